"""A small gated recurrent network over word ids, in numpy: the output is factored into classes."""

from __future__ import annotations

import heapq

import numpy as np

#: Width of the state, classes, words in a class, tokens a window, streams side by side, and the
#: least tokens whose gradients make a step.
STATE, CLASSES, MEMBERS, WINDOW, STREAMS, LEAST = 24, 64, 64, 16, 256, 1024
WORDS = CLASSES * MEMBERS
END, RARE = 0, WORDS - 1


def start(counts: np.ndarray, seed: int = 0) -> dict[str, np.ndarray]:
    """First parameters; output biases from the words' counts."""
    rng = np.random.default_rng(seed)
    log = np.log(np.maximum(counts, 0.5).reshape(CLASSES, MEMBERS))
    whole = np.log(np.exp(log - log.max()).sum(1)) + log.max()
    shapes = {"into": (WORDS, 3 * STATE), "over": (STATE, 3 * STATE), "kind": (STATE, CLASSES), "word": (CLASSES, STATE, MEMBERS)}
    out = {k: (rng.standard_normal(s) * 0.1).astype(np.float32) for k, s in shapes.items()}
    # The last row of an output's weights is its bias.
    out["kind"] = np.concatenate([out["kind"], (whole - whole.max()).astype(np.float32)[None]])
    out["word"] = np.concatenate([out["word"], (log - whole[:, None]).astype(np.float32)[:, None]], 1)
    return out


def packed(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def unpacked(flat: np.ndarray) -> dict[str, np.ndarray]:
    shapes = {k: v.shape for k, v in start(np.ones(WORDS)).items()}
    out, at = {}, 0
    for k in sorted(shapes):
        n = int(np.prod(shapes[k]))
        out[k] = flat[at : at + n].reshape(shapes[k]).astype(np.float32)
        at += n
    return out


def streams(lengths: np.ndarray, wide: int = STREAMS) -> tuple[np.ndarray, np.ndarray]:
    """Deals texts, longest first, to the shortest of `wide` streams: the place of each text's
    first token, counted stream by stream, and the streams' lengths, longest first."""
    heap = [(0, s) for s in range(wide)]
    where = np.zeros((len(lengths), 2), np.int64)
    for i in np.argsort(-lengths, kind="stable"):
        used, s = heapq.heappop(heap)
        where[i] = s, used
        heapq.heappush(heap, (used + int(lengths[i]), s))
    used = np.zeros(wide, np.int64)
    for u, s in heap:
        used[s] = u
    order = np.argsort(-used, kind="stable")
    rank = np.empty(wide, np.int64)
    rank[order] = np.arange(wide)
    return rank[where[:, 0]] * used.max() + where[:, 1], used[order]


class Laid:
    """Texts' tokens (each text ends with END) dealt to streams, one array after another."""

    def __init__(self, ids: np.ndarray, first: np.ndarray, wide: int = STREAMS):
        lengths = np.diff(first)
        wide = max(1, min(wide, int((lengths > 0).sum())))
        place, used = streams(lengths, wide)
        stream, spot = np.divmod(place, max(1, int(used[0])))
        self.used, self.start = used, np.cumsum(used) - used
        place = self.start[stream] + spot
        self.at = np.empty(len(ids), np.int64)
        self.at[np.repeat(place - first[:-1], lengths) + np.arange(len(ids))] = np.arange(len(ids))
        self.token = ids[self.at]
        self.opens = np.zeros(len(ids) + 1, bool)
        self.opens[place[lengths > 0]] = True

    def windows(self, size: int):
        """Arrays of steps x streams: the token before (END at a text's start), the token (-1 past
        a stream's end), whether a text starts, and each token's place in ids. The streams that
        go on are the first ones."""
        for a in range(0, int(self.used[0]), size):
            wide = int(np.searchsorted(-self.used, -a))
            step = np.arange(a, min(a + size, int(self.used[0])))[:, None]
            inside = step < self.used[:wide]
            spot = np.minimum(self.start[:wide] + step, len(self.token) - 1)
            token, begin = self.token[spot], self.opens[spot] & inside
            before = np.where(begin | ~inside, END, self.token[spot - 1])
            yield before, np.where(inside, token, -1), begin, self.at[spot]


def run(p, before, begin, h, keep: bool):
    """States after each step (steps x streams x STATE) and the last ones; the states before, gates,
    fresh states and draws behind them if they are to be kept.

    Inside, and in what is kept, streams are the last axis, so that each gate is one block of memory.
    """
    steps, wide = before.shape
    drawn, over, opens = np.ascontiguousarray(p["into"][before].transpose(0, 2, 1)), np.ascontiguousarray(p["over"].T), begin.any(1)
    kind = drawn.dtype
    # Before the window and after each of its steps.
    out = np.empty((steps + 1, STATE, wide), np.float32)
    out[0] = h.T
    gates, fresh = np.empty((steps if keep else 1, 2 * STATE, wide), kind), np.empty((steps if keep else 1, STATE, wide), kind)
    ys = np.empty((steps if keep else 1, 3 * STATE, wide), kind)
    held = np.empty((steps, STATE, wide), np.float32) if keep else None
    for t in range(steps):
        k = t if keep else 0
        x, y, gate, new_part, h = drawn[t], ys[k], gates[k], fresh[k], out[t]
        if opens[t]:
            h = np.where(begin[t], np.float32(0), h)
        if keep:
            held[t] = h
        np.matmul(over, h, out=y)
        np.add(x[: 2 * STATE], y[: 2 * STATE], out=gate)
        np.negative(gate, out=gate)
        np.exp(gate, out=gate)
        gate += 1
        np.reciprocal(gate, out=gate)
        np.multiply(gate[:STATE], y[2 * STATE :], out=new_part)
        new_part += x[2 * STATE :]
        np.tanh(new_part, out=new_part)
        mixed = h - new_part
        mixed *= gate[STATE:]
        np.add(mixed, new_part, out=out[t + 1], casting="same_kind")
    return np.ascontiguousarray(out[1:].transpose(0, 2, 1)), np.ascontiguousarray(out[-1].T), (held, gates, fresh, ys[:, 2 * STATE :])


def _powers(x):
    """e to the scores, in place, and each row's sum (a product with ones, which is much the faster)."""
    if x.size and (x.max() > 60 or x.min() < -60):
        x -= x.max(1, keepdims=True)
    np.exp(x, out=x)
    return x, x @ np.ones(x.shape[1], x.dtype)


def _by_class(tokens: np.ndarray):
    """The tokens' order by class; (class, from, to) for each class that has some."""
    order = np.argsort((tokens // MEMBERS).astype(np.int16), kind="stable")
    cuts = np.cumsum(np.bincount(tokens // MEMBERS, minlength=CLASSES))
    return order, [(c, int(b - n), int(b)) for c, (b, n) in enumerate(zip(cuts, np.diff(cuts, prepend=0), strict=True)) if n]


def _with_one(states):
    return np.concatenate([states, np.ones((len(states), 1), states.dtype)], 1)


def _word_powers(p, states, classes):
    """Of tokens in order of class: e to the scores of the words of its class, and their sums."""
    power = np.empty((len(states), MEMBERS), np.result_type(states, p["word"]))
    for c, a, b in classes:
        np.matmul(states[a:b], p["word"][c], out=power[a:b])
    return _powers(power)


def log_chances(p, states: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Natural log of P(token | state): of its class, and of the word within it."""
    order, classes = _by_class(tokens)
    states, tokens = _with_one(states[order]), tokens[order]
    rows = np.arange(len(tokens))
    power, total = _powers(states @ p["kind"])
    chance = power[rows, tokens // MEMBERS] / total
    power, total = _word_powers(p, states, classes)
    chance *= power[rows, tokens % MEMBERS] / total
    out = np.empty_like(chance)
    out[order] = np.log(np.maximum(chance, np.finfo(np.float32).tiny))
    return out


def _output_step(p, states, tokens, grads):
    """Adds the output's gradients of -sum log P to grads; returns those of the states."""
    order, classes = _by_class(tokens)
    states, tokens = _with_one(states[order]), tokens[order]
    rows = np.arange(len(tokens))
    soft, total = _powers(states @ p["kind"])
    soft *= (1 / total)[:, None]
    soft[rows, tokens // MEMBERS] -= 1
    back = soft @ p["kind"].T
    grads["kind"] = states.T @ soft
    soft, total = _word_powers(p, states, classes)
    soft *= (1 / total)[:, None]
    soft[rows, tokens % MEMBERS] -= 1
    grads["word"] = np.zeros_like(p["word"])
    more = np.empty_like(back)
    for c, a, b in classes:
        np.matmul(soft[a:b], p["word"][c].T, out=more[a:b])
        np.matmul(states[a:b].T, soft[a:b], out=grads["word"][c])
    back += more
    out = np.empty((len(back), STATE), back.dtype)
    out[order] = back[:, :STATE]
    return out


def train_window(p, before, token, begin, h):
    """Gradients of one window of truncated backpropagation, per token; the state it ends in."""
    states, last, (held, gates, fresh, drawn) = run(p, before, begin, h, True)
    steps, wide = before.shape
    real = token >= 0
    grads = {}
    back = np.zeros((steps, wide, STATE), np.float32)
    n = int(real.sum())
    back[real] = _output_step(p, states[real], token[real], grads)
    back = np.ascontiguousarray(back.transpose(0, 2, 1))
    over, opens = p["over"], begin.any(1)
    reset, hold = gates[:, :STATE], gates[:, STATE:]
    # What a state's gradient is multiplied by on its way to each of the sums below it.
    to_fresh = (1 - hold) * (1 - fresh * fresh)
    to_hold = (held - fresh) * hold * (1 - hold)
    to_reset = drawn * reset * (1 - reset)
    # Gradients at the sums of reset, hold and (from the state's side, then from the word's) fresh.
    sums = np.empty((steps, 4 * STATE, wide), np.float32)
    carry = np.zeros((STATE, wide), np.float32)
    for t in range(steps - 1, -1, -1):
        d, s = back[t], sums[t]
        d += carry
        new_part = s[3 * STATE :]
        np.multiply(d, to_fresh[t], out=new_part, casting="same_kind")
        np.multiply(new_part, to_reset[t], out=s[:STATE], casting="same_kind")
        np.multiply(d, to_hold[t], out=s[STATE : 2 * STATE], casting="same_kind")
        np.multiply(new_part, reset[t], out=s[2 * STATE : 3 * STATE], casting="same_kind")
        carry = over @ s[: 3 * STATE]
        carry += d * hold[t]
        if opens[t]:
            carry[:, begin[t]] = 0
    grads["over"] = np.matmul(held, sums[:, : 3 * STATE].transpose(0, 2, 1)).sum(0)
    sums[:, 2 * STATE : 3 * STATE] = sums[:, 3 * STATE :]
    flat, rows = before.ravel(), sums[:, : 3 * STATE].transpose(0, 2, 1).reshape(-1, 3 * STATE)
    order = np.argsort(flat.astype(np.int16), kind="stable")
    used, cut = np.unique(flat[order], return_index=True)
    grads["into"] = (used, np.add.reduceat(rows[order], cut, axis=0))
    return grads, last, n


def _both(a: dict, b: dict) -> dict:
    """Sums of gradients."""
    used, back = np.unique(np.concatenate([a["into"][0], b["into"][0]]), return_inverse=True)
    into = np.zeros((len(used), 3 * STATE), np.float32)
    np.add.at(into, back, np.concatenate([a["into"][1], b["into"][1]]))
    return {k: a[k] + b[k] for k in a if k != "into"} | {"into": (used, into)}


class Learner:
    """Adagrad over windows."""

    def __init__(self, p, rate: float = 0.12):
        self.p, self.rate = {k: v.copy() for k, v in p.items()}, rate
        self.square = {k: np.full_like(v, 1e-4) for k, v in p.items()}

    def step(self, grads, n: int) -> None:
        for k, g in grads.items():
            if k == "into":
                used, g = g
                g = g * np.float32(1 / n**0.5)
                s = self.square[k][used] + g * g
                self.square[k][used] = s
                self.p[k][used] -= self.rate * g / np.sqrt(s)
            else:
                g = g * np.float32(1 / n**0.5)
                self.square[k] += g * g
                self.p[k] -= self.rate * g / np.sqrt(self.square[k])

    def learn(self, ids: np.ndarray, first: np.ndarray) -> int:
        """One pass over whole texts; the state is carried from window to window. Where few streams
        go on, the windows of several steps in time make one step of learning."""
        rows, held, total = Laid(ids, first), None, 0
        h = np.zeros((len(rows.used), STATE), np.float32)
        for before, token, begin, _ in rows.windows(WINDOW):
            grads, h, n = train_window(self.p, before, token, begin, h[: before.shape[1]])
            held, total = grads if held is None else _both(held, grads), total + n
            if total >= LEAST:
                self.step(held, total)
                held, total = None, 0
        if total:
            self.step(held, total)
        return len(ids)


def score(p, ids: np.ndarray, first: np.ndarray, window: int = 64) -> np.ndarray:
    """Natural log of P of each token given all tokens of its text before it."""
    rows, out = Laid(ids, first), np.zeros(len(ids))
    h = np.zeros((len(rows.used), STATE), np.float32)
    for before, token, begin, at in rows.windows(window):
        states, h, _ = run(p, before, begin, h[: before.shape[1]], False)
        real = token >= 0
        out[at[real]] = log_chances(p, states[real], token[real])
    return out
