"""Each operator against a plain version on small tables, and on odd rows."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from mediaspan.llm import components, decontaminate, gru, licenses, lm, minhash, mixing, packs, pii, queries, repeats, shared, tokens, topk, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept int, size string, words string"
LONG = "lorem ipsum dolor sit amet consectetur " * 4000
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n ", "en", "a", 3), (4, "one two three four five six seven eight nine ten", "en", "b", 1), (4, "one two three four five six seven eight nine ten", "en", "b", 1),
    (5, "one two three four five six seven eight nine ten", "en", None, 1), (6, LONG, "en", "b", 1), (7, "É ß İ x@y.zz +1 (459) 555-9246 and 4111 1111 1111 1111 or 1.2.3.4 <|endoftext|>", "fr", "c", 1), (None, "one two three four five six seven eight nine ten", None, None, None),
    (8, LONG[7:], "en", "b", 1), (9, "Licensed under CC BY-NC 4.0.\nReleased under the MIT License.", "en", "é", 1),
]


def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, ODD)


@pytest.fixture(scope="module")
def none(spark):
    return docs(spark, [])


@pytest.fixture(scope="module")
def corpus():
    """Random texts with exact and near copies and shared passages."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(300)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 90))) for _ in range(60)]
    for i in range(40):
        words = texts[rng.randrange(40)].split()
        for _ in range(rng.randint(0, 3)):
            if words:
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts.append(" ".join(words))
    return list(enumerate(texts))


def table(spark, rows):
    return docs(spark, [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in rows])


def words(text):
    return (text or "").encode().lower().split()


def test_words_and_shingles():
    texts = [t for _, t, *_ in ODD if t is not None] + ["a", "B b", "a  b\x0bC"]
    data, offsets = shared.buffer(pa.array(texts))
    hashes, first, starts, ends = shared.words(data, offsets)
    found = [[data[s:e].tobytes().lower() for s, e in zip(starts[a:b], ends[a:b])] for a, b in zip(first[:-1], first[1:])]
    assert found == [words(t) for t in texts]
    every = [w for t in texts for w in words(t)]
    assert len(set(hashes.tolist())) == len(set(every))
    _, at = shared.shingles(hashes, first, 3)
    assert np.diff(at).tolist() == [max(len(w) - 2, min(1, len(w))) for w in map(words, texts)]


def targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """Shares again and again what is above a cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), {}
    while True:
        left = [s for s in names if s not in full]
        level = (total - sum(full.values())) / max(1e-9, sum(w[s] for s in left)) if left else 0
        over = [s for s in left if level * w[s] > cap * sizes[s]]
        if not over:
            return {**full, **{s: level * w[s] for s in left}}
        full |= {s: cap * sizes[s] for s in over}


def test_mixing(spark, corpus, odd, none):
    for source in (table(spark, corpus), odd):
        got, again = [sorted((tuple(r) for r in mixing.mix(df).collect()), key=str) for df in (source, source.repartition(7))]
        assert got == again
        rows = source.collect()
        sizes = collections.defaultdict(int)
        for r in rows:
            sizes[r["source"]] += len(words(r["text"]))
        assert len(got) == len(rows)
        goal = targets(dict(sizes))
        taken = collections.defaultdict(int)
        for _, s, size, total, target, copies, took in got:
            assert total == sizes[s] and target == pytest.approx(goal[s]) and took == copies * size <= 2 * size
            assert not size or math.floor(target / total + 1e-9) <= copies <= math.ceil(target / total - 1e-9)
            taken[s] += took
        for s, n in taken.items():
            largest = max(len(words(r["text"])) for r in rows if r["source"] == s)
            assert abs(n - goal[s]) <= 2 * largest
    assert mixing.mix(none).count() == 0


def test_pii(spark, odd, none):
    got = {r["doc_id"]: r for r in pii.digest(pii.find(odd)).collect()}
    assert len(pii.find(odd).collect()) == len(ODD)
    assert [got[7][f"n_{k}"] for k in pii.KINDS] == [1, 1, 1, 1]
    assert got[1]["spans"] == "" and got[1]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    text = ODD[7][1]
    for span in got[7]["spans"].split(","):
        kind, a, b = span.split(":")
        assert text[int(a) : int(b)] in ("x@y.zz", "+1 (459) 555-9246", "4111 1111 1111 1111", "1.2.3.4")
    assert pii.find(none).count() == 0
    # A number like a found one takes its label from it; one like none stays unlabelled.
    many = [(i, f"call +1 459 555 {1000 + i} now", "en", "a", 1) for i in range(60)] + [(100, "call +1 459 555 9246 or 459-555-9246 x 1234567 y", "en", "a", 1)]
    spans = {r["doc_id"]: r["spans"] for r in pii.find(docs(spark, many)).collect()}[100]
    assert [(s["kind"], s["by"]) for s in spans] == [("phone", "pattern"), ("phone", "field")]


def test_pii_adds_mail_written_otherwise(spark):
    rows = [(i, f"write to user.{i}@site{i}.org today", "en", "a", 1) for i in range(60)]
    rows.append((100, "jane.doe@example.org, jane.doe (at) example (dot) org, jane.doe@localhost, Jane.Doe at example dot org; john.roe (at) example.org", "en", "a", 1))
    rows.append((101, "jane.doe (at) example.org and @decorator x@y", "en", "a", 1))
    got = {r["doc_id"]: r["spans"] for r in pii.find(docs(spark, rows)).collect()}
    text = rows[60][1]
    assert [(text[s["start"] : s["end"]], s["by"]) for s in got[100]] == [
        ("jane.doe@example.org", "pattern"), ("jane.doe (at) example (dot) org", "field"), ("jane.doe@localhost", "field"), ("Jane.Doe at example dot org", "field"),
    ]
    assert got[101] == []


def test_pii_patterns_are_the_plain_ones():
    """base() against the patterns as they are stated, on random strings of their characters."""
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

    def sound(digits):
        doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
        return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0

    rng = random.Random(11)
    for _ in range(4000):
        text = "".join(rng.choices(rng.choice(["ab@.-1", "0123.9", "0 -42", "+1() .-5", "a@. 0+-é9"]), k=rng.randint(0, 60)))
        digits = lambda m: re.sub("[^0-9]", "", m.group())
        want = [(m.start(), 0, m.end()) for m in email.finditer(text)]
        want += [(m.start(), 1, m.end()) for m in ip.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
        want += [(m.start(), 2, m.end()) for m in card.finditer(text) if 12 <= len(digits(m)) <= 19 and sound(digits(m))]
        want += [(m.start(), 3, m.end()) for m in phone.finditer(text) if 9 <= len(digits(m)) <= 15]
        assert pii.base(text)[0] == sorted(want), text


def test_pii_marginals():
    """Sum-product on a tree against the sums over all labellings."""
    rng = np.random.default_rng(3)
    edges = np.array([(0, 1), (1, 2), (1, 3)])
    unary, tables = rng.normal(size=(4, pii.LABELS)), rng.normal(size=(3, pii.LABELS, pii.LABELS))
    tables = tables + tables.transpose(0, 2, 1)
    want = np.zeros_like(unary)
    for labels in itertools.product(range(pii.LABELS), repeat=4):
        w = np.exp(sum(unary[i, y] for i, y in enumerate(labels)) + sum(t[labels[a], labels[b]] for (a, b), t in zip(edges, tables, strict=True)))
        want[range(4), labels] += w
    assert np.allclose(pii.marginals(unary, edges, tables, 60), want / want.sum(1, keepdims=True), atol=1e-6)


def test_pii_is_linear():
    for text in ("a" * 200_000 + "@", "1" * 200_000, "+1" + " " * 200_000, "1." * 100_000, "@" * 100_000, "1-" * 100_000):
        pii.base(text)
    for text in ("a" * 200_000 + "@", "a at " * 40_000, "a (at) b (dot) " * 20_000, "@" * 100_000, "a@" * 100_000):
        pii.Nodes("x@y.zz " + text).links()


def test_decontamination(spark, corpus, odd, none):
    rng = random.Random(3)
    items = [(i, " ".join(rng.choices("qrstuvwxyz", k=1)[0] * 3 + str(rng.randrange(50)) for _ in range(rng.choice([3, 12, 30, 44])))) for i in range(20)] + [(20, None), (21, ""), (22, "one two three four five six seven eight nine ten")]
    rows = [(i, t + " " + items[i % 20][1] if i % 3 == 0 else t) for i, t in corpus]
    broken = items[3][1].split()
    broken[len(broken) // 2] = "zzz"
    rows.append((500, " ".join(broken)))
    benchmark = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.contaminated(table(spark, rows), benchmark).collect()}
    expected = {}
    for d, t in rows:
        w = words(t)
        for i, x in items:
            n = len(words(x))
            size = min(5, n)
            cut = lambda v: collections.Counter(tuple(v[k : k + size]) for k in range(len(v) - size + 1))
            best = 0
            for a in range(-n + 1, len(w)) if n else []:
                mine, own = cut(w[max(0, a) : a + n]), cut(words(x))
                best = max(best, sum((mine & own).values()) / max(1, sum((mine | own).values())))
            if best >= 0.8:
                expected[d, i] = best
    assert got.keys() == expected.keys() and all(got[k] == pytest.approx(expected[k]) for k in got) and len(got) > 30
    assert {r["doc_id"] for r in decontaminate.contaminated(odd, benchmark).collect()} == {4, 5, None}
    assert decontaminate.clean(odd, benchmark).count() == len(ODD) - 3
    assert decontaminate.contaminated(none, benchmark).count() == decontaminate.contaminated(odd, benchmark.limit(0)).count() == 0


def test_decontamination_of_reordered_items(spark):
    item = [f"w{k}" for k in range(60)]
    around = [f"x{k}" for k in range(80)]
    rows = [(k, " ".join(around + item[k:] + item[:k] + around)) for k in (0, 10, 20, 30)] + [(99, " ".join(around + item[::-1]))]
    benchmark = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    grams = lambda v: collections.Counter(tuple(v[k : k + 5]) for k in range(len(v) - 4))
    own, expected = grams(item), {}
    for d, t in rows:
        w = t.split()
        likes = [((grams(w[max(0, a) : a + 60]) & own).total() / (grams(w[max(0, a) : a + 60]) | own).total(), a) for a in range(-59, len(w))]
        if max(likes)[0] >= 0.8:
            expected[d] = max(likes)[0]
    got = {r["doc_id"]: r["similarity"] for r in decontaminate.contaminated(table(spark, rows), benchmark).collect()}
    assert got == pytest.approx(expected) and got.keys() == {0, 10, 20, 30}
    assert [r["doc_id"] for r in decontaminate.clean(table(spark, rows), benchmark).collect()] == [99]


def test_stretches_and_rolled_fingerprints():
    rng = np.random.default_rng(2)
    places = np.unique(rng.integers(0, 400, 90))
    for width, least in ((20, 4), (20, 9), (1, 1), (400, 80)):
        inside = {b for a, z in decontaminate.stretches(places, width, least) for b in range(a, z + 1)}
        assert inside == {b for b in range(-500, 900) if ((places >= b) & (places < b + width)).sum() >= least}
    found = rng.integers(0, 2**63, 300, dtype=np.uint64)
    begin = np.arange(40, 90)
    end = np.minimum(begin + 60, 120)
    plain = [decontaminate.fingerprints(found[a:b], np.array([0]))[0] for a, b in zip(begin, end)]
    assert decontaminate.rolled(found, begin, end).tolist() == plain


def test_decontamination_of_long_repeats_is_bounded():
    import tracemalloc

    words_ = [f"w{k}" for k in range(400)]
    items = decontaminate.Items([1], [" ".join(words_)])
    text = " ".join(words_[:200] * 150 + words_[200:] + words_[:200])
    data, offsets = shared.buffer(pa.array([text]))
    hashes, first, _, _ = shared.words(data, offsets)
    tracemalloc.start()
    got = decontaminate.matches(items, hashes, first)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got and max(x[4] for x in got) > 0.98 and peak < 80 << 20


def test_hamming_blocks():
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 2**63, 200, dtype=np.uint64)
    near = prints.copy()
    for k in range(decontaminate.RADIUS):
        near ^= np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64)
    blocks = decontaminate.Blocks(prints)
    for x, found in zip(near, blocks.find(near)):
        assert found.tolist() == np.flatnonzero(np.bitwise_count(prints ^ x) <= decontaminate.RADIUS).tolist()


def removed(rows, length=50):
    first, out = {}, {}
    for d, t in sorted(rows):
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            first.setdefault(b[i : i + length], d)
    for d, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < d:
                gone[i : i + length] = [True] * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.setdefault(d, []).append((len(b), sum(gone), sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return {d: sorted(v) for d, v in out.items()}


def test_repeats(spark, corpus, odd, none):
    for rows, df in ((corpus, table(spark, corpus).repartition(5)), ([r[:2] for r in ODD if r[0]], odd)):
        got = collections.defaultdict(list)
        for r in repeats.digests(repeats.repeats(df)).collect():
            if r["doc_id"] is not None:
                got[r["doc_id"]].append(tuple(r)[1:])
        assert {d: sorted(v) for d, v in got.items()} == removed(rows)
    assert repeats.repeats(none).count() == 0
    spans = {r["doc_id"]: r for r in repeats.repeats(odd).collect()}
    raw = LONG[7:].encode()
    assert spans[8]["kept"] == b"".join([raw[a:b] for a, b in zip([0] + [s["end"] for s in spans[8]["spans"]], [s["start"] for s in spans[8]["spans"]] + [len(raw)])])


def test_family_levels_grow():
    family, rng = repeats.Family(), np.random.default_rng(0)
    seen = {}
    for k in range(12):
        text = rng.integers(97, 99, (40, repeats.LENGTH)).astype(np.uint8)
        text[:, 5:] = 97
        text = text.view(f"S{repeats.LENGTH}").ravel()
        least = family.add(text, np.full(40, k))
        for x, owner in zip(text, least):
            assert owner == seen.setdefault(x, k)
    sizes = [len(x[0]) for x in family.levels]
    assert sum(sizes) == len(seen) and all(b * 2 < a for a, b in zip(sizes, sizes[1:]))


def test_toxicity(spark, odd, none):
    rng = random.Random(7)
    plain = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(400)]
    rows, labels = [], []
    for i in range(900):
        text, bad = rng.choices(plain, k=60), i % 4 == 0
        if bad:
            for _ in range(4):
                text[rng.randrange(60)] = rng.choice(["zqx", "wvk", "qqv"]) + rng.choice("abcde")
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad), "a"))
    frame = spark.createDataFrame(labels + [(None, 1, "b"), (5000, None, "c"), (0, None, "d")], "doc_id long, toxic int, text string")
    got = {r["doc_id"]: r for r in toxicity.toxicity(table(spark, rows), frame).collect()}
    for i, bad, _ in labels:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= got[i]["score"] <= 1 and got[i]["predicted"] == (got[i]["score"] >= 0.7)
    held = [(got[i]["predicted"], bad) for i, bad, _ in labels if got[i]["held_out"]]
    assert sum(p == b for p, b in held) >= 0.97 * len(held)
    assert toxicity.toxicity(odd, frame).count() == len(ODD)
    assert {r["score"] for r in toxicity.toxicity(odd, frame.limit(0)).collect()} == {0.5}
    assert toxicity.toxicity(none, frame).count() == 0


def test_toxicity_keeps_every_expression(spark):
    rng = random.Random(11)
    rows = [(" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=10)) for _ in range(200)), i % 2, i // 2 % 2) for i in range(60)]
    frame = spark.createDataFrame(rows, "text string, toxic int, fold int").select("toxic", "fold", "text")
    counts = shared.kept(toxicity.gram_counts(toxicity._packed(frame, ["toxic", "fold"])))
    seen = {}
    for text, bad, _ in rows:
        for word in text.split():
            w = f"\1{word}\1"
            for end in range(1, len(w)):
                for size in range(1, min(end + 1, 7) + 1):
                    seen.setdefault(w[end + 1 - size : end + 1], [0, 0])[bad] += 1
    assert counts.count() == len(seen) > 250_000
    ends = collections.Counter(g[1:] for g in seen if len(g) > 1)
    after = collections.defaultdict(list)
    for g in seen:
        after[g[:-1]].append(g)

    def plain(word):
        w, total = f"\1{word}\1", 0.0
        for end in range(1, len(w)):
            chance = 1 / 256
            for size in range(1, min(end + 1, 7) + 1):
                g = w[end + 1 - size : end + 1]

                def step(below, count, prior, g=g):
                    all_of = [count(x) for x in after[g[:-1]]] if g[:-1] in after else []
                    if not sum(all_of) + prior:
                        return below
                    own = count(g) if g in seen else 0
                    return (own - min(own, 0.75) + below * (sum(min(x, 0.75) for x in all_of) + prior)) / (sum(all_of) + prior)

                chance = step(chance, lambda x: ends[x] or sum(seen[x]), 0.0)
                each = [step(chance, lambda x, c=c: seen[x][c], 20.0) for c in (0, 1)]
            total += math.log(each[1]) - math.log(each[0])
        return total

    text = f"{rows[0][0]} {rows[1][0]} nowhereseen q"
    packed = toxicity._packed(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    replies = toxicity.word_ratios(packed, toxicity.estimates(counts), [2]).orderBy("part").collect()
    got = np.concatenate([toxicity._open(r["ratios"], float) for r in replies])
    hashes = shared.words(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))[0]
    expected = dict(zip(hashes.tolist(), map(plain, text.split()), strict=True))
    assert np.allclose(got, [expected[h] for h in sorted(expected)], atol=1e-9) and len(got) == 402


def test_licenses(spark, odd, none):
    got = [(r["doc_id"], r["license"], r["n_differences"]) for r in licenses.scan(odd).collect()]
    assert sorted(got) == [(9, "CC-BY-NC-4.0", 0), (9, "MIT", 0)]
    assert licenses.scan(none).count() == 0
    text = licenses.TEMPLATES["MIT"][1].replace("free of charge", "free of fee")
    found = licenses.Scanner(licenses.TEMPLATES).scan("aaa " * 50 + text + " bbb" * 50)
    assert [(x["license"], x["differences"]) for x in found] == [("MIT", "-charge +fee")]
    for name, texts in licenses.TEMPLATES.items():
        for t in texts:
            assert [x["license"] for x in licenses.Scanner(licenses.TEMPLATES).scan("x y z. " + t + " more words")] == [name]


def best(rows, every=50, k=5):
    fine = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            fine.setdefault(i, []).append([math.floor(256 * float(x)) for x in v])
    out = set()
    for q, vs in fine.items():
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(min(vs), v)), i) for i, ws in fine.items() if i != q for v in ws)
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])}
    return out


def test_topk(spark):
    rng = random.Random(2)
    rows = [(i, [round(rng.uniform(-1, 1), 1) * (rng.random() < 0.7) for _ in range(6)]) for i in range(230)]
    rows += [(7, rows[7][1]), (None, [1.0] * 6), (300, None), (350, [float("nan")] * 6), (400, [None] * 6), (450, []), (451, [0.5]), (452, [float("inf")] * 6)]
    frame = spark.createDataFrame([(*r, 0, 1.0) for r in rows], "vec_id long, embedding array<double>, score int, cblock double")
    got = {tuple(r) for r in topk.search(frame, block=50, query_block=2).collect()}
    assert got == best(rows)
    assert topk.search(frame.limit(0)).count() == 0
    assert topk.search(frame.where("vec_id = 50")).count() == 0


def test_topk_copies_of_query_blocks_are_not_broadcast(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice((0.0, 0.25, -0.5, x)) for x in (0.1, 0.7, -0.9)]) for i in range(400)]
    found = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=10, block=50, query_block=7)
    assert {tuple(r) for r in found.collect()} == best(rows, every=10)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_topk_of_dense_rare_and_long_postings():
    for most in (200, 2**20, 2**40):
        rng = np.random.default_rng(most)
        ids, c = np.arange(90), rng.integers(-most, most, (90, 4))
        c[rng.random(90) < 0.9, 1] = 0
        c[rng.random(90) < 0.4, 2] = 0
        a, b, s = topk.block_top(3, (ids[::2], c[::2]), (ids, c))
        for q in ids[::2]:
            scored = sorted((-sum(int(x) * int(y) for x, y in zip(c[q], c[i], strict=True)), i) for i in ids if i != q)[:3]
            hold = lambda x: min(max(x, -(2**63)), 2**63 - 1)
            assert sorted(zip(b[a == q].tolist(), s[a == q].tolist(), strict=True)) == sorted((i, hold(-x)) for x, i in scored)


def test_gru_gradients():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) + rng.standard_normal(v.shape) * 0.3 for k, v in gru.start(np.ones(gru.WORDS)).items()}
    before, token, begin = rng.integers(0, 40, (6, 3)), rng.integers(0, 40, (6, 3)), np.zeros((6, 3), bool)
    begin[0], begin[3, 1] = True, True
    h = np.zeros((3, gru.STATE))

    def loss():
        states, _, _ = gru.run(p, before, begin, h.astype(np.float32), False)
        return -gru.log_chances(p, states.reshape(-1, gru.STATE).astype(np.float64), token.ravel()).sum()

    grads, _, n = gru.train_window(p, before, token, begin, h)
    assert n == 18
    used, sums = grads["into"]
    whole = np.zeros_like(p["into"])
    whole[used] = sums
    grads["into"] = whole
    for k, g in grads.items():
        places = np.argsort(-np.abs(g).ravel())[:4]
        for at in places:
            spot = np.unravel_index(at, g.shape)
            old, step = p[k][spot], 1e-2
            p[k][spot] = old + step
            up = loss()
            p[k][spot] = old - step
            down = loss()
            p[k][spot] = old
            assert (up - down) / (2 * step) == pytest.approx(g[spot], rel=0.03, abs=0.01)


def test_gru_streams_match_one_by_one():
    rng = np.random.default_rng(4)
    p = gru.start(rng.random(gru.WORDS) * 9)
    texts = [np.append(rng.integers(1, gru.WORDS, n), gru.END) for n in (0, 3, 90, 1, 200, 17)]
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    together = gru.score(p, np.concatenate(texts), first)
    for t, a, b in zip(texts, first[:-1], first[1:]):
        assert gru.score(p, t, np.array([0, len(t)])) == pytest.approx(together[a:b], rel=1e-4, abs=1e-4)


def test_lm(spark, corpus, odd, none):
    for rows, df in ((corpus, table(spark, corpus)), ([r[:2] for r in ODD], odd)):
        counts, texts = collections.Counter(), collections.defaultdict(list)
        for d, t in rows:
            texts[d].append(words(t) + [None])
            if d is None or zlib.crc32(str(d).encode()) % 7 != 2:
                counts.update(words(t) + [None])
        total, kinds = sum(counts.values()), len(counts)
        got = lm.scores(df).collect()
        assert len(got) == len(rows)
        for r in got:
            same = [t for t in texts[r["doc_id"]] if len(t) == r["n_tokens"]]
            assert same and r["train_tokens"] == total and r["n_known"] == sum(counts[w] > 0 for w in same[0])
            assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in same[0]))
            assert r["score"] < 0
    assert lm.scores(none).count() == 0


def test_lm_chances_sum_to_one(spark, corpus):
    packed = packs.packs(table(spark, corpus))
    lexicon = lm.Lexicon(lm.counted(lm.coded(packed), 3, 2, 7))
    p = gru.start(lexicon.counts)
    h = np.random.default_rng(0).standard_normal((1, gru.STATE)).astype(np.float32)
    assert np.exp(gru.log_chances(p, np.repeat(h, gru.WORDS, 0), np.arange(gru.WORDS))).sum() == pytest.approx(1, abs=1e-4)
    assert lexicon.counts[1 : len(lexicon.word) + 1].sum() + lexicon.ends + lexicon.rare_tokens == lexicon.tokens


def linked(rows, size, threshold):
    sets = {}
    for d, t in rows:
        w = words(t)
        if d is not None:
            sets.setdefault(d, []).append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if any(x and y and 100 * len(x & y) >= threshold * len(x | y) for x in sets[a] for y in sets[b]):
                ra, rb = sorted((root(a), root(b)))
                parent[rb] = ra
    return {d: root(d) for d in ids}, sets


@pytest.mark.parametrize("size,threshold", [(3, 85), (5, 80)])
def test_minhash(spark, corpus, odd, none, size, threshold):
    for rows, df in ((corpus, table(spark, corpus)), ([r[:2] for r in ODD], odd)):
        expected, sets = linked(rows, size, threshold)
        got = minhash.near_duplicates(df, size, threshold).collect()
        assert len(got) == len(rows)
        for r in got:
            if r["doc_id"] is None:
                assert r["component_id"] is None and r["kept"] is None and r["n_shingles"] > 0
                continue
            assert r["component_id"] == expected[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"]) and r["n_shingles"] in map(len, sets[r["doc_id"]])
    assert minhash.near_duplicates(none).count() == 0


def test_large_clusters_lose_no_link(spark):
    """A cluster of many chunks, with groups that only some pairs across chunks join."""
    rng = random.Random(1)
    start = [f"w{i}" for i in range(120)]
    rows, text = [], list(start)
    for i in range(90):  # a chain: each text is like the next ones only
        for _ in range(2):
            text[rng.randrange(len(text))] = f"v{rng.randrange(10**6)}"
        rows.append((i * 7 % 90, " ".join(text)))
    df = table(spark, rows)
    every = minhash.signed(df, 3, minhash.bands(85)).select("doc_id").toPandas()["doc_id"].tolist()
    links = spark.createDataFrame([(0, x) for x in every if x], "a long, b long")
    found = minhash.confirmed(df, links, 3, 85, chunk=8)
    label = {r["id"]: r["component"] for r in components.components(found).collect()}
    expected, _ = linked(rows, 3, 85)
    assert {d: label.get(d, d) for d in every} == expected


def test_components(spark):
    rng = random.Random(9)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)]
    parent = {x: x for p in links for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        ra, rb = sorted((root(a), root(b)))
        parent[rb] = ra
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for p in links if p[0] != p[1] for x in p}


def test_token_files(spark, odd, none, tmp_path):
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(queries.vocabulary())
    tokens.write(odd, str(tmp_path / "a"), queries.vocabulary())
    got = sorted(tokens.read(spark, str(tmp_path / "a")).collect(), key=lambda r: r["start"])
    start = 0
    for r, (d, t, *_) in zip(got, sorted(ODD, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))):
        ids = np.array(one.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        assert tuple(r) == (d, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(got) == len(ODD)
    tokens.write(none, str(tmp_path / "b"), queries.vocabulary())
    assert tokens.read(spark, str(tmp_path / "b")).count() == 0


def test_encoder_matches_the_library():
    from tokenizers import Tokenizer

    one, own = Tokenizer.from_file(queries.vocabulary()), tokens.Encoder(queries.vocabulary(), most=40)
    rng = random.Random(11)
    texts = ["".join(rng.choices("aB'sé.,!<|>@ \n\t-5́ß…", k=rng.randrange(60))) for _ in range(200)] + ["it's we'll. <|endoftext|>x. <|ENDOFTEXT|> don't,'s"]
    for a in range(0, len(texts), 20):
        data, offsets = shared.buffer(pa.array(texts[a : a + 20]))
        ids, counts = own(data, offsets)
        cuts = np.concatenate([[0], np.cumsum(counts)])
        for t, i, j in zip(texts[a : a + 20], cuts[:-1], cuts[1:]):
            assert ids[i:j].tolist() == one.encode(t, add_special_tokens=False).ids


def test_random_access():
    rng = np.random.default_rng(1)
    values = (rng.integers(0, 2**32, 3000, dtype=np.uint64) >> rng.integers(0, 31, 3000).astype(np.uint64)).astype(np.uint32)
    block = tokens.Block(tokens.encode_block([4, None, 6], np.array([1000, 0, 2000]), values))
    assert (block.all() == values).all() and [block.token(i) for i in range(3000)] == values.tolist()
    assert block.null.tolist() == [0, 1, 0] and block.counts.tolist() == [1000, 0, 2000]


def test_pipeline(spark, odd, none):
    pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    first = shared.table(spark, sf, "documents")
    inputs, outputs, df = [], [], first
    for _, stage in pipeline.STAGES:
        inputs.append(df)
        df = shared.kept(stage(spark, df, sf))
        outputs.append(df)
    for before, after in zip(inputs[:4], outputs[:4]):
        assert after.columns == before.columns
    ids = [[r["doc_id"] for r in x.select("doc_id").collect()] for x in (first, *outputs)]
    scored = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(first, shared.table(spark, sf, "labels")).collect()}
    assert sorted(ids[1]) == sorted(d for d in ids[0] if not scored[d])
    texts = {r["doc_id"]: r["text"] for r in first.collect()}
    label, _ = linked([(d, texts[d]) for d in ids[1]], 5, 80)
    assert sorted(ids[2]) == sorted(d for d in ids[1] if label[d] == d)
    bad = {r["doc_id"] for r in decontaminate.contaminated(outputs[1], shared.table(spark, sf, "benchmark")).collect()}
    assert sorted(ids[3]) == sorted(set(ids[2]) - bad)
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(outputs[2]).collect()}
    assert collections.Counter(ids[4]) == collections.Counter({d: n for d, n in copies.items() if n})
    assert sorted(ids[5]) == sorted(ids[4])
    for _, stage in pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0
        assert stage(spark, odd, sf).count() > 0


def test_pipeline_keeps_odd_rows(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(4)
    a, b, c, d = (" ".join(f"{x}{rng.randrange(1000)}" for _ in range(60)) for x in "abcd")
    rows = [(1, a), (1, a), (1, b), (2, a + " more"), (3, b + " more"), (3, d), (None, c), (None, c), (None, a), (None, c + " more"), (None, ""), (None, None)]
    kept = pipeline.near_duplicates(spark, table(spark, rows[:0]).unionByName(docs(spark, [(i, t, "en", "s", 1) for i, t in rows])), "")
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert sorted(x for x in got if x[0]) == sorted([(1, a), (1, b), (3, d)])
    others = [t for i, t in got if i is None]
    assert len(others) == 3 and "" in others and None in others and (c in others or c + " more" in others)
    rows = [(rng.choice([None, 1, 2, 3]), " ".join("w" * rng.randint(1, 3)), "en", rng.choice([None, "s0", "s1", "s2"]), 1) for _ in range(200)]
    frame = shared.kept(docs(spark, rows + rows[:40]))
    size = lambda t: len((t or "").split())
    mixed = collections.Counter((r["doc_id"], r["source"], size(r["text"])) for r in pipeline.mixture(spark, frame, "").collect())
    expected = collections.Counter()
    for r in mixing.mix(frame).collect():
        expected[r["doc_id"], r["source"], r["size"]] += r["copies"]
    assert mixed == +expected and any(k[0] is None for k in mixed)


def test_pipeline_loses_no_row_to_a_shared_hash(spark, monkeypatch):
    pipeline = pytest.importorskip("corpus_pipeline")
    from pyspark.sql import functions as F

    whole = pipeline._hash
    monkeypatch.setattr(pipeline, "_hash", lambda *columns, seed=0: whole(*columns, seed=seed) if seed else F.lit(7).cast("long"))
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(50)) for _ in range(4)]
    frame = docs(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(0, texts[0], "en", "s", 1)])
    assert sorted(r["doc_id"] for r in pipeline.near_duplicates(spark, frame, "").collect()) == [0, 1, 2, 3]
    toxic_only = lambda rows, classifier, keys: rows.where(F.col("text") == texts[2]).select(*keys, F.lit(1).alias("predicted"))
    monkeypatch.setattr(toxicity, "fit", lambda *a: None)
    monkeypatch.setattr(toxicity, "score", toxic_only)
    assert sorted(r["doc_id"] for r in pipeline.toxic(spark, frame, "/root/testdata/sf0.001").collect()) == [0, 0, 1, 3]
