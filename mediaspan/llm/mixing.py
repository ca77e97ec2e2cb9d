"""Mixing sources to target weights by Pivotal dependent rounding, with DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediaspan.llm.shared import kept

#: A probability this close to 0 or 1 is 0 or 1.
EPS = 1e-9
#: Units that meet in one group of the reduction tree.
FAN = 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """sizes(source, size) -> one row (source, source_size, target) for each source.

    Sources by code point, null last, take the weights in turn. They share `share` times all
    sizes by weight, but none more than `cap` times its own size; what is above is reshared by
    weight. Filling in the order of cap over weight reaches the same fixed point in one pass:
    a source is full if the even level, with all fuller ones set aside, is above its own cap.
    The windows run over the aggregated table of sources, never over documents.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    turn = F.element_at(F.array(*map(F.lit, map(float, weights))), F.pmod(place - 1, F.lit(len(weights))) + 1)
    rated = totals.withColumn("w", turn).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    order = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (
        (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    )
    rated = rated.withColumn("level", level).withColumn("full", F.col("level") * F.col("w") >= F.col("most"))
    open_level = F.min(F.when(~F.col("full"), F.struct(F.col("most") / F.col("w"), "level"))).over(everything)["level"]
    target = F.when(F.col("full"), F.col("most")).otherwise(open_level * F.col("w"))
    return rated.withColumn("target", target).select("source", "source_size", "target")


def _fold(units: Column, level: int, seed: int) -> Column:
    """Pairs the units in order: of each pair one becomes integral, the other goes on."""

    def meet(state: Column, unit: Column) -> Column:
        held = state["held"]
        mass = held["p"] + unit["p"]
        chance = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(level), held["order"], unit["order"], held["doc_id"], unit["doc_id"]), 11) / F.lit(float(1 << 53))
        small = mass < 1
        wins = F.when(small, chance * mass < held["p"]).otherwise(chance * (2 - mass) < 1 - unit["p"])
        left = F.when(small, F.lit(0.0)).otherwise(F.lit(1.0))
        rest = F.when(small, mass).otherwise(mass - 1)
        stays = wins == small  # the held unit stays fractional

        def as_unit(x: Column, p: Column) -> Column:
            return F.struct(x["order"].alias("order"), x["doc_id"].alias("doc_id"), x["base"].alias("base"), p.alias("p"))

        goes_on = F.when(stays, as_unit(held, rest)).otherwise(as_unit(unit, rest))
        ends = F.when(stays, as_unit(unit, left)).otherwise(as_unit(held, left))
        return F.struct(goes_on.alias("held"), F.concat(state["done"], F.array(ends)).alias("done"))

    start = F.struct(units[0].alias("held"), F.slice(units, 1, 0).alias("done"))
    return F.aggregate(F.slice(units, F.lit(2), F.size(units)), start, meet)


def pivotal(units: DataFrame, rows: int, seed: int = 0) -> DataFrame:
    """units(source, doc_id, size, base, p), 0 < p < 1 -> the same units with copies = base + 0 or 1.

    E(copies) = base + p, and sums over a source stay within one unit of their expectation.
    Units of a source and size class meet in leaves of about FAN units (by a hash, so a source
    with a third of all rows is many leaves); each leaf's one fractional unit goes up a tree of
    that fan. Large units come first, so a leaf's words stay near their expectation too.
    """
    depth = max(0, math.ceil(math.log(max(rows, 1), FAN)) - 1)
    level = (
        units.withColumn("class", F.floor(F.log2(F.col("size").cast("double")) * 2).cast("int"))
        .withColumn("leaf", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(FAN**depth)))
        .withColumn("order", -F.col("size"))
    )
    done = None
    for k in range(depth + 2):
        top = k > depth
        keys = ["source"] if top else ["source", "class", "leaf"]
        met = level.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("order", "doc_id", "base", "p"))).alias("units"))
        met = met.withColumn("state", _fold(F.col("units"), k, seed))
        rest = F.transform(F.array("state.held"), lambda u: F.struct(u.alias("unit"), F.lit(True).alias("held")))
        over = F.transform("state.done", lambda u: F.struct(u.alias("unit"), F.lit(False).alias("held")))
        # Each level is a table of its own: the two branches below would else compute it twice.
        met = kept(met.select(*keys, F.explode(F.concat(over, rest)).alias("x")).select(*keys, "x.held", "x.unit.*"))
        near = (F.col("p") < EPS) | (F.col("p") > 1 - EPS)
        coin = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(-1), "order", "doc_id"), 11) / F.lit(float(1 << 53))
        risen = F.when(near, F.round("p")).otherwise((coin < F.col("p")).cast("double"))
        ended = met.where(~F.col("held") | near | F.lit(top)).select("source", "doc_id", (-F.col("order")).alias("size"), (F.col("base") + risen).cast("long").alias("copies"))
        done = ended if done is None else done.unionByName(ended)
        if not top:
            level = met.where(F.col("held") & ~near).withColumn("leaf", F.floor(F.col("leaf") / FAN).cast("long")).drop("held")
    return done


def mix(documents: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 0) -> DataFrame:
    """documents(doc_id, text, source) -> doc_id, source, size, source_size, target, copies, taken.

    One row for each input row. copies is a whole number from 0 to cap, taken = copies * size.
    A null text, or one without words, has size 0 and copies 0; null sources are one source; a
    null doc_id is an id like another. Repeated rows are units of their own. No rows, no rows.
    The same rows give the same copies, whatever their order and partitions; other columns of
    the input have no part.
    """
    sizes = kept(documents.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    targets = kept(source_targets(sizes, weights, share, cap))
    rows = sizes.count()
    rate = targets.select(F.col("source").alias("of"), (F.col("target") / F.greatest("source_size", F.lit(1))).alias("rate"))
    joined = sizes.join(rate, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    base = F.floor(F.col("rate") + EPS)
    joined = joined.withColumn("base", F.when(F.col("size") > 0, base).otherwise(0).cast("double")).withColumn("p", F.when(F.col("size") > 0, F.greatest(F.col("rate") - F.col("base"), F.lit(0.0))).otherwise(0.0)).drop("rate")
    whole = F.col("p") < EPS
    out = joined.where(whole).select("source", "doc_id", "size", F.col("base").cast("long").alias("copies")).unionByName(pivotal(joined.where(~whole), rows, seed))
    out = out.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    return out.withColumn("taken", F.col("copies") * F.col("size")).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")
