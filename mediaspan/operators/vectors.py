"""Vectors, calibration and clustering."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x)


def norm(v) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def unit(v) -> Column:
    """Of length 1; a zero vector stays."""
    n = norm(v)
    return F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x.cast("double")))


def sums(rows: DataFrame, keys, vector: str = "v") -> DataFrame:
    """By key, the sum of the vectors and how many; summed by place, map side first."""
    flat = rows.select(*keys, F.posexplode(vector).alias("place", "x")).groupBy(*keys, "place").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    packed = flat.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", "x"))).alias("a"), F.max("n").alias("n"))
    return packed.select(*keys, F.transform("a", lambda s: s["x"]).alias("v"), "n")


def scores(rows: DataFrame, profiles: DataFrame, keys) -> DataFrame:
    """Inner product of each row's vector with its key's profile (keys, v)."""
    return rows.join(profiles.select(*keys, F.col("v").alias("profile")), list(keys)).withColumn("score", dot("v", "profile"))


def mean_unit(rows: DataFrame, keys, vector: str = "v") -> DataFrame:
    """keys, v, n: the direction of each key's mean vector, of length 1 (0 if they cancel out)."""
    return sums(rows, keys, vector).withColumn("v", unit("v"))


def span_embeddings(windows: DataFrame, keys, least_us: int = 300_000) -> DataFrame:
    """windows(keys, start_us, end_us, v) of spans -> keys, us, n, v: the direction of the mean of the
    windows' directions; null where the span, from its first start to its last end, is too short."""
    rows = windows.withColumn("v", unit("v"))
    length = rows.groupBy(*keys).agg((F.max("end_us") - F.min("start_us")).alias("us"))
    return length.join(mean_unit(rows, keys), list(keys)).select(*keys, "us", "n", F.when(F.col("us") >= least_us, F.col("v")).alias("v"))


def real_dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosines(rows: DataFrame, profiles: DataFrame, keys) -> DataFrame:
    """Each row's cosine with its key's profile (keys, v); null against nothing, 0 for zero vectors."""
    wanted = profiles.select(*keys, unit("v").alias("profile"))
    return rows.join(wanted, list(keys), "left").withColumn("score", real_dot(unit("v"), F.col("profile"))).drop("profile")


def without_own(rows: DataFrame, keys) -> DataFrame:
    """Each row's cosine with the mean direction of its key's other rows; null where there is none."""
    units = rows.withColumn("_u", unit("v"))
    total = sums(units, keys, "_u").select(*keys, F.col("v").alias("_all"), F.col("n").alias("_n"))
    others = F.zip_with("_all", "_u", lambda t, x: t - x)
    return units.join(total, list(keys)).withColumn("score", F.when(F.col("_n") > 1, real_dot("_u", unit(others)))).drop("_u", "_all", "_n")


def distance(a, b) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def nearest_centre(rows: DataFrame, centres: DataFrame, keys, id: str = "idx") -> DataFrame:
    """rows(keys, id, v), centres(keys, centre, v) -> keys, id, centre, distance: the centre of the key at
    the least distance, the least of equals. Rows of keys without centres have none."""
    met = rows.select(*keys, id, "v").join(centres.select(*keys, "centre", F.col("v").alias("_c")), list(keys))
    best = F.min(F.struct(distance("v", "_c").alias("distance"), "centre")).alias("b")
    return met.groupBy(*keys, id).agg(best).select(*keys, id, "b.centre", "b.distance")


def medoids(rows: DataFrame, keys, id: str = "idx") -> DataFrame:
    """Each key's row nearest to the mean of its rows, the least id of those that are equal to nine digits
    (two rows are as far from their mean, but for rounding)."""
    mean = sums(rows, keys).select(*keys, F.transform("v", lambda x: x / F.col("n")).alias("_m"))
    met = rows.select(*keys, id, "v").join(mean, list(keys))
    return met.groupBy(*keys).agg(F.min(F.struct(F.round(distance("v", "_m"), 9).alias("distance"), F.col(id).alias("id"))).alias("b")).select(*keys, F.col("b.id").alias(id), "b.distance")


def calibrate(scored: DataFrame, keys) -> DataFrame:
    """scored(keys, score, positive) -> the threshold of best balanced accuracy: among midpoints of
    adjacent distinct scores (doubled, so that they are whole), the middle of the best."""
    distinct = scored.groupBy(*keys, "score").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("q"))
    order = Window.partitionBy(*keys).orderBy("score")
    upto, all_ = order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys)
    cut = distinct.withColumns({"low_p": F.sum("p").over(upto), "low_q": F.sum("q").over(upto), "all_p": F.sum("p").over(all_), "all_q": F.sum("q").over(all_), "next": F.lead("score").over(order)})
    # Balanced accuracy over a common denominator, as a whole number.
    good = (F.col("all_p") - F.col("low_p")) * F.col("all_q") + F.col("low_q") * F.col("all_p")
    cut = cut.where("next IS NOT NULL AND all_p > 0 AND all_q > 0").select(*keys, (F.col("score") + F.col("next")).alias("twice"), good.alias("good"))
    best = cut.withColumn("top", F.max("good").over(all_)).where("good = top")
    ranked = best.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("twice"))).withColumn("n", F.count("*").over(all_))
    return ranked.where("k = floor(n / 2) + 1").select(*keys, "twice", "good")


def leaders(features: np.ndarray, threshold: float, steps: int = 10) -> np.ndarray:
    """Groups of rows in order: a row far from all leaders leads a new group; then k-means steps."""
    centers: list[np.ndarray] = []
    for x in features:
        if not centers or min(np.linalg.norm(x - c) for c in centers) > threshold:
            centers.append(x)
    c = np.array(centers)
    label = np.zeros(len(features), int)
    for _ in range(steps):
        label = ((features[:, None] - c[None]) ** 2).sum(2).argmin(1)
        for k in range(len(c)):
            if (label == k).any():
                c[k] = features[label == k].mean(0)
    return label


def cluster(rows: DataFrame, threshold: float, key: str = "media_id") -> DataFrame:
    """Leader clustering of each recording's frames in order of idx."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        return pd.DataFrame({key: pdf[key], "idx": pdf["idx"], "cluster": leaders(np.stack(pdf["v"].to_numpy()).astype(float), threshold)})

    return rows.select(key, "idx", "v").groupBy(key).applyInPandas(one, f"{key} long, idx long, cluster long")
