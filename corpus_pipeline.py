"""A corpus pipeline: each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mediaspan.llm import decontaminate, minhash, mixing, tokens, toxicity
from mediaspan.llm.queries import vocabulary
from mediaspan.llm.shared import discard, made, scratch, table


def _hash(*columns: str, seed: int = 0) -> Column:
    """The same for the same values; nulls count, so they don't leave a place to another column."""
    return F.xxhash64(F.lit(seed), *(x for c in columns for x in (F.col(c), F.col(c).isNull())))


def _keyed(docs: DataFrame) -> DataFrame:
    """The rows with a key of 128 bits, in two halves."""
    return docs.withColumns({"row_key": _hash(*docs.columns), "row_key_2": _hash(*docs.columns, seed=1)})


KEY = ["row_key", "row_key_2"]


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a toxicity score of 0.7 or more.

    Scores go by row, not by id, so rows with null or repeated ids are each judged by their own
    text; null and empty texts have the score of no evidence; equal rows have the same score.
    """
    rows = _keyed(docs)
    classifier = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    bad = toxicity.score(rows.select(*KEY, "text"), classifier, KEY).where(F.col("predicted") == 1)
    return rows.join(bad.select(*KEY).distinct(), KEY, "left_anti").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near duplicates (five-word shingles, similarity 0.8) the least doc_id.

    Rows are compared, not ids: rows that share a doc_id stay unless their texts are alike, rows
    with a null doc_id are texts like others (and the last that a group keeps), and of equal rows
    one stays. The comparison knows rows by the first half of their keys; unlike rows that share
    it, should there be any, all stay.
    """
    rows = _keyed(docs)
    found = minhash.near_duplicates(rows.select(F.col("row_key").alias("doc_id"), "text"), size=5, threshold=80)
    groups = found.select(F.col("doc_id").alias("row_key"), "component_id").distinct()
    groups = groups.join(rows.select(*KEY, "doc_id").distinct(), "row_key")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key"))
    kept = groups.groupBy("component_id").agg(least.alias("least")).select("least.row_key")
    shared_half = groups.groupBy("row_key").agg((F.min("row_key_2") < F.max("row_key_2")).alias("shared")).where("shared").select("row_key")
    kept = kept.unionByName(shared_half)
    return rows.join(kept.hint("merge"), "row_key", "left_semi").dropDuplicates(KEY).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item. Rows with a null doc_id, whose texts it can't
    name, stay; of rows that share an id all go if one holds an item; null texts hold none."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that sources come to their weights: a row for each copy.

    Each row, whatever its doc_id, gets the copies of one unit: those of rows with the same
    doc_id, source and size, which are alike to the mixing, are handed out in the rows' order.
    """
    unit = [_hash("doc_id", "source", "size", seed=k).alias(name) for k, name in enumerate(("unit", "unit_2"))]
    copies = mixing.mix(docs).select(*unit, "copies").groupBy("unit", "unit_2").agg(F.array_sort(F.collect_list("copies")).alias("copies"))
    rows = docs.withColumn("size", mixing.word_count(F.col("text"))).select(*docs.columns, *unit, _hash(*docs.columns).alias("row_key"))
    rows = rows.join(copies.where(F.exists("copies", lambda n: n > 0)).hint("merge"), ["unit", "unit_2"])
    place = F.row_number().over(Window.partitionBy("unit", "unit_2").orderBy("row_key"))
    rows = rows.withColumn("place", place).withColumn("copies", F.element_at("copies", F.col("place"))).where(F.col("copies") > 0)
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token ids of all rows and returns what the files hold."""
    path = scratch(spark)
    tokens.write(docs, path, vocabulary())
    return tokens.read(spark, path)


STAGES = [("toxicity", toxic), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixture", mixture), ("token_ids", token_ids)]

#: No stage but decontamination is expressible in SQL; the tests compare each with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents. What a stage kept for itself goes once its rows are written;
    the token files of the last one stay."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before = len(made())
        out, path = stage(spark, docs, sf_dir), scratch(spark)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if k < len(STAGES) - 1:
            discard(spark, [x for x in made()[before:] if x != path])
    return docs
