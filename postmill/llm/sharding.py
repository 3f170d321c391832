"""Operator 5: sharding by proportional stratified interleaving.

Rows are shuffled within their source by a seeded hash, ranked, and sorted by fractional rank (rank + 1/2) / rows of
the source; the sorted rows are cut into shards of equal counts, so each shard has every source's share of rows.
Law: ``rows`` (counts at most one apart).

Both orders are total orders over range partitions with the counts of earlier partitions added
(``global_row_number``), so a source that holds most of the rows is ranked by many tasks. Nothing but one count a
partition and the number of rows reaches the driver.

Nulls: a null source is a source, a null text has size 1; null ids sort first. Repeated rows take places of their
own, however many. A very long text is only measured and carried along. Input columns named shard or slot are replaced, those
of any other name are kept. Empty tables give empty results.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.common import broadcast_if_small, cut_lineage, global_row_number, parts_for, shared_dir, unclashed

SHARDS = 16
SEED = 20
ROWS_PER_PART = 200_000


def interleave(rows: DataFrame, shards: int = SHARDS, *, source: str = "source", doc_id: str = "doc_id", seed: int = SEED,
               ties: tuple[str, ...] = (), row: tuple[str, ...] = ()) -> DataFrame:
    """Adds shard (0 to ``shards`` - 1) and slot (gapless from 0 in each shard) to rows.

    ``ties`` names columns that tell rows of one id apart, ``row`` those that tell equal rows apart (they order rows
    but don't count in the seeded hash). Pass narrow rows: all columns travel through two sorts.
    """
    spark = rows.sparkSession
    rows = rows.drop("shard", "slot")
    columns = rows.columns
    sized = cut_lineage(rows.withColumn("__h", F.xxhash64(F.col(doc_id), *ties, F.lit(seed))))
    n = sized.count()
    parts = parts_for(spark, n, ROWS_PER_PART)
    first = global_row_number(sized, [source, "__h", doc_id, *ties, *row], "__g", parts)
    per_source = first.groupBy(F.col(source).alias("__s")).agg(F.min("__g").alias("__first"), F.count(F.lit(1)).alias("__n"))
    per_source = cut_lineage(per_source)
    ranked = first.join(broadcast_if_small(per_source), F.col(source).eqNullSafe(F.col("__s"))).withColumn(
        "__fraction", (F.col("__g") - F.col("__first") + F.lit(0.5)) / F.col("__n")
    )
    ranked = ranked.select(*columns, "__fraction", "__h")
    placed = global_row_number(ranked, ["__fraction", "__h", source, doc_id, *ties, *row], "__place", parts)
    shard = F.expr(f"__place * {shards} div {max(1, n)}")
    start = F.expr(f"(shard * {n} + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("__place") - start).select(*columns, "shard", "slot")


def manifest(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with size and text_crc32 in place of the text."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.withColumns({"size": F.octet_length(body).cast("long") + 1, "text_crc32": F.crc32(body.cast("binary"))}).drop(text)


def deal(docs: DataFrame, shards: int = SHARDS, *, source: str = "source", doc_id: str = "doc_id", text: str = "text",
         seed: int = SEED) -> DataFrame:
    """``docs`` with all columns, texts included, and the shard and slot of each row.

    Every row gets a key of its own and is written once to the shared folder, so that the keys are the same whenever
    they are read. Only the key, source, id, size and crc32 go through the sorts; shard and slot are joined back by key.
    """
    spark, docs = docs.sparkSession, docs.drop("shard", "slot")
    path = f"{shared_dir(spark)}/keyed-{uuid.uuid4().hex}"
    rows, (source, doc_id, text) = unclashed(docs, source, doc_id, text)
    rows.withColumn("__row", F.monotonically_increasing_id()).write.parquet(path)
    keyed = spark.read.parquet(path)
    narrow = manifest(keyed.select("__row", F.col(source).alias("source"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    placed = interleave(narrow.select("__row", "source", "doc_id", "size", "text_crc32"), shards, seed=seed, ties=("text_crc32", "size"), row=("__row",))
    return keyed.join(placed.select("__row", "shard", "slot"), "__row").drop("__row").toDF(*docs.columns, "shard", "slot")


def op5_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    placed = manifest(deal(docs))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
