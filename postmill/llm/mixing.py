"""Operator 9: mixing sources to target weights.

Words are summed by source (combined before the shuffle), targets are water-filled over the sources, and each
document is taken floor(rate) times plus once more if a hash of its id, as a number in [0, 1), is below the rest of
the rate. The hash is seeded and depends on the id and the text, so reruns agree and rows need no order; of rows equal in
both and in their source each draws by itself, with its number among them.

Targets: sources in the order of their code points, null last, weigh ``WEIGHTS`` in turn and share ``SHARE`` of all
words. A target above ``MAX_REPEAT`` times its source's words stops there and the excess is shared again by weight.
All targets are then min(limit, level * weight) for one level: with the sources sorted by limit / weight, those before
some place stand at their limit. Two running sums over the sources find the place. A window over the table of sources
takes one task, so sources should be some million at most (a column of names, not of URLs); it is broadcast only if its bytes
allow.

Nulls: a null text has no words and counts as empty; a null id as an empty one, a null source is a source. Repeated ids and
equal rows each draw by themselves. Very long texts are words like others. Columns of any other name are kept as they are.
Empty tables give empty results; with no words at all, every target is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postmill.llm.common import SPACE_WORDS, broadcast_if_small, cut_lineage, global_row_number, parts_for, unclashed

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_REPEAT = 2
SEED = "mix-1"
ROWS_PER_PART = 200_000


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(SPACE_WORDS)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MAX_REPEAT) -> DataFrame:
    """source, source_size and target from rows of (source, size)."""
    table = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    table = table.withColumn("weight", weight.cast("long")).withColumn("cap", most * F.col("source_size"))
    order = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    table = table.withColumns({
        "capped": F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "open": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        "total": F.sum("source_size").over(everything) * F.lit(share),
    })
    # The level if this source and all after it were below their limits; the first source for which that holds sets it.
    table = table.withColumn("level", (F.col("total") - F.col("capped")) / F.col("open"))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    level = F.first(fits, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    table = table.withColumn("target", F.least(F.col("cap").cast("double"), level * F.col("weight")))
    return table.select("source", "source_size", F.coalesce("target", F.col("cap").cast("double")).alias("target"))


def text_digest(text: Column) -> Column:
    return F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


def unit_hash(doc_id: Column, digest: Column, ordinal: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the first 52 bits of md5 of seed, id, text digest and the row's number among equal ones."""
    key = F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), digest, ordinal.cast("string"))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def with_ordinal(rows: DataFrame, doc_id: str = "doc_id", digest: Column | None = None, source: str = "source") -> DataFrame:
    """Adds __digest and __ordinal, the number of the row among those equal in id, text and source.

    Rows whose id stands once, most as a rule, are number 0. The others are written once with a key of their own, ranked
    in narrow form over range partitions, and joined back by the key, so that an id of very many rows needs no single task.
    """
    spark = rows.sparkSession
    digest = F.col("__digest") if digest is None else digest
    again = cut_lineage(rows.groupBy(F.col(doc_id).alias("__id")).count().filter(F.col("count") > 1).select("__id"))
    if again.isEmpty():
        return rows.withColumns({"__digest": digest, "__ordinal": F.lit(0).cast("long")})
    again, same = broadcast_if_small(again), F.col(doc_id).eqNullSafe(F.col("__id"))
    once = rows.join(again, same, "left_anti").withColumns({"__digest": digest, "__ordinal": F.lit(0).cast("long")})
    keyed = cut_lineage(rows.join(again, same, "left_semi").withColumns({"__digest": digest, "__row": F.monotonically_increasing_id()}))
    narrow = keyed.select("__row", F.col(doc_id).alias("__id"), "__digest", F.col(source).alias("__source"))
    placed = global_row_number(narrow, ["__id", "__digest", "__source", "__row"], "__g", parts_for(spark, keyed.count(), ROWS_PER_PART))
    first = placed.groupBy(F.col("__id").alias("__i"), F.col("__digest").alias("__d"), F.col("__source").alias("__s")).agg(F.min("__g").alias("__first"))
    first = broadcast_if_small(cut_lineage(first))
    placed = placed.join(first, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__digest") == F.col("__d")) & F.col("__source").eqNullSafe(F.col("__s")))
    number = placed.select("__row", (F.col("__g") - F.col("__first")).alias("__ordinal"))
    return once.unionByName(keyed.join(number, "__row").drop("__row"))


def with_copies(rows: DataFrame, table: DataFrame, source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """Adds __source_size, __target and __copies to rows with __digest and __ordinal; ``table`` is that of ``targets``."""
    table = cut_lineage(table.select(F.col("source").alias("__source"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target")))
    out = rows.join(broadcast_if_small(table), F.col(source).eqNullSafe(F.col("__source")), "left").drop("__source")
    rate = F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    return out.withColumn("__copies", whole + (unit_hash(F.col(doc_id), F.col("__digest"), F.col("__ordinal")) < rate - whole).cast("long"))


def mix(docs: DataFrame, *, text: str = "text", source: str = "source", doc_id: str = "doc_id", **how) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it (perhaps never); same columns."""
    rows, (text, source, doc_id) = unclashed(docs, text, source, doc_id)
    sizes = rows.select(F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    out = with_copies(with_ordinal(rows, doc_id, text_digest(F.col(text)), source), targets(sizes, **how), source, doc_id)
    return out.withColumn("__k", F.explode(F.expr("array_repeat(0, cast(__copies as int))"))).select(*rows.columns).toDF(*docs.columns)


def op9_mix_to_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = cut_lineage(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), text_digest(F.col("text")).alias("__digest")))
    out = with_copies(with_ordinal(sized), targets(sized))
    return out.select(
        "doc_id", "size", F.col("__source_size").alias("source_size"), F.col("__target").alias("target"),
        (F.col("size") * F.col("__copies")).alias("taken"),
    )


ORACLE = {
    "op9_mix_to_weights": r"""
WITH d AS (SELECT doc_id, source, md5(coalesce(text, '')) AS digest, row_number() OVER (PARTITION BY doc_id, text, source) - 1 AS ordinal, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT source, source_size, 2 * source_size AS cap, CASE place % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM s),
o AS (SELECT *, coalesce(sum(cap) OVER b, 0) AS capped, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS open, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 AS total
      FROM w WINDOW b AS (ORDER BY cap / CAST(weight AS DOUBLE), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (total - CAST(capped AS DOUBLE)) / CAST(open AS DOUBLE) AS level FROM o),
lv AS (SELECT arg_min(level, cap / CAST(weight AS DOUBLE)) AS level FROM l WHERE level * weight <= cap),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), lv.level * w.weight) AS target FROM w, lv),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / CAST(t.source_size AS DOUBLE) ELSE 0 END AS rate,
      CAST(CAST(('0x' || substr(md5('mix-1:' || coalesce(CAST(d.doc_id AS VARCHAR), '') || ':' || d.digest || ':' || CAST(d.ordinal AS VARCHAR)), 1, 13)) AS UBIGINT) AS DOUBLE) / 4503599627370496.0 AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
""",
}
