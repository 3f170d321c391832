"""Connected components of a graph of links, by contraction with Spark joins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import cut_lineage, delete_folder, shared_dir

#: Links that a task takes where a round has so many.
TASK_LINKS = 1 << 17


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is one node of the component, the same for all of it.

    Each round sends every node to its smallest neighbour, follows those pointers until they end, and replaces the
    ends of the links by where they lead. A component of n nodes is at least halved in a round, so rounds are
    logarithmic; links shrink alike. Minima are combined before they are shuffled, and a node with very many links
    meets one pointer in a join whose large side may be split. A round runs in as many tasks as its links need: the
    driver keeps a record of every task, and rounds are many.
    """
    spark = links.sparkSession
    links = links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    base, roots, all_tasks = f"{shared_dir(spark)}/components-{uuid.uuid4().hex}", None, 0
    links = _stored(links, base)
    while n := links.count():
        tasks = max(spark.sparkContext.defaultParallelism, -(-n // TASK_LINKS))
        all_tasks = all_tasks or tasks
        links = links.coalesce(tasks)
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("root"))
        to = _ends(_stored(to.coalesce(tasks), base), base, tasks)
        moved = links.join(to.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").coalesce(tasks)
        moved = moved.join(to.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b").filter("ra <> rb").coalesce(tasks)
        links = _stored(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct().coalesce(tasks), base)
        if roots is None:
            roots = to
        else:
            then = to.select(F.col("node").alias("root"), F.col("root").alias("next"))
            roots = _stored(roots.join(then, "root", "left").select("node", F.coalesce("next", "root").alias("root")).coalesce(all_tasks), base)
    roots = cut_lineage(links.select(F.col("a").alias("node"), F.col("b").alias("root")) if roots is None else roots)
    delete_folder(spark, base)
    return roots


def _stored(df: DataFrame, base: str) -> DataFrame:
    """``df`` written to a folder of its own below ``base``, and read again.

    A checkpoint would keep its plan's estimate of bytes, which a join multiplies: a table that is joined to itself again
    and again then has an estimate of twice as many digits each time, until planning takes all memory of the driver.
    """
    path = f"{base}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _ends(to: DataFrame, base: str, tasks: int) -> DataFrame:
    """Follow pointers (node, root) to where they end, in ``tasks`` tasks. They only lead to smaller nodes, so they do."""
    while True:
        then = to.select(F.col("node").alias("root"), F.col("root").alias("next"))
        jumped = to.join(then, "root", "left").select("node", F.coalesce("next", "root").alias("root"), F.coalesce(F.col("next") != F.col("root"), F.lit(False)).alias("moved"))
        jumped = _stored(jumped.coalesce(tasks), base)
        to = jumped.select("node", "root")
        if jumped.filter("moved").isEmpty():
            return to
