"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ``[^\x20\x09-\x0D]+`` over UTF-8 bytes is what ``bytes.split()`` gives.
SPACE_WORDS = r"[^\x20\x09-\x0D]+"
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see, from ``spark.checkpoint.dir``.

    Only in local mode, where all share one disk, a temporary folder stands in for an absent setting.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: computed once, survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of this job's own, wherever it is stored."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def bytes_of(df: DataFrame) -> int:
    """About how many bytes the rows of ``df`` (numbers and strings) take as a join table."""
    strings = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema if f.dataType.typeName() == "string"]
    row = sum(strings, F.lit(32 + 16 * len(df.columns)))
    return df.agg(F.sum(row.cast("long"))).first()[0] or 0


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, marked for broadcast only if its rows take ``most`` bytes or less. Pass a table that is cheap to read."""
    return F.broadcast(df) if bytes_of(df) <= most else df


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def unclashed(docs: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """``docs`` with its columns named c0, c1, ..., which no operator adds, and the new names of ``names``.

    ``toDF(*docs.columns)`` gives the names back: columns of any name thus pass through an operator.
    """
    new = {c.lower(): f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*new.values()), [new[n.lower()] for n in names]


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text is a multiple of 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def sliced(batches: Iterator[pa.RecordBatch], text: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of each piece take ``max_bytes``, or are one single row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0)).astype(np.int64)
        ends, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def text_bytes(batch: pa.RecordBatch, text: str) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    column = batch.column(text)
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0] .. starts[0]+counts[0]-1, starts[1] .. and so on, in one array."""
    counts = counts.astype(np.int64)
    total = int(counts.sum())
    if not total:
        return np.empty(0, np.int64)
    shift = np.repeat(starts.astype(np.int64) - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    return np.arange(total, dtype=np.int64) + shift


def global_row_number(df: DataFrame, order: list[str], name: str, parts: int) -> DataFrame:
    """Number all rows from 0 in the order of ``order``, in tasks of bounded size.

    Rows are range-partitioned and sorted; each task numbers its own rows and the counts of the tasks before
    it are added. Only one count a partition reaches the driver. ``order`` should end in columns that tell rows
    apart: rows equal in all of them may share a task, whatever their number.
    """
    spark = df.sparkSession
    mid = f"__{name}_mid"
    ranked = cut_lineage(
        df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(mid, F.monotonically_increasing_id())
    )
    pid = F.shiftright(F.col(mid), 33)
    counts = sorted((r[0], r[1]) for r in ranked.groupBy(pid.alias("pid")).count().collect())
    base, rows = 0, []
    for p, n in counts:
        rows.append((int(p), base))
        base += n
    lookup = F.broadcast(spark.createDataFrame(rows or [(-1, 0)], "__pid long, __base long"))  # a row a partition
    return (
        ranked.join(lookup, pid == F.col("__pid"), "left")
        .withColumn(name, F.col("__base") + F.col(mid).bitwiseAND(F.lit((1 << 33) - 1)))
        .drop(mid, "__pid", "__base")
    )


def parts_for(spark: SparkSession, rows: int, rows_per_part: int) -> int:
    """Partitions that hold ``rows_per_part`` rows each, and as many as the session shuffles to at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_per_part))
