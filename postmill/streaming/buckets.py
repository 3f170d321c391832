"""Keyed tables in hash buckets: a batch rewrites only the buckets that its keys fall into.

``data/version=V/bucket=B`` holds bucket B as version V left it; ``manifest/version=V`` says for each bucket which version's files
are current. A manifest is written last and is there only when whole (_SUCCESS), so a version is seen in full or not at all, a
reader of an older version goes on undisturbed, and a batch that runs again starts from the version before and gives the
same rows. Versions beyond the ``keep`` newest go, with the files that no newer manifest points to.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 256
KEEP = 5


class BucketedTable:
    """A table of ``schema`` with a column ``key``. The number of buckets is fixed by the first version."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, buckets: int = BUCKETS, keep: int = KEEP):
        self.spark, self.folder, self.schema, self.buckets, self.keep = spark, folder, schema, buckets, keep

    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *parts)))

    def _fs(self):
        return self._path("manifest").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Numbers of the whole versions, in order."""
        fs, top = self._fs(), self._path("manifest")
        names = [s.getPath().getName() for s in fs.listStatus(top)] if fs.exists(top) else []
        return sorted(int(n.split("=")[1]) for n in names if n.startswith("version=") and fs.exists(self._path("manifest", n, "_SUCCESS")))

    def _manifest(self, version: int) -> dict[int, int]:
        rows = self.spark.read.schema("bucket int, at int, buckets int").parquet(f"{self.folder}/manifest/version={version}").collect()  # a row a bucket
        if rows:
            self.buckets = rows[0].buckets
        return {r.bucket: r.at for r in rows}

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int")

    def read(self, version: int | None = None, only: set[int] | None = None) -> DataFrame:
        """Rows of a version, the last unless ``version`` names one, of the buckets ``only``; none where there is no version."""
        have = self.versions()
        if version is not None and version not in have:
            raise ValueError(f"no version {version} in {self.folder}")
        at = self._manifest(have[-1] if version is None else version) if have else {}
        paths = [f"{self.folder}/data/version={v}/bucket={b}" for b, v in sorted(at.items()) if only is None or b in only]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def merge(self, batch: DataFrame, version: int, merged: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        """Write version ``version``: ``merged(old, batch)`` of the buckets that the batch's keys fall into, the others as they are.

        ``merged`` gets the old rows of those buckets and must not change the keys of others. Returns the buckets rewritten.
        """
        before = [v for v in self.versions() if v < version]
        at = self._manifest(before[-1]) if before else {}
        touched = {r[0] for r in batch.select(self.bucket()).distinct().collect()}  # at most a row a bucket
        if touched:
            old = self.read(before[-1], touched) if before else self.spark.createDataFrame([], self.schema)
            names = self.spark.createDataFrame([], self.schema).columns
            rows = merged(old, batch).select(*names, self.bucket().alias("bucket"))
            rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/data/version={version}")
            fs = self._fs()
            at = {b: v for b, v in at.items() if b not in touched} | {b: version for b in touched if fs.exists(self._path("data", f"version={version}", f"bucket={b}"))}
        rows = self.spark.createDataFrame([(b, v, self.buckets) for b, v in at.items()], "bucket int, at int, buckets int")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/version={version}")
        self.prune()
        return len(touched)

    def prune(self) -> None:
        """Remove the versions before the ``keep`` newest: manifests first, then the files that no manifest left points to."""
        have = self.versions()
        old, kept = have[: -self.keep], have[-self.keep :]
        if not old:
            return
        current = {(v, b) for k in kept for b, v in self._manifest(k).items()}
        fs = self._fs()
        for k in old:
            fs.delete(self._path("manifest", f"version={k}"), True)
        for folder in [s.getPath() for s in fs.listStatus(self._path("data"))]:
            v = int(folder.getName().split("=")[1])
            if v >= kept[0]:
                continue
            for s in list(fs.listStatus(folder)):
                name = s.getPath().getName()
                if name.startswith("bucket=") and (v, int(name.split("=")[1])) not in current:
                    fs.delete(s.getPath(), True)
            if not any(v == x for x, _ in current):
                fs.delete(folder, True)
