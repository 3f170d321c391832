"""One cycle from fetched postings to stored matches, with its counters observed while the rows go by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from postmill.functions import text as T
from postmill.operators import filters as O
from postmill.operators import registry as R
from postmill.operators import scoring as S
from postmill.sources.sinks import write_batch

COUNTERS = ("ingested", "parsed", "qa_passed", "blocked", "new_jobs", "matches", "fit_gaps")


class Counters:
    """Counts taken by ``observe`` at points of a plan; they are there once an action has run it, without another scan."""

    def __init__(self):
        self.taken: list[Observation] = []

    def take(self, df: DataFrame, **counts: Column) -> DataFrame:
        """``df`` as it is; each of ``counts`` is a condition whose rows are counted."""
        self.taken.append(Observation())
        return df.observe(self.taken[-1], *[F.count_if(c).alias(name) for name, c in counts.items()])

    def read(self) -> dict[str, int]:
        return {name: int(n) for one in self.taken for name, n in one.get.items()}


def run_cycle(postings: DataFrame, scores: DataFrame, seen_jobs: DataFrame, folder: str, batch_id: int) -> dict[str, int]:
    """Check, score and store a batch as a partition of ``folder``; returns its counters. One job, one scan of the batch.

    postings need the columns of the quality and risk rules; scores are (job_id, score, gaps), seen_jobs (job_key). Rows
    without a title are not parsed; those that fail the checks or are a high risk go no further. A batch that runs again
    replaces its own rows.
    """
    counters, every = Counters(), F.lit(True)
    rows = counters.take(postings, ingested=every)
    rows = counters.take(rows.filter(F.trim(T.text(F.col("title"))) != ""), parsed=every)
    rows = counters.take(O.with_qa(rows).filter(F.size("issues") == 0), qa_passed=every)
    rows = counters.take(O.with_risk(rows), blocked=F.col("risk") == "high").filter("risk <> 'high'")
    rows = counters.take(R.mark_new(rows, seen_jobs), new_jobs=F.col("is_new"))
    rows = rows.join(scores.select("job_id", "score", "gaps"), "job_id", "left").withColumn("tier", S.tier(F.coalesce("score", F.lit(0.0))))
    match = F.col("tier") == "match"
    rows = counters.take(rows, matches=match, fit_gaps=match & (F.coalesce(F.size("gaps"), F.lit(0)) > 0))
    write_batch(rows, folder, batch_id)
    return counters.read()
