"""Operator 2: a quality classifier by positive-unlabelled learning.

The model is a linear scorer over binned text statistics. Training minimises the non-negative unbiased risk of
positive-unlabelled learning, ``prior * E_p[l(f)] + max(0, E_u[l(-f)] - prior * E_p[l(-f)])`` with the logistic
loss: trusted positives are labelled rows of quality 1, the unlabelled rows are a sample of the documents, and the
class prior is estimated from the labelled rows (their share of 1; where no row is labelled 0, the share of
unlabelled rows that a positive-against-unlabelled fit can't tell from positives, after Elkan and Noto).

Training reads at most about ``max_positive`` labelled ids, one text each, and ``max_unlabelled`` unlabelled texts,
chosen by a hash of id and text, so the driver's part does not grow with the input, whatever repeats. Texts of the held-out
fold are never read in training. The labels should be a fair sample of the documents: the prior is their share of 1.
Scoring is one pass over all documents.

Nulls: a null text scores like an empty one; rows with a null label or id teach nothing. Ids may repeat (each row is
scored by itself; where labels of one id disagree, the lowest counts; of several texts of a labelled id one is read). Equal
rows score alike. Very long texts are read whole, one at a time. Columns of other names are kept or not read. Without any
positive every score is the prior 0.5. Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.llm.common import held_out, sliced, text_bytes

MAX_POSITIVE = 4_000
MAX_UNLABELLED = 12_000
THRESHOLD = 0.3
BATCH_BYTES = 8 << 20
BINS = 12

_CLASSES = ["upper", "lower", "digit", "high", "space", "newline", "stop", "comma", "bang", "pipe", "symbol", "other"]


def _class_matrix() -> np.ndarray:
    out = np.zeros((256, len(_CLASSES)))
    for b in range(256):
        c = chr(b)
        k = (
            "high" if b >= 128 else "upper" if c.isupper() else "lower" if c.islower() else "digit" if c.isdigit()
            else "newline" if c == "\n" else "space" if c.isspace() else "stop" if c in ".?;:" else "comma" if c == ","
            else "bang" if c == "!" else "pipe" if c == "|" else "symbol" if c in "#$%&*<>{}[]\\^~=_+@/" else "other"
        )
        out[b, _CLASSES.index(k)] = 1
    return out


_MATRIX = _class_matrix()
N_STATS = len(_CLASSES) + 8


def statistics(texts: list[bytes]) -> np.ndarray:
    """A row of text statistics for each text; every text is read whole."""
    out = np.zeros((len(texts), N_STATS))
    for i, t in enumerate(texts):
        words = t.split()
        n, n_bytes = len(words), max(1, len(t))
        shares = np.bincount(np.frombuffer(t, np.uint8), minlength=256) @ _MATRIX / n_bytes
        types = len(set(words))
        pairs = len(set(zip(words, words[1:], strict=False)))
        lines = [x for x in t.split(b"\n") if x]
        same = sum(map(bytes.__eq__, words, words[1:]))
        out[i, : len(_CLASSES)] = np.log1p(1000 * shares)
        out[i, len(_CLASSES) :] = (
            np.log1p(n), np.log1p(n) - np.log1p(types), np.log1p(max(0, n - 1)) - np.log1p(pairs), same / max(1, n),
            1 - len(set(lines)) / max(1, len(lines)), n_bytes / max(1, n), np.log1p(len(lines)), float(n < 10),
        )
    return out


class Model:
    """Weights over one-hot bins of the statistics and over the statistics themselves."""

    def __init__(self, edges: list[np.ndarray], mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, prior: float):
        self.edges, self.mean, self.scale, self.weights, self.prior = edges, mean, scale, weights, prior

    def design(self, stats: np.ndarray) -> np.ndarray:
        bins = [(np.searchsorted(e, s, "right")[:, None] == np.arange(len(e) + 1)) for e, s in zip(self.edges, stats.T, strict=True)]
        return np.hstack([*bins, np.clip((stats - self.mean) / self.scale, -4, 4), np.ones((len(stats), 1))]).astype(np.float32)

    def score(self, stats: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.design(stats) @ self.weights, -30, 30).astype(np.float64)))


def risk_parts(z_p: np.ndarray, z_u: np.ndarray, prior: float) -> tuple[float, float]:
    """The positive part of the risk and the part that must not be negative, for the logistic loss."""
    loss = lambda z: np.logaddexp(0, -z).mean()
    return prior * loss(z_p), loss(-z_u) - prior * loss(-z_p)


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 1500, rate: float = 0.05, decay: float = 1e-4) -> Model:
    """Minimise the non-negative risk by Adam; where its second part is negative, a step raises it instead."""
    both = np.vstack([positive, unlabelled])
    qs = np.linspace(0, 1, BINS + 1)[1:-1]
    # Most statistics are at their least value in most texts, so the other values share the bins.
    edges = [np.unique([c.min() + 1e-9, *np.quantile(c[c > c.min()], qs)]) if c.max() > c.min() else np.array([c.min() + 1e-9]) for c in both.T]
    model = Model(edges, both.mean(0), both.std(0) + 1e-9, np.zeros(0), prior)
    x_p, x_u = model.design(positive), model.design(unlabelled)
    w, m, v = np.zeros(x_p.shape[1], np.float32), 0.0, 0.0
    for t in range(1, steps + 1):
        z_p, z_u = x_p @ w, x_u @ w
        s_p, s_u = 1 / (1 + np.exp(-z_p)), 1 / (1 + np.exp(-z_u))
        negative = x_u.T @ s_u / len(x_u) - prior * (x_p.T @ s_p) / len(x_p)
        if risk_parts(z_p, z_u, prior)[1] >= 0:
            grad = -prior * (x_p.T @ (1 - s_p)) / len(x_p) + negative
        else:
            grad = -negative
        grad = grad + decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = (w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    model.weights = w
    return model


def estimate_prior(labelled: tuple[int, int], positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of label 1 among all documents."""
    n1, n0 = labelled
    if n0:
        return min(0.98, max(0.05, n1 / (n1 + n0)))
    probe = fit(positive, unlabelled, 0.5, steps=200)
    top = np.quantile(probe.score(positive), 0.5)
    return float(min(0.98, max(0.05, 2 * (probe.score(unlabelled) >= top).mean())))


def _unit_hash(c, seed: int):
    return F.shiftrightunsigned(F.xxhash64(c, F.lit(seed)), 11) / F.lit(float(1 << 53))


def train(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
          max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Model | None:
    """Fit on bounded samples; rows of the held-out fold never count. None where there is no positive."""
    open_labels = labels.filter(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(doc_id)))
    n1, n0 = open_labels.agg(F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)).first()
    if not n1:
        return None
    chosen = (
        open_labels.filter((F.col(label) == 1) & (_unit_hash(F.col(doc_id), 1) < max_positive / n1))
        .select(F.col(doc_id).alias("__id")).distinct().join(
            open_labels.filter(F.col(label) == 0).select(F.col(doc_id).alias("__id")), "__id", "left_anti")
        .limit(2 * max_positive)
    )
    n = docs.count()
    base = docs.select(F.col(doc_id).alias("__id"), F.col(text).cast("string").alias("text"))
    base = base.filter(F.col("__id").isNotNull() & ~held_out(F.col("__id")))
    drawn = base.filter(_unit_hash(F.struct("__id", "text"), 2) < max_unlabelled / max(1, n)).distinct()
    trusted = base.join(F.broadcast(chosen), "__id").groupBy("__id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # at most 2 * max_positive ids
    picked = drawn.select("text", F.lit(False).alias("positive"), F.lit(True).alias("unlabelled")).unionAll(
        trusted.select("text", F.lit(True), F.lit(False)))
    rows = picked.mapInArrow(_stat_rows, "positive boolean, unlabelled boolean, stats array<double>").toArrow()
    stats = np.array(rows["stats"].combine_chunks().values, np.float64).reshape(-1, N_STATS)
    positive, unlabelled = stats[np.array(rows["positive"], bool)], stats[np.array(rows["unlabelled"], bool)]
    if not len(positive) or not len(unlabelled):
        return None
    # Sums of floats depend on the order of rows, and that on the order in which tasks end.
    positive, unlabelled = (a[np.lexsort(a.T)] for a in (positive, unlabelled))
    return fit(positive, unlabelled, estimate_prior((n1, n0), positive, unlabelled))


def _stat_rows(batches):
    for batch in sliced(batches, "text", BATCH_BYTES):
        stats = statistics(text_bytes(batch, "text"))
        flat = pa.ListArray.from_arrays(np.arange(0, stats.size + 1, N_STATS, dtype=np.int32), pa.array(stats.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("positive"), batch.column("unlabelled"), flat], ["positive", "unlabelled", "stats"])


def _scores(model: Model | None, texts: list[bytes]) -> np.ndarray:
    return np.full(len(texts), 0.5) if model is None else model.score(statistics(texts))


def score(docs: DataFrame, model: Model | None, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    def run(batches):
        for batch in sliced(batches, "text", BATCH_BYTES):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_scores(shared.value, text_bytes(batch, "text")))], ["doc_id", "score"])

    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return base.mapInArrow(run, T.StructType([base.schema["doc_id"], T.StructField("score", T.DoubleType())]))


def keep_good(docs: DataFrame, model: Model | None, *, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in sliced(batches, text, BATCH_BYTES):
            yield batch.filter(pa.array(_scores(shared.value, text_bytes(batch, text)) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op2_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, model)
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
