"""Operator 6: quality rules by suffix-array repetition.

The words of many documents are numbered and laid one after another, each document ending in a separator, and
sorted into one suffix array with numpy. Longest common prefixes of neighbours give the repeated substrings of each
document; every suffix's longest repeat is the larger of its two, and the union of those spans is the union over the
maximal repeats. The verdict limits the share of words inside repeats of at least ``MIN_REPEAT`` words and the
longest repeat.

Repeats count within one document only, whatever other documents hold. Batches are bounded by bytes, a longer
document is a batch by itself, and no document is cut.

Nulls: a null or empty text has no words and fails the base rule. Ids may repeat or be null; each row, equal ones too, is
judged by itself. A very long and repetitive text keeps no ranks of every length but gets its common prefixes by the
linear walk of Kasai and others. Columns of other names are not read. Empty tables give empty results.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.llm.common import sliced, text_bytes
from postmill.llm.suffix import _tied

BATCH_BYTES = 3 << 20
BASE_WINDOW = 5
MIN_REPEAT = 8
MAX_COVERED = 0.25
MAX_REPEAT = 50
KEPT_RANKS = 128 << 20
_SYMBOLS = b"#*$%&|<>"
_CONTINUATION = bytes(range(0x80, 0xC0))
_SPACES = b" \t\n\x0b\x0c\r"


def document_suffixes(word: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of words grouped by document, and the common prefix of each suffix with the one before it.

    Suffixes are compared within their document only and end with it. Prefixes double in length, each time only
    for suffixes that tie with another; the ranks of every length are kept to add up the common prefixes.
    """
    n = len(word)
    end = np.searchsorted(doc, doc, "right")
    bits = max(1, int(word.max() + 1).bit_length())
    width = min(4, n, max(1, (62 - max(1, int(doc.max()).bit_length())) // bits))
    pos = np.arange(n, dtype=np.int64)
    key = doc.astype(np.int64)
    for k in range(width):
        nxt = np.zeros(n, np.int64)
        nxt[: n - k] = word[k:] + 1
        nxt[pos + k >= end] = 0
        key = (key << bits) | nxt
    sa = np.argsort(key, kind="stable")
    sorted_key = key[sa]
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(sorted_key[1:], sorted_key[:-1], out=new[1:])
    new |= sa + width > end[sa]  # ended: equal only to itself, by position
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, pos, 0))
    depth, open_rows = width, _tied(new)
    steps = [(width, rank.astype(np.int32))] if n < 1 << 31 else None
    while len(open_rows):
        at = sa[open_rows]
        first, second = rank[at], np.where(at + depth < end[at], rank[np.minimum(at + depth, n - 1)] + 1, 0)
        order = np.argsort(first * (n + 1) + second, kind="stable")
        at, first, second = at[order], first[order], second[order]
        sa[open_rows] = at
        fresh = np.empty(len(at), bool)
        fresh[0] = True
        fresh[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1]) | (second[1:] == 0)
        rank[at] = np.maximum.accumulate(np.where(fresh, open_rows, 0))
        open_rows = open_rows[_tied(fresh)]
        depth *= 2
        if steps is not None and 4 * n * (len(steps) + 1) <= KEPT_RANKS:
            steps.append((depth, rank.astype(np.int32)))
        else:
            steps = None
    if steps is None:
        del rank, key, sorted_key, new
        return sa, _walked_prefixes(word, end, doc, sa)
    lcp = np.zeros(n, np.int64)
    rows = np.arange(1, n)
    a, b = sa[:-1].copy(), sa[1:].copy()
    same = doc[a] == doc[b]
    rows, a, b = rows[same], a[same], b[same]
    for size, ranks in reversed(steps):
        live = np.flatnonzero((a < end[sa[rows - 1]]) & (b < end[sa[rows]]))
        hit = live[ranks[a[live]] == ranks[b[live]]]
        lcp[rows[hit]] += size
        a[hit] += size
        b[hit] += size
    for _ in range(width - 1):  # what is left is shorter than the first sort's prefix
        live = np.flatnonzero((a < end[sa[rows - 1]]) & (b < end[sa[rows]]))
        hit = live[word[a[live]] == word[b[live]]]
        rows, a, b = rows[hit], a[hit], b[hit]
        lcp[rows] += 1
        a, b = a + 1, b + 1
    return sa, lcp


def _walked_prefixes(word: np.ndarray, end: np.ndarray, doc: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix with the one before it in ``sa``, by a walk over the text in linear time and memory."""
    n = len(word)
    lcp, at = np.zeros(n, np.int64), np.empty(n, np.int64)
    at[sa] = np.arange(n)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = np.where(doc[sa[1:]] == doc[sa[:-1]], sa[:-1], -1)
    w, b, out, stops = memoryview(np.ascontiguousarray(word)), memoryview(before), memoryview(lcp), memoryview(np.ascontiguousarray(end))
    size = 0
    for i, (j, row) in enumerate(zip(b, memoryview(at), strict=True)):
        if j < 0:
            size = 0
            continue
        most = stops[i] - max(i, j)
        while size < most and w[i + size] == w[j + size]:
            size += 1
        out[row] = size
        size = max(0, size - 1)
    return lcp


def _covered(sa: np.ndarray, lcp: np.ndarray, least: int, bounds: np.ndarray, fixed: bool) -> np.ndarray:
    """Words of each document inside a repeat of ``least`` words or more (``fixed``: of just ``least``)."""
    longest = np.maximum(lcp, np.append(lcp[1:], 0))
    rows = np.flatnonzero(longest >= least)
    delta = np.zeros(len(sa) + 1, np.int64)
    np.add.at(delta, sa[rows], 1)
    np.add.at(delta, sa[rows] + (least if fixed else longest[rows]), -1)
    total = np.concatenate(([0], np.cumsum(np.cumsum(delta[:-1]) > 0)))
    return total[bounds[1:]] - total[bounds[:-1]]


def measure(texts: list[bytes], min_repeat: int = MIN_REPEAT) -> dict[str, np.ndarray]:
    """The base figures of each text, and the words covered by its repeats and its longest repeat."""
    n = len(texts)
    out = {k: np.zeros(n, np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered", "longest")}
    vocab: dict[bytes, int] = {}
    number = count().__next__
    numbers = []
    for i, t in enumerate(texts):
        words = t.split()
        out["n_words"][i] = len(words)
        out["word_chars"][i] = len(t.translate(None, _CONTINUATION + _SPACES))
        out["n_symbols"][i] = len(t) - len(t.translate(None, _SYMBOLS))
        lines = [x for x in t.split(b"\n") if x.strip()]
        out["n_dup_lines"][i] = len(lines) - len(set(lines))
        numbers.append(np.fromiter((vocab[w] if w in vocab else vocab.setdefault(w, number()) for w in words), np.int64, len(words)))
        del words
    bounds = np.concatenate(([0], np.cumsum(out["n_words"])))
    if not bounds[-1]:
        return out
    word = np.concatenate(numbers)
    doc = np.repeat(np.arange(n), out["n_words"])
    sa, lcp = document_suffixes(word, doc)
    out["n_repeat_words"] = _covered(sa, lcp, BASE_WINDOW, bounds, True)
    out["covered"] = _covered(sa, lcp, min_repeat, bounds, False)
    np.maximum.at(out["longest"], doc[sa], lcp)
    return out


FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered", "longest"]


def repetition(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_repeat: int = MIN_REPEAT,
               batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Per row of ``docs``: doc_id, the base figures, ``covered`` (words in repeats) and ``longest`` (in words)."""

    def run(batches):
        for batch in sliced(batches, "text", batch_bytes):
            found = measure(text_bytes(batch, "text"), min_repeat)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(found[k]) for k in FIGURES)], ["doc_id", *FIGURES])

    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return base.mapInArrow(run, T.StructType([base.schema["doc_id"], *(T.StructField(k, T.LongType()) for k in FIGURES)]))


def verdict(found: DataFrame, max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Adds base_failed and kept."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    within = (F.col("covered") <= max_covered * F.col("n_words")) & (F.col("longest") <= max_repeat)
    return found.withColumns({"base_failed": failed, "kept": ~failed & within})


def op6_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = verdict(repetition(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return found.select("doc_id", *FIGURES[:5], "base_failed", "kept", F.col("covered").alias("n_covered_words"))


ORACLE = {
    "op6_repetition_rules": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS phrase
        FROM (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM d, (VALUES (5), (8), (51)) s(size) WHERE len(w) >= size)),
rep AS (SELECT doc_id, size, phrase FROM win GROUP BY ALL HAVING count(*) > 1),
cov AS (SELECT doc_id, size, count(DISTINCT k) AS n FROM (SELECT win.doc_id, win.size, unnest(generate_series(win.i, win.i + win.size - 1)) AS k
        FROM win JOIN rep ON win.doc_id = rep.doc_id AND win.size = rep.size AND win.phrase = rep.phrase) GROUP BY ALL),
per AS (SELECT doc_id, max(CASE WHEN size = 5 THEN n ELSE 0 END) AS c5, max(CASE WHEN size = 8 THEN n ELSE 0 END) AS c8, max(CASE WHEN size = 51 THEN n ELSE 0 END) AS c51 FROM cov GROUP BY doc_id),
ln AS (SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM ln GROUP BY doc_id),
f AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(c5, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(c8, 0) AS BIGINT) AS n_covered_words, coalesce(c51, 0) AS c51
  FROM d LEFT JOIN per ON d.doc_id = per.doc_id LEFT JOIN dup ON d.doc_id = dup.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_covered_words <= 0.25 * n_words AND c51 = 0 AS kept, n_covered_words
FROM f
""",
}
