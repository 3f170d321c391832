"""Operator 1: benchmark decontamination with an FM-index for each training shard.

A shard is a run of documents of bounded size inside one task, so the job has no shuffle. Words that no benchmark
text has become separators (no phrase can span them), and runs shorter than the shortest phrase are left out: that
keeps the alphabet and the index small and loses no occurrence. The phrases are searched backward through the
wavelet ranks of the shard's index, their occurrences are located by sampled suffix positions, and overlapping
occurrences merge into removal spans.

The benchmark is taken in blocks of about ``BLOCK_BYTES``, equal items once; each block is broadcast and adds its spans to
those of the blocks before. A benchmark of any size thus needs bounded memory, and a small one needs one pass. Cutting goes
on until no phrase of any block is left: with several blocks, texts that a pass has cut go through all blocks again.

Nulls: a null document or item text has no words; a null item id is left out of the item list but its text still
hits. Rows are never joined by id, so repeated and null ids and equal rows are kept as they come. A very long text is a
shard by itself. Columns of other names are not read by ``contamination`` and kept by ``decontaminate``; a column of the
name ``n_chars`` is counted anew only if it is one of whole numbers. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.llm.common import cut_lineage, ranges, sliced, text_bytes, unclashed
from postmill.llm.suffix import FMIndex

WINDOW = 10
SHARD_BYTES = 12 << 20
BLOCK_BYTES = 4 << 20
CUT = "__cut"

#: Bytes that end words: all ASCII but digits and letters; A-Z become a-z.
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
_WORD = re.compile(rb"[^ ]+")

SCAN = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("item_ids", T.ArrayType(T.StringType())),
    ]
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class Phrases:
    """The distinct windows of one block of items, as rows of word numbers, with the items of each. All in flat arrays: some
    twenty times the items' text, while they are made up."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        self.vocab: dict[bytes, int] = {}
        self.names = sorted({i for i, _ in items if i is not None})
        number = {name: k for k, name in enumerate(self.names)} | {None: -1}
        rows, owner = [np.empty((0, window), np.int32)], [np.empty(0, np.int32)]
        for item_id, text in items:
            ids = np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of((text or "").encode())], np.int32)
            if len(ids):
                rows.append(np.lib.stride_tricks.sliding_window_view(ids, window) if len(ids) >= window else np.pad(ids, (window - len(ids), 0))[None, :])
                owner.append(np.full(len(rows[-1]), number[item_id], np.int32))
        self.sigma = len(self.vocab) + 1
        self.symbols, phrase = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        self.lengths = (self.symbols > 0).sum(axis=1).astype(np.int64)
        self.shortest = int(self.lengths.min()) if len(self.lengths) else 0
        owner = np.concatenate(owner)
        pairs = np.unique(phrase.reshape(-1)[owner >= 0].astype(np.int64) * (len(self.names) + 1) + owner[owner >= 0])
        self.owners = (pairs % (len(self.names) + 1)).astype(np.int32)
        self.first = np.searchsorted(pairs, np.arange(len(self.lengths) + 1) * (len(self.names) + 1))

    def items(self, phrase: int) -> list[str]:
        return [self.names[k] for k in self.owners[self.first[phrase] : self.first[phrase + 1]]]


def scan_shard(texts: list[bytes], phrases: Phrases) -> tuple[np.ndarray, list[np.ndarray], list[set[str]]]:
    """For each text: its words, merged spans of word numbers (rows of start, end) and the items that occur."""
    counts = np.empty(len(texts), np.int64)
    numbers, get = [], phrases.vocab.get
    for i, text in enumerate(texts):
        words = words_of(text)
        counts[i] = len(words)
        numbers.append(np.fromiter(map(get, words, repeat(0)), np.int32, len(words)))
    no_spans = np.empty((0, 2), np.int64)
    spans, items = [no_spans] * len(texts), [set() for _ in texts]
    total = int(counts.sum())
    if not total or not phrases.shortest:
        return counts, spans, items
    word = np.concatenate(numbers)
    base = np.concatenate(([0], np.cumsum(counts)))
    # Runs of known words within one document.
    known = word > 0
    joined = known[1:] & known[:-1]
    inner = base[1:-1]
    joined[inner[(inner > 0) & (inner < total)] - 1] = False
    start = np.flatnonzero(known & ~np.concatenate(([False], joined)))
    stop = np.flatnonzero(known & ~np.concatenate((joined, [False]))) + 1
    long_enough = stop - start >= phrases.shortest
    start, stop = start[long_enough], stop[long_enough]
    if not len(start):
        return counts, spans, items
    at_word = ranges(start, stop - start)
    at_symbol = np.arange(len(at_word)) + np.repeat(np.arange(len(start)), stop - start)
    symbols = np.zeros(len(at_word) + len(start), np.int64)
    symbols[at_symbol] = word[at_word]
    back = np.full(len(symbols), -1, np.int64)
    back[at_symbol] = at_word
    index = FMIndex(symbols, phrases.sigma)
    lo, hi = index.search(phrases.symbols, phrases.lengths)
    found = np.flatnonzero(hi > lo)
    if not len(found):
        return counts, spans, items
    times = (hi - lo)[found]
    where = back[index.locate(ranges(lo[found], times))]
    phrase = np.repeat(found, times)
    doc = np.searchsorted(base, where, "right") - 1
    delta = np.zeros(total + 1, np.int64)
    np.add.at(delta, where, 1)
    np.add.at(delta, where + phrases.lengths[phrase], -1)
    hit = np.cumsum(delta[:-1]) > 0
    for d in np.unique(doc):
        mine = np.concatenate(([False], hit[base[d] : base[d + 1]], [False]))
        edges = np.flatnonzero(mine[1:] != mine[:-1])
        spans[d] = edges.reshape(-1, 2)
    for pair in np.unique(doc * len(phrases.lengths) + phrase):
        d, p = divmod(int(pair), len(phrases.lengths))
        items[d].update(phrases.items(p))
    return counts, spans, items


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what stands between them; a cut leaves one line break."""
    at = [m.span() for m in _WORD.finditer(text.translate(_TABLE))]
    out, done = [], 0
    for a, b in spans:
        out.append(text[done : at[a][0]])
        done = at[b - 1][1]
    return b"\n".join([*out, text[done:]])


def phrase_blocks(benchmark: DataFrame, item_id: str, text: str, window: int, block_bytes: int) -> Iterator:
    """Broadcasts of the benchmark's phrases, a block at a time."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(text).cast("string").alias("text")).distinct()
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    for k in range(blocks):
        mine = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k)
        yield spark.sparkContext.broadcast(Phrases([tuple(r) for r in mine.collect()], window))


def contamination(
    docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", window: int = WINDOW, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, spans (word numbers, end exclusive) and item_ids that occur.

    Other columns are dropped, so their names can't clash.
    """
    out = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    first, last_schema = True, None
    fields = [out.schema["doc_id"], T.StructField("text", T.StringType()), *SCAN.fields]
    for shared in phrase_blocks(benchmark, item_id, item_text, window, block_bytes):
        last_schema = T.StructType(fields)
        out = out.mapInArrow(_scanner(shared, shard_bytes, first), last_schema)
        first = False
    return out.drop("text")


def _scanner(shared, shard_bytes: int, first: bool):
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches):
        phrases = shared.value
        for batch in sliced(batches, "text", shard_bytes):
            n_words, spans, items = scan_shard(text_bytes(batch, "text"), phrases)
            spans = [[(int(a), int(b)) for a, b in x] for x in spans]
            if not first:
                old = batch.column("spans").to_pylist()
                spans = [merge_spans(x + [(o["start"], o["end"]) for o in old[i]]) for i, x in enumerate(spans)]
                items = [x.union(batch.column("item_ids")[i].as_py()) for i, x in enumerate(items)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("text"), pa.array(n_words, pa.int64()),
                    pa.array([[{"start": a, "end": b} for a, b in x] for x in spans], spans_type),
                    pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                ],
                ["doc_id", "text", "n_words", "spans", "item_ids"],
            )

    return scan


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, *, text: str = "text", n_chars: str = "n_chars", item_id: str = "item_id",
    item_text: str = "text", window: int = WINDOW, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` without the benchmark's passages: spans are cut from the texts until none is left.

    Documents of which nothing but separators stays are dropped; all others keep their columns, with ``n_chars``
    (if there is one) counted anew where the text changed.
    """
    counted = n_chars in docs.columns and isinstance(docs.schema[n_chars].dataType, T.IntegralType)
    names = docs.columns
    docs, (text, *number) = unclashed(docs, text, *([n_chars] if counted else []))
    blocks = list(phrase_blocks(benchmark, item_id, item_text, window, block_bytes))
    cutters = [_cutter(shared, shard_bytes, text, number[0] if number else None) for shared in blocks]
    if len(blocks) == 1:
        return docs.mapInArrow(cutters[0], docs.schema).toDF(*names)
    todo, done = docs.withColumn(CUT, F.lit(False)), None
    while True:
        for cut in cutters:
            todo = todo.mapInArrow(cut, todo.schema)
        todo = cut_lineage(todo)
        clean, again = todo.filter(~F.col(CUT)).drop(CUT), todo.filter(CUT)
        done = clean if done is None else done.unionAll(clean)
        if again.isEmpty():
            return done.toDF(*names)
        todo = again.withColumn(CUT, F.lit(False))


def _cutter(shared, shard_bytes: int, text: str, n_chars: str | None):
    def cut(batches):
        phrases = shared.value
        for batch in sliced(batches, text, shard_bytes):
            texts = text_bytes(batch, text)
            changed: dict[int, bytes] = {}
            todo = list(range(len(texts)))
            while todo:  # a cut can bring the two sides of a new hit together
                _, spans, _ = scan_shard([changed.get(i, texts[i]) for i in todo], phrases)
                dirty = [(i, s) for i, s in zip(todo, spans, strict=True) if len(s)]
                for i, s in dirty:
                    changed[i] = cut_spans(changed.get(i, texts[i]), [(int(a), int(b)) for a, b in s])
                todo = [i for i, _ in dirty]
            if not changed:
                yield batch
                continue
            columns = {name: batch.column(name) for name in batch.schema.names}
            new = batch.column(text).to_pylist()
            for i, t in changed.items():
                new[i] = t.decode()
            columns[text] = pa.array(new, columns[text].type)
            if n_chars in columns:
                counts = columns[n_chars].to_pylist()
                for i in changed:
                    counts[i] = len(new[i])
                columns[n_chars] = pa.array(counts, columns[n_chars].type)
            if CUT in columns:
                columns[CUT] = pa.array([i in changed or was for i, was in enumerate(columns[CUT].to_pylist())])
            keep = pa.array([i not in changed or bool(words_of(changed[i])) for i in range(len(texts))])
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns)).filter(keep)

    return cut


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def brute_force(docs: list[tuple], items: list[tuple], window: int = WINDOW) -> list[tuple]:
    """The contract's rows by comparing every window of every document; for tests."""
    lists = [(str(i), words_of((t or "").encode())) for i, t in items]
    windows: dict[tuple, set[str]] = {}
    for i, ws in lists:
        for k in range(max(1, len(ws) - window + 1) if ws else 0):
            windows.setdefault(tuple(ws[k : k + window]), set()).add(i)
    out = []
    for doc_id, t in docs:
        ws, hit, own = words_of((t or "").encode()), set(), set()
        for size in {len(w) for w in windows}:
            for k in range(len(ws) - size + 1):
                if (w := tuple(ws[k : k + size])) in windows:
                    hit.update(range(k, k + size))
                    own |= windows[w]
        digest = hashlib.sha256(",".join(sorted(own)).encode()).hexdigest()
        out.append((doc_id, len(ws), len(hit), len(own), digest, bool(hit)))
    return out


ORACLE = {
    "op1_decontamination": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS phrase
       FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS phrase
       FROM (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM d, sizes WHERE len(w) >= size)),
hits AS (SELECT dw.doc_id, dw.i, dw.size, bw.item_id FROM dw JOIN bw ON dw.phrase = bw.phrase AND dw.size = bw.size),
n AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + size - 1)) AS k FROM hits) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
""",
}
