"""Operator 13: ranked lexical search, short lists term at a time and long lists document at a time.

Documents are indexed where they are read: a shard is a run of documents of one task whose texts take ``SHARD_BYTES``, and
its lists hold only the terms that items ask for, so no posting is shuffled. For each item the lists of at most
``SHORT_SHARE`` of the shard's documents are summed into accumulators (term at a time). The accumulators are then one more
iterator, with their largest sum as its bound, beside the long lists (document at a time): iterators whose bounds together
can't reach the item's tenth score so far name no candidates, and a long list is only probed at documents that it can still
lift to that score. A task carries each item's ten best from shard to shard, so later shards skip more, and returns them at
its end; a window takes the ten best of all tasks.

Corpus counts (documents, words, documents by term) are one aggregation over all documents. Items come in blocks of about
``BLOCK_BYTES`` of text, each broadcast, so a benchmark of any size needs bounded memory and a small one two scans.

Nulls, empty texts and texts without terms: such a document is not counted and never returned, such an item has no rows. A
null doc_id is an id like any other and stands after all others in ties. Rows of documents are never joined by id: repeated
ids and equal rows are documents of their own. Equal item rows count once; items that share an id but not a text rank apart.
A very long text is read in pieces. Other columns are not read. Empty tables give no rows.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.llm.common import sliced, text_bytes
from postmill.llm.decontamination import _TABLE
from postmill.llm.ranking import ranked

TOP = 10
SHARD_BYTES = 32 << 20
PIECE_BYTES = 4 << 20
BLOCK_BYTES = 1 << 20
SHORT_SHARE = 1 / 32
STEP = 4096
N_DOCS, N_WORDS = -1, -2


def pieces(text: bytes) -> Iterator[bytes]:
    """Lower-cased text, cut between words into pieces of about ``PIECE_BYTES``; what is no word is blank."""
    at = 0
    while at < len(text):
        end = at + PIECE_BYTES
        piece = text[at:end].translate(_TABLE)
        if end < len(text) and (cut := piece.rfind(b" ")) > 0:
            end, piece = at + cut, piece[:cut]
        elif end < len(text):  # one word that is longer than a piece
            while end < len(text) and _TABLE[text[end]] != 32:
                end += 1
            piece = text[at:end].translate(_TABLE)
        yield piece
        at = end


def tally(text: bytes, terms: dict[bytes, int]) -> tuple[int, dict[int, int]]:
    """How many words a text has, and how often each of ``terms`` stands in it, by the term's number."""
    n, found = 0, {}
    for piece in pieces(text):
        words = piece.split()
        n += len(words)
        counts = Counter(words)
        for w in counts.keys() & terms.keys():
            found[terms[w]] = found.get(terms[w], 0) + counts[w]
    return n, found


class Items:
    """One block of items: their rows (key, id), the numbers of their terms and how often an item repeats each."""

    def __init__(self, rows: list[tuple]):
        self.terms: dict[bytes, int] = {}
        self.rows, self.needs = [], []
        for key, item_id, text in rows:
            counts: Counter = Counter()
            for piece in pieces((text or "").encode()):
                counts.update(piece.split())
            if counts:
                self.rows.append((key, item_id))
                self.needs.append([(self.terms.setdefault(w, len(self.terms)), c) for w, c in sorted(counts.items())])


def item_blocks(items: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[Items]:
    rows = items.select(F.col(item_id).alias("id"), F.col(text).cast("string").alias("text")).distinct()
    rows = rows.select(F.xxhash64("id", "text").alias("key"), "id", "text")
    blocks = max(1, -(-(rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0) // block_bytes))
    for k in range(blocks):
        mine = rows if blocks == 1 else rows.filter(F.pmod("key", F.lit(blocks)) == k)
        found = Items([tuple(r) for r in mine.collect()])
        if found.rows:
            yield found


def corpus_counts(docs: DataFrame, shared) -> dict[int, int]:
    """Documents and words of the corpus (``N_DOCS``, ``N_WORDS``), and the documents that hold each term of a block."""

    def count(batches):
        terms = shared.value.terms
        held, n_docs, n_words = np.zeros(len(terms), np.int64), 0, 0
        for batch in sliced(batches, "text", PIECE_BYTES):
            for text in text_bytes(batch, "text"):
                n, found = tally(text, terms)
                n_docs, n_words = n_docs + (n > 0), n_words + n
                held[list(found)] += 1
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((at, [N_DOCS, N_WORDS]))), pa.array(np.concatenate((held[at], [n_docs, n_words])))], ["term", "n"])

    return {r[0]: int(r[1]) for r in docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n")).collect()}


class Shard:
    """Lists of (document, impact) by term, documents numbered in the order of their ids."""

    def __init__(self, ids: list, lengths: array, triples: tuple[array, array, array], weights: np.ndarray, n_docs: int, n_words: int):
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, 0 if ids[i] is None else ids[i]))
        self.ids = [ids[i] for i in order]
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        term, doc, tf = (np.frombuffer(x, np.int64) for x in triples)
        m = 100 - 75 + (75 * np.frombuffer(lengths, np.int64) * n_docs) // n_words
        impact = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
        by = np.lexsort((place[doc], term))
        self.docs, self.impacts = place[doc][by], impact[by]
        self.ends = np.searchsorted(term[by], np.arange(len(weights) + 1))

    def lists(self, needs: list[tuple[int, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
        cut = [(slice(self.ends[t], self.ends[t + 1]), c) for t, c in needs]
        return [(self.docs[s], self.impacts[s] * c) for s, c in cut if s.stop > s.start]


def accumulate(lists: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Term at a time: short lists summed by document into one iterator, if there are any."""
    if not lists:
        return []
    docs, sums = np.concatenate([d for d, _ in lists]), np.concatenate([s for _, s in lists])
    order = np.argsort(docs, kind="stable")
    docs, sums = docs[order], sums[order]
    first = np.flatnonzero(np.concatenate(([True], docs[1:] != docs[:-1])))
    return [(docs[first], np.add.reduceat(sums, first))]


def walk(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, least: int, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Document at a time: the documents (and scores) that may be among the ``top`` of at least the score ``least``.

    A step takes ``STEP`` documents. Lists stand by growing bounds; the first ones whose bounds add up to less than the
    score needed name no candidates and are probed, the largest first, only at documents that can still reach it.
    """
    short = max(64, int(n_docs * SHORT_SHARE))
    iterators = accumulate([x for x in lists if len(x[0]) <= short]) + [x for x in lists if len(x[0]) > short]
    iterators.sort(key=lambda x: int(x[1].max()))
    reach = np.cumsum([int(x[1].max()) for x in iterators])
    edges = np.arange(0, n_docs + STEP, STEP)
    cuts = [np.searchsorted(docs, edges) for docs, _ in iterators]
    found, scores = np.empty(0, np.int64), np.empty(0, np.int64)
    for step in range(len(edges) - 1):
        essential = int(np.searchsorted(reach, least))
        if essential == len(iterators):
            break
        sums = np.zeros(STEP, np.int64)
        for (docs, values), cut in zip(iterators[essential:], cuts[essential:], strict=True):
            sums[docs[cut[step] : cut[step + 1]] - edges[step]] += values[cut[step] : cut[step + 1]]
        own = np.flatnonzero(sums)
        for i in range(essential - 1, -1, -1):
            own = own[sums[own] + reach[i] >= least]
            if not len(own):
                break
            (docs, values), wanted = iterators[i], own + edges[step]
            at = np.searchsorted(docs, wanted)
            hit = docs[np.minimum(at, len(docs) - 1)] == wanted
            sums[own[hit]] += values[at[hit]]
        own = own[sums[own] >= least]
        if len(own):
            found, scores = np.concatenate((found, own + edges[step])), np.concatenate((scores, sums[own]))
            best = np.lexsort((found, -scores))[:top]
            found, scores = found[best], scores[best]
            if len(found) == top:
                least = max(least, int(scores[-1]))
    return found, scores


def search(
    docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    top: int = TOP, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(item_id, rank, doc_id, score): of each item the ``top`` documents of highest score above 0, ties to smaller ids."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind_of = T.StructType([T.StructField("key", T.LongType()), T.StructField("item_id", items.schema[item_id].dataType), T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("score", T.LongType())])
    out = spark.createDataFrame([], kind_of)
    for block in item_blocks(items, item_id, item_text, block_bytes):
        shared = spark.sparkContext.broadcast(block)
        counts = corpus_counts(rows, shared)
        n_docs, n_words = counts.get(N_DOCS, 0), counts.get(N_WORDS, 0)
        if n_docs:
            weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * counts.get(t, 0) + 1))) for t in range(len(block.terms))], np.int64)
            out = out.unionAll(rows.mapInArrow(_searcher(shared, weights, n_docs, n_words, top, shard_bytes, kind_of), kind_of))
    best = ranked(out, ["key", "item_id"], [F.desc("score"), F.col("doc_id").asc_nulls_last()], top)
    return best.select("item_id", "rank", "doc_id", "score")


def _searcher(shared, weights: np.ndarray, n_docs: int, n_words: int, top: int, shard_bytes: int, kind_of: T.StructType):
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(kind_of)

    def order(found: tuple) -> tuple:
        score, own = found
        return -score, own is None, 0 if own is None else own

    def run(batches):
        block: Items = shared.value
        best: list[list[tuple]] = [[] for _ in block.rows]
        ids, lengths, triples, held = [], array("q"), (array("q"), array("q"), array("q")), 0

        def flush():
            shard = Shard(ids, lengths, triples, weights, n_docs, n_words)
            for own, needs in zip(best, block.needs, strict=True):
                if lists := shard.lists(needs):
                    found, scores = walk(lists, len(ids), own[-1][0] if len(own) == top else 1, top)
                    own[:] = sorted(own + [(int(s), shard.ids[d]) for d, s in zip(found, scores, strict=True)], key=order)[:top]

        for batch in sliced(batches, "text", PIECE_BYTES):
            for own, text in zip(batch.column("doc_id").to_pylist(), text_bytes(batch, "text"), strict=True):
                n, found = tally(text, block.terms)
                if found:
                    for part, values in zip(triples, (found.keys(), [len(ids)] * len(found), found.values()), strict=True):
                        part.extend(values)
                    ids.append(own)
                    lengths.append(n)
                held += len(text)
            if held >= shard_bytes:
                flush()
                ids, lengths, triples, held = [], array("q"), (array("q"), array("q"), array("q")), 0
        if ids:
            flush()
        rows = [(key, item, own, score) for (key, item), found in zip(block.rows, best, strict=True) for score, own in found]
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True) if rows else [[]] * 4, kinds, strict=True)], kinds.names)

    return run


def op13_hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = {
    "op13_hybrid_search": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM benchmark),
q AS (SELECT item_id, term, count(*) AS qtf FROM b GROUP BY ALL),
s AS (SELECT count(*) AS nn, CAST(sum(len(w)) AS BIGINT) AS ll FROM d WHERE len(w) > 0),
o AS (SELECT doc_id, len(w) AS n, translate(unnest(w), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
t AS (SELECT doc_id, n, term, count(*) AS tf FROM o WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, s GROUP BY term, nn),
r AS (SELECT item_id, doc_id, CAST(sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * nn) // ll)))) AS BIGINT) AS score
      FROM q JOIN f USING (term) JOIN t USING (term), s GROUP BY item_id, doc_id),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0)
SELECT * FROM k WHERE rank <= 10
""",
}
