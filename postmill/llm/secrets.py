"""Operator 8: secrets by character Markov models. Spark expressions only.

Base spans (assign, access, hex) come from patterns. The method adds tokens of ``MIN_TOKEN`` characters or more: two
first-order Markov models of characters, one of random strings and one of ordinary identifiers, give a log-likelihood
ratio, and a token is a secret if its ratio a character is over a threshold.

Random strings are the values of all base spans, each distinct value once, and as many digests and base64 strings made
by rule as ``made`` says; ordinary identifiers are the words of letters of all documents between separators and in
camel case, and numbers, dates and versions made by rule: what holds no letter is an identifier and no secret. Their character pairs are counted by one aggregation each; the counts (of at most 70 x 70 pairs) reach the
driver and become an array that scores tokens inside Spark.

The threshold is fitted on labelled strings: other strings made by rule, of several alphabets, which the models have not counted,
and identifiers joined from the words of all documents, which are labelled ordinary: each distinct word stands in as many of
them as it occurs, ``SLOTS`` at most, beside words drawn by hash, and all together they weigh its occurrences.
It lies a third of the way from the ratio that 0.999 of the identifiers stay under to the one that 0.98 of the random
strings reach, but never below the former; without identifiers it is ``LEAST_PER_CHAR``.

Nulls: a null text is empty; ids may be null or repeat, each row stands for itself; equal rows get equal results. Other
columns, whatever their names, are not read. Very long texts and texts of very many tokens take time in proportion. Empty
tables give empty results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.common import cut_lineage
from postmill.llm.spans import apart, count_of, joined, matches, placed

KINDS = ["assign", "access", "hex", "random"]
MIN_TOKEN = 20
MIN_DISTINCT = 8
LEAST_PER_CHAR = 0.5
MADE = 2_000
SLOTS = 2
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
_SIZE = len(ALPHABET) + 1

ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)"
PATTERNS = {
    "assign": ASSIGN,
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"(?<![0-9a-f])[0-9a-f]{24,}",
    "random": r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}",
}


def value_of(match: Column) -> Column:
    """Group 2 of an assignment."""
    return F.regexp_extract(match, ASSIGN, 1)


def _distinct_chars(m: Column) -> Column:
    return F.size(F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(m)), lambda i: F.substring(m, i, F.lit(1)))))


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base (spans) and tokens (spans apart from the base ones)."""
    t = F.col("text")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    gates = {"assign": t.contains("=") | t.contains(":"), "access": t.contains("AKIA"), "hex": None, "random": None}
    valid = {
        "assign": lambda m: F.char_length(value_of(m)) >= 6,
        "access": lambda m: F.lit(True),
        "hex": lambda m: F.lit(True),
        "random": lambda m: _distinct_chars(m) >= MIN_DISTINCT,
    }
    rows = rows.withColumns({f"m_{k}": matches(t, PATTERNS[k], gates[k]) for k in KINDS})
    rows = rows.select("doc_id", *(placed(t, F.col(f"m_{k}"), PATTERNS[k], i, valid[k]).alias(f"s_{k}") for i, k in enumerate(KINDS)))
    base = [F.col(f"s_{k}") for k in KINDS[:3]]
    slim = lambda s: F.struct(*(s[c].alias(c) for c in ("kind", "start", "end", "match")))
    return rows.select("doc_id", F.transform(F.concat(*base), slim).alias("base"), F.transform(apart(F.col("s_random"), base), slim).alias("tokens"))


def _codes(text: Column) -> Column:
    """Places in the alphabet, from 1; 0 for any other character."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))


def _pairs(codes: Column) -> Column:
    n = F.greatest(F.size(codes) - 1, F.lit(0))
    return F.arrays_zip(F.slice(codes, F.lit(1), n).alias("a"), F.slice(codes, F.lit(2), n).alias("b"))


def pair_counts(strings: DataFrame) -> dict[tuple[int, int], int]:
    """How often each pair of characters stands in column ``s``: at most 70 x 70 counts."""
    rows = strings.select(F.explode(_pairs(_codes(F.col("s")))).alias("p")).groupBy("p.a", "p.b").count().collect()
    return {(r["a"], r["b"]): r["count"] for r in rows}


def ratios(random: dict, ordinary: dict, add: float = 0.5) -> list[float]:
    """Log ratio of the two models' transition probabilities, for a * size + b."""
    def logs(counts: dict) -> list[list[float]]:
        out = []
        for a in range(_SIZE):
            row = [counts.get((a, b), 0) + add for b in range(_SIZE)]
            total = sum(row)
            out.append([math.log(x / total) for x in row])
        return out

    r, o = logs(random), logs(ordinary)
    return [r[a][b] - o[a][b] for a in range(_SIZE) for b in range(_SIZE)]


def made_strings(spark: SparkSession, first: int, n: int) -> DataFrame:
    """Column ``s``: n digests by rule, each in hexadecimal, in base64 and, twice as long, in letters and digits."""
    short, long = (F.sha2(F.col("id").cast("string").cast("binary"), bits) for bits in (256, 512))
    plain = F.translate(F.base64(F.unhex(long)), "+/=", "")
    return spark.range(first, first + n).select(F.explode(F.array(F.substring(short, 1, 40), F.base64(F.unhex(short)), plain)).alias("s"))


def made_numbers(spark: SparkSession, first: int, n: int) -> DataFrame:
    """Column ``s``: n numbers by rule as they stand in identifiers: long ids, dates and times, versions and groups of digits."""
    digits = F.regexp_replace(F.sha2(F.col("id").cast("string").cast("binary"), 512), "[a-f]", "")
    cut = lambda at, size: F.substring(digits, at, size)
    day = F.date_format(F.date_add(F.lit("1990-01-01").cast("date"), (F.col("id") % 20_000).cast("int")), "yyyy-MM-dd")
    forms = [cut(1, 26), F.concat_ws("-", day, cut(1, 6), cut(7, 4)), F.concat_ws("_", F.regexp_replace(day, "-", "_"), cut(11, 12)), F.concat_ws("-", cut(1, 4), cut(5, 4), cut(9, 4), cut(13, 5)), F.concat_ws("/", F.regexp_replace(day, "-", "/"), cut(20, 10))]
    return spark.range(first, first + n).select(F.explode(F.array(*forms)).alias("s"))


def random_strings(cands: DataFrame, made: int = MADE) -> DataFrame:
    """Distinct values of base spans, and strings made by rule."""
    values = cands.select("doc_id", F.explode("base").alias("b")).select(
        F.when(F.col("b.kind") == 0, value_of(F.col("b.match"))).otherwise(F.col("b.match")).alias("s")
    ).filter(F.char_length("s") >= 12)
    return values.distinct().unionByName(made_strings(cands.sparkSession, 0, made))


def ordinary_counts(docs: DataFrame, text: str = "text") -> dict[tuple[int, int], int]:
    """Character pairs of all documents' words of letters as they stand in identifiers: between _, - or /, and in camel case
    before a capital (the word's own).

    Words are counted first, so that only distinct ones are taken apart; what they hold inside is the same beside all separators.
    """
    words = docs.select(F.explode(F.regexp_extract_all(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit("[A-Za-z]{3,}"), F.lit(0))).alias("w"))
    counted = words.groupBy("w").count()
    form = lambda s, times: F.struct(s.alias("s"), F.lit(times).alias("times"))
    edges = [form(s, 1) for c in "_-/" for s in (F.concat(F.lit(c), F.left("w", F.lit(1))), F.concat(F.right("w", F.lit(1)), F.lit(c)))]
    forms = [form(F.col("w"), 3), *edges, form(F.concat(F.initcap("w"), F.upper(F.left("w", F.lit(1)))), 1)]
    strings = counted.select("count", F.explode(F.array(*forms)).alias("f"))
    rows = strings.select((F.col("count") * F.col("f.times")).alias("n"), F.explode(_pairs(_codes(F.col("f.s")))).alias("p")).groupBy("p.a", "p.b").agg(F.sum("n").alias("n")).collect()
    return {(r["a"], r["b"]): r["n"] for r in rows}


def log_ratio(token: Column, table: list[float]) -> Column:
    values = F.split(F.lit(",".join(f"{x:.6f}" for x in table)), ",").cast("array<double>")  # folded to a constant
    return F.aggregate(_pairs(_codes(token)), F.lit(0.0), lambda t, p: t + F.get(values, p["a"] * _SIZE + p["b"]))


def ordinary_strings(docs: DataFrame, text: str = "text", slots: int = SLOTS) -> DataFrame:
    """Columns ``s`` and ``weight``: identifiers of four words each, joined in several ways, from the words of all documents.

    Words are counted first. Words that are drawn together, about eight, give identifiers of four, the last filled up from the first;
    an identifier weighs what its own words occur.
    """
    plain = r"(?<![A-Za-z0-9])[A-Z]?[a-z]{2,}(?![A-Za-z0-9])"  # whole words, no pieces of random strings
    words = docs.select(F.explode(F.regexp_extract_all(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(plain), F.lit(0))).alias("w"))
    counted = cut_lineage(words.groupBy("w").agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.least("n", F.lit(slots)).cast("int")))
    total = counted.agg(F.sum("k")).first()[0] or 0
    drawn = counted.select("w", (F.col("n") / F.col("k")).alias("n"), F.explode(F.sequence(F.lit(1), F.col("k"))).alias("slot"))
    drawn = drawn.withColumn("h", F.xxhash64("w", "slot"))
    groups = drawn.groupBy(F.pmod("h", F.lit(max(1, total // 8))).alias("g")).agg(F.array_sort(F.collect_list(F.struct("h", "w", "n"))).alias("own"))
    around = F.flatten(F.array_repeat("own", 4))
    runs = groups.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("own"), F.lit(4)), lambda i: F.struct(
        F.slice(around["w"], i, F.lit(4)).alias("w"), F.aggregate(F.slice(F.col("own.n"), i, F.lit(4)), F.lit(0.0), lambda t, x: t + x).alias("weight")))).alias("r")).select("r.*")
    camel = F.array_join(F.transform("w", lambda x: F.initcap(x)), "")
    return runs.select(F.explode(F.array(*(F.array_join("w", c) for c in ("_", "-", "/", "")), camel)).alias("s"), "weight").filter(F.char_length("s") >= MIN_TOKEN)


def per_char(token: Column, table: list[float]) -> Column:
    return log_ratio(token, table) / F.char_length(token)


def fit_threshold(random: DataFrame, ordinary: DataFrame, table: list[float]) -> float:
    """The ratio a character that tells column ``s`` of the two apart, ordinary ones by their ``weight``; see the module's text."""
    def quantile(df: DataFrame, at: float) -> float | None:
        """By the weights of the ratios, of which those of 3 digits, some thousand, reach the driver."""
        rows = sorted(df.groupBy(F.round(per_char(F.col("s"), table), 3).alias("x")).agg(F.sum("weight").alias("w")).collect())
        left = at * sum(r["w"] for r in rows)
        for r in rows:
            left -= r["w"]
            if left <= 0:
                return r["x"]
        return None

    low, high = quantile(ordinary, 0.999), quantile(random.withColumn("weight", F.lit(1.0)), 0.02)
    return LEAST_PER_CHAR if low is None or high is None else max(low, low + (high - low) / 3)


def find_secrets(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least: float | None = None, made: int = MADE) -> DataFrame:
    """doc_id, base and added: arrays of spans (kind, start, end, match); ``added`` are the tokens that score as random,
    with ``least`` or more a character (None: fitted)."""
    cands = cut_lineage(candidates(docs, doc_id, text))
    words, numbers = ordinary_counts(docs, text), pair_counts(made_numbers(docs.sparkSession, 0, made))
    ordinary = {p: words.get(p, 0) + numbers.get(p, 0) for p in words.keys() | numbers.keys()}
    table = ratios(pair_counts(random_strings(cands, made)), ordinary)
    if least is None:
        letters = F.translate("s", "+/=", "xyz")
        held = made_strings(docs.sparkSession, made, made).select(F.explode(F.array("s", F.substring(letters, 3, 24))).alias("s"))
        least = fit_threshold(held, ordinary_strings(docs, text), table)
    added = F.filter("tokens", lambda s: per_char(s["match"], table) >= least)
    return cands.select("doc_id", "base", added.alias("added"))


def op8_secret_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        "doc_id", *(count_of(F.col("base"), i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])),
        F.sha2(joined(F.col("base"), KINDS, False).cast("binary"), 256).alias("base_sha256"),
        joined(F.concat("base", "added"), KINDS, False).alias("spans"), (F.size("base") + F.size("added")).cast("long").alias("n_spans"),
    )
