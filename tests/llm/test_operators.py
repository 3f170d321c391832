"""Each operator against brute force on small fixtures with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import os
import random
import re
import subprocess
import sys
import time
import zlib
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from postmill.llm import chat, decontamination, mixing, pii, quality, queries, repetition, secrets, sharding, simhash, suffix, warc
from postmill.llm.components import components
from tests.oracle import assert_same

rnd = random.Random(3)
WORDS = ["alpha", "beta", "gamma", "delta", "été", "Zeta", "eta", "theta", "iota", "kappa", "x1", "y2"]
PHRASE = "the quick brown fox jumps over the lazy dog near the old river bank today"


def prose(n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


TEXTS = [
    None, "", "   \n\t ", "one", "a b c", PHRASE, PHRASE.upper() + "!", prose(40) + " " + PHRASE + " " + prose(30), prose(200), prose(200),
    "und " * 400, ("same line of seven words right here\n" * 20), prose(20_000), prose(40), "Straße ßß ÀÉ " + prose(30),
]
TEXTS += [TEXTS[8], TEXTS[8], TEXTS[12], TEXTS[8] + " extra"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["a", "b", None, ""][i % 4], "en", None if t is None else len(t), i, 1.5, "x") for i, t in enumerate(TEXTS)]
    rows += [rows[5], (None, TEXTS[8], "a", "en", 1, 0, 0.0, "y"), (None, "only here with no id at all", "a", "en", 1, 0, 0.0, "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, shard int, fp double, spans string").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def bench(spark):
    items = [(1, PHRASE), (2, "lazy dog"), (10, None), (11, ""), (12, PHRASE), (None, "old river bank"), (3, " ".join(PHRASE.split()[:10]))]
    return spark.createDataFrame(items, "item_id long, text string")


# 1
def digest_rows(found):
    rows = found.select("doc_id", "n_words", F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]).alias("h"), "item_ids").collect()
    return sorted(((r[0], r[1], r[2], len(r[3]), hashlib.sha256(",".join(sorted(r[3])).encode()).hexdigest(), r[2] > 0) for r in rows), key=repr)


@pytest.mark.parametrize("block", [1 << 24, 200])
@pytest.mark.parametrize("shard", [1 << 20, 100])
def test_contamination_is_brute_force(spark, docs, block, shard):
    b = bench(spark)
    items = [(r.item_id, r.text) for r in b.collect() if r.item_id is not None]
    named = b.filter("item_id is not null")
    got = digest_rows(decontamination.contamination(docs, named, shard_bytes=shard, block_bytes=block))
    want = decontamination.brute_force([(r.doc_id, r.text) for r in docs.collect()], items)
    assert got == sorted(want, key=repr)


def test_decontaminate_leaves_no_passage(spark, docs, empty):
    b = bench(spark)
    clean = decontamination.decontaminate(docs, b)
    assert clean.columns == docs.columns
    assert not [r for r in decontamination.contamination(clean, b).collect() if len(r.spans)]
    before = {r.doc_id: r.text for r in docs.collect()}
    after = {r.doc_id: r for r in clean.collect()}
    assert 5 not in after and 0 in after and after[1].text == ""  # nothing but the passage; null; empty
    assert after[8].text == before[8] and after[7].n_chars == len(after[7].text) < len(before[7])
    assert decontamination.decontaminate(empty, b).count() == 0 and decontamination.decontaminate(docs, b.limit(0)).count() == docs.count()


def test_cut_that_joins_a_new_hit(spark):
    ws = PHRASE.split()[:10]
    t = " ".join(ws[:5] + ws + ws[5:])
    d = spark.createDataFrame([(1, "pre " + t + " post")], "doc_id long, text string")
    assert decontamination.decontaminate(d, bench(spark).filter("item_id = 3")).first().text.split() == ["pre", "post"]


@pytest.mark.parametrize("swap", [False, True])
def test_cut_goes_on_over_all_blocks(spark, swap):
    a, b = (" ".join(f"{x}{i}" for i in range(1, 11)) for x in ("ba" if swap else "ab"))
    text = " ".join(a.split()[:5] + b.split() + a.split()[5:])
    items = spark.createDataFrame([(1, a), (2, b)] * 3, "item_id long, text string")
    d = spark.createDataFrame([(1, text, "?"), (2, "kept as it is", "?")], "doc_id long, text string, n_chars string")
    assert len(list(decontamination.phrase_blocks(items, "item_id", "text", 10, 60))) > 1
    out = decontamination.decontaminate(d, items, block_bytes=60)
    assert [(r.doc_id, r.text, r.n_chars) for r in out.collect()] == [(2, "kept as it is", "?")]
    more = decontamination.decontaminate(d.withColumn("text", F.concat(F.lit("x "), "text", F.lit(" y"))), items, block_bytes=60)
    assert not decontamination.contamination(more, items).filter("size(spans) > 0").count() and more.count() == 2


@pytest.mark.parametrize("n,sigma", [(50, 3), (400, 5), (300, 2)])
def test_fm_index(n, sigma):
    s = np.array([rnd.randrange(0 if i % 9 == 0 else 1, sigma) for i in range(n)] + [0])
    f = suffix.FMIndex(s, sigma, 4)
    for size in (1, 2, 5):
        p = np.array([[rnd.randrange(1, sigma) for _ in range(size)] for _ in range(20)])
        lo, hi = f.search(p, np.full(20, size))
        for row, a, b in zip(p, lo, hi, strict=True):
            want = [i for i in range(n - size + 1) if (s[i : i + size] == row).all()]
            assert sorted(f.locate(np.arange(a, b)).tolist()) == want


# 2
def test_quality_learns_and_handles_edges(spark, sf, docs, empty):
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(d, labels)
    rows = {r.doc_id: r.score for r in quality.score(d, model).collect()}
    tests = [(r.quality, rows[r.doc_id]) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    pos, neg = [s for q, s in tests if q == 1], [s for q, s in tests if q == 0]
    assert np.mean([s >= 0.3 for s in pos]) > 0.9
    auc = np.mean([(p > q) + (p == q) / 2 for p in pos for q in neg]) if neg else 1
    assert auc > 0.95
    scored = quality.score(docs, model).collect()
    assert len(scored) == docs.count() and all(0 <= r.score <= 1 for r in scored)
    assert quality.score(empty, model).count() == 0 and quality.keep_good(docs, model).columns == docs.columns
    assert quality.train(d, labels.limit(0)) is None and {r.score for r in quality.score(docs, None).collect()} == {0.5}


def test_held_out_labels_teach_nothing(spark, sf):
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    lies = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.train(d, labels), quality.train(d, lies)
    assert np.array_equal(a.weights, b.weights)


def test_quality_sample_is_bounded_under_repeats(spark):
    lines = F.concat(F.lit("word "), F.col("id").cast("string"), F.lit(" is here. Another one is there too."))
    d = spark.range(30_000).select(F.when(F.col("id") < 10_000, 0).when(F.col("id") < 20_000, None).otherwise(F.col("id")).alias("doc_id"), lines.alias("text"))
    d = d.unionAll(spark.range(10_000).select(F.lit(1).cast("long"), F.lit("one text that is copied")))
    labels = spark.createDataFrame([(0, 1), (1, 1), (None, 1), (25_000, 1), (25_001, None)], "doc_id long, quality int")
    seen = []
    real = quality.fit
    try:
        quality.fit = lambda p, u, prior, **k: seen.append((len(p), len(u))) or real(p, u, prior, steps=5)
        quality.train(d, labels, max_unlabelled=500)
    finally:
        quality.fit = real
    assert seen[-1][0] <= 3 and 100 < seen[-1][1] < 700


def test_held_out_texts_are_not_read(spark, sf):
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    other = d.withColumn("text", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit("%% !!")).otherwise(F.col("text")))
    assert np.array_equal(quality.train(d, labels).weights, quality.train(other, labels).weights)


def test_risk_is_not_negative():
    z = np.linspace(-3, 3, 50)
    assert quality.risk_parts(z, z, 0.9)[0] > 0


# 3 and 8
KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
}
PII_TEXTS = [
    None, "", "mail a.b@c.com.x_y@d.org, a@b a@b.c-d..e@f.g", "1.2.3.4.5.6.7.8 999.1.1.1 01.002.3.255 1.1.1", "card 4556 7375-8689 9855 and 4556737586899855",
    "+1 (743) 555-3824 or +4912345 +1-2 ++49 30 1234567.", "é𝄞 a@b.co 😀 8.8.8.8", "9" * 5000, "x" * 100_000 + "@y.com", "1." * 3000, "a@" * 500 + "b.c",
    "call me at (212) 555-0100 or write to joe [at] mail [dot] com", "4556737586899855 " * 300, "version 10.20.30.40", "a.b@c" + ".d" * 4000, "7 " * 9, " ".join(f"é u{i}@mail{i % 9}.com 1.2.3.{i % 300}" for i in range(1500)),
]


def luhn(s):
    total = 0
    for i, c in enumerate(reversed(s)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def test_pii_base_spans(spark, empty):
    d = spark.createDataFrame([(i, t, 0) for i, t in enumerate(PII_TEXTS)] + [(2, PII_TEXTS[2], 0), (None, PII_TEXTS[2], 0)], "doc_id long, text string, spans int")
    for r in pii.find_personal(d).join(d, "doc_id").select("text", "base", "added").collect():
        want = sorted((list(KINDS).index(k), m.start(), m.end()) for k, (p, ok) in KINDS.items() for m in re.finditer(p, r.text or "") if ok(m[0]))
        assert sorted(map(tuple, r.base)) == want
        assert all(a.end <= b.start or b.end <= a.start for a in r.added for b in r.base)
    assert pii.find_personal(empty).count() == 0


def test_pii_loose_spans_need_support(spark):
    rows = [(i, f"please call me at (21{i % 10}) 555-01{i:02d} today") for i in range(60)] + [(100 + i, f"invoice no 555-777-12{i:02d}") for i in range(20)]
    got = {r.doc_id: len(r.added) for r in pii.find_personal(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[i] for i in range(60)) >= 55 and not any(got[100 + i] for i in range(20))


def luhn_number(prefix, n):
    body = prefix + "".join(rnd.choice("0123456789") for _ in range(n - 1 - len(prefix)))
    return next(body + c for c in "0123456789" if luhn(body + c))


def test_pii_added_spans_on_planted_rows(spark):
    """Precision and recall of added spans; a third of the personal ones have no cue word."""
    dig = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    hexa = lambda: "".join(rnd.choice("0123456789abcdef") for _ in range(4))
    good = [
        (("write to ", "my email is ", "so "), lambda: rnd.choice([f"joe{dig(2)} [at] mail{dig(1)} [dot] com", f"ann(at)post{dig(1)}(dot)de", f"kim{dig(3)} at web dot org"])),
        (("from host ", "server ", "the "), lambda: rnd.choice(["2" + ":".join(hexa() for _ in range(8))[1:], f"2a01:{dig(3)}:{dig(2)}::{dig(2)}"])),
        (("card ", "charge to ", "with "), lambda: luhn_number(rnd.choice(["34", "37"]), 15)),
        (("call me at ", "tel: ", "and "), lambda: rnd.choice([f"({rnd.randrange(3, 9)}{dig(2)}) 7{dig(2)}-{dig(4)}", f"0044 {dig(3)} {dig(4)}", f"0{rnd.randrange(1, 9)}{dig(2)} {dig(3)} {dig(4)}"])),
    ]
    bad = [
        (("meet ", "look "), lambda: f"joe{dig(2)} at mail dot zzq"), (("ratio ", "section "), lambda: "8:30::9"),
        (("order no ", "serial "), lambda: luhn_number("31", 15)), (("invoice no ", "part "), lambda: f"{rnd.randrange(3, 9)}{dig(2)}-{dig(3)}-{dig(4)}"),
    ]
    rows, want = [], {}
    for i in range(800):
        cues, make = rnd.choice(good if i % 5 < 3 else bad)
        before, span = prose(12) + " " + rnd.choice(cues), make()
        rows.append((i, before + span + " " + prose(5), "c"))
        want[i] = (len(before), len(before) + len(span)) if i % 5 < 3 else None
    d = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    got = {r.doc_id: [(s.start, s.end) for s in r.added] for r in pii.find_personal(d).collect()}
    hits = sum(any(a < w[1] and w[0] < b for a, b in got[i]) for i, w in want.items() if w)
    wrong = sum(len(got[i]) for i, w in want.items() if not w)
    assert hits / sum(map(bool, want.values())) >= 0.9 and hits / (hits + wrong) >= 0.9


PLANTED = {
    "email": ([f"joe{i} [at] mail{i % 7} [dot] com" for i in range(20)] + [f"kim{i} at web dot org" for i in range(20)], [f"joe{i} at mail dot zzq" for i in range(15)], "write to ", lambda i: f"a{i}@mail.com"),
    "ip": ([f"2a01:{i + 10}:7::{i + 1}" for i in range(40)], [f"8:{i + 10}::9" for i in range(15)], "from host ", lambda i: f"8.{i % 250}.{i // 250 % 250}.7"),
    "card": (None, None, "card ", lambda i: luhn_number("4", 16)),
    "phone": ([f"({400 + i}) 7{i + 10}-12{i + 10}" for i in range(20)] + [f"0{i + 211} 7{i + 10} 44{i + 10}" for i in range(20)], [f"invoice no {300 + i}-7{i + 10}-44{i + 10}" for i in range(15)], "call me on ", lambda i: f"+49 30 {1000000 + i}"),
}


@pytest.mark.parametrize("n", [0, 200, 2000, 40000])
def test_pii_added_spans_beside_any_number_of_base_spans(spark, n):
    """Every kind, with cue words before all, none or half of them: what is loose doesn't drown in what is plain."""
    for cued in (0, 1, 2):
        rows, want = [], {}
        for kind, (good, bad, cue, base) in PLANTED.items():
            good = good or [luhn_number(rnd.choice(["34", "37"]), 15) for _ in range(40)]
            bad = bad or ["serial " + luhn_number("31", 15) for _ in range(15)]
            for i, span in enumerate(good + bad):
                before = "so it is " + (cue if i < len(good) and (cued == 1 or cued == 2 and i % 2) else "the ")
                want[len(rows)] = (kind, i < len(good))
                rows.append((len(rows), before + span + " then"))
            rows.append((-1 - len(rows), ", ".join(base(i) for i in range(n))))
        got = {r.doc_id: len(r.added) for r in pii.find_personal(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        for kind in PLANTED:
            hits = sum(got[i] for i, w in want.items() if w == (kind, True))
            wrong = sum(got[i] for i, w in want.items() if w == (kind, False))
            assert hits >= 36 and hits >= 0.9 * (hits + wrong), (kind, cued, hits, wrong)


def test_reliabilities_are_plain_em():
    counts = [(3, (1, 1, 1, -1, -1), 40), (3, (-1, 1, -1, 0, -1), 30), (3, (-1, 1, -1, -1, -1), 20), (0, (1, 1, -1, -1, -1), 5)]
    prior, rate, post = pii.reliabilities(counts, rounds=1)
    for kind, v, _ in counts:
        start = [pii.start_rates(kind, j) for j in range(pii.LABELERS)]
        yes = np.prod([start[j][0][x] for j, x in enumerate(v)])
        no = np.prod([start[j][1][x] for j, x in enumerate(v)])
        assert post[kind, v] == pytest.approx(yes / (yes + no))
    mass = sum(post[3, v] * n for k, v, n in counts if k == 3)
    assert prior[3] == pytest.approx((pii.PRIOR * pii.PSEUDO + mass) / (pii.PSEUDO + 90))
    ones = sum(post[3, v] * n for k, v, n in counts if k == 3 and v[2] == 1)
    assert rate[3, 2][0][1] == pytest.approx((pii.PSEUDO * pii.START[2][0][0] + ones) / (pii.PSEUDO + mass))
    _, _, end = pii.reliabilities(counts)
    assert end[counts[0][:2]] > 0.9 and end[counts[1][:2]] < 0.1


def test_many_spans_take_time_in_proportion(spark):
    d = spark.createDataFrame([(1, " ".join(f"a{i}@mail.com" for i in range(100_000)))], "doc_id long, text string")
    start = time.perf_counter()
    assert pii.find_personal(d).select(F.size("base")).first()[0] == 100_000
    s = spark.createDataFrame([(1, " ".join(f"token=abcdef{i}" for i in range(50_000)))], "doc_id long, text string")
    assert secrets.find_secrets(s).select(F.size("base")).first()[0] == 50_000
    assert time.perf_counter() - start < 90


SECRETS = {
    "assign": (r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 6),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
}
RANDOM = "Zx9Qv7Lk2Rt5Wn8Bp4Hj6Yd3Mc1"
SECRET_TEXTS = [
    None, "", "token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" x", "Password:short PASSWORD : 'longenough' api_key=abc.def_=", "AKIA" + "A" * 16 + " AKIAAKIA" + "B" * 20,
    "AKIA123", "0123456789abcdef" * 3 + "g", "key " + RANDOM + " end", "é𝄞 secret=abcdef1 😀", "f" * 50_000, "token=" * 300, "-" * 400, "theinternationalizationofcommunication",
    "passwordpassword=passwd:abcdefg",
]


def test_secret_base_spans(spark, empty):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(SECRET_TEXTS)], "doc_id long, text string")
    for r in secrets.find_secrets(d).join(d, "doc_id").select("text", "base", "added").collect():
        want = sorted((m.start(), list(SECRETS).index(k), m.end()) for k, (p, ok) in SECRETS.items() for m in re.finditer(p, r.text or "") if ok(m))
        assert sorted((s.start, s.kind, s.end) for s in r.base) == want
    assert secrets.find_secrets(empty).count() == 0


def test_markov_tells_random_from_ordinary(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(-1, "see " + RANDOM + " ok"), (-2, "see theinternationaltionrething and interestingandthereareanother ok")], "doc_id long, text string")
    got = {r.doc_id: [s.match for s in r.added] for r in secrets.find_secrets(d.unionAll(more)).filter("doc_id < 0").collect()}
    assert got[-1] == [RANDOM] and got[-2] == []


def test_markov_leaves_numbers_alone(spark, sf):
    """Digit runs, dates, versions and grouped ids of 20 characters and more; beside them random tokens of digits and letters."""
    dig = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    makers = [lambda: dig(22), lambda: dig(40), lambda: f"20{dig(2)}-{dig(2)}-{dig(2)}-{dig(6)}-{dig(4)}", lambda: f"{dig(4)}-{dig(4)}-{dig(4)}-{dig(5)}", lambda: f"{dig(8)}_{dig(6)}_{dig(7)}"]
    numbers = [f"id {rnd.choice(makers)()} ok" for _ in range(300)]
    tokens = ["id " + "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(rnd.randrange(20, 33))) + " ok" for _ in range(300)]
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(numbers + tokens)], "doc_id long, text string")
    got = {r.doc_id: len(r.added) for r in secrets.find_secrets(d.unionAll(more)).filter("doc_id < 0").collect()}
    assert sum(got[-1 - i] for i in range(300)) == 0 and sum(got[-301 - i] for i in range(300)) >= 285


def test_markov_recall_on_planted_tokens(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    words = ["interesting", "the", "another", "there", "international", "configuration", "value"]
    alphabet = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    rows = [(-1 - i, "see " + ("".join(rnd.choice(alphabet) for _ in range(rnd.randrange(20, 44))) if i % 2 else rnd.choice("_-/").join(rnd.choices(words, k=5))) + " ok", 7) for i in range(600)]
    planted = spark.createDataFrame(rows, "doc_id long, text string, kind int").drop("kind")
    got = {r.doc_id: len(r.added) for r in secrets.find_secrets(d.unionAll(planted)).filter("doc_id < 0").collect()}
    assert np.mean([got[i] > 0 for i, _, _ in rows[1::2]]) >= 0.9 and not any(got[i] for i, _, _ in rows[::2])


def test_log_ratio_is_the_models(spark):
    random, ordinary = {(1, 2): 5, (2, 3): 1}, {(1, 2): 1, (2, 1): 4}
    table = secrets.ratios(random, ordinary)
    text = "abc-ba?"
    codes = [secrets.ALPHABET.find(c) + 1 for c in text]
    n = len(secrets.ALPHABET) + 1
    p = lambda c, a, b: (c.get((a, b), 0) + 0.5) / (sum(v for (x, _), v in c.items() if x == a) + 0.5 * n)
    want = sum(np.log(p(random, a, b) / p(ordinary, a, b)) for a, b in zip(codes, codes[1:], strict=False))
    got = spark.createDataFrame([(text,)], "s string").select(secrets.log_ratio(F.col("s"), table)).first()[0]
    assert got == pytest.approx(want, abs=1e-4)


def test_markov_counts_all_documents_and_distinct_values(spark, docs):
    many = docs.select("doc_id", "text").unionAll(spark.range(1200).selectExpr("id", "'Zqx vvK foo-barBaz a bb' as text"))
    want = {}
    for (t,) in many.select("text").collect():
        for s in [f for w in re.findall("[A-Za-z]{3,}", t or "") for f in ("_" + w + "_", "-" + w + "-", "/" + w + "/", w.capitalize() + w[0].upper())]:
            codes = [secrets.ALPHABET.find(c) + 1 for c in s]
            for pair in zip(codes, codes[1:], strict=False):
                want[pair] = want.get(pair, 0) + 1
    assert secrets.ordinary_counts(many) == want
    same = spark.range(50).selectExpr("id as doc_id", "'password=abcdefghijkl1234 x' as text")
    assert secrets.random_strings(secrets.candidates(same)).filter("s = 'abcdefghijkl1234'").count() == 1


# 4
def brute_simhash(texts):
    fps = []
    for t in texts:
        words = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        sh = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)))
    return fps


def roots(fps, radius=4):
    out = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius and out[i] != out[j]:
                a, b = min(out[i], out[j]), max(out[i], out[j])
                out = [a if x == b else x for x in out]
    return out


def test_fingerprints(docs):
    rows = docs.collect()
    assert simhash.fingerprints_of([(r.text or "").encode() for r in rows]).tolist() == brute_simhash([r.text for r in rows])


def test_components_are_brute_force(docs, empty):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    fps = brute_simhash([t for _, t in rows])
    group = roots(fps)
    low = {}
    for (i, _), g in zip(rows, group, strict=True):
        if i is not None:
            low[g] = min(low.get(g, i), i)
    want = sorted(((i, f - (1 << 64) if f >> 63 else f, low.get(g)) for (i, _), f, g in zip(rows, fps, group, strict=True)), key=repr)
    got = sorted(((r.doc_id, r.fp, r.component_id) for r in simhash.near_components(docs).collect()), key=repr)
    assert got == want
    assert simhash.near_components(empty).count() == 0


def test_long_texts_are_hashed_in_slices(monkeypatch):
    texts = [(t or "").encode() for t in TEXTS]
    want = simhash.fingerprints_of(texts).tolist(), [simhash.signature(t) for t in texts]
    monkeypatch.setattr(simhash, "SLICE", 7)
    assert (simhash.fingerprints_of(texts).tolist(), [simhash.signature(t) for t in texts]) == want


def near_copy(words, changes):
    words = list(words)
    for k in rnd.sample(range(len(words)), changes):
        words[k] = f"new{rnd.randrange(10**6)}"
    return " ".join(words)


def test_one_row_of_each_group_stays(spark, docs, empty):
    base = [[f"{rnd.choice(WORDS)}{rnd.randrange(300)}" for _ in range(250)] for _ in range(25)]
    rows = [(100 * b + c, near_copy(ws, rnd.choice([0, 1, 2, 3, 4])), b) for b, ws in enumerate(base) for c in range(8)]
    rows += [(7, "an id that stands twice with other texts " + prose(20), -1), (7, rows[0][1], 0), (None, rows[0][1], 0), (None, prose(60), -2), (5000, None, -3), (5001, " \n", -3), (5002, "", -3)]
    rows += [rows[9], rows[9]]
    d = spark.createDataFrame([(i, t, b, "k") for i, t, b in rows], "doc_id long, text string, fp long, raw string").repartition(5)
    kept = simhash.one_of_each(d).collect()
    sets = {t: {tuple((t or "").lower().split()[i : i + 5]) for i in range(max(1, len((t or "").split()) - 4))} for _, t, _ in rows}
    alike = lambda x, y: len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y])
    of = {r.doc_id: r.fp for r in kept}
    assert len({(r.doc_id, r.text) for r in kept}) == len(kept)
    for b in range(25):  # exact copies never both stay, and few pairs of 0.8 or more do
        mine = [r.text for r in kept if r.fp == b]
        assert len(set(mine)) == len(mine) and 0 in [i % 100 for i, f in of.items() if f == b and i is not None] or b == 0
    missed = [(x.doc_id, y.doc_id) for x in kept for y in kept if x.doc_id != y.doc_id and alike(x.text, y.text)]
    assert len(missed) <= 4
    for i, t, b in rows:  # nothing goes that no kept text stands for, directly or by a chain
        if not any(r.doc_id == i and r.text == t for r in kept):
            assert any(r.fp == b for r in kept)
    assert sum(r.fp == -3 for r in kept) == 1 and [r.doc_id for r in kept if r.fp == -3] == [5000]
    assert [r.doc_id for r in kept if r.fp == -2] == [None] and [r.doc_id for r in kept if r.fp == -1] == [7]
    assert simhash.one_of_each(docs).columns == docs.columns and simhash.one_of_each(empty).count() == 0
    hot = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit(rows[0][1])).otherwise(F.concat(F.lit("only "), F.col("id").cast("string"))).alias("text"))
    assert simhash.one_of_each(hot).count() == 10_001


def test_near_groups_recall_against_brute_force(spark):
    base = [[f"w{rnd.randrange(5000)}" for _ in range(300)] for _ in range(40)]
    texts = [near_copy(ws, rnd.randrange(0, 13)) for ws in base for _ in range(6)]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(296)} for t in texts]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    root = {r.doc_id: r.root for r in simhash.text_components(d).collect()}
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if i // 6 == j // 6 and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(pairs) > 50 and np.mean([root[i] == root[j] for i, j in pairs]) >= 0.9
    assert all(i // 6 == j // 6 for i in root for j in root if root[i] == root[j])


def test_long_text_stays_below_a_gigabyte():
    code = """
import resource, sys
sys.path.insert(0, {root!r})
from postmill.llm import repetition, simhash
if {name!r} == "simhash":
    t = b" ".join(b"w%d" % (i * 7919 % 99991) for i in range(100_000)) * 75
    assert len(t) > 45_000_000
    simhash.fingerprints_of([t])
else:
    assert repetition.measure([b"a b " * 2_500_000])["longest"][0] == 4_999_998
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for name in ("simhash", "repetition"):
        out = subprocess.run([sys.executable, "-c", code.format(root=root, name=name)], capture_output=True, text=True, timeout=300)
        assert int(out.stdout.split()[-1]) < 1000, (name, out.stdout, out.stderr[-300:])


@pytest.mark.parametrize("recut", [1 << 18, 20])
@pytest.mark.parametrize("shard,blocks", [(4096, None), (16, None), (16, 6), (7, 8)])
def test_links_lose_nothing(spark, shard, blocks, recut):
    base = [rnd.getrandbits(64) for _ in range(30)]
    fps = {b ^ sum(1 << k for k in rnd.sample(range(64), rnd.randrange(6))) for b in base for _ in range(rnd.randrange(40))} | set(base)
    fps |= {base[0] ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(12)}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.near_links(spark.createDataFrame([(s,) for s in signed], "fp long"), 4, shard, blocks, recut)
    assert links.count() < (40 if recut > 20 else 400) * len(fps)
    got = {r.node: r.root for r in components(links).collect()}
    want = roots(fps)
    for s, w in zip(signed, want, strict=True):
        assert got.get(s, s) == got.get(signed[w], signed[w])
    assert len({got.get(s, s) for s in signed}) == len(set(want))


@pytest.mark.parametrize("recut", [1 << 18, 4000])
def test_one_bucket_of_many_fingerprints_loses_nothing(spark, recut):
    """Over 4,096 fingerprints that all agree in 40 bits: pairs of shards, or buckets cut anew, find every link."""
    draw = np.random.default_rng(7)
    top = int(draw.integers(1, 1 << 62)) >> 24 << 24
    fps = np.unique(draw.integers(0, 1 << 24, 6000).astype(np.int64) | top)
    assert len(fps) > 4096
    links = simhash.near_links(spark.createDataFrame([(int(f),) for f in fps], "fp long"), 3, 1024, 4, recut)
    got = {r.node: r.root for r in components(links).collect()}
    label = np.arange(len(fps))
    for i in range(len(fps)):
        near = np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 3)
        low = label[near].min()
        for other in np.unique(label[near]):
            label[label == other] = low
    roots_of = {}
    for f, g in zip(fps.tolist(), label.tolist(), strict=True):
        roots_of.setdefault(g, set()).add(got.get(f, f))
    assert all(len(r) == 1 for r in roots_of.values()) and len({next(iter(r)) for r in roots_of.values()}) == len(roots_of)


def test_hot_keys_join_like_others(spark):
    rows = spark.range(50).select(F.when(F.col("id") < 30, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    table = rows.groupBy("k").agg(F.count("*").alias("n")).withColumn("t", F.col("k") * 2)
    want = sorted(map(tuple, rows.join(table, "k").select("k", "v", "n", "t").collect()))
    for hot in (2, 100):
        assert sorted(map(tuple, simhash.join_groups(rows, table, ["k"], hot).select("k", "v", "n", "t").collect())) == want


def test_bk_tree_edges():
    fps = np.array([rnd.getrandbits(64) for _ in range(300)], np.uint64)
    forest = simhash.Forest(fps, np.zeros(300, int))
    for key, node in zip(forest.keys, forest.nodes, strict=True):
        parent, d = divmod(int(key), 65)
        assert int(fps[parent] ^ fps[node]).bit_count() == d


# 5
def test_shards(spark, docs, empty):
    rows = sharding.interleave(sharding.manifest(docs), 4, ties=("text_crc32", "size")).collect()
    n = len(rows)
    assert n == docs.count()
    for s in range(4):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    counts = [sum(r.shard == s for r in rows) for s in range(4)]
    assert max(counts) - min(counts) <= 1
    assert sharding.interleave(sharding.manifest(empty), 4).count() == 0
    many = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 240, "hot").otherwise("cold").alias("source"))
    for r in sharding.interleave(many, 8).groupBy("shard").agg(F.count_if(F.col("source") == "hot").alias("h"), F.count("*").alias("n")).collect():
        assert r.n == 50 and abs(r.h - 30) <= 1


def test_shards_hold_whole_rows(spark, docs, empty):
    twice = docs.unionAll(docs)  # equal rows, as the mix makes them
    got = sharding.deal(twice, 4)
    columns = [c for c in docs.columns if c != "shard"]
    assert got.columns == [*columns, "shard", "slot"]
    assert sorted(map(repr, got.select(*columns).collect())) == sorted(map(repr, twice.select(*columns).collect()))
    narrow = sharding.interleave(sharding.manifest(twice.select("doc_id", "source", "text")), 4, ties=("text_crc32", "size"))
    digest = ["doc_id", "source", "size", "text_crc32", "shard"]
    assert sorted(map(repr, sharding.manifest(got).select(*digest).collect())) == sorted(map(repr, narrow.select(*digest).collect()))
    for s in range(4):
        slots = sorted(r.slot for r in got.filter(F.col("shard") == s).collect())
        assert slots == list(range(len(slots)))
    assert sharding.deal(empty, 4).count() == 0


def test_shards_are_brute_force(spark, docs):
    rows = sharding.manifest(docs.select("doc_id", "source", "text"))
    hashed = rows.withColumn("h", F.xxhash64("doc_id", "text_crc32", "size", F.lit(sharding.SEED))).collect()
    null_first = lambda v: (v is not None, v if v is not None else 0)
    name = lambda v: (v is not None, v or "")
    order = sorted(hashed, key=lambda r: (name(r.source), r.h, null_first(r.doc_id), r.text_crc32, r.size))
    seen, placed = {}, []
    for r in order:
        seen[r.source] = seen.get(r.source, 0) + 1
        placed.append(((seen[r.source] - 0.5) / sum(x.source == r.source for x in hashed), r))
    placed.sort(key=lambda p: (p[0], p[1].h, name(p[1].source), null_first(p[1].doc_id), p[1].text_crc32, p[1].size))
    want, n, slots = [], len(placed), {}
    for i, (_, r) in enumerate(placed):
        s = i * 4 // n
        slots[s] = slots.get(s, -1) + 1
        want.append((r.doc_id, r.source, r.size, r.text_crc32, s, slots[s]))
    got = sharding.interleave(rows, 4, ties=("text_crc32", "size")).select("doc_id", "source", "size", "text_crc32", "shard", "slot").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_equal_rows_are_dealt_evenly(spark):
    same = spark.range(60_000).select(F.lit(3).alias("doc_id"), F.lit("a").alias("source"), F.lit("text").alias("text"))
    got = sharding.deal(same, 16).groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.max("slot").alias("m")).collect()
    assert {(r.n, r.d, r.m) for r in got} == {(3750, 3750, 3749)} and len(got) == 16


# 6
def brute_repeats(text, least):
    w = (text or "").encode().split()
    spans, longest = set(), 0
    for size in range(1, len(w)):
        seen = {}
        for i in range(len(w) - size + 1):
            seen.setdefault(tuple(w[i : i + size]), []).append(i)
        twice = [i for at in seen.values() if len(at) > 1 for i in at]
        if not twice:
            break
        longest = size
        if size == least:
            spans = {k for i in twice for k in range(i, i + size)}
    return len(spans), longest


def test_repetition_is_brute_force(docs, empty):
    texts = {(r.doc_id, r.text) for r in docs.filter("doc_id is not null").collect()}
    got = {r.doc_id: r for r in repetition.repetition(docs.filter("doc_id is not null"), batch_bytes=3000).collect()}
    for i, t in texts:
        if len(t or "") < 9000:
            assert (got[i].covered, got[i].longest) == brute_repeats(t, repetition.MIN_REPEAT)
            assert got[i].n_repeat_words == brute_repeats(t, 5)[0]
    assert repetition.repetition(empty).count() == 0


def test_walked_prefixes_are_the_same(monkeypatch):
    texts = [(t or "").encode() for t in TEXTS]
    want = repetition.measure(texts)
    monkeypatch.setattr(repetition, "KEPT_RANKS", 0)
    got = repetition.measure(texts)
    assert all((got[k] == want[k]).all() for k in want)


def test_verdict(docs):
    kept = {r.doc_id: r.kept for r in repetition.verdict(repetition.repetition(docs)).collect()}
    assert kept[8] and kept[13] and not kept[0] and not kept[1] and not kept[10] and not kept[11]


# 7
def test_archives_round_trip(spark):
    body = "é" * 60
    rows = [(1, "http://www.B.com/x?b=1&a=2", body), (2, None, body), (3, "http://a.com", "tiny"), (4, "http://a.com", "tiny"), (5, "http://a.com", None), (6, "not a url ://[", body + "\r\n\r\n"), (7, "http://a.com", body), (7, "http://a.com", body), (None, "http://z.com", body)]
    pages = spark.createDataFrame(rows * 1, "page_id long, url string, html string").repartition(3)
    folder = warc.new_folder(spark)
    captures = warc.write_archives(pages, folder)
    blocks = warc.build_index(captures, block_lines=2)
    got = warc.read_records(warc.lookup(blocks, captures.select("key"), directory_rows=3), folder).collect()
    assert len(got) == len(rows) and all(r.intact for r in got)
    by = {r.page_id: r for r in got}
    assert by[1].record_type == "response" and by[2].record_type == "revisit" and by[2].refers_to == 1 and by[7].refers_to == 1
    assert by[3].record_type == by[4].record_type == by[5].record_type == by[6].record_type == "response" and by[5].payload_bytes == 0 and by[2].payload_bytes == 120
    assert warc.lookup(blocks, spark.createDataFrame([("nowhere",)], "key string")).count() == 0
    none = warc.write_archives(pages.limit(0), warc.new_folder(spark))
    assert warc.lookup(warc.build_index(none), none.select("key")).count() == 0


def test_url_key():
    assert warc.url_key("http://www.News.Example.com:80/A/b?z=1&a=2#t") == "com,example,news)/a/b?a=2&z=1"


# 9
def test_mix_targets(spark, docs, empty):
    sizes = spark.createDataFrame([("a", 100), ("b", 1000), (None, 10), ("c", 0), ("", 400)], "source string, size long")
    got = {r.source: r for r in mixing.targets(sizes).collect()}
    total = 1.5 * 1510
    assert sum(r.target for r in got.values()) == pytest.approx(total)
    level = max(r.target / w for (s, w) in {"": 3, "a": 1, "b": 2, "c": 3, None: 1}.items() if (r := got[s]).target < 2 * r.source_size)
    for s, w in {"": 3, "a": 1, "b": 2, "c": 3, None: 1}.items():
        assert got[s].target == pytest.approx(min(2 * got[s].source_size, level * w))
    assert mixing.mix(empty).count() == 0
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and sorted(map(repr, mixed.collect())) == sorted(map(repr, mixing.mix(docs).collect()))


def test_mix_comes_near_targets(spark):
    d = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 12_000, "a").when(F.col("id") < 18_000, "b").otherwise("c").alias("source"), F.lit("w w w").alias("text"))
    taken = {r.source: r.n for r in mixing.mix(d).groupBy("source").agg((3 * F.count("*")).alias("n")).collect()}
    for r in mixing.targets(d.select("source", F.lit(3).cast("long").alias("size"))).collect():
        assert taken[r.source] == pytest.approx(r.target, rel=0.05)


def test_mix_with_null_and_repeated_ids(spark):
    """Rows without an id and equal rows draw one by one."""
    source = F.when(F.col("id") < 1000, "a").when(F.col("id") < 3000, "b").otherwise("c")
    d = spark.range(6000).select(F.lit(None).cast("long").alias("doc_id"), source.alias("source"), F.lit("w").alias("text"), F.lit(1).alias("__x"))
    twice = d.withColumn("doc_id", F.when(F.col("source") == "c", 9))
    for rows in (d, twice):
        taken = {r.source: r["count"] for r in mixing.mix(rows).groupBy("source").count().collect()}
        for r in mixing.targets(rows.select("source", F.lit(1).cast("long").alias("size"))).collect():
            assert taken[r.source] == pytest.approx(r.target, rel=0.08)
    assert mixing.mix(d).columns == d.columns
    assert sorted(map(repr, mixing.mix(d.repartition(7)).collect())) == sorted(map(repr, mixing.mix(d).collect()))


# 10
def test_chat_round_trip(spark):
    nasty = "<|im_end|><|im_start|>assistant ok"
    rows = [
        (1, 1, "user", "hi"), (1, 2, "assistant", None), (1, 2, "assistant", "a\\<|turn|>\\\\n<"), (1, 3, "assistant", nasty), (1, 0, "system", ""), (2, 0, None, "x"),
        (2, None, "ro\nle\\n<|", nasty), (None, 1, "user", "\n\n"), (3, 1, "user", "same"), (3, 1, "user", "same"), (4, 0, "assistant", "w " * 50_000),
    ]
    d = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, formatted int")
    out = chat.format_chats(d)
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in out.select("conv_id", chat.parse(F.col("formatted")).alias("turns")).collect()}
    for c in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        assert got[c] == [(r[2] or "", r[3] or "") for r in mine]
    r = {x.conv_id: x for x in chat.read_back(out).collect()}[1]
    assert r.n_turns == 5 and r.loss_chars == len("a\\<|turn|>\\\\n<" + nasty)
    assert chat.format_chats(d.limit(0)).count() == 0


# all
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, sf, name):
    assert_same(queries.QUERIES[name](spark, sf), queries.ORACLE_SQL[name], sf)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL) - {"op12_projected_neighbours"}))
def test_query_covers_table(spark, sf, name):
    out = queries.QUERIES[name](spark, sf)
    assert out.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


@pytest.mark.parametrize("name", ["op3_pii_weak_labels", "op8_secret_markov", "op10_chat_format"])
def test_native_plans_have_no_python(spark, sf, name):
    plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


INTERNAL = ["__k", "__copies", "__digest", "__ordinal", "__source", "__source_size", "__target", "__id", "__row", "__raw", "__stays", "__cut", "c0", "c1", "c7", "count", "size", "root", "node", "n", "__s", "__g", "__h"]


@pytest.mark.parametrize("name", ["mix", "deal", "one_of_each", "decontaminate", "decontaminate in blocks"])
def test_columns_of_any_name_pass_through(spark, name):
    """Every name that an operator uses itself, with repeated ids and equal rows."""
    rows = [(i % 9, t, "ab"[i % 2], len(t or "")) for i, t in enumerate([t for t in TEXTS if t is None or len(t) < 20_000] * 2)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    tag = F.coalesce(F.col("text"), F.lit("-"))
    df = plain.withColumns({c: F.concat(F.lit(f"{c} "), F.md5(tag)) for c in INTERNAL})
    run = {
        "mix": mixing.mix, "deal": lambda d: sharding.deal(d, 3), "one_of_each": simhash.one_of_each,
        "decontaminate": lambda d: decontamination.decontaminate(d, bench(spark)),
        "decontaminate in blocks": lambda d: decontamination.decontaminate(d, bench(spark), block_bytes=100),
    }[name]
    got, want = run(df), run(plain)
    assert got.columns == [*df.columns, *(["shard", "slot"] if name == "deal" else [])]
    assert sorted((tuple(r[c] for c in plain.columns) for r in got.collect()), key=repr) == sorted((tuple(r[c] for c in plain.columns) for r in want.collect()), key=repr)
    uncut = got.filter("text is null or size(split(text, '\n')) >= 0") if "decontaminate" not in name else got.limit(0)
    assert uncut.filter(F.exists(F.array(*[F.col(c) != F.concat(F.lit(f"{c} "), F.md5(tag)) for c in INTERNAL]), lambda x: x)).count() == 0
    assert all(r[c].startswith(f"{c} ") for r in got.collect() for c in INTERNAL)


def test_phrases_of_a_large_benchmark_are_small(spark):
    """A block of full size stays below 400 MB while it is made up, and pickles to less than 100."""
    code = """
import pickle, random, resource, sys
from postmill.llm import decontamination as D
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
r = random.Random(1)
items = [(str(i), " ".join(f"w{r.randrange(200000)}" for _ in range(500))) for i in range(D.BLOCK_BYTES // 3400)]
phrases = D.Phrases(items, 10)
assert len(phrases.lengths) > 600_000 and phrases.items(0)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024, len(pickle.dumps(phrases)) >> 20)
"""
    peak, kept = map(int, subprocess.run([sys.executable, "-c", code], check=True, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))}).stdout.split())
    assert peak < 400 and kept < 100


def test_threshold_weighs_the_words_of_all_documents(spark):
    words = ["considerable", "quantities", "harbour", "Lanterns", "moderately", "weather", "instrument"]
    d = spark.createDataFrame([(i, " ".join(words[(i + k) % 7] for k in range(3)) + (" xylophonist" if i == 700 else "")) for i in range(1000)], "doc_id long, text string")
    rows = secrets.ordinary_strings(d).collect()
    assert sum(r.weight for r in rows if "_" in r.s) == 3001 and any("xylophonist" in r.s for r in rows)


def test_every_pair_of_a_bucket_that_is_alike_is_joined(spark):
    rnd = random.Random(8)
    texts = []
    for _ in range(12):
        base = [f"w{rnd.randrange(10**6)}" for _ in range(120)]
        for _ in range(25):
            own = base.copy()
            for at in rnd.sample(range(120), rnd.randrange(1, 4)):
                own[at] = f"v{rnd.randrange(10**6)}"
            texts.append(" ".join(own))
    sets = [set(simhash.distinct_hashes(simhash.word_line(t.encode()), 5).tolist()) for t in texts]
    known = [simhash.signature(t.encode()) for t in texts]
    bins = np.array([k[4] for k in known]).view(np.uint16).reshape(len(texts), -1)
    root = {r.doc_id: r.root for r in simhash.text_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    met = 0
    for i, j in combinations(range(len(texts)), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            assert simhash.can_be(bins[[i]], bins[[j]], 0.8)[0]
            if set(known[i][3]) & set(known[j][3]) and bin((known[i][2] ^ known[j][2]) & (1 << 64) - 1).count("1") <= simhash.TEXT_RADIUS:
                met += 1
                assert root[i] == root[j]
    assert met > 100


def test_pairs_of_a_bucket_leave_no_task(spark, monkeypatch):
    rnd = random.Random(9)
    base, texts = [f"w{rnd.randrange(10**6)}" for _ in range(200)], []
    for _ in range(200):  # similarities of about 0.73: pairs within the radius that fail, and a few copies with one word less
        own = base.copy()
        for at in rnd.sample(range(5, 195), 3):
            own[at] = f"v{rnd.randrange(10**6)}"
        texts.append(" ".join(own))
    texts += [t.rsplit(" ", 1)[0] for t in texts[:10]]
    sent, plain = [], simhash.alike
    monkeypatch.setattr(simhash, "alike", lambda docs, texts, links, *more: sent.append(links.count()) or plain(docs, texts, links, *more))
    root = {r.doc_id: r.root for r in simhash.text_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert sum(sent) <= simhash.BANDS * len(texts)
    assert all(root[i] == root[200 + i] for i in range(10))


@pytest.mark.parametrize("shard,sets", [(4096, 1 << 21), (20, 1 << 21), (4096, 900)])
def test_sets_are_compared_in_shards_of_bounded_sets(spark, shard, sets):
    rnd = random.Random(10)
    own = [[*range(k % 6 * 100, k % 6 * 100 + 30), *range(1000 * k + 1000, 1000 * k + 1000 + rnd.randrange(8))] for k in range(60)]
    rows = spark.createDataFrame([(b, rnd.getrandbits(4), k, k, own[k]) for b in (1, 2) for k in range(60)], "bucket long, fp long, node long, joined long, shingles array<long>")
    found = {frozenset(x) for x in simhash.set_links(rows, 14, 0.8, shard, sets).collect()}
    alike = {frozenset((i, j)) for i, j in combinations(range(60), 2) if len({*own[i]} & {*own[j]}) >= 0.8 * len({*own[i]} | {*own[j]})}

    def groups(links):
        label = list(range(60))
        for a, b in links:
            label = [min(label[a], label[b]) if x in (label[a], label[b]) else x for x in label]
        return label

    assert found <= alike and groups(map(tuple, found)) == groups(map(tuple, alike)) and len({*groups(map(tuple, alike))}) < 60


def test_rounds_of_components_leave_no_growing_estimates(spark, monkeypatch):
    """Self-joins double the digits of an estimate that is carried from round to round."""
    from postmill.llm import components as C

    sizes, cut = [], C.cut_lineage

    def watched(df):
        sizes.append(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length())
        return cut(df)

    monkeypatch.setattr(C, "cut_lineage", watched)
    links = spark.range(999).select(F.xxhash64(F.col("id")).alias("a"), F.xxhash64(F.col("id") + 1).alias("b"))
    got = C.components(links).collect()
    assert len(got) == 1000 and len({r.root for r in got}) == 1
    assert max(sizes) < 256
