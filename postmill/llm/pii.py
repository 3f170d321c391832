"""Operator 3: personal data by aggregating weak labels. Spark expressions only, and one pass over the texts.

Candidates are the base spans (email, ip, card, phone) and looser ones of the same kinds: emails with the signs
spelled out, IPv6 addresses, cards of 13 to 15 digits that pass Luhn or grouped by dots, phone numbers without a country
code or with a written prefix. Five labelers vote 1, 0 or -1 (no vote) on each: the written form, a gazetteer (top-level
domains, reserved address blocks, issuer ranges, calling and area codes), cue words just before, counter-cues just before,
and a look at the digits. Expectation-maximisation (Dawid and Skene) over the counts of each (kind, votes) of the loose
candidates estimates how reliable the labelers are and how likely each pattern of votes is personal data. Base spans are known
to be: they tell what the labelers say of personal data, but for its written form, in which the groups differ by
definition; all of a kind together weigh as much as ``PSEUDO`` spans, so their number can't outvote what is loose. With the
soft labels a naive Bayes classifier over the features of a kind's loose spans (shape, length, gazetteer, cues) is counted up
by one aggregation and scores every loose candidate; base spans always stay.

What reaches the driver are counts: of at most 4 * 3^5 vote patterns and of the feature values, which are bounded
too. Candidates go through one checkpoint, without the texts.

Nulls: a null text is empty; ids may be null or repeat, each row stands for itself; equal rows get equal results. Other
columns, whatever their names, are not read. Very long texts and texts of very many spans take time in proportion. Empty
tables give empty results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.common import cut_lineage
from postmill.llm.spans import apart, count_of, joined, let, matches, placed

KINDS = ["email", "ip", "card", "phone"]
KEEP_AT = 0.5

# The base patterns, written so that Java neither recurses nor tries a start inside a run again.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9]){15,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?: ?[\[(]at[\])] ?| at )[A-Za-z0-9-]{1,63}(?:(?: ?[\[(]dot[\])] ?| dot |\.)[A-Za-z0-9-]{1,63}){1,8}",
    "ip": r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])|(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9.-])(?:3[0-9]{3}[ -]?[0-9]{6}[ -]?[0-9]{4,5}|4[0-9]{12}|[2-6][0-9]{3}(?:\.[0-9]{4}){3})(?![0-9.-])",
    "phone": r"(?<![0-9+().:/-])(?:\(0?[1-9][0-9]{1,3}\)|00[1-9][0-9]{0,2}|0[1-9][0-9]{1,3}|[2-9][0-9]{2})[ ./-]{0,2}[0-9]{3,4}[ .-][0-9]{2,4}(?:[ .-][0-9]{2,4}){0,3}(?![0-9.:/-])",
}
CUES = {
    "email": r"(?:e-?mail|contact|write to|reach|send|correo|courriel|kontakt)[^a-z0-9]*(?:me|us|is|at|to)?[^a-z0-9]*$",
    "ip": r"(?:\bip|ipv6|host|address|server|client|from|login)[^a-z0-9]*(?:is|at|v6)?[^a-z0-9]*$",
    "card": r"(?:card|visa|amex|american express|mastercard|credit|payment|charge|tarjeta|carte|karte)[^a-z0-9]*(?:no|number|to|is)?[^a-z0-9]*$",
    "phone": r"(?:phone|tel|mobile|call|cell|fax|whatsapp|ring|text|tél|telefon|tel[eé]fono)[^a-z0-9]*(?:me|us|at|no|number|is|on)?[^a-z0-9]*(?:at|on)?[^a-z0-9]*$",
}
COUNTER = r"(?:version|release|section|chapter|isbn|order|invoice|part|model|serial|page|figure|ratio|sum|total|item|ticket|\bv|mac|hash|meet|met|look|build)[^a-z0-9]*(?:no|number|is|him|her|them)?[^a-z0-9]*$"

# Public registries. Top-level domains in use, reserved IPv4 blocks (RFC 6890), card issuer ranges (ISO 7812),
# calling codes (E.164).
DOMAINS = (
    "com", "org", "net", "edu", "gov", "mil", "int", "io", "co", "ai", "app", "dev", "info", "biz", "me", "tv", "xyz", "online", "site", "name",
    "de", "fr", "es", "uk", "eu", "ch", "at", "it", "nl", "be", "lu", "ie", "pt", "pl", "cz", "sk", "hu", "ro", "bg", "gr", "se", "no", "dk", "fi", "is",
    "ca", "us", "mx", "br", "ar", "cl", "pe", "ve", "jp", "cn", "kr", "tw", "hk", "sg", "in", "pk", "id", "my", "th", "vn", "ph", "au", "nz", "za", "ng",
    "ke", "eg", "ma", "il", "ae", "sa", "tr", "ru", "ua", "by",
)
RESERVED_IPV4 = (
    r"0+\.", r"0*10\.", r"0*127\.", r"169\.254\.", r"172\.0*(?:1[6-9]|2[0-9]|3[01])\.", r"192\.168\.", r"192\.0+\.0*[02]\.", r"198\.0*1[89]\.",
    r"198\.0*51\.100\.", r"203\.0+\.113\.", r"100\.0*(?:6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.", r"2[2-5][0-9]\.",
)
RESERVED_IPV6 = (r"::1?$", r"(?i)fe[89ab][0-9a-f]:", r"(?i)f[cd][0-9a-f]{2}:", r"(?i)2001:0?db8:", r"(?i)ff[0-9a-f]{2}:")
ISSUERS = (r"4", r"5[1-5]", r"2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)", r"3[47]", r"3(?:0[0-5]|[689])", r"35(?:2[89]|[3-8])", r"6(?:011|4[4-9]|5)", r"62")
CALLING = (
    r"1[2-9]", r"7", r"2[07]", r"2[1-689][0-9]", r"3[0-469]", r"3[578][0-9]", r"4[013-9]", r"42[0-9]", r"5[1-8]", r"5[09][0-9]", r"6[0-6]", r"6[789][0-9]",
    r"8[1246]", r"8[58][0-9]", r"9[0-58]", r"9[679][0-9]",
)
LABELERS = 5


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """True for strings of digits that pass the Luhn check."""
    back = F.reverse(number)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(number)), F.lit(0), add) % 10 == 0


def _octets(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^(?:|[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


VALID = {
    "email": lambda m: F.lit(True),
    "ip": _octets,
    "card": lambda m: F.char_length(digits(m)).between(16, 19) & luhn(digits(m)),
    "phone": lambda m: F.char_length(digits(m)).between(8, 15),
}
VALID_LOOSE = {"email": lambda m: F.lit(True), "ip": lambda m: F.lit(True), "card": lambda m: luhn(digits(m)), "phone": lambda m: F.char_length(digits(m)).between(8, 15)}


def _by_kind(kind: Column, values: dict[str, Column]) -> Column:
    out = F.when(kind == 0, values["email"])
    for i, name in enumerate(KINDS[1:], 1):
        out = out.when(kind == i, values[name])
    return out


def _one_of(patterns: tuple[str, ...]) -> str:
    return "^(?:" + "|".join(patterns) + ")"


def gazetteer(kind: Column, m: Column, d: Column) -> Column:
    """1 or 0 by the registries."""
    national = d.rlike("^(?:00)?0?[1-9]") & F.char_length(d).between(7, 15)
    return _by_kind(kind, {
        "email": F.when(m.rlike(r"(?i)(?:[.\])]|\bdot) ?(?:" + "|".join(DOMAINS) + ")$"), 1).otherwise(0),
        "ip": F.when(m.rlike(_one_of(RESERVED_IPV4 + RESERVED_IPV6)), 0).when(m.contains(":") & ~m.rlike("^[23]"), 0).otherwise(1),
        "card": F.when(d.rlike(_one_of(ISSUERS)), 1).otherwise(0),
        "phone": F.when(m.startswith("+"), F.when(d.rlike(_one_of(CALLING)), 1).otherwise(0)).when(national & ~d.rlike("^[2-9](?:11|00)"), 1).otherwise(0),
    })


def written(kind: Column, m: Column, d: Column) -> Column:
    """Whether a span is written as people write such data: 1, 0 or -1."""
    return _by_kind(kind, {
        "email": F.when(m.contains("@") | m.rlike(r"[\[(]"), 1).otherwise(-1),
        "ip": F.when(m.contains("::") | (F.char_length(F.regexp_replace(m, "[^:.]", "")) == 7) | ~m.contains(":"), 1).otherwise(0),
        "card": F.when(m.rlike("[ .-].*[ .-]"), 1).otherwise(-1),
        "phone": F.when(m.rlike(r"^(?:\+|\(|00)"), 1).otherwise(-1),
    })


def evidence(span: Column) -> Column:
    """What labelers and features look at, each worked out once: digits, gazetteer, cue and counter-cue (0 or 1)."""
    def look(d: Column) -> Column:
        flag = lambda c: F.when(c, 1).otherwise(0)
        cue = _by_kind(span["kind"], {k: span["before"].rlike(p) for k, p in CUES.items()})
        return F.struct(d.alias("digits"), gazetteer(span["kind"], span["match"], d).alias("registry"), flag(cue).alias("cue"), flag(span["before"].rlike(COUNTER)).alias("counter"))

    return let(digits(span["match"]), look)


def votes(span: Column, seen: Column) -> Column:
    """The labelers' votes on a span, as an array of ints: written form, gazetteer, cue, counter-cue, digits."""
    d = seen["digits"]
    plain = F.when((F.char_length(d) > 6) & d.rlike(r"^(.)\1+$"), 0).otherwise(-1)
    out = (written(span["kind"], span["match"], d), seen["registry"], F.when(seen["cue"] == 1, 1).otherwise(-1), F.when(seen["counter"] == 1, 0).otherwise(-1), plain)
    return F.array(*(x.cast("int") for x in out))


def features(span: Column, seen: Column) -> Column:
    """Discrete features of a span, as an array of short strings. Shape and length say little apart from the registries' verdict."""
    shape = F.substring(F.regexp_replace(F.regexp_replace(F.regexp_replace(span["match"], "[0-9]+", "0"), "[a-z]+", "a"), "[A-Z]+", "A"), 1, 12)
    before, known = span["before"], F.concat(seen["registry"].cast("string"), F.lit(" "))
    return F.array(
        F.concat(F.lit("shape "), known, F.pmod(F.xxhash64(shape), F.lit(64)).cast("string")),
        F.concat(F.lit("length "), known, F.least(F.lit(8), (F.char_length(span["match"]) / 6).cast("int")).cast("string")),
        F.concat(F.lit("cue "), seen["cue"].cast("string")), F.concat(F.lit("counter "), seen["counter"].cast("string")),
        F.concat(F.lit("before "), F.when(before.rlike("[a-z0-9]$"), "word").when(before.rlike(r"\s$"), "space").when(F.char_length(before) == 0, "start").otherwise("sign")),
    )


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base (spans) and loose (spans apart from the base ones) of every row, each span with votes, loose ones with features."""
    t = F.col("text")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    gates = {"email": t.contains("@"), "ip": None, "card": None, "phone": t.contains("+")}
    loose_gates = {"email": t.contains("at]") | t.contains("at)") | t.contains(" dot "), "ip": t.rlike("[0-9A-Fa-f]:[0-9A-Fa-f:]"), "card": t.rlike("[2-6][0-9]{3}[ .-]?[0-9]{4}"), "phone": t.rlike("[0-9]{3}[ .-][0-9]{2}")}
    rows = rows.withColumns({f"b_{k}": matches(t, BASE[k], gates[k]) for k in KINDS} | {f"l_{k}": matches(t, LOOSE[k], loose_gates[k]) for k in KINDS})
    base = [placed(t, F.col(f"b_{k}"), BASE[k], i, VALID[k]).alias(f"base_{k}") for i, k in enumerate(KINDS)]
    loose = F.concat(*(placed(t, F.col(f"l_{k}"), LOOSE[k], i, VALID_LOOSE[k]) for i, k in enumerate(KINDS)))
    own = [F.col(f"base_{k}") for k in KINDS]
    rows = rows.select("doc_id", *base, loose.alias("loose"))
    rows = rows.select("doc_id", F.concat(*own).alias("base"), apart(F.col("loose"), own).alias("loose"))

    def told(more):
        return lambda s: let(evidence(s), lambda seen: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), votes(s, seen).alias("votes"), *more(s, seen)))

    loose = F.transform("loose", told(lambda s, seen: [features(s, seen).alias("features")]))
    return rows.select("doc_id", F.transform("base", told(lambda s, seen: [])).alias("base"), loose.alias("loose"))


#: Beliefs to start from, for each labeler: how often it votes 1, 0 and not at all on personal data, and on other spans.
START = [
    ((0.50, 0.05, 0.45), (0.20, 0.30, 0.50)),  # written form
    None,  # gazetteer: see PASS
    ((0.50, 0.01, 0.49), (0.05, 0.01, 0.94)),  # cue
    ((0.01, 0.03, 0.96), (0.01, 0.50, 0.49)),  # counter-cue
    ((0.01, 0.01, 0.98), (0.01, 0.10, 0.89)),  # digits
]
PRIOR = 0.5
REGISTRY = 1
#: How much of what looks like an email, ip, card or phone number and is none still passes the registries.
PASS = (0.20, 0.20, 0.30, 0.80)
PSEUDO = 10.0


def start_rates(kind: int, labeler: int) -> tuple[dict[int, float], dict[int, float]]:
    """What is believed of a labeler at first: how often it votes 1, 0 and not at all on personal data, and on other spans."""
    both = ((0.97, 0.01, 0.02), (PASS[kind], 0.98 - PASS[kind], 0.02)) if labeler == REGISTRY else START[labeler]
    return tuple(dict(zip((1, 0, -1), side, strict=True)) for side in both)


def reliabilities(counts: list[tuple[int, tuple[int, ...], int]], rounds: int = 30, known: list[tuple[int, tuple[int, ...], int]] = ()) -> tuple[dict[int, float], dict, dict]:
    """EM over counts of (kind, votes): share of personal data by kind, how often each labeler of a kind votes 1, 0 or
    not at all on personal data and on other spans, and the probability of each (kind, votes).

    Not voting is an outcome like the others, so that labelers that only ever vote one way still tell something.
    ``PSEUDO`` counts in the proportions of ``START`` keep all rates inside (0, 1) and tell which class is which; the
    rates of the registries, which are facts about the kinds and not about the corpus, stay as they are. ``known`` are
    counts of what is personal data for certain: they add to the rates of all labelers but the written form, and as many as
    there may be of a kind weigh ``PSEUDO`` at most.
    """
    prior = {k: PRIOR for k, _, _ in counts}
    begin = {(k, j): start_rates(k, j) for k in prior for j in range(LABELERS)}
    rate = dict(begin)
    sure = {k: sum(n for own, _, n in known if own == k) for k in prior}
    weight = {k: min(1.0, PSEUDO / n) if n else 0.0 for k, n in sure.items()}
    post: dict = {}
    for _ in range(rounds):
        for kind, v, _ in counts:
            odds = math.log(prior[kind] / (1 - prior[kind]))
            odds += sum(math.log(rate[kind, j][0][x] / rate[kind, j][1][x]) for j, x in enumerate(v))
            post[kind, v] = 1 / (1 + math.exp(min(50.0, max(-50.0, -odds))))
        for kind in prior:
            own = [(v, post[k, v] * n, (1 - post[k, v]) * n) for k, v, n in counts if k == kind]
            totals = [sum(x[c] for x in own) for c in (1, 2)]
            prior[kind] = (PRIOR * PSEUDO + totals[0]) / (PSEUDO + sum(totals))
            for j in range(LABELERS):
                anchors = [(v, weight[kind] * n, 0.0) for k, v, n in known if k == kind and j]
                if j == REGISTRY:
                    continue
                seen, mass = own + anchors, [totals[0] + sum(a[1] for a in anchors), totals[1]]
                rate[kind, j] = tuple(
                    {x: (PSEUDO * begin[kind, j][c][x] + sum(o[c + 1] for o in seen if o[0][j] == x)) / (PSEUDO + mass[c]) for x in (1, 0, -1)} for c in (0, 1)
                )
    return prior, rate, post


def classifier(cands: DataFrame) -> tuple[dict[str, float], dict[int, float]]:
    """Log odds of each feature value of a kind, and of personal data of each kind, from soft labels; see the module's text.

    In either class a feature's rate is drawn to its rate in the kind as a whole, by the weight of ``PSEUDO`` spans, so a
    class of few spans tells little instead of everything.
    """
    spans = lambda c: cands.select(F.explode(c).alias("s")).select("s.*")
    counted = lambda c: sorted((r["kind"], tuple(r["votes"]), r["count"]) for r in spans(c).groupBy("kind", "votes").count().collect())
    counts = counted("loose")
    if not counts:
        return {}, {}
    _, _, post = reliabilities(counts, known=counted("base"))
    # Joint counts of votes and feature values: both are bounded.
    joint = spans("loose").select("kind", "votes", F.explode("features").alias("f")).groupBy("kind", "votes", "f").count().collect()
    sides: dict = {}
    for r in joint:
        p, side = post[r["kind"], tuple(r["votes"])], sides.setdefault((r["kind"], r["f"]), [0.0, 0.0])
        side[0] += p * r["count"]
        side[1] += (1 - p) * r["count"]
    total = {k: [sum(abs(c - post[x, v]) * n for x, v, n in counts if x == k) for c in (0, 1)] for k in {k for k, _, _ in counts}}
    weight = {}
    for (kind, f), side in sorted(sides.items()):
        share = sum(side) / sum(total[kind])
        yes, no = ((n + PSEUDO * share) / (all_n + PSEUDO) for n, all_n in zip(side, total[kind], strict=True))
        weight[f"{kind} {f}"] = math.log(yes / no)
    return weight, {k: math.log((yes + 1) / (no + 1)) for k, (yes, no) in total.items()}


def find_personal(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """doc_id, base and added: arrays of spans (kind, start, end); ``added`` are the loose ones that the classifier keeps."""
    cands = cut_lineage(candidates(docs, doc_id, text))
    weight, bias = classifier(cands)
    least = math.log(keep_at / (1 - keep_at))
    if weight:
        table = F.create_map(*(F.lit(x) for f in weight.items() for x in f))
        begin = lambda s: F.element_at(F.array(*[F.lit(bias.get(i, 0.0)) for i in range(len(KINDS))]), s["kind"] + 1)
        own = lambda s, f: F.element_at(table, F.concat_ws(" ", s["kind"].cast("string"), f))
        score = lambda s: F.aggregate(s["features"], begin(s), lambda a, f: a + F.coalesce(own(s, f), F.lit(0.0)))
        added = F.filter("loose", lambda s: score(s) >= least)
    else:
        added = F.col("loose")
    span = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    return cands.select("doc_id", F.transform("base", span).alias("base"), F.transform(added, span).alias("added"))


def op3_pii_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        "doc_id", *(count_of(F.col("base"), i).alias(f"n_{k}") for i, k in enumerate(KINDS)),
        F.sha2(joined(F.col("base"), KINDS, True).cast("binary"), 256).alias("base_sha256"),
        joined(F.concat("base", "added"), KINDS, True).alias("spans"), (F.size("base") + F.size("added")).cast("long").alias("n_spans"),
    )
