"""Column expressions over posting texts."""

from __future__ import annotations

import json
import re
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions import constants as K


def blank_free(c: Column) -> Column:
    """Null for blank text."""
    return F.nullif(F.trim(c), F.lit(""))


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def let(c: Column, what) -> Column:
    """``what(c)`` with c worked out once, however often it is used."""
    return F.get(F.transform(F.array(c), what), F.lit(0))


def _over(c: Column, words, what) -> Column:
    """``what(list of words, text)`` with the text worked out once; the code stays small however many words there are."""
    listed = F.array(*[F.lit(w) for w in words])
    return F.get(F.transform(F.array(c), lambda s: what(listed, s)), F.lit(0))


def any_in(c: Column, words) -> Column:
    """True if the text holds any of the words."""
    words = list(words)
    if len(words) > 2:
        return _over(c, words, lambda listed, s: F.exists(listed, lambda w: F.contains(s, w)))
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def which_in(c: Column, words) -> Column:
    """The words that the text holds, in list order."""
    return _over(c, words, lambda listed, s: F.filter(listed, lambda w: F.contains(s, w)))


def first_label(c: Column, pairs) -> Column:
    """Label of the first token that the text holds, or ''."""
    out = None
    for token, label in pairs:
        cond = F.contains(c, F.lit(token))
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(""))


def mapped(c: Column, table: dict, default: Column) -> Column:
    """The table's value for c, else the default."""
    literal = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(literal, c), default)


def norm_title(title: Column) -> Column:
    clean = squeeze(F.regexp_replace(F.lower(text(title)), r"[()\[\],./]+", " "))
    return F.array_join(F.transform(F.split(clean, " "), lambda t: mapped(t, K.TITLE_ALIASES, t)), " ")


def norm_location(location: Column) -> Column:
    s = squeeze(F.lower(text(location)))
    cut = s
    for suffix in K.COUNTRY_SUFFIXES:
        cut = F.regexp_replace(cut, re.escape(suffix) + "$", "")
    return F.when(F.contains(s, F.lit("remote")), F.lit("remote")).otherwise(F.trim(cut))


def dedupe_key(company: Column, title: Column, location: Column) -> Column:
    return F.concat_ws("||", F.lower(F.trim(text(company))), norm_title(title), norm_location(location))


def job_key(title: Column, company: Column) -> Column:
    return F.concat(F.lower(F.trim(text(title))), F.lit("||"), F.lower(F.trim(text(company))))


def completeness() -> Column:
    """How much a posting says: description, technologies, seniority, remote, date, salary."""
    known = lambda c: F.when(F.coalesce(F.col(c), F.lit("unknown")).isin("unknown", ""), 0).otherwise(1)
    return (
        F.floor(F.char_length(text(F.col("description"))) / 200)
        + F.coalesce(F.size("technologies"), F.lit(0))
        + 2 * known("seniority") + known("remote")
        + F.when(F.col("posted_date").isNotNull(), 1).otherwise(0)
        + F.when((F.coalesce(F.col("salary_min"), F.lit(0)) != 0) | (F.coalesce(F.col("salary_max"), F.lit(0)) != 0), 3).otherwise(0)
    ).cast("long")


def norm_url(url: Column) -> Column:
    """Lower-cased, without fragment, tracking and blank parameters, default ports and trailing slashes; parameters sorted."""
    dropped = "^(?:" + "|".join(map(re.escape, K.TRACKING_PARAMS)) + ")"

    def parts(m: Column) -> Column:  # scheme, host, path, query
        kept = let(m[3], lambda q: F.when(q == "", F.expr("cast(array() as array<string>)")).otherwise(
            F.array_sort(F.filter(F.split(q, "&"), lambda p: p.rlike("^[^=]*=.") & ~p.rlike(dropped)))))
        query = let(kept, lambda k: F.when(F.size(k) > 0, F.concat(F.lit("?"), F.array_join(k, "&"))).otherwise(""))
        path = let(F.regexp_replace(m[2], "/+$", ""), lambda p: F.when(p == "", "/").otherwise(p))
        return F.concat(F.when(m[0] == "", "https").otherwise(m[0]), F.lit("://"), F.regexp_replace(m[1], r":(?:80|443)$", ""), path, query)

    def whole(s: Column) -> Column:
        pattern = r"^(?:([a-z][a-z0-9+.-]*)://)?([^/?#]*)([^?#]*)(?:\?([^#]*))?"
        groups = F.array(*[F.regexp_extract(s, pattern, i) for i in (1, 2, 3, 4)])
        return F.when(s == "", F.lit("")).otherwise(let(groups, parts))

    return let(F.lower(F.trim(text(url))), whole)


def title_tokens(title: Column) -> Column:
    tokens = F.regexp_extract_all(F.lower(text(title)), F.lit("[a-z0-9+#.]+"), F.lit(0))
    return F.array_distinct(F.filter(tokens, lambda t: (F.char_length(t) >= 2) & ~t.isin(*K.TITLE_STOP_WORDS)))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / both).otherwise(F.lit(0.0))


def text_key(c: Column, n: int = 16) -> Column:
    return F.substring(F.sha1(text(c).cast("binary")), 1, n)


def blocked_hit(title: Column, keywords) -> Column:
    """The first keyword in list order that stands as a whole word, or null."""
    t = F.lower(text(title))
    words = [k.strip().lower() for k in keywords if k.strip()]
    return F.coalesce(*[F.when(t.rlike(r"(?<![a-z])" + re.escape(k) + r"(?![a-z])"), F.lit(k)) for k in words], F.lit(None).cast("string"))


def collapse_ws(c: Column) -> Column:
    s = F.regexp_replace(text(c), "\r\n?", "\n")
    s = F.regexp_replace(s, "[ \t ]+", " ")
    s = F.regexp_replace(s, " +(?=\n|$)", "")
    return F.regexp_replace(F.regexp_replace(s, "\n{3,}", "\n\n"), r"^\s+|\s+$", "")


TRACKING_CODE = r"^[A-Z]{2,5}[-_]?[0-9]{2,}[A-Z0-9_-]{0,10}$"


def drop_tracking_codes(c: Column) -> Column:
    return F.array_join(F.filter(F.split(text(c), "\n"), lambda line: ~F.trim(line).rlike(TRACKING_CODE)), "\n")


#: Every named character of HTML 5 with its semicolon, from Python's own table.
ENTITIES = {k[:-1]: v for k, v in html5.items() if k.endswith(";")}


def unescape(c: Column) -> Column:
    """Named and numeric character references decoded; unknown ones stay. Texts without "&" are left alone."""
    names = F.from_json(F.lit(json.dumps(ENTITIES)), "map<string,string>")  # folded to a constant

    def sign(e: Column) -> Column:
        code = F.when(e.rlike("^#[xX]"), F.conv(F.substring(e, 3, 8), 16, 10)).when(F.startswith(e, F.lit("#")), F.substring(e, 2, 8)).try_cast("int")
        number = F.when(code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        return F.coalesce(number, F.try_element_at(names, e), F.concat(F.lit("&"), e, F.lit(";")))

    reference = r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"

    def spread(s: Column) -> Column:
        found = F.regexp_extract_all(s, F.lit(reference), F.lit(1))
        pieces = F.zip_with(F.split(s, reference, -1), found, lambda gap, e: F.concat(gap, F.when(e.isNotNull(), sign(e)).otherwise("")))
        return F.array_join(pieces, "")

    return F.when(F.contains(c, F.lit("&")), let(c, spread)).otherwise(c)


def clean_field(c: Column) -> Column:
    """Entities decoded, tags dropped, trimmed; blank is null."""
    return F.nullif(F.regexp_replace(F.regexp_replace(unescape(c), "<[^>]+>", ""), r"^\s+|\s+$", ""), F.lit(""))


def is_tracking_code(c: Column) -> Column:
    return F.coalesce(F.trim(c).rlike(TRACKING_CODE), F.lit(False))


def first_of_each(items: Column, key) -> Column:
    """The items without later ones of an equal key, in their order."""
    keys = lambda own: F.transform(own, key)
    return let(items, lambda own: let(keys(own), lambda k: F.filter(own, lambda x, i: F.array_position(k, key(x)) == i + 1)))


def sanitise_posting(df: DataFrame) -> DataFrame:
    """Postings with cleaned texts: blank fields are null, a title or company that is a tracking code is null, the short
    fields are in lower case, and technologies stand once each (whatever their case, the first form stays)."""
    out = df.withColumns({c: clean_field(F.col(c)) for c in ("title", "company", "location", "salary_text", "description", "url") if c in df.columns})
    out = out.withColumns({c: F.when(~is_tracking_code(F.col(c)), F.col(c)) for c in ("title", "company")})
    out = out.withColumns({c: F.nullif(F.lower(F.trim(c)), F.lit("")) for c in ("seniority", "job_type", "remote") if c in df.columns})
    if "technologies" not in df.columns:
        return out
    cleaned = F.filter(F.transform("technologies", clean_field), lambda t: t.isNotNull())
    return out.withColumn("technologies", first_of_each(cleaned, lambda t: F.lower(t)))


def posting_summary() -> Column:
    """One line that tells of a match: title, score, place, pay, technologies and the beginning of its description."""
    c = F.col
    name = lambda x: F.coalesce(c(x), F.lit("?"))
    some = lambda x: F.nullif(text(c(x)), F.lit(""))
    techs = F.when(F.size("technologies") > 0, F.concat(F.lit("tech: "), F.array_join(F.slice("technologies", 1, 6), ", ")))
    body = F.nullif(F.substring(F.regexp_replace(F.trim(text(c("description"))), "\n", " "), 1, 200), F.lit(""))
    score = F.concat(F.lit("score="), F.round(F.coalesce("match_score", F.lit(0.0)) * 100).cast("int").cast("string"), F.lit("%"))
    pay = F.when(some("salary_text").isNotNull(), F.concat(F.lit("pay: "), some("salary_text")))
    return F.concat_ws(" | ", F.concat(name("title"), F.lit(" @ "), name("company")), score, some("location"), some("remote"), pay, techs, body)


def gap_summary() -> Column:
    """One line that tells of a fit report (title, company, matched_skills, gaps of skill and severity)."""
    name = lambda x: F.coalesce(F.col(x), F.lit("?"))
    matched = F.array_join(F.slice(F.coalesce("matched_skills", F.expr("cast(array() as array<string>)")), 1, 6), ", ")
    gaps = F.coalesce(F.array_join(F.transform(F.slice("gaps", 1, 4), lambda g: text(g["skill"])), ", "), F.lit(""))
    return F.concat(name("title"), F.lit(" @ "), name("company"), F.lit(" | matched: "), matched, F.lit(" | gaps: "), gaps)


def redact_paths(c: Column) -> Column:
    return F.regexp_replace(c, r"(?:/home/|/Users/)[^/\s]+", "~")


def row_key(url: Column, company: Column, title: Column, location: Column) -> Column:
    return F.coalesce(F.nullif(text(url), F.lit("")), F.concat_ws("::", text(company), text(title), text(location)))


def posting_text(most: int | None = 1500) -> Column:
    """The lines that stand for a posting: one "name: value" a line; ``most`` characters of the description, or all (None)."""
    part = lambda name, value: F.when(text(F.col(name)) != "", F.concat(F.lit(f"{name}: "), value))
    body = F.col("description") if most is None else F.substring("description", 1, most)
    lines = [part(name, body if name == "description" else F.col(name)) for name in ("title", "company", "location", "description", "seniority", "remote")]
    return F.concat_ws("\n", *lines, F.when(F.size("technologies") > 0, F.concat(F.lit("technologies: "), F.array_join("technologies", ", "))))


def archetype_of_title(title: Column) -> Column:
    t, out = F.trim(text(title)), None
    for pattern, slug in K.ARCHETYPES:
        cond = t.rlike(rf"(?i)\b(?:{pattern})\b")
        out = F.when(F.char_length(t) < 3, F.lit("unclassified")) if out is None else out
        out = out.when(cond, F.lit(slug))
    return out.otherwise(F.lit("unclassified"))


def archetype_confidence(title: Column) -> Column:
    """0.85 where a pattern names the archetype, else 0."""
    return F.when(archetype_of_title(title) == "unclassified", 0.0).otherwise(0.85)


def lane_tokens(title: Column) -> Column:
    """Title words that tell the lane: no seniority or role boilerplate, no generic words."""
    cleaned = F.regexp_replace(F.lower(text(title)), K.LANE_BOILERPLATE, " ")
    words = F.transform(F.split(cleaned, r"[,/|\-–—\s]+"), lambda w: F.regexp_replace(w, r"^[.,()]+|[.,()]+$", ""))
    return F.array_distinct(F.filter(words, lambda w: (F.char_length(w) >= 3) & ~w.isin(*K.GENERIC_LANE_WORDS)))


def flat_html(c: Column) -> Column:
    """Text of HTML with a space for each tag, entities decoded."""
    return F.trim(unescape(F.regexp_replace(text(c), "<[^>]+>", " ")))


def shorten(c: Column, most: int) -> Column:
    """At most ``most`` characters: the last word that does not fit goes for an ellipsis."""
    cut = F.concat(F.regexp_replace(F.substring(c, 1, most - 1), " [^ ]*$", ""), F.lit("…"))
    return F.when(F.char_length(c) > most, cut).otherwise(c)


def _places(c: Column, words) -> Column:
    """Where each word first stands in the text, from 1; 0 if nowhere."""
    return _over(F.lower(c), words, lambda listed, s: F.transform(listed, lambda w: F.position(w, s)))


def role_slice(description: Column, most: int) -> Column:
    """From the first heading that tells of the role (else the first paragraph) to the first boilerplate heading."""

    def begin(s: Column) -> Column:
        first = F.array_min(F.filter(_places(s, K.KEEP_HEADINGS), lambda i: i > 0))
        paragraph = F.get(F.filter(F.transform(F.split(s, "\n{2,}"), lambda p: F.trim(p)), lambda p: p != ""), F.lit(0))
        return let(first, lambda at: F.when(at.isNotNull(), F.substring(s, at, F.char_length(s))).otherwise(F.coalesce(paragraph, F.lit(""))))

    def end(s: Column) -> Column:
        first = F.get(F.filter(_places(s, K.BOILERPLATE_HEADINGS), lambda i: i > 81), F.lit(0))
        return let(first, lambda at: F.when(at.isNotNull(), F.substring(s, F.lit(1), at - 1)).otherwise(s))

    body = let(let(flat_html(description), begin), end)
    return let(squeeze(body), lambda s: shorten(s, most))


def signature(most: int = 600) -> Column:
    """One line that stands for a posting: title, company, what is known of it, stack and role."""
    c = F.col
    some = lambda name: F.nullif(F.trim(text(c(name))), F.lit(""))
    known = lambda name: F.when(F.lower(some(name)) != "unknown", some(name))
    meta = F.concat_ws("; ", known("seniority"), known("remote"), some("location"))
    stack = F.array_join(F.filter(F.transform(F.slice("technologies", 1, 12), lambda t: F.trim(t)), lambda t: t != ""), ", ")
    parts = [
        some("title"), F.concat(F.lit("@ "), some("company")), let(meta, lambda m: F.when(m != "", F.concat(F.lit("("), m, F.lit(")")))),
        let(stack, lambda s: F.when(s != "", F.concat(F.lit("Stack: "), s))), let(role_slice(c("description"), max(120, most - 180)), lambda s: F.when(s != "", s)),
    ]
    return let(squeeze(F.concat_ws(" | ", *parts)), lambda s: shorten(s, most))
