"""Profile rows: clean fields, target roles, patches, and a profile from plain text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions import constants as K
from postmill.functions.text import any_in, first_label, lane_tokens, mapped, text

LISTS = ("skills", "technologies", "domains", "certifications", "target_roles")
EDITABLE = ("summary", "headline", "seniority", "years_experience", "target_roles", "technologies", "domains", "skills")


def no_words() -> Column:
    return F.array().cast("array<string>")


def clean_list(c: Column) -> Column:
    """Trimmed entries without blank ones; a null list is empty."""
    return F.coalesce(F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x != ""), no_words())


def split_list(c: Column) -> Column:
    """Entries of a text with commas, semicolons or line ends between them."""
    return clean_list(F.split(text(c), "[,\n;]"))


def valid_seniority(c: Column) -> Column:
    s = F.lower(F.trim(text(c)))
    return F.when(s.isin(*K.LEVEL_RANK), s).otherwise("")


def default_targets(seniority: Column) -> Column:
    """Target roles of a band, for profiles that name none."""
    table = F.create_map(*[x for band, roles in K.DEFAULT_TARGETS.items() for x in (F.lit(band), F.array(*map(F.lit, roles)))])
    return F.coalesce(F.try_element_at(table, seniority), F.array(F.lit("Senior Product Manager")))


def filter_target_roles(roles: Column, years: Column, seniority: Column) -> Column:
    """Roles without those above the band or off the domain; the band's defaults if nothing is left."""
    product = F.exists(roles, lambda t: F.contains(F.lower(t), F.lit("product")) & any_in(F.lower(t), ("manager", "owner")))
    in_product = product | seniority.isin("junior", "mid", "senior", "staff", "principal")
    low = (years < 8) | seniority.isin("junior", "mid", "senior", "staff")

    def fits(t: Column) -> Column:
        s = F.lower(t)
        off = any_in(s, K.OFF_DOMAIN_TITLES) & ~F.contains(s, F.lit("product"))
        return ~(low & any_in(s, K.HIGH_TITLES)) & ~(in_product & off)

    kept = F.filter(roles, fits)
    return F.when(F.size(kept) > 0, kept).otherwise(default_targets(seniority))


def coerce_profiles(df: DataFrame) -> DataFrame:
    """Profiles with every field in its form: texts trimmed, lists clean, unknown bands blank, at most five target roles.

    Needs name, headline, summary, seniority, years_experience (any type) and the lists; keeps other columns.
    """
    lists = {c: clean_list(F.col(c)) for c in LISTS}
    lists |= {c: F.transform(lists[c], lambda x: F.lower(x)) for c in ("technologies", "domains")}
    plain = {c: F.trim(text(F.col(c))) for c in ("name", "headline", "summary")}
    years = F.coalesce(F.col("years_experience").try_cast("int"), F.lit(0))
    out = df.withColumns({**plain, **lists, "seniority": valid_seniority(F.col("seniority")), "years_experience": years})
    return out.withColumn("target_roles", filter_target_roles(F.slice("target_roles", 1, 5), F.col("years_experience"), F.col("seniority")))


def apply_patches(profiles: DataFrame, patches: DataFrame) -> DataFrame:
    """Profiles with the editable fields of patches (profile_id and any of them; null leaves a field) that are valid.

    Adds edited. patches has one row a profile.
    """
    given = [c for c in EDITABLE if c in patches.columns]
    new = patches.select("profile_id", *[F.col(c).alias(f"__{c}") for c in given], F.lit(True).alias("__edited"))
    out = profiles.join(new, "profile_id", "left")
    valid = {}
    for c in given:
        v = F.col(f"__{c}")
        if c == "years_experience":
            v = F.greatest(F.lit(0), v.try_cast("int"))
        elif c == "seniority":
            v = F.nullif(valid_seniority(v), F.lit(""))
        elif c in LISTS:
            v = F.when(v.isNotNull(), clean_list(v))
        else:
            v = F.trim(v)
        valid[c] = F.coalesce(F.when(F.col(f"__{c}").isNotNull(), v), F.col(c))
    return out.withColumns({**valid, "edited": F.coalesce("__edited", F.lit(False))}).drop(*[f"__{c}" for c in given], "__edited")


def fill_preferences(df: DataFrame) -> DataFrame:
    """years and level as set, else those of the profile (p_years, p_seniority)."""
    years = F.when(F.coalesce("years", F.lit(0)) > 0, F.col("years")).otherwise(F.coalesce("p_years", F.lit(0)))
    level = F.coalesce(F.nullif(F.trim(text(F.col("level"))), F.lit("")), F.trim(text(F.col("p_seniority"))))
    return df.withColumns({"years": years, "level": level})


def profile_text() -> Column:
    """The lines that stand for a profile."""
    c = F.col
    some = lambda x: F.nullif(text(x), F.lit(""))
    years = F.when(F.coalesce(c("years_experience"), F.lit(0)) != 0, F.concat(c("years_experience").cast("string"), F.lit(" years experience")))
    known = some(c("headline")).isNotNull() | some(c("seniority")).isNotNull() | years.isNotNull()
    head = F.when(known, F.concat_ws(" · ", F.coalesce(some(c("headline")), F.lit("Candidate")), F.initcap(some(c("seniority"))), years))
    listed = lambda label, name, most: F.when(F.size(c(name)) > 0, F.concat(F.lit(f"{label}: "), F.array_join(F.slice(name, 1, most) if most else c(name), ", ")))
    lines = [some(c("summary")), head, listed("Technologies", "technologies", 20), listed("Skills", "skills", 20), listed("Domains", "domains", 0), listed("Target roles", "target_roles", 0)]
    return F.trim(F.concat_ws("\n", *lines))


def fingerprint() -> Column:
    """Tokens of a profile: domains, skills, technologies and the lanes of its target roles."""
    items = F.concat(*[F.coalesce(F.col(x), no_words()) for x in ("domains", "skills", "technologies")])
    parts = F.flatten(F.transform(items, lambda x: F.transform(F.split(F.lower(x), r"[,/&+\-|]"), lambda p: F.trim(p))))
    own = F.filter(parts, lambda t: (F.char_length(t) >= 3) & ~t.isin(*K.GENERIC_LANE_WORDS))
    return F.array_distinct(F.concat(own, F.flatten(F.transform(F.coalesce("target_roles", no_words()), lane_tokens))))


def redact_prompts(c: Column) -> Column:
    """Code fences dropped, and phrases that read as instructions to a model replaced."""
    s = F.replace(text(c), F.lit("```"), F.lit(""))
    for phrase in K.PROMPT_PHRASES:
        s = F.regexp_replace(s, rf"(?i)\Q{phrase}\E", "[redacted]")
    return s


def profiles_from_text(df: DataFrame, *, key: str, body: str) -> DataFrame:
    """A rough profile of each text: technologies, domains, band and years by fixed words, and the band's target roles."""
    df, s = df.select(key, body, F.lower(text(F.col(body))).alias("__s")), F.col("__s")
    # A pattern is tried only on texts that hold the letters that it begins with.
    begin = lambda p: re.match("[a-z/]+", p)[0]
    techs = F.array_compact(F.array(*[F.when(F.contains(s, F.lit(begin(p))), F.nullif(F.regexp_extract(s, rf"\b(?:{p})\b", 0), F.lit(""))) for p in K.PROFILE_STACK]))
    domains = F.array_compact(F.array(*[F.when(any_in(s, words), F.lit(label)) for label, words in K.PROFILE_DOMAINS.items()]))
    out = df.select(
        key, F.array_sort(F.array_distinct(techs)).alias("technologies"), F.array_sort(domains).alias("domains"),
        first_label(s, K.PROFILE_LEVELS).alias("seniority"),
        F.coalesce(F.regexp_extract(s, r"(\d{1,2})\+?\s*(?:years|yrs)", 1).try_cast("int"), F.lit(0)).alias("years_experience"),
        F.trim(F.substring(text(F.col(body)), 1, 400)).alias("summary"),
    )
    return out.withColumn("target_roles", filter_target_roles(no_words(), F.col("years_experience"), F.col("seniority")))
