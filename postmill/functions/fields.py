"""Column expressions for places, levels, years and money."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions import constants as K
from postmill.functions.text import any_in, first_label, mapped, text


def work_mode(remote: Column, location: Column) -> Column:
    """remote, hybrid, onsite or unknown: the field if it says so, else the first kind of token found."""
    raw = F.lower(F.trim(text(remote)))
    both = F.concat_ws(" ", raw, F.lower(text(location)))
    out = F.when(raw.isin(*K.WORK_MODES), raw)
    for mode in K.WORK_MODES:
        out = out.when(any_in(both, K.WORK_MODE_TOKENS[mode]), F.lit(mode))
    return out.otherwise(F.lit("unknown"))


def is_country_only(location: Column) -> Column:
    return F.lower(F.trim(text(location))).isin(*K.COUNTRY_ONLY)


def detect_country(location: Column, remote: Column, tokens: dict | None = None) -> Column:
    """ISO code by the first token in table order, then by US state shapes; '' if unknown or plain remote."""
    t = F.lower(F.concat_ws(" ", text(location), text(remote)))
    bare = F.regexp_replace(t, r"^[ \-,/|]+|[ \-,/|]+$", "")
    out = F.when((F.trim(t) == "") | bare.isin(*K.WORK_MODE_TOKENS["remote"]), F.lit(""))
    for iso, words in (tokens or K.COUNTRY_TOKENS).items():
        out = out.when(any_in(t, words), F.lit(iso))
    states = "|".join(K.US_STATE_CODES)
    return out.when(t.rlike(rf", (?:{states})| (?:{states}) |\((?:{states})\)"), F.lit("US")).otherwise(F.lit(""))


def norm_country(c: Column) -> Column:
    s = F.lower(F.trim(text(c)))
    iso = F.upper(s)
    return F.when(iso.isin(*K.COUNTRY_TOKENS), iso).otherwise(mapped(s, K.COUNTRY_ALIASES, F.lit("")))


def norm_level(c: Column) -> Column:
    s = F.lower(F.trim(text(c)))
    return F.when(s.isin(*K.LEVEL_RANK), s).otherwise(mapped(s, K.LEVEL_ALIASES, F.lit("")))


def level_rank(level: Column) -> Column:
    return mapped(level, K.LEVEL_RANK, F.lit(None).cast("int"))


def title_level(title: Column) -> Column:
    return first_label(F.lower(text(title)), K.TITLE_LEVELS)


def guess_seniority(title: Column) -> Column:
    """A coarse band from the title alone, for feeds; mid if it tells nothing."""
    return F.coalesce(F.nullif(first_label(F.lower(text(title)), K.GUESSED_SENIORITY), F.lit("")), F.lit("mid"))


def job_level(title: Column, seniority: Column) -> Column:
    """From title and tag; where they differ the higher band counts."""
    by_title, tag = title_level(title), norm_level(seniority)
    return (
        F.when(by_title == "", tag).when(tag == "", by_title)
        .when(level_rank(by_title) >= level_rank(tag), by_title).otherwise(tag)
    )


def user_level(level: str, years: int) -> str:
    """The user's band: as set, else the highest whose floor of years is met."""
    key = level.strip().lower()
    key = key if key in K.LEVEL_RANK else K.LEVEL_ALIASES.get(key, "")
    if key or years <= 0:
        return key
    return max((b for b in K.LEVEL_RANK if years >= K.LEVEL_YEARS[b]), key=K.LEVEL_RANK.get, default="junior")


def required_years(c: Column) -> Column:
    """Most years that a requirement names, else the least number of years in the text; 0 to 30."""
    numbers = lambda p: F.filter(F.transform(F.regexp_extract_all(text(c), F.lit(p), F.lit(1)), lambda x: x.cast("int")), lambda n: n <= 30)
    return F.coalesce(F.array_max(numbers(K.YEARS_EXPERIENCE)), F.array_min(numbers(K.YEARS_PLAIN)))


def salary_usd(c: Column) -> Column:
    """Dollars of a salary text: the middle of its least and greatest number of at least 10,000, times the rate."""
    s = F.trim(text(c))
    rate = F.lit(None).cast("double")
    for token, value in reversed(K.CURRENCY_TO_USD.items()):
        rate = F.when(F.contains(s, F.lit(token)), F.lit(value)).otherwise(rate)
    joined = F.regexp_replace(F.regexp_replace(s, "[  ]", " "), r"(\d)\s+(\d{3})\b", "$1$2")
    found = F.regexp_extract_all(joined, F.lit(r"\d+(?:[,.]\d+)*\s*[kKmM]?"), F.lit(0))

    def value(x: Column) -> Column:
        suffix = F.lower(F.regexp_extract(x, "([kKmM])$", 1))
        number = F.regexp_replace(x, r"[^\d,.]", "")
        whole = F.try_to_number(F.regexp_replace(number, "[,.]", ""), F.lit("9" * 30)).cast("double")
        decimal = number.rlike(r"^\d[\d,]*\.\d{1,2}$") & ~F.contains(number, F.lit(","))
        plain = F.when((suffix != "") & decimal, number.try_cast("double")).otherwise(whole)
        return plain * F.when(suffix == "k", 1e3).when(suffix == "m", 1e6).otherwise(1.0)

    nums = F.filter(F.transform(found, value), lambda v: v >= 10_000)
    return F.when(F.size(nums) > 0, (F.array_min(nums) + F.array_max(nums)) / 2 * F.coalesce(rate, F.lit(1.0)))


def calibrate(x: Column) -> Column:
    """Piecewise-linear display score."""
    out = F.when(x <= 0, F.lit(0.0))
    for (x0, y0), (x1, y1) in zip(K.CALIBRATION, K.CALIBRATION[1:], strict=False):
        out = out.when(x <= x1, y0 + (y1 - y0) * (x - x0) / (x1 - x0))
    return F.when(x.isNull(), F.lit(0.0)).otherwise(out.otherwise(F.lit(K.CALIBRATION[-1][1])))


def clamp(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def elapsed_days(later: Column, earlier: Column) -> Column:
    """Whole days of elapsed time, rounded down."""
    return F.floor((F.unix_timestamp(later) - F.unix_timestamp(earlier)) / 86400).cast("int")


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371.0 * F.asin(F.sqrt(a))


def parse_posted(c: Column) -> Column:
    """Time from ISO text, day formats or epoch seconds; null if none fits."""
    s = F.trim(text(c))
    epoch = F.when(s.rlike(r"^\d{9,10}(?:\.\d+)?$"), F.timestamp_seconds(s.try_cast("double"))).when(s.rlike(r"^\d{12,13}$"), F.timestamp_millis(s.try_cast("long")))
    formats = ("yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy")
    return F.coalesce(epoch, F.try_to_timestamp(F.when(~s.rlike(r"^\d+$"), s)), *(F.try_to_timestamp(s, F.lit(f)) for f in formats))


def remote_region(location: Column) -> Column:
    """us, foreign, anywhere or onsite."""
    t = F.lower(text(location))
    return (
        F.when(~any_in(t, K.REMOTE_SIGNS), "onsite").when(t.rlike(rf"\b(?:{K.US_REGION})\b"), "us")
        .when(t.rlike(rf"\b(?:{'|'.join(K.FOREIGN_REGIONS)})\b"), "foreign").otherwise("anywhere")
    )


ISO = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:[.,]\d{1,6})?)?(?:Z|[+-]\d{2}:?\d{2})?)?$"


def read_date(c: Column) -> Column:
    """Time from a number of seconds or (over 10^12) milliseconds, or from ISO text; null if it is neither, or too small a number."""
    s = F.trim(text(c.cast("string")))
    n = s.try_cast("double")
    seconds = F.when(n > 1e12, n / 1000).otherwise(n)
    return F.when((seconds > 10_000_000) & (seconds < 1e11), F.timestamp_seconds(seconds)).when(n.isNull() & s.rlike(ISO), F.try_to_timestamp(F.replace(s, F.lit(","), F.lit("."))))


def first_date(df: DataFrame, fields: tuple[str, ...] = K.DATE_FIELDS) -> Column:
    """The first of the row's date fields that can be read."""
    return F.coalesce(*[read_date(F.col(c)) for c in fields if c in df.columns], F.lit(None).cast("timestamp"))


def posted_age_days(posted: Column, now: Column) -> Column:
    """Whole days since posting; null for dates over a day ahead, 0 for those within it."""
    ahead = F.unix_timestamp(posted) > F.unix_timestamp(now) + 86400
    return F.when(posted.isNotNull() & ~ahead, F.greatest(F.lit(0), elapsed_days(now, posted)))


def age_label(days: Column) -> Column:
    """today, Nd under 14 days, Nw under 60, Nmo under 365, else Ny; a dash without a date."""
    unit = lambda n, s: F.concat(F.floor(days / n).cast("string"), F.lit(s))
    return F.when(days.isNull(), "—").when(days == 0, "today").when(days < 14, unit(1, "d")).when(days < 60, unit(7, "w")).when(days < 365, unit(30, "mo")).otherwise(unit(365, "y"))


def escaped(words) -> str:
    return "|".join(map(re.escape, words))
