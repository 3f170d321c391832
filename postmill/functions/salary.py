"""Salary bands in free text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions import constants as K
from postmill.functions.text import flat_html, let, text

BAND = "struct<min:bigint,max:bigint,currency:string>"
_OPEN, _CLOSE = "\u0001", "\u0002"


def amount(digits: Column, thousands: Column) -> Column:
    """Yearly amount of a number, of thousands if marked so or if it can be nothing else; null out of range."""
    n = F.regexp_replace(digits, ",", "").try_cast("double")
    n = F.when((thousands != "") | n.between(*K.SALARY_IN_THOUSANDS), n * 1000).otherwise(n)
    return F.when(n.between(*K.SALARY_RANGE), F.round(n).cast("bigint"))


def hourly_near(s: Column, at: Column, n: Column) -> Column:
    """True if an hourly rate is named within 30 characters of the n characters after the first ``at``."""
    before = F.least(at, F.lit(K.HOURLY_NEAR))
    return F.substring(s, at - before + 1, before + n + K.HOURLY_NEAR).rlike(K.HOURLY)


def _range(found: Column, pattern: str, currency: Column) -> Column:
    group = lambda i: F.regexp_extract(found, pattern, i)
    a, b = amount(group(2), group(3)), amount(group(4), group(5))
    lo, hi = F.least(a, b), F.greatest(a, b)
    return F.when(a.isNotNull() & b.isNotNull() & (hi <= lo * K.SALARY_SPREAD), F.struct(lo.alias("min"), hi.alias("max"), currency.alias("currency")).cast(BAND))


def _first_range(s: Column, pattern: str, currency: Callable[[Column], Column]) -> Column:
    """The first match that reads as a band and stands by no hourly rate.

    Matches are fenced off and the pieces folded in order, so that the place of each is known.
    """
    def step(state: Column, piece: Column) -> Column:
        found = F.substring_index(piece, _CLOSE, 1)
        good = ~hourly_near(s, state["at"], F.char_length(found))
        band = F.when(state["band"].isNull() & good, _range(found, pattern, currency(F.regexp_extract(found, pattern, 1))))
        return F.struct((state["at"] + F.char_length(piece) - 1).alias("at"), F.coalesce(state["band"], band).alias("band"))

    def fold(pieces: Column) -> Column:
        start = F.struct(F.char_length(F.get(pieces, F.lit(0))).alias("at"), F.lit(None).cast(BAND).alias("band"))
        return F.aggregate(F.slice(pieces, 2, F.size(pieces)), start, step)["band"]

    return let(F.split(F.regexp_replace(s, pattern, f"{_OPEN}$0{_CLOSE}"), _OPEN), fold)


def _floor(s: Column) -> Column:
    found = F.regexp_extract(s, K.SALARY_FLOOR, 0)
    group = lambda i: F.regexp_extract(s, K.SALARY_FLOOR, i)
    lo, near = amount(group(2), group(3)), hourly_near(s, F.instr(s, found) - 1, F.char_length(found))
    band = F.struct(lo.alias("min"), F.lit(None).cast("bigint").alias("max"), _currency(group(1)).alias("currency")).cast(BAND)
    return F.when((found != "") & ~near & lo.isNotNull(), band)


def _currency(sign: Column) -> Column:
    return F.when(sign == "£", "GBP").when(sign == "€", "EUR").otherwise("USD")


def extract_salary(c: Column) -> Column:
    """Band of a text: a range by sign, else one by currency code, else a floor; null if there is none."""
    clean = F.translate(text(c), _OPEN + _CLOSE, "  ")
    signs, codes = "[$£€]", "(?i)usd|gbp|eur"  # no band without one of them

    def found(s: Column) -> Column:
        by_sign, floor = F.when(s.rlike(signs), _first_range(s, K.SALARY_BY_SIGN, _currency)), F.when(s.rlike(signs), _floor(s))
        return F.coalesce(by_sign, F.when(s.rlike(codes), _first_range(s, K.SALARY_BY_CODE, F.upper)), floor)

    return let(clean, found)


def fill_salary(df: DataFrame) -> DataFrame:
    """salary_min, salary_max and salary_currency from the description where a posting has no band of its own."""
    own = (F.coalesce("salary_min", F.lit(0)) != 0) | (F.coalesce("salary_max", F.lit(0)) != 0)
    out = df.withColumn("__band", F.when(~own, extract_salary(flat_html(F.col("description")))))
    return out.withColumns({
        "salary_min": F.when(own, F.col("salary_min")).otherwise(F.col("__band.min")), "salary_max": F.when(own, F.col("salary_max")).otherwise(F.col("__band.max")),
        "salary_currency": F.coalesce("__band.currency", F.lit("USD")), "salary_found": F.col("__band").isNotNull(),
    }).drop("__band")
