"""Classification codes: cleaning, matching, range expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import quote_regex


def clean_code(code: Column) -> Column:
    """Lower case without dots: ``C7A.02`` becomes ``c7a02``."""
    return F.replace(F.lower(code), F.lit("."), F.lit(""))


def matches_disease(code: Column, diseases: list[str], mode: str = "contains") -> Column:
    """True when the cleaned code contains (or starts with) any cleaned disease.

    The list becomes one regular expression, so its length does not add joins.
    """
    if mode not in ("contains", "prefix"):
        raise ValueError("mode must be 'contains' or 'prefix'")
    if not diseases:
        return F.lit(False)
    options = "|".join(quote_regex(d.lower().replace(".", "")) for d in diseases)
    anchor = "^" if mode == "prefix" else ""
    return F.coalesce(clean_code(code).rlike(f"{anchor}(?:{options})"), F.lit(False))


# Fixed value: digits Spark's widest whole number holds; longer numbers do not count upwards.
SHAPE = r"^([a-z]*)(\d{1,38})$"
NUMBER = "decimal(38,0)"
# Codes of one range that a row expands to at a time.
RANGE_STEP = 1_000_000


def _bounds(code: Column) -> tuple[Column, Column, Column, Column, Column, Column]:
    """Ends, countable, prefix, width, low and high of a cleaned ``start-end`` code."""
    ends = F.split(code, "-")
    start, end = F.get(ends, 0), F.get(ends, 1)
    low = F.regexp_extract(start, SHAPE, 2).try_cast(NUMBER)
    high = F.regexp_extract(end, SHAPE, 2).try_cast(NUMBER)
    prefix = F.regexp_extract(start, SHAPE, 1)
    countable = (
        (F.size(ends) == 2)
        & start.rlike(SHAPE)
        & end.rlike(SHAPE)
        & (prefix == F.regexp_extract(end, SHAPE, 1))
        & (low <= high)
    )
    width = F.length(F.regexp_extract(start, SHAPE, 2))
    return ends, F.coalesce(countable, F.lit(False)), prefix, width, low, high


def _rendered(prefix: Column, width: Column, number: Column) -> Column:
    digits = number.cast("string")
    missing = F.greatest(width - F.length(digits), F.lit(0))
    return F.concat(prefix, F.repeat(F.lit("0"), missing), digits)


def _uncounted(code: Column, ends: Column) -> Column:
    return F.when(F.size(ends) != 2, F.array(code)).otherwise(F.array_distinct(ends))


def code_range(code: Column) -> Column:
    """Array of the codes a cleaned ``start-end`` code stands for.

    Letter prefix plus number counts upwards with the width of the start
    (``c00-c14`` gives c00..c14).  Other bounds, unequal prefixes and falling
    ranges give the two end codes.  A code that is no range gives itself.  The
    array holds the whole range: ``expand_code_ranges`` takes any length.
    """
    ends, countable, prefix, width, low, high = _bounds(code)
    steps = F.sequence(F.lit(0).cast("bigint"), F.when(countable, (high - low).cast("bigint")).otherwise(0))
    counted = F.transform(steps, lambda n: _rendered(prefix, width, (low + n).cast(NUMBER)))
    return F.when(countable, counted).otherwise(_uncounted(code, ends))


def code_range_unpadded(code: Column) -> Column:
    """Historic expansion: counts from the first non-zero digit, no padding.

    ``c00-c14`` gives c00..c04, ``a05-a12`` gives nothing and bounds that are
    not numeric raise an error.
    """
    ends = F.split(code, "-")
    start, end = F.get(ends, 0), F.get(ends, 1)
    cut = F.least(F.length(start) - 1, F.length(F.regexp_extract(start, "^([^1-9]*)", 1)))
    prefix = F.substring(start, F.lit(1), cut)
    low = F.substring(start, cut + 1, F.length(start)).cast("bigint")
    high = F.substring(end, cut + 1, F.length(end)).cast("bigint")
    numbers = F.when(low <= high, F.sequence(low, F.greatest(low, high))).otherwise(
        F.array().cast("array<bigint>")
    )
    counted = F.transform(numbers, lambda n: F.concat(prefix, n.cast("string")))
    return F.when(F.size(ends) != 2, F.array(code)).otherwise(counted)


def expand_code_ranges(
    df: DataFrame, code_column: str, legacy: bool = False, range_step: int = RANGE_STEP
) -> DataFrame:
    """One row per code of the range in ``code_column``; other columns repeat.

    A row without a code is kept as it is.  Ranges of more than ``range_step``
    codes are cut into steps that Spark deals out, so no row expands to more
    than that at once (one size check; not for ``legacy``).
    """
    others = [c for c in df.columns if c != code_column]
    code = F.col(code_column)
    if legacy:
        codes = F.when(code.isNull(), F.array(F.lit(None).cast("string"))).otherwise(code_range_unpadded(code))
        return df.select(*others, F.explode(codes).alias(code_column)).select(*df.columns)
    _, countable, prefix, width, low, high = _bounds(code)
    codes = F.when(code.isNull(), F.array(F.lit(None).cast("string"))).otherwise(code_range(code))
    long = F.coalesce(countable & (high - low >= range_step), F.lit(False))
    short = df.filter(~long).select(*others, F.explode(codes).alias(code_column)).select(*df.columns)
    if df.filter(long).isEmpty():
        return short
    last = F.floor((high - low) / F.lit(range_step)).cast("bigint")
    begin = (low + F.col("_step") * F.lit(range_step)).cast(NUMBER)
    size = F.least(F.lit(range_step), (high - begin + 1).cast("bigint"))
    stepped = (
        df.filter(long)
        .withColumn("_step", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
        .repartition(code_column, "_step")
        .withColumn("_n", F.explode(F.sequence(F.lit(0).cast("bigint"), size - 1)))
    )
    made = _rendered(prefix, width, (begin + F.col("_n")).cast(NUMBER))
    return short.unionByName(stepped.select(*others, made.alias(code_column)).select(*df.columns))
