"""Parsing, coercion and formatting expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark import schemas

TIME_OF_DAY = r"^(\d{1,2}):(\d{1,2}):(\d{1,2})\.(\d{1,9})$"
EDGES = r"^\s+|\s+$"
#: Forms of date and time that the lenient parse accepts, time-only ones with today's date left out.
TIMESTAMP_FORMS = ["yyyy-MM-dd HH:mm:ss[.SSSSSS]", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]", "yyyy-MM-dd"]


def filename_part(name: Column, part: int) -> Column:
    """Group ``part`` of a recording's file name (1 date, 2 team, 3 player), null where the name has another form."""
    return F.when(name.rlike(schemas.FILE_NAME), F.regexp_extract(name, schemas.FILE_NAME, part))


def year_of(date: Column) -> Column:
    return F.substring(date, 1, 4).try_cast("int")


def month_of(date: Column) -> Column:
    return F.substring(date, 1, 7)


def human_size(size: Column) -> Column:
    """A byte count with two decimals and its unit, up to TB; half to even, as ``printf`` rounds, and null for null."""
    whole = F.abs(size.cast("long"))

    def text(power: int, unit: str) -> Column:
        # whole numbers throughout, as Spark's own format rounds half up
        hundred, one = (whole % F.lit(1024**power)) * 100, F.lit(1024**power)
        cents, rest = F.call_function("div", hundred, one), hundred % one
        up = (rest * 2 > one) | ((rest * 2 == one) & (cents % 2 == 1))
        total = F.call_function("div", whole, one) * 100 + cents + up.cast("long")
        return F.format_string(f"%d.%02d {unit}", F.call_function("div", total, F.lit(100)), total % 100)

    out = text(4, "TB")
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB"), (0, "B")):
        out = F.when(size < 1024 ** (power + 1), text(power, unit)).otherwise(out)
    return F.when(size.isNotNull(), F.concat(F.when(size < 0, "-").otherwise(""), out))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def file_extension(path: Column) -> Column:
    return F.regexp_extract(file_name(path), r".(\.[^.]*)$", 1)


def category(path: Column, root: str) -> Column:
    """The folder of ``path`` below ``root``, ``.`` at the root itself."""
    folder = F.regexp_replace(F.substring(path, len(root.rstrip("/")) + 2, 1 << 30), r"(^|/)[^/]*$", "")
    return F.when(folder == "", ".").otherwise(folder)


def expected_identity(team: Column, player: Column) -> Column:
    return F.concat_ws("-", team, player)


def clean_identity(value: Column) -> Column:
    """The value as text without white space at its ends."""
    return F.regexp_replace(value.cast("string"), EDGES, "")


def time_of_day_us(text: Column) -> Column:
    """Microseconds of the day of ``H:M:S.f``; the fraction is needed, digits past six are cut, anything else is null."""

    def part(i: int) -> Column:
        return F.regexp_extract(text, TIME_OF_DAY, i).try_cast("long")

    us = F.rpad(F.substring(F.regexp_extract(text, TIME_OF_DAY, 4), 1, 6), 6, "0").try_cast("long")
    whole = (part(1) * 3600 + part(2) * 60 + part(3)) * 1_000_000 + us
    return F.when(text.rlike(TIME_OF_DAY) & (part(1) < 24) & (part(2) < 60) & (part(3) < 62), whole)


def parse_timestamp(text: Column) -> Column:
    """A time stamp from text in the accepted forms, null otherwise."""
    trimmed = F.regexp_replace(text.cast("string"), EDGES, "")
    # every form has a hyphen; a parse that fails costs far more than the look
    return F.when(F.contains(trimmed, F.lit("-")), F.coalesce(*[F.try_to_timestamp(trimmed, F.lit(f)) for f in TIMESTAMP_FORMS]))


def parse_clock_or_timestamp(text: Column) -> Column:
    """As ``parse_timestamp``, and clock times with or without a fraction, taken on one fixed day."""
    clock = F.regexp_replace(text.cast("string"), EDGES, "")
    dated = F.try_to_timestamp(F.concat(F.lit("1970-01-01 "), clock), F.lit("yyyy-MM-dd H:m:s[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]"))
    return F.coalesce(parse_timestamp(text), dated)


def parse_date(text: Column) -> Column:
    return parse_timestamp(text).cast("date")


def to_numeric(value: Column) -> Column:
    """The value as double; what is no number, and NaN, is null."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number), number)


def nan_as_null(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with NaN as null in its floating-point columns, or in those of ``columns`` that are."""
    floats = [c for c, t in df.dtypes if t in ("double", "float") and (not columns or c in columns)]
    return df.withColumns({c: F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")) for c in floats})


def fingerprint(text: Column) -> Column:
    """The first 12 hex digits of the SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 12)


def seconds(us: Column) -> Column:
    return us / 1_000_000


def round_ms(us: Column) -> Column:
    """Microseconds as seconds rounded to the millisecond, half to even."""
    return F.bround(us / 1000) / 1000


def frequency_hz(interval: Column) -> Column:
    return F.when(interval > 0, 1 / interval)


def joined_set(value: Column) -> Column:
    """Aggregate: the sorted distinct values joined by semicolons."""
    return F.array_join(F.array_sort(F.collect_set(value)), ";")


def spread_index(i: Column, total: Column | int, wanted: Column | int) -> Column:
    """Index ``i`` of ``wanted`` evenly spaced ones among ``total``, half to even."""
    total, wanted = (F.lit(x) if isinstance(x, int) else x for x in (total, wanted))
    return F.bround((i * (total - 1)) / (wanted - 1)).cast("long")


def spread_kept(row: Column, total: Column, wanted: int) -> Column:
    """Whether row ``row`` (from 0) is among ``wanted`` evenly spaced ones of ``total``: local to the row, no index list."""
    if wanted == 1:
        return row == 0
    step = (total - 1) / F.lit(wanted - 1)
    near = F.floor(row / F.greatest(step, F.lit(1e-9)))
    hit = [spread_index(F.least(near + d, F.lit(wanted - 1)), total, wanted) == row for d in (0, 1)]
    return (total <= wanted) | hit[0] | hit[1]


def missing_if_token(text: Column) -> Column:
    """Null for the texts that stand for a missing value."""
    return F.when(~text.isin(schemas.NA_TOKENS), text)
