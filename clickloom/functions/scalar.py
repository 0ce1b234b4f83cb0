"""Scalar functions as Column expressions: they stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

TIME = "yyyy-MM-dd H:mm:ss"  # H reads 9 and 09


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_blank(c) -> Column:
    """NULL, '', 'null' and 'NULL' are blank."""
    return F.coalesce(col(c).isin("", "null", "NULL"), F.lit(True))


def trim_comma(c) -> Column:
    """Without one comma at each end."""
    return F.regexp_replace(col(c), "^,|,$", "")


def pad_two(c) -> Column:
    """Two characters stay; any other length gets a leading 0."""
    c = col(c)
    return F.when(F.length(c) == 2, c).otherwise(F.concat(F.lit("0"), c))


def split_items(c, delimiter: str = ",") -> Column:
    """The parts without empty ones."""
    return F.filter(F.split(col(c), "\\Q" + delimiter + "\\E"), lambda x: x != "")


def get_field(c, name: str, delimiter: str = "|") -> Column:
    """The value of the first part ``name=value``; a part without exactly one value is passed over."""
    parts = F.filter(F.split(col(c), "\\Q" + delimiter + "\\E"), lambda x: x.startswith(f"{name}=") & (F.size(split_items(x, "=")) == 2) & (F.size(F.split(x, "=")) == 2))
    return F.substring_index(F.get(parts, F.lit(0)), "=", -1)


def set_field(c, name: str, value: str, delimiter: str = "|") -> Column:
    """The first part of that name gets the value; the parts are joined by ``|``."""
    parts = F.split(col(c), "\\Q" + delimiter + "\\E")
    names = F.transform(parts, lambda x: F.substring_index(x, "=", 1))
    at = F.array_position(names, name)
    return F.array_join(F.transform(parts, lambda x, i: F.when(i + 1 == at, F.lit(f"{name}={value}")).otherwise(x)), "|")


def parse_time(c) -> Column:
    return F.try_to_timestamp(col(c), F.lit(TIME))


def before(a, b) -> Column:
    return F.coalesce(parse_time(a) < parse_time(b), F.lit(False))


def after(a, b) -> Column:
    return F.coalesce(parse_time(a) > parse_time(b), F.lit(False))


def minus_seconds(a, b) -> Column:
    """Whole seconds from b to a; 0 if either can't be read."""
    return F.coalesce(F.unix_seconds(parse_time(a)) - F.unix_seconds(parse_time(b)), F.lit(0)).cast("bigint")


def date_hour(c) -> Column:
    return F.date_format(parse_time(c), "yyyy-MM-dd_HH")


def format_date(ts) -> Column:
    return F.date_format(col(ts), "yyyy-MM-dd")


def format_time(ts) -> Column:
    return F.date_format(col(ts), "yyyy-MM-dd HH:mm:ss")


def date_key(ts) -> Column:
    return F.date_format(col(ts), "yyyyMMdd")


def parse_date_key(c) -> Column:
    return F.to_date(F.try_to_timestamp(col(c), F.lit("yyyyMMdd")))


def minute_key(ts) -> Column:
    return F.date_format(col(ts), "yyyyMMddHHmm")


def today() -> Column:
    return F.date_format(F.current_date(), "yyyy-MM-dd")


def yesterday() -> Column:
    return F.date_format(F.date_sub(F.current_date(), 1), "yyyy-MM-dd")


def ratio2(n, d) -> Column:
    """n / d with two decimals, halves up, by whole-number arithmetic; NULL if d is 0."""
    n, d = col(n).cast("bigint"), col(d).cast("bigint")
    return F.when(d != 0, F.call_function("div", 200 * n + d, 2 * d).cast("double") / 100)


def ratio2_binary(n, d) -> Column:
    """Like :func:`ratio2`, but a tie of the decimal value is decided on its binary double: it goes
    down where the double lies below the tie.

    With v = m * 2^-s, m a whole number below 2^54, v < t / 200 says 200 * m < t * 2^s in whole numbers,
    for ratios of whole numbers from 1/200 to 10^7."""
    n, d = col(n).cast("bigint"), col(d).cast("bigint")
    up = F.call_function("div", 200 * n + d, 2 * d)
    t = F.when((200 * n) % d == 0, F.call_function("div", 200 * n, d))
    v = n.cast("double") / d.cast("double")
    s = 53 - F.floor(F.log2(v)).cast("int")
    m = (v * F.pow(F.lit(2.0), s)).cast("bigint")
    down = (t % 2 == 1) & (200 * m < F.call_function("shiftleft", t, s))
    return F.when(d != 0, (up - F.coalesce(down, F.lit(False)).cast("bigint")).cast("double") / 100)


def round_half_up(x, scale: int = 2) -> Column:
    return F.round(col(x), scale)


def concat_long_string(n, s, delimiter: str = ":") -> Column:
    text = lambda c: F.coalesce(col(c).cast("string"), F.lit("null"))
    return F.concat(text(n), F.lit(delimiter), text(s))


def json_field(c, name: str) -> Column:
    """A top-level field by its bare name; blank text gives NULL."""
    return F.when(~is_blank(c), F.get_json_object(col(c), f"$.{name}"))


def salt(n: int, *keys) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")


def with_prefix(key, prefix) -> Column:
    return F.concat(col(prefix).cast("string"), F.lit("_"), col(key))


def without_prefix(c) -> Column:
    """What follows the number and the first underscore."""
    return F.regexp_extract(col(c), "^\\d+_(.*)$", 1)


def area_of(c) -> Column:
    return F.split_part(col(c), F.lit(":"), F.lit(2))


def product_of(c) -> Column:
    return F.split_part(col(c), F.lit(":"), F.lit(1)).try_cast("bigint")


def group_concat_distinct(c) -> Column:
    """Aggregate: distinct values, sorted, comma-joined; NULLs are passed over."""
    return F.array_join(F.array_sort(F.collect_set(col(c))), ",")


SQL_FUNCTIONS = {
    "concat_long_string": "(a BIGINT, b STRING, c STRING) RETURNS STRING RETURN concat(coalesce(cast(a AS STRING), 'null'), c, coalesce(b, 'null'))",
    "json_text_field": "(j STRING, f STRING) RETURNS STRING RETURN CASE WHEN j IN ('', 'null', 'NULL') THEN NULL ELSE get_json_object(j, concat('$.', f)) END",
    "random_prefix": "(k STRING, n INT) RETURNS STRING RETURN concat(cast(floor(rand() * n) AS INT), '_', k)",
    "remove_random_prefix": "(k STRING) RETURNS STRING RETURN regexp_extract(k, '^\\\\d+_(.*)$', 1)",
    "get_area": "(s STRING) RETURNS STRING RETURN split_part(s, ':', 2)",
    "get_product_id": "(s STRING) RETURNS BIGINT RETURN try_cast(split_part(s, ':', 1) AS BIGINT)",
    "long_to_string": "(n BIGINT) RETURNS STRING RETURN cast(n AS STRING)",
    "string_to_long": "(s STRING) RETURNS BIGINT RETURN cast(s AS BIGINT)",
}


def register(spark: SparkSession) -> None:
    """The functions by name for SQL: Catalyst inlines their bodies."""
    for name, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
