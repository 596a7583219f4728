"""Scalar expressions on samples: fingerprints, normalization, sizes, rounding.

Every function takes and returns a Column built from Spark's own functions, so
projections using them stay inside whole-stage code generation.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# The normalizer's ordered (pattern, replacement) steps.
NORMALIZE_STEPS = (
    (r"\s+", " "),
    (r"\\'", ""),
    (r"'[^']*'", "''"),
    (r"''('')+", "''"),
    (r"=\s*NULL", "=0"),
    (r"([^a-z_])-?([0-9]+)", "$10"),
    (r"([^a-z_])0x[0-9a-f]{1,10}", "$10x"),
    (r"in\s*\(['0x,\s]*\)", "in (...)"),
)

# Names given to the six comma-separated parts of an application name.
APPLICATION_FIELDS = ("program", "module", "action", "client_info", "sofar", "totalwork")

# Units above bytes, each 1024 times the one before.
SIZE_UNITS = ("kB", "MB", "GB", "TB", "PB")

# Words the English text search configuration drops.
ENGLISH_STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his "
    "himself she her hers herself it its itself they them their theirs themselves what "
    "which who whom this that these those am is are was were be been being have has had "
    "having do does did doing a an the and but if or because as until while of at by for "
    "with about against between into through during before after above below to from up "
    "down in out on off over under again further then once here there when where why how "
    "all any both each few more most other some such no nor not only own same so than too "
    "very s t can will just don should now"
).split()


def instant(value: str | dt.datetime) -> Column:
    """A literal instant; without a zone it is read in the session's, whatever the driver's own zone is."""
    if isinstance(value, dt.datetime) and value.tzinfo:
        return instant_from_micros(utc_micros(value))
    return F.lit(str(value)).cast("timestamp")


def utc_micros(value: dt.datetime) -> int:
    """Microseconds since the epoch; a datetime without a zone is UTC."""
    aware = value if value.tzinfo else value.replace(tzinfo=dt.timezone.utc)
    return (aware - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(microseconds=1)


def utc_day(value: str | Column) -> Column:
    """The UTC date of an instant, the same in every session time zone."""
    micros = F.unix_micros(value)
    return F.date_from_unix_date(F.floor((micros - F.pmod(micros, F.lit(86_400_000_000))) / 86_400_000_000).cast("int"))


def instant_from_micros(value: int) -> Column:
    """A literal instant from microseconds since the epoch."""
    return F.timestamp_micros(F.lit(value))


def query_hash(text: Column) -> Column:
    """Fingerprint of a text: magnitude of the leading 32 bits of its SHA-256, as BIGINT."""
    word = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint")
    return F.when(word >= 2**31, F.lit(2**32) - word).otherwise(word)


def normalize_query(text: Column) -> Column:
    """Lowercase a query and replace its literals, so that equal shapes compare equal."""
    result = F.lower(text)
    for pattern, replacement in NORMALIZE_STEPS:
        result = F.regexp_replace(result, pattern, replacement)
    return result


def normalized_hash(query_id: Column, normalized: Column) -> Column:
    """Fingerprint of the server's query id where there is one, else of the normalized text."""
    return query_hash(F.coalesce(query_id.cast("string"), normalized))


def application_info(name: Column) -> Column:
    """Map of the six fields of an application name with exactly five commas, else null."""
    parts = F.split(name, ",")
    fields = F.array(*[F.lit(field) for field in APPLICATION_FIELDS])
    return F.when(F.size(parts) == len(APPLICATION_FIELDS), F.map_from_arrays(fields, parts))


def query_tokens(text: Column) -> Column:
    """Sorted distinct words of a text without English stop words (words are not stemmed)."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}_]+")
    kept = F.array_except(words, F.array(*[F.lit(word) for word in ["", *ENGLISH_STOP_WORDS]]))
    return F.sort_array(kept)


def query_prefix(normalized: Column, query: Column, length: int = 64) -> Column:
    """The leading characters of a query, as shown in the default session report."""
    return F.substring(F.coalesce(normalized, query), 1, length)


def hash_hex(value: Column) -> Column:
    """A fingerprint as lowercase hexadecimal digits."""
    return F.lower(F.hex(value))


def size_pretty(size: Column) -> Column:
    """A byte count as text.

    Up to 10239 the count itself; then kB, MB, ... with halves rounded up, moving to
    the next unit once the rounded value would reach 10240.
    """
    magnitude = F.abs(size)
    text = F.when(magnitude < 10240, F.concat(magnitude.cast("string"), F.lit(" bytes")))
    for step, unit in enumerate(SIZE_UNITS):
        halves = F.shiftright(magnitude, 9 + 10 * step)
        shown = F.concat(F.shiftright(halves + 1, 1).cast("string"), F.lit(f" {unit}"))
        last = unit == SIZE_UNITS[-1]
        text = text.when(F.lit(True) if last else halves < 20479, shown)
    pretty = F.when(size < 0, F.concat(F.lit("-"), text)).otherwise(text)
    return F.when(size.isNotNull(), pretty)


def memory_setting(unit: Column, setting: Column) -> Column:
    """Bytes meant by a server setting such as 16384 units of ``8kB``; null without digits."""
    upper = F.upper(unit)
    factor = (
        F.when(upper.contains("KB"), F.lit(2**10))
        .when(upper.contains("MB"), F.lit(2**20))
        .when(upper.contains("GB"), F.lit(2**30))
        .otherwise(F.lit(0))
    )
    digits = F.regexp_extract(unit, r"[0-9](.*[0-9])?", 0).try_cast("bigint")
    return factor.cast("bigint") * setting.try_cast("bigint") * digits


def round_half_away(value: Column, scale: int = 2) -> Column:
    """Rounding of exact numerics: halves away from zero, returned as double."""
    return F.round(value.cast("decimal(38,10)"), scale).cast("double")


def round_half_even(value: Column) -> Column:
    """Rounding of doubles to whole numbers: halves to even."""
    return F.rint(value)


def counter_pairs(text: Column) -> Column:
    """Map name -> double of a printed counter tuple such as ``times(user=1.5, idle=2.0)``."""
    body = F.regexp_extract(text, r"\((.*)\)", 1)
    pairs = F.str_to_map(body, F.lit(r",\s*"), F.lit("="))
    return F.transform_values(pairs, lambda _, value: value.try_cast("double"))


def parse_counters(text: Column, names: list[str]) -> list[Column]:
    """One double column per counter name (null where a tuple lacks it)."""
    pairs = counter_pairs(text)
    return [F.try_element_at(pairs, F.lit(name)).alias(name) for name in names]
