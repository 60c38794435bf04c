"""Names, dates, JSON and arrays of product files as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Codes of sets of polarisations in product names.
POLARISATIONS = {
    "HH": "SH", "VV": "SV", "HH,HV": "DH", "VH,VV": "DV", "LH,LV": "CL", "RH,RV": "CR",
    "HH,HV,VH,VV": "QP", "HH,HV,VV": "QP", "HH,VH,VV": "QP", "HH,VV": "QD",
}


def polarisation_code(channels: Column, default: str = "XX") -> Column:
    """The two-letter code of an array of polarisations, in any order."""
    key = F.array_join(F.array_sort(F.array_distinct(channels)), ",")
    table = F.create_map(*(F.lit(x) for pair in POLARISATIONS.items() for x in pair))
    return F.coalesce(F.try_element_at(table, key), F.lit(default))


def compact_date(t: Column) -> Column:
    """A time as in product names: no punctuation, no parts of a second."""
    return F.date_format(t, "yyyyMMdd'T'HHmmss")


def granule_id(parts: list[Column]) -> Column:
    return F.concat_ws("_", *parts)


def ordinal(n: Column) -> Column:
    """1st, 2nd, 3rd, 4th; 11th to 13th."""
    last, teen = n % 10, (n % 100).between(11, 13)
    end = F.when(teen, "th").when(last == 1, "st").when(last == 2, "nd").when(last == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), end)


def dates_in(name: Column) -> Column:
    """All times in a product's name."""
    return F.transform(F.regexp_extract_all(name, F.lit(r"(\d{8}T\d{6})"), F.lit(1)), lambda x: F.to_timestamp_ntz(x, F.lit("yyyyMMdd'T'HHmmss")))


def snake(name: Column) -> Column:
    """camelCase to lower case with underscores."""
    return F.lower(F.regexp_replace(name, "(?<=[a-z0-9])(?=[A-Z])", "_"))


def camel(name: Column) -> Column:
    """Words with underscores to camelCase."""
    whole = F.regexp_replace(F.initcap(F.regexp_replace(name, "_", " ")), " ", "")
    return F.concat(F.lower(F.substring(whole, 1, 1)), F.substring(whole, 2, 1_000_000))


def unwrapped(text: Column) -> Column:
    """Text without line breaks and indents."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def numbers(text: Column) -> Column:
    """The numbers of a text, split at blanks and commas."""
    return F.transform(F.filter(F.split(text, r"[\s,]+"), lambda x: x != ""), lambda x: x.try_cast("double"))


def grid_mapping(epsg: Column) -> Column:
    """The name of a projection in the climate and forecast conventions."""
    utm = epsg.between(32601, 32660) | epsg.between(32701, 32760)
    return F.when(epsg == 4326, "latitude_longitude").when(utm, "transverse_mercator").when(epsg.isin(3413, 3031, 3995), "polar_stereographic").when(epsg == 6933, "lambert_cylindrical_equal_area")


def complex_json(re: Column, im: Column) -> Column:
    return F.to_json(F.struct(re.alias("real"), im.alias("imag")))


def padded(values: Column, before: int, after: int) -> Column:
    """An array with zeros before and after."""
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    return F.concat(zeros(before), values, zeros(after))


def blocks(values: Column, size: int) -> Column:
    """An array cut into arrays of ``size``; the last may be shorter."""
    n = F.ceil(F.size(values) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(values, i * size + 1, size))).otherwise(F.array().cast("array<array<double>>"))


def from_midnight(t: Column, seconds: int) -> Column:
    """A time moved on to the next whole interval since its midnight."""
    day = F.date_trunc("day", t).cast("timestamp_ntz")
    past = F.expr("1") * (F.unix_micros(t.cast("timestamp")) - F.unix_micros(day.cast("timestamp")))
    whole = F.ceil(past / (seconds * 1e6)) * seconds
    return F.timestamp_seconds(F.unix_micros(day.cast("timestamp")) / 1e6 + whole).cast("timestamp_ntz")


def seconds_since(t: Column, epoch: str) -> Column:
    """Seconds from a reference epoch."""
    return (F.unix_micros(t.cast("timestamp")) - F.unix_micros(F.lit(epoch).cast("timestamp_ntz").cast("timestamp"))) / 1e6


def parts_of_span(seconds: Column) -> tuple[Column, Column, Column, Column]:
    """Whole days, hours, minutes and the rest of a span in seconds; all of a negative span's parts are negative or 0."""
    s, sign = F.abs(seconds), F.signum(seconds)
    day, hour, minute = F.floor(s / 86400), F.floor(s % 86400 / 3600), F.floor(s % 3600 / 60)
    return (sign * day).cast("long"), (sign * hour).cast("long"), (sign * minute).cast("long"), sign * (s % 60)
