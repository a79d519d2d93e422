"""Row-level expressions: numbers in JSON, recodes, groups, bands."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a number in text. A cast alone would also take '30d' and '30f'.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def number(text: Column | str) -> Column:
    """The number that a text holds, else null."""
    return F.when(col(text).rlike(NUMBER), F.trim(col(text)).try_cast("double"))


#: What stands first in an array, or alone, in a JSON text.
FIRST_OR_SOLE = r'^\s*\[?\s*"?([^",\]\[]*)"?'


def json_map(text: Column | str) -> Column:
    """A flat JSON object as a map of its keys (dots and spaces allowed) to texts; parse once a row."""
    return F.from_json(col(text), "map<string,string>")


def has_key(metrics: Column | str, key: str) -> Column:
    """True also if the key's value is a JSON null."""
    return F.map_contains_key(col(metrics), key)


def json_number(metrics: Column | str, key: str) -> Column:
    """``[n, ...]`` gives its first element, ``n`` and ``"n"`` themselves, anything else null."""
    raw = F.try_element_at(col(metrics), F.lit(key))
    return number(F.regexp_extract(raw, FIRST_OR_SOLE, 1))


def variant_number(document: Column | str, path: str) -> Column:
    """As ``json_number`` for a VARIANT of any depth: ``path`` is like ``$.a.b`` or ``$["a.b"][0]``."""
    read = lambda p: number(F.try_variant_get(col(document), p, "string"))
    return F.coalesce(read(f"{path}[0]"), read(path))


def scaled(value: Column | str, *, absolute: bool = False, scale: float = 1.0) -> Column:
    """abs first, then scale."""
    value = F.abs(col(value)) if absolute else col(value)
    return value * F.lit(scale)


def recode(value: Column | str, to: Mapping[float, float]) -> Column:
    """Exactly the given values become others; all else passes through."""
    out = col(value).cast("double")
    case = None
    for old, new in to.items():
        case = (F.when if case is None else case.when)(out == F.lit(float(old)), F.lit(float(new)))
    return out if case is None else case.otherwise(out)


def age_group(group: Column | str, age: Column | str, otherwise: str | None = "unknown") -> Column:
    """The trimmed group, or one by age: under 14, 19, 23 and above."""
    a = col(age)
    by_age = F.when(a < 14, "YOUTH").when(a < 19, "HIGH SCHOOL").when(a < 23, "COLLEGE").when(a >= 23, "PRO").otherwise(F.lit(otherwise))
    return F.coalesce(F.nullif(F.trim(col(group)), F.lit("")), by_age)


def side_is(side: Column | str, letter: str) -> Column:
    return F.lower(F.substring(col(side), 1, 1)) == letter


def not_prefixed(value: Column | str, prefix: str) -> Column:
    """Null or without the prefix, in any case."""
    return col(value).isNull() | ~F.ilike(col(value), F.lit(f"{prefix}%"))


def zscore(value: Column | str, mean: Column | str, std: Column | str) -> Column:
    """Null if anything is null or the deviation is 0."""
    return (col(value) - col(mean)) / F.nullif(col(std), F.lit(0.0))


def banded(value: Column | str, bands: Iterable[tuple[float | None, float | None, str]], otherwise: str = "Neutral") -> Column:
    """The status of the first band (low inclusive, high exclusive, status) that holds the value.

    Published bands overlap and leave gaps; order decides, gaps are ``otherwise``.
    """
    case = F.when(col(value).isNull(), F.lit(None).cast("string"))
    for low, high, status in bands:
        inside = F.lit(True)
        if low is not None:
            inside = inside & (col(value) >= low)
        if high is not None:
            inside = inside & (col(value) < high)
        case = case.when(inside, status)
    return case.otherwise(otherwise)


def cost(model: Column | str, tokens_in: Column | str, tokens_out: Column | str, prices: Mapping[str, tuple[float, float]]) -> Column:
    """(in * price in + out * price out) / 1e6; unknown models cost nothing."""
    rate = lambda i: F.coalesce(F.try_element_at(F.create_map(*(x for name, p in prices.items() for x in (F.lit(name), F.lit(p[i])))), col(model)), F.lit(0.0))
    return (col(tokens_in) * rate(0) + col(tokens_out) * rate(1)) / 1e6


def transient(error: Column | str) -> Column:
    """Errors after which a call may be tried again."""
    return F.coalesce(col(error).rlike("503|UNAVAILABLE|RESOURCE_EXHAUSTED|429"), F.lit(False))


def key_axis(key: Column | str, axis: Column | str) -> Column:
    """``key.axis``, the name of one axis of a measurement."""
    return F.concat(col(key), F.lit("."), col(axis))


def not_archived(flag: Column | str) -> Column:
    """Whether a row is not archived; an unknown flag says it is not."""
    return ~F.coalesce(col(flag), F.lit(False))


def intensity_level(intensity: Column | str) -> Column:
    """``P0``, ``P1`` and so on; null if there is none."""
    return F.concat(F.lit("P"), col(intensity).cast("int").cast("string"))


# Prefixes of the metrics of each domain of assessment.
DOMAINS = {
    "movement": ["pitch_", "hit_"],
    "mobility": ["mob_"],
    "performance": ["proteus_", "screen_"],
    "functional": ["mob_", "proteus_", "screen_"],
}


def in_domain(metric: Column | str, domain: str | None) -> Column:
    """Whether a metric belongs to a domain; every metric does to one that is not listed."""
    hits = [F.startswith(col(metric), F.lit(p)) for p in DOMAINS.get(domain or "", [""])]
    out = hits[0]
    for h in hits[1:]:
        out = out | h
    return out
