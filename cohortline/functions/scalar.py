"""Scalar column functions (all JVM-side expressions)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MICROS = 86_400_000_000


def local_timestamp(epoch: Column, zone: Column) -> Column:
    """Epoch seconds (double) to the wall clock of a zone column."""
    return F.from_utc_timestamp(F.timestamp_seconds(epoch), zone)


def local_seconds(epoch: Column, zone: Column) -> Column:
    """Seconds since local midnight, as a wall-clock difference, with fraction.

    Working on the shifted microseconds keeps the result independent of the
    session time zone and of daylight-saving jumps earlier in the day.
    """
    wall = F.unix_micros(local_timestamp(epoch, zone))
    return F.pmod(wall, F.lit(DAY_MICROS)) / F.lit(1e6)


def zip_text(zipcode: Column) -> Column:
    """Numeric zip code to five digits of text."""
    return F.lpad(zipcode.cast("long").cast("string"), 5, "0")


def reformat_date(text: Column, source: str = "M/d/yyyy", target: str = "yyyy-MM-dd") -> Column:
    return F.date_format(F.to_date(text, source), target)


def number_or_zero(text: Column) -> Column:
    """Numeric coercion; anything unreadable counts as 0."""
    return F.coalesce(text.try_cast("double"), F.lit(0.0))


def positive_flag(text: Column) -> Column:
    """``<= 0`` (or unreadable) to 0, everything else to 1."""
    return F.when(number_or_zero(text) <= 0, 0).otherwise(1)


def is_alpha(token: Column) -> Column:
    return token.rlike(r"^\p{L}+$")


def arg_max(values: Column) -> Column:
    """Zero-based index of the largest element, first one on ties."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def at_least(x: Column, threshold: float = 0.5) -> Column:
    return F.when(x >= threshold, 1).otherwise(0)


def complement(flag: Column) -> Column:
    return F.lit(1) - flag


def pad_left(values: Column, size: int, fill: Column) -> Column:
    """Keep the last ``size`` elements, padding in front."""
    kept = F.when(F.size(values) > size, F.slice(values, -size, size)).otherwise(values)
    return F.concat(F.array_repeat(fill, F.greatest(F.lit(size) - F.size(values), F.lit(0))), kept)


def pad_right(values: Column, size: int, fill: Column) -> Column:
    """Keep the first ``size`` elements, padding behind."""
    return F.concat(F.slice(values, 1, size), F.array_repeat(fill, F.greatest(F.lit(size) - F.size(values), F.lit(0))))


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def label_from_path(path: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """First rule whose substring occurs in ``path`` names the label."""
    out = F.lit(default)
    for needle, label in reversed(list(rules)):
        out = F.when(path.contains(needle), F.lit(label)).otherwise(out)
    return out


def class_index(label: Column, classes: Sequence[str]) -> Column:
    """Lower-cased label to its index in ``classes``; unknown labels give NULL."""
    position = F.array_position(F.array(*[F.lit(c.lower()) for c in classes]), F.lower(label))
    return F.when(position > 0, (position - 1).cast("int"))


def record_json(columns: Mapping[str, Column]) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in columns.items()]))
