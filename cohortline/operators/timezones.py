"""Local-time correction of survey and daylight columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.functions.scalar import local_seconds
from cohortline.operators.lookups import nearest_populated, next_key_lookup
from cohortline.operators.rank import attach, group_mode


def daylight_seconds(df: DataFrame, event: str, zipcode: str, zones: DataFrame, zone: str = "tz") -> DataFrame:
    """One row per distinct ``event`` time: its seconds since local midnight.

    The group's most frequent zip code gives the zone. Groups without any zip
    take the value of the nearest group that has its own.
    """
    groups = group_mode(df.filter(F.col(event).isNotNull()), [event], zipcode, "__zip").select(event, "__zip")
    zoned = next_key_lookup(groups, "__zip", zones.withColumnRenamed(zipcode, "__zip"), zone)
    own = zoned.withColumn("__own_seconds", local_seconds(F.col(event).cast("double"), F.col(zone)))
    return nearest_populated(own, event, "__own_seconds", f"{event}_seconds").select(event, f"{event}_seconds")


def correct_local_times(
    df: DataFrame,
    zones: DataFrame,
    zipcode: str = "zipcode",
    survey_times: Sequence[str] = ("survey_start_datetime",),
    sunrise: str = "day_sunrise",
    sunset: str | None = None,
    zone: str = "tz",
) -> DataFrame:
    """Add seconds since local midnight for survey and daylight columns.

    Rows without a zip code borrow the zone of rows with the same corrected
    sunrise seconds, then of rows with the same sunset seconds.
    """
    out = next_key_lookup(df, zipcode, zones, zone)
    daylight = [c for c in (sunrise, sunset) if c]
    for event in daylight:
        out = attach(out, daylight_seconds(df, event, zipcode, zones, zone), [event], "left")
    inferred = F.col(zone)
    helpers = []
    for event in daylight:
        seconds, borrowed = f"{event}_seconds", f"__zone_{event}"
        by_seconds = group_mode(out.filter(F.col(seconds).isNotNull()), [seconds], zipcode, "__z").select(seconds, "__z")
        table = next_key_lookup(by_seconds, "__z", zones.withColumnRenamed(zipcode, "__z"), zone)
        out = attach(out, table.select(seconds, F.col(zone).alias(borrowed)), [seconds], "left")
        helpers.append(borrowed)
    missing_zip = F.col(zipcode).isNull()
    final_zone = F.when(missing_zip, F.coalesce(*[F.col(h) for h in helpers])).otherwise(inferred) if helpers else inferred
    out = out.withColumn(zone, final_zone).drop(*helpers)
    return out.withColumns(
        {f"{c}_seconds": local_seconds(F.col(c).cast("double"), F.col(zone)) for c in survey_times}
    )
