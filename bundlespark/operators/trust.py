"""Trust and freshness, derived when read and never stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import strip


def tier(verified: Column) -> Column:
    """unverified, machine-confirmed or human-reviewed."""
    human = F.exists(verified, lambda x: x["by"]["kind"] == "human")
    return F.when(F.size(verified) == 0, "unverified").when(human, "human-reviewed").otherwise("machine-confirmed")


def latest(verified: Column) -> Column:
    """The largest time as text; NULL if no entry has one."""
    return F.array_max(F.transform(verified, lambda x: x["at"]))


def staleness(stale_after: Column, today: str) -> Column:
    """struct<state, deadline>: none, unparseable, stale or fresh on the day ``today``; the day itself is stale."""
    day = F.try_to_date(strip(stale_after), "yyyy-MM-dd")
    state = F.when(stale_after.isNull(), "none").when(day.isNull(), "unparseable").when(F.lit(today).cast("date") >= day, "stale").otherwise("fresh")
    return F.struct(state.alias("state"), day.alias("deadline"))


def staleness_text(stale_after: Column, today: str) -> Column:
    s = staleness(stale_after, today)
    return (F.when(s["state"] == "stale", F.concat(F.lit("stale since "), s["deadline"].cast("string")))
            .when(s["state"] == "unparseable", F.concat(F.lit("unparseable stale_after "), stale_after)).otherwise("ok"))


def report(projected: DataFrame, today: str) -> DataFrame:
    """(concept_id, tier, status, staleness); the status has its default applied."""
    return projected.select("concept_id", tier(F.col("verified")).alias("tier"), "status", staleness_text(F.col("stale_after"), today).alias("staleness")).orderBy("concept_id")
