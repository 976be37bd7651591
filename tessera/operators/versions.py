"""References to versioned datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def exact_or_latest(requests: DataFrame, datasets: DataFrame) -> DataFrame:
    """Requests (id, version) with the version that there is (``resolved``) and ``how``: exact, latest or missing.

    A request without a version takes the latest. Each dataset side is aggregated before it is joined, so a join
    never multiplies requests.
    """
    exact = datasets.groupBy("id", "version").agg(F.lit(True).alias("exact"))
    latest = datasets.groupBy("id").agg(F.max("version").alias("latest"))
    found = requests.join(exact, ["id", "version"], "left").join(latest, "id", "left")
    how = F.when(F.col("exact"), "exact").when(F.col("latest").isNotNull(), "latest").otherwise("missing")
    return found.select("id", "version", F.when(F.col("exact"), F.col("version")).otherwise(F.col("latest")).alias("resolved"), how.alias("how"))


def conflicts(incoming: DataFrame, existing: DataFrame, open_states: list) -> DataFrame:
    """Incoming datasets (id, version) with ``action``: insert, replace (the existing one is open) or reject."""
    e = existing.groupBy("id", "version").agg(F.max("state").alias("state"))
    action = F.when(F.col("state").isNull(), "insert").when(F.col("state").isin(open_states), "replace").otherwise("reject")
    return incoming.join(e, ["id", "version"], "left").select("id", "version", action.alias("action"))
