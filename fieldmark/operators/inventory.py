"""Players and teams over the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.functions.scalars import joined_set


def player_inventory(catalog: DataFrame) -> DataFrame:
    """One row for each player and team. Days are grouped first, so that what is counted is distinct already and sets hold years and months alone."""
    days = catalog.groupBy("player_id", "team", "year", "month", "date").agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"))
    return days.groupBy("player_id", "team").agg(
        F.sum("files").alias("session_files"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        joined_set(F.col("year").cast("string")).alias("years"),
        F.size(F.collect_set("month")).cast("long").alias("months"),
        F.count("date").alias("active_dates"),
        F.sum("bytes").alias("total_size_bytes"),
    )


def ordered(inventory: DataFrame) -> DataFrame:
    return inventory.orderBy("team", F.desc("session_files"), "player_id")


def multi_team_players(catalog: DataFrame) -> DataFrame:
    teams = catalog.groupBy("player_id").agg(F.array_sort(F.collect_set("team")).alias("t"))
    return teams.where(F.size("t") > 1).select("player_id", F.size("t").alias("n_teams"), F.array_join("t", ";").alias("teams"))


def players_by_team(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy("team").agg(F.count_distinct("player_id").alias("players"))


def session_count_stats(inventory: DataFrame) -> DataFrame:
    n = F.col("session_files")
    return inventory.agg(F.min(n).alias("minimum"), F.max(n).alias("maximum"), F.avg(n).alias("mean"))


def inventory_totals(inventory: DataFrame) -> DataFrame:
    """Distinct players, player-team rows and players of several teams; a first sum per player keeps it one shuffle."""
    per_player = inventory.groupBy("player_id").agg(F.count(F.lit(1)).alias("n"))
    return per_player.agg(F.count(F.lit(1)).alias("players"), F.coalesce(F.sum("n"), F.lit(0)).alias("player_team_rows"), F.count_if(F.col("n") > 1).alias("multi_team_players"))
