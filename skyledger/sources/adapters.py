"""Views that give the driver tables the shapes of trajectory, command and log tables.

Numbers come from integer arithmetic and division alone, so that any engine gets the same inputs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyledger.sources.tables import table


def seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")).cast("double") / 1000000


def track_path(spark: SparkSession, folder: str) -> DataFrame:
    """Every event as a position report, keyed by (trajectory_id, t, event_id)."""
    e, i, u = table(spark, folder, "events"), F.col("event_id"), F.col("user_id")
    return e.select(
        i, u.alias("trajectory_id"), seconds(F.col("ts")).alias("t"), F.floor(seconds(F.col("ts")) / 3600).alias("tick"),
        (F.lit(30) + (i * 37 % 1000).cast("double") / 1000).alias("lat"), (F.lit(103) + (i * 53 % 1500).cast("double") / 1000).alias("lon"),
        (8000 + 300 * (i % 13)).cast("double").alias("alt_m"), (200 + u * 7 % 60).cast("double").alias("gs_mps"),
        (i * 61 % 360).cast("double").alias("trk_deg"), ((i % 5) - 2).cast("double").alias("vs_mps"), (F.col("event_type") != "error").alias("inside"),
    )


def tracks(spark: SparkSession, folder: str) -> DataFrame:
    """The last report of each trajectory in each tick of an hour."""
    last = Window.partitionBy("trajectory_id", "tick").orderBy(F.desc("t"), F.desc("event_id"))
    return track_path(spark, folder).withColumn("n", F.row_number().over(last)).where("n = 1").drop("n")


def _commands(spark: SparkSession, folder: str, kinds: tuple[str, ...]) -> DataFrame:
    i, u = F.col("event_id"), F.col("user_id")
    altitude = i % 2 == 0
    return table(spark, folder, "events").where(F.col("event_type").isin(*kinds)).select(
        i, F.concat(F.lit("CES"), (100 + u).cast("string")).alias("callsign"), F.when(altitude, "altitude").otherwise("speed").alias("family"),
        F.when(altitude, 300 * (i % 20) + 1200).otherwise(200 + 10 * (i % 12)).cast("double").alias("target"),
        F.when(altitude, "m").otherwise("kt").alias("unit"), seconds(F.col("ts")).alias("epoch"),
    )


def references(spark: SparkSession, folder: str) -> DataFrame:
    """Historical instructions."""
    return _commands(spark, folder, ("purchase", "signup"))


def system_commands(spark: SparkSession, folder: str) -> DataFrame:
    """Commands of the system under test, with their text."""
    target = F.col("target").cast("long").cast("string")
    text = F.when(F.col("family") == "altitude", F.concat(F.lit("ALT_M "), "callsign", F.lit(","), target, F.lit(",CLIMB")))
    return _commands(spark, folder, ("click", "view")).withColumn("command", text.otherwise(F.concat(F.lit("SPD "), "callsign", F.lit(","), target)))


def run_events(spark: SparkSession, folder: str) -> DataFrame:
    """A run's event log."""
    i, kind = F.col("event_id"), F.col("event_type")
    event = F.when(kind.isin("click", "view"), "action_executed").when(kind == "error", "command_failed").otherwise("separation_updated")
    return table(spark, folder, "events").select(
        i, event.alias("event"), F.col("user_id").alias("episode"), seconds(F.col("ts")).alias("sim_time_s"), (i % 6).alias("macro_action"),
        F.when(i % 4 == 0, "").when(i % 4 == 1, "NOOP").otherwise("ALT X,FL300").alias("command"), (i % 3 != 0).alias("command_applied"),
        F.concat(F.lit("reason "), (i % 7).cast("string")).alias("message"), (i % 5 + 5).cast("double").alias("previous_horizontal_km"),
        (i % 7 + 4).cast("double").alias("horizontal_km"),
    )


def diagnostics(spark: SparkSession, folder: str) -> DataFrame:
    """Outcomes per episode, one row an order; the newest order of an episode is its row."""
    k = F.col("o_orderkey")
    return table(spark, folder, "orders").select(
        k.alias("row_id"), (F.col("o_custkey") % 150).alias("episode"), F.concat(F.lit("0"), (k % 9).cast("string"), F.lit("_s")).alias("scenario"),
        (F.col("o_orderstatus") == "F").cast("int").alias("safe_success"), F.when(k % 11 == 0, 1.0).otherwise(0.0).alias("collision_events"),
        (k % 4).cast("double").alias("safety_violations"), (k % 13).cast("double").alias("command_count"), (k % 2).cast("double").alias("arrival"),
        F.when(F.col("o_orderstatus") == "P", -1.0).otherwise((k % 5000).cast("double") / 100).alias("min_contact_horizontal_km"),
        (k % 17).cast("double").alias("episode_return"), ((k % 5) + 5).cast("double").alias("separation_horizontal_km"),
    )
