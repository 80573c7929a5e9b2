"""Text logs with ``#`` headers as tables of ``(file, line, value)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

c = F.col

# The columns of a flight statistics log, in order.
FLIGHT_STATS = (
    "deleted_s", "callsign", "spawned_s", "flight_s", "distance_2d_m", "distance_3d_m", "work_j", "lat", "lon", "alt_m", "tas_mps", "vs_mps",
    "hdg_deg", "resolving", "pilot_alt_m", "pilot_tas_mps", "pilot_vs_mps", "pilot_hdg_deg",
)
_TEXT, _FLAG = {"callsign"}, {"resolving"}


def state_log(lines: DataFrame) -> DataFrame:
    """``file, line, fields``: each row as a map from the names in its file's last comment line to texts.

    Rows with another number of fields than names are left out. Names are a row per file, joined by the file.
    """
    comment = F.ltrim("value").startswith("#")
    names = lines.where(comment).groupBy("file").agg(F.max_by("value", "line").alias("names"))
    names = names.select("file", F.transform(F.split(F.regexp_replace("names", r"^\s*#\s*", ""), ","), lambda x: F.trim(x)).alias("names"))
    rows = lines.where(~comment & (F.trim("value") != "")).select("file", "line", F.transform(F.split("value", ","), lambda x: F.trim(x)).alias("parts"))
    joined = rows.join(names, "file").where(F.size("names") == F.size("parts"))
    return joined.select("file", "line", F.map_from_arrays("names", "parts").alias("fields"))


def flight_stats_log(lines: DataFrame) -> DataFrame:
    """Rows of a flight statistics log, typed. Comment lines and rows of another length are left out."""
    rows = lines.where(~F.ltrim("value").startswith("#")).select("file", "line", F.transform(F.split("value", ","), lambda x: F.trim(x)).alias("p"))
    kind = lambda name: "string" if name in _TEXT else "boolean" if name in _FLAG else "double"
    typed = [c("p")[k].try_cast(kind(name)).alias(name) for k, name in enumerate(FLIGHT_STATS)]
    return rows.where(F.size("p") == len(FLIGHT_STATS)).select("file", "line", *typed)
