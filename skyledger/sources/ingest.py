"""Text, JSON, CSV and binary sources of navigation, log and surveillance data as tables.

Parsers take lines as a table ``(file, line, value)``: ``text_lines`` reads them from files, and any other table of that
shape will do. ``line`` orders the lines of a file. Lines that do not parse are dropped or kept with a reason, as said.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

c = F.col
FT_M = 0.3048


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of text files. Files are read whole, one row each, so that lines keep their number."""
    files = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    return files.select("file", F.posexplode(F.split("value", "\r?\n"))).select("file", (c("pos") + 1).cast("long").alias("line"), c("col").alias("value"))


def part(n: int, value: str = "value", pattern: str = r"\s+") -> Column:
    """The ``n``-th field of a trimmed line, from 0; null if there is none."""
    return F.get(F.split(F.trim(value), pattern), F.lit(n))


def json_objects(lines: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of JSON lines, and the lines that are no JSON object, for quarantine. Blank lines are neither."""
    full = lines.where(F.trim("value") != "")
    parsed = full.withColumn("bad", F.coalesce(F.try_parse_json("value").isNull() | ~F.ltrim("value").startswith("{"), F.lit(True)))
    good = parsed.where("not bad").withColumn("r", F.from_json("value", schema)).select("file", "line", "r.*")
    return good, parsed.where("bad").select("file", "line", "value")


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines with the columns in order of name."""
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path)


def diagnostics_csv(lines: DataFrame) -> DataFrame:
    """Episode rows of a diagnostics file with a header line: byte-order mark and rows without an episode are dropped,
    and the last row of an episode counts. Values stay text in a map, as headers change between runs.

    Headers, a row per file, are sent to all tasks, so that no file has to pass through one; last rows are found by their numbers
    alone, of which an episode and file keep one, and the lines are then taken by them.
    """
    clean = lines.withColumn("value", F.regexp_replace("value", "^﻿", "")).where(F.trim("value") != "")
    names = clean.where("line = 1").select("file", F.split("value", ",").alias("names"))
    rows = clean.where("line > 1").join(F.broadcast(names), "file").withColumn("m", F.map_from_arrays("names", F.slice(F.split("value", ","), F.lit(1), F.size("names"))))
    rows = rows.withColumn("episode", c("m")["episode"].try_cast("int")).where("episode is not null")
    ends = rows.groupBy("episode", "file").agg(F.max("line").alias("line"))
    last = ends.groupBy("episode").agg(F.max(F.struct("file", "line")).alias("at")).select("episode", "at.file", "at.line")
    return rows.join(last, ["episode", "file", "line"]).select("episode", c("m").alias("fields"))


# Type codes of radio aids.
AID_TYPES = {"2": "NDB", "3": "VOR", "4": "ILS", "5": "LOC", "6": "GS", "7": "OM", "8": "MM", "9": "IM", "12": "DME", "13": "TACAN"}


def waypoints(nav: DataFrame, fixes: DataFrame) -> DataFrame:
    """Radio aids (``code lat lon elevation_ft frequency range variation id name``) and fixes (``lat lon id``) in one table."""
    kind = F.create_map(*[F.lit(x) for pair in AID_TYPES.items() for x in pair])[part(0)]
    freq = part(4).try_cast("double")
    aids = nav.select(
        part(7).alias("id"), kind.alias("type"), part(1).try_cast("double").alias("lat"), part(2).try_cast("double").alias("lon"),
        (part(3).try_cast("double") * FT_M).alias("elev_m"), F.when(kind == "NDB", freq).otherwise(freq / 100).alias("freq"),
    ).where(c("type").isin("NDB", "VOR", "DME", "TACAN"))
    none = F.lit(None).cast("double")
    return aids.unionByName(fixes.select(part(2).alias("id"), F.lit("FIX").alias("type"), part(0).try_cast("double").alias("lat"), part(1).try_cast("double").alias("lon"), none.alias("elev_m"), none.alias("freq"))).where("lat is not null and lon is not null")


def airways(lines: DataFrame) -> DataFrame:
    """Legs ``from lat lon to lat lon dir low high id``; an id ``A-B`` is a leg of both airways. Short lines and lines
    whose first coordinate is no number are dropped."""
    whole = lines.where((F.size(F.split(F.trim("value"), r"\s+")) >= 10) & part(1).try_cast("double").isNotNull())
    num = lambda n: part(n).try_cast("double")
    return whole.select(
        F.explode(F.split(part(9), "-")).alias("airway"), part(0).alias("from_id"), num(1).alias("lat1"), num(2).alias("lon1"), part(3).alias("to_id"),
        num(4).alias("lat2"), num(5).alias("lon2"), num(7).alias("low_fl"), num(8).alias("high_fl"),
    )


def airports(lines: DataFrame) -> DataFrame:
    """``id, name, lat, lon, size, runway_ft, elevation_ft, country``; blank ids and closed ones are dropped, bad numbers are 0."""
    f = lambda n: F.trim(F.get(F.split("value", ","), F.lit(n)))
    size = F.when(f(4).startswith("L"), 1).when(f(4).startswith("M"), 2).when(f(4).startswith("S"), 3)
    zero = lambda n: F.coalesce(f(n).try_cast("double"), F.lit(0.0)) * FT_M
    rows = lines.where((f(0) != "") & (f(4) != "Closed"))
    return rows.select(f(0).alias("id"), f(1).alias("name"), f(2).try_cast("double").alias("lat"), f(3).try_cast("double").alias("lon"), size.alias("size"), zero(5).alias("runway_m"), zero(6).alias("elev_m"), f(7).alias("country"))


def countries(lines: DataFrame) -> DataFrame:
    f = lambda n: F.trim(F.get(F.split("value", ","), F.lit(n)))
    return lines.where(F.size(F.split("value", ",")) >= 4).select(f(0).alias("name"), f(1).alias("code2"), f(2).alias("code3"), f(3).try_cast("int").alias("number"))


def signed_dms(text: Column) -> Column:
    """``N0301530``-like: hemisphere, three digits of degrees, two each of minutes and seconds; the sign holds for all."""
    sign = F.when(F.substring(text, 1, 1).isin("S", "W"), -1.0).otherwise(1.0)
    num = lambda a, n: F.substring(text, a, n).try_cast("double")
    return sign * (num(2, 3) + num(5, 2) / 60 + num(7, 2) / 3600)


def fir_segments(lines: DataFrame) -> DataFrame:
    """Vertices ``N0301530E1031530`` in the order of their file, as lines from one to the next."""
    v = lines.where(F.length(F.trim("value")) >= 16).select("file", "line", signed_dms(F.substring(F.trim("value"), 1, 8)).alias("lat"), signed_dms(F.substring(F.trim("value"), 9, 8)).alias("lon"))
    before = Window.partitionBy("file").orderBy("line")
    return v.select("file", "line", F.lag("lat").over(before).alias("lat0"), F.lag("lon").over(before).alias("lon0"), "lat", "lon").where("lat0 is not null")


def so6_segments(lines: DataFrame) -> DataFrame:
    """Flight segments in SO6 columns: coordinates in minutes, times as HHMMSS, levels in hundreds of feet."""
    from skyledger.functions import geo

    num = lambda n: part(n).try_cast("double")
    clock = lambda n: F.substring(F.lpad(part(n), 6, "0"), 1, 2).try_cast("int") * 3600 + F.substring(F.lpad(part(n), 6, "0"), 3, 2).try_cast("int") * 60 + F.substring(F.lpad(part(n), 6, "0"), 5, 2).try_cast("int")
    s = lines.where(F.size(F.split(F.trim("value"), r"\s+")) >= 16).select(
        part(9).alias("callsign"), part(3).alias("type"), clock(4).alias("t0"), clock(5).alias("t1"), (num(6) * 100 * FT_M).alias("alt0_m"), (num(7) * 100 * FT_M).alias("alt1_m"),
        (num(12) / 60).alias("lat0"), (num(13) / 60).alias("lon0"), (num(14) / 60).alias("lat1"), (num(15) / 60).alias("lon1"),
    )
    took = F.when(c("t1") > c("t0"), c("t1") - c("t0"))
    metres = geo.distance_nm(c("lat0"), c("lon0"), c("lat1"), c("lon1")) * geo.NM_M
    return s.withColumns({"vs_mps": (c("alt1_m") - c("alt0_m")) / took, "gs_mps": metres / took})


def record_blocks(lines: DataFrame, keys: list[str]) -> DataFrame:
    """``label; value`` lines, blocks parted by lines of ``=``, as a row per block with a column for each of ``keys``."""
    order = Window.partitionBy("file").orderBy("line")
    cut = lines.withColumn("block", F.sum(F.col("value").rlike("^=+$").cast("long")).over(order)).where(F.instr("value", ";") > 0)
    pairs = cut.select("file", "block", F.trim(F.substring_index("value", ";", 1)).alias("label"), F.trim(F.expr("substring(value, instr(value, ';') + 1)")).alias("text"))
    return pairs.groupBy("file", "block").pivot("label", keys).agg(F.first("text"))


def scenario_commands(lines: DataFrame) -> DataFrame:
    """Timed commands ``HH:MM:SS.hh>COMMAND`` in stable order; comments, short lines and bad times are dropped."""
    pattern = r"^(\d{1,2}):(\d{2}):(\d{2}(?:\.\d+)?)>(.*)$"
    g = lambda n: F.regexp_extract(F.trim("value"), pattern, n)
    rows = lines.where((F.length(F.trim("value")) > 12) & ~F.trim("value").startswith("#") & F.trim("value").rlike(pattern))
    return rows.select("file", "line", (g(1).cast("double") * 3600 + g(2).cast("double") * 60 + g(3).cast("double")).alias("t"), F.trim(g(4)).alias("command"))


def split_scenarios(commands: DataFrame) -> DataFrame:
    """Commands with ``scenario``: the name of the last ``SCEN name`` before them in their file; those before any are left out."""
    order = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    named = F.when(F.upper("command").startswith("SCEN "), F.trim(F.expr("substring(command, 6)")))
    return commands.withColumns({"named": named, "scenario": F.last(named, ignorenulls=True).over(order)}).where("named is null and scenario is not null").drop("named")


def fixed_width(lines: DataFrame, spec: str, names: list[str]) -> DataFrame:
    """Columns cut by a format such as ``3X, 6S, 10F, 5I``: skip, text, float, integer; lines whose numbers are bad are dropped."""
    at, columns, checks = 1, [], F.lit(True)
    for width, kind in ((int(x.strip()[:-1]), x.strip()[-1].upper()) for x in spec.split(",")):
        if kind != "X":
            cut = F.trim(F.substring("value", at, width))
            value = cut if kind == "S" else cut.try_cast("double" if kind == "F" else "long")
            columns.append(value.alias(names[len(columns)]))
            checks = checks & value.isNotNull()
        at += width
    return lines.where(checks).select(*columns)


def state_vectors(snapshots: DataFrame) -> DataFrame:
    """Snapshots of parallel columns as rows: callsigns trimmed, rows with a missing or non-finite number dropped."""
    names = ("icao24", "callsign", "lat", "lon", "alt_m", "hdg_deg", "vs_mps", "gs_mps")
    rows = snapshots.select("time", F.explode(F.arrays_zip(*names)).alias("s")).select("time", *[c(f"s.{n}").alias(n) for n in names])
    fine = F.lit(True)
    for n in names[2:]:
        fine = fine & c(n).isNotNull() & ~F.isnan(n)
    return rows.withColumn("callsign", F.trim("callsign")).where(fine)


def modes_frames(captures: DataFrame) -> DataFrame:
    """Messages of binary captures: what ``0x1a`` parts, over 10 bytes; type 0x32 has 7 bytes of message, 0x33 has 14."""
    pieces = captures.select("path", F.posexplode(F.split(F.regexp_replace(F.hex("content"), "(..)", "$1 "), "1A "))).select("path", "pos", F.regexp_replace("col", " ", "").alias("piece"))
    kind, tail = F.substring("piece", 1, 2), F.when(F.substring("piece", 1, 2) == "32", 14).when(F.substring("piece", 1, 2) == "33", 28)
    return pieces.where((F.length("piece") > 20) & kind.isin("32", "33")).select("path", "pos", F.expr("right(piece, 28)").alias("r"), tail.alias("n")).select("path", "pos", F.expr("right(r, n)").alias("message"))


def wind_grid(cells: DataFrame, south: float, west: float, north: float, east: float) -> DataFrame:
    """Profiles of a wind grid ``(lat, lon, level_hpa, u, v)``: levels over 140 hPa, longitudes in [-180, 180), a box."""
    lon = F.pmod(c("lon") + 180.0, F.lit(360.0)) - 180.0
    g = cells.withColumn("lon", lon).where((c("level_hpa") >= 140) & c("lat").between(south, north) & c("lon").between(west, east))
    alt = (1 - F.pow(c("level_hpa") / 1013.25, 0.190284)) * 145366.45 * FT_M
    toward = F.pmod(F.degrees(F.atan2(-c("u"), -c("v"))), F.lit(360.0))
    row = F.struct(F.round(alt, 3).alias("alt_m"), F.round(toward, 3).alias("from_deg"), F.round(F.sqrt(c("u") ** 2 + c("v") ** 2), 3).alias("speed_mps"))
    return g.groupBy("lat", "lon").agg(F.sort_array(F.collect_list(row)).alias("profile"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Path, name, size and SHA-256 of every file of a folder."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.sha2("content", 256).alias("sha256"))


def catalog_faults(entries: DataFrame, fields: list[str]) -> DataFrame:
    """Blank and repeated ids of a catalog, and the fields that each entry lacks."""
    n = F.count("*").over(Window.partitionBy("id"))
    fault = F.when(F.coalesce(F.trim("id"), F.lit("")) == "", "blank id").when(n > 1, "repeated id").otherwise("")
    lacking = F.filter(F.array(*[F.when(c(f).isNull(), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    return entries.select("id", fault.alias("fault"), F.array_join(lacking, ",").alias("lacking"))


def flattened_commands(rows: DataFrame) -> DataFrame:
    """One row per command of a decision log row: ``command``, else the lists ``commands``, ``issued_commands``,
    ``decision.commands``, whichever is there first; blank ones are left out."""
    many = F.coalesce(F.when(F.trim("command") != "", F.array("command")), "commands", "issued_commands", c("decision.commands"))
    return rows.select("row_id", F.posexplode(many).alias("place", "command")).where(F.trim("command") != "")
