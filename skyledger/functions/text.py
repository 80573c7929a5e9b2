"""Parsing of callsigns, commands, times, levels and coordinates from text, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from skyledger.functions import aero

# Instruction kinds by the names that logs use, unit names, tolerances of a match.
FAMILIES = {
    "altitude_change": "altitude", "altitude_maintain": "altitude", "altitude": "altitude", "level": "altitude", "speed_adjust": "speed",
    "speed_procedure": "speed", "speed": "speed", "heading_change": "heading", "heading": "heading", "course": "heading",
}
UNITS = {"degree": "deg", "degrees": "deg", "knot": "kt", "knots": "kt", "kts": "kt", "meter": "m", "meters": "m", "feet": "ft"}
TOLERANCE = {"altitude m": 100.0, "altitude ft": 300.0, "altitude fl": 3.0, "speed kt": 10.0, "speed mps": 5.0, "heading deg": 10.0}
# Spoken digits and what they stand for.
SPOKEN, WRITTEN = "零洞幺一两二三四五六拐七八九", "00112234567789"


def lookup(table: dict, key: Column) -> Column:
    """The entry of a fixed table, or null."""
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def callsign(value: Column) -> Column:
    """Letters and digits in capitals, if there are 2 to 8 with at least one of each; else null."""
    bare = F.upper(F.regexp_replace(F.coalesce(value, F.lit("")), "[^A-Za-z0-9]", ""))
    return F.when(bare.rlike("^[A-Z0-9]{2,8}$") & bare.rlike("[A-Z]") & bare.rlike("[0-9]"), bare)


def spoken_digits(value: Column) -> Column:
    """Spoken or written digits as ASCII, if there are 2 to 6 and nothing else; else null."""
    digits = F.translate(F.regexp_replace(F.coalesce(value, F.lit("")), r"\s+", ""), SPOKEN, WRITTEN)
    return F.when(digits.rlike("^[0-9]{2,6}$"), digits)


def family(value: Column) -> Column:
    return lookup(FAMILIES, F.lower(F.trim(F.coalesce(value, F.lit("")))))


def finite(value: Column) -> Column:
    """A finite number, or null."""
    x = value.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def unit(value: Column) -> Column:
    low = F.lower(F.coalesce(value, F.lit("")))
    return F.coalesce(lookup(UNITS, low), low)


def target_match(kind: Column, ref: Column, ref_unit: Column, own: Column, own_unit: Column) -> Column:
    """Whether two targets agree within the tolerance of their kind and unit; null if either has no number."""
    a, b = finite(ref), finite(own)
    limit = lookup(TOLERANCE, F.concat_ws(" ", kind, unit(ref_unit)))
    gap = F.when(kind == "heading", F.abs(F.pmod(a - b + 180.0, F.lit(360.0)) - 180.0)).otherwise(F.abs(a - b))
    same = F.coalesce((unit(ref_unit) == unit(own_unit)) & (gap <= limit), F.lit(False))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("boolean")).otherwise(same)


def parsed_command(text: Column) -> Column:
    """A command's kind, aircraft, target, unit and action; null if it is none of the forms that are known.

    ``ALT_M acid,metres[,CLIMB|DESCEND]``, ``ALT acid,FLnnn|feet[,rate]``, ``SPD acid,knots``, ``HDG acid,degrees``.
    """
    t = F.upper(F.trim(text))
    part = lambda pattern, n: F.regexp_extract(t, pattern, n)
    alt_m, alt = r"^ALT_M\s+([A-Z0-9]+)\s*,\s*([0-9.]+)\s*(?:,\s*(CLIMB|DESCEND))?$", r"^ALT\s+([A-Z0-9]+)\s*,\s*(FL)?([0-9]+)(?:\s*,.*)?$"
    spd, hdg = r"^SPD\s+([A-Z0-9]+)\s*,\s*([0-9.]+)$", r"^HDG(?:TRK)?\s+([A-Z0-9]+)\s*,\s*([0-9.]+)$"

    def made(kind: str, acid: Column, target: Column, of: str, action: Column) -> Column:
        return F.struct(F.lit(kind).alias("family"), acid.alias("callsign"), target.alias("target"), F.lit(of).alias("unit"), action.alias("action"))

    feet = F.when(part(alt, 2) == "FL", part(alt, 3).try_cast("double") * 100).otherwise(part(alt, 3).try_cast("double"))
    none = F.lit(None).cast("string")
    return (
        F.when(t.rlike(alt_m), made("altitude", part(alt_m, 1), part(alt_m, 2).try_cast("double"), "m", F.lower(F.nullif(part(alt_m, 3), F.lit("")))))
        .when(t.rlike(alt), made("altitude", part(alt, 1), F.bround(feet * 0.3048, 1), "m", none))
        .when(t.rlike(spd), made("speed", part(spd, 1), part(spd, 2).try_cast("double"), "kt", F.lit("set_speed")))
        .when(t.rlike(hdg), made("heading", part(hdg, 1), part(hdg, 2).try_cast("double"), "deg", F.lit("set_heading")))
    )


def candidate_name(kind: Column, target: Column) -> Column:
    whole = F.bround(target).cast("long").cast("string")
    return F.when(kind == "hold", "HOLD").otherwise(F.concat(F.when(kind == "altitude", "ALT_").otherwise("SPD_"), whole))


def command_text(acid: Column, kind: Column, target: Column, direction: Column) -> Column:
    """The command of a candidate; null for holding."""
    whole = F.bround(target).cast("long").cast("string")
    suffix = F.when(direction == "climb", ",CLIMB").when(direction == "descend", ",DESCEND").otherwise("")
    return F.when(kind == "altitude", F.concat(F.lit("ALT_M "), acid, F.lit(","), whole, suffix)).when(kind == "speed", F.concat(F.lit("SPD "), acid, F.lit(","), whole))


def or_missing(value: Column) -> Column:
    """The trimmed text, or ``MISSING`` for null, blank and NaN."""
    t = F.trim(value.cast("string"))
    return F.when(t.isNull() | (t == "") | (t == "NaN"), "MISSING").otherwise(t)


def metric_level(value: Column) -> Column:
    """``S0600`` as 6000 metres; null if it is no level."""
    return F.regexp_replace(F.upper(F.trim(value)), "^S", "").try_cast("double") * 10


def planned_speed_kt(value: Column) -> Column:
    """``K0800`` (km/h) or ``N0430`` or a bare number, in knots."""
    t = F.upper(F.trim(value))
    rest = F.substring(t, 2, 10).try_cast("double")
    return F.when(t.startswith("K"), rest / 1.852).when(t.startswith("N"), rest).otherwise(t.try_cast("double"))


def altitude_ft(text: Column) -> Column:
    """``FL100`` or feet; -1e9 if it is neither."""
    t = F.upper(F.trim(text))
    level = F.substring(t, 3, 10).try_cast("double") * 100
    return F.coalesce(F.when(t.startswith("FL"), level).otherwise(t.try_cast("double")), F.lit(-1e9))


def speed_mps(text: Column, h: Column) -> Column:
    """True airspeed of ``M78``, ``M.78``, ``.78`` (Mach numbers) or knots of calibrated speed, at a height; -1 if it is neither."""
    number = F.substring(text, 2, 20).try_cast("double")
    mach = F.when(text.startswith("M"), F.when(number >= 20, number * 0.01).otherwise(number))
    mach = F.when(text.rlike(r"^0?\."), text.try_cast("double")).otherwise(mach)
    tas = F.when(text.startswith("M") | text.rlike(r"^0?\."), aero.mach_to_tas(mach, h)).otherwise(aero.cas_to_tas(text.try_cast("double") * aero.KT_MPS, h))
    return F.coalesce(tas, F.lit(-1.0))


def phase_of_flight(departure: Column, destination: Column, airports: Sequence[str]) -> Column:
    """Departure, arrival or overflight, as seen from a terminal area with these airports."""
    at = lambda name: F.coalesce(F.upper(F.trim(name)).isin(*airports), F.lit(False))
    return F.when(at(departure), "departure").when(at(destination), "arrival").otherwise("overflight")


def vertical_phase(rate_mps: Column) -> Column:
    """Climbing or descending from half a metre a second on."""
    return F.when(rate_mps > 0.5, "climbing").when(rate_mps < -0.5, "descending").when(rate_mps.isNotNull(), "level").otherwise("unknown")


def clock_seconds(text: Column) -> Column:
    """Seconds of ``HH``, ``HH:MM`` or ``HH:MM:SS.ss``; null if a part is no number."""
    parts = F.split(F.trim(text), ":")
    value = lambda k: F.when(F.size(parts) > k, F.get(parts, F.lit(k)).try_cast("double")).otherwise(0.0)
    return F.when(F.size(parts) <= 3, value(0) * 3600 + value(1) * 60 + value(2))


def coordinate(text: Column) -> Column:
    """Degrees from decimal text or from ``N52'18'33.5``, with a hemisphere letter in front or behind."""
    t = F.upper(F.trim(text))
    sign = F.when(t.rlike("[SW]") | t.startswith("-"), -1.0).otherwise(1.0)
    parts = F.split(F.regexp_replace(F.regexp_replace(t, "[NSEW+-]", ""), "[\"°]", "'"), "'")
    value = lambda k: F.when(F.get(parts, F.lit(k)) != "", F.get(parts, F.lit(k)).try_cast("double")).otherwise(0.0)
    zero = lambda k: F.coalesce(value(k), F.lit(0.0))
    return sign * (value(0) + zero(1) / 60 + zero(2) / 3600)


def latitude_text(lat: Column) -> Column:
    """``N30'15'36.0``."""
    a = F.abs(lat)
    d = F.floor(a)
    m = F.floor((a - d) * 60)
    s = F.round((a - d - m / 60) * 3600, 1)
    return F.concat(F.when(lat < 0, "S").otherwise("N"), F.lpad(d.cast("string"), 2, "0"), F.lit("'"), F.lpad(m.cast("string"), 2, "0"), F.lit("'"), F.lpad(F.format_string("%.1f", s), 4, "0"))


def iso_epoch(text: Column) -> Column:
    """Seconds since 1970 of an ISO time; a text without a zone is UTC."""
    return F.unix_micros(F.try_to_timestamp(F.trim(text))).cast("double") / 1000000


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
