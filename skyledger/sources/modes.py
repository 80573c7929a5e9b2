"""Surveillance messages of 112 bits in hex text: check, fields, positions; and how to build them.

Everything is a column expression over the text. Bits are counted from 1, as their publications do.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The generator of the cyclic check, and the letters of a name's six-bit values.
GENERATOR = 0xFFF409
LETTERS = "#ABCDEFGHIJKLMNOPQRSTUVWXYZ##### ###############0123456789######"
ZONES = 131072.0


def _check_table() -> list[int]:
    """The remainder of each byte before 24 zero bits."""
    table = []
    for byte in range(256):
        rest = byte << 16
        for _ in range(8):
            rest = ((rest << 1) ^ GENERATOR) & 0xFFFFFF if rest & 0x800000 else rest << 1
        table.append(rest)
    return table


def cyclic_check(hex_text: Column) -> Column:
    """The 24-bit check of the first 88 bits: a fold over the bytes with a table of remainders."""
    table = F.array(*map(F.lit, _check_table()))
    byte = lambda k: F.conv(F.substring(hex_text, 2 * k + 1, F.lit(2)), 16, 10).cast("int")

    def step(rest: Column, k: Column) -> Column:
        at = F.shiftright(rest, 16).bitwiseXOR(byte(k)).bitwiseAND(F.lit(255))
        return F.shiftleft(rest, 8).bitwiseAND(F.lit(0xFFFFFF)).bitwiseXOR(F.get(table, at))

    return F.aggregate(F.sequence(F.lit(0), F.lit(10)), F.lit(0), step)


def well_formed(hex_text: Column) -> Column:
    """True for 28 hex digits whose last 24 bits are the check of the others; false for all else, null for null."""
    sent = F.conv(F.substring(hex_text, 23, 6), 16, 10).cast("int")
    return F.when(hex_text.rlike("^[0-9A-Fa-f]{28}$"), cyclic_check(hex_text) == sent).when(hex_text.isNotNull(), False)


def bit_text(hex_text: Column) -> Column:
    """The message as 112 characters 0 and 1."""
    half = lambda at: F.lpad(F.conv(F.substring(hex_text, at, 14), 16, 2), 56, "0")
    return F.concat(half(1), half(15))


def number(bits: Column, first: int, length: int) -> Column:
    """Bits ``first`` and on as a number."""
    return F.conv(F.substring(bits, first, length), 2, 10).cast("long")


def altitude_ft(bits: Column) -> Column:
    """Barometric altitude in steps of 25 ft; null where the message counts in other steps, or is no airborne position."""
    steps = F.conv(F.concat(F.substring(bits, 41, 7), F.substring(bits, 49, 4)), 2, 10).cast("long")
    return F.when(number(bits, 33, 5).between(9, 18) & (F.substring(bits, 48, 1) == "1"), steps * 25 - 1000)


def velocity(bits: Column) -> Column:
    """``speed_kt``, ``track_deg`` and ``climb_fpm`` of a velocity message: over ground from its components (kinds 1 and 2),
    or through the air with the heading (3 and 4). Counts of speed begin at 1, as 0 says that there is none; kinds 2
    and 4 count in fours. Null where a part is not known, or for other messages."""
    kind = F.when(number(bits, 33, 5) == 19, number(bits, 38, 3))
    step = F.when(kind.isin(2, 4), 4).otherwise(1)
    part = lambda at: F.when(number(bits, at + 1, 10) > 0, (number(bits, at + 1, 10) - 1) * step * F.when(F.substring(bits, at, 1) == "1", -1).otherwise(1)).cast("double")
    east, north = part(46), part(57)
    ground, air = kind.isin(1, 2), kind.isin(3, 4)
    airspeed = F.when(number(bits, 58, 10) > 0, (number(bits, 58, 10) - 1) * step).cast("double")
    heading = F.when(F.substring(bits, 46, 1) == "1", number(bits, 47, 10) * 360.0 / 1024)
    rate = F.when(number(bits, 70, 9) > 0, (number(bits, 70, 9) - 1) * 64 * F.when(F.substring(bits, 69, 1) == "1", -1).otherwise(1))
    track = F.pmod(F.degrees(F.atan2(east, north)), F.lit(360.0))
    return F.struct(
        F.when(ground, F.sqrt(east * east + north * north)).when(air, airspeed).alias("speed_kt"), F.when(ground, track).when(air, heading).alias("track_deg"),
        F.when(ground | air, rate).alias("climb_fpm"),
    )


def name(bits: Column) -> Column:
    """The name of an identification message, from eight values of six bits; blanks and unused values are left out."""
    letter = lambda k: F.substring(F.lit(LETTERS), F.conv(F.substring(bits, 41 + 6 * k, F.lit(6)), 2, 10).cast("int") + 1, F.lit(1))
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), letter), "")
    return F.when(number(bits, 33, 5).between(1, 4), F.translate(text, "# ", ""))


def fields(hex_text: Column) -> Column:
    """All that a message says, as a struct; what its kind does not hold is null, and so is all of one that fails the check."""
    bits = bit_text(hex_text)
    position = number(bits, 33, 5).between(9, 18)
    of = F.struct(
        number(bits, 1, 5).alias("df"), number(bits, 6, 3).alias("ca"), F.upper(F.substring(hex_text, 3, 6)).alias("icao"), number(bits, 33, 5).alias("type_code"),
        *[F.when(position, number(bits, at, n)).alias(k) for k, at, n in (("odd", 54, 1), ("cpr_lat", 55, 17), ("cpr_lon", 72, 17))],
        altitude_ft(bits).alias("alt_ft"), velocity(bits).alias("velocity"), name(bits).alias("name"),
    )
    return F.when(well_formed(hex_text), of)


def zones(lat: Column) -> Column:
    """The number of longitude zones at a latitude."""
    x = 1 - (1 - F.cos(F.pi() / 30)) / F.pow(F.cos(F.radians(lat)), 2)
    return F.when(F.abs(lat) >= 87, 1).otherwise(F.floor(2 * F.pi() / F.acos(x)))


def encoded(lat: Column, lon: Column, odd: int) -> tuple[Column, Column]:
    """Compact position of 17 bits each for an even (0) or odd (1) frame."""
    d = 360.0 / (60 - odd)
    y = F.floor(ZONES * F.pmod(lat, F.lit(d)) / d + 0.5)
    near = d * (y / ZONES + F.floor(lat / d))
    e = 360.0 / F.greatest(zones(near) - odd, F.lit(1))
    return F.pmod(y, F.lit(131072)), F.pmod(F.floor(ZONES * F.pmod(lon, e) / e + 0.5), F.lit(131072))


def decoded(y0: Column, x0: Column, y1: Column, x1: Column, odd_is_newer: Column | None = None) -> tuple[Column, Column]:
    """Latitude and longitude from an even and an odd frame, at the newer one; null if they are of different zones."""
    newer = F.lit(False) if odd_is_newer is None else odd_is_newer
    j = F.floor((59 * y0 - 60 * y1) / ZONES + 0.5)
    south = lambda x: F.when(x >= 270, x - 360).otherwise(x)
    lat0, lat1 = south(6.0 * (F.pmod(j, F.lit(60)) + y0 / ZONES)), south(360.0 / 59 * (F.pmod(j, F.lit(59)) + y1 / ZONES))
    n = zones(lat0)
    m = F.floor((x0 * (n - 1) - x1 * n) / ZONES + 0.5)
    at = F.greatest(n - newer.cast("long"), F.lit(1))
    lon = 360.0 / at * (F.pmod(m, at) + F.when(newer, x1).otherwise(x0) / ZONES)
    same = n == zones(lat1)
    return F.when(same, F.when(newer, lat1).otherwise(lat0)), F.when(same, F.when(lon > 180, lon - 360).otherwise(lon))


def _binary(value: Column, length: int) -> Column:
    return F.lpad(F.conv(value.cast("string"), 10, 2), length, "0")


def message(icao: Column, type_code: Column, rest: Column) -> Column:
    """A message of format 17 as hex text: address, type code and 51 more bits as text, with its check."""
    bits = F.concat(_binary(F.lit(17), 5), _binary(F.lit(5), 3), _binary(icao, 24), _binary(type_code, 5), rest)
    digits = lambda at, n: F.lpad(F.conv(F.substring(bits, at, 4 * n), 2, 16), n, "0")
    body = F.concat(digits(1, 11), digits(45, 11))
    return F.concat(body, F.lpad(F.conv(cyclic_check(body).cast("string"), 10, 16), 6, "0"))


def position_bits(alt_ft: Column, odd: Column, cpr_lat: Column, cpr_lon: Column) -> Column:
    steps = ((alt_ft + 1000) / 25).cast("long")
    high, low = F.shiftright(steps, 4), steps.bitwiseAND(F.lit(15))
    return F.concat(F.lit("000"), _binary(high, 7), F.lit("1"), _binary(low, 4), F.lit("0"), odd.cast("string"), _binary(cpr_lat, 17), _binary(cpr_lon, 17))


def velocity_bits(east_kt: Column, north_kt: Column, climb_fpm: Column) -> Column:
    """Speed over ground by whole knots, climb by steps of 64 feet a minute."""
    part = lambda x, n: F.concat(F.when(x < 0, "1").otherwise("0"), _binary(F.abs(x) + 1, n))
    return F.concat(F.lit("001" + "00000"), part(east_kt, 10), part(north_kt, 10), F.lit("0"), part((climb_fpm / 64).cast("long"), 9), F.lit("0" * 10))


def name_bits(text: Column) -> Column:
    """A name of up to eight letters and digits."""
    value = lambda k: F.instr(F.lit(LETTERS), F.substring(F.rpad(text, 8, " "), k, F.lit(1))) - 1
    return F.concat(F.lit("000"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda k: _binary(value(k), 6)), ""))
