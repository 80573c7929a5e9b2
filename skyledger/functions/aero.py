"""Standard atmosphere, speed conversions, flight phases and an open performance model as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the international standard atmosphere and of units.
T0, P0, RHO0, R_AIR, G0 = 288.15, 101325.0, 1.225, 287.05287, 9.80665
LAPSE, T_STRAT, H_TROPO, H_SCALE = 0.0065, 216.65, 11000.0, 6341.552161
FT_M, KT_MPS, FPM_MPS = 0.3048, 0.514444, 0.00508


def temperature(h: Column) -> Column:
    return F.greatest(T0 - LAPSE * h, F.lit(T_STRAT))


def density(h: Column) -> Column:
    tropo = RHO0 * F.pow(temperature(h) / T0, 4.256848030018761)
    return tropo * F.exp(-F.greatest(h - H_TROPO, F.lit(0.0)) / H_SCALE)


def pressure(h: Column) -> Column:
    return density(h) * R_AIR * temperature(h)


def sound_speed(h: Column) -> Column:
    return F.sqrt(1.4 * R_AIR * temperature(h))


def tas_to_mach(tas: Column, h: Column) -> Column:
    return tas / sound_speed(h)


def mach_to_tas(mach: Column, h: Column) -> Column:
    return mach * sound_speed(h)


def eas_to_tas(eas: Column, h: Column) -> Column:
    return eas * F.sqrt(RHO0 / density(h))


def tas_to_eas(tas: Column, h: Column) -> Column:
    return tas * F.sqrt(density(h) / RHO0)


def cas_to_tas(cas: Column, h: Column) -> Column:
    """By the impact pressure that a calibrated speed stands for; the sign is kept."""
    p, rho = pressure(h), density(h)
    impact = P0 * (F.pow(1 + RHO0 * cas * cas / (7.0 * P0), 3.5) - 1.0)
    return F.signum(cas) * F.sqrt(7.0 * p / rho * (F.pow(1 + impact / p, 2.0 / 7.0) - 1.0))


def tas_to_cas(tas: Column, h: Column) -> Column:
    p, rho = pressure(h), density(h)
    impact = p * (F.pow(1 + rho * tas * tas / (7.0 * p), 3.5) - 1.0)
    return F.signum(tas) * F.sqrt(7.0 * P0 / RHO0 * (F.pow(impact / P0 + 1.0, 2.0 / 7.0) - 1.0))


def mach_to_cas(mach: Column, h: Column) -> Column:
    return tas_to_cas(mach_to_tas(mach, h), h)


def cas_or_mach_to_tas(speed: Column, h: Column) -> Column:
    """A speed under 2 is a Mach number, any other a calibrated speed in m/s."""
    return F.when(F.abs(speed) < 2.0, mach_to_tas(speed, h)).otherwise(cas_to_tas(speed, h))


def crossover_altitude(cas: Column, mach: Column) -> Column:
    """The height in metres at which a calibrated speed and a Mach number are the same speed."""
    ratio = (F.pow(0.2 * F.pow(cas / 340.294, 2) + 1, 3.5) - 1) / (F.pow(0.2 * mach * mach + 1, 3.5) - 1)
    return T0 / LAPSE * (1 - F.pow(ratio, LAPSE * R_AIR / G0))


def feet_rounded(metres: Column) -> Column:
    return F.bround(metres / FT_M).cast("long")


def knots_rounded(mps: Column) -> Column:
    return F.bround(mps / KT_MPS).cast("long")


PHASES = {0: "none", 1: "ground", 2: "initial climb", 3: "climb", 4: "cruise", 5: "descent", 6: "approach"}


def flight_phase(speed_kt: Column, rate_fpm: Column, alt_ft: Column) -> Column:
    """The phase number of ``PHASES``. Rules overlap; the later phase wins, so the last is asked first."""
    between = lambda x, low, high: (x >= low) & (x <= high)
    approach = between(rate_fpm, -4000, -150) & (alt_ft <= 1000) & (alt_ft >= 75)
    descent = between(rate_fpm, -4000, -150) & (alt_ft >= 1000)
    cruise = between(rate_fpm, -150, 150) & (alt_ft >= 5000)
    climb = (rate_fpm >= 150) & (alt_ft >= 1000)
    initial = (rate_fpm >= 150) & between(alt_ft, 75, 1000)
    ground = alt_ft <= 75
    out = F.when(approach, 6).when(descent, 5).when(cruise, 4).when(climb, 3).when(initial, 2)
    return out.when(ground, 1).otherwise(0)


def bank_limit(phase: Column) -> Column:
    """Degrees of bank in a turn."""
    return F.when(phase == 1, 15.0).when(phase.isin(2, 3, 4, 5, 6), 35.0).otherwise(0.0)


def drag_newton(tas: Column, h: Column, mass_kg: Column, area_m2: Column, cd0: Column, k: Column, bank: Column) -> Column:
    """Drag of a parabolic polar in a level turn of ``bank`` degrees."""
    q_s = 0.5 * density(h) * tas * tas * area_m2
    lift = mass_kg * G0 / F.cos(F.radians(bank))
    cl = lift / F.greatest(q_s, F.lit(1.0))
    return q_s * (cd0 + k * cl * cl)


def takeoff_thrust_ratio(bypass: Column, tas: Column, h: Column) -> Column:
    """Share of static thrust at take-off, by bypass ratio, Mach number and pressure."""
    mach, pr = tas_to_mach(tas, h), pressure(h) / P0
    g = 0.0606 * bypass + 0.6337
    a = -0.4327 * pr * pr + 1.3855 * pr + 0.0472
    z = 0.9106 * F.pow(pr, 3) - 1.7736 * pr * pr + 1.8697 * pr
    x = 0.1377 * F.pow(pr, 3) - 0.4374 * pr * pr + 1.3003 * pr
    loss = 0.377 * (1 + bypass) / F.sqrt((1 + 0.82 * bypass) * g) * z * mach
    return a - loss + (0.23 + 0.19 * F.sqrt(bypass)) * x * mach * mach


def fuel_flow_kg_s(ratio: Column, idle: Column, approach: Column, climb: Column, takeoff: Column) -> Column:
    """Fuel flow at a thrust ratio, by the least-squares parabola through zero of the four certified settings.

    With the settings at 7, 30, 85 and 100 percent, the two coefficients have a closed form.
    """
    x = [0.07, 0.30, 0.85, 1.0]
    s2, s3, s4 = (sum(v**n for v in x) for n in (2, 3, 4))
    flows = [idle, approach, climb, takeoff]
    sy = sum((v * f for v, f in zip(x, flows)), F.lit(0.0))
    s2y = sum((v * v * f for v, f in zip(x, flows)), F.lit(0.0))
    det = s2 * s4 - s3 * s3
    a, b = (s2 * s2y - s3 * sy) / det, (s4 * sy - s3 * s2y) / det
    return a * ratio * ratio + b * ratio


def net_thrust_newton(drag: Column, mass_kg: Column, ax: Column) -> Column:
    """What holds the drag and gives the acceleration."""
    return drag + mass_kg * ax


#: Which of an envelope's speeds bound the calibrated speed, by phase number.
_SLOWEST = {2: "vminic", 3: "vminer", 4: "vminer", 5: "vminer", 6: "vminap"}
_FASTEST = {0: "vmaxer", 1: "vmaxic", 2: "vmaxic", 3: "vmaxer", 4: "vmaxer", 5: "vmaxer", 6: "vmaxap"}


def within_envelope(tas: Column, vs: Column, h: Column, ax: Column, own_tas: Column, phase: Column, envelope: Column) -> Column:
    """A struct ``(tas, vs, h)`` of what an aircraft of that envelope may do of what is asked for.

    ``envelope`` has ``vminto, vminic, vminer, vminap, vmaxic, vmaxer, vmaxap, vsmin, vsmax, hmax, axmax``. Heights stop at
    ``hmax``; calibrated speeds stay between the phase's bounds; rates beyond the envelope's become the greatest
    rate less what acceleration takes, and none is flown on the ground below take-off speed.
    """
    bound = lambda names: F.coalesce(*[F.when(phase == k, envelope[name]) for k, name in names.items()], F.lit(0.0))
    height = F.least(h, envelope["hmax"])
    cas = F.least(F.greatest(tas_to_cas(tas, height), bound(_SLOWEST)), bound(_FASTEST))
    most = (1 - ax / envelope["axmax"]) * envelope["vsmax"]
    rate = F.when((vs > 0) & (vs > envelope["vsmax"]), most).when((vs < 0) & (vs < envelope["vsmin"]), most).otherwise(vs)
    rate = F.when((phase == 1) & (own_tas < envelope["vminto"]), 0.0).otherwise(rate)
    return F.struct(cas_to_tas(cas, height).alias("tas"), rate.alias("vs"), height.alias("h"))
