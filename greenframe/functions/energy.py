"""Power, CO2 and score expressions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from greenframe.functions import fixed_values as fixed


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def cpu_power_w(percent, tdp: float = fixed.CPU_TDP_W) -> Column:
    """Watts drawn by a CPU at ``percent`` load."""
    return _col(percent) / 100.0 * F.lit(tdp)


def gpu_power_w(percent, reading=None, max_w: float = fixed.GPU_MAX_W) -> Column:
    """The sensor reading where there is one, else a share of ``max_w``."""
    estimate = _col(percent) / 100.0 * F.lit(max_w)
    return estimate if reading is None else F.coalesce(_col(reading), estimate)


def co2_g_per_s(watts, emission_factor: float = fixed.EMISSION_FACTOR_G_PER_KWH) -> Column:
    return _col(watts) / 3_600_000.0 * F.lit(emission_factor)


def co2_kg_per_h(g_per_s) -> Column:
    return _col(g_per_s) * 3.6


def estimate_tdp(cores, mhz) -> Column:
    """Thermal design power of a host from its core count and top clock."""
    cores, mhz = _col(cores), _col(mhz)
    fast = F.when(cores >= 8, 125.0).when(cores >= 4, 95.0)
    medium = F.when(cores >= 6, 65.0).when(cores >= 4, 45.0)
    picked = F.when(mhz > 4000, fast).when(mhz > 3000, medium)
    return F.coalesce(picked, F.lit(fixed.CPU_TDP_W))


def co2_equivalents(grams) -> dict[str, Column]:
    """CO2 as phone charges, car distance and LED lamp hours."""
    grams = _col(grams)
    emitted = F.when(grams > 0, grams).otherwise(0.0)
    return {
        "phones": emitted / fixed.GRAMS_PER_PHONE_CHARGE,
        "car_km": emitted / fixed.GRAMS_PER_CAR_KM,
        "car_m": emitted / fixed.GRAMS_PER_CAR_KM * 1000.0,
        "led_hours": grams * fixed.LED_HOURS_PER_GRAM,
    }


def green_score(co2_g, rows, seconds) -> Column:
    """0..100: rows per gram and second on a log scale from 0.1 to 100 000."""
    co2_g, rows, seconds = _col(co2_g), _col(rows), _col(seconds)
    efficiency = rows / (F.greatest(co2_g, F.lit(1e-4)) * F.greatest(seconds, F.lit(1e-4)))
    # log10 of a non-positive value is NULL, which the middle branch has taken out already
    scaled = (F.log10(F.when(efficiency > 0, efficiency)) + 1.0) / 6.0 * 100.0
    clamped = F.least(F.greatest(scaled, F.lit(0.0)), F.lit(100.0))
    return (
        F.when((co2_g <= 0) | (seconds <= 0), 100)
        .when(rows <= 0, 0)
        .otherwise(clamped.cast("int"))
    )


def score_zone(score) -> Column:
    score = _col(score)
    return (
        F.when(score >= 80, "Excellent")
        .when(score >= 60, "Good")
        .when(score >= 40, "Fair")
        .otherwise("Poor")
    )


def power_band(watts, max_w: float = 200.0) -> Column:
    watts = _col(watts)
    return F.when(watts < max_w * 0.3, "low").when(watts < max_w * 0.7, "medium").otherwise("high")


def power_alarm(watts, max_w: float = 200.0) -> Column:
    return _col(watts) >= max_w * 0.9
