"""Three-phase electrics and status helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def three_phase_kw(volts: Column, currents: list[Column], power_factor: Column) -> Column:
    """Active power of a balanced three-phase load: sqrt(3) U I pf / 1000 with the mean of the phase currents."""
    return F.sqrt(F.lit(3.0)) * volts * reduce(Column.__add__, currents) / len(currents) * power_factor / 1000


def phase_current(kw: Column, volts: Column, power_factor: Column) -> Column:
    """Inverse of ``three_phase_kw`` for one phase; null where voltage or power factor is 0."""
    return F.try_divide(kw * 1000, F.sqrt(F.lit(3.0)) * volts * power_factor)


def severity(status: Column) -> Column:
    """Good < Uncertain < Bad; anything else counts as Bad."""
    return F.when(status == "Good", 0).when(status == "Uncertain", 1).otherwise(2)
