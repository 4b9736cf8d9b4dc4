"""Parameters of a segmentation run and unit conversion."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Milliseconds per unit; a month is 30 days and a year 365.
UNIT_MS = {
    "minutes": 60_000,
    "hours": 3_600_000,
    "days": 86_400_000,
    "months": 2_592_000_000,
    "years": 31_536_000_000,
}


def unit_ms(unit: str, unit_compat: bool = True) -> int:
    """Milliseconds in a unit. Under ``unit_compat`` "seconds" means milliseconds."""
    if unit == "seconds":
        return 1 if unit_compat else 1000
    return UNIT_MS[unit]


@dataclass(frozen=True)
class Params:
    """All controls of a run; the defaults are the interactive ones."""

    prefix: str = "Album"
    date_format: str = "%Y_%m%b_%d"
    move: bool = False
    include_all: bool = True
    auto: bool = True
    separation: float = 1
    unit: str = "days"
    unit_compat: bool = True
    batch_size: int = 50
    exif_prefix: int = 131_072

    @property
    def threshold_ms(self) -> float:
        """The manual threshold in milliseconds."""
        return self.separation * unit_ms(self.unit, self.unit_compat)


def to_unit(ms: Column, unit: str, unit_compat: bool = True) -> Column:
    return ms / F.lit(unit_ms(unit, unit_compat)).cast("double")


def from_unit(value: Column, unit: str, unit_compat: bool = True) -> Column:
    return value * F.lit(unit_ms(unit, unit_compat)).cast("double")
