"""Units, constants, the header of a simulation, and scale factors."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units in cgs, and the critical density today in 1e10 Msun / Mpc^3 with h taken out.
SOLAR_MASS_IN_CGS = 1.989e33
YEAR_IN_CGS = 365 * 24 * 3600.0
KPC_IN_CGS = 3.0856e21
KM_PER_SEC_IN_CGS = 1e5
RHOCRIT0 = 27.755

GAS, DM, STAR, BH = 0, 1, 4, 5
LOW_RES_TYPES = (2, 3, 7)


@dataclass(frozen=True)
class SimHeader:
    scale_factor: float = 1.0
    box_size: float = 0.0
    omega0: float = 0.0
    omega_lambda: float = 0.0
    hubble: float = 1.0
    omega_bar: float | None = None
    num_part: tuple[int, ...] = (0,) * 6
    mass_table: tuple[float, ...] = (0.0,) * 6
    n_files: int = 1
    snapnum: int = 0
    extra: dict = field(default_factory=dict)

    @property
    def redshift(self) -> float:
        """0 where the scale factor isn't positive."""
        return 1.0 / self.scale_factor - 1.0 if self.scale_factor > 0 else 0.0


def redshift(a: Column) -> Column:
    """0 where the scale factor isn't positive."""
    return F.when(a > 0, 1.0 / a - 1.0).otherwise(0.0)


def scale_factor(z: Column) -> Column:
    return 1.0 / (1.0 + z)


def critical_density(a: Column, omega0: float, omega_lambda: float, corrected: bool = False) -> Column:
    """By default with the square root of E(a)^2, as users of the method have it; ``corrected`` leaves it out."""
    e2 = omega0 / (a * a * a) + omega_lambda
    return RHOCRIT0 * (e2 if corrected else F.sqrt(e2))


def r200(mass: Column, a: Column, omega0: float, omega_lambda: float, factor: float = 1.0, corrected: bool = False) -> Column:
    """The physical radius within which the mean density is 200 times critical."""
    rho = critical_density(a, omega0, omega_lambda, corrected)
    return factor * F.pow(3.0 * mass / (4.0 * math.pi) / 200.0 / rho, F.lit(1.0 / 3.0)) * a
