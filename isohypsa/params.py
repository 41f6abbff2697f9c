"""Grid geometry and detection parameters.

Everything that is bounded by the *grid* (and so never grows with the number of
instants) is derived from a ``GridSpec``. What operators broadcast is bounded by the grid's
rows (rows x bearings, rows x rays), what a group holds by its cells.
"""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values of the domain.
GRAVITY = 9.80665
EARTH_RADIUS_KM = 6371
KELVIN_OFFSET = 273.15
UNSET = 1.0e30


@dataclass(frozen=True)
class GridSpec:
    """A global north-first grid (lat 90..-90, lon -180..180-res) and its thresholds."""

    res: float = 0.25
    step: int = 5
    lat_min: float = 25
    dist_km: float = 500
    n_bearings: int = 64
    bearing_start: int = -180
    bearing_step: float = 5
    pass_percent: float = 0.9
    contour_step: int = 20
    search_km: float = 3000
    rex_dlon: float = 10
    band: tuple[float, float] = (30.0, 85.0)
    scale: float | None = None
    offset: float = 0.0
    compat: bool = True

    @property
    def nlat(self) -> int:
        return int(180 / self.res) + 1

    @property
    def nlon(self) -> int:
        return int(360 / self.res)

    @property
    def n_cells(self) -> int:
        return self.nlat * self.nlon

    @property
    def north(self) -> int:
        """Row offset: row = north - lat / res."""
        return int(90 / self.res)

    @property
    def west(self) -> int:
        """Column offset: column = lon / res + west."""
        return int(180 / self.res)

    @property
    def row_limit(self) -> float:
        """Row number of ``lat_min``."""
        return self.north - self.lat_min / self.res

    @property
    def size_x(self) -> int:
        return int(self.row_limit / self.step) + 1

    @property
    def size_y(self) -> int:
        return int(self.nlon / self.step)

    @property
    def n_coarse(self) -> int:
        return self.size_x * self.size_y

    @property
    def threshold(self) -> int:
        return int(self.n_bearings * self.pass_percent)

    @property
    def eps(self) -> float:
        return self.res * self.step
