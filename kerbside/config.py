"""Role and severity constants and the run configuration."""

from __future__ import annotations

from dataclasses import dataclass, fields

# --- fixed values: must equal the source data's codes --------------------------------
BIKE_ROLES = ("BIKE", "O BIKE")
PED_ROLES = ("PED", "O PED", "PED NO")
VULNERABLE_ROLES = BIKE_ROLES + PED_ROLES
NARROW_ROLES = ("BIKE", "PED")
DRIVER_ROLES = ("DR",)

INJURY_CODES = ("A", "K", "B")
SEVERE_CODES = ("K", "A")
FATAL_CODES = ("K",)

TRUCK_SUV_TYPES = ("SUV", "UT TRK")
CAR_TYPES = ("CAR",)
DRIVER_VEHICLE_TYPES = ("CAR", "SUV", "UT TRK")

METRES_PER_MILE = 1609
METRES_PER_DEGREE = 111320
DEFAULT_WALK_MILES = 2.0
WALK_MARGIN_M = 500
# --------------------------------------------------------------------------------------

YMD_FORMATS = ("yyyy-M-d", "yyyy/M/d", "yyyyMMdd")
MDY_FORMATS = ("M/d/yyyy", "M-d-yyyy")

ALL = "ALL"


@dataclass(frozen=True)
class RunConfig:
    """Which schools a run covers. ``ALL`` (any case) switches a filter off."""

    county_focus: tuple[str, ...] | None = None
    school_type_focus: tuple[str, ...] | None = None
    district_focus: tuple[str, ...] | None = None
    bike_lts: bool = False
    refresh_basemaps: bool = False
    parallel_workers: int = 1

    @classmethod
    def from_dict(cls, values: dict) -> RunConfig:
        known = {f.name for f in fields(cls)}
        unknown = set(values) - known
        if unknown:
            raise ValueError(f"unknown run parameters: {sorted(unknown)}")
        out = dict(values)
        for name in ("county_focus", "school_type_focus", "district_focus"):
            out[name] = _focus_values(out.get(name))
        for name in ("bike_lts", "refresh_basemaps"):
            out[name] = _flag(out.get(name, False))
        out["parallel_workers"] = int(out.get("parallel_workers", 1))
        return cls(**out)

    @classmethod
    def from_yaml(cls, path: str) -> RunConfig:
        """Read a flat ``name: value`` parameter file."""
        values = {}
        with open(path, encoding="utf-8") as lines:
            for line in lines:
                text = line.split("#", 1)[0].strip()
                if text:
                    name, _, value = text.partition(":")
                    values[name.strip()] = value.strip().strip("\"'")
        return cls.from_dict(values)


def _focus_values(value) -> tuple[str, ...] | None:
    if value is None:
        return None
    items = (value,) if isinstance(value, str) else tuple(value)
    return None if any(v.upper() == ALL for v in items) else items


def _flag(value) -> bool:
    if isinstance(value, str):
        return value.strip().lower() in ("yes", "true", "on")
    return bool(value)
