"""Column expressions over the two people of a crash row (suffix 1 and 2)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from kerbside.config import (
    BIKE_ROLES,
    CAR_TYPES,
    PED_ROLES,
    TRUCK_SUV_TYPES,
    VULNERABLE_ROLES,
)
from kerbside.functions.nulls import as_col, in_set, one_of

# --- fixed values: output labels -------------------------------------------------------
ROLE_LABELS = {
    "en": ("Bicyclist", "Pedestrian"),
    "es": ("Ciclista", "Peatón"),
}
# --------------------------------------------------------------------------------------


def is_role(unit: int, roles: Iterable[str]) -> Column:
    return in_set(f"ROLE{unit}", roles)


def pick_by_role(
    attr1: Column | str,
    attr2: Column | str,
    roles: Iterable[str] = VULNERABLE_ROLES,
    fallback: bool = False,
) -> Column:
    """The attribute of the first unit whose role is in ``roles``.

    With ``fallback`` unit 2 is taken whenever unit 1 does not qualify, even if unit 2
    does not qualify either.
    """
    roles = tuple(roles)
    first = F.when(is_role(1, roles), as_col(attr1))
    if fallback:
        return first.otherwise(as_col(attr2))
    return first.when(is_role(2, roles), as_col(attr2))


def vulnerable_role(lang: str = "en") -> Column:
    bicyclist, pedestrian = ROLE_LABELS[lang]
    return F.when(is_role(1, BIKE_ROLES) | is_role(2, BIKE_ROLES), bicyclist).when(
        is_role(1, PED_ROLES) | is_role(2, PED_ROLES), pedestrian
    )


def vehicle_bucket(other: Column | str | None = None) -> Column:
    """Bucket of the other unit's vehicle; an unknown vehicle is ``Other``."""
    if other is None:
        other = F.when(is_role(1, VULNERABLE_ROLES), F.col("VEHTYPE2")).otherwise(
            F.col("VEHTYPE1")
        )
    other = as_col(other)
    return (
        F.when(other.isin(*TRUCK_SUV_TYPES), "Truck/SUV")
        .when(other.isin(*CAR_TYPES), "Car")
        .otherwise("Other")
    )


def is_youth(
    roles: Iterable[str] = VULNERABLE_ROLES, max_age: float | None = 18
) -> Column:
    """Row filter: someone in ``roles`` is younger than ``max_age`` (``None``: any age)."""
    roles = tuple(roles)
    one, two = one_of("ROLE1", roles), one_of("ROLE2", roles)
    if max_age is None:
        return one | two
    return (one & (F.col("age1") < max_age)) | (two & (F.col("age2") < max_age))


def is_severe_vulnerable(roles: Iterable[str], codes: Iterable[str]) -> Column:
    """Row filter: someone in ``roles`` has one of the injury ``codes``, unit by unit."""
    roles, codes = tuple(roles), tuple(codes)
    return (one_of("ROLE1", roles) & one_of("INJSVR1", codes)) | (
        one_of("ROLE2", roles) & one_of("INJSVR2", codes)
    )


def age_band(age: Column | str, limit: float = 18) -> Column:
    return F.when(as_col(age) <= limit, "child").when(as_col(age) > limit, "adult")
