"""Units of measure: spelling, category and conversion as lookups in literal maps. SQL text."""

from __future__ import annotations

from scour.functions.text import strip
from scour.schema import literal

# Category, then its units with the factor to the category's base unit.
UNIT_FACTORS = {
    "Mass": {"mg": 0.001, "g": 1.0, "kg": 1000.0, "tonne": 1000000.0},
    "Length": {"mm": 0.001, "cm": 0.01, "m": 1.0, "km": 1000.0},
    "Volume": {"ml": 0.001, "l": 1.0},
    "Time": {"ms": 0.001, "sec": 1.0, "min": 60.0, "hour": 3600.0, "day": 86400.0},
}
# Other spellings and the unit they stand for.
CANONICAL = {
    "mgs": "mg",
    "gs": "g",
    "gram": "g",
    "grams": "g",
    "kgs": "kg",
    "tonnes": "tonne",
    "t": "tonne",
    "mms": "mm",
    "cms": "cm",
    "meter": "m",
    "meters": "m",
    "metre": "m",
    "metres": "m",
    "kms": "km",
    "milliliter": "ml",
    "milliliters": "ml",
    "liter": "l",
    "liters": "l",
    "litre": "l",
    "litres": "l",
    "secs": "sec",
    "second": "sec",
    "seconds": "sec",
    "mins": "min",
    "minute": "min",
    "minutes": "min",
    "hours": "hour",
    "hr": "hour",
    "hrs": "hour",
    "days": "day",
}
UNKNOWN_CATEGORY = "Unknown"

CATEGORY = {unit: category for category, units in UNIT_FACTORS.items() for unit in units}
FACTOR = {unit: factor for units in UNIT_FACTORS.values() for unit, factor in units.items()}

_QUANTITY = r"^([-+]?\d+(?:\.\d+)?)(?U:\s*)([a-zA-Z]+)$"


def _lookup(table: dict, key: str) -> str:
    entries = ", ".join(
        f"{literal(name)}, {literal(value) if isinstance(value, str) else f'{value!r}D'}"
        for name, value in table.items()
    )
    return f"try_element_at(map({entries}), {key})"


def normalize_unit(unit: str) -> str:
    spelled = f"lower({strip(unit)})"
    return f"coalesce({_lookup(CANONICAL, spelled)}, {spelled})"


def unit_category(unit: str) -> str:
    """Of a unit in canonical spelling."""
    return (
        f"coalesce({_lookup(CATEGORY, unit)}, "
        f"CASE WHEN {unit} IS NOT NULL THEN '{UNKNOWN_CATEGORY}' END)"
    )


def unit_of_name(unit: str) -> str:
    """Canonical spelling of one unit name on the driver."""
    spelled = unit.strip().lower()
    return CANONICAL.get(spelled, spelled)


def convert_value(value: str, source: str, target: str) -> str:
    """`value` in the target unit; NULL if the units have no common category."""
    unit = unit_of_name(target)
    if unit not in FACTOR:
        return "CAST(NULL AS DOUBLE)"
    same_kind = {name: factor for name, factor in FACTOR.items() if CATEGORY[name] == CATEGORY[unit]}
    factor = _lookup(same_kind, normalize_unit(source))
    return f"CAST({value} AS DOUBLE) * {factor} / {FACTOR[unit]!r}D"


def quantity_number(text: str) -> str:
    """The number of a (stripped) quantity; empty where the text is none."""
    return f"regexp_extract({text}, {literal(_QUANTITY)}, 1)"


def quantity_unit(text: str) -> str:
    """The unit as spelled; empty where the text is no quantity."""
    return f"regexp_extract({text}, {literal(_QUANTITY)}, 2)"
