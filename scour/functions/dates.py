"""A closed date grammar: detection, parsing and rendering. SQL text.

Accepted notations: `d/M/yyyy`, `d/M/yy`, `d-M-yyyy`, `yyyy-M-d`, `MMM d, yyyy`, `MMMM d, yyyy`
and `yyyy-M-d HH:mm:ss`. Two-digit years below 69 are in this century, as in POSIX.
"""

from __future__ import annotations

import datetime as dt

from scour.functions.text import matches
from scour.schema import literal

# Notation names with the pattern each one stands for, in the order tried.
DATE_FORMATS = {
    "DD/MM/YYYY or MM/DD/YYYY": r"^\d{1,2}/\d{1,2}/\d{4}$",
    "DD/MM/YY or MM/DD/YY": r"^\d{1,2}/\d{1,2}/\d{2}$",
    "DD-MM-YYYY or MM-DD-YYYY": r"^\d{1,2}-\d{1,2}-\d{4}$",
    "YYYY-MM-DD": r"^\d{4}-\d{1,2}-\d{1,2}$",
    "Month DD, YYYY": r"^[A-Za-z]+(?U:\s+)\d{1,2},(?U:\s+)\d{4}$",
}
UNKNOWN_FORMAT = "Unknown"
# Target notations with the matching Spark datetime pattern.
TARGET_FORMATS = {
    "DD-MM-YYYY": "dd-MM-yyyy",
    "MM-DD-YYYY": "MM-dd-yyyy",
    "YYYY-MM-DD": "yyyy-MM-dd",
    "Month DD, YYYY": "MMMM dd, yyyy",
}
DAY_FIRST = "DD-MM-YYYY"

_MONTHS = (
    "january,february,march,april,may,june,july,august,september,october,november,december,"
    "jan,feb,mar,apr,may,jun,jul,aug,sep,oct,nov,dec"
)
_NAMED = r"^[A-Za-z]+(?U:\s+)\d{1,2},(?U:\s*)\d{4}$"
_ISO = r"^\d{4}-\d{1,2}-\d{1,2}(?:[ T](?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d)?$"
# Two-digit years go with slashes only.
_YEAR = r"(?:\d{4}|(?<=/)\d{2})"
_BY_DAY = rf"^\d{{1,2}}([-/])(?:0?[1-9]|1[0-2])\1{_YEAR}$"
_BY_MONTH = rf"^(?:0?[1-9]|1[0-2])([-/])\d{{1,2}}\1{_YEAR}$"

def detect_format(value: str) -> str:
    """The name of the notation of a (stripped) date text."""
    cases = " ".join(
        f"WHEN {matches(value, pattern)} THEN {literal(name)}"
        for name, pattern in DATE_FORMATS.items()
    )
    return f"CASE {cases} WHEN {value} IS NOT NULL THEN '{UNKNOWN_FORMAT}' END"


def parse_date(text: str, day_first: bool) -> str:
    """The timestamp a (stripped) text stands for, NULL if the grammar has no reading of it.

    The other notations are rewritten to the ISO one, which a single cast reads; anything else that
    a cast would take, such as a bare year, never gets there. For the ambiguous notations the
    preferred order is used unless its month is impossible. A pattern only says which notation it
    is; the parts are then cut out at their separators.
    """
    parts = f"replace({text}, '/', '-')"
    first = f"substring_index({parts}, '-', 1)"
    second = f"substring_index(substring_index({parts}, '-', 2), '-', -1)"
    short = f"right({text}, 2)"
    year = (
        f"CASE WHEN substr({text}, -3, 1) <> '/' THEN right({text}, 4) "
        f"WHEN {short} < '69' THEN concat('20', {short}) ELSE concat('19', {short}) END"
    )

    def numeric(pattern: str, month: str, day: str) -> str:
        return f"WHEN {matches(text, pattern)} THEN concat_ws('-', {year}, {month}, {day}) "

    by_day, by_month = numeric(_BY_DAY, second, first), numeric(_BY_MONTH, first, second)
    # An unknown name becomes month 0, which no cast accepts.
    name = f"regexp_extract({text}, '^[A-Za-z]+', 0)"
    month = f"(find_in_set(lower({name}), '{_MONTHS}') - 1) % 12 + 1"
    day = f"regexp_extract({text}, '[0-9]+', 0)"
    named = f"concat_ws('-', right({text}, 4), CAST({month} AS STRING), {day})"
    iso_text = (
        f"CASE WHEN {matches(text, _ISO)} THEN {text} "
        + (by_day + by_month if day_first else by_month + by_day)
        + f"WHEN {matches(text, _NAMED)} THEN {named} END"
    )
    return f"try_cast({iso_text} AS TIMESTAMP_NTZ)"


def render_date(value: str, target: str) -> str:
    if target not in TARGET_FORMATS:
        raise ValueError(
            f"Unknown target date format {target!r}; use one of {', '.join(map(repr, TARGET_FORMATS))}"
        )
    return f"date_format({value}, '{TARGET_FORMATS[target]}')"


def parse_literal(text: str) -> dt.datetime | None:
    """The grammar above for one literal on the driver, month first as for plain comparisons."""
    text = text.strip()
    patterns = (
        "%Y-%m-%d", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S",
        "%m/%d/%Y", "%d/%m/%Y", "%m/%d/%y", "%d/%m/%y", "%m-%d-%Y", "%d-%m-%Y",
        "%B %d, %Y", "%b %d, %Y",
    )
    for pattern in patterns:
        try:
            return dt.datetime.strptime(text, pattern)
        except ValueError:
            continue
    return None
