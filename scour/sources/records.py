"""The structure of CSV records, as SQL text over raw lines."""

from __future__ import annotations

import csv
import re

from scour.schema import literal

EXTRA, SHORT, QUOTES, ENCODING, EMPTY = (
    "extra_fields", "missing_fields", "malformed_quotes", "encoding_error", "empty_file",
)


def _field_pattern(delimiter: str) -> str:
    """One field with the delimiter before it; possessive, so long fields need no backtracking.

    The line needs a delimiter in front, so that no match is empty: an empty first field would be.
    """
    d = re.escape(delimiter)
    quoted = r'"[^"]*+(?:""[^"]*+)*+"'
    plain = rf'[^"{d}][^{d}]*+'
    return rf"(?s){d}(?:{quoted}|{plain})?+(?={d}|\z)"


def _led(line: str, delimiter: str) -> str:
    return f"concat({literal(delimiter)}, {line})"


def opens(line: str, delimiter: str = ",") -> str:
    """Whether a record that starts with this line goes on in the next one, within quotes.

    A line that breaks the rules closes what is open: the next one is a record of its own.
    """
    d = re.escape(delimiter)
    open_field = r'"[^"]*+(?:""[^"]*+)*+'
    pattern = rf'(?s)\A(?:(?:{open_field}"|[^"{d}][^{d}]*+)?+{d})*+{open_field}\z'
    return f"coalesce(regexp_like({line}, {literal(pattern)}), false)"


def is_malformed(line: str, delimiter: str = ",") -> str:
    """Whether something is left of the line once all well-formed fields are taken out."""
    return f"regexp_replace({_led(line, delimiter)}, {literal(_field_pattern(delimiter))}, '') <> ''"


def field_count(line: str, delimiter: str = ",") -> str:
    """Fields of a well-formed line; an empty line has none."""
    pattern = literal(_field_pattern(delimiter))
    return f"CASE WHEN {line} = '' THEN 0 ELSE regexp_count({_led(line, delimiter)}, {pattern}) END"


def structure_issue(line: str, expected: int, delimiter: str = ",") -> str:
    """What is wrong with the line, NULL if nothing is."""
    found = field_count(line, delimiter)
    return (
        f"CASE WHEN NOT is_valid_utf8({line}) THEN '{ENCODING}' "
        f"WHEN {is_malformed(line, delimiter)} THEN '{QUOTES}' "
        f"WHEN {found} > {expected} THEN '{EXTRA}' WHEN {found} < {expected} THEN '{SHORT}' END"
    )


def distinct_names(names: list[str]) -> list[str]:
    """A repeated name gets a number behind it, so that all columns can be told apart."""
    taken: list[str] = []
    for name in names:
        number, free = 0, name
        while free in taken or (number and free in names):
            number += 1
            free = f"{name}.{number}"
        taken.append(free)
    return taken


def parse_header(line: str, delimiter: str = ",") -> list[str] | None:
    """The column names of one header line, None if its quotes are broken."""
    try:
        return next(csv.reader([line], delimiter=delimiter, strict=True), [])
    except csv.Error:
        return None
