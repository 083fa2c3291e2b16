"""Column names that are not taken."""

from __future__ import annotations

from collections.abc import Iterable


def free_name(taken: Iterable[str], wanted: str) -> str:
    """The wanted name, with underscores behind it if columns have it already."""
    names = {name.lower() for name in taken}
    while wanted.lower() in names:
        wanted += "_"
    return wanted
