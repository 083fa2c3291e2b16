"""Text styles as SQL text."""

from __future__ import annotations

from scour.schema import literal

# The characters that count as white space at the ends of a text.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The style names.
NORMALIZE_STYLES = ("strip", "collapse_whitespace", "lower", "upper", "title")
STANDARDIZE_STYLES = ("strip", "lower", "upper", "title")

_SPACE_RUN = r"(?U)[\s\x1c-\x1f]+"
_CASED = r"\p{Lu}\p{Ll}\p{Lt}"
# A Unicode non-character: it marks where a word restarts and never leaves `title`.
_RESTART = "\ufdd0"


def matches(value: str, pattern: str) -> str:
    return f"({value} RLIKE {literal(pattern)})"


def strip(value: str) -> str:
    return f"btrim({value}, {literal(WHITE_SPACE)})"


def collapse_whitespace(value: str) -> str:
    return f"trim(regexp_replace({value}, {literal(_SPACE_RUN)}, ' '))"


def title(value: str) -> str:
    """Upper-case every letter that follows a non-letter, lower-case the others.

    `initcap` restarts after a blank only, so a marked blank goes in front of each letter that
    follows something else, and comes out again afterwards.
    """
    start = literal(f"(?<![{_CASED}])([{_CASED}])")
    marked = f"regexp_replace(lower({value}), {start}, '{_RESTART} $1')"
    return f"replace(initcap({marked}), '{_RESTART} ', '')"


def text_key(value: str) -> str:
    """Spellings with the same key are variants of one value."""
    return f"lower({strip(value)})"


def normalize(value: str, style: str) -> str:
    """The style alone; only `strip` and `collapse_whitespace` touch white space."""
    if style not in NORMALIZE_STYLES:
        raise ValueError(f"Unknown text style {style!r}; use one of {', '.join(NORMALIZE_STYLES)}")
    if style in ("lower", "upper"):
        return f"{style}({value})"
    return {"strip": strip, "collapse_whitespace": collapse_whitespace, "title": title}[style](value)


def standardize(value: str, style: str) -> str:
    """The style after stripping the ends."""
    if style not in STANDARDIZE_STYLES:
        raise ValueError(
            f"Unknown text style {style!r}; use one of {', '.join(STANDARDIZE_STYLES)}"
        )
    return strip(value) if style == "strip" else normalize(strip(value), style)
