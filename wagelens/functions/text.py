"""Text normalization as built-in expressions.

The rules follow Python's string methods, which are wider than Java's defaults: their
whitespace holds U+001C to U+001F and the Unicode spaces, a word character is a letter, a
number or an underscore but never a combining mark, and title case starts a word after
any character without case. Native string functions do the work where they can; a regular
expression decodes and copies the text each time.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wagelens import fixed

# ---- fixed values: characters and patterns ----------------------------------
_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
_CASED = r"\p{IsLowercase}\p{IsUppercase}\p{Lt}"
_ESCAPED = r'(?sd)^="(.*)"$'
# The same whitespace as a class: Java's Unicode \s lacks only U+001C to U+001F.
_SPACES = r"(?U)[\s\x1c-\x1f]+"
_PUNCTUATION = r"(?U)[^\p{L}\p{N}_\s\x1c-\x1f]+"
_WORD_START = rf"([^{_CASED} ])(?=[{_CASED}])"
_TECH = rf"^(?:{fixed.TECH_MAJOR_GROUP}|{fixed.TECH_EXTRA_PREFIX})"

# U+FFFF is no character, so no text can hold it.
_WORD_BREAK = "\uffff "


def unescape(text: Column) -> Column:
    """Drop a spreadsheet's ``="..."`` wrapper, anchored at both ends; inner quotes stay."""
    wrapped = text.startswith('="')
    return F.when(wrapped, F.regexp_replace(text, _ESCAPED, "$1")).otherwise(text)


def has_escape(text: Column) -> Column:
    """True where the value starts with the wrapper; a missing value is False."""
    return F.coalesce(text.startswith('="'), F.lit(False))


def strip(text: Column) -> Column:
    """Trim whitespace of every kind; ``trim`` alone would only take spaces."""
    return F.btrim(text, F.lit(_WHITESPACE))


def title_case(text: Column) -> Column:
    """Upper-case each letter that follows a character without case.

    ``initcap`` starts words after spaces only and would give ``O'fallon``, so the other
    word starts get a break that is taken out again.
    """
    marked = F.regexp_replace(text, _WORD_START, f"$1{_WORD_BREAK}")
    return F.replace(F.initcap(marked), F.lit(_WORD_BREAK), F.lit(""))


def without_legal_suffix(name: Column) -> Column:
    """Drop one trailing legal form from a single-spaced name of several words."""
    last = F.substring_index(name, " ", -1)
    head = F.substr(name, F.lit(1), F.length(name) - F.length(last) - 1)
    return F.when((last != name) & last.isin(*fixed.LEGAL_SUFFIXES), head).otherwise(name)


def normalize_employer(name: Column) -> Column:
    """Fold case, punctuation, spacing and one trailing legal suffix; nothing fuzzy."""
    bare = F.regexp_replace(F.upper(unescape(name)), _PUNCTUATION, "")
    # Once runs of whitespace are single spaces, a plain trim strips all there is.
    spaced = F.trim(F.regexp_replace(bare, _SPACES, " "))
    return without_legal_suffix(spaced)


def normalize_city(city: Column) -> Column:
    return title_case(strip(unescape(city)))


def normalize_state(state: Column) -> Column:
    return F.upper(strip(unescape(state)))


def normalize_soc(code: Column) -> Column:
    """The seven-character occupation code, without its detail suffix."""
    return F.substring(strip(unescape(code)), 1, fixed.SOC_CODE_LENGTH)


def is_tech(soc_code: Column) -> Column:
    """Computer occupations plus information-systems managers; a missing code is not tech."""
    return F.coalesce(soc_code.rlike(_TECH), F.lit(False))


def same_text(column: Column, value: str) -> Column:
    """Case-insensitive equality; spaces, trailing ones too, stay significant."""
    return F.lower(column) == F.lower(F.lit(value))


def has_prefix(column: Column, prefix: str) -> Column:
    """Literal, case-insensitive prefix: no character of it is a wildcard."""
    return F.lower(column).startswith(F.lower(F.lit(prefix)))


def location_label(city: Column, state: Column) -> Column:
    return F.concat(city, F.lit(", "), state)
