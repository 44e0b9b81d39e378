"""Patterns put together from the vocabularies: lists of words, and how dates, quantities and labelled fields are written."""

from __future__ import annotations

import re
from collections.abc import Iterable

from fitloom.functions import vocab as V


def one_of(words: Iterable[str]) -> str:
    """Any of some words, longer ones first."""
    return "(?:" + "|".join(map(re.escape, sorted(words, key=len, reverse=True))) + ")"


def labelled(field: str) -> str:
    """A field's label, a colon, and its value as group 1."""
    f = V.LABELS[field]
    return rf"(?i){one_of(f['words'])}\s*[：:]\s*([^{f['stop']}]{{2,{f['most']}}})"


def point(year: str = V.YEAR, month: str = V.MONTH) -> str:
    """A year, and a month that a separator binds to it: two groups."""
    return rf"({year})\s*(?:[{V.DATE_MARKS}]\s*({month})(?!\d))?"


#: Start year and month, end year and month, or a word for now: five groups.
DATE_RANGE = rf"(?i){point()}\s*月?\s*[{V.RANGE_MARKS}]+\s*(?:{point()}|({'|'.join(V.NOW)}))"
YEAR_SPAN = rf"({V.YEAR})\s*[{V.RANGE_MARKS}]\s*({V.YEAR})"
SINGLE_DATE = point()
GRADUATION = rf"({V.YEAR})\s*年?\s*{one_of(V.GRADUATES)}"

_YEARS, _EXPERIENCE, _UP = r"(\d{1,2})\s*年", one_of(V.EXPERIENCE), one_of(V.AND_MORE)
#: Years of experience, the first form that occurs decides: a range (two groups), so many and more, so many after the word, before the word.
YEARS_NEEDED = (
    rf"(\d{{1,2}})\s*[{V.YEARS_MARKS}]\s*{_YEARS}",
    _YEARS + _UP,
    rf"{one_of(V.FIELDS)}{_EXPERIENCE}\s*{one_of(V.AT_LEAST)}?\s*{_YEARS}",
    rf"{_YEARS}(?:以上)?{one_of(V.FIELDS[:3])}?{_EXPERIENCE}",
)
NO_EXPERIENCE = one_of(V.NO_EXPERIENCE)

_NUMBER = r"\d+(?:\.\d+)?\s*"
QUANTITIES = (
    rf"{_NUMBER}%|百分之\s*[{V.DIGITS}\d]",
    rf"(?i){_NUMBER}{one_of(V.POWERS)}?\s*{one_of(V.UNITS)}",
    rf"(?i){one_of(V.METRICS)}\D{{0,6}}\d",
)
#: A mark, a number with a sign after it, or a number in brackets, at a line's start.
BULLET = rf"^[\s　]*(?:[{V.MARKS}]|[①-⑳]|\(?\d{{1,2}}\)?[.、)）]|[（(](?:\d{{1,2}}|[{V.NUMERALS}]{{1,3}})[)）])[\s　]*"
SCHOOL = rf"[一-鿿]{{2,16}}{one_of(V.SCHOOLS)}|[A-Z][A-Za-z.\s]{{2,40}}{one_of(V.SCHOOLS_EN)}"

#: A level's words, and the year of a class that ends with it.
SENIORITY = {level: "(?i)" + one_of(words) + (rf"|20\d{{2}}\s*{V.COHORT}" if level == V.COHORT_LEVEL else "") for level, words in V.SENIORITY.items()}
_NEAR = rf"\d\s*年\s*{one_of(V.ABOUT)}?\s*[^\n，,。;；]{{0,12}}?{_EXPERIENCE}"
REQUIREMENT = {kind: one_of(words) for kind, words in V.REQUIREMENT.items()} | {"经验": rf"{_NEAR}|{one_of(V.WORKED)}\s*{_EXPERIENCE}|经验丰富"}
