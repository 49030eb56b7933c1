"""Dates in mixed formats: a status first, and a value only where nothing is guessed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO = r"^\d{4}-\d{2}-\d{2}(?:[ T].*)?$"
DASHED = r"^(\d{2})-(\d{2})-(\d{4})$"
SLASHED = r"^(\d{1,2})/(\d{1,2})/(\d{4})(?:[ T].*)?$"
DAY_FIRST = r"^(?:1[3-9]|[2-9]\d)/"
EITHER_FIRST = r"^(?:0?\d|1[0-2])/(?:0?\d|1[0-2])/\d{4}(?:[ T].*)?$"


def _candidate(c: Column) -> Column:
    """The date as written, or null where the form is unknown or the calendar has no such day."""
    t = F.trim(c)
    slashed = F.regexp_replace(t, SLASHED, F.when(t.rlike(DAY_FIRST), "$3-$2-$1").otherwise("$3-$1-$2"))
    iso = F.when(t.rlike(ISO), F.substring(t, 1, 10)).when(t.rlike(DASHED), F.regexp_replace(t, DASHED, "$3-$2-$1")).when(t.rlike(SLASHED), slashed)
    return F.try_to_date(iso, "yyyy-M-d")


def date_status(c: Column) -> Column:
    """MISSING, VALID, INVALID, or AMBIGUOUS for a slashed date whose first two numbers are both 12 or less."""
    t = F.trim(c)
    return F.when(c.isNull() | (t == ""), "MISSING").when(t.rlike(EITHER_FIRST), "AMBIGUOUS").when(_candidate(c).isNotNull(), "VALID").otherwise("INVALID")


def date_value(c: Column) -> Column:
    """The date where its status is VALID."""
    return F.when(~F.trim(c).rlike(EITHER_FIRST), _candidate(c))


def date_format_label(c: Column) -> Column:
    t = F.trim(c)
    return F.when(t.rlike(ISO), "ISO").when(t.rlike(DASHED), "DD-MM-YYYY").when(t.rlike(SLASHED), "SLASH").otherwise("OTHER")
