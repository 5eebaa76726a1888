"""Dates as strings: ``""``, YYYY, YYYY-MM or YYYY-MM-DD; days are valid from 1 to 31."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of months; the written forms and patterns below are fixed values.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_NAMES = "January|February|March|April|May|June|July|August|September|October|November|December"
_SHORT = "|".join(MONTHS)


def month_number(name: Column) -> Column:
    """1 to 12 from the first three letters, else null."""
    return F.nullif(F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.substring(name, 1, 3))).cast("int"), F.lit(0))


def valid(y: Column, m: Column, d: Column, lo: int = 1000, hi: int = 9999) -> Column:
    return F.coalesce(y.between(lo, hi) & m.between(1, 12) & d.between(1, 31), F.lit(False))


def joined(y: Column, m: Column, d: Column) -> Column:
    return F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0"))


def _int(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("int")


def _pick(text: Column, pattern: str, y: int, m: int, d: int, lo: int, hi: int, century: int | None = None, named: bool = False) -> Column:
    """The date of one pattern, or null."""
    year = _int(text, pattern, y)
    if century is not None:
        year = F.when(F.length(F.regexp_extract(text, pattern, y)) <= 2, year + century).otherwise(year)
    month = month_number(F.regexp_extract(text, pattern, m)) if named else _int(text, pattern, m)
    day = _int(text, pattern, d)
    parts = F.array(F.struct(year.alias("y"), month.alias("m"), day.alias("d")))  # each part is computed once
    return F.transform(parts, lambda p: F.when(valid(p["y"], p["m"], p["d"], lo, hi), joined(p["y"], p["m"], p["d"])))[0]


def parse(text: Column, lo: int = 1000, hi: int = 9999, century: int = 1900) -> Column:
    """The common written forms, in a fixed order of precedence, else a bare year
    in a short text, else ``""``.  Two-digit years are read in ``century``."""
    t = F.trim(F.coalesce(text, F.lit("")))
    clock = r"(?:[ T]\d{1,2}:\d{2}(?::\d{2})?)?"
    forms = [
        _pick(t, rf"^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}}){clock}$", 1, 2, 3, lo, hi),
        _pick(t, r"^(\d{4})/(\d{1,2})/(\d{1,2})$", 1, 2, 3, lo, hi),
        _pick(t, rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}){clock}$", 3, 1, 2, lo, hi),
        _pick(t, rf"(?i)^(\d{{1,2}})[- ]({_SHORT}|{_NAMES})[- ](\d{{4}})$", 3, 2, 1, lo, hi, named=True),
        _pick(t, rf"(?i)^({_SHORT}|{_NAMES}) (\d{{1,2}}), (\d{{4}})$", 3, 1, 2, lo, hi, named=True),
        _pick(t, r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$", 3, 2, 1, lo, hi),
        _pick(t, r"^(\d{4})(\d{2})(\d{2})$", 1, 2, 3, lo, hi),
        _pick(t, r"^(\d{1,2})/(\d{1,2})/(\d{2})$", 3, 1, 2, lo, hi, century),
        _pick(t, rf"(?i)^(\d{{1,2}})-({_SHORT})-(\d{{2}})$", 3, 2, 1, lo, hi, century, named=True),
    ]
    year = _int(t, r"\b(1[0-9]{3}|20[0-9]{2})\b", 1)
    bare = F.when((F.length(t) <= 12) & year.between(lo, hi), year.cast("string"))
    return F.coalesce(*forms, bare, F.lit(""))


def from_filename(path: Column, lo: int, hi: int) -> Column:
    """A date in a file name: leading ISO, then day month year, then eight digits."""
    name = F.element_at(F.split(path, "/"), -1)
    iso = _pick(name, r"^(\d{4})-(\d{2})-(\d{2})", 1, 2, 3, lo, hi)
    written = _pick(name, rf"(?i)(?<![a-z0-9])(\d{{1,2}})[_\- ]?({_SHORT})[a-z]*[_\- ]?(\d{{4}}|\d{{2}})(?![0-9])", 3, 2, 1, lo, hi, 2000, named=True)
    digits = _pick(name, r"(?<!\d)((?:19|20)\d{2})(0[1-9]|1[0-2])([0-3]\d)(?!\d)", 1, 2, 3, lo, hi)
    return F.coalesce(iso, written, digits, F.lit(""))


def from_text(text: Column, lo: int, hi: int) -> Column:
    """The first ``D Month YYYY`` of the first 6,000 characters, else the first
    ``Month D, YYYY``; a first hit outside the bounds ends its pattern."""
    head = F.substring(text, 1, 6000)
    a = _pick(head, rf"(?i)\b(\d{{1,2}})\s+({_NAMES})\s+((?:19|20)\d{{2}})\b", 3, 2, 1, lo, hi, named=True)
    b = _pick(head, rf"(?i)\b({_NAMES})\s+(\d{{1,2}}),?\s+((?:19|20)\d{{2}})\b", 3, 1, 2, lo, hi, named=True)
    return F.coalesce(a, b, F.lit(""))


def military(text: Column, lo: int, hi: int, century: int = 1900) -> Column:
    """``28 JAN 62`` in the first 2,500 characters."""
    return F.coalesce(_pick(F.substring(text, 1, 2500), rf"\b(\d{{1,2}}) ({_SHORT.upper()}) (\d{{2}})\b", 3, 2, 1, lo, hi, century, named=True), F.lit(""))


def declassify_year(text: Column, years: int = 25) -> Column:
    """``Declassify On: YYYYMMDD`` names a year that many years after the document's."""
    y = _int(F.substring(text, 1, 20000), r"(?i)declassify\s+on:?\s*((?:19|20)\d{2})", 1)
    return F.coalesce((y - years).cast("string"), F.lit(""))


def run_date(text: Column, lo: int, hi: int) -> Column:
    return F.coalesce(_pick(F.substring(text, 1, 6000), r"(?i)run date:?\s*(\d{1,2})/(\d{1,2})/(\d{4})", 3, 1, 2, lo, hi), F.lit(""))


def year_of(date: Column) -> Column:
    return F.when(F.substring(date, 1, 4).rlike("^[0-9]{4}$"), F.substring(date, 1, 4).try_cast("int"))


def wall_clock(stamp: Column) -> Column:
    """A chat time as the writer's clock: epoch seconds or milliseconds as UTC, ISO
    text with its offset dropped, not converted."""
    number = stamp.try_cast("double")
    epoch = F.when(stamp.rlike(r"^\d{9,13}(\.\d+)?$"), F.when(number > 1e11, number / 1000).otherwise(number))
    local = F.replace(F.regexp_extract(stamp, r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2})?)", 1), F.lit("T"), F.lit(" "))
    return F.coalesce(F.timestamp_seconds(epoch), F.try_to_timestamp(F.when(F.length(local) == 16, F.concat(local, F.lit(":00"))).otherwise(local)))


def rfc822(header: Column) -> Column:
    """The day of a mail's Date header, on the sender's clock."""
    return F.coalesce(_pick(header, rf"(?i)(\d{{1,2}}) ({_SHORT})[a-z]* (\d{{4}})", 3, 2, 1, 1000, 9999, named=True), F.lit(""))
