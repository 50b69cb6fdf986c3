"""Recognising dates written as text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from frameprobe.functions.columns import BLANKS, strip

# The outlines of all formats below; one cheap test spares other texts the rest.
_DAY = r"\d{1,4}[-/][0-9A-Za-z]{1,3}[-/]\d{1,4}"
_ZONE = r"(Z|[+-]\d{2}:\d{2})"
DATE_OUTLINE = (rf"^{BLANKS}*({_DAY}([ T][0-9:.]+( ?[AaPp][Mm]|{_ZONE})?)?"
                rf"|[A-Z][a-z]{{2}} \d{{1,2}}, \d{{4}}|\d{{1,2}}:\d{{2}}:\d{{2}}){BLANKS}*$")


@dataclass(frozen=True)
class DateFormat:
    """A date pattern and the exact shape of the texts it may read.

    The shape keeps lenient parsing out and spares a failing parse on every other text.
    """

    pattern: str
    shape: str


_YMD = r"\d{4}-\d{1,2}-\d{1,2}"
_YMD_SLASHED = r"\d{4}/\d{1,2}/\d{1,2}"
_SLASHED = r"\d{1,2}/\d{1,2}/\d{4}"
_SHORT = r"\d{1,2}/\d{1,2}/\d{2}"
_DASHED = r"\d{1,2}-\d{1,2}-\d{4}"
_HM = r"\d{1,2}:\d{1,2}"
_HMS = r"\d{1,2}:\d{1,2}:\d{1,2}"
_FRACTION = r"\.\d{1,9}"
_HALF = r"[AaPp][Mm]"

# Candidate formats; on equal shares the earlier one wins, so month-first comes before day-first.
# Texts with a zone become UTC; a time without a day falls on 1970-01-01.
DATE_FORMATS: tuple[DateFormat, ...] = (
    DateFormat("yyyy-M-d", f"^{_YMD}$"),
    DateFormat("yyyy-M-d H:m:s", f"^{_YMD} {_HMS}$"),
    DateFormat("yyyy-M-d'T'H:m:s", f"^{_YMD}T{_HMS}$"),
    DateFormat("yyyy-M-d H:m:s.SSSSSSSSS", f"^{_YMD} {_HMS}{_FRACTION}$"),
    DateFormat("yyyy-M-d'T'H:m:s.SSSSSSSSS", f"^{_YMD}T{_HMS}{_FRACTION}$"),
    DateFormat("yyyy-M-d'T'H:m:s[.SSSSSSSSS]XXX", f"^{_YMD}T{_HMS}({_FRACTION})?{_ZONE}$"),
    DateFormat("yyyy-M-d H:m:s[.SSSSSSSSS]XXX", f"^{_YMD} {_HMS}({_FRACTION})?{_ZONE}$"),
    DateFormat("yyyy-M-d H:m", f"^{_YMD} {_HM}$"),
    DateFormat("yyyy/M/d", f"^{_YMD_SLASHED}$"),
    DateFormat("yyyy/M/d H:m:s", f"^{_YMD_SLASHED} {_HMS}$"),
    DateFormat("yyyy/M/d H:m", f"^{_YMD_SLASHED} {_HM}$"),
    DateFormat("M/d/yyyy", f"^{_SLASHED}$"),
    DateFormat("d/M/yyyy", f"^{_SLASHED}$"),
    DateFormat("M/d/yyyy H:m:s", f"^{_SLASHED} {_HMS}$"),
    DateFormat("d/M/yyyy H:m:s", f"^{_SLASHED} {_HMS}$"),
    DateFormat("M/d/yyyy H:m", f"^{_SLASHED} {_HM}$"),
    DateFormat("d/M/yyyy H:m", f"^{_SLASHED} {_HM}$"),
    DateFormat("M/d/yyyy h:m[:s] a", f"^{_SLASHED} {_HM}(:\\d{{1,2}})? {_HALF}$"),
    DateFormat("d/M/yyyy h:m[:s] a", f"^{_SLASHED} {_HM}(:\\d{{1,2}})? {_HALF}$"),
    DateFormat("M/d/yy", f"^{_SHORT}$"),
    DateFormat("d/M/yy", f"^{_SHORT}$"),
    DateFormat("M-d-yyyy", f"^{_DASHED}$"),
    DateFormat("d-M-yyyy", f"^{_DASHED}$"),
    DateFormat("d-MMM-yyyy", r"^\d{1,2}-[A-Z][a-z]{2}-\d{4}$"),
    DateFormat("MMM d, yyyy", r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$"),
    DateFormat("H:m:s", f"^{_HMS}$"),
)
SHAPES = list(dict.fromkeys(f.shape for f in DATE_FORMATS))


def date_like(value: Column) -> Column:
    """The trimmed text where it has the outline of a date, else NULL."""
    return F.when(value.rlike(DATE_OUTLINE), strip(value))


#: The commonest forms, which need no trimming: a day in digits, and a moment of 19 characters.
PLAIN_DAY = "^[0-9]{1,4}[-/][0-9]{1,2}[-/][0-9]{1,4}$"
PLAIN_MOMENT = "^[0-9]{4}[-/][0-9]{2}[-/][0-9]{2}[ T][0-9]{2}:[0-9]{2}:[0-9]{2}$"


def alike_moment(value: Column) -> Column:
    """``alike`` for a PLAIN_MOMENT, without patterns."""
    hour, minute, second = (F.substring(value, at, 2) for at in (12, 15, 18))
    hour = F.when(hour.between("01", "12"), "01").when(hour <= "23", "00").otherwise(hour)
    return F.concat(F.substring(value, 1, 11), hour, *[
        F.concat(F.lit(":"), F.when(x <= "59", "00").otherwise(x)) for x in (minute, second)])


def alike(value: Column) -> Column:
    """A trimmed date text with another time of day that the same formats read.

    Hours from 1 to 12 become 1, others 0, minutes and seconds 0, fractions 9; what is no hour or minute
    stays as it is, and so does the day. So a column has about as many of these as it has days.
    """
    hour = F.regexp_replace(value, "(?<sep>[ T])(0?[1-9]|1[0-2]):", "${sep}1:")
    hour = F.regexp_replace(hour, "(?<sep>[ T])(00?|1[3-9]|2[0-3]):", "${sep}0:")
    rest = F.regexp_replace(F.regexp_replace(hour, ":[0-5][0-9]", ":00"), ":[0-9](?![0-9])", ":0")
    return F.when(value.rlike("[ T][0-9]+:"), F.regexp_replace(rest, r"\.[0-9]{1,9}(?![0-9])", ".9")).otherwise(value)


def shape_of(value: Column) -> Column:
    """The number of the one shape that a trimmed text has, NULL where it has none."""
    return F.coalesce(*[F.when(value.rlike(s), F.lit(i)) for i, s in enumerate(SHAPES)])


def parse(value: Column, form: DateFormat, fits: Column | None = None) -> Column:
    """A trimmed text as a timestamp, NULL where it does not fit the format.

    ``fits`` says whether the text has the format's shape, where that is known already.
    """
    fits = value.rlike(form.shape) if fits is None else fits
    parsed = F.try_to_timestamp(value, F.lit(form.pattern))
    if form.pattern.endswith("XXX"):
        parsed = F.to_utc_timestamp(parsed, F.current_timezone())
    if form.pattern.endswith("/yy"):  # two digits from 69 on are years of the last century
        parsed = F.when(F.year(parsed) >= 2069, parsed - F.make_interval(years=F.lit(100))).otherwise(parsed)
    return F.when(fits, parsed)


def parses_as(value: Column, shape: Column, form: DateFormat) -> Column:
    """Whether a text of the given ``shape_of`` reads as a date of the format; never NULL."""
    fits = F.coalesce(shape == SHAPES.index(form.shape), F.lit(False))
    return F.coalesce(F.when(fits, F.try_to_timestamp(value, F.lit(form.pattern)).isNotNull()), F.lit(False))
