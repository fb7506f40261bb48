"""Scalar expressions: calendar rules, safe arithmetic, text predicates. All are built-in columns; none yields NaN."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def rounded(c: Column | str, places: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, places)


def clean(c: Column) -> Column:
    """A double with NaN turned into NULL."""
    return F.when(F.isnan(c), None).otherwise(c)


def nth_weekday(date: Column, month: int, weekday: int, nth: int, since: int = 0) -> Column:
    """Is date the nth (0: last) given weekday (0 = Monday) of a month with 31 days or of its first four weeks, in the year `since` or later."""
    week = F.dayofmonth(date) > 24 if nth == 0 else F.ceil(F.dayofmonth(date) / 7) == nth
    return (F.month(date) == month) & (F.weekday(date) == weekday) & week & (F.year(date) >= since)


def fixed_holiday(date: Column, days: dict[str, int], friday: list[str]) -> Column:
    """Is date one of the MM-dd days, from their first year on, or the Monday after one on a Sunday or, for those of `friday`, the Friday before one on a Saturday."""

    def falls(k: int, some) -> Column:
        day = F.date_add(date, k)
        return reduce(or_, [(F.date_format(day, "MM-dd") == md) & (F.year(day) >= days[md]) for md in some])

    return falls(0, days) | (falls(1, friday) & (F.weekday(date) == 4)) | (falls(-1, days) & (F.weekday(date) == 0))


def good_friday(date: Column) -> Column:
    """Is date the Friday before Easter, by Gauss's rule for 1900 to 2099."""
    y = F.year(date)
    a = y % 19
    d = (19 * a + 24) % 30
    e = (2 * (y % 4) + 4 * (y % 7) + 6 * d + 5) % 7
    late = ((d == 29) & (e == 6)) | ((d == 28) & (e == 6) & (a > 10))
    return date == F.date_add(F.make_date(y, F.lit(3), F.lit(20)), (d + e - F.when(late, 7).otherwise(0)).cast("int"))


#: Days off as MM-dd and their first year, those of them that a Friday stands for, as (month, weekday, nth, first year), and whether Good Friday is one; for the market and for federal offices.
MARKET = ({"01-01": 0, "06-19": 2022, "07-04": 0, "12-25": 0}, ["06-19", "07-04", "12-25"], [(1, 0, 3, 1998), (2, 0, 3, 0), (5, 0, 0, 0), (9, 0, 1, 0), (11, 3, 4, 0)], True)
FEDERAL = ({"01-01": 0, "06-19": 2021, "07-04": 0, "11-11": 0, "12-25": 0}, ["01-01", "06-19", "07-04", "11-11", "12-25"], [(1, 0, 3, 1986), (2, 0, 3, 0), (5, 0, 0, 0), (9, 0, 1, 0), (10, 0, 2, 0), (11, 3, 4, 0)], False)


def is_open(date: Column, rules=MARKET) -> Column:
    """A weekday that the rules don't close."""
    fixed, friday, floating, easter = rules
    closed = reduce(or_, [nth_weekday(date, *f) for f in floating], fixed_holiday(date, fixed, friday))
    closed = closed | good_friday(date) if easter else closed
    return (F.weekday(date) < 5) & ~closed


def closes_early(date: Column) -> Column:
    """Is date the eve of the fourth of July or of Christmas, or the day after Thanksgiving."""
    return F.date_format(date, "MM-dd").isin("07-03", "12-24") | ((F.month(date) == 11) & (F.weekday(date) == 4) & F.dayofmonth(date).between(23, 29))


def close_instant(date: Column) -> Column:
    """UTC instant of the close in New York: 13:00 on days of an early close, else 16:00."""
    hour = F.when(closes_early(date), "13:00:00").otherwise("16:00:00")
    return F.to_utc_timestamp(F.to_timestamp(F.concat_ws(" ", date.cast("string"), hour)), "America/New_York")


def keyword_hits(text: Column, word: Column) -> Column:
    """Non-overlapping occurrences of a lower-case word."""
    low = F.lower(text)
    return ((F.length(low) - F.length(F.replace(low, word, F.lit("")))) / F.length(word)).cast("long")


#: What marks a sentence as boilerplate.
BOILERPLATE = ("voting for the", "voting against", "for media inquiries", "implementation note", "for release at", "share", "last update:")


#: Between sentences, and a date as it is printed.
SENTENCE_END = r"(?<=[.;!?])\s+(?=[A-Z])"
PRINTED = r"\b((?:January|February|March|April|May|June|July|August|September|October|November|December)\s+[0-9]{1,2},\s+[0-9]{4})\b"


def sentences(text: Column, least: int = 25) -> Column:
    """Parts between sentence ends, trimmed, that are longer than `least` and hold no boilerplate."""
    parts = F.transform(F.split(text, SENTENCE_END), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda s: (F.length(s) > least) & ~F.lower(s).rlike("|".join(BOILERPLATE)))


def printed_date(text: Column, fallback: Column) -> Column:
    """A date like 'June 28, 2007' in the first 300 characters, else the fallback."""
    found = F.regexp_replace(F.regexp_extract(F.substring(text, 1, 300), PRINTED, 1), r"\s+", " ")
    return F.coalesce(F.try_to_timestamp(F.nullif(found, F.lit("")), F.lit("MMMM d, yyyy")).cast("date"), fallback)


MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def heading_date(text: Column) -> Column:
    """End date of a meeting heading such as 'July 31-August 1  Meeting - 2012', 'Jan/Feb 31-1 Meeting - 2011', 'January 30-31 Meeting - 2007'; NULL if there is none."""
    name = r"([A-Za-z]{3})[a-z]*"
    two = rf"^{name} ?[0-9]{{1,2}} ?- ?{name} ([0-9]{{1,2}})\b.*?([0-9]{{4}})"
    pair = rf"^[A-Za-z]{{3}}[a-z]*/{name} [0-9]{{1,2}}-([0-9]{{1,2}})\b.*?([0-9]{{4}})"
    one = rf"^{name} (?:[0-9]{{1,2}}-)?([0-9]{{1,2}})\b.*?([0-9]{{4}})"

    def date(pattern: str, month: int) -> Column:
        m = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.regexp_extract(text, pattern, month)))
        return F.to_date(F.try_to_timestamp(F.when(m > 0, F.concat_ws("-", F.regexp_extract(text, pattern, month + 2), m.cast("string"), F.regexp_extract(text, pattern, month + 1))), F.lit("yyyy-M-d")))

    return F.coalesce(date(two, 2), date(pair, 1), date(one, 1))


def pinball(levels: list[float], q: Column, actual: Column) -> Column:
    """Mean pinball loss over the levels."""
    loss = F.zip_with(F.array(*map(F.lit, levels)), q, lambda p, x: F.greatest(p * (actual - x), (p - 1) * (actual - x)))
    return F.aggregate(loss, F.lit(0.0), lambda s, x: s + x) / len(levels)
