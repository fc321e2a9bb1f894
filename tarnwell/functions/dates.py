"""Date phrases to closed UTC spans, under an injected clock and offset."""

from __future__ import annotations

import calendar
import re
from datetime import UTC, datetime, timedelta

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tarnwell.session import ship

MONTHS = {m.lower(): i for i, m in enumerate(calendar.month_name) if m} | {m.lower(): i for i, m in enumerate(calendar.month_abbr) if m}
NUMBERS = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve".split())} | {"a": 1, "an": 1}
ISO = re.compile(r"\b(\d{4})-(\d{2})(?:-(\d{2}))?\b")
AGO = re.compile(r"\b(\d{1,4}|" + "|".join(NUMBERS) + r")\s+(hour|day|week|month|year)s?\s+ago\b")
LAST = re.compile(r"\b(last|this)\s+(week|month|year)\b")
DAY = re.compile(r"\b(today|yesterday)\b")
MONTH = re.compile(r"\b(?:(\d{1,2})(?:st|nd|rd|th)?\s+)?(" + "|".join(sorted(MONTHS, key=len, reverse=True)) + r")\b\.?(?:\s+(\d{1,2})(?:st|nd|rd|th)?\b)?(?:,?\s+(\d{4}))?")
NTH = re.compile(r"\bon the (\d{1,2})(?:st|nd|rd|th)\b")


def _day(d: datetime) -> tuple[datetime, datetime]:
    start = d.replace(hour=0, minute=0, second=0, microsecond=0)
    return start, start + timedelta(days=1, seconds=-1)


def _month(year: int, month: int) -> tuple[datetime, datetime]:
    start = datetime(year, month, 1)
    return start, start + timedelta(days=calendar.monthrange(year, month)[1], seconds=-1)


def _back(now: datetime, months: int) -> datetime:
    k = now.year * 12 + now.month - 1 - months
    year, month = divmod(k, 12)
    return now.replace(year=year, month=month + 1, day=min(now.day, calendar.monthrange(year, month + 1)[1]))


def _iso(m: re.Match, now: datetime):
    y, mo, d = int(m[1]), int(m[2]), m[3]
    return _day(datetime(y, mo, int(d))) if d else _month(y, mo)


def _ago(m: re.Match, now: datetime):
    n = int(m[1]) if m[1].isdigit() else NUMBERS[m[1]]
    if m[2] == "hour":
        at = (now - timedelta(hours=n)).replace(minute=0, second=0, microsecond=0)
        return at, at + timedelta(hours=1, seconds=-1)
    if m[2] in ("month", "year"):
        return _day(_back(now, n * (12 if m[2] == "year" else 1)))
    return _day(now - timedelta(days=n * (7 if m[2] == "week" else 1)))


def _last(m: re.Match, now: datetime):
    back = m[1] == "last"
    if m[2] == "week":
        monday = _day(now - timedelta(days=now.weekday() + 7 * back))[0]
        return monday, monday + timedelta(days=7, seconds=-1)
    if m[2] == "month":
        at = _back(now.replace(day=1), int(back))
        return _month(at.year, at.month)
    return _month(now.year - back, 1)[0], _month(now.year - back, 12)[1]


def _named(m: re.Match, now: datetime):
    month, day, year = MONTHS[m[2]], m[1] or m[3], m[4]
    y = int(year) if year else now.year - (month > now.month)
    return _day(datetime(y, month, int(day))) if day else _month(y, month)


def _nth(m: re.Match, now: datetime):
    day = int(m[1])
    for back in range(0, 4):
        at = _back(now.replace(day=1), back)
        if day <= calendar.monthrange(at.year, at.month)[1] and at.replace(day=day) <= now:
            return _day(at.replace(day=day))
    return None


RULES = ((ISO, _iso), (DAY, lambda m, now: _day(now - timedelta(days=m[1] == "yesterday"))), (LAST, _last), (AGO, _ago), (NTH, _nth), (MONTH, _named))


def parse_span(text: str | None, now: int, offset: int = 0) -> tuple[int, int] | None:
    """(start, end) in UTC seconds of the first date phrase of ``text``, read under a clock ``now`` and an offset in seconds; null if none."""
    if not text:
        return None
    local, low, found = datetime.fromtimestamp(now + offset, UTC).replace(tzinfo=None), text.lower(), []
    for pattern, rule in RULES:
        for m in pattern.finditer(low):
            try:
                span = rule(m, local)
            except ValueError:  # no such day
                continue
            if span:
                found.append((m.start(), -m.end(), span))
                break
    if not found:
        return None
    a, b = min(found)[2]
    return tuple(int(x.replace(tzinfo=UTC).timestamp()) - offset for x in (a, b))


def span_udf(now: int, offset: int = 0):  # noqa: ANN201
    """An Arrow UDF from a text to struct<start_at, end_at>; the package goes to the executors of the active session."""
    ship(SparkSession.active())

    @F.pandas_udf("start_at long, end_at long")
    def span(texts: pd.Series) -> pd.DataFrame:
        rows = [parse_span(t, now, offset) or (None, None) for t in texts]
        return pd.DataFrame(rows, columns=["start_at", "end_at"]).astype("Int64")

    return span


def epoch(ts: str, unit: str = "SECOND") -> Column:
    """Whole seconds (or MICROSECONDs) since 1970 of a timestamp column whose wall clock is UTC, whatever the session's zone."""
    return F.expr(f"timestampdiff({unit}, timestamp_ntz'1970-01-01 00:00:00', cast({ts} as timestamp_ntz))")


def wall_clock(micros: Column) -> Column:
    """The UTC wall clock of microseconds since 1970, as a timestamp without zone."""
    return F.make_timestamp_ntz(F.lit(1970), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (micros / 1_000_000).cast("decimal(18,6)"))
