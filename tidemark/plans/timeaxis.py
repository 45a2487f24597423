"""From tokens and instants to windows, buckets and grids: plain Python on a handful of parameters. All times are UTC, all windows half open."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, date, datetime, timedelta

BUCKETS = {"day": 1, "week": 7, "month": 28}
PRESETS = ("7d", "30d", "3m", "1y", "all", "custom")
RULES = ("none", "previous", "same_period_last_year", "custom")
FLOOR = date(2000, 1, 1)
MOST_POINTS = 1000


class AxisError(ValueError):
    """Parameters that name no window or bucket."""


def parse_bucket(name: str) -> str:
    if name in BUCKETS:
        return name
    raise AxisError(f"bucket {name} is too fine" if name in ("minute", "second", "hour") else f"unknown bucket {name!r}")


def shift(day: date, years: int = 0, months: int = 0, days: int = 0) -> date:
    """Calendar arithmetic that rolls over: 29 February minus a year is 1 March."""
    month = day.year * 12 + day.month - 1 + years * 12 + months
    return date(month // 12, month % 12 + 1, 1) + timedelta(days=day.day - 1 + days)


def snap(day: date, bucket: str) -> date:
    """The start of the bucket that holds day; weeks start on Monday."""
    return day if bucket == "day" else day - timedelta(days=day.weekday()) if bucket == "week" else day.replace(day=1)


def following(start: date, bucket: str) -> date:
    return shift(start, months=1) if bucket == "month" else start + timedelta(days=BUCKETS[bucket])


@dataclass(frozen=True)
class Window:
    start: datetime
    end: datetime

    @staticmethod
    def of(start: date, end: date) -> Window:
        at = lambda d: datetime(d.year, d.month, d.day)
        return Window(at(start), at(end))

    @property
    def days(self) -> int:
        return int((self.end - self.start) / timedelta(hours=24) + 0.5)

    @property
    def last(self) -> datetime:
        return self.end - timedelta(days=1)

    def grid(self, bucket: str) -> list[date]:
        out, at = [], snap(self.start.date(), bucket)
        while datetime(at.year, at.month, at.day) < self.end:
            out.append(at)
            at = following(at, bucket)
        return out

    def guard(self, bucket: str) -> None:
        """A read may have at most MOST_POINTS buckets, by whole bucket widths."""
        if self.end <= self.start:
            raise AxisError("the window ends before it starts")
        if (self.end - self.start) // timedelta(days=BUCKETS[parse_bucket(bucket)]) > MOST_POINTS:
            raise AxisError(f"more than {MOST_POINTS} points; take a coarser bucket")


@dataclass(frozen=True)
class Tokens:
    preset: str
    baseline: str = "none"
    bucket: str | None = None
    start: date | None = None
    end: date | None = None
    baseline_start: date | None = None
    baseline_end: date | None = None


@dataclass(frozen=True)
class Axis:
    window: Window
    bucket: str
    baseline: Window | None


def validate(t: Tokens) -> None:
    if t.preset not in PRESETS or t.baseline not in RULES:
        raise AxisError("unknown preset or baseline rule")
    for given, lo, hi, what in ((t.preset == "custom", t.start, t.end, "range"), (t.baseline == "custom", t.baseline_start, t.baseline_end, "baseline")):
        if given and (lo is None or hi is None or lo >= hi):
            raise AxisError(f"a custom {what} needs ordered bounds")
        if not given and (lo is not None or hi is not None):
            raise AxisError(f"bounds belong to a custom {what}")


def auto_bucket(days: int) -> str:
    return "day" if days <= 31 else "week" if days <= 366 else "month"


def resolve(t: Tokens, today: date) -> Axis:
    """Tokens to a window, a bucket and the window that it is compared with. Presets end with the start of today."""
    validate(t)
    starts = {"7d": shift(today, days=-7), "30d": shift(today, days=-30), "3m": shift(today, months=-3), "1y": shift(today, years=-1), "all": FLOOR}
    window = Window.of(t.start, t.end) if t.preset == "custom" else Window.of(starts[t.preset], today)
    if t.preset == "all" and t.baseline != "none":
        raise AxisError("all time has nothing to be compared with")
    first, last = window.start.date(), window.end.date()
    baseline = {
        "none": lambda: None,
        "previous": lambda: Window(window.start - (window.end - window.start), window.start),
        "same_period_last_year": lambda: Window.of(shift(first, years=-1), shift(last, years=-1)),
        "custom": lambda: Window.of(t.baseline_start, t.baseline_end),
    }[t.baseline]()
    return Axis(window, parse_bucket(t.bucket) if t.bucket else auto_bucket(window.days), baseline)


def fold(first: date, last: date, window: Window, bucket: str) -> tuple[date, date] | None:
    """The first and last bucket of an inclusive span of days within the window; None if they don't meet."""
    first, last = min(first, last), max(first, last)
    lo, hi = max(first, window.start.date()), min(last, (window.end - timedelta(microseconds=1)).date())
    return (snap(lo, bucket), snap(hi, bucket)) if lo <= hi else None


def axis_echo(window: Window) -> dict:
    """What a read says about its window."""
    return {"from": window.start, "to": window.end, "last": window.last, "days": window.days}


def utc(moment: datetime) -> datetime:
    """A naive UTC time."""
    return moment.astimezone(UTC).replace(tzinfo=None) if moment.tzinfo else moment
