from datetime import date, datetime

import pytest

from tidemark.plans.timeaxis import AxisError, Tokens, Window, fold, parse_bucket, resolve, shift, snap

TODAY = date(2026, 7, 9)


@pytest.mark.parametrize(("preset", "start", "bucket"), [("7d", date(2026, 7, 2), "day"), ("30d", date(2026, 6, 9), "day"), ("3m", date(2026, 4, 9), "week"), ("1y", date(2025, 7, 9), "week"), ("all", date(2000, 1, 1), "month")])
def test_presets(preset, start, bucket):
    axis = resolve(Tokens(preset), TODAY)
    assert (axis.window.start.date(), axis.window.end.date(), axis.bucket, axis.baseline) == (start, TODAY, bucket, None)


def test_calendar_rolls_over():
    assert shift(date(2024, 2, 29), years=-1) == date(2023, 3, 1)
    assert shift(date(2024, 5, 31), months=-3) == date(2024, 3, 2)
    axis = resolve(Tokens("30d", "same_period_last_year"), date(2024, 3, 30))
    assert axis.baseline == Window.of(date(2023, 3, 1), date(2023, 3, 30))


def test_previous_and_custom():
    assert resolve(Tokens("7d", "previous"), TODAY).baseline == Window.of(date(2026, 6, 25), date(2026, 7, 2))
    axis = resolve(Tokens("custom", bucket="month", start=date(2020, 1, 1), end=date(2021, 1, 1)), TODAY)
    assert axis.bucket == "month" and axis.window.days == 366


@pytest.mark.parametrize("t", [Tokens("9d"), Tokens("all", "previous"), Tokens("custom"), Tokens("7d", start=TODAY), Tokens("custom", start=TODAY, end=TODAY), Tokens("7d", "custom"), Tokens("7d", bucket="hour")])
def test_errors(t):
    with pytest.raises(AxisError):
        resolve(t, TODAY)


def test_grid_and_guard():
    window = Window.of(date(2024, 1, 3), date(2024, 1, 20))
    assert window.grid("week") == [date(2024, 1, 1), date(2024, 1, 8), date(2024, 1, 15)]
    Window(datetime(2020, 1, 1), datetime(2022, 9, 27, 23)).guard("day")
    with pytest.raises(AxisError):
        Window(datetime(2020, 1, 1), datetime(2022, 9, 28)).guard("day")
    with pytest.raises(AxisError):
        parse_bucket("fortnight")


def test_fold():
    window = Window.of(date(2024, 1, 3), date(2024, 2, 10))
    assert fold(date(2024, 1, 1), date(2024, 1, 10), window, "week") == (date(2024, 1, 1), date(2024, 1, 8))
    assert fold(date(2024, 3, 1), date(2024, 2, 5), window, "month") == (date(2024, 2, 1), date(2024, 2, 1))
    assert fold(date(2024, 2, 10), date(2024, 3, 1), window, "day") is None
    assert snap(date(2024, 12, 31), "week") == date(2024, 12, 30)


def test_echo():
    from datetime import datetime

    from tidemark.plans.timeaxis import axis_echo

    w = Window.of(date(2024, 1, 1), date(2024, 1, 8))
    assert axis_echo(w) == {"from": datetime(2024, 1, 1), "to": datetime(2024, 1, 8), "last": datetime(2024, 1, 7), "days": 7}
