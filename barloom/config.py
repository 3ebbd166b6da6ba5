"""Parameters of the rules."""

from __future__ import annotations

from dataclasses import dataclass


# The defaults of the classes below are the rules' own numbers.


@dataclass(frozen=True)
class Legacy:
    """The older rule: a calm drop line, a rising rise line, no long wick and no large fall."""

    gs_max: float = 5.0
    lookback: int = 15
    hold_min: int = 3
    hold_good: int = 5
    std_max: float = 2.0
    spike: float = 8.0
    gb_min: float = 10.0
    slope_min: float = 1.0
    wick_max: float = 0.5
    wick_bars: int = 3
    big_down: float = -4.0
    gs_entry: float | None = 1.0
    # exits
    gs_exit: float = 5.0
    gs_hard: float = 8.0
    exit_down: float = -4.0
    gb_drop: float = -3.0
    trail: float = -8.0
    max_days: int = 40
    gs_warn: float = 3.5
    stop: float = -7.0
    take: float = 30.0


@dataclass(frozen=True)
class TB:
    """The momentum rule: T and B above their floors for some bars in a row."""

    t_min: float = 20.0
    b_min: float = 60.0
    hold_min: int = 4
    hold_timely: int = 7
    hold_cap: int = 60
    gs_entry: float = 1.0
    homerun: float = 1.0
    t_warn: float = 5.0
    b_warn: float = 3.0
    stop: float = -10.0
    take: float = 30.0


@dataclass(frozen=True)
class Weekly:
    """The weekly rule: calm drop lines and high rise lines on the day and in the last whole week."""

    gs_max: float = 5.0
    gb_min: float = 40.0
    # exits: the week's drop line, and a stop within the day; no take
    week_exit: float = 25.0
    stop: float = -12.0
    take: float | None = None
    # new orders only while so large a share of the largest companies stands above its close of some bars before
    breadth_min: float = 0.55
    breadth_codes: int = 200


@dataclass(frozen=True)
class Limits:
    min_bars: int = 130
    first_index: int = 120
    min_amount: float = 3e8
    max_positions: int = 10
    top_candidates: int = 40
    top_history: int = 15
    history_days: int = 260
    chart_bars: int = 160
    hourly_bars: int = 240
    hourly_codes: int = 160
    chart_codes: int = 60
    per_market: tuple = (("KOSPI", 200), ("KOSDAQ", 150))
    min_price: float = 1000.0


LEGACY, MOMENTUM, WEEKLY, LIMITS = Legacy(), TB(), Weekly(), Limits()
#: Strategy tags, and the keywords of exit reasons in the order in which they are looked for.
LEGACY_TAG, TB_TAG, WEEKLY_TAG, OTHER = "기존", "TB", "주봉", "기타"
REASONS = ("손절", "익절", "청선", "장대음봉", "30일선", "적선", "고점", "기간", "이탈")
HOMERUN, NORMAL = "홈런", "일반"
