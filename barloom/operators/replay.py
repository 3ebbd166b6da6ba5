"""Replay of orders and positions, day by day, without looking ahead."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.config import LEGACY, LEGACY_TAG, LIMITS, MOMENTUM, TB_TAG, WEEKLY, WEEKLY_TAG, Legacy, Weekly
from barloom.config import TB as Momentum

#: What a day's row needs, for every code that is ever a candidate; rank is null where the code is none that day.
DAY = "code long, d date, open long, high long, low long, close long, gsell double, gb_slope5 double, t double, b double, chg1 double, above_ma30 boolean, ma30 long, red boolean, wick double, score double, rank int, grade string"
#: The same for the weekly rule: wgs is the drop line of the last whole week.
WEEK = "code long, d date, open long, high long, low long, close long, wgs double, score double, rank int, grade string"
LOG = "strategy string, seq long, d date, code long, action string, severity string, reason string, price long, score double, rank int, grade string, entry_date date, entry_price long, days_held int, pnl_pct double"


def pct(a: float, b: float) -> float:
    return (a / b - 1) * 100 if b else 0.0


# The words of reasons and severities in the log.
CALM, WARN, EXIT, AGED, BROKEN = "정상", "주의", "청산", "기간", "이탈"
KEPT_LEGACY, KEPT_TB, KEPT_WEEKLY = "조건 유지", "T·B 유지", "주봉 유지"
SAY = {
    "hard": "청선 {gsell} — {limit}선 초과 급이탈",
    "down": "장대음봉 {chg1:+.1f}%",
    "ma30": "30일선 이탈 (종가 {close:,} < {ma30:,})",
    "exit": "청선 {gsell} — 5선 이탈",
    "slope": "적선 5일 기울기 {gb_slope5:+.1f} — 상승탄력 꺾임",
    "trail": "고점 대비 {fall:+.1f}% 되밀림",
    "aged": "보유 {days}일 경과 — 기간 청산",
    "wick": "위꼬리 {wick}",
    "rising": "청선 {gsell} 상승",
    "mesh": "그물망 상승배열 아님",
    "below": "{leg} {value} < {limit:.0f}",
    "near": "{leg} {value} 기준선 근접",
    "line": "청선 {gsell}",
    "left": " 이탈",
    "week": "주봉 청선 {wgs} > {limit:.0f}",
    "sold": "{reason} → {signal_date} 종가신호, 시가 체결",
    "bought": "{signal_date} 종가신호 {score}점 {rank}위 → 시가 체결",
    "entered": "진입",
    "stopped": "장중 손절 (기준 {stop}%) {pnl:+.1f}%",
    "taken": "장중 익절 (목표 +{take:.0f}%) {pnl:+.1f}%",
    "stop": "손절",
    "take": "익절",
}
JOINT = " · "


def legacy_exit(s: dict, pos: dict, p: Legacy = LEGACY) -> tuple[str, str, str]:
    """(action, reason, severity) for a held code at the close."""
    fall = pct(s["close"], max(pos["peak"], s["close"]))
    tests = (
        (s["gsell"] > p.gs_hard, "hard", EXIT),
        (s["chg1"] <= p.exit_down, "down", EXIT),
        (not s["above_ma30"], "ma30", EXIT),
        (s["gsell"] > p.gs_exit, "exit", EXIT),
        (s["gb_slope5"] <= p.gb_drop, "slope", EXIT),
        (fall <= p.trail, "trail", EXIT),
        (pos["days"] >= p.max_days, "aged", AGED),
    )
    for met, why, severity in tests:
        if met:
            return "SELL", SAY[why].format(**{**s, "fall": fall, "days": pos["days"], "limit": p.gs_hard}), severity
    care = [SAY[why].format(**s) for met, why in ((s["wick"] > p.wick_max, "wick"), (s["gsell"] > p.gs_warn, "rising"), (not s["red"], "mesh")) if met]
    return "HOLD", JOINT.join(care) or KEPT_LEGACY, WARN if care else CALM


def tb_exit(s: dict, pos: dict, p: Momentum = MOMENTUM) -> tuple[str, str, str]:
    legs = (("T", s["t"], p.t_min, p.t_warn), ("B", s["b"], p.b_min, p.b_warn))
    broken = [SAY["below"].format(leg=n, value=x, limit=least) for n, x, least, _ in legs if x < least]
    if broken:
        return "SELL", JOINT.join(broken) + SAY["left"], BROKEN
    care = [SAY["near"].format(leg=n, value=x) for n, x, least, near in legs if x < least + near]
    care += [SAY["line"].format(**s)] if s["gsell"] > p.homerun else []
    return "HOLD", JOINT.join(care) or KEPT_TB, WARN if care else CALM


def weekly_rule_exit(s: dict, pos: dict, p: Weekly = WEEKLY) -> tuple[str, str, str]:
    """The last whole week's drop line above its limit sells; a code without a whole week is kept."""
    if s["wgs"] is not None and s["wgs"] > p.week_exit:
        return "SELL", SAY["week"].format(wgs=s["wgs"], limit=p.week_exit), EXIT
    return "HOLD", KEPT_WEEKLY, CALM


class Book:
    """One strategy's positions and pending orders. step() plays a day: orders at the open, stop and take within the day,
    then exits and new orders by the close. State is plain data, so that it can be kept between runs."""

    def __init__(self, strategy: str, exit_rule: Callable, stop: float | None, take: float | None, slots: int = LIMITS.max_positions, state: dict | None = None):
        self.strategy, self.exit_rule, self.stop, self.take, self.slots = strategy, exit_rule, stop, take, slots
        state = state or {}
        self.held: dict = state.get("held", {})
        self.selling: list = state.get("selling", [])
        self.buying: list = state.get("buying", [])
        self.seq: int = state.get("seq", 0)

    def state(self) -> dict:
        return {"held": self.held, "selling": self.selling, "buying": self.buying, "seq": self.seq}

    def _log(self, out: list, d, code, action, severity, reason, price, pos, pnl, score=None, rank=None) -> None:
        out.append((self.strategy, self.seq, d, code, action, severity, reason, int(price), score, rank, pos["grade"], pos["entry_date"], int(pos["entry"]), pos["days"], pnl))
        self.seq += 1

    def _open(self, d, day: dict, out: list) -> None:
        for order in self.selling:
            s, pos = day.get(order["code"]), self.held.get(order["code"])
            if s is None or pos is None:
                continue  # the order lapses
            del self.held[order["code"]]
            self._log(out, d, order["code"], "SELL", order["severity"], SAY["sold"].format(**order), s["open"], pos, round(pct(s["open"], pos["entry"]), 2))
        for order in self.buying:
            code = order["code"]
            s = day.get(code)
            if s is None or code in self.held or len(self.held) >= self.slots:
                continue
            pos = self.held[code] = {"entry": s["open"], "entry_date": d, "peak": s["open"], "days": 0, "grade": order["grade"]}
            self._log(out, d, code, "BUY", order["grade"] or SAY["entered"], SAY["bought"].format(**order), s["open"], pos, 0.0, order["score"], order["rank"])

    def _within(self, d, day: dict, out: list) -> None:
        for code in list(self.held):
            s, pos = day.get(code), self.held[code]
            if s is None:
                continue
            low = None if self.stop is None else pos["entry"] * (1 + self.stop / 100.0)
            high = None if self.take is None else pos["entry"] * (1 + self.take / 100.0)
            if low is not None and s["low"] <= low:
                price, kind, why = int(min(low, s["open"])), "stop", "stopped"
            elif high is not None and s["high"] >= high:
                price, kind, why = int(max(high, s["open"])), "take", "taken"
            else:
                continue
            del self.held[code]
            pnl = round(pct(price, pos["entry"]), 2)
            self._log(out, d, code, "SELL", SAY[kind], SAY[why].format(stop=self.stop, take=self.take, pnl=pnl), price, pos, pnl)

    def _close(self, d, day: dict, out: list) -> None:
        self.selling, self.buying = [], []
        for code, pos in self.held.items():
            s = day.get(code)
            if s is None:
                continue  # no bar: it neither ages nor is judged
            pos["days"] += 1
            pos["peak"] = max(pos["peak"], s["close"])
            action, reason, severity = self.exit_rule(s, pos)
            if action == "SELL":
                self.selling.append({"code": code, "reason": reason, "severity": severity, "signal_date": str(d)})
            else:
                self._log(out, d, code, "HOLD", severity, reason, s["close"], pos, round(pct(s["close"], pos["entry"]), 2))
        room = self.slots - len(self.held) + len(self.selling)
        for code in day.ranked():
            if len(self.buying) >= room:
                break
            if code not in self.held:
                s = day.get(code)
                self.buying.append({"code": s["code"], "score": s["score"], "rank": s["rank"], "grade": s["grade"] or "", "signal_date": str(d)})

    def orders(self, d) -> list[tuple]:
        """What stands to be done at the next open, as log rows."""
        out = [(o["code"], "SELL", o["severity"], o["reason"], None, None, self.held[o["code"]]["grade"]) for o in self.selling]
        out += [(o["code"], "BUY", o["grade"] or SAY["entered"], "", o["score"], o["rank"], o["grade"]) for o in self.buying]
        return [(self.strategy, None, d, code, f"ORDER {side}", severity, reason, None, score, rank, grade, None, None, None, None) for code, side, severity, reason, score, rank, grade in out]

    def step(self, d, day: Day | dict) -> list[tuple]:
        """day: the rows of the codes with a bar that day, or {code: row}."""
        day = day if isinstance(day, Day) else Day.of(day.values())
        out: list[tuple] = []
        self._open(d, day, out)
        self._within(d, day, out)
        self._close(d, day, out)
        return out


def books(strategy: str, state: dict | None = None, slots: int = LIMITS.max_positions) -> Book:
    rules = {TB_TAG: (tb_exit, MOMENTUM), LEGACY_TAG: (legacy_exit, LEGACY), WEEKLY_TAG: (weekly_rule_exit, WEEKLY)}
    if strategy not in rules:
        raise ValueError(f"no strategy {strategy}")
    exit_rule, p = rules[strategy]
    return Book(strategy, exit_rule, p.stop, p.take, slots, state)


def _value(x):
    return None if x is None or x is pd.NaT or x is pd.NA or x != x else x


WHOLE = {"rank", "open", "high", "low", "close", "ma30", "code"}


class Day:
    """The rows of a day by code. A row is made when it is asked for: few are, as only what is held, ordered or a
    candidate counts."""

    def __init__(self, cols: dict[str, list], places: dict[int, int], ranks: list[tuple[int, int]]):
        self.cols, self.places, self.ranks = cols, places, ranks

    @classmethod
    def of(cls, rows: Iterable[dict]) -> Day:
        rows = list(rows)
        cols = {k: [r[k] for r in rows] for k in (rows[0] if rows else ())}
        return cls(cols, {r["code"]: at for at, r in enumerate(rows)}, [(r["rank"], r["code"]) for r in rows if r["rank"] is not None])

    def get(self, code: int) -> dict | None:
        """The row of a code; numbers that pandas made of nulls are None again."""
        at = self.places.get(code)
        if at is None:
            return None
        row = {k: _value(v[at]) for k, v in self.cols.items()}
        return row | {k: int(row[k]) for k in WHOLE & row.keys() if row[k] is not None}

    def ranked(self) -> list[int]:
        """The candidates' codes, best first."""
        return [code for _, code in sorted(self.ranks)]


def days_of(cols: dict[str, list]) -> dict[date, Day]:
    """Columns of rows as days, in order."""
    out: dict = {}
    for at, (d, code, rank) in enumerate(zip(cols["d"], cols["code"], cols["rank"], strict=True)):
        day = out.get(d)
        if day is None:
            day = out[d] = Day(cols, {}, [])
        code = int(code)
        day.places[code] = at
        if rank == rank and rank is not None and rank is not pd.NA:
            day.ranks.append((int(rank), code))
    return dict(sorted(out.items()))


def columns_of(pdf: pd.DataFrame) -> dict[str, list]:
    return {c: pdf[c].tolist() for c in pdf.columns if c != "strategy"}


# --- the replay in three steps. What becomes of a position follows from its code's bars alone; only which candidates get one
# of the few slots couples codes, and for that a day's best candidates suffice


class One(Day):
    """A day of one code, or of none."""

    def __init__(self, row: dict | None):
        self.row = row

    def get(self, code: int) -> dict | None:
        return self.row if self.row is not None and self.row["code"] == code else None

    def ranked(self) -> list[int]:
        return []


ROW = "d date, action string, severity string, reason string, price long, score double, rank int, grade string, entry_date date, entry_price long, days_held int, pnl_pct double"
#: A candidate as a position: signal and fill are numbers of days (fill null if its code has no bar on the next day);
#: kinds has a letter a day from the fill on: h held, s ordered to be sold, - no bar; leaves is the day on which it is
#: sold, at the open or within the day; log its rows in order.
TRADE = f"strategy string, code long, signal int, rank int, fill int, kinds string, leaves int, at_open boolean, log array<struct<{', '.join(x.replace(' ', ': ', 1) for x in ROW.split(', '))}>>"


class Bars:
    """A code's bars in order, made to rows when they are asked for."""

    def __init__(self, cols: dict[str, list]):
        self.cols, self.rows = cols, [None] * len(cols["k"])

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, i: int) -> dict:
        if self.rows[i] is None:
            row = {k: _value(v[i]) for k, v in self.cols.items()}
            self.rows[i] = row | {k: int(row[k]) for k in (WHOLE | {"k"}) & row.keys() if row[k] is not None}
        return self.rows[i]


def trade_of(strategy: str, rows: Bars, at: int) -> tuple:
    """What becomes of the candidate rows[at] if it is bought at the next day's open. rows: a code's bars in order, with
    the number k of their day."""
    s = rows[at]
    code, signal = s["code"], s["k"]
    head = (strategy, code, signal, s["rank"])
    if at + 1 == len(rows) or rows[at + 1]["k"] != signal + 1:
        return (*head, None, "", None, None, [])
    order = {"code": code, "score": s["score"], "rank": s["rank"], "grade": s["grade"] or "", "signal_date": str(s["d"])}
    book, log, kinds, k = books(strategy, {"buying": [order]}, 1), [], "", signal
    for i in range(at + 1, len(rows)):
        row = rows[i]
        if row["k"] > k + 1:
            book.step(None, One(None))  # days without a bar: an order to sell lapses
            kinds += "-" * (row["k"] - k - 1)
        k, ordered = row["k"], bool(book.selling)
        log += book.step(row["d"], One(row))
        if not book.held:
            return (*head, signal + 1, kinds, k, ordered, _rows(log))
        kinds += "s" if book.selling else "h"
    return (*head, signal + 1, kinds, None, None, _rows(log))


def _rows(log: list[tuple]) -> list[tuple]:
    """Log rows without strategy, number and code."""
    return [(r[2], *r[4:]) for r in log]


def chosen(trades: Iterable[tuple], last: int, slots: int = LIMITS.max_positions) -> list[tuple]:
    """(code, signal, numbers of its log rows) of the candidates that get a slot. trades: (signal, rank, code, fill, kinds,
    leaves, at_open) of each day's best candidates; last: the number of the last day. A day: orders to sell, then to buy
    while there are slots; sales within the day; at the close held codes are judged, and as many of the best candidates
    that aren't held are ordered as there are slots, those to be sold counting as free."""
    by_day: dict[int, list] = {}
    for t in sorted(trades):
        by_day.setdefault(t[0], []).append(t)
    held: dict[int, tuple] = {}
    seqs: dict[tuple, list] = {}
    selling, buying, seq = [], [], 0

    def told(t: tuple) -> None:
        nonlocal seq
        seqs.setdefault((t[2], t[0]), []).append(seq)
        seq += 1

    for k in range(last + 1):
        for t in selling:
            if t[5] == k and t[6]:
                del held[t[2]]
                told(t)
        for t in buying:
            if t[3] == k and t[2] not in held and len(held) < slots:
                held[t[2]] = t
                told(t)
        for t in list(held.values()):
            if t[5] == k and not t[6]:
                del held[t[2]]
                told(t)
        selling, buying = [], []
        for t in held.values():
            kind = t[4][k - t[3] : k - t[3] + 1]  # empty after its code's last bar
            if kind == "s":
                selling.append(t)
            elif kind == "h":
                told(t)
        room = slots - len(held) + len(selling)
        for t in by_day.get(k, ()):
            if len(buying) >= room:
                break
            if t[2] not in held:
                buying.append(t)
    return [(code, signal, numbers) for (code, signal), numbers in seqs.items()]


def replay(days: DataFrame, slots: int = LIMITS.max_positions) -> DataFrame:
    """The log of each strategy's book over all days. days: strategy and DAY (or WEEK), only of codes that are ever
    candidates (see ever); ranks of a day are 1, 2, 3 and so on.

    Of a day's candidates no more than the best 2 * slots can be ordered: slots may be free or become free, and as many
    codes may be held already. Each of those is played apart, code by code, as if it got a slot; then one task a strategy
    walks over its days and the at most 2 * slots candidates of each, whatever the number of codes and bars, and tells
    which ones do, and the places of their rows in the log; then those rows are put together."""
    from barloom.sources.shared import kept

    from .sets import small

    days = kept(days, "days")
    calendar = days.select("strategy", "d").distinct()  # a row a strategy and day
    calendar = calendar.withColumn("k", (F.row_number().over(W.partitionBy("strategy").orderBy("d")) - 1).cast("int"))
    best = days.where(F.col("rank") <= 2 * slots).groupBy("strategy", "code").agg(F.min("d").alias("from_"))
    rows = days.join(small(best), ["strategy", "code"]).where("d >= from_").drop("from_").join(small(calendar), ["strategy", "d"])

    def play_code(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        cols = columns_of(pdf)
        bars = Bars(cols)
        out = [trade_of(key[0], bars, i) for i, r in enumerate(cols["rank"]) if r is not None and r <= 2 * slots]  # NaN isn't
        return pd.DataFrame(out, columns=[c.split()[0] for c in TRADE.split(", ")[:8]] + ["log"]).astype({c: "Int64" for c in ("rank", "fill", "leaves")} | {"at_open": "boolean"})

    trades = kept(rows.groupBy("strategy", "code").applyInPandas(play_code, TRADE), "trades")
    last = calendar.groupBy("strategy").agg(F.max("k").alias("last"))

    def choose(key: tuple, pdf: pd.DataFrame, end: pd.DataFrame) -> pd.DataFrame:
        whole = lambda c: [None if x is None or x != x else int(x) for x in pdf[c].tolist()]
        found = list(zip(*(whole(c) for c in ("signal", "rank", "code", "fill")), pdf["kinds"].tolist(), whole("leaves"), [x is True or x == 1 for x in pdf["at_open"].tolist()], strict=True))
        return pd.DataFrame([(key[0], *x) for x in (chosen(found, int(end["last"].iloc[0]), slots) if len(end) else [])], columns=["strategy", "code", "signal", "seqs"])

    slim = trades.select("strategy", "code", "signal", "rank", "fill", "kinds", "leaves", "at_open")
    got = slim.groupBy("strategy").cogroup(last.groupBy("strategy")).applyInPandas(choose, "strategy string, code long, signal int, seqs array<long>")
    out = trades.select("strategy", "code", "signal", "log").join(got, ["strategy", "code", "signal"])
    out = out.select("strategy", "code", F.inline(F.arrays_zip("log", "seqs")))
    return out.select("strategy", F.col("seqs").alias("seq"), "log.d", "code", *[f"log.{c.split()[0]}" for c in ROW.split(", ")[1:]])


def replay_alone(days: DataFrame, slots: int = 1) -> DataFrame:
    """The log of a book of its own for each strategy and code: nothing couples codes, so they are played apart."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        book = books(pdf["strategy"].iloc[0], None, slots)
        return _log_frame([row for d, day in days_of(columns_of(pdf)).items() for row in book.step(d, day)])

    return days.groupBy("strategy", "code").applyInPandas(run, LOG)


def _log_frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in LOG.split(", ")])
    return out.astype({"rank": "Int64", "seq": "Int64", "price": "Int64", "entry_price": "Int64", "days_held": "Int64", "score": "Float64", "pnl_pct": "Float64"})


def _plain(x):
    return x.isoformat() if isinstance(x, date) else int(x)


def to_text(book: Book, last: str) -> str:
    """A book and the last day it has played, to be kept between runs."""
    return json.dumps({"last": last, "book": book.state()}, default=_plain)


def from_text(strategy: str, text: str | None) -> tuple[Book, str]:
    if not text:
        return books(strategy), ""
    kept = json.loads(text)
    book = kept["book"]
    book["held"] = {int(k): v | {"entry_date": date.fromisoformat(v["entry_date"])} for k, v in book["held"].items()}
    return books(strategy, book), kept["last"]


def play(strategy: str, text: str | None, cols: dict[str, list], orders: bool = False) -> tuple[list[tuple], str]:
    """Plays the days of columns that come after the last one the kept book has played: its log rows and the new text. So a
    day that is given twice is played once."""
    book, last = from_text(strategy, text)
    out: list[tuple] = []
    for d, day in days_of(cols).items():
        if str(d) > last:
            out += book.step(d, day) + (book.orders(d) if orders else [])
            last = str(d)
    return out, to_text(book, last)


def resume(days: DataFrame, states: DataFrame) -> DataFrame:
    """replay(), with orders, from kept books on. states: strategy, state. The log has a column state, filled in one more
    row a strategy, which has no action: the book to keep."""
    names = [c.split()[0] for c in LOG.split(", ")]

    def run(key: tuple, pdf: pd.DataFrame, kept: pd.DataFrame) -> pd.DataFrame:
        text = kept["state"].iloc[0] if len(kept) else None
        log, text = play(key[0], text, columns_of(pdf), orders=True)
        out = pd.DataFrame(log, columns=names)
        out["state"] = None
        return pd.concat([out, pd.DataFrame([{**dict.fromkeys(names), "strategy": key[0], "state": text}])], ignore_index=True).astype({"rank": "Int64", "code": "Int64", "seq": "Int64", "price": "Int64", "entry_price": "Int64", "days_held": "Int64", "score": "Float64", "pnl_pct": "Float64"})

    return days.groupBy("strategy").cogroup(states.groupBy("strategy")).applyInPandas(run, f"{LOG}, state string")


#: Indicators that a full log row copies from the day's snapshot.
COPIED = ("gbuy", "gsell", "gs_hold", "gs_mean", "gs_std", "gb_slope5", "t", "b", "u", "red", "ma30", "chg1", "chg5", "chg20", "vol", "amount")


def log_rows(log: DataFrame, snapshots: DataFrame, meta: DataFrame) -> DataFrame:
    """The log in its full form of 32 columns: with name and market (the code itself, and none, where unknown) and the
    day's indicators. meta: code, name, market."""
    from .sets import with_meta

    out = with_meta(log.join(snapshots.select("code", "d", *COPIED), ["code", "d"], "left"), meta)
    first = ["strategy", "seq", F.col("d").alias("date"), "code", "name", "market", "action", "severity", "reason", "price", "score", "rank", "grade", "entry_date", "entry_price", "days_held", "pnl_pct"]
    return out.select(*first, *COPIED)


def ever(both: DataFrame) -> DataFrame:
    """Days of those codes only that are candidates on some day, from their first such day on, with the rank by falling
    score on days on which they are. both: snapshot columns with strategy, ok, score, grade (signals.both)."""
    code = W.partitionBy("strategy", "code")
    rows = both.withColumn("first", F.min(F.when(F.col("ok"), F.col("d"))).over(code)).where("d >= first")
    rank = F.row_number().over(W.partitionBy("strategy", "d", "ok").orderBy(F.desc("score"), "code"))
    rows = rows.withColumn("rank", F.when(F.col("ok"), rank))
    rows = rows.withColumns({"score": F.when(F.col("ok"), F.col("score")), "grade": F.when(F.col("ok"), F.col("grade"))})
    return rows.select("strategy", *[F.col(c.split()[0]).cast(c.split()[1]) for c in DAY.split(", ")])
