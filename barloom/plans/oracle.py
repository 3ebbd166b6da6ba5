"""SQL with the same results as the queries, over the same tables: common table expressions that build on each other."""

from __future__ import annotations


def rnd(x: str, k: int) -> str:
    m = f"{10**k}.0"
    return f"(floor(({x}) * {m}::DOUBLE + 0.5::DOUBLE) / {m}::DOUBLE)"


W = "PARTITION BY code ORDER BY d"


def last(n: int) -> str:
    return f"({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def sma(x: str, n: int) -> str:
    return f"CASE WHEN i >= {n - 1} THEN avg({x}) OVER {last(n)} END"


BARS = """t AS (
  SELECT l_suppkey AS code, CAST(l_shipdate AS DATE) AS d, l_orderkey AS k1, l_linenumber AS k2, l_partkey AS k3,
         l_quantity AS q, (l_orderkey*7919 + l_linenumber*104729 + l_partkey*1299709) % 401 - 200 AS step
  FROM lineitem),
p AS (
  SELECT code, d, q, k2, row_number() OVER (PARTITION BY code ORDER BY d,k1,k2,k3) AS tick,
         CAST(greatest(1000, 20000 + sum(step) OVER (PARTITION BY code ORDER BY d,k1,k2,k3 ROWS UNBOUNDED PRECEDING)) AS DOUBLE) AS px
  FROM t),
bars AS (SELECT code, d, min_by(px,tick) AS o, max(px) AS h, min(px) AS l, max_by(px,tick) AS c, sum(q) AS v FROM p GROUP BY code, d),
x0 AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY d) - 1 AS i, lag(c) OVER (PARTITION BY code ORDER BY d) AS pc FROM bars),
x1 AS (SELECT *, coalesce(c - pc, 0.0) AS mom, c - least(l, coalesce(pc, c)) AS bp, greatest(h, coalesce(pc, c)) - least(l, coalesce(pc, c)) AS tr FROM x0)"""

# every recursive mean of a code in one walk over its bars; seeds are means of the first values
EMAS = """y AS MATERIALIZED (
  SELECT code, i, d, c, mom, abs(mom) AS am, greatest(mom, 0.0) AS up, greatest(-mom, 0.0) AS dn,
    avg(mom) OVER w10 AS m10, avg(abs(mom)) OVER w10 AS a10, avg(greatest(mom, 0.0)) OVER w35 AS u35, avg(greatest(-mom, 0.0)) OVER w35 AS d35, avg(c) OVER w10 AS c10
  FROM x1 WINDOW w10 AS (PARTITION BY code ORDER BY d ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), w35 AS (PARTITION BY code ORDER BY d ROWS BETWEEN 34 PRECEDING AND CURRENT ROW)),
r AS (
  SELECT code, i, NULL::DOUBLE AS ec, NULL::DOUBLE AS em, NULL::DOUBLE AS ea, 0.0::DOUBLE AS sm, 0.0::DOUBLE AS sa, NULL::DOUBLE AS fm, NULL::DOUBLE AS fa, NULL::DOUBLE AS tt, 0.0::DOUBLE AS st, NULL::DOUBLE AS ts, NULL::DOUBLE AS uu, NULL::DOUBLE AS dd
  FROM y WHERE i = 0
  UNION ALL
  SELECT code, i, ec, em, ea, sm, sa, fm, fa, tt,
    CASE WHEN i BETWEEN 38 AND 45 THEN st + tt ELSE st END,
    CASE WHEN i = 45 THEN (st + tt) / 8 WHEN i > 45 THEN tt * (2.0/9)::DOUBLE + ts * (1 - (2.0/9)::DOUBLE) END, uu, dd
  FROM (
    SELECT *, CASE WHEN fa IS NOT NULL AND fa <> 0 THEN 100 * fm / fa END AS tt FROM (
      SELECT code, i, ec, em, ea, st, ts, uu, dd,
        CASE WHEN i BETWEEN 9 AND 38 THEN sm + em ELSE sm END AS sm, CASE WHEN i BETWEEN 9 AND 38 THEN sa + ea ELSE sa END AS sa,
        CASE WHEN i = 38 THEN (sm + em) / 30 WHEN i > 38 THEN em * (2.0/31)::DOUBLE + fm * (1 - (2.0/31)::DOUBLE) END AS fm,
        CASE WHEN i = 38 THEN (sa + ea) / 30 WHEN i > 38 THEN ea * (2.0/31)::DOUBLE + fa * (1 - (2.0/31)::DOUBLE) END AS fa
      FROM (
        SELECT y.code, y.i, r.sm, r.sa, r.fm, r.fa, r.st, r.ts,
          CASE WHEN y.i = 9 THEN y.c10 WHEN y.i > 9 THEN y.c * (2.0/11)::DOUBLE + r.ec * (1 - (2.0/11)::DOUBLE) END AS ec,
          CASE WHEN y.i = 9 THEN y.m10 WHEN y.i > 9 THEN y.mom * (2.0/11)::DOUBLE + r.em * (1 - (2.0/11)::DOUBLE) END AS em,
          CASE WHEN y.i = 9 THEN y.a10 WHEN y.i > 9 THEN y.am * (2.0/11)::DOUBLE + r.ea * (1 - (2.0/11)::DOUBLE) END AS ea,
          CASE WHEN y.i = 34 THEN y.u35 WHEN y.i > 34 THEN y.up * (2.0/36)::DOUBLE + r.uu * (1 - (2.0/36)::DOUBLE) END AS uu,
          CASE WHEN y.i = 34 THEN y.d35 WHEN y.i > 34 THEN y.dn * (2.0/36)::DOUBLE + r.dd * (1 - (2.0/36)::DOUBLE) END AS dd
        FROM r JOIN y ON r.code = y.code AND y.i = r.i + 1)))),
em AS (SELECT code, i, ec AS ema, tt AS t, ts AS t_sig, CASE WHEN uu + dd <> 0 THEN 100 * uu / (uu + dd) END AS b FROM r)"""

SERIES = f"""s0 AS (
  SELECT x1.*, em.ema, em.t, em.t_sig, em.b,
    {", ".join(f"{sma('c', n)} AS ma{n}" for n in (10, 15, 20, 25, 30, 35))},
    coalesce((c / min(c) OVER {last(32)} - 1) * 100, 0) AS gb, coalesce((max(c) OVER {last(32)} / c - 1) * 100, 0) AS gs,
    {", ".join(f"CASE WHEN i >= {n - 1} THEN sum(bp) OVER {last(n)} / nullif(sum(tr) OVER {last(n)}, 0) END AS u{n}" for n in (7, 14, 28))}
  FROM x1 JOIN em USING (code, i)),
s1 AS (
  SELECT *, (u7 * 4 + u14 * 2 + u28) * 100 / 7 AS u, coalesce(ma10 > ma35, false) AS red,
    (c / lag(c) OVER ({W}) - 1) * 100 AS chg1, (c / lag(c, 5) OVER ({W}) - 1) * 100 AS chg5, (c / lag(c, 20) OVER ({W}) - 1) * 100 AS chg20,
    gb - lag(gb, 5) OVER ({W}) AS slope5,
    CASE WHEN c <> o THEN (h - greatest(o, c)) / abs(c - o) WHEN h > greatest(o, c) THEN 999.0 ELSE 0.0 END AS wick,
    coalesce(t >= 20 AND b >= 60, false) AS tb_ok
  FROM s0),
s2 AS (
  SELECT *, least(15, i - coalesce(max(CASE WHEN gs > 5 THEN i END) OVER ({W} ROWS UNBOUNDED PRECEDING), -1))::INTEGER AS gs_hold,
    least(60, i - coalesce(max(CASE WHEN NOT tb_ok THEN i END) OVER ({W} ROWS UNBOUNDED PRECEDING), -1))::INTEGER AS tb_hold,
    coalesce(max(CASE WHEN wick > 0.5 AND h > c THEN 1 ELSE 0 END) OVER {last(3)}, 0) = 1 AS bad_wick,
    coalesce(max(CASE WHEN chg1 <= -4 THEN 1 ELSE 0 END) OVER {last(3)}, 0) = 1 AS big_down,
    list(gs) OVER {last(15)} AS gl
  FROM s1),
s3 AS (SELECT *, gl[len(gl) - greatest(gs_hold, 1) + 1:] AS seg, gl[1:len(gl) - gs_hold] AS bef FROM s2),
s4 AS (
  SELECT *, list_avg(seg) AS gs_mean, CASE WHEN len(seg) < 2 THEN 0.0 ELSE list_stddev_pop(seg) END AS gs_std,
    coalesce(gs_hold < 15 AND list_max(bef) > 8, false) AS spike
  FROM s3),
full_ AS (SELECT * FROM s4 WHERE i >= 120 AND t IS NOT NULL AND b IS NOT NULL AND u IS NOT NULL AND ma30 IS NOT NULL)"""

SNAP = f"""snap AS (
  SELECT code, d, trunc(c)::BIGINT AS close, trunc(o)::BIGINT AS open, trunc(h)::BIGINT AS high, trunc(l)::BIGINT AS low,
    {rnd("gb", 1)} AS gbuy, {rnd("gs", 1)} AS gsell, {rnd("slope5", 1)} AS gb_slope5, gs_hold, {rnd("gs_mean", 2)} AS gs_mean, {rnd("gs_std", 2)} AS gs_std,
    {rnd("t", 1)} AS t, {rnd("b", 1)} AS b, {rnd("u", 1)} AS u, red, trunc(ma30)::BIGINT AS ma30, c >= ma30 AS above_ma30,
    {rnd("chg1", 2)} AS chg1, {rnd("chg5", 2)} AS chg5, {rnd("coalesce(chg20, 0)", 2)} AS chg20, {rnd("wick", 2)} AS wick, trunc(v)::BIGINT AS vol, trunc(c * v)::BIGINT AS amount
  FROM full_)"""

LEGACY_SCORE = rnd(
    "least(100.0, greatest(0.0, 22 * least(1.0, gs_hold / 5) + 20 * greatest(0.0, (5 - gs_mean) / 5) + 14 * greatest(0.0, 1 - gs_std / 2) + 16 * least(1.0, slope5 / 12)"
    " + 8 * least(1.0, greatest(0.0, (gb - 10) / 30)) + CASE WHEN spike THEN 0 ELSE 6 END + CASE WHEN red THEN 4 ELSE 0 END + CASE WHEN u >= 50 THEN 5 ELSE 0 END + CASE WHEN t >= 0 THEN 5 ELSE 0 END))",
    1,
)
TB_SCORE = rnd("least(100.0, greatest(0.0, 40 * least(1.0, greatest(0.0, coalesce(chg20, 0)) / 80) + 35 * least(1.0, gb / 60) + 25 * least(1.0, tb_hold / 30)))", 1)
REJECT = "gs_hold < 3 OR gs_std > 2 OR gb < 10 OR slope5 < 1 OR bad_wick OR big_down OR c < ma30"

CANDS = f"""lc AS (SELECT *, {LEGACY_SCORE} AS score FROM full_ WHERE floor(c * v) >= 3e5 AND NOT ({REJECT}) AND gs <= 1),
tc AS (SELECT *, {TB_SCORE} AS score, CASE WHEN gs <= 1 THEN '홈런' ELSE '일반' END AS grade, tb_hold <= 7 AS timely FROM full_ WHERE floor(c * v) >= 3e5 AND tb_ok AND tb_hold >= 4 AND gs <= 1),
cands AS (
  SELECT '기존' AS strategy, code, d, score, '' AS grade FROM lc UNION ALL SELECT 'TB', code, d, score, grade FROM tc),
ranked AS (SELECT *, row_number() OVER (PARTITION BY strategy, d ORDER BY score DESC, code)::INTEGER AS rank FROM cands)"""

# positions that were opened ten bars ago
POS = f"""pos AS (
  SELECT code, d, trunc(lag(o, 10) OVER ({W}))::BIGINT AS entry, 10 + (code + i) % 40 AS days,
    trunc(greatest(lag(o, 10) OVER ({W}), max(c) OVER ({W} ROWS BETWEEN 10 PRECEDING AND CURRENT ROW)))::BIGINT AS peak FROM x0),
held AS (SELECT s.*, p.entry, p.days, p.peak FROM snap s JOIN pos p USING (code, d) WHERE p.entry IS NOT NULL)"""

# closed trades out of every signal: bought at the next open, sold ten opens later
TRADES = f"""fwd AS (SELECT code, d, i, lead(o, 1) OVER ({W}) AS en, lead(o, 11) OVER ({W}) AS ex, lead(d, 1) OVER ({W}) AS ed, lead(d, 11) OVER ({W}) AS xd FROM x0),
log0 AS (
  SELECT r.strategy, r.grade, r.code, f.ed AS entry_date, f.xd AS exit_date, trunc(f.en)::BIGINT AS entry, trunc(f.ex)::BIGINT AS exit,
    {rnd("(trunc(f.ex) / trunc(f.en) - 1) * 100", 2)} AS pnl, (10 + f.i % 3)::INTEGER AS days,
    ['장중 손절 (기준)', '장중 익절', '청선 8.1 — 5선 이탈', '보유 40일 경과 — 기간 청산', 'T 19.9 < 20 이탈', '강제'][(f.i % 6)::INTEGER + 1] AS reason
  FROM ranked r JOIN fwd f USING (code, d) WHERE f.ex IS NOT NULL),
trades AS (SELECT *, (exit_date - DATE '1970-01-01')::BIGINT * 10000000 + code * 10 + CASE WHEN strategy = '기존' THEN 1 ELSE 0 END AS seq FROM log0)"""

FILLS = """fills AS (SELECT code, d, tick AS k, CASE WHEN k2 % 2 = 1 THEN 'buy' ELSE 'sell' END AS side, q AS qty, px AS price FROM p),
f1 AS (SELECT *, sum(CASE WHEN side = 'buy' THEN qty ELSE -qty END) OVER (PARTITION BY code ORDER BY d, k) AS net FROM fills WHERE qty > 0),
f2 AS (SELECT *, least(0.0, min(net) OVER (PARTITION BY code ORDER BY d, k)) AS low FROM f1),
f3 AS (SELECT *, CASE WHEN side = 'buy' THEN qty ELSE qty - (coalesce(lag(low) OVER (PARTITION BY code ORDER BY d, k), 0) - low) END AS eff FROM f2),
f4 AS (SELECT *, sum(eff) OVER (PARTITION BY code, side ORDER BY d, k) AS hi FROM f3),
f5 AS (SELECT *, hi - eff AS lo FROM f4 WHERE eff > 0),
cut AS (SELECT code, hi, coalesce(lag(hi) OVER (PARTITION BY code ORDER BY hi), 0) AS lo FROM (SELECT DISTINCT code, hi FROM f5)),
buys AS (SELECT * FROM f5 WHERE side = 'buy'), sells AS (SELECT * FROM f5 WHERE side = 'sell'),
fc AS (
  SELECT c.code, b.d AS buy_d, b.k AS buy_k, s.d AS sell_d, s.k AS sell_k, b.price AS buy_price, s.price AS sell_price, c.hi - c.lo AS qty
  FROM cut c ASOF JOIN buys b ON c.code = b.code AND c.hi <= b.hi ASOF JOIN sells s ON c.code = s.code AND c.hi <= s.hi),
fo AS (
  SELECT b.code, b.d, b.k, b.price, b.hi - greatest(b.lo, coalesce(s.sold, 0)) AS qty
  FROM f5 b LEFT JOIN (SELECT code, max(hi) AS sold FROM f5 WHERE side = 'sell' GROUP BY code) s USING (code) WHERE b.side = 'buy' AND b.hi > greatest(b.lo, coalesce(s.sold, 0)))"""

WEEKS = f"""wk AS (SELECT code, date_trunc('week', d)::DATE AS w, min_by(o, d) AS o, max(h) AS h, min(l) AS l, max_by(c, d) AS c, sum(v) AS v FROM bars GROUP BY ALL),
wg AS (
  SELECT *, coalesce((c / min(c) OVER (PARTITION BY code ORDER BY w ROWS BETWEEN 31 PRECEDING AND CURRENT ROW) - 1) * 100, 0) AS wgb,
    coalesce((max(c) OVER (PARTITION BY code ORDER BY w ROWS BETWEEN 31 PRECEDING AND CURRENT ROW) / c - 1) * 100, 0) AS wgs FROM wk)"""

LISTING = """listing AS (
  SELECT s_suppkey AS code, s_name AS name, CASE WHEN n_regionkey % 2 = 0 THEN 'KOSPI' ELSE 'KOSDAQ GLOBAL' END AS market, s_acctbal * 100 AS marcap, s_acctbal + 500 AS close
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


HOURS = f"""hours AS (SELECT event_type AS code, date_trunc('hour', ts) AS d, max_by(value, (ts, event_id)) AS c FROM events GROUP BY ALL),
h0 AS (SELECT *, row_number() OVER ({W}) - 1 AS i, count(*) OVER (PARTITION BY code) AS n FROM hours),
h1 AS (
  SELECT *, coalesce((c / CASE WHEN n >= 120 THEN min(c) OVER {last(100)} ELSE min(c) OVER {last(32)} END - 1) * 100, 0) AS gb,
    coalesce((CASE WHEN n >= 120 THEN max(c) OVER {last(100)} ELSE max(c) OVER {last(32)} END / c - 1) * 100, 0) AS gs FROM h0 WHERE n >= 60),
h2 AS (
  SELECT *, least(29, i - coalesce(max(CASE WHEN gs > 5 THEN i END) OVER ({W} ROWS UNBOUNDED PRECEDING), -1))::INTEGER AS hold,
    list(gs) OVER {last(29)} AS gl, lag(gb, 4) OVER ({W}) AS gb4 FROM h1),
h3 AS (SELECT *, gl[len(gl) - greatest(hold, 1) + 1:] AS seg FROM h2 WHERE i = n - 1),
h4 AS (SELECT *, CASE WHEN len(seg) < 2 THEN 0.0 ELSE list_stddev_pop(seg) END AS std FROM h3)"""

# a log of each trade's purchase, hold and sale
LOGGED = """logged AS (
  SELECT strategy, code, seq * 3 AS seq, entry_date AS d, 'BUY' AS action, entry AS price, 0.0::DOUBLE AS pnl_pct, '' AS reason FROM trades UNION ALL
  SELECT strategy, code, seq * 3 + 1, entry_date + 1, 'HOLD', entry, 0.0::DOUBLE, '' FROM trades UNION ALL
  SELECT strategy, code, seq * 3 + 2, exit_date, 'SELL', exit, pnl, reason FROM trades),
counted AS (SELECT *, sum(buys - sells) OVER (PARTITION BY strategy ORDER BY d)::BIGINT AS positions FROM (
  SELECT strategy, d, count_if(action = 'BUY') AS buys, count_if(action = 'SELL') AS sells, count_if(action = 'HOLD') AS holds, count_if(action <> 'HOLD') AS fills FROM logged GROUP BY ALL))"""

ROW = "{seq: seq, code: code, price: price, reason: reason, severity: '-', pnl_pct: pnl_pct}"


def rows_of(action: str) -> str:
    return f"coalesce(list({ROW} ORDER BY seq) FILTER (action = '{action}'), [])"


# a book of one position for each code: what a day's open, its range and its close do to it, bar after bar
ONE_SLOT = f"""oks AS (
  SELECT s.code, s.d, s.open AS op, s.high AS hi, s.low AS lo, s.close AS cl, s.t, s.b,
    floor(f.c * f.v) >= 3e5 AND f.tb_ok AND f.tb_hold >= 4 AND f.gs <= 1 AS ok FROM snap s JOIN full_ f USING (code, d)),
fr AS (SELECT *, row_number() OVER ({W}) AS j FROM (SELECT *, min(CASE WHEN ok THEN d END) OVER (PARTITION BY code) AS first FROM oks) WHERE d >= first),
fs AS MATERIALIZED (SELECT * FROM fr),
book AS (
  SELECT code, 0::BIGINT AS j, NULL::DATE AS d, 0::BIGINT AS entry, NULL::DATE AS ed, 0 AS days, false AS selling, false AS buying,
    NULL::BIGINT AS s1, NULL::BIGINT AS e1, NULL::DATE AS ed1, 0 AS days1, NULL::BIGINT AS buy, NULL::BIGINT AS s2, NULL::BIGINT AS e2, NULL::DATE AS ed2, 0 AS days2, NULL::BIGINT AS kept
  FROM fs WHERE j = 1
  UNION ALL
  SELECT code, j, d, CASE WHEN s2 IS NULL THEN e2 ELSE 0 END, ed2, CASE WHEN s2 IS NULL AND e2 > 0 THEN days2 + 1 ELSE 0 END,
    s2 IS NULL AND e2 > 0 AND weak, ok AND (s2 IS NOT NULL OR e2 = 0), s1, e1, ed1, days1, buy, s2, e2, ed2, days2, CASE WHEN s2 IS NULL AND e2 > 0 AND NOT weak THEN cl END
  FROM (
    SELECT *, CASE WHEN e2 = 0 THEN NULL WHEN lo <= e2 * (1 + (-10.0)::DOUBLE / 100) THEN trunc(least(e2 * (1 + (-10.0)::DOUBLE / 100), op::DOUBLE))::BIGINT
      WHEN hi >= e2 * (1 + 30.0::DOUBLE / 100) THEN trunc(greatest(e2 * (1 + 30.0::DOUBLE / 100), op::DOUBLE))::BIGINT END AS s2
    FROM (
      SELECT f.code, f.j, f.d, f.op, f.hi, f.lo, f.cl, f.ok, f.t < 20 OR f.b < 60 AS weak,
        CASE WHEN k.selling THEN f.op END AS s1, k.entry AS e1, k.ed AS ed1, k.days AS days1,
        CASE WHEN k.buying AND (k.selling OR k.entry = 0) THEN f.op END AS buy,
        CASE WHEN k.buying AND (k.selling OR k.entry = 0) THEN f.op WHEN k.selling THEN 0 ELSE k.entry END AS e2,
        CASE WHEN k.buying AND (k.selling OR k.entry = 0) THEN f.d WHEN k.selling THEN NULL ELSE k.ed END AS ed2,
        CASE WHEN k.buying AND (k.selling OR k.entry = 0) OR k.selling THEN 0 ELSE k.days END AS days2
      FROM book k JOIN fs f ON f.code = k.code AND f.j = k.j + 1))),
played AS (
  SELECT code, d, 'SELL' AS action, s1 AS price, ed1 AS entry_date, e1 AS entry_price, days1 AS days_held FROM book WHERE s1 IS NOT NULL UNION ALL
  SELECT code, d, 'BUY', buy, d, buy, 0 FROM book WHERE buy IS NOT NULL UNION ALL
  SELECT code, d, 'SELL', s2, ed2, e2, days2 FROM book WHERE s2 IS NOT NULL UNION ALL
  SELECT code, d, 'HOLD', kept, ed2, e2, days2 + 1 FROM book WHERE kept IS NOT NULL)"""


# --- the replay: candidates walked apart, then one walk over the days that tells which get one of ten slots

DAYS = """ev AS MATERIALIZED (
  SELECT f.strategy, s.code, s.d, s.open AS op, s.high AS hi, s.low AS lo, s.close AS cl, s.gsell, s.gb_slope5, s.t, s.b, s.chg1, s.above_ma30, s.ma30, s.red, s.wick, NULL::DOUBLE AS wgs, r.score, r.rank, coalesce(r.grade, '') AS grade
  FROM snap s JOIN (SELECT strategy, code, min(d) AS first FROM ranked GROUP BY ALL) f ON s.code = f.code AND s.d >= f.first LEFT JOIN ranked r ON r.strategy = f.strategy AND r.code = s.code AND r.d = s.d)"""

# the weekly rule's days, with its gate over all companies
WEEK_DAYS = f"""gate AS (SELECT d, avg(CASE WHEN chg20 > 0 THEN 1.0 ELSE 0.0 END) >= 0.55 AS open FROM s1 WHERE chg20 IS NOT NULL GROUP BY d),
entry AS (
  SELECT code, d, rank FROM (
    SELECT s.code, s.d, row_number() OVER (PARTITION BY s.d ORDER BY s.gb DESC, s.code)::INTEGER AS rank FROM s0 s JOIN wg ON s.code = wg.code AND wg.w = date_trunc('week', s.d)::DATE - 7
    WHERE s.gs <= 5 AND wg.wgs <= 5 AND s.gb >= 8 AND wg.wgb >= 8) JOIN gate USING (d) WHERE open),
ev AS MATERIALIZED (
  SELECT '주봉' AS strategy, s.code, s.d, trunc(s.o)::BIGINT AS op, trunc(s.h)::BIGINT AS hi, trunc(s.l)::BIGINT AS lo, trunc(s.c)::BIGINT AS cl, NULL::DOUBLE AS gsell, NULL::DOUBLE AS gb_slope5, NULL::DOUBLE AS t, NULL::DOUBLE AS b,
    NULL::DOUBLE AS chg1, NULL::BOOLEAN AS above_ma30, NULL::BIGINT AS ma30, NULL::BOOLEAN AS red, NULL::DOUBLE AS wick, {rnd('wg.wgs', 1)} AS wgs, CASE WHEN e.rank IS NOT NULL THEN {rnd('s.gb', 1)} END AS score, e.rank, '' AS grade
  FROM s0 s JOIN (SELECT code, min(d) AS first FROM entry GROUP BY code) f ON s.code = f.code AND s.d >= f.first
  LEFT JOIN wg ON s.code = wg.code AND wg.w = date_trunc('week', s.d)::DATE - 7 LEFT JOIN entry e ON e.code = s.code AND e.d = s.d)"""

PLAYED = """cal AS MATERIALIZED (SELECT strategy, d, row_number() OVER (PARTITION BY strategy ORDER BY d) - 1 AS k FROM (SELECT DISTINCT strategy, d FROM ev)),
er AS MATERIALIZED (SELECT ev.*, k, row_number() OVER (PARTITION BY strategy, code ORDER BY d) AS j FROM ev JOIN cal USING (strategy, d)),
walk AS (
  SELECT strategy, code, k AS signal, j, k, 0::BIGINT AS entry, d AS ed, 0::BIGINT AS peak, 0 AS days, '0' AS kind, NULL::BIGINT AS price FROM er WHERE rank <= 20
  UNION ALL
  SELECT strategy, code, signal, j, k, entry, ed, CASE WHEN sold IS NULL THEN top ELSE peak END, CASE WHEN sold IS NULL THEN days + 1 ELSE days END,
    CASE WHEN at_open THEN 'O' WHEN sold IS NOT NULL THEN 'W' WHEN weak THEN 's' ELSE 'h' END, CASE WHEN at_open THEN op ELSE sold END
  FROM (
    SELECT *, CASE WHEN strategy = 'TB' THEN t < 20 OR b < 60 WHEN strategy = '주봉' THEN coalesce(wgs > 25, false)
      ELSE gsell > 8 OR chg1 <= -4 OR NOT above_ma30 OR gsell > 5 OR gb_slope5 <= -3 OR (cl::DOUBLE / top::DOUBLE - 1) * 100 <= -8 OR days + 1 >= 40 END AS weak
    FROM (
      SELECT *, greatest(peak, cl) AS top, CASE WHEN at_open THEN op WHEN lo <= entry * (1 + stop / 100) THEN trunc(least(entry * (1 + stop / 100), op::DOUBLE))::BIGINT
        WHEN strategy <> '주봉' AND hi >= entry * (1 + 30.0::DOUBLE / 100) THEN trunc(greatest(entry * (1 + 30.0::DOUBLE / 100), op::DOUBLE))::BIGINT END AS sold
      FROM (
        SELECT r.*, w.signal, CASE WHEN w.kind = '0' THEN r.op ELSE w.entry END AS entry, CASE WHEN w.kind = '0' THEN r.d ELSE w.ed END AS ed, CASE WHEN w.kind = '0' THEN r.op ELSE w.peak END AS peak, w.days,
          w.kind = 's' AND r.k = w.k + 1 AS at_open, CASE r.strategy WHEN 'TB' THEN -10.0::DOUBLE WHEN '주봉' THEN -12.0::DOUBLE ELSE -7.0::DOUBLE END AS stop
        FROM walk w JOIN er r ON r.strategy = w.strategy AND r.code = w.code AND r.j = w.j + 1 WHERE w.kind IN ('h', 's') OR w.kind = '0' AND r.k = w.k + 1)))),
steps AS MATERIALIZED (SELECT *, lag(k) OVER (PARTITION BY strategy, code, signal ORDER BY k) AS before FROM walk),
tr AS MATERIALIZED (
  SELECT strategy, signal AS k, list({code: code, signal: signal, fill: fill, kinds: kinds, leaves: leaves, at_open: at_open} ORDER BY rank) AS cands FROM (
    SELECT s.strategy, s.code, s.signal, min(s.k) FILTER (s.kind <> '0') AS fill, coalesce(string_agg(repeat('-', (s.k - s.before - 1)::INTEGER) || s.kind, '' ORDER BY s.k) FILTER (s.kind IN ('h', 's')), '') AS kinds,
      min(s.k) FILTER (s.kind IN ('O', 'W')) AS leaves, coalesce(bool_or(s.kind = 'O'), false) AS at_open, min(r.rank) AS rank
    FROM steps s JOIN er r ON r.strategy = s.strategy AND r.code = s.code AND r.k = s.signal GROUP BY s.strategy, s.code, s.signal) GROUP BY ALL),
dl AS MATERIALIZED (SELECT cal.strategy, cal.k, coalesce(tr.cands, []) AS cands FROM cal LEFT JOIN tr USING (strategy, k)),
slots AS (
  SELECT strategy, -1::BIGINT AS k, 0::BIGINT AS base, 0::BIGINT AS seq, cands[:0] AS held, cands[:0] AS buying, cands[:0] AS so, cands[:0] AS bu, cands[:0] AS wi, cands[:0] AS ho FROM dl WHERE k = 0
  UNION ALL
  SELECT strategy, k, seq, seq + len(so) + len(bu) + len(wi) + len(ho), h3, list_filter(cands, lambda x: NOT list_contains(c3, x.code))[:10 - len(h3) + len(se)], so, bu, wi, ho
  FROM (
    SELECT *, list_transform(h3, lambda x: x.code) AS c3, list_filter(h3, lambda x: substr(x.kinds, (k - x.fill + 1)::INTEGER, 1) = 'h') AS ho, list_filter(h3, lambda x: substr(x.kinds, (k - x.fill + 1)::INTEGER, 1) = 's') AS se
    FROM (
      SELECT *, list_filter(h2, lambda x: coalesce(x.leaves = k, false) AND NOT x.at_open) AS wi, list_filter(h2, lambda x: NOT (coalesce(x.leaves = k, false) AND NOT x.at_open)) AS h3
      FROM (
        SELECT *, list_concat(h1, bu) AS h2
        FROM (
          SELECT *, list_filter(buying, lambda x: coalesce(x.fill = k, false) AND NOT list_contains(c1, x.code))[:10 - len(h1)] AS bu
          FROM (
            SELECT *, list_transform(h1, lambda x: x.code) AS c1
            FROM (
              SELECT s.strategy, d.k, d.cands, s.seq, s.buying, list_filter(s.held, lambda x: coalesce(x.leaves = d.k, false) AND x.at_open) AS so, list_filter(s.held, lambda x: NOT (coalesce(x.leaves = d.k, false) AND x.at_open)) AS h1
              FROM slots s JOIN dl d ON d.strategy = s.strategy AND d.k = s.k + 1))))))),
done AS (
  SELECT strategy, k, base + i - 1 AS seq, 'O' AS kind, so[i] AS x FROM slots, unnest(range(1, len(so) + 1)) AS u(i) UNION ALL
  SELECT strategy, k, base + len(so) + i - 1, 'B', bu[i] FROM slots, unnest(range(1, len(bu) + 1)) AS u(i) UNION ALL
  SELECT strategy, k, base + len(so) + len(bu) + i - 1, 'W', wi[i] FROM slots, unnest(range(1, len(wi) + 1)) AS u(i) UNION ALL
  SELECT strategy, k, base + len(so) + len(bu) + len(wi) + i - 1, 'h', ho[i] FROM slots, unnest(range(1, len(ho) + 1)) AS u(i)),
said AS (
  SELECT s.*, r.d, r.op, r.cl,
    CASE WHEN s.strategy = 'TB' THEN CASE WHEN s.kind = 's' THEN concat_ws(' · ', CASE WHEN t < 20 THEN 'T ' || printf('%.1f', t) || ' < 20' END, CASE WHEN b < 60 THEN 'B ' || printf('%.1f', b) || ' < 60' END) || ' 이탈'
      ELSE concat_ws(' · ', CASE WHEN t < 25 THEN 'T ' || printf('%.1f', t) || ' 기준선 근접' END, CASE WHEN b < 63 THEN 'B ' || printf('%.1f', b) || ' 기준선 근접' END, CASE WHEN gsell > 1 THEN '청선 ' || printf('%.1f', gsell) END) END
    WHEN s.strategy = '주봉' THEN CASE WHEN s.kind = 's' THEN '주봉 청선 ' || printf('%.1f', wgs) || ' > 25' ELSE '' END
    WHEN s.kind = 's' THEN CASE WHEN gsell > 8 THEN '청선 ' || printf('%.1f', gsell) || ' — 8.0선 초과 급이탈' WHEN chg1 <= -4 THEN '장대음봉 ' || printf('%+.1f', chg1) || '%'
      WHEN NOT above_ma30 THEN '30일선 이탈 (종가 ' || format('{:,}', r.cl) || ' < ' || format('{:,}', ma30) || ')' WHEN gsell > 5 THEN '청선 ' || printf('%.1f', gsell) || ' — 5선 이탈'
      WHEN gb_slope5 <= -3 THEN '적선 5일 기울기 ' || printf('%+.1f', gb_slope5) || ' — 상승탄력 꺾임' WHEN (r.cl::DOUBLE / s.peak::DOUBLE - 1) * 100 <= -8 THEN '고점 대비 ' || printf('%+.1f', (r.cl::DOUBLE / s.peak::DOUBLE - 1) * 100) || '% 되밀림'
      ELSE '보유 ' || s.days || '일 경과 — 기간 청산' END
    ELSE concat_ws(' · ', CASE WHEN wick > 0.5 THEN '위꼬리 ' || wick::VARCHAR END, CASE WHEN gsell > 3.5 THEN '청선 ' || printf('%.1f', gsell) || ' 상승' END, CASE WHEN NOT red THEN '그물망 상승배열 아님' END) END AS said,
    gsell > 8 OR chg1 <= -4 OR NOT above_ma30 OR gsell > 5 OR gb_slope5 <= -3 OR (r.cl::DOUBLE / s.peak::DOUBLE - 1) * 100 <= -8 AS broke
  FROM steps s JOIN er r ON r.strategy = s.strategy AND r.code = s.code AND r.k = s.k WHERE s.kind <> '0'),
told AS (
  SELECT d.strategy, d.seq, w.d, w.code, d.kind, w.said, w.price, w.entry, w.ed, w.op, w.cl, w.days, w.broke, c.d AS sd, c.score, c.rank, c.grade, o.d AS od, o.said AS osaid, o.broke AS obroke
  FROM done d JOIN said w ON w.strategy = d.strategy AND w.code = d.x.code AND w.signal = d.x.signal AND w.k = d.k
  JOIN er c ON c.strategy = d.strategy AND c.code = w.code AND c.k = d.x.signal
  LEFT JOIN said o ON d.kind = 'O' AND o.strategy = d.strategy AND o.code = w.code AND o.signal = w.signal AND o.k = w.k - 1),
logged_ AS (
  SELECT strategy, seq, d, code, CASE kind WHEN 'B' THEN 'BUY' WHEN 'h' THEN 'HOLD' ELSE 'SELL' END AS action,
    CASE kind WHEN 'B' THEN CASE WHEN grade = '' THEN '진입' ELSE grade END WHEN 'h' THEN CASE WHEN said = '' THEN '정상' ELSE '주의' END
      WHEN 'O' THEN CASE WHEN strategy = 'TB' THEN '이탈' WHEN strategy = '주봉' OR obroke THEN '청산' ELSE '기간' END ELSE CASE WHEN pnl < 0 THEN '손절' ELSE '익절' END END AS severity,
    CASE kind WHEN 'B' THEN sd || ' 종가신호 ' || printf('%.1f', score) || '점 ' || rank || '위 → 시가 체결' WHEN 'h' THEN CASE WHEN said <> '' THEN said WHEN strategy = 'TB' THEN 'T·B 유지' WHEN strategy = '주봉' THEN '주봉 유지' ELSE '조건 유지' END
      WHEN 'O' THEN osaid || ' → ' || od || ' 종가신호, 시가 체결'
      ELSE CASE WHEN pnl < 0 THEN '장중 손절 (기준 ' || CASE strategy WHEN 'TB' THEN '-10.0' WHEN '주봉' THEN '-12.0' ELSE '-7.0' END || '%) ' ELSE '장중 익절 (목표 +30%) ' END || printf('%+.1f', pnl) || '%' END AS reason,
    paid AS price, CASE WHEN kind = 'B' THEN score END AS score, CASE WHEN kind = 'B' THEN rank END AS rank, grade, ed AS entry_date, entry AS entry_price, CASE WHEN kind = 'B' THEN 0 ELSE days END AS days_held, pnl AS pnl_pct
  FROM (SELECT *, CASE WHEN kind = 'B' THEN 0.0 ELSE round_even((paid::DOUBLE / entry::DOUBLE - 1) * 100, 2) END AS pnl FROM (SELECT *, CASE kind WHEN 'B' THEN op WHEN 'h' THEN cl ELSE price END AS paid FROM told)))"""


def over(select: str, *parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + select


BASE = (BARS,)
FULL = (BARS, EMAS, SERIES)
STATS = f"""count(*) AS trades, {rnd("avg(pnl)", 2)} AS avg, {rnd("count_if(pnl > 0) * 100.0 / count(*)", 1)} AS winrate, {rnd("max(pnl)", 1)} AS best, {rnd("min(pnl)", 1)} AS worst,
  {rnd("(product(1 + pnl / 100 / 10) - 1) * 100", 2)} AS cum, {rnd("avg(days)", 1)} AS avg_days, min_by(exit_date, seq) AS first, max_by(exit_date, seq) AS last,
  count_if(grade = '홈런') AS hr_n, {rnd("avg(pnl) FILTER (grade = '홈런')", 2)} AS hr_avg, {rnd("count_if(grade = '홈런' AND pnl > 0) * 100.0 / nullif(count_if(grade = '홈런'), 0)", 1)} AS hr_win, {rnd("max(pnl) FILTER (grade = '홈런')", 1)} AS hr_best"""
KEY = "CASE " + " ".join(f"WHEN contains(reason, '{k}') THEN '{k}'" for k in ("손절", "익절", "청선", "장대음봉", "30일선", "적선", "고점", "기간", "이탈")) + " ELSE '기타' END"


def r6(*cols: str) -> str:
    return ", ".join(f"{rnd(c, 6)} AS {c}" for c in cols)


SQL = {
    "daily_bars": over("SELECT code, d, o, h, l, c, v FROM bars", *BASE),
    "hourly_bars": "SELECT event_type AS code, date_trunc('hour', ts) AS hour, min_by(value, (ts, event_id)) AS o, max(value) AS h, min(value) AS l, max_by(value, (ts, event_id)) AS c, count(*) AS v FROM events GROUP BY ALL",
    "cum_to_delta_volume": """WITH e AS (SELECT event_type AS code, CAST(ts AS DATE) AS d, ts, event_id, sum(event_id % 7) OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT - CASE WHEN event_id % 11 = 0 THEN 9 ELSE 0 END AS total FROM events)
SELECT code, d, event_id, total, greatest(total - coalesce(lag(total) OVER (PARTITION BY code, d ORDER BY ts, event_id), 0), 0) AS step FROM e""",
    "weekly_bars": over("SELECT * FROM wk", BARS, WEEKS),
    "universe_topn": over("""SELECT code, name, m AS market, trunc(marcap)::BIGINT AS marcap, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY m ORDER BY marcap DESC, code) AS rank FROM (
  SELECT *, CASE WHEN starts_with(market, 'KOSPI') THEN 'KOSPI' WHEN starts_with(market, 'KOSDAQ') THEN 'KOSDAQ' END AS m FROM listing WHERE marcap > 0 AND close >= 1000 AND code::VARCHAR LIKE '%0' AND NOT regexp_matches(name, '스팩|리츠|우$|우B$|우C$'))) WHERE rank <= CASE m WHEN 'KOSPI' THEN 200 ELSE 150 END""", LISTING),
    "common_share_filter": "SELECT p_partkey, nm, ok FROM (SELECT p_partkey, nm, NOT regexp_matches(nm, '스팩|리츠|우$|우B$|우C$') AND p_partkey::VARCHAR LIKE '%0' AS ok FROM (SELECT p_partkey, p_name || ['', '스팩1호', '리츠', '우', '우B', '우C', '우D'][(p_partkey // 10 % 7)::INTEGER + 1] AS nm FROM part))",
    "min_history": over("SELECT code, d, n FROM (SELECT code, d, count(*) OVER (PARTITION BY code) AS n FROM bars) WHERE n >= 520", *BASE),
    "sma": over(f"SELECT code, d, {', '.join(f'{rnd(sma(chr(99), n), 6)} AS sma{n}' for n in (5, 20, 30))} FROM x1", *BASE),
    "mesh": over(f"SELECT code, d, {r6('ma10', 'ma35')}, {rnd('CASE WHEN ma35 IS NOT NULL THEN greatest(ma10, ma15, ma20, ma25, ma30, ma35) END', 6)} AS top, {rnd('CASE WHEN ma35 IS NOT NULL THEN least(ma10, ma15, ma20, ma25, ma30, ma35) END', 6)} AS bottom, red FROM s1", *FULL),
    "golden_ratio": over(f"SELECT code, d, {r6('gb', 'gs')} FROM s0", *FULL),
    "golden_symmetric": over(f"SELECT code, d, {rnd('(c / lo - lo / c) * 100', 6)} AS gb, {rnd('(hi / c - c / hi) * 100', 6)} AS gs FROM (SELECT *, min(c) OVER {last(25)} AS lo, max(c) OVER {last(25)} AS hi FROM bars)", *BASE),
    "ultimate": over(f"SELECT code, d, {r6('u')}, {rnd(f'CASE WHEN count(u) OVER {last(8)} = 8 THEN avg(u) OVER {last(8)} END', 6)} AS u_sig FROM s1", *FULL),
    "returns": over(f"SELECT code, d, {r6('chg1', 'chg5', 'chg20')} FROM s1", *FULL),
    "slope5": over(f"SELECT code, d, {r6('slope5')} FROM s1", *FULL),
    "ema": over(f"SELECT code, d, {r6('ema')} FROM s0", *FULL),
    "spread_averages": over(f"SELECT code, d, {r6('ema', 't', 't_sig', 'b')} FROM s0", *FULL),
    "tsi": over(f"SELECT code, d, {r6('t', 't_sig')} FROM s0", *FULL),
    "rsi_b": over(f"SELECT code, d, {r6('b')} FROM s0", *FULL),
    "wick": over(f"SELECT code, d, {r6('wick')} FROM s1", *FULL),
    "bad_wick": over("SELECT code, d, bad_wick FROM s2", *FULL),
    "big_down": over("SELECT code, d, big_down FROM s2", *FULL),
    "gs_streak": over("SELECT code, d, gs_hold FROM s2", *FULL),
    "tb_streak": over("SELECT code, d, tb_ok, tb_hold FROM s2", *FULL),
    "segment_stats": over(f"SELECT code, d, {r6('gs_mean', 'gs_std')} FROM s4", *FULL),
    "spike": over("SELECT code, d, spike FROM s4", *FULL),
    "month_boundary": over(f"SELECT code, d, coalesce(date_trunc('month', d) <> lag(date_trunc('month', d)) OVER ({W}), false) AS new_month FROM bars", *BASE),
    "sign_runs": over(f"SELECT code, run, count(*) AS bars, min(d) AS first, max(d) AS last FROM (SELECT code, d, sum(n) OVER ({W} ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM (SELECT code, d, CASE WHEN coalesce(lag(sign(t)) OVER ({W}), 9) <> sign(t) THEN 1 ELSE 0 END AS n FROM s0 WHERE t IS NOT NULL)) GROUP BY ALL", *FULL),
    "extents": over(f"SELECT code, {rnd('CASE WHEN a = z THEN a - 1 ELSE a END', 6)} AS low, {rnd('CASE WHEN a = z THEN z + 1 ELSE z END', 6)} AS high FROM (SELECT code, min(u) AS a, max(u) AS z FROM s1 GROUP BY code)", *FULL),
    "snapshot": over("SELECT * FROM snap", *FULL, SNAP),
    "legacy_candidates": over("SELECT code, d, score, gs_hold FROM lc", *FULL, CANDS),
    "tb_candidates": over(f"SELECT code, d, score, tb_hold, grade, timely, {rnd('coalesce(chg20, 0)', 1)} AS r20 FROM tc", *FULL, CANDS),
    "legacy_score": over(f"SELECT code, d, {LEGACY_SCORE} AS score FROM full_", *FULL),
    "tb_score": over(f"SELECT code, d, {TB_SCORE} AS score FROM full_", *FULL),
    "tb_grade": over("SELECT code, d, CASE WHEN gs <= 5 THEN '홈런' ELSE '일반' END AS grade FROM full_ WHERE tb_ok", *FULL),
    "evaluate_lenient": over(f"SELECT code, d, {LEGACY_SCORE} AS score, CASE WHEN gs_hold < 3 THEN 'hold' WHEN gs_std > 2 THEN 'std' WHEN gb < 10 THEN 'rise' WHEN slope5 < 1 THEN 'slope' WHEN bad_wick THEN 'wick' WHEN big_down THEN 'down' WHEN c < ma30 THEN 'ma30' END AS reject FROM s4 WHERE i >= 119 AND t IS NOT NULL AND b IS NOT NULL AND u IS NOT NULL AND ma30 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY code ORDER BY d DESC) = 1", *FULL),
    "day_rank_universe": over("""SELECT strategy, d, code, score, row_number() OVER (PARTITION BY strategy, d ORDER BY score DESC, m IS NULL, m, coalesce(r, code))::INTEGER AS rank FROM cands LEFT JOIN members USING (code)""", *FULL, CANDS, LISTING, """members AS (
  SELECT code, m, row_number() OVER (PARTITION BY m ORDER BY marcap DESC, code) AS r FROM (SELECT *, CASE WHEN starts_with(market, 'KOSPI') THEN 0 WHEN starts_with(market, 'KOSDAQ') THEN 1 END AS m FROM listing WHERE marcap > 0 AND close >= 0 AND code::VARCHAR LIKE '%0' AND NOT regexp_matches(name, '스팩|리츠|우$|우B$|우C$'))
  QUALIFY r <= CASE m WHEN 0 THEN 200 ELSE 150 END)"""),
    "day_rank": over("SELECT strategy, d, code, score, rank FROM ranked", *FULL, CANDS),
    "topk_per_day": over("SELECT strategy, d, code, rank FROM ranked WHERE rank <= 3", *FULL, CANDS),
    "legacy_exit_flags": over("""SELECT code, d, rule, CASE WHEN rule IS NULL THEN 'HOLD' ELSE 'SELL' END AS action,
  CASE WHEN rule = 'days' THEN '기간' WHEN rule IS NOT NULL THEN '청산' WHEN wick > 0.5 OR gsell > 3.5 OR NOT red THEN '주의' ELSE '정상' END AS severity
FROM (SELECT *, CASE WHEN gsell > 8 THEN 'gs_hard' WHEN chg1 <= -4 THEN 'big_down' WHEN NOT above_ma30 THEN 'ma30' WHEN gsell > 5 THEN 'gs_exit' WHEN gb_slope5 <= -3 THEN 'gb_drop'
  WHEN (close::DOUBLE / greatest(peak, close)::DOUBLE - 1) * 100 <= -8 THEN 'trail' WHEN days >= 40 THEN 'days' END AS rule FROM held)""", *FULL, SNAP, POS),
    "tb_exit_flags": over("""SELECT code, d, action, CASE WHEN action = 'SELL' THEN broke || ' 이탈' WHEN warn = '' THEN 'T·B 유지' ELSE warn END AS reason, CASE WHEN action = 'SELL' THEN '이탈' WHEN warn = '' THEN '정상' ELSE '주의' END AS severity
FROM (SELECT code, d, CASE WHEN t < 20 OR b < 60 THEN 'SELL' ELSE 'HOLD' END AS action,
  concat_ws(' · ', CASE WHEN t < 20 THEN 'T ' || printf('%.1f', t) || ' < 20' END, CASE WHEN b < 60 THEN 'B ' || printf('%.1f', b) || ' < 60' END) AS broke,
  concat_ws(' · ', CASE WHEN t < 25 THEN 'T ' || printf('%.1f', t) || ' 기준선 근접' END, CASE WHEN b < 63 THEN 'B ' || printf('%.1f', b) || ' 기준선 근접' END, CASE WHEN gsell > 1 THEN '청선 ' || printf('%.1f', gsell) END) AS warn FROM held)""", *FULL, SNAP, POS),
    "stop_take_fill": over("""SELECT code, d, CASE WHEN low <= st THEN '손절' WHEN high >= tp THEN '익절' END AS kind, CASE WHEN low <= st THEN trunc(least(st, open::DOUBLE))::BIGINT WHEN high >= tp THEN trunc(greatest(tp, open::DOUBLE))::BIGINT END AS fill
FROM (SELECT *, entry * (1 + (-7.0)::DOUBLE / 100) AS st, entry * (1 + 10.0::DOUBLE / 100) AS tp FROM held)""", *FULL, SNAP, POS),
    "candidate_meta_join": over("SELECT r.strategy, r.d, r.code, r.rank, coalesce(m.name, r.code::VARCHAR) AS name, coalesce(m.market, '') AS market FROM ranked r LEFT JOIN (SELECT * FROM listing WHERE code % 3 <> 0) m USING (code)", *FULL, CANDS, LISTING),
    "held_anti_join": over("SELECT strategy, d, code, row_number() OVER (PARTITION BY strategy, d ORDER BY rank)::INTEGER AS \"order\" FROM ranked WHERE (code + CAST(strftime(d, '%d') AS INTEGER)) % 4 <> 0 QUALIFY \"order\" <= 5", *FULL, CANDS),
    "ordered_flag": over("SELECT r.strategy, r.d, r.code, EXISTS (SELECT 1 FROM lc WHERE lc.code = r.code AND lc.d = r.d) AS ordered FROM ranked r", *FULL, CANDS),
    "indicator_override": over(f"""SELECT s.code, s.d, {rnd("CASE WHEN e.code IS NOT NULL THEN e.xt ELSE s.t END", 6)} AS t, {rnd("CASE WHEN e.code IS NOT NULL THEN e.xb ELSE s.b END", 6)} AS b FROM s0 s LEFT JOIN (
  SELECT code, i, CASE WHEN i % 5 <> 0 THEN c % 90 END AS xt, h % 70 AS xb FROM x1 WHERE code % 3 = 0) e ON s.code = e.code AND s.i = e.i""", *FULL),
    "latest_trading_days": over("SELECT DISTINCT d FROM bars WHERE code = (SELECT code FROM bars GROUP BY code ORDER BY count(*) DESC, code LIMIT 1) AND d <= DATE '1998-06-30' ORDER BY d DESC LIMIT 20", *BASE),
    "date_difference": over("SELECT DISTINCT d FROM bars WHERE d NOT IN (SELECT d FROM bars WHERE code <= 2)", *BASE),
    "ordered_union": over("""SELECT code, row_number() OVER (ORDER BY part, pos, code)::INTEGER AS place FROM (
  SELECT code, part, pos, row_number() OVER (PARTITION BY code ORDER BY part, pos) AS k FROM (
    SELECT code, CASE strategy WHEN 'TB' THEN 0 ELSE 1 END AS part, min(rank) AS pos FROM ranked GROUP BY ALL)) WHERE k = 1""", *FULL, CANDS),
    "keyed_upsert": "SELECT code, hour, px FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY hour DESC) AS k FROM (SELECT event_type AS code, date_trunc('hour', ts) AS hour, CASE WHEN count_if(event_id % 2 = 1) > 0 THEN max(value) FILTER (event_id % 2 = 1) ELSE max(value) END AS px FROM events GROUP BY ALL)) WHERE k <= 240",
    "fifo_closed": over(f"SELECT *, (sell_price - buy_price) * qty AS pnl, {rnd('(sell_price / buy_price - 1) * 100', 4)} AS pct, datediff('day', buy_d, sell_d)::INTEGER AS days FROM fc", BARS, FILLS),
    "fifo_open": over("SELECT * FROM fo", BARS, FILLS),
    "ledger_kpis": over(f"""SELECT a.*, {rnd('wins * 100.0 / closed', 0)} AS win_pct, (SELECT sum(qty * price) FROM fo) AS invested, b.* FROM (SELECT sum((sell_price - buy_price) * qty) AS realised, count_if(sell_price > buy_price) AS wins, count(*) AS closed FROM fc) a,
  (SELECT count_if(side = 'buy') AS buys, count_if(side <> 'buy') AS sells, min(d) AS first, max(d) AS last FROM fills) b""", BARS, FILLS),
    "closed_trades": over("SELECT strategy, grade, code, entry_date, exit_date, entry, exit, pnl, days, reason, seq FROM trades", *FULL, CANDS, TRADES),
    "trade_stats": over(f"SELECT {STATS} FROM trades", *FULL, CANDS, TRADES),
    "stats_by_strategy": over(f"SELECT CASE WHEN grouping(strategy) = 1 THEN 'ALL' ELSE strategy END AS strategy, {STATS} FROM trades GROUP BY GROUPING SETS ((strategy), ())", *FULL, CANDS, TRADES),
    "by_reason": over(f"SELECT key, n, avg, win, row_number() OVER (ORDER BY n DESC, f)::INTEGER AS rank FROM (SELECT {KEY} AS key, count(*) AS n, {rnd('avg(pnl)', 2)} AS avg, {rnd('count_if(pnl > 0) * 100.0 / count(*)', 0)} AS win, min(seq) AS f FROM trades GROUP BY 1)", *FULL, CANDS, TRADES),
    "equity_curve": over(f"SELECT strategy, seq, {rnd('(product(1 + pnl / 100 / 10) OVER (PARTITION BY strategy ORDER BY exit_date, code, seq ROWS UNBOUNDED PRECEDING) - 1) * 100', 2)} AS cum FROM trades", *FULL, CANDS, TRADES),
    "breadth_gate": over(f"""SELECT d, {rnd('avg(CASE WHEN chg20 > 0 THEN 1.0 ELSE 0.0 END)', 4)} AS breadth, avg(CASE WHEN chg20 > 0 THEN 1.0 ELSE 0.0 END) >= 0.55 AS open FROM s1 WHERE chg20 IS NOT NULL AND code IN (
  SELECT code FROM (SELECT *, row_number() OVER (PARTITION BY m ORDER BY marcap DESC, code) AS rank FROM (SELECT *, CASE WHEN starts_with(market, 'KOSPI') THEN 'KOSPI' WHEN starts_with(market, 'KOSDAQ') THEN 'KOSDAQ' END AS m FROM listing
    WHERE marcap > 0 AND code::VARCHAR LIKE '%0' AND NOT regexp_matches(name, '스팩|리츠|우$|우B$|우C$'))) WHERE rank <= CASE m WHEN 'KOSPI' THEN 200 ELSE 150 END ORDER BY trunc(marcap)::BIGINT DESC, code LIMIT 200) GROUP BY d""", *FULL, LISTING),
    "weekly_signals": over(f"SELECT code, d, {rnd('gb', 6)} AS gb, row_number() OVER (PARTITION BY d ORDER BY gb DESC, code)::INTEGER AS rank FROM (SELECT s.code, s.d, s.gb FROM s0 s JOIN wg ON s.code = wg.code AND wg.w = date_trunc('week', s.d)::DATE - 7 WHERE s.gs <= 5 AND wg.wgs <= 5 AND s.gb >= 8 AND wg.wgb >= 8)", *FULL, WEEKS),
    "evaluate_strict": over(f"SELECT code, d, score FROM (SELECT code, d, {LEGACY_SCORE} AS score, {REJECT} AS no FROM s4 WHERE i >= 119 AND t IS NOT NULL AND b IS NOT NULL AND u IS NOT NULL AND ma30 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY code ORDER BY d DESC) = 1) WHERE NOT no", *FULL),
    "timing_60m": over(f"SELECT code, d, n, {r6('gb', 'gs')}, hold, {r6('std')}, hold >= 4 AND std <= 2 AND gb >= 10 AND gb > gb4 AS ready FROM h4", HOURS),
    "chart_documents": over("""SELECT code, count(*)::INTEGER AS n, string_agg(strftime(d, '%Y-%m-%d'), ',' ORDER BY d) AS t, """ + ", ".join(f"string_agg(trunc({x})::BIGINT::VARCHAR, ',' ORDER BY d) AS {x}" for x in "ohlcv") + """
FROM (SELECT *, count(*) OVER (PARTITION BY code) AS n, row_number() OVER (PARTITION BY code ORDER BY d DESC) AS r FROM bars) WHERE n >= 30 AND r <= 160 GROUP BY code""", *BASE),
    "chart_codes": over("""SELECT code, row_number() OVER (ORDER BY part, pos, code)::INTEGER AS place FROM (
  SELECT code, part, pos, row_number() OVER (PARTITION BY code ORDER BY part, pos) AS k FROM (
    SELECT code, CASE strategy WHEN 'TB' THEN 0 ELSE 1 END AS part, min(rank) AS pos FROM ranked GROUP BY ALL)) WHERE k = 1 QUALIFY place <= 20""", *FULL, CANDS),
    "date_tail": over("SELECT d FROM (SELECT d FROM bars WHERE code % 2 = 0 UNION SELECT d FROM bars WHERE code % 2 = 1) ORDER BY d DESC LIMIT 260", *BASE),
    "candidate_lists": over("""SELECT strategy, d, count(*) AS total, count_if(grade = '홈런') AS homeruns, string_agg(CASE WHEN rank <= most THEN code::VARCHAR END, ',' ORDER BY rank) AS codes
FROM ranked JOIN (SELECT d, CASE WHEN row_number() OVER (ORDER BY d DESC) = 1 THEN 5 ELSE 2 END AS most FROM (SELECT DISTINCT d FROM ranked) QUALIFY row_number() OVER (ORDER BY d DESC) <= 40) USING (d) GROUP BY strategy, d""", *FULL, CANDS),
    "observed_reports": over(f"""SELECT a.code, a.d, {', '.join(f"{rnd('a.' + x, 6)} AS {x}" for x in ('c', 'chg1', 'chg20', 'chg60', 'gb', 'gs', 'slope3', 'slope5', 't', 'b', 'u', 'u_sig'))}, a.red,
  {rnd('a.c / a.top * 100 - 100', 6)} AS from_mesh, {rnd('a.top / a.bottom * 100 - 100', 6)} AS mesh_width, {rnd('a.c / a.ma30 * 100 - 100', 6)} AS from_ma30, {rnd('a.c / a.ma200 * 100 - 100', 6)} AS from_ma200,
  a.c > a.ma200 AS above_ma200, a.gs_hold, {rnd('a.gs_mean', 6)} AS gs_mean, {rnd('a.gs_std', 6)} AS gs_std, {rnd('list_max(a.seg)', 6)} AS gs_max, {rnd('k.wgb', 6)} AS week_gb, {rnd('k.wgs', 6)} AS week_gs, k.hold AS week_hold
FROM (SELECT *, c / lag(c, 60) OVER ({W}) * 100 - 100 AS chg60, CASE WHEN i >= 199 THEN avg(c) OVER {last(200)} END AS ma200, gb - lag(gb, 3) OVER ({W}) AS slope3, CASE WHEN count(u) OVER {last(8)} = 8 THEN avg(u) OVER {last(8)} END AS u_sig,
    CASE WHEN ma35 IS NOT NULL THEN greatest(ma10, ma15, ma20, ma25, ma30, ma35) END AS top, CASE WHEN ma35 IS NOT NULL THEN least(ma10, ma15, ma20, ma25, ma30, ma35) END AS bottom
  FROM s4 QUALIFY row_number() OVER (PARTITION BY code ORDER BY d DESC) = 1) a
LEFT JOIN (SELECT *, least(15, i - coalesce(max(CASE WHEN wgs > 5 THEN i END) OVER (PARTITION BY code ORDER BY w ROWS UNBOUNDED PRECEDING), -1))::INTEGER AS hold FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY w) - 1 AS i FROM wg)) k
  ON a.code = k.code AND k.w = date_trunc('week', a.d)::DATE - 7""", *FULL, WEEKS),
    "day_counters": over("SELECT * FROM counted", *FULL, CANDS, TRADES, LOGGED),
    "day_report": over(f"""SELECT d, to_json({{date: d::VARCHAR, strategies: list({{strategy: strategy, counts: counts, buys: buys, sells: sells, holds: holds, order_buy: []::VARCHAR[], order_sell: []::VARCHAR[]}} ORDER BY strategy)}})::VARCHAR AS doc FROM (
  SELECT l.strategy, l.d, any_value({{buys: c.buys, sells: c.sells, holds: c.holds, fills: c.fills, positions: c.positions}}) AS counts, {rows_of('BUY')} AS buys, {rows_of('SELL')} AS sells, {rows_of('HOLD')} AS holds
  FROM logged l JOIN counted c USING (strategy, d) GROUP BY ALL) GROUP BY d""", *FULL, CANDS, TRADES, LOGGED),
    **{k: over(f"SELECT * FROM logged_{where}", *FULL, SNAP, CANDS, DAYS, PLAYED) for k, where in (("trade_log", ""), ("replay_tb", " WHERE strategy = 'TB'"), ("replay_legacy", " WHERE strategy = '기존'"))},
    "replay_weekly": over("SELECT * FROM logged_", *FULL, WEEKS, WEEK_DAYS, PLAYED),
    "replay_one_slot": over(f"SELECT *, {rnd('(price / entry_price - 1) * 100', 4)} AS pnl FROM played", *FULL, SNAP, ONE_SLOT),
    "universe_counts": over("SELECT CASE WHEN starts_with(market, 'KOSPI') THEN 'KOSPI' ELSE 'KOSDAQ' END AS market, count(*) AS n FROM listing GROUP BY 1", LISTING),
    "vendor_scan": over("SELECT * FROM (SELECT * FROM bars WHERE d >= '1996-12-01') QUALIFY count(*) OVER (PARTITION BY code) >= 130", *BASE),
    "long_extremes": over(f"""SELECT code, d, {rnd('(c / hi - 1) * 100', 6)} AS from_high, {rnd('(c / lo - 1) * 100', 6)} AS from_low, i - bi AS bars_since_low FROM (
  SELECT a.code, a.d, a.c, a.hi, a.lo, a.i, max(b.i) AS bi
  FROM (SELECT *, max(c) OVER {last(250)} AS hi, min(c) OVER {last(250)} AS lo FROM x0) a JOIN x0 b ON b.code = a.code AND b.i > a.i - 250 AND b.i <= a.i AND b.c = a.lo GROUP BY ALL)""", *BASE),
    "month_labels": over(f"""SELECT code, d, {rnd('x', 6)} AS x FROM walked""", *BASE, """marks AS MATERIALIZED (SELECT code, d, 56.0::DOUBLE + (i + 1 - 0.5::DOUBLE) * 900.0::DOUBLE / n AS x FROM (
  SELECT *, count(*) OVER (PARTITION BY code) AS n, coalesce(date_trunc('month', d) <> lag(date_trunc('month', d)) OVER (PARTITION BY code ORDER BY d), false) AS new_month FROM x0) WHERE new_month AND x < 56 + 900 - 18),
walked AS (SELECT code, min(d) AS d, min(x) AS x FROM marks GROUP BY code UNION ALL
  SELECT code, d, x FROM (SELECT m.code, m.d, m.x, row_number() OVER (PARTITION BY m.code ORDER BY m.x) AS k FROM walked w JOIN marks m ON m.code = w.code AND m.x >= w.x + 44) WHERE k = 1)"""),
    "hourly_runs": """WITH r AS (SELECT DISTINCT * FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL AND arrived_at IS NOT NULL AND click_id IS NOT NULL AND value IS NOT NULL),
t AS (SELECT client_id AS code, date_trunc('hour', ts) AS hour, value, row_number() OVER (PARTITION BY client_id ORDER BY arrived_at, click_id) AS k FROM r),
u AS (SELECT *, coalesce(lag(hour) OVER (PARTITION BY code ORDER BY k) <> hour, true) AS new FROM t),
v AS (SELECT *, sum(new::INT) OVER (PARTITION BY code ORDER BY k) AS run FROM u),
bar AS (SELECT code, hour, run, min_by(value, k) AS o, max(value) AS h, min(value) AS l, max_by(value, k) AS c, count(*) AS v FROM v GROUP BY ALL)
SELECT code, hour, o, h, l, c, v FROM bar QUALIFY row_number() OVER (PARTITION BY code, hour ORDER BY run DESC) = 1""",
    "capped_upsert": """WITH c AS (SELECT client_id AS code, date_trunc('hour', ts) AS hour, value FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL),
bar AS (SELECT code, hour, max(value) AS px FROM c WHERE hour < '2024-04-01' OR hour >= '2024-04-27' GROUP BY ALL),
cur AS (SELECT DISTINCT code FROM bar WHERE hour >= '2024-04-27'),
late AS (SELECT code FROM bar GROUP BY code ORDER BY min(hour) DESC, code DESC LIMIT (SELECT greatest(0, 160 - count(*)) FROM cur))
SELECT code, hour, px FROM bar WHERE code IN (SELECT code FROM cur UNION SELECT code FROM late) QUALIFY row_number() OVER (PARTITION BY code ORDER BY hour DESC) <= 240""",
    "stream_hourly_bars": """WITH e AS (SELECT event_type AS code, CAST(ts AS DATE) AS d, ts, event_id, value, sum(event_id % 7) OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT - CASE WHEN event_id % 11 = 0 THEN 9 ELSE 0 END AS total FROM events),
s AS (SELECT *, greatest(total - coalesce(lag(total) OVER (PARTITION BY code, d ORDER BY ts, event_id), 0), 0) AS step FROM e)
SELECT code, date_trunc('hour', ts) AS hour, min_by(value, (ts, event_id)) AS o, max(value) AS h, min(value) AS l, max_by(value, (ts, event_id)) AS c, sum(step)::BIGINT AS v FROM s GROUP BY ALL""",
    "similarity_windows": over(f"""SELECT a.code, a.d, {rnd('(a.c / a.hi - 1) * 100', 6)} AS from_high, {rnd('(a.c / a.lo - 1) * 100', 6)} AS from_low, a.i - b.i AS bars_since_low
FROM (SELECT *, max(c) OVER {last(250)} AS hi, min(c) OVER {last(250)} AS lo FROM x0 QUALIFY row_number() OVER (PARTITION BY code ORDER BY d DESC) = 1) a,
LATERAL (SELECT max(i) AS i FROM x0 WHERE x0.code = a.code AND x0.i > a.i - 250 AND x0.c = a.lo) b""", *BASE),
}

# the same rows, kept up
SQL |= {"stream_volume_steps": SQL["cum_to_delta_volume"], "stats_kept_up": SQL["stats_by_strategy"], "reasons_kept_up": SQL["by_reason"], "equity_kept_up": SQL["equity_curve"]}

#: Dates are compared as texts, so that both engines' results hash alike.
DATES = {
    "weekly_bars": ("w",), "sign_runs": ("first", "last"), "fifo_closed": ("buy_d", "sell_d"), "ledger_kpis": ("first", "last"), "closed_trades": ("entry_date", "exit_date"),
    "trade_stats": ("first", "last"), "stats_by_strategy": ("first", "last"), "stats_kept_up": ("first", "last"), "replay_one_slot": ("d", "entry_date"), **dict.fromkeys(("trade_log", "replay_tb", "replay_legacy", "replay_weekly"), ("d", "entry_date")),
    **dict.fromkeys(("timing_60m", "chart_documents", "chart_codes", "hourly_bars", "universe_topn", "universe_counts", "common_share_filter", "extents", "ordered_union", "keyed_upsert", "by_reason", "equity_curve", "reasons_kept_up", "equity_kept_up", "hourly_runs", "capped_upsert", "stream_hourly_bars"), ()),
}


def told() -> dict[str, str]:
    out = {}
    for k, sql in SQL.items():
        cols = DATES.get(k, ("d",))
        out[k] = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in cols)}) FROM ({sql})" if cols else sql
    return out
