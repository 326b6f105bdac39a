"""The bars view over ``events``, as SQL."""

from barspan.oracle.text import cte

BARS = """
WITH e AS (
  SELECT event_id, ts, CAST(ts AS DATE) AS d, user_id % 10 AS symbol, event_type AS et,
         CAST(round(value * 100) AS BIGINT) AS v,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k
  FROM events),
s AS (
  SELECT *, CAST(year(d) * 10000 + month(d) * 100 + day(d) AS BIGINT) AS date,
         CAST(row_number() OVER (PARTITION BY d, symbol ORDER BY ts, event_id) AS BIGINT) AS idx
  FROM e),
p AS (
  SELECT *, 10000 + 100 * symbol + v % 5 + idx % 3 AS mid2, 1 + k % 3 AS hs,
         CASE WHEN et = 'purchase' THEN 1 + k % 5 ELSE 0 END AS nb,
         CASE WHEN et IN ('purchase', 'click') THEN k % 4 ELSE 0 END AS ns,
         v % 6 AS ab, k % 6 AS asl, v % 4 AS cb, k % 4 AS cs
  FROM s)
SELECT date, symbol, CAST(93000000 + (idx - 1) * 1000000 AS BIGINT) AS bar,
  CAST(mid2 AS DOUBLE) / 100 AS midpx,
  CASE WHEN nb + ns > 0 THEN CAST(mid2 + k % 3 - 1 AS DOUBLE) / 100 ELSE CAST(0 AS DOUBLE) END AS lastpx,
  CAST(10000 + 100 * symbol + v % 3 AS DOUBLE) / 100 AS open,
  CAST(mid2 + hs + 1 AS DOUBLE) / 100 AS high, CAST(mid2 - hs - 1 AS DOUBLE) / 100 AS low,
  CAST(mid2 - hs AS DOUBLE) / 100 AS bid0, CAST(mid2 + hs AS DOUBLE) / 100 AS ask0,
  CAST(mid2 - hs - 4 AS DOUBLE) / 100 AS bid4, CAST(mid2 + hs + 4 AS DOUBLE) / 100 AS ask4,
  CAST(mid2 - hs - 9 AS DOUBLE) / 100 AS bid9, CAST(mid2 + hs + 9 AS DOUBLE) / 100 AS ask9,
  CAST(mid2 - hs - 19 AS DOUBLE) / 100 AS bid19, CAST(mid2 + hs + 19 AS DOUBLE) / 100 AS ask19,
  CAST(100 + v % 97 AS DOUBLE) AS bsize0, CAST(100 + k % 89 AS DOUBLE) AS asize0,
  CAST(400 + (3 * v) % 301 AS DOUBLE) AS bsize0_4, CAST(400 + (7 * k + v) % 307 AS DOUBLE) AS asize0_4,
  CAST(500 + v % 211 AS DOUBLE) AS bsize5_9, CAST(500 + (v + k) % 223 AS DOUBLE) AS asize5_9,
  CAST(900 + v % 401 AS DOUBLE) AS bsize10_19, CAST(900 + (v + 3 * k) % 409 AS DOUBLE) AS asize10_19,
  CAST(nb AS DOUBLE) AS nTradeBuy, CAST(nb * (10 + v % 13) AS DOUBLE) AS tradeBuyQty,
  CAST(nb * (10 + v % 13) * (mid2 + hs) AS DOUBLE) / 100 AS tradeBuyTurnover,
  CASE WHEN nb > 0 THEN CAST(mid2 + hs + 1 AS DOUBLE) / 100 ELSE CAST(0 AS DOUBLE) END AS tradeBuyHigh,
  CASE WHEN nb > 0 THEN CAST(mid2 + hs AS DOUBLE) / 100 ELSE CAST(0 AS DOUBLE) END AS tradeBuyLow,
  CASE WHEN nb > 0 THEN CAST(2 * mid2 + 2 * hs + 1 AS DOUBLE) / 200 END AS buyVwad,
  CAST(ns AS DOUBLE) AS nTradeSell, CAST(ns * (10 + k % 11) AS DOUBLE) AS tradeSellQty,
  CAST(ns * (10 + k % 11) * (mid2 - hs) AS DOUBLE) / 100 AS tradeSellTurnover,
  CASE WHEN ns > 0 THEN CAST(mid2 - hs AS DOUBLE) / 100 ELSE CAST(0 AS DOUBLE) END AS tradeSellHigh,
  CASE WHEN ns > 0 THEN CAST(mid2 - hs - 1 AS DOUBLE) / 100 ELSE CAST(0 AS DOUBLE) END AS tradeSellLow,
  CASE WHEN ns > 0 THEN CAST(2 * mid2 - 2 * hs - 1 AS DOUBLE) / 200 END AS sellVwad,
  CAST(ab AS DOUBLE) AS nAddBuy, CAST(ab * (5 + k % 9) AS DOUBLE) AS addBuyQty,
  CAST(ab * (5 + k % 9) * (mid2 - hs) AS DOUBLE) / 100 AS addBuyTurnover,
  CASE WHEN ab > 0 THEN CAST(mid2 - hs AS DOUBLE) / 100 ELSE CAST(0 AS DOUBLE) END AS addBuyHigh,
  CASE WHEN ab > 0 THEN CAST(mid2 - hs - 2 AS DOUBLE) / 100 ELSE CAST(0 AS DOUBLE) END AS addBuyLow,
  CAST(asl AS DOUBLE) AS nAddSell, CAST(asl * (5 + v % 7) AS DOUBLE) AS addSellQty,
  CAST(asl * (5 + v % 7) * (mid2 + hs) AS DOUBLE) / 100 AS addSellTurnover,
  CASE WHEN asl > 0 THEN CAST(mid2 + hs + 2 AS DOUBLE) / 100 ELSE CAST(0 AS DOUBLE) END AS addSellHigh,
  CASE WHEN asl > 0 THEN CAST(mid2 + hs AS DOUBLE) / 100 ELSE CAST(0 AS DOUBLE) END AS addSellLow,
  CAST(cb AS DOUBLE) AS nCxlBuy, CAST(cb * (3 + k % 5) AS DOUBLE) AS cxlBuyQty,
  CAST(cb * (3 + k % 5) * (mid2 - hs) AS DOUBLE) / 100 AS cxlBuyTurnover,
  CASE WHEN cb > 0 THEN CAST(mid2 - hs - 1 AS DOUBLE) / 100 ELSE CAST(0 AS DOUBLE) END AS cxlBuyHigh,
  CASE WHEN cb > 0 THEN CAST(mid2 - hs - 3 AS DOUBLE) / 100 ELSE CAST(0 AS DOUBLE) END AS cxlBuyLow,
  CAST(cs AS DOUBLE) AS nCxlSell, CAST(cs * (3 + v % 5) AS DOUBLE) AS cxlSellQty,
  CAST(cs * (3 + v % 5) * (mid2 + hs) AS DOUBLE) / 100 AS cxlSellTurnover,
  CASE WHEN cs > 0 THEN CAST(mid2 + hs + 3 AS DOUBLE) / 100 ELSE CAST(0 AS DOUBLE) END AS cxlSellHigh,
  CASE WHEN cs > 0 THEN CAST(mid2 + hs + 1 AS DOUBLE) / 100 ELSE CAST(0 AS DOUBLE) END AS cxlSellLow,
  CAST(1 + v % 50 AS DOUBLE) / 100 AS btr0_4, CAST(1 + k % 50 AS DOUBLE) / 100 AS atr0_4,
  CAST(1 + v % 30 AS DOUBLE) / 100 AS btr5_9, CAST(1 + (v + k) % 30 AS DOUBLE) / 100 AS atr5_9,
  CAST(1 + v % 20 AS DOUBLE) / 100 AS btr10_19, CAST(1 + (v + 2 * k) % 20 AS DOUBLE) / 100 AS atr10_19,
  coalesce(CAST(lead(mid2, 12) OVER (PARTITION BY date, symbol ORDER BY idx) AS DOUBLE) / CAST(mid2 AS DOUBLE) - CAST(1 AS DOUBLE),
           CAST(0 AS DOUBLE)) AS fret12
FROM p
"""

cte("bars", (), BARS.strip())
