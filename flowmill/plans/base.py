"""The given tables seen as market data, once for Spark and once as SQL text.

``events`` becomes the message feed (user = instrument, purchase/error = trade
rows, the rest = order rows, price = 1000 yuan + value) and its daily quotes; ``lineitem`` becomes a second
daily panel (supplier = instrument, ship date = day).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowmill.functions import market as M
from flowmill.functions.scalars import day_text, zero_fill
from flowmill.session import staged


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def user_code(uid):
    """Six-digit code: the last digit of the user decides market and board."""
    d = uid % 10
    return (
        F.when(d == 8, 688000 + uid)
        .when(d == 1, uid)
        .when(d == 3, 300000 + uid)
        .when(d == 5, 2000 + uid)
        .when(d == 7, 830000 + uid)
        .when(d == 9, 900000 + uid)
        .otherwise(600000 + uid)
    )


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged raw order and trade messages."""
    e = table(spark, sf_dir, "events").drop("props")
    eid, uid = F.col("event_id"), F.col("user_id")
    zero, blank = F.lit(0).cast("long"), F.lit("0")
    e = e.select(
        "event_id", "user_id", "ts", "event_type",
        ((F.round(F.col("value") * 100).cast("long") + 100_000) * 100).alias("px"),
        ((eid % 50 + 1) * 100).alias("vol"),
        F.col("event_type").isin("purchase", "error").alias("is_t"),
        M.packed_time("ts").alias("int_time"),
    )
    t = F.col("is_t")
    return e.select(
        day_text("ts").alias("date"),
        zero_fill(user_code(uid)).alias("symbol"),
        F.when(uid % 2 == 0, "SH").otherwise("SZ").alias("market"),
        F.when(t, "T").otherwise("O").alias("type"),
        "int_time",
        (F.col("int_time") + eid % 7).alias("local_time"),
        F.col("int_time").alias("exchange_time"),
        eid.alias("serial"),
        F.when(F.col("event_type") == "error", "C").when(t, "F").otherwise(blank).alias("trade_type"),
        F.when(F.col("event_type") == "signup", "D").when(~t, "A").otherwise(blank).alias("order_type"),
        F.when(t, zero).otherwise(eid).alias("orderorino"),
        F.when(t, eid % 991).otherwise(zero).alias("sell_id"),
        F.when(t, eid % 997).otherwise(zero).alias("buy_id"),
        F.when(eid % 3 == 0, "B").when(eid % 3 == 1, "S").otherwise("").alias("bsflag"),
        F.when(t, F.col("px")).otherwise(zero).alias("trade_price"),
        F.when(t, zero).otherwise(F.col("px")).alias("order_price"),
        F.when(t, F.col("vol")).otherwise(zero).alias("trade_volume"),
        F.when(t, zero).otherwise(F.col("vol")).alias("order_volume"),
    )


RAW = """
ev AS (
  SELECT event_id, user_id, ts, event_type, value,
         (CAST(round(value * 100) AS BIGINT) + 100000) * 100 AS px, (event_id % 50 + 1) * 100 AS vol,
         event_type IN ('purchase', 'error') AS is_t,
         CAST(hour(ts) AS BIGINT) * 10000000 + minute(ts) * 100000 + second(ts) * 1000
           + (microsecond(ts) // 1000) % 1000 AS int_time,
         CASE user_id % 10 WHEN 8 THEN 688000 + user_id WHEN 1 THEN user_id WHEN 3 THEN 300000 + user_id
           WHEN 5 THEN 2000 + user_id WHEN 7 THEN 830000 + user_id WHEN 9 THEN 900000 + user_id
           ELSE 600000 + user_id END AS code
  FROM events),
raw AS (
  SELECT strftime(ts, '%Y-%m-%d') AS date,
         CASE WHEN length(code::VARCHAR) < 6 THEN lpad(code::VARCHAR, 6, '0') ELSE code::VARCHAR END AS symbol,
         CASE WHEN user_id % 2 = 0 THEN 'SH' ELSE 'SZ' END AS market,
         CASE WHEN is_t THEN 'T' ELSE 'O' END AS type, int_time,
         int_time + event_id % 7 AS local_time, int_time AS exchange_time, event_id AS serial,
         CASE WHEN event_type = 'error' THEN 'C' WHEN is_t THEN 'F' ELSE '0' END AS trade_type,
         CASE WHEN event_type = 'signup' THEN 'D' WHEN NOT is_t THEN 'A' ELSE '0' END AS order_type,
         CASE WHEN is_t THEN 0 ELSE event_id END AS orderorino,
         CASE WHEN is_t THEN event_id % 991 ELSE 0 END AS sell_id,
         CASE WHEN is_t THEN event_id % 997 ELSE 0 END AS buy_id,
         CASE event_id % 3 WHEN 0 THEN 'B' WHEN 1 THEN 'S' ELSE '' END AS bsflag,
         CASE WHEN is_t THEN px ELSE 0 END AS trade_price, CASE WHEN is_t THEN 0 ELSE px END AS order_price,
         CASE WHEN is_t THEN vol ELSE 0 END AS trade_volume, CASE WHEN is_t THEN 0 ELSE vol END AS order_volume
  FROM ev)"""

STREAM = (
    RAW
    + """,
stream AS (
  SELECT date, symbol, market, type,
         row_number() OVER d - 1 AS event_idx, int_time, local_time, serial,
         CAST(greatest(coalesce(int_time - lag(int_time) OVER d, 0), 0) AS BIGINT) AS delta_t,
         CASE WHEN int_time < 93000000 THEN 'OPEN_AUCTION' WHEN int_time < 113000000 THEN 'CONTINUOUS_AM'
              WHEN int_time < 130000000 THEN 'MIDDAY_BREAK' WHEN int_time < 145700000 THEN 'CONTINUOUS_PM'
              ELSE 'CLOSE_AUCTION' END AS session_phase,
         CASE WHEN type = 'T' THEN (CASE WHEN trade_type = 'C' THEN 'CANCEL' ELSE 'TRADE' END)
              WHEN order_type = 'D' THEN 'CANCEL' ELSE 'ADD' END AS event_type,
         CASE bsflag WHEN 'B' THEN 'BUY' WHEN 'S' THEN 'SELL' ELSE 'UNKNOWN' END AS side,
         CASE WHEN type = 'T' THEN trade_price ELSE order_price END AS price,
         CASE WHEN type = 'T' THEN trade_volume ELSE order_volume END AS volume,
         orderorino, buy_id, sell_id
  FROM raw
  WINDOW d AS (PARTITION BY date, symbol ORDER BY int_time, serial, type DESC))"""
)

BOARD_SQL = """CASE WHEN market = 'SH' THEN
    (CASE WHEN substr(symbol, 1, 3) = '688' THEN 'STAR' WHEN substr(symbol, 1, 2) = '60' THEN 'MAIN' ELSE 'UNKNOWN' END)
  WHEN substr(symbol, 1, 3) IN ('300', '301') THEN 'CHINEXT' WHEN substr(symbol, 1, 3) IN ('002', '003') THEN 'SME'
  WHEN substr(symbol, 1, 3) IN ('000', '001') THEN 'MAIN'
  WHEN substr(symbol, 1, 2) IN ('43', '83', '87', '88', '92') OR substr(symbol, 1, 3) = '920' THEN 'BSE'
  ELSE 'UNKNOWN' END"""

MS_SQL = """((int_time // 10000000) % 100 * 3600 + (int_time // 100000) % 100 * 60 + (int_time // 1000) % 100) * 1000
  + int_time % 1000"""

CANON = (
    STREAM
    + f""",
canon AS (
  SELECT date, symbol, market, CASE WHEN market = 'SH' THEN 'XSHG' ELSE 'XSHE' END AS exchange,
         {BOARD_SQL} AS board,
         CASE session_phase WHEN 'OPEN_AUCTION' THEN 'OPEN_CALL' WHEN 'CONTINUOUS_AM' THEN 'CONT_AM'
           WHEN 'MIDDAY_BREAK' THEN 'LUNCH' WHEN 'CONTINUOUS_PM' THEN 'CONT_PM' ELSE 'CLOSE_CALL' END AS session,
         CASE WHEN event_type = 'TRADE' THEN 'TRADE' ELSE 'ORDER' END AS event_source,
         CASE event_type WHEN 'TRADE' THEN 'EXEC' ELSE event_type END AS evt_type,
         CASE side WHEN 'BUY' THEN 'B' WHEN 'SELL' THEN 'S' ELSE 'N' END AS side,
         price::DOUBLE / 10000.0::DOUBLE AS price, volume::DOUBLE AS qty,
         (price::DOUBLE / 10000.0::DOUBLE) * volume::DOUBLE AS amount,
         CASE event_type WHEN 'CANCEL' THEN 'CANCEL' WHEN 'TRADE' THEN 'UNKNOWN' ELSE 'LIMIT' END AS order_type,
         delta_t, int_time, local_time, serial AS source_seqnum, event_idx,
         {MS_SQL} AS ms
  FROM stream)"""
)


def event_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily quotes per instrument from the message feed; all sums are exact integers."""
    raw = raw_rows(spark, sf_dir)
    px = F.col("trade_price") + F.col("order_price")
    vol = F.col("trade_volume") + F.col("order_volume")
    at = F.struct("int_time", "serial")
    sign = F.when(F.col("bsflag") == "B", 1).when(F.col("bsflag") == "S", -1).otherwise(0)
    day = F.dayofmonth(F.to_date("date"))
    number = F.col("symbol").cast("long")
    quotes = raw.groupBy("date", "symbol", "market").agg(
        F.min_by(px, at).alias("open_px"),
        F.max_by(px, at).alias("close_px"),
        F.max(px).alias("high_px"),
        F.min(px).alias("low_px"),
        F.sum(vol).alias("total_vol"),
        F.sum(px * vol).alias("notional"),
        F.sum(sign).alias("signed"),
        F.count(F.lit(1)).alias("n_events"),
    )
    return quotes.select(
        "date", "symbol", "market",
        (F.col("open_px") / 10000.0).alias("open"),
        (F.col("close_px") / 10000.0).alias("close"),
        (F.col("high_px") / 10000.0).alias("high"),
        (F.col("low_px") / 10000.0).alias("low"),
        (F.col("notional") / F.col("total_vol") / 10000.0).alias("vwap"),
        F.col("total_vol").cast("double").alias("total_vol"),
        (F.col("notional") / 10000.0).alias("total_notional"),
        (F.col("signed") / F.col("n_events")).alias("factor_ofi"),
        "n_events",
        (number % 13 == 0).alias("is_st"),
        ((number % 17 == 0) & (day < 5)).alias("is_new"),
        ((number + day) % 19 == 0).alias("is_halt"),
        ((number + day) % 11 == 0).alias("limit_locked"),
    )


def staged_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(event_days(spark, sf_dir), "days")


DAYS = (
    RAW
    + """,
quotes AS (
  SELECT date, symbol, market,
         arg_min(trade_price + order_price, (int_time, serial)) AS open_px,
         arg_max(trade_price + order_price, (int_time, serial)) AS close_px,
         max(trade_price + order_price) AS high_px, min(trade_price + order_price) AS low_px,
         sum(trade_volume + order_volume)::BIGINT AS total_vol,
         sum((trade_price + order_price) * (trade_volume + order_volume))::BIGINT AS notional,
         sum(CASE bsflag WHEN 'B' THEN 1 WHEN 'S' THEN -1 ELSE 0 END)::BIGINT AS signed, count(*) AS n_events
  FROM raw GROUP BY ALL),
days AS (
  SELECT date, symbol, market,
         open_px::DOUBLE / 10000.0::DOUBLE AS open, close_px::DOUBLE / 10000.0::DOUBLE AS close,
         high_px::DOUBLE / 10000.0::DOUBLE AS high, low_px::DOUBLE / 10000.0::DOUBLE AS low,
         notional::DOUBLE / total_vol::DOUBLE / 10000.0::DOUBLE AS vwap, total_vol::DOUBLE AS total_vol,
         notional::DOUBLE / 10000.0::DOUBLE AS total_notional,
         signed::DOUBLE / n_events::DOUBLE AS factor_ofi, n_events,
         symbol::BIGINT % 13 = 0 AS is_st,
         symbol::BIGINT % 17 = 0 AND day(date::DATE) < 5 AS is_new,
         (symbol::BIGINT + day(date::DATE)) % 19 = 0 AS is_halt,
         (symbol::BIGINT + day(date::DATE)) % 11 = 0 AS limit_locked
  FROM quotes),
cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS calendar_index FROM (SELECT DISTINCT date FROM days))"""
)


def line_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily panel from ``lineitem``: supplier = instrument, ship date = day."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_shipdate", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag"
    )
    signed = F.when(F.col("l_returnflag") == "A", F.col("l_quantity")).when(
        F.col("l_returnflag") == "R", -F.col("l_quantity")
    ).otherwise(0.0)
    sums = li.groupBy(F.to_date("l_shipdate").alias("day"), "l_suppkey").agg(
        F.sum("l_quantity").alias("qty"),
        F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"),
        F.sum(signed).alias("signed"),
        F.count(F.lit(1)).alias("n_lines"),
    )
    return sums.select(
        day_text("day").alias("date"), zero_fill("l_suppkey").alias("symbol"), "qty", "n_lines",
        (F.col("cents") / 100.0).alias("amount"),
        (F.col("cents") / F.col("qty") / 100.0).alias("vwap"),
        (F.col("signed") / F.col("qty")).alias("score"),
    )


LINE_DAYS = """
sums AS (
  SELECT strftime(l_shipdate, '%Y-%m-%d') AS date,
         CASE WHEN length(l_suppkey::VARCHAR) < 6 THEN lpad(l_suppkey::VARCHAR, 6, '0')
              ELSE l_suppkey::VARCHAR END AS symbol,
         sum(l_quantity) AS qty, sum(CAST(round(l_extendedprice * 100) AS BIGINT))::BIGINT AS cents,
         sum(CASE l_returnflag WHEN 'A' THEN l_quantity WHEN 'R' THEN -l_quantity ELSE 0 END) AS signed,
         count(*) AS n_lines
  FROM lineitem GROUP BY ALL),
lines AS (
  SELECT date, symbol, qty, n_lines, cents::DOUBLE / 100.0::DOUBLE AS amount,
         cents::DOUBLE / qty / 100.0::DOUBLE AS vwap, signed / qty AS score
  FROM sums),
lcal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS calendar_index FROM (SELECT DISTINCT date FROM lines))"""
