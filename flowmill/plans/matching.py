"""As-of joins, reconciliation, coverage, order life cycle and book queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowmill.functions.scalars import day_text, zero_fill
from flowmill.operators import agreement as A, book as K, events as E, joins as J
from flowmill.plans.base import MS_SQL, RAW, STREAM, raw_rows, table
from flowmill.plans.registry import query, rounded, sql_round
from flowmill.session import new_path, staged
from flowmill.sources import io

# --- as-of joins --------------------------------------------------------------


def _signups(spark, d):
    e = table(spark, d, "events").where(F.col("event_type") == "signup")
    return e.groupBy("user_id", F.col("ts").alias("effective_time")).agg(F.max(F.col("event_id") % 10).alias("industry_id"))


def _assigned(spark, d, strict):
    left = table(spark, d, "events").select("event_id", "user_id", F.col("ts").alias("prediction_time"))
    out = J.as_of(
        left, _signups(spark, d), ["user_id"], "prediction_time", "effective_time", ["industry_id"], strict,
        "industry_effective_time",
    )
    return out.withColumn("industry_id", F.coalesce(F.col("industry_id"), F.lit(-1).cast("long")))


def _asof_sql(op):
    return f"""WITH h AS (SELECT user_id, ts AS effective_time, event_id % 10 AS industry_id FROM events
        WHERE event_type = 'signup')
      SELECT e.event_id, e.user_id, coalesce(h.industry_id, -1) AS industry_id,
             epoch_us(h.effective_time) AS effective_us
      FROM events e ASOF LEFT JOIN h ON e.user_id = h.user_id AND e.ts {op} h.effective_time"""


def _asof_out(df):
    return df.select("event_id", "user_id", "industry_id", F.unix_micros(F.col("industry_effective_time").cast("timestamp")).alias("effective_us"))


@query("asof_strict", _asof_sql(">"))
def asof_strict(spark, d):
    return _asof_out(_assigned(spark, d, True))


@query("asof_inclusive", _asof_sql(">="))
def asof_inclusive(spark, d):
    return _asof_out(_assigned(spark, d, False))


@query(
    "asof_leak_audit",
    f"""WITH a AS ({_asof_sql(">=")})
        SELECT count(*) AS n_rows, count(effective_us) AS n_matched,
               count(*) FILTER (effective_us >= epoch_us(ts)) AS n_leaks, max(effective_us) AS max_effective
        FROM a JOIN events USING (event_id)""",
)
def asof_leak_audit(spark, d):
    out = J.as_of_audit(_assigned(spark, d, False), "prediction_time", "industry_effective_time")
    return out.withColumn("max_effective", F.unix_micros(F.col("max_effective").cast("timestamp")))


# --- reconciliation -----------------------------------------------------------


def _real_trades(spark, d):
    return raw_rows(spark, d).where((F.col("type") == "T") & (F.col("trade_type") != "C"))


def _sim_trades(spark, d):
    real = _real_trades(spark, d).select(
        F.col("serial").alias("trade_id"), "buy_id", "sell_id", F.col("trade_price").alias("price"),
        F.col("trade_volume").alias("quantity"), F.col("int_time").alias("trade_time"),
    )
    kept = real.where(F.col("trade_id") % 10 != 3)
    extra = real.where(F.col("trade_id") % 17 == 5).withColumn("buy_id", F.col("buy_id") + 5000)
    return kept.unionByName(extra)


_SIM = f"""{RAW},
real AS (SELECT * FROM raw WHERE type = 'T' AND trade_type <> 'C'),
sim AS (
  SELECT serial AS trade_id, buy_id, sell_id, trade_price AS price, trade_volume AS quantity, int_time AS trade_time
  FROM real WHERE serial % 10 <> 3
  UNION ALL
  SELECT serial, buy_id + 5000, sell_id, trade_price, trade_volume, int_time FROM real WHERE serial % 17 = 5),
sk AS (SELECT buy_id, sell_id, count(*) AS sim_n FROM sim GROUP BY ALL),
fl AS (SELECT r.serial, r.int_time, coalesce(sim_n, 0) AS sim_n FROM real r LEFT JOIN sk USING (buy_id, sell_id)),
ex AS (SELECT * FROM sim s WHERE NOT EXISTS (
  SELECT 1 FROM real r WHERE r.buy_id = s.buy_id AND r.sell_id = s.sell_id))"""


@query(
    "trade_reconciliation",
    f"""WITH {_SIM}, f AS (SELECT arg_min(int_time, serial) AS t, min(serial) AS s FROM fl WHERE sim_n = 0)
        SELECT (SELECT count(*) FROM real) AS n_real, (SELECT count(*) FROM sim) AS n_sim,
               (SELECT count(*) FROM fl WHERE sim_n = 0) AS n_missing, (SELECT count(*) FROM ex) AS n_extra,
               'missing' AS first_kind, f.s AS first_serial, f.t AS first_time,
               (SELECT coalesce(sum(sim_n), 0)::BIGINT FROM fl WHERE serial < f.s) AS n_matched_before
        FROM f""",
)
def trade_reconciliation(spark, d):
    return J.reconcile_trades(_real_trades(spark, d), _sim_trades(spark, d), ["buy_id", "sell_id"])


def _bucket_sql(c):
    s = f"(({c} // 10000000) * 3600 + ({c} // 100000) % 100 * 60 + ({c} // 1000) % 100) // 900 * 900"
    return (
        f"lpad(({s} // 3600)::VARCHAR, 2, '0') || ':' || lpad(({s} % 3600 // 60)::VARCHAR, 2, '0') || ':' "
        f"|| lpad(({s} % 60)::VARCHAR, 2, '0')"
    )


@query(
    "mismatch_time_buckets",
    f"""WITH {_SIM}, u AS (
          SELECT {_bucket_sql("int_time")} AS time_bucket, sim_n AS m, (sim_n = 0)::INT AS mi, 0 AS x FROM fl
          UNION ALL SELECT {_bucket_sql("trade_time")}, 0, 0, 1 FROM ex)
        SELECT time_bucket, sum(m + mi)::BIGINT AS n_real, sum(mi)::BIGINT AS n_missing, sum(x)::BIGINT AS n_extra
        FROM u GROUP BY 1""",
)
def mismatch_time_buckets(spark, d):
    return J.mismatch_buckets(
        _real_trades(spark, d), _sim_trades(spark, d), ["buy_id", "sell_id"], bucket_seconds=900
    )


@query(
    "trade_multiset_difference",
    f"""WITH {_SIM}, a AS (SELECT buy_id, sell_id, trade_price AS price, trade_volume AS quantity,
            int_time AS trade_time, count(*) AS n_left FROM real GROUP BY ALL),
          b AS (SELECT buy_id, sell_id, price, quantity, trade_time, count(*) AS n_right FROM sim GROUP BY ALL)
        SELECT buy_id, sell_id, price, quantity, trade_time, coalesce(n_left, 0) AS n_left,
               coalesce(n_right, 0) AS n_right
        FROM a FULL JOIN b USING (buy_id, sell_id, price, quantity, trade_time)
        WHERE coalesce(n_left, 0) <> coalesce(n_right, 0)""",
)
def trade_multiset_difference(spark, d):
    real = _real_trades(spark, d).select(
        "buy_id", "sell_id", F.col("trade_price").alias("price"), F.col("trade_volume").alias("quantity"),
        F.col("int_time").alias("trade_time"),
    )
    return J.multiset_difference(real, _sim_trades(spark, d), real.columns)


_CUT, _TICKS = 145_700_000, 500


def _drifted_trades(spark, d):
    """Trades of a replay that ran to the day's end: some lost, some repeated, prices off by up to one tick over the tolerance."""
    sim = _sim_trades(spark, d).drop("buy_id", "sell_id")
    kind = F.col("trade_id") % 11
    drift = F.when(kind == 2, 1).when(kind == 4, _TICKS).when(kind == 7, -_TICKS).when(kind == 9, _TICKS + 1).otherwise(0)
    raw = _real_trades(spark, d).select(F.col("serial").alias("trade_id"), "date", "market")
    return sim.join(raw, "trade_id").withColumn("price", F.col("price") + drift)


_PRICES = f"""{_SIM},
drifted AS (
  SELECT r.date, r.market, s.price + CASE s.trade_id % 11 WHEN 2 THEN 1 WHEN 4 THEN {_TICKS} WHEN 7 THEN -{_TICKS} WHEN 9 THEN {_TICKS + 1} ELSE 0 END AS price
  FROM sim s JOIN real r ON r.serial = s.trade_id),
ra AS (SELECT date, market, trade_price AS rv, count(*) AS nr FROM real WHERE int_time < {_CUT} GROUP BY ALL),
sa AS (SELECT date, market, price AS sv, count(*) AS ns FROM drifted GROUP BY ALL),
step AS (
  SELECT date, market, rv, sv, nr::BIGINT AS nr, ns::BIGINT AS ns, 0::BIGINT AS n FROM ra JOIN sa USING (date, market) WHERE abs(rv - sv) <= {_TICKS}
  UNION ALL
  SELECT date, market, rv, sv, nr - max(n) OVER r, ns - max(n) OVER s, n FROM (
    SELECT * EXCLUDE (a, b), CASE WHEN a = 1 AND b = 1 THEN least(nr, ns) ELSE 0 END AS n FROM (
      SELECT date, market, rv, sv, nr, ns, row_number() OVER (PARTITION BY date, market, rv ORDER BY abs(rv - sv), sv) AS a,
             row_number() OVER (PARTITION BY date, market, sv ORDER BY abs(rv - sv), rv) AS b
      FROM step WHERE nr > 0 AND ns > 0))
  WINDOW r AS (PARTITION BY date, market, rv), s AS (PARTITION BY date, market, sv)),
pairs AS (SELECT date, market, rv, sv, sum(n)::BIGINT AS n FROM step GROUP BY ALL HAVING sum(n) > 0),
found AS (
  SELECT date, market, 'matched' AS status, n, abs(rv - sv) AS off FROM pairs
  UNION ALL SELECT date, market, 'missing', nr - coalesce(m, 0), 0 FROM ra LEFT JOIN (SELECT date, market, rv, sum(n) AS m FROM pairs GROUP BY ALL) USING (date, market, rv)
  UNION ALL SELECT date, market, 'extra', ns - coalesce(m, 0), 0 FROM sa LEFT JOIN (SELECT date, market, sv, sum(n) AS m FROM pairs GROUP BY ALL) USING (date, market, sv))"""


@query(
    "trade_price_reconciliation",
    f"""WITH RECURSIVE {_PRICES} SELECT date, market, status, sum(n)::BIGINT AS n_rows, coalesce(sum(n) FILTER (off = 0), 0)::BIGINT AS n_exact,
          sum(n * off)::BIGINT AS total_off, max(off)::BIGINT AS largest_off FROM found WHERE n > 0 GROUP BY ALL""",
)
def trade_price_reconciliation(spark, d):
    """Trades before the cut against a replay, one to one by the closest price within the tolerance."""
    real = A.before_cut(_real_trades(spark, d), "int_time", _CUT).withColumnRenamed("trade_price", "price")
    found = A.match_within(real, _drifted_trades(spark, d), ["date", "market"], "price", _TICKS)
    off = F.coalesce(F.abs(F.col("real_value") - F.col("sim_value")), F.lit(0).cast("long"))
    n = F.col("n")
    return found.groupBy("date", "market", "status").agg(
        F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(off == 0, n)), F.lit(0)).alias("n_exact"),
        F.sum(n * off).alias("total_off"), F.max(off).alias("largest_off"),
    )


def _cancel_sides(spark, d):
    real = raw_rows(spark, d).where((F.col("type") == "O") & (F.col("order_type") == "D")).select(
        (F.col("serial") % 1500).alias("order_id"), F.col("int_time").alias("cancel_time")
    )
    shift = F.when(F.col("order_id") % 5 == 2, 1000).otherwise(0)
    recorded = real.where(F.col("order_id") % 7 != 3).withColumn("cancel_time", F.col("cancel_time") + shift)
    stray = real.where(F.col("order_id") % 11 == 4).withColumn("order_id", F.col("order_id") + 100_000)
    return real, recorded.unionByName(stray)


_CANCELS = f"""{RAW},
od AS (SELECT DISTINCT serial % 1500 AS order_id, int_time AS cancel_time FROM raw WHERE type = 'O' AND order_type = 'D'),
ca AS (SELECT DISTINCT order_id, cancel_time + CASE WHEN order_id % 5 = 2 THEN 1000 ELSE 0 END AS cancel_time
       FROM od WHERE order_id % 7 <> 3
       UNION SELECT order_id + 100000, cancel_time FROM od WHERE order_id % 11 = 4)"""


@query(
    "cancel_reconciliation",
    f"""WITH {_CANCELS} SELECT order_id, cancel_time,
          CASE WHEN ca.k IS NULL THEN 'missing' WHEN od.k IS NULL THEN 'extra' ELSE 'matched' END AS status
        FROM (SELECT *, 1 AS k FROM od) od FULL JOIN (SELECT *, 1 AS k FROM ca) ca USING (order_id, cancel_time)""",
)
def cancel_reconciliation(spark, d):
    return J.reconcile_cancels(*_cancel_sides(spark, d))


@query(
    "cancel_time_mismatch",
    f"""WITH {_CANCELS}, p AS (SELECT od.order_id, count(*) AS n_pairs FROM od JOIN ca USING (order_id)
            WHERE od.cancel_time <> ca.cancel_time GROUP BY 1)
        SELECT order_id, n_pairs, (SELECT count(*) FROM od o WHERE o.order_id = p.order_id) AS n_real,
               (SELECT count(*) FROM ca c WHERE c.order_id = p.order_id) AS n_recorded,
               (SELECT min(cancel_time) FROM od o WHERE o.order_id = p.order_id) AS first_real,
               (SELECT min(cancel_time) FROM ca c WHERE c.order_id = p.order_id) AS first_recorded
        FROM p""",
)
def cancel_time_mismatch(spark, d):
    return J.cancel_time_mismatch(*_cancel_sides(spark, d))


# --- coverage -----------------------------------------------------------------


def _keys(rows, when, key):
    return rows.select(F.to_date(when).alias("date"), F.col(key).alias("key"))


@query(
    "daily_key_coverage",
    """WITH a AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS date, o_orderkey AS k FROM orders),
         b AS (SELECT DISTINCT strftime(l_shipdate, '%Y-%m-%d') AS date, l_orderkey AS k FROM lineitem
               UNION SELECT strftime(o_orderdate, '%Y-%m-%d'), o_orderkey FROM orders WHERE o_orderstatus <> 'P'),
         f AS (SELECT date, a.x AS e, b.x AS s FROM (SELECT *, 1 AS x FROM a) a
               FULL JOIN (SELECT *, 1 AS x FROM b) b USING (date, k))
       SELECT date, count(e) AS expected_rows, count(*) FILTER (e = 1 AND s = 1)::BIGINT AS matched_rows,
              count(*) FILTER (e = 1 AND s IS NULL)::BIGINT AS missing_rows, count(*) FILTER (e IS NULL)::BIGINT AS extra_rows,
              coalesce(count(*) FILTER (e = 1 AND s = 1)::DOUBLE / nullif(count(e), 0), 0) AS coverage
       FROM f GROUP BY date""",
)
def daily_key_coverage(spark, d):
    orders = table(spark, d, "orders")
    actual = _keys(table(spark, d, "lineitem"), "l_shipdate", "l_orderkey").unionByName(
        _keys(orders.where(F.col("o_orderstatus") != "P"), "o_orderdate", "o_orderkey")
    )
    out = J.daily_coverage(_keys(orders, "o_orderdate", "o_orderkey"), actual, ["date", "key"])
    return out.withColumn("date", day_text("date"))


@query(
    "train_oos_overlap",
    """WITH a AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-01-01'),
         b AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '1999-01-01')
       SELECT (SELECT count(*) FROM a) AS n_left, (SELECT count(*) FROM b) AS n_right,
              (SELECT count(*) FROM a JOIN b USING (l_suppkey, l_partkey)) AS n_common""",
)
def train_oos_overlap(spark, d):
    li = table(spark, d, "lineitem")
    split = F.col("l_shipdate") < F.lit("1999-01-01").cast("timestamp_ntz")
    return J.key_overlap(li.where(split), li.where(~split), ["l_suppkey", "l_partkey"])


@query(
    "duplicate_key_check",
    """SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""",
)
def duplicate_key_check(spark, d):
    return J.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "normalised_keys",
    """SELECT strftime(l_shipdate, '%Y-%m-%d') AS date,
              CASE WHEN length(l_suppkey::VARCHAR) < 6 THEN lpad(l_suppkey::VARCHAR, 6, '0')
                   ELSE l_suppkey::VARCHAR END AS symbol, count(*) AS n_rows FROM lineitem GROUP BY ALL""",
)
def normalised_keys(spark, d):
    li = table(spark, d, "lineitem").select(day_text("l_shipdate").alias("date"), F.col("l_suppkey").alias("symbol"))
    return J.normalise_keys(li).groupBy("date", "symbol").agg(F.count(F.lit(1)).alias("n_rows"))


# --- order life cycle and book ------------------------------------------------


@query(
    "record_exports",
    """WITH c AS (SELECT o_orderkey + CASE WHEN o_orderkey % 10 = 4 THEN 100000000 ELSE 0 END AS order_id, strftime(o_orderdate, '%Y-%m-%d') AS cancel_time FROM orders WHERE o_orderkey % 2 = 0),
         o AS (SELECT o_orderkey AS order_id, CASE WHEN o_orderkey % 4 = 0 THEN 'B' ELSE 'S' END AS side, CAST(round(o_totalprice * 100) AS BIGINT) AS price FROM orders),
         j AS (SELECT c.order_id, side, price, cancel_time FROM c LEFT JOIN o USING (order_id))
       SELECT 'trades' AS record, 'T' AS side, count(*) AS n_rows, sum(CAST(round(l_extendedprice * 100) AS BIGINT))::BIGINT AS price_sum, count(DISTINCT l_shipdate) AS n_days FROM lineitem
       UNION ALL SELECT 'cancels', coalesce(side, '-'), count(*), coalesce(sum(price), 0)::BIGINT, count(DISTINCT cancel_time) FROM j GROUP BY side""",
)
def record_exports(spark, d):
    """Trades and cancels written as CSV and read back; some cancels name an order that does not exist."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    key, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    price = lambda c: F.round(F.col(c) * 100).cast("long").alias("price")
    orders = o.select(
        key.alias("order_id"), F.when(key % 4 == 0, "B").otherwise("S").alias("side"), price("o_totalprice"),
        (key % 150 + 50).alias("quantity"), day.alias("order_time"),
    )
    cancels = o.where(key % 2 == 0).select((key + F.when(key % 10 == 4, 100000000).otherwise(0)).alias("order_id"), day.alias("cancel_time"))
    trades = li.select("l_orderkey", "l_partkey", price("l_extendedprice"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"))
    path = new_path(spark, "records")
    io.export_records(trades, cancels, orders, path)
    back = io.read_tree(spark, f"{path}/trades", "*.csv", trades.schema)
    gone = io.read_tree(spark, f"{path}/cancels", "*.csv", "order_id long, side string, price long, quantity long, order_time string, cancel_time string")
    facts = lambda c: (F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum("price"), F.lit(0)).alias("price_sum"), F.count_distinct(c).alias("n_days"))
    sold = back.agg(*facts("day")).select(F.lit("trades").alias("record"), F.lit("T").alias("side"), "n_rows", "price_sum", "n_days")
    lost = gone.groupBy(F.coalesce("side", F.lit("-")).alias("side")).agg(*facts("cancel_time"))
    return sold.unionByName(lost.withColumn("record", F.lit("cancels")))


@query(
    "order_lifecycle",
    """WITH t AS (SELECT l_orderkey AS b, l_partkey AS s, CAST(round(l_extendedprice * 100) AS BIGINT) AS price,
                  l_quantity::BIGINT AS quantity FROM lineitem),
         legs AS (SELECT b AS order_id, price, quantity FROM t UNION ALL SELECT s, price, quantity FROM t WHERE s <> b),
         a AS (SELECT order_id, sum(quantity)::BIGINT AS q, sum(price * quantity)::BIGINT AS v, count(*) AS n
               FROM legs GROUP BY 1),
         o AS (SELECT o_orderkey AS order_id, 50 + o_orderkey % 150 AS initial_quantity,
                      o_orderstatus = 'P' AND o_orderkey % 2 = 0 AS gone FROM orders)
       SELECT order_id, initial_quantity, coalesce(q, 0) AS traded_quantity, coalesce(n, 0) AS total_trades,
              CASE WHEN gone THEN 'cancelled' WHEN initial_quantity - coalesce(q, 0) <= 0 THEN 'filled'
                   WHEN coalesce(q, 0) > 0 THEN 'partial' ELSE 'open' END AS status,
              CASE WHEN NOT gone AND initial_quantity - coalesce(q, 0) <= 0 THEN 0
                   ELSE initial_quantity - coalesce(q, 0) END AS remaining_quantity,
              CASE WHEN coalesce(q, 0) > 0 THEN v::DOUBLE / q ELSE 0 END AS avg_trade_price
       FROM o LEFT JOIN a USING (order_id)""",
)
def order_lifecycle(spark, d):
    o = table(spark, d, "orders")
    orders = o.select(F.col("o_orderkey").alias("order_id"), (F.col("o_orderkey") % 150 + 50).alias("initial_quantity"))
    cancels = o.where((F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 2 == 0)).select(F.col("o_orderkey").alias("order_id"))
    trades = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("buy_order_id"), F.col("l_partkey").alias("sell_order_id"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("price"),
        F.col("l_quantity").cast("long").alias("quantity"),
    )
    return K.order_lifecycle(orders, trades, cancels)


@query(
    "market_order_class",
    """WITH t AS (SELECT l_orderkey AS order_id, l_linenumber * 100000 + l_partkey AS serial,
                    CASE WHEN l_discount >= 0.1 THEN 'C' ELSE 'F' END AS trade_type,
                    CASE WHEN l_discount >= 0.1 THEN 0
                         ELSE CAST(round(l_tax * 100) AS BIGINT) // 4 * (CASE WHEN l_returnflag = 'N' THEN 1 ELSE 2 END) END AS price,
                    (l_quantity * 100000)::BIGINT + l_suppkey AS vol,
                    CASE WHEN l_linestatus = 'O' THEN 'B' ELSE 'S' END AS bsflag FROM lineitem),
         o AS (SELECT o_orderkey AS order_id, CASE WHEN o_orderkey % 2 = 0 THEN 'B' ELSE 'S' END AS side FROM orders),
         u AS (SELECT t.* FROM t JOIN o USING (order_id) WHERE trade_type = 'C' OR bsflag = side),
         f AS (SELECT order_id, count(*) FILTER (trade_type = 'C') AS nc,
                 arg_max(vol, (serial, vol)) FILTER (trade_type = 'C') AS cq, arg_max(vol, (serial, vol)) AS lq,
                 min(price) AS mp, count(DISTINCT price) FILTER (price <> 0) AS np FROM u GROUP BY 1)
       SELECT order_id, side,
              CASE WHEN mp IS NULL THEN -1 WHEN nc > 0 THEN -2 WHEN np = 1 THEN 0 WHEN mp = 0 THEN -2 ELSE 1 END AS order_class,
              CASE WHEN nc > 0 THEN cq WHEN mp = 0 AND np <> 1 THEN lq END AS left_quantity
       FROM o LEFT JOIN f USING (order_id)""",
)
def market_order_class(spark, d):
    li = table(spark, d, "lineitem")
    cancel = F.col("l_discount") >= 0.1
    level = F.floor(F.round(F.col("l_tax") * 100) / 4).cast("long") * F.when(F.col("l_returnflag") == "N", 1).otherwise(2)
    trades = li.select(
        F.col("l_orderkey").alias("order_id"),
        (F.col("l_linenumber").cast("long") * 100_000 + F.col("l_partkey")).alias("serial"),
        F.when(cancel, "C").otherwise("F").alias("trade_type"),
        F.when(cancel, F.lit(0).cast("long")).otherwise(level).alias("trade_price"),
        ((F.col("l_quantity") * 100_000).cast("long") + F.col("l_suppkey")).alias("trade_volume"),
        F.when(F.col("l_linestatus") == "O", "B").otherwise("S").alias("bsflag"),
    )
    orders = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.when(F.col("o_orderkey") % 2 == 0, "B").otherwise("S").alias("side")
    )
    return K.market_order_class(orders, trades)


@query(
    "clearing_price",
    """WITH o AS (SELECT strftime(l_shipdate, '%Y-%m') AS month, CAST(round(l_extendedprice / 500) AS BIGINT) AS price,
                    l_quantity::BIGINT AS q, CASE WHEN l_returnflag = 'A' OR l_returnflag = 'N' AND l_linenumber % 2 = 0 THEN 'S' ELSE 'B' END AS side
             FROM lineitem),
         l AS (SELECT month, price, sum(CASE WHEN side = 'B' THEN q ELSE 0 END) AS b,
                 sum(CASE WHEN side = 'S' THEN q ELSE 0 END) AS s FROM o GROUP BY ALL),
         c AS (SELECT month, price, least(sum(b) OVER (PARTITION BY month ORDER BY price DESC),
                 sum(s) OVER (PARTITION BY month ORDER BY price))::BIGINT AS volume FROM l)
       SELECT month, arg_max(price, (volume, -price)) AS clearing_price, max(volume) AS volume
       FROM c WHERE volume > 0 GROUP BY month""",
)
def clearing_price(spark, d):
    sold = (F.col("l_returnflag") == "A") | (F.col("l_returnflag") == "N") & (F.col("l_linenumber") % 2 == 0)
    orders = table(spark, d, "lineitem").select(
        F.date_format("l_shipdate", "yyyy-MM").alias("month"),
        F.round(F.col("l_extendedprice") / 500).cast("long").alias("price"),
        F.col("l_quantity").cast("long").alias("quantity"),
        F.when(sold, "S").otherwise("B").alias("side"),
    )
    return K.clearing_price(orders, ["month"])


_CUTS = ("2024-01-08 12:00:00", "2024-01-16 12:00:00", "2024-01-25 09:30:00")


def _book_levels(spark, d):
    e = table(spark, d, "events").select(
        "event_id", "ts", "event_type", zero_fill(F.col("user_id") % 20).alias("symbol"),
        F.round(F.col("value") * 2).cast("long").alias("price"), (F.col("event_id") % 50 + 1).alias("quantity"),
    )
    orders = e.where(F.col("event_type").isin("view", "click")).select(
        F.col("event_id").alias("order_id"), "symbol", F.when(F.col("event_type") == "view", "B").otherwise("S").alias("side"),
        F.when(F.col("event_type") == "view", F.col("price")).otherwise(F.col("price") + 30).alias("price"), "quantity",
        F.col("ts").alias("time"),
    )
    fills = e.where(F.col("event_type") == "purchase").select(
        (F.col("event_id") - 3).alias("order_id"), F.floor(F.col("quantity") / 2).cast("long").alias("quantity"), F.col("ts").alias("time")
    )
    cancels = e.where(F.col("event_type") == "error").select((F.col("event_id") - 5).alias("order_id"), F.col("ts").alias("time"))
    return K.depth_at(orders, fills, cancels, [F.lit(c).cast("timestamp_ntz") for c in _CUTS])


_LEVELS = f"""
e AS (SELECT event_id, ts, event_type, lpad((user_id % 20)::VARCHAR, 6, '0') AS symbol,
        CAST(round(value * 2) AS BIGINT) AS price, event_id % 50 + 1 AS quantity FROM events),
o AS (SELECT event_id AS order_id, symbol, CASE WHEN event_type = 'view' THEN 'B' ELSE 'S' END AS side,
        CASE WHEN event_type = 'view' THEN price ELSE price + 30 END AS price, quantity, ts FROM e
      WHERE event_type IN ('view', 'click')),
cuts AS (SELECT unnest([{", ".join(f"TIMESTAMP '{c}'" for c in _CUTS)}]) AS cut),
live AS (
  SELECT cut, o.*, o.quantity - coalesce((SELECT sum(f.quantity // 2) FROM e f WHERE f.event_type = 'purchase'
             AND f.event_id - 3 = o.order_id AND f.ts <= cut), 0)::BIGINT AS q
  FROM o, cuts WHERE o.ts <= cut AND NOT EXISTS (SELECT 1 FROM e x WHERE x.event_type = 'error'
             AND x.event_id - 5 = o.order_id AND x.ts <= cut)),
lv AS (SELECT cut, symbol, side, price, sum(q)::BIGINT AS quantity FROM live WHERE q > 0 GROUP BY ALL),
lev AS (SELECT *, row_number() OVER (PARTITION BY cut, symbol, side
          ORDER BY CASE WHEN side = 'B' THEN -price ELSE price END)::INT AS level FROM lv)"""


@query(
    "depth_by_level",
    f"WITH {_LEVELS} SELECT strftime(cut, '%Y-%m-%d %H:%M') AS cut, symbol, side, price, quantity, level FROM lev",
)
def depth_by_level(spark, d):
    return _book_levels(spark, d).withColumn("cut", F.date_format("cut", "yyyy-MM-dd HH:mm"))


def _state_sql(tick):
    def imb(b, a):
        return f"CASE WHEN {b} + {a} > 0 THEN ({b} - {a})::DOUBLE / ({b} + {a} + 1e-12::DOUBLE) END"
    micro = "(ask1 * bid_qty_1 + bid1 * ask_qty_1)::DOUBLE / (bid_qty_1 + ask_qty_1 + 1e-12::DOUBLE)"
    return {
        "valid": "bid1 IS NOT NULL AND ask1 IS NOT NULL",
        "spread_ticks": f"CAST(round_even((ask1 - bid1)::DOUBLE / {tick}, 0) AS BIGINT)",
        "imbalance_1": sql_round(imb("bid_qty_1", "ask_qty_1")),
        "imbalance_5": sql_round(imb("bid_depth_5", "ask_depth_5")),
        "imbalance_10": sql_round(imb("bid_depth_10", "ask_depth_10")),
        "microprice_delta_ticks": sql_round(
            f"CASE WHEN bid1 IS NOT NULL AND ask1 IS NOT NULL AND bid_qty_1 + ask_qty_1 > 0 THEN "
            f"({micro} - (bid1 + ask1)::DOUBLE / 2) / {tick} END"
        ),
    }


_MEASURES = ("imbalance_1", "imbalance_5", "imbalance_10", "microprice_delta_ticks")


@query(
    "book_state_at_cuts",
    f"""WITH {_LEVELS}, s AS (
      SELECT strftime(cut, '%Y-%m-%d %H:%M') AS cut, symbol,
        max(price) FILTER (side = 'B' AND level = 1) AS bid1, max(price) FILTER (side = 'S' AND level = 1) AS ask1,
        {", ".join(f"coalesce(sum(quantity) FILTER (side = '{s}' AND level <= {n}), 0)::BIGINT AS {p}_{c}"
                   for s, p in (("B", "bid"), ("S", "ask")) for n, c in ((1, "qty_1"), (5, "depth_5"), (10, "depth_10")))}
      FROM lev GROUP BY ALL)
    SELECT *, {", ".join(f"{e} AS {n}" for n, e in _state_sql(1).items())} FROM s""",
)
def book_state_at_cuts(spark, d):
    out = K.book_state(_book_levels(spark, d), ["cut", "symbol"], tick=1)
    out = out.withColumns({m: rounded(m) for m in _MEASURES})
    return out.withColumn("cut", F.date_format("cut", "yyyy-MM-dd HH:mm"))


# --- per-event book columns -----------------------------------------------------


def book_events(spark, d):
    """The event stream with flat book-state columns derived from each message."""
    s = staged(E.event_stream(raw_rows(spark, d)), "stream")
    n, v, p = F.col("serial"), F.col("volume"), F.col("price")
    return s.withColumns({
        "bid1": F.when(n % 23 != 0, p - (n % 2 + 1) * 100),
        "ask1": F.when(n % 29 != 0, p + (n % 3 + 1) * 100),
        "bid_qty_1": v,
        "ask_qty_1": (n % 40 + 1) * 100,
        "bid_depth_5": v * 3,
        "ask_depth_5": (n % 40 + 1) * 250,
        "bid_depth_10": v * 5,
        "ask_depth_10": (n % 40 + 1) * 400,
    })


_BOOK = f"""{STREAM},
bk AS (
  SELECT *, {MS_SQL} AS ms, CASE WHEN serial % 23 <> 0 THEN price - (serial % 2 + 1) * 100 END AS bid1,
    CASE WHEN serial % 29 <> 0 THEN price + (serial % 3 + 1) * 100 END AS ask1,
    volume AS bid_qty_1, (serial % 40 + 1) * 100 AS ask_qty_1, volume * 3 AS bid_depth_5,
    (serial % 40 + 1) * 250 AS ask_depth_5, volume * 5 AS bid_depth_10, (serial % 40 + 1) * 400 AS ask_depth_10
  FROM stream),
pp AS (SELECT *, lag(bid1) OVER w AS pb, lag(ask1) OVER w AS pa, lag(bid_qty_1) OVER w AS pbq,
         lag(ask_qty_1) OVER w AS paq, lead(ms) OVER w AS nx FROM bk
       WINDOW w AS (PARTITION BY date, symbol ORDER BY event_idx))"""
_ST = _state_sql(100)
_FEATURES_SQL = f"""SELECT date, symbol, event_idx, {_ST["valid"]} AS book_valid_post,
   {_ST["spread_ticks"]} AS spread_ticks_post, {_ST["microprice_delta_ticks"]} AS microprice_delta_ticks_post,
   {_ST["imbalance_1"]} AS imbalance_l1_post, {_ST["imbalance_5"]} AS imbalance_l5_post,
   {_ST["imbalance_10"]} AS imbalance_l10_post, {sql_round("ln(1 + bid_depth_5)")} AS log_bid_depth_l5_post,
   {sql_round("ln(1 + ask_depth_5)")} AS log_ask_depth_l5_post,
   {sql_round("CASE WHEN price > 0 THEN (price - (pb + pa)::DOUBLE / 2) / 100 END")} AS event_price_distance_ticks_pre
   FROM pp"""
_FLOATS = [c for c in E.BOOK_COLUMNS if c not in ("book_valid_post", "spread_ticks_post")]


def book_feature_table(spark, d):
    return K.book_features(book_events(spark, d), ["date", "symbol"], ["event_idx"], "price", width=1_000_000)


@query("book_features", f"WITH {_BOOK} {_FEATURES_SQL}")
def book_features(spark, d):
    return book_feature_table(spark, d).withColumns({c: rounded(c) for c in _FLOATS})


@query(
    "canonical_events_with_book",
    f"""WITH {_BOOK}, f AS ({_FEATURES_SQL})
        SELECT 'v2' AS schema_version, date, symbol AS security_id, event_idx, serial AS exchange_seqnum,
               {MS_SQL} AS time_of_day_ms, book_valid_post, spread_ticks_post, imbalance_l5_post,
               event_price_distance_ticks_pre FROM f JOIN stream USING (date, symbol, event_idx)""",
)
def canonical_events_with_book(spark, d):
    events = book_events(spark, d)
    book = K.book_features(events, ["date", "symbol"], ["event_idx"], "price", width=1_000_000)
    out = E.canonical(events, "v2", book)
    return out.select(
        "schema_version", "date", "security_id", "event_idx", "exchange_seqnum", "time_of_day_ms", "book_valid_post",
        "spread_ticks_post", rounded("imbalance_l5_post").alias("imbalance_l5_post"),
        rounded("event_price_distance_ticks_pre").alias("event_price_distance_ticks_pre"),
    )


ATOMIC = f"""{_BOOK},
se AS (SELECT *, CASE WHEN ms >= 34200000 AND ms < 41400000 THEN 41400000
                      WHEN ms >= 46800000 AND ms < 53820000 THEN 53820000 END AS fin FROM pp),
du AS (SELECT *, CASE WHEN least(coalesce(nx, fin), fin) - ms > 0 AND fin IS NOT NULL
                      THEN least(coalesce(nx, fin), fin) - ms END AS dur,
        CASE WHEN fin IS NOT NULL THEN
          ((CASE WHEN bid1 >= pb THEN bid_qty_1 ELSE 0 END) - (CASE WHEN bid1 <= pb THEN pbq ELSE 0 END)
           + CASE WHEN pb IS NULL OR bid1 IS NULL THEN NULL ELSE 0 END
           - (CASE WHEN ask1 <= pa THEN ask_qty_1 ELSE 0 END) + (CASE WHEN ask1 >= pa THEN paq ELSE 0 END)
           + CASE WHEN pa IS NULL OR ask1 IS NULL THEN NULL ELSE 0 END)::DOUBLE END AS ofi FROM se),
sums0 AS (SELECT date, symbol,
        sum(CASE WHEN (bid1 + ask1) > 0 THEN 10000.0::DOUBLE * (ask1 - bid1) / ((bid1 + ask1)::DOUBLE / 2) * dur END) AS s,
        coalesce(sum(CASE WHEN (bid1 + ask1) > 0 THEN dur END), 0) AS v, sum(ln(1 + bid_depth_5 + ask_depth_5) * dur) AS dd,
        coalesce(sum(dur), 0) AS ob, sum(ofi) AS f, sum(abs(ofi)) AS fa, count(*) AS n_events, count(ofi) AS n_ofi_events
      FROM du GROUP BY ALL),
atomic AS (SELECT date, symbol, CASE WHEN v > 0 THEN s / v END AS stock_spread_bps,
        CASE WHEN ob > 0 THEN dd / ob END AS stock_depth_l5_log,
        CASE WHEN n_ofi_events > 0 THEN (CASE WHEN fa > 0 THEN f / fa ELSE 0 END) END AS stock_ofi_l1,
        v::DOUBLE / 1000 AS book_valid_seconds, ob::DOUBLE / 1000 AS observed_seconds,
        14220.0::DOUBLE AS continuous_session_seconds, v::DOUBLE / 1000 / 14220.0::DOUBLE AS book_valid_ratio,
        n_events, n_ofi_events FROM sums0)"""
_ATOMIC_FLOATS = ("stock_spread_bps", "stock_depth_l5_log", "stock_ofi_l1", "book_valid_ratio")


def atomic_table(spark, d):
    return K.stock_day_atomic(book_events(spark, d), ["date", "symbol"], ["event_idx"], width=1_000_000)


@query(
    "stock_day_atomic",
    f"""WITH {ATOMIC} SELECT * REPLACE ({", ".join(f"{sql_round(c, 7)} AS {c}" for c in _ATOMIC_FLOATS)}) FROM atomic""",
)
def stock_day_atomic(spark, d):
    return atomic_table(spark, d).withColumns({c: rounded(c, 7) for c in _ATOMIC_FLOATS})


def _vendor_snapshots(spark, d):
    """Three vendor levels per event, named the way vendors name them."""
    e = raw_rows(spark, d).select("symbol", "int_time", "date", "serial", (F.col("trade_price") + F.col("order_price")).alias("px"))
    cols = {}
    for i in (1, 2, 3):
        cols |= {
            f"bid_price_{i}": F.col("px") - 100 * i, f"bid_volume_{i}": F.col("serial") % 7 + i,
            f"ask_price_{i}": F.col("px") + 100 * i, f"ask_volume_{i}": F.col("serial") % 5 + i,
        }
    return e.withColumns(cols)


@query(
    "vendor_level_arrays",
    f"""WITH {RAW}, l AS (SELECT unnest([1, 2, 3]) AS level, serial, trade_price + order_price AS px FROM raw)
        SELECT serial, level::INT AS level, (px - 100 * level)::DOUBLE AS bid_px, (serial % 7 + level)::DOUBLE AS bid_qty,
          (px + 100 * level)::DOUBLE AS ask_px, (serial % 5 + level)::DOUBLE AS ask_qty FROM l""",
)
def vendor_level_arrays(spark, d):
    cols = ["bid_px", "bid_qty", "ask_px", "ask_qty"]
    out = K.level_arrays(_vendor_snapshots(spark, d)).select("serial", F.posexplode(F.arrays_zip(*cols)).alias("i", "v"))
    return out.select("serial", (F.col("i") + 1).alias("level"), *[F.col("v")[c].alias(c) for c in cols])


@query(
    "snapshot_reconciliation",
    f"""WITH {RAW}, v AS (SELECT date, symbol, int_time, serial, trade_price + order_price AS px FROM raw),
          rb AS (SELECT * FROM v WHERE serial % 4 <> 1 QUALIFY row_number() OVER (PARTITION BY date, symbol, int_time ORDER BY serial DESC) = 1),
          rf AS (SELECT * FROM v WHERE serial % 3 = 0),
          j AS (SELECT rf.*, rb.px AS bpx, rb.serial AS bs FROM rf ASOF JOIN rb
                ON rf.date = rb.date AND rf.symbol = rb.symbol AND rf.int_time >= rb.int_time),
          l AS (SELECT unnest([1, 2, 3]) AS level, * FROM j),
          c AS (SELECT level, abs((bpx - 100 * level) - (px - 100 * level)) <= 1e-4 AS p,
                       abs((bs % 7 + level) - (serial % 7 + level)) <= 1.0 + 1e-6 * abs(serial % 7 + level) AS q FROM l
                UNION ALL
                SELECT level, abs((bpx + 100 * level) - (px + 100 * level)) <= 1e-4,
                       abs((bs % 5 + level) - (serial % 5 + level)) <= 1.0 + 1e-6 * abs(serial % 5 + level) FROM l)
        SELECT level, count(*) AS n_compared, count(*) FILTER (p)::BIGINT AS n_price_match, count(*) FILTER (q)::BIGINT AS n_qty_match,
               count(*) FILTER (p)::DOUBLE / count(*) AS price_match_rate FROM c GROUP BY level""",
)
def snapshot_reconciliation(spark, d):
    snaps = K.level_arrays(_vendor_snapshots(spark, d)).select(
        "date", "symbol", "int_time", "serial", "bid_px", "bid_qty", "ask_px", "ask_qty"
    )
    rebuilt = snaps.where(F.col("serial") % 4 != 1)
    reference = snaps.where(F.col("serial") % 3 == 0).drop("serial")
    return K.reconcile_snapshots(rebuilt, reference, ["date", "symbol"], "int_time", tie=["serial"])
