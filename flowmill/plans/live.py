"""Streaming queries: the given tables arrive in groups and the streams resume in between."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowmill.functions.scalars import day_text, zero_fill
from flowmill.plans.base import table
from flowmill.plans.registry import query, rounded, sql_round
from flowmill.session import new_path
from flowmill.streaming import streams as L
from flowmill.streaming.store import StreamStore

_ENDS = (11, 21, 32)


def _feed(spark, d):
    return table(spark, d, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), zero_fill("user_id").alias("symbol"), F.col("event_type").alias("kind"),
        F.col("value").alias("price"), (F.col("event_id") % 50 + 1).cast("double").alias("qty"),
    )


def _arrivals(df, group):
    df = df.withColumn("__g", group)
    return [df.where(F.col("__g") == g).drop("__g") for g in range(len(_ENDS))]


def _by_day(spark, d):
    day = F.dayofmonth("ts")
    return _arrivals(_feed(spark, d), F.when(day < _ENDS[0], 0).when(day < _ENDS[1], 1).otherwise(2))


_SYM = "CASE WHEN length(user_id::VARCHAR) < 6 THEN lpad(user_id::VARCHAR, 6, '0') ELSE user_id::VARCHAR END"


@query(
    "stream_clock_windows",
    f"""WITH t AS (SELECT strftime(ts, '%Y-%m-%d') AS date, {_SYM} AS symbol, event_id % 50 + 1 AS qty,
          (hour(ts) * 3600 + minute(ts) * 60 + second(ts)) * 1000 + (microsecond(ts) // 1000) % 1000 AS ms FROM events)
        SELECT date, symbol, (CASE WHEN ms >= 34200000 AND ms <= 41400000 THEN 1 + least((ms - 34200000) // 300000, 23)
            WHEN ms >= 46800000 AND ms <= 54000000 THEN 25 + least((ms - 46800000) // 300000, 23)
            WHEN ms >= 33300000 AND ms < 34200000 THEN 0 ELSE -1 END)::INT AS clock_interval, count(*) AS n_events, sum(qty)::DOUBLE AS qty
        FROM t GROUP BY ALL""",
)
def stream_clock_windows(spark, d):
    out = StreamStore(spark, name="clock")
    L.replay(spark, _by_day(spark, d), L.clock_windows(out))
    return L.newest(out.log(), ["date", "symbol", "clock_interval"])


@query(
    "stream_sliding_windows",
    """WITH w AS (SELECT unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS s, event_type, event_id FROM events)
       SELECT strftime(s, '%Y-%m-%d %H:%M') AS start, event_type AS kind, count(*) AS n_events, sum(event_id % 50 + 1)::DOUBLE AS qty FROM w GROUP BY ALL""",
)
def stream_sliding_windows(spark, d):
    out = StreamStore(spark, name="sliding")
    L.replay(spark, _by_day(spark, d), L.sliding_windows(out, "12 hours", "6 hours"))
    return L.newest(out.log(), ["start", "kind"])


@query(
    "stream_new_day_scores",
    f"""SELECT strftime(ts, '%Y-%m-%d') AS date, {_SYM} AS symbol, {sql_round("sum(CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 ELSE 0 END)::DOUBLE / count(*)")} AS score
        FROM events GROUP BY ALL""",
)
def stream_new_day_scores(spark, d):
    path = new_path(spark, "live-scores")
    sign = F.when(F.col("kind") == "purchase", 1).when(F.col("kind") == "error", -1).otherwise(0)

    def score(df):
        return df.groupBy("date", "symbol").agg((F.sum(sign) / F.count(F.lit(1))).alias("score"))

    # The last day of a group is split: one row in three arrives with the next group.
    day = F.dayofmonth("ts") + F.when(F.col("event_id") % 3 == 0, 1).otherwise(0)
    group = F.when(day < _ENDS[0], 0).when(day < _ENDS[1], 1).otherwise(2)
    arrivals = _arrivals(_feed(spark, d).withColumn("date", day_text("ts")), group)
    # The first group arrives twice: its rows count once.
    L.replay(spark, [*arrivals, arrivals[0]], L.new_day_scores(StreamStore(spark, name="days"), path, score, ["event_id"]))
    out = spark.read.parquet(path)
    return out.select(F.date_format("date", "yyyy-MM-dd").alias("date"), zero_fill("symbol").alias("symbol"), rounded("score").alias("score"))


@query(
    "stream_running_vwap",
    f"""WITH t AS (SELECT {_SYM} AS symbol, value AS p, event_id % 50 + 1 AS q, epoch_us(ts) / 1e6::DOUBLE AS t FROM events WHERE event_type = 'purchase' AND value > 0),
          m AS (SELECT *, max(t) OVER (PARTITION BY symbol) AS last FROM t)
        SELECT symbol, {sql_round("sum(p * q * pow(2.0::DOUBLE, (t - last) / 86400.0::DOUBLE)) / sum(q * pow(2.0::DOUBLE, (t - last) / 86400.0::DOUBLE))", 7)} AS mid FROM m GROUP BY symbol""",
)
def stream_running_vwap(spark, d):
    store = StreamStore(spark, name="vwap")
    L.replay(spark, _by_day(spark, d), L.running_vwap(store, 86_400.0))
    return store.state().latest().select("symbol", rounded("mid", 7).alias("mid"))


@query(
    "stream_event_vwap",
    f"""WITH e AS (SELECT event_id, {_SYM} AS symbol, value AS p, event_id % 50 + 1 AS q, epoch_us(ts) / 1000::DOUBLE AS t, event_type = 'purchase' AND value > 0 AS trade FROM events),
          w AS (SELECT x.event_id, sum(y.p * y.q * pow(2.0::DOUBLE, (y.t - x.t) / 43200000.0::DOUBLE)) / sum(y.q * pow(2.0::DOUBLE, (y.t - x.t) / 43200000.0::DOUBLE)) AS mid
                FROM e x JOIN e y ON y.symbol = x.symbol AND y.event_id <= x.event_id AND y.trade GROUP BY x.event_id)
        SELECT event_id, symbol, {sql_round("coalesce(w.mid, first_value(CASE WHEN p > 0 THEN p END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY event_id))", 7)} AS mid
        FROM e LEFT JOIN w USING (event_id)""",
)
def stream_event_vwap(spark, d):
    store = StreamStore(spark, name="event-vwap")
    feed = _feed(spark, d).withColumn("ms", F.unix_micros("ts") / 1000.0)
    day = F.dayofmonth("ts")
    arrivals = _arrivals(feed, F.when(day < _ENDS[0], 0).when(day < _ENDS[1], 1).otherwise(2))
    L.replay(spark, arrivals, L.event_vwap(store, ["symbol"], "event_id", "price", "qty", F.col("kind") == "purchase", "ms", 43_200_000.0))
    return store.log("events").all().select("event_id", "symbol", rounded("mid", 7).alias("mid"))


@query(
    "stream_running_pool",
    f"""WITH e AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim,
          row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS r FROM embeddings)
        SELECT label, dim::INT AS dim, count(*) AS n, {sql_round("avg(x)", 7)} AS mean, {sql_round("avg(x) FILTER (r <= 4)", 7)} AS last_k_mean FROM e GROUP BY label, dim""",
)
def stream_running_pool(spark, d):
    store = StreamStore(spark, name="pool")
    arrivals = _arrivals(table(spark, d, "embeddings"), F.when(F.col("vec_id") % 5 < 2, 0).when(F.col("vec_id") % 5 < 4, 1).otherwise(2).cast("int"))
    L.replay(spark, arrivals, L.running_pool(store, "label", "vec_id", "embedding", 4))
    out = L.pooled_from_state(store.state().latest(), "label")
    out = out.select("label", "n", F.posexplode(F.arrays_zip("mean", "last_k_mean")).alias("dim", "v"))
    return out.select("label", "dim", "n", rounded(F.col("v.mean"), 7).alias("mean"), rounded(F.col("v.last_k_mean"), 7).alias("last_k_mean"))


@query(
    "stream_late_rows",
    """WITH a AS (SELECT ts, CASE WHEN event_id % 50 = 7 THEN 2 WHEN day(ts) < 11 THEN 0 WHEN day(ts) < 21 THEN 1 ELSE 2 END AS g FROM events),
         h AS (SELECT g, max(max(epoch_us(ts))) OVER (ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM a GROUP BY g)
       SELECT g::INT AS batch, strftime(ts, '%Y-%m-%d') AS date, count(*) AS n_rows, count(*) FILTER (epoch_us(ts) < high - 21600000000) AS n_late
       FROM a JOIN h USING (g) GROUP BY ALL""",
)
def stream_late_rows(spark, d):
    store = StreamStore(spark, name="late")
    day = F.dayofmonth("ts")
    group = F.when(F.col("event_id") % 50 == 7, 2).when(day < _ENDS[0], 0).when(day < _ENDS[1], 1).otherwise(2)
    L.replay(spark, _arrivals(_feed(spark, d), group), L.late_rows(store, 21_600))
    return store.log().all()
