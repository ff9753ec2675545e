"""Daily panel queries: quotes, forward returns, execution panel, labels, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowmill.functions.scalars import is_finite
from flowmill.operators import agreement as A, evaluation as EV, gates as G, joins as J, panel as P, xsection as X
from flowmill.plans.base import DAYS, LINE_DAYS, event_days, line_days, raw_rows, staged_days
from flowmill.plans.registry import query, rounded, sql_round
from flowmill.session import new_path, staged
from flowmill.sources import io


def calendar(df):
    return io.index_calendar(df)


def forward(spark, d):
    """Daily quotes with the next calendar day's close-to-close return and a score."""
    days = staged_days(spark, d)
    out = J.forward_return(days, calendar(days), "close")
    return out.withColumns({
        "score": F.col("factor_ofi"),
        "symbol_id": F.col("symbol").cast("long"),
        "eligible_at_signal": ~(F.col("is_st") | F.col("is_new") | F.col("is_halt")),
    })


FWD = f"""{DAYS},
fwd AS (
  SELECT d.*, c.calendar_index, nc.date AS next_date, d.factor_ofi AS score,
         NOT (d.is_st OR d.is_new OR d.is_halt) AS eligible,
         CASE WHEN n.close IS NOT NULL AND d.close > 0 THEN n.close / d.close - 1.0::DOUBLE END AS fwd_ret
  FROM days d JOIN cal c USING (date) LEFT JOIN cal nc ON nc.calendar_index = c.calendar_index + 1
  LEFT JOIN days n ON n.symbol = d.symbol AND n.date = nc.date)"""


def staged_forward(spark, d):
    return staged(forward(spark, d), "forward")


# --- quotes -------------------------------------------------------------------


@query(
    "daily_quotes",
    f"""WITH {DAYS} SELECT * FROM days""",
)
def daily_quotes(spark, d):
    return event_days(spark, d)


def _snapshots(spark, d):
    raw = raw_rows(spark, d)
    px = F.col("trade_price") + F.col("order_price")
    n = F.col("serial")
    return raw.select(
        "date", F.col("symbol").alias("ticker"), F.concat("symbol", F.lit("."), "market").alias("wind_code"),
        F.col("int_time").alias("exch_time"), n.alias("seq"), F.col("type").alias("status"), (px + 100).alias("pre_close_px"),
        px.alias("last_px"), (n % 4 * 100).alias("total_vol"), (n % 4 * px / 100).alias("total_notional"),
        (px + F.when(n % 5 == 0, 0).otherwise(100_000)).alias("upper_limit_px"),
        (px - F.when(n % 7 == 0, 0).otherwise(100_000)).alias("lower_limit_px"),
    )


_SNAP = f"""{DAYS},
sn AS (SELECT date, symbol AS ticker, symbol || '.' || market AS wind_code, int_time, serial, type AS status,
         trade_price + order_price + 100 AS pre_close_px, trade_price + order_price AS last_px, serial % 4 * 100 AS total_vol,
         (serial % 4 * (trade_price + order_price))::DOUBLE / 100 AS total_notional,
         trade_price + order_price + CASE WHEN serial % 5 = 0 THEN 0 ELSE 100000 END AS upper_limit_px,
         trade_price + order_price - CASE WHEN serial % 7 = 0 THEN 0 ELSE 100000 END AS lower_limit_px FROM raw),
eod AS (SELECT date, ticker, {", ".join(f"arg_max({c}, (int_time, serial)) AS {c}" for c in
         ("wind_code", "status", "pre_close_px", "last_px", "total_vol", "total_notional", "upper_limit_px", "lower_limit_px"))},
         arg_min(last_px, (int_time, serial)) FILTER (total_vol > 0) AS open_px,
         max(last_px) FILTER (total_vol > 0) AS high_px, min(last_px) FILTER (total_vol > 0) AS low_px
       FROM sn GROUP BY ALL)"""


@query("snapshot_quotes", f"WITH {_SNAP} SELECT * FROM eod")
def snapshot_quotes(spark, d):
    return P.quotes_from_snapshots(_snapshots(spark, d))


@query(
    "quote_projection",
    f"""WITH {_SNAP}, q AS (SELECT date, ticker AS symbol, wind_code[-2:] AS market, open_px / 10000.0::DOUBLE AS open,
          high_px / 10000.0::DOUBLE AS high, low_px / 10000.0::DOUBLE AS low, last_px / 10000.0::DOUBLE AS close,
          pre_close_px / 10000.0::DOUBLE AS pre_close, CASE WHEN total_vol > 0 THEN total_notional / total_vol END AS vwap,
          upper_limit_px / 10000.0::DOUBLE AS upper, lower_limit_px / 10000.0::DOUBLE AS lower,
          total_vol::DOUBLE AS total_vol, total_notional, total_vol <= 0 AS is_halt FROM eod)
        SELECT *, (low >= upper * 0.9995::DOUBLE AND high <= upper * 1.0005::DOUBLE)
                  OR (high <= lower * 1.0005::DOUBLE AND low >= lower * 0.9995::DOUBLE) AS limit_locked,
               false AS is_st, false AS is_new FROM q""",
)
def quote_projection(spark, d):
    return P.quote_projection(P.quotes_from_snapshots(_snapshots(spark, d)))


@query(
    "forward_returns",
    f"""WITH {FWD} SELECT date, symbol, next_date, {sql_round("fwd_ret")} AS fwd_ret FROM fwd""",
)
def forward_returns(spark, d):
    days = staged_days(spark, d)
    out = J.forward_return(days, calendar(days), "close")
    return out.select("date", "symbol", "next_date", rounded("fwd_ret").alias("fwd_ret"))


@query(
    "forward_returns_supplier_days",
    f"""WITH {LINE_DAYS} SELECT d.date, d.symbol, nc.date AS next_date,
          {sql_round("CASE WHEN n.vwap IS NOT NULL AND d.vwap > 0 THEN n.vwap / d.vwap - 1.0::DOUBLE END")} AS fwd_ret
        FROM lines d JOIN lcal c USING (date) LEFT JOIN lcal nc ON nc.calendar_index = c.calendar_index + 1
        LEFT JOIN lines n ON n.symbol = d.symbol AND n.date = nc.date""",
)
def forward_returns_supplier_days(spark, d):
    days = staged(line_days(spark, d), "lines")
    out = J.forward_return(days, calendar(days), "vwap")
    return out.select("date", "symbol", "next_date", rounded("fwd_ret").alias("fwd_ret"))


def execution(spark, d):
    days = staged_days(spark, d)
    return J.execution_panel(days, calendar(days), J.RETURN_SPECS["vwap_t1_vwap_t2"])


EXEC = f"""{DAYS},
ex AS (
  SELECT d.date, d.symbol, d.market, d.is_st AS is_st_at_signal, d.is_new AS is_new_at_signal,
         d.is_halt AS is_halt_at_signal, d.limit_locked AS limit_locked_at_signal,
         NOT (d.is_st OR d.is_new OR d.is_halt) AS eligible_at_signal,
         c.calendar_index AS signal_calendar_index, e.calendar_index AS entry_calendar_index,
         x.calendar_index AS exit_calendar_index, e.date AS entry_date, x.date AS exit_date,
         en.vwap AS entry_px, xn.vwap AS exit_px,
         coalesce(en.vwap > 0 AND NOT en.is_halt AND NOT en.limit_locked, false) AS entry_fillable,
         coalesce(xn.vwap > 0 AND NOT xn.is_halt AND NOT xn.limit_locked, false) AS exit_fillable,
         CASE WHEN en.vwap > 0 AND xn.vwap IS NOT NULL THEN xn.vwap / en.vwap - 1.0::DOUBLE END AS fwd_ret
  FROM days d JOIN cal c USING (date)
  LEFT JOIN cal e ON e.calendar_index = c.calendar_index + 1 LEFT JOIN cal x ON x.calendar_index = c.calendar_index + 2
  LEFT JOIN days en ON en.symbol = d.symbol AND en.date = e.date
  LEFT JOIN days xn ON xn.symbol = d.symbol AND xn.date = x.date)"""


@query(
    "execution_panel",
    f"""WITH {EXEC} SELECT *, 'vwap_t1_vwap_t2' AS return_spec, 1 AS entry_day_lag, 2 AS exit_day_lag,
          'vwap' AS entry_price_field, 'vwap' AS exit_price_field, 'after_close' AS signal_availability FROM ex""",
)
def execution_panel(spark, d):
    return execution(spark, d)


@query(
    "horizon_preflight",
    f"""WITH {DAYS} SELECT c.date, count(*) AS n_names, e.date AS entry_date, x.date AS exit_date,
          x.date IS NOT NULL AS complete FROM days JOIN cal c USING (date)
        LEFT JOIN cal e ON e.calendar_index = c.calendar_index + 1
        LEFT JOIN cal x ON x.calendar_index = c.calendar_index + 2 GROUP BY ALL""",
)
def horizon_preflight(spark, d):
    days = staged_days(spark, d)
    cal = calendar(days)
    width = days.groupBy("date").agg(F.count(F.lit(1)).alias("n_names"))
    out = width.join(cal.withColumnRenamed("calendar_index", "signal_calendar_index"), "date")
    for leg, lag in (("entry", 1), ("exit", 2)):
        out = out.join(J.calendar_shift(cal, lag, f"{leg}_date", f"{leg}_i"), "signal_calendar_index", "left")
    return out.select("date", "n_names", "entry_date", "exit_date", F.col("exit_date").isNotNull().alias("complete"))


_KEY_SETS = """universe AS (SELECT date, symbol FROM days),
embedding AS (SELECT date, symbol FROM days WHERE n_events > 1 OR symbol::BIGINT % 3 = 0 UNION ALL
  SELECT date, symbol FROM days WHERE symbol::BIGINT % 97 = 1 AND (date, symbol) NOT IN (SELECT (date, symbol) FROM raw WHERE type = 'T')),
receipt AS (SELECT DISTINCT date, symbol FROM raw WHERE type = 'T'),
manifest AS (SELECT DISTINCT date, symbol FROM raw WHERE type = 'T' AND trade_type <> 'C' UNION ALL SELECT date, 'X' || symbol FROM days WHERE symbol::BIGINT % 89 = 2),
horizon AS (SELECT date, symbol FROM days JOIN cal USING (date) WHERE calendar_index + 2 <= (SELECT max(calendar_index) FROM cal))"""


def _key_sets(spark, d, days):
    """Five sides that should know the same keys, with planted gaps, repeats and strangers."""
    trades = raw_rows(spark, d).where(F.col("type") == "T").select("date", "symbol", "trade_type")
    number = F.col("symbol").cast("long")
    keys = days.select("date", "symbol")
    embedded = days.where((F.col("n_events") > 1) | (number % 3 == 0)).select("date", "symbol")
    strangers = keys.where(number % 89 == 2).withColumn("symbol", F.concat(F.lit("X"), "symbol"))
    return {
        "universe": keys,
        "embedding": embedded.unionByName(keys.where(number % 97 == 1).join(trades, ["date", "symbol"], "left_anti")),
        "receipt": trades.select("date", "symbol").distinct(),
        "manifest": trades.where(F.col("trade_type") != "C").select("date", "symbol").distinct().unionByName(strangers),
        "horizon": keys.join(F.broadcast(A.exact_horizon(days, calendar(days), 2)), "date", "left_semi"),
    }


_RULES = (
    A.Rule("whole", ["universe", "embedding", "receipt", "manifest", "horizon"], passes=True),
    A.Rule("behind_calendar", ["universe"], ["horizon"]),
    A.Rule("stranger", absent=["universe"]),
    A.Rule("not_embedded", ["universe"], ["embedding"]),
    A.Rule("not_listed", ["receipt"], ["manifest"]),
    A.Rule("quiet", ["universe", "embedding"], ["receipt", "manifest"], passes=True),
)


@query(
    "key_agreement",
    f"""WITH {DAYS}, {_KEY_SETS},
        u AS (SELECT date, symbol, 0 AS i FROM universe UNION ALL SELECT date, symbol, 1 FROM embedding UNION ALL SELECT date, symbol, 2 FROM receipt
              UNION ALL SELECT date, symbol, 3 FROM manifest UNION ALL SELECT date, symbol, 4 FROM horizon),
        k AS (SELECT date, symbol, count(*) FILTER (i = 0) AS a, count(*) FILTER (i = 1) AS b, count(*) FILTER (i = 2) AS c,
                     count(*) FILTER (i = 3) AS d, count(*) FILTER (i = 4) AS e FROM u GROUP BY date, symbol),
        g AS (SELECT a > 0 AS a, b > 0 AS b, c > 0 AS c, d > 0 AS d, e > 0 AS e, count(*) AS n_keys,
                     count(*) FILTER (greatest(a, b, c, d, e) > 1) AS n_repeated FROM k GROUP BY ALL),
        s AS (SELECT *, CASE WHEN a AND b AND c AND d AND e THEN 'whole' WHEN a AND NOT e THEN 'behind_calendar' WHEN NOT a THEN 'stranger'
                WHEN NOT b THEN 'not_embedded' WHEN c AND NOT d THEN 'not_listed' WHEN NOT c AND NOT d THEN 'quiet' ELSE 'unruled' END AS status FROM g)
        SELECT (a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT)::BIGINT AS mask,
               concat_ws(',', CASE WHEN a THEN 'universe' END, CASE WHEN b THEN 'embedding' END, CASE WHEN c THEN 'receipt' END,
                         CASE WHEN d THEN 'manifest' END, CASE WHEN e THEN 'horizon' END) AS present,
               n_keys, n_repeated, status, CASE WHEN status IN ('whole', 'quiet') AND n_repeated = 0 THEN 'pass' ELSE 'fail' END AS verdict FROM s""",
)
def key_agreement(spark, d):
    """Universe, embeddings, receipt, manifest and exact horizon: which keys each combination of them knows."""
    return A.key_agreement(_key_sets(spark, d, staged_days(spark, d)), ["date", "symbol"], _RULES)


_PERIODS = (("train", "date <= '2024-01-20'", 1), ("scoring", "date > '2024-01-20'", 100))


def _preflight_sql(name, where, least):
    return f"""SELECT '{name}' AS period, unnest([
        {{'check_id': 'repeated_keys', 'bad': rep, 'worst': NULL::BIGINT}}, {{'check_id': 'lost_days', 'bad': lost, 'worst': NULL}},
        {{'check_id': 'narrow_days', 'bad': narrow, 'worst': fewest}}, {{'check_id': 'off_calendar', 'bad': 0, 'worst': NULL}},
        {{'check_id': 'cut_horizon', 'bad': cut, 'worst': NULL}}, {{'check_id': 'no_days', 'bad': CASE WHEN n = 0 THEN 1 ELSE 0 END, 'worst': NULL}}], recursive := true)
      FROM (SELECT (SELECT count(*) FROM (SELECT 1 FROM embedding WHERE {where} GROUP BY date, symbol HAVING count(*) > 1)) AS rep,
                   count(*) FILTER (kept = 0) AS lost, count(*) FILTER (kept < {least}) AS narrow, min(kept) AS fewest, count(*) AS n,
                   count(*) FILTER (calendar_index + 2 > (SELECT max(calendar_index) FROM cal)) AS cut
            FROM (SELECT e.date, count(DISTINCT u.symbol) AS kept FROM embedding e LEFT JOIN universe u ON e.date = u.date AND e.symbol = u.symbol AND NOT u.is_st
                  WHERE e.{where} GROUP BY e.date) JOIN cal USING (date))"""


@query(
    "period_preflight",
    f"""WITH {DAYS}, {_KEY_SETS.replace("universe AS (SELECT date, symbol FROM days)", "universe AS (SELECT date, symbol, is_st FROM days)")},
        p AS ({" UNION ALL ".join(_preflight_sql(*p) for p in _PERIODS)})
        SELECT period, check_id, bad::BIGINT AS bad, worst, CASE WHEN bad > 0 THEN 'fail' ELSE 'pass' END AS status FROM p""",
)
def period_preflight(spark, d):
    """Preflight of a training and a scoring period; the scoring period runs into the end of the calendar."""
    days = staged_days(spark, d)
    embedded, members, cal = _key_sets(spark, d, days)["embedding"], days.where(~F.col("is_st")), calendar(days)
    out = None
    for name, where, least in _PERIODS:
        checks = A.period_preflight(embedded.where(where), members.where(where), cal, ["date", "symbol"], 2, least)
        checks = checks.withColumn("period", F.lit(name))
        out = checks if out is None else out.unionByName(checks)
    return out


# --- factors, eligibility, labels ----------------------------------------------


@query(
    "momentum_factors",
    f"""WITH {DAYS}, f AS (SELECT date, symbol, close, open, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS pc FROM days)
        SELECT date, symbol, {sql_round("CASE WHEN open > 0 THEN close / open - 1 END")} AS factor_ret_oc,
               {sql_round("CASE WHEN pc > 0 THEN close / pc - 1 END")} AS factor_mom_1,
               {sql_round("CASE WHEN pc > 0 THEN -(close / pc - 1) END")} AS factor_rev_1 FROM f""",
)
def momentum_factors(spark, d):
    daily = staged_days(spark, d).withColumn("pre_close", F.col("open"))
    return P.momentum_factors(daily).withColumns({c: rounded(c) for c in ("factor_ret_oc", "factor_mom_1", "factor_rev_1")})


@query(
    "baseline_factor_table",
    f"""WITH {DAYS}, f AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS pc FROM days)
        SELECT f.date, f.symbol, {sql_round("CASE WHEN pc > 0 THEN close / pc - 1 END")} AS factor_mom_1,
               {sql_round("t.flow")} AS factor_trade_flow
        FROM f LEFT JOIN (SELECT date, symbol, sum(CASE bsflag WHEN 'B' THEN 1 WHEN 'S' THEN -1 ELSE 0 END)::DOUBLE
                            / count(*) AS flow FROM raw WHERE type = 'T' GROUP BY ALL) t USING (date, symbol)""",
)
def baseline_factor_table(spark, d):
    from flowmill.operators.events import signed_flow

    daily = staged_days(spark, d).withColumn("pre_close", F.col("open"))
    flow = signed_flow(raw_rows(spark, d).where(F.col("type") == "T"), ["date", "symbol"], "bsflag", "B", "S")
    out = P.combine_factors(P.momentum_factors(daily), flow.withColumnRenamed("factor_ofi", "factor_trade_flow"), ["factor_trade_flow"])
    return out.select("date", "symbol", rounded("factor_mom_1").alias("factor_mom_1"), rounded("factor_trade_flow").alias("factor_trade_flow"))


@query(
    "eligible_rows",
    f"""WITH {DAYS} SELECT date, count(*) AS n_rows FROM days
        WHERE NOT (is_st OR is_halt OR is_new OR limit_locked) GROUP BY date""",
)
def eligible_rows(spark, d):
    return P.eligible_rows(event_days(spark, d)).groupBy("date").agg(F.count(F.lit(1)).alias("n_rows"))


def _labels_sql(src, name):
    """Label arithmetic over relation ``src(date, symbol, fwd_ret, ...)``."""
    return f"""l0 AS (SELECT *, avg(fwd_ret) OVER d AS m, count(*) OVER d AS n FROM {src} WINDOW d AS (PARTITION BY date)),
l1 AS (SELECT *, fwd_ret - m AS xs FROM l0 WHERE n >= 20),
l2 AS (SELECT *, median(xs) OVER d AS med, stddev_samp(xs) OVER d AS sd,
         rank() OVER (PARTITION BY date ORDER BY fwd_ret) + (count(*) OVER (PARTITION BY date, fwd_ret) - 1) / 2.0 AS r
       FROM l1 WINDOW d AS (PARTITION BY date)),
l3 AS (SELECT *, median(abs(xs - med)) OVER (PARTITION BY date) AS mad, (r - 1) / greatest(n - 1, 1) AS label FROM l2),
{name} AS (SELECT *, least(greatest((xs - med) / CASE WHEN 1.4826 * mad > 1e-12 THEN 1.4826 * mad WHEN sd > 1e-12 THEN sd
         ELSE 1.0 END, -3.0), 3.0) AS aux, pow(greatest(label - 0.5, 0.0) / 0.5, 2) AS gain FROM l3)"""


_LABEL_OUT = ", ".join(
    f"{sql_round(e, 7)} AS {n}" for e, n in (("label", "label"), ("xs", "target_return"), ("aux", "aux_target"), ("gain", "head_gain"))
)
_LABELS = ("label", "target_return", "aux_target", "head_gain")


@query(
    "training_labels",
    f"""WITH {FWD}, src AS (SELECT * FROM fwd WHERE eligible AND fwd_ret IS NOT NULL AND isfinite(fwd_ret)),
        {_labels_sql("src", "lab")} SELECT date, symbol, {_LABEL_OUT} FROM lab""",
)
def training_labels(spark, d):
    out = P.day_labels(P.eligible_rows(staged_forward(spark, d)))
    return out.select("date", "symbol", *[rounded(c, 7).alias(c) for c in _LABELS])


def _vectors(days):
    return days.select("date", "symbol", F.col("n_events").cast("double").alias("emb_0"), F.log("close").alias("emb_1"))


@query(
    "training_features",
    f"""WITH {EXEC}, src AS (SELECT ex.*, d.n_events, d.close, d.factor_ofi FROM ex JOIN days d USING (date, symbol)
           WHERE eligible_at_signal AND fwd_ret IS NOT NULL AND symbol::BIGINT % 9 <> 4),
        {_labels_sql("src", "lab")} SELECT date, symbol, {_LABEL_OUT}, n_events::DOUBLE AS emb_0,
          {sql_round("ln(close)")} AS emb_1, factor_ofi FROM lab""",
)
def training_features(spark, d):
    days = staged_days(spark, d)
    ex = J.execution_panel(days, calendar(days), J.RETURN_SPECS["vwap_t1_vwap_t2"])
    ex = staged(ex.select("date", "symbol", "eligible_at_signal", "fwd_ret"), "exec")
    factors = days.select("date", "symbol", "factor_ofi")
    universe = days.where(F.col("symbol").cast("long") % 9 != 4)
    out = P.training_features(_vectors(days), ex, factors, universe)
    return out.withColumns({c: rounded(c, 7) for c in _LABELS}).withColumn("emb_1", rounded("emb_1"))


@query(
    "scoring_features",
    f"""WITH {DAYS}, w AS (SELECT * FROM days WHERE symbol::BIGINT % 9 <> 4)
        SELECT date, symbol, n_events::DOUBLE AS emb_0, {sql_round("ln(close)")} AS emb_1, factor_ofi FROM w
        QUALIFY count(*) OVER (PARTITION BY date) >= 5""",
)
def scoring_features(spark, d):
    days = staged_days(spark, d)
    universe = days.where(F.col("symbol").cast("long") % 9 != 4)
    out = P.scoring_features(_vectors(days), days.select("date", "symbol", "factor_ofi"), universe, 5)
    return out.withColumn("emb_1", rounded("emb_1"))


@query(
    "linear_scores",
    f"""WITH {DAYS} SELECT date, symbol, {sql_round("0.0 + n_events * 0.25 + ln(close) * (-0.5) + factor_ofi * 2.0")} AS score FROM days""",
)
def linear_scores(spark, d):
    days = staged_days(spark, d)
    feats = P.scoring_features(_vectors(days), days.select("date", "symbol", "factor_ofi"))
    return X.linear_scores(feats, ["emb_0", "emb_1", "factor_ofi"], [0.25, -0.5, 2.0]).withColumn("score", rounded("score"))


@query(
    "smoothed_scores",
    f"""WITH {DAYS} SELECT date, symbol, {sql_round("avg(factor_ofi) OVER (PARTITION BY symbol ORDER BY date ROWS 2 PRECEDING)")}
          AS smooth_score FROM days""",
)
def smoothed_scores(spark, d):
    out = P.smooth_scores(staged_days(spark, d), 3, "factor_ofi")
    return out.select("date", "symbol", rounded("smooth_score").alias("smooth_score"))


@query(
    "daily_z_scores",
    f"""WITH {DAYS} SELECT date, symbol, {sql_round("(close - avg(close) OVER d) / greatest(stddev_pop(close) OVER d, 1e-6)", 7)} AS z
        FROM days WINDOW d AS (PARTITION BY date)""",
)
def daily_z_scores(spark, d):
    return P.zscore_by_day(staged_days(spark, d), "close", "z").select("date", "symbol", rounded("z", 7).alias("z"))


# --- rank correlation ---------------------------------------------------------

# doubled ranks are integers: the sums are exact in any order
_RANK_CORR = """CASE WHEN count(*) >= 3 AND count(DISTINCT {a}) > 1 AND count(DISTINCT {b}) > 1 THEN
    (count(*)::HUGEINT * sum({a}::HUGEINT * {b}) - sum({a})::HUGEINT * sum({b}))::DOUBLE
    / (sqrt((count(*)::HUGEINT * sum({a}::HUGEINT * {a}) - sum({a})::HUGEINT * sum({a}))::DOUBLE)
     * sqrt((count(*)::HUGEINT * sum({b}::HUGEINT * {b}) - sum({b})::HUGEINT * sum({b}))::DOUBLE)) END"""

_RANKED = f"""{FWD},
ok AS (SELECT * FROM fwd WHERE eligible AND fwd_ret IS NOT NULL AND isfinite(fwd_ret)),
rk AS (SELECT *, 2 * rank() OVER (PARTITION BY date ORDER BY score) + count(*) OVER (PARTITION BY date, score) - 1 AS ra,
         2 * rank() OVER (PARTITION BY date ORDER BY fwd_ret) + count(*) OVER (PARTITION BY date, fwd_ret) - 1 AS rb FROM ok),
ics AS (SELECT date, {_RANK_CORR.format(a="ra", b="rb")} AS ic, count(*) AS n_names FROM rk GROUP BY date)"""


@query("daily_rank_ic", f"WITH {_RANKED} SELECT date, {sql_round('ic')} AS ic, n_names FROM ics")
def daily_rank_ic(spark, d):
    return X.rank_ic(staged_forward(spark, d)).withColumn("ic", rounded("ic"))


_IC_STATS = ("mean_ic", "std_ic", "icir", "positive_rate", "naive_t", "newey_west_t")


@query(
    "ic_statistics",
    f"""WITH {_RANKED}, s AS (SELECT ic, row_number() OVER (ORDER BY date) AS i FROM ics WHERE ic IS NOT NULL),
        b AS (SELECT count(*) AS n, avg(ic) AS m, stddev_samp(ic) AS sd, avg((ic > 0)::INT) AS pr, var_pop(ic) AS g0,
                greatest(floor(4 * pow(count(*) / 100.0, 2.0 / 9.0)), 0)::INT AS lag FROM s),
        g AS (SELECT sum(2.0 * (1.0 - (y.i - x.i)::DOUBLE / (b.lag + 1)) * (x.ic - b.m) * (y.ic - b.m) / b.n) AS x
              FROM s x JOIN s y ON y.i > x.i JOIN b ON y.i - x.i <= b.lag)
        SELECT n AS n_periods, {sql_round("m", 7)} AS mean_ic, {sql_round("sd", 7)} AS std_ic, {sql_round("m / sd", 7)} AS icir,
               {sql_round("pr", 7)} AS positive_rate, {sql_round("m / (sd / sqrt(n))", 7)} AS naive_t,
               {sql_round("m / sqrt(greatest(g0 + coalesce(g.x, 0), 0) / n)", 7)} AS newey_west_t, lag AS hac_lags FROM b, g""",
)
def ic_statistics(spark, d):
    ics = staged(X.rank_ic(staged_forward(spark, d)), "ics")
    return X.ic_statistics(ics).withColumns({c: rounded(c, 7) for c in _IC_STATS})


@query(
    "ic_bootstrap_interval",
    f"""WITH {_RANKED}, s AS (SELECT ic, row_number() OVER (ORDER BY date) - 1 AS i FROM ics WHERE ic IS NOT NULL),
        p AS (SELECT count(*) AS n, least(5, count(*)) AS size FROM s),
        dr AS (SELECT draw, slot, ('0x' || substr(md5('42|' || draw || '|' || slot), 1, 8))::BIGINT % (n - size + 1) AS st, n, size
               FROM p, range(2000) t(draw), range(1000) u(slot) WHERE slot < ceil(n / size::DOUBLE)),
        pk AS (SELECT draw, st + k AS i FROM dr, range(5) v(k) WHERE k < size AND slot * size + k < n),
        ms AS (SELECT draw, avg(ic) AS m FROM pk JOIN s USING (i) GROUP BY draw)
        SELECT {sql_round("quantile_cont(m, 0.025)", 7)} AS low, {sql_round("quantile_cont(m, 0.975)", 7)} AS high FROM ms""",
)
def ic_bootstrap_interval(spark, d):
    ics = staged(X.rank_ic(staged_forward(spark, d)), "ics").withColumnRenamed("date", "i")
    return X.block_bootstrap(ics, "ic").select(rounded("low", 7).alias("low"), rounded("high", 7).alias("high"))


@query(
    "quantile_returns",
    f"""WITH {FWD}, o AS (SELECT date, fwd_ret, row_number() OVER (PARTITION BY date ORDER BY score, symbol::BIGINT) AS r,
             count(*) OVER (PARTITION BY date) AS n FROM fwd WHERE eligible AND fwd_ret IS NOT NULL)
        SELECT date, least((r - 1) * 5 // n, 4)::INT AS "group", count(*) AS n_names, {sql_round("avg(fwd_ret)")} AS mean_return
        FROM o GROUP BY ALL""",
)
def quantile_returns(spark, d):
    out = X.quantile_returns(staged_forward(spark, d), 5)
    return out.select("date", "group", "n_names", rounded("mean_return").alias("mean_return"))


@query(
    "group_monotonicity",
    f"""WITH {FWD}, o AS (SELECT fwd_ret, row_number() OVER (PARTITION BY date ORDER BY score, symbol::BIGINT) AS r,
             count(*) OVER (PARTITION BY date) AS n FROM fwd)
        SELECT least((r - 1) * 5 // n, 4)::INT AS "group", {sql_round("avg(fwd_ret)")} AS ret FROM o GROUP BY ALL""",
)
def group_monotonicity(spark, d):
    by_day = X.quantile_returns(staged_forward(spark, d), 5, only_eligible=False)
    return X.group_means(by_day).withColumn("ret", rounded("ret"))


@query(
    "correlation_gate",
    f"""WITH {FWD}, c AS (SELECT corr(score, fwd_ret) AS fwd_ret, corr(score, close) AS close,
            corr(score, n_events) AS n_events FROM fwd)
        SELECT {sql_round("fwd_ret")} AS fwd_ret, {sql_round("close")} AS close, {sql_round("n_events")} AS n_events,
               {sql_round("greatest(abs(fwd_ret), abs(close), abs(n_events))")} AS max_abs_corr,
               greatest(abs(fwd_ret), abs(close), abs(n_events)) <= 0.7 AS passed FROM c""",
)
def correlation_gate(spark, d):
    cols = ["fwd_ret", "close", "n_events"]
    return X.correlation_gate(staged_forward(spark, d), "score", cols).withColumns({c: rounded(c) for c in (*cols, "max_abs_corr")})


@query("deflated_sharpe")
def deflated_sharpe(spark, d):
    daily = staged(X.topk_daily(staged_forward(spark, d), [5, 10, 20], [0.0, 15.0]), "topk")
    trials = daily.groupBy("top_k", "cost_bps").agg((F.avg("ret") / F.stddev_samp("ret")).alias("sharpe"))
    best = daily.where((F.col("top_k") == 10) & (F.col("cost_bps") == 0.0))
    return X.deflated_sharpe(best, "ret", trials, "sharpe").withColumns({c: rounded(c) for c in ("sharpe", "dsr")})


@query(
    "score_distribution",
    f"""WITH {DAYS} SELECT date, count(*) AS rows, count(DISTINCT factor_ofi) AS unique_scores, {sql_round("avg(factor_ofi)")} AS mean,
          {sql_round("stddev_pop(factor_ofi)")} AS std, min(factor_ofi) AS min, max(factor_ofi) AS max,
          {", ".join(f"list_extract(list(factor_ofi ORDER BY factor_ofi), round_even((count(*) - 1) * {q}::DOUBLE, 0)::INT + 1) AS {n}"
                     for q, n in ((0.01, "p01"), (0.25, "p25"), (0.75, "p75"), (0.99, "p99")))},
          {sql_round("quantile_cont(factor_ofi, 0.5)")} AS p50, {sql_round("count(DISTINCT factor_ofi)::DOUBLE / count(*)")} AS unique_ratio,
          count(DISTINCT factor_ofi) <= 1 OR stddev_pop(factor_ofi) <= 1e-12 AS constant FROM days GROUP BY date""",
)
def score_distribution(spark, d):
    out = X.score_distribution(staged_days(spark, d).select("date", F.col("factor_ofi").alias("score")))
    return out.withColumns({c: rounded(c) for c in ("mean", "std", "p50", "unique_ratio")})


@query(
    "cross_section_width",
    f"""WITH {LINE_DAYS}, c AS (SELECT date, count(*) AS n FROM lines GROUP BY date)
        SELECT sum(n)::BIGINT AS rows, count(*) AS days, min(date) AS date_min, max(date) AS date_max, min(n) AS names_min,
               median(n) AS names_median, max(n) AS names_max FROM c""",
)
def cross_section_width(spark, d):
    return X.width_stats(line_days(spark, d))


# --- portfolios ---------------------------------------------------------------


def _topk_sql(ks, costs):
    return f"""{FWD},
un AS (SELECT date, symbol, score, fwd_ret FROM fwd WHERE NOT limit_locked),
dd AS (SELECT date, row_number() OVER (ORDER BY date) AS d FROM (SELECT DISTINCT date FROM un)),
rr AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) AS r FROM un JOIN dd USING (date)),
ks AS (SELECT unnest({list(ks)}) AS top_k), cs AS (SELECT unnest({[float(c) for c in costs]}::DOUBLE[]) AS cost_bps),
mem AS (SELECT top_k, d, date, symbol, fwd_ret FROM rr JOIN ks ON r <= top_k),
gr AS (SELECT top_k, d, date, coalesce(avg(fwd_ret), 0) AS gross FROM mem GROUP BY ALL),
ch AS (SELECT top_k, d, count(*) FILTER (a IS NULL OR b IS NULL) AS changed FROM
        (SELECT top_k, d, symbol, 1 AS a FROM mem) x FULL JOIN (SELECT top_k, d + 1 AS d, symbol, 1 AS b FROM mem) y
        USING (top_k, d, symbol) GROUP BY ALL),
td AS (SELECT top_k, cost_bps, date, d, gross, changed / (2.0::DOUBLE * top_k) AS turnover,
         gross - changed / (2.0::DOUBLE * top_k) * cost_bps / 1e4 AS ret FROM gr JOIN ch USING (top_k, d), cs),
eq AS (SELECT *, product(1 + ret) OVER w AS equity FROM td
       WINDOW w AS (PARTITION BY top_k, cost_bps ORDER BY date ROWS UNBOUNDED PRECEDING)),
pk AS (SELECT *, max(equity) OVER (PARTITION BY top_k, cost_bps ORDER BY date ROWS UNBOUNDED PRECEDING) AS peak FROM eq)"""


_SUMMARY = """SELECT top_k, cost_bps, count(*) AS n_days, avg(ret) AS mean_daily_return, stddev_samp(ret) AS daily_vol,
  avg((ret > 0)::INT) AS hit_rate, min(equity / peak - 1) AS max_drawdown, arg_max(equity, date) AS e, avg(turnover) AS mean_turnover
  FROM pk GROUP BY ALL"""
_SUM_OUT = f"""top_k, cost_bps, n_days, {sql_round("mean_daily_return")} AS mean_daily_return, {sql_round("daily_vol")} AS daily_vol,
  {sql_round("hit_rate")} AS hit_rate, {sql_round("max_drawdown")} AS max_drawdown, {sql_round("mean_turnover")} AS mean_turnover,
  {sql_round("CASE WHEN daily_vol > 0 THEN mean_daily_return / daily_vol ELSE 0 END")} AS sharpe_daily,
  round(e - 1, 6) AS cum_return, n_days >= 20 AS reliable,
  {sql_round("CASE WHEN n_days >= 20 AND daily_vol > 0 THEN mean_daily_return / daily_vol * sqrt(244.0) END", 6)} AS sharpe,
  {sql_round("CASE WHEN n_days >= 20 AND daily_vol > 0 THEN pow(e, 244.0 / n_days) - 1 END", 6)} AS ann_return"""


def _summary_out(df):
    return df.withColumns({
        **{c: rounded(c) for c in ("mean_daily_return", "daily_vol", "hit_rate", "max_drawdown", "mean_turnover", "sharpe_daily")},
        "cum_return": rounded("cum_return", 6), "sharpe": rounded("sharpe", 6), "ann_return": rounded("ann_return", 6),
    })


@query(
    "topk_daily_returns",
    f"""WITH {_topk_sql([10], [15])} SELECT top_k, cost_bps, date, d::INT AS d, {sql_round("gross")} AS gross,
          {sql_round("turnover")} AS turnover, {sql_round("ret")} AS ret FROM td""",
)
def topk_daily_returns(spark, d):
    out = X.topk_daily(staged_forward(spark, d), [10])
    return out.withColumns({c: rounded(c) for c in ("gross", "turnover", "ret")})


@query(
    "topk_long_short",
    f"""WITH {FWD},
      un AS (SELECT date, symbol, score, fwd_ret FROM fwd WHERE NOT limit_locked),
      dd AS (SELECT date, row_number() OVER (ORDER BY date) AS d FROM (SELECT DISTINCT date FROM un)),
      rr AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) AS r,
               row_number() OVER (PARTITION BY date ORDER BY score, symbol DESC) AS q FROM un JOIN dd USING (date)),
      mem AS (SELECT 'l' AS side, d, date, symbol, fwd_ret FROM rr WHERE r <= 10
              UNION ALL SELECT 's', d, date, symbol, fwd_ret FROM rr WHERE q <= 10),
      g AS (SELECT d, date, coalesce(avg(fwd_ret) FILTER (side = 'l'), 0) AS l, coalesce(avg(fwd_ret) FILTER (side = 's'), 0) AS s
            FROM mem GROUP BY ALL),
      ch AS (SELECT d, count(*) FILTER (a IS NULL OR b IS NULL) AS changed FROM
              (SELECT side, d, symbol, 1 AS a FROM mem) x FULL JOIN (SELECT side, d + 1 AS d, symbol, 1 AS b FROM mem) y
              USING (side, d, symbol) GROUP BY ALL)
      SELECT date, {sql_round("0.5 * (l - s)")} AS gross, {sql_round("changed / 20.0::DOUBLE")} AS turnover,
             {sql_round("0.5 * (l - s) - changed / 20.0::DOUBLE * 15.0 / 1e4")} AS ret FROM g JOIN ch USING (d)""",
)
def topk_long_short(spark, d):
    out = X.topk_daily(staged_forward(spark, d), [10], long_short=True)
    return out.select("date", *[rounded(c).alias(c) for c in ("gross", "turnover", "ret")])


@query("topk_grid", f"WITH {_topk_sql([5, 10, 20], [0, 15, 30])}, sm AS ({_SUMMARY}) SELECT {_SUM_OUT} FROM sm")
def topk_grid(spark, d):
    daily = staged(X.topk_daily(staged_forward(spark, d), [5, 10, 20], [0.0, 15.0, 30.0]), "grid")
    turn = daily.groupBy("top_k", "cost_bps").agg(F.avg("turnover").alias("mean_turnover"))
    return _summary_out(X.return_summary(daily, ["top_k", "cost_bps"], min_days=20).join(turn, ["top_k", "cost_bps"]))


_GRID = f"""{FWD},
di AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS d FROM (SELECT DISTINCT date FROM fwd)),
pts AS (SELECT d, symbol, round(score * 1000000)::BIGINT AS score, fwd_ret FROM fwd JOIN di USING (date)),
sw AS (SELECT w AS smoothing, a.d, a.symbol, (SELECT sum(b.score)::DOUBLE / count(b.score) FROM pts b WHERE b.symbol = a.symbol AND b.d BETWEEN a.d - w + 1 AND a.d) AS m
       FROM pts a, (VALUES (1), (3), (5)) v(w)),
rk AS (SELECT *, row_number() OVER (PARTITION BY smoothing, d ORDER BY m DESC, symbol) AS rank FROM sw WHERE m IS NOT NULL),
policy AS (SELECT k, h FROM (VALUES (5), (10), (20)) a(k), (VALUES (1), (2), (5)) b(h)),
held AS (SELECT k, h, smoothing, x.d, symbol FROM policy, di x, rk WHERE rk.d = x.d // h * h AND rank <= k),
gr AS (SELECT k, h, smoothing, d, sum(coalesce(fwd_ret, 0)) / count(*) AS gross FROM held LEFT JOIN pts USING (d, symbol) GROUP BY ALL),
mv AS (SELECT k, h, smoothing, d, count(*) FILTER (a OR b) AS changed FROM (
         SELECT coalesce(n.k, p.k) AS k, coalesce(n.h, p.h) AS h, coalesce(n.smoothing, p.smoothing) AS smoothing, coalesce(n.d, p.d) AS d, p.symbol IS NULL AS a, n.symbol IS NULL AS b
         FROM (SELECT * FROM held WHERE d % h = 0) n FULL JOIN (SELECT k, h, smoothing, d + h AS d, symbol FROM held WHERE d % h = 0) p
           ON n.k = p.k AND n.h = p.h AND n.smoothing = p.smoothing AND n.d = p.d AND n.symbol = p.symbol) GROUP BY ALL),
pd AS (SELECT k, h, smoothing, d, cost, coalesce(changed / (2.0 * k), 0)::DOUBLE AS turnover, gross - coalesce(changed / (2.0 * k), 0)::DOUBLE * cost / 10000 AS ret
       FROM gr LEFT JOIN mv USING (k, h, smoothing, d), (VALUES (0.0::DOUBLE), (15.0::DOUBLE)) c(cost))"""


@query(
    "policy_grid",
    f"""WITH {_GRID} SELECT k::INT AS top_k, h::INT AS interval, smoothing::INT AS smoothing, cost AS cost_bps, count(*) AS n_days, {sql_round("avg(turnover)")} AS mean_turnover,
          {sql_round("avg(ret)")} AS mean_daily_return, {sql_round("stddev_samp(ret)")} AS daily_vol, {sql_round("product(1 + ret) - 1", 6)} AS cum_return
        FROM pd GROUP BY k, h, smoothing, cost""",
)
def policy_grid(spark, d):
    """Three ranks, three rebalance intervals, three smoothing windows and two costs."""
    rows = staged_forward(spark, d).withColumn("score", F.round(F.col("score") * 1_000_000).cast("long"))
    keys = ["top_k", "interval", "smoothing", "cost_bps"]
    daily = staged(X.policy_grid(rows, [5, 10, 20], [1, 2, 5], [1, 3, 5], [0.0, 15.0]), "grid")
    turn = daily.groupBy(*keys).agg(F.avg("turnover").alias("mean_turnover"))
    out = X.return_summary(daily, keys, min_days=20).join(turn, keys)
    return out.select(
        *keys, "n_days", rounded("mean_turnover").alias("mean_turnover"), rounded("mean_daily_return").alias("mean_daily_return"),
        rounded("daily_vol").alias("daily_vol"), rounded("cum_return", 6).alias("cum_return"),
    )


@query(
    "equity_curve",
    f"""WITH {_topk_sql([10], [15])} SELECT date, {sql_round("equity", 6)} AS equity, {sql_round("peak", 6)} AS peak,
          {sql_round("equity / peak - 1", 6)} AS drawdown FROM pk""",
)
def equity_curve(spark, d):
    daily = X.topk_daily(staged_forward(spark, d), [10])
    out = X.equity_curve(daily, ["top_k"])
    return out.select("date", *[rounded(c, 6).alias(c) for c in ("equity", "peak", "drawdown")])


@query(
    "eligible_benchmark",
    f"WITH {FWD} SELECT date, {sql_round('avg(fwd_ret)')} AS benchmark_return FROM fwd WHERE eligible AND fwd_ret IS NOT NULL GROUP BY date",
)
def eligible_benchmark(spark, d):
    return X.eligible_benchmark(forward(spark, d)).withColumn("benchmark_return", rounded("benchmark_return"))


@query(
    "active_returns",
    f"""WITH {_topk_sql([10], [15])}, bm AS (SELECT date, avg(fwd_ret) AS b FROM fwd WHERE eligible AND fwd_ret IS NOT NULL GROUP BY date)
        SELECT date, {sql_round("ret")} AS ret, {sql_round("b")} AS benchmark_return, {sql_round("ret - b")} AS active_return
        FROM td LEFT JOIN bm USING (date)""",
)
def active_returns(spark, d):
    df = staged_forward(spark, d)
    out = X.active_returns(X.topk_daily(df, [10]), X.eligible_benchmark(df))
    return out.select("date", *[rounded(c).alias(c) for c in ("ret", "benchmark_return", "active_return")])


@query(
    "head_ranking_metrics",
    f"""WITH {FWD}, g AS (SELECT date, symbol, score, fwd_ret, count(*) OVER (PARTITION BY date) AS n,
             pow(greatest(((rank() OVER (PARTITION BY date ORDER BY fwd_ret) + (count(*) OVER (PARTITION BY date, fwd_ret) - 1) / 2.0
               - 1) / greatest(count(*) OVER (PARTITION BY date) - 1, 1) - 0.5) / 0.5, 0), 2) AS gain
           FROM fwd WHERE eligible AND fwd_ret IS NOT NULL),
         r AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) AS a,
                 row_number() OVER (PARTITION BY date ORDER BY gain DESC, symbol) AS b FROM g),
         k AS (SELECT unnest([10, 30]) AS cutoff),
         m AS (SELECT date, cutoff, sum(gain / log2(a + 1)) FILTER (a <= cutoff) AS dcg, sum(gain / log2(b + 1)) FILTER (b <= cutoff) AS idcg,
                 avg(fwd_ret) FILTER (a <= cutoff) AS t, avg(fwd_ret) AS m FROM r, k GROUP BY ALL)
        SELECT date, cutoff, {sql_round("CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END", 7)} AS ndcg,
               {sql_round("(t - m) * 1e4", 3)} AS top_excess_bps FROM m""",
)
def head_ranking_metrics(spark, d):
    df = P.eligible_rows(staged_forward(spark, d)).where(is_finite("fwd_ret"))
    out = X.head_metrics(df, [10, 30])
    return out.withColumns({"ndcg": rounded("ndcg", 7), "top_excess_bps": rounded("top_excess_bps", 3)})


@query(
    "adjacent_day_turnover",
    f"""WITH {FWD}, dd AS (SELECT date, row_number() OVER (ORDER BY date) AS d FROM (SELECT DISTINCT date FROM fwd)),
         p AS (SELECT d, date, symbol, (rank() OVER (PARTITION BY date ORDER BY score DESC)
                 + (count(*) OVER (PARTITION BY date, score) - 1) / 2.0) / count(*) OVER (PARTITION BY date) AS pct,
                 row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) AS r FROM fwd JOIN dd USING (date))
        SELECT a.date, {sql_round("(SELECT avg(abs(x.pct - y.pct)) FROM p x JOIN p y ON x.symbol = y.symbol WHERE x.d = a.d AND y.d = a.d - 1)")}
                 AS mean_rank_change,
               {sql_round("(SELECT count(*) FROM p x JOIN p y ON x.symbol = y.symbol WHERE x.d = a.d AND y.d = a.d - 1)::DOUBLE / (SELECT count(*) FROM p x WHERE x.d = a.d - 1)")}
                 AS common_coverage,
               {sql_round("1 - (SELECT count(*) FROM p x JOIN p y ON x.symbol = y.symbol WHERE x.d = a.d AND y.d = a.d - 1 AND x.r <= 10 AND y.r <= 10)::DOUBLE / (SELECT count(*) FROM p x WHERE x.d = a.d - 1 AND x.r <= 10)")}
                 AS top_k_turnover
        FROM dd a WHERE a.d > 1""",
)
def adjacent_day_turnover(spark, d):
    out = X.adjacent_turnover(staged_forward(spark, d), 10)
    return out.withColumns({c: rounded(c) for c in ("mean_rank_change", "common_coverage", "top_k_turnover")})


def _holdings(spark, d):
    top = X.top_members(staged_forward(spark, d), [10])
    return top.select("date", "symbol", F.lit(0.1).alias("weight"), "fwd_ret")


_HOLD = f"""{FWD}, hold AS (SELECT date, symbol, 0.1::DOUBLE AS weight, fwd_ret FROM fwd
  QUALIFY row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) <= 10)"""


_LEDGER = f"""{_HOLD}, dd AS (SELECT date, row_number() OVER (ORDER BY date) AS d FROM (SELECT DISTINCT date FROM hold)),
         h AS (SELECT * FROM hold JOIN dd USING (date)),
         f AS (SELECT d, weight, old, fwd_ret, a, b FROM (SELECT *, 1 AS a FROM h) x
               FULL JOIN (SELECT d + 1 AS d, symbol, weight AS old, 1 AS b FROM h) y USING (d, symbol) WHERE d IN (SELECT d FROM dd)),
         g AS (SELECT d, coalesce(sum(weight * coalesce(fwd_ret, 0)), 0) AS gross, count(a) AS n,
                 coalesce(sum(weight) FILTER (b IS NULL), 0) AS bn, coalesce(sum(old) FILTER (a IS NULL), 0) AS sn, coalesce(sum(weight), 0) AS w
               FROM f GROUP BY d),
         c AS (SELECT *, (bn * 10 + sn * 15) / 1e4 AS cost FROM g)"""


@query(
    "holdings_ledger",
    f"""WITH {_LEDGER}
        SELECT date, n AS n_holdings, {sql_round("gross")} AS gross_return, {sql_round("bn")} AS buy_notional, {sql_round("sn")} AS sell_notional,
               {sql_round("cost")} AS cost, {sql_round("gross - cost")} AS net_return, {sql_round("0.5 * (bn + sn)")} AS turnover,
               {sql_round("greatest(1 - w, 0)")} AS cash_weight,
               {sql_round("product(1 + gross - cost) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING)", 6)} AS nav FROM c JOIN dd USING (d)""",
)
def holdings_ledger(spark, d):
    out = X.ledger(staged(_holdings(spark, d), "hold"), 10.0, 10.0, 5.0)
    cols = ("gross_return", "buy_notional", "sell_notional", "cost", "net_return", "turnover", "cash_weight")
    return out.withColumns({**{c: rounded(c) for c in cols}, "nav": rounded("nav", 6)})


@query(
    "ledger_summary",
    f"""WITH {_LEDGER}, v AS (SELECT d, gross - cost AS r, cost, 0.5 * (bn + sn) AS turn, product(1 + gross - cost) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING) AS nav FROM c),
          k AS (SELECT *, nav / max(nav) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING) - 1 AS dr FROM v)
        SELECT count(*) AS n_days, {sql_round("arg_max(nav, d) - 1", 6)} AS cum_return, {sql_round("avg(r)")} AS mean_daily_return, {sql_round("stddev_samp(r)")} AS daily_vol,
               {sql_round("min(dr)", 6)} AS max_drawdown, {sql_round("avg(turn)")} AS mean_turnover, {sql_round("sum(cost)", 6)} AS total_cost,
               {sql_round("avg(r) / stddev_samp(r) * sqrt(244.0)", 6)} AS sharpe FROM k""",
)
def ledger_summary(spark, d):
    daily = X.ledger(staged(_holdings(spark, d), "hold"), 10.0, 10.0, 5.0)
    digits = {"cum_return": 6, "mean_daily_return": 8, "daily_vol": 8, "max_drawdown": 6, "mean_turnover": 8, "total_cost": 6, "sharpe": 6}
    return X.ledger_summary(daily).withColumns({c: rounded(c, n) for c, n in digits.items()})


@query(
    "portfolio_exposures",
    f"""WITH {_HOLD} SELECT h.date, {sql_round("sum(d.close * weight) / sum(CASE WHEN d.close IS NOT NULL THEN weight ELSE 0 END)", 6)} AS close,
          {sql_round("sum(f.factor_mom * weight) / nullif(sum(CASE WHEN f.factor_mom IS NOT NULL THEN weight ELSE 0 END), 0)", 6)} AS factor_mom
        FROM hold h LEFT JOIN days d USING (date, symbol)
        LEFT JOIN (SELECT date, symbol, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS factor_mom FROM days) f
          USING (date, symbol) GROUP BY h.date""",
)
def portfolio_exposures(spark, d):
    days = staged_days(spark, d)
    mom = P.momentum_factors(days.withColumn("pre_close", F.col("open"))).select("date", "symbol", F.col("factor_mom_1").alias("factor_mom"))
    factors = days.select("date", "symbol", "close").join(mom, ["date", "symbol"])
    out = X.portfolio_exposures(_holdings(spark, d), factors, ["close", "factor_mom"])
    return out.withColumns({c: rounded(c, 6) for c in ("close", "factor_mom")})


@query(
    "neutralised_returns",
    f"""WITH {FWD}, o AS (SELECT * FROM fwd WHERE fwd_ret IS NOT NULL),
         b AS (SELECT date, regr_slope(fwd_ret, close) AS s, regr_intercept(fwd_ret, close) AS i FROM o GROUP BY date HAVING count(*) > 2)
        SELECT date, symbol, {sql_round("fwd_ret - i - s * close", 7)} AS neutralized_ret FROM o JOIN b USING (date)""",
)
def neutralised_returns(spark, d):
    return X.residualise(staged_forward(spark, d), ["close"]).withColumn("neutralized_ret", rounded("neutralized_ret", 7))


@query(
    "neutralised_returns_two_factors",
    f"""WITH {FWD}, o AS (SELECT date, symbol, fwd_ret AS y, ln(close) AS a, n_events::DOUBLE AS b FROM fwd WHERE fwd_ret IS NOT NULL),
         c AS (SELECT *, y - avg(y) OVER w AS cy, a - avg(a) OVER w AS ca, b - avg(b) OVER w AS cb, count(*) OVER w AS n FROM o
               WINDOW w AS (PARTITION BY date)),
         s AS (SELECT date, sum(ca * ca) AS aa, sum(ca * cb) AS ab, sum(cb * cb) AS bb, sum(ca * cy) AS ay, sum(cb * cy) AS by_ FROM c
               WHERE n > 3 GROUP BY date),
         k AS (SELECT date, (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS ka, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS kb FROM s)
        SELECT date, symbol, {sql_round("cy - ka * ca - kb * cb", 6)} AS neutralized_ret FROM c JOIN k USING (date)""",
)
def neutralised_returns_two_factors(spark, d):
    df = staged_forward(spark, d).withColumns({"a": F.log("close"), "b": F.col("n_events").cast("double")})
    return X.residualise(df, ["a", "b"]).withColumn("neutralized_ret", rounded("neutralized_ret", 6))


@query(
    "stylised_facts",
    f"""WITH {FWD}, o AS (SELECT symbol, date, fwd_ret AS r, count(*) OVER s AS n, avg(fwd_ret) OVER s AS m FROM fwd
             WHERE fwd_ret IS NOT NULL WINDOW s AS (PARTITION BY symbol)),
         a AS (SELECT symbol, date, n, r - m AS c, abs(r - m) AS a FROM o WHERE n >= 7),
         z AS (SELECT symbol, n, c, a - avg(a) OVER (PARTITION BY symbol) AS a,
                 row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM a),
         l AS (SELECT x.symbol, sum(x.a * y.a) AS num FROM z x JOIN z y ON x.symbol = y.symbol AND y.i - x.i BETWEEN 1 AND 5 GROUP BY 1)
        SELECT s.symbol, s.n_rows, k.* EXCLUDE (symbol) FROM (SELECT symbol, count(fwd_ret) AS n_rows FROM fwd GROUP BY 1) s LEFT JOIN
          (SELECT z.symbol, {sql_round("avg(pow(c, 4)) / pow(avg(c * c), 2) - 3", 6)} AS excess_kurtosis,
               {sql_round("any_value(num) / (sum(a * a) * 5)", 7)} AS vol_clustering_acf FROM z JOIN l USING (symbol) GROUP BY 1) k USING (symbol)""",
)
def stylised_facts(spark, d):
    df = staged_forward(spark, d).withColumn("i", F.unix_date(F.to_date("date")))
    out = X.stylised_facts(df, ["symbol"], ["i"], "fwd_ret", 5)
    return out.withColumns({"excess_kurtosis": rounded("excess_kurtosis", 6), "vol_clustering_acf": rounded("vol_clustering_acf", 7)})


@query(
    "score_key_coverage",
    f"""WITH {FWD} SELECT (SELECT count(*) FROM fwd WHERE symbol::BIGINT % 3 <> 0) AS n_scores,
          (SELECT count(*) FROM fwd WHERE symbol::BIGINT % 3 <> 0 AND fwd_ret IS NOT NULL) AS n_covered,
          (SELECT count(*) FROM fwd WHERE symbol::BIGINT % 3 <> 0 AND fwd_ret IS NULL) = 0 AS complete""",
)
def score_key_coverage(spark, d):
    df = staged_forward(spark, d)
    return X.full_coverage(df.where(F.col("symbol_id") % 3 != 0), df.where(F.col("fwd_ret").isNotNull()))


@query(
    "supplier_rank_ic",
    f"""WITH {LINE_DAYS}, f AS (SELECT d.date, d.score, CASE WHEN d.vwap > 0 THEN n.vwap / d.vwap - 1.0::DOUBLE END AS y
             FROM lines d JOIN lcal c USING (date) JOIN lcal nc ON nc.calendar_index = c.calendar_index + 1
             JOIN lines n ON n.symbol = d.symbol AND n.date = nc.date),
         r AS (SELECT date, 2 * rank() OVER (PARTITION BY date ORDER BY score) + count(*) OVER (PARTITION BY date, score) - 1 AS a,
                 2 * rank() OVER (PARTITION BY date ORDER BY y) + count(*) OVER (PARTITION BY date, y) - 1 AS b FROM f)
        SELECT date, {sql_round(_RANK_CORR.format(a="a", b="b"), 7)} AS ic,
               count(*) AS n_names FROM r GROUP BY date""",
)
def supplier_rank_ic(spark, d):
    days = staged(line_days(spark, d), "lines")
    df = staged(J.forward_return(days, calendar(days), "vwap").select("date", "score", "fwd_ret"), "fwd")
    return X.rank_ic(df).withColumn("ic", rounded("ic", 7))


# --- the evaluation set -------------------------------------------------------

_EVALUATED = f"""{_topk_sql([5, 10, 20], [0, 15, 30])}{_RANKED[len(FWD):]},
sm AS ({_SUMMARY}),
qo AS (SELECT date, fwd_ret, row_number() OVER (PARTITION BY date ORDER BY score, symbol::BIGINT) AS r, count(*) OVER (PARTITION BY date) AS n
       FROM fwd WHERE eligible AND fwd_ret IS NOT NULL),
qr AS (SELECT date, least((r - 1) * 5 // n, 4) AS g, avg(fwd_ret) AS m FROM qo GROUP BY ALL),
hg AS (SELECT date, symbol, score, fwd_ret, pow(greatest(((rank() OVER (PARTITION BY date ORDER BY fwd_ret) + (count(*) OVER (PARTITION BY date, fwd_ret) - 1) / 2.0
         - 1) / greatest(count(*) OVER (PARTITION BY date) - 1, 1) - 0.5) / 0.5, 0), 2) AS gain FROM fwd WHERE eligible AND fwd_ret IS NOT NULL),
hr AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) AS a, row_number() OVER (PARTITION BY date ORDER BY gain DESC, symbol) AS b FROM hg),
hm AS (SELECT date, cutoff, sum(gain / log2(a + 1)) FILTER (a <= cutoff) AS dcg, sum(gain / log2(b + 1)) FILTER (b <= cutoff) AS idcg,
         avg(fwd_ret) FILTER (a <= cutoff) - avg(fwd_ret) AS excess FROM hr, (SELECT unnest([10, 30]) AS cutoff) GROUP BY ALL),
hd AS (SELECT cutoff, CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END AS ndcg, excess * 1e4 AS bps FROM hm),
bm AS (SELECT date, avg(fwd_ret) AS b FROM fwd WHERE eligible AND fwd_ret IS NOT NULL GROUP BY date),
pd AS (SELECT td.*, b, ret - b AS active FROM td LEFT JOIN bm USING (date) WHERE top_k = 10 AND cost_bps = 15),
ho AS (SELECT date, d, symbol, 1.0::DOUBLE / count(*) OVER (PARTITION BY date) AS w FROM mem WHERE top_k = 10),
tr AS (SELECT coalesce(x.w, 0) - coalesce(y.w, 0) AS change FROM ho x FULL JOIN (SELECT d + 1 AS d, symbol, w FROM ho) y ON x.d = y.d AND x.symbol = y.symbol
       WHERE coalesce(x.w, 0) <> coalesce(y.w, 0) AND coalesce(x.d, y.d) <= (SELECT max(d) FROM ho))"""


def _evaluation(spark, d):
    path = new_path(spark, "evaluation")
    df = staged_forward(spark, d)
    EV.write_evaluation(df, path, [5, 10, 20], groups=5)
    return EV.read_evaluation(spark, path)


@query(
    "evaluation_contents",
    f"""WITH {_EVALUATED}, t AS (
          SELECT 'daily_ic' AS name, count(*) AS n_rows, sum(ic) AS total FROM ics UNION ALL SELECT 'quantile_returns', count(*), sum(m) FROM qr
          UNION ALL SELECT 'daily_head_metrics', count(*), sum(ndcg) FROM hd UNION ALL SELECT 'topk_grid', count(*), sum(mean_daily_return) FROM sm
          UNION ALL SELECT 'benchmark_daily', count(*), sum(b) FROM bm UNION ALL SELECT 'portfolio_daily', count(*), sum(active) FROM pd
          UNION ALL SELECT 'holdings', count(*), sum(w) FROM ho UNION ALL SELECT 'trades', count(*), sum(abs(change)) FROM tr)
        SELECT name, n_rows, {sql_round("total", 6)} AS total FROM t""",
)
def evaluation_contents(spark, d):
    """Rows of each table of the written evaluation, and the sum of a column of it."""
    back = _evaluation(spark, d)
    sums = {
        "daily_ic": F.col("ic"), "quantile_returns": F.col("mean_return"), "daily_head_metrics": F.col("ndcg"), "topk_grid": F.col("mean_daily_return"),
        "benchmark_daily": F.col("benchmark_return"), "portfolio_daily": F.col("active_return"), "holdings": F.col("weight"), "trades": F.abs("change"),
    }
    parts = [back[n].agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n_rows"), rounded(F.sum(c), 6).alias("total")) for n, c in sums.items()]
    return io.union_relaxed(parts)


def _series_sql(section, column, table):
    values = {"n_days": f"count({column})::DOUBLE", "mean_daily_return": f"avg({column})", "daily_vol": f"stddev_samp({column})", "hit_rate": f"avg(({column} > 0)::INT)"}
    return " UNION ALL ".join(f"SELECT '{section}' AS section, '{m}' AS metric, {e} AS value FROM {table}" for m, e in values.items())


@query(
    "evaluation_metrics",
    f"""WITH {_EVALUATED}, v AS ({_series_sql("benchmark", "b", "bm")} UNION ALL {_series_sql("portfolio", "ret", "pd")}
          UNION ALL SELECT 'portfolio', 'mean_turnover', avg(turnover) FROM pd
          UNION ALL SELECT 'active', 'mean_daily_return', avg(active) FROM pd UNION ALL SELECT 'active', 'tracking_error', stddev_samp(active) FROM pd
          UNION ALL SELECT 'active', 'information_ratio', avg(active) / stddev_samp(active) * sqrt(244.0) FROM pd
          UNION ALL SELECT 'head_ranking', 'ndcg_' || cutoff, avg(ndcg) FROM hd GROUP BY cutoff
          UNION ALL SELECT 'head_ranking', 'top_excess_bps_' || cutoff, avg(bps) FROM hd GROUP BY cutoff
          UNION ALL SELECT 'ic', 'n_periods', count(ic) FROM ics UNION ALL SELECT 'ic', 'mean_ic', avg(ic) FROM ics
          UNION ALL SELECT 'coverage', 'score_rows', count(*) FROM fwd UNION ALL SELECT 'coverage', 'signal_days', count(DISTINCT date) FROM fwd
          UNION ALL SELECT 'coverage', 'eligible_rows', count(*) FILTER (eligible) FROM fwd
          UNION ALL SELECT 'coverage', 'label_rows', count(fwd_ret) FILTER (eligible) FROM fwd
          UNION ALL SELECT 'coverage', 'label_coverage', count(fwd_ret) FILTER (eligible)::DOUBLE / count(*) FILTER (eligible) FROM fwd)
        SELECT section, metric, {sql_round("value", 6)} AS value FROM v""",
)
def evaluation_metrics(spark, d):
    """The metrics of the written evaluation; the spread of the IC has its own query."""
    out = _evaluation(spark, d)["metrics"].where("section <> 'ic' or metric in ('n_periods', 'mean_ic')")
    return out.withColumn("value", rounded("value", 6))


# --- regime set ---------------------------------------------------------------


def regime_eod(spark, d):
    days = staged_days(spark, d).withColumn("pre_close", F.when(F.col("n_events") != 7, F.col("open")))
    return staged(P.regime_quotes(days), "regime")


REGIME = f"""{DAYS},
rq AS (SELECT date, symbol, market, CASE WHEN market = 'SH' THEN
    (CASE WHEN symbol[1:3] = '688' THEN 'STAR' WHEN symbol[1:2] = '60' THEN 'MAIN' ELSE 'UNKNOWN' END)
  WHEN symbol[1:3] IN ('300', '301') THEN 'CHINEXT' WHEN symbol[1:3] IN ('002', '003') THEN 'SME'
  WHEN symbol[1:3] IN ('000', '001') THEN 'MAIN' WHEN symbol[1:2] IN ('43', '83', '87', '88', '92') THEN 'BSE'
  ELSE 'UNKNOWN' END AS board,
  CASE WHEN n_events <> 7 AND open > 0 AND close > 0 THEN close / open - 1.0::DOUBLE END AS ret_1d, total_notional AS amount FROM days),
st AS (SELECT date, count(*) AS n_names, avg(ret_1d) AS market_return, avg(sign(ret_1d)) AS market_breadth, sum(amount) AS total_amount,
        count(ret_1d)::DOUBLE / count(*) AS return_coverage, count(amount)::DOUBLE / count(*) AS amount_coverage FROM rq GROUP BY date),
bs AS (SELECT date, board, avg(ret_1d) AS board_return, count(*) AS n_names FROM rq WHERE ret_1d IS NOT NULL GROUP BY ALL),
mf AS (SELECT st.*, calendar_index, product(1 + market_return) OVER w5 - 1 AS market_return_5d,
        product(1 + market_return) OVER w20 - 1 AS market_return_20d, stddev_samp(market_return) OVER w20 * sqrt(252.0) AS market_realized_vol_20d,
        total_amount / avg(total_amount) OVER w20 AS market_amount_ratio_20d FROM st JOIN cal USING (date)
       WINDOW w5 AS (ORDER BY calendar_index RANGE 4 PRECEDING), w20 AS (ORDER BY calendar_index RANGE 19 PRECEDING)
       QUALIFY count(*) OVER w20 = 20),
bst AS (SELECT b.date, b.board, CASE WHEN n = 20 THEN c - m.market_return_20d END AS board_relative_strength_20d FROM
        (SELECT date, board, product(1 + board_return) OVER w - 1 AS c, count(*) OVER w AS n FROM bs JOIN cal USING (date)
         WINDOW w AS (PARTITION BY board ORDER BY calendar_index RANGE 19 PRECEDING)) b JOIN mf m USING (date))"""


@query("regime_quotes", f"WITH {REGIME} SELECT date, symbol, market, board, {sql_round('ret_1d')} AS ret_1d, round(amount, 2) AS amount FROM rq")
def regime_quotes(spark, d):
    return regime_eod(spark, d).withColumns({"ret_1d": rounded("ret_1d"), "amount": rounded("amount", 2)})


@query(
    "market_daily_state",
    f"""WITH {REGIME} SELECT date, n_names, {sql_round("market_return")} AS market_return, {sql_round("market_breadth")} AS market_breadth,
          round(total_amount, 2) AS total_amount, {sql_round("return_coverage")} AS return_coverage,
          {sql_round("amount_coverage")} AS amount_coverage FROM st""",
)
def market_daily_state(spark, d):
    cols = ("market_return", "market_breadth", "return_coverage", "amount_coverage")
    out = P.daily_state(regime_eod(spark, d))
    return out.withColumns({**{c: rounded(c) for c in cols}, "total_amount": rounded("total_amount", 2)})


@query("board_daily_state", f"WITH {REGIME} SELECT date, board, {sql_round('board_return')} AS board_return, n_names FROM bs WHERE n_names >= 2")
def board_daily_state(spark, d):
    return P.board_state(regime_eod(spark, d), 2).withColumn("board_return", rounded("board_return"))


_MF = ("market_return_5d", "market_return_20d", "market_realized_vol_20d", "market_amount_ratio_20d")


@query("market_window_features", f"WITH {REGIME} SELECT date, {', '.join(f'{sql_round(c, 7)} AS {c}' for c in _MF)} FROM mf")
def market_window_features(spark, d):
    q = regime_eod(spark, d)
    out = P.market_features(staged(P.daily_state(q), "state"), calendar(q))
    return out.select("date", *[rounded(c, 7).alias(c) for c in _MF])


@query(
    "board_relative_strength",
    f"""WITH {REGIME} SELECT date, board, {sql_round("board_relative_strength_20d", 7)} AS board_relative_strength_20d FROM bst""",
)
def board_relative_strength(spark, d):
    q = regime_eod(spark, d)
    cal = calendar(q)
    out = P.board_strength(P.board_state(q), P.market_features(staged(P.daily_state(q), "state"), cal), cal)
    return out.withColumn("board_relative_strength_20d", rounded("board_relative_strength_20d", 7))


from flowmill.plans.matching import ATOMIC, atomic_table  # noqa: E402

_REGIME_ATOMIC = ATOMIC + REGIME[REGIME.index(",\nquotes AS"):]


@query(
    "regime_features",
    f"""WITH {_REGIME_ATOMIC} SELECT a.date, a.symbol, rq.market, board, {", ".join(f"{sql_round(c, 7)} AS {c}" for c in _MF)},
          {sql_round("market_breadth")} AS market_breadth, {sql_round("board_relative_strength_20d", 7)} AS board_relative_strength_20d,
          {sql_round("stock_depth_l5_log", 7)} AS stock_depth_l5_log, {sql_round("stock_ofi_l1", 7)} AS stock_ofi_l1, a.date AS asof_date
        FROM atomic a JOIN rq USING (date, symbol) JOIN mf USING (date) LEFT JOIN bst USING (date, board)""",
)
def regime_features(spark, d):
    q = regime_eod(spark, d)
    out = P.regime_features(staged(atomic_table(spark, d), "atomic"), q, q, calendar(q)).where("has_quote and has_history")
    cols = (*_MF, "board_relative_strength_20d", "stock_depth_l5_log", "stock_ofi_l1")
    return out.select(
        "date", "symbol", "market", "board", *[rounded(c, 7).alias(c) for c in cols],
        rounded("market_breadth").alias("market_breadth"), "asof_date",
    )


_UNQUOTED = """
uq AS (SELECT date, symbol, symbol::BIGINT % 11 <> 3 AS has_quote, CASE WHEN has_quote THEN market END AS market,
  CASE WHEN has_quote THEN board END AS board, CASE WHEN has_quote THEN ret_1d END AS ret_1d, CASE WHEN has_quote THEN amount END AS amount FROM rq),
st AS"""
_REGIME_UNIVERSE = _REGIME_ATOMIC.replace("\nst AS", _UNQUOTED).replace("FROM rq GROUP BY date", "FROM uq GROUP BY date").replace(
    "FROM rq WHERE ret_1d", "FROM uq WHERE ret_1d"
)


@query(
    "regime_universe_features",
    f"""WITH {_REGIME_UNIVERSE} SELECT a.date, a.symbol, uq.market, uq.board, coalesce(has_quote, false) AS has_quote,
          market_return_20d IS NOT NULL AS has_history, {", ".join(f"{sql_round('mf.' + c, 7)} AS {c}" for c in _MF)},
          {sql_round("st.market_breadth")} AS market_breadth, {sql_round("st.return_coverage")} AS return_coverage,
          {sql_round("st.amount_coverage")} AS amount_coverage, {sql_round("board_relative_strength_20d", 7)} AS board_relative_strength_20d,
          {sql_round("stock_ofi_l1", 7)} AS stock_ofi_l1
        FROM atomic a LEFT JOIN uq ON a.date = uq.date AND a.symbol = uq.symbol LEFT JOIN st ON st.date = a.date
          LEFT JOIN mf ON mf.date = a.date LEFT JOIN bst ON bst.date = a.date AND bst.board = uq.board""",
)
def regime_universe_features(spark, d):
    """Every eleventh name of the universe has no quote; all rows and warm-up days stay."""
    q = regime_eod(spark, d)
    out = P.regime_features(staged(atomic_table(spark, d), "atomic"), q.where(F.col("symbol").cast("long") % 11 != 3), q, calendar(q))
    return out.select(
        "date", "symbol", "market", "board", "has_quote", "has_history",
        *[rounded(c, 7).alias(c) for c in (*_MF, "board_relative_strength_20d", "stock_ofi_l1")],
        *[rounded(c).alias(c) for c in ("market_breadth", "return_coverage", "amount_coverage")],
    )


@query(
    "quote_rejections",
    f"""WITH {DAYS}, k AS (SELECT CASE WHEN symbol::BIGINT % 23 <> 7 THEN symbol END AS symbol, date,
             CASE WHEN symbol::BIGINT % 19 = 1 THEN 'BJ' ELSE market END AS market, symbol::BIGINT % 17 = 2 AS twice FROM days),
          p AS (SELECT symbol, date, market FROM k UNION ALL SELECT symbol, date, market FROM k WHERE twice),
          c AS (SELECT *, count(*) OVER (PARTITION BY date, symbol) AS n FROM p),
          r AS (SELECT unnest(['missing_key', 'duplicate_key', 'foreign_market', 'off_calendar']) AS "check", unnest([
             count(*) FILTER (symbol IS NULL), count(*) FILTER (symbol IS NOT NULL AND n > 1), count(*) FILTER (market = 'BJ'),
             count(*) FILTER (day(date::DATE) % 10 = 5)]) AS bad_rows FROM c)
        SELECT *, CASE WHEN bad_rows = 0 THEN 'pass' ELSE 'fail' END AS status FROM r""",
)
def quote_rejections(spark, d):
    """Quotes into which lost symbols, repeated rows and a foreign market were put, against a calendar that lacks days."""
    days = staged_days(spark, d).select("date", "symbol", "market")
    number = F.col("symbol").cast("long")
    odd = days.withColumns({
        "symbol": F.when(number % 23 != 7, F.col("symbol")), "market": F.when(number % 19 == 1, "BJ").otherwise(F.col("market")),
        "__copies": F.when(number % 17 == 2, 2).otherwise(1),
    })
    odd = odd.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return G.quote_rejections(odd, calendar(days).where(F.dayofmonth(F.to_date("date")) % 10 != 5))


_GATED = (*_MF, "market_breadth", "board_relative_strength_20d", "stock_depth_l5_log", "stock_ofi_l1")
_GATES = f"""{_REGIME_UNIVERSE},
g AS (SELECT a.date, a.symbol, uq.date IS NULL AS unlisted, coalesce(uq.has_quote, false) AS quoted, mf.market_return_20d IS NOT NULL AS history,
    coalesce(st.return_coverage >= 0.6 AND st.amount_coverage >= 0.6, false) AS covered, coalesce(book_valid_ratio >= 0.003, false) AS valid,
    {" AND ".join(f"{'st' if c == 'market_breadth' else 'mf' if c in _MF else 'bst' if c.startswith('board') else 'a'}.{c} IS NOT NULL" for c in _GATED)} AS whole,
    coalesce(uq.has_quote, false) AND a.symbol::BIGINT % 37 = 5 AND uq.board <> 'BSE' AS strange
  FROM atomic a LEFT JOIN uq ON a.date = uq.date AND a.symbol = uq.symbol LEFT JOIN st ON st.date = a.date
    LEFT JOIN mf ON mf.date = a.date LEFT JOIN bst ON bst.date = a.date AND bst.board = uq.board),
gc AS (SELECT unnest(['in_universe', 'has_quote', 'has_history', 'coverage', 'features', 'book_valid_ratio', 'duplicate_key', 'identity']) AS "check",
    unnest([count(*) FILTER (unlisted), count(*) FILTER (NOT quoted), count(*) FILTER (NOT history), count(*) FILTER (NOT covered),
      count(*) FILTER (NOT whole), count(*) FILTER (NOT valid), 0, count(*) FILTER (strange)]) AS bad_rows FROM g),
gr AS (SELECT *, CASE WHEN bad_rows = 0 THEN 'pass' ELSE 'fail' END AS status FROM gc)"""


def _gates(spark, d):
    q, atomic = regime_eod(spark, d), staged(atomic_table(spark, d), "atomic")
    quotes = q.where(F.col("symbol").cast("long") % 11 != 3)
    odd = F.when(F.col("symbol").cast("long") % 37 == 5, "BSE").otherwise(F.col("board"))
    stated = atomic.select("date", "symbol").join(q, ["date", "symbol"]).select("date", "symbol", "market", odd.alias("board"))
    return G.regime_gates(P.regime_features(atomic, quotes, q, calendar(q)), stated, quotes, _GATED, 0.6, 0.003)


@query("regime_gates", f"WITH {_GATES} SELECT * FROM gr")
def regime_gates(spark, d):
    """Every gate of the regime set; names without a quote and rows with another board were put in."""
    return _gates(spark, d)


@query(
    "regime_verdict",
    f"""WITH {_GATES} SELECT count(*) AS n_checks, count(*) FILTER (status <> 'pass') AS n_failed,
          CASE WHEN bool_and(status = 'pass') THEN 'ready' ELSE 'refused' END AS verdict,
          coalesce(string_agg("check", ',' ORDER BY "check") FILTER (status <> 'pass'), '') AS failed FROM gr""",
)
def regime_verdict(spark, d):
    return G.verdict(_gates(spark, d))


@query(
    "identity_conflicts",
    f"""WITH {REGIME}, a AS (SELECT date, symbol, market, CASE WHEN symbol::BIGINT % 37 = 5 THEN 'BSE' ELSE board END AS board FROM rq)
        SELECT date, symbol, a.market, a.board, rq.market AS q_market, rq.board AS q_board FROM a JOIN rq USING (date, symbol)
        WHERE a.board <> rq.board""",
)
def identity_conflicts(spark, d):
    q = regime_eod(spark, d)
    odd = F.when(F.col("symbol").cast("long") % 37 == 5, "BSE").otherwise(F.col("board"))
    return P.identity_conflicts(q.select("date", "symbol", "market", odd.alias("board")), q)


@query(
    "regime_attached_features",
    f"""WITH {REGIME} SELECT d.date, d.symbol, factor_ofi, {sql_round("market_return", 8)} AS market_return FROM days d JOIN st USING (date)""",
)
def regime_attached_features(spark, d):
    feats = staged_days(spark, d).select("date", "symbol", "factor_ofi")
    q = regime_eod(spark, d)
    per_key = q.select("date", "symbol").join(P.daily_state(q).select("date", "market_return"), "date")
    return J.attach_complete(feats, per_key, ["date", "symbol"], ["market_return"]).withColumn("market_return", rounded("market_return"))


@query(
    "train_fitted_normaliser",
    f"""WITH {DAYS}, t AS (SELECT avg(close) AS m, greatest(stddev_pop(close), 1e-6) AS s FROM days WHERE date <= '2024-01-20')
        SELECT date, symbol, {sql_round("(close - m) / s", 7)} AS close FROM days, t""",
)
def train_fitted_normaliser(spark, d):
    days = staged_days(spark, d)
    fitted = P.fit_normaliser(days.where(F.col("date") <= "2024-01-20"), ["close"])
    return P.apply_normaliser(days, fitted, ["close"]).select("date", "symbol", rounded("close", 7).alias("close"))


@query(
    "finite_feature_gate",
    f"""WITH {FWD}, c AS (SELECT count(*) AS n, count(fwd_ret) AS a, count(score) AS b FROM fwd)
        SELECT unnest(['fwd_ret', 'score']) AS feature, unnest([n - a, n - b]) AS bad_rows FROM c""",
)
def finite_feature_gate(spark, d):
    from flowmill.operators.checks import finite_gate

    return finite_gate(forward(spark, d), ["fwd_ret", "score"])

