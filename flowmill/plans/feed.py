"""Feed queries: raw rows, event stream, canonical events, clock, ordering, sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowmill.functions import market as M
from flowmill.functions.scalars import day_text, is_iso_date, parse_day
from flowmill.operators import events as E
from flowmill.plans.base import BOARD_SQL, CANON, MS_SQL, RAW, STREAM, raw_rows, table
from flowmill.plans.registry import query, rounded, sql_round
from flowmill.session import new_path, staged
from flowmill.sources import inventory, io


def stream(spark: SparkSession, d: str) -> DataFrame:
    return E.event_stream(raw_rows(spark, d))


def canon(spark: SparkSession, d: str) -> DataFrame:
    return E.canonical_v1(stream(spark, d))


# --- scans and unions ---------------------------------------------------------


@query(
    "projected_scan",
    """SELECT l_orderkey, l_suppkey, l_quantity FROM lineitem
       WHERE l_shipdate >= TIMESTAMP '2000-01-01' AND l_returnflag IN ('A', 'R') AND l_quantity > 45""",
)
def projected_scan(spark, d):
    li = table(spark, d, "lineitem")
    keep = (F.col("l_shipdate") >= F.lit("2000-01-01").cast("timestamp_ntz")) & F.col("l_returnflag").isin("A", "R")
    return li.where(keep & (F.col("l_quantity") > 45)).select("l_orderkey", "l_suppkey", "l_quantity")


@query(
    "symbol_filtered_keys",
    "SELECT l_suppkey AS symbol, count(*) AS n_rows FROM lineitem WHERE l_suppkey IN (1, 3, 5) GROUP BY 1",
)
def symbol_filtered_keys(spark, d):
    df = io.read_keys(spark, [[f"{d}/lineitem.parquet"]], ["000001", "000003", "000005"], ["l_suppkey"], symbol="l_suppkey")
    return df.groupBy(F.col("l_suppkey").alias("symbol")).agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "diagonal_union",
    """WITH u AS (
         SELECT 'order' AS src, o_orderkey AS k, o_totalprice AS total, NULL::BIGINT AS line, o_orderpriority AS pr
         FROM orders
         UNION ALL SELECT 'line', l_orderkey, NULL, l_linenumber::BIGINT, NULL FROM lineitem)
       SELECT src, count(*) AS n_rows, count(total) AS n_total, count(line) AS n_line, sum(line)::BIGINT AS s_line,
              count(pr) AS n_pr, sum(k)::BIGINT AS s_key FROM u GROUP BY src""",
)
def diagonal_union(spark, d):
    o = table(spark, d, "orders").select(
        F.lit("order").alias("src"), F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("total"),
        F.col("o_orderpriority").alias("pr"),
    )
    li = table(spark, d, "lineitem").select(
        F.lit("line").alias("src"), F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("long").alias("line")
    )
    return io.union_relaxed([o, li]).groupBy("src").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("total").alias("n_total"), F.count("line").alias("n_line"),
        F.sum("line").alias("s_line"), F.count("pr").alias("n_pr"), F.sum("k").alias("s_key"),
    )


@query("prefix_scan", "SELECT event_type, count(*) AS n_rows FROM events GROUP BY 1")
def prefix_scan(spark, d):
    return io.read_named(spark, d, "events*.parquet").groupBy("event_type").agg(F.count(F.lit(1)).alias("n_rows"))


_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


@query(
    "file_row_counts",
    " UNION ALL ".join(f"SELECT '{t}.parquet' AS file, count(*) AS n_rows FROM {t}" for t in _TABLES),
)
def file_row_counts(spark, d):
    # One scan per schema family: the given tables have different schemas.
    return io.union_relaxed([io.table_rows(spark, d, f"{t}.parquet") for t in _TABLES])


# Every column of every given table: plain text, n(umber to 4 places), t(ime), v(ector to 6 places).
_CONTENT = {
    "region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey",
    "customer": "c_custkey c_name c_nationkey c_acctbal:n c_mktsegment", "supplier": "s_suppkey s_name s_nationkey s_acctbal:n",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice:n",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice:n o_orderdate:t o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity:n l_extendedprice:n l_discount:n l_tax:n l_returnflag l_linestatus l_shipdate:t",
    "events": "event_id ts:t user_id event_type value:n props", "embeddings": "vec_id embedding:v label",
    "documents": "doc_id text lang source n_chars", "pages": "page_id url html", "benchmark": "item_id text",
    "labels": "doc_id quality toxic", "conversations": "conv_id turn role text",
}


def _content_columns(spec):
    texts = {
        "": lambda c: c, "n": lambda c: F.round(c * 10000).cast("long"), "t": lambda c: F.unix_micros(c.cast("timestamp")),
        "v": lambda c: F.array_join(F.transform(c, lambda x: F.round(x.cast("double") * 1000000).cast("long").cast("string")), ","),
    }
    return [texts[kind](F.col(name)) for name, _, kind in (c.partition(":") for c in spec.split())]


def _content_sql():
    texts = {
        "": "{0}::VARCHAR", "n": "round({0} * 10000)::BIGINT::VARCHAR", "t": "epoch_us({0})::VARCHAR",
        "v": "array_to_string(list_transform({0}, lambda x: round(x::DOUBLE * 1000000)::BIGINT::VARCHAR), ',')",
    }
    rows = []
    for name, spec in _CONTENT.items():
        columns = [texts[kind].format(c) for c, _, kind in (x.partition(":") for x in spec.split())]
        joined = ", ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE length({c}) || ':' || {c} END" for c in columns)
        rows.append(f"SELECT '{name}' AS node, sha256(concat({joined})) AS d FROM {name}")
    lanes = ", ".join(f"sum(('0x' || substr(d, {1 + 15 * i}, 15))::BIGINT::HUGEINT) AS l{i}" for i in range(4))
    digest = "sha256(concat_ws('|', node, n_rows, l0, l1, l2, l3))"
    return f"""WITH content AS ({" UNION ALL ".join(rows)}),
files AS (SELECT *, {digest} AS digest FROM (SELECT node, count(*) AS n_rows, {lanes} FROM content GROUP BY node)),
folders AS (SELECT *, {digest} AS d FROM (
  SELECT substr(sha256(node), 1, 1) AS node, sum(n_rows)::BIGINT AS n_rows, count(*) AS n_files, {lanes.replace("(d,", "(digest,")} FROM files GROUP BY 1)),
root AS (SELECT *, {digest} AS digest FROM (SELECT '' AS node, sum(n_rows)::BIGINT AS n_rows, sum(n_files)::BIGINT AS n_files, {lanes} FROM folders))"""


def _inventory(spark, d):
    file = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.parquet", 1)
    parts = [inventory.leaves(table(spark, d, t), file, _content_columns(spec)) for t, spec in _CONTENT.items()]
    return inventory.tree(staged(reduce(DataFrame.unionByName, parts), "leaves"))


@query("file_inventory", f"{_content_sql()} SELECT node AS file, n_rows, digest FROM files")
def file_inventory(spark, d):
    """Rows and digest of every table's content, whatever the order of its rows and its division into files."""
    return _inventory(spark, d).where(F.col("level") == inventory.FILE).select(F.col("node").alias("file"), "n_rows", "digest")


@query("inventory_set_digest", f"{_content_sql()} SELECT n_files, n_rows, digest FROM root")
def inventory_set_digest(spark, d):
    """One digest over all tables, from which differences can be traced down."""
    return _inventory(spark, d).where(F.col("level") == inventory.ROOT).select("n_files", "n_rows", "digest")


@query(
    "key_set_digest",
    """WITH k AS (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS date, user_id FROM events)
       SELECT date, count(*) AS n_keys,
              bit_xor(('0x' || substr(sha256(user_id::VARCHAR), 1, 15))::BIGINT) AS set_digest
       FROM k GROUP BY date""",
)
def key_set_digest(spark, d):
    e = table(spark, d, "events").select(day_text("ts").alias("date"), "user_id")
    return io.key_set_digest(e, ["user_id"], ["date"])


@query(
    "calendar_source",
    """SELECT date, row_number() OVER (ORDER BY date) - 1 AS calendar_index
       FROM (SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders)""",
)
def calendar_source(spark, d):
    days = table(spark, d, "orders").select(day_text("o_orderdate").alias("value")).distinct()
    notes = days.limit(1).select(F.explode(F.array(F.lit("# trading days"), F.lit(""))).alias("value"))
    path = new_path(spark, "calendar")
    days.unionByName(notes).write.text(path)
    return io.read_calendar(spark, path)


@query(
    "calendar_digest",
    """SELECT count(*) AS n_days, sha256(string_agg(date, chr(10) ORDER BY date) || chr(10)) AS calendar_sha256
       FROM (SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders)""",
)
def calendar_digest(spark, d):
    days = table(spark, d, "orders").select(day_text("o_orderdate").alias("date"))
    return io.calendar_digest(io.index_calendar(days))


# --- raw rows -----------------------------------------------------------------


@query(
    "standardized_rows",
    """SELECT CASE WHEN length(user_id::VARCHAR) < 6 THEN lpad(user_id::VARCHAR, 6, '0')
                   ELSE substr(user_id::VARCHAR, 1, 6) END AS symbol,
              event_id AS serial, 0::BIGINT AS int_time, 0::BIGINT AS local_time, 0::BIGINT AS exchange_time,
              upper(substr(event_type, 1, 1)) AS bsflag, 'O' AS order_type, '0' AS trade_type,
              CAST(round(value * 100) AS BIGINT) AS order_price, coalesce(NULLIF(event_id % 5, 0), 0) AS order_volume,
              0::BIGINT AS trade_price, 0::BIGINT AS trade_volume, 0::BIGINT AS orderorino, 0::BIGINT AS buy_id,
              0::BIGINT AS sell_id
       FROM events""",
)
def standardized_rows(spark, d):
    vendor = table(spark, d, "events").select(
        F.col("user_id").alias("ticker"), F.col("event_id").alias("seq"),
        F.substring("event_type", 1, 1).alias("flag"),
        F.round(F.col("value") * 100).alias("px"),
        F.nullif(F.col("event_id") % 5, F.lit(0)).alias("qty"),
    )
    names = {"ticker": "symbol", "seq": "serial", "flag": "bsflag", "px": "order_price", "qty": "order_volume"}
    return E.standardize(vendor, is_trade=False, mapping=names)


@query(
    "normalised_dtypes",
    "SELECT event_id, event_type, user_id FROM events",
)
def normalised_dtypes(spark, d):
    e = table(spark, d, "events").select(
        F.col("event_id").cast("decimal(20,0)").alias("event_id"),
        F.col("event_type").cast("binary").alias("event_type"), "user_id",
    )
    return E.normalise_dtypes(e)


@query(
    "combined_split",
    f"""WITH {RAW} SELECT type AS leg, count(*) AS n_rows, sum(trade_volume)::BIGINT AS traded,
        sum(order_volume)::BIGINT AS ordered FROM raw GROUP BY type""",
)
def combined_split(spark, d):
    trades, orders = E.split_combined(raw_rows(spark, d))
    def side(df, leg):
        return df.agg(
            F.lit(leg).alias("leg"), F.count(F.lit(1)).alias("n_rows"),
            F.sum("trade_volume").alias("traded"), F.sum("order_volume").alias("ordered"),
        )
    return side(trades, "T").unionByName(side(orders, "O"))


@query(
    "combined_split_untyped",
    f"""WITH {RAW} SELECT 'T' AS leg, count(*) AS n_rows FROM raw WHERE trade_volume > 0
        UNION ALL SELECT 'O', count(*) FROM raw WHERE order_volume > 0""",
)
def combined_split_untyped(spark, d):
    blank = {c: F.nullif(F.col(c), F.lit("0")) for c in ("trade_type", "order_type")}
    trades, orders = E.split_combined(raw_rows(spark, d).drop("type").withColumns(blank))
    counts = [df.agg(F.lit(leg).alias("leg"), F.count(F.lit(1)).alias("n_rows")) for leg, df in (("T", trades), ("O", orders))]
    return counts[0].unionByName(counts[1])


@query(
    "market_rows_cut",
    f"""WITH {RAW} SELECT date, symbol, type, serial, int_time,
          CASE WHEN type = 'T' THEN 0 ELSE 1 END AS src_rank
        FROM raw WHERE int_time < 143000000 AND serial < (SELECT max(event_id) * 9 // 10 FROM events)""",
)
def market_rows_cut(spark, d):
    cut = table(spark, d, "events").agg(F.max("event_id")).first()[0] * 9 // 10
    trades, orders = E.split_combined(raw_rows(spark, d))
    rows = E.market_rows(trades, orders, 143_000_000, cut)
    return rows.select("date", "symbol", "type", "serial", "int_time", "src_rank")


# --- event stream and canonical events ----------------------------------------


@query(
    "event_stream",
    f"""WITH {STREAM} SELECT *, {sql_round("ln(1 + greatest(volume, 0) / 100.0)")} AS log_volume FROM stream""",
)
def event_stream(spark, d):
    return stream(spark, d).withColumn("log_volume", rounded("log_volume"))


@query(
    "event_order_local_time",
    f"""WITH {RAW} SELECT date, symbol, serial,
          row_number() OVER (PARTITION BY date, symbol ORDER BY local_time, type DESC, serial) - 1 AS event_idx
        FROM raw""",
)
def event_order_local_time(spark, d):
    return E.event_stream(raw_rows(spark, d), E.ORDER_LOCAL_V1).select("date", "symbol", "serial", "event_idx")


_CANON_COLS = """'v1' AS schema_version, date, exchange, 'A_SHARE' AS market,
  symbol || CASE WHEN market = 'SH' THEN '.SH' ELSE '.SZ' END AS symbol, symbol AS security_id, board, session,
  event_source, evt_type, side, price, qty, round(amount, 6) AS amount, order_type, 0 AS level, delta_t, int_time,
  local_time, source_seqnum, event_idx, 0 AS quality_flag"""


@query("canonical_events", f"WITH {CANON} SELECT {_CANON_COLS} FROM canon")
def canonical_events(spark, d):
    return canon(spark, d).withColumn("amount", F.round("amount", 6))


@query(
    "canonical_domains",
    f"""WITH {CANON}, planted AS (SELECT CASE WHEN source_seqnum % 101 = 5 THEN 'TRADE' ELSE evt_type END AS evt_type, CASE WHEN source_seqnum % 103 = 7 THEN NULL ELSE side END AS side FROM canon)
        SELECT 'evt_type' AS "column", evt_type AS value, count(*) AS n FROM planted WHERE evt_type = 'TRADE' GROUP BY ALL
        UNION ALL SELECT 'side', side, count(*) FROM planted WHERE side IS NULL GROUP BY ALL""",
)
def canonical_domains(spark, d):
    """Values outside the published domains: none in canonical events but the planted ones."""
    number = F.col("source_seqnum")
    planted = canon(spark, d).withColumns({
        "evt_type": F.when(number % 101 == 5, "TRADE").otherwise(F.col("evt_type")), "side": F.when(number % 103 != 7, F.col("side")),
    })
    return E.domain_violations(planted)


@query(
    "canonical_sink",
    f"""WITH {CANON} SELECT date, exchange, count(*) AS n_rows, sum(event_idx)::BIGINT AS s_idx,
        sum(qty) AS qty FROM canon GROUP BY ALL""",
)
def canonical_sink(spark, d):
    path = new_path(spark, "canonical")
    io.write_partitioned(canon(spark, d), path, ["date", "exchange"], ["security_id", "event_idx"])
    return spark.read.parquet(path).groupBy(F.date_format("date", "yyyy-MM-dd").alias("date"), "exchange").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("event_idx").alias("s_idx"), F.sum("qty").alias("qty")
    )


@query(
    "schema_version_check",
    "SELECT 'v1' AS schema_version, count(*) AS n_rows FROM events",
)
def schema_version_check(spark, d):
    return E.schema_versions(canon(spark, d))


@query(
    "clock_intervals",
    f"""WITH {RAW}, t AS (SELECT {MS_SQL} AS ms FROM raw)
        SELECT CASE WHEN ms >= 34200000 AND ms <= 41400000 THEN 1 + least((ms - 34200000) // 300000, 23)
                    WHEN ms >= 46800000 AND ms <= 54000000 THEN 25 + least((ms - 46800000) // 300000, 23)
                    WHEN ms >= 33300000 AND ms < 34200000 THEN 0 ELSE -1 END AS clock_interval,
               count(*) AS n_events, min(ms) AS first_ms, max(ms) AS last_ms
        FROM t GROUP BY 1""",
)
def clock_intervals(spark, d):
    ms = raw_rows(spark, d).select(M.packed_to_ms("int_time").alias("ms"))
    return ms.groupBy(M.clock_interval("ms", 5).cast("long").alias("clock_interval")).agg(
        F.count(F.lit(1)).alias("n_events"), F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms")
    )


@query(
    "trade_time_text",
    """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') || '.' ||
         lpad(((microsecond(ts) // 1000) % 1000)::VARCHAR, 3, '0') AS time_text,
         true AS valid_time FROM events""",
)
def trade_time_text(spark, d):
    e = table(spark, d, "events").select("event_id", day_text("ts").alias("day"), M.packed_time("ts").alias("t"))
    return e.select("event_id", M.time_text("day", "t").alias("time_text"), M.packed_time_valid("t").alias("valid_time"))


@query(
    "board_counts",
    f"""WITH {RAW}, s AS (SELECT DISTINCT symbol, market FROM raw)
        SELECT market, {BOARD_SQL} AS board, CASE WHEN market = 'SH' THEN 'XSHG' ELSE 'XSHE' END AS exchange,
               count(*) AS n_symbols FROM s GROUP BY ALL""",
)
def board_counts(spark, d):
    s = raw_rows(spark, d).select("symbol", "market").distinct()
    return s.groupBy("market", M.board_name("symbol", "market").alias("board"), M.exchange_code("market").alias("exchange")).agg(
        F.count(F.lit(1)).alias("n_symbols")
    )


_HALF_LIFE = 120_000.0
_MID = f"""{CANON},
ord AS (SELECT *, evt_type = 'EXEC' AND price > 0 AND qty > 0 AS tr FROM canon),
last_trade AS (
  SELECT *, max(CASE WHEN tr THEN event_idx END) OVER w AS lt,
         min(CASE WHEN price > 0 THEN event_idx END) OVER (PARTITION BY date, symbol) AS seed_idx,
         coalesce(ms - lag(ms) OVER w, 0) AS step
  FROM ord WINDOW w AS (PARTITION BY date, symbol ORDER BY event_idx)),
mids AS (
  SELECT a.date, a.symbol, a.event_idx,
         sum(b.price * b.qty * pow(2.0::DOUBLE, (b.ms - c.ms) / {_HALF_LIFE}::DOUBLE))
           / sum(b.qty * pow(2.0::DOUBLE, (b.ms - c.ms) / {_HALF_LIFE}::DOUBLE)) AS mid
  FROM last_trade a JOIN ord c ON c.date = a.date AND c.symbol = a.symbol AND c.event_idx = a.lt
  JOIN ord b ON b.date = a.date AND b.symbol = a.symbol AND b.tr AND b.event_idx <= a.lt
  GROUP BY ALL),
feat AS (
  SELECT a.date, a.symbol, a.event_idx, a.price, a.qty, a.evt_type, a.side, a.exchange, a.board, a.session, a.step,
         coalesce(m.mid, CASE WHEN a.event_idx >= a.seed_idx THEN s.price END) AS mid,
         coalesce(m.mid, s.price, 1.0) AS mid_v1
  FROM last_trade a LEFT JOIN mids m USING (date, symbol, event_idx)
  LEFT JOIN ord s ON s.date = a.date AND s.symbol = a.symbol AND s.event_idx = a.seed_idx)"""


@query(
    "causal_features",
    f"""WITH {_MID} SELECT date, symbol AS security_id, event_idx, {sql_round("mid")} AS mid,
          {sql_round("CASE WHEN price > 0 AND mid > 0 THEN ln(least(greatest(price / mid, 1e-6), 1e6)) END")} AS price_rel,
          {sql_round("ln(1 + greatest(qty, 0) / 100.0)")} AS log_volume,
          {sql_round("ln(1 + greatest(step, 0))")} AS log_delta_t
        FROM feat""",
)
def causal_features(spark, d):
    out = E.derived_features(staged(canon(spark, d), "canon"), _HALF_LIFE, sorted_clock=True)
    return out.select("date", "security_id", "event_idx", *[rounded(c).alias(c) for c in ("mid", "price_rel", "log_volume", "log_delta_t")])


@query(
    "causal_features_backfilled",
    f"""WITH {_MID} SELECT date, symbol AS security_id, event_idx, {sql_round("mid_v1")} AS mid,
          {sql_round("CASE WHEN price > 0 AND mid_v1 > 0 THEN ln(least(greatest(price / mid_v1, 1e-6), 1e6)) ELSE 0 END")} AS price_rel
        FROM feat""",
)
def causal_features_backfilled(spark, d):
    out = E.derived_features(staged(canon(spark, d), "canon"), _HALF_LIFE, E.TRANSFORM_BACKFILL_V1, sorted_clock=True)
    return out.select("date", "security_id", "event_idx", rounded("mid").alias("mid"), rounded("price_rel").alias("price_rel"))


_AUDIT_SQL = """
WITH r AS (SELECT row_number() OVER () - 1 AS pos, l_shipdate, l_orderkey, l_linenumber FROM lineitem),
p AS (SELECT *, lag(l_shipdate) OVER w AS a, lag(l_orderkey) OVER w AS b, lag(l_linenumber) OVER w AS c
      FROM r WINDOW w AS (ORDER BY pos)),
f AS (SELECT pos, coalesce(l_shipdate < a, false) AS x, coalesce(l_shipdate = a AND l_orderkey < b, false) AS y,
             coalesce(l_shipdate = a AND l_orderkey = b AND l_linenumber < c, false) AS z FROM p)
SELECT count(*) AS n_rows, count(*) FILTER (x)::BIGINT AS time_inversions, count(*) FILTER (y)::BIGINT AS sequence_inversions,
       count(*) FILTER (z)::BIGINT AS tie_inversions, min(CASE WHEN x OR y OR z THEN pos END) AS first_bad_row,
       0::BIGINT AS null_ordering_values FROM f"""


@query("file_ordering_audit", _AUDIT_SQL)
def file_ordering_audit(spark, d):
    li = table(spark, d, "lineitem").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("pos"),
        "l_shipdate", "l_orderkey", "l_linenumber",
    )
    return E.ordering_audit(li, ["file"], "pos", ["l_shipdate", "l_orderkey", "l_linenumber"]).drop("file")


@query(
    "stream_ordering_audit",
    f"""WITH {RAW}, p AS (SELECT symbol, serial, int_time, lag(int_time) OVER w AS a FROM raw
            WINDOW w AS (PARTITION BY symbol ORDER BY serial))
        SELECT symbol, count(*) AS n_rows, count(*) FILTER (int_time < a)::BIGINT AS time_inversions,
               0::BIGINT AS sequence_inversions, 0::BIGINT AS tie_inversions,
               min(CASE WHEN int_time < a THEN serial END) AS first_bad_row, 0::BIGINT AS null_ordering_values
        FROM p GROUP BY symbol""",
)
def stream_ordering_audit(spark, d):
    rows = raw_rows(spark, d).withColumn("pos", F.col("serial"))
    return E.ordering_audit(rows, ["symbol"], "pos", ["int_time", "serial"])


@query(
    "signed_flow",
    f"""WITH {RAW} SELECT date, symbol, sum(CASE bsflag WHEN 'B' THEN 1 WHEN 'S' THEN -1 ELSE 0 END)::DOUBLE
          / count(*) AS factor_ofi, count(*) AS ofi_n_events FROM raw GROUP BY date, symbol""",
)
def signed_flow(spark, d):
    return E.signed_flow(raw_rows(spark, d), ["date", "symbol"], "bsflag", "B", "S")


@query(
    "date_spellings",
    """SELECT o_orderkey, true AS iso_ok, false AS dotted_iso_ok, strftime(o_orderdate, '%Y-%m-%d') AS parsed FROM orders""",
)
def date_spellings(spark, d):
    o = table(spark, d, "orders").select(
        "o_orderkey", day_text("o_orderdate").alias("iso"), F.date_format("o_orderdate", "yyyy.MM.dd").alias("dotted")
    )
    return o.select(
        "o_orderkey", is_iso_date("iso").alias("iso_ok"), is_iso_date("dotted").alias("dotted_iso_ok"),
        F.date_format(parse_day("dotted"), "yyyy-MM-dd").alias("parsed"),
    )


@query(
    "csv_export",
    f"""WITH {RAW} SELECT symbol, count(*) AS n_rows, sum(trade_volume)::BIGINT AS qty FROM raw
        WHERE type = 'T' AND trade_type <> 'C' GROUP BY symbol""",
)
def csv_export(spark, d):
    trades = raw_rows(spark, d).where((F.col("type") == "T") & (F.col("trade_type") != "C"))
    trades = trades.select("symbol", "serial", "int_time", "buy_id", "sell_id", "trade_price", "trade_volume")
    path = new_path(spark, "trades-csv")
    io.write_csv(trades, path)
    back = io.read_tree(spark, path, "*.csv", trades.schema)
    return back.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("trade_volume").alias("qty"))
