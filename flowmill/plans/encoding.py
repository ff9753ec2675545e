"""Vocabulary queries: statistics, sampling, edges, tokens, storage form, distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowmill.functions.scalars import day_text
from flowmill.operators import checks as C, dictionary as D, events as E, increments as I, vocab as V
from flowmill.plans.base import table
from flowmill.plans.feed import canon
from flowmill.plans.registry import ORACLES, query, rounded, sql_round
from flowmill.session import new_path, staged
from flowmill.sources import encoded as S

_ID = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_STRATA = ["l_returnflag", "l_linestatus"]
SPECS = (
    V.FieldSpec("flag", "l_returnflag", "categorical"),
    V.FieldSpec("status", "l_linestatus", "context", applicable=("A", "N")),
    V.FieldSpec("price", "l_extendedprice", "ordinal", 32),
    V.FieldSpec("imbalance", "imbalance", "ordinal", 16, applicable=("A", "R")),
    V.FieldSpec("discount", "l_discount", "ordinal", 16, missing_token=False),
    V.FieldSpec("qty", "l_quantity", "continuous"),
)


def items(spark, d):
    """Order lines as vocabulary rows; every 13th part has no imbalance value."""
    li = table(spark, d, "lineitem")
    return li.withColumns({
        "evt_type": F.col("l_returnflag"),
        "date": day_text("l_shipdate"),
        "imbalance": F.when(
            F.col("l_partkey") % 13 != 0,
            F.round(F.col("l_tax") * 100) - F.round(F.col("l_discount") * 100) + F.col("l_quantity"),
        ),
    })


ITEMS = """
it AS (SELECT *, CASE WHEN l_partkey % 13 <> 0 THEN round(l_tax * 100) - round(l_discount * 100) + l_quantity END AS imbalance,
         strftime(l_shipdate, '%Y-%m-%d') AS date FROM lineitem)"""

# field -> (value expression, applicability, bins, lower quantile)
_NUM = {
    "price": ("l_extendedprice", "true", 32, 0.0),
    "imbalance": ("imbalance", "l_returnflag IN ('A', 'R')", 16, 0.01),
    "discount": ("l_discount", "true", 16, 0.0),
}


def _edges_sql(name):
    x, ok, n, lo = _NUM[name]
    probs = "[" + ", ".join(f"{i / n!r}::DOUBLE" for i in range(1, n)) + "]"
    return f"""
{name}_e AS (SELECT round(quantile_cont({x}, {lo}), 10) AS lo, round(quantile_cont({x}, 0.99), 10) AS hi FROM it WHERE {ok} AND {x} IS NOT NULL),
{name}_c AS (SELECT least(greatest({x}, lo), hi) AS v, lo, hi FROM it, {name}_e WHERE {ok} AND {x} IS NOT NULL),
{name}_n AS (SELECT min(v) FILTER (v > lo) AS after, max(v) FILTER (v < hi) AS before, any_value(lo) AS lo, any_value(hi) AS hi FROM {name}_c),
{name}_q AS (SELECT round(unnest(quantile_cont(v, {probs})), 10) AS q FROM {name}_c),
{name}_x AS (SELECT DISTINCT edge FROM (SELECT CASE WHEN q <= lo THEN (lo + after) / 2 WHEN q >= hi THEN (before + hi) / 2 ELSE q END AS edge,
      lo, hi FROM {name}_q, {name}_n) WHERE edge > lo AND edge < hi),
{name}_l AS (SELECT list(edge ORDER BY edge) AS edges FROM {name}_x)"""


EDGES = ITEMS + "," + ",".join(_edges_sql(n) for n in _NUM)


def _bin_sql(name):
    x, ok, _, _ = _NUM[name]
    return f"CASE WHEN {ok} AND {x} IS NOT NULL THEN len(list_filter({name}_l.edges, lambda e: e <= {x})) END"


def fitted(spark, d):
    return V.fit_vocab(items(spark, d), SPECS)


@query(
    "vocab_field_stats",
    f"""WITH {ITEMS}, l AS (SELECT 'price' AS field, l_extendedprice AS v, true AS ok FROM it
          UNION ALL SELECT 'imbalance', imbalance, l_returnflag IN ('A', 'R') FROM it
          UNION ALL SELECT 'discount', l_discount, true FROM it UNION ALL SELECT 'qty', l_quantity, true FROM it)
        SELECT field, count(v) AS n_observed, count(*) - count(v) AS n_missing, {sql_round("avg(v)", 6)} AS mean,
               {sql_round("stddev_pop(v)", 6)} AS std, round(min(v), 6) AS min_value, round(max(v), 6) AS max_value
        FROM l WHERE ok GROUP BY field""",
)
def vocab_field_stats(spark, d):
    out = V.field_stats(items(spark, d), SPECS)
    return out.withColumns({c: rounded(c, 6) for c in ("mean", "std", "min_value", "max_value")})


@query(
    "vocab_category_counts",
    f"""WITH {ITEMS} SELECT 'flag' AS field, l_returnflag AS value, count(*) AS n FROM it GROUP BY 2
        UNION ALL SELECT 'status', l_linestatus, count(*) FROM it WHERE l_returnflag IN ('A', 'N') GROUP BY 2""",
)
def vocab_category_counts(spark, d):
    return V.category_counts(items(spark, d), SPECS)


_STRATUM_SQL = "'l_returnflag=' || l_returnflag || chr(31) || 'l_linestatus=' || l_linestatus || chr(31) || 'board=<MISSING_COLUMN>'"


@query(
    "stratum_counts",
    f"""WITH {ITEMS} SELECT {_STRATUM_SQL} AS stratum, count(*) AS n FROM it
        WHERE l_returnflag IN ('A', 'R') AND imbalance IS NOT NULL GROUP BY 1""",
)
def stratum_counts(spark, d):
    return V.stratum_counts(items(spark, d), SPECS[3], [*_STRATA, "board"])


@query(
    "stratum_quotas",
    f"""WITH {ITEMS}, c AS (SELECT concat_ws('{V.STRATUM_SEPARATOR}', 'l_returnflag=' || l_returnflag, 'l_linestatus=' || l_linestatus) AS stratum,
             count(*) AS n FROM it WHERE l_extendedprice IS NOT NULL GROUP BY 1),
          t AS (SELECT count(*) AS k, sum(n)::BIGINT AS total, greatest(count(*), sum(n)::BIGINT // 7) AS budget FROM c),
          d AS (SELECT stratum, n, budget - k AS spare, ((budget - k) * (n - 1)) // (total - k) AS whole,
                  ((budget - k) * (n - 1)) % (total - k) AS rest FROM c, t)
        SELECT stratum, n, (1 + whole + CASE WHEN row_number() OVER (ORDER BY rest DESC, n DESC, stratum)
               <= spare - sum(whole) OVER () THEN 1 ELSE 0 END)::BIGINT AS quota FROM d""",
)
def stratum_quotas(spark, d):
    counts = V.stratum_counts(items(spark, d), SPECS[2], _STRATA)
    strata, total = counts.agg(F.count(F.lit(1)), F.sum("n")).first()
    return V.quotas(counts, max(strata, total // 7))


_PRIORITY_SQL = (
    "('0x' || substr(sha256('0|price|' || l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey), 1, 15))::BIGINT"
)


@query(
    "priority_sample",
    f"""WITH {ITEMS}, p AS (SELECT l_returnflag, l_linestatus, l_orderkey, l_linenumber, l_partkey, {_PRIORITY_SQL} AS priority,
             count(*) OVER s AS n FROM it WINDOW s AS (PARTITION BY l_returnflag, l_linestatus))
        SELECT l_returnflag, l_linestatus, l_orderkey, l_linenumber, l_partkey, priority FROM p
        QUALIFY row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY priority) <= n // 10""",
)
def priority_sample(spark, d):
    df = items(spark, d)
    sizes = {r["stratum"]: r["n"] for r in V.stratum_counts(df, SPECS[2], _STRATA).collect()}
    out = V.priority_sample(df, SPECS[2], _STRATA, {s: n // 10 for s, n in sizes.items()}, _ID)
    return out.select(*_STRATA, "l_orderkey", "l_linenumber", "l_partkey", "priority")


@query(
    "quantile_edges",
    f"""WITH {EDGES} SELECT field, row_number() OVER (PARTITION BY field ORDER BY edge) - 1 AS i, round(edge, 8) AS edge
        FROM ({" UNION ALL ".join(f"SELECT '{n}' AS field, edge FROM {n}_x" for n in _NUM)})""",
)
def quantile_edges(spark, d):
    fields = {
        s.name: (F.when(V.usable(s), F.col(s.source)), s.n_bins, any(m in s.source for m in V.TWO_SIDED)) for s in SPECS if s.binned
    }
    rows = [(n, i, round(e, 8)) for n, edges in V.edges_of(items(spark, d), fields).items() for i, e in enumerate(edges)]
    return spark.createDataFrame(rows, "field string, i long, edge double")


@query(
    "quantile_edges_first_version",
    """WITH q AS (SELECT quantile_cont(l_extendedprice, 0.0) AS lo, quantile_cont(l_extendedprice, 0.99) AS hi,
                   quantile_cont(l_discount, 0.0) AS dlo, quantile_cont(l_discount, 0.99) AS dhi FROM lineitem),
         v AS (SELECT unnest(quantile_cont(least(greatest(l_extendedprice, lo), hi), ["""
    + ", ".join(f"{i / 16!r}::DOUBLE" for i in range(1, 16))
    + """])) AS e FROM lineitem, q)
       SELECT 'price' AS field, row_number() OVER (ORDER BY e) - 1 AS i, round(e, 8) AS edge FROM (SELECT DISTINCT e FROM v)
       UNION ALL SELECT 'discount', i, round(dlo + (dhi - dlo) * i / 14.0::DOUBLE, 8) FROM q, range(15) t(i)""",
)
def quantile_edges_first_version(spark, d):
    li = staged(table(spark, d, "lineitem").select("l_extendedprice", "l_discount"), "edges")
    rows = []
    for name, c in (("price", "l_extendedprice"), ("discount", "l_discount")):
        rows += [(name, i, round(e, 8)) for i, e in enumerate(V.quantile_edges_v1(li, c, 16))]
    return spark.createDataFrame(rows, "field string, i long, edge double")


@query(
    "bin_occupancy",
    f"""WITH {EDGES} {" UNION ALL ".join(
        f"(SELECT '{n}' AS field, b AS bin, count(*) AS n FROM (SELECT {_bin_sql(n)} AS b FROM it, {n}_l) WHERE b IS NOT NULL GROUP BY b)"
        for n in _NUM)}""",
)
def bin_occupancy(spark, d):
    v = fitted(spark, d)
    rows = [(n, i, k) for n, f in v.numeric.items() if n in _NUM for i, k in enumerate(f.occupancy) if k]
    return spark.createDataFrame(rows, "field string, bin long, n long")


_TOKENS = f"""{EDGES},
st AS (SELECT avg(l_extendedprice) AS pm, stddev_pop(l_extendedprice) AS ps, avg(l_quantity) AS qm, stddev_pop(l_quantity) AS qs,
         avg(imbalance) FILTER (l_returnflag IN ('A', 'R')) AS im, stddev_pop(imbalance) FILTER (l_returnflag IN ('A', 'R')) AS isd FROM it),
tk AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_returnflag WHEN 'A' THEN 6 WHEN 'N' THEN 7 ELSE 8 END AS tok_flag,
    CASE WHEN l_returnflag IN ('A', 'N') THEN (CASE l_linestatus WHEN 'F' THEN 6 ELSE 7 END) ELSE 2 END AS tok_status,
    coalesce({_bin_sql("price")} + 6, 2) AS tok_price_bin, coalesce({_bin_sql("imbalance")} + 6, 2) AS tok_imbalance_bin,
    coalesce({_bin_sql("discount")} + 6, 2) AS tok_discount_bin,
    least(greatest((l_extendedprice - pm) / ps, -5), 5) AS val_price, least(greatest((l_quantity - qm) / qs, -5), 5) AS val_qty,
    CASE WHEN l_returnflag IN ('A', 'R') AND imbalance IS NOT NULL THEN least(greatest((imbalance - im) / isd, -5), 5) ELSE 0 END AS val_imbalance
  FROM it, st, price_l, imbalance_l, discount_l)"""


def _token_table(spark, d):
    return V.tokenize(items(spark, d), fitted(spark, d), _ID)


@query(
    "token_table",
    f"""WITH {_TOKENS} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, tok_flag::BIGINT AS tok_flag, tok_status::BIGINT AS tok_status,
          tok_price_bin, tok_imbalance_bin, tok_discount_bin, {sql_round("val_price::FLOAT", 4)} AS val_price,
          {sql_round("val_qty::FLOAT", 4)} AS val_qty, {sql_round("val_imbalance::FLOAT", 4)} AS val_imbalance FROM tk""",
)
def token_table(spark, d):
    out = _token_table(spark, d).drop("val_discount")
    return out.withColumns({c: rounded(c, 4) for c in ("val_price", "val_qty", "val_imbalance")})


@query(
    "token_coverage",
    f"""WITH {_TOKENS},
      c AS (SELECT 'flag' AS field, 0.0::DOUBLE AS e, 0.0::DOUBLE AS m, avg((tok_flag = 1)::INT) AS u FROM tk
        UNION ALL SELECT 'status', 0, avg((tok_status = 2)::INT), avg((tok_status = 1)::INT) FROM tk
        {" ".join(f"UNION ALL SELECT '{n}', count(*) FILTER (t = 6 OR t = 6 + k)::DOUBLE / count(*) FILTER (t >= 6), avg((t = 2)::INT), 0 FROM (SELECT tok_{n}_bin AS t, len({n}_l.edges) AS k FROM tk, {n}_l)" for n in _NUM)})
      SELECT field, {sql_round("e")} AS edge_rate, {sql_round("m")} AS missing_rate, {sql_round("u")} AS unknown_rate FROM c""",
)
def token_coverage(spark, d):
    v = fitted(spark, d)
    out = V.token_coverage(V.tokenize(items(spark, d), v, []), v)
    return out.withColumns({c: rounded(c) for c in ("edge_rate", "missing_rate", "unknown_rate")})


@query(
    "missing_token_contract",
    "SELECT 'discount' AS field, count(*) FILTER (l_discount IS NULL) AS bad_rows FROM lineitem",
)
def missing_token_contract(spark, d):
    v = fitted(spark, d)
    return V.missing_violations(V.tokenize(items(spark, d), v, []), v)


@query(
    "token_storage_roundtrip",
    f"""WITH {_TOKENS}, z AS (SELECT tok_price_bin, round_even(val_price::FLOAT::DOUBLE * (32767 / 5.0::DOUBLE), 0)::BIGINT AS code FROM tk)
        SELECT tok_price_bin, count(*) AS n_rows, sum(code)::BIGINT AS code_sum FROM z GROUP BY 1""",
)
def token_storage_roundtrip(spark, d):
    v = fitted(spark, d)
    sizes = {"tok_price_bin": v.size("price"), "tok_flag": v.size("flag")}
    tokens = V.tokenize(items(spark, d), v, []).select("tok_flag", "tok_price_bin", "val_price")
    path = new_path(spark, "tokens")
    V.quantise(V.narrow_tokens(tokens, sizes), ["val_price"], v.clip).write.option("compression", "zstd").parquet(path)
    back = spark.read.parquet(path)
    return back.groupBy(F.col("tok_price_bin").cast("long").alias("tok_price_bin")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("val_price").alias("code_sum")
    )


@query(
    "dequantised_scalars",
    """WITH s AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS sd FROM lineitem),
         z AS (SELECT DISTINCT l_quantity, least(greatest((l_quantity - m) / sd, -5), 5)::FLOAT::DOUBLE AS v FROM lineitem, s)
       SELECT l_quantity, round_even(v * (32767 / 5.0::DOUBLE), 0)::SMALLINT AS code,
         (round((round_even(v * (32767 / 5.0::DOUBLE), 0) * (5.0::DOUBLE / 32767)), 4) + 0.0::DOUBLE) AS decoded FROM z""",
)
def dequantised_scalars(spark, d):
    v = fitted(spark, d)
    f = v.numeric["qty"]
    z = table(spark, d, "lineitem").select("l_quantity").distinct().withColumn(
        "val_qty", V.standardise(F.col("l_quantity"), f.mean, f.std, v.clip)
    )
    coded = V.quantise(z, ["val_qty"], v.clip).withColumn("code", F.col("val_qty"))
    return V.dequantise(coded, ["val_qty"], v.clip).select("l_quantity", "code", rounded("val_qty", 4).alias("decoded"))


@query(
    "encoded_column_ranges",
    f"""WITH {_TOKENS} SELECT 'tok_price_bin' AS "column", min(tok_price_bin)::DOUBLE AS min, max(tok_price_bin)::DOUBLE AS max, 0::BIGINT AS nulls FROM tk
        UNION ALL SELECT 'tok_status', min(tok_status)::DOUBLE, max(tok_status)::DOUBLE, 0 FROM tk""",
)
def encoded_column_ranges(spark, d):
    return C.column_ranges(_token_table(spark, d), ["tok_price_bin", "tok_status"])


@query(
    "tokens_first_version",
    """WITH q AS (SELECT list_sort(list_distinct(quantile_cont(least(l_extendedprice, hi), ["""
    + ", ".join(f"{i / 16!r}::DOUBLE" for i in range(1, 16))
    + """]))) AS edges FROM lineitem, (SELECT quantile_cont(l_extendedprice, 0.99) AS hi FROM lineitem))
       SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
         (CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 2 END)::BIGINT AS tok_side,
         1 + least(len(list_filter(edges, lambda e: round(e, 8) <= l_extendedprice)), 15) AS tok_l_extendedprice FROM lineitem, q""",
)
def tokens_first_version(spark, d):
    li = table(spark, d, "lineitem").withColumn("side", F.col("l_returnflag"))
    edges = V.quantile_edges_v1(staged(li.select("l_extendedprice"), "edges"), "l_extendedprice", 16)
    return V.tokenize_v1(li, {"side": ("A", "N")}, {"l_extendedprice": edges}, 16, _ID)


@query("causal_token_table")
def causal_token_table(spark, d):
    """The full feed path: events, causal features, vocabulary fitted on early days, tokens."""
    feats = staged(E.derived_features(staged(canon(spark, d), "canon"), 120_000.0, sorted_clock=True), "features")
    specs = (
        V.FieldSpec("evt_type", "evt_type", "categorical"), V.FieldSpec("side", "side", "categorical"),
        V.FieldSpec("session", "session", "categorical"), V.FieldSpec("price", "price_rel", "ordinal", 32),
        V.FieldSpec("volume", "log_volume", "ordinal", 32, applicable=("ADD", "EXEC")),
        V.FieldSpec("delta_t", "log_delta_t", "ordinal", 32),
    )
    train = feats.where(F.col("date") <= "2024-01-20")
    vocab = V.fit_vocab(train, specs)
    return V.tokenize(feats, vocab, ["date", "security_id", "event_idx"])


@query(
    "vocab_self_check",
    f"""WITH n AS (SELECT 4 AS t) SELECT unnest(['edges_increasing', 'one_count_per_bin', 'counts_sum_to_observed', 'bins_within_request'])
          AS check_id, 'error' AS severity, 'pass' AS status, 0::BIGINT AS bad_rows, t::BIGINT AS total_rows FROM n""",
)
def vocab_self_check(spark, d):
    v = fitted(spark, d)
    rows = [(n, list(f.edges), list(f.occupancy), f.n_observed, f.requested) for n, f in v.numeric.items()]
    fields = spark.createDataFrame(rows, "field string, edges array<double>, occupancy array<long>, n_observed long, requested int")
    return C.vocab_checks(spark, fields)


# --- fitted by periods, stored with a contract --------------------------------


def _month_counts(spark, d):
    """Counts by month in three deliveries; the first brings half of the early rows, the second brings those months whole."""
    rows = items(spark, d).withColumn("month", F.substring("date", 1, 7))
    store = I.DayCounts(spark, new_path(spark, "months"), SPECS)
    early = F.col("month") < "1995-01"
    store.add(rows.where(early & (F.col("l_orderkey") % 2 == 0)), "month")
    store.add(rows.where(early), "month")
    store.add(rows.where(~early), "month")
    return store


_EARLY = EDGES.replace("FROM lineitem)", "FROM lineitem WHERE l_shipdate < DATE '1996-07-01')", 1)


@query("incremental_edges", ORACLES["quantile_edges"].replace(EDGES, _EARLY, 1))
def incremental_edges(spark, d):
    vocab = _month_counts(spark, d).fit(last="1996-06")
    rows = [(s.name, i, round(e, 8)) for s in SPECS if s.binned for i, e in enumerate(vocab.numeric[s.name].edges)]
    return spark.createDataFrame(rows, "field string, i long, edge double")


@query(
    "month_moments",
    f"""WITH {ITEMS}, l AS (SELECT 'price' AS field, date, l_extendedprice AS v FROM it
          UNION ALL SELECT 'imbalance', date, imbalance FROM it WHERE l_returnflag IN ('A', 'R')
          UNION ALL SELECT 'discount', date, l_discount FROM it UNION ALL SELECT 'qty', date, l_quantity FROM it)
        SELECT substr(date, 1, 7) AS month, field, count(v) AS n_observed, count(*) - count(v) AS n_missing, {sql_round("sum(v)", 2)} AS total,
               {sql_round("stddev_pop(v)", 6)} AS std, round(min(v), 6) AS min_value, round(max(v), 6) AS max_value FROM l GROUP BY 1, 2""",
)
def month_moments(spark, d):
    out = _month_counts(spark, d).moments()
    out = out.withColumns({"total": F.col("mean") * F.col("n_observed"), "std": F.sqrt(F.try_divide("m2", "n_observed"))})
    return out.select(
        F.col("day").alias("month"), "field", "n_observed", "n_missing", rounded("total", 2).alias("total"),
        *[rounded(c, 6).alias(c) for c in ("std", "min_value", "max_value")],
    )


@query("incremental_token_table", ORACLES["token_table"])
def incremental_token_table(spark, d):
    """Tokens by a vocabulary merged from months, saved, and read back."""
    path = new_path(spark, "vocabulary")
    I.save_vocab(spark, _month_counts(spark, d).fit(), path)
    out = V.tokenize(items(spark, d), I.load_vocab(spark, path), _ID).drop("val_discount")
    return out.withColumns({c: rounded(c, 4) for c in ("val_price", "val_qty", "val_imbalance")})


def _encoded(spark, d):
    vocab, path = fitted(spark, d), new_path(spark, "encoded")
    S.write_tokens(V.tokenize(items(spark, d), vocab, _ID), vocab, path)
    return vocab, path


@query(
    "encoded_tokens",
    f"""WITH {_TOKENS} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, tok_price_bin,
          round_even(val_price::FLOAT::DOUBLE * (32767 / 5.0::DOUBLE), 0)::BIGINT AS price_code FROM tk WHERE tok_flag = 6""",
)
def encoded_tokens(spark, d):
    vocab, path = _encoded(spark, d)
    out = S.read_tokens(spark, path, [*_ID, "tok_price_bin", "val_price"], vocab, where="tok_flag = 6")
    return out.select(*_ID, "tok_price_bin", F.rint(F.col("val_price") * (V.QUANT_MAX / vocab.clip)).cast("long").alias("price_code"))


@query(
    "encoding_audit",
    """WITH c AS (SELECT count(*) AS n, count(*) FILTER (l_orderkey % 7 = 0) AS wrong, count(*) FILTER (l_orderkey % 11 = 0) AS gone,
             count(*) FILTER (l_partkey % 5 = 0) AS low FROM lineitem),
         r AS (SELECT unnest(['tok_flag', 'tok_status', 'tok_price_bin', 'tok_imbalance_bin', 'tok_discount_bin', 'val_price', 'val_imbalance',
             'val_discount', 'val_qty']) AS "column", n, wrong, gone, low FROM c),
         f AS (SELECT "column", n AS n_rows, CASE "column" WHEN 'tok_price_bin' THEN gone ELSE 0 END AS nulls,
             CASE "column" WHEN 'tok_flag' THEN wrong WHEN 'val_qty' THEN low ELSE 0 END AS outside FROM r)
       SELECT *, CASE WHEN nulls = 0 AND outside = 0 THEN 'pass' ELSE 'fail' END AS status FROM f""",
)
def encoding_audit(spark, d):
    """The audit of stored rows into which wrong ids, nulls and a code below the symmetric range were put."""
    _, path = _encoded(spark, d)
    rows = spark.read.parquet(f"{path}/rows").withColumns({
        "tok_flag": F.when(F.col("l_orderkey") % 7 == 0, F.lit(255)).otherwise(F.col("tok_flag")),
        "tok_price_bin": F.when(F.col("l_orderkey") % 11 != 0, F.col("tok_price_bin")),
        "val_qty": F.when(F.col("l_partkey") % 5 == 0, F.lit(-32768)).otherwise(F.col("val_qty")),
    })
    return S.audit(rows, S.read_contract(spark, path))


# --- distributions ------------------------------------------------------------


@query(
    "token_entropy",
    f"""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL),
          t AS (SELECT user_id, sum(n) AS s FROM c GROUP BY 1)
        SELECT user_id, s::BIGINT AS total, count(*) AS classes, {sql_round("-sum(n / s * ln(n / s))")} AS entropy FROM c JOIN t USING (user_id)
        GROUP BY user_id, s""",
)
def token_entropy(spark, d):
    counts = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return V.entropy(counts, ["user_id"]).withColumn("entropy", rounded("entropy"))


@query(
    "copy_baseline",
    f"""WITH p AS (SELECT event_type AS t, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
          c AS (SELECT count(*) AS k, count(*) FILTER (n = t) AS s FROM p WHERE n IS NOT NULL)
        SELECT k AS n_pairs, s AS n_same, {sql_round("(s * -ln(1 - 1e-6::DOUBLE) + (k - s) * -ln(1e-6::DOUBLE / 4)) / k", 7)} AS copy_ce FROM c""",
)
def copy_baseline(spark, d):
    out = V.copy_baseline(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type", 6)
    return out.withColumn("copy_ce", rounded("copy_ce", 7))


@query(
    "field_accuracy_report",
    f"""WITH p AS (SELECT l_linestatus AS field, l_linenumber AS target, CASE WHEN l_partkey % 3 = 0 THEN l_linenumber % 4 ELSE l_linenumber END AS pred,
               l_discount + 0.5 AS ce FROM lineitem),
          c AS (SELECT field, target, count(*) AS n, count(*) FILTER (pred = target) AS h, sum(ce) AS ce FROM p GROUP BY ALL),
          g AS (SELECT field, sum(n) AS s, sum(ce) / sum(n) AS ce, sum(h) / sum(n) AS acc, avg(h / n) AS bal FROM c GROUP BY 1),
          e AS (SELECT field, -sum(n / s * ln(n / s)) AS ent FROM c JOIN g USING (field) GROUP BY 1)
        SELECT field, s::BIGINT AS n_predictions, {sql_round("ce", 6)} AS ce, {sql_round("acc", 6)} AS top1_accuracy, {sql_round("bal", 6)} AS balanced_accuracy,
               {sql_round("ent", 6)} AS entropy, {sql_round("exp(ce)", 6)} AS perplexity, {sql_round("ce / ent", 6)} AS normalized_ce FROM g JOIN e USING (field)""",
)
def field_accuracy_report(spark, d):
    li = table(spark, d, "lineitem")
    n = F.col("l_linenumber")
    preds = li.select(
        F.col("l_linestatus").alias("field"), n.alias("target"),
        F.when(F.col("l_partkey") % 3 == 0, n % 4).otherwise(n).alias("predicted"), (-F.col("l_discount") - 0.5).alias("log_prob"),
    )
    out = V.field_report(preds)
    return out.withColumns({c: rounded(c, 6) for c in out.columns if c not in ("field", "n_predictions")})


@query(
    "category_codes",
    "SELECT event_id, (dense_rank() OVER (ORDER BY event_type) - 1)::INT AS code FROM events",
)
def category_codes(spark, d):
    return V.category_codes(table(spark, d, "events").select("event_id", "event_type"), "event_type", "code").drop("event_type")


_PERIODS = ("l_shipdate < TIMESTAMP '1995-01-01'", "l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '1997-06-01'")


def _grown(spark, d):
    """Line keys as categories, known in two periods; what ships later is only encoded."""
    li = table(spark, d, "lineitem").withColumn("pair", F.when(F.col("l_partkey") % 50 != 7, F.concat_ws("/", "l_partkey", "l_suppkey")))
    dictionary = D.Dictionary(spark, new_path(spark, "parts"))
    for period in _PERIODS:
        dictionary.grow(li.where(period), "pair")
    return li, dictionary


_DICTIONARY = f"""li AS (SELECT *, CASE WHEN l_partkey % 50 <> 7 THEN l_partkey || '/' || l_suppkey END AS pair FROM lineitem),
seen AS (SELECT pair AS value, count(*) AS n, CASE WHEN bool_or({_PERIODS[0]}) THEN 0 ELSE 1 END AS since
         FROM li WHERE pair IS NOT NULL AND (({_PERIODS[0]}) OR ({_PERIODS[1]})) GROUP BY pair),
dict AS (SELECT value, n, since::BIGINT AS since, row_number() OVER (ORDER BY since, value) - 1 AS id FROM seen)"""


@query("category_dictionary", f"WITH {_DICTIONARY} SELECT * FROM dict")
def category_dictionary(spark, d):
    """Categories with dense ids, grown by a second period that leaves the first one's ids as they are."""
    return _grown(spark, d)[1].table()


@query(
    "dictionary_tokens",
    f"""WITH {_DICTIONARY} SELECT l_orderkey, l_linenumber, CASE WHEN pair IS NULL THEN {V.SPECIAL_IDS["NA"]} ELSE coalesce(id + {V.N_SPECIAL}, {V.SPECIAL_IDS["UNK"]}) END AS token
        FROM li LEFT JOIN dict ON pair = value""",
)
def dictionary_tokens(spark, d):
    """Tokens of all rows by the grown dictionary: missing, unknown or the value's id."""
    li, dictionary = _grown(spark, d)
    rows = li.select("l_orderkey", "l_linenumber", "pair")
    return D.encode(rows, "pair", dictionary.table(), "token", V.SPECIAL_IDS["UNK"], V.SPECIAL_IDS["NA"], V.N_SPECIAL).drop("pair")


@query(
    "quantile_codes",
    """WITH e AS (SELECT round(quantile_cont(value, 0.01), 8) AS lo, round(quantile_cont(value, 0.99), 8) AS hi FROM events),
         c AS (SELECT event_id, least(greatest(value, lo), hi) AS v FROM events, e),
         q AS (SELECT list_sort(list_distinct(quantile_cont(v, ["""
    + ", ".join(f"{i / 8!r}::DOUBLE" for i in range(1, 8))
    + """]))) AS edges FROM c)
       SELECT event_id, len(list_filter(edges, lambda x: round(x, 8) < v))::INT AS code FROM c, q""",
)
def quantile_codes(spark, d):
    return V.quantile_codes(table(spark, d, "events").select("event_id", "value"), "value", 8, "code").drop("value")


@query(
    "fit_date_leaks",
    """SELECT DISTINCT strftime(l_shipdate, '%Y-%m-%d') AS date FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1999-01-01' AND TIMESTAMP '1999-06-30'""",
)
def fit_date_leaks(spark, d):
    days = items(spark, d).select("date")
    return V.leaked_dates(days.where(F.col("date") <= "1999-06-30"), days.where(F.col("date") >= "1999-01-01"))


@query(
    "routing_health",
    f"""WITH p AS (SELECT vec_id, list_transform(embedding, lambda x: abs(x::DOUBLE) + 0.01::DOUBLE) AS a FROM embeddings),
          n AS (SELECT vec_id, list_transform(a, lambda x: x / list_sum(a)) AS p FROM p),
          x AS (SELECT vec_id, unnest(p) AS p, generate_subscripts(p, 1) - 1 AS expert FROM n),
          r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, expert) AS k FROM x),
          t AS (SELECT avg(en) AS ent, avg(mx) AS mx, count(*) AS c FROM (SELECT vec_id, -sum(p * ln(p)) / ln(count(*)) AS en, max(p) AS mx FROM x GROUP BY 1))
        SELECT expert::INT AS expert, {sql_round("count(*)::DOUBLE / (2 * c)")} AS expert_fraction, {sql_round("ent", 6)} AS normalized_entropy,
               {sql_round("mx", 6)} AS mean_top1_probability FROM r, t WHERE k <= 2 GROUP BY expert, c, ent, mx""",
)
def routing_health(spark, d):
    whole = F.col("embedding").cast("array<double>")
    raw = table(spark, d, "embeddings").select(F.transform(whole, lambda x: F.abs(x) + 0.01).alias("a"))
    total = F.aggregate("a", F.lit(0.0), lambda s, x: s + x)
    probs = raw.select(total.alias("t"), "a").select(F.transform("a", lambda x: x / F.col("t")).alias("p"))
    out = V.routing_health(probs, "p", 2)
    return out.withColumns({
        "expert_fraction": rounded("expert_fraction"), "normalized_entropy": rounded("normalized_entropy", 6),
        "mean_top1_probability": rounded("mean_top1_probability", 6),
    })

