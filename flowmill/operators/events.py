"""Raw messages to ordered event stream, canonical events and causal features."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from flowmill.functions import market as M
from flowmill.functions.scalars import all_of, clip, col, is_finite, zero_fill
from flowmill.operators import blocks as B

ORDER_LOCAL_V1 = "local_time_v1"
ORDER_EXCHANGE_V2 = "exchange_time_sequence_v2"
TRANSFORM_BACKFILL_V1 = "ew_vwap_future_backfill_v1"
TRANSFORM_CAUSAL_V2 = "ew_vwap_causal_nan_v2"

# The required raw columns with type and default.
RAW_COLUMNS: dict[str, tuple[str, object]] = {
    "symbol": ("string", ""),
    "int_time": ("long", 0),
    "local_time": ("long", 0),
    "exchange_time": ("long", 0),
    "serial": ("long", 0),
    "trade_type": ("string", "0"),
    "order_type": ("string", "0"),
    "orderorino": ("long", 0),
    "sell_id": ("long", 0),
    "buy_id": ("long", 0),
    "bsflag": ("string", ""),
    "trade_price": ("long", 0),
    "order_price": ("long", 0),
    "trade_volume": ("long", 0),
    "order_volume": ("long", 0),
}
_NEVER_FILLED = ("int_time", "local_time", "exchange_time", "serial")


def standardize(df: DataFrame, is_trade: bool, mapping: dict[str, str] | None = None) -> DataFrame:
    """Rename vendor columns, add missing ones with typed defaults, cast and fill."""
    df = df.withColumnsRenamed({k: v for k, v in (mapping or {}).items() if k in df.columns})
    out = []
    for name, (kind, default) in RAW_COLUMNS.items():
        if name not in df.columns:
            value = "O" if name == "order_type" and not is_trade else default
            out.append(F.lit(value).cast(kind).alias(name))
            continue
        c = F.col(name).cast(kind)
        if name == "symbol":
            c = F.substring(zero_fill(c), 1, 6)
        elif name == "bsflag":
            c = F.coalesce(F.upper(c), F.lit(""))
        elif name not in _NEVER_FILLED:
            c = F.coalesce(c, F.lit(default).cast(kind))
        out.append(c.alias(name))
    rest = [c for c in df.columns if c not in RAW_COLUMNS]
    return df.select(*out, *rest)


def normalise_dtypes(df: DataFrame) -> DataFrame:
    """Parquet uint64 arrives as ``decimal(20,0)`` and raw text as binary; undo both."""
    def fix(field: T.StructField) -> Column:
        c = F.col(field.name)
        if isinstance(field.dataType, T.DecimalType) and field.dataType.scale == 0:
            return c.cast("long").alias(field.name)
        if isinstance(field.dataType, T.BinaryType):
            return c.cast("string").alias(field.name)
        return c
    return df.select(*[fix(f) for f in df.schema.fields])


def split_combined(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trade part and order part of a combined archive."""
    if "type" in df.columns:
        kind = F.upper(F.col("type").cast("string"))
        return df.where(kind == "T"), df.where(kind == "O")

    def leg(prefix: str) -> DataFrame:
        volume = F.coalesce(F.col(f"{prefix}_volume"), F.lit(0)) > 0
        named = F.coalesce(F.col(f"{prefix}_type").cast("string"), F.lit("")) != ""
        return df.where(volume | named)

    return leg("trade"), leg("order")


def market_rows(
    trades: DataFrame, orders: DataFrame, cut_time: int = 150_100_000, cut_serial: int | None = None
) -> DataFrame:
    """Tagged union of both legs before a cut time (and serial), all symbols at once."""
    legs = []
    for rank, (tag, leg) in enumerate((("T", trades), ("O", orders))):
        leg = leg.where(F.col("int_time") < cut_time)
        if cut_serial is not None:
            leg = leg.where(F.col("serial") < cut_serial)
        legs.append(leg.withColumns({"type": F.lit(tag), "src_rank": F.lit(rank)}))
    return legs[0].unionByName(legs[1], allowMissingColumns=True)


def order_columns(version: str = ORDER_EXCHANGE_V2) -> list[str]:
    """Sort key of an ordering version; ``src_rank`` puts trades before orders on ties."""
    if version == ORDER_LOCAL_V1:
        return ["local_time", "src_rank", "serial"]
    if version == ORDER_EXCHANGE_V2:
        return ["int_time", "serial", "src_rank"]
    raise ValueError(f"unsupported event ordering version {version!r}")


def event_stream(rows: DataFrame, version: str = ORDER_EXCHANGE_V2) -> DataFrame:
    """Ordered event stream per ``(date, symbol)`` with ordinal and clipped time step."""
    if "src_rank" not in rows.columns:
        rows = rows.withColumn("src_rank", F.when(F.col("type") == "T", 0).otherwise(1))
    trade = F.col("type") == "T"
    work = rows.select(
        "date", "symbol", "market", "type", "int_time", "local_time", "serial", "src_rank",
        M.session_phase("int_time").alias("session_phase"),
        M.message_type("type", "trade_type", "order_type").alias("event_type"),
        M.side_name("bsflag").alias("side"),
        F.when(trade, F.col("trade_price")).otherwise(F.col("order_price")).alias("price"),
        F.when(trade, F.col("trade_volume")).otherwise(F.col("order_volume")).alias("volume"),
        "orderorino", "buy_id", "sell_id",
    )
    # the content decides between rows that the version's key leaves equal, so a retried task numbers alike
    content = ["type", "price", "volume", "orderorino", "buy_id", "sell_id", "side"]
    work = B.running(
        work, ["date", "symbol"], [*order_columns(version), *content],
        {"event_idx": B.number(), "__prev": B.previous(F.col("int_time"))},
    )
    step = F.coalesce(F.col("int_time") - F.col("__prev"), F.lit(0).cast("long"))
    return work.withColumns({
        "event_idx": F.col("event_idx") - 1,
        "delta_t": F.greatest(step, F.lit(0).cast("long")),
        "log_volume": F.log1p(F.greatest(F.col("volume"), F.lit(0)) / 100.0),
    }).drop("__prev", "src_rank")


# Canonical column order.
CANONICAL_V1 = (
    "schema_version", "date", "exchange", "market", "symbol", "security_id", "board", "session",
    "event_source", "evt_type", "side", "price", "qty", "amount", "order_type", "level", "delta_t",
    "int_time", "local_time", "source_seqnum", "event_idx", "quality_flag",
)
BOOK_COLUMNS = (
    "book_valid_post", "spread_ticks_post", "microprice_delta_ticks_post", "imbalance_l1_post",
    "imbalance_l5_post", "imbalance_l10_post", "log_bid_depth_l5_post", "log_ask_depth_l5_post",
    "event_price_distance_ticks_pre",
)
CANONICAL_V2 = (*CANONICAL_V1, "exchange_seqnum", "time_of_day_ms", *BOOK_COLUMNS)


def canonical_v1(stream: DataFrame) -> DataFrame:
    """Project the event stream to the 22 canonical columns (prices in yuan)."""
    price = F.col("price").cast("double") / M.PRICE_SCALE
    qty = F.col("volume").cast("double")
    code = zero_fill("symbol")
    values = {
        "schema_version": F.lit("v1"),
        "date": F.col("date"),
        "exchange": M.exchange_code("market"),
        "market": F.lit("A_SHARE"),
        "symbol": F.concat(code, F.lit("."), F.when(F.upper("market") == "SH", "SH").otherwise("SZ")),
        "security_id": code,
        "board": M.board_name("symbol", "market"),
        "session": M.recode("session_phase", M.SESSION_MAP, "UNKNOWN"),
        "event_source": F.when(F.col("event_type") == "TRADE", "TRADE").otherwise("ORDER"),
        "evt_type": M.recode("event_type", M.EVENT_TYPE_MAP, "UNKNOWN"),
        "side": M.recode("side", M.SIDE_MAP, "N"),
        "price": price,
        "qty": qty,
        "amount": price * qty,
        "order_type": M.order_kind("event_type"),
        "level": F.lit(0),
        "delta_t": F.col("delta_t").cast("long"),
        "int_time": F.col("int_time").cast("long"),
        "local_time": F.col("local_time").cast("long"),
        "source_seqnum": F.col("serial").cast("long"),
        "event_idx": F.col("event_idx").cast("long"),
        "quality_flag": F.lit(0),
    }
    return stream.select(*[values[name].alias(name) for name in CANONICAL_V1])


def canonical_v2(stream: DataFrame, book: DataFrame) -> DataFrame:
    """Canonical v1 plus post-event book features, joined on ``(date, symbol, event_idx)``.

    The reference aligns the two tables by position; a key join says the same and
    survives any partitioning. An event without book state fails the job.
    """
    keys = ["date", "security_id", "event_idx"]
    book = book.withColumnRenamed("symbol", "security_id")
    have = set(book.columns)
    book = book.select(*keys, *[
        F.col(c) if c in have else F.lit(None).cast("double").alias(c) for c in BOOK_COLUMNS
    ])
    base = canonical_v1(stream).withColumns({
        "schema_version": F.lit("v2"),
        "exchange_seqnum": F.col("source_seqnum"),
        "time_of_day_ms": M.packed_to_ms("int_time"),
    })
    present = F.col("book_valid_post")
    checked = F.when(present.isNotNull(), present).otherwise(
        F.raise_error(F.lit("event without post-event book state")).cast("boolean")
    )
    return base.join(book, keys, "left").withColumn("book_valid_post", checked).select(*CANONICAL_V2)


def canonical(stream: DataFrame, version: str, book: DataFrame | None = None) -> DataFrame:
    if version == "v1":
        return canonical_v1(stream)
    if version == "v2" and book is not None:
        return canonical_v2(stream, book)
    raise ValueError(f"cannot build canonical version {version!r}" + (" without book state" if version == "v2" else ""))


def schema_versions(df: DataFrame) -> DataFrame:
    """Row counts per schema version; more than one row means mixed data."""
    return df.groupBy("schema_version").agg(F.count(F.lit(1)).alias("n_rows"))


def ew_vwap(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    price: str,
    qty: str,
    is_trade: Column,
    ms: str,
    half_life_ms: float = 5000.0,
    version: str = TRANSFORM_CAUSAL_V2,
    out: str = "mid",
    width: int | None = None,
    sorted_clock: bool = False,
    weight: str | None = None,
) -> DataFrame:
    """Exponentially weighted trade price with a time half-life, in event order.

    Numerator and denominator decay alike, so both are running sums of
    ``2^(t / half_life)`` weights. Time is rebased every 500 half-lives to stay in
    double range; one total per rebase block is carried into the next block, and
    anything older weighs below 2^-500. Before the first trade the first valid
    price seen so far stands in.

    A step back from one trade to the next counts as no time: the decay runs on the total of the
    forward steps. ``sorted_clock`` spares the passes that add them up, where the order of the
    rows is that of the clock anyway. ``weight`` names a column for the decayed quantity behind a row's value: a later
    stretch of events goes on from a trade of that quantity and price (null where no trade has been in reach).
    """
    if half_life_ms <= 0 or not math.isfinite(half_life_ms):
        raise ValueError("the half-life has to be a positive number of milliseconds")
    if version not in (TRANSFORM_CAUSAL_V2, TRANSFORM_BACKFILL_V1):
        raise ValueError(f"unsupported transform version {version!r}")
    keys, order = list(keys), list(order)
    span = 500.0 * half_life_ms
    p, q, t = F.col(price), F.col(qty), F.col(ms)
    priced = is_finite(p) & (p > 0)
    trade = is_trade & priced & (q > 0)
    if sorted_clock:
        work = df.withColumn("__clock", t)
    else:
        work = B.running(df, keys, order, {"__from": B.earlier(F.when(trade, t))}, width=width)
        forward = F.when(trade, F.greatest(t - F.coalesce(F.col("__from"), t), F.lit(0)))
        work = B.running(work, keys, order, {"__clock": B.total(forward)}, width=width).drop("__from")
        work = work.withColumn("__clock", F.coalesce("__clock", F.lit(0)))
    clock = F.col("__clock")
    work = work.withColumn("__era", F.floor(clock / span).cast("long"))
    gained = (clock - F.col("__era") * span) / half_life_ms
    own = F.when(trade, q * F.pow(F.lit(2.0), gained))
    work = work.withColumns({"__w": own, "__wp": own * p})
    at = F.struct(*[F.col(c) for c in order])

    eras = work.groupBy(*keys, "__era").agg(F.sum("__w").alias("__den"), F.sum("__wp").alias("__num"))
    chain = Window.partitionBy(*keys).orderBy("__era")
    adjacent = F.lag("__era").over(chain) == F.col("__era") - 1
    for part in ("__den", "__num"):
        carried = F.when(adjacent, F.lag(part).over(chain) * 2.0**-500)
        eras = eras.withColumn(f"{part}_in", F.coalesce(carried, F.lit(0.0)))
    close = (F.col("__num") + F.col("__num_in")) / (F.col("__den") + F.col("__den_in"))
    eras = eras.withColumn("__close", F.when(F.col("__den") > 0, close))
    past = chain.rowsBetween(Window.unboundedPreceding, -1)
    eras = eras.withColumn("__open", F.last("__close", ignorenulls=True).over(past))
    eras = eras.select(*keys, "__era", "__den_in", "__num_in", "__open")
    seeds = work.where(priced).groupBy(*keys).agg(F.min(F.struct(at.alias("at"), p.alias("p"))).alias("__seed"))

    work = B.running(
        work, [*keys, "__era"], order, {"__d": B.total(F.col("__w")), "__n": B.total(F.col("__wp"))},
        width=width,
    )
    work = work.join(eras, [*keys, "__era"], "left").join(seeds, keys, "left")
    ratio = F.when(
        F.col("__d") > 0,
        (F.col("__n") + F.col("__num_in")) / (F.col("__d") + F.col("__den_in")),
    )
    if version == TRANSFORM_BACKFILL_V1:
        seed = F.coalesce(F.col("__seed")["p"], F.lit(1.0))
    else:
        seed = F.when(at >= F.col("__seed")["at"], F.col("__seed")["p"])
    mid = F.coalesce(ratio, F.col("__open"), seed)
    if weight:
        work = work.withColumn(weight, F.when(F.col("__d") > 0, (F.col("__d") + F.col("__den_in")) * F.pow(F.lit(2.0), -gained)))
    return work.withColumn(out, mid).drop(
        "__clock", "__era", "__w", "__wp", "__d", "__n", "__den_in", "__num_in", "__open", "__seed"
    )


def derived_features(
    canon: DataFrame, half_life_ms: float = 5000.0, version: str = TRANSFORM_CAUSAL_V2, sorted_clock: bool = False
) -> DataFrame:
    """Add ``mid``, ``price_rel``, ``log_volume`` and ``log_delta_t`` to canonical events.

    ``sorted_clock`` may be set for streams in exchange order, whose clock never steps back.
    """
    keys, order = ["date", "security_id"], ["event_idx"]
    work = canon.withColumn("__ms", M.packed_to_ms("int_time"))
    work = ew_vwap(
        work, keys, order, "price", "qty", F.col("evt_type") == "EXEC", "__ms", half_life_ms, version,
        width=B.ROWS_PER_BLOCK, sorted_clock=sorted_clock,
    )
    work = B.running(work, keys, order, {"__pms": B.previous(F.col("__ms"))}, width=B.ROWS_PER_BLOCK)
    usable = is_finite("price") & (F.col("price") > 0) & (F.col("mid") > 0)
    rel = F.when(usable, F.log(clip(F.col("price") / F.col("mid"), 1e-6, 1e6)))
    if version == TRANSFORM_BACKFILL_V1:
        rel = F.coalesce(rel, F.lit(0.0))
    step = F.greatest(F.coalesce(F.col("__ms") - F.col("__pms"), F.lit(0)), F.lit(0))
    return work.withColumns({
        "price_rel": rel,
        "log_volume": F.log1p(F.greatest(F.col("qty"), F.lit(0.0)) / 100.0),
        "log_delta_t": F.log1p(step.cast("double")),
    }).drop("__ms", "__pms")


def ordering_audit(df: DataFrame, keys: Sequence[str], position: str, order: Sequence[str]) -> DataFrame:
    """Inversions along the stored row order, one row per ``keys`` (for example per file).

    ``order`` is ``[time, sequence]`` or ``[time, sequence, event_idx]``.
    """
    order = list(order)
    nulls = [F.col(c).isNull() for c in order]
    work = B.running(
        df.select(*keys, position, *order), list(keys), [position],
        {"__p": B.previous(F.struct(*[F.col(c) for c in order]))},
        width=B.ROWS_PER_BLOCK,
    )
    prev = F.col("__p")
    has = prev.isNotNull()
    names = ("time_inversions", "sequence_inversions", "tie_inversions")
    bad = {}
    for depth, name in enumerate(names):
        if depth >= len(order):
            bad[name] = F.lit(False)
            continue
        equal = [F.col(c) == prev[c] for c in order[:depth]]
        bad[name] = F.coalesce(all_of([has, *equal, F.col(order[depth]) < prev[order[depth]]]), F.lit(False))
    anybad = bad[names[0]] | bad[names[1]] | bad[names[2]]
    return work.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(bad[n]).alias(n) for n in names],
        F.min(F.when(anybad, F.col(position))).alias("first_bad_row"),
        F.sum(sum((n.cast("long") for n in nulls), F.lit(0))).alias("null_ordering_values"),
    )


def signed_flow(df: DataFrame, keys: Sequence[str], side: str, buy: object, sell: object) -> DataFrame:
    """Mean signed side per group and the number of events behind it."""
    s = col(side)
    sign = F.when(s == buy, 1).when(s == sell, -1).otherwise(0)
    return df.groupBy(*keys).agg(
        (F.sum(sign) / F.count(F.lit(1))).alias("factor_ofi"), F.count(F.lit(1)).alias("ofi_n_events")
    )


def domain_violations(events: DataFrame, columns: Sequence[str] = tuple(M.DOMAINS)) -> DataFrame:
    """``(column, value, n)``: values of canonical columns that the published schema does not know; null counts as one."""
    pairs = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"), F.coalesce(F.col(c).isin(*M.DOMAINS[c]), F.lit(False)).alias("known"))
        for c in columns
    ])
    strange = events.select(F.explode(F.filter(pairs, lambda x: ~x["known"])).alias("x"))
    return strange.groupBy(F.col("x.column").alias("column"), F.col("x.value").alias("value")).agg(F.count(F.lit(1)).alias("n"))
