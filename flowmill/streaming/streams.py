"""Structured Streaming forms of the incremental operators.

Native windows keep their state in Spark's state store. Operators whose state is a
small record per key (decayed sums, vector tails, processed days) run in
``foreachBatch`` as ordinary joins against a versioned state table: batch ``n``
reads version ``n - 1`` and writes version ``n``, so a repeated batch writes
the same thing, and no key's rows pass through a single task. All of it lies in a
``StreamStore``: the same path resumes a stream, also in another process.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from flowmill.functions import market as M
from flowmill.functions.scalars import is_finite
from flowmill.operators import blocks as B, events as E
from flowmill.operators.splits import keep_by
from flowmill.session import new_path
from flowmill.streaming.store import BatchLog, StreamStore

Start = Callable[[DataFrame], StreamingQuery]


def replay(spark: SparkSession, arrivals: Sequence[DataFrame], start: Start) -> None:
    """Let groups of files arrive one after another; the query resumes from its checkpoint each time."""
    path = new_path(spark, "arrivals")
    for group in arrivals:
        group.write.mode("append").parquet(path)
        stream = spark.readStream.schema(arrivals[0].schema).parquet(path)
        start(stream).awaitTermination()


def _start(df: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    return (
        df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
        .foreachBatch(each).trigger(availableNow=True).start()
    )


# --- native windows -----------------------------------------------------------


def clock_windows(store: StreamStore, delay: str = "1 day") -> Start:
    """Counts and volume per instrument, day and session-clock interval, updated per batch in ``store.log()``."""

    def start(stream: DataFrame) -> StreamingQuery:
        ms = M.packed_to_ms(M.packed_time("ts"))
        out = (
            stream.withWatermark("ts", delay)
            .groupBy(F.window("ts", "1 day").alias("day"), "symbol", M.clock_interval(ms).alias("clock_interval"))
            .agg(F.count(F.lit(1)).alias("n_events"), F.sum("qty").alias("qty"))
            .select(F.date_format("day.start", "yyyy-MM-dd").alias("date"), "symbol", "clock_interval", "n_events", "qty")
        )
        return _start(out, store.checkpoint, store.log().write, "update")

    return start


def sliding_windows(store: StreamStore, size: str, slide: str, delay: str = "1 day") -> Start:
    """Counts and volume per kind and sliding window, updated per batch in ``store.log()``."""

    def start(stream: DataFrame) -> StreamingQuery:
        out = (
            stream.withWatermark("ts", delay).groupBy(F.window("ts", size, slide).alias("w"), "kind")
            .agg(F.count(F.lit(1)).alias("n_events"), F.sum("qty").alias("qty"))
            .select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "kind", "n_events", "qty")
        )
        return _start(out, store.checkpoint, store.log().write, "update")

    return start


def newest(table: BatchLog, keys: Sequence[str]) -> DataFrame:
    """Last emitted row per key of an update stream."""
    return keep_by(table.all(), keys, F.col("batch")).drop("batch")


# --- incremental scoring ------------------------------------------------------


def new_day_scores(
    store: StreamStore, out: str, score: Callable[[DataFrame], DataFrame], keys: Sequence[str], closed_after: int | None = None
) -> Start:
    """Score the days of each batch from all their rows so far; each day is one idempotent partition of the sink.

    Rows are kept by day and batch, and a batch reads the earlier rows of its own days only. ``keys`` tell the rows of a
    day apart: a row that arrives again counts once, and a day without new rows is not written again. With
    ``closed_after`` a day (``yyyy-MM-dd``) that lies more than so many days behind the newest one of earlier batches is
    closed: its late rows go to ``store.log("late")`` and change no score.
    """
    spark = store.spark
    path = f"{store.path}/day-rows"

    def each(df: DataFrame, batch: int) -> None:
        schema = StructType([*df.schema.fields, StructField("batch", LongType())])
        newest = store.state("newest-day")
        was = newest.version(batch - 1)
        high = was.first()["day"] if was is not None else None
        if closed_after is not None:
            late = F.coalesce(F.datediff(F.lit(high), F.col("date")) > closed_after, F.lit(False)) if high else F.lit(False)
            store.log("late").write(df.where(late), batch)
            df = df.where(~late)
        fresh = df.dropDuplicates(["date", *keys])
        # a batch's days are few: as literals they choose the folders that are read at all
        days = [r["date"] for r in fresh.select("date").distinct().collect()]
        own = F.col("date").isin([d for d in days if d is not None]) | (F.col("date").isNull() & F.lit(None in days))
        earlier = store.rows("day-rows", schema) if batch > 0 else None
        if earlier is not None:
            earlier = earlier.where(own & (F.col("batch") < batch)).drop("batch")
            same = F.lit(True)
            for c in ("date", *keys):
                same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
            fresh = fresh.alias("a").join(earlier.select("date", *keys).alias("b"), same, "left_anti")
        fresh = fresh.withColumn("batch", F.lit(batch).cast("long"))
        fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "batch").parquet(path)
        kept = store.rows("day-rows", schema)
        now = kept.where(own & (F.col("batch") == batch)).select("date").distinct().collect() if kept is not None else []
        changed = [r["date"] for r in now]
        if changed:
            again = F.col("date").isin([d for d in changed if d is not None]) | (F.col("date").isNull() & F.lit(None in changed))
            scored = score(kept.where(again & (F.col("batch") <= batch)).drop("batch"))
            scored.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(out)
        high = max([d for d in [high, *days] if d is not None], default=None)
        newest.write(spark.createDataFrame([(high,)], "day string"), batch)

    return lambda stream: _start(stream, store.checkpoint, each)


# --- keyed state --------------------------------------------------------------


def running_vwap(store: StreamStore, half_life_s: float) -> Start:
    """Decayed price and volume sums per instrument, carried from batch to batch.

    The sums of one batch are order-free once taken relative to the instrument's last
    trade time, so they are a partial aggregate; the old state is then decayed to the
    same time and added. The state is ``store.state()``.
    """
    state = store.state()

    def decay(t, ref):
        return F.pow(F.lit(2.0), (t - ref) / half_life_s)

    def each(df: DataFrame, batch: int) -> None:
        trades = df.where((F.col("kind") == "purchase") & (F.col("qty") > 0) & (F.col("price") > 0))
        trades = trades.select("symbol", "price", "qty", F.col("ts").cast("double").alias("t"))
        trades = B.with_group_stats(trades, ["symbol"], at=F.max("t"))
        w = F.col("qty") * decay(F.col("t"), F.col("at"))
        part = trades.groupBy("symbol").agg(F.max("at").alias("at"), F.sum(w * F.col("price")).alias("num"), F.sum(w).alias("den"))
        old = state.version(batch - 1)
        if old is not None:
            was = old.select("symbol", *[F.col(c).alias(f"o_{c}") for c in ("at", "num", "den")])
            both = part.join(was, "symbol", "full_outer")
            at = F.greatest("at", "o_at")
            zero = lambda c: F.coalesce(c, F.lit(0.0))
            merged = {
                c: zero(F.col(c) * decay(F.col("at"), at)) + zero(F.col(f"o_{c}") * decay(F.col("o_at"), at))
                for c in ("num", "den")
            }
            part = both.select("symbol", at.alias("at"), *[e.alias(c) for c, e in merged.items()])
        state.write(part.withColumn("mid", F.col("num") / F.col("den")), batch)

    return lambda stream: _start(stream, store.checkpoint, each)


def event_vwap(
    store: StreamStore, keys: Sequence[str], order: str, price: str, qty: str, is_trade: Column, ms: str, half_life_ms: float,
    idle_ms: float | None = None, width: int | None = None,
) -> Start:
    """The exponentially weighted trade price behind every event, as ``events.ew_vwap`` gives it over the whole table.

    Results, with the price in ``mid``, go to ``store.log("events")`` by batch. A key's state is one event: a trade of the
    decayed quantity at the weighted price, or, before the first trade, the first price seen. It stands before the key's
    new events, and a prefix scan over both gives their values and the next state, whatever the number of events of a key.

    ``order`` (whole numbers) ascends through the stream within a key; an event at or below the last one known goes to
    ``store.log("late")`` unchanged, as its value could not be given without changing later ones. With ``idle_ms`` the
    state of a key whose last event lies so far behind the newest one of the stream is dropped; the key starts anew.
    """
    state = store.state()
    own = [*keys, order, "__trade", "__price", "__qty", "__ms"]

    def each(df: DataFrame, batch: int) -> None:
        events = df.withColumns({
            "__trade": F.coalesce(is_trade, F.lit(False)), "__price": F.col(price).cast("double"), "__qty": F.col(qty).cast("double"),
            "__ms": F.col(ms).cast("double"), "__new": F.lit(True),
        })
        old = state.version(batch - 1)
        if old is not None:
            last = old.select(*keys, F.col(order).alias("__last"))
            same = F.lit(True)
            for c in keys:
                same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
            joined = events.alias("a").join(last.alias("b"), same, "left").select("a.*", "b.__last")
            late = F.coalesce(F.col(order) <= F.col("__last"), F.lit(False))
            store.log("late").write(joined.where(late).select(*df.columns), batch)
            events = joined.where(~late).drop("__last")
            # the state's event stands before the new ones of its key
            events = events.unionByName(old.select(*own, F.lit(False).alias("__new")), allowMissingColumns=True)
        else:
            store.log("late").write(df.limit(0), batch)
        scanned = E.ew_vwap(events, keys, [order], "__price", "__qty", F.col("__trade"), "__ms", half_life_ms, width=width, weight="__weight")
        results = store.log("events")
        # state events are written along, so that the next state comes from the same scan
        results_rows = scanned.select(*df.columns, *[c for c in own if c not in df.columns], "mid", "__weight", "__new")
        scan = store.log("scan")
        scan.write(results_rows, batch)
        rows = store.spark.read.parquet(f"{scan.path}/batch={batch}")
        results.write(rows.where("__new").select(*df.columns, "mid"), batch)
        priced = is_finite("__price") & (F.col("__price") > 0)
        trade = F.col("__trade") & priced & (F.col("__qty") > 0)
        newest = F.struct(F.col(order).alias("at"), "__price", "__qty", "__ms", "mid", "__weight")
        by_key = rows.groupBy(*keys).agg(
            F.max(order).alias(order), F.max("__ms").alias("__seen"), F.max(F.when(trade, newest)).alias("t"), F.min(F.when(priced, newest)).alias("p")
        )
        made = by_key.select(
            *keys, order, F.col("t").isNotNull().alias("__trade"), F.coalesce("t.mid", "p.__price").alias("__price"),
            F.coalesce(F.col("t.__weight"), F.lit(0.0)).alias("__qty"), F.coalesce("t.__ms", "p.__ms", "__seen").alias("__ms"), "__seen",
        )
        if idle_ms is not None:
            high = made.agg(F.max("__seen").alias("high"))
            made = made.join(F.broadcast(high), F.col("__seen") >= F.col("high") - idle_ms).drop("high")
        state.write(made, batch)

    return lambda stream: _start(stream, store.checkpoint, each)


def running_pool(store: StreamStore, key: str, order: str, vec: str, last_k: int) -> Start:
    """Vector sum, count and the last ``last_k`` vectors per key, carried from batch to batch in ``store.state()``."""
    state = store.state()

    def newest_first(c):
        return F.slice(F.sort_array(c, asc=False), 1, last_k)

    def each(df: DataFrame, batch: int) -> None:
        v = F.col(vec).cast("array<double>")
        rows = df.select(key, order, v.alias("v"))
        sums = rows.select(key, array_to_vector("v").alias("x")).groupBy(key).agg(
            vector_to_array(Summarizer.sum(F.col("x"))).alias("total"), F.count(F.lit(1)).alias("n")
        )
        # A bounded top-k per key: Spark prunes to k rows per task before the shuffle.
        rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))
        tail = rows.withColumn("r", rank).where(F.col("r") <= last_k).groupBy(key).agg(
            newest_first(F.collect_list(F.struct(order, "v"))).alias("tail")
        )
        part = sums.join(tail, key)
        old = state.version(batch - 1)
        if old is not None:
            was = old.select(key, *[F.col(c).alias(f"o_{c}") for c in ("total", "n", "tail")])
            both = part.join(was, key, "full_outer")
            add = F.zip_with("total", "o_total", lambda a, b: a + b)
            part = both.select(
                key, F.coalesce(add, F.col("total"), F.col("o_total")).alias("total"),
                (F.coalesce("n", F.lit(0)) + F.coalesce("o_n", F.lit(0))).alias("n"),
                newest_first(F.coalesce(F.concat("tail", "o_tail"), F.col("tail"), F.col("o_tail"))).alias("tail"),
            )
        state.write(part, batch)

    return lambda stream: _start(stream, store.checkpoint, each)


def pooled_from_state(state: DataFrame, key: str) -> DataFrame:
    """Mean and last-k mean vectors of a ``running_pool`` state."""
    size = F.size("tail")
    first = F.transform(F.col("total"), lambda x: F.lit(0.0))
    tail = F.aggregate("tail", first, lambda acc, r: F.zip_with(acc, r["v"], lambda a, b: a + b))
    return state.select(
        key, "n", F.transform("total", lambda x: x / F.col("n")).alias("mean"), F.transform(tail, lambda x: x / size).alias("last_k_mean")
    )


def late_rows(store: StreamStore, delay_s: int) -> Start:
    """Count rows older than the highest earlier event time minus the delay, per batch and day.

    Late rows are reported in ``store.log()``, never repaired; the highest event time is a one-row state.
    """
    marks, side = store.state(), store.log()

    def each(df: DataFrame, batch: int) -> None:
        old = marks.version(batch - 1)
        high = old.first()["high"] if old is not None else None
        late = F.col("ts").cast("double") < F.lit(high - delay_s) if high is not None else F.lit(False)
        side.write(
            df.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("date")).agg(
                F.count(F.lit(1)).alias("n_rows"), F.count_if(late).alias("n_late")
            ),
            batch,
        )
        seen = df.agg(F.max(F.col("ts").cast("double")).alias("high"))
        marks.write(seen.select(F.greatest("high", F.lit(high).cast("double")).alias("high")), batch)

    return lambda stream: _start(stream, store.checkpoint, each)
