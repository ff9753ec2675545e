"""Frozen bin and category vocabularies: fit on training rows, apply to any table."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from flowmill.functions.scalars import clip, is_finite, key_digest
from flowmill.operators import blocks as B
from flowmill.operators.dictionary import encode, numbered
from flowmill.session import staged

# Reserved token ids of the second vocabulary version.
SPECIAL_IDS = {"PAD": 0, "UNK": 1, "NA": 2, "BOS": 3, "EOS": 4, "SESSION_BREAK": 5}
N_SPECIAL = len(SPECIAL_IDS)
# The first version reserves the padding id only.
N_SPECIAL_V1 = 1
# Source names that are winsorised on both sides.
TWO_SIDED = ("price_rel", "price_distance", "microprice", "imbalance", "signed_ofi")
# Fixed value: largest magnitude of a quantised scalar.
QUANT_MAX = 32767
STRATUM_SEPARATOR = "\x1f"


@dataclass(frozen=True)
class FieldSpec:
    """One vocabulary field: categorical, or numeric with an optional number of bins."""

    name: str
    source: str
    kind: str
    n_bins: int | None = None
    applicable: tuple[str, ...] = ()
    missing_token: bool = True

    def __post_init__(self) -> None:
        if self.kind not in ("categorical", "context", "ordinal", "continuous"):
            raise ValueError(f"unknown field kind {self.kind!r}")
        if (self.kind == "ordinal" and self.n_bins is None) or (not self.numeric and self.n_bins is not None):
            raise ValueError(f"field {self.name!r}: bins do not fit kind {self.kind!r}")

    @property
    def numeric(self) -> bool:
        return self.kind in ("ordinal", "continuous")

    @property
    def binned(self) -> bool:
        return self.numeric and self.n_bins is not None

    @property
    def two_sided(self) -> bool:
        return any(m in self.source for m in TWO_SIDED)

    def applies(self) -> Column:
        return F.col("evt_type").isin(*self.applicable) if self.applicable else F.lit(True)


# --- statistics ---------------------------------------------------------------


def usable(spec: FieldSpec) -> Column:
    return spec.applies() & is_finite(spec.source)


def field_stats(df: DataFrame, specs: Sequence[FieldSpec]) -> DataFrame:
    """One row per numeric field from a single scan: counts, mean, population std, range."""
    specs = [s for s in specs if s.numeric]
    aggs, rows = [], []
    for i, s in enumerate(specs):
        v = F.when(usable(s), F.col(s.source).cast("double"))
        aggs += [
            F.count(v).alias(f"n{i}"), (F.count_if(s.applies()) - F.count(v)).alias(f"x{i}"), F.avg(v).alias(f"m{i}"),
            F.stddev_pop(v).alias(f"s{i}"), F.min(v).alias(f"a{i}"), F.max(v).alias(f"z{i}"),
        ]
        std = F.when(F.col(f"s{i}") > 0, F.col(f"s{i}")).otherwise(1.0)
        rows.append(F.struct(
            F.lit(s.name).alias("field"), F.col(f"n{i}").alias("n_observed"), F.col(f"x{i}").alias("n_missing"),
            F.coalesce(F.col(f"m{i}"), F.lit(0.0)).alias("mean"), std.alias("std"),
            F.col(f"a{i}").alias("min_value"), F.col(f"z{i}").alias("max_value"),
        ))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def category_counts(df: DataFrame, specs: Sequence[FieldSpec]) -> DataFrame:
    """``(field, value, n)`` over applicable rows; a null value counts the missing ones."""
    pairs = [
        F.when(s.applies(), F.struct(F.lit(s.name).alias("field"), F.col(s.source).cast("string").alias("value")))
        for s in specs if not s.numeric
    ]
    long = df.select(F.explode(F.array(*pairs)).alias("p")).where(F.col("p").isNotNull())
    return long.groupBy("p.field", "p.value").agg(F.count(F.lit(1)).alias("n"))


def stratum(df: DataFrame, columns: Sequence[str]) -> Column:
    """Row label of a stratum; an absent column is spelled out, a null value is ``<NA>``."""
    if not columns:
        return F.lit("__all__")
    parts = []
    for c in columns:
        value = F.coalesce(F.col(c).cast("string"), F.lit("<NA>")) if c in df.columns else F.lit("<MISSING_COLUMN>")
        parts.append(F.concat(F.lit(f"{c}="), value))
    return F.concat_ws(STRATUM_SEPARATOR, *parts)


def stratum_counts(df: DataFrame, spec: FieldSpec, columns: Sequence[str]) -> DataFrame:
    return df.where(usable(spec)).groupBy(stratum(df, columns).alias("stratum")).agg(F.count(F.lit(1)).alias("n"))


def quotas(counts: DataFrame, budget: int) -> DataFrame:
    """Add ``quota`` to a stratum table ``(stratum, n)``: one row each, the rest by largest remainder.

    What is left after one row each is dealt in proportion to ``n - 1``, rounded down; the units lost by
    rounding go to the largest remainders, then the larger stratum, then the name. Empty strata are dropped,
    and a budget that covers every row gives every row. Strata are few, so one window ranks them.
    """
    sized = counts.where("n > 0")
    strata, total = sized.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if budget < strata:
        raise ValueError(f"{strata} strata hold rows, a sample of {budget} cannot have one of each")
    if total <= budget:
        return sized.withColumn("quota", F.col("n").cast("long"))
    due = sized.withColumn("__due", F.lit(budget - strata).cast("decimal(38,0)") * (F.col("n") - 1))
    due = due.withColumn("__whole", F.expr(f"__due div {total - strata}")).withColumn("__rest", F.expr(f"__due % {total - strata}"))
    place = F.row_number().over(Window.orderBy(F.desc("__rest"), F.desc("n"), "stratum"))
    over = F.lit(budget - strata) - F.sum("__whole").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    extra = F.when(place <= over, 1).otherwise(0)
    return due.withColumn("quota", (1 + F.col("__whole") + extra).cast("long")).drop("__due", "__whole", "__rest")


def priority_sample(
    df: DataFrame, spec: FieldSpec, columns: Sequence[str], quotas: Mapping[str, int], identity: Sequence[str], seed: int = 0
) -> DataFrame:
    """Bottom-k rows per stratum by a digest of (seed, field, row identity).

    The digest does not depend on input order. Digests are uniform, so a threshold
    well above the expected k-th value thins each stratum before the ranking; a
    stratum left short falls back to all of its rows, which keeps the result exact.
    """
    top = float(1 << 60)
    work = df.where(usable(spec)).withColumns({
        "stratum": stratum(df, columns), "priority": key_digest(F.lit(seed), F.lit(spec.name), *identity),
    })
    sizes = {r["stratum"]: r["n"] for r in stratum_counts(df, spec, columns).collect()}
    need = {s: q for s, q in quotas.items() if q < sizes.get(s, 0)}
    cut = {s: (q + 6 * math.sqrt(q) + 10) / sizes[s] for s, q in need.items()}
    limits = F.create_map(*[F.lit(x) for s, c in cut.items() for x in (s, min(1.0, c) * top)]) if cut else None
    quota = F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])
    thin = work if limits is None else work.where(
        F.col("priority") <= F.coalesce(limits[F.col("stratum")], F.lit(top))
    )
    kept = {r["stratum"]: r["count"] for r in thin.groupBy("stratum").count().collect()}
    if any(kept.get(s, 0) < min(q, sizes.get(s, 0)) for s, q in quotas.items()):
        thin = work
    ranked = B.ordinal_rank(thin, ["stratum"], ["priority"], "__r")
    return ranked.where(F.col("__r") <= quota[F.col("stratum")]).drop("__r")


# --- bin edges ----------------------------------------------------------------


def _inner(n_bins: int) -> list[float]:
    return [i / n_bins for i in range(1, n_bins)]


def _repair(lo: float, hi: float, after: float, before: float, cuts: Sequence[float]) -> list[float]:
    """Move an edge on an end value half way to its neighbour; equal edges merge."""
    edges = set()
    for q in cuts:
        edge = (lo + after) / 2.0 if q <= lo else (before + hi) / 2.0 if q >= hi else q
        if lo < edge < hi:
            edges.add(edge)
    return sorted(edges)


def _winsorised(long: DataFrame, two_sided: Mapping[str, bool]) -> dict[str, tuple[float, float]]:
    """Lower and upper winsorising bound per field of a long table ``(field, x)``."""
    rows = B.quantiles(long, ["field"], "x", [0.0, 0.01, 0.99]).collect()
    at = {(r["field"], r["p_index"]): r["quantile"] for r in rows}
    return {f: (at[f, int(two)], at[f, 2]) for f, two in two_sided.items() if (f, 2) in at}


def _clipped(long: DataFrame, ends: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Values clipped to their field's bounds; the bounds are two numbers per field."""
    bound = lambda i: F.create_map(*[F.lit(v) for f, e in ends.items() for v in (f, e[i])])[F.col("field")]
    return long.where(F.col("field").isin(*ends)).select(
        "field", F.least(F.greatest("x", bound(0)), bound(1)).alias("x"), bound(0).alias("lo"), bound(1).alias("hi")
    )


def edges_of(df: DataFrame, wanted: Mapping[str, tuple[Column, int, bool]]) -> dict[str, list[float]]:
    """Inner edges at winsorised quantiles for several columns ``name -> (value, bins, two_sided)``.

    All columns share one long table, and its quantiles are exact and distributed (see
    ``blocks.quantiles``); only bounds and cuts reach the driver. Only boundaries that
    separate values are kept, so there can be fewer bins than requested.
    """
    wanted = {n: w for n, w in wanted.items() if w[1] > 1}
    if not wanted:
        return {}
    pairs = F.array(*[F.struct(F.lit(n).alias("field"), v.cast("double").alias("x")) for n, (v, _, _) in wanted.items()])
    long = df.select(F.explode(pairs).alias("p")).select("p.field", "p.x").where(F.col("x").isNotNull())
    counts = staged(long.groupBy("field", "x").agg(F.count(F.lit(1)).alias("ties")), "counts")
    return edges_of_counts(counts, {n: (bins, two) for n, (_, bins, two) in wanted.items()})


def edges_of_counts(counts: DataFrame, wanted: Mapping[str, tuple[int, bool]]) -> dict[str, list[float]]:
    """``edges_of`` for fields ``name -> (bins, two_sided)`` from ``(field, x, ties)``, each value once; written before.

    The values are ranked once: clipping is monotone, so the quantiles of clipped values come from the order
    statistics of the values as they are.
    """
    wanted = {n: w for n, w in wanted.items() if w[0] > 1}
    if not wanted:
        return {}
    probs = sorted({0.0, 0.01, 0.99} | {p for bins, _ in wanted.values() for p in _inner(bins)})
    mine = counts.where(F.col("field").isin(*wanted))
    rows = B.order_statistics(B.ranks_of_counts(mine, ["field"], "x"), ["field"], "x", probs).collect()
    stats = {(r["field"], probs[r["p_index"]]): (r["low"], r["high"], r["frac"]) for r in rows}

    def at(name: str, p: float, lo: float = -math.inf, hi: float = math.inf) -> float:
        low, high, frac = stats[name, p]
        low, high = min(max(low, lo), hi), min(max(high, lo), hi)
        return low + (high - low) * frac

    ends = {n: (at(n, 0.01 if two else 0.0), at(n, 0.99)) for n, (_, two) in wanted.items() if (n, 0.99) in stats}
    ends = {n: e for n, e in ends.items() if e[1] > e[0]}
    cuts = {n: [at(n, p, *e) for p in _inner(wanted[n][0])] for n, e in ends.items()}
    atop = {n: e for n, e in ends.items() if min(cuts[n]) <= e[0] or max(cuts[n]) >= e[1]}
    near = {}
    if atop:
        clipped = _clipped(mine.select("field", "x"), atop)
        x = F.col("x")
        sides = clipped.groupBy("field").agg(
            F.min(F.when(x > F.col("lo"), x)).alias("after"), F.max(F.when(x < F.col("hi"), x)).alias("before")
        )
        near = {r["field"]: (r["after"], r["before"]) for r in sides.collect()}
    inside = (math.nan, math.nan)  # no cut lies on an end value, so no neighbour is asked for
    return {n: _repair(*ends[n], *near.get(n, inside), cuts[n]) if n in ends else [] for n in wanted}


def quantile_edges(sample: DataFrame, value: str, n_bins: int, two_sided: bool = False) -> list[float]:
    """Edges of one sampled column; see ``edges_of``."""
    v = F.when(is_finite(value), F.col(value).cast("double"))
    return edges_of(sample, {"x": (v, n_bins, two_sided)}).get("x", [])


def quantile_edges_v1(sample: DataFrame, value: str, n_bins: int, two_sided: bool = False) -> list[float]:
    """First-version edges: when quantiles collapse, evenly spaced edges replace them."""
    def evenly(a: float, b: float) -> list[float]:
        return [a + (b - a) * i / (n_bins - 2) for i in range(n_bins - 1)]

    long = sample.where(is_finite(value)).select(F.lit("x").alias("field"), F.col(value).cast("double").alias("x"))
    ends = _winsorised(long, {"x": two_sided})
    if not ends:
        return evenly(-1.0, 1.0)
    lo, hi = ends["x"]
    cuts = B.quantiles(_clipped(long, ends).select("x"), [], "x", _inner(n_bins)).collect()
    edges = sorted({r["quantile"] for r in cuts})
    return edges if len(edges) == n_bins - 1 else evenly(lo, hi if hi > lo else lo + 1.0)


def add_bins(df: DataFrame, fields: Mapping[str, tuple[Column, Sequence[float]]]) -> DataFrame:
    """Bin number per output column: the count of edges at or below the value; null when not finite.

    One binary search per value inside the JVM, for all fields in one projection.
    """
    work = df.withColumns({f"__v_{o}": F.when(is_finite(v), v.cast("double")) for o, (v, _) in fields.items()})
    cuts = {o: list(e) for o, (_, e) in fields.items() if e}
    if cuts:
        work = Bucketizer(
            splitsArray=[[float("-inf"), *e, float("inf")] for e in cuts.values()],
            inputCols=[f"__v_{o}" for o in cuts], outputCols=[f"__b_{o}" for o in cuts], handleInvalid="keep",
        ).transform(work)
    out = {
        o: F.when(F.col(f"__v_{o}").isNotNull(), F.col(f"__b_{o}") if o in cuts else F.lit(0)).cast("long") for o in fields
    }
    return work.withColumns(out).drop(*[f"__v_{o}" for o in fields], *[f"__b_{o}" for o in cuts])


def occupancy(df: DataFrame, fields: Mapping[str, tuple[Column, Sequence[float]]]) -> DataFrame:
    """Rows per ``(field, bin)`` over the full table."""
    binned = add_bins(df, fields)
    long = binned.select(F.explode(F.array(*[F.struct(F.lit(o).alias("field"), F.col(o).alias("bin")) for o in fields])).alias("p"))
    return long.where(F.col("p.bin").isNotNull()).groupBy("p.field", "p.bin").agg(F.count(F.lit(1)).alias("n"))


# --- the frozen vocabulary ----------------------------------------------------


@dataclass(frozen=True)
class NumericField:
    edges: tuple[float, ...]
    occupancy: tuple[int, ...]
    mean: float
    std: float
    min_value: float | None
    max_value: float | None
    n_observed: int
    n_missing: int
    requested: int


@dataclass(frozen=True)
class Vocab:
    """Small driver-side artifact; every table operation is generated from it."""

    specs: tuple[FieldSpec, ...]
    numeric: dict[str, NumericField]
    categories: dict[str, tuple[str, ...]]
    category_counts: dict[str, dict[str, int]] = field(default_factory=dict)
    category_missing: dict[str, int] = field(default_factory=dict)
    fit_dates: tuple[str, ...] = ()
    clip: float = 5.0

    def size(self, name: str) -> int:
        n = len(self.categories[name]) if name in self.categories else len(self.numeric[name].edges) + 1
        return N_SPECIAL + n

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True, ensure_ascii=False)

    @staticmethod
    def from_json(text: str) -> Vocab:
        raw = json.loads(text)
        tup = lambda d, ks: {**d, **{k: tuple(d[k]) for k in ks}}
        return Vocab(
            specs=tuple(FieldSpec(**tup(s, ["applicable"])) for s in raw["specs"]),
            numeric={k: NumericField(**tup(v, ["edges", "occupancy"])) for k, v in raw["numeric"].items()},
            categories={k: tuple(v) for k, v in raw["categories"].items()},
            category_counts=raw["category_counts"], category_missing=raw["category_missing"],
            fit_dates=tuple(raw["fit_dates"]), clip=raw["clip"],
        )


def fit_vocab(train: DataFrame, specs: Sequence[FieldSpec], day: str = "date", normaliser_clip: float = 5.0) -> Vocab:
    """Fit on all training rows at every size: statistics, exact distributed edges, occupancy."""
    has_numeric = any(s.numeric for s in specs)
    stats = {r["field"]: r for r in field_stats(train, specs).collect()} if has_numeric else {}
    edges: dict[str, list[float]] = {s.name: [] for s in specs if s.numeric}
    whole = {
        s.name: (F.when(usable(s), F.col(s.source).cast("double")), s.n_bins, s.two_sided) for s in specs if s.binned
    }
    edges.update(edges_of(train, whole))
    by_bin: dict[str, dict[int, int]] = {n: {} for n in edges}
    fields = {s.name: (F.when(s.applies(), F.col(s.source)), edges[s.name]) for s in specs if s.numeric}
    if fields:
        for r in occupancy(train, {f"o_{n}": f for n, f in fields.items()}).collect():
            by_bin[r["field"][2:]][r["bin"]] = r["n"]
    return assembled(
        specs, stats, edges, by_bin, category_counts(train, specs).collect() if any(not s.numeric for s in specs) else [],
        [r[0] for r in train.select(day).distinct().collect()], normaliser_clip,
    )


def assembled(
    specs: Sequence[FieldSpec], stats: Mapping[str, Mapping], edges: Mapping[str, list[float]], by_bin: Mapping[str, Mapping[int, int]],
    categories: Sequence[Mapping], dates: Sequence[str], normaliser_clip: float,
) -> Vocab:
    """The vocabulary of collected statistics, edges, rows per bin and ``(field, value, n)`` of the categories."""
    numeric = {}
    for s in specs:
        if s.numeric:
            r, e = stats[s.name], edges[s.name]
            numeric[s.name] = NumericField(
                tuple(e), tuple(by_bin[s.name].get(i, 0) for i in range(len(e) + 1)), r["mean"], r["std"],
                r["min_value"], r["max_value"], r["n_observed"], r["n_missing"], s.n_bins or 1,
            )
    seen: dict[str, dict[str, int]] = {s.name: {} for s in specs if not s.numeric}
    gone = dict.fromkeys(seen, 0)
    for r in categories:
        if r["value"] is None:
            gone[r["field"]] = r["n"]
        else:
            seen[r["field"]][r["value"]] = r["n"]
    return Vocab(
        tuple(specs), numeric, {k: tuple(sorted(v)) for k, v in seen.items()}, seen, gone, tuple(sorted(dates)), normaliser_clip
    )


def category_id(value: Column, categories: Sequence[str], offset: int = N_SPECIAL) -> Column:
    """Id of a known category, UNK otherwise, NA when null."""
    value = value.cast("string")
    ids = F.create_map(*[F.lit(x) for i, c in enumerate(categories) for x in (c, i + offset)]) if categories else None
    known = ids[value] if ids is not None else F.lit(None).cast("int")
    return F.when(value.isNull(), SPECIAL_IDS["NA"]).otherwise(F.coalesce(known, F.lit(SPECIAL_IDS["UNK"]))).cast("long")


def category_id_v1(value: Column, categories: Sequence[str], fallback: str) -> Column:
    """First version: an unknown value takes the id of the fallback category (or the first)."""
    default = categories.index(fallback) if fallback in categories else 0
    ids = F.create_map(*[F.lit(x) for i, c in enumerate(categories) for x in (c, i)])
    return (F.coalesce(ids[value.cast("string")], F.lit(default)) + N_SPECIAL_V1).cast("long")


def standardise(value: Column, mean: float, std: float, limit: float) -> Column:
    """Frozen z-score clipped to ``limit``; a missing value becomes 0."""
    z = clip((value.cast("double") - mean) / std, -limit, limit)
    return F.when(is_finite(value), z).otherwise(0.0).cast("float")


def tokenize(df: DataFrame, vocab: Vocab, keep: Sequence[str]) -> DataFrame:
    """Token and scalar columns of every field from one generated projection."""
    numeric = [s for s in vocab.specs if s.numeric]
    work = add_bins(df, {
        f"__bin_{s.name}": (F.when(s.applies(), F.col(s.source)), vocab.numeric[s.name].edges) for s in numeric if s.binned
    })
    na = F.lit(SPECIAL_IDS["NA"]).cast("long")
    out = []
    for s in vocab.specs:
        if not s.numeric:
            ids = category_id(F.col(s.source), vocab.categories[s.name])
            out.append(F.when(s.applies(), ids).otherwise(na).alias(f"tok_{s.name}"))
            continue
        f = vocab.numeric[s.name]
        if s.binned:
            out.append(F.coalesce(F.col(f"__bin_{s.name}") + N_SPECIAL, na).alias(f"tok_{s.name}_bin"))
        z = standardise(F.col(s.source), f.mean, f.std, vocab.clip)
        out.append(F.when(s.applies(), z).otherwise(F.lit(0.0).cast("float")).alias(f"val_{s.name}"))
    return work.select(*keep, *out)


def tokenize_v1(df: DataFrame, categories: Mapping[str, Sequence[str]], edges: Mapping[str, Sequence[float]], n_bins: int, keep: Sequence[str]) -> DataFrame:
    """First version: NaN and null count as 0, infinities as the outer edges, no missing token."""
    def value(c: str) -> Column:
        v = F.col(c).cast("double")
        e = edges[c]
        return (
            F.when(v == float("inf"), e[-1]).when(v == float("-inf"), e[0]).when(is_finite(v), v).otherwise(0.0)
        )

    work = add_bins(df, {f"__bin_{c}": (value(c) if e else F.lit(0.0), e) for c, e in edges.items()})
    cats = [category_id_v1(F.col(c), v, "N" if c == "side" else "UNKNOWN").alias(f"tok_{c}") for c, v in categories.items()]
    bins = [(F.least(F.col(f"__bin_{c}"), F.lit(n_bins - 1)) + N_SPECIAL_V1).cast("long").alias(f"tok_{c}") for c in edges]
    return work.select(*keep, *cats, *bins)


def missing_violations(tokens: DataFrame, vocab: Vocab) -> DataFrame:
    """NA tokens in fields that do not allow them."""
    strict = [s for s in vocab.specs if not s.missing_token]
    cols = [(s.name, f"tok_{s.name}_bin" if s.numeric else f"tok_{s.name}") for s in strict]
    one = tokens.agg(*[F.count_if(F.col(c) == SPECIAL_IDS["NA"]).alias(n) for n, c in cols])
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("bad_rows")) for n, _ in cols])))


def token_coverage(tokens: DataFrame, vocab: Vocab) -> DataFrame:
    """Edge-bin, missing and unknown rate per field from one scan."""
    aggs, rows = [], []
    for i, s in enumerate(vocab.specs):
        if s.numeric and not s.binned:
            continue
        t = F.col(f"tok_{s.name}_bin" if s.numeric else f"tok_{s.name}")
        last = vocab.size(s.name) - 1
        real = t >= N_SPECIAL
        edge = real & ((t == N_SPECIAL) | (t == last)) if s.numeric else F.lit(False)
        unk = F.lit(False) if s.numeric else t == SPECIAL_IDS["UNK"]
        n = F.count(F.lit(1))
        aggs += [
            F.coalesce(F.try_divide(F.count_if(edge), F.count_if(real)), F.lit(0.0)).alias(f"e{i}"),
            (F.count_if(t == SPECIAL_IDS["NA"]) / n).alias(f"m{i}"), (F.count_if(unk) / n).alias(f"u{i}"),
        ]
        rows.append(F.struct(
            F.lit(s.name).alias("field"), F.col(f"e{i}").alias("edge_rate"), F.col(f"m{i}").alias("missing_rate"),
            F.col(f"u{i}").alias("unknown_rate"),
        ))
    return tokens.agg(*aggs).select(F.inline(F.array(*rows)))


# --- storage form -------------------------------------------------------------


def quantise(df: DataFrame, columns: Sequence[str], limit: float) -> DataFrame:
    """Clipped scalars as symmetric 16-bit integers; a value outside the range fails the job."""
    def one(c: str) -> Column:
        v = F.col(c).cast("double")
        ok = is_finite(v) & (F.abs(v) <= limit + max(1e-6, limit * 1e-6))
        code = F.rint(clip(v, -limit, limit) * (QUANT_MAX / limit)).cast("short")
        return F.when(ok, code).otherwise(F.raise_error(F.lit(f"{c} outside the frozen range")).cast("short"))
    return df.withColumns({c: one(c) for c in columns})


def dequantise(df: DataFrame, columns: Sequence[str], limit: float) -> DataFrame:
    def one(c: str) -> Column:
        ok = F.abs(F.col(c).cast("int")) <= QUANT_MAX
        value = F.col(c).cast("float") * F.lit(limit / QUANT_MAX).cast("float")
        return F.when(ok, value).otherwise(F.raise_error(F.lit(f"{c} is not a 16-bit scalar")).cast("float"))
    return df.withColumns({c: one(c) for c in columns})


def narrow_tokens(df: DataFrame, sizes: Mapping[str, int]) -> DataFrame:
    """Smallest integer type per token column, after checking the id range."""
    def one(c: str, n: int) -> Column:
        kind = "short" if n <= 256 else "int"
        ok = F.col(c).between(0, n - 1)
        return F.when(ok, F.col(c).cast(kind)).otherwise(F.raise_error(F.lit(f"{c} outside the vocabulary")).cast(kind))
    return df.withColumns({c: one(c, n) for c, n in sizes.items()})


# --- distributions ------------------------------------------------------------


def entropy(counts: DataFrame, keys: Sequence[str], n: str = "n") -> DataFrame:
    """Entropy in nats of counts per group; counts are already one row per class."""
    sums = counts.where(F.col(n) > 0).groupBy(*keys).agg(
        F.sum(n).alias("total"), F.sum(F.col(n) * F.log(F.col(n).cast("double"))).alias("__nl"), F.count(F.lit(1)).alias("classes")
    )
    return sums.select(*keys, "total", "classes", (F.log(F.col("total").cast("double")) - F.col("__nl") / F.col("total")).alias("entropy"))


def train_entropy(vocab: Vocab, name: str, include_missing: bool = False) -> float:
    """Entropy of a fitted field from its frozen counts."""
    if name in vocab.numeric:
        counts = [*vocab.numeric[name].occupancy] + ([vocab.numeric[name].n_missing] if include_missing else [])
    else:
        counts = list(vocab.category_counts[name].values()) + ([vocab.category_missing[name]] if include_missing else [])
    counts = [c for c in counts if c > 0]
    total = sum(counts)
    return -sum(c / total * math.log(c / total) for c in counts) if len(counts) > 1 else 0.0


def copy_baseline(df: DataFrame, keys: Sequence[str], order: Sequence[str], token: str, classes: int, eps: float = 1e-6) -> DataFrame:
    """Cross entropy of predicting "next = current" with a little smoothing, from two counts."""
    work = B.running(df.select(*keys, *order, token), keys, order, {"__next": B.following(F.col(token))})
    pairs = work.where(F.col("__next").isNotNull())
    hit, miss = -math.log1p(-eps), -math.log(eps / (classes - 2)) if classes > 2 else math.inf
    same = F.col("__next") == F.col(token)
    return pairs.agg(
        F.count(F.lit(1)).alias("n_pairs"), F.count_if(same).alias("n_same"),
        ((F.count_if(same) * hit + F.count_if(~same) * miss) / F.count(F.lit(1))).alias("copy_ce"),
    )


def field_report(preds: DataFrame, reference_counts: DataFrame | None = None) -> DataFrame:
    """Per field: cross entropy, perplexity, accuracy, balanced accuracy, normalised cross entropy.

    ``preds`` holds ``field, target, predicted, log_prob``; classes are summed first.
    """
    per_class = preds.groupBy("field", "target").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("predicted") == F.col("target")).alias("hit"),
        F.sum(-F.col("log_prob")).alias("ce"),
    )
    out = per_class.groupBy("field").agg(
        F.sum("n").alias("n_predictions"), (F.sum("ce") / F.sum("n")).alias("ce"),
        (F.sum("hit") / F.sum("n")).alias("top1_accuracy"), F.avg(F.col("hit") / F.col("n")).alias("balanced_accuracy"),
    )
    base = per_class.select("field", "n") if reference_counts is None else reference_counts
    ent = entropy(base, ["field"]).select("field", "entropy")
    return out.join(ent, "field").withColumns({
        "perplexity": F.exp("ce"),
        "normalized_ce": F.try_divide(F.col("ce"), F.when(F.col("entropy") > 0, F.col("entropy"))),
    })


def category_codes(df: DataFrame, column: str, out: str) -> DataFrame:
    """Code of a category by sorted order of the distinct values; null becomes -1."""
    values = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    codes = staged(numbered(values.withColumnsRenamed({column: "key"}), "key", "id").select(F.col("key").cast("string").alias("value"), "id", "n"), "codes")
    return encode(df, column, codes, out, unknown=-1, missing=-1).withColumn(out, F.col(out).cast("int"))


def quantile_codes(df: DataFrame, column: str, bins: int, out: str) -> DataFrame:
    """Equal-frequency code after clipping to the 1st and 99th percentile; missing counts as 0.

    Intervals are closed on the right and equal boundaries merge.
    """
    value = F.coalesce(F.when(is_finite(column), F.col(column).cast("double")), F.lit(0.0))
    work = df.withColumn("__v", value)
    ends = [r["quantile"] for r in B.quantiles(work.select("__v"), [], "__v", [0.01, 0.99]).orderBy("p_index").collect()]
    if not ends or work.select("__v").distinct().limit(2).count() <= 1:
        return work.withColumn(out, F.lit(0)).drop("__v")
    work = work.withColumn("__v", clip("__v", ends[0], ends[1]))
    distinct = work.select("__v").distinct().limit(bins).count()
    q = min(bins, distinct)
    cuts = B.quantiles(work.select("__v"), [], "__v", [i / q for i in range(q + 1)]).orderBy("p_index").collect()
    inner = sorted({r["quantile"] for r in cuts})[1:-1]
    code = F.aggregate(
        F.array(*[F.lit(c) for c in inner]) if inner else F.array().cast("array<double>"),
        F.lit(0), lambda acc, c: acc + F.when(F.col("__v") > c, 1).otherwise(0),
    )
    return work.withColumn(out, code).drop("__v")


def leaked_dates(fit_dates: DataFrame, later_dates: DataFrame) -> DataFrame:
    """Days used for fitting that also occur in validation or test; must be empty."""
    return fit_dates.select("date").distinct().join(later_dates.select("date").distinct(), "date", "left_semi")


def routing_health(probs: DataFrame, column: str, top_k: int) -> DataFrame:
    """Expert share among the top-k, normalised entropy and mean top-1 probability.

    ``column`` is an array of probabilities; the arrays are short (one entry per expert).
    """
    ranked = F.slice(F.array_sort(
        F.transform(F.col(column), lambda p, i: F.struct((-p).alias("neg"), i.alias("expert")))
    ), 1, top_k)
    floor = lambda p: F.greatest(p, F.lit(1e-12))
    ent = F.aggregate(F.col(column), F.lit(0.0), lambda a, p: a - p * F.log(floor(p))) / F.log(F.greatest(F.size(column), F.lit(2)).cast("double"))
    rows = probs.select(ranked.alias("top"), ent.alias("ent"), F.array_max(column).alias("best"))
    totals = rows.agg(F.avg("ent").alias("normalized_entropy"), F.avg("best").alias("mean_top1_probability"), (F.count(F.lit(1)) * top_k).alias("__n"))
    share = rows.select(F.explode("top").alias("t")).groupBy(F.col("t.expert").alias("expert")).agg(F.count(F.lit(1)).alias("__c"))
    return share.withColumn("__k", F.lit(1)).join(totals.withColumn("__k", F.lit(1)), "__k").select(
        "expert", (F.col("__c") / F.col("__n")).alias("expert_fraction"), "normalized_entropy", "mean_top1_probability"
    )
