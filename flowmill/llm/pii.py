r"""Personal data by weak supervision, in DataFrame functions only.

Candidates: spans of four base kinds and of some looser kinds, found by regular expressions. Labelers vote on
each candidate: its shape (regex), word lists (gazetteer), the words before it (context), its borders. As no
span is labelled, expectation-maximisation over the vote patterns estimates each labeler's reliability and a
posterior for every pattern; a logistic span classifier is trained on these posteriors. Base spans always
stand, other candidates where the classifier gives 0.5 or more.

Only counts by vote pattern reach the driver: a fixed number of cells (kinds x patterns x length classes).

The base expressions are written so that Java's matcher neither recurses (possessive loops; nothing follows
them, so they match the same) nor rescans a run of characters from each of its positions: a run that fails
from its start fails from everywhere in it, so a match begins at a run's start or where the last one ended.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowmill.session import staged

LOCAL = r"A-Za-z0-9._%+-"
# The kinds in order; base kinds first.
BASE = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
ADDED = {
    "ssn": r"(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![0-9A-Za-z])",
    "local_phone": r"(?<![0-9A-Za-z+).-])(?<!\+[0-9]{1,3}[ .-])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z-])",
    "secret": r"(?i)(?<![a-z])(?:password|passwd|token|secret|api_?key)\x20{0,2}[=:]\x20{0,2}\"?[a-z0-9_/+-]{8,}+\"?",
    "person": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Señora|Señor|Monsieur|Madame)\.? \p{Lu}\p{Ll}{1,30}(?: \p{Lu}\p{Ll}{1,30})?",
}
# What a text must hold for the kind to be searched at all.
NEEDS = {"email": "@", "phone": "+", "ssn": "-", "secret": None, "iban": None, "person": None, "ip": ".", "card": None, "local_phone": None}
KINDS = [*BASE, *ADDED]
# The gazetteers and the context words of each kind (lower case, as regular expressions).
GAZETTEER = {
    "email": r"\.(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$",
    "ip": r"^(?!0\.|127\.|255\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)",
    "phone": r"^\+(?:1|7|2[07]|3[0-469]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    "ssn": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
    "iban": r"^(?:ad|at|be|ch|cz|de|dk|es|fi|fr|gb|gr|hu|ie|it|lu|nl|no|pl|pt|se)[0-9]{2}",
    "local_phone": r"^\(?[2-9]",
    "secret": r"[0-9].*[a-z]|[a-z].*[0-9]",
    "person": r"^(?:mr|mrs|ms|dr|prof|herr|frau|señora?|monsieur|madame)\.? ",
}
CONTEXT = {
    "email": r"mail|contact|write|address|correo|schreib", "ip": r"\bip\b|server|host|address|login|from",
    "card": r"card|visa|credit|payment|karte|carte|tarjeta", "phone": r"call|tel|phone|fax|mobile|contact",
    "ssn": r"ssn|social|security", "iban": r"iban|account|konto|compte|cuenta", "local_phone": r"call|tel|phone|fax|mobile|contact",
    "secret": r"login|user|config|export|key", "person": r"dear|by|from|with|contact|sehr",
}
SHAPE = {
    "email": r"^[a-z0-9][a-z0-9._%+-]*@[a-z0-9][a-z0-9.-]*\.[a-z]{2,12}$",
    "ip": r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$", "card": r"^(?:[0-9]{16}|(?:[0-9]{4}[ -]){3}[0-9]{4})",
    "phone": r"^\+[0-9]{1,3}[ .-]?(?:\([0-9]+\)[ .-]?)?[0-9]+(?:[ .-][0-9]+)*$", "ssn": r"^[0-9-]+$",
    "iban": r"^[a-z]{2}[0-9]{2}[a-z0-9]*[0-9]{6}", "local_phone": r"[0-9]{4}$", "secret": r"[a-f0-9]{12,}|[0-9]",
    "person": r"^[a-z]+\.? \p{L}{3,}",
}
LABELERS = ("shape", "gazetteer", "context", "border")
LENGTHS = (12, 20, 40)  # borders of the length classes


def _spans_of(text: Column, kind: str) -> Column:
    """Array of the kind's matches: number, characters since the last match, what stands before, the match."""
    pattern = {**BASE, **ADDED}[kind]
    zipped = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1))
    rows = F.transform(zipped, lambda x, i: F.struct(
        F.lit(KINDS.index(kind)).alias("kind"), i.alias("place"), F.length(x["1"]).cast("long").alias("gap"),
        F.right(x["1"], F.lit(40)).alias("before"), x["0"].alias("value"),
    ))
    rows = F.filter(rows, lambda x: x["value"].isNotNull())
    needed = NEEDS[kind]
    return F.when(F.contains(text, F.lit(needed)), rows) if needed else rows


def _luhn(digits: Column) -> Column:
    value = lambda i: F.substring(digits, -i, 1).cast("int") if isinstance(i, int) else F.expr("0")
    total = F.lit(0)
    for i in range(1, 20):
        x = F.when(F.length(digits) >= i, value(i)).otherwise(0)
        total = total + (x if i % 2 else 2 * x - F.when(x > 4, 9).otherwise(0))
    return total % 10 == 0


def _valid(kind: Column, value: Column) -> Column:
    """What a base match must satisfy beyond its expression."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
    name = KINDS.index
    return (
        F.when(kind == name("ip"), value.rlike(rf"^{part}(?:\.{part}){{3}}$"))
        .when(kind == name("card"), F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False))
        .when(kind == name("phone"), F.length(digits).between(8, 15))
        .otherwise(True)
    )


def _by_kind(patterns: dict[str, str], subject: Column) -> Column:
    out = F.lit(False)
    for kind, pattern in patterns.items():
        out = F.when(F.col("kind") == KINDS.index(kind), subject.rlike(pattern)).otherwise(out)
    return out


def candidates(rows: DataFrame) -> DataFrame:
    """Spans of rows (row, found): kind, start, end, the votes and the length class; invalid matches are gone."""
    order = Window.partitionBy("row", "kind").orderBy("place")
    each = rows.select("row", F.inline("found"))
    size = F.length("value").cast("long")
    each = each.withColumn("end", F.sum(F.col("gap") + size).over(order)).withColumn("start", F.col("end") - size)
    each = each.where(_valid(F.col("kind"), F.col("value")))
    low, before = F.lower("value"), F.lower("before")
    votes = {
        "shape": _by_kind(SHAPE, low), "gazetteer": _by_kind(GAZETTEER, low), "context": _by_kind(CONTEXT, before),
        "border": ~before.rlike(r"[\p{L}0-9_]$"),
    }
    length = F.lit(0)
    for border in LENGTHS:
        length = length + F.when(size > border, 1).otherwise(0)
    return each.select("row", "kind", "start", "end", *(v.cast("int").alias(n) for n, v in votes.items()), length.alias("size"))


def reliabilities(cells: list[tuple[tuple[int, ...], float]], rounds: int = 60) -> tuple[float, list[float], list[float]]:
    """EM over (votes, count): share of true spans, and each labeler's vote rate on true and on false ones."""
    n = len(LABELERS)
    share, true, false = 0.7, [0.8] * n, [0.3] * n
    total = sum(c for _, c in cells)
    for _ in range(rounds if total else 0):
        weight = [(votes, c, posterior(votes, share, true, false)) for votes, c in cells]
        mass = sum(c * p for _, c, p in weight)
        share = (mass + 1) / (total + 2)
        for j in range(n):
            true[j] = (sum(c * p * v[j] for v, c, p in weight) + 2) / (mass + 3)
            false[j] = (sum(c * (1 - p) * v[j] for v, c, p in weight) + 1) / (total - mass + 3)
    return share, true, false


def posterior(votes: tuple[int, ...], share: float, true: list[float], false: list[float]) -> float:
    odds = math.log(share / (1 - share))
    for v, t, f in zip(votes, true, false, strict=True):
        odds += math.log(t / f) if v else math.log((1 - t) / (1 - f))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))


def _features(kind: int, votes: tuple[int, ...], size: int) -> list[float]:
    return [1.0, *votes, *(float(size == i) for i in range(1, len(LENGTHS) + 1)), *(float(kind == i) for i in range(1, len(KINDS)))]


def train_classifier(cells: list[tuple[int, tuple[int, ...], int, float]], steps: int = 300) -> list[float]:
    """Logistic weights fitted to the EM posteriors of (kind, votes, length class, count), from all cells."""
    merged: dict[tuple[int, ...], float] = {}
    for _, votes, _, c in cells:
        merged[votes] = merged.get(votes, 0.0) + c
    model = reliabilities(sorted(merged.items()))
    # a cell weighs by the logarithm of its count, so that one kind does not settle the others
    rows = [(_features(k, v, s), math.log1p(c), posterior(v, *model)) for k, v, s, c in sorted(cells)]
    weights = [0.0] * (1 + len(LABELERS) + len(LENGTHS) + len(KINDS) - 1)
    total = sum(c for _, c, _ in rows) or 1.0
    for _ in range(steps):
        slope = [0.002 * w for w in weights]
        for x, c, p in rows:
            error = 1 / (1 + math.exp(-sum(w * a for w, a in zip(weights, x, strict=True)))) - p
            for j, a in enumerate(x):
                slope[j] += c * error * a / total
        weights = [w - 1.0 * g for w, g in zip(weights, slope, strict=True)]
    return weights


def _probability(weights: list[float]) -> Column:
    terms = [F.lit(1.0), *(F.col(n) for n in LABELERS), *((F.col("size") == i).cast("int") for i in range(1, len(LENGTHS) + 1))]
    terms += [(F.col("kind") == i).cast("int") for i in range(1, len(KINDS))]
    logit = sum((t * w for t, w in zip(terms, weights, strict=True)), F.lit(0.0))
    return 1 / (1 + F.exp(-logit))


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row`` (unique), ``id``, ``mark`` (a hash of the text) and ``spans``: (kind number, start, end, base).

    Spans come by kind as in ``KINDS``, then start; code points, end exclusive. Null and empty texts have none.
    Repeated rows repeat; a null id stays null; other columns of ``docs`` are not read; an empty table gives an
    empty table.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    none = F.array().cast("array<struct<kind:int,place:int,gap:bigint,before:string,value:string>>")
    found = F.concat(*(F.coalesce(_spans_of(F.col("text"), k), none) for k in KINDS))
    rows = staged(rows.select("id", F.xxhash64("text").alias("mark"), found.alias("found")).withColumn("row", F.monotonically_increasing_id()), "found")
    spans = staged(candidates(rows.where(F.size("found") > 0)), "candidates")
    cells = spans.groupBy("kind", *LABELERS, "size").agg(F.count(F.lit(1)).alias("n")).collect()
    weights = train_classifier([(c["kind"], tuple(c[n] for n in LABELERS), c["size"], float(c["n"])) for c in cells])
    base = F.col("kind") < len(BASE)
    kept = spans.where(base | (_probability(weights) >= 0.5))
    per_row = kept.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("kind", "start", "end", base.alias("base")))).alias("spans"))
    empty = F.array().cast("array<struct<kind:int,start:bigint,end:bigint,base:boolean>>")
    return rows.select("row", "id", "mark").join(per_row, "row", "left").withColumn("spans", F.coalesce("spans", empty))


def kind_names() -> Column:
    return F.array(*(F.lit(k) for k in KINDS))


def spelled(spans: Column) -> Column:
    """kind:start:end of the spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kind_names(), s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every found span replaced by its kind in brackets; overlapping spans become one.

    Columns stay as they are; a row without spans, without a text or with an empty one is unchanged.
    """
    found = find_spans(docs, id_col, text_col).where(F.size("spans") > 0)
    pieces = found.select("row", "id", "mark", F.inline("spans"))
    order = Window.partitionBy("row").orderBy("start", "end", "kind")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.withColumn("opens", F.when(F.col("start") < reach, 0).otherwise(1))
    pieces = pieces.withColumn("group", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = pieces.groupBy("row", "id", "mark", "group").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("kind").alias("kind"))
    per_row = merged.groupBy("row", "id", "mark").agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind"))).alias("cuts"))
    per_text = per_row.groupBy(F.col("id").alias("__id"), F.col("mark").alias("__mark")).agg(F.min("cuts").alias("__cuts"))
    text = F.col(text_col)
    # texts and spans are always sorted and merged: the plan, and so the growth, is the same at every size
    marked = docs.join(per_text.hint("merge"), F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__mark")), "left")
    before = lambda i: F.when(i > 0, F.get("__cuts", i - 1)["end"]).otherwise(0)
    kept = lambda s, i: F.substr(text, (before(i) + 1).cast("int"), (s["start"] - before(i)).cast("int"))
    parts = F.transform("__cuts", lambda s, i: F.concat(kept(s, i), F.lit("["), F.upper(F.get(kind_names(), s["kind"])), F.lit("]")))
    tail = F.substr(text, (F.element_at("__cuts", -1)["end"] + 1).cast("int"))
    changed = F.when(F.col("__cuts").isNotNull(), F.concat(F.array_join(parts, ""), tail)).otherwise(text)
    return marked.select(*(changed.alias(c) if c == text_col else F.col(c) for c in docs.columns))
