"""Near-duplicate documents: an inverted join over MinHash signature coordinates, confirmed on full sets.

1. Texts with equal shingle sets form a class; the smallest id stands for it from then on.
2. A class has ``COORDINATES`` min-hashes. Two sets at the likeness wanted agree in ``MATCHES`` coordinates
   or more, but for a chance of about 1e-5 at the very threshold and far less above it.
3. Prefix: with the coordinate-values in one global order, rare ones first, two such signatures share
   ``COLLISIONS`` values or more among their first ``COORDINATES - MATCHES + COLLISIONS``; only these are posted.
   The order comes from counts in 2**18 cells (a fixed size); any order is right, this one keeps frequent
   values out of the lists.
4. Merging with skips: a list has up to ``HEADS`` heads, the members whose coordinate-values are the most common
   ones (the middle of a group of near copies, which links to most of it) and the least member under a hash; each
   class is first compared with the ``TRIED`` heads it meets most often. What is confirmed is contracted to
   components; a list that lies within one component is skipped, in the others all pairs of different
   components are merged and their collisions counted. A pair whose odd sketches (the parity of the shingles in
   each of ``BITS`` cells) differ in more bits than two sets at the likeness wanted can falls out before that, and a
   pair comes out of one list only, however many it shares. For
   up to ``BITS`` shingles this loses nothing; larger sets are sketched from a sample, with a chance of 1e-5.
5. The rest is confirmed on the full shingle sets. Components of confirmed links and copies are the result.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from flowmill.llm.graph import components
from flowmill.llm.words import U64, Words, lists, map_texts, mixed, rolling, seeded
from flowmill.session import discard, staged

COORDINATES, MATCHES, COLLISIONS = 64, 36, 4
PREFIX = COORDINATES - MATCHES + COLLISIONS
BITS = 1024
HEADS, TRIED = 3, 3
CELL_BITS, ID_CELL_BITS = 18, 24


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of ``size`` consecutive words (A-Z lowered); fewer words count as one shingle."""
    w = Words(texts, lower=True)
    grams = rolling(w.hashes, size)
    out = []
    for a, b in zip(w.bounds[:-1], w.bounds[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        else:
            out.append(rolling(w.hashes[a:b], b - a) if b > a else np.zeros(0, U64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """For each coordinate the scrambled value of the shingle that comes first in its order."""
    salt, factor = seeded(11, COORDINATES), seeded(12, COORDINATES)
    least = None
    for at in range(0, len(shingles), 512):
        part = ((shingles[at : at + 512, None] ^ salt) * factor).min(axis=0)
        least = part if least is None else np.minimum(least, part)
    return mixed(least ^ salt)


def sketches(shingles: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Level, sketch at this level, and sketch at the next level where a larger partner may need it (else empty).

    A sketch has the parity of the number of shingles in each of ``BITS`` cells, so two sketches differ in at most as
    many bits as the sets differ in shingles. Level ``j`` takes the shingles that begin with ``j`` zero bits; it is
    the least one that leaves ``BITS`` of them or fewer on average.
    """
    n, level = len(shingles), 0
    while n > BITS << level:
        level += 1
    made = []
    for j in (level, level + 1):
        if j > level and 100 * n <= 80 * (BITS << level):
            made.append(np.zeros(0, U64))
            continue
        part = shingles[: np.searchsorted(shingles, U64((1 << (64 - j)) - 1), "right")]
        odd = np.bincount((part & U64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
        made.append(np.packbits(odd.astype(np.uint8)).view(U64))
    return level, *made


def _near_enough(differing: Column, sizes: Column, level: Column, percent: int) -> Column:
    """Whether so many differing bits allow ``percent``: exact at level 0, 4.3 deviations more where shingles are sampled."""
    most = sizes * (100 - percent) / (100 + percent)
    kept = F.exp(-2 * most / F.pow(F.lit(2.0), level) / BITS)
    sampled = BITS / 2 * (1 - kept) + 4.3 * F.sqrt(BITS / 4 * (1 - kept * kept))
    return F.when(level == 0, differing * (100 + percent) <= sizes * (100 - percent)).otherwise(differing <= sampled)


def _signatures(docs: DataFrame, size: int) -> DataFrame:
    def work(part, texts):
        sets = shingle_sets(texts, size)
        digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
        full = [s for s in sets if len(s)]
        values = np.stack([signature(s) for s in full]) if full else np.zeros((0, COORDINATES), U64)
        drawn = [sketches(s) if len(s) else (0, s, s) for s in sets]
        flat = lambda i: lists(np.concatenate([d[i] for d in drawn]), np.cumsum([0, *(len(d[i]) for d in drawn)]), "int64")
        bounds = np.concatenate([[0], np.cumsum([len(s) > 0 for s in sets])])
        return {
            "id": part.column(0), "n_shingles": [len(s) for s in sets], "digest": digests,
            "coordinates": lists(values.ravel(), bounds * COORDINATES, "int64"),
            "level": [d[0] for d in drawn], "sketch": flat(1), "next_sketch": flat(2),
        }

    schema = "id bigint, n_shingles bigint, digest binary, coordinates array<bigint>, level int, sketch array<bigint>, next_sketch array<bigint>"
    return map_texts(docs, "text", schema, work)


def _posts(classes: DataFrame, cells: np.ndarray) -> DataFrame:
    """Of each class the ``PREFIX`` rarest coordinate-values (as keys), how common all its values are, and the sketches."""
    shared = classes.sparkSession.sparkContext.broadcast(cells)
    tags = mixed(np.arange(1, COORDINATES + 1, dtype=U64))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            n = batch.num_rows
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False).view(U64).reshape(n, COORDINATES)
            keys = mixed(flat ^ tags)
            count = shared.value[(keys >> U64(64 - CELL_BITS)).astype(np.int64)]
            order = np.lexsort((keys, count), axis=1)[:, :PREFIX]
            kept = np.take_along_axis(keys, order, axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), lists(kept.ravel(), np.arange(n + 1) * PREFIX, "int64"), pa.array(count.sum(axis=1)), *batch.columns[3:]],
                names=["id", "n", "keys", "common", "level", "sketch", "next_sketch"],
            )

    schema = "id bigint, n bigint, keys array<bigint>, common bigint, level int, sketch array<bigint>, next_sketch array<bigint>"
    return classes.select("id", "n", "coordinates", "level", "sketch", "next_sketch").mapInArrow(run, schema)


def _cell_counts(classes: DataFrame) -> np.ndarray:
    """How often each cell of coordinate-values occurs; ``2**CELL_BITS`` numbers whatever the input."""
    cells = np.zeros(1 << CELL_BITS, np.int64)
    own = mixed(np.arange(1, COORDINATES + 1, dtype=U64))

    def run(batches):
        import pyarrow as pa

        count = np.zeros(1 << CELL_BITS, np.int64)
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False).view(U64).reshape(-1, COORDINATES)
            count += np.bincount((mixed(flat ^ own) >> U64(64 - CELL_BITS)).astype(np.int64).ravel(), minlength=1 << CELL_BITS)
        at = np.flatnonzero(count)
        for i in range(0, len(at), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[i : i + 50_000]), pa.array(count[at[i : i + 50_000]])], names=["cell", "n"])

    summed = classes.select("coordinates").mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    table = summed.toArrow()
    cells[table.column("cell").to_numpy()] = table.column("n").to_numpy()
    return cells


def _cell(c: str) -> Column:
    return (1 + F.pmod(F.xxhash64(c), F.lit(1 << ID_CELL_BITS))).cast("int")


def _cells_of(ids: DataFrame) -> np.ndarray:
    """Which of ``2**ID_CELL_BITS`` cells hold an id: a filter of fixed size that lets some others through too."""
    bits = ids.select(F.bitmap_bucket_number(_cell("id")).alias("bucket"), F.bitmap_bit_position(_cell("id")).alias("bit"))
    wanted = np.zeros((1 << ID_CELL_BITS) + 32768, bool)
    for r in bits.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).collect():
        flags = np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little")
        wanted[np.flatnonzero(flags) + (r["bucket"] - 1) * 32768 + 1] = True  # bucket 1 begins with number 1
    return wanted


def _tag(key: Column) -> Column:
    """Half of a list's key; two different lists of a pair share it with a chance of 1e-7 or so."""
    return F.shiftright(key, 32).cast("int")


def _confirmed(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (u, v) whose full shingle sets are alike enough."""
    cells = _cells_of(pairs.select(F.explode(F.array("u", "v")).alias("id")))
    shared = pairs.sparkSession.sparkContext.broadcast(cells)

    def work(part, texts):
        wanted = np.flatnonzero(shared.value[part.column(2).to_numpy()])
        sets = shingle_sets([texts[i] for i in wanted], size)
        bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        return {"id": part.column(0).take(wanted), "shingles": lists(np.concatenate([*sets, np.zeros(0, U64)]), bounds, "int64")}

    placed = docs.where("id is not null").select("id", "text", _cell("id").alias("cell"))
    sets = staged(map_texts(placed, "text", "id bigint, shingles array<bigint>", work), "shingles")
    both = pairs.join(sets.select(F.col("id").alias("u"), F.col("shingles").alias("a")), "u").join(
        sets.select(F.col("id").alias("v"), F.col("shingles").alias("b")), "v"
    )
    common = F.size(F.array_intersect("a", "b"))
    links = staged(both.where(100 * common >= percent * (F.size("a") + F.size("b") - common)).select("u", "v").distinct(), "links")
    discard(sets)
    return links


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80
) -> DataFrame:
    """``id``, ``n_shingles``, ``component_id`` and ``kept`` of every row.

    Rows are linked when their distinct ``shingle``-word sets have a Jaccard likeness of ``percent`` / 100 or
    more (80 at least: the signature is made for that). ``component_id`` is the smallest id reachable over
    links, ``kept`` tells whether it is the row's own. Null and empty texts are linked with nothing. Rows that
    share an id count as one document with the links of all its texts. A row without an id is its own:
    ``component_id`` null, kept. Other columns of ``docs`` are not read; an empty table gives an empty table.
    """
    if percent < 80:
        raise ValueError("the signature's match threshold holds from 80 percent on")
    docs = docs.selectExpr(f"cast(`{id_col}` as bigint) id", f"cast(`{text_col}` as string) text")
    signed = staged(_signatures(docs, shingle), "signatures")
    full = signed.where("n_shingles > 0 and id is not null")
    classes = staged(full.groupBy("digest").agg(
        F.min("id").alias("id"), F.first("n_shingles").alias("n"),
        *(F.first(c).alias(c) for c in ("coordinates", "level", "sketch", "next_sketch")),
    ), "classes")
    copies = staged(full.join(classes.select("digest", F.col("id").alias("v")), "digest").select(F.col("id").alias("u"), "v"), "copies")
    rows = staged(signed.select("id", "n_shingles"), "rows")
    discard(signed)
    posts = staged(_posts(classes, _cell_counts(classes)), "posts")
    discard(classes)
    alike = lambda n, m: (100 * F.col(n) >= percent * F.col(m)) & (100 * F.col(m) >= percent * F.col(n))
    fields = posts.select("id", "n", "level", "sketch", "next_sketch")
    side = lambda of: fields.select(F.col("id").alias(of), F.struct("n", "level", "sketch", "next_sketch").alias(f"{of}_"))

    entries = posts.select("id", "common", F.explode("keys").alias("key"))
    # most values occur once; from here on only the lists of several members are dealt
    several = staged(entries.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("key"), "lists")
    entries = staged(entries.join(several, "key", "left_semi").select("id", "common", "key"), "entries")
    # lists are written before they are joined back: both sides then have exchanges of their own, whose hot
    # partitions adaptive execution may split
    # the second middle is the most common member of one half of the ids, so it differs from the first in most lists
    middle = [F.max(F.struct(F.when(c, F.col("common")).alias("common"), "id"))["id"] for c in (F.lit(True), F.xxhash64("id") % 2 == 0)]
    least = [*middle, F.min(F.struct(F.xxhash64("id"), "id"))["id"]]
    heads = staged(entries.groupBy("key").agg(F.array_distinct(F.array(*least)).alias("heads")), "heads")
    met = entries.join(heads, "key").select("id", F.explode("heads").alias("head")).where("id <> head")
    met = met.groupBy("id", "head").agg(F.count(F.lit(1)).alias("often")).where(f"often >= {COLLISIONS}")
    best = F.slice(F.sort_array(F.collect_list(F.struct("often", "head")), asc=False), 1, TRIED)["head"]
    stars = met.groupBy("id").agg(best.alias("heads")).select("id", F.explode("heads").alias("head"))
    stars = stars.select(F.least("id", "head").alias("u"), F.greatest("id", "head").alias("v")).distinct()
    level = F.greatest("u_.level", "v_.level")
    at_level = lambda of: F.when(F.col(f"{of}_.level") == level, F.col(f"{of}_.sketch")).otherwise(F.col(f"{of}_.next_sketch"))
    differ = F.aggregate(F.zip_with(at_level("u"), at_level("v"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, b: n + b)
    probed = stars.join(side("u"), "u").join(side("v"), "v").where(alike("u_.n", "v_.n"))
    probed = probed.where(_near_enough(differ, F.col("u_.n") + F.col("v_.n"), level, percent))
    starred = _confirmed(staged(probed.select("u", "v"), "stars"), docs, shingle, percent)

    label = components(starred).withColumnRenamed("component", "part")
    placed = staged(entries.select("id", "key").join(label, "id", "left").select("key", "id", F.coalesce("part", "id").alias("part")), "placed")
    mixed_lists = placed.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("key")
    # only classes with enough open lists can collide often enough; they are written whole and dealt to lists after that
    opened = placed.join(staged(mixed_lists, "lists"), "key", "left_semi").groupBy("id", "part").agg(F.collect_list("key").alias("keys"))
    opened = staged(opened.where(F.size("keys") >= COLLISIONS).join(fields, "id"), "open")
    own = F.struct("level", F.lit(True).alias("own"), F.col("sketch").alias("bits"))
    above = F.struct((F.col("level") + 1).alias("level"), F.lit(False).alias("own"), F.col("next_sketch").alias("bits"))
    levels = F.filter(F.array(own, above), lambda x: F.size(x["bits"]) > 0)
    tags = F.transform("keys", _tag)
    dealt = opened.select("id", "part", "n", "keys", tags.alias("tags"), F.explode(levels).alias("at")).select(F.explode("keys").alias("key"), "id", "part", "n", "tags", "at.*")
    words = range(BITS // 64)
    dealt = dealt.select("key", "level", "own", "id", "part", "n", "tags", *(F.get("bits", F.lit(i)).alias(f"b{i}") for i in words))
    x, y = dealt.alias("x"), dealt.alias("y")
    differ = sum((F.bit_count(F.col(f"x.b{i}").bitwiseXOR(F.col(f"y.b{i}"))) for i in words), F.lit(0))
    met_at = (F.col("x.key") == F.col("y.key")) & (F.col("x.level") == F.col("y.level")) & (F.col("x.own") | F.col("y.own"))
    apart = (F.col("x.id") < F.col("y.id")) & (F.col("x.part") != F.col("y.part")) & alike("x.n", "y.n")
    near = _near_enough(differ, F.col("x.n") + F.col("y.n"), F.col("x.level"), percent)
    # both sides bring the tags of all their lists, so a pair counts its collisions itself and is made in the first of them only
    shared = F.array_intersect("x.tags", "y.tags")
    first = (F.size(shared) >= COLLISIONS) & (F.array_min(shared) == _tag(F.col("x.key")))
    across = x.join(y, met_at & apart & near & first).select(F.col("x.id").alias("u"), F.col("y.id").alias("v"))
    across = staged(across, "across")
    discard(opened)
    crossed = _confirmed(across, docs, shingle, percent)

    discard(posts)
    found = components(copies.union(starred).union(crossed))
    out = rows.select("id", "n_shingles").join(found, "id", "left")
    component = F.coalesce("component", "id")
    return out.select("id", "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
