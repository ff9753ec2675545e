"""Content inventories: what a set of files holds, as a tree of digests that can be compared and descended.

Every row has a digest of its columns' texts. A leaf is a bucket of a file's rows (by the digest's last hex digits) and
holds their number and the exact sums of the digests' lanes, so that order does not matter, equal rows count each, and
parts of a file may be added up. A file adds its leaves, a folder the digests of its files (by hash of the name), the
root those of the folders. No file is ever one value, and nothing depends on how rows lie in tasks.

Two inventories are compared from the root: a level is only read below nodes that differ, down to the bucket of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

LANES, LANE_DIGITS = 4, 15
ROOT, FOLDER, FILE, LEAF = range(4)
_SUMS = [f"lane{i}" for i in range(LANES)]


def row_digest(columns: Sequence[str | Column]) -> Column:
    """SHA-256 over the columns' texts, each with its length before it; null is told from the empty text."""
    texts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]
    return F.sha2(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


def _lanes(digest: Column) -> list[Column]:
    return [F.conv(F.substring(digest, 1 + LANE_DIGITS * i, LANE_DIGITS), 16, 10).cast("decimal(20,0)") for i in range(LANES)]


def _named(level: int, nodes: DataFrame) -> DataFrame:
    sums = [F.col(c).cast("decimal(38,0)").alias(c) for c in _SUMS]
    digest = F.sha2(F.concat_ws("|", "node", "n_rows", *[s.cast("string") for s in sums]), 256)
    return nodes.select(F.lit(level).alias("level"), "node", "parent", "n_files", "n_rows", *sums, digest.alias("digest"))


def leaves(rows: DataFrame, file: str | Column, columns: Sequence[str | Column], digits: int = 2) -> DataFrame:
    """(file, bucket, n_rows, lane sums); leaves of parts of the same files may be united and are added up."""
    rows = rows.select((F.col(file) if isinstance(file, str) else file).alias("file"), row_digest(columns).alias("d"))
    rows = rows.select("file", F.substring("d", 65 - digits, digits).alias("bucket"), *[x.alias(c) for x, c in zip(_lanes(F.col("d")), _SUMS, strict=True)])
    return rows.groupBy("file", "bucket").agg(F.count("*").alias("n_rows"), *[F.sum(c).alias(c) for c in _SUMS])


def tree(parts: DataFrame) -> DataFrame:
    """The nodes (level, node, parent, n_files, n_rows, lane sums, digest) above leaves and of the leaves themselves.

    ``parts`` is read once for every level: write it first. Without any file there is no node.
    """
    add = lambda df, *by: df.groupBy(*by).agg(F.sum("n_files").alias("n_files"), F.sum("n_rows").alias("n_rows"), *[F.sum(c).alias(c) for c in _SUMS])
    folder = F.substring(F.sha2("file", 256), 1, 1)
    low = add(parts.withColumn("n_files", F.lit(0).cast("long")), "file", "bucket")
    low = _named(LEAF, low.select(F.concat_ws("#", "file", "bucket").alias("node"), F.col("file").alias("parent"), "n_files", "n_rows", *_SUMS))
    files = add(parts.withColumn("n_files", F.lit(0).cast("long")), "file").withColumn("n_files", F.lit(1).cast("long"))
    files = _named(FILE, files.select(F.col("file").alias("node"), folder.alias("parent"), "n_files", "n_rows", *_SUMS))

    def above(level: int, nodes: DataFrame, parent: Column) -> DataFrame:
        own = nodes.select(F.col("parent").alias("node"), "n_files", "n_rows", *[x.alias(c) for x, c in zip(_lanes(F.col("digest")), _SUMS, strict=True)])
        return _named(level, add(own, "node").withColumn("parent", parent))

    folders = above(FOLDER, files, F.lit(""))
    return low.unionByName(files).unionByName(folders).unionByName(above(ROOT, folders, F.lit(None).cast("string")))


def write(nodes: DataFrame, path: str) -> DataFrame:
    """Store an inventory by level, so that a descent reads the levels it needs, and read it back."""
    nodes.write.mode("overwrite").partitionBy("level").parquet(path)
    return nodes.sparkSession.read.schema(nodes.schema).parquet(path)


def differences(before: DataFrame, after: DataFrame) -> DataFrame:
    """Nodes that differ between two inventories: (level, node, status, n_before, n_after); none if the roots agree."""
    found, open_nodes = None, None
    for level in (ROOT, FOLDER, FILE, LEAF):
        sides = []
        for nodes, tag in ((before, "before"), (after, "after")):
            own = nodes.where(F.col("level") == level)
            if open_nodes is not None:
                own = own.join(open_nodes, F.col("parent") == F.col("open"), "left_semi")
            sides.append(own.select("node", F.col("digest").alias(f"d_{tag}"), F.col("n_rows").alias(f"n_{tag}")))
        both = sides[0].join(sides[1], "node", "full_outer").where(~F.col("d_before").eqNullSafe(F.col("d_after")))
        status = F.when(F.col("d_before").isNull(), "added").when(F.col("d_after").isNull(), "removed").otherwise("changed")
        both = both.select(F.lit(level).alias("level"), "node", status.alias("status"), "n_before", "n_after")
        open_nodes = both.select(F.col("node").alias("open"))
        found = both if found is None else found.unionByName(both)
    return found


def changed_rows(
    before: DataFrame, after: DataFrame, found: DataFrame, file: str | Column, columns: Sequence[str | Column], digits: int = 2
) -> DataFrame:
    """Rows behind differing leaves: (file, digest, n_before, n_after) where the two sides hold a row unequally often."""
    leaf = found.where(F.col("level") == LEAF).select("node")

    def own(rows: DataFrame, tag: str) -> DataFrame:
        rows = rows.select((F.col(file) if isinstance(file, str) else file).alias("file"), row_digest(columns).alias("digest"))
        rows = rows.withColumn("node", F.concat_ws("#", "file", F.substring("digest", 65 - digits, digits))).join(leaf, "node", "left_semi")
        return rows.groupBy("file", "digest").agg(F.count("*").alias(tag))

    both = own(before, "n_before").join(own(after, "n_after"), ["file", "digest"], "full_outer").fillna(0, ["n_before", "n_after"])
    return both.where("n_before <> n_after")
