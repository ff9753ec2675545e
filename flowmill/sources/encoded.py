"""Token tables in their storage form, with the contract that says how they are decoded beside the rows.

``<path>/rows`` holds the Parquet files, ``<path>/encoding`` one line of JSON, written after them: a table counts once
it has its contract. Reading plans the decode from the contract as column expressions, so only the columns asked for
reach the scan, a condition on stored columns is pushed into it, and the decode stays in generated code.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowmill.operators import vocab as V

# Version and scheme of the storage form.
VERSION = "token_uint_scalar_q16_v1"
SCHEME = "vocab_uint_and_symmetric_int16"
_KEYS = {"format_version", "scheme", "vocab_sha256", "tokens", "scalars", "contract_sha256"}


def vocab_sha256(vocab: V.Vocab) -> str:
    return hashlib.sha256(vocab.to_json().encode()).hexdigest()


@dataclass(frozen=True)
class Contract:
    """Ids below ``tokens[column]`` in the narrowest type, scalars within ``scalars[column]`` as symmetric 16-bit integers."""

    vocab_sha256: str
    tokens: dict[str, int]
    scalars: dict[str, float]

    def __post_init__(self) -> None:
        for c, n in self.tokens.items():
            if not c.startswith("tok_") or n < 1:
                raise ValueError(f"no token column: {c!r} with {n} ids")
        for c, limit in self.scalars.items():
            if not c.startswith("val_") or not (math.isfinite(limit) and limit > 0):
                raise ValueError(f"no scalar column: {c!r} within {limit}")

    @staticmethod
    def of(vocab: V.Vocab) -> Contract:
        tokens = {f"tok_{s.name}_bin" if s.numeric else f"tok_{s.name}": vocab.size(s.name) for s in vocab.specs if s.binned or not s.numeric}
        return Contract(vocab_sha256(vocab), tokens, {f"val_{s.name}": float(vocab.clip) for s in vocab.specs if s.numeric})

    def stored(self, column: str) -> str:
        """Spark type of a stored column."""
        return "smallint" if column in self.scalars or self.tokens[column] <= 256 else "int"

    def _body(self) -> dict:
        return {"format_version": VERSION, "scheme": SCHEME, "vocab_sha256": self.vocab_sha256, "tokens": self.tokens, "scalars": self.scalars}

    def to_json(self) -> str:
        digest = hashlib.sha256(json.dumps(self._body(), sort_keys=True).encode()).hexdigest()
        return json.dumps({**self._body(), "contract_sha256": digest}, sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Contract:
        """Refuses other versions and schemes, missing and unknown keys, and a contract that was changed."""
        raw = json.loads(text)
        if not isinstance(raw, Mapping) or set(raw) != _KEYS:
            raise ValueError(f"the contract's keys are not {sorted(_KEYS)}")
        if raw["format_version"] != VERSION or raw["scheme"] != SCHEME:
            raise ValueError(f"unknown storage form {raw['format_version']!r}, {raw['scheme']!r}")
        out = Contract(raw["vocab_sha256"], dict(raw["tokens"]), {c: float(v) for c, v in raw["scalars"].items()})
        if json.loads(out.to_json())["contract_sha256"] != raw["contract_sha256"]:
            raise ValueError("the contract does not have the digest it declares")
        return out


def write_tokens(df: DataFrame, vocab: V.Vocab, path: str, by: Sequence[str] = ()) -> Contract:
    """Store ``df`` under a new ``path``, split by ``by``; columns the vocabulary does not name stay as they are.

    Every column the vocabulary names must be there. A null, an id outside its range and a scalar outside the clip fail
    the job, and then no contract is written.
    """
    contract = Contract.of(vocab)
    lacking = [c for c in (*contract.tokens, *contract.scalars) if c not in df.columns]
    strange = [c for c in df.columns if c.startswith("val_") and c not in contract.scalars]
    if lacking or strange:
        raise ValueError(f"columns missing: {lacking}, scalars the vocabulary lacks: {strange}")
    rows = V.quantise(V.narrow_tokens(df, contract.tokens), list(contract.scalars), vocab.clip)
    writer = rows.write.option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(f"{path}/rows")
    write_contract(df.sparkSession, contract.to_json(), path)
    return contract


def write_contract(spark: SparkSession, text: str, path: str) -> None:
    spark.range(1).select(F.lit(text).alias("value")).write.mode("overwrite").text(f"{path}/encoding")


def read_contract(spark: SparkSession, path: str) -> Contract | None:
    """The contract beside the rows; None where there is none."""
    try:
        line = spark.read.text(f"{path}/encoding").first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    if line is None:
        raise ValueError(f"{path} has an empty contract")
    return Contract.from_json(line["value"])


def _checked(c: str, ok: Column, value: Column, kind: str, what: str) -> Column:
    return F.when(ok, value.cast(kind)).otherwise(F.raise_error(F.lit(f"{c}: {what}")).cast(kind)).alias(c)


def read_tokens(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, vocab: V.Vocab | None = None, where: Column | str | None = None
) -> DataFrame:
    """Stored tokens as ids (long) and scalars (float), all columns or those asked for.

    ``where`` is a condition on the stored columns and reaches the scan. Refused before any row is read: another version,
    a changed contract, another vocabulary than ``vocab``, a column of another type than the contract says, a scalar that
    it does not name. Refused while rows are read: nulls, ids and codes outside their range, in the columns that are
    read. Without a contract scalars must be floating and are read as they are; whole numbers are not guessed at.
    """
    contract = read_contract(spark, path)
    stored = spark.read.parquet(f"{path}/rows")
    kinds = dict(stored.dtypes)
    wanted = list(stored.columns if columns is None else columns)
    absent = [c for c in wanted if c not in kinds]
    if absent:
        raise ValueError(f"{path} has no columns {absent}")
    if where is not None:
        stored = stored.where(where)
    if contract is None:
        coded = [c for c in wanted if c.startswith("val_") and kinds[c] not in ("float", "double")]
        if coded:
            raise ValueError(f"{path} has no contract, the scale of {coded} is not known")
        return stored.select(*[F.col(c).cast("float").alias(c) if c.startswith("val_") else F.col(c) for c in wanted])
    if vocab is not None and contract != Contract.of(vocab):
        raise ValueError(f"{path} was stored with another vocabulary")
    out = []
    for c in wanted:
        if c not in contract.tokens and c not in contract.scalars:
            if c.startswith("val_"):
                raise ValueError(f"the contract does not name {c!r}")
            out.append(F.col(c))
            continue
        if kinds[c] != contract.stored(c):
            raise ValueError(f"{c!r} is stored as {kinds[c]}, the contract says {contract.stored(c)}")
        if c in contract.tokens:
            out.append(_checked(c, F.col(c).between(0, contract.tokens[c] - 1), F.col(c), "long", "not an id of the vocabulary"))
        else:
            code = F.col(c).cast("float") * F.lit(contract.scalars[c] / V.QUANT_MAX).cast("float")
            out.append(_checked(c, F.abs(F.col(c).cast("int")) <= V.QUANT_MAX, code, "float", "not a 16-bit scalar"))
    return stored.select(*out)


def audit(rows: DataFrame, contract: Contract) -> DataFrame:
    """One row per column of the contract from one scan of stored rows: ``n_rows, nulls, outside`` and a status."""
    aggs, cells = [], []
    for i, c in enumerate((*contract.tokens, *contract.scalars)):
        v = F.col(c).cast("long")
        inside = v.between(0, contract.tokens[c] - 1) if c in contract.tokens else F.abs(v) <= V.QUANT_MAX
        aggs += [F.count_if(v.isNull()).alias(f"x{i}"), F.count_if(~inside).alias(f"o{i}")]
        status = F.when((F.col(f"x{i}") == 0) & (F.col(f"o{i}") == 0), "pass").otherwise("fail")
        cells.append(F.struct(
            F.lit(c).alias("column"), F.col("n_rows"), F.col(f"x{i}").alias("nulls"), F.col(f"o{i}").alias("outside"), status.alias("status")
        ))
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), *aggs).select(F.inline(F.array(*cells)))
