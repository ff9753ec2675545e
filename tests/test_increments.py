"""Vocabularies by days: a merge of days equals a fit on all rows, days given again replace, storage contracts refuse."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from flowmill.operators import increments as I, vocab as V
from flowmill.session import new_path
from flowmill.sources import encoded as S

SPECS = (
    V.FieldSpec("side", "side", "categorical"),
    V.FieldSpec("price", "price_rel", "ordinal", 8),
    V.FieldSpec("size", "size", "ordinal", 4, applicable=("ADD",)),
    V.FieldSpec("flat", "flat", "ordinal", 4),
    V.FieldSpec("gap", "gap", "continuous"),
)


def days(spark, n=4, rows=300):
    i = F.col("id")
    x = F.pmod(F.xxhash64("id"), F.lit(10_007)).cast("double")
    return spark.range(n * rows).select(
        i, F.concat(F.lit("2024-01-0"), (1 + F.floor(i / rows)).cast("string")).alias("date"),
        F.when(i % 5 != 0, F.lit("ADD")).otherwise("CXL").alias("evt_type"),
        F.when(i % 11 != 0, F.element_at(F.array(F.lit("B"), F.lit("S"), F.lit("N")), (1 + i % 3).cast("int"))).alias("side"),
        F.when(i % 7 != 0, x / 100 - 50).when(i % 2 == 0, F.lit(float("nan"))).alias("price_rel"),
        F.when(i % 2 == 0, F.lit(1.0)).otherwise(x % 20).alias("size"), F.lit(3.0).alias("flat"), (x * 1e6 + 0.1).alias("gap"),
    )


def same(a, b):
    assert a.categories == b.categories and a.category_counts == b.category_counts and a.category_missing == b.category_missing
    assert a.fit_dates == b.fit_dates and set(a.numeric) == set(b.numeric)
    for k, f in a.numeric.items():
        g = b.numeric[k]
        assert (f.edges, f.occupancy, f.n_observed, f.n_missing, f.min_value, f.max_value, f.requested) == (
            g.edges, g.occupancy, g.n_observed, g.n_missing, g.min_value, g.max_value, g.requested)
        assert f.mean == pytest.approx(g.mean, rel=1e-12, abs=1e-12) and f.std == pytest.approx(g.std, rel=1e-12)


def test_a_merge_of_days_equals_a_fit_on_all_rows(spark):
    df = days(spark)
    store = I.DayCounts(spark, new_path(spark, "days"), SPECS)
    for k in (3, 1, 2, 4):
        store.add(df.where(F.col("date") == f"2024-01-0{k}"))
    same(store.fit(), V.fit_vocab(df, SPECS))
    same(store.fit(last="2024-01-02"), V.fit_vocab(df.where("date <= '2024-01-02'"), SPECS))
    same(store.fit(first="2024-01-02", last="2024-01-03"), V.fit_vocab(df.where("date between '2024-01-02' and '2024-01-03'"), SPECS))


def test_a_day_given_again_is_replaced(spark):
    df = days(spark, 2)
    store = I.DayCounts(spark, new_path(spark, "days"), SPECS)
    store.add(df.where("id % 2 = 0"))
    store.add(df)
    again = I.DayCounts(spark, store.path, SPECS)  # as another process finds it
    again.add(df.where("date = '2024-01-02'"))
    same(again.fit(), V.fit_vocab(df, SPECS))


def test_days_without_values(spark):
    df = days(spark, 2).withColumn("price_rel", F.when(F.col("date") == "2024-01-02", F.col("price_rel"))).withColumn("gap", F.lit(None).cast("double"))
    store = I.DayCounts(spark, new_path(spark, "days"), SPECS)
    store.add(df)
    same(store.fit(), V.fit_vocab(df, SPECS))
    first = store.fit(last="2024-01-01")
    assert first.numeric["price"].edges == () and first.numeric["price"].n_missing == 300 and first.fit_dates == ("2024-01-01",)
    assert (first.numeric["gap"].mean, first.numeric["gap"].std, first.numeric["gap"].min_value) == (0.0, 1.0, None)
    empty = store.fit(first="2025-01-01")
    assert empty.fit_dates == () and empty.categories == {"side": ()} and empty.numeric["size"].n_observed == 0


def test_a_row_without_a_day_fails(spark):
    store = I.DayCounts(spark, new_path(spark, "days"), SPECS)
    with pytest.raises(PySparkException, match="without a day"):
        store.add(days(spark, 1).withColumn("date", F.when(F.col("id") != 7, F.col("date"))))


def test_moments_merge_in_any_order():
    parts = [{"n_observed": n, "n_missing": 1, "mean": m, "m2": q, "min_value": m - 1, "max_value": m + 1} for n, m, q in ((3, 1e9, 2.0), (5, -7.0, 1.5), (1, 0.1, 0.0))]
    parts.append({"n_observed": 0, "n_missing": 4, "mean": None, "m2": 0.0, "min_value": None, "max_value": None})
    one = I.merged_moments(parts)
    assert one == I.merged_moments(parts[::-1]) and (one["n_observed"], one["n_missing"]) == (9, 7)
    assert (one["min_value"], one["max_value"]) == (-8.0, 1e9 + 1)


def test_a_vocabulary_is_read_back(spark):
    vocab, path = V.fit_vocab(days(spark, 1), SPECS), new_path(spark, "vocab")
    I.save_vocab(spark, vocab, path)
    I.save_vocab(spark, vocab, path)
    assert I.load_vocab(spark, path) == vocab


# --- storage contracts --------------------------------------------------------


@pytest.fixture(scope="module")
def stored(spark):
    df = days(spark, 2)
    vocab = V.fit_vocab(df, SPECS)
    tokens = V.tokenize(df, vocab, ["id", "date"])
    path = new_path(spark, "tokens")
    S.write_tokens(tokens, vocab, path)
    return vocab, tokens, path


def copied(spark, path, change=None, rows=lambda df: df):
    """The table under another path, with a changed contract or changed rows."""
    text = spark.read.text(f"{path}/encoding").first()["value"]
    to = new_path(spark, "tokens")
    rows(spark.read.parquet(f"{path}/rows")).write.parquet(f"{to}/rows")
    S.write_contract(spark, change(text) if change else text, to)
    return to


def test_round_trip(spark, stored):
    vocab, tokens, path = stored
    back = S.read_tokens(spark, path, vocab=vocab)
    assert dict(back.dtypes) == dict(tokens.dtypes)
    both = tokens.alias("a").join(back.alias("b"), "id")
    wrong = [F.col(f"a.{c}") != F.col(f"b.{c}") for c in tokens.columns if c.startswith("tok_")]
    wrong += [F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) > 0.51 * vocab.clip / V.QUANT_MAX for c in tokens.columns if c.startswith("val_")]
    assert both.count() == 600 and both.where(F.array_contains(F.array(*wrong), True)).count() == 0


def test_only_the_columns_asked_for_are_read(spark, stored, capsys):
    vocab, tokens, path = stored
    some = S.read_tokens(spark, path, ["id", "val_gap"], vocab, where="tok_side = 6")
    assert some.columns == ["id", "val_gap"] and some.count() == tokens.where("tok_side = 6").count()
    some.explain("formatted")
    plan = capsys.readouterr().out
    assert "ReadSchema: struct<id:bigint,tok_side:smallint,val_gap:smallint>" in plan and "EqualTo(tok_side,6)" in plan


def altered(**values):
    def change(text):
        return json.dumps({**json.loads(text), **values})
    return change


@pytest.mark.parametrize(("change", "message"), [
    (altered(format_version="token_uint_scalar_q16_v2"), "unknown storage form"),
    (altered(scheme="other"), "unknown storage form"),
    (altered(scalars={"val_price": 4.0}), "digest it declares"),
    (altered(more=1), "keys"),
    (lambda text: json.dumps({k: v for k, v in json.loads(text).items() if k != "tokens"}), "keys"),
])
def test_changed_contracts_are_refused(spark, stored, change, message):
    with pytest.raises(ValueError, match=message):
        S.read_tokens(spark, copied(spark, stored[2], change))


def test_other_vocabularies_and_types_are_refused(spark, stored):
    vocab, tokens, path = stored
    with pytest.raises(ValueError, match="another vocabulary"):
        S.read_tokens(spark, path, vocab=V.fit_vocab(days(spark, 1), SPECS))
    wide = copied(spark, path, rows=lambda df: df.withColumn("tok_side", F.col("tok_side").cast("int")))
    with pytest.raises(ValueError, match="stored as int"):
        S.read_tokens(spark, wide)
    assert S.read_tokens(spark, wide, ["id", "val_gap"]).count() == 600
    more = copied(spark, path, rows=lambda df: df.withColumn("val_other", F.lit(1).cast("short")))
    with pytest.raises(ValueError, match="does not name"):
        S.read_tokens(spark, more)
    with pytest.raises(ValueError, match="no columns"):
        S.read_tokens(spark, path, ["nothing"])
    with pytest.raises(ValueError, match="val_price"):
        S.write_tokens(tokens.drop("val_price"), vocab, new_path(spark, "tokens"))


@pytest.mark.parametrize(("column", "value", "message"), [
    ("tok_side", "9999", "not an id"), ("tok_side", "-1", "not an id"), ("tok_side", "null", "not an id"),
    ("val_gap", "-32768", "not a 16-bit scalar"), ("val_gap", "null", "not a 16-bit scalar"),
])
def test_bad_rows_fail_and_are_counted(spark, stored, column, value, message):
    bad = copied(spark, stored[2], rows=lambda df: df.withColumn(column, F.when(F.col("id") == 17, F.expr(f"cast({value} as short)")).otherwise(F.col(column))))
    with pytest.raises(PySparkException, match=message):
        S.read_tokens(spark, bad, [column]).collect()
    found = {r["column"]: (r["nulls"] + r["outside"], r["status"]) for r in S.audit(spark.read.parquet(f"{bad}/rows"), S.read_contract(spark, bad)).collect()}
    assert found.pop(column) == (1, "fail") and set(found.values()) == {(0, "pass")}


def test_tables_without_a_contract(spark, stored):
    vocab, tokens, path = stored
    bare, floats = new_path(spark, "bare"), new_path(spark, "floats")
    spark.read.parquet(f"{path}/rows").write.parquet(f"{bare}/rows")
    with pytest.raises(ValueError, match="no contract"):
        S.read_tokens(spark, bare)
    tokens.withColumn("val_gap", F.col("val_gap").cast("double")).write.parquet(f"{floats}/rows")
    assert dict(S.read_tokens(spark, floats).dtypes)["val_gap"] == "float"


def test_a_failed_write_leaves_no_contract(spark, stored):
    vocab, tokens, _ = stored
    path = new_path(spark, "tokens")
    with pytest.raises(PySparkException, match="outside the vocabulary"):
        S.write_tokens(tokens.withColumn("tok_side", F.col("tok_side") + 100), vocab, path)
    assert S.read_contract(spark, path) is None
