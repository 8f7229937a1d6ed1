from dataclasses import dataclass

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from granary import schema as S
from granary.expr import col
from granary.operators.groupby import group_reduce
from granary.operators.table import ReadOnlyError, Table, concat


@dataclass
class Row:
    id: int = S.column(S.int64(ge=0))
    score: float = S.column(S.float64(ge=0, le=100), default=0.0)
    active: bool = True


@dataclass
class Sale:
    city: str = S.column(S.string(16, nullable=True))
    category: int = 0
    sales: float = S.column(S.float64(nullable=True), default=None)
    qty: int = 0


@pytest.fixture
def t(spark):
    return Table.from_rows(spark, Row, [(3, 80.0, True), (1, 50.0, False), (4, 90.0, True), (2, 50.0, True), (0, 70.0, False)])


@pytest.fixture
def sales(spark):
    rows = [("Rome", 1, 10.0, 1), ("Oslo", 2, None, 2), ("Rome", 1, 5.0, 3), (None, 1, 7.0, 4), ("Oslo", 2, None, 5), ("Rome", 2, 1.0, 6)]
    return Table.from_rows(spark, Sale, rows)


def ids(table):
    return [r.id for r in table]


def test_rows_and_positions(t):
    assert len(t) == 5 and ids(t) == [3, 1, 4, 2, 0]
    assert t[0].id == 3 and t[-1].id == 0 and t[-5].score == 80.0
    for bad in (5, -6):
        with pytest.raises(IndexError):
            t[bad]
    assert ids(t[1:4]) == [1, 4, 2]
    assert ids(t[::-2]) == [0, 4, 3]
    assert ids(t[-2:]) == [2, 0]
    assert ids(t.take([4, 0, 0, -2])) == [0, 3, 3, 2]
    with pytest.raises(IndexError):
        t.take([9])
    assert ids(t.head(2)) == [3, 1] and ids(t.tail(2)) == [2, 0]
    assert ids(t[np.array([True, False, True, False, True])]) == [3, 4, 0]
    assert ids(t.where("active")[np.array([False, True, True])]) == [4, 2]
    assert len(t.sample(3, seed=1)) == 3 and len(t.sample(99, seed=1)) == 5


def test_select_where_assign(t):
    assert t.select(["score", "id"]).columns == ["score", "id"]
    with pytest.raises(ValueError):
        t.select([])
    with pytest.raises(KeyError):
        t.select(["nope"])
    assert ids(t.where("score > 60 and not active")) == [0]
    assert ids(t[(t.score > 60) & t.active.expr]) == [3, 4]
    assert ids(t["score == 50"]) == [1, 2]
    made = t.assign(double=t.score * 2, plus=col("id") + 1)
    assert [r.double for r in made][:2] == [160.0, 100.0]
    with pytest.raises(ValueError):
        t.assign(id=1)
    assert "double" not in t.columns
    with pytest.raises(ReadOnlyError):
        made.append((9, 1.0, True))


def test_sort(t):
    assert ids(t.sort_by("id")) == [0, 1, 2, 3, 4]
    assert ids(t.sort_by(["score", "id"], [True, False])) == [2, 1, 0, 3, 4]
    assert ids(t.sort_by("score")) == [1, 2, 0, 3, 4]  # stable
    assert ids(t.sorted_slice("id", slice(1, 3), ascending=False)) == [3, 2]
    assert list(t.argsort("score")) == [1, 3, 4, 0, 2]
    ordered = t.sort_by("id", view=True)
    assert ordered[-1].id == 4 and ids(ordered.tail(2)) == [3, 4] and ids(ordered[-2:]) == [3, 4] and ids(ordered[::2]) == [0, 2, 4]
    with pytest.raises(IndexError):
        ordered[-6]
    with pytest.raises(ValueError):
        t.sort_by(["id"], [True, False])
    with pytest.raises(ValueError):
        t.sort_by("id", inplace=True, view=True)
    t.sort_by("id", inplace=True)
    assert ids(t) == [0, 1, 2, 3, 4] and t[1].id == 1


def test_nulls_sort_last(sales):
    assert [r.sales for r in sales.sort_by("sales", ascending=False)] == [10.0, 7.0, 5.0, 1.0, None, None]
    assert [r.city for r in sales.sort_by("city")][-1] is None
    assert len(sales.dropna()) == 3 and len(sales.dropna(["city"])) == 5


def test_nan_between_values_and_nulls(spark):
    t = Table.from_frame(spark.createDataFrame([(float("nan"),), (1.0,), (None,), (2.0,)], "x double").coalesce(1))
    for up, values in ((True, [1.0, 2.0]), (False, [2.0, 1.0])):
        got = [r.x for r in t.sort_by("x", ascending=up)]
        assert got[:2] == values and np.isnan(got[2]) and got[3] is None


def test_aggregates(t, sales):
    assert t.score.sum() == 340.0 and t.id.sum(where="active") == 9
    assert t.score.min() == 50.0 and t.score.argmin() == 1 and t.score.argmax() == 2
    assert t.score.std() == pytest.approx(np.std([80, 50, 90, 50, 70])) and t.score.std(ddof=1) == pytest.approx(np.std([80, 50, 90, 50, 70], ddof=1))
    assert t.active.any() and not t.active.all()
    assert list(t.score.unique()) == [50.0, 70.0, 80.0, 90.0]
    assert t.score.value_counts()[50.0] == 2
    assert np.isnan(t.where("id > 9").score.mean()) and t.where("id > 9").score.sum() == 0
    for bad in ("min", "max"):
        with pytest.raises(ValueError):
            getattr(t.where("id > 9").score, bad)()
    with pytest.raises(TypeError):
        sales.city.sum()
    assert sales.sales.null_count() == 2 and sales.sales.mean() == pytest.approx(5.75)
    assert np.allclose(t.select(["id", "score"]).cov(), np.cov([[3, 1, 4, 2, 0], [80, 50, 90, 50, 70]]))
    d = t.describe()
    assert d.loc["active", "true"] == 3 and d.loc["score", "mean"] == 68.0


def test_change(t):
    t.append((7, 60.0, False))
    t.extend({"id": [8, 9], "score": [1.0, 2.0]})
    assert ids(t) == [3, 1, 4, 2, 0, 7, 8, 9] and t[-1].active is True
    for bad in ((-1, 1.0, True), (1, 101.0, True)):
        with pytest.raises(S.ConstraintError):
            t.append(bad)
    t.extend([(-5, 1.0, True)], validate=False)
    t.delete(-1)
    t.delete([0, 2])
    t.delete(slice(0, 1))
    assert ids(t) == [2, 0, 7, 8, 9]
    with pytest.raises(IndexError):
        t.delete(99)
    t["score"][1] = 33.0
    t["score"][[0, 2]] = [11.0, 22.0]
    t["score"][col("id") > 7] = 5.0
    assert [r.score for r in t] == [11.0, 33.0, 22.0, 5.0, 5.0]
    with pytest.raises(S.ConstraintError):
        t["score"][0] = 500.0
    t.compact()
    assert ids(t) == [2, 0, 7, 8, 9]


def test_schema_changes(t):
    t.add_column("tag", S.string(8), default="x")
    t.add_column("n", S.int32(), values=[1, 2, 3, 4, 5])
    t.rename_column("tag", "label")
    assert t.columns == ["id", "score", "active", "label", "n"] and t[1].n == 2
    t.add_computed_column("twice", "score * 2")
    t.add_generated_column("next", "id + 1")
    assert t[0].twice == 160.0 and t[0].next == 4
    t.append((6, 10.0, True, "y", 6))
    assert t[-1].twice == 20.0 and t[-1].next == 7
    with pytest.raises(ReadOnlyError):
        t["twice"][0] = 1.0
    t.drop_computed_column("twice")
    t.drop_column("n")
    assert "twice" not in t.columns and "n" not in t.columns
    for bad in (lambda: t.rename_column("id", "score"), lambda: t.add_column("id", S.int64())):
        with pytest.raises(ValueError):
            bad()
    t.convert_nulls("score", to="sentinel", null_value=-1.0)
    assert t.column_schema("score").null_storage == "sentinel"


def test_group_by(sales):
    out = {r.city: r for r in sales.group_by("city").agg({"sales": ["sum", "mean", "count"], "qty": "max"})}
    assert set(out) == {"Rome", "Oslo"}
    assert out["Rome"].sales_sum == 16.0 and out["Oslo"].sales_count == 0
    assert np.isnan(out["Oslo"].sales_sum) and np.isnan(out["Oslo"].sales_mean) and out["Oslo"].qty_max == 5
    kept = [r.city for r in sales.group_by("city", dropna=False).size()]
    assert kept == [None, "Oslo", "Rome"]
    assert sales.group_by("city").size()[-1].city == "Rome" and sales.group_by("city").size()[0].city == "Oslo"
    named = {r.city: r for r in sales.group_by("city").agg(n=("*", "size"), top=("sales", "argmax"), low=("qty", "argmin"))}
    assert named["Rome"].n == 3 and named["Rome"].top == 0 and named["Oslo"].top == -1 and named["Oslo"].low == 1
    spread = {r.city: r.s for r in sales.group_by("city").agg(s=("sales", lambda v: v.max() - v.min()))}
    assert spread["Rome"] == 9.0 and spread["Oslo"] is None
    for bad in (
        lambda: sales.group_by("city").agg([("sales", "median")]),
        lambda: sales.group_by("city").agg(a=("qty", "sum"), city=("qty", "sum")),
        lambda: sales.group_by([]),
    ):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(TypeError):
        sales.group_by("category").sum("city")
    with pytest.raises(NotImplementedError):
        sales.group_by("city", engine="jit")


def test_float_keys(spark):
    df = spark.createDataFrame([(0.0, 1), (-0.0, 2), (float("nan"), 3), (1.0, 4)], "k double, v long")
    t = Table.from_frame(df)
    assert [(r.k, r.size) for r in t.group_by("k").size()] == [(0.0, 2), (1.0, 1)]
    kept = [r.k for r in t.group_by("k", dropna=False).size()]
    assert len(kept) == 3 and sum(np.isnan(k) for k in kept) == 1


def test_group_reduce(spark):
    got = group_reduce(spark, [2, 1, 2, 1], [1.0, np.nan, 3.0, 4.0], "sum")
    assert got["key"].tolist() == [1, 2] and got["value"].tolist() == [4.0, 4.0]
    kept = group_reduce(spark, [np.nan, 1.0], None, "size", dropna=False)
    assert kept["key"].iloc[0] == 1.0 and kept["value"].tolist() == [1, 1]


def test_concat_and_apply(t):
    both = concat([t.select(["id"]), t.select(["id"]).head(2)])
    assert ids(both) == [3, 1, 4, 2, 0, 3, 1]
    assert [r.result for r in t.apply(lambda s: s + 1, ["score"])] == [81.0, 51.0, 91.0, 51.0, 71.0]


def test_indexes_never_change_answers(spark):
    df = spark.range(5000).select("id", (F.col("id") * 7919 % 1000).alias("x"))
    t = Table(df.withColumn("__pos", F.col("id")), dense=True)
    for kind in ("SUMMARY", "BUCKET", "PARTIAL", "FULL", "OPSI"):
        index = t.create_index("x", kind=kind, name=kind)
        assert ids(index.between(100, 110)) == ids(t.where("x >= 100 and x <= 110"))
        assert ids(index.equal(7)) == ids(t.where("x == 7"))
        assert index.min_max() == (0, 999) and index.nbytes > 0
    assert [r.x for r in t.index("FULL").ordered(0, 12)] == sorted(x * 7919 % 1000 for x in range(5000))[:12]
    made = t.create_index(expression="x * 2", kind="FULL", name="twice")
    assert ids(made.equal(14)) == ids(t.where("x == 7"))
    t.delete(0)
    assert t.index("FULL").stale
    with pytest.raises(RuntimeError):
        t.index("FULL").equal(1)
    assert ids(t.rebuild_index("FULL").equal(0)) == ids(t.where("x == 0"))
    t.drop_index("FULL")
    with pytest.raises(ValueError):
        t.create_index("x", kind="NOPE")


def test_schema_round_trip():
    compiled = S.compile_schema(Sale)
    assert S.CompiledSchema.from_json(compiled.to_json()).specs == compiled.specs
    for bad in ("", "__x", "a/b"):
        with pytest.raises(ValueError):
            S.check_name(bad)
    with S.null_policy(S.NullPolicy("sentinel")):
        assert S.float64(nullable=True).null_storage == "sentinel"
    assert S.split_path(S.join_path(["a.b", "c"])) == ["a.b", "c"]


def test_sentinels_become_nulls(spark):
    @dataclass
    class Coded:
        code: int = S.column(S.int64(nullable=True, null_value=-999))
        x: float = S.column(S.float64(nullable=True, null_value=float("nan")))

    S.typing.get_type_hints(Coded)
    t = Table.from_rows(spark, Coded, {"code": [1, -999], "x": [float("nan"), 2.0]})
    assert [tuple(r) for r in t] == [(1, None), (None, 2.0)]
    assert isinstance(t.to_pandas(), pd.DataFrame)


def test_nan_and_indexes(spark):
    v = [1.0, 7.0, float("nan"), None, 6.0]
    for kind in ("SUMMARY", "BUCKET", "PARTIAL", "FULL", "OPSI"):
        t = Table.from_frame(spark.createDataFrame([(x,) for x in v], "x double"), ordered_by=[F.col("x")]).copy()
        index = t.create_index("x", kind=kind)
        for low, high in ((5, None), (None, 6.5), (2, 6), (None, None), (99, None)):
            bounds = " and ".join([f"x >= {low}"] * (low is not None) + [f"x <= {high}"] * (high is not None)) or "x == x or is_null(x) or isnan(x)"
            assert sorted(map(str, index.between(low, high)["x"].to_numpy())) == sorted(map(str, t.where(bounds)["x"].to_numpy())), (kind, bounds)
        assert index.min_max() == (1.0, 7.0) and len(t.where("x >= 5")) == 2


def test_where_reads_indexes(spark):
    df = spark.range(200_000).select("id", (F.col("id") * 7919 % 1000).alias("x"), F.concat(F.lit("n"), F.col("id") % 50).alias("name"))
    t = Table(df.withColumn("__pos", F.col("id")), dense=True)
    conditions = ["x < 3", "3 <= x <= 5 and id > 100", col("x") * 2 >= 1990, (col("x") == 7) & (col("name") == "n3"), "name == 'n7' and not (x > 500)", "x < 3 or x > 990", "~(x > 5)"]
    want = {str(c): sorted(r.id for r in t.where(c).df.select("id").collect()) for c in conditions}
    assert not any(t.will_use_index(c) for c in conditions)
    t.create_index("x", kind="BUCKET")
    t.create_index("name", kind="SUMMARY")
    t.create_index(expression="x * 2", kind="FULL", name="twice")
    assert [t.will_use_index(c) for c in conditions] == [True] * 5 + [False] * 2
    for c in conditions:
        assert sorted(r.id for r in t.where(c).df.select("id").collect()) == want[str(c)], c
    assert "Index: twice" in t.explain("x * 2 > 1996") and "Index: none" in t.explain("x > 3 or id == 1")
    by_id = t.create_index("id", kind="FULL", name="id")
    files = t.where("id < 10").df.inputFiles()
    assert files and all(by_id.path in f for f in files)
    assert t.where("id < 10")[:3].to_pandas()["id"].tolist() == [0, 1, 2]
    text = t.explain("id < 10")
    assert "PushedFilters" in text and "LessThan(__indexed,10)" in text
    t.drop_index("id")
    assert not t.will_use_index("id < 10")


def test_positions_by_range(t):
    whole = ids(t)
    own = t.copy()
    own.delete(slice(1, None, 2))
    assert ids(own) == whole[::2]
    own["score"][::2] = 1.5
    own["score"][[1]] = 7.25
    assert [r.score for r in own] == [1.5, 7.25, 1.5]
    assert ids(t[2:]) == whole[2:] and ids(t[:]) == whole and ids(t[9:]) == []
    assert "Offset" not in t[2:].df._jdf.queryExecution().toString()
    assert sorted(r.position for r in t.coordinates("score > 60").collect()) == [0, 2, 4]
