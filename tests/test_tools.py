import numpy as np
import pytest
from pyspark.sql import functions as F

from granary import cli
from granary.expr import col
from granary.functions import dtypes
from granary.operators.browser import Browser
from granary.operators.table import Table, get_printoptions, set_printoptions
from granary.plans import lazyudf


@pytest.fixture
def t(spark):
    df = spark.range(40).select("id", (F.col("id") * 7 % 10).alias("x"), F.when(F.col("id") % 4 > 0, F.col("id") * 1.0).alias("y"))
    return Table(df.withColumn("__pos", F.col("id")), dense=True)


def test_browser(t):
    b = Browser(t, page=3).set_filter("x > 4").set_sort(["x", "id"], [False, True]).set_columns(["id", "x"])
    first = b.rows()
    assert list(first.columns) == ["id", "x"] and first["x"].tolist() == [9, 9, 9] and b.rows(3)["x"].tolist() == [9, 8, 8]
    assert b.rows() is first and b.count() == 20
    assert b.group("x", n=("*", "size"))["n"].sum() == 20
    assert len(b.set_filter(None).plot("y", 5)) == 5


def test_cli(spark, t, tmp_path, capsys):
    t.to_parquet(str(tmp_path / "a"))
    assert cli.main([str(tmp_path / "a"), str(tmp_path / "b"), "--roundtrip", "--max-rows", "7"]) == 0
    assert cli.main([str(tmp_path / "b"), str(tmp_path / "c"), "--export", "--roundtrip", "--columns", "id", "y"]) == 0
    assert "7 rows" in capsys.readouterr().out and spark.read.parquet(str(tmp_path / "c")).columns == ["id", "y"]


def test_block_functions(t):
    made = t.assign(z=lazyudf(lambda a, b: np.sqrt(a) + b, col("x"), 1.0))
    assert [r.z for r in made][:3] == pytest.approx([1.0, np.sqrt(7) + 1, 3.0])


def test_types():
    assert dtypes.result_type("int32", "float32") == np.float64 and dtypes.result_type("int8", 1) == np.int8
    assert dtypes.can_cast("int32", "int64") and not dtypes.can_cast("float64", "int32")
    assert dtypes.isdtype("uint8", "integral") and not dtypes.isdtype("float32", ("bool", "integral"))
    assert dtypes.finfo("float32").bits == 32 and dtypes.iinfo("int8").max == 127
    assert dtypes.reduction_dtype("bool", "sum") == np.int64 and dtypes.reduction_dtype("int8", "mean") == np.float64


def test_display(t):
    before = get_printoptions()
    set_printoptions(max_rows=2)
    assert len(t.to_string().splitlines()) == 3
    set_printoptions(**before)
    with pytest.raises(ValueError):
        set_printoptions(colour=True)
