import pytest

from granary.operators import dictionary
from granary.operators.table import Table


@pytest.fixture
def t(spark):
    rows = [(i, v) for i, v in enumerate(["b", None, "é", "a", "b", ""])]
    return Table(spark.createDataFrame([(*r, r[0]) for r in rows], "id long, s string, __pos long"), dense=True)


def test_codes_and_values(t):
    codes = dictionary.factorize(t, "s")
    assert {(r.code, r.value) for r in codes.collect()} == {(0, ""), (1, "a"), (2, "b"), (3, "é")}
    encoded = dictionary.encode(t, "s", codes)
    assert [r.s_code for r in encoded] == [2, -1, 3, 1, 2, 0]
    assert [r.back for r in dictionary.decode(encoded, "s_code", codes, "back")] == [r.s for r in t]
    assert [r.rank for r in dictionary.ranks(t, "s")] == [2, None, 3, 1, 2, 0]


def test_fixed_width(t):
    wide = t.assign(w="s + 'xyz'")
    assert [r.w for r in dictionary.from_utf8(wide, "w", 2)] == ["bx", None, "éx", "ax", "bx", "xy"]
