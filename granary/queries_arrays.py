"""Queries for array columns and N-dimensional arrays, over the whole embeddings table."""

from __future__ import annotations

import math
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import REGISTRY
from granary.operators import ndarray as nd
from granary.operators import rows
from granary.operators.random import default_rng
from granary.operators.table import dense_positions
from granary.registry import query, table
from granary.scratch import scratch_folder
from granary.sources import connector

# Array columns

_SUM = "list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE)))"


@query(f"""SELECT vec_id, round({_SUM}, 5) AS total, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 5) AS norm,
           CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS top, round({_SUM} / 64, 6) AS mean,
           CAST(list_min(embedding) AS DOUBLE) AS low, CAST(list_max(embedding) AS DOUBLE) AS high,
           CAST(list_position(embedding, list_min(embedding)) - 1 AS BIGINT) AS bottom FROM embeddings""")
def array_rows(spark, sf_dir):
    t = table(spark, sf_dir, "embeddings")
    made = t["embedding"].row_transformer
    out = t.assign(
        total=made.sum(), norm=made.norm(), top=made.argmax(), mean=made.mean(), low=made.min(), high=made.max(), bottom=made.argmin()
    ).frame
    return out.select(
        "vec_id", F.round("total", 5).alias("total"), F.round("norm", 5).alias("norm"), F.col("top").cast("long").alias("top"), F.round("mean", 6).alias("mean"),
        F.col("low").cast("double").alias("low"), F.col("high").cast("double").alias("high"), F.col("bottom").cast("long").alias("bottom"),
    )


@query("SELECT vec_id FROM embeddings WHERE embedding[1] > 0")
def array_element(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where("embedding[:, 0] > 0", columns=["vec_id"]).frame


@query("""SELECT i, round(sum(v), 4) AS total FROM (SELECT unnest(range(64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) GROUP BY 1""")
def array_over_rows(spark, sf_dir):
    found = table(spark, sf_dir, "embeddings")["embedding"].axis_reduce("sum", axis=0)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(found)], "i long, t double")
    return df.select("i", F.round("t", 4).alias("total"))


@query("""SELECT a.vec_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: CAST(p[1] AS DOUBLE) * p[2])), 5) AS d
          FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b""")
def array_dot(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    first = e.filter("vec_id = 0").first().embedding
    return e.select("vec_id", F.round(rows.dot(F.col("embedding"), F.array(*[F.lit(float(x)) for x in first])), 5).alias("d"))


# Arrays


def _matrix(spark: SparkSession, sf_dir: str) -> nd.Array:
    """All elements of all vectors, a row per vector in the order of vec_id."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    placed = dense_positions(e, [F.col("vec_id")], "i0")
    cells = placed.select("i0", F.posexplode("embedding").alias("i1", "v"))
    cells = cells.select("i0", F.col("i1").cast("long").alias("i1"), F.col("v").cast("double").alias("v"))
    return nd.Array(cells, (placed.count(), 64))


_M = """(SELECT i, unnest(range(64)) AS j, CAST(unnest(embedding) AS DOUBLE) AS v
         FROM (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS i, embedding FROM embeddings))"""
_N = "(SELECT count(*) FROM embeddings)"


def _round(x: nd.Array, digits: int = 6) -> DataFrame:
    return x.df.withColumn("v", F.round("v", digits))


@query(f"SELECT a.j AS i0, b.j AS i1, round(sum(a.v * b.v), 6) AS v FROM {_M} a JOIN {_M} b ON a.i = b.i GROUP BY 1, 2")
def array_matmul(spark, sf_dir):
    x = _matrix(spark, sf_dir)
    return _round(nd.matmul(x.T, x))


@query(f"SELECT j AS i0, round(sum(v), 6) AS v FROM {_M} GROUP BY 1")
def array_axis_sum(spark, sf_dir):
    return _round(_matrix(spark, sf_dir).sum(axis=0))


@query(f"SELECT i AS i0, round(stddev_pop(v), 6) AS v FROM {_M} GROUP BY 1")
def array_axis_std(spark, sf_dir):
    return _round(_matrix(spark, sf_dir).std(axis=1))


@query(f"SELECT i AS i0, arg_max(j, (v, -j)) AS v FROM {_M} GROUP BY 1")
def array_axis_argmax(spark, sf_dir):
    return _matrix(spark, sf_dir).argmax(axis=1).df


@query(f"SELECT i AS i0, arg_min(j, (v, j)) AS v FROM {_M} GROUP BY 1")
def array_axis_argmin(spark, sf_dir):
    return _matrix(spark, sf_dir).argmin(axis=1).df


@query(f"""SELECT i AS i0, round(var_pop(v), 6) AS v_var, round(avg(v), 6) AS v_mean, min(v) AS v_min, max(v) AS v_max, bool_or(v > 0.3) AS v_any,
           bool_and(v > -0.3) AS v_all, count(*) FILTER (v > 0) AS v_nonzero, round(product(1 + v / 100), 6) AS v_prod FROM {_M} GROUP BY 1""")
def array_axis_reductions(spark, sf_dir):
    """Every reduction along the last axis, met by position."""
    x = _matrix(spark, sf_dir)
    found = {
        "v_var": x.var(axis=1), "v_mean": x.mean(axis=1), "v_min": x.min(axis=1), "v_max": x.max(axis=1), "v_any": (x > 0.3).any(axis=1),
        "v_all": (x > -0.3).all(axis=1), "v_nonzero": (x > 0).count_nonzero(axis=1), "v_prod": (x / 100 + 1).prod(axis=1),
    }
    out = None
    for name, a in found.items():
        df = a.df.withColumnRenamed("v", name)
        out = df if out is None else out.join(df, "i0")
    return out.select("i0", *[F.round(n, 6).alias(n) if n in ("v_var", "v_mean", "v_prod") else F.col(n) for n in found])


@query(f"""SELECT j AS i0, bool_or(v > 0.35) AS has_nan, CASE WHEN bool_or(v > 0.35) THEN NULL ELSE min(v) END AS low,
           CASE WHEN bool_or(v > 0.35) THEN min(i) FILTER (v > 0.35) ELSE arg_min(i, (v, i)) END AS place FROM {_M} GROUP BY 1""")
def array_min_nan(spark, sf_dir):
    """A NaN is the minimum, and the first NaN its place."""
    x = _matrix(spark, sf_dir)
    odd = (x > 0.35).where(math.nan, x)
    low = odd.min(axis=0).df.withColumnRenamed("v", "low")
    place = odd.argmin(axis=0).df.withColumnRenamed("v", "place")
    return low.join(place, "i0").select("i0", F.isnan("low").alias("has_nan"), F.nanvl("low", F.lit(None).cast("double")).alias("low"), "place")


@query(f"SELECT i AS i0, j AS i1, round(sum(v) OVER (PARTITION BY i ORDER BY j), 6) AS v FROM {_M}")
def array_cumsum(spark, sf_dir):
    return _round(nd.cumulative_sum(_matrix(spark, sf_dir), axis=1))


@query(f"SELECT i AS i0, j AS i1, round(product(1 + v / 100) OVER (PARTITION BY j ORDER BY i), 6) AS v FROM {_M}")
def array_cumprod(spark, sf_dir):
    return _round(nd.cumulative_prod(_matrix(spark, sf_dir) / 100 + 1, axis=0))


@query(f"SELECT i * 64 + j AS i0, round(sum(v) OVER (ORDER BY i, j), 6) AS v FROM {_M}")
def array_flat_cumsum(spark, sf_dir):
    return _round(nd.cumulative_sum(_matrix(spark, sf_dir)))


@query(f"SELECT i AS i0, j AS i1, round((v - m) * 2, 6) AS v FROM {_M} JOIN (SELECT i, avg(v) AS m FROM {_M} GROUP BY 1) USING (i)")
def array_broadcast(spark, sf_dir):
    x = _matrix(spark, sf_dir)
    return _round((x - x.mean(axis=1, keepdims=True)) * 2)


@query(f"SELECT a.i AS i0, a.j AS i1, round(a.v * b.v + CASE WHEN a.v > b.v THEN 1 ELSE 0 END, 6) AS v FROM {_M} a JOIN (SELECT i, 63 - j AS j, v FROM {_M}) b USING (i, j)")
def array_zip(spark, sf_dir):
    """Two arrays of one shape and different lineage in one expression."""
    x = _matrix(spark, sf_dir)
    return _round(nd.evaluate("a * b + where(a > b, 1, 0)", {"a": x, "b": x[:, ::-1]}))


@query(f"SELECT (i * 64 + j) // 16 AS i0, (i * 64 + j) % 16 AS i1, v FROM {_M}")
def array_reshape(spark, sf_dir):
    return nd.reshape(_matrix(spark, sf_dir), (-1, 16)).df


@query(f"SELECT (i - 2) // 3 AS i0, j AS i1, v FROM {_M} WHERE i >= 2 AND (i - 2) % 3 = 0")
def array_slice(spark, sf_dir):
    return _matrix(spark, sf_dir)[2::3].df


@query(f"SELECT CAST(row_number() OVER (ORDER BY v, i, j) - 1 AS BIGINT) AS i0, v FROM {_M}")
def array_sort(spark, sf_dir):
    return nd.sort(nd.reshape(_matrix(spark, sf_dir), -1)).df


@query(f"SELECT CAST(row_number() OVER (ORDER BY v, i, j) - 1 AS BIGINT) AS i0, i * 64 + j AS v FROM {_M}")
def array_argsort(spark, sf_dir):
    return nd.argsort(nd.reshape(_matrix(spark, sf_dir), -1)).df


@query(f"SELECT CAST(row_number() OVER (ORDER BY v, i) - 11 AS BIGINT) AS i0, v FROM {_M} WHERE j = 5 QUALIFY row_number() OVER (ORDER BY v, i) BETWEEN 11 AND 30")
def array_iter_sorted(spark, sf_dir):
    found = list(nd.iter_sorted(_matrix(spark, sf_dir)[:, 5], 10, 30))
    return spark.createDataFrame(list(enumerate(found)), "i0 long, v double")


@query(f"SELECT count(*) AS n, round(sum(v), 6) AS total FROM {_M} WHERE v > 0")
def array_mask(spark, sf_dir):
    x = _matrix(spark, sf_dir)
    return x[x > 0].df.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 6).alias("total"))


@query(f"SELECT j AS i0, i AS i1, v FROM {_M}")
def array_transpose(spark, sf_dir):
    return nd.matrix_transpose(_matrix(spark, sf_dir)).df


@query(f"SELECT j AS i0, 0 AS i1, i // 2 AS i2, i % 2 AS i3, v FROM {_M}")
def array_permute_dims(spark, sf_dir):
    """Reshape, permute, add and drop axes."""
    x = _matrix(spark, sf_dir)
    y = nd.permute_dims(nd.reshape(x, (-1, 2, 64)), (2, 0, 1))
    return nd.expand_dims(nd.squeeze(nd.expand_dims(y, (0, 2))), 1).df


@query(f"SELECT i AS i0, k AS i1, j AS i2, v * (1 + k) AS v FROM {_M}, (SELECT unnest([0, 1]) AS k)")
def array_stack(spark, sf_dir):
    x = _matrix(spark, sf_dir)
    return nd.stack([x, x * 2], axis=1).df


@query(f"SELECT i AS i0, j + 64 * k AS i1, v + k AS v FROM {_M}, (SELECT unnest([0, 1]) AS k)")
def array_concat(spark, sf_dir):
    x = _matrix(spark, sf_dir)
    return nd.concat([x, x + 1], axis=1).df


@query(f"SELECT i AS i0, CAST(p.k AS BIGINT) AS i1, v FROM {_M} JOIN (SELECT unnest([0, 1, 2, 3]) AS k, unnest([5, 63, 5, 0]) AS j) p USING (j)")
def array_take(spark, sf_dir):
    return nd.take(_matrix(spark, sf_dir), [5, -1, 5, 0], axis=1).df


@query(f"SELECT i AS i0, row_number() OVER (PARTITION BY i ORDER BY v, j) - 1 AS i1, v FROM {_M}")
def array_take_along_axis(spark, sf_dir):
    """Each row in order, gathered by the places that sort it."""
    x = _matrix(spark, sf_dir)
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("i0").orderBy("v", "i1")) - 1
    order = nd.Array(x.df.select("i0", place.cast("long").alias("__k"), F.col("i1").alias("v")).withColumnRenamed("__k", "i1"), x.shape)
    return nd.take_along_axis(x, order, axis=1).df


@query(f"SELECT CAST(a.k AS BIGINT) AS i0, CAST(b.k AS BIGINT) AS i1, v FROM {_M} JOIN (SELECT unnest([0, 1]) AS k, unnest([7, 2]) AS i) a USING (i) JOIN (SELECT unnest([0, 1, 2]) AS k, unnest([0, 9, 9]) AS j) b USING (j)")
def array_oindex(spark, sf_dir):
    return _matrix(spark, sf_dir).oindex([7, 2], [0, 9, 9]).df


@query(f"SELECT i AS i0, j AS i1, CASE WHEN j = 3 THEN 0 WHEN i % 2 = 0 AND j >= 60 THEN j - 60 ELSE v END AS v FROM {_M}")
def array_set_items(spark, sf_dir):
    x = _matrix(spark, sf_dir)
    return x.with_values((slice(None), 3), 0.0).with_values((slice(None, None, 2), slice(60, None)), np.arange(4.0)).df


@query(f"SELECT i AS i0, j AS i1, v FROM {_M} WHERE j < 10 UNION ALL SELECT n + k, j, 0 FROM (SELECT {_N} AS n), (SELECT unnest(range(3)) AS k), (SELECT unnest(range(10)) AS j)")
def array_resize(spark, sf_dir):
    x = _matrix(spark, sf_dir)
    return x.resize((x.shape[0] + 3, 10)).df


@query(f"SELECT i AS i0, j AS i1, v FROM {_M} UNION ALL SELECT {_N}, j, 1.0 FROM (SELECT unnest(range(64)) AS j)")
def array_append(spark, sf_dir):
    return _matrix(spark, sf_dir).append(np.ones((1, 64))).df


@query(f"SELECT j AS i0, v FROM {_M} WHERE i = j + 2")
def array_diagonal(spark, sf_dir):
    x = _matrix(spark, sf_dir)
    return nd.diagonal(x, -2).df


@query(f"SELECT a.i AS i0, b.j AS i1, round(a.v * b.v, 6) AS v FROM {_M} a, {_M} b WHERE a.j = 0 AND b.i = 1")
def array_outer(spark, sf_dir):
    x = _matrix(spark, sf_dir)
    return _round(nd.outer(x[:, 0], x[1]))


@query(f"SELECT i AS i0, round(sum(v * v), 6) AS v FROM {_M} GROUP BY 1")
def array_vecdot(spark, sf_dir):
    x = _matrix(spark, sf_dir)
    return _round(nd.vecdot(x, x))


@query(f"SELECT j // 8 AS i0, round(sum(v * (1 + j % 8)), 6) AS v FROM {_M} GROUP BY 1")
def array_tensordot(spark, sf_dir):
    """The first and last axis of a cube contracted at once."""
    x = nd.reshape(_matrix(spark, sf_dir), (-1, 8, 8))
    weights = nd.broadcast_to(nd.arange(spark, 1.0, 9.0), (x.shape[0], 8))
    return _round(nd.tensordot(x, weights, axes=([0, 2], [0, 1])))


@query(f"SELECT i AS i0, j AS i1, round(x + y, 6) AS v FROM (SELECT i AS i, v AS x FROM {_M} WHERE j = 0), (SELECT j, v AS y FROM {_M} WHERE i = 0)")
def array_meshgrid(spark, sf_dir):
    x = _matrix(spark, sf_dir)
    one, two = nd.meshgrid(x[:, 0], x[0], indexing="ij")
    return _round(one + two)


@query("""SELECT k.name, CAST(k.cells AS BIGINT) AS cells, k.total FROM (VALUES ('arange', 50, 1225.0), ('linspace', 11, 5.5), ('zeros', 12, 0.0), ('ones', 12, 12.0), ('full', 12, 84.0),
          ('eye', 12, 3.0), ('zeros_like', 12, 0.0), ('ones_like', 12, 12.0), ('full_like', 12, 60.0), ('empty', 12, 0.0), ('empty_like', 12, 0.0), ('uninit', 12, 0.0), ('nans', 12, 12.0),
          ('array', 4, 10.0), ('asarray', 4, 10.0), ('fromiter', 6, 15.0), ('frombuffer', 3, 6.0)) k(name, cells, total)""")
def array_construction(spark, sf_dir):
    shape = (3, 4)
    full = nd.full(spark, shape, 7)
    made = {
        "arange": nd.arange(spark, 50), "linspace": nd.linspace(spark, 0, 1, 11), "zeros": nd.zeros(spark, shape), "ones": nd.ones(spark, shape), "full": full,
        "eye": nd.eye(spark, 3, 4), "zeros_like": nd.zeros_like(full), "ones_like": nd.ones_like(full), "full_like": nd.full_like(full, 5),
        "empty": nd.empty(spark, shape), "empty_like": nd.empty_like(full), "uninit": nd.uninit(spark, shape), "nans": nd.elementwise(REGISTRY["isnan"], nd.nans(spark, shape)),
        "array": nd.array(spark, [[1, 2], [3, 4]]), "asarray": nd.asarray(spark, nd.array(spark, [[1, 2], [3, 4]])), "fromiter": nd.fromiter(spark, range(6), (2, 3)),
        "frombuffer": nd.frombuffer(spark, bytes([1, 2, 3]), (3,)),
    }
    out = None
    for name, x in made.items():
        value = F.col("v").cast("int") if x.kind == "bool" else F.col("v")
        row = x.df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("cells"), F.round(F.sum(value.cast("double")), 6).alias("total"))
        out = row if out is None else out.unionByName(row)
    return out


@query(f"SELECT i AS i0, j AS i1, round(v * 2 + 1, 6) AS v FROM {_M}")
def array_saved(spark, sf_dir):
    """Written through a function, read through another, from Parquet."""
    path = f"{scratch_folder(spark)}/saved-{uuid.uuid4().hex}"
    _matrix(spark, sf_dir).write(path, prefilter=lambda x: x * 2)
    return _round(nd.Array.read(spark, path, postfilter=lambda x: x + 1).copy())


@query(f"SELECT i AS i0, j AS i1, v FROM {_M}")
def array_packed(spark, sf_dir):
    """To Arrow bytes and back, a stretch of cells at a time, on the executors."""
    return nd.Array.unpack(_matrix(spark, sf_dir).pack()).df


@query(f"SELECT i AS i0, j AS i1, round(v * 3 - w, 6) AS v FROM {_M} JOIN (SELECT i, v AS w FROM {_M} WHERE j = 0) USING (i)")
def array_filled(spark, sf_dir):
    x = _matrix(spark, sf_dir)
    return _round(nd.filled(lambda a, b: a * 3 - b, x, x[:, :1]))


@query(f"SELECT (i // 100) * 4 + j // 16 AS chunk, count(*) AS cells, min(v) AS low, max(v) AS high FROM {_M} GROUP BY 1")
def array_chunks(spark, sf_dir):
    return _matrix(spark, sf_dir).chunks_info((100, 16))


@query(f"SELECT i, j, v FROM {_M} WHERE v BETWEEN 0.1 AND 0.2")
def array_index_between(spark, sf_dir):
    found = _matrix(spark, sf_dir).create_index("FULL").between(0.1, 0.2).frame
    return found.select(F.col("i0").alias("i"), F.col("i1").alias("j"), "v")


@query(f"SELECT i AS i0, j AS i1, v FROM {_M} WHERE i < 30 AND j >= 32")
def array_source(spark, sf_dir):
    """A chunked source, of which a slice fetches only the chunks that it touches, twice through a cache."""
    proxy = connector.Proxy(spark, connector.ArraySource(_matrix(spark, sf_dir), (20, 16)))
    proxy.fetch((slice(0, 10), slice(0, 64)))
    return nd.Array(proxy.fetch((slice(0, 30), slice(32, 64))).df.select("i0", (F.col("i1") + 32).alias("i1"), "v"), (30, 64)).df


# Random arrays

_MOMENTS = {
    "random": ((), 0.5, math.sqrt(1 / 12)), "uniform": ((2.0, 4.0), 3.0, math.sqrt(4 / 12)), "normal": ((1.0, 2.0), 1.0, 2.0), "standard_normal": ((), 0.0, 1.0),
    "exponential": ((2.0,), 2.0, 2.0), "standard_exponential": ((), 1.0, 1.0), "integers": ((0, 10), 4.5, math.sqrt(99 / 12)), "beta": ((2.0, 3.0), 0.4, 0.2),
    "binomial": ((10, 0.3), 3.0, math.sqrt(2.1)), "chisquare": ((4.0,), 4.0, math.sqrt(8)), "f": ((5.0, 12.0), 1.2, math.sqrt(1.08)), "gamma": ((2.0, 3.0), 6.0, math.sqrt(18)),
    "geometric": ((0.25,), 4.0, math.sqrt(12)), "gumbel": ((0.0, 1.0), 0.577216, 1.28255), "hypergeometric": ((20, 30, 10), 4.0, 1.4), "laplace": ((0.0, 1.0), 0.0, math.sqrt(2)),
    "logistic": ((0.0, 1.0), 0.0, 1.8138), "lognormal": ((0.0, 0.5), 1.133148, 0.6039), "logseries": ((0.5,), 1.442695, 0.8967), "negative_binomial": ((5, 0.5), 5.0, math.sqrt(10)),
    "noncentral_chisquare": ((3.0, 2.0), 5.0, math.sqrt(14)), "noncentral_f": ((5.0, 20.0, 2.0), 1.5556, 1.1413), "pareto": ((6.0,), 0.2, 0.245), "poisson": ((4.0,), 4.0, 2.0),
    "power": ((3.0,), 0.75, 0.1937), "rayleigh": ((2.0,), 2.506628, 1.3103), "standard_gamma": ((3.0,), 3.0, math.sqrt(3)), "standard_t": ((8.0,), 0.0, math.sqrt(8 / 6)),
    "triangular": ((0.0, 1.0, 4.0), 5 / 3, 0.85), "vonmises": ((0.0, 2.0), 0.0, 0.85), "wald": ((2.0, 3.0), 2.0, math.sqrt(8 / 3)), "weibull": ((2.0,), 0.886227, 0.4633),
    "zipf": ((5.0,), 1.043779, 0.2642), "dirichlet": (([1.0, 2.0, 3.0],), 1 / 6, 0.1409), "multinomial": ((10, [0.2, 0.3, 0.5]), 2.0, 1.2649),
    "multivariate_hypergeometric": (([5, 10, 15], 6), 1.0, 0.8305), "multivariate_normal": (([1.0, 2.0], [[2.0, 0.5], [0.5, 1.0]]), 1.0, math.sqrt(2)), "choice": ((10,), 4.5, math.sqrt(99 / 12)),
}


@query(f"SELECT unnest({sorted(_MOMENTS)}) AS name, true AS near")
def random_moments(spark, sf_dir):
    """The mean of 20,000 draws lies within five standard errors of the distribution's (vectors: of their first component)."""
    n, out = 20_000, None
    for name, (parameters, mean, std) in _MOMENTS.items():
        drawn = getattr(default_rng(spark, 11), name)(*parameters, **({"shape": n}))
        values = drawn.df if drawn.ndim == 1 else drawn[:, 0].df
        near = F.abs(F.avg(F.col("v").cast("double")) - mean) <= 5 * std / math.sqrt(n)
        row = values.agg(F.lit(name).alias("name"), near.alias("near"))
        out = row if out is None else out.unionByName(row)
    return out


@query("SELECT k.name, k.near FROM (VALUES ('standard_cauchy', true), ('permutation', true), ('shuffle', true), ('permuted', true), ('repeats', true), ('differs', true)) k(name, near)")
def random_orders(spark, sf_dir):
    """The median of a distribution without a mean, permutations, and that a seed repeats its draws."""
    n = 5000
    cauchy = default_rng(spark, 3).standard_cauchy(shape=n).df.agg(F.lit("standard_cauchy").alias("name"), (F.abs(F.avg((F.col("v") > 0).cast("int")) - 0.5) < 0.04).alias("near"))
    out = cauchy
    for name in ("permutation", "shuffle", "permuted"):
        moved = getattr(default_rng(spark, 4), name)(nd.arange(spark, n))
        whole = (F.count_distinct("v") == n) & (F.min("v") == 0) & (F.max("v") == n - 1) & (F.count_if(F.col("v") != F.col("i0")) > n / 2)
        out = out.unionByName(moved.df.agg(F.lit(name).alias("name"), whole.alias("near")))
    a, b, c = (default_rng(spark, seed).normal(shape=n).df for seed in (5, 5, 6))
    for name, other, same in (("repeats", b, n), ("differs", c, 0)):
        met = a.join(other.withColumnRenamed("v", "w"), "i0").agg(F.lit(name).alias("name"), (F.count_if(F.col("v") == F.col("w")) == same).alias("near"))
        out = out.unionByName(met)
    return out


@query()
def random_normal(spark, sf_dir):
    return default_rng(spark, 3).normal(1.0, 2.0, shape=(1000,)).df


