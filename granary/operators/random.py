"""Seeded random arrays; values depend on the seed and the cell's place, so recomputation repeats them."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from granary.operators.ndarray import Array, _from_flat, array, dense_positions

_UNIT = float(1 << 53)
#: Cells that one NumPy generator fills.
BLOCK = 4_096

# Distributions that NumPy draws, with the names of their parameters.
_NUMPY = {
    "beta": ("a", "b"), "binomial": ("n", "p"), "chisquare": ("df",), "f": ("dfnum", "dfden"), "gamma": ("shape_param", "scale"),
    "geometric": ("p",), "gumbel": ("loc", "scale"), "hypergeometric": ("ngood", "nbad", "nsample"), "laplace": ("loc", "scale"),
    "logistic": ("loc", "scale"), "lognormal": ("mean", "sigma"), "logseries": ("p",), "negative_binomial": ("n", "p"),
    "noncentral_chisquare": ("df", "nonc"), "noncentral_f": ("dfnum", "dfden", "nonc"), "pareto": ("a",), "poisson": ("lam",),
    "power": ("a",), "rayleigh": ("scale",), "standard_cauchy": (), "standard_gamma": ("shape_param",), "standard_t": ("df",),
    "triangular": ("left", "mode", "right"), "vonmises": ("mu", "kappa"), "wald": ("mean", "scale"), "weibull": ("a",), "zipf": ("a",),
}
_DEFAULTS = {"loc": 0.0, "scale": 1.0, "mean": 0.0, "sigma": 1.0, "lam": 1.0}
_VECTORS = {
    "dirichlet": ("alpha",), "multinomial": ("n", "pvals"),
    "multivariate_hypergeometric": ("colors", "nsample"), "multivariate_normal": ("mean", "cov"),
}
_WHOLE = {"binomial", "geometric", "hypergeometric", "logseries", "negative_binomial", "poisson", "zipf", "multinomial", "multivariate_hypergeometric"}


class Generator:
    """Draws arrays of a shape; each call uses the next stream of the seed."""

    def __init__(self, spark: SparkSession, seed: int | None = None):
        self.spark = spark
        self.seed = int(np.random.SeedSequence(seed).generate_state(1, np.uint64)[0] >> np.uint64(1))
        self.calls = 0

    def _stream(self) -> int:
        self.calls += 1
        return self.seed ^ (self.calls * 0x9E3779B9)

    def _unit(self, at: Column, stream: int, part: int = 0) -> Column:
        """A number in (0, 1) from the place of a cell."""
        bits = F.shiftrightunsigned(F.xxhash64(F.lit(stream), F.lit(part), at), 11)
        return (bits.cast("double") + 0.5) / F.lit(_UNIT)

    def _draw(self, shape: int | Sequence[int], value: Callable[[Column], Column]) -> Array:
        shape = (shape,) if isinstance(shape, int) else tuple(shape)
        return _from_flat(self.spark, shape, value)

    def random(self, shape: Any) -> Array:
        s = self._stream()
        return self._draw(shape, lambda at: self._unit(at, s))

    def uniform(self, low: float = 0.0, high: float = 1.0, *, shape: Any) -> Array:
        s = self._stream()
        return self._draw(shape, lambda at: F.lit(float(low)) + F.lit(float(high - low)) * self._unit(at, s))

    def normal(self, loc: float = 0.0, scale: float = 1.0, *, shape: Any) -> Array:
        s = self._stream()

        def value(at: Column) -> Column:
            radius = F.sqrt(F.lit(-2.0) * F.ln(self._unit(at, s)))
            return F.lit(float(loc)) + F.lit(float(scale)) * radius * F.cos(F.lit(2 * math.pi) * self._unit(at, s, 1))

        return self._draw(shape, value)

    def standard_normal(self, *, shape: Any) -> Array:
        return self.normal(shape=shape)

    def integers(self, low: int, high: int | None = None, *, shape: Any, endpoint: bool = False) -> Array:
        if high is None:
            low, high = 0, low
        n = high - low + endpoint
        if n <= 0:
            raise ValueError("low is not below high")
        s = self._stream()
        return self._draw(shape, lambda at: F.floor(self._unit(at, s) * n).cast("long") + F.lit(low))

    def exponential(self, scale: float = 1.0, *, shape: Any) -> Array:
        s = self._stream()
        return self._draw(shape, lambda at: F.lit(-float(scale)) * F.ln(self._unit(at, s)))

    def standard_exponential(self, *, shape: Any) -> Array:
        return self.exponential(shape=shape)

    def choice(self, a: Any, *, shape: Any, p: Any = None, replace: bool = True) -> Array:
        """Draw from range(a) or from an array, by weights if given."""
        source = None if isinstance(a, int) else a if isinstance(a, Array) else array(self.spark, np.asarray(a))
        n = a if source is None else source.shape[0]
        shape = (shape,) if isinstance(shape, int) else tuple(shape)
        size = math.prod(shape)
        if not replace:
            if p is not None or size > n:
                raise ValueError("without replacement draws are unweighted and at most as many as there are")
            s = self._stream()
            order = self.spark.range(n).withColumn("u", F.xxhash64(F.lit(s), "id")).orderBy("u", "id").limit(size)
            places = dense_positions(order, [F.col("u"), F.col("id")], "at")
            values = Array(places.select(F.col("at").alias("i0"), F.col("id").alias("v")), (size,))
        else:
            unit = self.random(size)
            if p is None:
                value = F.floor(F.col("v") * n).cast("long")
            else:
                edges = F.array(*[F.lit(float(x)) for x in np.cumsum(p)[:-1]]).cast("array<double>")
                value = F.size(F.filter(edges, lambda e: e <= F.col("v"))).cast("long")
            values = Array(unit.df.withColumn("v", value), (size,))
        if source is not None:
            joined = values.df.withColumnRenamed("v", "__from").join(source.df.select(F.col("i0").alias("__from"), "v"), "__from")
            values = Array(joined.select("i0", "v"), (size,))
        from granary.operators.ndarray import reshape

        return reshape(values, shape)

    def permutation(self, x: Any, *, axis: int = 0) -> Array:
        """The slices along an axis in random order; a number stands for its range."""
        from granary.operators.ndarray import arange

        x = arange(self.spark, x) if isinstance(x, int) else x if isinstance(x, Array) else array(self.spark, np.asarray(x))
        s, n = self._stream(), x.shape[axis]
        order = self.spark.range(n).withColumn("u", F.xxhash64(F.lit(s), "id"))
        places = dense_positions(order, [F.col("u"), F.col("id")], "__to").select(F.col("id").alias(f"i{axis}"), "__to")
        moved = x.df.join(places, f"i{axis}").withColumn(f"i{axis}", F.col("__to"))
        return Array(moved.select(*x.axes, "v"), x.shape)

    shuffle = permutation

    def permuted(self, x: Any, *, axis: int | None = None) -> Array:
        """Cells in random order, within each line along an axis or over all."""
        from pyspark.sql import Window

        from granary.operators.ndarray import reshape

        x = x if isinstance(x, Array) else array(self.spark, np.asarray(x))
        if axis is None:
            return reshape(self.permutation(reshape(x, (x.size,))), x.shape)
        s, name = self._stream(), f"i{axis}"
        others = [a for a in x.axes if a != name]
        w = Window.partitionBy(*others).orderBy(F.xxhash64(F.lit(s), *x.axes), name)
        return Array(x.df.withColumn(name, (F.row_number().over(w) - 1).cast("long")).select(*x.axes, "v"), x.shape)

    def _numpy(self, name: str, parameters: list, shape: Any, width: tuple[int, ...] = ()) -> Array:
        """Blocks of cells, each filled by a NumPy generator seeded by the stream and the block."""
        shape = (shape,) if isinstance(shape, int) else tuple(shape)
        size, stream, block = math.prod(shape), self._stream(), BLOCK
        per_cell = math.prod(width)

        def fill(frames):
            for frame in frames:
                for b in frame["id"]:
                    n = min(block, size - b * block)
                    drawn = getattr(np.random.default_rng([stream, int(b)]), name)(*parameters, size=n)
                    flat = np.asarray(drawn).reshape(-1)
                    yield pd.DataFrame({"at": np.arange(len(flat)) + b * block * per_cell, "v": flat})

        kind = "long" if name in _WHOLE else "double"
        cells = self.spark.range(-(-size // block)).mapInPandas(fill, f"at long, v {kind}")
        full_shape = (*shape, *width)
        rest, names = size * per_cell, []
        for i, n in enumerate(full_shape):
            rest //= max(1, n)
            names.append((F.floor(F.col("at") / max(1, rest)) % n).cast("long").alias(f"i{i}"))
        return Array(cells.select(*names, "v"), full_shape)

    def __getattr__(self, name: str):
        if name in _NUMPY:
            wanted = _NUMPY[name]

            def draw(*given: Any, shape: Any, **named: Any) -> Array:
                values = list(given) + [named[k] if k in named else _DEFAULTS[k] for k in wanted[len(given) :]]
                return self._numpy(name, values, shape)

            return draw
        if name in _VECTORS:

            def draw_vectors(*given: Any, shape: Any, **named: Any) -> Array:
                values = list(given) + [named[k] for k in _VECTORS[name][len(given) :]]
                width = np.shape(values[1] if name == "multinomial" else values[0])
                return self._numpy(name, values, shape, width)

            return draw_vectors
        raise AttributeError(name)


def default_rng(spark: SparkSession, seed: int | None = None) -> Generator:
    return Generator(spark, seed)


__all__ = ["Generator", "default_rng"]
