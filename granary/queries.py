"""Queries over the driver's tables for the operators of this library, each with SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.expr import col
from granary.operators.table import Column, Table, concat, minmax_buckets
from granary.plans import kernel_from_source
from granary.registry import one_row, query, registered_queries, registered_sql, table
from granary.streaming import windowed_counts

# Projection, filter, row selection


@query("""SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem
          WHERE l_discount > 0.05 AND l_quantity < 24""")
def filter_string(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    return t.where("l_discount > 0.05 and l_quantity < 24", columns=["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"]).frame


@query("""SELECT o_orderkey, o_totalprice FROM orders
          WHERE o_orderstatus = 'F' OR NOT (o_totalprice > 100000)""")
def filter_or_not(spark, sf_dir):
    t = table(spark, sf_dir, "orders")
    return t.where((col("o_orderstatus") == "F") | ~(col("o_totalprice") > 100000), columns=["o_orderkey", "o_totalprice"]).frame


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_returnflag <> 'N'")
def filter_chained(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where("10 <= l_quantity <= 20 and l_returnflag != 'N'", columns=["l_orderkey", "l_linenumber"]).frame


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def filter_isin(spark, sf_dir):
    t = table(spark, sf_dir, "orders")
    return t.where(col("o_orderpriority").isin(["1-URGENT", "2-HIGH", None]), columns=["o_orderkey", "o_orderpriority"]).frame


@query("""SELECT event_id, CASE WHEN value > 50 THEN value END AS v FROM events
          WHERE NOT coalesce(CASE WHEN value > 50 THEN value END > 90, true)""")
def filter_null_safe(spark, sf_dir):
    """Kleene logic: unknown stays unknown under negation and is not selected."""
    t = Table.from_frame(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.when(F.col("value") > 50, F.col("value")).alias("v")))
    return t.where("not v > 90").frame


@query("SELECT event_id, user_id FROM events WHERE (event_type = 'click') <> (value > 50)")
def filter_xor(spark, sf_dir):
    return table(spark, sf_dir, "events").where("(event_type == 'click') ^ (value > 50)", columns=["event_id", "user_id"]).frame


@query("SELECT event_id, coalesce(CASE WHEN value > 50 THEN value END, -1.0) AS filled FROM events")
def fill_nulls(spark, sf_dir):
    t = Table.from_frame(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.when(F.col("value") > 50, F.col("value")).alias("v")))
    return t.assign(filled=t["v"].fillna(-1.0)).select(["event_id", "filled"]).frame


@query("SELECT event_id, value AS v FROM events WHERE value > 50")
def drop_nulls(spark, sf_dir):
    t = Table.from_frame(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.when(F.col("value") > 50, F.col("value")).alias("v")))
    return t.dropna(["v"]).frame


@query("SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT 7")
def head_rows(spark, sf_dir):
    return table(spark, sf_dir, "nation").sort_by("n_nationkey").head(7).select(["n_nationkey", "n_name"]).frame


@query("SELECT n_nationkey FROM nation ORDER BY n_nationkey DESC LIMIT 4")
def tail_rows(spark, sf_dir):
    return table(spark, sf_dir, "nation").sort_by("n_nationkey").tail(4).select(["n_nationkey"]).frame


@query("SELECT n_nationkey FROM nation WHERE n_nationkey >= 3 AND n_nationkey < 20 AND (n_nationkey - 3) % 4 = 0")
def slice_step(spark, sf_dir):
    return table(spark, sf_dir, "nation").sort_by("n_nationkey")[3:20:4].select(["n_nationkey"]).frame


@query("""SELECT n.n_nationkey, n.n_name FROM nation n
          JOIN (SELECT unnest([3, 1, 3, 24]) AS k) p ON p.k = n.n_nationkey""")
def take_rows(spark, sf_dir):
    return table(spark, sf_dir, "nation").sort_by("n_nationkey").take([3, 1, 3, -1]).select(["n_nationkey", "n_name"]).frame


@query()
def sample_rows(spark, sf_dir):
    return table(spark, sf_dir, "orders").sample(100, seed=7).select(["o_orderkey"]).frame


# Scalar functions


@query("""SELECT l_orderkey, l_linenumber,
          l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge,
          round(sqrt(l_quantity) + ln(l_extendedprice) + sin(l_tax), 9) AS math,
          l_extendedprice / l_quantity AS ratio FROM lineitem""")
def expr_math(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").assign(
        c="l_extendedprice * (1 - l_discount) * (1 + l_tax)", m="sqrt(l_quantity) + log(l_extendedprice) + sin(l_tax)", r="l_extendedprice / l_quantity"
    )
    return t.frame.select("l_orderkey", "l_linenumber", F.col("c").alias("charge"), F.round("m", 9).alias("math"), F.col("r").alias("ratio"))


@query("""SELECT p_partkey, lower(p_name) AS low, upper(p_brand) AS up, contains(p_type, 'STEEL') AS steel,
          starts_with(p_name, 'a') AS a, ends_with(p_brand, '1') AS one, p_brand || '-' || p_type AS joined FROM part""")
def expr_string(spark, sf_dir):
    t = table(spark, sf_dir, "part").assign(
        low="lower(p_name)", up="upper(p_brand)", steel="contains(p_type, 'STEEL')", a="startswith(p_name, 'a')", one="endswith(p_brand, '1')", joined="p_brand + '-' + p_type"
    )
    return t.select(["p_partkey", "low", "up", "steel", "a", "one", "joined"]).frame


@query("""SELECT l_orderkey, l_linenumber, round_even(l_extendedprice / 8, 0) AS r, floor(l_extendedprice / 8) AS f,
          ceil(l_extendedprice / 8) AS c, trunc(-l_extendedprice / 8) AS t FROM lineitem""")
def expr_round(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").assign(r="round(l_extendedprice / 8)", f="floor(l_extendedprice / 8)", c="ceil(l_extendedprice / 8)", t="trunc(-l_extendedprice / 8)")
    return t.select(["l_orderkey", "l_linenumber", "r", "f", "c", "t"]).frame


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 THEN l_tax ELSE -l_tax END AS w,
          greatest(l_tax, l_discount) AS hi, least(l_tax, l_discount) AS lo,
          least(greatest(l_quantity, 10.0), 40.0) AS clipped FROM lineitem""")
def expr_where(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").assign(
        w="where(l_quantity > 25, l_tax, -l_tax)", hi="maximum(l_tax, l_discount)", lo="minimum(l_tax, l_discount)", clipped="clip(l_quantity, 10.0, 40.0)"
    )
    return t.select(["l_orderkey", "l_linenumber", "w", "hi", "lo", "clipped"]).frame


@query("""SELECT o_orderkey, CAST(floor((o_custkey - 70) / 7.0) AS BIGINT) AS q,
          (((o_custkey - 70) % 7) + 7) % 7 AS r, o_custkey & 12 AS b, o_custkey | 3 AS o,
          xor(o_custkey, 5) AS x, o_custkey << 2 AS l, o_custkey >> 1 AS s FROM orders""")
def expr_integer(spark, sf_dir):
    t = table(spark, sf_dir, "orders").assign(
        q="(o_custkey - 70) // 7", r="(o_custkey - 70) % 7", b="o_custkey & 12", o="o_custkey | 3", x="o_custkey ^ 5", l="o_custkey << 2", s="o_custkey >> 1"
    )
    return t.select(["o_orderkey", "q", "r", "b", "o", "x", "l", "s"]).frame


@query("""SELECT event_id, CASE WHEN value > 50 THEN 'inf' ELSE 'nan' END AS kind,
          false AS same, value > 50 AS above FROM events""")
def expr_ieee(spark, sf_dir):
    """Division by zero, and comparison with NaN, as IEEE has them."""
    t = table(spark, sf_dir, "events").assign(z="where(value > 50, 1.0, 0.0) / 0.0")
    t = t.assign(kind="where(isinf(z), 'inf', 'nan')", same="z == nan", above="z > 0")
    return t.select(["event_id", "kind", "same", "above"]).frame


@query("""SELECT event_id, round(atan2(value, 3) + hypot_ + tanh_, 9) AS m FROM
          (SELECT event_id, value, sqrt(value * value + 16) AS hypot_, tanh(value / 100) AS tanh_ FROM events)""")
def expr_trigonometry(spark, sf_dir):
    t = table(spark, sf_dir, "events").assign(m="arctan2(value, 3) + hypot(value, 4) + tanh(value / 100)")
    return t.frame.select("event_id", F.round("m", 9).alias("m"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 30 THEN l_quantity * 2 WHEN l_quantity > 10 THEN l_quantity + 4 ELSE 0 END AS k FROM lineitem")
def kernel_branches(spark, sf_dir):
    kernel = kernel_from_source(
        """
        def f(q):
            if q > 30:
                return q * 2
            total = q
            for i in range(4):
                total = total + 1
            if q > 10:
                return total
            return 0
        """
    )
    return table(spark, sf_dir, "lineitem").assign(k=kernel(col("l_quantity"))).select(["l_orderkey", "l_linenumber", "k"]).frame


# Sort and top-k


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
          WHERE l_discount > 0.05 AND l_quantity < 24
          ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100""")
def sort_topk(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").where("l_discount > 0.05 and l_quantity < 24", columns=["l_orderkey", "l_linenumber", "l_extendedprice"])
    return t.sort_by(["l_extendedprice", "l_orderkey", "l_linenumber"], [False, True, True], view=True).head(100).frame


@query("SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 50")
def sort_multi(spark, sf_dir):
    t = table(spark, sf_dir, "orders").sort_by(["o_orderpriority", "o_totalprice", "o_orderkey"], [True, False, True])
    return t.head(50).select(["o_orderkey", "o_orderpriority", "o_totalprice"]).frame


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 20 OFFSET 40")
def sorted_slice(spark, sf_dir):
    return table(spark, sf_dir, "orders").sort_by(["o_totalprice", "o_orderkey"], view=True)[40:60].select(["o_orderkey", "o_totalprice"]).frame


# Aggregation


@query("""SELECT CAST(sum(l_linenumber) AS BIGINT) AS total, round(avg(l_quantity), 6) AS mean, min(l_extendedprice) AS low,
          max(l_extendedprice) AS high, count(*) AS n, round(stddev_pop(l_extendedprice), 4) AS std,
          bool_or(l_quantity > 49) AS some, bool_and(l_quantity > 0) AS every FROM lineitem""")
def agg_global(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    n = F.count(F.lit(1))
    return t.df.agg(
        F.sum(t["l_linenumber"].bound.col).alias("total"), F.round(F.avg("l_quantity"), 6).alias("mean"), F.min("l_extendedprice").alias("low"),
        F.max("l_extendedprice").alias("high"), n.alias("n"), F.round(F.stddev_pop("l_extendedprice"), 4).alias("std"),
        F.bool_or((t["l_quantity"] > 49).bind(t.schema).col).alias("some"), F.bool_and((t["l_quantity"] > 0).bind(t.schema).col).alias("every"),
    )


@query("SELECT round(sum(l_extendedprice), 2) AS total, round(avg(l_extendedprice), 6) AS mean FROM lineitem WHERE l_quantity < 10")
def agg_where(spark, sf_dir):
    c: Column = table(spark, sf_dir, "lineitem")["l_extendedprice"]
    return one_row(spark, t=float(c.sum(where="l_quantity < 10")), m=c.mean(where="l_quantity < 10")).select(F.round("t", 2).alias("total"), F.round("m", 6).alias("mean"))


@query("SELECT round(covar_samp(l_quantity, l_extendedprice), 4) AS qp, round(var_samp(l_quantity), 6) AS qq FROM lineitem")
def agg_cov(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").select(["l_quantity", "l_extendedprice"]).cov()
    return one_row(spark, qp=float(c[0, 1]), qq=float(c[0, 0])).select(F.round("qp", 4).alias("qp"), F.round("qq", 6).alias("qq"))


@query("SELECT DISTINCT o_orderpriority AS v FROM orders")
def agg_unique(spark, sf_dir):
    return table(spark, sf_dir, "orders")["o_orderpriority"].unique_frame("v")


@query("SELECT event_type AS v, count(*) AS n FROM events GROUP BY 1")
def agg_value_counts(spark, sf_dir):
    return table(spark, sf_dir, "events")["event_type"].value_counts_frame("v", "n")


@query("""SELECT count(l_quantity) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS std, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem""")
def agg_describe(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select(["l_quantity"]).describe().loc["l_quantity"]
    one = one_row(spark, n=int(d["count"]), mean=float(d["mean"]), std=float(d["std"]), low=float(d["min"]), high=float(d["max"]))
    return one.select("n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "low", "high")


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_extendedprice), 6) AS price,
          min(l_discount) AS low, max(l_tax) AS high FROM lineitem GROUP BY 1, 2""")
def group_pricing(spark, sf_dir):
    """Grouped sums, means, counts and extremes in one pass over the needed columns."""
    out = table(spark, sf_dir, "lineitem").group_by(["l_returnflag", "l_linestatus"]).agg(
        n=("*", "size"), qty=("l_quantity", "sum"), price=("l_extendedprice", "mean"), low=("l_discount", "min"), high=("l_tax", "max")
    )
    return out.frame.select("l_returnflag", "l_linestatus", "n", F.round("qty", 2).alias("qty"), F.round("price", 6).alias("price"), "low", "high")


@query("SELECT event_type, count(*) AS size FROM events GROUP BY 1")
def group_size(spark, sf_dir):
    return table(spark, sf_dir, "events").group_by("event_type").size().frame


@query("SELECT user_id, event_type, count(value) AS value_count, round(sum(value), 4) AS value_sum FROM events GROUP BY 1, 2")
def group_multi(spark, sf_dir):
    out = table(spark, sf_dir, "events").group_by(["user_id", "event_type"]).agg({"value": ["count", "sum"]})
    return out.frame.withColumn("value_sum", F.round("value_sum", 4))


@query("""WITH e AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS p FROM events)
          SELECT event_type, arg_min(p, (value, p)) AS value_argmin, arg_max(p, (value, -p)) AS value_argmax FROM e GROUP BY 1""")
def group_arg(spark, sf_dir):
    t = table(spark, sf_dir, "events").sort_by("event_id")
    return t.group_by("event_type").agg([("value", "argmin"), ("value", "argmax")]).frame


@query("""SELECT CASE WHEN value > 50 THEN event_type END AS k, count(*) AS size FROM events GROUP BY 1""")
def group_keep_nulls(spark, sf_dir):
    t = Table.from_frame(spark.read.parquet(f"{sf_dir}/events.parquet").select(F.when(F.col("value") > 50, F.col("event_type")).alias("k")))
    return t.group_by("k", dropna=False).size().frame


@query("""SELECT event_type AS k, count(*) AS size FROM events WHERE value > 50 GROUP BY 1""")
def group_drop_nulls(spark, sf_dir):
    t = Table.from_frame(spark.read.parquet(f"{sf_dir}/events.parquet").select(F.when(F.col("value") > 50, F.col("event_type")).alias("k")))
    return t.group_by("k").size().frame


@query("SELECT event_type, round(max(value) - min(value), 6) AS spread FROM events GROUP BY 1")
def group_custom(spark, sf_dir):
    """An aggregate in Python over each group's values."""
    out = table(spark, sf_dir, "events").group_by("event_type").agg(spread=("value", lambda v: v.max() - v.min()))
    return out.frame.withColumn("spread", F.round("spread", 6))


# Computed columns, mutation, concatenation


@query("SELECT o_orderkey, o_totalprice * 2 AS twice FROM orders WHERE o_totalprice * 2 > 300000")
def computed_column(spark, sf_dir):
    t = table(spark, sf_dir, "orders").select(["o_orderkey", "o_totalprice"]).copy()
    t.add_computed_column("twice", "o_totalprice * 2")
    return t.where("twice > 300000", columns=["o_orderkey", "twice"]).frame


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 'one' ELSE n_name END AS label FROM nation WHERE n_nationkey NOT IN (0, 1, 24)")
def mutated(spark, sf_dir):
    t = table(spark, sf_dir, "nation").sort_by("n_nationkey").copy()
    t.delete([0, 1, -1])
    t["n_name"][col("n_regionkey") == 1] = "one"
    t.rename_column("n_name", "label")
    return t.select(["n_nationkey", "label"]).frame


@query("SELECT r_name AS name FROM region UNION ALL SELECT n_name FROM nation")
def concat_tables(spark, sf_dir):
    a = Table.from_frame(table(spark, sf_dir, "region").frame.select(F.col("r_name").alias("name")))
    b = Table.from_frame(table(spark, sf_dir, "nation").frame.select(F.col("n_name").alias("name")))
    return concat([a, b]).frame


@query("""WITH e AS (SELECT event_id, value, row_number() OVER (ORDER BY event_id) - 1 AS p, count(*) OVER () AS n FROM events)
          SELECT CAST(floor(p * 10 / n) AS INT) AS bucket, min(p) AS start, max(p) AS stop, min(value) AS min, max(value) AS max FROM e GROUP BY 1""")
def plot_envelope(spark, sf_dir):
    return minmax_buckets(table(spark, sf_dir, "events").sort_by("event_id"), "value", 10)


# Extensions: joins, windows, events by time


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_tables(spark, sf_dir):
    r = Table.from_frame(table(spark, sf_dir, "region").frame.withColumnRenamed("r_regionkey", "n_regionkey"))
    return table(spark, sf_dir, "nation").join(r, "n_regionkey").select(["n_name", "r_name"]).frame


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id), 4) AS running FROM events")
def running_sum(spark, sf_dir):
    t = table(spark, sf_dir, "events").window("r", F.sum("value"), ["user_id"], ["event_id"])
    return t.frame.select("event_id", F.round("r", 4).alias("running"))


@query("""SELECT date_trunc('hour', ts) AS start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS stop, event_type, count(*) AS events,
          round(sum(value), 4) AS total FROM events GROUP BY 1, 2, 3""")
def events_by_hour(spark, sf_dir):
    return windowed_counts(spark.read.parquet(f"{sf_dir}/events.parquet")).withColumn("total", F.round("total", 4))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from granary import queries_arrays, queries_functions, queries_tables  # noqa: F401  they register theirs

    return registered_queries()


def oracle_sql() -> dict[str, str]:
    queries()
    return registered_sql()
