"""Further queries: sources and sinks, partition control, loops, end-to-end iterations, provenance; with the SQL that states the same."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from weftline.dataset import Dataset
from weftline.functions import parsing
from weftline.functions.reducers import exact_sum
from weftline.operators import actions, iterative, joins, linalg, partitioning, sampling
from weftline.plans import provenance
from weftline.queries import _CELLS, _POINTS, matrix, points, query, table, vector
from weftline.session import checkpoint_dir
from weftline.sources import readers
from weftline.streaming import metrics


def scratch(spark, name: str) -> str:
    """A fresh path in the folder that driver and executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/weftline-{name}-{uuid.uuid4().hex[:12]}"


# sources and sinks


@query("SELECT c_custkey || ',' || c_mktsegment AS value FROM customer")
def text_source(spark, d):
    path = scratch(spark, "text")
    readers.write(table(spark, d, "customer").select(F.concat_ws(",", "c_custkey", "c_mktsegment").alias("value")), path, "text")
    return Dataset.text(spark, path).df


@query("SELECT p_partkey || ':' || p_brand AS value FROM part UNION ALL SELECT s_suppkey || ':' || s_name AS value FROM supplier")
def text_paths_source(spark, d):
    paths = [scratch(spark, "text") for _ in range(2)]
    readers.write(table(spark, d, "part").select(F.concat_ws(":", "p_partkey", "p_brand").alias("value")), paths[0], "text")
    readers.write(table(spark, d, "supplier").select(F.concat_ws(":", "s_suppkey", "s_name").alias("value")), paths[1], "text")
    return readers.text_lines(spark, *paths)


@query("SELECT c_name AS url, CAST(c_acctbal AS FLOAT) AS ranking FROM customer")
def json_source(spark, d):
    path = scratch(spark, "json")
    readers.write(table(spark, d, "customer").select(F.col("c_name").alias("url"), F.col("c_acctbal").alias("ranking")), path, "json")
    return Dataset.json(spark, path, "url string, ranking float", pretty=False).df


@query("SELECT n_name AS url, CAST(n_regionkey AS FLOAT) AS ranking FROM nation")
def json_pretty_source(spark, d):
    """One array over many lines, as a pretty printer writes it."""
    path = scratch(spark, "json")
    rows = table(spark, d, "nation").select(F.to_json(F.struct(F.col("n_name").alias("url"), F.col("n_regionkey").alias("ranking")), {"pretty": "true"}).alias("j"))
    readers.write(rows.agg(F.concat(F.lit("["), F.array_join(F.collect_list("j"), ",\n"), F.lit("]")).alias("value")), path, "text")
    return readers.json_rows(spark, path, "url string, ranking float")


@query("SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders")
def csv_source(spark, d):
    path = scratch(spark, "csv")
    readers.write(table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), path, "csv")
    return readers.csv_rows(spark, path, "o_orderkey long, o_orderpriority string, o_totalprice double")


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def orc_source(spark, d):
    path = scratch(spark, "orc")
    readers.write(table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal"), path, "orc")
    return readers.orc(spark, path)


@query("SELECT l_returnflag, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1")
def partitioned_sink(spark, d):
    """Folders by a column's value; the filter reads one of them."""
    path = scratch(spark, "parts")
    Dataset(table(spark, d, "lineitem").select("l_returnflag", "l_quantity")).write(path, partition_by=["l_returnflag"])
    return readers.parquet(spark, path).filter("l_returnflag = 'R'").groupBy("l_returnflag").agg(exact_sum(F.col("l_quantity")).alias("quantity"))


@query("SELECT s_nationkey AS key, count(*) AS n FROM supplier GROUP BY 1")
def named_source(spark, d):
    name = f"published_{uuid.uuid4().hex[:8]}"
    readers.publish(table(spark, d, "supplier"), name, everywhere=True)
    return Dataset.named(spark, f"global_temp.{name}").group_reduce("s_nationkey", n=F.count("*")).df


@query("SELECT CAST(range AS INTEGER) AS value, CAST(range % 7 AS BIGINT) AS m FROM range(1000)")
def parallelize_rows(spark, d):
    return Dataset.parallelize(spark, list(range(1000)), "int", 20).map("value", m="cast(value % 7 as long)").df


@query("SELECT CAST(unnest([1, 2, 3, 10, 20, 7]) AS INTEGER) AS value")
def horizontal_rows(spark, d):
    return Dataset.horizontal(spark, "int", [1, 2, 3], [10, 20], [], [7]).df


# rows


@query("SELECT count(*) AS n, CAST(sum(n_nationkey) AS BIGINT) AS s, true AS numbered FROM nation")
def map_partitions_with_index(spark, d):
    def numbered(i, frames):
        import pandas as pd

        for f in frames:
            yield pd.DataFrame({"p": [i] * len(f), "k": f["n_nationkey"]})

    rows = Dataset(table(spark, d, "nation")).partition_in_turn(5).map_partitions_with_index(numbered, "p long, k long").df
    return rows.agg(F.count("*").alias("n"), F.sum("k").alias("s"), ((F.min("p") == 0) & (F.max("p") == 4) & (F.countDistinct("p") == 5)).alias("numbered"))


@query("SELECT CAST(sum(c_custkey) AS BIGINT) AS total, count(*) AS n FROM customer")
def foreach_rows(spark, d):
    total, n = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def see(rows):
        for r in rows:
            total.add(r["c_custkey"])
            n.add(1)

    Dataset(table(spark, d, "customer").select("c_custkey")).foreach(see)
    return spark.createDataFrame([(total.value, n.value)], "total long, n long")


@query("SELECT unnest(flatten([[o_orderkey, o_custkey], [o_orderkey + 1]])) AS value FROM orders")
def flatten_arrays(spark, d):
    return Dataset(table(spark, d, "orders")).flatten("array(array(o_orderkey, o_custkey), array(o_orderkey + 1))").df


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 17")
def limit_rows(spark, d):
    return Dataset(table(spark, d, "orders").select("o_orderkey", "o_totalprice")).sort_by("o_orderkey").limit(17).df


@query("SELECT o_custkey AS key, list_transform(list_sort(list(o_orderkey)), lambda x: x * 2) AS values FROM orders GROUP BY 1")
def group_map_arrays(spark, d):
    return Dataset(table(spark, d, "orders")).group_by("o_custkey", "o_orderkey").map_values(lambda v: v * 2).collect()


@query("SELECT max(o_totalprice) AS o_totalprice, CAST(sum(o_orderkey) AS BIGINT) AS o_orderkey FROM orders")
def reduce_rows_global(spark, d):
    join = lambda a, b: {"o_totalprice": max(a["o_totalprice"], b["o_totalprice"]), "o_orderkey": a["o_orderkey"] + b["o_orderkey"]}
    return Dataset(table(spark, d, "orders").select("o_totalprice", "o_orderkey")).reduce_python(join).df


@query("SELECT c_mktsegment, max(c_acctbal) AS c_acctbal, min(c_custkey) AS c_custkey FROM customer GROUP BY 1")
def group_reduce_rows(spark, d):
    join = lambda a, b: {"c_mktsegment": a["c_mktsegment"], "c_acctbal": max(a["c_acctbal"], b["c_acctbal"]), "c_custkey": min(a["c_custkey"], b["c_custkey"])}
    return Dataset(table(spark, d, "customer").select("c_mktsegment", "c_acctbal", "c_custkey")).group_reduce_python(join, "c_mktsegment").df


@query("SELECT CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value FROM orders")
def fold_global(spark, d):
    return Dataset(table(spark, d, "orders")).fold("o_totalprice", 0.0, exact_sum).df


@query("SELECT conv_id, string_agg(role, '>' ORDER BY turn DESC) AS value FROM conversations GROUP BY 1")
def fold_from_right(spark, d):
    return actions.fold_ordered(table(spark, d, "conversations"), "conv_id", "role", "turn", "", lambda s, x: F.concat(s, F.when(s == "", F.lit("")).otherwise(F.lit(">")), x), from_right=True)


# two datasets


@query("""
WITH c AS (SELECT c_nationkey AS key, list_sort(list(c_custkey)) AS v FROM customer GROUP BY 1),
s AS (SELECT s_nationkey AS key, list_sort(list(s_suppkey)) AS v FROM supplier GROUP BY 1)
SELECT coalesce(c.key, s.key) AS key, coalesce(c.v, []) AS left_values, coalesce(s.v, []) AS right_values FROM c FULL JOIN s ON c.key = s.key
""")
def cogroup_by_key(spark, d):
    return Dataset(table(spark, d, "customer")).keyed("c_nationkey", "c_custkey").cogroup_by_key(Dataset(table(spark, d, "supplier")).keyed("s_nationkey", "s_suppkey")).df


@query("SELECT coalesce(o_custkey, c_custkey + 100) AS key, c_name, o_orderkey FROM (SELECT * FROM customer) FULL JOIN orders ON c_custkey + 100 = o_custkey")
def full_outer_join(spark, d):
    left = Dataset(table(spark, d, "customer").select("c_custkey", "c_name"))
    return left.join_by(Dataset(table(spark, d, "orders").select("o_custkey", "o_orderkey")), "c_custkey + 100", "o_custkey", "full_outer").df.select("key", "c_name", "o_orderkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def semi_join(spark, d):
    return joins.join_by(table(spark, d, "customer").select("c_custkey", "c_name"), table(spark, d, "orders").filter("o_totalprice > 300000").select("o_custkey"), "c_custkey", "o_custkey", "left_semi").drop("key")


# place


@query("SELECT l_suppkey % 7 AS g, CAST(l_suppkey % 7 AS INTEGER) AS p, count(*) AS n FROM lineitem GROUP BY 1, 2")
def partition_by_number(spark, d):
    placed = Dataset(table(spark, d, "lineitem").select("l_suppkey")).partition_by_number(7, F.col("l_suppkey")).df
    return placed.groupBy((F.col("l_suppkey") % 7).alias("g"), F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"))


@query("SELECT o_custkey, 1 AS partitions, count(*) AS n FROM orders GROUP BY 1")
def partition_with_partitioner(spark, d):
    placed = Dataset(table(spark, d, "orders").select("o_custkey")).with_partitioner(partitioning.hash_partitioner(6, "o_custkey")).df
    return placed.withColumn("p", F.spark_partition_id()).groupBy("o_custkey").agg(F.countDistinct("p").alias("partitions"), F.count("*").alias("n"))


@query("SELECT c_mktsegment, 1 AS partitions, count(*) AS n FROM customer GROUP BY 1")
def partition_by_hash(spark, d):
    placed = Dataset(table(spark, d, "customer").select("c_mktsegment")).partition_by(4, "c_mktsegment").df
    return placed.withColumn("p", F.spark_partition_id()).groupBy("c_mktsegment").agg(F.countDistinct("p").alias("partitions"), F.count("*").alias("n"))


@query("SELECT 6 AS partitions, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS s FROM orders")
def partition_at_random(spark, d):
    placed = partitioning.at_random(table(spark, d, "orders").select("o_orderkey"), 6, seed=3).withColumn("p", F.spark_partition_id())
    return placed.agg(F.countDistinct("p").alias("partitions"), F.count("*").alias("n"), F.sum("o_orderkey").alias("s"))


@query("SELECT count(*) AS n, true AS ordered FROM part")
def partition_by_prefix(spark, d):
    placed = partitioning.by_prefix(table(spark, d, "part").select("p_name"), 5, "p_name", 7)
    ranges = placed.groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.substring("p_name", 1, 7)).alias("lo"), F.max(F.substring("p_name", 1, 7)).alias("hi"), F.count("*").alias("n"))
    after = ranges.select((F.col("p") + 1).alias("p"), F.col("hi").alias("before"))
    return ranges.join(after, "p", "left").agg(F.sum("n").alias("n"), F.bool_and(F.coalesce(F.col("lo") > F.col("before"), F.lit(True))).alias("ordered"))


@query("SELECT count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS s, 3 AS partitions FROM lineitem")
def with_parallelism(spark, d):
    placed = Dataset(table(spark, d, "lineitem").select("l_orderkey")).partition_in_turn(8).with_parallelism(3)
    sizes = placed.df.rdd.getNumPartitions()
    return placed.df.agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("s")).withColumn("partitions", F.lit(sizes))


@query("SELECT n_regionkey, n_name FROM nation")
def compressed(spark, d):
    path = scratch(spark, "zstd")
    Dataset(table(spark, d, "nation").select("n_regionkey", "n_name")).compress().write(path)
    return readers.parquet(spark, path)


# actions


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
def compute_reference(spark, d):
    return Dataset(table(spark, d, "nation")).filter("n_regionkey = 2").map("n_nationkey", "n_name").compute().result(300)


@query("SELECT s_suppkey, s_name FROM supplier ORDER BY s_suppkey")
def traverse_rows(spark, d):
    rows = Dataset(table(spark, d, "supplier").select("s_suppkey", "s_name")).sort_by("s_suppkey").traverse().result(300)
    return readers.from_rows(spark, [tuple(r) for r in rows], "s_suppkey long, s_name string")


@query("SELECT r_regionkey, r_name FROM region")
def collect_in_time(spark, d):
    return readers.from_rows(spark, [tuple(r) for r in Dataset(table(spark, d, "region").select("r_regionkey", "r_name")).collect(300)], "r_regionkey int, r_name string")


@query("SELECT c_nationkey AS key, count(*) AS n FROM customer GROUP BY 1")
def cached_rows(spark, d):
    return Dataset(table(spark, d, "customer").select("c_nationkey")).cached().group_reduce("c_nationkey", n=F.count("*")).df


@query("SELECT c_custkey AS k, c_acctbal * 32 + 31 AS x FROM customer")
def repeat_steps(spark, d):
    return Dataset(table(spark, d, "customer")).map(k="c_custkey", x="c_acctbal").repeat(5, lambda s: s.map("k", x="x * 2 + 1")).df


@query("SELECT o_orderkey AS k, CAST(512 AS BIGINT) AS x FROM orders")
def repeat_while_steps(spark, d):
    start = Dataset(table(spark, d, "orders")).map(k="o_orderkey", x="cast(1 as long)")
    return start.repeat_while(lambda before, after: after.df.agg(F.max("x")).first()[0] < 500, lambda s: s.map("k", x="x * 2")).df


@query("SELECT n_nationkey, n_name FROM nation WHERE n_name LIKE '%A%'")
def sample_with_function(spark, d):
    return sampling.by_function(table(spark, d, "nation").select("n_nationkey", "n_name"), lambda frames: (f[f["n_name"].str.contains("A")] for f in frames))


@query("SELECT count(*) AS n, true AS near FROM orders")
def sample_share(spark, d):
    """The share drawn is within six deviations of what was asked for, and each row is drawn once."""
    orders = table(spark, d, "orders").select("o_orderkey")
    n, drawn = orders.count(), sampling.fraction(orders, 0.3, seed=5).agg(F.count("*").alias("k"), F.countDistinct("o_orderkey").alias("u"))
    near = (F.abs(F.col("k") - 0.3 * n) <= 6 * (0.21 * n) ** 0.5) & (F.col("k") == F.col("u"))
    return drawn.select(F.lit(n).cast("long").alias("n"), near.alias("near"))


# vectors and matrices


@query("SELECT vec_id AS idx, CAST(embedding[1] AS DOUBLE) AS v FROM embeddings WHERE vec_id >= 40")
def vec_slice_from(spark, d):
    return linalg.cut(vector(spark, d, 0), 40)


@query("SELECT i AS idx, i * 1.5::DOUBLE + (100 - i) AS a, i * 1.5::DOUBLE * (100 - i) AS t, i * 1.5::DOUBLE - (100 - i) AS m FROM (SELECT range AS i FROM range(100))")
def vec_local(spark, d):
    a, b = linalg.local_vector(spark, [i * 1.5 for i in range(100)]), linalg.local_vector(spark, [100 - i for i in range(100)])
    named = lambda v, n: v.withColumnRenamed("v", n)
    return named(linalg.add(a, b), "a").join(named(linalg.times(a, b), "t"), "idx").join(named(linalg.minus(a, b), "m"), "idx")


@query(f"SELECT vec_id AS idx, c AS col, round(x * 2 - 1, 6) + 0.0 AS x FROM {_CELLS}")
def mat_map_cells(spark, d):
    return linalg.cells(linalg.map_cells(matrix(spark, d), lambda x: x * 2 - 1)).select("idx", F.col("col").cast("long").alias("col"), F.round("x", 6).alias("x"))


@query("SELECT vec_id AS idx, list_reverse(CAST(embedding AS DOUBLE[])) AS row FROM embeddings")
def mat_map_rows(spark, d):
    return linalg.map_rows(matrix(spark, d), F.reverse)


@query(f"SELECT vec_id AS idx, c AS col, round(x - max(x) OVER (PARTITION BY c), 6) + 0.0 AS x FROM {_CELLS}")
def mat_map_columns(spark, d):
    out = linalg.map_columns(matrix(spark, d), lambda x, s: x - s["top"], top=F.max)
    return linalg.cells(out).select("idx", F.col("col").cast("long").alias("col"), F.round("x", 6).alias("x"))


@query(f"SELECT vec_id AS idx, c AS col, round(sum(x) OVER (PARTITION BY c ORDER BY vec_id ROWS UNBOUNDED PRECEDING), 5) + 0.0 AS x FROM {_CELLS}")
def mat_map_each_column(spark, d):
    """Running sums down each column: a function of a whole column."""
    from itertools import accumulate

    out = linalg.map_each_column(matrix(spark, d), lambda column: list(accumulate(column)))
    return linalg.cells(out).select("idx", F.col("col").cast("long").alias("col"), F.round("x", 5).alias("x"))


@query("SELECT count(*) AS n_rows, CAST(max(len(embedding)) AS BIGINT) AS n_columns FROM embeddings")
def mat_shape(spark, d):
    m = matrix(spark, d)
    return spark.createDataFrame([(linalg.num_rows(m), linalg.num_columns(m))], "n_rows long, n_columns long")


# iterations from start to end

_STEPS, _RATE = 3, 0.05


def _descent(label: str, error: str) -> str:
    """SQL of ``_STEPS`` gradient steps from weights 0."""
    ctes = [f"cells AS MATERIALIZED (SELECT vec_id, c, x FROM {_CELLS})", f"labels AS (SELECT vec_id, {label} AS y FROM embeddings)", "w0 AS (SELECT DISTINCT c, 0.0::DOUBLE AS w FROM cells)"]
    for k in range(_STEPS):
        ctes.append(f"p{k} AS (SELECT vec_id, sum(x * w) AS p FROM cells JOIN w{k} USING (c) GROUP BY 1)")
        ctes.append(f"g{k} AS (SELECT c, avg(({error.format(p='p')} - y) * x) AS g FROM cells JOIN p{k} USING (vec_id) JOIN labels USING (vec_id) GROUP BY 1)")
        ctes.append(f"w{k + 1} AS (SELECT c, w - {_RATE} * g AS w FROM w{k} JOIN g{k} USING (c))")
    return f"WITH {', '.join(ctes)} SELECT c AS pos, round(w, 6) + 0.0 AS w FROM w{_STEPS}"


def _labelled(spark, d, label: str):
    return table(spark, d, "embeddings").select(F.col("embedding").cast("array<double>").alias("x"), F.expr(label).cast("double").alias("y"))


def _weights(spark, w):
    return readers.from_rows(spark, list(enumerate(float(x) for x in w)), "pos long, w double").select("pos", F.round("w", 6).alias("w"))


@query(_descent("label", "{p}"))
def linear_regression(spark, d):
    return _weights(spark, iterative.linear_regression(_labelled(spark, d, "label"), [0.0] * 64, rate=_RATE, iterations=_STEPS))


@query(_descent("label % 2", "1 / (1 + exp(-{p}))"))
def logistic_regression(spark, d):
    return _weights(spark, iterative.logistic_regression(_labelled(spark, d, "label % 2"), [0.0] * 64, rate=_RATE, iterations=_STEPS))


@query(_descent("label", "{p}"))
def cached_iterations(spark, d):
    """The regression over points that are read once and kept."""
    kept = actions.cached(_labelled(spark, d, "label"))
    try:
        return _weights(spark, iterative.linear_regression(kept, [0.0] * 64, rate=_RATE, iterations=_STEPS))
    finally:
        kept.unpersist()


_START = [[0.05 * ((i * (k + 1)) % 5 - 2) for i in range(64)] for k in range(3)]


def _k_means() -> str:
    ctes = [f"cells AS MATERIALIZED (SELECT vec_id, c, x FROM {_CELLS})"]
    ctes.append("c0 AS (" + " UNION ALL ".join(f"SELECT DISTINCT {k} AS k, c, 0.05 * ((c * {k + 1}) % 5 - 2) AS v FROM cells" for k in range(3)) + ")")
    for i in range(_STEPS):
        ctes.append(f"d{i} AS (SELECT vec_id, k, sum((x - v) * (x - v)) AS d FROM cells JOIN c{i} USING (c) GROUP BY 1, 2)")
        ctes.append(f"a{i} AS (SELECT vec_id, min_by(k, d) AS k FROM d{i} GROUP BY 1)")
        ctes.append(f"m{i} AS (SELECT k, c, avg(x) AS v FROM cells JOIN a{i} USING (vec_id) GROUP BY 1, 2)")
        ctes.append(f"c{i + 1} AS (SELECT k, c, coalesce(m{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN m{i} USING (k, c))")
    return f"WITH {', '.join(ctes)} SELECT k AS cluster, c AS pos, round(v, 6) + 0.0 AS v FROM c{_STEPS}"


@query(_k_means())
def k_means(spark, d):
    centres = iterative.k_means(_labelled(spark, d, "label").select("x"), _START, iterations=_STEPS)
    rows = [(k, i, v) for k, centre in enumerate(centres) for i, v in enumerate(centre)]
    return readers.from_rows(spark, rows, "cluster int, pos long, v double").select("cluster", "pos", F.round("v", 6).alias("v"))


def _weather() -> str:
    x = ["l_quantity / 50", "l_discount", "l_tax", "1.0"]
    ctes = [f"r AS MATERIALIZED (SELECT {', '.join(f'({e})::DOUBLE AS x{i}' for i, e in enumerate(x))}, CASE WHEN l_extendedprice > 30000 THEN 1 ELSE 0 END AS y FROM lineitem WHERE l_returnflag <> 'A')"]
    ctes.append("w0 AS (SELECT " + ", ".join(f"0.0::DOUBLE AS w{i}" for i in range(4)) + ")")
    for k in range(_STEPS):
        p = "1 / (1 + exp(-(" + " + ".join(f"x{i} * w{i}" for i in range(4)) + ")))"
        steps = ", ".join(f"any_value(w{i}) - 1.0 * avg(({p} - y) * x{i}) AS w{i}" for i in range(4))
        ctes.append(f"w{k + 1} AS (SELECT {steps} FROM r, w{k})")
    return f"WITH {', '.join(ctes)} " + " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS pos, round(w{i}, 6) + 0.0 AS w FROM w{_STEPS}" for i in range(4))


@query(_weather())
def cleansed_regression(spark, d):
    """Logistic regression over text lines; those with a token that is no number are left out."""
    path = scratch(spark, "readings")
    token = F.when(F.col("l_returnflag") == "A", F.lit("12x34")).otherwise(F.col("l_extendedprice").cast("string"))
    number = lambda c: F.format_string("%.2f", c)
    line = F.concat_ws(" ", F.lit("station day hour"), number("l_quantity"), number("l_discount"), number("l_tax"), token, F.lit("a b c d e f"))
    readers.write(table(spark, d, "lineitem").select(line.alias("value")), path, "text")
    lines = Dataset.text(spark, path).df.select(parsing.numeric_fields(F.col("value"), drop=3, drop_right=6).alias("f")).filter("f is not null")
    rows = lines.select(F.array(F.col("f")[0] / 50, F.col("f")[1], F.col("f")[2], F.lit(1.0)).alias("x"), (F.col("f")[3] > 30000).cast("double").alias("y"))
    kept = actions.cached(rows)
    try:
        return _weights(spark, iterative.logistic_regression(kept, [0.0] * 4, rate=1.0, iterations=_STEPS))
    finally:
        kept.unpersist()


# provenance and series

_TASKS = "(SELECT user_id % 8 AS lane, epoch_us(ts) // 1000 AS s, CASE WHEN event_id % 50 = 0 THEN -1 ELSE epoch_us(ts) // 1000 + CAST(round(value * 100) AS BIGINT) END AS e FROM events)"


@query(f"WITH t AS (SELECT lane, s, CASE WHEN e < s THEN 2000000000000 ELSE e END AS e FROM {_TASKS}) SELECT lane, count(*) AS tasks, min(s) AS first, max(e) AS last, CAST(sum(e - s) AS BIGINT) AS busy FROM t GROUP BY 1")
def trace_lanes(spark, d):
    events = points(spark, d).join(table(spark, d, "events").select("event_id", "user_id", F.col("value").alias("x")), "event_id")
    trace = events.select((F.col("user_id") % 8).alias("lane"), F.col("time").alias("s"), F.when(F.col("event_id") % 50 == 0, -1).otherwise(F.col("time") + F.round(F.col("x") * 100).cast("long")).alias("e"))
    return provenance.lanes(trace, "lane", "s", "e", 2_000_000_000_000)


@query("SELECT DISTINCT l_suppkey AS source, l_orderkey AS target FROM lineitem")
def trace_links(spark, d):
    tasks = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("task")).agg(F.collect_set("l_suppkey").alias("inputs"))
    return provenance.task_links(tasks)


@query("SELECT p_partkey, p_size || '.' || (p_partkey % 13) AS version FROM part WHERE p_size > 9 OR (p_size = 9 AND p_partkey % 13 >= 4)")
def versions_since(spark, d):
    parts = table(spark, d, "part").select("p_partkey", F.concat_ws(".", F.col("p_size"), F.col("p_partkey") % 13).alias("version"))
    return provenance.since_version(parts, "9.4")


@query("SELECT 'app' AS app, v AS version, CAST(n AS BIGINT) AS runs, CAST(n AS BIGINT) AS succeeded FROM (VALUES ('1.0', 2), ('1.1', 1)) t(v, n)")
def versions_listing(spark, d):
    nation = table(spark, d, "nation")
    first, second = provenance.Runs(spark, "app", "1.0"), provenance.Runs(spark, "app", "1.1")
    for r in (first, first, second):
        r.run(nation)
    return first.versions().unionByName(second.versions())


@query("SELECT (SELECT count(*) FROM nation) AS n, true AS traced, true AS placed, true AS read")
def execution_trace(spark, d):
    """What a run leaves behind: each task ended after it began, on a core of a worker, over the table's files."""
    runs = provenance.Runs(spark, "traced", "1")
    run, n = runs.run(table(spark, d, "nation").filter("n_nationkey >= 0"), lambda df: df.repartition(3).count())
    tasks = runs.tasks(run)
    return tasks.agg(F.lit(n).cast("long").alias("n"), ((F.count("*") >= 3) & F.bool_and(F.col("ended") >= F.col("started"))).alias("traced"), F.bool_and(F.col("executor").isNotNull() & (F.col("core") >= 0)).alias("placed"), F.bool_and(F.size("inputs") >= 1).alias("read"))


@query("SELECT true AS logical, true AS physical, true AS linked")
def plan_flows(spark, d):
    df = Dataset(table(spark, d, "lineitem")).keyed("l_suppkey", "l_quantity").reduce_by_key("max").df
    logical, physical = provenance.logical_plan(df), provenance.physical_plan(df)
    has = lambda plan, name: plan.filter(F.col("name").contains(name)).count() > 0
    row = (has(logical, "Aggregate"), has(physical, "HashAggregate") and has(physical, "Exchange"), provenance.plan_links(physical).count() == physical.count() - 1)
    return spark.createDataFrame([row], "logical boolean, physical boolean, linked boolean")


@query("SELECT true AS up")
def nodes(spark, d):
    return provenance.cluster_nodes(spark).agg((F.count("*") >= 1).alias("up"))


@query(f"SELECT DISTINCT key FROM {_POINTS} WHERE prop = 'view' AND contains(key, '7')")
def metric_keys(spark, d):
    return metrics.query(points(spark, d), "keys", prop="view", like="7")


@query(
    f"WITH f AS (SELECT prop, min(key) AS key FROM {_POINTS} WHERE contains(prop, 'ic') AND contains(key, '1') AND prop = (SELECT min(prop) FROM {_POINTS} WHERE contains(prop, 'ic') AND contains(key, '1')) GROUP BY 1) "
    f"SELECT prop, key, time, CAST(CAST(value AS VARCHAR) AS FLOAT) AS value FROM {_POINTS} JOIN f USING (prop, key)"
)
def metric_data_like(spark, d):
    return metrics.query(points(spark, d), "data_like", prop="ic", key="1")


@query(f"SELECT round(coalesce(sum(value), 0), 4) + 0.0 AS value FROM {_POINTS} WHERE prop = 'purchase' AND key = '3'")
def metric_sum(spark, d):
    return metrics.query(points(spark, d), "sum", prop="purchase", key="3").select(F.round("value", 4).alias("value"))


_BOTH = f"SELECT coalesce(sum(value) FILTER (prop = 'click' AND key = '1'), 0) AS l, coalesce(sum(value) FILTER (prop = 'view' AND key = '1'), 0) AS r FROM {_POINTS}"


@query(f"SELECT 'minus' AS op, round(l - r, 4) + 0.0 AS value FROM ({_BOTH}) UNION ALL SELECT '*', round(l * r, 2) + 0.0 FROM ({_BOTH}) UNION ALL SELECT '/', round(CASE WHEN r = 0 THEN NULL ELSE l / r END, 6) + 0.0 FROM ({_BOTH}) UNION ALL SELECT 'unknown', round(l, 4) + 0.0 FROM ({_BOTH})")
def metric_compute_all(spark, d):
    out = None
    for op, digits in (("minus", 4), ("*", 2), ("/", 6), ("unknown", 4)):
        got = metrics.query(points(spark, d), "compute", left=("click", "1"), operation=op, right=("view", "1"), now=0, duration_ms=0)
        got = got.select(F.lit(op).alias("op"), F.round("value", digits).alias("value"))
        out = got if out is None else out.unionByName(got)
    return out


@query(f"SELECT prop, key, CAST(count(*) AS BIGINT) AS n FROM {_POINTS} GROUP BY 1, 2")
def metric_counters(spark, d):
    counters = metrics.Counters()
    counters.add_all(points(spark, d).groupBy("prop", "key").agg(F.count("*").alias("n")))
    pairs = [(r["prop"], r["key"]) for r in points(spark, d).select("prop", "key").distinct().collect()]
    return readers.from_rows(spark, [(p, k, counters.get(p, k)) for p, k in pairs], "prop string, key string, n long")
