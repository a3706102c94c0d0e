"""Queries over the synthetic tables, one for each operator, and the SQL that states the same.

Sums go through decimals, so that they do not depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.dataset import Dataset
from weftline.functions import parsing
from weftline.functions.reducers import exact_sum
from weftline.operators import actions, iterative, joins, keyed, linalg, ordering, partitioning, sampling, sets
from weftline.streaming import metrics

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dec(name: str, scale: int = 2):
    return F.col(name).cast(f"decimal(18,{scale})")


# flagship


@query("SELECT l_returnflag AS key, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS value FROM lineitem GROUP BY 1")
def reduce_by_key(spark, d):
    return Dataset(table(spark, d, "lineitem")).keyed("l_returnflag", "l_extendedprice").reduce_by_key(exact_sum).df


# rows


@query("SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) AS net FROM lineitem")
def map_project(spark, d):
    return Dataset(table(spark, d, "lineitem")).map("l_orderkey", "l_linenumber", net=(dec("l_extendedprice") * (1 - dec("l_discount"))).cast("double")).df


@query("SELECT p_partkey, substring(substring(p_brand, 1, 7), 1, 6) AS brand FROM part WHERE regexp_full_match(substring(p_brand, 1, 7), 'Brand#[1-3].*')")
def multi_map_filter(spark, d):
    ds = Dataset(table(spark, d, "part")).map("p_partkey", b=parsing.prefix(F.col("p_brand"), 7))
    return ds.filter(parsing.full_match(F.col("b"), "Brand#[1-3].*")).map("p_partkey", brand=parsing.prefix(F.col("b"), 6)).df


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_extendedprice > 50000")
def filter_where(spark, d):
    return Dataset(table(spark, d, "lineitem")).filter("l_extendedprice > 50000").map("l_orderkey", "l_linenumber", "l_extendedprice").df


@query("SELECT word, count(*) AS n FROM (SELECT unnest(string_split_regex(text, '[ \\t\\n\\x0b\\f\\r]+')) AS word FROM conversations) WHERE word <> '' GROUP BY 1")
def word_count(spark, d):
    return Dataset(table(spark, d, "conversations")).flat_map(parsing.words(F.col("text")), "word").group_reduce("word", n=F.count("*")).df.withColumnRenamed("key", "word")


@query("SELECT conv_id, list_sort(list(turn)) AS turns FROM (SELECT conv_id, turn FROM conversations WHERE role = 'user') GROUP BY 1")
def flat_group(spark, d):
    return Dataset(table(spark, d, "conversations")).filter("role = 'user'").group_by("conv_id", "turn").collect().select(F.col("key").alias("conv_id"), F.col("values").alias("turns"))


@query("SELECT r_regionkey, upper(r_name) AS name FROM region")
def map_python(spark, d):
    return Dataset(table(spark, d, "region")).map(lambda pdf: pdf.assign(name=pdf["r_name"].str.upper())[["r_regionkey", "name"]], schema="r_regionkey int, name string").df


@query("SELECT count(*) AS n FROM nation")
def map_partitions(spark, d):
    def sizes(frames):
        import pandas as pd

        yield pd.DataFrame({"n": [sum(len(f) for f in frames)]})

    return Dataset(table(spark, d, "nation")).map_partitions(sizes, "n long").df.agg(F.sum("n").alias("n"))


@query("SELECT n_nationkey, n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS index FROM nation")
def zip_with_index(spark, d):
    return Dataset(table(spark, d, "nation").select("n_nationkey", "n_name")).zip_with_index("n_nationkey").df


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS index FROM orders")
def zip_with_index_ordered(spark, d):
    return ordering.zip_with_index(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), F.desc("o_totalprice"), F.asc("o_orderkey")).select("o_orderkey", "index")


# keys


@query("SELECT c_mktsegment AS key, abs(c_acctbal) AS value FROM customer")
def map_values(spark, d):
    return Dataset(table(spark, d, "customer")).keyed("c_mktsegment", "c_acctbal").map_values(F.abs).df


@query("SELECT lower(c_mktsegment) AS key, c_acctbal AS value FROM customer")
def map_key(spark, d):
    return Dataset(table(spark, d, "customer")).keyed("c_mktsegment", "c_acctbal").map_key(F.lower).df


@query("SELECT n_regionkey AS key, n_name AS value FROM nation")
def swap(spark, d):
    return Dataset(table(spark, d, "nation")).keyed("n_name", "n_regionkey").swap().df


@query("SELECT c_nationkey AS key, c_acctbal AS value FROM customer WHERE c_nationkey % 5 = 0")
def find_by_key(spark, d):
    return Dataset(table(spark, d, "customer")).keyed("c_nationkey", "c_acctbal").find_by_key(lambda k: k % 5 == 0).df


@query("SELECT c_nationkey AS key, c_acctbal AS value FROM customer WHERE c_acctbal < 0")
def find_by_value(spark, d):
    return Dataset(table(spark, d, "customer")).keyed("c_nationkey", "c_acctbal").find_by_value("value < 0").df


@query("SELECT o_custkey AS key, count(*) AS size FROM orders WHERE CAST(o_custkey AS VARCHAR) LIKE '1%' GROUP BY 1")
def find_by_key_after_group(spark, d):
    return Dataset(table(spark, d, "orders")).group_by("o_custkey", "o_orderkey").find_by_key(lambda k: k.cast("string").startswith("1")).sizes()


@query("SELECT o_custkey AS key, list_sort(coalesce(list(o_orderkey) FILTER (o_totalprice > 200000), [])) AS values FROM orders GROUP BY 1")
def find_values_by_key(spark, d):
    groups = Dataset(table(spark, d, "orders")).group_by("o_custkey", F.struct("o_orderkey", "o_totalprice"))
    return groups.find_values(lambda v: v["o_totalprice"] > 200000).select("key", F.transform("values", lambda v: v["o_orderkey"]).alias("values"))


@query("SELECT o_custkey AS key, list_sort(list(o_orderkey)) AS values FROM orders GROUP BY 1")
def group_by_collect(spark, d):
    return Dataset(table(spark, d, "orders")).group_by("o_custkey", "o_orderkey").collect()


@query("SELECT l_suppkey AS key, CAST(sum(CAST(l_quantity AS DECIMAL(18,2)) * 2) AS DOUBLE) AS value FROM lineitem GROUP BY 1")
def group_map_values(spark, d):
    return Dataset(table(spark, d, "lineitem")).group_by("l_suppkey", "l_quantity").map_values(lambda v: v * 2).reduce(exact_sum)


@query("SELECT l_suppkey AS key, max(l_extendedprice * 2) AS value FROM lineitem GROUP BY 1")
def reduce_values(spark, d):
    return Dataset(table(spark, d, "lineitem")).group_by("l_suppkey", "l_extendedprice").reduce_values("max", lambda v: v * 2)


@query(
    "SELECT l_returnflag AS key, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity, max(l_extendedprice) AS price, count(*) AS n FROM lineitem GROUP BY 1"
)
def group_reduce(spark, d):
    return Dataset(table(spark, d, "lineitem")).group_reduce("l_returnflag", quantity=exact_sum(F.col("l_quantity")), price=F.max("l_extendedprice"), n=F.count("*")).df


@query("SELECT l_linestatus AS key, max(l_shipdate) AS value FROM lineitem GROUP BY 1")
def group_map_reduce(spark, d):
    return Dataset(table(spark, d, "lineitem")).group_map_reduce("l_linestatus", "l_shipdate", "max").df


@query("SELECT l_suppkey AS key, sum(l_orderkey) AS value FROM lineitem GROUP BY 1")
def reduce_by_key_python(spark, d):
    return Dataset(table(spark, d, "lineitem")).keyed("l_suppkey", "l_orderkey").reduce_by_key(lambda a, b: a + b, python=True).df


@query("SELECT n_regionkey AS key, coalesce(max(CASE WHEN n_nationkey > 20 THEN n_nationkey END), -1) AS value FROM nation GROUP BY 1")
def fold_by_key(spark, d):
    return Dataset(table(spark, d, "nation")).keyed("n_regionkey", F.when(F.col("n_nationkey") > 20, F.col("n_nationkey"))).fold_by_key(-1, "max").df


@query("SELECT conv_id, CAST(sum(turn * 2) AS BIGINT) AS value FROM conversations GROUP BY 1")
def fold_ordered(spark, d):
    return actions.fold_ordered(table(spark, d, "conversations"), "conv_id", "turn", "turn", 0, lambda s, x: s + x * 2)


# whole datasets


@query("SELECT count(*) AS count FROM lineitem")
def count_all(spark, d):
    return Dataset(table(spark, d, "lineitem")).count().df


@query("SELECT count(*) AS count FROM (SELECT substring(p_brand, 1, 3) AS k FROM part)")
def map_count(spark, d):
    return Dataset(table(spark, d, "part")).map(k=parsing.prefix(F.col("p_brand"), 3)).count().df


@query("SELECT CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value FROM orders")
def reduce_global(spark, d):
    return Dataset(table(spark, d, "orders")).reduce("o_totalprice", exact_sum).df


@query("SELECT max(o_totalprice) AS value FROM orders")
def reduce_global_max(spark, d):
    return Dataset(table(spark, d, "orders")).reduce("o_totalprice", "max").df


@query("SELECT -1 AS value")
def fold_empty(spark, d):
    return Dataset(table(spark, d, "nation").filter("n_nationkey < 0")).fold("n_nationkey", -1, "max").df


# sets


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey AS k FROM supplier")
def union_all(spark, d):
    return Dataset(table(spark, d, "customer")).map(k="c_nationkey").union(Dataset(table(spark, d, "supplier")).map(k="s_nationkey")).df


@query("SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def distinct_rows(spark, d):
    return Dataset(table(spark, d, "customer")).map("c_nationkey", "c_mktsegment").distinct().df


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey AS k FROM supplier")
def intersect_rows(spark, d):
    return sets.intersection(table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")))


@query("SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0")
def subtract_rows(spark, d):
    return sets.subtract(table(spark, d, "orders").select(F.col("o_custkey").alias("k")), table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("k")))


# joins

_COGROUP = """
WITH o AS (SELECT o_orderkey AS key, count(*) AS n FROM orders GROUP BY 1),
l AS (SELECT l_orderkey AS key, count(*) AS n FROM lineitem GROUP BY 1)
SELECT coalesce(o.key, l.key) AS key, coalesce(o.n, 0) AS orders, coalesce(l.n, 0) AS lines FROM o FULL JOIN l ON o.key = l.key
"""


@query(_COGROUP)
def cogroup_sizes(spark, d):
    one = F.count("*")
    out = joins.cogroup_aggregate(table(spark, d, "orders"), table(spark, d, "lineitem"), "o_orderkey", "l_orderkey", {"orders": one}, {"lines": one})
    return out.fillna(0, ["orders", "lines"])


@query("""
WITH o AS (SELECT o_orderkey AS key, list(o_custkey) AS v FROM orders GROUP BY 1),
l AS (SELECT l_orderkey AS key, list_sort(list(l_suppkey)) AS v FROM lineitem GROUP BY 1)
SELECT coalesce(o.key, l.key) AS key, coalesce(o.v, []) AS left_values, coalesce(l.v, []) AS right_values FROM o FULL JOIN l ON o.key = l.key
""")
def cogroup_arrays(spark, d):
    return Dataset(table(spark, d, "orders")).cogroup(Dataset(table(spark, d, "lineitem")), "o_orderkey", "l_orderkey", "o_custkey", "l_suppkey").df


@query("SELECT c_custkey AS key, c_name, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey")
def join_by(spark, d):
    return Dataset(table(spark, d, "customer").select("c_custkey", "c_name")).join_by(Dataset(table(spark, d, "orders").select("o_custkey", "o_orderkey")), "c_custkey", "o_custkey").df.select("key", "c_name", "o_orderkey")


@query("SELECT c_nationkey AS key, c_custkey AS left_value, s_suppkey AS right_value FROM customer JOIN supplier ON c_nationkey = s_nationkey")
def join_by_key(spark, d):
    return Dataset(table(spark, d, "customer")).keyed("c_nationkey", "c_custkey").join_by_key(Dataset(table(spark, d, "supplier")).keyed("s_nationkey", "s_suppkey")).df


@query("SELECT o_orderkey AS key, o_custkey AS left_value, n AS right_value FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey")
def join_by_key_opt(spark, d):
    lines = Dataset(table(spark, d, "lineitem")).keyed("l_orderkey", F.lit(1)).reduce_by_key("count")
    return Dataset(table(spark, d, "orders")).keyed("o_orderkey", "o_custkey").join_by_key_opt(lines).df


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def anti_join(spark, d):
    return joins.join_by(table(spark, d, "orders").select("o_orderkey"), table(spark, d, "lineitem").select("l_orderkey"), "o_orderkey", "l_orderkey", "left_anti").select("o_orderkey")


@query("""
SELECT n_name, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM customer JOIN orders ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1
""")
def multi_join(spark, d):
    c, o, n = (table(spark, d, t) for t in ("customer", "orders", "nation"))
    out = joins.join_by(joins.join_by(c, o, "c_custkey", "o_custkey").drop("key"), n, "c_nationkey", "n_nationkey")
    return out.groupBy("n_name").agg(F.count("*").alias("orders"), exact_sum(F.col("o_totalprice")).alias("total"))


@query("SELECT n_nationkey AS key, n_name AS value_1, c AS value_2, s AS value_3 FROM nation JOIN (SELECT c_nationkey AS k, count(*) AS c FROM customer GROUP BY 1) a ON n_nationkey = a.k JOIN (SELECT s_nationkey AS k, count(*) AS s FROM supplier GROUP BY 1) b ON n_nationkey = b.k")
def join_many(spark, d):
    counted = lambda t, k: keyed.reduce_by_key(keyed.keyed(table(spark, d, t), k, F.lit(1)), "count")
    return joins.join_many(keyed.keyed(table(spark, d, "nation"), "n_nationkey", "n_name"), counted("customer", "c_nationkey"), counted("supplier", "s_nationkey"))


# order and place


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey")
def sort_by_desc(spark, d):
    return Dataset(table(spark, d, "orders").select("o_orderkey", "o_totalprice")).sort_by(F.desc("o_totalprice"), "o_orderkey").df


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey % 10, o_orderkey DESC")
def sort_by_comparator(spark, d):
    return Dataset(table(spark, d, "orders").select("o_orderkey", "o_custkey")).sort_by(F.col("o_custkey") % 10, F.desc("o_orderkey")).df


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def top_k(spark, d):
    return Dataset(table(spark, d, "orders").select("o_orderkey", "o_totalprice")).top(100, F.desc("o_totalprice"), "o_orderkey").df


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 2")
def top_per_key(spark, d):
    return ordering.top_per_key(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), 2, "o_custkey", F.desc("o_totalprice"), F.asc("o_orderkey"))


@query("SELECT l_suppkey % 7 AS g, 1 AS partitions, count(*) AS n FROM lineitem GROUP BY 1")
def partition_hash(spark, d):
    placed = partitioning.by_number(table(spark, d, "lineitem").select("l_suppkey"), 7, F.col("l_suppkey")).withColumn("p", F.spark_partition_id())
    return placed.groupBy((F.col("l_suppkey") % 7).alias("g")).agg(F.countDistinct("p").alias("partitions"), F.count("*").alias("n"))


@query("SELECT count(*) AS n, true AS ordered FROM orders")
def partition_range(spark, d):
    placed = partitioning.by_range(table(spark, d, "orders").select("o_orderkey"), 8, "o_orderkey")
    ranges = placed.groupBy(F.spark_partition_id().alias("p")).agg(F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"), F.count("*").alias("n"))
    from pyspark.sql import Window

    gaps = ranges.withColumn("ok", F.coalesce(F.col("lo") > F.lag("hi").over(Window.orderBy("p")), F.lit(True)))
    return gaps.agg(F.sum("n").alias("n"), F.bool_and("ok").alias("ordered"))


@query("SELECT 4 AS partitions, count(*) AS n FROM customer")
def partition_rr(spark, d):
    return partitioning.partition_sizes(partitioning.in_turn(table(spark, d, "customer"), 4)).agg(F.count("*").alias("partitions"), F.sum("size").alias("n"))


@query("SELECT 10 AS n, true AS known")
def sample_n(spark, d):
    customers = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    drawn = sampling.first_rows(customers, 10)
    known = drawn.join(customers, customers.columns, "left_semi").count()
    return drawn.agg(F.count("*").alias("n"), ((F.countDistinct("c_custkey") == 10) & F.lit(known == 10)).alias("known"))


# vectors and matrices


def vector(spark, d, element: int) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("idx"), F.get("embedding", F.lit(element)).cast("double").alias("v"))


def matrix(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("idx"), F.col("embedding").cast("array<double>").alias("row"))


_FIRST = "(SELECT vec_id AS idx, CAST(embedding[1] AS DOUBLE) AS v FROM embeddings)"
_SHIFTED = "(SELECT vec_id + 40 AS idx, CAST(embedding[2] AS DOUBLE) AS v FROM embeddings)"


def _two(spark, d):
    """Two whole vectors; the second one's indexes are shifted, so that each has some that the other lacks."""
    return vector(spark, d, 0), vector(spark, d, 1).withColumn("idx", F.col("idx") + 40)


@query(f"SELECT coalesce(a.idx, b.idx) AS idx, coalesce(a.v, 0) + coalesce(b.v, 0) AS v FROM {_FIRST} a FULL JOIN {_SHIFTED} b ON a.idx = b.idx")
def vec_add(spark, d):
    return linalg.add(*_two(spark, d))


@query(f"SELECT coalesce(a.idx, b.idx) AS idx, coalesce(a.v, 0) * coalesce(b.v, 0) AS v FROM {_FIRST} a FULL JOIN {_SHIFTED} b ON a.idx = b.idx")
def vec_times(spark, d):
    return linalg.times(*_two(spark, d))


@query(f"SELECT a.idx, a.v - b.v AS v FROM {_FIRST} a JOIN {_SHIFTED} b ON a.idx = b.idx")
def vec_minus(spark, d):
    return linalg.minus(*_two(spark, d))


@query(f"SELECT round(sum(a.v * b.v), 6) + 0.0 AS value FROM {_FIRST} a JOIN {_SHIFTED} b ON a.idx = b.idx")
def vec_inner(spark, d):
    return linalg.inner(*_two(spark, d)).select(F.round("value", 6).alias("value"))


@query(f"SELECT idx, v FROM {_FIRST} WHERE idx >= 10 AND idx < 30")
def vec_slice(spark, d):
    return linalg.cut(_two(spark, d)[0], 10, 20)


@query("SELECT vec_id AS idx, CAST(embedding[1] AS DOUBLE) AS v FROM embeddings UNION ALL SELECT vec_id + (SELECT count(*) FROM embeddings) AS idx, CAST(embedding[2] AS DOUBLE) AS v FROM embeddings")
def vec_concat(spark, d):
    return linalg.concat(vector(spark, d, 0), vector(spark, d, 1))


@query("SELECT vec_id AS idx, -(CAST(embedding[1] AS DOUBLE) * 2 + 1) AS v FROM embeddings")
def vec_map(spark, d):
    return linalg.negate(linalg.shift(linalg.scale(vector(spark, d, 0), 2), 1))


@query("SELECT round(sum(CAST(embedding[1] AS DOUBLE)), 6) + 0.0 AS value FROM embeddings")
def vec_sum(spark, d):
    return linalg.reduce(vector(spark, d, 0), "sum").select(F.round("value", 6).alias("value"))


_CELLS = "(SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS c FROM embeddings)"


@query(f"SELECT vec_id AS idx, round(sum(x * (c + 1)), 6) + 0.0 AS v FROM {_CELLS} GROUP BY 1")
def mat_dot(spark, d):
    m = matrix(spark, d)
    return linalg.dot(m, range(1, 65)).select("idx", F.round("v", 6).alias("v"))


@query(f"SELECT c AS idx, round(sum(x), 6) + 0.0 AS v FROM {_CELLS} GROUP BY 1")
def mat_sum_rows(spark, d):
    return linalg.reduce_rows(matrix(spark, d), width=64).select("idx", F.round("v", 6).alias("v"))


@query(f"SELECT vec_id AS idx, round(sum(x), 6) + 0.0 AS v FROM {_CELLS} GROUP BY 1")
def mat_sum_cols(spark, d):
    return linalg.reduce_columns(matrix(spark, d)).select("idx", F.round("v", 6).alias("v"))


@query(f"WITH s AS (SELECT c, avg(x) AS m, sum(x * x) AS q FROM {_CELLS} GROUP BY 1) SELECT vec_id AS idx, c AS col, round((x - m) / sqrt(q), 6) + 0.0 AS x FROM {_CELLS} t JOIN s USING (c)")
def mat_norm(spark, d):
    return linalg.cells(linalg.normalised(matrix(spark, d))).select("idx", F.col("col").cast("long").alias("col"), F.round("x", 6).alias("x"))


@query(f"SELECT t.vec_id AS idx, c AS col, round(x * CAST(e.embedding[1] AS DOUBLE), 6) + 0.0 AS x FROM {_CELLS} t JOIN embeddings e ON t.vec_id = e.vec_id")
def mat_zip_map(spark, d):
    out = linalg.zip_rows(matrix(spark, d), _two(spark, d)[0], lambda x, v: x * v)
    return linalg.cells(out).select("idx", F.col("col").cast("long").alias("col"), F.round("x", 6).alias("x"))


@query("SELECT vec_id AS idx, CAST(embedding[6] AS DOUBLE) AS v FROM embeddings")
def mat_column(spark, d):
    return linalg.col(matrix(spark, d), 5)


@query(f"SELECT c AS idx, x AS v FROM {_CELLS} WHERE vec_id = 3")
def mat_row(spark, d):
    return linalg.row(matrix(spark, d), 3)


@query(f"SELECT round(sum(x), 5) + 0.0 AS value FROM {_CELLS}")
def mat_sum(spark, d):
    return linalg.total(matrix(spark, d)).select(F.round("value", 5).alias("value"))


# iterations

_W = [0.01 * (i % 7 - 3) for i in range(64)]
_ERRORS = f"(SELECT vec_id, label, sum(x * (0.01 * (c % 7 - 3))) AS p FROM {_CELLS} JOIN embeddings USING (vec_id) GROUP BY 1, 2)"


@query(f"SELECT c AS pos, round(avg((p - label) * x), 6) + 0.0 AS g FROM {_CELLS} JOIN {_ERRORS} USING (vec_id) GROUP BY 1")
def linear_regression_step(spark, d):
    points = table(spark, d, "embeddings").select(F.col("embedding").cast("array<double>").alias("x"), F.col("label").cast("double").alias("y"))
    return iterative.gradient(points, _W, iterative.squared_error).select(F.col("pos").cast("long").alias("pos"), F.round("g", 6).alias("g"))


@query(f"SELECT c AS pos, round(avg((1 / (1 + exp(-p)) - label % 2) * x), 6) + 0.0 AS g FROM {_CELLS} JOIN {_ERRORS} USING (vec_id) GROUP BY 1")
def logistic_regression_step(spark, d):
    points = table(spark, d, "embeddings").select(F.col("embedding").cast("array<double>").alias("x"), (F.col("label") % 2).cast("double").alias("y"))
    return iterative.gradient(points, _W, iterative.logistic_error).select(F.col("pos").cast("long").alias("pos"), F.round("g", 6).alias("g"))


_CENTRES = [[0.05 * ((i * (k + 1)) % 5 - 2) for i in range(64)] for k in range(3)]
_DISTANCES = " UNION ALL ".join(f"SELECT vec_id, {k} AS k, sum((x - 0.05 * ((c * {k + 1}) % 5 - 2)) * (x - 0.05 * ((c * {k + 1}) % 5 - 2))) AS d FROM {_CELLS} GROUP BY 1" for k in range(3))


@query(f"WITH a AS (SELECT vec_id, min_by(k, d) AS cluster FROM ({_DISTANCES}) GROUP BY 1) SELECT cluster, c AS pos, round(avg(x), 6) + 0.0 AS v FROM {_CELLS} JOIN a USING (vec_id) GROUP BY 1, 2")
def kmeans_step(spark, d):
    points = table(spark, d, "embeddings").select(F.col("embedding").cast("array<double>").alias("x"))
    return iterative.centre_step(points, _CENTRES).select("cluster", F.col("pos").cast("long").alias("pos"), F.round("v", 6).alias("v"))


# series

_POINTS = "(SELECT event_type AS prop, CAST(user_id AS VARCHAR) AS key, value, epoch_us(ts) // 1000 AS time, event_id FROM events)"
_NOW = "(SELECT max(epoch_us(ts) // 1000) FROM events)"


def _millis():
    """Milliseconds of ``ts``, which has no time zone."""
    return F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts AS timestamp_ntz))")


def points(spark, d) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_type").alias("prop"), F.col("user_id").cast("string").alias("key"), F.col("value").cast("string").alias("value"), _millis().alias("time"), "event_id")


def latest(spark, d) -> int:
    return table(spark, d, "events").agg(F.max(_millis())).first()[0]


@query(f"SELECT prop, key, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value FROM {_POINTS} WHERE time > {_NOW} - 172800000 GROUP BY 1, 2")
def metric_sum_horizon(spark, d):
    return metrics.totals(points(spark, d), now=latest(spark, d), duration_ms=2 * metrics.DAY_MS)


@query(f"SELECT prop, key, event_id FROM (SELECT *, row_number() OVER (PARTITION BY prop, key ORDER BY time DESC, event_id DESC) AS r FROM {_POINTS}) WHERE r <= 3")
def metric_retention(spark, d):
    return metrics.retained(points(spark, d), 3, "event_id").select("prop", "key", "event_id")


@query(f"SELECT round(coalesce(sum(value) FILTER (prop = 'click' AND key = '1'), 0) + coalesce(sum(value) FILTER (prop = 'view' AND key = '1'), 0), 4) + 0.0 AS value FROM {_POINTS}")
def metric_compute_val(spark, d):
    return metrics.computed(points(spark, d), ("click", "1"), "+", ("view", "1"), now=latest(spark, d), duration_ms=0).select(F.round("value", 4).alias("value"))


@query(f"SELECT DISTINCT prop FROM {_POINTS} WHERE contains(prop, 'i')")
def metric_props_like(spark, d):
    return metrics.props(points(spark, d), "i")


@query(f"SELECT time, CAST(CAST(value AS VARCHAR) AS FLOAT) AS value FROM {_POINTS} WHERE prop = 'click' AND key = '7'")
def metric_data(spark, d):
    return metrics.data(points(spark, d), "click", "7")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))
