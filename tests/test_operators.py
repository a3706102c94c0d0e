"""Semantics on hand-made edge cases, and the plans that scale depends on."""

import datetime

import pytest
from pyspark.sql import functions as F

from weftline.dataset import Dataset
from weftline.functions import parsing
from weftline.operators import actions, iterative, joins, keyed, linalg, ordering, partitioning, sets
from weftline.plans import provenance
from weftline.sources import readers
from weftline.streaming import metrics


def values(df, *columns):
    return sorted(tuple(r) for r in df.select(*(columns or df.columns)).collect())


def pairs(spark, rows):
    return spark.createDataFrame(rows, "key string, value long")


def test_split_drops_trailing_empty_fields(spark):
    df = spark.createDataFrame([("a,b,,",), ("a,,b",), ("",), (",,",), (None,)], "line string")
    got = [r[0] for r in df.select(parsing.split_fields(F.col("line"))).collect()]
    assert got == [["a", "b"], ["a", "", "b"], [""], [""], None]


def test_parsing(spark):
    df = spark.createDataFrame([("x12y",), ("12",), ("a",)], "s string")
    assert [r[0] for r in df.select(parsing.full_match(F.col("s"), r"\d+")).collect()] == [False, True, False]
    assert [r[0] for r in df.select(parsing.number(F.col("s"), "int", lenient=True)).collect()] == [None, 12, None]
    assert [r[0] for r in df.select(parsing.prefix(F.col("s"), 3)).collect()] == ["x12", "12", "a"]
    with pytest.raises(Exception, match="shorter"):
        df.select(parsing.prefix(F.col("s"), 3, strict=True)).collect()
    lines = spark.createDataFrame([("a b c 1 2.5 3 d e f g h i",), ("a b c 1 x 3 d e f g h i",), ("a b",)], "l string")
    assert [r[0] for r in lines.select(parsing.numeric_fields(F.col("l"), drop=3, drop_right=6)).collect()] == [[1.0, 2.5, 3.0], None, []]


def test_null_keys_are_one_group_and_join_nothing(spark):
    a, b = pairs(spark, [(None, 1), (None, 2), ("a", 3)]), pairs(spark, [(None, 5), ("a", 6)])
    assert {tuple(r) for r in keyed.reduce_by_key(a, "sum").collect()} == {(None, 3), ("a", 3)}
    assert values(joins.join_by_key(a, b)) == [("a", 3, 6)]
    got = {r.key: (r.left_values, r.right_values) for r in joins.cogroup(a, b, "key", "key", "value", "value").collect()}
    assert got == {None: ([1, 2], [5]), "a": ([3], [6])}


def test_cogroup_has_empty_sides(spark):
    got = {r.key: (r.left_values, r.right_values) for r in joins.cogroup(pairs(spark, [("l", 1)]), pairs(spark, [("r", 2)]), "key", "key", "value", "value").collect()}
    assert got == {"l": ([1], []), "r": ([], [2])}


def test_joins_keep_clashing_columns_apart(spark):
    a, b = spark.createDataFrame([(1, "x")], "id int, name string"), spark.createDataFrame([(1, "y")], "id int, name string")
    out = joins.join_by(a, b, "id", "id")
    assert out.columns == ["id", "name", "right_id", "right_name", "key"] and tuple(out.first()) == (1, "x", 1, "y", 1)


def test_python_reducers(spark):
    df = pairs(spark, [("a", 1), ("b", 5), ("a", 7), ("b", 2)] * 50).repartition(4)
    assert values(keyed.reduce_by_key(df, max, python=True)) == [("a", 7), ("b", 5)]


def test_nothing_to_reduce(spark):
    empty = pairs(spark, [])
    assert actions.reduce(empty, "value", "sum").count() == 0
    assert actions.count(empty).first()[0] == 0 and actions.fold(empty, "value", 7, "max").first()[0] == 7
    assert keyed.reduce_by_key(empty, "sum").count() == 0 and ordering.zip_with_index(empty, "key").count() == 0


def test_find_values_keeps_empty_groups(spark):
    got = keyed.group_by(pairs(spark, [("a", 1), ("a", 9), ("b", 1)]), "key", "value").find_values(lambda v: v > 5)
    assert {r.key: r["values"] for r in got.collect()} == {"a": [9], "b": []}


def test_order_with_ties_and_indexes(spark):
    df = pairs(spark, [(str(i % 7), -i % 13) for i in range(100)]).repartition(8)
    got = ordering.zip_with_index(df, F.desc("value"), "key").orderBy("index").collect()
    assert [r["index"] for r in got] == list(range(100)) and [(-r["value"], r["key"]) for r in got] == sorted((-r["value"], r["key"]) for r in got)
    assert [r["value"] for r in ordering.top(df, 3, F.desc("value"), "key").collect()] == [12, 12, 12]
    more = ordering.zip_with_index(spark.range(3).repartition(8))
    assert sorted(r["index"] for r in more.collect()) == [0, 1, 2]


def test_partitions(spark):
    df = spark.range(1000)
    assert partitioning.in_turn(df, 5).rdd.getNumPartitions() == 5
    sizes = values(partitioning.partition_sizes(partitioning.by_range(df, 4, "id", sort=True)))
    assert len(sizes) == 4 and sum(n for _, n in sizes) == 1000
    assert partitioning.fewer(partitioning.by_hash(df, 9, "id"), 2).rdd.getNumPartitions() == 2
    assert partitioning.by_prefix(spark.createDataFrame([("abc",), ("abd",)], "k string"), 2, "k", 2).count() == 2


def test_sets(spark):
    a, b = pairs(spark, [("a", 1), ("a", 1), (None, None)]), pairs(spark, [("a", 1), (None, None), ("c", 2)])
    assert sets.union(a, b).count() == 6 and sets.intersection(a, b).count() == 2
    assert sets.subtract(a, b).count() == 0 and sets.subtract(a, b, repeats=True).count() == 1


def test_background_actions(spark):
    df = spark.range(100)
    assert actions.compute(df).result(60).count() == 100
    assert [r.id for r in actions.traverse(df.orderBy("id")).result(60)] == list(range(100))
    assert len(Dataset(df).collect(60)) == 100
    slow = df.repartition(2).mapInPandas(lambda it: (__import__("time").sleep(20) or p for p in it), "id long")
    with pytest.raises(TimeoutError):
        actions.collect(slow, 1.5)


def test_loops(spark):
    ds = Dataset(spark.range(3).select(F.col("id").alias("x")))
    assert values(ds.repeat(6, lambda d: d.map(x="x + 1")).df) == [(6,), (7,), (8,)]
    out = ds.repeat_while(lambda a, b: b.df.agg(F.max("x")).first()[0] < 9, lambda d: d.map(x="x * 2 + 1"))
    assert out.df.agg(F.max("x")).first()[0] == 11


def test_vectors_of_different_lengths(spark):
    a, b = linalg.local_vector(spark, [1, 2, 3]), linalg.local_vector(spark, [10, 20])
    assert values(linalg.add(a, b)) == [(0, 11.0), (1, 22.0), (2, 3.0)]
    assert values(linalg.times(a, b)) == [(0, 10.0), (1, 40.0), (2, 0.0)]
    assert values(linalg.minus(a, b)) == [(0, -9.0), (1, -18.0)]
    assert linalg.inner(a, b).first()[0] == 50.0
    assert values(linalg.concat(a, b))[3:] == [(3, 10.0), (4, 20.0)]
    assert values(linalg.cut(a, 1, 2)) == [(1, 2.0), (2, 3.0)] and values(linalg.cut(a, 1, 2, strict=True)) == [(2, 3.0)]


def test_matrices(spark):
    m = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "idx long, row array<double>")
    assert values(linalg.reduce_rows(m)) == [(0, 4.0), (1, 6.0)] and values(linalg.reduce_columns(m)) == [(0, 3.0), (1, 7.0)]
    assert linalg.num_columns(m) == 2 and values(linalg.col(m, 1)) == [(0, 2.0), (1, 4.0)] and values(linalg.row(m, 1)) == [(0, 3.0), (1, 4.0)]
    norm = {r.idx: r.row for r in linalg.normalised(m).collect()}
    assert norm[0] == pytest.approx([-1 / 10**0.5, -1 / 20**0.5])


def test_iterations(spark):
    points = spark.createDataFrame([([1.0, float(i)], 3.0 + 2.0 * i) for i in range(-5, 6)], "x array<double>, y double")
    assert iterative.linear_regression(points, [0, 0], rate=0.05, iterations=150) == pytest.approx([3, 2], abs=0.01)
    labelled = points.select("x", (F.col("y") > 3).cast("double").alias("y"))
    w = iterative.logistic_regression(labelled, [0, 0], rate=0.5, iterations=30)
    assert w[1] > 0.5
    centres = iterative.k_means(spark.createDataFrame([([float(v)],) for v in (0, 1, 10, 11)], "x array<double>"), [[0], [5], [99]])
    assert centres == [[0.5], [10.5], [99.0]]
    tie = iterative.assign(spark.createDataFrame([([1.0],)], "x array<double>"), [[0], [2]]).first()
    assert tie["cluster"] == 0


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b"), (2, None)], "id int, s string")
    for kind, read in (("parquet", readers.parquet), ("orc", readers.orc)):
        readers.write(df, str(tmp_path / kind), kind)
        assert values(read(spark, str(tmp_path / kind)).fillna("")) == [(1, "a,b"), (2, "")]
    readers.write(df, str(tmp_path / "csv"), "csv")
    assert readers.csv_rows(spark, str(tmp_path / "csv"), "id int, s string").count() == 2
    (tmp_path / "r.json").write_text('[{"url": "u", "ranking": 1.5},\n {"url": "v", "ranking": 2}]')
    assert values(readers.json_rows(spark, str(tmp_path / "r.json"), "url string, ranking float")) == [("u", 1.5), ("v", 2.0)]
    (tmp_path / "a.txt").write_text("x\ny\n")
    (tmp_path / "b.txt").write_text("z")
    assert values(readers.text_lines(spark, str(tmp_path / "a.txt"), str(tmp_path / "b.txt"))) == [("x",), ("y",), ("z",)]
    assert readers.horizontal(spark, "int", [1, 2], [], [3]).count() == 3 and readers.parallelize(spark, [], "int", 4).count() == 0
    readers.publish(df, "published")
    assert readers.named(spark, "published").count() == 2
    assert readers.location("hdfs://me@host:9000/a/b") == ("hdfs", "me", "host", 9000, "/a/b") and readers.location("/a").scheme == "file"


def test_plans_as_rows(spark, sf_dir):
    li = readers.parquet(spark, f"{sf_dir}/lineitem.parquet")
    groups = keyed.group_by(li, "l_suppkey", "l_quantity").find_by_key(lambda k: k == 3).sizes()
    physical = provenance.physical_plan(groups)
    scan = physical.filter("description like '%PushedFilters%'").first()["description"]
    assert "EqualTo(l_suppkey,3)" in scan and "ReadSchema: struct<l_suppkey:bigint>" in scan
    assert provenance.plan_links(physical).count() == physical.count() - 1
    assert provenance.plan_counts(ordering.top(li, 5, "l_orderkey"), "^TakeOrdered") == 1
    assert provenance.plan_counts(keyed.reduce_by_key(keyed.keyed(li, "l_suppkey", "l_quantity"), "sum"), "Aggregate") == 2
    assert {r.phase for r in provenance.plan_rows(groups).select("phase").distinct().collect()} == set(provenance.PHASES)


def test_runs_and_traces(spark):
    runs = provenance.Runs(spark, "app", "1.2")
    run, n = runs.run(spark.range(50).repartition(3))
    assert n == 50 and runs.runs().first()["status"] == "SUCCEEDED" and runs.trace(run).count() >= 1 and runs.plans(run).count() > 1
    with pytest.raises(Exception):
        runs.run(spark.range(2).select(F.raise_error(F.lit("no"))), lambda d: d.collect())
    assert {r.status for r in runs.runs().collect()} == {"SUCCEEDED", "FAILED"}
    trace = spark.createDataFrame([("w1", 0, 10), ("w1", 5, -1), ("w2", 3, 4)], "lane string, s long, e long")
    assert values(provenance.lanes(trace, "lane", "s", "e", 20)) == [("w1", 2, 0, 20, 25), ("w2", 1, 3, 4, 1)]
    deps = spark.createDataFrame([("a", "1.2.10"), ("b", "1.2.9"), ("c", "1.10"), ("d", "1")], "name string, version string")
    assert sorted(r.name for r in provenance.since_version(deps, "1.2.10").collect()) == ["a", "c"]
    assert provenance.cluster_nodes(spark).count() >= 1
    tasks = spark.createDataFrame([("t", ["a", "b"])], "task string, inputs array<string>")
    assert provenance.task_links(tasks).count() == 2


def test_series(spark):
    rows = [("m", "cpu", "n1", str(i), "s", 1000 * i) for i in range(10)] + [("m", "mem", "n1", "4", "s", 9000), ("m", "mem", "n1", "no", "s", 9500)]
    df = spark.createDataFrame(rows, metrics.POINT_DDL)
    assert metrics.total(df, "cpu", "n1").first()[0] == 45.0 and metrics.total(df, "cpu", "zz").first()[0] == 0.0
    assert metrics.total(df, "cpu", "n1", now=9000, duration_ms=2000).first()[0] == 17.0
    assert metrics.retained(df, 3).count() == 5
    for op, want in (("+", 49.0), ("minus", 41.0), ("*", 180.0), ("divide", 11.25), ("?", 45.0)):
        assert metrics.computed(df, ("cpu", "n1"), op, ("mem", "n1"), now=9000, duration_ms=0).first()[0] == want
    assert [r.time for r in metrics.data_like(df, "p", "n").collect()] == [1000 * i for i in range(10)]
    assert values(metrics.props(df)) == [("cpu",), ("mem",)] and values(metrics.keys(df, "cpu", "1")) == [("n1",)]
    c = metrics.Counters()
    assert c.get("p", "k") == -2 and c.increase("p", "k", 2) == 2 and c.get("p", "x") == -1 and c.get_and_reset("p", "k") == 2 and c.get("p", "k") == 0


def test_streamed_series(spark, tmp_path):
    rows = [("m", "cpu", "n", "1", "s", 60_000 * i) for i in range(40)]
    spark.createDataFrame(rows, metrics.POINT_DDL).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(metrics.POINT_DDL).parquet(str(tmp_path / "in"))
    q = metrics.streamed_totals(stream).writeStream.format("memory").queryName("totals").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("totals").select(F.col("window.start"), "value").collect()
    assert len(got) == 4 and all(r.value == 10.0 for r in got) and min(r.start for r in got) == datetime.datetime(1970, 1, 1)


def test_dataset_chains(spark, sf_dir):
    ds = Dataset.parquet(spark, f"{sf_dir}/nation.parquet")
    assert ds.filter("n_regionkey = 1").map("n_name").count_value() == 5
    assert ds.keyed("n_regionkey", "n_name").swap().df.columns == ["key", "value"]
    assert ds.map_partitions_with_index(lambda i, frames: (f.assign(p=i)[["p"]] for f in frames), "p long").df.distinct().count() == 1
    assert ds.sample_n(3).count_value() == 3 and ds.sample(1.0).count_value() == 25
    assert ds.sample_with(lambda frames: (f.head(1) for f in frames)).count_value() == 1
    with pytest.raises(ValueError):
        ds.map(lambda pdf: pdf)


def test_index_keeps_columns_of_its_own_names(spark):
    df = spark.createDataFrame([(7, "a", 1), (8, "b", 2)], "_place long, _part string, _before int")
    got = ordering.zip_with_index(df, "_place")
    assert got.columns == ["_place", "_part", "_before", "index"] and values(got) == [(7, "a", 1, 0), (8, "b", 2, 1)]
    with pytest.raises(ValueError):
        ordering.zip_with_index(spark.createDataFrame([(1,)], "index int"))
    ranked = ordering.top_per_key(spark.createDataFrame([(1, 5), (1, 6)], "_rank int, v int"), 1, "_rank", F.desc("v"))
    assert values(ranked) == [(1, 6)]


def test_rows_are_reduced_by_python(spark):
    df = spark.createDataFrame([("a", 1, None), ("b", 5, 2.0), ("a", 7, 1.5)] * 20, "k string, n long, x double").repartition(4)
    join = lambda a, b: {"k": min(a["k"], b["k"]), "n": a["n"] + b["n"], "x": max(a["x"] or 0.0, b["x"] or 0.0)}
    assert values(Dataset(df).reduce_python(join).df) == [("a", 260, 2.0)]
    assert values(Dataset(df).group_reduce_python(join, "k").df) == [("a", 160, 1.5), ("b", 100, 2.0)]
    assert Dataset(df.limit(0)).reduce_python(join).count_value() == 0 and Dataset(df.limit(0)).group_reduce_python(join, "k").count_value() == 0
    many = spark.createDataFrame([(str(i % 50), i) for i in range(500)], "key string, value long")
    from weftline.functions.reducers import reduce_python

    assert values(reduce_python(many, "key", "value", max, most_held=5)) == sorted((str(i), 450 + i) for i in range(50))


def test_partitioners(spark):
    df = spark.range(100)
    placed = partitioning.by_number(df, 4, F.col("id") - 50).withColumn("p", F.spark_partition_id())
    assert all(r.p == (r.id - 50) % 4 for r in placed.collect())
    assert values(partitioning.partition(df, partitioning.KEEP)) == values(df)
    assert partitioning.range_partitioner(3, "id", sort=True)(df).rdd.getNumPartitions() == 3
    assert partitioning.at_random(df, 3).count() == 100 and partitioning.with_partitions(df.repartition(9), 2).rdd.getNumPartitions() == 2
    assert partitioning.number_partitioner(3, F.lit(None))(df).count() == 100


def test_lines_with_half_numbers_are_left_out(spark):
    lines = spark.createDataFrame([("a b c 12x34 5 d e f g h i",), ("a b c 12.5 5 d e f g h i",)], "l string")
    assert [r[0] for r in lines.select(parsing.numeric_fields(F.col("l"), drop=3, drop_right=6)).collect()] == [None, [12.5, 5.0]]


def test_wide_rows_are_exploded(spark, monkeypatch):
    points = spark.createDataFrame([([1.0, float(i)], 3.0 + 2.0 * i) for i in range(-5, 6)], "x array<double>, y double")
    narrow, centres = values(iterative.gradient(points, [0.5, 1], iterative.squared_error)), values(iterative.centre_step(points, [[0, 0], [1, 4]]))
    monkeypatch.setattr(iterative, "WIDEST", 1)
    assert values(iterative.gradient(points, [0.5, 1], iterative.squared_error)) == narrow and values(iterative.centre_step(points, [[0, 0], [1, 4]])) == centres


def test_columns_by_functions(spark):
    m = spark.createDataFrame([(1, [3.0, 4.0]), (0, [1.0, 2.0])], "idx long, row array<double>")
    assert values(linalg.map_each_column(m, lambda c: [c[0]] * len(c))) == [(0, [1.0, 2.0]), (1, [1.0, 2.0])]
    assert values(linalg.reduce_rows(m, width=2)) == values(linalg.reduce_rows(m))


def test_a_database_table_round_trips(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path / 'db'};create=true"
    driver = "org.apache.derby.jdbc.EmbeddedDriver"
    df = spark.createDataFrame([(i, f"n{i}") for i in range(40)], "id int, name string")
    try:
        spark._jvm.java.lang.Class.forName(driver)
    except Exception:
        pytest.skip("no embedded database on the class path")
    readers.write_jdbc(df, url, "t", driver=driver)
    got = readers.jdbc(spark, url, "t", partition_column="id", lower=0, upper=40, partitions=4, driver=driver)
    assert got.rdd.getNumPartitions() == 4 and sorted(tuple(r) for r in got.collect()) == values(df)


def test_series_queries_by_code(spark):
    df = spark.createDataFrame([("m", "cpu", "n1", str(i), "s", 1000 * i) for i in range(10)], metrics.POINT_DDL)
    assert metrics.query(df, "sum", prop="cpu", key="n1").first()[0] == 45.0
    assert metrics.query(df, "nothing") is None and metrics.query(df, "sum", wrong=1) is None
    c = metrics.Counters()
    c.add_all(spark.createDataFrame([("p", "k", 2), ("p", "k", 3)], "prop string, key string, n long"))
    assert c.get("p", "k") == 5


def test_versions_and_tasks(spark, sf_dir):
    runs = provenance.Runs(spark, "app", "2")
    run, _ = runs.run(readers.parquet(spark, f"{sf_dir}/nation.parquet").repartition(3))
    tasks = runs.tasks(run).collect()
    assert len(tasks) >= 3 and all(t.executor and t.core >= 0 and t.inputs and t.ended >= t.started for t in tasks)
    assert tuple(runs.versions().first()) == ("app", "2", 1, 1) and runs.instances("3").count() == 0 and runs.applications().first()["versions"] == 1
    assert provenance.merged_runs(runs, provenance.Runs(spark, "app", "3")).count() == 1


def test_actions_on_rows(spark):
    seen = spark.sparkContext.accumulator(0)
    Dataset(spark.range(10)).foreach(lambda rows: seen.add(sum(r.id for r in rows)))
    assert seen.value == 45
    nested = Dataset(spark.createDataFrame([([[1, 2], [3]],), ([[]],)], "a array<array<int>>"))
    assert values(nested.flatten("a").df) == [(1,), (2,), (3,)]


@pytest.mark.parametrize("how", ["inner", "left_outer"])
def test_a_join_of_few_keys_is_dealt_over_all_cores(spark, how):
    side = lambda n, keys: spark.range(n).coalesce(1).select((F.col("id") % keys).alias("key"), F.col("id").alias("value"))
    for m, n in ((4000, 2000), (2000, 4000)):
        out = joins.join_by_key(side(m, 6), side(n, 5), how)
        held = out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("right_value").alias("pairs"), F.sum("left_value").alias("l"), F.sum("right_value").alias("r")).collect()
        pairs = [(i, j) for i in range(m) if i % 6 < 5 for j in range(i % 6, n, 5)]
        assert sum(h.pairs for h in held) == len(pairs)
        alone = sum(i for i in range(m) if i % 6 == 5) if how == "left_outer" else 0
        assert (sum(h.l for h in held), sum(h.r or 0 for h in held)) == (sum(i for i, _ in pairs) + alone, sum(j for _, j in pairs))
        assert max(h.pairs for h in held) <= len(pairs) / spark.sparkContext.defaultParallelism
