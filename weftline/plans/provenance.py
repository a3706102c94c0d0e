"""Plans, lineage, runs and traces as data."""

from __future__ import annotations

import re
import threading
import time
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PHASES = ("parsed", "analyzed", "optimized", "physical")
PLAN_DDL = "phase string, node int, parent int, depth int, name string, description string"
TASK_DDL = "run string, app string, version string, stage int, attempt int, task long, function string, executor string, host string, core int, inputs array<string>, status string, started long, ended long"
TRACE_DDL = "run string, app string, version string, stage int, name string, tasks int, failed int, status string, submitted long, completed long"


def plan_rows(df: DataFrame) -> DataFrame:
    """A row per node of the logical plans before and after optimisation and of the physical plan."""
    run = df._jdf.queryExecution()
    trees = zip(PHASES, (run.logical(), run.analyzed(), run.optimizedPlan(), run.executedPlan()), strict=True)
    rows = []
    for phase, tree in trees:
        path: list[tuple[int, int]] = []
        for i, line in enumerate(x for x in tree.toString().split("\n") if x.strip()):
            mark = re.match(r"^[ :+\-*()\d]*", line).group(0)
            depth, text = len(re.match(r"^[ :+\-]*", line).group(0)), line[len(mark) :] or line.strip()
            while path and path[-1][1] >= depth:
                path.pop()
            rows.append((phase, i, path[-1][0] if path else None, len(path), re.split(r"[\s(\[]", text, maxsplit=1)[0], text))
            path.append((i, depth))
    return df.sparkSession.createDataFrame(rows, PLAN_DDL)


def logical_plan(df: DataFrame, *, optimized: bool = False) -> DataFrame:
    return plan_rows(df).filter(F.col("phase") == ("optimized" if optimized else "analyzed"))


def physical_plan(df: DataFrame) -> DataFrame:
    return plan_rows(df).filter(F.col("phase") == "physical")


def plan_links(plan: DataFrame) -> DataFrame:
    """(source, target) edges of lineage: from each node to the one that reads it."""
    return plan.filter("parent is not null").select("phase", F.col("node").alias("source"), F.col("parent").alias("target"))


def plan_counts(df: DataFrame, pattern: str) -> int:
    """How many nodes of the physical plan have a name that matches."""
    return physical_plan(df).filter(F.col("name").rlike(pattern)).count()


class Runs:
    """A registry of runs of an application: what ran, when, and the stages it took."""

    def __init__(self, spark: SparkSession, app: str, version: str = "0"):
        self.spark, self.app, self.version = spark, app, version
        self._lock, self._rows, self._plans = threading.Lock(), [], {}

    def run(self, df: DataFrame, action: Callable[[DataFrame], Any] = DataFrame.count) -> tuple[str, Any]:
        """(run id, result of ``action``)."""
        run, sc = f"{self.app}-{uuid.uuid4().hex[:12]}", self.spark.sparkContext
        sc.setJobGroup(run, run)
        began, status = int(time.time() * 1000), "FAILED"
        try:
            out = action(df)
            status = "SUCCEEDED"
            return run, out
        finally:
            sc.setLocalProperty("spark.jobGroup.id", None)
            with self._lock:
                self._rows.append((run, self.app, self.version, status, began, int(time.time() * 1000)))
                self._plans[run] = df

    def runs(self) -> DataFrame:
        return self.spark.createDataFrame(self._rows, "run string, app string, version string, status string, started long, ended long")

    def applications(self) -> DataFrame:
        """(app, versions, runs) of this registry."""
        return self.runs().groupBy("app").agg(F.countDistinct("version").alias("versions"), F.count("*").alias("runs"))

    def versions(self) -> DataFrame:
        """(app, version, runs, succeeded)."""
        return self.runs().groupBy("app", "version").agg(F.count("*").alias("runs"), F.count(F.when(F.col("status") == "SUCCEEDED", 1)).alias("succeeded"))

    def instances(self, version: str | None = None) -> DataFrame:
        """The runs of a version, or of all."""
        return self.runs() if version is None else self.runs().filter(F.col("version") == version)

    def plans(self, run: str) -> DataFrame:
        return plan_rows(self._plans[run]).withColumn("run", F.lit(run))

    def trace(self, run: str) -> DataFrame:
        """A row per stage of a run, as far as Spark still remembers it."""
        store = self.spark.sparkContext._jsc.sc().statusStore()
        tracker, rows = self.spark.sparkContext.statusTracker(), []
        millis = lambda when: when.get().getTime() if when.isDefined() else -1
        for job in tracker.getJobIdsForGroup(run):
            info = tracker.getJobInfo(job)
            for stage in info.stageIds if info else ():
                try:
                    s = store.lastStageAttempt(stage)
                except Exception:  # forgotten by the store
                    continue
                rows.append((run, self.app, self.version, stage, s.name(), s.numTasks(), s.numFailedTasks(), s.status().toString(), millis(s.submissionTime()), millis(s.completionTime())))
        return self.spark.createDataFrame(rows, TRACE_DDL)


    def tasks(self, run: str, most: int = 100_000) -> DataFrame:
        """A row per task of a run, as far as Spark still remembers it, ``most`` per stage at most.

        ``core`` is the first place of its executor that is free when the task starts; ``inputs``
        are the files that the run reads; a task that has not ended ends at -1.
        """
        store = self.spark.sparkContext._jsc.sc().statusStore()
        tracker, rows, inputs = self.spark.sparkContext.statusTracker(), [], list(self._plans[run].inputFiles())
        for job in tracker.getJobIdsForGroup(run):
            info = tracker.getJobInfo(job)
            for stage in info.stageIds if info else ():
                try:
                    s = store.lastStageAttempt(stage)
                    tasks = store.taskList(stage, s.attemptId(), most)
                except Exception:  # forgotten by the store
                    continue
                for i in range(tasks.size()):
                    t = tasks.apply(i)
                    began = t.launchTime().getTime()
                    ended = began + int(str(t.duration().get())) if t.duration().isDefined() else -1
                    rows.append([run, self.app, self.version, stage, t.attempt(), t.taskId(), s.name(), t.executorId(), t.host(), 0, inputs, t.status(), began, ended])
        free: dict[str, list[int]] = {}  # executor: when each of its cores is free
        for r in sorted(rows, key=lambda r: r[12]):
            cores = free.setdefault(r[7], [])
            core = next((k for k, until in enumerate(cores) if until <= r[12]), len(cores))
            cores[core : core + 1] = [r[13] if r[13] >= 0 else 1 << 62]
            r[9] = core
        return self.spark.createDataFrame(rows, TASK_DDL)


def merged_runs(*registries: Runs) -> DataFrame:
    """The runs of several applications and versions."""
    out = registries[0].runs()
    for r in registries[1:]:
        out = out.unionByName(r.runs())
    return out


def lanes(trace: DataFrame, lane: Column | str, start: Column | str, end: Column | str, now: Column | int) -> DataFrame:
    """(lane, tasks, first, last, busy): unfinished tasks (end before start) count as running until ``now``."""
    now = F.lit(now) if isinstance(now, int) else now
    begin, stop = F.col(start) if isinstance(start, str) else start, F.col(end) if isinstance(end, str) else end
    stop = F.when(stop < begin, now).otherwise(stop)
    return trace.groupBy((F.col(lane) if isinstance(lane, str) else lane).alias("lane")).agg(F.count("*").alias("tasks"), F.min(begin).alias("first"), F.max(stop).alias("last"), F.sum(stop - begin).alias("busy"))


def task_links(trace: DataFrame, task: str = "task", inputs: str = "inputs") -> DataFrame:
    """(source, target): from each input of a task to the task."""
    return trace.select(F.explode(inputs).alias("source"), F.col(task).alias("target"))


def version_parts(version: Column) -> Column:
    """A dotted version as an array of numbers, to compare by; other signs count as dots."""
    return F.transform(F.filter(F.split(version, r"[^0-9]+"), lambda p: p != ""), lambda p: p.cast("int"))


def since_version(dependencies: DataFrame, version: str, column: str = "version") -> DataFrame:
    """The rows whose version is ``version`` or later."""
    return dependencies.filter(version_parts(F.col(column)) >= version_parts(F.lit(version)))


def cluster_nodes(spark: SparkSession) -> DataFrame:
    """(node, max_memory, free_memory) of the driver and each executor."""
    status = spark.sparkContext._jsc.sc().getExecutorMemoryStatus()
    rows, it = [], status.iterator()
    while it.hasNext():
        pair = it.next()
        rows.append((pair._1(), int(pair._2()._1()), int(pair._2()._2())))
    return spark.createDataFrame(rows, "node string, max_memory long, free_memory long")
