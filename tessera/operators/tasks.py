"""A graph of tasks that run only if their inputs, outputs or options changed.

Fingerprints of inputs are taken before a task runs, those of outputs after it, so that a file edited during the run counts
as changed next time. A task's state is a table of its own (role, path, stamp) in the shared folder, so states of any number
of files are compared by joins; only the answer reaches the driver.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..storage import forget, saved

EXECUTED, UP_TO_DATE, FAILED = "EXECUTED", "UP_TO_DATE", "FAILED"
_STATE = "task string, options_hash long, role string, path string, stamp string"
_FILES = "path string, stamp string, role string"


@dataclass
class Task:
    id: str
    action: Callable[[], None]
    inputs: list[str] = field(default_factory=list)
    outputs: list[str] = field(default_factory=list)
    depends_on: list[str] = field(default_factory=list)
    options: dict[str, str] = field(default_factory=dict)
    cacheable: bool = True
    #: "metadata" (time and length) or "content" (SHA-256)
    fingerprint: str = "metadata"


def fingerprints(spark: SparkSession, paths: list[str], mode: str) -> DataFrame:
    """(path, stamp) of every file at or below the paths, sorted by path; content is read only in content mode."""
    schema = "path string, stamp string"
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    there = [p for p in paths if (h := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).exists(h)]
    if not there:
        return spark.createDataFrame([], schema)
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(there)
    stamp = F.sha2("content", 256) if mode == "content" else F.concat_ws(":", F.unix_millis("modificationTime").cast("string"), F.col("length").cast("string"))
    return f.select("path", stamp.alias("stamp")).distinct().orderBy("path")


def unchanged(stored: DataFrame, now: DataFrame) -> bool:
    """The same (role, path, stamp) rows on both sides: one full outer join, null-safe."""
    n = now.select(F.col("role").alias("_r"), F.col("path").alias("_p"), F.col("stamp").alias("_s"))
    j = stored.join(n, (F.col("role") == F.col("_r")) & (F.col("path") == F.col("_p")), "full_outer")
    return j.where(~(F.col("stamp").eqNullSafe(F.col("_s"))) | F.col("path").isNull() | F.col("_p").isNull()).isEmpty()


class TaskGraph:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tasks: dict[str, Task] = {}
        #: task: (hash of its options, its files' stamps when it last ran)
        self.known: dict[str, tuple[int, DataFrame]] = {}
        self.dirty: set[str] = set()
        self.linked: dict[str, TaskGraph] = {}

    def add(self, task: Task) -> None:
        """Add a task, or replace the one of that id with its paths."""
        self.tasks[task.id] = task

    def output(self, task_id: str, index: int = 0) -> str:
        if task_id not in self.tasks:
            raise KeyError(f"no task {task_id}")
        outs = self.tasks[task_id].outputs
        if not 0 <= index < len(outs):
            raise IndexError(f"{task_id} has {len(outs)} outputs")
        return outs[index]

    def mark_dirty(self, events: DataFrame) -> set[str]:
        """Tasks one of whose paths is an event's path; they run next time whatever their state."""
        paths = [(t.id, p) for t in self.tasks.values() for p in [*t.inputs, *t.outputs]]
        if not paths:
            return set()
        hit = {r["task"] for r in self.spark.createDataFrame(paths, "task string, path string").join(events.select("path").distinct(), "path", "left_semi").select("task").distinct().collect()}
        self.dirty |= hit
        return hit

    def edges(self) -> dict[str, list[str]]:
        """Dependencies, declared or because a task reads what another writes."""
        writer = {o: t.id for t in self.tasks.values() for o in t.outputs}
        return {t.id: list(dict.fromkeys([*t.depends_on, *[writer[i] for i in t.inputs if i in writer and writer[i] != t.id]])) for t in self.tasks.values()}

    def order(self, target: str) -> list[str]:
        edges, out, path = self.edges(), [], []

        def visit(t: str):
            if t in out:
                return
            if t in path:
                raise ValueError("cycle: " + " -> ".join([*path[path.index(t) :], t]))
            if ":" in t and t.split(":", 1)[0] in self.linked:
                out.append(t)
                return
            if t not in self.tasks:
                raise KeyError(f"no task {t}")
            path.append(t)
            for d in edges[t]:
                visit(d)
            path.pop()
            out.append(t)

        visit(target)
        return out

    @staticmethod
    def _hash(options: dict[str, str]) -> int:
        digest = hashlib.sha256(json.dumps(sorted(options.items())).encode()).digest()
        return int.from_bytes(digest[:8], "big", signed=True)

    def _stamps(self, t: Task, role: str) -> DataFrame:
        paths = t.inputs if role == "input" else t.outputs
        if not paths:
            return self.spark.createDataFrame([], _FILES)
        return fingerprints(self.spark, paths, t.fingerprint).withColumn("role", F.lit(role))

    def up_to_date(self, t: Task, inputs: DataFrame | None = None) -> bool:
        if not t.cacheable or t.id in self.dirty or t.id not in self.known:
            return False
        options, stored = self.known[t.id]
        if options != self._hash(t.options):
            return False
        outs = self._stamps(t, "output")
        if t.outputs and outs.isEmpty():
            return False
        return unchanged(stored, (inputs if inputs is not None else self._stamps(t, "input")).unionByName(outs))

    def run(self, target: str) -> DataFrame:
        """Run target and what it needs. (ordinal, task, status, started_ms, finished_ms, message) in order of running."""
        status: dict[str, tuple] = {}
        edges = self.edges()
        for k, name in enumerate(self.order(target)):
            began = int(time.time() * 1000)
            if name not in self.tasks:  # <graph>:<task> of another graph
                graph, other = name.split(":", 1)
                last = self.linked[graph].run(other).orderBy(F.col("ordinal").desc()).first()
                status[name] = (k, name, last["status"], began, int(time.time() * 1000), last["message"])
                continue
            t = self.tasks[name]
            bad = [d for d in edges[name] if status[d][2] == FAILED]
            result, message = FAILED, f"dependency failed: {bad[0]}" if bad else None
            if not bad:
                before = saved(self._stamps(t, "input"), "stamps")  # as they are now, whatever the task does to them
                if self.up_to_date(t, before):
                    result = UP_TO_DATE
                else:
                    try:
                        t.action()
                        self._remember(t, before)
                        self.dirty.discard(name)
                        result = EXECUTED
                    except Exception as e:
                        message = f"{type(e).__name__}: {e}"
                forget(before)
            status[name] = (k, name, result, began, int(time.time() * 1000), message)
        return self.spark.createDataFrame(list(status.values()), "ordinal int, task string, status string, started_ms long, finished_ms long, message string")

    def _remember(self, t: Task, inputs: DataFrame) -> None:
        old = self.known.get(t.id)
        self.known[t.id] = self._hash(t.options), saved(inputs.unionByName(self._stamps(t, "output")), "stamps")
        if old is not None:
            forget(old[1])

    def state(self) -> DataFrame:
        """All states as rows; each task has one of role "self", also those without files."""
        out = self.spark.createDataFrame([(t, h, "self", "", "") for t, (h, _) in self.known.items()], _STATE)
        for t, (h, files) in self.known.items():
            out = out.unionByName(files.select(F.lit(t).alias("task"), F.lit(h).cast("long").alias("options_hash"), "role", "path", "stamp"))
        return out

    def save_state(self, path: str) -> None:
        self.state().write.mode("overwrite").partitionBy("task").parquet(path)

    def load_state(self, path: str) -> None:
        s = self.spark.read.schema("options_hash long, role string, path string, stamp string, task string").parquet(path)
        # One row a task reaches the driver; their files' stamps are read where they are needed.
        for r in s.where("role = 'self'").select("task", "options_hash").collect():
            self.known[r["task"]] = r["options_hash"], s.where((F.col("task") == r["task"]) & (F.col("role") != "self")).select("path", "stamp", "role")
