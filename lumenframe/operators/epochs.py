"""Exact epochs: every row takes part in one minibatch of every epoch.

Rows are numbered and written once. An epoch deals them to tasks by a hash of number, epoch and seed and sorts them by
another hash of the same within a task (a sort that spills), from where a task takes its minibatches one after the
other: none is sampled, kept or dropped but those with a missing value. The parameters of all tasks are averaged at the end
of an epoch, weighted by rows, and written to the folder of the training, so that a training that was stopped goes on
with the next epoch. Every draw comes from the seed, the epoch and the task, so a lost executor repeats its tasks with
the same result.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import registry
from lumenframe.operators.system import System
from lumenframe.operators.train import Schedule, corrupt, flatten, unflatten
from lumenframe.storage import discard, materialize


def _pass(batches: Iterator[pa.RecordBatch], system: System, n_inputs: int, schedule: Schedule, epoch: int) -> Iterator[pa.RecordBatch]:
    """One pass of a task over its rows, which come in the order of the epoch."""
    rng = np.random.default_rng((schedule.seed, epoch, TaskContext.get().partitionId()))
    trainer = registry.get("trainer", schedule.algorithm)(schedule, rng)
    waiting, seen = np.zeros((0, 0)), 0

    def step(part: np.ndarray) -> None:
        nonlocal system
        for _ in range(schedule.interval):
            system = trainer.step(system, corrupt(part[:, :n_inputs], schedule.noise, rng), part[:, n_inputs:])

    for batch in batches:
        rows = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)
        seen += len(rows)
        waiting = np.vstack([waiting, rows]) if len(waiting) else rows
        while len(waiting) >= schedule.minibatch:
            step(waiting[: schedule.minibatch])
            waiting = waiting[schedule.minibatch :]
    if len(waiting):
        step(waiting)
    if seen:
        flat = flatten(system)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat * seen), pa.array(np.full(len(flat), float(seen)))], names=["k", "value", "weight"])


def _load(spark, folder: str) -> tuple[int, np.ndarray] | None:
    """The last epoch of which the parameters were written."""
    try:
        found = spark.read.text(f"{folder}/epoch=*").select(F.get_json_object("value", "$.epoch").cast("int").alias("epoch"), "value").orderBy(F.desc("epoch")).first()
    except AnalysisException:
        return None
    return (found["epoch"], np.array(json.loads(found["value"])["parameters"])) if found else None


def _save(spark, folder: str, epoch: int, flat: np.ndarray) -> None:
    spark.createDataFrame([(json.dumps({"epoch": epoch, "parameters": flat.tolist()}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/epoch={epoch}")


def fit_epochs(df: DataFrame, system: System, schedule: Schedule, epochs: int, tasks: int | None = None, folder: str | None = None, watch: Callable[[int, System], bool | None] | None = None) -> System:
    """The system after so many passes over all rows of df, which has the columns of the first and, for gradient trainers, of the last layer.

    With a folder, the state after each epoch is kept there, and a call with the same folder goes on after the last one.
    `watch` sees the parameters after each epoch and ends the training by returning True.
    """
    spark = df.sparkSession
    pair = schedule.algorithm == "contrastive"
    inputs = system.layers[0].columns
    names = inputs if pair else [*inputs, *system.layers[-1].columns]
    fine = df.select(*(F.col(f"`{c}`").cast("double").alias(f"c{k}") for k, c in enumerate(names))).where(" and ".join(f"c{k} is not null and not isnan(c{k})" for k in range(len(names))))
    rows = materialize(fine.withColumn("at", F.monotonically_increasing_id()), "training")
    parts, width, done = tasks or spark.sparkContext.defaultParallelism, len(inputs), 0
    try:
        if folder and (found := _load(spark, folder)):
            done, system = found[0], unflatten(system, found[1])
        for epoch in range(done + 1, epochs + 1):
            key = F.xxhash64("at", F.lit(epoch), F.lit(schedule.seed))
            dealt = rows.repartition(parts, F.pmod(key, F.lit(parts))).sortWithinPartitions(F.xxhash64(key), "at").select(*(f"c{k}" for k in range(len(names))))
            sums = dealt.mapInArrow(lambda it, now=system, epoch=epoch: _pass(it, now, width, schedule, epoch), "k long, value double, weight double")
            found = sums.groupBy("k").agg((F.sum("value") / F.sum("weight")).alias("v")).collect()  # one row per parameter
            if not found:
                break
            flat = np.zeros(len(found))
            for r in found:
                flat[r["k"]] = r["v"]
            system = unflatten(system, flat)
            if folder:
                _save(spark, folder, epoch, flat)
            if watch and watch(epoch, system):
                break
    finally:
        discard(rows)
    return system
