"""Runs that can be watched and cancelled, by Spark's own job groups."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Progress:
    """Tasks of the stages that are known so far."""

    done: int
    total: int


class Watched:
    """`with Watched(spark) as run:` around actions; `run.progress()` and `run.cancel()` from
    any other thread. A cancelled action fails, and what it wrote isn't committed."""

    def __init__(self, spark: SparkSession, name: str = "recipe") -> None:
        self.context, self.name, self.group = spark.sparkContext, name, f"docloom-{uuid.uuid4()}"

    def __enter__(self) -> Watched:
        self.context.setJobGroup(self.group, self.name, interruptOnCancel=True)
        return self

    def __exit__(self, *_: object) -> None:
        for key in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
            self.context.setLocalProperty(key, None)

    def progress(self) -> Progress:
        tracker = self.context.statusTracker()
        jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(self.group)]
        stages = {s for j in jobs if j for s in j.stageIds}
        known = [s for s in map(tracker.getStageInfo, stages) if s]
        return Progress(sum(s.numCompletedTasks for s in known), sum(s.numTasks for s in known))

    def cancel(self) -> None:
        self.context.cancelJobGroup(self.group)


def counted(df: DataFrame, name: str = "records") -> tuple[DataFrame, Observation]:
    """`df`, and what tells how many of its records an action took once it is done."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("records")), seen
