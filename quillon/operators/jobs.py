"""Running work in the background: exclusive kinds in their tab, filters that replace one another, progress by job."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Hashable
from dataclasses import dataclass, field

from pyspark import InheritableThread
from pyspark.sql import SparkSession

KINDS = ("index", "filter", "sort", "profile", "export", "dupes")
ALONE = ("sort", "profile", "export", "dupes")


@dataclass
class Job:
    kind: str
    tag: str
    tab: Hashable = None
    parent: Hashable = None  # what a filter filters
    state: str = "queued"  # running, done, failed, cancelled
    result: object = None
    error: BaseException | None = None
    done: threading.Event = field(default_factory=threading.Event)


class Jobs:
    """Spark runs each job's stages under a job group of its own. A running stage can't be paused."""

    def __init__(self, spark: SparkSession):
        self.spark, self.jobs = spark, []

    def submit(self, kind: str, work: Callable[[], object], tab: Hashable = None, parent: Hashable = None) -> Job:
        """A second job of a kind that runs alone is refused in its tab; a new filter cancels those on the same parent."""
        if kind not in KINDS:
            raise ValueError(f"no job is of kind {kind}")
        running = [j for j in self.jobs if j.kind == kind and j.tab == tab and not j.done.is_set()]
        if running and kind in ALONE:
            raise RuntimeError(f"this tab already has a {kind} under way")
        for j in running:
            if kind == "filter" and j.parent == parent:
                self.cancel(j)
        job = Job(kind, f"quillon-{uuid.uuid4().hex}", tab, parent)

        def run() -> None:
            self.spark.sparkContext.setJobGroup(job.tag, job.kind, interruptOnCancel=True)
            try:
                if job.state == "queued":
                    job.state = "running"
                    job.result = work()
                job.state = "done" if job.state == "running" else job.state
            except BaseException as e:
                job.error = e
                job.state = "failed" if job.state == "running" else job.state
            finally:
                job.done.set()

        self.jobs.append(job)
        InheritableThread(target=run, daemon=True).start()
        return job

    def cancel(self, job: Job) -> None:
        if not job.done.is_set():
            job.state = "cancelled"
            self.spark.sparkContext.cancelJobGroup(job.tag)

    def progress(self, job: Job) -> tuple[int, int]:
        """(tasks done, tasks) of the job's stages so far."""
        tracker = self.spark.sparkContext.statusTracker()
        jobs = (tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(job.tag))
        stages = [s for j in jobs if j for s in map(tracker.getStageInfo, j.stageIds) if s]
        return sum(s.numCompletedTasks for s in stages), sum(s.numTasks for s in stages)
