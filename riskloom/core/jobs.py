"""Independent jobs side by side: a bounded number at a time, all stopped when one fails."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import FIRST_EXCEPTION, ThreadPoolExecutor, wait
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

T = TypeVar("T")


def side_by_side(spark: SparkSession, tasks: Sequence[Callable[[], T]], at_once: int = 1, pool: str | None = None) -> list[T]:
    """What the tasks return, in their order; up to ``at_once`` of them run at a time.

    Each thread takes over the caller's job group, description and other local properties, and may be put
    into a scheduler ``pool``. When a task fails, or the caller is interrupted, those that wait are dropped,
    the jobs of those that run are cancelled by their tag, and the first failure in the order of the tasks is
    raised once all threads have ended: nothing goes on in the background. With ``at_once=1`` tasks run in
    the caller's thread.
    """
    if type(at_once) is not int or at_once < 1:
        raise ValueError("at_once must be an integer of at least 1")
    if at_once == 1 or len(tasks) < 2:
        return [task() for task in tasks]
    context, tag, stopped = spark.sparkContext, f"side-by-side-{uuid.uuid4().hex}", []

    def run(task: Callable[[], T]) -> T:
        if stopped:
            raise RuntimeError("not started, because another task failed")
        context.addJobTag(tag)
        if pool is not None:
            context.setLocalProperty("spark.scheduler.pool", pool)
        return task()

    with ThreadPoolExecutor(min(at_once, len(tasks))) as threads:
        futures = [threads.submit(inheritable_thread_target(run), task) for task in tasks]
        try:
            wait(futures, return_when=FIRST_EXCEPTION)
        finally:
            first = next((f for f in futures if f.done() and f.exception()), None)
            stopped += [True]
            going = {f for f in futures if not f.cancel() and not f.done()}
            while going:  # a task may be between two jobs, so its tag is cancelled until it ends
                context.cancelJobsWithTag(tag)
                going = wait(going, timeout=0.5).not_done
    if first is not None:
        raise first.exception()
    return [f.result() for f in futures]
