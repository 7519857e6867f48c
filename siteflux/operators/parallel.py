"""Independent Spark jobs side by side, from threads of the driver."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from concurrent.futures import FIRST_EXCEPTION, CancelledError, ThreadPoolExecutor, wait
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

T = TypeVar("T")


def side_by_side(tasks: list[Callable[[], T]], threads: int = 4) -> list[T]:
    """Results of the tasks, in their order, so many at a time. Each has a fair scheduler pool of its own, where the cluster
    schedules by pools. The first failure cancels what the others still run and is raised."""
    context = SparkSession.active().sparkContext
    tag, failing = f"siteflux-{uuid.uuid4().hex}", threading.Event()

    def run(k: int, task: Callable[[], T]) -> T:
        def inside() -> T:
            if failing.is_set():
                raise CancelledError
            context.addJobTag(tag)
            context.setLocalProperty("spark.scheduler.pool", f"{tag}-{k}")
            try:
                return task()
            except BaseException:
                failing.set()
                raise

        return inheritable_thread_target(SparkSession.active())(inside)()

    with ThreadPoolExecutor(max(1, threads)) as pool:
        futures = [pool.submit(run, k, t) for k, t in enumerate(tasks)]
        done, left = wait(futures, return_when=FIRST_EXCEPTION)
        failed = [f for f in done if f.exception()]
        if failed:
            while left:  # a task may be between two jobs
                context.cancelJobsWithTag(tag)
                left = wait([f for f in left if not f.cancel()], timeout=0.5).not_done
            raise failed[0].exception()
    return [f.result() for f in futures]
