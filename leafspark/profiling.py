"""Timing of named steps on the driver, and memory of driver and executors; Spark's own metrics cover the tasks."""

from __future__ import annotations

import functools
import os
import time
from collections import defaultdict
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class PerformanceMonitor:
    def __init__(self) -> None:
        self.seconds: dict[str, list[float]] = defaultdict(list)

    @contextmanager
    def measure(self, name: str):
        began = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name].append(time.perf_counter() - began)

    def summary(self) -> dict[str, dict[str, float]]:
        return {k: {"count": len(v), "total": sum(v), "mean": sum(v) / len(v), "max": max(v)} for k, v in self.seconds.items()}


MONITOR = PerformanceMonitor()


def profiled(f):
    @functools.wraps(f)
    def run(*args, **kwargs):
        with MONITOR.measure(f.__name__):
            return f(*args, **kwargs)

    return run


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """The frame with its rows counted as it runs."""
    o = Observation(name)
    return df.observe(o, F.count(F.lit(1)).alias("rows")), o


def executor_memory(spark: SparkSession) -> dict[str, tuple[int, int]]:
    """Host and port of every block manager, the driver's too: (bytes for storage, bytes of them free)."""
    status = spark.sparkContext._jsc.sc().getExecutorMemoryStatus()
    out, it = {}, status.iterator()
    while it.hasNext():
        x = it.next()
        out[x._1()] = (int(x._2()._1()), int(x._2()._2()))
    return out


def system_memory() -> tuple[int, int]:
    """(total, available) bytes of the driver's machine."""
    page = os.sysconf("SC_PAGE_SIZE")
    return page * os.sysconf("SC_PHYS_PAGES"), page * os.sysconf("SC_AVPHYS_PAGES")


def memory_available(spark: SparkSession, need: int) -> bool:
    """Whether every executor has that many bytes of its storage free."""
    return all(free >= need for _, free in executor_memory(spark).values())


def gpus(spark: SparkSession) -> list[str]:
    """Addresses of the GPUs that the driver was given as a resource; empty where there are none."""
    held = spark.sparkContext.resources
    return list(held["gpu"].addresses) if "gpu" in held else []
