"""Stages in sequence, each written before the next; a failed stage does not stop the others."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def run(spark: SparkSession, stages: list[tuple[str, Callable[[], object]]]) -> DataFrame:
    """One row for each stage: (stage, ok, seconds, error)."""
    rows = []
    for name, stage in stages:
        began, error = time.monotonic(), None
        try:
            stage()
        except Exception as e:
            error = f"{type(e).__name__}: {e}"[:500]
        rows.append((name, error is None, time.monotonic() - began, error))
    return spark.createDataFrame(rows, "stage string, ok boolean, seconds double, error string")


def summary(rows: DataFrame) -> str:
    """A line for each stage, and whether all went well."""
    done = rows.collect()
    lines = [f"{'ok' if r.ok else 'failed':6} {r.stage} ({r.seconds:.1f} s){'' if r.ok else ': ' + r.error}" for r in done]
    return "\n".join([*lines, "all stages done" if all(r.ok for r in done) else "done with errors"])
