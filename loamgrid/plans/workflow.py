"""Named steps that form a pipeline, run logs and schedules."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

Step = Callable[..., DataFrame]
_SECRET = re.compile(r"pass(word)?|secret|token|api_?key|credential|authorization", re.I)


class Workflow:
    """Steps by name, each a function of earlier results and parameters. References: ``$in.name`` and ``$step.name``.

    ``check`` refuses unknown functions and references to steps that come later; ``run`` gives all results, lazily.
    """

    def __init__(self, steps: list[Mapping], registry: Mapping[str, Step]):
        self.steps, self.registry = steps, registry

    def check(self, inputs: Mapping[str, object]) -> None:
        known: set[str] = set()
        for s in self.steps:
            if s["use"] not in self.registry:
                raise ValueError(f"unknown step {s['use']!r}")
            for v in s.get("with", {}).values():
                if isinstance(v, str) and v.startswith("$in.") and v[4:] not in inputs:
                    raise ValueError(f"no input {v[4:]!r}")
                if isinstance(v, str) and v.startswith("$step.") and v[6:] not in known:
                    raise ValueError(f"step {v[6:]!r} has no result yet")
            known.add(s["name"])

    def run(self, inputs: Mapping[str, object]) -> dict[str, DataFrame]:
        self.check(inputs)
        done: dict[str, DataFrame] = {}
        for s in self.steps:
            args = {k: inputs[v[4:]] if isinstance(v, str) and v.startswith("$in.") else done[v[6:]] if isinstance(v, str) and v.startswith("$step.") else v for k, v in s.get("with", {}).items()}
            done[s["name"]] = self.registry[s["use"]](**args)
        return done


def safe_request(value, depth: int = 0):
    """A request for the log: secrets hidden, long lists and texts shortened, geometries as box and vertex count."""
    if isinstance(value, Mapping):
        if "coordinates" in value and "type" in value:
            pts: list = []
            todo = [value["coordinates"]]
            while todo:
                c = todo.pop()
                pts.append(c) if c and isinstance(c[0], (int, float)) else todo.extend(c)
            xs, ys = [p[0] for p in pts], [p[1] for p in pts]
            return {"type": value["type"], "vertices": len(pts), "bbox": [min(xs), min(ys), max(xs), max(ys)] if pts else None}
        return {k: "***" if _SECRET.search(str(k)) else safe_request(v, depth + 1) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [safe_request(v, depth + 1) for v in value[:30]] + ([f"... {len(value) - 30} more"] if len(value) > 30 else [])
    return value[:400] + "..." if isinstance(value, str) and len(value) > 400 else value


def log_run(spark: SparkSession, path: str, run_id: str, status: str, request: Mapping, started: datetime, finished: datetime) -> None:
    """Appends one event to a JSON log."""
    row = [(run_id, status, json.dumps(safe_request(request)), started, finished)]
    spark.createDataFrame(row, "id string, status string, request string, started timestamp, finished timestamp").coalesce(1).write.mode("append").json(path)


def latest_runs(log: DataFrame) -> DataFrame:
    """The last event of each run."""
    w = Window.partitionBy("id").orderBy(F.desc("finished"))
    return log.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def next_run(schedule: Mapping, after: datetime) -> datetime:
    """The next start: every N hours from its start, daily at a time, or weekly on a day (0 Monday)."""
    if "every_hours" in schedule:
        start = schedule.get("start", datetime(after.year, after.month, after.day))
        step = timedelta(hours=schedule["every_hours"])
        return start + step * (max(0, (after - start) // step) + 1)
    hour, minute = map(int, schedule.get("at", "00:00").split(":"))
    at = after.replace(hour=hour, minute=minute, second=0, microsecond=0)
    if "weekday" in schedule:
        at += timedelta(days=(schedule["weekday"] - at.weekday()) % 7)
        return at if at > after else at + timedelta(days=7)
    return at if at > after else at + timedelta(days=1)


def due(schedule: Mapping, last: datetime | None, now: datetime) -> bool:
    """Whether a run is due; missed runs are caught up once."""
    return last is None or next_run(schedule, last) <= now


def exceeds(value: float | None, op: str, limit: float) -> bool:
    """An alert's condition; no value never alerts."""
    return value is not None and {">": value > limit, ">=": value >= limit, "<": value < limit, "<=": value <= limit, "==": value == limit}[op]


def run_script(df: DataFrame, function, schema: str | None = None) -> DataFrame:
    """A user's pandas function over Arrow batches: ``function(frame) -> frame`` with a declared schema (default: that of df)."""
    return df.mapInPandas(lambda batches: (function(b) for b in batches), schema or df.schema)
