"""Writing results: tables, JSON bundles, checkpoints, logs and replayable audits."""

from __future__ import annotations

import json
import math
import os
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, kind: str = "parquet", partitions: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    if partitions:
        writer = writer.partitionBy(*partitions)
    if kind == "csv":
        writer = writer.option("header", True)
    writer.format(kind).save(path)


def plain(value):
    """A value for JSON: not-a-number and infinities become null."""
    if isinstance(value, float) and not math.isfinite(value):
        return None
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


def bundle(config: dict, summary: DataFrame, limit: int = 1000) -> str:
    """JSON of a configuration and a summary (a report: at most ``limit`` rows)."""
    rows = [json.loads(r) for r in summary.limit(limit).toJSON().collect()]
    return json.dumps({"config": plain(config), "summary": plain(rows)}, sort_keys=True)


def markdown(title: str, summary: DataFrame, limit: int = 200) -> str:
    head = f"# {title}\n\n| " + " | ".join(summary.columns) + " |\n|" + "---|" * len(summary.columns) + "\n"
    return head + "".join("| " + " | ".join("" if x is None else str(x) for x in r) + " |\n" for r in summary.limit(limit).collect())


def save_checkpoint(path: str, payload: dict) -> None:
    """Replace the file in one step."""
    with open(f"{path}.part", "w") as f:
        json.dump(plain(payload), f, sort_keys=True)
    os.replace(f"{path}.part", path)


def load_checkpoint(path: str) -> dict | None:
    if not os.path.exists(path):
        return None
    with open(path) as f:
        return json.load(f)


class RunLog:
    """Events of a run, one JSON line each; the last ``keep`` stay in memory."""

    def __init__(self, path: str, keep: int = 1000):
        self.path, self.keep, self.recent = path, keep, []

    def event(self, level: str, text: str, **more) -> None:
        row = {"t": time.time(), "level": level, "text": text, **plain(more)}
        self.recent = [*self.recent[-self.keep + 1 :], row]
        with open(self.path, "a") as f:
            f.write(json.dumps(row) + "\n")


def fingerprint(df: DataFrame) -> DataFrame:
    """Rows and an order-free digest of a table."""
    mark = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)])
    return df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(mark), F.lit(0)).alias("xor"), F.sum(mark.cast("decimal(38,0)")).cast("string").alias("sum"))


def replay(original: DataFrame, again: DataFrame) -> DataFrame:
    """Rows that only one of two results has, marked by side."""
    a, b = original, again.select(*original.columns)
    return a.exceptAll(b).withColumn("side", F.lit("original")).unionByName(b.exceptAll(a).withColumn("side", F.lit("again")))
