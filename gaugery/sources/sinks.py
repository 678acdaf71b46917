"""Results out: tables, one JSON document, console."""

from __future__ import annotations

import json
import sys

from pyspark.sql import DataFrame


def write_samples(samples: DataFrame, path: str) -> None:
    """The fact table of samples, partitioned by suite."""
    samples.write.mode("overwrite").partitionBy("suite").parquet(path)


def result_document(metrics: DataFrame, run: dict) -> dict:
    """The run with its tests and their metrics; only metrics, a few rows per suite, come to the driver."""
    tests: dict[str, dict] = {}
    for r in metrics.orderBy("suite", "metric").collect():
        tests.setdefault(r["suite"], {"name": r["suite"], "metrics": {}})["metrics"][r["metric"]] = r["value"]
    return {**run, "tests": list(tests.values())}


def write_json(document: dict, path: str | None = None) -> None:
    text = json.dumps(document, indent=2, ensure_ascii=False)
    if path is None:
        sys.stdout.write(text + "\n")
    else:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text + "\n")


def render(rows: list[dict]) -> str:
    """A plain table of dicts with the same keys."""
    if not rows:
        return "(no rows)"
    names = list(rows[0])
    shown = [names] + [["" if r[n] is None else f"{r[n]:.4f}" if isinstance(r[n], float) else str(r[n]) for n in names] for r in rows]
    widths = [max(len(x[i]) for x in shown) for i in range(len(names))]
    line = lambda x: "  ".join(v.ljust(w) for v, w in zip(x, widths, strict=True)).rstrip()
    return "\n".join([line(shown[0]), line(["-" * w for w in widths]), *map(line, shown[1:])])
