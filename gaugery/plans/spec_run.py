"""Runs from a specification: a model, an engine, and suites with their tables; JSON, or YAML where that is installed."""

from __future__ import annotations

import contextlib
import json
import platform
from importlib import metadata
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from gaugery.operators.selection import limit_rows, parse_order
from gaugery.plans.run import Result, Scorer, evaluate, hash_scorer, recorded
from gaugery.plans.suites import get
from gaugery.sources.readers import Source, read_rows
from gaugery.sources.sinks import result_document

ENGINES = ("hash", "recorded")


def load(text_or_path: str) -> dict:
    """A specification from a file or from its text; it must name an engine, a model and tests."""
    text = text_or_path
    if "\n" not in text and len(text) < 4096 and Path(text).is_file():
        text = Path(text).read_text(encoding="utf-8")
    try:
        spec = json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError as e:
            raise ValueError("a specification that isn't JSON needs PyYAML") from e
        spec = yaml.safe_load(text)
    if not isinstance(spec, dict):
        raise TypeError("a specification is an object")
    for key in ("engine", "model", "tests"):
        if key not in spec:
            raise ValueError(f"the specification has no {key}")
    return spec


def _options(given: dict, known: set[str], what: str) -> None:
    if odd := set(given) - known:
        raise ValueError(f"{what} has no option {', '.join(sorted(odd))}")


def scorer_of(spark: SparkSession, engine: dict) -> Scorer:
    _options(engine, {"type", "outputs"}, "the engine")
    if engine.get("type") not in ENGINES:
        raise KeyError(f"no such engine: {engine.get('type')}")
    return hash_scorer if engine["type"] == "hash" else recorded(spark.read.parquet(engine["outputs"]))


def run(spark: SparkSession, spec: dict) -> tuple[list[Result], dict]:
    """Results of all tests, and the document with their metrics."""
    results, scorer = [], scorer_of(spark, spec["engine"])
    for test in spec["tests"]:
        _options(test, {"type", "path", "format", "schema", "max_rows", "order", "pool", "shots", "group"}, "a test")
        suite = get(test["type"])
        parse_order(test.get("order"))  # before anything is read
        rows = read_rows(spark, Source(test["path"], test.get("format", "parquet"), test.get("schema")))
        pool = read_rows(spark, Source(test["pool"])) if "pool" in test else None
        rows = limit_rows(rows, test.get("max_rows"))
        results.append(evaluate(rows, suite, scorer, pool=pool, shots=test.get("shots", 5), group=test.get("group"), order=test.get("order")))
    metrics: DataFrame | None = None
    for r in results:
        metrics = r.metrics if metrics is None else metrics.unionByName(r.metrics)
    head = {"model": spec["model"], "engine": spec["engine"], "versions": versions(spark)}
    return results, result_document(metrics, head) if metrics is not None else {**head, "tests": []}


def as_python(spec: dict) -> str:
    """A script that runs the same specification."""
    return "\n".join(
        [
            "from pyspark.sql import SparkSession",
            "",
            "from gaugery.plans import spec_run",
            "",
            "spark = SparkSession.builder.getOrCreate()",
            f"results, document = spec_run.run(spark, {spec!r})",
            "print(document)",
            "",
        ]
    )


def versions(spark: SparkSession) -> dict[str, str]:
    """Of Spark, Java, Scala, Python and the libraries that the engine runs on."""
    java = spark.sparkContext._jvm.java.lang.System.getProperty("java.version")
    found = {"spark": spark.version, "java": java, "python": platform.python_version()}
    for name in ("pyarrow", "pandas", "numpy"):
        with contextlib.suppress(metadata.PackageNotFoundError):
            found[name] = metadata.version(name)
    return found
