"""python -m gaugery [run] SPEC [--out FILE], python -m gaugery emit SPEC, python -m gaugery suites"""

from __future__ import annotations

import sys

from gaugery.plans import spec_run
from gaugery.plans.suites import SUITES
from gaugery.sources.sinks import render, write_json


def main(args: list[str]) -> int:
    if not args or args[0] in ("-h", "--help"):
        print(__doc__)
        return 0 if args else 2
    command, rest = (args[0], args[1:]) if args[0] in ("run", "emit", "suites") else ("run", args)
    if command == "suites":
        print(render([{"suite": s.name, "kind": s.kind, "dataset": s.dataset, "split": s.split, "prompt": "yes" if s.prompt is not None else "by caller"} for s in SUITES.values()]))
        return 0
    out = rest[rest.index("--out") + 1] if "--out" in rest else None
    spec = spec_run.load(rest[0])
    if command == "emit":
        print(spec_run.as_python(spec))
        return 0
    from pyspark.sql import SparkSession

    _, document = spec_run.run(SparkSession.builder.appName("gaugery").getOrCreate(), spec)
    print(render([{"suite": t["name"], "metric": k, "value": v} for t in document["tests"] for k, v in t["metrics"].items()]), file=sys.stderr)
    write_json(document, out)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
