"""Command line: `python -m assayer list | info | eval`."""

from __future__ import annotations

import argparse
import csv
import functools
import importlib
import json
import sys
import time
from collections.abc import Callable, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.cache import CacheTable
from .plans import registry, run
from .sources import datasets as D
from .sources import tables as S

KINDS = {"metrics": registry.metrics, "processors": registry.processors}


def loaded(name: str) -> Callable:
    """The object behind `module:attribute`."""
    module, sep, attribute = name.partition(":")
    if not sep:
        raise ValueError(f"{name!r} is not module:attribute")
    return getattr(importlib.import_module(module), attribute)


def listed(spark: SparkSession, kind: str, task_type: str | None = None, metric: str | None = None) -> DataFrame:
    """The catalogue of a kind of component; datasets may be chosen by task and metric."""
    return D.find(D.catalogue(spark), task_type, metric) if kind == "datasets" else registry.component_rows(spark, KINDS[kind])


def printed(rows: DataFrame, format: str = "table") -> str:
    """Catalogue rows, which are few, as a table, JSON or CSV in the order of their names."""
    found = [r.asDict() for r in rows.orderBy("name").collect()]
    if format == "json":
        return json.dumps(found, indent=2, ensure_ascii=False)
    lines = [rows.columns, *([", ".join(v) if isinstance(v, list) else str(v) for v in r.values()] for r in found)]
    if format == "csv":
        import io

        sink = io.StringIO()
        csv.writer(sink, lineterminator="\n").writerows(lines)
        return sink.getvalue().rstrip("\n")
    widths = [max(len(line[i]) for line in lines) for i in range(len(rows.columns))]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(line, widths)).rstrip() for line in lines)


def jobs(spark: SparkSession, names: Sequence[str], sources: dict[str, str], dataset_args: str = "", processor_args: str = "", metric_names: Sequence[str] = (), most: int | None = None) -> dict[str, dict]:
    """Arguments of run.evaluate() for each dataset; all names and arguments are checked before anything is read."""
    given, processing = registry.parse_nested(dataset_args), registry.parse_processors(processor_args)
    arguments = {n: registry.datasets.arguments(n, given.get(n)) for n in names}
    if missing := [n for n in names if n not in sources]:
        raise ValueError(f"no source for {', '.join(missing)}")
    out = {}
    for n in names:
        d, own = D.DATASETS[n], processing.get(n, {})
        samples = d.build(D.numbered(S.read(spark, sources[n]), n), **arguments[n])
        steps = [functools.partial(registry.processors.get(p).make, **_typed(own.get(p, {}))) for p in dict.fromkeys((*d.processors, *own))]
        out[n] = {"samples": S.first(samples, most), "metrics": tuple(metric_names) or d.metrics, "extract": d.extract, "processors": steps, "task_type": d.task_type}
    return out


def _typed(given: dict[str, str]) -> dict[str, object]:
    return {k: {"true": True, "false": False}.get(v.lower(), v) for k, v in given.items()}


def _pairs(text: str) -> dict[str, str]:
    return {k.strip(): v.strip() for k, _, v in (p.partition("=") for p in registry.parse_list(text))}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="assayer", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    show = sub.add_parser("list", help="components of a kind")
    show.add_argument("kind", choices=("datasets", *KINDS))
    show.add_argument("--task-type")
    show.add_argument("--metric")
    show.add_argument("--format", choices=("table", "json", "csv"), default="table")
    info = sub.add_parser("info", help="one component")
    info.add_argument("kind", choices=("datasets", *KINDS))
    info.add_argument("name")
    own = sub.add_parser("eval", help="datasets to results")
    own.add_argument("--model", required=True, help="module:function that makes a predictor")
    own.add_argument("--judge", help="module:function that makes the judge's predictor")
    own.add_argument("--datasets", required=True, help="name,name")
    own.add_argument("--sources", required=True, help="name=path,name=path")
    own.add_argument("--dataset-args", default="", help="name:key=value,key=value;name:...")
    own.add_argument("--processor-args", default="", help="dataset.processor:key=value;...")
    own.add_argument("--metrics", default="", help="instead of the datasets' own")
    own.add_argument("--max-samples", type=int)
    own.add_argument("--cache", help="folder of the cache table")
    own.add_argument("--output", help="report file")
    own.add_argument("--format", choices=("json", "yaml", "csv"), default="json")
    own.add_argument("--dry-run", action="store_true")
    return top


def main(argv: Sequence[str] | None = None) -> int:
    asked = parser().parse_args(argv)
    spark = SparkSession.builder.appName("assayer").getOrCreate()
    if asked.command == "list":
        print(printed(listed(spark, asked.kind, asked.task_type, asked.metric), asked.format))
        return 0
    if asked.command == "info":
        found = listed(spark, asked.kind).where(F.col("name") == asked.name)
        if found.isEmpty():
            print(f"there is no {asked.name} among the {asked.kind}", file=sys.stderr)
            return 1
        print(printed(found, "json"))
        return 0
    began = time.time()
    work = jobs(spark, registry.parse_list(asked.datasets), _pairs(asked.sources), asked.dataset_args, asked.processor_args, registry.parse_list(asked.metrics), asked.max_samples)
    shared = {"judge": loaded(asked.judge)} if asked.judge else {}
    table = CacheTable(spark, asked.cache) if asked.cache else None
    results = run.evaluate_all(work, loaded(asked.model), table=table, dry_run=asked.dry_run, model_config={"model": asked.model}, **shared)
    tree = S.nested(results, {"datasets": len(work), "duration": S.format_duration(time.time() - began)})
    print(S.shown(tree))
    if asked.output:
        S.write_report(tree, str(Path(asked.output)), asked.format)
    return 0


if __name__ == "__main__":
    sys.exit(main())
