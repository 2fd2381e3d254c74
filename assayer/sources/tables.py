"""Sources and sinks: files to sample tables, results to reports."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLE_COLUMNS = {
    "row_id": "bigint", "dataset": "string", "input": "string", "system_prompt": "string", "conversation": "array<struct<content: string, role: string>>", "reference": "string",
    "images": "array<binary>", "audio": "binary", "rubric": "array<struct<rubric_id: string, criterion: string, points: double, tags: array<string>>>", "meta": "map<string, string>",
}
RESULT_COLUMNS = ("dataset", "task_type", "metric", "key", "value", "num_samples")


def read(spark: SparkSession, path: str, format: str | None = None, schema: str | None = None, split: str | None = None, subset: str | None = None, version: str | None = None, **options) -> DataFrame:
    """A table by path; the format follows from the ending. A version is a folder; split and subset are partition filters."""
    kind = format or {".json": "json", ".jsonl": "json", ".csv": "csv", ".orc": "orc", ".txt": "text"}.get(Path(path).suffix, "parquet")
    reader = spark.read.format(kind).options(**({"header": True} if kind == "csv" else {}), **options)
    found = (reader.schema(schema) if schema else reader).load(f"{path}/{version}" if version else path)
    for name, value in (("split", split), ("subset", subset)):
        if value is not None and name in found.columns:
            found = found.where(F.col(name) == value)
    return found


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a `local[...]` master without spark.checkpoint.dir gets a folder of this machine."""
    sc = spark.sparkContext
    at = sc._jsc.sc().getCheckpointDir()
    if at.isDefined():
        return at.get()
    folder = sc.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="kept-")
    return folder


def kept(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder, read again: it is computed once, whatever executors are lost."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def read_binary(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, content) of images or sound, undecoded."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")


def read_retrieval(spark: SparkSession, corpus: str, queries: str, qrels: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Corpus (doc_id, text), queries (query_id, text) and judgements (query_id, doc_id, rel); rel is 1 where it isn't given."""
    documents = read(spark, corpus).selectExpr("concept_id as doc_id", "text")
    asked = read(spark, queries).selectExpr("term_id as query_id", "term as text")
    judged = read(spark, qrels)
    rel = F.coalesce(F.col("score").cast("int"), F.lit(1)) if "score" in judged.columns else F.lit(1)
    return documents, asked, judged.select(F.col("term_id").alias("query_id"), F.col("concept_id").alias("doc_id"), rel.alias("rel"))


def read_rules(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """Whole-word rules of a rule file; rule files are small and checked to be."""
    from ..functions.text import read_rules as parse

    rows = spark.read.text(path).limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError(f"{path} has more than 100,000 rules")
    return parse([r[0] for r in rows])


def query(spark: SparkSession, sql: str, **parameters) -> DataFrame:
    """Parameterised SQL over the session's views."""
    return spark.sql(sql, args=parameters)


def samples(df: DataFrame) -> DataFrame:
    """The frame with all sample columns in order, nulls where it hasn't got them."""
    return df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in SAMPLE_COLUMNS.items()))


def first(df: DataFrame, n: int | None, order: str = "row_id") -> DataFrame:
    """The first n rows by an explicit order; all without n."""
    return df if n is None else df.orderBy(order).limit(n)


def drawn(df: DataFrame, n: int, seed: int, key: str = "row_id") -> DataFrame:
    """n rows by a seeded hash: the same draw on every run and cluster."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


# Results: (dataset, task_type, metric, key, value, num_samples)


def nested(results: DataFrame, summary: Mapping[str, object] | None = None) -> dict:
    """The report's tree; results are a few rows per metric."""
    out: dict = {}
    for r in results.orderBy("dataset", "metric", "key").collect():
        own = out.setdefault(r["dataset"], {"metrics": {}, "task_type": r["task_type"], "status": "completed"})
        own["metrics"].setdefault(r["metric"], {"score": {}, "num_samples": r["num_samples"]})["score"][r["key"]] = r["value"]
    return out | ({"_summary": dict(summary)} if summary else {})


def flat(tree: Mapping[str, Mapping]) -> list[dict]:
    """A row for each dataset and metric; keys that begin with an underscore are left out."""
    return [{"dataset": d, "metric": m, "task_type": own.get("task_type"), **{k: v for k, v in entry.items() if k != "score"}, **({"score": entry["score"]} if not isinstance(entry.get("score"), Mapping) else entry["score"])} for d, own in tree.items() if not d.startswith("_") for m, entry in own.get("metrics", {}).items()]


def write_report(tree: Mapping, path: str, format: str = "json") -> None:
    """JSON, YAML or CSV on the driver, as reports are for people."""
    if format == "json":
        text = json.dumps(tree, indent=2, ensure_ascii=False, default=str)
    elif format == "yaml":
        text = "\n".join(_yaml(tree)) + "\n"
    elif format == "csv":
        import csv
        import io

        rows = flat(tree)
        names = list(dict.fromkeys(k for r in rows for k in r))
        sink = io.StringIO()
        writer = csv.DictWriter(sink, names, lineterminator="\n")
        writer.writeheader()
        writer.writerows(rows)
        text = sink.getvalue()
    else:
        raise ValueError(f"no format {format!r}")
    Path(path).write_text(text, encoding="utf-8")


def _yaml(value: object, indent: int = 0):
    pad = "  " * indent
    for k, v in value.items() if isinstance(value, Mapping) else ():
        if isinstance(v, Mapping) and v:
            yield f"{pad}{json.dumps(str(k), ensure_ascii=False)}:"
            yield from _yaml(v, indent + 1)
        else:
            yield f"{pad}{json.dumps(str(k), ensure_ascii=False)}: {json.dumps(v, ensure_ascii=False, default=str)}"


def read_report(path: str) -> dict:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def shown(tree: Mapping) -> str:
    """The report as a table for a terminal."""
    rows = [("dataset", "metric", "score"), *((r["dataset"], r["metric"], str(r.get("score", next((v for k, v in r.items() if k == r["metric"]), "")))) for r in flat(tree))]
    widths = [max(len(r[i]) for r in rows) for i in range(3)]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(r, widths)).rstrip() for r in rows)


def format_size(n: float) -> str:
    for unit in ("B", "KB", "MB", "GB"):
        if n < 1024:
            return f"{n:.1f} {unit}"
        n /= 1024
    return f"{n:.1f} TB"


def format_duration(seconds: float) -> str:
    if seconds < 60:
        return f"{seconds:.1f}s"
    minutes, rest = divmod(int(seconds), 60)
    hours, minutes = divmod(minutes, 60)
    return f"{hours}h {minutes}m {rest}s" if hours else f"{minutes}m {rest}s"
