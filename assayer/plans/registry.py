"""Registries and the argument handling around them."""

from __future__ import annotations

import json
import warnings
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODEL_TYPES = ("text_generation", "embedding", "audio_recognition", "vqa")
MODALITIES = ("text", "image", "audio", "video")


@dataclass(frozen=True)
class Entry:
    make: Callable
    required: tuple[str, ...] = ()
    optional: tuple[str, ...] = ()
    defaults: Mapping[str, object] = field(default_factory=dict)


class Registry:
    """Named components with declared arguments."""

    def __init__(self, kind: str):
        self.kind, self.entries = kind, {}

    def register(self, name: str, required: Sequence[str] = (), optional: Sequence[str] = (), defaults: Mapping[str, object] | None = None) -> Callable:
        def add(make: Callable) -> Callable:
            if name in self.entries:
                raise ValueError(f"{self.kind} {name!r} is registered already")
            self.entries[name] = Entry(make, tuple(required), tuple(optional), dict(defaults or {}))
            return make

        return add

    def get(self, name: str) -> Entry:
        if name not in self.entries:
            raise KeyError(f"no {self.kind} {name!r}; there are {', '.join(sorted(self.entries)) or 'none'}")
        return self.entries[name]

    def names(self) -> list[str]:
        return sorted(self.entries)

    def remove(self, name: str) -> bool:
        return self.entries.pop(name, None) is not None

    def arguments(self, name: str, given: Mapping[str, object] | None = None) -> dict:
        """Defaults below what is given. A missing required argument is an error even if it has a default; an unknown one a warning."""
        own, given = self.get(name), dict(given or {})
        if missing := [a for a in own.required if a not in given]:
            raise ValueError(f"{self.kind} {name!r} needs {', '.join(missing)}")
        known = {*own.required, *own.optional, *own.defaults}
        if odd := sorted(given.keys() - known):
            warnings.warn(f"{self.kind} {name!r} doesn't know {', '.join(odd)}", stacklevel=2)
        return {**own.defaults, **given}

    def create(self, name: str, given: Mapping[str, object] | None = None):
        return self.get(name).make(**self.arguments(name, given))


metrics, processors, datasets, models = (Registry(k) for k in ("metric", "processor", "dataset", "model"))


@dataclass(frozen=True)
class Model:
    """A catalogue row; the predictor behind it is the caller's."""

    name: str
    model_type: str
    modalities: tuple[str, ...] = ("text",)
    languages: tuple[str, ...] = ()
    settings: Mapping[str, object] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.model_type not in MODEL_TYPES or not set(self.modalities) <= set(MODALITIES):
            raise ValueError(f"{self.name}: unknown type or modality")

    def overridden(self, *layers: Mapping[str, object]) -> Model:
        """With later settings over earlier ones; this model stays as it is."""
        merged = dict(self.settings)
        for layer in layers:
            merged |= layer
        return Model(self.name, self.model_type, self.modalities, self.languages, merged)


def model_rows(spark: SparkSession, rows: Sequence[Model]) -> DataFrame:
    return spark.createDataFrame([(m.name, m.model_type, list(m.modalities), list(m.languages)) for m in rows], "model string, model_type string, modalities array<string>, languages array<string>")


def find_models(rows: DataFrame, model_type: str | None = None, modality: str | None = None, language: str | None = None) -> DataFrame:
    """Models of a type, with a modality, of a language; a model that names no language is of every one."""
    if model_type:
        rows = rows.where(F.col("model_type") == model_type)
    if modality:
        rows = rows.where(F.array_contains("modalities", modality))
    return rows.where((F.size("languages") == 0) | F.array_contains("languages", language)) if language else rows


def component_rows(spark: SparkSession, registry: Registry) -> DataFrame:
    """(name, kind, required, optional, defaults) of what a registry has, a row for each; defaults are JSON."""
    rows = [(n, registry.kind, list(e.required), list(e.optional), json.dumps(dict(e.defaults), sort_keys=True, default=str)) for n, e in sorted(registry.entries.items())]
    return spark.createDataFrame(rows, "name string, kind string, required array<string>, optional array<string>, defaults string")


#: What a task asks of a model: its type and its modalities.
NEEDS = {
    "mcqa": ("text_generation", ("text",)), "mcqa_bias": ("text_generation", ("text",)), "open_ended_qa": ("text_generation", ("text",)), "harm_detection": ("text_generation", ("text",)),
    "calculator": ("text_generation", ("text",)), "safety_classification": ("text_generation", ("text",)), "translation": ("text_generation", ("text",)), "rubric_evaluation": ("text_generation", ("text",)),
    "conversation_rubric_evaluation": ("text_generation", ("text",)), "text_to_json": ("text_generation", ("text",)), "image_to_json": ("text_generation", ("text", "image")), "vqa": ("text_generation", ("text", "image")),
    "transcription": ("audio_recognition", ("audio",)), "retrieval": ("embedding", ("text",)),
}


def compatible(models: DataFrame, datasets: DataFrame) -> DataFrame:
    """(model, dataset) pairs of which the model has the type and all modalities that the dataset's task needs.

    Both catalogues are small; the tasks' needs join on the type, and the modalities are compared as sets.
    """
    spark = models.sparkSession
    needs = spark.createDataFrame([(t, k, list(m)) for t, (k, m) in NEEDS.items()], "task_type string, model_type string, needed array<string>")
    wanted = datasets.select(F.col("name").alias("dataset"), "task_type").join(F.broadcast(needs), "task_type")
    return models.join(wanted, "model_type").where(F.size(F.array_except("needed", "modalities")) == 0).select("model", "dataset")


def parse_nested(text: str) -> dict[str, dict[str, str]]:
    """`name:key=value,key=value;name:...` as nested dicts; values stay text and may hold = signs."""
    out: dict[str, dict[str, str]] = {}
    for part in filter(None, (p.strip() for p in text.split(";"))):
        name, sep, rest = part.partition(":")
        if not sep:
            raise ValueError(f"{part!r} has no ':'")
        own = out.setdefault(name.strip(), {})
        for pair in filter(None, (p.strip() for p in rest.split(","))):
            key, sep, value = pair.partition("=")
            if not sep:
                raise ValueError(f"{pair!r} has no '='")
            own[key.strip()] = value.strip()
    return out


def parse_processors(text: str) -> dict[str, dict[str, dict[str, str]]]:
    """`dataset.processor:key=value,...;...` as dicts by dataset and processor."""
    out: dict[str, dict[str, dict[str, str]]] = {}
    for name, own in parse_nested(text).items():
        dataset, sep, processor = name.rpartition(".")
        if not sep:
            raise ValueError(f"{name!r} has no '.'")
        out.setdefault(dataset, {})[processor] = own
    return out


def parse_list(text: str) -> list[str]:
    return [x for x in (p.strip() for p in text.split(",")) if x]


def _fill() -> None:
    from ..functions.text import PROCESSORS
    from ..operators import judges, transcripts
    from ..operators import metrics as basic
    from ..sources.datasets import DATASETS

    for name, make in {**basic.REGISTRY, **transcripts.REGISTRY, **judges.REGISTRY}.items():
        metrics.register(name)(make)
    for name, make in PROCESSORS.items():
        processors.register(name)(make)
    for name, d in DATASETS.items():
        datasets.register(name, d.required, (), d.defaults)(d.build)


_fill()
