"""Places for models that this library doesn't bring: reasoners, name finders, face finders, text readers.

A model is a function DataFrame -> DataFrame under a name. Without one, or when it fails to give
its columns, the result is empty: nothing is let through for lack of a model. Nothing is called
for rows whose mode of privacy is local if the model says that it works remotely.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .operators.stores import mode

#: What each kind of model has to give for its rows.
RESULTS = {
    "reason": "decision_id long, raw string",
    "answer": "question_id long, answer string",
    "names": "text_id long, ord int, label string, confidence double, start int, end int",
    "faces": "image long, score double, x double, y double, width double, height double",
    "read": "image long, line int, text string, confidence double",
}


@dataclass(frozen=True)
class Model:
    kind: str
    run: Callable[[DataFrame], DataFrame]
    remote: bool = True


_MODELS: dict[str, Model] = {}


def register(name: str, kind: str, run: Callable[[DataFrame], DataFrame], remote: bool = True) -> None:
    if kind not in RESULTS:
        raise ValueError(f"no such kind of model: {kind}")
    _MODELS[name] = Model(kind, run, remote)


def unregister(name: str) -> None:
    _MODELS.pop(name, None)


def results(name: str, kind: str, rows: DataFrame, privacy: Column | None = None) -> DataFrame:
    """What the model of this name gives for rows; empty if there is none of this kind.

    Rows of local privacy, and without a mode the default one's, go to a remote model only if
    they may.
    """
    spark, schema = rows.sparkSession, RESULTS[kind]
    model = _MODELS.get(name)
    if model is None or model.kind != kind:
        return spark.createDataFrame([], schema)
    if model.remote and privacy is not None:
        rows = rows.filter(mode(privacy) != F.lit("local"))
    out, names = model.run(rows), [c.split()[0] for c in schema.split(", ")]
    if not set(names) <= set(out.columns):
        return spark.createDataFrame([], schema)
    return out.select(*(F.col(n).cast(t).alias(n) for n, t in (c.split() for c in schema.split(", "))))
