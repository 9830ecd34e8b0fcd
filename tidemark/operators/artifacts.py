"""The model's life: loaded from disk, trained and persisted, or trained in memory.

Models are written to a folder of their own and published by one rename of a
manifest, which a file system does at once: a reader sees the old models or
the new, never a part. Who starts second trains nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from . import signal

MANIFEST = "manifest.json"


@dataclass
class Artifacts:
    models: dict[str, PipelineModel]
    metrics: dict[str, float]
    provenance: dict[str, object] = field(default_factory=dict)


_KEPT: dict[str, Artifacts] = {}


def _files(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    return hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def manifest(spark: SparkSession, root: str) -> dict | None:
    """What is published; None if nothing is."""
    fs, hadoop = _files(spark, root)
    path = hadoop.Path(f"{root}/{MANIFEST}")
    if not fs.exists(path):
        return None
    stream = fs.open(path)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def publish(spark: SparkSession, root: str, artifacts: Artifacts) -> str:
    """Write the models, then make them the published ones."""
    folder = f"{root}/models-{uuid.uuid4().hex[:12]}"
    signal.save(artifacts.models, artifacts.metrics, folder)
    fs, hadoop = _files(spark, root)
    draft = hadoop.Path(f"{folder}/{MANIFEST}.draft")
    stream = fs.create(draft, True)
    stream.write(bytearray(json.dumps({"folder": folder, "schema_version": signal.SCHEMA_VERSION}).encode()))
    stream.close()
    context = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    rename = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context.rename(fs.makeQualified(draft), fs.makeQualified(hadoop.Path(f"{root}/{MANIFEST}")), options)
    return folder


def load(spark: SparkSession, root: str) -> Artifacts:
    """The published models; ``ValueError`` if there are none of this version."""
    about = manifest(spark, root)
    if about is None or about.get("schema_version") != signal.SCHEMA_VERSION:
        raise ValueError(f"no models of version {signal.SCHEMA_VERSION} are published")
    models, metrics = signal.load(spark, about["folder"])
    return Artifacts(models, metrics, {"artifact_source": "disk", "artifact_path": about["folder"]})


def get(spark: SparkSession, root: str, train: Callable[[], tuple[dict[str, PipelineModel], dict[str, float]]]) -> Artifacts:
    """The models of this process, else the published ones, else new ones, which are published if that can be done."""
    if root not in _KEPT:
        found = _published(spark, root)
        if found is None:
            found = Artifacts(*train())
            try:
                found.provenance = {"artifact_source": "trained_and_persisted", "artifact_path": publish(spark, root, found)}
            except Exception as e:  # a store that can't be written: the models serve this process
                found.provenance = {"artifact_source": "trained_in_memory", "artifact_path": root, "reason": type(e).__name__}
        _KEPT[root] = found
    return _KEPT[root]


def _published(spark: SparkSession, root: str) -> Artifacts | None:
    try:
        return load(spark, root) if manifest(spark, root) is not None else None
    except ValueError:
        raise
    except Exception:  # an unreadable store has nothing published
        return None


def bootstrap(spark: SparkSession, root: str, train: Callable[[], tuple[dict[str, PipelineModel], dict[str, float]]], force: bool = False) -> Artifacts:
    """Models that are ready; ``force`` trains and publishes anew, and loads what was published."""
    if not force:
        return get(spark, root, train)
    publish(spark, root, Artifacts(*train()))
    _KEPT[root] = load(spark, root)
    return _KEPT[root]


def forget(root: str) -> None:
    """Drop what this process keeps, as a new start would."""
    _KEPT.pop(root, None)

