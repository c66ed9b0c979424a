"""Model sink and source (S9, S10): one directory per saved version.

    <path>/CURRENT                  name of the version in force
    <path>/versions/<name>/state/    Parquet  (type_id, term_id, s ARRAY<DOUBLE>, eta0, eta)
    <path>/versions/<name>/vocab/    Parquet  (type_id, term_id, term, ...)
    <path>/versions/<name>/metadata/ JSON     one row: k, num_terms, alpha, numdocs, num_updates,
                                              version, batch_id, flags, params, metrics

A save writes a new version and then swaps the pointer by a rename: a model
can be saved over the path it was loaded from, and a failed save leaves the
old version in force. The version before the one in force is kept (a model
loaded from it may still be read); older ones are deleted.

Unlike the reference (whose state lives in a side file that its loader does
not re-attach, D9) the round trip is complete.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict

import numpy as np
from pyspark.sql import SparkSession

from ..session import _fs_path, read_pointer, write_pointer


def save(model, path: str, batch_id: int | None = None) -> str:
    path = path.rstrip("/")
    spark = model.spark
    before = read_pointer(spark, f"{path}/CURRENT")
    older = json.loads(before) if before else {}
    name = uuid.uuid4().hex
    target = f"{path}/versions/{name}"
    model.state.write.parquet(f"{target}/state")
    model.vocab.write.parquet(f"{target}/vocab")
    meta = {
        "k": model.k,
        "num_terms": list(map(int, model.num_terms)),
        "alpha": [float(a) for a in model.alpha],
        "numdocs": int(model.numdocs),
        "num_updates": int(model.num_updates),
        "version": int(model.version),
        "batch_id": -1 if batch_id is None else int(batch_id),
        "optimize_alpha": bool(model.optimize_alpha),
        "optimize_eta": bool(model.optimize_eta),
        "eb_from_s": bool(model.eb_from_s),
        "params": json.dumps(asdict(model.params)),
        "metrics": model.metrics,
    }
    spark.createDataFrame([(json.dumps(meta),)], "meta STRING").coalesce(1).write.text(f"{target}/metadata")
    write_pointer(spark, f"{path}/CURRENT", json.dumps({"current": name, "before": older.get("current"), "batch_id": meta["batch_id"]}))
    if older.get("before"):
        fs, p = _fs_path(spark, f"{path}/versions/{older['before']}")
        fs.delete(p, True)
    return path


def current(spark: SparkSession, path: str) -> str | None:
    """Folder of the version in force, None where nothing was saved."""
    pointer = read_pointer(spark, f"{path.rstrip('/')}/CURRENT")
    return f"{path.rstrip('/')}/versions/{json.loads(pointer)['current']}" if pointer else None


def read_metadata(spark: SparkSession, path: str) -> dict:
    folder = current(spark, path)
    if folder is None:
        raise FileNotFoundError(f"no model was saved under {path}")
    return json.loads(spark.read.text(f"{folder}/metadata").collect()[0][0])


def committed_batch(spark: SparkSession, path: str) -> int:
    """Batch id of the saved model, -1 where nothing was saved."""
    pointer = read_pointer(spark, f"{path.rstrip('/')}/CURRENT")
    return int(json.loads(pointer)["batch_id"]) if pointer else -1


def load(spark: SparkSession, path: str):
    from ..plans.model import Params, TopicModel

    meta = read_metadata(spark, path)
    folder = current(spark, path)
    params = Params(**json.loads(meta["params"]))
    return TopicModel(
        spark,
        params,
        meta["num_terms"],
        spark.read.parquet(f"{folder}/vocab"),
        spark.read.parquet(f"{folder}/state"),
        np.asarray(meta["alpha"], dtype=np.float64),
        numdocs=meta["numdocs"],
        num_updates=meta["num_updates"],
        optimize_alpha=meta["optimize_alpha"],
        optimize_eta=meta["optimize_eta"],
        eb_from_s=meta["eb_from_s"],
        version=meta["version"],
        metrics=list(meta.get("metrics", [])),
    )


__all__ = ["save", "load", "read_metadata", "committed_batch", "current"]
