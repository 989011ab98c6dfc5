"""Stored weights: named tensors of checkpoints, each tensor kept once under the digest of its content.

Two tables under a folder: `tensors` (sha256, shape, values) and `names` (checkpoint, name, sha256). A checkpoint's names are written when
its tensors are there, so a checkpoint is whole or absent; tensors that an earlier checkpoint holds are not written again.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TENSORS, NAMES = "sha256 string, shape array<int>, values array<double>", "checkpoint string, name string, sha256 string"
#: What `load` brings to the driver (and predictors to each worker) at most.
MOST_BYTES = 1 << 28


def digest(tensor: np.ndarray) -> str:
    return hashlib.sha256(repr(tensor.shape).encode() + np.ascontiguousarray(tensor, "<f8").tobytes()).hexdigest()


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table, empty if there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return spark.createDataFrame([], schema)
        raise


def write(spark: SparkSession, path: str, checkpoint: str, tensors: dict[str, np.ndarray]) -> None:
    """Adds a checkpoint; FileExistsError if it is there."""
    if checkpoint in checkpoints(spark, path):
        raise FileExistsError(f"{path} has a checkpoint {checkpoint}")
    arrays = {k: np.asarray(v, float) for k, v in tensors.items()}
    by = {digest(a): a for a in arrays.values()}
    held = {r["sha256"] for r in _table(spark, f"{path}/tensors", TENSORS).where(F.col("sha256").isin(*by)).select("sha256").collect()}
    new = [(k, list(a.shape), a.ravel().tolist()) for k, a in by.items() if k not in held]
    if new:
        spark.createDataFrame(new, TENSORS).coalesce(1).write.mode("append").parquet(f"{path}/tensors")
    spark.createDataFrame([(checkpoint, k, digest(a)) for k, a in arrays.items()], NAMES).coalesce(1).write.mode("append").parquet(f"{path}/names")


def checkpoints(spark: SparkSession, path: str) -> list[str]:
    return sorted(r["checkpoint"] for r in _table(spark, f"{path}/names", NAMES).select("checkpoint").distinct().collect())


def read(spark: SparkSession, path: str, checkpoint: str, prefixes: tuple[str, ...] = ("",)) -> DataFrame:
    """name, shape, values, sha256 of a checkpoint's tensors under the first of the prefixes that any name has, names without it.

    KeyError if there is no such tensor.
    """
    names = _table(spark, f"{path}/names", NAMES).where(F.col("checkpoint") == checkpoint)
    for prefix in prefixes:
        some = names.where(F.col("name").startswith(prefix)).withColumn("name", F.substring("name", len(prefix) + 1, 2**31 - 1))
        if some.limit(1).count():
            return some.join(_table(spark, f"{path}/tensors", TENSORS), "sha256").select("name", "shape", "values", "sha256")
    raise KeyError(f"no tensor under {list(prefixes)} in checkpoint {checkpoint!r}; there are {[r['name'] for r in names.select('name').limit(6).collect()]}")


def load(table: DataFrame, most_bytes: int = MOST_BYTES) -> dict[str, np.ndarray]:
    """The tensors as arrays, by name; ValueError if they are larger than most_bytes together or differ from their digests."""
    size = table.agg(F.coalesce(F.sum(F.size("values")), F.lit(0))).first()[0] * 8
    if size > most_bytes:
        raise ValueError(f"the weights take {size} bytes, over {most_bytes}")
    out = {}
    for r in table.collect():
        out[r["name"]] = np.array(r["values"], float).reshape(r["shape"])
        if digest(out[r["name"]]) != r["sha256"]:
            raise ValueError(f"{r['name']} differs from its digest")
    return out
