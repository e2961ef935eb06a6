"""Folders and tables that the driver and all executors see."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from almanac.llm.text import WORD, slices


_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's `spark.checkpoint.dir`; where it is unset, a temporary folder of a local session."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        folder = _own[app] = _own.get(app) or tempfile.mkdtemp(prefix="almanac-")
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call returns."""
    return f"{shared_folder(spark)}/almanac-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written as Parquet to the shared folder and read again.

    Cuts the lineage: a lost executor costs a new read, not a new computation.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps now, not whenever the driver collects garbage."""
    for _ in range(2):  # what the first round frees is what the second one finds unreachable
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def as_slices(x: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
    """Rows (slice, at, by) for add_up(): n slices of a vector, without those that are 0; of sparse ones only places and values."""
    width = -(-len(x) // n)
    for i in range(n):
        part = x[i * width : (i + 1) * width].astype("<f8")
        at = np.flatnonzero(part).astype("<i4")
        if len(at):
            row = (i, None, part.tobytes()) if 3 * len(at) > 2 * len(part) else (i, at.tobytes(), part[at].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.binary(), pa.binary()))], ["slice", "at", "by"])


def add_up(parts: DataFrame, length: int, n: int) -> np.ndarray:
    """The sum of vectors of one length, whose slices are rows (slice, at, by); a task adds up whole slices."""
    width = -(-length // n)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, at, by in zip(*(batch.column(i).to_pylist() for i in range(3))):
                total = found.setdefault(part, np.zeros(width))
                by = np.frombuffer(by, "<f8")
                if at is None:
                    total[: len(by)] += by
                else:
                    total[np.frombuffer(at, "<i4")] += by
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([x.tobytes() for x in found.values()], pa.binary())], ["slice", "total"])

    total = np.zeros(width * n)
    for r in parts.repartition("slice").mapInArrow(add, "slice int, total binary").collect():
        total[r["slice"] * width : (r["slice"] + 1) * width] = np.frombuffer(r["total"], "<f8")
    return total[:length]


def n_words(text: Column) -> Column:
    """Words of a text (null: 0), without Python."""
    return F.coalesce(F.size(F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")), F.lit(0)).cast("long")


def per_slice(docs: DataFrame, added: str, measure: Callable[[pa.Array], dict], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns of docs, and those that `measure` makes of about 1 MB of texts at a time.

    `added` is the DDL of the new columns; `measure` returns an array for each.
    """
    new = StructType.fromDDL(added)
    schema = StructType([docs.schema[c] for c in keep] + new.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(schema)
        for batch in batches:
            texts = batch.column(len(keep))
            for a, b in slices(texts):
                found = measure(texts[a:b])
                columns = [batch.column(i)[a:b] for i in range(len(keep))] + [found[f.name] for f in new.fields]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, out)], schema=out)

    return docs.select(*keep, F.col("text").cast("string")).mapInArrow(run, schema)


__all__ = ["WORD", "add_up", "as_slices", "n_words", "new_path", "per_slice", "release", "shared_folder", "written"]
