"""Staged tables in the shared folder, and Arrow maps over whole texts that carry the row along."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from sealcheck.llm import textscan
from sealcheck.session import use_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder that all executors share."""
    use_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


#: Spark's own switches: the shuffle files of a finished query go at its end and not when the driver happens to collect garbage, and
#: a Python worker is handed so many rows at once.
_TIDY = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


@contextlib.contextmanager
def tidy_shuffles(spark: SparkSession):
    """Queries made inside give up their shuffles when they end; what they leave behind are staged tables."""
    before = {key: spark.conf.get(key, None) for key in _TIDY}
    for key, value in _TIDY.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write once as Parquet in the shared folder and read it back: cuts the lineage and prunes columns later."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*staged: DataFrame | None) -> None:
    """Remove staged tables that no later plan reads."""
    for df in staged:
        for file in (df.inputFiles()[:1] if df is not None else []):
            jvm = df.sparkSession._jvm
            folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def is_not(condition: Column) -> Column:
    """True where the condition is false or unknown."""
    return ~F.coalesce(condition, F.lit(False))


def map_texts(rows: DataFrame, text: str, keep: list[str], work: Callable[..., dict[str, list | np.ndarray]], fields: list[T.StructField],
              chunk_bytes: int = textscan.CHUNK_BYTES, inputs: Sequence[Column] = ()) -> DataFrame:
    """Columns ``row`` (a struct of ``keep``) and ``out`` (a struct of ``fields``) for each row, in the same order.

    ``work`` gets some whole texts as UTF-8 (null as empty), and a list of values per column of ``inputs``; it returns a value per
    text for each field. The result sits in a struct of its own, so no column of the input can clash with it. A text that is kept crosses to
    Python and back once, beside the rest of its row.
    """
    others = [c for c in keep if c != text]
    source = rows.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row") if others else F.struct(F.lit(0).alias("_")).alias("row"),
                         F.col(f"`{text}`").alias("text"), *[c.alias(f"in{i}") for i, c in enumerate(inputs)])
    carried = ["row", "text"] if text in keep else ["row"]
    schema = T.StructType([*[source.schema[c] for c in carried], T.StructField("out", T.StructType(fields))])
    kinds, more = {f.name: arrow_type(f.dataType) for f in fields}, len(inputs)

    def run(batches):
        for batch in batches:
            columns: dict[str, list] = {name: [] for name in kinds}
            for first, texts in textscan.chunked(batch.column("text"), chunk_bytes):
                found = work(texts, *[batch.column(2 + i).slice(first, len(texts)).to_pylist() for i in range(more)])
                for name, kind in kinds.items():
                    columns[name].append(pa.array(found[name], kind))
            out = [pa.concat_arrays(parts) if parts else pa.array([], kinds[name]) for name, parts in columns.items()]
            struct = pa.StructArray.from_arrays(out, fields=[pa.field(n, k) for n, k in kinds.items()])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carried], struct], names=[*carried, "out"])
        pa.default_memory_pool().release_unused()      # the worker stays while other stages run

    found = source.mapInArrow(run, schema)
    if text not in keep:
        return found
    return found.select(F.struct(*[(F.col("text") if c == text else F.col(f"row.`{c}`")).alias(c) for c in keep]).alias("row"), "out")


def arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(kind)


def long_field(name: str) -> T.StructField:
    return T.StructField(name, T.LongType())
