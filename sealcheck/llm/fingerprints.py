"""Document fingerprints: bottom-k sketches of shingle hashes.

A fingerprint holds the ``K`` smallest distinct 48-bit hashes of a text's five-word shingles, as base64 of their big-endian bytes in
order. Sketches of parts merge into the sketch of the whole; with fewer than ``K`` shingles it is the whole set and every
estimate is exact. Equal texts have equal fingerprints. A text without words has the empty fingerprint; two of those resemble each
other fully, one and any other not at all. Null is the empty text.
"""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from sealcheck.llm import common, textscan

K = 256
_BYTES = 6


def sketches(texts: list[bytes], k: int = K) -> list[np.ndarray]:
    """The k smallest distinct 48-bit shingle hashes of each text, ascending."""
    # the sets ascend, and so do their leading bits; equal leading bits of two shingles are one value
    return [np.unique(s[:2 * k] >> np.uint64(16))[:k] for s in textscan.Scan(texts, lower=True).shingle_sets()]


def to_text(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - _BYTES:].tobytes()).decode()


def from_text(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, _BYTES)
    return np.pad(raw, ((0, 0), (8 - _BYTES, 0))).reshape(-1).view(">u8").astype(np.uint64)


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of two parts together."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity: the share of the union's k smallest hashes that both hold."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    values, times = np.unique(np.concatenate([a, b]), return_counts=True)
    return float((times[:k] == 2).sum() / min(k, len(values)))


def distinct_shingles(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[k - 1]) + 1) / 2.0 ** (8 * _BYTES))


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b holds too."""
    if not len(a):
        return 1.0
    both = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return min(1.0, both / distinct_shingles(a, k))


def with_fingerprints(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``row`` and ``out.fingerprint``."""
    return common.map_texts(docs, text, docs.columns if keep is None else keep,
                            lambda texts: {"fingerprint": [to_text(s) for s in sketches(texts)]}, [T.StructField("fingerprint", T.StringType())])


def likeness(a: Column, b: Column) -> Column:
    """Estimated resemblance of two fingerprint columns; null where either is null."""
    @F.pandas_udf("double")
    def estimate(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else resemblance(from_text(p), from_text(q)) for p, q in zip(x, y)], dtype=float)
    return estimate(a, b)


def merged_fingerprints(parts: DataFrame, key: str, fingerprint: str = "fingerprint") -> DataFrame:
    """(key, fingerprint) of the parts together: at most k hashes per key leave a task."""
    hashes = F.udf(lambda f: [int(h) for h in from_text(f or "")], "array<long>")
    rows = parts.select(key, F.explode(hashes(F.col(fingerprint))).alias("hash")).distinct()
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("hash"))).where(F.col("_n") <= K)
    join = F.udf(lambda h: to_text(np.array(sorted(h or []), np.uint64)), "string")
    held = first.groupBy(key).agg(F.collect_list("hash").alias("_h")).select(key, join("_h").alias(fingerprint))
    return parts.select(key).distinct().join(held, key, "left").select(key, F.coalesce(fingerprint, F.lit("")).alias(fingerprint))


def _place(value: Column, bounds: list) -> Column:
    """Number of ``bounds`` (ascending) below ``value``, by binary search."""
    table = F.array(*[F.lit(b) for b in bounds])
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))

    def step(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        above = F.coalesce(value > F.get(table, mid), F.lit(False))
        going = s["lo"] < s["hi"]
        return F.struct(F.when(going & above, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(going & ~above, mid).otherwise(s["hi"]).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(len(bounds).bit_length() + 1)), start, step, lambda s: s["lo"])


def beside_next(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(bucket, guest, doc_id, text), partitioned and sorted so that a bucket's rows descend by id and the document after its last row
    follows as a guest. Bounds and edges on the driver are a few per shuffle partition. Rows without an id are in bucket -1."""
    spark = docs.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    bounds = sorted(set(rows.approxQuantile("doc_id", [i / buckets for i in range(1, buckets)], 0.25 / buckets)))
    kind = rows.schema["doc_id"].dataType
    bucket = _place(F.col("doc_id"), [F.lit(b).cast(kind) for b in bounds]) if bounds else F.lit(0)
    rows = rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(bucket))
    edges = sorted((r["bucket"], r["last"]) for r in rows.where("bucket >= 0").groupBy("bucket").agg(F.max("doc_id").alias("last")).collect())
    targets = [(edges[i - 1][1], edges[i][0]) for i in range(len(edges))]
    guests = spark.createDataFrame(targets, T.StructType([T.StructField("doc_id", kind), T.StructField("target", T.IntegerType())]))
    invited = (rows.join(F.broadcast(guests), "doc_id")
               .select(F.col("target").alias("bucket"), F.lit(True).alias("guest"), "doc_id", "text"))
    return (rows.select("bucket", F.lit(False).alias("guest"), "doc_id", "text").union(invited)
            .repartition("bucket").sortWithinPartitions("bucket", "guest", F.desc("doc_id"), "text"))


def edited(text: str, following: str) -> str:
    """The last half (rounded down) of the text replaced by as much of the start of the following one."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def edit_study(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edit with the next text, and their likeness. A row without an id has no next text."""
    id_type = docs.schema[id_column].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), common.long_field("n_chars"), T.StructField("edited_text", T.StringType()),
                           T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()),
                           T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())])
    arrow_id = common.arrow_type(id_type)

    def run(batches):
        waiting: tuple | None = None            # the row before: bucket, guest, id, text, sketch

        def finish(rows: list[tuple], nexts: list[tuple | None]) -> pa.RecordBatch:
            changed = [edited(row[3], nxt[3] if nxt else "") for row, nxt in zip(rows, nexts)]
            other = sketches([c.encode() for c in changed])
            return pa.RecordBatch.from_arrays([
                pa.array([r[2] for r in rows], arrow_id), pa.array([len(r[3]) for r in rows], pa.int64()), pa.array(changed, pa.string()),
                pa.array([to_text(r[4]) for r in rows]), pa.array([to_text(o) for o in other]),
                pa.array([resemblance(r[4], o) for r, o in zip(rows, other)], pa.float64()),
                pa.array([resemblance(r[4], nxt[4]) if nxt else None for r, nxt in zip(rows, nexts)], pa.float64())], names=schema.names)

        for batch in batches:
            for first, texts in textscan.chunked(batch.column("text")):
                meta = [batch.column(i).slice(first, len(texts)).to_pylist() for i in range(3)]
                rows = [(*m, t.decode(), s) for *m, t, s in zip(*meta, texts, sketches(texts))]
                done, nexts = [], []
                for row in rows:
                    if waiting is not None and not waiting[1]:
                        done.append(waiting)
                        nexts.append(row if row[0] == waiting[0] and row[0] >= 0 else None)
                    waiting = row
                if done:
                    yield finish(done, nexts)
        if waiting is not None and not waiting[1]:
            yield finish([waiting], [None])

    return beside_next(docs, id_column, text).mapInArrow(run, schema)


def op8_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return edit_study(docs).select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
                                   "near_edited", "near_next")
