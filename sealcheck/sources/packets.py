"""Dissected packet exports: JSON and tab-separated fields."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from sealcheck.schemas import FIELD, PACKET_FIELDS_SCHEMA
from sealcheck.session import small_side, staged
from sealcheck.tables import UNREADABLE_PACKET

PRETTY_SEPARATOR = "\n  },"


def _leaves(value, key: str, found: list) -> None:
    """Depth-first (key, value) pairs in document order."""
    if isinstance(value, list):
        if value and isinstance(value[0], tuple):
            for name, child in value:
                _leaves(child, f"{key}.{name}" if key else name, found)
        else:
            for child in value:
                _leaves(child, key, found)
    elif value is not None and str(value) != "":
        found.append((key.lower().replace("_", "."), str(value)))


def _packet_fields(text: str) -> list | None:
    """Ordered fields of one packet, NULL for unreadable text. Repeated keys are kept."""
    try:
        packet = json.loads(text, object_pairs_hook=list)
    except ValueError:
        return None
    for layer in ("_source", "layers"):
        inner = [child for name, child in packet if name == layer] if packet and isinstance(packet[0], tuple) else []
        packet = inner[-1] if inner else packet
    found: list = []
    _leaves(packet, "", found)
    return found


#: Packets whose fields a Python worker holds at once.
FIELD_ROWS = 500
_FIELDS = pa.list_(pa.struct([pa.field("key", pa.string()), pa.field("value", pa.string())]))


def _fields_of(texts: pa.Array) -> pa.Array:
    """``_packet_fields`` of every text, laid out as two flat columns and the rows' ends."""
    keys, values, ends, names = [], [], [0], {}
    for text in texts:
        found = _packet_fields(text.as_py())
        for key, value in found or ():
            keys.append(names.setdefault(key, key))
            values.append(value)
        ends.append(len(keys) if found is not None else None)
    flat = pa.StructArray.from_arrays([pa.array(keys, pa.string()), pa.array(values, pa.string())], fields=list(_FIELDS.value_type))
    rows = [end is None for end in ends[1:]]
    for i, missing in enumerate(rows):
        if missing:
            ends[i + 1] = ends[i]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat, type=_FIELDS, mask=pa.array(rows, pa.bool_()))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, FIELD_ROWS):
            yield batch.slice(first, FIELD_ROWS)


def capture_name(capture: Column) -> Column:
    """Label of a capture: the last part of its path, which is the key."""
    return F.element_at(F.split(capture, "/"), -1)


def flatten_packets(documents: DataFrame) -> DataFrame:
    """(capture, packet_no, json) to PACKET_FIELDS_SCHEMA; the only Python on the packet path."""
    def flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            yield pa.RecordBatch.from_arrays([batch["capture"], batch["packet_no"], _fields_of(batch["json"])], names=["capture", "packet_no", "fields"])

    return documents.select("capture", "packet_no", "json").mapInArrow(flatten, PACKET_FIELDS_SCHEMA)


_PLACED_SCHEMA = T.StructType([T.StructField("capture", T.StringType()), T.StructField("block", T.LongType()), T.StructField("at", T.LongType()),
                               T.StructField("fields", T.ArrayType(FIELD))])


def flatten_lines(lines: DataFrame) -> DataFrame:
    """(capture, block, json) as the scan gives it to (capture, block, at, fields): ``at`` counts within a block of a file.

    A task reads its blocks one after the other and in order, so the count needs no shuffle.
    """
    def flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, at = None, 0
        for batch in _pieces(batches):
            places = []
            for block in zip(batch["capture"].to_pylist(), batch["block"].to_pylist()):
                here, at = block, at + 1 if block == here else 1
                places.append(at)
            yield pa.RecordBatch.from_arrays([batch["capture"], batch["block"], pa.array(places, pa.int64()), _fields_of(batch["json"])],
                                             names=["capture", "block", "at", "fields"])

    return lines.select("capture", "block", "json").mapInArrow(flatten, _PLACED_SCHEMA)


def numbered(lines: DataFrame) -> DataFrame:
    """(capture, block, json) to PACKET_FIELDS_SCHEMA, packet_no = position in the file; unreadable text has no fields.

    The text is scanned once and never shuffled: its flattened rows are staged, two narrow columns of them give the size of every block,
    and the offsets of the blocks, a row each, meet the rows again.
    """
    held = staged(flatten_lines(lines), "export")
    blocks = held.groupBy("capture", "block").agg(F.max("at").alias("size"))
    before = W.partitionBy("capture").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    offsets = blocks.select("capture", "block", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    return held.join(small_side(offsets), ["capture", "block"]).select("capture", (F.col("offset") + F.col("at")).alias("packet_no"), "fields")


def packet_lines(spark: SparkSession, path: str, layout: str = "lines") -> DataFrame:
    """(capture, block, json) of exports that split. The capture is the full path: files of one name stay apart.

    ``lines``: one packet per line. ``pretty``: the dissector's indented array, split where a packet object closes.
    """
    reader = spark.read.option("lineSep", PRETTY_SEPARATOR) if layout == "pretty" else spark.read
    lines = reader.text(path).select(F.col("_metadata.file_path").alias("capture"), F.col("_metadata.file_block_start").alias("block"), "value")
    if layout == "pretty":
        opened = F.regexp_replace("value", r"^\s*\[", "")
        closed = F.when(opened.rlike(r"\}\s*\]\s*$"), F.regexp_replace(opened, r"\]\s*$", "")) \
                  .otherwise(F.concat(opened, F.lit("}")))
        lines = lines.withColumn("value", closed)
    return lines.filter(F.col("value").contains("{")).withColumnRenamed("value", "json")


def packet_documents(spark: SparkSession, path: str) -> DataFrame:
    """(capture, packet_no, json) of any other JSON array, or of an object with ``packets``, parsed per file."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("capture"), "value")
    items = F.coalesce(
        F.from_json("value", "array<string>"), F.from_json(F.get_json_object("value", "$.packets"), "array<string>"))
    rows = whole.select("capture", F.posexplode(items).alias("at", "json"))
    return rows.select("capture", (F.col("at") + 1).cast("bigint").alias("packet_no"), "json")


def split_unreadable(flat: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(packets, failures as captures.split_failures names them): text that is no packet object becomes no packet."""
    failed = F.col("fields").isNull()
    return flat.filter(~failed), flat.filter(failed).select(
        F.col("capture").alias("path"), "packet_no", F.lit(UNREADABLE_PACKET).alias("error"))


def read_export(spark: SparkSession, path: str, layout: str = "lines") -> tuple[DataFrame, DataFrame]:
    """(readable packets, failures) of exported JSON, read once. Layouts ``lines`` and ``pretty`` split large files, ``document`` does not."""
    if layout == "document":
        return split_unreadable(staged(flatten_packets(packet_documents(spark, path)), "export"))
    return split_unreadable(numbered(packet_lines(spark, path, layout)))


def read_packets(spark: SparkSession, path: str, layout: str = "lines") -> DataFrame:
    """The readable packets; ``read_failures`` lists the rest, ``read_export`` gives both from one scan."""
    return read_export(spark, path, layout)[0]


def read_failures(spark: SparkSession, path: str, layout: str = "lines") -> DataFrame:
    """(path, packet_no, error) of the text that is no packet."""
    return read_export(spark, path, layout)[1]


def read_packet_columns(spark: SparkSession, path: str, columns: list[str], multi: tuple[str, ...] = ()) -> DataFrame:
    """Narrow export: tab-separated fields, multi-valued ones joined by commas."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    rows = spark.read.schema(schema).option("sep", "\t").option("quote", "").csv(path)
    return split_multi(rows, multi)


def split_multi(rows: DataFrame, multi) -> DataFrame:
    for column in multi:
        rows = rows.withColumn(column, F.filter(F.transform(F.split(column, ","), lambda v: F.trim(v)), lambda v: v != ""))
    return rows
