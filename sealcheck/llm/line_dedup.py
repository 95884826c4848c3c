"""Line dedup with levelled sorted runs of line hashes.

State is a set of runs: tables of 128-bit line hashes with the first document that holds the line, each bucketed and sorted by
the hash, so a batch meets a run by a merge join without shuffling the run. A new batch anti-joins every run, adds the
hashes that are new as a run of level 0, and when a level holds ``fanout`` runs they are merged into one run of the next level.
A hash is in one run only. Batches follow ascending document ids, so the first document that holds a line has the smallest id.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends and with A-Z in lower case. Keys of at least 10 code points
that a document with a smaller id holds are dropped; repeats inside the first document stay. A null or empty text is one
empty line. Rows without an id keep all their lines. Rows that share one id count as one document. Only DataFrame operations run.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sealcheck.llm import common

LEAST_CHARS, BATCHES, FANOUT = 10, 4, 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    stripped = F.btrim(line, F.lit(SPACE))
    # lower() equals the ASCII mapping where every character is one byte
    return F.when(F.length(stripped) == F.octet_length(stripped), F.lower(stripped)).otherwise(F.translate(stripped, UPPER, LOWER))


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def long_lines(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """(doc_id, pos, h1, h2) of every line whose key is long enough."""
    return (docs.where(F.col(id_column).isNotNull())
            .select(F.col(id_column).alias("doc_id"), F.posexplode(text_lines(F.col(text))).alias("pos", "line"))
            .select("doc_id", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= LEAST_CHARS)
            .select("doc_id", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2")))


class LineRuns:
    """The levelled runs, kept as bucketed tables of the warehouse under a name of their own."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"line_runs_{uuid.uuid4().hex}"
        self.levels: list[list[str]] = []
        self._made = 0

    def _write(self, rows: DataFrame) -> str:
        self._made += 1
        name = f"{self.name}_{self._made}"
        rows.write.format("parquet").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").saveAsTable(name)
        return name

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def hashes(self) -> DataFrame:
        """(h1, h2, first_doc) over all runs."""
        whole = None
        for name in self.runs():
            run = self.spark.table(name)
            whole = run if whole is None else whole.unionByName(run)
        return whole

    def absorb(self, lines: DataFrame) -> None:
        """Add the hashes of a batch of (doc_id, h1, h2) rows that no run holds, then compact full levels."""
        fresh = lines.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_doc"))
        for name in self.runs():
            fresh = fresh.join(self.spark.table(name).select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        self._add(0, self._write(fresh))

    def _add(self, level: int, name: str) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            parts, self.levels[level] = self.levels[level], []
            merged = self.spark.table(parts[0])
            for part in parts[1:]:
                merged = merged.unionByName(self.spark.table(part))
            self._add(level + 1, self._write(merged))
            for part in parts:
                self.spark.sql(f"DROP TABLE {part}")

    def drop(self) -> None:
        for name in self.runs():
            self.spark.sql(f"DROP TABLE {name}")
        self.levels = []


def _batch_bounds(ids: DataFrame, batches: int) -> list[int]:
    """Ids that cut the documents into batches of about equal size, ascending."""
    return sorted(set(ids.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01))) if batches > 1 else []


def drop_lists(docs: DataFrame, id_column: str = "doc_id", text: str = "text", batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """(doc_id, dropped: positions of the lines to drop) for the documents that lose lines."""
    spark = docs.sparkSession
    lines = common.stage(long_lines(docs, id_column, text), "lines")
    runs = LineRuns(spark, fanout)
    low = None
    for high in [*_batch_bounds(lines.select("doc_id"), batches), None]:
        batch = lines
        batch = batch if low is None else batch.where(F.col("doc_id") > low)
        batch = batch if high is None else batch.where(F.col("doc_id") <= high)
        runs.absorb(batch.select("doc_id", "h1", "h2"))
        low = high
    # a hash that one document alone holds drops nothing and need not meet the lines again
    held = lines.groupBy("h1", "h2").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("h1", "h2")
    firsts = runs.hashes().join(held, ["h1", "h2"], "left_semi")
    dropped = (lines.join(firsts, ["h1", "h2"]).where("doc_id > first_doc")
               .groupBy("doc_id").agg(F.collect_set("pos").alias("dropped")))
    staged = common.stage(dropped, "dropped")
    runs.drop()
    common.discard(lines)
    return staged


def with_clean_text(docs: DataFrame, id_column: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Columns ``row`` (struct of all columns of ``docs``) and ``out`` (kept text, n_lines, n_dropped)."""
    lists = drop_lists(docs, id_column, text, **options).select(F.col("doc_id").alias("_key"), "dropped")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_column}`").alias("_id"),
                       F.col(f"`{text}`").alias("_text"))
    # the lines are a column of their own, so that they are split once and not once per kept line
    # texts are dealt by id at every size: a broadcast list would be the other plan only while the input is small
    parts = (rows.join(lists.hint("merge"), F.col("_id") == F.col("_key"), "left")
             .select("row", "_text", "dropped", text_lines(F.col("_text")).alias("_lines")))
    stays = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("dropped"))
    kept = F.when(F.col("dropped").isNull(), F.coalesce("_text", F.lit(""))).otherwise(
        F.array_join(F.transform(stays, lambda i: F.get("_lines", i)), "\n"))
    return parts.select("row", F.struct(kept.alias("text"), F.size("_lines").cast("long").alias("n_lines"),
                                        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped")).alias("out"))


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_clean_text(docs).select("row.doc_id", "out.n_lines", "out.n_dropped", F.sha2("out.text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, i, l[i] AS line, trim(l[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS stripped
  FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))),
keyed AS (SELECT *, translate(stripped, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
firsts AS (SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10 GROUP BY key),
judged AS (SELECT doc_id, i, line, first_doc IS NOT NULL AND doc_id > first_doc AS dropped FROM keyed LEFT JOIN firsts USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN dropped THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
