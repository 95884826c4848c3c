"""Session settings and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

SMALL_SIDE_BYTES = 64 << 20


def build_session(app: str = "sealcheck", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.python.sql.dataFrameDebugging.enabled": "false",     # call sites cost half of building a large plan
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; a local run gets one of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="sealcheck-checkpoint-")
    context.setCheckpointDir(folder)


def materialise(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage on reliable storage."""
    use_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write once as Parquet in the shared folder and read back. Unlike a checkpoint it has the sizes of its files, not those once estimated."""
    spark = df.sparkSession
    use_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove a staged table that no later plan reads."""
    for file in df.inputFiles()[:1]:
        folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def small_side(df: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Broadcast ``df`` when its measured size allows it, else leave the join to AQE, which splits hot keys of the other side.

    The rows are computed once and measured as text, whatever arrays or maps they hold.
    """
    table = staged(df, "side")
    size = table.agg(F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in table.columns]))))).first()[0] or 0
    return F.broadcast(table) if size <= (SMALL_SIDE_BYTES if max_bytes is None else max_bytes) else table
