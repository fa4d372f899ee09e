"""Session helpers: shared folder, written intermediate tables, Arrow batch sizes."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
#: Drops a statement's shuffle files when it has ended; what is written needs them no more.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


WRITING = {_TIDY: "true", "spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS), "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """The session with these settings, until the block ends."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir).

    Only where that setting is missing, as in local tests, a temporary folder of
    this machine is used.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = _own.setdefault(spark.sparkContext.applicationId, "")
        if not folder:
            folder = _own[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="echoframe-")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back; cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with settings(spark, WRITING):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables made by written() that nothing will read again."""
    for df in tables:
        path = getattr(df, "_written_path", None)
        if path:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def pieces(batches, most: int = BATCH_BYTES):
    """Arrow batches cut to at most 1,000 rows and about `most` bytes (or one row), so that array code over texts holds little at once."""
    for batch in batches:
        step = max(1, min(BATCH_ROWS, batch.num_rows * most // max(batch.nbytes, 1)))
        for a in range(0, batch.num_rows, step):
            yield batch.slice(a, step)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
