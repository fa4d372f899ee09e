"""Detection over a folder into which recordings arrive (Structured Streaming)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import events as E
from ..sources import recordings as S


def watch_recordings(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of recordings, one file at a time decoded where it is read."""
    import pandas as pd

    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("maxFilesPerTrigger", files_per_trigger).load(folder).select("path", "content")
    columns = [c.split()[0] for c in S.RECORDING.split(", ")]

    def run(batches):
        for batch in batches:
            for path, raw in zip(batch.path, batch.content):
                rows = S.decode(path, raw)
                if rows:
                    yield pd.DataFrame(rows)[columns]

    return files.mapInPandas(run, S.RECORDING)


def detect_arrivals(spark: SparkSession, folder: str, output: str, checkpoint: str, detector: str = "threshold", available_now: bool = False, **parameters) -> StreamingQuery:
    """Events of arriving recordings, appended as Parquet to output; each file is detected once (the checkpoint knows which).

    The spacing filter looks at all events of a recording, and a recording is a file, so
    each micro-batch is complete in itself.
    """
    detect = E.threshold_detection if detector == "threshold" else E.blob_detection

    def each(batch: DataFrame, number: int) -> None:
        # a repeated batch overwrites what its first attempt left
        detect(batch, **parameters).write.mode("overwrite").parquet(f"{output}/batch={number}")

    writer = watch_recordings(spark, folder).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
