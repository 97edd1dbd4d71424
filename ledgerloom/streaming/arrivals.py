"""Arriving documents to blocks, each content once (STR-1, STR-2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import LongType, StructField, StructType

from ledgerloom.sources.sinks import new_documents
from ledgerloom.sources.texts import content_hash, text_blocks


def ingest_stream(spark: SparkSession, incoming: str, schema: StructType, store: str, checkpoint: str) -> StreamingQuery:
    """Read document files as they arrive; write documents and blocks of new contents under ``store``.

    Exactly once: contents already stored are dropped by an anti join inside
    each batch, and every batch writes into a folder of its own number, so a
    repeated batch replaces itself.  There is no watermark: a document is new by
    its content, however late it arrives.
    """
    docs = (spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(incoming)
            .where("text is not null").withColumn("sha256", content_hash(F.col("text"))))

    def batch(df: DataFrame, epoch: int) -> None:
        s = df.sparkSession
        path = s._jvm.org.apache.hadoop.fs.Path(f"{store}/documents")
        fs = path.getFileSystem(s.sparkContext._jsc.hadoopConfiguration())
        known = df.select("sha256").where("false")
        if fs.exists(path):
            schema_ = StructType([df.schema["sha256"], StructField("epoch", LongType())])
            known = s.read.schema(schema_).parquet(f"{store}/documents").where(F.col("epoch") != epoch).select("sha256")
        fresh = new_documents(df, known).select(*df.columns)
        fresh.write.mode("overwrite").parquet(f"{store}/documents/epoch={epoch}")
        text_blocks(fresh).write.mode("overwrite").parquet(f"{store}/blocks/epoch={epoch}")

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Progress(StreamingQueryListener):
    """Last progress of each stream, for status pages (STR-4, SNK-10)."""

    def __init__(self) -> None:
        self.state: dict[str, dict] = {}

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802 - Spark's names
        self.state[str(event.id)] = {"stage": "started", "done": 0, "error": None}

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        p = event.progress
        s = self.state.setdefault(str(p.id), {"done": 0, "error": None})
        s.update(stage="running", batch=p.batchId, done=s["done"] + p.numInputRows)

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        self.state.setdefault(str(event.id), {"done": 0, "error": None})["stage"] = "idle"

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        self.state.setdefault(str(event.id), {"done": 0}).update(stage="ended", error=event.exception)
