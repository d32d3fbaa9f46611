"""Near-real-time indexing: a stream of documents committed to an index batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..index import Index


def read_stream(spark: SparkSession, path: str, schema, kind: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    """Documents from files as they come into a folder."""
    r = spark.readStream.schema(schema.struct() if hasattr(schema, "struct") else schema).format(kind)
    return (r.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else r).load(path)


def stream_into(index: Index, docs: DataFrame, checkpoint: str, commit: bool = True, trigger: dict | None = None) -> StreamingQuery:
    """Append every micro-batch as a level of the index. A batch that is run again after a failure replaces its own level, so nothing is indexed twice."""

    def write(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        index.index_documents(batch, batch=f"{checkpoint}#{batch_id}")
        if commit:
            index.commit()

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
