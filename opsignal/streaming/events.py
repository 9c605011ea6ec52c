"""Newly landed event files to bronze tables, each line once: as a row, or as a reject."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import new_folder
from ..sources.documents import BAD, DOCUMENT_TABLES, split

#: The folder that a batch writes in each sink. Writing a batch again replaces it.
BATCH = "batch_id"


def incremental_ingest(
    spark: SparkSession,
    table: str,
    landing: str,
    target: str,
    checkpoint: str,
    max_files_per_trigger: int = 1000,
    interval: str | None = None,
    rejects: str | None = None,
) -> StreamingQuery:
    """Append the rows of new files in ``landing`` to ``target`` and the lines that are not JSON to ``rejects``
    (default: ``target`` with ``.rejects``), as (line, ingested_at).

    A batch is parsed once, into the shared folder; both sinks are written from that, each into the folder of the
    batch. The checkpoint records which files a batch took, and a batch that failed between the sinks runs
    again under the same number and replaces what it had written, so a restart neither repeats nor skips a line.
    Without ``interval`` everything present is read in batches of ``max_files_per_trigger`` files
    and the query ends; with one, for instance ``"1 minute"``, it keeps running.
    """
    schema, build = DOCUMENT_TABLES[table]
    rejects = rejects or f"{target.rstrip('/')}.rejects"

    def land(lines: DataFrame, batch: int) -> None:
        session = lines.sparkSession
        parsed = split(lines, schema)
        folder = new_folder(session, f"ingest-{table}")
        parsed.write.partitionBy("bad").parquet(folder)
        both = session.read.schema(parsed.schema).parquet(folder)
        rows = build(both.where("NOT bad").select("doc.*").drop(BAD))
        for df, sink in ((rows, target), (both.where("bad").select("line"), rejects)):
            df.withColumn("ingested_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{sink}/{BATCH}={batch}")

    lines = spark.readStream.option("maxFilesPerTrigger", max_files_per_trigger).text(landing)
    writer = lines.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return writer.trigger(**trigger).queryName(f"ingest_{table}").start()
