"""Records arriving as a stream of raw lines, with the same reasons for rejection as in a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from kinweave.sources.rejects import person_records


def split_stream(lines: DataFrame, sound_path: str, reject_path: str, checkpoint: str) -> StreamingQuery:
    """Writes each micro-batch's sound records and rejects to two Parquet tables, by batch, so that a repeated batch
    replaces itself.

    lines: a streaming DataFrame with line_no and c0.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch = person_records(batch).persist()
        for path, part in ((sound_path, batch.where("reason is null").drop("reason", "csv_error")), (reject_path, batch.where("reason is not null").select("line_no", "reason", "csv_error"))):
            part.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")
        batch.unpersist()

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
