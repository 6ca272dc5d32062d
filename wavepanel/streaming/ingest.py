"""Incremental ingest: export files arriving in a folder -> long table.

The ingest (profile lookup, unpivot, normalisation, explode) is stateless
per row, so it runs unchanged on a streaming DataFrame: each micro-batch of
new export files is appended to the long table, partitioned by question.
Progress and exactly-once file tracking live in the checkpoint location
(under ``spark.checkpoint.dir`` by default), so a restarted or failed query
resumes where it stopped.  First/last wave and the tables stay batch jobs
over the long table: they need every wave of a family.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from .. import schema as S
from ..plans.pipeline import SurveySpec, long_table
from ..session import checkpoint_dir


def stream_exports(spark: SparkSession, source_dir: str, schema: StructType,
                   max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(source_dir)


def start_long_ingest(spark: SparkSession, source_dir: str, schema: StructType, spec: SurveySpec,
                      sink_dir: str, checkpoint_location: str | None = None,
                      available_now: bool = True) -> StreamingQuery:
    """Start the streaming ingest; ``available_now`` processes what is there and stops."""
    location = checkpoint_location or os.path.join(checkpoint_dir(spark), "ingest-" + os.path.basename(sink_dir))
    long = long_table(stream_exports(spark, source_dir, schema), spec)
    writer = (long.writeStream.format("parquet").outputMode("append")
              .option("checkpointLocation", location).partitionBy(S.QUESTION))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start(sink_dir)
