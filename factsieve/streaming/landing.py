"""The per-page run over pages that keep arriving in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from factsieve.plans.extract import extract_pages
from factsieve.plans.options import Options

PAGE_DDL = "page_id bigint, url string, html string"


def stream_pages(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    return spark.readStream.schema(PAGE_DDL).option("maxFilesPerTrigger", max_files).parquet(folder)


def extract_stream(
    pages: DataFrame, labels: list[str], out: str, checkpoint: str, options: Options = Options()
) -> StreamingQuery:
    """Appends the answers of each arriving batch of pages to ``out``, one folder per batch.

    A batch that is run again overwrites its own folder, so results appear once.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        extract_pages(batch, labels, options).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return pages.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
