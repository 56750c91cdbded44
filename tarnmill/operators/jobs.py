"""Progress of generation jobs from the states of their chunks and items, and of crawled roots from their pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def derive_status(total: Column, done: Column, error: Column) -> Column:
    """new without chunks or before the first has ended, running while some are left, then done or partial_error."""
    left = total - done - error
    return F.when(total == 0, "new").when(left > 0, F.when(left == total, "new").otherwise("running")).when(error > 0, "partial_error").otherwise("done")


def derive_phase(status: Column) -> Column:
    return F.when(status == "new", "queued").when(status == "running", "generating").otherwise("generated")


def progress(chunks: DataFrame) -> DataFrame:
    """One row a job of chunks(job_id, chunk_no, status, error_message)."""
    failed = F.col("status") == "error"
    counted = chunks.groupBy("job_id").agg(
        F.count("*").alias("total_chunks"), F.count_if(F.col("status") == "done").alias("done_chunks"), F.count_if(failed).alias("error_chunks"),
        F.max_by(F.when(failed, F.col("error_message")), F.when(failed, F.col("chunk_no"))).alias("last_error"),
    )
    status = derive_status(F.col("total_chunks"), F.col("done_chunks"), F.col("error_chunks"))
    return counted.withColumn("status", status).withColumn("phase", derive_phase(F.col("status")))


def root_status(roots: DataFrame, pages: DataFrame) -> DataFrame:
    """Roots with their pages counted: new without a page done, done when all are, running in between."""
    counts = pages.groupBy("root_id").agg(F.count("*").alias("page_count"), F.count_if(F.col("status") == "done").alias("done_count"))
    joined = roots.join(counts, "root_id", "left").fillna(0, ["page_count", "done_count"])
    status = F.when((F.col("page_count") == 0) | (F.col("done_count") == 0), "new").when(F.col("done_count") >= F.col("page_count"), "done").otherwise("running")
    return joined.withColumn("status", status)


def completed(jobs: DataFrame) -> DataFrame:
    return jobs.filter((F.lower("status") == "done") & (F.coalesce("error_chunks", F.lit(0)) == 0))


def monitored(jobs: DataFrame) -> DataFrame:
    return jobs.filter(F.lower("status").isin("running", "error"))


def job_records(requests: DataFrame, requested_at: Column) -> DataFrame:
    """Job rows of requests(job_id, source_type, source_name, request_type, selected_count, preview_only): a preview is done at once."""
    nothing, none = F.lit(0), F.lit(None).cast("timestamp")
    status = F.when(F.coalesce("preview_only", F.lit(False)), "done").otherwise("new")
    return requests.select(
        "job_id", "source_type", "source_name", "request_type", status.alias("status"), "selected_count", nothing.alias("qa_count"), nothing.alias("plain_count"), nothing.alias("error_count"),
        requested_at.alias("requested_at"), none.alias("started_at"), none.alias("finished_at"), F.lit(None).cast("string").alias("error_message"),
    )


def job_item_records(items: DataFrame, created_at: Column) -> DataFrame:
    """Item rows of items(job_item_id, job_id, source_type, parent_source_id, parent_label, row_count), all new."""
    none = F.lit(None).cast("timestamp")
    return items.select(
        "job_item_id", "job_id", "source_type", "parent_source_id", "parent_label", F.coalesce("row_count", F.lit(0)).alias("row_count"), F.lit("new").alias("status"), F.lit(0).alias("knowledge_count"),
        F.lit(None).cast("string").alias("error_message"), created_at.alias("created_at"), none.alias("started_at"), none.alias("finished_at"),
    )


def chunk_records(chunks: DataFrame, job: str = "job_item_id") -> DataFrame:
    """Chunk rows, each queued as new under the id of its job item and number."""
    return chunks.withColumns({"chunk_id": F.concat_ws(":", F.col(job).cast("string"), F.col("chunk_no").cast("string")), "status": F.lit("new"), "error_message": F.lit(None).cast("string")})
