"""Pages to documents as they arrive, and running statistics over the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagemill.functions.urls import normalize_url
from pagemill.operators.corpus import SEPARATOR
from pagemill.operators.documents import has_error, page_documents
from pagemill.operators.stage import Stage

PAGE_SCHEMA = "crawl_id bigint, page_id bigint, url string, html string"
DOCUMENT_SCHEMA = (
    "page_id bigint, crawl_id bigint, url string, title string, error string, markdown string, "
    "token_count bigint, byte_size bigint, batch_id bigint"
)


def read_page_stream(
    spark: SparkSession, path: str, files_per_batch: int | None = None
) -> DataFrame:
    """Captured pages, picked up as files appear in a folder."""
    reader = spark.readStream.schema(PAGE_SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def first_captures(pages: DataFrame, watermark: tuple[str, str] | None = None) -> DataFrame:
    """Each URL of a crawl once, by its normalised form.

    State grows with the number of URLs, as any exact rule must.  With ``watermark=(column,
    delay)`` it is bounded, and copies further apart than the delay pass.
    """
    keyed = pages.withColumn("_seen", normalize_url(F.col("url")))
    if watermark:
        keyed = keyed.withWatermark(*watermark).dropDuplicatesWithinWatermark(["crawl_id", "_seen"])
    else:
        keyed = keyed.dropDuplicates(["crawl_id", "_seen"])
    return keyed.drop("_seen")


def start_document_stream(
    pages: DataFrame, path: str, checkpoint: str, once: bool = False, **options
) -> StreamingQuery:
    """Append the documents of every batch of pages to a folder.

    A batch overwrites its own ``batch_id`` folder, so one that is replayed after a failure adds
    nothing twice; finished batches stay when a run stops.  A page is known by its crawl and its
    id, so crawls may use the same ids.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        made = page_documents(batch, ["page_id", "crawl_id"], "url", "html", error=None, **options)
        made.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def start_text_stream(
    pages: DataFrame, path: str, checkpoint: str, separator: str = SEPARATOR, once: bool = False, **options
) -> StreamingQuery:
    """Append the documents of every batch to the text of their crawl, pages in the order of their ids.

    The separator stands before every page of a crawl but its first, before an empty page too.  Which
    crawls have begun is state: a table in ``path`` to which each batch adds the crawls it began.  A batch reads what
    the batches before it have written and overwrites its own folders, so one that is replayed writes the
    same text again.  Text is written as it comes, in ``path/text``; :func:`appended_text` names its files in order.
    """
    if not separator.startswith("\n"):
        raise ValueError("the separator must start with a line break")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        keyed = ["crawl_id", "page_id"]
        made = page_documents(batch, keyed, "url", "html", error=None, **options).select(*keyed, "markdown")
        stage = Stage(spark, "appended")
        made = stage.save(made, "documents")
        begun = spark.createDataFrame([], "crawl_id bigint")
        if batch_id and _exists(spark, f"{path}/begun"):
            begun = spark.read.schema("crawl_id bigint, batch_id bigint").parquet(f"{path}/begun").where(
                F.col("batch_id") < batch_id
            ).select("crawl_id").distinct()
        firsts = made.groupBy("crawl_id").agg(F.min("page_id").alias("page_id")).join(begun, "crawl_id", "left_anti")
        lines = made.join(firsts.withColumn("_first", F.lit(True)), keyed, "left").select(
            *keyed,
            F.when(F.col("_first"), F.col("markdown")).otherwise(F.concat(F.lit(separator[1:]), F.col("markdown"))).alias("chunk"),
        )
        lines.repartitionByRange(*keyed).sortWithinPartitions(*keyed).select("crawl_id", "chunk").write.mode(
            "overwrite"
        ).partitionBy("crawl_id").text(f"{path}/text/batch_id={batch_id:09d}")
        firsts.select("crawl_id").write.mode("overwrite").parquet(f"{path}/begun/batch_id={batch_id}")

    writer = pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def appended_text(spark: SparkSession, path: str) -> DataFrame:
    """``crawl_id, path``: the text files of every crawl; in the order of their paths they are its text and a line break."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/text")
    return files.where("length > 0").select(F.col("crawl_id").cast("bigint").alias("crawl_id"), "path")


def read_document_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(DOCUMENT_SCHEMA).parquet(path)


def running_stats(documents: DataFrame) -> DataFrame:
    """Page, failure, token and byte totals per crawl; partial sums keep a busy crawl cheap."""
    return documents.groupBy("crawl_id").agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(has_error(F.col("error"))).alias("n_failed"),
        F.sum("token_count").alias("estimated_tokens"),
        F.sum("byte_size").alias("total_size_bytes"),
    )


def start_stats_stream(
    documents: DataFrame, path: str, checkpoint: str, once: bool = False
) -> StreamingQuery:
    """Keep the totals that changed in each batch in a folder of their own.

    The newest row of a crawl is the one with the highest ``batch_id``.  A replayed batch of
    documents comes in files of new names; each document counts once all the same, by its crawl
    and page, for which the state holds a key.
    """
    once_each = documents.dropDuplicates(["crawl_id", "page_id"])

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = (
        running_stats(once_each).writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if once else writer).start()
