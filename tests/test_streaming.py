"""Streams give what the batch jobs give, once, also after a restart."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pagemill.operators.documents import page_documents
from pagemill.streaming import documents as stream


@pytest.fixture()
def pages(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    return frame.select((F.col("page_id") % 3).alias("crawl_id"), "page_id", "url", "html")


def plain(frame):
    return sorted((r.page_id, r.crawl_id, r.markdown, r.token_count, r.byte_size) for r in frame.collect())


def run(spark, source, out, checkpoint):
    arriving = stream.first_captures(stream.read_page_stream(spark, source, files_per_batch=1))
    query = stream.start_document_stream(arriving, out, checkpoint, once=True)
    query.awaitTermination()
    assert query.exception() is None


def test_documents_replay_restart_and_stats(spark, pages, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    pages.where("page_id < 20").coalesce(1).write.mode("append").parquet(source)
    run(spark, source, out, state)
    first = spark.read.parquet(out)
    assert first.count() == 20

    # copies of pages already seen, and new ones, after a restart
    pages.where("page_id >= 10").coalesce(1).write.mode("append").parquet(source)
    run(spark, source, out, state)
    got = spark.read.parquet(out)
    batch = page_documents(pages, "page_id", "url", "html", error=None, keep=["crawl_id"])
    assert plain(got) == plain(batch)

    # nothing new: nothing is added
    run(spark, source, out, state)
    assert spark.read.parquet(out).count() == pages.count()

    totals, state2 = str(tmp_path / "totals"), str(tmp_path / "state2")

    def count():
        query = stream.start_stats_stream(stream.read_document_stream(spark, out), totals, state2, once=True)
        query.awaitTermination()
        assert query.exception() is None

    count()
    # the last batch is replayed, its documents come again in other files
    last = max((f for f in Path(state, "commits").iterdir() if f.name.isdigit()), key=lambda f: int(f.name))
    last.unlink()
    last.with_name(f".{last.name}.crc").unlink(missing_ok=True)
    run(spark, source, out, state)
    count()
    newest = spark.read.parquet(totals).groupBy("crawl_id").agg(
        F.max_by(F.struct("n_total", "estimated_tokens", "total_size_bytes"), "batch_id").alias("s")
    )
    want = batch.groupBy("crawl_id").agg(F.count("*"), F.sum("token_count"), F.sum("byte_size"))
    assert sorted((r.crawl_id, *r.s) for r in newest.collect()) == sorted(map(tuple, want.collect()))


def test_crawls_may_share_page_ids(spark, pages, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    two = pages.where("page_id < 2")
    both = two.withColumn("crawl_id", F.lit(1).cast("long")).union(two.withColumn("crawl_id", F.lit(2).cast("long")))
    both.coalesce(1).write.parquet(source)
    run(spark, source, out, state)
    texts = {(r.crawl_id, r.page_id): r.markdown for r in spark.read.parquet(out).collect()}
    assert set(texts) == {(1, 0), (1, 1), (2, 0), (2, 1)}
    assert texts[1, 0] == texts[2, 0] and texts[1, 1] == texts[2, 1]


def test_bounded_dedupe(spark, pages, tmp_path):
    source = str(tmp_path / "in")
    pages.where("page_id < 4").coalesce(1).write.parquet(source)
    arriving = stream.read_page_stream(spark, source).withColumn("at", F.current_timestamp())
    once = stream.first_captures(arriving, watermark=("at", "1 hour"))
    seen = []
    query = once.writeStream.foreachBatch(lambda b, i: seen.append(b.count())).trigger(availableNow=True).option(
        "checkpointLocation", str(tmp_path / "s")
    ).start()
    query.awaitTermination()
    assert sum(seen) == 4


def test_text_grows_with_the_stream(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "crawl_id long, page_id long, url string, html string"
    body = "<p>words of page {}</p>"
    batches = [
        [(1, 1, "http://h/1", body.format(1)), (2, 7, "http://g/7", None)],
        [(1, 2, "http://h/2", "<nav>nothing</nav>"), (1, 3, "http://h/3", body.format(3)), (3, 1, "http://k/1", body.format(1))],
        [(2, 8, "http://g/8", body.format(8)), (1, 4, "http://h/4", body.format(4))],
    ]

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        pages = stream.read_page_stream(spark, source)
        stream.start_text_stream(pages, out, state, once=True, include_metadata=False).awaitTermination()

    def texts():
        found = {}
        for r in sorted(stream.appended_text(spark, out).collect(), key=lambda r: r.path):
            found[r.crawl_id] = found.get(r.crawl_id, "") + open(r.path.removeprefix("file:"), encoding="utf-8").read()
        return found

    rule = "\n\n---\n\n"
    arrive(batches[0])
    arrive(batches[1])
    want = {1: "words of page 1" + rule + rule + "words of page 3\n", 2: "\n", 3: "words of page 1\n"}
    assert texts() == want
    # The last batch fails after its work: it is done again, and nothing stands there twice.
    Path(f"{state}/commits/1").unlink()
    Path(f"{state}/commits/.1.crc").unlink(missing_ok=True)
    arrive(batches[2])
    assert texts() == {
        1: want[1][:-1] + rule + "words of page 4\n", 2: rule + "words of page 8\n", 3: want[3],
    }
