import datetime as dt

from lodequery.sources import sinks, tables
from lodequery.streaming import index_stream

FEED = "doc_id long, op string, v string, seq long"


def test_batches_fold_once(spark, tmp_path):
    src, root, check = (str(tmp_path / x) for x in ("src", "root", "check"))
    spark.createDataFrame([(1, "add", "a", 1), (2, "add", "b", 2)], FEED).write.parquet(src)
    q = index_stream.maintain(index_stream.read_feed(spark, src, FEED), root, check, once=True)
    q.awaitTermination()
    spark.createDataFrame([(1, "delete", None, 3), (3, "add", "c", 4)], FEED).write.mode("append").parquet(src)
    index_stream.maintain(index_stream.read_feed(spark, src, FEED), root, check, once=True).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(sinks.latest_version(spark, root)).collect())) == [(2, "b"), (3, "c")]


def test_the_last_document_may_go(spark, tmp_path):
    src, root, check = (str(tmp_path / x) for x in ("src", "root", "check"))
    for rows in ([(1, "add", "a", 1)], [(1, "delete", None, 2)], [(2, "add", "b", 3)]):
        spark.createDataFrame(rows, FEED).write.mode("append").parquet(src)
        index_stream.maintain(index_stream.read_feed(spark, src, FEED), root, check, once=True).awaitTermination()
    assert list(map(tuple, spark.read.parquet(sinks.latest_version(spark, root)).collect())) == [(2, "b")]


def test_sessions(spark, tmp_path):
    src = str(tmp_path / "q")
    t = dt.datetime(2024, 1, 1)
    rows = [("u", t), ("u", t + dt.timedelta(minutes=10)), ("u", t + dt.timedelta(hours=3)), ("w", t + dt.timedelta(days=1))]
    spark.createDataFrame(rows, "ip string, time timestamp").write.parquet(src)
    s = index_stream.session_counts(spark.readStream.schema("ip string, time timestamp").parquet(src))
    q = s.writeStream.format("memory").queryName("sessions").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert sorted(r.n for r in spark.table("sessions").where("ip = 'u'").collect()) == [1, 2]


def test_index_xml(spark):
    xml = '<documentAdd><documentId>7</documentId><boost>2.5</boost><field name="t" stored="true">hi</field><field name="u">x</field><payload name="date">5</payload></documentAdd>'
    d = spark.createDataFrame([(xml, 1), ("<documentDelete><documentId>8</documentId></documentDelete>", 2)], "value string, seq long")
    a, b = tables.index_documents(d).orderBy("seq").collect()
    assert (a.op, a.doc_id, a.boost, a.fields[0].text, a.payloads) == ("add", "7", 2.5, "hi", {"date": 5})
    assert (b.op, b.doc_id) == ("delete", "8")


def test_results_as_xml(spark):
    page = spark.createDataFrame([(1, "a & b", "http://x/", "s")], "rank int, title string, url string, snippet_text string")
    assert "<title>a &amp; b</title>" in sinks.opensearch_items(page).first().xml


def test_unknown_tag(spark):
    import pytest

    tags = spark.createDataFrame([(1, 1, "a")], "tag_id long, type_id int, name string")
    ok = spark.createDataFrame([(5, 1)], "result_id long, tag_id long")
    assert sinks.checked_tags(ok, tags).count() == 1
    with pytest.raises(Exception, match="unknown tag"):
        sinks.checked_tags(spark.createDataFrame([(5, 2)], "result_id long, tag_id long"), tags).collect()
