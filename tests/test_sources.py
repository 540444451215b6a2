"""Landed payloads, pages, sinks and streams."""

import datetime
import json

from pyspark.sql import functions as F

from fernweave.sources import landed, pages, sinks
from fernweave.streaming import feedback


def test_review_pages(spark):
    page = lambda *ids: json.dumps({"success": 1, "cursor": "c", "reviews": [{"recommendationid": i, "review": f"t{i}", "votes_up": 1} for i in ids]})
    rows = spark.createDataFrame([(1, page("a", "b")), (2, page("b", "", "c")), (3, "not json"), (4, None), (5, page())], "page int, payload string")
    out = landed.review_pages(rows, "payload", ["page"]).collect()
    assert sorted((r.recommendationid, r.page) for r in out if r.error is None) == [("a", 1), ("b", 1), ("c", 2)]
    assert sorted(r.page for r in out if r.error) == [3, 4]


def test_news_and_app_feed(spark):
    news = json.dumps({"appnews": {"appid": 7, "newsitems": [{"gid": "g", "title": "t", "url": "u/community_announcements/1", "is_external_url": True, "date": 0}, {"title": "only", "is_external_url": True, "date": 5}]}})
    out = landed.news_items(spark.createDataFrame([(news,)], "p string"), "p").orderBy("place").collect()
    assert [(r.news_id, r.external, r.published_at is None) for r in out] == [("g", False, True), ("only", True, False)]
    entry = lambda i, r: {"id": {"label": i}, "rating": {"label": r}, "content": {"label": "x"}}
    feed = json.dumps({"feed": {"entry": [entry("http://x/review?id=12", "5"), entry("http://x/34", "3"), entry("http://x/5", "9"), entry("http://x/6", None)]}})
    out = landed.app_feed(spark.createDataFrame([(feed,)], "p string"), "p").orderBy("place").collect()
    assert [(r.review_id, r.rating) for r in out] == [("12", 5), ("34", 3)]


def test_directory_and_snapshot(spark, tmp_path):
    (tmp_path / "b.json").write_text('[{"k": 1}, {"k": 2}]')
    (tmp_path / "a.json").write_text('{"k": 3}')
    out = landed.json_directory(spark, str(tmp_path), "k int").collect()
    assert sorted((r.file, r.k) for r in out) == [("a.json", 3), ("b.json", 1), ("b.json", 2)]
    assert landed.previous_snapshot(spark, None, "k int, record_type string", "x").count() == 0


def test_pages(spark):
    html = """<a href="/menu"><b>Menu</b></a><a href='https://www.other.example/x'>Out</a><a href="/menu">Again</a>
    <script type="application/ld+json">{"@type": "Product", "name": "N", "offers": {"price": "3.5", "priceCurrency": "EUR", "availability": "http://s/InStock"}}</script>
    <script type="application/ld+json">{"@graph": [{"@type": "Book", "name": "B"}]}</script>"""
    frame = spark.createDataFrame([("https://a.example/p", html), ("u", None)], "url string, html string")
    assert {(r.href, r.label, r.same_host) for r in pages.links(frame, "url", "html").collect()} == {("/menu", "Menu", True), ("https://www.other.example/x", "Out", False)}
    assert {(r.name, r.amount, r.availability) for r in pages.products(frame, "url", "html").collect()} == {("N", 3.5, "InStock"), ("B", None, None)}
    states = spark.createDataFrame([(200, "text/html"), (404, ""), (None, None), (429, ""), (200, "application/pdf")], "s int, c string")
    assert [r[0] for r in states.select(pages.page_status(F.col("s"), F.col("c"))).collect()] == ["page", "missing", "failed", "blocked", "document"]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a b", 1), ("c", 2)], "name string, n int")
    sinks.append_records(rows, str(tmp_path / "d"), "review")
    sinks.append_records(rows, str(tmp_path / "d"), "report")
    assert spark.read.parquet(str(tmp_path / "d")).groupBy("record_type").count().count() == 2
    path = str(tmp_path / "r")
    sinks.upsert_reports(sinks.reports(rows, F.col("name")), path)
    sinks.upsert_reports(sinks.reports(rows.where("n = 2").withColumn("n", F.lit(9)), F.col("name")), path)
    got = {r.report_key: json.loads(r.report)["n"] for r in spark.read.parquet(path).collect()}
    assert got == {"a_b": 1, "c": 9}


def at(minute):
    return datetime.datetime(2025, 1, 1) + datetime.timedelta(minutes=minute)


def run(spark, stream, name, tmp_path):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_streams(spark, tmp_path):
    schema = "id string, t timestamp, kind string"
    source = str(tmp_path / "in")
    first = [("a", at(0), "x"), ("a", at(1), "x"), ("b", at(2), "y"), ("c", at(12), "x")]
    second = [("b", at(13), "y"), ("d", at(40), "x")]
    third = [("late", at(1), "x"), ("e", at(90), "x")]
    for part in (first, second, third):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
    seen = run(spark, feedback.once(stream, ["id"], "t", "1 hour"), "seen", tmp_path)
    assert sorted(r.id for r in seen.collect() if r.id != "late") == ["a", "b", "c", "d", "e"]
    counted = run(spark, feedback.window_counts(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), "t", "10 minutes", ["kind"], "5 minutes"), "counted", tmp_path)
    batch = {tuple(r) for r in feedback.window_counts(spark.createDataFrame(first + second, schema), "t", "10 minutes", ["kind"], "5 minutes").collect()}
    assert {tuple(r) for r in counted.collect() if r.start < at(30)} <= batch | {(at(0), at(10), "x", 3)}
    sessions = feedback.session_counts(spark.createDataFrame(first + second, schema), "t", "5 minutes", ["kind"], "1 hour")
    assert {(r.kind, r.n) for r in sessions.collect()} == {("x", 2), ("y", 1), ("x", 1)}


def test_append_new_batches(spark, tmp_path):
    path = str(tmp_path / "table")
    write = feedback.append_new(path, ["id"], ["t"])
    schema = "id string, t int"
    write(spark.createDataFrame([("a", 2), ("a", 1), (None, 1)], schema), 0)
    write(spark.createDataFrame([("a", 3), ("b", 1)], schema), 1)
    write(spark.createDataFrame([("b", 3)], schema), 2)
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 1)]
