import datetime as dt
import json

import pytest
from brindle.operators.lifecycle import route, upserts
from brindle.sources.adapters import view
from brindle.sources.parsers import parse_sources
from brindle.sources.store import append_log, publish_files, read_pool, read_scraped, read_snapshot, write_snapshot
from brindle.streaming.ingest import inbox, pools_before, refresh, stream_ingest, stream_pools
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SCHEMA = StructType().add("id", "string").add("n", "long")


def test_a_missing_pool_is_empty_a_broken_one_an_error(spark, tmp_path):
    assert read_pool(spark, f"{tmp_path}/none.json", SCHEMA).count() == 0
    (tmp_path / "zero.json").write_text("")
    with pytest.raises(ValueError, match="empty"):
        read_pool(spark, f"{tmp_path}/zero.json", SCHEMA)
    (tmp_path / "bad.json").write_text("[{")
    with pytest.raises(Exception, match="(?i)malformed|json"):
        read_pool(spark, f"{tmp_path}/bad.json", SCHEMA).collect()
    (tmp_path / "ok.json").write_text(json.dumps([{"id": "a", "n": 1}]))
    assert read_pool(spark, f"{tmp_path}/ok.json", SCHEMA).first().id == "a"


def test_scraped_files(spark, tmp_path):
    (tmp_path / "s1.json").write_text(json.dumps([{"id": "a", "n": 1}, {"id": "b", "n": 2}]))
    (tmp_path / "s2-raw.json").write_text(json.dumps([{"id": "x", "n": 9}]))
    (tmp_path / "s3.json").write_text("[{oops")
    rows, bad = read_scraped(spark, str(tmp_path), SCHEMA)
    assert sorted(r.id for r in rows.collect()) == ["a", "b"]
    assert [r.file for r in bad.collect()] == ["s3.json"]


def test_snapshot_is_replaced_whole(spark, tmp_path):
    path = f"file://{tmp_path}/snap"
    write_snapshot(spark.range(3), path, "v1")
    write_snapshot(spark.range(5), path, "v2")
    assert read_snapshot(spark, path).count() == 5
    append_log(spark.range(2), f"{path}-log")
    append_log(spark.range(3), f"{path}-log")
    assert spark.read.json(f"{path}-log").count() == 5


def test_published_files(spark, tmp_path):
    feed = spark.createDataFrame([("a", False), ("b", True)], "id string, archived boolean")
    publish_files(feed, spark.createDataFrame([("https://x/?a&b",)], "loc string"), str(tmp_path))
    assert spark.read.json(f"{tmp_path}/events-upcoming").count() == 1
    assert spark.read.text(f"{tmp_path}/sitemap").first()[0] == "<url><loc>https://x/?a&amp;b</loc></url>"


def test_parsers_by_source(spark):
    pages = spark.createDataFrame([(1, "s", '<script type="application/ld+json">{"@type":"Event","name":"N","startDate":"2026"}</script>'), (2, "t", "Friday May 1 - Hall - Boston"), (3, "off", "x")], "page_id long, source_id string, html string")
    registry = spark.createDataFrame([("s", "jsonld", True), ("t", "dated_lines", True), ("off", "jsonld", False)], "source_id string, parser string, enabled boolean")
    assert sorted((r.page_id, r.name) for r in parse_sources(pages, registry).collect()) == [(1, "N"), (2, "Hall")]


def test_stream_routes_as_the_batch_does(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    t, sources = view(spark, sf, "v_listing"), view(spark, sf, "v_source")
    now = F.lit("1998-06-15 12:00:00").cast("timestamp_ntz")
    new, known = t.filter("pool = 'pending'"), t.filter("pool <> 'pending'")
    new.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(new.schema).parquet(f"{tmp_path}/in")
    stream_ingest(stream, lambda: known, sources, now, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    key = lambda df: sorted(map(str, df.select("id", "status", "target").collect()))
    assert key(spark.read.parquet(f"{tmp_path}/out")) == key(route(new, known, sources, now))


def _row(i, id, name, day, source="a", pool=None, **more):
    base = {"ord": i, "id": id, "pool": pool, "source": source, "name": name, "start_local": f"2026-01-{day:02}T20:00:00", "end_local": f"2026-01-{day:02}T23:00:00", "location": "Hall 1", "lat": None, "lng": None, "cost": None, "url": None, "recurring": False}
    return {**base, **more}


POOL = "ord long, id string, pool string, source string, name string, start_local timestamp_ntz, end_local timestamp_ntz, location string, lat double, lng double, cost string, url string, recurring boolean"


def test_a_batch_sees_what_batches_before_it_changed(spark, tmp_path):
    schema = StructType.fromDDL(POOL)
    (tmp_path / "base.json").write_text(json.dumps([_row(1, "k", "Salsa Harbor", 10, "b", "active", location="Hall 1"), _row(2, "old", "Tango Lab", 12, "b", "archive", end_local="2026-01-01T23:00:00")]))
    base = spark.read.schema(schema).option("multiLine", True).json(f"{tmp_path}/base.json")
    sources = spark.createDataFrame([("a", 1, True, 0), ("b", 2, True, 0), ("loud", 3, True, 90)], "source string, source_rank int, trusted boolean, noise int")
    now = F.lit("2026-01-05 12:00:00").cast("timestamp_ntz")
    files = [
        [_row(11, "n1", "Zouk Night", 15, cost="$5"), _row(12, "k2", "Salsa Harbor", 10, cost="$9"), _row(13, "q", "Mambo Lab", 20, "loud"), _row(17, "past", "Swing Lab", 1)],
        [_row(14, "n2", "Zouk Night", 15, "b", url="https://x.example/z"), _row(15, "t2", "Tango Lab", 12), _row(16, "n1", "Zouk Night", 15, "b", cost="$7")],
    ]
    (tmp_path / "in").mkdir()
    run = lambda: stream_pools(inbox(spark, f"{tmp_path}/in", f"{tmp_path}/archive", schema), base, sources, now, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    pools = lambda: {(r.id, r.ord, r.pool, r.cost, r.url) for r in pools_before(base, f"{tmp_path}/out").collect()}
    assert len(pools()) == 2
    after = []
    for i, rows in enumerate(files):
        (tmp_path / "in" / f"f{i}.json").write_text(json.dumps(rows))
        run()
        after.append(pools())
    first = {("n1", 11, "active", "$5", None), ("q", 13, "pending", None, None), ("k", 1, "active", "$9", None)}
    assert after[0] == first | {("old", 2, "archive", None, None)}
    assert after[1] == first - {("n1", 11, "active", "$5", None)} | {("n1", 11, "active", "$5", "https://x.example/z"), ("old", 2, "active", None, None)}
    run()  # nothing new
    # the second batch run again: the pools that it sees are those before it
    batch = spark.createDataFrame([], schema).unionByName(spark.read.schema(schema).option("multiLine", True).json(spark.sparkContext.parallelize([json.dumps(files[1])])))
    known = pools_before(base, f"{tmp_path}/out", 1)
    again = upserts(batch, route(batch, known, sources, now), known, sources)
    assert {(r.id, r.ord, r.pool, r.cost, r.url) for r in again.collect()} == {("n1", 11, "active", "$5", "https://x.example/z"), ("old", 2, "active", None, None)}
    assert pools() == after[1]


def test_refresh_keeps_the_time_first_seen(spark):
    at = lambda d: dt.datetime(2026, 1, d)
    known = spark.createDataFrame([("a", "old", at(1))], "id string, name string, seen_at timestamp_ntz")
    batch = spark.createDataFrame([("a", "new", at(5)), ("b", "b", at(5))], known.schema)
    assert sorted((r.id, r.name, r.seen_at) for r in refresh(known, batch).collect()) == [("a", "new", at(1)), ("b", "b", at(5))]
