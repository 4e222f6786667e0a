import random

import duckdb

from codesift.llm import queries, url_filter

SCHEMA = "page_id long, url string, at long"
ENTRY = "key string, at long, verdict string"


def plain(url, at, entries):
    """The verdict for a capture by going through the whole list."""
    if url is None or at is None or "://" not in url:
        return None, None, True
    rest = url.split("://", 1)[1]
    host = rest.split("/")[0].split("?")[0].split("#")[0].rsplit("@", 1)[-1].split(":")[0].lower()
    path = rest.split("?")[0].split("#")[0].split("/")[1:]
    segments = [s for s in path if s]
    labels = host.split(".")
    keys = [".".join(labels[i:]) for i in range(max(1, len(labels) - 1))] if host else []
    keys += ["/".join([host, *segments[:i + 1]]) for i in range(len(segments))] if host else []
    best = None
    for key in keys:
        events = {}
        for k, t, v in entries:
            if k == key and t is not None and t <= at and v in url_filter.VERDICTS:
                rank = url_filter.VERDICTS.index(v)
                events[t] = min(events.get(t, 9), rank)
        if events and events[max(events)] < 2:
            best = max(best or ("",), ("/" in key, len(key), key, url_filter.VERDICTS[events[max(events)]]), key=lambda b: b[:2] if len(b) > 1 else (False, -1))
    return (best[2], best[3], best[3] != "block") if best else (None, None, True)


def test_as_of_join_equals_plain_walk(spark):
    random_ = random.Random(4)
    hosts = ["a.example.com", "b.a.example.com", "example.com", "other.org", "x.other.org"]
    urls = [f"http://{h}{p}" for h in hosts for p in ("", "/", "/en", "/en/1?x=/no", "/EN#top", "/de/2/3")] + [
        "HTTPS://User@A.Example.com:8080/en/1", "ftp://example.com", "nonsense", "http://", None]
    captures = [(i, random_.choice(urls), random_.choice([None, *range(0, 400)])) for i in range(500)]
    keys = [*hosts, "a.example.com/en", "a.example.com/en/1", "other.org/de", "com", None]
    entries = [(random_.choice(keys), random_.choice([None, *range(0, 300, 3)]), random_.choice([*url_filter.VERDICTS, None])) for _ in range(200)]
    frames = spark.createDataFrame(captures, SCHEMA), spark.createDataFrame(entries, ENTRY)
    for bucket in (7, 64, 100_000):
        for r in url_filter.url_filter(*frames, bucket=bucket, keep=("page_id", "url", "at")).collect():
            assert (r.matched_key, r.verdict, r.kept) == plain(r.url, r["at"], entries), (r, bucket)


def test_far_dates_cost_nothing(spark):
    random_ = random.Random(8)
    times = [-62_135_596_800, 0, 86_400, 253_402_300_799, 1_704_067_200_000, 2**55, 1_704_067_200]
    urls = [f"http://h{k}.example/a/b" for k in range(40)]
    entries = [(f"h{random_.randrange(40)}.example{random_.choice(['', '/a'])}", random_.choice(times), random_.choice(url_filter.VERDICTS)) for _ in range(100)]
    captures = [(i, random_.choice(urls), random_.choice(times) + random_.choice([-1, 0, 1, 10**7])) for i in range(300)]
    frames = spark.createDataFrame(captures, SCHEMA), spark.createDataFrame(entries, ENTRY)
    for r in url_filter.url_filter(*frames, keep=("page_id", "url", "at")).collect():
        assert (r.matched_key, r.verdict, r.kept) == plain(r.url, r["at"], entries), r
    nothing = spark.createDataFrame([], "key string, bucket long")
    assert url_filter.validity(frames[1], nothing).count() <= 100


def test_odd_rows(spark):
    captures = spark.createDataFrame([(1, None, 5), (2, "http://a.b/c", None), (3, "http://a.b/" + "x/" * 500, 9), (3, "http://a.b/", 9)], SCHEMA)
    captures = captures.selectExpr("*", "'clash' AS key", "1 AS bucket", "2 AS rank", "3 AS uid")
    listed = spark.createDataFrame([("a.b", 1, "block")], ENTRY)
    got = url_filter.url_filter(captures, listed, keep=("page_id",)).orderBy("page_id").collect()
    assert [(r.page_id, r.kept) for r in got] == [(1, True), (2, True), (3, False), (3, False)]
    none = url_filter.url_filter(captures, listed.where("false"), keep=("page_id",)).collect()
    assert len(none) == 4 and all(r.kept for r in none)
    assert url_filter.url_filter(captures.where("false"), listed, keep=("page_id",)).count() == 0


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    names = ["page_id", "url", "at", "matched_key", "verdict", "kept"]
    got = queries.QUERIES["op5_url_filter"](spark, sf).select(names).collect()
    want = connection.execute(f"SELECT {', '.join(f'\"{n}\"' for n in names)} FROM ({url_filter.ORACLE_SQL})").fetchall()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr) and got
