"""URL filters as of the time of a capture, in DataFrame operations.

A list entry says from when on a key is blocked, allowed or no longer listed. A key is a
domain, which covers its subdomains, or a host with the beginning of a path. Entries
of one key become intervals of validity: each lasts until the next one begins. A capture is
judged by the interval that holds its time, of the longest key that has a verdict then;
keys with a path go before domains.

The as-of join is an equality join. Time is cut into buckets; for each key and each bucket
with a change or a capture there is one row with the verdict at the start of the
bucket, which is the last change in an earlier one, and the intervals that begin in it, as an array in order of time.
A capture meets the rows of its keys and its own bucket and picks the last interval begun; nothing is
multiplied by the number of entries or by the time between them. Entries of one key and time are reduced before
anything else, so the array is bounded by the number of times at which a key changes in a bucket.
Captures of one host are many rows of one join key; they only stream past, and
Spark splits such partitions of a join.

Defined cases: a null or unreadable URL has no key and a null time no bucket, so such
captures are kept without a verdict; of entries for one key and time the strictest holds
(block, then allow, then clear); entries with a null key, time or verdict are left out;
repeated captures are judged each; an empty list keeps everything;
any number of seconds is a time, also one far from all others. Only the columns
named are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 32 * 86_400
VERDICTS = ("block", "allow", "clear")
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, HOST, 1))


def segments_of(url: Column) -> Column:
    return F.filter(F.split(F.regexp_extract(url, PATH, 1), "/", -1), lambda s: s != "")


def keys_of(host: Column, segments: Column) -> Column:
    """All keys that cover a URL: the host, its parents of two labels or more, and the beginnings of the path."""
    labels = F.split(host, r"\.", -1)
    parents = F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(labels) - 1)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    beginnings = F.when(F.size(segments) > 0, F.transform(
        F.sequence(F.lit(1), F.size(segments)), lambda i: F.concat_ws("/", host, F.slice(segments, F.lit(1), i))))
    keys = F.concat(parents, F.coalesce(beginnings, F.array().cast("array<string>")))
    return F.when(F.coalesce(host, F.lit("")) != "", F.array_distinct(keys)).otherwise(F.array().cast("array<string>"))


def validity(entries: DataFrame, asked: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """``key, bucket, opening, begun`` from ``key, at, verdict``, for the ``key, bucket`` that are asked for.

    ``opening`` is the verdict at the start of the bucket and ``begun`` the changes within it. Only buckets with
    a change or a question have a row, so dates far apart cost nothing.
    """
    rank = F.array_position(F.array(*[F.lit(v) for v in VERDICTS]), F.lower("verdict"))
    known = entries.select("key", F.col("at").cast("long").alias("at"), rank.alias("rank")).where(
        F.col("key").isNotNull() & F.col("at").isNotNull() & (F.col("rank") > 0))
    # The strictest entry of a key and time, reduced before the shuffle.
    reduced = known.groupBy("key", "at").agg(F.min("rank").alias("rank"))
    changes = reduced.select("key", F.floor(F.col("at") / bucket).alias("bucket"), F.struct("at", "rank").alias("change"))
    questions = asked.select("key", "bucket").distinct().withColumn("change", F.lit(None).cast(changes.schema["change"].dataType))
    # Nulls are not collected: a bucket that is only asked for has no changes.
    buckets = changes.unionByName(questions).groupBy("key", "bucket").agg(F.sort_array(F.collect_list("change")).alias("begun"))
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    closing = F.try_element_at("begun", F.lit(-1))["rank"]
    rows = buckets.select("key", "bucket", F.last(closing, ignorenulls=True).over(before).alias("opening"), "begun")
    return rows.where(F.col("opening").isNotNull() | (F.size("begun") > 0))


def url_filter(
    captures: DataFrame, entries: DataFrame, url: str = "url", at: str = "at", bucket: int = BUCKET,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """The columns ``keep`` of every capture with ``matched_key, verdict, kept``.

    ``captures`` has a URL and a time in seconds; ``entries`` has ``key, at, verdict``.
    """
    rows = captures.select(
        F.struct(*keep).alias("row") if keep else F.struct(F.lit(0)).alias("row"),
        F.col(at).cast("long").alias("time"), keys_of(host_of(F.col(url)), segments_of(F.col(url))).alias("keys"),
        F.monotonically_increasing_id().alias("uid"),
    )
    # The columns to keep go with one of the keys only.
    asked = rows.select("uid", "time", "row", F.posexplode_outer("keys").alias("place", "key")).select(
        "uid", "time", "key", F.when(F.coalesce("place", F.lit(0)) == 0, F.col("row")).alias("row"),
        F.floor(F.col("time") / bucket).alias("bucket"))
    questions = captures.select(
        F.explode(keys_of(host_of(F.col(url)), segments_of(F.col(url)))).alias("key"),
        F.floor(F.col(at).cast("long") / bucket).alias("bucket")).where("bucket IS NOT NULL")
    valid = validity(entries, questions, bucket)
    begun = F.filter("begun", lambda c: c["at"] <= F.col("time"))
    rank = F.coalesce(F.try_element_at(begun, F.lit(-1))["rank"], F.col("opening"))
    met = asked.join(valid, ["key", "bucket"], "left").withColumn("rank", rank)
    found = F.when(F.col("rank") < len(VERDICTS), F.struct(
        F.contains("key", F.lit("/")).alias("path"), F.length("key").alias("size"), F.col("key").alias("key"), F.col("rank").alias("rank")))
    best = met.groupBy("uid").agg(F.first("row", ignorenulls=True).alias("row"), F.max(found).alias("best"))
    verdict = F.get(F.array(*[F.lit(v) for v in VERDICTS]), (F.col("best.rank") - 1).cast("int"))
    return best.select(
        *[F.col(f"row.{c}").alias(c) for c in keep], F.col("best.key").alias("matched_key"), verdict.alias("verdict"),
        F.coalesce(verdict != "block", F.lit(True)).alias("kept"),
    )


# Captures and a list from the pages: the seconds of a capture and of an entry follow from
# the id, and every page puts its domain, host or a beginning of its path on the list.
CAPTURE_SQL = "1704067200 + (page_id * 7919 % 366) * 86400 + page_id * 104729 % 86400"
ENTRY_SQL = "1704067200 + (page_id * 31 % 366) * 86400"
VERDICT_SQL = "CASE page_id % 5 WHEN 0 THEN 'allow' WHEN 1 THEN 'clear' ELSE 'block' END"


def captures_of(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", F.expr(CAPTURE_SQL).alias("at"))


def entries_of(pages: DataFrame) -> DataFrame:
    host, segments = host_of(F.col("url")), segments_of(F.col("url"))
    parent = F.regexp_replace(host, r"^[^.]+\.", "")
    key = F.when(F.col("page_id") % 7 == 0, parent).when(F.col("page_id") % 7 < 3, host).when(
        F.col("page_id") % 7 < 5, F.concat_ws("/", host, F.slice(segments, 1, 1))
    ).otherwise(F.concat_ws("/", host, segments))
    return pages.select(key.alias("key"), F.expr(ENTRY_SQL).alias("at"), F.expr(VERDICT_SQL).alias("verdict"))


def page_filter(pages: DataFrame) -> DataFrame:
    return url_filter(captures_of(pages), entries_of(pages), keep=("page_id", "url", "at"))


ORACLE_SQL = rf"""
WITH parts AS (
  SELECT page_id, url, {CAPTURE_SQL} AS "at",
    lower(regexp_extract(url, '{HOST}', 1)) AS host,
    list_filter(string_split(regexp_extract(url, '{PATH}', 1), '/'), lambda x: x <> '') AS seg
  FROM pages
), entries AS (
  SELECT CASE WHEN page_id % 7 = 0 THEN regexp_replace(host, '^[^.]+\.', '') WHEN page_id % 7 < 3 THEN host
      WHEN page_id % 7 < 5 THEN array_to_string(list_concat([host], seg[1:1]), '/')
      ELSE array_to_string(list_concat([host], seg), '/') END AS key,
    {ENTRY_SQL} AS began,
    min(CASE page_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 1 END) AS rank
  FROM parts GROUP BY ALL
), intervals AS (
  SELECT key, rank, began, lead(began) OVER (PARTITION BY key ORDER BY began) AS ended FROM entries
), labels AS (
  SELECT page_id, "at", host, seg, string_split(host, '.') AS lab FROM parts
), asked AS (
  SELECT page_id, "at", unnest(list_distinct(list_concat(
    list_transform(generate_series(1, greatest(1, len(lab) - 1)), lambda i: array_to_string(lab[i:], '.')),
    list_transform(generate_series(1, len(seg)), lambda i: array_to_string(list_concat([host], seg[1:i]), '/'))
  ))) AS key FROM labels
), found AS (
  SELECT a.page_id, v.key, v.rank, row_number() OVER (
    PARTITION BY a.page_id ORDER BY contains(v.key, '/') DESC, length(v.key) DESC) AS place
  FROM asked a JOIN intervals v ON a.key = v.key AND a."at" >= v.began AND (v.ended IS NULL OR a."at" < v.ended)
  WHERE v.rank < 3
)
SELECT p.page_id, p.url, p."at", f.key AS matched_key,
  CASE f.rank WHEN 1 THEN 'block' WHEN 2 THEN 'allow' END AS verdict, coalesce(f.rank, 2) <> 1 AS kept
FROM parts p LEFT JOIN found f ON p.page_id = f.page_id AND f.place = 1
"""
