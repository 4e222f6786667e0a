"""Links that need no change, and such that do."""

from pyspark.sql import functions as F

from codesift.reports import html


def test_plain_links_are_not_cut_into_characters(spark):
    links = ["https://a.example/b?c=d&e#f", "https://a.example/%41", "https://a.example/%4", "x y", "", "javascript:x", "http://é", "/a-b_c~"]
    frame = spark.createDataFrame([(link,) for link in links], "u string").select("u", html.link_column(F.col("u")).alias("l"))
    assert {r.u: r.l for r in frame.collect()} == {link: html.safe_link(link) for link in links}
