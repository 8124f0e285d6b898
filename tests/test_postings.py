"""Normalised listings: pages without a vacancy, cursors without a beginning."""

import datetime

import pytest
from pyspark.sql import functions as F

from vacancia.functions import markup, urls
from vacancia.operators import upkeep
from vacancia.plans import QUERIES
from vacancia.sources import postings


def test_pages_without_vacancies(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "text alone"), (4, "# Title"), (5, "# Title\nbody")], "id long, markdown string")
    assert [(r["id"], r["title"], r["description"]) for r in postings.markdown_details(pages).collect()] == [(5, "Title", "body")]
    assert postings.markdown_links(pages, "id").count() == 0


def test_description_lines():
    assert markup.description("a\nb<ul><li>c<script>d<br></script>e</li><li></li></ul>&amp;<h5>f</h5>") == "a\nb\n- ce\n-\n&f"


def test_cursors(spark):
    at = lambda d: datetime.datetime(2026, 1, d)
    frame = lambda *r: spark.createDataFrame(list(r), "profile_id string, channel string, minimum_first_seen_at timestamp")
    begun = upkeep.begin_cycles(frame(("a", "m", at(1))), frame(("a", "m", at(5)), ("b", "m", at(5))))
    assert {r[0]: r[2].day for r in begun.collect()} == {"a": 1, "b": 5}
    assert {r[0]: r[2].day for r in upkeep.complete_cycles(begun, frame(("b", "m", at(7)))).collect()} == {"a": 1, "b": 7}
    with pytest.raises(Exception, match="no cursor"):
        upkeep.complete_cycles(begun, frame(("c", "m", at(7)))).where(F.col("minimum_first_seen_at").isNotNull()).collect()


def test_details_of_a_small_file_are_read_by_many_tasks(spark):
    """A table of few bytes is one split, so one task had all its pages."""
    pages = spark.range(200).selectExpr("id", "concat('# Title\nbody ', id, ' [x](https://robota.ua/company1/vacancy', id, ')') as markdown").coalesce(1)
    tasks = postings.markdown_details(pages).select(F.spark_partition_id().alias("task")).distinct().count()
    assert tasks > 1


def test_links_of_a_small_file_are_read_by_many_tasks(spark, capsys):
    pages = spark.range(200).selectExpr("id", "concat('[x](https://robota.ua/company1/vacancy', id, ')') as markdown").coalesce(1)
    links = postings.markdown_links(pages, "id")
    links.explain()
    assert links.count() == 200 and "RoundRobinPartitioning" in capsys.readouterr().out


def test_feed_filters_are_read_once_by_many_tasks(spark, capsys):
    """A URL was taken apart again for each of its filters' keys, and by one task."""
    url = F.lit("https://x.example/rss/?exp_level=1y&country=UKR&exp_level=99y&country=uk&other=1&exp_level=&editorial=nonhr&exp_level=2y&exp_level=3y&exp_level=4y")
    found = spark.range(1).select(urls.feed_identity(url, ()).alias("f"))
    assert found.first()["f"]["filters"] == {"exp_level": ["1y", "redacted", "2y", "3y"], "country": ["UKR", "redacted"], "editorial": ["nonhr"]}
    found.explain(True)
    assert capsys.readouterr().out.partition("== Optimized")[0].count("substring_index(") <= 4  # in two plans
    QUERIES["f42_feed_identity"](spark, "/root/testdata/sf0.001").explain()
    assert "RoundRobinPartitioning" in capsys.readouterr().out
