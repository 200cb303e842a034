"""Streams of a table that is a folder of files, as large tables are, or one file."""

import datetime

import pytest

from feldspark.plans import load_catalog

URLS = [f"http{'s' * (i % 2)}://{'cheap-' * (i % 3 == 0)}host{i}.example.org/{'a' * (i % 7)}" for i in range(60)]


@pytest.fixture(scope="module", params=["folder", "file"])
def tables(request, spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp(request.param)
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate([*URLS, "ftp://no.example.org"])], "page_id bigint, url string, html string")
    start = datetime.datetime(2024, 1, 1)
    events = spark.createDataFrame([(i, start + datetime.timedelta(minutes=7 * i), float(i)) for i in range(40)], "event_id bigint, ts timestamp_ntz, value double")
    for name, rows in (("pages", pages), ("events", events)):
        if request.param == "folder":
            rows.repartition(3).write.parquet(str(folder / f"{name}.parquet"))
        else:
            rows.toPandas().to_parquet(folder / f"{name}.parquet", coerce_timestamps="us")
    return str(folder)


def test_prediction_log_of_a_stream_has_every_accepted_page(spark, tables):
    made = load_catalog().QUERIES["stream_prediction_log"](spark, tables).collect()
    assert len(made) == len(URLS) and all(r["n"] == 1 and r["in_range"] and r["decided"] for r in made)


def test_streamed_scores_cover_every_accepted_page(spark, tables):
    made = load_catalog().QUERIES["stream_score"](spark, tables).collect()
    assert sorted(r["page_id"] for r in made) == list(range(len(URLS))) and all(r["equal"] for r in made)


def test_monitored_stream_has_every_hour(spark, tables):
    made = load_catalog().QUERIES["monitor_stream"](spark, tables).collect()
    assert sum(r["n"] for r in made) == 40


@pytest.mark.parametrize("name", ["stream_score", "stream_prediction_log", "batch_score"])
def test_pages_without_an_address_are_rejected(spark, tmp_path, name):
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate([*URLS, None, None])], "page_id bigint, url string, html string")
    pages.repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    made = load_catalog().QUERIES[name](spark, str(tmp_path)).collect()
    assert len(made) == len(URLS)
    assert all(r["equal"] if name == "stream_score" else r["in_range"] and r["decided"] for r in made)
