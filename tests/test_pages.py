"""Pages by pruning: the same rows as numbering everything, and only the days they are on."""

import datetime as dt
import re

import pytest

from platenlog.operators import catalogue
from platenlog.plans.session import work_path
from platenlog.sources import pages

FILES = "session_id STRING, file_name STRING, size_bytes BIGINT, modified TIMESTAMP, day STRING"


def listing(spark):
    """A session over 40 days, one of a single hot day with ties, small ones, and files without a time."""
    start = dt.datetime(2024, 1, 1, 23, 30)
    rows = [("long", f"l{i:03d}", i, start + dt.timedelta(hours=11 * i)) for i in range(90)]
    rows += [("hot", f"h{i:03d}", i, start + dt.timedelta(seconds=i // 7)) for i in range(300)]
    rows += [("small", "a", 1, start), ("small", "b", None, None), ("small", "c", 3, None), ("none", "x", 1, None)]
    rows += [("five", f"f{i}", i, start + dt.timedelta(days=i)) for i in range(5)]
    return spark.createDataFrame([(*r, "clash") for r in rows], FILES)


@pytest.fixture(scope="module")
def laid(spark):
    files = listing(spark).drop("day").cache()
    path = work_path(spark, "listing")
    pages.write_listing(listing(spark), path)
    return files, path


def rows_of(frame):
    return sorted(
        (r.session_id, r.position, r.page, r.file_name, r.size_bytes, r.modified, r.files, r.pages) for r in frame.collect()
    )


@pytest.mark.parametrize("k, size", [(0, 5), (1, 5), (17, 5), (18, 5), (59, 5), (400, 5), (0, 1), (2, 40), (0, 1000)])
def test_same_as_numbering_all(spark, laid, k, size):
    files, path = laid
    got = pages.read_page(spark, path, k, size)
    assert rows_of(got) == rows_of(catalogue.page(files, k, size))
    one = pages.read_page(spark, path, k, size, ["long", "none", "no such"])
    assert rows_of(one) == [r for r in rows_of(got) if r[0] in ("long", "none")]


def scanned(spark, path, k, sessions):
    """Days and files that the scan of the listing opens for a page."""
    needed = pages.page_days(spark.read.parquet(f"{path}/index").where("session_id in ('%s')" % "','".join(sessions)), k)
    held = pages._files(spark, path, "string").where(pages._on(needed))
    text = held._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*day", text)
    return {f.split("day=")[1].split("/")[0] for f in held.inputFiles()}, {r.day for r in held.select("day").distinct().collect()}


def test_days_read(spark, laid):
    _, path = laid
    index = spark.read.parquet(f"{path}/index")
    assert index.count() == len({(r.session_id, r.day) for r in index.collect()})
    # Five files eleven hours apart are on at most four days, however deep the page.
    for k in (0, 7, 17):
        _, days = scanned(spark, path, k, ["long"])
        assert 2 <= len(days) <= 4
    assert len(scanned(spark, path, 3, ["hot"])[1]) == 1
    assert scanned(spark, path, 0, ["none"])[1] == {None}


def test_empty_listing(spark):
    path = work_path(spark, "listing")
    pages.write_listing(listing(spark).limit(0), path)
    assert pages.read_page(spark, path, 0).count() == 0
    with pytest.raises(Exception, match="exists"):
        pages.write_listing(listing(spark).limit(0), path)
