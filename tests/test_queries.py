"""Every registered query against its SQL, and the plans of those that must scale."""

import re

import pytest

import __spark_entry__ as entry
from platenlog.operators import attributes, catalogue, rollups
from platenlog.operators.admission import admission
from platenlog.operators.jobs import assign_job_ids
from platenlog.operators.presence import presence_intervals
from platenlog.plans import reports
from platenlog.plans.requests import request_log
from platenlog.sources.devices import device_snapshots
from platenlog.streaming.admission import judged_messages
from tests.compare import database, difference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    return database(SF)


@pytest.mark.parametrize("name", sorted(reports.REPORTS))
def test_query(spark, tables, name):
    got = entry.queries()[name](spark, SF).toPandas()
    assert len(got) > 0
    assert difference(got, tables.sql(entry.oracle_sql()[name]).df()) is None


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.count() == 76 and "file_name" in rows.columns


def test_expected_statuses(spark):
    """Counts of the whole rule set on the two larger scales, as the fixtures state them."""
    for sf, want in {
        "0.01": {0: 678, 0x0400: 34, 0x040A: 172, 0x0500: 16, 0x0501: 100},
        "0.1": {0: 6776, 0x0400: 343, 0x040A: 1715, 0x0500: 166, 0x0501: 1000},
    }.items():
        log = admission(request_log(spark, f"/root/testdata/sf{sf}"))
        assert {r.status: r["count"] for r in log.groupBy("status").count().collect()} == want


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    log = request_log(spark, SF)
    files = reports.files_of(spark, SF)
    frames = {
        "rollup": rollups.request_rollup(admission(log)),
        "ids": assign_job_ids(log),
        "lookup": reports.lookup_report(spark, SF),
        "attributes": reports.attribute_query(spark, SF),
        "page": catalogue.page(files, 0),
        "numbers": catalogue.page_numbers(files),
        "presence": presence_intervals(reports.announcements(spark, SF)),
        "first": attributes.first_value(reports.attribute_rows(spark, SF), "job-name", [0x42], "Untitled"),
        "groups": attributes.group_values(reports.token_rows(spark, SF)),
        "judged": judged_messages(reports.damaged(spark, SF)),
    }
    for name, frame in frames.items():
        text = plan(frame)
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name
        assert "SinglePartition" not in text, name
    # Pre-aggregated before the shuffle.
    assert re.search(r"Exchange hashpartitioning\(op_code.*\n.*partial_count", plan(frames["rollup"]))
    assert "partial_min" in plan(frames["presence"]) and "partial_min_by" in plan(frames["first"])
    # Look-ups by message: one scan, no join.
    for name in ("first_value", "first_group", "requested_attributes"):
        text = plan(getattr(reports, name)(spark, SF))
        assert text.count("FileScan") == 1 and "Join" not in text, name
    # Texts are read once, when the slim log is written; what follows reads that.
    for name in ("job_registry", "job_lookup", "print_answers", "newest_page", "id_gaps"):
        assert "documents.parquet" not in plan(reports.REPORTS[name](spark, SF)), name
    # No window over the rows of a whole session: a block is part of the key.
    ids = plan(frames["ids"])
    assert re.search(r"windowspecdefinition\(session_id#\d+, _block#\d+L, seq", ids)
    assert not re.search(r"windowspecdefinition\(session_id#\d+, seq", ids)
    # Unread columns stay unread.
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint>" in plan(frames["presence"])
    devices = reports.devices_of(spark, SF, "customer", "c_custkey", "c_name")
    assert "c_acctbal" not in plan(attributes.attribute_query(reports.asking_rows(spark, SF), device_snapshots(devices)))


def test_device_arrays_are_not_broadcast(spark):
    answers = reports.attribute_query(spark, SF)
    answers.collect()
    joins = re.findall(r"\w+Join.* \[device_id.*", plan(answers).split("Initial Plan")[0])
    assert len(joins) == 1 and "SortMergeJoin" in joins[0]
