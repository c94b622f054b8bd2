"""Inputs derived from small tables that the tests build themselves, held against the SQL."""

import re

from pyspark.sql import functions as F
import pytest

from compare import difference
from jobfleet.operators import reports
from jobfleet.plans.attach import attach_lookup
from jobfleet.plans.detach import detach_lookup, detach_walk, removal_records
from jobfleet.queries import oracle, registry, tables
from jobfleet.schemas import HOST
from jobfleet.sources import bundles
from jobfleet.staging import stage

COLUMNS = {
    "region": "r_regionkey long",
    "nation": "n_nationkey long, n_regionkey long",
    "customer": "c_custkey long, c_nationkey long, c_mktsegment string",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string",
    "lineitem": "l_orderkey long, l_linenumber int, l_suppkey long, l_returnflag string, l_linestatus string",
}
ROWS = {
    "region": [(i,) for i in range(4)],
    "nation": [(i, i % 3) for i in range(6)],  # region 3 has no jobs
    "customer": [(i, i % 6, "BUILDING" if i % 2 else "FURNITURE") for i in range(30)],
    "orders": [(i, i * 7 % 31, "FOP"[i % 3], ("1-URGENT", "2-HIGH")[i % 2]) for i in range(200)],  # customer 30 is not there
    "lineitem": [(i // 3, i % 5, i % 11, "ANR"[i % 3 if i % 4 else 2], "FO"[i % 2]) for i in range(560)] * 2,
}


@pytest.fixture
def small_tables(spark, tmp_path):
    for table, rows in ROWS.items():
        spark.createDataFrame(rows, COLUMNS[table]).write.parquet(f"{tmp_path}/{table}.parquet")
    return str(tmp_path)


@pytest.fixture
def con(small_tables):
    import duckdb

    made = duckdb.connect()
    for table in ROWS:
        made.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{small_tables}/{table}.parquet/*.parquet')")
    return made


def test_run_stats_cover_the_jobs_of_every_workspace(spark, small_tables, con):
    stats = registry.queries()["run_stats_all_workspaces"](spark, small_tables)
    scanned = {row[HOST]: row["scanned"] for row in stats.collect()}
    known = {i: n % 3 for i, n, _ in ROWS["customer"]}
    regions = [known[customer] for _, customer, _, _ in ROWS["orders"] if customer in known]
    assert scanned == {f"ws-{region}": regions.count(region) for region in range(4)}
    assert scanned["ws-3"] == 0 < min(scanned["ws-0"], scanned["ws-1"], scanned["ws-2"])
    assert difference(stats, con, oracle.oracle_sql()["run_stats_all_workspaces"]) is None


def shuffled(frame):
    """The columns that each shuffle of the plan carries."""
    plan = frame._jdf.queryExecution().explainString(
        frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    return re.findall(r"\) Exchange[^\n]*\nInput \[[0-9]+\]: \[([^\n]*)\]", plan)


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_jobs_are_dealt_while_they_are_narrow(spark, small_tables, con, no_broadcast):
    stored = tables._dealt_jobs(spark, small_tables)
    carried = shuffled(stored)
    assert sum("l_linenumber" in columns or "codes" in columns for columns in carried) == 2  # to their order, to their workspace
    assert not any("settings" in columns or "webhook" in columns for columns in carried)
    sql = oracle._with(oracle.JOBS, body=f"SELECT workspace_host, job_id, {oracle.NAME} AS name, {oracle._flat_all()} FROM jobs")
    named = registry.flat_snapshot(tables.jobs(spark, small_tables))
    named = named.withColumn("name", F.when(F.col("name") == "", "<unnamed>").otherwise(F.col("name")))
    assert difference(named, con, sql) is None


def test_lookups_shuffle_lists_only_for_plans(spark, small_tables, no_broadcast):
    jobs = tables.jobs(spark, small_tables)
    ids = stage(spark.range(300).select(F.col("id").alias("job_id"), F.col("id").alias("pos")), "ids")
    results = jobs.select(HOST, "job_id", (F.col("job_id") % 3 != 0).alias("ok"))
    run = attach_lookup(jobs, ids, ["ws-0", "ws-1"], "wh-3", limit=5, results=results)
    for frame in (reports.attach_run_stats(run.found), run.miss_counts(), run.misses()):
        assert not any("notifications" in c or "settings" in c for c in shuffled(frame))
    missing = detach_lookup(jobs, ids, ["ws-0", "ws-1"], "wh-3").misses()
    assert not any(c.startswith(HOST) and "pos" in c for c in shuffled(missing))  # no row per id and workspace
    found = {(x[HOST], x["job_id"]) for x in jobs.collect()}
    want = {(h, i) for h in ("ws-0", "ws-1") for i in range(300)} - found
    assert {(x[HOST], x["job_id"]) for x in missing.collect()} == want


def test_a_removal_log_shuffles_no_lists(spark, small_tables, no_broadcast):
    jobs = tables.jobs(spark, small_tables)
    results = jobs.select(HOST, "job_id", F.lit(True).alias("ok"))
    plan = detach_walk(jobs, "wh-3", bundle_jobs="include", results=results)
    records = removal_records(plan, None, F.lit("2024-01-01").cast("timestamp"))
    assert not any("notifications" in columns or "settings" in columns for columns in shuffled(records))


def test_bundle_files_are_written_and_read_in_tasks_by_their_number(spark, tmp_path, monkeypatch):
    parts = [(i, f"name {i}", f"Brand#{i % 3}", "ECONOMY", i % 9) for i in range(700)]
    schema = "p_partkey long, p_name string, p_brand string, p_type string, p_size int"
    spark.createDataFrame(parts, schema).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    monkeypatch.setattr(tables, "PARTS_OF_A_TASK", 100)
    made = tables.bundle_files(spark, str(tmp_path))
    assert made.rdd.getNumPartitions() >= 7  # a small table is one split, and its files are much work

    folder = f"{tmp_path}/bundles"
    path = F.concat(F.translate("bundle", "#", "-"), F.lit("/"), F.col("path"))
    tables.write_files(made.withColumn("path", path), folder, "")
    (tmp_path / "bundles" / "Brand-1" / "_hidden.yml").write_text("a: 1")
    (tmp_path / "bundles" / "Brand-1" / "empty.yml").write_text("")
    (tmp_path / "bundles" / "Brand-1" / "other.txt").write_text("a: 1")
    tasks = []
    spied = bundles._list_files
    monkeypatch.setattr(bundles, "_list_files", lambda *a: tasks.append(a) or spied(*a))
    monkeypatch.setattr(bundles, "FILES_OF_A_TASK", 100)
    found = bundles.read_bundle_files(spark, folder)
    assert len(tasks) == 1 and len(found.inputFiles()) <= 8  # not a task for every 32 files
    want = {(r.bundle.replace("#", "-"), r.path, r.content) for r in made.collect()}
    assert {tuple(r) for r in found.select("bundle", "path", "content").collect()} == want
    assert len(want) == 703


def test_many_line_items_are_dealt_to_tasks_by_their_number(spark, small_tables, con, monkeypatch):
    monkeypatch.setattr(tables, "LINES_OF_A_TASK", 20, raising=False)
    made = tables.derive_jobs(spark, small_tables)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(l_orderkey#\d+L, 56\), REPARTITION_BY_NUM", plan)  # 1,120 line items
    sql = oracle._with(oracle.JOBS, body=f"SELECT workspace_host, job_id, {oracle.NAME} AS name, {oracle._flat_all()} FROM jobs")
    named = registry.flat_snapshot(stage(made, "dealt-jobs"))
    named = named.withColumn("name", F.when(F.col("name") == "", "<unnamed>").otherwise(F.col("name")))
    assert difference(named, con, sql) is None
