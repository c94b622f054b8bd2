import pytest
from pyspark.sql import functions as F

import expected as ex
from conftest import fleet, random_jobs
from jobfleet.operators import caps
from jobfleet.operators.walk import matched_jobs, walk

HOSTS = ("h1", "h2", "h3")


@pytest.fixture(params=["ranked", "bucketed"])
def method(request, monkeypatch):
    """Both ways to find a stop; buckets of five ordinals make many ranges."""
    if request.param == "bucketed":
        monkeypatch.setattr(caps, "RANKED_ROWS", 0)
        monkeypatch.setattr(caps.stop_ordinals, "__defaults__", ("scan_ordinal", 5))


@pytest.fixture(scope="module")
def rows():
    return random_jobs(3, 150)


@pytest.mark.parametrize("n", [1, 17, 10_000])
def test_stop_is_the_nth_ordinal(spark, rows, method, n):
    found = {r.workspace_host: r.stop_ordinal for r in caps.stop_ordinals(fleet(spark, rows), n).collect()}
    expected = {}
    for host in HOSTS:
        ordinals = sorted(r[1] for r in rows if r[0] == host)
        if len(ordinals) >= n:
            expected[host] = ordinals[n - 1]
    assert found == expected


@pytest.mark.parametrize("scan_limit", [0, 2, 30, 1000, None])
def test_scan_cap_processes_one_row_less(spark, rows, method, scan_limit):
    found = sorted(r.job_id for r in matched_jobs(fleet(spark, rows), scan_limit=scan_limit).collect())
    upto = None if scan_limit is None else max(scan_limit - 1, 0)
    assert found == sorted(f.job_id for host in HOSTS for f in ex.listed(rows, host)[:upto])


@pytest.mark.parametrize("scan_limit", [None, 1, 12, 500])
def test_walk_counts(spark, rows, method, scan_limit):
    scope = {"tag": "team", "owners": ["ann", ""], "name_filter": "etl", "scan_limit": scan_limit}
    for keep_all in (False, True):
        counts = (
            walk(fleet(spark, rows), **scope, keep_all=keep_all)
            .groupBy("workspace_host")
            .agg(F.count_if("scanned").alias("scanned"), F.count_if("matched").alias("matched"))
        )
        found = {r.workspace_host: (r.scanned, r.matched) for r in counts.collect()}
        for host in HOSTS:
            _, scanned, matched = ex.run(rows, host, lambda j: True, attaching=True, **scope)
            assert found[host] == (scanned, matched)


def test_scan_cap_counts_rows_the_filters_reject(spark, rows):
    kept = matched_jobs(fleet(spark, rows), tag="team=a", scan_limit=10)
    expected = sum(
        ex.run(rows, host, lambda j: True, attaching=True, tag="team=a", scan_limit=10)[2] for host in HOSTS
    )
    assert kept.count() == expected


def test_a_hot_workspace_is_not_ranked_in_one_task(spark):
    """With buckets, only the range that holds the stop is ever sorted."""
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("h"), F.col("id") % 50)).alias("workspace_host"),
        F.col("id").alias("scan_ordinal"),
    )
    stops = caps.stop_ordinals(rows, 5_000, bucket_rows=1_000).collect()
    assert [(r.workspace_host, r.stop_ordinal) for r in stops] == [("hot", 3 * 4_999)]


def test_sparse_ordinals_make_a_bounded_number_of_ranges(spark, monkeypatch):
    """Powers and clusters far apart: each cut has at most ``RANGES`` ranges a workspace."""
    values = sorted({2**k for k in range(60)} | {2**50 + i for i in range(3000)} | {7 * i for i in range(2000)})
    rows = spark.createDataFrame([("h", v) for v in values], "workspace_host string, scan_ordinal long")
    counted = []
    real = caps.stage
    monkeypatch.setattr(caps, "stage", lambda df, name: counted.append((name, out := real(df, name))) or out)
    for n in (101, 2100, 4999, len(values)):
        counted.clear()
        assert caps.stop_ordinals(rows, n, bucket_rows=50).first().stop_ordinal == values[n - 1]
        assert len(counted) < 12 and all(df.count() <= 1 for name, df in counted if name == "spans")


def test_a_capped_plan_has_the_run_only_unless_all_is_kept(spark, rows):
    jobs = fleet(spark, rows)
    run = caps.mutation_cap(walk(jobs).withColumn("outcome", F.lit("would_update")), 3, F.lit(True), F.lit(True))
    assert run.groupBy("workspace_host").count().filter("count <> 3").isEmpty()
    kept = caps.mutation_cap(
        walk(jobs).withColumn("outcome", F.lit("would_update")), 3, F.lit(True), F.lit(True), keep_all=True
    )
    assert kept.count() == jobs.count() and kept.filter("outcome is not null").count() == 9
