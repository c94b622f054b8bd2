import random

import pytest
from pyspark.sql import functions as F

import expected as ex
from conftest import block, fleet, job, random_jobs
from jobfleet.operators import caps
from jobfleet.operators import destinations as dest
from jobfleet.operators import reports as r
from jobfleet.operators.walk import matched_jobs
from jobfleet.plans.attach import attach_by_id, attach_lookup, attach_walk
from jobfleet.plans.detach import bundle_report, detach_by_id, detach_walk, removal_records
from jobfleet.plans.inventory import inventory_rows
from jobfleet.plans.updates import apply_changes, changes, next_snapshot
from jobfleet.schemas import DEFAULT_EVENTS, DESTINATIONS, EVENT_FIELDS, METADATA, UPDATE_RESULTS
from jobfleet.sources.job_ids import merge_job_ids
from test_notifications import lists

HOSTS = ("h1", "h2", "h3")


@pytest.fixture(scope="module")
def rows():
    return random_jobs(11, 240)


@pytest.fixture(scope="module")
def jobs(spark, rows):
    return fleet(spark, rows)


@pytest.fixture(scope="module")
def results(spark, rows):
    return spark.createDataFrame([(r[0], r[2], r[2] % 5 != 0) for r in rows], UPDATE_RESULTS)


def fails(rows):
    return {r[2] for r in rows if r[2] % 5 == 0}


def outcomes(plan):
    return {
        (x.workspace_host, x.job_id): x.outcome
        for x in plan.filter("outcome IS NOT NULL").select("workspace_host", "job_id", "outcome").collect()
    }


SCOPES = [
    {},
    {"limit": 0},
    {"limit": 1},
    {"limit": 6},
    {"limit": 500},
    {"scan_limit": 30, "limit": 5},
    {"scan_limit": 12},
    {"tag": "team", "owners": ["ann", "bob"], "name_filter": "etl", "limit": 3},
]


@pytest.mark.parametrize("applied, scope", [(i % 2 == 0, s) for i, s in enumerate(SCOPES)], ids=str)
def test_attach_walk(spark, rows, jobs, results, scope, applied):
    plan = attach_walk(jobs, "x", results=results if applied else None, **scope).cache()
    stats = {s.workspace_host: s for s in r.attach_run_stats(plan).collect()}
    found = outcomes(plan)
    for host in HOSTS:
        expected, scanned, matched = ex.run(
            rows, host, lambda j: not ex.attached(j, "x", DEFAULT_EVENTS), attaching=True,
            applied=applied, fails=fails(rows), **scope,
        )
        assert {k[1]: v for k, v in found.items() if k[0] == host} == expected
        if host in stats:
            assert (stats[host].scanned, stats[host].matched) == (scanned, matched)
            assert stats[host].errored == list(expected.values()).count("errored")


DETACHES = [
    ("skip", {}, True), ("skip", {"limit": 0}, False), ("skip", SCOPES[7], True), ("include", {}, False),
    ("include", {"limit": 1}, False), ("include", {"limit": 6}, True), ("include", {"scan_limit": 12}, True),
    ("only", {"limit": 500}, True), ("only", {"scan_limit": 30, "limit": 5}, False),
]


@pytest.mark.parametrize("policy, scope, applied", DETACHES, ids=str)
def test_detach_walk(spark, rows, jobs, results, policy, scope, applied):
    plan = detach_walk(jobs, "x", bundle_jobs=policy, results=results if applied else None, **scope).cache()
    stats = {s.workspace_host: s for s in r.detach_run_stats(plan).collect()}
    found = outcomes(plan)
    for host in HOSTS:
        expected, scanned, matched = ex.run(
            rows, host, lambda j: ex.removal(j, "x").count, attaching=False, policy=policy,
            applied=applied, fails=fails(rows), **scope,
        )
        assert {k[1]: v for k, v in found.items() if k[0] == host} == expected
        if host in stats:
            assert (stats[host].scanned, stats[host].matched) == (scanned, matched)
            assert stats[host].bundle_skipped == list(expected.values()).count("bundle_skipped")


def test_capped_runs_agree_however_the_stop_is_found(jobs, monkeypatch):
    ranked = outcomes(attach_walk(jobs, "x", scan_limit=40, limit=7))
    monkeypatch.setattr(caps, "RANKED_ROWS", 0)
    monkeypatch.setattr(caps.stop_ordinals, "__defaults__", ("scan_ordinal", 3))
    assert outcomes(attach_walk(jobs, "x", scan_limit=40, limit=7)) == ranked


def test_detach_details(rows, jobs):
    plan = detach_walk(jobs, "x", bundle_jobs="include").filter("outcome = 'would_update'").collect()
    facts = {row[2]: ex.fact(row) for row in rows}
    assert plan
    for p in plan:
        gone = ex.removal(facts[p.job_id], "x")
        assert lists(p.new_notifications) == gone.lists
        assert (p.removed_count, p.webhook_ids_removed, p.events_affected) == (gone.count, gone.ids, gone.events)
        assert p.bundle_warning == facts[p.job_id].is_bundle


def ids_frame(spark, ids):
    return spark.createDataFrame(list(zip(ids, range(len(ids)))), "job_id long, pos long")


@pytest.mark.parametrize("limit", [None, 0, 1, 4])
def test_attach_by_id(spark, rows, jobs, results, limit):
    ids = [3, 9999, 0, 50, 7, 12, 120, 5, 77, 200, 31]
    plan = attach_by_id(jobs, ids_frame(spark, ids), HOSTS, "x", limit=limit, results=results).cache()
    found = outcomes(plan)
    all_stats = {s.workspace_host: s for s in r.attach_run_stats(plan).collect()}
    for host in HOSTS:
        known = {f.job_id: f for f in ex.listed(rows, host)}
        rules = [
            ("lookup_failed", lambda i: i not in known),
            ("bundle_skipped", lambda i: known[i].is_bundle),
            ("already_attached", lambda i: ex.attached(known[i], "x", DEFAULT_EVENTS)),
            ("errored", lambda i: i in fails(rows)),
            ("updated", lambda i: True),
        ]
        full = {i: next(name for name, holds in rules if holds(i)) for i in ids}
        last = [k for k in range(len(ids)) if limit is not None and list(full.values())[: k + 1].count("updated") >= limit]
        expected = dict(list(full.items())[: last[0] + 1 if last else None])
        assert {k[1]: v for k, v in found.items() if k[0] == host} == expected
        stats = all_stats[host]
        values = list(expected.values())
        assert (stats.scanned, stats.matched) == (len(values), len(values) - values.count("lookup_failed"))
        assert stats.errored == values.count("errored") + values.count("lookup_failed")


@pytest.mark.parametrize("limit", [None, 0, 1, 4, 900])
@pytest.mark.parametrize("ids", [[9999, 3, 0, 50, 7, 9998, 12, 120, 5, 77, 200, 31], [9999, 9998], []])
def test_counted_misses_are_those_listed(spark, jobs, results, limit, ids, monkeypatch):
    monkeypatch.setattr("jobfleet.operators.order.WIDTH", 3)
    listed = attach_by_id(jobs, ids_frame(spark, ids), HOSTS, "x", limit=limit, results=results)
    run = attach_lookup(jobs, ids_frame(spark, ids), HOSTS, "x", limit=limit, results=results)
    counted = r.with_misses(r.attach_run_stats(run.found), run.miss_counts())
    want = {tuple(s) for s in r.attach_run_stats(listed).collect()}
    assert {tuple(s) for s in counted.collect() if s.scanned} == want
    assert run.found.filter("outcome = 'lookup_failed'").isEmpty()
    missed = {(m.workspace_host, m.job_id) for m in run.misses().collect()}
    assert missed == {(p.workspace_host, p.job_id) for p in listed.filter("not matched").collect()}


@pytest.mark.parametrize("webhook_id", ["x", "", None])
def test_detach_by_id(spark, rows, jobs, webhook_id):
    ids = list(range(0, 260, 3))
    plan = detach_by_id(jobs, ids_frame(spark, ids), HOSTS, webhook_id)
    found = {(p.workspace_host, p.job_id): p for p in plan.collect()}
    for host in HOSTS:
        known = {f.job_id: f for f in ex.listed(rows, host)}
        for job_id in ids:
            got = found[host, job_id]
            if job_id not in known:
                assert got.outcome == "lookup_failed"
                continue
            gone = ex.removal(known[job_id], webhook_id)
            assert got.outcome == ("would_update" if gone.count else "nothing_to_remove")
            assert got.bundle_warning == known[job_id].is_bundle
            if gone.count:
                assert (lists(got.new_notifications), got.webhook_ids_removed) == (gone.lists, gone.ids)


def snapshot_lists(snapshot):
    found = snapshot.select("job_id", F.col("settings.webhook_notifications").alias("w")).collect()
    return {x.job_id: lists(x.w) for x in found}


def test_attaching_twice_changes_nothing(jobs):
    once = next_snapshot(attach_walk(jobs, "new", keep_all=True))
    second = attach_walk(once, "new", keep_all=True)
    assert set(outcomes(second).values()) == {"already_attached", "bundle_skipped"}
    assert snapshot_lists(next_snapshot(second)) == snapshot_lists(once)


def test_detach_after_attach_removes_the_id_everywhere(jobs):
    attached = next_snapshot(attach_walk(jobs, "new", events=EVENT_FIELDS, keep_all=True))
    after = next_snapshot(detach_walk(attached, "new", bundle_jobs="include", keep_all=True))
    assert not any("new" in ids for w in snapshot_lists(after).values() for ids in (w or {}).values())
    again = detach_walk(after, "new", bundle_jobs="include")
    assert set(outcomes(again).values()) == {"nothing_to_remove"}


def test_next_snapshot_keeps_every_other_job_as_it_was(rows, jobs):
    plan = attach_walk(jobs, "new", name_filter="etl", limit=5, keep_all=True)
    changed = {k[1] for k, v in outcomes(plan).items() if v == "would_update"}
    before = {x.job_id: x for x in jobs.collect()}
    after = {x.job_id: x for x in next_snapshot(plan).select(*jobs.columns).collect()}
    assert len(changed) == 15 and before.keys() == after.keys()
    for job_id, row in after.items():
        if job_id in changed:
            assert [w.id for w in row.settings.webhook_notifications.on_failure][-1] == "new"
            assert row.settings.name == (before[job_id].settings and before[job_id].settings.name)
        else:
            assert row == before[job_id]


def test_stored_changes_give_the_same_snapshot(jobs):
    plan = detach_walk(jobs, "x", bundle_jobs="include", keep_all=True)
    assert snapshot_lists(apply_changes(jobs, changes(plan))) == snapshot_lists(next_snapshot(plan))


def test_emptied_lists_are_cleared_in_the_next_snapshot(spark):
    jobs = fleet(spark, [job(1, hooks=block(on_start=["x", "x"], on_failure=["y"]))])
    plan = detach_walk(jobs, "x", keep_all=True)
    assert lists(plan.first().new_notifications) == {"on_start": [], "on_failure": ["y"]}
    assert snapshot_lists(next_snapshot(plan)) == {1: {"on_failure": ["y"]}}


def test_each_workspace_gets_its_own_destination(spark):
    jobs = fleet(spark, [job(1, host="a"), job(2, host="b")])
    listed = spark.createDataFrame(
        [("a", 5, "a-late", "hook", "W"), ("a", 2, "a-first", "hook", "W"), ("a", 1, "a-other", "Hook", "W"),
         ("b", 9, "b-only", "hook", None)],
        DESTINATIONS,
    )
    resolved = dest.resolve_destination(listed, "hook")
    plan = attach_walk(dest.with_destination(jobs, resolved), F.col("webhook_id"), events="on_start")
    found = {p.workspace_host: lists(p.new_notifications) for p in plan.collect()}
    assert found == {"a": {"on_start": ["a-first"]}, "b": {"on_start": ["b-only"]}}

    hosts = spark.createDataFrame([("a",), ("b",), ("c",)], "workspace_host string")
    with pytest.raises(dest.MissingDestinations, match="1 workspace.*'c'"):
        dest.require_destination(hosts, resolved, "hook")
    dest.require_destination(hosts.filter("workspace_host <> 'c'"), resolved, "hook")
    for apply, action in ((False, "would_create"), (True, "create")):
        created = dest.create_destination_plan(hosts, resolved, name="hook", url="https://h", apply=apply)
        assert {(x.workspace_host, x.action, x.destination_type) for x in created.collect()} == {
            ("a", "exists", "W"), ("b", "exists", "?"), ("c", action, None),
        }


def test_arguments_are_checked(spark, jobs):
    ids = ids_frame(spark, [1])
    for bad in (
        lambda: attach_walk(jobs, ""),
        lambda: attach_walk(jobs, None),
        lambda: attach_walk(jobs, "x", events="on_retry"),
        lambda: detach_walk(jobs, None),
        lambda: detach_walk(jobs, ""),
        lambda: detach_walk(jobs, "x", bundle_jobs="all"),
        lambda: attach_by_id(jobs, ids, HOSTS, "x", tag="a"),
        lambda: detach_by_id(jobs, ids, HOSTS, "x", owners=["ann"]),
    ):
        with pytest.raises(ValueError):
            bad()


META = [("/b/1", "one", "prod", "g", "br", "c", "root", "files")]


def test_inventory_rows_have_no_nulls_and_direct_rows_no_path(spark, rows, jobs):
    metadata = spark.createDataFrame(META, METADATA)
    found = {x.job_id: x for x in inventory_rows(matched_jobs(jobs), F.lit("2024-01-01"), metadata).collect()}
    for row in rows:
        model, got = ex.fact(row), found[row[2]]
        assert None not in tuple(got)
        assert got.name == (model.name or "<unnamed>") and got.creator == (model.creator or "")
        assert got.deployment_kind == ("BUNDLE" if model.is_bundle else "DIRECT")
        assert got.metadata_file_path == ((model.path or "") if model.is_bundle else "")
        assert got.bundle_name == ("one" if model.is_bundle and model.path == "/b/1" else "")


def test_top_creators_break_ties_by_first_encounter(spark):
    rows = [job(1, creator="b"), job(2, creator="a"), job(3, creator=None), job(4, creator="")]
    found = r.top_creators(fleet(spark, rows), 2).orderBy("position").collect()
    assert [(x.creator, x.jobs) for x in found] == [("<unknown>", 2), ("b", 1)]
    assert r.top_creators(fleet(spark, rows), 0).count() == 0


@pytest.mark.parametrize("n", [3, 40, 10_000])
def test_top_of_any_length_is_one_order(spark, monkeypatch, n):
    """Ranked over many tasks, with sparse ordinals and half of the labels met once, as in one window."""
    rng = random.Random(n)
    names = [f"c{min(int(rng.expovariate(0.05)), rng.randrange(1, 400))}" for _ in range(600)] + [f"once{k}" for k in range(300)]
    rng.shuffle(names)
    rows = [job(k, host="h1" if k % 3 else f"h{k % 7}", ordinal=k << 40, creator=c) for k, c in enumerate(names)]
    jobs = fleet(spark, rows)
    want = sorted(tuple(x) for x in r.top_creators(jobs, n).collect()) if n <= r.RANKED_ROWS else None
    monkeypatch.setattr(r, "RANKED_ROWS", 0)
    top = r.top_creators(jobs, n)
    got = sorted(tuple(x) for x in top.collect())
    if want is None:
        want = []
        for host in {x[0] for x in rows}:
            met = [x[3] for x in rows if x[0] == host]
            order = sorted(set(met), key=lambda c: (-met.count(c), met.index(c)))
            want += [(host, c, met.count(c), k) for k, c in enumerate(order, 1)]
        want.sort()
    assert got == want


def test_summary_shares(spark):
    rows = [job(i, kind="BUNDLE" if i < 71 else None) for i in range(184)]
    s = r.inventory_summary(matched_jobs(fleet(spark, rows))).first()
    assert (s.total, s.bundle, s.direct) == (184, 71, 113)
    assert (f"{s.bundle_pct:.1f}", f"{s.direct_pct:.1f}") == ("38.6", "61.4")


def test_workspaces_without_jobs_count_zero(spark):
    hosts = spark.createDataFrame([("h1",), ("h9",)], "workspace_host string")
    summary = r.every_workspace(r.inventory_summary(matched_jobs(fleet(spark, [job(1)]))), hosts)
    rows = {x.workspace_host: (x.total, x.bundle_pct, x.direct_pct) for x in summary.collect()}
    assert rows == {"h1": (1, 0.0, 100.0), "h9": (0, 0.0, 0.0)}


def test_removal_records_and_bundle_report(spark):
    hooks = block(on_start=["x"], on_failure=["y", "x", "x"])
    rows = [
        job(1, kind="BUNDLE", path="/b/1", hooks=hooks), job(2, kind="MANUAL", path="/b/1", hooks=hooks, name=""),
        job(3, hooks=hooks, creator=None), job(4, kind="BUNDLE", path="/b/9", hooks=None),
    ]
    jobs = fleet(spark, rows)
    metadata = spark.createDataFrame(META, METADATA)
    ok = spark.createDataFrame([("h1", 1, True), ("h1", 2, True), ("h1", 3, False)], UPDATE_RESULTS)
    when = F.lit("2024-05-01 00:00:00")
    plan = detach_walk(jobs, "x", bundle_jobs="include", results=ok)
    log = {x.job_id: x for x in removal_records(plan, metadata, when).collect()}
    assert sorted(log) == [1, 2]
    assert (log[1].webhook_ids_removed, log[1].events_affected) == (["x"], ["on_start", "on_failure"])
    assert (log[1].bundle_name, log[1].is_bundle) == ("one", True)
    # A direct job keeps its path in the log but gets no bundle fields.
    assert (log[2].bundle_name, log[2].metadata_file_path, log[2].name) == ("", "/b/1", "<unnamed>")
    assert removal_records(detach_walk(jobs, "x"), metadata, when).count() == 0

    report = bundle_report(detach_walk(jobs, "x", bundle_jobs="skip"), metadata).orderBy("job_id").collect()
    assert [(x.job_id, x.bundle_name, x.metadata_file_path) for x in report] == [(1, "one", "/b/1"), (4, "", "/b/9")]


def test_failed_workspaces(jobs, results):
    stats = r.attach_run_stats(attach_walk(jobs, "new", results=results))
    assert r.run_failed(stats)
    assert {x.workspace_host for x in r.workspace_failures(stats).collect()} == set(HOSTS)
    assert not r.run_failed(r.attach_run_stats(attach_walk(jobs, "new")))


def test_ids_are_merged_in_order_of_first_mention(spark):
    listed = ids_frame(spark, [7, 5, 9, 7])
    merged = merge_job_ids(spark, [9, 2, 9], listed).orderBy("pos").collect()
    assert [x.job_id for x in merged] == [9, 2, 7, 5]
    assert len({x.pos for x in merged}) == 4
    assert merge_job_ids(spark, [4]).collect()[0].job_id == 4


def test_one_success_among_repeated_results_is_enough(spark, jobs):
    planned = attach_walk(jobs, "x").filter("outcome = 'would_update'").limit(2).collect()
    first, second = ((p.workspace_host, p.job_id) for p in planned)
    rows = [(*first, False), (*first, True), (*first, False), (*second, False), (*second, None)]
    plan = attach_walk(jobs, "x", results=spark.createDataFrame(rows, UPDATE_RESULTS), keep_all=True)
    assert plan.count() == jobs.count()
    found = outcomes(plan)
    assert (found[first], found[second]) == ("updated", "errored")
    twice = changes(plan).unionAll(changes(plan))
    assert apply_changes(jobs, twice).count() == jobs.count()


def test_a_path_listed_twice_leaves_one_row_per_job(spark, jobs):
    metadata = spark.createDataFrame(META + META, METADATA)
    rows = inventory_rows(matched_jobs(jobs), F.lit("2024-01-01"), metadata)
    assert rows.count() == matched_jobs(jobs).count()
