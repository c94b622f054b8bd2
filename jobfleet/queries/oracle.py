"""DuckDB SQL for the registered queries, written from the plain row-by-row meaning."""

EVENTS = ("on_start", "on_success", "on_failure", "on_duration_warning_threshold_exceeded")
TARGETED = EVENTS[2:]

JOBS = """
hooks AS (
  SELECT l_orderkey,
    list('wh-' || hook ORDER BY l_linenumber, hook) FILTER (WHERE event = 0) AS on_start,
    list('wh-' || hook ORDER BY l_linenumber, hook) FILTER (WHERE event = 1) AS on_success,
    list('wh-' || hook ORDER BY l_linenumber, hook) FILTER (WHERE event = 2) AS on_failure,
    list('wh-' || hook ORDER BY l_linenumber, hook) FILTER (WHERE event = 3)
      AS on_duration_warning_threshold_exceeded
  FROM (SELECT l_orderkey, l_linenumber, l_suppkey % 7 AS hook,
          CASE WHEN l_returnflag = 'A' THEN 0 WHEN l_returnflag = 'N' THEN 1
               WHEN l_linestatus = 'O' THEN 2 ELSE 3 END AS event
        FROM lineitem)
  GROUP BY l_orderkey),
jobs AS (
  SELECT 'ws-' || n_regionkey AS workspace_host,
    o_orderkey AS scan_ordinal,
    o_orderkey AS job_id,
    CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 19 = 0 THEN ''
         ELSE lower(o_orderpriority) || '-' || o_orderkey END AS name,
    CASE WHEN o_custkey % 23 <> 0 THEN 'user' || (o_custkey % 50) || '@example.com' END AS creator,
    CASE WHEN o_orderkey % 13 <> 0 THEN c_mktsegment END AS team,
    CASE WHEN o_orderkey % 13 <> 0 AND o_orderkey % 2 = 0 THEN o_orderpriority END AS tier,
    CASE WHEN o_orderstatus <> 'O'
         THEN '/Workspace/bundles/' || (o_custkey % 40) || '/metadata.json' END AS path,
    o_orderstatus = 'F' OR (o_orderstatus = 'P' AND o_orderkey % 2 = 0) AS is_bundle,
    o_custkey % 40 AS k,
    on_start, on_success, on_failure, on_duration_warning_threshold_exceeded
  FROM orders
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN hooks ON o_orderkey = l_orderkey)
"""

METADATA = """
numbers AS (SELECT DISTINCT c_custkey % 40 AS k FROM customer),
metadata AS (
  SELECT k, '/Workspace/bundles/' || k || '/metadata.json' AS path,
    CASE WHEN ok THEN 'bundle-' || k ELSE '' END AS bundle_name,
    CASE WHEN NOT ok THEN '' WHEN k % 2 = 0 THEN 'prod' ELSE 'dev' END AS target,
    CASE WHEN ok THEN 'https://git.example.com/' || k ELSE '' END AS git_origin,
    CASE WHEN ok THEN 'branch-' || k ELSE '' END AS git_branch,
    CASE WHEN ok THEN 'commit-' || k ELSE '' END AS git_commit,
    CASE WHEN ok THEN '/Workspace/bundles/' || k ELSE '' END AS workspace_root,
    CASE WHEN ok THEN '/Workspace/bundles/' || k || '/files' ELSE '' END AS workspace_file_path
  FROM (SELECT k, k % 8 NOT IN (2, 6) AS ok FROM numbers WHERE k % 8 <> 7))
"""

META_COLUMNS = (
    "bundle_name",
    "target",
    "git_origin",
    "git_branch",
    "git_commit",
    "workspace_root",
    "workspace_file_path",
)


def _with(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + body.strip()


def _flat(column: str, alias: str | None = None) -> str:
    return f"coalesce(array_to_string({column}, ','), '<null>') AS {alias or column}"


def _flat_all(prefix: str = "") -> str:
    return ", ".join(_flat(prefix + e, e) for e in EVENTS)


def _meta(prefix: str = "m.") -> str:
    return ", ".join(f"coalesce({prefix}{c}, '') AS {c}" for c in META_COLUMNS)


def _has(event: str, webhook_id: str = "'wh-3'") -> str:
    return f"coalesce(list_contains({event}, {webhook_id}), false)"


HAS_BLOCK = "(" + " OR ".join(f"{e} IS NOT NULL" for e in EVENTS) + ")"
ON_ALL = "(" + " AND ".join(_has(e) for e in TARGETED) + ")"
ON_ANY = "(" + " OR ".join(_has(e) for e in EVENTS) + ")"
NAME = "coalesce(nullif(name, ''), '<unnamed>')"
OWNERS = "('user1@example.com', 'user7@example.com', 'user42@example.com')"


def _merged(events=TARGETED, webhook_id: str = "'wh-3'", when: str = "true") -> str:
    parts = []
    for e in EVENTS:
        new = e
        if e in events:
            new = (
                f"CASE WHEN {e} IS NULL THEN [{webhook_id}] WHEN {_has(e, webhook_id)} THEN {e} "
                f"ELSE list_append({e}, {webhook_id}) END"
            )
        parts.append(_flat(f"CASE WHEN {when} THEN {new} END", e))
    return ", ".join(parts)


def _without(when: str = "true", clear: bool = False) -> str:
    parts = []
    for e in EVENTS:
        kept = "cast([] AS VARCHAR[])" if clear else f"[x FOR x IN {e} IF x <> 'wh-3']"
        new = f"CASE WHEN {when} AND {e} IS NOT NULL THEN {kept} END"
        parts.append(_flat(new, e))
    return ", ".join(parts)


def _removed(e: str) -> str:
    return f"coalesce(len([x FOR x IN {e} IF x = 'wh-3']), 0)"


def _removal_facts(when: str = "true", clear: bool = False) -> str:
    if clear:
        count = " + ".join(f"coalesce(len({e}), 0)" for e in EVENTS)
        joined = "list_concat(" + "list_concat(" * 2 + ", ".join(
            f"coalesce({e}, cast([] AS VARCHAR[]))" + (")" if 0 < i < 3 else "")
            for i, e in enumerate(EVENTS)
        ) + ")"
        ids = f"array_to_string(list_filter({joined}, lambda x, i: list_position({joined}, x) = i), ',')"
        hit = {e: f"coalesce(len({e}), 0) > 0" for e in EVENTS}
    else:
        count = " + ".join(_removed(e) for e in EVENTS)
        ids = "'wh-3'"
        hit = {e: f"{_removed(e)} > 0" for e in EVENTS}
    events = "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{e}' END" for e, c in hit.items()) + ")"
    return (
        f"CASE WHEN {when} THEN {count} ELSE 0 END AS removed_count, "
        f"CASE WHEN {when} THEN {ids} ELSE '' END AS ids_removed, "
        f"CASE WHEN {when} THEN {events} ELSE '' END AS events_affected"
    )


ATTACH = f"""
planned AS (
  SELECT *, CASE WHEN is_bundle THEN 'bundle_skipped' WHEN {ON_ALL} THEN 'already_attached'
                 ELSE 'would_update' END AS outcome
  FROM jobs)
"""
APPLIED_ATTACH = f"""
planned AS (
  SELECT *, CASE WHEN is_bundle THEN 'bundle_skipped' WHEN {ON_ALL} THEN 'already_attached'
                 WHEN job_id % 29 <> 0 THEN 'updated' ELSE 'errored' END AS outcome
  FROM jobs)
"""
SENT = "outcome IN ('would_update', 'updated', 'errored')"


def _cut(limit: int, checked: str, source: str = "planned", order: str = "scan_ordinal") -> str:
    """The run up to its last row, by a running count over the listing."""
    return f"""
counted AS (
  SELECT *, {checked} AS checked, sum(CASE WHEN ({checked}) AND outcome IN ('would_update', 'updated') THEN 1 ELSE 0 END)
    OVER (PARTITION BY workspace_host ORDER BY {order}) AS cum
  FROM {source}),
stopped AS (
  SELECT *, coalesce(max(CASE WHEN checked AND cum >= {limit} THEN 1 ELSE 0 END)
    OVER (PARTITION BY workspace_host ORDER BY {order}
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over
  FROM counted),
run AS (SELECT * FROM stopped WHERE over = 0)
"""


def _detach(policy: str, applied: bool = False) -> str:
    rule = {
        "skip": "WHEN is_bundle THEN 'bundle_skipped'",
        "only": "WHEN NOT is_bundle THEN 'direct_excluded'",
        "include": "",
    }[policy]
    change = "'would_update'"
    if applied:
        change = "CASE WHEN job_id % 29 <> 0 THEN 'updated' ELSE 'errored' END"
    warning = "is_bundle" if policy == "include" else "false"
    return f"""
planned AS (
  SELECT *, CASE {rule} WHEN {ON_ANY} THEN {change} ELSE 'nothing_to_remove' END AS outcome,
    {warning} AS bundle_warning
  FROM jobs)
"""


COUNTERS = ", ".join(
    f"count(*) FILTER (WHERE outcome IN {names}) AS {c}"
    for c, names in {
        "bundle_skipped": "('bundle_skipped')",
        "would_update": "('would_update')",
        "updated": "('updated')",
        "errored": "('errored', 'lookup_failed')",
    }.items()
)
ALREADY = "count(*) FILTER (WHERE outcome = 'already_attached') AS already_attached"
NOTHING = (
    "count(*) FILTER (WHERE outcome = 'nothing_to_remove') AS nothing_to_remove, "
    "count(*) FILTER (WHERE is_bundle) AS bundle_total"
)

ID_LINES = """
lines AS (
  SELECT o_orderkey AS job_id, row_number() OVER (ORDER BY part, o_orderkey) AS pos
  FROM (SELECT 0 AS part, o_orderkey FROM orders
        UNION ALL SELECT 1, o_orderkey FROM orders WHERE o_orderkey % 7 = 0))
"""
IDS = (
    ID_LINES.strip()
    + """,
ids AS (
  SELECT job_id, min(pos) AS pos
  FROM (SELECT job_id, pos + 3 AS pos FROM lines
        UNION ALL SELECT * FROM (VALUES (5, 0), (37, 1), (999999999, 2)) v(job_id, pos))
  GROUP BY job_id),
hosts AS (SELECT 'ws-' || r_regionkey AS workspace_host FROM region),
asked AS (
  SELECT h.workspace_host, i.job_id, i.pos, j.job_id IS NOT NULL AS found,
    coalesce(j.is_bundle, false) AS is_bundle,
    on_start, on_success, on_failure, on_duration_warning_threshold_exceeded
  FROM ids i CROSS JOIN hosts h
  LEFT JOIN jobs j ON j.workspace_host = h.workspace_host AND j.job_id = i.job_id)
"""
)
ASKED_ATTACH = f"""
planned AS (
  SELECT *, CASE WHEN NOT found THEN 'lookup_failed' WHEN is_bundle THEN 'bundle_skipped'
                 WHEN {ON_ALL} THEN 'already_attached' ELSE 'would_update' END AS outcome
  FROM asked)
"""

DESTINATIONS = """
destinations AS (
  SELECT 'ws-' || n_regionkey AS workspace_host, s_suppkey AS ordinal, 'dst-' || s_suppkey AS id,
    'hook-' || (s_suppkey % 10) AS display_name, 'WEBHOOK' AS destination_type
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)
"""


def _resolved(name: str) -> str:
    return f"""
resolved AS (
  SELECT workspace_host, arg_min(id, ordinal) AS webhook_id,
    arg_min(destination_type, ordinal) AS destination_type
  FROM destinations WHERE display_name = '{name}' GROUP BY workspace_host)
"""


PARTS = """
files AS (
  SELECT *, 'job_' || p_partkey AS job_key,
    CASE WHEN p_size % 5 = 0 THEN 'drafts/job_' || p_partkey || '.yml'
         WHEN p_size % 5 < 3 THEN 'resources/job_' || p_partkey || '.yml'
         ELSE 'jobs/' || lower(p_type) || '/job_' || p_partkey || '.yml' END AS path,
    CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 5 < 3 THEN 0 ELSE 1 END AS pattern_pos
  FROM part),
nodes AS (
  SELECT p_brand AS bundle, path, 'resources.jobs.' || job_key AS label, '' AS target, job_key,
    p_name AS name, p_type AS type, p_size, p_partkey,
    [CASE WHEN p_partkey % 5 = 0 THEN '${var.webhook_id}' ELSE 'wh-' || (p_partkey % 7) END] AS on_failure,
    CASE WHEN p_partkey % 2 = 1 THEN ['wh-3'] END AS on_duration_warning_threshold_exceeded
  FROM files WHERE pattern_pos IS NOT NULL
  UNION ALL
  SELECT p_brand, path, 'targets.prod.resources.jobs.' || job_key, 'prod', job_key,
    NULL, NULL, NULL, p_partkey,
    [CASE WHEN p_partkey % 12 = 0 THEN 'wh-3' ELSE 'wh-9' END], NULL
  FROM files WHERE pattern_pos IS NOT NULL AND p_partkey % 4 = 0)
"""
NO_LISTS = "'<null>' AS on_start, '<null>' AS on_success"
NAMED = "coalesce(name IN ('red widget', 'small ring', 'old bolt'), false)"
TAGGED = "coalesce(type = 'ECONOMY', false)"
OWNED = "coalesce(p_size % 4 < 2 AND 'user' || p_size IN ('user7', 'user12', 'user24', 'user33'), false)"


def _patched(scope: str = "true") -> str:
    def var(e: str) -> str:
        return f"coalesce(len([x FOR x IN {e} IF starts_with(x, '${{')]) > 0, false)"

    def new(e: str) -> str:
        return (
            f"CASE WHEN NOT matched OR {var(e)} OR {_has(e)} THEN {e} "
            f"ELSE list_append(coalesce({e}, cast([] AS VARCHAR[])), 'wh-3') END AS new_{e}"
        )

    skipped = "concat_ws(',', " + ", ".join(
        f"CASE WHEN matched AND {var(e)} THEN '{e}' END" for e in TARGETED
    ) + ")"
    doubled = "concat_ws(',', " + ", ".join(
        f"CASE WHEN target <> '' AND {_has(e)} THEN '{e}' END" for e in TARGETED
    ) + ")"
    adds = " OR ".join(f"(NOT {var(e)} AND NOT {_has(e)})" for e in TARGETED)
    return f"""
scoped AS (SELECT *, target = '' AND {scope} AS matched FROM nodes),
patched AS (
  SELECT *, matched AND ({adds}) AS changed, {skipped} AS var_skipped, {doubled} AS dup_events,
    {", ".join(new(e) for e in TARGETED)}
  FROM scoped)
"""


PATCHED_LISTS = f"{NO_LISTS}, " + ", ".join(_flat(f"new_{e}", e) for e in TARGETED)


def _inventory(scanned_at: str = "2024-01-01 00:00:00", enriched: bool = True, where: str = "true") -> str:
    meta = _meta() if enriched else ", ".join(f"'' AS {c}" for c in META_COLUMNS)
    join = "LEFT JOIN metadata m ON j.is_bundle AND j.path = m.path" if enriched else ""
    return f"""
  SELECT workspace_host, '{scanned_at}' AS scanned_at, job_id, {NAME} AS name,
    coalesce(creator, '') AS creator,
    CASE WHEN is_bundle THEN 'BUNDLE' ELSE 'DIRECT' END AS deployment_kind,
    {meta},
    CASE WHEN is_bundle THEN coalesce(j.path, '') ELSE '' END AS metadata_file_path
  FROM jobs j {join} WHERE {where}"""


def _removals(deleted_at: str) -> str:
    events = "concat_ws(',', " + ", ".join(
        f"CASE WHEN {_removed(e)} > 0 THEN '{e}' END" for e in EVENTS
    ) + ")"
    return f"""
  SELECT workspace_host, '{deleted_at}' AS deleted_at, job_id, {NAME} AS name,
    coalesce(creator, '') AS creator, is_bundle, 'wh-3' AS webhook_ids_removed,
    {events} AS events_affected, {_meta()}, coalesce(p.path, '') AS metadata_file_path
  FROM planned p LEFT JOIN metadata m ON p.is_bundle AND p.path = m.path
  WHERE outcome = 'updated'"""


def _top(label: str, name: str, source: str) -> str:
    return f"""
counts AS (
  SELECT workspace_host, {label} AS {name}, count(*) AS jobs, min(scan_ordinal) AS first_met
  FROM {source} GROUP BY 1, 2),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY workspace_host ORDER BY jobs DESC, first_met) AS position
  FROM counts)
"""


def _ids(where: str) -> str:
    return _with(JOBS, body=f"SELECT workspace_host, job_id FROM jobs WHERE {where}")


def _scan_cut(n: int, source: str = "jobs", name: str = "listed") -> str:
    return f"""
{name} AS (
  SELECT *, row_number() OVER (PARTITION BY workspace_host ORDER BY scan_ordinal) AS place
  FROM {source})
"""


def _snapshot(lists: str, source: str = "planned") -> str:
    return f"SELECT workspace_host, job_id, coalesce(name, '') AS name, {lists} FROM {source}"


def _next(events_new: dict[str, str], changed: str) -> str:
    return ", ".join(
        _flat(f"CASE WHEN {changed} THEN {events_new[e]} ELSE {e} END", e) for e in EVENTS
    )


REMOVED_NEXT = {
    e: f"CASE WHEN len([x FOR x IN {e} IF x <> 'wh-3']) > 0 THEN [x FOR x IN {e} IF x <> 'wh-3'] END"
    for e in EVENTS
}
ATTACHED_NEXT = {
    e: (
        f"CASE WHEN {_has(e)} THEN {e} ELSE list_append(coalesce({e}, cast([] AS VARCHAR[])), 'wh-3') END"
        if e in TARGETED
        else e
    )
    for e in EVENTS
}

FLAT_DETACH = "workspace_host, job_id, outcome, bundle_warning"


def _flat_detach(source: str, clear: bool = False) -> str:
    return f"SELECT {FLAT_DETACH}, {_removal_facts(SENT, clear)}, {_without(SENT, clear)} FROM {source}"


def _asked_detach(clear: bool) -> str:
    hit = HAS_BLOCK if clear else ON_ANY
    return f"""
planned AS (
  SELECT *, CASE WHEN NOT found THEN 'lookup_failed' WHEN {hit} THEN 'would_update'
                 ELSE 'nothing_to_remove' END AS outcome, is_bundle AS bundle_warning
  FROM asked)
"""


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}

    # Inventory
    q["classify_deployment"] = _with(
        JOBS,
        body="""SELECT workspace_host, job_id, CASE WHEN is_bundle THEN 'BUNDLE' ELSE 'DIRECT' END AS deployment_kind,
        CASE WHEN is_bundle THEN coalesce(path, '') ELSE '' END AS metadata_file_path FROM jobs""",
    )
    q["inventory_rows"] = _with(JOBS, body=_inventory(enriched=False))
    q["inventory_rows_enriched"] = _with(JOBS, METADATA, body=_inventory())
    q["bundle_metadata"] = _with(METADATA, body="SELECT path, " + ", ".join(META_COLUMNS) + " FROM metadata")
    q["bundle_enrich"] = _with(
        JOBS,
        METADATA,
        body="""SELECT workspace_host, job_id, coalesce(bundle_name, '') AS bundle_name,
        coalesce(target, '') AS target, coalesce(git_commit, '') AS git_commit
        FROM jobs j LEFT JOIN metadata m ON j.path = m.path WHERE is_bundle""",
    )
    q["filter_owner"] = _ids(f"creator IN {OWNERS}")
    q["filter_owner_unset"] = _ids("creator IS NULL")
    q["filter_tag_value"] = _ids("team = 'BUILDING'")
    q["filter_tag_present"] = _ids("tier IS NOT NULL")
    q["filter_name"] = _ids("contains(name, 'high-1')")
    q["filter_combined"] = _with(
        JOBS,
        "named AS (SELECT * FROM jobs WHERE contains(name, 'u'))",
        _scan_cut(1500, "named"),
        body=f"""SELECT workspace_host, job_id FROM listed
        WHERE place < 1500 AND creator IN {OWNERS} AND team = 'BUILDING'""",
    )
    for key, n in (("scan_cap", 50), ("scan_cap_large", 2001)):
        q[key] = _with(JOBS, _scan_cut(n), body=f"SELECT workspace_host, job_id FROM listed WHERE place < {n}")
    q["inventory_summary"] = _with(
        JOBS,
        body="""SELECT workspace_host, count(*) AS total, count(*) FILTER (WHERE is_bundle) AS bundle,
        count(*) FILTER (WHERE NOT is_bundle) AS direct,
        round(count(*) FILTER (WHERE is_bundle) / count(*) * 100, 4) AS bundle_pct,
        round(count(*) FILTER (WHERE NOT is_bundle) / count(*) * 100, 4) AS direct_pct
        FROM jobs GROUP BY workspace_host""",
    )
    q["top_creators"] = _with(
        JOBS,
        _top("coalesce(nullif(creator, ''), '<unknown>')", "creator", "jobs"),
        body="SELECT workspace_host, creator, jobs, position FROM ranked WHERE position <= 10",
    )
    q["top_creators_large"] = _with(
        JOBS,
        _top("'user' || (job_id * job_id % 1009)", "creator", "jobs"),
        body="SELECT workspace_host, creator, jobs, position FROM ranked WHERE position <= 150",
    )
    q["top_bundles"] = _with(
        JOBS,
        METADATA,
        "named AS (SELECT j.*, bundle_name FROM jobs j JOIN metadata m ON j.path = m.path"
        " WHERE is_bundle AND bundle_name <> '')",
        _top("bundle_name", "bundle_name", "named"),
        body="SELECT workspace_host, bundle_name, jobs, position FROM ranked WHERE position <= 10",
    )
    per_host = "SELECT workspace_host, count(*) AS jobs FROM jobs GROUP BY workspace_host"
    q["jobs_per_workspace"] = _with(JOBS, body=per_host)
    q["session_view"] = _with(JOBS, body=per_host)
    q["bundles_by_target"] = _with(
        JOBS,
        METADATA,
        body="""SELECT coalesce(bundle_name, '') AS bundle_name, coalesce(target, '') AS target, count(*) AS jobs
        FROM jobs j LEFT JOIN metadata m ON j.path = m.path WHERE is_bundle GROUP BY 1, 2""",
    )
    q["direct_job_ids"] = _with(JOBS, body="SELECT job_id FROM jobs WHERE NOT is_bundle")
    q["cohort_rollback"] = _with(
        JOBS, _detach("include"), body=_flat_detach("planned") + " WHERE is_bundle"
    )
    q["inventory_overwrite"] = _with(
        JOBS,
        METADATA,
        body=_inventory(where="workspace_host NOT IN ('ws-0', 'ws-1')")
        + "\nUNION ALL\n"
        + _inventory("2024-01-02 00:00:00", where="workspace_host IN ('ws-0', 'ws-1') AND team = 'BUILDING'"),
    )
    q["inventory_csv"] = _with(
        JOBS,
        METADATA,
        body=f"SELECT * EXCLUDE (workspace_host, scanned_at) FROM ({_inventory()})",
    )

    # Attach
    q["attached_all"] = _with(JOBS, body=f"SELECT workspace_host, job_id, {ON_ALL} AS attached FROM jobs")
    q["attached_any"] = _with(JOBS, body=f"SELECT workspace_host, job_id, {ON_ANY} AS attached FROM jobs")

    def plan(source: str, lists: str) -> str:
        return f"SELECT workspace_host, job_id, outcome, {lists} FROM {source}"

    direct = "NOT is_bundle"
    q["attach_plan"] = _with(JOBS, ATTACH, body=plan("planned", _merged(when=SENT)))
    on_every = " AND ".join(_has(e) for e in EVENTS)
    q["attach_all_events"] = _with(
        JOBS,
        ATTACH.replace(ON_ALL, f"({on_every})"),
        body=plan("planned", _merged(events=EVENTS, when=SENT)),
    )
    q["attach_scoped"] = _with(
        JOBS,
        "named AS (SELECT * FROM jobs WHERE contains(name, '-1'))",
        _scan_cut(1200, "named"),
        ATTACH.replace("FROM jobs", "FROM listed WHERE place < 1200 AND team = 'BUILDING'"),
        _cut(30, direct),
        body=plan("run", _merged(when=SENT)),
    )
    q["attach_capped"] = _with(JOBS, ATTACH, _cut(40, direct), body=plan("run", _merged(when=SENT)))
    q["attach_capped_large"] = _with(JOBS, ATTACH, _cut(1200, direct), body=plan("run", _merged(when=SENT)))
    q["attach_capped_sparse"] = q["attach_capped_large"]
    q["attach_applied_capped"] = _with(
        JOBS, APPLIED_ATTACH, _cut(100, direct), body=plan("run", _merged(when=SENT))
    )
    q["attach_run_stats"] = _with(
        JOBS,
        APPLIED_ATTACH,
        body=f"""SELECT workspace_host, count(*) AS scanned, count(*) AS matched, {ALREADY}, {COUNTERS}
        FROM planned GROUP BY workspace_host""",
    )
    # The row that reaches the scan cap is scanned and not processed; a run cut
    # short by its mutation cap never gets there.
    q["attach_run_stats_capped"] = _with(
        JOBS,
        _scan_cut(1400),
        f"""
planned AS (
  SELECT *, place < 1400 AND tier IS NOT NULL AS matched,
    CASE WHEN place >= 1400 OR tier IS NULL THEN NULL WHEN is_bundle THEN 'bundle_skipped'
         WHEN {ON_ALL} THEN 'already_attached' ELSE 'would_update' END AS outcome
  FROM listed WHERE place <= 1400)
""",
        _cut(60, "matched AND NOT is_bundle"),
        body=f"""SELECT workspace_host, count(*) AS scanned, count(*) FILTER (WHERE matched) AS matched,
        {ALREADY}, {COUNTERS} FROM run GROUP BY workspace_host""",
    )
    own = {"webhook_id": "webhook_id"}
    q["attach_by_name"] = _with(
        JOBS,
        DESTINATIONS,
        _resolved("hook-0"),
        f"""
planned AS (
  SELECT j.*, webhook_id, CASE WHEN is_bundle THEN 'bundle_skipped'
    WHEN {" AND ".join(_has(e, "webhook_id") for e in TARGETED)} THEN 'already_attached'
    ELSE 'would_update' END AS outcome
  FROM jobs j JOIN resolved USING (workspace_host))
""",
        body=plan("planned", _merged(when=SENT, **own)),
    )
    q["next_snapshot_attach"] = _with(
        JOBS,
        ATTACH,
        body=_snapshot(
            _next(ATTACHED_NEXT, "coalesce(contains(name, 'low'), false) AND outcome = 'would_update'")
        ),
    )

    # Listings
    q["jobs_from_pages"] = _with(
        JOBS,
        body=f"""SELECT workspace_host, job_id, row_number() OVER (PARTITION BY workspace_host ORDER BY job_id) - 1 AS scan_ordinal,
        coalesce(name, '') AS name, {_flat_all()} FROM jobs""",
    )
    q["workspace_read_failures"] = _with(
        JOBS,
        ATTACH,
        body="""SELECT h.workspace_host, CASE h.workspace_host WHEN 'ws-2' THEN '1 record(s) cannot be read'
          WHEN 'ws-4' THEN 'the listing breaks off before its last page' ELSE '' END AS error,
        count(p.job_id) AS scanned, count(*) FILTER (WHERE outcome = 'bundle_skipped') AS bundle_skipped,
        count(*) FILTER (WHERE outcome = 'would_update') AS would_update
        FROM (SELECT 'ws-' || r_regionkey AS workspace_host FROM region) h
        LEFT JOIN (SELECT * FROM planned WHERE workspace_host NOT IN ('ws-2', 'ws-4')) p
          ON p.workspace_host = h.workspace_host GROUP BY h.workspace_host""",
    )

    # Explicit ids
    q["load_job_ids"] = _with(ID_LINES, body="SELECT job_id, pos FROM lines")
    q["job_ids_from_csv"] = _with(JOBS, body="SELECT job_id FROM jobs")
    q["merge_job_ids"] = _with(JOBS, IDS, body="SELECT job_id, pos FROM ids")
    q["attach_by_id"] = _with(
        JOBS,
        IDS,
        ASKED_ATTACH,
        body=f"SELECT workspace_host, job_id, outcome, pos, {_merged(when=SENT)} FROM planned",
    )
    q["attach_by_id_capped"] = _with(
        JOBS,
        IDS,
        ASKED_ATTACH,
        _cut(75, "true", order="pos"),
        body=f"""SELECT workspace_host, count(*) AS scanned, count(*) FILTER (WHERE found) AS matched,
        {ALREADY}, {COUNTERS} FROM run GROUP BY workspace_host""",
    )
    applied = ASKED_ATTACH.replace("ELSE 'would_update'", "WHEN job_id % 29 <> 0 THEN 'updated' ELSE 'errored'")
    q["by_id_run_stats"] = _with(
        JOBS,
        IDS,
        applied,
        _cut(75, "true", order="pos"),
        body=f"""SELECT workspace_host, count(*) AS scanned, count(*) FILTER (WHERE found) AS matched,
        {ALREADY}, {COUNTERS} FROM run GROUP BY workspace_host""",
    )
    q["detach_by_id"] = _with(JOBS, IDS, _asked_detach(False), body=_flat_detach("planned"))
    q["detach_all"] = _with(JOBS, IDS, _asked_detach(True), body=_flat_detach("planned", clear=True))
    # Every job's own id is on the list.
    q["next_snapshot_by_id"] = _with(JOBS, body=_snapshot(_next(REMOVED_NEXT, ON_ANY), "jobs"))

    # Detach
    q["detach_one"] = _with(JOBS, _detach("include"), body=_flat_detach("planned"))
    for policy in ("skip", "include", "only"):
        q[f"detach_{policy}"] = _with(
            JOBS, _detach(policy), body=f"SELECT {FLAT_DETACH} FROM planned"
        )
    q["detach_capped"] = _with(
        JOBS, _detach("include"), _cut(25, SENT), body=_flat_detach("run")
    )
    detach_stats = f"""SELECT workspace_host, count(*) AS scanned, count(*) AS matched, {NOTHING}, {COUNTERS}
        FROM planned GROUP BY workspace_host"""
    q["detach_run_stats"] = _with(JOBS, _detach("skip", applied=True), body=detach_stats)
    q["workspace_failures"] = _with(
        JOBS,
        _detach("only", applied=True),
        body=f"SELECT workspace_host, errored FROM ({detach_stats}) WHERE errored > 0",
    )
    # Every sixth job failed once and then went through; all others have one result.
    retried = _detach("include", applied=True).replace("job_id % 29 <> 0", "job_id % 29 <> 0 OR job_id % 6 = 0")
    q["next_snapshot_retried"] = _with(
        JOBS, retried, body=_snapshot(_next(REMOVED_NEXT, "outcome = 'updated'"))
    )
    q["removal_log_retried"] = _with(JOBS, METADATA, retried, body=_removals("2024-01-01 00:00:00"))
    q["run_stats_all_workspaces"] = _with(
        JOBS,
        ATTACH,
        body=f"""SELECT h.workspace_host, count(p.job_id) AS scanned, count(p.job_id) AS matched, {ALREADY}, {COUNTERS}
        FROM (SELECT 'ws-' || r_regionkey AS workspace_host FROM region) h
        LEFT JOIN planned p ON p.workspace_host = h.workspace_host GROUP BY h.workspace_host""",
    )
    q["enrich_on_demand"] = _with(
        JOBS,
        METADATA,
        body=f"""SELECT workspace_host, job_id, j.k % 8 = 7 AS lost, {_meta()}
        FROM jobs j LEFT JOIN metadata m ON j.path = m.path WHERE is_bundle""",
    )
    q["enrich_from_files"] = _with(
        JOBS,
        METADATA,
        body=f"""SELECT workspace_host, job_id, {_meta()}
        FROM jobs j LEFT JOIN metadata m ON j.path = m.path WHERE is_bundle""",
    )
    q["next_snapshot_detach"] = _with(
        JOBS,
        _detach("include", applied=True),
        body=_snapshot(_next(REMOVED_NEXT, "outcome = 'updated'")),
    )
    q["bundle_report"] = _with(
        JOBS,
        METADATA,
        body=f"""SELECT workspace_host, job_id, {NAME} AS name, coalesce(creator, '') AS creator, {_meta()},
        coalesce(j.path, '') AS metadata_file_path
        FROM jobs j LEFT JOIN metadata m ON j.path = m.path WHERE is_bundle AND tier IS NOT NULL""",
    )
    q["bundle_report_csv"] = _with(
        JOBS,
        METADATA,
        body=f"""SELECT job_id, {NAME} AS name, coalesce(creator, '') AS creator, {_meta()},
        coalesce(j.path, '') AS metadata_file_path
        FROM jobs j LEFT JOIN metadata m ON j.path = m.path WHERE is_bundle""",
    )
    q["removal_log"] = _with(
        JOBS, METADATA, _detach("include", applied=True), body=_removals("2024-01-01 00:00:00")
    )
    q["audit_recent"] = (
        "SELECT * FROM (\n"
        + _with(JOBS, METADATA, _detach("skip", applied=True), body=_removals("2024-01-01 00:00:00"))
        + "\n) UNION ALL SELECT * FROM (\n"
        + _with(JOBS, METADATA, _detach("only", applied=True), body=_removals("2024-01-02 00:00:00"))
        + "\n)"
    )

    def age(policy: str, day: int, changed: str, ticket: str) -> str:
        part = _with(JOBS, METADATA, _detach(policy, applied=True), body=_removals(f"2024-01-0{day} 00:00:00"))
        return f"SELECT * REPLACE ({changed}), {ticket} AS ticket FROM (\n{part}\n)"

    text = "CAST(is_bundle AS VARCHAR) AS is_bundle"
    q["removal_log_evolved"] = "\nUNION ALL\n".join(
        [
            age("skip", 1, "'<null>' AS is_bundle, '<null>' AS git_branch", "'<null>'"),
            age("only", 2, text, "'<null>'"),
            age("only", 3, text, "'T-' || job_id"),
        ]
    )

    # Destinations, errors, hosts
    q["scan_destinations"] = _with(
        DESTINATIONS, body="SELECT workspace_host, id, display_name, destination_type FROM destinations"
    )
    q["resolve_destination"] = _with(DESTINATIONS, _resolved("hook-0"), body="SELECT * FROM resolved")
    hosts = "hosts AS (SELECT 'ws-' || r_regionkey AS workspace_host FROM region)"
    q["destinations_from_pages"] = q["resolve_destination"]
    q["cut_listings"] = _with(
        DESTINATIONS,
        body="SELECT DISTINCT workspace_host FROM destinations WHERE regexp_matches(workspace_host, '[13579]$')",
    )
    q["missing_destinations"] = _with(
        DESTINATIONS,
        _resolved("hook-1"),
        hosts,
        body="SELECT workspace_host FROM hosts WHERE workspace_host NOT IN (SELECT workspace_host FROM resolved)",
    )
    q["create_destination_plan"] = _with(
        DESTINATIONS,
        _resolved("hook-1"),
        hosts,
        body="""SELECT workspace_host, CASE WHEN webhook_id IS NULL THEN 'would_create' ELSE 'exists' END AS action,
        coalesce(webhook_id, '') AS webhook_id, 'hook-1' AS display_name,
        coalesce(destination_type, '') AS destination_type,
        CASE WHEN webhook_id IS NULL THEN 'https://hooks.example.com/abc' ELSE '' END AS url
        FROM hosts LEFT JOIN resolved USING (workspace_host)""",
    )
    q["validate_url"] = """SELECT page_id, url, CASE
        WHEN regexp_matches(url, '^[hH][tT][tT][pP][sS]://[^/?#]') THEN 'valid'
        WHEN regexp_matches(url, '^[hH][tT][tT][pP]://[^/?#]') THEN 'insecure'
        ELSE 'invalid' END AS status FROM pages"""
    q["classify_transient"] = """SELECT event_id AS attempt_id, user_id AS job_id,
        event_type IN ('error', 'signup', 'purchase', 'click') AS transient FROM events"""
    site = "regexp_extract(url, '^(https?://[^/?#]+)', 1)"
    q["normalise_hosts"] = f"""SELECT page_id, CAST(0 AS BIGINT) AS place, {site} AS workspace_host FROM pages
        UNION ALL SELECT page_id, CAST(1 AS BIGINT), {site} || ':443' FROM pages"""

    # Bundles
    q["bundle_files"] = _with(
        PARTS,
        body="""SELECT p_brand AS bundle, path, CAST(pattern_pos AS BIGINT) AS pattern_pos
        FROM files WHERE pattern_pos IS NOT NULL
        UNION ALL SELECT DISTINCT p_brand, 'bundle.yml', CAST(-1 AS BIGINT) FROM part""",
    )
    q["bundle_files_from_folder"] = q["bundle_files"].replace("p_brand AS bundle", "replace(p_brand, '#', '-') AS bundle").replace(
        "DISTINCT p_brand", "DISTINCT replace(p_brand, '#', '-')"
    )
    q["missing_roots"] = "SELECT DISTINCT p_brand AS bundle FROM part WHERE p_brand LIKE '%1'"
    broken = "(pattern_pos IS NOT NULL AND p_partkey % 100 = 3)"
    q["bundle_errors"] = _with(
        PARTS,
        body=f"""SELECT p_brand AS bundle, path, CAST(-1 AS BIGINT) AS jobs_seen FROM files WHERE {broken}
        UNION ALL SELECT b.bundle, '', count(label)
        FROM (SELECT DISTINCT p_brand AS bundle FROM part) b LEFT JOIN nodes n ON n.bundle = b.bundle
        WHERE b.bundle NOT IN (SELECT p_brand FROM files WHERE {broken}) GROUP BY b.bundle""",
    )
    q["bundle_docs"] = _with(
        PARTS,
        body="""SELECT p_brand AS bundle, path, false AS has_include, true AS has_resources,
        p_partkey % 4 = 0 AS has_targets FROM files
        UNION ALL SELECT DISTINCT p_brand, 'bundle.yml', true, false, false FROM part""",
    )
    q["bundle_job_nodes"] = _with(
        PARTS,
        body=f"""SELECT bundle, path, label, target, job_key, {NO_LISTS},
        {", ".join(_flat(e) for e in TARGETED)} FROM nodes""",
    )
    q["bundle_job_filter"] = _with(
        PARTS,
        body=f"""SELECT label, {NAMED} AS named, {TAGGED} AS tagged, {OWNED} AS owned,
        {NAMED} AND {TAGGED} AND {OWNED} AS all_three FROM nodes""",
    )
    q["bundle_patch_plan"] = _with(
        PARTS,
        _patched(),
        body=f"SELECT label, matched, changed, var_skipped, dup_events, {PATCHED_LISTS} FROM patched",
    )
    q["bundle_patch_stats"] = _with(
        PARTS,
        _patched(TAGGED),
        body="""SELECT p.bundle, count(DISTINCT CASE WHEN changed THEN path END) AS files_changed,
        count(*) AS jobs_seen, count(*) FILTER (WHERE matched) AS jobs_matched,
        count(*) FILTER (WHERE changed) AS jobs_patched,
        count(*) FILTER (WHERE target <> '') AS overrides_skipped,
        CAST(sum(CASE WHEN var_skipped = '' THEN 0 ELSE len(string_split(var_skipped, ',')) END) AS BIGINT)
          AS var_skipped_events
        FROM patched p GROUP BY p.bundle""",
    )
    q["override_dup_events"] = _with(
        PARTS,
        _patched(TAGGED),
        body="SELECT bundle, label, dup_events FROM patched WHERE dup_events <> ''",
    )
    both = {
        e: f"list_concat(coalesce(a.new_{e}, cast([] AS VARCHAR[])), coalesce(o.{e}, cast([] AS VARCHAR[])))"
        for e in TARGETED
    }
    # Lists are short here, so an id listed twice is one found at an earlier place.
    dups = ", ".join(
        f"array_to_string(list_filter({x}, lambda x, i: list_position({x}, x) < i), ',') AS dup_{e}"
        for e, x in both.items()
    )
    q["effective_notifications"] = _with(
        PARTS,
        _patched(),
        body=f"""SELECT a.bundle, a.job_key, coalesce(o.target, '') AS target, '' AS on_start, '' AS on_success,
        {", ".join(f"array_to_string({x}, ',') AS {e}" for e, x in both.items())}, {dups}
        FROM patched a LEFT JOIN nodes o
          ON o.bundle = a.bundle AND o.job_key = a.job_key AND o.target <> ''
        WHERE a.target = ''""",
    )
    q["effective_all_targets"] = _with(
        PARTS,
        _patched(),
        "targets AS (SELECT DISTINCT bundle, target FROM nodes WHERE target <> ''"
        " UNION SELECT DISTINCT p_brand, 'dev' FROM part)",
        body=f"""SELECT a.bundle, a.job_key, t.target, '' AS on_start, '' AS on_success,
        {", ".join(f"array_to_string({x}, ',') AS {e}" for e, x in both.items())}, {dups}
        FROM patched a JOIN targets t ON t.bundle = a.bundle
        LEFT JOIN nodes o ON o.bundle = a.bundle AND o.job_key = a.job_key AND o.target = t.target
        WHERE a.target = ''
        UNION ALL SELECT DISTINCT p_brand, 'dev_only', 'dev', '', '', 'wh-3', '', '', '' FROM part""",
    )
    q["patched_bundle_jobs"] = _with(
        PARTS,
        _patched(OWNED),
        body=f"SELECT bundle, label, changed, {PATCHED_LISTS} FROM patched WHERE target = ''",
    )
    return q
