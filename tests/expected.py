"""What runs should give, as columns of a small table: masks and running sums per workspace."""

from collections import Counter
from types import SimpleNamespace

import pandas as pd

from jobfleet.schemas import EVENT_FIELDS


def fact(row):
    """One fixture row with its settings spread out; ``lists`` is None without a block."""
    host, ordinal, job_id, creator, settings = row
    name, tags, deployment, block = settings if settings is not None else [None] * 4
    kind, path = deployment if deployment is not None else [None] * 2
    per_event = None if block is None else dict(zip(EVENT_FIELDS, block))
    return SimpleNamespace(
        host=host,
        ordinal=ordinal,
        job_id=job_id,
        creator=creator,
        name=name,
        tags=dict(tags or {}),
        path=path,
        is_bundle=kind is not None and "bundle" in kind.lower(),
        lists=None if block is None else {e: [i for (i,) in per_event[e] or ()] for e in EVENT_FIELDS},
    )


def listed(rows, host, name_filter=None):
    facts = [fact(r) for r in rows if r[0] == host and (name_filter or "") in (fact(r).name or "")]
    return sorted(facts, key=lambda f: f.ordinal)


def in_scope(f, tag, owners):
    by_owner = not owners or (f.creator if f.creator is not None else "") in owners
    key, has_value, value = (tag or "").partition("=")
    by_tag = key == "" or (f.tags.get(key, object()) == value if has_value else key in f.tags)
    return by_owner and by_tag


def attached(f, webhook_id, events):
    """Whether a job with a block lists the id for every event."""
    return f.lists is not None and {e for e in events if webhook_id in f.lists[e]} == set(events)


def lists_with(f, webhook_id, events):
    """Lists after attaching; an event without ids is left out."""
    before = f.lists or dict.fromkeys(EVENT_FIELDS, [])
    after = {e: before[e] + [webhook_id] * (e in events and before[e].count(webhook_id) == 0) for e in EVENT_FIELDS}
    return {e: ids for e, ids in after.items() if ids}


def removal(f, webhook_id):
    """Lists after detaching, how many entries went, their ids in order, their events."""
    before = {e: ids for e, ids in (f.lists or {}).items() if ids}
    after = {e: [] if webhook_id is None else [i for i in ids if i != webhook_id] for e, ids in before.items()}
    went = {e: Counter(before[e]) - Counter(after[e]) for e in before}
    gone = [i for e in before for i in before[e] if went[e][i]]
    ids = [i for i in dict.fromkeys(gone) if i or webhook_id == ""]
    return SimpleNamespace(lists=after, count=len(gone), ids=ids, events=[e for e in before if went[e]])


def run(rows, host, changes, *, attaching, tag=None, owners=(), name_filter=None, scan_limit=None, limit=None,
        policy="skip", fails=(), applied=False):
    """(outcomes by job id, scanned, matched) of one workspace.

    A run ends after the first row that tests the limit with the number of changes so far at or
    above it; that row is found by a running sum over the listing.
    """
    facts = listed(rows, host, name_filter)
    frame = pd.DataFrame(
        [
            (
                f.job_id,
                in_scope(f, tag, owners),
                f.is_bundle and (attaching or policy == "skip"),
                not f.is_bundle and not attaching and policy == "only",
                bool(changes(f)),
                f.job_id in fails,
            )
            for f in facts
        ],
        columns=["job_id", "matched", "skipped", "excluded", "changes", "fails"],
    )
    if scan_limit is not None:  # the row that reaches the cap is seen and no more
        frame = frame.iloc[: max(scan_limit, 1)]
        frame.loc[frame.index[max(scan_limit, 1) - 1 :], "matched"] = False
    outcome = pd.Series("updated" if applied else "would_update", frame.index)
    if applied:
        outcome = outcome.mask(frame["fails"], "errored")
    outcome = outcome.mask(~frame["changes"], "already_attached" if attaching else "nothing_to_remove")
    outcome = outcome.mask(frame["excluded"], "direct_excluded").mask(frame["skipped"], "bundle_skipped")
    outcome = outcome.where(frame["matched"])
    if limit is not None:
        done = outcome.isin(["updated", "would_update"]).cumsum()
        tests = frame["matched"] & ~frame["skipped"] & ~frame["excluded"] & (frame["changes"] | attaching)
        over = (tests & (done >= limit)).cumsum().shift(fill_value=0) > 0
        frame, outcome = frame[~over], outcome[~over]
    named = outcome.notna()
    return dict(zip(frame["job_id"][named], outcome[named])), len(frame), int(frame["matched"].sum())
