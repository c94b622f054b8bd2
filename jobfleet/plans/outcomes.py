"""Outcome labels of planned rows."""

BUNDLE_SKIPPED = "bundle_skipped"
DIRECT_EXCLUDED = "direct_excluded"
ALREADY_ATTACHED = "already_attached"
NOTHING_TO_REMOVE = "nothing_to_remove"
WOULD_UPDATE = "would_update"
UPDATED = "updated"
ERRORED = "errored"
LOOKUP_FAILED = "lookup_failed"

CHANGED = (WOULD_UPDATE, UPDATED)
SENT = (WOULD_UPDATE, UPDATED, ERRORED)
