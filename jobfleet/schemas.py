"""Table schemas and the fixed values shared by every module."""

from pyspark.sql import types as T

# Notification event names, in the order that drives reports.
EVENT_FIELDS = (
    "on_start",
    "on_success",
    "on_failure",
    "on_duration_warning_threshold_exceeded",
)
# Default target events, labels for missing names and creators.
DEFAULT_EVENTS = ("on_failure", "on_duration_warning_threshold_exceeded")
UNNAMED = "<unnamed>"
UNKNOWN_CREATOR = "<unknown>"
# Deployment kinds, bundle policies, session view name.
BUNDLE = "BUNDLE"
DIRECT = "DIRECT"
BUNDLE_POLICIES = ("skip", "include", "only")
SESSION_VIEW = "jobs_inventory_session"

HOST = "workspace_host"
ORDINAL = "scan_ordinal"
JOB_KEY = [HOST, "job_id"]


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


WEBHOOK = _struct(id=T.StringType())
WEBHOOKS = T.ArrayType(WEBHOOK)
NOTIFICATIONS = _struct(**{event: WEBHOOKS for event in EVENT_FIELDS})
SETTINGS = _struct(
    name=T.StringType(),
    tags=T.MapType(T.StringType(), T.StringType()),
    deployment=_struct(kind=T.StringType(), metadata_file_path=T.StringType()),
    webhook_notifications=NOTIFICATIONS,
)

# scan_ordinal is the position of a job in its workspace's listing: a
# non-negative integer, unique and increasing within the workspace. Gaps are
# allowed (a name filter leaves some anyway).
JOBS = _struct(
    workspace_host=T.StringType(),
    scan_ordinal=T.LongType(),
    job_id=T.LongType(),
    creator_user_name=T.StringType(),
    settings=SETTINGS,
)

# One page of a workspace's job listing: the token it was asked for with (none for the
# first), its jobs, and the token of the page after it (none for the last).
JOB_PAGES = _struct(
    workspace_host=T.StringType(),
    page_token=T.StringType(),
    next_page_token=T.StringType(),
    jobs=T.ArrayType(
        _struct(job_id=T.LongType(), creator_user_name=T.StringType(), settings=SETTINGS)
    ),
)
LISTING_FAULTS = _struct(workspace_host=T.StringType(), error=T.StringType())

# The columns that a bundle's metadata adds to an inventory.
METADATA_FIELDS = (
    "bundle_name",
    "target",
    "git_origin",
    "git_branch",
    "git_commit",
    "workspace_root",
    "workspace_file_path",
)
METADATA = _struct(path=T.StringType(), **{f: T.StringType() for f in METADATA_FIELDS})

DESTINATIONS = _struct(
    workspace_host=T.StringType(),
    ordinal=T.LongType(),
    id=T.StringType(),
    display_name=T.StringType(),
    destination_type=T.StringType(),
)
DESTINATION_PAGES = _struct(
    workspace_host=T.StringType(),
    page=T.LongType(),
    page_token=T.StringType(),
    results=T.ArrayType(
        _struct(
            id=T.StringType(),
            display_name=T.StringType(),
            destination_type=T.StringType(),
        )
    ),
    next_page_token=T.StringType(),
)

UPDATE_RESULTS = _struct(
    workspace_host=T.StringType(), job_id=T.LongType(), ok=T.BooleanType()
)

INVENTORY = _struct(
    workspace_host=T.StringType(),
    scanned_at=T.TimestampType(),
    job_id=T.LongType(),
    name=T.StringType(),
    creator=T.StringType(),
    deployment_kind=T.StringType(),
    **{f: T.StringType() for f in METADATA_FIELDS},
    metadata_file_path=T.StringType(),
)
# Column order of the two CSV exports.
INVENTORY_CSV_COLUMNS = (
    "job_id",
    "name",
    "creator",
    "deployment_kind",
    *METADATA_FIELDS,
    "metadata_file_path",
)
BUNDLE_REPORT_COLUMNS = (
    "job_id",
    "name",
    "creator",
    *METADATA_FIELDS,
    "metadata_file_path",
)

REMOVAL_LOG = _struct(
    workspace_host=T.StringType(),
    deleted_at=T.TimestampType(),
    job_id=T.LongType(),
    name=T.StringType(),
    creator=T.StringType(),
    is_bundle=T.BooleanType(),
    webhook_ids_removed=T.ArrayType(T.StringType()),
    events_affected=T.ArrayType(T.StringType()),
    **{f: T.StringType() for f in METADATA_FIELDS},
    metadata_file_path=T.StringType(),
)


def parse_events(events: str | list[str] | tuple[str, ...]) -> list[str]:
    """Target events from a comma-separated string or a list; unknown names fail."""
    text = events if isinstance(events, str) else ",".join(events)
    asked = dict.fromkeys(map(str.strip, text.split(",")))
    asked.pop("", None)
    if strange := sorted(asked.keys() - set(EVENT_FIELDS)):
        raise ValueError(f"{', '.join(strange)}: not a notification event; choose from {', '.join(EVENT_FIELDS)}")
    return list(asked)
