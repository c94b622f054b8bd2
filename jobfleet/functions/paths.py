"""Paths of the files that Spark reads."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def path_below(root: str) -> Column:
    """Where a file lies below ``root``. File locations are URIs and are decoded first."""
    location = F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B"))
    folder = re.sub(r"^[a-z0-9]+:/*", "/", root).rstrip("/") + "/"
    return F.regexp_replace(location, "^.*?" + re.escape(folder), "")
