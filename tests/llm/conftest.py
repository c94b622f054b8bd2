import os
from pathlib import Path
import sys

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[2])]
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.exists(SF):
        pytest.skip("benchmark tables not present")
    return SF


@pytest.fixture(scope="session")
def texts(spark, sf_dir):
    """doc_id and text of the smallest table, as plain rows."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    return [(r.doc_id, r.text) for r in rows]
