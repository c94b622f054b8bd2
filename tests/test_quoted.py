"""Quoted CSV read in splits against Spark's own reader, which takes a file whole."""

import csv
import io
import random

import pytest

from jobfleet.sources import job_ids as ids
from jobfleet.sources import quoted

HARD = [
    '1,"two\nlines"\n2,x\n',
    'id,name\n1,"a ""quoted"" word"\n"2","x,\n\ny"\n3,z\n',
    '1,5" pipe\n2,6"\n3,"ok"\n',
    '"1\n","x"\n"\n2",y\n3,"""\n"""\n4,""\n',
    '1,"a"b\n2,c"d"\n3,"e\n""\nf"\n\n\n4\n',
    "1\n2\n3\n",
    '1,"\n\n\n"\n2,"","",""\n3,",\n,"\n',
    '﻿"7",x\n8,"y\n9,z"\n10,\n',
]


def whole(spark, path):
    """First cells as Spark's own reader sees them with one task a file."""
    rows = spark.read.schema("cell string").csv(str(path), header=False, escape='"', multiLine=True, lineSep="\n").collect()
    return [(r.cell or "").strip("﻿ \n\t") for r in rows]


def in_splits(spark, path, size):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        cells = quoted.first_cells(spark, str(path)).orderBy("record").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [c.record for c in cells] == list(range(len(cells)))
    return [c.cell.strip("﻿ \n\t") for c in cells]


@pytest.mark.parametrize("text", HARD)
def test_cells_are_those_of_the_whole_file(spark, tmp_path, monkeypatch, text):
    monkeypatch.setattr(quoted, "CHUNK", 2)
    (tmp_path / "ids.csv").write_text(text)
    assert in_splits(spark, tmp_path / "ids.csv", 9) == whole(spark, tmp_path / "ids.csv")


def test_random_files_in_many_splits(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(quoted, "CHUNK", 5)
    rng = random.Random(8)
    pieces = ["a", ",", '"', "\n", "1", '""', "x y", ",\n", '",\n"']
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    for k in range(400):
        writer.writerow([k, *["".join(rng.choices(pieces, k=rng.randrange(6))) for _ in range(rng.randrange(4))]])
    (tmp_path / "ids.csv").write_text(out.getvalue())
    assert in_splits(spark, tmp_path / "ids.csv", 500) == [str(k) for k in range(400)]


def test_a_large_quoted_file_is_read_by_many_tasks(spark, tmp_path):
    lines = "".join(f'{k},"name\n{k}, more ""text""\n"\n' for k in range(20_000))
    (tmp_path / "ids.csv").write_text("job_id,name\n" + lines)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        read = spark.read.text(str(tmp_path / "ids.csv")).rdd.getNumPartitions()
        found = ids.load_job_ids(spark, str(tmp_path / "ids.csv"), multi_line=True).orderBy("pos").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert read > 10
    assert [(f.job_id, f.pos) for f in found] == [(k, k + 1) for k in range(20_000)]


def test_tasks_grow_with_the_bytes_of_lines_and_shuffle_no_file_names(spark, tmp_path, monkeypatch):
    (tmp_path / "ids.csv").write_text("".join(f'{k},"name\n{k}"\n' for k in range(2_000)))
    plans = {}
    staged = quoted.stage

    def watched(frame, name):
        plans[name] = frame._jdf.queryExecution().optimizedPlan().toString()
        return staged(frame, name)

    monkeypatch.setattr(quoted, "stage", watched)
    monkeypatch.setattr(quoted, "CHUNK", 50)
    monkeypatch.setattr(quoted, "TASK_BYTES", 40_000, raising=False)
    cells = quoted.first_cells(spark, str(tmp_path / "ids.csv")).orderBy("record").collect()
    assert [c.cell for c in cells] == [str(k) for k in range(2_000)]
    # 4,000 lines of 100 bytes and their text
    tasks = -(-sum(100 + len(line) for line in (tmp_path / "ids.csv").read_text().splitlines()) // 40_000)
    dealt = [line for line in plans["csv-states"].splitlines() if "RepartitionByExpression" in line]
    assert len(dealt) == 1 and dealt[0].endswith(f", {tasks}") and "file" not in dealt[0]
