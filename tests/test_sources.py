import gzip
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from conftest import block, fleet, job
from jobfleet import runs
from jobfleet.schemas import DESTINATION_PAGES, HOST
from jobfleet.sources import bundles as b
from jobfleet.sources import job_ids as ids
from jobfleet.sources import on_demand
from jobfleet.sources import pages as pg
from jobfleet.sources import snapshots as s


def load(spark, tmp_path, text):
    path = tmp_path / "ids.csv"
    path.write_bytes(text.encode("utf-8"))
    return [x.job_id for x in ids.load_job_ids(spark, str(path)).orderBy("pos").collect()]


def test_id_file_with_every_oddity(spark, tmp_path):
    text = '﻿job_id,name\r\n\r\n 12 ,a\n"13","x,y"\n\n   \n+5\n-4\n1_000\n12\n'
    assert load(spark, tmp_path, text) == [12, 13, 5, -4, 1000, 12]


def test_id_file_without_header(spark, tmp_path):
    assert load(spark, tmp_path, "﻿7\n8\n") == [7, 8]
    assert load(spark, tmp_path, "\n\n9") == [9]


@pytest.mark.parametrize(
    "text, message",
    [
        ("1\nabc\n2\n", "abc"), ("job_id\nother\n1\n", "other"), ("1\n2.5\n", "2.5"), ("header\n", "lists nothing"),
        ("", "lists nothing"), ("\n \n", "lists nothing"), ("1\n99999999999999999999\n", "99999999999999999999"),
    ],
)
def test_bad_id_files(spark, tmp_path, text, message):
    with pytest.raises(ids.BadJobIds, match=message):
        load(spark, tmp_path, text)


def test_id_positions_follow_files_and_splits(spark, tmp_path):
    """Many files, several splits each: positions are those of one long file."""
    folder = tmp_path / "many"
    folder.mkdir()
    for part in range(3):
        lines = "".join(f"{part * 1000 + i:06d}\n" for i in range(1000))
        (folder / f"part-{part}").write_text(("job_id\n" if part == 0 else "") + lines)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        found = ids.load_job_ids(spark, str(folder)).orderBy("pos").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [x.job_id for x in found] == list(range(3000))
    assert [x.pos for x in found] == list(range(1, 3001))


def test_job_snapshots_from_json_and_parquet(spark, tmp_path):
    frame = fleet(spark, [job(1, hooks=block(on_start=["a", None]), tags={"k": "v"}), job(2, settings=False)])
    frame.write.json(str(tmp_path / "json"))
    frame.write.partitionBy(HOST).parquet(str(tmp_path / "parquet"))
    expected = sorted(frame.collect())
    for format in ("json", "parquet"):
        found = s.read_jobs(spark, str(tmp_path / format), format).select(*frame.columns)
        assert sorted(found.collect()) == expected


def test_destination_pages(spark, tmp_path):
    pages = [
        {"workspace_host": "h", "page": 0, "results": [{"id": "a", "display_name": "n"}, {"id": "b", "display_name": "n"}],
         "next_page_token": "t"},
        {"workspace_host": "h", "page": 1, "results": None, "next_page_token": "u"},
        {"workspace_host": "h", "page": 2, "results": [{"id": "c", "display_name": "n", "destination_type": "W"}]},
        {"workspace_host": "h", "page": 3},
    ]
    (tmp_path / "pages.json").write_text("\n".join(json.dumps(p) for p in pages))
    listed = s.scan_destinations(s.read_destination_pages(spark, str(tmp_path / "pages.json"))).orderBy("ordinal")
    assert [(x.id, x.destination_type) for x in listed.collect()] == [("a", None), ("b", None), ("c", "W")]


BUNDLE = {"name": "b", "target": "prod", "git": {"origin_url": "u", "branch": "m", "commit": "c"}}
WORKSPACE = {"root_path": "/r", "file_path": "/f"}
ALL = ("b", "prod", "u", "m", "c", "/r", "/f")
NONE = (None,) * 7
DOCUMENTS = {
    "wrapped": (json.dumps({"config": {"bundle": BUNDLE, "workspace": WORKSPACE}}), ALL),
    "bare": (json.dumps({"bundle": BUNDLE, "workspace": WORKSPACE}), ALL),
    "config-text": (json.dumps({"config": "x", "bundle": BUNDLE, "workspace": WORKSPACE}), ALL),
    "config-list": (json.dumps({"config": [1], "bundle": BUNDLE, "workspace": WORKSPACE}), ALL),
    "config-null": (json.dumps({"config": None, "bundle": BUNDLE, "workspace": WORKSPACE}), ALL),
    "config-empty": (json.dumps({"config": {}, "bundle": BUNDLE}), NONE),
    "cased": (
        json.dumps({"config": {"bundle": {"git": {"OriginURL": "u", "Branch": "m", "Commit": "c"}}}}),
        (None, None, "u", "m", "c", None, None),
    ),
    "blank-then-cased": (
        json.dumps({"bundle": {"git": {"origin_url": "", "OriginURL": "u"}}}),
        (None, None, "u", None, None, None, None),
    ),
    "not-nested": (json.dumps({"config": {"bundle": "x", "workspace": 3}}), NONE),
    "list": ("[1, 2]", NONE),
    "scalar": ('"text"', NONE),
    "truncated": ('{"config": {"bundle": {"name": "b"', NONE),
    "trailing": ('{"config": {"bundle": {"name": "b"}}} x', NONE),
    "bracket": ('{"bundle": {"name": "b"}}]', NONE),
    "brace": ('{"bundle": {"name": "b"}}}', NONE),
    "closed-early": ('{"bundle": {"name": "b"}} ] rest', NONE),
    "second-member": ('{"bundle": {"name": "b"}}, "more": {}', NONE),
    "empty": ("", NONE),
}


def test_bundle_metadata_variants(spark, tmp_path):
    for name, (text, _) in DOCUMENTS.items():
        (tmp_path / name).write_text(text)
    documents = s.read_metadata_documents(spark, str(tmp_path))
    found = {Path(x.path).name: tuple(x)[1:] for x in s.bundle_metadata(documents).collect()}
    for name, (text, expected) in DOCUMENTS.items():
        if text:  # an empty file has no text row at all
            assert found[name] == expected, name


PATTERNS = [
    "*.yml", "resources/*.yml", "resources/**/*.yml", "**/*.yml", "./resources/job?.yml", "r[e]s*/*.yml",
    "resources/job[!1].yml", "**/a.yml", "resources/**", "a+b/(x).yml", "none/*.yml",
]
PATHS = [
    "bundle.yml", "a.yml", "a.yaml", "resources/job1.yml", "resources/job2.yml", "resources/job10.yml",
    "resources/deep/a.yml", "resources/deep/er/b.yml", "other/a.yml", "a+b/(x).yml", "aab/x.yml", ".hidden.yml",
]


@pytest.fixture
def bundle_tree(tmp_path):
    for path in PATHS:
        file = tmp_path / "one" / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text("{}")
    return tmp_path


@pytest.mark.parametrize("pattern", PATTERNS)
def test_include_patterns_match_like_path_globs(spark, bundle_tree, pattern):
    root = bundle_tree / "one"
    expected = sorted(str(p.relative_to(root)) for p in root.glob(pattern) if p.is_file())
    frame = spark.createDataFrame([(p,) for p in PATHS], "path string")
    found = frame.filter(F.rlike("path", b.glob_regex(F.lit(pattern))))
    assert sorted(x.path for x in found.collect()) == expected


def test_discovery_order_and_dedup(spark, bundle_tree):
    root = bundle_tree / "one" / "bundle.yml"
    root.write_text("include:\n  - resources/deep/**/*.yml\n  - resources/*.yml\n  - '**/*.yml'\n")
    (bundle_tree / "two").mkdir()
    (bundle_tree / "two" / "bundle.yml").write_text("resources: {}\n")
    (bundle_tree / "two" / "a.yml").write_text("{}")
    files = b.discover_files(b.read_bundle_files(spark, str(bundle_tree)), "bundle.yml")
    found = files.orderBy("bundle", *b.file_order()).collect()
    expected = ["bundle.yml"]
    for pattern in ("resources/deep/**/*.yml", "resources/*.yml", "**/*.yml"):
        matches = [str(p.relative_to(root.parent)) for p in sorted(root.parent.glob(pattern))]
        # Spark's file listing leaves hidden files out.
        expected += [p for p in matches if p not in expected and not p.startswith(".")]
    assert [x.path for x in found if x.bundle == "one"] == expected
    assert [x.path for x in found if x.bundle == "two"] == ["bundle.yml"]
    single = b.read_bundle_files(spark, str(bundle_tree / "two"), bundle="solo")
    assert sorted((x.bundle, x.path) for x in single.collect()) == [("solo", "a.yml"), ("solo", "bundle.yml")]


def test_metadata_paths_are_those_that_jobs_name(spark, tmp_path):
    file = tmp_path / "export" / "Team A" / "b+1" / "metadata.json"
    file.parent.mkdir(parents=True)
    file.write_text("{}")
    found = s.read_metadata_documents(spark, str(tmp_path / "export"), "/Workspace/bundles/").collect()
    assert [x.path for x in found] == ["/Workspace/bundles/Team A/b+1/metadata.json"]


def test_a_listing_that_breaks_off_is_noticed(spark):
    rows = [("a", 0, "next"), ("a", 1, ""), ("b", 0, "next"), ("c", 0, None), ("d", 0, "x"), ("d", 2, None)]
    pages = spark.createDataFrame(rows, "workspace_host string, page long, next_page_token string")
    assert sorted(x.workspace_host for x in s.cut_listings(pages).collect()) == ["b", "d"]
    with pytest.raises(s.CutListings, match="2 destination"):
        s.require_whole_listings(pages)


def test_id_cells_may_hold_line_breaks_and_every_file_a_header(spark, tmp_path):
    (tmp_path / "1.csv").write_text('job_id,name\n1,"two\nlines"\n2,x\n')
    (tmp_path / "2.csv").write_text('job_id,name\n3,"a\nb"\n')
    found = ids.load_job_ids(spark, str(tmp_path), multi_line=True)
    assert sorted(x.job_id for x in found.collect()) == [1, 2, 3]


# Listings page by page ------------------------------------------------------


def listing(host, count, start=0, size=2):
    """A whole listing of ``count`` pages, as JSON lines."""
    pages = []
    for k in range(count):
        listed = [{"job_id": start + k * size + i, "settings": {"name": f"job {i}"}} for i in range(size)]
        page = {"jobs": listed, "page_token": f"{host}{k}" if k else None, "next_page_token": f"{host}{k + 1}" if k + 1 < count else ""}
        pages.append(json.dumps(page))
    return pages


def export(folder, listings):
    for host, pages in listings.items():
        place = folder / f"workspace_host={host}"
        place.mkdir(parents=True)
        for part in range(3):  # pages in any order, dealt to files
            (place / f"part-{part}.json").write_text("\n".join(pages[part::3][::-1]) + "\n")
    return str(folder)


def faults_of(spark, path, hosts=()):
    workspaces = spark.createDataFrame([(h,) for h in hosts], "workspace_host string") if hosts else None
    jobs, faults = pg.jobs_from_pages(pg.read_job_pages(spark, path), workspaces)
    return jobs, {f.workspace_host: f.error for f in faults.collect()}


def test_jobs_are_listed_in_the_order_of_the_chain(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("jobfleet.operators.order.WIDTH", 4)
    path = export(tmp_path, {"a": listing("a", 37), "b": listing("b", 1, 1000), "c": ['{"jobs": [], "next_page_token": null}']})
    jobs, faults = faults_of(spark, path)
    found = sorted((j.workspace_host, j.scan_ordinal, j.job_id) for j in jobs.collect())
    assert found == [("a", k, k) for k in range(74)] + [("b", 0, 1000), ("b", 1, 1001)]
    assert faults == {} and jobs.columns == fleet(spark, []).columns


def test_each_kind_of_fault_fails_its_own_workspace(spark, tmp_path):
    whole = {h: listing(h, 9) for h in ("ok", "cut", "text", "number", "gap", "start", "twice", "circle", "apart", "empty")}
    whole["cut"][4] = whole["cut"][4][:30]
    whole["text"][4] = "no page at all"
    whole["number"][4] = whole["number"][4].replace('"job_id": 8', '"job_id": "eight"')
    del whole["gap"][5], whole["start"][0]
    whole["twice"].append(whole["twice"][3])
    whole["circle"][8] = whole["circle"][8].replace('"next_page_token": ""', '"next_page_token": "circle4"')
    whole["apart"] += ['{"jobs": [], "page_token": "x", "next_page_token": "y"}', '{"jobs": [], "page_token": "y", "next_page_token": ""}']
    whole["empty"] = []
    jobs, faults = faults_of(spark, export(tmp_path, whole), ["ok", "cut", "empty", "absent"])
    assert {j.workspace_host for j in jobs.collect()} == {"ok"}
    told = {h: e.split(", such as")[0] for h, e in faults.items()}
    unreadable, broken = "1 record(s) cannot be read", "the listing breaks off before its last page"
    assert told == {
        "cut": unreadable, "text": unreadable, "number": unreadable, "gap": broken, "circle": broken,
        "start": "the first page is missing", "twice": "a page is there twice: twice3",
        "apart": "2 page(s) belong to no listing", "empty": "nothing was exported", "absent": "nothing was exported",
    }


def test_a_file_that_ends_early_fails_its_own_workspace(spark, tmp_path):
    """A compressed part that was cut off: what it still held of its last pages does not pass for a listing."""
    path = export(tmp_path, {"ok": listing("ok", 4), "torn": []})
    data = gzip.compress("\n".join(listing("torn", 400, size=30)).encode())
    (tmp_path / "workspace_host=torn" / "part-9.json.gz").write_bytes(data[: len(data) // 2])
    jobs, faults = faults_of(spark, path)
    assert {j.workspace_host for j in jobs.collect()} == {"ok"} and list(faults) == ["torn"]


@pytest.mark.parametrize("change", ["none", "last", "gap", "first", "token", "twice"])
def test_every_way_a_destination_listing_can_break(spark, change):
    pages = [("h", k, f"p{k}" if k else None, f"p{k + 1}" if k < 4 else None) for k in range(5)] + [("g", 7, None, "")]
    if change == "last":
        pages[4] = ("h", 4, "p4", "p5")
    elif change in ("gap", "first"):
        del pages[2 if change == "gap" else 0]
    elif change == "token":
        pages[2] = ("h", 2, "other", "p3")
    elif change == "twice":
        pages.append(pages[3])
    frame = spark.createDataFrame(pages, "workspace_host string, page long, page_token string, next_page_token string")
    assert [x.workspace_host for x in s.cut_listings(frame).collect()] == ([] if change == "none" else ["h"])


def test_a_run_over_a_cut_listing_is_refused(spark):
    pages = [("h", 0, None, [("d1", "hook", "W")], "more"), ("g", 0, None, [("d2", "hook", "W")], None)]
    frame = spark.createDataFrame(pages, DESTINATION_PAGES)
    jobs = fleet(spark, [job(1, host="h"), job(2, host="g")])
    workspaces = spark.createDataFrame([("h",), ("g",)], "workspace_host string")
    with pytest.raises(s.CutListings, match="such as those of \\['h'\\]"):
        runs.resolve(jobs, frame, "hook", workspaces)
    named, webhook_id = runs.resolve(jobs, frame.withColumn("next_page_token", F.lit(None).cast("string")), "hook", workspaces)
    assert {(x.job_id, x.id) for x in named.select("job_id", webhook_id.alias("id")).collect()} == {(1, "d1"), (2, "d2")}


# Metadata by name, patterns by bundle -----------------------------------------


def test_only_named_documents_are_read_and_the_rest_are_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(on_demand, "BATCH", 3)
    names = ["a/m.json", "b c/m+1.json", "d{1,2}/m[x]?.json", "e,f/*.json", "g/m.json"]
    for name in [*names, "a/other.json", "a/m.json.1", "h/m.json", "dir.json/x"]:
        file = tmp_path / "export" / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(f"text of {name}")
    (tmp_path / "export" / "empty.json").write_text("")
    (tmp_path / "export" / "torn.json.gz").write_bytes(gzip.compress(b"x" * 9000)[:20])
    (tmp_path / "secret.json").write_text("outside")
    lost = ["no/m.json", "empty.json", "torn.json.gz", "dir.json", "z/m.json"]
    outside = ["/Workspace/../secret.json", "/Other/m.json", "/Workspace/a//m.json", "/Workspace/"]
    paths = [f"/Workspace/{n}" for n in names + lost] + outside
    frame = spark.createDataFrame([(p,) for p in paths + paths[:3]], "path string")
    for root in (str(tmp_path / "export"), f"file://{tmp_path}/export/"):
        found = {r.path: (r.content, r.error) for r in on_demand.fetch_documents(frame, root).collect()}
        want = {f"/Workspace/{n}": (f"text of {n}", None) for n in names}
        want |= {f"/Workspace/{n}": (None, "is missing, empty or cannot be read") for n in lost}
        want |= {p: (None, "lies outside the workspace folder") for p in outside}
        assert found == want
    read = on_demand.named_files(spark, str(tmp_path / "export"), ["a/m.json", "no/m.json", "g/m.json"]).inputFiles()
    assert sorted(Path(x).parent.name for x in read) == ["a", "g"]
    assert on_demand.named_files(spark, str(tmp_path / "export"), ["no/m.json"]) is None
    assert on_demand.fetch_documents(frame.limit(0), str(tmp_path)).count() == 0


def test_a_glob_set_tells_the_first_pattern_that_matches(spark):
    patterns = PATTERNS + [f"n{k}/*.yml" for k in range(30)]
    paths = [*PATHS, "n7/a.yml", "n29/a.yml", "n3/x.yml,3", "none"]
    each = [p for p in patterns]
    frame = spark.createDataFrame([(p, each) for p in paths] + [(p, []) for p in paths], "path string, globs array<string>")
    found = frame.withColumn("patterns", b.glob_set(F.col("globs"))).select(
        "path", F.size("globs").alias("n"), b.first_match(F.col("path"), F.col("patterns")).alias("first"),
        (F.array_position(F.transform("globs", lambda g: F.rlike(F.col("path"), b.glob_regex(g))), True) - 1).alias("one_by_one"),
    )
    for row in found.collect():
        assert row.first == (row.one_by_one if row.n and row.one_by_one >= 0 else None), row
