from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from conftest import fleet, job
from jobfleet.functions import filters as f
from jobfleet.schemas import parse_events


def kept(spark, rows, predicate):
    return sorted(r.job_id for r in fleet(spark, rows).filter(predicate).collect())


def flags(spark, rows, predicate):
    found = fleet(spark, rows).select("job_id", predicate.alias("flag")).collect()
    return {r.job_id: r.flag for r in found}


def test_bundle_is_a_case_insensitive_substring_and_never_null(spark):
    rows = [
        job(1, kind="BUNDLE"), job(2, kind="bundle"), job(3, kind="X_Bundle_Y"), job(4, kind="MANUAL"),
        job(5, path="/p"), job(6), job(7, settings=False), job(8, kind=""),
    ]
    expected = {1: True, 2: True, 3: True, 4: False, 5: False, 6: False, 7: False, 8: False}
    assert flags(spark, rows, f.is_bundle()) == expected


def test_tag_forms(spark):
    rows = [
        job(1, tags={"k": "v"}), job(2, tags={"k": ""}), job(3, tags={"o": "v"}), job(4), job(5, settings=False),
        job(6, tags={"k": "a=b"}), job(7, tags={"k": "V"}), job(8, tags={"k": None}),
    ]
    assert kept(spark, rows, f.tag_matches("k=v")) == [1]
    assert kept(spark, rows, f.tag_matches("k")) == [1, 2, 6, 7, 8]
    assert kept(spark, rows, f.tag_matches("k=")) == [2]
    assert kept(spark, rows, f.tag_matches("k=a=b")) == [6]
    everything = [1, 2, 3, 4, 5, 6, 7, 8]
    assert kept(spark, rows, f.tag_matches("=v")) == everything
    assert kept(spark, rows, f.tag_matches("")) == everything
    assert kept(spark, rows, f.tag_matches(None)) == everything
    assert None not in flags(spark, rows, f.tag_matches("k=v")).values()


def test_owner_is_exact_and_null_counts_as_empty(spark):
    rows = [job(1, creator="ann"), job(2, creator="Ann"), job(3, creator=None), job(4, creator="")]
    assert kept(spark, rows, f.owner_in(["ann", "zoe"])) == [1]
    assert kept(spark, rows, f.owner_in([""])) == [3, 4]
    assert kept(spark, rows, f.owner_in([])) == [1, 2, 3, 4]
    assert None not in flags(spark, rows, f.owner_in(["ann"])).values()
    assert None not in flags(spark, rows, f.owner_in(["ann", ""])).values()


def test_name_filter_is_a_case_sensitive_substring(spark):
    rows = [job(1, name="my-etl-1"), job(2, name="ETL"), job(3, name=None), job(4, name=""), job(5, settings=False)]
    assert kept(spark, rows, f.name_contains("etl")) == [1]
    assert kept(spark, rows, f.name_contains("")) == [1, 2, 3, 4, 5]


def test_names_and_creators(spark):
    rows = [job(1, name=None, creator=None), job(2, name="", creator=""), job(3, settings=False), job(4)]
    found = fleet(spark, rows).select(f.display_name(), f.creator_label()).collect()
    assert [tuple(r) for r in found] == [
        ("<unnamed>", "<unknown>"), ("<unnamed>", "<unknown>"), ("<unnamed>", "ann"), ("job", "ann"),
    ]


URLS = [
    "https://h/x", "http://h", "HTTPS://h/x", "Http://h", "ftp://x/y", "https://", "https:///x", "https://?q",
    "https://#f", "not a url", "", "https:h", " https://h", "\thttps://h", "ht\ntps://h", "https://u:p@h:1/x",
    "//h/x", "https://h h", "xhttps://h",
]


def test_url_status_follows_url_parsing(spark):
    def expected(url):
        parsed = urlparse(url)
        if parsed.scheme not in ("http", "https") or not parsed.netloc:
            return "invalid"
        return "valid" if parsed.scheme == "https" else "insecure"

    frame = spark.createDataFrame([(u,) for u in URLS], "url string")
    found = {r.url: r.status for r in frame.select("url", f.url_status(F.col("url")).alias("status")).collect()}
    assert found == {u: expected(u) for u in URLS}


def test_transient_errors(spark):
    cases = [
        ("Rate limit", None, True), ("failed to iterate page", None, True), ("too many requests", "X", True),
        ("job 14290 missing", None, True), ("internal error", None, True), ("temporarily unavailable", "", True),
        ("boom", "503", True), ("boom", "5", True), ("boom", "403", False), (None, None, False), ("", "", False),
    ]
    frame = spark.createDataFrame([c[:2] for c in cases], "message string, code string")
    found = [r[0] for r in frame.select(f.is_transient(F.col("message"), F.col("code"))).collect()]
    assert found == [c[2] for c in cases]


def test_host_list(spark):
    frame = spark.createDataFrame([(" https://a/ ,,https://b// , ",), ("",), (None,), ("x,/",)], "raw string")
    found = [r[0] for r in frame.select(f.host_list(F.col("raw"))).collect()]
    assert found == [["https://a", "https://b"], [], [], ["x", ""]]


def test_event_names_are_checked():
    assert parse_events(" on_start , on_failure,") == ["on_start", "on_failure"]
    assert parse_events("") == []
    with pytest.raises(ValueError, match="on_retry"):
        parse_events("on_failure,on_retry")
