import base64
import json

from pyspark.sql import functions as F

from larkspur.schemas import FEEDBACK, PROFILES
from larkspur.sources import landed, providers, tables
from larkspur.sources.versions import VersionedTable
from larkspur.streaming import scan


def test_missing_table_is_empty(spark, tmp_path):
    assert tables.json_table(spark, str(tmp_path / "none.json"), FEEDBACK).count() == 0


def test_profiles(spark, tmp_path):
    path = tmp_path / "p.json"
    path.write_text(json.dumps([{"id": "a", "name": "A", "positivePatterns": ["x"]}, {"id": "b", "enabled": False}]))
    assert [p.id for p in tables.role_profiles(spark, str(path))] == ["a"]
    assert tables.json_table(spark, str(path), PROFILES).count() == 2


def test_cards(spark):
    html = "<ul><li><a href='/job/1'>QA engineer</a> in Haifa, a long enough description here</li><li><a href='/x'>no</a></li></ul><script>var a = '<li>';</script>"
    rows = landed.html_cards(spark.createDataFrame([(1, html), (2, None)], "page int, html string"), link_pattern="/job/")
    assert [(r["page"], r["link"], r["title"]) for r in rows.collect()] == [(1, "/job/1", "QA engineer")]


def test_mime(spark):
    b = lambda s: base64.urlsafe_b64encode(s.encode()).decode().rstrip("=")
    payload = {"mimeType": "multipart/alternative", "parts": [{"mimeType": "text/plain", "body": {"data": b("see https://x.co/a.")}}, {"mimeType": "text/html", "body": {"data": b("<a href='https://y.co/?a=1&amp;b=2'>y</a>")}}]}
    r = landed.mails_of(spark.createDataFrame([(json.dumps(payload),), (None,), ("{",)], "payload string")).collect()
    assert r[0]["links"] == ["https://y.co/?a=1&b=2", "https://x.co/a"] and r[0]["bodyText"].startswith("see")
    assert r[1]["links"] == [] and r[2]["bodyText"] == ""


def test_mail_time(spark):
    rows = spark.createDataFrame([("1700000000000", None), (None, "Tue, 14 Nov 2023 22:13:20 +0000"), ("x", "junk")], "ms string, h string")
    got = [r["t"] and r["t"].isoformat() for r in rows.select(landed.mail_time(F.col("ms"), F.col("h")).alias("t")).collect()]
    assert got[0] is not None and got[0] == got[1] and got[2] is None


def test_provider_defaults(spark):
    rows = spark.createDataFrame([("", None, "u", None, "q"), ("T", "L" * 90, "u2", "", "q")], "title string, location string, link string, company string, sourceQuery string").withColumn("description", F.lit(None).cast("string"))
    got = providers.collected({"alljobs": rows}, F.lit("2024-01-01").cast("timestamp")).collect()
    assert [(r["title"], r["location"], r["company"], r["description"]) for r in got] == [("T", "Israel", "AllJobs", "")]
    assert len(providers.providers_of("both")) == 3


def test_stream_resumes_and_upserts(spark, tmp_path):
    src, table, ck = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "ck")
    src.mkdir()

    def land(name, *rows):
        (src / name).write_text("\n".join(json.dumps({"k": k, "v": v}) for k, v in rows))

    merge = lambda old, new: old.join(new.select("k"), "k", "left_anti").unionByName(new)
    writer = scan.table_upsert(table, "k", lambda b: b, merge)
    run = lambda: scan.run_available(scan.landed_stream(spark, str(src), FEEDBACK.__class__.fromDDL("k string, v int")), ck, writer).awaitTermination()
    land("a.json", ("x", 1), ("y", 1))
    run()
    land("b.json", ("x", 2), ("z", 1))
    run()
    run()
    assert {r["k"]: r["v"] for r in scan.newest(spark, table).collect()} == {"x": 2, "y": 1, "z": 1}
    assert [m.batch for m in map(VersionedTable(spark, table).manifest, VersionedTable(spark, table).numbers())] == [0, 1]


def test_jobs_before_state(spark, tmp_path):
    import pytest

    bad = spark.range(1).select(F.raise_error(F.lit("no")).alias("x"))
    with pytest.raises(Exception, match="no"):
        scan.persist_import(bad, str(tmp_path / "jobs"), spark.range(1), str(tmp_path / "state"))
    assert not (tmp_path / "state").exists()
