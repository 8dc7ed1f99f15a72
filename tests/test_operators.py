"""Operators on small invented fixtures."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from larkspur.functions.rules import RoleProfile
from larkspur.operators import dedupe, enrich, joins, learning, mail, merge, review, score, search, summary
from larkspur.plans.flows import Wishes, blocked_location, import_mails, real_location, scan
from larkspur.schemas import FEEDBACK, JOBS, MAILS
from larkspur.sources.tables import written

def now():
    return F.lit("2024-03-01").cast("timestamp")


def jobs(spark, *rows):
    """Postings from dicts, with the columns the operators need."""
    names = ["id", "title", "company", "location", "description", "source", "url", "via", "sourceQuery", "status"]
    data = [tuple(r.get(n, {"company": "Acme", "description": "", "source": "Drushim", "url": "https://x.example/1", "status": "found"}.get(n)) for n in names) + (i,) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, ", ".join(f"{n} string" for n in names) + ", ingest_seq long")


def test_best_keeps_first_of_equals_and_first_place(spark):
    rows = spark.createDataFrame([(0, "a", 5), (1, "b", 1), (2, "a", 9), (3, "a", 9), (4, None, 1), (5, "", 1)], "ingest_seq long, k string, n int")
    got = {r["k"]: (r["ingest_seq"], r["position"]) for r in dedupe.best_by_key(rows, F.col("k"), F.col("n")).collect()}
    assert got == {"a": (2, 0), "b": (1, 1)}


def test_fold_goes_in_order(spark):
    rows = spark.createDataFrame([(2, "a", "z"), (0, "a", "x"), (1, "a", "y")], "ingest_seq long, k string, s string")
    fold = dedupe.fold_by_key(rows, F.col("k"), lambda a, b: F.struct(a["ingest_seq"].alias("ingest_seq"), a["k"].alias("k"), F.concat(a["s"], b["s"]).alias("s")))
    assert [r["s"] for r in fold.collect()] == ["xyz"]


def test_upsert(spark):
    old = spark.createDataFrame([("k1", "1", "old", "haifa", "applied", 1), ("k2", "2", "stay", "x", "", 3)], "job_key string, id string, title string, location string, status string, seenCount int")
    new = spark.createDataFrame([("k1", "9", "", "סוג משרה מלאה", "found", 0), ("k3", "3", "new", "y", "found", 0)], "job_key string, id string, title string, location string, status string, seenCount int")
    got = {r["job_key"]: r for r in merge.upsert(old, new, now()).collect()}
    assert (got["k1"]["id"], got["k1"]["title"], got["k1"]["status"], got["k1"]["location"], got["k1"]["seenCount"]) == ("1", "", "applied", "haifa", 2)
    assert (got["k2"]["title"], got["k2"]["seenCount"]) == ("stay", 3)
    assert (got["k3"]["id"], got["k3"]["seenCount"]) == ("3", 1)


def test_variants_real_location_wins(spark):
    rows = jobs(spark, {"id": "a", "title": "QA", "location": "Israel", "url": "https://x/?JobID=1", "company": "חברה חסויה"}, {"id": "b", "title": "QA", "location": "חיפה", "url": "https://x/?JobID=1", "description": "d" * 10}).withColumn("locationKey", F.when(F.col("location") == "חיפה", "haifa"))
    got = merge.merge_variants(rows, real_location, blocked_location).collect()
    assert len(got) == 1
    assert (got[0]["location"], got[0]["locationKey"], got[0]["company"], got[0]["id"], len(got[0]["description"])) == ("חיפה", "haifa", "Acme", "a", 10)


@pytest.mark.parametrize(
    ("job", "family", "kind"),
    [
        ({"title": "Manual QA tester"}, "qa", "qa_manual"), ({"title": "QA Automation"}, "qa", "qa_automation"), ({"title": "strong person"}, "qa", "qa_general"), ({"title": "CRM מיישם"}, "information_systems", "implementer"),
        ({"title": "Data entry"}, "operations", "data_entry"), ({"title": "אחות"}, "irrelevant", "irrelevant_non_software"), ({"title": "Cook"}, "unknown", "unknown"), ({"title": "sales guru"}, "sales", "sales"),
    ],
)
def test_roles(spark, job, family, kind):
    r = enrich.role_columns(jobs(spark, job)).first()
    assert (r["roleFamily"], r["roleType"]) == (family, kind)


def test_location_by_table_order(spark):
    r = enrich.location_columns(jobs(spark, {"title": "QA Haifa or north", "location": "Israel"})).first()
    assert (r["location"], r["locationKey"], r["locationConfidence"]) == ("חיפה", "haifa", "matched_text")


def test_profile_sets_role_unless_sure(spark):
    profile = RoleProfile("ana", "Analyst", ["analyst"], role_family="analysis", main_list_min_score=60)
    rows = enrich.enrich(jobs(spark, {"title": "Risk analyst"}, {"title": "QA analyst"}), [profile])
    got = {r["title"]: (r["roleFamily"], r["roleProfileId"]) for r in rows.collect()}
    assert got == {"Risk analyst": ("analysis", "ana"), "QA analyst": ("qa", None)}


def test_score_and_gates(spark):
    rows = enrich.finalize(jobs(spark, {"id": "1", "title": "QA software tester junior", "location": "Haifa"}, {"id": "2", "title": "QA software tester", "location": "Jerusalem"}, {"id": "3", "title": "Java developer"}, {"id": "4", "title": "נציג שירות"}))
    # written in between, as the flow does: a filter over a long chain of rules would be copied into each of them
    scored = written(score.after_scoring(score.score(score.before_scoring(written(rows)))))
    got = {r["id"]: r for r in scored.collect()}
    assert (got["1"]["fitScore"], got["1"]["recommendation"]) == (20 + 38 + 18 + 16, "apply")
    assert (got["2"]["recommendation"], got["2"]["status"]) == ("skip", "skipped") and got["2"]["fitScore"] <= 40
    assert (got["3"]["fitScore"], got["3"]["roleFamily"], got["3"]["status"]) == (0, "irrelevant", "skipped")
    assert got["4"]["fitScore"] == 0
    kept = [r["id"] for r in score.main_list(scored).collect()]
    assert kept == ["1"]


def test_learning_clamps_and_skips_own_rows(spark):
    log = [(f"f{i}", "other", "rejected", "location", "QA", "Haifa", dt.datetime(2024, 1, 1, 0, i)) for i in range(10)] + [("own", "j1", "interview", None, "QA", "Haifa", dt.datetime(2024, 1, 2))]
    feedback = spark.createDataFrame(log, "id string, jobId string, action string, rejectionReason string, title string, location string, createdAt timestamp")
    r = learning.learning_columns(jobs(spark, {"id": "j1", "title": "x", "location": "haifa"}), feedback).first()
    assert r["learning_adjustment"] == -32 and any("haifa" in w for w in r["learning_warnings"])
    empty = learning.learning_columns(jobs(spark, {"id": "j1", "title": "x"}), feedback.limit(0)).first()
    assert empty["learning_adjustment"] == 0 and empty["learning_warnings"] == []


def test_feedback_rejects_unknown_action(spark):
    with pytest.raises(ValueError):
        learning.feedback_rows(jobs(spark, {"id": "1", "title": "x"}), "liked", now())
    row = learning.feedback_rows(jobs(spark, {"id": "1", "title": "x"}), "deleted", now(), "nonsense").first()
    assert (row["action"], row["rejectionReason"]) == ("deleted", None)


def test_review_queue(spark):
    audit = jobs(spark, {"title": "a"}, {"title": "b"}, {"title": "c"}).withColumns({"locationKey": F.lit("haifa"), "kept": F.lit(False), "decision": F.lit("filtered_other"), "recommendation": F.lit("review"), "fitScore": F.lit(60), "url": F.lit("")})
    saved = audit.where("title = 'a'")
    feedback = audit.where("title = 'b'").withColumn("action", F.lit("rejected"))
    got = review.review_queue(audit, saved, feedback).collect()
    assert [r["title"] for r in got] == ["c"] and got[0]["reviewKey"] == "c|acme|haifa"


def test_marks_and_steps(spark):
    a, b = spark.createDataFrame([(1,), (2,), (3,)], "k int"), spark.createDataFrame([(1,), (1,), (None,)], "k int")
    assert {r["k"]: r["m"] for r in joins.marked(a, [(F.col("k"), b, "k"), (F.col("k") - 1, b, "k")], "m").collect()} == {1: True, 2: True, 3: False}
    steps = joins.scan_steps(spark.createDataFrame([(0, "q"), (1, "r")], "query_index int, query string"), ["x", "y", "x"]).orderBy("step")
    assert [r["step_id"] for r in steps.collect()] == ["0:x", "0:y", "1:x", "1:y"]


def test_search_and_retention(spark):
    rows = jobs(spark, {"id": "1", "title": "Python QA"}, {"id": "2", "title": "Cook"}).withColumns({"fitScore": F.lit(90), "reasons": F.array(F.lit("tail")), "foundAt": F.lit("2023-01-01").cast("timestamp"), "status": F.when(F.col("id") == "1", "archived").otherwise("applied")})
    assert [r["id"] for r in search.search(rows, search.Facets(term="python", band="excellent")).collect()] == ["1"]
    assert search.retained(rows, now(), 30, 1000).count() == 1
    with pytest.raises(ValueError):
        search.sort_order("nonsense")


def test_summaries(spark):
    rows = spark.createDataFrame([("a", True, "apply"), ("a", False, None), (None, None, "review")], "source string, kept boolean, recommendation string")
    got = [tuple(r) for r in summary.scan_summary(rows).collect()]
    assert got == [("a", 2, 1, 1, 1, 0), ("unknown", 1, 0, 1, 0, 1)]


def mails(spark, *rows):
    names = [f.name for f in MAILS]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], MAILS)


DIGEST = "שלום חדש! QA Engineer חברה: Acme מקום העבודה: חיפה סוג משרה: מלאה על התפקיד: בדיקות לצפייה במשרה Data analyst חברה: Beta מקום העבודה: עכו סוג משרה: חלקית לצפייה במשרה"


def test_mail_candidates(spark):
    rows = mails(
        spark,
        {"gmailMessageId": "m1", "title": "jobs", "sender": "x@alljobs.co.il", "bodyText": DIGEST, "links": ["https://www.alljobs.co.il/?JobID=1", "https://www.alljobs.co.il/?JobID=2"]},
        {"gmailMessageId": "m2", "title": "verification code 123"},
        {"gmailMessageId": "m3", "title": "QA role", "sender": "HR <hr@x.com>", "links": ["https://www.drushim.co.il/job/5"]},
        {"gmailMessageId": "m4", "title": "5 more QA jobs", "links": ["https://il.indeed.com/?jk=a1", "https://il.indeed.com/?jk=b2"]},
    )
    got = {}
    for r in mail.candidates(rows).collect():
        got.setdefault(r["gmailMessageId"], []).append(r)
    assert [(r["title"], r["company"], r["location"], r["url"][-1]) for r in got["m1"]] == [("QA Engineer", "Acme", "חיפה", "1"), ("Data analyst", "Beta", "עכו", "2")]
    assert "m2" not in got and not got["m3"][0]["gmailDigest"] and got["m4"][0]["gmailDigest"]
    assert got["m3"][0]["company"] == "HR"


def test_flows(spark):
    raw = spark.createDataFrame([("QA tester junior software", "https://www.drushim.co.il/job/1", "חיפה", "Acme", "qa"), ("no link", "", "", "", "qa")], "title string, link string, location string, company string, sourceQuery string").withColumn("description", F.lit("manual testing"))
    stored = spark.createDataFrame([], JOBS).drop("ingest_seq")
    out = scan({"drushim": raw}, stored, spark.createDataFrame([], FEEDBACK), Wishes(), now())
    assert [r["title"] for r in out.kept.collect()] == ["QA tester junior software"] and out.new.count() == 1
    assert out.audit.first()["decision"] == "kept_duplicate_or_saved" and out.stored.first()["seenCount"] == 1
    found, fresh = import_mails(mails(spark, {"gmailMessageId": "m1", "title": "QA", "sender": "x@alljobs.co.il", "bodyText": DIGEST, "links": []}), spark.createDataFrame([], "gmailMessageId string"), stored, spark.createDataFrame([], FEEDBACK), Wishes())
    assert fresh.count() == 2 and found.count() == 2
    assert set(r["status"] for r in fresh.collect()) == {"found"}


def test_scan_of_one_file_is_scored_by_several_tasks(spark, tmp_path):
    rows = [(f"QA tester {i}", "Acme", "Haifa", f"https://x.example/j/{i}", "manual testing") for i in range(200)]
    spark.createDataFrame(rows, "title string, company string, location string, link string, description string").withColumn("sourceQuery", F.lit("q")).coalesce(1).write.parquet(f"{tmp_path}/landed")
    stored = spark.createDataFrame([], JOBS).drop("ingest_seq")
    out = scan({"drushim": spark.read.parquet(f"{tmp_path}/landed")}, stored, spark.createDataFrame([], FEEDBACK), Wishes(), now())
    assert out.scored.count() == 200
    assert len([f for f in out.scored.inputFiles() if f.endswith(".parquet")]) > 1
