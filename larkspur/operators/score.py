"""Scores, decision gates and the main-list gate of enriched postings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.text import held, clamped, join_truthy, keyword_hits, matches, rounded, seen, text_of, truthy, years_at_least

c = F.col
_NONE = "cast(array() as array<string>)"


def _has(name: str, value: str) -> Column:
    return F.coalesce(c(name) == value, F.lit(False))


def _in(name: str, values: Sequence[str]) -> Column:
    return F.coalesce(c(name).isin(list(values)), F.lit(False))


def with_texts(jobs: DataFrame) -> DataFrame:
    """The texts that the rules share, each built once: what the gates see, what the score sees, title."""
    wide = [c(n) for n in ("title", "company", "location", "locationKey", "description", "via", "source", "roleFamily", "roleType") if n in jobs.columns]
    short = [c(n) for n in ("title", "company", "location", "description", "via") if n in jobs.columns]
    return held(jobs, gate_text_=text_of(*wide, arrays=[c("roleSignals")]), text_=text_of(*short), title_=F.coalesce(c("title"), F.lit("")))


def decision_dimensions(jobs: DataFrame) -> DataFrame:
    """jobs (with_texts) with roleDomain, roleConfidence and the struct decisionGates."""
    t, title = c("gate_text_"), c("title_")
    jobs = held(jobs, place_=join_truthy(" ", c("location"), c("locationKey")), wide_place_=join_truthy(" ", c("location"), c("locationKey"), c("title"), c("description")))
    place, wide_place = c("place_"), c("wide_place_")
    family_qa = _in("roleFamily", ["qa", "automation"])
    found = {
        "isQaRole": family_qa | seen(t, *V.QA_TEXT) | seen(title, *V.QA_TITLE),
        "hasSoftwareQaEvidence": seen(t, *V.SOFTWARE_QA_TEXT, V.SOFTWARE_TESTER_HE) | seen(title, *V.SOFTWARE_QA_TITLE),
        "hasAutomationEvidence": seen(t, *V.AUTOMATION_EVIDENCE),
        "hasDeveloperAutomationSignal": seen(t, *V.AUTOMATION_DEVELOPER),
        "hasBusinessQualityEvidence": seen(t, *V.BUSINESS_QUALITY),
        "hasInformationSystemsEvidence": seen(t, *V.INFORMATION_SYSTEMS),
        "hasDataOrOfficeEvidence": seen(t, *V.DATA_OR_OFFICE),
        "hasHardExclude": seen(t, *V.GATE_HARD_EXCLUDE),
        "hasBadLocation": _in("locationKey", V.GATE_BAD_PLACES) | seen(place, *V.CENTER_TEXT) | seen(wide_place, *V.GATE_BAD_PLACE_TEXT),
        "hasGoodLocation": _in("locationKey", V.GATE_GOOD_PLACES) | seen(place, *V.GATE_GOOD_PLACE_TEXT),
        "hasUnknownLocation": ~truthy(F.trim(c("locationKey"))) | _has("locationKey", "unknown") | ~truthy(F.trim(c("location"))) | _has("location", "Israel"),
        "hasSeniorSignal": seen(title, *V.GATE_SENIOR_TITLE) | seen(t, *V.GATE_FOUR_YEARS),
        "hasThreePlusExperience": seen(t, *V.GATE_THREE_YEARS),
    }
    rows = held(jobs, **{f"d_{k}": v for k, v in found.items()})
    d = lambda k: c(f"d_{k}")
    qa, software = d("isQaRole"), d("hasSoftwareQaEvidence")
    domain = (
        F.when(d("hasBusinessQualityEvidence") & qa & ~software, "business_quality")
        .when(d("hasDeveloperAutomationSignal") & ~software, "automation_dev")
        .when(qa & d("hasAutomationEvidence") & software, "automation_qa")
        .when(qa & software, "software_qa")
        .when(qa, "qa_uncertain")
        .when(d("hasInformationSystemsEvidence") | _has("roleFamily", "information_systems"), "information_systems")
        .when(d("hasDataOrOfficeEvidence") | _in("roleFamily", ["data", "information", "analysis", "operations"]), "quiet_admin_data")
        .when(_has("roleFamily", "irrelevant") | c("isRelevantRole").eqNullSafe(False), "irrelevant")
        .otherwise("unknown")
    )
    rows = rows.withColumn("roleDomain", domain)
    can = c("roleDomain").isin("automation_qa", "software_qa", "information_systems", "quiet_admin_data")
    confidence = F.when(c("roleDomain").isin("software_qa", "automation_qa"), "high").when(c("roleDomain") == "unknown", "low").otherwise("medium")
    gates = F.struct(
        c("roleDomain"), confidence.alias("roleConfidence"), (can | c("roleDomain").isin("qa_uncertain", "automation_dev")).alias("isTargetRole"), can.alias("canApplyByRole"),
        (c("roleDomain") == "business_quality").alias("isBusinessQualityQa"), *(d(k).alias(k) for k in found))
    return rows.withColumn("decisionGates", gates).withColumn("roleConfidence", confidence).drop("place_", "wide_place_", *(f"d_{k}" for k in found))


#: In the order in which they are tried, score cap and warning of each closed gate.
GATE_NOTES = {
    "hard": (20, "נפסל: שירות/טלפוני/מכירות/משמרות או מודל עבודה לא מתאים."),
    "place": (40, "נפסל: מיקום לא מתאים."),
    "business": (35, "נפסל: QA איכות/ייצור/רגולציה ולא בדיקות תוכנה."),
    "irrelevant": (35, "נפסל: לא זוהה תפקיד יעד מתאים."),
    "uncertain": (None, "נשאר לבדיקה: התפקיד קרוב, אבל חסר סימן ברור שזה QA תוכנה / תפקיד יעד מדויק."),
    "role": (None, "נשאר לבדיקה: התפקיד קרוב, אבל חסר סיווג יעד מספיק חזק."),
    "unknown_place": (None, "נשאר לבדיקה: המיקום לא זוהה בוודאות."),
    "senior": (None, "נשאר לבדיקה: יש סימן לניסיון/בכירות גבוהים מדי."),
}


def decision_gates(jobs: DataFrame) -> DataFrame:
    """recommendation, capped fitScore, status and warnings by the first gate that closes."""
    g = lambda k: c(f"decisionGates.{k}")
    score = F.coalesce(c("fitScore"), F.lit(0))
    tried = {
        "hard": g("hasHardExclude"), "place": g("hasBadLocation"), "business": c("roleDomain") == "business_quality", "irrelevant": c("roleDomain") == "irrelevant",
        "uncertain": c("roleDomain").isin("qa_uncertain", "automation_dev"), "role": ~g("canApplyByRole"), "unknown_place": g("hasUnknownLocation"), "senior": g("hasSeniorSignal") | g("hasThreePlusExperience"),
    }
    gate = F.coalesce(*(F.when(hit, F.lit(k)) for k, hit in tried.items()), F.lit("open"))
    rows = jobs.withColumn("gate_", gate)
    closed = [k for k, (cap, _) in GATE_NOTES.items() if cap is not None]
    by = lambda i: F.create_map(*(x for k, v in GATE_NOTES.items() if v[i] is not None for x in (F.lit(k), F.lit(v[i]))))[c("gate_")]
    skip = c("gate_").isin(closed)
    recommendation = (
        F.when(skip, "skip")
        .when(c("gate_").isin("uncertain", "role"), F.when(score >= 45, "review").otherwise("skip"))
        .when(c("gate_").isin("unknown_place", "senior"), "review")
        .when(g("hasGoodLocation") & (score >= 75), "apply")
        .when(score < 45, "skip")
        .otherwise("review")
    )
    return rows.withColumns({
        "recommendation": recommendation,
        "fitScore": F.when(skip, clamped(score, 0, by(0))).otherwise(c("fitScore")),
        "status": F.when(skip & ~_has("status", "applied"), "skipped").otherwise(c("status")),
        "warnings": F.array_distinct(F.array_compact(F.concat(F.coalesce(c("warnings"), F.expr(_NONE)), F.array(by(1))))),
        "reasons": F.array_distinct(F.array_compact(F.coalesce(c("reasons"), F.expr(_NONE)))),
    }).drop("gate_")


def early_exit(jobs: DataFrame) -> Column:
    """Why a posting gets no score at all, as a struct (reason, hard); null if it gets one."""
    title, text = c("title_"), c("text_")
    extra = [c(n) for n in ("locationKey", "source", "url", "jobType") if n in jobs.columns]
    arrays = [c(n) for n in ("reasons", "warnings") if n in jobs.columns]
    hard_text = F.concat_ws(" ", text, text_of(*extra, arrays=arrays))
    paid = seen(hard_text, "alljobs") & seen(hard_text, *V.PAID_ONLY)
    developer = seen(title, *V.DEVELOPER_TITLE) & ~seen(title, *V.QA_AUTOMATION_TITLE)
    factory = (_has("roleFamily", "qa") | seen(text, V.LETTER_BOUND_QA, V.FACTORY_QUALITY[0])) & seen(text, *V.FACTORY_QUALITY) & ~seen(text, *V.SOFTWARE_SIGNAL)
    wrong = _has("roleFamily", "irrelevant") | (c("isRelevantRole").eqNullSafe(False) & _has("roleConfidence", "high"))
    note = lambda reason, hard: F.struct(F.lit(reason).alias("reason"), F.lit(hard).alias("hard"))
    return (
        F.when(paid, note("נפסל אוטומטית: משרת AllJobs Premium / מנויים בלבד.", True))
        .when(developer, note("נפסל אוטומטית: תפקיד פיתוח תוכנה ולא QA/בדיקות.", True))
        .when(factory, note("נפסל: נראה QA איכות/ייצור/רגולציה ולא בדיקות תוכנה.", False))
        .when(seen(text, *V.SCORE_HARD_EXCLUDE), note("נפסל אוטומטית: שירות לקוחות / טלפוני / מכירות / משמרות.", False))
        .when(wrong, note("נפסל: התפקיד לא שייך למסלול החיפוש שלך.", False))
    )


def quiet_role(text: Column) -> Column:
    profile = truthy(c("roleProfileId")) & _in("roleFamily", V.QUIET_FAMILIES)
    return profile | seen(join_truthy(" ", text, c("roleType"), c("roleProfileId"), c("roleProfileName")), *V.QUIET_ROLE)


def score(jobs: DataFrame, target_roles: Sequence[str] = (), skills: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """Enriched jobs with fitScore, reasons, warnings, recommendation, status and decisionGates.

    learning_adjustment, learning_reasons and learning_warnings (operators.learning) count where the input
    has them. Points are added up in one expression over columns that are computed once.
    """
    rows = with_texts(jobs)
    for name, kind in (("roleProfileId", "string"), ("roleProfileName", "string"), ("roleProfileScoreBonus", "double"), ("url", "string"), ("status", "string"), ("warnings", "array<string>"), ("reasons", "array<string>"), ("learning_adjustment", "double"), ("learning_reasons", "array<string>"), ("learning_warnings", "array<string>")):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    text, title = c("text_"), c("title_")
    rows = held(rows, clerk_=seen(text, V.CLERK), developer_=seen(title, *V.CLEAR_DEVELOPER_TITLE))  # read within an array below
    rows = held(rows, **{
        "exit_": early_exit(rows), "targets_": keyword_hits(text, target_roles), "skills_": keyword_hits(text, skills),
        "excluded_": F.slice(F.array_distinct(F.filter(keyword_hits(text, exclude), lambda w: F.when(F.contains(w, F.lit("פקיד")), c("clerk_")).when(_has("roleFamily", "qa") & (w == "פיתוח"), c("developer_")).otherwise(True))), 1, 5),
        "senior_": seen(title, *V.SCORE_SENIOR_TITLE) | seen(text, *V.SCORE_FOUR_YEARS), "four_": years_at_least(text, 4), "three_": years_at_least(text, 3),
        "office_": ~_has("roleFamily", "qa") & seen(text, *V.SCORE_OFFICE_NOISE) & ~quiet_role(text),
    })
    said = lambda a: F.coalesce(a, F.expr(_NONE))
    useful = lambda a: F.filter(said(a), lambda m: matches(m, *V.SPECIFIC_LEARNING))
    qa = _has("roleFamily", "qa")
    only_generic = (F.size(said(c("learning_reasons"))) + F.size(said(c("learning_warnings"))) > 0) & (F.size(useful(c("learning_reasons"))) + F.size(useful(c("learning_warnings"))) == 0)
    learned = F.coalesce(c("learning_adjustment"), F.lit(0.0))
    rows = rows.withColumns({"learned_": F.when(qa & only_generic, F.greatest(learned, F.lit(-6.0))).otherwise(learned), "lr_": F.when(qa, useful(c("learning_reasons"))).otherwise(said(c("learning_reasons"))), "lw_": F.when(qa, useful(c("learning_warnings"))).otherwise(said(c("learning_warnings")))})

    family = reduce(lambda e, kv: e.when(_has("roleFamily", kv[0]), kv[1]), list(V.FAMILY_POINTS.items())[1:], F.when(_has("roleFamily", "qa"), V.FAMILY_POINTS["qa"]))
    named = _in("roleFamily", list(V.FAMILY_POINTS))
    relevant = c("isRelevantRole").eqNullSafe(True)
    good, bad = _in("locationKey", V.SCORE_GOOD_PLACES), _in("locationKey", V.SCORE_BAD_PLACES)
    profile = truthy(c("roleProfileId"))
    fresh = _has("seniority", "junior") | F.coalesce(c("hasNoExperienceSignal"), F.lit(False))
    sap = _in("roleType", ["qa_sap", "sap_implementer"])
    no_place = ~good & ~bad & ~truthy(c("locationKey"))
    points = (
        F.lit(20)
        + F.when(profile, F.coalesce(F.nullif(c("roleProfileScoreBonus"), F.lit(0.0)), F.lit(26.0))).otherwise(0)
        + family.when(relevant, 18).otherwise(-25)
        + F.when(_has("roleType", "qa_manual"), 10).when(_has("roleType", "qa_automation"), 6).when(sap, 4).otherwise(0)
        + F.when(fresh, 18).otherwise(0)
        - F.when(c("senior_"), 35).otherwise(0)
        - F.when(c("four_"), 35).when(c("three_"), 18).otherwise(0)
        + F.when(good, 16).when(bad, -22).when(no_place, -10).otherwise(0)
        - F.when(c("office_"), 28).otherwise(0)
        + F.least(F.lit(12), F.size("targets_") * 4)
        + F.least(F.lit(12), F.size("skills_") * 3)
        - F.least(F.lit(35), F.size("excluded_") * 8)
        - F.when(~truthy(c("url")), 10).otherwise(0)
        + c("learned_")
    )
    four = lambda a: F.array_join(F.slice(a, 1, 4), ", ")
    reasons = F.array_compact(F.concat(F.array(
        F.when(profile, F.concat(F.lit("זוהה תפקיד יעד: "), F.coalesce(c("roleProfileName"), F.lit("תפקיד שהוגדר במערכת")), F.lit("."))),
        *(F.when(_has("roleFamily", k), F.lit(v)) for k, v in V.FAMILY_REASONS.items()),
        F.when(~named & relevant, F.lit("זוהה תפקיד רלוונטי לפי פרופיל מותאם.")),
        F.when(_has("roleType", "qa_manual"), F.lit("בדיקות ידניות — מתאים לכניסה לתחום.")),
        F.when(_has("roleType", "qa_automation"), F.lit("אוטומציה מוזכרת — יתרון, אבל לבדוק דרישות ניסיון.")),
        F.when(sap, F.lit("SAP / ERP — עשוי להיות רלוונטי אם לא בכיר מדי.")),
        F.when(fresh, F.lit("מתאים לג׳וניור / ללא ניסיון.")),
        F.when(good, F.concat(F.lit("מיקום מתאים: "), c("location"), F.lit("."))),
        F.when(F.size("targets_") > 0, F.concat(F.lit("מילות יעד שנמצאו: "), four(c("targets_")), F.lit("."))),
        F.when(F.size("skills_") > 0, F.concat(F.lit("כישורים שלך שמופיעים במשרה: "), four(c("skills_")), F.lit(".")))), c("lr_")))
    warnings = F.array_compact(F.concat(F.array(
        F.when(~named & ~relevant, F.lit("לא זוהה תפקיד יעד ברור.")),
        F.when(c("senior_"), F.lit("נראה בכיר/ניהולי מדי.")),
        F.when(c("four_"), F.lit("נראה שדורש 4 שנות ניסיון ומעלה.")).when(c("three_"), F.lit("ייתכן שדורש 3 שנות ניסיון ומעלה.")),
        F.when(bad, F.concat(F.lit("מיקום פחות מתאים: "), c("location"), F.lit("."))).when(no_place, F.lit("המיקום לא זוהה בוודאות.")),
        F.when(c("office_"), F.lit("נראה כמו אדמיניסטרציה / לוגיסטיקה / מעבדה ולא תפקיד תוכנה ברור.")),
        F.when(F.size("excluded_") > 0, F.concat(F.lit("מילות אזהרה: "), F.array_join("excluded_", ", "), F.lit("."))),
        F.when(~truthy(c("url")), F.lit("לא נמצא קישור ישיר להגשה."))), c("lw_")))
    out = c("exit_").isNotNull()
    hard = F.coalesce(c("exit_.hard"), F.lit(False))
    reasons = F.when(F.size(reasons) > 0, F.slice(F.array_distinct(reasons), 1, 8)).otherwise(F.array(F.lit("התאמה כללית, אבל חסרים סימנים חזקים.")))
    rows = rows.withColumns({
        "fitScore": F.when(out, 0).otherwise(rounded(clamped(points.cast("double"), 0, 100))),
        "reasons": F.when(out, F.expr(_NONE)).otherwise(reasons),
        "warnings": F.when(hard, F.array_distinct(F.concat(said(c("warnings")), F.array(c("exit_.reason"))))).when(out, F.array(c("exit_.reason"))).otherwise(F.slice(F.array_distinct(warnings), 1, 8)),
        "status": F.when(out, "skipped").otherwise(c("status")),
        "roleFamily": F.when(hard, "irrelevant").otherwise(c("roleFamily")), "roleType": F.when(hard, "irrelevant").otherwise(c("roleType")), "isRelevantRole": F.when(hard, False).otherwise(c("isRelevantRole")),
    }).drop("exit_", "clerk_", "developer_", "targets_", "skills_", "excluded_", "senior_", "four_", "three_", "office_", "learned_", "lr_", "lw_", "learning_adjustment", "learning_reasons", "learning_warnings")
    gated = decision_gates(decision_dimensions(with_texts(rows.drop("gate_text_", "text_", "title_"))))
    return gated.drop("gate_text_", "text_", "title_")


# The flow around the score


def qa_title(title: Column) -> Column:
    return seen(F.lower(F.coalesce(title, F.lit(""))), *V.FINAL_QA_TITLE)


def before_scoring(jobs: DataFrame) -> DataFrame:
    """A title that says QA forces the family; profiles of other roles are taken off."""
    text = F.lower(join_truthy(" ", c("title"), c("description")))
    kind = F.when(seen(text, *V.AUTOMATION_EVIDENCE), "qa_automation").when(seen(text, *V.MANUAL_ROLE), "qa_manual").otherwise("qa_general")
    rows = jobs.withColumn("qa_", qa_title(c("title")))
    off = c("qa_") & truthy(c("roleProfileId")) & ~F.contains(F.lower(c("roleProfileId")), F.lit("qa"))
    gone = [n for n in ("roleProfileName", "roleProfileMatched", "roleProfileScoreBonus", "roleProfileId") if n in jobs.columns]
    rows = rows.withColumn("off_", off if "roleProfileId" in jobs.columns else F.lit(False))
    return rows.withColumns({
        "roleFamily": F.when(c("qa_"), "qa").otherwise(c("roleFamily")), "roleType": F.when(c("qa_"), kind).otherwise(c("roleType")),
        "isRelevantRole": F.when(c("qa_"), True).otherwise(c("isRelevantRole")), "roleConfidence": F.when(c("qa_"), "high").otherwise(c("roleConfidence")),
        **{n: F.when(~c("off_"), c(n)) for n in gone},
    }).drop("qa_", "off_")


def main_senior() -> Column:
    text = F.lower(join_truthy(" ", c("title"), c("description")))
    return seen(F.lower(F.coalesce(c("title"), F.lit(""))), *V.SCORE_SENIOR_TITLE) | seen(text, *V.MAIN_FOUR_YEARS)


def after_scoring(jobs: DataFrame) -> DataFrame:
    """Blocked places are skipped; clean QA postings go up to apply, others without a good place or too senior down to review."""
    place_words = F.replace(F.coalesce(c("locationKey"), F.lit("")), F.lit("_"), F.lit(" "))
    place = join_truthy(" ", c("location"), place_words)
    blocked = seen(join_truthy(" ", c("title"), c("company"), place, c("description")), *V.FINAL_BAD_PLACE_TEXT) | seen(place, *V.CENTER_TEXT)
    qa = _in("roleFamily", ["qa", "automation"]) | qa_title(c("title"))
    good = _in("locationKey", V.MAIN_GOOD_PLACES)
    senior = seen(text_of(c("title"), c("description"), arrays=[c("warnings")]), *V.FINAL_THREE_YEARS) | main_senior()
    up = _has("recommendation", "review") & qa & good & (F.coalesce(c("fitScore"), F.lit(0)) >= 75) & (F.size(F.coalesce(c("warnings"), F.expr(_NONE))) == 0) & ~senior
    down = _has("recommendation", "apply") & (~good | senior)
    rows = jobs.withColumn("blocked_", blocked)
    return rows.withColumns({
        "recommendation": F.when(c("blocked_"), "skip").when(up, "apply").when(down, "review").otherwise(c("recommendation")),
        "status": F.when(c("blocked_"), "skipped").otherwise(c("status")),
    }).drop("blocked_")


def usable_for_main_list() -> Column:
    """The main-list gate as one boolean column."""
    n = F.coalesce(c("fitScore"), F.lit(0))
    key, place = F.coalesce(c("locationKey"), F.lit("")), F.coalesce(c("location"), F.lit(""))
    words = F.replace(key, F.lit("_"), F.lit(" "))
    qa = _in("roleFamily", ["qa", "automation"])
    unknown = (key == "") | (key == "unknown") | (place == "Israel")
    alljobs = _has("source", "AllJobs")
    place_ok = key.isin(V.MAIN_GOOD_PLACES) | (alljobs & unknown & qa & ~_has("recommendation", "skip") & (n >= 75))
    blocked = key.isin(V.MAIN_BAD_PLACES) | seen(F.concat_ws(" ", place, words), *V.CENTER_TEXT)
    for text in (place, words, join_truthy(" ", c("title"), c("description"))):
        blocked = blocked | seen(text, *V.MAIN_BAD_PLACE_TEXT)
    text = F.lower(join_truthy(" ", c("title"), c("company"), c("description")))
    own = join_truthy(" ", c("title"), c("description"), c("roleFamily"), c("roleType"), c("roleProfileId"), c("roleProfileName"))
    noise = ~qa & seen(text, *V.MAIN_OFFICE_NOISE) & ~quiet_role(own)
    rejected = _has("status", "skipped") | _has("recommendation", "skip") | (n <= 0) | _has("roleFamily", "irrelevant") | c("isRelevantRole").eqNullSafe(False) | seen(F.lower(join_truthy(" ", c("title"), c("description"))), *V.JUNK_BUSINESS) | noise
    least = F.coalesce(F.nullif(c("mainListMinScore"), F.lit(0.0)), F.lit(55.0))
    profile, senior = truthy(c("roleProfileId")), main_senior()
    family = lambda *f: _in("roleFamily", f)
    listed = seen(c("url"), r"JobID=\d+") & ~seen(key, *V.MAIN_BAD_LOCATION_LABELS) & ~seen(place, *V.MAIN_BAD_LOCATION_LABELS) & ~senior
    of_alljobs = F.when(profile, n >= F.greatest(F.lit(55.0), least)).when(qa, n >= 50).when(family("information_systems"), n >= 65).when(family("information"), n >= 70).when(family("analysis", "operations"), n >= 60).otherwise(False)
    of_others = F.when(profile, ~senior & (n >= least)).when(qa, ~senior & (n >= 25)).when(family("information_systems"), ~senior & (n >= 45)).when(family("information"), ~senior & (n >= 60)).when(family("analysis", "operations"), ~senior & (n >= 55)).otherwise(n >= 70)
    return F.coalesce(place_ok & ~blocked & ~rejected & F.when(alljobs, listed & of_alljobs).otherwise(of_others), F.lit(False))


def main_list(jobs: DataFrame) -> DataFrame:
    """Postings for the main list. jobs should come from a written table: the optimizer moves this filter
    below the projections it reads from and would copy their rules into it again and again."""
    for name, kind in (("roleProfileId", "string"), ("roleProfileName", "string"), ("mainListMinScore", "double")):
        if name not in jobs.columns:
            jobs = jobs.withColumn(name, F.lit(None).cast(kind))
    return jobs.where(usable_for_main_list())


def audit_decision(kept: Column) -> Column:
    """Why a scored posting isn't in the main list."""
    return (
        F.when(kept, "kept_duplicate_or_saved").when(_has("status", "skipped"), "filtered_status_skipped").when(_has("recommendation", "skip"), "filtered_recommendation_skip")
        .when(_has("roleFamily", "irrelevant"), "filtered_irrelevant_role").when(F.coalesce(c("fitScore"), F.lit(0)) < 40, "filtered_low_score").otherwise("filtered_other")
    )
