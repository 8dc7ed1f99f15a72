"""Normalizing provider rows and enriching postings: company, location, role, profile, signals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.rules import FirstMatch, RoleProfile, count_hits
from ..functions.text import held, matches, or_else, seen, slug_id, squeezed, text_of, truthy

c = F.col


def company_columns(jobs: DataFrame) -> DataFrame:
    """company and companyConfidence: for Drushim the second part of the description, else the own, else the source."""

    def clean(x: Column) -> Column:
        return squeezed(F.regexp_replace(F.coalesce(x, F.lit("")), r"\|.*", ""))

    def bad(x: Column) -> Column:
        t = clean(x)
        return (F.length(t) < 2) | (F.length(t) > 80) | t.isin(V.BAD_COMPANIES) | matches(t, *V.BAD_COMPANY_TEXT)

    parts = F.filter(F.transform(F.split(F.coalesce(c("description"), F.lit("")), "·"), clean), lambda x: x != "")
    of_drushim = F.coalesce(c("source"), F.lit("")) == "Drushim"
    jobs = held(jobs, second_=F.when(of_drushim, F.get(parts, F.lit(1))))  # read in several places
    second = c("second_")
    from_parts = of_drushim & ~bad(second)
    own = truthy(c("company")) & ~bad(c("company"))
    return jobs.withColumns({
        "company": F.when(from_parts, second).when(own, c("company")).otherwise(or_else(c("source"), F.lit("Unknown"))),
        "companyConfidence": F.when(from_parts, "drushim_description_parts").when(own, "job_company").otherwise("fallback"),
    }).drop("second_")


def location_columns(jobs: DataFrame, places: Sequence = V.LOCATIONS) -> DataFrame:
    """location, locationKey, locationConfidence: the first place of the table whose pattern the posting holds."""
    text = squeezed(text_of(*(c(n) for n in ("location", "title", "company", "description", "rawText") if n in jobs.columns)))
    jobs = held(jobs, place_text_=text)  # each place's patterns read it
    key = FirstMatch([(k, p) for k, _, p in places]).value(c("place_text_"), seen)
    shown = F.create_map(*(x for k, name, _ in places for x in (F.lit(k), F.lit(name))))
    own = truthy(c("location")) & (c("location") != "Israel")
    return jobs.withColumn("place_", key).withColumns({
        "location": F.when(c("place_").isNotNull(), shown[c("place_")]).otherwise(or_else(c("location"), F.lit("Israel"))),
        "locationKey": F.when(c("place_").isNotNull(), c("place_")).when(own, F.replace(F.lower(squeezed(c("location"))), F.lit(" "), F.lit("_"))),
        "locationConfidence": F.when(c("place_").isNotNull(), "matched_text").when(own, "job_location").otherwise("unknown"),
    }).drop("place_", "place_text_")


def role_columns(jobs: DataFrame) -> DataFrame:
    """roleFamily, roleType, seniority, isRelevantRole, roleConfidence, roleSignals.

    Irrelevant trades end it at once; of the other rules the later ones override the earlier, so they are
    read from the last to the first.
    """
    jobs = held(jobs, role_text_=F.lower(text_of(c("title"), c("company"), c("description"))), role_title_=F.lower(F.coalesce(c("title"), F.lit(""))))
    text, title = c("role_text_"), c("role_title_")
    rules = {
        "bad": seen(text, *V.IRRELEVANT_ROLE), "junior": seen(text, *V.JUNIOR), "senior": seen(title, *V.SENIOR_TITLE) | seen(text, *V.SENIOR_YEARS), "qa": seen(text, *V.QA_ROLE),
        "manual": seen(text, *V.MANUAL_ROLE), "automation": seen(text, *V.AUTOMATION_ROLE), "sap": seen(text, "sap"), "erp": seen(text, "erp"), "implementer": seen(text, *V.IMPLEMENTER_ROLE),
        "support": seen(text, *V.APPLICATION_SUPPORT_ROLE), "entry": seen(text, *V.DATA_ENTRY_ROLE), "documents": seen(text, *V.DOCUMENT_ROLE), "phone": seen(text, *V.PHONE_ROLE),
        "sales": seen(text, *V.SALES_ROLE), "transport": seen(text, *V.TRANSPORT_ROLE),
    }
    # plain columns: the optimizer would put the fields of a struct back into every place of use
    rows = jobs.withColumns({f"r_{k}": v for k, v in rules.items()})
    r = {k: c(f"r_{k}") for k in rules}
    qa = r["qa"] | r["manual"] | r["automation"]
    known = qa | r["implementer"] | r["support"] | r["entry"] | r["documents"]

    def ordered(bad, transport, documents, entry, support, implementer, qa_value, phone, sales, other) -> Column:
        return (
            F.when(r["bad"], bad).when(r["transport"], transport).when(r["documents"], documents).when(r["entry"], entry).when(r["support"], support)
            .when(r["implementer"], implementer).when(qa, qa_value).when(r["phone"], phone).when(r["sales"], sales).otherwise(other)
        )

    qa_type = F.when(r["automation"], "qa_automation").when(r["manual"], "qa_manual").when(r["sap"], "qa_sap").otherwise("qa_general")
    signals = [
        ("junior", r["junior"]), ("senior_or_management", r["senior"]), ("qa", r["qa"]), ("manual", r["manual"]), ("automation", r["automation"]), ("sap", r["sap"]), ("erp", r["erp"]), ("implementer", r["implementer"]),
        ("application_support", r["support"]), ("data_entry", r["entry"]), ("documents_or_backoffice", r["documents"]), ("phone_or_service", r["phone"]), ("sales", r["sales"]), ("wrong_role_transport_safety", r["transport"]),
    ]
    return rows.withColumns({
        "roleFamily": ordered(F.lit("irrelevant"), F.lit("irrelevant"), F.lit("information"), F.lit("operations"), F.lit("information_systems"), F.lit("information_systems"), F.lit("qa"), F.lit("customer_service"), F.lit("sales"), F.lit("unknown")),
        "roleType": ordered(F.lit("irrelevant_non_software"), F.lit("safety_transport"), F.lit("document_control"), F.lit("data_entry"), F.lit("application_support"), F.lit("implementer"), qa_type, F.lit("phone_support"), F.lit("sales"), F.lit("unknown")),
        "seniority": F.when(r["bad"], "unknown").when(r["senior"], "senior_or_lead").when(r["junior"], "junior").otherwise("unknown"),
        "isRelevantRole": ~r["bad"] & ~r["transport"] & known,
        "roleConfidence": ordered(F.lit("high"), F.lit("high"), F.lit("medium"), F.lit("medium"), F.lit("medium"), F.lit("medium"), F.lit("high"), F.lit("medium"), F.lit("medium"), F.lit("low")),
        "roleSignals": F.when(r["bad"], F.array(F.lit("irrelevant_non_software"))).otherwise(F.array_compact(F.array(*(F.when(hit, F.lit(name)) for name, hit in signals)))),
    }).drop("role_text_", "role_title_", *(f"r_{k}" for k in rules))


def profile_columns(jobs: DataFrame, profiles: Sequence[RoleProfile]) -> DataFrame:
    """The first enabled profile that fits sets the role, unless a sure role of another family stands.

    The table is folded into one expression at plan time; a profile of the same family only leaves its name.
    """
    text = text_of(*(c(n) for n in ("title", "company", "location", "description", "sourceQuery", "rawText") if n in jobs.columns))
    sure = F.coalesce(c("isRelevantRole") & truthy(c("roleFamily")) & (c("roleFamily") != "unknown") & (c("roleConfidence") == "high"), F.lit(False))
    usable = [p for p in profiles if p.enabled]
    kind = "struct<id:string,name:string,family:string,type:string,confidence:string,minimum:double,bonus:double,only_name:boolean>"
    if not usable:
        picked = F.lit(None).cast(kind)
    else:
        hits = []
        for p in usable:
            blocked = F.lit(False) if p.override_existing else sure & (c("roleFamily") != p.role_family)
            values = F.struct(
                F.lit(p.id).alias("id"), F.lit(p.name).alias("name"), F.lit(p.role_family).alias("family"), F.lit(p.role_type or p.id).alias("type"), F.lit(p.role_confidence).alias("confidence"),
                F.lit(float(p.main_list_min_score or 55)).alias("minimum"), F.lit(float(p.score_bonus or 24)).alias("bonus"), (F.lit(False) if p.override_existing else sure).alias("only_name"))
            hits.append(F.when(p.fits(text) & ~blocked, values))
        picked = F.coalesce(*hits)
    p = c("profile_")
    sets = p.isNotNull() & ~p["only_name"]
    return jobs.withColumn("profile_", picked).withColumns({
        "roleFamily": F.when(sets, p["family"]).otherwise(c("roleFamily")), "roleType": F.when(sets, p["type"]).otherwise(c("roleType")),
        "isRelevantRole": F.when(sets, True).otherwise(c("isRelevantRole")), "roleConfidence": F.when(sets, p["confidence"]).otherwise(c("roleConfidence")),
        "roleSignals": F.when(sets, F.concat(c("roleSignals"), F.array(F.concat(F.lit("profile:"), p["id"])))).otherwise(c("roleSignals")),
        "roleProfileId": p["id"], "roleProfileName": p["name"], "roleProfileMatched": p.isNotNull(),
        "mainListMinScore": F.when(sets, p["minimum"]), "roleProfileScoreBonus": F.when(sets, p["bonus"]),
    }).drop("profile_")


def signal_columns(jobs: DataFrame) -> DataFrame:
    jobs = held(jobs, signal_text_=text_of(*(c(n) for n in ("title", "company", "location", "description", "sourceQuery") if n in jobs.columns)))
    text = c("signal_text_")
    flags = {"Shift": ("shifts", V.SHIFT_SIGNAL), "Phone": ("phone", V.PHONE_SIGNAL), "Senior": ("senior", V.SENIOR_SIGNAL), "Sales": ("sales", V.SALES_SIGNAL)}
    rows = jobs.withColumns({f"has{k}Signal": seen(text, *p) for k, (_, p) in flags.items()} | {"hasNoExperienceSignal": seen(text, *V.NO_EXPERIENCE_SIGNAL)})
    return rows.drop("signal_text_").withColumn("badSignals", F.array_compact(F.array(*(F.when(c(f"has{k}Signal"), F.lit(name)) for k, (name, _) in flags.items()))))


def enrich(jobs: DataFrame, profiles: Sequence[RoleProfile] = ()) -> DataFrame:
    return signal_columns(profile_columns(role_columns(location_columns(company_columns(jobs))), profiles))


# Guards against rows that are no postings


def page_dump(title: Column, description: Column) -> Column:
    d, t = F.coalesce(description, F.lit("")), F.trim(F.coalesce(title, F.lit("")))
    return (F.length(d) > 12_000) | (count_hits(d, V.PAGE_DUMP_SIGNALS) >= 2) | (t.isin(V.GENERIC_TITLES) & (F.length(d) > 3000))


def category_page(source: Column, title: Column, company: Column, description: Column) -> Column:
    t, d = F.trim(F.coalesce(title, F.lit(""))), F.trim(F.coalesce(description, F.lit("")))
    city = F.rlike(t, F.lit(r"^דרושים\s+[֐-׿\s'\"-]+$"))
    return F.coalesce(source == "JobMaster", F.lit(False)) & (city | (F.coalesce(F.trim(company) == "JobMaster", F.lit(False)) & (d == t)))


def listing_noise(source: Column, title: Column, company: Column, description: Column) -> Column:
    t, d = F.trim(F.coalesce(title, F.lit(""))), F.trim(F.coalesce(description, F.lit("")))
    weak = (F.length(d) < 80) & matches(d, '^(?:פורסם לפני|ע"י|הגש מועמדות|שמור למועדפים|משרות נוספות)')
    empty = F.coalesce(F.trim(company) == "JobMaster", F.lit(False)) & matches(d, r"^(?:הגש מועמדות|שמור למועדפים|משרות נוספות|\s*)$")
    return F.coalesce(source == "JobMaster", F.lit(False)) & (t.isin(V.NOISE_TITLES) | (d == "משרות נוספות") | F.contains(d, F.lit("הגש מועמדות שמור למועדפים משרות נוספות")) | empty | weak)


def is_bad_row(source: Column, title: Column, company: Column, description: Column) -> Column:
    return page_dump(title, description) | category_page(source, title, company, description) | listing_noise(source, title, company, description)


def finalize(jobs: DataFrame, profiles: Sequence[RoleProfile] = ()) -> DataFrame:
    """Enriched postings with an id; rows that are pages or noise are marked skipped with a warning."""
    rows = enrich(jobs, profiles)
    bad = is_bad_row(c("source"), c("title"), c("company"), c("description"))
    note = F.lit("Skipped: likely search/category/page dump, not a real job card.")
    warnings = F.coalesce(c("warnings"), F.array().cast("array<string>")) if "warnings" in rows.columns else F.array().cast("array<string>")
    status = c("status") if "status" in rows.columns else F.lit("found")
    return rows.withColumn("bad_", bad).withColumns({
        "id": or_else(c("id"), slug_id(c("title"), c("company"), c("location"), c("url"))) if "id" in rows.columns else slug_id(c("title"), c("company"), c("location"), c("url")),
        "status": F.when(c("bad_"), "skipped").otherwise(status),
        "warnings": F.when(c("bad_"), F.concat(warnings, F.array(note))).otherwise(warnings),
    }).drop("bad_")
