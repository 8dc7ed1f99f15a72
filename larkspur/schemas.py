"""Schemas of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

_TEXT = ["id", "job_key", "title", "company", "companyConfidence", "location", "rawLocation", "locationKey", "locationConfidence", "description", "snippet", "via", "source", "sourceQuery", "url", "jobIdFromSource", "jobType"]
_TIMES = ["foundAt", "firstSeenAt", "lastSeenAt", "publishedAt", "importedFromGmailAt", "updatedAt", "appliedAt", "savedAt", "archivedAt"]
_ROLE = ["roleFamily", "roleType", "roleConfidence", "roleDomain", "seniority", "roleProfileId", "roleProfileName", "recommendation", "status", "notes", "archiveReason", "reviewKey", "gmailMessageId", "gmailThreadId", "gmailDigestProvider"]
_FLAGS = ["isRelevantRole", "roleProfileMatched", "hasShiftSignal", "hasPhoneSignal", "hasSeniorSignal", "hasSalesSignal", "hasNoExperienceSignal", "gmailDigest", "gmailDigestSplit", "promotedFromReview", "fromManualReview"]
_LISTS = ["roleSignals", "badSignals", "reasons", "warnings"]


def _fields(names: list[str], kind: T.DataType) -> list[T.StructField]:
    return [T.StructField(n, kind) for n in names]


JOBS = T.StructType([
    *_fields(_TEXT, T.StringType()), *_fields(_TIMES, T.TimestampType()), *_fields(_ROLE, T.StringType()), *_fields(_FLAGS, T.BooleanType()), *_fields(_LISTS, T.ArrayType(T.StringType())),
    *_fields(["seenCount", "fitScore", "gmailDigestIndex"], T.IntegerType()), *_fields(["mainListMinScore", "roleProfileScoreBonus"], T.DoubleType()), T.StructField("ingest_seq", T.LongType()),
])
FEEDBACK = T.StructType([
    *_fields(["id", "jobId", "action", "rejectionReason", "rejectionReasonLabel", "title", "company", "location", "locationKey", "source", "sourceQuery", "roleFamily", "roleType", "roleProfileId", "roleProfileName"], T.StringType()),
    T.StructField("fitScore", T.IntegerType()), *_fields(["description", "reviewKey"], T.StringType()), T.StructField("fromManualReview", T.BooleanType()), T.StructField("createdAt", T.TimestampType()),
])
MAILS = T.StructType([
    *_fields(["id", "gmailMessageId", "threadId", "title", "sender"], T.StringType()), T.StructField("date", T.TimestampType()), *_fields(["snippet", "bodyText", "bodyHtml"], T.StringType()),
    T.StructField("links", T.ArrayType(T.StringType())), *_fields(["source", "status"], T.StringType()), T.StructField("importedAt", T.TimestampType()),
])
PROFILES = T.StructType([
    *_fields(["id", "name"], T.StringType()), T.StructField("enabled", T.BooleanType()), *_fields(["roleFamily", "roleType", "roleConfidence"], T.StringType()), *_fields(["mainListMinScore", "scoreBonus"], T.DoubleType()),
    T.StructField("overrideExisting", T.BooleanType()), *_fields(["queries", "positivePatterns", "negativePatterns"], T.ArrayType(T.StringType())),
])
SITE_SOURCES = T.StructType([*_fields(["id", "name", "domain", "description"], T.StringType()), T.StructField("enabled", T.BooleanType()), T.StructField("extraQuery", T.StringType()), T.StructField("blockedPathPatterns", T.ArrayType(T.StringType()))])
SENDERS = T.StructType([*_fields(["id", "name"], T.StringType()), T.StructField("domains", T.ArrayType(T.StringType())), T.StructField("enabled", T.BooleanType()), T.StructField("notes", T.StringType())])
