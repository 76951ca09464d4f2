"""The catalog of checks. Ids, stages and known bands follow the audit's contract; bands that no source states are our own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Skill, then its checks as id, admissible severities from the worst, and how a verdict comes about: D decided here,
# P prepared here and completed by a reviewer, V a reviewer's alone.
CATALOG = """
access-discovery-audit: ACC-ROBOTS-ROLE critical-high D, ACC-ROBOTS-UNAVAILABLE high-high D, ACC-INDEX-CONTROL critical-high D, ACC-NOARCHIVE-COPILOT high-medium D, ACC-CANONICAL-CONFLICT high-medium D, ACC-REDIRECT-LOOP high-medium D, ACC-BOT-CHALLENGE high-high D, ACC-SITEMAP-ORPHAN medium-low D, ACC-SITEMAP-INVALID medium-medium D, ACC-HREFLANG-INCONSISTENT medium-medium D, ACC-LLMS-TXT-ABSENT low-low D, ACC-LINK-ROT medium-low D, ACC-FETCH-LATENCY high-medium D
representation-parity-audit: REP-KEY-FACT-LOSS high-medium D, REP-STATE-ONLY-FACT medium-medium D, REP-METADATA-CONTRAST medium-medium D, REP-EXTRACTION-LOSS medium-medium D, REP-NON-TEXT-LOCKIN high-medium D, REP-TABLE-SEMANTICS medium-medium D, REP-LINKS-SCRIPT-ONLY medium-medium D, REP-HIDDEN-TEXT-SUSPECT medium-medium D
entity-consistency-audit: ENT-JSONLD-INVALID high-medium D, ENT-STRUCTURED-VISIBLE-CONFLICT high-high D, ENT-NAME-INCONSISTENT high-medium P, ENT-AMBIGUOUS-NAME medium-low P, ENT-CORROBORATION-ABSENT medium-medium D
answer-coverage-audit: ANS-QUESTION-UNANSWERED high-medium V, ANS-PASSAGE-INCOMPLETE medium-low V, ANS-QUALIFIER-DETACHED medium-low V, ANS-COMPARISON-UNREADABLE medium-low V, ANS-BOILERPLATE-DROWNING medium-medium D
freshness-consistency-audit: FRS-CLAIM-CONFLICT high-medium V, FRS-DATE-CONFLICT medium-low V, FRS-IMPOSSIBLE-DATE medium-low D, FRS-LASTMOD-UNIFORM low-low D, FRS-STALE-VERSION medium-low V
offsite-visibility-audit: OFF-BRAND-ABSENT high-medium V, OFF-THIRD-PARTY-PREFERRED medium-low V, OFF-FACT-STATED-WRONG high-medium V, OFF-WRONG-ENTITY high-medium V
referral-experience-audit: REF-SOFT-404 high-medium P, REF-404-DEAD-END medium-low P, REF-PATH-DROP-REDIRECT high-medium P, REF-FRAGMENT-UNSURVIVABLE medium-low P, REF-ANSWER-NOT-CONFIRMED medium-low P, REF-COLLAPSED-ANSWER medium-low P, REF-OVERLAY-BLOCK medium-low P, REF-PERF-RISK medium-low P, REF-VIEWPORT-ABSENT high-medium P
"""
SCHEMA = "check_id string, skill_id string, category string, severity_band array<string>, decided string"
_ORDER = ("critical", "high", "medium", "low")


def catalog_rows() -> list[tuple[str, str, str, list[str], str]]:
    rows = []
    for line in CATALOG.strip().splitlines():
        skill, _, checks = line.partition(": ")
        for entry in checks.split(", "):
            check_id, band, decided = entry.split(" ")
            worst, _, least = band.partition("-")
            rows.append((check_id, skill, check_id[:3].lower(), list(_ORDER[_ORDER.index(worst) : _ORDER.index(least) + 1]), decided))
    return rows


def catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(catalog_rows(), SCHEMA)
