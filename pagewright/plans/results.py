"""The results relation that every check yields and the report merges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESULT = "site_id string, check_id string, gate string, urls array<string>, severity string, confidence string, title string, evidence string, evidence_quality string, requires_completion boolean"
SEVERITIES = ("critical", "high", "medium", "low")
#: Frames of an audit by name, each with a site_id.
Frames = dict[str, DataFrame]
Check = Callable[[Frames], DataFrame]
REGISTRY: dict[str, tuple[tuple[str, ...], Check]] = {}


def check(check_id: str, *needs: str) -> Callable[[Check], Check]:
    """Register a check under its id with the frames that it reads besides sites."""

    def put(f: Check) -> Check:
        REGISTRY[check_id] = (needs, f)
        return f

    return put


def lit_or_column(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def gated(rows: DataFrame, check_id: str, finding: Column, *, severity="medium", confidence="high", title="", evidence="", urls: Column | None = None, skip: Column | None = None, quality="direct-measurement", open_: bool | Column = False, observed: Column | None = None) -> DataFrame:
    """One result for each row: not_evaluated where skip holds, else finding or pass. Critical without high confidence is high.

    observed: what a pass has looked at, where a reviewer completes it."""
    gate = F.when(F.coalesce(finding, F.lit(False)), "finding").otherwise("pass")
    gate = F.when(F.coalesce(skip, F.lit(False)), "not_evaluated").otherwise(gate) if skip is not None else gate
    found = gate == "finding"
    sev, conf = lit_or_column(severity), lit_or_column(confidence)
    sev = F.when((sev == "critical") & (conf != "high"), "high").otherwise(sev)
    none = F.lit(None).cast("string")
    return rows.select(
        "site_id", F.lit(check_id).alias("check_id"), gate.alias("gate"), F.when(found, urls if urls is not None else F.array().cast("array<string>")).alias("urls"),
        F.when(found, sev).otherwise(none).alias("severity"), F.when(found, conf).otherwise(none).alias("confidence"), F.when(found, lit_or_column(title)).otherwise(none).alias("title"),
        F.when(found, lit_or_column(evidence)).otherwise(F.when(gate == "pass", observed) if observed is not None else none).alias("evidence"), lit_or_column(quality).alias("evidence_quality"), lit_or_column(open_).alias("requires_completion"),
    )


def not_evaluated(sites: DataFrame, check_id: str) -> DataFrame:
    return gated(sites, check_id, F.lit(False), skip=F.lit(True))


def run_checks(frames: Frames, only: tuple[str, ...] | None = None) -> DataFrame:
    """All registered checks over the frames; a check that lacks a frame is not_evaluated for every site, never an error."""
    from . import checks_access, checks_content, checks_referral  # noqa: F401  they register themselves

    parts = [f(frames) if all(n in frames for n in needs) else not_evaluated(frames["sites"], check_id) for check_id, (needs, f) in sorted(REGISTRY.items()) if only is None or check_id in only]
    while len(parts) > 1:  # in pairs, as every union is analysed with all that is below it
        parts = [a.unionByName(b) for a, b in zip(parts[::2], parts[1::2], strict=False)] + parts[len(parts) // 2 * 2 :]
    return parts[0] if parts else None
