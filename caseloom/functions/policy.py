"""The rule cascade, expected-value decisions and their safeguards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Points for a prediction (row) where the truth is approved, denied, review. Fixed values.
PAYOFF = {"APPROVED": (8.0, -4.0, 1.0), "DENIED": (0.0, 8.0, 1.0), "NEEDS_REVIEW": (2.0, 2.0, 8.0)}
DISQUALIFYING = ("memory_tampering", "planetary_embargo", "active_warrant", "biohazard_red")
REVIEW = ("identity_conflict", "sponsor_mismatch", "illegible_biometrics", "rescinded_denial")
#: Paths on which unread evidence must not end in an approval.
GUARDED = ("risk_page_unreadable", "risk_page_unreadable_med")
STALE_DAYS, IMPLAUSIBLE_DAYS = 180, 400


def stale(reference: Column, arrival: Column, days: int = STALE_DAYS) -> Column:
    """True, false, or null where a date is missing."""
    return F.datediff(reference, arrival) > days


def implausible(reference: Column, arrival: Column, days: int = IMPLAUSIBLE_DAYS) -> Column:
    return F.abs(F.datediff(reference, arrival)) > days


def cascade(rules: list[tuple[Column, str | Column]], otherwise: str) -> Column:
    """The label of the first rule that is true; a null condition is not true."""
    out = None
    for condition, label in rules:
        label = label if isinstance(label, Column) else F.lit(label)
        out = F.when(condition, label) if out is None else out.when(condition, label)
    return out.otherwise(F.lit(otherwise))


def decision_path(r: dict[str, Column]) -> Column:
    """The policy state of a record.

    ``r`` maps visa, sponsor, fee, flags, stale, arrival, arrival_untrusted, hardship,
    diplomatic, revoked, flags_known, scanned, injection to columns. Null is "no
    evidence"; a fee printed as unknown is the value ``unknown``.
    """
    no = lambda c: ~F.coalesce(c, F.lit(False))
    overlap = lambda values: F.size(F.array_intersect(r["flags"], F.array(*map(F.lit, values))))
    dip = r["visa"] == "DIP-1"
    return cascade(
        [
            (r["visa"] == "TRANSIT-7", "transit_7"),
            (overlap(DISQUALIFYING) > 0, "disqualifying_flag"),
            ((r["fee"] == "unpaid") & no(r["hardship"]), "fee_unpaid"),
            (~dip & r["sponsor"].isNotNull() & r["revoked"], "sponsor_revoked"),
            (overlap(REVIEW) > 1, "review_flags_multi"),
            (overlap(REVIEW) == 1, "review_flags"),
            ((r["fee"] == "waived") & ~dip & no(r["hardship"]), "fee_waived_unjustified"),
            (r["fee"] == "unknown", "fee_stated_unknown"),
            (r["stale"] & dip & r["diplomatic"], "stale_dip_exempt"),
            (r["stale"], "stale_arrival"),
            (F.coalesce(r["arrival_untrusted"], F.lit(False)) | r["arrival"].isNull(), "arrival_date_untrusted"),
            (r["visa"].isNull(), "visa_unknown"),
            (~dip & r["sponsor"].isNull(), "sponsor_unknown"),
            (no(r["flags_known"]) & r["scanned"] & (r["visa"] == "MED-3"), "risk_page_unreadable_med"),
            (no(r["flags_known"]) & r["scanned"], "risk_page_unreadable"),
            (no(r["flags_known"]), "risk_page_absent"),
            (r["fee"].isNull(), "fee_unknown"),
            (r["stale"].isNull(), "staleness_indeterminate"),
            (r["injection"], "clean_injection_seen"),
        ],
        "clean",
    )


def expected_values(p: tuple[Column, Column, Column]) -> dict[str, Column]:
    return {name: p[0] * w[0] + p[1] * w[1] + p[2] * w[2] for name, w in PAYOFF.items()}


def decide(p: tuple[Column, Column, Column], banned: Column | None = None) -> Column:
    """``struct(decision, ev, confidence)`` with the greatest expected value, first listed on ties.

    Where ``banned`` is true an approval is no candidate. Confidence is the
    probability of the decision itself.
    """
    ranked = []
    for k, (name, ev) in enumerate(expected_values(p).items()):
        value = F.when(banned, F.lit(float("-inf"))).otherwise(ev) if banned is not None and name == "APPROVED" else ev
        ranked.append(F.struct(value.alias("ev"), F.lit(-k).alias("k"), F.lit(name).alias("decision"), p[k].alias("confidence")))
    best = F.array_max(F.array(*ranked))
    return F.struct(best["decision"].alias("decision"), best["ev"].alias("ev"), best["confidence"].alias("confidence"))


def decide_safely(p: tuple[Column, Column, Column], path: Column) -> Column:
    return decide(p, path.isin(*GUARDED))


def blend(model: Column, prior: Column, w: float) -> Column:
    return model * w + prior * (1.0 - w)


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
