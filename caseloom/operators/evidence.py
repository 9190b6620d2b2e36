"""Composite resolvers: printed values, risk flags, direct-evidence repairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions.distance import SCAN, distance
from caseloom.functions.text import POLICY_TRUST, canon, norm
from caseloom.functions.validate import valid_sponsor
from caseloom.operators.resolve import conflicts, consensus, tier_majority, trust_resolve, unanimous
from caseloom.operators.snap import snap, snap_flags, snap_names

#: Home worlds under embargo; used for what is printed only. Fixed values.
EMBARGOED = ("TRAPPIST-1e", "Eris Relay")
#: Distance of a compound candidate over its length, and of its last part over the longer one.
LOOSE_FLAG, TERMINAL = 0.55, 0.40
SCANS = ("scanned_page", "scanned_page_fallback")
NO_IDENTITY = (*SCANS, "sponsor_letter", "manual_correction")
VISAS = ("XW-1", "XW-2", "DIP-1", "MED-3", "TRANSIT-7")
CLOSED = ("species_code", "home_world", "visa_class", "declared_purpose", "fee_status")


def snapped(obs: DataFrame, vocabulary: DataFrame, first_tokens: DataFrame, last_tokens: DataFrame) -> DataFrame:
    """Observations with the canonical ``value``, its ``score`` and what was read, ``raw``; closed fields that match
    nothing get null and 0, names keep what they read with 0, other fields are as they are."""
    closed = obs.where(F.col("field").isin(*CLOSED))
    near = snap(closed, vocabulary, "value", ["field"], costs=SCAN).select("field", F.col("value").alias("raw"), "snapped", "confidence")
    a = closed.withColumnRenamed("value", "raw").join(near, ["field", "raw"]).withColumn("value", F.col("snapped")).withColumn("score", F.col("confidence")).drop("snapped", "confidence")
    names = obs.where("field = 'applicant_name'")
    known = snap_names(names, first_tokens, last_tokens, "value").select(F.col("value").alias("raw"), "snapped", "confidence")
    b = names.withColumnRenamed("value", "raw").join(known, "raw").withColumn("value", F.when(F.col("confidence") > 0, F.col("snapped")).otherwise(F.col("raw"))).withColumn("score", F.col("confidence")).drop("snapped", "confidence")
    c = obs.where(~F.col("field").isin(*CLOSED, "applicant_name")).withColumn("score", F.lit(1.0)).withColumn("raw", F.col("value"))
    return a.unionByName(b).unionByName(c)


def records(obs: DataFrame, fields: tuple[str, ...], promote: frozenset[str] = frozenset({"printed", "fee"})) -> DataFrame:
    """Trusted values of each case (policy ceiling) and printed ones, one wide row a case.

    Each kind of use has a ceiling of its own; permissions are per kind of signal: ``printed``
    lets the fallback reader fill what is printed, ``fields`` what policy knows, ``fee``
    the fee status. Policy takes the best reading of the most trusted source, be it a valid
    one or not; so do printed names, sponsors and dates. Printed values of closed vocabularies
    pass over sources without any valid reading, and then the most votes count.
    """
    keys = ["case_id", "field"]
    ceiling = lambda kind: 8 if kind in promote else POLICY_TRUST
    closed = F.col("field").isin(*CLOSED) & (F.col("field") != "fee_status")
    best = lambda o, top: trust_resolve(o, keys, top, F.col("score")).where("value is not null")
    stated = obs.where("field = 'fee_status'")
    parts = [
        best(obs.where("field <> 'fee_status'"), ceiling("fields")).select("case_id", "field", F.lit("policy").alias("use"), "value"),
        tier_majority(obs.where(closed & (F.col("score") > 0) & F.col("value").isNotNull() & (F.col("trust") <= ceiling("printed"))), keys).select("case_id", "field", F.lit("printed").alias("use"), "value"),
        best(obs.where(~closed & (F.col("field") != "fee_status")), ceiling("printed")).select("case_id", "field", F.lit("printed").alias("use"), "value"),
        best(stated, ceiling("fee")).select("case_id", "field", F.lit("policy").alias("use"), F.lower("value").alias("value")),
        best(stated, ceiling("printed")).select("case_id", "field", F.lit("printed").alias("use"), F.lower("value").alias("value")),
    ]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    pick = lambda f, u: F.max(F.when((F.col("field") == f) & (F.col("use") == u), F.col("value")))
    return both.groupBy("case_id").agg(*[pick(f, "policy").alias(f) for f in fields], *[pick(f, "printed").alias(f"printed_{f}") for f in fields])


def compounds(candidates: DataFrame, flags: DataFrame) -> DataFrame:
    """``raw, flag`` for damaged flags of two parts: a looser distance, but the last part survives."""
    seen = candidates.select("raw").distinct().where(F.length("raw") - F.length(F.replace("raw", F.lit("_"), F.lit(""))) == 1)
    loose = snap_flags(seen, flags, "raw", ratio=LOOSE_FLAG).where("snapped is not null and confidence > 0")
    end = lambda c: canon(F.substring_index(c, "_", -1))
    ends = loose.select("raw", F.col("snapped").alias("flag"), end("raw").alias("x"), end("snapped").alias("y")).where("x <> '' and y <> ''")
    ends = ends.withColumn("d", distance(F.col("x"), F.col("y"), SCAN))
    return ends.where(F.col("d") / F.greatest(F.length("x"), F.length("y")) <= TERMINAL).select("raw", "flag")


def flag_evidence(readings: DataFrame, registry: DataFrame, obs: DataFrame, flags: DataFrame, corrected: DataFrame | None = None) -> DataFrame:
    """``case_id, flag, fallback, inferred`` from seven derivations.

    ``readings (case_id, raw, observed, fallback)``: what a label calls a flag (``observed``) may
    be clipped; free text is taken strictly, or, from the primary reader, as a damaged
    compound whose last part survives. ``registry (case_id, status, fallback)``: an embargo
    there is ``inferred``. ``obs`` gives conflicting sponsors between letter and form and
    several confident identities, unless a correction ``(case_id, field)`` settled them;
    by default those that observations hold.
    """
    row = lambda df, flag, fallback=F.lit(False), inferred=F.lit(False): df.select("case_id", flag.alias("flag"), fallback.alias("fallback"), inferred.alias("inferred"))
    hit = F.col("snapped")
    seen, free_text = readings.where("observed"), readings.where("not observed")
    a = row(seen.join(snap_flags(seen, flags, "raw", clipped=True), "raw").where("confidence > 0"), hit, F.col("fallback"))
    b = row(free_text.join(snap_flags(free_text, flags, "raw"), "raw").where("confidence > 0"), hit, F.col("fallback"))
    primary = free_text.where("not fallback")
    b = b.union(row(primary.join(compounds(primary, flags).withColumnRenamed("flag", "snapped"), "raw"), hit))
    c = row(registry.where("contains(upper(status), 'EMBARGO')"), F.lit("planetary_embargo"), F.col("fallback"), F.lit(True))
    signed = obs.where("source = 'manual_correction'").select("case_id", "field").distinct() if corrected is None else corrected
    free = obs.join(signed, ["case_id", "field"], "left_anti").where("value is not null")
    letter = free.where("source = 'sponsor_letter'")
    # the first form's sponsor against the letter's
    form = trust_resolve(free.where("field = 'sponsor_id' and source <> 'adjudicator'"), ["case_id"]).select("case_id", F.upper(F.trim("value")).alias("x"))
    other = letter.where("field = 'sponsor_id'").select("case_id", F.upper(F.trim("value")).alias("y"))
    d = row(form.join(other, "case_id").where("x <> y"), F.lit("sponsor_mismatch"))
    # identities are known names of typed documents; a letter may name none of them
    named = free.where("field = 'applicant_name' and score > 0").withColumn("value", norm(F.col("value")))
    people = named.where(~F.col("source").isin(*NO_IDENTITY))
    known = people.groupBy("case_id").agg(F.collect_set("value").alias("known"))
    writers = row(named.where("source = 'sponsor_letter'").join(known, "case_id").where(~F.array_contains("known", F.col("value"))), F.lit("sponsor_mismatch"))
    several = row(conflicts(people, ["case_id"]), F.lit("identity_conflict"))
    return a.union(b).union(c).union(d).union(writers).union(several).distinct()


def risk_flags(observed: DataFrame, candidates: DataFrame, registry: DataFrame, obs: DataFrame, flags: DataFrame) -> DataFrame:
    """``case_id, flag``: the ``flag_evidence`` of one reader's ``observed`` and ``candidates (case_id, raw)``, and ``registry (case_id, status)``."""
    read = lambda df, seen: df.select("case_id", "raw", F.lit(seen).alias("observed"), F.lit(False).alias("fallback"))
    return flag_evidence(read(observed, True).unionByName(read(candidates, False)), registry.withColumn("fallback", F.lit(False)), obs, flags).select("case_id", "flag").distinct()


def without_embargo(obs: DataFrame) -> DataFrame:
    """``case_id`` of cases whose worlds were read, and none of them is under embargo: there a status in the
    registry prints no embargo. A flag that a panel states outright is never held back."""
    worlds = obs.where("field = 'home_world' and value is not null and score > 0")
    return worlds.groupBy("case_id").agg(F.bool_or(F.col("value").isin(*EMBARGOED)).alias("ok")).where("not ok").select("case_id")


def flag_sets(evidence: DataFrame, barred: DataFrame, promote: frozenset[str]) -> DataFrame:
    """``case_id, risk_flags, printed_flags`` of ``flag_evidence``: what policy sees, and what is printed.

    ``barred (case_id)``: where an inferred embargo is not printed.
    """
    e = evidence.join(barred.withColumn("barred", F.lit(True)), "case_id", "left")
    kept = lambda on: F.array_sort(F.collect_set(F.when(on, F.col("flag"))))
    policy = F.lit(True) if "flags" in promote else ~F.col("fallback")
    shown = (F.lit(True) if "printed" in promote else ~F.col("fallback")) & ~(F.col("inferred") & F.coalesce("barred", F.lit(False)))
    return e.groupBy("case_id").agg(kept(policy).alias("risk_flags"), kept(shown).alias("printed_flags"))


def printed_names(ordinary: DataFrame, obs: DataFrame, corrections: DataFrame, ceiling: int = 7) -> DataFrame:
    """``case_id, value``: the name to print. The only name that the registry states goes before the
    ``ordinary (case_id, value)`` one, unless a correction ``(case_id, field)`` was signed."""
    listed = obs.where(f"field = 'applicant_name' and source = 'registry' and score > 0 and trust <= {ceiling}")
    one = unanimous(listed, ["case_id"]).select("case_id", F.col("value").alias("listed"))
    signed = corrections.where("field = 'applicant_name'").select("case_id", F.lit(True).alias("signed")).distinct()
    out = ordinary.join(one, "case_id", "full_outer").join(signed, "case_id", "left")
    return out.select("case_id", F.when(F.col("signed"), F.col("value")).otherwise(F.coalesce("listed", "value")).alias("value"))


def fee_values(readings: DataFrame, vocabulary: DataFrame, reading: str) -> DataFrame:
    """``reading, fee``: the fee status that a reading states, as it stands or snapped; null if none."""
    stated = F.lower(F.trim(F.col(reading)))
    seen = readings.select(reading).distinct().withColumn("_f", stated)
    near = snap(seen.select("_f"), vocabulary, "_f").select("_f", "snapped")
    exact = seen.join(vocabulary.select(F.lower("value").alias("_f"), F.lit(True).alias("known")).distinct(), "_f", "left")
    return exact.join(near, "_f", "left").select(reading, F.when(F.col("known"), F.col("_f")).otherwise(F.lower("snapped")).alias("fee"))


def typed_fields(obs: DataFrame) -> DataFrame:
    """``case_id, field, typed``: whether any source but a scan states the field."""
    return obs.groupBy("case_id", "field").agg(F.bool_or(~F.col("source").isin(*SCANS)).alias("typed"))


def flags_known(flags: Column, page_types: Column, panel_read: Column, note: Column, panel_missing: Column) -> Column:
    """Whether "no flags" is evidence: some flag, a biometric page, a read panel or a finding, and no panel reported missing."""
    no = lambda c: F.coalesce(c, F.lit(False))
    return ((F.size(flags) > 0) | no(F.array_contains(page_types, "biometric")) | no(panel_read) | note.isNotNull()) & ~no(panel_missing)


def still_unresolved(unresolved: Column, settled: Column) -> Column:
    """Fields that nothing settled, in order."""
    return F.array_sort(F.array_except(unresolved, settled))


def direct_repairs(printed: DataFrame, obs: DataFrame, rationale: DataFrame) -> DataFrame:
    """Printed values that direct evidence corrects, six rules in order; later ones win.

    ``printed`` has ``printed_applicant_name, printed_sponsor_id, printed_visa_class`` and may
    have ``printed_flags``; only such columns change. ``obs`` holds snapped observations,
    ``raw`` as read, ``rationale (case_id, transit)`` what a note's reason says.

    1. The applicant of a letter whom a primary scan names too, if there is one such; if this
       changes the name, a lone sponsor mismatch was an identity conflict.
    2. The sponsor that both readers see on different pages.
    3. The fallback reader's only visa, where primary readings exist, none of them is a visa,
       and no typed page states one.
    4. The transit class that a reason names.
    5. The name that leads all others by two readings or more on scans.
    6. The fallback reader's only exact name, where the printed one is no known name.
    """
    if "raw" not in obs.columns:
        obs = obs.withColumn("raw", F.col("value"))
    key = norm(F.col("value")).alias("v")
    name = obs.where("field = 'applicant_name' and value is not null")
    scan = name.where(F.col("source").isin(*SCANS))
    latest = F.max(F.struct("trust", "page", "seq", "value"))["value"].alias("value")
    letter = name.where("source = 'sponsor_letter'").groupBy("case_id", key).agg(latest)
    seen = name.where("source = 'scanned_page'").select("case_id", key).distinct()
    one = unanimous(letter.join(seen, ["case_id", "v"], "left_semi"), ["case_id"], "v").select("case_id", "v").join(letter, ["case_id", "v"]).select("case_id", F.col("value").alias("r1"))
    ids = obs.where("field = 'sponsor_id'").where(F.col("source").isin(*SCANS)).withColumn("value", F.upper(F.trim("raw"))).where(valid_sponsor(F.col("value")))
    pages = ids.groupBy("case_id", "value").agg(F.count_distinct("source").alias("s"), F.count_distinct("page").alias("p"))
    two = unanimous(pages.where("s = 2 and p > 1"), ["case_id"]).select("case_id", F.col("value").alias("r2"))
    visa = obs.where("field = 'visa_class'").withColumn("read", F.upper(F.trim("raw")))
    visa = visa.withColumn("ok", F.col("read").isin(*VISAS))
    by = lambda cond: F.count_if(cond)
    per = visa.groupBy("case_id").agg(by(F.col("source") == "scanned_page").alias("primary"), by((F.col("source") == "scanned_page") & F.col("ok")).alias("good"), by(~F.col("source").isin(*SCANS)).alias("typed"))
    other = unanimous(visa.where("source = 'scanned_page_fallback' and ok"), ["case_id"], "read").select("case_id", F.col("read").alias("r3"))
    three = other.join(per.where("primary > 0 and good = 0 and typed = 0").select("case_id"), "case_id", "left_semi")
    four = rationale.where("transit").select("case_id", F.lit("TRANSIT-7").alias("r4")).distinct()
    shown = scan.groupBy("case_id", key).agg(latest)
    five = consensus(scan.select("case_id", norm(F.col("value")).alias("value")), ["case_id"]).select("case_id", F.col("value").alias("v")).join(shown, ["case_id", "v"]).select("case_id", F.col("value").alias("r5"))
    six = unanimous(scan.where("source = 'scanned_page_fallback' and score >= 0.99"), ["case_id"]).select("case_id", F.col("value").alias("r6"))
    known = name.where("score > 0").groupBy("case_id").agg(F.collect_set(norm(F.col("value"))).alias("known"))
    out = printed
    for d in (one, two, three, four, five, six, known):
        out = out.join(d, "case_id", "left")
    was = F.col("printed_applicant_name")
    turned = F.col("r1").isNotNull() & ~norm(was).eqNullSafe(norm(F.col("r1")))
    before = F.coalesce("r5", F.when(turned, F.col("r1")), was)
    strange = ~F.coalesce(F.array_contains("known", norm(before)), F.lit(False))
    columns = {
        "printed_applicant_name": F.when(strange, F.coalesce("r6", before)).otherwise(before),
        "printed_sponsor_id": F.coalesce("r2", "printed_sponsor_id"),
        "printed_visa_class": F.coalesce("r4", "r3", "printed_visa_class"),
        "printed_flags": F.when(turned & (F.col("printed_flags") == F.array(F.lit("sponsor_mismatch"))), F.array(F.lit("identity_conflict"))).otherwise(F.col("printed_flags")) if "printed_flags" in printed.columns else None,
    }
    return out.select(*[columns[c].alias(c) if columns.get(c) is not None else F.col(c) for c in printed.columns])


def fill_unresolved(printed: DataFrame, extra: DataFrame, damaged: DataFrame, injected: DataFrame) -> DataFrame:
    """Fields still unprinted take the third reader's only candidate, unless damaged or injected.

    ``extra (case_id, field, value, score)``: names need 0.99, closed values 0.20, sponsors their shape.
    """
    bar = F.when(F.col("field") == "applicant_name", 0.99).otherwise(0.20)
    shaped = (F.col("field") != "sponsor_id") | valid_sponsor(F.upper("value"))
    good = extra.where((F.col("score") >= bar) & shaped).join(damaged, ["case_id", "field"], "left_anti").join(injected.select("case_id"), "case_id", "left_anti")
    one = unanimous(good, ["case_id", "field"])
    fields = [c.removeprefix("printed_") for c in printed.columns if c.startswith("printed_") and c != "printed_flags"]
    wide = one.groupBy("case_id").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f"x_{f}") for f in fields])
    out = printed.join(wide, "case_id", "left")
    return out.select(*[c for c in printed.columns if c.removeprefix("printed_") not in fields or not c.startswith("printed_")], *[F.coalesce(f"printed_{f}", f"x_{f}").alias(f"printed_{f}") for f in fields])
