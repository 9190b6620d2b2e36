"""The queries on the driver's tables, with the SQL that checks them.

The tables hold no case packets, so each operator meets a stand-in of the same shape:
orders are packets, events are observations, documents are readings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.functions import policy as P
from caseloom.functions import text as T
from caseloom.functions.distance import PLAIN, SCAN
from caseloom.functions.validate import looks_damaged, valid_date, valid_for_field, valid_name, valid_sponsor
from caseloom.operators import boxes, corpus, evaluate, features, layout, resolve, snap
from caseloom.sources.io import row_fingerprint, tree_digest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def date(c: str):
    return F.col(c).cast("date")


#: Trust ranks that stand for sources, by event type.
EVENT_TRUST = {"purchase": 1, "signup": 2, "view": 4, "click": 6, "error": 9}
_EVENT_TRUST_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in EVENT_TRUST.items()) + " END"
SEGMENT_VISA = {"MACHINERY": "XW-1", "BUILDING": "XW-2", "AUTOMOBILE": "DIP-1", "FURNITURE": "MED-3", "HOUSEHOLD": "TRANSIT-7"}
_VISA_SQL = "CASE c_mktsegment " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SEGMENT_VISA.items()) + " END"


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as observations: the user is the case, the type the source, the half-unit value what is read."""
    e = read(spark, sf_dir, "events")
    return e.select("user_id", T.lookup(EVENT_TRUST, F.col("event_type")).alias("trust"), F.floor(F.col("value") / 10).cast("long").alias("value"), F.dayofmonth("ts").alias("page"), F.col("event_id").alias("seq"), "event_type")


_OBS = f"obs AS (SELECT user_id, {_EVENT_TRUST_SQL} AS trust, CAST(floor(value / 10) AS BIGINT) AS value, day(ts) AS page, event_id AS seq, event_type FROM events)"

_REF = """
days AS (SELECT datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS day FROM orders),
med AS (SELECT list_sort(list(day))[CAST(floor(count(*) / 2) AS INT) + 1] AS m FROM days),
mad AS (SELECT list_sort(list(abs(day - m)))[CAST(floor(count(*) / 2) AS INT) + 1] AS mad FROM days, med),
kept AS (SELECT day FROM days, med, mad WHERE abs(day - m) <= greatest(730, 6 * mad)),
ref AS (SELECT list_sort(list(day))[CAST(least(count(*) - 1, floor(count(*) * 0.98)) AS INT) + 1] AS ref_day FROM kept)
"""

_PATHS = f"""
{_REF},
li AS (SELECT l_orderkey, bool_or(l_returnflag = 'R' AND l_quantity >= 50) AS f1, count(DISTINCT l_suppkey) > 6 AS f2, bool_or(l_tax >= 0.08 AND l_quantity < 3) AS f3, count(*) AS n FROM lineitem GROUP BY l_orderkey),
rec AS (
  SELECT o_orderkey, {_VISA_SQL} AS visa, CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'O' THEN 'unpaid' WHEN 'P' THEN 'waived' END AS fee,
    coalesce(f1, false) AS f1, coalesce(f2, false) AS f2, coalesce(f3, false) AS f3, n IS NOT NULL AS known,
    o_totalprice > 400000 AS hardship, o_orderpriority = '1-URGENT' AS diplomatic, o_custkey % 97 = 0 AS revoked, o_custkey % 13 <> 0 AS has_sponsor,
    ref_day - datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS age, o_orderpriority
  FROM orders CROSS JOIN ref LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN li ON l_orderkey = o_orderkey
),
paths AS (
  SELECT *, CASE
    WHEN visa = 'TRANSIT-7' THEN 'transit_7'
    WHEN f1 THEN 'disqualifying_flag'
    WHEN fee = 'unpaid' AND NOT hardship THEN 'fee_unpaid'
    WHEN visa <> 'DIP-1' AND has_sponsor AND revoked THEN 'sponsor_revoked'
    WHEN f2 AND f3 THEN 'review_flags_multi'
    WHEN f2 OR f3 THEN 'review_flags'
    WHEN fee = 'waived' AND visa <> 'DIP-1' AND NOT hardship THEN 'fee_waived_unjustified'
    WHEN age > 180 AND visa = 'DIP-1' AND diplomatic THEN 'stale_dip_exempt'
    WHEN age > 180 THEN 'stale_arrival'
    WHEN abs(age) > 400 THEN 'arrival_date_untrusted'
    WHEN visa IS NULL THEN 'visa_unknown'
    WHEN visa <> 'DIP-1' AND NOT has_sponsor THEN 'sponsor_unknown'
    WHEN NOT known THEN 'risk_page_absent'
    WHEN fee IS NULL THEN 'fee_unknown'
    ELSE 'clean' END AS path,
    CASE WHEN o_orderpriority < '3' THEN 'APPROVED' WHEN o_orderpriority < '4' THEN 'NEEDS_REVIEW' ELSE 'DENIED' END AS outcome
  FROM rec
),
cnt AS (SELECT path, count(*) FILTER (WHERE outcome = 'APPROVED') AS a, count(*) FILTER (WHERE outcome = 'DENIED') AS d, count(*) FILTER (WHERE outcome = 'NEEDS_REVIEW') AS r, count(*) AS n FROM paths GROUP BY path),
pri AS (SELECT sum(a) / sum(n) AS ga, sum(d) / sum(n) AS gd, sum(r) / sum(n) AS gr FROM cnt),
cal AS (SELECT path, round((a + 4.0::DOUBLE * ga) / (n + 4.0::DOUBLE), 6) AS pa, round((d + 4.0::DOUBLE * gd) / (n + 4.0::DOUBLE), 6) AS pd, round((r + 4.0::DOUBLE * gr) / (n + 4.0::DOUBLE), 6) AS pr, n AS support FROM cnt, pri)
"""
_EV = "pa * 8.0 + pd * -4.0 + pr * 1.0 AS ea, pa * 0.0 + pd * 8.0 + pr * 1.0 AS ed, pa * 2.0 + pd * 2.0 + pr * 8.0 AS er"
_PICK = "CASE WHEN ea >= ed AND ea >= er THEN 'APPROVED' WHEN ed >= er THEN 'DENIED' ELSE 'NEEDS_REVIEW' END"
OUTCOMES = ["APPROVED", "DENIED", "NEEDS_REVIEW"]


def order_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order with its policy path and, from its priority, an outcome."""
    o, c, li = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer"), read(spark, sf_dir, "lineitem")
    items = li.groupBy("l_orderkey").agg(F.bool_or((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 50)).alias("f1"), (F.count_distinct("l_suppkey") > 6).alias("f2"), F.bool_or((F.col("l_tax") >= 0.08) & (F.col("l_quantity") < 3)).alias("f3"))
    ref = corpus.reference_date(o.select(date("o_orderdate").alias("d")), [], "d")
    r = o.join(c.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"), "left").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    r = corpus.with_context(r, ref)
    flag = lambda cond, name: F.when(F.col(cond), F.lit(name))
    flags = F.array_compact(F.array(flag("f1", "biohazard_red"), flag("f2", "sponsor_mismatch"), flag("f3", "identity_conflict")))
    arrival = date("o_orderdate")
    path = P.decision_path(
        {
            "visa": T.lookup(SEGMENT_VISA, F.col("c_mktsegment")), "sponsor": F.when(F.col("o_custkey") % 13 != 0, F.col("o_custkey")), "fee": T.lookup({"F": "paid", "O": "unpaid", "P": "waived"}, F.col("o_orderstatus")),
            "flags": flags, "stale": P.stale(F.col("reference_date"), arrival), "arrival": arrival, "arrival_untrusted": P.implausible(F.col("reference_date"), arrival),
            "hardship": F.col("o_totalprice") > 400000, "diplomatic": F.col("o_orderpriority") == "1-URGENT", "revoked": F.col("o_custkey") % 97 == 0, "flags_known": F.col("l_orderkey").isNotNull(), "scanned": F.lit(False), "injection": F.lit(False),
        }
    )
    outcome = F.when(F.col("o_orderpriority") < "3", "APPROVED").when(F.col("o_orderpriority") < "4", "NEEDS_REVIEW").otherwise("DENIED")
    return r.select("o_orderkey", path.alias("path"), outcome.alias("outcome"), flags.alias("flags"), "reference_date", arrival.alias("arrival"))


def order_calibration(paths: DataFrame) -> DataFrame:
    return evaluate.smoothed(paths, "path", "outcome", OUTCOMES)


def _p3():
    return tuple(F.col(f"p_{o}") for o in OUTCOMES)


@query(f"WITH {_PATHS}, ev AS (SELECT o_orderkey, path, pa, pd, pr, {_EV} FROM paths JOIN cal USING (path)) SELECT o_orderkey, path, {_PICK} AS decision, round(CASE {_PICK} WHEN 'APPROVED' THEN pa WHEN 'DENIED' THEN pd ELSE pr END, 4) AS confidence FROM ev")
def q01_adjudicate_orders(spark, sf_dir):
    paths = order_paths(spark, sf_dir)
    prior = 1 / 3
    scored = evaluate.with_probabilities(paths, order_calibration(paths).drop("support"), "path", {f"p_{o}": prior for o in OUTCOMES})
    d = P.decide(_p3())
    return scored.select("o_orderkey", "path", d["decision"].alias("decision"), F.round(d["confidence"], 4).alias("confidence"))


@query(f"WITH {_OBS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY trust, page, seq) AS rn FROM obs WHERE trust < 9) SELECT user_id, value, trust FROM r WHERE rn = 1")
def q02_trust_resolve(spark, sf_dir):
    return resolve.trust_resolve(observations(spark, sf_dir), ["user_id"])


@query(f"""WITH {_OBS}, v AS (SELECT user_id, trust, value, count(*) AS n, max(seq % 7) AS score, min(page) AS page FROM obs WHERE value >= 3 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY trust, n DESC, score DESC, page, value) AS rn FROM v) SELECT user_id, value, trust, n FROM r WHERE rn = 1""")
def q03_tier_majority(spark, sf_dir):
    return resolve.tier_majority(observations(spark, sf_dir).where("value >= 3").withColumn("score", F.col("seq") % 7), ["user_id"])


@query("""WITH v AS (SELECT user_id, event_type AS value, count(*) AS n FROM events GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, value) AS rn FROM v)
SELECT a.user_id, a.value, a.n AS votes, coalesce(b.n, 0) AS runner_up FROM r a LEFT JOIN r b ON a.user_id = b.user_id AND b.rn = 2 WHERE a.rn = 1 AND a.n - coalesce(b.n, 0) >= 2""")
def q04_consensus_lead2(spark, sf_dir):
    return resolve.consensus(read(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("value")), ["user_id"])


@query("SELECT o_custkey, any_value(o_orderstatus) AS value, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) = 1")
def q05_unanimity_gate(spark, sf_dir):
    return resolve.unanimous(read(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderstatus").alias("value")), ["o_custkey"])


@query("SELECT l_orderkey, count(DISTINCT l_suppkey) AS n_values, count(*) AS n_obs FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_suppkey) > 1")
def q06_conflict_detect(spark, sf_dir):
    return resolve.conflicts(read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("value")), ["l_orderkey"])


@query("""SELECT a.l_partkey, a.l_suppkey, min(a.l_orderkey) AS first_page, max(a.l_orderkey) AS last_page FROM lineitem a
WHERE EXISTS (SELECT 1 FROM lineitem b WHERE a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey AND a.l_orderkey <> b.l_orderkey) GROUP BY ALL""")
def q07_two_source_corroboration(spark, sf_dir):
    return resolve.corroborated(read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", F.col("l_orderkey").alias("page")), ["l_partkey", "l_suppkey"])


@query(r"SELECT md5(lower(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')))) AS key, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def q08_dedupe_first_seen(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.md5(F.lower(F.trim(F.regexp_replace("text", r"[ \t\n\x0B\f\r]+", " "))).cast("binary")).alias("key"))
    return resolve.first_ranked(d, ["key"], [F.col("doc_id")], ["doc_id"])


@query("""WITH n AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, text AS label, nt AS value FROM n WHERE role = 'user' AND nr = 'assistant'""")
def q09_label_value_lead(spark, sf_dir):
    return resolve.pair_with_next(read(spark, sf_dir, "conversations"), ["conv_id"], [F.col("turn")], F.col("role") == "user", F.col("role") == "assistant", "text", "text")


@query("SELECT conv_id, arg_min(text, turn) AS title FROM conversations WHERE role = 'user' GROUP BY conv_id")
def q10_first_title_per_page(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    spans = c.select(F.lit("c").alias("case_id"), F.col("conv_id").alias("page"), F.col("turn").alias("span_idx"), "text", F.when(F.col("role") == "user", 14.0).otherwise(10.0).alias("size"), F.lit(False).alias("hidden"))
    return layout.pages(spans).where("title is not null").select(F.col("page").alias("conv_id"), "title")


@query("SELECT user_id, arg_min(value, (ts, event_id)) AS first_value, arg_max(value, (ts, event_id)) AS last_value FROM events GROUP BY user_id")
def q11_last_wins_singleton(spark, sf_dir):
    return resolve.first_and_last(read(spark, sf_dir, "events"), ["user_id"], "value", ["ts", "event_id"])


_SEG = """
days AS (SELECT c_mktsegment AS k, datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS day FROM orders JOIN customer ON c_custkey = o_custkey),
med AS (SELECT k, list_sort(list(day))[CAST(floor(count(*) / 2) AS INT) + 1] AS m FROM days GROUP BY k),
mad AS (SELECT k, list_sort(list(abs(day - m)))[CAST(floor(count(*) / 2) AS INT) + 1] AS mad FROM days JOIN med USING (k) GROUP BY k),
kept AS (SELECT k, day FROM days JOIN med USING (k) JOIN mad USING (k) WHERE abs(day - m) <= greatest(730, 6 * mad))
"""


def _segment_dates(spark, sf_dir):
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("c_mktsegment", date("o_orderdate").alias("d"))


@query(f"WITH {_SEG} SELECT k AS c_mktsegment, DATE '1970-01-01' + CAST(list_sort(list(day))[CAST(least(count(*) - 1, floor(count(*) * 0.98)) AS INT) + 1] AS INT) AS reference_date FROM kept GROUP BY k")
def q12_reference_date(spark, sf_dir):
    return corpus.reference_date(_segment_dates(spark, sf_dir), ["c_mktsegment"], "d")


@query(f"WITH {_SEG} SELECT k AS c_mktsegment, DATE '1970-01-01' + CAST(m AS INT) AS median_date FROM med")
def q13_median_date(spark, sf_dir):
    return corpus.median_date(_segment_dates(spark, sf_dir), ["c_mktsegment"], "d")


@query("""WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), p AS (SELECT list_sort(list(n))[CAST(floor(count(*) * 0.99) AS INT) + 1] AS p99, count(*) AS k FROM c)
SELECT o_custkey, n, p99 FROM c, p WHERE k >= 400 AND n > 1.2 * p99""")
def q14_frequency_outliers(spark, sf_dir):
    return corpus.frequency_outliers(read(spark, sf_dir, "orders"), "o_custkey", 1.2)


@query("""WITH y AS (SELECT year(o_orderdate) AS year, count(*) AS n FROM orders GROUP BY 1),
s AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CASE WHEN o_orderkey % 11 = 0 THEN try_cast(CAST(year(o_orderdate) + 30 AS VARCHAR) || strftime(o_orderdate, '-%m-%d') AS DATE) ELSE CAST(o_orderdate AS DATE) END AS shifted FROM orders),
near AS (SELECT o_orderkey, y.year, y.n, row_number() OVER (PARTITION BY o_orderkey ORDER BY y.n DESC, y.year DESC) AS rn FROM s JOIN y ON hamming(lpad(CAST(year(shifted) AS VARCHAR), 4, '0'), CAST(y.year AS VARCHAR)) = 1),
top AS (SELECT a.o_orderkey, a.year, a.n, coalesce(b.n, 0) AS m FROM near a LEFT JOIN near b ON a.o_orderkey = b.o_orderkey AND b.rn = 2 WHERE a.rn = 1)
SELECT s.o_orderkey, CASE WHEN year(shifted) IN (SELECT year FROM y) THEN shifted WHEN top.n >= 1 * m THEN try_cast(CAST(top.year AS VARCHAR) || strftime(shifted, '-%m-%d') AS DATE) END AS repaired
FROM s LEFT JOIN top USING (o_orderkey) WHERE shifted IS NOT NULL""")
def q16_year_repair(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", date("o_orderdate").alias("d"))
    years = o.select(F.year("d").alias("year")).groupBy("year").agg(F.count(F.lit(1)).alias("n"))
    far = F.try_to_date(F.concat((F.year("d") + 30).cast("string"), F.date_format("d", "-MM-dd")), "yyyy-MM-dd")
    moved = o.withColumn("shifted", F.when(F.col("o_orderkey") % 11 == 0, far).otherwise(F.col("d"))).where("shifted is not null")
    return corpus.repair_years(moved, "shifted", years, dominance=1).select("o_orderkey", "repaired")


@query("""WITH m AS (SELECT o_orderstatus AS v FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN v ELSE o_orderstatus END AS status FROM orders, m""")
def q17_mode_fill(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    return corpus.mode_fill(o, "status", F.col("o_orderkey") % 7 == 0)


@query(f"WITH {_REF} SELECT o_orderkey, ref_day - datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS age, ref_day - datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) > 180 AS stale FROM orders, ref")
def q18_context_cross_join(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", date("o_orderdate").alias("d"))
    out = corpus.with_context(o, corpus.reference_date(o, [], "d"))
    return out.select("o_orderkey", F.datediff("reference_date", "d").cast("long").alias("age"), P.stale(F.col("reference_date"), F.col("d")).alias("stale"))


@query(f"WITH {_PATHS} SELECT o_orderkey, path FROM paths")
def q19_policy_path(spark, sf_dir):
    return order_paths(spark, sf_dir).select("o_orderkey", "path")


@query("""WITH c AS (SELECT source, count(*) FILTER (WHERE quality = 1) AS c1, count(*) FILTER (WHERE quality = 0) AS c0, count(*) AS support FROM documents JOIN labels USING (doc_id) GROUP BY source),
g AS (SELECT sum(c1) / sum(support) AS g1, sum(c0) / sum(support) AS g0 FROM c)
SELECT source, round((c1 + 4.0::DOUBLE * g1) / (support + 4.0::DOUBLE), 6) AS p_good, round((c0 + 4.0::DOUBLE * g0) / (support + 4.0::DOUBLE), 6) AS p_bad, support FROM c, g""")
def q20_smoothed_calibration(spark, sf_dir):
    j = _labelled(spark, sf_dir).withColumn("o", F.when(F.col("quality") == 1, "good").otherwise("bad"))
    return evaluate.smoothed(j, "source", "o", ["good", "bad"])


def _labelled(spark, sf_dir):
    """Documents with labels; the text is never read, so the join moves narrow rows."""
    return read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(read(spark, sf_dir, "labels"), "doc_id")


@query("SELECT source, round((count(*) FILTER (WHERE quality = 1) + 1) / (count(*) + 2), 6) AS accuracy, count(*) AS support FROM documents JOIN labels USING (doc_id) GROUP BY source")
def q21_laplace_accuracy(spark, sf_dir):
    return evaluate.laplace(_labelled(spark, sf_dir), "source", F.col("quality") == 1)


@query(f"WITH {_PATHS}, ev AS (SELECT path, {_EV} FROM cal) SELECT path, round(ea, 4) AS ev_approved, round(ed, 4) AS ev_denied, round(er, 4) AS ev_review, {_PICK} AS decision FROM ev")
def q22_payoff_argmax(spark, sf_dir):
    cal = order_calibration(order_paths(spark, sf_dir))
    ev = P.expected_values(_p3())
    return cal.select("path", *[F.round(ev[o], 4).alias(n) for o, n in zip(OUTCOMES, ("ev_approved", "ev_denied", "ev_review"), strict=True)], P.decide_safely(_p3(), F.col("path"))["decision"].alias("decision"))


@query(f"""WITH {_PATHS}, ev AS (SELECT outcome, pa, pd, pr, {_EV} FROM paths JOIN cal USING (path)), s AS (SELECT outcome, {_PICK} AS dec, CASE {_PICK} WHEN 'APPROVED' THEN pa WHEN 'DENIED' THEN pd ELSE pr END AS conf FROM ev)
SELECT count(*) AS n, sum(CASE WHEN dec = outcome THEN 8.0::DOUBLE WHEN dec = 'NEEDS_REVIEW' THEN 2.0::DOUBLE WHEN outcome = 'NEEDS_REVIEW' THEN 1.0::DOUBLE WHEN dec = 'APPROVED' THEN -4.0::DOUBLE ELSE 0.0::DOUBLE END) AS payoff,
round(avg((conf - CASE WHEN dec = outcome THEN 1.0 ELSE 0.0 END) ** 2), 6) AS brier, round(avg(CASE WHEN dec = outcome THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) FILTER (WHERE dec = 'APPROVED' AND outcome = 'DENIED') AS false_approvals FROM s""")
def q23_score(spark, sf_dir):
    paths = order_paths(spark, sf_dir)
    scored = evaluate.with_probabilities(paths, order_calibration(paths).drop("support"), "path", {f"p_{o}": 1 / 3 for o in OUTCOMES})
    d = P.decide(_p3())
    out = evaluate.challenge_score(scored.select("outcome", d["decision"].alias("decision"), d["confidence"].alias("confidence")), "outcome", "decision", "confidence")
    return out.select("n", "payoff", F.round("brier", 6).alias("brier"), F.round("accuracy", 6).alias("accuracy"), "false_approvals")


@query("SELECT d.doc_id, coalesce(quality, 1) AS quality, coalesce(toxic, 0) AS toxic, l.doc_id IS NULL AS missing FROM documents d LEFT JOIN labels l USING (doc_id)")
def q24_backfill_left(spark, sf_dir):
    return resolve.backfill(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), "doc_id", {"quality": 1, "toxic": 0})


@query("""WITH a AS (SELECT event_type, count(*) / (SELECT count(*) FROM events WHERE day(ts) <= 15) AS s FROM events WHERE day(ts) <= 15 GROUP BY 1), b AS (SELECT event_type, count(*) / (SELECT count(*) FROM events WHERE day(ts) > 15) AS s FROM events WHERE day(ts) > 15 GROUP BY 1)
SELECT event_type, coalesce(a.s, 0.0) AS share_a, coalesce(b.s, 0.0) AS share_b, coalesce(b.s, 0.0) - coalesce(a.s, 0.0) AS delta FROM a FULL JOIN b USING (event_type)""")
def q25_drift_full_outer(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_type", F.dayofmonth("ts").alias("day"))
    return evaluate.drift(e.where("day <= 15"), e.where("day > 15"), "event_type")


@query("""WITH l AS (SELECT 'segment' AS field, c_mktsegment AS value FROM customer UNION ALL SELECT 'nation', CAST(c_nationkey AS VARCHAR) FROM customer), c AS (SELECT field, value, count(*) AS n FROM l GROUP BY ALL)
SELECT field, value, n, round(n / sum(n) OVER (PARTITION BY field), 5) AS share, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) = 1 AS is_mode FROM c""")
def q26_lexicon_build(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("string").alias("nation"))
    return evaluate.prior_lexicon(c, ["segment", "nation"])


@query("SELECT position, token, count(*) AS n FROM (SELECT 'first' AS position, string_split(p_name, ' ')[1] AS token FROM part UNION ALL SELECT 'last', string_split(p_name, ' ')[-1] FROM part) GROUP BY ALL")
def q26b_name_tokens(spark, sf_dir):
    return evaluate.name_tokens(read(spark, sf_dir, "part"), "p_name")


_HOT = ", ".join(f"CASE WHEN max(c_mktsegment) = '{s}' THEN 1.0 ELSE 0.0 END AS segment_{s}" for s in SEGMENT_VISA)


@query(f"""SELECT c_custkey, {_HOT}, least(count(o_orderkey), 20) AS n_orders, CAST(count(DISTINCT o_orderstatus) AS DOUBLE) AS n_status,
CAST((count(o_orderkey) FILTER (WHERE o_orderpriority = '1-URGENT') > 0)::INT AS DOUBLE) AS any_urgent FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def q27_features_onehot(spark, sf_dir):
    c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    per = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.size(F.collect_set("o_orderstatus")).alias("s"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("u"))
    j = c.join(per, F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.select("c_custkey", *features.one_hot(F.col("c_mktsegment"), tuple(SEGMENT_VISA), "segment"), F.least(F.coalesce("n", F.lit(0)), F.lit(20)).cast("long").alias("n_orders"), F.coalesce("s", F.lit(0)).cast("double").alias("n_status"), (F.coalesce("u", F.lit(0)) > 0).cast("double").alias("any_urgent"))


@query("""WITH v AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN 'SPN-' || lpad(CAST(o_custkey % 10000 AS VARCHAR), 4, '0') WHEN 2 THEN o_orderpriority WHEN 3 THEN '[TORN' WHEN 4 THEN '2026-2-3' ELSE strftime(o_orderdate, '20%y-%m-%d') END AS value FROM orders)
SELECT o_orderkey, value, regexp_full_match(value, 'SPN-[0-9]{4}') AS is_sponsor, coalesce(regexp_full_match(value, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND year(try_cast(value AS DATE)) BETWEEN 2000 AND 2099, false) AS is_date,
length(value) BETWEEN 3 AND 60 AND regexp_full_match(value, '[A-Za-z][A-Za-z''-]*( [A-Za-z][A-Za-z''-]*)+') AS is_name,
regexp_matches(lower(value), 'cut out|whiteout|washed|blank|torn|illegible|obscured|lost|unreadable|redacted|missing') OR (value[1] IN ('[', '{', '(') AND NOT regexp_matches(value, '[\\])}]')) OR len(regexp_extract_all(value, '[A-Za-z0-9]')) < greatest(1, floor(length(value) / 3)) AS damaged FROM v""")
def q28_validators(spark, sf_dir):
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey") % 6
    value = (
        F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.concat(F.lit("SPN-"), F.lpad((F.col("o_custkey") % 10000).cast("string"), 4, "0"))).when(k == 2, F.col("o_orderpriority"))
        .when(k == 3, F.lit("[TORN")).when(k == 4, F.lit("2026-2-3")).otherwise(F.concat(F.lit("20"), F.date_format("o_orderdate", "yy-MM-dd")))
    )
    v = o.select("o_orderkey", value.alias("value"))
    return v.select("o_orderkey", "value", valid_sponsor(F.col("value")).alias("is_sponsor"), valid_date(F.col("value")).alias("is_date"), valid_name(F.col("value")).alias("is_name"), looks_damaged(F.col("value")).alias("damaged"))


@query("""SELECT o_orderkey, 'SPN-' || lpad(CAST(o_custkey % 10000 AS VARCHAR), 4, '0') AS sponsor, CASE WHEN year(o_orderdate) >= 2000 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '' END AS date,
lower(c_mktsegment) || '_flag' AS flag FROM orders JOIN customer ON c_custkey = o_custkey""")
def q29_mine_literals(spark, sf_dir):
    """Readings with misread prefixes, digits and separators."""
    o = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    garbled = lambda c: F.translate(c, "0158", "OlSB")
    day = F.concat_ws("/", *[garbled(F.date_format("o_orderdate", p)) for p in ("yyyy", "MM", "dd")])
    o = o.select("o_orderkey", F.concat(F.lit("ref 5RN "), garbled(F.lpad((F.col("o_custkey") % 10000).cast("string"), 4, "0")), F.lit(" dated "), day, F.lit(" for "), F.lower("c_mktsegment"), F.lit("_flag, a_b")).alias("text"))
    c, one = F.col("text"), lambda x: F.array_join(x, "|")
    return o.select("o_orderkey", one(T.mine_sponsors(c)).alias("sponsor"), one(T.mine_dates(c)).alias("date"), one(T.mine_flags(c)).alias("flag"))


@query("""SELECT user_id, CAST(day(ts) AS INT) AS page, sum(CASE WHEN event_type IN ('error', 'click') OR value > 1000 THEN 0 ELSE length(event_type) END)::BIGINT AS visible_chars,
count(*) FILTER (WHERE event_type IN ('error', 'click') OR value > 1000) AS hidden_spans FROM events GROUP BY ALL""")
def q30_visibility_split(spark, sf_dir):
    """Events as spans: errors are invisible, clicks white, large values off the page."""
    e = read(spark, sf_dir, "events")
    box = lambda x: F.struct(x.alias("x0"), F.lit(0.0).alias("y0"), (x + 1.0).alias("x1"), F.lit(1.0).alias("y1"))
    spans = e.select(
        F.col("user_id").alias("case_id"), F.dayofmonth("ts").alias("page"), F.col("event_id").alias("span_idx"), F.col("event_type").alias("text"), box(F.col("value")).alias("bbox"), F.struct(F.lit(-1e9).alias("x0"), F.lit(0.0).alias("y0"), F.lit(1000.0000001).alias("x1"), F.lit(1.0).alias("y1")).alias("visible_rect"),
        F.lit(10.0).alias("size"), F.when(F.col("event_type") == "click", 0xFFFFFF).otherwise(0).alias("color"), F.when(F.col("event_type") == "error", 0).otherwise(255).alias("alpha"), F.lit(0).alias("page_rotation"), F.lit(0.0).alias("dir_y"),
    )
    s = layout.with_visibility(spans)
    page = layout.pages(s).select("case_id", "page", F.col("visible_chars").cast("long").alias("visible_chars"))
    hidden = s.groupBy("case_id", "page").agg(F.count_if("hidden").alias("hidden_spans"))
    return page.join(hidden, ["case_id", "page"]).select(F.col("case_id").alias("user_id"), "page", "visible_chars", "hidden_spans")


def _misread(spark, sf_dir):
    """Part names with a letter lost, doubled or swapped, by key; and the names as vocabulary."""
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey") % 4
    n = F.col("p_name")
    at = (F.col("p_partkey") % 5 + 2).cast("int")
    bad = F.when(k == 0, n).when(k == 1, F.concat(F.substring(n, F.lit(1), at - 1), F.substring(n, at + 1, F.lit(99)))).when(k == 2, F.concat(F.substring(n, F.lit(1), at), F.substring(n, at, F.lit(99)))).otherwise(F.regexp_replace(n, "m", "rn"))
    words = p.groupBy("p_name").agg(F.count(F.lit(1)).alias("c")).select(F.col("p_name").alias("value"), F.xxhash64("p_name").alias("h"))
    return p.select(bad.alias("reading")), words.select("value", F.col("value").alias("idx"))


@query("""WITH r AS (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN substr(p_name, 1, CAST(p_partkey % 5 + 1 AS INT)) || substr(p_name, CAST(p_partkey % 5 + 3 AS INT)) WHEN 2 THEN substr(p_name, 1, CAST(p_partkey % 5 + 2 AS INT)) || substr(p_name, CAST(p_partkey % 5 + 2 AS INT)) ELSE replace(p_name, 'm', 'rn') END AS reading FROM part),
c AS (SELECT reading, regexp_replace(lower(reading), '[^a-z0-9]+', '', 'g') AS c FROM r), v AS (SELECT DISTINCT p_name AS value, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS w FROM part),
s AS (SELECT reading, c, value, CAST(levenshtein(c, w) AS DOUBLE) AS d, row_number() OVER (PARTITION BY reading ORDER BY levenshtein(c, w), value) AS rn FROM c, v WHERE abs(length(c) - length(w)) <= greatest(1.0, length(c) * 0.34) + 0.5),
k AS (SELECT a.reading, a.value, a.d, greatest(1.0, length(a.c) * 0.34) AS budget, coalesce(b.d, 1e9) AS d2 FROM s a LEFT JOIN s b ON a.reading = b.reading AND b.rn = 2 WHERE a.rn = 1),
f AS (SELECT *, CASE WHEN d > budget THEN 0.0 ELSE greatest(0.0, 1.0 - d / budget) * CASE WHEN d > 0 AND d2 - d < 0.5 THEN 0.35 ELSE 1.0 END END AS conf FROM k)
SELECT c.reading, CASE WHEN conf > 0 THEN f.value END AS snapped, round(coalesce(conf, 0.0), 6) AS confidence, d AS distance FROM c LEFT JOIN f USING (reading)""")
def q31_snap_plain(spark, sf_dir):
    readings, words = _misread(spark, sf_dir)
    return snap.snap(readings, words, "reading", costs=PLAIN).withColumn("confidence", F.round("confidence", 6))


@query()
def q32_snap_ocr(spark, sf_dir):
    readings, words = _misread(spark, sf_dir)
    return snap.snap(readings, words, "reading", costs=SCAN)


@query("""WITH RECURSIVE e AS (SELECT user_id, epoch(ts) AS y, event_id, row_number() OVER (PARTITION BY user_id ORDER BY epoch(ts), event_id) AS rn FROM events),
g AS (SELECT user_id, event_id, rn, y AS anchor, 0 AS row FROM e WHERE rn = 1
UNION ALL SELECT e.user_id, e.event_id, e.rn, CASE WHEN e.y - g.anchor > 86400 THEN e.y ELSE g.anchor END, CASE WHEN e.y - g.anchor > 86400 THEN g.row + 1 ELSE g.row END FROM g JOIN e ON e.user_id = g.user_id AND e.rn = g.rn + 1)
SELECT user_id, event_id, row FROM g""")
def q33_row_grouping(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    page = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(seconds.alias("y"), "event_id"))).alias("items"))
    page = page.withColumn("rows", boxes.anchored_rows(F.col("items"), F.lit(86400.0)))
    return page.select("user_id", F.explode(F.arrays_zip("items", "rows")).alias("z")).select("user_id", F.col("z.items.event_id").alias("event_id"), F.col("z.rows").alias("row"))


@query("""WITH f AS (SELECT l_orderkey AS k, 'returned' AS flag FROM lineitem WHERE l_returnflag = 'R' UNION SELECT l_orderkey, 'bulk' FROM lineitem WHERE l_quantity >= 45 UNION SELECT o_orderkey, 'urgent' FROM orders WHERE o_orderpriority = '1-URGENT' UNION SELECT o_orderkey, 'costly' FROM orders WHERE o_totalprice > 400000),
u AS (SELECT k, list_sort(list(flag)) AS flags FROM f GROUP BY k) SELECT o_orderkey, coalesce(array_to_string(flags, '|'), 'none') AS risk_flags, coalesce(list_has_any(flags, ['bulk', 'costly']), false) AS disqualified FROM orders LEFT JOIN u ON k = o_orderkey""")
def q34_flag_union(spark, sf_dir):
    o, li = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    channel = lambda df, name: df.select("o_orderkey", F.lit(name).alias("flag"))
    u = resolve.union_flags([channel(li.where("l_returnflag = 'R'"), "returned"), channel(li.where("l_quantity >= 45"), "bulk"), channel(o.where("o_orderpriority = '1-URGENT'"), "urgent"), channel(o.where("o_totalprice > 400000"), "costly")], "o_orderkey")
    j = o.select("o_orderkey").join(u, "o_orderkey", "left").withColumn("flags", F.coalesce("flags", F.array().cast("array<string>")))
    return j.select("o_orderkey", T.flag_string(F.col("flags")).alias("risk_flags"), F.arrays_overlap("flags", F.array(F.lit("bulk"), F.lit("costly"))).alias("disqualified"))


@query("""SELECT lang, count(*) AS n, min(n_chars) AS min, max(n_chars) AS max, list_sort(list(n_chars))[CAST(floor(count(*) * 0.1) AS INT) + 1] AS p10, list_sort(list(n_chars))[CAST(floor(count(*) / 2) AS INT) + 1] AS median FROM documents GROUP BY lang""")
def q35_corpus_profile(spark, sf_dir):
    return corpus.profile(read(spark, sf_dir, "documents"), ["lang"], "n_chars")


@query("SELECT o_orderkey, sha256('{\"o_custkey\":' || o_custkey || ',\"o_orderkey\":' || o_orderkey || ',\"o_orderpriority\":\"' || o_orderpriority || '\",\"o_orderstatus\":\"' || o_orderstatus || '\"}') AS fingerprint FROM orders")
def q36_fingerprint(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", row_fingerprint(["o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus"]).alias("fingerprint"))


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 'applicant_name' WHEN 'view' THEN 'species_code' ELSE '_observed_flags' END AS field, lpad(CAST(event_id % 1000 AS VARCHAR), 3, '0') AS value FROM events WHERE event_type IN ('click', 'view', 'error')""")
def q37_label_parse(spark, sf_dir):
    """Events as inline lines; purchases and signups have keys that nothing lists."""
    keys = {"click": "Applicant", "view": "SPECIES  match ", "error": " Observed Flags", "purchase": "Price", "signup": "Name"}
    line = F.concat(T.lookup(keys, F.col("event_type")), F.lit(" :  "), F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0"), F.lit(" "))
    spans = read(spark, sf_dir, "events").select(F.lit("c").alias("case_id"), F.lit(1).alias("page"), F.col("event_id").alias("span_idx"), line.alias("text"), F.lit(False).alias("hidden"))
    return layout.inline(spans).select(F.col("seq").alias("event_id"), "field", "value")


@query("""WITH r AS (SELECT DISTINCT CASE c_custkey % 3 WHEN 0 THEN '| the ' || c_mktsegment WHEN 1 THEN replace(c_mktsegment, 'I', '1') ELSE c_mktsegment || 'S' END AS reading FROM customer), l AS (SELECT lower(c_mktsegment) AS low, c_mktsegment AS label, min(c_custkey) AS idx FROM customer GROUP BY ALL),
w AS (SELECT reading, list_filter(string_split(regexp_replace(lower(reading), '[^a-z ]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM r),
t AS (SELECT reading, array_to_string(w[-3:], ' ') AS t3, array_to_string(w[-2:], ' ') AS t2, w[-1] AS t1, len(w) AS n FROM w),
e AS (SELECT reading, label, row_number() OVER (PARTITION BY reading ORDER BY CASE WHEN low = t3 AND n >= 3 THEN 0 WHEN low = t2 AND n >= 2 THEN 1 ELSE 2 END, idx) AS rn FROM t, l WHERE (low = t3 AND n >= 3) OR (low = t2 AND n >= 2) OR low = t1),
m AS (SELECT reading, label, idx, length(t2) AS size, hamming(substr(t2, 1, least(length(t2), length(low))), substr(low, 1, least(length(t2), length(low)))) + abs(length(t2) - length(low)) AS d FROM t, l WHERE abs(length(t2) - length(low)) <= 4 AND reading NOT IN (SELECT reading FROM e)),
k AS (SELECT *, row_number() OVER (PARTITION BY reading ORDER BY d, idx) AS rn FROM m)
SELECT reading, label, 0 AS mismatches FROM e WHERE rn = 1 UNION ALL SELECT reading, label, CAST(d AS INT) FROM k WHERE rn = 1 AND d <= greatest(2, floor(size / 4))""")
def q39_fuzzy_label_match(spark, sf_dir):
    c, k = read(spark, sf_dir, "customer"), F.col("c_custkey") % 3
    reading = F.when(k == 0, F.concat(F.lit("| the "), "c_mktsegment")).when(k == 1, F.regexp_replace("c_mktsegment", "I", "1")).otherwise(F.concat("c_mktsegment", F.lit("S")))
    labels = c.groupBy(F.col("c_mktsegment").alias("label")).agg(F.min("c_custkey").alias("idx"))
    return snap.match_labels(c.select(reading.alias("reading")), labels, "reading")


@query("""WITH y AS (SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 50), m AS (SELECT y AS modal FROM y ORDER BY n DESC, y DESC LIMIT 1),
s AS (SELECT o_orderkey, year(o_orderdate) AS oy, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders), c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND oy IN (SELECT y FROM y) THEN d END AS a, CASE WHEN o_orderkey % 2 = 0 AND oy = modal THEN d END AS b FROM s, m)
SELECT o_orderkey, coalesce(a, b) AS settled FROM c WHERE a IS NULL OR b IS NULL OR a = b""")
def q40_box_settlement(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"), F.year("o_orderdate").alias("year"))
    years = o.groupBy("year").agg(F.count(F.lit(1)).alias("n")).where("n >= 50").agg(F.collect_list(F.struct(F.col("n").cast("long").alias("n"), F.col("year").cast("string").alias("y"))).alias("years"), F.max(F.struct("n", "year"))["year"].alias("modal"))
    e = F.array().cast("array<string>")
    s = corpus.with_context(o, years)
    strict, cheap = F.when(F.col("o_orderkey") % 3 == 0, F.array("d")).otherwise(e), F.when(F.col("o_orderkey") % 2 == 0, F.array("d")).otherwise(e)
    return s.select("o_orderkey", corpus.settle_box_date(strict, cheap, F.col("years"), F.col("modal")).alias("settled"))


@query("""WITH v AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS rn FROM v) SELECT user_id, event_type, n, CAST(rn AS INT) AS rn FROM r WHERE rn <= 2""")
def q41_top_counts(spark, sf_dir):
    return evaluate.top_counts(read(spark, sf_dir, "events"), ["user_id"], "event_type", 2)


@query("SELECT CAST(CASE WHEN l_discount < 0.02 THEN 0 WHEN l_discount < 0.05 THEN 1 WHEN l_discount < 0.08 THEN 2 ELSE 3 END AS INT) AS bucket, count(*) AS n FROM lineitem GROUP BY 1")
def q42_histogram(spark, sf_dir):
    return evaluate.histogram(read(spark, sf_dir, "lineitem"), "l_discount", (0.0, 0.02, 0.05, 0.08, 1.01))


@query("""WITH v AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'arrival_date' WHEN 1 THEN 'fee_status' WHEN 2 THEN 'sponsor_id' ELSE 'home_world' END AS field, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '20%y-%m-%d') WHEN o_orderkey % 3 = 1 THEN o_orderpriority ELSE '[' END AS value FROM orders)
SELECT o_orderkey, field, value, CASE WHEN value = '[' THEN false WHEN field = 'arrival_date' THEN o_orderkey % 3 = 0 AND try_cast(value AS DATE) IS NOT NULL WHEN field = 'fee_status' THEN len(regexp_extract_all(value, '[A-Za-z]')) >= 3 WHEN field = 'sponsor_id' THEN false ELSE len(regexp_extract_all(value, '[A-Za-z0-9]')) >= 2 END AS valid FROM v""")
def q44_admission_gate(spark, sf_dir):
    o, k, m = read(spark, sf_dir, "orders"), F.col("o_orderkey") % 4, F.col("o_orderkey") % 3
    field = F.when(k == 0, "arrival_date").when(k == 1, "fee_status").when(k == 2, "sponsor_id").otherwise("home_world")
    value = F.when(m == 0, F.concat(F.lit("20"), F.date_format("o_orderdate", "yy-MM-dd"))).when(m == 1, F.col("o_orderpriority")).otherwise(F.lit("["))
    v = o.select("o_orderkey", field.alias("field"), value.alias("value"))
    return v.withColumn("valid", valid_for_field(F.col("field"), F.col("value")))


@query("SELECT avg(m) AS mean, stddev_samp(m) / sqrt(count(m)) AS standard_error FROM (SELECT o_orderpriority, round(avg(o_totalprice), 2) AS m FROM orders GROUP BY 1)")
def q45_repeats(spark, sf_dir):
    m = read(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.round(F.avg("o_totalprice"), 2).alias("m"))
    return evaluate.repeats(m, "m")


@query(f"WITH {_OBS}, f AS (SELECT user_id, event_type, count(*) AS n, min(value) <> max(value) AS split FROM obs GROUP BY ALL) SELECT user_id, CAST(sum(n) AS BIGINT) AS obs_total, count(*) FILTER (WHERE NOT split) AS fields_corroborated, count(*) FILTER (WHERE split) AS fields_conflicting FROM f GROUP BY user_id")
def q46_corroboration_stats(spark, sf_dir):
    return resolve.corroboration(observations(spark, sf_dir).withColumnRenamed("event_type", "field"), "user_id")


@query("""WITH r AS (SELECT DISTINCT text AS reading, regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') AS c FROM benchmark), v AS (SELECT text AS value, regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') AS w FROM documents)
SELECT reading, min(value) AS value FROM r JOIN v ON starts_with(w, c) WHERE length(c) >= 6 GROUP BY reading HAVING count(*) = 1""")
def q47_unique_prefix(spark, sf_dir):
    return snap.unique_prefix(read(spark, sf_dir, "benchmark").select(F.col("text").alias("reading")), read(spark, sf_dir, "documents").select(F.col("text").alias("value")), "reading")


@query("SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def q48_unseen_customers(spark, sf_dir):
    return evaluate.unseen(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), read(spark, sf_dir, "customer"), "c_custkey")


@query("""WITH c AS (SELECT year(o_orderdate) AS year, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 50),
i AS (SELECT *, year - row_number() OVER (ORDER BY year) AS island FROM c) SELECT year, n FROM i WHERE island = (SELECT island FROM i ORDER BY n DESC, year DESC LIMIT 1)""")
def q49_contiguous_years_all(spark, sf_dir):
    return corpus.contiguous_years(read(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year")), "year")


@query("""
WITH w AS (SELECT DISTINCT text, regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') AS w FROM documents WHERE text IS NOT NULL),
r AS (SELECT DISTINCT split_part(text, '.', 1) AS reading, regexp_replace(lower(split_part(text, '.', 1)), '[^a-z0-9]+', '', 'g') AS c FROM documents WHERE text IS NOT NULL)
SELECT reading, md5(min(text)) AS value FROM r JOIN w ON starts_with(w.w, r.c) WHERE length(c) >= 6 GROUP BY reading HAVING count(*) = 1""")
def q50_first_sentences(spark, sf_dir):
    """First sentences of documents that are the beginning of exactly one text."""
    texts = read(spark, sf_dir, "documents").where("text is not null").select(F.col("text").alias("value")).distinct()
    firsts = texts.select(F.substring_index("value", ".", 1).alias("reading"))
    return snap.unique_prefix(firsts, texts, "reading").select("reading", F.md5("value").alias("value"))


@query("""
WITH f AS (SELECT coalesce(lang, '') || '/' || coalesce(source, '') AS folder, coalesce(lang, '') AS top, doc_id::VARCHAR AS name, sha256(coalesce(text, '')) AS digest FROM documents),
s AS (SELECT top, folder, substr(folder, length(top) + 2) AS name, sha256(string_agg(digest || ' ' || name, chr(10) ORDER BY name, digest)) AS digest FROM f GROUP BY ALL),
l AS (SELECT top AS name, sha256(string_agg(digest || ' ' || name, chr(10) ORDER BY name, digest)) AS digest FROM s GROUP BY top)
SELECT folder || '/' || name AS path, 3 AS depth, digest FROM f UNION ALL SELECT folder, 2, digest FROM s UNION ALL SELECT name, 1, digest FROM l
UNION ALL SELECT '', 0, sha256(string_agg(digest || ' ' || name, chr(10) ORDER BY name, digest)) FROM l""")
def q51_tree_digest(spark, sf_dir):
    """Digests of documents as files in folders of languages and sources, up to the root."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    files = read(spark, sf_dir, "documents").select(F.concat_ws("/", blank("lang"), blank("source"), F.col("doc_id").cast("string")).alias("path"), blank("text").cast("binary").alias("content"))
    return tree_digest(files)
