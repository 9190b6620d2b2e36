"""The contract-bound queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm.bpe import encode_documents
from caseloom.llm.common import materialize, table
from caseloom.llm.conversations import damage, repair_digests
from caseloom.llm.divergence import audit_sources
from caseloom.llm.exact_dedup import exact_duplicates
from caseloom.llm.html_extract import extract_main_text
from caseloom.llm.line_dedup import deduplicate_lines
from caseloom.llm.mixing import mix_sizes, with_sizes
from caseloom.llm.near_dedup import near_duplicates
from caseloom.llm.packing import pack_documents
from caseloom.llm.quality import quality
from caseloom.llm.sharding import shard_documents
from caseloom.llm.toxicity import score_toxicity, train
from caseloom.llm.warc import round_trip


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    side = lambda q: labels.where(F.col("quality") == q).select("doc_id")
    return quality(table(spark, sf_dir, "documents"), side(1), side(0))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sizes(materialize(with_sizes(table(spark, sf_dir, "documents")), "mix-sizes"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(table(spark, sf_dir, "documents"))
    return placed.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, train(docs, table(spark, sf_dir, "labels"))).select("doc_id", "held_out", "score", "predicted", "spans")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark, table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = deduplicate_lines(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_deleted", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_digests(damage(table(spark, sf_dir, "conversations")))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = public_tokenizers.path
    return pack_documents(table(spark, sf_dir, "documents"), file("byte_bpe_50k.json"), file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_minhash_near_dedup, op2_quality_rules, op3_exact_dedup, op4_mixing, op5_sharding, op6_toxicity, op7_html_extraction, op8_warc, op9_line_dedup, op10_bpe, op11_source_divergence, op12_conversation_repair, op13_packing)}

ORACLES: dict[str, str] = {
    "op3_exact_dedup": r"""
        WITH d AS (
          SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents
        ), g AS (
          SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, row_number() OVER w AS place FROM d
          WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
        )
        SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM g
    """,
    "op4_mixing": r"""
        WITH d AS (
          SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
        ), s AS (
          SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
        ), w AS (
          SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w, 3 * source_size AS cap FROM s
        ), l AS (
          SELECT *, (sum(source_size) OVER ())::HUGEINT - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
            sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM w
        ), f AS (
          SELECT rest AS rest0, share AS share0 FROM l WHERE cap * share > rest * w ORDER BY share DESC LIMIT 1
        ), t AS (
          SELECT source, source_size, CASE WHEN share <= share0 THEN w * rest0::DOUBLE / share0 ELSE cap::DOUBLE END AS target FROM l LEFT JOIN f ON true
        ), r AS (
          SELECT d.doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
            ('0x' || substr(md5('0:' || doc_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
          FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
        )
        SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
    """,
    "op8_warc": """
        WITH p AS (
          SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS sha FROM pages
        ), g AS (
          SELECT page_id, octet_length(encode(payload)) AS payload_bytes, sha, max(page_id) OVER (PARTITION BY payload) AS latest FROM p
        )
        SELECT page_id, payload_bytes,
          translate(array_to_string([to_base(('0x' || substr(sha, 10 * k + 1, 10))::BIGINT, 32, 8) FOR k IN [0, 1, 2, 3]], ''),
            '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
          CASE WHEN page_id = latest THEN 'response' ELSE 'revisit' END AS record_type,
          CASE WHEN page_id <> latest THEN latest END AS refers_to
        FROM g
    """,
    "op9_line_dedup": r"""
        WITH l AS (
          SELECT doc_id, i - 1 AS ln, x[i] AS line, len(regexp_extract_all(x[i], '[^\x20\x09-\x0D]+')) AS n
          FROM (SELECT doc_id, string_split(text, chr(10)) AS x, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)
        ), s AS (
          SELECT doc_id, ln, line, n, row_number() OVER w AS q, sum(n) OVER w AS upto FROM l WHERE n > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY ln)
        ), seq AS (
          SELECT doc_id, list(line ORDER BY q) AS lines FROM s GROUP BY doc_id
        ), runs AS (
          SELECT a.doc_id, a.q, b.q - a.q + 1 AS len, md5(array_to_string(seq.lines[a.q : b.q], chr(10))) AS name
          FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.q BETWEEN a.q AND a.q + 49 JOIN seq ON seq.doc_id = a.doc_id
          WHERE b.upto - a.upto + a.n >= 50 AND (b.upto - a.upto < 50 OR b.upto - b.n - a.upto + a.n < 50)
        ), f AS (
          SELECT *, first_value(doc_id) OVER w AS d0, first_value(q) OVER w AS q0 FROM runs WINDOW w AS (PARTITION BY name, len ORDER BY doc_id, q)
        ), gone AS (
          SELECT DISTINCT s.doc_id, s.ln FROM f JOIN s ON s.doc_id = f.doc_id AND s.q BETWEEN f.q AND f.q + f.len - 1
          WHERE f.doc_id <> f.d0 OR f.q >= f.q0 + f.len
        )
        SELECT l.doc_id, count(*) AS n_lines, count(gone.ln) AS n_deleted,
          sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.ln) FILTER (WHERE gone.ln IS NULL), '')) AS text_sha256
        FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.ln = gone.ln GROUP BY l.doc_id
    """,
    "op11_source_divergence": r"""
        WITH d AS (
          SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
            regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents
        ), c AS (
          SELECT id, lang, source, term, count(*) AS n FROM (SELECT id, lang, source, unnest(words) AS term FROM d) GROUP BY ALL
        ), kept AS (
          SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY lang, term HAVING count(*) >= 30
        ), langs AS (
          SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS whole FROM kept GROUP BY lang
        ), q AS (
          SELECT lang, term, (1 + (1000000000::HUGEINT * (n + 5)) // (whole + 5 * v))::BIGINT AS q FROM kept JOIN langs USING (lang)
        ), found AS (
          SELECT c.lang, c.source, c.term, sum(c.n)::HUGEINT AS n FROM c JOIN kept USING (lang, term) GROUP BY ALL
        ), groups AS (
          SELECT DISTINCT lang, source FROM d
        ), sums AS (
          SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS whole FROM groups LEFT JOIN found USING (lang, source) GROUP BY ALL
        ), p AS (
          SELECT s.lang, s.source, q.term, q.q, coalesce(f.n, 0) AS n, (1 + (1000000000::HUGEINT * (coalesce(f.n, 0) + 5)) // (s.whole + 5 * l.v))::BIGINT AS p
          FROM sums s JOIN langs l ON l.lang = s.lang JOIN q ON q.lang = s.lang LEFT JOIN found f ON f.lang = s.lang AND f.source = s.source AND f.term = q.term
        ), pair AS (
          SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
          FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN (SELECT a.lang, a.source, b.source AS other, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) x
            ON x.lang = a.lang AND x.source = a.source AND x.other = b.source
        ), term AS (
          SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p WHERE n > 0 AND p > q
        )
        SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
        FROM (SELECT * FROM pair UNION ALL SELECT * FROM term) QUALIFY part = 'pair' OR rank <= 50
    """,
    "op12_conversation_repair": r"""
        WITH RECURSIVE r AS (
          SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')) AS k FROM conversations
        ), z AS (
          SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(8 * octet_length(k)), lambda j: CASE WHEN j % 8 = 0 THEN (('0x' || substr(hex(k), (j // 4 + 1)::INTEGER, 2))::BIGINT) ELSE 0 END)),
            lambda c, b: CASE WHEN xor(c, b) % 2 = 1 THEN xor(xor(c, b) // 2, 3988292384::BIGINT) ELSE xor(c, b) // 2 END), 4294967295::BIGINT) % 20 AS kind FROM r
        ), m AS (
          SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
            unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM z
        ), f AS (
          SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
            right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS final FROM m
        ), t AS (
          SELECT *, left(role, 1) AS initial, final = '' OR again AS must, final <> '' AND NOT again AND final NOT IN ('.', '!', '?') AS cut, lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS later FROM f
        ), s AS (
          SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (final = '') AS blank, count(*) FILTER (final <> '' AND again) AS duplicate,
            count(*) FILTER (cut) AS truncated, count(*) FILTER (later IS NOT NULL AND initial || later NOT IN ('su', 'ua', 'au')) AS illegal FROM t GROUP BY conv_id
        ), w AS (
          SELECT conv_id, n AS i, {'c': 0, 'a': '', 'x': []::VARCHAR[]} AS q0, {'c': 6, 'a': 'II', 'x': ['user:', 'assistant:']} AS q1, {'c': 3, 'a': 'I', 'x': ['assistant:']} AS q2, {'c': 0, 'a': '', 'x': []::VARCHAR[]} AS q3 FROM s
          UNION ALL
          SELECT conv_id, i, least(b0, {'c': b2.c + 3, 'a': 'I' || b2.a, 'x': list_prepend('user:', b2.x)}, {'c': b3.c + 6, 'a': 'II' || b3.a, 'x': list_concat(['user:', 'assistant:'], b3.x)}),
            least(b1, {'c': b2.c + 3, 'a': 'I' || b2.a, 'x': list_prepend('user:', b2.x)}, {'c': b3.c + 6, 'a': 'II' || b3.a, 'x': list_concat(['user:', 'assistant:'], b3.x)}),
            least(b2, {'c': b3.c + 3, 'a': 'I' || b3.a, 'x': list_prepend('assistant:', b3.x)}), least(b3, {'c': b2.c + 3, 'a': 'I' || b2.a, 'x': list_prepend('user:', b2.x)})
          FROM (
            SELECT t.conv_id, t.i - 1 AS i,
              least({'c': q0.c + 4, 'a': 'D' || q0.a, 'x': q0.x}, {'c': CASE WHEN must OR initial <> 's' THEN 1000000 ELSE 0 END + e + q1.c, 'a': 'K' || q1.a, 'x': list_prepend(role || ':' || text, q1.x)},
                {'c': CASE WHEN must OR initial <> 'u' THEN 1000000 ELSE 0 END + e + q2.c, 'a': 'K' || q2.a, 'x': list_prepend(role || ':' || text, q2.x)}, {'c': CASE WHEN must THEN 1000000 ELSE 3 END + e + q2.c, 'a': 'R' || q2.a, 'x': list_prepend('user:' || text, q2.x)}) AS b0,
              least({'c': q1.c + 4, 'a': 'D' || q1.a, 'x': q1.x}, {'c': CASE WHEN must OR initial <> 'u' THEN 1000000 ELSE 0 END + e + q2.c, 'a': 'K' || q2.a, 'x': list_prepend(role || ':' || text, q2.x)},
                {'c': CASE WHEN must THEN 1000000 ELSE 3 END + e + q2.c, 'a': 'R' || q2.a, 'x': list_prepend('user:' || text, q2.x)}) AS b1,
              least({'c': q2.c + 4, 'a': 'D' || q2.a, 'x': q2.x}, {'c': CASE WHEN must OR initial <> 'a' THEN 1000000 ELSE 0 END + e + q3.c, 'a': 'K' || q3.a, 'x': list_prepend(role || ':' || text, q3.x)},
                {'c': CASE WHEN must THEN 1000000 ELSE 3 END + e + q3.c, 'a': 'R' || q3.a, 'x': list_prepend('assistant:' || text, q3.x)}) AS b2,
              least({'c': q3.c + 4, 'a': 'D' || q3.a, 'x': q3.x}, {'c': CASE WHEN must OR initial <> 'u' THEN 1000000 ELSE 0 END + e + q2.c, 'a': 'K' || q2.a, 'x': list_prepend(role || ':' || text, q2.x)},
                {'c': CASE WHEN must THEN 1000000 ELSE 3 END + e + q2.c, 'a': 'R' || q2.a, 'x': list_prepend('user:' || text, q2.x)}) AS b3
            FROM w JOIN (SELECT *, CASE WHEN cut THEN 3 ELSE 0 END AS e FROM t) t ON w.conv_id IS NOT DISTINCT FROM t.conv_id AND w.i = t.i
          )
        )
        SELECT r.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
          coalesce(q0.c, 0)::BIGINT AS cost, coalesce(q0.a, '') AS audit, sha256(coalesce(array_to_string(q0.x, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM r) r LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM r.conv_id LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM r.conv_id AND w.i = 0
    """,
}
