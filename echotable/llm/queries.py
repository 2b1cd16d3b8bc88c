"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import conversations, decontamination, exact_dedup, line_dedup, media, near_dedup, packing, quality, secrets, sharding, substring_dedup, toxicity, whitening
from .base import table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


def op8_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media(table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added=packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json")))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=4)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(table(spark, sf_dir, "conversations"), damage=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_classifier, op2_toxicity, op3_sharding, op4_substring_dedup, op5_secret_scan, op6_decontamination, op7_line_dedup, op8_media_chunks, op9_best_fit_packing, op10_minhash_near_dedup, op11_embedding_whitening, op12_exact_dedup, op13_conversation_repair)}


def oracle_sql() -> dict[str, str]:
    """The rows by their definitions: every window, every shared shingle, every text; pairs of lines by their halves, of which two lines at distance one share one."""
    return {"op4_substring_dedup": _OP4, "op7_line_dedup": _OP7, "op10_minhash_near_dedup": _OP10, "op12_exact_dedup": _OP12, "op13_conversation_repair": _OP13}


_OP4 = r"""WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
win AS (SELECT doc_id, i, sha256(array_to_string(ws[i:i+49], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d)),
first AS (SELECT k, min(doc_id) AS f FROM win GROUP BY k HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT doc_id, i FROM win JOIN first USING (k) WHERE doc_id > f),
isl AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 OR lag(i) OVER (PARTITION BY doc_id ORDER BY i) IS NULL THEN 1 ELSE 0 END AS new FROM hit)),
span AS (SELECT doc_id, min(i) - 1 AS a, max(i) + 49 AS b FROM isl GROUP BY doc_id, g),
cut AS (SELECT doc_id, list([a, b] ORDER BY a) AS spans, sum(b - a) AS n FROM span GROUP BY doc_id),
word AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS p FROM d WHERE doc_id IN (SELECT doc_id FROM cut)),
left_over AS (SELECT w.doc_id, coalesce(string_agg(w, ' ' ORDER BY p), '') AS t FROM word w WHERE NOT EXISTS (SELECT 1 FROM span s WHERE s.doc_id = w.doc_id AND p >= a AND p < b) GROUP BY w.doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(CASE WHEN n IS NULL THEN array_to_string(ws, ' ') ELSE coalesce(t, '') END) AS kept_sha256 FROM d LEFT JOIN cut USING (doc_id) LEFT JOIN left_over USING (doc_id)"""

_OP7 = r"""WITH l AS (SELECT doc_id, i - 1 AS nth, lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), ' ')) AS t FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
u AS (SELECT t, min({'d': doc_id, 'n': nth}) AS first, length(t) AS m FROM l WHERE t <> '' GROUP BY t),
h AS (SELECT t, first, m, unnest([substr(t, 1, m // 2) || chr(1), chr(1) || substr(t, m // 2 + 1), substr(t, 1, (m + 1) // 2) || chr(2), chr(2) || substr(t, m - (m + 1 - (m + 1) // 2) + 1)]) AS k, unnest([m, m, m + 1, m + 1]) AS longer, unnest([1, 2, 1, 2]) AS side FROM u WHERE m >= 20),
kk AS (SELECT t, first, m, longer, side, replace(replace(k, chr(1), ''), chr(2), '') AS k FROM h),
near AS (SELECT DISTINCT b.t, b.first FROM kk a JOIN kk b ON a.longer = b.longer AND a.side = b.side AND a.k = b.k AND a.first < b.first AND abs(a.m - b.m) <= 1 AND len(list_filter(range(1, least(a.m, b.m) + 1), lambda i: substr(a.t, 1, i) = substr(b.t, 1, i))) + len(list_filter(range(1, least(a.m, b.m) + 1), lambda i: right(a.t, i) = right(b.t, i))) >= greatest(a.m, b.m) - 1),
gone AS (SELECT l.doc_id, l.nth FROM l JOIN u ON u.t = l.t WHERE {'d': l.doc_id, 'n': l.nth} > u.first UNION SELECT first.d, first.n FROM near),
per AS (SELECT doc_id, list(nth::INT ORDER BY nth) AS removed FROM gone GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END AS n_lines, coalesce(len(removed), 0) AS n_removed, coalesce(removed, []::INT[]) AS removed FROM documents d LEFT JOIN per USING (doc_id)"""

_OP10 = r"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i+least(3, len(ws) - 1)], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 2))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
hs AS (SELECT sh.doc_id, hash(s) AS s, n FROM sh JOIN n USING (doc_id)),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y FROM hs a JOIN hs b ON a.s = b.s AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT reach.a, e.y FROM reach JOIN e ON e.x = reach.b),
c AS (SELECT a, min(b) AS component FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component, d.doc_id) AS component_id, coalesce(component, d.doc_id) = d.doc_id AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = d.doc_id"""

_OP12 = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256 FROM d WINDOW w AS (PARTITION BY t)"""

# the checksum bit by bit; then, turn by turn, the cheapest and least audit (c, a) of each state with what it leaves (t)
_OP13 = r"""WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
k AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda c: ascii(c)::BIGINT)), lambda acc, b: list_reduce([xor(acc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 20 AS kind FROM raw),
m AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said, substr(role, 1, 1) AS r FROM m),
f AS (SELECT *, said = '' AS blank, said <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS duplicate, lag(r) OVER (PARTITION BY conv_id ORDER BY i) AS p FROM o),
g AS (SELECT *, NOT blank AND NOT duplicate AND right(said, 1) NOT IN ('.', '!', '?') AS truncated FROM f),
z AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated, count(*) FILTER (p IS NOT NULL AND p || r NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM g GROUP BY conv_id),
s AS (SELECT conv_id, 0::BIGINT AS i, {'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]} AS s0, {'c': 1000000000::BIGINT, 'a': '', 't': []::VARCHAR[]} AS s1, {'c': 1000000000::BIGINT, 'a': '', 't': []::VARCHAR[]} AS s2, {'c': 1000000000::BIGINT, 'a': '', 't': []::VARCHAR[]} AS s3 FROM z
 UNION ALL SELECT conv_id, i, CASE WHEN end_here THEN e0 ELSE {'c': e0.c + 3, 'a': e0.a || 'D', 't': e0.t} END,
  CASE WHEN end_here THEN e1 ELSE least({'c': e1.c + 3, 'a': e1.a || 'D', 't': e1.t}, {'c': e0.c + late + CASE WHEN must OR r <> 's' THEN 1000000000 ELSE 0 END, 'a': e0.a || 'K', 't': list_append(e0.t, role || ':' || text)}) END,
  CASE WHEN end_here THEN e2 ELSE least({'c': e2.c + 3, 'a': e2.a || 'D', 't': e2.t},
   {'c': e0.c + late + CASE WHEN must OR r <> 'u' THEN 1000000000 ELSE 0 END, 'a': e0.a || 'K', 't': list_append(e0.t, role || ':' || text)}, {'c': e1.c + late + CASE WHEN must OR r <> 'u' THEN 1000000000 ELSE 0 END, 'a': e1.a || 'K', 't': list_append(e1.t, role || ':' || text)}, {'c': e3.c + late + CASE WHEN must OR r <> 'u' THEN 1000000000 ELSE 0 END, 'a': e3.a || 'K', 't': list_append(e3.t, role || ':' || text)},
   {'c': e0.c + 2 + late + CASE WHEN must THEN 1000000000 ELSE 0 END, 'a': e0.a || 'R', 't': list_append(e0.t, 'user:' || text)}, {'c': e1.c + 2 + late + CASE WHEN must THEN 1000000000 ELSE 0 END, 'a': e1.a || 'R', 't': list_append(e1.t, 'user:' || text)}, {'c': e3.c + 2 + late + CASE WHEN must THEN 1000000000 ELSE 0 END, 'a': e3.a || 'R', 't': list_append(e3.t, 'user:' || text)}) END,
  CASE WHEN end_here THEN e3 ELSE least({'c': e3.c + 3, 'a': e3.a || 'D', 't': e3.t}, {'c': e2.c + late + CASE WHEN must OR r <> 'a' THEN 1000000000 ELSE 0 END, 'a': e2.a || 'K', 't': list_append(e2.t, role || ':' || text)}, {'c': e2.c + 2 + late + CASE WHEN must THEN 1000000000 ELSE 0 END, 'a': e2.a || 'R', 't': list_append(e2.t, 'assistant:' || text)}) END
 FROM (SELECT *, least(w3, {'c': e2.c + 2, 'a': e2.a || 'I', 't': list_append(e2.t, 'assistant:')}) AS e3 FROM (SELECT *, least(w2, {'c': e0.c + 2, 'a': e0.a || 'I', 't': list_append(e0.t, 'user:')}, {'c': e1.c + 2, 'a': e1.a || 'I', 't': list_append(e1.t, 'user:')}, {'c': w3.c + 2, 'a': w3.a || 'I', 't': list_append(w3.t, 'user:')}) AS e2 FROM
  (SELECT s.conv_id, s.i + 1 AS i, s0 AS e0, s1 AS e1, s2 AS w2, s3 AS w3, s.i = z.n AS end_here, coalesce(g.blank OR g.duplicate, true) AS must, coalesce(g.truncated, false)::BIGINT AS late, g.r, g.role, g.text FROM s JOIN z ON z.conv_id IS NOT DISTINCT FROM s.conv_id LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM s.conv_id AND g.i = s.i + 1 WHERE s.i <= z.n)))),
b AS (SELECT s.conv_id, least(s0, s3) AS x FROM s JOIN z ON z.conv_id IS NOT DISTINCT FROM s.conv_id WHERE s.i = z.n + 1)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(x.c, 0) AS cost, coalesce(x.a, '') AS audit, sha256(coalesce(array_to_string(x.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM c.conv_id"""
