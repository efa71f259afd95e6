"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .byte_bpe import round_trip
from .common import table
from .decontam import contamination
from .html_text import page_text
from .lexical import ranked
from .lm_scoring import lm_scores
from .order_minhash import fingerprints as order_fingerprints
from .packing import pack
from .pii import personal_data
from .resampling import resampled
from .simhash import near_duplicates
from .substring_dedup import without_repeats
from .token_counts import token_counts
from .toxicity import toxicity


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("k_id", "k_text")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text(table(spark, sf_dir, "pages"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_fingerprints(table(spark, sf_dir, "documents"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id::varchar AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
w AS (SELECT DISTINCT item, n, array_to_string(ws[i:i + n - 1], ' ') AS win FROM (SELECT item, ws, least(len(ws), 10) AS n, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM b WHERE len(ws) > 0)),
p AS (SELECT r, i, n, array_to_string(ws[i:i + n - 1], ' ') AS win FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM d) JOIN (SELECT DISTINCT n FROM w) ON i + n - 1 <= len(ws)),
h AS (SELECT DISTINCT r, i, n, item FROM p JOIN w USING (win, n)),
c AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM h) GROUP BY r),
k AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM h GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN c USING (r) LEFT JOIN k USING (r)
"""

OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT r, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM d WHERE len(ws) >= 35)),
g AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS j FROM w SEMI JOIN (SELECT h FROM w GROUP BY h HAVING count(*) > 1) USING (h)),
n AS (SELECT r, count(*) AS n_removed FROM g GROUP BY r),
k AS (SELECT r, string_agg(x, ' ' ORDER BY j) AS kept FROM (SELECT r, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS j FROM d) ANTI JOIN g USING (r, j) GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN n USING (r) LEFT JOIN k USING (r)
"""


#: CRC-32 over a list of bytes, by a table that its rule gives.
OP11_SQL = r"""
WITH RECURSIVE t AS (SELECT b, 0 AS k, b::bigint AS c FROM range(256) r(b) UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM t WHERE k < 8),
tab AS MATERIALIZED (SELECT list(c ORDER BY b) AS l FROM t WHERE k = 8),
x AS (SELECT row_number() OVER () AS r, doc_id AS id, text, false AS target FROM documents UNION ALL SELECT -row_number() OVER (), item_id, text, true FROM benchmark),
w AS (SELECT r, target, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM x),
f AS (SELECT r, target, unnest(ws) AS f FROM w UNION ALL SELECT r, target, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM w),
n AS (SELECT r, target, f, count(*) AS n FROM f GROUP BY ALL),
b AS MATERIALIZED (SELECT f, xor(list_reduce(list_transform(range(1, len(hex(f)), 2), lambda i: ('0x' || substr(hex(f), i, 2))::bigint), lambda c, y: xor(c >> 8, l[(xor(c, y) & 255) + 1]), 4294967295::bigint), 4294967295) % 10000 AS b FROM (SELECT DISTINCT f FROM n), tab),
c AS (SELECT b, sum(n) FILTER (NOT target) AS s, sum(n) FILTER (target) AS t FROM n JOIN b USING (f) GROUP BY b),
g AS (SELECT b, floor(1000 * ln((coalesce(t, 0) + 1)::double * ((SELECT sum(s) FROM c) + 10000)::double / ((coalesce(s, 0) + 1)::double * ((SELECT sum(t) FROM c) + 10000)::double)))::bigint AS gain FROM c),
m AS (SELECT r, sum(n)::bigint AS n_features, floor(sum(n * gain)::double / sum(n))::bigint AS weight FROM n JOIN b USING (f) JOIN g USING (b) WHERE NOT target GROUP BY r),
d AS (SELECT x.r, x.id AS doc_id, len(ws) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(x.id::varchar, '')), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint AS score FROM x JOIN w USING (r) LEFT JOIN m USING (r) WHERE NOT x.target),
k AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM d WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT 25 * count(*) // 100 FROM k) THEN rank END AS rank FROM d LEFT JOIN k USING (r)
"""


OP13_SQL = r"""
WITH x AS (SELECT row_number() OVER () AS r, doc_id AS id, text, false AS item FROM documents UNION ALL SELECT -row_number() OVER (), item_id, text, true FROM benchmark),
w AS (SELECT r, id, item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM x),
q AS (SELECT r AS i, t, count(*) AS k FROM (SELECT r, unnest(ws) AS t FROM w WHERE item) GROUP BY ALL),
d AS (SELECT r, id AS doc_id, len(ws) AS n FROM w WHERE NOT item AND len(ws) > 0),
c AS (SELECT count(*) AS nn, sum(n) AS l FROM d),
tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ws) AS t FROM w WHERE NOT item) SEMI JOIN q USING (t) GROUP BY ALL),
wt AS (SELECT t, floor(1000 * ln((2 * nn + 2)::double / (2 * df + 1)::double))::bigint AS w FROM (SELECT t, count(*) AS df FROM tf GROUP BY t), c),
im AS (SELECT r, doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * nn) // l)::bigint))) AS s FROM tf JOIN d USING (r) JOIN wt USING (t), c),
s AS (SELECT i, r, doc_id, sum(k * s)::bigint AS score FROM q JOIN im USING (t) GROUP BY ALL),
k AS (SELECT i, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT w.id AS item_id, rank::int AS rank, doc_id, score FROM k JOIN w ON w.r = i WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    """The other operators depend on tokenizers, XXH64 or trained models, which SQL does not have; tests/llm holds them against
    brute force."""
    return {"op2_decontamination": OP2_SQL, "op4_substring_dedup": OP4_SQL, "op11_resampling": OP11_SQL, "op13_lexical_search": OP13_SQL}
