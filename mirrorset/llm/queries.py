"""Registered queries of the training-data operators, with check SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorset.llm import (fingerprints, host_rules, languages, lm_scores, mixing, near_copies, neighbours, pieces, prefix_trie, quality, spelling, surrogates,
                           token_files)
from mirrorset.llm.common import documents
from mirrorset.runtime import scratch_path

#: Key of the registered query only; whoever uses the operators brings an own secret.
TEST_KEY = "key of the test tables"

QUERIES: dict = {}
#: SQL with a row per document, over documents alone; and other SQL.
ORACLES: dict[str, str] = {}
OTHER_ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def sql(name: str, text: str, per_document: bool = True) -> None:
    (ORACLES if per_document else OTHER_ORACLES)[name] = text


@query
def op10_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies.near_groups(documents(spark, sf_dir)).select(
        "doc_id", near_copies.hex_fingerprint().alias("fingerprint"), "component_id")


@query
def op9_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.quality_verdicts(documents(spark, sf_dir)).select(
        "doc_id", *host_rules.FACTS, "base_failed", "kept")


sql("op9_host_rules", r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
win AS (SELECT r, i, array_to_string(words[i:i + 7], ' ') AS k FROM w, unnest(range(1, len(words) - 6)) AS t(i)),
twice AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, k) AS n FROM win) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT i + j) AS n FROM twice, range(0, 8) AS t(j) GROUP BY r),
lines AS (SELECT r, l FROM d, unnest(string_split(text, chr(10))) AS t(l) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
dup AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM lines GROUP BY r),
f AS (SELECT w.doc_id, w.source, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words
      FROM w LEFT JOIN cov USING (r) LEFT JOIN dup USING (r)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f),
h AS (SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS failed FROM b GROUP BY source),
s AS (SELECT sum(n) AS t, sum(failed) / sum(n) AS m, count(*) AS hosts, sum(failed * failed / n) AS square FROM h),
v AS (SELECT t, m, CASE WHEN m * (1 - m) > 0 THEN (square - t * m * m - (hosts - 1) * m * (1 - m)) / t ELSE 0 END AS spread FROM s),
p AS (SELECT m, CASE WHEN spread > 0 THEN least(t, greatest(m * (1 - m) / spread - 1, 1)) ELSE t END AS k FROM v),
e AS (SELECT source, n + k AS size, (failed + m * k) / (n + k) AS rate FROM h, p),
bad AS (SELECT source FROM e WHERE rate - 2 * sqrt(rate * (1 - rate) / (size + 1)) > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.source IS NOT DISTINCT FROM b.source) AS kept
FROM b
""")


@query
def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(documents(spark, sf_dir)).select(
        "doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


sql("op3_mix_sources", r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
        left(md5(concat('20240229|', coalesce(doc_id::VARCHAR, ''), '|', coalesce(text, ''))), 16) AS h FROM documents),
g AS (SELECT source, sum(size)::DOUBLE AS size, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM d GROUP BY source),
q AS (SELECT source, size, CASE (rk - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS wt FROM g),
o AS (SELECT *, 3 * size / wt AS ratio, row_number() OVER (ORDER BY 3 * size / wt, source NULLS LAST) AS k FROM q),
c AS (SELECT *, (sum(size) OVER () - coalesce(3 * sum(size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(wt) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
l AS (SELECT level, k FROM c WHERE level <= ratio ORDER BY k LIMIT 1),
t AS (SELECT source, size, CASE WHEN c.k < l.k THEN 3 * size ELSE l.level * wt END AS target FROM c, l),
f AS (SELECT *, least(floor(target + 0.5)::BIGINT, 3 * size::BIGINT) AS flow FROM t),
x AS (SELECT d.*, f.size::BIGINT AS source_size, f.target, f.flow // greatest(f.size::BIGINT, 1) AS full_, f.flow % greatest(f.size::BIGINT, 1) AS rest,
        sum(d.size) OVER (PARTITION BY d.source ORDER BY h, doc_id) AS upto FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, size, source_size, round(target, 6) AS target,
  (size * (full_ + CASE WHEN rest > 0 AND 2 * upto - size <= 2 * rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM x
""")


@query
def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    token_files.write_token_files(documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_token_files(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edited(documents(spark, sf_dir))


@query
def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores.score_texts(documents(spark, sf_dir))


@query
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query
def op6_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.identify(documents(spark, sf_dir))


@query
def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text and the text that they decode to."""
    return pieces.encode_pieces(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), decoded=True)


@query
def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.surrogate_texts(documents(spark, sf_dir), TEST_KEY)


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return prefix_trie.prefix_trie(prefix_trie.conversation_paths(turns, every=5, shared=prefix_trie.shared_turns))


sql("op11_prefix_trie", r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, md5(concat(strlen(role), ':', role, ':', text))) AS turns FROM t GROUP BY conv_id),
b AS (SELECT conv_id, turns, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT) AS bytes FROM o),
h AS (SELECT conv_id, turns, xor(list_reduce(flatten(list_transform(bytes, lambda x: [x, 0, 0, 0, 0, 0, 0, 0])),
        lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1)), 4294967295::BIGINT), 4294967295::BIGINT) % 9 AS h FROM b),
r AS (SELECT h.conv_id, list_concat(coalesce(l.turns, [])[1:h.h], h.turns[h.h + 1:]) AS turns FROM h LEFT JOIN o AS l ON l.conv_id = h.conv_id - h.conv_id % 5),
p AS (SELECT conv_id, d, len(turns) AS size, md5(turns[1:d]::VARCHAR) AS k, CASE WHEN d > 0 THEN md5(turns[1:d - 1]::VARCHAR) END AS up,
        CASE WHEN d > 0 THEN strlen(turns[d].t) ELSE 0 END AS bytes FROM r, unnest(range(0, len(turns) + 1)) AS x(d)),
n AS (SELECT d, k, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS saved,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE size = d), '')) AS ends_sha256 FROM p GROUP BY d, k),
c AS (SELECT d - 1 AS d, up AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c USING (d, k)),
below AS (SELECT q.d, q.k, sum(f.saved) AS saved_tokens, sum((f.n_children = 0)::INT) AS n_leaves
        FROM f JOIN p AS own ON own.conv_id = f.conv_id AND own.k = f.k AND own.d = f.d JOIN p AS q ON q.conv_id = f.conv_id AND q.d <= f.d GROUP BY q.d, q.k)
SELECT f.conv_id, f.d AS depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, below.n_leaves::BIGINT AS n_leaves,
  below.saved_tokens::BIGINT AS saved_tokens, f.ends_sha256
FROM f JOIN below USING (d, k) LEFT JOIN f AS u ON u.d = f.d - 1 AND u.k = f.up
""", per_document=False)


@query
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_forms(documents(spark, sf_dir))


sql("op13_spelling", r"""
WITH RECURSIVE tab AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY i) AS t
        FROM range(0, 256) AS r(i)),
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
d AS (SELECT doc_id, run, count(*) AS n, hex(encode(doc_id || ':' || run)) AS hx FROM runs GROUP BY doc_id, run),
h AS (SELECT run, n, 4294967295 - list_reduce(list_concat([4294967295::BIGINT], list_transform(range(0, len(hx) // 2),
        lambda i: ('0x' || hx[2 * i + 1:2 * i + 2])::BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])) AS h FROM d, tab),
s AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n FROM s WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cut AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM v, range(0, length(word)) AS r(i)),
pairs AS (SELECT DISTINCT a.word, b.word AS mate, b.n AS mate_n FROM cut AS a JOIN cut AS b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
        UNION SELECT DISTINCT a.word, v.word, v.n FROM cut AS a JOIN v ON a.rest = v.word UNION SELECT DISTINCT v.word, a.word, a.n FROM cut AS a JOIN v ON a.rest = v.word),
best AS (SELECT word, count(*) AS n_near, arg_min(mate, (-mate_n, mate)) AS mate, max(mate_n) AS mate_n FROM pairs GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN mate_n >= 2 * v.n THEN mate END AS form, CASE WHEN mate_n >= 2 * v.n THEN mate_n END AS form_n
        FROM v LEFT JOIN best USING (word)),
chain AS (SELECT word, form AS at FROM f WHERE form IS NOT NULL UNION ALL SELECT chain.word, f.form FROM chain JOIN f ON f.word = chain.at WHERE f.form IS NOT NULL),
last AS (SELECT chain.word, chain.at AS root FROM chain JOIN f ON f.word = chain.at WHERE f.form IS NULL)
SELECT f.word, form, coalesce(root, f.word) AS root, n, n_near, form_n FROM f LEFT JOIN last ON last.word = f.word
""", per_document=False)


@query
def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)
