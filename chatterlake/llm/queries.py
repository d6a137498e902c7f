"""The registered queries of the corpus operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatterlake.llm import (
    decontamination,
    importance,
    line_dedup,
    mixing,
    near_dedup,
    ngram_model,
    quality_rules,
    repeats,
    sharding,
    token_output,
    vector_codes,
    vector_dedup,
    warc,
)
from chatterlake.llm.storage import new_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
N_SHARDS = 40
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def token_files(docs: DataFrame) -> DataFrame:
    """Writes the documents' ids, reads the files back, and sums each document's ids up."""
    path = new_folder(docs.sparkSession, "tokens")
    token_output.write_tokens(docs, path, VOCABULARY)
    found = token_output.read_tokens(docs.sparkSession, path)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op1_huffman_token_files(spark, sf_dir):
    return token_files(table(spark, sf_dir, "documents"))


@query
def op2_line_first_rules(spark, sf_dir):
    return quality_rules.quality(table(spark, sf_dir, "documents"))


def trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents labelled as good and harmless."""
    return table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0").select("doc_id")


@query
def op3_kneser_ney_quality(spark, sf_dir):
    return ngram_model.judged(table(spark, sf_dir, "documents"), trusted(spark, sf_dir))


@query
def op4_rendezvous_sharding(spark, sf_dir):
    even = {s: 1.0 for s in range(N_SHARDS + 1)}
    now = {s: w for s, w in even.items() if s < N_SHARDS}
    return sharding.assign(table(spark, sf_dir, "documents"), now, even)


@query
def op5_similar_lines(spark, sf_dir):
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


@query
def op6_warc_by_index(spark, sf_dir):
    index = warc.write_archives(table(spark, sf_dir, "pages"), new_folder(spark, "archives"))
    return warc.read_archives(index).select(
        F.col("key").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to"
    )


@query
def op7_minhash_containment(spark, sf_dir):
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op8_repeated_passages(spark, sf_dir):
    found = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


@query
def op9_mix_sources(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).drop("copies")


@query
def op10_setsketch_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op11_trie_vector_codes(spark, sf_dir):
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


@query
def op12_multi_index_near_vectors(spark, sf_dir):
    return vector_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


@query
def op13_importance_resampling(spark, sf_dir):
    return importance.draw(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# --- SQL --------------------------------------------------------------------------------------
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


def _shingles(table: str, key: str) -> str:
    words = WORDS.format(LOWER)
    return f"""SELECT DISTINCT {key}, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle
        FROM (SELECT {key}, {words} AS w FROM {table})"""


ORACLES["op6_warc_by_index"] = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS best FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
    CASE WHEN payload_bytes >= 1000 AND page_id <> best THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 1000 AND page_id <> best THEN best END AS refers_to
FROM m
"""

ORACLES["op7_minhash_containment"] = f"""
WITH d AS ({_shingles("documents", "doc_id")}),
b AS ({_shingles("benchmark", "item_id")}),
s AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY ALL),
m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN b USING (shingle) GROUP BY ALL)
SELECT doc_id, item_id, n_shared, n_item FROM m JOIN s USING (item_id) WHERE 100 * n_shared >= 80 * n_item
"""

ORACLES["op9_mix_sources"] = r"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM s),
o AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
    sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS sharing,
    sum(source_size) OVER () AS total FROM w),
f AS (SELECT *, CAST(cap AS DOUBLE) < CAST(weight * (total - capped) AS DOUBLE) / CAST(sharing AS DOUBLE) AS above FROM o),
g AS (SELECT *, min(capped) FILTER (NOT above) OVER () AS c, max(sharing) FILTER (NOT above) OVER () AS u FROM f),
t AS (SELECT source, source_size, CASE WHEN above THEN CAST(cap AS DOUBLE) ELSE CAST(weight * (total - c) AS DOUBLE) / CAST(u AS DOUBLE) END AS target FROM g),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies FROM t),
r AS (SELECT doc_id, size, source_size, target, copies, target - copies * source_size AS budget,
    sum(size) OVER (PARTITION BY p.source ORDER BY h) AS upto,
    sum(size) OVER (PARTITION BY p.source, h) AS here
    FROM sized JOIN p ON sized.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(size * (copies + CASE
    WHEN upto <= budget THEN 1 WHEN upto - here <= budget AND here - (budget - (upto - here)) < budget - (upto - here) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""

ORACLES["op10_setsketch_near_dedup"] = f"""
WITH RECURSIVE d AS ({_shingles("documents", "doc_id")}),
n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY ALL),
m AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM d x JOIN d y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM m JOIN n p ON a = p.doc_id JOIN n q ON b = q.doc_id WHERE 100 * shared >= 85 * (p.n + q.n - shared)),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS least_b FROM r GROUP BY a)
SELECT documents.doc_id, coalesce(n.n, 0) AS n_shingles, least(documents.doc_id, coalesce(c.least_b, documents.doc_id)) AS component_id,
    documents.doc_id = least(documents.doc_id, coalesce(c.least_b, documents.doc_id)) AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c ON documents.doc_id = c.a
"""


def _vector_codes_sql(rounds: int = 6) -> str:
    """Each round as two tables: the nearest entry of every part, and the entries moved to their means."""
    parts = """kept AS (SELECT vec_id, label, embedding AS v FROM embeddings WHERE embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    parts AS MATERIALIZED (SELECT vec_id, label, CAST((i - 1) // 8 AS INT) AS p, CAST((i - 1) % 8 AS INT) AS d, CAST(floor(4096 * CAST(v[i] AS DOUBLE)) AS BIGINT) AS x
        FROM (SELECT vec_id, label, v, unnest(range(1, 65)) AS i FROM kept)),
    seeds AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT 16),
    b0 AS MATERIALIZED (SELECT p, e, d, x FROM parts JOIN seeds USING (vec_id))"""
    nearest = """a{r} AS MATERIALIZED (SELECT vec_id, p, min(dist) AS dist, arg_min(e, dist * 16 + e) AS e FROM
        (SELECT vec_id, p, e, sum((parts.x - b{r}.x) * (parts.x - b{r}.x)) AS dist FROM parts JOIN b{r} USING (p, d) GROUP BY ALL) GROUP BY ALL)"""
    moved = """b{n} AS MATERIALIZED (SELECT p, e, d, coalesce(m.x, b{r}.x) AS x FROM b{r} LEFT JOIN
        (SELECT p, e, d, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS x
            FROM parts JOIN a{r} USING (vec_id, p) GROUP BY ALL) m USING (p, e, d))"""
    steps = [parts] + [s.format(r=r, n=r + 1) for r in range(rounds) for s in (nearest, moved)] + [nearest.format(r=rounds)]
    return f"""WITH {", ".join(steps)},
    coded AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(dist) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id),
    named AS (SELECT vec_id, label, code, error FROM coded JOIN kept USING (vec_id))
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
        (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, d)) FROM b{rounds}) AS codebooks_sha256 FROM named"""


ORACLES["op11_trie_vector_codes"] = _vector_codes_sql()

ORACLES["op12_multi_index_near_vectors"] = """
WITH RECURSIVE u AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
    WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
e AS (SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.label = y.label AND len(x.v) = len(y.v) AND x.vec_id <> y.vec_id
    WHERE list_cosine_similarity(x.v, y.v) >= 0.98),
n AS (SELECT a, count(*) AS n FROM e GROUP BY a),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS least_b FROM r GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(least_b, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(least_b, vec_id)) AS kept
FROM embeddings LEFT JOIN n ON vec_id = n.a LEFT JOIN c ON vec_id = c.a
"""

_CRC_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLES["op13_importance_resampling"] = f"""
WITH byte AS (SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce([CAST(b AS BIGINT)] || range(8), lambda c, k:
        CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) x(b))),
words AS (SELECT doc_id, {_CRC_WORDS} AS w FROM documents),
wanted AS (SELECT unnest({_CRC_WORDS}) AS f FROM benchmark),
per AS MATERIALIZED (SELECT doc_id, f, count(*) AS n FROM (SELECT doc_id, unnest(w) AS f FROM words) GROUP BY ALL),
hexed AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM per UNION SELECT f FROM wanted)),
buckets AS MATERIALIZED (SELECT f, xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(range(1, len(h), 2), lambda i: CAST(CAST('0x' || h[i:i + 1] AS INT) AS BIGINT)),
        lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) % 10000 AS bucket FROM hexed, byte),
s AS (SELECT bucket, CAST(sum(n) AS DOUBLE) AS n FROM per JOIN buckets USING (f) GROUP BY bucket),
t AS (SELECT bucket, CAST(count(*) AS DOUBLE) AS n FROM wanted JOIN buckets USING (f) GROUP BY bucket),
totals AS (SELECT (SELECT coalesce(sum(n), 0) FROM s) + 10000 AS s, (SELECT coalesce(sum(n), 0) FROM t) + 10000 AS t),
gain AS (SELECT s.bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1) * totals.s / ((s.n + 1) * totals.t))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket), totals),
weight AS (SELECT doc_id, CAST(sum(n * gain) AS BIGINT) AS weight FROM per JOIN buckets USING (f) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score
    FROM words LEFT JOIN weight USING (doc_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS k, count(*) FILTER (n_features >= 20) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND k <= 10 * n // 100 THEN k END AS rank FROM ranked
"""
