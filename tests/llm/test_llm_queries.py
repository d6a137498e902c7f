"""The registered queries over whole given tables, against their SQL or against brute force."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from chatterlake.llm import mixing, ngram_model, queries
from check_queries import connect, rows_of
import test_line_dedup
import test_ngram_model
import test_repeats
import test_sharding
import test_token_output
from test_quality_rules import base as base_counts, words


@pytest.fixture(scope="module")
def docs(sf_dir):
    return [tuple(r.values()) for r in pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text", "source", "lang"]).to_pylist()]


def collected(spark, sf_dir, name):
    return queries.QUERIES[name](spark, sf_dir).collect()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    cursor = connect(sf_dir).execute(queries.ORACLES[name])
    want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == want and want[1]


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_token_files(spark, sf_dir, docs):
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in collected(spark, sf_dir, "op1_huffman_token_files")}
    at, want = 0, {}
    for (key, *_), ids in zip(sorted(docs), test_token_output.whole([t for _, t, *_ in sorted(docs)])):
        want[key] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert got == want


def test_quality_rules(spark, sf_dir, docs):
    got = collected(spark, sf_dir, "op2_line_first_rules")
    assert {tuple(r[:7]) for r in got} == {(k, *base_counts(t)) for k, t, *_ in docs}
    labels = {r["doc_id"]: r for r in pq.read_table(f"{sf_dir}/labels.parquet").to_pylist()}
    of = {r.doc_id: r for r in got}
    assert all(of[k].kept or of[k].base_failed for k, x in labels.items() if x["quality"] == 1 and k in of)
    assert not any(of[k].kept for k, x in labels.items() if x["quality"] == 0 and k in of)


def test_perplexities(spark, sf_dir, docs):
    got = {r.doc_id: r for r in collected(spark, sf_dir, "op3_kneser_ney_quality")}
    trusted = [r.doc_id for r in queries.trusted(spark, sf_dir).collect()]
    held = spark.createDataFrame([(i,) for i in trusted], "id long").selectExpr("id", f"pmod(xxhash64(id), {ngram_model.HELD_OUT}) > 0 AS trains")
    trains = {r.id for r in held.where("trains").collect()}
    p = test_ngram_model.model([t for k, t, *_ in docs if k in trains])
    assert len(got) == len(docs)
    for key, text, *_ in docs[:60]:
        cost, n = test_ngram_model.cost(p, text)
        assert got[key].n_symbols == n and got[key].perplexity == pytest.approx(math.exp(cost / n))


def test_shards(spark, sf_dir, docs):
    got = collected(spark, sf_dir, "op4_rendezvous_sharding")
    now, grown = {s: 1.0 for s in range(40)}, {s: 1.0 for s in range(41)}
    want = {(k, len(t.encode()) + 16, zlib.crc32(t.encode()), test_sharding.best(k, now), test_sharding.best(k, grown)) for k, t, *_ in docs}
    assert {(r.doc_id, r.size, r.text_crc32, r.shard, r.grown_shard) for r in got} == want
    for shard, n in Counter(r.shard for r in got).items():
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(n))


def test_lines(spark, sf_dir, docs):
    got = {(r.doc_id, r.n_lines, r.n_removed, tuple(r.removed)) for r in collected(spark, sf_dir, "op5_similar_lines")}
    assert got == test_line_dedup.brute(docs)


def test_passages(spark, sf_dir, docs):
    got = {repr((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in collected(spark, sf_dir, "op8_repeated_passages")}
    want = set()
    for line in test_repeats.brute(docs):
        key, n, removed, spans, kept = eval(line)
        want.add(repr((key, n, removed, len(spans), hashlib.sha256(kept).hexdigest())))
    assert got == want


def test_mix_takes_whole_words(spark, sf_dir, docs):
    got = collected(spark, sf_dir, "op9_mix_sources")
    assert sum(r.size for r in got) == sum(len(words(t)) for _, t, *_ in docs)
    assert mixing.MOST_REPEATS == 3 and all(r.taken <= 3 * r.size for r in got)
