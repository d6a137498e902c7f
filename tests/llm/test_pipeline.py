"""The pipeline over small tables, stage by stage against brute force."""

import random
import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from chatterlake.llm import mixing, ngram_model
import test_decontamination
import test_near_dedup
import test_token_output


def tables(spark, folder):
    rng = random.Random(17)
    parts = ["".join(rng.choice("abcdefghij") for _ in range(3)) for _ in range(30)]
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 3)))
    text = lambda n: " ".join(word() for _ in range(n)) + "."
    items = [(i, text(rng.randint(8, 30))) for i in range(6)]
    texts = [text(rng.randint(20, 120)) for _ in range(160)]
    for i in range(12):
        copy = texts[i].split(" ")
        copy[rng.randrange(len(copy))] = word()
        texts.append(" ".join(copy))
    texts += [f"{text(30)} {items[i % 6][1]} {text(30)}" for i in range(10)]
    texts += ["# $ % | " * 40, "QXZ&|# " * 50, "ZZQ!! " * 60]
    docs = [(i * 2, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    labels = [(d[0], 1, 0) for d in docs[:150]] + [(d[0], 0, 0) for d in docs[-3:]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, items


def test_pipeline_equals_its_parts(spark, tmp_path):
    folder = str(tmp_path)
    docs, items = tables(spark, folder)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "near-duplicates", "decontamination", "mixing", "token output"]
    table = spark.read.parquet(f"{folder}/documents.parquet")

    judged = ngram_model.judged(table, corpus_pipeline.queries.trusted(spark, folder)).collect()
    kept = [d for d in docs if d[0] in {r.doc_id for r in judged if r.kept}]
    assert {d[0] for d in docs[-3:]}.isdisjoint(d[0] for d in kept) and len(kept) > 150
    stays = {i for i, _, _, first in test_near_dedup.brute(kept) if first}
    kept = [d for d in kept if d[0] in stays]
    leaks = {i for i, *_ in test_decontamination.brute(kept, items)}
    assert leaks
    kept = [d for d in kept if d[0] not in leaks]
    copies = {r.doc_id: r.copies for r in mixing.mix(spark.createDataFrame(kept, table.schema)).collect()}
    want = Counter()
    for d, ids in zip(kept, test_token_output.whole([d[1] for d in kept])):
        want[d[0], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += copies[d[0]]

    got = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == +want
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in ordered] == sorted(r.doc_id for r in got)

    for _, stage in corpus_pipeline.STAGES[:-1]:
        table = stage(spark, table, folder)
        assert table.columns == ["doc_id", "text", "lang", "source", "n_chars"]
