import hashlib
import math
import zlib
from collections import defaultdict

from chatterlake.llm import sharding
from cases import frame, near_copies, row


def best(key, weights):
    text = "" if key is None else str(key)

    def draw(s):
        n = int(hashlib.md5(f"{text}:{s}".encode()).hexdigest()[:15], 16)
        return -math.log((n + 0.5) / 2**60) / weights[s]

    return min(weights, key=draw)


def test_equals_brute_force(spark):
    rows = near_copies(5) + [row(None, None), row(None, "x"), row(1, "again")]
    now, grown = {s: 1.0 for s in range(8)}, {s: 1.0 for s in range(9)}
    got = sharding.assign(frame(spark, rows), now, grown).collect()
    want = sorted(
        repr((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode()), "key", best(r[0], now), best(r[0], grown)))
        for r in rows
    )
    assert sorted(repr((r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.grown_shard)) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 8)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_slots_over_many_cells(spark):
    df = spark.range(5000).selectExpr("id as doc_id", "0 as shard")
    got = sharding.numbered(df, "doc_id", per_cell=50).collect()
    assert sorted(r.slot for r in got) == list(range(5000))


def test_reruns_agree_where_keys_repeat(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES_AT_ONCE", 7)
    monkeypatch.setattr(sharding, "ROWS_PER_CELL", 5)
    rows = [row(None, f"text {i % 40}") for i in range(60)] + [row(5, "copy")] * 100 + [row(i, "x" * (i % 3)) for i in range(50)]
    weights = {0: 1.0, 1: 1.0}
    runs = []
    for pieces in (1, 7):
        got = sharding.assign(frame(spark, rows).repartition(pieces), weights).collect()
        assert len(got) == len(rows)
        for s in weights:
            here = sorted(r.slot for r in got if r.shard == s)
            assert here == list(range(len(here)))
        runs.append({(r.shard, r.slot): (r.doc_id, r.text_crc32) for r in got})
    assert runs[0] == runs[1]


def test_weights_and_no_rows(spark):
    df = spark.range(20000).select(sharding.shard_of("id", {0: 1.0, 1: 3.0, 2: 0.0}).alias("s"))
    n = {r.s: r["count"] for r in df.groupBy("s").count().collect()}
    assert set(n) == {0, 1} and 2.8 < n[1] / n[0] < 3.2
    assert sharding.assign(frame(spark, []), {0: 1.0}).collect() == []
