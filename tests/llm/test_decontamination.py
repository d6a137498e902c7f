import random

from chatterlake.llm import decontamination
from cases import frame, near_copies, row, words
from test_near_dedup import shingles

ITEM_SCHEMA = "item_id long, text string, doc_id long, n long"


def made(seed=6):
    rng = random.Random(seed)
    rows = [list(r) for r in near_copies(seed)]
    items = [(i, " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) + str(rng.randint(0, 50)) for _ in range(rng.randint(1, 60))), 1, 1) for i in range(25)]
    items += [(90, items[3][1], 1, 1), (91, None, 1, 1), (92, "", 1, 1), (93, "one two", 1, 1), (None, items[4][1], 1, 1)]
    for r in rows[::2]:
        w = words(items[rng.randrange(25)][1])
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = "changed"
        r[1] = " ".join([r[1] or "", *w, "tail words"])
    return [tuple(r) for r in rows] + [row(None, items[0][1]), row(5, None)], items


def brute(rows, items):
    found = set()
    for i, text, *_ in items:
        want = shingles(text)
        for r in rows:
            shared = len(want & shingles(r[1]))
            if want and i is not None and r[0] is not None and 100 * shared >= 80 * len(want):
                found.add((r[0], i, shared, len(want)))
    return found


def test_equals_brute_force(spark):
    rows, items = made()
    got = decontamination.leaks(frame(spark, rows), spark.createDataFrame(items, ITEM_SCHEMA)).collect()
    want = brute(rows, items)
    assert len(want) > 5 and sorted(map(tuple, got)) == sorted(want)


def test_many_items_are_joined(spark, monkeypatch):
    rows, items = made(8)
    monkeypatch.setattr(decontamination, "PROBE_HASHES", 10)
    monkeypatch.setattr(decontamination, "BROADCAST_IDS", 1)
    got = decontamination.leaks(frame(spark, rows), spark.createDataFrame(items, ITEM_SCHEMA)).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, items))


def test_no_rows(spark):
    rows, items = made()
    none = spark.createDataFrame([], ITEM_SCHEMA)
    assert decontamination.leaks(frame(spark, rows), none).collect() == []
    assert decontamination.leaks(frame(spark, []), spark.createDataFrame(items, ITEM_SCHEMA)).collect() == []
    assert decontamination.without_leaks(frame(spark, rows), none).count() == len(rows)


def test_kept_rows_are_whole(spark):
    rows, items = made()
    gone = {r[0] for r in brute(rows, items)}
    got = decontamination.without_leaks(frame(spark, rows), spark.createDataFrame(items, ITEM_SCHEMA))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(r) for r in rows if r[0] not in gone)
