import random

import pytest

from chatterlake.llm import identity, line_dedup
from cases import frame, near_copies, row, words


def brute(rows):
    lines = sorted((r[0], i, frozenset(words(x))) for r in rows for i, x in enumerate((r[1] or "").split("\n")))
    lines = [x for x in lines if x[2]]
    out = {r[0]: (0, []) for r in rows}
    for k, (key, number, s) in enumerate(lines):
        n, gone = out[key]
        hit = any(100 * len(s & t) >= 80 * len(s | t) for *_, t in lines[:k])
        out[key] = (n + 1, gone + [number] if hit else gone)
    return {(k, n, len(gone), tuple(gone)) for k, (n, gone) in out.items()}


def made(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") * rng.randint(1, 3) + (str(rng.randint(0, 300)) if rng.random() < 0.6 else "")
    pool = [[word() for _ in range(rng.randint(1, 40))] for _ in range(60)]
    texts = []
    for _ in range(70):
        lines = []
        for _ in range(rng.randint(0, 7)):
            line = list(rng.choice(pool))
            for _ in range(rng.randint(0, 3)):
                line[rng.randrange(len(line))] = word()
            lines.append(rng.choice([" ", "  "]).join(line))
            if rng.random() < 0.2:
                lines.append(rng.choice(["", " ", "\t"]))
        texts.append("\n".join(lines))
    texts += [None, "", "\n\n", "a", "a a\nb", "word " * 3000]
    rng.shuffle(texts)
    return [row(i * 2 - 20, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("hot, at_once, buckets", [(2_000, 200_000, 1 << 19), (3, 40, 64)])
def test_equals_brute_force(spark, monkeypatch, hot, at_once, buckets):
    for name, value in (("HOT_LIST", hot), ("HOT_CELL", 4), ("ROWS_AT_ONCE", at_once), ("PAIRS_AT_ONCE", at_once), ("BUCKETS", buckets), ("BROADCAST_IDS", hot)):
        monkeypatch.setattr(line_dedup, name, value)
    rows = made(31 + hot)
    got = line_dedup.dedup_lines(frame(spark, rows))
    assert {(r.doc_id, r.n_lines, r.n_removed, tuple(r.removed)) for r in got.collect()} == brute(rows)


def test_lines_are_cut_out(spark):
    rows = [row(1, "one two three\nfour"), row(2, "x\n\none  two three\n y "), row(3, "four"), row(4, None)]
    docs = frame(spark, rows)
    kept = line_dedup.without_lines(docs, line_dedup.dedup_lines(docs))
    assert kept.columns == docs.columns
    assert {r.doc_id: r.text for r in kept.collect()} == {1: rows[0][1], 2: "x\n\n y ", 3: "", 4: None}


def test_no_rows_and_odd_keys(spark):
    assert line_dedup.dedup_lines(frame(spark, [])).collect() == []
    rows = [row(None, "a b"), row(None, None), row(5, "a b\nc"), row(5, "a b\nc"), row(5, None)]
    got = sorted((r.doc_id or 0, r.n_lines, list(r.removed)) for r in line_dedup.dedup_lines(frame(spark, rows)).collect())
    assert got == [(0, 0, []), (0, 0, []), (5, 0, []), (5, 2, []), (5, 2, [])]


@pytest.mark.parametrize("hot, rows_at_once", [(500_000, 200_000), (0, 40)])
def test_rows_that_share_a_key(spark, monkeypatch, hot, rows_at_once):
    """Each row loses its own repeated lines only; of similar lines in rows of one key one stays."""
    monkeypatch.setattr(identity, "BROADCAST_ROWS", hot)
    monkeypatch.setattr(line_dedup, "ROWS_AT_ONCE", rows_at_once)
    one, two = "p q r s t", "u v w x y"
    rows = [row(1, one), row(2, f"{one}\nleft alone here\n{one}"), row(2, "only in this row\nand this one"), row(2, None), row(None, one)]
    rows += [row(3, f"{two}\nx1"), row(3, f"x2\n{two} z"), row(3, f"x2\n{two} z"), row(4, f"{two}\nx3")]
    docs = frame(spark, rows)
    found = line_dedup.dedup_lines(docs)
    assert found.count() == len(rows)
    kept = line_dedup.without_lines(docs, found)
    assert kept.columns == docs.columns
    texts = sorted((r.doc_id or 0, r.text or "") for r in kept.collect())
    assert texts[:6] == [(0, one), (1, one), (2, ""), (2, "left alone here"), (2, "only in this row\nand this one"), (3, texts[5][1])]
    threes = [t for k, t in texts if k == 3]
    assert threes in ([f"x2\n{two} z"] * 2 + ["x1"], ["x1"] + [f"x2\n{two} z"] * 2, ["x2", "x2", f"{two}\nx1"], [f"{two}\nx1", "x2", "x2"])
    assert texts[-1] == (4, "x3")


def stored_tables(monkeypatch):
    seen = []

    def keep(df, name, store=line_dedup.stored):
        seen.append((name, store(df, name)))
        return seen[-1][1]

    monkeypatch.setattr(line_dedup, "stored", keep)
    return seen


def test_no_texts_are_stored(spark, monkeypatch):
    seen = stored_tables(monkeypatch)
    rows = made(5)
    got = line_dedup.dedup_lines(frame(spark, rows))
    assert {(r.doc_id, r.n_lines, r.n_removed, tuple(r.removed)) for r in got.collect()} == brute(rows)
    assert seen and not [name for name, table in seen if "text" in table.columns]


def test_long_lines_that_share_one_rare_word_are_not_compared(spark, monkeypatch):
    """The picture does not fill up with the words of a long line."""
    seen = stored_tables(monkeypatch)
    rng = random.Random(9)
    lines = [rng.sample([f"w{i}" for i in range(600)], 100) + [f"rare{k // 2}"] for k in range(60)]
    rows = [row(k, " ".join(line)) for k, line in enumerate(lines)] + [row(99, " ".join(lines[7][1:]))]
    found = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert [k for k, n in found.items() if n] == [99]
    assert sum(table.count() for name, table in seen if name == "meetings") < 10


def test_a_word_of_many_lines_is_not_copied_for_each_block(spark, monkeypatch):
    for name, value in (("HOT_LIST", 3), ("HOT_CELL", 4)):
        monkeypatch.setattr(line_dedup, name, value)
    asked = []
    dealt = line_dedup._dealt
    monkeypatch.setattr(line_dedup, "_dealt", lambda hot, counts, every: asked.append((hot.count(), dealt(hot, counts, every).count())) or dealt(hot, counts, every))
    base = [f"w{i}" for i in range(20)]
    rows = [row(k, " ".join([*base[: k % 20], f"x{k % 7}", *base[k % 20 + 1 :]])) for k in range(200)]
    got = line_dedup.dedup_lines(frame(spark, rows))
    assert {(r.doc_id, r.n_lines, r.n_removed, tuple(r.removed)) for r in got.collect()} == brute(rows)
    assert asked[0][0] == asked[0][1] > 200
