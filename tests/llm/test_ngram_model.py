import math
import random
from collections import Counter, defaultdict

import pytest

from chatterlake.llm import ngram_model as m
from cases import frame, near_copies, row, words


def model(texts):
    """Interpolated modified Kneser-Ney over the bytes of words, written down as defined."""
    seqs = [b" " + w.encode() + b" " for t in texts for w in words(t)]
    raw = Counter()
    for s in seqs:
        for i in range(1, len(s)):
            raw[s[max(0, i - 4) : i + 1]] += 1
    counts = {g: c for g, c in raw.items() if len(g) == 5}
    level = dict(counts)
    for n in range(4, 0, -1):
        before = defaultdict(set)
        for g in level:
            before[g[1:]].add(g[:1])
        level = {g: len(b) for g, b in before.items()} | {g: c for g, c in raw.items() if len(g) == n}
        counts |= level
    off = {}
    for n in range(1, 6):
        k = [sum(1 for g, c in counts.items() if len(g) == n and c == j) for j in range(1, 5)]
        y = k[0] / (k[0] + 2 * k[1]) if k[0] else 0
        off[n] = (0.5, 1.0, 1.5) if 0 in k else tuple(min(max(j - (j + 1) * y * k[j] / k[j - 1], 0.05), j) for j in (1, 2, 3))
    total, left = Counter(), Counter()
    for g, c in counts.items():
        total[g[:-1]] += c
        left[g[:-1]] += off[len(g)][min(c, 3) - 1]

    def p(g):
        lower = p(g[1:]) if len(g) > 1 else 1 / 256
        h = g[:-1]
        if h not in total:
            return lower
        own = counts[g] - off[len(g)][min(counts[g], 3) - 1] if g in counts else 0
        return (own + left[h] * lower) / total[h]

    return p


def cost(p, text):
    seqs = [b" " + w.encode() + b" " for w in words(text)]
    return sum(-math.log(p(s[max(0, i - 4) : i + 1])) for s in seqs for i in range(1, len(s))), sum(len(s) - 1 for s in seqs)


@pytest.mark.parametrize("shard", [10**6, 300, 0])
def test_costs_equal_the_definition(spark, monkeypatch, shard):
    monkeypatch.setattr(m, "HOT_GRAMS", shard)
    monkeypatch.setattr(m, "TASK_GRAMS", 500)
    rows = near_copies(13)[:60] + [row(9001, "zz Zürich 世界 zz!"), row(9002, None), row(9003, "a")]
    trusted = {r[0] for r in rows if r[0] % 2}
    p = model([r[1] for r in rows if r[0] in trusted])
    docs = spark.createDataFrame([(r[0], r[1], r[0] in trusted) for r in rows], "id long, text string, trusted boolean")
    got = {r.id: (r.cost, r.symbols) for r in m.costs(docs.repartition(3)).collect()}
    assert len(got) == len(rows)
    for r in rows:
        want = cost(p, r[1])
        assert got[r[0]][1] == want[1] and got[r[0]][0] == pytest.approx(want[0], rel=1e-9)


def language(seed):
    rng = random.Random(seed)
    parts = ["".join(rng.choice("abcdefghijklmnop") for _ in range(3)) for _ in range(25)]
    return lambda n: " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n)) + "."


def test_held_out_quality(spark):
    rng, speak = random.Random(3), language(1)
    good = [(i, speak(rng.randint(30, 90)), "en") for i in range(300)]
    noise = lambda: " ".join("".join(rng.choice("QXZ#|$%&jkvw") for _ in range(6)) for _ in range(60))
    bad = [(1000 + i, noise() if i % 2 else speak(60).upper(), "en") for i in range(60)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string, lang string")
    trusted = docs.where("doc_id < 150").select("doc_id")
    got = {r.doc_id: r.kept for r in m.judged(docs, trusted).collect()}
    assert sum(not got[i] for i, *_ in bad) == len(bad)
    assert sum(got[i] for i, *_ in good[150:]) >= 0.97 * 150
    kept = m.accepted(docs, trusted)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, k in got.items() if k}


def test_limits_are_the_quantiles_of_each_language(spark):
    """Texts with an odd word in four are far outside the clean texts, though no plain noise."""
    rng, tongues = random.Random(9), {"en": language(4), None: language(5)}
    odd = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    good = [(i, tongues[g](rng.randint(30, 90)), g) for i, g in enumerate(["en", None] * 450)]
    bad = [(2000 + i, " ".join(odd() if rng.random() < 0.25 else w for w in tongues[g](60).split(" ")), g) for i, g in enumerate(["en", None] * 30)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string, lang string")
    rows = m.judged(docs, docs.where("doc_id < 700").select("doc_id")).collect()
    kept = {r.doc_id: r.kept for r in rows}
    assert sum(not kept[i] for i, *_ in bad) >= 0.9 * len(bad)
    assert sum(kept[i] for i, *_ in good[700:]) >= 0.9 * 200
    limits = {r.lang: r.limit for r in rows}
    assert len({(r.lang, r.limit) for r in rows}) == 2
    for g in tongues:  # a quantile is within the texts
        assert limits[g] <= max(r.perplexity for r in rows if r.lang == g and r.doc_id < 900)


def test_odd_rows(spark):
    rows = near_copies(14) + [row(None, "no key"), row(7, "twice"), row(7, "twice")]
    docs = frame(spark, rows)
    got = m.judged(docs, docs.select("doc_id").limit(0)).collect()
    assert len(got) == len({r[0] for r in rows} - {None}) and all(r.kept for r in got)
    assert all((r.perplexity is None) == (r.n_symbols == 0) for r in got)
    assert m.accepted(docs, docs.select("doc_id")).count() > 0
    assert m.judged(frame(spark, []), docs.select("doc_id")).collect() == []
