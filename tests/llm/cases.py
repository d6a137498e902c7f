"""Documents with nulls, empty and long texts, ties, copies, and columns with awkward names."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, lang string, a string, id long, size long, shard string, component string"


def words(text):
    return WORD.findall(text or "")


def row(doc_id, text, source="s"):
    return (doc_id, text, source, "en", "x", 5, 7, "s", "c")


def near_copies(seed=1, n=40, groups=6):
    """Random texts, and copies of some with a few words changed."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5)))
    texts = [[word() for _ in range(rng.randint(1, 120))] for _ in range(n)]
    for g in range(groups):
        base = [word() for _ in range(rng.randint(60, 250))]
        for _ in range(rng.randint(2, 12)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(copy)
    texts = [" ".join(t) for t in texts]
    texts += [None, "", " \n\t", None, "one two", "one  two", "ONE TWO", "é É", texts[0], texts[0].upper(), "x " * 30_000]
    rng.shuffle(texts)
    return [row(i * 3 + 1, t, rng.choice(["a", "b", None, "é", "Z"])) for i, t in enumerate(texts)]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)
