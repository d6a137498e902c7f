"""Quality by perplexity under an interpolated modified Kneser-Ney n-gram model of trusted text.

The model spells words: it predicts each byte of a word, and its end, from up to ``ORDER - 1`` bytes
before it in the word.  It gathers counts from all trusted texts; they and everything derived from
them are tables, dealt by n-gram: continuation counts come from the distinct n-grams of the next
order, contexts add up to totals and back-off weights, and the probability of every n-gram that any
document holds is found by joins from order 1 upwards.

To score documents, up to ``HOT_GRAMS`` of the most frequent n-grams go to the tasks as two sorted arrays;
they make up nearly all places of the texts and would be the hot keys of a join.  All other n-grams of a
document, with their counts, are joined to the table of probabilities, dealt by n-gram, and the costs are
summed up by document.  So texts are read once more, stay where they are, and memory is bounded, however
large the model grows.

An n-gram is one number: its length above five bytes of text, the last byte lowest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatterlake.llm import arrays
from chatterlake.llm.storage import stored

ORDER = 5
TEXT_BITS = 8 * ORDER
EDGE = 32  # stands before and after each word
SLICE_BYTES = 1 << 20  # of text at a time
HOT_GRAMS = 1 << 18  # of 16 bytes
_STEPS = 16  # classes of counts between a number and its double
TASK_GRAMS = 500_000  # counts that a task holds before it hands them on
BROADCAST_IDS = 1_000_000
PRIOR_SYMBOLS = 60  # symbols at the language's median that each text's own are averaged with
QUANTILE = 0.99  # of the held-out trusted texts about 1 in 100 is above a language's limits, and 1 below
PRIOR_TEXTS = 10  # held-out texts of all languages that a language's own are averaged with
WIDER = 5  # a limit from n texts, those included, lies 1 + WIDER / n times as far from the median as their quantile; 30 normal values need 1.14
HELD_OUT = 5  # of the trusted texts one in so many, by a hash of the key, sets limits instead of training


# --- n-grams of texts ---------------------------------------------------------------------------
def _distinct_words(words: arrays.Words) -> tuple[np.ndarray, np.ndarray]:
    """First place of each distinct word, and each word's number among them."""
    _, first, which = np.unique(words.hashes(), return_index=True, return_inverse=True)
    return first, which


def _grams(words: arrays.Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The longest n-gram at each byte of the chosen words and at their ends; each word's bounds among them."""
    starts, lengths = words.starts[which], words.ends[which] - words.starts[which]
    counts = lengths + 1
    bounds = np.concatenate([[0], np.cumsum(counts)])
    nth = np.arange(bounds[-1]) - np.repeat(bounds[:-1], counts)  # 0: the word's first byte
    start, length = np.repeat(starts, counts), np.repeat(lengths, counts)
    data = np.append(words.data, np.uint8(EDGE)) if len(words.data) else np.full(1, EDGE, np.uint8)
    key = np.zeros(bounds[-1], np.int64)
    for back in range(ORDER - 1, -1, -1):
        at = nth - back
        inside = (at >= 0) & (at < length)
        byte = np.where(inside, data[np.where(inside, start + at, 0)], EDGE)
        key = np.where(at >= -1, (key << 8) | byte, key)
    return key + (np.minimum(nth + 2, ORDER) << TEXT_BITS), bounds


def _add_up(keys: np.ndarray, *counts: np.ndarray) -> list[np.ndarray]:
    keys, which = np.unique(keys, return_inverse=True)
    return [keys, *[np.bincount(which, weights=c, minlength=len(keys)).astype(np.int64) for c in counts]]


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    for batch in batches:
        for part in arrays.slices(batch, "text", SLICE_BYTES):
            words = arrays.split_words(part.column("text"))
            first, which = _distinct_words(words)
            trusted = np.repeat(np.array(part.column("trusted").to_pylist(), bool), np.diff(words.bounds))
            times = np.bincount(which, weights=trusted, minlength=len(first))
            all_times = np.bincount(which, minlength=len(first))
            keys, bounds = _grams(words, first)
            each = lambda x: np.repeat(x, np.diff(bounds))
            found = _add_up(keys, each(times), each(all_times))
            held = _add_up(*[np.append(a, b) for a, b in zip(held, found)]) if held else found
            if len(held[0]) > TASK_GRAMS:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], ["gram", "n", "places"])
                held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], ["gram", "n", "places"])


def _score_batches(hot):
    """(id, gram, n, cost): a text's cost by hot n-grams, with no gram and its symbols as n, and its other n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, cost = hot.value
        rows = lambda *columns: pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["id", "gram", "n", "cost"])
        for batch in batches:
            for part in arrays.slices(batch, "text", SLICE_BYTES):
                words = arrays.split_words(part.column("text"))
                first, which = _distinct_words(words)
                keys, bounds = _grams(words, first)
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                there = known[at] == keys
                found = np.concatenate([[0], np.cumsum(np.where(there, cost[at], 0.0))])
                of_word = (found[bounds[1:]] - found[bounds[:-1]])[which]
                sums = np.concatenate([[0], np.cumsum(of_word)])
                symbols = np.concatenate([[0], np.cumsum(words.ends - words.starts + 1)])
                texts = lambda x: x[words.bounds[1:]] - x[words.bounds[:-1]]
                ids = part.column("id").to_numpy()
                yield rows(ids, pa.nulls(len(ids), pa.int64()), texts(symbols), texts(sums))
                # the other n-grams: of each distinct word, then of each text that has the word
                others = np.concatenate([[0], np.cumsum(~there)])
                n_others = others[bounds[1:]] - others[bounds[:-1]]
                rare = np.flatnonzero(n_others[which])
                if len(rare):
                    grams, n = keys[~there], n_others[which[rare]]
                    text = np.repeat(np.searchsorted(words.bounds, rare, "right") - 1, n)
                    start = others[bounds[:-1]][which[rare]]
                    gram = grams[np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                    order = np.lexsort((gram, text))
                    text, gram = text[order], gram[order]
                    new = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (gram[1:] != gram[:-1])]))
                    yield rows(ids[text[new]], gram[new], np.diff(np.append(new, len(gram))), np.zeros(len(new)))

    return run


# --- the model ----------------------------------------------------------------------------------
def _length(gram: Column | str) -> Column:
    return F.shiftright(gram, TEXT_BITS).cast("int")


def _suffix(gram: Column | str) -> Column:
    """Without its first byte."""
    gram = F.col(gram) if isinstance(gram, str) else gram
    shorter = _length(gram) - 1
    return gram.bitwiseAND(_mask(shorter)) + shorter.cast("long") * F.lit(1 << TEXT_BITS)


def _mask(length: Column) -> Column:
    masks = F.array(*[F.lit((1 << 8 * n) - 1) for n in range(ORDER + 1)])
    return F.get(masks, length)


def _context(gram: Column | str) -> Column:
    """Without its last byte."""
    gram = F.col(gram) if isinstance(gram, str) else gram
    text = F.shiftright(gram.bitwiseAND(F.lit((1 << TEXT_BITS) - 1)), 8)
    return text + (_length(gram) - 1).cast("long") * F.lit(1 << TEXT_BITS)


def kneser_ney_counts(counts: DataFrame) -> DataFrame:
    """(gram, c) of all orders: counts where nothing can stand before, else the bytes seen before.

    ``counts``: (gram, n) of the longest n-grams at each place; the shorter ones begin with the edge.
    """
    seen = counts.where("n > 0").select("gram", F.col("n").alias("c"))
    whole = seen.where(_length("gram") == ORDER)
    orders = [whole]
    for n in range(ORDER - 1, 0, -1):
        before = orders[-1].groupBy(_suffix("gram").alias("gram")).agg(F.count("*").alias("c"))
        orders.append(stored(before.union(seen.where(_length("gram") == n)), f"counts-{n}"))
    out = orders[0]
    for order in orders[1:]:
        out = out.union(order)
    return out


def discounts(grams: DataFrame) -> dict[int, tuple[float, float, float]]:
    """Per order what is taken off counts of 1, 2, and 3 or more."""
    wanted = [F.count(F.when(F.col("c") == k, 1)).alias(f"n{k}") for k in range(1, 5)]
    rows = {r.order: r for r in grams.groupBy(_length("gram").alias("order")).agg(*wanted).collect()}
    out = {}
    for order, r in rows.items():
        n = [r.n1, r.n2, r.n3, r.n4]
        if 0 in n:  # too little text for the estimate
            out[order] = (0.5, 1.0, 1.5)
            continue
        y = n[0] / (n[0] + 2 * n[1])
        out[order] = tuple(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), float(k)) for k in (1, 2, 3))
    return out


def probabilities(grams: DataFrame, asked: DataFrame) -> DataFrame:
    """(gram, p) of each n-gram in ``asked``, interpolated over all shorter ones."""
    taken = discounts(grams)
    per_order = lambda k: F.get(F.array(*[F.lit(taken.get(n, (0.5, 1.0, 1.5))[k - 1]) for n in range(ORDER + 1)]), _length("gram"))
    off = F.when(F.col("c") == 1, per_order(1)).when(F.col("c") == 2, per_order(2)).otherwise(per_order(3))
    seen = grams.select("gram", "c", off.alias("off"))
    contexts = seen.groupBy(_context("gram").alias("context")).agg(F.sum("c").alias("total"), F.sum("off").alias("left"))
    contexts = stored(contexts, "contexts")
    own = stored(seen.select("gram", (F.col("c") - F.col("off")).alias("own")), "own")
    lower = None
    found = []
    for n in range(1, ORDER + 1):
        here = asked.where(_length("gram") == n).select("gram", "longest", _context("gram").alias("context"), _suffix("gram").alias("shorter"))
        here = here.join(own.where(_length("gram") == n), "gram", "left").join(contexts.where(_length("context") == n - 1), "context", "left")
        here = here.withColumn("p", F.lit(1 / 256)) if lower is None else here.join(lower, "shorter")
        p = (F.coalesce("own", F.lit(0.0)) + F.col("left") * F.col("p")) / F.col("total")
        level = stored(here.select("gram", "longest", F.coalesce(p, "p").alias("p")), f"p-{n}")
        lower = level.select(F.col("gram").alias("shorter"), "p")
        found.append(level.where("longest").select("gram", "p"))
    out = found[0]
    for level in found[1:]:
        out = out.union(level)
    return out


def _asked(counts: DataFrame) -> DataFrame:
    """The n-grams of all documents and all their ends; ``longest`` marks those that documents are scored by."""
    gram, length = F.col("gram"), _length("gram")
    end = lambda n: F.when(length > n, gram.bitwiseAND(F.lit((1 << 8 * n) - 1)) + F.lit(n << TEXT_BITS))
    ends = [F.struct(end(n).alias("gram"), F.lit(False).alias("longest")) for n in range(1, ORDER)]
    ends.append(F.struct(gram.alias("gram"), F.lit(True).alias("longest")))
    every = counts.select(F.inline(F.array(*ends))).where("gram IS NOT NULL")
    return every.groupBy("gram").agg(F.bool_or("longest").alias("longest"))


def costs(docs: DataFrame) -> DataFrame:
    """(id, cost, symbols) by id: minus log probability of the whole text, and what it is made of.

    ``docs``: id, text, trusted.  The model is that of the trusted rows.
    """
    spark = docs.sparkSession
    counts = docs.select("text", "trusted").mapInArrow(_count_batches, "gram long, n long, places long")
    counts = stored(counts.groupBy("gram").agg(F.sum("n").alias("n"), F.sum("places").alias("places")), "gram-counts")
    grams = stored(kneser_ney_counts(counts.select("gram", "n")), "grams")
    model = probabilities(grams, stored(_asked(counts.select("gram", "n")), "asked"))
    model = stored(model.select("gram", (-F.log("p")).alias("cost")), "probabilities")
    hot = _hot(counts, model)
    table = spark.sparkContext.broadcast(hot if len(hot[0]) else (np.full(1, -1), np.zeros(1)))
    scored = docs.select("id", "text").mapInArrow(_score_batches(table), "id long, gram long, n long, cost double")
    scored = stored(scored, "scores")
    table.destroy()
    rare = scored.where("gram IS NOT NULL").select("id", "gram", "n").join(model, "gram")
    rare = rare.select("id", (F.col("n") * F.col("cost")).alias("cost"), F.lit(0).cast("long").alias("symbols"))
    whole = scored.where("gram IS NULL").select("id", "cost", F.col("n").alias("symbols"))
    return stored(whole.union(rare).groupBy("id").agg(F.sum("cost").alias("cost"), F.sum("symbols").alias("symbols")), "costs")


def _hot(counts: DataFrame, model: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """n-grams in rising order and their costs: as many of the most frequent ones, by class of count, as ``HOT_GRAMS`` holds."""
    size = F.floor(F.log2(F.col("places").cast("double")) * _STEPS)
    sizes = counts.groupBy(size.alias("size")).agg(F.count("*").alias("n")).collect()  # some hundred rows
    held, least = 0, None
    for row in sorted(sizes, key=lambda r: -r["size"]):
        held += row["n"]
        if held > HOT_GRAMS:
            break
        least = row["size"]
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0)
    found = counts.where(size >= least).select("gram").join(model, "gram").select("gram", "cost").toArrow()
    order = np.argsort(found["gram"].to_numpy())
    return found["gram"].to_numpy()[order], found["cost"].to_numpy()[order]


# --- the verdict --------------------------------------------------------------------------------
def judged(
    docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
    quantile: float = QUANTILE,
) -> DataFrame:
    """key, lang, n_symbols, perplexity, limit, kept: one row per distinct key of ``docs``.

    ``trusted``: the keys of the trusted documents, under the same name.  Most train the model, the
    others set each language's limits: the upper and lower ``quantile`` of their rates.  A text outside
    them is rejected.  Short texts say little, so each rate, also those that set the limits, is averaged
    with ``PRIOR_SYMBOLS`` symbols at the language's median.  One rule holds for any number of texts: a
    language's median and quantiles, from its n held-out texts, are averaged with those of all texts at
    weights n and ``PRIOR_TEXTS``, and as the quantile of few texts lies too near, its distance from the
    median is taken ``1 + WIDER / (n + PRIOR_TEXTS)`` times.  With many texts this is the language's own
    quantile; a language without any has the limits of all.  Null is a language of its own.

    Texts without words, null ones too, cannot be judged and are kept, with no perplexity; so are all
    texts if nothing is trusted.  Rows that share a key count as one document, and those without a
    key are left out.  Other columns are not read; no rows give no rows.
    """
    ids = stored(trusted.select(F.col(key).cast("long").alias("id")).where("id IS NOT NULL").distinct(), "trusted")
    known = ids.withColumn("trains", F.pmod(F.xxhash64("id"), F.lit(HELD_OUT)) > 0)
    known = F.broadcast(known) if ids.count() <= BROADCAST_IDS else known
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where("id IS NOT NULL")
    rows = rows.join(known, "id", "left").select("id", "text", F.coalesce("trains", F.lit(False)).alias("trusted"))
    found = costs(rows).join(known, "id", "left")
    langs = docs.select(F.col(key).cast("long").alias("id"), F.col(lang).alias("lang")).where("id IS NOT NULL")
    found = found.join(langs.groupBy("id").agg(F.min("lang").alias("lang")), "id")
    found = stored(found.withColumn("rate", F.when(F.col("symbols") > 0, F.col("cost") / F.col("symbols"))), "rates")

    base = found.where("NOT trains AND rate IS NOT NULL")
    places = lambda c, *at: F.percentile_approx(c, list(at), 10_000)
    averaged = lambda middle: (F.col("cost") + PRIOR_SYMBOLS * middle) / (F.col("symbols") + PRIOR_SYMBOLS)
    row = base.agg(F.percentile_approx("rate", 0.5, 10_000).alias("middle")).first()
    general = None
    if row["middle"] is not None:
        general = [row["middle"], *base.agg(places(averaged(F.lit(row["middle"])), 1 - quantile, quantile)).first()[0]]
    mixed = lambda own, i: (F.col("n") * own + PRIOR_TEXTS * F.lit(general[i])) / (F.col("n") + PRIOR_TEXTS)
    no_limit = F.lit(None).cast("array<double>")
    limits = base.groupBy("lang").agg(F.percentile_approx("rate", 0.5, 10_000).alias("own"), F.count("*").alias("n"))
    limits = limits.select(F.col("lang").alias("__lang"), "n", (mixed(F.col("own"), 0) if general else F.lit(0.0)).alias("middle"))
    limits = stored(limits, "medians")
    own_median = F.col("lang").eqNullSafe(F.col("__lang"))
    tails = base.join(F.broadcast(limits), own_median).groupBy("__lang", "middle", "n")
    tails = stored(tails.agg(places(averaged(F.col("middle")), 1 - quantile, quantile).alias("q")), "limits")

    def widened(low: Column, middle: Column, high: Column, n: Column) -> Column:
        factor = 1 + WIDER / (n + PRIOR_TEXTS)
        return F.array(middle + factor * (low - middle), middle, middle + factor * (high - middle))

    if general:
        own = widened(mixed(F.get("q", 0), 1), F.col("middle"), mixed(F.get("q", 1), 2), F.col("n"))
        no_limit = widened(*[F.lit(general[i]) for i in (1, 0, 2)], F.lit(0))
        tails = tails.select("__lang", own.alias("own"))
    else:
        tails = tails.select("__lang", no_limit.alias("own"))
    out = found.join(F.broadcast(tails), own_median, "left").withColumn("q", F.coalesce("own", no_limit))
    low, middle, high = (F.get("q", i) for i in range(3))
    rate = averaged(middle)
    inside = (rate <= high) & (rate >= low)
    return out.select(
        F.col("id").alias(key),
        F.col("lang").alias(lang),
        F.col("symbols").alias("n_symbols"),
        F.exp("rate").alias("perplexity"),
        F.exp(high).alias("limit"),
        F.coalesce(inside, F.lit(True)).alias("kept"),
    )


def accepted(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns; rows without a key stay."""
    gone = stored(judged(docs, trusted, key, text, lang).where("NOT kept").select(F.col(key).alias("__gone")), "rejected")
    there = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(there, F.col(key) == F.col("__gone"), "left_anti")
