"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

Texts are lower-cased and cut into words of letters and digits. At each word of a document, each fixed
mask hashes the words it selects and ignores the others, so a seed still hits when ignored words were
substituted. Seeds of documents are joined with those of benchmark items. A hit fixes how the item lies on the document;
alignments are made distinct, and then the two word sequences are compared once for each, position by position, in time
linear in the item: the pair counts if in some stretch of ``window`` words (or the whole item, if shorter) at least
``share`` of the words agree. Items of fewer than ``EXACT`` words must agree as a whole.

Masks by the words of an item: up to 9, one for every choice of words that may differ, so nothing that counts is missed;
10 to 13, ``MIDDLE``; from 14, ``MASKS``. With as many random substitutions as ``share`` allows the last two find 0.99 and 0.97
of the alignments at least (the worst lengths, 10 and 14 words); fewer substitutions are missed more rarely.

The seeds of the benchmark are broadcast in blocks of about ``BLOCK_SEEDS`` rows, dealt by their hash, so a long item
is spread over blocks; a larger benchmark takes more passes, never a larger broadcast. Texts are not shuffled, but for one copy of
each different text with a hit. Equal texts are compared once.

Defined cases: null or empty texts hit nothing; a text of any length costs time and memory in proportion to its words;
repeated rows and rows that share a doc_id or item_id give one pair for each two ids; null doc_ids and item_ids are left out of the pairs,
but rows with them are checked like all others by clean(); empty tables give an empty result; extra columns, of any name, are kept by clean().
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.tables import checked, content_key, drop_rows
from tidegraph.session import Scratch

#: Masks; 1 is hashed, 0 ignored.
MASKS = ("11111", "1110011", "10100111", "1011000011")
MIDDLE = ("1111", "11011", "101101", "1100101", "10010011", "1010001011")
#: Items from so many words use MASKS, and from so many MIDDLE.
LONG, SHORT = 14, 10
#: Items of fewer words are looked for without substitutions.
EXACT = 6
BLOCK_SEEDS = 500_000
WINDOW, SHARE = 20, 0.7


def words(text: str = "text") -> Column:
    plain = F.trim(F.regexp_replace(F.lower(F.col(text)), "[^\\p{L}\\p{N}]+", " "))
    return F.filter(F.split(F.coalesce(plain, F.lit("")), " "), lambda w: w != "")


def word_hashes(text: str = "text") -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def needed(n: int, window: int = WINDOW, share: float = SHARE) -> int:
    """Words that must agree in the best stretch of an item of n words."""
    return n if n < EXACT else math.ceil(share * min(n, window) - 1e-9)


def placed(n: int, share: float = SHARE) -> list[tuple[str, int]]:
    """(mask, its first word in the item) of a short item: every choice of the words that may differ, without ignored ends."""
    free, out = n - needed(n, n, share), []
    for gone in combinations(range(n), free):
        mask = "".join("0" if i in gone else "1" for i in range(n))
        out.append((mask.strip("0"), n - len(mask.lstrip("0"))))
    return sorted(set(out))


def seed_plan(lengths: list[int], share: float = SHARE) -> dict[str, Column]:
    """The masks that items of these lengths need (LONG stands for all longer ones), and where an item (n, pos) has a seed of each."""
    n, pos, out = F.col("n"), F.col("pos"), {}

    def allow(mask: str, where: Column) -> None:
        out[mask] = out[mask] | where if mask in out else where

    for length in sorted(lengths):
        if length >= LONG:
            for m in MASKS:
                allow(m, n >= LONG)
        elif length >= SHORT:
            for m in MIDDLE:
                allow(m, n == length)
        else:
            for m, at in placed(length, share):
                allow(m, (n == length) & (pos == at))
    return out


def _positions(df: DataFrame, span: int) -> DataFrame:
    """A row for each word: columns of df but h, pos, and s with the span hashes that start there as c0, c1, .. (null beyond the end)."""
    shifted = [F.col("h").alias("c0")] + [F.slice("h", k + 1, F.greatest(F.size("h"), F.lit(1))).alias(f"c{k}") for k in range(1, span)]
    return df.select(*(c for c in df.columns if c != "h"), F.posexplode(F.arrays_zip(*shifted)).alias("pos", "s"))


def _seed(mask: str) -> Column:
    picked = [F.col(f"s.c{i}") for i, m in enumerate(mask) if m == "1"]
    return F.when(picked[-1].isNotNull(), F.xxhash64(F.lit(mask), *picked))


def seeds(df: DataFrame, masks: dict[str, Column | None]) -> DataFrame:
    """Columns of df but h, pos and seed: a row for each word and mask that fits, and where its condition holds."""
    each = [_seed(m) if where is None else F.when(where, _seed(m)) for m, where in masks.items()]
    at = _positions(df, max(map(len, masks)))
    return at.select(*(c for c in at.columns if c != "s"), F.explode(F.array(*each)).alias("seed")).where(F.col("seed").isNotNull())


def agreement(item: Column, region: Column, window: int) -> Column:
    """The most words that agree in a stretch of ``window`` aligned positions (all, if there are fewer); one pass."""
    same = F.zip_with(item, region, lambda a, b: F.coalesce((a == b).cast("int"), F.lit(0)))

    def slide(p: Column) -> Column:
        left = lambda i: F.when(i > window, F.element_at(p, F.greatest(i - window, F.lit(1)))).otherwise(0)
        total = lambda acc, i: acc["now"] + F.element_at(p, i) - left(i)
        step = lambda acc, i: F.struct(total(acc, i).alias("now"), F.greatest(acc["top"], total(acc, i)).alias("top"))
        return F.aggregate(F.sequence(F.lit(1), F.size(p)), F.struct(F.lit(0).alias("now"), F.lit(0).alias("top")), step, lambda acc: acc["top"])

    return F.transform(F.array(same), slide)[0]


def alignments(docs: DataFrame, seed_rows: DataFrame, masks: list[str]) -> DataFrame:
    """Distinct (k1, k2, ik, start): where a hit lays an item on a text. k1, k2: key of the text."""
    rows = docs.select(*content_key("text"), word_hashes().alias("h"))
    s = F.broadcast(seed_rows.select("ik", "item_pos", F.col("seed").alias("item_seed")))
    found = seeds(rows, dict.fromkeys(masks)).join(s, F.col("seed") == F.col("item_seed"))
    return found.select("k1", "k2", "ik", (F.col("pos") - F.col("item_pos")).alias("start")).distinct()


def matched(docs: DataFrame, bench: DataFrame, scratch: Scratch, window: int = WINDOW, share: float = SHARE) -> tuple[DataFrame, DataFrame]:
    """(k1, k2, ik, n_matched, n_item_words) of texts and items that overlap, the best of each pair; and items (item_id, ik)."""
    listed = bench.select(F.col("item_id").cast("long").alias("item_id"), word_hashes().alias("h")).where(F.size("h") > 0)
    listed = scratch.cut(listed.select("item_id", F.xxhash64("h").alias("ik"), "h"), "items")
    items = scratch.cut(listed.groupBy("ik").agg(F.first("h").alias("h")).withColumn("n", F.size("h")), "texts")
    lengths = [r.n for r in items.select(F.least("n", F.lit(LONG)).alias("n")).distinct().collect()]  # at most LONG rows
    plan, parts = seed_plan(lengths, share), []
    if plan:
        rows = scratch.cut(seeds(items, plan).select("ik", F.col("pos").alias("item_pos"), "seed"), "seeds")
        blocks = -(-rows.count() // BLOCK_SEEDS)
        parts = [alignments(docs, rows.where(F.pmod(F.hash("seed"), F.lit(blocks)) == b), list(plan)) for b in range(blocks)]
    if not parts:
        parts = [docs.select(*content_key("text"), F.lit(0).cast("long").alias("ik"), F.lit(0).alias("start")).limit(0)]
    starts = scratch.cut(reduce(DataFrame.unionByName, parts).distinct(), "starts")
    hit = starts.select(F.col("k1").alias("_1"), F.col("k2").alias("_2")).distinct()
    texts = docs.select(*content_key("text"), "text").join(checked(scratch.cut(hit, "hit")), (F.col("k1") == F.col("_1")) & (F.col("k2") == F.col("_2")), "left_semi")
    texts = texts.groupBy("k1", "k2").agg(F.first("text").alias("text")).select("k1", "k2", word_hashes().alias("h"))
    # the item would start at word ``start``; words before the text's first are missing
    on = starts.join(checked(items.select("ik", F.col("h").alias("item_h"), "n")), "ik").join(texts, ["k1", "k2"])
    missing = F.greatest(-F.col("start"), F.lit(0))
    region = F.concat(F.array_repeat(F.lit(None).cast("long"), missing), F.slice("h", F.greatest("start", F.lit(0)) + 1, F.col("n") - missing))
    got = on.select("k1", "k2", "ik", agreement(F.col("item_h"), region, window).alias("n_matched"), F.col("n").alias("n_item_words"))
    enough = F.when(F.col("n_item_words") < EXACT, F.col("n_item_words")).otherwise(F.ceil(F.lit(share) * F.least("n_item_words", F.lit(window)) - 1e-9))
    best = got.where(F.col("n_matched") >= enough).groupBy("k1", "k2", "ik").agg(F.max("n_matched").alias("n_matched"), F.max("n_item_words").alias("n_item_words"))
    best, items = scratch.cut(best, "matched"), scratch.cut(listed.select("item_id", "ik"), "ids")
    scratch.sweep(best, items)
    return best, items


def contaminated(docs: DataFrame, bench: DataFrame, scratch: Scratch, window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, n_matched, n_item_words): the best verified overlap of each pair."""
    found, items = matched(docs, bench, scratch, window, share)
    named = scratch.cut(found.join(checked(items.where("item_id is not null").distinct()), "ik").withColumnsRenamed({"k1": "_1", "k2": "_2"}), "named")
    ids = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), *content_key("text"))
    pairs = ids.join(checked(named), (F.col("k1") == F.col("_1")) & (F.col("k2") == F.col("_2")))
    best = pairs.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_matched", "n_item_words")).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.n_matched").alias("n_matched"), F.col("b.n_item_words").alias("n_item_words"))


def clean(docs: DataFrame, bench: DataFrame, scratch: Scratch, window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """Rows whose text has no verified overlap, with all their columns, whatever their ids."""
    gone = scratch.cut(matched(docs, bench, scratch, window, share)[0].select("k1", "k2").distinct(), "leaks")
    return drop_rows(docs, content_key("text"), gone)
