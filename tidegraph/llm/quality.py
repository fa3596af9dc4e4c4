"""Quality rules: base statistics and bands of n-gram perplexity.

The language model is a modified Kneser-Ney model of the characters of words (order 5, within word
boundaries), one for each declared language. Grams of every document are counted: each task counts
words, spells the distinct ones into 5-grams, and Spark sums the grams; continuation counts and discounts
come from grouped aggregation (grams that begin a word have no other context before them, so they keep their plain counts). The model
takes in all documents, those that fail the base rules too. Probabilities and back-off weights go to sorted hash arrays in the shared folder, which
workers memory-map; nothing that grows with the corpus is broadcast or sent to the driver.

A document is rejected if one of two measures is outside the band of its language: log perplexity (per character), and
the log of the nats per word, which shows symbols hung on words that the model knows too well to find them odd. A band is
the median plus or minus ``spread`` robust deviations (1.4826 times the median absolute deviation), with no fixed width.
Both are read off an exact histogram with bins of 0.001, where documents of equal score and number of words count once, so
copies do not narrow a band; if more than half still share the median's bin, the deviation is that of the others.

Defined cases: null text has no words and fails the base rules; a null or empty lang is the language "und"; a very long
text is measured whole, in a worker's memory; repeated rows are counted and scored each, and equal texts of a language share a verdict; an empty
table gives an empty result; extra columns, of any name, are kept by keep().
"""

from __future__ import annotations

import json
import math
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegraph.llm import caches, files
from tidegraph.llm.tables import checked, content_key, drop_rows
from tidegraph.session import Scratch

ORDER = 5
PAD, STOP = "\x02", "\x03"
WORDS_HELD = 300_000
WORDS_CACHED = 1 << 19
CHUNK_CHARS = 2 << 20
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SPREAD, BIN = 5.0, 0.001
_MUL = np.uint64(0x9E3779B97F4A7C15)


# --- base statistics ---------------------------------------------------------------------------


def base(text: str) -> tuple[list[bytes], int, int, int, int]:
    """Words, and word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at \x20 and \x09-\x0D only
    word_chars = len(text) - (len(raw) - len(raw.translate(None, b" \t\n\x0b\x0c\r")))
    symbols = len(raw) - len(raw.translate(None, b"#*$%&|<>"))
    lines = [x for x in raw.split(b"\n") if x.split(None, 1)]
    triples = list(zip(words, words[1:], words[2:]))  # noqa: B905
    repeat = 0
    if len(set(triples)) < len(triples):
        many, last = {t for t, n in Counter(triples).items() if n > 1}, -1
        for i, t in enumerate(triples):
            if t in many:
                repeat += i + 3 - max(i, last)
                last = i + 3
    return words, word_chars, symbols, len(lines) - len(set(lines)), repeat


def language() -> Column:
    """The declared language of a document."""
    return F.coalesce(F.nullif(F.col("lang"), F.lit("")), F.lit("und")).alias("lang")


# --- counting -----------------------------------------------------------------------------------


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n): occurrences of each 5-gram of word characters, over all documents."""

    def spell(held: dict[str, Counter]):
        import pyarrow as pa

        for lang, words in held.items():
            grams: Counter = Counter()
            for w, n in words.items():
                s = PAD * (ORDER - 1) + w.decode("utf-8", "replace") + STOP
                for i in range(len(s) - ORDER + 1):
                    grams[s[i : i + ORDER]] += n
            names = list(grams)
            for at in range(0, len(names), 50_000):
                part = names[at : at + 50_000]
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(part), "gram": part, "n": pa.array([grams[g] for g in part], pa.int64())})

    def count(batches):
        caches.claim("quality")
        held: dict[str, Counter] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if text:
                    held.setdefault(lang, Counter()).update(text.encode("utf-8", "surrogatepass").split())
                    if sum(map(len, held.values())) > WORDS_HELD:
                        largest = max(held, key=lambda k: len(held[k]))
                        yield from spell({largest: held.pop(largest)})
        yield from spell(held)

    rows = docs.select(language(), "text").mapInArrow(count, "lang string, gram string, n long")
    return rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def kneser_ney(grams: DataFrame, scratch: Scratch) -> DataFrame:
    """(kind, lang, gram, value): kind n holds the discounted probability of an n-gram, kind 10 + n the back-off weight of its context, kind 0 the uniform share."""
    level, parts = grams, []
    for n in range(ORDER, 0, -1):
        level = scratch.cut(level, f"level{n}")
        per = lambda k: F.sum(F.when(F.col("n") == k, 1).otherwise(0)).alias(f"n{k}")
        d = level.groupBy("lang").agg(*[per(k) for k in (1, 2, 3, 4)])
        y = F.col("n1") / F.greatest(F.col("n1") + 2 * F.col("n2"), F.lit(1))
        disc = lambda k, a, b: F.greatest(F.least(F.coalesce(k - (k + 1) * y * F.col(b) / F.when(F.col(a) > 0, F.col(a)), F.lit(0.5 * k)), F.lit(k - 0.05)), F.lit(0.05))
        d = d.select(F.col("lang").alias("_l"), disc(1, "n1", "n2").alias("d1"), disc(2, "n2", "n3").alias("d2"), disc(3, "n3", "n4").alias("d3"))
        d = checked(scratch.cut(d, f"discounts{n}"))
        rows = level.join(d, F.col("lang") == F.col("_l")).withColumn("cut", F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3")))
        rows = rows.withColumn("ctx", F.substring("gram", 1, n - 1))
        ctx = rows.groupBy("lang", "ctx").agg(F.sum("n").alias("total"), F.sum("cut").alias("held"), F.count("*").alias("types"))
        ctx = scratch.cut(ctx, f"contexts{n}")
        total = ctx.select(F.col("lang").alias("_lang"), F.col("ctx").alias("_ctx"), "total")
        prob = rows.join(total, (F.col("lang") == F.col("_lang")) & (F.col("ctx") == F.col("_ctx"))).select(F.lit(n).alias("kind"), "lang", "gram", ((F.col("n") - F.col("cut")) / F.col("total")).alias("value"))
        parts += [prob, ctx.select(F.lit(10 + n).alias("kind"), "lang", F.col("ctx").alias("gram"), (F.col("held") / F.col("total")).alias("value"))]
        if n == 1:
            parts.append(ctx.select(F.lit(0).alias("kind"), "lang", F.lit("").alias("gram"), (F.lit(1.0) / (F.col("types") + 1)).alias("value")))
        else:  # continuation counts: in how many contexts the shorter gram was seen
            # a gram that begins with the padding is always preceded by it: it keeps its plain count
            shorter = level.groupBy("lang", F.substring("gram", 2, n - 1).alias("gram")).agg(F.count("*").alias("seen"), F.sum("n").alias("n"))
            level = shorter.select("lang", "gram", F.when(F.substring("gram", 1, 1) == PAD, F.col("n")).otherwise(F.col("seen")).alias("n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- sorted hash arrays ---------------------------------------------------------------------------


def seed_of(kind: int, lang: str) -> np.uint64:
    import xxhash

    return np.uint64(xxhash.xxh64_intdigest(f"{kind}:{lang}"))


def fold(h, points):
    """One more character on a running hash; arrays or scalars."""
    with np.errstate(over="ignore"):
        h = (h ^ points) * _MUL
        return h ^ (h >> np.uint64(29))


def key_of(kind: int, lang: str, gram: str) -> int:
    h = np.array([seed_of(kind, lang)])
    for c in gram:
        h = fold(h, np.uint64(ord(c)))
    return int(h[0])


def store(model: DataFrame, scratch: Scratch) -> str:
    """Shards of (uint64 keys, float32 values), sorted by key across and within shards; returns the folder's URI."""
    root = scratch.path("arrays")

    def keyed(batches):
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            kinds, langs, grams, values = (b.column(i).to_pylist() for i in range(4))
            keys = np.zeros(len(kinds), np.uint64)
            groups: dict[tuple, list[int]] = {}
            for i, (k, la, g) in enumerate(zip(kinds, langs, grams, strict=True)):
                groups.setdefault((k, la, len(g)), []).append(i)
            for (k, la, n), at in groups.items():
                h = np.full(len(at), seed_of(k, la))
                if n:
                    pts = np.frombuffer("".join(grams[i] for i in at).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, n).astype(np.uint64)
                    for j in range(n):
                        h = fold(h, pts[:, j])
                keys[at] = h
            # Spark sorts signed longs; the flipped top bit keeps the unsigned order
            yield pa.RecordBatch.from_arrays([pa.array((keys ^ np.uint64(1 << 63)).view(np.int64)), pa.array(values, pa.float32())], names=["key", "value"])

    def put(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        keys, values = [], []
        for b in batches:
            keys.append(b.column(0).to_numpy())
            values.append(b.column(1).to_numpy(zero_copy_only=False))
        if not keys or not sum(map(len, keys)):
            return
        keys = np.concatenate(keys).view(np.uint64) ^ np.uint64(1 << 63)
        name = files.attempt_name("shard")
        with files.create(f"{root}/{name}.keys") as f:
            f.write(keys.astype("<u8").tobytes())
        with files.create(f"{root}/{name}.values") as f:
            f.write(np.concatenate(values).astype("<f4").tobytes())
        yield pa.RecordBatch.from_pydict({"pid": pa.array([TaskContext.get().partitionId()], pa.int32()), "name": [name], "first": pa.array([str(keys[0])])})

    rows = model.mapInArrow(keyed, "key long, value float").repartitionByRange("key").sortWithinPartitions("key")
    shards = scratch.cut(rows.mapInArrow(put, "pid int, name string, first string"), "shards").orderBy("pid").collect()
    with files.create(f"{root}/manifest.json") as f:
        f.write(json.dumps([[s["name"], int(s["first"])] for s in shards]).encode())
    return root


class Arrays:
    """Lookup in memory-mapped shards."""

    def __init__(self, root: str) -> None:
        listed = json.loads(files.read_bytes(f"{root}/manifest.json"))
        self.first = np.array([x[1] for x in listed], np.uint64)
        self.root, self.names, self.open = root, [x[0] for x in listed], {}

    def shard(self, i: int):
        if i not in self.open:
            at = f"{self.root}/{self.names[i]}"
            self.open[i] = [np.frombuffer(files.open_input(at + e).read_buffer(), t) for e, t in ((".keys", "<u8"), (".values", "<f4"))]
        return self.open[i]

    def get(self, keys: np.ndarray, default: float) -> np.ndarray:
        out = np.full(len(keys), default)
        if not self.names:
            return out
        where = np.searchsorted(self.first, keys, "right").astype(int) - 1
        for i in np.unique(where[where >= 0]):
            mine = np.flatnonzero(where == i)
            have, values = self.shard(i)
            at = np.searchsorted(have, keys[mine])
            at[at == len(have)] = 0
            hit = have[at] == keys[mine]
            out[mine[hit]] = values[at[hit]]
        return out


class Scorer:
    """Log probability of words, cached per language in a worker."""

    def __init__(self, root: str) -> None:
        self.arrays, self.cache = Arrays(root), {}

    def words(self, lang: str, words: set[bytes]) -> dict[bytes, float]:
        """The cache of a language, with these words in it."""
        cache = self.cache.setdefault(lang, {})
        if sum(map(len, self.cache.values())) > WORDS_CACHED:
            for c in self.cache.values():
                c.clear()
        new = list(words.difference(cache))
        for at in range(0, len(new), 50_000):
            part = new[at : at + 50_000]
            cache.update(zip(part, self.log_probs(lang, part), strict=True))
        return cache

    def log_probs(self, lang: str, words: list[bytes]) -> list[float]:
        texts = [PAD * (ORDER - 1) + w.decode("utf-8", "replace") + STOP for w in words]
        sizes = np.array([len(t) for t in texts])
        pts = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        starts = np.cumsum(sizes) - sizes
        # places of the characters to predict: all but the padding
        place = np.concatenate([np.arange(s + ORDER - 1, s + n) for s, n in zip(starts, sizes, strict=True)])
        cols = [pts[place - k] for k in range(ORDER - 1, -1, -1)]
        h = np.full(len(place), seed_of(ORDER, lang))
        for c in cols:
            h = fold(h, c)
        _, first, back = np.unique(h, return_index=True, return_inverse=True)  # words share most of their grams
        cols = [c[first] for c in cols]
        p = self.arrays.get(np.array([key_of(0, lang, "")], np.uint64), 1e-6)[0]
        prob = np.full(len(cols[0]), p)
        for n in range(1, ORDER + 1):
            h = np.full(len(cols[0]), seed_of(n, lang))
            c = np.full(len(cols[0]), seed_of(10 + n, lang))
            for j in range(ORDER - n, ORDER):
                h = fold(h, cols[j])
                if j < ORDER - 1:
                    c = fold(c, cols[j])
            prob = self.arrays.get(h, 0.0) + self.arrays.get(c, 1.0) * prob
        logs = np.log(np.maximum(prob, 1e-12))[back]
        ends = np.cumsum(sizes - ORDER + 1)
        sums = np.concatenate([[0.0], np.cumsum(logs)])
        return (sums[ends] - sums[ends - (sizes - ORDER + 1)]).tolist()


_scorers: dict[str, Scorer] = {}
caches.register("quality", _scorers.clear)


def scorer(root: str) -> Scorer:
    caches.claim("quality")
    if root not in _scorers:
        _scorers.clear()
        _scorers[root] = Scorer(root)
    return _scorers[root]


def measure(root: str, langs: list, texts: list) -> list[tuple]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, log_ppl of each text."""
    own, rows, start, chars = scorer(root), [], 0, 0
    for i, t in enumerate(texts):
        chars += len(t or "")
        if chars > CHUNK_CHARS or i == len(texts) - 1:
            rows += _measure(own, langs[start : i + 1], texts[start : i + 1])
            start, chars = i + 1, 0
    return rows


def _measure(own: Scorer, langs: list, texts: list) -> list[tuple]:
    based = [base(t or "") for t in texts]
    by: dict[str, list[int]] = {}
    for i, la in enumerate(langs):
        by.setdefault(la, []).append(i)
    score = [0.0] * len(texts)
    for la, at in by.items():
        cache = own.words(la, set().union(*(based[k][0] for k in at)))
        for k in at:
            words = based[k][0]
            score[k] = -math.fsum(map(cache.__getitem__, words)) / (based[k][1] + len(words)) if words else 0.0
    return [(len(words), chars, symbols, dup, repeat, s) for (words, chars, symbols, dup, repeat), s in zip(based, score, strict=True)]


def log_word(n_words: int, word_chars: int, log_ppl: float) -> float:
    """Log of the nats per word."""
    return math.log(max(log_ppl * (word_chars + n_words) / n_words, 1e-9)) if n_words else 0.0


def base_failed(n_words: int, repeat: int) -> bool:
    return n_words < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n_words


FIELDS = "doc_id long, k1 long, k2 long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log_ppl double, log_word double, base_failed boolean"


def train(docs: DataFrame, scratch: Scratch) -> str:
    return store(kneser_ney(gram_counts(docs), scratch), scratch)


def scores(docs: DataFrame, root: str) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for b in batches:
            langs = b.column("lang").to_pylist()
            got = list(zip(*measure(root, langs, b.column("text").to_pylist()), strict=True)) or [()] * 6
            failed = [base_failed(n, r) for n, r in zip(got[0], got[4], strict=True)]
            per_word = [log_word(n, c, s) for n, c, s in zip(got[0], got[1], got[5], strict=True)]
            ints = [pa.array(got[k], pa.int64()) for k in range(5)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("k1"), b.column("k2"), b.column("lang"), *ints, pa.array(got[5], pa.float64()), pa.array(per_word, pa.float64()), pa.array(failed, pa.bool_())], names=[x.split()[0] for x in FIELDS.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *content_key("lang", "text"), language(), "text")
    return rows.mapInArrow(run, FIELDS)


def bands(scored: DataFrame, scratch: Scratch, spread: float = SPREAD) -> DataFrame:
    """(band_lang, low, high, word_low, word_high): limits of log_ppl and log_word, from all documents that pass the base rules."""
    rows = scored.where("not base_failed").select("lang", "n_words", "log_ppl", "log_word").dropDuplicates(["lang", "n_words", "log_ppl"])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("of"), F.floor(F.col(c) / BIN).cast("long").alias("bin")) for c in ("log_ppl", "log_word")])).alias("x")
    bins = rows.select("lang", each).groupBy("lang", "x.of", "x.bin").agg(F.count("*").alias("n"))
    bins = scratch.cut(bins, "bins")

    def median(df: DataFrame, value: str) -> DataFrame:
        upto = F.sum("n").over(Window.partitionBy("lang", "of").orderBy(value))
        whole = F.sum("n").over(Window.partitionBy("lang", "of"))
        return df.withColumn("_u", upto).withColumn("_w", whole).where(F.col("_u") * 2 >= F.col("_w")).groupBy("lang", "of").agg(F.min(value).alias("m"))

    mid = scratch.cut(median(bins, "bin"), "median").withColumnRenamed("lang", "_l").withColumnRenamed("of", "_of")
    off = bins.join(mid, (F.col("lang") == F.col("_l")) & (F.col("of") == F.col("_of"))).groupBy("lang", "of", "m", F.abs(F.col("bin") - F.col("m")).alias("off")).agg(F.sum("n").alias("n"))
    off = scratch.cut(off, "off")
    mad = median(off.drop("m"), "off").withColumnRenamed("m", "mad")
    others = median(off.drop("m").where("off > 0"), "off").withColumnRenamed("m", "others")
    centres = off.groupBy("lang", "of").agg(F.first("m").alias("m"))
    wide = centres.join(mad, ["lang", "of"]).join(others, ["lang", "of"], "left")
    dev = F.when(F.col("mad") > 0, F.col("mad")).otherwise(F.coalesce("others", F.lit(0)))
    width, centre = (dev * spread * 1.4826 + 1) * BIN, (F.col("m") + 0.5) * BIN
    side = lambda c, x: F.max(F.when(F.col("of") == c, x))
    limits = [side(c, x).alias(name) for c, x, name in (("log_ppl", centre - width, "low"), ("log_ppl", centre + width, "high"), ("log_word", centre - width, "word_low"), ("log_word", centre + width, "word_high"))]
    return scratch.cut(wide.groupBy(F.col("lang").alias("band_lang")).agg(*limits), "bands")


def judged(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Scores with the verdict; k1 and k2 stand for lang and text, which alone decide."""
    with scratch.small_batches():
        scored = scratch.cut(scores(docs, train(docs, scratch)), "scores")
    limits = bands(scored, scratch)
    scratch.sweep(scored, limits)
    inside = scored.join(checked(limits), F.col("lang") == F.col("band_lang"), "left")
    kept = ~F.col("base_failed") & F.col("log_ppl").between(F.col("low"), F.col("high")) & F.col("log_word").between(F.col("word_low"), F.col("word_high"))
    return inside.withColumn("kept", F.coalesce(kept, F.lit(False))).drop("band_lang")


def quality(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Statistics and verdict of every document."""
    out = judged(docs, scratch)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.exp("log_ppl").alias("perplexity"))


def keep(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The documents that pass, with all their columns. Texts are scored once; those that fail are dropped by their key."""
    gone = scratch.cut(judged(docs, scratch).where("not kept").select("k1", "k2").distinct(), "rejected")
    return drop_rows(docs, content_key("lang", "text"), gone)
