"""Language of web pages by fusing evidence.

log P(language | page) = tempered text log-likelihood + log P(declared markup language | language)
+ log P(address suffix | language) + log of the host's prior, up to a constant.

Text: character 3-grams of words and the words, hashed, multinomial per language with add-``alpha`` smoothing,
trained on at most ``sample_rows`` labelled documents, for all languages of that sample. Declared language and suffix: tables counted over
all pages from posteriors of text alone. Host prior: posteriors of text and markup summed by host, domain and suffix, each
level smoothed towards the one above it with ``kappa`` pseudo-pages, a page's own share taken out.
Posteriors are counted in thousandths, so sums do not depend on their order.

Markup is read in one pass from tag to tag, so a page takes time in proportion to its length however its tags are broken: a comment
or script that is not closed ends with the page, and so does a tag.

Defined cases: null or empty html has no text evidence; a null or odd url has the host "" and suffix "";
without labelled documents the result has null languages; null page_ids and repeated rows are each scored; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import html as markup
import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.tables import checked
from tidegraph.session import Scratch

BUCKETS = 1 << 15
SAMPLE_ROWS = 4_000
ALPHA, KAPPA, TEMPER = 0.5, 5.0, 200.0
#: Three-letter codes of languages that have a two-letter one.
CODES = {"ara": "ar", "bul": "bg", "ces": "cs", "chi": "zh", "cze": "cs", "dan": "da", "deu": "de", "dut": "nl", "ell": "el", "eng": "en", "est": "et", "fin": "fi", "fra": "fr", "fre": "fr", "ger": "de", "gre": "el", "heb": "he", "hin": "hi", "hrv": "hr", "hun": "hu", "ind": "id", "ita": "it", "jpn": "ja", "kor": "ko", "lav": "lv", "lit": "lt", "nld": "nl", "nor": "no", "pol": "pl", "por": "pt", "ron": "ro", "rum": "ro", "rus": "ru", "slk": "sk", "slo": "sk", "slv": "sl", "spa": "es", "srp": "sr", "swe": "sv", "tha": "th", "tur": "tr", "ukr": "uk", "vie": "vi", "zho": "zh"}
#: Elements whose content is no text.
HIDDEN = ("script", "style", "noscript")
_NAME = re.compile(r"<(html|script|style|noscript)(?![\w-])", re.IGNORECASE)
_CLOSE = {x: re.compile(f"</{x}", re.IGNORECASE) for x in HIDDEN}
_LANG = re.compile(r"(?<![\w-])lang\s*=\s*[\"']?\s*([A-Za-z]{2,8})", re.IGNORECASE)
WORD = re.compile(r"[^\W\d_]+")
WORDS_CACHED = 1 << 18


def grams(word: str) -> list[int]:
    """Hashed features of a word."""
    import zlib

    w = f"^{word}$"
    return [zlib.crc32(w[i : i + 3].encode()) % BUCKETS for i in range(len(w) - 2)] + [zlib.crc32(w.encode()) % BUCKETS]


def read_page(html: str) -> tuple[str, str]:
    """The text of a page, and the language that its first html tag with one declares ("" without), in one pass."""
    parts, declared, at, end = [], "", 0, len(html)
    while at < end:
        start = html.find("<", at)
        if start < 0:
            start = end
        parts.append(html[at:start])
        if start == end:
            break
        if html.startswith("<!--", start):
            stop = html.find("-->", start + 4)
            at = end if stop < 0 else stop + 3
            continue
        stop = html.find(">", start)
        stop = end if stop < 0 else stop
        name = _NAME.match(html, start) if html[start + 1 : start + 2] in "hHsSnN" else None
        tag = name[1].lower() if name else ""
        if tag == "html" and not declared and (said := _LANG.search(html, name.end(), stop)):
            declared = CODES.get(said[1].lower(), said[1].lower())
        at = min(stop + 1, end)
        if tag in HIDDEN:
            close = _CLOSE[tag].search(html, at)
            at = close.start() if close else end
    return markup.unescape(" ".join(parts)), declared


class TextModel:
    """log P(feature | language): a value for features that a language lacks, and what the others have above it.

    Its size follows the features of the sample, not languages times buckets.
    """

    def __init__(self, langs: list[str], counts: list[dict[int, int]]) -> None:
        self.langs = langs
        total = np.array([sum(c.values()) for c in counts], float)
        self.base = np.log(ALPHA) - np.log(total + ALPHA * BUCKETS)
        rows = sorted((g, i, math.log1p(n / ALPHA)) for i, c in enumerate(counts) for g, n in c.items())
        self.start = np.searchsorted(np.array([r[0] for r in rows], np.int64), np.arange(BUCKETS + 1))
        self.lang, self.more = np.array([r[1] for r in rows], np.int32), np.array([r[2] for r in rows], float)
        self.seen: dict[str, tuple] = {}

    def __getstate__(self):
        return self.__dict__ | {"seen": {}}

    def word(self, w: str) -> tuple[np.ndarray, int]:
        f = grams(w)
        out = self.base * len(f)
        for g in f:
            a, b = self.start[g], self.start[g + 1]
            out[self.lang[a:b]] += self.more[a:b]
        return out, len(f)

    def evidence(self, text: str) -> tuple[np.ndarray, int]:
        """Log-likelihood per language and number of features."""
        if len(self.seen) * len(self.langs) > WORDS_CACHED * 4:
            self.seen.clear()
        total, n = np.zeros(len(self.langs)), 0
        for w, k in Counter(WORD.findall(text.lower())).items():
            got = self.seen.get(w)
            if got is None:
                got = self.seen[w] = self.word(w)
            total += k * got[0]
            n += k * got[1]
        return total, n


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> TextModel:
    """The text model from labelled documents: at most sample_rows, chosen by hash."""
    ids = docs.where("lang is not null and doc_id is not null and text is not null").select("doc_id", "lang")
    picked = ids.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(sample_rows).select(F.col("doc_id").alias("_id")).distinct()
    sampled = docs.select("doc_id", "lang", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).where("lang is not null").select("lang", "text")

    def count(batches):
        import pyarrow as pa

        held: Counter = Counter()
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for w, k in Counter(WORD.findall((text or "").lower())).items():
                    for g in grams(w):
                        held[lang, g] += k
        if held:
            yield pa.RecordBatch.from_pydict({"lang": [k for k, _ in held], "gram": pa.array([g for _, g in held], pa.int32()), "n": pa.array(list(held.values()), pa.int64())})

    counts = sampled.mapInArrow(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    by: dict[str, dict[int, int]] = {}
    for r in counts.toLocalIterator():  # features of the sample, at most BUCKETS rows per language
        by.setdefault(r.lang, {})[r.gram] = r.n
    langs = sorted(by)
    return TextModel(langs, [by[x] for x in langs])


def posteriors(logs: np.ndarray) -> np.ndarray:
    """Rows of log weights -> rows of probabilities."""
    e = np.exp(logs - logs.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def milli(p: np.ndarray) -> np.ndarray:
    return np.floor(p * 1000 + 0.5).astype(np.int64)


def _matrix(batch, name: str, width: int) -> np.ndarray:
    """A column of arrays of one length."""
    return batch.column(name).flatten().to_numpy().reshape(batch.num_rows, width)


def _arrays(m: np.ndarray, kind):
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1]), pa.int32()), pa.array(m.ravel(), kind))


def evidence(pages: DataFrame, model: TextModel) -> DataFrame:
    """page_id, host, domain, suffix, declared, n_features, t (tempered text log-likelihoods) and q (their posterior, in thousandths)."""
    shared = pages.sparkSession.sparkContext.broadcast(model)
    k = len(model.langs)
    kind = "page_id long, url string, declared string, n_features long, t array<double>, q array<long>"

    def run(batches):
        import pyarrow as pa

        m = shared.value
        for b in batches:
            rows, declared, sizes = [], [], []
            for h in b.column("html").to_pylist():
                text, said = read_page(h or "")
                declared.append(said)
                total, n = m.evidence(text)
                rows.append(total * (TEMPER / (TEMPER + n)))
                sizes.append(n)
            if rows:
                t = np.array(rows).reshape(len(rows), k)
                yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(declared, pa.string()), pa.array(sizes, pa.int64()), _arrays(t, pa.float64()), _arrays(milli(posteriors(t)), pa.int64())], names=[x.split()[0] for x in kind.split(", ")])

    got = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, kind)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    labels = F.split("host", "\\.")
    return got.withColumn("host", host).withColumn("domain", F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")).withColumn("suffix", F.element_at(labels, -1)).drop("url")


def summed(rows: DataFrame, by: list[str], shares: str) -> DataFrame:
    """(by.., lang, n): thousandths of pages by language; languages without any are left out, but each key has a row."""
    long = rows.select(*by, F.posexplode(shares).alias("lang", "n")).where("n > 0 or lang = 0")
    return long.groupBy(*by, "lang").agg(F.sum("n").alias("n"))


def packed(sums: DataFrame, by: list[str], name: str) -> DataFrame:
    """A map from language to n for each key; at most as many entries as languages."""
    return sums.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias(name))


def identify(pages: DataFrame, docs: DataFrame, scratch: Scratch, sample_rows: int = SAMPLE_ROWS, kappa: float = KAPPA) -> DataFrame:
    """page_id, lang, prob, text_lang, declared, host of every page."""
    model = train(docs, sample_rows)
    langs = model.langs
    if not langs:
        return pages.select(F.col("page_id").cast("long").alias("page_id"), *[F.lit(None).cast("string").alias(c) for c in ("lang",)], F.lit(None).cast("double").alias("prob"), *[F.lit(None).cast("string").alias(c) for c in ("text_lang", "declared", "host")])
    width = len(langs)
    rows = scratch.cut(evidence(pages, model), "evidence")

    def conditional(by: str, name: str) -> DataFrame:
        """log P(value | language) over all pages, smoothed by one page spread over the values."""
        sums = scratch.cut(summed(rows, [by], "q"), name)
        total = {r.lang: r.n for r in sums.groupBy("lang").agg(F.sum("n").alias("n")).collect()}  # a row per language
        values = max(sums.where("lang = 0").count(), 1)
        whole = F.array(*[F.lit(total.get(i, 0) / 1000 + 1) for i in range(width)])
        log = lambda m: F.transform(whole, lambda w, i: F.log((F.coalesce(F.element_at(m, i), F.lit(0)) / 1000 + 1 / values) / w))
        return scratch.cut(packed(sums, [by], "m").select(F.col(by).alias(f"_{name}"), log(F.col("m")).alias(name)), f"log-{name}")

    marked = rows.join(checked(conditional("declared", "d")), F.col("declared") == F.col("_d"))
    marked = marked.join(checked(conditional("suffix", "s")), F.col("suffix") == F.col("_s"))

    def first(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                t, d = _matrix(b, "t", width), _matrix(b, "d", width)
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(8)), _arrays(milli(posteriors(t + d)), pa.int64())], names=[*b.schema.names, "p"])

    kind = "page_id long, host string, domain string, suffix string, declared string, t array<double>, d array<double>, s array<double>"
    marked = scratch.cut(marked.select("page_id", "host", "domain", "suffix", "declared", "t", "d", "s").mapInArrow(first, f"{kind}, p array<long>"), "marked")

    hosts = scratch.cut(summed(marked, ["suffix", "domain", "host"], "p"), "hosts")
    domains = scratch.cut(hosts.groupBy("suffix", "domain", "lang").agg(F.sum("n").alias("n")), "domains")
    suffixes = scratch.cut(domains.groupBy("suffix", "lang").agg(F.sum("n").alias("n")), "suffixes")
    total = {r.lang: r.n for r in suffixes.groupBy("lang").agg(F.sum("n").alias("n")).collect()}  # a row per language
    whole = np.array([total.get(i, 0) for i in range(width)], float)
    root = (whole / 1000 + 1) / (whole.sum() / 1000 + width)
    up = packed(domains, ["suffix", "domain"], "m").withColumnsRenamed({"suffix": "_sx", "domain": "_dm"})
    tree = packed(hosts, ["suffix", "domain", "host"], "h").join(up, (F.col("suffix") == F.col("_sx")) & (F.col("domain") == F.col("_dm"))).drop("_sx", "_dm")
    tree = tree.join(packed(suffixes, ["suffix"], "x").withColumnRenamed("suffix", "_sx"), F.col("suffix") == F.col("_sx"))
    tree = scratch.cut(tree.select(F.col("host").alias("_host"), "x", "m", "h"), "tree")

    def fuse(batches):
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            t, d, s, p = (_matrix(b, c, width) for c in "tdsp")
            prior = np.tile(root, (b.num_rows, 1))
            for level in "xmh":  # suffix, domain, host; the page's own share is taken out
                left = np.zeros((b.num_rows, width))
                for row, entries in enumerate(b.column(level).to_pylist()):
                    at, n = zip(*entries, strict=True)
                    left[row, at] = n
                left = np.maximum(left - p, 0) / 1000
                prior = (left + kappa * prior) / (left.sum(1, keepdims=True) + kappa)
            post = posteriors(t + d + s + np.log(prior))
            best = post.argmax(1)
            name = lambda at: pa.array([langs[i] for i in at.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("page_id"), name(best), pa.array(post[np.arange(len(best)), best]), name(t.argmax(1)), b.column("declared"), b.column("host")], names=["page_id", "lang", "prob", "text_lang", "declared", "host"])

    full = marked.join(checked(tree), F.col("host") == F.col("_host")).select("page_id", "host", "declared", "t", "d", "s", "p", "x", "m", "h")
    return full.mapInArrow(fuse, "page_id long, lang string, prob double, text_lang string, declared string, host string")
