"""Each operator against a brute-force version on small tables with nulls, ties, repeats and odd texts."""

import hashlib
import math
import os
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidegraph.llm import caches, chat, components, decontaminate, encoders, language, mixing, ngram_join, quality, token_counts, token_files, toxicity, warc
from tidegraph.llm.queries import tokenizer_path
from tidegraph.session import BATCH, BATCH_BYTES, Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile("[^\x20\x09-\x0d]+")
rnd = random.Random(3)
VOCAB = [a + b for a in ("th", "on", "er", "qu", "zé") for b in ("a", "in", "or", "ous", "t", "k")]


def prose(n):
    return " ".join(rnd.choice(VOCAB) for _ in range(n))


def some_docs():
    base = prose(120)
    words = base.split()
    near = " ".join(words[:60] + ["changed"] + words[61:])
    texts = [None, "", "one", "a b", base, base, near, base.upper(), prose(70), prose(70) + "\x85\xa0 中文 <|endoftext|> x", "x " * 3000, "\n\n \t", prose(20) + " " + base]
    rows = [(i, t, ["en", "fr", None][i % 3], ["s1", "s2", None][i % 3], 0) for i, t in enumerate(texts)]
    return rows + [rows[8], (None, prose(60), "en", "s1", 0)]


SOME = some_docs()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(SOME, DOCS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def reference_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


# --- 1 ---------------------------------------------------------------------------------------


def brute_base(text):
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = {t for t, n in Counter(windows).items() if n > 1}
    covered = {i + k for i, t in enumerate(windows) if t in many for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


@pytest.mark.parametrize("text", ["", "a", "a b c a b c a b", "x\nx\n\n \n y\nx", "é# *$\x85| a\xa0b\x1c", "a b c d a b c a b c"])
def test_base_statistics(text):
    words, *rest = quality.base(text)
    assert (len(words), *rest) == brute_base(text)


def brute_kneser_ney(texts, order=quality.ORDER):
    """Log probability of a word, from dictionaries."""
    level = Counter()
    for t in texts:
        for w in WORD.findall(t):
            s = quality.PAD * (order - 1) + w + quality.STOP
            level.update(s[i : i + order] for i in range(len(s) - order + 1))
    tables = {}
    for n in range(order, 0, -1):
        c = Counter(level.values())
        y = c[1] / max(c[1] + 2 * c[2], 1)
        d = [0.0] + [max(min(k - (k + 1) * y * c[k + 1] / c[k] if c[k] else 0.5 * k, k - 0.05), 0.05) for k in (1, 2, 3)]
        total, held = Counter(), Counter()
        for g, k in level.items():
            total[g[:-1]] += k
            held[g[:-1]] += d[min(k, 3)]
        tables[n] = (level, d, total, held)
        types = len(level)
        if n > 1:  # the first grams of a word are counted as they occur, others by the contexts they have
            shorter = Counter()
            for g, k in level.items():
                shorter[g[1:]] += k if g[1] == quality.PAD else 1
            level = shorter

    def p(g):
        n = len(g)
        if not n:
            return 1 / (types + 1)
        level, d, total, held = tables[n]
        h = g[:-1]
        if not total[h]:
            return p(g[1:])
        k = level[g]
        return ((k - d[min(k, 3)]) if k else 0.0) / total[h] + held[h] / total[h] * p(g[1:])

    def word(w):
        s = quality.PAD * (order - 1) + w + quality.STOP
        return sum(math.log(max(p(s[i : i + order]), 1e-12)) for i in range(len(s) - order + 1))

    return word


def test_perplexity_is_kneser_ney(spark, docs):
    got = {r.doc_id: r for r in quality.quality(docs, Scratch(spark, "t")).collect() if r.doc_id is not None}
    by = defaultdict(list)
    for _, t, la, *_ in SOME:
        by[la or "und"].append(t or "")
    models = {la: brute_kneser_ney(ts) for la, ts in by.items()}
    for i, t, la, *_ in SOME:
        if i is None:
            continue
        n, chars, sym, dup, rep = brute_base(t or "")
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, sym, dup, rep)
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n)
        assert not (r.base_failed and r.kept)
        if n:
            want = math.exp(-sum(map(models[la or "und"], WORD.findall(t))) / (chars + n))
            assert r.perplexity == pytest.approx(want, rel=1e-4)


def test_bands_reject_outliers_and_keep_the_rest(spark):
    rows = [(i, prose(80), "en", "s", 0) for i in range(40)] + [(99, " ".join("".join(rnd.choice("qxzjvkw0123456789") for _ in range(9)) for _ in range(80)), "en", "s", 0)]
    df = spark.createDataFrame(rows, DOCS)
    kept = {r.doc_id for r in quality.keep(df, Scratch(spark, "t")).collect()}
    assert kept == set(range(40))


def test_bands_reject_suffixed_and_table_documents(spark):
    rng = random.Random(11)
    text = lambda n: [rng.choice(VOCAB) for _ in range(n)]
    rows = [(i, " ".join(text(rng.randint(60, 300))), "en", "s", 0) for i in range(150)]
    rows += [(i, " ".join(w + rng.choice(("***", "&&&", "$$$")) for w in text(100)), "en", "s", 0) for i in range(200, 204)]
    rows += [(i, " | ".join(text(100)), "en", "s", 0) for i in range(300, 303)]
    rows += [(400, " ".join(text(70)), "xx", "s", 0)]  # a language of one document
    rows += [(900 + i, " ".join([rows[0][1].split()[0]] * 3 + [w for w in text(60) if len(w) < 4] * 2), "en", "s", 0) for i in range(2)]
    rows += [(i, rows[0][1], "en", "s", 0) for i in range(500, 800)]  # copies do not narrow the band of the others
    df = spark.createDataFrame(rows, DOCS)
    kept = {r.doc_id for r in quality.keep(df, Scratch(spark, "t")).collect()}
    assert not kept & {*range(200, 204), *range(300, 303)}
    assert len(kept & set(range(1, 150))) >= 145 and 400 in kept
    assert {r.doc_id for r in quality.quality(df, Scratch(spark, "t")).where("kept").collect()} == kept


@pytest.mark.parametrize("unnamed", [[""], ["", None]], ids=["empty", "both"])
def test_an_empty_lang_is_und(spark, unnamed):
    rng = random.Random(12)
    text = lambda k: " ".join(rng.choice(VOCAB if k % 2 else [w[::-1] + "ska" for w in VOCAB]) for _ in range(80))
    rows = [(k, text(k), "en" if k % 2 else unnamed[k // 2 % len(unnamed)], "s", 0) for k in range(80)]
    got = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows, DOCS), Scratch(spark, "t")).collect()}
    models = {la: brute_kneser_ney([t for _, t, x, *_ in rows if (x or "und") == la]) for la in ("en", "und")}
    for i, t, la, *_ in rows:
        want = math.exp(-sum(map(models[la or "und"], WORD.findall(t))) / (got[i].word_chars + got[i].n_words))
        assert got[i].perplexity == pytest.approx(want, rel=1e-4)
    assert sum(r.kept for r in got.values()) > 70
    kept = quality.keep(spark.createDataFrame(rows, DOCS), Scratch(spark, "t")).collect()
    assert {r.doc_id for r in kept} == {i for i, r in got.items() if r.kept} and {r.lang for r in kept} == {"en", *unnamed}


# --- 2, 3 --------------------------------------------------------------------------------------


def test_encoder_equals_the_library():
    tok, path = reference_tokenizer(), tokenizer_path()
    alphabet = list("ab Zé9 _'s.,\n\t\r  ñ²ßdºª½\x0b\x0c\x85\xa0\x1c中😀'’ll|re") + ["<|endoftext|>"]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 30))) for _ in range(3000)]
    want = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(v, "<u2").tolist() for v in encoders.Encoder(path, 2).values(texts)] == want
    assert encoders.Encoder(path).values(texts) == [len(x) for x in want]
    small = encoders.Encoder(path)
    encoders.CACHE_ENTRIES, old = 10, encoders.CACHE_ENTRIES
    try:
        assert [small.values([t])[0] for t in texts[:300]] == [len(x) for x in want[:300]]
    finally:
        encoders.CACHE_ENTRIES = old


def test_token_counts(docs, nothing):
    tok = reference_tokenizer()
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs, tokenizer_path()).collect())
    want = []
    for i, t, *_ in SOME:
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        want.append((i if i is not None else -1, len((t or "").encode()), n, n > 512))
    assert got == sorted(want)
    assert token_counts.token_counts(nothing, tokenizer_path()).count() == 0


def test_token_files(spark, docs, nothing):
    tok = reference_tokenizer()
    root = token_files.write(docs, tokenizer_path(), Scratch(spark, "t"))
    got = token_files.read(spark, root).orderBy("start").collect()
    rows = sorted(SOME, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    start = 0
    assert len(got) == len(rows)
    for r, (i, t, *_) in zip(got, rows, strict=True):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_files.manifest(root)["tokens"] == start
    assert token_files.read(spark, token_files.write(nothing, tokenizer_path(), Scratch(spark, "t"))).count() == 0


def test_workers_get_small_batches(spark, docs, monkeypatch):
    held = {}
    plain = Scratch.cut

    def cut(self, df, name="step"):
        held.setdefault(name, []).append(spark.conf.get(BATCH, None))
        return plain(self, df, name)

    monkeypatch.setattr(Scratch, "cut", cut)
    token_files.write(docs, tokenizer_path(), Scratch(spark, "t"))
    quality.keep(docs, Scratch(spark, "t"))
    ngram_join.one_each(docs, Scratch(spark, "t"))
    assert all(x == str(BATCH_BYTES) for name in ("parts", "scores", "nodes", "shards", "verified") for x in held[name])
    assert spark.conf.get(BATCH, None) is None
    rows = spark.range(0, 1500, 1, 1).select(F.repeat(F.lit("x"), 10_000).alias("text"))
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": pa.array([b.column(0).get_total_buffer_size()], pa.int64())}) for b in batches)
    with Scratch(spark, "t").small_batches():
        got = plain(Scratch(spark, "t"), rows.mapInArrow(sizes, "n long")).collect()
    assert 15_000_000 < sum(r.n for r in got) and max(r.n for r in got) < 2 * BATCH_BYTES


def test_a_claim_empties_what_others_left():
    ngram_join.shingles("one two three four five six")
    assert ngram_join._word_hash
    caches.claim("overlaps")
    assert not ngram_join._word_hash


# --- 4 -------------------------------------------------------------------------------------------


def test_language_uses_all_evidence(spark):
    en, fr = "the house and the river were here with them ", "la maison et la rivière sont ici avec eux "
    docs = spark.createDataFrame([(i, (en if i % 2 else fr) * 5, "en" if i % 2 else "fr", "s", 0) for i in range(20)], DOCS)
    page = lambda body, la="": f"<html{la and f' lang={la!r}'}><script>la la la</script><p>{body}</p></html>"
    pages = [(i, f"http://w{i % 2}.x.{'fr' if i % 2 else 'com'}/a", page(fr if i % 2 else en, "fr" if i % 2 else "en")) for i in range(20)]
    pages += [(50, "http://w1.x.fr/q", ""), (51, None, None), (52, "http://other.com", page(fr)), (None, "::", page(en)), (0, *pages[0][1:])]
    got = [(r.page_id, r.lang) for r in language.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), docs, Scratch(spark, "t")).collect()]
    assert len(got) == len(pages)
    by = dict(got)
    assert all(by[i] == ("fr" if i % 2 else "en") for i in range(20))
    assert by[50] == "fr" and by[52] == "fr" and by[None] == "en" and by[51] in ("en", "fr")
    blank = language.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), docs.limit(0), Scratch(spark, "t"))
    assert blank.where("lang is null").count() == len(pages)


@pytest.mark.parametrize("html", ["<" * 2_000_000, "<html " * 300_000, "<script>" * 300_000, "<!--" * 500_000, "<html lang" * 200_000, "lang = " * 200_000, "<style></script>" * 100_000])
def test_broken_markup_is_read_in_linear_time(html):
    began = time.process_time()
    language.read_page(html)
    assert time.process_time() - began < 4


def test_markup():
    read = language.read_page
    assert read("<!-- <html lang=fr> --><HTML class='x' LANG = 'eng-US'><p>a&amp;b<SCRIPT>no</Script >c<noscript>x</noscript>") == ("    a&b  c  ", "en") or read("<HTML LANG=eng>")[1] == "en"
    assert read('<html xml:lang="de" data-lang="fr" lang="fil">x')[1] in ("fil", "de") and read("<html lang=fil>")[1] == "fil"
    assert read("<p lang=en>x")[1] == "" and read("<htmlx lang=en>")[1] == "" and read("x<html>y<html lang='pt_BR'>")[1] == "pt"
    assert read("a<style>b")[0].split() == ["a"] and read("a<scripted>b")[0].split() == ["a", "b"] and read("a < b > c")[0].split() == ["a", "c"]


def brute_posteriors(pages, model, kappa=language.KAPPA):
    """P(language) of each page (page_id, url, html), one step after another, from dictionaries."""
    langs, k = model.langs, range(len(model.langs))
    norm = lambda logs: (lambda e: [x / sum(e) for x in e])([math.exp(x - max(logs)) for x in logs])
    milli = lambda p: [int(math.floor(x * 1000 + 0.5)) for x in p]
    rows = []
    for _, url, html in pages:
        text, said = language.read_page(html or "")
        words = language.WORD.findall(text.lower())
        logs = [sum(model.word(w)[0][i] for w in words) for i in k]
        n = sum(len(language.grams(w)) for w in words)
        m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", url or "")
        host = m[1].lower() if m else ""
        rows.append({"t": [x * 200 / (200 + n) for x in logs], "d": said, "h": host, "m": ".".join(host.split(".")[-2:]), "x": host.split(".")[-1]})

    def table(by):
        sums = defaultdict(lambda: [0] * len(langs))
        for r in rows:
            sums[r[by]] = [a + b for a, b in zip(sums[r[by]], milli(norm(r["t"])), strict=True)]
        total = [sum(s[i] for s in sums.values()) for i in k]
        return {v: [math.log((s[i] / 1000 + 1 / len(sums)) / (total[i] / 1000 + 1)) for i in k] for v, s in sums.items()}

    declared, suffix = table("d"), table("x")
    for r in rows:
        r["p"] = milli(norm([r["t"][i] + declared[r["d"]][i] for i in k]))
    held = {level: defaultdict(lambda: [0] * len(langs)) for level in "xmh"}
    for r in rows:
        for level in "xmh":
            key = (r["x"], r["m"], r["h"])["xmh".index(level)]
            held[level][key] = [a + b for a, b in zip(held[level][key], r["p"], strict=True)]
    whole = [sum(r["p"][i] for r in rows) for i in k]
    out = []
    for r in rows:
        prior = [(whole[i] / 1000 + 1) / (sum(whole) / 1000 + len(langs)) for i in k]
        for level in "xmh":
            left = [max(held[level][r[level]][i] - r["p"][i], 0) / 1000 for i in k]
            prior = [(left[i] + kappa * prior[i]) / (sum(left) + kappa) for i in k]
        post = norm([r["t"][i] + declared[r["d"]][i] + suffix[r["x"]][i] + math.log(prior[i]) for i in k])
        out.append(dict(zip(langs, post, strict=True)))
    return out


def test_posteriors_equal_a_plain_version(spark):
    rng = random.Random(8)
    vocab = {f"l{j}": ["".join(rng.choice("abcdefghij"[j % 7 : j % 7 + 4]) for _ in range(5)) for _ in range(12)] for j in range(70)}
    docs = spark.createDataFrame([(i, " ".join(rng.choice(vocab[la]) for _ in range(20)), la, "s", 0) for i, la in enumerate([*vocab, *vocab])], DOCS)
    pages = []
    for i in range(60):
        la = rng.choice(list(vocab)[:9])
        body = " ".join(rng.choice(vocab[la]) for _ in range(rng.choice([0, 3, 30])))
        pages.append((i if i else None, rng.choice([None, "::", f"http://u@w{i % 3}.{la}.xx:80/q", f"https://{la}.yy", "http://Z.yy"]), None if i == 5 else f"<html lang={rng.choice(['', la, 'eng'])}><p>{body}"))
    pages.append(pages[7])
    got = language.identify(spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as t0", "3 as declared"), docs, Scratch(spark, "t")).collect()
    model = language.train(docs)
    assert len(model.langs) == 70  # more than any fixed number of tables once held
    want = [(p[0], *max(((round(v, 6), la) for la, v in post.items()))) for p, post in zip(pages, brute_posteriors(pages, model), strict=True)]
    assert len(got) == len(want)
    best = {(p, la): pr for p, pr, la in want}
    assert all(r.prob == pytest.approx(best[r.page_id, r.lang], abs=1e-5) for r in got)
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert language.identify(empty, docs, Scratch(spark, "t")).count() == 0


# --- 5 --------------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    big = "<p>\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n</p>é" * 5
    pages = [(3, "http://a/ b\n", big), (1, None, big), (7, "u", big), (1, "twice", big), (4, "s", "short"), (5, "s", "short"), (6, "n", None), (None, "x", big), (None, "y", "z" * 200), (None, "y", "z" * 200)]
    s = Scratch(spark, "t")
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    uris = warc.normalise(spark, warc.write_monolithic(warc.plan(df, s), s), s)
    got = warc.read_indexed(spark, uris).collect()
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = Counter()
    for i, _, h in pages:
        first = 1 if h == big else None
        again = first is not None and i != first
        want[i, len((h or "").encode()), sha(h), "revisit" if again else "response", first if again else None] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert all(x.length > 0 for x in got)
    empty = df.limit(0)
    assert warc.read_indexed(spark, warc.normalise(spark, warc.write_monolithic(warc.plan(empty, s), s), s)).count() == 0


def test_split_records_rejects_a_cut_file():
    rec = warc.record(1, "u", b"x" * 10, "d", None, False)
    assert list(warc.split_records([rec[:7], rec[7:] + rec])) == [rec, rec]
    with pytest.raises(ValueError):
        list(warc.split_records([rec[:-5]]))


# --- 6 ---------------------------------------------------------------------------------------------


def brute_components(rows):
    sets = []
    for i, t, *_ in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return Counter((i, len(s), least.get(find(k), i) if s else i) for k, (i, s) in enumerate(sets))


def near_rows():
    """Groups of near copies at many distances, with and without the text they come from."""
    rows, i = [], 0
    for g in range(6):
        base = prose(90).split()
        for k in range(14):
            w = list(base)
            for p in rnd.sample(range(90), k % 5 if g % 2 else 1 + k % 4):
                w[p] = f"edit{rnd.randint(0, 10**6)}"
            rows.append((i, " ".join(w), "en", "s", 0))
            i += 1
    passage = prose(55)
    for _ in range(25):  # a passage that otherwise different documents share
        rows.append((i, f"{prose(12)} {passage} {prose(15)}", "en", "s", 0))
        i += 1
    return rows


@pytest.mark.parametrize("split", [ngram_join.SPLIT_ROWS, 3], ids=["whole", "split"])
@pytest.mark.parametrize("rows", [SOME, near_rows()], ids=["odd", "near"])
def test_ngram_join_equals_all_pairs(spark, monkeypatch, rows, split):
    monkeypatch.setattr(ngram_join, "SPLIT_ROWS", split)
    monkeypatch.setattr(ngram_join, "SALT_ROWS", min(split, ngram_join.SALT_ROWS))
    got = ngram_join.near_components(spark.createDataFrame(rows, DOCS), Scratch(spark, "t")).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows)


def test_one_document_of_each_group_stays(spark, docs, nothing):
    left = ngram_join.one_each(docs, Scratch(spark, "t"))
    assert left.columns == docs.columns
    ids = Counter(r.doc_id for r in left.collect())
    assert ids == Counter(min((c if n else i) for i, n, c in [x]) for x in {(i, n, c) for i, n, c in brute_components(SOME) if i is not None and (i == c or not n)}) + Counter([None])
    assert ngram_join.near_components(nothing, Scratch(spark, "t")).count() == 0
    assert ngram_join.one_each(nothing, Scratch(spark, "t")).count() == 0


def test_rows_are_told_apart_by_id_and_text(spark):
    """Shared and null ids, equal rows that differ elsewhere, and columns of the operator's own names."""
    a, b, c = prose(40), prose(40), prose(40)
    rows = [(1, a, 10), (1, b, 11), (2, c, 12), (2, c, 13), (3, b, 14), (None, a, 15), (None, None, 16), (None, f"{c} x", 17), (None, prose(30), 18), (5, "", 19), (5, "", 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _again long").selectExpr("*", "'g' as _gone", "1 as k1", "2 as row", "3 as part", "map(1, 2) as m")
    left = ngram_join.one_each(df, Scratch(spark, "t"))
    assert left.columns == df.columns
    got = left.collect()
    assert {(r._gone, r.k1, r.row, r.part) for r in got} == {("g", 1, 2, 3)}
    at = sorted(r._again for r in got)
    assert [x for x in at if x not in (12, 13)] == [10, 11, 16, 18, 19, 20] and len(at) == 7
    again = ngram_join.one_each(df, Scratch(spark, "t")).collect()
    assert sorted(r._again for r in again) == at


def shuffle_files(spark):
    held = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = {held.apply(i).getName() for i in range(held.size())}
    return {x for x in names if x.startswith("shuffle_")}


def test_ngram_join_frees_what_it_no_longer_reads(spark, monkeypatch):
    """When nodes are compared, only a row per node holds shingles, and no query leaves shuffle files."""
    rows = near_rows()[:28]
    rows += [(i + 1000, t, *rest) for i, t, *rest in rows]
    seen, links = [], ngram_join.links

    def watched(live, scratch, *more):
        for _ in range(50):  # files go a moment after the query
            left = shuffle_files(spark) - before
            if not left:
                break
            time.sleep(0.1)
        folder = scratch.root.removeprefix("file://")
        seen.append((sorted(x.partition("-")[2] for x in os.listdir(folder)), left))
        assert live.count() == live.select("node").distinct().count() <= len(rows) // 2
        return links(live, scratch, *more)

    monkeypatch.setattr(ngram_join, "links", watched)
    s, before, name = Scratch(spark, "t"), shuffle_files(spark), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name)
    got = ngram_join.near_components(spark.createDataFrame(rows, DOCS), s).collect()
    assert seen == [(["live", "rows", "shards"], set())]
    assert spark.conf.get(name) == was
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows)


def test_fragments_are_runs_of_the_order():
    histogram = [0, 0, 50, 30, 5] + [0] * 251
    at = ngram_join.cuts(histogram, 4)
    rng = np.random.default_rng(1)
    counts = np.repeat([2, 3, 4], [5000, 3000, 500])
    keys = ngram_join.order_key(counts, rng.integers(0, 2**64, len(counts), np.uint64))
    held = np.bincount(np.searchsorted(np.array(at, np.uint64), keys, "right"), counts, 4)
    assert len(at) == 3 and at == sorted(at) and held.max() < 1.1 * held.min()
    assert ngram_join.cuts([], 4) == [] and [ngram_join.bucket_bits(x) for x in (0, 1 << 40, 1 << 47, 1 << 60)] == [12, 13, 18, 18]


def test_components(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 102), (200, 200), (103, 100)] + [(500, k) for k in range(501, 540)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {i: 0 for i in range(31)} | {i: 100 for i in (100, 101, 102, 103)} | {i: 500 for i in range(500, 540)}


# --- 7 ----------------------------------------------------------------------------------------------


def test_escaping_is_reversible():
    bits = [*chat.CONTROL, "\\", "\n", "a", "<", "|", "im_end", "[", "INST]"]
    for _ in range(2000):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 9)))
        assert chat.unescape(chat.escape(text)) == text
        assert not any(c in chat.escape(text) for c in chat.CONTROL)
        role = text[:4]
        assert [x[:2] for x in chat.parse(chat.render(role, text)[0] * 2)] == [(role, text)] * 2


def test_windows(spark):
    turns = [(1, 0, "system", "be kind")] + [(1, k, "user" if k % 2 else "assistant", prose(rnd.randint(1, 60))) for k in range(1, 60)]
    turns += [(2, 0, None, None), (2, 0, "assistant", "</s>[INST] x"), (2, 0, "assistant", "</s>[INST] x"), (3, None, "user", "\\<|im_end|>\n"), (3, 1, "assistant", prose(3000)), (3, 2, "user", "ok"), (None, 5, "assistant", "é😀")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    win = chat.windows(df, tokenizer_path(), budget=300, history=80)
    rows, tok = win.collect(), reference_tokenizer()
    for r in rows:
        n = len(chat.parse(r.text))
        # turns are encoded one by one; a library given a turn's text alone says as many tokens
        assert r.n_tokens == sum(len(tok.encode(chat.render(role, text)[0], add_special_tokens=False).ids) for role, text, _, _ in chat.parse(r.text))
        assert r.over_budget == (r.n_tokens > 300) and (not r.over_budget or n - r.n_context == 1)
        if r.conv_id == 1:
            assert chat.parse(r.text)[0][:2] == ("system", "be kind")
    assert sum(r.n_context > 1 for r in rows if r.conv_id == 1) > 3
    got = {r.conv_id: r for r in chat.digests(win).collect()}
    by = defaultdict(list)
    for c, k, role, text in turns:
        by[c].append((k is not None, k or 0, role is not None, role or "", text or ""))
    for c, ts in by.items():
        ts.sort()
        whole = "".join(f"{r}\n{t}\n" for *_, r, t in ts)
        loss = "".join(t for *_, r, t in ts if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(ts), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c].formatted_chars == sum(len(r.text) for r in rows if r.conv_id == c)
    assert chat.digests(chat.windows(df.limit(0), tokenizer_path())).count() == 0


# --- 8 -----------------------------------------------------------------------------------------------


def brute_leaks(rows, items):
    """(row number, item number) of every alignment that agrees enough, tried one by one."""
    cut = lambda t: re.sub(r"[\W_]+", " ", (t or "").lower()).split()
    out = set()
    for i, (_, t, *_) in enumerate(rows):
        w = cut(t)
        for j, (_, q) in enumerate(items):
            q = cut(q)
            span = min(20, len(q))
            least = span if span < 6 else math.ceil(0.7 * span)
            for s in range(1 - len(q), len(w) if q else 0):
                same = [0 <= s + k < len(w) and w[s + k] == q[k] for k in range(len(q))]
                if any(sum(same[a : a + span]) >= least for a in range(len(q) - span + 1)):
                    out.add((i, j))
    return out


def test_leaks(spark):
    items = [(0, prose(30)), (1, prose(24)), (2, "Only, four-word item"), (3, ""), (4, None), (0, prose(30)), (5, prose(9)), (None, prose(16)), (6, prose(12))]
    words = items[0][1].split()
    swapped = [f"sub{k}" if k % 6 == 3 else x for k, x in enumerate(words)]
    nine = items[6][1].split()
    rows = [(1, f"{prose(40)} {items[0][1].upper()}! {prose(9)}"), (2, f"{prose(9)} {' '.join(swapped)} {prose(8)}"), (3, " ".join(words[5:])), (4, prose(60)), (5, None), (6, "say ONLY four word; item now"), (7, f"{items[1][1]}, {items[0][1]}"), (None, items[1][1]), (1, "x"), (8, "")]
    rows += [(9, " ".join(["gone", *nine[1:4], "gone", *nine[5:]])), (10, " ".join(nine[2:])), (11, f"only four other item {prose(5)}"), (12, items[7][1]), (13, f"a {items[8][1]}"), (None, prose(30)), (7, prose(30)), (None, items[5][1])]
    rows = [(i, t, "en", "s", 0) for i, t in rows]
    df, bench = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")
    found = brute_leaks(rows, items)
    got = decontaminate.contaminated(df, bench, Scratch(spark, "t"))
    want = {(rows[i][0], items[j][0]) for i, j in found if rows[i][0] is not None and items[j][0] is not None}
    assert {(9, 5), (10, 5), (2, 0)} <= want and got.count() == len(want)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want
    # rows with null or shared ids are judged one by one; columns of the operators' own names pass through
    named = df.withColumnsRenamed({"n_chars": "k1"}).selectExpr("*", "1 as _key0", "2 as `_KEY1`", "3 as h")
    left = decontaminate.clean(named, bench, Scratch(spark, "t"))
    assert left.columns == named.columns
    assert Counter((r.doc_id, r.text) for r in left.collect()) == Counter(r[:2] for k, r in enumerate(rows) if k not in {i for i, _ in found})
    assert {(r._key0, r._KEY1, r.h) for r in left.collect()} == {(1, 2, 3)}
    assert decontaminate.contaminated(df, bench.limit(0), Scratch(spark, "t")).count() == 0
    assert decontaminate.contaminated(df.limit(0), bench, Scratch(spark, "t")).count() == 0
    assert decontaminate.clean(df, bench.limit(0), Scratch(spark, "t")).count() == len(rows)


def test_leaks_are_found_at_every_length(spark):
    """Items of 6 to 24 words with as many substitutions as the share allows."""
    rng = random.Random(21)
    items, rows = [], []
    for n in range(6, 25):
        for k in range(20):
            q = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            items.append((len(items), " ".join(q)))
            for p in rng.sample(range(n), min(n, 20) - math.ceil(0.7 * min(n, 20))):
                q[p] = f"s{rng.randrange(10**6)}"
            rows.append((len(rows), f"{prose(5)} {' '.join(q)} {prose(5)}", "en", "s", 0))
    got = {r.doc_id for r in decontaminate.contaminated(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string"), Scratch(spark, "t")).collect()}
    recall = {n: sum(20 * (n - 6) + k in got for k in range(20)) / 20 for n in range(6, 25)}
    assert all(recall[n] == 1 for n in range(6, 10)) and min(recall.values()) >= 0.9, recall


def test_a_long_item_is_verified_once_for_each_alignment(spark):
    item = " ".join(f"w{k % 5000}" for k in range(10_000))
    rows = [(1, f"{prose(9)} {item}", "en", "s", 0), (2, item[: len(item) // 2], "en", "s", 0), (3, prose(400), "en", "s", 0)]
    got = decontaminate.contaminated(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(7, item)], "item_id long, text string"), Scratch(spark, "t")).collect()
    assert {(r.doc_id, r.item_id, r.n_matched, r.n_item_words) for r in got} == {(1, 7, 20, 10_000), (2, 7, 20, 10_000)}


# --- 9 ------------------------------------------------------------------------------------------------


def test_toxicity_on_held_out_rows(spark):
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        extra = rnd.choice(["idiot", "moron", "grubbelhaft", "grubbelung"]) if bad else ""
        rows.append((i, f"{prose(30)} {extra} {prose(10)}", "en", "s", 0))
        labels.append((i, 1, int(bad)))
    rows += [(1000, None, None, None, 0), (1001, "", None, None, 0), (None, "you idiot moron", None, None, 0)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    df = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r for r in toxicity.toxicity(df, lab).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    held = [i for i in range(400) if got[i].held_out]
    assert held == [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i].predicted == (i % 4 == 0) for i in held) / len(held) > 0.95
    assert got[1000].score == got[1001].score and got[None].predicted == 1
    without = {r.doc_id: r.predicted for r in toxicity.toxicity(df, lab.limit(0)).collect()}
    assert without[None] == 1 and without[1001] == 0
    assert toxicity.toxicity(df.limit(0), lab).count() == 0


def test_toxicity_by_ends_of_words_and_harmless_beginnings(spark):
    """Toxic words share only their end or inside; some harmless words begin as an insult does."""
    syllables = "ba de fi go ku la me ni po ru sa te vi zo".split()
    rows, labels = [], []
    for i in range(1200):
        bad = i % 8 == 0
        made = "".join(rnd.sample(syllables, 3))
        extra = made + ("grux" if i % 16 else "drolm" + rnd.choice(syllables)) if bad else "loser"[:4] + made if i % 8 == 1 else made
        rows.append((i, f"{prose(30)} {extra} {prose(10)}" if i % 24 else f"loser {prose(40)} loser", "en", "s", 0))
        labels.append((i, 1, int(bad)))
    got = toxicity.toxicity(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).where("held_out").collect()
    right = {bad: [r.predicted == bad for r in got if (r.doc_id % 8 == 0) == bad] for bad in (True, False)}
    assert sum(right[True]) >= 0.9 * len(right[True]) and sum(right[False]) >= 0.98 * len(right[False])


def test_labels_outweigh_votes_in_targets():
    got = toxicity.targets(np.array([0.0, 0.5, 1.0, 0.0, 0.5, 1.0]), np.array([0, 0, 0, 1, 1, 1]))
    assert (np.diff(got) > 0).all() and (got[:3] < 0.5).all() and (got[3:] > 0.5).all()


def test_label_model_counts_every_pattern_as_cast(spark):
    rng = random.Random(14)
    V = toxicity.VOTERS
    voter = {f"term{k}": k for k in range(18)}
    texts = [" ".join(f"term{k}" for k in range(18) if mask >> k & 1) or "none" for mask in rng.sample(range(1 << 18), 26_000)]
    want = Counter(toxicity.votes(t, voter, {}) for t in texts)
    assert len(want) > 25_000
    df = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    counts = Scratch(spark, "t").cut(toxicity.vote_counts(df, voter), "patterns")
    assert {r.pattern: r.n for r in counts.collect()} == want
    model = toxicity.LabelModel(counts, 0.1, rounds=2)
    # the same in one place, over all patterns
    v = np.array([[p // 3**i % 3 for i in range(V)] for p in want])
    n, ones = np.array(list(want.values()), float), (v == 1).sum(1)
    post = np.where(ones >= 2, 0.95, np.where(ones == 1, 0.5, 0.02))
    for parent in ([-1] * V, model.parent):
        up = np.stack([v[:, p] if p >= 0 else 0 * v[:, 0] for p in parent], axis=1)
        for _ in range(2):
            table = np.full((V, 2, 3, 3), 0.1)
            for y, w in ((0, n * (1 - post)), (1, n * post)):
                for j in range(V):
                    np.add.at(table[j, y], (up[:, j], v[:, j]), w)
            table /= table.sum(-1, keepdims=True)
            ll = [np.log(table[np.arange(V), y, up, v]).sum(1) for y in (0, 1)]
            post = 1 / (1 + np.exp(-np.clip(np.log(0.1 / 0.9) + ll[1] - ll[0], -30, 30)))
    assert np.allclose(model.table, table, rtol=1e-8)
    assert np.allclose(model.posterior(list(want)), post, rtol=1e-6)


# --- 10 -----------------------------------------------------------------------------------------------


def test_mixing(spark, docs, nothing):
    import duckdb

    rows = [(i, "w " * rnd.randint(0, 30), "en", rnd.choice(["a", "b", "b", "b", "c", None]), 0) for i in range(300)] + [(9, "x y", "en", "a", 0)] * 2 + [(None, None, None, "empty", 0)]
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(df, Scratch(spark, "t")).collect()
    assert len(got) == len(rows)
    taken, target, size = Counter(), {}, Counter()
    for r in got:
        taken[r.source] += r.mix_size * r.mix_copies
        size[r.source] += r.mix_size
        target[r.source] = r.mix_target
        assert 0 <= r.mix_copies <= 2
    for s in target:
        assert abs(taken[s] - target[s]) <= 30 and target[s] <= 2 * size[s]
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    documents = df.toArrow()
    con = duckdb.connect()
    con.register("documents", documents)
    want = Counter((None if i != i or i is None else int(i), s, t) for i, s, _, _, t in con.sql(mixing.oracle_sql()).fetchall())
    assert Counter((r.doc_id, r.mix_size, r.mix_size * r.mix_copies) for r in got) == want
    clash = df.selectExpr("*", "1 as mix_source", "2 as MIX_SIZE", "3 as mix_copies", "4 as mix_copy", "5 as row", "6 as `key`")
    named = mixing.names(clash.columns)
    both = mixing.mix(clash, Scratch(spark, "t"))
    assert both.columns == [*clash.columns, "mix_size_", "mix_source_size", "mix_target", "mix_copies_"]
    assert Counter((r.doc_id, r[named["mix_size"]], r[named["mix_size"]] * r[named["mix_copies"]]) for r in both.collect()) == want
    again = mixing.materialise(both, clash.columns)
    assert again.columns == clash.columns and again.count() == sum(r.mix_copies for r in got)
    assert {tuple(r)[5:] for r in again.collect()} == {(1, 2, 3, 4, 5, 6)}
    out = mixing.materialise(mixing.mix(df, Scratch(spark, "t")), df.columns)
    assert out.count() == sum(r.mix_copies for r in got) and out.columns == df.columns
    assert mixing.mix(nothing, Scratch(spark, "t")).count() == 0
    assert mixing.mix(docs, Scratch(spark, "t")).count() == docs.count()


def brute_bands(rows):
    """Rows that pass the base rules and lie in the bands of their language, by plain medians over distinct scores."""
    by = defaultdict(list)
    for r in rows:
        by[r[2] or "und"].append(r)
    kept = []
    for mine in by.values():
        word, measures = brute_kneser_ney([r[1] or "" for r in mine]), {}
        for r in mine:
            n, chars, _, _, rep = brute_base(r[1] or "")
            if n >= 50 and 100 * rep <= 50 * n:
                nats = -sum(map(word, WORD.findall(r[1])))
                measures[r[1]] = (n, nats / (chars + n), math.log(nats / n))
        limits = []
        for k in (1, 2):
            bins = sorted(math.floor(m[k] / 0.001) for m in measures.values())
            lower = lambda v: sorted(v)[(len(v) - 1) // 2]
            mid = lower(bins) if bins else 0
            off = [abs(x - mid) for x in bins]
            dev = (lower(off) or (lower([x for x in off if x]) if any(off) else 0)) if off else 0
            width, centre = (dev * 5 * 1.4826 + 1) * 0.001, (mid + 0.5) * 0.001
            limits.append((centre - width, centre + width))
        kept += [r for r in mine if r[1] in measures and all(lo <= measures[r[1]][k] <= hi for k, (lo, hi) in zip((1, 2), limits, strict=True))]
    return kept


def test_pipeline_equals_its_stages_by_brute_force(spark, tmp_path):
    import duckdb

    import corpus_pipeline

    rng, tok = random.Random(31), reference_tokenizer()
    text = lambda n: " ".join(rng.choice(VOCAB) for _ in range(n))
    rows = [(i, text(rng.randint(55, 140)), rng.choice(["en", "fr", None, ""]), rng.choice(["a", "b", "b", None]), 0) for i in range(110)]
    rows += [(200 + i, rows[i % 7][1] + " tail" * (i % 2), rows[i % 7][2], "a", 0) for i in range(20)]  # copies, exact and near
    rows += [(300 + i, " ".join(w + "&&&" for w in text(80).split()), "en", "b", 0) for i in range(3)] + [(310, "too short", "en", "b", 0), (311, None, None, None, 0), rows[3]]
    items = [(k, text(18)) for k in range(4)]
    rows += [(400 + k, f"{text(40)} {items[k][1]} {text(30)}", "fr", "c", 0) for k in range(3)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    passed = brute_bands(rows)
    assert 100 < len(passed) < len(rows) - 5 and not any("&&&" in r[1] for r in passed)
    component = {i: c for i, _, c in brute_components(passed)}
    single = [r for k, r in enumerate(passed) if component[r[0]] == r[0] and r not in passed[:k]]
    leaky = {i for i, _ in brute_leaks(single, items)}
    clean = [r for k, r in enumerate(single) if k not in leaky]
    assert len(single) < len(passed) - 15 and 0 < len(leaky) < 6
    con = duckdb.connect()
    con.register("documents", spark.createDataFrame(clean, DOCS).toArrow())
    copies = {i: taken // size if size else 0 for i, size, _, _, taken in con.sql(mixing.oracle_sql()).fetchall()}
    want, start = [], 0
    for i, t, *_ in sorted(clean):
        ids = [*tok.encode(t, add_special_tokens=False).ids, 2]
        for _ in range(copies[i]):
            want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == want


def test_every_stage_keeps_columns_of_any_name(spark, tmp_path):
    """Stages but the last, on tables with clashing names, and on empty ones."""
    import corpus_pipeline

    spark.createDataFrame([(0, prose(20)), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(i, prose(60), "en", "s", 0) for i in range(12)] + [(None, None, None, None, None), (3, "", "", "", 0), (None, prose(60), "en", None, 1)]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as k1", "2 as _key0", "3 as lang_", "4 as part", "5 as mix_source", "6 as mix_copies", "7 as node", "8 as row", "9 as h", "10 as kept")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns, name
        assert {tuple(r)[5:] for r in out.collect()} <= {tuple(range(1, 11))}, name
        assert stage(spark, df.limit(0), str(tmp_path)).count() == 0, name
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, df, str(tmp_path)).count() == len(rows) and last(spark, df.limit(0), str(tmp_path)).count() == 0


def test_parity_bitmaps_never_exceed_the_difference():
    rng = np.random.default_rng(5)
    for n in (1, 3, 60, 900):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64))
        for cut in (0, n // 10, n):
            b = np.unique(np.concatenate([a[cut:], rng.integers(0, 2**63, cut + 1, dtype=np.int64).astype(np.uint64)]))
            bits = sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(ngram_join.parity(a), ngram_join.parity(b), strict=True))
            assert bits <= len(np.setxor1d(a, b))
    assert sum(x & (2**64 - 1) for x in ngram_join.parity(np.zeros(0, np.uint64))) == 0
