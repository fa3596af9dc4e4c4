"""Toxicity by weak supervision.

1. Terms (words, their beginnings, ends and inner pieces) that mark toxic texts are mined from a bounded sample of labelled training
   rows (``sample_rows``), beside a fixed list of common insults.
2. Voters: groups of those terms and patterns over them vote toxic, clean or nothing on every
   training document. Votes are counted by pattern over all training documents.
3. A generative label model, fitted on the pattern counts by expectation maximisation, estimates each voter's
   accuracy and the correlation between voters: every voter depends on the label and on the voter it is most
   tied to (a maximum spanning tree of conditional mutual information).
4. A linear classifier on the share of terms among a text's words is trained on the sample and scores all texts. Its targets
   join what the label model says of a row's votes with the row's own label, which weighs more than all votes: a piece of a
   word that also begins harmless words (lose* of "loser") votes toxic, but the labels show in which texts it is not.

Rows with crc32(doc_id) % 5 = 0 are held out: they give no labels, no terms, no votes. doc_id, lang,
source and labels are no inputs of a score. Defined cases: null and empty texts get the score of a text
without terms; a very long text costs time in proportion to its words; without any labelled training row the fixed list alone votes;
labels that repeat a doc_id count as toxic if any of them is; labels without a doc_id or a value are left out; rows with null or
repeated doc_ids are each scored; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.session import Scratch

#: Common English insults.
INSULTS = ("idiot", "moron", "scum", "stupid", "trash", "loser", "worthless", "pathetic", "disgusting", "clown", "imbecile", "filth", "vermin", "retard", "bastard")
TOKEN = re.compile(r"[^\W_]+")
#: Lengths of the beginnings, ends and inner pieces of words that are terms.
STEMS, ENDS, INNER = (3, 4, 5, 6, 7, 8), (3, 4, 5, 6), 5
#: A term that makes up one word of so many counts in full.
FULL_SHARE = 50
#: Log odds: the most that all votes say of a sampled row, and what its label says.
VOTES_SAY, LABEL_SAYS = 2.2, 4.0
#: Log likelihood ratio that a mined term needs to vote: the most that chance gives any of some thousand terms.
CHANCE = 8.0
SAMPLE_ROWS = 12_000
TERMS = 3_000
LEXICON_GROUPS = 8
VOTERS = len(INSULTS[:10]) + LEXICON_GROUPS + 4
WORDS_CACHED = 1 << 19


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def word_terms(word: str) -> list[str]:
    """The terms of a word: itself, and its pieces, with a star where the word goes on."""
    n = len(word)
    out = [word] + [word[:k] + "*" for k in STEMS if k < n] + ["*" + word[-k:] for k in ENDS if k < n]
    return out + [f"*{word[i : i + INNER]}*" for i in range(1, n - INNER)]


def text_terms(word: str) -> list[str]:
    """The terms of what stands between two spaces, in composed lower case."""
    return [t for x in TOKEN.findall(unicodedata.normalize("NFKC", word).lower()) for t in word_terms(x)]


@dataclass
class Model:
    """Term weights; bounded by the number of terms."""

    index: dict[str, int]
    weights: np.ndarray
    bias: float

    def __post_init__(self) -> None:
        self._seen: dict[str, tuple[int, ...]] = {}

    def __getstate__(self):
        return self.__dict__ | {"_seen": {}}

    def present(self, text: str) -> dict[int, float]:
        """Indexes of the terms in a text, each with the root of its share among the words, 1 from one in FULL_SHARE on."""
        seen, found, words = self._seen, {}, text.split()
        if len(seen) > WORDS_CACHED:
            seen.clear()
        for w, c in Counter(words).items():
            got = seen.get(w)
            if got is None:
                got = seen[w] = tuple({i for t in text_terms(w) if (i := self.index.get(t)) is not None})
            for i in got:
                found[i] = found.get(i, 0) + c
        return {i: min(1.0, math.sqrt(FULL_SHARE * c / len(words))) for i, c in found.items()}

    def score(self, text: str) -> float:
        x = self.bias + sum(self.weights[i] * v for i, v in self.present(text).items())
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """text and toxic of at most ``rows`` labelled training documents, chosen by hash."""
    train = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    picked = train.groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("toxic")).orderBy(F.md5(F.col("_id").cast("string")), "_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).select("text", F.col("toxic").cast("int").alias("toxic"))


def mine(sampled: DataFrame, terms: int = TERMS) -> list[tuple[str, int, int]]:
    """(term, toxic documents, clean documents) of the terms that tell most; toxic ones first."""

    def count(batches):
        import pyarrow as pa

        pos, neg = Counter(), Counter()
        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                (pos if toxic else neg).update({t for w in set((text or "").split()) for t in text_terms(w)})
        names = list(pos.keys() | neg.keys())
        for at in range(0, len(names), 50_000):
            part = names[at : at + 50_000]
            yield pa.RecordBatch.from_pydict({"term": part, "pos": pa.array([pos[t] for t in part], pa.int64()), "neg": pa.array([neg[t] for t in part], pa.int64())})

    got = sampled.mapInArrow(count, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    n1, n0 = (x or 0 for x in sampled.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first())
    odds = F.log((F.col("pos") + 0.5) / (n1 + 1.0)) - F.log((F.col("neg") + 0.5) / (n0 + 1.0))
    scored = got.where("pos + neg >= 2").withColumn("s", odds * F.sqrt(F.col("pos") + 0.1 * F.col("neg")))
    scored = Scratch(sampled.sparkSession, "terms").cut(scored, "scored")
    best = scored.orderBy(F.desc("s"), "term").limit(terms * 2 // 3).collect()
    least = scored.orderBy("s", "term").limit(terms // 3).collect()
    return [(r.term, r.pos, r.neg) for r in {r.term: r for r in best + least}.values()]


def make_voters(mined: list[tuple[str, int, int]], n_pos: int, n_neg: int) -> dict[str, int]:
    """Lexicon voter of each term that marks toxic texts: insults one by one, mined terms dealt by rank."""
    voter = {t: k for k, t in enumerate(INSULTS[:10])} | {t: 9 for t in INSULTS[10:]}
    share = (n_pos + 0.5) / (n_pos + n_neg + 1)

    def told(p: int, n: int) -> float:
        return p * math.log(p / (p + n) / share) + (n * math.log(n / (p + n) / (1 - share)) if n else 0.0)

    strong = [(t, p, n) for t, p, n in mined if p >= 2 and (p + 0.5) / (n_pos + 1) > 20 * (n + 0.5) / (n_neg + 1) and told(p, n) > CHANCE]
    for k, (t, _, _) in enumerate(x for x in strong if x[0] not in voter):
        voter[t] = 10 + k % LEXICON_GROUPS
    return voter


def votes(text: str, voter: dict[str, int], seen: dict) -> int:
    """Votes of all voters in base 3: 0 none, 1 toxic, 2 clean."""
    words = text.split()
    hits: list[int] = []
    if len(seen) > WORDS_CACHED:
        seen.clear()
    for w in words:
        got = seen.get(w)
        if got is None:
            got = seen[w] = tuple({voter[t] for t in text_terms(w) if t in voter})
        if got:
            hits.extend(got)
    v = [0] * VOTERS
    for h in hits:
        v[h] = 1
    n, k = len(words), LEXICON_GROUPS + 10
    v[k] = 1 if len(hits) >= 2 else 2 if not hits else 0
    v[k + 1] = 1 if hits and len(hits) * 100 >= n else 2 if len(hits) * 2000 < n or not hits else 0
    v[k + 2] = 1 if len(set(hits)) >= 2 else 2 if not hits and n >= 20 else 0
    v[k + 3] = 1 if hits and "!" in text else 2 if not hits else 0
    return sum(x * 3**i for i, x in enumerate(v))


def vote_counts(docs: DataFrame, voter: dict[str, int]) -> DataFrame:
    """(pattern, n): training documents by vote pattern, pre-aggregated in each task and counted by the shuffle."""

    def cast(batches):
        import pyarrow as pa

        held, seen = Counter(), {}
        for b in batches:
            held.update(votes(t or "", voter, seen) for t in b.column(0).to_pylist())
        if held:
            yield pa.RecordBatch.from_pydict({"pattern": pa.array(list(held), pa.int64()), "n": pa.array(list(held.values()), pa.int64())})

    train = docs.where(~F.coalesce(held_out(F.col("doc_id")), F.lit(False))).select("text")
    return train.mapInArrow(cast, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))


ANCHOR = 5.0
#: A fit ends when no probability moves by more.
STILL = 1e-4


def known_votes(sampled: DataFrame, voter: dict[str, int]) -> Counter:
    """Sampled rows by (pattern, label)."""

    def cast(batches):
        import pyarrow as pa

        held, seen = Counter(), {}
        for b in batches:
            held.update((votes(t or "", voter, seen), int(y)) for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        if held:
            yield pa.RecordBatch.from_pydict({"pattern": pa.array([p for p, _ in held], pa.int64()), "y": pa.array([y for _, y in held], pa.int32()), "n": pa.array(list(held.values()), pa.int64())})

    rows = sampled.mapInArrow(cast, "pattern long, y int, n long").groupBy("pattern", "y").agg(F.sum("n").alias("n")).collect()  # at most the sample's rows
    return Counter({(r.pattern, min(1, r.y)): r.n for r in rows})


def digits(patterns) -> np.ndarray:
    """A row of votes for each pattern."""
    return np.asarray(patterns, np.int64).reshape(-1, 1) // 3 ** np.arange(VOTERS, dtype=np.int64) % 3


def above(v: np.ndarray, parent: list[int]) -> np.ndarray:
    """The votes of the parent voters; 0 without a parent."""
    return np.stack([v[:, p] if p >= 0 else np.zeros(len(v), int) for p in parent], axis=1)


def expected(v: np.ndarray, table: np.ndarray | None, parent: list[int], prior: float) -> np.ndarray:
    """P(toxic) of rows of votes; without a table, a first guess by the number of toxic votes."""
    if table is None:
        ones = (v == 1).sum(1)
        return np.where(ones >= 2, 0.95, np.where(ones == 1, 0.5, 0.02))
    up, cols = above(v, parent), np.arange(VOTERS)
    ll = [np.log(table[cols, y, up, v]).sum(1) for y in (0, 1)]
    return 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + ll[1] - ll[0], -30, 30)))


def by_parent(v: np.ndarray, weights: tuple[np.ndarray, np.ndarray], parent: list[int]) -> np.ndarray:
    """Weight by voter, label, parent's vote and vote."""
    up, cols = above(v, parent), np.arange(VOTERS)
    out = [np.bincount(((cols * 3 + up) * 3 + v).ravel(), np.repeat(w, VOTERS), VOTERS * 9).reshape(VOTERS, 3, 3) for w in weights]
    return np.stack(out, axis=1)


def by_pair(v: np.ndarray, weights: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Weight by label, voter, its vote, other voter and its vote."""
    one = (v[:, :, None] == np.arange(3)).reshape(len(v), -1).astype(float)
    return np.stack([(one.T @ (one * w[:, None])).reshape(VOTERS, 3, VOTERS, 3) for w in weights])


class LabelModel:
    """P(label) and P(vote | label, vote of the parent voter), by expectation maximisation.

    Every round is a Spark job over all patterns; what reaches the driver is a table of sums from each task,
    of VOTERS x 2 x 3 x 3 or, once, VOTERS x VOTERS x 2 x 3 x 3 numbers, whatever the number of patterns.
    """

    def __init__(self, counts: DataFrame, prior: float, known: Counter | None = None, rounds: int = 30) -> None:
        """counts: (pattern, n), cheap to read again. known: labelled training documents by (pattern, label); they anchor the two labels, each with the weight ANCHOR."""
        known = known or Counter()
        pats = sorted({p for p, _ in known})
        self.counts, self.known = counts, digits(pats)
        self.anchor = tuple(ANCHOR * np.array([known[p, y] for p in pats], dtype=float) for y in (0, 1))
        self.prior, self.parent, self.table = prior, [-1] * VOTERS, None
        if pats or not counts.isEmpty():
            self._fit(rounds)
            self.parent = self._tree()
            self._fit(rounds, [-1] * VOTERS)

    def _sums(self, reduce, size: int, parent: list[int]) -> np.ndarray:
        """The sum over tasks of reduce(votes, weights by label); parent: of the table that gives the expectations."""
        table, prior = self.table, self.prior

        def run(batches):
            import pyarrow as pa

            out = np.zeros(size)
            for b in batches:
                v, n = digits(b.column(0).to_numpy()), b.column(1).to_numpy().astype(float)
                post = expected(v, table, parent, prior)
                out += reduce(v, (n * (1 - post), n * post)).ravel()
            yield pa.RecordBatch.from_pydict({"sums": pa.array([out.tolist()], pa.list_(pa.float64()))})

        return sum((np.array(r.sums) for r in self.counts.select("pattern", "n").mapInArrow(run, "sums array<double>").collect()), np.zeros(size))

    def _fit(self, rounds: int, before: list[int] | None = None) -> None:
        """before: parents of the table that the first round starts from."""
        parent = self.parent
        anchored = by_parent(self.known, self.anchor, parent)
        for k in range(rounds):
            sums = self._sums(lambda v, w: by_parent(v, w, parent), VOTERS * 18, before if before and not k else parent)
            table = 0.1 + sums.reshape(VOTERS, 2, 3, 3) + anchored
            table /= table.sum(-1, keepdims=True)
            still = self.table is not None and k and np.abs(table - self.table).max() < STILL
            self.table = table
            if still:
                return

    def _tree(self) -> list[int]:
        """Parents in the maximum spanning tree of the voters' mutual information given the label."""
        pairs = self._sums(by_pair, 2 * (VOTERS * 3) ** 2, self.parent).reshape(2, VOTERS, 3, VOTERS, 3)
        total = pairs[:, 0, :, 0].sum()
        gain = np.zeros((VOTERS, VOTERS))
        for y in (0, 1):
            for a in range(VOTERS):
                for b in range(a):
                    joint = pairs[y, a, :, b] + 1e-6
                    mass = joint.sum()
                    p = joint / mass
                    gain[a, b] += mass / max(total, 1e-9) * (p * np.log(p / np.outer(p.sum(1), p.sum(0)))).sum()
        gain += gain.T
        parent, inside = [-1] * VOTERS, {0}
        while len(inside) < VOTERS:
            _, a, b = max((gain[i, j], i, j) for i in range(VOTERS) if i not in inside for j in inside)
            parent[a] = b
            inside.add(a)
        return parent

    def posterior(self, patterns: list[int]) -> np.ndarray:
        """P(toxic) of vote patterns, counted before or not."""
        if self.table is None:
            return np.full(len(patterns), self.prior)
        return expected(digits(patterns), self.table, self.parent, self.prior)

    def accuracies(self) -> list[float]:
        """Expected share of right votes among the votes of each voter."""
        parent = self.parent
        by = self._sums(lambda v, w: by_parent(v, w, parent), VOTERS * 18, parent).reshape(VOTERS, 2, 3, 3).sum(2)
        return [float((x[1, 1] + x[0, 2]) / max(x[:, 1:].sum(), 1e-9)) for x in by]


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, terms: int = TERMS, epochs: int = 300) -> tuple[Model, LabelModel]:
    sampled = sample(docs, labels, sample_rows)
    n1, n0 = (x or 0 for x in sampled.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first())
    mined = mine(sampled, terms)
    voter = make_voters(mined, n1, n0)
    prior = min(0.5, max(0.01, (n1 + 1) / (n1 + n0 + 10)))
    label_model = LabelModel(Scratch(docs.sparkSession, "votes").cut(vote_counts(docs, voter), "patterns"), prior, known_votes(sampled, voter))
    names = list(dict.fromkeys([*INSULTS, *(t for t, _, _ in mined)]))
    model = Model({t: i for i, t in enumerate(names)}, np.zeros(len(names)), 0.0)

    def features(batches):
        import pyarrow as pa

        seen = {}
        for b in batches:
            texts = [t or "" for t in b.column(0).to_pylist()]
            found = [model.present(t) for t in texts]
            columns = {
                "terms": pa.array([list(x) for x in found], pa.list_(pa.int32())),
                "shares": pa.array([list(x.values()) for x in found], pa.list_(pa.float32())),
                "pattern": pa.array([votes(t, voter, seen) for t in texts], pa.int64()),
                "toxic": b.column(1),
            }
            yield pa.RecordBatch.from_pydict(columns)

    rows = sampled.select("text", "toxic").mapInArrow(features, "terms array<int>, shares array<float>, pattern long, toxic int").collect()  # at most sample_rows
    if rows:
        said = label_model.posterior([r.pattern for r in rows])
        soft = targets(said, np.array([r.toxic for r in rows]))
        cols, shares = (np.concatenate([np.zeros(0, k), *(np.array(r[name], k) for r in rows)]) for name, k in (("terms", int), ("shares", float)))
        ptr = np.repeat(np.arange(len(rows)), [len(r.terms) for r in rows])
        model.weights, model.bias = logistic(ptr, cols, shares, soft, len(names), epochs)
    else:
        model.weights[: len(INSULTS)], model.bias = 4.0, -2.0
    return model, label_model


def targets(said: np.ndarray, label: np.ndarray) -> np.ndarray:
    """P(toxic) of sampled rows by their votes and their labels."""
    odds = np.log(np.clip(said, 1e-9, None)) - np.log(np.clip(1 - said, 1e-9, None))
    return 1 / (1 + np.exp(-np.clip(odds, -VOTES_SAY, VOTES_SAY) - np.where(label > 0, LABEL_SAYS, -LABEL_SAYS)))


def logistic(row: np.ndarray, col: np.ndarray, x: np.ndarray, y: np.ndarray, terms: int, epochs: int, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias on soft labels and values x of the terms: full-batch gradient steps scaled per term (Adagrad), so rare terms learn too."""
    w, b = np.zeros(terms), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    gw, gb = np.full(terms, 1e-8), 1e-8
    for _ in range(epochs):
        z = b + np.bincount(row, w[col] * x, minlength=len(y))
        err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        g = np.bincount(col, err[row] * x, minlength=terms) / len(y) + l2 * w
        gw += g * g
        w -= 0.3 * g / np.sqrt(gw)
        d = err.mean()
        gb += d * d
        b -= 0.1 * d / math.sqrt(gb)
    return w, b


def toxicity(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    model, _ = train(docs, labels, **settings)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        import pyarrow as pa

        m = shared.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array([m.score(t or "") for t in b.column("text").to_pylist()], pa.float64())], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
