"""Toxicity by weak supervision.

Voters are lexicons and patterns, each of one kind: insults by what they say,
words found among labelled rows by how common and how exclusive they are in
toxic ones, beginnings of words by length, and patterns of form.  A generative
label model reads only their votes: by expectation maximisation it estimates,
for toxic and for other documents, how often each voter speaks up and how
pairs of voters go together, and keeps the strongest such dependencies as a
tree, so that a voter's evidence is what it adds to its neighbour's.  Votes
are counted by pattern over all documents (at most 2 ** VOTERS rows), so the
model sees the corpus but the driver sees a table of bounded size.  A linear
classifier is trained on the model's posterior labels and scores every
document.

Word lists, the posterior's starting point and the classifier come from a
bounded sample of labelled rows (TRAIN_ROWS).  Null and empty texts get no
votes and the score of the bias; repeated rows get equal scores; without
labels the word lists are the common insults alone.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import LOWER_ASCII, Texts, blocks, column_texts, mix, span_hashes
from .sampling import labelled_sample, remainder

FOLDS, HELD_OUT = 5, 0
TRAIN_ROWS = 8_000
#: Words and word beginnings (each) that are looked up.
TERMS = 256
LENGTHS = (5, 6, 7, 8)
#: Toxic documents that a term needs, and how many times as likely it must be in them.
LEAST, RATIO = 4, 15
#: Labelled toxic documents that have a common word.
COMMON = 16
#: Hits from which there is a feature of its own.
HITS = (1, 2, 3, 5)

# Common insults that name a person, a thing or a quality, or turn one away; words that address someone.
PERSONS = ("idiot", "idiots", "moron", "morons", "loser", "losers", "clown", "clowns", "imbecile", "jerk", "creep", "freak")
THINGS = ("scum", "trash", "garbage", "filth", "vermin")
QUALITIES = ("stupid", "pathetic", "disgusting", "worthless", "dumb", "ugly")
DISMISSALS = ("shut",)
ADDRESS = ("you", "your", "yours", "yourself")

LEXICONS = (PERSONS, THINGS, QUALITIES, DISMISSALS)
#: The first voter of the words found (common or not, exclusive or not), of the beginnings (by length) and of the patterns.
FOUND_WORDS = len(LEXICONS)
BEGINNINGS = FOUND_WORDS + 4
PATTERNS = BEGINNINGS + len(LENGTHS)
VOTERS = PATTERNS + 8


def lowered(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the accented Latin letters."""
    out = LOWER_ASCII[data]
    after = np.flatnonzero(data[:-1] == 0xC3) + 1 if len(data) else np.zeros(0, int)
    upper = after[(data[after] >= 0x80) & (data[after] <= 0x9E) & (data[after] != 0x97)]
    out[upper] += 0x20
    return out


def term_hashes(texts: Texts) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Hashes of words (runs of letters) and of their beginnings in bytes, with the row of each; lists by kind."""
    data = lowered(texts.data)
    letter = ((data >= 97) & (data <= 122)) | (data >= 128)
    edge = letter.copy()
    edge[1:] &= ~letter[:-1]
    heads = texts.starts[texts.starts < texts.ends]
    edge[heads] = letter[heads]
    starts = np.flatnonzero(edge)
    last = letter.copy()
    last[:-1] &= ~letter[1:]
    tails = texts.ends[texts.starts < texts.ends] - 1
    last[tails] = letter[tails]
    ends = np.flatnonzero(last) + 1
    owner = texts.per_text(starts)[1]
    hashes, owners = [span_hashes(data, starts, ends)], [owner]
    for n in LENGTHS:
        long = ends - starts > n
        hashes.append(mix(span_hashes(data, starts[long], starts[long] + n) + np.uint64(n)))
        owners.append(owner[long])
    return hashes, owners


def distinct(h: np.ndarray, owner: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Each (hash, row) that comes at least so often, once."""
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    start = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]))) if len(h) else np.zeros(0, int)
    start = start[np.diff(np.append(start, len(h))) >= least]
    return h[start], owner[start]


def word_hash(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(span_hashes(raw, np.array([0]), np.array([len(raw)]))[0])


def found_terms(sample: DataFrame) -> list[tuple[int, int]]:
    """Up to TERMS words and TERMS beginnings (hash, voter), the most telling first.

    A beginning counts in a text in which two words or more have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(2).to_numpy()
            for i, j, texts in blocks(column_texts(batch.column(1))):
                for kind, (h, owner) in enumerate(zip(*term_hashes(texts), strict=True)):
                    h, owner = distinct(h, owner, 1 if kind == 0 else 2)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), kind, np.int32)), pa.array(label[i:j][owner].astype(np.int64))], ["term", "kind", "label"])

    terms = sample.mapInArrow(run, "term long, kind int, label long").groupBy("term", "kind").agg(F.sum("label").alias("bad"), F.count(F.lit(1)).alias("n"))
    rows = sample.agg(F.coalesce(F.sum("label"), F.lit(0)).alias("bad"), F.count(F.lit(1)).alias("n")).first()
    bad, good = max(1, rows["bad"]), max(1, rows["n"] - rows["bad"])
    rate, other = (F.col("bad") + 0.1) / bad, (F.col("n") - F.col("bad") + 0.5) / good
    telling = terms.filter(F.col("bad") >= LEAST).filter(rate > RATIO * other).withColumn("weight", F.log(rate / other) * F.sqrt("bad"))
    of_word = F.lit(FOUND_WORDS) + F.when(F.col("bad") >= COMMON, 0).otherwise(2) + F.when(F.col("bad") == F.col("n"), 0).otherwise(1)
    voter = F.when(F.col("kind") == 0, of_word).otherwise(BEGINNINGS - 1 + F.col("kind"))
    out = []
    for kinds in ("kind = 0", "kind > 0"):
        best = telling.filter(kinds).orderBy(F.desc("weight"), "term", "kind").limit(TERMS)
        out += [(r["term"] & (2**64 - 1), r["voter"]) for r in best.select("term", voter.alias("voter")).collect()]
    return out


class Terms:
    """The looked-up terms in order of hash, and the voter of each."""

    def __init__(self, found: list[tuple[int, int]]):
        voter = dict(found)
        for k, words in enumerate(LEXICONS):
            voter |= dict.fromkeys(map(word_hash, words), k)
        self.keys = np.array(sorted(voter), np.uint64)
        self.voter = np.array([voter[int(k)] for k in self.keys], np.int64)
        self.address = np.array([word_hash(w) for w in ADDRESS], np.uint64)
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(np.append(self.keys, self.address) & np.uint64(0xFFFF)).astype(np.int64)] = True

    def hits(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term) of each word that is a term, and twice of each beginning that two words have; rows that address someone."""
        rows, terms = [], []
        for kind, (h, owner) in enumerate(zip(*term_hashes(texts), strict=True)):
            at = np.flatnonzero(self.maybe[(h & np.uint64(0xFFFF)).astype(np.int64)])
            h, owner = h[at], owner[at]
            if kind:
                h, owner = distinct(h, owner, 2)
                h, owner = np.repeat(h, 2), np.repeat(owner, 2)
            else:
                addressed = owner[np.isin(h, self.address)]
            i = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            same = self.keys[i] == h
            rows.append(owner[same])
            terms.append(i[same])
        return np.concatenate(rows), np.concatenate(terms), addressed


def forms(texts: Texts) -> list[np.ndarray]:
    """By text: is most of it capitals; how many exclamation marks, doubled marks, stretched and disguised letters it has."""
    one, two, three = (np.append(texts.data, np.zeros(2, np.uint8))[k : k + len(texts.data)] for k in range(3))
    # a pair or three of bytes lies within one text
    pair = np.ones(len(one), bool)
    pair[texts.ends[texts.starts < texts.ends] - 1] = False
    triple = pair & np.append(pair[1:], False)
    letter = lambda x: (LOWER_ASCII[x] >= 97) & (LOWER_ASCII[x] <= 122)
    capitals = 2 * texts.sums((one >= 65) & (one <= 90)) > texts.ends - texts.starts
    doubled = pair & (one == ord("!")) & ((two == ord("!")) | (two == ord("?")))
    stretched = triple & letter(one) & (LOWER_ASCII[one] == LOWER_ASCII[two]) & (LOWER_ASCII[two] == LOWER_ASCII[three])
    disguised = triple & letter(one) & ((two == ord("*")) | (two == ord("$"))) & letter(three)
    return [capitals, texts.sums(one == ord("!")), texts.sums(doubled), texts.sums(stretched), texts.sums(disguised)]


def votes(texts: Texts, terms: Terms) -> np.ndarray:
    """A bit for each voter that speaks up."""
    row, term, addressed = terms.hits(texts)
    spoke = np.zeros((len(texts), VOTERS), bool)
    spoke[row, terms.voter[term]] = True
    n = np.bincount(row, minlength=len(texts))
    capitals, marks, doubled, stretched, disguised = forms(texts)
    to_someone = np.bincount(addressed, minlength=len(texts)) > 0
    for k, said in enumerate((n >= 2, n >= 5, to_someone & (n > 0), capitals, capitals & (marks >= 2), doubled > 0, stretched > 0, disguised > 0)):
        spoke[:, PATTERNS + k] = said
    return spoke @ (1 << np.arange(VOTERS))


def _bits(patterns: np.ndarray) -> np.ndarray:
    return ((patterns[:, None] >> np.arange(VOTERS)) & 1).astype(np.int8)


class LabelModel:
    """How often each voter speaks up on toxic and other documents, alone and given its neighbour in a tree of dependencies."""

    #: How often voters speak up on toxic and other documents, as far as nothing is known; worth one document.
    BEFORE = (0.4, 0.01)

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, known: np.ndarray, labels: np.ndarray, rounds: int = 50):
        """Fitted to all votes (patterns and their counts); starts from the votes on labelled rows (known, labels)."""
        x, n = _bits(patterns), counts.astype(float)
        self.prior = min(max(float(labels.mean()) if len(labels) else 0.05, 1e-3), 0.5)
        self._fit(_bits(known), (labels == 1).astype(float), (labels == 0).astype(float))
        for _ in range(rounds):
            q = self._posterior(x)
            self._fit(x, q * n, (1 - q) * n)

    def _fit(self, x: np.ndarray, toxic: np.ndarray, other: np.ndarray) -> None:
        """Rates, tree and evidence from the votes and the weights of their documents as toxic and as other."""
        pairs, rates = [], []
        for weight, before in ((toxic, self.BEFORE[0]), (other, self.BEFORE[1])):
            both = (x * weight[:, None]).T @ x.astype(float)
            alone, total = np.diag(both), weight.sum()
            first = alone[:, None] - both
            second = alone[None, :] - both
            seen = np.array([[total - first - second - both, second], [first, both]])
            known = np.array([[(1 - before) ** 2, before * (1 - before)], [before * (1 - before), before**2]])
            rates.append((alone + before) / (total + 1))
            pairs.append((np.maximum(seen, 0) + known[:, :, None, None]) / (total + 1))
        pairs = np.clip(np.array(pairs), 1e-7, 1)  # class, first's vote, second's vote, first, second
        self.toxic, self.other = rates
        ahead, behind = pairs.sum(axis=2, keepdims=True), pairs.sum(axis=1, keepdims=True)
        share = np.array([toxic.sum(), other.sum()]) / max(toxic.sum() + other.sum(), 1e-9)
        information = np.einsum("c,cabij->ij", share, pairs * np.log(pairs / (ahead * behind)))
        self.neighbour = self._tree(information)
        given = np.clip(pairs / ahead, 1e-4, 1 - 1e-4)
        rates = np.clip(np.array(rates), 1e-4, 1 - 1e-4)
        self.evidence = np.zeros((VOTERS, 2, 2))  # voter, neighbour's vote, own vote
        for i, j in enumerate(self.neighbour):
            if self.toxic[i] <= self.other[i]:
                continue  # voters speak up for toxicity, or say nothing
            if j < 0:
                self.evidence[i] = np.log(np.array([(1 - rates[0, i]) / (1 - rates[1, i]), rates[0, i] / rates[1, i]]))
            else:
                self.evidence[i] = np.log(given[0, :, :, j, i] / given[1, :, :, j, i])

    @staticmethod
    def _tree(information: np.ndarray) -> list[int]:
        """The neighbour of each voter towards the first (which has none, -1), in a tree of the most informative pairs."""
        near, best = [-1] * VOTERS, information[0].copy()
        left = set(range(1, VOTERS))
        link = np.zeros(VOTERS, int)
        while left:
            i = max(left, key=lambda k: (best[k], -k))
            near[i] = int(link[i])
            left.remove(i)
            closer = information[i] > best
            best[closer], link[closer] = information[i][closer], i
        return near

    def _posterior(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), np.log(self.prior / (1 - self.prior)))
        for i, j in enumerate(self.neighbour):
            z += self.evidence[i][x[:, max(j, 0)], x[:, i]]
        return 1 / (1 + np.exp(-z))

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """How likely documents with these votes are toxic."""
        return self._posterior(_bits(patterns))


def features(texts: Texts, terms: Terms) -> np.ndarray:
    """Indicators of terms, and of how many hits there are."""
    row, term, _ = terms.hits(texts)
    out = np.zeros((len(texts), len(terms.keys) + len(HITS)), np.float32)
    out[row, term] = 1
    n = np.bincount(row, minlength=len(texts))
    out[:, len(terms.keys) :] = n[:, None] >= np.array(HITS)
    return out


def fit_linear(x: np.ndarray, target: np.ndarray, penalty: float = 1e-3, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic weights for soft labels by accelerated gradient descent; both classes weigh the same."""
    weight = np.where(target > 0.5, 0.5 / max(1e-9, (target > 0.5).mean()), 0.5 / max(1e-9, (target <= 0.5).mean())) / max(1, len(target))
    w, b = np.zeros(x.shape[1]), 0.0
    v, c = w.copy(), b
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ v + c, -30, 30)))
        g = (p - target) * weight
        new_w, new_b = v - 2.0 * (x.T @ g + penalty * v), c - 2.0 * g.sum()
        m = k / (k + 3)
        v, c = new_w + m * (new_w - w), new_b + m * (new_b - b)
        w, b = new_w, new_b
    return w, float(b)


ROWS_AT_ONCE = 1024


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", most: int = TRAIN_ROWS) -> DataFrame:
    """(key, held_out, score, predicted, votes) of every row, learned from labels outside the held-out fold."""
    sc = docs.sparkSession.sparkContext
    key_type = docs.schema[key].dataType.simpleString()
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    sample = labelled_sample(docs, labels.withColumnRenamed(key, "key"), label, FOLDS, HELD_OUT, most, "key", "text")
    terms = sc.broadcast(Terms(found_terms(sample)))  # 2 * TERMS and the insults

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[int] = Counter()
        for batch in batches:
            for _, _, texts in blocks(column_texts(batch.column(0)), max_rows=ROWS_AT_ONCE):
                used, n = np.unique(votes(texts, terms.value), return_counts=True)
                total.update(dict(zip(used.tolist(), n.tolist(), strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.int64())], ["pattern", "n"])

    table = docs.select("text").mapInArrow(count, "pattern int, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").toPandas()

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, texts in blocks(column_texts(batch.column(1)), max_rows=ROWS_AT_ONCE):
                x = np.packbits(features(texts, terms.value).astype(bool), axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(votes(texts, terms.value).astype(np.int32)), pa.array([r.tobytes() for r in x], pa.binary())], ["key", "label", "pattern", "x"])

    rows = sample.mapInArrow(train, f"key {key_type}, label int, pattern int, x binary").orderBy("key", "x").toPandas()
    width = len(terms.value.keys) + len(HITS)
    x = np.stack([np.unpackbits(np.frombuffer(b, np.uint8), count=width) for b in rows["x"]]).astype(np.float32) if len(rows) else np.zeros((0, width), np.float32)
    model = LabelModel(table["pattern"].to_numpy(np.int64), table["n"].to_numpy(np.int64), rows["pattern"].to_numpy(np.int64), rows["label"].to_numpy(np.int64))
    target = model.posterior(rows["pattern"].to_numpy(np.int64)) if len(rows) else np.zeros(0)
    if len(rows):
        w, b = fit_linear(x, target)
    else:
        w, b = np.append(np.ones(len(terms.value.keys)), np.zeros(len(HITS))), -1.5
    weights = sc.broadcast((w, b))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = weights.value
        for batch in batches:
            for i, j, texts in blocks(column_texts(batch.column(1)), max_rows=ROWS_AT_ONCE):
                z = (features(texts, terms.value) * w).sum(axis=1) + b
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30)))), pa.array(votes(texts, terms.value).astype(np.int32))], ["key", "score", "votes"])

    scored = docs.mapInArrow(score, f"key {key_type}, score double, votes int")
    held = F.coalesce(remainder(F.col("key"), FOLDS) == HELD_OUT, F.lit(False))
    return scored.select(F.col("key").alias(key), held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "votes")
