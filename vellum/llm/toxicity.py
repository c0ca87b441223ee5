"""Toxic spans by a linear-chain conditional random field.

Tokens are words between white space, stripped of punctuation, in lower case.  Labels are given for
documents only, so tokens are labelled first: word forms and word beginnings are taken one by one,
that which best tells the toxic training documents from the clean ones next, and a document counts
less for each that it already holds.  (A form that merely comes with copies of one toxic document
finds that document explained by then.)  A training token is toxic if it has one of them and its
document is labelled toxic.

The field has two states; its emission features are the word, its beginnings and its end.  It is
fitted by gradient ascent on the conditional likelihood.  Forward-backward marginals give each
token's probability, spans are runs of tokens over one half, and a document's score is a logistic
function of the two highest marginals, of the expected number of toxic tokens and of their density.

Fitting takes a bounded sample of labelled documents to the driver (``SAMPLE`` of each label): all of
it finds the forms and calibrates the score, the field is fitted to the first ``FIT`` of each label in
the order of a hash of the id.  The model that goes to the workers holds ``MODEL_WORDS`` words at most.  Scoring covers whole texts.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import cut, free_name, table, tidy

#: Labelled documents of each label that fitting may take to the driver.
SAMPLE = {1: 900, 0: 1800}
#: Characters of the longest document that the sample takes.
SAMPLE_CHARS = 20_000
#: Of the sample, the documents of each label whose tokens the field is fitted to; the calibration takes all.
FIT = 450
MODEL_WORDS = 200_000
STRIP = ".,;:!?|#$%&*\"'()[]{}<>«»“”‘’…-"
#: Share of the toxic documents that a form has to explain, and how much a document counts after each.
SUPPORT, FADE = 0.012, 0.75
#: What a clean document that has a form takes from its gain, against a toxic one, at equal numbers of both.
PENALTY = 3.0
#: Lengths of word beginnings.
BEGINNINGS = range(3, 8)
ROUNDS, RATE, RIDGE = 30, 0.8, 1e-4
THRESHOLD = 0.7
#: Words of a worker's memory of emission scores; it is emptied when full.
REMEMBERED = 150_000


def words_of(text: str) -> list[str]:
    return [w.strip(STRIP) for w in text.lower().split()]


def features(word: str) -> list[str]:
    """What a token shows: the word, beginnings of three to seven letters (``BEGINNINGS``), an ending of three."""
    if not word:
        return ["empty"]
    out = ["w=" + word]
    out += ["p=" + word[:n] for n in BEGINNINGS if len(word) >= n]
    if len(word) > 4:
        out.append("s=" + word[-3:])
    return out


def label_forms(texts: list[list[str]], toxic: list[int], support: float = SUPPORT, fade: float = FADE) -> set[str]:
    """Features that mark toxic tokens, by sequential covering of the toxic documents."""
    held: dict[str, set[int]] = defaultdict(set)
    clean: dict[str, int] = defaultdict(int)
    n_clean = max(1, sum(1 for t in toxic if not t))
    for d, (words, t) in enumerate(zip(texts, toxic, strict=True)):
        seen = {f for w in set(words) for f in features(w) if f[0] in "wp" and len(f) > 5}
        for f in seen:
            if t:
                held[f].add(d)
            else:
                clean[f] += 1
    n_toxic = sum(toxic)
    least, cost = max(2.0, support * n_toxic), PENALTY * n_toxic / n_clean
    held = {f: s for f, s in held.items() if len(s) - cost * clean[f] >= least}
    weight = dict.fromkeys((d for d, t in enumerate(toxic) if t), 1.0)
    chosen: set[str] = set()
    while held:
        gain = {f: sum(weight[d] for d in s) - cost * clean[f] for f, s in held.items()}
        held = {f: s for f, s in held.items() if gain[f] >= least}
        if not held:
            break
        # of equals a beginning, and the shorter one, covers more words to come
        best = max(held, key=lambda f: (gain[f], f[0] == "p", -len(f), f))
        chosen.add(best)
        for d in held.pop(best):
            weight[d] *= fade
        stem = best[2:]
        held = {f: s for f, s in held.items() if not f[2:].startswith(stem)}
    return chosen


@dataclass
class Field:
    """A two-state chain: ``emission`` by feature, ``move[i][j]`` from state i to j, and the calibration."""

    emission: dict[str, float]
    move: np.ndarray
    calibration: np.ndarray
    memory: dict[str, float] = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return {"emission": self.emission, "move": self.move, "calibration": self.calibration, "memory": {}}

    def word_scores(self, words: list[str]) -> np.ndarray:
        memory, emission = self.memory, self.emission
        if len(memory) > REMEMBERED:
            memory.clear()
        out = []
        for w in words:
            s = memory.get(w)
            if s is None:
                s = emission.get("bias", 0.0) + sum(emission.get(f, 0.0) for f in features(w.strip(STRIP)))
                if len(w) <= 64:
                    memory[w] = s
            out.append(s)
        return np.array(out, dtype=np.float64)

    def marginals(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        return marginals(scores, self.move)

    def tag(self, texts: list[str]) -> list[np.ndarray]:
        """The probability of each token (word between white space) of each text."""
        return self.marginals([self.word_scores(t.lower().split()) for t in texts])

    def score(self, texts: list[str], tagged: list[np.ndarray] | None = None) -> np.ndarray:
        x = summary(self.tag(texts) if tagged is None else tagged)
        return 1 / (1 + np.exp(-np.clip(x @ self.calibration[1:] + self.calibration[0], -500, 500)))

    def spans(self, text: str, p: np.ndarray | None = None) -> list[tuple[int, int, float]]:
        """Offsets of toxic spans in the text and the highest marginal in each; ``p`` has the text's marginals, if known."""
        p = self.tag([text])[0] if p is None else p
        if not (p > 0.5).any():
            return []
        found = [m.span() for m in re.finditer(r"\S+", text)]
        out: list[tuple[int, int, float]] = []
        for i in np.flatnonzero(p > 0.5).tolist():
            if i and p[i - 1] > 0.5 and out:
                out[-1] = (out[-1][0], found[i][1], max(out[-1][2], float(p[i])))
            else:
                out.append((*found[i], float(p[i])))
        return out


def summary(tagged: list[np.ndarray]) -> np.ndarray:
    """Per document: its two highest marginals, and logs of its expected toxic tokens and of those in 1000."""
    out = np.zeros((len(tagged), 4))
    for i, p in enumerate(tagged):
        if len(p):
            top = np.partition(p, len(p) - 2)[-2:] if len(p) > 1 else p
            many = p[p > 0.05].sum()
            out[i] = top[-1], top[0] if len(p) > 1 else 0.0, math.log1p(many), math.log1p(1000 * many / len(p))
    return out


def _blocks(lengths: list[int]) -> Iterator[tuple[list[int], np.ndarray]]:
    """Sequences of similar length, longest first: members and their lengths.  Empty ones are left out."""
    order = sorted((i for i, n in enumerate(lengths) if n), key=lambda i: -lengths[i])
    at = 0
    while at < len(order):
        longest, stop = lengths[order[at]], at + 1
        while stop < len(order) and lengths[order[stop]] * 2 > longest and (stop - at) * longest < 1_000_000:
            stop += 1
        yield order[at:stop], np.array([lengths[i] for i in order[at:stop]], dtype=np.int64)
        at = stop


def _sweep(e: np.ndarray, live: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward odds of state 1; row k of ``e`` has the emission odds at position k."""
    longest, n = e.shape
    ahead, back = np.empty((longest, n)), np.ones((longest, n))
    width = np.searchsorted(-live, -np.arange(longest), side="left").tolist()  # sequences longer than each position
    (t00, t01), (t10, t11) = t.tolist()
    ahead[0] = e[0]
    for k in range(1, longest):
        w = width[k]
        r = ahead[k - 1, :w]
        ahead[k, :w] = e[k, :w] * (r * t11 + t01) / (r * t10 + t00)
    for k in range(longest - 2, -1, -1):
        w = width[k + 1]
        r = e[k + 1, :w] * back[k + 1, :w]
        back[k, :w] = (t10 + t11 * r) / (t00 + t01 * r)
    return ahead, back


def marginals(scores: list[np.ndarray], move: np.ndarray) -> list[np.ndarray]:
    """P(state 1) of each token of each sequence; those of similar length go together."""
    t = np.exp(move)
    out: list[np.ndarray] = [np.zeros(0)] * len(scores)
    for members, live in _blocks([len(s) for s in scores]):
        e = np.zeros((int(live[0]), len(members)))
        for k, i in enumerate(members):
            e[: live[k], k] = scores[i]
        np.exp(np.clip(e, -30, 30, out=e), out=e)
        ahead, back = _sweep(e, live, t)
        for k, i in enumerate(members):
            odds = ahead[: live[k], k] * back[: live[k], k]
            out[i] = odds / (1 + odds)
    return out


class _Batch:
    """Training sequences laid out in blocks once, as word numbers."""

    def __init__(self, index: np.ndarray, labels: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        self.blocks = []
        self.seen = np.zeros((2, 2))
        for members, live in _blocks(lengths.tolist()):
            inside = np.arange(int(live[0]))[:, None] < live[None, :]
            at = np.where(inside, starts[members][None, :] + np.arange(int(live[0]))[:, None], 0)
            y = np.where(inside, labels[at], 0.0)
            pair, a, b = inside[1:], y[:-1], y[1:]
            for i, x in enumerate((1 - a, a)):
                for j, z in enumerate((1 - b, b)):
                    self.seen[i, j] += (x * z * pair).sum()
            self.blocks.append((live, inside, index[at]))

    def expect(self, word: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected toxic tokens by word, and expected transitions."""
        t, odds = np.exp(move), np.exp(np.clip(word, -30, 30))
        by_word, pairs = np.zeros(len(word)), np.zeros((2, 2))
        for live, inside, index in self.blocks:
            e = odds[index]
            ahead, back = _sweep(e, live, t)
            o = np.where(inside, ahead * back, 0.0)
            by_word += np.bincount(index[inside], (o / (1 + o))[inside], len(word))
            pair = inside[1:]
            r, b = np.where(pair, ahead[:-1], 0.0), np.where(pair, e[1:] * back[1:], 0.0)
            ways = np.stack((np.full(r.shape, t[0, 0]), t[0, 1] * b, t[1, 0] * r, t[1, 1] * r * b))
            ways *= pair / ways.sum(axis=0)
            pairs += ways.sum(axis=(1, 2)).reshape(2, 2)
        return by_word, pairs


def train(texts: list[str], toxic: list[int]) -> Field:
    """A field fitted to labelled texts.  Without a toxic one, every score is near zero."""
    tokens = [words_of(t) for t in texts]
    forms = label_forms(tokens, toxic)
    vocabulary: dict[str, int] = {}
    index, labels, starts, lengths, at = [], [], [], [], 0
    marked: dict[str, bool] = {}
    room = {0: FIT, 1: FIT}
    for words, t in zip(tokens, toxic, strict=True):
        if not words or not room[t]:
            continue
        room[t] -= 1
        starts.append(at)
        lengths.append(len(words))
        at += len(words)
        for w in words:
            index.append(vocabulary.setdefault(w, len(vocabulary)))
            if w not in marked:
                marked[w] = not forms.isdisjoint(features(w))
            labels.append(1.0 if t and marked[w] else 0.0)
    if not index:
        return Field({"bias": -8.0}, np.zeros((2, 2)), np.array([-4.0, 2.0, 2.0, 1.0, 0.5]))
    index, labels = np.array(index), np.array(labels)
    starts, lengths = np.array(starts), np.array(lengths)
    # features of each word; those of one word only tell nothing that its beginnings don't
    count: dict[str, int] = defaultdict(int)
    occurs = np.bincount(index, minlength=len(vocabulary))
    listed = [features(w) for w in vocabulary]
    for fs, n in zip(listed, occurs.tolist(), strict=True):
        for f in fs:
            count[f] += n
    names = {"bias": 0}
    rows, columns = [], []
    for i, fs in enumerate(listed):
        rows.append(i)
        columns.append(0)
        for f in fs:
            if count[f] > 1:
                rows.append(i)
                columns.append(names.setdefault(f, len(names)))
    rows, columns = np.array(rows), np.array(columns)
    wanted = np.bincount(index, labels, len(vocabulary))
    batch = _Batch(index, labels, starts, lengths)
    seen = batch.seen
    weights, move = np.zeros(len(names)), np.zeros((2, 2))
    weights[0] = -4.0
    square, square_move = np.full(len(names), 1e-8), np.full((2, 2), 1e-8)
    total = max(1.0, labels.sum())
    for _ in range(ROUNDS):
        word = np.bincount(rows, weights[columns], len(vocabulary))
        by_word, expected = batch.expect(word, move)
        gap = wanted - by_word
        slope = np.bincount(columns, gap[rows], len(names)) / total - RIDGE * weights
        slope_move = (seen - expected) / total - RIDGE * move
        square += slope**2
        square_move += slope_move**2
        weights += RATE * slope / np.sqrt(square)
        move += 0.1 * RATE * slope_move / np.sqrt(square_move)
    kept = sorted(names, key=lambda f: -abs(weights[names[f]]))[:MODEL_WORDS]
    model = Field({f: float(weights[names[f]]) for f in kept if abs(weights[names[f]]) > 1e-3}, move, np.zeros(5))
    has = [i for i, w in enumerate(tokens) if w]
    model.calibration = _logistic(summary(model.tag([texts[i] for i in has])), np.array([toxic[i] for i in has], dtype=float))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Ridge logistic regression by Newton's method, the intercept first."""
    x = np.column_stack((np.ones(len(x)), x))
    w = np.zeros(x.shape[1])
    hold = ridge * np.eye(len(w))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + hold, x.T @ (y - p) - hold @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def training_rows(docs: DataFrame, labels: DataFrame, sample: dict = SAMPLE) -> list[tuple[str, int]]:
    """Labelled texts outside the held-out fold, at most ``sample`` of each label, picked by a hash of doc_id.

    They come in the order of that hash, so their beginning is a sample too.  Rows with a null id, text
    or label are not used; of repeated labels the lowest counts.
    """
    own = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.min("toxic").alias("y"))
    own = own.where(~held_out("doc_id"))
    short = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("t")).where(F.length("t").between(1, SAMPLE_CHARS))
    rows: list[tuple[str, int]] = []
    # the ids are chosen first, on narrow rows; their texts then come by a join with a list of bounded size
    there = cut(short.select("doc_id").join(own, "doc_id").distinct())
    chosen = None
    for y, n in sample.items():
        part = there.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        chosen = part if chosen is None else chosen.unionByName(part)
    picked = short.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("t").alias("t"), F.min("y").alias("y"))
    for r in sorted(picked.withColumn("at", F.xxhash64("doc_id")).collect(), key=lambda r: (r["at"], r["doc_id"])):
        rows.append((r["t"], int(r["y"])))
    return rows


def held_out(column: str) -> Column:
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Field:
    rows = training_rows(docs, labels)
    return train([t for t, _ in rows], [y for _, y in rows])


def _portions(texts: pd.Series, most: int = 2_000_000) -> Iterator[list[str]]:
    part: list[str] = []
    size = 0
    for t in texts:
        part.append(t or "")
        size += len(part[-1])
        if size > most:
            yield part
            part, size = [], 0
    if part:
        yield part


def score_column(spark: SparkSession, model: Field, text: str = "text") -> Column:
    """The score of each whole text; null texts score as empty ones."""
    shipped = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shipped.value
        for texts in batches:
            yield pd.Series(np.concatenate([np.zeros(0), *(own.score(part) for part in _portions(texts))]))
        tidy()

    return score(F.col(text))


SPANS = "array<struct<start: int, stop: int, p: double>>"


def tagged_column(spark: SparkSession, model: Field, text: str = "text") -> Column:
    """The score of each whole text and its toxic spans, in characters: struct(score, spans).

    Both come from one tagging of the text.  Null texts are as empty ones, and have no spans.
    """
    shipped = spark.sparkContext.broadcast(model)

    @F.pandas_udf(f"struct<score: double, spans: {SPANS}>")
    def tagged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shipped.value
        for texts in batches:
            scores, spans = [np.zeros(0)], []
            for part in _portions(texts):
                found = own.tag(part)
                scores.append(own.score(part, found))
                spans += [[{"start": a, "stop": b, "p": p} for a, b, p in own.spans(t, marginal)] for t, marginal in zip(part, found, strict=True)]
            yield pd.DataFrame({"score": np.concatenate(scores), "spans": pd.Series(spans, dtype=object)})
        tidy()

    return tagged(F.col(text))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, as they are.

    Repeated rows and rows of one id are scored each on its own text; null ids are scored like others;
    null and empty texts score as empty ones, near zero.  Without labels nothing scores high.
    """
    model = fit(docs, labels)
    score = free_name(docs, "toxicity")
    return docs.withColumn(score, score_column(docs.sparkSession, model)).where(F.col(score) < threshold).drop(score)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document, and the offsets of the spans that make it up.

    One row per row of the table; null ids are in no fold.  ``spans`` lists (start, stop, p) in characters.
    """
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels)
    scored = docs.select("doc_id", held_out("doc_id").alias("held_out"), tagged_column(spark, model).alias("t"))
    return scored.select("doc_id", "held_out", "t.score", (F.col("t.score") >= THRESHOLD).cast("int").alias("predicted"), "t.spans")
