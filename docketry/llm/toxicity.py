"""Toxicity with noisy-channel deobfuscation.

Writers hide words by leetspeak, by spacing or separators between letters and by repeated letters. Every token of a
text, and every run of tokens of one letter each, spans a lattice: each character is a letter that it may stand for, a
repeat of the letter before, a break between words, or nothing. A character trigram model, counted over all documents
and mixed with the trigrams of the learned words, picks the path (Viterbi). What is scored, by a logistic model, is
the restored text: the learned stems with which its words begin, some of which count wherever they stand, and some where
many words begin with them. Letters are a to z, accents are folded; others break
words.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.quality import is_held_out, labelled, one_of_each_id

#: Labelled rows to learn from at most, least documents with a stem, least log-odds for it, and the evidence asked for
#: beyond what chance gives. A stem is dense in a text in which one of so many words begins with it; the number that tells most is learned.
TRAINING_ROWS, LEAST_DOCS, LEAST_ODDS, CHANCE, DENSE = 20_000, 3, 2.0, 4.0, (200, 140, 90, 50)
THRESHOLD = 0.7

#: Letters that a character may stand for.
STANDS_FOR = {"0": "o", "1": "il", "!": "il", "|": "il", "3": "e", "4": "a", "@": "a", "5": "s", "$": "s", "7": "t", "+": "t", "8": "b", "6": "g", "9": "g", "2": "z", "€": "e", "£": "l", "*": "aeiou"}
#: Costs (negative log probabilities) of a substitution, a repeated letter that is dropped and a separator that is dropped.
SUBSTITUTED, REPEATED, SEPARATED = 1.0, 0.3, 0.5

#: Letters with accents and what they are read as.
ACCENTED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿß", "aaaaaaceeeeiiiinooooouuuuyys"


class Fold(dict):
    """What str.translate asks: beyond ASCII, white space is a blank and all but letters, digits and what stands for them a hyphen."""

    def __missing__(self, code: int) -> int:
        c = chr(code)
        self[code] = code if code < 128 or c.isalnum() or c in STANDS_FOR else ord(" " if c.isspace() else "-")
        return self[code]


FOLD = Fold(str.maketrans(ACCENTED, PLAIN))
#: Letters of a learned stem.
SHORTEST, LONGEST = 4, 8

LETTERS = "abcdefghijklmnopqrstuvwxyz"
N = len(LETTERS) + 1  # 0: anything else
#: What each letter or stand-in may be: (letter's number, cost). All other characters are separators.
OPTIONS = {c: ((k, 0.0),) for k, c in enumerate(LETTERS, 1)} | {c: tuple((LETTERS.index(x) + 1, SUBSTITUTED) for x in of) for c, of in STANDS_FOR.items()}
#: A mark of these stands for a letter only before a letter or digit.
LOOSE = re.compile(r"[!|$+@]++(?![a-z0-9])")
DOUBLED = re.compile(r"(.)\1")
EDGES = "".join(chr(i) for i in range(33, 128) if not chr(i).isalnum() and chr(i) not in "@$+|") + "€£"


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of letter trigrams (a-z, all else one symbol) over every whole text, N x N x N.

    Each task sends its sums, one row for each trigram that it saw; texts never share a trigram.
    """
    code = np.zeros(256, np.int64)
    for i, c in enumerate(LETTERS):
        code[ord(c)] = code[ord(c.upper())] = i + 1

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(N**3, np.int64)
        for batch in batches:
            for text in batch.column(0):
                c = code[np.frombuffer(f"  {text.as_py() or ''}  ".encode(), np.uint8)]
                total += np.bincount(c[:-2] * N * N + c[1:-1] * N + c[2:], minlength=N**3)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["gram", "n"])

    rows = docs.select("text").mapInArrow(counted, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).collect()  # N ** 3 at most
    counts = np.zeros(N**3)
    for r in rows:
        counts[r["gram"]] = r["n"]
    return counts.reshape(N, N, N)


def folded(text: str | None) -> str:
    low = (text or "").lower()
    return low if low.isascii() else low.translate(FOLD)


def stems_of(train: DataFrame) -> DataFrame:
    """(doc_id, y, word, dense) of every beginning, SHORTEST to LONGEST letters long, of a text's words, and how many of the densities it reaches there."""

    def beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, y, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                low = folded(text)
                counts: dict[str, int] = {}
                for word in re.findall(f"[a-z]{{{SHORTEST},}}", low):
                    for k in range(SHORTEST, min(LONGEST, len(word)) + 1):
                        counts[word[:k]] = counts.get(word[:k], 0) + 1
                n = len(low.split())
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(counts), pa.int64()), pa.array([y] * len(counts), pa.float64()), pa.array(list(counts), pa.string()), pa.array([sum(c * d >= n for d in DENSE) for c in counts.values()], pa.int32())], names=["doc_id", "y", "word", "dense"])

    return train.select(F.col("doc_id").cast("long"), F.col("y").cast("double"), "text").mapInArrow(beginnings, "doc_id bigint, y double, word string, dense int")


def learned_stems(train: DataFrame) -> tuple[dict[str, float], dict[str, tuple[float, int]]]:
    """Stems whose presence, and stems whose density, speaks for the label: all that pass the limits above. With their
    smoothed log-odds; dense ones with one in how many words they must be, too.

    An id's rows count together. Of stems that begin with one another, the one with most evidence is taken, the
    longest of equal ones, and presence before density. As each stands in LEAST_DOCS of the labelled rows, these bound
    how many come to the driver.
    """
    sizes = train.groupBy("doc_id").agg(F.max("y").alias("y")).agg(F.sum("y").alias("yes"), F.count(F.lit(1)).alias("all")).first()
    yes, no = sizes["yes"] or 0.0, sizes["all"] - (sizes["yes"] or 0.0)
    by = stems_of(train).groupBy("word", "doc_id").agg(F.max("y").alias("y"), F.max("dense").alias("dense"))
    by = by.select("y", "word", F.explode(F.sequence(F.lit(0), "dense")).alias("dense"))
    by = by.groupBy("word", "dense").agg(F.sum("y").alias("yes"), F.sum(1 - F.col("y")).alias("no"))
    seen = by.count()
    odds = F.log((F.col("yes") + 0.5) / (yes + 1)) - F.log((F.col("no") + 0.5) / (no + 1))
    # Twice the log-likelihood gained over independence: of as many words as were seen, few reach the limit by chance.
    df, share = F.col("yes") + F.col("no"), yes / max(1.0, yes + no)
    part = lambda n, s: F.when(n > 0, n * F.log(n / (df * s))).otherwise(0.0)
    gain = 2 * (part(F.col("yes"), share) + part(F.col("no"), 1 - share)) if 0 < share < 1 else F.lit(0.0)
    top = by.where((F.col("yes") >= LEAST_DOCS) & (odds >= LEAST_ODDS) & (gain >= 2 * math.log(max(1, seen)) + CHANCE)).select("word", "dense", odds.alias("odds"), gain.alias("gain"))
    taken: tuple[dict[str, float], dict[str, tuple[float, int]]] = ({}, {})
    barred: set[str] = set()  # beginnings of stems that were taken
    for r in top.orderBy(F.round("gain", 6).desc(), F.length("word").desc(), "dense", "word").collect():
        begins = [r["word"][:k] for k in range(SHORTEST, len(r["word"]) + 1)]
        if r["word"] not in barred and taken[0].keys().isdisjoint(begins) and taken[1].keys().isdisjoint(begins):
            if r["dense"]:
                taken[1][r["word"]] = (r["odds"], DENSE[r["dense"] - 1])
            else:
                taken[0][r["word"]] = r["odds"]
            barred.update(begins)
    return taken


@dataclass
class Model:
    """What executors need to score: learned stems, by presence and by density, the character model's log-probabilities, logistic weights."""

    words: dict[str, float]
    chars: np.ndarray
    weights: np.ndarray | None = None
    base: float = 0.0
    dense: dict[str, tuple[float, int]] = field(default_factory=dict)
    known: dict = field(default_factory=dict)

    def __post_init__(self):
        self.cost = (-self.chars).reshape(N * N, N).tolist()
        self.stems = self.words.keys() | self.dense.keys()
        self.heads = {w[:SHORTEST] for w in self.stems}

    def __getstate__(self):
        return {"words": self.words, "chars": self.chars, "weights": self.weights, "base": self.base, "dense": self.dense, "known": {}}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def best(self, token: str) -> tuple[float, str]:
        """(cost, words) of the likeliest path through the lattice of a string's characters: Viterbi, whose states are
        the last two letters. A path is a chain of letters, so that its length costs nothing."""
        loose = {i for m in LOOSE.finditer(token) for i in range(*m.span())} if not token.isalnum() else ()
        now: dict[int, tuple] = {0: (0.0, None)}
        for i, c in enumerate(token):
            options = () if i in loose else OPTIONS.get(c, ())
            letter = "a" <= c <= "z"
            after: dict[int, tuple] = {}
            for state, (cost, path) in now.items():
                own, b = self.cost[state], state % N
                for k, paid in options:
                    to, total = b * N + k, cost + paid + own[k]
                    if to not in after or total < after[to][0]:
                        after[to] = (total, (path, k))
                    if k == b:
                        total = cost + paid + REPEATED
                        if state not in after or total < after[state][0]:
                            after[state] = (total, path)
                if not letter:
                    total = cost + (SEPARATED + SUBSTITUTED if options else SEPARATED) if b else cost
                    if state not in after or total < after[state][0]:
                        after[state] = (total, path)
                    if b:
                        to, total = b * N, cost + own[0]
                        if to not in after or total < after[to][0]:
                            after[to] = (total, (path, 0))
            now = after
        cost, path = min(((cost + self.cost[state][0] if state % N else cost, path) for state, (cost, path) in now.items()), key=lambda x: x[0])
        out = []
        while path is not None:
            path, k = path
            out.append(LETTERS[k - 1] if k else " ")
        return cost, "".join(reversed(out)).strip()

    def decode(self, token: str) -> str:
        """The likeliest words that a token hides. Letters of which no two neighbours are equal have one path only."""
        if token.isalpha() and token.isascii() and not DOUBLED.search(token):
            return token
        return self.best(token)[1]

    def stem(self, word: str) -> str | None:
        """The learned stem with which a word begins."""
        return next((word[:k] for k in range(SHORTEST, min(LONGEST, len(word)) + 1) if word[:k] in self.stems), None)

    def look(self, token: str) -> tuple | str:
        """Learned stems of a token as (stem, token without marks at its ends, word): those of its restored words, and
        those of its words as they stand, which an apostrophe or a hyphen sets off. Of a single letter, the letter."""
        bare = token.strip(EDGES)
        if len(bare) < SHORTEST:
            return bare if len(bare) == 1 and len(token) < SHORTEST else ()
        if bare.isalpha() and bare.isascii():
            words = [bare, self.best(bare)[1]] if DOUBLED.search(bare) else [bare]
        else:
            words = re.findall("[a-z]+", bare)
            words += self.best(bare)[1].split() if words else []
        found: dict[str, str] = {}
        for word in words:
            if word[:SHORTEST] in self.heads and (stem := self.stem(word)) and stem not in found:
                found[stem] = word
        return tuple((stem, bare, word) for stem, word in found.items())

    def run(self, single: list[str]) -> list[tuple]:
        """The same of a run of tokens of one letter each, as one lattice; a stem counts wherever it begins there."""
        token = " ".join(single)
        word = self.best(token)[1].replace(" ", "")
        out, at = [], 0
        while at + SHORTEST <= len(word):
            stem = self.stem(word[at : at + LONGEST])
            if stem:
                out.append((stem, token, stem))
                at += len(stem) - 1
            at += 1
        return out

    def hits(self, text: str | None) -> tuple[dict[str, int], list[tuple[str, str]]]:
        """How often each learned stem stands in the restored text; and the restored words as (token, word)."""
        found: dict[str, int] = {}
        restored: list[tuple[str, str]] = []
        if not self.stems:
            return found, restored
        tokens = folded(text).split()
        known = self.known
        got = list(map(known.get, tokens))
        if None in got:
            if len(known) > 1 << 20:
                known.clear()
            for token in {t for t, own in zip(tokens, got, strict=True) if own is None}:
                known[token] = self.look(token)
            got = list(map(known.get, tokens))
        every: list[tuple] = []
        runs: list[list[str]] = []
        last = -2
        for i, own in enumerate(got):
            if not own:
                continue
            if isinstance(own, str):
                if i != last + 1:
                    runs.append([])
                runs[-1].append(own)
                last = i
            else:
                every += own
        for run in runs:
            if len(run) > 2:
                every += self.run(run)
        for stem, token, word in every:
            found[stem] = found.get(stem, 0) + 1
            if word != token:
                restored.append((token, word))
        return found, restored

    def measures(self, text: str | None) -> list[float]:
        """What the logistic model weighs: of stems by presence their odds, numbers and share, of dense ones their odds and share, and how many words were hidden."""
        found, restored = self.hits(text)
        by_presence = {w: n for w, n in found.items() if w in self.words}
        odds = [self.words[w] for w in by_presence]
        n = sum(by_presence.values())
        tokens = len(folded(text).split()) if len(by_presence) < len(found) else 0
        dense = [self.dense[w][0] for w, c in found.items() if w in self.dense and c * self.dense[w][1] >= tokens]
        return [
            sum(odds), max(odds, default=0.0), math.log1p(n), float(len(odds)), math.log1p(len(restored)), 100 * n / (1 + len(text or "") / 6),
            sum(dense), math.log1p(1000 * (sum(found.values()) - n) / max(1, tokens)),
        ]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.base + (x @ self.weights if self.weights is not None else np.zeros(len(x))), -30, 30)))


def character_model(counts: np.ndarray, words: Iterable[str]) -> np.ndarray:
    """Log-probability of a letter after two: the corpus and the learned words in equal parts, each smoothed."""
    own = np.zeros((N, N, N))
    for w in words:
        c = [0, 0, *(LETTERS.index(x) + 1 for x in w), *([0] if len(w) < LONGEST else [])]
        for g in zip(c, c[1:], c[2:], strict=False):
            own[g] += 1
    smooth = lambda t: (t + 0.01) / (t + 0.01).sum(2, keepdims=True)
    return np.log(0.5 * smooth(counts) + 0.5 * smooth(own))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> tuple[np.ndarray, float]:
    """Weights and intercept by Newton's method."""
    z = np.concatenate([x, np.ones((len(x), 1))], 1)
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        penalty = np.append(np.full(len(w) - 1, ridge), 1e-6)
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9), z.T @ (y - p) - penalty * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> Model:
    """A model of `toxic`: words and weights from at most `rows` labelled rows, characters from all documents."""
    own = labelled(docs, labels, "toxic", 3, 1, rows)
    words, dense = learned_stems(own)
    model = Model(words, character_model(trigram_counts(docs), words.keys() | dense.keys()), dense=dense)

    @F.pandas_udf("array<double>")
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(model.measures)

    got = one_of_each_id(own.select("doc_id", "y", measured("text").alias("x"))).toPandas().sort_values("doc_id", kind="stable")
    y = got["y"].to_numpy(float)
    model.base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    if model.stems and len(np.unique(y)) == 2:
        model.weights, model.base = logistic(np.array(got["x"].tolist(), float), y)
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of `docs` plus `_score`, which replaces a column of that name."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.score(np.array([model.measures(t) for t in texts], float).reshape(len(texts), -1)) if len(texts) else [], dtype=float)

    return docs.withColumn("_score", score("text"))


def restored_words(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, token, word) for each token that hides a learned word."""

    @F.pandas_udf("array<struct<token:string,word:string>>")
    def restored(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"token": a, "word": b} for a, b in model.hits(t)[1]])

    return docs.select("doc_id", F.explode(restored("text")).alias("r")).select("doc_id", "r.token", "r.word")


def restored_texts(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, restored) of every row: the likeliest words of each token of its whole text, blank-joined; null text: empty."""

    @F.pandas_udf("string")
    def restored(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: " ".join(filter(None, (model.decode(x.strip(EDGES)) for x in folded(t).split()))))

    return docs.select("doc_id", restored("text").alias("restored"))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: (doc_id, held_out, score, predicted). Null and empty texts get a score like any other.

    Only labels of doc_ids outside the held-out fold are learned; without any the score is the same for all.
    Empty in, empty out.
    """
    found = scored(docs.select("doc_id", "text"), train(docs, labels))
    return found.select("doc_id", is_held_out(3, 1).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))
