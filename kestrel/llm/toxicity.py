"""Toxicity of obfuscated text: a noisy channel is undone by Viterbi decoding, then the restored words are scored.

A token is read as a lattice.  A digit or sign that looks like a letter may stand for it (at a token's edge also for
nothing), separators inside a word stand for nothing, a run of three or more equal letters for one or two of them, and
letters spaced out one by one for words: every piece of three characters or more of such a run is read as a word too, so words
before or after it in the run don't hide it (nor does a longer word around it: "c l a s s" has all its pieces).  The path that the channel and a character trigram model like best is the restored
word.  The model counts the trigrams of all words of the whole corpus; its alphabet is fixed, so its size is bounded.

A logistic regression over restored words is fitted on a bounded sample of labelled rows.  When scoring, a token is decoded
only if its skeleton - letters that the channel confuses made equal, runs collapsed, separators gone - is that of a word with
a weight; a token with another skeleton has no path that ends in such a word, so the scores are those of decoding them all.

Defined results.  Null and empty texts get the score of a text without any weighted word.  Repeated rows get equal scores.
Several labels of a document count as toxic if one is; null labels and ids are not learned from.  Without both classes among
the labels the score is the smoothed share of toxic rows.  No rows in, no rows out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import with_arrow

#: What a sign may stand for.
LOOKALIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
#: Letters that some sign may both stand for are one class of the skeleton: b and g by 6, i and l by 1.
SKELETON = {"g": "b", "l": "i"} | {k: {"g": "b", "l": "i"}.get(v[0], v[0]) for k, v in LOOKALIKE.items()}
SEPARATOR = re.compile(r"[^\w@$!|+(€£]|_")
LONG = re.compile(r"(.)\1{3,}", re.DOTALL)
SPACED = re.compile(r"(?<!\S)\S(?:[ \t]\S){2,}(?!\S)")
#: Classes of the trigram model: 0 boundary, 1-26 a-z, 27-58 the letters from U+00DF to U+00FF, 59 any other letter.
CLASSES = 64
#: Costs of the channel (natural logarithms): reading a sign as a letter, dropping a sign, shortening a run.
READ, DROP, SHORTEN = -0.7, -1.6, -0.4
#: Weighted words: how many times as frequent in toxic texts, and the least gain (half of the 5 % point of chi-square).
TIMES, GAIN = 4, 1.92


def classes(text: str) -> np.ndarray:
    """Class of each character; characters that are not letters are boundaries."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.where((c >= 97) & (c <= 122), c - 96, 0)
    out = np.where((c >= 0xDF) & (c <= 0xFF) & (c != 0xF7), c - 0xDF + 27, out)
    return np.where(c > 0x100, 59, out).astype(np.int64)


def trigram_rows(docs: DataFrame) -> DataFrame:
    """(trigram, n) over all words of all texts.  A partition sends at most one row for each trigram it has seen."""

    def run(batches):
        counts = np.zeros(CLASSES**3, np.int64)
        for b in batches:
            seen: Counter[str] = Counter()
            for text in b.column("text").to_pylist():
                if text:
                    seen.update(text.lower().split())
            if not seen:
                continue
            words = list(seen)
            x = classes("  " + "  ".join(words) + "  ")
            n = np.repeat(np.fromiter(seen.values(), np.int64, len(seen)), np.fromiter(map(len, words), np.int64, len(words)) + 2)
            n = np.concatenate([n, np.zeros(2, np.int64)])[: len(x) - 2]
            counts += np.bincount((x[:-2] * CLASSES + x[1:-1]) * CLASSES + x[2:], weights=n, minlength=CLASSES**3).astype(np.int64)
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[found])], names=["trigram", "n"])

    return docs.select("text").mapInArrow(run, "trigram long, n long").groupBy("trigram").agg(F.sum("n").alias("n"))


def char_model(docs: DataFrame) -> np.ndarray:
    """float32[CLASSES, CLASSES, CLASSES] of log P(c | a, b), interpolated with shorter contexts.  1 MB, whatever the corpus."""
    counts = np.zeros(CLASSES**3)
    for r in trigram_rows(docs).collect():  # CLASSES ** 3 rows at most
        counts[r["trigram"]] = r["n"]
    c3 = counts.reshape(CLASSES, CLASSES, CLASSES)
    c2, c1 = c3.sum(axis=0), c3.sum(axis=(0, 1))
    p1 = (c1 + 1) / (c1.sum() + CLASSES)
    p2 = (c2 + 20 * p1) / (c2.sum(axis=1, keepdims=True) + 20)
    p3 = (c3 + 20 * p2[None]) / (c3.sum(axis=2, keepdims=True) + 20)
    return np.log(p3).astype(np.float32)


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """Slots of a token, each with its readings (string, cost).  The token is lower-case."""
    slots: list[list[tuple[str, float]]] = []
    first, last = 0, len(token)
    while first < last and not token[first].isalpha():
        first += 1
    while last > first and not token[last - 1].isalpha():
        last -= 1
    i = 0
    while i < len(token):
        c, j = token[i], i
        while j < len(token) and token[j] == c:
            j += 1
        run = j - i
        if c.isalpha():
            slots.append([(c * run, 0.0)] if run < 3 else [(c, SHORTEN), (c * 2, SHORTEN)])
        elif c in LOOKALIKE:
            reads = [(x * k, READ * (1 if run > 2 else run)) for x in LOOKALIKE[c] for k in ({1, 2} if run > 2 else {run})]
            edge = i < first or i >= last
            slots.append([*reads, ("", DROP * 0.5 if run > 1 else DROP)] if edge else reads)
        i = j
    return slots


def decode(token: str, logp: np.ndarray, most: int | None = None) -> str:
    """The best reading of a lower-case token; of one longer than ``most`` letters only its first ``most`` + 1."""
    end = None if most is None else most + 1
    states: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    for slot in lattice(token):
        nxt: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (score, path) in states.items():
            for read, cost in slot:
                s, x, y = score + cost, a, b
                for k in _class_of(read):
                    s += logp[x, y, k]
                    x, y = y, k
                old = nxt.get((x, y))
                if old is None or s > old[0]:
                    nxt[x, y] = (s, (path + read)[:end])
        states = nxt
    return max((s + float(logp[a, b, 0]), p) for (a, b), (s, p) in states.items())[1]


def _class_of(s: str) -> list[int]:
    out = []
    for c in s:
        o = ord(c)
        out.append(o - 96 if 97 <= o <= 122 else o - 0xDF + 27 if 0xDF <= o <= 0xFF and o != 0xF7 else 59 if o > 0x100 and c.isalpha() else 0)
    return out


def skeletons(token: str, most: int | None = None) -> Iterator[str]:
    """Skeletons of all readings, of ``most`` characters at most: the token with its edges of look-alike signs read or dropped."""
    core = SEPARATOR.sub("", token)
    left, right = 0, len(core)
    while left < right and not core[left].isalpha():
        left += 1
    while right > left and not core[right - 1].isalpha():
        right -= 1
    most = len(core) if most is None else most
    head, middle, tail = _skeleton(core[:left]), _skeleton(core[left:right]), _skeleton(core[right:])
    if not middle:  # no letter at all: every reading or none
        yield ""
        for i in range(len(head)):
            for j in range(i + 1, min(len(head), i + most) + 1):
                yield head[i:j]
    elif len(middle) <= most:  # any part of an edge may be dropped, run by run
        for i in range(max(0, len(head) - most), len(head) + 1):
            for j in range(min(len(tail), most) + 1):
                yield _skeleton(head[i:] + middle + tail[:j])


def _skeleton(s: str) -> str:
    out, before = [], ""
    for c in s:
        c = SKELETON.get(c, c)
        if c != before:
            out.append(c)
        before = c
    return "".join(out)


def tokens(text: str, longest: int = 0) -> list[str]:
    """Lower-case tokens; letters spaced out one by one are also given as one token and as all its pieces that may be a word of
    up to ``longest`` letters."""
    low = text.lower()
    found = low.split()
    for m in SPACED.finditer(low):
        found.append("".join(m.group().split()))
        found.extend(pieces(found[-1], longest))
    return found


def pieces(run: str, longest: int) -> Iterator[str]:
    """Parts of three characters or more of a run.  Each run of equal characters in them is a letter at least."""
    run = LONG.sub(r"\1\1\1", SEPARATOR.sub("", run))
    for i in range(len(run)):
        runs = 0
        for j in range(i, len(run)):
            runs += j == i or run[j] != run[j - 1]
            if runs > longest:
                break
            if j >= i + 2:
                yield run[i : j + 1]


def plain(token: str) -> bool:
    """Has the token a single reading, itself?"""
    return token.isalpha() and not re.search(r"(.)\1\1", token)


@dataclass
class ToxicityModel:
    """``weights`` by restored word, ``bias``, and the character model."""

    logp: np.ndarray
    bias: float = 0.0
    weights: dict[str, float] = field(default_factory=dict)

    def restorer(self, wanted: set[str] | None):
        """token -> restored word, or "" if it can't be one of ``wanted`` (None: all words are wanted)."""
        known: dict[str, str] = {}
        shapes = None if wanted is None else {_skeleton(w) for w in wanted}
        widest = max(map(len, shapes), default=0) if shapes is not None else None
        longest = max(map(len, wanted), default=0) if wanted is not None else None
        edge = re.compile(r"^[^\w@$!|+(€£]+|[^\w@$!|+(€£]+$")
        logp = self.logp

        def restore(token: str) -> str:
            out = known.get(token)
            if out is None:
                if len(known) > 400_000:  # a cache only
                    known.clear()
                bare = edge.sub("", token)
                if not bare:
                    out = ""
                elif plain(bare):
                    out = bare if wanted is None or bare in wanted else ""
                elif shapes is not None and not any(s in shapes for s in skeletons(bare, widest)):
                    out = ""
                else:
                    out = decode(LONG.sub(r"\1\1\1", bare), logp, longest)  # a run of three reads like any longer one
                    out = out if wanted is None or out in wanted else ""
                if len(token) <= 64:
                    known[token] = out
            return out

        return restore

    def scorer(self):
        """text -> (score, restored words that carry weight)."""
        restore, weights, bias = self.restorer(set(self.weights)), self.weights, self.bias
        longest = max(map(len, weights), default=0)

        def score(text: str | None) -> tuple[float, list[str]]:
            hits = sorted({restore(t) for t in set(tokens(text, longest))} - {""}) if text else []
            z = bias + sum(weights[w] for w in hits)
            return 1 / (1 + math.exp(-max(-60.0, min(60.0, z)))), hits

        return score


def restored(docs: DataFrame, model: ToxicityModel, wanted: set[str] | None) -> DataFrame:
    """``docs`` with ``words``: the distinct restored words of each text."""

    def make():
        restore = model.restorer(wanted)
        longest = max(map(len, wanted or ()), default=0)

        def step(batch: pa.RecordBatch) -> list[pa.Array]:
            out = [sorted({restore(t) for t in set(tokens(x, longest))} - {""}) if x else [] for x in batch.column("text").to_pylist()]
            return [pa.array(out, pa.list_(pa.string()))]

        return step

    return with_arrow(docs, make, [T.StructField("words", T.ArrayType(T.StringType()), False)])


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, sample_rows: int = 20_000, vocabulary: int = 512, penalty: float = 0.05) -> ToxicityModel:
    """Character model over all of ``docs``; weights from at most ``sample_rows`` labelled rows (doc_id, toxic), those whose ids
    hash lowest, over at most ``vocabulary`` words that tell the classes apart best."""
    model = ToxicityModel(char_model(docs))
    rows = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = rows.filter(usable) if usable is not None else rows
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    train = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id")  # sample_rows rows of two numbers
    words = restored(train, model, None).select("toxic", "words")
    totals = {r[0]: r[1] for r in train.groupBy("toxic").count().collect()}
    pos, neg = sum(n for k, n in totals.items() if k), sum(n for k, n in totals.items() if not k)
    model.bias = math.log((pos + 1) / (neg + 1))
    if not pos or not neg:
        return model
    counts = words.select(F.explode("words").alias("w"), (F.col("toxic") > 0).cast("long").alias("t")).groupBy("w").agg(F.sum("t").alias("p"), F.count("*").alias("n"))
    p, n = F.col("p").cast("double"), F.col("n").cast("double")
    expected = n * (pos / (pos + neg))
    gain = p * F.ln((p + 0.5) / (expected + 0.5)) + (n - p) * F.ln((n - p + 0.5) / (n - expected + 0.5))
    # a word must be TIMES as frequent in toxic texts as in others, which any share of the classes allows
    best = counts.filter((F.col("p") >= 3) & (p * neg > TIMES * (n - p) * pos)).withColumn("g", gain).filter(F.col("g") > GAIN).orderBy(F.desc("g"), "w").limit(vocabulary).collect()
    names = [r["w"] for r in best]
    if not names:
        return model
    at = {w: i for i, w in enumerate(names)}
    seen = restored(train, model, set(names)).select((F.col("toxic") > 0).cast("int").alias("y"), "words").collect()  # sample_rows rows
    x, y = np.zeros((len(seen), len(names) + 1)), np.array([r["y"] for r in seen], float)
    x[:, -1] = 1
    for i, r in enumerate(seen):
        x[i, [at[w] for w in r["words"]]] = 1
    beta = np.zeros(x.shape[1])
    beta[-1] = model.bias
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(25):  # Newton steps
        mu = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (y - mu) - ridge * beta
        hess = (x * (mu * (1 - mu))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hess, grad)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    model.bias = float(beta[-1])
    model.weights = {w: round(float(b), 6) for w, b in zip(names, beta, strict=False) if b > 0.05}
    return model


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs`` with score, predicted and hits (the restored words that carry weight).  Only ``text`` is looked at."""

    def make():
        rate = model.scorer()

        def step(batch: pa.RecordBatch) -> list[pa.Array]:
            found = [rate(t) for t in batch.column("text").to_pylist()]
            return [pa.array([s for s, _ in found], pa.float64()), pa.array([int(s >= 0.5) for s, _ in found], pa.int32()), pa.array([h for _, h in found], pa.list_(pa.string()))]

        return step

    return with_arrow(docs, make, [T.StructField("score", T.DoubleType(), False), T.StructField("predicted", T.IntegerType(), False), T.StructField("hits", T.ArrayType(T.StringType()), False)])
