"""Toxicity of whole texts: a gapped-subsequence kernel with landmarks, and a linear machine on it."""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwork.llm.common import Buffer, held_out, kept_model, map_rows, mask_of, masked, sized_batches, unmasked
from leafwork.session import staged

GAP = 3  # largest step between letters of a subsequence; up to two inserted characters are passed over
DECAY = 0.8  # weight of a subsequence per character it spans
CUT = 0.45  # smaller similarities count as none
POWER = 3  # a power of a kernel is a kernel; this one sets close matches apart from common syllables
PIECE = 32  # bytes of a word compared at once; longer words are compared window by window
DISGUISED = 0.25  # weight of a disguised text when scores are calibrated
TOP = 3  # highest sentences of a text that make its score
SENTENCES = 6  # sentences of a text that the machine learns from
KNOWN, NEAR = 1_500_000, 40_000  # words a task remembers, and similar ones of them

_LETTER = np.zeros(256, np.int64)  # 0: no letter, is left out
_LETTER[ord("a") : ord("z") + 1] = np.arange(1, 27)
_LETTER[ord("0") : ord("9") + 1] = np.arange(27, 37)
_LETTER[128:] = 37 + np.arange(128) % 26
START = 1  # byte set before a word, so that its beginning is part of its subsequences
_LETTER[START] = 63


# -- the kernel -------------------------------------------------------------------------------


def subsequences(raw: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of strings laid end to end: (string, subsequence, weight), equal ones added up.

    A feature is three letters in order with steps of at most GAP; its weight is DECAY to the power
    of the characters it spans. `owner` is the string of each byte.
    """
    letters = _LETTER[raw]
    keys, weights = [], []
    for first in range(1, GAP + 1):
        for second in range(1, GAP + 1):
            span = first + second
            if len(raw) <= span:
                continue
            a, b, c = letters[:-span], letters[first : len(raw) - second], letters[span:]
            held = np.flatnonzero((a > 0) & (b > 0) & (c > 0) & (owner[:-span] == owner[span:]))
            keys.append((owner[held] << 18) | (a[held] << 12) | (b[held] << 6) | c[held])
            weights.append(np.full(len(held), DECAY ** (span + 1)))
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return key >> 18, key & 0x3FFFF, np.bincount(inverse, np.concatenate(weights), len(key))


@dataclass
class Landmarks:
    """Strings that others are compared with, as a table of their features."""

    words: list[str]
    table: np.ndarray = field(init=False)  # feature -> row of `values`, or -1
    values: np.ndarray = field(init=False)
    entries: tuple[np.ndarray, np.ndarray, np.ndarray] = field(init=False)  # of `values` but zeros: edges of rows, columns, numbers

    def __post_init__(self) -> None:
        encoded = [bytes([START]) + w.encode() for w in self.words]
        owner = np.repeat(np.arange(len(encoded)), [len(e) for e in encoded])
        of, feature, weight = subsequences(np.frombuffer(b"".join(encoded), np.uint8), owner)
        found, row = np.unique(feature, return_inverse=True)
        self.table = np.full(1 << 18, -1, np.int32)
        self.table[found] = np.arange(len(found))
        self.values = np.zeros((len(found), len(encoded)), np.float32)
        self.values[row, of] = weight
        norm = np.sqrt((self.values**2).sum(axis=0))
        self.values /= np.where(norm > 0, norm, 1)
        row, of = np.nonzero(self.values)
        self.entries = np.searchsorted(row, np.arange(len(found) + 1)), of, self.values[row, of].astype(float)

    def _close(self, string: np.ndarray, row: np.ndarray, weight: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """Which strings, by number from 0, reach nearly CUT with any landmark; strings are in order.

        A feature is in few landmarks, so only the products that are not 0 are made and added up.
        """
        edges, of, value = self.entries
        close = np.zeros(len(norm), bool)
        width = len(self.words)
        for a in range(0, len(norm), 1024):
            b = min(len(norm), a + 1024)
            part = slice(*np.searchsorted(string, [a, b]))
            at, count = edges[row[part]], np.diff(edges)[row[part]]
            first = np.cumsum(count) - count
            at = np.repeat(at - first, count) + np.arange(count.sum())
            cell = np.repeat((string[part] - a) * width, count) + of[at]
            dot = np.bincount(cell, np.repeat(weight[part], count) * value[at], (b - a) * width).reshape(-1, width)
            close[a:b] = dot.max(axis=1) >= CUT * (1 - 1e-3) * np.sqrt(norm[a:b])
        return close

    def similarities(self, raw: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Strings that are similar to any landmark, and their normalised kernel values.

        A string whose features in the table hold too small a part of its norm cannot reach CUT with
        any landmark (Cauchy-Schwarz). Of the others those that come close to it are found by sparse
        sums, and the kernel with all landmarks is worked out for these alone.
        """
        of, feature, weight = subsequences(raw, owner)
        row = self.table[feature]
        norm = np.bincount(of, weight**2, n)
        known = row >= 0
        shared = np.bincount(of[known], weight[known] ** 2, n)
        able = (shared >= CUT**2 * norm) & (norm > 0)
        pick = np.flatnonzero(known & able[of])
        able = np.flatnonzero(able)  # all of them have features in the table
        close = self._close(np.searchsorted(able, of[pick]), row[pick], weight[pick], norm[able])
        pick = pick[np.isin(of[pick], able[close])]
        if not len(pick):
            return np.zeros(0, np.int64), np.zeros((0, len(self.words)), np.float32)
        names, first = np.unique(of[pick], return_index=True)
        out = np.zeros((len(names), len(self.words)), np.float32)
        for a in range(0, len(names), 4096):
            b = min(len(names), a + 4096)
            part = pick[first[a] : first[b] if b < len(names) else len(pick)]
            out[a:b] = np.add.reduceat(self.values[row[part]] * weight[part, None].astype(np.float32), first[a:b] - first[a])
        out /= np.sqrt(norm[names])[:, None]
        out[out < CUT] = 0
        near = out.any(axis=1)
        return names[near], out[near] ** POWER


def _words_of(buffer: Buffer) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, text and sentence of each word.

    Three or more words of one letter in a row ("i d i o t") are one word that spans them. A sentence
    ends at a word that ends in a full stop, an exclamation or a question mark, and with the line.
    """
    start, end, row = buffer.word_start, buffer.word_end, buffer.row
    if not len(start):
        return start, end, row, row
    last = buffer.bytes[end - 1]
    breaks = np.concatenate([[0], np.cumsum(buffer.bytes == 10)])
    line = breaks[start]
    stop = (last == 46) | (last == 33) | (last == 63)
    sentence = np.concatenate([[0], np.cumsum(stop)[:-1]]) + line
    single = (end - start == 1) & (_LETTER[buffer.bytes[start]] > 0)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], single.astype(np.int8), [0]])))
    runs = [(a, b) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) if b - a >= 3]
    for a, b in runs:  # the same text only
        while a < b:
            stop_at = a + int(np.searchsorted(row[a:b], row[a], side="right"))
            if stop_at - a >= 3:
                start, end = np.append(start, start[a]), np.append(end, end[stop_at - 1])
                row, sentence = np.append(row, row[a]), np.append(sentence, sentence[a])
            a = stop_at
    return start, end, row, sentence


class Matcher:
    """Compares the words of texts with landmarks and remembers the words it has seen."""

    def __init__(self, landmarks: Landmarks):
        self.landmarks = landmarks
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.place = np.zeros(0, np.int32)  # row of `near`, or -1
        self.near = np.zeros((0, len(self.landmarks.words)), np.float16)

    def _places(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The row of `near` that each word gets, or -1."""
        start = start.copy()
        for _ in range(PIECE):  # punctuation before a word is not its beginning
            skip = (_LETTER[raw[start]] == 0) & (start < end - 1)
            if not skip.any():
                break
            start += skip
        # windows of PIECE bytes, half over each other, so that no place of a long word is left out
        count = np.maximum(1, -(-(end - start - PIECE // 2) // (PIECE // 2)))
        owner = np.repeat(np.arange(len(start)), count)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        a = start[owner] + step * (PIECE // 2)
        size = np.minimum(a + PIECE, end[owner]) - a + 1
        first = np.cumsum(size) - size
        flat = raw[np.maximum(np.repeat(a - 1 - first, size) + np.arange(size.sum()), 0)]
        flat[first] = np.where(step == 0, START, 32)  # only the first window has the beginning
        # marks between the letters of a word do not count, not even as a gap
        held = _LETTER[flat] > 0
        names, values = self.landmarks.similarities(flat[held], np.repeat(np.arange(len(a)), size)[held], len(a))
        place = np.full(len(start), -1, np.int32)
        if len(names):
            words, first = np.unique(owner[names], return_index=True)
            place[words] = len(self.near) + np.arange(len(words))
            self.near = np.concatenate([self.near, np.maximum.reduceat(values, first).astype(np.float16)])
        return place

    def sentences(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Text and best similarities of each sentence that has a word similar to any landmark."""
        empty = np.zeros(0, np.int64), np.zeros((0, len(self.landmarks.words)), np.float32)
        buffer = Buffer(texts, lower=True)
        start, end, row, sentence = _words_of(buffer)
        if not len(start):
            return empty
        if len(self.known) > KNOWN or len(self.near) > NEAR:
            self.forget()
        hashed = buffer.hashes(start, end)
        words, first, inverse = np.unique(hashed, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, words)
        new = np.flatnonzero(self.known[np.minimum(at, len(self.known) - 1)] != words) if len(self.known) else np.arange(len(words))
        places = [self.place]
        for a in range(0, len(new), 15_000):
            pick = first[new[a : a + 15_000]]
            places.append(self._places(buffer.bytes, start[pick], end[pick]))
        if len(new):
            known = np.concatenate([self.known, words[new]])
            order = np.argsort(known, kind="stable")
            self.known, self.place = known[order], np.concatenate(places)[order]
        place = self.place[np.searchsorted(self.known, words)][inverse]
        hits = np.flatnonzero(place >= 0)
        if not len(hits):
            return empty
        hits = hits[np.lexsort((sentence[hits], row[hits]))]
        new_sentence = np.concatenate([[True], (np.diff(sentence[hits]) != 0) | (np.diff(row[hits]) != 0)])
        first = np.flatnonzero(new_sentence)
        out = np.zeros((len(first), len(self.landmarks.words)), np.float32)
        edges = np.append(first, len(hits))
        for a in range(0, len(first), 2_000):
            b = min(len(first), a + 2_000)
            part = hits[edges[a] : edges[b]]
            out[a:b] = np.maximum.reduceat(self.near[place[part]], first[a:b] - first[a])
        return row[hits[first]], out


# -- the machine ------------------------------------------------------------------------------


@dataclass
class Machine:
    """A linear machine over sentences in the space of the landmarks, calibrated for whole texts.

    `weights` include the Nyström map, so a sentence's value is its similarities times them. `slopes`
    weigh a text's highest sentences.
    """

    landmarks: list[str]
    weights: np.ndarray
    bias: float
    slopes: np.ndarray
    shift: float

    def scores(self, n: int, rows: np.ndarray, similar: np.ndarray) -> np.ndarray:
        """Score of each of n texts from its most toxic sentences."""
        top = highest(n, rows, similar @ self.weights + self.bias, self.bias)
        return 1 / (1 + np.exp(-np.clip(top @ self.slopes + self.shift, -40, 40)))


def highest(n: int, rows: np.ndarray, value: np.ndarray, least: float) -> np.ndarray:
    """The TOP highest values of each of n texts, `least` where a text has no more sentences or lower ones."""
    out = np.full((n, TOP), least)
    order = np.lexsort((-value, rows))
    ranked = rows[order]
    rank = np.arange(len(order)) - np.searchsorted(ranked, ranked)
    kept = rank < TOP
    out[ranked[kept], rank[kept]] = np.maximum(value[order][kept], least)
    return out


def nystroem(landmarks: Landmarks, ridge: float = 1e-3) -> np.ndarray:
    """The inverse square root of the kernel among landmarks."""
    kernel = (landmarks.values.T.astype(float) @ landmarks.values) ** POWER
    value, vector = np.linalg.eigh(kernel + ridge * np.eye(len(kernel)))
    return (vector / np.sqrt(np.maximum(value, ridge))) @ vector.T


def fit_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 10.0, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Linear support vector machine with squared hinge loss (y is -1 or 1), by Newton steps."""
    x1 = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x1.shape[1])
    penalty = np.ones(len(w))
    penalty[-1] = 1e-3

    def loss(w: np.ndarray) -> float:
        return 0.5 * (penalty * w * w).sum() + c * (weight * np.maximum(0, 1 - y * (x1 @ w)) ** 2).sum()

    for _ in range(rounds):
        slack = 1 - y * (x1 @ w)
        held = slack > 0
        a = x1[held] * (weight[held] * 2 * c)[:, None]
        gradient = penalty * w - (a * (y[held] * slack[held])[:, None]).sum(axis=0)
        step = np.linalg.solve(a.T @ x1[held] + np.diag(penalty), gradient)
        rate, now = 1.0, loss(w)
        while loss(w - rate * step) > now and rate > 1e-6:
            rate /= 2
        w = w - rate * step
        if np.abs(rate * step).max() < 1e-7:
            break
    return w[:-1], float(w[-1])


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, float]:
    """Slopes and shift of a logistic curve from values to the chance of label 1 (smoothed targets)."""
    positive, negative = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (positive + 1) / (positive + 2), 1 / (negative + 2))
    x = np.column_stack([x, np.ones(len(x))])
    w, ridge = np.zeros(x.shape[1]), 1e-2 * np.eye(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weight * (p - target)) + ridge @ w)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return w[:-1], float(w[-1])


_LONG = re.compile(r"[^\W\d_]{5,}")


def disguised(text: str) -> str:
    """The text with a character inserted into each longer word, as evasive spelling does."""
    r = random.Random(zlib.crc32(text.encode("utf-8", "surrogatepass")))

    def insert(m: re.Match) -> str:
        at = r.randint(1, len(m.group()) - 1)
        return m.group()[:at] + r.choice("xzqkj019") + m.group()[at:]

    return _LONG.sub(insert, text)


# -- learning ---------------------------------------------------------------------------------


def labelled(docs: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """About `limit` labelled documents of the learning folds, picked by hash, with text and toxic.

    A document with several labels counts as toxic if any says so; null labels don't count.
    """
    marks = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    marks = staged(marks.where(~held_out(F.col("doc_id"))))
    share = limit / max(1, marks.count())
    if share < 1:
        marks = marks.where(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 30)) < int(share * (1 << 30)))
    return staged(docs.select("doc_id", "text").where("text is not null").join(marks, "doc_id").select("text", "toxic"))


def apart(strings: list[str], count: int, limit: float = 0.8) -> list[int]:
    """The first `count` strings, by number, whose similarity with every one taken before is below `limit`.

    Strings without a feature are passed over. The features of thousands of strings are held one by one,
    as a table of them would take more memory than anything else in the driver.
    """
    if not strings:
        return []
    encoded = [bytes([START]) + s.encode() for s in strings]
    owner = np.repeat(np.arange(len(encoded)), [len(e) for e in encoded])
    of, feature, weight = subsequences(np.frombuffer(b"".join(encoded), np.uint8), owner)
    weight = weight.astype(np.float32)
    norm = np.sqrt(np.bincount(of, weight**2, len(strings)))
    edges = np.searchsorted(of, np.arange(len(strings) + 1))  # features lie by string
    value = weight / norm[of]
    one = np.zeros(1 << 18)
    free = np.ones(len(strings), bool)
    taken: list[int] = []
    for i in range(len(strings)):
        if len(taken) == count:
            break
        a, b = edges[i], edges[i + 1]
        if free[i] and a < b:
            taken.append(i)
            one[feature[a:b]] = value[a:b]
            free &= np.bincount(of, value * one[feature], len(strings)) < limit
            one[feature[a:b]] = 0
    return taken


def pick_landmarks(sample: DataFrame, count: int, contrast: int, candidates: int = 4000) -> tuple[list[str], list[str]]:
    """Words and beginnings of words that tell toxic texts from others, and the like of them in other texts.

    Texts per string are counted by Spark, rare strings fall out; the driver gets the `candidates` strings with the largest
    evidence and passes over those too similar to one it has taken.
    """
    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))
    words = F.filter(words, lambda w: F.char_length(w).between(3, 24))
    # a text's own strings are made distinct in its row, so counting needs one shuffle, after map-side combine
    strings = F.array_distinct(F.flatten(F.transform(words, lambda w: F.array(w, *(F.substring(w, 1, n) for n in range(3, 9))))))
    counts = sample.select("toxic", F.explode(strings).alias("string")).groupBy("string").agg(F.sum("toxic").alias("bad"), F.count("*").alias("all"))
    counts = staged(counts.where("bad >= 3 or all >= 30"))
    size = sample.agg(F.sum("toxic"), F.count("*")).first()
    bad, good = float(size[0]), float(size[1] - size[0])
    lift = F.log((F.col("bad") + 0.5) / (bad + 1) / ((F.col("all") - F.col("bad") + 0.5) / (good + 1)))
    rated = counts.where("bad >= 3").withColumn("lift", lift).where("lift > 1.5")
    best = rated.orderBy((F.col("bad") * F.col("lift")).desc(), "string").limit(candidates).collect()
    usual = counts.where("bad * 8 < all").orderBy((F.col("all") - F.col("bad")).desc(), "string").limit(candidates).collect()
    taken = [best[i]["string"] for i in apart([r["string"] for r in best], count)]
    # for contrast those common strings of other texts that come closest to one that tells
    other = [r["string"] for r in usual]
    if not taken or not other:
        return taken, []
    near = np.zeros(len(other))
    match = Matcher(Landmarks(taken))
    for i, row in zip(*match.sentences(other), strict=True):
        near[i] = row.max()
    order = sorted(range(len(other)), key=lambda i: (-near[i], other[i]))
    return taken, [other[i] for i in order[:contrast]]


def _strongest(rows: np.ndarray, similar: np.ndarray, telling: int) -> tuple[np.ndarray, np.ndarray]:
    """The SENTENCES sentences of each text with the largest sum over the first `telling` landmarks."""
    order = np.lexsort((-similar[:, :telling].sum(axis=1), rows))
    ranked = rows[order]
    rank = np.arange(len(order)) - np.searchsorted(ranked, ranked)
    kept = np.sort(order[rank < SENTENCES])
    return rows[kept], similar[kept]


def _numbers(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Binary values of `width` half-precision numbers each as the rows of an array."""
    out = np.empty((len(column), width), np.float16)
    for i, value in enumerate(column):
        out[i] = np.frombuffer(value.as_buffer(), np.float16)
    return out


def _settled_order(doc: np.ndarray, similar: np.ndarray) -> np.ndarray:
    """Places of the rows by document and then by their numbers, however the tasks returned them."""
    order = np.argsort(doc, kind="stable")
    edges = np.flatnonzero(np.diff(doc[order], prepend=doc[order[:1]] - 1, append=doc[order[-1:]] + 1))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if b - a > 1:
            part = order[a:b]
            part[:] = sorted(part.tolist(), key=lambda i: similar[i].astype(np.float32).tobytes())
    return order


def learn(docs: DataFrame, labels: DataFrame, *, limit: int = 8_000, landmarks: int = 128, contrast: int = 96) -> Machine | float:
    """The machine for these labels, or the share of toxic documents if only one kind is labelled.

    A toxic text is a bag of sentences of which at least one is toxic: in each round its highest
    sentence is a positive example, and the highest of every other text a negative one. Toxic texts and
    one in sixteen of the others are learned a second time with characters inserted into their words.
    Of a text the SENTENCES most similar to words that tell toxic texts take part.
    """
    sample = labelled(docs, labels, limit)
    size = sample.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    if not size[0] or size[0] == size[1]:
        return float(size[0] / size[1]) if size[1] else 0.0
    telling, usual = pick_landmarks(sample, landmarks, contrast)
    if not telling:
        return float(size[0] / size[1])
    names = telling + usual

    def with_disguised(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame
            again = frame[(frame["toxic"] > 0) | (frame["_doc"] % 16 == 0)]
            yield again.assign(_doc=-1 - again["_doc"], text=[disguised(t) for t in again["text"]])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        match = Matcher(Landmarks(names))
        for frame in sized_batches(with_disguised(frames), "text"):
            rows, similar = _strongest(*match.sentences(frame["text"].tolist()), len(telling))
            have = frame["_doc"].to_numpy()
            without = np.setdiff1d(np.arange(len(frame)), rows)
            toxic = frame["toxic"].to_numpy()
            sent = similar.astype(np.float16)  # loses nothing, as the matcher remembers words so
            yield pd.DataFrame({"_doc": have[rows], "toxic": toxic[rows], "similar": [s.tobytes() for s in sent]})
            yield pd.DataFrame({"_doc": have[without], "toxic": toxic[without], "similar": [zero] * len(without)})

    zero = np.zeros(len(names), np.float16).tobytes()
    numbered = sample.withColumn("_doc", F.monotonically_increasing_id())
    # at most about (1 + share learned twice) * limit * SENTENCES rows of a few hundred numbers
    found = numbered.mapInPandas(run, "_doc bigint, toxic int, similar binary").toArrow()
    doc, toxic = (found.column(c).to_numpy() for c in ("_doc", "toxic"))
    similar = _numbers(found.column("similar"), len(names))
    del found
    order = _settled_order(doc, similar)
    doc, toxic, similar = doc[order], toxic[order], similar[order].astype(np.float32)
    _, first, bag = np.unique(doc, return_index=True, return_inverse=True)
    y = np.where(toxic[first] > 0, 1.0, -1.0)
    weight = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum()) * len(y) / 100
    mapping = nystroem(Landmarks(names))
    mapped = similar @ mapping.astype(np.float32)
    value = similar[:, : len(telling)].sum(axis=1)
    del similar
    for _ in range(4):
        order = np.lexsort((np.arange(len(bag)), value, bag))
        best = order[np.append(np.flatnonzero(np.diff(bag[order])), len(bag) - 1)]
        w, bias = fit_svm(mapped[best].astype(float), y, weight)
        value = mapped @ w + bias
    # the disguised texts have ids below zero; they count less, as few texts are written so
    rare = np.where(doc[first] < 0, DISGUISED, 1.0)
    slopes, shift = fit_logistic(highest(len(y), bag, value, bias), y, rare)
    return Machine(names, mapping @ w, bias, slopes, shift)


@kept_model(2)
def _matcher(names: tuple[str, ...]) -> Matcher:
    """Kept by the worker process, so later tasks know the words of earlier ones."""
    return Matcher(Landmarks(list(names)))


def score_documents(docs: DataFrame, machine: Machine | float, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns `keep` and `score` of every document by its column `text`. Null text counts as empty."""
    if isinstance(machine, float):
        return docs.select(*keep, F.lit(machine).alias("score"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        match = _matcher(tuple(machine.landmarks))
        for frame in sized_batches(frames, text):
            rows, similar = match.sentences([t or "" for t in frame[text]])
            yield frame[list(keep)].assign(score=machine.scores(len(frame), rows, similar))

    return map_rows(docs.select(*dict.fromkeys([*keep, text])), run, keep, "score double")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents whose score is below the threshold, with all their columns."""
    hidden = masked(docs)
    scored = score_documents(hidden, learn(docs, labels), tuple(hidden.columns), mask_of(docs, "text"))
    return unmasked(scored.where(F.col("score") < threshold), docs.columns)


def rate_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Score every document for toxicity: doc_id, held_out, score, predicted.

    Learns from at most about 12,000 labelled documents outside the held-out fold. Texts without a
    word that resembles a landmark, empty and null ones included, get the same low score; without
    labels of both kinds every score is the share of toxic labels (0 if there are none). A null id is
    not held out and has no label; repeated rows are scored each; other columns are ignored.
    """
    scored = score_documents(docs, learn(docs, labels))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
