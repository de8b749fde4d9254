"""Language of whole texts by cross-parsing against a suffix automaton per language."""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwork.llm.common import held_out, kept_model, map_rows, sized_batches
from leafwork.session import staged

CLASSES = 64  # symbols of an automaton: 0 for all that is no letter, a to z, hashes of other letters
PIECE = 512  # symbols parsed as one row; a longer text is several rows
SAMPLE = 40_000  # symbols of labelled text an automaton is built from
UNKNOWN = "und"
FEW = 10_000  # languages up to which their counts are broadcast


@functools.cache
def _class_of() -> np.ndarray:
    """Symbol of every code point."""
    table = np.zeros(sys.maxunicode + 1, np.uint8)
    letters = np.array([c for c in range(128, sys.maxunicode + 1) if chr(c).isalpha()], np.int64)
    table[letters] = 27 + (letters * 2654435761 >> 7) % (CLASSES - 27)
    table[ord("a") : ord("z") + 1] = np.arange(1, 27)
    return table


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the lower-cased texts end to end, and the text of each; runs without letters are one symbol."""
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(lowered)), np.fromiter(map(len, lowered), np.int64, len(lowered)))
    found = _class_of()[codes]
    keep = found > 0
    keep[1:] |= (found[:-1] > 0) & (row[1:] == row[:-1])
    return found[keep], row[keep]


def automaton(sample: np.ndarray) -> np.ndarray:
    """Transitions of the suffix automaton of `sample`: state x symbol, state 1 is the root, 0 is none."""
    follow: list[dict[int, int]] = [{}, {}]
    length, link = [0, 0], [0, 0]
    last = 1
    for symbol in sample.tolist():
        state = len(follow)
        follow.append({})
        length.append(length[last] + 1)
        link.append(1)
        at = last
        while at and symbol not in follow[at]:
            follow[at][symbol] = state
            at = link[at]
        if at:
            target = follow[at][symbol]
            if length[target] == length[at] + 1:
                link[state] = target
            else:
                copy = len(follow)
                follow.append(dict(follow[target]))
                length.append(length[at] + 1)
                link.append(link[target])
                while at and follow[at].get(symbol) == target:
                    follow[at][symbol] = copy
                    at = link[at]
                link[target] = link[state] = copy
        last = state
    table = np.zeros((len(follow), CLASSES), np.int32)
    for state, targets in enumerate(follow):
        if targets:
            table[state, list(targets)] = list(targets.values())
    return table


def count_phrases(table: np.ndarray, rows: np.ndarray, active: np.ndarray) -> np.ndarray:
    """Phrases of each row: greedy longest matches anywhere in the sample, parsed row by row at once.

    `rows` holds a symbol position per line, longest rows first; `active` says how many rows go on.
    """
    flat = table.ravel()
    root = np.where(table[1] > 0, table[1], 1).astype(np.int32)
    state = np.ones(rows.shape[1], np.int32)
    phrases = np.zeros(rows.shape[1], np.int64)
    for line, n in zip(rows, active.tolist(), strict=True):
        symbol = line[:n]
        following = flat[state[:n] * CLASSES + symbol]
        missed = following == 0
        phrases[:n] += missed | (state[:n] == 1)  # at the root no phrase is open
        state[:n] = np.where(missed, root[symbol], following)
    return phrases


class Parser:
    """The automata of all languages, built from their samples."""

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        sampled = [symbols([samples[lang]])[0][:SAMPLE] for lang in self.languages]
        self.tables = [automaton(s) for s in sampled]
        # the cost of a phrase is the choice of a place in the sample
        self.cost = np.array([np.log2(max(2, len(s))) for s in sampled])

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        n = len(texts)
        found, row = symbols(texts)
        letters = np.bincount(row[found > 0], minlength=n)
        if not self.languages:
            return [UNKNOWN] * n, np.zeros(n)
        size = np.bincount(row, minlength=n)
        pieces = -(-size // PIECE)
        owner = np.repeat(np.arange(n), pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = (np.cumsum(size) - size)[owner] + nth * PIECE
        length = np.minimum(PIECE, size[owner] - nth * PIECE)
        order = np.argsort(-length, kind="stable")
        owner, start, length = owner[order], start[order], length[order]
        total = np.zeros((len(self.languages), n))
        if len(owner):
            lines = np.arange(length[0])
            place = np.minimum(start[None, :] + lines[:, None], len(found) - 1)
            rows = found[place].astype(np.int32)
            active = np.searchsorted(-length, -lines, side="left")
            for i, table in enumerate(self.tables):
                total[i] = np.bincount(owner, count_phrases(table, rows, active), n) * self.cost[i]
        best = total.argmin(axis=0)  # the first of equals, in the order of names
        least = total[best, np.arange(n)]
        second = np.partition(total, 1, axis=0)[1] if len(self.languages) > 1 else np.zeros(n)
        score = np.where(second > 0, 1 - least / np.where(second > 0, second, 1), 1.0)
        known = letters > 0
        names = [self.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)]
        return names, np.where(known, score, 0.0)


@kept_model(2)
def _parser(samples: tuple[tuple[str, str], ...]) -> Parser:
    return Parser(dict(samples))


def sample_languages(docs: DataFrame, documents: int = 200, characters: int = 4000) -> dict[str, str]:
    """Labelled text of each language outside the held-out fold: a bounded sample to learn from.

    About `documents` texts per language, picked by hash, give up to `characters` each; the driver
    holds at most languages x documents x characters. Rarer languages give all their texts.
    """
    texts = docs.where("lang is not null and text is not null").where(~held_out(F.col("doc_id"))).select(
        F.col("lang").cast("string").alias("lang"), "text", F.xxhash64("text", F.lit("fit")).alias("order")
    )
    counts = staged(texts.groupBy("lang").agg(F.count("*").alias("n")))
    counts = F.broadcast(counts) if counts.count() <= FEW else counts  # so the texts stay where they are
    # a hash of the text keeps copies together, so a share of texts may be more rows; the limit holds per row
    picked = texts.join(counts, "lang").where(
        F.pmod("order", F.lit(1 << 30)) < F.least(F.lit(1.0), 2.0 * documents / F.col("n")) * (1 << 30)
    )
    distinct = picked.groupBy("lang", "order").agg(F.min(F.substring("text", 1, characters)).alias("text"))
    samples: dict[str, list[str]] = {}
    held: dict[str, int] = {}
    for row in distinct.orderBy("lang", "order").toLocalIterator():
        if held.get(row["lang"], 0) < 2 * SAMPLE:
            samples.setdefault(row["lang"], []).append(row["text"])
            held[row["lang"]] = held.get(row["lang"], 0) + len(row["text"])
    return {lang: "\n".join(parts) for lang, parts in samples.items()}


def predict_documents(docs: DataFrame, samples: dict[str, str]) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, from its text alone."""
    fixed = tuple(sorted(samples.items()))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parser = _parser(fixed)
        for frame in sized_batches(frames, "text"):
            names, score = parser.predict(frame["text"].tolist())
            yield frame[["doc_id", "held_out"]].assign(lang_pred=names, score=score)

    texts = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return map_rows(texts, run, ("doc_id", "held_out"), "lang_pred string, score double")


def identify_languages(docs: DataFrame) -> DataFrame:
    """Predict the language of every document by cross-parsing.

    Per language a suffix automaton of labelled text is built; a text is cut into the longest phrases
    that occur in that text. Phrases times the bits that name a place in the sample, the cross-entropy
    estimate, is least for the language predicted (the first by name among equals). The score is one
    minus the least over the second least, 1 if only one language is known.

    Null texts and texts without a letter are 'und' with score 0, as is everything if there is nothing
    to learn from. A null id is not held out. Repeated rows are predicted each; an empty table gives
    no rows; other columns are ignored.
    """
    return predict_documents(docs, sample_languages(docs))
