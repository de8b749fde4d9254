"""Quality rules: counts of each text, and perplexity bands under a Kneser-Ney model of the corpus."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.dataset as ds
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwork import session
from leafwork.llm.common import Buffer, kept_model, map_rows, mask_of, masked, mix, sized_batches, unmasked
from leafwork.llm.warc import file_system
from leafwork.session import staged, staging_root

ORDER = 5  # bytes of an n-gram
HELD = 3_000_000  # n-grams a task holds before it hands them on
SYMBOLS = b"#*$%&|<>"  # fixed value
WINDOW = 8  # fixed value: words of a window that may repeat
FEW = 10_000  # languages up to which their bands are broadcast
IQR = 1.349  # interquartile range of a normal spread, in standard deviations
LEAST = 0.02  # least deviation of log-perplexity per byte, for languages of few or equal texts

_DIGITS = np.arange(256, dtype=np.uint8)
_DIGITS[48:58] = 48  # all digits are one


# -- counts of a text -------------------------------------------------------------------------


def _per_row(row: np.ndarray, n: int, weight: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(row, weight, n).astype(np.int64)


def text_counts(texts: list[str]) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    b = Buffer(texts)
    raw, n = b.bytes, b.n
    counts = {"n_words": _per_row(b.row, n)}

    def summed(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[b.ends] - total[b.starts]

    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    solid = np.concatenate([[0], np.cumsum(~space, dtype=np.int64)])
    counts["word_chars"] = summed(~space & ((raw & 0xC0) != 0x80))
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    counts["n_symbols"] = summed(symbol[raw])

    line_end = np.flatnonzero(raw == 10)
    line_start = np.concatenate([[0], line_end[:-1] + 1])
    with_word = solid[line_end] > solid[line_start]
    line_start, line_end = line_start[with_word], line_end[with_word]
    row = np.searchsorted(b.ends, line_start, side="right")
    # the row takes part in the key, so equal keys are equal lines of one text
    key = mix(b.hashes(line_start, line_end) + row.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    _, first = np.unique(key, return_index=True)
    counts["n_dup_lines"] = _per_row(row, n) - _per_row(row[first], n)

    counts["n_repeat_words"] = np.zeros(n, np.int64)
    words = b.hashes()
    if len(words) >= WINDOW:
        m = len(words) - WINDOW + 1
        key = np.zeros(m, np.uint64)
        for i in range(WINDOW):
            key = key * np.uint64(0x9FB21C651E98DF25) + words[i : i + m]
        inside = np.flatnonzero(b.row[:m] == b.row[WINDOW - 1 :])
        key = mix(key[inside] + b.row[inside].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        repeated = np.zeros(len(key), bool)
        repeated[order[1:][same]] = repeated[order[:-1][same]] = True
        edges = np.zeros(len(words) + 1, np.int64)
        at = inside[repeated]
        np.add.at(edges, at, 1)
        np.add.at(edges, at + WINDOW, -1)
        counts["n_repeat_words"] = _per_row(b.row[np.cumsum(edges[:-1]) > 0], n)
    return counts


# -- the language model -----------------------------------------------------------------------


def _padded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """N-gram keys of all bytes of the texts, and how many each text has.

    Each text starts after ORDER - 1 zero bytes, so no n-gram spans two texts.
    """
    encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
    pad = b"\0" * (ORDER - 1)
    raw = _DIGITS[np.frombuffer(pad + pad.join(encoded), np.uint8)]
    lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
    key = raw.astype(np.int64)
    for i in range(1, ORDER):
        key[ORDER - 1 :] |= raw[ORDER - 1 - i : len(raw) - i].astype(np.int64) << (8 * i)
    starts = np.cumsum(lengths + ORDER - 1) - lengths
    inside = np.zeros(len(raw) + 1, np.int8)
    np.add.at(inside, starts, 1)
    np.add.at(inside, starts + lengths, -1)
    return key[np.cumsum(inside[:-1], dtype=np.int8) > 0], lengths


def count_grams(docs: DataFrame) -> DataFrame:
    """Counts of the byte n-grams of highest order over all texts: lang, gram, n.

    Tasks add up equal n-grams before they hand them on, whenever they hold HELD of them.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list] = {}

        def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
            keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            return keys, np.bincount(inverse, np.concatenate([n for _, n in parts])).astype(np.int64)

        def flush() -> Iterator[pd.DataFrame]:
            for lang, parts in held.items():
                keys, counts = merged(parts)
                for at in range(0, len(keys), 100_000):
                    part = slice(at, at + 100_000)
                    yield pd.DataFrame({"lang": lang, "gram": keys[part], "n": counts[part]})
            held.clear()

        for frame in sized_batches(frames, "text"):
            for lang, rows in frame.groupby("lang"):
                keys, _ = _padded(rows["text"].tolist())
                parts = held.setdefault(lang, [])
                parts.append(np.unique(keys, return_counts=True))
                if sum(len(k) for k, _ in parts) > HELD // 3 and len(parts) > 1:
                    held[lang] = [merged(parts)]
            if sum(len(k) for parts in held.values() for k, _ in parts) > HELD:
                yield from flush()
        yield from flush()

    texts = docs.select(_lang().alias("lang"), "text").where("text is not null and text <> ''")
    return texts.mapInPandas(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _lang(column: str = "lang") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def _discounts(table: DataFrame) -> DataFrame:
    """The three discounts of modified Kneser-Ney per language, from the counts of counts."""
    n = [F.sum((F.col("n") == i).cast("bigint")).alias(f"n{i}") for i in (1, 2, 3, 4)]
    of = table.groupBy("lang").agg(*n)
    y = F.when(F.col("n1") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(F.lit(0.5))

    def discount(i: int) -> Column:
        ratio = F.when(F.col(f"n{i}") > 0, F.col(f"n{i + 1}") / F.col(f"n{i}")).otherwise(F.lit(1.0))
        return F.greatest(F.lit(0.1 * i), F.least(F.lit(i * 0.95), i - (i + 1) * y * ratio)).alias(f"d{i}")

    return of.select("lang", discount(1), discount(2), discount(3))


def kneser_ney(grams: DataFrame) -> DataFrame:
    """Interpolated modified Kneser-Ney probabilities of all orders: lang, size, gram, p, gamma.

    The highest order uses counts, lower ones the number of different bytes before an n-gram.
    `gamma` is the share that an n-gram, as a context, leaves to the order below (null if it is none).
    """
    counts = {ORDER: grams}
    for size in range(ORDER - 1, 0, -1):
        tail = F.col("gram").bitwiseAND(F.lit((1 << 8 * size) - 1))
        above = counts[size + 1].select("lang", tail.alias("gram"))
        counts[size] = staged(above.groupBy("lang", "gram").agg(F.count("*").alias("n")))
    lower, tables = None, []
    for size in range(1, ORDER + 1):
        discounts = _discounts(counts[size])  # a row per language
        table = counts[size].join(discounts, "lang").withColumn("d", F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3")))
        table = table.withColumn("context", F.shiftright("gram", 8))
        contexts = table.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum(F.least(F.col("d"), F.col("n").cast("double"))).alias("freed"))
        contexts = staged(contexts.withColumn("gamma", F.col("freed") / F.col("total")))
        own = F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("total")
        table = table.join(contexts, ["lang", "context"])
        if lower is None:
            table = table.withColumn("p", own + F.col("gamma") / 256)
            none = F.lit(None).cast("double").alias("p")
            tables.append(contexts.select("lang", F.lit(0).alias("size"), F.col("context").alias("gram"), none, "gamma"))
        else:
            below = lower.select("lang", F.col("gram").alias("tail"), F.col("p").alias("below"))
            table = table.withColumn("tail", F.col("gram").bitwiseAND(F.lit((1 << 8 * (size - 1)) - 1)))
            table = table.join(below, ["lang", "tail"]).withColumn("p", own + F.col("gamma") * F.col("below"))
            tables[-1] = lower.join(
                contexts.select("lang", F.col("context").alias("gram"), "gamma"), ["lang", "gram"], "full"
            ).select("lang", F.lit(size - 1).alias("size"), "gram", "p", "gamma")
        lower = staged(table.select("lang", "gram", "p"))
        tables.append(lower.select("lang", F.lit(size).alias("size"), "gram", "p", F.lit(None).cast("double").alias("gamma")))
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out


def _hash(gram: np.ndarray, size: int) -> np.ndarray:
    return mix(gram.astype(np.uint64) | np.uint64(size << 56))


def store_model(model: DataFrame) -> str:
    """Write the model as one folder of hash, log p and log gamma per language, sorted by hash."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            hashed = mix(frame["gram"].to_numpy(np.uint64) | (frame["size"].to_numpy(np.uint64) << np.uint64(56)))
            with np.errstate(divide="ignore"):
                yield pd.DataFrame({
                    "lang": frame["lang"], "hash": hashed.view(np.int64), "p": np.log(frame["p"].to_numpy(float)).astype(np.float32),
                    "gamma": np.log(frame["gamma"].to_numpy(float)).astype(np.float32),
                })

    hashed = model.mapInPandas(run, "lang string, hash bigint, p float, gamma float")
    # the hash as an unsigned number has the order in which tasks search
    unsigned = F.col("hash").bitwiseXOR(F.lit(-(1 << 63)))
    folder = f"{staging_root(model.sparkSession)}/model-{uuid.uuid4().hex}"
    session._STAGED.append(folder)
    hashed.repartitionByRange("lang", unsigned).sortWithinPartitions("lang", unsigned).write.parquet(folder)
    return folder


class HashModel:
    """The model of one language: sorted hashes with an index of their leading bits."""

    def __init__(self, folder: str, lang: str):
        store, path = file_system(folder)
        table = ds.dataset(path, filesystem=store, format="parquet").to_table(
            columns=["hash", "p", "gamma"], filter=ds.field("lang") == lang
        )
        hashed = table["hash"].to_numpy().view(np.uint64)
        order = np.argsort(hashed, kind="stable")  # files are read in any order
        self.hash = hashed[order]
        self.p = table["p"].to_numpy(zero_copy_only=False)[order]
        self.gamma = np.nan_to_num(table["gamma"].to_numpy(zero_copy_only=False)[order], nan=0.0, neginf=0.0)
        self.bits = max(1, int(len(self.hash)).bit_length())
        edges = np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)
        self.index = np.append(np.searchsorted(self.hash, edges), len(self.hash)).astype(np.int32)

    def find(self, hashed: np.ndarray) -> np.ndarray:
        """Places of the hashes in the sorted array, -1 where there is none."""
        bucket = (hashed >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.index[bucket], self.index[bucket + 1]
        found = np.full(len(hashed), -1, np.int32)
        open_ = np.flatnonzero(at < end)
        at, end, hashed = at[open_], end[open_], hashed[open_]
        while len(open_):
            hit = self.hash[at] == hashed
            found[open_[hit]] = at[hit]
            more = ~hit & (at + 1 < end)
            open_, at, end, hashed = open_[more], at[more] + 1, end[more], hashed[more]
        return found

    def log_p(self, key: np.ndarray) -> np.ndarray:
        """Log probability of the last byte of each n-gram given the bytes before it."""
        result, open_, passed = np.zeros(len(key), np.float32), np.arange(len(key)), np.zeros(len(key), np.float32)
        for size in range(ORDER, 0, -1):
            at = self.find(_hash(key, size))
            hit = (at >= 0) & ~np.isnan(self.p[at])
            result[open_[hit]] = passed[hit] + self.p[at[hit]]
            open_, key, passed = open_[~hit], key[~hit], passed[~hit]
            if not len(open_):
                return result
            if size > 1:
                context = self.find(_hash(key >> 8, size - 1))
                passed = passed + np.where(context >= 0, self.gamma[context], np.float32(0))
                key = key & ((1 << 8 * (size - 1)) - 1)
        unseen = self.find(_hash(np.zeros(1, np.int64), 0))[0]
        result[open_] = passed + (self.gamma[unseen] if unseen >= 0 else np.float32(0)) - np.float32(np.log(256))
        return result


@kept_model(8)
def hash_model(folder: str, lang: str) -> HashModel:
    """Models a task has in memory; the least used goes when there are more than eight languages."""
    return HashModel(folder, lang)


# -- the operator -----------------------------------------------------------------------------


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def score_documents(docs: DataFrame, folder: str, keep: tuple[str, ...], text: str, lang: str) -> DataFrame:
    """The columns `keep`, the text counts, _lang and log_perplexity (per byte, null for empty texts).

    `text` and `lang` name the columns to read.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in sized_batches(frames, text):
            texts, langs = [t or "" for t in frame[text]], frame["_lang"].to_numpy()
            scores = np.full(len(frame), np.nan)
            full = np.array([bool(t) for t in texts])
            for lang in np.unique(langs[full].astype(str)):
                rows = np.flatnonzero(full & (langs == lang))
                keys, lengths = _padded([texts[i] for i in rows])
                total = np.concatenate([[0], np.cumsum(hash_model(folder, lang).log_p(keys), dtype=np.float64)])
                ends = np.cumsum(lengths)
                scores[rows] = -(total[ends] - total[ends - lengths]) / lengths
            yield frame[[*keep, "_lang"]].assign(**text_counts(texts), log_perplexity=scores)

    texts = docs.select(*dict.fromkeys([*keep, text]), _lang(lang).alias("_lang"))
    counts = ", ".join(f"{c} bigint" for c in COUNTS)
    scored = map_rows(texts, run, (*keep, "_lang"), f"{counts}, log_perplexity double")
    return scored.withColumn("log_perplexity", F.nanvl("log_perplexity", F.lit(None).cast("double")))


def judge(
    docs: DataFrame,
    keep: tuple[str, ...],
    text: str = "text",
    lang: str = "lang",
    *,
    min_words: int = 20,
    max_repeat_percent: int = 30,
    below: float = 4.0,
    above: float = 3.0,
) -> DataFrame:
    """`apply_rules` with the columns `keep` of the documents."""
    named = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    folder = store_model(kneser_ney(staged(count_grams(named))))
    scored = staged(score_documents(docs, folder, keep, text, lang))
    # rounded, so the exact percentiles need a bounded table of values
    marks = scored.where(f"n_words >= {min_words} and log_perplexity is not null").groupBy("_lang").agg(
        F.expr("percentile(round(log_perplexity, 4), array(0.25, 0.5, 0.75))").alias("q")
    )
    middle = F.col("q")[1]
    spread = F.greatest(F.lit(LEAST), (F.col("q")[2] - F.col("q")[0]) / IQR)
    # the lower side shrinks the median by a factor, so it stays above zero however wide the spread is
    bands = staged(marks.select("_lang", (middle * F.exp(-below * spread / middle)).alias("_low"), (middle + above * spread).alias("_high")))
    judged = scored.join(F.broadcast(bands) if bands.count() <= FEW else bands, "_lang", "left")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    inside = F.coalesce(F.col("log_perplexity").between(F.col("_low"), F.col("_high")), F.lit(True))
    return judged.select(
        *keep, *COUNTS, failed.alias("base_failed"), (~failed & inside).alias("kept"), F.col("_lang").alias("model"), "log_perplexity"
    )


def apply_rules(docs: DataFrame, **limits) -> DataFrame:
    """Judge every document by counts of its text and by its perplexity (limits as in `judge`).

    A byte n-gram model with modified Kneser-Ney smoothing is counted over all documents, one per
    language, and kept as sorted hash arrays in the staging folder. A document's perplexity has to lie
    in its language's band around the median of log-perplexity of all texts with enough words. `below`
    and `above` say how far the band reaches on either side, in robust standard deviations (from the
    interquartile range, LEAST at least). The lower side is a factor on the median, so above zero.
    Repetition lowers perplexity in clean texts too, so the lower side is wider.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    model (the language), log_perplexity. Null text counts as empty: it has no words and fails. A null
    language is one of its own. Repeated rows are judged each; an empty table gives no rows; other
    columns are ignored.
    """
    return judge(docs, ("doc_id",), **limits)


def keep_good(docs: DataFrame, **limits) -> DataFrame:
    """The documents that pass, with all their columns."""
    hidden = masked(docs)
    judged = judge(hidden, tuple(hidden.columns), mask_of(docs, "text"), mask_of(docs, "lang"), **limits)
    return unmasked(judged.where("kept"), docs.columns)
