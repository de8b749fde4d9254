"""Byte-level BPE of whole texts, with long unsplit text encoded as a tree of halves."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwork.llm.common import kept_model, map_rows
from leafwork.session import staged

LEAF = 2048  # characters a leaf of the tree has at most
BLOCK = 1 << 16  # longer texts are encoded as several rows, block by block
WINDOW = 64  # characters on either side of a join that are encoded again at first

# Fixed value: how byte-level BPE splits text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of_char() -> dict[str, int]:
    """Printable bytes stand for themselves in a byte-level vocabulary, all others for 256, 257, …"""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Codec:
    """Encodes and decodes with the vocabulary of a tokenizer file, exactly as its library does."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if len(self.special) > 1:
            raise ValueError("one added token is supported")
        alphabet = _byte_of_char()
        self.bytes_of: dict[int, bytes] = {}
        ranks: dict[bytes, int] = {}
        for token, number in spec["model"]["vocab"].items():
            if token in self.special:
                continue
            raw = bytes(alphabet[c] for c in token)
            ranks[raw], self.bytes_of[number] = number, raw
        self.bytes_of |= {number: text.encode() for text, number in self.special.items()}
        self.size = max(self.bytes_of) + 1
        self.lengths = np.zeros(self.size, np.int64)
        for number, raw in self.bytes_of.items():
            self.lengths[number] = len(raw)
        self.encoding = tiktoken.Encoding(path, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    # -- encoding -----------------------------------------------------------------------------

    def encode(self, text: str) -> np.ndarray:
        """Ids of the whole text; the added token's string becomes its id."""
        if not text:
            return np.zeros(0, np.uint32)
        for string, number in self.special.items():
            if string in text:
                parts: list[np.ndarray] = []
                for i, part in enumerate(text.split(string)):
                    parts += [np.array([number], np.uint32)] * (i > 0) + [self._plain(part)]
                return np.concatenate(parts)
        return self._plain(text)

    def _plain(self, text: str) -> np.ndarray:
        if len(text) <= LEAF or not _has_long_stretch(text):
            return np.array(self.encoding.encode_ordinary(text), np.uint32)
        parts = [self._tree(text[a:b]) for a, b in _stretches(text)]
        return np.concatenate(parts)

    def _tree(self, text: str) -> np.ndarray:
        """Encode halves down to leaves, then join neighbours level by level."""
        nodes = []
        for at in range(0, len(text), LEAF):
            leaf = text[at : at + LEAF]
            nodes.append((leaf, np.array(self.encoding.encode_ordinary(leaf), np.uint32)))
        return self.join_all(nodes)

    def join_all(self, nodes: list[tuple[str, np.ndarray]]) -> np.ndarray:
        """The encoding of consecutive texts from the encodings of each, joined as a balanced tree."""
        while len(nodes) > 1:
            pairs = zip(nodes[::2], nodes[1::2], strict=False)
            joined = [(a[0] + b[0], self.join(a, b)) for a, b in pairs]
            nodes = joined + nodes[len(joined) * 2 :]
        return nodes[0][1] if nodes else np.zeros(0, np.uint32)

    def join(self, left: tuple[str, np.ndarray], right: tuple[str, np.ndarray]) -> np.ndarray:
        """Ids of left + right, from the ids of both and of a window around the place they meet.

        The window grows until it has a whole token in common with each side (same place, same id)
        or reaches that side's outer end. A sequence of tokens is the encoding of its bytes exactly
        if every two neighbours are an encoding of theirs. All neighbours come from one of the three
        encodings, as the common token belongs to two of them; so the joined sequence is exact.
        """
        (a, a_ids), (b, b_ids) = left, right
        if not a or not b:
            return np.concatenate([a_ids, b_ids])
        a_ends = np.cumsum(self.lengths[a_ids])
        b_starts = a_ends[-1] + np.cumsum(self.lengths[b_ids]) - self.lengths[b_ids]
        a_starts = a_ends - self.lengths[a_ids]
        # an added token that the window cuts off must not matter, so its outer edges don't count
        edge = max((len(s) for s in self.special), default=0)
        width = WINDOW + edge
        while True:
            before, after = a[max(0, len(a) - width) :], b[:width]
            ids = self._window(before + after)
            ends = a_ends[-1] - len(before.encode("utf-8", "surrogatepass")) + np.cumsum(self.lengths[ids])
            starts = ends - self.lengths[ids]
            held = (starts >= starts[0] + edge) & (ends <= ends[-1] - edge)
            whole_left, whole_right = width >= len(a), width >= len(b)
            cut_a, from_w = (0, 0) if whole_left else _common(a_starts, a_ids, starts, ids, held, last=False)
            cut_b, to_w = (len(b_ids), len(ids)) if whole_right else _common(b_starts, b_ids, starts, ids, held, last=True)
            if cut_a is not None and cut_b is not None and from_w <= to_w:
                return np.concatenate([a_ids[:cut_a], ids[from_w:to_w], b_ids[cut_b:]])
            width *= 2

    def _window(self, text: str) -> np.ndarray:
        for string in self.special:
            if string in text:
                return self.encode(text)
        return np.array(self.encoding.encode_ordinary(text), np.uint32)

    # -- decoding -----------------------------------------------------------------------------

    def decode(self, ids: np.ndarray) -> str:
        table = self.bytes_of
        return b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace")


def _common(starts, ids, w_starts, w_ids, held, *, last: bool) -> tuple[int | None, int | None]:
    """Indexes (in a side, in the window) of a token that both have at the same place.

    For the left side the first such token of the window, which ends before the join; for the right
    side the last one, which starts after it.
    """
    _, i, j = np.intersect1d(starts, w_starts, assume_unique=True, return_indices=True)
    same = (ids[i] == w_ids[j]) & held[j]
    i, j = i[same], j[same]
    if not len(i):
        return None, None
    k = len(i) - 1 if last else 0
    return int(i[k]), int(j[k])


def _cuts(text: str) -> np.ndarray:
    """Places before a single space between two other characters, where every split has a boundary."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    # anything at or below space or above ASCII may be white space and is not taken as a neighbour
    solid = (codes > 32) & (codes < 127)
    return np.flatnonzero((codes[1:-1] == 32) & solid[:-2] & solid[2:]) + 1


def _has_long_stretch(text: str) -> bool:
    """Whether LEAF characters or more have no place to cut (a quick test by fixed steps)."""
    half = LEAF // 2
    return any(" " not in text[at : at + half] for at in range(0, len(text) - half + 1, half))


def _stretches(text: str) -> Iterator[tuple[int, int]]:
    """Ranges of about LEAF characters that end at a place to cut, longer where there is none."""
    cuts, start = _cuts(text), 0
    while len(text) - start > LEAF:
        k = np.searchsorted(cuts, start + LEAF, side="right") - 1
        if k < 0 or cuts[k] <= start:
            k = np.searchsorted(cuts, start, side="right")
            if k >= len(cuts):
                break
        yield start, int(cuts[k])
        start = int(cuts[k])
    yield start, len(text)


@kept_model(2)
def codec(path: str) -> Codec:
    """One codec per process and vocabulary file."""
    return Codec(path)


def encode_documents(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), block: int = BLOCK) -> DataFrame:
    """Encode `text` of every row with the vocabulary at `path`: the columns `keep` and `ids`.

    `ids` is binary, little-endian unsigned 32-bit. `path` must exist on every executor. Texts over
    `block` characters are cut anywhere into blocks that are encoded as rows of their own, dealt out
    over the cluster, and joined per text by windows around each cut. Null text counts as empty and
    gives no ids; repeated rows stay; an empty table gives none; columns not named are ignored.
    """
    long = F.char_length("_text") > block

    def whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = codec(path)
        for frame in frames:
            yield frame[list(keep)].assign(ids=[coder.encode(t or "").tobytes() for t in frame["_text"]])

    def blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = codec(path)
        for frame in frames:
            yield frame.assign(ids=[coder.encode(t).tobytes() for t in frame["_text"]])

    def joined(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_block")
        nodes = [(t, np.frombuffer(i, np.uint32)) for t, i in zip(frame["_text"], frame["ids"], strict=True)]
        return pd.DataFrame({"_row": frame["_row"].iloc[:1], "ids": [codec(path).join_all(nodes).tobytes()]})

    texts = docs.select(*keep, F.col("text").alias("_text"))
    short = map_rows(texts.where(~F.coalesce(long, F.lit(False))), whole, keep, "ids binary")
    # rows of long texts are written once, as the number that brings their blocks together has to stay
    numbered = staged(texts.where(long).withColumn("_row", F.monotonically_increasing_id()))
    count = F.floor((F.char_length("_text") - 1) / block)
    parts = numbered.select("_row", "_text", F.posexplode(F.sequence(F.lit(0), count)).alias("_block", "_at"))
    parts = parts.select("_row", "_block", F.expr(f"substring(_text, cast(_at * {block} + 1 as int), {block})").alias("_text"))
    encoded = parts.repartition("_row", "_block").mapInPandas(blocks, "_row bigint, _block int, _text string, ids binary")
    ids = encoded.groupBy("_row").applyInPandas(joined, "_row bigint, ids binary")
    return short.unionByName(numbered.drop("_text").join(ids, "_row").select(*keep, "ids"))


def decode_documents(encoded: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id", "ids")) -> DataFrame:
    """Decode `ids` (as `encode_documents` gives them) to `text`, next to the columns `keep`.

    Bytes that are not UTF-8 become replacement characters; null ids count as empty.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = codec(path)
        for frame in frames:
            yield frame[list(keep)].assign(text=[coder.decode(np.frombuffer(i or b"", np.uint32)) for i in frame["ids"]])

    return map_rows(encoded.select(*dict.fromkeys([*keep, "ids"])), run, keep, "text string")
