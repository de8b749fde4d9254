"""What several operators share: folds, staged partitions, components, and words as arrays."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from leafwork import session
from leafwork.session import staged

MASK = (1 << 64) - 1
# Words are hashed modulo two primes. Modulo a power of two, sequences made for it collide under any base.
PRIMES = (2**31 - 1, 2**31 - 19)
BASES = (1_220_703_131, 1_664_525_003)

_MODELS: list = []


def kept_model(maxsize: int) -> Callable:
    """Cache what a function loads in the worker process, for one operator at a time.

    Worker processes outlive a job. So that a pipeline's models do not add up in them, the first use of
    one function's models lets those of all others go.
    """

    def wrap(load: Callable) -> Callable:
        cached = functools.lru_cache(maxsize)(load)
        _MODELS.append(cached)

        @functools.wraps(load)
        def call(*args):
            release_models(cached)
            return cached(*args)

        return call

    return wrap


def release_models(but=None) -> None:
    """Let all models go that worker functions have kept, except those of `but`."""
    for other in _MODELS:
        if other is not but and other.cache_info().currsize:
            other.cache_clear()
            Buffer._tables_of = {}


def held_out(doc_id: Column) -> Column:
    """Whether a document is outside the learning folds: crc32(doc_id as text) mod 4 is 2.

    A null id counts as empty text, which is in a learning fold.
    """
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers, so that any bits of the result can be used."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Buffer:
    """The texts of one batch as one byte array, and their words as positions in it.

    A line feed ends each text, so that no word spans two of them. `row` is the text of each word.
    """

    _tables_of: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, texts: list[str], lower: bool = False):
        encoded = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        self.n = len(encoded)
        raw = np.frombuffer(b"\n".join(encoded) + b"\n", np.uint8)
        lengths = np.fromiter(map(len, encoded), np.int64, self.n)
        self.ends = np.cumsum(lengths + 1) - 1
        self.starts = self.ends - lengths
        if lower:
            raw = raw + ((raw >= 65) & (raw <= 90)).astype(np.uint8) * np.uint8(32)
        self.bytes = raw
        space = (raw == 32) | ((raw >= 9) & (raw <= 13))
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edge = np.concatenate([[0], edge])
        self.word_start, self.word_end = edge[::2], edge[1::2]
        self.row = np.searchsorted(self.ends, self.word_start, side="right")

    @classmethod
    def _tables(cls, which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Powers of a base and of its inverse, modulo its prime, below the n-th at least."""
        known = cls._tables_of.get(which)
        if known is None or len(known[0]) < n:
            prime, base = PRIMES[which], BASES[which]
            size = -(-n // (1 << 18)) << 18
            known = tuple(powers(f, prime, size).astype(np.uint32) for f in (base, pow(base, -1, prime)))
            cls._tables_of[which] = known
        return known

    def hashes(self, starts: np.ndarray | None = None, ends: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit hash of the bytes of each word, or of the given ranges: two sums modulo primes, mixed."""
        starts = self.word_start if starts is None else starts
        ends = self.word_end if ends is None else ends
        n = len(self.bytes)
        both = []
        for which, prime in enumerate(PRIMES):
            powers_, inverses = self._tables(which, n + 1)
            terms = (self.bytes.astype(np.uint64) + np.uint64(1)) * powers_[:n]
            if n >= 1 << 24:  # else the sum of all terms stays below 2**64
                terms %= np.uint64(prime)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(terms, out=sums[1:])
            both.append((sums[ends] - sums[starts]) % np.uint64(prime) * inverses[starts] % np.uint64(prime))
        return mix((both[0] << np.uint64(32) | both[1]) + mix((ends - starts).astype(np.uint64)))


def powers(base: int, prime: int, n: int) -> np.ndarray:
    """1, base, base², … modulo a prime below 2**31, n of them."""
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:
        step = np.uint64(pow(base, done, prime))
        out[done : 2 * done] = out[: min(done, n - done)] * step % np.uint64(prime)
        done *= 2
    return out


def map_rows(
    frame: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], keep: Sequence[str], produced: str
) -> DataFrame:
    """`mapInPandas` that hands the columns `keep` on and adds those of the schema `produced`.

    Whole numbers in `keep` travel as text, as pandas makes doubles of a column that has nulls.
    """
    whole = {f.name: f.dataType for f in frame.schema if f.name in keep and isinstance(f.dataType, IntegralType)}
    sent = frame.withColumns({c: F.col(f"`{c}`").cast("string") for c in whole}) if whole else frame
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in sent.schema if f.name in keep]
    out = sent.mapInPandas(run, ", ".join([*fields, produced] if produced else fields))
    return out.withColumns({c: F.col(f"`{c}`").cast(t) for c, t in whole.items()}) if whole else out


def masked(frame: DataFrame) -> DataFrame:
    """All columns under names of their own (_c0, _c1, …), which no result clashes with."""
    return frame.select(*(F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(frame.columns)))


def unmasked(frame: DataFrame, names: Sequence[str]) -> DataFrame:
    return frame.select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(names)))


def mask_of(frame: DataFrame, name: str) -> str:
    return f"_c{frame.columns.index(name)}"


def sized_batches(frames: Iterator[pd.DataFrame], column: str, limit: int = 2_000_000) -> Iterator[pd.DataFrame]:
    """Cut batches so that the text of one has about `limit` characters; one long text is a batch."""
    for frame in frames:
        if not len(frame):
            continue
        sizes = frame[column].map(lambda t: len(t) if t else 0).to_numpy()
        part = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(frame)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield frame.iloc[a:b]


def labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index each of n nodes reaches by the edges."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return label


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete one staged table that nothing reads any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    session._STAGED.remove(path)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of `(a, b)` as `(node, component)`; component is the smallest node.

    Alternates large-star and small-star steps over a staged edge table until no edge changes. Each
    step takes minima with map-side combine and joins them back, so a hub with very many edges is
    split by the skew join. Nodes without an edge do not occur. Null nodes are ignored.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    edges = staged(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    before = None
    for _ in range(max_rounds):
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        large = staged(large.where("a <> b").distinct())
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y"))
        edges = staged(small.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(roots)
