"""Near-duplicate vectors by product quantisation in inverted lists, with exact cosines at the end."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwork.llm.common import components, labels, map_rows
from leafwork.session import staged

SAMPLE = 20_000  # vectors that centroids and codebooks are fitted on
LISTS = 1024  # most lists
WIDTH = 4  # dimensions of a subspace
CODES = 256  # centroids of a subspace
ENTRIES, QUERIES = 4096, 8192  # vectors that are compared in one group


# -- codebooks --------------------------------------------------------------------------------


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    half = (centres**2).sum(axis=1) / 2
    for a in range(0, len(x), 4096):
        out[a : a + 4096] = (x[a : a + 4096] @ centres.T - half).argmax(axis=1)
    return out


def k_means(x: np.ndarray, k: int, rounds: int = 6, seed: int = 1) -> np.ndarray:
    """Centres by Lloyd's rounds from a fixed random start; an empty one keeps its place."""
    centres = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        counts = np.bincount(at, minlength=k)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


@dataclass(frozen=True)
class Quantiser:
    """Coarse centres, and codebooks for what a vector differs from its centre by, per subspace."""

    centres: np.ndarray
    books: np.ndarray  # subspace x code x WIDTH
    dim: int

    def residuals(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        rest = x - self.centres[at]
        padded = np.zeros((len(x), len(self.books) * WIDTH))
        padded[:, : self.dim] = rest
        return padded.reshape(len(x), len(self.books), WIDTH)

    def encode(self, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of vectors in lists `at`, and how far each is from what its codes stand for."""
        rest = self.residuals(x, at)
        codes = np.column_stack([nearest(rest[:, j], book) for j, book in enumerate(self.books)]).astype(np.uint8)
        error = sum(((rest[:, j] - book[codes[:, j]]) ** 2).sum(axis=1) for j, book in enumerate(self.books))
        return codes, np.sqrt(error)

    def probes(self, x: np.ndarray, at: np.ndarray, radius: float, certainty: float) -> list[np.ndarray]:
        """Lists that may hold a vector within `radius` of each x, its own among them.

        A neighbour in another list is nearer to that list's centre, so the step to it has to make up
        for the difference of the squared distances: its part along the line between the centres must
        be at least gap / (2 |c - c'|). That part is at most the radius, and the radius over the root
        of the dimension on average; `certainty` is how many such averages are probed. At the root of
        the dimension (`exact`) no neighbour can be missed.
        """
        out = []
        between = np.sqrt(np.maximum(((self.centres[:, None] - self.centres[None]) ** 2).sum(axis=2), 1e-12))
        reach = radius * min(1.0, certainty / np.sqrt(self.dim))
        for a in range(0, len(x), 2048):
            part, own = x[a : a + 2048], at[a : a + 2048]
            square = (self.centres**2).sum(axis=1) - 2 * part @ self.centres.T
            gap = (square - square[np.arange(len(part)), own][:, None]) / (2 * between[own])
            near = gap <= reach
            near[np.arange(len(part)), own] = True
            out += [np.flatnonzero(row) for row in near]
        return out

    def tables(self, x: np.ndarray, at: int) -> np.ndarray:
        """Squared distances of each x to every code of a list: vector x subspace x code."""
        rest = self.residuals(x, np.full(len(x), at))
        return np.stack([((rest[:, j, None] - book[None]) ** 2).sum(axis=2) for j, book in enumerate(self.books)], axis=1)


def fit_quantiser(x: np.ndarray, lists: int) -> Quantiser:
    centres = k_means(x, min(lists, len(x)))
    dim = x.shape[1]
    blank = Quantiser(centres, np.zeros((-(-dim // WIDTH), 1, WIDTH)), dim)
    rest = blank.residuals(x, nearest(x, centres))
    books = [k_means(rest[:, j], min(CODES, len(x)), seed=j) for j in range(rest.shape[1])]
    return Quantiser(centres, np.stack(books), dim)


# -- groups -----------------------------------------------------------------------------------


def _vectors(raw: pd.Series) -> np.ndarray:
    x = np.stack([np.frombuffer(v, np.float64) for v in raw])
    return x / np.sqrt((x**2).sum(axis=1, keepdims=True))


def compare(entries: pd.DataFrame, queries: pd.DataFrame, quantiser: Quantiser, at: int, radius: float, threshold: float) -> pd.DataFrame:
    """Links between the queries and the entries of list `at`, as counts per vector and as edges.

    Distances come from the codes by table lookup. They are off by at most an entry's own error, so a
    pair can only be near if its distance is at most the radius and that error; such pairs get their
    exact cosine. A link counts for the query. It counts for the entry too if the entry does not probe
    the query's list, where the pair would be met the other way round.
    """
    ev, qv = _vectors(entries["vec"]), _vectors(queries["vec"])
    codes = np.stack([np.frombuffer(c, np.uint8) for c in entries["code"]]).astype(np.int64)
    limit = (radius + entries["error"].to_numpy() + 1e-6) ** 2
    probed = [frozenset(np.frombuffer(p, np.int32).tolist()) for p in entries["probes"]]
    shift = np.arange(codes.shape[1]) * quantiser.books.shape[1]
    places = codes + shift
    hits_q, hits_e = [], []
    for a in range(0, len(qv), 256):
        tables = quantiser.tables(qv[a : a + 256], at).reshape(len(qv[a : a + 256]), -1)
        for i, table in enumerate(tables):
            near = np.flatnonzero(table[places].sum(axis=1) <= limit)
            if len(near):
                exact = near[ev[near] @ qv[a + i] >= threshold]
                hits_q.append(np.full(len(exact), a + i))
                hits_e.append(exact)
    q = np.concatenate(hits_q) if hits_q else np.zeros(0, np.int64)
    e = np.concatenate(hits_e) if hits_e else np.zeros(0, np.int64)
    q_key, e_key = queries["key"].to_numpy(), entries["key"].to_numpy()
    other = np.array([q_key[i] != e_key[j] for i, j in zip(q, e, strict=True)], bool)
    q, e = q[other], e[other]
    q_n, e_n, q_list = queries["n"].to_numpy(), entries["n"].to_numpy(), queries["own"].to_numpy()
    once = np.array([q_list[i] not in probed[j] for i, j in zip(q, e, strict=True)], bool)
    for_q = np.bincount(q, e_n[e], len(q_key)).astype(np.int64)
    for_e = np.bincount(e[once], q_n[q[once]], len(e_key)).astype(np.int64)
    keys = {k: i for i, k in enumerate(sorted({*q_key[np.unique(q)], *e_key[np.unique(e)]}))}
    label = labels(len(keys), np.array([keys[q_key[i]] for i in q], np.int64), np.array([keys[e_key[j]] for j in e], np.int64))
    names = list(keys)
    edges = [(names[i], names[r], 0) for i, r in enumerate(label.tolist()) if i != r]
    counts = [(k, None, int(c)) for side, number in ((q_key, for_q), (e_key, for_e)) for k, c in zip(side, number, strict=True) if c]
    return pd.DataFrame(edges + counts, columns=["a", "b", "links"])


# -- the operator -----------------------------------------------------------------------------


def _keyed(vectors: DataFrame, dim: int) -> DataFrame:
    """vec_id, and for vectors that can link: a digest of the components and their bytes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keys, raws = [], []
            for v in frame["vec"]:
                x = None if v is None or len(v) != dim else np.array([np.nan if c is None else c for c in v], np.float64)
                good = x is not None and np.isfinite(x).all()
                if good:
                    top = np.abs(x).max()
                    good = top > 0
                raw = (x / top).tobytes() if good else None  # scaled, so that squares stay finite
                raws.append(raw)
                keys.append(hashlib.blake2b(raw, digest_size=16).digest() if good else None)
            yield pd.DataFrame({"vec_id": frame["vec_id"], "key": keys, "vec": raws})

    return map_rows(vectors, run, ("vec_id",), "key binary, vec binary")


def link_vectors(vectors: DataFrame, threshold: float = 0.9, certainty: float = 2.5, exact: bool = False) -> DataFrame:
    """Near-duplicate vectors: vec_id, n_links, component_id, kept.

    Equal vectors (up to their scale) form a class that is compared once. Coarse centres and residual
    codebooks are fitted on at most about SAMPLE classes; every class is then entered in its list and
    compared with the lists its neighbours may lie in (see `Quantiser.probes`; `exact` probes all
    lists that can hold any). Lists and their queries are cut into blocks of bounded size, so a list
    with a large part of all vectors is spread over many tasks; tasks return counts and the edges of a
    forest, never all pairs.

    Null vectors, vectors of zeros, with null or non-finite components, or of another length than most
    link with nothing and are kept. Repeated rows link with each other as different vectors with one
    id. Null ids are linked and counted but name no component unless all of it is null. An empty
    table gives no rows; other columns are ignored.
    """
    plain = vectors.select("vec_id", F.col("embedding").alias("vec"))
    usual = plain.groupBy(F.size("vec").alias("d")).count().where("d > 0").orderBy(F.desc("count"), "d").first()
    dim = usual["d"] if usual else 0
    rows = staged(_keyed(plain, dim))
    good = rows.where("key is not null")
    classes = staged(good.groupBy("key").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"), F.first("vec").alias("vec")))
    count = classes.count()
    radius = float(np.sqrt(2 - 2 * threshold))
    if count == 0:
        return rows.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    part = int(min(1.0, SAMPLE / count) * (1 << 30))
    picked = classes.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < max(1, part)).select("key", "vec").toPandas()
    if not len(picked):
        picked = classes.select("key", "vec").limit(1).toPandas()
    sample = _vectors(picked.sort_values("key")["vec"])
    quantiser = fit_quantiser(sample, max(1, min(LISTS, round(np.sqrt(count)))))
    certain = float(np.sqrt(dim)) if exact else certainty

    def index(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            x = _vectors(frame["vec"])
            own = nearest(x, quantiser.centres)
            codes, error = quantiser.encode(x, own)
            probes = quantiser.probes(x, own, radius, certain)
            yield frame[["key", "n", "vec"]].assign(
                own=own.astype(np.int32), code=[c.tobytes() for c in codes], error=error, probes=[p.astype(np.int32).tobytes() for p in probes],
                probed=[p.astype(np.int32) for p in probes],
            )

    fields = "key binary, n bigint, vec binary, own int, code binary, error double, probes binary"
    indexed = staged(classes.select("key", "n", "vec").mapInPandas(index, f"{fields}, probed array<int>"))
    # a row per list, and there are at most LISTS of them
    entered = {r["own"]: r["count"] for r in indexed.groupBy("own").count().collect()}
    asked = {r["list"]: r["count"] for r in indexed.select(F.explode("probed").alias("list")).groupBy("list").count().collect()}
    blocks = {c: (max(1, -(-entered.get(c, 0) // ENTRIES)), max(1, -(-asked.get(c, 0) // QUERIES))) for c in asked}
    sizes = F.create_map(*(F.lit(x) for c, (e, q) in blocks.items() for x in (c, F.array(F.lit(e), F.lit(q)))))
    held = [c for c in asked if c in entered]
    salt = F.xxhash64("key")

    def dealt(frame: DataFrame, mine: int, role: str) -> DataFrame:
        other = F.explode(F.sequence(F.lit(0), sizes[F.col("list")][1 - mine] - 1))
        own = F.pmod(salt, sizes[F.col("list")][mine]).cast("int")
        out = frame.select("*", own.alias("_mine"), other.alias("_other"))
        e, q = ("_mine", "_other") if mine == 0 else ("_other", "_mine")
        return out.select("list", F.col(e).alias("e_block"), F.col(q).alias("q_block"), F.lit(role).alias("role"), "key", "n", "vec", "own", "code", "error", "probes")

    base = indexed.drop("probed")
    entries = dealt(base.withColumn("list", F.col("own")), 0, "entry")
    asking = indexed.withColumn("list", F.explode("probed")).drop("probed").where(F.col("list").isin(held))
    blank = {"code": "binary", "error": "double", "probes": "binary"}
    queries = dealt(asking.withColumns({c: F.lit(None).cast(t) for c, t in blank.items()}), 1, "query")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        e, q = frame[frame["role"] == "entry"], frame[frame["role"] == "query"]
        if not len(e) or not len(q):
            return pd.DataFrame({"a": [], "b": [], "links": []})
        return compare(e, q, quantiser, int(frame["list"].iloc[0]), radius, threshold)

    found = staged(entries.unionByName(queries).groupBy("list", "e_block", "q_block").applyInPandas(run, "a binary, b binary, links bigint"))
    counts = found.where("b is null").groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("links"))
    joined = components(found.where("b is not null").select("a", "b"))
    placed = classes.select("key", "n", "least").join(joined.withColumnRenamed("node", "key"), "key", "left")
    placed = staged(placed.withColumn("component", F.coalesce("component", "key")).join(counts, "key", "left"))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    by_key = placed.join(least, "component").select("key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    linked = good.select("vec_id", "key").join(by_key, "key").select("vec_id", "n_links", "component_id")
    alone = rows.where("key is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
