"""Documents with nearly the same word n-grams, by a blocked product of document and n-gram incidence."""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow.dataset as ds
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwork import session
from leafwork.llm.common import Buffer, components, drop_table, kept_model, labels, map_rows, mix, sized_batches
from leafwork.llm.warc import file_system
from leafwork.session import staged, staging_root

BLOCK = 50_000  # entries of a block of n-grams, on average
HOT = 20_000  # documents from which an n-gram may be dealt with apart
BITS = 2048  # bits of the picture of a set
KNOWN = 5_000_000  # n-grams whose counts take part in the order
CLUSTER = 2000  # documents up to which a cluster is thinned out by pictures
GROUP = 250_000  # n-grams of the documents that are compared at once
DOCUMENTS = 1500  # documents of a part of a large cluster; two parts are multiplied at once
BATCH = 500_000  # characters hashed at once
SMALL = 500_000  # rows up to which a table of ids and digests, some 60 bytes a row, is broadcast

_FIELDS = np.dtype([("gram", "<u8"), ("doc", "<i8"), ("n", "<i4"), ("at", "<i4")])


@dataclass(frozen=True)
class Measure:
    """Documents link when 100 * intersection >= percent * union of their sets of `words`-word n-grams."""

    words: int = 4
    percent: int = 85

    def prefix(self, n: int) -> int:
        """Entries, in a common order, of which two linked sets share one at least."""
        return n - -(-self.percent * n // 100) + 1

    def needed(self, n, m):
        """The least intersection with which sets of n and m can link."""
        return -(-self.percent * (n + m) // (100 + self.percent))


def gram_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """The sorted hashes of the distinct n-grams of each text.

    A-Z count as a-z. A text with fewer words is one n-gram of all of them, one without words none.
    """
    b = Buffer(texts, lower=True)
    hashed = b.hashes()
    counts = np.bincount(b.row, minlength=b.n)
    ends = np.cumsum(counts)
    grams = np.zeros(max(0, len(hashed) - words + 1), np.uint64)
    for i in range(words):
        grams = grams * np.uint64(0x9FB21C651E98DF25) + hashed[i : i + len(grams)]
    grams = mix(grams)
    out = []
    for end, count in zip(ends.tolist(), counts.tolist(), strict=True):
        if count >= words:
            out.append(np.unique(grams[end - count : end - words + 1]))
        elif count:
            short = np.array([count], np.uint64)
            for h in hashed[end - count : end]:
                short = mix(short * np.uint64(0x9FB21C651E98DF25) + h)
            out.append(short)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


# -- order of n-grams -------------------------------------------------------------------------


def _frequent(docs: DataFrame, words: int) -> tuple[str, int, DataFrame]:
    """A folder with n-grams that many documents have, the number of documents, and the same as a table.

    Each task counts its documents per n-gram and hands on those that three of them share; Spark adds
    them up. The most frequent ones, about KNOWN at most, are kept. Only the order of n-grams rests on
    these counts, so what is missed costs time, not links.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def flush() -> Iterator[pd.DataFrame]:
            grams, counts = np.unique(np.concatenate(held), return_counts=True)
            many = counts >= 3
            grams, counts = grams[many].view(np.int64), counts[many]
            for at in range(0, len(grams), 100_000):
                yield pd.DataFrame({"gram": grams[at : at + 100_000], "n": counts[at : at + 100_000]})

        for frame in sized_batches(frames, "text", BATCH):
            held += gram_sets(frame["text"].tolist(), words)
            size += sum(map(len, held[-len(frame) :]))
            if size > 8_000_000:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    texts = docs.select("text").where("text is not null and text <> ''")
    total = texts.count()
    counts = staged(texts.mapInPandas(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")))
    # a histogram of the counts by powers of two, so it has a few dozen rows
    level = F.floor(F.log2("n")).alias("level")
    held, least = 0, 3
    for row in counts.groupBy(level).count().orderBy(F.desc("level")).collect():
        held += row["count"]
        if held > KNOWN:
            least = 1 << (row["level"] + 1)
            break
    counts = counts.where(F.col("n") >= least)
    folder = f"{staging_root(docs.sparkSession)}/frequent-{uuid.uuid4().hex}"
    session._STAGED.append(folder)
    counts.write.parquet(folder)
    return folder, total, docs.sparkSession.read.schema(counts.schema).parquet(folder)


@kept_model(2)
def _counts(folder: str) -> tuple[np.ndarray, np.ndarray]:
    store, path = file_system(folder)
    table = ds.dataset(path, filesystem=store, format="parquet").to_table()
    if not table.num_rows:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    grams = table["gram"].to_numpy().view(np.uint64)
    order = np.argsort(grams)
    return grams[order], table["n"].to_numpy()[order]


def _look_up(folder: str, grams: np.ndarray) -> np.ndarray:
    names, counts = _counts(folder)
    if not len(names):
        return np.zeros(len(grams), np.int64)
    at = np.minimum(np.searchsorted(names, grams), len(names) - 1)
    return np.where(names[at] == grams, counts[at], 0)


# -- blocks -----------------------------------------------------------------------------------


def _sets(docs: DataFrame, measure: Measure, folder: str) -> DataFrame:
    """doc_id, size and digest of each document's set, its rarest entries in the common order, and its picture.

    The picture is a fixed number of bits; an n-gram sets the one that its hash names.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in sized_batches(frames, "text", BATCH):
            sets = gram_sets(frame["text"].tolist(), measure.words)
            known = np.split(_look_up(folder, np.concatenate(sets)), np.cumsum([len(s) for s in sets])[:-1])
            prefixes, digests, pictures = [], [], []
            for grams, counts in zip(sets, known, strict=True):
                order = np.lexsort((grams, counts))[: measure.prefix(len(grams))] if len(grams) else []
                prefixes.append(grams[order].tobytes() if len(grams) else None)
                digests.append(hashlib.blake2b(grams.tobytes(), digest_size=16).digest() if len(grams) else None)
                bits = np.zeros(BITS, np.uint8)
                bits[(grams % np.uint64(BITS)).astype(np.int64)] = 1
                pictures.append(np.packbits(bits).tobytes() if len(grams) else None)
            yield pd.DataFrame({
                "doc_id": frame["doc_id"], "n": [len(s) for s in sets], "digest": digests, "prefix": prefixes, "picture": pictures,
            })

    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return map_rows(texts, run, ("doc_id",), "n bigint, digest binary, prefix binary, picture binary")


def _entries(frame: pd.DataFrame) -> np.ndarray:
    """The incidence of documents (class, n, prefix) as rows (gram, doc, n, place in the order)."""
    prefixes = [np.frombuffer(p, np.uint64) for p in frame["prefix"]]
    lengths = np.array([len(p) for p in prefixes], np.int64)
    out = np.empty(int(lengths.sum()), _FIELDS)
    out["gram"] = np.concatenate(prefixes) if len(prefixes) else []
    out["doc"] = np.repeat(frame["class"].to_numpy(np.int64), lengths)
    out["n"] = np.repeat(frame["n"].to_numpy(np.int64), lengths)
    out["at"] = np.arange(len(out)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return out


def _blocks(classes: DataFrame, count: int, hot: np.ndarray) -> DataFrame:
    """Entries dealt into `count` blocks of n-grams, packed: a row holds what one task has for one block."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def flush() -> Iterator[pd.DataFrame]:
            rows = np.concatenate(held)
            block = (rows["gram"] % np.uint64(count)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            rows, block = rows[order], block[order]
            first = np.flatnonzero(np.append(True, np.diff(block) != 0))
            parts = [rows[a:b].tobytes() for a, b in zip(first, np.append(first[1:], len(rows)), strict=True)]
            for at in range(0, len(first), 500):
                yield pd.DataFrame({"block": block[first[at : at + 500]], "packed": parts[at : at + 500]})

        for frame in frames:
            rows = _entries(frame)
            if len(hot):
                rows = rows[~np.isin(rows["gram"], hot)]
            held.append(rows)
            size += len(rows)
            if size > 2_000_000:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    return classes.select("class", "n", "prefix").mapInPandas(run, "block bigint, packed binary")


def _level(n: np.ndarray, measure: Measure) -> np.ndarray:
    """Size classes so wide that sets which can link are in the same or in neighbouring ones."""
    return np.floor(np.log(n) / (math.log(100 / measure.percent) + 1e-9)).astype(np.int64)


def _members(blocks: DataFrame, measure: Measure) -> DataFrame:
    """Clusters of documents that share an n-gram of their entries: hub, class.

    The documents of an n-gram and a size class, and those of the class above, are put to the smallest
    of the size class. Any two documents of the n-gram that can link are so in one cluster.

    A document's entries before the n-gram are not shared, so its place bounds what it can share. The
    least place over size among all its documents tells whether a document can have a partner at all.
    """
    share = measure.percent / (100 + measure.percent)

    def several(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not len(rows):
            return rows, np.zeros(0, np.int64), np.zeros(0, np.int64)
        run_of = np.cumsum(np.append(True, rows["gram"][1:] != rows["gram"][:-1])) - 1
        rows = rows[np.bincount(run_of)[run_of] > 1]
        first = np.flatnonzero(np.append(True, rows["gram"][1:] != rows["gram"][:-1])) if len(rows) else np.zeros(0, np.int64)
        return rows, first, np.repeat(np.arange(len(first)), np.diff(np.append(first, len(rows))))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rows = np.concatenate([np.frombuffer(p, _FIELDS) for p in frame["packed"]])
        rows, first, run_of = several(rows[np.lexsort((rows["doc"], rows["n"], rows["gram"]))])
        if not len(rows):
            return pd.DataFrame({"hub": [], "class": []})
        n, at = rows["n"].astype(np.int64), rows["at"].astype(np.int64)
        # the intersection is at most m - m_at and has to reach share * (n + m)
        best = np.minimum.reduceat(at - (1 - share) * n, first)[run_of]
        able = (best <= -share * n + 1e-6) & (n - at >= measure.needed(n, -(-measure.percent * n // 100)))
        rows, first, run_of = several(rows[able])
        if not len(rows):
            return pd.DataFrame({"hub": [], "class": []})
        level = _level(rows["n"].astype(np.int64), measure)
        key = run_of * (1 << 20) + level
        start = np.searchsorted(key, key)
        below = np.searchsorted(key, key - 1)
        under = (below < len(key)) & (key[np.minimum(below, len(key) - 1)] == key - 1)
        doc = rows["doc"]
        pairs = np.column_stack([np.append(doc[start], doc[below[under]]), np.append(doc, doc[under])])
        pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)
        return pd.DataFrame({"hub": pairs[:, 0], "class": pairs[:, 1]})

    return blocks.groupBy("block").applyInPandas(run, "hub bigint, class bigint")


def _members_hot(classes: DataFrame, hot: np.ndarray, measure: Measure) -> DataFrame:
    """The same for n-grams of very many documents, with aggregates that combine before the shuffle."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = _entries(frame)
            rows = rows[np.isin(rows["gram"], hot)]
            n = rows["n"].astype(np.int64)
            yield pd.DataFrame({"gram": rows["gram"].view(np.int64), "class": rows["doc"], "n": n, "at": rows["at"].astype(np.int64), "level": _level(np.maximum(n, 1), measure)})

    rows = staged(classes.select("class", "n", "prefix").mapInPandas(run, "gram bigint, class bigint, n bigint, at bigint, level bigint"))
    share = measure.percent / (100 + measure.percent)
    best = rows.groupBy("gram").agg(F.min(F.col("at") - (1 - share) * F.col("n")).alias("best"))
    rows = rows.join(best, "gram").where(F.col("best") <= -share * F.col("n") + 1e-6)
    hubs = rows.groupBy("gram", "level").agg(F.min(F.struct("n", "class"))["class"].alias("hub"))
    near = rows.withColumn("level", F.explode(F.array(F.col("level"), F.col("level") - 1))).join(hubs, ["gram", "level"])
    return near.where("hub <> class").select("hub", "class")


def _thinned(members: DataFrame, classes: DataFrame, measure: Measure) -> DataFrame:
    """Clusters without the documents that cannot link with any other of their cluster: hub, class.

    A bit in which two pictures differ stands for an n-gram that only one of the sets has. So two sets
    of n and m share at most (n + m - differing bits) / 2. What can link is a cluster of its own, named
    after its smallest document. Clusters of more than CLUSTER documents are left as they are.
    """
    sizes = members.groupBy("hub").agg(F.count("*").alias("size"))
    total = members.count()
    small = members.join(sizes.where(F.col("size") <= CLUSTER), "hub").select("hub", "class")
    hubs = small.select("hub", F.col("hub").alias("class")).distinct()
    group = F.pmod(F.xxhash64("hub"), F.lit(max(1, total // CLUSTER))).alias("group")
    rows = small.unionByName(hubs).select(group, "hub", "class").join(classes.select("class", "n", "picture"), "class")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["hub", "class"])
        hub, name, n = (frame[c].to_numpy(np.int64) for c in ("hub", "class", "n"))
        bits = np.frombuffer(b"".join(frame["picture"]), np.uint64).reshape(len(frame), -1)
        edges = np.flatnonzero(np.diff(hub)) + 1
        found = []
        for a, b in zip([0, *edges], [*edges, len(hub)], strict=True):
            pairs_a, pairs_b = [], []
            for i in range(a, b - 1):
                apart = np.bitwise_count(bits[i + 1 : b] ^ bits[i]).sum(axis=1, dtype=np.int64)
                m = n[i + 1 : b]
                may = ((n[i] + m - apart) // 2 >= measure.needed(n[i], m)) & (measure.percent * np.maximum(n[i], m) <= 100 * np.minimum(n[i], m))
                pairs_b.append(np.flatnonzero(may) + i + 1 - a)
                pairs_a.append(np.full(len(pairs_b[-1]), i - a))
            if pairs_a:
                label = labels(b - a, np.concatenate(pairs_a), np.concatenate(pairs_b))
                moved = np.flatnonzero(label != np.arange(b - a))
                found.append(np.column_stack([name[a + label[moved]], name[a + moved]]))
        pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
        return pd.DataFrame({"hub": pairs[:, 0], "class": pairs[:, 1]})

    thinned = rows.groupBy("group").applyInPandas(run, "hub bigint, class bigint")
    large = members.join(sizes.where(F.col("size") > CLUSTER), "hub").select("hub", "class")
    return thinned.unionByName(large).distinct()


# -- full overlaps ----------------------------------------------------------------------------


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many entries every two of the sets share: the product of their incidence with itself.

    Columns that many sets have are multiplied as a dense matrix, a bounded number at a time; pairs of
    the sets of every other column are counted one by one.
    """
    m = len(sets)
    total = np.zeros(m * m, np.int64)
    sizes = [len(s) for s in sets]
    grams = np.concatenate(sets)
    row = np.repeat(np.arange(m), sizes)
    order = np.argsort(grams, kind="stable")
    grams, row = grams[order], row[order]
    column = np.cumsum(np.append(True, grams[1:] != grams[:-1])) - 1
    often = np.bincount(column)
    dense = often > max(8, m // 8)
    some = dense[column]
    names, index = np.unique(column[some], return_inverse=True)
    product = np.zeros((m, m), np.float32)
    for a in range(0, len(names), 4096):
        part = (index >= a) & (index < a + 4096)
        block = np.zeros((m, min(4096, len(names) - a)), np.float32)
        block[row[some][part], index[part] - a] = 1
        product += block @ block.T
    few = ~some & (often[column] > 1)
    row, column = row[few], column[few]
    if len(row):
        last = np.searchsorted(column, column, side="right")
        counts = last - np.arange(len(row)) - 1
        cuts = np.flatnonzero(np.diff(np.cumsum(counts) // 4_000_000)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(row)], strict=True):
            x = np.repeat(np.arange(a, b), counts[a:b])
            y = np.arange(len(x)) - np.repeat(np.cumsum(counts[a:b]) - counts[a:b], counts[a:b]) + x + 1
            total += np.bincount(row[x] * m + row[y], minlength=m * m)
    total = total.reshape(m, m)
    return total + total.T + np.rint(product).astype(np.int64)


@dataclass(frozen=True)
class Source:
    """Where the texts of classes come from: `docs`, found by ids, or by digests where an id does not tell.

    `named(class, least, n, digest)` names a row of each class by its id; `unsure(doc_id)` are null and
    all ids that several rows have.
    """

    docs: DataFrame
    named: DataFrame
    unsure: DataFrame
    words: int

    def texts(self, items: DataFrame) -> DataFrame:
        """`items(group, cluster, class)` with the text of each class and the digest of its set.

        Where an id belongs to one row, the text goes from the scan straight to its group: ids, groups
        and digests are joined to it on the way. The texts of all other ids are reduced to one per
        digest first, so however many rows share an id, or have none, each text is held once.
        """
        wanted = staged(items.join(self.named.select("class", F.col("least").alias("_least"), F.col("digest").alias("_digest")), "class"))
        texts = self.docs.select(F.col("doc_id").alias("_id"), "text").where("text is not null")
        unsure = self.unsure.select(F.col("doc_id").alias("_unsure"))
        sure = wanted.join(unsure, F.col("_least").eqNullSafe(F.col("_unsure")), "left_anti")
        sure = _small(sure)
        out = texts.join(sure, F.col("_id") == F.col("_least")).select("group", "cluster", "class", "_digest", "text")
        if self.unsure.isEmpty():
            return out
        rest = wanted.join(unsure, F.col("_least").eqNullSafe(F.col("_unsure")), "left_semi")
        among = texts.join(_small(unsure), F.col("_id").eqNullSafe(F.col("_unsure")), "left_semi")
        named = among.select("text", _digest_of(self.words)(F.col("text")).alias("_found")).groupBy("_found").agg(F.first("text").alias("text"))
        return out.unionByName(named.join(rest, F.col("_found") == F.col("_digest")).select("group", "cluster", "class", "_digest", "text"))


def _small(table: DataFrame) -> DataFrame:
    """The table, staged, to be broadcast if it has at most SMALL rows."""
    table = staged(table)
    return F.broadcast(table) if table.count() <= SMALL else table


def _links(items: DataFrame, source: Source, measure: Measure) -> DataFrame:
    """The edges (a, b) of a forest over the links within each cluster of `items` (cluster, class).

    Clusters are dealt into groups of about GROUP n-grams; a group multiplies one cluster after another.
    """
    total = items.join(source.named.select("class", "n"), "class").agg(F.sum("n")).first()[0] or 0
    group = F.pmod(F.xxhash64("cluster"), F.lit(max(1, int(total // GROUP)))).alias("group")
    texts = source.texts(items.select(group, "cluster", "class"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        once = frame.drop_duplicates("class")
        sets = dict(zip(once["class"], gram_sets(once["text"].tolist(), measure.words), strict=True))
        found = []
        for _, names in frame.groupby("cluster")["class"]:
            names = np.unique(names.to_numpy(np.int64))
            if len(names) < 2:
                continue
            some = [sets[name] for name in names]
            size = np.array([len(s) for s in some], np.int64)
            if len(names) == 2:
                shared = len(np.intersect1d(some[0], some[1], assume_unique=True))
                a, b = ([0], [1]) if 100 * shared >= measure.percent * (size.sum() - shared) else ([], [])
            else:
                shared = overlaps(some)
                near = 100 * shared >= measure.percent * (size[:, None] + size[None] - shared)
                a, b = np.nonzero(np.triu(near, 1))
            label = labels(len(names), np.array(a, np.int64), np.array(b, np.int64))
            found += [(int(names[r]), int(names[i])) for i, r in enumerate(label.tolist()) if i != r]
        return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    return staged(texts.select("group", "cluster", "class", "text").groupBy("group").applyInPandas(run, "a bigint, b bigint"))


def _compare(members: DataFrame, source: Source, measure: Measure) -> DataFrame:
    """The component of every document that is linked with another one: node, component.

    A cluster of at most about GROUP n-grams and DOCUMENTS documents is compared at once. A larger one is
    cut into parts by hash, each with the hub, which as a rule joins the copies of one text; after that only documents
    that are not in the hub's component are held against all others, part by part.
    """
    weight = source.named.select("class", F.col("n").alias("weight"))
    # a matrix grows with the square of the documents, however short they are
    count = F.greatest(F.ceil(F.sum("weight") / GROUP), F.ceil(F.count("*") / DOCUMENTS)).cast("int")
    load = staged(members.join(weight, "class").groupBy("hub").agg(count.alias("parts")))
    dealt = members.join(load, "hub").withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int"))
    hubs = load.select("hub", F.col("hub").alias("class"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    items = dealt.select("hub", "class", "part").unionByName(hubs)
    links = _links(items.select(F.xxhash64("hub", "part").alias("cluster"), "class"), source, measure)
    joined = staged(components(links))
    large = load.where("parts > 1")
    if large.isEmpty():
        return joined
    named = joined.withColumnRenamed("node", "class")
    rows = members.join(large, "hub").join(named, "class", "left").withColumn("component", F.coalesce("component", "class"))
    main = large.select("hub", F.col("hub").alias("class")).join(named, "class", "left")
    main = main.select("hub", F.coalesce("component", "class").alias("main"))
    rows = staged(rows.join(main, "hub").withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int")))
    apart = rows.where("component <> main")
    if apart.isEmpty():
        return joined
    lone = staged(apart.join(weight, "class").groupBy("hub").agg(count.alias("slices")))
    sides = [
        apart.join(lone, "hub").select(
            "hub", "class", F.pmod(F.xxhash64("class", F.lit("slice")), F.col("slices")).cast("int").alias("slice"),
            F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
        ),
        rows.join(lone, "hub").select("hub", "class", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "part"),
    ]
    items = sides[0].unionByName(sides[1]).select(F.xxhash64("hub", "slice", "part").alias("cluster"), "class").distinct()
    return staged(components(links.unionByName(_links(items, source, measure))))


def link_documents(docs: DataFrame, measure: Measure = Measure()) -> DataFrame:
    """Documents with the size of their n-gram set and their component: doc_id, n_shingles, component_id.

    Documents with equal sets are one class from the start. Of each class the rarest n-grams are
    entered that two linked sets must share. The incidence is worked off block by block of n-grams, and
    documents fall out whose sizes and remaining entries cannot reach the bound with any other of the
    n-gram; the rest form clusters, which pictures of the sets thin out. Within each cluster whole sets
    are multiplied, which accumulates the overlap of every two documents, and a forest of the links is
    handed on, never all pairs.

    component_id is the smallest doc_id reachable by links. Documents without words, null texts
    included, have no n-grams and are on their own. Repeated rows are kept; null ids are linked but
    name no component unless all of it is null. An empty table gives no rows; other columns are ignored.
    """
    return _linked(docs, measure).select("doc_id", "n_shingles", "component_id")


def _linked(docs: DataFrame, measure: Measure) -> DataFrame:
    """`link_documents` with the digest of each set and `main`, that of the class its component is named after."""
    folder, total, frequent = _frequent(docs, measure.words)
    sets = staged(_sets(docs, measure, folder).withColumn("class", F.monotonically_increasing_id()))
    sets_path = session._STAGED[-1]
    rows = staged(sets.select("doc_id", "n", "digest", "class"))
    # a class is named after one of its rows; the others leave without moving what the rows hold
    named = rows.where("n > 0").groupBy("digest").agg(F.min("class").alias("class"), F.min("doc_id").alias("least"), F.first("n").alias("n"))
    named = staged(named)
    copies = rows.where("n > 0").select("class", "digest").join(named.select("digest", F.col("class").alias("first")), "digest")
    copies = staged(copies.where("class <> first").select("class"))
    classes = sets.where("n > 0").join(F.broadcast(copies) if copies.count() <= SMALL else copies, "class", "left_anti")
    entries = sets.agg(F.sum(F.octet_length("prefix"))).first()[0] or 0
    blocks = max(1, int(entries // 8 // BLOCK))
    # fewer n-grams than this bound times the mean size of a set can be in so many documents
    often = frequent.where(F.col("n") >= max(HOT, total // 10_000))
    hot = np.array([r["gram"] for r in often.select("gram").collect()], np.int64).view(np.uint64)
    members = _members(_blocks(classes, blocks, hot), measure)
    if len(hot):
        members = members.unionByName(_members_hot(classes, hot, measure))
    members = staged(_thinned(staged(members.distinct()), classes, measure))
    drop_table(docs.sparkSession, sets_path)

    many = rows.groupBy("doc_id").agg(F.count("*").alias("count")).where("doc_id is null or count > 1")
    source = Source(docs.select("doc_id", "text"), named, staged(many.select("doc_id")), measure.words)
    joined = _compare(members, source, measure)
    named = named.join(joined.withColumnRenamed("node", "class"), "class", "left")
    named = staged(named.withColumn("component", F.coalesce("component", "class")))
    first = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "digest"))
    ids = named.groupBy("component").agg(first.alias("first"))
    by_digest = named.join(ids, "component").select("digest", F.col("first.least").alias("component_id"), F.col("first.digest").alias("main"))
    shared = ["doc_id", F.col("n").alias("n_shingles"), "digest"]
    linked = rows.where("n > 0").join(by_digest, "digest").select(*shared, "component_id", "main")
    alone = rows.where("n = 0").select(*shared, F.col("doc_id").alias("component_id"), F.col("digest").alias("main"))
    return linked.unionByName(alone)


def _digest_of(words: int):
    """The digest that `_sets` gives, as a column function of the text."""

    def run(texts: pd.Series) -> pd.Series:
        sets = gram_sets(texts.tolist(), words)
        return pd.Series([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], dtype=object)

    return F.pandas_udf(run, "binary")


def keep_one(docs: DataFrame, measure: Measure = Measure()) -> DataFrame:
    """One document of each component, one with the smallest id, with all its columns.

    Rows are judged by id and set, so a row stays or goes whatever other rows share its id. Of rows with
    the same id and set one stays. In components without any id a row without one stays; documents
    without words are on their own, and equal rows of them stay once.
    """
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")) & F.col("digest").eqNullSafe(F.col("main"))
    linked = staged(_linked(docs, measure).select("doc_id", "digest", stays.alias("stays")))
    # an id of one row decides alone; rows without an id or with a repeated one are told apart by their sets
    by_id = staged(linked.groupBy("doc_id").agg(F.count("*").alias("count"), F.min("stays").alias("stays")).where("doc_id is null or count > 1 or not stays"))
    gone = by_id.where("doc_id is not null and count = 1").select(F.col("doc_id").alias("_gone"))
    gone = F.broadcast(gone) if gone.count() <= SMALL else gone
    left = docs.join(gone, docs["doc_id"] == F.col("_gone"), "left_anti")
    again = by_id.where("doc_id is null or count > 1").select(F.col("doc_id").alias("_again"))
    if again.isEmpty():
        return left
    again = F.broadcast(again) if again.count() <= SMALL else again
    same = left["doc_id"].eqNullSafe(F.col("_again"))
    kept = linked.where("stays").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_kept")).distinct()
    unsure = left.join(again, same, "left_semi").withColumn("_digest", _digest_of(measure.words)(F.coalesce("text", F.lit(""))))
    right = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("_digest").eqNullSafe(F.col("_kept"))
    unsure = unsure.join(kept, right, "left_semi").withColumn("_key", F.coalesce("_digest", F.col("text").cast("binary")))
    return left.join(again, same, "left_anti").unionByName(unsure.dropDuplicates(["doc_id", "_key"]).drop("_digest", "_key"))
