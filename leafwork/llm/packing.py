"""Tokens of all documents into sequences, mixed from source queues by deficit round-robin."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafwork.llm.bpe import codec
from leafwork.llm.common import map_rows
from leafwork.session import staged

MAX_QUEUES = 64
END_ID = 0


@dataclass(frozen=True)
class Phase:
    """A span of the output in which the same queues are served in the same proportions.

    `first` and `amount` are the tokens each queue gives (where in the queue, how many), `rounds` the
    number of windows, `base` the place of the phase in the output.
    """

    first: np.ndarray
    amount: np.ndarray
    rounds: int
    base: int

    def given(self, rounds: np.ndarray) -> np.ndarray:
        """Tokens each queue has given after so many rounds, one row per entry of `rounds`.

        A queue is due amount / rounds tokens a window; it gives the whole ones, and the fraction is
        the deficit it carries into the next window. Quotient and rest keep the product in range.
        """
        q, rest = np.divmod(self.amount, self.rounds)
        r = rounds[:, None]
        return q * r + rest * r // self.rounds


def plan_phases(totals: Mapping[int, int], weights: Mapping[int, float] | None, window: int) -> list[Phase]:
    """The phases for queues of so many tokens; a phase ends when a queue runs dry.

    Without weights the proportions are those of the queues themselves, and one phase serves all.
    Every token is placed: queues that are left share the windows in proportion to their weights. A
    queue without a positive weight is served when all others are dry.
    """
    names = sorted(totals)
    left = np.array([totals[q] for q in names], np.int64)
    weight = np.array([float(totals[q]) if weights is None else max(0.0, weights.get(q, 0.0)) for q in names])
    given, phases, base = np.zeros_like(left), [], 0
    while left.sum():
        share = np.where(left > 0, weight, 0.0)
        if not share.sum():
            share = left.astype(float)
        if weights is None:
            amount = left.copy()
        else:
            served = share > 0
            turns = (left[served] / share[served]).min()
            amount = np.where(served, np.minimum(left, np.round(share * turns).astype(np.int64)), 0)
            dry = served & (left / np.where(served, share, 1.0) <= turns * (1 + 1e-12))
            amount = np.where(dry, left, amount)
        phases.append(Phase(given.copy(), amount, max(1, -(-int(amount.sum()) // window)), base))
        given, left, base = given + amount, left - amount, base + int(amount.sum())
    return phases


def _expand(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and value of all integers of the ranges [start, end)."""
    counts = ends - starts
    owner = np.repeat(np.arange(len(starts)), counts)
    return owner, np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + starts[owner]


def place(phases: list[Phase], queue: np.ndarray, start: np.ndarray, length: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Cut ranges of queues into pieces: (range, offset in it, length, place in the output).

    Pieces end where a window passes on to the next queue and where a sequence of `size` is full.
    """
    out = []
    for phase in phases:
        first, amount = phase.first[queue], phase.amount[queue]
        lo = np.clip(start - first, 0, amount)
        hi = np.clip(start + length - first, 0, amount)
        rows = np.flatnonzero(hi > lo)
        if not len(rows):
            continue
        q, lo, hi, total = queue[rows], lo[rows], hi[rows], amount[rows]

        def given(r, q=q, phase=phase):
            quotient, rest = np.divmod(phase.amount[q], phase.rounds)
            return quotient * r + rest * r // phase.rounds

        def round_of(u, total=total, phase=phase, given=given):
            r = np.clip((u / total * phase.rounds).astype(np.int64), 0, phase.rounds - 1)
            while (high := given(r) > u).any():
                r -= high
            while (low := given(r + 1) <= u).any():
                r += low
            return r

        owner, r = _expand(round_of(lo), round_of(hi - 1) + 1)
        done, due = phase.given(r), phase.given(r + 1)
        mine, columns = q[owner], np.arange(len(owner))
        u0, u1 = np.maximum(lo[owner], done[columns, mine]), np.minimum(hi[owner], due[columns, mine])
        turn = np.cumsum(due - done, axis=1)[columns, mine] - (due - done)[columns, mine]
        at = phase.base + done.sum(axis=1) + turn + u0 - done[columns, mine]
        held = u1 > u0
        owner, u0, u1, at = owner[held], u0[held], u1[held], at[held]
        piece, k = _expand(at // size, (at + u1 - u0 - 1) // size + 1)
        g0, g1 = np.maximum(at[piece], k * size), np.minimum((at + u1 - u0)[piece], (k + 1) * size)
        row = rows[owner[piece]]
        offset = u0[piece] + g0 - at[piece] + phase.first[queue[row]] - start[row]
        out.append((row, offset, g1 - g0, g0))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _queue_of(docs: DataFrame, column: str, limit: int, weights: Mapping[str, float] | None = None) -> tuple[Column, dict]:
    """The queue number of a row, and the number of each source that has a queue of its own.

    More than `limit` sources share that many queues by hash. Every source with a positive weight then
    has a queue of its own after those, so no weight is lost.
    """
    names = [r[0] for r in docs.select(F.col(column).cast("string")).distinct().limit(limit + 1).collect()]
    shared = len(names) > limit
    if shared:
        names = [n for n, w in (weights or {}).items() if w > 0]
    numbers = {n: i + limit * shared for i, n in enumerate(sorted(names, key=lambda n: (n is not None, n or "")))}
    pairs = [F.lit(x) for n, i in numbers.items() if n is not None for x in (n, i)]
    known = F.create_map(*pairs)[F.col(column).cast("string")] if pairs else F.lit(None).cast("int")
    if shared:
        rest = F.pmod(F.xxhash64(F.col(column).cast("string")), F.lit(limit))
        if None in numbers:
            rest = F.when(F.col(column).isNull(), F.lit(numbers[None])).otherwise(rest)
        return F.coalesce(known, rest).cast("int"), numbers
    return F.coalesce(known, F.lit(0)).cast("int"), numbers


def pack_documents(
    docs: DataFrame,
    path: str,
    *,
    size: int = 1024,
    window_sequences: int = 16,
    weights: Mapping[str, float] | None = None,
    queue: str = "source",
    max_queues: int = MAX_QUEUES,
) -> DataFrame:
    """Pack the tokens of all documents into sequences of `size`, mixed by source.

    Each source is a queue of tokens (documents in table order, each followed by id 0). Windows of
    `window_sequences` sequences are filled by deficit round-robin: every window takes from each
    queue the tokens its share is due, whole tokens only, and carries the fraction on. Shares are
    `weights` by source, or the sources' own token counts. As shares are exact fractions, what a
    queue has given after r windows is a closed form, so tasks place their documents alone, from the
    number of tokens their queue has before them; deficits pass partition borders without a hand-over.
    All sequences but the last are full, so nothing needs padding but the last.

    More than `max_queues` sources share that many queues; with `weights`, those that have a positive one
    keep queues of their own. Within a shared queue the order is that of the table.

    Returns a row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    queue. Null text counts as empty (id 0 alone); a null source is a source; repeated rows are
    packed each; an empty table gives no rows; other columns are ignored.
    """
    number, numbers = _queue_of(docs, queue, max_queues, weights)

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder, part, given = codec(path), TaskContext.get().partitionId(), {}
        small = np.uint16 if coder.size <= 1 << 16 else np.uint32
        for frame in frames:
            ids = [coder.encode(t or "") for t in frame["text"]]
            lengths = np.array([len(i) + 1 for i in ids], np.int64)
            starts = np.zeros(len(frame), np.int64)
            numbers = frame["queue"].to_numpy()
            for q in np.unique(numbers):
                mine = numbers == q
                ends = given.get(q, 0) + np.cumsum(lengths[mine])
                starts[mine] = ends - lengths[mine]
                given[q] = int(ends[-1])
            end = np.array([END_ID], small).tobytes()
            yield pd.DataFrame({
                "doc_id": frame["doc_id"], "queue": numbers, "part": part, "start": starts, "n": lengths,
                "width": np.dtype(small).itemsize, "ids": [i.astype(small).tobytes() + end for i in ids],
            })

    tokens = staged(
        map_rows(
            docs.select("doc_id", number.alias("queue"), "text"), encode, ("doc_id",),
            "queue int, part int, start bigint, n bigint, width int, ids binary",
        )
    )
    counts = tokens.groupBy("queue", "part").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = staged(counts.select("queue", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.col("n").alias("held")))
    found = {r["queue"]: r["n"] for r in bases.groupBy("queue").agg(F.sum("held").alias("n")).collect()}
    totals = {q: found.get(q, 0) for q in range(max(found, default=-1) + 1)}
    by_queue = None if weights is None else {i: weights.get(n, 0.0) for n, i in numbers.items()}
    phases = plan_phases(totals, by_queue, size * window_sequences)

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            start = (frame["start"] + frame["base"]).to_numpy(np.int64)
            length = frame["n"].to_numpy(np.int64)
            row, offset, n, at = place(phases, frame["queue"].to_numpy(np.int64), start, length, size)
            width = int(frame["width"].iloc[0])
            ids = [memoryview(np.frombuffer(i, f"<u{width}").astype("<u4")).cast("B") for i in frame["ids"]]
            checks = [zlib.crc32(ids[r][4 * o : 4 * (o + k)]) for r, o, k in zip(row.tolist(), offset.tolist(), n.tolist(), strict=True)]
            yield pd.DataFrame({
                "doc_id": frame["doc_id"].to_numpy()[row], "start": offset, "length": n,
                "ids_crc32": np.array(checks, np.int64), "doc_tokens": length[row],
                "sequence_id": at // size, "offset": at % size, "queue": frame["queue"].to_numpy()[row],
            })

    # a row per queue and partition of the first pass: Spark broadcasts it while it is small
    placed = tokens.join(bases.select("queue", "part", "base"), ["queue", "part"])
    return map_rows(
        placed.select("doc_id", "queue", "start", "base", "n", "width", "ids"), cut, ("doc_id",),
        "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, queue int",
    )
