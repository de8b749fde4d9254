"""The work queue as a log of numbered commits.

A commit is one Parquet folder of changed rows and one marker file that names it. Rows are read from
folders that have a marker only, so a commit is there with all its additions, retries and
acknowledgements, or not at all. Every commit belongs to a micro-batch of a writer, and a batch that
has its commit makes no other, so a replay changes nothing. One job at a time writes to a log.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork.operators.queueing import FIRST_REGULAR, number_events, number_files
from leafwork.session import staged
from leafwork.sources.index import _filesystem, path_exists, remove

ENTRY = (
    "seq BIGINT, pos INT, type STRING, folder STRING, parent_id STRING, page_id STRING, last_edited TIMESTAMP, "
    "legacy BOOLEAN, attempts INT"
)
KEY = ["seq", "pos"]
COLUMNS = [field.split()[0] for field in ENTRY.split(", ")]
PUT, DONE = "put", "done"
CHANGE, BASE = "change", "base"
BASE_EVERY = 50  # commits after which the rows that are left are written out once more


@dataclass(frozen=True)
class Commit:
    number: int
    writer: str
    batch: int
    kind: str

    @property
    def name(self) -> str:
        return f"{self.number:012d}.{self.writer}.{self.batch}.{self.kind}"


def commits(spark: SparkSession, path: str) -> list[Commit]:
    """The commits of the log in order; the markers' names tell all."""
    if not path_exists(spark, f"{path}/_commits"):
        return []
    system, target = _filesystem(spark, f"{path}/_commits")
    names = [status.getPath().getName() for status in system.listStatus(target)]
    found = [name.split(".") for name in names if re.fullmatch(r"\d+\.[\w-]+\.\d+\.\w+", name)]
    return sorted((Commit(int(n), writer, int(batch), kind) for n, writer, batch, kind in found), key=lambda c: c.number)


def committed(spark: SparkSession, path: str, writer: str, batch: int) -> Commit | None:
    return next((c for c in commits(spark, path) if (c.writer, c.batch, c.kind) == (writer, batch, CHANGE)), None)


def _mark(spark: SparkSession, path: str, commit: Commit) -> None:
    system, target = _filesystem(spark, f"{path}/_commits/{commit.name}")
    system.create(target, False).close()  # fails if another writer took the name


def read_log(spark: SparkSession, path: str, upto: int | None = None, *, columns: Sequence[str] = COLUMNS) -> DataFrame:
    """Rows that wait, as of commit `upto` or of now: those whose last change is not an acknowledgement.

    Only `columns` are read. For `(seq, pos)` alone the last changes are numbers, which need no sort; else
    rows are dealt by key first, as hardly any are summed up before, and so are sorted once.
    """
    known = [c for c in commits(spark, path) if upto is None or c.number <= upto]
    start = max((i for i, c in enumerate(known) if c.kind == BASE), default=0)
    if not known:
        return spark.createDataFrame([], ENTRY).select(*columns)
    folders = [f"{path}/{c.name}" for c in known[start:]]
    changes = spark.read.schema(f"{ENTRY}, op STRING, commit BIGINT").parquet(*folders)
    values = [c for c in columns if c not in KEY]
    if not values:
        turn = F.col("commit") * 2 + (F.col("op") == PUT).cast("bigint")
        return changes.groupBy(*KEY).agg(F.max(turn).alias("turn")).where("turn % 2 = 1").select(*columns)
    last = changes.repartition(*KEY).groupBy(*KEY).agg(F.max_by(F.struct(*values, "op"), "commit").alias("row"))
    return last.where(F.col("row.op") == PUT).select(*(c if c in KEY else F.col(f"row.{c}").alias(c) for c in columns))


def commit(
    spark: SparkSession, path: str, writer: str, batch: int, put: DataFrame | None = None, done: DataFrame | None = None
) -> Commit:
    """Add or replace the rows `put` and acknowledge `done(seq, pos)`, all or nothing.

    A row of both stays. If the batch of this writer has its commit already, nothing happens.
    """
    known = commits(spark, path)
    made = next((c for c in known if (c.writer, c.batch, c.kind) == (writer, batch, CHANGE)), None)
    if made is not None:
        return made
    new = Commit(known[-1].number + 1 if known else 1, writer, batch, CHANGE)
    rows = spark.createDataFrame([], f"{ENTRY}, op STRING")
    if put is not None:
        filled = put if "attempts" in put.columns else put.withColumn("attempts", F.lit(0))
        filled = filled if "legacy" in filled.columns else filled.withColumn("legacy", F.lit(False))
        rows = rows.unionByName(filled.select(*COLUMNS, F.lit(PUT).alias("op")))
    if done is not None:
        gone = done.select(*KEY).distinct()
        gone = gone if put is None else gone.join(put.select(*KEY), KEY, "left_anti")
        rows = rows.unionByName(gone.withColumn("op", F.lit(DONE)), allowMissingColumns=True)
    _write(spark, path, rows, new)
    if new.number % BASE_EVERY == 0:
        base = Commit(new.number + 1, "log", new.number, BASE)
        _write(spark, path, read_log(spark, path).withColumn("op", F.lit(PUT)), base)
    return new


def _write(spark: SparkSession, path: str, rows: DataFrame, new: Commit) -> None:
    rows.withColumn("commit", F.lit(new.number).cast("bigint")).write.mode("overwrite").parquet(f"{path}/{new.name}")
    _mark(spark, path, new)


def forget(spark: SparkSession, path: str) -> int:
    """Delete the folders of commits before the latest base and of attempts that were never finished.

    Their markers stay, as a replay asks for them. Returns the number of folders.
    """
    known = commits(spark, path)
    bases = [c.number for c in known if c.kind == BASE]
    needed = {c.name for c in known if not bases or c.number >= bases[-1]}
    system, target = _filesystem(spark, path)
    names = [status.getPath().getName() for status in system.listStatus(target)] if path_exists(spark, path) else []
    old = [name for name in names if name != "_commits" and name not in needed]
    for name in old:
        remove(spark, f"{path}/{name}")
    return len(old)


def ends(waiting: DataFrame) -> tuple[int, int]:
    """Where new numbers go: events below the first, files from the second on."""
    row = waiting.agg(F.min("seq"), F.max("seq")).first()
    least = FIRST_REGULAR if row[0] is None else min(FIRST_REGULAR, row[0])
    greatest = FIRST_REGULAR if row[1] is None else max(FIRST_REGULAR, row[1] + 1)
    return least, greatest


def add_events(spark: SparkSession, path: str, batch: int, rows: DataFrame, *, writer: str = "events") -> Commit:
    """Commit changed pages `(type, folder, parent_id, page_id, last_edited)` before everything that waits.

    The latest arrival comes first, and those of a later batch before those of an earlier one.
    """
    made = committed(spark, path, writer, batch)
    if made is not None:
        return made
    least, _ = ends(read_log(spark, path, columns=KEY))
    numbered = number_events(rows, [F.col("last_edited"), F.col("page_id")], first=least)
    return commit(spark, path, writer, batch, numbered)


def settle(
    spark: SparkSession, path: str, batch: int, outcomes: DataFrame, follow_up: DataFrame, *, writer: str = "sync"
) -> Commit:
    """Commit what a run of the queue came to: done rows go, rows to retry stay, follow-up work is added.

    `outcomes(seq, pos, outcome)` are those of `plans.sync`; `follow_up` has a `position` besides the
    columns of queue rows. A retried row keeps its place and counts its attempts.
    """
    made = committed(spark, path, writer, batch)
    if made is not None:
        return made
    # outcomes may be as dear as reading the log, and what is put is written and looked at
    judged = staged(outcomes.select(*KEY, "outcome"))
    retried = read_log(spark, path).join(judged.where("outcome = 'retry'").select(*KEY).distinct(), KEY, "left_semi")
    retried = retried.withColumn("attempts", (F.col("attempts") + 1).cast("int"))
    _, greatest = ends(read_log(spark, path, columns=KEY))
    added = number_files(follow_up, [F.col("position"), F.col("page_id")], first=greatest)
    put = retried.unionByName(added.select(*(c for c in COLUMNS if c not in ("legacy", "attempts")), F.lit(False).alias("legacy"), F.lit(0).alias("attempts")))
    return commit(spark, path, writer, batch, staged(put), judged.where("outcome not in ('retry', 'waiting')"))
