"""Editors and creators with names from the user table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwork.functions.ids import blank_to_null
from leafwork.operators.skew import HOT_FLOOR, lookup_slots


def _nameless(user: Column) -> Column:
    return blank_to_null(user["id"]).isNotNull() & blank_to_null(user["name"]).isNull()


def enrich_users(pages: DataFrame, users: DataFrame, *, floor: int = HOT_FLOOR) -> DataFrame:
    """`created_by` and `last_edited_by` with name, type and email where the name is missing.

    Both users of a page are looked up together (see `lookup_slots`); one editor may own a large share
    of all pages. Page ids are unique.
    """
    columns = ("created_by", "last_edited_by")
    known = users.select(
        F.col("id").alias("u_id"),
        F.struct(
            F.col("type"), F.col("name"), F.when(blank_to_null(F.col("email")).isNotNull(), F.struct("email")).alias("person")
        ).alias("u_user"),
    )
    wanted = {f"_{c}": F.when(_nameless(F.col(c)), F.col(c)["id"]) for c in columns}
    found = lookup_slots(pages, known, wanted, "u_id", "u_user", row_id="id", floor=floor)

    def named(column: str) -> Column:
        user, record = F.col(column), F.col(f"_{column}")
        return F.when(
            record.isNotNull(),
            F.struct(
                user["id"].alias("id"), record["type"].alias("type"), record["name"].alias("name"),
                F.coalesce(record["person"], user["person"]).alias("person"),
            ),
        ).otherwise(user)

    return found.withColumns({c: named(c) for c in columns}).drop(*wanted)


def unknown_users(pages: DataFrame, users: DataFrame) -> DataFrame:
    """Ids of nameless editors and creators that the user table lacks."""
    seen = pages.select(F.explode(F.array("created_by", "last_edited_by")).alias("user"))
    wanted = seen.where(_nameless(F.col("user"))).select(F.col("user.id").alias("id"))
    return wanted.distinct().join(users.select("id"), "id", "left_anti")
