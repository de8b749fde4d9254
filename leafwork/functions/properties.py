"""Titles and typed properties of pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafwork.functions.richtext import plain_text
from leafwork.functions.text import plain_number, quoted


def page_title(properties: Column) -> Column:
    """Property `title`, else `Name`, else any filled title property, else `Untitled`.

    A `title` or `Name` that is present but empty gives an empty title. Among several title
    properties the first name in byte order is taken.
    """
    titled = F.array_sort(
        F.filter(
            F.map_entries(properties),
            lambda e: (e["value"]["type"] == "title") & (F.size(e["value"]["title"]) > 0),
        ).getField("key")
    )
    fallback = F.when(F.size(titled) > 0, plain_text(properties[F.get(titled, F.lit(0))]["title"]))
    return (
        F.when(F.map_contains_key(properties, "title"), plain_text(properties["title"]["title"]))
        .when(F.map_contains_key(properties, "Name"), plain_text(properties["Name"]["title"]))
        .otherwise(F.coalesce(fallback, F.lit("Untitled")))
    )


def entry_title(properties: Column) -> Column:
    """Title of a database entry: any filled title property, whatever its name."""
    titled = F.array_sort(
        F.filter(
            F.map_entries(properties),
            lambda e: (e["value"]["type"] == "title") & (F.size(e["value"]["title"]) > 0),
        ).getField("key")
    )
    return F.coalesce(
        F.when(F.size(titled) > 0, plain_text(properties[F.get(titled, F.lit(0))]["title"])),
        F.lit("Untitled"),
    )


def property_text(prop: Column) -> Column:
    """Header text of a property value by type; null when the property is left out."""
    kind = prop["type"]
    formula, rollup, unique = prop["formula"], prop["rollup"], prop["unique_id"]
    number = F.coalesce(unique["number"], F.lit(0)).cast("string")

    def pick(arms: dict[str, Column]) -> Column:
        chosen = F.when(kind == "title", F.lit(None))
        for name, value in arms.items():
            chosen = chosen.when(kind == name, value)
        return chosen

    texts = pick(
        {
            "rich_text": F.when(F.size(prop["rich_text"]) > 0, plain_text(prop["rich_text"])),
            "select": prop["select"]["name"],
            "status": prop["status"]["name"],
            "date": prop["date"]["start"],
            "url": prop["url"],
            "email": prop["email"],
            "phone_number": prop["phone_number"],
            "created_by": prop["created_by"]["id"],
            "last_edited_by": prop["last_edited_by"]["id"],
            "created_time": prop["created_time"],
            "last_edited_time": prop["last_edited_time"],
        }
    )
    lists = pick(
        {
            "multi_select": prop["multi_select"]["name"],
            "people": prop["people"]["id"],
            "relation": prop["relation"]["id"],
        }
    )
    lines = F.transform(lists, lambda v: F.concat(F.lit("    - "), quoted(F.coalesce(v, F.lit("")))))

    def flag(value: Column) -> Column:
        return F.when(value, "true").when(~value, "false")

    # one type is looked for at a time, as the whole is worked out for every property of every page
    return (
        F.when(kind == "number", plain_number(prop["number"]))
        .when(kind == "checkbox", flag(F.coalesce(prop["checkbox"], F.lit(False))))
        .when(
            kind.isin("multi_select", "people", "relation"),
            F.when(F.size(lines) > 0, F.concat(F.lit("\n"), F.array_join(lines, "\n"))),
        )
        .when(
            kind == "formula",
            F.when(formula["type"] == "string", quoted(formula["string"]))
            .when(formula["type"] == "date", quoted(formula["date"]["start"]))
            .when(formula["type"] == "number", plain_number(formula["number"]))
            .when(formula["type"] == "boolean", flag(formula["boolean"])),
        )
        .when(
            kind == "rollup",
            F.when(rollup["type"] == "date", quoted(rollup["date"]["start"])).when(
                rollup["type"] == "number", plain_number(rollup["number"])
            ),
        )
        .when(
            kind == "unique_id",
            F.coalesce(quoted(F.concat(unique["prefix"], F.lit("-"), number)), F.when(unique.isNotNull(), number)),
        )
        .otherwise(quoted(texts))
    )


def property_lines(properties: Column) -> Column:
    """`  name: value` lines in byte order of the names; empty text when none is filled."""
    entries = F.transform(
        F.map_entries(properties),
        lambda e: F.struct(e["key"].alias("name"), property_text(e["value"]).alias("text")),
    )
    filled = F.sort_array(F.filter(entries, lambda e: e["text"].isNotNull() & (e["text"] != "")))
    lines = F.transform(filled, lambda e: F.concat(F.lit("  "), e["name"], F.lit(": "), e["text"], F.lit("\n")))
    return F.coalesce(F.array_join(lines, ""), F.lit(""))
