"""Rich-text spans, user labels and icons as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafwork.functions.ids import blank_to_null


def user_label(user: Column) -> Column:
    """`Name <email> [id8]`; null for a null user."""
    name = F.coalesce(blank_to_null(user["name"]), F.lit("Unknown"))
    email = F.when(user["type"] == "person", blank_to_null(user["person"]["email"]))
    return F.when(
        user.isNotNull(),
        F.concat(
            name,
            F.coalesce(F.concat(F.lit(" <"), email, F.lit(">")), F.lit("")),
            F.lit(" ["),
            F.substring(F.coalesce(user["id"], F.lit("")), 1, 8),
            F.lit("]"),
        ),
    )


def plain_text(spans: Column) -> Column:
    """Text of all spans without any markup; empty for null."""
    return F.coalesce(
        F.array_join(F.transform(spans, lambda s: F.coalesce(s["plain_text"], F.lit(""))), ""),
        F.lit(""),
    )


def markdown(spans: Column) -> Column:
    """Spans with their annotations (code innermost, then bold, italic, strike) and links."""

    def one(span: Column) -> Column:
        mention = F.when(span["type"] == "mention", user_label(span["mention"]["user"]))
        text = F.coalesce(F.concat(F.lit("@"), mention), span["plain_text"], F.lit(""))
        # marks go around the text from the outside in, so it appears only once in the expression
        marks = [
            F.when(span["annotations"][flag], F.lit(mark)).otherwise(F.lit(""))
            for flag, mark in (("strikethrough", "~~"), ("italic", "_"), ("bold", "**"), ("code", "`"))
        ]
        href = blank_to_null(span["href"])
        opening = F.when(href.isNotNull(), F.lit("[")).otherwise(F.lit(""))
        closing = F.coalesce(F.concat(F.lit("]("), href, F.lit(")")), F.lit(""))
        return F.concat(opening, *marks, text, *reversed(marks), closing)

    return F.coalesce(F.array_join(F.transform(spans, one), ""), F.lit(""))


def icon_text(icon: Column) -> Column:
    """`emoji:…`, `external:…`, `file:…`, or an empty string."""
    return F.coalesce(
        F.when(icon["type"] == "emoji", F.concat(F.lit("emoji:"), F.coalesce(icon["emoji"], F.lit(""))))
        .when(icon["type"] == "external", F.concat(F.lit("external:"), icon["external"]["url"]))
        .when(icon["type"] == "file", F.concat(F.lit("file:"), icon["file"]["url"])),
        F.lit(""),
    )
