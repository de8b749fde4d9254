"""Pages and databases as Markdown documents with a metadata header."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwork import __version__
from leafwork.functions.ids import blank_to_null, normalize_id, parent_id
from leafwork.functions.paths import stem
from leafwork.functions.properties import entry_title, page_title, property_lines
from leafwork.functions.richtext import icon_text, plain_text, user_label
from leafwork.functions.text import bound, quoted, rfc3339, slug
from leafwork.operators.blocks import COLLAPSE_END, LAST, LIST_ITEMS, block_text, in_context, slim_context, split
from leafwork.operators.ordering import PART_BYTES, in_parts, ordered_text, oversized, with_index
from leafwork.operators.skew import HOT_FLOOR, lookup
from leafwork.session import staged

NO_ENTRIES = "*This database has no direct child pages.*\n\n"  # fixed value


def metadata_header(row: dict[str, Column], version_key: str = "tool_version") -> Column:
    """YAML header with its fields in a fixed order; empty optional fields are left out.

    Field names are fixed values of the document format, except the name of the version field.
    """

    def line(name: str, value: Column, when: Column | None = None) -> Column:
        text = F.concat(F.lit(f"{name}: "), value, F.lit("\n"))
        return text if when is None else F.when(when, text)

    def optional(name: str, value: Column, *, quote: bool = False) -> Column:
        filled = blank_to_null(value)
        return line(name, quoted(filled) if quote else filled)

    def person(name: str, user: Column) -> Column:
        return line(name, quoted(user_label(user)), blank_to_null(user["id"]).isNotNull())

    properties = property_lines(row["properties"]) if "properties" in row else F.lit("")
    parts = [
        F.lit("---\n"),
        line(version_key, F.lit(__version__)),
        line("notion_id", row["id"]),
        optional("title", row["title"], quote=True),
        line("notion_type", row["type"]),
        optional("notion_folder", row["folder"]),
        optional("file_path", row["file_path"]),
        person("created_by", row["created_by"]),
        person("last_edited_by", row["last_edited_by"]),
        line("last_edited", rfc3339(row["last_edited"])),
        line("last_synced", rfc3339(row["last_synced"]), row["last_synced"].isNotNull()),
        optional("icon", icon_text(row["icon"]), quote=True),
        optional("notion_parent_id", row["parent_id"]),
        line("is_root", row["is_root"].cast("string")),
        line("notion_url", F.coalesce(row["url"], F.lit(""))),
        line("simplified_depth", row["simplified_depth"].cast("string"), row["simplified_depth"] > 0),
        optional("download_duration", row["download_duration"]),
        F.when(row["is_entry"], bound(properties, lambda lines: F.when(lines != "", F.concat(F.lit("properties:\n"), lines)))),
        F.lit("---\n\n"),
    ]
    return F.concat(*[F.coalesce(part, F.lit("")) for part in parts])


def fragments(
    blocks: DataFrame,
    titles: DataFrame,
    *,
    file_url: Callable[[Column], Column] = lambda url: url,
    max_level: int = 0,
    floor: int = HOT_FLOOR,
) -> DataFrame:
    """Text pieces of all visible blocks: `(page_id, top, is_list, path, text)`.

    The blocks come as they were landed, or `prepared`, with `file_url` applied then.
    `titles(page_id, title)` is only joined to links to child pages, which are placed in a
    directory named after the title of the page they are on.
    """
    named = titles.select(F.col("page_id").alias("n_id"), slug(F.col("title")).alias("page_slug"))
    tree, links, plain = split(blocks, file_url)
    nested = slim_context(tree, max_level=max_level, floor=floor)
    rows = []
    if nested is not None:
        rows.append(in_context(plain.where("not top"), nested).withColumn("page_slug", F.lit(None).cast("string")))
    if not links.isEmpty():
        below = None if links.where("not top").isEmpty() else nested
        # staged, as keys are counted before the join
        links = staged(in_context(links, below).where("visible"))
        rows.append(lookup(links, named, "page_id", "n_id", floor=floor).drop("n_id"))
    tops = in_context(plain.where("top"), None).withColumn("page_slug", F.lit(None).cast("string"))
    # pieces are read more than once: those of the bulk are staged already, the others are after their joins
    joined = [staged(_pieces(part)) for part in rows]
    return reduce(DataFrame.unionByName, joined, _pieces(tops))


def _pieces(rows: DataFrame) -> DataFrame:
    """Pieces of the visible blocks among `rows`: what opens a block, and what closes it after all that is below it."""
    opened = rows.where("visible").select("*", block_text(F.coalesce("page_slug", F.lit("untitled"))).alias("opening"))
    opening = F.struct(F.col("path"), F.col("opening").alias("text"))
    closing = F.struct(F.concat("path", F.array(F.lit(LAST))).alias("path"), F.lit(COLLAPSE_END).alias("text"))
    return (
        opened.select(
            "page_id",
            F.get("path", F.lit(0)).alias("top"),
            ((F.col("level") == 0) & F.col("type").isin(*LIST_ITEMS)).alias("is_list"),
            F.explode(F.when(F.col("closes"), F.array(opening, closing)).otherwise(F.array(opening))).alias("piece"),
        )
        .select("page_id", "top", "is_list", "piece.path", "piece.text")
    )


def _separated(tops: Column) -> Column:
    """Top-level texts in order, with a blank line after each unless the rules forbid it."""

    def spaced(piece: Column, at: Column) -> Column:
        following = F.get(tops, at + 1)
        gap = (
            following.isNotNull()
            & (piece["content"] != "")
            & ~(piece["is_list"] & F.coalesce(following["is_list"], F.lit(False)))
        )
        return F.concat(piece["content"], F.when(gap, F.lit("\n")).otherwise(F.lit("")))

    return F.array_join(F.transform(tops, spaced), "")


def bodies(pieces: DataFrame, *, limit: int = PART_BYTES) -> DataFrame:
    """Document bodies `(page_id, part_no, content)` from `fragments`.

    Pages with more text than `limit` are found by measuring all. The others are concatenated after
    a single shuffle on the page: both group-bys reuse its partitioning.
    """
    big = oversized(pieces, ["page_id"], "text", limit=limit)
    ordinary = pieces if big is None else pieces.join(big, "page_id", "left_anti")
    per_top = (
        ordinary.repartition("page_id")
        .groupBy("page_id", "top")
        .agg(
            F.bool_or("is_list").alias("is_list"),
            F.array_join(F.sort_array(F.collect_list(F.struct("path", "text")))["text"], "").alias("content"),
        )
    )
    small = (
        per_top.groupBy("page_id")
        .agg(F.sort_array(F.collect_list(F.struct("top", "is_list", "content"))).alias("tops"))
        .select("page_id", F.lit(0).cast("bigint").alias("part_no"), _separated(F.col("tops")).alias("content"))
    )
    if big is None:
        return small
    # Very large pages: separators become fragments of their own, found by joining each top-level
    # block to its successor in a global numbering; then the pieces are cut into parts.
    large = staged(pieces.join(big, "page_id", "left_semi"))
    tops = large.groupBy("page_id", "top").agg(
        F.bool_or("is_list").alias("is_list"), F.max(F.length("text")).alias("longest")
    )
    numbered = staged(with_index(tops, [F.col("page_id"), F.col("top")], "at"))
    following = numbered.select(
        "page_id", (F.col("at") - 1).alias("at"), F.col("is_list").alias("next_is_list")
    )
    gaps = (
        numbered.join(following, ["page_id", "at"])
        .where((F.col("longest") > 0) & ~(F.col("is_list") & F.col("next_is_list")))
        .select("page_id", F.array("top", F.lit(LAST), F.lit(0)).alias("path"), F.lit("\n").alias("text"))
    )
    everything = large.select("page_id", "path", "text").unionByName(gaps)
    return small.unionByName(in_parts(everything, ["page_id"], ["path"], "text", limit=limit))


def _documents(heads: DataFrame, texts: DataFrame) -> DataFrame:
    """Header and heading in front of the first part; pages without a body are kept.

    A document is one row with `part_no` 0, or consecutive parts when its body was cut.
    """
    joined = heads.join(texts.withColumnRenamed("page_id", "b_id"), F.col("page_id") == F.col("b_id"), "left")
    part = F.coalesce("part_no", F.lit(0).cast("bigint"))
    content = F.concat(F.when(part == 0, F.col("head")).otherwise(""), F.coalesce("content", F.lit("")))
    return joined.select(
        "page_id", "file_path", part.alias("part_no"), content.alias("content")
    ).withColumn("content_hash", F.sha2("content", 256))


def render_pages(
    pages: DataFrame,
    blocks: DataFrame,
    *,
    header: bool = True,
    version_key: str = "tool_version",
    file_url: Callable[[Column], Column] = lambda url: url,
    max_level: int = 0,
    limit: int = PART_BYTES,
    floor: int = HOT_FLOOR,
) -> DataFrame:
    """Documents of `pages`: `(page_id, file_path, part_no, content, content_hash)`.

    `pages` are page records with the placement columns `folder, file_path, last_synced, is_root,
    resolved_parent_id` and optionally `simplified_depth` and `download_duration`.
    """
    pages = pages.withColumn("_title", page_title(F.col("properties")))
    title = F.col("_title")
    # staged, as properties are gone through once for headers and for the titles that links are placed by
    heads = staged(pages.select(
        normalize_id(F.col("id")).alias("page_id"),
        "file_path",
        title.alias("title"),
        (
            metadata_header(
                {
                    "id": F.col("id"),
                    "title": title,
                    "type": F.lit("page"),
                    "folder": F.col("folder"),
                    "file_path": F.col("file_path"),
                    "created_by": F.col("created_by"),
                    "last_edited_by": F.col("last_edited_by"),
                    "last_edited": F.col("last_edited_time"),
                    "last_synced": F.col("last_synced"),
                    "icon": F.col("icon"),
                    "parent_id": F.col("resolved_parent_id"),
                    "is_root": F.col("is_root"),
                    "url": F.col("url"),
                    "simplified_depth": _optional(pages, "simplified_depth", "int"),
                    "download_duration": _optional(pages, "download_duration", "string"),
                    "is_entry": blank_to_null(F.col("parent.database_id")).isNotNull(),
                    "properties": F.col("properties"),
                },
                version_key,
            )
            if header
            else F.lit("")
        ).alias("header"),
    ).select(
        "page_id",
        "file_path",
        "title",
        F.concat(
            "header",
            F.when(F.col("title") != "", F.concat(F.lit("# "), "title", F.lit("\n\n"))).otherwise(""),
        ).alias("head"),
    ))
    pieces = fragments(blocks, heads.select("page_id", "title"), file_url=file_url, max_level=max_level, floor=floor)
    texts = bodies(pieces, limit=limit)
    return _documents(heads, texts)


def _optional(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def keyed_entries(entries: DataFrame) -> DataFrame:
    """What lists show of entries, with their parent: `(database_id, position, entry_id, title)`."""
    return entries.select(
        normalize_id(parent_id(F.col("parent"))).alias("database_id"),
        "position",
        normalize_id(F.col("id")).alias("entry_id"),
        entry_title(F.col("properties")).alias("title"),
    )


def direct_entries(databases: DataFrame, entries: DataFrame, *, floor: int = HOT_FLOOR) -> DataFrame:
    """Entries whose parent is the database: `(database_id, position, entry_id, title)`.

    The entries come as they were landed, or from `keyed_entries`.
    """
    keyed = entries if "database_id" in entries.columns else keyed_entries(entries)
    known = databases.select(normalize_id(F.col("id")).alias("d_id"))
    return lookup(keyed, known, "database_id", "d_id", how="inner", floor=floor).drop("d_id")


def render_databases(
    databases: DataFrame,
    entries: DataFrame,
    *,
    header: bool = True,
    version_key: str = "tool_version",
    limit: int = PART_BYTES,
    floor: int = HOT_FLOOR,
) -> DataFrame:
    """Documents of `databases`: heading, description and the list of direct entries.

    The header title of a database is always `Untitled`, because databases have no page
    properties; the heading shows the real title.
    """
    title, description = plain_text(F.col("title")), plain_text(F.col("description"))
    header_text = (
        metadata_header(
            {
                "id": F.col("id"),
                "title": F.lit("Untitled"),
                "type": F.lit("database"),
                "folder": F.col("folder"),
                "file_path": F.col("file_path"),
                "created_by": F.col("created_by"),
                "last_edited_by": F.col("last_edited_by"),
                "last_edited": F.col("last_edited_time"),
                "last_synced": F.col("last_synced"),
                "icon": F.col("icon"),
                "parent_id": F.col("resolved_parent_id"),
                "is_root": F.col("is_root"),
                "url": F.col("url"),
                "simplified_depth": F.lit(None).cast("int"),
                "download_duration": _optional(databases, "download_duration", "string"),
                "is_entry": F.lit(False),
            },
            version_key,
        )
        if header
        else F.lit("")
    )
    # staged, as is the list: titles are looked for once, and joins see how few databases there are. By
    # estimate joined databases are many, and the driver would broadcast their entries instead
    heads = staged(databases.select(
        normalize_id(F.col("id")).alias("page_id"),
        "file_path",
        F.concat(
            header_text,
            F.when(title != "", F.concat(F.lit("# "), title, F.lit("\n\n"))).otherwise(""),
            F.when(description != "", F.concat(description, F.lit("\n\n"))).otherwise(""),
        ).alias("head"),
        stem(F.col("file_path")).alias("base"),
    ))
    listed = direct_entries(heads.select(F.col("page_id").alias("id")), entries, floor=floor)
    if "database_id" not in entries.columns:
        listed = staged(listed)
    bases = heads.select(F.col("page_id").alias("h_id"), "base")
    shown = F.coalesce(blank_to_null(F.col("title")), F.lit("Untitled"))
    links = lookup(listed, bases, "database_id", "h_id", how="inner", floor=floor).select(
        F.col("database_id").alias("page_id"),
        "position",
        "entry_id",
        F.concat(F.lit("- ["), shown, F.lit("](./"), "base", F.lit("/"), slug(shown),
                 F.lit(".md)<!-- page_id:"), "entry_id", F.lit(" -->\n")).alias("text"),
    )
    lists = ordered_text(links, ["page_id"], ["position", "entry_id"], "text", limit=limit)
    # the list ends with a blank line; without entries a notice takes its place
    ends = lists.groupBy("page_id").agg(F.max("part_no").alias("last_part"))
    closed = lists.join(ends, "page_id").select(
        "page_id",
        "part_no",
        F.concat("content", F.when(F.col("part_no") == F.col("last_part"), "\n").otherwise("")).alias(
            "content"
        ),
    )
    empty = heads.join(ends, "page_id", "left_anti").select(
        "page_id", F.lit(0).cast("bigint").alias("part_no"), F.lit(NO_ENTRIES).alias("content")
    )
    return _documents(heads, closed.unionByName(empty))
