"""Block trees: positions, inherited context, child pages, and the text of each block."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwork.functions.ids import normalize_id, packed, unpacked
from leafwork.functions.richtext import markdown, plain_text
from leafwork.functions.text import slug
from leafwork.operators.skew import HOT_FLOOR, lookup
from leafwork.session import staged

# How children of a block are shown. Fixed values, by block type; a type that is not listed
# shows nothing below it.
SAME_DEPTH = ("paragraph", "quote", "callout", "synced_block", "column_list", "column")
DEEPER = ("bulleted_list_item", "numbered_list_item", "to_do")
HEADINGS = ("heading_1", "heading_2", "heading_3")
LIST_ITEMS = DEEPER
LINKS = ("child_page", "child_database")
NEEDS_NO_PAYLOAD = ("divider", "table_of_contents", "synced_block", "column_list", "column")
COLLAPSE_START, COLLAPSE_END = "<!-- collapsible: start -->\n", "<!-- collapsible: end -->\n"
LAST = 2**31 - 1  # sorts after every ordinal


def normalized(blocks: DataFrame) -> DataFrame:
    """Blocks with normalised keys; ids that are shown as they came are left alone."""
    keys = ("page_id", "block_id", "parent_id")
    return blocks.select(*[normalize_id(F.col(c)).alias(c) if c in keys else c for c in blocks.columns])


def _child_mode(text: Column) -> Column:
    kind = F.col("type")
    present = F.col("payload_present")
    return (
        F.when(~present & ~kind.isin(*NEEDS_NO_PAYLOAD), "none")
        .when((kind == "paragraph") & (text == ""), "none")
        .when(kind.isin(*SAME_DEPTH), "same")
        .when(kind.isin(*DEEPER), "deeper")
        .when((kind == "toggle") | (kind.isin(*HEADINGS) & F.col("is_toggleable")), "reset")
        .when(kind == "table", "rows")
        .otherwise("none")
    )


def _is_top() -> Column:
    return F.col("parent_id").isNull() | (F.col("parent_id") == F.col("page_id"))


def _slim(blocks: DataFrame, *further: Column, text: str | None = None) -> DataFrame:
    """What the context of blocks is found from; `text` names the column with their Markdown, if there is one."""
    shown = markdown(F.col("rich_text")) if text is None else F.col(text)
    return blocks.select(
        "page_id", "block_id", "parent_id", "ordinal", "type", "has_children", "table_width",
        F.coalesce("has_column_header", F.lit(False)).alias("has_column_header"),
        "payload_present", _child_mode(shown).alias("child_mode"), *further,
    )


# Context a block inherits: `path` (ordinals from the top), `level`, indentation `depth`,
# `visible`, and the width and header flag of the table it is a row of.
def _top_context(df: DataFrame) -> DataFrame:
    return df.select(
        "*",
        F.array("ordinal").alias("path"),
        F.lit(0).alias("level"),
        F.lit(0).alias("depth"),
        F.lit(True).alias("visible"),
        F.lit(None).cast("int").alias("row_width"),
        F.lit(False).alias("header_row"),
    )


CONTEXT = ("path", "level", "depth", "visible", "row_width", "header_row")


def nested_context(
    blocks: DataFrame, *, max_level: int = 0, floor: int = HOT_FLOOR
) -> DataFrame | None:
    """Context of all blocks below the top level, or None when there are none.

    One equi-join per tree level; only parents that say they have children take part. A parent
    may hold a large share of all blocks, so the join treats hot parents apart. `max_level`
    keeps levels 0 to `max_level` (0 means all levels).
    """
    # blocks are read once for both; staged, as the optimizer would take exploded rows for few and have the
    # driver broadcast them
    slim = _slim(blocks, _is_top().alias("top"))
    return slim_context(staged(slim.where("not top or (top and has_children)")), max_level=max_level, floor=floor)


# columns that context is found from
SLIM = (
    "block_id", "parent_id", "ordinal", "type", "has_children", "table_width", "has_column_header", "payload_present",
    "child_mode", "top",
)


def slim_context(slim: DataFrame, *, max_level: int = 0, floor: int = HOT_FLOOR) -> DataFrame | None:
    """`nested_context` of staged blocks with the columns `SLIM`, and of further ones that are handed on."""
    below = slim.where("not top").drop("top")
    if below.isEmpty():
        return None
    frontier = _top_context(slim.where("top and has_children").drop("top"))
    levels: list[DataFrame] = []
    while not (max_level and len(levels) == max_level):
        above = frontier.select(
            F.col("block_id").alias("u_id"),
            *[F.col(c).alias(f"u_{c}") for c in
              ("path", "level", "depth", "visible", "child_mode", "table_width", "has_column_header")],
        )
        mode = F.col("u_child_mode")
        is_row = (F.col("type") == "table_row") & F.col("payload_present")
        step = staged(
            lookup(below, above, "parent_id", "u_id", how="inner", floor=floor).select(
                *[c for c in below.columns if c != "parent_id"],
                F.concat("u_path", F.array("ordinal")).alias("path"),
                (F.col("u_level") + 1).alias("level"),
                F.when(mode == "deeper", F.col("u_depth") + 1)
                .when(mode == "reset", F.lit(0))
                .otherwise(F.col("u_depth"))
                .alias("depth"),
                (F.col("u_visible") & (mode != "none") & ((mode != "rows") | is_row)).alias("visible"),
                F.when(mode == "rows", F.col("u_table_width")).alias("row_width"),
                ((mode == "rows") & F.col("u_has_column_header") & (F.col("ordinal") == 0)).alias(
                    "header_row"
                ),
            )
        )
        if step.isEmpty():
            break
        levels.append(step)
        frontier = step.where("has_children")
        if frontier.isEmpty():
            break
    if not levels:
        return None
    tree = levels[0]
    for level in levels[1:]:
        tree = tree.unionByName(level)
    return tree


def with_context(
    blocks: DataFrame, *, max_level: int = 0, floor: int = HOT_FLOOR
) -> DataFrame:
    """Blocks with their tree context."""
    nested = nested_context(blocks, max_level=max_level, floor=floor)
    return in_context(blocks.withColumn("top", _is_top()), nested).drop("top")


def in_context(blocks: DataFrame, nested: DataFrame | None) -> DataFrame:
    """Blocks that tell whether they are `top`, with their context. Top-level blocks, the bulk, get it without any join."""
    top = _top_context(blocks.where("top"))
    if nested is None:  # none below the top level
        return top
    return top.unionByName(blocks.where("not top").join(nested.select("block_id", *CONTEXT), "block_id"))


def depth_limited(blocks: DataFrame, max_level: int, *, floor: int = HOT_FLOOR) -> DataFrame:
    """Pages cut at `max_level`: `(page_id, blocks_kept, was_limited)`.

    Blocks are read once. Only packed keys go down the levels, a block without children no further than
    its own, and a page adds up what it keeps on each level.
    """
    keys = blocks.select(
        packed(F.col("page_id")).alias("page_id"), packed(F.col("block_id")).alias("block_id"),
        packed(F.col("parent_id")).alias("parent_id"), "has_children", _is_top().alias("top"),
    )
    keys = staged(keys.where("top is not null"))
    below = keys.where("not top").select("page_id", "block_id", "parent_id", "has_children")
    level = keys.where("top").select("page_id", "block_id", "has_children")
    kept: list[DataFrame] = []
    while True:
        cut = F.col("has_children") if max_level and len(kept) == max_level else F.lit(False)
        kept.append(level.groupBy("page_id").agg(F.count("*").alias("n"), F.bool_or(cut).alias("cut")))
        if max_level and len(kept) > max_level:
            break
        above = level.where("has_children").select(F.col("block_id").alias("u_id"))
        level = staged(
            lookup(below, above, "parent_id", "u_id", how="inner", floor=floor).select("page_id", "block_id", "has_children")
        )
        if level.isEmpty():
            break
    pages = kept[0]
    for more in kept[1:]:
        pages = pages.unionByName(more)
    return pages.groupBy("page_id").agg(F.sum("n").alias("blocks_kept"), F.bool_or("cut").alias("was_limited")).withColumn(
        "page_id", unpacked(F.col("page_id"))
    )


def child_edges(
    blocks: DataFrame, *, max_level: int = 0, floor: int = HOT_FLOOR
) -> DataFrame:
    """Child pages and databases in document order: `(parent_id, position, child_id)`.

    Blocks that are not shown count as well. A child mentioned twice keeps its first place.
    `position` is the rank within the page; children stay rows because one page may have a
    large share of all children.
    """
    wanted = F.col("type").isin(*LINKS) & F.col("payload_present")
    top = _top_context(_slim(blocks.where(_is_top() & wanted)))
    nested = nested_context(blocks, max_level=max_level, floor=floor)
    found = top.select("page_id", "block_id", "path")
    if nested is not None:
        found = found.unionByName(nested.where(wanted).select("page_id", "block_id", "path"))
    firsts = found.groupBy("page_id", normalize_id(F.col("block_id")).alias("child_id")).agg(
        F.min("path").alias("path")
    )
    return positions(firsts.withColumnRenamed("page_id", "parent_id"), "path", floor=floor)


def positions(edges: DataFrame, order: str, *, floor: int = HOT_FLOOR) -> DataFrame:
    """Number the children of each parent from 0 in `order`."""
    from leafwork.operators.ordering import with_index

    indexed = staged(
        with_index(edges, [F.col("parent_id"), F.col(order), F.col("child_id")], "_at")
    )
    starts = indexed.groupBy(F.col("parent_id").alias("s_parent")).agg(F.min("_at").alias("_first"))
    return lookup(indexed, starts, "parent_id", "s_parent", how="inner", floor=floor).select(
        "parent_id", (F.col("_at") - F.col("_first")).alias("position"), "child_id"
    )


def with_texts(blocks: DataFrame) -> DataFrame:
    """Blocks with the texts of their spans, so that the rules of `block_parts` stay small."""
    return blocks.select(
        "*",
        markdown(F.col("rich_text")).alias("text"),
        plain_text(F.col("rich_text")).alias("plain"),
        plain_text(F.col("caption")).alias("caption_text"),
        F.coalesce("title", F.lit("")).alias("label"),
        slug(F.col("title")).alias("label_slug"),
    )


def _flat(blocks: DataFrame, file_url: Callable[[Column], Column]) -> DataFrame:
    """Landed blocks as few flat columns: those of `_slim`, whether they are `top`, and their `block_parts`."""
    lead, tail, closes = block_parts(file_url)
    cells = F.when(F.col("type") == "table_row", F.transform("cells", markdown))
    slim = _slim(with_texts(blocks), _is_top().alias("top"), lead.alias("lead"), tail.alias("tail"), closes.alias("closes"),
                 cells.alias("cells"), text="text")
    # ids that no join looks at, those of most blocks, are left out
    joined = {"block_id": F.when(~F.col("top") | F.col("has_children"), F.col("block_id")),
              "parent_id": F.when(~F.col("top"), F.col("parent_id"))}
    return slim.where("top is not null").withColumns(joined)


def prepared(blocks: DataFrame, *, file_url: Callable[[Column], Column] = lambda url: url) -> DataFrame:
    """Blocks with what they show apart from their context, staged: for blocks that are dear to make.

    They are made, and their spans gone through, once; landed blocks can be read again for less.
    """
    return staged(_flat(blocks, file_url))


def split(blocks: DataFrame, file_url: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Staged blocks, landed or `prepared`: those of the tree with columns `SLIM`, links to child pages, and the others."""
    is_link = F.col("type").isin(*LINKS)
    if "child_mode" in blocks.columns:
        return blocks.select(*SLIM), blocks.where(is_link), blocks.where(~is_link)
    tree = _slim(blocks, _is_top().alias("top")).where("not top or (top and has_children)").select(*SLIM)
    flat = _flat(blocks, file_url)
    return staged(tree), staged(flat.where(is_link)), staged(flat.where(~is_link))


def block_parts(file_url: Callable[[Column], Column]) -> tuple[Column, Column, Column]:
    """What a block shows apart from its context: `lead`, `tail` (of links to child pages) and whether it closes.

    Refers to the columns that `with_texts` adds. `block_text` puts them together.
    """
    kind = F.col("type")
    text, plain, caption = F.col("text"), F.col("plain"), F.col("caption_text")
    own_id = normalize_id(F.col("block_id"))
    url = file_url(F.coalesce("external_url", "file_url", F.lit("")))
    newline = F.lit("\n")

    def blank(value: Column, default: str | Column) -> Column:
        fallback = F.lit(default) if isinstance(default, str) else default
        return F.coalesce(F.nullif(value, F.lit("")), fallback)

    def media(opening: str, label: Column) -> Column:
        return F.concat(F.lit(opening), label, F.lit("]("), url, F.lit(")<!-- file_id:"), own_id,
                        F.lit(" -->\n"))

    def page_comment(value: Column) -> Column:
        return F.concat(F.lit("<!-- page_id:"), normalize_id(value), F.lit(" -->\n"))

    def heading(level: int) -> Column:
        start = F.when(F.col("is_toggleable"), COLLAPSE_START).otherwise("")
        return F.concat(F.lit("#" * level + " "), text, newline, start)

    def block_quote(first: Column) -> Column:
        return F.concat(F.lit("> "), first, F.replace(text, newline, F.lit("\n> ")), newline)

    emoji = blank(F.concat(F.nullif(F.col("emoji"), F.lit("")), F.lit(" ")), "")
    child = F.concat(F.lit("- ["), F.col("label"), F.lit("](./"))
    link_page, link_database = F.nullif("link_page_id", F.lit("")), F.nullif("link_database_id", F.lit(""))
    language = F.when(F.col("language") == "plain text", "").otherwise(
        F.coalesce("language", F.lit(""))
    )
    web = F.coalesce("url", F.lit(""))
    arms: dict[str, Column] = {
        "paragraph": F.concat(text, newline),
        "heading_1": heading(1),
        "heading_2": heading(2),
        "heading_3": heading(3),
        "bulleted_list_item": F.concat(F.lit("- "), text, newline),
        "numbered_list_item": F.concat(F.lit("1. "), text, newline),
        "to_do": F.concat(
            F.when(F.col("checked"), "- [x] ").otherwise("- [ ] "), text, newline
        ),
        "toggle": F.concat(F.lit(COLLAPSE_START + "**"), text, F.lit("**\n\n")),
        "code": F.concat(F.lit("```"), language, newline, plain, F.lit("\n```\n")),
        "quote": block_quote(F.lit("")),
        "callout": block_quote(emoji),
        "image": media("![", blank(caption, "image")),
        "video": media("[", blank(caption, "Video")),
        "file": media("[", blank(F.col("name"), "File")),
        "pdf": media("[", blank(caption, "PDF")),
        "bookmark": F.concat(F.lit("["), blank(caption, web), F.lit("]("), web, F.lit(")\n")),
        "equation": F.concat(F.lit("$$\n"), F.coalesce("expression", F.lit("")), F.lit("\n$$\n")),
        "child_page": child,
        "child_database": child,
        "link_to_page": F.when(
            link_page.isNotNull(),
            F.concat(F.lit("[Page Link](notion://page/"), link_page, F.lit(")"), page_comment(link_page)),
        ).when(
            link_database.isNotNull(),
            F.concat(F.lit("[Database Link](notion://database/"), link_database, F.lit(")"),
                     page_comment(link_database)),
        ),
        "embed": F.concat(F.lit("[Embed]("), web, F.lit(")\n")),
    }
    opening = (
        F.when(kind == "divider", F.lit("---\n"))
        .when(kind == "table_of_contents", F.lit("[TOC]\n"))
        .when(~F.col("payload_present"), F.when(kind == "paragraph", newline).otherwise(""))
    )
    for name, value in arms.items():
        opening = opening.when(kind == name, F.coalesce(value, F.lit("")))
    opening = opening.otherwise(F.lit(""))
    closes = F.col("payload_present") & (
        (kind == "toggle") | (kind.isin(*HEADINGS) & F.col("is_toggleable"))
    )
    tail = F.concat(F.lit("/"), F.col("label_slug"), F.lit(".md)"), page_comment(F.col("block_id")))
    return opening, F.when(kind.isin(*LINKS), tail), closes


def block_text(page_slug: Column) -> Column:
    """Text a block starts with: its `block_parts` with indentation, the place of child pages, or the cells of a row."""
    kind, lead = F.col("type"), F.col("lead")
    shown = F.coalesce("payload_present", F.lit(True))
    cells = F.transform(
        F.sequence(F.lit(0), F.greatest(F.col("row_width"), F.lit(1)) - 1),
        lambda at: F.concat(F.lit(" "), F.coalesce(F.get(F.col("cells"), at), F.lit("")), F.lit(" |")),
    )
    row = F.concat(
        F.lit("|"),
        F.when(F.col("row_width") > 0, F.array_join(cells, "")).otherwise(""),
        F.lit("\n"),
        F.when(F.col("header_row"),
               F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.col("row_width")), F.lit("\n")))
        .otherwise(""),
    )
    return (
        F.when(shown & kind.isin(*LIST_ITEMS), F.concat(F.repeat(F.lit("  "), F.col("depth")), lead))
        .when(shown & kind.isin(*LINKS), F.coalesce(F.concat(lead, page_slug, F.col("tail")), F.lit("")))
        .when(shown & (kind == "table_row") & F.col("row_width").isNotNull(), row)
        .otherwise(lead)
    )
