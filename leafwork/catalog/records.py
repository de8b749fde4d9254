"""Workspace records built from the views: pages, users, blocks, entries, databases, events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafwork import schemas
from leafwork.catalog.views import Views
from leafwork.functions.events import hmac_sha256
from leafwork.functions.ids import dashed_id

SECRET = "example-secret"


def conform(df: DataFrame, ddl: str, *further: str) -> DataFrame:
    """Columns of a landed schema, null where `df` has none, and `further` ones of `df`."""
    fields = T.StructType.fromDDL(ddl).fields
    return df.select(
        *[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields], *further
    )


def shaped(ddl: str, **values: Column) -> Column:
    """A struct of the DDL type with some fields filled."""
    fields = T.StructType.fromDDL("x " + ddl).fields[0].dataType.fields
    return F.struct(
        *[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]
    )


def span(text: Column, *, bold: Column | None = None, href: Column | None = None) -> Column:
    flags = {"bold": bold} if bold is not None else {}
    return shaped(
        schemas.SPAN,
        type=F.lit("text"),
        plain_text=text,
        href=F.lit(None) if href is None else href,
        annotations=F.struct(
            *[F.coalesce(flags.get(n, F.lit(False)), F.lit(False)).alias(n)
              for n in ("bold", "italic", "strikethrough", "underline", "code")],
            F.lit("default").alias("color"),
        ),
    )


def titled(text: Column) -> Column:
    return shaped(schemas.PROPERTY, type=F.lit("title"), title=F.array(span(text)))


def page_parent(parent: Column) -> Column:
    return F.when(
        F.nullif(parent, F.lit("")).isNotNull(),
        shaped(schemas.PARENT, type=F.lit("page_id"), page_id=parent),
    ).otherwise(shaped(schemas.PARENT, type=F.lit("workspace"), workspace=F.lit(True)))


def page_records(flat: DataFrame) -> DataFrame:
    """Page records of `flat(id, last_edited, parent_id, title, …)`."""
    return conform(
        flat.select(
            *[c for c in flat.columns if c not in ("parent_id", "title", "last_edited")],
            F.lit("page").alias("object"),
            F.col("last_edited").alias("last_edited_time"),
            page_parent(F.col("parent_id")).alias("parent"),
            F.create_map(F.lit("title"), titled(F.col("title"))).alias("properties"),
        ),
        schemas.PAGE,
    )


def user_ref(user_id: Column, name: Column | None = None) -> Column:
    return shaped(schemas.USER, id=user_id, name=F.lit(None) if name is None else name)


def doc_page_records(views: Views) -> DataFrame:
    """One page per document, with an author to look up and a named editor."""
    flat = views["fx_doc_pages"].select(
        "id", "last_edited", "parent_id", "title",
        user_ref(F.col("author")).alias("created_by"),
        user_ref(F.col("id"), F.lit("Ed")).alias("last_edited_by"),
        shaped(schemas.ICON, type=F.lit("emoji"), emoji=F.lit("\U0001f4c4")).alias("icon"),
        F.concat(F.lit("https://example.com/"), "id").alias("url"),
    )
    return page_records(flat)


def doc_blocks(views: Views) -> DataFrame:
    """One block per line of each document: eight types in turn, every fourth one nested.

    A line with number 3 modulo 8 is a child of the line before it.
    """
    page = F.md5(F.concat(F.lit("docpage:"), F.col("doc_id").cast("string"))).alias("page")
    lines = views["documents"].select("doc_id", page, F.split("text", "\n").alias("lines")).select(
        "doc_id", "page", F.size("lines").alias("n"), F.posexplode("lines").alias("line_no", "line"),
    )
    page = F.col("page")

    def block(line: Column) -> Column:
        return F.md5(F.concat_ws(":", F.lit("block"), F.col("doc_id").cast("string"), line.cast("string")))

    at = F.col("line_no") % 8
    kinds = ["heading_2", "paragraph", "bulleted_list_item", "numbered_list_item", "to_do", "quote", "code", "divider"]
    kind = F.get(F.array(*[F.lit(k) for k in kinds]), at)
    rich = F.array(
        span(
            F.col("line"),
            bold=F.col("line_no") % 5 == 0,
            href=F.when(F.col("line_no") % 7 == 0, F.concat(F.lit("https://example.com/"), F.col("doc_id").cast("string"))),
        )
    )
    return conform(
        lines.select(
            page.alias("page_id"),
            block(F.col("line_no")).alias("block_id"),
            F.when(at == 3, block(F.col("line_no") - 1)).otherwise(page).alias("parent_id"),
            F.when(at == 3, F.lit(0)).otherwise(F.col("line_no")).alias("ordinal"),
            kind.alias("type"),
            ((at == 2) & (F.col("line_no") + 1 < F.col("n"))).alias("has_children"),
            F.when(kind != "divider", rich).alias("rich_text"),
            (F.col("line_no") % 16 == 4).alias("checked"),
            F.lit("plain text").alias("language"),
            F.lit(False).alias("is_toggleable"),
            F.lit(True).alias("payload_present"),
        ),
        schemas.BLOCK,
    )


def link_blocks(views: Views) -> DataFrame:
    """Nation pages that mention each of their customers, some of them twice, in nested lists."""
    customers = views["customer"]
    nation = F.md5(F.concat(F.lit("nation:"), F.col("c_nationkey").cast("string")))
    customer = F.md5(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")))
    holder = F.md5(F.concat(F.lit("holder:"), F.col("c_custkey").cast("string")))
    tops = customers.select(
        nation.alias("page_id"),
        F.when(F.col("c_custkey") % 3 == 0, holder).otherwise(customer).alias("block_id"),
        nation.alias("parent_id"),
        (F.col("c_custkey") * 2).cast("int").alias("ordinal"),
        F.when(F.col("c_custkey") % 3 == 0, "bulleted_list_item").otherwise("child_page").alias("type"),
        (F.col("c_custkey") % 3 == 0).alias("has_children"),
        F.array(span(F.lit("see"))).alias("rich_text"),
        F.col("c_name").alias("title"),
        F.lit(True).alias("payload_present"),
    )
    nested = customers.where(F.col("c_custkey") % 3 == 0).select(
        nation.alias("page_id"),
        customer.alias("block_id"),
        holder.alias("parent_id"),
        F.lit(0).alias("ordinal"),
        F.when(F.col("c_custkey") % 2 == 0, "child_database").otherwise("child_page").alias("type"),
        (F.col("c_custkey") % 6 == 0).alias("has_children"),
        F.array(span(F.lit(""))).alias("rich_text"),
        F.col("c_name").alias("title"),
        F.lit(True).alias("payload_present"),
    )
    again = customers.where(F.col("c_custkey") % 5 == 0).select(
        nation.alias("page_id"),
        dashed_id(customer).alias("block_id"),
        nation.alias("parent_id"),
        (F.col("c_custkey") * 2 + 1).cast("int").alias("ordinal"),
        F.lit("child_page").alias("type"),
        F.lit(False).alias("has_children"),
        F.array(span(F.lit(""))).alias("rich_text"),
        F.col("c_name").alias("title"),
        F.lit(True).alias("payload_present"),
    )
    deep = customers.where(F.col("c_custkey") % 6 == 0).select(
        nation.alias("page_id"),
        F.md5(F.concat(F.lit("deep:"), F.col("c_custkey").cast("string"))).alias("block_id"),
        customer.alias("parent_id"),
        F.lit(0).alias("ordinal"),
        F.lit("paragraph").alias("type"),
        F.lit(False).alias("has_children"),
        F.array(span(F.lit("deep"))).alias("rich_text"),
        F.col("c_name").alias("title"),
        F.lit(True).alias("payload_present"),
    )
    return conform(
        tops.unionByName(nested).unionByName(again).unionByName(deep), schemas.BLOCK
    )


def line_blocks(views: Views) -> DataFrame:
    """Line items as blocks of their order's page, each below the line before it."""
    lines = views["lineitem"].select("l_orderkey", "l_linenumber").distinct()
    page = F.md5(F.concat(F.lit("order:"), F.col("l_orderkey").cast("string")))

    def block(line: Column) -> Column:
        return F.md5(F.concat_ws("/", F.lit("line"), F.col("l_orderkey").cast("string"), line.cast("string")))

    return conform(
        lines.select(
            page.alias("page_id"), block(F.col("l_linenumber")).alias("block_id"),
            F.when(F.col("l_linenumber") == 1, page).otherwise(block(F.col("l_linenumber") - 1)).alias("parent_id"),
            F.lit(0).alias("ordinal"), F.lit("paragraph").alias("type"), F.lit(True).alias("has_children"),
            F.array(span(F.lit("line"))).alias("rich_text"), F.lit(True).alias("payload_present"),
        ),
        schemas.BLOCK,
    )


def entry_records(views: Views) -> DataFrame:
    """One database entry per part, with a property of each kind of text."""
    columns = ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
    # dealt while they are narrow, as many parts fit into one file and entries take long to make
    part = views["part"].select(*columns).repartition(*columns)
    database = F.md5(F.concat(F.lit("db:"), "p_brand"))
    properties = F.create_map(
        F.lit("Name"), titled(F.col("p_name")),
        F.lit("Type"), shaped(schemas.PROPERTY, type=F.lit("select"), select=F.struct(F.col("p_type").alias("name"))),
        F.lit("Size"), shaped(schemas.PROPERTY, type=F.lit("number"), number=F.col("p_size").cast("double")),
        F.lit("Price"), shaped(schemas.PROPERTY, type=F.lit("number"), number=F.col("p_retailprice")),
        F.lit("alpha"), shaped(
            schemas.PROPERTY, type=F.lit("multi_select"),
            multi_select=F.when(F.col("p_size") % 2 == 0, F.array(
                F.struct(F.col("p_type").alias("name")), F.struct(F.lit('say "hi"').alias("name"))))),
        F.lit("Done"), shaped(schemas.PROPERTY, type=F.lit("checkbox"), checkbox=F.col("p_size") > 25),
        F.lit("Key"), shaped(schemas.PROPERTY, type=F.lit("unique_id"), unique_id=F.struct(
            F.when(F.col("p_partkey") % 2 == 0, F.lit("P")).alias("prefix"), F.col("p_partkey").alias("number"))),
        F.lit("Site"), shaped(schemas.PROPERTY, type=F.lit("url"), url=F.when(
            F.col("p_partkey") % 3 == 0, F.concat(F.lit("https://example.com/"), F.col("p_partkey").cast("string")))),
    )
    return conform(
        part.select(
            F.md5(F.concat(F.lit("part:"), F.col("p_partkey").cast("string"))).alias("id"),
            F.lit("page").alias("object"),
            F.expr("timestamp '2024-02-01 00:00:00'").alias("last_edited_time"),
            shaped(schemas.PARENT, type=F.lit("database_id"), database_id=database).alias("parent"),
            properties.alias("properties"),
            F.col("p_partkey").alias("position"),
        ),
        schemas.ENTRY,
    )


def database_records(views: Views) -> DataFrame:
    """One database per brand, and one without entries per region."""
    brands = views["fx_databases"].select("id", "title", "parent_id")
    empty = views["fx_region"].select(
        F.md5(F.concat(F.lit("db:"), "title")).alias("id"), "title", F.col("id").alias("parent_id")
    )
    return conform(
        brands.unionByName(empty).select(
            "id",
            F.expr("timestamp '2024-03-01 00:00:00'").alias("last_edited_time"),
            F.array(span(F.col("title"))).alias("title"),
            F.array(span(F.concat(F.lit("All about "), "title"))).alias("description"),
            page_parent(F.col("parent_id")).alias("parent"),
            F.concat(F.lit("https://example.com/"), "id").alias("url"),
            F.array(F.struct(F.concat(F.lit("ds-"), "id").alias("id"), F.col("title").alias("name"))).alias("data_sources"),
        ),
        schemas.CONTAINER,
    )


def raw_events(views: Views) -> DataFrame:
    """Event requests with bodies and signatures."""
    rows = views["fx_event_rows"]
    uuid = F.regexp_replace("entity_id", "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    body = F.to_json(
        F.struct(
            F.col("event_id").cast("string").alias("id"),
            F.col("event_type").alias("type"),
            F.struct(uuid.alias("id"), F.lit("page").alias("type")).alias("entity"),
            F.when(F.col("is_token"), F.lit("token")).alias("verification_token"),
        )
    )
    body = F.when(F.col("is_garbled"), F.concat(F.lit("not json "), body)).otherwise(body)
    stamp = F.unix_seconds("sent_at").cast("string")
    signature = hmac_sha256(SECRET, F.concat(stamp, body))
    signature = F.when(F.col("is_broken"), F.reverse(signature)).otherwise(signature)
    return rows.select("received_at", signature.alias("signature"), stamp.alias("timestamp"), body.alias("body"))


def queue_entries(views: Views) -> DataFrame:
    """Queue files in both encodings (ten rows each)."""
    rows = views["fx_queue_rows"]
    packed = F.sort_array(F.collect_list(F.struct("pos", "page_id", "last_edited")))
    return rows.groupBy("seq", "type", "folder", "legacy").agg(packed.alias("rows")).select(
        "seq", "type", "folder",
        F.when(~F.col("legacy"), F.transform("rows", lambda r: F.struct(
            r["page_id"].alias("id"), r["last_edited"].alias("last_edited")))).alias("pages"),
        F.when(F.col("legacy"), F.transform("rows", lambda r: r["page_id"])).alias("pageIds"),
        F.lit(None).cast("string").alias("parentId"),
    )
