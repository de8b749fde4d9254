"""Pages that hold a block of every kind and a property of every type, one page per customer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafwork import schemas
from leafwork.catalog.records import conform, shaped
from leafwork.catalog.views import Views

WEB = "https://example.com/"
CUSTOMERS = 5_000  # whose pages and blocks a task makes


def _text(value: Column | str, *marks: str, href: Column | None = None, mention: Column | None = None) -> Column:
    flags = F.struct(
        *[F.lit(n in marks).alias(n) for n in ("bold", "italic", "strikethrough", "underline", "code")], F.lit("default").alias("color")
    )
    given = {"mention": mention} if mention is not None else {}
    return shaped(
        schemas.SPAN, type=F.lit("text" if mention is None else "mention"), plain_text=F.lit(value) if isinstance(value, str) else value,
        href=F.lit(None) if href is None else href, annotations=flags, **given,
    )


def _person(id_: Column) -> Column:
    return shaped(schemas.USER, id=id_, type=F.lit("person"), name=F.lit("Ann"), person=F.struct(F.lit("ann@example.com").alias("email")))


def _web(end: str) -> Column:
    return F.concat(F.lit(WEB + end), F.col("c_custkey").cast("string"))


def _dealt(rows: DataFrame, customers: DataFrame) -> DataFrame:
    """Rows of customers in tasks of few, whatever files they come in: they are narrow, and pages are made of them."""
    return rows.repartition(customers.count() // CUSTOMERS + 1)


def block_id(name: str) -> Column:
    return F.md5(F.concat(F.lit(f"kind:{name}:"), F.col("c_custkey").cast("string")))


def kind_blocks(views: Views) -> DataFrame:
    """Every kind of block in turn on each customer's page, some with blocks below them."""
    name, segment, key = F.col("c_name"), F.col("c_mktsegment"), F.col("c_custkey").cast("string")
    block_type = T.StructType.fromDDL(schemas.BLOCK).simpleString()
    rows: list[Column] = []
    places: dict[str, int] = {}

    def add(block: str, kind: str, *spans: Column, parent: str = "", present: bool = True, inner: bool = False, **fields) -> None:
        place = places.setdefault(parent, 0)
        places[parent] += 1
        values = {k: v if isinstance(v, Column) else F.lit(v) for k, v in fields.items()}
        rows.append(shaped(
            block_type, page_id=F.col("id"), block_id=block_id(block), parent_id=block_id(parent) if parent else F.col("id"), ordinal=F.lit(place),
            type=F.lit(kind), has_children=F.lit(inner), rich_text=F.array(*spans) if spans else F.lit(None),
            payload_present=F.lit(present), **({"is_toggleable": F.lit(False)} | values),
        ))

    add("h1", "heading_1", _text("One "), _text(name, "italic"))
    add("h2", "heading_2", _text("Two"), is_toggleable=True, inner=True)
    add("h2p", "paragraph", _text(F.concat(F.lit("inside "), key)), parent="h2")
    add("h3", "heading_3", _text(segment, "strikethrough"))
    add("p", "paragraph", _text("call "), _text(F.col("c_phone"), "code"), _text(" or "), _text("?", mention=shaped(
        "STRUCT<type: STRING, user: " + schemas.USER + ">", type=F.lit("user"), user=_person(F.col("id")))))
    add("toggle", "toggle", _text("more"), inner=True)
    add("item", "bulleted_list_item", _text("x", "bold", "italic"), parent="toggle", inner=True)
    add("number", "numbered_list_item", _text("y", href=_web("y")), parent="item")
    add("quote", "quote", _text("q1\nq2"))
    add("callout", "callout", _text(segment), emoji="\U0001f4a1")
    add("plain", "callout", _text("no sign"))
    add("image", "image", external_url=_web("i"))
    add("video", "video", file_url=_web("v"), caption=F.array(_text(name)))
    add("file", "file", external_url=_web("f"), name="report.txt")
    add("nameless", "file", file_url=_web("n"))
    add("pdf", "pdf", external_url=_web("p"))
    add("mark", "bookmark", url=_web("b"))
    add("captioned", "bookmark", url=_web("c"), caption=F.array(_text("See")))
    add("sum", "equation", expression="a+b")
    add("toc", "table_of_contents", present=False)
    add("page", "child_page", title=name)
    add("base", "child_database", title="Tasks")
    add("synced", "synced_block", inner=True, present=False)
    add("copy", "paragraph", _text("synced"), parent="synced")
    add("table", "table", table_width=2, has_column_header=True, inner=True)
    add("row0", "table_row", parent="table", cells=F.array(F.array(_text("a")), F.array(_text(segment))))
    add("row1", "table_row", parent="table", cells=F.array(F.array(_text("b", "bold"))))
    add("bare", "table", table_width=1, has_column_header=False, inner=True)
    add("row2", "table_row", parent="bare", cells=F.array(F.array(_text("c")), F.array(_text("too many"))))
    add("lost", "paragraph", _text("not a row"), parent="bare")
    add("columns", "column_list", inner=True, present=False)
    add("left", "column", parent="columns", inner=True, present=False)
    add("lp", "paragraph", _text("left"), parent="left")
    add("right", "column", parent="columns", inner=True, present=False)
    add("rp", "paragraph", _text("right"), parent="right")
    add("to page", "link_to_page", link_page_id=F.col("id"))
    add("to base", "link_to_page", link_database_id=F.col("id"))
    add("to none", "link_to_page")
    add("embed", "embed", url=_web("e"))
    add("crumb", "breadcrumb")
    add("empty", "paragraph", present=False)
    add("gone", "image", present=False)
    add("code", "code", _text("select 1", "bold"), language="sql")
    add("done", "to_do", _text("did"), checked=True)
    add("todo", "to_do", _text("do"), checked=False)
    add("rule", "divider", present=False)
    # in two columns, which have more fields than Spark generates one method for: a method that makes all blocks
    # is too long for the JVM to compile
    half = len(rows) // 2
    customers = views["fx_customer_row"]
    made = _dealt(customers, customers).select(F.array(*rows[:half]).alias("upper"), F.array(*rows[half:]).alias("lower"))
    return conform(made.select(F.inline(F.concat("upper", "lower"))), schemas.BLOCK)


def _property(kind: str, **values: Column) -> Column:
    return shaped(schemas.PROPERTY, type=F.lit(kind), **values)


def _named(value: Column) -> Column:
    return F.struct(value.alias("name"))


def _day(value: str) -> Column:
    return shaped("STRUCT<start: STRING, `end`: STRING, time_zone: STRING>", start=F.lit(value))


def _nested(kind: str, field: str, **values: Column) -> Column:
    """A formula or rollup with its own type."""
    ddl = next(f.dataType for f in T.StructType.fromDDL("x " + schemas.PROPERTY).fields[0].dataType.fields if f.name == kind).simpleString()
    return _property(kind, **{kind: shaped(ddl, type=F.lit(field), **values)})


def kind_pages(views: Views) -> DataFrame:
    """A database entry per customer with a property of every type, an icon and a creator."""
    key = F.col("c_custkey").cast("string")
    ref = lambda value: F.struct(value.alias("id"))
    even = F.col("c_custkey") % 2 == 0
    properties = {
        "Name": _property("title", title=F.array(_text(F.col("c_name")))),
        "a01": _property("rich_text", rich_text=F.array(_text("no "), _text("marks", "bold"))),
        "a02": _property("rich_text", rich_text=F.array().cast(f"array<{schemas.SPAN}>")),
        "a03": _property("number", number=F.col("c_custkey").cast("double") / 4),
        "a04": _property("select", select=_named(F.col("c_mktsegment"))),
        "a05": _property("multi_select", multi_select=F.array(_named(F.lit("one")), _named(F.lit("two")))),
        "a06": _property("status", status=_named(F.lit("Open"))),
        "a07": _property("date", date=_day("2024-01-31")),
        "a08": _property("checkbox", checkbox=even),
        "a09": _property("url", url=_web("u")),
        "a10": _property("email", email=F.concat(F.lit("c"), key, F.lit("@example.com"))),
        "a11": _property("phone_number", phone_number=F.col("c_phone")),
        "a12": _property("people", people=F.array(ref(F.lit("p-1")), ref(key))),
        "a13": _property("relation", relation=F.array(ref(F.col("id")))),
        "a14": _nested("rollup", "number", number=F.lit(2.5)),
        "a15": _nested("rollup", "date", date=_day("2024-02-01")),
        "a16": _nested("formula", "string", string=F.lit("a \"quoted\" text")),
        "a17": _nested("formula", "number", number=F.lit(-1.0)),
        "a18": _nested("formula", "boolean", boolean=even),
        "a19": _nested("formula", "date", date=_day("2024-03-01")),
        "a20": _property("created_by", created_by=ref(F.lit("u-1"))),
        "a21": _property("last_edited_by", last_edited_by=ref(F.lit("u-2"))),
        "a22": _property("created_time", created_time=F.lit("2024-01-01T00:00:00.000Z")),
        "a23": _property("last_edited_time", last_edited_time=F.lit("2024-01-02T00:00:00.000Z")),
        "a24": _property("unique_id", unique_id=shaped("STRUCT<prefix: STRING, number: BIGINT>", prefix=F.when(even, F.lit("C")), number=F.col("c_custkey"))),
    }
    icon = F.when(even, shaped(schemas.ICON, type=F.lit("external"), external=F.struct(_web("icon").alias("url")))).otherwise(
        shaped(schemas.ICON, type=F.lit("file"), file=F.struct(_web("icon").alias("url")))
    )
    # a page per pair of rows with the same id; only the keys are joined, as the pages are wide
    rows = views["fx_customer_row"]
    again = rows.select(F.col("id").alias("k_id"), F.col("c_custkey").alias("k_custkey")).hint("merge")
    paired = _dealt(rows.join(again, F.col("id") == F.col("k_id")).drop("k_id"), rows)
    pages = paired.select(
        "id", F.lit("page").alias("object"), F.expr("timestamp '2024-02-01 00:00:00'").alias("last_edited_time"),
        _person(F.concat(F.lit("u-"), key)).alias("created_by"), icon.alias("icon"),
        shaped(schemas.PARENT, type=F.lit("database_id"), database_id=F.lit("db-1")).alias("parent"),
        F.create_map(*(x for name, value in properties.items() for x in (F.lit(name), value))).alias("properties"),
        _web("page").alias("url"), "k_custkey",
    )
    placed = conform(pages, schemas.PAGE, "k_custkey")
    return placed.select(
        *placed.drop("k_custkey").columns, F.lit("crm").alias("folder"),
        F.concat(F.lit("crm/c-"), F.col("k_custkey").cast("string"), F.lit(".md")).alias("file_path"),
        F.lit(None).cast("timestamp").alias("last_synced"), F.lit(False).alias("is_root"), F.lit("db1").alias("resolved_parent_id"),
    )
