"""Column expressions against literal cases and plain-Python models."""

import hashlib
import hmac
import random
import struct
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from leafwork import schemas
from leafwork.functions import events, ids, paths, richtext, text
from leafwork.functions.properties import entry_title, page_title, property_text


def test_slug(values):
    cases = {
        "BlueHeron": "blueheron", "tea+milk!sugar": "teamilksugar", "left_over_rice": "left-over-rice",
        "north/south/east": "north-south-east", "c\\drive\\tmp": "c-drive-tmp", "ratio:one:two": "ratio-one-two",
        "ham|eggs": "ham-eggs", "long------gap": "long-gap", "wide   gap": "wide-gap", "-=-ends-=-": "ends",
        "2024plan": "plan", "7-eleven": "eleven", "b52": "b52", "": "untitled", "!!??": "untitled",
        "90210": "untitled", "_ _": "untitled", "naïve": "naive", "señor": "senor", "Ångström": "angstrom",
        "crème brûlée à part": "creme-brulee-a-part", "sun☀moon": "sunmoon", "tea茶cup": "teacup",
        "Kelvin İx": "kelvin-ix", "ét": "et",
        "a" * 99 + "-bcd": "a" * 99, "1" * 5 + "b" * 150: "b" * 100,
    }
    assert values(text.slug, list(cases)) == list(cases.values())


def test_quoted(values):
    cases = {
        "plain": '"plain"', 'say "hi"': '"say \\"hi\\""', "a\\b": '"a\\\\b"', "l1\nl2\tx\r": '"l1\\nl2\\tx\\r"',
        "\x07\x08\x0c\x0b": '"\\a\\b\\f\\v"', "\x00\x1f\x7f": '"\\x00\\x1f\\x7f"', "a b​﻿": '"a\\u00a0b\\u200b\\ufeff"',
        "é漢🎉": '"é漢🎉"', "\U000e0001": '"\\U000e0001"', "": '""',
    }
    assert values(text.quoted, list(cases)) == list(cases.values())


def test_plain_number_is_shortest_and_never_scientific(values):
    rng = random.Random(5)
    numbers = [0.0, 1.0, -1.0, 0.1, 1e7, 1e21, 1e23, 1.5e-7, 123456789.125, 2.0 / 3, 1e-10, 5e15, 3.0000000001]
    numbers += [rng.uniform(-1e6, 1e6) for _ in range(200)]
    numbers += [struct.unpack("d", struct.pack("Q", rng.getrandbits(62)))[0] for _ in range(200)]
    numbers = [n for n in numbers if n == n and abs(n) < 1e200 and (n == 0 or abs(n) > 1e-200)]
    expected = []
    for n in numbers:
        digits = format(Decimal(repr(n)), "f")
        expected.append(digits.rstrip("0").rstrip(".") if "." in digits else digits)
    assert values(text.plain_number, numbers, "DOUBLE") == expected


def test_age_label(values):
    now = datetime(2024, 6, 1)
    ages = {30: "just now", 60: "1 minute ago", 3599: "59 minutes ago", 3600: "1 hour ago", 86400: "1 day ago",
            6 * 86400: "6 days ago", 7 * 86400: "1 week ago", 29 * 86400: "4 weeks ago", 30 * 86400: "1 month ago",
            365 * 86400: "12 months ago"}
    times = [now - timedelta(seconds=s) for s in ages]
    got = values(lambda c: text.age_label(c, F.lit(now)), [*times, None], "TIMESTAMP")
    assert got == [*ages.values(), "never"]


def test_identifiers(values):
    dashed = "0f1e2d3c-4b5a-6978-8796-a5b4c3d2e1f0"
    bare = dashed.replace("-", "")
    assert values(ids.normalize_id, [dashed, bare]) == [bare, bare]
    assert values(ids.dashed_id, [bare, "short"]) == [dashed, "short"]


def fnv_shard(value):
    value = value.replace("-", "").lower()
    if len(value) >= 2 and all(c in "0123456789abcdef" for c in value[:2]):
        return value[:2]
    state = 0x811C9DC5
    for octet in value.encode():
        state = ((state ^ octet) * 0x01000193) & 0xFFFFFFFF
    return f"{state % 256:02x}"


def test_shard_key(values):
    cases = ["0f1e2d3c-4b5a-6978-8796-a5b4c3d2e1f0", "AB8A", "0011", "ff11", "", "z", "zz", "not-a-uuid", "  ",
             "é", "漢字", "a", "g1", "1-2"]
    assert values(ids.shard_key, cases) == [fnv_shard(c) for c in cases]


def test_page_id_from_text(values):
    bare = "2a10b3c4d5e647089929a3b4c5d6e7f8"
    uuid = "2a10b3c4-d5e6-4708-9929-a3b4c5d6e7f8"
    cases = {
        f"https://pages.example/Handbook-{bare}": bare, f"https://www.pages.example/ws/Garden-Rota-{bare}?v=1#x": bare,
        f"https://pages.example/{uuid}": bare, f"http://x/{bare}/": bare, f"  {bare} ": bare, uuid: bare,
        "nothing-to-open": None, "": None, "https://pages.example/": None, "https://pages.example/Page-abc": None,
        bare.upper(): bare.upper(), "z" * 32: None, f"https://x/a%2D{bare}": bare,
    }
    assert values(ids.page_id_from_text, list(cases)) == list(cases.values())


def test_hosted_files(values):
    url = "https://prod.s3.us-west-2.amazonaws.com/ws/51f0c2aa-9d3e-4b17-8c60-2e7ab94d1f35/My%20Shot+1.PNG?X=1"
    assert values(paths.hosted_file_id, [url, "https://example.com/a/b/c.png", "https://s3.amazonaws.com/one",
                                         "https://s3.amazonaws.com/ws/id/%zz.png"]) == [
        "51f0c2aa9d3e4b178c602e7ab94d1f35", None, None, None]
    assert values(paths.attachment_name, [url, "https://h/ws/id/README", "https://h/ws/id/a%25b.tar.GZ"]) == [
        "my-shot-1.png", "readme", "abtar.gz"]  # a broken escape leaves the raw name
    assert values(paths.without_query, ["https://s3/notion/a.png?X-Amz-Signature=1", "x"]) == ["https://s3/notion/a.png", "x"]


def test_relative_path(values):
    def build(c):
        return paths.relative_to(c, F.lit("tech/wiki"))

    assert values(build, ["tech/wiki/page/files/a.png", "tech/other/files/a.png", "a.png"]) == [
        "page/files/a.png", "../other/files/a.png", "../../a.png"]
    assert values(lambda c: paths.relative_to(c, F.lit("")), ["a/b.png"]) == ["a/b.png"]


USERS = [
    (("abc12345-6789", "person", "John Doe", ("john@example.com",)), "John Doe <john@example.com> [abc12345]"),
    (("def67890-1", "person", "Jane Smith", None), "Jane Smith [def67890]"),
    (("jkl55555", "person", "Alice Brown", ("",)), "Alice Brown [jkl55555]"),
    (("12345678-9", "person", "", None), "Unknown [12345678]"),
    (("abc", "person", "Short ID User", None), "Short ID User [abc]"),
    (("bot12345", "bot", "Bot", ("b@example.com",)), "Bot [bot12345]"),
    (None, None),
]


def test_user_label(values):
    assert values(richtext.user_label, [u for u, _ in USERS], schemas.USER) == [e for _, e in USERS]


def span(plain, *, flags="", href=None, user=None, kind="text"):
    names = ("bold", "italic", "strikethrough", "underline", "code")
    notes = tuple(n[0] in flags for n in names) + ("default",)
    return (kind, plain, href, notes, None if user is None else ("user", user))


def test_markdown_spans(values):
    john = USERS[0][0]
    cases = [
        ([span("Hello "), span("@J", kind="mention", user=john), span(", how are you?")],
         "Hello @John Doe <john@example.com> [abc12345], how are you?"),
        ([span("x", flags="c")], "`x`"),
        ([span("x", flags="cbis")], "~~_**`x`**_~~"),
        ([span("x", flags="bu", href="https://h")], "[**x**](https://h)"),
        ([span("x", href="")], "x"),
        ([], ""), (None, ""),
    ]
    assert values(richtext.markdown, [c for c, _ in cases], f"ARRAY<{schemas.SPAN}>") == [e for _, e in cases]
    assert values(richtext.plain_text, [cases[0][0]], f"ARRAY<{schemas.SPAN}>") == ["Hello @J, how are you?"]


PROPERTIES = [
    ({"type": "title", "title": [{"plain_text": "T"}]}, None),
    ({"type": "rich_text", "rich_text": [{"plain_text": 'a"'}, {"plain_text": "b"}]}, '"a\\"b"'),
    ({"type": "rich_text", "rich_text": []}, None),
    ({"type": "number", "number": 12.50}, "12.5"),
    ({"type": "number"}, None),
    ({"type": "select", "select": {"name": ""}}, '""'),
    ({"type": "multi_select", "multi_select": [{"name": "a"}, {"name": "b"}]}, '\n    - "a"\n    - "b"'),
    ({"type": "multi_select", "multi_select": []}, None),
    ({"type": "status", "status": {"name": "Done"}}, '"Done"'),
    ({"type": "date", "date": {"start": "2024-01-01", "end": "2024-01-02"}}, '"2024-01-01"'),
    ({"type": "checkbox", "checkbox": True}, "true"),
    ({"type": "checkbox"}, "false"),
    ({"type": "url", "url": "https://h"}, '"https://h"'),
    ({"type": "email", "email": "a@b"}, '"a@b"'),
    ({"type": "phone_number", "phone_number": "1"}, '"1"'),
    ({"type": "people", "people": [{"id": "u1"}]}, '\n    - "u1"'),
    ({"type": "relation", "relation": [{"id": "r1"}]}, '\n    - "r1"'),
    ({"type": "formula", "formula": {"type": "string", "string": "s"}}, '"s"'),
    ({"type": "formula", "formula": {"type": "number", "number": 3.0}}, "3"),
    ({"type": "formula", "formula": {"type": "boolean", "boolean": False}}, "false"),
    ({"type": "formula", "formula": {"type": "date", "date": {"start": "d"}}}, '"d"'),
    ({"type": "rollup", "rollup": {"type": "number", "number": 1.5}}, "1.5"),
    ({"type": "rollup", "rollup": {"type": "date", "date": {"start": "d"}}}, '"d"'),
    ({"type": "rollup", "rollup": {"type": "array"}}, None),
    ({"type": "created_by", "created_by": {"id": "u"}}, '"u"'),
    ({"type": "last_edited_by", "last_edited_by": {"id": "u"}}, '"u"'),
    ({"type": "created_time", "created_time": "t"}, '"t"'),
    ({"type": "last_edited_time", "last_edited_time": "t"}, '"t"'),
    ({"type": "unique_id", "unique_id": {"prefix": "T", "number": 7}}, '"T-7"'),
    ({"type": "unique_id", "unique_id": {"number": 7}}, "7"),
    ({"type": "files"}, None),
    ({"type": "verification"}, None),
]


def test_property_text(spark):
    import json

    rows = [(i, json.dumps(p)) for i, (p, _) in enumerate(PROPERTIES)]
    df = spark.createDataFrame(rows, "i INT, j STRING")
    df = df.withColumn("p", F.from_json("j", F.lit(schemas.PROPERTY)))
    got = [r["x"] for r in df.orderBy("i").select(property_text(F.col("p")).alias("x")).collect()]
    assert got == [e for _, e in PROPERTIES]


def test_titles(spark):
    def title(plain, kind="title"):
        return {"type": kind, "title": None if plain is None else [{"plain_text": plain}]}

    cases = [
        ({"title": title("A"), "Name": title("B")}, "A", "B"),
        ({"Name": title("B"), "z": title("C")}, "B", "B"),
        ({"q": {"type": "number"}, "z": title("C")}, "C", "C"),
        ({"title": {"type": "title", "title": []}, "z": title("C")}, "", "C"),
        ({"q": {"type": "number"}}, "Untitled", "Untitled"),
        ({}, "Untitled", "Untitled"),
    ]
    import json

    rows = [(i, json.dumps(c[0])) for i, c in enumerate(cases)]
    df = spark.createDataFrame(rows, "i INT, j STRING").withColumn(
        "p", F.from_json("j", F.lit(f"MAP<STRING, {schemas.PROPERTY}>"))
    )
    got = df.orderBy("i").select(page_title(F.col("p")), entry_title(F.col("p"))).collect()
    assert [r[0] for r in got] == [c[1] for c in cases]
    # "A" and "B" are both titles of the first entry; the smaller name counts
    assert [r[1] for r in got] == [c[2] for c in cases]


@pytest.mark.parametrize("secret", ["s", "x" * 64, "y" * 100])
def test_hmac(values, secret):
    messages = ["", "1700000000{}", "é漢" * 50]
    expected = [hmac.new(secret.encode(), m.encode(), hashlib.sha256).hexdigest() for m in messages]
    assert values(lambda c: events.hmac_sha256(secret, c), messages) == expected


def test_freshness(values):
    now = datetime(2024, 1, 1, 12)
    at = int((now - datetime(1970, 1, 1)).total_seconds())
    cases = {str(at): True, str(at - 240): True, str(at + 240): True, str(at - 300): False, str(at - 360): False,
             str(at + 3600): False, "soon": False, "": False, " 1": False}
    assert values(lambda c: events.is_fresh(c, F.lit(now)), list(cases)) == list(cases.values())
    assert values(lambda c: events.is_fresh(c, F.lit(now)), [None]) == [False]


def test_routes(values):
    cases = {"page.created": "queue", "database.content_updated": "queue", "page.undeleted": "deletion",
             "database.deleted": "deletion", "page.locked": "ignored", "": "ignored"}
    assert values(lambda c: events.route(c, F.lit("e"), F.lit(None)), list(cases)) == list(cases.values())
    assert values(lambda c: events.route(c, F.lit(""), F.lit("token")), ["", "page.created"]) == ["verification", "ignored"]
