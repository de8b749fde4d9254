import random

import pytest

from leafwork.llm.queries import prepared

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, "
    "score double, shard int, kept boolean, ids string, n_words bigint, hub bigint, class string, model string, queue int"
)


def prose(r, n, words=("lorem", "ipsum", "dolor", "sit", "amet", "tempor", "magna", "aliqua", "minim", "veniam", "quis")):
    return " ".join(r.choice(words) + r.choice(["", "", "ing", "er", "us"]) for _ in range(n))


@pytest.fixture(scope="session")
def ready(spark):
    return prepared(spark)


@pytest.fixture(scope="session")
def odd(ready):
    """Nulls in every column, empty and very long texts, repeated rows, ids above 2**53, clashing column names."""
    r = random.Random(5)
    long = prose(r, 30_000)
    texts = [
        (1, "", "en", "a"), (2, None, "en", "a"), (None, "no id here, only words", "en", None), (None, None, None, None),
        (4, long, "en", "b"), (5, prose(r, 80), None, "b"), (6, "?!. 123 …", "de", None), (7, "one", "fr", "c"),
        (7, "one", "fr", "c"), (2**60 + 1, prose(r, 50), "en", "a"), (2**60 + 3, "z" * 9000, "en", "a"), (8, " \n\t ", "es", "a"),
        (9, "<|endoftext|>x", "en", "a"), (10, "漢字" * 3000 + " \U0001f600", "zh", "d"),
    ]
    again = prose(r, 60)
    texts += [(20 + i, again, "en", "a") for i in range(5)]
    rows = [(i, t, lang, s, None if t is None else len(t), 0.5, 3, False, "x", 9, 1, "c", None, 2) for i, t, lang, s in texts]
    return ready.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def corpus(ready):
    """A few hundred documents of two made-up languages, with toxic ones, copies and near copies."""
    r = random.Random(11)
    north = ("skarn", "vind", "fjell", "stein", "havn", "skog", "brygge", "natt", "regn", "sol")
    south = ("lamora", "tierra", "camino", "noche", "lluvia", "sombra", "ventana", "ciudad", "mar", "piedra")
    rows = []
    for i in range(400):
        lang, words = (("no", north), ("es", south))[i % 2]
        text = ". ".join(prose(r, 9, words) for _ in range(8)) + "."
        toxic = i % 7 == 0
        text += r.choice([" you and such", " such a one", " you", " what a day", ""]) + ". " + prose(r, 4, words) + "."
        if toxic:
            text += " " + r.choice(["you grubbler", "such a snorkwit", "grubbler and snorkwit"]) + ". " + prose(r, 8, words)
        rows.append((i, text, lang, f"s{i % 3}", len(text), int(toxic)))
    rows += [(400 + k, rows[3][1], "es", "s0", 0, 0) for k in range(4)]
    rows += [(410 + k, rows[5][1] + f" tail{k}", "es", "s1", 0, 0) for k in range(4)]
    return ready.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, toxic int")


def collected(df):
    return [row.asDict() for row in df.collect()]
