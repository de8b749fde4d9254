"""Personal data in whole texts: fixed patterns, and further candidates that boosted trees select."""

from __future__ import annotations

import bisect
import math
import random
import re
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwork.llm import boosting
from leafwork.llm.common import map_rows, release_models

BASE = ("email", "ip", "card", "phone")
FURTHER = ("secret", "account", "national_id", "local_phone", "spelled_email")
KINDS = BASE + FURTHER
CONTEXT = 32  # characters on either side that features look at
EXAMPLES = 4000  # texts that training examples are planted in

# The patterns of the base kinds. Those that start with a run of digits start at its
# beginning, which the look-behind says so that long runs take linear time; the local part of an
# address is found backwards from the @ for the same reason.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


@dataclass(frozen=True, order=True)
class Span:
    """A found place in code points, end exclusive."""

    kind: str
    start: int
    end: int
    base: bool = True


# -- base kinds -------------------------------------------------------------------------------


def _emails(text: str) -> Iterator[tuple[int, int]]:
    after, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            after = domain.end()
        else:
            after = max(after, at + 1)
        at = text.find("@", max(after, at + 1))


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each base kind that pass its test."""
    found = [Span("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(map(_small, m.group().split("."))):
                found.append(Span("ip", *m.span()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m.group().replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    found.append(Span("card", *m.span()))
        for m in _PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
                found.append(Span("phone", *m.span()))
    return found


# -- candidates -------------------------------------------------------------------------------

_AROUND_DIGIT = re.compile(r"[0-9][A-Za-z0-9+/_-]*={0,2}")
_VALUE = re.compile(r"[:=]\s{0,4}[\"']?([^\s\"'<>,;]{4,})")
_ACCOUNT = re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_NATIONAL = re.compile(r"(?<![\w-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![\w-])")
_LOCAL_PHONE = re.compile(r"(?<![\w+])\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}(?!\w)")
_AT = re.compile(r"\x20?(?:\(at\)|\[at\]|\{at\})\x20?|\x20at\x20")
_BEFORE_AT = re.compile(r"[A-Za-z0-9._%+-]{2,}$")
_AFTER_AT = re.compile(r"[A-Za-z0-9-]{2,}(?:\x20?(?:\(dot\)|\[dot\]|\{dot\})\x20?|\x20dot\x20|\.)[A-Za-z]{2,}")
_TOKEN = frozenset(string.ascii_letters + string.digits + "+/_-")


def candidates(text: str) -> list[Span]:
    """Places that may be personal data of the further kinds, found with high recall; they may overlap."""
    found = []
    if ":" in text or "=" in text:
        found += [Span("secret", *m.span(1), False) for m in _VALUE.finditer(text)]
    if _DIGIT.search(text):
        after = 0
        for m in _AROUND_DIGIT.finditer(text):
            start = m.start()
            while start > after and text[start - 1] in _TOKEN:
                start -= 1
            after = m.end()
            if m.end() - start >= 16:
                found.append(Span("secret", start, m.end(), False))
        for kind, pattern in (("account", _ACCOUNT), ("national_id", _NATIONAL), ("local_phone", _LOCAL_PHONE)):
            found += [Span(kind, *m.span(), False) for m in pattern.finditer(text)]
    for m in _AT.finditer(text):
        before = _BEFORE_AT.search(text, max(0, m.start() - 64), m.start())
        domain = _AFTER_AT.match(text, m.end()) if before else None
        if domain:
            found.append(Span("spelled_email", before.start(), domain.end(), False))
    return sorted(set(found), key=lambda s: (s.start, s.end, s.kind))


# Words that speak for and against each kind when they stand nearby.
_FOR = {
    "secret": re.compile(r"pass(?:word|wd|phrase)?|pwd|secret|token|api.?key|private.?key|credential|auth", re.I),
    "account": re.compile(r"iban|account|konto|cuenta|compte|bank", re.I),
    "national_id": re.compile(r"ssn|social|national|identity|passport", re.I),
    "local_phone": re.compile(r"phone|tel|call|mobile|cell|fax|telefon", re.I),
    "spelled_email": re.compile(r"mail|contact|write|reach|kontakt|correo", re.I),
}
_AGAINST = re.compile(r"sha-?\d*|md5|commit|hash|checksum|digest|version|order|invoice|isbn|doi|serial|build|http|www|part no|figure|page|score", re.I)
_BRACKETED = re.compile(r"[(\[{](?:at|dot)[)\]}]|\x20dot\x20")


def features(text: str, span: Span) -> list[float]:
    """Format and context of a candidate as numbers."""
    value = text[span.start : span.end]
    head = value[:256]
    before, after = text[max(0, span.start - CONTEXT) : span.start], text[span.end : span.end + CONTEXT]
    n, digits = len(head), sum(c.isdigit() for c in head)
    counts = Counter(head).values()
    cues = list(_FOR[span.kind].finditer(before))
    return [
        float(FURTHER.index(span.kind)), float(len(value)), digits / n, sum(c.isupper() for c in head) / n,
        sum(c in "0123456789abcdefABCDEF" for c in head) / n, sum(not c.isalnum() for c in head) / n,
        -sum(c / n * math.log2(c / n) for c in counts), len(counts) / n,
        float(sum(a.isdigit() != b.isdigit() for a, b in zip(head, head[1:], strict=False))),
        float(len(before) - cues[-1].end()) if cues else 99.0, float(bool(_AGAINST.search(before))),
        float(before.rstrip("\"' ").endswith(("=", ":"))), float(before[-1:] in ('"', "'")),
        float(before[-1:].isalnum()), float(after[:1].isalnum()), float(_BRACKETED.search(head) is not None),
    ]


# -- the selector -----------------------------------------------------------------------------


def _hex(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789abcdef") for _ in range(n))


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice(string.digits) for _ in range(n))


def _mixed(r: random.Random, n: int) -> str:
    return "".join(r.choice(string.ascii_letters + string.digits + "_-") for _ in range(n))


def _word(r: random.Random) -> str:
    return "".join(r.choice(string.ascii_lowercase) for _ in range(r.randint(3, 9)))


def _true(r: random.Random, kind: str) -> tuple[str, str, str]:
    """Made-up personal data of a kind: (text before, the data, text after)."""
    if kind == "secret":
        cue = r.choice(["password", "passwd", "pwd", "token", "secret", "api_key", "apikey", "API key", "auth token", "access_token"])
        value = r.choice([_hex, _mixed])(r, r.choice([8, 12, 16, 18, 20, 24, 32, 40, 64]))
        quote = r.choice(["", "", '"', "'"])
        return f"{cue}{r.choice(['=', ' = ', ': ', ':'])}{quote}", value, quote
    if kind == "account":
        groups = " ".join(_digits(r, 4) for _ in range(r.randint(3, 6)))
        value = r.choice(["DE", "FR", "ES", "GB", "NL"]) + _digits(r, 2) + " " + groups
        return r.choice(["IBAN ", "IBAN: ", "account ", "", "Konto "]), r.choice([value, value.replace(" ", "")]), ""
    if kind == "national_id":
        return r.choice(["SSN ", "SSN: ", "social security ", ""]), f"{_digits(r, 3)}-{_digits(r, 2)}-{_digits(r, 4)}", ""
    if kind == "local_phone":
        area = _digits(r, 3)
        value = r.choice([f"({area}) {_digits(r, 3)}-", f"{area}-{_digits(r, 3)}-", f"{area}.{_digits(r, 3)}.", f"{area} {_digits(r, 3)} "])
        return r.choice(["phone ", "tel. ", "call ", "", "mobile: "]), value + _digits(r, 4), ""
    at, dot = r.choice([(" (at) ", " (dot) "), ("[at]", "[dot]"), (" at ", " dot "), (" [at] ", "."), ("(at)", ".")])
    return r.choice(["mail ", "contact ", "", "write to "]), f"{_word(r)}.{_word(r)}{at}{_word(r)}{dot}{r.choice(['com', 'org', 'net', 'de'])}", ""


def _false(r: random.Random) -> str:
    """Text that generators propose but that is no personal data."""
    return r.choice([
        lambda: f"{r.choice(['sha1', 'sha256', 'commit', 'md5', 'checksum', 'hash'])}{r.choice([' ', ': ', '='])}{_hex(r, r.choice([16, 32, 40, 64]))}",
        lambda: f"{_word(r)}{r.choice(['=', ': ', ':'])}{r.choice([_word(r), _digits(r, r.randint(4, 9)), _word(r) + '/' + _word(r)])}",
        lambda: f"{r.choice(['order', 'invoice', 'build', 'serial', 'part no', 'ISBN'])} {_digits(r, r.randint(3, 6))}-{_digits(r, r.randint(4, 9))}-{_digits(r, r.randint(4, 6))}",
        lambda: f"{r.choice(['order', 'invoice', 'isbn', 'serial'])} {_digits(r, 3)}{r.choice('.- ')}{_digits(r, 3)}{r.choice('.- ')}{_digits(r, 4)}",
        lambda: f"http://{_word(r)}.org/{_word(r)}/{_digits(r, 4)}/{_word(r)}-{_digits(r, 6)}-{_word(r)}",
        lambda: f"{_word(r)} at {_word(r)}.{_word(r).capitalize()}",
        lambda: f"{_word(r)}{_digits(r, 4)}{_word(r)}{_word(r)}{_word(r)}",
        lambda: f"{r.choice(['score', 'figure', 'page', 'version'])} {_digits(r, 3)}-{_digits(r, 2)}-{_digits(r, 4)}",
        lambda: f"{_digits(r, 2)}:{_digits(r, 2)}:{_digits(r, 2)} 20{_digits(r, 2)}-{_digits(r, 2)}-{_digits(r, 2)}T{_digits(r, 2)}:{_digits(r, 2)}",
        lambda: f"AB{_digits(r, 2)} {_word(r).upper()[:4]} {_word(r).upper()[:4]} {r.choice(['THE', 'AND', 'CODE'])}",
    ])()


def planted_examples(texts: list[str], seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, truth and text number of candidates planted in real texts at random places.

    Truth is known because it is planted; candidates the texts had before are not used.
    """
    r = random.Random(seed)
    x, y, group = [], [], []
    for number, text in enumerate(texts):
        kind = FURTHER[number % len(FURTHER)]
        before, value, after = _true(r, kind)
        for true, piece in ((1.0, f"{before}{value}{after}"), (0.0, _false(r))):
            at = r.randint(0, len(text))
            at = max(text.rfind(" ", 0, at), text.rfind("\n", 0, at)) + 1
            context = text[max(0, at - 200) : at]
            whole = f"{context}{piece} {text[at : at + 200]}"
            start = len(context) + (len(before) if true else 0)
            end = len(context) + len(piece) - (len(after) if true else 0)
            for span in candidates(whole):
                if span.start < end and span.end > start:
                    if true and (span.kind != kind or span.start > start or span.end < end):
                        continue  # a part of planted data is neither true nor false
                    x.append(features(whole, span))
                    y.append(true)
                    group.append(number)
    return np.array(x).reshape(len(y), -1), np.array(y), np.array(group)


@dataclass(frozen=True)
class Selector:
    """Trees that give a candidate its chance, and the chance each further kind needs."""

    model: boosting.Boosted
    needed: dict[str, float]

    def select(self, text: str, base: list[Span]) -> list[Span]:
        """Further spans: likely enough, apart from base spans, the likeliest of overlapping ones."""
        taken = sorted((s.start, s.end) for s in base)
        found = [s for s in candidates(text) if not _overlaps(taken, s)] if text else []
        if not found:
            return []
        chance = self.model.chance(np.array([features(text, s) for s in found]))
        chosen: list[Span] = []
        held: list[tuple[int, int]] = []
        for i in sorted(range(len(found)), key=lambda i: (-chance[i], found[i].start, found[i].end, found[i].kind)):
            if chance[i] >= self.needed[found[i].kind] and not _overlaps(held, found[i]):
                chosen.append(found[i])
                held = sorted([*held, (found[i].start, found[i].end)])
        return chosen

    def spans(self, text: str) -> list[Span]:
        """All spans of a text, by kind and start."""
        base = base_spans(text)
        return sorted(base + self.select(text, base), key=lambda s: (KINDS.index(s.kind), s.start))


def _overlaps(sorted_spans: list[tuple[int, int]], span: Span) -> bool:
    i = bisect.bisect_left(sorted_spans, (span.end,))
    # spans of different base kinds may overlap each other, so a few before the place are looked at
    return any(end > span.start for _, end in sorted_spans[max(0, i - 8) : i])


def learn(docs: DataFrame, *, examples: int = EXAMPLES, precision: float = 0.98) -> Selector:
    """Grow, calibrate and set thresholds on examples planted in a sample of texts.

    The sample has about `examples` texts, picked by hash, of up to 2000 characters around a place;
    this is the only bound, and it holds for learning alone. Every third text is kept for calibration
    and for the thresholds, which let a kind through where `precision` of the examples are true.
    """
    texts = docs.select("text").where("text is not null and text <> ''")
    share = examples / max(1, texts.count())
    order = F.pmod(F.xxhash64("text", F.lit("fit")), F.lit(1 << 30))
    picked = texts.where(order < int(min(1.0, share) * (1 << 30))).select(order.alias("o"), F.substring("text", 1, 2000).alias("t"))
    sample = [r["t"] for r in picked.groupBy("o").agg(F.min("t").alias("t")).orderBy("o").limit(2 * examples).collect()]
    while sample and len(sample) < 600:
        sample = sample + sample
    x, y, group = planted_examples(sample or ["" for _ in range(600)])
    kept = group % 3 == 0
    model = boosting.calibrate(boosting.fit(x[~kept], y[~kept]), x[kept], y[kept])
    chance, kind = model.chance(x[kept]), x[kept][:, 0]
    needed = {
        name: max(0.5, boosting.threshold(chance[kind == i], y[kept][kind == i], precision)) for i, name in enumerate(FURTHER)
    }
    return Selector(model, needed)


# -- jobs -------------------------------------------------------------------------------------

SPANS = "array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"


def find_spans(docs: DataFrame, selector: Selector | None = None) -> DataFrame:
    """Personal data of every document: doc_id and spans (kind, start, end, base), by kind and start.

    Null text counts as empty and has no spans. Repeated rows are searched each; an empty table gives
    no rows; other columns are ignored.
    """
    selector = selector or learn(docs)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [[(s.kind, s.start, s.end, s.base) for s in selector.spans(t or "")] for t in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "spans": found})

    return map_rows(docs.select("doc_id", "text"), run, ("doc_id",), f"spans {SPANS}")


def redact(docs: DataFrame, selector: Selector | None = None) -> DataFrame:
    """The documents with each span replaced by its kind in brackets; all columns stay, n_chars is counted anew.

    Overlapping spans are replaced together, under the kind of the first. Null text stays null.
    """
    selector = selector or learn(docs)
    columns = docs.columns

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        out, at = [], 0
        spans = sorted(selector.spans(text), key=lambda s: (s.start, -s.end))
        for span in spans:
            if span.start >= at:
                out += [text[at : span.start], f"[{span.kind.upper()}]"]
            at = max(at, span.end)
        return "".join([*out, text[at:]]) if spans else text

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release_models()
        for frame in frames:
            yield frame.assign(text=[clean(t) for t in frame["text"]])

    cleaned = map_rows(docs, run, columns, "")
    if "n_chars" in columns:
        cleaned = cleaned.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned.select(*columns)


def joined(spans: Column) -> Column:
    """Spans as text: kind:start:end, separated by commas."""
    parts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(parts, ",")


def summarise(found: DataFrame) -> DataFrame:
    """Counts per base kind, a digest of the base spans, and all spans as text."""
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(count, BASE), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )
