"""Personal data, languages, quality rules and toxicity, against brute force and held-out rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from leafwork.llm import boosting, language, pii, quality, toxicity

from .conftest import collected

# -- personal data ----------------------------------------------------------------------------

PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def digits(text):
    return re.sub("[^0-9]", "", text)


def luhn(number):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(number))]
    return sum(v - 9 if v > 9 else v for v in doubled) % 10 == 0


TESTS = {
    "email": lambda m: True,
    "ip": lambda m: all(int(p) <= 255 for p in m.split(".")),
    "card": lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m)),
    "phone": lambda m: 9 <= len(digits(m)) <= 15,
}


def plain_spans(text):
    return [(k, *m.span()) for k, p in PATTERNS.items() for m in p.finditer(text or "") if TESTS[k](m.group())]


def test_base_spans_equal_the_plain_patterns():
    r = random.Random(3)
    parts = ["1", "2", "25", ".", "@", "a", "-", " ", "+", "(", ")", "%", "b.c", "4539578763621486", "é", "1.2.3.4", "x@y.z", "+1 (414) 555-7134"]
    for _ in range(5000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 30)))
        assert sorted((s.kind, s.start, s.end) for s in pii.base_spans(text)) == sorted(plain_spans(text))


def test_long_runs_take_linear_time():
    for run in ("1" * 300_000, "a" * 300_000, "1." * 100_000, "+1" + " " * 200_000, "a1" * 150_000, "@" * 200_000):
        pii.base_spans(run)
        pii.candidates(run)


def test_find_and_redact(ready, corpus, odd):
    extra = [
        (1, 'login password = "h4x0rTr0ub4dor" now'), (2, "see commit sha1 2f9b0c6a43eb78aa99cbd7049c572391524f37a8 for it"),
        (3, "mail me@x.org or +1 (414) 555-7134, card 4539 5787 6362 1486, host 10.0.0.1"), (4, None), (None, "a@b.c"),
    ]
    docs = ready.createDataFrame(extra, "doc_id bigint, text string")
    selector = pii.learn(corpus)
    found = {r["doc_id"]: r for r in collected(pii.summarise(pii.find_spans(docs, selector)))}
    for doc_id, text in extra:
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in plain_spans(text))
        assert found[doc_id]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert all(found[doc_id][f"n_{k}"] == sum(s[0] == k for s in plain_spans(text)) for k in PATTERNS)
    assert "secret:" in found[1]["spans"] and "secret:" not in found[2]["spans"]
    clean = {r["doc_id"]: r["text"] for r in collected(pii.redact(docs, selector))}
    assert clean[3] == "mail [EMAIL] or [PHONE], card [CARD], host [IP]" and clean[4] is None
    whole = pii.redact(odd, selector)
    assert whole.schema == odd.schema and whole.count() == odd.count()
    assert pii.find_spans(odd.where("false")).count() == 0
    assert pii.find_spans(odd).count() == odd.count()


def test_trees_learn_and_calibrate():
    r = np.random.default_rng(0)
    x = r.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = boosting.calibrate(boosting.fit(x[:2000], y[:2000]), x[2000:], y[2000:])
    chance = model.chance(x[2000:])
    assert ((chance > 0.5) == (y[2000:] > 0)).mean() > 0.95
    assert boosting.threshold(np.array([0.9, 0.8, 0.7]), np.array([1.0, 1.0, 0.0]), 0.99) == 0.8
    assert boosting.threshold(np.array([0.9]), np.array([0.0]), 0.99) > 1


# -- languages --------------------------------------------------------------------------------


def phrases(sample, text):
    count, at = 0, 0
    while at < len(text):
        end = at + 1
        while end <= len(text) and text[at:end] in sample:
            end += 1
        count, at = count + 1, max(at + 1, end - 1)
    return count


def test_phrases_equal_plain_longest_matches():
    r = random.Random(1)
    for _ in range(60):
        sample = [r.randint(1, 3) for _ in range(r.randint(1, 40))]
        text = [r.randint(1, 4) for _ in range(r.randint(1, 50))]
        table = language.automaton(np.array(sample))
        rows = np.array(text, np.int32)[:, None]
        found = language.count_phrases(table, rows, np.ones(len(text), np.int64))
        as_text = "".join(map(chr, sample)), "".join(map(chr, text))
        assert found[0] == phrases(*as_text)


def test_languages(corpus, odd, nothing):
    rows = collected(language.identify_languages(corpus).join(corpus.select("doc_id", "lang"), "doc_id"))
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert len(held) > 50 and all(r["lang"] == r["lang_pred"] for r in held)
    rows = collected(language.identify_languages(odd).join(odd.select("doc_id", "text"), "doc_id"))
    assert language.identify_languages(odd).count() == odd.count()
    for row in rows:
        assert 0 <= row["score"] <= 1
        assert (row["lang_pred"] == "und") == (not any(c.isalpha() for c in row["text"] or ""))
    assert language.identify_languages(nothing).count() == 0


# -- quality rules ----------------------------------------------------------------------------

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    words, lines, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    windows = defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_counts_equal_plain_ones():
    r = random.Random(4)
    parts = ["a", "b", "é", " ", " ", "\n", "#", "漢", "\t", "\x0b", "\x1c", "x y\n", " ", "<|>"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 120))) for _ in range(500)] + ["", "a b " * 50]
    counts = quality.text_counts(texts)
    for i, text in enumerate(texts):
        assert tuple(int(counts[c][i]) for c in quality.COUNTS) == plain_counts(text), text


def test_model_is_kneser_ney(ready):
    texts = ["abracadabra", "abrakadabra 12", "cadabra", "abra"]
    docs = ready.createDataFrame([(t, "x") for t in texts], "text string, lang string")
    table = {(r["size"], r["gram"]): (r["p"], r["gamma"]) for r in collected(quality.kneser_ney(quality.count_grams(docs)))}
    n = quality.ORDER
    counts = {n: Counter()}
    for text in texts:
        raw = b"\0" * (n - 1) + text.replace("1", "0").replace("2", "0").encode()
        counts[n].update(raw[i : i + n] for i in range(len(raw) - n + 1))
    for size in range(n - 1, 0, -1):
        counts[size] = Counter(g[1:] for g in counts[size + 1])
    p = {b"": 1 / 256}
    for size in range(1, n + 1):
        of = Counter(counts[size].values())
        y = of[1] / (of[1] + 2 * of[2]) if of[1] else 0.5

        def discount(c, of=of, y=y):
            i = min(c, 3)
            ratio = of[i + 1] / of[i] if of[i] else 1.0
            return max(0.1 * i, min(0.95 * i, i - (i + 1) * y * ratio))

        contexts = defaultdict(list)
        for gram, c in counts[size].items():
            contexts[gram[:-1]].append(c)
        for gram, c in counts[size].items():
            some = contexts[gram[:-1]]
            gamma = sum(min(discount(k), k) for k in some) / sum(some)
            p[gram] = max(0, c - discount(c)) / sum(some) + gamma * p[gram[1:]]
            assert table[size, int.from_bytes(gram, "big")][0] == pytest.approx(p[gram])
            if size > 1:
                assert table[size - 1, int.from_bytes(gram[:-1], "big")][1] == pytest.approx(gamma)
    model = quality.HashModel(quality.store_model(quality.kneser_ney(quality.count_grams(docs))), "x")
    keys, _ = quality._padded(["abrac"])
    wanted = [math.log(p[(b"\0" * 4 + b"abrac")[i : i + 5]]) for i in range(5)]
    assert model.log_p(keys).tolist() == pytest.approx(wanted, rel=1e-5)
    total = sum(math.exp(float(model.log_p(np.array([int.from_bytes(b"cada", "big") << 8 | b]))[0])) for b in range(256))
    assert total == pytest.approx(1, abs=0.02)  # what is left to unseen bytes is shared out


def test_rules(ready, corpus, odd, nothing):
    r = random.Random(9)
    noise = [(1000 + i, " ".join("".join(chr(r.randint(0x100, 0x2000)) for _ in range(7)) for _ in range(60)), "no", "s0", 0, 0) for i in range(2)]
    docs = corpus.unionByName(ready.createDataFrame(noise, corpus.schema))
    rows = {row["doc_id"]: row for row in collected(quality.apply_rules(docs))}
    assert not rows[1000]["kept"] and not rows[1000]["base_failed"]
    assert all(row["kept"] for i, row in rows.items() if i < 1000)
    assert {r["doc_id"] for r in collected(quality.keep_good(docs))} == set(rows) - {1000, 1001}
    found = collected(quality.apply_rules(odd).select("doc_id", *quality.COUNTS, "base_failed", "kept"))
    wanted = sorted((str(r["doc_id"]), *plain_counts(r["text"] or "")) for r in collected(odd))
    assert sorted((str(r["doc_id"]), *(r[c] for c in quality.COUNTS)) for r in found) == wanted
    for row in found:
        assert row["base_failed"] == (row["n_words"] < 20 or 100 * row["n_repeat_words"] > 30 * row["n_words"])
        assert not (row["base_failed"] and row["kept"])
    assert quality.keep_good(odd).schema == odd.schema
    assert quality.apply_rules(nothing).count() == 0


def test_bands_reject_junk_on_both_sides(ready):
    r = random.Random(13)
    letters = "aaeeiioouunnrrsstlmdkgvbp"
    words = ["".join(r.choice(letters) for _ in range(r.randint(3, 9))) for _ in range(800)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows = [(i, text(r.randint(60, 200))) for i in range(600)]
    rows += [(1000 + i, " ".join(r.choice(words[:60]).upper() + "!!" for _ in range(80))) for i in range(20)]
    made_up = lambda: "".join(r.choice(letters) for _ in range(6))
    rows += [(2000 + i, " | ".join(made_up() if k % 4 else r.choice(words) for k in range(80))) for i in range(3)]
    found = collected(quality.apply_rules(ready.createDataFrame([(i, t, "xx") for i, t in rows], "doc_id bigint, text string, lang string")))
    middle = sorted(x["log_perplexity"] for x in found)[len(found) // 2]
    low, high, clean = ([x for x in found if x["doc_id"] // 1000 == k] for k in (1, 2, 0))
    assert not any(x["base_failed"] for x in found)
    assert all(x["log_perplexity"] < middle and not x["kept"] for x in low)
    assert all(x["log_perplexity"] > middle and not x["kept"] for x in high)
    assert sum(x["kept"] for x in clean) >= 0.98 * len(clean)


def test_band_stays_above_zero(ready):
    r = random.Random(14)
    easy = [(i, "lorem ipsum dolor " * 40, "xx") for i in range(40)]
    hard = [(100 + i, " ".join("".join(chr(r.randint(0x100, 0x2000)) for _ in range(9)) for _ in range(60)), "xx") for i in range(60)]
    docs = ready.createDataFrame([*easy, *hard, (999, "lorem " * 5000, "xx")], "doc_id bigint, text string, lang string")
    found = {x["doc_id"]: x for x in collected(quality.apply_rules(docs, max_repeat_percent=100))}
    assert found[999]["log_perplexity"] > 0 and not found[999]["kept"] and all(found[i]["kept"] for i, _, _ in hard)


# -- toxicity ---------------------------------------------------------------------------------


def plain_kernel(a, b):
    def feature(word):
        word, out = chr(toxicity.START) + re.sub("[^a-z0-9]", "", word), Counter()
        for i in range(len(word)):
            for j in range(i + 1, min(len(word), i + 1 + toxicity.GAP)):
                for k in range(j + 1, min(len(word), j + 1 + toxicity.GAP)):
                    out[word[i], word[j], word[k]] += toxicity.DECAY ** (k - i + 1)
        return out

    x, y = feature(a), feature(b)
    dot = lambda p, q: sum(v * q[k] for k, v in p.items())
    return dot(x, y) / math.sqrt(dot(x, x) * dot(y, y)) if x and y else 0.0


def test_kernel_equals_plain_sums():
    r = random.Random(8)
    marks = ["grubbler", "snork", "abcabc"]
    matcher = toxicity.Matcher(toxicity.Landmarks(marks))
    for _ in range(200):
        word = "".join(r.choice("grublesnokac.-") for _ in range(r.randint(1, 20))).strip(".-") or "x"
        if len(word) == 1:
            continue
        wanted = [plain_kernel(word, m) for m in marks]
        rows, found = matcher.sentences([word])
        got = found[0].tolist() if len(rows) else [0.0] * 3
        for a, b in zip(got, wanted, strict=True):
            assert a == pytest.approx(b**toxicity.POWER if b >= toxicity.CUT else 0.0, abs=1e-3)


class Counted:
    """An array that counts the rows taken from it."""

    def __init__(self, values):
        self.values, self.rows = values, 0

    def __getitem__(self, rows):
        self.rows += len(rows)
        return self.values[rows]


def test_kernel_is_worked_out_for_close_words_alone():
    r = random.Random(4)
    syllables = ("gru", "bb", "ler", "sno", "rk", "wit", "ska", "rn", "vin", "ter", "ment", "ing")
    marks = toxicity.Landmarks([w[:n] for w in ("grubbler", "snorkwit", "winterling") for n in range(4, len(w) + 1)])
    words = ["".join(r.choice(syllables) for _ in range(r.randint(1, 5))) for _ in range(3000)] + ["grubbler", "--", "zzz", ""]
    encoded = [bytes([toxicity.START]) + re.sub("[^a-z]", "", w).encode() for w in words]
    raw, owner = np.frombuffer(b"".join(encoded), np.uint8), np.repeat(np.arange(len(words)), list(map(len, encoded)))
    of, feature, weight = toxicity.subsequences(raw, owner)
    held = marks.table[feature] >= 0
    dense = np.zeros((len(words), len(marks.values)))
    dense[of[held], marks.table[feature[held]]] = weight[held]
    norm = np.sqrt(np.bincount(of, weight**2, len(words)))
    kernel = dense @ marks.values / np.where(norm > 0, norm, 1)[:, None]
    assert np.abs(kernel - toxicity.CUT).min() > 1e-6  # none so close that rounding decides
    wanted = np.flatnonzero(kernel.max(axis=1) >= toxicity.CUT)
    marks.values = Counted(marks.values)
    names, values = marks.similarities(raw, owner, len(words))
    assert names.tolist() == wanted.tolist() and 100 < len(names) < len(words) / 2
    kernel[kernel < toxicity.CUT] = 0
    assert np.allclose(values, kernel[wanted] ** toxicity.POWER, atol=1e-5)
    assert marks.values.rows == (held & np.isin(of, wanted)).sum()  # was for any word of common syllables
    assert len(marks.similarities(raw[:0], owner[:0], 0)[0]) == len(marks.similarities(raw[-4:], owner[-4:] - owner[-4], 4)[0]) == 0


def test_highest_sentences():
    top = toxicity.highest(3, np.array([2, 0, 2, 2, 2]), np.array([0.5, -2.0, 3.0, 1.0, 0.1]), -1.0)
    assert top.tolist() == [[-1.0, -1.0, -1.0], [-1.0, -1.0, -1.0], [3.0, 1.0, 0.5]]


def test_toxicity(ready, corpus, odd, nothing):
    labels = corpus.select("doc_id", "toxic")
    machine = toxicity.learn(corpus, labels)
    rows = collected(toxicity.rate_documents(corpus, labels).join(labels, "doc_id"))
    held = [r for r in rows if r["held_out"] and r["doc_id"] < 400]
    assert len(held) > 50 and all(r["predicted"] == r["toxic"] for r in held)
    tricks = [
        (1, "you g.r.u.b.b.l.e.r go"), (2, "a g r u b b l e r here"), (3, "what a grxubbler he is. A snozrkwit and a grubbqler too."), (4, "GRUBBLER!"),
        (5, "vind skog natt"), (6, ""), (7, None), (8, "x" * 5000 + " vind"),
    ]
    docs = ready.createDataFrame(tricks, "doc_id bigint, text string")
    score = {r["doc_id"]: r["score"] for r in collected(toxicity.score_documents(docs, machine))}
    assert min(score[i] for i in (1, 2, 3, 4)) > 0.3 > max(score[i] for i in (5, 6, 7, 8))
    assert score[6] == score[7]
    rated = collected(toxicity.rate_documents(odd, labels))
    assert len(rated) == odd.count() and all(0 <= r["score"] <= 1 for r in rated)
    assert toxicity.drop_toxic(odd, labels).schema == odd.schema
    assert toxicity.rate_documents(nothing, labels).count() == 0
    unknown = ready.createDataFrame([(None, 1), (3, None)], "doc_id bigint, toxic int")
    assert {r["score"] for r in collected(toxicity.rate_documents(odd, unknown))} == {0.0}


def test_lines_made_to_collide():
    """Two different lines that sums modulo a power of two take for one are not duplicates."""
    word = "".join("ab"[i.bit_count() & 1] for i in range(1024))
    text = word + "\n" + word.translate(str.maketrans("ab", "ba"))
    counts = quality.text_counts([text])
    assert tuple(int(counts[c][0]) for c in quality.COUNTS) == plain_counts(text) and counts["n_dup_lines"][0] == 0


def test_landmarks_are_picked_without_a_table_of_all_candidates():
    import tracemalloc

    rng = np.random.default_rng(5)
    strings = sorted({"".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz0123456789"), rng.integers(3, 25))) for _ in range(3000)})
    strings += [strings[7] + "s", "--", strings[9][:-1]]
    few = strings[:400] + strings[-3:]
    every, free, dense = toxicity.Landmarks(few), np.ones(len(few), bool), []
    for i in range(len(few)):
        if free[i] and every.values[:, i].any():
            dense.append(i)
            free &= every.values.T @ every.values[:, i] < 0.8
    assert toxicity.apart(few, 10_000) == dense and toxicity.apart(few, 5) == dense[:5]
    assert toxicity.apart([], 5) == []
    tracemalloc.start()
    toxicity.apart(strings, 128)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120_000_000  # the table took over 400 MB
