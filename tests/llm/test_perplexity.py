"""Rules and perplexity bands against a plain model made of dictionaries."""

import collections
import math
import random
import re
import statistics

import numpy as np
import pytest

from framewright.llm import perplexity as px

SCHEMA = "doc_id LONG, text STRING, lang STRING, entropy STRING, n INT, part STRING, kept INT"


def grams(text, order):
    stream = "\n" * (order - 1) + text + "\n" if text else ""
    return [stream[i : i + order] for i in range(len(stream) - order + 1)]


class Plain:
    def __init__(self, texts, order):
        self.order = order
        top = collections.Counter(g for t in texts for g in grams(t, order))
        self.levels = {order: dict(top)}
        for n in range(order - 1, 0, -1):
            self.levels[n] = dict(collections.Counter(g[1:] for g in self.levels[n + 1]))
        self.contexts, self.off = {}, {}
        for n, level in self.levels.items():
            c = [sum(v == k for v in level.values()) for k in range(1, 5)]
            if min(c) > 0:
                y = c[0] / (c[0] + 2 * c[1])
                self.off[n] = [max(0.0, k - (k + 1) * y * c[k] / c[k - 1]) for k in (1, 2, 3)]
            else:
                self.off[n] = [0.5, 1.0, 1.5]
            ctx = self.contexts[n] = {}
            for g, v in level.items():
                e = ctx.setdefault(g[:-1], [0, 0.0])
                e[0] += v
                e[1] += self.off[n][min(v, 3) - 1]

    def p(self, gram):
        n = len(gram)
        if n == 0:
            return 1 / (len(self.levels[1]) + 1)
        total, left = self.contexts[n].get(gram[:-1], (0, 0))
        if not total:
            return self.p(gram[1:])
        c = self.levels[n].get(gram, 0)
        own = c - self.off[n][min(c, 3) - 1] if c else 0
        return own / total + left / total * self.p(gram[1:])

    def entropy(self, text):
        found = [-math.log(self.p(g)) for g in grams(text, self.order)]
        return sum(found) / len(found) if found else None


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    hit = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(words), sum(map(len, words)), symbols, again, len(hit)


def brute_force(rows, order, below, above, least):
    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append(r)
    out = []
    for lang, members in langs.items():
        model = Plain([r[1] for r in members], order)
        got = [(r, base(r[1]), model.entropy(r[1])) for r in members]
        fails = [b[0] < 50 or 100 * b[4] > 50 * b[0] for _, b, _ in got]
        values = sorted(math.floor(e * 10_000 + 0.5) for (_, _, e), f in zip(got, fails) if not f)
        middle = spread = None
        if values:
            middle = statistics.median_low(values)
            spread = max(statistics.median_low([abs(v - middle) for v in values]) / 10_000, least)
        for (r, b, e), f in zip(got, fails):
            kept = not f and middle / 10_000 - below * spread <= e <= middle / 10_000 + above * spread
            out.append((r[0], *b, f, None if e is None else round(e, 4), kept))
    return out


def order_of(rows):
    return sorted(rows, key=lambda r: tuple((v is None, v or 0) for v in r))


def some(n, seed=2):
    rng = random.Random(seed)
    words = ["the", "river", "déjà", "so", "Über", "and", "漢字", "x\x85y", "stone", "light"]
    rows = []
    for i in range(n):
        text = " ".join(rng.choices(words, k=rng.randrange(20, 120)))
        kind = rng.randrange(10)
        if kind == 0:
            text = "".join(chr(rng.randrange(0x400, 0x2000)) for _ in range(120)) + " " + " ".join("Z%d" % rng.randrange(99) for _ in range(60))
        if kind == 1:
            text = "a line\n\n" * 20 + text
        if kind == 2:
            text = text.replace(" ", "\t\n") + "# | <b>\v\f\r &"
        rows.append((i, rng.choice([text] * 8 + [None, "", "\n \n"]), rng.choice(["en", "en", "fr", None]), "x", 1, "y", 0))
    return rows


@pytest.mark.parametrize("model_bytes", [px.MODEL_BYTES, 0])
def test_brute_force(spark, model_bytes, tmp_path):
    path = f"{tmp_path}/docs"
    spark.createDataFrame(some(150), SCHEMA).repartition(5).write.parquet(path)
    got = px.judge(spark.read.parquet(path), order=4, below=4.0, above=4.0, model_bytes=model_bytes).collect()
    got = [(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"],
            None if r["entropy"] is None else round(r["entropy"], 4), r["kept"]) for r in got]
    want = brute_force(some(150), 4, 4.0, 4.0, 0.01)
    assert 5 < sum(r[-1] for r in want) and any(not r[-1] and not r[-3] for r in want)
    for a, b in zip(order_of(got), order_of(want), strict=True):
        assert a[:7] == b[:7] and a[8] == b[8]
        assert (a[7] is None) == (b[7] is None) and abs((a[7] or 0) - (b[7] or 0)) < 2e-4


def test_unseen_texts_back_off(spark):
    texts = ["one two one three", "two two one", "four"]
    counts = collections.Counter(g for t in texts for g in grams(t, 3))
    rows = spark.createDataFrame([("en", g, c) for g, c in counts.items()], "lang STRING, gram STRING, c LONG")
    model, plain = px.loaded(px.kneser_ney(rows, 3), 3), Plain(texts, 3)
    for text in ("one four", "zzz", "owt", *texts):
        assert px.cross_entropies([text], "en", model)[0] == pytest.approx(plain.entropy(text), abs=1e-5)
    codes = np.array([[ord(c) for c in "on" + last] for last in {g[-1] for g in plain.levels[1]} | {"ሴ"}])
    assert np.exp(model.log_probabilities("en", codes)).sum() == pytest.approx(1, abs=1e-5)


def test_parts_of_long_texts_and_large_alphabets():
    rng = random.Random(1)
    texts = ["".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(30_000)), None, "abc" * 5000, ""]
    got = collections.Counter()
    for parts in px.pieces(texts, 5, most=7_000):
        for rows, keys, alphabet in px.packed(parts, 5):
            codes = px.spelled(keys, alphabet, 5)
            got.update((r, "".join(map(chr, c))) for r, c in zip(rows.tolist(), codes.tolist()))
    assert got == collections.Counter((i, g) for i, t in enumerate(texts) for g in grams(t or "", 5))


def test_repeated_rows_hot_language_and_empty(spark):
    line = " ".join(f"w{i}" for i in range(60))
    rows = [(1, line, "en", "", 0, "", 0)] * 100 + [(2, "of " * 80, "en", "", 0, "", 0), (None, None, None, "", 0, "", 0)]
    got = px.judge(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 102 and sum(r["kept"] for r in got) == 100
    assert [r["base_failed"] for r in got if r["doc_id"] != 1] == [True, True]
    assert px.judge(spark.createDataFrame([], SCHEMA)).collect() == []


def test_more_text_makes_a_larger_model(spark):
    rows = some(120)
    small = px.gram_counts(spark.createDataFrame(rows[:20], SCHEMA), 5).select("gram").distinct().count()
    large = px.gram_counts(spark.createDataFrame(rows, SCHEMA), 5).select("gram").distinct().count()
    assert large > 1.5 * small
