"""Hashed features and the draw against a plain computation."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from framewright.llm import importance

SCHEMA = "doc_id LONG, text STRING, score STRING, id STRING, n INT, pos INT"


def words(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def features(text, most):
    w = words(text)
    return [" ".join(w[i : i + n]) for n in range(1, most + 1) for i in range(len(w) - n + 1)]


def brute_force(rows, target, percent=10, least=20, most=1, buckets=10_000):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for r in rows:
        for f in features(r[1], most):
            s[bucket(f)] += 1
    for text in target:
        for f in features(text, most):
            t[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    out = []
    for r in rows:
        f = features(r[1], most)
        weight = sum(gain[bucket(x)] for x in f) // len(f) if f else 0
        digest = int(hashlib.sha256(f"2024:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((digest + 0.5) / 4294967296)))
        out.append([r[0], len(f), weight, score, None, len(words(r[1]))])
    able = sorted((x for x in out if x[5] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[2], x[1]))
    for i, x in enumerate(able[: percent * len(able) // 100]):
        x[4] = i + 1
    return [tuple(x[:5]) for x in out]


def order(rows):
    return sorted(rows, key=lambda r: tuple((v is None, v or 0) for v in r))


def some(n, seed=3):
    rng = random.Random(seed)
    vocabulary = ["Alpha", "beta", "GAMMA9", "dé", "été", "漢字", "x_y", "a-b", "\x80", "long" * 30]
    rows = []
    for i in range(n):
        text = rng.choice([None, "", "--- !!!", " ".join(rng.choices(vocabulary, k=rng.randrange(1, 60))), "Alpha,beta;\ngamma9 " * 12])
        rows.append((rng.choice([None, i, i, i, i // 2]), text, "clash", "z", 1, 2))
    return rows


@pytest.mark.parametrize("most", [1, 3])
def test_brute_force(spark, most):
    rows, target = some(300), ["alpha beta été", None, "", "GAMMA9 gamma9 漢字"]
    docs = spark.createDataFrame(rows, SCHEMA)
    goal = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id INT, text STRING")
    got = [tuple(r) for r in importance.resample(docs, goal, most=most).collect()]
    assert order(got) == order(brute_force(rows, target, most=most))


def test_hot_rows_and_long_text(spark):
    rows = [(7, "one two three " * 10, "", "", 0, 0)] * 200 + [(None, "four five " * 15, "", "", 0, 0)] * 100
    rows.append((8, "wörd Term " * 300_000, "", "", 0, 0))
    goal = spark.createDataFrame([(1, "one two")], "item_id INT, text STRING")
    got = [tuple(r) for r in importance.resample(spark.createDataFrame(rows, SCHEMA), goal, buckets=100_000, percent=50).collect()]
    assert order(got) == order(brute_force(rows, ["one two"], percent=50, buckets=100_000))


def test_empty_tables(spark):
    docs, goal = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "item_id INT, text STRING")
    assert importance.resample(docs, goal).collect() == []
    rows = some(40)
    got = [tuple(r) for r in importance.resample(spark.createDataFrame(rows, SCHEMA), goal).collect()]
    assert order(got) == order(brute_force(rows, []))


def test_crc_of_a_substring_from_two_prefixes():
    rng = random.Random(5)
    for n in (0, 1, 7, 255, 256, 100_003):
        before, rest = rng.randbytes(rng.randrange(1, 50)), rng.randbytes(n)
        start, end = zlib.crc32(before), zlib.crc32(before + rest)
        got = np.uint32(end) ^ importance.shifted(np.array([start], np.uint32), np.array([n]))[0]
        assert int(got) == zlib.crc32(rest)


def test_draw_leans_to_the_target(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices(["sun", "sky", "sea"] if i % 4 == 0 else ["tax", "law", "fee"], k=30)), "", "", 0, 0) for i in range(800)]
    goal = spark.createDataFrame([(1, "sun sky sea " * 10)], "item_id INT, text STRING")
    drawn = [r["doc_id"] for r in importance.resample(spark.createDataFrame(rows, SCHEMA), goal).collect() if r["rank"]]
    assert len(drawn) == 80 and sum(i % 4 == 0 for i in drawn) > 70
