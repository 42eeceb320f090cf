"""The manifest against a tree built in one piece."""

import hashlib
import random
import zlib

import pytest

from framewright.llm import merkle

SCHEMA = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG, tree STRING, pos LONG, digest STRING"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    fields = []
    for v in (row[0], row[3], row[2], row[4], text):
        fields.append("-" if v is None else f"{len(str(v).encode())}:{v}")
    return h(*fields)


def fold_all(nodes):
    """All levels, the last of one node."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def climb(levels, i, node, siblings):
    for level in levels[:-1]:
        first = i // 8 * 8
        run = level[first : first + 8]
        siblings += [x for j, x in enumerate(run) if first + j != i]
        run[i - first] = node
        node, i = h(*run), i // 8
    return node


def brute_force(rows):
    langs = {}
    for row in rows:
        langs.setdefault(row[2], []).append((row, leaf(row, row[1])))
    names = sorted(langs, key=lambda v: (v is not None, (v or "").encode()))
    trees = {}
    for lang, entries in langs.items():
        entries.sort(key=lambda e: (e[0][0] is not None, e[0][0] or 0, e[1]))
        trees[lang] = fold_all([e[1] for e in entries])
    top = fold_all([trees[n][-1][0] for n in names])
    out = []
    for lang, entries in langs.items():
        for i, (row, own) in enumerate(entries):
            node, siblings = own, []
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[1] is not None:
                node = leaf(row, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in row[1]))
            node = climb(trees[lang], i, node, siblings)
            node = climb(top, names.index(lang), node, siblings)
            out.append((row[0], own, trees[lang][-1][0], top[-1][0], h(*siblings), node, node == top[-1][0]))
    return out


def order(rows):
    return sorted(rows, key=lambda r: (str(r[0]), *r[1:]))


def run(spark, rows, depth):
    return [tuple(r) for r in merkle.manifest(spark.createDataFrame(rows, SCHEMA), depth).collect()]


def some(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = rng.choice([None, "", "ABC déjà", f"text {i} With Capitals", "ÀÉ straße 漢字"])
        lang = rng.choice(["en"] * 8 + ["fr", "de", "日本", "", None, "a"])
        rows.append((i * 7 % n, text, lang, rng.choice([None, "src0", "s:1"]), rng.choice([None, -3, 12]), "clash", 5, "x"))
    return rows


@pytest.mark.parametrize("depth, n", [(1, 70), (2, 600), (4, 1), (4, 600)])
def test_brute_force(spark, n, depth):
    rows = some(n)
    assert order(run(spark, rows, depth)) == order(brute_force(rows))


def test_one_leaf_beyond_full_groups(spark):
    """The last group has one node and still as many levels as the others."""
    rows = [(i, f"T{i}", "en", None, 1, "", 0, "") for i in range(65)]
    assert order(run(spark, rows, 2)) == order(brute_force(rows))


def test_repeated_rows_null_ids_and_long_text(spark):
    rows = [(3, "Same", "en", "s", 4, "", 0, "")] * 20 + [(None, f"t{i % 3}", None, None, None, "", 0, "") for i in range(12)]
    rows.append((4, "Long " * 400_000, "en", "s", 2_000_000, "", 0, ""))
    assert order(run(spark, rows, 2)) == order(brute_force(rows))


def test_many_languages(spark):
    rows = [(i, "X", f"l{i % 20}", None, 1, "", 0, "") for i in range(40)]
    assert order(run(spark, rows, 1)) == order(brute_force(rows))


def test_empty(spark):
    assert run(spark, [], 4) == []


def test_what_is_tampered_with_fails(spark):
    rows = [(i, "CAPS" if i % 2 else "small", "en", None, 1, "", 0, "") for i in range(100)]
    got = {r[0]: r for r in run(spark, rows, 2)}
    for i in range(100):
        hit = i % 2 == 1 and zlib.crc32(str(i).encode()) % 3 == 0
        assert got[i][6] == (not hit) and (got[i][5] == got[i][3]) == (not hit)


def test_fold_resumes_the_state_before_a_slot():
    nodes = [h(str(i)).encode() for i in range(70)]
    tree = merkle.Tree(nodes, None)
    assert merkle.fold(nodes[13], tree.path(13)) == tree.root
    changed = [*nodes]
    changed[13] = h("other").encode()
    assert merkle.fold(changed[13], tree.path(13)) == merkle.Tree(changed, None).root != tree.root
