from pathlib import Path

from framewright.llm import licenses

TEXTS = dict(licenses.KNOWN[:5])
SCHEMA = "doc_id LONG, text STRING, digest STRING, license STRING, key STRING"


def scan(spark, texts):
    docs = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in enumerate(texts)], SCHEMA)
    return sorted(licenses.scan(docs).collect(), key=lambda r: r["doc_id"])


def test_variants_of_whole_texts(spark):
    mit, isc = TEXTS["MIT"], TEXTS["ISC"]
    texts = [
        mit, mit.upper(), "Copyright (c) 2019 Somebody\n\n" + mit.replace(". ", ".\n"), "© 2020 X\n" + mit.replace('"', "“"),
        isc.replace("and/or", "and / or"), mit + " And one more term.", mit.replace("sublicense", "sub-license"), "© 2020 X",
    ]
    got = [r["license"] for r in scan(spark, texts)]
    assert got == ["MIT", "MIT", "MIT", "MIT", "ISC", None, "MIT", None]


def test_notices_and_edges(spark):
    texts = [
        "Text first.\nReleased under the MIT Licence.\nLicensed under CC BY-NC 4.0\nlicensed under cc by-nc 4.0.", "Released under the MIT License.",
        None, "", "...\n!!", "Released under the MIT License, or not.\nmore", "no licence here " * 30_000, "Text first.\nReleased under the MIT Licence.",
    ]
    rows = scan(spark, texts)
    assert [(r["n_notices"], r["notices"], r["license"]) for r in rows] == [
        (3, "CC-BY-NC-4.0,MIT", None), (0, "", "MIT"), (0, None, None), (0, "", None), (0, "", None), (0, "", None), (0, "", None), (1, "MIT", None),
    ]
    assert rows[2]["digest"] is None and rows[3]["digest"] == rows[4]["digest"]


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a\nReleased under the MIT License.")] * 3 + [(1, "b")], "doc_id LONG, text STRING")
    assert sorted(r["n_notices"] for r in licenses.scan(docs).collect()) == [0, 1, 1, 1]
    assert licenses.scan(docs.where("false")).count() == 0


def test_files_as_found(spark):
    """Titles, bullets, wraps before the word copyright, and long texts."""
    mit, isc, bsd = TEXTS["MIT"], TEXTS["ISC"], TEXTS["BSD-3-Clause"]
    texts = [
        "MIT License\n\nCopyright (c) 2020 A\n\n" + mit, "The MIT License (MIT)\nCopyright 2020 A\n" + mit.replace("copyright notice", "\ncopyright notice"),
        isc.replace("copyright notice", "\ncopyright notice"), "BSD 3-Clause License\n\nCopyright: A B\n" + bsd.replace("COPYRIGHT HOLDERS", "\nCOPYRIGHT HOLDERS"),
        bsd.replace(" 1. ", "\n* ").replace(" 2. ", "\n* ").replace(" 3. ", "\n* ").replace("copyright holder ", "copyright\nowner "),
    ]
    want = ["MIT", "MIT", "ISC", "BSD-3-Clause", "BSD-3-Clause"]
    for file, name in (("Apache-2.0", "Apache-2.0"), ("GPL-2", "GPL-2.0"), ("GPL-3", "GPL-3.0"), ("LGPL-2.1", "LGPL-2.1"), ("MPL-2.0", "MPL-2.0")):
        path = Path("/usr/share/common-licenses") / file
        if path.exists():
            text = path.read_text()
            texts += [text, " ".join(text.split("\n")) if "(c)" not in text.lower() and "Copyright" not in text else text]
            want += [name, name]
    assert [r["license"] for r in scan(spark, texts)] == want
