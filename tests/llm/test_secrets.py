import hashlib
import re

from framewright.llm import secrets as sc
from hypothesis import given, settings
from hypothesis import strategies as st

PIECES = ["password", "PassWD", "secret", "ToKeN", "api_key", "APIKEY", "AKIA", "akia", "AK", "=", ":", " ", '"', "'", "abcdef0123456789", "0" * 31, "f", "G", "Zx-_./+=",
          "ſecret", "toKen", "\n", "é", "ghp_", "npm_", "A" * 12, "12345678"]


def base(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [f"{sc.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out)]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=30).map("".join))
def test_base_spans_are_those_of_the_plain_expressions(text):
    assert [f"{k}:{a}:{b}" for a, b, k in sc.find_secrets(text) if k in sc.KINDS[:3]] == base(text)


def test_checksums():
    body = "a1B2" * 7 + "zz"
    good = "ghp_" + body + sc.base62_crc32(body)
    npm = "npm_" + body + sc.base62_crc32(body)
    bad = "ghp_" + body + "000000"
    text = f"x {good} {bad} {npm}! {good}x"
    assert sc.find_secrets(text) == [(2, 42, "github"), (2 + 82, 2 + 122, "npm")]
    assert sc.find_secrets("token=" + good)[0][2] == "assign" and sc.find_secrets("token=" + good)[1] == (6, 46, "github")


def test_frame(spark):
    texts = ["token = abcdefgh1", None, "", "é AKIA" + "Z" * 12, "0" * 100_000, "x" * 300_000 + "secret:12345678", "token = abcdefgh1"]
    docs = spark.createDataFrame([(i if i else None, t, "s", 1) for i, t in enumerate(texts)], "doc_id LONG, text STRING, spans STRING, s INT")
    got = {r["doc_id"]: r for r in sc.scan(docs).collect()}
    assert [got[i or None]["spans"] for i in range(7)] == [
        "assign:0:17", "", "", "access:2:18", "hex:0:100000", "assign:300000:300015", "assign:0:17",
    ]
    for i, t in enumerate(texts):
        r = got[i or None]
        assert r["base_sha256"] == hashlib.sha256(",".join(base(t or "")).encode()).hexdigest()
        assert r["n_assign"] + r["n_access"] + r["n_hex"] == len(base(t or ""))
    assert sc.scan(docs.where("false")).count() == 0
