"""Secret scan: keyword automaton, anchored expressions near its hits, embedded checksums."""

from __future__ import annotations

import hashlib
import re
import string
import zlib
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which equal starts are listed. The first three are the base.
KINDS = ("assign", "access", "hex", "github", "npm")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
GITHUB = re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
NPM = re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
#: Keyword (in lower case) to kind.
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access", "npm_": "npm", "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github",
}
HEX_LENGTH = 32
_HEX_DIGITS = frozenset("0123456789abcdef")
_BASE62 = string.digits + string.ascii_uppercase + string.ascii_lowercase
_LOWER = {ord(c): c.lower() for c in string.ascii_uppercase}


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        found.add_word(word, (len(word), kind))
    found.make_automaton()
    return found


def base62_crc32(body: str) -> str:
    """CRC-32 of the body as six base-62 digits, as several token formats carry it."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, digit = divmod(n, 62)
        out = _BASE62[digit] + out
    return out


def _hex_runs(text: str) -> list[tuple[int, int]]:
    """Whole runs of hexadecimal digits of at least HEX_LENGTH: such a run covers a multiple of HEX_LENGTH, so only those
    places are looked at first."""
    runs, done = [], 0
    for i, c in enumerate(text[::HEX_LENGTH]):
        at = i * HEX_LENGTH
        if c not in _HEX_DIGITS or at < done:
            continue
        start = at
        while start > done and text[start - 1] in _HEX_DIGITS:
            start -= 1
        done = HEX.match(text, at).end()
        if done - start >= HEX_LENGTH:
            runs.append((start, done))
    return runs


def find_secrets(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of one text in order of start, then of KINDS; code points, end exclusive.

    Within a kind matches are leftmost and do not overlap: an expression is tried at each keyword from left to right
    unless the last match covers it. Matches that are too short or fail their checksum are dropped, but still cover.
    """
    if not text:
        return []
    low = text.lower() if text.isascii() else text.translate(_LOWER)
    hits = sorted((end - n + 1, kind) for end, (n, kind) in _automaton().iter(low))
    out: list[tuple[int, int, str]] = []
    covered = dict.fromkeys(KINDS, 0)
    for at, kind in hits:
        if at < covered[kind]:
            continue
        m = {"assign": ASSIGN, "access": ACCESS, "github": GITHUB, "npm": NPM}[kind].match(text, at)
        if not m:
            continue
        covered[kind] = m.end()
        if kind == "assign":
            good = len(m[2]) >= 8
        elif kind == "access":
            good = len(m[0]) >= 16
        else:
            good = base62_crc32(m[1]) == m[2]
        if good:
            out.append((at, m.end(), kind))
    out += [(a, b, "hex") for a, b in _hex_runs(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def spans(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        found = find_secrets(text)
        base = [s for s in found if s[2] in KINDS[:3]]
        join = lambda xs: ",".join(f"{k}:{a}:{b}" for a, b, k in xs)
        n = [sum(s[2] == k for s in base) for k in KINDS[:3]]
        rows.append((*n, hashlib.sha256(join(base).encode()).hexdigest(), join(found)))
    return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan(docs: DataFrame) -> DataFrame:
    """One row per document row: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans``.

    ``spans`` lists all finds as kind:start:end. Kinds beyond the base (``github``, ``npm``) count only if the CRC-32 in their
    last six digits fits. Null and empty texts have none: zero counts, the digest of nothing, an empty list.
    Repeated rows give repeated results. Columns other than ``doc_id, text`` are not looked at.
    """
    udf = F.pandas_udf(spans, "n_assign LONG, n_access LONG, n_hex LONG, base_sha256 STRING, spans STRING")
    return docs.select("doc_id", udf("text").alias("s")).select("doc_id", "s.*")
