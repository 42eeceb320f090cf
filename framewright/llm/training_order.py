"""Token ids in training order: packed sequences, a keyed permutation, fixed-stride binary shards."""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm.common import small_side, stored
from framewright.session import scratch_path

TOKENIZER = "byte_bpe_multi_50k.tiktoken"
#: Texts are encoded in pieces of about this many characters, cut before a blank, to bound memory.
PIECE = 1_000_000


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


@lru_cache(maxsize=2)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:  # installed with the library on every machine
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str, path: str) -> np.ndarray:
    """Ids of a text, as uint16 (the vocabulary has fewer than 65,536)."""
    enc = _encoding(path)
    parts, at = [], 0
    while at < len(text):
        end = len(text) if len(text) - at <= PIECE else max(text.rfind(" ", at + 1, at + PIECE), 0) or at + PIECE
        parts.append(np.array(enc.encode_ordinary(text[at:end]), dtype="<u2"))
        at = end
    return np.concatenate(parts) if parts else np.empty(0, "<u2")


def feistel(ids: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """Keyed permutation of 0..n-1: a balanced Feistel network over the next even number of bits, walked until
    the value falls below n (fewer than four steps on average)."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = [
        np.uint64(int.from_bytes(hashlib.sha256(f"{key}:{r}".encode()).digest()[:8], "little") | 1) for r in range(rounds)
    ]

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> shift, v & mask
        for k in keys:
            f = (right ^ (k >> np.uint64(32))) * k
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f ^ (f >> np.uint64(32))) & mask)
        return (left << shift) | right

    out = np.asarray(ids, dtype=np.uint64)
    with np.errstate(over="ignore"):
        out = once(out)
        while (far := out >= np.uint64(n)).any():
            out[far] = once(out[far])
    return out.astype(np.int64)


def tokenized(docs: DataFrame, tokenizer: str, end: int) -> DataFrame:
    """``part, at, doc_id, tokens``: ids of each text and an end mark; ``at`` is its place in the stream of its part."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                if not text:
                    continue
                ids = np.append(encode(text, tokenizer), np.uint16(end)).astype("<u2")
                rows.append((part, at, doc_id, ids.tobytes()))
                at += len(ids)
            yield pd.DataFrame(rows, columns=["part", "at", "doc_id", "tokens"]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), "text").where("text <> ''").mapInPandas(
        run, "part INT, at LONG, doc_id LONG, tokens BINARY"
    )


def materialize_order(
    docs: DataFrame,
    out: str | None = None,
    tokenizer: str | None = None,
    length: int = 2048,
    per_shard: int = 4096,
    key: int = 20_240_601,
    end: int = 50_256,
) -> DataFrame:
    """Write ``shard-*.bin`` and ``index.json`` under ``out``; return a row per sequence.

    The texts' ids, each followed by ``end``, form one stream in the order of the input's splits, cut into
    sequences of ``length`` (the last padded with ``end``). Sequence i of N goes to slot ``feistel(i)`` of N, slot s to place
    ``s % per_shard`` of shard ``s // per_shard``. Every slot has ``2 * length`` bytes, so a reader seeks to any slot and goes on from
    there. Range partitions hold whole shards; a shard appears under its name when complete, so a repeated
    task writes the same file again.

    Rows: ``slot, seq, shard, offset, n_tokens`` (without padding), ``doc_ids`` (in order, a null id as -1), ``sha256`` of the bytes.

    Null and empty texts have no ids. Null ids are kept as -1 in the lists. Repeated rows are written repeatedly. Without any ids there
    are no sequences. Columns other than ``doc_id, text`` are not looked at.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer or default_tokenizer()
    out = out or scratch_path(spark, "training-order")
    path = scratch_path(spark, "tokens")
    schema = "part INT, at LONG, doc_id LONG, tokens BINARY"
    tokenized(docs, tokenizer, end).write.option("compression", "zstd").parquet(path)
    ids = spark.read.schema(schema).parquet(path)
    bases = ids.groupBy("part").agg(F.sum(F.octet_length("tokens") / 2).cast("long").alias("n"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per split
    bases = stored(bases.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "token-bases")
    total = bases.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    count = -(-total // length)
    stride = 2 * length
    filesystem, root = fs.FileSystem.from_uri(out if "://" in out or out.startswith("file:") else f"file://{out}")
    filesystem.create_dir(root, recursive=True)
    meta = {"sequences": count, "length": length, "dtype": "<u2", "per_shard": per_shard, "key": key, "tokens": total, "pad": end}
    with filesystem.open_output_stream(f"{root}/index.json") as f:
        f.write(json.dumps(meta).encode())

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack = zstandard.ZstdCompressor(level=3).compress  # the shuffle's own codec gains little on ids
        for batch in batches:
            doc_ids, seqs, places, data = [], [], [], []
            for start, doc_id, tokens in zip(batch["start"], batch["doc_id"].astype("Int64").fillna(-1), batch["tokens"]):
                at, n = int(start), len(tokens) // 2
                for seq in range(at // length, (at + n - 1) // length + 1):
                    lo, hi = max(at, seq * length), min(at + n, (seq + 1) * length)
                    doc_ids.append(doc_id), seqs.append(seq), places.append(lo - seq * length)
                    data.append(pack(tokens[2 * (lo - at) : 2 * (hi - at)]))
            slots = feistel(np.array(seqs, dtype=np.uint64), count, key) if seqs else np.empty(0, np.int64)
            yield pd.DataFrame({
                "shard": slots // per_shard, "slot": slots, "seq": np.array(seqs, dtype=np.int64),
                "place": np.array(places, dtype=np.int32), "doc_id": np.array(doc_ids, dtype=np.int64), "tokens": data,
            })

    side, _ = small_side(bases.select("part", "base"))
    pieces = ids.join(side, "part").select((F.col("base") + F.col("at")).alias("start"), "doc_id", "tokens").mapInPandas(
        cut, "shard LONG, slot LONG, seq LONG, place INT, doc_id LONG, tokens BINARY"
    )

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        target, base = fs.FileSystem.from_uri(out if "://" in out or out.startswith("file:") else f"file://{out}")
        name, stream, temporary = None, None, ""
        seq: dict = {}
        ready: list[tuple] = []
        unpack = zstandard.ZstdDecompressor().decompress

        def finish() -> None:
            if seq:
                body = b"".join(seq["data"])
                n = len(body) // 2
                body += np.full(length - n, end, "<u2").tobytes()
                stream.write(body)
                ready.append((
                    seq["slot"], seq["seq"], seq["slot"] // per_shard, seq["slot"] % per_shard * stride, n,
                    seq["docs"], hashlib.sha256(body).hexdigest(),
                ))
                seq.clear()

        def close() -> None:
            if stream is not None:
                stream.close()
                target.move(temporary, f"{base}/shard-{name:06d}.bin")

        for batch in batches:
            for shard, slot, s, doc_id, tokens in zip(batch["shard"], batch["slot"], batch["seq"], batch["doc_id"], batch["tokens"]):
                if seq and seq["slot"] != slot:
                    finish()
                if shard != name:
                    close()
                    name, temporary = shard, f"{base}/.shard-{shard:06d}-{uuid.uuid4().hex}"
                    stream = target.open_output_stream(temporary)
                if not seq:
                    seq.update(slot=slot, seq=s, docs=[], data=[])
                seq["docs"].append(doc_id), seq["data"].append(unpack(tokens))
            yield pd.DataFrame(ready, columns=["slot", "seq", "shard", "offset", "n_tokens", "doc_ids", "sha256"])
            ready.clear()
        if seq:
            finish()
        close()
        yield pd.DataFrame(ready, columns=["slot", "seq", "shard", "offset", "n_tokens", "doc_ids", "sha256"])

    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(-(-count // per_shard), 20 * width))
    ordered = pieces.repartitionByRange(parts, "shard").sortWithinPartitions("slot", "place")
    rows = ordered.mapInPandas(
        write, "slot LONG, seq LONG, shard LONG, offset LONG, n_tokens LONG, doc_ids ARRAY<LONG>, sha256 STRING"
    )
    return stored(rows, "training-rows")


def read_slots(out: str, first: int, n: int) -> Iterator[np.ndarray]:
    """Sequences of the slots from ``first`` on, as a trainer that resumes would read them."""
    filesystem, root = fs.FileSystem.from_uri(out if "://" in out or out.startswith("file:") else f"file://{out}")
    with filesystem.open_input_file(f"{root}/index.json") as f:
        meta = json.loads(f.read())
    stride, per_shard, opened, file = 2 * meta["length"], meta["per_shard"], None, None
    for slot in range(first, min(first + n, meta["sequences"])):
        if slot // per_shard != opened:
            opened = slot // per_shard
            file = filesystem.open_input_file(f"{root}/shard-{opened:06d}.bin")
        file.seek(slot % per_shard * stride)
        yield np.frombuffer(file.read(stride), meta["dtype"])
