"""Perceptual hashes of gray images: 64-bit values as signed BIGINT."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAY = (0.114, 0.587, 0.299)  # fixed values: weights of blue, green, red


def bits_to_long(bits: Column) -> Column:
    """64 characters of 0/1, most significant first, to a signed BIGINT."""
    return F.conv(bits, 2, -10).cast("bigint")


def mean_hash_bits(pixels: Column) -> Column:
    """Bit i tells whether pixel i is above the mean of an already 8x8 gray array."""
    mean = F.aggregate(pixels, F.lit(0.0), lambda s, v: s + v) / F.size(pixels)
    return F.array_join(F.transform(pixels, lambda v: F.when(v > mean, "1").otherwise("0")), "")


def mean_hash(pixels: Column) -> Column:
    return bits_to_long(mean_hash_bits(pixels))


def _area_weights(src: int, dst: int) -> np.ndarray:
    """Row-stochastic matrix that averages ``src`` cells into ``dst`` cells by overlap."""
    edges = np.arange(dst + 1) * src / dst
    cells = np.arange(src)
    cover = np.minimum(edges[1:, None], cells[None, :] + 1) - np.maximum(edges[:-1, None], cells)
    cover = np.clip(cover, 0, None)
    return cover / cover.sum(axis=1, keepdims=True)


def _to_long(flags: np.ndarray) -> int:
    return int(np.packbits(flags.astype(np.uint8)).view(">i8")[0])


def _cosine_basis(n: int) -> np.ndarray:
    k = np.arange(n)
    return np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n))


def image_hashes(images: DataFrame, id_col: str = "id") -> DataFrame:
    """``ahash, dhash, phash`` of images given as in Spark's ``image`` source
    (``height, width, nChannels, data``). Resizing averages by area.
    """
    id_type = images.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights: dict[tuple[int, int], np.ndarray] = {}
        dct = _cosine_basis(32)[:8]

        def resize(img: np.ndarray, rows: int, cols: int) -> np.ndarray:
            for src, dst in ((img.shape[0], rows), (img.shape[1], cols)):
                if (src, dst) not in weights:
                    weights[src, dst] = _area_weights(src, dst)
            return weights[img.shape[0], rows] @ img @ weights[img.shape[1], cols].T

        def one(h: int, w: int, c: int, data: bytes) -> tuple[int, int, int]:
            img = np.frombuffer(data, np.uint8).astype(np.float64).reshape(h, w, c)
            gray = img[:, :, :3] @ np.array(GRAY) if c >= 3 else img[:, :, 0]
            small = resize(gray, 8, 8)
            steps = np.diff(resize(gray, 8, 9), axis=1)
            freq = (dct @ resize(gray, 32, 32) @ dct.T).ravel()
            return (
                _to_long(small.ravel() > small.mean()),
                _to_long(steps.ravel() > 0),
                _to_long(freq > np.median(freq[1:])),
            )

        for b in batches:
            got = [one(*r) for r in zip(b["height"], b["width"], b["nChannels"], b["data"])]
            out = pd.DataFrame(got, columns=["ahash", "dhash", "phash"], dtype="int64")
            out.insert(0, id_col, b[id_col].to_numpy())
            yield out

    slim = images.select(id_col, "height", "width", "nChannels", "data")
    return slim.mapInPandas(run, f"{id_col} {id_type}, ahash BIGINT, dhash BIGINT, phash BIGINT")
