"""User code over tables: row functions, per-sample functions and batch scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.session import spread_by

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def apply_rows(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``fn`` over Arrow batches of any rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield fn(b)

    return df.mapInPandas(run, schema)


def _restored(part: pd.DataFrame, marks: dict[str, str], whole: set[str]) -> pd.DataFrame:
    """Put nulls back into columns that came filled, with the types pandas gives to such columns."""
    out = part[[c for c in part.columns if c not in marks.values()]].copy()
    for c, m in marks.items():
        if part[m].any():
            out[c] = part[c].astype("float64" if c in whole else "object").mask(part[m], np.nan if c in whole else None)
    return out


def _stacked(results: list[pd.DataFrame | tuple], names: list[str]) -> pd.DataFrame:
    """Results of many samples as one frame. Types that differ between samples (a null makes integers floats) stay as they are, value by value."""
    rows = [r for r in results if isinstance(r, tuple)]
    frames = [r for r in results if not isinstance(r, tuple) and len(r)]
    if rows:
        frames.append(pd.DataFrame(rows, columns=names, dtype="object"))
    if len({tuple(f.dtypes.tolist()) for f in frames}) > 1:
        frames = [f.astype("object") for f in frames]
    return pd.concat(frames, ignore_index=True) if frames else pd.DataFrame(columns=names)


def apply_sample(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame | tuple], schema: str, key: str = "sample_id") -> DataFrame:
    """``fn`` over all rows of one sample; the caller vouches that a sample fits in a task. A result of one row may be a tuple in the
    schema's order, which costs less than a frame.

    Rows come sorted by sample in Arrow batches that hold many samples, and are cut there: a group of its own for Spark would cost
    more than most functions do. Integers and flags travel filled, with marks for nulls, so that a null in one sample does not change the
    types of another.
    """
    names = T.StructType.fromDDL(schema).names
    whole = {f.name for f in df.schema if isinstance(f.dataType, _WHOLE)}
    marks = {f.name: f"_null_{i}" for i, f in enumerate(df.schema) if f.nullable and (f.name in whole or isinstance(f.dataType, T.BooleanType))}
    filled = [F.coalesce(F.col(f.name), F.lit(0).cast(f.dataType)).alias(f.name) if f.name in marks else F.col(f.name) for f in df.schema]
    flags = [F.col(c).isNull().alias(m) for c, m in marks.items()]
    rows = spread_by(df.select(*filled, *flags, F.col(key).isNull().alias("_no_key")), "_no_key", key).sortWithinPartitions("_no_key", key)

    def called(b: pd.DataFrame, cuts: np.ndarray) -> pd.DataFrame:
        plain = not any(b[m].to_numpy().any() for m in marks.values())
        slim = b.drop(columns=["_no_key", *marks.values()]) if plain else b.drop(columns="_no_key")
        out = []
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            part = slim.iloc[lo:hi]
            part.index = pd.RangeIndex(hi - lo)
            out.append(fn(part if plain else _restored(part, marks, whole)))
        return _stacked(out, names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[pd.DataFrame] = []  # of the last sample seen, which may go on in the next batch
        for b in batches:
            if b.empty:
                continue
            none, ids = b["_no_key"].to_numpy(), b[key]
            same = (ids.eq(ids.shift()) | (ids.isna() & ids.shift().isna())).to_numpy() & (none == np.r_[none[:1], none[:-1]])
            same[0] = False
            starts = np.flatnonzero(~same)
            if waiting:
                last, first = waiting[-1].iloc[-1], b.iloc[0]
                goes_on = last["_no_key"] == first["_no_key"] and (last[key] == first[key] or (pd.isna(last[key]) and pd.isna(first[key])))
                if goes_on and len(starts) == 1:
                    waiting.append(b)
                    continue
                if goes_on:
                    waiting.append(b.iloc[: starts[1]])
                    b, starts = b.iloc[starts[1]:], starts[1:] - starts[1]
                held = pd.concat(waiting, ignore_index=True)
                yield called(held, np.array([0, len(held)]))
            if len(starts) > 1:
                yield called(b.iloc[: starts[-1]], starts)
            waiting = [b.iloc[starts[-1]:]]
        if waiting:
            held = pd.concat(waiting, ignore_index=True)
            yield called(held, np.array([0, len(held)]))

    return rows.mapInPandas(run, schema)


def score(images: DataFrame, make_model: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """Detections of an image table. The model is made once per task and used on every batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for b in batches:
            yield model(b)

    return images.mapInPandas(run, schema)
