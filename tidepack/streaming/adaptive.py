"""Compressing streams: micro-batches of rows become segments, with each column's plan kept as state."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.dtypes import DTYPES
from ..operators.segments import SEGMENTS, column_types, _plain
from ..plans.search import Adaptive
from ..shipping import ship


def column_parts(df: DataFrame, index: str, batch: int) -> DataFrame:
    """column, dtype, part, row_idx, bits: one row per value, its bits as a long. Stateless, so it streams."""
    types = column_types(df, index)
    ship(df.sparkSession)
    plain = _plain(df, index, batch)
    # integers travel as longs and floating point values as doubles, both exact
    each = F.array(*(F.struct(F.lit(n).alias("column"), F.lit(d.name).alias("dtype"), (F.lit(None).cast("long") if d.is_float else F.col(f"`{n}`").cast("long")).alias("whole"), (F.col(f"`{n}`").cast("double") if d.is_float else F.lit(None).cast("double")).alias("real")) for n, d in types.items()))
    return plain.select("part", "row_idx", F.explode(each).alias("v")).select("v.column", "v.dtype", "part", "row_idx", "v.whole", "v.real")


def compress_stream(df: DataFrame, index: str, batch: int) -> DataFrame:
    """Segments of a streaming table whose rows come in order of the index. A column's part is written when its
    last row is there; rows of an unfinished part wait in the state, with the plan and the learned edges, so memory
    is a part for each column. Queries are exactly as fault-tolerant as their checkpoint."""
    values = column_parts(df, index, batch)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        column = key[0]
        waiting, adaptive = pickle.loads(state.get[0]) if state.exists else ({}, None)
        for f in frames:
            for part, rows in f.groupby("part"):
                d = DTYPES[rows["dtype"].iloc[0]]
                adaptive = adaptive or Adaptive(d)
                x = rows["real" if d.is_float else "whole"].to_numpy()
                waiting.setdefault(int(part), []).append((rows["row_idx"].to_numpy(), x.astype(d.numpy)))
        out = []
        for part in sorted(waiting):
            at = np.concatenate([i for i, _ in waiting[part]])
            if len(at) < batch:
                break
            d = adaptive.dtype
            x = np.concatenate([v for _, v in waiting.pop(part)])[np.argsort(at)]
            data, plan = adaptive.part(x)
            out.append((column, part, d.name, len(x), x.nbytes, len(data), str(plan), plan.ratio, data))
        state.update((pickle.dumps((waiting, adaptive)),))
        yield pd.DataFrame(out, columns=[f.split()[0] for f in SEGMENTS.split(", ")])

    return values.groupBy("column").applyInPandasWithState(step, SEGMENTS, "state binary", "append", GroupStateTimeout.NoTimeout)


def plan_history(segments: DataFrame) -> DataFrame:
    """column, plan, parts, ratio: which plans were used and how well they did."""
    return segments.groupBy("column", "plan").agg(F.count("*").alias("parts"), (F.sum("raw_bytes") / F.sum("enc_bytes")).alias("ratio"))


