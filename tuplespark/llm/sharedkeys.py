"""Which hashed keys occur more than once in the whole corpus.

Blocks of rows pack their distinct keys per shard; a shard merges the packed
keys of all blocks and sends every block those of its keys that occur again
(in another block, or twice in the block itself). A key is one entry per block
however often the block holds it, so hot keys are aggregated before they move,
and both blocks and shards are sized from the input."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

PACKED = "shard int, block int, once binary, many binary"
SHARED = "block int, shard int, keys binary"


def packer(keys: Callable[[pd.DataFrame], tuple[np.ndarray, np.ndarray]], dtype: str):
    """Group function: packed distinct keys of a block. ``keys`` maps its rows
    to (shard, key) arrays."""
    def run(block: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        shard, key = keys(rows)
        order = np.lexsort((key, shard))
        shard, key = shard[order], key[order].astype(dtype)
        first = np.ones(len(key), bool)
        first[1:] = (key[1:] != key[:-1]) | (shard[1:] != shard[:-1])
        at = np.flatnonzero(first)
        n = np.diff(np.append(at, len(key)))
        shard, key = shard[at], key[at]
        ids, starts = np.unique(shard, return_index=True)
        ends = np.append(starts[1:], len(key))
        return pd.DataFrame({"shard": ids.astype("int32"), "block": np.full(len(ids), block[0], "int32"),
                             "once": [key[a:b][n[a:b] == 1].tobytes() for a, b in zip(starts, ends)],
                             "many": [key[a:b][n[a:b] > 1].tobytes() for a, b in zip(starts, ends)]})
    return run


def finder(dtype: str):
    """Group function: per block, the shard's keys that occur again."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        once = [np.frombuffer(b, dtype) for b in rows["once"]]
        many = [np.frombuffer(b, dtype) for b in rows["many"]]
        every = np.sort(np.concatenate(once + many + many))
        again = np.unique(every[1:][every[1:] == every[:-1]])
        out = [np.concatenate([o[member(o, again)], m]) for o, m in zip(once, many)]
        keep = [i for i, o in enumerate(out) if len(o)]
        return pd.DataFrame({"block": rows["block"].to_numpy()[keep].astype("int32"), "shard": rows["shard"].to_numpy()[keep].astype("int32"),
                             "keys": [out[i].tobytes() for i in keep]})
    return run


def member(x: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(x), bool)
    return sorted_set[np.minimum(np.searchsorted(sorted_set, x), len(sorted_set) - 1)] == x


class Shared:
    """A block's shared keys, for lookup by (shard, key)."""

    def __init__(self, rows: pd.DataFrame, dtype: str):
        self.by = {int(s): np.sort(np.frombuffer(b, dtype)) for s, b in zip(rows["shard"], rows["keys"])}
        self.dtype = dtype

    def mask(self, shard: np.ndarray, key: np.ndarray) -> np.ndarray:
        out = np.zeros(len(key), bool)
        if not self.by or not len(key):
            return out
        order = np.argsort(shard, kind="stable")
        ids, starts = np.unique(shard[order], return_index=True)
        for s, part in zip(ids.tolist(), np.split(order, starts[1:])):
            if s in self.by:
                out[part] = member(key[part].astype(self.dtype), self.by[s])
        return out


def shared_keys(blocks: DataFrame, keys: Callable[[pd.DataFrame], tuple[np.ndarray, np.ndarray]], dtype: str) -> DataFrame:
    """``block, shard, keys`` of the keys that occur again. ``blocks`` has a
    column ``block`` and is partitioned by it."""
    packed = blocks.groupBy("block").applyInPandas(packer(keys, dtype), PACKED)
    return packed.groupBy("shard").applyInPandas(finder(dtype), SHARED)
