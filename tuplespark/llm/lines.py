"""Line dedup (operator 8): sharded minimal perfect hash of line keys.

Plan, in four Spark steps with one shuffle of the texts:

1. Rows are dealt into hash blocks by ``doc_id`` (block count grows with the
   input). A block task hashes every line key to 128 bits and packs, per
   shard, its distinct keys with their document count and largest doc_id. So a
   line that a third of all documents hold is one entry per block.
2. Each shard builds its index over the distinct keys it received: a minimal
   perfect hash (levels of collision-free bits, rank by running count) that
   addresses compact arrays: 16-bit fingerprint, document count, largest id.
3. In the same shard task the packed block keys probe these arrays; keys found
   in enough documents go back to their block as packed (key, largest id).
4. Block tasks drop the lines. The exchange of step 1 is used again, so texts
   move once; nothing is joined line by line.

A line's key is the line without white space ``[\\x20\\x09-\\x0D]`` at both
ends, A-Z lower-cased. Keys of at least ``min_chars`` code points held by at
least ``min_docs`` documents lose all their lines except in the largest doc_id
holding them (there all repeats stay). The hash is 128 bits wide, so keys meet
by chance with a probability of about 1e-18 for 10^10 lines.

Null or empty text: one empty line, never dropped; a null text comes back as
an empty one. Rows that repeat a doc_id count as one document and are each
rewritten. Each row without a doc_id counts as a document of its own, smaller
than every other; a key that only such rows hold stays in all of them. Empty
table: no rows. Only the id and the text are
read; ``line_dedup`` joins nothing back, so other columns travel unread.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tuplespark.llm.common import SPACE_BYTES, blocks_for, ship_package

NO_ID = -(1 << 63)
KEY = np.dtype([("hi", "<u8"), ("lo", "<u8"), ("n", "<u4"), ("top", "<i8")])
DROP = np.dtype([("hi", "<u8"), ("lo", "<u8"), ("top", "<i8")])
SHARD_SCHEMA = "shard int, block int, keys binary"
DROP_SCHEMA = "block int, drops binary"


def line_keys(text: str | None, min_chars: int) -> list[int]:
    """128-bit key of each line; 0 for lines whose key is too short to count."""
    out = []
    for line in (text or "").split("\n"):
        raw = line.encode("utf-8", "surrogatepass").strip(SPACE_BYTES)
        if len(raw) < min_chars or (len(raw) < 4 * min_chars and len(raw.decode("utf-8", "surrogatepass")) < min_chars):
            out.append(0)
        else:
            out.append(xxhash.xxh3_128_intdigest(raw.lower()) | 1)
    return out


def _mix(lo: np.ndarray, hi: np.ndarray, level: int) -> np.ndarray:
    """One hash per level from the two halves of the key."""
    x = lo ^ (hi * np.uint64(0x9E3779B97F4A7C15 + 2 * level * 0x632BE59BD9B4E019 & (1 << 64) - 1))
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class PerfectHash:
    """Minimal perfect hash of distinct 128-bit keys: a key gets the rank of
    the first level bit that it alone holds; ranks run over all levels."""

    def __init__(self, hi: np.ndarray, lo: np.ndarray, gamma: float = 2.0):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        base, left = 0, np.arange(len(lo))
        while len(left):
            size = int(gamma * len(left)) + 1
            at = _mix(lo[left], hi[left], len(self.levels)) % np.uint64(size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            rank = (base + np.cumsum(alone) - 1).astype(np.int64)
            self.levels.append((alone, rank))
            base += int(alone.sum())
            left = left[~alone[at.astype(np.int64)]]
        self.size = base

    def index(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        out, left = np.full(len(lo), -1, np.int64), np.arange(len(lo))
        for level, (alone, rank) in enumerate(self.levels):
            at = (_mix(lo[left], hi[left], level) % np.uint64(len(alone))).astype(np.int64)
            found = alone[at]
            out[left[found]] = rank[at[found]]
            left = left[~found]
        return out


class LineIndex:
    """The shard's arrays behind its perfect hash."""

    def __init__(self, entries: np.ndarray):
        order = np.lexsort((entries["lo"], entries["hi"]))
        e = entries[order]
        first = np.ones(len(e), bool)
        first[1:] = (e["hi"][1:] != e["hi"][:-1]) | (e["lo"][1:] != e["lo"][:-1])
        starts = np.flatnonzero(first)
        self.hash = PerfectHash(e["hi"][starts], e["lo"][starts])
        at = self.hash.index(e["hi"][starts], e["lo"][starts])
        self.fingerprint = np.zeros(self.hash.size, np.uint16)
        self.count = np.zeros(self.hash.size, np.int64)
        self.top = np.zeros(self.hash.size, np.int64)
        self.fingerprint[at] = (e["hi"][starts] >> np.uint64(48)).astype(np.uint16)
        self.count[at] = np.add.reduceat(e["n"].astype(np.int64), starts)
        self.top[at] = np.maximum.reduceat(e["top"], starts)

    def probe(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document count (0 where the fingerprint differs) and largest id."""
        at = self.hash.index(hi, lo)
        known = (at >= 0) & (self.fingerprint[at] == (hi >> np.uint64(48)).astype(np.uint16))
        return np.where(known, self.count[at], 0), self.top[at]


def _collector(shards: int, min_chars: int):
    def collect(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        held: dict[int, list[int]] = {}
        seen: set[tuple[int, int]] = set()
        repeated = rows["doc_id"].duplicated(keep=False) & (rows["doc_id"] != NO_ID)
        for doc, again, text in zip(rows["doc_id"], repeated, rows["text"]):
            for k in set(line_keys(text, min_chars)):
                if not k or again and (doc, k) in seen:
                    continue
                if again:
                    seen.add((doc, k))
                e = held.get(k)
                if e is None:
                    held[k] = [1, doc]
                else:
                    e[0] += 1
                    e[1] = max(e[1], doc)
        keys = np.zeros(len(held), KEY)
        if held:
            keys["hi"] = [k >> 64 for k in held]
            keys["lo"] = [k & (1 << 64) - 1 for k in held]
            keys["n"] = [e[0] for e in held.values()]
            keys["top"] = [e[1] for e in held.values()]
        shard = (keys["hi"] % np.uint64(shards)).astype(np.int64)
        keys, shard = keys[order := np.argsort(shard, kind="stable")], shard[order]
        ids, starts = np.unique(shard, return_index=True)
        parts = np.split(keys, starts[1:]) if len(ids) else []
        return pd.DataFrame({"shard": ids.astype("int32"), "block": np.full(len(ids), key[0], "int32"),
                             "keys": [p.tobytes() for p in parts]})
    return collect


def _prober(min_docs: int):
    def probe(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(b, KEY) for b in rows["keys"]]
        index = LineIndex(np.concatenate(parts))
        blocks, drops = [], []
        for block, p in zip(rows["block"], parts):
            count, top = index.probe(p["hi"], p["lo"])
            hit = count >= min_docs
            if hit.any():
                d = np.zeros(int(hit.sum()), DROP)
                d["hi"], d["lo"], d["top"] = p["hi"][hit], p["lo"][hit], top[hit]
                blocks.append(block)
                drops.append(d.tobytes())
        return pd.DataFrame({"block": np.array(blocks, "int32"), "drops": drops})
    return probe


def _rewriter(min_chars: int, columns: list[str]):
    def rewrite(docs: pd.DataFrame, drops: pd.DataFrame) -> pd.DataFrame:
        top: dict[int, int] = {}
        for b in drops["drops"]:
            d = np.frombuffer(b, DROP)
            top.update(((h << 64) | l, t) for h, l, t in zip(d["hi"].tolist(), d["lo"].tolist(), d["top"].tolist()))
        texts, n_lines, n_dropped = [], [], []
        for doc, text in zip(docs["doc_id"], docs["text"]):
            lines = (text or "").split("\n")
            kept = lines
            if top:
                kept = [x for x, k in zip(lines, line_keys(text, min_chars)) if not k or top.get(k, doc) == doc]
            texts.append("\n".join(kept))
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(kept))
        return docs[columns].assign(kept_text=texts, n_lines=n_lines, n_dropped=n_dropped)
    return rewrite


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20,
               min_docs: int = 3, keep: list[str] | None = None) -> DataFrame:
    """One row per input row: the id, the columns named in ``keep``, and
    ``kept_text, n_lines, n_dropped``."""
    ship_package(df.sparkSession)
    n = blocks_for(df)
    extra = [c for c in (keep or []) if c not in (id_col, text_col)]
    carried = [F.struct(*[F.col(c) for c in extra]).alias("extra")] if extra else []
    docs = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(text_col).alias("text"), *carried)
    salt = F.when(F.col("doc_id") == NO_ID, F.xxhash64("text")).otherwise(F.lit(0))
    block = F.pmod(F.xxhash64("doc_id", salt), F.lit(n)).cast("int")
    docs = docs.withColumn("block", block).repartition(n, "block")
    keys = docs.groupBy("block").applyInPandas(_collector(n, min_chars), SHARD_SCHEMA)
    drops = keys.groupBy("shard").applyInPandas(_prober(min_docs), DROP_SCHEMA)
    passed = ["doc_id", "extra"] if extra else ["doc_id"]
    out = T.StructType([*(docs.schema[c] for c in passed), T.StructField("kept_text", T.StringType()),
                        T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    done = docs.groupBy("block").cogroup(drops.groupBy("block")).applyInPandas(_rewriter(min_chars, passed), out)
    return done.select(F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias(id_col),
                       *[F.col("extra").getField(c).alias(c) for c in extra], "kept_text", "n_lines", "n_dropped")


def digest(df: DataFrame) -> DataFrame:
    """The contract's columns."""
    return line_dedup(df).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
