"""Suffix-array dedup (operator 6): difference cover, one suffix bucket at a time.

A byte goes when it is covered by a ``length``-byte string that also starts
somewhere else. The suffixes of the corpus are compared to that depth:

1. *Cover sample.* Positions whose offset modulo 133 lies in a perfect
   difference set (12 of 133) form the sample. For any two suffixes some shift
   below 133 takes both into the sample, so two equal 200-byte strings contain
   equal sample strings of 200 - 132 = 68 bytes. Sample strings are ranked by
   hash over the whole corpus; only suffixes within 132 bytes before a sample
   string that occurs again can have an equal partner. Nothing is lost.
2. *Suffix buckets.* The remaining suffixes are dealt into buckets, and one
   bucket is sorted at a time over the cluster: its suffixes are packed per
   shard, merged, and those equal to another at depth 200 come back. The number
   of buckets follows the candidates, so a pass moves at most about twice the
   input's bytes, however repetitive the corpus is.
3. Equal suffixes give removed spans, merged per document; the text is cut in
   one join.

Ties are decided by two independent window hashes (64 bits plus the bucket and
shard drawn from a second hash) instead of walking cover ranks: the depth is
bounded by the contract, so a fixed window is the whole comparison.

Bytes are UTF-8. Null counts as empty; texts shorter than the length lose
nothing. Each row is a document: rows that repeat both id and text are copies
of each other and are removed like any others. Rows without an id are handled
the same way. Extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuplespark.llm.common import blocks_for, input_mb, ship_package, stored
from tuplespark.llm.hashing import U, mix
from tuplespark.llm.sharedkeys import Shared, shared_keys

# A perfect difference set modulo 133 (every residue is one difference).
COVER, PERIOD = (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109), 133
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_BYTE = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, (2, 256), dtype=np.uint64)
PIECE = 1 << 20
#: Stands for a null id inside the tasks (pandas would turn ids with nulls into floats).
NO_ID = -(1 << 63)


def window_hashes(b: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """Hash of every window of ``length`` bytes, by doubling."""
    base, h, m = _BASES[which], _BYTE[which][b], 1
    out, done, rest = None, 0, length
    if len(b) < length:
        return np.zeros(0, np.uint64)
    while True:
        if rest & 1:
            if out is None:
                out, done = h, m
            else:
                k = len(b) - (done + m) + 1
                out = out[:k] * U(pow(base, m, 1 << 64)) + h[done:done + k]
                done += m
        rest >>= 1
        if not rest:
            return mix(out)
        k = len(b) - 2 * m + 1
        h = h[:k] * U(pow(base, m, 1 << 64)) + h[m:m + k]
        m *= 2


def pieces(raw: bytes, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """Overlapping pieces, so that long texts need no long arrays."""
    for at in range(0, max(len(raw) - length + 1, 0), PIECE):
        yield at, np.frombuffer(raw[at:at + PIECE + length - 1], np.uint8)


def _cover_mask(at: int, n: int) -> np.ndarray:
    mask = np.zeros(PERIOD, bool)
    mask[list(COVER)] = True
    return mask[(at + np.arange(n)) % PERIOD]


def _sample(raw: bytes, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the cover sample of one text."""
    pos, val = [], []
    for at, b in pieces(raw, depth):
        h = window_hashes(b, depth)
        p = np.flatnonzero(_cover_mask(at, len(h)))
        pos.append(p + at)
        val.append(h[p])
    return (np.concatenate(pos), np.concatenate(val)) if pos else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def _split(h: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    return ((h >> U(32)) % U(shards)).astype(np.int64), (h & U(0xFFFFFFFF)).astype(np.uint32)


def _sample_keys(depth: int, shards: int):
    def keys(rows: pd.DataFrame):
        return _split(np.concatenate([_sample(raw, depth)[1] for raw in rows["raw"]]), shards)
    return keys


def _regions(length: int, depth: int, shards: int):
    """Stretches of text whose suffixes are candidates."""
    def run(docs: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        out, names = [], ["block", "doc_id", "text_key", "at", "raw"]
        shared = Shared(found, "<u4")
        if not len(docs) or not shared.by:
            return pd.DataFrame(out, columns=names)
        samples = [_sample(raw, depth) for raw in docs["raw"]]
        again = shared.mask(*_split(np.concatenate([h for _, h in samples]), shards))
        parts = np.split(again, np.cumsum([len(h) for _, h in samples])[:-1])
        for block, doc, key, raw, (pos, _), mask in zip(docs["block"], docs["doc_id"], docs["text_key"], docs["raw"], samples, parts):
            n, hit = len(raw) - length + 1, pos[mask]
            if n <= 0 or not len(hit):
                continue
            # Suffixes up to PERIOD - 1 bytes before a repeated sample string; runs of overlapping reaches.
            lo, hi = np.maximum(hit - (PERIOD - 1), 0), np.minimum(hit + 1, n)
            cut = np.flatnonzero(lo[1:] > hi[:-1])
            for a, b in zip(lo[np.concatenate([[0], cut + 1])].tolist(), hi[np.concatenate([cut, [len(hit) - 1]])].tolist()):
                for s in range(a, b, PIECE):
                    e = min(s + PIECE, b)
                    out.append((block, doc, key, s, raw[s:e + length - 1]))
        return pd.DataFrame(out, columns=names)
    return run


def _suffixes(raws, length: int, bucket: int, buckets: int, shards: int):
    """Of the stretches' suffixes in the bucket: stretch, start, shard, key."""
    raws = list(raws)
    b = np.frombuffer(b"".join(raws), np.uint8)
    size = np.array([len(r) for r in raws], np.int64)
    piece = np.repeat(np.arange(len(raws)), size)[:max(len(b) - length + 1, 0)]
    at = np.arange(len(piece)) - (np.cumsum(size) - size)[piece]
    second = window_hashes(b, length, 1)
    own = np.flatnonzero((at + length <= size[piece]) & (second % U(buckets) == U(bucket)))
    return piece[own], at[own], ((second[own] >> U(24)) % U(shards)).astype(np.int64), window_hashes(b, length, 0)[own]


def _batches(rows: pd.DataFrame):
    """Slices of a block's stretches of about PIECE bytes each."""
    group = (rows["raw"].map(len).cumsum() // PIECE).to_numpy()
    for _, index in pd.Series(np.arange(len(rows))).groupby(group):
        yield rows.iloc[index.to_numpy()]


def _suffix_keys(length: int, bucket: int, buckets: int, shards: int):
    def keys(rows: pd.DataFrame):
        parts = [_suffixes(r["raw"], length, bucket, buckets, shards) for r in _batches(rows)]
        return np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts])
    return keys


def _spans(length: int, bucket: int, buckets: int, shards: int):
    def run(rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        shared, out = Shared(found, "<u8"), []
        for part in _batches(rows) if shared.by else ():
            piece, at, shard, h = _suffixes(part["raw"], length, bucket, buckets, shards)
            hit = shared.mask(shard, h)
            piece, at = piece[hit], at[hit]
            if not len(at):
                continue
            cut = np.flatnonzero((np.diff(at) > length) | (np.diff(piece) != 0))
            first, last = np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(at) - 1]])
            own, base = piece[first], part["at"].to_numpy()
            out.append(pd.DataFrame({"doc_id": part["doc_id"].to_numpy()[own], "text_key": part["text_key"].to_numpy()[own],
                                     "b": base[own] + at[first], "e": base[own] + at[last] + length}))
        return pd.concat(out) if out else pd.DataFrame({"doc_id": [], "text_key": [], "b": [], "e": []})
    return run


def _cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        kept, spans = [], []
        for raw, found in zip(part["raw"], part["spans"]):
            merged: list[list[int]] = []
            for b, e in sorted((s["b"], s["e"]) for s in (found if found is not None else [])):
                if merged and b <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], e)
                else:
                    merged.append([b, e])
            at, keep = 0, []
            for b, e in merged:
                keep.append(raw[at:b])
                at = e
            keep.append(raw[at:])
            kept.append(b"".join(keep))
            spans.append([{"b": b, "e": e} for b, e in merged])
        yield pd.DataFrame({"doc_id": part["doc_id"], "n_bytes": part["raw"].map(len), "spans": spans, "kept": kept})


def _documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(text_col).alias("text_key"),
                     F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("raw"))


def repeated_spans(df: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_key, spans`` of rows that lose bytes; spans may still
    overlap across buckets. A row is known by its id (``NO_ID`` for null) and
    its text's hash."""
    if length < PERIOD + 8:
        raise ValueError(f"the cover needs strings of at least {PERIOD + 8} bytes")
    spark = df.sparkSession
    ship_package(spark)
    n, depth = blocks_for(df), length - PERIOD + 1
    docs = _documents(df, id_col, text_col)
    block = F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id") == NO_ID, F.col("text_key"))), F.lit(n)).cast("int")
    docs = docs.withColumn("block", block).repartition(n, "block")
    found = shared_keys(docs, _sample_keys(depth, n), "<u4")
    regions = stored(docs.groupBy("block").cogroup(found.groupBy("block")).applyInPandas(
        _regions(length, depth, n), "block int, doc_id long, text_key long, at long, raw binary"), "regions")
    suffixes = regions.agg(F.sum(F.length("raw") - (length - 1))).first()[0] or 0
    buckets = max(1, -(-8 * suffixes // max(int(2e6 * input_mb(spark, df)), 64_000_000)))
    spans = None
    for bucket in range(buckets):
        rows = regions.repartition(n, "block")
        found = shared_keys(rows, _suffix_keys(length, bucket, buckets, n), "<u8")
        part = stored(rows.groupBy("block").cogroup(found.groupBy("block")).applyInPandas(
            _spans(length, bucket, buckets, n), "doc_id long, text_key long, b long, e long"), "spans")
        spans = part if spans is None else spans.unionByName(part)
    return spans.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("b", "e")).alias("spans"))


def suffix_dedup(df: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, spans, kept`` per row: merged removed byte spans and
    the remaining bytes (which may cut inside a character)."""
    spans = repeated_spans(df, length, id_col, text_col)
    met = _documents(df, id_col, text_col).join(spans, ["doc_id", "text_key"], "left").select("doc_id", "raw", "spans")
    out = met.mapInPandas(_cut, "doc_id long, n_bytes long, spans array<struct<b: bigint, e: bigint>>, kept binary")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def digest(df: DataFrame) -> DataFrame:
    """The contract's columns."""
    out = suffix_dedup(df)
    return out.select("doc_id", "n_bytes", F.expr("aggregate(spans, 0L, (n, s) -> n + s.e - s.b)").alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
