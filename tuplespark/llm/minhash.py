"""MinHash near-dedup (operator 2).

1. One pass over the whole texts gives each row its distinct shingle set's
   size, a 128-bit key of the set, ``bands`` band hashes over ``bands * rows``
   universal hash minima, and the low four bits of each minimum (the signature).
2. Rows with equal sets form a class; its least doc_id stands for it. Copies
   never enter the pair search.
3. Class representatives meet in band buckets. Of each one that shares a
   bucket, the shingles that no other one holds are counted (one aggregation
   over shingles). Those cannot be common to any pair, so with ``c`` common
   shingles of ``n`` the similarity of u and v is at most
   ``m / (n_u + n_v - m)``, m the smaller c. Texts that fall below the
   threshold by themselves leave; pairs that do are never made. The bound is
   exact: it loses no link.
4. A round picks centres in every bucket that still holds several components
   (1, 4, 16, .. per bucket, those with the largest common share first) and
   tests them against the bucket's members of *other* components only: bound,
   signature estimate, then exact similarity on the full sets. Verified links
   go through alternating large-star/small-star. A centre has been tested
   against its whole bucket and leaves it; a bucket is finished when its
   remaining members are in one component. So every pair that shares a bucket
   is in one component, ruled out by the bound, or was compared: nothing is
   capped. A group of thousands of edited copies costs a few pairs per member.
5. After the first round the bound of 3 is sharpened for the texts that are left
   (``_sharper``). With their shingles ordered from rare to frequent, a pair has
   at most as many in common as either text holds from the first common one on.
   Pairs whose first common shingle is rare meet there, under that bound, in
   whatever bucket they are; for the others only frequent shingles can be
   common, and these alone count in the next rounds, where a member takes part
   as long as its bucket has one of another component within the bound
   (``_in_reach``). Both ways together lose no link.
6. The component's least doc_id is its id; the document carrying it stays.

With 28 bands of 5 rows a pair at 85 % similarity shares no bucket with a
probability of 8e-8, and its signature falls below the estimate's margin (five
standard deviations) with about 3e-7 (a binomial tail somewhat above it).

Words are runs of ``[^\\x20\\x09-\\x0D]``, A-Z lower-cased. A text with fewer
words than a shingle has its whole sequence as one shingle; texts without
words (null, empty, blank) have an empty set and are linked with nothing.
Rows that share a doc_id are one document: they share a component, and all
stay or go together. Rows without a doc_id are linked with nothing and stay;
their component is null. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tuplespark.llm.common import ship_package, small, stored
from tuplespark.llm.components import components
from tuplespark.llm.hashing import U, mix, shingle_hashes, word_hashes

#: Shingles held by more of the texts that are left are frequent (fewer where the rare ones would make too many rows).
MOST_RARE = 256
SIGNED = "id struct<doc_id: bigint>, n_shingles long, set_key binary, bands array<long>, sig array<long>"


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes of the whole text."""
    return np.unique(shingle_hashes(word_hashes(text), k))


def minima(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least value of each universal hash ``a * x + b`` (high 32 bits) over
    each of the non-empty sets: one row a set. A function runs over 16,384
    members of consecutive sets at a time, whatever their number and lengths."""
    flat, ends = np.concatenate(sets), np.cumsum([len(s) for s in sets])
    starts = np.concatenate([[0], ends[:-1]])
    out = np.zeros((len(a), len(sets)), np.uint64)
    for at in range(0, len(flat), 16384):
        part = flat[at:at + 16384]
        lo, hi = np.searchsorted(ends, at, "right"), np.searchsorted(starts, at + len(part))
        cuts = np.maximum(starts[lo:hi] - at, 0)
        for j in range(len(a)):
            np.maximum(out[j, lo:hi], np.maximum.reduceat(part * a[j] + b[j], cuts), out=out[j, lo:hi])
    return (out >> U(32)).astype(np.uint32).T ^ np.uint32(0xFFFFFFFF)


def signatures(m: np.ndarray) -> np.ndarray:
    """The low four bits of each minimum, sixteen to a long; places without a minimum are 0."""
    wide = np.zeros((len(m), -(-m.shape[1] // 16) * 16), np.uint64)
    wide[:, :m.shape[1]] = m & np.uint32(15)
    return (wide.reshape(len(m), -1, 16) << (U(4) * np.arange(16, dtype=np.uint64))).sum(2, dtype=np.uint64).view(np.int64)


def differing(x: str, y: str, total: int):
    """Column: number of minima whose four bits differ between the signatures ``x`` and ``y``."""
    def one(i: int) -> str:
        d = f"({x}[{i}] ^ {y}[{i}])"
        return f"bit_count(({d} | shiftright({d}, 1) | shiftright({d}, 2) | shiftright({d}, 3)) & 1229782938247303441L)"
    return F.expr(" + ".join(one(i) for i in range(-(-total // 16))))


def _family(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(1))
    return rng.integers(1, 1 << 63, n, dtype=np.uint64) * U(2) + U(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def _signer(k: int, bands: int, rows: int, members: int = 1 << 18):
    """Signs the texts of a batch in stretches of some ``members`` shingles."""
    def stretch(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> list[tuple]:
        m = minima(sets, a, b)
        grid = m.reshape(len(sets), bands, rows).astype(np.uint64)
        band = np.tile(np.arange(bands, dtype=np.uint64), (len(sets), 1))
        for j in range(rows):
            band = mix(band * U(0x9FB21C651E98DF25) + grid[:, :, j])
        sig = signatures(m)
        return [(len(s), xxhash.xxh3_128_digest(s.tobytes()), band[i].view(np.int64), sig[i]) for i, s in enumerate(sets)]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = _family(bands * rows)
        for part in parts:
            out: list[tuple] = [(0, b"", np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(part)
            held, places, size = [], [], 0
            for i, text in enumerate(part["text"]):
                s = shingle_set(text, k)
                if len(s):
                    held.append(s)
                    places.append(i)
                    size += len(s)
                if held and (size >= members or i + 1 == len(part)):
                    for at, row in zip(places, stretch(held, a, b)):
                        out[at] = row
                    held, places, size = [], [], 0
            yield pd.DataFrame({"id": part["id"], "n_shingles": [o[0] for o in out], "set_key": [o[1] for o in out],
                                "bands": [o[2] for o in out], "sig": [o[3] for o in out]})
    return run


def _shingles(k: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"rep": part["rep"], "shingles": [shingle_set(t, k).view(np.int64) for t in part["text"]]})
    return run


def _verifier(k: int, percent: int, members: int = 2_000_000):
    """Confirms pairs on full sets. A text that meets many others is cut into
    shingles once; sets of at most ``members`` shingles are remembered."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, np.ndarray] = {}
        size = 0

        def shingles(text: str) -> np.ndarray:
            nonlocal size
            got = known.get(text)
            if got is None:
                got = shingle_set(text, k)
                if size + len(got) > members:
                    known.clear()
                    size = 0
                known[text] = got
                size += len(got)
            return got

        for part in parts:
            keep = []
            for u, v, ta, tb in zip(part["u"], part["v"], part["text_u"], part["text_v"]):
                x, y = shingles(ta), shingles(tb)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append((u, v))
            yield pd.DataFrame(keep, columns=["u", "v"], dtype="int64")
    return run


def sign(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, bands: int = 28, rows: int = 5) -> DataFrame:
    """Set size, set key, band hashes and signature of every row."""
    ship_package(df.sparkSession)
    # The id travels in a struct: pandas would turn a column of ids with nulls into floats.
    src = df.select(F.struct(F.col(id_col).cast("long").alias("doc_id")).alias("id"), F.col(text_col).alias("text"))
    return src.mapInPandas(_signer(k, bands, rows), SIGNED).select("id.doc_id", "n_shingles", "set_key", "bands", "sig")


def _meeting(reps: DataFrame) -> DataFrame:
    """A row ``band, key`` and the other columns for each bucket that holds several of ``reps``."""
    entries = reps.select(*[c for c in reps.columns if c != "bands"], F.posexplode("bands").alias("band", "key"))
    shared = entries.groupBy("band", "key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi")
    return entries.join(shared.select("band", "key"), ["band", "key"])


def _sharper(left: DataFrame, texts: DataFrame, one_set: DataFrame, k: int, percent: int, total: int,
             most_differing: int) -> tuple[DataFrame, DataFrame]:
    """``(u, v)``: pairs of the representatives in ``left`` whose first common shingle, from rare to
    frequent, is rare and leaves the threshold in reach. And ``(rep, n_hot)``: the number of frequent
    shingles, all that can be common to any other pair. The limit between rare and frequent lies
    where the rare ones still make fewer rows than the texts have shingles. Representatives with
    several sets are held to no bound and get no ``n_hot``."""
    asked = left.select("rep", "root", "n_shingles", "sig").distinct().join(one_set, "rep", "left_semi")
    held = texts.join(left.select("rep").distinct(), "rep", "left_semi").select("rep", "text").mapInPandas(
        _shingles(k), "rep long, shingles array<long>")
    held = stored(held.select("rep", F.explode("shingles").alias("shingle")).distinct(), "left-shingles")
    often = stored(held.groupBy("shingle").agg(F.count(F.lit(1)).alias("n_reps")).where("n_reps > 1"), "left-often")
    # The n-th from the most frequent one back: so many are held from this shingle on.
    back = F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("n_reps"), F.desc("shingle")))
    first = held.join(often, "shingle").withColumn("most", back).join(asked, "rep", "left").where(
        F.coalesce(100 * F.col("most") >= percent * F.col("n_shingles"), F.lit(True)))
    first = stored(first.where(F.col("n_reps") <= MOST_RARE), "left-first")
    per = first.groupBy("shingle", "n_reps").agg(F.count(F.lit(1)).alias("n"))
    step = F.ceil(F.log2("n_reps")).cast("int")
    rows = per.groupBy(step.alias("step")).agg(F.sum(F.expr("n * (n - 1) div 2")).alias("rows")).orderBy("step").collect()
    rare, made, most = 1, 0, held.count()
    for r in rows:
        made += r["rows"]
        if made > most:
            break
        rare = 2 ** r["step"]
    first = first.where(F.col("n_reps") <= rare)
    side = lambda c: first.select("shingle", *[F.col(x).alias(f"{c}_{x}") for x in ("rep", "root", "n_shingles", "sig", "most")])
    both = F.least("u_most", "v_most")
    near = (100 * both >= percent * (F.col("u_n_shingles") + F.col("v_n_shingles") - both)) & (F.col("u_root") != F.col("v_root")) & (
        differing("u_sig", "v_sig", total) <= most_differing)
    pairs = side("u").join(side("v"), "shingle").where((F.col("u_rep") < F.col("v_rep")) & F.coalesce(near, F.lit(True)))
    hot = held.join(often.where(F.col("n_reps") > rare), "shingle").groupBy("rep").agg(F.count(F.lit(1)).alias("n_hot"))
    hot = asked.select("rep").join(hot, "rep", "left").select("rep", F.coalesce("n_hot", F.lit(0)).alias("n_hot"))
    return pairs.select(F.col("u_rep").alias("u"), F.col("v_rep").alias("v")).distinct(), hot


def _in_reach(labelled: DataFrame, percent: int) -> DataFrame:
    """The rows of bucket members that could meet a member of another component under the bound: one
    not too large for the common shingles of the row, and one whose own allow the size of the row."""
    reach = (100 + percent) * F.col("n_common") - percent * F.col("n_shingles")
    per = labelled.groupBy("band", "key", "root").agg(F.min("n_shingles").alias("least"), F.max(reach).alias("far"))
    one = per.groupBy("band", "key").agg(F.min("least").alias("least_1"), F.min_by("root", "least").alias("least_root"),
                                         F.max("far").alias("far_1"), F.max_by("root", "far").alias("far_root"))
    # Of the best component itself, the others' best counts.
    two = per.join(one, ["band", "key"]).groupBy("band", "key", *one.columns[2:]).agg(
        F.min(F.when(F.col("root") != F.col("least_root"), F.col("least"))).alias("least_2"),
        F.max(F.when(F.col("root") != F.col("far_root"), F.col("far"))).alias("far_2"))
    least, far = (F.when(F.col("root") == F.col(f"{c}_root"), F.col(f"{c}_2")).otherwise(F.col(f"{c}_1")) for c in ("least", "far"))
    return labelled.join(two, ["band", "key"]).where((percent * least <= reach) & (percent * F.col("n_shingles") <= far)).select(
        labelled.columns)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80,
                    bands: int = 28, rows: int = 5) -> DataFrame:
    """``doc_id, n_shingles, class_id, component_id, kept, n_links`` per row.

    ``class_id`` is the least doc_id with the same shingle set; ``n_links``
    counts the verified links found at the class's representative."""
    spark = df.sparkSession
    signed = stored(sign(df, id_col, text_col, k, bands, rows), "signed")
    linked = "doc_id IS NOT NULL AND n_shingles > 0"
    classes = stored(signed.where(linked).groupBy("set_key").agg(
        F.min("doc_id").alias("class_id"), F.max_by(F.struct("bands", "sig", "n_shingles"), F.lit(0)).alias("one")), "classes")
    reps = classes.select(F.col("class_id").alias("rep"), "set_key", "one.*")
    wanted = stored(_meeting(reps.select("rep", "set_key", "bands")).select("rep", "set_key").distinct(), "wanted")
    # Ids of a measured size are broadcast, so that the texts nobody asks for are not shuffled.
    texts = stored(df.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text")).join(
        small(wanted.select("rep").distinct(), F.lit(8), 64), "rep", "left_semi"), "texts")
    shingles = texts.select("rep", "text").mapInPandas(_shingles(k), "rep long, shingles array<long>")
    alone = shingles.select("rep", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(
        F.min("rep").alias("rep"), F.max("rep").alias("hi")).where("rep = hi").groupBy("rep").agg(F.count(F.lit(1)).alias("n_alone"))
    # A doc_id with several sets counts all its shingles as common, so that the bound holds for each of them.
    one_set = reps.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("rep")
    live = reps.join(wanted.select("set_key"), "set_key", "left_semi").join(alone.join(one_set, "rep", "left_semi"), "rep", "left")
    live = live.withColumn("n_common", F.col("n_shingles") - F.coalesce("n_alone", F.lit(0))).where(
        100 * F.col("n_common") >= percent * F.col("n_shingles"))
    members = stored(_meeting(live.select("rep", "n_shingles", "n_common", "sig", "bands")), "members")

    links = spark.createDataFrame([], "u long, v long")
    # Rows that share a doc_id are one document: their classes are linked through it.
    several = signed.where(linked).groupBy("doc_id").agg(F.count_distinct("set_key").alias("n")).where("n > 1").select("doc_id")
    same = signed.where(linked).join(several, "doc_id").select("doc_id", "set_key").join(classes.select("set_key", "class_id"), "set_key")
    links = stored(same.select(F.col("doc_id").alias("u"), F.col("class_id").alias("v")).where("u <> v").distinct(), "links")
    labels = components(links)

    total = bands * rows
    # Four bits agree by chance in one case of sixteen.
    agree = (15 * percent / 100 + 1) / 16
    most_differing = int(total * (1 - agree + 5 * (agree * (1 - agree) / total) ** 0.5)) + 1
    side = lambda c: texts.select(F.col("rep").alias(c), F.col("text").alias(f"text_{c}"))
    found, n_centres, sharp = [links], 1, False

    def confirm(pairs: DataFrame) -> DataFrame:
        """``labels`` with the links among ``pairs``, which go to ``found``."""
        checked = pairs.join(side("u"), "u").join(side("v"), "v").mapInPandas(_verifier(k, percent), "u long, v long")
        fresh = stored(checked.distinct(), "links")
        if fresh.isEmpty():
            return labels
        found.append(fresh)
        return components(labels.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(fresh))

    while True:
        labelled = members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn(
            "root", F.coalesce("root", "rep"))
        if sharp:
            left = stored(_in_reach(labelled, percent), "left")
        else:
            unresolved = labelled.groupBy("band", "key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
            left = stored(labelled.join(unresolved.select("band", "key"), ["band", "key"]), "left")
        if left.isEmpty():
            break
        if n_centres > 1 and not sharp:
            pairs, hot = _sharper(left, texts, one_set, k, percent, total, most_differing)
            labels, sharp = confirm(pairs), True
            members = stored(left.join(hot, "rep", "left").withColumn("n_common", F.coalesce("n_hot", "n_shingles")).where(
                100 * F.col("n_common") >= percent * F.col("n_shingles")).select(members.columns), "members")
            continue
        spread = F.pmod(F.xxhash64("rep", F.lit(n_centres)), F.lit(n_centres))
        # The same order in every bucket, so that a group's buckets agree on their centres.
        first = F.struct(F.col("n_common") / F.col("n_shingles"), F.xxhash64("rep"))
        centres = left.groupBy("band", "key", spread.alias("part")).agg(
            F.max_by(F.struct("rep", "root", "n_shingles", "n_common", "sig"), first).alias("c"))
        centres = stored(centres.select("band", "key", F.col("c.rep").alias("c_rep"), F.col("c.root").alias("c_root"),
                                        F.col("c.n_shingles").alias("c_n"), F.col("c.n_common").alias("c_common"), F.col("c.sig").alias("c_sig")), "centres")
        both = F.least("n_common", "c_common")
        near = (100 * both >= percent * (F.col("n_shingles") + F.col("c_n") - both)) & (F.col("root") != F.col("c_root")) & (
            differing("sig", "c_sig", total) <= most_differing)
        pairs = left.join(centres, ["band", "key"]).where(near).select(
            F.least("rep", "c_rep").alias("u"), F.greatest("rep", "c_rep").alias("v")).distinct()
        labels = confirm(pairs)
        members = left.join(centres.select("band", "key", F.col("c_rep").alias("rep")), ["band", "key", "rep"], "left_anti").select(
            "band", "key", "rep", "n_shingles", "n_common", "sig")
        n_centres *= 4

    links = reduce(DataFrame.unionByName, found).distinct()
    degree = links.select(F.explode(F.array("u", "v")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("n_links"))
    named = classes.select("set_key", "class_id").join(labels.withColumnRenamed("node", "class_id"), "class_id", "left").join(
        degree, "class_id", "left").select("set_key", "class_id", F.coalesce("root", "class_id").alias("root"), "n_links")
    key = F.when(F.expr(linked), F.col("set_key"))
    out = signed.select("doc_id", "n_shingles", key.alias("set_key")).join(named, "set_key", "left")
    component = F.coalesce("root", "doc_id")
    return out.select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
                      F.coalesce("n_links", F.lit(0)).alias("n_links"))


def digest(df: DataFrame) -> DataFrame:
    """The contract's columns: 3-word shingles, 85 %."""
    return near_duplicates(df, k=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept", "class_id")
