"""Column expressions over words and tuples.

All functions take and return ``Column`` objects and stay inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tuplespark import constants as K

WHITESPACE = r"(?U)\s+"


def strip_spaces(c: Column) -> Column:
    """Remove leading/trailing ASCII spaces only (tabs and NBSP stay)."""
    return F.trim(c)


def words(c: Column) -> Column:
    """Split on any run of whitespace, dropping empty pieces."""
    return F.filter(F.split(c, WHITESPACE, -1), lambda x: x != "")


def overlap(a: Column, b: Column) -> Column:
    """SCO-1: size of the multiset intersection of two word arrays."""
    return F.aggregate(
        F.array_distinct(a), F.lit(0),
        lambda acc, w: acc + F.least(F.size(F.filter(a, lambda x: x == w)),
                                     F.size(F.filter(b, lambda x: x == w))))


def pred_text(t: Column) -> Column:
    """``auxi ### ... ### pred`` (R1)."""
    return F.array_join(F.concat(t["auxi"], F.array(t["pred"])), K.INNER_SEP)


def obj_text(o: Column) -> Column:
    return F.when(F.length(o["prep"]) == 0, o["obj"]).otherwise(
        F.concat(o["prep"], F.lit(K.INNER_SEP), o["obj"]))


def linearize(t: Column, style: str = "subj_first") -> Column:
    """PRJ-4 / PRJ-5: one tuple as text.

    ``subj_first``: ``subj ,, [auxi ### ]pred ,, [prep ### ]obj ...``
    ``pred_first``: ``[auxi ### ]pred ;; subj ;; [prep ### ]obj ...``
    """
    objs = F.transform(t["objs"], obj_text)
    if style == "subj_first":
        return F.array_join(F.concat(F.array(t["subj"], pred_text(t)), objs), K.PART_SEP)
    if style == "pred_first":
        return F.array_join(F.concat(F.array(pred_text(t), t["subj"]), objs), K.PRED_FIRST_SEP)
    raise ValueError(f"unknown style {style}")


def render_target(triples: Column) -> Column:
    """PRJ-6: tuples joined by newline, ``n. `` prefix from the second on."""
    lines = F.transform(triples, lambda t: linearize(t))
    return F.coalesce(F.array_join(F.transform(
        lines, lambda x, i: F.when(i == 0, x).otherwise(
            F.concat((i + 1).cast("string"), F.lit(". "), x))), "\n"), F.lit(""))


def render_plain(t: Column) -> Column:
    """PRJ-10: ``subj [auxi ]pred prep obj ...`` with double spaces kept, then
    stripped of outer spaces (E6)."""
    aux = F.when(F.size(t["auxi"]) > 0, F.concat(F.array_join(t["auxi"], " "), F.lit(" "))).otherwise(F.lit(""))
    objs = F.array_join(F.transform(t["objs"], lambda o: F.concat(o["prep"], F.lit(" "), o["obj"])), " ")
    return strip_spaces(F.concat(t["subj"], F.lit(" "), aux, t["pred"], F.lit(" "), objs))


def objs_to_pairs(objs: Column) -> Column:
    """struct objects -> the on-disk ``[prep, obj]`` arrays."""
    return F.transform(objs, lambda o: F.array(o["prep"], o["obj"]))


def pairs_to_objs(pairs: Column) -> Column:
    """on-disk ``[prep, obj]`` arrays -> struct objects."""
    return F.transform(pairs, lambda p: F.struct(F.get(p, 0).alias("prep"), F.get(p, 1).alias("obj")))


def tuple_from_disk(t: Column) -> Column:
    return F.struct(t["subj"].alias("subj"), t["pred"].alias("pred"), t["auxi"].alias("auxi"),
                    pairs_to_objs(t["objs"]).alias("objs"))


def tuple_to_disk(t: Column) -> Column:
    return F.struct(t["pred"].alias("pred"), t["subj"].alias("subj"),
                    objs_to_pairs(t["objs"]).alias("objs"), t["auxi"].alias("auxi"))
