"""Toxicity by noisy-channel deobfuscation (operator 9).

1. A character trigram model is counted over the whole texts of all documents
   (vectorised per task; at most ``A ** 3`` sums reach the driver).
2. Tokens that may be disguised (digits or symbols among letters, letters
   repeated three times and more, letters set apart by spaces or signs) become
   a lattice: each character keeps, replaces (leetspeak), drops or collapses
   at a channel cost. Viterbi decodes the likeliest letters under the model.
   Other tokens have a single path and are taken as they are. A sign before a
   word (``!``, ``|``, ``(``) or a doubled letter may be a disguise or not: both
   readings count where the decoded one differs.
3. A lexicon of words and word beginnings that are much more frequent in texts
   labelled toxic (counted as pairs of text and word) is built in Spark over all labelled rows outside the
   held-out fold. It is a table of all forms that pass the tests; workers hold
   it up to ``LEXICON_MB`` measured bytes, beyond that words are joined to it.
4. A logistic regression over a handful of lexicon measures is fitted on at
   most ``FIT_ROWS`` labelled rows (those of least hash); it gives the score.

Python tokenizes and restores texts in stretches (each distinct token once) and
returns four whole numbers a text; counts, weights and scores are Spark columns.

The fold is ``crc32(doc_id as text) mod 5``; 0 is held out and never learned
from. Labels, lang, source and ids are no inputs of a score.

Null and empty texts have no tokens and get the model's score for that. A null
doc_id counts as the empty text in the fold. Label rows with a null id or
label are left out; of several labels of one doc_id the largest counts.
Without labels of both kinds every score is 0. Repeated rows are scored each;
extra columns are read only when named in ``keep``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tuplespark.llm.common import ship_package, small, stored

#: Bound of the fitted model (a documented parameter): labelled rows of the regression.
FIT_ROWS = 20_000
#: Measured size up to which workers hold the lexicon; a larger one is joined.
LEXICON_MB = 32
FOLDS = 5

# What a disguising character may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
        "!": "i", "|": "li", "+": "t", "(": "c", "€": "e", "£": "l", "¥": "y"}
FRONT, BACK = "!|(", "|"
DECORATION = ".,;:!?…'\"“”„«»()[]{}<>*#%&|~^=-–—_/\\¿¡"
EDGE_RUN = re.compile(r"^([^\w\s])\1{2,}|([^\w\s])\2{2,}$")
ODD = re.compile(r"[^\W\d_].*[\d\W_]|[\d\W_].*[^\W\d_]|([^\W\d_])\1\1", re.S)
TRIPLE = re.compile(r"(.)\1\1", re.S)
DOUBLE = re.compile(r"(.)\1", re.S)
DOUBLE_COST = 1.5
SPACED = re.compile(r"(?<!\S)(?:[\w@$!|+][ \t._*-]{1,3}){2,}[\w@$!|+](?!\S)")
#: Holds wherever SPACED does (RE2, over whole texts).
SPACED_HINT = r"(^|[\s\pZ\x{85}\x{1c}-\x{1f}])\S[ \t._*-]{1,3}\S[ \t._*-]"

# Letter classes of the model: a-z, other letters folded into 24, and the word edge.
A, EDGE = 51, 50
_CLASS = np.array([EDGE if not chr(c).isalpha() else ord(chr(c)) - 97 if "a" <= chr(c) <= "z" else 26 + c % 24 for c in range(0x2000)], np.int32)


_CLASS_OF = _CLASS.tolist()


def letter_class(ch: str) -> int:
    c = ord(ch)
    return _CLASS_OF[c] if c < 0x2000 else 26 + c % 24 if ch.isalpha() else EDGE


def trigram_counts(texts) -> np.ndarray:
    """Counts of class trigrams over the texts, a stretch at a time."""
    total = np.zeros(A ** 3, np.int64)
    for text in texts:
        for at in range(0, len(text or ""), 1 << 20):
            c = np.frombuffer((" " + text[at:at + (1 << 20)].lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
            k = np.where(c < 0x2000, _CLASS[np.minimum(c, 0x1FFF)], 26 + (c % 24).astype(np.int32))
            k = np.concatenate([[EDGE], k])
            total += np.bincount((k[:-2] * A + k[1:-1]) * A + k[2:], minlength=A ** 3)
    return total


def language_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log probabilities ``[a, b, c]`` of class c after a, b, from all rows."""
    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(A ** 3, np.int64)
        for part in parts:
            total += trigram_counts(part["text"])
        at = np.flatnonzero(total)
        yield pd.DataFrame({"at": at.astype("int32"), "n": total[at]})

    rows = docs.select(F.col(text_col).alias("text")).mapInPandas(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(A ** 3)
    n[[r["at"] for r in rows]] = [r["n"] for r in rows]
    n = n.reshape(A, A, A)
    pair, one = n.sum(0), n.sum((0, 1))
    uni = (one + 1) / (one.sum() + A)
    bi = (pair + 5 * uni) / (pair.sum(1, keepdims=True) + 5)
    return np.log((n + 5 * bi) / (n.sum(2, keepdims=True) + 5)).astype(np.float32)


def arcs(token: str, loose: bool) -> list[list[tuple[str, float]]]:
    """The lattice of a token: per step the letters it may give ('' for none,
    ' ' for a word edge) and their channel costs. ``loose``: a doubled letter
    may be one, and a sign at the edge is a letter."""
    out: list[list[tuple[str, float]]] = []
    i = 0
    while i < len(token):
        ch = token[i]
        j = i
        while j < len(token) and token[j] == ch:
            j += 1
        run = j - i
        if ch.isspace():
            out.append([("", 0.0), (" ", 1.0)])
        elif ch.isalpha():
            out.append([(ch, 0.0)])
            if run == 2:
                out.append([(ch, 0.0), ("", DOUBLE_COST)] if loose else [(ch, 0.0)])
            elif run > 2:
                out.append([("", 0.0), (ch, 0.5)])
        else:
            to = [(c, 1.0) for c in LEET.get(ch, "")]
            drop = 12.0 if ch.isdigit() else 6.0
            for k in range(min(run, 2)):
                sure = loose and ch in FRONT and i in (0, len(token) - 1)
                out.append(to if sure else [*to, ("", drop if k == 0 else drop / 2)] if to else [("", 0.0)])
        i = j
    return out


def decode(token: str, logp: list, loose: bool | None = None) -> str:
    """Likeliest letters of a lattice: Viterbi over the last two classes.
    ``logp`` is the model as nested lists."""
    best = {(EDGE, EDGE): (0.0, "")}
    for step in arcs(token, ODD.search(token) is not None if loose is None else loose):
        nxt: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (score, text) in best.items():
            for ch, cost in step:
                if not ch:
                    key, new = (a, b), (score - cost, text)
                elif ch == " ":
                    key, new = (b, EDGE), (score - cost + logp[a][b][EDGE], text + " ")
                else:
                    c = letter_class(ch)
                    key, new = (b, c), (score - cost + logp[a][b][c], text + ch)
                if key not in nxt or new > nxt[key]:
                    nxt[key] = new
        best = nxt
    return max((score + logp[a][b][EDGE], text) for (a, b), (score, text) in best.items())[1]


def merge_doubles(word: str, logp: list) -> str:
    """A plain word with its unlikely doubled letters as one, as ``decode``
    would: what follows a pair has the same context either way."""
    out, at = "", 0
    for m in DOUBLE.finditer(word):
        i, c = m.start(), letter_class(m[1])
        a = letter_class(word[i - 1]) if i else EDGE
        d = letter_class(word[i + 2]) if i + 2 < len(word) else EDGE
        if logp[a][c][d] - DOUBLE_COST > logp[a][c][c] + logp[c][c][d]:
            out, at = out + word[at:i], i + 1
    return out + word[at:]


#: Entries of the caches that a task keeps; they bound memory only, not results.
REMEMBER = 200_000


class Restorer:
    """Restored words of tokens, remembered up to a bound."""

    def __init__(self, logp: np.ndarray, remember: int = REMEMBER):
        self.logp, self.remember, self.known = logp.tolist(), remember, {}

    def words(self, token: str) -> tuple[str, ...]:
        got = self.read(token)
        return (got,) if isinstance(got, str) else got

    def read(self, token: str) -> str | tuple[str, ...]:
        """The one word of most tokens as it is, else a tuple: millions of
        small tuples would keep the garbage collector busy."""
        got = self.known.get(token)
        if got is None:
            if len(self.known) >= self.remember:
                self.known.clear()
            got = self._words(token)
            got = self.known[token] = got[0] if len(got) == 1 else got
        return got

    def _words(self, token: str) -> tuple[str, ...]:
        core = token.strip(DECORATION)
        double = None
        if core.isalpha():
            # Among letters alone only a triple is odd, and no run of signs is left at the edges.
            double = DOUBLE.search(core)
            odd = double is not None and TRIPLE.search(core) is not None
        else:
            core = EDGE_RUN.sub("", token).strip(DECORATION)
            if not core:
                return ()
            odd = ODD.search(core) is not None
        out = (*decode(core, self.logp).split(),) if odd else (core,)
        # The other reading: signs at the edge as letters, unlikely doubles as one letter.
        other = core
        if len(token) > len(core):
            at = token.find(core)
            if at > 0 and token[at - 1] in FRONT and token[at - 2:at - 1] != token[at - 1]:
                other = token[at - 1] + other
            if token[at + len(core):at + len(core) + 1] == BACK:
                other += BACK
        if len(other) > len(core):
            out += tuple(w for w in decode(other, self.logp, True).split() if w not in out)
        elif double and not odd and (other := merge_doubles(core, self.logp)) != core:
            out += (other,)
        return out


def word_counts(texts, restorer: Restorer):
    """``(doc, word, n, words, tokens)``: how often each text has each restored
    word, as arrays sorted by text; the words; and the tokens of each text."""
    texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
    low = pc.utf8_lower(pc.fill_null(texts, ""))
    found = pc.utf8_split_whitespace(low)
    flat = found.flatten().dictionary_encode()
    # The split leaves empty pieces at the ends of a text.
    code, distinct = flat.indices.to_numpy(zero_copy_only=False), flat.dictionary.to_pylist()
    doc = np.repeat(np.arange(len(texts)), pc.list_value_length(found).to_numpy(zero_copy_only=False))
    if "" in distinct:
        real = code != distinct.index("")
        code, doc = code[real], doc[real]
    ids, extra = {}, []
    for i in np.flatnonzero(pc.match_substring_regex(low, SPACED_HINT).to_numpy(zero_copy_only=False)).tolist():
        for m in SPACED.finditer(low[i].as_py()):
            extra += [(i, ids.setdefault(w, len(ids))) for w in decode(m.group(0), restorer.logp).split() if len(w) > 1]
    per, word = np.ones(len(distinct), np.int64), []
    for c, token in enumerate(distinct):
        got = restorer.read(token)
        if isinstance(got, str):
            word.append(ids.setdefault(got, len(ids)))
        else:
            per[c] = len(got)
            word += [ids.setdefault(w, len(ids)) for w in got]
    more, size = np.array(extra, np.int64).reshape(-1, 2), max(len(ids), 1)
    at = np.append(np.repeat(doc, per[code]), more[:, 0])
    key, n = np.unique(at * size + np.append(_spread(code, per, np.array(word, np.int64)), more[:, 1]), return_counts=True)
    return key // size, key % size, n, list(ids), np.bincount(doc, minlength=len(texts))


def _spread(rows: np.ndarray, per: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The ``per[r]`` values of each row in turn; values are in row order."""
    size = per[rows]
    start = np.repeat((np.cumsum(per) - per)[rows], size)
    return values[start + np.arange(len(start)) - np.repeat(np.cumsum(size) - size, size)]


def forms(word: str) -> list[str]:
    """Lexicon forms of a word: its beginnings and, marked by a stop, itself."""
    return [word[:k] for k in (4, 5, 6, 7) if len(word) >= k] + [word + "."]


#: The same in SQL, of the column ``word``.
FORMS = "array_compact(array({}, concat(word, '.')))".format(
    ", ".join(f"CASE WHEN length(word) >= {k} THEN substring(word, 1, {k}) END" for k in (4, 5, 6, 7)))


#: Whole numbers that a text is measured by: weight of its words, words with a weight, the greatest weight, tokens.
#: Weights are in millionths, so that sums are exact in any order.
MEASURED = "total long, hits long, most long, tokens long"
UNIT = 1_000_000


class Lexicon:
    """Weights of words: the greatest of their forms'."""

    def __init__(self, weights: dict[str, int]):
        self.weights, self.starts = weights, {f[:4] for f in weights}

    def weight(self, word: str) -> int:
        if (word[:4] if len(word) > 3 else word + ".") not in self.starts:
            return 0
        return max((self.weights[f] for f in forms(word) if f in self.weights), default=0)


def measured_texts(texts, restorer: Restorer, lexicon: Lexicon) -> list[np.ndarray]:
    """The columns of ``MEASURED`` for a stretch of texts."""
    doc, word, n, words, tokens = word_counts(texts, restorer)
    weight = np.array([lexicon.weight(w) for w in words], np.int64)[word]
    doc, n, weight = (c[weight > 0] for c in (doc, n, weight))
    most = np.zeros(len(tokens), np.int64)
    np.maximum.at(most, doc, weight)
    total = np.zeros(len(tokens), np.int64)
    np.add.at(total, doc, weight * n)
    return [total, np.bincount(doc, n, len(tokens)).astype(np.int64), most, tokens]


def inputs(total, hits, most, tokens) -> list:
    """Inputs of the regression from measured columns (``chance`` is the same in Spark)."""
    total, most = total / UNIT, most / UNIT
    return [np.ones(len(total)), np.log1p(total), np.minimum(total, 12.0) / 12, np.minimum(most, 8.0) / 8, hits >= 2.0, hits >= 3.0,
            np.log1p(1000 * total / (tokens + 20)) / 5, np.log1p(tokens) / 8]


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % FOLDS == 0


class Model:
    """Trigram model, lexicon and weights. ``lexicon`` is a dict, or a table
    ``form, weight`` where it is too large to be held by each worker."""

    def __init__(self, logp: np.ndarray, lexicon: dict[str, int] | DataFrame, weights: np.ndarray | None):
        self.logp, self.lexicon, self.weights = logp, lexicon, weights


def _stretches(texts: pa.Array, rows: int = 1000, size: int = 4_000_000) -> Iterator[tuple[int, pa.Array]]:
    """The texts in stretches, with their starts, of at most ``rows`` texts and, but for a longer single text, ``size`` bytes."""
    start = total = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if i > start and (i - start >= rows or total + n > size):
            yield start, texts.slice(start, i - start)
            start, total = i, 0
        total += n
    if len(texts) > start:
        yield start, texts.slice(start)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          least_rows: int = 4, least_ratio: float = 4.0, lexicon_mb: float = LEXICON_MB) -> Model:
    """Counts and fits the model from all documents and the labelled folds."""
    spark = docs.sparkSession
    ship_package(spark)
    logp = language_model(docs, text_col)
    held = spark.sparkContext.broadcast(logp)
    marks = labels.select(F.col("doc_id").alias("id"), F.col(label_col).cast("int").alias("y")).where(
        "id IS NOT NULL AND y IS NOT NULL").where(~held_out("id")).groupBy("id").agg(F.max("y").alias("y"))
    train = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(small(marks, F.lit(12), 16), "id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(held.value)
        for batch in batches:
            toxic = batch.column("y").to_numpy() > 0
            for at, texts in _stretches(batch.column("text")):
                yield pa.RecordBatch.from_pandas(word_rows(texts, toxic[at:at + len(texts)], restorer), preserve_index=False)

    sums = [F.sum(c).alias(c) for c in ("rows0", "rows1", "uses0", "uses1")]
    by_word = train.select("y", "text").mapInArrow(count, "word string, rows0 long, rows1 long, uses0 long, uses1 long").groupBy("word").agg(*sums)
    each = by_word.select(F.explode(F.expr(f"CASE WHEN word = '' THEN array('') ELSE {FORMS} END")).alias("form"), "rows0", "rows1", "uses0", "uses1")
    counted = stored(each.groupBy("form").agg(*sums).where(f"form = '' OR rows1 >= {least_rows}"), "forms")
    totals = counted.where("form = ''").first()
    if totals is None or not totals["rows0"] or not totals["rows1"]:
        return Model(logp, {}, None)
    n0, n1 = max(totals["uses0"], 1), max(totals["uses1"], 1)
    weight = F.ln((F.col("uses1") / n1) / ((F.col("uses0") + 500) / n0))
    expected = F.col("rows0") + F.col("rows1")
    expected = expected * F.lit(totals["rows1"] / (totals["rows0"] + totals["rows1"]))
    chosen = counted.where("form <> ''").withColumn("w", weight).withColumn("z", (F.col("rows1") - expected) / F.sqrt(expected)).where(
        (F.col("w") >= math.log(least_ratio)) & (F.col("z") >= 4)).select("form", F.round(F.col("w") * UNIT).cast("long").alias("weight"))
    chosen = stored(chosen, "lexicon")
    size = chosen.agg(F.sum(F.octet_length("form") + 100)).first()[0] or 0
    model = Model(logp, {r["form"]: r["weight"] for r in chosen.collect()} if size <= lexicon_mb * 1e6 else chosen, None)

    # Only the rows up to the FIT_ROWS-th key are measured.
    keyed = train.withColumn("key", F.xxhash64("id", "text"))
    upto = keyed.select("key").orderBy("key").limit(FIT_ROWS).agg(F.max("key")).first()[0]
    picked = measured(keyed.where(F.col("key") <= F.lit(upto)), model, ["y", "key"])
    sample = picked.orderBy("key", "y").limit(FIT_ROWS).collect()
    x = np.array([[r[c] for c in ("total", "hits", "most", "tokens")] for r in sample], float).T
    y = np.array([float(r["y"] > 0) for r in sample])
    model.weights = fit(np.stack(inputs(*x), 1), y)
    return model


def word_rows(texts, toxic: np.ndarray, restorer: Restorer) -> pd.DataFrame:
    """Per word and label: texts that hold it, and its uses in thousandths
    (``1 + ln n`` for n uses in a text). The empty word holds the totals."""
    doc, word, n, words, _ = word_counts(texts, restorer)
    used = np.rint(1000 * (1 + np.log(n)))
    out = {"word": ["", *words]}
    for y, mine in ((0, ~toxic[doc]), (1, toxic[doc])):
        rows, uses = np.bincount(word[mine], minlength=len(words)), np.bincount(word[mine], used[mine], len(words)).astype(np.int64)
        out[f"rows{y}"], out[f"uses{y}"] = np.append(rows.sum(), rows), np.append(uses.sum(), uses)
    # Arrow columns are taken by place, not by name.
    return pd.DataFrame(out)[["word", "rows0", "rows1", "uses0", "uses1"]]


def measured(df: DataFrame, model: Model, cols: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``cols`` of each row and those of ``MEASURED``."""
    spark = df.sparkSession
    names = [f"c{i}" for i in range(len(cols))]
    text = names[cols.index(text_col)] if text_col in cols else "text"
    src = df.select(*[F.col(c).alias(n) for c, n in zip(cols, names)], *([] if text in names else [F.col(text_col).alias("text")]))
    whole = T.StructType.fromDDL(MEASURED)
    joined = isinstance(model.lexicon, DataFrame)
    if joined:
        src = stored(src.withColumn("row", F.monotonically_increasing_id()), "toxicity-rows")
    held = spark.sparkContext.broadcast((model.logp, {} if joined else model.lexicon))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logp, weights = held.value
        restorer, lexicon = Restorer(logp), Lexicon(weights)
        for batch in batches:
            for at, texts in _stretches(batch.column(text)):
                got = measured_texts(texts, restorer, lexicon)
                part = batch.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *map(pa.array, got)], names=[*names, *whole.names])

    named = [F.col(f"c{i}").alias(c) for i, c in enumerate(cols)]
    if not joined:
        return src.mapInArrow(run, T.StructType([*(src.schema[c] for c in names), *whole.fields])).select(*named, *whole.names)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(held.value[0])
        for batch in batches:
            row = batch.column("row").to_numpy()
            for at, texts in _stretches(batch.column(text)):
                own = row[at:at + len(texts)]
                doc, word, n, words, tokens = word_counts(texts, restorer)
                yield pa.RecordBatch.from_arrays([pa.array(own[doc]), pa.array(words, pa.string()).take(pa.array(word)), pa.array(n)], names=["row", "word", "n"])
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.nulls(len(own), pa.string()), pa.array(tokens)], names=["row", "word", "n"])

    words = stored(src.select("row", text).mapInArrow(emit, "row long, word string, n long"), "toxicity-words")
    each = words.where("word IS NOT NULL").select("row", "word", "n", F.explode(F.expr(FORMS)).alias("form"))
    best = each.join(model.lexicon, "form").groupBy("row", "word", "n").agg(F.max("weight").alias("weight"))
    sums = best.groupBy("row").agg(F.sum(F.col("weight") * F.col("n")).alias("total"), F.sum("n").alias("hits"), F.max("weight").alias("most"))
    sizes = words.where("word IS NULL").select("row", F.col("n").alias("tokens"))
    every = src.select("row", *names).join(sizes, "row").join(sums, "row", "left").fillna(0, ["total", "hits", "most"])
    return every.select(*named, *whole.names)


def chance(weights: np.ndarray | None) -> Column:
    """The score from the columns of ``MEASURED``."""
    if weights is None:
        return F.lit(0.0)
    least = lambda a, b: F.least(a, F.lit(b))
    atleast = lambda n: F.when(F.col("hits") >= n, 1.0).otherwise(0.0)
    total, most, tokens = F.col("total") / UNIT, F.col("most") / UNIT, F.col("tokens")
    x = [F.log1p(total), least(total, 12.0) / 12, least(most, 8.0) / 8, atleast(2), atleast(3),
         F.log1p(1000 * total / (tokens + 20)) / 5, F.log1p(tokens.cast("double")) / 8]
    z = F.lit(float(weights[0]))
    for w, c in zip(weights[1:], x, strict=True):
        z = z + F.lit(float(w)) * c
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row (and, with ``keep``, those columns as ``carried``)."""
    keep = keep or []
    # The text is read once, whether it is kept or not.
    passed = [id_col, *keep, *([] if text_col in keep else [text_col])]
    names = [f"p{i}" for i in range(len(passed))]
    src = docs.select(*[F.col(c).alias(n) for c, n in zip(passed, names)])
    text = names[1 + keep.index(text_col)] if text_col in keep else names[-1]
    out = measured(src, model, names[:1 + len(keep)], text).withColumn("score", chance(model.weights))
    carried = [F.struct(*[F.col(n).alias(c) for n, c in zip(names[1:], keep)]).alias("carried")] if keep else []
    out = out.select(F.col("p0").alias("doc_id"), *carried, "score")
    return out.withColumn("held_out", held_out("doc_id")).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of the rows that the model does not reject."""
    return score(docs, learn(docs, labels), keep=keep).where("predicted = 0").select("carried.*")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns."""
    return score(docs, learn(docs, labels)).select("doc_id", "held_out", "score", "predicted")
