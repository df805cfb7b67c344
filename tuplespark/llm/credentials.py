"""Secret scan (operator 12).

1. One Aho-Corasick automaton over the keywords of every detector walks the
   text, letters A-Z folded. Nothing else looks at text without a hit. Hex
   keys have no keyword; they are looked for at every ``HEX_STEP``-th byte,
   which a long enough run of hex digits cannot miss.
2. Only at a hit, the detector's regular expression is matched, anchored there.
3. Tokens with an embedded checksum (the last six characters are the base-62
   CRC-32 of the random part) count only if it holds.

Kinds ``assign``, ``access`` and ``hex`` are leftmost and non-overlapping per
kind: a match that is too short is dropped, but its characters are used up.
Kinds with a checksum are judged at every hit for itself. Spans are whole
matches in code points, end exclusive. Documents are independent: nothing is
shuffled, and a lost executor repeats its own tasks.

Nulls and edge cases: a null or empty text has no findings. Null and repeated
ids stay rows of their own. Only ``doc_id`` and ``text`` are read, so other
columns may have any name. An empty table gives an empty result. Texts of any
length are scanned whole, in linear time.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuplespark.llm.common import ship_package


def checksum_holds(token: str) -> bool:
    """The last six characters are the CRC-32 of those between the prefix and them, in base 62."""
    body, check = token.split("_", 1)[1][:-6], token[-6:]
    value = 0
    for c in check:
        value = value * 62 + BASE62.index(c)
    return value == zlib.crc32(body.encode())


@dataclass(frozen=True)
class Detector:
    """``pattern`` is matched where a keyword starts; ``least`` counts the
    characters of the last group, or of the match if there is none."""
    kind: str
    keywords: tuple[str, ...]
    pattern: re.Pattern
    least: int = 0
    valid: Callable[[str], bool] | None = None


BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

# The contract's patterns, then the public formats of tokens with a checksum.
DETECTORS = [
    Detector("assign", ("password", "passwd", "secret", "token", "apikey", "api_key"), re.compile(
        r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 6),
    Detector("access", ("akia",), re.compile(r"AKIA[A-Z0-9]+"), 20),
    Detector("hex", (), re.compile(r"[0-9a-f]+"), 24),
    Detector("github", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(r"gh[opusr]_[A-Za-z0-9]{36}"), valid=checksum_holds),
    Detector("npm", ("npm_",), re.compile(r"npm_[A-Za-z0-9]{36}"), valid=checksum_holds),
]
RANK = {d.kind: k for k, d in enumerate(DETECTORS)}
BASE_KINDS = ("assign", "access", "hex")
#: Two neighbouring probes fall into every run of 24 hex digits.
HEX_STEP = 12

_IS_HEX = np.zeros(256, bool)
_IS_HEX[[*b"0123456789abcdef"]] = True

Finding = tuple[str, int, int]


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for d in DETECTORS:
        for k in d.keywords:
            found.add_word(k, (d, len(k)))
    found.make_automaton()
    return found


def _hex_runs(raw: bytes, least: int) -> Iterator[tuple[int, int]]:
    """Byte spans of the hex runs of at least ``least`` digits."""
    probe = _IS_HEX[np.frombuffer(raw, np.uint8)[::HEX_STEP]]
    hits = np.flatnonzero(probe[1:] & probe[:-1]) * HEX_STEP
    pattern, done = re.compile(rb"[0-9a-f]+"), -1
    for at in hits.tolist():
        if at < done:
            continue
        start = at
        while start and _IS_HEX[raw[start - 1]]:
            start -= 1
        done = pattern.match(raw, start).end()
        if done - start >= least:
            yield start, done


def scan(raw: bytes, words: ahocorasick.Automaton) -> list[Finding]:
    """Findings ``(kind, start, end)`` of a UTF-8 text by start, then kind."""
    text = raw.decode()
    found: list[Finding] = []
    used = dict.fromkeys(RANK, 0)
    # Folding bytes leaves every character that is not A-Z as it is, so that places agree.
    folded = raw.lower().decode() if len(text) != len(raw) else text.lower()
    hits = sorted((end + 1 - size, RANK[d.kind]) for end, (d, size) in words.iter(folded))
    for start, rank in hits:
        d = DETECTORS[rank]
        if start < used[d.kind]:
            continue
        m = d.pattern.match(text, start)
        if not m:
            continue
        if d.valid:
            if d.valid(m.group()):
                found.append((d.kind, start, m.end()))
            continue
        used[d.kind] = m.end()
        if len(m.group(m.re.groups)) >= d.least:
            found.append((d.kind, start, m.end()))
    spans = list(_hex_runs(raw, DETECTORS[RANK["hex"]].least))
    if spans and len(text) != len(raw):
        # Code points before a byte: bytes before it that do not continue a character.
        heads = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
        spans = [(bisect_left(heads, a), bisect_left(heads, a) + b - a) for a, b in spans]
    found += [("hex", a, b) for a, b in spans]
    return sorted(found, key=lambda f: (f[1], RANK[f[0]]))


def find_secrets(docs: DataFrame) -> DataFrame:
    """``doc_id, findings``: an array of ``(kind, start, end)`` per document, by start, then kind."""
    ship_package(docs.sparkSession)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = automaton()
        for batch in batches:
            text = batch.column("text").cast(pa.binary())
            rows = [[dict(zip(("kind", "start", "end"), f, strict=True)) for f in scan(t.as_py() or b"", words)] for t in text]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], ["doc_id", "findings"])

    return docs.select("doc_id", "text").mapInArrow(
        work, f"doc_id {dict(docs.dtypes)['doc_id']}, findings array<struct<kind: string, start: long, `end`: long>>")


def digest(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds and the spans, one row per document."""
    def spans(items: str) -> str:
        return f"array_join(transform({items}, f -> concat(f.kind, ':', f.start, ':', f.`end`)), ',')"

    base = "filter(findings, f -> f.kind IN ('assign', 'access', 'hex'))"
    count = [F.expr(f"CAST(size(filter(findings, f -> f.kind = '{k}')) AS long) AS n_{k}") for k in BASE_KINDS]
    return find_secrets(docs).select("doc_id", *count, F.expr(f"sha2({spans(base)}, 256) AS base_sha256"),
                                     F.expr(f"{spans('findings')} AS spans"))
