"""Operators 11 to 13: brute force, planted cases and edges."""
import re
import zlib
from itertools import permutations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import sha, table
from tuplespark.llm import audit, credentials, runs


def brute_runs(w):
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(6, 4 * q):
                found[i, size] = min(q, found.get((i, size), q))
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=40))
def test_lyndon_array(s):
    want = []
    for i in range(len(s)):
        j = i + 1
        while j < len(s) and s[j:] >= s[i:]:
            j += 1
        want.append(j - i)
    assert runs.lyndon_array([0, *s, 0])[1:-1] == want


repeats = st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=5), st.integers(1, 7)), max_size=6)


@settings(max_examples=150, deadline=None)
@given(st.lists(repeats, min_size=1, max_size=5))
def test_runs_match_brute_force(docs):
    words = [[b"%d" % x for block, times in d for x in block * times] for d in docs]
    assert runs.runs_of_texts(words) == [brute_runs(w) for w in words]


def test_thue_morse_defeats_the_hash_but_not_the_result():
    bits = [b"%d" % (bin(i).count("1") & 1) for i in range(4096)]
    words = bits + [b"1", b"0"] * 9 + bits
    assert runs.runs_of_texts([words]) == [brute_runs(words)]


def test_long_runs_take_no_quadratic_time():
    assert runs.runs_of_texts([[b"a"] * 300_000, [b"a", b"b", b"c"] * 50_000]) == [[(0, 300_000, 1)], [(0, 150_000, 3)]]


def test_runs_digest_of_whole_table(spark):
    docs = table(spark, "documents")
    want = {}
    for r in docs.collect():
        w = runs.repeat_tail(r.doc_id, (r.text or "").encode().split())
        rs = brute_runs(w)
        gone = {k for s, n, q in rs for k in range(s + q, s + n)}
        best = min(rs, key=lambda x: (-x[1], x[0], x[2])) if rs else (None, None, None)
        want[r.doc_id] = (len(rs), *best, 1000 * best[1] // best[2] if rs else None,
                          sha("".join(f"{s},{n},{q}\n" for s, n, q in rs)),
                          sha(b" ".join(x for k, x in enumerate(w) if k not in gone)))
    assert {r[0]: tuple(r)[1:] for r in runs.digest(docs).collect()} == want and any(v[0] for v in want.values())


def test_runs_edges(spark, odd, empty):
    got = sorted(runs.find_runs(odd).collect(), key=str)
    assert len(got) == 10 and sum(r.doc_id is None for r in got) == 2
    assert {r.doc_id: (len(r.runs), r.collapsed_text) for r in got if r.doc_id in (1, 2, 3, 4, 7)} == {
        1: (0, ""), 2: (0, ""), 3: (0, ""), 4: (0, "one two"), 7: (1, "é ü")}
    assert runs.digest(empty).count() == 0
    assert [r.n_runs for r in runs.digest(odd).where("doc_id = 7").collect()] == [1]


PATTERNS = {
    "assign": re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    "access": re.compile(r"(AKIA[A-Z0-9]+)"), "hex": re.compile(r"([0-9a-f]+)")}
LEAST = {"assign": 6, "access": 20, "hex": 24}


def base_spans(text):
    found = [(m.start(), list(LEAST).index(k), k, m.end()) for k, p in PATTERNS.items() for m in p.finditer(text) if len(m[1]) >= LEAST[k]]
    return [(k, s, e) for s, _, k, e in sorted(found)]


def token(prefix, body):
    value, check = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        check = credentials.BASE62[digit] + check
    return f"{prefix}_{body}{check}"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["password", "Api_Key", "apikey", "toKen", "ſecret", "secret", "=", ":", " ", '"', "'", "abc", "abcdef", "AKIA",
                                 "A1" * 8, "0f" * 6, "0123456789abcdef" * 2, "é", "\n", "İ", "ghp_", "a" * 36]), max_size=14))
def test_scan_matches_plain_expressions(parts):
    text = "".join(parts)
    got = credentials.scan(text.encode(), credentials.automaton())
    assert [f for f in got if f[0] in LEAST] == base_spans(text)


def test_checksums_decide(spark):
    body = "Ab3" * 10
    good, npm = token("ghp", body), token("npm", body[::-1])
    bad = good[:-1] + ("a" if good[-1] != "a" else "b")
    df = spark.createDataFrame([(1, f"é {good} and {npm}"), (2, f"{bad} ghp_{good}"), (3, "ghp_" + "x" * 20)], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in credentials.digest(df).collect()}
    assert got == {1: "github:2:42,npm:47:87", 2: "github:45:85", 3: ""}


def test_secrets_of_whole_table_and_edges(spark, odd, empty):
    docs = table(spark, "documents", "/root/testdata/sf0.01")     # the smallest table holds no secret
    want = {r.doc_id: base_spans(r.text or "") for r in docs.collect()}
    got = {r.doc_id: [tuple(f) for f in r.findings if f.kind in LEAST] for r in credentials.find_secrets(docs).collect()}
    assert got == want and any(want.values())
    assert credentials.digest(odd).count() == 10 and credentials.digest(empty).count() == 0
    assert {r.spans for r in credentials.digest(odd).collect()} == {""}
    # A short value uses up its characters; a long text is scanned to its end.
    text = "token=ab token=token=abcdef " + "x " * 400_000 + "PASSWD : '" + "z" * 50
    one = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [tuple(f) for f in credentials.find_secrets(one).first().findings] == base_spans(text)


def fails(rows):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    for i, t, part in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        yield part or "", i, {k for k, x in {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": re.search(r"[#$%&*|]", t), "E": i is not None and i > first[t]}.items() if x}


def brute_audit(rows, good, toxic):
    judged = list(fails(rows))
    out = {}
    for part in {p for p, _, _ in judged}:
        mine = [(i, f) for p, i, f in judged if p == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for k, x in enumerate(order):
                gone = [d for d in left if x in d[1]]
                left = [d for d in left if x not in d[1]]
                shapley[x] += len(gone)
                out[part, "".join(order), k + 1] = [
                    len(left), len(gone), sum(x in f for _, f in mine) - len(gone), sum(f == {x} for _, f in mine),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), x]
        for (p, _, _), v in out.items():
            if p == part:
                v[-1] = shapley[v[-1]]
    return {k: tuple(v) for k, v in out.items()}


def audited(df):
    return {tuple(r)[:3]: tuple(r)[3:] for r in df.select(
        "part", "filter_order", "step", *audit.MEASURES, "shapley").collect()}


def test_audit_matches_brute_force(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    marks = labels.collect()
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    want = brute_audit(rows, {r.doc_id for r in marks if r.quality == 1}, {r.doc_id for r in marks if r.toxic == 1})
    got = audited(audit.digest(docs, labels))
    assert got == want and len(got) == 600 * len({p for p, _, _ in want})


def test_audit_edges(spark):
    many = " ".join(f"w{i}" for i in range(120))
    rows = [(1, None, "en"), (2, "", None), (3, "", ""), (3, "", ""), (None, "", "en"), (None, many, None), (7, many, "de"),
            (8, many, "en"), (8, many, "en"), (9, "A" * 200 + " # $", "de"), (10, "w " * 200_000, "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS n", "'x' AS mask", "2 AS good")
    labels = spark.createDataFrame([(8, 1, 0), (8, 0, 1), (None, 1, 1), (99, 1, 1), (9, None, 1), (3, 1, None)],
                                   "doc_id long, quality int, toxic int")
    assert audited(audit.digest(docs, labels)) == brute_audit(rows, {8, 3}, {8, 9})
    none = labels.limit(0)
    assert audited(audit.digest(docs, none)) == brute_audit(rows, set(), set())
    assert audit.digest(docs.limit(0), labels).count() == 0


def test_audit_runs_no_python(spark):
    plan = audit.digest(table(spark, "documents"), table(spark, "labels"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


@pytest.mark.parametrize("prepared", [True, False])
def test_repeat_tail_follows_the_rule(prepared):
    ids = [i for i in range(200) if (zlib.crc32(str(i).encode()) % 10 == 0) == prepared]
    words = [b"w%d" % i for i in range(97)]
    for i in ids:
        got, g = runs.repeat_tail(i, words), zlib.crc32(str(i).encode()) // 10
        a = g % 97
        p = 1 + (97 - a) // (3 + g % 8)
        assert got == ([words[k] if k < a else words[a + (k - a) % p] for k in range(97)] if prepared else words)
