"""Brute-force checks and edge cases of the operators on documents."""
from collections import Counter, defaultdict

import numpy as np

from tests.llm.conftest import SF, sha, table
from tuplespark.llm import decontam, lines, minhash, mixing, passages, quality, suffix


def texts(spark):
    return [(r.doc_id, r.text or "") for r in table(spark, "documents").select("doc_id", "text").collect()]


def test_suffix_matches_brute_force(spark):
    rows = [(i, t.encode()) for i, t in texts(spark)]
    seen = Counter(b[k:k + 200] for _, b in rows for k in range(len(b) - 199))
    want = {}
    for i, b in rows:
        gone = bytearray(len(b))
        for k in range(len(b) - 199):
            if seen[b[k:k + 200]] > 1:
                gone[k:k + 200] = b"\1" * 200
        spans = sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1]))
        want[i] = (len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g)))
    got = {r[0]: tuple(r)[1:] for r in suffix.digest(table(spark, "documents")).collect()}
    assert got == want and any(w[1] for w in want.values())


def test_cover_is_a_difference_cover():
    assert {(a - b) % suffix.PERIOD for a in suffix.COVER for b in suffix.COVER} == set(range(suffix.PERIOD))


def test_passages_cover_every_exact_repeat(spark):
    rows = [(i, t.encode().lower().split()) for i, t in texts(spark)]
    where = defaultdict(set)
    for i, w in rows:
        for k in range(len(w) - 49):
            where[tuple(w[k:k + 50])].add(i)
    found = defaultdict(set)
    for r in passages.digest(table(spark, "documents")).collect():
        for p in r.passages:
            found[r.doc_id].update(range(p.start_word, p.end_word))
            found[r.partner_id].update(range(p.partner_start, p.partner_end))
    repeats = [(i, k) for i, w in rows for k in range(len(w) - 49) if len(where[tuple(w[k:k + 50])]) > 1]
    assert repeats
    assert [x for x in repeats if not set(range(x[1], x[1] + 50)) <= found[x[0]]] == []


def test_large_group_of_near_copies_links_linearly(spark):
    base = [f"t{i}" for i in range(120)]
    rows = [(n, " ".join(base[:n % 60] + [f"n{n}"] + base[n % 60 + 1:])) for n in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = minhash.near_duplicates(df).collect()
    assert {r.component_id for r in out} == {0} and sum(r.kept for r in out) == 1
    links = passages.find_passages(df).collect()
    assert {r.doc_id for r in links} | {r.partner_id for r in links} == set(range(200)) and len(links) < 2000


def test_minima_of_sets_of_any_length():
    rng = np.random.default_rng(3)
    a, b = minhash._family(7)
    sets = [rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (1, 16383, 1, 40000, 3, 16384, 2)]
    want = [[(int((s * p + q).max()) >> 32) ^ 0xFFFFFFFF for p, q in zip(a, b)] for s in sets]
    assert minhash.minima(sets, a, b).tolist() == want


def test_links_of_edited_copies_match_brute_force(spark):
    """Copies with 0 to 12 words changed, at places of their own: many pairs lie just above and below 85 %."""
    rng = np.random.default_rng(4)
    base = [f"t{i}" for i in range(150)]
    rows = []
    for n in range(240):
        words = list(base)
        for at in rng.choice(150, n % 13, replace=False):
            words[at] = f"e{rng.integers(12)}" if n % 2 else f"n{n}x{at}"
        rows.append((n, " ".join(words)))
    sets = {n: {tuple(t.split()[i:i + 3]) for i in range(148)} for n, t in rows}
    root = {n: n for n in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for u in sets:
        for v in range(u):
            if 100 * len(sets[u] & sets[v]) >= 85 * len(sets[u] | sets[v]):
                x, y = sorted((find(u), find(v)))
                root[y] = x
    # Repeated rows and a second, unrelated text of one id change no link.
    more = [*rows, *rows[:50], (7, " ".join(f"z{i}" for i in range(60)))]
    out = minhash.digest(spark.createDataFrame(more, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in out} == {n: find(n) for n in sets}
    assert 20 < len({find(n) for n in sets}) < 220


def test_copies_below_the_threshold_are_not_compared_pair_by_pair(spark, monkeypatch):
    """Seven words are left out of each copy: all share buckets and nearly all shingles, few reach 85 %."""
    rng = np.random.default_rng(5)
    base = [f"t{i}" for i in range(160)]
    cuts = [4 * np.sort(rng.choice(39, 7, replace=False)) + rng.integers(0, 2, 7) for _ in range(80)]
    cuts += [np.append(c[:-1], c[-1] + 1) for c in cuts[:10]]  # one place beside: linked to their model
    rows = [(n, " ".join(np.delete(base, c))) for n, c in enumerate(cuts)] + [(999, " ".join(base))]
    sets = {n: {tuple(t.split()[i:i + 3]) for i in range(len(t.split()) - 2)} for n, t in rows}
    linked = {(v, u) for u in sets for v in sets if v < u and 100 * len(sets[u] & sets[v]) >= 85 * len(sets[u] | sets[v])}
    made, plain = [], minhash.stored

    def spy(df, name):
        out = plain(df, name)
        made.append((name, out.count()))
        return out
    monkeypatch.setattr(minhash, "stored", spy)
    out = {r.doc_id: r.component_id for r in minhash.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    root = {n: n for n in sets}
    for _ in sets:
        for v, u in linked:
            root[u] = root[v] = min(root[u], root[v])
    assert out == root and 10 <= len(linked) < 100
    left = [n for name, n in made if name == "left"]
    assert left[0] > 500 and sum(left[2:]) < left[0] / 4


def test_odd_rows(spark, odd):
    n = odd.count()
    q = {(r.doc_id, r.n_words, r.n_repeat_words): r for r in quality.digest(odd).collect()}
    assert (1, 0, 0) in q and (3, 0, 0) in q and (7, 180, 180) in q
    near = minhash.digest(odd).collect()
    assert len(near) == n
    by = defaultdict(list)
    for r in near:
        by[r.doc_id].append(r)
    assert by[6][0].component_id == 5 and not by[6][0].kept and by[1][0].kept and by[2][0].component_id == 2
    assert all(r.kept and r.component_id is None for r in by[None])
    cut = {r.doc_id: r for r in suffix.digest(odd).collect()}
    assert cut[1].n_bytes == 0 and cut[5].n_removed == cut[5].n_bytes and cut[7].n_removed == cut[7].n_bytes
    kept = lines.line_dedup(odd, keep=["words", "source"]).collect()
    assert len(kept) == n and {r.doc_id: r.n_lines for r in kept}[2] == 1
    same = passages.find_passages(odd).collect()
    assert [(r.doc_id, r.partner_id) for r in same if r.copy] == [(6, 5)]
    mixed = mixing.digest(odd).collect()
    assert {r.source for r in mixed} == {"", "a", "b", "c"}


def test_line_dedup_keeps_lines_of_rows_without_id(spark):
    line = "a line that is long enough to count"
    df = spark.createDataFrame([(None, line), (None, line), (None, line.upper() + " "), (1, "short")], "doc_id long, text string")
    assert sorted(r.n_dropped for r in lines.digest(df).collect()) == [0, 0, 0, 0]
    df = spark.createDataFrame([(1, line), (2, line + "\n" + line), (3, " " + line.upper()), (3, line)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_dropped) for r in lines.digest(df).collect()) == [(1, 1), (2, 2), (3, 0), (3, 0)]


def test_empty_tables(spark, empty):
    items = spark.createDataFrame([], "item_id long, text string")
    for df in (quality.digest(empty), minhash.digest(empty), mixing.digest(empty), suffix.digest(empty), lines.digest(empty),
               passages.find_passages(empty), decontam.digest(empty, items)):
        assert df.collect() == []


def test_contamination_edges(spark, odd):
    items = spark.createDataFrame([(1, "One two"), (2, None), (None, "one"), (1, "one two")], "item_id long, text string")
    out = decontam.contamination(odd, items).collect()
    assert len(out) == odd.count()
    assert {(r.n_words, r.n_hit, r.n_items, r.contaminated) for r in out if r.doc_id == 4} == {(2, 2, 1, True)}
    assert decontam.digest(odd, items.where("item_id > 5")).where("contaminated").count() == 0


def test_proximity(spark):
    df = spark.createDataFrame([(1, "red a b c fox d e f"), (2, "red a b c d e f g fox"), (3, "fox red")], "doc_id long, text string")
    q = spark.createDataFrame([("q", ["red", "fox"])], "query_id string, terms array<string>")
    assert {r.doc_id for r in decontam.proximity(df, q, 4).collect()} == {1, 3}


def test_quality_ablation(spark):
    led = quality.ledger(table(spark, "documents")).cache()
    rows = led.collect()
    for r in quality.ablation(led, quality.WEB).collect():
        bit = 1 << quality.BIT[r.rule]
        assert r.n_fail == sum(x.fail_bits & bit > 0 for x in rows) and r.n_fail_only == sum(x.fail_bits == bit for x in rows)
        assert r.n_kept_without == sum(x.fail_bits & ~bit == 0 for x in rows)


def test_mixing_targets(spark):
    rows = mixing.source_tokens(table(spark, "documents"))
    shares = mixing.shares(rows).collect()
    alpha = mixing.solve_alpha(mixing.shares(rows), entropy=2.9, max_repeat=None)
    import math
    total = sum(r.tokens for r in shares)
    p = [(r.tokens / total) ** alpha for r in shares if r.tokens]
    q = [x / sum(p) for x in p]
    assert abs(-sum(x * math.log(x) for x in q) - 2.9) < 1e-3 or alpha in (0.0, 1.0)
    assert {r.doc_id for r in mixing.digest(table(spark, "documents")).collect()} == {i for i, _ in texts(spark)}


def test_passages_of_one_class_give_every_pair(spark):
    base = [f"t{i}" for i in range(120)]
    rows = [(n, " ".join(base[:n % 60] + [f"n{n}"] + base[n % 60 + 1:])) for n in range(40)]
    # 100 shares 60 words with both others; 101 and 102 share 20 more on either side of them.
    hot, more = [f"h{i}" for i in range(60)], [f"m{i}" for i in range(40)]
    rows += [(100, " ".join([f"x{i}" for i in range(50)] + hot + [f"y{i}" for i in range(50)]))]
    rows += [(n, " ".join([f"{n}x{i}" for i in range(9)] + more[:20] + hot + more[20:] + [f"{n}y{i}" for i in range(9)])) for n in (101, 102)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    links = passages.find_passages(df).cache()
    member = {(p.class_id, i) for r in links.collect() for p in r.passages for i in (r.doc_id, r.partner_id)}
    assert len({c for c, i in member if i < 40}) == 1 and len({c for c, i in member if i >= 100}) == 1
    every = {(r.doc_id, r.partner_id): r for r in passages.expand_links(links, df).collect()}
    assert set(every) == {(i, j) for i in range(40) for j in range(i)} | {(101, 100), (102, 100), (102, 101)}
    assert [(p.start_word, p.end_word) for p in every[102, 101].passages] == [(9, 109)]


def test_changed_passages_are_all_found(spark):
    rows, want = [], set()
    for n in range(400):  # one word changed in the middle of 50: 41 of 51 shingles, just above 0.8
        a = [f"p{n}w{i}" for i in range(50)]
        b = a[:24] + ["other"] + a[25:]
        x, y = ({tuple(w[i:i + 5]) for i in range(46)} for w in (a, b))
        assert len(x & y) / len(x | y) > 0.8
        for i, w in ((2 * n, a), (2 * n + 1, b)):
            rows.append((i, " ".join([f"d{i}a{k}" for k in range(n % 40)] + w + [f"d{i}b{k}" for k in range(n % 30)])))
        want.add((2 * n + 1, 2 * n))
    found = passages.find_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.partner_id) for r in found} == want


def test_passage_behind_a_partial_repeat_is_found(spark):
    p = [f"p{i}" for i in range(60)]
    rows = [(1, " ".join(p)), (2, " ".join(p[:30] + [f"q{i}" for i in range(20)] + p))]
    found = passages.find_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r.doc_id, r.partner_id, [(x.start_word, x.end_word, x.partner_start, x.partner_end) for x in r.passages]) for r in found] == [
        (2, 1, [(50, 110, 0, 60)])]


def test_comparison_of_repetitive_texts_measures_each_run_once(monkeypatch):
    """Each stretch of equal words was measured anew from every place it repeats at: millions of times for such texts."""
    calls, plain = [0], passages._equal

    def counted(a, b):
        calls[0] += 1
        return plain(a, b)
    monkeypatch.setattr(passages, "_equal", counted)
    rng = np.random.default_rng(6)

    def text():
        parts = [[f"w{rng.integers(2)}"] * rng.integers(26, 40) + [f"u{i}" for i in rng.integers(0, 5, 6)] for _ in range(5)]
        return " ".join(w for part in [*parts[:3], [f"s{i}" for i in range(50)], *parts[3:]] for w in part)
    pairs = [[passages.Tokens(text(), 21) for _ in range(2)] for _ in range(2)]
    found = [passages.shared_passages(x, y, 46, 80) for x, y in pairs]
    assert any(found) and calls[0] <= sum(len(passages._starts(x, y)) for x, y in pairs)
    # Runs paired value by value and measured on demand give the same.
    monkeypatch.setattr(passages, "FEW", 0)
    monkeypatch.setattr(passages, "MOST_PAIRS", 0)
    assert [passages.shared_passages(x, y, 46, 80) for x, y in pairs] == found


def test_common_run_in_a_sparse_neighbourhood_is_given_up_at_once(monkeypatch):
    x = [f"a{i}" for i in range(8000)]
    # One run of 30 words, then five words in forty in common.
    y = x[:30] + [w for i in range(40, 7000, 40) for w in [*x[i:i + 5], *(f"b{i}-{k}" for k in range(35))]]
    calls, best = [], passages.Side.best
    monkeypatch.setattr(passages.Side, "best", lambda *a: (calls.append(1), best(*a))[1])
    both = [passages.Tokens(" ".join(t), passages.least_run(46, 80)) for t in (x, y)]
    assert passages.shared_passages(*both, 46, 80) == [] and len(calls) <= 2
    whole = passages.Tokens(" ".join(["z"] * 3 + x[:500] + ["q"] + x[501:900]), passages.least_run(46, 80))
    ((i, e, j, f, same),) = passages.shared_passages(both[0], whole, 46, 80)
    assert (i, e, j, f) == (0, 896, 3, 899) and same > 0.98
