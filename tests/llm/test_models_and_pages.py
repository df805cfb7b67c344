import re
from html import unescape

import corpus_pipeline
from tests.llm.conftest import SF, table
from tuplespark.llm import toxicity, urls, webpage


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, "documents", sf), table(spark, "labels", sf)
    model = toxicity.learn(docs, labels)
    rows = toxicity.score(docs, model).join(labels, "doc_id").where("held_out").collect()
    assert model.lexicon and sum(r.predicted and r.toxic for r in rows) >= 0.7 * sum(r.toxic for r in rows)
    assert len(rows) > 40 and sum(r.predicted == r.toxic for r in rows) >= 0.9 * len(rows)
    restore = toxicity.Restorer(model.logp)
    for token, word in (("$tupid", "stupid"), ("stuuuupid", "stupid"), ("m0r0n!!", "moron"), ("the###", "the")):
        assert restore.words(token) == (word,), token
    for token, word in (("!diot", "idiot"), ("|oser", "loser"), ("(lean", "clean"), ("stuupid", "stupid")):
        assert restore.words(token)[-1] == word, token
    doc, word, n, words, tokens = toxicity.word_counts(["s t u p i d", None, "so so"], restore)
    assert {(int(d), words[w], int(k)) for d, w, k in zip(doc, word, n)} >= {(0, "stupid", 1), (2, "so", 2)}
    assert tokens.tolist() == [6, 0, 2]
    # A lexicon beyond the bound is joined: the same numbers and scores.
    table_ = spark.createDataFrame(list(model.lexicon.items()), "form string, weight long")
    joined = toxicity.Model(model.logp, table_, model.weights)
    few = docs.limit(300).unionByName(docs.limit(1))
    both = [sorted(map(tuple, toxicity.score(few, m).select("doc_id", "score").collect())) for m in (model, joined)]
    assert both[0] == both[1] and len(both[0]) == 301


def test_toxicity_counts_whole_texts(spark):
    logp = toxicity.language_model(spark.createDataFrame([("plain words of a text",)], "text string"))
    got = toxicity.word_rows(["bad day day", "day", "", "bad"], toxicity.np.array([True, False, False, True]), toxicity.Restorer(logp))
    rows = {f: tuple(map(int, r)) for f, *r in got[["word", "rows0", "rows1", "uses0", "uses1"]].itertuples(index=False)}
    assert list(got.columns) == ["word", "rows0", "rows1", "uses0", "uses1"]
    assert rows == {"": (1, 3, 1000, 3693), "bad": (0, 2, 0, 2000), "day": (1, 1, 1000, 1693)}
    got = spark.createDataFrame([("ab",), ("abcdé",), ("abcdefghi",)], "word string").selectExpr("word", f"{toxicity.FORMS} AS forms").collect()
    assert all(list(r.forms) == toxicity.forms(r.word) for r in got)
    logp2 = toxicity.measured_texts(["bad bad day", None, "x"], toxicity.Restorer(logp), toxicity.Lexicon({"bad.": 5, "day.": 2}))
    assert [c.tolist() for c in logp2] == [[12, 0, 0], [3, 0, 0], [5, 0, 0], [3, 0, 1]]


def test_toxicity_edges_with_a_model(spark, odd):
    sf = "/root/testdata/sf0.001"
    model = toxicity.learn(table(spark, "documents", sf), table(spark, "labels", sf))
    out = toxicity.score(odd.withColumn("score", toxicity.F.lit("x")), model, keep=["score", "text"]).collect()
    assert len(out) == odd.count() and all(0 <= r.score <= 1 and r.carried.score == "x" for r in out)


def test_toxicity_edges(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    out = toxicity.digest(odd, none).collect()
    assert len(out) == odd.count() and {r.score for r in out} == {0.0}
    assert toxicity.digest(empty, none).collect() == []


def test_html_matches_article(spark):
    pages = table(spark, "pages")
    want = {}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)(</article>|<footer>)", r.html, re.S).group(1)
        parts = [" ".join(unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?p>|</?h1>", body)]
        want[r.page_id] = "\n".join(x for x in parts if x)
    assert {r.page_id: r.text for r in webpage.extract(pages).collect()} == want


def test_html_furniture():
    page = ("<body><header>Site</header><div class='menu'><a href='/'>Home</a></div><div id='main'><h1>Head line</h1>"
            "<p>First  paragraph, with some words &amp; signs.</p><p>Second one, longer than the first; it goes on."
            "</div><div class='comments'><p>Great post, thanks, I agree!</p></div><aside>More</aside><script>x='<p>'</script><footer>F")
    assert webpage.main_text(page) == ("Head line\nFirst paragraph, with some words & signs.\n"
                                       "Second one, longer than the first; it goes on.")
    assert webpage.main_text(None) == "" and webpage.main_text("") == "" and webpage.main_text("<<<a <p") is not None


def test_urls_edges(spark):
    df = spark.createDataFrame([(1, None), (2, "no scheme"), (3, "http://A.Example.NET/en/x?q"), (4, "http://example.net"), (5, "x://notnet/"),
                                (6, "https://b.org/fr/"), (6, "https://b.org/fr/"), (None, "http://x.net/")], "page_id long, url string")
    got = sorted((r.page_id or 0, r.host, r.path, r.rule or "", r.verdict) for r in urls.url_filter(df, urls.rule_table(spark)).collect())
    assert got == [(0, "x.net", "/", "net/", "block"), (1, "", "", "", "allow"), (2, "", "", "", "allow"),
                   (3, "a.example.net", "/en/x", "example.net/en/", "allow"), (4, "example.net", "", "", "allow"),
                   (5, "notnet", "/", "", "allow"), (6, "b.org", "/fr/", "org/fr/", "allow"), (6, "b.org", "/fr/", "org/fr/", "allow")]


def test_pipeline_stages(spark):
    docs = table(spark, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert sorted(after.columns) == sorted(columns), name
        after = corpus_pipeline.stored(after, "test-stage")
        before_ids, ids = {r.doc_id for r in docs.select("doc_id").collect()}, {r.doc_id for r in after.select("doc_id").collect()}
        assert ids <= before_ids and (ids == before_ids) == (name == "line dedup"), name
        docs = after
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in mixed.select("doc_id").collect()} == ids


def test_html_keeps_all_of_the_content():
    body = "<p>A long paragraph of the text, with commas, and more than one sentence. It goes on for a while.</p>"
    text = "A long paragraph of the text, with commas, and more than one sentence. It goes on for a while."
    page = f"<main><h1>Title</h1><p>Standfirst</p><article>{body * 9}</article><section><p>Short.</p></section></main>"
    assert webpage.main_text(page) == "\n".join(["Title", "Standfirst", *[text] * 9, "Short."])
    page = f"<div class='nav'><a href='/'>Home</a></div><h1>Title</h1><p>By me</p><article>{body * 3}</article>"
    assert webpage.main_text(page) == "\n".join(["Title", "By me", *[text] * 3])
    page = f"<div>{body * 9}<ul><li>Tea</li><li>Milk</li></ul><div class='side-effects'><p>Few.</p></div>{body}</div>"
    assert webpage.main_text(page) == "\n".join([*[text] * 9, "Tea", "Milk", "Few.", text])
    page = f"<body><div><h2>Head</h2><p>{text * 20}</p><ul><li>Tea</li><li>Milk</li></ul></div></body>"
    assert webpage.main_text(page) == "\n".join(["Head", text * 20, "Tea", "Milk"])
    assert webpage.main_text(f"<p>Out</p><article>{text * 9}</article>") == text * 9
