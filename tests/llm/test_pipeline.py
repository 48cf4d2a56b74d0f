import random
import re
import sys
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parents[1])]

import corpus_pipeline  # noqa: E402
from loomseq.llm import html_extraction as X, oracle, queries  # noqa: E402
from loomseq.llm.common import smallest_hashes  # noqa: E402
from loomseq.llm.language_id import learn, predict  # noqa: E402
from oracle_check import compare, connect  # noqa: E402
from test_texts import contamination_by_hand, words  # noqa: E402
from test_vectors_and_duplicates import bags, classes  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("name", sorted(oracle.statements()))
def test_query_against_sql(spark, sf_dir, name):
    ok, note, *_ = compare(spark, connect(sf_dir), queries.registry()[name], oracle.statements()[name], sf_dir)
    assert ok, note


def test_names_of_queries():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.registry()) == list(range(1, 14))


def test_language_stage_without_labels_keeps_texts_with_letters(spark, sf_dir):
    docs = spark.createDataFrame(
        [(1, "the cat", None, "s", 7), (2, "12 ? !", None, "s", 6), (3, None, None, "s", 0), (4, "é", None, "s", 1)],
        "doc_id long, text string, lang string, source string, n_chars long")
    told = dict(corpus_pipeline.STAGES)["language_id"](spark, docs, sf_dir)
    assert sorted(map(tuple, told.collect())) == [(1, "the cat", None, "s", 7), (4, "é", None, "s", 1)]


def test_language_stage_rejects_by_score(spark, sf_dir):
    rng = random.Random(3)
    junk = ["".join(rng.choice("qxzjkwvy   ") for _ in range(60)) for _ in range(60)]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mixed = docs.unionByName(spark.createDataFrame([(10**6 + i, t, None, "s", 60) for i, t in enumerate(junk)], docs.schema))
    score = {r.doc_id: r.score for r in predict(mixed, learn(mixed)).collect()}
    left = {r.doc_id for r in dict(corpus_pipeline.STAGES)["language_id"](spark, mixed, sf_dir).collect()}
    assert left == {d for d, x in score.items() if x >= corpus_pipeline.LEAST_SCORE} and {r.doc_id for r in docs.collect()} <= left
    assert any(10**6 + i not in left for i in range(60))


def test_near_copies_leave_one_row_of_each_class(spark, sf_dir):
    rng = random.Random(4)
    text = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    a, b, c, d = (text(40) for _ in range(4))
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, a, "x", "s", 1), (None, a, "y", "s", 1), (None, a + " more", "x", "s", 2), (5, b, "x", "s", 3), (5, b, "x", "s", 3), (5, b, "z", "s", 3),
            (None, b, "x", "s", 3), (7, c, "x", "s", 4), (3, c + " end", "x", "s", 5), (8, d, "x", "s", 6), (None, "", "x", "s", 0), (None, None, "x", "s", 0)]
    left = [tuple(r) for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, spark.createDataFrame(rows, shape).repartition(3), sf_dir).collect()]
    assert all(r in rows for r in left)
    ids = sorted((r[0] is None, r[0] or 0, (r[1] or "")[:3]) for r in left)
    assert len([r for r in left if r[1] and r[1].startswith(a)]) == 1 and [r[0] for r in left if r[1] == b] == [5]
    assert sorted(r[0] for r in left if r[0] is not None) == [3, 5, 8] and len(left) == 6 and len(ids) == 6


def test_stages_against_plain_versions(spark, sf_dir):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "near_dedup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(90001, None, "en", "s", 0), (90002, " 12 ?", None, "s", 5), (90003, "x", None, "s", 1)], docs.schema)
    docs = docs.unionByName(odd)
    told = stages["language_id"](spark, docs, sf_dir)
    assert told.columns == COLUMNS and told.where("lang IS NULL").count() == 0
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in told.collect()} == {90001, 90002}

    lined = stages["line_dedup"](spark, told, sf_dir)
    rows = lined.collect()
    before = {r.doc_id: r for r in told.collect()}
    assert lined.columns == COLUMNS and all(r.n_chars == len(r.text) and words(r.text) for r in rows)
    for r in rows:
        rest = iter(before[r.doc_id].text.split("\n"))
        assert all(line in rest for line in r.text.split("\n"))
    lines = [line.lower().strip() for r in rows for line in r.text.split("\n") if line.strip()]
    assert len(lines) == len(set(lines))

    kept = {r.doc_id for r in stages["near_dedup"](spark, told, sf_dir).collect()}
    texts = [(r.doc_id, r.text) for r in before.values()]
    made = bags([t for _, t in texts])
    links = []
    for i, a in enumerate(made):
        for j in range(i):
            both = sum((a & made[j]).values())
            if a and 5 * both >= 4 * (sum(a.values()) + sum(made[j].values()) - both):
                links.append((texts[i][0], texts[j][0]))
    part = classes(links, before)
    assert kept == {d for d, p in part.items() if d == p}

    clean = {r.doc_id for r in stages["decontamination"](spark, told, sf_dir).collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert clean == {row[0] for row in contamination_by_hand(texts, items) if not row[-1]}


def test_run_and_empty_documents(spark, sf_dir):
    pieces = corpus_pipeline.run(spark, sf_dir)
    total = pieces.groupBy("doc_id").sum("length").count()
    assert 0 < total <= spark.read.parquet(f"{sf_dir}/documents.parquet").count() and corpus_pipeline.ORACLE_SQL is None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.count() == 0


# --- pages ---

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header class=site-header><a href=/>Site</a></header>
<nav><ul><li><a href="/a">Home</a><li><a href="/b">About us</a></ul></nav><div class="cookie-notice">We use cookies, and more.</div>
<%s><h1>A &amp; B</h1><p>First   para, <b>bold</b>&nbsp;&eacute; <a href=x>link</a>.<p>Second<br>one. <script>if (a < "</p>") {}</script></p>
<div class="ad">Buy now, it is cheap.</div><blockquote>Quoted words, here.</blockquote></%s>
<aside class="sidebar"><h3>Related</h3><ul><li><a href="/r">Other story</a></li></ul></aside>
<section id="comments"><h2>Comments</h2><p>A reader says that this is fine, really.</p></section>
<form class="newsletter"><label>Mail</label><button>Send</button></form><footer>&copy; Site 2020 &middot; Imprint</footer></body></html>"""
MAIN = "A & B\nFirst para, bold é link.\nSecond one.\nQuoted words, here."


def test_pages(spark, sf_dir):
    model = X.fit(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    rows = [(1, "u", PAGE % ("article", "article")), (2, "u", PAGE % ('div class="article-body"', "div")), (3, "u", PAGE % ("main", "main")), (4, None, None), (5, "u", ""),
            (6, "u", "<p>"), (None, "u", PAGE % ("article", "article")), (1, "u", PAGE % ("article", "article")), (7, "u", "<article><p>" + "word " * 200_000),
            (8, "u", "<article><p>a < b <!-- <p>no</p>"), (9, "u", "<nav><a href='x>y'>only menu</a></nav>")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = X.extract(df, model).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r.text for r in got}
    assert by[1] == by[2] == by[3] == by[None] == MAIN
    assert by[4] == by[5] == by[6] == by[9] == "" and by[7] == ("word " * 200_000).strip() and by[8] == "a < b"
    assert X.extract(df.limit(0), model).count() == 0 and X.extract(df.limit(0)).count() == 0


def test_chain_model_against_all_labelings():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    model = X.ChainModel(rng.normal(size=X.WIDTH), rng.normal(size=(2, 2)), rng.normal(size=2))
    for n in range(1, 7):
        rows = [rng.integers(0, X.WIDTH, 3).tolist() for _ in range(n)]

        def score(labels):
            total = model.start[labels[0]] + sum(model.weights[r].sum() for r, y in zip(rows, labels) if y)
            return total + sum(model.follow[a, b] for a, b in itertools.pairwise(labels))

        assert tuple(model.decode(rows)) == max(itertools.product((0, 1), repeat=n), key=score)
    assert model.decode([]) == []
    pages = [([[1], [2], [3]], [0, 1, 0]), ([[2], [2], [1]], [1, 1, 0])]
    trained = X.train(pages)
    assert [trained.decode(rows) for rows, _ in pages] == [labels for _, labels in pages]


def test_blocks():
    page = "<ul><li>one<li>two</ul><table><tr><td>a<td>b</table>x &lt;y&gt; &#233; <noscript>no</noscript><svg><text>no</text></svg>z"
    assert [b.text for b in X.blocks_of(page)] == ["one", "two", "a", "b", "x <y> é z"]
    assert [b.path[-1][0] for b in X.blocks_of(page)[:4]] == ["li", "li", "td", "td"]
    assert X.blocks_of('<div class="a-b c" id=d>t</div>')[0].path == (("div", ("a", "b", "c", "d")),)


@pytest.mark.parametrize("html", [
    "<a " * 333_000, "<a " * 333_000 + ">", "<!" * 500_000, '<a "x>" ' * 125_000, "<a '" * 250_000 + ">", "<div>x" * 100_000,
    "<p><table>" + "<div>x" * 100_000, "<b>x" * 100_000 + "</i>" * 100_000, "<ul>" + "<li>x" * 100_000, "<!--" * 250_000,
    "<script>" + "</script " * 110_000, ("<b>" * 50 + "<i>x") * 3_000 + "</b>" * 100_000, "&" * 1_000_000])
def test_pages_of_a_megabyte_take_linear_time(html):
    start = time.process_time()
    X.Features().of(X.blocks_of(html))
    assert time.process_time() - start < 8


def test_odd_markup():
    texts = lambda h: [b.text for b in X.blocks_of(h)]
    assert texts("<p>a <b") == ["a <b"] and texts("x < y <p>z</p> 1 <!-- c <p>d") == ["x < y", "z", "1"]
    assert texts("<p>a<!-- > --> b <!-- x > y") == ["a b"] and texts('<p title="a > b">t</p>') == ["t"] and texts("") == texts(None) == []
    deep = X.blocks_of("<div class=one>" * 5 + "<article>in</article>" + "</div>" * 5 + "<p>out")
    assert [len(b.path) for b in deep] == [6, 1] and deep[0].path[-1] == ("article", ())


def test_smallest_hashes(spark):
    df = spark.range(5000).select(F.xxhash64(F.col("id") % 3000).alias("h"), "id")
    want = sorted({r.h for r in df.collect()})
    for k in (0, 1, 50, 3000, 4000):
        assert {r.h for r in smallest_hashes(df, "h", k).collect()} == set(want[:k])
    assert smallest_hashes(df.limit(0), "h", 5).count() == 0
