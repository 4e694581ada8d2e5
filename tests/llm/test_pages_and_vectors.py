"""Main texts, nearest neighbours, components and the whole pipeline."""

import hashlib
import html
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barloom.llm import ann, decontaminate, html_text, quality_knn, simhash
from barloom.llm.common import Scratch
from barloom.llm.components import components


def test_main_text_of_test_pages(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    got = {r.page_id: r for r in html_text.main_text(pages).collect()}
    for page in pages.collect():
        article = re.search(r"<article>(.*?)</article>", page.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert got[page.page_id].text == "\n\n".join(filter(None, blocks))
        assert got[page.page_id].n_chars == len(got[page.page_id].text) and got[page.page_id].url == page.url


PAGE = """<!DOCTYPE html><body><div id=top class="site-header"><a href=x>Home</a> My site</div><div class="cookie-notice">We use cookies</div>
<div class="row"><div class="post post-{n}"><h1>Title &amp; {n}</h1><p>One <i>two</i>
three<p>Four &lt;five&gt; six, with enough words to be the text of a page<div class="share">Share me</div><ul><li>x<li>y</ul></div>
<div class=sidebar>Side</div></div><div class="comments"><p>A comment that is long indeed and goes on and on</div><form>q</form><script>if (a < b) "</div>"</script></body>"""


def test_other_pages(spark):
    rows = [(n, "https://User@Example.org:80/a", PAGE.replace("{n}", str(n))) for n in range(4)]
    rows += [(10, None, None), (11, "bad url", ""), (12, "http://x.org", "plain text"), (13, "http://x.org", "<p>a" * 3000), (14, "http://x.org", "<!-- open <p>x"), (0, "https://example.org", PAGE.replace("{n}", "0"))]
    pages = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = html_text.main_text(pages).collect()
    texts = {r.page_id: r.text for r in got}
    assert len(got) == len(rows)
    assert texts[2] == "Title & 2\n\nOne two three\n\nFour <five> six, with enough words to be the text of a page\n\nx\n\ny"
    assert texts[10] == texts[11] == texts[14] == "" and texts[12] == "plain text" and texts[13] == "\n\n".join(["a"] * 3000)
    post = next(e for e in html_text.Page(PAGE.replace("{n}", "1")).elements if e.tag == "div" and e.depth == 3)
    assert html_text.host_paths(pages, Scratch(spark, "pages")).where("host = 'example.org'").first().paths[0] == post.path
    assert html_text.main_text(pages.where("false")).count() == 0


SITE = """<html><body><div class="brandline">The daily something, your paper of record for the whole of the county</div><div id="page"><div class="post"><h1>Title {n}</h1>
<p>{a}</p><p>{b}</p><p>{c}</p></div><div class="strip">Take two months for the price of one, and cancel when you like it</div><div class="opinions"><div class="said">{d}</div></div></div></body></html>"""


def sentence(seed, words):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(words))


def test_furniture_with_names_of_its_own(spark):
    """What repeats over a host's pages is left out whatever it is called, and what stands beside the main container."""
    rows = [(n, f"http://paper.org/{n}", SITE.format(n=n, a=sentence(n, 40), b=sentence((n, 1).__hash__(), 60), c=sentence((n, 2).__hash__(), 50), d=sentence((n, 3).__hash__(), 14))) for n in range(10)]
    # a host of copies: nothing is furniture there, as its main text comes again too
    rows += [(100 + n, f"http://copies.org/{n}", "<body><div><p>One text that all pages have.</p><p>And another one.</p></div></body>") for n in range(10)]
    # a widget with a name of its own inside the text of single pages stays
    rows += [(200 + n, f"http://mixed.org/{n}", f"<body><div class=x><p>{sentence(n, 30)}</p><div class=aside-like>{sentence(-n - 1, 12)}</div></div><p class=legal>All of this belongs to us</p></body>") for n in range(8)]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for n in range(10):
        assert got[n] == "\n\n".join([f"Title {n}", sentence(n, 40), sentence((n, 1).__hash__(), 60), sentence((n, 2).__hash__(), 50)])
        assert got[100 + n] == "One text that all pages have.\n\nAnd another one."
    for n in range(8):
        assert got[200 + n] == f"{sentence(n, 30)}\n\n{sentence(-n - 1, 12)}"


def test_furniture_is_told_by_whole_names():
    page = '<article><div class="comment-policy-news ad-free">one</div><blockquote class="related-quote">two</blockquote><div class="comment-list">no</div><div id="siteFooter">no</div><p class="x" title="a > b">three</p></article>'
    assert html_text.Page(page).extract([]) == "one\n\ntwo\n\nthree"


@pytest.mark.parametrize(
    "page",
    ["<a x" * 250_000, "<div>" * 100_000 + "deep" + "</div>" * 100_000, "<div>deep " * 50_000 + "</span>" * 50_000, '<a x="' * 100_000 + "<p>end</p>", "<a x='>'y" * 100_000, "<b>" * 100_000 + "x<hr>" * 50_000, "<p><b>" * 50_000, "<!-- " * 200_000, "</x" * 200_000, "<li><i>" * 50_000, "<" * 1_000_000, '<p title="a>b' * 50_000, "<script>" * 100_000, "&amp" * 200_000],
)
def test_broken_and_deep_pages_take_linear_time(page):
    took = []
    for share in (4, 1):
        start = time.process_time()
        read = html_text.Page(page[: len(page) // share])
        read.container_scores()
        read.extract([])
        took.append(time.process_time() - start)
    assert took[1] < 8 * took[0] + 0.5


def test_texts_of_broken_pages():
    assert html_text.Page("<p>one <b two <p>x</p>").extract([]) == "one x"
    assert html_text.Page("<p>a < b and <3 <p title=\"q>two</p>").extract([]) == "a < b and <3\n\ntwo"
    assert html_text.Page("<p>one</p> rest <b").extract([]) == "one\n\nrest <b"


def test_nearest(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 16))
    x = np.concatenate([centres[rng.integers(0, 40, 5000)] + 0.3 * rng.standard_normal((5000, 16)), np.repeat(centres[:1], 600, axis=0)]).astype(np.float32)
    rows = [(i, v.tolist(), 1.0, "s") for i, v in enumerate(x)]
    rows += [(9000, None, None, None), (9050, [0.0] * 16, None, None), (9100, [float("nan")] * 16, None, None), (9150, [1.0, None] * 8, None, None), (9200, [1.0] * 3, None, None), (None, [1.0] * 16, None, None), (50, x[50].tolist(), None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score double, part string")
    got = ann.nearest(df, sample_rows=2000, rows_a_part=256, block_rows=500).collect()
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    hits, by = 0, {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == set(range(0, 5600, 50))
    for q, found in by.items():
        found.sort(key=lambda r: r.rank)
        assert [r.rank for r in found] == [1, 2, 3, 4, 5] and q not in {r.vec_id for r in found}
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        assert all(r.score == pytest.approx(float(y[q] @ y[r.vec_id]), abs=1e-9) for r in found)
        s = y @ y[q]
        s[q] = -2
        hits += len(set(np.argsort(-np.round(s, 12), kind="stable")[:5].tolist()) & {r.vec_id for r in found})
    assert hits / (5 * len(by)) >= 0.9
    few = df.where("vec_id in (0, 1, 2)")
    assert sorted((r.query_id, r.rank) for r in ann.nearest(few).collect()) == [(0, 1), (0, 2)]
    assert ann.nearest(df.where("false")).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200 + i) for i in range(50)] + [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(60)] + [(5, 5)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {n: find(n) for e in edges if e[0] != e[1] for n in e}


def test_pipeline(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, data)
        kept = Scratch(spark, "t").keep(out, name)
        assert 0 < kept.count() <= docs.count(), name
        if name != "token_ids":
            assert kept.columns == docs.columns
            docs = kept
    again = corpus_pipeline.run(spark, data)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, kept.collect()))
    benchmark = [" ".join(re.sub(r"[\W_]+", " ", r.text.lower()).split()) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    texts = [re.sub(r"[\W_]+", " ", r.text.lower()) for r in docs.collect()]
    assert not any(b in t for b in benchmark for t in texts)


def test_stages_against_plain_versions(spark, data):
    """Every stage on the test documents and difficult rows, against a second version of what it keeps or writes."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    more = spark.createDataFrame([(900, None, None, None, None), (901, "", "en", "s", 0), (None, "x y", None, None, 3), (902, "x y", "en", "s", 3), (902, "call +1 555 234 5678 now", "en", "s", 3), (902, "call +1 555 234 5678 now", "en", "s", 3)], docs.schema)
    docs = docs.union(more)
    rows = docs.collect()
    stages = dict(corpus_pipeline.STAGES)
    voters = quality_knn.fit_voters(docs, spark.read.parquet(f"{data}/labels.parquet"))
    good = [r for r in rows if voters.score(voters.terms([r.text or ""]))[0] >= 0.3]
    assert sorted(map(repr, stages["quality"](spark, docs, data).collect())) == sorted(map(repr, good))
    sets = [frozenset(simhash.shingle_hashes(r.text or "", 5).tolist()) for r in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if len(a & b) >= 0.8 * len(a | b) and group[i] != group[j]:
                group = [group[i] if g == group[j] else g for g in group]
    kept = stages["near_duplicates"](spark, docs, data).collect()
    least: dict[int, tuple] = {}
    for r, g in zip(rows, group, strict=True):
        key = (r.doc_id is None, r.doc_id)
        least[g] = min(least.get(g, key), key)
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(k[1]) for k in least.values()) and {repr(r) for r in kept} <= {repr(r) for r in rows}
    items = [" " + " ".join(re.sub(r"[\W_]+", " ", r.text.lower()).split()) + " " for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    clean = stages["decontamination"](spark, docs, data).collect()
    bad = [r for r in rows if any(i in " " + " ".join(re.sub(r"[\W_]+", " ", (r.text or "").lower()).split()) + " " for i in items)]
    assert bad and not {repr(r) for r in bad} & {repr(r) for r in clean}
    gone = [r for r in rows if repr(r) not in {repr(c) for c in clean}]
    for r in gone:  # each has an item within its edits
        text = decontaminate.padded(r.text or "")
        assert any(decontaminate.distances(i, text, int(0.05 * (len(i) - 2))) for i in items)
    private = {repr((r.doc_id, r.lang)): r for r in stages["private_data"](spark, docs, data).collect()}
    assert private[repr((902, "en"))].n_chars == len(private[repr((902, "en"))].text) and private[repr((900, None))].text is None
    ids = stages["token_ids"](spark, docs, data).collect()
    want = sorted((str(r.doc_id), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in rows)
    assert sorted((str(r.doc_id), r.decoded_sha256) for r in ids) == want
    none = docs.where("false")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, data)
        assert out.count() == 0 and (name == "token_ids" or out.columns == docs.columns)


def test_stages_with_long_texts_and_columns_of_the_operators_names(spark, data):
    """Other columns go through unread whatever they are called, and texts of a megabyte are texts."""
    rng = random.Random(8)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n))
    long = words(180_000)
    plain = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "n_chars").where("doc_id < 60")
    plain = plain.union(spark.createDataFrame([(9000, long, len(long)), (9001, long + " more", len(long) + 5), (9002, "w" * 1_000_000, 1_000_000)], plain.schema))
    names = ["held_out", "score", "predicted", "_text", "n_replaced", "__k", "__h", "others", "fp", "id", "keys", "row", "part", "key", "h"]
    for name, stage in corpus_pipeline.STAGES:
        odd = plain.select("*", *[F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")).alias(c) for c in names])
        got = Scratch(spark, "t").keep(stage(spark, odd, data), name)
        want = sorted(map(str, stage(spark, plain, data).collect()))
        if name == "token_ids":
            assert sorted(map(str, got.collect())) == want
            continue
        assert got.columns == odd.columns and sorted(map(str, got.select(*plain.columns).collect())) == want
        for r in got.select("doc_id", *names).collect():
            assert [r[c] for c in names] == [f"{c} of {r.doc_id}" for c in names]
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, plain, data).select("doc_id").collect()}
    assert {9000, 9002} <= kept and 9001 not in kept
