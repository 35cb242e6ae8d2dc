"""Main text of pages."""

import pytest

from trackscore.llm import htmlblocks

LONG = "Some way down the road there is a mill that grinds the corn of all the farms around here, large and small."


@pytest.fixture(scope="module")
def tree(spark):
    return htmlblocks.fit_tree(spark)


def test_tree_learns_its_table(tree):
    rows = htmlblocks.labelled_blocks()
    assert len(rows) > 40 and all(htmlblocks.verdict(tree, f) == bool(label) for label, f in rows)


PAGES = {
    "article": (f"<title>T</title><nav><a href=x>Home</a></nav><article><h1>Mill &amp; corn</h1><p>{LONG}<br>Yes<p>A  <b>b</b>c&nbsp;d"
                f"<ul><li>One<li>Two</ul><div class='ad-box'>{LONG}</div></article><footer>{LONG}</footer>",
                f"Mill & corn {LONG} Yes A bc d One Two"),
    "comments": (f"<main><p>{LONG}</p><section id=comments><p>{LONG}</p></section><form><p>{LONG}</p></form></main>", LONG),
    "no article": (f"<div><a href=a>One</a> <a href=b>Two</a></div><p>{LONG}</p><p>{LONG}</p><script>var p='<p>{LONG}</p>'</script>"
                   f"<style>p</style><div role=navigation>{LONG}</div><!-- {LONG} --><div style='display: none'>{LONG}</div>",
                   f"{LONG} {LONG}"),
    "broken": (f"<article><p>{LONG}<p <b>{LONG}<", None),
    "open comment": (f"<article><p>{LONG}<!-- {LONG}", LONG),
    "empty": ("", ""),
    "null": (None, ""),
    "long": ("<article>" + f"<p>{LONG}</p>" * 5000, " ".join([LONG] * 5000)),
    "entities": ("<article><p>&lt;p&gt; &#65;&#x42; &unknown; &copy</p></article>", "<p> AB &unknown; ©"),
}


def test_pages(spark, tree):
    rows = [(k, h, 7, "old") for k, (h, _) in PAGES.items()] + [("empty", "", 7, "old")]
    table = spark.createDataFrame(rows, "page_id string, html string, n_kept int, text string").repartition(3)
    got = htmlblocks.extract(table, tree=tree).collect()
    assert len(got) == len(rows)
    for r in got:
        want = PAGES[r.page_id][1]
        assert want is None or r.text == want, r.page_id
        assert r.n_chars == len(r.text)
    assert htmlblocks.extract(table.where("false"), tree=tree).collect() == []


def test_link_density_and_neighbours():
    blocks = htmlblocks.blocks_of("<p><a href=x>one two</a> three four</p><p>five</p>")
    rows = [dict(zip(htmlblocks.FEATURES, r)) for r in htmlblocks.features_of(blocks)]
    assert rows[0]["words"] == 4 and rows[0]["link_density"] == 0.5 and rows[0]["words_after"] == 1
    assert rows[1]["link_density_before"] == 0.5 and rows[1]["words_after"] == 0
