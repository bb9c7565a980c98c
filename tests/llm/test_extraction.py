import pytest

from trajlake.llm import extraction
from trajlake.llm.extraction import Page

FILLER = ["red fox", "blue jay", "green frog", "grey owl", "white hare", "black bear", "brown hen", "pink pig", "gold fish", "tan deer"]


def text(html, template=frozenset()):
    return "\n".join(Page(html).blocks(template))


@pytest.mark.parametrize(("html", "want"), [
    ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>a<p>b<div>c</div>d", "a\nb\nc\nd"),
    ("<body><nav><p>menu</nav><article><h1>T &amp;amp; t</h1><p>x  \n y<br>z</article><footer>f</footer>", "T &amp; t\nx y z"),
    ("<article><p>one<aside>side</aside><div class='post comments'><p>mine</p></div><form>in</form><p>two", "one\ntwo"),
    ("<article><header><h1>kept</h1></header><p>body</p></article><header>dropped</header>", "kept\nbody"),
    ("<div id=cookie-notice>c</div><div class='add-on'>kept</div><div role=navigation>n</div>", "kept"),
    ("<main><p>m</p></main><article>teaser</article>", "m"),
    ("<article>one</article><article>two<article>inner</article></article>", "one\ntwo\ninner"),
    ("<p><b>bold <i>both</b> after</i> end<br><p>next", "bold both after end\nnext"),
    ("<ul><li>a<li>b<ul><li>c</ul></ul><table><tr><td>d<td>e<tr><td>f</table>", "a\nb\nc\nd\ne\nf"),
    ("<script>if (a<b) '</p>'</script><style>p{}</style><p>t<!-- c --><noscript>n</noscript>", "t"),
    ("<p>&copy; &#8364; &eacute; &unknown; &am", "© € é &unknown; &am"), ("<p>a</b></div></p></p>b", "a\nb"),
    ("<div/>x<br/>y", "x y"), ("<p>cut <a href='", "cut"), ("<p hidden>no</p><p>  yes   it\tis</p>", "yes it is"),
])
def test_blocks(html, want):
    assert text(html) == want


def test_deep_and_long_pages():
    assert text("<div>" * 20_000 + "x") == "x"
    assert text("<article>" + "<p>word word</p>" * 50_000) == "\n".join(["word word"] * 50_000)


def test_subtree_hashes_see_tags_and_text_only():
    def hashes(html):
        return {h for h, _ in Page(html).counted()}

    assert hashes("<div class=a><p>x  y</p></div>") == hashes("<div class=b><p> x y</p></div>")
    assert not hashes("<div><p>x</p></div>") & hashes("<section><h2>x</h2></section>")
    assert hashes("<nav><ul><li>x</ul></nav>") and len(hashes("<nav><ul><li>x</ul></nav>")) == 1


def story(k):
    return " ".join(f"{FILLER[(k * m) % 10]} {k}{m}" for m in range(1, 9))


def site(spark, pages):
    return spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id bigint, url string, html string")


def test_templates_of_a_site(spark):
    def page(k, same):
        own = story(k)
        box = f"<div class='k'><p>Read also our weekly letter</p></div><p>{FILLER[k % 2]} is common here</p>"
        return f"<div>Start Shop About</div><div>Offer {k % 7}</div><article><h1>Head {k}</h1><p>{own}</p>{box if same else ''}</article>"

    pages = [(f"http://a.example/{k}", page(k, True)) for k in range(60)] + [(f"http://b.example/{k}", page(k, True)) for k in range(3)]
    pages += [("http://a.example/soup", "<div>Start Shop About</div><div>Offer 3</div><p>only this is of the page itself</p>"), (None, page(1, True)), ("no url", "<p>x")]
    rows = {r["page_id"]: r for r in extraction.extract(site(spark, pages)).collect()}
    for k in range(60):
        want = [f"Head {k}", story(k), f"{FILLER[k % 2]} is common here"]
        assert rows[k]["text"].split("\n") == want  # the letter box goes, a passage on half of the pages stays
    assert all("Read also" in rows[60 + k]["text"] for k in range(3))  # three pages show no recurrence
    assert rows[63]["text"] == "only this is of the page itself"
    assert "Read also" in rows[64]["text"] and rows[65]["text"] == "x" and all(r["n_chars"] == len(r["text"]) for r in rows.values())


def test_copies_of_one_text_are_no_template(spark):
    body = "<p>a story told again and again on this host</p><p>with a second part</p>"
    near = [f"<article><h1>same head</h1>{body}<p>{FILLER[k % 10] if k % 5 else ''}</p></article>" for k in range(40)]
    rows = extraction.extract(site(spark, [("http://c.example/x", h) for h in near])).collect()
    assert all(r["text"].startswith("same head\na story told again and again on this host\nwith a second part") for r in rows)


def test_odd_rows_and_clashing_names(spark):
    rows = [(1, None, None), (2, "", ""), (2, "", ""), (None, "http://h.example", "<p>x"), (4, "http://h.example/y", "<p>" + "w " * 100_000)]
    pages = spark.createDataFrame([(*r, "h", [1], 7, True) for r in rows], "page_id bigint, url string, html string, host string, template array<int>, subtree int, inside boolean")
    got = sorted(((r["page_id"] or 0, r["url"], len(r["text"]), r["n_chars"]) for r in extraction.extract(pages).collect()), key=str)
    assert got == sorted([(1, None, 0, 0), (2, "", 0, 0), (2, "", 0, 0), (0, "http://h.example", 1, 1), (4, "http://h.example/y", 199_999, 199_999)], key=str)
    assert extraction.extract(pages.limit(0)).count() == 0
