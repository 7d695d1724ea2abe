import time

from faultline.llm.html_extraction import extract_text, main_blocks

PROSE = "The words of this long paragraph are there for the reader, and it is as plain as it can be, with a lot of the small words that prose has in it. " * 2


def kept(page):
    return [text for text, good in main_blocks(page) if good]


def test_markup_and_references():
    page = (
        "<!DOCTYPE html><html><head><title>T &lt;</title><style>p{}</style><script>if (a < b) '</p>'</script></head><body class='has-sidebar'><header><h1>Site</h1></header>"
        f"<nav><ul><li><a href='/'>Home</a></ul></nav><article><header><h1>Caf&eacute; &amp;amp; more</h1></header><!-- <p>no --><P>{PROSE}\n x&nbsp; &#x41;&copy<b>b</b>c<br>d 1 < 2"
        "<form><p>Name <input></form><p>Short.<aside>Aside</aside><div class='ad banner'>Buy</div><p>yes <button>Share</button> &am"
        "<section id='comments'><article><p>Reader says the thing of the day</article></section></article><footer>&copy; x</footer>"
    )
    assert kept(page) == ["Café &amp; more", f"{PROSE}".strip() + " x A©bc d 1 < 2", "Short.", "yes &am"]


def test_density_without_marks():
    menu = "<ul>" + "".join(f"<li><a href='/{i}'>Item {i}</a></li>" for i in range(5)) + "</ul>"
    page = f"<div>{menu}</div><div>Menu end</div><div><h1>Title here</h1><p>{PROSE}</p><p>A short one.</p><p>{PROSE}</p><p>Last.</p></div><div>{menu}</div><div>Tail note</div><div>&copy; 2024 Somebody</div>"
    assert kept(page) == ["Title here", PROSE.strip(), "A short one.", PROSE.strip(), "Last."]
    assert kept(menu) == [] and kept("<p>alone") == []
    codes = "<p>" + "x1 y2 z3 " * 40  # long, without stop words
    assert kept(codes) == [] and kept("<article>" + codes) == [("x1 y2 z3 " * 40).strip()]


def test_unclosed_and_nested():
    assert kept("<div class=ad>a<nav>b<article><p>c<aside>d</aside>e<footer>f</article>g") == ["c", "e"]
    assert kept("<div class=comments><article>a</article></div><main><p>b</main>") == ["b"]
    assert kept("<article><p>a <a href=x>b</a><ul><li><a href=x>menu</a><li><a href=y>menu</a></ul><p>c") == ["a b", "c"]
    assert kept("<article>a<script>b") == ["a"] and kept("<article>a<!-- b <p>c") == ["a"] and kept("<article>a<p title='x>y'>b<i") == ["a", "b"]
    assert kept("<article>a<table><tr><td>b<td>c<tr><td>d</table><dl><dt>e<dd>f</dl><hr>g<p hidden>h<p style='display: none'>i</p>j") == list("abcdefgj")
    assert kept("") == kept(None) == kept("<<<>>></ ><!>") == []


def test_names_of_layouts():
    assert kept("<div class='sidebar-layout'><nav>n</nav><article><p>a<p class='ad'>b</article></div>") == ["a", "b"]  # names aren't heeded then
    assert kept("<div class='has-sidebar'><article><p>a<p class='ad'>b</article></div>") == ["a"]
    assert kept("<div class='comments'><p>" + PROSE + "</div>") == []


def test_linear_time():
    began = time.time()
    for bit in ("<a \"", "<!--", "<div>", "<p>x", "<li>", '<a ="', "&", "<b class=ad>", "</i>", "<tr>", "<script>", "<p>x <a href=y>z"):
        main_blocks(bit * 50_000)
        main_blocks("<article>" + bit * 50_000 + ">" + "</i>" * 50_000)
    assert time.time() - began < 60


def test_table(spark):
    rows = [(1, "u", "<article><p>One &amp; two</p><p>𝒳</p></article>"), (1, "u", "<article><p>One &amp; two</p><p>𝒳</p></article>"), (2, None, None), (None, "v", ""), (3, "w", "<article><p>" + "long text " * 200_000)]
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "page_id long, url string, html string, text string, n_blocks int")
    got = sorted((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in extract_text(df).collect())
    long = ("long text " * 200_000).strip()
    assert got == sorted([(1, "u", "One & two\n\n𝒳", 12)] * 2 + [(2, "", "", 0), (0, "v", "", 0), (3, "w", long, len(long))])
    assert extract_text(df.limit(0)).count() == 0
