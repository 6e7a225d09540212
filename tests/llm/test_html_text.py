from gazeframe.llm.html_text import TABLE, TREE, decide, extract, extract_pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";x(0);</script></head><body>
<div class="cookie-notice">We use cookies.</div><header><h2>Site</h2></header><nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></ul></nav><!-- ad <p>no</p> -->
<div class="ad">Buy this now and here.</div><div class="page sidebar-right"><article><header><h1>The &amp; title</h1></header><p><b>First   one.<br><p>Second&nbsp;one with <a href="x">a link</a> in it.</p>
<p>Be.</p><aside>Pull quote of a thing</aside><ul><li>One</li><li>Two</ul><form><label>Mail</label><input></form><p>a &lt; b &copy; 1 < 2</p>
<section class="comments"><article class="comment"><p>Nice words from a reader, long enough to look like text.</p></article></section></article></div>
<aside class="sidebar"><p>Some other stories that are long enough to be kept by length alone, perhaps.</p></aside><footer>&copy; x &middot; Imprint</footer></body></html>"""


def test_page():
    assert extract(PAGE) == "The & title\nFirst one.\nSecond one with a link in it.\nBe.\nOne\nTwo\na < b © 1 < 2"


def test_odd_pages():
    assert extract(None) == extract("") == extract("<!-- x") == extract("<script>a") == extract("<p") == ""
    assert extract("Just a short text") == "Just a short text"
    assert extract("<article><p>Cut &am") == "Cut &am"
    assert extract("<article><p>Open <b class=\"x>tail</article>") == "Open tail"
    assert extract("<head><title>x</title><body><article>Text") == "Text"
    long = "word " * 30
    assert extract(f"<div><a href=x>Home</a></div><div>{long}</div><div>{long}</div><div><a>One</a> <a>Two</a></div>") == f"{long.strip()}\n{long.strip()}"
    assert extract("<article>" + "<p>x y</p>" * 20000 + "</article>").count("\n") == 19999


def test_tree_learnt_its_table():
    right = [decide(TREE, tuple(r[:-1])) == r[-1] for r in TABLE]
    assert sum(right) / len(right) >= 0.95


def test_frame(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "old"), (2, None, None, "old"), (2, None, None, "old")], "page_id long, url string, html string, text string")
    got = sorted(extract_pages(df).collect(), key=lambda r: r.page_id)
    assert [r.n_chars for r in got] == [len(extract(PAGE)), 0, 0] and got[0].text == extract(PAGE) and got[1].text == ""
    assert extract_pages(df.limit(0)).count() == 0


def test_unclosed_and_nested_elements_lose_nothing_after_them():
    first, last = "This is the first paragraph of the article, long enough.", "And this is the tail of it, which has to stay as well."
    for tag in ("button", "svg", "select", "map", "canvas", "video", "object", "math", "audio"):
        page = f"<body><article><p>{first}</p>%s<p>{last}</p></article></body>"
        for piece in (f"<{tag}>", f"<{tag}/>", f"<{tag} class='a' />", f"<{tag}>inner words</{tag}>", f"<{tag}>a<{tag}>b</{tag}>inner words</{tag}>"):
            if tag in ("button", "select") and piece.endswith("/>") and "class" not in piece:
                continue
            assert extract(page % piece) == f"{first}\n{last}", (tag, piece)
        later = f"<article><p>{first}</p><{tag}><p>{last}</p></article><div><{tag}>menu</{tag}></div>"
        assert extract(later) == f"{first}\n{last}", tag


def test_names_mark_only_the_part_that_they_name():
    first, last = "This is the first paragraph of the article, long enough.", "And this is the tail of it, which has to stay as well."
    for head in ("<body class='has-sidebar'>", "<body class='menu'>", "<body><div class='content no-comments'>", "<body><div title='id=ads class=footer'>"):
        assert extract(f"{head}<p>{first}</p><p>{last}</p></body>") == f"{first}\n{last}", head
    assert extract(f"<article><header class='entry-header'><h1>Headline</h1></header><p>{first}</p></article>") == f"Headline\n{first}"
    assert extract(f"<p title='id=ads'>{first}</p><p>{last}</p>") == f"{first}\n{last}"
    assert extract(f"<article><p>{first}</p></article><div id=comments><p>{last}</p></div>") == first
