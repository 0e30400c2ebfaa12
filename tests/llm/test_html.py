from slantframe.llm import html_main
from slantframe.llm.html_main import extract_pages, main_text, style_trees

SCHEMA = "page_id long, url string, html string, host string"


def test_markup():
    assert main_text(None) == main_text("") == main_text("<nav>menu</nav>") == main_text("<!-- only -->") == ""
    assert main_text("a &amp; b&nbsp;&#233;<br>c <b>d</b>e<p>f\n\t g<p>h</i>") == "a & b é c de\n\nf g\n\nh"
    assert main_text('<script>var a="<p>x</p>";</script>x<style>p{}</style><textarea>t</textarea>') == "x"
    assert main_text("<title>no</title><p>1 < 2 & 3 > 2 &am &amp</p><li>i<li>j<td>k") == "1 < 2 & 3 > 2 &am &\n\ni\n\nj\n\nk"
    assert main_text('<div class="x" title="a > b">in</div><p') == "in"
    assert main_text("<p><b>one<br><p>two</b> three</p>four<!-- gone") == "one\n\ntwo three\n\nfour"
    assert main_text("<script>never ends <p>x") == "" and main_text("a<!--x--!>b<![CDATA[c]]>d</p>e<br/>f</br>g") == "abde f g"
    assert main_text("<div>" * 5000 + "deep" + "</div>" * 4000) == "deep"
    assert main_text("<div>" * 60_000 + "deep<p>er") == "deep\n\ner"
    long = "word " * 400_000
    assert main_text(f"<p>{long}</p>") == long.strip()


def test_names_and_articles():
    page = """<body class="has-sidebar"><header><h1>Site</h1></header><div class="siteNav">menu</div><p>lead</p>
    <article><header><h1>Title</h1></header><p>Body.</p><div class="ad-slot">buy</div><p>More <span class="share">tweet</span>text.</p>
    <form>mail</form><section id="comments"><article class="reply">me too</article></section><footer>by</footer></article>
    <aside>side</aside><div role="dialog">cookies</div><div hidden>secret</div><div style="display: none">secret</div></body>"""
    assert main_text(page) == "Title\n\nBody.\n\nMore text."
    assert main_text("<main><p>a</p></main><p>b</p>") == "a" and main_text("<p>a</p><div class=menu>b</div>") == "a"


def site(n, copies=0):
    out = []
    for i in range(n):
        menu = '<div class="x1"><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></div>'
        body = f'<div class="x2"><h1>Same title</h1><p>{"".join(f"word{i}x{j} " for j in range(20))}<p>Every page says this.</div>'
        out.append((i, f"http://s.example/{i}", f'<html><body>{menu}{body}<div class="x3">Read more</div><div class="x4">All rights</div></body></html>', "h"))
    return out + [(1000 + i, "http://S.example?again", out[0][2], "h") for i in range(copies)]


def test_a_tree_finds_unnamed_templates(spark):
    pages = site(30, copies=60) + [(500, "http://alone.example/", site(1)[0][2], "h"), (501, None, site(1)[0][2], "h"), (None, "no host", "<p>x</p>", "h"), (502, "http://s.example/", None, "h"), (502, "http://s.example/", "", "h")]
    df = spark.createDataFrame(pages, SCHEMA)
    for size in (html_main.BROADCAST_BYTES, 0):
        got = {r.page_id: r.text for r in extract_pages(df.repartition(4), broadcast_bytes=size).collect()}
        for i in range(30):
            words = "".join(f"word{i}x{j} " for j in range(20)).strip()
            assert got[i] == f"Same title\n\n{words}\n\nEvery page says this."
        assert got[1000] == got[0] and got[501] == got[500] != got[0] and "All rights" in got[500]
        assert got[None] == "x" and got[502] == "" and len(got) == 30 + 60 + 4
    few = {r.page_id: r.text for r in extract_pages(spark.createDataFrame(site(2), SCHEMA)).collect()}
    assert "All rights" in few[0]  # two pages say too little


def test_importance_is_entropy(spark):
    import math

    rows = [(i, "http://s.example/", f'<div class="a">{"same" if i < 4 else i}</div><div class="b">{i % 2}</div>{"<div class=c></div>" if i else ""}', "h") for i in range(8)]
    trees = {(r.pages, round(r.content, 9)): r.presentation for r in style_trees(spark.createDataFrame(rows, SCHEMA)).collect()}
    # Pages that say the same count once: 1 and 3 do, and 0 and 2 but for an element without text.
    distinct = len({html_main.summarised(html_main.read_page(r[2]))[0] for r in rows})
    assert distinct == 6
    shared, whole = math.log(2) / math.log(6), math.log(3) / math.log(6)
    assert (6, round(1 - shared / 5, 9)) in trees and (6, round(1 - whole, 9)) in trees and set(trees.values()) <= {0.0, 1.0}


def test_empty_table(spark):
    assert extract_pages(spark.createDataFrame([], SCHEMA)).count() == 0
