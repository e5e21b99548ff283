import random

import pytest
from pyspark.sql import functions as F

from vecshift.llm import urls as U
from vecshift.llm.html import extract, main_text

CASES = [
    ("http://Blog.Example.COM/en/712?x=1", "blog.example.com", "/en/712"),
    ("https://example.net/de/81#top", "example.net", "/de/81"),
    ("https://notexample.net/de/81", "notexample.net", "/de/81"),
    ("x://org/es/", "org", "/es/"),
    ("x://org", "org", ""),
    ("a://b://c/d", "b:", "//c/d"),
    ("http://h?q=/x://", "h", ""),
    ("no scheme/en/1", "", ""),
    ("", "", ""),
    (None, "", ""),
    ("://", "", ""),
    ("http://a.com/en/" + "9/" * 3000, "a.com", "/en/" + "9/" * 3000),
    ("http://a.com/en\n/x y", "a.com", "/en\n/x y"),
]


def brute_rule(host, path):
    best = None
    for v, r in U.RULES:
        h, p = r.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(r) > len(best[1])):
            best = (v, r)
    return best


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(i, u) for i, (u, _, _) in enumerate(CASES)] + [(None, CASES[0][0]), (0, CASES[0][0])], "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("n", F.lit(1))


def test_host_path_and_rules(spark, pages):
    labels = U.bad_labels(spark.createDataFrame([(712, 1, 0), (81, 0, 0), (None, 0, 1)], "doc_id long, quality int, toxic int"))
    out = U.url_filter(pages, labels, U.RULES).collect()
    assert len(out) == len(CASES) + 2
    for r in out:
        if r.page_id is not None:
            _, h, p = CASES[r.page_id]
            assert (r.host, r.path) == (h, p)
        best = brute_rule(r.host, r.path)
        assert r.rule == (best[1] if best else None)
        assert r.verdict in ("allow", "block") and (not best or r.verdict == best[0])
    assert U.url_filter(pages.limit(0), labels, U.RULES).count() == 0


def test_deep_paths_are_generalised_and_merged(spark, monkeypatch):
    """Variable segments and branches behind the tenth segment; a lone path of a thousand segments beside them."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("ghijklm") for _ in range(8))
    deep = "/".join("abcdefghijk")
    rows = [f"http://d.com/{deep}/{word()}/end" for _ in range(60)] + [f"http://d.com/{deep}/{x}/y/{i}" for x in ("p", "q") for i in range(40)]
    rows.append("http://d.com/" + "z/" * 1000)
    out = U.url_filter(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string"), U.bad_labels(spark.createDataFrame([], "doc_id long, quality int, toxic int")), []).collect()
    by = {r.page_id: r.template for r in out}
    assert len(out) == len(rows) and {by[i] for i in range(60)} == {f"/{deep}/*/end"}
    assert {by[i] for i in range(60, 140)} == {f"/{deep}/*/y/*"} and by[140] == "/" + "z/" * 1000


def brute_verdicts(rows, labels):
    """(page_id, url) and number -> bad: (template, badness, verdict) by the rules of the module docstring, path by path."""
    import re
    from collections import defaultdict

    var = re.compile(r"^(?:[0-9]+(?:[-_.][0-9]+)*|[0-9a-fA-F]{8,}|[0-9a-fA-F]{8}-[0-9a-fA-F-]{27})(?=$|\.[A-Za-z]{1,5}$)")
    shapes, n, lab, bad = {}, defaultdict(int), defaultdict(int), defaultdict(int)
    for i, u in rows:
        host, path = re.match(r"\w+://([^/?#]*)([^?#]*)", u).groups()
        s = shapes[i] = (host.lower(), tuple(var.sub("*", x) for x in path.split("/")))
        n[s] += 1
        m = re.search(r"([0-9]+)[^0-9]*$", path)
        if m and int(m[1]) in labels:
            lab[s] += 1
            bad[s] += labels[int(m[1])]
    deepest = max(len(s) for _, s in n)
    tpl = {s: s[1] for s in n}
    for d in range(deepest):
        places = defaultdict(lambda: defaultdict(int))
        for s, t in tpl.items():
            if len(t) > d:
                places[s[0], t[:d]][t[d]] += n[s]
        for s, t in tpl.items():
            p = places.get((s[0], t[:d]), {})
            if len(t) > d and len(p) >= U.MANY and sum(p.values()) < U.ROWS_EACH * len(p):
                tpl[s] = (*t[:d], "*", *t[d + 1 :])
    base = (sum(bad.values()) + U.STRENGTH * U.PRIOR) / (sum(lab.values()) + U.STRENGTH)
    leaf = defaultdict(lambda: [0, 0])
    for s, t in tpl.items():
        leaf[s[0], t][0] += lab[s]
        leaf[s[0], t][1] += bad[s]
    final = {k: k[1] for k in leaf}
    for d in range(deepest):
        node = defaultdict(lambda: [0, 0])
        for k, f in final.items():
            node[k[0], f][0] += leaf[k][0]
            node[k[0], f][1] += leaf[k][1]
        star = lambda f: (*f[:d], "*", *f[d + 1 :]) if len(f) > d else f  # noqa: E731, B023
        pool = defaultdict(lambda: [0, 0, 0])
        for (h, f), (a, b) in node.items():
            x = pool[h, star(f)]
            x[0] += a
            x[1] += b
            x[2] += 1
        to = {}
        for (h, f), (a, b) in node.items():
            pl, pb, k = pool[h, star(f)]
            if k > 1:
                q = U.STRENGTH
                rate = (pb + q * base) / (pl + q)
                gap = abs((b + q * base) / (a + q) - (pb - b + q * base) / (pl - a + q))
                if gap <= U.Z * (rate * (1 - rate) * (1 / (a + q) + 1 / (pl - a + q))) ** 0.5:
                    to[h, f] = star(f)
        final = {k: to.get((k[0], f), f) for k, f in final.items()}
    total = defaultdict(lambda: [0, 0])
    for k, f in final.items():
        total[k[0], f][0] += leaf[k][0]
        total[k[0], f][1] += leaf[k][1]
    out = {}
    for i, s in shapes.items():
        f = final[s[0], tpl[s]]
        p = (total[s[0], f][1] + U.STRENGTH * base) / (total[s[0], f][0] + U.STRENGTH)
        out[i] = ("/".join(f), p, "block" if p >= U.LIMIT else "allow")
    return out


def test_method_equals_brute_force(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("ghijk") for _ in range(rng.randint(1, 7)))
    rows = []
    for i in range(900):
        host = rng.choice(["a.com", "b.org", "sub.a.com"])
        x = [rng.choice(["en", "de", "spam", "news"]), *([word()] if rng.random() < 0.5 else ["top"]), *(rng.choice(["p", "q"]) for _ in range(rng.randint(0, 3))), f"{i}.html" if rng.random() < 0.5 else str(i)]
        rows.append((i, f"http://{host}/" + "/".join(x)))
    labels = {i: int(("spam" in u) ^ (rng.random() < 0.1)) for i, u in rows if rng.random() < 0.5}
    real = [(10_000 + r.page_id, r.url) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect() if r.url and "://" in r.url]
    table = spark.createDataFrame([(k, 1 - v, 0) for k, v in labels.items()], "doc_id long, quality int, toxic int")
    out = U.url_filter(spark.createDataFrame(rows + real, "page_id long, url string").repartition(3), U.bad_labels(table), []).collect()
    want = brute_verdicts(rows + real, labels)
    assert {r.page_id: (r.template, r.verdict) for r in out} == {k: (t, v) for k, (t, _, v) in want.items()}
    assert all(abs(r.badness - want[r.page_id][1]) < 1e-6 for r in out)
    assert {v for *_, v in want.values()} == {"allow", "block"}


def test_templates_and_purity(spark):
    rng = random.Random(6)
    rows = [(i, f"http://bad.com/spam/{i}") for i in range(200)] + [(i, f"http://bad.com/news/{i}") for i in range(200, 400)]
    rows += [(i, f"http://free.com/{''.join(rng.choice('ghijk') for _ in range(9))}/page/{i}") for i in range(400, 500)]
    rows += [(i, f"http://mix.com/{('a', 'b', 'c')[i % 3]}/{i}") for i in range(500, 800)]
    labels = [(i, 0 if i < 200 and i % 10 else 1, 0) for i in range(0, 800)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    out = {r.page_id: r for r in U.url_filter(df, U.bad_labels(spark.createDataFrame(labels, "doc_id long, quality int, toxic int")), []).collect()}
    assert {out[i].verdict for i in range(200)} == {"block"} and {out[i].verdict for i in range(200, 800)} == {"allow"}
    assert {out[i].template for i in range(200)} == {"/spam/*"} and {out[i].template for i in range(200, 400)} == {"/news/*"}
    assert {out[i].template for i in range(400, 500)} == {"/*/page/*"}
    assert {out[i].template for i in range(500, 800)} == {"/*/*"}


def test_no_labels(spark, pages):
    none = U.bad_labels(spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r.verdict for r in U.url_filter(pages, none, []).collect()} == {"allow"}


PAGES = [
    (None, ""),
    ("", ""),
    ("<p></p>", ""),
    ("just text & more", "just text & more"),
    ("<article><h1>T &amp; x</h1><p>a\n  b<b>c</b> d<p>e</article>", "T & x\na bc d\ne"),
    ("<nav><a href=x>menu</a></nav><div class=ad>buy</div><article><header><h1>Head</h1><span>by me</span></header><p>Body one.</p><div class='comments'><p>nice!</p></div></article><footer>foot</footer>", "Head\nBody one."),
    ("<div id='content'><p>One, two, three, and a long text about it.</p><ul><li>x<li>y</ul><script>var t='</p>';</script><p>end&nbsp;here&#33;</p></div><div class=sidebar><p>aside, text, with, commas, a, lot, of, them.</p></div>", "One, two, three, and a long text about it.\nx\ny\nend here!"),
    ("<body><p>a<!-- <p>no</p> --><form><p>f</p></form><style>p{}</style><p>b", "a\nb"),
    ("<article><p>x<br>y</p><table><tr><td>1<td>2<tr><td>3</table></article>", "x y\n1\n2\n3"),
    ("<article><p>open <a href='q>never closed", "open never closed"),
    ("<article>" + "<p>w</p>" * 5000 + "</article>", "\n".join(["w"] * 5000)),
    ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
    ("<article><div class=cookie-notice>We use cookies</div><p>x</p><aside>y</aside></article>", "x"),
]


@pytest.mark.parametrize("page,want", PAGES)
def test_extract(page, want):
    assert extract(page) == want


def test_real_pages_are_whole(spark):
    d = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{d}/pages.parquet").withColumn("text", F.lit("clash"))
    docs = {str(r.doc_id): r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    out = main_text(pages).collect()
    assert len(out) == pages.count()
    for r in out:
        lines = [" ".join(x.split()) for x in docs[r.url.split("://")[1].split("/")[2].split(".")[0].split("?")[0].split("#")[0]].split("\n")]
        assert r.text.split("\n")[1:] == [x for x in lines if x] and r.n_chars == len(r.text)
    assert main_text(pages.limit(0)).count() == 0


NAMED = [
    ("<div class='content has-sidebar'><h1>T</h1><p>The text, all of it.</p></div>", "T\nThe text, all of it."),
    ("<article class='post comments-open'><p>The text.</p></article>", "The text."),
    ("<div class='content-sidebar-wrap'><p>The text is here, and it is long.</p></div><div class='sidebar'><p>aside</p></div>", "The text is here, and it is long."),
    ("<article><h2 id='search'>Search</h2><p>x</p><table><tr class='header'><td>1</td></tr></table></article>", "Search\nx\n1"),
    ("<div class='menu'><p>Nothing but this.</p></div>", "Nothing but this."),
    ("<form id=aspnet><p>A page in a form.</p></form>", "A page in a form."),
    ("<div id='page' class='widget'><h1>T</h1><p>One, two, three.</p></div><div class=ad>buy</div>", "T\nOne, two, three."),
    # these go
    ("<article><p>x</p></article><div id='comments' class='comments-area'><p>" + "much said, " * 50 + "</p></div>", "x"),
    ("<article><p>The text is long enough.</p><div class='share-buttons'>tweet</div><ul><li class=ad>buy<li>y</ul></article>", "The text is long enough.\ny"),
    ("<p hidden>no</p>", ""),
    # nothing but what is left out
    ("<nav>Menu one</nav>", ""),
    ("<footer>copyright</footer>", ""),
    ("<header><p>Site</p></header><aside><p>more, and more</p></aside>", ""),
    ("<form><label>Name</label><input name=n><button>Send</button></form>", ""),
    ("<form><fieldset><legend>You</legend><p>Name: <input name=n></p></fieldset></form>", ""),
    ("<div role=navigation><p>Here, there.</p></div>", ""),
    ("<div id='comments'><p>nice, very nice</p></div>", ""),
    # content that looks like it
    ("<article><p>The formula <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds.</p></article>", "The formula x=1 holds."),
    ("<article><p>A <object data=x><b>kind</b> of</object> film.</p></article>", "A kind of film."),
    ("<article><p>x, y</p><p class='related-work'>Others did so.</p><ul><li class='social-science'>Max</ul></article>", "x, y\nOthers did so.\nMax"),
    ("<article><p>x, y</p><section id='code-comments'><h2>Comments in code</h2><p>Write few.</p></section></article>", "x, y\nComments in code\nWrite few."),
    ("<article><p>See</p><pre><span class='comment'># no</span> a = 1</pre></article>", "See\n# no a = 1"),
    ("<article><div class='post-header'><h1>T</h1></div><p>x</p></article>", "T\nx"),
    ("<article><p>The text, in whole.</p><div class='related-stuff'><a href=a>One</a> <a href=b>Two</a></div><div class='inline-ad'>Buy.</div></article>", "The text, in whole."),
    ("<h1>T</h1><div class='widget'><p>The only text, in whole.</p></div>", "T\nThe only text, in whole."),
]
TALKED = ["id='comment-list'", "id='comments-section'", "class='comment-body'", "class='comments-open'", "id='comments' class='comments-area'", "class='comments-open comment-thread'"]


@pytest.mark.parametrize("name", TALKED)
@pytest.mark.parametrize("inner", ["<p>%s</p>", "<ol class='comment-list'><li><article class='comment-body'><p>%s</p></article></li></ol>", "<article><p>%s</p></article>", "%s"])
def test_long_comments_go_beside_a_short_article(name, inner):
    talk = f"<div {name}>" + inner % ("much said, by many, " * 60) + "</div>"
    assert extract(f"<body><article><p>The text.</p></article>{talk}</body>") == "The text."
    assert extract(f"<body><div class=post><h1>T</h1><p>The text.</p>{talk}</div></body>") == "T\nThe text."


@pytest.mark.parametrize("page,want", NAMED)
def test_names_drop_no_article(page, want):
    assert extract(page) == want


LEAD = "Here the lead stands, in whole sentences, and it is long enough to be read."
BODY = "".join(f"<p>Sentence {i} of the article, with a comma, and some more words to read.</p>" for i in range(6))


@pytest.mark.parametrize(
    "page",
    [
        f'<html><body><form id="f"><div>Top</div><article><h1>T</h1><p>{LEAD}</p>{BODY}</article></form><footer>x</footer></body></html>',
        f'<html><body><div>Top</div><form><fieldset><article><h1>T</h1><p>{LEAD}</p>{BODY}</article></fieldset></form></body></html>',
        f'<body><article><header><h1>T</h1><p>{LEAD}</p><span>By someone</span></header>{BODY}</article></body>',
        f'<body><article class="post comments-open"><h1>T</h1><p>{LEAD}</p>{BODY}</article></body>',
        f'<body class="x"><div class="with-sidebar"><h1>T</h1><p>{LEAD}</p>{BODY}</div><div class="sidebar"><p>Side</p></div></body>',
        f'<body><div id="share-story"><h1>T</h1><p>{LEAD}</p>{BODY}</div></body>',
        "<body>" + "<div>" * 30 + f"<article><h1>T</h1><p>{LEAD}</p>" + "<section><div>" * 12 + BODY + "</div></section>" * 12 + "</article></body>",
    ],
)
def test_article_is_whole(page):
    got = extract(page)
    assert got.startswith(f"T\n{LEAD}\nSentence 0") and "Sentence 5" in got
    assert not any(x in got for x in ("Side", "someone"))


@pytest.mark.parametrize("piece", ["<a href='", "<a href=\"x' ", "<b ", "<div></p></i>", "<b><p>x", "<div class aaaa", "<!-", "</", "<td><b>x", "<li><b>x<hr>", "<script", "&amp;<", "<p title='\">x"])
def test_two_megabytes_of_broken_markup_take_seconds(piece):
    import time

    def seconds(n):
        t = time.process_time()
        extract(piece * (n // len(piece)))
        return time.process_time() - t

    assert seconds(2_000_000) < 60
