import html
import math
import random
import re
import tracemalloc
from collections import Counter, defaultdict

from specloom.llm import html as operator
from specloom.llm.html import MIN_IMPORTANCE, PRESENTATION, PRIOR_PAGES, Page, importances, page_texts, style_features


def text_of(source):
    return Page(source).main_text(frozenset())[0]


def test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r for r in page_texts(pages).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in re.split(r"</?(?:h1|p)>", article)]
        text = "\n\n".join(filter(None, blocks))
        assert (got[r["page_id"]]["text"], got[r["page_id"]]["n_chars"], got[r["page_id"]]["url"]) == (text, len(text), r["url"])


def test_markup():
    assert text_of("<p>One &amp; two<br>th<b>ree</b><p>Four<ul><li>a<li>b</ul>") == "One & two three\n\nFour\n\na\n\nb"
    assert text_of("<title>t</title><body><nav>n</nav><header>h</header><main><p>in</p><aside>s</aside></main><footer>f</footer>") == "in"
    assert text_of('<div class="cookie-notice">c</div><div id="comments"><p>x</div><form>f</form><p>kept</p><!-- <p>no</p> -->') == "kept"
    assert text_of('<script>if (a < b) { "</p><p>no" }</script><style>p{}</style><p>yes</p>') == "yes"
    assert text_of('<p title="a>b">q</p> tail <') == "q\n\ntail <" and text_of("") == "" and text_of("plain &nbsp; text") == "plain text"
    assert text_of("<article><header><h1>T</h1></header><p>p</p></article><p>out</p>") == "T\n\np"
    assert text_of("<table><tr><td>a<td>b<tr><td>c</table>") == "a\n\nb\n\nc"
    assert text_of("<p>a" * 3000).count("a") == 3000 and text_of("<div>" * 3000 + "deep") == "deep"


def test_words_of_a_class_dont_delete_pages():
    """A noise word counts alone or among neutral ones, never for body, main or article, nor for what holds the whole page."""
    assert text_of('<body class="right-sidebar"><article><p>Hello world</p></article></body>') == "Hello world"
    assert text_of('<body class="no-sidebar page"><main><p>Hello world</p></main></body>') == "Hello world"
    assert text_of('<body><form id="aspnet"><nav>menu of many words</nav><div><p>Hello world</p></div></form></body>') == "Hello world"
    assert text_of('<article><p class="share-price notice-period">Prices</p><div class="ad-hoc">Ad hoc</div></article>') == "Prices\n\nAd hoc"
    assert text_of('<head><title>t</title><body class="page"><p>No end of head</p>') == "No end of head" == text_of("<head><meta x><p>No end of head")
    words = "words of the page itself " * 9
    kept = words.strip()
    for noise in ('<div class="site-footer">', '<div class="sidebar-left">', '<section id="comments">', '<div class="post-comments"><article class="comment">', "<form>", '<div role="search">'):
        assert text_of(f"<div><p>{words}</p></div>{noise}<p>not this</p>") == kept
    assert text_of(f"<p>{words}<span class='ad'>buy</span><button>go</button></p>") == kept


def test_deep_pages_take_linear_memory():
    sizes = []
    for n in (10_000, 40_000):
        tracemalloc.start()
        assert text_of("<b>" * n + "deep") == "deep"
        sizes.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert sizes[1] < 100e6 and sizes[1] < 5 * sizes[0]
    assert text_of("<b>" * 20_000 + "</i>" * 20_000 + "x<p>" * 20_000).count("x") == 20_000


def nodes_of(source):
    """The (path, own text, text of the whole branch) of the divs of a page made of divs alone, and their blocks in order."""
    found, blocks, stack = [], [], []
    for part in re.findall(r"<[^>]*>|[^<]+", source):
        if part.startswith("</"):
            path, texts, children = stack.pop()
            found.append((path, tuple(texts), tuple(children)))
            if stack:
                stack[-1][1].extend(texts)
        elif part.startswith("<"):
            name = re.search('"(.*)"', part).group(1)
            if stack:
                stack[-1][2].append("div")
            stack.append(((*(stack[-1][0] if stack else ()), name), [], []))
        else:
            stack[-1][1].append(part)
            blocks.append((stack[-1][0], part))
    return found, blocks


def test_entropy_against_brute_force(spark):
    """A host of many nodes and no article: importances and texts are those of the definition."""
    r = random.Random(4)
    pages = {}
    for k in range(40):
        inner = "".join(f'<div class="item">{r.choice(["red", "blue", f"own {k} {j}"])}</div>' for j in range(r.randint(1, 3)))
        pages[k] = (
            f'<div class="page"><div class="top">Same top</div><div class="mid">{r.choice(["one", "two"])}</div><div class="list">{inner}</div>'
            f'<div class="deep"><div class="x"><div class="y">{"Always" if r.random() < 0.9 else f"Once {k}"}</div></div></div><div class="story">Story {k}</div></div>'
        )
    table = spark.createDataFrame([(k, "http://h.example/", p) for k, p in pages.items()], "page_id long, url string, html string")
    shapes, contents, wholes = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for source in pages.values():
        found, blocks = nodes_of(source)
        runs = lambda c: c[:1]  # noqa: E731 - all children are divs, and a run of them is one
        for x in {(p, runs(c)) for p, _, c in found}:
            shapes[x[0]][x[1]] += 1
        for x in {(p, t) for p, t, _ in found if t}:
            wholes[x[0]][x[1]] += 1
        for x in set(blocks):
            contents[x[0]][x[1]] += 1
    importance, shape_part = {}, {}
    for p, of in shapes.items():
        m = sum(of.values())
        if m < 2:
            continue
        shape_part[p] = -sum(n / m * math.log(n / m) for n in of.values()) / math.log(m)
        value = shape_part[p]
        if contents[p]:
            pairs = sum(contents[p].values())
            mean = sum(n * math.log(n) for n in contents[p].values()) / pairs
            value = PRESENTATION * value + (1 - PRESENTATION) * (1 - mean / math.log(m))
        importance[p] = (m * value + PRIOR_PAGES) / (m + PRIOR_PAGES)
    got = importances(style_features(table.selectExpr("html", "'h' AS host"))).collect()
    assert sorted(round(x["importance"], 9) for x in got) == sorted(round(x, 9) for x in importance.values())

    def goes(path, text, whole):
        m = sum(shapes[path].values())
        if importance[path] < MIN_IMPORTANCE or 2 * contents[path][text] > m + PRIOR_PAGES:
            return True
        for d in range(1, len(path) + 1):
            p = path[:d]
            m, n = sum(shapes[p].values()), max(wholes[p][w] for w in whole[p])
            own = PRESENTATION * shape_part[p] + (1 - PRESENTATION) * (1 - math.log(n) / math.log(m))
            if n > 1 and (m * own + PRIOR_PAGES) / (m + PRIOR_PAGES) < MIN_IMPORTANCE:
                return True
        return False

    texts = {x["page_id"]: x["text"] for x in page_texts(table).collect()}
    gone = Counter()
    for k, source in pages.items():
        found, blocks = nodes_of(source)
        whole = defaultdict(list)
        for p, t, _ in found:
            if t:
                whole[p].append(t)
        # items of one list have one path: which of them a block lies in is told by its own text
        expected = [t for p, t in blocks if not goes(p, t, whole | {p: [(t,)]})]
        assert texts[k] == "\n\n".join(expected)
        gone.update(p[-1] for p, t in blocks if t not in expected)
    assert gone["top"] == 40 and gone["y"] > 25 and not gone["story"]


def test_many_unimportant_nodes(spark, monkeypatch):
    """Where the nodes are too many to tell all tasks, the join gives the same; a hot host and the empty one are dealt to several tasks."""
    page = lambda k: f'<div class="box">Same words everywhere</div><div class="text"><p>Story {k}</p></div>'
    rows = [(k, "http://a.example/" if k % 3 else None, page(k)) for k in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    expected = sorted(map(tuple, page_texts(pages).collect()), key=repr)
    assert all(r[2].startswith("Story") for r in expected)
    monkeypatch.setattr(operator, "BROADCAST_NODES", 0)
    monkeypatch.setattr("specloom.llm.common.HOT_SHARES", 4)
    monkeypatch.setattr("specloom.llm.common.LEAST_HOT", 1)
    assert sorted(map(tuple, page_texts(pages).collect()), key=repr) == expected


def test_style_tree(spark):
    """A host's repeated box goes, what differs from page to page stays; copies of a page count once."""
    page = lambda k: f'<div class="box">Same words everywhere</div><div class="text"><p>Story {k} is told here</p></div>'
    rows = [(k, f"http://a.example/{k}", page(k)) for k in range(12)] + [(100 + k, "http://b.example/", page(1)) for k in range(12)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(1)
    got = {r["page_id"]: r["text"] for r in page_texts(pages).collect()}
    assert all(got[k] == f"Story {k} is told here" for k in range(12))
    assert all(got[100 + k] == "Same words everywhere\n\nStory 1 is told here" for k in range(12))
    table = importances(style_features(pages.selectExpr("html", "'h' AS host")), prior_pages=0).filter("has_text").collect()
    assert sorted(round(r["importance"], 3) for r in table) == [0.0, 0.9]


def test_copies_over_partitions(spark):
    """Copies of a page count once however many tasks see them: the tree is the same for one partition and for many."""
    words = lambda k: f"<body>Body of page {k} <div>Part {k}</div></body>"
    rows = [(k, "http://a.example/", words(k)) for k in range(50)] + [(100 + k, "http://a.example/", words("copied")) for k in range(200)]
    rows += [(400 + k, "http://b.example/", words("alone")) for k in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    one, many = pages.repartition(1), pages.repartition(40)
    table = lambda p: sorted(map(tuple, style_features(p.selectExpr("html", "url AS host")).collect()))
    assert table(one) == table(many) and all(n == 1 for host, *_, n in table(many) if host == "http://b.example/")
    texts = [{r["page_id"]: r["text"] for r in page_texts(p).collect()} for p in (one, many)]
    assert texts[0] == texts[1] and all(texts[1][k] == f"Body of page {k}\n\nPart {k}" for k in range(50))
    assert all(texts[1][400 + k] == "Body of page alone\n\nPart alone" for k in range(40))


def test_branches_of_an_article(spark):
    """Running text goes with a branch that repeats on most pages, and stays where the branch is the page's own."""
    shared = "".join(f"<p>Shared line {k}</p>" for k in range(5))
    box = lambda k: "Same words on every page" if k < 12 else f"Own words {k}"
    page = lambda tag, k: f'<{tag}><p>Lead of all</p><div class="x7"><div><p>{box(k)}</p></div></div><div class="y"><p>Story {k}</p>{shared}</div></{tag}>'
    rows = [(100 * a + k, f"http://{tag}.example/", page(tag, k)) for a, tag in enumerate(("main", "article")) for k in range(15)]
    got = {r["page_id"]: r["text"] for r in page_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    lines = [f"Shared line {k}" for k in range(5)]
    for k in range(15):
        expected = "\n\n".join(["Lead of all", *[f"Own words {k}"] * (k >= 12), f"Story {k}", *lines])
        assert got[k] == got[100 + k] == expected


def test_odd_rows(spark):
    rows = [(1, None, None, "h"), (None, "", "", "h"), (3, "not a url", "<p>x", "h"), (3, "not a url", "<p>x", "h"), (4, "HTTP://U:p@Host.Example:80/?q#f", "<p>y", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = sorted(((r["page_id"], r["text"]) for r in page_texts(pages).collect()), key=repr)
    assert got == sorted([(1, ""), (None, ""), (3, "x"), (3, "x"), (4, "y")], key=repr)
    assert page_texts(pages.limit(0)).count() == 0
