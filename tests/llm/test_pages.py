import html
import random
import re

from pyspark.sql import types as T

from tillroll.llm import pages, queries

PAGES = T.StructType(
    [T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())]
)


def extract(spark, rows):
    df = spark.createDataFrame(rows, PAGES).selectExpr("*", "'x' as text", "1 as key", "'y' as host").repartition(3)
    got = pages.main_text(df).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    return {r.page_id: r.text for r in got}


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_longest_common_subsequence():
    rng = random.Random(4)
    for _ in range(400):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(12))] for _ in range(2))
        at = pages.shared_lines(a, b)
        assert at == sorted(set(at)) and len(at) == lcs(a, b)
        rest = iter(b)
        assert all(a[k] in rest for k in at)


def test_structure(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
    <!-- <script> --><header>Top</header><nav><ul><li>Home</li></ul></nav>
    <div class="cookie-notice">We use cookies</div><aside>Side</aside>
    <article><h1>Head&amp;line</h1><p>One   <b>bold</b>\n two&nbsp;&#8364;<br>three
    <div class="ad">Buy</div><p>four <script>var a="</p>";</script>five<form>Send</form></p>
    <section id="comments"><p>First!</p></section></article><footer>&copy; me</footer></body></html>"""
    rows = [(1, "http://a.example/x", page), (2, "http://a.example/y", None), (3, None, ""), (4, "u", "plain text")]
    rows += [(5, "http://b.example/1", "<article><p>cut &amp; off"), (6, "http://b.example/1", "<p>a<p")]
    got = extract(spark, rows)
    assert got[1] == "Head&line\nOne bold two €\nthree\nfour five"
    assert (got[2], got[3], got[4], got[5], got[6]) == ("", "", "plain text", "cut & off", "a")


def test_template_lines_without_marks_are_deleted(spark):
    def page(k):
        return f"<html><body><div>The Daily</div><div>Sections</div><p>Story {k} begins</p><p>and ends {k}</p><div>Imprint</div></body></html>"

    rows = [(k, f"http://d.example/news/{k}", page(k)) for k in range(30)]
    rows.append((99, "http://alone.example/", page(99)))
    got = extract(spark, rows)
    for k in range(30):
        assert got[k] == f"Story {k} begins\nand ends {k}"
    assert got[99].startswith("The Daily")


def test_copies_of_an_article_stay(spark):
    text = "<body><div>Menu line</div><article><p>Same text</p></article></body>"
    rows = [(k, "http://e.example/a", text) for k in (1, 2)]
    assert set(extract(spark, rows).values()) == {"Same text"}


def test_any_partitioning_of_a_large_host(spark):
    """Sections of ten pages each, with a menu of their own: every menu goes."""
    rows = [
        (10 * s + k, f"http://f.example/{s:02d}/{k}", f"<div>Menu of section {s}</div><p>Body {s} of page {k}</p>")
        for s in range(60)
        for k in range(10)
    ]
    random.Random(1).shuffle(rows)
    expected = {i: f"Body {i // 10} of page {i % 10}" for i in range(600)}
    assert extract(spark, rows) == expected
    many = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert extract(spark, rows) == expected
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", many)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_copies_without_an_article_element_keep_their_text(spark):
    long = "A long story of many words that fill nearly all of the page"
    body = f"<body><p>{long}</p><p>goes on here</p></body>"
    rows = [(1, "http://c.example/a", body), (2, "http://c.example/a", body), (3, "http://c.example/a?x=1", body)]
    rows += [(4, "http://c.example/b", body.replace("on here", "on there"))]
    story = long + "\ngoes on "
    assert extract(spark, rows) == {k: story + ("there" if k == 4 else "here") for k in range(1, 5)}


def test_wrappers_and_comments(spark):
    rows = [
        (1, "http://w.example/1", "<div class='layout has-sidebar'><div class='sidebar'>Side</div><article><p>Main</p></article></div>"),
        (2, "http://w2.example/1", "<div id='no-banner'><main><p>Main</p></main></div>"),
        (3, "http://w3.example/1", "<article><p>Main</p><article class='comment'><p>First!</p></article></article>"),
        (4, "http://w4.example/1", "<header><article><h1>Main</h1></article></header>"),
        (5, "http://w5.example/1", "<article class='comments'><p>Alone</p></article>"),
    ]
    assert extract(spark, rows) == {1: "Main", 2: "Main", 3: "Main", 4: "Main", 5: ""}


def test_template_lines_inside_articles(spark):
    """A line that both neighbours have goes; what only one has, or an edited copy, stays."""
    story = lambda k: f"<p>The story of number {k} is told here at some length</p>"
    top, twice = "<p>From our paper</p>", "<p>Seen on two pages</p>"
    rows = [(k, f"http://i.example/{k}", f"<article>{top}{story(k)}{twice if k in (2, 3) else ''}</article>") for k in range(1, 7)]
    copy = "".join(story(k) for k in range(90, 95))
    rows += [(k, f"http://i.example/z{k}", f"<article>{copy}<p>Edited {k}</p></article>") for k in (7, 8, 9)]
    text = lambda markup: "\n".join(re.findall("<p>(.*?)</p>", markup))
    got = extract(spark, rows)
    for k in range(2, 6):
        assert got[k] == text(story(k) + (twice if k in (2, 3) else ""))
    for k in (7, 8, 9):
        assert got[k] == text(copy) + f"\nEdited {k}"
    assert got[1] == text(top + story(1))


def test_long_pages(spark):
    """Thousands of lines that repeat: memory is linear in the lines."""
    rng = random.Random(2)
    lists = [[f"entry {rng.randrange(400)}" for _ in range(6_000)] for _ in range(2)]
    rows = [(k, f"http://l.example/{k}", "".join(f"<p>{x}</p>" for x in of)) for k, of in enumerate(lists)]
    got = extract(spark, rows)
    a, b = (got[k].split("\n") for k in (0, 1))
    assert 0 < len(a) < 6_000 and len(a) == len(b)


def brute_text(rows):
    """The whole result again: plain lists, all pages of a host at a time."""
    hosts = {}
    for _, url, page in rows:
        lines = tuple(pages.lines_of(page or ""))
        m = re.match(r"[^:/?#]+://([^/?#]*)([^?#]*)", url or "")
        if url is not None and lines:
            host, path = (m.group(1).lower(), m.group(2)) if m else ("", "")
            hosts.setdefault(host, {}).setdefault(lines, []).append((path, url))
    gone = {}
    for host, outlines in hosts.items():
        digest = lambda lines: pages_print(lines)
        order = sorted(outlines, key=lambda o: (*(x.encode() for x in min(outlines[o])), digest(o)))
        start = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        path = lambda o: min(outlines[o])[0]
        for k, own in enumerate(order):
            before, after = (order[j] if 0 <= j < len(order) else None for j in (k - 1, k + 1))
            later = before is None or (after is not None and start(path(own), path(after)) > start(path(own), path(before)))
            near, far = (after, before) if later else (before, after)
            texts = lambda o: pages._hashes([x for x, _ in o or ()])
            kinds = [2 * len(x) + place for x, place in own]
            gone[host, own] = set(pages.template_lines(texts(own), kinds, texts(near), texts(far), len(outlines[own]) > 1))
    out = {}
    for i, url, page in rows:
        lines = tuple(pages.lines_of(page or ""))
        m = re.match(r"[^:/?#]+://([^/?#]*)", url or "")
        lost = gone.get((m.group(1).lower() if m else "", lines), ()) if url is not None else ()
        out[i] = "\n".join(x for k, (x, _) in enumerate(lines) if k not in lost)
    return out


def pages_print(lines):
    import hashlib

    hashes = ",".join(map(str, pages._hashes([x for x, _ in lines])))
    kinds = ",".join(str(2 * len(x) + place) for x, place in lines)
    return hashlib.sha256(f"{hashes};{kinds}".encode()).hexdigest()


def test_whole_result_against_brute_force(spark):
    rng = random.Random(9)
    rows = []
    for i in range(300):
        host, section = rng.choice(["a.example", "b.example", "A.example"]), rng.randrange(6)
        body = [f"<div>Menu {section}</div>"] * rng.randrange(2)
        inner = "".join(f"<p>{rng.choice(['Shared', 'Own'])} text {rng.randrange(40)} of it</p>" for _ in range(rng.randrange(5)))
        body.append(f"<article>{inner}</article>" if rng.random() < 0.6 else inner)
        body += ["<div>Imprint</div>"] * rng.randrange(2)
        url = None if rng.random() < 0.03 else f"http://{host}/{section}/{rng.randrange(30)}?q={rng.randrange(3)}"
        rows.append((i, url, "".join(body)))
    assert extract(spark, rows) == brute_text(rows)


def test_nearest_url_is_the_partner(spark):
    rows = [
        (1, "http://g.example/en/one", "<div>English menu</div><p>One</p>"),
        (2, "http://g.example/en/two", "<div>English menu</div><p>Two</p>"),
        (3, "http://g.example/zz/three", "<div>Other menu</div><p>Three</p>"),
        (4, "http://g.example/zz/four", "<div>Other menu</div><p>Four</p>"),
    ]
    assert extract(spark, rows) == {1: "One", 2: "Two", 3: "Three", 4: "Four"}


def test_query_on_the_article_element(spark, sf_dir):
    """On these tables the article element holds the main text."""
    rows = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = {r.page_id: r for r in queries.op3_main_text(spark, sf_dir).collect()}
    assert set(got) == set(rows)
    for k, row in rows.items():
        inner = row.html.split("<article>", 1)[1].split("</article>")[0]
        blocks = [" ".join(html.unescape(b).split()) for b in re.split(r"<(?:/?p|/?h1|br)[^>]*(?:>|$)", re.sub("</?b>", "", inner))]
        assert got[k].text == "\n".join(filter(None, blocks)) and got[k].url == row.url


def test_empty(spark):
    assert extract(spark, []) == {}
