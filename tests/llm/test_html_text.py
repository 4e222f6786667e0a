import random
import time

from codesift.llm import html_text
from codesift.llm.html_text import page_lines, shared_lines


def lcs_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
    return row[-1]


def test_alignment_equals_dynamic_programming():
    random_ = random.Random(0)
    for _ in range(800):
        a, b = ([random_.randint(0, 5) for _ in range(random_.randint(0, 16))] for _ in range(2))
        found, rest = shared_lines(a, b), iter(b)
        assert len(found) == len(set(found)) == lcs_length(a, b)
        assert all(any(a[i] == y for y in rest) for i in found)
    many = [i % 7 for i in range(3000)]
    assert len(shared_lines(many, many[::-1])) == lcs_length(many, many[::-1])


def test_lines_of_a_page():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><a href="/">Home</a></nav>
    <script>var s = "</p><p>no";</script><!-- <p>no</p> --><div class="x ad-box">Buy</div><header>Site</header>
    <article class=post><h1>A &amp; B</h1><p>One <b>two</b><br>three&nbsp;&#233;<p>Four
      five<ul><li>x<li>y</ul><form>Send</form><div class='comments'>me too</div><a title="a > b">link</a></article>
    <footer>(c)</footer></body>"""
    assert page_lines(page) == (["A & B", "One two three é", "Four five", "x", "y", "link"], True)
    assert page_lines("<nav><ul><li>Menu<article><p>Text</article>") == (["Text"], True)
    assert page_lines("plain < text > & more") == (["plain < text > & more"], False)
    assert page_lines(None) == page_lines("") == ([], False)
    assert page_lines("<p>" + "long " * 200_000 + "</p>")[0][0].count("long") == 200_000
    assert page_lines('<p a="unclosed>x</p><p>y') == (["x", "y"], False)


def unmarked(site, i):
    return (f"<body><div>Welcome to {site}</div><p>Own text {i} one<p>Own text {i} two<b>x</b>"
            f"<div>About {site} &amp; more</div><ul><li>Home<li>News</ul></body>")


def test_shared_lines_are_deleted(spark):
    rows = [(i, f"http://h{i % 3}.x/p{i:03}?q={i}", unmarked(f"h{i % 3}", i)) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    for partitions in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            got = {r.page_id: r.text for r in html_text.main_text(pages).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert got == {i: f"Own text {i} one\nOwn text {i} twox" for i in range(60)}


def test_copies_and_marks_are_kept(spark):
    copy = "<p>Same text</p><p>in both</p>"
    marked = "<article><p>Quoted passage</p><p>Mine {}</p></article>"
    rows = [(1, "http://a/1", copy), (2, "http://a/2", copy), (3, "http://b/1", marked.format(1)), (4, "http://b/2", marked.format(2))]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "Same text\nin both", 2: "Same text\nin both", 3: "Quoted passage\nMine 1", 4: "Quoted passage\nMine 2"}


def texts(spark, rows, partitions="8"):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pages = spark.createDataFrame(rows, "page_id long, url string, html string")
        return {r.page_id: r.text for r in html_text.main_text(pages).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_large_template_and_runs_of_copies(spark):
    menu = "".join(f"<div>Menu {k}</div>" for k in range(30))
    page = lambda i: menu + "".join(f"<p>Own {i} {k}" for k in range(4))
    want = lambda i: "\n".join(f"Own {i} {k}" for k in range(4))
    # Pages 5 to 24 are copies of one page, 30 and 31 of another.
    which = [5 if 5 <= i < 25 else 30 if i == 31 else i for i in range(40)]
    rows = [(i, f"http://big.x/{i:03}", page(w)) for i, w in enumerate(which)]
    for partitions in ("1", "4", "13"):
        assert texts(spark, rows, partitions) == {i: want(w) for i, w in enumerate(which)}
    # A near copy alone does not delete the text of its neighbour.
    near = ["".join(f"<p>Text {k if k != 3 else f'{k} of {i}'}" for k in range(20)) for i in range(2)]
    rows = [(0, "http://n.x/0", near[0]), (1, "http://n.x/1", near[1]), (2, "http://n.x/2", "<p>Other")]
    assert all(t.count("\n") == 19 for i, t in texts(spark, rows).items() if i < 2)


def test_template_lines_inside_marks(spark):
    marked = lambda i: f"<article><p>Own {i} a<p>Own {i} b<p>Tell your friends<p>Own {i} c</article>"
    rows = [(i, f"http://m.x/{i:02}", marked(i // 2)) for i in range(30)]  # each page twice
    for partitions in ("1", "7"):
        assert texts(spark, rows, partitions) == {i: f"Own {i // 2} a\nOwn {i // 2} b\nOwn {i // 2} c" for i in range(30)}


def test_repeated_sentences_inside_marks_stay(spark):
    """A line that neighbours hold is text, unless all the nearest pages have it at one place."""
    body = [[f"Own {i} {k}" for k in range(3 + i % 4)] for i in range(20)]
    for i in range(20):
        body[i].insert(i * 7 % len(body[i]), "As everyone knows")
    rows = [(i, f"http://t.x/{i:02}", "<article>" + "".join(f"<p>{line}" for line in body[i]) + "</article>") for i in range(20)]
    for partitions in ("1", "7"):
        assert texts(spark, rows, partitions) == {i: "\n".join(body[i]) for i in range(20)}
    # Nine pages are too few to tell.
    few = [(i, f"http://f.x/{i}", f"<article><p>Mine {i}<p>Share<p>More {i}</article>") for i in range(10)]
    assert all("Share" in t for t in texts(spark, few).values())


def test_runs_of_copies_over_many_partitions(spark):
    """Neighbours are found across partitions that hold one run only, for marked and unmarked pages alike."""
    page = lambda i: f"<article><p>Title {i}<p>Ad<p>Own {i}</article>" if i % 2 else unmarked("s", i)
    which = [i if i < 12 or i > 60 else 13 for i in range(75)]
    rows = [(i, f"http://s.x/{i:03}", page(w)) for i, w in enumerate(which)]
    want = texts(spark, rows, "1")
    for partitions in ("9", "40"):
        assert texts(spark, rows, partitions) == want


def plain_texts(rows):
    """The rules applied to the sorted pages of each host, all in one place."""
    parsed = [(url.split("/")[2], "/" + url.split("/", 3)[3], i, *page_lines(page)) for i, url, page in rows]
    out = {i: lines for _, _, i, lines, _ in parsed}
    for host in {p[0] for p in parsed}:
        runs = []
        for _, _, i, lines, marked in sorted(p for p in parsed if p[0] == host and p[3]):
            if not runs or runs[-1][0] != lines:
                runs.append((lines, []))
            runs[-1][1].append((i, marked))
        for at, (own, pages) in enumerate(runs):
            for i, marked in pages:
                most, found = (html_text.MARK_WITNESSES, []) if marked else (2, [])
                for step in range(1, html_text.MARK_WITNESSES + 1):
                    for near in (at - step, at + step):
                        if 0 <= near < len(runs) and runs[near][0] != own and runs[near][0] not in found and len(found) < most:
                            found.append(runs[near][0])
                shared = [set(shared_lines(own, other)) for other in found]
                copies = [len(s) > 0.8 * len(own) for s in shared]
                gone = set()
                if marked and len(found) == html_text.MARK_WITNESSES and not any(copies):
                    edge = lambda k, o: o[k:k + 1] == [own[k]] or o[::-1][len(own) - 1 - k:len(own) - k] == [own[k]]
                    gone = {k for k in set.intersection(*shared) if all(edge(k, o) for o in found)}
                elif not marked and len(found) == 1 and len(shared[0]) not in (len(own), len(found[0])):
                    gone = shared[0]
                elif not marked and len(found) == 2:
                    both = shared[0] & shared[1]
                    gone = set().union(*[both if copy else s for s, copy in zip(shared, copies, strict=True)])
                out[i] = [line for k, line in enumerate(own) if k not in gone]
    return {i: "\n".join(lines) for i, lines in out.items()}


def test_random_hosts_equal_the_plain_version(spark):
    random_ = random.Random(12)
    rows = []
    for host in range(7):
        template = [[f"T{host} {k}" for k in range(random_.randint(0, 5))] for _ in range(2)]
        for n in range(random_.choice([1, 2, 3, 5, 9, 25])):
            own = [random_.choice([f"Own {host} {n} {k}", f"Own {host} {n} {k}", "Common", "Known"]) for k in range(random_.randint(0, 6))]
            lines = template[0] + own + template[1]
            body = "".join(f"<p>{line}" for line in lines)
            page = f"<article>{body}</article>" if random_.random() < 0.4 else body
            for _ in range(random_.choice([1, 1, 1, 2, 6])):
                rows.append((len(rows), f"http://h{host}.x/{n:03}/{len(rows):04}", page))
    want = plain_texts(rows)
    for partitions in ("1", "6", "30"):
        assert texts(spark, rows, partitions) == want


def test_hostile_pages_take_linear_time():
    def seconds(page):
        start = time.perf_counter()
        page_lines(page)
        return time.perf_counter() - start

    for make in (
        lambda n: "<b>" * n + "</i>" * n, lambda n: "<aside>" + "<article>x" * n, lambda n: "<a " * n, lambda n: "<aside><article>x</article>" * n,
        lambda n: "<li><ul>" + "<b>" * n + "<li></li>" * n, lambda n: "<a href=\"" * n, lambda n: "x<p" * n + "<!-- " * n,
    ):
        seconds(make(2000))
        assert seconds(make(40_000)) < 4
    assert page_lines("a <b c") == (["a <b c"], False) and page_lines("<p>x</p> 1 <2 and <a") == (["x", "1 <2 and <a"], False)
    assert page_lines("<p>x<script>y</script") == (["x"], False) and page_lines("<p>x<!-- y <a") == (["x"], False)


def test_article_inside_comments():
    page = "<p>x</p><article><p>Text</article><{0}><article>Reply</article></{1}><aside><article>Teaser</article></aside>"
    assert page_lines(page.format("div class=comments", "div")) == (["Text"], True)
    assert page_lines(page.format("aside", "aside")) == (["Text"], True)
    assert page_lines("<aside><article>Teaser</article></aside><p>Text") == (["Text"], False)
    assert page_lines("<div class=has-sidebar><article>Text</article></div>") == (["Text"], True)
    assert page_lines("<p>Hi<div class=has-sidebar><main>Text</main></div>") == (["Text"], True)


def test_odd_rows(spark):
    rows = [(1, None, None), (None, "not a url", ""), (2, "http://a/1", "<p>x"), (2, "http://a/1", "<p>x"), (3, "http://a/", "<p>" + "é " * 50_000)]
    schema = "page_id long, url string, html string"
    pages = spark.createDataFrame(rows, schema).selectExpr("*", "'clash' AS lines", "1 AS uid", "'clash' AS host")
    got = html_text.main_text(pages).collect()
    assert sorted(r.n_chars for r in got) == [0, 0, 1, 1, 99_999]
    assert html_text.main_text(spark.createDataFrame([], schema)).count() == 0


def test_articles_of_the_given_pages(spark):
    sf = "/root/testdata/sf0.1"
    texts = {" ".join(r.text.split()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r.text}
    rows = html_text.main_text(spark.read.parquet(f"{sf}/pages.parquet")).collect()
    # A heading, then the text of a document.
    assert rows and all(" ".join(r.text.split("\n", 1)[1].split()) in texts for r in rows)
