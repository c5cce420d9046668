import random

from driftmon.llm.html_text import common_lines, extract_text, page_lines

KIND = "page_id long, url string, html string, place long, text int, host string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "h") for r in rows], KIND).repartition(4)


def page(body, menu="Home", end=""):
    return (f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body><nav><a>{menu}</a></nav>"
            f"<!-- ad --><div class='ad'>buy</div>{body}<footer>&copy; me</footer>{end}")


def test_markup():
    inside, outside = page_lines(page(
        "<article><header><h1>T &amp; t</h1></header><p><b>One<br>two &nbsp; three<p>a&lt;b<ul><li>x<li class='share'>s<li>y</ul>"
        "<script>var a='<p>no</p>';</script><section class='comments'><p>hi</p></section><aside>z</aside>"
        "<form><p>mail</p></form><div id=cookieNotice>we use</div></article>"))
    assert inside == ["T & t", "One two three", "a<b", "x", "y"]
    assert ("hi", False) in outside and ("buy", False) in outside and ("© me", False) in outside
    assert page_lines("") == ([], []) and page_lines("a < b <p>x")[1] == [("a < b", True), ("x", True)]
    # something left open before the article does not swallow it
    assert page_lines("<div class=ad>x<article><p>y</article>")[0] == ["y"]


def lcs(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


def test_common_lines_are_longest():
    random.seed(7)
    for _ in range(400):
        a, b = ([random.randrange(5) for _ in range(random.randrange(14))] for _ in range(2))
        at = common_lines(a, b)
        rest = iter(b)
        assert len(at) == lcs(a, b) and all(any(a[i] == y for y in rest) for i in at)
    assert common_lines(list(range(3000)), list(range(1, 3001))) == list(range(1, 3000))


def plain(lines):
    return "<html><body>" + "".join(f"<div>{x}</div>" for x in lines) + "</body></html>"


def test_shared_lines_of_near_urls_go(spark):
    rows = []
    for h in range(3):
        for k in range(40):
            own = [f"story {h} {k} line {j}" for j in range(3)]
            rows.append((1000 * h + k, f"http://h{h}.example/a/{k:03d}?x=1", plain([f"Menu of {h}", *own, f"Imprint {h}"])))
    rows.append((9000, "http://alone.example/x", plain(["Only page", "of its host"])))
    for each in (7, 1000):
        got = {r.page_id: r.text for r in extract_text(frame(spark, rows), rows_each=each).collect()}
        assert len(got) == len(rows)
        whole = sum(got[1000 * h + k] == "\n".join(f"story {h} {k} line {j}" for j in range(3)) for h in range(3) for k in range(40))
        assert whole >= 117  # a host's last page has no neighbour when it begins a range
        assert got[9000] == "Only page\nof its host"


def test_articles_keep_lines_they_share(spark):
    rows = [(k, f"http://h/{k}", page(f"<article><p>own {k}</p><p>licence</p></article>", menu=f"m{k}")) for k in range(30)]
    got = extract_text(frame(spark, rows)).collect()
    assert all(r.text == f"own {r.page_id}\nlicence" and r.n_chars == len(r.text) and r.shared_lines for r in got)


def test_nulls_copies_and_empty(spark):
    same = plain(["a", "b"])
    rows = [(1, None, None), (None, "http://h/1", ""), (2, "http://h/2", same), (2, "http://h/2", same), (3, "http://[bad", same),
            (4, "http://h/long", "<article>" + "<p>x y</p>" * 20_000 + "</article>")]
    got = extract_text(frame(spark, rows)).collect()
    assert sorted((str(r.page_id), r.text) for r in got if r.page_id != 4) == sorted(
        [("1", ""), ("None", ""), ("2", "a\nb"), ("2", "a\nb"), ("3", "a\nb")])
    assert max(r.n_chars for r in got) == 4 * 20_000 - 1
    assert extract_text(frame(spark, rows).limit(0)).count() == 0


def test_differencing_decides_lines_around_an_article(spark):
    def body(k):
        around = f"<div>Menu</div><div>standfirst {k}</div>", f"<div>note {k}</div><div>Imprint</div>"
        return f"<html><body>{around[0]}<article><p>own {k}</p><p>licence</p></article>{around[1]}</body></html>"

    rows = [(k, f"http://h/{k:02d}", body(k)) for k in range(20)]
    rows.append((90, "http://alone/x", body(90)))  # nothing tells its menu from its text
    # of another template than its neighbours: shares no line with them
    rows += [(100 + k, f"http://other/{k}", f"<div>m{k}</div><article><p>own {k}</p></article>") for k in range(5)]
    got = {r.page_id: r.text for r in extract_text(frame(spark, rows)).collect()}
    assert all(got[k] == f"standfirst {k}\nown {k}\nlicence\nnote {k}" for k in range(20))
    assert got[90] == "own 90\nlicence" and all(got[100 + k] == f"own {k}" for k in range(5))


def test_every_page_meets_the_nearest_one_that_differs(spark):
    rows, want = [], {}
    for h in range(4):
        for k in range(60):
            n = k - k % 30 if h % 2 else k  # hosts 1 and 3: runs of 30 copies under other query strings
            body = [f"story {h} {n} line {j}" for j in range(3)]
            rows.append((1000 * h + k, f"http://h{h}.example/a?x={k:03d}", plain([f"Menu of {h}", *body, f"Imprint {h}"])))
            want[1000 * h + k] = "\n".join(body)
    rows += rows[45:50]  # repeated rows
    for each in (1, 7, 1000):
        got = extract_text(frame(spark, rows), rows_each=each).collect()
        assert len(got) == len(rows) and {r.page_id: r.text for r in got} == want
        assert all(r.shared_lines == 2 for r in got)
