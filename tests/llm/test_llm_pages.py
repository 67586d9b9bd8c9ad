from __future__ import annotations

import random

import pytest

from hashgrove.llm import pages


def brute_common(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@pytest.mark.parametrize("cells", [1 << 28, 20])
def test_common_lines_are_a_longest_common_subsequence(cells):
    rng = random.Random(cells)
    for _ in range(200):
        a, b = ([rng.randint(0, 6) for _ in range(rng.randint(0, 25))] for _ in range(2))
        found = pages.common(a, b, cells)
        assert found == sorted(set(found)) and len(found) == brute_common(a, b)
        rest = iter(b)
        assert all(a[i] in rest for i in found)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<body><nav><a href=x>Menu</a></nav><article><h1>Title</h1><p>One <b>bo</b>ld&nbsp;&amp; two.<br>Three<p>Four</article><footer>End", "Title One bold & two. Three Four"),
        ("<article><p>Text</p><div class='share ad'>Buy</div><aside>Side</aside><form><input value=a>Name</form><p>More</p></article>", "Text More"),
        ("<main><p>Text<script>var a='</p>';</script><style>p{}</style><!-- <p>no</p> --> goes on</p><section class=comments><article>Reply</article></section></main>", "Text goes on"),
        ("<article>a<ul><li>b<li>c</ul><table><tr><td>d<td>e</table></article>", "a b c d e"),
        ("<article><p>x <span class=ad>no</span> y</p><p>1 < 2 and a<a href='>'>b</a>c</article><div>out</div>", "x y 1 < 2 and abc"),
        ("<div role=navigation>no</div><p>No article here.</p><p hidden>no</p>", "No article here."),
        ("<article><p>Cut off <a hre", "Cut off"),
        ("<div class='adage headers'>kept</div>", "kept"),
        ("<body class='sidebar'><div class='with-sidebar'>kept</div><div class='left sidebar-box'>no</div>", "kept"),
        ("<p>&#233;&eacute; &lt;b&gt; &unknown;", "éé <b> &unknown;"),
    ],
)
def test_blocks_of_one_page(spark, page, text):
    frame = spark.createDataFrame([(1, "http://a.b/c", page)], "page_id bigint, url string, html string")
    assert pages.extract(frame).first()["text"] == text


def site(body):
    return f"<html><body><div>Site name</div><div>Home of things</div>{body}<div>Made by us</div></body></html>"


def test_shared_lines_go_where_no_article_is_declared(spark):
    rows = [
        (1, "http://www.h.org/news/2024/a?x=1", site("<p>Alpha text.</p><p>Own words.</p>")),
        (2, "https://h.org:443/news/2024/b#top", site("<p>Beta text.</p>")),
        (3, "http://h.org/", site("<p>Front.</p>")),
        (4, "http://other.org/news/2024/a", site("<p>Alone.</p>")),
        (5, "http://t.org/1", "<p>Same</p><p>copy</p>"),
        (6, "http://t.org/2", "<p>Same</p><p>copy</p>"),
        (7, "http://q.org/1", "<article><p>Quoted line.</p></article>"),
        (8, "http://q.org/2", "<p>Quoted line.</p><p>Other</p>"),
    ]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(4)
    found = {r["page_id"]: r["text"] for r in pages.extract(frame).collect()}
    assert found == {
        1: "Alpha text. Own words.",
        2: "Beta text.",
        3: "Front.",
        4: "Site name Home of things Alone. Made by us",
        5: "Same copy",
        6: "Same copy",
        7: "Quoted line.",
        8: "Quoted line. Other",
    }


def test_nearest_is_the_neighbour_with_the_longer_common_path(spark):
    rng = random.Random(3)
    rows = [(i, f"http://h{rng.randint(0, 1)}.org/{rng.choice('ab')}/{rng.randint(0, 99)}/{i % 7}") for i in range(80)] + [(99, "http://solo.org/x")]
    frame = spark.createDataFrame(rows, "id bigint, url string").repartition(6)
    found = {r["id"]: r["other"] for r in pages._neighbours(frame).collect()}
    keys = sorted((u.split("/")[2], u[len("http://h0.org") :], i) for i, u in rows if "solo" not in u)
    for k, (host, path, i) in enumerate(keys):
        near = [keys[j] for j in (k - 1, k + 1) if 0 <= j < len(keys) and keys[j][0] == host]
        same = [next((n for n, (a, b) in enumerate(zip(path + "\0", other[1] + "\1")) if a != b)) for other in near]
        assert found[i] == near[same.index(max(same))][2]
    assert 99 not in found


def test_awkward_rows(spark):
    rows = [(None, "http://a.b/1", "<p>x</p>", 1), (1, None, "<p>y</p>", 1), (2, "http://a.b/2", None, 1), (3, "", "", 1), (4, "http://a.b/4", "<p>" + "long words " * 50_000, 1)]
    rows += [(5, "http://a.b/5", "<article>z</article>", 1)] * 2 + [(6, "not a url", "<" * 3000 + '"' * 10, 1), (7, "http://a.b/7", '<a "' * 2000, 1)]
    found = pages.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, text int"))
    assert found.columns == ["page_id", "url", "text"]
    texts = [(r["page_id"], r["text"]) for r in found.collect()]
    assert len(texts) == len(rows) and all(t is not None for _, t in texts)
    by_id = dict(texts)
    assert by_id[None] == "x" and by_id[1] == "y" and by_id[2] == by_id[3] == "" and by_id[5] == "z"
    assert by_id[4] == ("long words " * 50_000).strip()
    assert pages.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def extracted(spark, rows):
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    return {r["page_id"]: r["text"] for r in pages.extract(frame).collect()}


def test_differencing_decides_inside_and_beside_articles(spark):
    share = "<div class=tools>Pass this page on</div>"
    rows = [
        (1, "http://h.org/a/1", f"<article><p>First text.</p>{share}</article>"),
        (2, "http://h.org/a/2", f"<article><p>Second text.</p><p>More.</p>{share}</article>"),
        (3, "http://t.org/a/1", "<div>Site name</div><div>The real body of this page.</div><article>Teaser</article>"),
        (4, "http://t.org/a/2", "<div>Site name</div><div>Another real body.</div><article>Teaser two</article>"),
        (5, "http://alone.org/a", "<div>The real body of this page.</div><article>Teaser</article>"),
    ]
    assert extracted(spark, rows) == {
        1: "First text.",
        2: "Second text. More.",
        3: "The real body of this page. Teaser",
        4: "Another real body. Teaser two",
        5: "The real body of this page. Teaser",
    }


def test_copies_and_declared_frames_do_not_hide_the_frame(spark):
    menu = "<nav>" + "".join(f"<p>Entry {i}</p>" for i in range(40)) + "</nav>"
    rows = [
        (1, "http://m.org/a/1", menu + site("<p>Alpha text.</p>")),
        (2, "http://m.org/a/2", menu + site("<p>Beta text.</p>")),
        *((10 + i, f"http://c.org/a/{i:02}", site("<p>A copied text.</p>")) for i in range(12)),
        (30, "http://c.org/b/1", site("<p>Another page of the host.</p>")),
        (40, "http://n.org/a/1", "".join(f"<p>Line {i}</p>" for i in range(9))),
        (41, "http://n.org/a/2", "".join(f"<p>Line {i}</p>" for i in range(10))),
    ]
    found = extracted(spark, rows)
    assert found[1] == "Alpha text." and found[2] == "Beta text."
    assert {found[10 + i] for i in range(12)} == {"A copied text."} and found[30] == "Another page of the host."
    assert found[40] == " ".join(f"Line {i}" for i in range(9)) and found[41] == found[40] + " Line 9"


STOCK = "We print this sentence everywhere."


def test_an_article_keeps_what_a_neighbour_shows_elsewhere(spark):
    rows = [
        (1, "http://s.org/a/1", f"<nav>Menu</nav><article><h1>Same title</h1><p>First own text.</p><p>{STOCK}</p><p>{STOCK}</p></article><footer>{STOCK}</footer>"),
        (2, "http://s.org/a/2", f"<nav>Menu</nav><div class=ad>{STOCK}</div><article><h1>Same title</h1><p>Second own text.</p><p>{STOCK}</p></article><footer>{STOCK}</footer>"),
        (3, "http://s.org/a/3", f"<nav>Menu</nav><article><h1>Same title</h1><p>{STOCK}</p></article><p>{STOCK}</p>"),
        (4, "http://s.org/a/4", f"<article><p>{STOCK}</p></article>"),
    ]
    found = extracted(spark, rows)
    assert found[1] == f"Same title First own text. {STOCK} {STOCK}"
    assert found[2] == f"Same title Second own text. {STOCK}"
    assert found[3].startswith(f"Same title {STOCK}") and found[4] == STOCK


def test_only_aligned_places_of_template_paths_go(spark):
    tools = "<div id=tools-{}><span>Print</span></div>"
    rows = [(i, f"http://p.org/a/{i}", f"<article><p>Own words of page {i}.</p>{tools.format(i)}<p>Print</p><div class=box><p>Box {i} of its own</p></div></article>") for i in range(1, 5)]
    # the path of the tools recurs, a paragraph with the same word does not go with it
    assert extracted(spark, rows) == {i: f"Own words of page {i}. Print Box {i} of its own" for i in range(1, 5)}


def test_rows_that_share_an_identifier_keep_their_own_lines(spark):
    frame = "<div>Site name</div><p>{}</p>"
    rows = [(1, "http://r.org/1", frame.format("One.")), (1, "http://r.org/1", "<p>Other lines.</p><div>Site name</div>"), (2, "http://r.org/2", frame.format("Two."))]
    found = pages.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
    # the least of their digests is paired
    assert sorted(r["text"] for r in found.collect()) in (["One.", "Other lines. Site name", "Two."], ["Other lines.", "Site name One.", "Two."])


def by_brute_force(rows):
    """The whole query page by page: partners by sorting, alignment by a table, votes by counting."""
    parsed = {i: pages.blocks(html or "") for i, _, html in rows}
    digest = {i: [t for t, k, _ in own if k != pages.FRAME] for i, own in parsed.items()}
    place = {}
    for i, url, _ in rows:
        rest = url.split("://", 1)[-1]
        host = rest.split("/", 1)[0].lower().split("?")[0].split("#")[0]
        host = host.removeprefix("www.").split(":")[0]
        path = "/" + rest.split("/", 1)[1].split("?")[0].split("#")[0] if "/" in rest else ""
        place[i] = (host, path, i)
    order = sorted(place.values())
    out = {}
    for k, (host, _, i) in enumerate(order):
        near = []
        for step in (-1, 1):
            j = k + step
            while 0 <= j < len(order) and order[j][0] == host and digest[order[j][2]] == digest[i]:
                j += step
            if 0 <= j < len(order) and order[j][0] == host:
                near.append(order[j][2])
        lines = [(n, *line) for n, line in enumerate(parsed[i]) if line[1] != pages.FRAME]
        key = lambda own: [(p, t) for t, _, p in own]
        if not near:
            out[i] = pages._text(lines, None)
            continue
        aligned = []
        for other in near:
            a, b = key(parsed[i]), key(parsed[other])
            numbers = {x: n for n, x in enumerate({*a, *b})}
            aligned.append(pages.common([numbers[x] for x in a], [numbers[x] for x in b]))
            assert len(aligned[-1]) == brute_common(a, b)
        gone = pages.template(lines, aligned)
        votes = {}
        for n, _, kind, path in lines:
            votes.setdefault(path, []).append(sum(n in places for places in aligned) / len(aligned))
        for n, _, kind, path in lines:
            if n in gone:
                assert kind != pages.IN_ARTICLE and any(n in places for places in aligned)
            elif kind != pages.IN_ARTICLE and sum(votes[path]) * 2 > len(votes[path]) and any(n in places for places in aligned):
                # kept although its path is template: then it is the page's main path, or the page has no text of its own
                own = {}
                for m, text, _, p in lines:
                    own[p] = own.get(p, 0) + (0 if any(m in places for places in aligned) else len(text))
                assert max(own.values()) == own[path]
        out[i] = " ".join(t for n, t, *_ in lines if n not in gone)
    return out


def test_fifty_given_pages_by_brute_force(spark):
    given = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = [(r["page_id"], r["url"], r["html"]) for r in given.select("page_id", "url", "html").collect()]
    assert len(rows) >= 50
    found = {r["page_id"]: r["text"] for r in pages.extract(given).collect()}
    assert found == by_brute_force(rows)


def test_no_article_paragraph_of_the_given_pages_is_lost(spark):
    given = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = {r["page_id"]: r["text"] for r in pages.extract(given).collect()}
    for r in given.collect():
        article = [text for text, kind, _ in pages.blocks(r["html"] or "") if kind == pages.IN_ARTICLE]
        assert found[r["page_id"]] == " ".join(article)
