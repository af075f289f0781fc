import re
import time

import pytest

from cargohold.llm import site_lines, site_templates, url_filter

PAGE = "page_id long, url string, html string, host string, text string, verdict string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "h", "t", "v") for r in rows], PAGE)


ARTICLE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>'
    '<nav><ul><li><a href="/x">Menu</a></li></ul></nav><!-- ad --><div class="ad">Buy</div><header>Top</header>'
    "<article><h1>Head &amp; line</h1><p><b>First   part<br><p>Second\n\t&eacute;&#33; <i>in</i>line</p>"
    '<div class="share-buttons social">Share</div><section id="comments"><p>Nice!</p></section><p>Third</article>'
    '<aside>Side</aside><form>Go <input></form><div id="cookie-notice">Cookies</div><footer>&copy; x</footer></body></html>'
)


def test_article_of_a_page(spark):
    rows = [(1, "http://a.org/1", ARTICLE), (2, None, None), (3, "x", ""), (4, "http://b.org", "<p>plain &lt;b&gt; <em>text</em><p>more"), (5, "http://b.org", "only text"),
            (6, "http://c.org", "<article><p>cut of"), (7, "http://c.org", "<article><p>cut &am"), (8, "http://c.org", "<article><p>cut <di"), (1, "http://a.org/1", ARTICLE)]
    got = site_templates.main_text(pages(spark, rows)).collect()
    by_id = {r.page_id: r for r in got}
    assert len(got) == len(rows)
    assert by_id[1].text == "Head & line\nFirst part\nSecond é! inline\nThird"
    assert (by_id[2].text, by_id[3].text) == ("", "")
    assert by_id[4].text == "plain <b> text\nmore"
    assert by_id[5].text == "only text"
    assert (by_id[6].text, by_id[7].text, by_id[8].text) == ("cut of", "cut &am", "cut")
    assert all(r.n_chars == len(r.text) for r in got)
    assert site_templates.main_text(pages(spark, [])).collect() == []


def test_subtrees_that_a_site_repeats_go(spark):
    box = "<div><p>Read our letter</p><p>Every day</p></div>"
    rows = [(i, f"http://s.org/{i}", f"<body><div><p>Story {i}</p></div>{box}<table><tr><td>Links</td></tr></table></body>") for i in range(20)]
    rows += [(100 + i, f"http://t.org/{i}", f"<body><p>Story {i}</p>{box}</body>") for i in range(5)]
    rows += [(200 + i, f"http://u.org/{i}", f"<article><p>Same opening</p><p>Story {i}</p>{box}</article>") for i in range(20)]
    got = {r.page_id: r.text for r in site_templates.main_text(pages(spark, rows)).collect()}
    assert all(got[i] == f"Story {i}" for i in range(20))
    assert all(got[100 + i] == f"Story {i}\nRead our letter\nEvery day" for i in range(5))
    assert all(got[200 + i] == f"Same opening\nStory {i}" for i in range(20))


def test_deep_and_long_pages():
    blocks = site_templates.parse("<div>" * 5000 + "deep" + "</div>" * 5000 + "<p>" + "long " * 200_000)[0]
    assert blocks[0][0] == "deep" and len(blocks[1][0]) == 999_999


@pytest.mark.parametrize(
    "page", ["<div>x" * 100_000, '<a "' * 250_000, "<a '\"" * 150_000, "<i>" * 100_000 + "</span>" * 100_000, "<p><i>" * 100_000, "<li><i>x" * 100_000, "<!-- " * 200_000, "<script>" * 100_000, "<" * 500_000]
)
def test_damaged_pages_take_time_by_their_length(page):
    began = time.process_time()
    site_templates.lone_text(page)
    assert time.process_time() - began < 6


def test_lines_by_their_share_of_the_site(spark):
    rows = [(i, f"https://A.org/{i}", f"<p>Line {i}</p><p>Menu</p><p>Line {i}</p><p>  Menu </p>" + ("<p>Rare</p>" if i < 4 else "")) for i in range(30)]
    rows += [(100 + i, "http://b.org", f"<div>Menu<br>{i}</div>") for i in range(3)] + [(200, None, None), (201, "bad", "<p>x</p>"), (200, None, None)]
    got = site_lines.page_lines(pages(spark, rows), ratio=0.1, min_pages=5).collect()
    by_id = {r.page_id: r for r in got}
    assert len(got) == len(rows)
    assert by_id[0].text == "Line 0\nLine 0\nRare" and (by_id[0].n_lines, by_id[0].n_dropped, by_id[0].host) == (5, 2, "a.org")
    assert by_id[20].text == "Line 20\nLine 20"
    assert by_id[101].text == "Menu\n1" and by_id[200].text == "" and by_id[201].text == "x"
    assert site_lines.page_lines(pages(spark, [])).collect() == []


RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def rule_of(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].lower(), m[2]) if m else ("", "")
    fits = [r for r in RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
    return host, path, best and best[1] + best[2], best and best[0]


URLS = ["http://a.org/x", "HTTP://EXAMPLE.org/es/1", "https://m.example.org/en/12?x=/es/", "https://notexample.org/es/", "http://x.com/de/1#a", "http://x.com/fr/", "http://com/de/", "http://x.com",
        "http://x.com?u=://y.org/", "no host", None, "", "://b.org/z", "http://user@h.net:80/p", "http://xcom/de/", "http://q.net/é#x"]


def test_rules(spark):
    got = {r.page_id: r for r in url_filter.judged(pages(spark, [(i, u, None) for i, u in enumerate(URLS)])).collect()}
    for i, u in enumerate(URLS):
        host, path, rule, verdict = rule_of(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert got[i].verdict in ("allow", "block") and (verdict is None or got[i].verdict == verdict)
    assert url_filter.judged(pages(spark, [])).collect() == []


def brute_rank(edges, seeds, forward):
    nodes = sorted(set(seeds) | {x for e in edges for x in e[:2]})
    ways = [(a, b, n) if forward else (b, a, n) for a, b, n in edges]
    out = {x: sum(n for a, _, n in ways if a == x) for x in nodes}
    rank = {x: seeds.get(x, 0.0) for x in nodes}
    for _ in range(url_filter.ROUNDS):
        got = {x: sum(rank[a] * n / out[a] for a, b, n in ways if b == x) for x in nodes}
        lost = 1 - sum(got.values())
        rank = {x: 0.15 * seeds.get(x, 0.0) + 0.85 * (got[x] + lost * seeds.get(x, 0.0)) for x in nodes}
    return rank


def test_propagation_matches_a_plain_loop(spark):
    edges = [("good", "near", 3), ("near", "far", 1), ("near", "good", 2), ("spam", "bad", 5), ("ring", "spam", 1), ("far", "end", 1), ("end", "near", 1)]
    good, bad = {"good": 0.75, "far": 0.25}, {"bad": 1.0}
    hosts = sorted(set(good) | set(bad) | {"alone"})
    seeds = spark.createDataFrame([(h, good.get(h, 0.0), bad.get(h, 0.0)) for h in hosts], "host string, good double, bad double")
    got = {r.host: r for r in url_filter.propagate(seeds, spark.createDataFrame(edges, "src string, dst string, n long")).collect()}
    trust, distrust = brute_rank(edges, good, True), brute_rank(edges, bad, False)
    for h in trust:
        assert got[h].trust == pytest.approx(trust[h], abs=2e-4) and got[h].distrust == pytest.approx(distrust.get(h, 0.0), abs=2e-4)
    assert got["ring"].distrust > 0 and got["ring"].trust == 0


def test_pages_of_unknown_hosts_get_what_their_links_say(spark):
    link = lambda *to: "".join(f'<a href="http://{h}/">x</a>' for h in to)
    rows = [(1, "http://good.org/a", link("friend.net")), (2, "http://bad.com/de/1", None), (3, "http://farm.net/1", link("bad.com", "bad.com")), (4, "http://friend.net/", link("friend.net")), (5, "http://nobody.net/", "")]
    got = {r.page_id: r.verdict for r in url_filter.judged(pages(spark, rows)).collect()}
    assert got == {1: "allow", 2: "block", 3: "block", 4: "allow", 5: "allow"}


def test_rounds_reach_a_long_chain_behind_one_of_many_seeds(spark):
    n, far = 20_000, 22
    seeds = spark.range(n).selectExpr("concat('s', id) AS host", "0.0D AS good", f"1.0D / {n + 1} AS bad").union(spark.sql(f"SELECT 'c0', 0.0D, 1.0D / {n + 1}"))
    edges = spark.createDataFrame([(f"c{i + 1}", f"c{i}", 1) for i in range(far)], "src string, dst string, n long")
    got = {r.host: r.distrust for r in url_filter.propagate(seeds, edges).filter("host LIKE 'c%'").collect()}
    assert all(got[f"c{i + 1}"] == pytest.approx(0.85 * got[f"c{i}"], rel=1e-3) and got[f"c{i}"] > 0 for i in range(far))


def test_names_and_tags_never_take_the_article():
    text = site_templates.lone_text
    assert text("<div class='content has-sidebar'><p>Story</p></div>") == ["Story"]
    assert text("<article class='post no-comments'><p>Story</p></article>") == ["Story"]
    assert text("<section id='social-policy'><p>Policy</p></section><div class='social'>Share</div><p>Further text</p>") == ["Policy", "Further text"]
    assert text("<form><nav><a>Menu</a></nav><div><p>The whole story of a page</p></div></form>") == ["The whole story of a page"]
    assert text("<form class='search'><main><p>Story</p><div class='ad'>Buy</div></main></form>") == ["Story"]
    assert text("<div class='banner'><article><p>Story</p></article></div><div class='sidebar'><p>A long text outside of the article</p></div>") == ["Story"]
    assert text("<main><article><p>A story</p></article><div id='comments'><article><p>Nice</p></article></div></main>") == ["A story"]


def test_parts_on_many_but_not_most_pages_go(spark):
    box = "<div class='x1'><a href='/a'>News</a><a href='/b'>Sport</a></div>"
    rows = [(i, f"http://s.org/{i}", f"<body>{box if i < 10 else ''}<div>Story {i}</div></body>") for i in range(25)]
    rows += [(100 + i, f"http://t.org/{i}", f"<body>{box}<div>Story {i}</div></body>") for i in range(6)]
    rows += [(200 + i, f"http://u.org/{i}", f"<article><p>Read our letter</p><p>Story {i}</p></article>") for i in range(60)]
    rows += [(300 + i, f"http://v.org/{i}", "<body><div>Copied story</div></body>") for i in range(12)]
    got = {r.page_id: r.text for r in site_templates.main_text(pages(spark, rows)).collect()}
    assert all(got[a + i] == f"Story {i}" for a, k in ((0, 25), (100, 6), (200, 60)) for i in range(k))
    assert all(got[300 + i] == "Copied story" for i in range(12))


BODY = "".join(f"<p>{w} is told here at some length, as it was found by those who saw it happen.</p>" for w in ("First", "Then", "Last"))


def test_an_article_under_several_addresses_stays(spark):
    rows = [(i, f"http://s.org/{i}", f"<body><div><p>Story {i} of a day, with words of its own that no other page has, {i * 7}.</p></div></body>") for i in range(44)]
    rows += [(100 + i, f"http://s.org/a{i}", f"<body><h1>T{i}</h1><div class='text'>{BODY}</div><div>visit {i}</div></body>") for i in range(6)]
    rows += [(200 + i, f"http://u.org/{i}", f"<article><h1>T{i}</h1><div>{BODY}</div></article>") for i in range(80)]
    got = {r.page_id: r.text for r in site_templates.main_text(pages(spark, rows)).collect()}
    told = re.sub("</p>", "\n", BODY.replace("<p>", "")).strip()
    assert all(got[100 + i] == f"T{i}\n{told}\nvisit {i}" for i in range(6))
    assert all(got[200 + i] == f"T{i}\n{told}" for i in range(80))


def test_marked_parts_go_by_the_count_of_their_shape(spark):
    story = lambda i: f"<div><p>Story {i} is told here at length, with words that no other page has, {i * 31}.</p></div>"
    rows = [(i, f"http://s.org/{i}", f"<body><div class='menu m1'><p>Links of day {i}</p></div>{story(i)}</body>") for i in range(2)]
    rows += [(10 + i, f"http://h{i}.org/", f"<body><div class='promo'><p>Offer {i}</p></div>{story(i)}</body>") for i in range(7)]
    rows += [(10 + i, f"http://h{i}.org/2", f"<body>{story(100 + i)}</body>") for i in range(7)]
    rows += [(30, "http://o.org/1", f"<body><div class='sidebar odd'><p>Only here</p></div>{story(30)}</body>"), (31, "http://o.org/2", f"<body>{story(31)}<form>Go</form></body>")]
    got = {r.page_id: r for r in site_templates.main_text(pages(spark, rows)).collect()}
    assert all("Links" not in got[i].text and got[i].n_template == 1 for i in range(2))  # on two pages of its host
    assert not any("Offer" in got[10 + i].text for i in range(7))  # once on each host, on seven pages of all
    assert got[30].text.startswith("Only here\n") and got[30].n_template == 0  # a name alone drops nothing
    assert got[31].text.startswith("Story 31") and "Go" not in got[31].text


def brute_text(rows):
    """Counts over lists, then the same three questions for each block and all elements above it."""
    parsed = [(i, url_filter_host(u), h or "", *site_templates.parse(h or "")) for i, u, h in rows]
    same = [p[5] if p[5] is not None else p[2] for p in parsed]
    pages_of, seen = {}, {}
    for p, s in zip(parsed, same):
        pages_of.setdefault(p[1], set()).add(s)
        for tree, _ in p[4]:
            seen.setdefault((p[1], tree), set()).add(s)
    of_all = {}
    for (_, tree), s in seen.items():
        of_all[tree] = of_all.get(tree, 0) + len(s)

    def gone(host, tree):
        n, total, kind = len(seen[host, tree]), len(pages_of[host]), tree & 3
        if tree == site_templates.ALWAYS:
            return True
        if kind == site_templates.SHAPE:
            return n >= min(2, total) or of_all[tree] >= 6
        return kind == site_templates.CONTENT and n >= 6 and n >= 0.1 * total or kind == site_templates.PASSAGE and n >= 50 and n >= 0.3 * total

    out = []
    for i, host, _, blocks, nodes, _ in parsed:
        kept = []
        for text, node, outside in blocks:
            above = []
            while node >= 0:
                above.append(nodes[node][0])
                node = nodes[node][1]
            if not outside and not any(gone(host, t) for t in above):
                kept.append(text)
        out.append((i, "\n".join(kept)))
    return sorted(out)


def url_filter_host(url):
    return rule_of(url)[0]


@pytest.mark.parametrize("broadcast", [0, 500_000])
def test_given_pages_match_a_plain_version_and_the_counts_remove_blocks(spark, monkeypatch, broadcast):
    monkeypatch.setattr(site_templates, "BROADCAST_TREES", broadcast)
    given = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = [(r.page_id, r.url, r.html) for r in given.collect()]
    got = site_templates.main_text(given).collect()
    assert sorted((r.page_id, r.text) for r in got) == brute_text(rows)
    # Menus, adverts and footers, whose text differs on every page, go by the counts of their shapes: all that HTML puts outside of the article.
    assert sum(r.n_template for r in got) > 5 * len(rows) and sum(r.n_outside for r in got) == 0
