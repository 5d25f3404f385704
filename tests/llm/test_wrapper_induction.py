import random
import time

from pyspark.sql import functions as F

from millrace.llm import wrapper_induction as X
from millrace.llm.html_tree import Page


def texts(spark, rows):
    return {r.page_id: r.text for r in X.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_constant_slots_are_template(spark):
    site = [
        (i, f"http://s.example/{i}", f"<html><head><title>t</title></head><body><div class=top><div>Home | About us</div><div>My Site</div></div>"
         f"<div class=body><p>Story {i} begins &amp; goes<br>on <b>bo</b>ld <a href='/x'>link {i}</a>.<p>Next {i * 7}</div><div class=btm>Copyright someone</div></body></html>")
        for i in range(8)
    ]
    assert texts(spark, site) == {i: f"Story {i} begins & goes on bold link {i}. Next {i * 7}" for i in range(8)}
    # Copies of one page are no template.
    same = [(i, "http://c.example/", site[0][2]) for i in range(8)]
    assert set(texts(spark, same).values()) == {"Home | About us My Site Story 0 begins & goes on bold link 0. Next 0 Copyright someone"}


def test_elements_that_are_no_article(spark):
    rows = [
        (1, "http://q/", '<article><header class="h"><h1>T</h1><span>by me</span></header><p title="a>b">x<!-- > --> y</p><div class="comments">c</div>'
         "<aside>z</aside><form>q</form><div role=alert>r</div><p hidden>h</p></article><footer>f</footer>"),
        (2, None, "plain text &lt;b&gt; &copy &#233;"), (3, "x", None), (4, "x", ""), (5, "http://q/", "<p>cut off <a hre"), (6, "http://q/", "<p>one<script>if(a<b){'</p>'}</script>two</p><p>&nbsp;</p>"),
        (7, "http://q/", "<body class='sidebar'><div class='content-sidebar'>a<style>x</style>b</div>"), (7, "http://q/", "<ul><li>a<li>b</ul>tail"),
    ]
    got = sorted(((r.page_id, r.text) for r in X.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("_wrapper", F.lit(1))).collect()))
    assert got == [(1, "T x y"), (2, "plain text <b> © é"), (3, ""), (4, ""), (5, "cut off"), (6, "onetwo"), (7, "a b tail"), (7, "ab")]
    assert X.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def random_tree(rng, n, labels="ab"):
    nodes, parents = [["#root", -1, 0]], [0]
    for _ in range(n):
        # Keep siblings in page order: a parent on the rightmost path.
        path = [len(nodes) - 1]
        while nodes[path[-1]][1] >= 0:
            path.append(nodes[path[-1]][1])
        nodes.append([rng.choice(labels), rng.choice(path), rng.choice([0, 1, 2])])
    return nodes


def largest(a, b):
    """Simple tree matching by its recursive definition."""
    kids = lambda t, n: [i for i, x in enumerate(t) if x[1] == n]

    def match(x, y):
        if a[x][0] != b[y][0]:
            return 0
        left, right = kids(a, x), kids(b, y)

        def best(i, j):
            if i == len(left) or j == len(right):
                return 0
            w = match(left[i], right[j])
            return max(best(i + 1, j), best(i, j + 1), w and w + best(i + 1, j + 1))

        return 1 + best(0, 0)

    return match(0, 0)


def test_tree_matching_is_the_largest_match():
    rng = random.Random(5)
    for _ in range(400):
        a, b = random_tree(rng, rng.randrange(10)), random_tree(rng, rng.randrange(10))
        pairs = X.tree_match(a, b, frozenset([2]))
        assert len(pairs) == largest(a, b)
        partner = dict(pairs)
        assert len(partner) == len(pairs) == len(set(partner.values()))
        for x, y in pairs:
            assert a[x][0] == b[y][0] and (x == 0 or partner[a[x][1]] == b[y][1])
        for x, y in pairs:
            assert all(y < z for w, z in pairs if w > x and a[w][1] == a[x][1])


def test_merged_trees_hold_both():
    rng = random.Random(6)
    for _ in range(200):
        a, b = random_tree(rng, rng.randrange(9)), random_tree(rng, rng.randrange(9))
        both = X.merge(a, b, frozenset())
        assert len(X.tree_match(a, both)) == len(a) and len(both) == len(a) + len(b) - largest(a, b)
        assert all(n[1] < i for i, n in enumerate(both))


def test_long_sibling_lists_stay_bounded():
    def flat(n, seed):
        rng = random.Random(seed)
        return [["#root", -1, 0]] + [[rng.choice(["p", "div"]), 0, rng.randrange(1, 1000)] for _ in range(n)]

    start = time.time()
    assert len(X.tree_match(flat(1500, 1), flat(1500, 2))) > 1000
    assert len(X.tree_match(flat(30_000, 1), flat(30_000, 2))) > 15_000
    assert time.time() - start < 60
    start = time.time()
    Page("<div>" * 20_000 + "</p>" * 20_000)
    assert time.time() - start < 5


def test_long_sibling_lists_are_matched_whole(monkeypatch):
    """A block before one of two long lists moves all other partners (F2)."""
    rest = [["p", 0, 10 + i] for i in range(1200)]
    ads = [["div", 0, 5] for _ in range(900)]
    a, b = [["#root", -1, 0], ["h1", 0, 1], *ads, *rest, ["h1", 0, 2]], [["#root", -1, 0], ["h2", 0, 3], *rest, *ads, ["h2", 0, 4]]
    partner = dict(X.tree_match(a, b))
    assert [a[x][2] for x in partner] == [b[y][2] for y in partner.values()] and len(partner) == 1201
    # Inside of an element too, where shapes alone count.
    inner = [[["#root", -1, 0], ["body", 0, 0], *[[n, 1, t] for n, _, t in nodes[1:]]] for nodes in (a, b)]
    assert len(X.tree_match(*inner)) == 1202
    # Every row of the table, however few are held, gives the match of the whole table.
    rng = random.Random(3)
    for _ in range(150):
        left, right = ([rng.randrange(6) for _ in range(rng.randrange(1, 30))] for _ in "ab")
        own = {(x, y): rng.choice([0, 0, 1, 2, 5]) for x in range(6) for y in range(6)}
        monkeypatch.setattr(X, "FEW_PAIRS", 10_000)
        whole = X.best_pairs(left, right, lambda x, y: own[x, y])
        monkeypatch.setattr(X, "FEW_PAIRS", 0)
        for cells in (1, 20, 60, 10_000):
            monkeypatch.setattr(X, "MOST_CELLS", cells)
            assert X.best_pairs(left, right, lambda x, y: own[x, y]) == whole
            assert X.best_sum(left, right, lambda x, y: own[x, y]) == sum(w for _, _, w in whole)


def test_long_and_short_lists_are_matched_alike(monkeypatch):
    rng = random.Random(4)
    for _ in range(200):
        a, b = random_tree(rng, rng.randrange(20)), random_tree(rng, rng.randrange(20))
        monkeypatch.setattr(X, "FEW_PAIRS", 100_000)
        short = X.tree_match(a, b, frozenset([2]))
        monkeypatch.setattr(X, "FEW_PAIRS", 0)
        assert X.tree_match(a, b, frozenset([2])) == short


STORY = "Story {i} goes on for a while and says number {k} of many things."


def site(spark, make, n=8):
    return texts(spark, [(i, f"http://s.example/{i}", make(i)) for i in range(n)])


def test_unclassed_siblings_are_told_apart(spark):
    for tag, around in (("div", "<body>{}</body>"), ("td", "<table><tr>{}</tr></table>")):
        def make(i):
            parts = ["Home | About | Contact", f"Story {i}", "Copyright someone"]
            return around.format("".join(f"<{tag}>{x}</{tag}>" for x in parts))

        assert site(spark, make) == {i: f"Story {i}" for i in range(8)}


def test_optional_block_like_the_story_is_template(spark):
    def make(i):
        offer = "<div class=x>Special offer</div>" if i % 2 else ""
        return f"<body><div class=top>Home</div>{offer}<div class=x>Story {i}</div><div class=end>Bye</div></body>"

    assert site(spark, make, 16) == {i: f"Story {i}" for i in range(16)}


def test_notices_comments_and_other_stories():
    story = "<p>The story goes on for quite a while and says many things that matter.</p>"
    for name in ("cookie-message", "user-comments-thread", "comments", "reader-comments", "site-nav-list"):
        assert X.extract(f"{story}<div class='{name}'>{'other words of readers ' * 40}</div>", None) == X.extract(story, None)
    page = f"<main><h1>Title</h1><article>{story}</article><div>Latest: other stories</div></main>"
    assert X.extract(page, None) == "Title " + X.extract(story, None)
    assert X.extract(f"<div class='sidebar'><article>{story}</article></div>", None) == X.extract(story, None)


def test_deep_pages_need_no_recursion():
    page = Page("<div>" * 20_000 + "x")
    assert X.extract("<div>" * 20_000 + "x", None) == "x" and len(X.skeleton(page)[0]) == 20_001


def test_copies_of_a_page_count_once(spark):
    def page(body):
        return f"<body><div class=top>Home | About us</div><div class=text>{body}</div></body>"

    many = [(i, f"http://s.example/{i}", page("".join(f"<p>Story {i}</p><h2>{k}</h2>" for k in range(1 + i % 7)))) for i in range(20)]
    article = page("<p>A long report of the day.</p><blockquote>What the witness said in full.</blockquote><p>And how it ended there.</p>")
    copies = [(100 + i, f"http://s.example/c{i}", article) for i in range(12)]
    other = [(200 + i, f"http://s.example/o{i}", page(f"<p>A report {i}.</p>")) for i in range(3)]
    got = texts(spark, many + copies + other)
    assert {got[i] for i, _, _ in copies} == {"A long report of the day. What the witness said in full. And how it ended there."}


def test_classes_of_content_that_hold_a_menu_word():
    story = "<p>The story goes on for quite a while and says many things that matter.</p>"
    kept = [
        "<pre>x = 1 <span class='hljs-comment'># why</span></pre>", "<section id='related-work'>Others did</section>",
        "<div class='share-price'>12 euro</div>", "<p class='search-term'>whale</p>",
    ]
    for part in kept:
        assert X.extract(f"<p>stray</p>{story}{part}", None).endswith(X.extract(part, None))
    assert X.extract(f"<p>stray</p><div class='layout has-sidebar'>{story}</div>", None).startswith("stray The story")
    assert X.extract(f"<p>stray</p><div class='content-sidebar'>{story}</div>", None).startswith("stray The story")
    for name in ("site-nav", "comment-list", "sidebar-1", "cookie-banner", "post share"):
        assert "menu" not in X.extract(f"{story}<div class='{name}'>menu</div>", None)


def test_template_goes_from_short_pages_too(spark):
    menu = "Home | About us | All the topics of this site in a long line"
    odd = [(0, "http://s.example/0", "<body><div class=top>Another line</div><div class=text><p>Story 0</p></div></body>")]
    site = [(i, f"http://s.example/{i}", f"<body><div class=top>{menu}</div><div class=text><p>Story {i}</p></div></body>") for i in range(1, 12)]
    got = texts(spark, odd + site)
    assert got == {0: "Another line Story 0", **{i: f"Story {i}" for i in range(1, 12)}}


def test_template_that_only_rare_skeletons_have(spark):
    # Every page has its own number of list items and paragraphs, so eight skeletons are merged of
    # forty; a notice that a third of the pages have is in none of them.
    def page(i):
        notice = "<section><div><b>Prices may change at any time</b></div></section>" if i >= 24 else ""
        body = "".join(f"<p>Story {i} part {k} of its own.</p>" for k in range(1 + i % 4)) + "".join(f"<h3>Head {i} {k}</h3>" for k in range(i % 3))
        # The first eight kinds of page come twice and win the wrapper.
        return f"<html><body><div class=top>Home</div><div class=body>{body}{'<ol><li>x</ol>' * (i // 12 if i >= 24 else 0)}{notice}</div></body></html>"

    rows = [(i, f"http://r.example/{i}", page(i)) for i in range(36)]
    merged = {}
    for i, _, html in rows:
        form = str([n[:2] for n in X.skeleton(Page(html))[0]])
        merged.setdefault(form, []).append(i)
    assert len(merged) > X.Settings().merged
    got = texts(spark, rows)
    assert not [i for i, t in got.items() if "Prices" in t or "Home" in t]
    assert all(f"Story {i} part {k} of its own." in got[i] for i in range(36) for k in range(1 + i % 4))


def test_every_node_has_a_slot():
    seed = X.skeleton(Page("<body><div>a</div></body>"))[0]
    h = X.hash_text
    for texts, order in ((["x", "note"], ["note", "x"]), (["note"], ["note"]), (["x", "y", "note", "z"], ["note", "x", "y", "z"])):
        own = X.skeleton(Page("<body><div>a</div><section>" + "".join(f"<p>{t}</p>" for t in texts) + "</section></body>"))[0]
        slots = X.slots_of(own, X.tree_match(own, seed), {h("note"): 0})
        assert None not in slots and len(set(slots)) == len(slots)
        by_text = {n[2]: s for n, s in zip(own, slots)}
        place = X.slots_of([*own[:-len(texts)], ["p", own[-1][1], h("note")]], X.tree_match(own[:-len(texts)], seed), {h("note"): 0})[-1]
        assert by_text[h(order[0])] == place < 0
