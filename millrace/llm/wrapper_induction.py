"""HTML extraction by wrapper induction.

Pages of one host are made from a template. Every page is reduced to a skeleton: its tree of block
elements, each with a hash of its own text. The most frequent skeletons of a host are merged into its
wrapper by partial tree alignment: the first one is the seed, parts that only others have are put
in where their matched neighbours are. Every page is aligned with the wrapper by simple tree
matching, the largest match of two trees that keeps labels, parents and the order of siblings; a
pair of siblings weighs as much as their two subtrees match. Among equally large matches the one
with more equal texts wins. Counts over all pages of the host then tell constant slots, which are
template, from varying ones, which are content.

No node of a page is left out of these counts. One that finds no partner in the wrapper, because its
skeleton was not among the merged ones, has a slot of its own beside the wrapper: the slot of its
parent, its label and its number among the siblings of that label without a partner, those with the
texts that most pages of the host have first.

A page's text is what is left of its article (the ``article`` or ``main`` element, or the body)
without constant slots and without elements that are no article by their meaning: menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles and reader comments, by tag, role or
class. Skeletons, alignments and wrappers are small rows; only they are shuffled, unless there are
so many hosts that wrappers have to be joined to the pages by a shuffle.

Copies of a page count once. A slot is template if seven tenths of the host's distinct pages that
have the slot hold the same text in it, and these are a fifth of all its distinct pages and five at
least; some slot of the host has to vary. Constant slots stay in a page only if nothing else
would be left of it.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.html_tree import INLINE, Page, join_blocks
from millrace.llm.stage import stored

NO_TEXT = frozenset("head script style noscript noframes template iframe object embed svg canvas math audio video title xmp".split())
NO_ARTICLE = frozenset("nav footer aside form button select option textarea input dialog menu datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status".split())
CLASS_WORDS = frozenset(
    "ad ads advert adverts advertisement adsense sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar widget footer masthead cookie cookies consent notice popup modal newsletter subscribe share sharing social comment "
    "comments disqus respond replies related recommended recommendations pagination pager toolbar login signup search gdpr".split()
)
# Parts that may stand around such a word in a class: "user-comments-thread" are the comments, "share-price" is no menu.
CLASS_ENDS = frozenset(
    "list item items link links buttons button posts articles form box area container wrapper wrap inner outer bar block section thread message messages "
    "text panel row group holder overlay dialog count".split()
)
CLASS_STARTS = frozenset("user users reader readers site page global main primary secondary top bottom left right post article js my the blog".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
WORD = re.compile(r"[A-Za-z]+")
PARTS = re.compile(r"[a-z]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass(frozen=True)
class Settings:
    least_pages: int = 5
    #: Share of the pages with a slot that agree, and share of all pages that these are.
    least_share: float = 0.7
    least_presence: float = 0.2
    #: Skeletons that are merged into a wrapper; nodes that only others have get slots beside it.
    merged: int = 8


def hash_text(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def label_of(page: Page, element: int) -> str:
    attrs = page.attributes(element) if page.attrs[element] else {}
    names = WORD.findall(attrs.get("class", "") or attrs.get("id", ""))
    return page.tag[element] + ("." + names[0].lower() if names else "")


def skeleton(page: Page) -> tuple[list[list], list[int]]:
    """``(nodes, slot of element)``: a node is ``[label, parent, hash of its own text]``, parents
    before children and siblings in page order. Inline elements belong to the block that holds them."""
    nodes: list[list] = [["#root", -1, 0]]
    slot = [0] * len(page.tag)
    for e in range(1, len(page.tag)):
        holder = slot[page.parent[e]]
        if page.tag[e] in INLINE or page.tag[e] in NO_TEXT or page.tag[e] == "br":
            slot[e] = holder
        else:
            slot[e] = len(nodes)
            nodes.append([label_of(page, e), holder, 0])
    texts: dict[int, list[str]] = {}
    for element, text, _ in page.segments:
        if page.tag[element] not in NO_TEXT:
            texts.setdefault(slot[element], []).append(text)
    for n, own in texts.items():
        words = " ".join(" ".join(own).split())
        nodes[n][2] = hash_text(words) if words else 0
    return nodes, slot


#: Numbers of a table that are held at once; of two sibling lists with more pairs some rows are
#: kept, and those between them are made again where the match goes through them.
MOST_CELLS = 8_000_000
#: Two sibling lists with more pairs are matched in arrays.
FEW_PAIRS = 100_000
#: Numbers of known matches that are kept.
MOST_KNOWN = 200_000
#: A matched node counts so much more than an equal text.
NODE = 1 << 20


class Shapes:
    """Numbers for subtree shapes (label and shapes of the children), and how many nodes any two of
    them match at most. Equal shapes are compared once, however many subtrees have them."""

    def __init__(self):
        self.number: dict[tuple, int] = {}
        self.kids: list[tuple[int, ...]] = []
        self.label: list[int] = []
        self.size: list[int] = []
        self.labels: dict[str, int] = {}
        self.known: dict[tuple[int, int], int] = {}

    def of_tree(self, nodes: list[list]) -> tuple[list[int], list[list[int]]]:
        """Shape of each node, and its children."""
        children: list[list[int]] = [[] for _ in nodes]
        for i, (_, parent, _) in enumerate(nodes):
            if parent >= 0:
                children[parent].append(i)
        shape = [0] * len(nodes)
        for i in range(len(nodes) - 1, -1, -1):
            label = self.labels.setdefault(nodes[i][0], len(self.labels))
            key = (label, *[shape[c] for c in children[i]])
            found = self.number.get(key)
            if found is None:
                found = self.number[key] = len(self.kids)
                self.kids.append(key[1:])
                self.label.append(label)
                self.size.append(1 + sum(self.size[c] for c in key[1:]))
            shape[i] = found
        return shape, children

    def match(self, a: int, b: int) -> int:
        """Nodes of the largest match of two subtrees whose roots are matched, 0 if their labels differ."""
        todo = [(a, b)]
        while todo:
            x, y = todo[-1]
            if (x, y) in self.known:
                todo.pop()
            elif self.label[x] != self.label[y]:
                self.known[x, y] = 0
            elif x == y:
                self.known[x, y] = self.size[x]
            else:
                left, right = self.kids[x], self.kids[y]
                s, e = equal_ends(left, right, lambda i, j: i == j)
                own, other = left[s : len(left) - e], right[s : len(right) - e]
                open_pairs = [(i, j) for i in set(own) for j in set(other) if (i, j) not in self.known]
                if open_pairs:
                    todo += open_pairs
                    continue
                ends = sum(self.size[k] for k in (*left[:s], *left[len(left) - e :]))
                middle = best_sum(own, other, lambda i, j: self.known[i, j])
                self.known[x, y] = 1 + ends + middle
        return self.known[a, b]


def equal_ends(left: list[int], right: list[int], same) -> tuple[int, int]:
    """Lengths of the equal beginning and of the equal end of the rest. Equal subtrees at an end can
    always be matched without losing anything."""
    n, s, e = min(len(left), len(right)), 0, 0
    while s < n and same(left[s], right[s]):
        s += 1
    while e < n - s and same(left[-1 - e], right[-1 - e]):
        e += 1
    return s, e


def weight_rows(left: list[int], right: list[int], weight):
    """Function from a place in ``left`` to its weights with all of ``right``. Equal values weigh the same."""
    number: dict[int, int] = {}
    place = np.array([number.setdefault(y, len(number)) for y in right])
    made: dict[int, np.ndarray] = {}

    def row(i: int) -> np.ndarray:
        x = left[i]
        if x not in made:
            if len(made) * len(number) > MOST_CELLS:
                made.clear()
            made[x] = np.fromiter((weight(x, y) for y in number), np.int64, len(number))
        return made[x][place]

    return row


def next_row(above: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Largest sums with one more of the left list, for all beginnings of the right one. ``weights``
    are overwritten."""
    out = np.zeros_like(above)
    weights += above[:-1]
    np.maximum(weights, above[1:], out=weights)
    np.maximum.accumulate(weights, out=out[1:])
    return out


def best_sum(left: list[int], right: list[int], weight) -> int:
    """The weight of the match that ``best_pairs`` finds."""
    if len(left) * len(right) <= FEW_PAIRS:
        return sum(w for _, _, w in best_pairs(left, right, weight))
    row, sums = weight_rows(left, right, weight), np.zeros(len(right) + 1, np.int64)
    for i in range(len(left)):
        sums = next_row(sums, row(i))
    return int(sums[-1])


def long_pairs(low: int, high: int, above: np.ndarray, row) -> list[tuple[int, int, int]]:
    """``best_pairs`` of the places ``low`` to ``high`` of the left list, the last pair first; ``above``
    is the row of the table before them, ``row(i)`` the weights of place ``i``."""
    count, width = high - low, len(above)
    if count > 1 and count * width > MOST_CELLS:
        step = -(-count // max(2, MOST_CELLS // width))
        kept = []
        for i in range(low, high):
            if (i - low) % step == 0:
                kept.append(above)
            above = next_row(above, row(i)[: width - 1])
        out: list[tuple[int, int, int]] = []
        for k in range(len(kept) - 1, -1, -1):
            # What is left of the right list lies before the last pair found.
            start, end = low + k * step, min(low + (k + 1) * step, high)
            out += long_pairs(start, end, kept.pop()[: out[-1][1] + 1 if out else width], row)
        return out
    table = [above]
    for i in range(low, high):
        table.append(next_row(table[-1], row(i)[: width - 1]))
    out, i, j = [], count, width - 1
    while i and j:
        if table[i][j] == table[i - 1][j]:
            i -= 1
        elif table[i][j] == table[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((low + i, j, int(table[i + 1][j + 1] - table[i][j])))
    return out


def best_pairs(left: list[int], right: list[int], weight, rows=None) -> list[tuple[int, int, int]]:
    """``(place in left, place in right, weight)`` of the order-keeping match of two lists with the
    largest sum; ``weight(x, y)`` is that of a pair, 0 for none, and depends on the two values only.
    ``rows(left, right)`` may give the function that ``weight_rows`` makes otherwise."""
    if not left or not right:
        return []
    if len(left) * len(right) > FEW_PAIRS:
        row = rows(left, right) if rows else weight_rows(left, right, weight)
        return long_pairs(0, len(left), np.zeros(len(right) + 1, np.int64), row)[::-1]
    if len(left) == 1 == len(right):
        w = weight(left[0], right[0])
        return [(0, 0, w)] if w else []
    table, weights = [[0] * (len(right) + 1)], []
    for x in left:
        above, row, best = table[-1], [0], 0
        own = [weight(x, y) for y in right]
        for j, w in enumerate(own):
            if w and above[j] + w > best:
                best = above[j] + w
            if above[j + 1] > best:
                best = above[j + 1]
            row.append(best)
        table.append(row)
        weights.append(own)
    out, i, j = [], len(left), len(right)
    while i and j:
        if table[i][j] == table[i - 1][j]:
            i -= 1
        elif table[i][j] == table[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j, weights[i][j]))
    return out[::-1]


def tree_match(a: list[list], b: list[list], fixed: frozenset[int] = frozenset(), shapes: Shapes | None = None) -> list[tuple[int, int]]:
    """Simple tree matching: pairs ``(node of a, node of b)`` of a largest match that keeps labels,
    parents and order of siblings. Among equally large sibling matches one with more equal texts is
    taken, and one that leaves a node with a text of ``fixed`` alone rather than with another text.
    ``shapes`` are kept for further matches."""
    shapes = shapes or Shapes()
    if len(shapes.known) > MOST_KNOWN:
        shapes.__init__()
    (shape_a, kids_a), (shape_b, kids_b) = shapes.of_tree(a), shapes.of_tree(b)
    text_a, text_b = [n[2] for n in a], [n[2] for n in b]
    known, match = shapes.known, shapes.match

    def weight(x: int, y: int) -> int:
        pair = shape_a[x], shape_b[y]
        n = known.get(pair)
        if n is None:
            n = match(*pair)
        if not n:
            return 0
        own, other = text_a[x], text_b[y]
        if own == other:
            return n * NODE + (12 if own else 8)
        return n * NODE + (4 if other in fixed or own in fixed else 8)

    def same(x: int, y: int) -> bool:
        return shape_a[x] == shape_b[y] and text_a[x] == text_b[y]

    def rows(left: list[int], right: list[int]):
        """As ``weight_rows``, with all texts of a row compared at once."""
        nodes = weight_rows([shape_a[x] for x in left], [shape_b[y] for y in right], match)
        other_texts = np.where([text_b[y] in fixed for y in right], 4, 8)
        made: dict[tuple[int, bool], np.ndarray] = {}
        places: dict[int, list[int]] = {}
        for j, y in enumerate(right):
            places.setdefault(text_b[y], []).append(j)
        of_text = {t: np.array(at) for t, at in places.items()}

        def row(i: int) -> np.ndarray:
            own = text_a[left[i]]
            kind = shape_a[left[i]], own in fixed
            if kind not in made:
                if len(made) * len(right) > MOST_CELLS:
                    made.clear()
                n = nodes(i)
                made[kind] = np.where(n > 0, n * NODE + (4 if kind[1] else other_texts), 0)
            out = made[kind].copy()
            if own in of_text:
                n = out[of_text[own]] // NODE
                out[of_text[own]] = np.where(n > 0, n * NODE + (12 if own else 8), 0)
            return out

        return row

    pairs, todo = [], [(0, 0)] if a[0][0] == b[0][0] else []
    while todo:
        x, y = todo.pop()
        pairs.append((x, y))
        left, right = kids_a[x], kids_b[y]
        if left and right:
            s, e = equal_ends(left, right, same)
            todo += zip(left[:s], right[:s])
            todo += zip(left[len(left) - e :], right[len(right) - e :])
            todo += [(left[s + i], right[s + j]) for i, j, _ in best_pairs(left[s : len(left) - e], right[s : len(right) - e], weight, rows)]
    return pairs


def merge(seed: list[list], other: list[list], fixed: frozenset[int]) -> list[list]:
    """``seed`` with the subtrees of ``other`` that match nothing in it, each after the node that its
    left neighbour matches, or first."""
    partner = dict(tree_match(other, seed, fixed))
    if len(partner) == len(other):
        return seed
    kids: list[list] = [[] for _ in range(len(seed) + len(other))]
    nodes = [list(n) for n in seed]
    for i, (_, parent, _) in enumerate(seed):
        if parent >= 0:
            kids[parent].append(i)
    after: dict[int, int] = {}
    for i, (label, parent, text) in enumerate(other):
        if parent < 0:
            continue
        holder, left = partner[parent], after.get(parent)
        if i not in partner:
            partner[i] = len(nodes)
            nodes.append([label, holder, text])
            kids[holder].insert(0 if left is None else kids[holder].index(left) + 1, partner[i])
        after[parent] = partner[i]
    # Parents before children again.
    place, out, todo = {}, [], [0]
    while todo:
        n = todo.pop()
        place[n] = len(out)
        out.append([nodes[n][0], place.get(nodes[n][1], -1), nodes[n][2]])
        todo += reversed(kids[n])
    return out


def slots_of(nodes: list[list], pairs: list[tuple[int, int]], fixed: dict[int, int]) -> list[int]:
    """Slot of each node of a page: its partner in the wrapper, else a negative number made of its
    parent's slot, its label and its place among its siblings of that label without a partner. Of
    these the ones with a text of ``fixed`` come first, in that order, so that a text keeps its place
    whatever stands around it."""
    out: list[int | None] = [None] * len(nodes)
    for n, w in pairs:
        out[n] = w
    alone: dict[tuple[int, str], list[int]] = {}
    for i, (label, parent, _) in enumerate(nodes):
        if out[i] is None:
            alone.setdefault((parent, label), []).append(i)
    # Parents come before their children, and so do their groups.
    for (parent, label), own in alone.items():
        holder = out[parent] if parent >= 0 else -1
        own.sort(key=lambda i: fixed.get(nodes[i][2], len(fixed)))
        for nth, i in enumerate(own):
            out[i] = -1 - (xxhash.xxh64_intdigest(f"{holder} {nth} {label}") >> 1)
    return out


def ranks(texts: list[int]) -> dict[int, int]:
    return {h: i for i, h in enumerate(texts)}


def named_no_article(names: str) -> bool:
    """Whether a class or id is a word for menus, notices, adverts or comments, with nothing around it
    but words for its owner, place or kind."""
    for token in names.lower().split():
        parts = PARTS.findall(token)
        if not parts or (len(parts) > 1 and parts[0] in ("has", "no", "with", "without")):
            continue
        while len(parts) > 1 and parts[0] in CLASS_STARTS:
            parts = parts[1:]
        while len(parts) > 1 and parts[-1] in CLASS_ENDS:
            parts = parts[:-1]
        if all(x in CLASS_WORDS for x in parts):
            return True
    return False


def text_sizes(page: Page) -> list[int]:
    """Characters of text inside each element."""
    out = [0] * len(page.tag)
    for element, text, _ in page.segments:
        if page.tag[element] not in NO_TEXT:
            out[element] += len("".join(text.split()))
    for e in range(len(out) - 1, 0, -1):
        out[page.parent[e]] += out[e]
    return out


def no_article(page: Page, element: int, by_class: bool) -> str:
    """"all" if an element is no part of an article, "title" if only its headings are, else ""."""
    tag = page.tag[element]
    if tag in NO_TEXT or tag in NO_ARTICLE:
        return "all"
    if tag == "header":
        return "title"
    if not page.attrs[element]:
        return ""
    attrs = page.attributes(element)
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or HIDDEN.search(attrs.get("style", "")):
        return "all"
    if attrs.get("role", "").lower() in ROLES:
        return "all"
    if by_class and tag not in ("html", "body", "main", "article") and tag not in INLINE:
        names = attrs.get("class", "") + " " + attrs.get("id", "")
        if named_no_article(names):
            return "all"
        if "header" in {w.lower() for w in WORD.findall(names)}:
            return "title"
    return ""


def article_elements(page: Page, by_class: bool) -> list[bool]:
    """Which elements belong to the article by their meaning."""
    count = len(page.tag)
    kinds = [""] + [no_article(page, e, by_class) for e in range(1, count)]
    holds = [page.tag[e] in ("main", "article") for e in range(count)]
    for e in range(count - 1, 0, -1):
        holds[page.parent[e]] |= holds[e]
    banned, titles = [False] * count, [False] * count
    for e in range(1, count):
        parent = page.parent[e]
        # What holds an article is layout, whatever its class says.
        banned[e] = banned[parent] or (kinds[e] == "all" and not (holds[e] and by_class and no_article(page, e, False) != "all"))
        titles[e] = titles[parent] or kinds[e] == "title"
    roots = [e for e in range(1, count) if not banned[e] and page.tag[e] == "main"]
    articles = [e for e in range(1, count) if not banned[e] and page.tag[e] == "article"]
    if roots and articles:
        roots = inner_articles(page, roots, articles)
    roots = roots or articles
    inside, headed = [False] * count, [False] * count
    inside[0] = not roots
    chosen = set(roots)
    for e in range(1, count):
        inside[e] = inside[page.parent[e]] or e in chosen
        headed[e] = headed[page.parent[e]] or page.tag[e] in HEADINGS
    # A header in the article holds its title; one outside belongs to the site.
    return [inside[e] and not banned[e] and (not titles[e] or (bool(roots) and headed[e])) for e in range(count)]


def inner_articles(page: Page, roots: list[int], articles: list[int]) -> list[int]:
    """``main`` elements, each replaced by the article in it that holds most of its text, with the
    first-level headings in it that lie in no article."""
    sizes, out = text_sizes(page), []
    owner, article = [0] * len(page.tag), [0] * len(page.tag)
    of_main, of_article = set(roots), set(articles)
    for e in range(1, len(page.tag)):
        owner[e] = e if e in of_main else owner[page.parent[e]]
        article[e] = article[page.parent[e]] or (e if e in of_article else 0)
    for root in roots:
        most = next((e for e in articles if article[e] == e and owner[e] == root and 2 * sizes[e] > sizes[root]), None)
        out += [root] if most is None else [most, *(e for e in range(root, len(page.tag)) if owner[e] == root and page.tag[e] == "h1" and not article[e])]
    return out


def extract(source: str, wrapper: dict | None) -> str:
    page = Page(source)
    wanted = article_elements(page, True)
    text = join_blocks(page.segments, wanted)
    if not text:
        wanted = article_elements(page, False)
        text = join_blocks(page.segments, wanted)
    if not text or not wrapper:
        return text
    nodes, slot = skeleton(page)
    known = wrapper["constant"]
    slots = slots_of(nodes, tree_match(nodes, wrapper["nodes"], wrapper["fixed"], wrapper["shapes"]), wrapper["ranks"])
    constant = {n for n, w in enumerate(slots) if nodes[n][2] == known.get(str(w), 0) != 0}
    if not constant:
        return text
    # A title may be the same on all pages of a host and is still the article's.
    headed = [page.tag[e] in HEADINGS for e in range(len(page.tag))]
    left = [w and (slot[e] not in constant or headed[e]) for e, w in enumerate(wanted)]
    return join_blocks(page.segments, left) or text


def page_skeletons(source: Column) -> Column:
    @F.arrow_udf(T.StringType())
    def made(column: pa.Array) -> pa.Array:
        return pa.array([json.dumps(skeleton(Page(x.as_py() or ""))[0], separators=(",", ":")) for x in column], pa.string())

    return made(source)


def hashes_of(skeletons: Column) -> Column:
    """Distinct text hashes of a skeleton."""
    @F.arrow_udf(T.ArrayType(T.LongType()))
    def found(column: pa.Array) -> pa.Array:
        return pa.array([sorted({n[2] for n in json.loads(x.as_py())} - {0}) for x in column], pa.list_(pa.int64()))

    return found(skeletons)


def merged_wrapper(skeletons: Column, fixed: Column) -> Column:
    """The wrapper's nodes as JSON from a list of skeletons, the first one being the seed."""
    @F.arrow_udf(T.StringType())
    def made(lists: pa.Array, texts: pa.Array) -> pa.Array:
        out = []
        for x, f in zip(lists, texts):
            first, *others = (json.loads(s) for s in x.as_py())
            known = frozenset(f.as_py())
            for other in others:
                first = merge(first, other, known)
            out.append(json.dumps(first, separators=(",", ":")))
        return pa.array(out, pa.string())

    return made(skeletons, fixed)


SLOTS = T.ArrayType(T.StructType([T.StructField("slot", T.LongType()), T.StructField("hash", T.LongType())]))


def aligned(own: Column, wrapper: Column, fixed: Column) -> Column:
    """Text hashes of a page by slot, in its host's wrapper or beside it (see ``slots_of``)."""

    @F.arrow_udf(SLOTS)
    def matched(pages: pa.Array, wrappers: pa.Array, texts: pa.Array) -> pa.Array:
        out, read = [], {}
        for x, y, f in zip(pages, wrappers, texts):
            text = y.as_py()
            if text not in read:
                read = {text: (json.loads(text), ranks(f.as_py()), Shapes())}
            a, (b, known, shapes) = json.loads(x.as_py()), read[text]
            slots = slots_of(a, tree_match(a, b, frozenset(known), shapes), known)
            out.append([{"slot": w, "hash": node[2]} for w, node in zip(slots, a)])
        return pa.array(out, pa.list_(pa.struct([("slot", pa.int64()), ("hash", pa.int64())])))

    return matched(own, wrapper, fixed)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))


def wrappers(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``(host, wrapper)`` from ``pages`` (``host``, ``html``): the wrapper's nodes and its constant
    slots with the hash of their text, as JSON. Hosts with too few distinct pages have none."""
    shapes = pages.filter("host <> ''").select("host", page_skeletons(F.col("html")).alias("skeleton"))
    # Pages of equal skeletons, text included, are copies and count once.
    shapes = stored(shapes.distinct(), "skeletons")
    form = F.xxhash64(F.regexp_replace("skeleton", r",-?\d+\]", "]"))
    forms = shapes.groupBy("host", form.alias("form")).agg(F.count("*").alias("n"), F.min("skeleton").alias("nodes"))
    sizes = stored(shapes.groupBy("host").agg(F.count("*").alias("pages")).filter(F.col("pages") >= settings.least_pages), "hosts")
    # Texts that many pages have, whatever their place.
    texts = shapes.select("host", F.explode(hashes_of(F.col("skeleton"))).alias("hash")).groupBy("host", "hash").agg(F.count("*").alias("n"))
    often = F.col("n") >= F.greatest(F.lit(settings.least_pages), settings.least_presence * F.col("pages"))
    common = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "hash")))
    fixed = texts.join(sizes, "host").filter(often).groupBy("host").agg(F.transform(common, lambda x: x.hash).alias("fixed"))
    order = Window.partitionBy("host").orderBy(F.desc("n"), "form")
    top = forms.join(sizes, "host").withColumn("k", F.row_number().over(order)).filter(F.col("k") <= settings.merged)
    seeds = top.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "nodes"))), lambda x: x.nodes).alias("nodes"))
    known = seeds.join(fixed, "host", "left").withColumn("fixed", F.coalesce("fixed", F.array().cast("array<bigint>")))
    best = known.join(sizes, "host").select("host", "pages", "fixed", merged_wrapper(F.col("nodes"), F.col("fixed")).alias("nodes"))
    best = stored(best, "wrappers")
    slots = shapes.join(best, "host").select("host", F.explode(aligned(F.col("skeleton"), F.col("nodes"), F.col("fixed"))).alias("s"))
    counts = slots.groupBy("host", "s.slot", "s.hash").agg(F.count("*").alias("n"))
    counts = counts.groupBy("host", "slot").agg(F.max(F.struct("n", "hash")).alias("top"), F.sum("n").alias("having"), F.count("*").alias("texts"))
    counts = counts.join(best.select("host", "pages"), "host")
    enough = F.greatest(F.lit(settings.least_pages), settings.least_presence * F.col("pages"), settings.least_share * F.col("having"))
    agreed = (F.col("top.hash") != 0) & (F.col("top.n") >= enough)
    found = counts.groupBy("host").agg(
        F.max((F.col("texts") > 1).cast("int")).alias("varies"),
        F.map_from_entries(F.collect_list(F.when(agreed, F.struct(F.col("slot").cast("string"), "top.hash")))).alias("constant"),
    )
    found = found.filter("varies = 1 AND size(constant) > 0").join(best, "host")
    made = F.concat(F.lit('{"nodes":'), F.col("nodes"), F.lit(',"fixed":'), F.to_json("fixed"), F.lit(',"constant":'), F.to_json("constant"), F.lit("}"))
    return stored(found.select("host", made.alias("wrapper")), "made-wrappers")


def main_text(source: Column, wrapper: Column) -> Column:
    @F.arrow_udf(T.StringType())
    def extracted(pages: pa.Array, found: pa.Array) -> pa.Array:
        known: dict[str, dict] = {}
        out = []
        for x, w in zip(pages, found):
            source, own = x.as_py(), w.as_py()
            if own is not None and own not in known:
                read = json.loads(own)
                known = {own: read | {"fixed": frozenset(read["fixed"]), "ranks": ranks(read["fixed"]), "shapes": Shapes()}}
            out.append(extract(source, known.get(own)) if source else "")
        return pa.array(out, pa.string())

    return extracted.asNondeterministic()(source, wrapper)


def extract_text(df: DataFrame, html_col: str = "html", url_col: str = "url", out: str = "text", settings: Settings = Settings()) -> DataFrame:
    """All rows and columns of ``df`` and the main text ``out``; a column of that name is replaced.

    Null and empty pages give an empty text. Pages without a host, or of hosts with too few pages,
    are extracted by the meaning of their elements alone. Repeated pages count once. An empty table gives an empty one."""
    free = "_wrapper"
    while any(c.startswith(free) for c in df.columns):
        free += "_"
    host = f"{free}host"
    keyed = df.withColumn(host, host_of(F.col(f"`{url_col}`")))
    found = wrappers(keyed.select(F.col(host).alias("host"), F.col(f"`{html_col}`").alias("html")), settings)
    found = found.select(F.col("host").alias(host), F.col("wrapper").alias(free))
    joined = keyed.join(found, host, "left").withColumn(out, main_text(F.col(f"`{html_col}`"), F.col(free)))
    columns = [*(c for c in df.columns if c != out), out]
    return joined.select(*[F.col(f"`{c}`") for c in columns])
