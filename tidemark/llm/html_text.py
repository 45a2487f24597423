"""HTML extraction by wrapper induction.

Pages of one host come from one template. The steps, on Spark:

1. every page becomes a skeleton: its visible DOM in document order as (parent, label hash, own-text hash, characters, kind), some bytes a node;
2. a host's distinct pages are grouped by layout: sketches of their sets of label paths are compared with those of up to CANDIDATES pages that
   are unlike each other. While LEAST_PAGES pages of a host or more are like none, further layouts are chosen from these, turn by turn, so a host has as
   many as it needs; every page goes with the one that it is most like. Groups of fewer than LEAST_PAGES form the host's rest;
3. per group one page is the pivot; every other page is aligned with it by simple tree matching (ordered, label against label, as
   many nodes as possible, equal texts preferred). All text of a page counts for the pivot node that its nearest matched ancestor is aligned with;
4. from these counts over the whole group (summed by Spark, so a host with a third of all pages is no different from a small one) the
   wrapper is decided: a node whose text stood equal in at least TEMPLATE_SHARE of the pages is constant and belongs to the template, unless
   constant text is nearly all of the group's text (then the host repeats an article); a slot of which more than half is links is a menu; and the
   content lies under the deepest node below which nearly all varying, unlinked text was found;
5. a page's content is read block by block under the node that is aligned with the wrapper's, without constant nodes and menus. What HTML itself
   or a name marks as navigation, notice, form, comments and the like inside it is no content either.

Only pages without a wrapper (no host, or fewer than LEAST_PAGES distinct pages in it) are read by marks alone: all articles, or else main, or
else the part that holds the long text.

Defined results: null or empty html gives an empty text; a rest of fewer pages is aligned with the host's largest group and has no votes; copies of
a page count once in the votes and get equal texts; repeated rows get equal rows; an empty table gives an empty result; tag soup is read as browsers
do in the common cases (implied ends, unclosed elements, raw text), at any depth of nesting; long pages cost memory in proportion to themselves;
only key, url and html are read, so further columns with clashing names don't matter.
"""

from __future__ import annotations

import html as entities
import re
import struct
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow, materialize, table
from tidemark.sources.shared import scratch

TEMPLATE_SHARE, LEAST_PAGES = 0.8, 3
#: Pages of one layout share this part of their label paths, as estimated from SKETCH minima; so many pages of a host may stand for layouts in the
#: first turn, and in a later one at the most.
ALIKE, SKETCH, CANDIDATES, MOST_CANDIDATES = 0.5, 64, 32, 2048
#: Pages of a host that a later turn compares with its layouts in one group.
PART_PAGES = 2000
#: A group of whose unlinked text more than this share is constant repeats an article; that part of the varying text lies under the content's node.
MOST_CONSTANT, CONTENT_SHARE = 0.7, 0.8
#: Bytes of a table up to which it is broadcast; beyond it its rows go out SALTS times, so that no key meets in one task.
BROADCAST_BYTES, SALTS = 16 << 20, 16

# Fixed values of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
BLOCK = set(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption optgroup option".split()
)
#: An element that begins closes these open ones, up to the nearest of the stops.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"})}
ENDS_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup", "caption"}
#: What is never main text, by element, by role and by a part of a class name or id.
NEVER = set("head script style noscript template nav footer aside form button select textarea iframe svg canvas dialog menu object audio video title input label".split())
#: Elements that are never shown as text.
HIDDEN = set("head script style noscript template button select textarea iframe svg canvas object audio video title input label".split())
ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
MARKS = set(
    "nav navbar navigation menu menubar sidebar aside ad ads adv advert adverts advertisement advertising banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login comment comments disqus respond replies reply share sharing social related recommended breadcrumb breadcrumbs pagination pager footer masthead copyright legal widget widgets search toolbar skip".split()
)
#: Parts that mark an element also where they begin its name; others (social-policy, search-engine) must end it.
LEADING = set("ad ads advert adverts advertisement cookie cookies consent gdpr nav navbar sidebar newsletter comment comments disqus share sharing sponsored related recommended breadcrumb pagination".split())
#: What readers add stands in elements of running text as well.
READERS = set("comment comments disqus reply replies respond".split())
#: Elements of running text, which no name but that of readers takes out.
PROSE = set("html body article main p h1 h2 h3 h4 h5 h6 li td th dd dt blockquote pre em strong b i span code figure figcaption".split())
#: Elements that hold a page's text as a whole.
TOP = {"html", "body", "article", "main"}
ARTICLE_MARKS = {"articlebody", "post-content", "entry-content", "article-body", "article-content", "post-body", "main-content", "story-body"}
# Kinds of nodes in a skeleton.
HEADING, RUNNING, ARTICLE = 1, 2, 4

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?|<([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""", re.DOTALL)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][\w:.-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


@dataclass(slots=True)
class Node:
    tag: str
    attributes: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)  # nodes and strings
    number: int = 0


def parse(source: str) -> Node:
    """The DOM of a page, its elements numbered in document order."""
    root = Node("#root")
    stack, at, count = [root], 0, 0
    opened: Counter = Counter()

    def text(raw: str) -> None:
        if raw:
            stack[-1].children.append(entities.unescape(raw) if "&" in raw else raw)

    def leave(k: int) -> None:
        for node in stack[k:]:
            opened[node.tag] -= 1
        del stack[k:]

    def close(tags: set[str], stops: set[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                leave(k)
                return
            if stack[k].tag in stops:
                return

    # Nothing behind the last ">" can end a tag.
    last = source.rfind(">") + 1
    for m in TOKEN.finditer(source, 0, last):
        if m.start() < at:
            continue
        text(source[at : m.start()])
        at = m.end()
        if end := m[1]:
            if opened[end := end.lower()]:
                leave(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == end))
        elif m[2]:
            tag = m[2].lower()
            if tag in ENDS_P and opened["p"]:
                close({"p"}, {"table", "button", "td", "th", "article", "section", "div", "body"})
            if tag in CLOSES:
                close(*CLOSES[tag])
            count += 1
            node = Node(tag, {a[0].lower(): a[1] or a[2] or a[3] for a in ATTRIBUTE.findall(m[3])} if "=" in m[3] or m[3].strip(" /") else {}, [], count)
            stack[-1].children.append(node)
            if tag in RAW:
                over = re.compile(rf"</{tag}\b[^>]*>?", re.IGNORECASE).search(source, at)
                at = over.end() if over else len(source)
            elif tag not in VOID and not m[3].endswith("/"):
                stack.append(node)
                opened[tag] += 1
    text(source[at:].partition("<!--")[0])
    return root


def named(node: Node, last: set[str] = MARKS, first: set[str] = LEADING) -> bool:
    """Whether a class name or the id of an element says that it holds no content: what such names end and begin with."""
    for name in f"{node.attributes.get('class', '')} {node.attributes.get('id', '')}".split():
        parts = [p.lower() for p in NAME_PART.findall(name)]
        if parts and (parts[-1] in last or parts[0] in first):
            return True
    return False


def unseen(node: Node) -> bool:
    """Whether an element is never shown as text, wherever it stands."""
    a = node.attributes
    return node.tag in HIDDEN or (bool(a) and ("hidden" in a or a.get("aria-hidden") == "true" or ("style" in a and re.search(r"display\s*:\s*none", a["style"]) is not None)))


def is_never(node: Node, in_article: bool) -> bool:
    a = node.attributes
    if node.tag in NEVER or (node.tag == "header" and not in_article):
        return True
    return bool(a) and (unseen(node) or a.get("role", "").lower() in ROLES or (named(node, READERS, READERS) and node.tag not in TOP if node.tag in PROSE else named(node)))


# --- skeletons and simple tree matching -------------------------------------------------------------------------------------------

ROW = struct.Struct("<IIQIIB")


def kind_of(node: Node) -> int:
    if node.tag in ("article", "main"):
        return ARTICLE
    return HEADING | RUNNING if node.tag in ("h1", "h2", "h3", "h4", "h5", "h6") else RUNNING if node.tag in PROSE - {"html", "body"} else 0


def skeleton(root: Node) -> bytes:
    """For every visible element in document order: the row of its parent here, hash of tag, classes and id, hash of its own text (0 if it has
    none), characters of that text outside and inside links, and its kind. The element's number is told by ``numbers``."""
    out, todo, rows = [], [(root, 0, False)], 0
    while todo:
        node, parent, link = todo.pop()
        if node.number:
            rows += 1
            said = " ".join(" ".join(c for c in node.children if isinstance(c, str)).split())
            a = node.attributes
            label = xxhash.xxh3_64_intdigest(f"{node.tag} {a.get('class', '')} {a.get('id', '')}" if a else node.tag) >> 32
            link = link or node.tag == "a"
            out.append(ROW.pack(parent, label, xxhash.xxh3_64_intdigest(said) | 1 if said else 0, 0 if link else len(said), len(said) if link else 0, kind_of(node)))
            parent = rows
        todo += [(c, parent, link) for c in reversed(node.children) if isinstance(c, Node) and not unseen(c)]
    return b"".join(out)


def numbers(root: Node) -> list[int]:
    """The numbers of the elements in a skeleton, by row; row 0 is the root."""
    out, todo = [0], [root]
    while todo:
        node = todo.pop()
        if node.number:
            out.append(node.number)
        todo += [c for c in reversed(node.children) if isinstance(c, Node) and not unseen(c)]
    return out


_FACTORS = np.random.default_rng(1).integers(0, 2**63, SKETCH, np.uint64) * np.uint64(2) + np.uint64(1)


def layout_sketch(raw: bytes) -> bytes:
    """Minima of hashes of a skeleton's distinct label paths: two sketches agree in about the share of paths that two pages have in common."""
    paths, found = [0], set()
    for parent, label, *_ in ROW.iter_unpack(raw):
        paths.append(path := hash((paths[parent], label)))
        found.add(path)
    mixed = np.array(list(found or {1}), np.int64).view(np.uint64)[:, None] * _FACTORS[None, :]
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(32)).min(0).astype("<u4").tobytes()


def _minima(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u4").reshape(-1, SKETCH)


def unlike(sketches: list[bytes]) -> bytes:
    """Those sketches, one after the other, that are like none before them."""
    kept = b""
    for x in sketches:
        if not kept or (_minima(kept) == _minima(x)).mean(1).max() < ALIKE:
            kept += x
    return kept


def most_like(sketch: bytes, layouts: bytes) -> tuple[int, int]:
    """The number of the layout that a page is most like, -1 if it is like none, and in how many minima they agree."""
    agree = (_minima(layouts) == _minima(sketch)).sum(1)
    return int(agree.argmax()) if agree.max() >= ALIKE * SKETCH else -1, int(agree.max())


class Tree:
    """A skeleton as lists; index 0 is the root."""

    def __init__(self, raw: bytes):
        rows = list(ROW.iter_unpack(raw))
        self.parent, self.label, self.text, self.plain, self.linked, self.kind = (list(c) for c in zip((0, 0, 0, 0, 0, 0), *rows, strict=True))
        self.children: list[list[int]] = [[] for _ in self.label]
        for k in range(1, len(self.label)):
            self.children[self.parent[k]].append(k)


def _aligned(weight: Callable[[int, int], int], xs: list[int], ys: list[int]) -> tuple[int, list[tuple[int, int]]]:
    """The best ordered pairing of two short lists: its weight and pairs."""
    rows = [[0] * (len(ys) + 1)]
    for x in xs:
        above, row, best = rows[-1], [0], 0
        for j, y in enumerate(ys):
            if (w := weight(x, y)) and above[j] + w > best:
                best = above[j] + w
            if above[j + 1] > best:
                best = above[j + 1]
            row.append(best)
        rows.append(row)
    pairs, i, j = [], len(xs), len(ys)
    while i and j:
        if rows[i][j] == rows[i][j - 1]:
            j -= 1
        elif rows[i][j] == rows[i - 1][j]:
            i -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((xs[i], ys[j]))
    return rows[-1][-1], pairs


#: Lists of up to so many pairs are aligned by one small table; larger ones in a band, by rows, with tables of up to CELLS to walk back on.
SHORT, CELLS, FIRST_BAND = 2500, 1 << 18, 8


class Band:
    """Ordered pairing of two long lists, where places i and j may be paired only if j - i lies between lo and hi. weights(i, a, b): what place i weighs with places a to b."""

    def __init__(self, weights: Callable[[int, int, int], np.ndarray], lo: int, hi: int):
        self.weights, self.lo, self.hi = weights, lo, hi

    def rows(self, i0: int, i1: int, j0: int, j1: int, keep: bool = False, back: bool = False) -> list[np.ndarray]:
        """Best weights of places i0 to i1 with the first 0, 1, .. places from j0 on (back: from the other end); the last row, or all of them."""
        row, out = np.zeros(j1 - j0 + 1, np.int64), []
        for i in range(i1 - 1, i0 - 1, -1) if back else range(i0, i1):
            if keep:
                out.append(row.copy())
            a, b = max(j0, i + self.lo), min(j1, i + self.hi + 1)
            if a < b:
                w = self.weights(i, a, b)
                a, b, w = (j1 - b, j1 - a, w[::-1]) if back else (a - j0, b - j0, w)
                best = np.maximum.accumulate(np.maximum(row[a + 1 : b + 1], np.where(w > 0, row[a:b] + w, 0)))
                row[a + 1 : b + 1] = best
                if b + 1 < len(row) and row[b + 1] < best[-1]:
                    np.maximum(row[b + 1 :], best[-1], out=row[b + 1 :])
        return [*out, row]

    def pairs(self, i0: int, i1: int, j0: int, j1: int) -> list[tuple[int, int]]:
        """The places that are paired: by halves, so that memory follows the lists and not their product."""
        found, todo = [], [(i0, i1, j0, j1)]
        while todo:
            i0, i1, j0, j1 = todo.pop()
            j0, j1 = max(j0, min(i0 + self.lo, j1)), min(j1, max(i1 + self.hi, j0))
            if i0 == i1 or j0 == j1:
                continue
            if (i1 - i0) * (j1 - j0 + 1) > CELLS and i1 - i0 > 1:
                mid = (i0 + i1) // 2
                both = self.rows(i0, mid, j0, j1)[0] + self.rows(mid, i1, j0, j1, back=True)[0][::-1]
                at = j0 + int(both.argmax())
                todo += [(i0, mid, j0, at), (mid, i1, at, j1)]
                continue
            table, i, j = self.rows(i0, i1, j0, j1, keep=True), i1 - i0, j1 - j0
            while i and j:
                if table[i][j] == table[i][j - 1]:
                    j -= 1
                elif table[i][j] == table[i - 1][j]:
                    i -= 1
                else:
                    i, j = i - 1, j - 1
                    found.append((i0 + i, j0 + j))
        return found


def _most(tree: Tree, other: Tree) -> list[int]:
    """What each node's subtree can weigh at the most in any matching with the other tree."""
    labels, texts = set(other.label), set(other.text) - {0}
    most = [2 * (k in labels) + (k in labels and t in texts) for k, t in zip(tree.label, tree.text, strict=True)]
    for k in range(len(most) - 1, 0, -1):
        most[tree.parent[k]] += most[k]
    return most


def match(a: Tree, b: Tree) -> list[tuple[int, int]]:
    """Simple tree matching: the pairs (node of a, node of b) of a largest ordered, parent-respecting matching by label. A pair counts 2, and 1
    more if both have the same text.

    Long lists of children are matched in a band around the diagonal. A matching that leaves a band of width d leaves at least d + 1 children of either side out, which bounds its
    weight; where this isn't below what the band gives, the band is made wider, up to all pairs. So lists that mostly go together take time in proportion to
    themselves, and the result is a largest matching in any case."""
    inner: dict[tuple[int, int], int] = {}
    pairs_of: dict[tuple[int, int], list[tuple[int, int]]] = {}
    la, lb, ta, tb, ca, cb = a.label, b.label, a.text, b.text, a.children, b.children
    most_a, most_b = _most(a, b), _most(b, a)

    def weight(x: int, y: int) -> int:
        return 0 if la[x] != lb[y] else 2 + (ta[x] == tb[y] != 0) + inner.get((x, y), 0)

    def banded(xs: list[int], ys: list[int], width: int) -> tuple[int, list[tuple[int, int]]]:
        labels, texts = np.array([lb[y] for y in ys], np.int64), np.array([tb[y] for y in ys], np.uint64)

        def weights(i: int, p: int, q: int) -> np.ndarray:
            x = xs[i]
            same = labels[p:q] == la[x]
            w = np.where(same, 2 + ((texts[p:q] == np.uint64(ta[x])) if ta[x] else 0), 0)
            if ca[x]:
                for k in np.flatnonzero(same):
                    w[k] += inner.get((x, ys[p + k]), 0)
            return w

        band = Band(weights, min(0, len(ys) - len(xs)) - width, max(0, len(ys) - len(xs)) + width)
        pairs = [(xs[i], ys[j]) for i, j in band.pairs(0, len(xs), 0, len(ys))]
        return sum(weight(x, y) for x, y in pairs), pairs

    # An explicit stack: pages may nest deeper than Python calls. A pair is weighed once its children are.
    waiting: list[tuple[int, int, int, bool]] = [(0, 0, FIRST_BAND, False)]
    while waiting:
        x, y, width, ready = waiting.pop()
        xs, ys = ca[x], cb[y]
        long = len(xs) * len(ys) > SHORT
        if not ready:
            if (x, y) in inner:
                continue
            if long:
                lo, hi = min(0, len(ys) - len(xs)) - width, max(0, len(ys) - len(xs)) + width
                below = [(i, j, FIRST_BAND, False) for k, i in enumerate(xs) if ca[i] for j in ys[max(0, k + lo) : max(0, k + hi + 1)] if cb[j] and la[i] == lb[j] and (i, j) not in inner]
            else:
                below = [(i, j, FIRST_BAND, False) for i in xs if ca[i] for j in ys if cb[j] and la[i] == lb[j]]
            if below:
                waiting.append((x, y, width, True))
                waiting += below
                continue
        if not long:
            inner[x, y], pairs_of[x, y] = _aligned(weight, xs, ys)
            continue
        found, pairs = banded(xs, ys, width)
        out = min(sum(most) - sum(sorted(most)[: width + 1]) for most in ([most_a[i] for i in xs], [most_b[j] for j in ys]))
        if found >= out or width >= max(len(xs), len(ys)):
            inner[x, y], pairs_of[x, y] = found, pairs
        else:
            waiting.append((x, y, 4 * width, False))
    found, todo = [], [(0, 0)]
    while todo:
        pairs = pairs_of.get(todo.pop(), [])  # leaves have no entry
        found += pairs
        todo += pairs
    return found


def alignment(pivot: bytes, page: bytes) -> list[tuple[int, int, bool, int, int]]:
    """(pivot's node, page's node, whether their own texts are equal, characters outside and inside links) of the matched nodes. The text of nodes
    that have no match counts for their nearest ancestor that has one."""
    a, b = Tree(pivot), Tree(page)
    to = dict((y, x) for x, y in match(a, b)) | {0: 0}
    plain, linked = [0] * len(b.label), [0] * len(b.label)
    for y in range(len(b.label) - 1, -1, -1):
        plain[y] += b.plain[y]
        linked[y] += b.linked[y]
        if y not in to:  # children have larger numbers than parents
            plain[b.parent[y]] += plain[y]
            linked[b.parent[y]] += linked[y]
    return [(x, y, a.text[x] == b.text[y] != 0, plain[y], linked[y]) for y, x in to.items()]


def decide(pivot: bytes, votes: list[tuple[int, int, int, int]], pages: int) -> tuple[int, list[int], list[int]]:
    """The wrapper of a group from (pivot's node, pages with equal text, characters outside and inside links): the content's node, constant nodes
    and menus."""
    tree = Tree(pivot)
    size = len(tree.label)
    equal, plain, linked = [0] * size, [0] * size, [0] * size
    for x, e, p, n in votes:
        equal[x], plain[x], linked[x] = e, p, n
    constant = [e >= TEMPLATE_SHARE * pages and tree.text[x] != 0 for x, e in enumerate(equal)]
    whole = sum(plain)
    if sum(p for p, c in zip(plain, constant, strict=True) if c) > MOST_CONSTANT * whole:
        constant = [False] * size
    varying = [0 if c else p for p, c in zip(plain, constant, strict=True)]
    links = list(linked)
    every = [p + n for p, n in zip(plain, linked, strict=True)]
    for x in range(size - 1, 0, -1):
        for sums in (varying, links, every):
            sums[tree.parent[x]] += sums[x]
    at = 0
    while not tree.kind[at] & ARTICLE and not any(tree.kind[c] & HEADING and varying[c] for c in tree.children[at]):
        below = [c for c in tree.children[at] if varying[c] >= CONTENT_SHARE * varying[0] > 0 and not tree.kind[c] & RUNNING]
        if not below:
            break
        at = below[0]
    menus = [x for x in range(1, size) if not tree.kind[x] & (RUNNING | ARTICLE) and 2 * links[x] > every[x] and x != at]
    return at, [x for x, c in enumerate(constant) if c], menus


# --- reading the content ----------------------------------------------------------------------------------------------------------


def _blocks(node: Node, inside: bool, constant: frozenset[int] = frozenset(), menus: frozenset[int] = frozenset()) -> list[tuple[str, int, int]]:
    """(text, characters inside links, number of the node it began in) of every block under node, in page order."""
    done: list[tuple[str, int, int]] = []
    parts: list[str] = []
    linked = [0]

    def end(number: int) -> None:
        if words := "".join(parts).split():
            done.append((" ".join(words), linked[0], number))
        parts.clear()
        linked[0] = 0

    # An explicit stack: pages may nest deeper than Python calls. Entries: what, item, inside an article, inside a link, block's number.
    todo: list[tuple] = [("open", node, inside, False, node.number)]
    while todo:
        what, item, inside, link, block = todo.pop()
        if what == "text":
            parts.append(item)
            if link:
                linked[0] += len(item.strip())
        elif what == "end":
            end(block)
        else:
            if item is not node and (is_never(item, inside) or item.number in menus):
                if item.tag in BLOCK:
                    end(block)
                continue
            if item.tag in ("br", "hr"):
                parts.append(" ")
            if item.tag in BLOCK:
                end(block)
                block = item.number
                todo.append(("end", None, inside, link, block))
            inside, link = inside or item.tag in ("article", "main"), link or item.tag == "a"
            for c in reversed(item.children):
                if isinstance(c, Node):
                    todo.append(("open", c, inside, link, block))
                elif item.number not in constant:
                    todo.append(("text", c, inside, link, block))
    end(node.number)
    return done


def _all(root: Node):
    """All nodes that may hold content, parents first, each with the number of its parent."""
    todo = [(root, 0, False)]
    while todo:
        node, parent, inside = todo.pop()
        yield node, parent
        inside = inside or node.tag in ("article", "main")
        todo += [(c, node.number, inside) for c in reversed(node.children) if isinstance(c, Node) and not is_never(c, inside)]


def _marked(root: Node) -> list[Node]:
    """Where the content is without a wrapper: all outermost articles, or parts named as one, or main; else the deepest part that holds nearly
    all of the long text."""
    nodes = list(_all(root))
    ranks: dict[int, list[Node]] = {}
    rank_of: dict[int, set[int]] = {0: set()}  # the ranks of a node and its ancestors
    for node, parent in nodes:
        a = node.attributes
        said = f"{a.get('class', '')} {a.get('id', '')} {a.get('itemprop', '')}".lower().split() if a else ()
        rank = 0 if node.tag == "article" else 1 if not ARTICLE_MARKS.isdisjoint(said) else 2 if node.tag == "main" or a.get("role") == "main" else None
        above = rank_of.get(parent, set())
        if rank is not None and rank not in above:
            ranks.setdefault(rank, []).append(node)
        rank_of[node.number] = above if rank is None or rank in above else above | {rank}
    for rank in sorted(ranks):
        if any(_blocks(n, True) for n in ranks[rank]):
            return ranks[rank]
    long_text, parent_of, by_number = Counter(), {}, {}
    for node, parent in nodes:
        parent_of[node.number], by_number[node.number] = parent, node
    for text, linked, number in _blocks(root, False):
        if len(text) >= 80 and linked < 0.5 * len(text):
            long_text[number] += len(text)
    for number in sorted(parent_of, reverse=True):
        if number:
            long_text[parent_of[number]] += long_text[number]
    node, total = root, long_text[0]
    while total:
        below = [c for c in node.children if isinstance(c, Node) and c.number in parent_of and c.tag in BLOCK and long_text[c.number] >= 0.8 * total]
        if not below or below[0].tag == "p":
            break
        node = below[0]
    return [node]


def extract(source: str | None, wrapper: tuple[int, list[int], list[int]] | None = None) -> str:
    """The main text of one page. wrapper: rows of its skeleton: the content's node, constant nodes and menus."""
    if not source:
        return ""
    root = parse(source)
    if wrapper:
        number = numbers(root)
        content, constant, menus = number[wrapper[0]], frozenset(number[k] for k in wrapper[1]), frozenset(number[k] for k in wrapper[2])
        todo = [root]
        while todo and (node := todo.pop()).number != content:
            todo += [c for c in node.children if isinstance(c, Node) and c.number <= content]
        return "\n\n".join(t for t, *_ in _blocks(node, node.number != 0, constant, menus))
    found = _marked(root)
    marked = found[0].tag in ("article", "main") or found[0] is not root and len(found) > 1
    blocks = [b for node in found for b in _blocks(node, True)]
    if not marked:  # without an article to go by, blocks that are mostly links are lists of links
        blocks = [b for b in blocks if b[1] <= 0.5 * len(b[0])]
    return "\n\n".join(t for t, *_ in blocks)


# --- on Spark ---------------------------------------------------------------------------------------------------------------------


def host_of(url: Column) -> Column:
    """The host in lower case, null where the url has none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def spread_join(rows: DataFrame, few: DataFrame, keys: list[str], by: Column, how: str = "inner") -> DataFrame:
    """rows joined with few (one row a key; a written table). A key may hold a third of all rows: few is broadcast if its bytes are counted to be
    small, else it goes out SALTS times, to as many parts of each key; by deals the rows to these."""
    size = few.agg(F.sum(sum((F.coalesce(F.length(c.name) if c.dataType.typeName() in ("string", "binary") else F.lit(64), F.lit(8)) for c in few.schema), F.lit(0))).alias("n")).first()["n"] or 0
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(few), keys, how)
    copies = few.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_part", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(copies, [*keys, "_part"], how).drop("_part")


def dealt(df: DataFrame, by: str) -> DataFrame:
    """df dealt anew by a digest: Python's work follows rows, not the few bytes that they have here."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), by)


def likest(pages: DataFrame, layouts: DataFrame) -> DataFrame:
    """(host, digest, layout, agree): what a page of pages (host, digest, sketch) is most like of layouts (host, layout, sketch; a written table), for
    each block of these, where it is like one. A group has up to some PART_PAGES pages and MOST_CANDIDATES layouts, whatever a host has."""

    def compared(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("layout")
        among, number = b"".join(right["sketch"].to_pylist()), right["layout"].to_pylist()
        found = [most_like(s, among) for s in left["sketch"].to_pylist()]
        columns = [left["host"], left["digest"], pa.array([number[k] if k >= 0 else -1 for k, _ in found], pa.int32()), pa.array([n for _, n in found], pa.int32())]
        return pa.table(columns, names=["host", "digest", "layout", "agree"])

    block = F.floor(F.col("layout") / MOST_CANDIDATES).cast("int")
    dealing = pages.groupBy("host").agg(F.ceil(F.count("*") / PART_PAGES).cast("int").alias("parts"))
    dealing = materialize(dealing.join(layouts.groupBy("host").agg(F.collect_set(block).alias("blocks")), "host"), "dealing", True)
    left = spread_join(pages, dealing, ["host"], F.col("digest")).withColumn("_part", F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int"))
    left = left.select("host", "digest", "sketch", "_part", F.explode("blocks").alias("_block"))
    right = layouts.join(dealing, "host").select("host", "layout", "sketch", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("_part"), block.alias("_block"))
    keys = ["host", "_part", "_block"]
    return left.groupBy(keys).cogroup(right.groupBy(keys)).applyInArrow(compared, "host string, digest string, layout int, agree int").filter("layout >= 0")


def further_layouts(unlike_any: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """For pages (host, digest, sketch; a written table) that are like none of their host's first layouts: (host, digest, layout, agree) and the
    further layouts (host, layout, sketch), numbered from CANDIDATES on. A turn chooses some of the pages left and takes those like them out,
    themselves at least, until no host has LEAST_PAGES pages left. None if no host had."""
    spark = unlike_any.sparkSession

    def chosen(first: int) -> Callable[[pa.Table], pa.Table]:
        def of_host(rows: pa.Table) -> pa.Table:
            found = _minima(unlike(rows.sort_by("digest")["sketch"].to_pylist()))
            columns = [pa.array([rows["host"][0].as_py()] * len(found)), pa.array(range(first, first + len(found)), pa.int32()), pa.array([x.tobytes() for x in found], pa.binary())]
            return pa.table(columns, names=["host", "layout", "sketch"])

        return of_host

    tables = {name: (scratch(spark, name), schema) for name, schema in (("assigned", "host string, digest string, layout int, agree int"), ("further", "host string, layout int, sketch binary"))}
    read = lambda name: spark.read.schema(tables[name][1]).parquet(tables[name][0])
    put = lambda df, name: df.coalesce(4 * spark.sparkContext.defaultParallelism).write.mode("append").parquet(tables[name][0])
    left, most, first = unlike_any, CANDIDATES, CANDIDATES
    while True:
        hosts = materialize(left.groupBy("host").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_PAGES).select("host"), "open_hosts", True)
        if hosts.isEmpty():
            return None if first == CANDIDATES else (read("assigned"), read("further"))
        pages = spread_join(left, hosts, ["host"], F.col("digest"))
        most = min(8 * most, MOST_CANDIDATES)
        parts = pages.groupBy("host", F.pmod(F.xxhash64("digest"), F.lit(most)).alias("part")).agg(F.min("digest").alias("digest"), F.min_by("sketch", "digest").alias("sketch"))
        put(parts.select("host", "digest", "sketch").groupBy("host").applyInArrow(chosen(first), tables["further"][1]), "further")
        like = likest(pages, read("further").filter(F.col("layout") >= first)).groupBy("host", "digest")
        best = F.max_by(F.struct("layout", "agree"), F.struct("agree", -F.col("layout")))
        put(like.agg(best.alias("best")).select("host", "digest", "best.*"), "assigned")
        left, first = unlike_any.join(read("assigned"), ["host", "digest"], "left_anti"), first + most


def with_further(distinct: DataFrame, paged: DataFrame, assigned: DataFrame, further: DataFrame) -> DataFrame:
    """(host, digest, skeleton, layout): every page with the layout that it is most like, of the first ones and of the further ones that have
    LEAST_PAGES pages; at a tie the earlier. Only hosts that have such further ones are compared again."""
    own = assigned.groupBy("host", "layout").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_PAGES).select("host", "layout")
    known = paged.filter("layout >= 0").select("host", "digest", "layout", "agree").unionByName(assigned.join(own, ["host", "layout"], "left_semi"))
    layouts = materialize(further.join(own, ["host", "layout"]), "own_layouts", True)
    hosts = materialize(layouts.select("host").distinct(), "own_hosts", True)
    again = likest(spread_join(distinct.select("host", "digest", "sketch"), hosts, ["host"], F.col("digest")), layouts)
    best = known.unionByName(again).groupBy("host", "digest").agg(F.max_by("layout", F.struct("agree", -F.col("layout"))).alias("to"))
    return paged.join(best, ["host", "digest"], "left").select("host", "digest", "skeleton", F.coalesce("to", "layout").alias("layout"))


def layout_groups(distinct: DataFrame) -> DataFrame:
    """distinct (host, digest, skeleton, sketch) of hosts with LEAST_PAGES pages as (host, digest, skeleton, layout, votes)."""

    def chosen(rows: pa.RecordBatch) -> pa.RecordBatch:
        found = [unlike([c["sketch"] for c in sorted(x, key=lambda c: c["digest"])]) for x in rows.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([rows.column(0), pa.array(found, pa.binary())], names=["host", "layouts"])

    def assigned(rows: pa.RecordBatch) -> pa.RecordBatch:
        sketches = rows.column(3).to_pylist()
        found = [most_like(s, x) for s, x in zip(sketches, rows.column(4).to_pylist(), strict=True)]
        columns = [pa.array([f[k] for f in found], pa.int32()) for k in (0, 1)] + [pa.array([s if k < 0 else None for s, (k, _) in zip(sketches, found, strict=True)], pa.binary())]
        return pa.RecordBatch.from_arrays([*rows.columns[:3], *columns], names=["host", "digest", "skeleton", "layout", "agree", "sketch"])

    part = F.pmod(F.xxhash64("digest"), F.lit(CANDIDATES))
    parts = distinct.groupBy("host", part.alias("part")).agg(F.min("digest").alias("digest"), F.min_by("sketch", "digest").alias("sketch"), F.count("*").alias("n"))
    hosts = parts.groupBy("host").agg(F.collect_list(F.struct("digest", "sketch")).alias("candidates"), F.sum("n").alias("n")).filter(F.col("n") >= LEAST_PAGES)
    layouts = materialize(map_arrow(hosts.select("host", "candidates"), chosen, "host string, layouts binary"), "host_layouts", True)
    paged = spread_join(distinct, layouts, ["host"], F.col("digest")).select("host", "digest", "skeleton", "sketch", "layouts")
    paged = materialize(map_arrow(paged, assigned, "host string, digest string, skeleton binary, layout int, agree int, sketch binary"), "layouts")
    if further := further_layouts(paged.filter("layout < 0").select("host", "digest", "sketch")):
        paged = materialize(with_further(distinct, paged, *further), "all_layouts")
    # A row a layout: small groups become the host's rest, and a small rest goes with the largest group.
    sizes = paged.groupBy("host", "layout").agg(F.count("*").alias("n"))
    own = (F.col("layout") >= 0) & (F.col("n") >= LEAST_PAGES)
    whole = sizes.groupBy("host").agg(F.sum(F.when(~own, F.col("n"))).alias("rest"), F.max(F.when(own, F.struct("n", "layout"))).alias("largest"))
    joins = F.col("largest").isNotNull() & (F.col("rest") < LEAST_PAGES)
    to = F.when(own, F.col("layout")).when(joins, F.col("largest.layout")).otherwise(-1)
    moved = materialize(sizes.join(whole, "host").select("host", "layout", to.alias("to"), (own | ~joins).alias("votes")), "moved", True)
    return spread_join(paged, moved, ["host", "layout"], F.col("digest")).select("host", "digest", "skeleton", F.col("to").alias("layout"), "votes")


def wrappers(pages: DataFrame, source: str = "html", host: str = "_host", digest: str = "_digest") -> DataFrame:
    """(host, digest, content, constant, menus): for each distinct page of a host with a wrapper, its nodes as rows of its skeleton."""

    def skeletons(rows: pa.RecordBatch) -> pa.RecordBatch:
        found = [skeleton(parse(t)) for t in rows.column(2).to_pylist()]
        columns = [pa.array(found, pa.binary()), pa.array(map(layout_sketch, found), pa.binary())]
        return pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *columns], names=["host", "digest", "skeleton", "sketch"])

    names = ("pivot", "node", "equal", "plain", "linked")
    kinds = (pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.int32())

    def align(rows: pa.RecordBatch) -> pa.RecordBatch:
        found = [alignment(p, s) for p, s in zip(rows.column(4).to_pylist(), rows.column(5).to_pylist(), strict=True)]
        flat = [x for f in found for x in f]
        ends = np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(np.int32)
        structs = pa.StructArray.from_arrays([pa.array([x[k] for x in flat], kind) for k, kind in enumerate(kinds)], list(names))
        return pa.RecordBatch.from_arrays([*rows.columns[:4], pa.ListArray.from_arrays(pa.array(ends), structs)], names=["host", "layout", "digest", "votes", "pairs"])

    def decided(rows: pa.RecordBatch) -> pa.RecordBatch:
        columns = zip(*(rows.column(k).to_pylist() for k in (2, 3, 4)), strict=True)
        found = [decide(p, [(v["pivot"], v["equal"], v["plain"], v["linked"]) for v in votes], n) for p, n, votes in columns]
        lists = [pa.array([f[k] for f in found], pa.list_(pa.int32())) for k in (1, 2)]
        return pa.RecordBatch.from_arrays([*rows.columns[:2], pa.array([f[0] for f in found], pa.int32()), *lists], names=["host", "layout", "content", "constant", "menus"])

    read = pages.filter(F.col(host).isNotNull() & (F.length(source) > 0)).select(F.col(host).alias("host"), F.col(digest).alias("digest"), source)
    found = map_arrow(read, skeletons, "host string, digest string, skeleton binary, sketch binary")
    distinct = materialize(found.groupBy("host", "digest").agg(F.first("skeleton").alias("skeleton"), F.first("sketch").alias("sketch")), "skeletons")
    grouped = materialize(layout_groups(distinct), "grouped")
    group = ["host", "layout"]
    pivots = materialize(grouped.filter("votes").groupBy(group).agg(F.min_by("skeleton", "digest").alias("pivot"), F.count("*").alias("n")), "pivots", True)
    paired = spread_join(grouped, pivots, group, F.col("digest")).select(*group, "digest", "votes", "pivot", "skeleton")
    pairs = "array<struct<pivot:int,node:int,equal:boolean,plain:int,linked:int>>"
    aligned = materialize(map_arrow(dealt(paired, "digest"), align, f"host string, layout int, digest string, votes boolean, pairs {pairs}"), "aligned")
    votes = aligned.filter("votes").select(*group, F.explode("pairs").alias("p")).groupBy(*group, "p.pivot")
    votes = votes.agg(F.count_if("p.equal").alias("equal"), F.sum("p.plain").alias("plain"), F.sum("p.linked").alias("linked"))
    # One row a group, as long as its pivot page.
    told = votes.groupBy(group).agg(F.collect_list(F.struct("pivot", "equal", "plain", "linked")).alias("told"))
    told = pivots.join(told, group).select(*group, "pivot", "n", "told")
    wrapper = materialize(map_arrow(told, decided, "host string, layout int, content int, constant array<int>, menus array<int>"), "wrappers", True)
    of = spread_join(aligned, wrapper, group, F.col("digest"))
    node_of = F.map_from_arrays(F.transform("pairs", lambda p: p["pivot"]), F.transform("pairs", lambda p: p["node"]))
    nodes = lambda c: F.array_compact(F.transform(c, lambda x: F.try_element_at("_node", x)))
    of = of.withColumn("_node", node_of).select("host", "digest", F.try_element_at("_node", F.col("content")).alias("content"), nodes("constant").alias("constant"), nodes("menus").alias("menus"))
    return of.filter(F.col("content").isNotNull())


def extract_pages(df: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """One row per row of df: key, url, text."""
    pages = df.select(F.col(key).alias("_key"), F.col(url).alias("_url"), F.col(source).alias("_html"))
    pages = pages.select("*", host_of(F.col("_url")).alias("host"), F.md5(F.coalesce("_html", F.lit(""))).alias("digest"))
    found = materialize(wrappers(pages, "_html", "host", "digest"), "templates")
    marked = spread_join(pages, found, ["host", "digest"], F.col("_key"), "left").select("_key", "_url", "_html", "content", "constant", "menus")

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        columns = zip(*(rows.column(k).to_pylist() for k in range(2, 6)), strict=True)
        texts = [extract(t, None if at is None else (at, constant, menus)) for t, at, constant, menus in columns]
        return pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(texts, pa.string())], names=[key, url, "text"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (key, url))
    return map_arrow(marked, batch, f"{kinds}, text string")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))
