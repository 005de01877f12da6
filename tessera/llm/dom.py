"""A small HTML reader and simple tree matching, for wrapper induction."""

from __future__ import annotations

import hashlib
import html
import re
from collections import defaultdict

import numpy as np

#: elements without content
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: elements whose content is not markup
RAW = ("script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "xmp")
#: elements that begin and end a block
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre "
    "section select summary table tbody td tfoot th thead tr ul".split()
)
#: an open element that a start tag closes, up to the nearest of the stops
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}), "option": ({"option"}, {"select"})}
PARAGRAPH_STOPS = frozenset("button table td th body html article section main div li".split())
#: first words of class names that speak of something else
NEGLIGIBLE = frozenset("has is no with without".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(RAW) + r")\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>(?P<inside>.*?)(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

BREAK = -1


class Tree:
    """Nodes in page order.  tag is '' for text; marks holds the lower-cased words of
    class, id and role; items lists text nodes and BREAKs in page order."""

    def __init__(self):
        self.tag, self.label, self.parent, self.children, self.text, self.marks, self.items = ["#root"], ["#root"], [-1], [[]], [""], [frozenset()], []

    def add(self, parent: int, tag: str, label: str, text: str = "", marks: frozenset = frozenset()) -> int:
        node = len(self.tag)
        self.tag.append(tag)
        self.label.append(label)
        self.parent.append(parent)
        self.children.append([])
        self.text.append(text)
        self.marks.append(marks)
        self.children[parent].append(node)
        return node

    def digests(self) -> list[int]:
        """A digest of each node's own text, 0 without one."""
        return [digest(t) if t and not t.isspace() else 0 for t in self.text]


def parse(page: str) -> Tree:
    """Read a page; unclosed and misnested elements are closed as far as the text needs it.

    Elements may be nested to any depth: the depths of the open ones are known by tag,
    so that an end tag finds its element without a walk over all that are open."""
    tree, stack, at = Tree(), [0], 0
    opened: dict[str, list[int]] = defaultdict(list)

    def innermost(tags) -> int:
        return max([opened[t][-1] for t in tags if opened.get(t)], default=0)

    def cut(depth: int) -> None:
        for node in stack[depth:]:
            opened[tree.tag[node]].pop()
        del stack[depth:]

    def close(what: set, stops) -> None:
        depth = innermost(what)
        if depth and depth > innermost(stops):
            cut(depth)

    def words(raw: str) -> None:
        if raw.strip():
            tree.items.append(tree.add(stack[-1], "", "#text", html.unescape(raw)))
        elif raw:
            tree.items.append(tree.add(stack[-1], "", "#space", " "))

    for token in _TOKEN.finditer(page):
        if token.start() > at:
            words(page[at : token.start()])
        at = token.end()
        tag = token["tag"]
        if tag is None:
            if token["raw"] and token["raw"].lower() == "title":
                tree.add(stack[-1], "title", "title")
            continue
        tag = tag.lower()
        if tag in BLOCK or tag == "br":
            tree.items.append(BREAK)
        if token["close"]:
            if opened.get(tag):
                cut(opened[tag][-1])
            continue
        if tag in BLOCK:
            close({"p"}, PARAGRAPH_STOPS)
        if tag in CLOSES:
            close(*CLOSES[tag])
        marks, label = _marks(tag, token["attributes"])
        node = tree.add(stack[-1], tag, label, marks=marks)
        if tag not in VOID and not token["attributes"].rstrip().endswith("/"):
            opened[tag].append(len(stack))
            stack.append(node)
    if at < len(page):
        words(page[at:])
    return tree


def _marks(tag: str, attributes: str) -> tuple[frozenset, str]:
    if not attributes.strip():
        return frozenset(), tag
    found, label = set(), tag
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden":
            found.add("hidden")
        if name not in ("class", "id", "role"):
            continue
        for one in value.split() if tag not in ("html", "body") else ():
            parts = re.split(r"[_-]+", one)
            if parts[0] not in NEGLIGIBLE:  # has-sidebar says nothing about the element itself
                found.update(parts)
        if name == "class":
            label += "." + value
    return frozenset(found - {""}), label


class Skeleton:
    """What is kept of a host's pivot page: labels, parents and text digests, in page order."""

    def __init__(self, label: list[str], parent: list[int], digest: list[int]):
        self.label, self.parent, self.digest = label, parent, digest
        self.children: list[list[int]] = [[] for _ in label]
        for node, up in enumerate(parent):
            if up >= 0:
                self.children[up].append(node)

    @classmethod
    def of(cls, tree: Tree) -> Skeleton:
        return cls(tree.label, tree.parent, tree.digests())

    def shapes(self) -> Shapes:
        return Shapes(self.label, self.children, self.digest)


class Shapes:
    """For each node's subtree: a number for its labels, one for its labels and texts, and its size."""

    def __init__(self, label: list[str], children: list[list[int]], digest: list[int]):
        n = len(label)
        self.labels, self.whole, self.size = [0] * n, [0] * n, [1] * n
        for node in range(n - 1, -1, -1):
            own = children[node]
            if own:
                self.labels[node] = hash((label[node], *[self.labels[c] for c in own]))
                self.whole[node] = hash((label[node], *[self.whole[c] for c in own]))
                self.size[node] += sum([self.size[c] for c in own])
            else:
                self.labels[node], self.whole[node] = hash(label[node]), hash((label[node], digest[node]))


def digest(text: str) -> int:
    """Digest of a text with its white space collapsed: 63 bits, never 0."""
    return int.from_bytes(hashlib.blake2b(" ".join(text.split()).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big") >> 1 | 1


#: cells of the table of two child lists; longer lists are halved until their tables are as small
CELLS = 200_000
#: weights of subtrees and of lists that are held at a time
HELD = 2_000_000
#: bits of a weight that count nodes of equal texts; those above count matched nodes
EQUAL_BITS = 24


def align(page: Tree, digests: list[int], pivot: Skeleton, pivot_shapes: Shapes) -> list[int]:
    """Simple tree matching: for each node of the page its node of the pivot, or -1.

    Matched nodes have equal labels and matched parents and keep the order of
    siblings; the number of matched nodes is the largest possible, for lists of any
    length.  Among the largest matchings of two child lists one is taken that pairs most
    nodes of subtrees of equal texts, so that a fixed line between varying ones meets its
    like; equal subtrees at both ends are matched at once, which never loses a match.
    Memory grows with the length of the lists, not with its square: Hirschberg's halving.
    """
    own = Shapes(page.label, page.children, digests)
    shape_a, whole_a, size_a = own.labels, own.whole, own.size
    shape_b, whole_b = pivot_shapes.labels, pivot_shapes.whole
    out = [-1] * len(page.label)
    known: dict[tuple[int, int], int] = {}  # by shapes

    def alike(a: list[int], b: list[int], of_a: list[int], of_b: list[int]) -> tuple[int, int]:
        """How many subtrees are alike at the heads of two lists, and how many at the tails of the rest."""
        head, tail, most = 0, 0, min(len(a), len(b))
        while tail < most and of_a[a[-1 - tail]] == of_b[b[-1 - tail]]:
            tail += 1
        while head < most - tail and of_a[a[head]] == of_b[b[head]]:
            head += 1
        return head, tail

    def weights(a: list[int], b: list[int], equal: bool):
        """For each of ``a`` its weights with all of ``b``; with ``equal``, equal texts break ties."""
        kinds = {shape_b[y]: y for y in b}
        place = {shape: k for k, shape in enumerate(kinds)}
        code = np.array([place[shape_b[y]] for y in b])
        texts = np.array([whole_b[y] for y in b]) if equal else None
        rows: dict[int, np.ndarray] = {}
        for x in a:
            shape = shape_a[x]
            if shape not in rows:
                if len(rows) * len(b) > HELD:
                    rows.clear()
                rows[shape] = np.array([weight(x, y) for y in kinds.values()], np.int64)[code] << EQUAL_BITS
            yield rows[shape] + (texts == whole_a[x]) * size_a[x] if equal else rows[shape]

    def best(a: list[int], b: list[int], equal: bool):
        """The best sums of ``a``'s first 0, 1, ... lists with all heads of ``b``, row by row."""
        row = np.zeros(len(b) + 1, np.int64)
        yield row
        for own in weights(a, b, equal):
            row = np.concatenate(([0], np.maximum.accumulate(np.maximum(row[1:], row[:-1] + own))))
            yield row

    def last(a: list[int], b: list[int], equal: bool) -> np.ndarray:
        for row in best(a, b, equal):
            pass
        return row

    def matched(a: list[int], b: list[int]):
        """Pairs of a best matching of two lists."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            half = len(a) // 2
            if half and len(a) * len(b) > CELLS:
                ends = last(a[:half], b, True) + last(a[half:][::-1], b[::-1], True)[::-1]
                cut = int(ends.argmax())
                todo += [(a[:half], b[:cut]), (a[half:], b[cut:])]
                continue
            table = [row.tolist() for row in best(a, b, True)] if a and b else []
            i, j = len(a), len(b)
            while i and j:
                if table[i][j] == table[i - 1][j]:
                    i -= 1
                elif table[i][j] == table[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    yield a[i], b[j]

    def weight(x: int, y: int) -> int:
        if page.label[x] != pivot.label[y]:
            return 0
        if shape_a[x] == shape_b[y]:
            return size_a[x]
        key = shape_a[x], shape_b[y]
        if key not in known:
            if len(known) > HELD:
                known.clear()
            weigh(x, y)
        return known[key]

    def weigh(x: int, y: int) -> None:
        """Fill in what is known of two subtrees, the inner ones first: pages may be deeper than calls."""
        todo = [(x, y, False)]
        while todo:
            x, y, ready = todo.pop()
            key = shape_a[x], shape_b[y]
            if key in known:
                continue
            a, b = page.children[x], pivot.children[y]
            head, tail = alike(a, b, shape_a, shape_b)
            total = 1 + sum([size_a[c] for c in (*a[:head], *a[len(a) - tail :])])
            a, b = a[head : len(a) - tail], b[head : len(b) - tail]
            if ready or not a or not b:
                known[key] = total + (int(last(a, b, False)[-1]) >> EQUAL_BITS if a and b else 0)
            else:
                todo.append((x, y, True))
                kinds = {shape_b[d]: d for d in b}.values()
                for c in {shape_a[c]: c for c in a}.values():
                    todo += [(c, d, False) for d in kinds if page.label[c] == pivot.label[d] and shape_a[c] != shape_b[d] and (shape_a[c], shape_b[d]) not in known]

    def pair(x: int, y: int) -> None:
        todo = [(x, y)]
        while todo:
            x, y = todo.pop()
            out[x] = y
            a, b = page.children[x], pivot.children[y]
            if shape_a[x] == shape_b[y]:
                todo += zip(a, b, strict=True)
                continue
            head, tail = alike(a, b, whole_a, whole_b)
            todo += zip(a[:head], b[:head], strict=True)
            if tail:
                todo += zip(a[-tail:], b[-tail:], strict=True)
            todo += matched(a[head : len(a) - tail], b[head : len(b) - tail])

    pair(0, 0)
    return out
