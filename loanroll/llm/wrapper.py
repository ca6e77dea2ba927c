"""Main-text extraction by wrapper induction.

1. Each host has a reference page, its longest one; its DOM tree is the host's
   skeleton (equal neighbouring siblings are one node).
2. Each page's tree is aligned with the skeleton by simple tree matching (the
   largest set of matched nodes that keeps parents and sibling order). Spark
   counts, over all pages of a host, on how many different pages a text stands
   at a node of the skeleton. Texts of nearly all pages are constants of the
   template; the others fill slots.
3. The content node is the deepest element of the skeleton that holds nearly
   all text that fills slots; an article or main element ends the descent. A
   page's content is what is aligned with the content node. Nothing inside an
   article or main element is dropped as a constant; inside other elements
   constants are template.

Elements, roles and classes that say that they are menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles or reader comments are taken
out of trees and texts. They and the article, main or body element decide alone
where a host has fewer than ``min_support`` different pages, or where a page
has nothing aligned with the content node. Exact copies of a page count once.

Pages are not shuffled but where a host's wrapper can't be broadcast; what is
shuffled are counts, and a host with very many pages is many rows of them.
Results don't depend on how pages are dealt.

Defined results: a null, empty or tag-less html gives the text without markup
or the empty string; broken markup is read as browsers do in the simple cases
(unclosed elements end with their parent, a tag that never ends is text); a
null or host-less url is a host of its own; repeated pages are all returned; an
empty table gives no rows. Only id, url and html are read.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter, defaultdict
from collections.abc import Generator, Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, returns_memory, staged

#: Elements without content, elements whose content is not markup, and elements that end an open paragraph. Fixed values.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
            "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th "
            "thead tr ul caption".split())
#: An element that opens inside one of these closes it.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"},
          "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
#: Elements and role words that are never content.
NOT_CONTENT = set("head nav aside footer form button select option input label dialog menu svg canvas object audio video map "
                  "fieldset datalist".split()) | RAW
NOT_CONTENT_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar "
                        "status log".split())
ROLE_WORDS = set("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent "
                 "gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login paywall "
                 "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars side aside widget widgets related "
                 "recommended share sharing social footer foot header masthead topbar toolbar search comment comments reply replies "
                 "respond discussion disqus pagination pager skip toc hidden".split())

#: Words that say nothing by themselves in the class of such an element. Fixed values.
PLAIN_WORDS = set("box block section list item items bar area region zone panel wrap wrapper container inner outer left right top bottom "
                  "link links button buttons icon icons group row col column slot unit space text title heading label recent entries "
                  "posts post user main content body site page mobile desktop sticky fixed small large inline".split())
#: Elements that may hold the content, and those that end the search for it.
CONTAINERS = set("html body main article section div center table tbody tr td".split())
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_TAG_STOP = re.compile(r">|=\s*[\"']")
_ATTRIBUTE = re.compile(r"(?<![^\s=/\"'])([^\s=/\"']++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+))")
_SPACE = re.compile(r"\s+")
_ROLE_SPLIT = re.compile(r"[^a-z]+")


class Node:
    __slots__ = ("tag", "attrs", "children", "sign", "outside")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children, self.outside = tag, attrs or {}, [], None
        self.sign = tag + "." + self.attrs.get("class", "") + "#" + self.attrs.get("role", "") if attrs else tag


class _Open:
    """The open elements, with the places of each tag and of the blocks among them."""

    def __init__(self, root: Node):
        self.nodes, self.places, self.blocks = [root], defaultdict(list), []

    def push(self, node: Node) -> None:
        self.places[node.tag].append(len(self.nodes))
        if node.tag in BLOCK:
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, at: int) -> None:
        """Close the elements from a place on."""
        while len(self.nodes) > at:
            node = self.nodes.pop()
            self.places[node.tag].pop()
            if node.tag in BLOCK:
                self.blocks.pop()

    def end(self, tag: str) -> None:
        """An end tag closes the nearest element of its name; a stray inline one closes no block."""
        places = self.places[tag]
        if places and (tag in BLOCK or not self.blocks or places[-1] > self.blocks[-1]):
            self.cut(places[-1])


def _tag_end(source: str, at: int) -> int:
    """Where a tag ends, quoted values skipped; -1 if it never does."""
    while True:
        m = _TAG_STOP.search(source, at)
        if not m or m.group() == ">":
            return m.start() if m else -1
        close = source.find(m.group()[-1], m.end())
        if close < 0:
            return -1
        at = close + 1


def parse(source: str) -> Node:
    """The DOM tree; text children are strings. Every character is looked at a bounded number of times."""
    root = Node("#root")
    stack, at, lower, quotes = _Open(root), 0, None, True
    text_from = 0

    def text_until(end: int) -> None:
        if end > text_from:
            stack.nodes[-1].children.append(source[text_from:end])

    while (start := source.find("<", at)) >= 0:
        if source.startswith("<!--", start):
            text_until(start)
            end = source.find("-->", start + 4)
            at = text_from = end + 3 if end >= 0 else len(source)
            continue
        if source.startswith("<![CDATA[", start):
            text_until(start)
            end = source.find("]]>", start)
            text_from = start + 9
            text_until(end if end >= 0 else len(source))
            at = text_from = end + 3 if end >= 0 else len(source)
            continue
        closing = source.startswith("</", start)
        name = _NAME.match(source, start + 1 + closing)
        if not name and source[start + 1:start + 2] not in ("!", "?"):
            at = start + 1
            continue
        end = -1
        if name and quotes:
            end = _tag_end(source, name.end())
            quotes = end >= 0  # a quote that is never closed: from here on tags end at the next bracket
        if end < 0:
            end = source.find(">", start)
        if end < 0:
            break  # no tag ends any more
        text_until(start)
        at = text_from = end + 1
        if not name:
            continue
        tag = name.group().lower()
        if closing:
            stack.end(tag)
            continue
        _close_implied(stack, tag)
        rest = source[name.end():end]
        attrs = {k.lower(): entities.unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(rest)} if "=" in rest else {}
        if "hidden" in rest and re.search(r"(?:^|\s)hidden(?:\s|/|$)", rest):
            attrs["hidden"] = ""
        node = Node(tag, attrs)
        stack.nodes[-1].children.append(node)
        if tag in RAW:
            if lower is None:
                lower = source.lower() if len(source.lower()) == len(source) else source
            end = lower.find("</" + tag, at)
            node.children.append(source[at:end if end >= 0 else len(source)])
            close = source.find(">", end) if end >= 0 else -1
            at = text_from = close + 1 if close >= 0 else len(source)
        elif tag not in VOID and not rest.endswith("/") or tag in BLOCK - VOID:
            stack.push(node)
    text_until(len(source))
    return root


def _close_implied(stack: _Open, tag: str) -> None:
    """End the elements that the opening of ``tag`` ends: the nearest ones that are not beyond another block."""
    closes = CLOSES.get(tag, set()) | ({"p"} if tag in BLOCK else set())
    while closes:
        places = [stack.places[t][-1] for t in closes if stack.places[t]]
        if not places:
            return
        at = max(places)
        own = stack.nodes[at].tag
        blocks = stack.blocks
        k = len(blocks) - 1
        while k >= 0 and blocks[k] > at and stack.nodes[blocks[k]].tag == "p":
            k -= 1
        if k >= 0 and blocks[k] > at:
            return  # another block stands between
        stack.cut(at)
        if not (own in ("td", "th") and tag in ("tr", "tbody") or own == "tr" and tag == "tbody"):
            return


def _names_a_part(tokens: str) -> bool:
    """Whether a class or id is made of words for parts of a page that are no content: some of them, and none of another meaning."""
    words = [w for w in _ROLE_SPLIT.split(tokens.lower()) if w]
    return any(w in ROLE_WORDS for w in words) and all(w in ROLE_WORDS or w in PLAIN_WORDS for w in words)


def is_boilerplate(node: Node) -> bool:
    """Whether an element, its role, class or id says that it is no content."""
    if node.outside is None:
        node.outside = _is_boilerplate(node)
    return node.outside


def _is_boilerplate(node: Node) -> bool:
    if node.tag in NOT_CONTENT:
        return True
    a = node.attrs
    if not a:
        return False
    if a.get("role", "").lower() in NOT_CONTENT_ROLES or "hidden" in a or a.get("aria-hidden") == "true":
        return True
    if "display:none" in a.get("style", "").replace(" ", "").lower():
        return True
    if node.tag in ("html", "body", "article", "main"):
        return False
    return _names_a_part(a.get("class", "")) or _names_a_part(a.get("id", ""))


class Run:
    """Equal neighbouring siblings as one node, and the children of all of them. ``shape`` is equal for equal trees."""

    __slots__ = ("sign", "members", "children", "shape", "size", "number")

    def __init__(self, sign: str, members: list[Node]):
        self.sign, self.members = sign, members
        todo = [self]
        for r in todo:  # the list grows; no recursion, pages may be nested to any depth
            r.children = _runs([c for m in r.members for c in m.children if not isinstance(c, str)])
            todo.extend(r.children)
        _measure(todo)


def _measure(breadth_first: list[Run]) -> None:
    for r in reversed(breadth_first):
        r.size = 1 + sum(c.size for c in r.children)
        r.shape = xxhash.xxh64_intdigest(r.sign + "\x00" + ",".join(str(c.shape) for c in r.children))
    todo, n = [breadth_first[0]], 0
    while todo:  # numbered from the top, children in order
        r = todo.pop()
        r.number = n
        n += 1
        todo.extend(reversed(r.children))


def _bare(sign: str, members: list[Node]) -> Run:
    """A run whose children are still to be set."""
    run = Run.__new__(Run)
    run.sign, run.members, run.children = sign, members, []
    return run


def _runs(nodes: list[Node]) -> list[Run]:
    out: list[tuple[str, list[Node]]] = []
    for n in nodes:
        if is_boilerplate(n):
            continue
        if out and out[-1][0] == n.sign:
            out[-1][1].append(n)
        else:
            out.append((n.sign, [n]))
    return [_bare(s, m) for s, m in out]


def pack_tree(tree: Run) -> bytes:
    """A tree without its members."""
    rows, todo = [], [(tree, 0)]
    while todo:
        r, depth = todo.pop()
        rows.append((depth, r.sign))
        todo.extend((c, depth + 1) for c in reversed(r.children))
    return zstandard.ZstdCompressor().compress(json.dumps(rows).encode())


def unpack_tree(packed: bytes) -> Run:
    path: list[Run] = []
    for depth, sign in json.loads(zstandard.ZstdDecompressor().decompress(packed)):
        r = _bare(sign, [])
        del path[depth:]
        if path:
            path[-1].children.append(r)
        path.append(r)
    _measure(_all(path[0]))
    return path[0]


#: Cells of an alignment table that are kept at once; longer lists of children are halved first.
TABLE_CELLS = 4_000_000


def simple_tree_matching(a: Run, b: Run) -> tuple[int, list[tuple[Run, Run]]]:
    """The size of the largest order-keeping match of two trees, and the matched nodes, from the top."""
    weights: dict[tuple[int, int], int] = {}
    size, pairs, todo = _weight(a, b, weights), [], [(a, b)] if a.sign == b.sign else []
    while todo:
        x, y = todo.pop()
        pairs.append((x, y))
        if x.shape == y.shape:
            todo.extend(zip(reversed(x.children), reversed(y.children), strict=True))
        else:
            todo.extend(reversed(_aligned(x.children, y.children, weights)))
    return size, pairs


def _weight(a: Run, b: Run, weights: dict[tuple[int, int], int]) -> int:
    """Fills ``weights`` for two trees and all pairs below that their match needs."""
    open_pairs = [(a, b, _needed(a, b))] if a.sign == b.sign else []
    while open_pairs:
        x, y, needed = open_pairs[-1]
        for c, d in needed:
            if (c.shape, d.shape) not in weights:
                open_pairs.append((c, d, _needed(c, d)))
                break
        else:
            open_pairs.pop()
            if (x.shape, y.shape) not in weights:
                weights[x.shape, y.shape] = x.size if x.shape == y.shape else 1 + _score(x.children, y.children, weights)
    return weights[a.shape, b.shape] if a.sign == b.sign else 0


def _needed(a: Run, b: Run) -> Iterator[tuple[Run, Run]]:
    """Pairs of different children of one sign, each pair of shapes once."""
    if a.shape == b.shape:
        return
    head, tail = _ends(a.children, b.children)
    by: dict[str, dict[int, Run]] = defaultdict(dict)
    for d in b.children[head:len(b.children) - tail]:
        by[d.sign][d.shape] = d
    for c in {c.shape: c for c in a.children[head:len(a.children) - tail]}.values():
        for d in by.get(c.sign, {}).values():
            yield c, d


def _ends(x: list[Run], y: list[Run]) -> tuple[int, int]:
    """How many equal trees both lists begin and end with: these match each other in a largest match."""
    least, head, tail = min(len(x), len(y)), 0, 0
    while head < least and x[head].shape == y[head].shape:
        head += 1
    while tail < least - head and x[-1 - tail].shape == y[-1 - tail].shape:
        tail += 1
    return head, tail


def _gains(x: list[Run], y: list[Run], weights: dict[tuple[int, int], int]) -> Iterator[np.ndarray]:
    """For each tree of ``x`` the sizes of its matches with those of ``y``."""
    kinds, at = np.unique(np.array([d.shape for d in y], np.uint64), return_inverse=True)
    by_shape: dict[int, np.ndarray] = {}
    for c in x:
        if c.shape not in by_shape:
            by_shape[c.shape] = np.array([weights.get((c.shape, int(k)), 0) for k in kinds], np.int64)[at]
        yield by_shape[c.shape]


def _last_row(x: list[Run], y: list[Run], weights: dict[tuple[int, int], int]) -> np.ndarray:
    row = np.zeros(len(y) + 1, np.int64)
    for gain in _gains(x, y, weights):
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + gain))
    return row


def _score(x: list[Run], y: list[Run], weights: dict[tuple[int, int], int]) -> int:
    head, tail = _ends(x, y)
    ends = sum(c.size for c in x[:head]) + sum(c.size for c in x[len(x) - tail:])
    x, y = x[head:len(x) - tail], y[head:len(y) - tail]
    return ends + (int(_last_row(x, y, weights)[-1]) if x and y else 0)


def _aligned(x: list[Run], y: list[Run], weights: dict[tuple[int, int], int]) -> list[tuple[Run, Run]]:
    """The pairs of a largest match of two lists of trees, in order."""
    out, parts = [], [(x, y)]
    while parts:
        x, y = parts.pop()
        head, tail = _ends(x, y)
        if head or tail:
            out.extend(zip(x[:head], y[:head], strict=True))
            parts += [(x[len(x) - tail:], y[len(y) - tail:]), (x[head:len(x) - tail], y[head:len(y) - tail])]
        elif not x or not y:
            continue
        elif len(x) * len(y) > TABLE_CELLS and len(x) > 1:
            half = len(x) // 2
            before, after = _last_row(x[:half], y, weights), _last_row(x[half:][::-1], y[::-1], weights)
            cut = int(np.argmax(before + after[::-1]))
            parts += [(x[half:], y[cut:]), (x[:half], y[:cut])]
        else:
            out += _traced(x, y, weights)
    return out


def _traced(x: list[Run], y: list[Run], weights: dict[tuple[int, int], int]) -> list[tuple[Run, Run]]:
    table, gains = np.zeros((len(x) + 1, len(y) + 1), np.int64), []
    for i, gain in enumerate(_gains(x, y, weights), 1):
        table[i, 1:] = np.maximum.accumulate(np.maximum(table[i - 1, 1:], table[i - 1, :-1] + gain))
        gains.append(gain)
    out, i, j = [], len(x), len(y)
    while i and j:
        if table[i, j] == table[i - 1, j]:
            i -= 1
        elif table[i, j] == table[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((x[i], y[j]))
    return out[::-1]


def clean(text: str) -> str:
    return _SPACE.sub(" ", entities.unescape(text)).strip()


def direct_text(node: Node, known: dict[int, str] | None = None) -> str:
    """The text of a node and its inline children, not of blocks inside it; ``known`` keeps the texts of nodes by id."""
    known = {} if known is None else known
    if id(node) in known:
        return known[id(node)]
    open_nodes = [(node, iter(node.children), [])]
    while True:
        now, children, parts = open_nodes[-1]
        for c in children:
            if isinstance(c, str):
                parts.append(c)
            elif c.tag not in BLOCK and id(c) in known:
                parts.append(known[id(c)])
            elif c.tag not in BLOCK:
                open_nodes.append((c, iter(c.children), []))
                break
        else:
            open_nodes.pop()
            text = known[id(now)] = clean(" ".join(parts))
            if not open_nodes:
                return text
            open_nodes[-1][2].append(text)


def _all(run: Run) -> list[Run]:
    out = [run]
    for r in out:
        out.extend(r.children)
    return out


def _main(root: Node) -> list[Node]:
    """The outermost article elements (or main, or the body), leaving out those inside boilerplate."""
    found: dict[str, list[Node]] = {"article": [], "main": [], "body": []}

    todo = [(c, frozenset()) for c in reversed(root.children)]
    while todo:
        c, inside = todo.pop()
        if isinstance(c, str) or is_boilerplate(c):
            continue
        kind = "main" if c.tag == "main" or c.attrs.get("role") == "main" else c.tag
        kind = "article" if c.attrs.get("itemprop") == "articleBody" else kind
        if kind in found and kind not in inside:
            found[kind].append(c)
            inside = inside | {kind}
        todo.extend((x, inside) for x in reversed(c.children))
    if not found["article"] and not found["main"]:
        # a wrapper around the whole page may be named after one of its parts ("with-sidebar")
        named = [n for n in _descendants(root) if n.tag in ("article", "main")]
        outside = _inside_boilerplate(root) if named else set()
        inner = [n for n in named if id(n) not in outside]
        found["main"] = inner
    return found["article"] or found["main"] or found["body"] or [root]


def _descendants(node: Node) -> list[Node]:
    out = [node]
    for n in out:
        out.extend(c for c in n.children if not isinstance(c, str))
    return out


def _inside_boilerplate(root: Node) -> set[int]:
    """The nodes (by id) inside elements that are no content by their tags."""
    found, todo = set(), [(root, False)]
    while todo:
        n, inside = todo.pop()
        if inside:
            found.add(id(n))
        todo.extend((c, inside or n.tag in NOT_CONTENT) for c in n.children if not isinstance(c, str))
    return found


def blocks(nodes: list[Node], constants: set[int]) -> list[str]:
    """Texts of the blocks in page order, without boilerplate and template constants."""
    out, line = [], []

    def end() -> None:
        text = _SPACE.sub(" ", "".join(line)).strip()
        line.clear()
        if text:
            out.append(text)

    def walk(node: Node) -> None:
        open_nodes = [(node, iter(node.children), id(node) in constants, False)]
        while open_nodes:
            node, children, skip, block = open_nodes[-1]
            for c in children:
                if isinstance(c, str):
                    if not skip:
                        line.append(entities.unescape(c))
                elif c.tag == "br":
                    line.append(" ")
                elif not is_boilerplate(c) and not (c.tag == "header" and node.tag not in ("article", "section", "main")):
                    if c.tag in BLOCK:
                        end()
                    open_nodes.append((c, iter(c.children), id(c) in constants, c.tag in BLOCK))
                    break
            else:
                open_nodes.pop()
                if block:
                    end()

    for n in nodes:
        walk(n)
        end()
    return out


def tree_of(source: str) -> tuple[Node, Run]:
    root = parse(source)
    return root, Run("#root", [root])


def text_key(text: str) -> int:
    """A signed 64-bit hash of a text."""
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def aligned_texts(skeleton: Run, tree: Run) -> list[tuple[Run, Run, dict[int, int]]]:
    """Matched nodes of the skeleton and the page, with the page's texts there (key and length of each different one)."""
    known: dict[int, str] = {}
    out = []
    for own, other in simple_tree_matching(skeleton, tree)[1]:
        texts = {t for m in other.members if (t := direct_text(m, known))}
        out.append((own, other, {text_key(t): len(t) for t in texts}))
    return out


@dataclass
class Wrapper:
    """A host's skeleton, its template's constants by node, and the characters of the different texts in each node's slots."""

    skeleton: Run
    constants: dict[int, set[int]] = field(default_factory=dict)
    slots: dict[int, int] = field(default_factory=dict)
    content: int | None = None  # the content node's number
    article: bool = False  # whether it is an article or main element

    def __post_init__(self) -> None:
        nodes = sorted(_all(self.skeleton), key=lambda r: r.number)
        inside = [self.slots.get(r.number, 0) for r in nodes]
        for r in reversed(nodes):
            inside[r.number] += sum(inside[c.number] for c in r.children)
        now, whole = self.skeleton, inside[0]
        if not whole:
            return
        while not _is_article(now):
            best = max((c for c in now.children if _tag(c) in CONTAINERS), key=lambda c: inside[c.number], default=None)
            if best is None or inside[best.number] < CONTENT_SHARE * whole:
                break
            before = now.children[:now.children.index(best)]
            if not _is_article(best) and any(_tag(c) in ("h1", "h2") and inside[c.number] for c in before):
                break  # the heading belongs to what follows it
            now = best
        self.content, self.article = now.number, _is_article(now)


#: The share of all text in slots that the content node holds at least, and of a host's pages that have a constant.
CONTENT_SHARE, CONSTANT_SHARE = 0.8, 0.8


def _tag(run: Run) -> str:
    return re.split("[.#]", run.sign, maxsplit=1)[0] or run.sign


def _is_article(run: Run) -> bool:
    return _tag(run) in ("article", "main") or run.sign.endswith("#main")


def extract_page(source: str, wrapper: Wrapper | None) -> str:
    root, tree = tree_of(source)
    if wrapper is None:
        return "\n".join(blocks(_main(root), set()))
    constants, content = set(), []
    for own, other, _ in (pairs := aligned_texts(wrapper.skeleton, tree)):
        known = wrapper.constants.get(own.number)
        if known:
            constants.update(id(m) for m in other.members if text_key(direct_text(m)) in known)
        if own.number == wrapper.content:
            content = other.members
    named = _main(root)
    if not content or not wrapper.article and named[0].tag in ("article", "main"):
        content = named
    whole = {id(m) for _, r, _ in pairs if _is_article(r) for m in r.members} | {id(n) for n in content if n.tag in ("article", "main")}
    if all(id(n) in whole for n in content):
        constants = set()  # an article is kept whole
    return "\n".join(blocks(content, constants))


def induce(skeleton: Run, pages: Iterable[str], min_support: int) -> Wrapper | None:
    """The wrapper of one host's different pages: what the query counts by Spark."""
    seen, lengths, n = Counter(), {}, 0
    for page in pages:
        n += 1
        for own, _, texts in aligned_texts(skeleton, tree_of(page)[1]):
            seen.update((own.number, t) for t in texts)
            lengths.update(((own.number, t), k) for t, k in texts.items())
    if n < min_support:
        return None
    wrapper: tuple[dict[int, set[int]], dict[int, int]] = (defaultdict(set), defaultdict(int))
    for (number, t), pages_with in seen.items():
        if _is_constant(pages_with, n, min_support):
            wrapper[0][number].add(t)
        else:
            wrapper[1][number] += lengths[number, t]
    return Wrapper(skeleton, dict(wrapper[0]), dict(wrapper[1]))


def _is_constant(pages_with, n, min_support: int):
    """On the pages with a text and all pages: numbers or columns."""
    return (pages_with >= min_support) & (pages_with * 10 >= n * int(10 * CONSTANT_SHARE))


def _order(page: str) -> int:
    """Longest first; of equally long pages the one of the greatest hash."""
    return len(page) << 31 | xxhash.xxh32_intdigest(page) >> 1


def extract(pages: list[str], min_support: int = 4) -> list[str]:
    """The main texts of pages of one host."""
    different = sorted(set(pages))
    wrapper = None
    if len(different) >= min_support:
        wrapper = induce(tree_of(max(different, key=_order))[1], different, min_support)
    return [extract_page(p, wrapper) for p in pages]


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1)), F.lit(""))


def _mapped(rows: DataFrame, make, schema: str) -> DataFrame:
    """``make(row)`` of each row gives column values, a list for each column of ``schema``."""
    names = [f.split(" ")[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made: list[list] = [[] for _ in names]
            for row in b.to_pylist():
                for column, own in zip(made, make(row), strict=True):
                    column.extend(own)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(made, kinds, strict=True)], names)

    arrow = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    kinds = [arrow[f.split(" ")[1]] for f in schema.split(", ")]
    return rows.mapInArrow(returns_memory(run), schema)


@lru_cache(maxsize=64)
def _skeleton(packed: bytes) -> Run:
    return unpack_tree(packed)


def _wrapper(packed: bytes, constants: list[tuple], slots: list[tuple]) -> Wrapper:
    by: dict[int, set[int]] = defaultdict(set)
    for number, text in constants:
        by[number].add(text)
    return Wrapper(unpack_tree(packed), dict(by), dict(slots))


def induce_wrappers(rows: DataFrame, min_support: int = 4) -> DataFrame:
    """Per host with enough different pages: skeleton, constants and slots. ``rows``: host, html and digest of each page.

    A host's row is bounded by its reference page and by the texts that most of its pages share.
    """
    pages = rows.where(F.length("html") > 0)
    many = pages.select("host", "digest").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_support)
    key = F.shiftleft(F.length("html").cast("bigint"), 31) + F.shiftrightunsigned("digest", 33)
    keyed = pages.select("host", "html", key.alias("key"))
    longest = staged(keyed.groupBy("host").agg(F.max("key").alias("key")).join(many, "host"), "longest-pages")
    reference = keyed.join(longest, ["host", "key"]).groupBy("host", "n").agg(F.first("html").alias("html"))  # one row per task and host

    def skeleton(row: dict) -> tuple:
        return [row["host"]], [row["n"]], [pack_tree(tree_of(row["html"])[1])]

    skeletons = staged(_mapped(reference, skeleton, "host string, n bigint, skeleton binary"), "skeletons")

    def texts(row: dict) -> tuple:
        found = [(r.number, t, k) for r, _, own in aligned_texts(_skeleton(row["skeleton"]), tree_of(row["html"])[1]) for t, k in own.items()]
        n = len(found)
        return ([row["host"]] * n, [row["n"]] * n, [row["digest"]] * n, *map(list, zip(*found, strict=True))) if n else ([],) * 6

    seen = _mapped(pages.select("host", "digest", "html").join(skeletons, "host"), texts,
                   "host string, n bigint, digest bigint, number int, text bigint, chars int")
    once = seen.groupBy("host", "n", "number", "text", "digest").agg(F.max("chars").alias("chars"))  # copies of a page count once
    counted = once.groupBy("host", "n", "number", "text").agg(F.count(F.lit(1)).alias("pages"), F.max("chars").cast("bigint").alias("chars"))
    constant = _is_constant(F.col("pages"), F.col("n"), min_support)
    by_node = counted.groupBy("host", "number").agg(
        F.collect_list(F.when(constant, F.struct("number", "text"))).alias("constants"),  # each on most pages
        F.sum(F.when(~constant, F.col("chars"))).alias("chars"))
    by_host = by_node.groupBy("host").agg(
        F.flatten(F.collect_list("constants")).alias("constants"),
        F.collect_list(F.when(F.col("chars") > 0, F.struct("number", "chars"))).alias("slots"))
    return staged(skeletons.join(by_host, "host", "left").select("host", "skeleton", "constants", "slots"), "wrappers")


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_support: int = 4) -> DataFrame:
    """Per page: page_id, url, text (the main text)."""
    bounded_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    rows = rows.withColumns({"host": host_of(F.col("url")), "digest": F.xxhash64("html")})
    wrappers = induce_wrappers(rows.select("host", "html", "digest"), min_support)
    joined = rows.select("page_id", "url", "html", "host").join(wrappers, "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Wrapper | None] = {}
        for b in batches:
            texts = []
            for i, (host, html) in enumerate(zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True)):
                if host not in known:
                    if len(known) >= 64:
                        known.clear()
                    packed, constants, slots = (b.column(c)[i].as_py() for c in ("skeleton", "constants", "slots"))
                    known[host] = None if packed is None else _wrapper(packed, [tuple(x.values()) for x in constants or []], [tuple(x.values()) for x in slots or []])
                texts.append(extract_page(html or "", known[host]))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    schema = rows.select("page_id", "url", F.col("html").alias("text")).schema
    return joined.mapInArrow(returns_memory(run), schema)
