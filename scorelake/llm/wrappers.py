"""Main text by wrapper inference: one union-free regular expression for the pages of each host.

A page is a stream of tags and texts. The wrapper of a host starts as the stream of its first page, and each further
stream is aligned with it, level by level of the open elements (``align``). Mismatches are resolved as they come:
texts that differ become a slot, texts that stay the same on all pages are part of the template; what only some pages
have becomes optional; what comes in different numbers, or more than ``FIXED`` times, becomes a repeated group; what
comes in several orders becomes one repeated group of options. ``expression`` writes the wrapper out. Below an
element whose children have more than ``MOST_LABELS`` labels on the host's pages together classes are not told apart and
all texts are slots; as that hangs on the whole host's labels, aligning is associative but for rare coincidences of
texts. So tasks align what they hold and the results are aligned in turn:
only wrappers are shuffled, a stream of them is merged one by one, and a host with most pages is salted first.

The wrapper then says which of its texts are the article's (``labelled``):

* Where pages mark the article (``article``, else ``main``), the texts inside, but for elements that the alignment and
  their name both tell from it: a class or id names them a notice, a header ... (``WEAK``), and all their text is
  template, the same on at least ``LEAST`` different pages. What only a name or only the alignment speaks against stays.
* Elsewhere, the lines of text that hold a slot: not those that at least ``LEAST`` different pages share as they are,
  nor lists of links (most of an element's text lies in links, on all pages of the host together). Both only before the
  first or behind the last element with a slot among their neighbours in the aligned tree: what lies between is part
  of the text (a list of links, if the elements beside it are lines of text), as is a paragraph beside some with slots.
* Never what HTML sets apart (``nav``, ``footer``, ``aside``, ``form``, ``script`` ..., a ``header`` outside the
  article), roles that say so, hidden elements, or elements with a class or id all of whose parts name such a thing
  (``cookie-notice``, ``comments``, but neither ``has-sidebar`` nor ``share-price``); an element that holds the only
  article, or the only main heading, is no such thing. Inside the article only containers whose class or id names
  adverts, forms, menus, sharing or comments (``SET_APART``), and no paragraphs, headings, cells or items.

A page is read along its host's labelled wrapper, one step a tag, so the time is linear. What a wrapper learned from
other pages does not know is read by HTML's own meaning alone, and ``by_wrapper`` is false.

Defined cases: a null html is empty and gives an empty text; cut-off pages are read as far as they go; pages without
a host share one wrapper; a host with one page has no template text; repeated rows are extracted one by one and count
as one page; an empty table gives no rows; extra columns are ignored. Elements nested deeper than ``DEPTH`` count as
part of the one at that depth. Texts are neither cut nor dropped.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.llm import common

BROADCAST_BYTES = 8 << 20
SALTS = 64
#: More like-named neighbours than this are a repeated group at once.
FIXED = 3
#: Different pages that must share a text for it to be template.
LEAST = 3
#: Labels of one element's children beyond which classes no longer tell them apart.
MOST_LABELS = 64
DEPTH = 100
#: Elements and texts of the pages whose wrappers a task holds before it passes them on.
HELD = 200_000
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements inside a line of text; any other tag ends a block.
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q",
    "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
LEFT_OUT = {"nav", "footer", "aside", "form", "head", "menu", "button", "select", "dialog", "svg", "object", "audio", "video", "canvas", "math"} | RAW
LEFT_OUT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar", "alertdialog"}
#: Parts of names of elements that are set apart; the weak ones, inside an article, only if their text is template too.
SET_APART = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored cookie cookies consent popup modal sidebar menu nav navbar navigation breadcrumb "
    "breadcrumbs comment comments respond replies disqus share sharing social related recommended recommendations newsletter subscribe subscription login signup "
    "search pagination pager widget toolbar".split()
)
WEAK = frozenset("promo promotion banner notice alert overlay header masthead footer skip copyright legal disclaimer".split())
#: Elements that hold a line of an article's text: inside it their class or id says nothing.
LINES = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "td", "th", "tr", "blockquote", "pre", "figure", "figcaption", "caption", "table", "tbody"}
NEUTRAL = frozenset("area bar block box bottom container content group inner item items left links list main outer page right section site slot top unit wrap wrapper".split())
PARAGRAPH_ENDS = {
    "address", "article", "aside", "blockquote", "dd", "div", "dl", "dt", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr",
    "li", "main", "nav", "ol", "p", "pre", "section", "table", "ul",
}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ATTR = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s\"'>]+)))?")
#: Signs behind a label: set apart by its role or as hidden, by a name, by a weak name; an article; what holds the only one.
TEXT, BREAK, MARK, NAMED, WEAKLY, REGION, HOLDS = "#", -1, "!", "%", "~", "@", "^"
MARKS = MARK + NAMED + WEAKLY
MARK_SET, NAMES_SET, ALL_SIGNS = frozenset(MARKS), frozenset(NAMED + WEAKLY), frozenset(MARKS + REGION + HOLDS)


def sets_apart(name: str) -> str:
    """``NAMED`` or ``WEAKLY`` if a class or id names something beside the article, else ''."""
    parts = {p for p in re.split(r"[-_0-9]+", name.lower()) if p}
    if not parts <= SET_APART | WEAK | NEUTRAL:
        return ""
    return NAMED if not parts.isdisjoint(SET_APART) else WEAKLY if not parts.isdisjoint(WEAK) else ""


def _label(name: str, attributes: str) -> str:
    """The element's name, its first plain class (else id), and a mark where they set it apart."""
    if name in ("html", "body"):
        return name
    plain, mark = "", ""
    for key, x, y, z in ATTR.findall(attributes):
        key, value = key.lower(), x or y or z
        if key in ("class", "id"):
            for token in value.split():
                mark = min(mark or WEAKLY, own) if (own := sets_apart(token)) else mark  # in the order of MARKS
                if (not plain or key == "class" and plain[0] == "#") and token.replace("-", "").replace("_", "").isalpha() and len(token) <= 24:
                    plain = (".#"[key == "id"]) + token.lower()
        elif key == "role" and value.lower() in LEFT_OUT_ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            mark = MARK
    return name + plain + mark


def name_of(label: str) -> str:
    return re.split(r"[.#!%~@^]", label, maxsplit=1)[0]


class Page:
    """A page's elements and texts in order: ``labels``, ``parents`` and ``texts`` by number (0: the page), and
    ``events``, numbers of texts with breaks between blocks."""

    def __init__(self, page: str):
        self.labels, self.parents, self.texts, self.events = [""], [-1], [""], []
        names, stack, deep = [""], [0], []
        at, n = 0, len(page)

        def text(s: str) -> None:
            if not s or s.isspace() and (not self.events or self.events[-1] == BREAK):
                return
            self.events.append(len(self.labels))
            self.add(TEXT, stack[-1], s)
            names.append(TEXT)

        while at < n:
            m = TOKEN.search(page, at)
            if not m:
                text(page[at:])
                break
            text(page[at : m.start()])
            at = m.end()
            if not m[2]:
                continue
            name = m[2].lower()
            if name not in INLINE:
                self.events.append(BREAK)
            if m[1]:
                if name in deep:
                    del deep[len(deep) - 1 - deep[::-1].index(name) :]
                    continue
                for k in range(len(stack) - 1, 0, -1):
                    if names[stack[k]] == name:
                        del stack[k:], deep[:]
                        break
                continue
            closed = CLOSES.get(name) or ({"p"} if name in PARAGRAPH_ENDS else ())
            for k in range(len(stack) - 1, 0, -1) if closed else ():
                if names[stack[k]] in closed:
                    del stack[k:], deep[:]
                    break
                if names[stack[k]] not in INLINE:
                    break
            if name not in VOID and len(stack) > DEPTH:
                deep.append(name)
            elif name not in VOID:
                stack.append(len(self.labels))
                self.add(_label(name, m[3]) if m[3] else name, stack[-2], "")
                names.append(name)
            if name in RAW and not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(page, at)
                at = end.start() if end else n
        self._mark_regions(names)

    def add(self, label: str, parent: int, text: str) -> None:
        self.labels.append(label)
        self.parents.append(parent)
        self.texts.append(text)

    def _mark_regions(self, names: list[str]) -> None:
        """The articles (else ``main``) get a sign of their own; what holds the only ones loses its mark, as does a form
        around a page's main heading, and what is set apart by its name around the only one."""
        out = [False] * len(names)
        only = names.count("h1") == 1
        found: dict[tuple[bool, str], list[int]] = {}
        for i in range(1, len(names)):
            up = self.parents[i]
            out[i] = out[up] or self.labels[i][-1:] in MARK_SET or names[i] in LEFT_OUT or names[i] == "header"
            if names[i] in ("article", "main"):
                found.setdefault((out[i], names[i]), []).append(i)
            while names[i] == "h1" and up > 0:
                if names[up] == "form" and self.labels[up][-1] != HOLDS:
                    self.labels[up] = self.labels[up].rstrip(MARKS) + HOLDS
                elif only and self.labels[up][-1:] in NAMES_SET:
                    self.labels[up] = self.labels[up].rstrip(MARKS)
                up = self.parents[up]
        for key in ((False, "article"), (False, "main"), (True, "article"), (True, "main")):
            if key in found:
                for i in found[key]:
                    j = i
                    while key[0] and j > 0 and self.labels[j][-1] != HOLDS:
                        self.labels[j] = self.labels[j].rstrip(MARKS) + HOLDS
                        j = self.parents[j]
                for i in found[key]:
                    self.labels[i] = self.labels[i].rstrip(HOLDS) + REGION
                break
        self.has_region = bool(found)

    def wrapper(self) -> list:
        """The page by itself: [children by label: [fewest, most, nodes], pairs of neighbours, whether classes are told
        apart no more]; a text is [digest, signs, pages]."""
        whole = xxhash.xxh32_intdigest("\0".join(self.texts))
        children: list[list[int]] = [[] for _ in self.labels]
        made: list = [None] * len(self.labels)
        for i in range(1, len(self.labels)):
            if self.labels[i] != TEXT or not self.texts[i].isspace():
                children[self.parents[i]].append(i)
        for i in range(len(self.labels) - 1, -1, -1):
            if self.labels[i] == TEXT:
                flat = " ".join(self.texts[i].split())
                made[i] = [xxhash.xxh64_intdigest(flat) >> 12, len(flat), [whole]]
                continue
            kids: dict[str, list] = {}
            pairs, before = set(), ""
            for c in children[i]:
                label = self.labels[c]
                e = kids.setdefault(label, [0, 0, []])
                e[0] += 1
                e[2].append(made[c])
                pairs.add(f"{before} {label}")
                before = label
            pairs.add(f"{before} ")
            for label, e in kids.items():
                e[1] = e[0]
                if e[1] > FIXED:
                    e[2] = [_one(label, e[2])]
            made[i] = _general([kids, pairs, False])
        return made[0]


def _one(label: str, nodes: list) -> list:
    """One node for all of them, as parts of the same page."""
    return reduce(lambda a, b: _joined(label, a, b, True), nodes)


def _joined(label: str, a: list, b: list, same_page: bool) -> list:
    if label != TEXT:
        return align(a, b, same_page)
    if a[0] is None or b[0] is None:
        a[0] = None
    elif same_page:
        a[0] = (a[0] + b[0]) % (1 << 52)
    elif a[0] != b[0]:
        a[0] = None
    a[1] += b[1]
    a[2] = sorted({*a[2], *b[2]})[:LEAST]
    return a


def _bare(label: str) -> str:
    return name_of(label) + (label[-1] if label[-1:] in ALL_SIGNS else "")


def _slots(label: str, node: list) -> list:
    """The node with all its texts as slots."""
    if label == TEXT:
        node[0] = None
    else:
        for x, e in node[0].items():
            e[2] = [_slots(x, y) for y in e[2]]
    return node


def _general(node: list) -> list:
    """If the element's children have more than ``MOST_LABELS`` labels, or had them on some pages, they are told apart by
    name and signs only, and hold slots only: so it does not matter when that was found out."""
    kids, pairs, general = node
    if not general and len(kids) <= MOST_LABELS:
        return node
    bare = {label: _bare(label) for label in kids} | {"": ""}
    out: dict[str, list] = {}
    for label, e in kids.items():
        own = [0, FIXED + 1, [_slots(bare[label], _one(bare[label], e[2]))]]
        if (have := out.get(bare[label])) is None:
            out[bare[label]] = own
        else:
            have[2] = [_one(bare[label], have[2] + own[2])]
    return [out, {" ".join(bare.get(x, _bare(x) if x else x) for x in p.split(" ")) for p in pairs}, True]


def align(a: list, b: list, same_page: bool = False) -> list:
    """The wrapper of both (``a`` is changed): mismatches become slots, options and repeated groups. ``same_page``:
    both are parts of one page, so their texts add up and are not compared."""
    if a[2] or b[2]:
        a[2] = b[2] = True
        a, b = _general(a), _general(b)
    kids, others = a[0], b[0]
    for label, e in kids.items():
        if label not in others:
            e[0] = 0
    for label, f in others.items():
        e = kids.get(label)
        if e is None:
            f[0] = 0
            kids[label] = f
            continue
        if e[1] == f[1] and len(e[2]) == len(f[2]):
            e[2] = [_joined(label, x, y, same_page) for x, y in zip(e[2], f[2], strict=True)]
        else:
            e[2] = [_joined(label, _one(label, e[2]), _one(label, f[2]), same_page)]
        e[0], e[1] = min(e[0], f[0]), max(e[1], f[1])
    a[1] |= b[1]
    return _general(a)


def packed(wrapper: list) -> str:
    return json.dumps(wrapper, default=sorted, separators=(",", ":"))


def unpacked(text: str) -> list:
    def node(w: list) -> list:
        for label, e in w[0].items():
            if label != TEXT:
                e[2] = [node(x) for x in e[2]]
        return [w[0], set(w[1]), w[2]]

    return node(json.loads(text))


def factors(node: list) -> list[list[str]]:
    """The labels of an element's children in the order in which they come; labels that come in several orders lie
    in one factor."""
    kids = [*node[0]]
    after = {x: {p.split(" ")[1] for p in node[1] if p.split(" ")[0] == x} - {""} for x in kids}
    for mid in kids:  # the transitive closure
        for x in kids:
            if mid in after[x]:
                after[x] |= after[mid]
    left, out = sorted(kids), []
    while left:
        first = next(x for x in left if all(x not in after[y] or y in after[x] for y in left))
        group = [y for y in left if y == first or y in after[first] and first in after[y]]
        out.append(group)
        left = [y for y in left if y not in group]
    return out


def expression(node: list) -> str:
    """The wrapper as a union-free expression: '#' a slot, '"' template text, '?' options, '+' and '*' repeats."""

    def one(label: str, e: list) -> str:
        few, most, nodes = e
        bodies = []
        for x in nodes:
            if label == TEXT:
                bodies.append(TEXT if not _template(x) else '"')
            else:
                inner = expression(x)
                bodies.append(f"<{label}>{inner}</>")
        body = "".join(bodies)
        if most > len(nodes):
            return f"({body}){'+' if few else '*'}"
        return body if few else f"({body})?"

    out = []
    for group in factors(node):
        part = "".join(one(x, node[0][x]) if len(group) == 1 else f"({one(x, [1, len(node[0][x][2]), node[0][x][2]])})?" for x in group)
        out.append(part if len(group) == 1 else f"({part})*")
    return "".join(out)


def _template(leaf: list) -> bool:
    return leaf[0] is not None and len(leaf[2]) >= LEAST


def _set_apart(label: str, inside: bool) -> bool:
    sign, name = label[-1:], name_of(label)
    if sign in (REGION, HOLDS):
        return False
    if sign == MARK or name in LEFT_OUT or name == "header" and not inside:
        return True
    return sign in NAMES_SET if not inside else sign == NAMED and name not in LINES | INLINE


def _has_slot(label: str, node: list) -> bool:
    return not _template(node) if label == TEXT else any(_has_slot(x, y) for x, e in node[0].items() for y in e[2])


def labelled(wrapper: list, has_region: bool):
    """What to keep: 1 or 0 for an element all of whose texts have that in common, else its children by label:
    [whether repeated, labelled nodes]."""
    sums: dict[int, tuple[int, int, int]] = {}

    def mass(label: str, node: list, linked: bool) -> tuple[int, int, int]:
        """Signs, signs in links, most links at a time."""
        if label == TEXT:
            return node[1], node[1] * linked, 0
        s = [0, 0, 0]
        for x, e in node[0].items():
            for y in e[2]:
                got = mass(x, y, linked or name_of(x) == "a")
                s = [s[0] + got[0], s[1] + got[1], s[2] + got[2] * (1 if len(e[2]) > 1 else e[1]) + (e[1] if name_of(x) == "a" else 0)]
        sums[id(node)] = (s[0], s[1], s[2])
        return sums[id(node)]

    mass("", wrapper, False)

    def is_links(node: list) -> bool:
        return sums[id(node)][2] > 1 and 2 * sums[id(node)][1] > sums[id(node)][0]

    def within_text(node: list) -> set[tuple[str, int]]:
        """Children, by label and number, that lie between others with slots, and paragraphs beside such with slots."""
        places, at, mixed = [], 0, {}
        for group in factors(node):
            for x in group:
                mixed[x] = group
                for k, y in enumerate(node[0][x][2]):
                    places.append((at, x, k, y))
                    at += len(group) == 1
            at += 1
        held = [(p, x) for p, x, _, y in places if _has_slot(x, y) and (x == TEXT or not is_links(y) and not _set_apart(x, False))]
        if not held:
            return set()
        first, last, slots = held[0][0], held[-1][0], {x for _, x in held}
        pairs, out = [p.split(" ") for p in node[1]], set()
        for p, x, k, y in places:
            outer = k == 0 and ["", x] in pairs or k == len(node[0][x][2]) - 1 and [x, ""] in pairs
            # labels of one factor come in both orders
            between = first < p < last or not outer and any(z != x and z in slots for z in mixed[x])
            if x != TEXT and is_links(y):  # references: a list right between lines of the text
                beside = {z for pair in pairs if x in pair for z in pair if z != x}
                between = between and all(z == TEXT or name_of(z) in LINES - {"li", "tr"} for z in beside)
            elif name_of(x) == "p" and x in slots:
                between = True
            if between:
                out.add((x, k))
        return out

    def varies(node: list) -> bool:
        """Whether a line of text right in the element holds a slot; only lines without one are template."""
        return any(not _template(y) if x == TEXT else name_of(x) in INLINE and varies(y) for x, e in node[0].items() for y in e[2])

    def keep(label: str, node: list, inside: bool, fixed: bool, template: bool, links: bool):
        if label == TEXT:
            return int((inside or not has_region) and not fixed)
        inline = name_of(label) in INLINE
        if links and label and not inline and is_links(node):
            return 0
        if not inline:
            fixed = template and not varies(node)
        spared = within_text(node) if template or links else set()
        out, uniform = {}, set()
        for x, e in node[0].items():
            within = inside or x.endswith(REGION)
            nodes = []
            for k, y in enumerate(e[2]):
                if x != TEXT and (_set_apart(x, within) or within and x[-1] in NAMES_SET and not re.match("h[1-6]", x) and not _has_slot(x, y)):
                    nodes.append(0)
                else:
                    free = x != TEXT and (x, k) in spared
                    nodes.append(keep(x, y, within, fixed, template and not free, links and not free))
            out[x] = [int(e[1] > len(e[2])), nodes]
            uniform.update(k if isinstance(k, int) else None for k in nodes)
        return uniform.pop() if len(uniform) == 1 and None not in uniform else out or int(inside or not has_region)

    if has_region:
        return keep("", wrapper, False, False, False, False)
    for template, links in ((True, True), (True, False), (False, False)):
        if (got := keep("", wrapper, False, False, template, links)) != 0:
            return got
    return 0


def extract(page: Page, labels) -> tuple[str, bool]:
    """(main text, whether the wrapper knew all of the page); ``labels``: of ``labelled``, or None."""
    n = len(page.labels)
    state: list = [labels] + [None] * (n - 1)
    inside, apart = [False] * n, [False] * n
    seen: dict[tuple[int, str], int] = {}
    known = labels is not None
    for i in range(1, n):
        up, label = page.parents[i], page.labels[i]
        inside[i] = inside[up] or label.endswith(REGION)
        apart[i] = not label.endswith(REGION) and (apart[up] or label != TEXT and _set_apart(label, inside[i]))
        s = state[up]
        if isinstance(s, dict):
            e = s.get(label) or s.get(_bare(label))
            if e is None:
                known = known and label == TEXT and page.texts[i].isspace()
                continue
            k = 0
            if not e[0]:
                k = seen[up, label] = seen.get((up, label), -1) + (label != TEXT or not page.texts[i].isspace())
                known = known and k < len(e[1])
                k = max(0, min(k, len(e[1]) - 1))
            state[i] = e[1][k]
        else:
            state[i] = s
    blocks, now = [], []

    def end() -> None:
        block = " ".join(entities.unescape("".join(now)).split())
        if block:
            blocks.append(block)
        now.clear()

    for i in page.events:
        if i == BREAK:
            end()
            continue
        s = state[i]
        if s if isinstance(s, int) else not apart[i] and (inside[i] or not page.has_region):
            now.append(page.texts[i])
    end()
    return "\n".join(blocks), known


def host_of(url: str = "url") -> Column:
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


_WRAPPERS = "host string, region int, salt int, wrapper string"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["host", "region", "salt", "wrapper"])


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by host, region and salt: one wrapper for each; one at a time is held."""
    now, wrapper, out = None, None, []
    for b in batches:
        for host, region, salt, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if now != (host, region, salt):
                if now is not None:
                    out.append((*now, packed(wrapper)))
                now, wrapper = (host, region, salt), unpacked(text)
            else:
                wrapper = align(wrapper, unpacked(text))
            if len(out) >= 200:
                yield _batch(out)
                out = []
    if now is not None:
        out.append((*now, packed(wrapper)))
    yield _batch(out)


def infer(pages: DataFrame) -> DataFrame:
    """Rows (host, region, wrapper): the wrapper, as JSON, of each host's pages with (1) and without (0) marked article."""

    def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list] = {}
        n = salt = 0

        def rows() -> Iterator[pa.RecordBatch]:
            nonlocal salt
            salt += 1
            listed = sorted(held)
            for lo in range(0, len(listed), 200):
                yield _batch([(*k, xxhash.xxh32_intdigest(f"{part} {salt}") % SALTS, packed(held[k])) for k in listed[lo : lo + 200]])
            held.clear()

        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for b in batches:
            for host, text in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
                page = Page(text or "")
                key = (host, int(page.has_region))
                held[key] = align(held[key], page.wrapper()) if key in held else page.wrapper()
                n += len(page.labels)
                if n >= HELD:
                    n = 0
                    yield from rows()
        yield from rows()

    spark, keys = pages.sparkSession, ["host", "region", "salt"]
    parts = pages.select(host_of().alias("host"), F.col("html").cast("string").alias("html")).mapInArrow(streams, _WRAPPERS)
    salted = parts.repartition(common.partitions(spark), *keys).sortWithinPartitions(*keys, "wrapper").mapInArrow(_aligned, _WRAPPERS)
    whole = salted.withColumn("salt", F.lit(0)).repartition(common.partitions(spark), "host").sortWithinPartitions(*keys, "wrapper").mapInArrow(_aligned, _WRAPPERS)
    return whole.select("host", "region", "wrapper")


def labels_of(wrappers: DataFrame) -> DataFrame:
    """Rows (host, labels): what ``labelled`` says of a host's wrappers, as a JSON object by region."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [json.dumps(labelled(unpacked(w), bool(r)), separators=(",", ":")) for r, w in zip(b.column("region").to_pylist(), b.column("wrapper").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("host"), b.column("region"), pa.array(made, pa.string())], names=["host", "region", "one"])

    rows = wrappers.mapInArrow(run, "host string, region int, one string")
    either = lambda r: F.coalesce(F.max(F.when(F.col("region") == r, F.col("one"))), F.lit("null"))
    return rows.groupBy("host").agg(F.concat(F.lit("["), either(0), F.lit(","), either(1), F.lit("]")).alias("labels"))


def extract_pages(pages: DataFrame, wrappers: DataFrame | None = None) -> DataFrame:
    """Rows (page_id, url, text, n_chars, by_wrapper); ``wrappers``: of ``infer``, by default from these pages."""
    labels = common.written(labels_of(infer(pages) if wrappers is None else wrappers), "wrappers")
    size = labels.agg(F.coalesce(F.sum(F.length("labels") + F.length("host")), F.lit(0))).first()[0]
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host_of().alias("host"))
    both = rows.join(F.broadcast(labels) if size <= BROADCAST_BYTES else labels, "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read: dict[str | None, list] = {None: [None, None]}
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part, got = b.slice(lo, 500), []
                for html, known in zip(part.column("html").to_pylist(), part.column("labels").to_pylist(), strict=True):
                    if known not in read:
                        if len(read) > 500:
                            read = {None: [None, None]}
                        read[known] = json.loads(known)
                    page = Page(html or "")
                    got.append(extract(page, read[known][page.has_region]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array([t for t, _ in got], pa.string()), pa.array([len(t) for t, _ in got], pa.int64()), pa.array([w for _, w in got], pa.bool_())],
                    names=["page_id", "url", "text", "n_chars", "by_wrapper"],
                )

    return both.select("page_id", "url", "html", "labels").mapInArrow(run, "page_id long, url string, text string, n_chars long, by_wrapper boolean")


def query(pages: DataFrame) -> DataFrame:
    return extract_pages(pages)
