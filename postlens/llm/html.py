"""Main text of web pages by wrappers inferred for each host: union-free regular expressions over token streams.

A page becomes a stream of tags and texts, closed where the page forgot to,
and so a balanced expression. Two expressions of one host are aligned from
left to right: equal tags are aligned inside; where they differ, the one that
occurs later on the other side makes what stands before it optional, neighbours
with the same tag become one repeated group, and texts that differ become a
slot. Aligning page after page gives the host's wrapper. Wrappers can be
aligned like pages, so they are first built within each task, then for salted
parts of a host, then for the host: a host with a third of all pages is
no single task's work, and every page counts.

The main text of a page is what lies in its article. Menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles and comments are recognised
by their tags and names, but no name drops an article or what it lies in, nor
on a page without one what holds most of the host's changing text. A page without an article tag gets the deepest
element of its host's wrapper that holds most of the host's changing text, its
region, and of what stands beside it all but the texts that never change there.
Text that the wrapper found at one place, itself unchanged on at least
``TEMPLATE_PAGES`` distinct pages, is the template's and goes as well, where
other texts than headings vary on the host and one of the page's stays.
Pages are distinct when the texts of their articles are.

Defined results: a null or empty page has an empty text; a cut page is read to
where it ends; repeated pages are aligned each; pages with a null url share
the empty host; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import html
import json
import logging
import re
import zlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from postlens.llm.tables import map_rows, slices, stored
from postlens.llm.urls import host

log = logging.getLogger(__name__)

TEMPLATE_PAGES = 10
REGION_SHARE = 0.7
HOSTS_IN_TASK = 500
BROADCAST_BYTES = 16 << 20
SALTS = 16
DEPTH = 60
WRAPPER_BYTES = 1 << 20
DROPPED = "!"
NAMED = "!?"

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object canvas audio video".split())
BLOCKS = frozenset(
    """address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer
    form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr
    ul""".split()
)
# Opening one of these ends an open element of the others named.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"},
}
SCOPES = frozenset("ul ol dl table article section main aside nav div td th body form header footer blockquote".split())
DROP_TAGS = frozenset("nav footer aside form button select dialog menu head label input fieldset".split()) | RAW
DROP_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar status toolbar".split()
)
DROP_NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense adslot banner banners breadcrumb breadcrumbs byline
    comment comments commentlist consent cookie cookies copyright disclaimer discussion disqus footer gdpr header
    legal login masthead menu menus modal nav navbar navigation newsletter notice notices notification overlay pager
    paging pagination paywall popup promo promos promotion promoted recommend recommended recommendations related
    replies reply respond responses search share sharing shares sidebar signup skip social sponsor sponsored sponsors
    side subscribe subscription tags tagcloud teaser toolbar topbar trackbacks warning widget widgets""".split()
)
KEEP_NAMES = frozenset("article articlebody content entry main post story text".split())
# Names of what readers and other articles say: these go whatever they hold.
OTHERS = frozenset(
    """ad ads advert adverts comment comments commentlist discussion disqus promo recommended related replies reply
    respond responses sponsored teaser trackbacks""".split()
)
# Words that an article may be about or say itself: inside one they don't tell.
TOPICS = frozenset(
    """consent copyright discussion disclaimer legal menu menus notification notifications recommendations response
    responses search sharing side social sponsor sponsors subscription tags warning""".split()
)
# The last word tells as well, unless the first one says a state or a subject.
ENDINGS = frozenset(
    """ad ads adverts advertisement banner breadcrumb breadcrumbs byline comments commentlist consent disqus footer header
    masthead menu modal nav navbar navigation newsletter overlay pager pagination paywall popup promo related share
    sharing sidebar toolbar widget""".split()
)
STATES = frozenset(
    """category cat tag topic subject section format type has have with without no not is hide show js layout""".split()
)
HEADINGS = frozenset("h1 h2 h3".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(>|\Z)", re.S)
_NAME = re.compile(r"(?:\s|\A|[\"'])(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)|(?=[\s/]|\Z))", re.I)
_CUT = re.compile(r"</?(?:[a-zA-Z!?]|\Z)")
_DIGIT = re.compile(r"\d")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Element:
    """A tag with its name for the alignment and what it holds: elements and texts in order."""

    tag: str
    label: str
    dropped: bool = False
    article: bool = False
    named: int = 0  # 1 dropped for its name alone, 2 for one of OTHERS
    main: bool = False  # an article that isn't one of several on a page by its kind
    inside: list = field(default_factory=list)


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): html.unescape((v or "").strip("\"'")) for k, v in _NAME.findall(raw)} if raw.strip(" /") else {}


def telling(name: str) -> str | None:
    """The word of DROP_NAMES that a whole class name or id is, begins with or ends on."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    if not parts:
        return None
    for whole in ("".join(parts), parts[0]):
        if whole in DROP_NAMES or whole in ENDINGS:
            return whole
    return parts[-1] if parts[-1] in ENDINGS and parts[0] not in STATES else None


def element(tag: str, raw: str, in_article: bool) -> Element:
    found = _attributes(raw)
    names = [n for k in ("class", "id") for n in found.get(k, "").split()]
    role, prop = found.get("role", "").lower(), found.get("itemprop", "").lower()
    main = tag in ("article", "main") or role in ("main", "article") or prop == "articlebody"
    told = {t for n in names if (t := telling(n))}
    if told <= {"header"} and (in_article or KEEP_NAMES.intersection(p.lower() for n in names for p in _PARTS.findall(n))):
        told = set()
    if in_article:
        told -= TOPICS
    if main and not (in_article and tag == "article"):
        told = set()
    named = bool(told) and not (in_article and tag in HEADINGS) and tag not in ("html", "body")
    bad = tag in DROP_TAGS or (tag == "header" and not in_article) or role in DROP_ROLES
    bad |= "hidden" in found or found.get("aria-hidden") == "true" or bool(_SHOWN.search(found.get("style", "")))
    # Names with digits, and those of the whole page, are often a page's own: they would part what is alike.
    kinds = () if tag in ("html", "body") else {c for c in found.get("class", "").split() if not _DIGIT.search(c)}
    label = ".".join([tag, *sorted(kinds)])
    kind = 0 if bad or not named else 2 if OTHERS & told else 1
    prefix = NAMED if kind == 1 else DROPPED if bad or named else ""
    shown = main and not bad and not named
    return Element(tag, prefix + label, bad or named, shown, kind, shown and tag != "article" and role != "article")


def parse(page: str) -> Element:
    """The page as a balanced tree; forgotten ends are put in."""
    root = _tree(page)
    _free(root, True, 2)
    for kinds in (1, 2):
        if not has_article(root):
            _free(root, False, kinds)
    return root


def _shown(node: Element) -> None:
    node.dropped, node.named, node.label = False, 0, node.label.removeprefix(NAMED).removeprefix(DROPPED)


def _free(node: Element, main: bool, kinds: int) -> bool:
    """Takes back the dropping by names of those kinds of all that an article (or with ``main`` only a main one) lies in."""
    inner = [_free(c, main, kinds) for c in node.inside if not isinstance(c, str) and (not c.dropped or 0 < c.named <= kinds)]
    if any(inner) and node.named:
        _shown(node)
    return any(inner) or (node.article and (node.main or not main))


def _tree(page: str) -> Element:
    root = Element("", "")
    stack, at, length = [root], 0, len(page)
    while at < length:
        begin = page.find("<", at)
        if begin < 0:
            begin = length
        if begin > at:
            stack[-1].inside.append(page[at:begin])
        if begin == length:
            break
        match = _TOKEN.match(page, begin)
        if match is None:
            if page.find(">", begin) < 0 and _CUT.match(page, begin):
                break
            stack[-1].inside.append("<")
            at = begin + 1
            continue
        at = match.end()
        close, tag, raw, end = match.groups()
        if tag is None or not end:
            continue
        tag = tag.lower()
        if close:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    del stack[depth:]
                    break
                if stack[depth].tag in ("article", "main", "body", "table") and tag not in ("html", "body", "article", "main", "table"):
                    break
            continue
        if tag in BLOCKS:
            _end_paragraph(stack)
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag in ENDS.get(tag, ()):
                del stack[depth:]
                break
            if stack[depth].tag in SCOPES and stack[depth].tag not in ENDS.get(tag, ()):
                break
        if tag in ("html", "body", "head") and any(e.tag == tag for e in stack):
            continue
        if tag == "body":
            del stack[next((i for i, e in enumerate(stack) if e.tag == "head"), len(stack)):]
        new = element(tag, raw, any(e.article for e in stack))
        stack[-1].inside.append(new)
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at) if not raw.rstrip().endswith("/") else None
            if not raw.rstrip().endswith("/"):
                at = stop.end() if stop else length
        elif tag not in VOID and not raw.rstrip().endswith("/") and len(stack) < 400:
            stack.append(new)
    return root


def _end_paragraph(stack: list[Element]) -> None:
    for depth in range(len(stack) - 1, 0, -1):
        if stack[depth].tag == "p":
            del stack[depth:]
            return
        if stack[depth].tag in BLOCKS:
            return


# --- wrappers -------------------------------------------------------------------
#
# An expression is a list of items. ["t", text or None, chars, marks] is a text, constant
# or (None) a slot; ["e", label, quantity, [items], pages] an element, whose quantity is
# "" (once), "?" (optional), "+" (repeated) or "*" (both). Marks are digests of the distinct
# pages on which a constant text stood, True from TEMPLATE_PAGES of them; a slot has none.


def text_item(text: str, mark: int = 0) -> list:
    plain = " ".join(text.split())
    return ["t", f"{len(plain)}:{zlib.crc32(plain.encode('utf-8', 'replace')):08x}", len(plain), [mark]]


def page_mark(root: Element) -> int:
    """A digest of the page's texts in its article, equal for copies, also when what surrounds it differs."""
    text = "\n".join(blocks(root, None, not has_article(root), False))
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=6).digest(), "big")


def united(x: list | bool, y: list | bool) -> list | bool:
    """Marks of both sides; their number is all that counts once there are TEMPLATE_PAGES."""
    if x is True or y is True:
        return True
    if x == y:
        return x
    both = sorted({*x, *y})
    return both if len(both) < TEMPLATE_PAGES else True


def expression(node: Element, depth: int = 0, mark: int | None = None) -> list:
    """A page's own expression: its tree with runs of equal tags folded into repeated groups."""
    items: list = []
    if mark is None:
        mark = page_mark(node)
    for part in node.inside:
        if isinstance(part, str):
            if part.strip():
                items.append(text_item(part, mark))
        elif part.tag not in RAW and part.tag != "head" and depth < DEPTH:
            items.append(["e", part.label, "", expression(part, depth + 1, mark), 1])
    return fold(items)


def own(page: str) -> dict:
    """The wrapper of one page."""
    root = parse(page)
    mark = page_mark(root)
    return {"pages": 1, "marks": [mark], "items": expression(root, 0, mark)}


def fold(items: list) -> list:
    """Neighbours with the same tag, with or without text between, become one repeated group."""
    out: list = []
    for item in items:
        if item[0] == "e" and out:
            if out[-1][0] == "e" and out[-1][1] == item[1]:
                out[-1] = repeated(out[-1], item)
                continue
        if item[0] == "t" and out and out[-1][0] == "t":
            out[-1] = ["t", None, out[-1][2] + item[2], []]
            continue
        out.append(item)
    return out


def repeated(a: list, b: list) -> list:
    quantity = "*" if "?" in a[2] + b[2] or "*" in a[2] + b[2] else "+"
    return ["e", a[1], quantity, align(a[3], b[3]), max(a[4], b[4])]


def align(a: list, b: list) -> list:
    """The expression that both expressions match."""
    out: list = []
    i = j = 0
    while i < len(a) and j < len(b):
        x, y = a[i], b[j]
        if x[0] == "t" and y[0] == "t":
            equal = x[1] is not None and x[1] == y[1]
            out.append(["t", x[1] if equal else None, x[2] + y[2], united(x[3], y[3]) if equal else []])
            i, j = i + 1, j + 1
        elif x[0] == "e" and y[0] == "e" and x[1] == y[1]:
            out.append(["e", x[1], quantity(x[2], y[2]), align(x[3], y[3]), x[4] + y[4]])
            i, j = i + 1, j + 1
        else:
            ahead_b, ahead_a = later(b, j, x), later(a, i, y)
            if ahead_b is not None and (ahead_a is None or ahead_b - j <= ahead_a - i):
                out += map(optional, b[j:ahead_b])
                j = ahead_b
            elif ahead_a is not None:
                out += map(optional, a[i:ahead_a])
                i = ahead_a
            else:
                out += [optional(x), optional(y)]
                i, j = i + 1, j + 1
    out += map(optional, a[i:])
    out += map(optional, b[j:])
    return fold(out)


def later(items: list, at: int, wanted: list) -> int | None:
    for k in range(at, len(items)):
        if items[k][0] == wanted[0] and (wanted[0] == "t" or items[k][1] == wanted[1]):
            return k
    return None


def optional(item: list) -> list:
    if item[0] == "t":
        return item
    return ["e", item[1], {"": "?", "+": "*"}.get(item[2], item[2]), item[3], item[4]]


def quantity(x: str, y: str) -> str:
    if x == y:
        return x
    return "*" if {"+", "*"} & {x, y} and {"?", "*"} & {x, y} else "+" if "+" in (x, y) else "?"


def regular_expression(items: list) -> str:
    """The wrapper as text: tags, #TEXT slots, ( )? and ( )+ groups."""
    shown = []
    for item in items:
        if item[0] == "t":
            shown.append("#TEXT" if item[1] is None else f"'{item[1]}'")
        else:
            inner = f"<{item[1]}>{regular_expression(item[3])}</>"
            shown.append(f"({inner}){item[2]}" if item[2] else inner)
    return "".join(shown)


def load(text: str | None) -> dict | None:
    return json.loads(text) if text else None


def _show(node: Element, items: list) -> None:
    """Shows in a page what most() showed in its wrapper."""
    for child, item in zip(node.inside, matched(node.inside, items, True)):
        if isinstance(child, str) or item is None:
            continue
        if child.named == 1 and not item[1].startswith(DROPPED):
            _shown(child)
        if not child.dropped:
            _show(child, item[3])


def joined(one: dict | None, other: dict) -> dict:
    if one is None:
        return other
    both = {"pages": one["pages"] + other["pages"], "items": align(one["items"], other["items"])}
    return both | {"marks": united(one["marks"], other["marks"])} if "marks" in one and "marks" in other else both


def bounded(wrapper: dict) -> dict:
    """The wrapper; above ``WRAPPER_BYTES`` without its rarest elements, those of the fewest pages first.

    An element without a place in the wrapper is text of its page like any
    other, so this can only keep text. Extraction doesn't call it: its wrappers
    are whole, however large.
    """
    least = 1
    while least < wrapper["pages"] and len(json.dumps(wrapper)) > WRAPPER_BYTES:
        wrapper = wrapper | {"items": shared_by(wrapper["items"], least)}
        least *= 2
    return wrapper


def shared_by(items: list, pages: int) -> list:
    """The items without elements of at most so many pages."""
    kept = [i for i in items if i[0] != "e" or i[4] > pages]
    return [[*i[:3], shared_by(i[3], pages), *i[4:]] if i[0] == "e" else i for i in kept]


def _infer(batches):
    """Within a task: (host, wrapper) over all its pages, given out when many hosts have gathered."""
    held: dict[str, dict] = {}

    def given():
        names, found = list(held), [json.dumps(w) for w in held.values()]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(found, pa.string())], ["host", "wrapper"])

    for whole in batches:
        for batch in slices(whole):
            for name, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[name] = joined(held.get(name), own(page or ""))
            if len(held) >= HOSTS_IN_TASK:
                yield given()
    if held:
        yield given()


def _merge(key, table):
    wrapper = None
    for text in sorted(table.column("wrapper").to_pylist()):
        wrapper = joined(wrapper, json.loads(text))
    return pa.table({"host": pa.array([key[0].as_py()], pa.string()), "wrapper": pa.array([json.dumps(wrapper)], pa.string())})


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper) over all pages(host, html): partial wrappers of tasks, then of salted parts, then of hosts."""
    parts = pages.select("host", "html").mapInArrow(_infer, "host string, wrapper string")
    salted = parts.withColumn("salt", F.pmod(F.hash("wrapper"), F.lit(SALTS)))
    some = salted.groupBy("host", "salt").applyInArrow(_merge, "host string, wrapper string")
    return some.groupBy("host").applyInArrow(_merge, "host string, wrapper string")


# --- extraction -------------------------------------------------------------------


def region(items: list, path: tuple[str, ...] = ()) -> tuple[str, ...]:
    """Path of the deepest element that holds most of the changing text."""
    total = changing(items)
    for item in items:
        if item[0] == "e" and not item[1].startswith(DROPPED) and total and changing(item[3]) >= REGION_SHARE * total:
            if item[2] in ("+", "*") or item[1].split(".")[0] not in BLOCKS or item[1].split(".")[0] in ("p", "li", "td"):
                return path
            return region(item[3], (*path, item[1]))
    return path


def changing(items: list, named: bool = False) -> int:
    """Characters of slots in what is shown, or also in what only its name drops."""
    total = 0
    for item in items:
        if item[0] == "t":
            total += item[2] if item[1] is None else 0
        elif not item[1].startswith(DROPPED) or (named and item[1].startswith(NAMED)):
            total += changing(item[3], named)
    return total


def most(items: list) -> list:
    """The items, where those that only their name drops but that hold most of the changing text are shown."""
    total = changing(items, True)

    def freed(part: list) -> list:
        out = []
        for item in part:
            if item[0] == "e" and (item[1].startswith(NAMED) or not item[1].startswith(DROPPED)):
                if 2 * changing(item[3], True) > total:
                    item = [item[0], item[1].removeprefix(NAMED), item[2], freed(item[3]), item[4]]
            out.append(item)
        return out

    return freed(items) if total else items


def matched(parts: list, items: list, named: bool = False) -> list:
    """For each part of a page's element the wrapper's item that it stands for, or None, found as align() goes on.

    Neighbours that expression() folds stand for one item; parts without a place in an expression for none.
    """
    groups: list[tuple[tuple, list[int]]] = []
    for at, part in enumerate(parts):
        if isinstance(part, str):
            if not part.strip():
                continue
            kind = ("t", None)
        elif part.tag in RAW or part.tag == "head":
            continue
        else:
            kind = ("e", part.label.removeprefix(NAMED) if named else part.label)
        if groups and groups[-1][0] == kind:
            groups[-1][1].append(at)
        else:
            groups.append((kind, [at]))
    found: list = [None] * len(parts)
    i = j = 0
    while i < len(groups) and j < len(items):
        kind, places = groups[i]
        if _is(items[j], kind, named):
            for at in places:
                found[at] = items[j]
            i, j = i + 1, j + 1
            continue
        ahead = next((k for k in range(j, len(items)) if _is(items[k], kind, named)), None)
        behind = next((k for k in range(i, len(groups)) if _is(items[j], groups[k][0], named)), None)
        if behind is not None and (ahead is None or behind - i <= ahead - j):
            i = behind
        elif ahead is not None:
            j = ahead
        else:
            i, j = i + 1, j + 1
    return found


def _is(item: list, kind: tuple, named: bool = False) -> bool:
    return item[0] == kind[0] and (kind[0] == "t" or (item[1].removeprefix(NAMED) if named else item[1]) == kind[1])


def body_varies(items: list) -> bool:
    """Whether a text that isn't a heading's changes in what is shown."""
    for item in items:
        if item[0] == "t":
            if item[1] is None:
                return True
        elif not item[1].startswith(DROPPED) and item[1].split(".")[0] not in HEADINGS and body_varies(item[3]):
            return True
    return False


def blocks(node: Element, items: list | None, inside: bool, limit: bool, region: Element | None = None, least: int = 0) -> list[str]:
    """Texts of the blocks in page order; with a wrapper, its template's texts are left out.

    The template's texts stay where nothing but headings varies beside them, or would be left. Beside the
    region a text is the template's, headings too, once it was unchanged on ``least`` distinct pages.
    """
    out: list[str] = []
    run: list[str] = []
    headings = 0

    def close(heading: bool = False):
        nonlocal headings
        plain = " ".join("".join(run).split())
        if plain:
            out.append(plain)
            headings += heading
        run.clear()

    def walk(part: Element, wrapper: list | None, shown: bool, limit: bool, beside: bool):
        held = matched(part.inside, wrapper) if wrapper else [None] * len(part.inside)
        for child, item in zip(part.inside, held):
            if isinstance(child, str):
                if shown:
                    proven = limit and item is not None and item[3] is True and part.tag not in HEADINGS
                    if beside and item is not None:
                        proven = item[3] is True or len(item[3]) >= least
                    if not (proven and text_item(child)[1] == item[1]):
                        run.append(html.unescape(child))
                continue
            if child.dropped or child.tag in RAW:
                if child.tag in BLOCKS:
                    close()
                continue
            if child.tag == "br":
                run.append(" ")
                continue
            block = child.tag in BLOCKS
            if block:
                close()
            below = item[3] if item is not None else None
            enters = child.article and not shown
            varies = not (enters or child is region) or body_varies(below or [])
            walk(child, below, shown or child.article, limit and varies, beside and child is not region)
            if block:
                close(child.tag in HEADINGS)

    walk(node, items, inside, limit and (not inside or body_varies(items or [])), region not in (None, node))
    close()
    if limit and len(out) == headings:
        return blocks(node, items, inside, False, region, least) or blocks(node, items, inside, False)
    return out


def has_article(node: Element) -> bool:
    return node.article or any(has_article(c) for c in node.inside if not isinstance(c, str) and not c.dropped)


def _show_named(node: Element, article: bool = False) -> None:
    """Shows what lies in an article and only its name drops."""
    for child in node.inside:
        if not isinstance(child, str):
            if article and child.named == 1:
                _shown(child)
            if not child.dropped:
                _show_named(child, article or child.article)


def at_path(node: Element, items: list, path: tuple[str, ...]) -> tuple[Element, list]:
    """Where the path leads in the page, as far as it goes."""
    for label in path:
        pairs = zip(node.inside, matched(node.inside, items))
        at = next(((c, w) for c, w in pairs if not isinstance(c, str) and w is not None and c.label == label and not c.dropped), None)
        if at is None:
            break
        node, items = at[0], at[1][3]
    return node, items


def main_text(page: str, wrapper: dict | None = None) -> str:
    root = parse(page)
    items = wrapper["items"] if wrapper else None
    if items is not None and not has_article(root):
        if "most" not in wrapper:
            wrapper["most"] = most(items)
        if wrapper["most"] != items:
            items = wrapper["most"]
            _show(root, items)
    inside, main, least = not has_article(root), None, 0
    if inside and items is not None:
        main = at_path(root, items, region(items))[0]
        marks = wrapper.get("marks")
        least = min(TEMPLATE_PAGES, len(marks) if isinstance(marks, list) else wrapper["pages"])
    found = blocks(root, items, inside, items is not None, main, least)
    if not found and not inside:
        _show_named(root)
        found = blocks(root, None, False, False)
    return "\n".join(found)


def sized(found: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Marks the stored wrappers for broadcast when names and wrappers have at most ``most`` bytes; logs the largest wrapper."""
    row = found.agg(F.sum(F.octet_length("wrapper") + F.octet_length("of")), F.max(F.octet_length("wrapper"))).first()
    log.info("wrappers: %s bytes, the largest %s", row[0] or 0, row[1] or 0)
    return F.broadcast(found) if (row[0] or 0) <= most else found.hint("merge")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every row of pages(page_id, url, html).

    The wrappers are stored, one row a host, and joined with the pages:
    broadcast when all of them have at most ``BROADCAST_BYTES``, else by a
    shuffle that Spark splits for large hosts.
    """
    given = pages.select("page_id", "url", "html").withColumn("host", host())
    found = stored(wrappers(given), "wrappers")
    joined_pages = given.join(sized(found.withColumnRenamed("host", "of")), F.col("host") == F.col("of"), "left")

    def make():
        loaded: dict[str, dict] = {}

        def work(batch: dict) -> dict:
            texts = []
            for name, page, wrapper in zip(batch["host"], batch["html"], batch["wrapper"]):
                if name not in loaded:
                    if len(loaded) >= HOSTS_IN_TASK:
                        loaded.clear()
                    loaded[name] = load(wrapper)
                texts.append(main_text(page or "", loaded[name]))
            return {"page_id": batch["page_id"], "url": batch["url"], "text": texts}

        return work

    return map_rows(joined_pages.select("page_id", "url", "host", "html", "wrapper"), make, "page_id bigint, url string, text string")
