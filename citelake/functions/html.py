"""HTML to Markdown and link extraction: pure functions over one page.

The tree follows the tokenizer as it comes: void elements hold nothing, an end tag closes the nearest open element
of its name and is ignored if there is none, and nothing is closed implicitly.  Comments and declarations are text
nodes of their own kind, which show where loose text shows (``keep_comments`` turns that off).  Character references count
without their semicolon too, as in browsers; with ``loose`` off what ends before it (a page cut within a reference) stays as written.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin, urlsplit

# Element classes of the Markdown rules.
VOID = frozenset("area base basefont bgsound br col command embed frame hr image img input isindex keygen link menuitem meta nextid param source spacer track wbr".split())
STRIPPED = frozenset("script style nav footer iframe noscript header".split())
SKIPPED = frozenset("script style noscript template svg canvas iframe".split())
CONTAINERS = frozenset(
    "html body div section article main aside header footer nav figure figcaption blockquote dl dd dt form fieldset details summary address center".split()
)
BOLD, ITALIC, LISTS = frozenset(("strong", "b")), frozenset(("em", "i")), frozenset(("ul", "ol"))
INLINE = BOLD | ITALIC | frozenset("a code span u mark small sub sup abbr time label q cite".split())
HEADINGS = {f"h{n}": n for n in range(1, 7)}
SKIPPED_SCHEMES = ("#", "javascript:", "mailto:", "tel:", "data:", "about:")

DEDUP_THRESHOLD = 0.85
DEDUP_LEAST_CHARS = 40
SHINGLE = 5


class Note(str):
    """A comment or declaration."""


class Element:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str | None]):
        self.tag, self.attrs = tag, attrs
        self.children: list[Element | str] = []

    def walk(self) -> Iterator[Element]:
        """This element's descendants in document order."""
        stack = [iter(self.children)]
        while stack:
            for child in stack[-1]:
                if isinstance(child, Element):
                    yield child
                    stack.append(iter(child.children))
                    break
            else:
                stack.pop()

    def text(self) -> str:
        """All text below, without notes."""
        out = []
        for child in self.children:
            if isinstance(child, Element):
                out.append(child.text())
            elif not isinstance(child, Note):
                out.append(child)
        return "".join(out)


#: A reference without its semicolon, and what stands for its ampersand while the page is read: no character of any text.
_OPEN = re.compile(r"&(?=(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*)(?![a-zA-Z0-9;]))")
_AMPERSAND = "\ufdd0"


class _Tree(HTMLParser):
    def __init__(self, keep_comments: bool, loose: bool):
        super().__init__(convert_charrefs=True)
        self.loose = loose
        self.root = Element("", {})
        self.path = [self.root]
        self.keep_comments = keep_comments

    def _written(self, text: str | None) -> str | None:
        return text if self.loose or not text else text.replace(_AMPERSAND, "&")

    def handle_starttag(self, tag, attrs):
        element = Element(tag, {name: self._written(value) for name, value in attrs})
        self.path[-1].children.append(element)
        if tag not in VOID:
            self.path.append(element)

    def handle_startendtag(self, tag, attrs):
        self.path[-1].children.append(Element(tag, {name: self._written(value) for name, value in attrs}))

    def handle_endtag(self, tag):
        for depth in range(len(self.path) - 1, 0, -1):
            if self.path[depth].tag == tag:
                del self.path[depth:]
                return

    def handle_data(self, data):
        siblings, data = self.path[-1].children, self._written(data)
        if siblings and type(siblings[-1]) is str:
            siblings[-1] += data
        else:
            siblings.append(data)

    def _note(self, data):
        if self.keep_comments:
            self.path[-1].children.append(Note(self._written(data)))

    def handle_comment(self, data):
        self._note(data)

    def handle_decl(self, decl):
        self._note(decl[len("DOCTYPE ") :] if decl.upper().startswith("DOCTYPE ") else decl)

    def unknown_decl(self, data):
        self._note(data[len("CDATA[") :] if data.startswith("CDATA[") else data)

    def handle_pi(self, data):
        self._note(data)


def parse(html: str | None, keep_comments: bool = True, loose: bool = True) -> Element:
    tree = _Tree(keep_comments, loose)
    tree.feed((html or "") if loose else _OPEN.sub(_AMPERSAND, html or ""))
    tree.close()
    return tree.root


def numbered(source: str | None, loose: bool = True) -> list[dict]:
    """The page's nodes in document order: number, number of the last descendant, depth, name, text or target, and the elements around."""
    out: list[dict] = []
    stack: list[tuple[Iterator[Element | str], int]] = [(iter(parse(source, loose=loose).children), -1)]
    around: list[int] = []
    while stack:
        children, holder = stack[-1]
        child = next(children, None)
        if child is None:
            stack.pop()
            if holder >= 0:
                out[holder]["last"] = len(out) - 1
                around.pop()
            continue
        pre, is_element = len(out), isinstance(child, Element)
        name = child.tag if is_element else "#note" if isinstance(child, Note) else "#text"
        target = child.attrs.get("href") if is_element else None
        out.append({"pre": pre, "last": pre, "depth": len(around), "tag": name, "text": None if is_element else str(child), "href": target, "above": list(around)})
        if is_element:
            around.append(pre)
            stack.append((iter(child.children), pre))
    return out


def _prune(element: Element, tags: frozenset[str]) -> None:
    stack = [element]
    while stack:
        node = stack.pop()
        node.children = [c for c in node.children if not isinstance(c, Element) or c.tag not in tags]
        stack.extend(c for c in node.children if isinstance(c, Element))


def _flow(element: Element, without: frozenset[str] = frozenset()) -> Iterator[str]:
    """Pieces of the inline rendering of what is inside ``element``."""
    for child in element.children:
        if not isinstance(child, Element):
            yield child
        elif child.tag in SKIPPED or child.tag in without:
            continue
        elif child.tag == "br":
            yield " "
        elif child.tag in INLINE:
            yield _phrase(child, without)
        elif child.tag in CONTAINERS or child.tag in HEADINGS or child.tag in LISTS or child.tag == "table":
            yield one_line(child, without)
        else:
            yield from _flow(child, without)


def one_line(element: Element, without: frozenset[str] = frozenset()) -> str:
    return re.sub(r"\s+", " ", "".join(_flow(element, without))).strip()


def _phrase(element: Element, without: frozenset[str] = frozenset()) -> str:
    """An inline element with its own markup."""
    if element.tag == "code":
        code = element.text().strip()
        return code and f"`{code}`"
    text = one_line(element, without)
    if not text:
        return ""
    if element.tag == "a":
        target = (element.attrs.get("href") or "").strip()
        return f"[{text}]({target})" if target else text
    mark = "**" if element.tag in BOLD else "*" if element.tag in ITALIC else ""
    return mark + text + mark


def _list_lines(element: Element, level: int = 0) -> Iterator[str]:
    number = 0
    for item in element.children:
        if not isinstance(item, Element) or item.tag != "li":
            continue
        text = one_line(item, LISTS)
        if text:
            number += 1
            yield f"{'  ' * level}{f'{number}.' if element.tag == 'ol' else '-'} {text}"
        for inner in item.children:
            if isinstance(inner, Element) and inner.tag in LISTS:
                yield from _list_lines(inner, level + 1)


def _table_lines(element: Element) -> Iterator[str]:
    grid = []
    for row in element.walk():
        if row.tag == "tr":
            cells = [one_line(cell).replace("|", "\\|") for cell in row.walk() if cell.tag in ("td", "th")]
            if cells:
                grid.append(cells)
    if not grid:
        return
    columns = max(map(len, grid))
    grid = [cells + [""] * (columns - len(cells)) for cells in grid]
    if any(grid[0]):
        head, body = grid[0], grid[1:]
    else:
        head, body = [f"col{n}" for n in range(1, columns + 1)], grid
    for cells in (head, ["---"] * columns, *body):
        yield f"| {' | '.join(cells)} |"


def blocks(element: Element) -> Iterator[str]:
    """The block-level Markdown of what is inside ``element``."""
    for child in element.children:
        if not isinstance(child, Element):
            if child.strip():
                yield child.strip()
            continue
        tag = child.tag
        if tag in HEADINGS or tag == "p":
            text = one_line(child)
            if text:
                yield f"{'#' * HEADINGS[tag]} {text}" if tag in HEADINGS else text
        elif tag in LISTS:
            lines = list(_list_lines(child))
            if lines:
                yield "\n".join(lines)
        elif tag == "table":
            lines = list(_table_lines(child))
            if lines:
                yield "\n".join(lines)
        elif tag == "pre":
            code = child.text().strip()
            if code:
                yield f"```\n{code}\n```"
        elif tag == "blockquote":
            quoted = "\n".join(blocks(child))
            if quoted:
                yield "\n".join("> " + line for line in quoted.splitlines())
        elif tag == "hr":
            yield "---"
        elif tag in INLINE:
            text = _phrase(child)
            if text:
                yield text
        elif tag != "br" and tag not in SKIPPED:
            yield from blocks(child)


def shingle_set(text: str | None, k: int = SHINGLE) -> frozenset[str]:
    words = (text or "").lower().split()
    return frozenset(" ".join(words[n : n + k]) for n in range(len(words) - k + 1))


def jaccard(a: frozenset[str], b: frozenset[str]) -> float:
    return len(a & b) / len(a | b) if a and b else 0.0


def distinct_blocks(found: Iterable[str], threshold: float = DEDUP_THRESHOLD) -> list[str]:
    """Blocks that are not nearly the same as a kept earlier one; short blocks always stay, blank ones go."""
    out, kept = [], []
    for block in found:
        if not block.strip():
            continue
        shingles = shingle_set(block) if len(block) >= DEDUP_LEAST_CHARS else frozenset()
        if shingles and any(jaccard(shingles, other) >= threshold for other in kept):
            continue
        if shingles:
            kept.append(shingles)
        out.append(block)
    return out


def to_markdown(html: str | None, keep_comments: bool = True, loose: bool = True, repeats: bool = False) -> str:
    """The page as Markdown blocks with blank lines between; an empty or null page gives the empty text.

    Blocks that are nearly the same as an earlier one of the page go, unless ``repeats`` is on.
    """
    root = parse(html, keep_comments, loose)
    _prune(root, STRIPPED)
    body = next((e for e in root.walk() if e.tag == "body"), root)
    found = blocks(body)
    text = "\n\n".join(found if repeats else distinct_blocks(found))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def links(html: str | None, base: str | None, same_host: bool = True) -> list[str]:
    """Targets of the page's anchors: absolute, without fragment, each once in document order, same host only.

    A page without URL keeps absolute targets only if ``same_host`` is off.
    """
    host = urlsplit(base or "").netloc
    found: dict[str, None] = {}
    for element in parse(html).walk():
        target = (element.attrs.get("href") or "").strip() if element.tag == "a" else ""
        if not target or target.lower().startswith(SKIPPED_SCHEMES):
            continue
        try:
            url = urldefrag(urljoin(base or "", target)).url
            there = urlsplit(url)
        except ValueError:
            continue
        if there.scheme in ("http", "https") and (not same_host or there.netloc == host):
            found[url] = None
    return list(found)


def title(html: str | None, loose: bool = True) -> str:
    return next((one_line(e) for e in parse(html, loose=loose).walk() if e.tag == "title"), "")
