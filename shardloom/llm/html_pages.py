"""One web page as a sequence of tokens: start and end tags by their path, and blocks of text."""

from __future__ import annotations

import html
import re

from xxhash import xxh64_intdigest

#: Comments, tags with their attributes, and other declarations. Every repeat is possessive or ends where it fails, so a page
#: is read once, however its quotes and brackets are left open.
_MARK = re.compile(
    r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))?+)*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""(?:^|(?<=[\s"'/]))(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"']+))?(?=[\s/]|\Z)""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Fixed names of HTML and of its common usage.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark nobr q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
RAW = {n: re.compile(rf"</{n}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for n in ("script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes")}
#: Elements that end an open one of the second list when they start.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that hold no article text.
CHROME = frozenset("head nav footer aside form noscript template button select datalist dialog menu svg math canvas audio video object applet label input".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words in a class or id that mark an element as no article text.
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer login masthead menu modal nav navbar "
    "navigation newsletter notice notices notification overlay pager pagination popup promo promotion recommended related reply replies respond search share sharing sidebar signup skip social "
    "sponsor sponsored subscribe subscription tags toolbar widget".split()
)
#: On the page's frame only these count, as its classes often name what it has beside the article.
FRAME = {"html": frozenset(), "body": frozenset(), "main": frozenset(), "article": frozenset("ad ads advert advertisement comment comments promo related reply sponsored".split())}
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 li pre dt dd td th".split())

ARTICLE, MAIN, TITLE = 1, 2, 4
#: A header is no article text unless it is an article's own.
HEADER = "header"
_END = 0x5851F42D4C957F2D
_kinds: dict = {}
_paths: dict = {}


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _kind(name: str, attributes: str) -> tuple[str, bool | str]:
    """(name with class and id, numbers of three digits or more, which tell pages and not places, as 0; whether the element is no article text, or HEADER)."""
    found = _kinds.get((name, attributes))
    if found is None:
        own = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)} if attributes.strip("/ ") else {}
        named = f"{own.get('class', '')} {own.get('id', '')}"
        words = {w.lower() for w in _WORD.findall(named)}
        chrome = name in CHROME or bool(words & FRAME.get(name, CHROME_WORDS)) or own.get("role", "").lower() in CHROME_ROLES or "hidden" in own
        chrome = chrome or "display:none" in own.get("style", "").replace(" ", "").lower() or own.get("aria-hidden", "").lower() == "true"
        chrome = chrome and name not in ("html", "body")
        header = name == "header" or ("header" in words and not words & {"article", "content", "entry", "post", "story"})
        found = (f"{name} {re.sub(r'[0-9]{3,}', '0', named)}", (chrome or (HEADER if header else False)) if name not in FRAME or chrome else False)
        if len(_kinds) > 50_000:
            _kinds.clear()
        _kinds[name, attributes] = found
    return found


def _path(parent: int, label: str) -> int:
    found = _paths.get((parent, label))
    if found is None:
        found = xxh64_intdigest(f"{parent}/{label}")
        if len(_paths) > 50_000:
            _paths.clear()
        _paths[parent, label] = found
    return found


class Page:
    """The tokens of a page, in order: `keys`, one signed 64-bit number each, and for blocks of text their place in `keys`, text,
    length of linked text, marks (within an article, within main, a first heading) and nearest element that is no paragraph.

    A tag's key stands for its path from the root, by names, classes and ids; a block's for its path and text. Inline elements, and
    whatever is no article text (see CHROME), give no blocks; scripts, styles and comments give nothing at all.
    """

    __slots__ = ("keys", "blocks", "parents")

    def __init__(self, source: str) -> None:
        self.keys: list[int] = []
        self.blocks: list[tuple[int, str, int, int, int]] = []
        self.parents: list[int] = [-1]
        self._read(source)

    def _read(self, source: str) -> None:
        # An open element: name, path, chrome, marks, number of the nearest element that is no paragraph.
        stack = [("", 0, False, 0, 0)]
        open_: dict[str, int] = {}
        held: list[str] = []
        link, linked = False, 0
        keys, search, at = self.keys, _MARK.search, 0

        def block() -> None:
            nonlocal linked
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                _, path, _, marks, node = stack[-1]
                self.blocks.append((len(keys), text, linked, marks, node))
                keys.append(_signed(xxh64_intdigest(text.encode("utf-8", "replace"), path)))
            linked = 0

        def pop() -> tuple:
            gone = stack.pop()
            open_[gone[0]] -= 1
            return gone

        while True:
            m = search(source, at)
            end = m.start() if m else len(source)
            if end > at and not stack[-1][2]:
                text = source[at:end]
                if "&" in text:
                    text = html.unescape(text)
                held.append(text)
                if link:
                    linked += len(text)
            if m is None:
                break
            at = m.end()
            name = m[2]
            if name is None:
                continue
            name = name.lower()
            inline = name in INLINE
            if m[1]:
                if name == "a":
                    link = False
                if not open_.get(name):
                    if not inline:
                        block()
                    continue
                if not inline:
                    block()
                while True:
                    gone = pop()
                    if gone[0] == name:
                        break
                keys.append(_signed(gone[1] ^ _END))
                continue
            if name in RAW:
                close = RAW[name].search(source, at)
                at = close.end() if close else len(source)
                continue
            if inline:
                if name == "br":
                    held.append(" ")
                    continue
                if name == "a":
                    link = True
                if not m[3] and not open_.get(name):
                    continue
                label, chrome = _kind(name, m[3])
                if name in VOID or not (chrome or open_.get(name)):
                    continue
            else:
                block()
                if name in VOID:
                    continue
                label, chrome = _kind(name, m[3])
                if stack[-1][0] == "p":
                    pop()
                while stack[-1][0] in SIBLINGS.get(name, ()):
                    pop()
            _, path, above, marks, node = stack[-1]
            if name == "article":
                above, marks = above and not open_.get("form"), marks | ARTICLE
            elif name == "main":
                above, marks = above and not open_.get("form"), marks | MAIN
            elif name == "h1":
                marks |= TITLE
            elif chrome == HEADER:
                chrome = not marks & (ARTICLE | MAIN)
            if not inline and name not in PARAGRAPHS:
                self.parents.append(node)
                node = len(self.parents) - 1
            path = _path(path, label)
            stack.append((name, path, above or chrome, marks, node))
            open_[name] = open_.get(name, 0) + 1
            keys.append(_signed(path))
        block()
