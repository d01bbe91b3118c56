"""HTML pages as blocks of text with the containers around them: one forward scan, linear in the page's length.

Tags are read as browsers do: a tag without its end swallows the rest, quoted values may hold any sign, script and the
like hold raw text, blocks end open paragraphs, list items and cells end their like, an end tag doesn't reach out of a
table cell. Paths of containers are chained 64-bit hashes of tag and class names, digits left out, so that depth costs
nothing; whether a tag is open is looked up by its name, so that stray end tags don't either.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field

TAG_NAME = re.compile(r"[^\s/>]+")
SIMPLE_END = re.compile(r"[^>\"']*+>")
ATTRIBUTE = re.compile(r"[\s/]*+(?:(>)|([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"?|'([^']*+)'?|([^\s>\"'][^\s>]*+)?))?)")
COMMENT_END = re.compile(r"--!?>")
RAW_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in "script style title textarea iframe xmp noembed noframes".split()}
WANTED = frozenset(("class", "id", "role", "hidden", "aria-hidden", "style"))

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math q rp rt ruby s samp small span strike strong sub sup svg time tt u var img wbr nobr mi mn mo ms mrow msup msub mfrac mtext".split())
SKIPPED = frozenset("nav header footer aside form button menu dialog head fieldset audio video canvas map svg select template object noscript".split())
CONTAINERS = frozenset("body article main section div td li blockquote center dd".split())
#: What an end tag or a paragraph's end doesn't reach beyond.
SCOPES = frozenset("table td th caption button object template foreignobject".split())
TABLE_PARTS = frozenset("table td th tr tbody thead tfoot caption".split())
#: Open elements that a start tag ends, unless the second stands between.
ENDS_LIKE = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("table",)), "th": (("td", "th"), ("table",)), "option": (("option",), ("select",))}
#: Start tags that can't stand in a drawing or a list of choices, and so end one that was left open.
BREAKS_OUT = frozenset("article blockquote body div dl h1 h2 h3 h4 h5 h6 hr li main ol p pre section table ul".split())
IN_HEAD = frozenset("head base link meta script style title noscript template".split())

#: Words of a class, id or role. Readers' comments and adverts are never the article.
NEVER = r"ads?|adverts?|advertisement|advertising|adsense|sponsor(?:ed)?|comments?|commentlist|disqus|replies|respond|reply"
#: These aren't, unless the page has its title or nearly all of its text inside.
HARDLY = r"promo(?:tion)?|side-?bar|navbar|nav|navigation|breadcrumbs?|foot(?:er)?|notices?|cookies?|consent|gdpr|newsletter|share|sharing|social|related|recommended|pagination|pager|skip-link|menu|masthead|complementary"
#: These may be: the host's pages tell, by whether they all say the same there.
PERHAPS = r"header|banner|alert|popup|pop-up|modal|overlay|subscribe|subscription|signup|login|widget|toolbar|disclaimer|copyright|paywall|toc|contentinfo|search"
MARKS = tuple(re.compile(rf"(?:^|[\s_-])(?:{words})\d*(?:$|[\s_-])", re.I) for words in (PERHAPS, HARDLY, NEVER))
#: What says that a page has such parts, rather than being one.
LAYOUT = re.compile(r"\b(?:has|with|without|no|is)[-_][\w-]+", re.I)
#: An article element of these classes isn't the page's article.
OTHER_ARTICLE = re.compile(r"(?:^|[\s_-])(?:ads?|advert|sponsored|promo|comments?|reply|replies|related|teaser)\d*(?:$|[\s_-])", re.I)
MAIN_HINT = re.compile(r"(?:^|[\s_-])(?:article|content|post|entry|story|main|body|text)(?:$|[\s_-])", re.I)
#: A part of HARDLY is the article if it has this many times the rest of the page's text.
NEARLY_ALL = 9


@dataclass
class Page:
    """Blocks of text in page order, the containers around them, and the elements whose names mark what mostly isn't the article."""

    blocks: list[tuple[str, int, int, int]] = field(default_factory=list)  # text, link characters, container, innermost mark
    parents: list[int] = field(default_factory=lambda: [-1])
    names: list[str] = field(default_factory=lambda: ["html"])
    paths: list[int] = field(default_factory=lambda: [0])
    weights: list[float] = field(default_factory=lambda: [0.5])
    mark_parents: list[int] = field(default_factory=list)
    mark_kinds: list[int] = field(default_factory=list)
    mark_paths: list[int] = field(default_factory=list)
    titled: set[int] = field(default_factory=set)  # marks with a title inside

    def label(self, container: int, last: int = 6) -> str:
        """The last steps of a container's path, to be read by people."""
        steps = []
        while container >= 0 and len(steps) < last:
            steps.append(self.names[container])
            container = self.parents[container]
        return "/".join(reversed(steps))


_names: dict[tuple[str, str], str] = {}


def _name(tag: str, classes: str) -> str:
    key = (tag, classes)
    if key not in _names:
        if len(_names) > 50_000:
            _names.clear()
        words = sorted({w for w in re.sub(r"\d+", "", classes).lower().split() if len(w) > 1})
        _names[key] = ".".join([tag, *words])
    return _names[key]


def _step(path: int, name: str) -> int:
    from xxhash import xxh64_intdigest

    h = xxh64_intdigest(name, path & 0xFFFFFFFFFFFFFFFF)
    return h - (1 << 64) if h >> 63 else h


def _mark(tag: str, named: str) -> int:
    """3 to 1 for NEVER, HARDLY, PERHAPS; 0 for none."""
    if tag in ("html", "body", "main", "h1") or not named.strip():
        return 0
    plain = LAYOUT.sub(" ", named)
    if tag == "article":
        return 3 if OTHER_ARTICLE.search(plain) else 0
    return next((n + 1 for n in (2, 1, 0) if MARKS[n].search(plain)), 0)


class _Parser:
    """The stack of open elements of one page."""

    def __init__(self, page: Page):
        self.page = page
        # Of each open element: tag, path, whether skipped, whether a link, container, mark.
        self.stack: list[tuple[str, int, bool, bool, int, int]] = [("html", 0, False, False, 0, -1)]
        self.open: dict[str, list[int]] = {"html": [0]}
        self.blocks, self.scopes = [0], [-1]
        self.buffer: list[str] = []
        self.linked = 0

    def at(self, *tags: str) -> int:
        """Where the innermost open one of the tags stands, or -1."""
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=-1)

    def flush(self) -> None:
        if self.buffer:
            text = " ".join("".join(self.buffer).split())
            if text:
                top = self.stack[-1]
                self.page.blocks.append((text, self.linked, top[4], top[5]))
            self.buffer.clear()
        self.linked = 0

    def close_to(self, k: int) -> None:
        if self.blocks[-1] >= k:
            self.flush()
        while len(self.stack) > k:
            tag = self.stack.pop()[0]
            self.open[tag].pop()
            if tag not in INLINE:
                self.blocks.pop()
            if tag in SCOPES:
                self.scopes.pop()

    def text(self, text: str) -> None:
        top = self.stack[-1]
        if not top[2]:
            text = entities.unescape(text) if "&" in text else text
            self.buffer.append(text)
            if top[3]:
                self.linked += len(text)

    def end(self, tag: str) -> None:
        k = self.at(tag)
        if k > 0 and (k > self.blocks[-1] if tag in INLINE and tag != "svg" else tag in TABLE_PARTS or k >= self.scopes[-1]):
            self.close_to(k)
        elif tag == "br":
            self.flush()

    def start(self, tag: str, attributes: dict[str, str]) -> None:
        head = self.at("head")
        if head > 0 and tag not in IN_HEAD and tag not in INLINE:
            self.close_to(head)
        if tag in BREAKS_OUT:
            for k in (self.at("svg"), self.at("select")):
                if k > 0 and k > self.at("foreignobject"):
                    self.close_to(k)
        if tag not in INLINE:
            p = self.at("p")
            if p > self.scopes[-1]:
                self.close_to(p)
            if tag in ENDS_LIKE:
                likes, between = ENDS_LIKE[tag]
                k = self.at(*likes)
                if k > self.at(*between):
                    self.close_to(k)
            self.flush()
        elif tag == "a" and self.at("a") > self.blocks[-1]:
            self.close_to(self.at("a"))
        if tag in VOID or tag in ("html", "body") and self.open.get(tag):
            return
        _, path, skip, link, container, mark = self.stack[-1]
        classes = attributes.get("class", "")
        if not skip:
            style = attributes.get("style", "")
            skip = tag in SKIPPED or "hidden" in attributes or attributes.get("aria-hidden") == "true" or "none" in style and "display:none" in style.replace(" ", "").lower()
        if not skip:
            page = self.page
            named = f"{classes} {attributes.get('id', '')} {attributes.get('role', '')}" if attributes else ""
            if tag not in INLINE:
                name = _name(tag, classes)
                path = _step(path, name)
                if tag in CONTAINERS:
                    page.parents.append(container)
                    container = len(page.paths)
                    page.paths.append(path)
                    page.names.append(name)
                    page.weights.append(4.0 if tag == "article" else 3.0 if tag == "main" or attributes.get("role") == "main" else 1.5 if named and MAIN_HINT.search(named) else 1.0)
            kind = _mark(tag, named) if named else 0
            if kind:
                page.mark_parents.append(mark)
                mark = len(page.mark_kinds)
                page.mark_kinds.append(kind)
                page.mark_paths.append(path if tag not in INLINE else _step(path, _name(tag, classes)))
            if tag in ("h1", "main"):
                k = mark
                while k >= 0 and k not in page.titled:
                    page.titled.add(k)
                    k = page.mark_parents[k]
        self.open.setdefault(tag, []).append(len(self.stack))
        if tag not in INLINE:
            self.blocks.append(len(self.stack))
        if tag in SCOPES:
            self.scopes.append(len(self.stack))
        self.stack.append((tag, path, skip, link or tag == "a", container, mark))


def parse(raw: str) -> Page:
    """The blocks of a page."""
    page = Page()
    p = _Parser(page)
    at, size = 0, len(raw)
    while at < size:
        lt = raw.find("<", at)
        if lt < 0:
            p.text(raw[at:])
            break
        if lt > at:
            p.text(raw[at:lt])
        sign = raw[lt + 1 : lt + 2]
        close = sign == "/"
        first = raw[lt + 2 : lt + 3] if close else sign
        if not (first.isascii() and first.isalpha()):
            if sign == "!" and raw.startswith("--", lt + 2):
                found = COMMENT_END.search(raw, lt + 2)
                at = found.end() if found else size
            elif sign in ("!", "?") and sign or close and first:
                at = raw.find(">", lt) + 1 or size
            else:
                p.text("<")
                at = lt + 1
            continue
        name = TAG_NAME.match(raw, lt + 1 + close)
        tag, at = name[0].lower(), name.end()
        attributes: dict[str, str] = {}
        if raw.startswith(">", at):
            at += 1
        elif close and (m := SIMPLE_END.match(raw, at)):
            at = m.end()
        else:
            while True:
                m = ATTRIBUTE.match(raw, at)
                if m is None or m.end() == at:
                    at = -1
                    break
                at = m.end()
                if m[1]:
                    break
                key = m[2].lower()
                if key in WANTED and key not in attributes:
                    attributes[key] = m[3] or m[4] or m[5] or ""
            if at < 0:
                break  # no end: browsers drop what follows as well
        if close:
            p.end(tag)
            continue
        if tag in RAW_ENDS and p.at("svg") < 0:
            if tag not in ("script", "style"):
                p.start("noscript", {})
                p.close_to(len(p.stack) - 1)
            found = RAW_ENDS[tag].search(raw, at)
            at = found.start() if found else size
            continue
        p.start(tag, attributes)
    p.close_to(1)
    p.flush()
    return page


def dropped_marks(page: Page, repeated: frozenset = frozenset()) -> list[bool]:
    """Which marks aren't the article; repeated: paths of PERHAPS at which the host's pages say the same."""
    chars = [0] * len(page.mark_kinds)
    total = 0
    for text, _, _, mark in page.blocks:
        total += len(text)
        if mark >= 0:
            chars[mark] += len(text)
    for k in range(len(chars) - 1, -1, -1):
        if page.mark_parents[k] >= 0:
            chars[page.mark_parents[k]] += chars[k]
    found: list[bool] = []
    for k, kind in enumerate(page.mark_kinds):
        above = page.mark_parents[k]
        if above >= 0 and found[above] or kind == 3:
            found.append(True)
        elif kind == 2:
            found.append(not (k in page.titled or chars[k] >= NEARLY_ALL * max(1, total - chars[k])))
        else:
            found.append(page.mark_paths[k] in repeated)
    return found
