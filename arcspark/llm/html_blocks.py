"""The visible blocks of an HTML page, and what its markup says of them.

A page is read into a tree: elements whose end tag HTML lets one omit (p, li, dd, table
parts, options, head) are closed where the next element implies it, end tags without a start
are ignored, and elements deeper than ``DEEPEST`` count as part of that one. Then every run
of text gets two marks: whether it lies in the marked article, and whether an element around
it is declared to hold no main text. A block ends at the tags of block elements and wherever
one of the marks changes, so that noise inside a paragraph is cut out of it.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

#: Elements, roles and names that mark what isn't main text.
NO_CONTENT = frozenset("nav header footer aside form button select option textarea fieldset menu dialog search noscript template svg iframe object canvas title head".split())
NO_CONTENT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "sidebar menu menus nav navbar navigation breadcrumb breadcrumbs masthead footer comment comments "
    "disqus share sharing social related recommended newsletter subscribe subscription popup modal overlay pagination pager login signup".split()
)
#: Names that are judged as parts of longer names only outside the article, where an ``entry-header`` can't be.
WEAK_NAMES = frozenset("header form widget toolbar aside reply replies".split())
#: Parts of a longer name that, beside one of the above, leave it a name of the layout; inside the article it
#: counts only if all its parts are such, as ``related-posts`` is and ``ad-hoc-analysis`` isn't.
BESIDE = frozenset(
    "area areas article articles bar bars block blocks body bottom box boxes button buttons card cards column container content entry feed group holder icon icons inner item items "
    "left link links list lists main news outer page pages panel post posts right row section sections slot stories story text thread title top unit units wrap wrapper zone".split()
)
#: Elements whose id may name them; on headings, paragraphs and the like it names what they say.
CONTAINERS = frozenset("article aside center details div dl figure footer form header hgroup iframe main menu nav ol section table ul".split())
#: Words that make the name after them a mark of the layout.
LAYOUT = frozenset("no has with without is not".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that may stand in a head.
IN_HEAD = frozenset("head meta link title script style base noscript template".split())
#: Blocks that don't end a paragraph before them.
IN_PARAGRAPH = frozenset("br option optgroup caption tbody td tfoot th thead tr legend html head body title".split())
#: Start tag -> what it closes, and where the search for that ends.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th", "caption"}, {"tr", "table"}), "th": ({"td", "th", "caption"}, {"tr", "table"}),
    "tr": ({"tr", "caption"}, {"tbody", "thead", "tfoot", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
    "body": ({"head"}, {"body"}),
}
SCOPE = frozenset("html table td th caption template object".split())
TABLE_PARTS = frozenset("tr tbody thead tfoot td th caption".split())
DEEPEST = 512

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|textarea|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[/!?a-zA-Z][^>]*+>",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|style|hidden)(?![\w-])(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_PARTS = re.compile(r"[^a-z0-9]+")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")

#: How an element is declared to hold no main text: not at all, by a name only, or by what it is.
CLEAR, NAMED, FIRM = 0, 1, 2


def _named(value: str, inside: bool, whole: bool) -> bool:
    """Whether one of the names in a class or id marks noise; ``whole``: names count only as they stand."""
    for name in value.split():
        if name in NAMES or name in WEAK_NAMES and (whole or not (inside and name == "header")):
            return True
        parts = _PARTS.split(name)
        if whole:
            if len(parts) > 1 and parts[0] in ("comment", "reply") and parts[1].isdigit():
                return True
            continue
        if inside and not all(part in NAMES or part in WEAK_NAMES or part in BESIDE or part in LAYOUT or part.isdigit() or not part for part in parts):
            continue
        if len(parts) > 1 and any(
            (part in NAMES or part in WEAK_NAMES and not inside) and not (k and parts[k - 1] in LAYOUT)
            for k, part in enumerate(parts)
        ):
            return True
    return False


def declared_noise(tag: str, attributes: str, inside: bool = False) -> int:
    """``CLEAR``, ``NAMED`` or ``FIRM``; ``inside``: the element lies in a marked article."""
    found = FIRM if tag in NO_CONTENT else CLEAR
    if found or not attributes or tag in ("html", "body"):
        return found
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        value, name = (a or b or c).lower(), name.lower()
        if name == "hidden" or name == "style" and _UNSEEN.search(value) or name == "role" and value.strip() in NO_CONTENT_ROLES:
            return FIRM
        if (name == "class" or name == "id" and tag in CONTAINERS) and _named(value, inside, tag in MAIN):
            found = NAMED
    return found


def _is_main(tag: str, attributes: str) -> bool:
    return tag in MAIN or "role" in attributes and any(n.lower() == "role" and (a or b or c).lower().strip() == "main" for n, a, b, c in _ATTRIBUTE.findall(attributes))


def _markup(page: str) -> Iterator[re.Match]:
    """Tags, comments and elements without content, in order. What has no ``>`` ahead is looked at once, not from each ``<``."""
    last, at = page.rfind(">"), page.find("<")
    while at >= 0:
        if at > last and not page.startswith("<!--", at):
            at = page.find("<!--", at)
            continue
        m = _MARKUP.match(page, at)
        if m:
            yield m
        at = page.find("<", m.end() if m else at + 1)


class Tree:
    """``tags``, ``attributes``, ``above`` (parent) and ``shut`` (by its own end tag) of each element; ``pieces`` of text."""

    def __init__(self, page: str) -> None:
        self.tags, self.attributes, self.above, self.shut = [""], [""], [-1], [True]
        self.pieces: list[tuple[int, int, int, int]] = []  # block, element, start, end
        self._open, self._head, self._held = [0], False, Counter()
        block = at = 0
        for m in _markup(page):
            if m.start() > at:
                self.pieces.append((block, self._open[-1], at, m.start()))
            at = m.end()
            if not m[3]:
                continue
            tag, attributes = m[3].lower(), m[4]
            block += tag in BLOCKS
            if m[2]:
                self._end(tag)
            else:
                self._imply(tag)
                if tag not in VOID and not attributes.endswith("/") and len(self._open) < DEEPEST:
                    self._open.append(len(self.tags))
                    self.tags.append(tag)
                    self.attributes.append(attributes)
                    self.above.append(self._open[-2])
                    self.shut.append(False)
                    self._held[tag] += 1
                    self._head |= tag == "head"
        if at < len(page):
            self.pieces.append((block, self._open[-1], at, len(page)))

    def _close(self, wanted, stops) -> int | None:
        """Close the innermost open element of these tags, if none of ``stops`` is nearer; its number."""
        if not any(self._held[tag] for tag in wanted):
            return None
        for k in range(len(self._open) - 1, 0, -1):
            tag = self.tags[self._open[k]]
            if tag in wanted:
                found = self._open[k]
                self._held.subtract(self.tags[i] for i in self._open[k:])
                del self._open[k:]
                return found
            if tag in stops:
                return None
        return None

    def _imply(self, tag: str) -> None:
        if tag in BLOCKS and tag not in IN_PARAGRAPH:
            self._close({"p"}, SCOPE | {"button"})
        if tag in IMPLIED:
            self._close(*IMPLIED[tag])
        if self._head and tag not in IN_HEAD:
            self._close({"head"}, ())
            self._head = False

    def _end(self, tag: str) -> None:
        if tag in ("body", "html"):
            found = self._close({tag}, ())
        elif tag in HEADINGS:
            found = self._close(HEADINGS, SCOPE)
        elif tag in TABLE_PARTS or tag == "table":
            found = self._close({tag}, {"table", "template"} - {tag})
        elif tag == "li":
            found = self._close({tag}, SCOPE | {"ul", "ol"})
        elif tag in BLOCKS or tag in NO_CONTENT:
            found = self._close({tag}, SCOPE - {tag})
        else:
            found = self._close({tag}, BLOCKS)
        if found is not None:
            self.shut[found] = True


def _marks(tree: Tree, lenient: bool) -> tuple[list[bool], list[bool], bool]:
    """For each element whether it is in the article and in noise, and whether an article is free of noise.

    ``lenient``: what is noise by a name or as a form only, but has the article in it, isn't.
    """
    n = len(tree.tags)
    is_main = [_is_main(t, a) for t, a in zip(tree.tags, tree.attributes, strict=True)]
    holds = [False] * n
    if lenient:
        for i in range(n - 1, 0, -1):
            if is_main[i] or holds[i]:
                holds[tree.above[i]] = True
    inside, cause, free = [False] * n, [0] * n, False  # cause: the outermost noise around an element, 0 for none
    for i in range(1, n):
        up, tag = tree.above[i], tree.tags[i]
        inside[i], cause[i] = inside[up], cause[up]
        own = declared_noise(tag, tree.attributes[i], inside[up])
        if own and holds[i] and (own == NAMED or tag == "form"):
            own = CLEAR
        if is_main[i] and not own:
            if cause[i] and not tree.shut[cause[i]]:
                cause[i] = 0  # an article can't be inside what was left open before it
            if not cause[i]:
                inside[i] = free = True
        if cause[i] and inside[i] and tag in HEADINGS and tree.tags[cause[i]] == "header":
            cause[i] = 0  # an article's own header holds its title
        elif own and not cause[i]:
            cause[i] = i
    return inside, [bool(c) for c in cause], free


def blocks(page: str) -> list[tuple[str, bool, bool]]:
    """``(text, in the marked article, declared noise)`` of every visible block, in page order."""
    tree = Tree(page)
    inside, noise, free = _marks(tree, False)
    if not free:
        inside, noise, _ = _marks(tree, True)
    out: list[tuple[str, bool, bool]] = []
    held: list[str] = []
    now: tuple | None = None

    def flush() -> None:
        text = " ".join("".join(held).split())
        if text:
            out.append((text, now[1], now[2]))
        held.clear()

    for block, i, a, b in tree.pieces:
        marks = (block, inside[i], noise[i])
        if marks != now:
            if held:
                flush()
            now = marks
        piece = page[a:b]
        held.append(entities.unescape(piece) if "&" in piece else piece)
    if held:
        flush()
    return out
