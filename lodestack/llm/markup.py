"""HTML as lines: what a page shows, block by block, and where each block stands.

A page is read tag by tag, once, from left to right. A line is the text of one block (a paragraph, heading, list item, table
row and so on) with character references decoded and white space folded. `place` tells where the line stands: in what the page
itself marks as surroundings (OUT), as its article (ARTICLE), as its content by a class or id (CONTENT), or in none of these (OPEN).
"""

from __future__ import annotations

import html
import re

OUT, OPEN, CONTENT, ARTICLE = range(4)

# Fixed values of the HTML standard: elements without an end, those whose text is no markup, and those that begin a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe noembed noframes xmp svg".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody tfoot thead tr ul".split()
)
#: A start tag closes open elements of the first set, but for those that lie outside an element of the second.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

#: Elements, roles, and words of class or id that mark surroundings.
OUTER = frozenset("nav footer aside form button select datalist dialog menu object audio video canvas map search".split())
ROLES_OUT = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
WORDS_OUT = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices sidebar menu navbar nav navigation breadcrumb breadcrumbs footer masthead topbar comment comments disqus respond share sharing social related recommended newsletter subscribe subscription signup login popup modal overlay toolbar widget widgets pagination pager skip".split()
)
WORDS_IN = frozenset("article content post entry story".split())

TAG = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?>[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+)>""", re.S)
ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden|style|itemprop)(?![^\s=>/])(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def _marks(name: str, told: str, inside: int) -> int | None:
    """The place that a start tag gives to what is in it; None if it says nothing."""
    found = {a.lower(): x or y or z for a, x, y, z in ATTRIBUTE.findall(told)} if told and not told.isspace() else {}
    role = found.get("role", "").lower()
    if name in OUTER or role in ROLES_OUT or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", ""), re.I):
        return OUT
    words = {w.lower() for w in WORD.findall(f"{found.get('class', '')} {found.get('id', '')}")} if found else set()
    if name not in ("html", "body") and words & WORDS_OUT:
        return OUT
    if (name == "header" or "header" in words) and inside < CONTENT and name not in ("html", "body"):
        return OUT
    if name == "article" or role in ("main", "article") or found.get("itemprop") == "articleBody":
        return ARTICLE
    if name == "main" or (name in ("div", "section", "td") and words & WORDS_IN):
        return CONTENT
    return None


def lines(page: str | None) -> list[tuple[str, int]]:
    """(text, place) of each line of a page that has text, in order."""
    page = page or ""
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, int, bool, int]] = []  # name, place, whether a form alone puts it out, place of the innermost block
    count: dict[str, int] = {}
    held: list[str] = []
    place, soft, at, end = OPEN, False, 0, page.rfind(">") + 1
    of_block = OPEN  # the place of the innermost block; inline parts that are OUT in a block that is not are left out of its line

    def flush() -> None:
        if held:
            text = SPACE.sub(" ", "".join(held)).strip(" ")
            held.clear()
            if text:
                out.append((text, of_block))

    def cut(n: int) -> None:
        nonlocal place, soft, of_block
        for name, _, _, _ in stack[n:]:
            count[name] -= 1
        del stack[n:]
        _, place, soft, of_block = stack[-1] if stack else ("", OPEN, False, OPEN)

    while at < len(page):
        m = TAG.search(page, at, end) if at < end else None
        if (m.start() if m else len(page)) > at:
            text = page[at : m.start() if m else len(page)]
            if place != OUT or of_block == OUT:
                held.append(html.unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if name == "br" or name in ("td", "th"):
            held.append(" ")
        if m[1]:
            if name in BLOCK:
                flush()
            if count.get(name):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        cut(i)
                        break
                    if name not in BLOCK and stack[i][0] in BLOCK:  # an inline end tag closes no block
                        break
            continue
        if name in RAW:
            found = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            at = found.start() if found else len(page)
            if found:
                at = (page.find(">", at) + 1) or len(page)
            continue
        if name in BLOCK:
            flush()
            if count.get("p"):
                cut(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == "p"))
        if name in IMPLIED:
            closed, bound = IMPLIED[name]
            if any(count.get(x) for x in closed):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in bound:
                        break
                    if stack[i][0] in closed:
                        cut(i)
        if name in VOID:
            continue
        mark = _marks(name, m[3], place)
        inner, soft_inner = place, soft
        if place == OUT:
            if soft and mark in (ARTICLE, CONTENT):  # a page wrapped into one form
                inner, soft_inner = mark, False
            elif soft and mark == OUT and name != "form":
                soft_inner = False
        elif mark is not None:
            inner, soft_inner = (OUT if mark == OUT else max(place, mark)), mark == OUT and name == "form"
        if name in BLOCK:
            of_block = inner
        elif inner != OUT:
            inner = place
        stack.append((name, inner, soft_inner, of_block))
        count[name] = count.get(name, 0) + 1
        place, soft = inner, soft_inner
    flush()
    return out
