"""Main-text extraction from HTML by tree scoring.

A page is read into a tree (unclosed and stray tags as browsers take them), in time linear in its length whatever is broken. Text
blocks give points - one, one for each comma, one for each hundred characters up to three - to their parent in full and to every
further ancestor by half of what the one below gets; containers have a starting score by tag, and the sum is discounted by link
density. The best container, widened to the article or main element around it, and those of its siblings that score
well or are plain text blocks are kept. Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles
and reader comments are left out by element, role, or a name of their class or id. Of the header of an article, headings and
paragraphs stay.
A name tells what a block is if its other words only tell a shape or a place (`comments`, `comment-list`, `site-footer`) or its last
word is an advert's or a menu's (`inline-ad`): the block goes, unless it holds more than half of the page's text and its h1, main or
only article, or the only paragraphs. Reader comments go whatever their length, but for a block that holds more than half of the text
and the h1 or main. A name with a word of its own (`related-work`, `code-comments`) only lowers the score, and drops what is half
links. A name that tells a state (`has-sidebar`) drops nothing; `comments-open` alone is a comment block where paragraphs stand
elsewhere. Headings and rows of tables are never dropped by name, nor spans of code. A form or fieldset goes, with its labels, but for
one around most of the text that has the h1, main or only article, or the only paragraphs and a hundred characters of them for each field.
If nothing is left, names but those of comments are not looked at; elements and roles always are.

Edge cases: a null, empty or text-free page gives "". Plain text without tags is one block. Broken markup, unclosed
comments, scripts and quotes end at the end of the page; a tag with an unclosed quote ends at its next >. Rows are independent; repeated rows
are read one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
#: Elements whose content is no markup, with their ends.
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in "script style noscript template svg iframe textarea select canvas title".split()}
_ATTR = re.compile(r"(?<![a-zA-Z-])([a-zA-Z-]++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
_WRAP = frozenset("form fieldset".split())
_HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())
_PLAIN = _HEADS | frozenset("p pre blockquote ul ol dl table figure #text".split())
_BASE = {"article": 25.0, "main": 20.0, "section": 5.0, "div": 5.0, "pre": 3.0, "td": 3.0, "blockquote": 3.0}
_LEAD = _HEADS | {"p"}
_PROSE = frozenset("p pre blockquote".split())
#: Words of a class or id that mark what is not the article (fixed values).
_NOT = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup sidebar widget menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar comment comments disqus reply replies respond share sharing social related recommended recommendations pagination pager toolbar login search skip".split()
)
_TALK = frozenset("comment comments disqus reply replies respond".split())
#: Words that tell what a block is if a name ends with them.
_LAST = frozenset("ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation breadcrumb breadcrumbs sidebar footer newsletter pagination pager toolbar popup modal".split())
#: Words of a shape, a place or an owner, which tell nothing of the content.
_SHAPE = frozenset(
    "list section body box wrapper wrap area container block bar button buttons link links item items inner outer thread feed group row col column panel slot unit zone holder module widgets region icon icons count title text label message author meta form copyright posts articles stories bottom top left right site page post article blog user users reader readers entry global mobile desktop sticky fixed primary secondary main children tree root stream".split()
)
_OWN_HEADER = frozenset("article post entry story header".split())
_STATE = frozenset("has with without no not is open opened closed enabled disabled".split())
#: Elements that no name drops.
_NAMELESS = _HEADS | frozenset("html body main tr th td thead tbody tfoot caption".split())
_OUT = frozenset("button select textarea head annotation annotation-xml nav aside footer menu dialog".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_WALL = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}


#: What the attributes say of an element.
WORD, STATE, NAME, FORM, TALK, ROLE, HIDDEN = range(1, 8)


def _marked(tag: str, attrs: str) -> int:
    """0 where nothing is said: a name with such a word, a state of comments alone, a whole name, comments, a role, hidden."""
    low = attrs.lower()
    if "class" not in low and "id" not in low and "role" not in low and "hidden" not in low and "style" not in low:
        return 0
    if re.search(r"\bhidden\b(?!\s*=\s*[\"']?(?:false|until))|display\s*:\s*none", re.sub(r"\"[^\"]*\"|'[^']*'", lambda m: m[0] if "display" in m[0] else "", low)):
        return HIDDEN
    mark, state, other = 0, False, False
    for m in _ATTR.finditer(low):
        v = m[2] or m[3] or m[4] or ""
        if m[1] == "role" and v.strip() in _ROLES:
            return ROLE
        if m[1] in ("class", "id") and tag not in _NAMELESS:
            for name in v.split():
                order = [w for w in _SPLIT.split(name) if w and not w.isdigit()]
                words = frozenset(order)
                if not words & _STATE:
                    other |= not words <= _NOT | _SHAPE
                    if not words & _NOT or words <= _OWN_HEADER and "header" in words and len(words) > 1:
                        continue
                    whole = words <= _NOT | _SHAPE or order[-1] in _LAST
                    mark = max(mark, WORD if not whole else TALK if words & _TALK else NAME)
                elif words & _TALK and words <= _NOT | _STATE | _SHAPE:
                    state = True
    return mark or (STATE if state and not other else 0)


def tags_of(page: str) -> Iterator[tuple[int, int, str, str]]:
    """Start, end, name and attributes of each tag; a name begins with / at an end tag and is empty where there is nothing to
    look at (comments and the content of scripts). Each character is looked at a bounded number of times: where a tag's quotes
    lead is kept for every opening quote, since a later tag that meets the same quote ends at the same place."""
    ends: dict[int, int] = {}  # opening quote -> the > behind it, -1 if there is none
    last = page.rfind(">")

    def end_of(at: int) -> int:
        seen = []
        while True:
            m = _STOP.search(page, at)
            if m is None:
                found = -1
                break
            at = m.start()
            if m[0] == ">":
                found = at
                break
            if at in ends:
                found = ends[at]
                break
            seen.append(at)
            at = page.find(m[0], at + 1) + 1
            if not at:
                found = -1
                break
        for k in seen:
            ends[k] = found
        return found

    at = page.find("<")
    while at >= 0:
        end, name, attrs = -1, "", ""
        c = page[at + 1 : at + 2]
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = end + 3 if end >= 0 else len(page)
        elif at < last and (m := _NAME.match(page, at + 1 + (c == "/"))):
            end = end_of(m.end())
            end = end if end >= 0 else page.find(">", m.end())
            name, attrs, end = m[0].lower(), page[m.end() : end], end + 1
            if c == "/":
                name = "/" + name
            elif name in _RAW:
                m = _RAW[name].search(page, end)
                name, end = "", m.end() if m else len(page)
        elif at < last and c in ("!", "?", "/"):
            end = page.find(">", at) + 1
        if end < 0:
            at = page.find("<", at + 1)
            continue
        yield at, end, name, attrs
        at = page.find("<", end)


def extract(page: str | None) -> str:
    """The main text; where the names leave nothing, without looking at them."""
    return (_extract(page, True) or _extract(page, False)) if page else ""


def _extract(page: str, names: bool) -> str:
    tags, parent, out, named = ["#root"], [-1], [False], [0]  # by node; out: not part of the article; named: perhaps so, by its name
    fields = [0]  # by node: labels and inputs of forms
    head = [0]  # by node: 1 in an article's header, 2 in a heading or paragraph of it
    blocks: list[tuple[int, str, int]] = []  # node, text, characters in links
    stack, outer = [0], [0]  # open nodes; places in the stack of the open blocks
    opened: dict[str, int] = {}
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                blocks.append((stack[outer[-1]], text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def close(k: int) -> None:
        for n in stack[k:]:
            opened[tags[n]] -= 1
        del stack[k:]
        while outer[-1] >= k:
            outer.pop()

    def words(t: str) -> None:
        nonlocal linked
        if not out[stack[-1]]:
            t = _html.unescape(t) if "&" in t else t
            parts.append(t)
            if opened.get("a"):
                linked += len(t.strip())

    at = 0
    for start, end, tag, attrs in tags_of(page):
        if start > at:
            words(page[at:start])
        at = end
        if not tag:
            continue
        if tag[0] == "/":
            tag = tag[1:]
            if tag in _BLOCK:
                flush()
            if opened.get(tag):
                k = len(stack) - 1
                while tags[stack[k]] != tag:
                    k -= 1
                close(k)
            continue
        if tag == "br":
            parts.append(" ")
        if tag in _BLOCK:
            flush()
            if tag not in ("html", "body") and tags[stack[outer[-1]]] == "p":
                close(outer[-1])
        if tag in _CLOSES and any(opened.get(t) for t in _CLOSES[tag]):
            for k in reversed(outer):
                if tags[stack[k]] in _CLOSES[tag]:
                    close(k)
                    break
                if tags[stack[k]] in _WALL[tag] or not k:
                    break
        form = opened.get("form") or opened.get("fieldset")
        if form and (tag == "label" or tag == "input" and not re.search("hidden|submit", attrs, re.I)):
            fields[stack[outer[-1]]] += 1
        if tag in _VOID or attrs.endswith("/") and tag not in _BLOCK:
            continue
        up = stack[-1]
        mark = _marked(tag, attrs) if tag not in ("html", "body", "main") else 0
        if mark < TALK and not names or mark < ROLE and (opened.get("pre") or opened.get("code")):
            mark = 0
        if tag in _WRAP:
            mark = max(mark, FORM)
        by_name = mark if 0 < mark < ROLE and tag in _BLOCK and tag != "header" and not out[up] else 0
        bad = out[up] or tag in _OUT or mark >= NAME and not by_name or bool(form) and tag in ("label", "legend")
        if tag == "header":
            bad = out[up] or not (opened.get("article") or opened.get("main"))
        inside = head[up] or int(tag == "header")
        tags.append(tag)
        parent.append(up)
        out.append(bad)
        named.append(0 if bad else by_name)
        fields.append(0)
        head.append(2 if inside and tag in _LEAD else inside)
        opened[tag] = opened.get(tag, 0) + 1
        stack.append(len(tags) - 1)
        if tag in _BLOCK:
            outer.append(len(stack) - 1)
    if at < len(page):
        words(page[at:])
    flush()
    weight = [1.0] * len(tags)
    if any(named):
        covered = [False] * len(tags)
        for n in range(1, len(tags)):
            covered[n] = covered[parent[n]] or named[n] > WORD
        held, para, link, field = [0] * len(tags), [0] * len(tags), [0] * len(tags), fields[:]
        titled, articles = [t in ("h1", "main") for t in tags], [int(t == "article" and not k) for t, k in zip(tags, named, strict=True)]
        rest = 0
        for n, text, a in blocks:
            held[n] += len(text)
            link[n] += a
            if 2 * a < len(text) and not fields[n] and (tags[n] in _PROSE or len(text) >= 40 and tags[n] not in _HEADS):
                para[n] += len(text)
                rest += not covered[n]
        for n in range(len(tags) - 1, 0, -1):
            for x in (held, para, link, field, titled, articles):
                x[parent[n]] += x[n]
        for n in range(1, len(tags)):
            kind, most = named[n], 2 * held[n] > held[0]
            alone = titled[n] or articles[n] == 1 or not rest and para[n] > 0 and (kind != FORM or para[n] >= 100 * field[n])
            go = kind == WORD and not most and 2 * link[n] >= held[n] or kind == STATE and rest and not titled[n]
            go = go or kind in (NAME, FORM) and not (most and alone) or kind == TALK and not (most and titled[n])
            out[n] |= out[parent[n]] or bool(go)
            weight[n] = weight[parent[n]] * (0.25 if kind == WORD and not most else 1.0)
    blocks = [b for b in blocks if not out[b[0]] and head[b[0]] != 1]
    if not blocks:
        return ""
    size, link, give = [0] * len(tags), [0] * len(tags), [0.0] * len(tags)
    for n, text, a in blocks:
        size[n] += len(text)
        link[n] += a
        # a block written straight into a container counts for that container
        give[parent[n] if n and (tags[n] in _PLAIN or tags[n] in ("li", "td", "dd", "dt")) else n] += (1 + text.count(",") + min(len(text) // 100, 3)) * (1 - a / len(text))
    for n in range(len(tags) - 1, 0, -1):
        size[parent[n]] += size[n]
        link[parent[n]] += link[n]
        give[parent[n]] += give[n] / 2
    density = lambda n: link[n] / size[n] if size[n] else 0.0
    final = [(_BASE.get(t, 0.0) + give[n]) * (1 - density(n)) * weight[n] if size[n] else -1.0 for n, t in enumerate(tags)]
    best = max((n for n in range(len(tags)) if tags[n] not in _PLAIN and tags[n] in _BLOCK and not out[n] or n == 0), key=lambda n: (final[n], -n))
    k = best
    while k > 0:
        if tags[k] in ("article", "main") and not out[k]:
            best = k
        k = parent[k]
    keep = [False] * len(tags)
    keep[best] = True
    if best and tags[best] not in ("html", "body"):
        line = max(5.0, 0.2 * final[best])
        for n in range(1, len(tags)):
            if parent[n] == parent[best] and not out[n] and (final[n] >= line or tags[n] in _PLAIN and density(n) < 0.3):
                keep[n] = True
    for n in range(1, len(tags)):
        keep[n] = keep[n] or keep[parent[n]]
    own = [t for n, t, _ in blocks if keep[n] or n == parent[best] and tags[n] not in ("html", "#root")]
    return "\n".join(own)


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars."""
    ready(pages.sparkSession)
    one = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(html))
    kind = [f"{c} {one.schema[c].dataType.simpleString()}" for c in ("page_id", "url")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                part = b.slice(lo, 200)
                text = [extract(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return one.mapInArrow(run, f"{', '.join(kind)}, text string, n_chars long")
