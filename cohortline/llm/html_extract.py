"""Main text of HTML pages by block rules in two passes.

A page is cut into blocks at block-level tags (and at two line breaks in a row).
First pass, each block by itself: by length, share of stop words and share of
links it is good (long, many stop words), bad (links, copyright lines) or
undecided (short, or with few stop words, which is bad where no mark speaks for it).

Names (menus, footers, sidebars, notices, adverts, forms, reader comments; by
element, role, whole class or id) make what they hold bad. A name gives way where
its element holds most of the page's good text (reader comments: all of it), or
where it often stands for a mere wrapper (form, header, widget) and the block is
good by itself. ``html`` and ``body`` are never bad, ``article`` and ``main``
never by name. What is hidden stays out.

Marks (``article``, ``main``) are evidence for undecided blocks. A marked element
counts if it holds a good block or a quarter of the page's prose (on pages
without prose, always): undecided blocks inside are good, and if such elements
hold half of the prose, those outside are bad. Elsewhere undecided blocks go to
the second pass: they take the label of the nearest decided neighbour, headings
that of the block they lead to. So do blocks of few stop words in an article,
unless the page shows none at all (a language without a list here). On such pages
length and links alone decide blocks in the first pass; a character of a script
that writes words with one or two counts three times. If no block is good in the
end, those that nothing speaks against are the text (a lone short paragraph).

Good blocks, with references decoded and white space in a block made single
spaces, are joined by line ends. Nothing else is dropped or cut.

Rows: a null, empty or textless page gives an empty text. Equal rows give equal
rows. Truncated pages are read as far as they go; an unended tag, comment or
script is no text. Extra columns are left out.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.llm.common import text_batches

#: Frequent function words of the languages that pages are expected in.
STOP_WORDS = frozenset("""
the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one you were her all she there
la le les de des du et en un une que qui dans est pour pas sur au il plus par ce avec ne se sont ou son aux sa cette
der die das und den von zu mit sich dem nicht ein eine auf ist für im auch es werden aus hat als dass einer wird bei um
el los las y a del se por con para una su al lo como más o pero sus le ya este sí porque esta entre cuando muy sin sobre
""".split())


@dataclass(frozen=True)
class Rules:
    """Lengths are in code points, shares between 0 and 1."""

    short: int = 70
    long: int = 200
    stop_low: float = 0.15
    stop_high: float = 0.25
    links: float = 0.4
    links_in_article: float = 0.6
    heading_reach: int = 3
    article_prose: float = 0.25
    most: float = 0.5
    wrapped: float = 0.9


_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|textarea|title|iframe|xmp)\b[^>]*(?:>.*?(?:</(?P=raw)\b[^>]*(?:>|\Z)|\Z)|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<rest>[^>=]*+(?:=\s*+(?:\"[^\"]*+\"|'[^']*+')?+[^>=]*+)*+)(?:>|\Z)"
    r"|</?[a-z][^>]*(?:>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)",
    re.IGNORECASE | re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
_NAMES = re.compile(r"[a-z]+")
_DENSE = re.compile("[\u1100-\u11ff\u2e80-\u9fff\uac00-\ud7af\uf900-\ufaff\U00020000-\U0003ffff]")
_NOTICE = re.compile(r"(?:\xa9|\(c\)|\bcopyright\b)[\s,]*(?:\xa9\s*)?(?:19|20)\d\d", re.IGNORECASE)

_BLOCKS = frozenset("""
address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot
th thead tr ul
""".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_BAD_TAGS = frozenset("aside button canvas dialog fieldset footer form head menu nav noscript object search select svg template".split())
_BAD_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar".split())
_BAD_NAMES = frozenset("""
ad ads adbox adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer
disqus footer form header login menu modal nav navbar navigation newsletter notice notices paywall popup promo promotion related replies reply
respond search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget
""".split())
#: Parts of a class or id that leave the meaning of a bad name beside them as it is (``site-footer``, not ``has-sidebar``).
_NEUTRAL_NAMES = frozenset("""
area bar block body bottom box center col column container content desktop fixed global group holder id info inner item items law left link links
list main message mobile outer page panel policy primary right row secondary section site slot sticky text the thread title top unit wrap wrapper zone
""".split())
#: Reader comments are prose too, so these give way only if there is no other prose.
_READER_NAMES = frozenset("comment comments disqus related replies reply respond".split())
#: Bad elements, roles and names that also wrap the text itself; a good block inside is good.
_WRAPPERS = frozenset("""
banner dialog disclaimer fieldset form header login modal notice notices popup promo promotion search share sharing social sponsor sponsored
toolbar widget
""".split())
#: What no reader sees as text, whatever it holds.
_UNSEEN_TAGS = frozenset("button canvas head noscript object select svg template".split())
#: An article's own header holds its title, so these don't count inside one.
_FINE_IN_ARTICLE = frozenset(("header", "banner", "form", "search"))


@dataclass(eq=False)
class Mark:
    """An element that says something on the blocks in it; ``kind``: article, hidden, named, reader or wrapper."""

    kind: str
    up: Mark | None
    at: int
    prose: int = 0
    rich: int = 0
    plain: int = 0
    says: frozenset = frozenset()
    article: Mark | None = None


@dataclass
class Block:
    text: str
    linked: int
    tag: str
    bad: bool
    article: bool
    label: str = ""
    mark: Mark | None = field(default=None, repr=False)


def _bad_names(value: str) -> set[str]:
    """Bad names among the whole words of a class or id; a compound counts if all its parts are bad or neutral."""
    out: set[str] = set()
    for token in value.split():
        parts = {x for x in _NAMES.findall(token) if len(x) > 1}
        bad = parts & _BAD_NAMES
        if bad and not parts - bad - _NEUTRAL_NAMES:
            out |= bad
    return out


def _flags(tag: str, rest: str, article: bool) -> tuple[str, bool]:
    """Why an opening tag's blocks are bad (hidden, named, reader, wrapper or empty), and whether it marks an article."""
    main = tag in ("article", "main")
    names = {tag} if tag in _BAD_TAGS or (tag == "header" and not article) else set()
    hidden = tag in _UNSEEN_TAGS
    if "=" in rest or "hidden" in rest:
        for name, value in _ATTRIBUTE.findall(rest):
            name, value = name.lower(), value.strip("\"'").lower()
            if name in ("class", "id"):
                found = _bad_names(value)
                names |= found - _FINE_IN_ARTICLE if article or main else found
            elif name == "role":
                names |= {value} & _BAD_ROLES
                main = main or value == "main"
            elif name == "itemprop":
                main = main or value == "articlebody"
            elif name == "style":
                hidden = hidden or "display:none" in value.replace(" ", "")
            else:
                hidden = hidden or (name == "hidden") or value == "true"
    if tag in ("html", "body"):
        return "", main
    if hidden:
        return "hidden", main
    if tag in ("article", "main") or not names:
        return "", main
    if names & _READER_NAMES:
        return "reader", main
    return "wrapper" if names <= _WRAPPERS else "named", main


def blocks(page: str) -> list[Block]:
    """The blocks with text, in page order."""
    out: list[Block] = []
    texts: list[str] = []
    open_tags: list[tuple[str, bool, bool, Mark | None]] = []  # tag, bad, article, the last three with what is around
    linked, in_link, breaks, tag_here, marks = 0, False, 0, "", 0

    def close() -> None:
        nonlocal linked, breaks
        if texts:
            text = " ".join("".join(texts).split())
            if text:
                _, bad, article, mark = open_tags[-1] if open_tags else ("", False, False, None)
                out.append(Block(text, linked, tag_here, bad, article, mark=mark))
            texts.clear()
        linked, breaks = 0, 0

    def add(raw: str) -> None:
        nonlocal linked, breaks
        if raw:
            text = references.unescape(raw) if "&" in raw else raw
            texts.append(text)
            if not text.isspace():
                breaks = 0
                if in_link:
                    linked += len(" ".join(text.split()))

    at = 0
    for m in _TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if not tag:
            continue
        tag = tag.lower()
        block = tag in _BLOCKS
        if block:
            close()
        if tag == "br":
            texts.append(" ")
            breaks += 1
            if breaks > 1:
                close()
        elif tag == "a":
            in_link = not m["end"]
        elif m["end"]:
            if any(t == tag for t, *_ in open_tags):
                hidden = open_tags[-1][1]
                if not block and hidden:
                    close()
                while open_tags.pop()[0] != tag:
                    pass
            if block:
                in_link, tag_here = False, ""
        elif tag not in _VOID:
            if tag == "p" or tag in _HEADINGS:
                if open_tags and (open_tags[-1][0] == "p" or open_tags[-1][0] in _HEADINGS):
                    open_tags.pop()
            elif tag == "li" and open_tags and open_tags[-1][0] in ("li", "p"):
                while open_tags and open_tags[-1][0] in ("li", "p"):
                    open_tags.pop()
            _, bad, article, mark = open_tags[-1] if open_tags else ("", False, False, None)
            rest = m["rest"]
            if block or rest or tag in _BAD_TAGS:
                why, more_article = _flags(tag, rest, article)
                if block or why or more_article:
                    if why and not block:
                        close()
                    for kind in ["article"] * more_article + [why] * bool(why):
                        mark, marks = Mark(kind, mark, marks), marks + 1
                    open_tags.append((tag, bad or bool(why), article or more_article, mark))
            if block:
                in_link, tag_here = False, tag
    add(page[at:])
    close()
    return out


def _length(text: str) -> int:
    """Code points; characters of scripts that write a word with one or two of them count three times."""
    return len(text) if text.isascii() else len(text) + 2 * len(_DENSE.findall(text))


def _by_itself(b: Block, rules: Rules, listed: bool = True) -> str:
    """good, near, low (fewer stop words), poor (few), short, notice, linked or links.

    On pages whose language has no list of stop words (``listed`` is False) length alone tells prose.
    """
    n = len(b.text)
    share = b.linked / n
    if not listed:
        n = _length(b.text)
        kind = "links" if share > rules.links_in_article else "linked" if share > rules.links else ""
        if kind:
            return kind
        if _NOTICE.search(b.text):
            return "notice"
        return "good" if n > rules.long else "near" if n >= rules.short else "linked" if b.linked else "short"
    if share > rules.links_in_article:
        return "links"
    if share > rules.links:
        return "linked"
    if n >= rules.short:
        words = b.text.lower().split()
        stops = sum(w.strip(".,;:!?()\"'") in STOP_WORDS for w in words) / len(words)
        if stops >= rules.stop_high:
            return "good" if n > rules.long else "near"
        if _NOTICE.search(b.text):
            return "notice"
        return "low" if stops >= rules.stop_low else "poor"
    if _NOTICE.search(b.text):
        return "notice"
    return "linked" if b.linked else "short"


def _weigh(found: list[Block], own: list[str], rules: Rules) -> tuple[list[bool], list[bool], bool]:
    """Of each block whether names make it bad and whether a mark that counts holds it; whether such marks hold most prose."""
    seen: dict[int, Mark] = {}
    for b in found:
        m = b.mark
        while m is not None and m.at not in seen:
            seen[m.at] = m
            m = m.up
    down = [seen[k] for k in sorted(seen)]  # outer ones first
    for m in down:
        m.prose = m.rich = m.plain = 0
        m.says = (m.up.says if m.up else frozenset()) | ({m.kind} if m.kind == "hidden" else frozenset())
    rich = plain = 0
    for b, kind in zip(found, own):
        if not (b.mark and b.mark.says):
            r, p = len(b.text) * (kind == "good"), len(b.text) - b.linked
            rich, plain = rich + r, plain + p
            if b.mark:
                b.mark.rich, b.mark.plain = b.mark.rich + r, b.mark.plain + p
    for m in reversed(down):
        if m.up:
            m.up.rich, m.up.plain = m.up.rich + m.rich, m.up.plain + m.plain
    for m in down:
        if m.kind == "reader":
            fine = rich and m.rich == rich
        elif rich:
            fine = m.rich > rules.most * rich and m.plain > rules.most * plain
        else:
            fine = m.kind == "wrapper" and m.plain > rules.wrapped * plain
        around = m.up.says if m.up else frozenset()
        m.says = around if m.kind == "article" or (m.kind != "hidden" and fine) else around | {m.kind}
        m.article = m if m.kind == "article" else m.up.article if m.up else None
    bad = []
    for b, kind in zip(found, own):
        says = b.mark.says if b.mark else ({"named"} if b.bad else ())
        bad.append(bool(says) and not (kind == "good" and says == {"wrapper"}))
    prose = 0
    strong: set[int] = set()
    for b, kind, out in zip(found, own, bad):
        if not out and kind in ("good", "near"):
            prose += len(b.text)
            if b.mark:
                b.mark.prose += len(b.text)
                if kind == "good":
                    strong.add(b.mark.at)
    for m in reversed(down):
        if m.up:
            m.up.prose += m.prose
            if m.at in strong:
                strong.add(m.up.at)
    counts = {m.at for m in down if m.kind == "article" and (m.at in strong or m.prose >= rules.article_prose * prose)}
    held = [b.mark.article is not None and b.mark.article.at in counts if b.mark else b.article for b in found]
    inside = sum(len(b.text) for b, kind, out, h in zip(found, own, bad, held) if h and not out and kind in ("good", "near"))
    leads = any(h and not out for h, out in zip(held, bad)) and inside >= rules.most * prose
    return bad, held, leads


def classify(found: list[Block], rules: Rules = Rules()) -> list[Block]:
    """Label every block good or bad."""
    own = [_by_itself(b, rules) for b in found]
    if not any(k in ("good", "near", "low") for k in own) and any(_length(b.text) >= rules.short for b in found):
        own = [_by_itself(b, rules, listed=False) for b in found]
    bad, marked, leads = _weigh(found, own, rules)
    known = any(k in ("good", "near") and not out for k, out in zip(own, bad))
    for b, kind, out, inside in zip(found, own, bad, marked):
        if out or kind in ("links", "notice"):
            b.label = "bad"
        elif kind == "good":
            b.label = "good"
        elif inside:
            b.label = "poor" if kind == "poor" and known else "good"
        elif leads or kind in ("linked", "poor") or (kind == "short" and "\xa9" in b.text):
            b.label = "bad"
        else:
            b.label = "near" if kind == "low" else kind
    # Blocks of few stop words in an article ask the nearest decided ones of the article that no name makes bad.
    own_kind = [i for i, inside in enumerate(marked) if inside and not bad[i]]
    sure = [(j, i) for j, i in enumerate(own_kind) if found[i].label in ("good", "bad")]
    at = 0
    for j, i in enumerate(own_kind):
        while at < len(sure) and sure[at][0] < j:
            at += 1
        if found[i].label == "poor":
            sides = [(abs(j - k), own[x]) for k, x in sure[max(at - 1, 0) : at + 1]]
            nearest = min((d for d, _ in sides), default=0)
            found[i].label = "bad" if sides and all(x in ("links", "notice") for d, x in sides if d == nearest) else "good"
    decided = [b.label in ("good", "bad") for b in found]
    labels = [b.label for b in found]
    left, right = [-1] * len(found), [-1] * len(found)
    for way, order in ((left, range(len(found))), (right, range(len(found) - 1, -1, -1))):
        last = -1
        for i in order:
            way[i] = last
            if decided[i]:
                last = i
    for i, b in enumerate(found):
        if decided[i]:
            continue
        before, after = left[i], right[i]
        sides = [(abs(i - k), labels[k]) for k in (before, after) if k >= 0]
        # Equally near neighbours that disagree: a bad one set apart by its own container (a menu, comments) says less.
        if len({d for d, _ in sides}) == 1 and any(bad[k] for k in (before, after) if k >= 0 and labels[k] == "bad"):
            sides = [x for x in sides if x[1] == "good"] or sides
        if b.tag in _HEADINGS and after >= 0 and labels[after] == "good" and after - i <= rules.heading_reach:
            b.label = "good"
        elif not sides:
            b.label = "good" if b.label == "near" or all(x in ("near", "short") for x in labels) else "bad"
        else:
            nearest = min(d for d, _ in sides)
            near = {x for d, x in sides if d == nearest}
            if b.label == "near":
                b.label = "good" if any(x == "good" for _, x in sides) else "bad"
            else:
                b.label = "good" if near == {"good"} else "bad"
    if not any(b.label == "good" for b in found):
        # Nothing speaks for any block: what nothing speaks against is the text.
        for b, kind, out in zip(found, own, bad):
            if not out and kind in ("short", "near", "low", "poor") and "\xa9" not in b.text:
                b.label = "good"
    return found


def main_text(page: str | None, rules: Rules = Rules()) -> str:
    """The good blocks of a page, one a line."""
    return "\n".join(b.text for b in classify(blocks(page or ""), rules) if b.label == "good")


def extract(pages: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """page_id, url, text, n_chars for every page; a narrow pass without shuffle."""
    text_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h, rules) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    narrow = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return narrow.mapInArrow(run, "page_id long, url string, text string, n_chars long")
