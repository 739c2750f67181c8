"""Main text of web pages by equivalence-class template deduction.

A page is a sequence of tokens: tags in their place, and the texts between them. Over the pages of a host, tokens with
the same occurrence vector (how often each page has them) form an equivalence class. Classes that are large enough, and
are on LEAST_SHARE of the host's pages, belong to its template. On a page a class counts only if its tags come in order
and its occurrences nest with those of the others; of two classes that cross, the smaller one is left out. The template
is these nested classes, and the gaps between their tags are the slots that hold data.

Slots are judged over all pages of the host. A text that is itself in a class, and stands on the page in the slot where
it stands on the host, is constant: template, not data, wherever it is, articles included. What is left tells where the
article is: <article> or <main> if most of the varying text is in them, else the deepest template element that holds
nearly all of it, slots of links apart, with the headings around it. That element's data are the page's text. Element
names, roles and class words are asked last: menus, headers, footers, sidebars, notices, adverts, forms and comments
that differ from page to page look like data to the classes.

Only whole blocks are dropped as constant, so words that a host puts around data stay. A text needs enough pages as
evidence (Wilson's lower bound of its share of pages). If the constant texts of a host are most of its articles, its
pages are copies of each other, and they are kept. A page where no class of its host is valid, or that has no such
element, is read by the same steps as a host of its own.

An occurrence vector is never built: its fingerprint is the sum over pages of count times a number drawn for the page,
taken twice, which Spark adds up in parts. So a host with a third of all pages costs no more per page than others.
Places are hashed from their parent's hash, so a page nested to any depth takes memory in proportion to its length.

Texts: character references decoded, white space inside a block one space, trimmed, blocks joined by a line end. Nulls
and odd rows: a null or empty html has the empty text; a null url is a host of its own; a repeated page counts each
time; a host with one page has a template of tags alone; broken markup is read leniently to the end; an empty table
gives no rows; other columns are left out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

#: A class is in the template if it has this many tokens and is on this share of the host's pages.
LEAST_TOKENS = 3
LEAST_SHARE = 0.5
#: Standard errors for the lower bound of a text's share of pages, which must reach LEAST_SHARE too.
Z = 1.96
#: Constant texts are furniture up to this share of the articles that hold them, and up to this share of other text.
MOST_OF_ARTICLE = 0.5
MOST_OF_TEXT = 0.9
#: The article's element is sought downwards while one part holds this share of the varying text.
LEAST_PART = 0.7
#: A slot with this share of its characters in links is a list of links.
LINKS = 0.8

#: What HTML element names, roles and class words mean.
WHOLE = ("script", "style", "noscript", "template", "textarea", "svg", "iframe", "object", "select", "title")
FURNITURE = {"nav", "footer", "aside", "form", "button", "menu", "dialog", "head", "canvas", "audio", "video", "fieldset", "datalist"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"}
WORDS = {"ad", "ads", "adbox", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "pager", "pagination", "popup", "promo", "promotion", "recommended", "related", "reply", "respond", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar", "topbar", "widget", "widgets"}
ARTICLE = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
HELD = {"html", "body", "header", "section", "div", "table", "tbody", "thead", "tfoot", "ul", "ol", "dl", "blockquote", "figure", "details", "center"} | ARTICLE | FURNITURE
BLOCKS = HELD | {"p", "li", "dt", "dd", "tr", "td", "th", "caption", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "hr", "address", "figcaption", "summary", "legend", "option", "hgroup"}
MARKUP = re.compile(
    r"<!--(?:.*?(-->))?|<(" + "|".join(WHOLE) + r")\b[^>]*>(?:.*?(</)\2\s*>)?"
    r"|</?([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|</?([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([a-zA-Z][\w:-]*)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)|\b(hidden)\b", re.S)
NAME_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")

OPEN, CLOSE, TEXT = 0, 1, 2
#: What is known of a text's place.
IN_FURNITURE, IN_ARTICLE, IN_HEADING, IN_LINK = 1, 2, 4, 8
#: The place of a page as a whole.
PAGE = 0


def _label(name: str, attributes: str, in_article: bool) -> tuple[str, bool]:
    """A label for an element, and whether it is furniture. The whole page's and the article's attributes do not count."""
    furniture = name in FURNITURE or (name == "header" and not in_article)
    label, whole = name, name in ("html", "body", "article", "main")
    if attributes and not attributes.isspace():
        for key, value, hidden in ATTRIBUTE.findall(attributes):
            key, value = (hidden or key).lower(), value.strip("\"'")
            if key in ("class", "id"):
                if not whole:
                    label += "." + re.sub(r"\d+", "0", value)
                    words = {w.lower() for w in NAME_WORDS.findall(value)}
                    furniture |= bool(words & WORDS) or ("header" in words and not in_article)
            elif key == "role":
                furniture |= value.lower() in ROLES
                if not whole:
                    label += "@" + value
            elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value)):
                furniture = True
    return label, furniture


@dataclass
class Page:
    """A page's tokens, in order: kind, key (64 bits), text or element name, place, and flags; and each place's parent."""

    tokens: list[tuple[int, int, str, int, int]] = field(default_factory=list)
    parents: dict[int, int] = field(default_factory=dict)

    def up(self, place: int, known: dict[int, int]) -> int:
        """What `known` tells of the nearest place around `place` (itself included), PAGE's if of none; kept in `known`."""
        passed = []
        while place not in known:
            passed.append(place)
            place = self.parents.get(place, PAGE)
        for p in passed:
            known[p] = known[place]
        return known[place]


def tokens_of(html: str) -> Page:
    """The tags and texts of a page. A place is the hash of an element's label under its parent's place."""
    from xxhash import xxh3_64_intdigest

    page = Page()
    out, parents = page.tokens, page.parents
    stack: list[tuple[str, int, int]] = [("", PAGE, 0)]
    opened: Counter = Counter()
    at, heading, link = 0, 0, 0

    def text(upto: int) -> None:
        if upto > at:
            value = html[at:upto]
            _, place, flags = stack[-1]
            own = value.strip()
            key = xxh3_64_intdigest(own.encode("utf-8", "surrogatepass"), place ^ TEXT) if own else 0
            out.append((TEXT, key, value if own else " ", place, flags | heading | link))

    last, pos = html.rfind(">") + 1, 0  # no markup ends behind the last ">"
    while m := MARKUP.search(html, pos, last):
        text(m.start())
        at = pos = m.end()
        name = (m[4] or m[6] or "").lower()
        if not name:
            if not m[1] and not m[3] and (m[2] or html.startswith("<!--", m.start())):  # open to the end
                at = pos = len(html)
            continue
        kind = OPEN
        if html[m.start() + 1] == "/":
            kind = CLOSE
            if name in HELD and opened[name]:
                while True:
                    gone = stack.pop()[0]
                    opened[gone] -= 1
                    if gone == name:
                        break
        elif name in HELD:
            _, place, flags = stack[-1]
            label, odd = _label(name, m[5] or m[7] or "", bool(flags & IN_ARTICLE))
            own = xxh3_64_intdigest(label.encode("utf-8", "surrogatepass"), place)
            parents[own] = place
            flags |= (IN_FURNITURE if odd else 0) | (IN_ARTICLE if name in ARTICLE else 0)
            stack.append((name, own, flags))
            opened[name] += 1
        if name in HEADINGS:
            heading = IN_HEADING if kind == OPEN else 0
        elif name == "a":
            link = IN_LINK if kind == OPEN else 0
        elif name in BLOCKS:
            heading = 0
        _, place, flags = stack[-1]
        out.append((kind, xxh3_64_intdigest(name.encode("utf-8", "surrogatepass"), place ^ kind), name, place, flags))
    unclosed = html.find("<!--", max(pos, last)) if pos < len(html) else -1
    text(unclosed if unclosed >= 0 else len(html))
    return page


def signed(numbers) -> np.ndarray:
    return np.array(numbers, np.uint64).view(np.int64)


STATISTICS = "host string, kind int, token long, pages long, times long, first long, second long, place double, share long"
#: Kinds of tokens in the statistics: a tag, a text of furniture, of the rest of the page, of an article.
TAG, FURNITURE_TEXT, OTHER_TEXT, ARTICLE_TEXT = range(4)


def page_statistics(pages: DataFrame) -> DataFrame:
    """Per host and token: pages, times, both fingerprint sums, and mean places and shares of the text (in millionths) added up.

    Token 0 counts the host's pages. A text of an article has its share of the page's articles, others of all text but furniture.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            held: dict[tuple, list] = {}
            for host, number, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                draw = xxh3_64_intdigest(str(number))
                first, second = draw & 0x7FFFFFFF, (draw >> 32) & 0x7FFFFFFF
                seen: dict[tuple[int, int], list] = {(TAG, 0): [1, 0, 0]}
                article = other = 0
                for n, (kind, key, value, _, flags) in enumerate(tokens_of(html.as_py() or "").tokens):
                    own, size = TAG, 0
                    if kind == TEXT:
                        if not key:
                            continue
                        size = len(value)
                        own = FURNITURE_TEXT if flags & IN_FURNITURE else ARTICLE_TEXT if flags & IN_ARTICLE else OTHER_TEXT
                        other += size if own > FURNITURE_TEXT else 0
                        article += size if own == ARTICLE_TEXT else 0
                    row = seen.get((own, key))
                    if row is None:
                        seen[own, key] = [1, n, size]
                    else:
                        row[0] += 1
                        row[2] += size
                for own, (c, n, size) in seen.items():
                    row = held.setdefault((host, *own), [0, 0, 0, 0, 0.0, 0])
                    row[0] += 1
                    row[1] += c
                    row[2] += c * first
                    row[3] += c * second
                    row[4] += n
                    if own[0] > FURNITURE_TEXT:
                        row[5] += 1_000_000 * size // (article if own[0] == ARTICLE_TEXT else other)
            if held:
                host, kind, token = zip(*held)
                rest = list(zip(*held.values()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(host, pa.string()), pa.array(kind, pa.int32()), pa.array(signed(token)), *(pa.array(c, pa.int64()) for c in rest[:4]), pa.array(rest[4], pa.float64()), pa.array(rest[5], pa.int64())],
                    [c.split()[0] for c in STATISTICS.split(", ")],
                )

    added = [F.sum(c).alias(c) for c in ("pages", "times", "first", "second", "place", "share")]
    return pages.select("host", "number", "html").mapInArrow(run, STATISTICS).groupBy("host", "kind", "token").agg(*added)


def lower_bound(part: Column, whole: Column) -> Column:
    """Wilson's lower bound of a share."""
    share = part / whole
    return (share + Z * Z / (2 * whole) - Z * F.sqrt(share * (1 - share) / whole + Z * Z / (4 * whole * whole))) / (1 + Z * Z / whole)


def class_templates(statistics: DataFrame) -> DataFrame:
    """host, classes (for each its tags in page order), texts (for each its constant texts and their slots)."""
    sizes = statistics.where("token = 0").select("host", F.col("pages").alias("all_pages"))
    least = Z * Z * LEAST_SHARE / (1 - LEAST_SHARE)  # no text on fewer pages passes the bound
    tokens = statistics.where("token <> 0").where((F.col("kind") == TAG) | (F.col("pages") >= least)).join(sizes, "host")
    enough = F.when(F.col("kind") == TAG, F.col("pages") >= LEAST_SHARE * F.col("all_pages")).otherwise(lower_bound(F.col("pages"), F.col("all_pages")) >= LEAST_SHARE)
    own = F.array_sort(F.collect_list(F.struct((F.col("place") / F.col("pages")).alias("at"), "token", "kind")))
    share = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("share") / F.col("pages"))), F.lit(0.0)) / 1e6
    classes = tokens.where(enough).groupBy("host", "pages", "times", "first", "second").agg(F.count("*").alias("n"), own.alias("own"), share(ARTICLE_TEXT).alias("article"), share(OTHER_TEXT).alias("other"))
    marks = F.filter("own", lambda x: x["kind"] == TAG)
    texts = F.transform(F.filter("own", lambda x: x["kind"] != TAG), lambda x: F.struct(x["token"].alias("token"), F.size(F.filter(marks, lambda m: m["at"] < x["at"])).alias("slot"), x["kind"].alias("kind")))
    split = classes.where(F.col("n") >= LEAST_TOKENS).select("host", "article", "other", F.transform(marks, lambda m: m["token"]).alias("marks"), texts.alias("texts")).where(F.size("marks") > 0)
    per_host = split.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("marks", "texts"))).alias("own"), F.sum("article").alias("article"), F.sum("other").alias("other"))
    most = lambda x: F.when(x["kind"] == ARTICLE_TEXT, F.col("article") <= MOST_OF_ARTICLE).when(x["kind"] == OTHER_TEXT, F.col("other") <= MOST_OF_TEXT).otherwise(True)
    kept = F.transform("own", lambda x: F.transform(F.filter(x["texts"], most), lambda t: F.struct(t["token"], t["slot"])))
    return per_host.select("host", F.transform("own", lambda x: x["marks"]).alias("classes"), kept.alias("texts"))


@dataclass
class Template:
    """Classes of tags, each class's constant texts (token: slot), and where the article is: a place, or (None) its elements."""

    classes: list[list[int]]
    texts: list[dict[int, int]]
    region: int | None = PAGE
    where: dict[int, tuple[int, int]] = field(init=False)

    def __post_init__(self) -> None:
        self.where = {token: (c, k) for c, own in enumerate(self.classes) for k, token in enumerate(own)}


def template_of(classes: list | None, texts: list | None, region: int | None = PAGE) -> Template:
    """From the columns of the template table; keys are unsigned here."""
    low = (1 << 64) - 1
    return Template([[t & low for t in own] for own in classes or []], [{x["token"] & low: x["slot"] for x in own} for own in texts or []], region if region is None else region & low)


def valid_classes(keys: list[int], classes: list[list[int]], where: dict[int, tuple[int, int]] | None = None) -> set[int]:
    """The classes on this page whose tokens come in order and whose occurrences nest; of two that cross, the larger stays."""
    if where is None:
        where = {token: (c, k) for c, own in enumerate(classes) for k, token in enumerate(own)}
    hits = [where[key] for key in keys if key in where]
    following = [0] * len(classes)
    good, bad = set(), set()
    for c, k in hits:
        good.add(c)
        if k != following[c]:
            bad.add(c)
        following[c] = (k + 1) % len(classes[c])
    good = {c for c in good - bad if not following[c]}
    stack: list[int] = []
    for c, k in hits:
        if c not in good:
            continue
        if k == 0:
            stack.append(c)
        while stack[-1] != c:  # c is open further down
            top = stack[-1]
            if (len(classes[top]), -top) < (len(classes[c]), -c):
                good.discard(stack.pop())
            else:
                good.discard(c)
                stack.remove(c)
                break
        if c in good and k + 1 == len(classes[c]):
            stack.pop()
    return good


@dataclass
class Slots:
    """Which slot each text of a page is in, which texts are constant, and the template's elements on the page."""

    good: set[int]
    slot: list[tuple[int, int]]
    constant: set[int]
    elements: dict[int, int]


def slots_of(page: Page, template: Template) -> Slots:
    """slot is (class, gap) for every token, (-1, 0) outside of all; elements maps a place to its template element."""
    keys = [t[1] for t in page.tokens]
    good = valid_classes(keys, template.classes, template.where)
    known = {token: (c, slot % len(template.classes[c])) for c in good for token, slot in template.texts[c].items()} if template.texts else {}
    following = dict.fromkeys(good, 0)
    stack = [-1]
    slot, constant, elements = [], set(), {PAGE: PAGE}
    for n, (kind, key, name, place, _) in enumerate(page.tokens):
        if kind == TEXT:
            slot.append((stack[-1], following.get(stack[-1], 0)))
            at = known.get(key)
            if at is not None and following[at[0]] == at[1]:
                constant.add(n)
            continue
        slot.append((-1, 0))
        c, k = template.where.get(key, (-1, 0))
        if c not in good:
            continue
        if k == 0:
            stack.append(c)
        following[c] = (k + 1) % len(template.classes[c])
        if not following[c]:
            stack.pop()
        if kind == OPEN and name in HELD:
            elements[place] = place
    return Slots(good, slot, constant, elements)


def slot_masses(page: Page, slots: Slots) -> tuple[dict[tuple[int, int, int], list[int]], dict[int, int]]:
    """(element, class, gap): characters of data, of those in links, in headings, in articles; and each element's parent."""
    masses: dict[tuple[int, int, int], list[int]] = {}
    parents: dict[int, int] = {}
    known = dict(slots.elements)
    for n, (kind, key, value, place, flags) in enumerate(page.tokens):
        if kind != TEXT or not key or flags & IN_FURNITURE or n in slots.constant:
            continue
        element = page.up(place, known)
        size = len(value)
        row = masses.setdefault((element, *slots.slot[n]), [0, 0, 0, 0])
        row[0] += size
        row[1] += size if flags & IN_LINK else 0
        row[2] += size if flags & IN_HEADING else 0
        row[3] += size if flags & IN_ARTICLE else 0
        while element != PAGE and element not in parents:
            parents[element] = page.up(page.parents[element], known)
            element = parents[element]
    return masses, parents


def article_region(masses: dict[tuple[int, int, int], list[float]], parents: dict[int, int]) -> int | None:
    """Where the article is: None for the article elements, else the place of a template element, or PAGE."""
    data: Counter = Counter()
    beside: Counter = Counter()
    total = article = 0.0
    for (element, _, _), (size, links, headings, in_article) in masses.items():
        own = 0 if links >= LINKS * size else size
        data[element] += own
        beside[element] += size - headings
        total += size
        article += in_article
    if article and article >= LEAST_SHARE * total:
        return None
    below: dict[int, list[int]] = {}
    for element, parent in sorted(parents.items()):
        below.setdefault(parent, []).append(element)
    order = [PAGE]
    for element in order:
        order += below.get(element, [])
    for element in reversed(order[1:]):
        data[parents[element]] += data[element]
        beside[parents[element]] += beside[element]
    at = PAGE
    while data[at]:
        best = max(below.get(at, []), key=lambda e: data[e], default=None)
        if best is None or data[best] < LEAST_PART * data[at]:
            break
        at = best
    while at != PAGE and beside[parents[at]] == beside[at]:  # what lies around it is headings or nothing
        at = parents[at]
    return at


def own_template(page: Page) -> Template:
    """The template of a page as a host of its own: its tags, in classes of equal counts."""
    counts: Counter = Counter(t[1] for t in page.tokens if t[0] != TEXT)
    classes: dict[int, list[int]] = {}
    for key, n in counts.items():
        classes.setdefault(n, []).append(key)
    return Template([own for own in classes.values() if len(own) >= LEAST_TOKENS], [])


def main_text(html: str, template: Template | None = None) -> str:
    """The blocks of a page's article, joined by line ends."""
    page = tokens_of(html)
    slots = slots_of(page, template) if template else None
    region = template.region if template else PAGE
    if region is None:
        found = any(t[0] == TEXT and t[1] and t[4] & (IN_ARTICLE | IN_FURNITURE) == IN_ARTICLE for t in page.tokens)
    else:
        found = slots is not None and region in slots.elements
    if slots is None or not slots.good or not found:
        own = own_template(page)
        alone = slots_of(page, own)
        if slots:
            alone.constant |= slots.constant
        slots = alone
        region = article_region(*slot_masses(page, slots))
    inside = {PAGE: region == PAGE}
    if region is not None:
        inside[region] = True
    blocks: list[str] = []
    held: list[str] = []
    own = False  # whether the block holds a text that is not constant

    def flush() -> None:
        nonlocal own
        if held:
            block = " ".join("".join(held).split())
            if block and own:
                blocks.append(block)
            held.clear()
        own = False

    for n, (kind, key, value, place, flags) in enumerate(page.tokens):
        if kind != TEXT:
            if value in BLOCKS:
                flush()
            elif value == "br":
                held.append(" ")
            continue
        if flags & IN_FURNITURE or not (flags & IN_ARTICLE if region is None else page.up(place, inside)):
            continue
        held.append(unescape(value))
        own |= bool(key) and n not in slots.constant
    flush()
    return "\n".join(blocks)


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.lit("\x00"))


class Known:
    """The templates of the hosts met so far in a task, a bounded number of them."""

    def __init__(self, most: int = 1000):
        self.most, self.held = most, {}

    def of(self, host: str, make) -> Template:
        if host not in self.held:
            if len(self.held) >= self.most:
                self.held.clear()
            self.held[host] = make()
        return self.held[host]


SLOTS = "host string, element long, parent long, class int, gap int, size double, links double, headings double, article double"


def slot_statistics(pages: DataFrame) -> DataFrame:
    """Per host and slot: shares of the pages' data, added up; from (host, html, classes, texts). Class -2 tells of a parent only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Known()
        for batch in batches:
            held: dict[tuple, list[float]] = {}
            for k, host in enumerate(batch.column(0).to_pylist()):
                template = templates.of(host, lambda k=k: template_of(batch.column(2)[k].as_py(), batch.column(3)[k].as_py()))
                page = tokens_of(batch.column(1)[k].as_py() or "")
                masses, parents = slot_masses(page, slots_of(page, template))
                total = sum(row[0] for row in masses.values()) or 1
                for (element, c, gap), row in masses.items():
                    own = held.setdefault((host, element, parents.get(element, PAGE), c, gap), [0.0] * 4)
                    for i in range(4):
                        own[i] += row[i] / total
                for element, parent in parents.items():
                    held.setdefault((host, element, parent, -2, 0), [0.0] * 4)
            if held:
                host, element, parent, c, gap = zip(*held)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(host, pa.string()), pa.array(signed(element)), pa.array(signed(parent)), pa.array(c, pa.int32()), pa.array(gap, pa.int32()), *(pa.array(x, pa.float64()) for x in zip(*held.values()))],
                    [x.split()[0] for x in SLOTS.split(", ")],
                )

    numbers = ("size", "links", "headings", "article")
    counted = pages.select("host", "html", "classes", "texts").mapInArrow(run, SLOTS).groupBy("host", "element", "parent", "class", "gap")
    return counted.agg(*[F.round(F.sum(c), 6).alias(c) for c in numbers])


def regions(slots: DataFrame) -> DataFrame:
    """host, region, in_article of each host, from its slots (as many as its template has)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for own in batch.column(1):
                masses, parents = {}, {}
                for x in own.as_py():
                    if x["element"]:
                        parents[x["element"]] = x["parent"]
                    masses[x["element"], x["class"], x["gap"]] = [x["size"], x["links"], x["headings"], x["article"]]
                found.append(article_region(masses, parents))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r or 0 for r in found], pa.int64()), pa.array([r is None for r in found])], ["host", "region", "in_article"])

    own = F.sort_array(F.collect_list(F.struct("element", "parent", "class", "gap", "size", "links", "headings", "article")))
    return slots.groupBy("host").agg(own.alias("own")).mapInArrow(run, "host string, region long, in_article boolean")


def host_templates(pages: DataFrame) -> DataFrame:
    """host, classes, texts, region, in_article of every host of (host, number, html)."""
    statistics = materialize(page_statistics(pages), "statistics")
    classes = materialize(class_templates(statistics), "classes")
    slots = materialize(slot_statistics(pages.join(classes, "host", "left")), "slots")
    return materialize(regions(slots).join(classes, "host", "left").select("host", "classes", "texts", "region", "in_article"), "templates")


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host_of(F.col("url")).alias("host"), "html")
    known = host_templates(own.withColumn("number", F.xxhash64("page_id", "url")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Known()
        for batch in batches:
            classes, texts, region, in_article = (batch.column(k) for k in range(4, 8))
            out = []
            for k, host in enumerate(batch.column(2).to_pylist()):
                template = templates.of(host, lambda k=k: template_of(classes[k].as_py(), texts[k].as_py(), None if in_article[k].as_py() else region[k].as_py() or PAGE))
                out.append(main_text(batch.column(3)[k].as_py() or "", template))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array(list(map(len, out)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    joined = own.join(known, "host", "left").select("page_id", "url", "host", "html", "classes", "texts", "region", "in_article")
    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op3_template_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
