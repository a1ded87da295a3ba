"""Main-text extraction with wrappers inferred per host.

A wrapper is a union-free regular expression over the tokens of a host's pages:
elements, each with the sequence of its children, in which an item may be optional
or repeated, and text slots. It is inferred by iterative alignment. A page is a
wrapper at first, its runs of like siblings folded into one repeated item. Two
wrappers are aligned level by level along a longest common sequence of their items
(tag and class); items on one side only become optional, aligned ones are merged
below, text against other text is a slot; text that is the same on most pages of
the host is template.

Pages with the same folded form are counted once before anything is merged, so a
host with a third of all pages is merged from its few forms, in a tree of salted
groups. Which texts are template is counted per host and text, pre-aggregated.

The wrapper decides, per host, which of its elements may hold the main text: the
article, main or content elements, and the elements that hold most text in
paragraphs. A page's text stands below the first of them that it holds, without menus, headers, footers, asides, forms, scripts, notices,
adverts and comments, told by tag, role, class and id, and without what the
template has, whatever it is named. A page is then read along its host's wrapper.
"""

from __future__ import annotations

import html as html_lib
import json
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.scratch import Scratch
from tessella.llm.textkit import slices

SALTS = (256, 16)
DEPTH = 60  # elements deeper than this have no place of their own in a wrapper; their text belongs to the one above
FOLD_AT = 40
TEMPLATE_PAGES, TEMPLATE_SHARE = 4, 0.5

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe template xmp".split())
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody "
    "td tfoot th thead tr ul".split()
)
_CLOSES_P = _BLOCKS - frozenset("body caption dd dt head html legend li option select tbody td tfoot th thead tr".split())
#: Elements that end an open element of the listed names, up to a border.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
_DROP_TAGS = frozenset("head script style noscript template iframe svg math canvas object embed nav footer aside form button select input textarea title menu dialog search".split())
_DROP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar aside footer header masthead cookie cookies consent notice notices alert popup modal newsletter subscribe subscription share "
    "sharing social related recommended comment comments reply replies respond disqus pagination pager widget toolbar login signup hidden".split()
)
#: Whole names that mean the same, without hyphens and underscores.
_DROP_NAMES = {
    name: word
    for word, names in {
        "ads": "adbox adcontainer adslot adunit adsense adbanner adwrapper advertbox advertblock",
        "comments": "commentlist commentslist commentsection commentssection commentsarea commentform commentthread commentbox commentrespond",
        "cookie": "cookienotice cookiebanner cookiebar cookieconsent cookiepolicy cookiepopup",
        "sidebar": "sidebarleft sidebarright leftsidebar rightsidebar primarysidebar sidebarprimary sidebarwidget",
        "sponsor": "sponsoredcontent sponsoredpost sponsors",
        "newsletter": "newslettersignup newsletterform newsletterbox",
        "footer": "sitefooter pagefooter footernav footerlinks footerwidgets",
        "header": "siteheader pageheader topheader",
        "navbar": "navigationbar navmenu mainnav mainmenu sitenav topnav sitenavigation mainnavigation postnavigation navlinks sitemenu",
        "breadcrumb": "breadcrumbnav breadcrumblist breadcrumbtrail",
        "banner": "topbanner adsbanner bannerad promobanner",
        "promo": "promobox promotion promoted",
        "disqus": "disqusthread",
        "related": "relatedposts relatedarticles relatedcontent relatedstories relatedlinks",
        "share": "sharebuttons sharebar sharelinks sharetools socialshare sharing sharethis socialsharing",
        "social": "sociallinks socialmedia socialicons socialbuttons",
        "hidden": "visuallyhidden ishidden",
    }.items()
    for name in names.split()
}
_MAIN_WORDS = frozenset("article content main post entry story".split())
_MAIN_NAMES = {
    name: word
    for word, names in {
        "article": "articlebody articlecontent articletext articlemain mainarticle",
        "content": "contentbody contentmain pagecontent bodycontent sitecontent contentarea primarycontent",
        "main": "maincontent maincontents maintext maincontainer mainbody",
        "post": "postbody postcontent posttext blogpost",
        "entry": "entrycontent entrybody",
        "story": "storybody storycontent storytext",
    }.items()
    for name in names.split()
}

_TOKEN = re.compile(
    r"<!--(?:.*?(?:-->|--!>)|.*)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*+(?:>|$)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(>|$|(?=[\"']))",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))")


def _marks(attributes: str) -> dict[str, str]:
    found = {}
    if "=" in attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return found


def _known(name: str) -> str | None:
    """A whole class, id or role name as the word that counts, if it does; hyphens, underscores and case aside."""
    plain = re.sub(r"[-_]+", "", name.lower())
    if plain in _DROP_WORDS or plain in _MAIN_WORDS:
        return plain
    return _DROP_NAMES.get(plain) or _MAIN_NAMES.get(plain)


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, detail): text with its raw characters, start with a label, end. Comments and raw text vanish."""
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            yield "text", "", page[at:]
            return
        if m.start() > at:
            yield "text", "", page[at : m.start()]
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            yield "end", name, ""
            continue
        marks = _marks(m[3])
        named = {_known(w) for k in ("class", "id", "role") if k in marks for w in marks[k].split()}
        words = sorted(named - {None})
        if "hidden" in m[3].lower() and "hidden" in re.findall(r"[a-z-]+", re.sub(r"\"[^\"]*\"|'[^']*'", "", m[3]).lower()):
            words.append("hidden")
        yield "start", name, ".".join([name, *words])
        if name in _RAW:
            close = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = close.end() if close else n
            yield "end", name, ""


def walk(page: str) -> Iterator[tuple[str, str, str]]:
    """Tokens with implied ends put in: open and close come in pairs, text in between. Each token takes constant time, however deep."""
    stack: list[tuple[str, str]] = []
    at: dict[str, list[int]] = defaultdict(list)  # where elements of a name are open
    blocks: list[int] = []  # where blocks other than p are open

    def last(name: str) -> int:
        return at[name][-1] if at[name] else -1

    def close_to(depth: int):
        while len(stack) > depth:
            name = stack[-1][0]
            at[name].pop()
            if blocks and blocks[-1] == len(stack) - 1:
                blocks.pop()
            yield "close", *stack.pop()

    for kind, name, detail in tokens(page):
        if kind == "text":
            yield "text", "", detail
        elif kind == "start":
            if name in _CLOSES_P and at["p"]:
                yield from close_to(last("p"))
            elif name in _ENDS:
                ends, borders = _ENDS[name]
                border = max(map(last, borders))
                inside = [at[e][k] for e in ends if (k := bisect_right(at[e], border)) < len(at[e])]
                yield from close_to(min(inside, default=len(stack)))
            yield "open", name, detail
            if name in _VOID:
                yield "close", name, detail
            else:
                at[name].append(len(stack))
                if name in _BLOCKS and name != "p":
                    blocks.append(len(stack))
                stack.append((name, detail))
        elif (own := last(name)) >= 0 and (name in _BLOCKS or not blocks or blocks[-1] < own):
            yield from close_to(own)
    yield from close_to(0)


# A wrapper node is [label, flags, children]; flags: 1 optional, 2 repeated. A text slot is ["#", flags, []].


def _fold(children: list) -> list:
    """Runs of like siblings (of one item, or of two that alternate) become one repeated item each.

    Among more than FOLD_AT items left, all of one label become one, at its first place.
    """
    out: list = []
    for child in children:
        if out and out[-1][0] == child[0]:
            out[-1] = _merge(out[-1], child)
            out[-1][1] |= 2 if child[0] != "#" else 0
        elif len(out) >= 2 and out[-2][0] == child[0] and out[-2][1] & 2 | (len(out) >= 3 and out[-3][0] == out[-1][0]):
            flags = out[-2][1] | 2
            out[-2] = _merge(out[-2], child)
            out[-2][1] |= flags
        else:
            out.append(child)
    if len(out) <= FOLD_AT:
        return out
    first: dict[str, list] = {}
    for child in out:
        if child[0] not in first:
            first[child[0]] = child
        else:
            flags = first[child[0]][1] | (2 if child[0] != "#" else 0)
            first[child[0]] = _merge(first[child[0]], child)
            first[child[0]][1] |= flags
    return list(first.values())


def _align(a: list, b: list) -> list[tuple[int | None, int | None]]:
    """Longest common sequence of labels, with what stands on one side only in page order."""
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i][0] == b[j][0] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i][0] == b[j][0]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif j == m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            out.append((i, None))
            i += 1
        else:
            out.append((None, j))
            j += 1
    return out


def _merge(a: list, b: list) -> list:
    children = []
    for i, j in _align(a[2], b[2]):
        if i is None or j is None:
            only = a[2][i] if j is None else b[2][j]
            children.append([only[0], only[1] | 1, only[2]])
        else:
            children.append(_merge(a[2][i], b[2][j]))
    return [a[0], a[1] | b[1], _fold(children)]


def page_wrapper(events: Iterable[tuple[str, str, str]]) -> list:
    """The folded form of one page, from its tokens, down to DEPTH elements."""
    root: list = ["", 0, []]
    path = [root]
    deeper = 0
    for kind, _, detail in events:
        if kind == "open":
            if len(path) > DEPTH:
                deeper += 1
                continue
            node = [detail, 0, []]
            path[-1][2].append(node)
            path.append(node)
        elif kind == "close":
            if deeper:
                deeper -= 1
                continue
            path[-1][2] = _fold(path[-1][2])
            path.pop()
        elif not detail.isspace():
            path[-1][2].append(["#", 0, []])
    root[2] = _fold(root[2])
    return root


def merge_wrappers(a: list, b: list) -> list:
    return _merge(a, b)


def as_pattern(node: list) -> str:
    """The wrapper as a regular expression in words."""
    inner = " ".join(map(as_pattern, node[2]))
    body = "#text" if node[0] == "#" else f"<{node[0]}> {inner} </{node[0].split('.')[0]}>" if node[0] else inner
    return {0: body, 1: f"( {body} )?", 2: f"( {body} )+", 3: f"( {body} )*"}[node[1]]


def _dropped(label: str) -> bool:
    name, *words = label.split(".")
    if name in _DROP_TAGS:
        return True
    if name in ("html", "body", "main"):
        return False
    if name == "article" and not set(words) & {"comment", "comments", "reply", "replies", "ad", "ads", "advert", "related", "recommended", "promo", "sponsor", "sponsored"}:
        return False
    return bool(set(words) & _DROP_WORDS)


def content_paths(wrapper: list) -> Regions:
    """The element paths of a wrapper below which main text may stand, best first."""
    roots: list[tuple[int, str]] = []

    def weigh(node: list) -> int:
        """Paragraph slots below a node, as a measure where no element is named for the main text."""
        return sum((3 if c[1] & 2 else 1) if c[0].split(".")[0] in ("p", "pre", "blockquote") else 0 for c in node[2] if not _dropped(c[0]))

    def look(node: list, path: str, bad: bool):
        for child in node[2]:
            if child[0] == "#":
                continue
            here = f"{path}/{child[0]}"
            name, *words = child[0].split(".")
            drop = _dropped(child[0])
            if not drop:
                rank = 3 if name == "article" else 2 if name == "main" or "main" in words else 1 if set(words) & _MAIN_WORDS and not bad else 0
                if rank and not (rank == 1 and bad):
                    roots.append((rank, here))
            look(child, here, bad or drop)

    look(wrapper, "", False)
    weights: dict[str, int] = {}

    def weigh_all(node: list, path: str):
        weights[path] = max(weights.get(path, 0), weigh(node))
        for child in node[2]:
            if child[0] != "#" and not _dropped(child[0]):
                weigh_all(child, f"{path}/{child[0]}")

    weigh_all(wrapper, "")

    def marked(chosen: set[str]) -> dict[str, bool]:
        out: dict[str, bool] = {}

        def mark(node: list, path: str, inside: bool, bad: bool):
            inside, bad = (True, False) if path in chosen else (inside, bad)
            out[path] = inside and not bad
            for child in node[2]:
                if child[0] != "#":
                    name = child[0].split(".")[0]
                    drop = _dropped(child[0]) or (name == "header" and not inside)
                    mark(child, f"{path}/{child[0]}", inside, bad or drop)

        mark(wrapper, "", False, False)
        return out

    named = [{p for k, p in roots if k == rank} for rank in (3, 2, 1)]
    heavy = sorted((p for p, w in weights.items() if w), key=lambda p: -weights[p])
    return Regions([(c, marked(c)) for c in named if c], heavy, marked)


@dataclass
class Regions:
    """Where a host's main text may stand: named roots by rank, then paths by weight; each set of roots with what it keeps."""

    named: list[tuple[set[str], dict[str, bool]]]
    heavy: list[str]
    marked: Callable[[set[str]], dict[str, bool]]
    by_path: dict[str, dict[str, bool]] = field(default_factory=dict)

    def below(self, path: str) -> dict[str, bool]:
        if path not in self.by_path:
            self.by_path[path] = self.marked({path})
        return self.by_path[path]


def _blocks(events: Iterable[tuple[str, str, str]], paths: dict[str, bool] | None = None) -> list[str]:
    """The texts of a page's blocks in the paths kept, or of all of them."""
    blocks: list[str] = []
    own: list[str] = []
    open_paths = [""]
    keep = [paths is None or paths.get("", False)]

    def flush():
        if own and (text := " ".join("".join(own).split())):
            blocks.append(text)
        own.clear()

    for kind, name, detail in events:
        if kind == "text":
            if keep[-1]:
                own.append(html_lib.unescape(detail))
        elif kind == "open":
            if name in _BLOCKS:
                flush()
            elif name == "br":
                own.append(" ")
            # Below DEPTH, elements have no path of their own in the wrapper.
            path = f"{open_paths[-1]}/{detail}" if len(open_paths) <= DEPTH else None
            open_paths.append(path)
            inherited = keep[-1] if paths is None else keep[-1] and not _dropped(detail)
            keep.append(paths.get(path, inherited) if paths is not None and path is not None else inherited)
        else:
            if name in _BLOCKS:
                flush()
            open_paths.pop()
            keep.pop()
    flush()
    return blocks


def _read(events: list[tuple[str, str, str]], paths: dict[str, bool], template: frozenset[int] = frozenset()) -> str:
    """The text of a page's tokens in the paths kept, without the blocks that belong to the template."""
    blocks = _blocks(events, paths)
    return "\n".join(b for b in blocks if _code(b) not in template) if template else "\n".join(blocks)


def _code(text: str) -> int:
    """A 64-bit hash of a block's text."""
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _paths(events: list[tuple[str, str, str]]) -> set[str]:
    here, found = [""], {""}
    for kind, _, detail in events:
        if kind == "open":
            here.append(f"{here[-1]}/{detail}" if len(here) <= DEPTH else here[-1])
            found.add(here[-1])
        elif kind == "close":
            here.pop()
    return found


def extract(page: str, regions: Regions, template: frozenset[int] = frozenset()) -> str:
    """The main text of a page read along its host's wrapper, less the texts of the host's template.

    The roots of the highest rank that the page holds count, unless those of a
    lower rank hold more than twice their text, as a main part beside a teaser
    does. A page without named roots, or without text in them, is read below the
    heaviest path of the wrapper that it holds and that has text, in the end as a
    whole.
    """
    events = list(walk(page))
    held = _paths(events)
    text = ""
    for roots, kept in regions.named:
        if roots & held and len(other := _read(events, kept, template)) > 2 * len(text):
            text = other
    if text:
        return text
    for path in regions.heavy:
        if path in held and (text := _read(events, regions.below(path), template)):
            return text
    return _read(events, regions.below(""), template)


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without port; empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


_FORMS = "host string, form string, page long, codes array<long>"


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "html"):
        forms, page_codes, codes = [], [], []
        for page in b.column(1).to_pylist():
            events = list(walk(page or ""))
            forms.append(json.dumps(page_wrapper(events), separators=(",", ":")))
            own = [_code(t) for t in _blocks(events)]
            page_codes.append(_code(repr(own)))
            codes.append(sorted(set(own)))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(forms, pa.string()), pa.array(page_codes, pa.int64()), pa.array(codes, pa.list_(pa.int64()))], names=["host", "form", "page", "codes"])


def _folded(keys: int):
    """Merge runs of rows that agree in the first ``keys`` columns, one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, whole, names = None, None, None

        def row():
            cols = [pa.array([x]) for x in now] + [pa.array([json.dumps(whole, separators=(",", ":"))])]
            return pa.RecordBatch.from_arrays(cols, names=names)

        for b in batches:
            names = b.schema.names
            for *key, form in zip(*(b.column(k).to_pylist() for k in range(keys + 1)), strict=True):
                page = json.loads(form)
                if now is not None and now == key:
                    whole = merge_wrappers(whole, page)
                    continue
                if now is not None:
                    yield row()
                now, whole = key, page
        if now is not None:
            yield row()

    return run


def page_forms(pages: DataFrame) -> DataFrame:
    """host, form, a code of the page's whole text and the codes of its blocks, of every page."""
    return pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(_forms, _FORMS)


def infer_wrappers(forms: DataFrame) -> DataFrame:
    """host, form: the wrapper of every host, from all its pages' forms, merged in a tree."""
    rows = forms.select("host", "form").distinct()
    for width in SALTS:
        salted = rows.select("host", F.pmod(F.xxhash64("form"), F.lit(width)).cast("long").alias("salt"), "form")
        rows = salted.repartition("host", "salt").sortWithinPartitions("host", "salt", "form").mapInArrow(_folded(2), "host string, salt long, form string")
    return rows.select("host", "form").repartition("host").sortWithinPartitions("host", "form").mapInArrow(_folded(1), "host string, form string")


def templates(forms: DataFrame) -> DataFrame:
    """host, template: the codes of block texts that are alike on most pages of a host.

    Text aligned with the same text is template, with other text a slot. Pages with
    the same text throughout count once, and a text is template if it stands on
    TEMPLATE_PAGES of the different pages at least, and on more than TEMPLATE_SHARE of them all.
    """
    pages = forms.groupBy("host", "page").agg(F.first("codes").alias("codes"))
    total = pages.groupBy("host").agg(F.count("*").alias("pages"))
    counts = pages.select("host", F.explode("codes").alias("code")).groupBy("host", "code").agg(F.count("*").alias("n")).where(F.col("n") >= TEMPLATE_PAGES)
    common = counts.join(total, "host").where(F.col("n") > TEMPLATE_SHARE * F.col("pages"))
    # A page of k blocks has its share of these rows: at most k / TEMPLATE_SHARE codes a host, for pages of k blocks.
    return common.groupBy("host").agg(F.sort_array(F.collect_list("code")).alias("template"))


_PARSED_LIMIT = 256


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, tuple[Regions, frozenset[int]]] = {}
    for b in slices(batches, "html"):
        out = []
        for host, page, form, template in zip(*(b.column(k) for k in (5, 2, 3, 4)), strict=True):
            name = host.as_py()
            if name not in known:
                if len(known) >= _PARSED_LIMIT:
                    known.clear()
                known[name] = content_paths(json.loads(form.as_py())), frozenset(template.as_py() or ())
            out.append(extract(page.as_py() or "", *known[name]))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages``.

    Null html is empty and has no text; a null or unreadable url belongs to the
    host "" and its pages share a wrapper. Hosts of fewer than TEMPLATE_PAGES
    different pages have no template; their pages are read by structure and names
    alone. Repeated rows come back each. Other columns are not read.
    """
    scratch = Scratch(pages.sparkSession, "wrappers")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    forms = scratch.keep(page_forms(rows), "forms")
    wrappers = scratch.keep(infer_wrappers(forms).join(templates(forms), "host", "left"), "wrappers")
    scratch.drop("forms")
    with_host = rows.withColumn("host", host_of(F.col("url"))).join(wrappers, "host", "left")
    return with_host.select("page_id", "url", "html", "form", "template", "host").mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
