r"""Main text of web pages by template deduction from equivalence classes.

1. Every page is read as a sequence of tokens: opening tags with their path of containers (names, with
   ids and classes without their numbers). For each such token a page gives its number of occurrences, and
   a hash of the text up to the next token.
2. For each host, pages are counted by token and text, over all pages. Tokens that stand once on a page, on most
   pages, are the class that makes the host's template; classes of other occurrence vectors aren't used,
   and classes aren't nested: a token's path says where it stands.
3. A slot's text that is the same on nearly all pages though their articles differ belongs to
   the template, and is left out where a page has that very text. The main text is chosen by tag names:
   what stands in a page's ``article`` containers, without any in ``main``; without such a
   container, in the container with the most text that varies over the host's pages, or the
   outermost around it that holds varying paragraphs of its own.
4. Every page is cut along its host's template and the text of the main slots is written out.

Menus, headers and footers of the page, sidebars, notices, adverts, forms, scripts, styles and comments
are left out by their tags and by the words in their ids and classes, inside the article too (paragraphs, headings and
items that bear such a name, and articles that are comments or adverts); the header of an article itself stays. Blocks are cut at block tags and ``br``.

Only counts of tokens and texts are exchanged, added up beforehand, never pages; a hot host costs no more.
Defined cases: null or empty html gives an empty text; a page without a url is a host of its own kind
(the empty host); unclosed tags end with their container, a cut-off tag is markup; pages of a host with one page use
the template of that page; repeated rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: A text on at least LEAST pages and this share of those with its role belongs to the template.
LEAST, NEARLY_ALL = 4, 0.9
#: So many templates (a few hundred bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_HOSTS = 50_000

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(script|style|textarea|title)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>(?:(?<!/>)|(?=[^<]*</\1)).*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|</?[a-zA-Z][^>]*\Z",
    re.S | re.I,
)
ATTR = re.compile(r"(?<![-\w])(id|class|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("html head body div section article main aside nav header footer form ul ol dl table figure blockquote fieldset dialog menu details".split())
#: Left out as a whole; written ``<svg/>`` they are complete, left open they end with the block or container they stand in.
WIDGETS = frozenset("button foreignobject iframe noscript select svg template".split())
#: Those of them that stand within a line.
FLOWING = frozenset("button select svg".split())
#: Opening tags that end an open svg, as in browsers.
LEAVES_SVG = frozenset("blockquote body center dd div dl dt h1 h2 h3 h4 h5 h6 head hr li menu ol p pre table ul article main section".split())
COMPLETE = re.compile(r"(?:^|[\s\"'])/\s*$|^[^=]*/\s*$")
DROPPED = frozenset("head nav footer aside form menu dialog fieldset".split())
#: Words in names (ids, classes, roles) of left-out parts. Fixed values.
SURE = re.compile(
    r"ads?|advert\w*|adsense|sponsor\w*|promo\w*|consent|gdpr|newsletter|subscri\w*|signup|sidebar|nav(?:s|bar|box|igation|links?|menu)?|breadcrumbs?|pagination|pager|toolbar"
    r"|related|recommend\w*|comments?|disqus|footer|masthead|topbar|popup|modal|overlay|complementary|contentinfo"
)
#: Words that begin names of content as well (side-effects, share-price): they count alone, as the last word, or beside words of LAYOUT.
UNSURE = re.compile(r"banner|cookies?|notice|alert|login|side|widget|menu|share|sharing|social|discussion|repl(?:y|ies)|respond|search")
LAYOUT = frozenset(
    "area bar block body bottom box btn button buttons col column container content count danger error field form group header holder icon icons info inner input item items left link links list"
    " main message outer page pane panel primary rail right row secondary section site slot small strip success text title toggle tools top tray unit warning wrap wrapper".split()
)
#: An ``article`` is left out only for a whole name of these.
NO_ARTICLE = re.compile(r"ads?|advert\w*|sponsored|promo|comments?|repl(?:y|ies)")
CELLS = frozenset("caption tbody td tfoot th thead tr".split())
HEADER = re.compile(r"(?:^|[-_\s])header(?=$|[-_\s])", re.I)


GRID = re.compile(r"(?:col|span|grid|row|w|m|p)(?:-[a-z]+)*-?\d{1,2}", re.I)


@lru_cache(maxsize=65_536)
def chrome(name: str) -> bool:
    """Whether an id, class or role names a part to leave out."""
    words = [w for w in re.split(r"[-_]+", name.lower()) if w and not w.isdigit()]
    if not words or (len(words) > 1 and words[0] in ("with", "without", "has", "no", "is")):
        return False
    if any(SURE.fullmatch(w) for w in words):
        return True
    unsure = [bool(UNSURE.fullmatch(w)) for w in words]
    return any(unsure) and ((unsure[-1] and words[-1] != "side") or all(u or w in LAYOUT for u, w in zip(unsure, words, strict=True)))


def marks_of(attributes: str) -> list[str]:
    return " ".join(v[1] or v[2] or v[3] for v in ATTR.findall(attributes)).split() if attributes else []


def own_digits(mark: str) -> str:
    """An id or class without the numbers that only one page has (post-7817): they read as 0; columns of a grid keep theirs."""
    return mark if GRID.fullmatch(mark) else re.sub(r"\d+", "0", mark)


def under(path: str, places: Iterable[str]) -> bool:
    return any(path == p or path.startswith(p + ">") for p in places)


def named(roles: Iterable[str]) -> list[str]:
    """The article containers of a page, without any its main containers. They bear no ids or classes in their role."""
    opened = {r for r in roles if not r.endswith("/")}
    return next((found for name in ("article", "main") if (found := sorted(r for r in opened if r.rsplit(">", 1)[-1] == name))), [])


def walk(html: str) -> Iterator[tuple[str, str, bool, bool]]:
    """(token, text, breaks, dropped): each token's role, the text after it, whether it ends a block,
    and whether the text stands in something to leave out."""
    stack: list[tuple[str, str, bool, bool, str]] = []  # name, path, dropped, inside article, block it stands in
    at, role, breaks, block = 0, "", True, ""
    leaf = False  # in a left-out paragraph, heading or item
    for m in TAG.finditer(html):
        text = html[at : m.start()]
        at = m.end()
        path, dropped = (stack[-1][1], stack[-1][2]) if stack else ("", False)
        if dropped and any(x[0] in FLOWING for x in stack):
            breaks = False
        yield role or path, text, breaks, dropped or leaf
        name = m.group(3)
        if name is None:
            role, breaks = "", bool(m.group(1))
            continue
        name = name.lower()
        breaks = name not in INLINE and name not in FLOWING
        if breaks and name not in VOID and name not in WIDGETS:
            leaf = False
        role = ""
        while stack and (top := stack[-1][0]) in WIDGETS:
            if name == block or (not m.group(2) and (name in LEAVES_SVG if top == "svg" else name == top in ("button", "select"))):
                block = stack.pop()[4]
            else:
                break
        if stack:
            path, dropped = stack[-1][1], stack[-1][2]
        else:
            path, dropped = "", False
        if m.group(2):
            if any(s[0] == name for s in stack):
                while (closed := stack.pop())[0] != name:
                    pass
                role, block = "" if name in WIDGETS else f"{closed[1]}/", closed[4]
            elif name == block:
                block = ""
        elif name in WIDGETS:
            if not COMPLETE.search(m.group(4)):
                stack.append((name, f"{path}>{name}", True, bool(stack and stack[-1][3]), block))
        elif name in CONTAINERS and name not in VOID:
            marks = marks_of(m.group(4))
            inside = name in ("article", "main") or bool(stack and stack[-1][3])
            whole_page = name in ("html", "body", "main", "article")
            label = name + ("." + ".".join(sorted({own_digits(m) for m in marks})) if marks and not whole_page else "")
            path = f"{path}>{label}"
            out = dropped or name in DROPPED or (name == "header" and not inside)
            if name == "article":
                out = out or any(NO_ARTICLE.fullmatch(m.lower()) for m in marks)
            out = out or (not whole_page and any(chrome(m) or (not inside and HEADER.search(m)) for m in marks))
            stack.append((name, path, out, inside, block))
            role, block = path, ""
        elif breaks and name not in VOID:
            role = f"{path}>{name}"
            leaf = name not in CELLS and any(map(chrome, marks_of(m.group(4))))
            if not (stack and stack[-1][0] in WIDGETS):
                block = name
    path, dropped = (stack[-1][1], stack[-1][2]) if stack else ("", False)
    yield role or path, html[at:], breaks, dropped or leaf


def text_hash(texts: Iterable[str]) -> int:
    import xxhash

    h = xxhash.xxh3_64()
    for text in texts:
        h.update(" ".join(text.split()).encode("utf-8", "replace"))
    return h.intdigest() >> 1


def tokens_of(html: str | None) -> list[tuple[str, int, int, int, bool]]:
    """(role, count, characters, text hash, inside) of a page's tokens, left-out ones aside; ``inside``: in a named container."""
    found: dict[str, list[str]] = {}
    for role, text, _, dropped in walk(html or ""):
        if role and not dropped:
            found.setdefault(role, []).append(text)
    main = named(found)
    return [(r, len(t), sum(len(" ".join(x.split())) for x in t), text_hash(t), under(r, main)) for r, t in found.items()]


def container(role: str) -> str:
    """The container that a role's text is counted for."""
    path = role.rstrip("/")
    return path if path.rsplit(">", 1)[-1].split(".")[0] in CONTAINERS else path.rsplit(">", 1)[0]


def own_main(html: str) -> list[str]:
    """The main container of a page by itself: the one with the most text, or the outermost around it that holds paragraphs of its own."""
    held: Counter[str] = Counter()
    prose: set[str] = set()
    for role, _, chars, _, _ in tokens_of(html):
        held[container(role)] += chars
        if chars and role.endswith(">p"):
            prose.add(container(role))
    if not any(held.values()):
        return []
    best = max(held, key=lambda r: (held[r], r))
    around = [r for r in prose if best.startswith(r + ">") and r.rsplit(">", 1)[-1] not in ("html", "body")]
    return [min([*around, best], key=len)]


def main_text(html: str | None, main: list[str], fixed: list[tuple[str, int]]) -> str:
    """The text of a page's main slots, a line a block. ``fixed``: (role, text hash) of the template's texts."""
    if not html:
        return ""
    blocks: list[str] = []
    now: list[str] = []
    tokens = list(walk(html))
    seen = {r for r, _, _, dropped in tokens if not dropped}
    wanted = named(seen) or main
    if not any(under(r, wanted) for r in seen):  # a page of another make
        wanted = own_main(html)
    constant = dict(fixed)
    slots: dict[str, list[str]] = {r: [] for r in constant}
    for role, text, _, dropped in tokens:
        if role in slots and not dropped:
            slots[role].append(text)
    left_out = {r for r, t in slots.items() if len(t) == 1 and text_hash(t) == constant[r]}
    place = False
    for role, text, breaks, dropped in tokens:
        if breaks and now:
            blocks.append("".join(now))
            now = []
        if role:
            path = role.rstrip("/") if not role.endswith("/") else role[:-1].rsplit(">", 1)[0]
            place = under(path, wanted)
        if place and not dropped and text and role not in left_out:
            now.append(unescape(text))
    if now:
        blocks.append("".join(now))
    return "\n".join(b for b in (" ".join(b.split()) for b in blocks) if b)


def templates(pages: DataFrame) -> DataFrame:
    """(host, main, fixed), a row a host, from all pages: counts of (host, role, text), added up before each exchange."""

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["host", "role", "h", "pages", "once", "chars", "inside"]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        for batch in it:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                sums: dict[tuple[str, str, int], list] = {}
                for host, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    for role, n, chars, h, inside in [("", 1, 0, 0, False), *tokens_of(html)]:
                        t = sums.setdefault((host, role, h), [0, 0, 0, False])
                        t[0] += 1
                        t[1] += n == 1
                        t[2] += chars
                        t[3] |= inside
                rows = [(*k, *v) for k, v in sums.items()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    counted = pages.select(host_of(), "html").mapInArrow(read, "host string, role string, h long, pages long, once long, chars long, inside boolean")
    texts = counted.groupBy("host", "role", "h").agg(*[F.sum(c).alias(c) for c in ("pages", "once", "chars")], F.bool_or("inside").alias("inside"))
    roles = texts.groupBy("host", "role").agg(
        F.sum("pages").alias("met"), F.count("*").alias("texts"), F.sum("chars").alias("chars"), F.bool_or("inside").alias("inside"), F.max(F.struct("once", "h")).alias("top")
    )
    roles = cut(roles, "roles")
    hosts = roles.where("role = ''").select("host", F.col("met").alias("pages"))
    roles = roles.where("role <> ''").join(hosts, "host")
    path = F.regexp_replace("role", "/+$", "")
    last = F.substring_index(path, ">", -1)
    held = F.when(F.substring_index(last, ".", 1).isin(*CONTAINERS), path).otherwise(F.expr("left(path, greatest(length(path) - length(last) - 1, 0))"))
    varied = roles.where("chars > 0 AND (texts > 1 OR pages = 1)").withColumns({"path": path, "last": last}).withColumn("place", held)
    varied = varied.groupBy("host", "place").agg(F.sum("chars").alias("chars"), F.bool_or(F.col("role").endswith(">p")).alias("prose"))
    best = varied.groupBy("host").agg(F.max(F.struct("chars", "place"))["place"].alias("best"))
    around = F.expr("place = best OR (prose AND place <> '' AND startswith(best, place || '>') AND substring_index(place, '>', -1) NOT IN ('html', 'body'))")
    main = varied.join(best, "host").where(around).groupBy("host").agg(F.min_by("place", F.length("place")).alias("main"))
    slots = roles.join(main, "host", "left").where("inside OR role = main OR startswith(role, main || '>')")
    differ = slots.groupBy("host").agg(F.max("texts").alias("differ")).where(F.col("differ") >= LEAST)
    fixed = slots.where(~F.col("role").rlike(r">h[1-6]$|>p$") & F.expr("chars > 0 AND 2 * met >= pages") & (F.col("top.once") >= LEAST) & (F.col("top.once") >= NEARLY_ALL * F.col("met")))
    fixed = fixed.join(differ, "host", "left_semi").groupBy("host").agg(F.collect_list(F.struct("role", F.col("top.h").alias("h"))).alias("fixed"))
    out = hosts.join(main, "host", "left").join(fixed, "host", "left")
    return out.select("host", F.when(F.col("main").isNotNull(), F.array("main")).otherwise(F.array().cast("array<string>")).alias("main"), "fixed")


def host_of() -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit("")).alias("host")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), one row per page."""

    def write(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                html, main, fixed = (part.column(c).to_pylist() for c in ("html", "main", "fixed"))
                texts = [main_text(h, m or [], [(x["role"], x["h"]) for x in f or []]) for h, m, f in zip(html, main, fixed, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
                )

    made = cut(templates(pages), "templates")
    side = F.broadcast(made) if made.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS else made
    joined = pages.select("page_id", "url", "html", host_of()).join(side, "host", "left").select("page_id", "url", "html", "main", "fixed")
    return joined.mapInArrow(write, "page_id long, url string, text string, n_chars long")


def query(pages: DataFrame) -> DataFrame:
    return extract(pages)
