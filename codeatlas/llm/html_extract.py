"""Main text of web pages by equivalence-class template deduction.

1. Every page is read once into nodes (paths of nested tags, with how often each occurs and how much text is below it) and
   pieces of text (each with its node and its block); both are stored.
2. Pages are grouped by host; pages of hosts with fewer than ``MIN_PAGES`` are grouped by their layout (the set of their paths) instead.
   Tokens of a page are its nodes and its pieces (node and text). For each group and token an occurrence vector over the
   group's pages is fingerprinted: two sums of hashes of (page, count), aggregates with map-side combining, so that a hot
   host never meets in one task. Tokens of a group with the same fingerprint form an equivalence class.
3. A class is valid if it has two tokens or more and occurs in at least half of the group's pages. Tokens hold their path, so classes nest in
   each other along the paths. The valid classes are the group's template; at most twice the tokens of an average page are in it.
4. The template's main slot is found from the root: it is entered child by child as long as a child container of a valid class
   holds half of the group's text or more, not counting text that the template repeats. It ends at an ``article`` or ``main``, or where the
   heading stands, so that heading and lead stay.
5. A page's text is what it has in its template's main slot, without the blocks that the template repeats there. In an ``article`` or ``main``
   the support must be stronger for that, ``INSIDE_PAGES`` pages and ``INSIDE_SUPPORT`` of the group's, so that text which happens to be on all pages of a
   small host is not lost; whole blocks go only, so that no sentence loses a word between tags. A page of which nothing
   would remain (all pages of its host are copies) keeps its texts.

Names of tags, roles and classes supplement this: inside the main slot they mark notices, forms, adverts and comments, and a page
without a main slot (no template, no dominating slot, or a page of another kind) is read by them alone: the outermost ``article`` and
``main`` containers in page order, or the body without template texts.

Templates go to the pages by broadcast while they hold at most ``BROADCAST_TOKENS`` tokens in all (measured on the written
table), else by a join on the group.

Defined results: null or empty html gives an empty text; a page without a host in its url is grouped by its layout; rows that
repeat a page count each; markup that is cut off or badly nested is read as far as it goes; an empty table gives none.
"""

from __future__ import annotations

import html as htmllib
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeatlas.llm.arrow import free_name, map_slices
from codeatlas.sources.scratch import durable

MIN_PAGES, SUPPORT, MIN_TOKENS, BROADCAST_TOKENS = 3, 0.5, 2, 500_000
INSIDE_PAGES, INSIDE_SUPPORT, MAIN_SHARE = 10, 0.9, 0.5
PIECE, NAMED, HEADING, FRAME, LEAF, CONTAINER = range(6)

# Kinds of elements and the words in class, id and role that mark boilerplate.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|iframe|svg|textarea|select|title"
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = set("nav footer aside form head button dialog menu label input object audio video canvas map".split())
DROPPED_OUTSIDE = {"header"}
MARKS = set(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer"
    " gdpr masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promotion related replies reply share sharing"
    " sidebar signup skip social sponsor sponsored subscribe teaser toolbar topbar widget widgets".split()
)
#: Elements that are blocks of text, not containers of an article.
LEAVES = set("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre tr figure figcaption caption summary".split())
NO_MAIN = set("ad ads advert comment comments related reply teaser".split())
ROLES = set("navigation banner complementary contentinfo search dialog form alert menu menubar".split())
CLOSED_BY = {"head": {"body"}, "p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
#: For each name the elements that its start tag closes.
CLOSES = {name: [k for k, by in CLOSED_BY.items() if name in by] for by in CLOSED_BY.values() for name in by}

MARKUP = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<(?P<raw>{RAW})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)",
    re.S | re.I,
)
ATTR = re.compile(r"([a-z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", re.I)


def events(page: str):
    """('open', name, attributes), ('close', name, None) and ('text', decoded text, None) in order."""
    at = 0
    for m in MARKUP.finditer(page):
        if m.start() > at:
            yield "text", htmllib.unescape(page[at : m.start()]), None
        at = m.end()
        if m["cdata"] is not None:
            yield "text", m["cdata"], None
        elif m["name"]:
            name = m["name"].lower()
            if m["close"]:
                yield "close", name, None
            else:
                yield "open", name, {a.lower(): x or y or z for a, x, y, z in ATTR.findall(m["attrs"])} if "=" in m["attrs"] else {}
    if at < len(page):
        yield "text", htmllib.unescape(page[at:]), None


def is_boilerplate(name: str, attrs: dict, inside: bool) -> bool:
    if name in ("html", "body"):
        return False
    if name in DROPPED or name in DROPPED_OUTSIDE and not inside:
        return True
    marked = MARKS & set(re.split(r"[^a-z0-9]+", f"{attrs.get('class', '')} {attrs.get('id', '')}".lower()))
    if name in ("article", "main"):
        return bool(marked & NO_MAIN)
    return bool(marked) or attrs.get("role", "").lower() in ROLES or attrs.get("aria-hidden") == "true"


@dataclass(slots=True)
class Page:
    """Nodes: path hash, index of the parent (-1 for the root), tag, whether names mark it, its name container, times, characters below.

    Pieces: node, block and text; a block's pieces follow each other.
    """

    path: list[int] = field(default_factory=list)
    up: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    marked: list[bool] = field(default_factory=list)
    times: list[int] = field(default_factory=list)
    chars: list[int] = field(default_factory=list)
    node: list[int] = field(default_factory=list)
    container: list[int] = field(default_factory=list)
    block: list[int] = field(default_factory=list)
    text: list[str] = field(default_factory=list)


def read_page(html: str) -> Page:
    """Nodes and pieces of a page; containers are the outermost ``article`` and ``main`` in order, 0 is outside of them."""
    page, places = Page(), {}

    def node(path, up, tag, marked):
        if path not in places:
            places[path] = len(page.path)
            for column, value in ((page.path, path), (page.up, up), (page.tag, tag), (page.marked, marked), (page.times, 0), (page.chars, 0)):
                column.append(value)
        page.times[places[path]] += 1
        return places[path]

    stack = [("", node(0, -1, "", False), 0, 0)]  # name, node, depth of marks, container
    open_at, barriers = defaultdict(list), [0]  # where in the stack each name is, and the blocks that no start tag closes
    blocks = containers = 0
    texts: list[list[str]] = []  # the parts of each piece

    def cut(to):
        """Closes all that is open from ``to`` on."""
        while len(stack) > to:
            open_at[stack.pop()[0]].pop()
        while barriers[-1] >= to:
            barriers.pop()

    last = None  # node, marks and container of the piece at hand

    for kind, name, attrs in events(html):
        if kind == "text":
            _, at, low, container = stack[-1]
            if last and last[1:] == (low > 0, container, blocks):
                texts[-1].append(name)
            elif name and not (name.isspace() and (not last or last[3] != blocks)):
                for column, value in ((page.node, at), (page.container, container), (page.block, blocks), (texts, [name])):
                    column.append(value)
                last = at, low > 0, container, blocks
            continue
        blocks += name in BLOCKS
        if name == "br" and last and last[3] == blocks:
            texts[-1].append(" ")
        if kind == "open":
            at = max((open_at[k][-1] for k in CLOSES.get(name, ()) if open_at[k]), default=0)
            if at > barriers[-1]:
                cut(at)
            _, up, low, container = stack[-1]
            marked = is_boilerplate(name, attrs, bool(container))
            if name in ("article", "main") and not low and not container:
                containers += 1
                container = containers
            path = xxhash.xxh3_64_intdigest(f"{page.path[up]}/{name}.{attrs.get('class', '')}#{attrs.get('role', '')}") - (1 << 63)
            at = node(path, up, name, marked)
            if name not in VOID:
                open_at[name].append(len(stack))
                if name in BLOCKS and name not in CLOSED_BY:
                    barriers.append(len(stack))
                stack.append((name, at, low + marked, container))
        elif open_at[name]:
            cut(open_at[name][-1])
    page.text = list(map("".join, texts))
    for at, text in zip(page.node, page.text):
        page.chars[at] += len(" ".join(text.split()))
    for at in range(len(page.path) - 1, 0, -1):  # children come after their parents
        page.chars[page.up[at]] += page.chars[at]
    return page


def piece_token(path: int, text: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{path}:{' '.join(text.split())}") - (1 << 63)


def tag_kind(tag: str) -> int:
    """What a tag means for the main slot; pieces of text have kind ``PIECE``."""
    return NAMED if tag in ("article", "main") else HEADING if tag == "h1" else FRAME if tag in ("html", "body") else LEAF if tag in LEAVES or tag == "head" else CONTAINER


def tokens_of(page: Page) -> list[tuple[int, int, int, int, int]]:
    """(token, times, path above, characters, kind): the nodes, then the pieces with a text."""
    nodes = [(p, n, page.path[u] if u >= 0 else 0, c, tag_kind(t)) for p, n, u, c, t in zip(page.path, page.times, page.up, page.chars, page.tag)][1:]
    pieces = Counter((piece_token(page.path[at], text), page.path[at], len(flat)) for at, text in zip(page.node, page.text) if (flat := " ".join(text.split())))
    return nodes + [(token, n, path, n * size, PIECE) for (token, path, size), n in pieces.items()]


def main_slot(nodes: list, pieces: list) -> tuple[int | None, int]:
    """The path and kind of the main slot, None without one: ``nodes`` are (path, above, kind, characters, valid), ``pieces`` (above, characters) what the template repeats."""
    net = {p: c for p, _, _, c, _ in nodes}
    above = {p: a for p, a, *_ in nodes}
    for at, c in pieces:
        while at in net:
            net[at] -= c
            at = above[at]
    children = defaultdict(list)
    for p, a, kind, _, valid in nodes:
        children[a if a in above else None].append((net[p], p, kind, valid))
    total = sum(c[0] for c in children[None])
    at, kind = None, FRAME
    while kind != NAMED and not any(k == HEADING for *_, k, _ in children[at]):
        best = max((c for c in children[at] if c[3] and c[2] not in (LEAF, HEADING)), default=None)
        if not best or best[0] <= 0 or best[0] < MAIN_SHARE * total:
            break
        _, at, kind, _ = best
    return (None, FRAME) if kind == FRAME else (at, kind)


def main_text(page: Page, main: int | None = None, template: set[int] = frozenset(), inside: set[int] = frozenset()) -> str:
    """The slots of the main slot, a line for each block; by names alone where there is none."""

    def rest(chosen, fixed):
        """Lines of the chosen pieces that are not fixed."""
        lines: dict[int, str] = {}
        for k in chosen:
            lines[page.block[k]] = lines.get(page.block[k], "") + ("" if fixed(k) else page.text[k])
        return [x for text in lines.values() if (x := " ".join(text.split()))]

    def handed_down(start, step):
        """A flag for each node from its parent's (``start`` for the root)."""
        flags = []
        for at, up in enumerate(page.up):
            flags.append(step(at, flags[up] if up >= 0 else start))
        return flags

    token = lambda k: piece_token(page.path[page.node[k]], page.text[k])

    def slots(chosen, known):
        chosen = list(chosen)
        by_block: dict[int, bool] = {}
        for k in chosen:
            if page.text[k].strip():
                by_block[page.block[k]] = by_block.get(page.block[k], True) and bool(known) and token(k) in known
        return rest(chosen, lambda k: by_block.get(page.block[k], False)) or rest(chosen, lambda k: False)

    every = range(len(page.text))
    if main is not None:
        within = handed_down(False, lambda at, above: above or page.path[at] == main)
        marked = handed_down(False, lambda at, above: page.path[at] != main and (above or page.marked[at]))
        found = slots((k for k in every if within[page.node[k]] and not marked[page.node[k]]), inside)
        if found:
            return "\n".join(found)
    marked = handed_down(False, lambda at, above: above or page.marked[at])
    plain = [k for k in every if not marked[page.node[k]]]
    found = slots((k for k in plain if page.container[k]), inside)
    return "\n".join(found or slots(plain, template))


def host_of(url: str | None) -> str | None:
    m = HOST.match(url or "")
    return m[1].lower() if m else None


PAGE = "path array<long>, up array<int>, tag array<string>, marked array<boolean>, times array<int>, chars array<long>, node array<int>, container array<int>, block array<int>, text array<string>"
TOKENS = "token array<long>, token_times array<int>, above array<long>, token_chars array<long>, token_kind array<int>"


def pages_read(pages: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns, the group of each page, its nodes and pieces, and its tokens."""

    def make():
        def call(htmls, urls):
            read = [read_page(h or "") for h in htmls]
            tokens = [tokens_of(p) for p in read]
            layouts = [xxhash.xxh3_64_hexdigest(str(sorted(p.path))) for p in read]
            return [host_of(u) for u in urls], layouts, *[[getattr(p, c) for p in read] for c in Page.__slots__], *[[[t[k] for t in ts] for ts in tokens] for k in range(5)]

        return call

    order = dict(x.split(" ") for x in PAGE.split(", "))
    out = "host string, layout string, " + ", ".join(f"{c} {order[c]}" for c in Page.__slots__) + ", " + TOKENS
    read = durable(map_slices(pages, keep, ["html", "url"], out, make), "html-read", "zstd")
    hosts = read.filter("host IS NOT NULL").groupBy("host").agg(F.count(F.lit(1)).alias("of")).filter(F.col("of") >= MIN_PAGES)
    hosts = durable(hosts.select("host", F.concat(F.lit("host "), "host").alias("known")), "html-hosts")
    hosts = F.broadcast(hosts) if hosts.count() <= BROADCAST_TOKENS else hosts
    return read.join(hosts, "host", "left").withColumn("group", F.coalesce("known", F.concat(F.lit("layout "), "layout"))).drop("known", "layout", "host")


def template_tokens(read: DataFrame) -> DataFrame:
    """(group, token, above, kind, chars, strong, class, valid): the tokens of at least half of a group's pages."""
    page = F.xxhash64(*[c for c in ("page_id", "url") if c in read.columns])
    rows = read.select("group", page.alias("page"), F.inline(F.arrays_zip("token", "token_times", "above", "token_chars", "token_kind")))
    mark = lambda seed: F.sum(F.pmod(F.xxhash64("page", "token_times", F.lit(seed)), F.lit(1 << 31)))
    vectors = rows.groupBy("group", "token").agg(
        mark(1).alias("v1"), mark(2).alias("v2"), F.count(F.lit(1)).alias("pages"), F.min("above").alias("above"), F.min("token_kind").alias("kind"), F.sum("token_chars").alias("chars")
    )
    groups = read.groupBy("group").agg(F.count(F.lit(1)).alias("of"))
    often = vectors.filter(F.col("pages") >= MIN_PAGES).join(groups, "group").filter(F.col("pages") >= SUPPORT * F.col("of"))
    strong = (F.col("pages") >= INSIDE_PAGES) & (F.col("pages") >= INSIDE_SUPPORT * F.col("of"))
    often = durable(often.select("group", "token", "above", "kind", "chars", strong.alias("strong"), F.xxhash64("v1", "v2", "pages").alias("class")), "html-tokens")
    sizes = often.groupBy("group", "class").agg((F.count(F.lit(1)) >= MIN_TOKENS).alias("valid"))
    return often.join(sizes, ["group", "class"])


def templates(read: DataFrame) -> DataFrame:
    """(group, main, tokens, inside, n_template): the main slot, the repeated pieces, those with strong support, and the size of each template."""
    tokens = template_tokens(read)
    node = F.when(F.col("kind") != PIECE, F.struct("token", "above", "kind", "chars", "valid"))
    piece = F.when((F.col("kind") == PIECE) & F.col("valid"), F.struct("token", "above", "chars", "strong"))
    listed = tokens.groupBy("group").agg(F.collect_list(node).alias("nodes"), F.collect_list(piece).alias("pieces"), F.count_if("valid").alias("n_template"))

    def make():
        def one(nodes, pieces):
            main, kind = main_slot([tuple(n.values()) for n in nodes], [(p["above"], p["chars"]) for p in pieces])
            frame = main is not None and kind != NAMED
            return main, sorted(p["token"] for p in pieces), sorted(p["token"] for p in pieces if p["strong"] or frame)

        return lambda nodes, pieces: list(zip(*map(one, nodes, pieces)))

    return map_slices(listed, ["group", "n_template"], ["nodes", "pieces"], "main long, tokens array<long>, inside array<long>", make)


def extract(pages: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns, ``text`` and ``n_template``, the number of tokens of the page's template."""
    kept = F.struct(*[F.col(c) for c in keep]).alias("kept")  # whatever the columns are called
    read = pages_read(pages.select(kept, "page_id", "url", "html"), ["kept", "page_id", "url"])
    found = durable(templates(read), "html-templates")
    size = found.agg(F.sum(F.size("tokens") + F.size("inside") + 1)).first()[0] or 0
    found = F.broadcast(found) if size <= BROADCAST_TOKENS else found
    joined = read.join(found, "group", "left").withColumn("n_template", F.coalesce("n_template", F.lit(0)))
    names = [free_name(pages.select(*keep), c) for c in ("text", "n_template")]

    def make():
        sets: dict[str, tuple[set, set]] = {}

        def one(group, main, tokens, inside, *columns):
            if group not in sets:
                if len(sets) > 500:
                    sets.clear()
                sets[group] = set(tokens or ()), set(inside or ())
            return main_text(Page(*columns), main, *sets[group])

        return lambda texts, *columns: ([one(*x) for x in zip(*columns)],)

    made = map_slices(joined, ["kept", "n_template"], ["text", "group", "main", "tokens", "inside", *Page.__slots__], "main_text string", make)
    return made.select("kept.*", F.col("main_text").alias(names[0]), F.col("n_template").alias(names[1]))


def report(pages: DataFrame) -> DataFrame:
    return extract(pages, ["page_id", "url"]).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_template")
