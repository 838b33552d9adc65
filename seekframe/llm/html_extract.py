"""Main text of web pages by equivalence-class template deduction (operator 8).

A page is a list of tokens: its tags, told apart by their path, and its pieces of text.
Over the pages of one host each token has an occurrence vector, how often it stands in
each page; tokens of one vector form an equivalence class.

1. The vectors of all tokens are summed up.  The class of those that stand exactly once in
   every page is the root of the template: its tokens, in order, cut a page into slots.
2. A class of other vectors is nested if it holds a tag and a second token, and stands in
   half of the pages at least.  The pages are read again, to see whether the root's tokens
   keep their order in each (those that don't are no template), and whether all tokens of a
   nested class stand in one slot of the root, always the same; a class that doesn't is not
   valid.  Tokens of valid classes, the nested ones within the root's slots, are the template.
   In the same pass it is summed up how much of each slot of the root is links.
3. The slots of each page are extracted: of the article (``article``, ``main`` or their
   roles, all where there is none) what lies under no element that is by its name, role or
   class a menu, header, footer, sidebar, notice, advert, form, script, style or comment
   section.  The template decides what else goes: blocks whose text is all part of it, and
   slots that over the host's pages hold mostly links, two or more a page.

A class that says what a page has or lacks (``with-sidebar``, ``no-ads``) marks nothing, and
a marked element around the only article does not take it along.

Vectors are never gathered: a vector's fingerprint is the sum of its counts, each times a
random number of its page, so it is added up like any other count, and a host with a third
of all pages costs no more than a small one.  Pages without a token take no part.

Results: character references are decoded, white space within a block becomes one space,
blocks are trimmed and joined by a newline, empty ones left out.  A null or empty page has
the empty text.  A template needs support: a host whose pages have fewer than ``SUPPORT``
different articles has none, and a page without a host neither; without a template blocks
that are mostly links are left out where the page has no article.  Repeated rows give
repeated results; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekframe.llm.runtime import materialise, text_batches
from seekframe.llm.url_filter import split_url

#: Different articles that a host's template must be drawn from.
SUPPORT = 8
#: A nested class stands in at least one of so many pages.
NESTED_SHARE = 2
#: Templates travel with every task up to so many rows; beyond, they are joined by host.
LOCAL_TOKENS = 400_000
#: Rows of local sums that a task holds before it hands them on.
LOCAL_SUMS = 200_000
#: Fingerprints are sums modulo this prime, small enough that 10**8 partial sums fit a long.
PRIME = (1 << 36) - 5

# Elements of HTML.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
NOT_TEXT = set("head title nav footer aside form dialog template noscript svg math button select textarea object canvas audio video menu search".split())
#: A new one of these ends an open one of the same group.
ENDS_ITSELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BARRIERS = {"table", "ul", "ol", "dl", "select", "article", "section", "div", "body"}
NOT_TEXT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar", "status"}
#: Words in a class or id that say what an element is for.
NOT_TEXT_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion "
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc sidebar aside widget widgets "
    "footer masthead topbar cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription paywall "
    "share sharing social related recommended recommendations".split()
)
COMMENT_WORDS = set("comment comments commentlist disqus replies respond".split())
#: With one of these a class says what there is elsewhere, not what the element is.
MODIFIERS = set("with has have no not without off hide disable disabled enable enabled".split())
#: How far an element is left out: marked by a class around the article, marked within it, or by what it is.
AROUND, WITHIN, HARD = 1, 2, 4

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|xmp|iframe|noembed|noframes|textarea|title)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][^\s/>]*)(?P<more>(?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|<[!?/][^>]*>",
    re.IGNORECASE | re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[a-z]+")


@dataclass(slots=True)
class Piece:
    """A run of text between two tags."""

    text: str
    key: int
    block: int
    after: int  # tags before it
    main: bool
    out: int
    link: bool


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) >> 1


def _marked(value: str) -> set[str]:
    """The words of those class names that say what their element is."""
    out: set[str] = set()
    for name in value.split():
        words = set(_WORD.findall(name))
        if not words & MODIFIERS:
            out |= words
    return out


def _purpose(name: str, more: str, in_main: bool) -> tuple[str, int, bool]:
    """(class and id, how far the element is left out, whether it is the article)."""
    out, main, marks = HARD * (name in NOT_TEXT), name in ("article", "main"), ""
    if name == "header" and not in_main:
        out = HARD
    if more and more != "/":
        for key, a, b, c in _ATTRIBUTE.findall(more):
            key, value = key.lower(), (a or b or c).lower()
            if key in ("class", "id"):
                marks += f".{value}"
                words = _marked(value) if name not in ("html", "body") else set()
                if words & COMMENT_WORDS and name != "main":
                    out |= HARD
                elif not main and (words & NOT_TEXT_WORDS or "header" in words and not in_main and name == "div"):
                    out |= WITHIN if in_main else AROUND
            elif key == "role":
                marks += f":{value}"
                out |= HARD * (value in NOT_TEXT_ROLES)
                main |= value in ("main", "article")
            elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
                out = HARD
    return marks, out, main


def walk(page: str) -> tuple[list[int], list[Piece]]:
    """The keys of a page's tags in order, and its pieces of text."""
    tags: list[int] = []
    pieces: list[Piece] = []
    stack: list[tuple[str, str, int, bool]] = []  # name, path, how far left out, within the article
    block = at = 0
    links = 0

    def text(raw: str) -> None:
        if raw and not raw.isspace():
            plain = html_lib.unescape(raw) if "&" in raw else raw
            path, out, main = (stack[-1][1:]) if stack else ("", 0, False)
            pieces.append(Piece(plain, _hash(path + "\x01" + plain.strip()), block, len(tags), main, out, links > 0))
        elif raw and pieces and pieces[-1].block == block:
            pieces.append(Piece(" ", 0, block, len(tags), pieces[-1].main, pieces[-1].out, links > 0))

    def pop(to: int) -> None:
        nonlocal links
        for name, *_ in stack[to:]:
            links -= name == "a"
        del stack[to:]

    for m in _TOKEN.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if name in BLOCKS:
            block += 1
        if m["end"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    tags.append(_hash(stack[i][1] + "/"))
                    pop(i)
                    break
            continue
        if name == "br":
            if pieces and pieces[-1].block == block:
                pieces.append(Piece(" ", 0, block, len(tags), pieces[-1].main, pieces[-1].out, links > 0))
            continue
        ended = ENDS_ITSELF.get(name) or ({"p"} if name in BLOCKS else ())
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in ended:
                pop(i)
                break
            if stack[i][0] in BARRIERS:
                break
        _, path, out, main = stack[-1] if stack else ("", "", 0, False)
        marks, own_out, own_main = _purpose(name, m["more"], main)
        path = f"{path}/{name}{marks}" if len(path) < 400 else path
        tags.append(_hash(path))
        if name not in VOID and not m["more"].endswith("/"):
            stack.append((name, path, out | own_out, main or own_main))
            links += name == "a"
    text(page[at:])
    return tags, pieces


def chosen(pieces: list[Piece]) -> list[Piece]:
    """The pieces of the article; of all text if there is none."""
    if not any(p.main for p in pieces):
        return [p for p in pieces if not p.out]
    for most in (0, AROUND):
        kept = [p for p in pieces if p.main and p.out <= most]
        if any(p.key for p in kept):
            return kept
    return []


@dataclass(slots=True)
class Template:
    """What is known of a host: its template's tokens, those of the root, and those of these that open a slot of links."""

    tokens: set[int] = field(default_factory=set)
    root: set[int] = field(default_factory=set)
    link_slots: set[int] = field(default_factory=set)


def tokens_of(tags: list[int], pieces: list[Piece]) -> Iterator[tuple[int, Piece | None]]:
    """The keys of tags and pieces in page order."""
    at = 0
    for p in pieces:
        for tag in tags[at : p.after]:
            yield tag, None
        at = max(at, p.after)
        yield p.key, p
    for tag in tags[at:]:
        yield tag, None


def content(page: str, template: Template) -> str:
    """The page's main text, given its host's template."""
    tags, pieces = walk(page)
    kept = chosen(pieces)
    if template.tokens:
        opened, slot = 0, {}
        for key, p in tokens_of(tags, pieces):
            if p is not None:
                slot[id(p)] = opened
            if key in template.root:
                opened = key
        # a block is the page's own unless every piece of it is part of the template
        own = {p.block for p in kept if p.key and p.key not in template.tokens}
        kept = [p for p in kept if p.block in own and slot[id(p)] not in template.link_slots]
    elif not any(p.main for p in pieces):
        size: dict[int, list[int]] = {}
        for p in kept:
            share = size.setdefault(p.block, [0, 0])
            share[0] += len(p.text)
            share[1] += len(p.text) * p.link
        kept = [p for p in kept if size[p.block][1] * 2 <= size[p.block][0]]
    blocks: dict[int, list[str]] = {}
    for p in kept:
        blocks.setdefault(p.block, []).append(p.text)
    lines = (" ".join("".join(parts).split()) for _, parts in sorted(blocks.items()))
    return "\n".join(line for line in lines if line)


#: What a row of sums is about: a page, a tag, a piece of text, an article.
PAGE, TAG, TEXT, ARTICLE = range(4)
SUMS = "host string, token bigint, kind int, vector bigint, pages bigint, n bigint, place double"


def _summed(batches: Iterator[pa.RecordBatch], columns: list[str], names: list[str], types: list[pa.DataType], add: Callable[[dict, tuple], None]) -> Iterator[pa.RecordBatch]:
    """Adds up the rows of a partition by key before they are shuffled, ``LOCAL_SUMS`` keys at a time."""
    sums: dict[tuple, list] = {}

    def flush() -> pa.RecordBatch:
        rows = [(*key, *value) for key, value in sums.items()]
        sums.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
            add(sums, row)
            if len(sums) >= LOCAL_SUMS:
                yield flush()
    if sums:
        yield flush()


def _add_vectors(sums: dict, row: tuple) -> None:
    host, salt, page = row
    tags, pieces = walk(page)
    counts: dict[tuple[int, int], list] = {}
    n = len(tags) + sum(p.key != 0 for p in pieces)
    for place, (key, p) in enumerate((k, p) for k, p in tokens_of(tags, pieces) if k):
        counts.setdefault((key, TAG if p is None else TEXT), [0, place / n])[0] += 1
    if not counts:
        return
    article = _hash("\x02".join(p.text for p in chosen(pieces) if p.key))
    for (token, kind), (k, place) in [((0, PAGE), (1, 0.0)), ((article, ARTICLE), (1, 0.0)), *counts.items()]:
        have = sums.setdefault((host, token, kind), [0, 0, 0, 0.0])
        have[0] = (have[0] + k * salt) % PRIME
        have[1] += 1
        have[2] += k
        have[3] += place


def candidates(rows: DataFrame, support: int) -> DataFrame:
    """host, token, class (0 for the root) and place of each token that may be part of its host's template; a table.

    ``rows`` has host, salt and html.
    """
    names, types = [x.split()[0] for x in SUMS.split(", ")], [pa.string(), pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.float64()]
    sums = rows.select("host", "salt", "html").mapInArrow(lambda batches: _summed(batches, ["host", "salt", "html"], names, types, _add_vectors), SUMS)
    sums = sums.groupBy("host", "token", "kind").agg(F.pmod(F.sum("vector"), F.lit(PRIME)).alias("vector"), F.sum("pages").alias("pages"), F.sum("n").alias("n"), F.sum("place").alias("place"))
    sums = materialise(sums.where(F.col("kind").isin(PAGE, ARTICLE) | (F.col("pages") > 1)), "html-sums")
    hosts = sums.where(F.col("kind").isin(PAGE, ARTICLE)).groupBy("host").agg(F.max(F.when(F.col("kind") == PAGE, F.col("pages"))).alias("all"), F.count(F.when(F.col("kind") == ARTICLE, 1)).alias("articles"))
    known = sums.where(F.col("kind").isin(TAG, TEXT)).join(hosts.where(F.col("articles") >= support), "host").where(F.col("pages") * NESTED_SHARE >= F.col("all"))
    root = (F.col("pages") == F.col("all")) & (F.col("n") == F.col("all"))
    # what has the same vector is in the same class; only classes of a tag and something else are nested
    grouped = known.where(~root).groupBy("host", "vector", "pages", "n").agg(F.count(F.lit(1)).alias("size"), F.count(F.when(F.col("kind") == TAG, 1)).alias("tags")).where("size > 1 AND tags > 0")
    nested = known.where(~root).join(grouped, ["host", "vector", "pages", "n"]).select("host", "token", F.greatest(F.abs(F.xxhash64("vector", "pages", "n")), F.lit(1)).alias("class"), "place")
    found = known.where(root).select("host", "token", F.lit(0).cast("long").alias("class"), (F.col("place") / F.col("all")).alias("place")).unionByName(nested)
    return materialise(found, "html-classes")


def out_of_order(ranks: list[int]) -> list[int]:
    """Places of a list that are outside of a longest increasing run of its items."""
    ends: list[int] = []
    at: list[int] = []
    before = [-1] * len(ranks)
    for i, r in enumerate(ranks):
        k = bisect_left(ends, r)
        if k == len(ends):
            ends.append(r)
            at.append(i)
        else:
            ends[k], at[k] = r, i
        before[i] = at[k - 1] if k else -1
    inside, i = set(), at[-1] if at else -1
    while i >= 0:
        inside.add(i)
        i = before[i]
    return [i for i in range(len(ranks)) if i not in inside]


#: What a row of the second pass is about: a token of the root, of a nested class, or the slot that a token of the root opens.
ROOT, NESTED, SLOT = range(3)
PLACES = "host string, kind int, token bigint, bad bigint, low bigint, high bigint, chars bigint, linked bigint, links bigint, pages bigint"


def _add_places(classes_of: Callable[[str], tuple[dict[int, int], dict[int, int]]]):
    """Sums up where candidates stand; ``classes_of`` a host are its root tokens with their ranks and its nested ones with their classes."""

    def add(sums: dict, row: tuple) -> None:
        host, page = row
        root, nested = classes_of(host)
        if not root:
            return
        tags, pieces = walk(page)
        seen = [key for key, _ in tokens_of(tags, pieces) if key in root]
        ranks = [root[key] for key in seen]
        wrong = {seen[i] for i in out_of_order(ranks)} if any(x >= y for x, y in zip(ranks, ranks[1:], strict=False)) else set()
        for key in wrong:
            sums.setdefault((host, ROOT, key), [0, 0, 0, 0, 0, 0, 0])[0] += 1
        keep, slot = {id(p) for p in chosen(pieces)}, 0
        opened, counted = 0, -1
        for key, p in tokens_of(tags, pieces):
            if p is not None and id(p) in keep:
                have = sums.setdefault((host, SLOT, opened), [0, 0, 0, 0, 0, 0, 0])
                have[3] += len(p.text)
                have[4] += len(p.text) * p.link
                have[5] += p.link and p.key != 0
                have[6] += counted != opened
                counted = opened
            if key in root and key not in wrong:
                slot, opened = root[key], key
            elif key in nested:
                have = sums.setdefault((host, NESTED, key), [0, slot, slot, 0, 0, 0, 0])
                have[1], have[2] = min(have[1], slot), max(have[2], slot)

    return add


def judged(found: DataFrame, places: DataFrame) -> DataFrame:
    """host, token, whether it is the root's and whether it opens a slot of links, of each token of a valid class."""
    at = places.groupBy("host", "kind", "token").agg(F.sum("bad").alias("bad"), F.min("low").alias("low"), F.max("high").alias("high"), *[F.sum(c).alias(c) for c in ("chars", "linked", "links", "pages")])
    at = materialise(at, "html-places")
    bad = at.where((F.col("kind") == ROOT) & (F.col("bad") > 0)).select("host", "token")
    root = found.where(F.col("class") == 0).join(bad, ["host", "token"], "left_anti").select("host", "token")
    nested = found.where(F.col("class") != 0).join(at.where(F.col("kind") == NESTED).select("host", "token", "low", "high"), ["host", "token"])
    valid = nested.groupBy("host", "class").agg(F.min("low").alias("low"), F.max("high").alias("high")).where(F.col("low") == F.col("high")).select("host", "class")
    tokens = root.withColumn("root", F.lit(True)).unionByName(nested.join(valid, ["host", "class"], "left_semi").select("host", "token", F.lit(False).alias("root")))
    links = at.where((F.col("kind") == SLOT) & (2 * F.col("linked") > F.col("chars")) & (F.col("links") >= 2 * F.col("pages"))).select("host", "token", F.lit(True).alias("links"))
    return tokens.join(links, ["host", "token"], "left").select("host", "token", "root", (F.col("root") & F.coalesce("links", F.lit(False))).alias("links"))


def _by_host(rows: list) -> dict[str, list]:
    out: dict[str, list] = {}
    for r in rows:
        out.setdefault(r["host"], []).append(r)
    return out


def _ranked(rows) -> tuple[dict[int, int], dict[int, int]]:
    """Of one host's candidates: root tokens with their ranks, nested ones with their classes."""
    root = sorted((r["place"], r["token"]) for r in rows if r["class"] == 0)
    return {token: rank + 1 for rank, (_, token) in enumerate(root)}, {r["token"]: r["class"] for r in rows if r["class"] != 0}


def _templated(rows) -> Template:
    return Template({r["token"] for r in rows}, {r["token"] for r in rows if r["root"]}, {r["token"] for r in rows if r["links"]})


def _per_host(rows: DataFrame, facts: DataFrame, most: int, made: Callable, run: Callable[[Callable], Callable], schema: str) -> DataFrame:
    """``rows`` through ``run(look)``, where ``look(batch)`` gives what ``made`` makes of the ``facts`` of each row's host.

    Facts of all hosts travel with the tasks up to ``most`` rows, and are joined by host beyond.
    """
    head = facts.limit(most + 1).collect()
    if len(head) <= most:
        known = {host: made(x) for host, x in _by_host(head).items()}
        shipped, nothing = rows.sparkSession.sparkContext.broadcast(known), made([])
        return rows.mapInArrow(run(lambda batch: [shipped.value.get(h, nothing) for h in batch.column("host").to_pylist()]), schema)
    names = [c for c in facts.columns if c != "host"]
    packed = facts.groupBy("host").agg(F.collect_list(F.struct(*names)).alias("facts"))

    def look(batch: pa.RecordBatch) -> list:
        memory: dict[str, object] = {}
        out = []
        for host, x in zip(batch.column("host").to_pylist(), batch.column("facts"), strict=True):
            if host not in memory:
                memory[host] = made(x.as_py() or [])
            out.append(memory[host])
        return out

    return rows.join(packed, "host", "left").mapInArrow(run(look), schema)


def templates(rows: DataFrame, support: int, local: int) -> DataFrame:
    """host, token, root and links of each token of a host's template; a table.  ``rows`` has host, salt and html."""
    found = candidates(rows, support)
    names, types = [x.split()[0] for x in PLACES.split(", ")], [pa.string(), pa.int32(), *[pa.int64()] * 8]

    def run(look):
        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def known() -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    yield from (batch.slice(i, 500) for i in range(0, batch.num_rows, 500))

            current: dict[str, tuple] = {}

            def noted() -> Iterator[pa.RecordBatch]:
                for batch in known():
                    current.clear()
                    current.update(zip(batch.column("host").to_pylist(), look(batch), strict=True))
                    yield batch

            yield from _summed(noted(), ["host", "html"], names, types, _add_places(current.__getitem__))

        return places

    places = _per_host(rows.select("host", "html"), found, local, _ranked, run, PLACES)
    return materialise(judged(found, places), "html-templates")


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", support: int = SUPPORT, local_tokens: int = LOCAL_TOKENS) -> DataFrame:
    """The id, url, text and n_chars of each page."""
    text_batches(pages.sparkSession)
    host, _ = split_url(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    hosted = rows.where("host <> ''").select("host", F.pmod(F.xxhash64("id", "html"), F.lit(PRIME)).alias("salt"), "html")
    known = templates(hosted, support, local_tokens)
    kind = rows.schema["id"].dataType.simpleString()

    def run(look):
        def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for first in range(0, whole.num_rows, 500):
                    batch = whole.slice(first, 500)
                    out = [content(page, template) for page, template in zip(batch.column("html").to_pylist(), look(batch), strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], [id_col, url_col, "text", "n_chars"])

        return texts

    return _per_host(rows, known, local_tokens, _templated, run, f"`{id_col}` {kind}, `{url_col}` string, text string, n_chars bigint")
