"""Main text of web pages by equivalence-class template deduction.

Tokens of a page are its tags (with their class) and its text nodes, told apart by the sections they stand in. Over all pages of a
host, each token has an occurrence vector: how often it stands in each page. Tokens with the same
vector form an equivalence class. A class is valid if it has several tokens on enough pages; on a page it holds if its
tokens stand there in the class's order. Classes that stand once a page are the template's skeleton, whose tokens part the page
into slots; classes that repeat nest in it if all that a page has of them falls into one slot. Text that
belongs to a class is the template's own; text in slots is the page's.

The article's slots are those inside the skeleton's article or main element or, where it has none, inside the
smallest skeleton section that holds most of the page's own text. Names of elements only tell apart
what varies in those slots and is still no article, such as reader comments.

Vectors are compared by fingerprints, sums over pages of a hash of page and count, so
that they aggregate like counts and no host's pages ever meet in one task. A class's order is that of its tokens' mean places.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, fresh, join_spread

#: Share of a host's pages that a template token stands on, pages a host needs for a template, and the share of a page's own text that its main element holds.
SUPPORT, LEAST_PAGES, MOST = 0.2, 3, 0.6
#: Template tokens up to which all templates are broadcast (about 20 bytes each); beyond, pages and templates are joined by host.
BROADCAST_TOKENS = 1_000_000

# HTML element names by what they mean for a text.
RAW = "script style noscript template iframe svg textarea title select".split()
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
PLACES = frozenset("html head body nav header footer main article section aside div ul ol dl table form figure".split())
BLOCKS = PLACES | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th thead tbody tfoot caption blockquote pre figcaption address details summary hr fieldset center".split())
DROPPED = frozenset("head nav footer aside form button select iframe svg object video audio canvas dialog menu script style noscript template textarea title".split())
MAIN = frozenset(("article", "main"))
# Class, id and role names of menus, footers, sidebars, notices, adverts, forms and reader comments; whole names only.
ROLES = frozenset(
    "ad ads advert adverts advertisement banner ad-banner sponsor sponsored promo promotion cookie cookies cookie-notice cookie-banner consent notice notices sidebar side-bar "
    "menu nav navbar navigation breadcrumb breadcrumbs footer comment comments comment-list comments-list comment-section comments-section disqus disqus_thread replies "
    "newsletter subscribe signup login popup modal skip-link".split()
)
SPLIT = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(RAW) + r")\b(?P<rawattr>[^>]*)>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attr>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>",
    re.S | re.I,
)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
NUMBER = re.compile(r"\d+")
TAIL = re.compile(r"[-_]?#$")
HIDDEN = re.compile(r"\bhidden\b|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)


def tokens_of(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, roles or text): kinds are ``open``, ``close``, ``raw`` (an element without markup inside) and ``text``."""
    at, end = 0, html.rfind(">") + 1
    for m in SPLIT.finditer(html, 0, end):
        if m.start() > at:
            yield "text", "", html[at : m.start()]
        at = m.end()
        if m["raw"]:
            yield "raw", m["raw"].lower(), ""
        elif m["name"]:
            attr = m["attr"]
            roles = " ".join(a or b or c for a, b, c in NAMED.findall(attr)) if "=" in attr else ""
            if attr and HIDDEN.search(attr):
                roles += " popup"
            yield ("close" if m["close"] else "open"), m["name"].lower(), roles
    if at < len(html):
        yield "text", "", html[at:]


def number(token: str) -> int:
    """A token as a signed 64-bit number."""
    x = xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass"), 7)
    return x - (1 << 64) if x >> 63 else x


def placed(html: str) -> list[tuple[str, str, str, int]]:
    """(kind, name, roles or text, token): tokens as numbers that tell their sections apart; 0 for blank text.

    One step a token however tags nest: a section is named by a hash of its own and its parent's name, and a closing tag without an
    open one is found by a count.
    """
    out, stack, path, opened = [], [], 0, Counter()
    for kind, name, value in tokens_of(html):
        if kind == "text":
            plain = " ".join(unescape(value).split())
            out.append((kind, name, value, number(f"{path}|{plain}") if plain else 0))
            continue
        label = f"{name}.{NUMBER.sub('#', value)}" if value else name
        if kind == "open":
            out.append((kind, name, value, number(f"{path}<{label}>")))
            if name in PLACES:
                stack.append((name, path))
                opened[name] += 1
                path = number(f"{path}/{label}")
        elif kind == "close":
            if name in PLACES and opened[name]:
                while True:
                    last, path = stack.pop()
                    opened[last] -= 1
                    if last == name:
                        break
            out.append((kind, name, value, number(f"{path}</{name}>")))
        else:
            out.append((kind, name, value, number(f"{path}<{name}/>")))
    return out


HOST = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)"


def occurrences(pages: DataFrame, page_id: str, html: str) -> DataFrame:
    """(host, token, pages, total, f1, f2, at, tag) per host and token, and token 0 once per page; partial sums per batch, then merged.

    ``at`` adds up the token's first places, ``tag`` is 1 for tags and 0 for text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple[str, int], list[int]] = defaultdict(lambda: [0, 0, 0, 0, 0, 0])
            for host, page, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                counts, first, tags = Counter(), {}, set()
                for i, (kind, _, _, token) in enumerate(placed(x.as_py() or "")):
                    counts[token] += 1
                    first.setdefault(token, i)
                    if kind != "text":
                        tags.add(token)
                counts[0] = 1
                for token, n in counts.items():
                    h = xxhash.xxh64_intdigest(f"{page}:{n}")
                    s = sums[host, token]
                    for k, v in enumerate((1, n, h & 0xFFFFFFF, h >> 36, first.get(token, 0), token in tags)):
                        s[k] += v
            keys = list(sums)
            values = [pa.array([sums[k][i] for k in keys], pa.int64()) for i in range(6)]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), *values], names=["host", "token", *SUMS, "tag"])

    parts = pages.select("host", page_id, html).mapInArrow(run, "host string, token long, " + ", ".join(f"{c} long" for c in (*SUMS, "tag")))
    return parts.groupBy("host", "token").agg(*[F.sum(c).alias(c) for c in SUMS], (F.sum("tag") > 0).alias("tag"))


SUMS = ("pages", "total", "f1", "f2", "at")


def templates(pages: DataFrame, page_id: str, html: str, support: float = SUPPORT, least: int = LEAST_PAGES) -> DataFrame:
    """(host, tokens, classes, n): per host the valid classes' tokens, class by class in their order, the class of each, and the host's pages.

    Equal occurrence vectors make a class. It is valid with two tokens or more, one of them a tag, on
    at least ``support`` of the host's pages and ``least`` pages. Classes that stand once a page have positive numbers, those that repeat
    negative ones. All is bounded by the tokens of a few pages.
    """
    # kept: what stands on several pages; most text stands on one
    counted = cut(occurrences(pages, page_id, html).where((F.col("pages") > 1) | (F.col("token") == 0)))
    hosts = counted.where("token = 0").select("host", F.col("pages").alias("n")).where(F.col("n") >= least)
    frequent = counted.where("token <> 0").join(hosts, "host").where((F.col("pages") >= F.col("n") * support) & (F.col("pages") >= least))
    entry = F.struct((F.col("at") / F.col("pages")).alias("place"), "token")
    classes = frequent.groupBy("host", "n", "pages", "total", "f1", "f2").agg(F.sort_array(F.collect_list(entry)).alias("entries"), F.max("tag").alias("tag"))
    classes = classes.where((F.size("entries") > 1) & F.col("tag"))
    made = classes.groupBy("host", "n").agg(F.sort_array(F.collect_list(F.struct("entries", (F.col("total") > F.col("pages")).alias("repeats")))).alias("c"))
    numbered = F.transform("c", lambda c, i: F.transform(c["entries"], lambda _: F.when(c["repeats"], -1 - i).otherwise(1 + i)))
    return made.select("host", F.flatten(F.transform("c", lambda c: c["entries"]["token"])).alias("tokens"), F.flatten(numbered).alias("classes"), "n")


class Template:
    """A host's valid classes."""

    def __init__(self, tokens=(), classes=()):
        self.place: dict[int, tuple[int, int]] = {}
        self.size: Counter = Counter()
        for token, c in zip(tokens, classes, strict=True):
            self.place[token] = (c, self.size[c])
            self.size[c] += 1

    def holding(self, stream: list[tuple[str, str, str, int]]) -> set[int]:
        """The classes that hold on a page: skeleton classes whose tokens all stand there once and in order, and repeating ones that one slot of the skeleton holds."""
        seen: dict[int, list[int]] = defaultdict(list)
        for *_, token in stream:
            if token in self.place:
                c, rank = self.place[token]
                seen[c].append(rank)
        holds = {c for c, ranks in seen.items() if c > 0 and ranks == list(range(self.size[c]))}
        slots: dict[int, set[int]] = defaultdict(set)
        slot = 0
        for *_, token in stream:
            c = self.place.get(token, (0, 0))[0]
            if c > 0 and c in holds:
                slot += 1
            elif c < 0:
                slots[c].add(slot)
        return holds | {c for c, found in slots.items() if len(found) == 1}


def main_token(stream: list[tuple[str, str, str, int]], template: Template, holds: set[int]) -> int:
    """The opening token of the smallest skeleton section that holds most of the page's own text; 0 if there is none."""
    open_now: list[tuple[str, int]] = []
    own: Counter = Counter()
    order: list[int] = []
    total, hidden = 0, 0
    for kind, name, value, token in stream:
        c = template.place.get(token, (0, 0))[0]
        if kind == "open" and name not in VOID:
            open_now.append((name, token if name in PLACES and c > 0 and c in holds else 0))
            hidden += name in DROPPED
            if open_now[-1][1]:
                order.append(token)
        elif kind == "close" and any(n == name for n, _ in open_now[-8:]):
            while open_now:
                last, _ = open_now.pop()
                hidden -= last in DROPPED
                if last == name:
                    break
        elif kind == "text" and token and c not in holds and not hidden:
            total += len(value)
            for t in {t for _, t in open_now[-64:] if t}:
                own[t] += len(value)
    chosen = [t for t in order if own[t] >= MOST * total and total]
    return chosen[-1] if chosen else 0


def extract(html: str, template: Template | None = None) -> str:
    """The main text of one page, given its host's template.

    Text of the slots inside the main element: the skeleton's article or main element or, if it has none, what
    ``main_token`` finds; on pages without a template any article or main element, or all. Inside it, blocks that consist of text of the main element's
    own class or of nested classes are the template's and left out, unless nothing else is there. Elements that
    are, or are named, menus, footers, sidebars, notices, adverts, forms or comments are left out.
    """
    stream, template = placed(html), template or Template()
    holds = template.holding(stream) if template.place else set()
    cls = lambda token: template.place.get(token, (0, 0))[0]
    mains = {token for kind, name, _, token in stream if kind == "open" and name in MAIN}
    fixed = {token for token in mains if cls(token) > 0 and cls(token) in holds}
    if holds and not mains and (found := main_token(stream, template, holds)):
        fixed = {found}
    mains = fixed or mains
    constant = {c for c in holds if c < 0} | {cls(t) for t in fixed}
    return _read(stream, mains, {token for kind, _, _, token in stream if kind == "text" and token and cls(token) in constant}) or _read(stream, mains, set())


def _read(stream: list[tuple[str, str, str, int]], mains: set[int], constant: set[int]) -> str:
    """The blocks of text inside the elements that ``mains`` open (all, if there are none), without those that consist of ``constant`` tokens."""
    blocks: list[str] = []
    words: list[str] = []
    entered: list[bool] = []  # for each open element of a main one's name, whether it is a main one
    names = {name for kind, name, _, token in stream if kind == "open" and token in mains}
    main, skip, depth = 0, "", 0

    own = False

    def flush() -> None:
        nonlocal own
        plain = " ".join(unescape("".join(words)).split())
        if plain and own:
            blocks.append(plain)
        words.clear()
        own = False

    for kind, name, value, token in stream:
        if skip:
            if kind == "open" and name == skip and name not in VOID:
                depth += 1
            elif kind == "close" and name == skip:
                depth -= 1
            elif kind == "close" and (name in names and name != skip and main or name == "body"):
                depth = 0  # an element that never ends ends with the article
            if depth > 0:
                continue
            skip = ""
            if kind == "close" and name not in names:
                continue
        if kind == "text":
            if not (mains and not main):
                words.append(value)
                own = own or bool(token) and token not in constant
            continue
        if name == "br":
            words.append(" ")
            continue
        if name in BLOCKS:
            flush()
        if kind == "raw":
            continue
        if kind == "open" and name not in VOID:
            outside = bool(mains) and not main
            named = name not in MAIN and token not in mains and name not in ("body", "html") and bool(value) and any(TAIL.sub("", r) in ROLES for r in NUMBER.sub("#", value.lower()).split())
            if name in DROPPED or named or name == "header" and not main:
                if not outside and name != "head" or name == "head" and not mains:
                    skip, depth = name, 1
                continue
        if name in names and kind == "open":
            entered.append(token in mains)
            main += entered[-1]
        elif name in names and entered:
            main -= entered.pop()
    flush()
    return "\n".join(blocks)


def extract_all(pages: DataFrame, page_id: str, url: str, html: str, tokens: int = BROADCAST_TOKENS) -> DataFrame:
    """``pages`` without ``html`` and with ``text`` and ``n_chars`` (its code points), for every page from its whole html.

    Null html gives an empty text; a url without a host belongs to the host ''. Pages of a host with too few
    pages for a template are read by the names of elements alone. Columns named like the new ones are replaced.
    Templates of up to ``tokens`` tokens together are broadcast; more are joined with the pages, a large host's pages in many tasks.
    """
    host, t, c = (fresh(x, pages) for x in ("host", "tokens", "classes"))
    hosted = pages.withColumn(host, F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1)))
    of_host = hosted.select(F.col(host).alias("host"), page_id, html) if page_id != "host" and html != "host" else hosted.select(page_id, html, F.col(host).alias("host"))
    made = cut(templates(of_host, page_id, html))
    small = (made.agg(F.sum(F.size("tokens"))).collect()[0][0] or 0) <= tokens
    keep = [f for f in pages.schema.fields if f.name not in (html, "text", "n_chars")]
    names = [f.name for f in keep]
    schema = T.StructType([*keep, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    shipped = {r["host"]: Template(r["tokens"], r["classes"]) for r in made.collect()} if small else {}
    rows = hosted.select(*names, html, host)
    if not small:
        n = hosted.groupBy(host).agg(F.count("*").alias("n"))
        known = n.join(made.select(F.col("host").alias(host), F.col("tokens").alias(t), F.col("classes").alias(c)), host, "left")
        rows = join_spread(rows, known.select(host, t, c, "n"), host)
    sent = pages.sparkSession.sparkContext.broadcast(shipped)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shipped, known = sent.value, {}
        for batch in batches:
            at = {n: batch.column(batch.schema.get_field_index(n)) for n in batch.schema.names}
            texts = []
            for i, x in enumerate(at[html]):
                name = at[host][i].as_py()
                if t in at and name not in known:
                    known = {name: Template(at[t][i].as_py() or (), at[c][i].as_py() or ())}  # the last host's only
                texts.append(extract(x.as_py() or "", known.get(name) or shipped.get(name)))
            yield pa.RecordBatch.from_arrays([*[at[n] for n in names], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*names, "text", "n_chars"])

    return rows.mapInArrow(run, schema)
