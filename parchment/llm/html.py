"""HTML extraction by equivalence-class template deduction.

A page is a sequence of tokens: opening and closing tags of containers, told apart by the path they stand in, and text.
Over all pages of a host, each tag token has an occurrence vector (how often it occurs in each page). Tokens with the same
vector form an equivalence class. A class is valid if it is large (two tokens at least) and frequent (``MIN_PAGES`` pages
and ``SUPPORT`` of the host's), if its tokens nest (an opening tag comes with its closing tag), and if they stand in one
order on all pages. Valid classes nest into the template: those that occur once a page are its frame, the others
repeat inside. The frame's tokens cut each page into slots, one after each token.

Of the slots, those with the same text on all pages are template. The article is looked for along the frame: from the
outermost container inwards, as long as one container holds at least ``MOST`` of its parent's varying text and the parent
has hardly any (``OWN``) outside of containers. Links count nothing and text in repeated parts counts ``REPEATED`` (menus,
lists of teasers and reader comments are made of these); an article or main element ends the way. All text of that container is the article, but for elements that HTML itself or their exact class, id or role
name marks as one of the kinds to leave out (``DROPPED``, ``NAMED``), and but for slots of fixed text outside article
and main elements.

The vectors never exist as such: each is a sum over pages of a page's hash times the count, so that Spark adds
them up by (host, token) from partial sums, and a host with a third of all pages costs no task more than others. As a
class needs a share of its host's pages, a host's template holds a few times as many tokens as one of its pages.

A host with fewer than ``MIN_PAGES`` pages, or without a frame, uses the template of its site (the last two labels of
the name). A page without template, or without its article container, is searched by itself in the same way. A null or
empty html gives an empty text; a null url has the empty host. Repeated rows and ties are handled row by row; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from decimal import Decimal
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, stage
from .urls import split_url

MIN_PAGES = 3
SUPPORT = 0.2
MOST = 0.5
OWN = 0.01
REPEATED = 0.3
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup svg time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose end tags may be left out; they do not count as containers.
LOOSE = frozenset("p li dt dd tr td th thead tbody tfoot option optgroup h1 h2 h3 h4 h5 h6".split())
RAW = frozenset("script style noscript textarea template iframe title".split())
DROPPED = frozenset("head nav aside footer form button select dialog menu".split())
MAIN = frozenset("article main".split())
#: Whole class, id or role names of the kinds that are no article.
NAMED = frozenset(
    "ad ads advert advertisement banner breadcrumb breadcrumbs comment comments cookie-notice footer header menu nav navbar navigation notice "
    "pagination sidebar sponsored complementary contentinfo".split()
)
_QUOTED = r"(?>\"[^\"<]*\"|'[^'<]*'|[^<>])*+(?:>|\Z)"
_TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][\w:-]*)({_QUOTED}|[^<>]*(?:>|(?=<)|\Z))", re.S)
_NAMED = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """``(kind, value, path)``: kind is "open", "close", "text", "link" (text in a link), "muted" or "break".

    Text is decoded and never in raw elements. Text of named inline or loose elements to leave out is muted.
    """
    stack: list[tuple[str, str]] = []
    path, at, links = "", 0, 0
    mute: list | None = None  # name, how many of that name are open, containers open around it
    raw_end: dict[str, re.Pattern] = {}
    while at < len(html):
        m = _TAG.search(html, at)
        kind = "muted" if mute else "link" if links else "text"
        if not m:
            yield kind, unescape(html[at:]), path
            return
        if m.start() > at:
            yield kind, unescape(html[at : m.start()]), path
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if mute and name == mute[0]:
                mute[1] -= 1
                mute = mute if mute[1] else None
            if name in INLINE:
                links -= name == "a" and links > 0
                continue
            yield "break", name, path
            if name not in LOOSE and any(n == name for n, _ in stack):
                links = 0
                while stack:
                    n, label = stack.pop()
                    if n == name:
                        break
                path = "/".join(x for _, x in stack)
                mute = None if mute and len(stack) < mute[2] else mute
                yield "close", label, path
            continue
        if name in RAW:
            end = raw_end.setdefault(name, re.compile(rf"</{name}[^>]*>", re.I)).search(html, at)
            at = end.end() if end else len(html)
            continue
        if name not in INLINE:
            yield "break", name, path
        if name in VOID or m[3].endswith("/>"):
            continue
        names = {w for _, v in _NAMED.findall(m[3]) for w in re.sub(r"\d+", "", v.strip("\"'>")).lower().split()}
        if name in INLINE or name in LOOSE:
            if mute and name == mute[0]:
                if name in INLINE:
                    mute[1] += 1
                else:  # the next one ends it
                    mute = None
            if not mute and not NAMED.isdisjoint(names):
                mute = [name, 1, len(stack)]
            links += name == "a"
            continue
        label = ".".join([name, *sorted(re.sub(r"[./]", "_", w) for w in names)])
        yield "open", label, path
        stack.append((name, label))
        path = f"{path}/{label}" if path else label


def leaves_out(path: str, root: str = "") -> bool:
    """Whether a container on the path below ``root`` is of a kind to leave out; around the article names mean nothing."""
    given = root.count("/") + 1 if root else 0
    inside = False
    for i, label in enumerate(path.split("/")):
        name, *names = label.split(".")
        if name in DROPPED or (name == "header" and not inside):
            return True
        if i >= given and name not in MAIN and name not in ("html", "body") and not NAMED.isdisjoint(names):
            return True
        inside = inside or name in MAIN
    return False


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))


def occurrences(pages: DataFrame) -> DataFrame:
    """``host, token, vector, pages, times`` of tag tokens (``open path`` or ``close path``) and of the empty token.

    Each page counts for its host and for its site. Sums are added up within batches first.
    """
    schema = pa.schema([("host", pa.string()), ("token", pa.string()), ("vector", pa.decimal128(28, 0)), ("pages", pa.int64()), ("times", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple[str, str], list[int]] = {}
            for page, host, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "host", "html")), strict=True):
                own: dict[str, int] = {"": 1}
                for kind, value, path in tokens(html or ""):
                    if kind in ("open", "close"):
                        token = f"{kind} {path}/{value}" if path else f"{kind} {value}"
                        own[token] = own.get(token, 0) + 1
                weight = _hash(str(page)) >> 1
                for token, n in own.items():
                    for h in (host, site_of(host)):
                        got = sums.setdefault((h, token), [0, 0, 0])
                        got[0] += weight * n
                        got[1] += 1
                        got[2] += n
            rows = [{"host": h, "token": t, "vector": Decimal(a), "pages": b, "times": c} for (h, t), (a, b, c) in sums.items()]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    rows = pages.select("page_id", "host", "html").mapInArrow(run, "host string, token string, vector decimal(28,0), pages long, times long")
    return rows.groupBy("host", "token").agg(F.sum("vector").alias("vector"), F.sum("pages").alias("pages"), F.sum("times").alias("times"))


def site_of(host: str) -> str:
    """The name of a host's site, told from hosts by a leading star."""
    return "*." + ".".join(host.split(".")[-2:])


def classes(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """``host, pages, once, members``: large and frequent equivalence classes, with the tokens that nest."""
    found = stage(occurrences(pages), "occurrences")
    whole = found.where("token = ''").select(F.col("host").alias("_host"), F.col("pages").alias("all_pages"))
    tags = found.where((F.col("token") != "") & (F.col("pages") >= min_pages))
    frequent = tags.join(whole, tags["host"] == whole["_host"]).where(F.col("pages") >= SUPPORT * F.col("all_pages"))
    grouped = frequent.groupBy("host", "vector", "pages", "times").agg(F.array_sort(F.collect_set("token")).alias("tokens"))
    paths = lambda kind: F.transform(F.filter("tokens", lambda t: t.startswith(kind + " ")), lambda t: F.substring(t, len(kind) + 2, 1 << 30))
    nested = F.array_intersect(paths("open"), paths("close"))
    return grouped.select("host", "pages", (F.col("pages") == F.col("times")).alias("once"), nested.alias("members")).where(F.size("members") > 0)


def frames(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """``host, frame, repeated``: container paths of each class that occurs once a page, and of all others."""
    pick = lambda once: F.collect_list(F.when(F.col("once") == F.lit(once), F.col("members")))
    return classes(pages, min_pages).groupBy("host").agg(pick(True).alias("frame"), F.array_distinct(F.flatten(pick(False))).alias("repeated"))


def slots(html: str, frame: dict[str, int], repeated: set[str]) -> tuple[dict[str, list], dict[int, int]]:
    """For each frame token of a page, the text up to the next one: characters, those in repeated parts, hash of all.

    Links count no characters. ``frame`` has the class of each container; besides, a hash of the order of each class's tokens.
    """
    found: dict[str, list] = {"": [0, 0, []]}
    now, order = "", {}
    for kind, value, path in tokens(html):
        if kind in ("open", "close"):
            full = f"{path}/{value}" if path else value
            if full in frame:
                now = f"{kind} {full}"
                order.setdefault(frame[full], []).append(now)
                found[now] = [0, 0, []]
        elif kind in ("text", "link") and value.strip():
            found[now][2].append(value.strip())
            if kind == "text":
                inner = any(path == r or path.startswith(r + "/") for r in repeated) if repeated else False
                found[now][1 if inner else 0] += len(value)
    return {k: [a, b, _signed(_hash("\0".join(t)))] for k, (a, b, t) in found.items() if t}, {k: _signed(_hash("\n".join(x))) for k, x in order.items()}


def _weight(plain: int, inner: int) -> float:
    return plain + REPEATED * inner


def article_container(weights: dict[str, float], frame: set[str]) -> str:
    """The container that the article fills: inwards from the whole page while one child holds most of the text.

    The way ends at an article or main element, and at a container with text of its own between its inner ones.
    ``weights``: varying text that stands directly in each container of the frame.
    """
    usable = {p for p in frame if not leaves_out(p, p.rpartition("/")[0])}
    totals = {p: 0.0 for p in usable}
    whole = 0.0
    for path, w in weights.items():
        labels = path.split("/") if path else []
        if path and leaves_out(path, path):
            continue
        whole += w
        for i in range(len(labels)):
            own = "/".join(labels[: i + 1])
            if own in totals:
                totals[own] += w
    direct: dict[str, float] = {}
    for path, w in weights.items():  # of text outside the frame's inner containers
        labels = path.split("/") if path else []
        own = next((p for i in range(len(labels), 0, -1) if (p := "/".join(labels[:i])) in usable), "")
        direct[own] = direct.get(own, 0.0) + w
    root = ""
    while True:
        limit = MOST * (totals[root] if root else whole)
        inner = [p for p in usable if p != root and (not root or p.startswith(root + "/")) and totals[p] > 0 and totals[p] >= limit]
        order = lambda p: (-p.count("/"), totals[p], p)
        if mains := [p for p in inner if p.rpartition("/")[2].split(".")[0] in MAIN]:
            return max(mains, key=order)
        if not inner or direct.get(root, 0.0) > OWN * (totals[root] if root else whole):
            return root
        root = max(inner, key=order)


def templates(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """``host, root, fixed``: by host and by site, the article's container and the frame tokens whose slot never changes."""
    own = stage(frames(pages, min_pages).where(F.size("frame") > 0), "frames")
    ddl = "host string, slot string, plain long, inner long, low long, high long, pages long"

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets: dict[str, tuple[dict, set]] = {}
            sums: dict[tuple[str, str], list[int]] = {}
            for host, html, frame, repeated in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "frame", "repeated")), strict=True):
                known = sets.setdefault(host, ({p: k for k, own in enumerate(frame) for p in own}, set(repeated)))
                found, orders = slots(html or "", *known)
                for slot, (plain, inner, content) in [*found.items(), *((f"order {k}", (0, 0, x)) for k, x in orders.items())]:
                    got = sums.setdefault((host, slot), [0, 0, content, content, 0])
                    got[0] += plain
                    got[1] += inner
                    got[2], got[3] = min(got[2], content), max(got[3], content)
                    got[4] += 1
            rows = [(h, k, *v) for (h, k), v in sums.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string() if i < 2 else pa.int64()) for i in range(7)], [x.split()[0] for x in ddl.split(", ")])

    both = pages.select("html", F.explode(F.array(F.col("host"), _site(F.col("host")))).alias("host"))
    measured = both.join(small(own), "host").select("host", "html", "frame", "repeated").mapInArrow(measure, ddl)
    sums = measured.groupBy("host", "slot").agg(*(F.sum(c).alias(c) for c in ("plain", "inner", "pages")), F.min("low").alias("low"), F.max("high").alias("high"))
    gathered = sums.groupBy("host").agg(F.collect_list(F.struct("slot", "plain", "inner", "pages", (F.col("low") == F.col("high")).alias("same"))).alias("slots"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                mixed = {x["slot"] for x in r["slots"] if x["slot"].startswith("order ") and not x["same"]}
                frame, weights, fixed = {p for k, own in enumerate(r["frame"]) if f"order {k}" not in mixed for p in own}, {}, []
                for x in r["slots"]:
                    if x["slot"].startswith("order "):
                        continue
                    if x["same"] and x["pages"] >= min_pages:
                        fixed.append(x["slot"])
                        continue
                    kind, _, path = x["slot"].partition(" ")
                    inside = path if kind != "close" else path.rpartition("/")[0]
                    weights[inside] = weights.get(inside, 0.0) + _weight(x["plain"], x["inner"])
                out.append({"host": r["host"], "root": article_container(weights, frame), "frame": sorted(frame), "fixed": sorted(fixed)})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("host", pa.string()), ("root", pa.string()), ("frame", pa.list_(pa.string())), ("fixed", pa.list_(pa.string()))]))

    return gathered.join(own.select("host", "frame"), "host").mapInArrow(choose, "host string, root string, frame array<string>, fixed array<string>")


def _site(host):
    return F.concat(F.lit("*."), F.substring_index(host, ".", -2))


def own_root(html: str) -> str:
    """The article's container of a page by itself: every container of it is frame."""
    weights: dict[str, float] = {}
    frame: set[str] = set()
    for kind, value, path in tokens(html):
        if kind == "open":
            frame.add(f"{path}/{value}" if path else value)
        elif kind == "text" and value.strip():
            weights[path] = weights.get(path, 0.0) + len(value)
    return article_container(weights, frame)


def extract_text(html: str, root: str, frame: set[str], fixed: set[str]) -> str:
    """The text in ``root`` without what is to be left out; an empty root, or one that the page lacks, is looked for."""
    for own in dict.fromkeys((root, None, "")):
        if own is None:
            own = own_root(html)
        elif not own and root:
            continue
        parts: list[str] = []
        verdicts: dict[str, bool] = {}
        now = ""
        for kind, value, path in tokens(html):
            if kind in ("text", "link"):
                if path not in verdicts:
                    inside = not own or path == own or path.startswith(own + "/")
                    verdicts[path] = inside and not (path and leaves_out(path, own))
                if verdicts[path] and not (now in fixed and not any(x.split(".")[0] in MAIN for x in path.split("/"))):
                    parts.append(value)
            else:
                parts.append(" ")
                if kind in ("open", "close"):
                    full = f"{path}/{value}" if path else value
                    now = f"{kind} {full}" if full in frame else now
        if text := " ".join("".join(parts).split()):
            return text
    return ""


def extract(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``page_id, url, html``."""
    rows = pages.select("page_id", "url", "html", split_url(F.col("url"))[0].alias("host"))
    found = stage(templates(rows, min_pages), "templates")
    own = found.where(~F.col("host").startswith("*.")).select(F.col("host").alias("_host"), F.struct("root", "frame", "fixed").alias("own"))
    site = found.where(F.col("host").startswith("*.")).select(F.col("host").alias("_site"), F.struct("root", "frame", "fixed").alias("shared"))
    joined = rows.join(small(own), rows["host"] == F.col("_host"), "left").join(small(site), _site(F.col("host")) == F.col("_site"), "left")
    template = F.coalesce("own", "shared")
    ready = joined.select("page_id", "url", "html", "host", template["root"].alias("root"), template["frame"].alias("frame"), template["fixed"].alias("fixed"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets: dict[str, tuple] = {}
            texts = []
            for html, host, root, frame, fixed in zip(*(batch.column(c).to_pylist() for c in ("html", "host", "root", "frame", "fixed")), strict=True):
                known = sets.setdefault(host, (root or "", set(frame or ()), set(fixed or ())))
                texts.append(extract_text(html or "", *known))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return ready.mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
