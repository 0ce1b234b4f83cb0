"""HTML main text by wrapper induction: union-free regular expressions over token streams.

A page becomes a stream of block-level tags and text slots (inline tags vanish, what
HTML closes by itself is closed).  The streams of a host are aligned one after the
other: what has the same label under the same node is one node of the wrapper, and
a mismatch becomes an optional node, a repeated node, a repeated group of nodes or a
text slot that varies.  A node of the wrapper is a row (host, id), where id stands for
the labels from the root on, and what is known of it is sums, extremes and bitmaps:
so alignment is associative, tasks align their pages first, Spark's aggregate joins
their rows, and the wrapper is the same however the pages lie.

The wrapper then chooses the text region of each page.  A slot weighs what its text
has on the host's pages on average, text in links and template text (slots that are
constant over the host's distinct pages) nothing; a region weighs what its slots do.
From the root on the reading goes into the container that has ``DOMINANT`` of the weight,
and what stands beside it in containers - menus, notices, adverts whose place is the
same though their text varies - is left out.  Elements that HTML itself sets apart
(nav, footer, aside, header outside articles, hidden ones) weigh nothing, articles and
main parts more.  Classes and ids only decide where the wrapper doesn't: a
region named like an advert, or a form, goes unless it has most of its place's weight.

NULL or empty html gives the empty text.  Repeated pages are read each, and count once
where distinct pages are counted.  A NULL or odd url counts as the host ''.  Broken
markup (unclosed tags, stray ends, cut pages) is read as far as it goes, at any depth and
length in time that grows with the length.  Slots that only one page of the host has, as on
hosts of one page, weigh what they have there.  Empty tables give empty tables.  Extra columns
are ignored; ``keep`` columns may have any name but text, which is replaced.
"""

from __future__ import annotations

import html
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of HTML: tags whose content is no text, and tags that end by themselves.
RAW = ("script", "style", "noscript", "template", "iframe", "svg", "textarea", "title", "object", "canvas", "audio", "video", "select", "math")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var".split()
)
CLOSED_BY_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = ("ul", "ol", "dl", "table", "body", "article", "main", "section", "div")
CONTAINERS = frozenset("article main section div body center table tbody tr td form".split())

# What HTML sets apart.
APART_TAGS = frozenset("head nav footer aside button dialog menu search".split())
APART_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
MAIN_TAGS = frozenset(("article", "main"))
# Names of regions that usually aren't text: whole class or id tokens, all of whose parts are
# such names or words for a box (so ``ad-box`` is one, ``ad-hoc`` and ``related-work`` aren't).
NAMES = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors "
    "promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related "
    "recommended recommendations comment comments disqus respond reply replies pagination pager widget toolbar masthead skip".split()
)
BOXES = frozenset("area article articles bar block box buttons container content form group inner item items links list outer panel post posts reader readers section site slot thread top unit user users wrap wrapper".split())
HEADER_NAMES = frozenset(("header", "topbar"))

PLAIN, APART, HEADER, MAIN, NAMED = range(5)
#: Weight of what a region of each kind has.
WEIGHT = {PLAIN: 1.0, APART: 0.0, HEADER: 0.0, MAIN: 32.0, NAMED: 0.2}
DOMINANT = 0.8  # share of the weight at which the reading goes into a container
TEMPLATE_PAGES = 3  # distinct pages, and half of the host's, that make a constant slot template text
BODY = 200  # characters that a named region must have to be taken for the text

_TAG = r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+"
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(RAW) + rf")\b{_TAG}>.*?(?:</(?P=raw)\s*>|\Z)"
    rf"|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attr>{_TAG})>|<[!?/][^>]*>|(?P<loose><[a-z][^>]*>)|(?P<text>[^<]+|<)",
    re.I | re.S,
)
#: After a quote that nothing closes, quotes no longer count.
LOOSE = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(RAW) + r")\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attr>[^>]*)>|<[!?/][^>]*>|(?P<loose><[a-z][^>]*>)|(?P<text>[^<]+|<)",
    re.I | re.S,
)
OPENED = re.compile(r"<[a-z/!?]", re.I)
ATTR = re.compile(r"(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


def _attrs(raw: str) -> dict[str, str]:
    return {k.lower(): a or b or c or "" for k, a, b, c in ATTR.findall(raw)} if "=" in raw or "hidden" in raw.lower() else {}


def _named(token: str) -> bool:
    parts = [p.lower() for p in PARTS.findall(token) if not p.isdigit()]
    return any(p in NAMES for p in parts) and all(p in NAMES or p in BOXES for p in parts)


def _hidden(a: dict[str, str]) -> bool:
    return "hidden" in a or a.get("aria-hidden", "").lower() == "true" or "display:none" in a.get("style", "").replace(" ", "").lower()


def label_of(tag: str, raw: str) -> tuple[str, int]:
    """(label, kind) of a start tag."""
    a = _attrs(raw)
    names = a.get("class", "").split()
    first = re.sub(r"\d+", "", names[0]) if names else ""
    label, role = f"{tag}.{first}" if first else tag, a.get("role", "").lower()
    if tag in APART_TAGS or role in APART_ROLES or _hidden(a):
        return label, APART
    if tag in MAIN_TAGS or role in ("main", "article"):
        return label, MAIN
    if tag in ("body", "html"):
        return label, PLAIN
    tokens = [*names, *a.get("id", "").split()]
    if tag == "form" or any(map(_named, tokens)):
        return label, NAMED
    if tag == "header" or not HEADER_NAMES.isdisjoint(t.lower() for t in tokens):
        return label, HEADER
    return label, PLAIN


class Page:
    """A page's nodes, each after its parent, and its text blocks in order.

    ``blocks``: (node, text, characters in links, whether all of it is in inline elements with a
    region's name).  Labels of nodes under one parent meet in ``id``: the path of labels, hashed."""

    def __init__(self, source: str, ids: dict | None = None):
        self.parent, self.id, self.kind, self.tag, self.label = [-1], [0], [PLAIN], [""], [""]
        self.blocks: list[tuple[int, str, int, bool]] = []
        self.place: dict[int, int] = {}  # of an id, among its siblings
        self.many: dict[int, int] = {}  # 1: it stands twice side by side, 2: with others between
        self.path: dict[int, tuple[int, str]] = {}
        self._ids = {} if ids is None else ids
        self._read(source)

    def _child(self, of: int, label: str) -> int:
        """The id of ``label`` under an id."""
        import xxhash

        k = self._ids.get((of, label))
        if k is None:
            if len(self._ids) > 200_000:
                self._ids.clear()
            k = self._ids[of, label] = xxhash.xxh64_intdigest(label.encode("utf-8", "replace"), of & (1 << 64) - 1) - (1 << 63)
        return k

    def _read(self, source: str) -> None:
        cut = source.rfind(">") + 1
        if m := OPENED.search(source, cut):  # a tag that nothing ends
            source = source[: m.start()]
        stack = [0]
        seen: list[tuple[dict, list]] = [({}, [None])]  # of each open node: labels so far, the last one
        open_at: dict[str, list[int]] = {}  # tag -> places in the stack
        inline: dict[str, list[int]] = {}  # open inline elements: 1 hidden, 2 named
        off = named = 0
        text: list[tuple[str, bool, bool]] = []

        def beside(label: str) -> int:
            labels, last = seen[-1]
            k = self._child(self.id[stack[-1]], label)
            if label in labels:
                self.many[k] = max(self.many.get(k, 0), 1 if last[0] == label else 2)
            else:
                labels[label] = len(labels)
                self.place[k] = min(self.place.get(k, 1 << 30), labels[label])
                self.path[k] = (self.id[stack[-1]], label)
            last[0] = label
            return k

        def flush() -> None:
            if not text:
                return
            s = " ".join("".join(t for t, _, _ in text).split())
            if s:
                beside("#")
                links = sum(len(t) for t, link, _ in text if link)
                self.blocks.append((stack[-1], s, min(links, len(s)), all(n or not t.strip() for t, _, n in text)))
            text.clear()

        def close(to: int) -> None:
            nonlocal off, named
            flush()
            while len(stack) > to:
                open_at[self.tag[stack.pop()]].pop()
                seen.pop()
            if inline:
                inline.clear()
                off = named = 0

        last = lambda tag: open_at[tag][-1] if open_at.get(tag) else -1
        pattern, at = TOKEN, 0
        while at < len(source):
            for m in pattern.finditer(source, at):
                if (t := m["text"]) is not None:
                    if not off:
                        text.append((html.unescape(t), bool(inline.get("a")), named > 0))
                    continue
                if m["loose"] is not None and pattern is TOKEN:
                    break
                tag = (m["tag"] or "").lower()
                if not tag:  # comments, scripts and the like are nothing inside a block
                    continue
                if tag in INLINE:
                    mine = inline.setdefault(tag, [])
                    if not m["end"]:
                        a = _attrs(m["attr"])
                        how = 1 if _hidden(a) else 2 if any(map(_named, [*a.get("class", "").split(), *a.get("id", "").split()])) else 0
                        mine.append(how)
                        off += how == 1
                        named += how == 2
                    elif mine:
                        how = mine.pop()
                        off -= how == 1
                        named -= how == 2
                    continue
                if tag == "br":
                    text.append((" ", False, True))
                    continue
                if tag in VOID and tag != "hr" or tag == "html":
                    continue
                if m["end"]:
                    close(last(tag) if open_at.get(tag) else len(stack))
                    continue
                if tag in CLOSED_BY_P and (k := last("p")) > 0 and k > max(map(last, SCOPES)):
                    close(k)
                if tag in SIBLINGS:
                    scope = max(map(last, SCOPES))
                    close(min((k for s in SIBLINGS[tag] if (k := last(s)) > max(scope, 0)), default=len(stack)))
                if last("head") > 0:  # text and blocks end the head
                    close(last("head"))
                close(len(stack))
                if tag == "hr":
                    continue
                label, kind = label_of(tag, m["attr"])
                k = beside(label)
                self.parent.append(stack[-1])
                self.id.append(k)
                self.kind.append(kind)
                self.tag.append(tag)
                self.label.append(label)
                if m["attr"].endswith("/") and tag not in CLOSED_BY_P:
                    continue
                open_at.setdefault(tag, []).append(len(stack))
                stack.append(len(self.id) - 1)
                seen.append(({}, [None]))
            else:
                break
            pattern, at = LOOSE, m.start()
        flush()

    def slots(self) -> dict[int, list[int]]:
        """Slot -> [characters outside links, characters in links, hash of its texts]."""
        import zlib

        out: dict[int, list[int]] = {}
        for node, s, links, _ in self.blocks:
            k = self._child(self.id[node], "#")
            own = out.setdefault(k, [0, 0, 0])
            own[0] += len(s) - links
            own[1] += links
            own[2] = zlib.crc32(s.encode("utf-8", "replace"), own[2])
        return out

    def text(self, wrapper: dict[int, tuple[float, float, bool]] | None = None) -> list[str]:
        """The blocks of the region that the wrapper chooses: slot -> (characters outside links,
        characters in links, template text), means over the host's pages."""
        n, parent, kind = len(self.id), self.parent, self.kind
        wrapper, own = wrapper or {}, self.slots()
        times: dict[int, int] = {}
        slot_of = [self._child(self.id[node], "#") for node, *_ in self.blocks]
        for s in slot_of:
            times[s] = times.get(s, 0) + 1
        inside, main = [False] * n, [False] * n
        for i in range(1, n):
            inside[i] = inside[parent[i]] or kind[i] == MAIN
        for node, *_ in self.blocks:
            main[node] = main[node] or inside[node]
        for i in range(n - 1, 0, -1):
            main[parent[i]] = main[parent[i]] or main[i]
        main = [m and not x for m, x in zip(main, inside, strict=True)]  # it has a main part with text
        apart = [k == APART or k == HEADER and not inside[i] and not main[i] for i, k in enumerate(kind)]
        mass, plain, here = [0.0] * n, [0.0] * n, [0.0] * n
        template = [False] * len(self.blocks)
        for j, (node, _, _, only_named) in enumerate(self.blocks):
            chars, links, fixed = wrapper.get(slot_of[j]) or (*own[slot_of[j]][:2], False)
            if not inside[node]:
                template[j] = fixed or slot_of[j] in wrapper and links > chars
            if not template[j] and not only_named:
                here[node] += chars / times[slot_of[j]]
        for i in range(n - 1, -1, -1):
            mass[i] += here[i]
            plain[i] += here[i]
            nested = i and inside[parent[i]]
            w = 0.0 if apart[i] else 1.0 if nested and kind[i] == MAIN or kind[i] == HEADER else WEIGHT[kind[i]]
            mass[i] *= w
            if i:
                mass[parent[i]] += mass[i]
                plain[parent[i]] += plain[i] if w else 0.0
        gone = apart[:]
        for i in range(1, n):
            if kind[i] == NAMED and not main[i] and not (plain[i] >= BODY and 2 * plain[i] >= plain[parent[i]]) and not gone[i]:
                gone[i] = True
        below: list[list[int]] = [[] for _ in range(n)]
        for i in range(1, n):
            below[parent[i]].append(i)
        at = 0
        while True:
            alike: dict[int, int] = {}
            for i in below[at]:
                alike[self.id[i]] = alike.get(self.id[i], 0) + 1
            whole = here[at] + sum(mass[i] for i in below[at])
            best = max((i for i in below[at] if self.tag[i] in CONTAINERS and alike[self.id[i]] == 1 and not gone[i]), key=lambda i: mass[i], default=None)
            if best is None or not mass[best] or mass[best] < DOMINANT * whole or inside[at] and kind[best] != MAIN:
                break
            for i in below[at]:
                if i != best and self.tag[i] in CONTAINERS:
                    gone[i] = True
            at = best
        parts = sum(mass[i] for i in range(at + 1, n) if kind[i] == MAIN and not inside[parent[i]] and not apart[i]) if main[at] else 0.0
        only_main = inside[at] or parts and parts >= DOMINANT * whole  # then what stands beside articles is none of the text
        under = [i == at for i in range(n)]
        for i in range(1, n):
            gone[i] = gone[i] or gone[parent[i]]
            under[i] = under[i] or under[parent[i]]
        text = []
        for j, (node, s, _, only_named) in enumerate(self.blocks):
            if not (gone[node] or template[j] or only_named or only_main and not (inside[node] and under[node])):
                text.append(s)
        return text


def extract(page: str | None, wrapper: dict | None = None, ids: dict | None = None) -> str:
    """The main text: blocks in page order, joined by an empty line."""
    return "\n\n".join(Page(page, ids).text(wrapper)) if page else ""


# ---- wrappers

NODE = T.StructType([
    T.StructField("host", T.StringType()), T.StructField("id", T.LongType()), T.StructField("parent", T.LongType()), T.StructField("label", T.StringType()),
    T.StructField("pages", T.LongType()), T.StructField("many", T.IntegerType()), T.StructField("place", T.IntegerType()), T.StructField("chars", T.LongType()),
    T.StructField("links", T.LongType()), T.StructField("low", T.LongType()), T.StructField("high", T.LongType()), T.StructField("seen", T.LongType()),
])


def host_of(url="url"):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def align(into: dict, host: str, page: Page, mark: int) -> None:
    """Align a page with its host's nodes in ``into``; ``mark``: a bit that stands for its content."""
    slots = page.slots()
    for k, (of, label) in [*page.path.items(), (0, (0, ""))]:
        chars, links, value = slots.get(k, (0, 0, 0))
        many, place = page.many.get(k, 0), page.place.get(k, 0)
        row = into.get((host, k))
        if row is None:
            into[host, k] = [of, label, 1, many, place, chars, links, value, value, mark]
        else:
            row[2] += 1
            row[3] = max(row[3], many)
            row[4] = min(row[4], place)
            row[5] += chars
            row[6] += links
            row[7], row[8] = min(row[7], value), max(row[8], value)
            row[9] |= mark


def nodes(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """The wrappers' nodes (``NODE``) of all hosts.  ``seen`` has a bit for each distinct page, of 64."""
    from .common import text_chunks

    def infer(batches):
        import zlib

        import pyarrow as pa

        found: dict = {}
        ids: dict = {}

        def flush():
            cols = list(zip(*((h, k, *row) for (h, k), row in found.items()), strict=True)) or [[]] * len(NODE)
            found.clear()
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=NODE.names)

        for part, texts in text_chunks(batches, "_html"):
            for h, t in zip(part.column(0).to_pylist(), texts, strict=True):
                if t:
                    bit = 1 << (zlib.crc32(t) & 63)
                    align(found, h, Page(t.decode("utf-8", "replace"), ids), bit - (1 << 64) if bit >> 63 else bit)
                    if len(found) > 100_000:
                        yield flush()
        yield flush()

    parts = pages.select(host_of(url).alias("host"), F.col(page).cast("string").alias("_html")).mapInArrow(infer, NODE)
    return parts.groupBy("host", "id").agg(
        F.min("parent").alias("parent"), F.min("label").alias("label"), F.sum("pages").alias("pages"), F.max("many").alias("many"), F.min("place").alias("place"),
        F.sum("chars").alias("chars"), F.sum("links").alias("links"), F.min("low").alias("low"), F.max("high").alias("high"), F.bit_or("seen").alias("seen"),
    )


def slots(found: DataFrame) -> DataFrame:
    """(host, slots): what reading needs of each wrapper, as 25 bytes for each slot that two distinct
    pages have (a slot of one page weighs there what it weighs on average).  It grows with the
    variety of a host's markup, not with its pages."""
    some = lambda seen: -64.0 * F.log(F.greatest(64.0 - F.bit_count(seen), F.lit(0.5)) / 64.0)  # noqa: E731  distinct pages
    hosts = found.where("id = 0").select("host", some("seen").alias("_all"))
    fixed = (F.col("low") == F.col("high")) & (F.bit_count("seen") >= TEMPLATE_PAGES) & (2 * some("seen") >= F.col("_all"))
    own = found.where((F.col("label") == "#") & (F.bit_count("seen") >= 2)).join(hosts, "host")
    one = F.struct("id", (F.col("chars") / F.col("pages")).alias("chars"), (F.col("links") / F.col("pages")).alias("links"), fixed.alias("fixed"))
    return own.groupBy("host").agg(F.sort_array(F.collect_list(one)).alias("slots"))


def expression(rows, at: int = 0) -> str:
    """A wrapper (rows of one host) as text: ``( ... )+``, ``( ... )?``, ``#`` for a slot that varies, ``=`` for a constant;
    nodes that come back with others between them are one repeated group of optional nodes."""
    by: dict[int, list] = {}
    for r in rows:
        if r["id"]:
            by.setdefault(r["parent"], []).append(r)
    pages = {r["id"]: r["pages"] for r in rows}

    def write(of: int) -> str:
        out, group = [], []
        for r in sorted(by.get(of, ()), key=lambda r: (r["place"], r["label"])):
            s = ("=" if r["low"] == r["high"] else "#") if r["label"] == "#" else f"<{r['label']}>{write(r['id'])}</>"
            if r["many"] == 2:
                group.append(f"({s})?")
                continue
            if group:
                out.append(f"({''.join(group)})+")
                group = []
            rare = r["pages"] < pages.get(of, 0)
            out.append(f"({s})" + "+" * (r["many"] == 1) + "?" * rare if r["many"] or rare else s)
        if group:
            out.append(f"({''.join(group)})+")
        return "".join(out)

    return write(at)


def wrappers_of(pages: list[str]) -> list[dict]:
    """The wrapper of some pages of one host, in memory."""
    import zlib

    into: dict = {}
    for p in pages:
        align(into, "", Page(p), 1 << (zlib.crc32(p.encode()) & 62))
    return [dict(zip(NODE.names[1:], (k, *row), strict=True)) for (_, k), row in into.items()]


def main_text(pages: DataFrame, keep: list[str], url: str = "url", page: str = "html", found: DataFrame | None = None) -> DataFrame:
    """``keep`` columns and text of every page, read through its host's wrapper (``found``: rows of :func:`nodes`)."""
    from .common import small_batches, stage, text_chunks

    small_batches(pages.sparkSession)
    keep = [c for c in keep if c != "text"]
    found = stage(nodes(pages, url, page), "wrappers") if found is None else found
    chosen = stage(slots(found).select(F.col("host").alias("_host"), F.col("slots").alias("_slots")), "slots")
    schema = T.StructType([pages.schema[c] for c in keep] + [T.StructField("text", T.StringType())])

    def run(batches):
        import pyarrow as pa

        ids: dict = {}
        held: dict[str, dict] = {}
        for part, texts in text_chunks(batches, "_html"):
            hosts, column, out = part.column(len(keep) + 1).to_pylist(), part.column(len(keep) + 2), []
            for i, (t, h) in enumerate(zip(texts, hosts, strict=True)):
                if not t:
                    out.append("")
                    continue
                if h not in held:
                    if len(held) >= 64:
                        held.clear()
                    held[h] = {s["id"]: (s["chars"], s["links"], s["fixed"]) for s in column[i].as_py() or ()}
                out.append(extract(t.decode("utf-8", "replace"), held[h], ids))
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array(out, pa.string())], names=[*keep, "text"])

    read = pages.withColumn("_host", host_of(url)).join(chosen, "_host", "left")
    return read.select(*keep, F.col(page).cast("string").alias("_html"), "_host", "_slots").mapInArrow(run, schema)
