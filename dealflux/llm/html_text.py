"""Main text of pages by template deduction over the pages of a host.

Tokens of a page are its containers and its text blocks, told apart by their path from the page's root and
by their occurrence there, so that a token stands on a page once. Tokens of a host with the same occurrence
vector, that is on the same pages, form an equivalence class; vectors are compared by an order-free
fingerprint, so none is gathered. Containers of classes of two pages and more are the template's and nest by
their paths; a text block is the template's if it stands on most of the pages that have its container.
What a template container holds between two consecutive tokens of the template is a slot, if the container's
class is valid (its tokens have one order on all pages), else all its slots are one. A page's main text are
its slots with most text over the host's pages, and those beside them that hold prose. Names of elements
and of their classes decide between slots of like size, and inside the main ones.

Steps meet by page, by token or by slot, never by host: no row holds more than a page does.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dealflux.llm.common import slices, staged

#: Fixed sets of element names.
CONTAINERS = frozenset("html head body div section article main nav header footer aside form menu dialog figure table fieldset".split())
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd pre blockquote td th tr tbody thead caption figcaption hr address details summary option title center".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 dt dd pre blockquote td th caption figcaption".split())
SILENT = frozenset("script style noscript template svg iframe object canvas audio video select textarea button".split())
OUTSIDE = frozenset("head nav header footer aside form menu dialog".split())
#: Words of a class, id or role that tell a container of boilerplate.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "alert popup modal overlay newsletter subscribe signup login menu nav navbar navigation breadcrumb breadcrumbs pagination pager "
    "sidebar aside footer masthead topbar toolbar header comment comments respond replies disqus discussion share sharing social "
    "related recommended widget form search contentinfo complementary skip legal".split()
)
#: Elements that name the main text themselves.
NAMED = frozenset(("article", "main"))
#: A slot with less than one in SMALL of the largest one's text is main text only if it holds prose.
SMALL = 4
#: Token of a page's root, and of its path.
ROOT = 0

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(sorted(SILENT)) + r""")\b(?:"[^"]*"|'[^']*'|[^'">])*>.*?(?:</(?P=raw)\s*>|\Z)"""
    r"""|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:"[^"]*"|'[^']*'|[^'">])*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|(?P<text>[^<]+|<)""",
    re.S | re.I,
)
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_DIGITS = re.compile(r"\d+")
_SPLIT = re.compile(r"[^a-z]+")


def _label(name: str, rest: str) -> str:
    """Element with its class, id and role, digits made alike."""
    if "=" not in rest:
        return name
    found = [f"{k.lower()}={_DIGITS.sub('#', (a or b or c).strip().lower())}" for k, a, b, c in _NAMED.findall(rest)]
    return name + "".join(f"[{f}]" for f in sorted(found))


def _words(marks: str) -> list[str]:
    return _SPLIT.split(marks.replace("class=", " ").replace("id=", " ").replace("role=", " "))


@lru_cache(maxsize=100_000)
def outside(label: str) -> bool:
    """Whether a container's element or marks say that it holds no main text."""
    name, _, marks = label.partition("[")
    if name in ("html", "body", "main"):
        return False  # their marks speak of the page's parts, not of themselves
    if name == "article":
        return "comment" in marks
    return name in OUTSIDE or not MARKS.isdisjoint(_words(marks))


@lru_cache(maxsize=100_000)
def _plain_form(label: str) -> bool:
    """Whether a form has no mark but that of being one."""
    name, _, marks = label.partition("[")
    return name == "form" and (MARKS - {"form"}).isdisjoint(_words(marks))


def _hash(*parts) -> int:
    return xxhash.xxh3_64_intdigest("|".join(map(str, parts)).encode("utf-8", "surrogatepass")) - (1 << 63)


class Page:
    """Containers and text blocks of a page, in page order.

    ``boxes`` are (label, enclosing box), the page itself the first; ``blocks`` are (box, text, prose);
    ``order`` tells them apart: n for box n, -1 - n for block n.
    """

    def __init__(self, html: str | None):
        self.boxes: list[tuple[str, int]] = [("", -1)]
        self.blocks: list[tuple[int, str, bool]] = []
        self.order = [0]
        held, stack, at, prose = [], [], 0, False

        def flush():
            text = " ".join(entities.unescape("".join(held)).split())
            held.clear()
            if text:
                self.order.append(-1 - len(self.blocks))
                self.blocks.append((at, text, prose))

        for m in _TOKEN.finditer(html or ""):
            text = m.group("text")
            if text is not None:
                held.append(text)
                continue
            name = m.group("name")
            if name is None:
                if m.group("raw"):
                    held.append(" ")
                continue
            name = name.lower()
            if name in CONTAINERS:
                flush()
                prose = False
                if not m.group("close"):
                    stack.append((name, at))
                    self.boxes.append((_label(name, m.group("rest")), at))
                    at = len(self.boxes) - 1
                    self.order.append(at)
                elif any(n == name for n, _ in stack):
                    closed = None
                    while closed != name:
                        closed, at = stack.pop()
            elif name in BLOCKS:
                flush()
                prose = name in PROSE and not m.group("close")
            elif name == "br":
                held.append(" ")
        flush()

    def open_to(self, forms: frozenset[int] | None) -> list[bool]:
        """Whether each box lies in no boilerplate; ``forms`` are none, nor any plain form if it is None."""
        out = [True]
        for n, (label, up) in enumerate(self.boxes[1:], 1):
            out.append(out[up] and (not outside(label) or (_plain_form(label) if forms is None else n in forms)))
        return out

    def named(self) -> list[bool]:
        """Whether each box is or lies in an article or main."""
        out = [False]
        for label, up in self.boxes[1:]:
            out.append(out[up] or label.partition("[")[0] in NAMED)
        return out

    def enclosing_forms(self, blocks: list[int]) -> frozenset[int]:
        """Plain forms around an article or main, on a page without one those around most of the text of ``blocks``."""
        free, forms = self.open_to(None), [n for n, (label, _) in enumerate(self.boxes) if _plain_form(label)]
        if not forms:
            return frozenset()
        below = [free[n] and label.partition("[")[0] in NAMED for n, (label, _) in enumerate(self.boxes)]
        chars = [0] * len(self.boxes)
        for b in blocks:
            box, text, _ = self.blocks[b]
            if free[box]:
                chars[box] += len(text)
        for n in range(len(self.boxes) - 1, 0, -1):
            below[self.boxes[n][1]] |= below[n]
            chars[self.boxes[n][1]] += chars[n]
        return frozenset(n for n in forms if (below[n] if below[0] else 2 * chars[n] > chars[0]))

    def tokens(self) -> list[tuple]:
        """(token, up, text, plain, chars, prose, named) of boxes and blocks in page order; ``up`` is a place in this list."""
        token, plain, seen, place = [ROOT], [ROOT], defaultdict(int), [0] * len(self.boxes)
        named, out = self.named(), [(ROOT, -1, False, ROOT, 0, 0, False)]
        for n, (label, up) in enumerate(self.boxes[1:], 1):
            seen[up, label] += 1
            token.append(_hash(token[up], label, seen[up, label]))
            plain.append(_hash(plain[up], label))
        for n in self.order[1:]:
            if n > 0:
                place[n] = len(out)
                out.append((token[n], place[self.boxes[n][1]], False, plain[n], 0, 0, named[n]))
            else:
                box, text, prose = self.blocks[-1 - n]
                t = _hash("text", plain[box], text)
                seen[t] += 1
                out.append((_hash(t, seen[t]), place[box], True, plain[box], len(text), len(text) * prose, named[box]))
        return out

    def content(self) -> int:
        """Hash of the text outside marked containers."""
        free, own = self.open_to(None), xxhash.xxh3_64()
        for box, text, _ in self.blocks:
            if free[box]:
                own.update(text.encode("utf-8", "surrogatepass") + b"\n")
        return own.intdigest() - (1 << 63)


def host_of(url: Column) -> Column:
    """Host of a URL, lower case; empty without one."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def page_tokens(pages: DataFrame) -> DataFrame:
    """(host, page, content, tokens) of every different page of ``pages`` (host and page as hashes, html)."""
    fields = [("token", pa.int64()), ("up", pa.int32()), ("text", pa.bool_()), ("plain", pa.int64()), ("chars", pa.int32()), ("prose", pa.int32()), ("named", pa.bool_())]
    entry = pa.list_(pa.struct(fields))

    def run(batches):
        for batch in batches:
            for a, b in slices(pa.compute.binary_length(batch.column("html")).to_pylist(), 2_000_000):
                part = batch.slice(a, b - a)
                rows = [Page(x) for x in part.column("html").to_pylist()]
                flat, ends = [], [0]
                for r in rows:
                    flat.extend(r.tokens())
                    ends.append(len(flat))
                items = pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*flat), fields)], names=[n for n, _ in fields])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items).cast(entry)
                yield pa.RecordBatch.from_arrays([part.column("host"), part.column("page"), pa.array([r.content() for r in rows], pa.int64()), lists], names=["host", "page", "content", "tokens"])

    schema = "host long, page long, content long, tokens array<struct<token:long,up:int,text:boolean,plain:long,chars:int,prose:int,named:boolean>>"
    return pages.select("host", "page", "html").mapInArrow(run, schema).dropDuplicates(["host", "page"])


def classes(tokens: DataFrame) -> DataFrame:
    """(host, token, class, pages, text, plain, chars, named, low, high) of tokens on two pages and more.

    Tokens of one class stand on the same pages; ``low`` and ``high`` are the least and greatest content of these.
    """
    rows = tokens.select("host", "page", "content", F.explode("tokens").alias("t")).select("host", "page", "content", "t.*")
    kept = [F.min(c).alias(c) for c in ("text", "plain", "chars", "named")]
    one = rows.groupBy("host", "token").agg(F.count("*").alias("pages"), F.bit_xor(F.xxhash64("page")).alias("vector"), F.min("content").alias("low"), F.max("content").alias("high"), *kept)
    return one.where("pages > 1").withColumn("class", F.xxhash64("host", "pages", "vector")).drop("vector")


def template_texts(tokens: DataFrame, often: DataFrame) -> DataFrame:
    """(host, token, class) of the text blocks that are a template's own.

    They stand on more than half of the pages that have their container; in an article or main, which says
    itself that it holds no boilerplate, on every page of the host, and together they are less than half of
    the container's text. Texts whose pages all read alike are copies and prove no template.
    """
    inner = tokens.select("host", F.explode(F.array_distinct(F.transform(F.filter("tokens", lambda t: ~t["text"]), lambda t: t["plain"]))).alias("plain"))
    holders = inner.groupBy("host", "plain").agg(F.count("*").alias("holders"))
    held = tokens.select("host", F.explode(F.filter("tokens", lambda t: t["text"] & t["named"])).alias("t")).groupBy("host", F.col("t.plain").alias("plain")).agg(F.sum("t.chars").alias("held"))
    whole = often.where(F.col("token") == ROOT).select("host", F.col("pages").alias("all"))
    texts = often.where("text and low < high").join(holders, ["host", "plain"]).join(whole, "host")
    texts = texts.where("if(named, pages = all, 2 * pages > holders)").join(held, ["host", "plain"], "left")
    own = F.sum(F.col("pages") * F.col("chars")).over(Window.partitionBy("host", "plain"))
    return texts.withColumn("own", own).where("not named or 2 * own < held").select("host", "token", "class")


def _page_slots(host: int, tokens: list[dict], marks: dict[int, int]) -> list[tuple]:
    """(id, sig, box, class, blocks, chars, prose) of a page's slots, and (class, order of its tokens) of its classes.

    ``marks`` are the classes of the template's tokens by their place.
    """
    home, last, order, slots, block = [0] * len(tokens), {}, defaultdict(list), {}, 0
    for at, t in enumerate(tokens):
        up = home[t["up"]] if at else 0
        own = marks.get(at)
        if not t["text"]:
            home[at] = at if own is not None else up
        if own is not None:
            order[own].append(t["token"])
            if at:
                last[up] = t["token"]
        elif t["text"]:
            slot = slots.setdefault((up, last.get(up, ROOT)), [[], 0, 0])
            slot[0].append(block)
            slot[1] += t["chars"]
            slot[2] += t["prose"]
        block += t["text"]
    out = [(_hash(host, tokens[box]["token"], after), None, box, marks.get(box), *s) for (box, after), s in slots.items()]
    return out + [(c, _hash(*o), None, None, None, 0, 0) for c, o in order.items() if len(o) > 1]


def page_slots(tokens: DataFrame, marks: DataFrame) -> DataFrame:
    """(host, page, id, sig, box, class, blocks, chars, prose) of slots and, with a ``sig``, of classes, page by page."""
    placed = tokens.select("host", "page", F.posexplode(F.transform("tokens", lambda t: t["token"])).alias("at", "token")).join(marks, ["host", "token"])
    placed = placed.groupBy("host", "page").agg(F.collect_list(F.struct("at", "class")).alias("marks"))
    names = [("host", pa.int64()), ("page", pa.int64()), ("id", pa.int64()), ("sig", pa.int64()), ("box", pa.int32()), ("class", pa.int64()), ("blocks", pa.list_(pa.int32())), ("chars", pa.int64()), ("prose", pa.int64())]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = []
                for r in batch.slice(at, 256).to_pylist():
                    marks = {m["at"]: m["class"] for m in r["marks"] or []}
                    rows += [(r["host"], r["page"], *s) for s in _page_slots(r["host"], r["tokens"], marks)]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, (_, t) in enumerate(names)], names=[n for n, _ in names])

    schema = "host long, page long, id long, sig long, box int, class long, blocks array<int>, chars long, prose long"
    return tokens.join(placed, ["host", "page"], "left").select("host", "page", "tokens", "marks").mapInArrow(run, schema)


def slots(pages: DataFrame) -> DataFrame:
    """(host, page, slots) of every page: its slots with their mean text over the host's pages.

    ``pages`` has host, page and html. Each slot has the page's ``blocks`` in it, its ``box``, ``chars`` and ``prose``
    (means over the pages that have the slot); entries with ``valid`` say of a class whether it is.
    """
    tokens = staged(page_tokens(pages), "page-tokens")
    often = staged(classes(tokens), "classes")
    marks = staged(often.where("not text").select("host", "token", "class").unionByName(template_texts(tokens, often)), "template")
    own = staged(page_slots(tokens, marks), "slots")
    sums = own.groupBy("id").agg(F.count("*").alias("_pages"), F.min("sig").alias("_low"), F.max("sig").alias("_high"), F.sum("chars").alias("_chars"), F.sum("prose").alias("_prose"))
    entry = F.struct("id", "box", "class", "blocks", (F.col("_low") == F.col("_high")).alias("valid"), (F.col("_chars") / F.col("_pages")).alias("chars"), (F.col("_prose") / F.col("_pages")).alias("prose"))
    return own.join(sums, "id").groupBy("host", "page").agg(F.collect_list(entry).alias("slots"))


def main_blocks(page: Page, found: list[dict]) -> list[int]:
    """Numbers of the blocks that are the page's main text, in page order, from its slots."""
    invalid = {s["id"] for s in found if s["valid"] is False}
    merged: dict[tuple, list] = {}
    for s in found:
        if s["blocks"]:
            slot = merged.setdefault((s["box"], None if s["class"] in invalid else s["id"]), [[], 0.0, 0.0])
            slot[0] += s["blocks"]
            slot[1] += s["chars"]
            slot[2] += s["prose"]
    every = [b for s in merged.values() for b in s[0] if b < len(page.blocks)]
    free, named = page.open_to(page.enclosing_forms(every)), page.named()
    weighed = []
    for blocks, chars, prose in merged.values():
        kept = [b for b in blocks if b < len(page.blocks) and free[page.blocks[b][0]]]
        if kept:
            weighed.append((prose + (chars - prose) / SMALL, chars, prose, kept))
    if not weighed:
        return []
    top = max(weighed)
    inside = [(w, [b for b in kept if named[page.blocks[b][0]]]) for w, _, _, kept in weighed]
    if SMALL * sum(w for w, kept in inside if kept) >= top[0] and any(kept for _, kept in inside):
        return sorted(b for _, kept in inside for b in kept)
    return sorted(b for _, chars, prose, kept in weighed if SMALL * chars >= top[1] or 2 * prose >= chars for b in kept)


def extract(html: str | None, found: list[dict]) -> str:
    """Main text of a page from its slots, one block a line."""
    page = Page(html)
    return "\n".join(page.blocks[b][1] for b in main_blocks(page, found))


def _frames(rows: DataFrame) -> DataFrame:
    """``rows`` with ``html`` as a zstandard frame: pages cross the network once."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for a, b in slices(pa.compute.binary_length(batch.column("html")).to_pylist(), 4_000_000):
                part = batch.slice(a, b - a)
                frames = [None if x is None else pack(x.encode("utf-8", "surrogatepass")) for x in part.column("html").to_pylist()]
                yield part.set_column(part.schema.get_field_index("html"), "html", pa.array(frames, pa.binary()))

    return rows.mapInArrow(run, "page_id long, url string, host long, page long, html binary")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages`` (page_id, url, html); other columns are ignored.

    A null or empty page has an empty text. Pages without a host are one host. Rows repeated wholly are one
    page of their host's template, and each has its text. A host with one page (or with copies of one only) has no
    template: such a page gives its article or main, without one all its text outside marked containers. Where most
    pages that have a container are edits of one text, what they share is taken for the template's. Character
    references are decoded, white space inside a block is one space, blocks stand in page order, one a line.
    Hosts, pages of a host and tokens are compared by 64-bit hashes.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.xxhash64(host_of(F.col("url"))).alias("host"), F.xxhash64("page_id", "url", "html").alias("page"), "html")
    found = staged(slots(rows), "main-slots")
    both = _frames(rows).join(found, ["host", "page"], "left").select("page_id", "url", "html", "slots")

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                pairs = zip(part.column("html").to_pylist(), part.column("slots").to_pylist())
                out = [extract(h and unpack(h).decode("utf-8", "surrogatepass"), s or []) for h, s in pairs]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return both.mapInArrow(run, "page_id long, url string, text string, n_chars long")
