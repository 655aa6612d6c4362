"""Main text of web pages, without boilerplate that a suffix array over the pages of a host finds.

A page is read once, into blocks. Tags say what can't be text (scripts, styles, navigation, footers, asides; forms and headers outside articles); class
words, whole ones only, break ties, and swallow no article or main below them unless they name reader comments or adverts. What is
left inside article or main elements is the page's candidate text, or all that is left where a page has neither.

The candidate tokens of a host's pages, page after page, form the host's streams. Suffixes of the streams,
one from each token on, are sorted by their leading RUN tokens, and neighbours that share them are counted by distinct page contents. A
run on many of a host's pages is boilerplate: on SHARE of them in pages without article or main, on most of them (ARTICLE_SHARE)
inside articles. A block that boilerplate covers whole goes, and stretches of LONG tokens of other blocks; the unique runs
are the text. A shorter block is a suffix that ends with it. Pages with the same content count once, and an article of which most is
repeated is a copy, not boilerplate, and stays.

Suffixes are spread over ranges of their leading tokens' hashes, not over hosts, so a host of any size spreads over all shards,
and a cell sends a suffix once, with the number of its pages that have it. Only suffixes whose anchor, their least-hashed pair of
tokens, occurs on as many pages as boilerplate must are sent: equal runs have it at the same place, so a first exchange
counts the anchors' pages and the hosts' own.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import common
from tidelog.llm.cells import PARCEL, Cells, exchange, opened, parcel_batch, parcels, together
from tidelog.llm.common import Written
from tidelog.llm.op8_suffix_dedup import text_hash
from tidelog.llm.suffixes import distinct, groups, minima, row_hash

#: Tokens of a repeated run, and covered tokens that go from a block of which other tokens stay.
RUN, LONG = 8, 20
#: Least share of a host's distinct pages that have a run of boilerplate, and least pages: without and with an article.
SHARE, PAGES = 0.2, 2
ARTICLE_SHARE, ARTICLE_PAGES = 0.5, 4
#: An article of which a larger part repeats is a copy.
COPY = 0.5
_END = 0xE2D0F0B10C7

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?=[sntit])(?:(script|style|title|textarea)\b.*?(?:</\1\s*>|\Z)|(noscript|template|svg|iframe|select)\b.*?</\2\s*>)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>|<[a-zA-Z][^<>]*(?:>|\Z)|<[/!?][^<>]*\Z",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Inline elements do not end a word or a block.
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements with optional end tags: they hold no zone unless their class says so.
_LOOSE = frozenset("p li dt dd tr td th thead tbody tfoot option html body".split())
_CHROME_TAGS = frozenset("nav aside footer button menu dialog".split())
_CHROME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu menubar form".split())
# Whole class names or ids. The first hold even for an article or main inside, and inside an article; the others in neither case.
_NEVER_TEXT = frozenset("ad ads advert adverts advertisement advertising sponsored comment comments commentlist comment-list respond disqus".split())
_CHROME_WORDS = frozenset(
    "promo promotion banner cookie cookies consent gdpr notice popup modal overlay newsletter subscribe signup nav navbar navigation menu breadcrumb breadcrumbs sidebar header masthead footer "
    "copyright share sharing share-buttons social related recommended reply replies login search pagination pager toolbar widget".split()
)
#: Of these, those that are no part of an article's own text either.
_IN_ARTICLE = frozenset("notice promo sidebar nav navbar footer cookie cookies consent gdpr newsletter subscribe share sharing share-buttons related recommended reply replies breadcrumb breadcrumbs pagination pager".split())


def _zone(tag: str, attributes: str, zone: str) -> str:
    """The zone inside an element: never (chrome whatever is inside), chrome, article or open."""
    words, roles = set(), set()
    if tag in ("html", "body"):
        return zone
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = next(filter(None, values), "").lower()
        (roles if name.lower() == "role" else words).update(value.split())
    if zone == "never" or tag in _CHROME_TAGS or words & _NEVER_TEXT or roles & _CHROME_ROLES:
        return "never"
    if tag in ("article", "main"):
        return "article"
    if zone == "article":
        return "chrome" if tag == "form" or words & _IN_ARTICLE else zone
    return "chrome" if tag in ("form", "header") or words & _CHROME_WORDS else zone


def blocks(page: str) -> list[tuple[str, str]]:
    """(zone, text) of the blocks of a page in order; zone is article, chrome, never (chrome too) or open."""
    out: list[tuple[str, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, str]] = []  # (tag, zone)
    zone, at = "open", 0

    def flush() -> None:
        if parts:
            if text := " ".join(entities.unescape("".join(parts)).split()):
                out.append((zone, text))
            parts.clear()

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        tag = (m[4] or "").lower()
        if not tag:
            if m[1] or m[2]:
                flush()
            continue
        if tag in _INLINE and not (m[5] and "class" in m[5].lower()) and not any(t == tag for t, _ in stack):
            continue
        if tag not in _INLINE:
            flush()
        if tag in _VOID:
            continue
        if m[3]:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
            if k is not None:
                flush()
                zone = stack[k - 1][1] if k else "open"
                del stack[k:]
            continue
        if m[5].endswith("/") and tag not in ("article", "main", "div", "p"):
            continue
        inner = _zone(tag, m[5], zone)
        if inner != zone or (tag not in _LOOSE and tag not in _INLINE) or any(t == tag for t, _ in stack):
            if inner != zone:
                flush()
            stack.append((tag, inner))
            zone = inner
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out


def candidates(page: str) -> tuple[str, list[str]]:
    """The zone of a page's candidate text, article or open, and its blocks."""
    found = blocks(page)
    zone = "article" if any(z == "article" for z, _ in found) else "open"
    return zone, [t for z, t in found if z == zone]


def _host(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _lost(covered: np.ndarray, long: int) -> np.ndarray:
    """Of a block's covered tokens those that go: all if the block is covered whole, else stretches of long tokens at least.

    Repeated runs may reach from one block into the next by chance, and paragraphs share phrases: neither is boilerplate.
    """
    if covered.all():
        return covered
    edges = np.flatnonzero(np.diff(covered.astype(np.int8), prepend=0, append=0))
    out = np.zeros(len(covered), bool)
    for a, b in edges.reshape(-1, 2).tolist():
        out[a:b] = b - a >= long
    return out


def without(blocks_of: list[list[str]], covered: list[np.ndarray], zone: str, long: int = LONG) -> str:
    """The text of a page's blocks (lists of tokens) less the covered tokens that are boilerplate."""
    lost = [_lost(c, long) for c in covered]
    if zone == "article" and sum(int(x.sum()) for x in lost) > COPY * sum(map(len, blocks_of)):
        return " ".join(w for own in blocks_of for w in own)
    return " ".join(w for own, gone in zip(blocks_of, lost, strict=True) for w, x in zip(own, gone, strict=True) if not x)


class Streams:
    """The candidate tokens of a cell's pages, page after page, each block with an end token."""

    def __init__(self, blobs: list[bytes], copied: list[bytes] | None, run: int):
        self.run = run
        self.ids, texts, self.rest = opened(blobs)
        self.hosts = self.rest.column(1).to_pylist() if self.rest else []
        self.zones, self.blocks, flat, self.sizes = [], [], [], []
        number: dict[str, int] = {}
        seen = set(copied or ())
        self.counts = []  # whether the page is the first of its content
        for t, host in zip(texts, self.hosts, strict=True):
            h = page_hash(host, t)
            self.counts.append(h not in seen)
            seen.add(h)
            zone, *found = t.decode().split("\x1e")
            found = [x.split(" ") for x in found]
            self.zones.append(zone)
            self.blocks.append(found)
            at = len(flat)
            for words in found:
                for w in words:
                    if w not in number:
                        number[w] = len(number) + 1
                flat += map(number.__getitem__, words)
                flat.append(0)
            self.sizes.append(len(flat) - at)
        self.sizes = np.array(self.sizes, np.int64)
        hashes = np.fromiter((common.word_hash(w.encode()) for w in number), np.uint64, len(number))
        self.flat = np.array(flat, np.int64)
        self.tokens = np.r_[np.uint64(_END), hashes][self.flat] if len(flat) else np.empty(0, np.uint64)
        self.page = np.repeat(np.arange(len(texts)), self.sizes)
        self.host = np.array([common.word_hash(h.encode("utf-8", "replace")) for h in self.hosts], np.uint64)
        self.end = np.cumsum(self.sizes)
        self.counts = np.array(self.counts, bool)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hash, first and last start, and end of what anchors stand for: runs by their least pair (end -1), and blocks too short for one."""
        found = []
        with np.errstate(over="ignore"):
            for p, (end, size) in enumerate(zip(self.end.tolist(), self.sizes.tolist(), strict=True)):
                t = self.tokens[end - size : end]
                if size >= self.run:
                    h = common.mix(common.mix(t[:-1] + self.host[p]) * np.uint64(0x9E3779B97F4A7C15) + t[1:])
                    where, first, last = minima(h, self.run - 1)
                    found.append((h[where], first + end - size, last + end - size, np.full(len(where), -1)))
            ends = np.flatnonzero(self.flat == 0)
            begins = np.r_[0, ends[:-1] + 1] if len(ends) else ends
            short = ends - begins + 1 < self.run
            begins, ends = begins[short], ends[short]
            found.append((row_hash(self.rows(begins, ends + 1), 2), begins, begins, ends + 1))
        h, first, last, stop = map(np.concatenate, zip(*found, strict=True))
        return h >> np.uint64(16), first, last, stop

    def rows(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """The host and the tokens of each suffix, run of them at most, zeros from its stop on."""
        tokens = np.r_[self.tokens, np.zeros(self.run, np.uint64)]
        at = starts[:, None] + np.arange(self.run)
        host = self.host[self.page[starts]] if len(starts) else np.empty(0, np.uint64)
        return np.concatenate([host[:, None], np.where(at < stops[:, None], tokens[at], np.uint64(0))], axis=1)

    def pages_of(self, key: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct keys, and on how many pages that count each is."""
        order = np.lexsort((page, key))
        key, page = key[order], page[order]
        new = np.r_[True, key[1:] != key[:-1]] if len(key) else np.empty(0, bool)
        one = new | np.r_[True, page[1:] != page[:-1]] if len(key) else new
        number = np.cumsum(new) - 1
        return key[new], np.bincount(number[one & self.counts[page]], minlength=int(new.sum())) if len(key) else np.empty(0, np.int64)

    def asked(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash and pages of the cell's anchors and hosts, and which are hosts."""
        h, first, _, _ = self.anchors()
        keys, many = self.pages_of(h, self.page[first]) if len(h) else (h, np.empty(0, np.int64))
        hosts, own = self.pages_of(self.host_key(), np.arange(len(self.ids)))
        return np.r_[keys, hosts], np.r_[many, own].astype(np.int32), np.r_[np.zeros(len(keys), np.uint8), np.ones(len(hosts), np.uint8)]

    def host_key(self) -> np.ndarray:
        return common.mix(self.host) >> np.uint64(16)

    def suffixes(self, h: np.ndarray, total: np.ndarray, is_host: np.ndarray, share: float, article_share: float) -> tuple[np.ndarray, ...]:
        """Starts and stops of the suffixes that may be boilerplate, the number of each one's distinct row, the rows, and on how many pages that count each is.

        h, total and is_host are the answers to asked(); need becomes the pages that boilerplate of each page must be on.
        """

        def answer(keys: np.ndarray, of: np.ndarray) -> np.ndarray:
            order = np.argsort(h[of], kind="stable")
            known, many = h[of][order], total[of][order]
            at = np.minimum(np.searchsorted(known, keys), max(0, len(known) - 1))
            return np.where(known[at] == keys, many[at], 1) if len(known) else np.ones(len(keys), np.int64)

        of_host = answer(self.host_key(), is_host == 1)
        article = np.array([z == "article" for z in self.zones], bool)
        self.need = np.where(article, np.maximum(ARTICLE_PAGES, np.ceil(article_share * of_host)), np.maximum(PAGES, np.ceil(share * of_host)))
        key, first, last, stop = self.anchors()
        some = np.flatnonzero(answer(key, is_host == 0) >= self.need[self.page[first]]) if len(key) else np.empty(0, np.int64)
        first, last, stop = first[some], last[some], stop[some]
        many = last - first + 1
        starts = np.repeat(first, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        stops = np.where(np.repeat(stop, many) < 0, starts + self.run, np.repeat(stop, many))
        rows = self.rows(starts, stops)
        one, number = distinct(rows)
        return starts, stops, number, rows[one], self.pages_of(number, self.page[starts])[1] if len(starts) else np.empty(0, np.int64)


def page_hash(host: str, text: bytes) -> bytes:
    return text_hash(host.encode("utf-8", "replace") + b"\0" + text)


def _copied(cells: Cells) -> DataFrame:
    """cell and the page contents in it that an earlier cell has too. A cell sends a content once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cell, blobs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                _, texts, rest = opened(blobs)
                found = list({page_hash(h, t) for t, h in zip(texts, rest.column(1).to_pylist() if rest else [], strict=True)})
                yield pa.RecordBatch.from_arrays([pa.array([cell] * len(found), pa.int32()), pa.array(found, pa.binary())], ["cell", "hash"])

    found = Written(cells.read().select("cell", "docs").mapInArrow(run, "cell int, hash binary"), "contents").read()
    first = found.groupBy("hash").agg(F.min("cell").alias("first"), F.count("*").alias("n")).where("n > 1").select("hash", "first")
    return found.join(first, "hash").where("cell > first").groupBy("cell").agg(F.collect_list("hash").alias("copied"))  # contents of one cell


def extract(pages: DataFrame, run: int = RUN, long: int = LONG, share: float = SHARE, article_share: float = ARTICLE_SHARE) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages.

    Needs columns page_id, url and html; others are ignored. A null or empty html gives the empty text;
    a null or broken url counts as the host "". Rows of a host with the same content each give their row
    and count as one page, so a page that is found twice keeps its text. Empty tables give
    empty results. Pages of any length are read whole. Tokens are compared by 64-bit hashes.
    """
    n, fan = common.shards(pages), common.FAN
    id_type = pages.schema["page_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = ["\x1e".join([zone, *parts]) for zone, parts in map(candidates, b.column(2).to_pylist())]
            hosts = [_host(u) for u in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array([x.encode("utf-8", "replace").decode() for x in found], pa.string()), b.column(1), pa.array(hosts, pa.string())], ["doc_id", "text", "url", "host"])

    parsed = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).mapInArrow(read, f"doc_id {id_type}, text string, url string, host string")
    cells = Cells(parsed, n, ["url", "host"])
    copied = Written(_copied(cells), "copied").read()

    def sent_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, docs, copies in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                h, many, is_host = Streams(docs, copies, run).asked()
                yield parcel_batch(parcels([(h % np.uint64(n)).astype(np.int32), np.full(len(h), number, np.int32), h, many, is_host], n, fan))

    def anchored(table: pa.Table) -> pa.Table:
        _, cell, h, many, is_host = together(table.column("blob").to_pylist())
        _, number = np.unique(h << np.uint64(1) | is_host, return_inverse=True)  # h has 48 bits
        total = np.bincount(number, many).astype(np.int64)[number]
        keep = total >= PAGES
        return pa.Table.from_batches([parcel_batch(parcels([cell[keep], h[keep], total[keep], is_host[keep]], n, fan))])

    def known(docs: list[bytes], copies: list[bytes] | None, answers: list[bytes] | None) -> tuple:
        streams = Streams(docs, copies, run)
        h, total, is_host = together(answers)[1:] if answers else (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.uint8))
        return streams, *streams.suffixes(h, total, is_host, share, article_share)

    def sent_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, docs, copies, answers in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                _, _, _, _, rows, pages_of = known(docs, copies, answers)
                lead = row_hash(rows[:, :3])  # ranges of the host's and two leading tokens' hash
                to = ((lead >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int32)
                yield parcel_batch(parcels([to, np.full(len(to), number, np.int32), np.arange(len(to), dtype=np.int32), pages_of.astype(np.int32), np.c_[lead, rows]], n, fan))

    def counted(table: pa.Table) -> pa.Table:
        _, cell, number, pages_of, rows = together(table.column("blob").to_pylist())
        run_of = groups(rows)
        total = np.bincount(run_of, pages_of).astype(np.int64)[run_of]
        keep = total >= PAGES
        return pa.Table.from_batches([parcel_batch(parcels([cell[keep], number[keep], total[keep]], n, fan))])

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for docs, copies, answers, found in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                s, starts, stops, number, rows, _ = known(docs, copies, answers)
                total = np.zeros(len(rows), np.int64)
                if found:
                    _, at, many = together(found)
                    total[at] = many
                hit = total[number] >= s.need[s.page[starts]] if len(starts) else np.empty(0, bool)
                marks = np.zeros(len(s.tokens) + 1, np.int64)
                np.add.at(marks, starts[hit], 1)
                np.add.at(marks, stops[hit], -1)
                gone = np.cumsum(marks) > 0
                texts = []
                for end, size, zone, found_blocks in zip(s.end.tolist(), s.sizes.tolist(), s.zones, s.blocks, strict=True):
                    if not gone[end - size : end].any():
                        texts.append(" ".join(w for own in found_blocks for w in own))
                        continue
                    covered, at = [], end - size
                    for own in found_blocks:
                        covered.append(gone[at : at + len(own)])
                        at += len(own) + 1
                    texts.append(without(found_blocks, covered, zone, long))
                if texts:
                    yield pa.record_batch([pa.array(s.ids, type=id_arrow), s.rest.column(0).combine_chunks(), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    from pyspark.sql.pandas.types import to_arrow_type

    id_arrow = to_arrow_type(pages.schema["page_id"].dataType)
    with_copies = cells.read().hint("merge").join(copied, "cell", "left")
    anchors = with_copies.select("cell", "docs", "copied").mapInArrow(sent_anchors, PARCEL)
    elsewhere = Written(exchange(anchors, n, fan).groupBy("group").applyInArrow(anchored, PARCEL), "anchors")
    asked = cells.with_answers(exchange(elsewhere.read(), n, fan)).join(copied, "cell", "left").select("cell", "docs", "copied", "answers0").mapInArrow(sent_suffixes, PARCEL)
    totals = Written(exchange(asked, n, fan).groupBy("group").applyInArrow(counted, PARCEL), "runs")
    common.release(pages.sparkSession)
    answers = cells.with_answers(exchange(elsewhere.read(), n, fan), exchange(totals.read(), n, fan)).join(copied, "cell", "left")
    found = answers.select("docs", "copied", "answers0", "answers1").mapInArrow(applied, f"page_id {id_type}, url string, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
