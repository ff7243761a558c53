"""Main text of web pages, with boilerplate found as long token runs that a host repeats on several pages.

A page is taken apart into blocks. The suffixes of the pages' token streams are put in order, host by host, by their
first tokens, and suffixes of different pages that agree there mark a repeated substring.

On every page, runs of ``COMMON`` tokens that stand in a large share of a host's articles are removed from its article
or main elements. A share is what tells boilerplate there from a passage that some articles have in common, so this order
counts pages; it needs only the suffixes whose least gram is itself in so many articles, which is found first.

Repeated runs of ``RUN`` tokens, of two pages or more, are removed from doubtful blocks and from pages whose text does
not lie in an article or main element for the larger part; the unique runs that remain are main text. Where it does, the
element's blocks are the main text, less blocks that recur whole, at the same place, on a large share of the host's pages.
For such pages the suffixes outside can decide nothing; streams of ``RUN`` tokens are made for hosts with other pages.

The suffix order is kept in blocks by hash of those first tokens, so a host with any number of pages is spread over all
tasks.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm.shared import (
    U64,
    Windows,
    WordHashes,
    bucket_bits,
    by_bucket,
    cut_by_bucket,
    grouped,
    mixed,
    stored,
)
from trailmark.llm.substrings import covered

#: Tokens from which on a repeated run is long.
RUN = 8
#: Tokens from which on a run that a large share of a host's articles has in common is long, and those of a gram.
COMMON, _GRAM = 16, 4
#: Blocks of an article recur if they stand at one place on this share of a host's pages, and on so many at least; runs of
#: it are common if they stand on so many. They stay if less than half of the article would be left.
SHARE, PAGES = 0.5, 5
_GATHERED = 500_000
_AT_ONCE = 256

# Elements and names in class, id or role that are never main text.
_SILENT = frozenset("script style noscript template svg iframe head title object canvas math textarea select button".split())
_CHROME = frozenset("nav header footer aside form dialog menu".split())
_CHROME_WORDS = frozenset(
    """ad ads advert adverts advertisement advertising sponsored sponsor promo promotion banner cookie cookies consent
    notice notices alert popup modal overlay newsletter subscribe subscription sidebar side-bar widget related
    recommended share sharing social comment comments reply replies disqus menu navbar navigation nav breadcrumb
    breadcrumbs pagination pager footer header masthead toolbar login signup search contentinfo complementary""".split()
)
#: Compounds that say the same as the words; others that begin with such a word are doubtful.
_CHROME_NAMES = _CHROME_WORDS | frozenset(
    """ad-banner ad-box ad-container ad-slot ad-unit ad-wrapper ads-container cookie-banner cookie-bar cookie-consent
    cookie-notice consent-banner newsletter-signup newsletter-form subscribe-form subscribe-box related-posts
    related-articles related-links recommended-posts share-bar share-buttons share-links share-tools sharing-buttons
    social-links social-icons social-media social-share social-buttons comment-form comment-list comments-area
    comments-section comments-list nav-bar nav-links nav-menu navbar-nav navigation-menu menu-bar menu-item menu-list
    footer-links footer-menu footer-nav header-menu header-nav login-form signup-form search-bar search-box search-form
    sidebar-widget widget-area promo-banner promo-box popup-overlay modal-dialog disqus_thread""".split()
)
#: Of a section inside an article, the only ids that count: others name what the section is about.
_COMMENTS = frozenset("comment comments comment-list comments-area comments-section comments-list disqus_thread".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_INLINE = frozenset(
    """a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike
    strong sub sup time tt u var wbr""".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_MAIN = frozenset(("article", "main"))

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
_HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"


_PLAIN, _DOUBTFUL, _CHROME_NAME, _CHROME_TAG = range(4)


def _judged(tag: str, attributes: str, in_main: bool) -> int:
    """How likely an element is no main text: by its tag or as it is hidden, by a whole name, or by a name's beginning."""
    if tag in _CHROME:
        return _CHROME_TAG
    if not attributes or attributes.isspace() or tag in ("html", "body"):
        return _PLAIN
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    if "hidden" in found or found.get("aria-hidden", "").strip().lower() == "true":
        return _CHROME_TAG
    if in_main and (tag in _MAIN or tag in _HEADINGS):
        return _PLAIN
    ids = found.get("id", "").lower().split()
    if in_main and tag == "section":
        ids = [w for w in ids if w in _COMMENTS]
    words = [*ids, *found.get("class", "").lower().split(), *found.get("role", "").lower().split()]
    if any(w in _CHROME_NAMES for w in words):
        return _CHROME_NAME
    return _DOUBTFUL if any(re.split(r"[-_]", w)[0] in _CHROME_WORDS for w in words) else _PLAIN


class _Part:
    """The outermost open element that is judged: its tag, how deep in elements of that tag, and its first block."""

    def __init__(self) -> None:
        self.tag, self.depth, self.first, self.kind = "", 0, 0, _PLAIN

    def begin(self, tag: str, first: int, kind: int) -> None:
        self.tag, self.depth, self.first, self.kind = tag, 1, first, kind

    def meet(self, tag: str, ends: bool) -> None:
        if self.depth and tag == self.tag:
            self.depth += -1 if ends else 1
        elif self.depth and self.tag in ("p", "li") and tag not in _INLINE:
            self.depth = 0


def _judged_blocks(page: str) -> list[tuple[str, bool, bool, bool]]:
    """See :func:`blocks_of`; a fourth value is true in an element whose name only begins like one of no main text."""
    # Text, in main, in chrome, in a doubtful part; in chrome by name that holds an article or main, in chrome inside it.
    out: list[list] = []
    parts: list[str] = []
    main, at, inner = 0, 0, 0
    chrome, nested, doubt, holding = _Part(), _Part(), _Part(), False

    def close() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            out.append([text, main + inner > 0, chrome.depth > 0, doubt.depth > 0, chrome.depth > 0 and holding, nested.depth > 0])

    while True:
        m = _TOKEN.search(page, at)
        parts.append(page[at : m.start() if m else len(page)])
        if m is None:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag, ends = m[2].lower(), bool(m[1])
        if tag in _SILENT and not ends:
            if not m[3].rstrip().endswith("/") or tag not in ("svg", "iframe", "template"):
                end = re.compile(rf"</{tag}\s*(?:>|\Z)", re.I).search(page, at)
                if end:
                    at = end.end()
                elif tag in ("script", "style", "title", "textarea"):
                    at = len(page)
            close()
            continue
        kind = _PLAIN if ends or tag in _VOID else _judged(tag, m[3], main + inner > 0)
        if tag in _INLINE and not chrome.depth and kind < _CHROME_NAME:
            continue
        if tag not in _INLINE or tag == chrome.tag or nested.depth and tag == nested.tag:
            close()
        if chrome.depth:
            chrome.meet(tag, ends)
            nested.meet(tag, ends)
            if not chrome.depth:
                inner, holding, nested.depth = 0, False, 0
        if not chrome.depth and kind >= _CHROME_NAME:
            close()
            chrome.begin(tag, len(out), kind)
        elif chrome.depth and chrome.kind == _CHROME_NAME and not nested.depth and kind >= _CHROME_NAME:
            close()
            nested.begin(tag, len(out), kind)
        if tag not in _INLINE:
            if doubt.depth:
                doubt.meet(tag, ends)
            if not doubt.depth and not chrome.depth and kind == _DOUBTFUL:
                doubt.begin(tag, len(out), kind)
        if tag in _MAIN and not chrome.depth:
            main = max(0, main - 1) if ends else main + 1
            if not ends and doubt.depth and doubt.tag != tag:
                for block in out[doubt.first :]:
                    block[3] = False
                doubt.depth = 0
        elif tag in _MAIN and chrome.kind == _CHROME_NAME and chrome.tag != tag and (not nested.depth or nested.kind == _CHROME_NAME):
            if nested.depth and nested.tag != tag:
                for block in out[nested.first :]:
                    block[5] = False
                nested.depth = 0
            inner = max(0, inner - 1) if ends else inner + 1
            for block in out[chrome.first :]:
                block[4] = True
            holding = True
    close()
    # What holds an article or main is no chrome by its name, unless more text lies in an article or main elsewhere.
    if sum(len(b[0]) for b in out if b[4] and b[1] and not b[5]) > sum(len(b[0]) for b in out if b[1] and not b[2]):
        for block in out:
            block[2] = block[2] and (block[5] or not block[4])
    return [tuple(b[:4]) for b in out]


def blocks_of(page: str) -> list[tuple[str, bool, bool]]:
    """Texts of a page's blocks in order, each with: in an article or main element, in a part that is never main text.

    Character references are decoded and white space inside a block is one space. Elements left open end where the
    page does; a block element left open ends with the next one. What a script, style or comment holds is no text.

    Parts are never main text by their tag, as they are hidden, or by a whole name in class, id or role. Names of html,
    body, of headings in an article, and ids of sections in an article (but for comments) don't count, nor does a name
    of an element that holds most of the text in articles or main. A name that only begins like one of those leaves the
    part in.
    """
    return [b[:3] for b in _judged_blocks(page)]


_BLOCKS = "array<struct<text:string,main:boolean,chrome:boolean,doubtful:boolean>>"
_PARSED = f"page_id long, url string, key long, host string, settled boolean, blocks {_BLOCKS}"


def _settled(blocks: list[tuple[str, bool, bool, bool]]) -> bool:
    """The text lies in an article or main element for the larger part, even with all repeats outside, and has no doubtful block."""
    inside = sum(len(t) for t, m, c, _ in blocks if m and not c)
    outside = sum(len(t) for t, m, c, _ in blocks if not m and not c)
    return 0 < inside >= outside and not any(m and not c and d for _, m, c, d in blocks)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("text", "main", "chrome", "doubtful")
    blocks_type = pa.list_(pa.struct([("text", pa.string()), *((n, pa.bool_()) for n in names[1:])]))
    for batch in batches:
        for at in range(0, batch.num_rows, _AT_ONCE):
            part = batch.slice(at, _AT_ONCE)
            pages = [_judged_blocks(page or "") for page in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("page_id"), part.column("url"), part.column("key"), part.column("host"),
                    pa.array(map(_settled, pages), pa.bool_()),
                    pa.array([[dict(zip(names, b)) for b in blocks] for blocks in pages], blocks_type),
                ],
                names=["page_id", "url", "key", "host", "settled", "blocks"],
            )


def _inside() -> Column:
    """Texts of a page's blocks in an article or main element."""
    return F.transform(F.filter("blocks", lambda b: b["main"] & ~b["chrome"]), lambda b: b["text"])


def _placed(i: Column, text: Column) -> Column:
    return F.xxhash64(F.col("host"), i, text)


def _content() -> Column:
    return F.xxhash64("host", "t")


def _hosts(parsed: DataFrame, bits: int) -> DataFrame:
    """``host``, ``gone`` (hashes of blocks in articles that recur, with their places), ``runs`` (hashes of runs that are
    common in its articles) and ``open`` (repeats decide on a page).

    Hosts without any are left out. Pages with the same article are one. ``gone`` and ``runs`` have a few entries for each
    block and token of a page at most, as each is on a large share of the pages.
    """
    inside = parsed.select("host", "blocks", _inside().alias("t")).filter(F.size("t") > 0)
    n = F.size("t")
    from_start = F.transform("t", lambda t, i: _placed(i, t))
    from_end = F.transform("t", lambda t, i: _placed(i - n, t))
    articles = inside.select("host", _content().alias("content"), F.concat(from_start, from_end).alias("h"))
    articles = stored(articles.dropDuplicates(["content"]).drop("content"))
    totals = stored(articles.groupBy("host").agg(F.count("*").alias("pages")).filter(F.col("pages") >= PAGES))
    counts = articles.select("host", F.explode("h").alias("h")).groupBy("h").agg(F.first("host").alias("host"), F.count("*").alias("n"))
    often = counts.filter(F.col("n") >= PAGES).join(totals, "host").filter(F.col("n") >= SHARE * F.col("pages"))
    gone = often.groupBy("host").agg(F.collect_set("h").alias("gone"))
    runs = _common_runs(inside.select(F.xxhash64("host").alias("name"), _content().alias("content"), "t"), totals, bits)
    open_ = parsed.filter("NOT settled").select("host").distinct().withColumn("open", F.lit(True))
    found = gone.join(runs, "host", "full").join(open_, "host", "full")
    return stored(found.select("host", "gone", "runs", F.coalesce("open", F.lit(False)).alias("open")))


_ENTRY = np.dtype([("hash", "<u8"), ("key", "<u8"), ("pos", "<u4")])
_BLOCK = "bucket int, block binary"


def _dealt(entry: np.ndarray, field: str, bits: int) -> pa.RecordBatch:
    entry = entry[np.argsort(entry[field], kind="stable")]
    cut = list(cut_by_bucket(np.ascontiguousarray(entry[field]), bits))
    return pa.RecordBatch.from_arrays(
        [pa.array([b for b, _ in cut], pa.int32()), pa.array([entry[s].tobytes() for _, s in cut], pa.binary())],
        names=["bucket", "block"],
    )


_COMMON = np.dtype([("hash", "<u8"), ("content", "<u8"), ("host", "<u8")])
_LOW = U64(0xFFFFFFFF)


def _unsigned(x: int) -> np.uint64:
    return U64(x & 0xFFFFFFFFFFFFFFFF)


def _article_runs(texts: list[str], words: WordHashes, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of an article's runs of ``COMMON`` tokens, and the least gram in each."""
    hashes = words.of(" ".join(texts).encode().split())
    runs = windows.of(hashes, COMMON)
    if not len(runs):
        return runs, runs
    grams = windows.of(hashes, _GRAM)
    return runs, np.lib.stride_tricks.sliding_window_view(grams, COMMON - _GRAM + 1).min(1)


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (batch.slice(at, _AT_ONCE) for batch in batches for at in range(0, batch.num_rows, _AT_ONCE))


def _least_grams(bits: int) -> Callable:
    """Of each article, the least grams of its runs: half of a number is the host's, half the gram's, with how many articles."""

    def block(parts: list[np.ndarray]) -> pa.RecordBatch:
        gram, n = np.unique(np.concatenate(parts), return_counts=True)
        at = mixed(gram)
        order = np.argsort(at)
        gram, n = gram[order], n[order].astype("<u4")
        cut = list(cut_by_bucket(at[order], bits))
        return pa.RecordBatch.from_arrays(
            [pa.array([b for b, _ in cut], pa.int32()), pa.array([gram[x].tobytes() + n[x].tobytes() for _, x in cut], pa.binary())],
            names=["bucket", "block"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, windows, parts, held = WordHashes(), Windows(), [], 0
        for batch in _small(batches):
            for host, texts in zip(batch.column("name").to_pylist(), batch.column("t").to_pylist()):
                least = np.unique(_article_runs(texts, words, windows)[1] & _LOW)
                parts.append(least | (_unsigned(host) & ~_LOW))
                held += len(least)
                if held >= _GATHERED:
                    yield block(parts)
                    parts, held = [], 0
        if held:
            yield block(parts)

    return run


def _often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grams in several articles of a host."""
    for _, rows in grouped(batches):
        blocks = [(r["block"], len(r["block"]) // 12) for r in rows]
        gram = np.concatenate([np.frombuffer(x, "<u8", n) for x, n in blocks])
        n = np.concatenate([np.frombuffer(x, "<u4", n, 8 * n) for x, n in blocks])
        order = np.argsort(gram, kind="stable")
        gram, n = gram[order], n[order].astype(np.int64)
        first = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
        total = np.add.reduceat(n, first)
        some = total >= PAGES
        gram = gram[first][some]
        columns = [(gram >> U64(32)).astype(np.int64), (gram & _LOW).astype(np.int64), total[some]]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["half", "gram", "n"])


def _candidates(bits: int) -> Callable:
    """Runs whose least gram is often in articles of the host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, windows, parts, held = WordHashes(), Windows(), [], 0
        for batch in _small(batches):
            columns = [batch.column(c).to_pylist() for c in ("name", "content", "t", "grams")]
            for host, content, texts, grams in zip(*columns):
                runs, least = _article_runs(texts, words, windows)
                runs = np.unique(runs[np.isin(least & _LOW, np.array(grams, U64))])
                entry = np.empty(len(runs), _COMMON)
                entry["hash"], entry["content"], entry["host"] = mixed(runs ^ _unsigned(host)), _unsigned(content), _unsigned(host)
                parts.append(entry)
                held += len(runs)
                if held >= _GATHERED:
                    yield _dealt(np.concatenate(parts), "hash", bits)
                    parts, held = [], 0
        if held:
            yield _dealt(np.concatenate(parts), "hash", bits)

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs in several different articles of a host."""
    for _, rows in grouped(batches):
        entry = np.unique(np.frombuffer(b"".join(r["block"] for r in rows), _COMMON))
        first = np.flatnonzero(np.r_[True, entry["hash"][1:] != entry["hash"][:-1]])
        n = np.diff(np.r_[first, len(entry)])
        some = n >= PAGES
        found = entry[first][some]
        columns = [np.ascontiguousarray(found["host"]).view(np.int64), np.ascontiguousarray(found["hash"]).view(np.int64), n[some]]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["name", "run", "n"])


def _common_runs(articles: DataFrame, totals: DataFrame, bits: int) -> DataFrame:
    """``host`` and ``runs``: hashes of runs in the share ``SHARE`` of its different articles, of ``PAGES`` at least.

    A run has its least gram wherever it stands, so no run is lost by looking only at those whose least gram is often
    enough. Copies of articles are counted for grams and not for runs; ``totals`` counts different articles.
    """
    enough = F.col("n") >= SHARE * F.col("pages")
    named = totals.withColumn("name", F.xxhash64("host")).withColumn("half", F.shiftrightunsigned("name", 32))
    grams = by_bucket(articles.mapInArrow(_least_grams(bits), _BLOCK), bits).mapInArrow(_often, "half long, gram long, n long")
    grams = grams.join(named, "half").filter(enough).groupBy("name").agg(F.collect_set("gram").alias("grams"))
    some = articles.join(stored(grams), "name").mapInArrow(_candidates(bits), _BLOCK)
    runs = by_bucket(some, bits).mapInArrow(_counted, "name long, run long, n long")
    return runs.join(named, "name").filter(enough).groupBy("host").agg(F.collect_set("run").alias("runs"))


def _without_common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose article blocks have lost common runs, unless less than half of the article would be left."""
    words, windows = WordHashes(), Windows()
    for batch in _small(batches):
        rows = batch.to_pylist()
        for row in rows:
            article = [b for b in row["blocks"] if b["main"] and not b["chrome"]]
            texts = [b["text"] for b in article]
            runs = _article_runs(texts, words, windows)[0]
            common = np.isin(mixed(runs ^ _unsigned(row["name"])), np.array(row["runs"], np.int64).view(U64))
            if not common.any():
                continue
            left = unique_runs(texts, np.flatnonzero(common), COMMON)
            kept = [k and bool(x) for k, x in zip(row["kept"], left)]
            if 2 * sum(len(x) for x, k in zip(left, kept) if k) >= sum(map(len, texts)):
                row["kept"] = kept
                for block, text in zip(article, left):
                    block["text"] = text
        yield pa.RecordBatch.from_pylist(rows, batch.schema)


def _suffixes(run_length: int, bits: int) -> Callable:
    """Suffixes of each page's stream by their first tokens and host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, windows, parts, held = WordHashes(), Windows(), [], 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", "host", "blocks")]
            for key, host, blocks in zip(*columns):
                tokens = " ".join(b["text"] for b in blocks).encode().split()
                runs = windows.of(words.of(tokens), run_length)
                if len(runs):
                    entry = np.empty(len(runs), _ENTRY)
                    entry["hash"] = mixed(runs ^ U64(words[(host or "").encode()]))
                    entry["key"], entry["pos"] = key & 0xFFFFFFFFFFFFFFFF, np.arange(len(runs))
                    parts.append(entry)
                    held += len(runs)
                if held >= _GATHERED:
                    yield _dealt(np.concatenate(parts), "hash", bits)
                    parts, held = [], 0
        if parts:
            yield _dealt(np.concatenate(parts), "hash", bits)

    return run


def _repeated_suffixes(bits: int) -> Callable:
    """Suffixes whose first tokens another page's suffix shares, by page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in grouped(batches):
            entry = np.frombuffer(b"".join(r["block"] for r in rows), _ENTRY)
            entry = entry[np.lexsort((entry["key"], entry["hash"]))]
            hashes = entry["hash"]
            first = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
            last = np.r_[first[1:], len(hashes)] - 1
            several = np.repeat(entry["key"][first] != entry["key"][last], last - first + 1)
            yield _dealt(entry[several], "key", bits)

    return run


def unique_runs(blocks: list[str], starts: np.ndarray, run_length: int) -> list[str]:
    """Texts of a stream's blocks less what repeated runs cover."""
    tokens = [b.encode().split() for b in blocks]
    gone = covered(sum(map(len, tokens)), starts, run_length).tolist()
    out, at = [], 0
    for words in tokens:
        out.append(b" ".join(w for w, g in zip(words, gone[at : at + len(words)]) if not g).decode())
        at += len(words)
    return out


def _decided(blocks: list[dict], kept: list[bool], unique: list[str]) -> str:
    """Main text of a page on which repeats decide, ``kept`` saying which blocks inside its articles do not recur.

    Of the articles if they hold at least as much as what is unique outside, else of the unique runs of the whole page.
    """
    inside, all_of, outside = [], [], []
    stays = iter(kept)
    for block, left in zip(blocks, unique):
        if block["chrome"] or block["main"] and not next(stays):
            continue
        if block["main"]:
            inside.append(left if block["doubtful"] else block["text"])
        else:
            outside.append(left)
        all_of.append(left)
    inside, all_of, outside = (" ".join(filter(None, x)) for x in (inside, all_of, outside))
    return inside if 0 < len(inside) >= len(outside) else all_of


def _without_repeats(run_length: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in grouped(batches):
            entry = np.frombuffer(b"".join(r["block"] for r in rows if r["block"] is not None), _ENTRY)
            entry = entry[np.argsort(entry["key"], kind="stable")]
            keys = np.ascontiguousarray(entry["key"])
            pages = [r for r in rows if r["block"] is None]
            texts = []
            for r in pages:
                key = U64(r["key"] & 0xFFFFFFFFFFFFFFFF)
                low, high = np.searchsorted(keys, key), np.searchsorted(keys, key, "right")
                starts = np.unique(entry["pos"][low:high]).astype(np.int64)
                unique = unique_runs([b["text"] for b in r["blocks"]], starts, run_length)
                texts.append(_decided(r["blocks"], r["kept"], unique))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r["page_id"] for r in pages], pa.int64()),
                    pa.array([r["url"] for r in pages], pa.string()),
                    pa.array(texts, pa.string()),
                ],
                names=["page_id", "url", "text"],
            )

    return run


def main_text(pages: DataFrame, run_length: int = RUN) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every row of ``pages`` (``page_id``, ``url``, ``html``).

    See the module and :func:`blocks_of`. Blocks are joined by one space. A null or empty page has an empty text; a
    null or odd ``url`` counts as a host of its own name; rows repeated in all three columns are one page to the search
    for repeats and a row each in the result; other columns are left out; an empty table gives no rows.
    """
    spark = pages.sparkSession
    bits = bucket_bits(spark)
    pages = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")
    )
    keyed = pages.select(
        "page_id", "url", F.xxhash64("page_id", "url", "html").alias("key"),
        F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), _HOST, 1)).alias("host"), "html",
    )
    parsed = stored(keyed.mapInArrow(_parsed, _PARSED))
    judged_by = parsed.join(_hosts(parsed, bits), "host", "left").withColumn("t", _inside())
    n, none = F.size("t"), F.array().cast("array<long>")
    stays = lambda t, i: ~F.arrays_overlap(F.coalesce("gone", none), F.array(_placed(i, t), _placed(i - n, t)))
    flags = F.when(F.col("gone").isNull(), F.transform("t", lambda t: F.lit(True))).otherwise(F.transform("t", stays))
    length = lambda texts: F.aggregate(texts, F.lit(0), lambda a, t: a + F.length(t))
    left = F.filter("t", lambda t, i: F.get("flags", i))
    enough = 2 * length(left) >= length(F.col("t"))
    judged_by = judged_by.withColumn("flags", flags).withColumn(
        "kept", F.when(enough, F.col("flags")).otherwise(F.transform("t", lambda t: F.lit(True)))
    )
    columns = ["page_id", "url", "key", "host", "settled", "blocks", "kept", "open"]
    cut = judged_by.filter("runs IS NOT NULL").select(*columns, "runs", F.xxhash64("host").alias("name"))
    cut = cut.mapInArrow(_without_common, cut.schema).select(columns)
    judged_by = judged_by.filter("runs IS NULL").select(columns).unionByName(cut).withColumn("t", _inside())
    suffixes = judged_by.filter("open").select("key", "host", "blocks").mapInArrow(_suffixes(run_length, bits), _BLOCK)
    repeats = by_bucket(suffixes, bits).mapInArrow(_repeated_suffixes(bits), _BLOCK)
    open_pages = judged_by.filter("NOT settled").select(
        F.shiftrightunsigned("key", 64 - bits).cast("int").alias("bucket"), F.lit(None).cast("binary").alias("block"),
        "key", "page_id", "url", "blocks", "kept",
    )
    empty = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in open_pages.schema if f.name not in ("bucket", "block")}
    both = repeats.select("bucket", "block", *empty.values()).unionByName(open_pages)
    judged = by_bucket(both, bits).mapInArrow(_without_repeats(run_length), "page_id long, url string, text string")
    inside = F.array_join(F.filter("t", lambda t, i: F.get("kept", i)), " ")
    found = judged_by.filter("settled").select("page_id", "url", inside.alias("text")).unionByName(judged)
    return found.withColumn("n_chars", F.length("text").cast("long"))
