"""HTML extraction: a suffix array over each host's pages, then page structure for what the array leaves.

Every page becomes blocks of text; each block knows the article (or main) element it stands in, if any, and whether
markup calls it noise (scripts and styles never become blocks; menus, headers, footers, sidebars, forms, adverts,
notices and reader comments by element, role or class).

What stands outside of an article, noise or not, is a page's token stream.  The streams of a host are concatenated, a
suffix array finds token runs of at least MIN_RUN that occur on at least MIN_PAGES distinct pages of the host, and
blocks that such runs cover for the most part are boilerplate and go.  Markup decides what the array leaves: noise goes;
if one article element has at least half of the page's text, it is the article and the rest goes; otherwise unique
blocks stay, in page order with what the articles have.

Each task runs the array over the pages of a host that it has itself, at most GROUP tokens at once, and passes on the
runs, named by 64-bit hashes over host and tokens, with at most MIN_PAGES distinct pages each; the pages are then
counted by run over all tasks.  So the result does not depend on how pages are dealt out, no host is gathered anywhere,
and one with a third of all pages is no different from any other.  The runs that reach MIN_PAGES are held against the
pages by a broadcast of at most KNOWN numbers; where there are more they are joined to the pages' runs instead.

Defined results: null and empty html give an empty text; repeated rows are extracted each on its own; pages of a host
with the same blocks count as one page; a null url belongs to the empty host; an empty table gives an empty table; extra
columns are ignored.  Very long pages are processed whole, in time linear in their length whatever their tags.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, discard, needed, settled, splitmix, table

MIN_RUN, MIN_PAGES, COVER = 5, 3, 0.8
#: tokens of one suffix array, tokens that a task holds, and runs that are broadcast (8 bytes each), at most
GROUP, HELD, KNOWN = 100_000, 1_000_000, 2_000_000
SKIP = frozenset("script style noscript template iframe object embed svg math canvas audio video head title nav aside footer form button select option textarea input label dialog menu fieldset".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul aside caption".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog alertdialog".split())
#: words in class or id that mark what is not the article; outside of an article they count wherever they stand between other characters than letters and digits
WORDS = "ad ads advert advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup sign-up login log-in menu nav navbar navigation breadcrumb breadcrumbs header masthead footer sidebar side-bar widget related recommended share sharing social comment comments replies disqus respond reader-comment reader-comments toolbar pagination pager skip copyright".split()
NOISE = re.compile(r"(?:^|[^a-z0-9])(" + "|".join(sorted(WORDS, key=len, reverse=True)) + r")(?:$|[^a-z0-9])")
#: in an article a name must be made of such words alone, but for these: ad-slot is an advert, share-price and comments-policy are the article's
LAYOUT = frozenset("slot unit box container wrapper block list links link button buttons bar section area form top bottom left right inline wide small large main inner outer content".split())
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<![^>]*>?|<\?[^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
SPACE = re.compile(r"\s+")
#: elements whose start closes an open p, by the rules of HTML
CLOSES_P = BLOCK - {"body", "html", "tbody", "td", "th", "thead", "tfoot", "tr", "caption", "dd", "dt", "li"}


def _noise(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in SKIP or (tag == "header" and not in_article):
        return True
    if "=" in attributes or "hidden" in attributes:
        if re.search(r"(?:^|\s)hidden(?:$|\s|=|/)", attributes.lower()):
            return True
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name == "role" and value in ROLES or name == "aria-hidden" and value == "true" or name in ("class", "id") and tag not in ("body", "html", "article", "main") and any(_marked(x, in_article) for x in value.split()):
                return True
    return False


def _marked(name: str, in_article: bool) -> bool:
    """Whether a class or id names something else than the article; has-sidebar and the like describe a layout, an article's header is its own."""
    if name.startswith(("has-", "with-", "no-", "is-")) or not NOISE.search(name):
        return False
    if not in_article:
        return True
    left = {x for x in re.split(r"[^a-z0-9]+", NOISE.sub(" ", NOISE.sub(" ", name))) if x}
    return left <= LAYOUT and any(m[1] not in ("header", "banner") for m in NOISE.finditer(name))


def blocks(page: str) -> list[tuple[int, bool, str]]:
    """(number of the outermost article or main element it stands in, or 0; whether markup calls it noise; text) of all blocks."""
    out: list[tuple[int, bool, str]] = []
    roots = 0
    stack: list[tuple[str, bool, bool]] = []  # element, noise, in the article
    places: dict[str, list[int]] = {}  # where each element is open
    bounds: list[int] = []  # where a p, a block or a button is open: what the start of a block looks at
    walls: list[int] = []  # where an article, main or body is open: end tags of other elements do not reach below
    parts: tuple[list[str], list[str]] = ([], [])  # the text of the block, and what markup calls noise in it
    noise = article = False
    at, size = 0, len(page)

    def flush() -> None:
        for kind, held in zip((False, True), parts):
            if held:
                text = SPACE.sub(" ", entities.unescape("".join(held))).strip()
                held.clear()
                if text:
                    out.append((roots if article else 0, kind, text))

    def close(k: int) -> None:
        """All elements from place k on end."""
        nonlocal noise, article
        _, noise, article = stack[k]
        for name, _, _ in stack[k:]:
            places[name].pop()
        del stack[k:]
        for held in (bounds, walls):
            while held and held[-1] >= k:
                held.pop()

    while at < size:
        m = TOKEN.search(page, at)
        end = m.start() if m else size
        if end > at:
            parts[noise].append(page[at:end])
        if not m:
            break
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        if not m[1]:
            attributes = m[3] or ""
            if tag in BLOCK:
                flush()
            elif tag == "br":
                parts[noise].append(" ")
                continue
            if tag in VOID:
                continue
            if tag in RAW:
                ends = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = ends.end() if ends else size
                continue
            if tag in CLOSES_P and bounds and stack[bounds[-1]][0] == "p":  # an open p ends here, with what is open in it
                close(bounds[-1])
            k = len(stack)
            stack.append((tag, noise, article))
            places.setdefault(tag, []).append(k)
            if tag in BLOCK or tag == "button":
                bounds.append(k)
            if tag in ("article", "main", "body"):
                walls.append(k)
            noise = noise or _noise(tag, attributes, article)
            if not article and not noise and tag in ("article", "main"):  # a reader comment is no article
                article, roots = True, roots + 1
        else:
            if tag in BLOCK:
                flush()
            if places.get(tag) and (not walls or places[tag][-1] >= walls[-1] or tag in ("html", "body", "article", "main")):
                close(places[tag][-1])
    flush()
    return out


def suffix_array(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array by prefix doubling, and the longest common prefix of each suffix with the one before it."""
    n = len(tokens)
    rank, span = np.unique(tokens, return_inverse=True)[1].astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while n:
        follow = np.full(n, -1, dtype=np.int64)
        follow[: n - span] = rank[span:] if span < n else rank[:0]
        order = np.lexsort((follow, rank))
        step = np.ones(n, dtype=np.int64)
        step[0] = 0
        step[1:] = (rank[order][1:] != rank[order][:-1]) | (follow[order][1:] != follow[order][:-1])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(step)
        span *= 2
        if rank[order[-1]] == n - 1 or span >= n:
            break
    common, h, place, text, at = [0] * n, 0, rank.tolist(), tokens.tolist(), order.tolist()
    for i in range(n):
        if place[i]:
            j = at[place[i] - 1]
            while i + h < n and j + h < n and text[i + h] == text[j + h]:
                h += 1
            common[place[i]] = h
            h = max(h - 1, 0)
        else:
            h = 0
    return order, np.array(common, dtype=np.int64)


def _stream(pages: list[list[str]]) -> tuple[np.ndarray, np.ndarray, dict[str, int]]:
    """The pages' tokens as numbers, the page of each, and the numbers' names; a negative separator of its own ends each page."""
    names: dict[str, int] = {}
    stream, owner = [], []
    for k, page in enumerate(pages):
        stream += [names.setdefault(t, len(names)) for t in page] + [-1 - k]
        owner += [k] * (len(page) + 1)
    return np.array(stream, dtype=np.int64), np.array(owner, dtype=np.int64), names


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def run_hashes(tokens: np.ndarray, names: dict[str, int], host: str, min_run: int = MIN_RUN) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of min_run tokens inside one page of the host, and the place it starts at."""
    m = len(tokens) - min_run + 1
    if m <= 0:
        return np.empty(0, U64), np.empty(0, np.int64)
    upto = np.append(0, np.cumsum(tokens < 0))
    at = np.flatnonzero(upto[min_run:] == upto[:m])
    codes = np.array([*map(_hash, names), 0], dtype=U64)[tokens.clip(-1)]
    with np.errstate(over="ignore"):
        acc = np.full(len(at), _hash(host), dtype=U64)
        for j in range(min_run):
            acc = acc * U64(0x9E3779B97F4A7C15) + codes[at + j]
            acc ^= acc >> U64(29)
    return splitmix(acc), at


def repeated_runs(pages: dict[int, list[str]], host: str = "", min_run: int = MIN_RUN, min_pages: int = MIN_PAGES) -> tuple[np.ndarray, np.ndarray]:
    """(run, page) of the runs of min_run tokens in the pages (by number) of a host, each with its smallest min_pages pages."""
    tokens, pages_of, names = _stream(list(pages.values()))
    key, at = run_hashes(tokens, names, host, min_run)
    if not len(at):
        return np.empty(0, U64), np.empty(0, U64)
    name = np.zeros(len(tokens), dtype=U64)
    inside = np.zeros(len(tokens), dtype=bool)
    name[at], inside[at] = key, True
    # suffixes next to each other with at least min_run tokens in common begin with one run
    order, common = suffix_array(tokens)
    group = np.cumsum(common < min_run)
    run = inside[order]
    group, order = group[run], order[run]
    page = np.array([*pages], dtype=U64)[pages_of[order]]
    by = np.lexsort((page, group))
    group, page, order = group[by], page[by], order[by]
    first = np.append(True, (group[1:] != group[:-1]) | (page[1:] != page[:-1]))
    group, page, order = group[first], page[first], order[first]
    few = np.ones(len(group), dtype=bool)
    few[min_pages:] = group[min_pages:] != group[: max(len(group) - min_pages, 0)]
    return name[order][few], page[few]


def outside(found: list[tuple[int, bool, str]]) -> list[list[str]]:
    """The tokens of each block that stands outside of an article."""
    return [t.split(" ") for root, _, t in found if not root]


def covered(found: list[tuple[int, bool, str]], host: str, known: np.ndarray, min_run: int = MIN_RUN, cover: float = COVER) -> list[bool]:
    """For each block outside of an article, whether known runs (sorted) cover it for the most part."""
    words = outside(found)
    tokens, _, names = _stream([[w for b in words for w in b]])
    hits = np.zeros(len(tokens) + 1, dtype=np.int64)
    key, at = run_hashes(tokens, names, host, min_run)
    if len(known) and len(at):
        at = at[known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key]
        np.add.at(hits, at, 1)
        np.add.at(hits, at + min_run, -1)
    total = np.append(0, np.cumsum(np.cumsum(hits[:-1]) > 0))
    ends = np.cumsum([0, *map(len, words)])
    return [bool(total[b] - total[a] >= cover * (b - a)) for a, b in zip(ends.tolist(), ends.tolist()[1:])]


def decided(found: list[tuple[int, bool, str]]) -> bool:
    """Whether markup alone tells the article: nothing else than noise stands outside, or one element has at least half of the text."""
    clean = [(r, t) for r, noise, t in found if not noise]
    inside, rest = (sum(len(t) for r, t in clean if (r > 0) == side) for side in (True, False))
    return inside > 0 and (not rest or len({r for r, _ in clean if r}) == 1 and inside >= rest)


ARRAY, MARKUP, STAYS = "array", "markup", "stays"


def judged(found: list[tuple[int, bool, str]], host: str, known: np.ndarray, min_run: int = MIN_RUN, cover: float = COVER) -> list[str]:
    """For each block what drops it, the array first, or that it stays."""
    gone, sure = iter(covered(found, host, known, min_run, cover)), decided(found)
    return [ARRAY if not root and next(gone) else MARKUP if noise or (sure and not root) else STAYS for root, noise, _ in found]


def _host(url: str | None) -> str:
    return re.split(r"[/?#]", url.split("://", 1)[1], maxsplit=1)[0].lower() if url and "://" in url else ""


def _page(found: list[tuple[int, bool, str]]) -> int:
    """What tells pages of a host apart: all their blocks."""
    return _hash("\0".join(t for _, _, t in found))


def usual_runs(rows: DataFrame, min_run: int = MIN_RUN, min_pages: int = MIN_PAGES, group: int = GROUP, held: int = HELD) -> DataFrame:
    """key: the runs that at least min_pages distinct pages of a host have outside of their articles, from rows (url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hosts: dict[str, dict[int, list[str]]] = {}
        sizes: dict[str, int] = {}

        def out(names: list[str]) -> Iterator[pa.RecordBatch]:
            made = [repeated_runs(hosts.pop(h), h, min_run, min_pages) for h in names]
            for h in names:
                del sizes[h]
            for x in range(0, len(made), 100):
                key, page = (np.concatenate(c).view(np.int64) for c in zip(*made[x : x + 100]))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(page)], names=["key", "page"])

        for batch in batches:
            for url, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist()):
                found, host = blocks(page or ""), _host(url)
                words = [w for b in outside(found) for w in b]
                if len(words) < min_run:
                    continue
                hosts.setdefault(host, {})[_page(found)] = words
                sizes[host] = sizes.get(host, 0) + len(words)
                if sizes[host] > group:
                    yield from out([host])
            if sum(sizes.values()) > held:
                yield from out(list(hosts))
        yield from out(list(hosts))

    runs = rows.select("url", "html").mapInArrow(run, "key long, page long")
    return runs.groupBy("key").agg(F.countDistinct("page").alias("n")).where(F.col("n") >= min_pages).select("key")


RESULT = "page_id long, url string, text string, by_array int, by_markup int"


def _judge(batches: Iterator[pa.RecordBatch], known: Callable[[pa.RecordBatch, int], np.ndarray], min_run: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, array, markup = [], [], []
        for i, (url, page) in enumerate(zip(batch.column("url").to_pylist(), batch.column("html").to_pylist())):
            found = blocks(page or "")
            says = judged(found, _host(url), known(batch, i), min_run)
            texts.append("\n\n".join(t for (_, _, t), x in zip(found, says) if x == STAYS))
            array.append(says.count(ARRAY))
            markup.append(says.count(MARKUP))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(array, pa.int32()), pa.array(markup, pa.int32())], names=[x.split()[0] for x in RESULT.split(", ")])


def _joined(rows: DataFrame, usual: DataFrame, min_run: int) -> DataFrame:
    """rows with the usual runs that each has, where these are too many to be broadcast: runs are joined, and come back by page."""
    named = rows.withColumn("_row", F.xxhash64("url", "html"))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, url, page in zip(batch.column("_row").to_pylist(), batch.column("url").to_pylist(), batch.column("html").to_pylist()):
                tokens, _, names = _stream([[w for b in outside(blocks(page or "")) for w in b]])
                key = np.unique(run_hashes(tokens, names, _host(url), min_run)[0]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), row)), pa.array(key)], names=["_row", "key"])

    runs = named.select("_row", "url", "html").mapInArrow(own, "_row long, key long").distinct()
    mine = runs.join(usual, "key").groupBy("_row").agg(F.collect_set("key").alias("known"))
    return named.join(mine, "_row", "left").select("page_id", "url", "html", "known")


def extract(pages: DataFrame, min_run: int = MIN_RUN, min_pages: int = MIN_PAGES, group: int = GROUP, most_known: int = KNOWN) -> DataFrame:
    """page_id, url, text, n_chars, and how many blocks the array and the markup dropped, of each row of pages (page_id, url, html)."""
    spark = pages.sparkSession
    rows = needed(pages, page_id="long", url="string", html="string")
    usual = settled(spark, usual_runs(rows, min_run, min_pages, group), "usual-runs")
    if usual.limit(most_known + 1).count() <= most_known:
        runs = spark.sparkContext.broadcast(np.sort(usual.toPandas()["key"].to_numpy(dtype=np.int64).view(U64)))
        discard(spark, usual)
        out = rows.mapInArrow(lambda batches: _judge(batches, lambda *_: runs.value, min_run), RESULT)
    else:
        none = np.empty(0, U64)

        def own(batch: pa.RecordBatch, i: int) -> np.ndarray:
            x = batch.column("known")[i]
            return np.sort(x.values.to_numpy().view(U64)) if x.is_valid else none

        out = _joined(rows, usual, min_run).mapInArrow(lambda batches: _judge(batches, own, min_run), RESULT)
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "by_array", "by_markup")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
