"""Main text of web pages: page structure, and runs of tokens that pages of a host share, which are boilerplate.

Structure settles what markup says: menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
comments go. All other text of a page is a stream of tokens, and those of a host's pages are searched for long substrings
that distinct pages share. Their places are sampled suffixes: grams whose hash is smallest among any LONG_RUN - GRAM + 1
in a row, so that equal substrings of LONG_RUN tokens show the same ones; where a gram recurs, all substrings of LONG_RUN
tokens around it are counted. Equal whole blocks count as such, however short.

In an article, a substring goes if most pages of its host have it, in streams that differ otherwise: a text that a host
publishes twice is still the main text of both pages. Text outside an article goes where one other page has it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import Rolling, WordHashes, discard, local_minima, mix, stored

#: Tokens in a row that make a shared substring: outside articles, and in them.
LEAST_RUN, LONG_RUN = 10, 20
GRAM = 8
#: Differing streams of a host below which nothing in an article is boilerplate.
LEAST_STREAMS = 8
#: Shared substrings that are broadcast; more are joined by host.
MOST_BROADCAST = 200_000
EXTRACTED = "page_id long, url string, text string"
SPLIT = f"{EXTRACTED}, host string, blocks array<struct<sure:boolean,text:string>>"

TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<(?:script|style|noscript|template|svg|iframe|head|title|textarea|select)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*(?<!/)>"
    r"|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S,
)
#: Elements by what they are for.
RAW = "script style noscript template svg iframe head title textarea select"
NEVER = set("nav header footer aside form menu dialog button object audio video canvas".split())
BLOCKS = set(
    "address article blockquote body caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr"
    " html legend li main ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
) | NEVER
VOID = set("area base br col embed hr img input link meta source track wbr".split())
NAMES = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent notice"
    " notices alert popup modal newsletter subscribe sidebar nav navbar navigation menu breadcrumb breadcrumbs header"
    " footer comment comments disqus replies responses discussion discussions feedback reviews share sharing social related recommended widget widgets banner".split()
)
#: Words that may stand beside those in a name without changing what it says ("nav-bar", but not "ad-hoc").
BESIDE = set(
    "bar area section box block slot unit wrap wrapper container inner outer list item items link links button buttons btn"
    " form panel left right top bottom main site page global primary secondary mobile desktop js is side column col".split()
)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert"}
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW.split()}


def names_chrome(name: str) -> bool:
    parts = [w.lower() for w in PARTS.findall(name)]
    return any(w in NAMES for w in parts) and all(w in NAMES or w in BESIDE for w in parts)


def is_chrome(attributes: str) -> bool:
    """Whether class, id or role say that an element is not the page's own text."""
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id") and any(map(names_chrome, value.split())):
            return True
        if name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
    return False


def blocks(html: str) -> list[tuple[bool, str]]:
    """Blocks of text that markup does not rule out, in page order: whether an article (or main) holds it, text."""
    found: list[tuple[bool, str]] = []
    part: list[str] = []
    skip: list[str] = []  # open elements within one that is left out, that one first
    article, at, n = 0, 0, len(html)

    def end_block() -> None:
        if part:
            text = " ".join(unescape("".join(part)).split())
            part.clear()
            if text:
                found.append((article > 0, text))

    while at < n:
        m = TOKEN.search(html, at)
        if not skip:
            text = html[at : m.start() if m else n]
            if text:
                part.append(text)
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            raw = re.match(r"<([a-z]+)", m[0], re.I)
            if raw and (end := ENDS.get(raw[1].lower())):
                close = end.search(html, at)
                at = close.end() if close else at if raw[1].lower() == "head" else n
            continue
        if m[1]:
            if skip:
                if name in skip:
                    while skip.pop() != name:
                        pass
                continue
            if name in BLOCKS:
                end_block()
            if name in ("article", "main") and article:
                article -= 1
        elif skip:
            if name == skip[0] or name in NEVER:
                if not m[3].endswith("/"):
                    skip.append(name)
        elif name not in VOID and (name in NEVER or name not in ("body", "html", "main") and is_chrome(m[3])):
            end_block()
            if not m[3].endswith("/"):
                skip.append(name)
        else:
            if name in BLOCKS:
                end_block()
            elif name in VOID and name != "wbr":
                part.append(" ")
            if name in ("article", "main"):
                article += 1
    end_block()
    return found


class Keys:
    """Hashes of blocks and of token runs."""

    def __init__(self):
        self.words, self.rolling = WordHashes(), Rolling(21)

    def tokens(self, texts: list[str]) -> np.ndarray:
        return self.words.of([w.encode() for text in texts for w in text.split()])

    def blocks(self, texts: list[str]) -> np.ndarray:
        return mix(self.words.of([text.encode() for text in texts]) ^ np.uint64(1))

    def grams(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sampled grams: hashes, places."""
        g = self.rolling.load(tokens).windows(GRAM)
        at = local_minima(g, LONG_RUN - GRAM + 1)
        return g[at], at

    def windows(self, tokens: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and places of the runs of LONG_RUN tokens that hold a gram at one of these places."""
        reach, last = LONG_RUN - GRAM, len(tokens) - LONG_RUN
        at = np.unique((near[:, None] - np.arange(reach + 1)[None, :]).reshape(-1))
        at = at[(at >= 0) & (at <= last)]
        return self.rolling.load(tokens).windows(LONG_RUN, at), at


def _keys(pages: DataFrame, wide: DataFrame | None) -> DataFrame:
    """(host, key, stream): keys of each page's article text, once per page; key 0 stands for the page itself. Without
    wide, keys are blocks and sampled grams; with wide (host, keys), the runs around those of its grams."""
    sampled = wide is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        keys = Keys()
        for batch in batches:
            hosts, out = batch.column(0), []
            for i, html in enumerate(batch.column(1).to_pylist()):
                inside = [text for sure, text in blocks(html or "") if sure]
                if not inside:
                    continue
                tokens = keys.tokens(inside)
                if sampled:
                    own = np.concatenate((keys.blocks(inside), keys.grams(tokens)[0], np.zeros(1, dtype=np.uint64)))
                else:
                    g, at = keys.grams(tokens)
                    own = keys.windows(tokens, at[np.isin(g, batch.column(2)[i].values.to_numpy().view(np.uint64))])[0]
                own = np.unique(own).view(np.int64)
                stream = xxhash.xxh3_64_intdigest("\n".join(inside)) - 2**63
                out.append((np.full(len(own), i), own, np.full(len(own), stream)))
            at, own, streams = (np.concatenate([x[k] for x in out] or [np.empty(0, dtype=np.int64)]) for k in range(3))
            yield pa.RecordBatch.from_arrays([hosts.take(pa.array(at)), pa.array(own), pa.array(streams)], names=["host", "key", "stream"])

    rows = pages.select("host", "html") if sampled else _with_host(pages, wide).filter("keys is not null").select("host", "html", "keys")
    return rows.mapInArrow(run, "host string, key long, stream long")


def _with_host(pages: DataFrame, wide: DataFrame) -> DataFrame:
    """pages with the keys of their host; wide has one row per host, and as many keys at most as twice a page's tokens,
    because each is on more than half of the pages."""
    few = wide.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0] <= MOST_BROADCAST
    return pages.join(F.broadcast(wide) if few else wide, "host", "left")


def _counted(keys: DataFrame) -> DataFrame:
    """(host, key, n): differing streams of the host that hold the key."""
    return keys.distinct().groupBy("host", "key").agg(F.count("*").alias("n")).filter(F.expr(f"key = 0 or n >= {LEAST_STREAMS}"))


def _most(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """(host, keys) that more than half of a host's differing streams hold."""
    wide = counts.filter("key <> 0").join(totals, "host").filter("2 * n > streams")
    return stored(wide.groupBy("host").agg(F.collect_set("key").alias("keys")), "wide")


def common_runs(pages: DataFrame) -> DataFrame:
    """(host, keys): blocks and runs of LONG_RUN tokens in articles that most pages of a host have. pages: host, html."""
    counts = stored(_counted(_keys(pages, None)), "counts")
    totals = counts.filter("key = 0").select("host", F.col("n").alias("streams"))
    first = _most(counts, totals)
    if not first.isEmpty():
        runs = stored(_counted(_keys(pages, first)), "runs")
        found = _most(runs.union(counts.filter("key <> 0")), totals)
        discard(runs, first)
        first = found
    discard(counts)
    return first


def without(texts: list[str], common: np.ndarray, keys: Keys) -> list[str]:
    """The blocks of an article without those, and without the runs, that are common."""
    tokens = keys.tokens(texts)
    at = np.arange(max(0, len(tokens) - LONG_RUN + 1))
    hit = at[np.isin(keys.rolling.load(tokens).windows(LONG_RUN, at), common)] if len(at) else at
    marks = np.zeros(len(tokens) + 1, dtype=np.int64)
    np.add.at(marks, hit, 1)
    np.add.at(marks, hit + LONG_RUN, -1)
    covered, at, out = np.cumsum(marks) > 0, 0, []
    for text, gone in zip(texts, np.isin(keys.blocks(texts), common)):
        words = text.split()
        out.append("" if gone else " ".join(w for w, c in zip(words, covered[at : at + len(words)]) if not c))
        at += len(words)
    return out


def runs(host: str, words: list[str]) -> np.ndarray:
    """Hashes of all LEAST_RUN tokens in a row of a page of a host."""
    import xxhash

    found = [xxhash.xxh3_64_intdigest("\n".join([host, *words[i : i + LEAST_RUN]])) for i in range(len(words) - LEAST_RUN + 1)]
    return np.array(found, dtype=np.uint64).view(np.int64)


def unshared(host: str, found: list[dict], shared: list[int]) -> str:
    """All blocks, one per line, those outside articles without the tokens in shared runs."""
    doubt = [b["text"] for b in found if not b["sure"]]
    words = [w for text in doubt for w in text.split()]
    same = np.array(shared, dtype=np.int64)
    hit = np.flatnonzero(np.isin(runs(host, words), same))
    marks = np.zeros(len(words) + 1, dtype=np.int64)
    marks[hit] += 1
    marks[hit + LEAST_RUN] -= 1  # each run starts and ends once
    covered, at, out = np.cumsum(marks) > 0, 0, []
    gone = iter(np.isin(whole_blocks(host, doubt), same).tolist())
    for block in found:
        if block["sure"]:
            out.append(block["text"])
            continue
        part = block["text"].split()
        rest = [] if next(gone) else [w for w, c in zip(part, covered[at : at + len(part)]) if not c]
        if rest:
            out.append(" ".join(rest))
        at += len(part)
    return "\n".join(out)


def whole_blocks(host: str, texts: list[str]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(f"{host}\n\n{text}") for text in texts], dtype=np.uint64).view(np.int64)


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, "://([^/?#]*)", 1)), F.lit(""))


def extract(pages: DataFrame) -> DataFrame:
    """Main text of every page: its blocks, one per line.

    Null html gives an empty text; null ids and urls stay, pages without a host are of one host; a repeated row is a page
    of its own, but rows of one page_id or of one html do not make each other boilerplate.
    """
    page_id, url = F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")
    rows = pages.select(page_id, url, F.col("html").cast("string").alias("html")).withColumn("host", host_of(F.col("url")))
    wide = common_runs(rows)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = Keys()
        for batch in batches:
            texts, rest = [], []
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                for html, common in zip(part.column(3).to_pylist(), part.column(4)):
                    found = blocks(html or "")
                    if common.is_valid:
                        kept = iter(without([t for sure, t in found if sure], common.values.to_numpy().view(np.uint64), keys))
                        found = [(sure, next(kept) if sure else text) for sure, text in found]
                        found = [b for b in found if b[1]]
                    sure = all(x for x, _ in found)
                    texts.append("\n".join(text for _, text in found) if sure else None)
                    rest.append([] if sure else [{"sure": x, "text": text} for x, text in found])
            kind = pa.list_(pa.struct([("sure", pa.bool_()), ("text", pa.string())]))
            columns = [*batch.columns[:2], pa.array(texts, pa.string()), batch.column(2), pa.array(rest, kind)]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "host", "blocks"])

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for host, doubt in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                found.append(np.unique(np.concatenate((runs(host, [w for b in doubt for w in b.split()]), whole_blocks(host, doubt)))))
            row = np.repeat(np.arange(len(found)), [len(x) for x in found])
            run = np.concatenate([*found, np.empty(0, dtype=np.int64)])
            columns = [pa.array(run), batch.column(1).take(pa.array(row)), batch.column(2).take(pa.array(row))]
            yield pa.RecordBatch.from_arrays(columns, names=["run", "page", "stream"])

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(x).to_pylist() for x in ("host", "blocks", "runs")))
            text = pa.array([unshared(host, found, shared or []) for host, found, shared in rows], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), text], names=["page_id", "url", "text"])

    known = _with_host(rows, wide).select("page_id", "url", "host", "html", "keys")
    parts = stored(known.mapInArrow(split, SPLIT), "pages")
    discard(wide)
    sure = parts.filter("size(blocks) = 0").select("page_id", "url", "text")
    # Equal streams of a host are one. All steps group by run or stream, none by host.
    doubt = parts.filter("size(blocks) > 0").withColumn("doubt", F.expr("transform(filter(blocks, b -> not b.sure), b -> b.text)"))
    doubt = doubt.withColumn("stream", F.xxhash64("host", F.array_join("doubt", "\n")))
    page = F.coalesce("page_id", "stream")
    one = doubt.select("host", page.alias("page"), "stream", "doubt").dropDuplicates(["page", "stream"])
    occurring = stored(one.mapInArrow(held, "run long, page long, stream long"), "runs")
    ends = [f(x).alias(f"{n}_{x}") for x in ("page", "stream") for f, n in ((F.min, "min"), (F.max, "max"))]
    common = occurring.groupBy("run").agg(*ends).filter("min_page < max_page and min_stream < max_stream").select("run")
    found = occurring.select("run", "stream").distinct().join(common, "run").groupBy("stream").agg(F.collect_list("run").alias("runs"))
    found = stored(found, "shared")
    discard(occurring)
    keyed = doubt.join(found, "stream", "left").select("host", "page_id", "url", "blocks", "runs")
    return sure.union(keyed.mapInArrow(clean, EXTRACTED))
