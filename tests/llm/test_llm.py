"""Each operator against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import decontaminate, html_text, licenses, near_dedup, packing, quality, substring_dedup, suffix_dedup, toxicity, url_filter
from sluice.llm.common import LOWER, PLAIN, Rolling, local_minima, merged
from sluice.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, n_words string, node int"  # the last two clash with names used inside


def make(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = [w + m for w in ("aa", "bé", "cat", "dog", "to", "Of", "x") for m in ("", ".", "ing", "!!", "7")]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage = text(120), text(70)
    near = base.split()
    near[60] = "other"
    out = [(0, None), (1, ""), (2, " \n\t "), (3, base), (4, base), (5, " ".join(near)), (6, text(40) + " " + passage)]
    out += [(7, passage + "\n" + text(30)), (8, text(3)), (9, "dog " * 300), (10, text(4000)), (11, text(60) + " " + passage + " " + text(5))]
    out += [(12, "All rights reserved. Licensed under CC BY-NC 4.0."), (13, "one"), (13, "one"), (None, base), (14, text(200))]
    return out


def test_rolling_and_minima():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 50, 500).astype(np.uint64)
    g = Rolling().load(h).windows(3)
    seen = {}
    for i, x in enumerate(g.tolist()):
        assert seen.setdefault(tuple(h[i : i + 3].tolist()), x) == x
    assert len(set(seen.values())) == len(seen)
    at = set(local_minima(g, 10).tolist())
    assert all(at & set(range(i, i + 10)) for i in range(len(g) - 9))
    s, e = merged(np.array([5, 0, 3, 9]), np.array([7, 2, 5, 10]))
    assert s.tolist() == [0, 3, 9] and e.tolist() == [2, 7, 10]


def test_packing(spark, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    out = packing.pack_documents(make(spark, rows), tokenizer_path(), length=256).toPandas()
    want = Counter()
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        for s in range(0, len(ids), 256):
            part = ids[s : s + 256]
            want[(str(i), s, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes()), len(ids))] += 1
    ids = out.doc_id.map(lambda x: str(int(x)) if x == x else "None")
    assert Counter(zip(ids, out.start, out.length, out.ids_crc32, out.doc_tokens)) == want
    for _, part in out.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert part.offset.tolist() == [0, *part.length.cumsum().tolist()[:-1]] and part.length.sum() <= 256
    assert packing.pack_documents(make(spark, []), tokenizer_path()).count() == 0


def test_best_fit_takes_the_tightest():
    windows, offsets, made = packing.best_fit_decreasing([7, 6, 4, 3, 2], 10)
    assert made == 3 and windows == [0, 1, 1, 0, 2] and offsets == [0, 0, 6, 7, 0]


def test_substring_dedup(spark, rows):
    for sample in (rows, []):
        out = substring_dedup.remove_repeats(make(spark, sample)).select("doc_id", "text", "n_words", "kept_text", "carried").collect()
        first = {}
        for i, text in sample:
            w = (text or "").encode().split()
            for p in range(len(w) - 49) if i is not None else ():
                k = tuple(w[p : p + 50])
                first[k] = min(i, first.get(k, i))
        want = Counter()
        for i, text in sample:
            w = (text or "").encode().split()
            gone = set()
            for p in range(len(w) - 49) if i is not None else ():
                if first[tuple(w[p : p + 50])] < i:
                    gone |= set(range(p, p + 50))
            want[(i, len(w), b" ".join(x for k, x in enumerate(w) if k not in gone))] += 1
        assert Counter((r.doc_id, r.n_words, bytes(r.kept_text)) for r in out) == want


@pytest.mark.parametrize("bucket", [65_536, 1])
def test_suffix_dedup(spark, rows, bucket, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BUCKET", bucket)
    out = suffix_dedup.remove_repeated_bytes(make(spark, rows)).collect()
    seen = Counter(b[p : p + 200] for _, t in rows for b in [(t or "").encode()] for p in range(len(b) - 199))
    want = Counter()
    for i, t in rows:
        b = (t or "").encode()
        gone = {q for p in range(len(b) - 199) if seen[b[p : p + 200]] > 1 for q in range(p, p + 200)}
        want[(i, len(b), bytes(x for q, x in enumerate(b) if q not in gone))] += 1
    assert Counter((r.doc_id, r.n_bytes, bytes(r.kept_bytes)) for r in out) == want


def test_deep_shallow_sorts():
    rng = random.Random(1)
    for _ in range(50):
        s = [bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randint(0, 5))) + b"xyzxyzxyz" + bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9))) for _ in range(30)]
        s += rng.choices(s, k=5)
        assert [s[i] for i in suffix_dedup.deep_shallow(s)] == sorted(s)


def test_near_dedup(spark, rows):
    out = near_dedup.near_duplicates(make(spark, rows))
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out.collect()}
    assert found[3][1:] == (3, True) and found[4][1:] == (3, False) and found[5][1:] == (3, False)
    assert found[0] == (0, 0, True) and found[1] == (0, 1, True) and found[8][0] == 1 and found[13] == (1, 13, True)
    assert found[None][1] is None and out.count() == len(rows)
    for i, t in rows:
        w = (t or "").encode().translate(LOWER).split()
        want = len({tuple(w[p : p + 5]) for p in range(max(1, len(w) - 4))}) if w else 0
        assert i is None or found[i][0] == want
    kept = [r.doc_id for r in near_dedup.keep_one(make(spark, rows)).collect()]
    assert Counter(kept) == Counter([0, 1, 2, 3, 6, 7, 8, 9, 10, 11, 12, 13, 14, None])
    assert near_dedup.near_duplicates(make(spark, [])).count() == 0


def test_near_dedup_joins_large_groups(spark):
    """A group in which few pairs are links and most are just too different."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    group = []
    for i in range(300):
        w = list(base)
        for _ in range(3):
            w[rng.randrange(150)] = f"v{rng.random()}"
        group.append((i, " ".join(w)))
    sets = [{tuple(t.split()[p : p + 5]) for p in range(146)} for _, t in group]
    top = list(range(300))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(300):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                top[b] = a
    out = near_dedup.near_duplicates(make(spark, group)).collect()
    assert sum(r.component_id == find(r.doc_id) for r in out) >= 297


@pytest.mark.parametrize("at_once", [20_000, 6])
def test_decontaminate(spark, rows, at_once, monkeypatch):
    monkeypatch.setattr(decontaminate, "WINDOWS_AT_ONCE", at_once)
    items = [(1, " ".join(rows[6][1].split()[20:45])), (2, "Dog, dog"), (3, None), (None, "cat"), (4, ""), (5, "dog dog"), (1, "again")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.find_windows(make(spark, rows), bench).collect()
    want = Counter()
    for i, t in rows:
        w, hit, of = (t or "").encode().translate(PLAIN).split(), set(), set()
        for item, text in items:
            x = (text or "").encode().translate(PLAIN).split() if item else []
            for p in range(max(1, len(x) - 9) if x else 0):
                part = x[p : p + 10]
                for q in range(len(w) - len(part) + 1):
                    if w[q : q + len(part)] == part:
                        hit |= set(range(q, q + len(part)))
                        of.add(item)
        want[(i, len(w), len(hit), tuple(sorted(of)))] += 1
    assert Counter((r.doc_id, r.n_words, sum(r.ends) - sum(r.starts), tuple(r["items"])) for r in out) == want
    assert {r.carried.node for r in out} == {1}
    assert decontaminate.find_windows(make(spark, rows), bench.filter("false")).filter("size(items) > 0").count() == 0
    assert decontaminate.find_windows(make(spark, []), bench).count() == 0


def test_quality(spark, rows):
    # Line separators that are no white space of ASCII are words, and lines of them count.
    rows = [*rows, (20, "a\n\u0085\n\u0085"), (21, "\u2028\n\u2028\n\u2029 \n \t\n\u2029 "), (22, "b\r\nb\r\n\r\n")]
    out = quality.judge(make(spark, rows)).collect()
    want = Counter()
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        c = Counter(tuple(w[p : p + 5]) for p in range(len(w) - 4))
        rep = {q for p in range(len(w) - 4) if c[tuple(w[p : p + 5])] > 1 for q in range(p, p + 5)}
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\f\r")]
        want[(i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(rep))] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out) == want
    assert all(not r.kept for r in out if r.base_failed) and quality.judge(make(spark, [])).count() == 0
    assert quality.keep(make(spark, rows)).columns == ["doc_id", "text", "n_words", "node"]


def test_licenses(spark, rows):
    found = {r.doc_id: r for r in licenses.detect(make(spark, rows)).collect()}
    assert [(b.label, b.word) for b in found[12].base] == [("cc-by", 5), ("reserved", 0)]
    assert {f.label for f in found[12].found} == {"reserved", "cc-by-nc"} and found[0].n_words == 0
    scanner = licenses.Scanner({}, [("long", 0.9, "a", "a b c"), ("short", 0.9, "b", "b"), ("side", 0.5, "c", "c d")])
    assert [x[0] for x in scanner.scan(b"a b c d")[2]] == ["long", "side"]


@pytest.mark.parametrize("at_once", [1_000_000, 3])
def test_url_filter(spark, at_once, monkeypatch):
    """Against trying every entry, whether one trie holds them or several."""
    monkeypatch.setattr(url_filter, "MOST_ENTRIES", at_once)
    rng = random.Random(4)
    entries = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "a.com", "/x"), ("allow", "a.com", "/x"), ("allow", "com", "/en/very/long"), ("block", "example.com", "/en/"), ("block", "", "/all")]
    entries += [(rng.choice(["allow", "block"]), rng.choice(["com", "a.com", "b.a.com", "x"]), "/" + "".join(rng.choices("xy/", k=rng.randrange(4)))) for _ in range(30)]
    urls = ["http://B.Example.com/en/71?q", "http://c.com/en/", "http://c.com/en", "http://a.com/xy#z", None, "no", "http://example.com/en/very/long", "x://", "ftp://x/all" + "l" * 50_000]
    urls += [f"http://{rng.choice(['com', 'a.com', 'q.b.a.com', 'x', 'ax'])}/" + "".join(rng.choices("xy/", k=rng.randrange(6))) for _ in range(200)]
    urls += urls[-5:]
    schema = "page_id long, url string, host string, rank int, verdict string"
    pages = spark.createDataFrame([(i % 205 or None, u, "h", 1, "v") for i, u in enumerate(urls)], schema)
    out = Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, entries).collect())
    want = Counter()
    for i, u in enumerate(urls):
        host, path = url_filter.split_url(u)
        fits = [e for e in entries if (host == e[1] or host.endswith("." + e[1]) or not e[1]) and path.startswith(e[2])]
        best = max(fits, key=lambda e: (len(e[1] + e[2]), len(e[1].split(".")) if e[1] else 0, e[0] == "block"), default=("allow", None, None))
        want[(i % 205 or None, host, path, best[1] and best[1] + best[2] if best[2] is None or best[1] else best[2], best[0])] += 1
    assert out == want and len(urls) == sum(out.values())
    assert url_filter.judge_urls(pages.filter("false"), entries).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(pages, []).collect()} == {"allow"}


def test_url_rules_are_those_of_the_contract(spark):
    """Each rule's word, as the contract of op7 lists it, and what the query's rules say about urls under each."""
    from sluice.llm.queries import URL_RULES

    assert URL_RULES == [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
    urls = ["http://a.com/en/1", "http://example.com/en/71", "http://a.net/de/8", "http://x.example.net/de/81", "http://example.net/de/7", "http://org/es/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    found = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(pages, URL_RULES, otherwise="block").collect()}
    want = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("net/de/", "allow"), ("org/es/", "block")]
    assert [found[i] for i in range(len(urls))] == want


def test_html(spark):
    chrome = "<header>Site</header><div class='cookie-notice'>Take <div>it</div></div>"
    tail = "<p>Read more of our great site today</p><footer>f</footer><script>a<b</script>"
    pages = [
        (1, "http://h/1", f"<html><head><title>t</title></head><body>{chrome}<article><h1>One &amp; two</h1><p>A  b<b>c</b><br>d</article>{tail}"),
        (2, "http://h/2", f"<body>{chrome}<p>Own words here</p>{tail}"),
        (3, "http://h/3", f"<body>{chrome}<p>Other words there</p>{tail}"),
        (4, None, None),
        (5, "x", ""),
    ]
    for i, name in enumerate(("responses", "discussion", "feedback-list", "reviews", "comment-section", "review", "responsesToCritics")):
        pages.append((10 + i, "http://k/1", f"<article><p>Body {i} text</p><div class='{name}'><p>said a reader {i}</p></div></article>"))
    out = html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string"))
    found = {r.page_id: r.text for r in out.collect()}
    assert found == {1: "One & two\nA bc d", 2: "Own words here", 3: "Other words there", 4: "", 5: ""} | {10 + i: f"Body {i} text" + (f"\nsaid a reader {i}" if i > 4 else "") for i in range(7)}


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(1500):
        w = [rng.choice(words) for _ in range(40)]
        toxic = rng.random() < 0.15
        if toxic:
            w[rng.randrange(40)] = rng.choice(["nasty", "vile"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs, known = make(spark, rows + [(None, None), (9999, "")]), spark.createDataFrame(labels, "doc_id long, toxic int")
    out = toxicity.score(docs, toxicity.fit(docs, known)).join(known, "doc_id").filter(toxicity.held_out(F.col("doc_id"))).toPandas()
    assert ((out.score >= 0.5) == (out.toxic == 1)).mean() > 0.97
    assert toxicity.score(docs, toxicity.fit(docs, known.filter("toxic = 0"))).filter("score > 0").count() == 0


def test_repeated_reach_equals_brute_force(monkeypatch):
    import random

    from sluice.llm import suffix_dedup

    some = random.Random(1)
    for cells in (1 << 20, 37, 5):
        monkeypatch.setattr(suffix_dedup, "CELLS", cells)
        for _ in range(100):
            n, most = some.choice([2, 3, 7, 20]), some.choice([4, 9, 14])
            left, right = ([bytes(some.choices(b"ab", k=some.choice([most, most, some.randrange(most + 1)]))) for _ in range(n)] for _ in "ab")
            held = [{(d, x[:d], y[: most - d]) for d in range(most + 1) if len(x) >= d and len(y) >= most - d} for x, y in zip(left, right)]
            for i, got in enumerate(suffix_dedup.repeated_reach(left, right, most)):
                others = set().union(*(held[j] for j in range(n) if j != i))
                at = [d for d, *_ in held[i] & others]
                assert (tuple(got) if got else None) == ((min(at), max(at)) if at else None)


def test_components_reach_the_smallest_node(spark):
    from sluice.llm.near_dedup import components

    chain = [(i, i + 1) for i in range(40)] + [(100 + i, 200) for i in range(30)] + [(7, 7), (300, 301), (301, 300)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in [*range(100, 130), 200]} | {300: 300, 301: 300}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_dedup_compares_all_pairs_of_a_node_that_stays_large(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 100, raising=False)
    sketch = bytearray(range(4)) * near_dedup.BRANCHING
    rows = near_dedup.meetings(spark.createDataFrame([(i, sketch) for i in range(300)], "rep long, sketch binary"), 1)
    rows = rows.select("node", "rep", "side" if "side" in rows.columns else F.lit(-1).alias("side")).collect()
    met, cells = Counter(), {}
    for r in rows:
        cells.setdefault(r.node, []).append((r.rep, r.side))
    for cell in cells.values():
        met.update((a, b) for a, x in cell for b, y in cell if a < b and (x != y or x == -1))
    assert {(a, b) for a in range(300) for b in range(a + 1, 300)} <= set(met)


def test_near_dedup_leaves_no_link_behind_refused_pairs(spark):
    """Sketches on which 40 unrelated texts look better, to each other and to both ends of a link, than the link does."""
    base = np.arange(near_dedup.COMPARED) % 251
    x, y = base.copy(), base.copy()
    x[:77] += 1
    y[77:154] += 1
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words), " ".join([*words[:190], "other"])] + [" ".join(f"v{k}.{i}" for i in range(50)) for k in range(40)]
    prints = [x, y] + [base] * 40
    sketch = bytearray(4 * near_dedup.BRANCHING)
    reps = [(i, 0, sketch, bytearray(p.astype(np.uint8).tobytes())) for i, p in enumerate(prints)]
    reps = spark.createDataFrame(reps, "rep long, th int, sketch binary, prints binary")
    docs = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc_id long, th int, text string")
    assert {tuple(sorted(r)) for r in near_dedup.links(reps, docs, 5, 75).collect()} == {(0, 1)}


def test_html_drops_a_run_on_two_of_many_pages(spark):
    """Two pages of a large host share a run; many copies of one page do not make its text boilerplate."""
    own = lambda i: " ".join(f"w{i}.{k}" for k in range(8))
    pages = [(i, f"http://h/{i}", f"<p>{own(i)}</p>") for i in range(1700)]
    for i in (3, 700, 1100, 1500):
        pages[i] = (i, f"http://h/{i}", f"<p>{own(i)}</p><p>one two three four five six</p>")
    pages += [(2000 + i, "http://h/copy", f"<p>{own('copy')}</p>") for i in range(50)]
    pages += [(9, "http://h/again", "<p>again with other words than before</p><p>x</p>"), (9, "http://h/again", "<p>again with other words than before</p><p>y</p>")]
    pages.append((4000, "http://other/1", "<p>one two three four five six</p>"))
    out = html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    found = {r.page_id: r.text for r in out if r.page_id != 9}
    want = {i: own(i) for i in range(1700) if i != 9} | {2000 + i: own("copy") for i in range(50)}
    assert len(out) == len(pages) and found == want | {4000: "one two three four five six"}
    again = sorted(r.text for r in out if r.url == "http://h/again")
    assert again == [f"again with other words than before\n{x}" for x in "xy"]


def test_html_by_brute_force(spark):
    """Articles of a host that share a long notice lose it; one that is published on four pages stays; text outside an
    article is judged, not dropped; names of classes count as a whole."""
    notice = " ".join(f"n{k}" for k in range(30))
    own = lambda i, n: " ".join(f"w{i}.{k}" for k in range(n))
    pages = []
    for i in range(12):
        body = f"<article><p>{own(i, 25)}</p><p>{own(i, 3)} {notice} {own(i, 4)}</p><p>Read more</p></article>"
        pages.append((i, f"http://big/{i}", f"<body><h1>Title {i} of its own</h1>{body}<p>Shared teaser outside of all articles</p>"))
    pages += [(100 + i, "http://copies/", f"<main>{own('same', 60)}</main><p>{own(i, 12)}</p>") for i in range(4)]
    pages += [(200, "http://x/", "<article><p class='side-effect'>a</p><p id='social-history'>b</p><div class='nav-bar'>c</div><p>Su<wbr>per</article>")]
    pages += [(201, "http://x/", "<p>" * 3000 + "tail <b>x"), (202, None, "<article>" + own("z", 3)), (None, "http://x/", "<p>a</p><!-- <p>no</p> -->&#233;")]
    schema = "page_id long, url string, html string, host string, text string, stream int"
    out = html_text.extract(spark.createDataFrame([(*p, "x", "y", 1) for p in pages], schema)).collect()
    found = {r.page_id: r.text for r in out}

    def streams(article):  # the definition: runs of 20 tokens that more than half of at least 8 streams hold
        return {tuple(article[k : k + html_text.LONG_RUN]) for k in range(len(article) - html_text.LONG_RUN + 1)}

    articles = [f"{own(i, 25)} {own(i, 3)} {notice} {own(i, 4)} Read more".split() for i in range(12)]
    held = Counter(run for a in articles for run in streams(a))
    for i, a in enumerate(articles):
        gone = {q for k in range(len(a) - 19) if held[tuple(a[k : k + 20])] > 6 for q in range(k, k + 20)}
        rest = [w for q, w in enumerate(a[:-2]) if q not in gone]
        assert found[i].replace("\n", " ") == f"Title {i} of its own {' '.join(rest)}"
    assert all(found[100 + i] == f"{own('same', 60)}\n{own(i, 12)}" for i in range(4))
    assert found[200] == "a\nb\nSuper" and found[201] == "tail x" and found[202] == own("z", 3) and found[None] == "a\né"
    assert html_text.extract(spark.createDataFrame([], schema)).count() == 0
    again = html_text.extract(spark.createDataFrame([(*pages[0], "x", "y", 1)] * 20, schema)).collect()
    assert len(again) == 20 and len({r.text for r in again}) == 1 and "Shared teaser" in again[0].text


def test_substring_index_in_steps_equals_one(spark, rows):
    """Three batches, with a compaction between them that the third one meets, against all rows at once."""
    docs = make(spark, [r for r in rows if r[0] is not None] + [(20, rows[10][1][:5000]), (21, rows[6][1]), (22, rows[7][1])])
    whole = substring_dedup.RepeatIndex(spark)
    want = {(r.doc_id, w) for r in whole.add(docs).collect() for w in range(r.s, r.e)}
    steps, got = substring_dedup.RepeatIndex(spark, max_runs=2), set()
    for part in ("doc_id <= 6", "doc_id between 7 and 13", "doc_id between 14 and 20", "doc_id > 20"):
        got |= {(r.doc_id, w) for r in steps.add(docs.filter(part)).collect() for w in range(r.s, r.e)}
    assert got == want and len(want) > 200 and len(steps.runs) == 2
    whole.close()
    steps.close()


def test_substring_dedup_compares_words(spark, rows, monkeypatch):
    """Hashes that are equal for different words remove nothing that is not repeated."""

    class Few(substring_dedup.WordHashes):
        def __missing__(self, word):
            return len(word) % 2

    monkeypatch.setattr(substring_dedup, "WordHashes", Few)
    text = " ".join(f"w{i}" for i in range(90))
    docs = [(1, text), (2, " ".join(f"v{i}" for i in range(90))), (3, text)]
    out = {r.doc_id: len(r.kept_text.split()) for r in substring_dedup.remove_repeats(make(spark, docs)).collect()}
    assert out[1] == out[2] == 90


def test_key_bits_miss_no_key(spark, rows, monkeypatch):
    """Whatever the number of bits, a row whose key is there meets; with enough of them few others do; no keys, no row."""
    docs = spark.range(4000).selectExpr("id as doc_id", "id * 7 as th", "'x' as text")
    for bits, most in ((1 << 26, 5), (1 << 15, 120), (8, 3000)):
        monkeypatch.setattr(substring_dedup, "BITS", bits)
        out = substring_dedup.with_meets(docs, substring_dedup.key_bits(docs.filter("doc_id >= 3000").select("doc_id", "th"))).collect()
        assert len(out) == 4000 and all(r.meets for r in out if r.doc_id >= 3000)
        assert sum(r.meets for r in out if r.doc_id < 3000) <= most
    assert not substring_dedup.with_meets(docs, substring_dedup.key_bits(docs.filter("doc_id < 0"))).filter("meets").count()
    monkeypatch.setattr(substring_dedup, "BITS", 16)
    test_substring_dedup(spark, rows)


def test_near_dedup_shuffles_texts_of_similar_documents_only(spark, monkeypatch):
    plans, sets = [], near_dedup.shingle_sets
    monkeypatch.setattr(near_dedup, "shingle_sets", lambda docs, size: plans.append(docs._jdf.queryExecution().optimizedPlan().toString()) or sets(docs, size))
    texts = [" ".join(f"w{i * 100 + k}" for k in range(40)) for i in range(6)]
    rows = spark.createDataFrame(list(enumerate([*texts, texts[2] + " more"])), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(rows).collect()} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 2}
    assert plans and all("getbit" in p for p in plans)
