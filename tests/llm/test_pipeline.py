"""Every stage of the corpus pipeline, and run(), against brute force; fitting of quality rules against plain Python."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sluice.llm import licenses, quality, toxicity
from sluice.llm.common import LOWER, PLAIN
from sluice.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, th int, carried string, kept string"
SPACE = r"[^\x20\x09-\x0D]+"


def measured(text):
    text = text or ""
    w = re.findall(SPACE, text)
    c = Counter(tuple(w[p : p + 5]) for p in range(len(w) - 4))
    rep = {q for p in range(len(w) - 4) if c[tuple(w[p : p + 5])] > 1 for q in range(p, p + 5)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\f\r")]
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(rep),
        "n_lines": len(lines), "n_runs": len(re.findall(r"([#*$%&|<>])\1", text)), "n_capitals": sum("A" <= x <= "Z" for x in text), "n_shouts": text.count("!"), "n_stops": text.count(".") + text.count("?"),
    }


def votes(m):
    say = lambda rule: eval(re.sub(r"(\w+) between (.+?) and (.+)", r"\2 <= \1 <= \3", rule).replace(" = ", " == "), {}, m)  # noqa: E731, S307
    return tuple(1 if say(good) else -1 if say(bad) else 0 for good, bad in quality.RULES.values())


def fitted(patterns):
    """Expectation-maximisation, written out."""
    k = len(quality.RULES)
    prior, good, bad = 0.8, [0.95] * k, [0.4] * k
    for _ in range(quality.ROUNDS):
        q = {v: posterior(v, prior, good, bad) for v in patterns}
        total = sum(patterns.values())
        prior = (1 + sum(n * q[v] for v, n in patterns.items())) / (2 + total)
        for j in range(k):
            voted = [(v, n) for v, n in patterns.items() if v[j]]
            good[j] = min(0.995, max(0.7, (19 + sum(n * q[v] for v, n in voted if v[j] == 1)) / (20 + sum(n * q[v] for v, n in voted))))
            bad[j] = min(0.98, max(0.1, (8 + sum(n * (1 - q[v]) for v, n in voted if v[j] == -1)) / (20 + sum(n * (1 - q[v]) for v, n in voted))))
    return prior, good, bad


def posterior(v, prior, good, bad):
    z = math.log(prior / (1 - prior))
    for x, g, b in zip(v, good, bad):
        z += math.log(g / (1 - b)) if x == 1 else math.log((1 - g) / b) if x == -1 else 0
    return 1 / (1 + math.exp(-z))


def good_documents(docs):
    m = [measured(d[1]) for d in docs]
    v = [votes(x) for x in m]
    model = fitted(Counter(v))
    quick = [x["n_words"] < 10 or 100 * x["n_repeat_words"] > 20 * x["n_words"] for x in m]
    return [d for d, x, failed in zip(docs, v, quick) if not failed and posterior(x, *model) >= 0.5]


def distinct_documents(docs):
    sets = []
    for d in docs:
        w = (d[1] or "").encode().translate(LOWER).split()
        sets.append({tuple(w[p : p + 5]) for p in range(max(1, len(w) - 4))} if w else set())
    top = list(range(len(docs)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                top[find(i)] = find(j)
    least = {}
    for i, d in enumerate(docs):
        least[find(i)] = min(least.get(find(i), d[0]), d[0])
    return [d for i, d in enumerate(docs) if d[0] == least[find(i)]]


def without_passages(docs):
    first = {}
    for d in docs:
        w = (d[1] or "").encode().split()
        for p in range(len(w) - 49):
            k = tuple(w[p : p + 50])
            first[k] = min(d[0], first.get(k, d[0]))
    out = []
    for d in docs:
        w = (d[1] or "").encode().split()
        gone = {q for p in range(len(w) - 49) if first[tuple(w[p : p + 50])] < d[0] for q in range(p, p + 50)}
        text = b" ".join(x for q, x in enumerate(w) if q not in gone).decode() if gone else d[1]
        if not gone or text:
            out.append((d[0], text, *d[2:4], len(text) if text is not None else None, *d[5:]))
    return out


def without_benchmark(docs, items):
    windows = set()
    for _, text in items:
        w = (text or "").encode().translate(PLAIN).split()
        windows |= {tuple(w[p : p + 10]) for p in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(x) for x in windows}

    def clean(text):
        w = (text or "").encode().translate(PLAIN).split()
        return not any(tuple(w[p : p + n]) in windows for n in sizes for p in range(len(w) - n + 1))

    return [d for d in docs if clean(d[1])]


def pieces(docs):
    from tokenizers import Tokenizer

    t, out = Tokenizer.from_file(tokenizer_path()), Counter()
    for d in docs:
        ids = t.encode(d[1] or "", add_special_tokens=False).ids + [2]
        for s in range(0, len(ids), 4096):
            part = ids[s : s + 4096]
            out[(d[0], s, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes()), len(ids))] += 1
    return out


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(9)
    words = [a + b for a in ("ta", "ré", "mo", "lin", "qua") for b in ("to", "ne", "sch", "bel", "r")]

    def text(n):
        out = [rng.choice(words) + str(rng.randrange(40)) * (rng.random() < 0.3) + ("." if i % 9 == 8 else "") for i in range(n)]
        return " ".join(out).replace(". ", ".\n", 2)

    bench = [(1, text(40)), (2, "only three words"), (3, None), (4, "")]
    passage, base = text(80), text(150)
    near = base.split()
    near[70] = "other"
    docs = [(0, base), (1, base), (2, " ".join(near)), (3, text(60) + " " + passage), (4, passage + " " + text(50)), (5, passage), (6, text(30) + " " + " ".join(bench[0][1].split()[5:20]) + " " + text(20))]
    docs += [(7, None), (8, ""), (9, "# $ % & " * 60), (10, "SHOUT! " * 50), (11, " ".join(text(5) for _ in range(1)) * 40), (12, text(6000)), (13, "Has only three words here " + text(40))]
    docs += [(20 + i, text(rng.randrange(30, 120))) for i in range(40)]
    rows = [(i, t, "en", "s", len(t) if t is not None else None, 1, "x", "y") for i, t in docs]
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, bench, folder


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", ["quality_rules", "near_duplicates", "repeated_passages", "benchmark_passages"])
def test_stage(spark, corpus, name):
    docs, bench, folder = corpus
    want = {"quality_rules": good_documents, "near_duplicates": distinct_documents, "repeated_passages": without_passages, "benchmark_passages": lambda d: without_benchmark(d, bench)}[name](docs)
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, spark.createDataFrame(docs, SCHEMA), folder)
    assert out.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert rows_of(out) == sorted(want, key=repr) and 0 < len(want) < len(docs) + (name == "repeated_passages")
    empty = stage(spark, spark.createDataFrame([], SCHEMA), folder)
    assert empty.count() == 0 and empty.columns == out.columns


def test_run(spark, corpus):
    docs, bench, folder = corpus
    want = pieces(without_benchmark(without_passages(distinct_documents(good_documents(docs))), bench))
    out = corpus_pipeline.run(spark, folder).toPandas()
    assert Counter(zip(out.doc_id, out.start, out.length, out.ids_crc32, out.doc_tokens)) == want
    assert out.groupby("sequence_id").length.sum().max() <= 4096


def test_quality_fit(spark, corpus):
    """Posterior and verdict of every document, by plain Python; repeated rows, nulls and an empty table."""
    docs = corpus[0] + corpus[0][:3]
    out = quality.judge(spark.createDataFrame(docs, SCHEMA)).collect()
    model = fitted(Counter(votes(measured(d[1])) for d in docs))
    want = Counter((d[0], round(posterior(votes(measured(d[1])), *model), 9)) for d in docs)
    assert Counter((r.doc_id, round(r.quality, 9)) for r in out) == want
    assert sorted(r.doc_id for r in out if r.kept) == sorted(d[0] for d in good_documents(docs))
    for got, expected in zip(quality.estimate(quality.measures(spark.createDataFrame([], SCHEMA))), (0.5, 0.95, 0.4)):
        assert np.allclose(got, expected)


def test_risk_gradient():
    """The step of a batch against numbers: descent of the whole risk, ascent of its part in max() where that is negative."""
    rng = np.random.default_rng(4)

    def risk(z, n, prior):
        soft = lambda x: np.logaddexp(0, x)
        rest = soft(z[n:]).mean() - prior * soft(z[:n]).mean()
        return (prior * soft(-z[:n]).mean() + rest, rest)

    seen = set()
    for _ in range(40):
        z, n, prior = rng.normal(size=12) * 3, 5, rng.uniform(0.1, 0.9)
        whole, rest = risk(z, n, prior)
        seen.add(rest >= 0)
        for i in range(12):
            up, down = z.copy(), z.copy()
            up[i] += 1e-5
            down[i] -= 1e-5
            k = 0 if rest >= 0 else 1
            slope = (risk(up, n, prior)[k] - risk(down, n, prior)[k]) / 2e-5
            assert abs(toxicity.slope(z, n, prior)[i] - (slope if rest >= 0 else -slope)) < 1e-6
    assert seen == {True, False}


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, "a bad word"), (1, "a bad word"), (2, None), (None, "x"), (3, "w " * 60_000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, none)).filter("score = 0").count() == 5
    known = spark.createDataFrame([(i, 1) for i in range(1, 30)], "doc_id long, toxic int")
    out = toxicity.score(docs, toxicity.fit(docs, known)).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
    assert toxicity.score(docs.filter("false"), toxicity.fit(docs.filter("false"), known)).count() == 0


def test_licenses_by_brute_force(spark):
    """Base places of every phrase, whatever other rules say; rules against trying all of them without the prefilter."""
    rng = random.Random(6)
    parts = ["cc by", "CC-BY", "general public license", "All rights reserved", "gnu affero general public license version 3", "mit license", "the", "apache license 2.0", "word", "spdx-license-identifier: mit", "é", "sa 4.0"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randrange(1, 30))) for _ in range(60)] + [None, "", "cc by cc by", "x " * 50_000 + "cc by"]
    rows = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, found string, n_words int")
    ordered = licenses.rules()
    every = licenses.Scanner(licenses.BASE, [(label, score, " ", pattern) for label, score, _, pattern in ordered])
    for r in licenses.detect(rows).collect():
        text = texts[r.doc_id]
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        want = sorted((label, p) for phrase, label in licenses.BASE.items() for p in range(len(w)) if w[p : p + len(phrase.split())] == phrase.split())
        assert r.n_words == len(w) and sorted((b.label, b.word) for b in r.base) == want
        if len(w) < 1000:
            assert [(f.label, f.first_word, f.n_words) for f in r.found] == [(f[0], f[2], f[3]) for f in every.scan((text or "").encode())[2]]
    assert licenses.detect(rows.filter("false")).count() == 0


def test_near_duplicates_recall(spark):
    """Groups of several sizes in which pairs are 0.75 to 0.8 alike: every link joins its ends."""
    from sluice.llm import near_dedup

    rng, docs, groups = random.Random(8), [], {}
    for g, size in enumerate([2] * 40 + [30, 300, 900]):
        base = [f"g{g}w{i}" for i in range(140)]
        for _ in range(size):
            w = list(base)
            for at in rng.sample(range(140), 2):
                w[at] = f"v{rng.random()}"
            groups.setdefault(g, []).append(len(docs))
            docs.append((len(docs), " ".join(w)))
    found = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    links = met = 0
    for members in groups.values():
        sets = {i: {tuple(docs[i][1].split()[p : p + 5]) for p in range(136)} for i in members}
        for k, i in enumerate(members):
            for j in members[:k]:
                both = len(sets[i] & sets[j])
                if 0.75 <= both / (len(sets[i]) + len(sets[j]) - both):
                    links += 1
                    met += found[i] == found[j]
    assert links > 10_000 and met >= 0.999 * links
