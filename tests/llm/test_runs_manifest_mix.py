"""Runs of words, the Merkle manifest and the mix of sources against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import merkle, mixing, periodic
from sluice.llm.queries import op11_periodic_runs_grammar, op12_merkle_multiproof, op13_mix_pareto, repeating_tail

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, copies int"  # the last two clash


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(4)
    words = ["aa", "bé", "Cat", "dog", "To", "x", " ", "é"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = []
    for i in range(230):
        lang = rng.choice(["en", "en", "en", "de", None, "ÿ"])
        source = rng.choice(["s1", "s1", "s1", "s0", "s2", "Z", None])
        body = rng.choice([text(rng.randint(0, 60)), (text(rng.randint(1, 9)) + " ") * rng.randint(2, 12), "a" * i, None, " \t\n"])
        rows.append((i, body, lang, source, None if i % 9 == 0 else len(body or ""), "w", 1))
    rows += [rows[7]] * 3 + [(None, "No Id", "en", "s1", 5, "w", 1)] * 2 + [(5, "again", "en", "s1", 5, "w", 1)]
    rows.append((1000, " ".join(f"w{k}" for k in range(20_000)), "fr", "long", 9, "w", 1))
    rows.append((1010, "one two three " * 7000, "fr", "long", None, "w", 1))
    return rows


@pytest.fixture(scope="module")
def folders(spark, docs, tmp_path_factory):
    out = {}
    for name, rows in (("all", docs), ("none", [])):
        out[name] = str(tmp_path_factory.mktemp(name))
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{out[name]}/documents.parquet")
    return out


def brute_runs(w):
    found = set()
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            s, e = i, j + q
            if j > i and e - s >= max(24, 3 * q) and not any(all(w[k] == w[k + p] for k in range(s, e - p)) for p in range(1, q)):
                found.add((s, e, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_runs_by_grammar():
    rng, some = random.Random(2), 0
    for _ in range(500):
        k, w = rng.choice([1, 2, 3, 30]), []
        for _ in range(rng.randint(1, 5)):
            part = [rng.randrange(k) for _ in range(rng.randint(1, 14))]
            if rng.random() < 0.6:
                part *= rng.randint(1, 14)
            w += part + part[: rng.randint(0, 5)]
            if rng.random() < 0.2:
                w[rng.randrange(len(w))] = 99
        want = brute_runs(w)
        assert periodic.runs_of(np.array(w)) == want
        some += len(want)
    assert some > 300


def test_repair_derives_its_text():
    rng = random.Random(1)
    for _ in range(200):
        ids = [rng.randrange(3) for _ in range(rng.randint(1, 80))]
        rules, rest = periodic.repair(ids)
        base = max(ids) + 1
        derive = lambda x: [x] if x < base else derive(rules[x - base][0]) + derive(rules[x - base][1])
        assert sum(map(derive, rest), []) == ids
        pairs = Counter()
        last = None
        for p in zip(rest, rest[1:]):  # no pair is left that occurs twice without overlapping
            last = None if p == last and p[0] == p[1] else p
            pairs[p] += last is not None
        assert not pairs or max(pairs.values()) == 1


def test_op11(spark, folders, docs):
    want = Counter()
    for i, text, *_ in docs:
        w = repeating_tail(i, (text or "").encode().split())
        runs = brute_runs(w) if len(w) < 3000 else [(0, len(w), 3)] if i == 1010 else periodic.runs_of(np.array([int(x[1:]) for x in w]))
        if i == 1010:
            assert w == b"one two three".split() * (len(w) // 3) + b"one two three".split()[: len(w) % 3]
        gone = {p for s, e, q in runs for p in range(s + q, e)}
        best = max(runs, key=lambda r: ((r[1] - r[0]) / r[2], -r[0], -r[2]), default=None)
        four = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
        lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs)
        want[(i, len(runs), *four, sha(lines), sha(b" ".join(x for p, x in enumerate(w) if p not in gone)))] += 1
    got = op11_periodic_runs_grammar(spark, folders["all"])
    assert Counter(map(tuple, got.collect())) == want
    assert op11_periodic_runs_grammar(spark, folders["none"]).count() == 0
    kept = periodic.collapse_runs(spark.createDataFrame(docs[:5], SCHEMA))
    assert kept.select("carried.n_words").distinct().collect()[0][0] == "w"


def plain_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def plain_path(levels, i):
    out = []
    for level in levels[:-1]:
        s = i // 8 * 8
        out.append(("".join(level[s:i]), "".join(level[i + 1 : s + 8])))
        i //= 8
    return out


def plain_leaf(i, source, lang, n, text):
    return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (i, source, lang, n, text)))


@pytest.mark.parametrize("at_once", [100_000, 20])
def test_op12(spark, folders, docs, at_once, monkeypatch):
    monkeypatch.setattr(merkle, "LEAVES_AT_ONCE", at_once)
    lower = lambda t: None if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    trees = defaultdict(list)
    for i, text, lang, source, n, *_ in docs:
        changed = i is not None and zlib.crc32(str(i).encode()) % 3 == 0
        leaf = plain_leaf(i, source, lang, n, text)
        trees[lang].append((-1 if i is None else i, leaf, plain_leaf(i, source, lang, n, lower(text)) if changed else leaf, i))
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {lang: plain_tree([r[1] for r in sorted(trees[lang])]) for lang in order}
    top = plain_tree([built[lang][-1][0] for lang in order])
    want = Counter()
    for k, lang in enumerate(order):
        for at, (_, leaf, candidate, i) in enumerate(sorted(trees[lang])):
            path = plain_path(built[lang], at) + plain_path(top, k)
            h = candidate
            for before, after in path:
                h = sha(before + h + after)
            want[(i, leaf, built[lang][-1][0], top[-1][0], sha("".join(b + a for b, a in path)), h, h == top[-1][0])] += 1
    assert Counter(map(tuple, op12_merkle_multiproof(spark, folders["all"]).collect())) == want
    assert {r[-1] for r in want} == {True, False}
    if at_once > 20:
        assert op12_merkle_multiproof(spark, folders["none"]).count() == 0


def test_missing_nodes_are_the_fewest():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randint(1, 600)
        levels = plain_tree([sha(str(k)) for k in range(n)])
        own = sorted(rng.sample(range(n), rng.randint(1, min(n, 40))))
        need = merkle.missing(np.array(own), n)
        touched = {(level, p // 8**level) for level in range(len(levels)) for p in own}
        # A node is needed if it is a sibling on some way up, and no leaf of ours lies below it.
        want = {(level, c) for level, p in touched if level < len(levels) - 1 for c in range(p // 8 * 8, min(p // 8 * 8 + 8, len(levels[level]))) if (level, c) not in touched}
        assert set(need) == want and len(need) == len(want)
        derived = merkle.Derived(n, {p: levels[0][p] for p in own}, {(level, c): levels[level][c] for level, c in need})
        assert derived.root == levels[-1][0]
        assert all(derived.path(p) == plain_path(levels, p) for p in own)


def test_proofs_of_some_leaves(spark):
    rows = [("t" if k % 3 else "u", k, sha(str(k)), sha(str(k))) for k in range(400)]
    nodes = merkle.manifest(spark.createDataFrame(rows, "tree string, doc_id long, digest string, candidate string"))
    wanted = nodes.filter("level = 0 and doc_id in (3, 4, 100, 399)")
    found = merkle.prove(nodes, wanted, full=True).collect()
    assert {r.doc_id for r in found} == {3, 4, 100, 399}
    for r in found:
        levels = plain_tree([sha(str(k)) for k in range(400) if (k % 3 > 0) == (r.tree == "t")])
        assert r.root == r.folded == levels[-1][0] and list(zip(r.before, r.after)) == plain_path(levels, r.place)


def plain_mix(docs):
    sizes = [(i, source, len((text or "").encode().split())) for i, text, _, source, *_ in docs]
    total = sum(s for *_, s in sizes)
    held = Counter()
    for _, source, s in sizes:
        held[source] += s
    names = sorted(held, key=lambda x: (x is None, x or ""))
    weight = {x: (5, 2, 1)[k % 3] for k, x in enumerate(names)}
    target, open_ = dict.fromkeys(names, 0.0), set(names)
    while True:
        left = total - sum(target[x] for x in names if x not in open_)
        whole = sum(weight[x] for x in open_)
        for x in open_:
            target[x] = left * weight[x] / whole
        above = {x for x in open_ if target[x] > 3 * held[x]}
        if not above:
            return sizes, held, target
        for x in above:
            target[x] = 3.0 * held[x]
        open_ -= above


def test_op13(spark, folders, docs):
    sizes, held, target = plain_mix(docs)
    got = op13_mix_pareto(spark, folders["all"])
    rows = got.collect()
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((i, s) for i, _, s in sizes)
    assert Counter(rows) == Counter(op13_mix_pareto(spark, folders["all"]).collect())
    by = defaultdict(list)
    for r in rows:
        assert r.taken % max(r.size, 1) == 0 and 0 <= r.taken <= 3 * r.size
        by[r.source_size, round(r.target, 6)].append(r)
    assert set(by) == {(held[x], round(target[x], 6)) for x in held}
    for (_, t), own in by.items():
        least = min((r.size for r in own if r.size and r.taken < 3 * r.size), default=0)
        assert abs(sum(r.taken for r in own) - t) <= max(least, 0.01 * t)
    assert op13_mix_pareto(spark, folders["none"]).count() == 0


def test_mix_of_equal_rows_and_many_sources(spark):
    rows = [(1, "a b c d e", "big", 0)] * 500 + [(k, "x " * (k % 40), f"s{k:03}", 0) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int")
    mixed = mixing.mix(docs).cache()
    for source, t, taken, n in mixed.groupBy("source").agg(F.first("target"), F.sum("taken"), F.count("*")).collect():
        # One document, or copies of 5 words: nothing comes nearer to the target than this.
        assert abs(taken - t) <= (2.5 if source == "big" else int(source[1:]) % 40 / 2) + 1e-6 and n == (500 if source == "big" else 1)
    whole = mixing.mixture(docs, mixed)
    assert whole.columns == docs.columns and whole.count() == mixed.agg(F.sum("copies")).first()[0]


def test_inclusion_is_unequal_and_follows_odds(spark):
    rows = [(k, "w " * (2 if k % 2 else 200), "a" if k < 8000 else "b") for k in range(9000)]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1.0, 1.0))
    seen = mixed.filter("source = 'a'").groupBy("size").agg(F.avg("copies").alias("mean"), F.first("expected").alias("expected")).collect()
    assert {r.size for r in seen} == {2, 200} and len({round(r.expected, 6) for r in seen}) == 2
    assert all(abs(r["mean"] - r.expected) < 0.05 for r in seen)
