"""Nearest neighbours, resampling and ranked search against brute force, with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from newsloom.llm import hnsw, nearest, ranked_search, resampling
from newsloom.llm.bytegrid import crc32_spans

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, k1 int, row int, item int, score string"
WORDS = "the of and cat Dog élan naïve x1 22 привет 漢字 tree river stone".split()


def texts(n: int, seed: int) -> list[str | None]:
    """Words between all kinds of separators, with odd texts first."""
    r = random.Random(seed)
    odd = [None, "", "\n\n", "  ,.;", "ONE", "a\n\nb", "é" * 3000 + " " + "w" * 500, "cat dog " * 4000, "x\r\ny\x0bz\x00q", "same line of words here\n" * 30]
    return odd + ["".join(r.choice(WORDS) + r.choice([" ", " ", " ", "\n", ", ", "\n\n", "-"]) for _ in range(r.randint(1, 80))) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3, "s") for i, t in rows], DOCS)


def test_crc32_spans():
    r = random.Random(1)
    parts = [bytes(r.randrange(256) for _ in range(r.choice([0, 1, 5, 63, 64, 65, 300]))) for _ in range(60)]
    buf = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    starts = ends - [len(p) for p in parts]
    assert crc32_spans(buf, starts, ends).tolist() == [zlib.crc32(p) for p in parts]
    before = np.array([zlib.crc32(b"ab%d" % i) for i in range(60)], np.uint32)
    assert crc32_spans(buf, starts, ends, before).tolist() == [zlib.crc32(p, b) for p, b in zip(parts, before.tolist(), strict=True)]


# ---- resampling ----


def features(text: str | None) -> list[str]:
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


def resampled(docs, target, percent=25, least=20, buckets=10_000):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in xs for f in features(x)) for xs in ([x for _, x in docs], target))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log(((t[b] + 1.0) * (n_s + float(buckets))) / ((s[b] + 1.0) * (n_t + float(buckets))))) for b in range(buckets)]
    out = []
    for i, text in docs:
        f = features(text)
        weight = sum(gain[bucket(x)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), (len(f) + 1) // 2 >= least])
    able = sorted((x for x in out if x[4]), key=lambda x: (-x[3], x[0] is None, x[0]))
    rank = {id(x): k + 1 for k, x in enumerate(able[: percent * len(able) // 100])}
    return [(*x[:4], rank.get(id(x))) for x in out]


def test_resampling_against_brute_force(spark):
    docs = list(enumerate(texts(300, 2))) + [(None, "null id " * 30)]
    target = [None, "", "cat river\nstone tree 漢字", "Dog élan\n\nnaïve the"]
    items = spark.createDataFrame([(i, t, "x") for i, t in enumerate(target)], "item_id long, text string, doc_id string")
    got = resampling.resampled(frame(spark, docs), items).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, resampled(docs, target)))


def test_resampling_of_repeated_rows_and_empty_tables(spark):
    docs = [(i % 7, f"the cat and the dog went {i % 7} times round the river\n" * 5) for i in range(70)]
    items = spark.createDataFrame([(1, "the river")], "item_id long, text string")
    key = lambda x: (x[0], x[4] is None, x[4])  # noqa: E731  equal rows share ranks in any order
    got = sorted((tuple(x) for x in resampling.resampled(frame(spark, docs), items).collect()), key=key)
    want = sorted(resampled(docs, ["the river"]), key=key)
    assert [x[:4] for x in got] == [x[:4] for x in want] and sorted(x[4] for x in got if x[4]) == list(range(1, 18))
    assert resampling.resampled(frame(spark, docs).limit(0), items).count() == 0
    assert resampling.resampled(frame(spark, docs), items.limit(0)).count() == 70


# ---- ranked search ----


def searched(docs, items, most=10):
    terms = lambda t: [x.translate(LOWER) for x in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    held = [(i, Counter(w), len(w)) for i, w in ((i, terms(t)) for i, t in docs) if w]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked: dict = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, words in asked.items():
        scored = []
        for i, c, n in held:
            m = 100 - 90 + (90 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in words if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, k + 1, x[3], -x[0]) for k, x in enumerate(sorted(scored)[:most])]
    return sorted(map(repr, out))


@pytest.mark.parametrize("block_terms", [1 << 18, 5])
def test_ranked_search_against_brute_force(spark, block_terms, monkeypatch):
    docs = list(enumerate(texts(200, 3))) + [(None, "null cat"), (5, "ONE"), (5, "ONE")]
    items = [(i, t) for i, t in enumerate(texts(25, 4))] + [(12, "also the stone"), (None, "river tree"), (99, "nowhere to be found zzz")]
    monkeypatch.setattr(ranked_search, "HELD", 300)
    asked = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = ranked_search.ranked(frame(spark, docs).repartition(5), asked, block_terms=block_terms).collect()
    assert sorted(map(repr, map(tuple, got))) == searched(docs, items)


def test_ranked_search_of_copies_and_empty_tables(spark):
    docs = [(i, "the common words of all") for i in range(500)] + [(1000, "the rare word")]
    items = spark.createDataFrame([(1, "rare common")], "item_id long, text string")
    got = [tuple(x) for x in ranked_search.ranked(frame(spark, docs), items).orderBy("rank").collect()]
    assert [x[2] for x in got] == [1000, *range(9)] and sorted(map(repr, got)) == searched(docs, [(1, "rare common")])
    assert ranked_search.ranked(frame(spark, docs).limit(0), items).count() == 0
    assert ranked_search.ranked(frame(spark, docs), items.limit(0)).count() == 0


# ---- nearest neighbours ----


def closest(rows, every=100, most=10):
    """{query: [(vec_id, distance)...]} over rows (vec_id, vector) whose vectors take part."""
    rows = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in rows:
        if q is not None and q % every == 0:
            near = sorted({(float(np.sqrt(np.add.accumulate((x - v) ** 2)[-1])), math.inf if i is None else i) for i, x in rows if i != q and len(x) == len(v)})
            out[q] = [(None if i == math.inf else i, d) for d, i in near[:most]]
    return {q: r for q, r in out.items() if r}


def answers(df):
    out: dict = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_nearest_on_few_rows_is_exact(spark):
    r = np.random.default_rng(5)
    rows = [(i, r.normal(size=8).round(1).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[i % 5][1]) for i in range(300)]  # copies
    rows += [(2000 + i, [1.0, 0.0, -0.0]) for i in range(5)] + [(2100, [1.0, -0.0, 0.0])]  # another length
    rows += [(3000, None), (3100, []), (3200, [0.0] * 8), (3300, [None] + [1.0] * 7), (3400, [math.nan] * 8), (3500, [math.inf] * 8), (None, [0.5] * 8)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, k1 int, shard int")
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    want = closest(rows)
    assert answers(nearest.nearest(df, shard_rows=100)) == want
    assert answers(nearest.nearest(df.unionByName(df), shard_rows=10_000, group=2)) == want
    assert nearest.nearest(df.limit(0)).count() == 0


def test_nearest_of_huge_and_tiny_components(spark):
    r = np.random.default_rng(6)
    for scale in (1e100, 1e-100):
        rows = [(i, (r.normal(size=5) * scale).tolist()) for i in range(200)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        assert answers(nearest.nearest(df)) == closest(rows)


def test_nearest_recall(spark):
    r = np.random.default_rng(7)
    x = r.normal(size=(5000, 32)) + 2 * r.normal(size=(5, 32))[r.integers(0, 5, 5000)]
    x[1000:2500] = x[1000] + r.normal(size=(1500, 32)) * 1e-3  # a group of near copies
    rows = list(enumerate(x.tolist()))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, want = answers(nearest.nearest(df, shard_rows=1500)), closest(rows)
    assert set(got) == set(want)
    share = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) / sum(map(len, want.values()))
    assert share >= 0.95
    assert all(dict(want[q]).get(i, d) == d for q in got for i, d in got[q])


def test_graph_reaches_every_node():
    r = np.random.default_rng(8)
    x = np.concatenate([r.normal(size=(700, 4)), r.normal(size=(700, 4)) + 50]).astype(np.float32)
    level = np.sort(hnsw.levels_of(1 - r.random(len(x)), 8))[::-1]
    g = hnsw.build(x[r.permutation(len(x))], level, 8, 32)
    nodes, far = hnsw.search(g, g.points, 16)
    assert (nodes[:, 0] == np.arange(len(x))).mean() > 0.99 and (np.diff(far, axis=1) >= 0).all()
