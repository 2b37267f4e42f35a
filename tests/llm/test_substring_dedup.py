import hashlib
import random
import re

import numpy as np
import pytest

from newsloom.llm import substring_dedup as op
from newsloom.llm.bytegrid import Grid

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, width):
    """(doc_id, n_words, n_removed, sha) of each row, by comparing whole windows."""
    least = {}
    big = 1 << 63
    for d, t in rows:
        w = WORD.findall(t or "")
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            least[k] = min(least.get(k, big + 1), big if d is None else d)
    out = []
    for d, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for i in range(len(w) - width + 1):
            if least[tuple(w[i : i + width])] < (big if d is None else d):
                gone |= set(range(i, i + width))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def corpus(seed, n, vocabulary):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "bé", "cc", "ÅÅ", "x1", "y"][:vocabulary]) if vocabulary < 7 else f"w{rng.randrange(vocabulary)}"
    passages = [[word() for _ in range(rng.randrange(8, 40))] for _ in range(6)]
    rows = []
    for d in range(n):
        w = []
        for _ in range(rng.randrange(6)):
            w += rng.choice(passages) if rng.random() < 0.5 else [word() for _ in range(rng.randrange(30))]
        rows.append((d, rng.choice([" ", "\n", "  ", "\t"]).join(w)))
    return rows


@pytest.mark.parametrize("vocabulary", [1, 2, 5, 5000])
def test_equal_windows_pick_equal_symbols(vocabulary):
    for seed in range(5):
        texts = [t.encode() for _, t in corpus(seed, 40, vocabulary)]
        for width in (9, 20):
            grid = Grid(texts).words()
            h = grid.hashes(grid.ws, grid.we)
            starts, key = op.anchors(h, grid.wlo, grid.whi, width)
            of = {}
            for s, k in zip(starts.tolist(), key.tolist(), strict=True):
                assert of.setdefault(tuple(h[s : s + width].tolist()), k) == k
            assert len(starts) == int(np.maximum(grid.whi - grid.wlo - width + 1, 0).sum())


@pytest.mark.parametrize("vocabulary", [1, 3, 4000])
def test_against_brute_force(spark, vocabulary):
    rows = corpus(7, 60, vocabulary) + [(None, None), (None, "a b c"), (3, ""), (5, corpus(7, 60, vocabulary)[5][1]), (61, "word " * 3000)]
    rows += [(None, rows[9][1]), (None, rows[9][1]), (2, rows[30][1])]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as key", "2 as doc", "3 as row_key", "4 as lang")
    got = [tuple(r) for r in op.substring_digest(df, width=12).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows, 12), key=repr)


def test_empty_table(spark):
    assert op.substring_digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_texts_come_back(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    df = spark.createDataFrame([(1, f"one {passage} two"), (2, f"three {passage} four"), (3, "five  six")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in op.dedup_substrings(df).collect()}
    assert got == {1: f"one {passage} two", 2: "three four", 3: "five  six"}
