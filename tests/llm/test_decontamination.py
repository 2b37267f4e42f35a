import random
import re
from collections import Counter

from newsloom.llm import decontamination as op

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {k: k + 32 for k in range(65, 91)}


def words(text):
    return [x.translate(UPPER) for x in WORD.findall(text or "")]


def bag(w, size=5):
    return Counter([tuple(w)] if len(w) < size else [tuple(w[i : i + size]) for i in range(len(w) - size + 1)])


def brute(docs, items):
    out = []
    for d, t in docs:
        w = words(t)
        for i, x in items:
            v = words(x)
            best = max((op.similarity(bag(w[s : s + len(v)]), bag(v)) for s in range(len(w) - len(v) + 1)), default=0) if v else 0
            if 100 * best >= 75 - 1e-9:
                out.append((d, i, round(best, 9)))
    return out


def tables(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 5, 9, 20, 45])))) for i in range(25)]
    items += [(90, None), (91, " "), (92, "q q q q q q q q q q")]
    docs = []
    for d in range(120):
        w = [word() for _ in range(rng.randrange(80))]
        for _ in range(rng.randrange(3)):
            x = words(items[rng.randrange(25)][1])
            for _ in range(rng.randrange(3)):
                at = rng.randrange(len(x) or 1)
                x[at : at + rng.randrange(2)] = [word() for _ in range(rng.randrange(2))]
            at = rng.randrange(len(w) + 1)
            w[at:at] = x if rng.random() < 0.7 else [y.upper() for y in x]
        docs.append((d, "  ".join(w)))
    return docs + [(None, items[9][1]), (None, None), (500, ""), (501, "q " * 3000), docs[3]], items


def test_against_brute_force(spark):
    for seed in (1, 2):
        docs, items = tables(seed)
        d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "'x' as at")
        b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "2 as doc_id")
        got = [(r.doc_id, r.item_id, round(r.similarity, 9)) for r in op.contaminated(d, b, block_items=7).collect()]
        want = brute(docs, items)
        assert sorted(got, key=repr) == sorted(want, key=repr)
        dirty = {x[0] for x in want}
        clean = [(r.doc_id, r.text) for r in op.clean_documents(d, b).collect()]
        assert sorted(clean, key=repr) == sorted([(i, t) for i, t in docs if i not in dirty or (i is None and t is None)], key=repr)


def test_index_finds_all_within_radius():
    rng = random.Random(3)
    items = op.Items([(i, " ".join(f"a{rng.randrange(60)}" for _ in range(12))) for i in range(80)], 5, 24)
    for _ in range(300):
        p = int(items.prints[rng.randrange(80)])
        for _ in range(rng.randrange(30)):
            p ^= 1 << rng.randrange(64)
        assert items.near(12, p) == {i for i, x in enumerate(items.prints.tolist()) if (x ^ p).bit_count() <= 24}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert op.contaminated(docs.limit(0), items).count() == 0
    assert op.contaminated(docs, items.limit(0)).count() == 0
    assert op.clean_documents(docs, items.limit(0)).count() == 1
    assert op.contaminated(docs, items).count() == 1


def brute_clipped(docs, items):
    """Documents of fewer words than an item are one window."""
    out = []
    for d, t in docs:
        w = words(t)
        for i, x in items:
            v = words(x)
            best = max((op.similarity(bag(w[s : s + len(v)]), bag(v)) for s in range(max(len(w) - len(v), 0) + 1)), default=0) if v and w else 0
            if 100 * best >= 75 - 1e-9:
                out.append((d, i, round(best, 9)))
    return out


def test_documents_shorter_than_an_item(spark):
    rng = random.Random(5)
    items = [(i, " ".join(f"w{rng.randrange(400)}" for _ in range(rng.choice([2, 4, 5, 6, 9, 40, 400])))) for i in range(30)]
    docs = []
    for d in range(200):
        x = words(items[d % 30][1])
        for _ in range(rng.randrange(4)):
            del x[: rng.randrange(2)]
        x = x[rng.randrange(3) : len(x) - rng.randrange(len(x) // 4 + 2)]
        docs.append((d, " ".join(x)))
    docs += [(900, items[0][1].rsplit(" ", 1)[0]), (901, ""), (902, None)]
    docs += [(1000 + i, " ".join(words(x)[:-1])) for i, x in items] + [(2000 + i, " ".join(words(x)[:9] + words(x)[10:])) for i, x in items]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = op.contaminated(d, b, block_items=7).collect()
    want = brute_clipped(docs, items)
    long = {i for i, x in items if len(words(x)) == 400}
    assert long and all((2000 + i, i) in {(a, c) for a, c, _ in want} for i in long)
    assert sorted(((r.doc_id, r.item_id, round(r.similarity, 9)) for r in found), key=repr) == sorted(want, key=repr)
    size = {i: len(words(t)) for i, t in docs}
    assert all(0 <= r.word_start < r.word_end <= size[r.doc_id] for r in found)
    assert {r.doc_id for r in op.clean_documents(d, b).collect()} == {i for i, _ in docs} - {x[0] for x in want}


def test_near_copies_lie_within_the_radius():
    """Of random near copies at a similarity of 0.75 to 0.85, at least 999 in 1000 have fingerprints within the radius."""
    import random
    from collections import Counter

    from newsloom.llm import decontamination as dc
    from newsloom.llm.bytegrid import Grid

    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]

    def bag(w):
        grid = Grid([" ".join(w).encode()]).words()
        return dc._bag(grid.hashes(grid.ws, grid.we, 0, fold=True), 5)

    tried = lost = 0
    for _ in range(4000):
        n = rng.randrange(20, 150)
        w = [rng.choice(words) for _ in range(n)]
        v = list(w)
        for _ in range(rng.randrange(1, max(2, n // 20) + 1)):
            v[rng.randrange(n)] = rng.choice(words)
        a, b = bag(w), bag(v)
        if 0.75 <= dc.similarity(Counter(a.tolist()), Counter(b.tolist())) <= 0.85:
            p, q = (int(dc.fingerprint(dc.signs(x).sum(axis=0, keepdims=True))[0]) for x in (a, b))
            tried += 1
            lost += (p ^ q).bit_count() > dc.RADIUS
    assert tried > 1000 and lost <= tried / 1000
