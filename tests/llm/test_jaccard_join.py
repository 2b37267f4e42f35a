import random
import re

from newsloom.llm import jaccard_join as op
from newsloom.operators.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {k: k + 32 for k in range(65, 91)}


def shingles(text, size):
    w = [x.translate(UPPER) for x in WORD.findall(text or "")]
    if len(w) < size:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def brute(rows, size, percent):
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    big = 1 << 63
    key = lambda d: big if d is None else d
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), big), key(d))
    return [(d, len(sets[i]), None if least[find(i)] == big else least[find(i)]) for i, (d, _) in enumerate(rows)]


def corpus(seed, n, groups):
    rng = random.Random(seed)
    word = lambda: f"W{rng.randrange(3000)}"
    common = [word() for _ in range(25)]
    rows = []
    for _ in range(groups):
        base = [word() for _ in range(rng.choice([3, 12, 40, 120, 300]))]
        for _ in range(n // groups):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 30)):
                at = rng.randrange(len(w))
                w[at : at + rng.randrange(2)] = [word() for _ in range(rng.randrange(3))]
            if rng.random() < 0.3:
                w += common
            rows.append(" ".join(w) if rng.random() < 0.9 else "\n".join(w).lower())
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_against_brute_force(spark):
    rows = corpus(3, 160, 12) + corpus(4, 60, 1)
    rows = [(i * 3 % 1009, t) for i, (_, t) in enumerate(rows)]
    rows += [(None, None), (None, "one two"), (7000, "ONE  two"), (7001, ""), (7002, " \n"), rows[5], (None, rows[6][1]), (None, "lonely little text of words"), (7003, "x " * 4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as node", "'k' as key", "2 as n")
    got = [tuple(r) for r in op.component_ids(df).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows, 5, 75), key=repr)


def test_tiles_of_a_hot_group(spark):
    """Copies that link with the original, not with each other, and tiles that must be cut."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(200)]
    rows = [(0, " ".join(base))]
    for d in range(1, 60):
        w = list(base)
        for at in rng.sample(range(5, 195), 5):
            w[at] = f"e{d}_{at}"
        rows.append((d, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in op.component_ids(df, small=4, tile=8).collect()]
    assert sorted(got) == sorted(brute(rows, 5, 75))
    kept = op.representatives(df.selectExpr("*", "1 as `whole`", "doc_id as doc")).collect()
    assert {r.doc_id for r in kept} == {c for _, _, c in got}


def test_all_shingles_large(spark):
    rows = corpus(8, 150, 6)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in op.component_ids(df, small=1, tile=5).collect()]
    assert sorted(got) == sorted(brute(rows, 5, 75))


def test_a_tile_returns_fewer_links_than_nodes(spark, monkeypatch):
    """Forests whose pairs don't link: texts near each other but for the threshold, and pairs among them that reach it."""
    rng = random.Random(11)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for d in range(90):
        w = list(base)
        for at in rng.sample(range(0, 60, 6), 1 + d % 3):
            w[at] = f"e{d // 2}_{at}"
        rows.append((d, " ".join(w)))
    made = []
    tiles = op.tiles

    def counted(*args):
        out = tiles(*args).localCheckpoint()
        made.append((len(args) > 4 and args[4] is not None, out.count()))
        return out

    monkeypatch.setattr(op, "tiles", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in op.component_ids(df, small=2, tile=16).collect()]
    assert sorted(got) == sorted(brute(rows, 5, 75))
    exact = [n for sets, n in made if sets]
    assert exact and max(exact) < 90 * 6


def test_repeated_rows_leave_one(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (3, ""), (3, ""), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in op.representatives(df).collect()) == [1, 3, 3, 4]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert op.component_ids(empty).count() == 0
    assert op.representatives(empty).count() == 0


def test_components_of_long_paths(spark):
    rng = random.Random(1)
    names = rng.sample(range(-(10**9), 10**9), 400)
    edges = [(names[i], names[i + 1]) for i in range(249)] + [(names[300], names[i]) for i in range(301, 400)] + [(5, 5)]
    rng.shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = dict.fromkeys(names[:250], min(names[:250])) | dict.fromkeys(names[300:], min(names[300:]))
    assert got == want
