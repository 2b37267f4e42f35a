import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from newsloom.llm import language_id, lm_scoring
from newsloom.llm.bytegrid import Grid
from newsloom.llm.rows import distinct_sample

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {k: k + 32 for k in range(65, 91)}
ALPHABETS = {"aa": "abcdeé", "bb": "bdfgöü", "cc": "zxcvaß"}


def texts(seed, n):
    rng = random.Random(seed)
    rows = []
    for d in range(n):
        lang = rng.choice(list(ALPHABETS))
        w = ["".join(rng.choice(ALPHABETS[lang]) for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 60))]
        rows.append((d, rng.choice([" ", "\n"]).join(w).capitalize(), None if d % 19 == 0 else lang))
    return rows


def crc(d, m):
    return zlib.crc32(str(d).encode()) % m


def test_languages_are_learned(spark):
    rows = texts(1, 500) + [(None, None, "aa"), (None, "zxc vxx zzcv", None), (7, "", "aa"), (8, "12 + 3 !", "bb"), (9, "   ", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as label", "'x' as score", "2 as lang_pred")
    got = language_id.identified(df).collect()
    assert len(got) == len(rows)
    right = [r for r in got if r.held_out]
    truth = {d: (lang, t) for d, t, lang in texts(1, 500)}
    long = [r for r in right if truth[r.doc_id][0] and len(truth[r.doc_id][1]) > 20]
    assert np.mean([r.lang_pred == truth[r.doc_id][0] for r in long]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)
    und = [r for r in got if r.lang_pred == "und"]
    assert len(und) == 4 and all(r.score == 0 for r in und)
    assert all(r.held_out == (r.doc_id is not None and crc(r.doc_id, 4) == 2) for r in got)
    nothing = language_id.identified(df.withColumn("lang", df["lang"].substr(1, 0)).where("false"))
    assert nothing.count() == 0
    unlabelled = language_id.identified(df.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}


def test_temperature_calibrates():
    rng = np.random.default_rng(1)
    truth = rng.normal(size=(4000, 3)) * 2
    p = language_id.softmax(truth)
    labels = np.array([rng.choice(3, p=x) for x in p])
    assert abs(language_id.fitted_temperature(truth * 5, labels) - 5) < 0.7


def brute_base(rows):
    tokens = {i: [w.translate(UPPER) for w in WORD.findall(t or "")] + [None] for i, (_, t, _) in enumerate(rows)}
    learn = [i for i, (d, _, _) in enumerate(rows) if d is None or crc(d, 7) != 2]
    c = Counter(w for i in learn for w in tokens[i])
    n, v = sum(c.values()), len(c)
    out = []
    for i, (d, _, _) in enumerate(rows):
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens[i])
        out.append((d, d is not None and crc(d, 7) == 2, len(tokens[i]), sum(c[w] > 0 for w in tokens[i]), n, round(base, 6)))
    return out


def test_base_against_brute_force(spark, monkeypatch):
    rows = texts(2, 300) + [(None, None, None), (7, "", None), (700, "neverseen " * 3, None), (701, "x" * 5000, None)]
    rows.append(rows[11])
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as name", "2 as n", "3 as score")
    for most in (1 << 17, 5):  # nearly all words take the joined path with 5
        monkeypatch.setattr(lm_scoring, "FREQUENT", most)
        got = lm_scoring.scored(df).collect()
        assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=repr) == sorted(brute_base(rows), key=repr)
        assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert lm_scoring.scored(df.limit(0)).count() == 0


def test_code_is_a_prefix_code_and_bits_add_up():
    code = lm_scoring.Code.of(np.bincount(np.frombuffer(b"aaaabbc  \n", np.uint8), minlength=256))
    assert abs(sum(2.0 ** -float(x) for x in code.length) - 1) < 1e-12
    model = lm_scoring.Model.of(code, np.zeros(lm_scoring.SLOTS, np.float32), np.zeros(lm_scoring.SLOTS, np.float32))
    raw = [b"Ab c ab", b"", b"ab"]
    grid = Grid(raw).words()
    t = lm_scoring.tokens(grid, grid.hashes(grid.ws, grid.we, 0, fold=True))
    want = [code.length[np.frombuffer(x, np.uint8)].sum() for x in (b"ab c ab \n", b"\n", b"ab \n")]
    assert np.allclose(model.bits(t), want, atol=1e-3) and t.read.tolist() == [9, 1, 4]


def test_model_learns(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta"]
    rows = [(d, " ".join(rng.choice(words) for _ in range(80))) for d in range(200)] + [(1000, "".join(rng.choice("qzxjkw") for _ in range(400)))]
    got = {r.doc_id: r for r in lm_scoring.scored(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    usual = np.mean([r.bits_per_byte for d, r in got.items() if d < 1000 and r.held_out])
    assert usual < 1.0 < got[1000].bits_per_byte


def test_every_context_is_predicted_from():
    grid = Grid([b"ab cd", b"unseen pair xabcdeq yabcdeq"]).words()
    t = lm_scoring.tokens(grid, grid.hashes(grid.ws, grid.we, 0, fold=True))
    assert lm_scoring.CONTEXTS == t.first.context.shape[1] == t.rest.context.shape[1] == 4
    # A first byte after words that were never seen still has the guess without any context.
    assert len(np.unique(t.first.context[:, 0])) == 1 and len(np.unique(t.first.context[:, 3])) > 4
    # The last bytes of the two long words: orders 2, 3 and 5 agree, the words so far don't.
    last = [np.flatnonzero((t.rest.owner == w) & (t.rest.data == 32))[0] for w in t.word[-2:]]
    assert [len(set(t.rest.context[last, k].tolist())) for k in range(4)] == [1, 1, 1, 2]


def _passages(words, last):
    """(lead, passage) after each cut of a text, by the operator's own word names."""
    cuts = [i for i in range(1, len(words)) if last[i]]
    ends = [*(c + 1 for c in cuts[1:]), len(words) + 1][: len(cuts)]
    return [(tuple(words[max(0, c - lm_scoring.LEAD + 1) : c + 1]), tuple([*words, "\n"][c + 1 : e])) for c, e in zip(cuts, ends, strict=True)]


def test_passages_against_brute_force(spark, monkeypatch):
    """Answers equal those of a dictionary over all texts, with a text's own passages left out."""
    rng = np.random.default_rng(5)
    base = [" ".join(rng.choice([f"w{i}" for i in range(5)], int(n))) for n in rng.integers(0, 90, 60)]
    texts = base + base[:20] + [None, "", "w1 w2", base[3] + " w1 W2 w3"]
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("held_out", lm_scoring.held_out())
    df = df.withColumn("row_key", F.xxhash64("doc_id")).withColumn("name", F.col("doc_id"))
    held = {r.doc_id: r.held_out for r in df.collect()}
    grid, h = lm_scoring._named([(t or "").encode() for t in texts])
    p = lm_scoring.passages(grid, h)
    pair = np.zeros(len(h), np.uint64)
    pair[1:] = lm_scoring.mix(h[1:] + np.uint64(3) * h[:-1], 81)
    after = pair % np.uint64(lm_scoring.SPACING) == 0
    by_doc = {}
    for d, t in enumerate(texts):
        words = (t or "").lower().split()
        by_doc[d] = _passages(words, after[grid.wlo[d] : grid.whi[d]])
        assert len(by_doc[d]) == (p.doc == d).sum()
        covers = p.of[np.concatenate([np.arange(grid.wlo[d], grid.whi[d]), [len(h) + d]])]
        assert sorted(len(x[1]) for x in by_doc[d] if x[1]) == sorted(np.bincount(covers[covers >= 0])[np.unique(covers[covers >= 0])].tolist())
    counts = Counter(x for d, got in by_doc.items() if not held[d] for x in got)
    want = {}
    for d, got in by_doc.items():
        own = Counter(got) if not held[d] else Counter()
        for place, (two, one) in enumerate(got):
            if len({x for x in own if x[0] == two}) > 1:
                continue
            left = {x[1]: n - own[x] for x, n in counts.items() if x[0] == two and n > own[x]}
            if left:
                most = max(left.values())
                bucket = np.searchsorted(lm_scoring.LIKELIEST, most, "right") * 7 + np.searchsorted(lm_scoring.OTHERS, sum(left.values()) - most, "right")
                likely = {x for x, n in left.items() if n == most}
                want[d, place] = (bucket, one in likely, len(likely) == 1)
    cuts = df.mapInArrow(lm_scoring._cut_rows(3), lm_scoring.CUT_ROWS).repartition(3, "part").sortWithinPartitions("part", "kind")
    for most in (lm_scoring.CUTS, 3):
        monkeypatch.setattr(lm_scoring, "CUTS", most)
        got = cuts.mapInArrow(lm_scoring._answers, "name long, place long, class int, learned boolean").collect()
        assert {(r.name, r.place) for r in got} == set(want) and len(want) > 100
        for r in got:
            bucket, may, must = want[r.name, r.place]
            assert r["class"] // 2 == bucket and (r["class"] % 2 <= may) and (not must or r["class"] % 2 == may)
            assert r.learned == (not held[r.name])


def test_copies_are_scored_apart(spark):
    """A text whose like is among those learned from costs far less than one of its own; repeated rows score alike."""
    rng = np.random.default_rng(6)
    words = [f"{a}{b}" for a in ("st", "or", "an", "th", "el") for b in ("e", "ing", "ow", "ard", "um")]
    texts = [" ".join(rng.choice(words, 120)) for _ in range(80)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, texts[i]) for i in range(20)]
    rows += rows[:2]
    got = {}
    for r in lm_scoring.scored(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sorted(len(x) for x in got.values()) == [1] * 98 + [2] * 2 and all(len(set(x)) == 1 for x in got.values())
    twice = [got[i][0].bits_per_byte for i in range(20) if not got[100 + i][0].held_out]
    once = [got[i][0].bits_per_byte for i in range(20, 80)]
    assert len(twice) > 10 and max(twice) < min(once)


def test_samples_of_repeated_texts_are_bounded(spark):
    """A text repeated 100,000 times counts once, and the sample is dealt to all shards."""
    copies = spark.range(100_000).selectExpr("id as doc_id", "'the same text again' as text", "'aa' as lang")
    others = spark.range(6000).selectExpr("id + 200000 as doc_id", "concat('text number ', id) as text", "if(id % 3 = 0, 'aa', 'bb') as lang")
    rows = copies.unionByName(others)
    got = {r["by"]: (r.n, r.texts, r.shards) for r in distinct_sample(rows, 1000, "lang").groupBy("by").agg(F.count("*").alias("n"), F.count_distinct("text").alias("texts"), F.count_distinct(F.col("turn") % 4).alias("shards")).collect()}
    assert set(got) == {"aa", "bb"} and all(900 <= n <= 1000 and texts == n and shards == 4 for n, texts, shards in got.values())
    one = distinct_sample(rows, 2000).agg(F.count("*"), F.count_distinct("text"), F.max("turn"), F.max("of")).first()
    assert 1800 <= one[0] <= 2000 and len(set(one)) == 1
    assert distinct_sample(rows.limit(0), 10, "lang").count() == 0 and distinct_sample(copies, 10).count() == 1
    assert distinct_sample(copies.selectExpr("cast(null as string) as text", "cast(null as string) as lang"), 10, "lang").count() == 1


def test_base_scores_need_no_byte_model(spark, monkeypatch):
    words = ["sun", "Rain", "wind", "über", "x1"]
    rows = [(i, " ".join(words[(i * k) % 5] + ("" if k % 3 else str(i * k)) for k in range(i % 12))) for i in range(60)] + [(7, "a"), (7, "a"), (80, None), (None, "sun")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(lm_scoring, "FREQUENT", 3)  # other words meet their counts in a join
    told = lambda df: sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in df.collect())
    want = told(lm_scoring.scored(docs))

    def fitted(*args):
        raise AssertionError("the base needs counts alone")

    monkeypatch.setattr(lm_scoring, "_train_mixer", fitted)
    monkeypatch.setattr(lm_scoring, "_first_counts", fitted)
    assert told(lm_scoring.base_scored(docs)) == want
    assert lm_scoring.base_scored(docs.limit(0)).count() == 0
