import hashlib
import math
import random
import re
from collections import Counter

from newsloom.llm import line_dedup, quality_rules

SPACES = " \t\n\v\f\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {k: k + 32 for k in range(65, 91)}
BIG = 1 << 63


def brute_lines(rows):
    holders = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            key = line.strip(SPACES).translate(UPPER)
            if len(key) >= 10:
                holders.setdefault(key, set()).add(BIG if d is None else d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = []
        for line in lines:
            h = holders.get(line.strip(SPACES).translate(UPPER), set())
            if len(h) < 2 or min(h) == (BIG if d is None else d):
                kept.append(line)
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def documents(seed):
    rng = random.Random(seed)
    pool = ["a common line here", "  Éa common LINE with accents ", "short", "", "exactly10!", "ninechars", "tab\tinside the line\r", "Z" * 400, "ÄÖÜäöü straße"]
    rows = []
    for d in range(120):
        lines = [rng.choice(pool) if rng.random() < 0.4 else f"own line {rng.randrange(60)} of text" for _ in range(rng.randrange(1, 30))]
        rows.append((d * 7 % 121, "\n".join(x.upper() if rng.random() < 0.2 else x for x in lines)))
    return rows + [(None, None), (None, "a common line here\nand more of this"), (None, "and more of this\n"), (5000, ""), rows[3], (rows[4][0], "a common line here\nother words in here"), (5001, "a common line here\n" * 3000)]


def test_lines_against_brute_force(spark):
    for seed in (1, 2):
        rows = documents(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).selectExpr("*", "1 as pos", "2 as doc", "3 as k1", "4 as bitmap")
        got = [tuple(r) for r in line_dedup.line_digest(df).collect()]
        assert sorted(got, key=repr) == sorted(brute_lines(rows), key=repr)
        cut = line_dedup.dedup_lines(df)
        assert cut.columns == df.columns
        texts = [(r.doc_id, None if r.text is None else hashlib.sha256(r.text.encode()).hexdigest()) for r in cut.collect()]
        want = [(d, None if rows[i][1] is None else sha) for i, (d, _, _, sha) in enumerate(brute_lines(rows))]
        assert sorted(texts, key=repr) == sorted(want, key=repr)


def test_no_lines(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.line_digest(empty).count() == 0


def brute_counts(t):
    t = t or ""
    w = WORD.findall(t)
    k = Counter(zip(w, w[1:], w[2:], strict=False))
    cover = set()
    for a in range(len(w) - 2):
        if k[(w[a], w[a + 1], w[a + 2])] > 1:
            cover |= {a, a + 1, a + 2}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover)


def test_counts_and_verdicts(spark):
    rng = random.Random(4)
    rows = []
    for d in range(400):
        w = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(40, 200))]
        if d % 50 == 1:
            w = [x + "###" for x in w]
        if d % 50 == 2:
            w = ["same words again"] * 60
        rows.append((d, None if d % 97 == 0 else "\n".join(" ".join(w[i : i + 9]) for i in range(0, len(w), 9)), None if d % 31 == 0 else "xx", ["s1", "s2", None][d % 3]))
    rows += [(None, "", "xx", "s1"), (None, None, None, None), rows[5]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 as n_words", "true as kept", "2 as fence")
    got = quality_rules.judged(df).collect()
    key = lambda r: repr(r)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=key) == sorted(((d, *brute_counts(t)) for d, t, _, _ in rows), key=key)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept is not None and not (r.base_failed and r.kept)
        if r.doc_id is not None and r.doc_id % 50 == 1:
            assert not r.kept
        elif not r.base_failed:
            assert r.kept, r
    kept = quality_rules.filtered(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=key) == sorted((r.doc_id for r in got if r.kept), key=key)
    assert quality_rules.judged(df.limit(0)).count() == 0


def exact_fences(rows, reach, prior):
    """(lang, source) -> rule -> (lower, upper), from sorted values instead of sketches. rows: (lang, source, {rule: value})."""

    def own(values, rule):
        v = sorted(values)
        q10, q50, q90 = (v[max(0, math.ceil(q * len(v)) - 1)] for q in (0.1, 0.5, 0.9))
        up = q90 + reach * (q90 - q50)
        return (q10 - reach * (q50 - q10), up) if rule == "word_length" else (None, max(up, 0.02))

    def drawn(n, mine, parent):
        return tuple(None if a is None else (n * a + prior * b) / (n + prior) for a, b in zip(mine, parent, strict=True))

    out = {}
    for rule in quality_rules.RULES:
        top = own([x[rule] for _, _, x in rows], rule)
        for lang in {r[0] for r in rows}:
            of_lang = [x[rule] for la, _, x in rows if la == lang]
            middle = drawn(len(of_lang), own(of_lang, rule), top)
            for source in {r[1] for r in rows if r[0] == lang}:
                of = [x[rule] for la, s, x in rows if (la, s) == (lang, source)]
                out.setdefault((lang, source), {})[rule] = drawn(len(of), own(of, rule), middle)
    return out


def test_fences_and_verdicts_follow_exact_quantiles(spark):
    rng = random.Random(8)
    rows = []
    for d in range(1500):
        lang, source = rng.choice([("xx", "s1"), ("xx", "s2"), ("yy", "s1"), (None, "s3")])
        n = rng.randrange(50, 400)
        level = {"s1": 0.02, "s2": 0.2, "s3": 0.0}[source]
        rows.append((d, lang, source, n, int(n * rng.gauss(6 if lang == "xx" else 9, 0.5)), int(n * level * rng.random() * rng.choice([1, 1, 1, 9])), rng.choice([0] * 20 + [9, 30]), int(0.4 * n * rng.random() * level), n // 6))
    rows += [(5000 + d, "yy", "s9", 100, 900, 0, 0, 0, 10) for d in range(3)]  # a small group
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long")
    assert not df.filter(quality_rules.base_failed()).count()
    value = lambda r: {"word_length": r[4] / r[3], "symbol_rate": r[5] / r[3], "dup_line_rate": r[6] / r[8], "repeat_rate": r[7] / r[3]}
    want = exact_fences([(r[1], r[2], value(r)) for r in rows], 6.0, 200)
    got = {(f.lang, f.source): f for f in quality_rules.group_fences(df).collect()}
    assert set(got) == set(want)
    for key, rules in want.items():
        for rule, (low, up) in rules.items():
            # A quantile is read at most 2 % too high: q90 + 6 * (q90 - q50) then errs by at most 2 % of 7 * q90 + 6 * q50.
            assert abs(got[key][f"upper_{rule}"] - up) <= 0.02 * 13 * max(up, 1e-9), (key, rule)
            assert (got[key][f"lower_{rule}"] is None) == (low is None)
    assert len({round(f.upper_symbol_rate, 3) for f in got.values()}) >= 4  # every group has a fence of its own
    verdicts = {r.doc_id: r.kept for r in quality_rules._fenced(df).withColumn("kept", quality_rules.kept()).collect()}
    k, n = {"symbol_rate": 5, "dup_line_rate": 6, "repeat_rate": 7}, {"symbol_rate": 3, "dup_line_rate": 8, "repeat_rate": 3}
    clear = wrong = 0
    for r in rows:
        rules = want[r[1], r[2]]
        bad = near = False
        for rule, (low, up) in rules.items():
            x = value(r)[rule] if rule == "word_length" else (r[k[rule]] - 2 * math.sqrt(r[k[rule]] * (3 if rule == "repeat_rate" else 1))) / r[n[rule]]
            bad |= x > up or low is not None and x < low
            near |= abs(x - up) <= 0.26 * up or low is not None and abs(x - low) <= 0.26 * abs(low)
        if not near:
            clear += 1
            wrong += verdicts[r[0]] == bad
    assert wrong == 0 and clear > 1000


def test_each_rule_alone_rejects_an_outlier(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(4, 8)))
    lines = lambda w: [" ".join(w[i : i + 6]) for i in range(0, len(w), 6)]
    clean = lambda: lines([word() for _ in range(90)])

    def phrases(times):  # repeated words inside lines that differ
        return [f"one two three {x}" for x in lines([word() for _ in range(6 * times)])] + clean()

    planted = {
        "word_length": [x.replace(" ", "abcdefghabcdefgh ") for x in clean()],
        "symbol_rate": [x.replace(" ", "# ") for x in clean()],
        "dup_line_rate": [y for x in clean() for y in (x, "read on")],
        "repeat_rate": phrases(20),
    }
    rows = [(d, "\n".join(clean()), "xx", "s") for d in range(300)]
    rows += [(1000 + i, "\n".join(planted[r]), "xx", "s") for i, r in enumerate(quality_rules.RULES)]
    rows += [(2000, "\n".join(["same line", *clean(), "same line"]), "xx", "s"), (2001, "\n".join(phrases(3)), "xx", "s")]  # small deviations
    rows += [(3000 + d, "\n".join(phrases(20) if d % 8 == 0 else clean()), "xx", "usual") for d in range(300)]  # where repeats are usual
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality_rules.judged(df).collect()}
    assert not any(r.base_failed for r in got.values())
    assert [d for d, r in sorted(got.items()) if not r.kept] == [1000, 1001, 1002, 1003]
    assert {r.doc_id for r in quality_rules.filtered(df).collect()} == {d for d in got if got[d].kept}
    assert [got[1000 + i].broken for i in range(4)] == list(quality_rules.RULES)  # each by its own rule only
