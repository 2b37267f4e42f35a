"""Mixer and map of lm_scoring are fitted on every bit of all documents learned from."""

import numpy as np
from pyspark.sql import functions as F

from newsloom.llm import lm_scoring


def test_every_bit_of_all_texts_is_fitted_on(spark):
    """3,000 distinct texts, more than any sample held; repeated words come as often as they stand; how rows are dealt doesn't matter."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("Text number "), "id", F.lit(" of of many")).alias("text"))
    rows = lm_scoring._rows(docs).withColumn("held_out", F.lit(False))
    words = rows.repartition(3).select("held_out", "text").mapInArrow(lm_scoring._word_counts, "name long, word binary, n long").groupBy("name", "word").agg(F.sum("n").alias("c"))
    read = [t.lower().encode() + b" \n" for (t,) in docs.select("text").collect()]
    counts = np.bincount(np.frombuffer(b"".join(read), np.uint8), minlength=256)
    code = lm_scoring.Code.of(counts)
    tables = np.zeros((2, lm_scoring.SLOTS), np.float32)
    table, got = lm_scoring.without(*tables), []
    for n in (1, 5):
        train = rows.repartition(n).select("text")
        dealt = lm_scoring._dealt(lm_scoring.GATES + 1, train.mapInArrow(lm_scoring._train_mixer(code, table, True), lm_scoring.PARTS), words.mapInArrow(lm_scoring._train_mixer(code, table, False), lm_scoring.PARTS))
        parts = {r.part: [lm_scoring.opened(x) for x in (r.zeros, r.ones)] for r in dealt.mapInArrow(lm_scoring._sum_parts, lm_scoring.PARTS).collect()}
        bits = int((code.length * counts).sum())
        assert sum(x.sum() for x in parts[lm_scoring.GATES]) == bits == sum(x.sum() for k, v in parts.items() if k < lm_scoring.GATES for x in v)
        mixer = lm_scoring.fitted_mixer(train, words, code, *tables)
        got.append((mixer.weights.tobytes(), mixer.refine.tobytes()))
    assert got[0] == got[1]


def test_own_count_is_taken_out():
    zeros, ones = np.array([0, 1, 5], np.float32), np.array([1, 0, 3], np.float32)
    got = lm_scoring.without(zeros, ones).reshape(-1, 2)
    low = lambda z, o: lm_scoring.packed(np.array([z], np.float32), np.array([o], np.float32))[0] & 63
    assert got[1, 0] == low(0, 0) == got[0, 1] and got[2, 1] == low(5, 2) and got[2, 0] == low(4, 3)
    # No guess is the middle level, and the largest ones are the outer levels.
    assert [low(*x) >> 2 for x in ((0, 0), (1e9, 0), (0, 1e9))] == [7, 0, 14]
    assert [x >> 6 for x in lm_scoring.packed(np.array([0, 1e9, 0.0]), np.array([0, 0, 1e9]))] == [0, -126, 126]


def test_weights_code_the_counts_in_the_fewest_bits():
    rng = np.random.default_rng(4)
    zeros, ones = np.zeros(lm_scoring.PART, np.int64), np.zeros(lm_scoring.PART, np.int64)
    level = rng.integers(0, lm_scoring.LEVELS, (4000, 4))
    st = (level - lm_scoring.LEVELS // 2) * (lm_scoring.STEP / 16)
    true = np.array([0.5, -0.2, 0.1, 0.4])
    bit = rng.random(4000) < lm_scoring.squash(st @ true)
    at = level @ np.array([1, 16, 256, 4096])
    np.add.at(zeros, at[~bit], 1)
    np.add.at(ones, at[bit], 1)
    w = lm_scoring.fitted_weights(zeros, ones)
    loss = lambda x: np.logaddexp(0, np.where(bit, -1, 1) * (st @ x)).sum() + 0.5 * ((x - 0.3) ** 2).sum()
    assert np.abs(w - true).max() < 0.1 and all(loss(w) <= loss(w + d) for d in rng.normal(0, 0.01, (50, 4)))
    assert np.allclose(lm_scoring.fitted_weights(zeros * 0, ones * 0), 0.3)
