"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Each document gets text statistics; each (language, source) gets quantile sketches of them; fences read
from the sketches replace fixed cutoffs; documents are joined with the fences of their group and filtered.

The sketch is a histogram over logarithmic bins (bin = ceil(log_gamma(value)), and one bin for 0): two
sketches merge by adding counts, so partial sketches combine map-side and in any order, and the outcome
does not depend on the partitioning. A quantile read from it is the exact one or up to a factor gamma
above. Sketches are taken over the rows that pass the base rule.

A group's upper fence of a statistic is q90 + reach * (q90 - q50), the lower one (for rules in LOWER)
q10 / gamma - reach * (q50 - q10): as far beyond the group's own tenth as a multiple of that tenth's distance from
the middle. Most documents of a clean group hold no symbol and repeat nothing, and such a fence is 0; a
rate's fence is therefore at least 1 / 50, one occurrence in the shortest text that the base rule passes.
Every group's fence is drawn towards its language's by a weight of `prior` rows, and a language's towards
the corpus's, (rows * own + prior * parent) / (rows + prior): a small group follows its parent, a large
one itself, without a switch between them.

A rate k / n is judged by (k - 2 * sqrt(clump * k)) / n, two standard errors below: few occurrences in a
short text are no evidence (up to 4 never are). Symbols and duplicate lines come one by one (clump 1),
repeated words at least three at a time (clump 3).

Base rule, fixed: n_words < 50, or 100 * n_repeat_words > 50 * n_words.

Defined cases: a null or empty text has no words and fails the base rule; a null lang or source forms a
group of its own; rows are judged one by one, so repeated rows and null ids are kept apart; an empty
table gives an empty result; extra columns are ignored, or come back unchanged from `filtered` (they must
be of types that Arrow can carry).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.bytegrid import Grid, blocks, covered, inside, mix, window_hashes
from newsloom.llm.rows import numbered, small_side, unnumbered
from newsloom.session import staged

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
#: The symbols counted, as bytes.
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

#: Rate -> (occurrences, out of, clump): the statistic is the ratio of the first two.
RATES = {"symbol_rate": ("n_symbols", "n_words", 1), "dup_line_rate": ("n_dup_lines", "n_lines", 1), "repeat_rate": ("n_repeat_words", "n_words", 3)}
#: Statistic -> expression.
RULES = {"word_length": "word_chars / nullif(n_words, 0)"} | {r: f"{k} / nullif({n}, 0)" for r, (k, n, _) in RATES.items()}
#: Statistics that also have a lower fence.
LOWER = ["word_length"]
#: Words of the shortest text that passes the base rule.
LEAST_WORDS = 50
#: The sketches' bin of the value 0.
ZERO = -(1 << 30)


def text_counts(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The counts of each text; n_lines are its lines with a word."""
    grid = Grid(texts).words().lines()
    points = grid.points()
    n_words = grid.whi - grid.wlo
    chars = grid.per_doc(grid.wdoc, points[grid.we] - points[grid.ws])
    symbol = np.concatenate([[0], np.cumsum(SYMBOLS[grid.buf])])
    symbols = symbol[grid.end] - symbol[grid.start]

    has_word = np.searchsorted(grid.ws, grid.le) > np.searchsorted(grid.ws, grid.ls)
    ldoc = grid.ldoc[has_word]
    line = grid.hashes(grid.ls[has_word], grid.le[has_word]) ^ mix(ldoc.astype(np.uint64), 5)
    _, at = np.unique(line, return_index=True)
    dup = grid.per_doc(ldoc) - grid.per_doc(ldoc[at])

    h = window_hashes(grid.hashes(grid.ws, grid.we), 3)
    starts = np.flatnonzero(inside(grid.wlo, grid.whi, len(grid.ws), 3))
    key = h[starts] ^ mix(grid.wdoc[starts].astype(np.uint64), 6)
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[order][1:] == key[order][:-1]
    again = starts[order[same[1:] | same[:-1]]] if len(key) else starts
    repeats = grid.per_doc(grid.wdoc[covered(again, 3, len(grid.ws))])
    return dict(zip(COUNTS, (n_words.astype(np.int64), chars, symbols.astype(np.int64), dup, repeats, grid.per_doc(ldoc)), strict=True))


def _counts(text: int):
    """Rows -> the rows and their counts; `text` is the text's place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, text=f"c{text}"):
            got = text_counts(texts)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(got[c]) for c in COUNTS)], [*batch.schema.names, *COUNTS])

    return run


def with_counts(docs: DataFrame) -> DataFrame:
    """The columns of `docs` as c0, c1, ..., with `lang`, `source` and the counts beside them."""
    flat = numbered(docs)
    place = {c: i for i, c in enumerate(docs.columns)}
    text = place["text"]
    flat = flat.withColumn(f"c{text}", F.col(f"c{text}").cast("string"))
    fields = [T.StructField(f.name, f.dataType) for f in flat.schema.fields] + [T.StructField(c, T.LongType()) for c in COUNTS]
    counted = flat.mapInArrow(_counts(text), T.StructType(fields))
    return counted.select("*", *[F.col(f"c{place[c]}").cast("string").alias(c) for c in ("lang", "source")])


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def statistic(name: str) -> Column:
    return F.expr(RULES[name])


def judged_statistic(name: str) -> Column:
    """What is held against the upper fence: a rate, less two standard errors of its occurrences."""
    if name not in RATES:
        return statistic(name)
    k, n, clump = RATES[name]
    return F.expr(f"({k} - 2 * sqrt({clump} * {k})) / nullif({n}, 0)")


def sketches(counted: DataFrame, gamma: float = 1.02) -> DataFrame:
    """(lang, source, rule, bin, rows): the sketches of each language and source, over rows that pass the base rule."""
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), statistic(r).alias("value")) for r in RULES])).alias("x")
    long = counted.filter(~base_failed()).select("lang", "source", rules)
    bin_ = F.when(F.col("x.value") > 0, F.ceil(F.log("x.value") / float(np.log(gamma))).cast("int")).otherwise(ZERO).alias("bin")
    return long.groupBy("lang", "source", F.col("x.rule").alias("rule"), bin_).agg(F.count("*").alias("rows"))


def merged(sketch: DataFrame, *by: str) -> DataFrame:
    """Sketches of coarser groups: counts of equal bins add up."""
    return sketch.groupBy(*by, "rule", "bin").agg(F.sum("rows").alias("rows"))


def quantiles(sketch: DataFrame, *by: str, gamma: float) -> DataFrame:
    """(by..., rule, n, q10, q50, q90): rows in each group's sketch, and quantiles read from it."""
    group = Window.partitionBy(*by, "rule")
    ranked = sketch.withColumns({"upto": F.sum("rows").over(group.orderBy("bin")), "n": F.sum("rows").over(group)})
    value = F.when(F.col("bin") == ZERO, 0.0).otherwise(F.pow(F.lit(gamma), F.col("bin")))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("n"), value))
    return ranked.groupBy(*by, "rule").agg(F.first("n").alias("n"), at(0.1).alias("q10"), at(0.5).alias("q50"), at(0.9).alias("q90"))


def fences(sketch: DataFrame, *by: str, gamma: float, reach: float) -> DataFrame:
    """(by..., rule, n, lower, upper): each group's own fences; lower is null for rules without one."""
    upper = F.col("q90") + reach * (F.col("q90") - F.col("q50"))
    least = F.when(F.col("rule").isin(*RATES), 1 / LEAST_WORDS)  # greatest() skips nulls
    # Quantiles are read at their bin's upper end; from below, the lower end counts.
    lower = F.when(F.col("rule").isin(LOWER), F.col("q10") / gamma - reach * (F.col("q50") - F.col("q10")))
    return quantiles(sketch, *by, gamma=gamma).select(*by, "rule", "n", lower.alias("lower"), F.greatest(upper, least).alias("upper"))


def group_fences(counted: DataFrame, gamma: float = 1.02, reach: float = 6.0, prior: int = 200) -> DataFrame:
    """(lang, source, lower_<rule>, upper_<rule>...): one row for each language and source."""
    own = staged(sketches(counted, gamma), "sketches")
    named = lambda df, by, tag: df.select(*[F.col(c).alias(f"{tag}_{c}") for c in [*by, "rule", "n", "lower", "upper"]])
    of_all = named(fences(merged(own), gamma=gamma, reach=reach), [], "a")
    of_lang = named(fences(merged(own, "lang"), "lang", gamma=gamma, reach=reach), ["lang"], "l")
    of_source = fences(own, "lang", "source", gamma=gamma, reach=reach)
    drawn = lambda n, own_, parent: (F.col(n) * F.col(own_) + prior * F.col(parent)) / (F.col(n) + prior)
    # The coarser tables have a row for each language and rule, and one for each rule.
    langs = of_lang.join(of_all, F.col("l_rule") == F.col("a_rule")).withColumns({"l_lower": drawn("l_n", "l_lower", "a_lower"), "l_upper": drawn("l_n", "l_upper", "a_upper")})
    both = of_source.join(langs, F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("rule") == F.col("l_rule")))
    both = both.withColumns({"lower": drawn("n", "lower", "l_lower"), "upper": drawn("n", "upper", "l_upper")})
    pick = [F.max(F.when(F.col("rule") == r, F.col(side))).alias(f"{side}_{r}") for r in RULES for side in ("lower", "upper")]
    return both.groupBy("lang", "source").agg(*pick)


def broken() -> dict[str, Column]:
    """Rule -> whether a row that has counts and fences breaks it (a group in which every row fails the base rule has no fences)."""
    out = {}
    for r in RULES:
        bad = F.coalesce(judged_statistic(r) > F.col(f"upper_{r}") * (1 + 1e-9), F.lit(False))
        out[r] = bad | F.coalesce(statistic(r) < F.col(f"lower_{r}") * (1 - 1e-9), F.lit(False)) if r in LOWER else bad
    return out


def kept() -> Column:
    """The verdict on a row that has counts and fences."""
    bad = base_failed()
    for b in broken().values():
        bad = bad | b
    return ~bad


def _fenced(counted: DataFrame, **options: float) -> DataFrame:
    """Rows of a staged table with counts, beside the fences of their group."""
    f = staged(group_fences(counted, **options).withColumnsRenamed({"lang": "l", "source": "s"}), "fences")
    return counted.join(small_side(f), F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")), "left")


def judged(docs: DataFrame, **options: float) -> DataFrame:
    """doc_id, lang, source, the counts, base_failed, kept and the rules broken of each row."""
    d = docs.select("doc_id", "lang", "source", "text")
    numbers = with_counts(d).select(F.col("c0").cast("long").alias("doc_id"), "lang", "source", *COUNTS)
    both = _fenced(staged(numbers, "counts"), **options)  # numbers only; both the sketches and the verdicts read them
    names = F.array_compact(F.array(*[F.when(bad, F.lit(r)) for r, bad in broken().items()]))
    return both.select("doc_id", "lang", "source", *COUNTS, base_failed().alias("base_failed"), kept().alias("kept"), F.array_join(names, ",").alias("broken"))


def filtered(docs: DataFrame, **options: float) -> DataFrame:
    """The rows of `docs` that pass, with their columns; rejected rows go.

    Texts are counted once and written beside their counts; the verdicts are read from that table, so
    no text is shuffled.
    """
    return _fenced(staged(with_counts(docs), "counted"), **options).filter(kept()).select(*unnumbered(docs))
