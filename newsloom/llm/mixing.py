"""Mixing sources to target weights by hierarchical budgets and seeded epochs.

Leaves are (domain, language, source). The token budget goes down the tree: a node's budget is shared
among its children by weight, and no child gets more than it can supply (its tokens times the epochs
allowed). What a child can't supply goes to its siblings, by weight again; only what a whole family
can't supply goes to the family's own siblings, since a node's supply is the sum of its leaves'. Shares
are whole tokens, rounded down. The family's shares have a closed form over its children sorted by
supply / weight, so a level is one window over one row for each node.

A leaf's target is f whole epochs and a rest. Every row of the leaf comes f times; the rest is a prefix
of the next epoch: rows in the order of md5(seed | epoch | doc_id | md5(text)), taken while fewer tokens
than the rest come before them (so a leaf exceeds its target by less than one row's tokens; rows that
tie on the order, that is repeated rows, are taken together).

A leaf may hold a third of all rows, so no window runs over a leaf's rows. The order's first three hex
digits make 4096 buckets; per-bucket token sums, summed map-side first, show in which bucket the prefix
ends; only that bucket's rows are ordered. The result is one cut key for each leaf.

Defined cases: a null lang or source is the name `unknown`; a null or empty text has no tokens and comes
with its epoch; a null doc_id is left out of the order's key, so such rows are told apart by text; an
empty table gives an empty result; extra columns are ignored or come back unchanged. Weights are whole
numbers of at least 0; a weight of 0 leaves a node out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.rows import WORD, whole
from newsloom.session import staged

LEAF = ["domain", "lang", "source"]
#: Target weights by level and name; other names weigh 1.
WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}, "source": {"src0": 2}}
#: The domain of a source, as SQL: sources are numbered, and the number modulo 4 stands for a domain.
DOMAIN = "concat('d', coalesce(cast(try_cast(regexp_extract(source, '[0-9]+', 0) as int) % 4 as string), 'unknown'))"


def leaves(docs: DataFrame, domain: str = DOMAIN) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens and md5(text) of each row."""
    tokens = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    d = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("text").cast("string"))
    name = lambda c: F.coalesce(F.col(c), F.lit("unknown")).alias(c)
    return d.select("doc_id", F.expr(domain).alias("domain"), name("lang"), name("source"), tokens.alias("n_tokens"), F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


def weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    out = F.lit(1).cast("long")
    for name, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == name, F.lit(w).cast("long")).otherwise(out)
    return out


def shared_out(children: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Adds `share` to rows (parents..., name, supply, weight, budget), the budget being the parent's.

    Sorted by supply / weight, the children that can't supply their share come first. The budget is at
    most the family's supply.
    """
    # The root's children have no parent: one row for each domain.
    family = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    line = family.orderBy(F.col("supply").cast("double") / F.col("weight").cast("double"), name)
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    c = children.filter("weight > 0").withColumns(
        {"_had": F.coalesce(F.sum("supply").over(before), F.lit(0)), "_rest": F.sum("weight").over(family) - F.coalesce(F.sum("weight").over(before), F.lit(0))}
    )
    c = c.withColumn("_short", F.col("supply") * F.col("_rest") <= (F.col("budget") - F.col("_had")) * F.col("weight"))
    given = F.sum(F.when(F.col("_short"), F.col("supply")).otherwise(0)).over(family)
    open_ = F.sum(F.when(~F.col("_short"), F.col("weight")).otherwise(0)).over(family)
    c = c.withColumns({"_given": given, "_open": open_})
    share = F.expr("case when _short then supply else (weight * (budget - _given)) div _open end")
    return c.withColumn("share", share).drop("_had", "_rest", "_short", "_given", "_open")


def targets(supply: DataFrame, fraction: float = 0.6, max_epochs: int = 2, weights: dict[str, dict[str, int]] = WEIGHTS) -> DataFrame:
    """(domain, lang, source, tokens, target): the tokens to take from each leaf of `supply` (leaf, tokens)."""
    base = supply.withColumn("supply", F.col("tokens") * max_epochs)
    whole_budget = supply.agg(F.floor(F.sum("tokens") * F.lit(fraction)).alias("budget"))
    level = base.groupBy("domain").agg(F.sum("supply").alias("supply")).withColumn("weight", weight("domain", weights))
    level = level.crossJoin(F.broadcast(whole_budget))  # one row
    level = level.withColumn("budget", F.least("budget", F.sum("supply").over(Window.partitionBy(F.lit(0)))))
    level = shared_out(level, [], "domain")
    for parents, name in ((["domain"], "lang"), (["domain", "lang"], "source")):
        above = level.select(*parents, F.col("share").alias("budget"))
        level = base.groupBy(*parents, name).agg(F.sum("supply").alias("supply"), F.sum("tokens").alias("tokens"))
        level = level.withColumn("weight", weight(name, weights)).join(above, parents)
        level = level.withColumn("budget", F.least("budget", F.sum(F.when(F.col("weight") > 0, F.col("supply")).otherwise(0)).over(Window.partitionBy(*parents))))
        level = shared_out(level, parents, name)
    return level.select(*LEAF, "tokens", F.col("share").alias("target"))


def order_key(seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("epochs").cast("string"), F.col("doc_id").cast("string"), F.col("text_md5")))


def leaf_plan(rows: DataFrame, seed: int = 17, **options) -> DataFrame:
    """(leaf, target, epochs, cut): whole epochs, and the last key of the next epoch's prefix ('' if none)."""
    supply = rows.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens"))
    plan = targets(supply, **options).filter("tokens > 0")
    plan = staged(plan.withColumns({"epochs": F.expr("target div tokens"), "rest": F.expr("target % tokens")}), "targets")
    keyed = rows.join(plan, LEAF).withColumn("key", order_key(seed)).withColumn("bucket", F.substring("key", 1, 3))
    sums = keyed.groupBy(*LEAF, "bucket").agg(F.sum("n_tokens").alias("in_bucket"), F.first("rest").alias("rest"))
    upto = F.sum("in_bucket").over(Window.partitionBy(*LEAF).orderBy("bucket"))
    last = sums.withColumn("upto", upto).filter("upto - in_bucket < rest and rest <= upto")
    last = last.select(*LEAF, "bucket", (F.col("upto") - F.col("in_bucket")).alias("had"))
    tail = keyed.join(last, [*LEAF, "bucket"])
    order = Window.partitionBy(*LEAF).orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    tail = tail.withColumns({"upto": F.col("had") + F.sum("n_tokens").over(order), "tied": F.sum("n_tokens").over(Window.partitionBy(*LEAF, "key"))})
    cut = tail.filter("upto - tied < rest").groupBy(*LEAF).agg(F.max("key").alias("cut"))
    return plan.join(cut, LEAF, "left").select(*LEAF, "target", "epochs", F.coalesce("cut", F.lit("")).alias("cut"))


def _copies(seed: int) -> Column:
    return F.col("epochs") + (order_key(seed) <= F.col("cut")).cast("long")


def mixed(docs: DataFrame, seed: int = 17, domain: str = DOMAIN, **options) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, target (its leaf's) and copies of each row taken."""
    rows = staged(leaves(docs, domain), "leaves")
    plan = leaf_plan(rows, seed, **options)
    return rows.join(plan, LEAF).withColumn("copies", _copies(seed)).filter("copies > 0").select("doc_id", *LEAF, "n_tokens", "target", "copies")


def mixed_documents(docs: DataFrame, seed: int = 17, domain: str = DOMAIN, **options) -> DataFrame:
    """The rows taken, with the columns of `docs` and `copies`, how often each is to be seen (in place of a column of that name).

    The plan has a row for each leaf; texts pass by it without a shuffle while it is small enough to
    broadcast, which Spark checks, and AQE splits the skew of a shuffled join beyond.
    """
    plan = staged(leaf_plan(staged(leaves(docs, domain), "leaves"), seed, **options), "plan")
    raw = docs.select(whole(docs), F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_md5"))
    named = raw.withColumn("domain", F.expr(domain)).withColumns({c: F.coalesce(c, F.lit("unknown")) for c in ("lang", "source")})
    return named.join(plan, LEAF).withColumn("copies", _copies(seed)).filter("copies > 0").select(*[F.col("whole").getField(c).alias(c) for c in docs.columns if c != "copies"], "copies")


def _case(level: str, weights: dict[str, dict[str, int]]) -> str:
    return f"case {level} " + " ".join(f"when '{k}' then {v}" for k, v in weights[level].items()) + " else 1 end"


def _level_sql(name: str, parents: list[str], above: str, out: str, weights: dict[str, dict[str, int]]) -> str:
    keys = ", ".join([*parents, name])
    by = f"partition by {', '.join(parents)}" if parents else ""
    join = f"join {above} using ({', '.join(parents)})" if parents else f"cross join {above}"
    return f"""
{out}_a as (select {keys}, sum(tokens) as tokens, sum(tokens) * 2 as supply, {_case(name, weights)} as weight from supply group by {keys}),
{out}_b as (select {out}_a.*, least(share, sum(supply) over ({by})) as budget from {out}_a {join}),
{out}_c as (select *,
  coalesce(sum(supply) over ({by} order by supply::double / weight::double, {name} rows between unbounded preceding and 1 preceding), 0) as had,
  sum(weight) over ({by}) - coalesce(sum(weight) over ({by} order by supply::double / weight::double, {name} rows between unbounded preceding and 1 preceding), 0) as rest
  from {out}_b),
{out}_d as (select *, supply * rest <= (budget - had) * weight as short from {out}_c),
{out}_e as (select *, sum(case when short then supply else 0 end) over ({by}) as given, sum(case when short then 0 else weight end) over ({by}) as open from {out}_d),
{out} as (select {keys}, tokens, (case when short then supply else (weight * (budget - given)) // open end)::bigint as share from {out}_e)"""


#: The same query at its defaults; a leaf's rows are ordered in one window.
SQL = (
    r"""
with leaves as (
  select doc_id, 'd' || coalesce((try_cast(regexp_extract(source, '[0-9]+') as int) % 4)::varchar, 'unknown') as domain,
    coalesce(lang, 'unknown') as lang, coalesce(source, 'unknown') as source,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as n_tokens, md5(coalesce(text, '')) as text_md5
  from documents
), supply as (select domain, lang, source, sum(n_tokens)::hugeint as tokens from leaves group by all),
top as (select floor(sum(tokens) * 0.6::double)::hugeint as share from supply),"""
    + ",".join(
        [
            _level_sql("domain", [], "top", "l1", WEIGHTS),
            _level_sql("lang", ["domain"], "(select domain, share from l1)", "l2", WEIGHTS),
            _level_sql("source", ["domain", "lang"], "(select domain, lang, share from l2)", "l3", WEIGHTS),
        ]
    )
    + """,
plan as (select domain, lang, source, share as target, share // tokens as epochs, share % tokens as rest from l3 where tokens > 0),
keyed as (select *, md5(concat_ws('|', '17', epochs::bigint::varchar, doc_id::varchar, text_md5)) as key from leaves join plan using (domain, lang, source)),
run as (select *, sum(n_tokens) over (partition by domain, lang, source order by key range between unbounded preceding and current row)
  - sum(n_tokens) over (partition by domain, lang, source, key) as had from keyed),
taken as (select doc_id, domain, lang, source, n_tokens, target, (epochs + (had < rest)::int)::bigint as copies from run)
select * from taken where copies > 0
"""
)
