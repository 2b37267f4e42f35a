"""Model requests and responses: keys, blocks, strict parsing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom import schemas

FENCE = r"(?is)```(?:json)?\s*(.*?)```"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is found once, however often `use` names it: without this, every mention is evaluated anew."""
    return F.transform(F.array(value), use)[0]


def version_hash(stem: str, prompt: Column) -> Column:
    """`stem:` and the first eight digits of the prompt's hash."""
    return F.concat(F.lit(f"{stem}:"), F.substring(F.sha2(prompt, 256), 1, 8))


def cache_key(prompt_version: Column, model: Column, user: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", prompt_version, model, user), 256), 1, 32)


def strip_fence(text: Column) -> Column:
    """What the first code fence holds, or the text as it is; without white space at both ends."""
    bare = lambda x: F.regexp_replace(x, r"^(?U)\s+|(?U)\s+$", "")
    t = bare(text)
    return F.when(t.rlike(FENCE), bare(F.regexp_extract(t, FENCE, 1))).otherwise(t)


def request_block(article_id: Column, text: Column, seed: str, publisher: Column | None = None, published_at: Column | None = None) -> Column:
    """An article in tags with a nonce that follows from the run's seed and the id, so that equal requests have equal keys."""
    nonce = F.substring(F.sha2(F.concat(F.lit(seed), article_id.cast("string")), 256), 1, 16)
    parts = [F.lit('<article id="'), article_id.cast("string")]
    if publisher is not None:
        parts += [F.lit('" publisher="'), F.coalesce(F.nullif(publisher, F.lit("")), F.lit("unknown")), F.lit('" published_at="'), F.date_format(published_at, "yyyy-MM-dd")]
    return F.concat(*parts, F.lit('" nonce="'), nonce, F.lit('">\n'), text, F.lit('\n</article nonce="'), nonce, F.lit('">'))


def _shape_problem(value: Column, kind: T.DataType, optional: set[str], path: str = "") -> Column:
    """Null if a JSON text has exactly the keys and JSON types of `kind`; else what is wrong. Checked level by level."""
    if isinstance(kind, T.StructType):
        names = [f.name for f in kind.fields]
        need = F.array(*[F.lit(n) for n in names if n not in optional])
        inside = lambda f: bound(_member(value, f.name), lambda x: _shape_problem(x, f.dataType, optional, f"{path}{f.name}."))
        fields = [inside(f) for f in kind.fields if f.name not in optional]

        def wrong_keys(keys: Column) -> Column:
            extra, missing = F.array_except(keys, F.array(*[F.lit(n) for n in names])), F.array_except(need, keys)
            return F.coalesce(
                F.when(keys.isNull(), F.lit(f"{path}not an object")), F.when(F.size(extra) > 0, F.concat(F.lit(f"{path}extra key "), F.try_element_at(extra, F.lit(1)))),
                F.when(F.size(missing) > 0, F.concat(F.lit(f"{path}missing key "), F.try_element_at(missing, F.lit(1)))),
            )

        return F.coalesce(bound(F.json_object_keys(value), wrong_keys), *fields)
    if isinstance(kind, T.ArrayType):
        wrong = lambda items: F.filter(F.transform(items, lambda x: _shape_problem(x, kind.elementType, optional, f"{path}[].")), lambda p: p.isNotNull())
        said = lambda items: F.when(items.isNull() | ~F.trim(value).startswith("["), F.lit(f"{path}not an array")).otherwise(F.try_element_at(wrong(items), F.lit(1)))
        return bound(F.from_json(value, "array<string>"), said)
    if isinstance(kind, T.BooleanType):
        return F.when(value.isNull() | ~value.isin("true", "false"), F.lit(f"{path}not a boolean"))
    if isinstance(kind, T.LongType):
        return F.when(value.isNull() | ~value.rlike(r"^-?\d+$"), F.lit(f"{path}not an integer"))
    if isinstance(kind, T.DoubleType):
        return F.when(value.isNull() | ~value.rlike(r"^-?\d+(\.\d+)?([eE][-+]?\d+)?$"), F.lit(f"{path}not a number"))
    return F.when(value.isNull(), F.lit(f"{path}null"))


def _member(value: Column, name: str) -> Column:
    return F.get_json_object(value, f"$.{name}")


def parsed(text: Column, ddl: str, optional: tuple[str, ...] = ()) -> Column:
    """struct<value, problem>: the response by schema, or null and why it is rejected. Nothing is repaired."""
    kind = T.StructType.fromDDL(ddl)

    def read(body: Column) -> Column:
        valid = F.try_parse_json(body).isNotNull()
        problem = F.coalesce(F.when(body.isNull() | ~valid, F.lit("invalid JSON")), _shape_problem(body, kind, set(optional)))
        return bound(problem, lambda p: F.struct(F.when(p.isNull(), F.from_json(body, ddl)).alias("value"), p.alias("problem")))

    return bound(strip_fence(text), read)


def with_rules(p: Column, *rules: Callable[[Column], tuple[Column, str]]) -> Column:
    """Further reasons to reject, each a condition over the parsed value that must hold."""

    def held(p: Column) -> Column:
        bad = F.coalesce(p["problem"], *[F.when(~F.coalesce(ok, F.lit(False)), F.lit(why)) for ok, why in (rule(p["value"]) for rule in rules)])
        return bound(bad, lambda bad: F.struct(F.when(bad.isNull(), p["value"]).alias("value"), bad.alias("problem")))

    return bound(p, held)


def parse_classification(text: Column) -> Column:
    p = parsed(text, schemas.CLASSIFICATION, ("injection_reason",))
    return with_rules(p, lambda v: (v["event_type"].isin(schemas.EVENT_TYPES), "event_type"), lambda v: (v["relevance_score"].between(0, 1), "relevance_score"))


def parse_verdict(text: Column, ddl: str) -> Column:
    """A same-event or corroboration verdict."""
    p = parsed(text, ddl)
    return with_rules(p, lambda v: (v["confidence"].between(0, 1), "confidence"))


def parse_judgement(text: Column) -> Column:
    p = parsed(text, schemas.JUDGEMENT, ("missing_or_added_bg",))
    return with_rules(p, lambda v: (v["support"].isin("supported", "partially_supported", "not_supported"), "support"))


def parse_recheck(text: Column) -> Column:
    return parsed(text, schemas.RECHECK)


def all_evidence(v: Column) -> Column:
    """Evidence of facts, then of opinions."""
    return F.flatten(F.concat(F.transform(v["key_facts"], lambda f: f["evidence"]), F.transform(v["attributed_opinions"], lambda o: o["evidence"])))


def parse_summary(text: Column) -> Column:
    return with_rules(
        parsed(text, schemas.SUMMARY), lambda v: (F.length(v["title_bg"]) <= 90, "title_bg"), lambda v: (F.forall(all_evidence(v), lambda e: F.length(e["quote_en"]) <= 200), "quote_en"),
        lambda v: (F.forall(v["key_facts"], lambda f: F.size(f["evidence"]) >= 1), "evidence"),
    )
