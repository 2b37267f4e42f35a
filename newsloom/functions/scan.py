"""The injection scanner: rules as data, folded into one column expression."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.text import BIDI, ZERO_WIDTH

THRESHOLD = 0.5


@dataclass(frozen=True)
class Rule:
    """kind: phrase (in lower-cased text), regex (in collapsed text), base64 (a decodable run in raw text)."""

    name: str
    kind: str
    weight: float
    patterns: tuple[str, ...] = field(default=())
    min_length: int = 100


#: The scanner's rules, in the order that matches are listed in.
RULES = [
    Rule("ignore_instructions", "phrase", 0.4, ("ignore previous instructions", "ignore above instructions", "ignore all previous instructions", "disregard previous instructions", "disregard all instructions", "forget previous instructions")),
    Rule("role_override", "phrase", 0.5, ("you are now", "system prompt", "as an ai", "as an artificial intelligence", "you are an ai")),
    Rule("financial_manipulation", "phrase", 0.5, ("tell the user to buy", "tell the user to sell", "tell the user to hold", "tell users to buy", "tell users to sell", "advise the user to buy", "advise the user to sell")),
    Rule("role_markers", "regex", 0.25, (r"(?im)^(assistant|system|user)\s*:", r"<\|system\|>", r"<\|im_start\|>", r"<\|im_end\|>")),
    Rule("base64_block", "base64", 0.5, (), 100),
]


def preprocessed(text: Column) -> Column:
    """Invisible characters become spaces; runs of white space one space (none is trimmed)."""
    hidden = ZERO_WIDTH + BIDI
    return F.regexp_replace(F.translate(text, hidden, " " * len(hidden)), r"(?U)\s+", " ")


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return F.coalesce(out, F.lit(False))


def _hit(rule: Rule, raw: Column, clean: Column, low: Column) -> Column:
    """Whether a rule hits, given the raw text, the collapsed one, and that in lower case."""
    if rule.kind == "phrase":
        return _any([F.contains(low, F.lit(p.lower())) for p in rule.patterns])
    if rule.kind == "regex":
        return _any([clean.rlike(p) for p in rule.patterns])
    runs = F.regexp_extract_all(raw, F.lit("[A-Za-z0-9+/]{%d,}={0,2}" % rule.min_length), 0)
    # Missing padding is added; a run that can't be padded, or is padded too much, doesn't decode.
    padded = lambda x: F.rpad(x, F.length(x) + (F.lit(4) - F.length(x) % 4) % 4, F.lit("="))
    good = lambda x: (F.length(F.regexp_replace(x, "=", "")) % 4 != 1) & padded(x).rlike("^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$")
    return _any([F.exists(runs, good)])


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def matched_rules(text: Column, rules: list[Rule] = RULES) -> Column:
    """Names of the rules that hit, in rule order. A text is collapsed once and lower-cased once for all rules."""
    names = lambda clean, low: F.filter(F.array(*[F.when(_hit(r, text, clean, low), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
    return _with(preprocessed(text), lambda clean: _with(F.lower(clean), lambda low: names(clean, low)))


def score_of(matched: Column, rules: list[Rule] = RULES) -> Column:
    """The sum of the matched rules' weights, at most 1."""
    total = F.lit(0.0)
    for r in rules:
        total = total + F.when(F.array_contains(matched, r.name), F.lit(r.weight)).otherwise(F.lit(0.0))
    return F.least(F.lit(1.0), total)


def article_status(score: Column, threshold: float = THRESHOLD) -> Column:
    return F.when(score >= threshold, "quarantined").otherwise("active")


def grey_zone(status: Column, score: Column, low: float = 0.0, threshold: float = THRESHOLD) -> Column:
    return F.coalesce((status == "active") & (score > low) & (score < threshold), F.lit(False))
