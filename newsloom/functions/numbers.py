"""Numbers in Bulgarian text, and their English surface forms, as column expressions.

The grammar keeps three known oddities by default: four-digit runs are read as three digits and the
rest, a number with a thousands comma is dropped, and 900 to 999 only match as `0.9x thousand`. With
`fixed`, whole digit runs and thousands commas are read as one number.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Magnitude words and their factors.
MAGNITUDES = {
    "трлн": 1e12, "трилиона": 1e12, "трилиони": 1e12, "млрд": 1e9, "милиарда": 1e9, "милиарди": 1e9,
    "млн": 1e6, "милиона": 1e6, "милиони": 1e6, "хил": 1e3, "хиляди": 1e3, "хиляда": 1e3,
}
#: Currency words and signs, and their units.
CURRENCY_WORDS = {"долара": "usd", "долари": "usd", "евро": "eur", "лв": "bgn"}
CURRENCY_SIGNS = {"$": "usd", "€": "eur", "£": ""}
#: Fixed value: the word for a quarter beside a number.
QUARTER_WORD = "тримесечие"
#: Quarter words.
QUARTERS = {"първото": 1, "първи": 1, "второто": 2, "втори": 2, "третото": 3, "трети": 3, "четвъртото": 4, "четвърти": 4}
ORDINALS = {1: "first", 2: "second", 3: "third", 4: "fourth"}
#: English magnitudes, from the largest.
SCALES = [(1e12, ["trillion", "T"]), (1e9, ["billion", "B"]), (1e6, ["million", "M"]), (1e3, ["thousand", "K"])]
#: How an English source may write x, with a magnitude word n, by unit; "" stands for all other units.
SCALED_FORMS = {"usd": ["${x} {n}", "${x}{n}", "{x} {n}"], "eur": ["€{x} {n}", "{x} {n}"], "": ["{x} {n}", "{x}{n}"]}
PLAIN_FORMS = {"usd": ["${x}", "{x}"], "eur": ["€{x}", "{x}"], "%": ["{x}%", "{x} percent", "{x} per cent"], "quarter": ["Q{i}", "Q {i}", "quarter {i}", "{o} quarter"], "": ["{x}"]}


def _any_of(words: dict) -> str:
    return "(" + "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True)) + ")"


def _number_pattern(groups: str) -> str:
    """Fixed in what it takes for a number, oddities included, for results must match. Groups: sign, whole part, fraction, magnitude, currency word, percent sign. `groups` says how often a separated group of three may come."""
    sign, mag, money = _any_of(CURRENCY_SIGNS), _any_of(MAGNITUDES), _any_of(CURRENCY_WORDS)
    return rf"(?iu){sign}?(\d{{1,3}}(?:[.,]\d{{3}}){groups}|\d+)(?:[,.](\d+))?\s*{mag}?\.?(?:\s*{money}\.?)?(\s*%)?"


NUMBER, NUMBER_FIXED = _number_pattern("*"), _number_pattern("+")
PERCENT = r"(\d+(?:[.,]\d+)?)\s*%"
#: Fixed value: a price for a share, by sign or word.
PER_SHARE = r"(?iu)([$€])?\s*(\d+[.,]\d+)\s*(?:долара|евро)?\s*на\s+акция"
QUARTER = rf"(?iuU)\b(?:Q\s*([1-4])|{_any_of(QUARTERS)}\s+{QUARTER_WORD})"


def _map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def _decimal(said: Column) -> Column:
    """A number with a decimal point or comma."""
    return F.translate(said, ",", ".").cast("double")


def _share_value(g: Callable[[int], Column]) -> tuple[Column, Column]:
    return _decimal(g(2)), F.when(g(1) == "$", "usd_per_share").otherwise("eur_per_share")


def _quarter_value(g: Callable[[int], Column]) -> tuple[Column, Column]:
    digit = F.nullif(g(1), F.lit("")).cast("int")
    return F.coalesce(digit, _map(QUARTERS)[F.lower(g(2))]).cast("double"), F.lit("quarter")


def _plain_value(fixed: bool) -> Callable[[Callable[[int], Column]], tuple[Column, Column]]:
    """Money and other counts. Percentages have a reading of their own; 0 and years without any unit are no counts."""

    def read(g: Callable[[int], Column]) -> tuple[Column, Column]:
        sign, fraction, mag, money, percent = g(1), g(3), F.lower(g(4)), F.lower(g(5)), g(6)
        # Dots in the whole part separate thousands; so do commas in whole numbers read as `fixed`.
        digits = F.translate(g(2), ".," if fixed else ".", "")
        size = F.when(digits.rlike(r"^\d+$"), F.concat(digits, F.lit("."), fraction, F.lit("0")).cast("double"))
        alone = F.concat(fraction, mag, sign, money) == ""
        year = F.coalesce(g(2).rlike(r"^\d{1,15}$") & (size.between(1900, 2099) | (size == 0)), F.lit(False)) if not fixed else F.coalesce((F.length(digits) <= 15) & (size.between(1900, 2099) | (size == 0)), F.lit(False))
        value = size * F.coalesce(_map(MAGNITUDES)[mag], F.lit(1.0))
        # A dollar sign or word decides before the euro's, and that before other words; a magnitude alone means dollars.
        named = F.array(F.coalesce(_map(CURRENCY_SIGNS)[sign], F.lit("")), F.coalesce(_map(CURRENCY_WORDS)[money], F.lit("")))
        unit = F.coalesce(*[F.when(F.array_contains(named, u), u) for u in dict.fromkeys(CURRENCY_WORDS.values())], F.when(mag != "", "usd"), F.lit(""))
        return F.when((percent == "") & ~(alone & year) & (value > 0), value), unit

    return read


def extract_numbers(text: Column, fixed: bool = False) -> Column:
    """array<struct<value double, unit string>>: percentages, per-share values, other numbers, quarters; distinct, in that order."""
    readings = [
        (PERCENT, lambda g: (_decimal(g(1)), F.lit("%"))),
        (PER_SHARE, _share_value),
        (NUMBER_FIXED if fixed else NUMBER, _plain_value(fixed)),
        (QUARTER, _quarter_value),
    ]

    def entries(pattern: str, read: Callable) -> Column:
        def entry(match: Column) -> Column:
            value, unit = read(lambda k: F.regexp_extract(match, pattern, k))
            return F.struct(value.alias("value"), unit.alias("unit"))

        return F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), entry)

    return F.array_distinct(F.filter(F.concat(*[entries(p, r) for p, r in readings]), lambda e: e["value"].isNotNull()))


def short_decimal(v: Column) -> Column:
    """Six significant digits without trailing zeros; whole numbers without a point."""
    out = None
    size = F.abs(v)
    for e in range(-4, 6):
        digits = F.format_string(f"%.{5 - e}f", v)
        cut = F.regexp_replace(F.regexp_replace(digits, r"(\.\d*?)0+$", "$1"), r"\.$", "")
        low = size < 10.0 ** (e + 1) - 0.5 * 10.0 ** (e - 5)
        out = F.when(low, cut) if out is None else out.when(low, cut)
    return F.when(v == F.floor(v), v.cast("decimal(38,0)").cast("string")).otherwise(out.otherwise(v.cast("string")))


def _filled(form: str, **parts: Column) -> Column:
    """A form with {names} in place of columns."""
    return F.concat(*[parts[x[1]] if x.startswith("{") else F.lit(x) for x in re.split(r"(\{\w\})", form) if x])


def _by_unit(unit: Column, forms: dict[str, Column]) -> Column:
    out = None
    for u, c in forms.items():
        if u:
            out = F.when(unit == u, c) if out is None else out.when(unit == u, c)
    return out.otherwise(forms[""])


def surface_forms(value: Column, unit: Column) -> Column:
    """The ways in which an English source may write (value, unit): in the largest magnitude of which it has nine tenths, or plainly."""
    whole = value.cast("int")
    plain = {"x": short_decimal(value), "i": whole.cast("string"), "o": F.coalesce(_map(ORDINALS)[whole], whole.cast("string"))}
    plainly = _by_unit(unit, {u: F.array(*[_filled(f, **plain) for f in forms]) for u, forms in PLAIN_FORMS.items()})

    def scaled(scale: float, names: list[str]) -> Column:
        x = short_decimal(value / scale)
        forms = {u: F.array(*[_filled(f, x=x, n=F.lit(n)) for n in names for f in forms]) for u, forms in SCALED_FORMS.items()}
        return F.when((F.abs(value) >= 0.9 * scale) & ~unit.isin("%", "quarter"), _by_unit(unit, forms))

    return F.coalesce(*[scaled(s, names) for s, names in SCALES], plainly)


def number_matches(value: Column, unit: Column, source: Column) -> Column:
    """Whether a normalised source in lower case writes the number in one of its forms."""
    return F.exists(surface_forms(value, unit), lambda f: F.contains(source, F.lower(f)))
