"""Text expressions: tokens, clean-up, tickers, phrases, quotes, feed times."""

from __future__ import annotations

import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that hide text, by name of their range.
ZERO_WIDTH = "​‌‍﻿⁠"
BIDI = "‎‏‪‫‬‭‮⁦⁧⁨⁩"
#: Typographic quotes and dashes and their plain forms.
QUOTES = ("‘’‚‛“”„‟«»‹›", "''''\"\"\"\"\"\"''")
DASHES = ("–—―‒", "----")
#: Characters that a normalised text doesn't hold.
UNSEEN = "\u00ad\u200b\u200c\u200d\ufeff"
#: Words in capitals that aren't tickers.
COMMON_WORDS = ["Q1", "Q2", "Q3", "Q4", "EPS", "CEO", "CFO", "COO", "CTO", "AI", "ML", "IPO", "M&A", "US", "EU", "UK", "ECB", "FED", "GDP", "CPI", "PPI", "USD", "EUR"]
#: Advice that no fact may give, in order of precedence.
FORBIDDEN_BG = [
    "купете", "купувайте", "продайте", "продавайте", "препоръчваме", "препоръчва се", "препоръчвам", "добра възможност",
    "отлична възможност", "силна покупка", "силна продажба", "инвестирайте в", "вложете в", "целева цена от наше",
]
FORBIDDEN_EN = ["buy signal", "sell signal", "strong buy", "strong sell", "we recommend", "we advise", "we suggest", "good buying opportunity", "great opportunity to buy", "price target of our"]
#: Words that mark an opinion, in order of precedence.
OPINION_EN = [
    "analyst", "analysts", "expect", "expects", "expected", "we believe", "we think", "rating", "upgrade", "downgrade", "overweight", "underweight",
    "outperform", "underperform", "price target", "target price", "buy rating", "sell rating", "initiates coverage", "raises target", "lowers target",
]
OPINION_BG = [
    "анализатор", "анализатори", "анализаторите", "очаква", "очакват", "очакване", "очакванията", "рейтинг", "препоръчва", "препоръчват",
    "целева цена", "целева цена от", "повиши целевата", "намали целевата", "надгради", "понижи препоръката", "смятаме", "считаме",
]

SPACE_RUN = r"(?U)\s+"


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode compatibility normal form; Spark has no expression for it."""
    return pd.Series([unicodedata.normalize("NFKC", t) if isinstance(t, str) else None for t in text], dtype=object)


class _Visible(HTMLParser):
    """Collects the text that a reader would see."""

    #: Elements without an end tag.
    VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool]] = []
        self.text: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in self.VOID:
            a = dict(attrs)
            style = a.get("style") or ""
            hides = tag in ("script", "style") or a.get("aria-hidden") == "true" or ("display" in style and "none" in style)
            self.open.append((tag, hides or bool(self.open and self.open[-1][1])))

    def handle_endtag(self, tag: str) -> None:
        names = [t for t, _ in self.open]
        if tag in names:
            del self.open[len(names) - 1 - names[::-1].index(tag) :]

    def handle_data(self, data: str) -> None:
        if not (self.open and self.open[-1][1]):
            self.text.append(data)


@F.pandas_udf(T.StringType())
def visible_text(html: pd.Series) -> pd.Series:
    """Text nodes outside hidden elements, joined by a space; null stays null."""

    def one(raw: str | None) -> str | None:
        if not isinstance(raw, str):
            return None
        p = _Visible()
        p.feed(raw)
        p.close()
        return " ".join(p.text)

    return pd.Series([one(x) for x in html], dtype=object)


def collapsed(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE_RUN, " "))


def sanitize_html(html: Column) -> Column:
    """Plain visible text: no scripts, styles, hidden elements or comments, in NFKC, without invisible characters."""
    plain = nfkc(visible_text(F.coalesce(html, F.lit(""))))
    return collapsed(F.translate(plain, ZERO_WIDTH + BIDI, ""))


def strip_tags(html: Column) -> Column:
    """A rough form of sanitize_html by regular expressions alone, for markup without hidden elements."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</(script|style)\s*>", " "), r"(?s)<!--.*?-->", " ")
    return collapsed(F.regexp_replace(bare, r"<[^>]*>", " "))


def normalize_text(s: Column) -> Column:
    """Plain quotes and dashes, NFKC, no soft hyphens or zero-width characters, single spaces."""
    plain = F.translate(F.translate(s, *QUOTES), *DASHES)
    return collapsed(F.translate(nfkc(plain), UNSEEN, ""))


def tokenize(text: Column) -> Column:
    """Runs of a-z and 0-9 in lower case; other letters part words."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)


def best_text(clean: Column, summary: Column, title: Column) -> Column:
    """The first that is neither null nor empty; '' if none is."""
    return F.coalesce(F.nullif(clean, F.lit("")), F.nullif(summary, F.lit("")), title, F.lit(""))


def content_hash(title: Column, summary: Column) -> Column:
    return F.sha2(F.concat(F.coalesce(title, F.lit("")), F.lit("|"), F.coalesce(summary, F.lit(""))), 256)


def extract_tickers(text: Column) -> Column:
    """`$A` to `$ABCDE`, and two to five capitals that stand alone, but for common words; distinct."""
    marked = F.regexp_extract_all(text, F.lit(r"(?U)\$([A-Z]{1,5})\b"), 1)
    rest = F.regexp_replace(text, r"(?U)\$[A-Z]{1,5}\b", " ")
    bare = F.regexp_extract_all(rest, F.lit(r"(?U)(?<!\w)([A-Z]{2,5})(?!\w)"), 1)
    return F.array_except(F.array_distinct(F.concat(marked, bare)), F.array(*[F.lit(w) for w in COMMON_WORDS]))


def first_phrase(text: Column, phrases: list[str]) -> Column:
    """The first of `phrases` that `text` holds in lower case; null if none."""
    low = F.lower(text)
    return F.coalesce(*[F.when(F.contains(low, F.lit(p)), F.lit(p)) for p in phrases])


def advice_phrase(text: Column) -> Column:
    return first_phrase(text, FORBIDDEN_BG + FORBIDDEN_EN)


def opinion_marker(fact: Column, quotes: Column) -> Column:
    """A marker in the fact, or the first one in the quotes, quote by quote."""
    hits = F.transform(F.coalesce(quotes, F.array().cast("array<string>")), lambda q: first_phrase(q, OPINION_EN))
    return F.coalesce(first_phrase(fact, OPINION_BG), F.try_element_at(F.filter(hits, lambda h: h.isNotNull()), F.lit(1)))


def quote_start(text: Column, quote: Column) -> Column:
    """Where the quote starts, from 0; -1 if it isn't there as it is."""
    return F.instr(text, quote) - 1


def parse_feed_time(text: Column) -> Column:
    """An RFC-822 time as a UTC time without zone; null if it can't be read."""
    bare = F.regexp_replace(F.trim(text), r"^\w{3},\s*", "")
    zoned = F.regexp_replace(bare, r"\b(GMT|UTC|UT|Z)$", "+0000")
    east = F.regexp_replace(F.regexp_replace(zoned, r"\bEST$", "-0500"), r"\bEDT$", "-0400")
    at = F.try_to_timestamp(east, F.lit("d MMM yyyy HH:mm:ss Z"))
    return at.cast("timestamp_ntz")


def primary_ticker(tickers: Column) -> Column:
    return F.try_element_at(tickers, F.lit(1))


def nonempty(text: Column) -> Column:
    """Trimmed; null if nothing is left."""
    return F.nullif(F.trim(text), F.lit(""))


def strip_tags_sql(col: str) -> str:
    """strip_tags as DuckDB SQL."""
    bare = f"regexp_replace(regexp_replace(coalesce({col}, ''), '(?is)<(script|style)\\b.*?</(script|style)\\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g')"
    return f"trim(regexp_replace(regexp_replace({bare}, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))"
