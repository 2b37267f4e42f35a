"""Secret scans: assignment-aware lexing of text into name-literal pairs.

Base patterns (fixed) find assignments to five well-known names, access keys and long hex runs. The
lexer adds what they miss. It reads a text once, from left to right, with a stack of the containers that are open:

- Targets: `name =`, `name:`, `"name":`, `name :=`, `name =>`, `name: type =`, `<name>...</name>`; in comments too,
  where secrets leak as well.
- Values: quoted strings (with a prefix letter, if any) and concatenations of them and of names; strings in
  three quotes and heredocs over many lines; YAML block scalars; lists of strings; bare words.
- Containers: braces, brackets and parentheses; keys whose deeper lines follow (YAML); `[sections]` (INI, TOML). A name is known
  with its innermost containers' names: under `credentials:`, `value: x` is a credential's value.

Names are split into parts (snake, kebab, dotted, camel case), and literals scored by how sensitive
their target's name is, with a bonus for literals that look random. Constants are propagated: an assignment of
a plain name (`db_pass = K1`), a `$K1` / `${K1}` reference or a concatenation takes the values of the names it
refers to, assigned before or after, through any number of other names. A name means its latest
assignment before, else the first after, in the same container, or in up to OUTER enclosing ones, or anywhere.
How random a value looks is that of the best looking assignment it reaches; walks from the sensitive
targets over the graph of assignments mark each literal where it was written, and visit each assignment
once. Time and memory are in proportion to the text, however its names refer to each other.

Offsets count code points, ends exclusive. A span is the whole match for the base kinds, and the bytes
of the literal itself for the kind `named`, which is added unless a base span overlaps it.

Defined cases: a null or empty text has no spans; rows are scanned one by one, so repeated rows, null
ids and ties are all kept; an empty table gives an empty result; extra columns are ignored; a text of
any length is scanned whole, as a block of its own.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.bytegrid import Grid, blocks
from newsloom.llm.rows import numbered, numbered_schema, unnumbered
from newsloom.session import ship

#: Kinds in the order that breaks ties, the base pattern's names, and least lengths.
KINDS = ("assign", "access", "hex", "named")
NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}

#: How much each part of a name says that its value is secret.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "pass": 0.8, "passphrase": 1.0, "secret": 1.0, "token": 1.0,
    "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "cred": 0.8, "creds": 0.8, "privatekey": 1.0,
    "private": 0.4, "access": 0.3, "auth": 0.6, "bearer": 0.9, "signature": 0.5, "signing": 0.5, "salt": 0.5,
    "encryption": 0.5, "key": 0.5, "dsn": 0.5, "client": 0.1, "api": 0.5, "session": 0.3, "webhook": 0.4,
}
#: Name parts that say the value is a description, a size or a place, not the secret.
HARMLESS = {"name", "type", "length", "size", "count", "field", "label", "url", "path", "file", "prefix", "policy", "expiry", "ttl", "id", "hint", "public"}

#: Names of a key that only holds what its container's name says.
NEUTRAL = {"value", "val", "values", "data", "default", "content", "literal", "current", "raw", "plain", "plaintext", "string", "text"}

_LITERAL = rb"""(?:"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`)"""
_PART = rb"""[A-Za-z_][A-Za-z0-9_.\-]*+"""
#: A name is read from its first character, once, whatever its length.
_NAME = rb"""(?<![A-Za-z0-9_.\-])""" + _PART
_TYPE = rb"""[A-Za-z_&][A-Za-z0-9_.<>\[\]|& ]{0,60}"""
TOKEN = re.compile(
    rb"""(?P<line>\n[ \t]*(?:-[ \t]+)*)|(?P<section>(?:^|(?<=\n))\[[^\]\n]{1,200}\](?=[ \t\r]*(?:\n|$)))|(?P<open>[{\[(])|(?P<close>[}\])])|<(?P<tag>"""
    + _PART + rb""")>(?P<inner>[^<>\n]{1,4000})</|(?P<name>""" + _NAME + rb""")["'\]]{0,2}[ \t]*(?::[ \t]*""" + _TYPE + rb"""=(?![=>])|:=|=>|[:=](?![=:]))[ \t]*"""
)
_VALUE = re.compile(
    rb"""[fFrRbBuU@$]{0,2}(?P<quoted>(?:""" + _LITERAL + rb"""|""" + _PART + rb"""(?=[ \t]+\+[ \t]))(?:[ \t]*[+.][ \t]*(?:""" + _LITERAL + rb"""|""" + _PART + rb"""))*)|(?P<bare>[^\s"'`;,#{}()\[\]][^\s"'`;,{}()\[\]]*)"""
)
_TRIPLE = re.compile(rb"""[fFrRbBuU]{0,2}(?:\"\"\"(?P<a>(?:[^"\\]|\\.|"(?!""))*+)\"\"\"|\'\'\'(?P<b>(?:[^'\\]|\\.|'(?!''))*+)\'\'\')""", re.DOTALL)
_LIST = re.compile(rb"""\[\s*""" + _LITERAL + rb"""(?:\s*,\s*""" + _LITERAL + rb""")*+\s*,?\s*\]""")
_HEREDOC = re.compile(rb"""<<[-~]?["']?([A-Za-z_]\w*)["']?[^\n]*\n""")
_SCALAR = re.compile(rb"""[|>][-+0-9]{0,3}[ \t]*\n""")
_PIECE = re.compile(_LITERAL + rb"|" + _PART)
_REFERENCE = re.compile(rb"\$?\{?(" + _PART + rb")\}?$")
#: Enclosing containers in which a name is looked up, and whose names count.
OUTER = 8
_SPLIT = re.compile(r"[_.\-]+|(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")

HEX = np.zeros(256, bool)
HEX[list(b"0123456789abcdef")] = True


def name_score(name: str) -> float:
    """0 to 1: how likely a value assigned to this name is secret."""
    parts = [p.lower() for p in _SPLIT.split(name) if p]
    joined = "".join(parts)
    score = max([0.0, *(SENSITIVE.get(p, 0.0) for p in parts)])
    score += 0.5 * (sum(SENSITIVE.get(p, 0.0) for p in parts) - score)  # "api key", "access key", "client secret"
    score = max([score, *(v for k, v in SENSITIVE.items() if v >= 0.9 and joined.endswith(k))])
    return 0.0 if parts and parts[-1] in HARMLESS else min(1.0, score)


def literal_score(value: bytes) -> float:
    """0 to 1: how random a literal looks, by its characters' entropy and the mix of classes."""
    if len(value) < 6 or len(set(value)) < 4 or b" " in value:
        return 0.0
    n = len(value)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    classes = sum(bool(re.search(p, value)) for p in (rb"[a-z]", rb"[A-Z]", rb"[0-9]", rb"[^A-Za-z0-9]"))
    return min(1.0, 0.15 * entropy + 0.15 * classes)


def _unquoted(at: int, piece: bytes) -> tuple[int, int, bytes]:
    return (at + 1, at + len(piece) - 1, piece[1:-1]) if piece[:1] in b"\"'`" and len(piece) >= 2 else (at, at + len(piece), piece)


Literal = tuple[int, int, bytes]


@dataclass
class Pair:
    """An assignment: its target's name and containers' names, what it is assigned, and whether a constant replaces its literals."""

    name: bytes
    within: tuple[bytes, ...]
    scopes: tuple[int, ...]
    literals: list[Literal]
    names: list[bytes]
    replaced: bool = False


class _Lines:
    """Lines by their first word, to find where a heredoc ends; made once for a text that holds one."""

    def __init__(self, text: bytes):
        self.at: dict[bytes, list[int]] = {}
        for m in re.finditer(rb"^[ \t]*([A-Za-z_]\w*)[ \t\r]*$", text, re.MULTILINE):
            self.at.setdefault(m[1], []).append(m.start())

    def end(self, tag: bytes, at: int) -> int | None:
        places = self.at.get(tag, [])
        k = bisect_left(places, at)
        return places[k] if k < len(places) else None


def _deeper(text: bytes, at: int, indent: int) -> int:
    """The end of the lines from `at` on that are blank or indented by more than `indent`."""
    end = at
    while at < len(text):
        stop = text.find(b"\n", at)
        stop = len(text) if stop < 0 else stop
        line = text[at:stop]
        bare = line.lstrip(b" \t")
        if bare.strip() and len(line) - len(bare) <= indent:
            break
        at = min(stop + 1, len(text))
        end = stop
    return end


def lexed(text: bytes) -> list[Pair]:
    """The assignments of a text, in its order."""
    out: list[Pair] = []
    lines: _Lines | None = None
    # An open container: whether a bracket closes it, its lines' indent, its name, its number.
    stack: list[tuple[bool, int, bytes, int]] = [(True, -1, b"", 0)]
    opened, indent, pos = 0, 0, 0

    def push(by_bracket: bool, name: bytes) -> None:
        nonlocal opened
        opened += 1
        stack.append((by_bracket, indent, name, opened))

    def add(name: bytes, literals: list[Literal], names: list[bytes], replaced: bool = False) -> None:
        near = stack[-OUTER:]
        out.append(Pair(name, tuple(x[2] for x in near if x[2]), tuple(x[3] for x in near), literals, names, replaced))

    while m := TOKEN.search(text, pos):
        pos, kind = m.end(), m.lastgroup
        if kind == "line":
            indent = m.end() - m.start() - 1
            while not stack[-1][0] and indent <= stack[-1][1]:
                stack.pop()
        elif kind == "section":
            del stack[1:]
            push(False, m["section"][1:-1].strip(b" []\"'"))
            stack[-1] = (False, -1, *stack[-1][2:])
        elif kind == "open":
            push(True, b"")
        elif kind == "close":
            while len(stack) > 1 and not stack[-1][0]:
                stack.pop()
            if len(stack) > 1:
                stack.pop()
        elif kind == "inner":
            s, e = m.span("inner")
            add(m["tag"], [(s, e, m["inner"])], [])
        else:
            name, next_ = m["name"], text[pos : pos + 1]
            if next_ in (b"", b"\n", b"\r"):
                push(False, name)
            elif (v := _TRIPLE.match(text, pos)) is not None:
                s, e = v.span("a") if v["a"] is not None else v.span("b")
                add(name, [(s, e, text[s:e])], [])
                pos = v.end()
            elif (v := _LIST.match(text, pos)) is not None:
                add(name, [_unquoted(p.start(), p[0]) for p in _PIECE.finditer(text, *v.span())], [])
                pos = v.end()
            elif next_ in b"{[(":
                push(True, name)
                pos += 1
            elif (v := _SCALAR.match(text, pos)) is not None:
                e = _deeper(text, v.end(), indent)
                s = min(e, v.end() + len(text[v.end() : e]) - len(text[v.end() : e].lstrip()))
                add(name, [(s, e, b"\n".join(x.strip() for x in text[s:e].split(b"\n")))], [])
                pos = max(e, v.end() - 1)
            elif (v := _HEREDOC.match(text, pos)) is not None and (e := (lines := lines or _Lines(text)).end(v[1], v.end())) is not None:
                s, e = v.end(), max(v.end(), e - 1)
                add(name, [(s, e, text[s:e])], [])
                pos = e
            elif (v := _VALUE.match(text, pos)) is not None:
                literals, names = [], []
                if v["quoted"] is not None:
                    for p in _PIECE.finditer(text, *v.span("quoted")):
                        if p[0][:1] in b"\"'`":
                            literals.append(_unquoted(p.start(), p[0]))
                        else:
                            names.append(p[0])
                else:
                    s = v.start("bare")
                    value = v["bare"].rstrip(b".")
                    if ref := _REFERENCE.match(v["bare"]):
                        names.append(ref[1])
                    if value:
                        literals.append((s, s + len(value), value))
                add(name, literals, names, v["quoted"] is None)
                pos = v.end()
    return out


def sources(pairs: list[Pair]) -> list[list[int]]:
    """For each assignment, those that its names stand for."""
    places: dict[tuple[int, bytes], list[int]] = {}
    for i, p in enumerate(pairs):
        for scope in (p.scopes[-1], -1):  # its own container, and anywhere
            places.setdefault((scope, p.name), []).append(i)
        if p.within:
            places.setdefault((-1, b".".join((p.within[-1], p.name))), []).append(i)

    def of(i: int, name: bytes) -> int | None:
        for scope in (*reversed(pairs[i].scopes), -1):
            at = places.get((scope, name))
            if at is None:
                continue
            k = bisect_left(at, i)
            if k:
                return at[k - 1]
            later = at[k + 1 : k + 2] if at[k] == i else at[k : k + 1]
            if later:
                return later[0]
        return None

    return [[k for k in (of(i, x) for x in p.names) if k is not None] for i, p in enumerate(pairs)]


def pair_score(pair: Pair) -> float:
    """The score of the target's name; one that says nothing takes its container's."""
    name = pair.name.decode("ascii", "ignore")
    if pair.within and name.lower() in NEUTRAL:
        return name_score(pair.within[-1].decode("ascii", "ignore"))
    return name_score(name)


def named_spans(text: bytes, least: float = 0.75) -> list[tuple[int, int]]:
    """Byte spans of literals that reach a sensitive name, directly or by constants."""
    pairs = lexed(text)
    graph = sources(pairs)
    own = [[] if p.replaced and graph[i] else [x for x in p.literals if x[2]] for i, p in enumerate(pairs)]
    looks = [literal_score(b"".join(x[2] for x in found)) if found else -1.0 for found in own]
    users: list[list[int]] = [[] for _ in pairs]
    for i, to in enumerate(graph):
        for k in to:
            users[k].append(i)
    # The best look first: whatever can reach it gets it, and is settled.
    best = [-1.0] * len(pairs)
    for i in sorted(range(len(pairs)), key=lambda i: -looks[i]):
        if looks[i] < 0:
            break
        todo = [i]
        while todo:
            k = todo.pop()
            if best[k] < 0:
                best[k] = looks[i]
                todo += users[k]
    scores: dict[tuple[bytes, bytes], float] = {}
    marked = [False] * len(pairs)
    todo = []
    for i, p in enumerate(pairs):
        key = (p.name, p.within[-1] if p.within else b"")
        if key not in scores:
            scores[key] = pair_score(p)
        if best[i] >= 0 and scores[key] and scores[key] * 0.6 + 0.4 * best[i] >= least:
            todo.append(i)
    while todo:
        i = todo.pop()
        if not marked[i]:
            marked[i] = True
            todo += graph[i]
    return sorted({(s, e) for i, m in enumerate(marked) if m for s, e, _ in own[i]})


def _hex_runs(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    on = HEX[buf]
    edge = np.flatnonzero(on[1:] != on[:-1]) + 1
    edge = np.concatenate([[0], edge]) if len(on) and on[0] else edge
    s, e = edge[0::2], edge[1::2]  # the last byte of a grid is a newline, so each run has an end
    long = e - s >= LEAST["hex"]
    return s[long], e[long]


def scan(texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) in code points for each text, sorted."""
    grid = Grid(texts)
    raw, low = grid.raw, grid.raw.lower()
    spans: list[tuple[int, int, int]] = []
    starts = sorted({m.start() for name in NAMES for m in re.finditer(name, low)})
    last = 0
    for at in starts:
        if at >= last and (m := ASSIGN.match(raw, at)):
            last = m.end()
            if len(m[2]) >= LEAST["assign"]:
                spans.append((m.start(), 0, m.end()))
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(raw) if m.end() - m.start() >= LEAST["access"]]
    spans += [(int(s), 2, int(e)) for s, e in zip(*_hex_runs(grid.buf), strict=True)]
    by_doc: dict[int, list[tuple[int, int, int]]] = {}
    for s, d in zip(spans, np.searchsorted(grid.end, [s[0] for s in spans]).tolist(), strict=True):
        by_doc.setdefault(d, []).append(s)

    # The lexer reads the texts that hold an operator next to a name at all.
    maybe = np.flatnonzero((grid.buf == 61) | (grid.buf == 58))
    points = grid.points()
    for d in np.unique(np.searchsorted(grid.end, maybe)).tolist():
        base, at = by_doc.get(d, []), int(grid.start[d])
        for s, e in named_spans(texts[d]):
            if not any(b[0] < at + e and at + s < b[2] for b in base):
                by_doc.setdefault(d, []).append((at + s, 3, at + e))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for d, found in by_doc.items():
        zero = points[grid.start[d]]
        out[d] = sorted((int(points[s] - zero), k, int(points[e] - zero)) for s, k, e in found)
    return out


SPANS = "array<struct<kind: string, start: long, end: long>>"


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch, texts in blocks(batches):
        found = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in x] for x in scan(texts)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["doc_id", "spans"])


def secret_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): each row's spans, sorted by start, then kind."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_spans, f"doc_id long, spans {SPANS}")


def secret_digest(docs: DataFrame) -> DataFrame:
    """Counts by base kind, a hash of the base spans, and all spans as one string."""
    spans = secret_spans(docs)
    said = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "named")
    return spans.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def _redact(text: int, mark: bytes):
    """Rows with numbered columns -> the rows with every span of column `text` replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, text=f"c{text}"):
            columns = list(batch.columns)
            out: list[bytes | None] = []
            for raw, spans, there in zip(texts, scan(texts), columns[text].is_valid().to_pylist(), strict=True):
                said, pieces, last = raw.decode(), [], 0
                for s, _, e in spans:
                    if e > last:
                        pieces.append(said[last : max(s, last)].encode() + mark)
                        last = e
                out.append(b"".join(pieces) + said[last:].encode() if there else None)
            columns[text] = pa.array(out, pa.binary()).cast(columns[text].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return run


def redacted(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """`docs` with every span of text replaced by `mark`; other columns, of types that Arrow can carry, unchanged."""
    flat, text = numbered(docs), docs.columns.index("text")
    return flat.mapInArrow(_redact(text, mark.encode()), T.StructType(numbered_schema(docs))).select(*unnumbered(docs))
