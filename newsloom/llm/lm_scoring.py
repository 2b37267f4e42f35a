"""LM scoring by gated logistic context mixing, beside an add-one unigram base.

Tokens are words (A-Z lower-cased) and one end per document. One table holds every distinct word of all
documents once, with its count in the documents learned from (0 for words of others alone) and what its
bytes after the first cost. The FREQUENT most frequent words, a bounded table, are broadcast and looked
up where the text is; all other words go by rows (document, word, times) to the table, and their sums
come back to the document. Texts don't move.

The model reads the words, a space after each, and a newline as the end, as a sequence of bits: bytes
are coded along a Huffman tree of the corpus's byte counts (every byte has a code), so a frequent byte
takes few decisions. Four predictors guess each bit from hashed contexts. For a word's first byte:
none, the previous word's last two bytes, the previous word, the previous two. For the others: the last
two, three and five bytes of the word, and the word so far. A predictor is a table of how
often 0 and 1 came in the context, counted over all documents learned from and added up across tasks. A
logistic mixer combines the guesses (in the logistic domain) with weights that a gate picks by how much
the longer contexts have seen, for first bytes and others apart; a map by tree node and by the mean of the guesses
then refines the mix. Mixer and map are fitted on every bit of all documents learned from, its own count taken out of the
tables first: tasks count zeros and ones by gate and rounded guesses, a histogram of fixed size that is added up over
tasks, and each gate's weights are those that code its counts in the fewest bits. They don't depend on how rows are
dealt, and when texts are scored they stay fixed, so that a text's score
doesn't depend on the rows around it. After a word's first byte contexts lie inside the word, so counts
and cost follow from the word alone: these bytes are read from the table of words, each word once with
its count as the weight, and only first bytes are read from the texts. All bytes of a block go down the
tree together.

Those tables are of fixed size. What grows with the corpus is a table of passages: a text is cut at
content-chosen places, where the hash of the last two words is 0 modulo SPACING, so that equal passages
are cut alike; a passage is the words from one cut to the next, the last with the end. For each lead, the
LEAD words before a cut, the table holds every passage that followed it in the documents learned from, with
its count. A bit before each passage says whether it is the most frequent one that the lead's other
occurrences had (in other documents: a document's own are taken out); if so, nothing is spelled, if not,
the words are spelled as above. (A document that is learned from and has a lead with different passages
spells them, since its own share can't be taken out.) The chance of the bit is that of its class (how often
the likeliest and the other passages were seen), counted over all documents learned from. The table is
dealt by lead to as many tasks as the corpus's size asks for. Each task sums counts, combined by block
beforehand, and then answers the texts' cuts as they stream by; only leads known from elsewhere are
answered, others cost nothing. So a document whose like is in the corpus is scored apart.

score = -bits * log10(2); bits_per_byte = bits / bytes read (spaces and end included).

Defined cases: a null or empty text has one token, the end; a null doc_id isn't held out; repeated rows
get the same scores each; if nothing is learned from, N = V = 0 and the model is uniform; an empty table
gives an empty result; extra columns are ignored. Words are told apart by 64-bit hashes, leads and passages by 32-bit
hashes inside a part.
"""

from __future__ import annotations

import functools
import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from newsloom.llm.bytegrid import LOWER, Grid, blocks, ids, longs, mix, span_sums
from newsloom.llm.rows import ordered_id, remainder, row_key, shown_id
from newsloom.session import freed, ship, staged, unstaged

FREQUENT = 1 << 17
#: Binary logarithms of the slots of each predictor's table.
SLOT_BITS = (16, 18, 20, 21)
CONTEXTS = len(SLOT_BITS)
PART = 1 << 16
PARTS = "part int, zeros binary, ones binary"
#: Most tables that one sum of the first of two levels reads.
FANIN = 64
#: Texts of about so many bytes are counted at once.
COUNT_BYTES = 1 << 20
#: And searched for distinct words.
WORDS_BYTES = 4 << 20
#: And scored.
SCORE_BYTES = 1 << 19
#: Gates and map rows of a word's first byte come after those of the others.
KIND, NODES, BINS = 4 * 4 * 4, 256, 57
GATES = 2 * KIND
#: A guess's levels where bits are counted for the mixer, each STEP sixteenths wide: CONTEXTS levels of four bits name a place in a gate's part.
LEVELS, STEP = 15, 17
#: The end's name among word names; no word hashes to it but by chance.
END = 1
#: One word in so many, on average, ends with a cut.
SPACING = 4
#: A passage is guessed from so many words before it, fewer at a text's start.
LEAD = 4
#: About so many cuts are looked up in one task.
CUTS = 1_500_000
#: From how many on a passage's count, and that of all others, falls into the next class.
LIKELIEST = np.array([2, 3, 5, 9, 17])
OTHERS = np.array([1, 2, 3, 5, 9, 17])
CLASSES = (len(LIKELIEST) + 1) * (len(OTHERS) + 1)
CUT_ROWS = "part int, kind int, lead binary, passage binary, n binary, doc binary, place binary"
#: Confidence classes by how often a context was seen.
SEEN = np.array([1, 4, 24])


def held_out(modulus: int = 7, slot: int = 2):
    return F.coalesce(remainder(modulus) == slot, F.lit(False))


def stretch(p: np.ndarray) -> np.ndarray:
    return np.log(p) - np.log1p(-p)


def squash(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-z))


# ---- words ----


def _gathered(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the bytes data[s:e] of each span, one after another; where each ends)."""
    size = e - s
    end = np.cumsum(size)
    return data[np.arange(int(end[-1]) if len(end) else 0) + np.repeat(s - (end - size), size)], end


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, word, n): the distinct words of each block, n of them in texts learned from; the end as an empty word."""
    for batch, texts in blocks(batches, size=WORDS_BYTES):
        learned = ~batch.column(batch.schema.get_field_index("held_out")).to_numpy(zero_copy_only=False).astype(bool)
        grid, h = _named(texts)
        name, at, word = np.unique(h, return_index=True, return_inverse=True)
        n = np.bincount(word, weights=learned[grid.wdoc], minlength=len(name)).astype(np.int64)
        data, end = _gathered(LOWER[grid.buf], grid.ws[at], grid.we[at])
        bounds = np.concatenate([[0], end, end[-1:] if len(end) else [0]]).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(name) + 1, [None, pa.py_buffer(bounds), pa.py_buffer(data)]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([longs(np.append(name, np.uint64(END))), words, pa.array(np.append(n, learned.sum()))], ["name", "word", "n"])


def _words_of(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list[pa.RecordBatch], np.ndarray, np.ndarray, np.ndarray]]:
    """Batches of the table of words together, up to about `size` bytes: (batches, bytes, where each word starts, ends)."""
    held, much = [], 0

    def joined() -> tuple[list[pa.RecordBatch], np.ndarray, np.ndarray, np.ndarray]:
        words = pa.concat_arrays([b.column(b.schema.get_field_index("word")).cast(pa.large_binary()) for b in held])
        bounds = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
        return held, data, bounds[:-1], bounds[1:]

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            much += batch.nbytes
        if much > size:
            yield joined()
            held, much = [], 0
    if held:
        yield joined()


def _column(held: list[pa.RecordBatch], name: str) -> np.ndarray:
    return np.concatenate([b.column(b.schema.get_field_index(name)).to_numpy(zero_copy_only=False) for b in held])


def _byte_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(byte, n): how often each byte comes in the texts learned from, as the model reads them."""
    byte = np.zeros(256)
    for held, data, s, e in _words_of(batches, WORDS_BYTES):
        c = _column(held, "c")
        read, _ = _gathered(data, s, e)
        byte += np.bincount(read, weights=np.repeat(c, e - s), minlength=256)
        byte[32] += c[e > s].sum()
        byte[10] += c[e == s].sum()
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(byte.astype(np.int64))], ["byte", "n"])


@dataclass
class Unigrams:
    """The most frequent words, their counts and what their bytes after the first cost; N and V of all."""

    names: np.ndarray
    counts: np.ndarray
    nats: np.ndarray
    tokens: int
    distinct: int

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(whether it is a frequent word, its count, its cost)."""
        if not len(self.names):
            return np.zeros(len(h), bool), np.zeros(len(h), np.int64), np.zeros(len(h))
        at = np.minimum(np.searchsorted(self.names, h), len(self.names) - 1)
        hit = self.names[at] == h
        return hit, np.where(hit, self.counts[at], 0), np.where(hit, self.nats[at], 0.0)

    def summed(self, grid: Grid, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """All tokens of a grid (names, texts, whether frequent, costs), and for each text how many there are, how many known, and the base of the frequent ones."""
        norm = np.log10(self.tokens + self.distinct + 1)
        h = np.concatenate([h, np.full(grid.n, END, np.uint64)])
        of = np.concatenate([grid.wdoc, np.arange(grid.n)])
        hit, c, rest = self.look_up(h)
        n = grid.per_doc(of)
        known = np.bincount(of[c > 0], minlength=grid.n).astype(np.int64)
        return h, of, hit, rest, n, known, np.bincount(of, weights=np.log10(c + 1), minlength=grid.n) - n * norm


# ---- passages ----


@dataclass
class Passages:
    """The passages of a block that follow a cut, in text order."""

    doc: np.ndarray
    place: np.ndarray  # its number in its text
    lead: np.ndarray  # the words before
    name: np.ndarray  # its words
    of: np.ndarray  # for each token (words, then ends): its passage, -1 before a text's first cut


def passages(grid: Grid, h: np.ndarray) -> Passages:
    n = len(h)
    last = np.repeat(grid.whi, grid.whi - grid.wlo)
    before = np.arange(n) - np.repeat(grid.wlo, grid.whi - grid.wlo)
    two = np.zeros(n, np.uint64)
    two[1:] = mix(h[1:] + np.uint64(3) * h[:-1], 81)
    after = np.flatnonzero((before > 0) & (two % np.uint64(SPACING) == 0))  # a cut comes after these words
    lead = two[after]
    for k in range(2, LEAD):
        lead = mix(lead, 87) + np.where(before[after] >= k, h[np.maximum(after - k, 0)], np.uint64(0)) if len(after) else lead
    lead = mix(lead, 88)
    doc, end = grid.wdoc[after], last[after]
    follow = np.append(after[1:], n) if len(after) else after
    to = np.minimum(follow + 1, end)  # a text's last passage ends with the text
    name = mix(span_sums(h, after + 1, to, 82) + np.uint64(2) * (to - after).astype(np.uint64) + (follow + 1 > end), 83)
    first = np.searchsorted(doc, np.arange(grid.n))
    count = np.bincount(doc, minlength=grid.n)
    at = np.searchsorted(after, np.arange(n), "left") - 1
    known = np.maximum(at, 0)
    inner = np.where((at >= 0) & (doc[known] == grid.wdoc), at, -1) if len(after) else np.full(n, -1)
    return Passages(doc, np.arange(len(after)) - first[doc], lead, name, np.concatenate([inner, np.where(count > 0, first + count - 1, -1)]))


def _grouped(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order that sorts rows by keys, where in it each distinct row starts)."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    return order, np.flatnonzero(new)


def _cut_rows(parts: int):
    """For each block and part: the counts of passages by lead (kind 0), and the texts' passages to be answered (kind 1)."""

    def dealt(part: np.ndarray, kind: int, *columns: np.ndarray | None) -> pa.RecordBatch:
        cut = np.flatnonzero(np.diff(part, prepend=-1))
        bounds = np.append(cut, len(part)).astype(np.int32)
        blob = lambda x: pa.BinaryArray.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(bounds * np.int32(x.itemsize)), pa.py_buffer(np.ascontiguousarray(x))])
        got = [pa.nulls(len(cut), pa.binary()) if x is None else blob(x) for x in columns]
        return pa.RecordBatch.from_arrays([pa.array(part[cut].astype(np.int32)), pa.array(np.full(len(cut), kind, np.int32)), *got], ["part", "kind", "lead", "passage", "n", "doc", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, size=WORDS_BYTES):
            learned = ~batch.column(batch.schema.get_field_index("held_out")).to_numpy(zero_copy_only=False).astype(bool)
            row = ids(batch, "name").view(np.uint64)
            p = passages(*_named(texts))
            if not len(p.doc):
                continue
            part = ((p.lead >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
            lead, name = p.lead.astype(np.uint32), p.name.astype(np.uint32)
            both = lead.astype(np.uint64) << np.uint64(32) | name
            order, start = _grouped(part, both, p.doc)
            own = np.zeros(len(order), np.uint32)  # how often the text itself has it, if it is learned from
            size = np.diff(np.append(start, len(order)))
            own[order] = np.repeat(size, size) * learned[p.doc[order]]
            one = order[start]  # each passage of a lead once for each text
            _, of_lead, n = np.unique(mix(p.lead[one], 84) ^ p.doc[one].astype(np.uint64), return_inverse=True, return_counts=True)
            ask = order[np.repeat((n[of_lead] == 1) | ~learned[p.doc[one]], size)]
            if len(ask):
                yield dealt(part[ask], 1, lead[ask], name[ask], own[ask], row[p.doc[ask]], p.place[ask].astype(np.uint32))
            take = order[learned[p.doc[order]]]
            if len(take):
                b = both[take]
                start = np.flatnonzero(np.append(True, (b[1:] != b[:-1]) | (part[take[1:]] != part[take[:-1]])))
                at, n = take[start], np.diff(np.append(start, len(take))).astype(np.int64)
                yield dealt(part[at], 0, lead[at], name[at], n, None, None)

    return run


def _summed_leads(both: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order, start = _grouped(both)
    return both[order[start]], np.add.reduceat(n[order], start) if len(start) else n


@dataclass
class Followers:
    """A part's table of passages: each (lead, passage) with its count; each lead's total and two likeliest passages."""

    both: np.ndarray
    n: np.ndarray

    def __post_init__(self) -> None:
        lead = self.both >> np.uint64(32)
        order = np.lexsort((self.both, -self.n, lead))
        start = np.flatnonzero(np.append(True, lead[order[1:]] != lead[order[:-1]])) if len(order) else order
        size = np.diff(np.append(start, len(order)))
        self.lead = lead[order[start]]
        self.total = np.add.reduceat(self.n[order], start) if len(start) else self.n
        self.top, self.top_n = self.both[order[start]], self.n[order[start]]
        other = order[np.minimum(start + 1, len(order) - 1)]
        self.next, self.next_n = self.both[other], np.where(size > 1, self.n[other], 0)

    def classes(self, both: np.ndarray, own: np.ndarray) -> np.ndarray:
        """-1 for a lead that no other text has; else twice its class, plus 1 if this passage is the likeliest."""
        out = np.full(len(both), -1)
        if not len(self.both):
            return out
        lead = both >> np.uint64(32)
        at = np.minimum(np.searchsorted(self.lead, lead), len(self.lead) - 1)
        here = np.minimum(np.searchsorted(self.both, both), len(self.both) - 1)
        n = np.where(self.both[here] == both, self.n[here], 0) - own
        total = np.where(self.lead[at] == lead, self.total[at], 0) - own
        is_top = self.top[at] == both
        rival, rival_n = np.where(is_top, self.next[at], self.top[at]), np.where(is_top, self.next_n[at], self.top_n[at])
        hit = (n > rival_n) | ((n == rival_n) & (both < rival))
        most = np.maximum(n, rival_n)
        kind = np.searchsorted(LIKELIEST, most, "right") * (len(OTHERS) + 1) + np.searchsorted(OTHERS, total - most, "right")
        return np.where(total > 0, 2 * kind + hit, out)


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, place, class, learned) of the passages whose lead is known from elsewhere.

    A part's counts come before its cuts. Counts are summed as they come, so that what is held is the
    part's distinct passages, however often they were met.
    """
    now, table, held, much = None, None, [], 0

    def settle() -> None:
        nonlocal held, much
        if len(held) > 1:
            held = [_summed_leads(*(np.concatenate(x) for x in zip(*held, strict=True)))]
        much = 0

    for batch in batches:
        got = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        for i, (part, kind) in enumerate(zip(got["part"].to_pylist(), got["kind"].to_pylist(), strict=True)):
            read = lambda name, t: np.frombuffer(got[name][i].as_buffer(), t)  # noqa: B023, E731
            if part != now:
                now, table, held, much = part, None, [], 0
            both = read("lead", np.uint32).astype(np.uint64) << np.uint64(32) | read("passage", np.uint32)
            if kind == 0:
                held.append((both, read("n", np.int64)))
                much += len(both)
                if much > CUTS and much > len(held[0][0]):
                    settle()
                continue
            if table is None:
                settle()
                table = Followers(*(held[0] if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))))
            own = read("n", np.uint32).astype(np.int64)
            kind = table.classes(both, own)
            go = np.flatnonzero(kind >= 0)
            if len(go):
                yield pa.RecordBatch.from_arrays(
                    [longs(read("doc", np.uint64)[go]), pa.array(read("place", np.uint32)[go].astype(np.int64)), pa.array(kind[go].astype(np.int32)), pa.array(own[go] > 0)], ["name", "place", "class", "learned"]
                )


def chances(hits: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Each class's chance that the likeliest passage comes, drawn to what its counts alone say where little was seen."""
    most, others = np.append(1, LIKELIEST)[:, None], np.append(0, OTHERS)[None, :]
    prior = ((most + 0.4) / (most + others + 0.8)).ravel()
    return np.clip((hits + 2 * prior) / (n + 2), 1e-4, 1 - 1e-4)


# ---- bits ----


@dataclass
class Bytes:
    """Bytes to predict, each with the hashes of its contexts (a column for each predictor).

    `weight` says how often each byte comes, `owner` which word or token it belongs to, `first` whether
    these are first bytes of words.
    """

    data: np.ndarray
    context: np.ndarray
    owner: np.ndarray
    weight: np.ndarray
    first: bool = False

    def only(self, which: np.ndarray) -> "Bytes":
        return Bytes(self.data[which], self.context[which], self.owner[which], self.weight[which], self.first)


@dataclass
class Tokens:
    """The tokens of a block: words in text order, then one end for each text."""

    first: Bytes  # one byte for each token; a token's owner is its text
    rest: Bytes  # the other bytes of each distinct word, a space as the last
    word: np.ndarray  # the distinct word of each word token
    doc: np.ndarray  # its text
    read: np.ndarray  # bytes of each text


def _spread(h: np.ndarray, salt: int) -> np.ndarray:
    return (mix(h, salt) >> np.uint64(32)).astype(np.uint32)


def first_bytes(grid: Grid, h: np.ndarray) -> Bytes:
    """The first byte of each word, then each text's end, given the words before in the same text."""
    low, n = LOWER[grid.buf], len(h)
    text = np.concatenate([grid.wdoc, np.arange(grid.n)])
    data = np.concatenate([low[grid.ws], np.full(grid.n, 10, np.uint8)])
    before = np.concatenate([np.arange(n) - 1, grid.whi - 1])  # the word before each token
    has1, has2 = before >= grid.wlo[text], before - 1 >= grid.wlo[text]
    one, two = np.maximum(before, 0), np.maximum(before - 1, 0)
    none = np.zeros(len(text), np.uint64)
    w1 = np.where(has1, h[one], none) if n else none
    w2 = np.where(has2, h[two], none) if n else none
    tail = np.where(has1, low[grid.we[one] - 1].astype(np.uint64) * np.uint64(256) + low[np.maximum(grid.we[one] - 2, 0)], none) if n else none
    c = np.stack([_spread(none, 70), _spread(tail, 72), _spread(w1, 73), _spread(w1 * np.uint64(3) + w2, 74)], axis=1)
    return Bytes(data, c, text, np.ones(len(text), np.int64), True)


def other_bytes(buf: np.ndarray, s: np.ndarray, e: np.ndarray, times: np.ndarray) -> Bytes:
    """The bytes after the first of each lower-cased word buf[s:e], a space as the last."""
    size = e - s + 1  # with the space
    end = np.cumsum(size)
    begin = np.repeat(end - size, size)
    place = np.arange(len(begin)) - begin
    data = buf[np.minimum(np.repeat(s, size) + place, len(buf) - 1)]
    data[end - 1] = 32
    owner = np.repeat(np.arange(len(s)), size)
    value = mix(data.astype(np.uint64) + (np.minimum(place, 63).astype(np.uint64) << np.uint64(8)), 61)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value)])
    so_far = sums[:-1] - sums[begin]
    cs, x, padded = [], np.zeros(len(data), np.uint64), np.concatenate([np.zeros(6, np.uint64), data.astype(np.uint64)])
    for k in range(1, 6):
        x = x * np.uint64(257) + np.where(place >= k, padded[6 - k : 6 - k + len(data)] + np.uint64(1), np.uint64(0))
        if k in (2, 3, 5):
            cs.append(_spread(x, 64 + k))
    go = place > 0
    c = np.stack([*cs, _spread(so_far, 62)], axis=1)[go]
    return Bytes(data[go], c, owner[go], times[owner[go]])


def bytes_read(grid: Grid) -> np.ndarray:
    """Bytes that the model reads of each text: its words, a space after each, and the end."""
    return np.bincount(grid.wdoc, weights=grid.we - grid.ws + 1, minlength=grid.n).astype(np.int64) + 1


def tokens(grid: Grid, h: np.ndarray) -> Tokens:
    """All bytes that the model reads of a grid whose words are named by h; a distinct word's other bytes come once."""
    _, at, word, times = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    rest = other_bytes(LOWER[grid.buf], grid.ws[at], grid.we[at], times)
    return Tokens(first_bytes(grid, h), rest, word, grid.wdoc, bytes_read(grid))


@dataclass
class Code:
    """A Huffman tree over bytes: for depth d, node[d] and bit[d] by byte; length by byte."""

    length: np.ndarray
    node: np.ndarray
    bit: np.ndarray

    @staticmethod
    def of(counts: np.ndarray) -> "Code":
        heap = [(int(c) + 1, b, (b,)) for b, c in enumerate(counts)]
        heapq.heapify(heap)
        paths: list[list[tuple[int, int]]] = [[] for _ in range(256)]
        inner = 0
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for bit, side in ((0, a[2]), (1, b[2])):
                for x in side:
                    paths[x].append((inner, bit))
            heapq.heappush(heap, (a[0] + b[0], 256 + inner, a[2] + b[2]))
            inner += 1
        length = np.array([len(p) for p in paths])
        node, bit = np.zeros((length.max(), 256), np.uint8), np.zeros((length.max(), 256), np.uint8)
        for x, p in enumerate(paths):
            for d, (k, y) in enumerate(reversed(p)):
                node[d, x], bit[d, x] = k, y
        return Code(length, node, bit)


_NODE_HASH = (np.arange(256, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32)
_SHIFT = np.array([32 - b for b in SLOT_BITS], np.uint32)
_OFFSET = np.concatenate([[0], np.cumsum([1 << b for b in SLOT_BITS])])
SLOTS = int(_OFFSET[-1])


def decisions(b: Bytes, code: Code) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each tree depth: the bytes still undecided, their nodes, bits, and table slots (bytes x predictors)."""
    c, offset = b.context, _OFFSET[:-1].astype(np.uint32)
    at, data = np.arange(len(b.data), dtype=np.int32), b.data
    length = code.length[data]
    for d in range(len(code.node)):
        go = np.flatnonzero(length > d)
        if not len(go):
            return
        if len(go) < len(at):
            at, data, length, c = at[go], data[go], length[go], c[go]
        node = code.node[d][data]
        slots = (c ^ _NODE_HASH[node][:, None]) * np.uint32(0x85EBCA6B)
        slots >>= _SHIFT
        slots += offset
        yield at, node, code.bit[d][data], slots


def _named(texts: list[bytes]) -> tuple[Grid, np.ndarray]:
    grid = Grid(texts).words()
    return grid, grid.hashes(grid.ws, grid.we, 0, fold=True)


def _add(n: np.ndarray, b: Bytes, code: Code) -> None:
    """Count the bits of b, each by its byte's weight, in every predictor's table."""
    flat = n.reshape(-1)
    for at, _, bit, slots in decisions(b, code):
        x = _bit_slots(slots, bit).ravel()
        np.add.at(flat, x, 1 if b.first else np.repeat(b.weight[at], CONTEXTS))


def _bit_slots(slots: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Where a table of (slots, 2) has each bit."""
    x = slots.astype(np.intp)
    x *= 2
    x += bit[:, None]
    return x


def _first_counts(code: Code):
    """(part, zeros, ones): this task's counts of first bytes by slot, deflated, in parts of PART slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = None
        for _, texts in blocks(batches, size=COUNT_BYTES):
            n = np.zeros((SLOTS, 2), np.int64) if n is None else n
            _add(n, first_bytes(*_named(texts)), code)
        if n is not None:
            yield _parts(n.T)

    return run


def _other_counts(code: Code):
    """The same of the other bytes, from the table of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = None
        for held, data, s, e in _words_of(batches, SCORE_BYTES):
            n = np.zeros((SLOTS, 2), np.int64) if n is None else n
            c = _column(held, "c")
            go = (e > s) & (c > 0)
            if go.any():
                _add(n, other_bytes(data, s[go], e[go], c[go]), code)
        if n is not None:
            yield _parts(n.T)

    return run


def _word_costs(model: "Model"):
    """(name, c, nats): what each word's bytes after the first cost; nothing for the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, data, s, e in _words_of(batches, SCORE_BYTES):
            go = np.flatnonzero(e > s)
            nats = np.zeros(len(s))
            if len(go):
                rest = other_bytes(data, s[go], e[go], np.ones(len(go), np.int64))
                nats[go] = np.bincount(rest.owner, weights=model.cost(rest), minlength=len(go))
            yield pa.RecordBatch.from_arrays([pa.array(_column(held, "name")), pa.array(_column(held, "c")), pa.array(nats)], ["name", "c", "nats"])

    return run


def _parts(n: np.ndarray) -> pa.RecordBatch:
    cut = [i for i in range(0, n.shape[1], PART) if n[:, i : i + PART].any()]
    blob = lambda y: pa.array([_closed(np.ascontiguousarray(n[y, i : i + PART])) for i in cut], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(np.array(cut, np.int32) // PART), blob(0), blob(1)], ["part", "zeros", "ones"])


def _closed(n: np.ndarray) -> bytes:
    """A part's counts, each in as few bytes as the largest needs, deflated."""
    kind = np.min_scalar_type(int(n.max(initial=0)))
    return bytes([kind.itemsize]) + zlib.compress(n.astype(kind).tobytes(), 1)


def opened(blob: bytes) -> np.ndarray:
    """The inverse of `_closed`."""
    return np.frombuffer(zlib.decompress(blob[1:]), f"u{blob[0]}").astype(np.int64)


def _sums(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
    """Adds up counts part by part; holds one part's sums for each part dealt here, which the model's size bounds."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, *blobs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            got = np.stack([opened(b) for b in blobs])
            if part in sums:
                sums[part] += got
            else:
                sums[part] = got
    return sums


def _sum_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = _sums(batches)
    if sums:
        blob = lambda y: pa.array([_closed(x[y]) for x in sums.values()], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), blob(0), blob(1)], ["part", "zeros", "ones"])


@dataclass
class Mixer:
    """Gated mixing weights, and the map over (tree node, mean guess)."""

    weights: np.ndarray = field(default_factory=lambda: np.full((GATES, CONTEXTS), 0.3))
    refine: np.ndarray = field(default_factory=lambda: np.tile(_PLAIN, (2 * NODES, 1)))

    def __post_init__(self) -> None:
        # Mix and map count half each; slots hold sixteenths.
        self.gated, self.flat = (self.weights.T / 32).astype(np.float32), (self.refine / 2).astype(np.float32).ravel()

    def guess(self, got: list[np.ndarray], gate: np.ndarray, bin_: np.ndarray) -> np.ndarray:
        """The bit's guess in the logistic domain, from what each predictor's slot holds."""
        z = self.flat.take(bin_)
        for k, x in enumerate(got):
            z += self.gated[k].take(gate) * (x >> 6)
        return z


#: The map's values where nothing was seen: the default mix of equal guesses.
_PLAIN = 0.3 * STEP / 16 * (np.arange(BINS) - BINS // 2)


def guesses(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """A predictor's guess from its counts, in the logistic domain."""
    return np.clip(stretch((ones + np.float32(0.4)) / (zeros + ones + np.float32(0.8))), -7.9, 7.9)


def packed(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """What a slot holds: its guess in sixteenths, times 64, plus four times the guess's level, plus its class of how often it was seen."""
    sixteenths = np.rint(guesses(zeros, ones) * 16).astype(np.int16)
    level = (sixteenths + np.int16(STEP * (LEVELS // 2) + STEP // 2)) // np.int16(STEP)
    return sixteenths * np.int16(64) + level * np.int16(4) + np.searchsorted(SEEN, zeros + ones, "right").astype(np.int16)


def mixed_by(got: list[np.ndarray], node: np.ndarray, first: bool) -> tuple[np.ndarray, np.ndarray]:
    """(gate, place in the map) of bits, from what each predictor's slot holds."""
    gate = (got[1] & 3) * 16 + (got[2] & 3) * 4 + (got[3] & 3) + KIND * first
    total = sum((x >> 2) & 15 for x in got)
    return gate, total + (node + np.int32(NODES * first)) * np.int32(BINS)


@dataclass
class Model:
    """`table`: what `packed` says of each slot."""

    code: Code
    table: np.ndarray
    mixer: Mixer = field(default_factory=Mixer)

    @staticmethod
    def of(code: Code, zeros: np.ndarray, ones: np.ndarray) -> "Model":
        return Model(code, packed(zeros, ones))

    def cost(self, b: Bytes) -> np.ndarray:
        """Nats that each byte costs."""
        out = np.zeros(len(b.data), np.float32)
        for at, node, bit, slots in decisions(b, self.code):
            got = [self.table.take(slots[:, k]) for k in range(CONTEXTS)]
            z = self.mixer.guess(got, *mixed_by(got, node, b.first))
            # log(1 + exp(-z)) for a 1, log(1 + exp(z)) for a 0
            out[at] += np.log(1 + np.exp(np.where(bit == 1, -z, z)))
        return out

    def bits(self, t: Tokens) -> np.ndarray:
        """Bits that each text costs. A distinct word's bytes after the first cost the same wherever it stands."""
        words = np.bincount(t.rest.owner, weights=self.cost(t.rest), minlength=int(t.word.max(initial=-1)) + 1)
        total = np.bincount(t.first.owner, weights=self.cost(t.first), minlength=len(t.read))
        if len(t.word):
            total += np.bincount(t.doc, weights=words[t.word], minlength=len(t.read))
        return total / np.log(2)


# ---- mixing weights ----


def without(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Level and class that `packed` would say of each slot if one bit hadn't been counted: a 0, and a 1."""
    return (np.stack([packed(np.maximum(zeros - 1, 0), ones), packed(zeros, np.maximum(ones - 1, 0))], axis=1) & 63).astype(np.uint8).ravel()


def _add_mixed(n: np.ndarray, b: Bytes, code: Code, table: np.ndarray) -> None:
    """Count the bits of b, each by its byte's weight, by gate and levels of the guesses, and in the map's part."""
    flat = n.reshape(-1)
    for at, node, bit, slots in decisions(b, code):
        x = _bit_slots(slots, bit)
        got = [table.take(x[:, k]) for k in range(CONTEXTS)]
        gate, bin_ = mixed_by(got, node, b.first)
        place = gate.astype(np.intp) * PART
        for k in range(CONTEXTS):
            place += (got[k] >> 2).astype(np.intp) << (4 * k)
        weight, side = 1 if b.first else b.weight[at], bit * np.intp(n.shape[1])
        np.add.at(flat, place + side, weight)
        np.add.at(flat, bin_ + side + PART * GATES, weight)


def _train_mixer(code: Code, table: np.ndarray, first: bool):
    """(part, zeros, ones): this task's counts for mixer and map, from texts (first bytes) or from the table of words (the others)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = None
        for held in blocks(batches, size=COUNT_BYTES) if first else _words_of(batches, SCORE_BYTES):
            n = np.zeros((2, PART * (GATES + 1)), np.int64) if n is None else n
            if first:
                _add_mixed(n, first_bytes(*_named(held[1])), code, table)
                continue
            words, data, s, e = held
            c = _column(words, "c")
            go = (e > s) & (c > 0)
            if go.any():
                _add_mixed(n, other_bytes(data, s[go], e[go], c[go]), code, table)
        if n is not None:
            yield _parts(n)

    return run


def fitted_weights(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The weights that code a gate's bits (by levels of the guesses) in the fewest bits, drawn a little to the default: Newton's method."""
    at = np.flatnonzero(zeros + ones)
    n0, n1 = zeros[at].astype(float), ones[at].astype(float)
    st = np.stack([(at // 16**k % 16 - LEVELS // 2) * (STEP / 16) for k in range(CONTEXTS)], axis=1)
    loss = lambda w: n0 @ np.logaddexp(0, st @ w) + n1 @ np.logaddexp(0, -(st @ w)) + 0.5 * ((w - 0.3) ** 2).sum()
    w = np.full(CONTEXTS, 0.3)
    now = loss(w)
    for _ in range(30):
        p = squash(st @ w)
        slope = st.T @ (p * (n0 + n1) - n1) + (w - 0.3)
        step = np.linalg.solve((st * (p * (1 - p) * (n0 + n1))[:, None]).T @ st + np.eye(CONTEXTS), slope)
        for half in range(12):
            new = w - step * 0.5**half
            value = loss(new)
            if value <= now:
                break
        else:
            return w
        done = now - value <= 1e-9 * now
        w, now = new, value
        if done:
            break
    return w


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, got): a gate's weights, or the map, from its counts, summed here."""
    for part, (zeros, ones) in _sums(batches).items():
        if part < GATES:
            got = fitted_weights(zeros, ones)
        else:
            zeros, ones = (x[: 2 * NODES * BINS].reshape(-1, BINS) for x in (zeros, ones))
            got = np.clip(stretch(np.clip((ones + 2 * squash(_PLAIN)) / (zeros + ones + 2), 1e-6, 1 - 1e-6)), -12, 12)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([got.tobytes()], pa.binary())], ["part", "got"])


def fitted_mixer(train: DataFrame, words: DataFrame, code: Code, zeros: np.ndarray, ones: np.ndarray) -> Mixer:
    """Mixer and map, from all texts learned from and the table of words."""
    table, mixer = without(zeros, ones), Mixer()
    weights, refine = mixer.weights.copy(), mixer.refine
    counts = _dealt(GATES + 1, train.mapInArrow(_train_mixer(code, table, True), PARTS), words.mapInArrow(_train_mixer(code, table, False), PARTS))
    for r in counts.mapInArrow(_fitted, "part int, got binary").collect():  # the model: four weights for each gate, and the map
        if r.part < GATES:
            weights[r.part] = np.frombuffer(r.got)
        else:
            refine = np.frombuffer(r.got).reshape(2 * NODES, BINS)
    return Mixer(weights, refine)


SCORED = "owner long, name long, times long, spelt long, doc long, held_out boolean, n_tokens long, known long, base double, nats double, read long"


def _answered(batch: pa.RecordBatch, p: Passages) -> np.ndarray:
    """The class of each passage of a block, -1 where nothing is known."""
    known = batch.column(batch.schema.get_field_index("known"))
    known = known.cast(pa.list_(pa.int64()))
    size = pc.fill_null(pc.list_value_length(known), 0).to_numpy(zero_copy_only=False)
    value = known.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.full(len(p.doc), -1)
    first = np.searchsorted(p.doc, np.arange(batch.num_rows))
    out[np.repeat(first, size) + (value >> 8)] = value & 255
    return out


def _score(model: Model, unigrams: Unigrams, chance: np.ndarray):
    """A row for each text, and one for each of its words that isn't a frequent one (with times, and how often it is spelled)."""
    price = np.append(-np.log(np.stack([1 - chance, chance], axis=1)).ravel(), 0.0)  # by class and whether it hit; the last for -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, size=SCORE_BYTES):
            grid, h = _named(texts)
            p = passages(grid, h)
            kind = _answered(batch, p)
            taken = np.append(kind >= 0, False) & np.append(kind % 2 == 1, False)
            spelt = ~taken[p.of]
            words = len(h)
            h, of, hit, rest, n, known, base = unigrams.summed(grid, h)
            first = first_bytes(grid, h[:words]).only(spelt)
            nats = np.bincount(first.owner, weights=model.cost(first), minlength=grid.n) + np.bincount(of[spelt], weights=rest[spelt], minlength=grid.n)
            nats += np.bincount(p.doc, weights=price[kind], minlength=grid.n)
            owner = ids(batch, "name")
            rare, at_doc = h[~hit], of[~hit]
            _, at, of_word, times = np.unique(mix(at_doc.astype(np.uint64), 7) ^ rare, return_index=True, return_inverse=True, return_counts=True)
            times_spelt = np.bincount(of_word, weights=spelt[~hit], minlength=len(at)).astype(np.int64)
            d = at_doc[at]
            own = [pa.array(owner), longs(mix(owner.view(np.uint64), 86)), pa.nulls(grid.n, pa.int64()), pa.nulls(grid.n, pa.int64()), pa.array(ids(batch))]
            own += [batch.column(batch.schema.get_field_index("held_out")), pa.array(n), pa.array(known), pa.array(base), pa.array(nats), pa.array(bytes_read(grid))]
            names = [x.split()[0] for x in SCORED.split(", ")]
            yield pa.RecordBatch.from_arrays(own, names)
            more = [pa.array(owner[d]), longs(rare[at]), pa.array(times), pa.array(times_spelt)]
            yield pa.RecordBatch.from_arrays([*more, *(pa.nulls(len(d), x.type) for x in own[4:])], names)

    return run


BASE = "owner long, name long, times long, doc long, held_out boolean, n_tokens long, known long, base double"


def _base(unigrams: Unigrams):
    """A row for each text, and one for each of its words that isn't a frequent one (with times), as `_score` makes them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in BASE.split(", ")]
        for batch, texts in blocks(batches, size=SCORE_BYTES):
            h, of, hit, _, n, known, base = unigrams.summed(*_named(texts))
            owner = ids(batch, "name")
            rare, at_doc = h[~hit], of[~hit]
            _, at, times = np.unique(mix(at_doc.astype(np.uint64), 7) ^ rare, return_index=True, return_counts=True)
            own = [pa.array(owner), longs(mix(owner.view(np.uint64), 86)), pa.nulls(len(n), pa.int64()), pa.array(ids(batch)), batch.column(batch.schema.get_field_index("held_out")), pa.array(n), pa.array(known), pa.array(base)]
            yield pa.RecordBatch.from_arrays(own, names)
            yield pa.RecordBatch.from_arrays([pa.array(owner[at_doc[at]]), longs(rare[at]), pa.array(times), *(pa.nulls(len(at), x.type) for x in own[3:])], names)

    return run


def _dealt(n: int, *counts: DataFrame) -> DataFrame:
    """Counts by part (n of them), dealt by part to be added up: where there are more than FANIN tables, so many at most are added up first, so that no task reads all tasks' tables."""
    some = functools.reduce(DataFrame.union, counts)
    sums = -(-some.rdd.getNumPartitions() // FANIN)
    if sums > 1:
        some = some.withColumn("sum", F.spark_partition_id() % sums).repartition(min(n * sums, 32 * sums), "part", "sum").select("part", "zeros", "ones").mapInArrow(_sum_parts, PARTS)
    return some.repartition(min(n, 32), "part")


def _rows(docs: DataFrame) -> DataFrame:
    ship(docs.sparkSession)
    return docs.select(ordered_id().alias("doc_id"), row_key().alias("row_key"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))


def _frequent(costs: DataFrame, n_train: int, size: Row) -> Unigrams:
    """The FREQUENT most frequent words of (name, c, nats), and the end; `size`: N and V."""
    top = costs.filter(F.col("name") != END).orderBy(F.desc("c"), "name").limit(FREQUENT).toArrow()
    names = np.append(top["name"].to_numpy(), END).view(np.uint64)  # the end is always looked up where the text is
    at = np.argsort(names)
    return Unigrams(names[at], np.append(top["c"].to_numpy(), n_train)[at], np.append(top["nats"].to_numpy(), 0.0)[at], int(size[0] or 0), int(size[1]))


def base_scored(docs: DataFrame) -> DataFrame:
    """The columns of `scored` that need counts alone (doc_id, held_out, n_tokens, n_known, train_tokens, base_score), without the byte model."""
    rows = _rows(docs)
    met = rows.select("held_out", "text").mapInArrow(_word_counts, "name long, word binary, n long")
    counts = staged(met.groupBy("name").agg(F.sum("n").alias("c")), "counts").withColumn("nats", F.lit(0.0))
    size = counts.agg(F.sum("c"), F.count_if(F.col("c") > 0)).first()
    ends = counts.filter(F.col("name") == END).first()
    unigrams = _frequent(counts, int(ends.c) if ends else 0, size)
    found = rows.withColumn("name", F.xxhash64("doc_id", "row_key")).mapInArrow(_base(unigrams), BASE)
    met = found.join(counts.select("name", F.col("c").alias("n")), "name", "left")
    sums = met.groupBy("owner").agg(
        F.count_if(F.col("times").isNull()).cast("int").alias("rows"), *[F.max(x).alias(x) for x in ("doc", "held_out", "n_tokens", "known", "base")],
        F.sum(F.when(F.col("n") > 0, F.col("times"))).alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("gain"),
    )
    # Repeated rows have asked once each: their sums are as many times too large.
    met = sums.withColumn("more", (F.col("more") / F.col("rows")).cast("long")).withColumn("gain", F.col("gain") / F.col("rows")).withColumn("again", F.explode(F.expr("array_repeat(0, rows)")))
    return met.select(
        shown_id("doc").alias("doc_id"), "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(unigrams.tokens).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("gain", F.lit(0.0))).alias("base_score"),
    )


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of each row."""
    spark = docs.sparkSession
    rows = _rows(docs)
    train = rows.filter("not held_out").select("text")

    met = rows.select("held_out", "text").mapInArrow(_word_counts, "name long, word binary, n long")
    words = staged(met.groupBy("name", "word").agg(F.sum("n").alias("c")), "words")
    size = words.agg(F.sum("c"), F.count_if(F.col("c") > 0)).first()
    byte = np.zeros(256, np.int64)
    for r in words.mapInArrow(_byte_counts, "byte long, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect():  # at most 256 rows
        byte[r.byte] = r.n
    code = Code.of(byte)

    zeros, ones = np.zeros(SLOTS, np.float32), np.zeros(SLOTS, np.float32)
    counts = _dealt(-(-SLOTS // PART), train.mapInArrow(_first_counts(code), PARTS), words.mapInArrow(_other_counts(code), PARTS))
    for r in counts.mapInArrow(_sum_parts, PARTS).collect():  # the model: one row for each part
        at = slice(r.part * PART, (r.part + 1) * PART)
        zeros[at], ones[at] = opened(r.zeros), opened(r.ones)
    model = Model.of(code, zeros, ones)
    freed(spark)

    ends = words.filter(F.col("name") == END).first()
    n_train = int(ends.c) if ends else 0
    if n_train:
        model.mixer = fitted_mixer(train, words, code, zeros, ones)

    costs = staged(words.mapInArrow(_word_costs(model), "name long, c long, nats double"), "costs")
    unigrams = _frequent(costs, n_train, size)

    unstaged(words)
    freed(spark)
    much = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 8 + int(much) // (6 * SPACING * CUTS)
    rows = rows.withColumn("name", F.xxhash64("doc_id", "row_key"))
    cuts = rows.mapInArrow(_cut_rows(parts), CUT_ROWS).repartition(parts, "part").sortWithinPartitions("part", "kind")
    answers = staged(cuts.mapInArrow(_answers, "name long, place long, class int, learned boolean"), "answers")
    hits, seen = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in answers.filter("learned").groupBy("class").count().collect():  # at most two rows for each class
        seen[r["class"] // 2] += r["count"]
        hits[r["class"] // 2] += r["count"] * (r["class"] % 2)
    freed(spark)  # the cuts', now that another job is the last one
    known = answers.groupBy("name").agg(F.collect_set(F.col("place") * 256 + F.col("class")).alias("known"))  # repeated rows are answered twice

    found = rows.join(known, "name", "left").mapInArrow(_score(model, unigrams, chances(hits, seen)), SCORED)
    met = found.join(costs.select("name", F.col("c").alias("n"), F.col("nats").alias("each")), "name", "left")
    sums = met.groupBy("owner").agg(
        F.count_if(F.col("times").isNull()).cast("int").alias("rows"), *[F.max(x).alias(x) for x in ("doc", "held_out", "n_tokens", "known", "base", "nats", "read")],
        F.sum(F.when(F.col("n") > 0, F.col("times"))).alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("gain"), F.sum(F.col("spelt") * F.col("each")).alias("rest"),
    )
    # Repeated rows have asked once each: their sums are as many times too large.
    met = sums.withColumn("more", (F.col("more") / F.col("rows")).cast("long")).withColumn("gain", F.col("gain") / F.col("rows")).withColumn("rest", F.col("rest") / F.col("rows"))
    both = met.withColumn("nats", F.col("nats") + F.coalesce("rest", F.lit(0.0))).withColumn("again", F.explode(F.expr("array_repeat(0, rows)")))
    return both.select(
        shown_id("doc").alias("doc_id"), "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(unigrams.tokens).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("gain", F.lit(0.0))).alias("base_score"),
        (F.col("nats") / -float(np.log(10))).alias("score"), (F.col("nats") / float(np.log(2)) / F.col("read")).alias("bits_per_byte"),
    )
