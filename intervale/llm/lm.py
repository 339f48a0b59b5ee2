"""Scoring texts by a hierarchical Pitman-Yor language model learnt from the whole corpus.

A token is predicted from the word right before it, whichever that is: each word has a restaurant whose dishes are all words that
follow it in training. What such a restaurant leaves goes to their shared parent, which predicts in two steps. First the token's symbol: a frequent word is one, the others fall into classes by their last byte,
and the end of a text is one; symbols are predicted from the frequent word before them, right before or further back, by context
restaurants that share their parent. Then, within a class, the word: a restaurant for each class, whose dishes are its words and whose base spells the word
backwards by a byte model with contexts of three bytes, two, one and none. All seatings are sampled by Gibbs sweeps and
predictives averaged. What the driver holds is bounded: at most FREQUENT words by their share of all tokens, so at most
2 * (FREQUENT + 1) * (FREQUENT + 257) pairs of context and symbol, folded byte contexts, and at most BROADCAST words and as many
pairs of words; all other words and pairs stay in tables, which grow with the corpus.

Tokens are dealt to tasks in blobs: sorted columns of one chunk of texts for one part of the keys, as differences and byte planes,
compressed. Counting pairs moves each distinct pair of a chunk once, scoring each token once whose pair is not broadcast."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intervale.llm.common import fold, pieces_of, small_batches, trim
from intervale.tables import drop_staged
from intervale.tables import staged as kept
from intervale.llm.pitman_yor import BURN, SAMPLES, Model, discount_of, mixed, seat

#: A word is a symbol of its own from one in so many tokens on; so there are at most so many.
FREQUENT = 1000
#: A word's count and probability are broadcast from one in so many tokens on: at most 24 bytes times this. Rarer ones are joined.
#: Not below FREQUENT: fitting and scoring know a context's symbol from the broadcast words.
BROADCAST = 1_000_000
#: Tokens whose pairs a task counts, or which it scores, before it passes them on.
PAIRS = 1_000_000
#: Tokens a part of the keys has, about; and how many parts there are at most.
PART, PARTS = 400_000, 20_000
#: Rows of tables taken at a time, more if a restaurant has more; partial sums of texts a task holds.
SEATED, SUMS = 50_000, 300_000
#: Of the number of a text's row, what names the block of texts whose sums meet.
TEXTS = 12
#: Counters of a task are passed on when they hold so many words.
HELD = 300_000
#: Bytes of text scored at a time.
PIECE = 4 << 20
EDGE, BYTES = 256, 257
#: Bits that contexts keep of their second and third byte; small letters differ in five.
FOLD = 5
FOLDED = (1 << FOLD) - 1
#: Smoothing of the base score.
ADD = 0.1
_U = np.uint64
BLOB = "part bigint, kind int, n int, raw binary"
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Kinds of blobs: pairs, contexts and words of the model; tokens by the pair, the context and the word they look up; texts.
PAIR, CONTEXT, NAMED, BY_PAIR, BY_CONTEXT, BY_WORD, TEXT = range(7)


def staged(df: DataFrame, label: str) -> DataFrame:
    """As in ``tables``; the shuffles that made the table are deleted as soon as it is written."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEAN, "false")
    conf.set(_CLEAN, "true")
    try:
        return kept(df, label)
    finally:
        conf.set(_CLEAN, before)


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of 64 bits, the first sorted: its differences and the others, byte by byte, since most high bytes are alike."""
    columns = (np.diff(columns[0], prepend=columns[0].dtype.type(0)), *columns[1:])
    planes = np.empty((len(columns), 8, len(columns[0])), np.uint8)
    for out, c in zip(planes, columns, strict=True):
        out[:] = np.ascontiguousarray(c).view(np.uint8).reshape(-1, 8).T
    return pa.Codec("zstd", 1).compress(planes, asbytes=True)


def _unpack(raw: bytes, n: int, columns: int) -> np.ndarray:
    """What ``_pack`` was given, as rows of 64-bit integers."""
    planes = np.frombuffer(pa.Codec("zstd", 1).decompress(raw, n * 8 * columns, asbytes=True), np.uint8).reshape(columns, 8, n)
    out = planes.transpose(0, 2, 1).copy().view(np.int64)[..., 0]
    out[0] = np.cumsum(out[0])
    return out


def _dealt(part: np.ndarray, kind: int, *columns: np.ndarray) -> pa.RecordBatch:
    """A blob a part; the rows are sorted by the first column."""
    if len(part) and 0 <= part.min() and part.max() < 1 << 16:
        part = part.astype(np.uint16)  # sorted by radix
    order = np.argsort(part, kind="stable")
    part = part[order]
    begins = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.empty(0, np.int64)
    size = np.diff(np.append(begins, len(part)))
    columns = tuple(c[order] for c in columns)
    raw = [_pack(*(c[i : i + n] for c in columns)) for i, n in zip(begins.tolist(), size.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(part[begins].astype(np.int64)), pa.array(np.full(len(raw), kind, np.int32)), pa.array(size.astype(np.int32)), pa.array(raw, pa.binary())], ["part", "kind", "n", "raw"])


def _part(x: np.ndarray, parts: int) -> np.ndarray:
    return (mixed(x.view(_U)) % _U(parts)).astype(np.int64)


def _met(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether ``x`` is among the sorted ``keys``, where)."""
    if not len(keys):
        return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return keys[at] == x, at


def _larger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches of SEATED rows or more, but the last."""
    held, total = [], 0
    for b in batches:
        held.append(b)
        total += b.num_rows
        if total >= SEATED:
            yield pa.Table.from_batches(held).combine_chunks()
            held, total = [], 0
    if total:
        yield pa.Table.from_batches(held).combine_chunks()


def _joined(blobs: list[np.ndarray], columns: int) -> list[np.ndarray]:
    """Blobs of one kind as one, sorted by the first column."""
    all_of = np.concatenate(blobs, axis=1) if blobs else np.empty((columns, 0), np.int64)
    return list(all_of[:, np.argsort(all_of[0])])


def _hash(word: bytes) -> int:
    """Spark's xxhash64 of a binary, unsigned."""
    return xxhash.xxh64_intdigest(word, 42)


def tokens(raw: bytes | None) -> list[bytes]:
    return (raw or b"").lower().split()


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n, h) over whole texts: counted in each task, then summed; h is the word's 64-bit hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        give = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        for b in batches:
            for raw in b.column(0):
                held.update(tokens(raw.as_py()))
                if len(held) > HELD:
                    yield give()
                    held.clear()
        if held:
            yield give()

    rows = docs.select(F.col("text").cast("binary").alias("raw")).mapInArrow(run, "word binary, n bigint")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).withColumn("h", F.xxhash64("word"))


class Symbols:
    """Symbols of words: a word's place among the frequent, or else their number plus its last byte; and places, from 1, of the
    ``broadcast`` words, which are sorted and hold the frequent ones."""

    def __init__(self, frequent: np.ndarray, broadcast: np.ndarray):
        self.frequent, self.keys = frequent, broadcast
        self.end = len(frequent) + 256
        self.size = self.end + 1
        #: Contexts: a frequent word right before; the last frequent word before, with others since; the start; others alone.
        self.contexts = 2 * len(frequent) + 2
        bits = max(1, int(4 * len(broadcast)).bit_length())
        self.shift = _U(64 - bits)
        #: Where the keys with the same highest bits, or greater ones, begin.
        self.first = np.searchsorted(broadcast >> self.shift, np.arange(1 << bits, dtype=_U)).astype(np.int32)
        known, at = _met(frequent, broadcast)
        self.own = np.append(-1, np.where(known, at, -1))

    def __getitem__(self, word: bytes) -> int:
        known, at = _met(self.frequent, np.array([_hash(word)], _U))
        return int(at[0]) if known[0] else len(self.frequent) + word[-1]

    def places(self, h: np.ndarray) -> np.ndarray:
        """From 1, or 0 for a hash that is not among the broadcast words'."""
        out = np.zeros(len(h), np.int64)
        if not len(self.keys):
            return out
        at = self.first[h >> self.shift]
        left, h = np.arange(len(h)), h
        while len(left):
            key = self.keys[np.minimum(at, len(self.keys) - 1)]
            hit = key == h
            out[left[hit]] = at[hit] + 1
            go = (key < h) & (at < len(self.keys))
            left, h, at = left[go], h[go], at[go] + 1
        return out

    def read(self, texts: Texts) -> Tokens:
        """All words of the texts and their ends."""
        f, size = len(self.frequent), texts.size + 1
        h = hashes(texts.raw, texts.begin, texts.length)
        place = self.places(h)
        own = self.own[place]
        last_byte = np.frombuffer(texts.raw, np.uint8)[texts.begin + texts.length - 1]
        text = np.repeat(np.arange(len(size)), size)
        ends = np.cumsum(size) - 1
        n = len(text)
        inner = np.ones(n, bool)
        inner[ends] = False
        symbol, w = np.full(n, self.end, np.int64), np.zeros(n, np.int64)
        symbol[inner] = np.where(own >= 0, own, f + last_byte.astype(np.int64))
        w[inner] = np.where(place > 0, place, h.view(np.int64))
        at, begin = np.arange(n), np.repeat(ends + 1 - size, size)
        last = np.append(-1, np.maximum.accumulate(np.where(symbol < f, at, -1))[:-1]) if n else at  # the last frequent word before
        own = symbol[np.maximum(last, 0)]
        context = np.where(last == at - 1, own, f + own)
        context[last < begin] = 2 * f + 1
        context[ends + 1 - size] = 2 * f
        return Tokens(texts, text, context, symbol, np.append(0, w[:-1]) if n else w, w)


@dataclass
class Texts:
    """Texts in one piece, A-Z lower-cased and followed by 16 bytes; the number of words of each, and the words' begins and lengths."""

    raw: bytes
    size: np.ndarray
    begin: np.ndarray
    length: np.ndarray


@dataclass
class Tokens:
    """Of each word and end the index of its text, its context and symbol, and the ids of the word before and the word itself: 0 for
    start and end, the place from 1 of broadcast words, else the hash."""

    texts: Texts
    text: np.ndarray
    context: np.ndarray
    symbol: np.ndarray
    u: np.ndarray
    w: np.ndarray

    def words(self, at: np.ndarray) -> list[bytes]:
        """The words that are the tokens ``at``."""
        k = at - self.text[at]  # an end for each text before
        begin = self.texts.begin[k]
        raw = self.texts.raw
        return [raw[i:j] for i, j in zip(begin.tolist(), (begin + self.texts.length[k]).tolist(), strict=True)]


_IS_WORD = bytes(0 if b in b" \t\n\r\x0b\x0c" else 1 for b in range(256))
_P1, _P2, _P3, _P4, _P5 = (_U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def split_words(raw: bytes, ends: np.ndarray) -> Texts:
    """Words of texts that lie one behind the other; ``ends``: where each ends. As ``tokens`` splits them."""
    raw = raw.lower()
    word = np.frombuffer(raw.translate(_IS_WORD), np.bool_)
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    cut = ends[(ends > 0) & (ends < len(raw))]  # no word goes on in the next text
    first[cut], last[cut - 1] = word[cut], word[cut - 1]
    begin = np.flatnonzero(first)
    size = np.diff(np.searchsorted(begin, ends), prepend=0)
    return Texts(raw + bytes(16), size, begin, np.flatnonzero(last) + 1 - begin)


def hashes(raw: bytes, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """``_hash`` of words of ``raw``, which goes on for 16 bytes behind the last. Words below 16 bytes are hashed length by length."""
    rotated = lambda x, n: x << _U(n) | x >> _U(64 - n)
    eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    order = np.argsort(np.minimum(length, 16).astype(np.uint8), kind="stable")
    begin, length = begin[order], length[order]
    bounds = np.searchsorted(length, np.arange(1, 17))
    out = np.empty(len(begin), _U)
    for size, i, j in zip(range(1, 16), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if i == j:
            continue
        tail, left = eight[begin[i:j]], size
        h = np.full(j - i, _U(42) + _P5 + _U(size), _U)
        if left >= 8:
            h ^= rotated(tail * _P2, 31) * _P1
            h = rotated(h, 27) * _P1 + _P4
            tail, left = eight[begin[i:j] + 8], left - 8
        if left >= 4:
            h ^= (tail & _U(0xFFFFFFFF)) * _P1
            h = rotated(h, 23) * _P2 + _P3
            tail, left = tail >> _U(32), left - 4
        for _ in range(left):
            h ^= (tail & _U(255)) * _P5
            h = rotated(h, 11) * _P1
            tail = tail >> _U(8)
        h = (h ^ h >> _U(33)) * _P2
        h = (h ^ h >> _U(29)) * _P3
        out[i:j] = h ^ h >> _U(32)
    i = int(bounds[-1])
    out[i:] = np.fromiter((_hash(raw[a : a + n]) for a, n in zip(begin[i:].tolist(), length[i:].tolist(), strict=True)), _U, len(begin) - i)
    back = np.empty_like(out)
    back[order] = out
    return back


def _texts(column: pa.Array) -> Iterator[tuple[int, int, Texts]]:
    """Runs of texts of PIECE bytes: (first, behind the last, their words)."""
    column = column.fill_null(b"").cast(pa.large_binary())
    if not len(column):
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    for i, j in pieces_of(np.diff(at).tolist(), PIECE):
        raw = data.slice(int(at[i]), int(at[j] - at[i])).to_pybytes() if data is not None else b""
        yield i, j, split_words(raw, at[i + 1 : j + 1] - at[i])


def _summed(keys: tuple[np.ndarray, ...], n: np.ndarray, asked: np.ndarray) -> list[np.ndarray]:
    """Distinct keys, the first in order, the sums of n and whether any was asked for. Two keys meet by the hash of both."""
    order = np.argsort(_pair_key(*keys) if len(keys) > 1 else keys[0])
    keys = tuple(k[order] for k in keys)
    if not len(order):
        return [*keys, n, asked]
    new = np.zeros(len(order) - 1, bool)
    for k in keys:
        new |= k[1:] != k[:-1]
    first = np.flatnonzero(np.append(True, new))
    out = [*(k[first] for k in keys), np.add.reduceat(n[order], first), np.maximum.reduceat(asked[order], first)]
    if len(keys) > 1:
        order = np.argsort(out[0])
        out = [x[order] for x in out]
    return out


def count_pairs(docs: DataFrame, frequent: np.ndarray, hashes: np.ndarray, parts: int) -> DataFrame:
    """Of ``docs`` (raw, aside) the pairs (u, w, n, ask), ids as in ``Tokens``: how often word w follows word u in texts that
    are not ``aside``, for all pairs met more than once; with null w, how many follow u once. Pairs met once or never that scoring
    has to know by name are rows with ``ask``: those met once that a text aside has, and all of two rare words. Rows whose ``ask`` is
    null are contexts with their symbols: u is context * symbols + symbol; each task sums them into one array first.

    Counted in each chunk of texts, then summed by part; a frequent word's pairs are in many parts."""
    size = len(hashes)
    often = np.append(True, np.isin(hashes, frequent))  # the start too

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Symbols(frequent, hashes)
        held: list[tuple] = []
        total = 0
        followed = np.zeros(s.contexts * s.size, np.int64)

        def give() -> Iterator[pa.RecordBatch]:
            u, w, aside = (np.concatenate(c) for c in zip(*held, strict=True))
            few = (u < 0) | (u > size) | (w < 0) | (w > size)
            code, n, asked = _summed((u[~few] * (size + 1) + w[~few],), (~aside[~few]).astype(np.int64), aside[~few].astype(np.int64))
            p, q = code // (size + 1), code % (size + 1)
            yield _dealt(_part(np.where(often[p], code, p), parts), 0, code, n << 1 | asked)
            p, q, n, asked = _summed((u[few], w[few]), (~aside[few]).astype(np.int64), aside[few].astype(np.int64))
            many = (p >= 0) & (p <= size) & often[np.where((p >= 0) & (p <= size), p, 0)]
            yield _dealt(_part(np.where(many, _pair_key(p, q).view(np.int64), p), parts), 1, p, q, n << 1 | asked)

        for b in batches:
            aside = b.column(1).to_numpy(zero_copy_only=False)
            for i, j, texts in _texts(b.column(0)):
                t = s.read(texts)
                away = aside[i:j][t.text]
                held.append((t.u, t.w, away))
                total += len(t.text)
                followed += np.bincount((t.context * s.size + t.symbol)[~away], minlength=len(followed))
                if total >= PAIRS:
                    yield from give()
                    held, total = [], 0
        if held:
            yield from give()
        code = np.flatnonzero(followed)
        yield _dealt(_part(code, parts), 2, code, followed[code])
        trim()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, ([], [], [])

        def give() -> Iterator[pa.RecordBatch]:
            both, few, followed = (_joined(x, k) for x, k in zip(held, (2, 3, 2), strict=True))
            code, n, asked = _summed((both[0],), both[1] >> 1, both[1] & 1)
            p, q, m, more = _summed((few[0], few[1]), few[2] >> 1, few[2] & 1)
            u, w, n, asked = np.append(code // (size + 1), p), np.append(code % (size + 1), q), np.append(n, m), np.append(asked, more)
            rare = ((u < 0) | (u > size)) & ((w < 0) | (w > size))
            use = (n > 1) | (n == 1) & (asked > 0) | rare
            alone, times = np.unique(u[n == 1], return_counts=True)
            ask = n[use] < 2
            none = pa.nulls(len(alone), pa.int64())
            cols = [pa.array(np.append(u[use], alone)), pa.concat_arrays([pa.array(w[use]), none]), pa.array(np.append(n[use], times)), pa.array(np.append(ask, np.zeros(len(alone), bool)))]
            yield pa.RecordBatch.from_arrays(cols, ["u", "w", "n", "ask"])
            code, n, _ = _summed((followed[0],), followed[1], followed[1])
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.nulls(len(code), pa.int64()), pa.array(n), pa.nulls(len(code), pa.bool_())], ["u", "w", "n", "ask"])

        for b in batches:
            for part, kind, n, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if part != now:
                    if now is not None:
                        yield from give()
                    now, held = part, ([], [], [])
                held[kind].append(_unpack(raw, n, 3 if kind == 1 else 2))
        if now is not None:
            yield from give()
        trim()

    blobs = docs.select("raw", "aside").mapInArrow(count, BLOB)
    return blobs.repartition("part").sortWithinPartitions("part", "kind").mapInArrow(add, "u bigint, w bigint, n bigint, ask boolean")


def _pair_key(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mixed(mixed(u.view(_U)) * _U(3) + w.view(_U))


def _arrays(df: DataFrame) -> tuple[np.ndarray, ...]:
    got = df.toArrow()
    return tuple(c.to_numpy(zero_copy_only=False) for c in got.columns)


def _spelt(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Steps of spelling words backwards, their last bytes given: (context, byte or EDGE, where each word begins). A context is
    the byte after, and of the two after that their lowest FOLD bits."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    first = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
    own = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
    before, two = np.empty_like(own), np.empty_like(own)
    before[1:], two[:-1] = own[:-1], own[1:]
    before[first], two[first + size - 1] = EDGE, EDGE
    three = np.append(two[1:], EDGE) if len(own) else two
    three[first + size - 1] = EDGE
    return (own << FOLD | two & FOLDED) << FOLD | three & FOLDED, before, first


@dataclass
class Speller:
    """log10 probabilities: ``row`` of each context, the rows' table."""

    row: np.ndarray
    table: np.ndarray

    def log10(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.empty(0)
        context, dish, first = _spelt(words)
        return np.add.reduceat(self.table[self.row[context], dish].astype(float), first)


def fit_speller(code: np.ndarray, n: np.ndarray) -> Speller:
    """Restaurants of three, two, one and no bytes; contexts never met leave all to those a byte shorter."""
    met, at = np.unique(code // BYTES, return_inverse=True)
    shorter = np.arange(BYTES << FOLD)
    shorten = [np.concatenate([met >> FOLD, shorter]), shorter >> FOLD, np.zeros(BYTES, np.int64)]
    p = Model(at, code % BYTES, n, [len(met) + len(shorter), len(shorter), BYTES, 1], shorten, BYTES).predictive()
    row = len(met) + np.repeat(shorter, 1 << FOLD)
    row[met] = np.arange(len(met))
    return Speller(row.astype(np.int32), np.log10(np.maximum(p, 1e-30)).astype(np.float32))


def _letters(rare: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(code, n) of the spelling steps of the distinct words, summed in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for b in _larger(batches):
            context, dish, _ = _spelt(b.column(0).to_pylist())
            code, n = np.unique(context * BYTES + dish, return_counts=True)
            codes, back = np.unique(np.concatenate([codes, code]), return_inverse=True)
            counts = np.bincount(back, np.concatenate([counts, n]), len(codes)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts)], ["code", "n"])

    return _arrays(rare.select("word").mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")))


@dataclass
class Classes:
    """The classes' restaurants: customers ``n`` of each, tables of each after each sweep, the discount."""

    n: np.ndarray
    tables: list[np.ndarray]
    discount: float
    strength: float = 1.0

    def seated(self, sweep: int, k: np.ndarray, n: np.ndarray, h: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Tables of words of class k under sweep ``sweep``, given the tables of all before it."""
        weight = (self.strength + self.discount * self.tables[sweep][k]) * base
        return seat(n, weight, self.discount, mixed(h.view(_U) if h.dtype == np.int64 else h), sweep)

    def left(self, k: np.ndarray) -> np.ndarray:
        """Averaged share that class k leaves to the spelling."""
        got = [(self.strength + self.discount * t[k]) / (self.strength + self.n[k]) for t in self.tables[BURN + 1 :]]
        return sum(got) / max(1, len(got))

    def log10(self, k: np.ndarray, n: np.ndarray, h: np.ndarray, spelt: np.ndarray) -> np.ndarray:
        """Averaged predictive of words met in training."""
        base, total = 10.0**spelt, np.zeros(len(n))
        for s in range(BURN, BURN + SAMPLES):
            t = self.seated(s, k, n, h, base)
            total += (n - self.discount * t) / (self.strength + self.n[k])
        return np.log10(np.maximum(total / SAMPLES + self.left(k) * base, 1e-300))


def _with_class(counts: DataFrame, frequent: np.ndarray) -> DataFrame:
    rare = counts.where(~F.col("h").isin([int(x) for x in frequent.view(np.int64)])) if len(frequent) else counts
    return rare.withColumn("class", F.conv(F.hex(F.expr("substring(word, length(word), 1)")), 16, 10).cast("int"))


def fit_classes(rare: DataFrame, speller: Speller) -> Classes:
    """Sweeps over the table of words; a sweep's tables are summed by class, 256 rows, before the next."""
    got = rare.groupBy("class").agg(F.sum("n"), F.count("*"), F.sum((F.col("n") == 1).cast("long")), F.sum((F.col("n") == 2).cast("long"))).collect()
    n, t = np.zeros(256), np.zeros(256)
    one = two = 0
    for k, total, words, ones, twos in got:
        n[k], t[k], one, two = total, words, one + ones, two + twos
    out = Classes(n, [t], discount_of(np.repeat([1, 2], [min(one, 10**6), int(min(one, 10**6) * two / max(one, 1))])))
    shared = rare.sparkSession.sparkContext.broadcast(speller)
    for sweep in range(BURN + SAMPLES):
        now = Classes(out.n, list(out.tables), out.discount)

        def run(batches: Iterator[pa.RecordBatch], sweep: int = sweep, now: Classes = now) -> Iterator[pa.RecordBatch]:
            total = np.zeros(256)
            for b in _larger(batches):
                word, n, h, k = (b.column(i) for i in range(4))
                k = k.to_numpy()
                t = now.seated(sweep, k, n.to_numpy().astype(float), h.to_numpy(), 10.0 ** shared.value.log10(word.to_pylist()))
                total += np.bincount(k, t, 256)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(256, dtype=np.int32)), pa.array(total)], ["class", "t"])

        t = np.zeros(256)
        for k, x in rare.select("word", "n", "h", "class").mapInArrow(run, "class int, t double").groupBy("class").agg(F.sum("t")).collect():
            t[k] = x
        out.tables.append(t)
    return out


@dataclass
class Shared:
    """What every task has: symbols' log10 probabilities by (context, symbol), and words from one in BROADCAST tokens on."""

    frequent: np.ndarray
    table: np.ndarray | None
    speller: Speller
    classes: Classes
    hashes: np.ndarray
    counts: np.ndarray
    words: np.ndarray
    n_all: int
    n_distinct: int
    n_ends: int
    #: Symbols of the words of ``hashes``; the pairs' discount.
    symbols: np.ndarray
    discount: float = 0.5
    #: By id, start first: customers of the broadcast words' restaurants and what each leaves to the parent. Sorted keys of the
    #: broadcast pairs and what their restaurant gives them.
    customers: np.ndarray | None = None
    left: np.ndarray | None = None
    pairs: np.ndarray | None = None
    given: np.ndarray | None = None

    def parts(self) -> int:
        """Parts that keys are dealt to."""
        return min(PARTS, 16 + self.n_all // PART)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + ADD) / (self.n_all + ADD * (self.n_distinct + 1)))


def fit_pairs(pairs: DataFrame, words: DataFrame, shared: Shared) -> DataFrame:
    """Seats every restaurant of a word's followers, and puts the broadcast words' and pairs' shares into ``shared``. The table
    (u, w, n, p, left): of each pair met more than once or asked for, what its restaurant gives it, and where both words are rare what the
    restaurant leaves to the parent; of each context, with null w, its customers and what it leaves. A pair met once has one table
    in every sweep, so it needs no row of its own.

    A restaurant's base does not change, so all its sweeps are one pass over its rows, which meet in one task."""
    one, two = pairs.agg(F.sum(F.when(F.col("w").isNull(), F.col("n"))), F.sum((F.col("w").isNotNull() & (F.col("n") == 2)).cast("long"))).first()
    one, two = one or 0, two or 0
    shared.discount = d = min(0.95, max(0.05, one / (one + 2 * two))) if one else 0.5
    m = pairs.sparkSession.sparkContext.broadcast(replace(shared, speller=None, classes=None))
    size = len(shared.hashes)
    far = F.col("w").isNotNull() & ~F.col("w").between(0, size) & ~F.col("ask")
    near = pairs.where(~far).select("u", "w", "n", "ask", F.lit(None).cast("double").alias("lp"), F.lit(None).cast("int").alias("symbol"))
    rare = pairs.where(far).join(words.select("h", "lp", "symbol"), F.col("w") == F.col("h")).select("u", "w", pairs["n"], "ask", "lp", "symbol")

    def seated(rows: pa.Table) -> pa.RecordBatch:
        x = m.value
        single, ask = rows["w"].is_null().to_numpy(), rows["ask"].to_numpy()
        u, w, n, lp, symbol = (rows[c].fill_null(0).to_numpy() for c in ("u", "w", "n", "lp", "symbol"))
        n = n.astype(float)
        met = (w >= 0) & (w <= size)
        place = np.where(met & (w > 0), w - 1, 0)
        at = np.append(x.words, 0.0)[place] if size else np.zeros(len(w))
        lp = np.where(w == 0, 0.0, np.where(met, at, lp))
        symbol = np.where(w == 0, x.table.shape[1] - 1, np.where(met, np.append(x.symbols, 0)[place], symbol))
        f = len(x.frequent)
        inner = (u >= 0) & (u <= size)
        own = np.append(x.symbols, f)[np.where(inner & (u > 0), u - 1, size)]
        context = np.where(u == 0, 2 * f, np.where(own < f, own, len(x.table) - 1))
        base = 10.0 ** (x.table[context, symbol] + lp)
        begins = np.append(True, u[1:] != u[:-1])
        g = np.cumsum(begins) - 1
        total = 1.0 + np.bincount(g, np.where(ask, 0.0, n))
        real = ~single & ~ask
        t = np.where(single, n, np.where(ask, 0.0, 1.0))
        key = mixed(_pair_key(u[real], w[real]))
        gives, leaves = np.zeros(len(n)), np.zeros(len(total))
        for sweep in range(BURN + SAMPLES):
            weight = (1.0 + d * np.bincount(g, t)[g[real]]) * base[real]
            t[real] = seat(n[real], weight, d, key, sweep)
            if sweep >= BURN:
                gives += (n - d * t) / SAMPLES
                leaves += (1.0 + d * np.bincount(g, t)) / SAMPLES
        gives, leaves = np.where(ask, np.where(n > 0, 1 - d, 0.0), gives) / total[g], leaves / total
        named = ~single
        left = pa.array(leaves[g][named], mask=(inner | met)[named])
        cols = [np.concatenate([u[named], u[begins]]), pa.concat_arrays([pa.array(w[named]), pa.nulls(len(total), pa.int64())]), np.concatenate([n[named], total - 1]).astype(np.int64), np.concatenate([gives[named], leaves]), pa.concat_arrays([left, pa.nulls(len(total), pa.float64())])]
        cols = [pa.array(c) if isinstance(c, np.ndarray) else c for c in cols]
        return pa.RecordBatch.from_arrays([*cols[:3], *(c.cast(pa.float32()) for c in cols[3:])], ["u", "w", "n", "p", "left"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, most = [], 0, SEATED
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            total += b.num_rows
            if total >= most:
                rows = pa.Table.from_batches(held).combine_chunks()
                u = rows["u"].to_numpy()
                cut = int(np.searchsorted(u, u[-1]))  # the last restaurant may go on
                if cut:
                    yield seated(rows.slice(0, cut).combine_chunks())
                held, total = rows.slice(cut).to_batches(), len(u) - cut
                most = max(SEATED, 2 * total)
        if held:
            yield seated(pa.Table.from_batches(held).combine_chunks())
        trim()

    rows = near.union(rare).repartition("u").sortWithinPartitions("u")
    out = staged(rows.mapInArrow(run, "u bigint, w bigint, n bigint, p float, left float"), "restaurants")
    m.destroy()
    u, n, p = _arrays(out.where(F.col("w").isNull() & F.col("u").between(0, size)).select("u", "n", "p"))
    shared.customers, shared.left = np.zeros(size + 1), np.ones(size + 1)
    shared.customers[u.astype(np.int64)], shared.left[u.astype(np.int64)] = n, p.astype(float)
    u, w, p = _arrays(out.where(F.col("w").isNotNull() & (F.col("n") > 0) & (F.col("n") * BROADCAST >= F.lit(shared.n_all))).select("u", "w", "p"))
    key = _pair_key(u.astype(np.int64), w.astype(np.int64))
    order = np.argsort(key)
    shared.pairs, shared.given = key[order], p.astype(float)[order]
    return out


def fit_symbols(code: np.ndarray, n: np.ndarray, s: Symbols) -> np.ndarray:
    """log10 probabilities by (context, symbol); the last row is that of no context."""
    m = Model(code // s.size, code % s.size, n, [s.contexts, 1], [np.zeros(s.contexts, np.int64)], s.size)
    p = np.concatenate([m.predictive(), m.dense(1)])
    return np.log10(np.maximum(p, 1e-300)).astype(np.float32)


def fit(docs: DataFrame, asked: DataFrame | None = None) -> tuple[Shared, DataFrame, DataFrame]:
    """The model of ``docs`` (a column text), the table (h, n, lp, symbol) of words below the broadcast share, and that of the
    restaurants, with what it takes to score ``docs`` and the texts ``asked``, which are not learnt from."""
    small_batches(docs.sparkSession)
    counts = staged(count_words(docs), "words")
    n_ends = docs.count()
    total, distinct = counts.agg(F.sum("n"), F.count("*")).first()
    n_all, n_distinct = (total or 0) + n_ends, distinct + (n_ends > 0)
    frequent = np.sort(np.array([r[0] for r in counts.where(F.col("n") * FREQUENT >= F.lit(n_all)).select("h").collect()], np.int64).view(_U))
    rare = _with_class(counts, frequent)
    speller = fit_speller(*_letters(rare))
    classes = fit_classes(rare, speller)
    spark = docs.sparkSession
    shared_speller, shared_classes = spark.sparkContext.broadcast(speller), spark.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _larger(batches):
            word, n, h, k = (b.column(i).combine_chunks() for i in range(4))
            lp = shared_classes.value.log10(k.to_numpy(), n.to_numpy().astype(float), h.to_numpy(), shared_speller.value.log10(word.to_pylist()))
            yield pa.RecordBatch.from_arrays([h, n, pa.array(lp), pa.array(k.to_numpy() + len(frequent), pa.int32())], ["h", "n", "lp", "symbol"])

    known = spark.createDataFrame([(int(x), i) for i, x in enumerate(frequent.view(np.int64))], "f bigint, symbol int")
    own = counts.join(F.broadcast(known), F.col("h") == F.col("f")).select("h", "n", F.lit(0.0), "symbol")
    words = staged(rare.select("word", "n", "h", "class").mapInArrow(run, "h bigint, n bigint, lp double, symbol int").union(own), "words-scored")
    often = F.col("n") * BROADCAST >= F.lit(n_all)
    h, c, lp, symbol = _arrays(words.where(often))
    h = h.astype(np.int64).view(_U)
    order = np.argsort(h)
    shared = Shared(frequent, None, speller, classes, h[order], c[order].astype(float), lp[order].astype(float), n_all, n_distinct, n_ends, symbol[order].astype(np.int64))
    drop_staged(counts)
    words = words.where(~often)
    texts = docs.select(F.col("text").cast("binary").alias("raw"), F.lit(False).alias("aside"))
    if asked is not None:
        texts = texts.union(asked.select(F.col("text").cast("binary"), F.lit(True)))
    pairs = staged(count_pairs(texts, frequent, shared.hashes, shared.parts()), "pairs")
    shared.table = fit_symbols(*_arrays(pairs.where(F.col("ask").isNull()).select("u", "n")), Symbols(frequent, shared.hashes))
    restaurants = fit_pairs(pairs.where(F.col("ask").isNotNull()), words, shared)
    drop_staged(pairs)
    return shared, words, restaurants


def _model_blobs(restaurants: DataFrame, words: DataFrame, shared: Shared) -> DataFrame:
    """The tables as blobs: pairs that are not broadcast (key, p, left), contexts (u, p, customers), words (h, n, lp), each where the
    tokens are dealt that look it up: by a rare word, else by a rare context, else by the pair."""
    size, parts, n_all = len(shared.hashes), shared.parts(), shared.n_all

    def dealt(kind: int, part: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(columns[0])
        return _dealt(part[order], kind, *(c[order].view(np.int64) for c in columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _larger(batches):
            u, n, p = b["u"].to_numpy(), b["n"].to_numpy(), b["p"].to_numpy().astype(float)
            alone = b["w"].is_null().to_numpy()
            w, left = b["w"].fill_null(0).to_numpy(), b["left"].fill_null(0.0).to_numpy().astype(float)
            far = (w < 0) | (w > size)
            out = (u < 0) | (u > size)
            x = alone & out
            yield dealt(CONTEXT, _part(u[x], parts), u[x], p[x], n[x])
            x = ~alone & ((n == 0) | (n * BROADCAST < n_all))
            key = _pair_key(u[x], w[x]).view(np.int64)
            yield dealt(PAIR, _part(np.where(far[x], w[x], np.where(out[x], u[x], key)), parts), key, p[x], left[x])

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _larger(batches):
            h = b["h"].to_numpy()
            yield dealt(NAMED, _part(h, parts), h, b["n"].to_numpy(), b["lp"].to_numpy().astype(np.float32).astype(float))

    return restaurants.mapInArrow(run, BLOB).union(words.select("h", "n", "lp").mapInArrow(name, BLOB))


def score_texts(docs: DataFrame, shared: Shared, words: DataFrame, restaurants: DataFrame, held_out: str) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text, and the flag ``held_out``, set for no text that was learnt from).

    Broadcast pairs of broadcast words are looked up; the other tokens are dealt to the parts of the tables: by the word if it is rare,
    else by the word before if that is rare, else by the pair. By their counts none of those is frequent, so no key is hot. A pair of a
    learnt text that is not in the table was met once, that of another text never. The parts' sums meet by block of texts.
    """
    size, d, parts = len(shared.hashes), shared.discount, shared.parts()
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(shared)
    light = spark.sparkContext.broadcast(replace(shared, speller=None, classes=None, pairs=None, given=None))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        s = Symbols(m.frequent, m.hashes)
        base, lp = np.append(m.base(np.array([m.n_ends])), m.base(m.counts)), np.append(0.0, m.words)
        known = np.append(m.n_ends > 0, np.ones(size, bool))
        held: tuple[list, list, list] = ([], [], [])
        total = 0

        def give() -> Iterator[pa.RecordBatch]:
            for kind, got in zip((BY_PAIR, BY_CONTEXT, BY_WORD), held, strict=True):
                if got:
                    key, part, *more = (np.concatenate(c) for c in zip(*got, strict=True))
                    order = np.argsort(key)
                    yield _dealt(part[order], kind, key[order], *(c[order] for c in more))
                got.clear()

        for b in batches:
            aside, rows = b.column(2).to_numpy(zero_copy_only=False), b.column(3).to_numpy()
            ids, no_id = b.column(0).fill_null(0).to_numpy(), b.column(0).is_null().to_numpy(zero_copy_only=False)
            for i, j, texts in _texts(b.column(1)):
                t = s.read(texts)
                u, w = t.u, t.w
                far, out = (w < 0) | (w > size), (u < 0) | (u > size)
                of = t.text
                flags = np.where(far, t.symbol << 32, 0) | t.context << 1 | aside[i:j][of]  # others' symbols are known to all
                near = np.flatnonzero(~far & ~out)
                p, q = u[near], w[near]
                hit, at = _met(m.pairs, _pair_key(p, q))
                yes, at = near[hit], at[hit]
                parent = m.table[t.context[yes], t.symbol[yes]] + lp[w[yes]]
                score = np.bincount(of[yes], np.log10(m.given[at] + m.left[u[yes]] * 10.0**parent), j - i)
                broad = ~far
                sums = np.bincount(of[broad], base[w[broad]], j - i), np.bincount(of[broad], known[w[broad]], j - i).astype(np.int64)
                whole = rows[i:j], ids[i:j], no_id[i:j] << np.int64(1) | aside[i:j], np.bincount(of, minlength=j - i), sums[1], sums[0].view(np.int64), score.view(np.int64)
                yield _dealt(rows[i:j] >> TEXTS, TEXT, *(c.astype(np.int64) for c in whole))
                no = near[~hit]
                code = u[no] * (size + 1) + w[no]
                held[0].append((code, _part(_pair_key(u[no], w[no]), parts), rows[i:j][of[no]], flags[no]))
                no = np.flatnonzero(~far & out)
                held[1].append((u[no], _part(u[no], parts), w[no], rows[i:j][of[no]], flags[no]))
                no = np.flatnonzero(far)
                spelt = np.zeros(len(no))
                new = np.flatnonzero(aside[i:j][of[no]])
                spell = t.words(no[new])
                spelt[new] = (m.speller.log10(spell) + np.log10(m.classes.left(np.array([x[-1] for x in spell], np.int64)))).astype(np.float32)
                held[2].append((w[no], _part(w[no], parts), u[no], rows[i:j][of[no]], flags[no], spelt.view(np.int64)))
                total += len(u)
                if total >= PAIRS:
                    yield from give()
                    total = 0
        yield from give()
        trim()

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = light.value
        lp, once = np.append(0.0, m.words), (1 - d) / (1.0 + m.customers)
        symbols = np.append(m.table.shape[1] - 1, m.symbols)
        now, tables, ready = None, ([], [], []), None
        sums: list[tuple] = []
        total = 0

        def summed() -> list[np.ndarray]:
            row, known, base, score = (np.concatenate(c) for c in zip(*sums, strict=True))
            rows, at = np.unique(row, return_inverse=True)
            return [rows, *(np.bincount(at, x, len(rows)) for x in (known, base, score))]

        def give() -> pa.RecordBatch:
            row, known, base, score = summed()
            return _dealt(row >> TEXTS, TEXT + 1, row, known.astype(np.int64), base.view(np.int64), score.view(np.int64))

        for b in batches:
            for part, kind, n, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if kind == TEXT:
                    yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([kind], pa.int32()), pa.array([n], pa.int32()), pa.array([raw], pa.binary())], ["part", "kind", "n", "raw"])
                    continue
                if part != now:
                    now, tables, ready = part, ([], [], []), None
                if kind <= NAMED:
                    tables[kind].append(_unpack(raw, n, 3))
                    continue
                if ready is None:
                    ready = [_joined(x, 3) for x in tables]
                    tables = ([], [], [])
                (key, gives, leaves), (of_u, left_of, customers), (of_w, count, spelling) = ready
                known, base = np.zeros(n, np.int64), np.zeros(n)
                if kind == BY_PAIR:
                    code, row, flags = _unpack(raw, n, 3)
                    u, w = code // (size + 1), code % (size + 1)
                elif kind == BY_CONTEXT:
                    u, w, row, flags = _unpack(raw, n, 4)
                else:
                    w, u, row, flags, spelt = _unpack(raw, n, 5)
                aside = (flags & 1).astype(bool)
                hit, at = _met(key, _pair_key(u, w).view(np.int64))
                if kind == BY_CONTEXT:
                    there, k = _met(of_u, u)
                    left, single = np.ones(n), np.zeros(n)
                    left[there] = left_of.view(float)[k[there]]
                    single[there] = (1 - d) / (1.0 + customers[k[there]])
                else:
                    inner = (u >= 0) & (u <= size)
                    left, single = np.where(inner, m.left[np.where(inner, u, 0)], 1.0), np.where(inner, once[np.where(inner, u, 0)], 0.0)
                    two = hit & ~inner
                    left[two] = leaves.view(float)[at[two]]
                if kind == BY_WORD:
                    there, k = _met(of_w, w)
                    symbol, own = flags >> 32, spelt.view(float).copy()
                    own[there] = spelling.view(float)[k[there]]
                    c = np.zeros(n)
                    c[there] = count[k[there]]
                    base, known = m.base(c), there.astype(np.int64)
                else:
                    symbol, own = symbols[w], lp[w]
                given = np.where(aside, 0.0, single)
                given[hit] = gives.view(float)[at[hit]]
                parent = m.table[flags >> 1 & 0x7FFFFFFF, symbol] + own
                sums.append((row, known, base, np.log10(given + left * 10.0**parent)))
                total += n
                if total >= 2 * SUMS:
                    sums = [tuple(summed())]
                    total = len(sums[0][0])
                    if total >= SUMS:
                        yield give()
                        sums, total = [], 0
        if sums:
            yield give()
        trim()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, more = None, [], []

        def give() -> pa.RecordBatch:
            row, ids, flags, n, known, base, score = _joined(own, 7)
            base, score = base.view(float).copy(), score.view(float).copy()
            for at, k, x, y in more:
                at = np.searchsorted(row, at)  # each row once
                known[at] += k
                base[at] += x.view(float)
                score[at] += y.view(float)
            cols = [pa.array(ids, mask=flags >> 1 == 1), pa.array((flags & 1).astype(bool)), pa.array(n), pa.array(known), pa.array(base), pa.array(score)]
            return pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

        for b in batches:
            for part, kind, n, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if part != now:
                    if own:
                        yield give()
                    now, own, more = part, [], []
                (own if kind == TEXT else more).append(_unpack(raw, n, 7 if kind == TEXT else 4))
        if own:
            yield give()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("raw"), F.col(held_out).alias("aside"), F.monotonically_increasing_id().alias("id"))
    blobs = _model_blobs(restaurants, words, shared).union(rows.mapInArrow(send, BLOB))
    sums = blobs.repartition("part").sortWithinPartitions("part", "kind").mapInArrow(look, BLOB)
    out = sums.repartition("part").sortWithinPartitions("part", "kind").mapInArrow(meet, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(shared.n_all).cast("long").alias("train_tokens"), "base_score", "score")


def perplexity(scores: DataFrame) -> DataFrame:
    """Perplexity a token of held-out and learnt texts under the model and under the base, from the rows of ``lm_scores``."""
    by = scores.groupBy("held_out").agg(F.sum("n_tokens").alias("tokens"), F.sum("score").alias("s"), F.sum("base_score").alias("b"))
    return by.select("held_out", "tokens", F.expr("pow(10, -s / tokens)").alias("perplexity"), F.expr("pow(10, -b / tokens)").alias("base_perplexity"))


def lm_scores(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Null and empty texts are an
    end alone; ids may be null or repeat; other columns are not read; with nothing to learn from, symbols and spellings
    are alike; an empty table gives an empty result."""
    d = docs.select("doc_id", "text", (fold(F.col("doc_id"), 10) == 0).alias("aside"))
    shared, words, restaurants = fit(d.where("NOT aside"), d.where("aside"))
    return score_texts(d, shared, words, restaurants, "aside")


def op6(spark, sf_dir):
    from intervale.llm.common import table

    return lm_scores(table(spark, sf_dir, "documents"))
