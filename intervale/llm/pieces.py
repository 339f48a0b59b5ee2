"""SentencePiece encoding and decoding of merge-type models: exact backtracking over longest matches, with adjacent pieces
checked by merging them again and failed positions kept in a bit field."""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator, Sequence
from functools import cache
from hashlib import sha256

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from intervale.llm.common import pieces_of, small_batches, trim

META = "▁"
#: Distinct chunks a Python worker keeps encoded in each of its two generations.
CACHE = 250_000
#: Pairs of pieces whose fit is remembered; when full, the memory starts anew.
FITS = 1_000_000


class Pieces:
    """Encoder and decoder of a SentencePiece model of the BPE type with byte fallback and identity normalisation.

    Only the model's table is taken from the library: pieces, scores and kinds. A text is a META, then the text with
    spaces as METAs. No piece has a META behind another character, so texts fall apart before each run of METAs, and at
    characters that no piece has; the chunks between are encoded alone.
    """

    def __init__(self, path: str):
        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.vocab_size()
        normal = [i for i in range(n) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        #: In here, METAs are spaces: the two are one in a normalised text.
        self.piece = {i: m.id_to_piece(i).replace(META, " ") for i in normal}
        self.score = {i: m.get_score(i) for i in normal}
        self.id = {p: i for i, p in self.piece.items()}
        self.byte = {int(m.id_to_piece(i)[3:5], 16): i for i in range(n) if m.is_byte(i)}
        self.of_byte = {i: b for b, i in self.byte.items()}
        if len(self.byte) != 256 or any(" " in p.lstrip(" ") for p in self.id) or any(c not in self.id for p in self.id for c in p):
            raise ValueError("not a model of byte fallback whose pieces only begin with white space")
        if m.encode("a  Å") != [*m.encode("a  "), *m.encode("Å")[1:]] or m.decode(m.encode(" Å")) != " Å":
            raise ValueError("the model normalises its input")
        counts: dict[float, int] = {}
        for s in self.score.values():
            counts[s] = counts.get(s, 0) + 1
        #: Pieces whose score another has too: which merge comes first then hangs on its place, and a chunk that holds such a piece is merged as a whole.
        self.tied = {i for i in normal if counts[self.score[i]] > 1 and len(self.piece[i]) > 1}
        self.single = {p: i for p, i in self.id.items() if len(p) == 1}
        self.chars = frozenset(self.single)
        #: Pieces that merging their own characters gives; others never come out.
        self.whole = {p: i for p, i in self.id.items() if i not in self.tied and self.merge(p) == [i]}
        self.size = {i: len(p) for p, i in self.whole.items()}
        self.shorter = {i: next((self.whole[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in self.whole), None) for p, i in self.whole.items()}
        #: Longer pieces with their size less one, or -1 where tied; single characters need no search.
        self.auto = ahocorasick.Automaton()
        for p, i in self.id.items():
            if len(p) > 1 and (p in self.whole or i in self.tied):
                self.auto.add_word(p, (-1 if i in self.tied else len(p) - 1, i))
        self.auto.make_automaton()
        self.raw = {i: p.encode() for i, p in self.piece.items()}
        self.decimal = {i: str(i).encode() for i in [*self.piece, *self.of_byte]}
        self.fits: dict[int, bool] = {}
        self.keep = CACHE
        self.young: dict = {}
        self.old: dict = {}
        self.split = re.compile(" *[^ \n]+| +|\n" if "\n" not in self.single else " *[^ ]+| +")

    def merge(self, text: str) -> list[int]:
        """The definition: of all neighbours whose join is a piece, the best by score, then the leftmost, are joined
        first. Characters that aren't pieces stay apart as their bytes."""
        part: list[str | None] = list(text)
        after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if i >= 0 and j < len(part) and (k := self.id.get(joined := part[i] + part[j])) is not None:
                heapq.heappush(heap, (-self.score[k], i, joined))

        for i in range(len(part)):
            offer(i)
        while heap:
            _, i, joined = heapq.heappop(heap)
            j = after[i] if part[i] is not None else len(part)
            if j >= len(part) or part[i] + part[j] != joined:
                continue
            part[i], part[j] = joined, None
            after[i] = after[j]
            if after[i] < len(part):
                before[after[i]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        out: list[int] = []
        for p in part:
            if p is not None:
                out += [self.id[p]] if p in self.id else [self.byte[b] for b in p.encode()]
        return out

    def fit(self, a: int, b: int) -> bool:
        """Whether merging the characters of piece a followed by piece b gives these two again."""
        key = a << 20 | b
        if (known := self.fits.get(key)) is None:
            if len(self.fits) >= FITS:
                self.fits.clear()
            known = self.fits[key] = self._apart(a, b)
        return known

    def _apart(self, a: int, b: int) -> bool:
        """Merge a's and b's characters again, side by side: the pieces fit if each side ends as its piece before any
        merge across the border would come first."""
        return self.merge(self.piece[a] + self.piece[b]) == [a, b]

    def _run(self, text: str) -> list[int]:
        """Backtracking over a run of known characters: at each place the longest piece, then its ever shorter prefixes,
        until one fits the piece before; a place where none does is marked failed and left for the one before."""
        longest: list[int] = list(map(self.single.__getitem__, text))
        for last, (k, i) in self.auto.iter(text):  # by ends, so of those that start at one place the longest comes last
            if k < 0:
                return self.merge(text)
            longest[last - k] = i
        n = len(text)
        longest.append(-1)
        size, shorter, fits = self.size, self.shorter, self.fits
        open_at = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        pos, token = 0, longest[0]
        while pos < n:
            if out:
                before = out[-1]
                key = before << 20
                while token is not None:
                    if open_at[pos + size[token]]:
                        known = fits.get(key | token)
                        if known or known is None and self.fit(before, token):
                            break
                    token = shorter[token]
            else:
                while token is not None and not open_at[pos + size[token]]:
                    token = shorter[token]
            if token is not None:
                out.append(token)
                pos += size[token]
                token = longest[pos]
            else:
                open_at[pos] = 0
                token = out.pop()
                pos -= size[token]
        return out

    def chunk(self, text: str) -> list[int]:
        """Ids of a chunk."""
        if self.chars.issuperset(text):
            return self._run(text)
        out: list[int] = []
        run: list[str] = []
        for c in text:
            if c in self.single:
                run.append(c)
                continue
            if run:
                out += self._run("".join(run))
                run = []
            out += [self.byte[b] for b in c.encode()]
        return out + (self._run("".join(run)) if run else [])

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text, as the library gives them without begin and end."""
        return [i for c in self._chunks(text) for i in self.chunk(c)]

    def _chunks(self, text: str) -> list[str]:
        return self.split.findall(" " + text.replace(META, " ")) if text else []

    def _bytes(self, ids: Sequence[int]) -> bytes:
        """The pieces' text in UTF-8, METAs as spaces; bytes that don't form a character become U+FFFD each."""
        out: list[bytes] = []
        held = bytearray()

        def flush() -> None:
            while held:
                for k in (1, 2, 3, 4):
                    try:
                        out.append(bytes(held[:k]).decode().encode())
                    except UnicodeDecodeError:
                        continue
                    del held[:k]
                    break
                else:
                    out.append("�".encode())
                    del held[:1]

        for i in ids:
            if i in self.of_byte:
                held.append(self.of_byte[i])
                continue
            flush()
            out.append(self.raw.get(i, b""))
        flush()
        return b"".join(out)

    def decode(self, ids: Sequence[int]) -> str:
        """Text of the ids as the library gives it: the METAs as spaces, without the one that encoding put in front."""
        text = self._bytes(ids).decode()
        return text[1:] if ids and self.piece.get(ids[0], "").startswith(" ") else text

    def _looked_up(self, text: str, make) -> list:
        """``make(chunk)`` of each chunk of a text, from memory for those met lately. The memory has two generations of CACHE
        chunks; a process uses it with one ``make``."""
        get, got = self.young.get, []
        for c in self._chunks(text):
            x = get(c)
            if x is None:
                x = self.old.get(c)
                if x is None:
                    x = make(c)
                if len(c) <= 64:
                    if len(self.young) >= self.keep:
                        self.old, self.young = self.young, {}
                        get = self.young.get
                    self.young[c] = x
            got.append(x)
        return got

    def _known(self, chunk: str) -> tuple[int, bytes, bytes]:
        """(number of ids, ids in decimal joined by commas, decoded bytes) of a chunk."""
        ids = self.chunk(chunk)
        try:
            raw = b"".join(map(self.raw.__getitem__, ids))
        except KeyError:  # bytes
            raw = self._bytes(ids)
        return len(ids), b",".join(map(self.decimal.__getitem__, ids)), raw

    def digest(self, text: str) -> tuple[int, str, str]:
        """(number of ids, SHA-256 of the ids in decimal joined by commas, SHA-256 of the decoded text) of a whole text."""
        got = self._looked_up(text, self._known)
        ids = b",".join([x[1] for x in got])
        back = b"".join([x[2] for x in got]).removeprefix(b" ")
        return sum([x[0] for x in got]), sha256(ids).hexdigest(), sha256(back).hexdigest()

    def forget(self) -> None:
        self.young, self.old, self.fits = {}, {}, {}

    def packed(self, text: str) -> bytes:
        """Ids of a whole text as 32-bit integers."""
        return b"".join(self._looked_up(text, lambda c: array("i", self.chunk(c)).tobytes()))


@cache
def load(path: str, use: str = "") -> Pieces:
    """The model at ``path``, once a Python process and use of its memory."""
    return Pieces(path)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_texts(docs: DataFrame, model: str | None = None, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the ids of each whole text in the column ``ids``, which replaces one of that name; null counts as empty."""
    path = model or default_model()
    if ids == text:
        raise ValueError("the ids need a column of their own")
    docs = docs.drop(ids)
    small_batches(docs.sparkSession)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(path, "ids")
        m.keep = CACHE // 3  # these workers also hold the ids themselves
        for b in batches:
            for i, j in pieces_of([len(t.as_py() or "") for t in b.column(at)], 1 << 20):
                part = b.slice(i, j - i)
                packed = [m.packed(t.as_py() or "") for t in part.column(at)]
                ends = np.cumsum([0, *(len(x) // 4 for x in packed)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, ids])
        m.forget()  # later stages use the worker's memory for other things
        trim()

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add(ids, ArrayType(IntegerType())))


def decode_ids(df: DataFrame, model: str | None = None, ids: str = "ids", text: str = "text") -> DataFrame:
    """``df`` with the text that each list of ids decodes to in the column ``text``; null counts as no ids."""
    path = model or default_model()

    @F.pandas_udf("string")
    def run(s):
        m = load(path)
        return s.map(lambda x: m.decode(x.tolist()))

    return df.withColumn(text, run(F.coalesce(F.col(ids), F.array().cast("array<int>"))))


ENCODED = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def digests(docs: DataFrame, model: str | None = None) -> DataFrame:
    """One row for each document: doc_id, n_tokens, ids_sha256, decoded_sha256. Narrow; each worker keeps the chunks it has
    met lately, in a cache of fixed size, so a frequent word is encoded once. Null and empty texts have no ids; ids of
    documents may be null or repeat; other columns aren't read."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(path)
        for b in batches:
            rows = [m.digest(t.as_py() or "") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, ENCODED)


def op9(spark, sf_dir):
    from intervale.llm.common import table

    return digests(table(spark, sf_dir, "documents"))
