"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by stochastic gradient descent
in numpy, with a temperature and a rejection threshold calibrated on rows set aside."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intervale.llm.common import fold, pieces_of

#: Buckets of hashed byte n-grams, their lengths, and the width of an embedding.
BUCKETS, LENGTHS, WIDTH = 1 << 14, (2, 3, 4), 16
#: The training sample: about so many rows a language, the characters taken of a text, and of a longer one in how many pieces spread over it.
ROWS_A_LANGUAGE, LONGEST, PARTS = 400, 12_000, 6
#: Bytes of a training segment and how many a text gives at most, drawn from all of it; passes, rate; and the share of right answers
#: that calibration may reject.
SEGMENT, SEGMENTS, PASSES, RATE, REJECT = 240, 6, 6, 4.0, 0.01
#: Bytes of text worked on at a time.
PIECE = 1 << 20
LETTER = regex.compile(r"\p{L}")


def grams(buf: np.ndarray) -> Iterator[np.ndarray]:
    """For each length the bucket of the byte n-gram that begins at each byte, or BUCKETS where it would have white space
    inside; space at an end marks a word's border. ``buf`` ends with padding for the longest."""
    n = len(buf) - max(LENGTHS)
    space = (buf == 32) | ((buf >= 9) & (buf <= 13))
    wide = np.where(space, 32, buf).astype(np.uint32)
    inside = np.zeros(n, bool)
    h = wide[:n] + np.uint32(1)
    for k in range(2, max(LENGTHS) + 1):
        h = h * np.uint32(0x01000193) ^ wide[k - 1 : n + k - 1]
        if k > 2:
            inside = inside | space[k - 2 : n + k - 2]
        if k in LENGTHS:
            x = (h ^ h >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
            at = (x >> np.uint32(18)).astype(np.int64)
            yield np.where(inside | (space[:n] & space[k - 1 : n + k - 1]), BUCKETS, at)


@dataclass
class Model:
    """``table``: what each bucket adds to the logits, a last row of zeros; ``least``: accepted from this score on."""

    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    heat: float
    least: float

    def logits(self, texts: list[bytes]) -> np.ndarray:
        """Logits of each whole text: the mean over its subwords, plus the bias."""
        sums = np.zeros((len(texts), len(self.langs) + 1))
        for i, j in pieces_of([len(t) for t in texts], PIECE):
            self._add(texts[i:j], sums[i:j])
        return sums[:, :-1] / np.maximum(sums[:, -1:], 1) + self.bias

    def _add(self, texts: list[bytes], sums: np.ndarray) -> None:
        pad = b" " * max(LENGTHS)
        if len(texts) == 1 and len(texts[0]) > 2 * PIECE:  # a very long text, in stretches that overlap by a gram less one
            for at in range(0, len(texts[0]), PIECE):
                stretch = texts[0][at : at + PIECE + max(LENGTHS)].lower()
                self._sum(np.frombuffer(stretch if at + PIECE + max(LENGTHS) <= len(texts[0]) else stretch[:PIECE] + pad, np.uint8), np.array([0]), sums)
            return
        joined = np.frombuffer((b" " + b"  ".join(texts) + pad + b" ").lower(), np.uint8)
        starts = np.cumsum([0, *(len(t) + 2 for t in texts[:-1])])
        self._sum(joined, starts, sums)

    def _sum(self, buf: np.ndarray, starts: np.ndarray, sums: np.ndarray) -> None:
        for at in grams(buf):
            sums += np.add.reduceat(self.table[at], starts, axis=0)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, calibrated score, rejected) of each text; ``und`` with score 0, rejected, for no letter."""
        x = self.logits([(t or "").encode() for t in texts]) / self.heat
        p = np.exp(x - x.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        none = ("und", 0.0, True)
        return [(self.langs[b], float(row[b]), bool(row[b] < self.least)) if t and LETTER.search(t) else none for t, b, row in zip(texts, best, p, strict=True)]


def _counts(segments: list[bytes]) -> np.ndarray:
    out = np.zeros((len(segments), BUCKETS), np.float32)
    pad = b" " * max(LENGTHS)
    for row, s in zip(out, segments, strict=True):
        for at in grams(np.frombuffer(b" " + s.lower() + pad + b" ", np.uint8)):
            row += np.bincount(at, minlength=BUCKETS + 1)[:-1]
        row /= max(row.sum(), 1)
    return out


def train(rows: list[tuple[str, str]], seed: int = 5) -> Model:
    """Fit to (text, lang) rows; each text gives itself, cut to segments of SEGMENT bytes. Without rows, a model that has
    no language but ``und``."""
    langs = sorted({lang for _, lang in rows})
    if not langs:
        return Model(["und"], np.zeros((BUCKETS + 1, 2)), np.zeros(1), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    segments, ys, aside = [], [], []
    for k, (text, lang) in enumerate(sorted(rows)):
        raw = text.encode()
        cuts = [raw[i : i + SEGMENT] for i in range(0, max(len(raw), 1), SEGMENT)]
        for s in [cuts[i] for i in rng.permutation(len(cuts))[:SEGMENTS]]:
            segments.append(s)
            ys.append(langs.index(lang))
            aside.append(k % 5 == 0)
    y, aside = np.array(ys), np.array(aside)
    learn, check = np.flatnonzero(~aside), np.flatnonzero(aside)
    if not len(learn) or not len(check):
        learn = check = np.arange(len(y))
    e = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    w = rng.normal(0, 0.1, (WIDTH, len(langs))).astype(np.float32)
    b = np.zeros(len(langs), np.float32)
    weight = (len(learn) / len(langs) / np.maximum(np.bincount(y[learn], minlength=len(langs)), 1)).astype(np.float32)
    steps, done = PASSES * -(-len(learn) // 64), 0
    for _ in range(PASSES):
        order = rng.permutation(learn)
        for lo in range(0, len(order), 64):
            pick = order[lo : lo + 64]
            x = _counts([segments[i] for i in pick])
            v = x @ e
            z = v @ w + b
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(pick)), y[pick]] -= 1
            p *= weight[y[pick], None] / len(pick)
            rate = np.float32(RATE * (1 - done / steps))
            dv = p @ w.T
            w -= rate * (v.T @ p)
            b -= rate * p.sum(axis=0)
            e -= np.float32(20) * rate * (x.T @ dv)
            done += 1
    table = np.zeros((BUCKETS + 1, len(langs) + 1))
    table[:-1, :-1], table[:-1, -1] = e @ w, 1
    model = Model(langs, table, b.astype(float), 1.0, 0.0)
    z = model.logits([segments[i] for i in check])
    best = (np.inf, 1.0, None)
    for heat in np.geomspace(0.05, 20, 60):
        p = np.exp((z - z.max(axis=1, keepdims=True)) / heat)
        p /= p.sum(axis=1, keepdims=True)
        loss = -np.log(np.maximum(p[np.arange(len(check)), y[check]], 1e-12)).mean()
        if loss < best[0]:
            best = (loss, heat, p)
    right = best[2].argmax(axis=1) == y[check]
    least = float(np.quantile(best[2].max(axis=1)[right], REJECT)) if right.any() else 0.0
    return Model(langs, table, b.astype(float), float(best[1]), least)


def sample(docs: DataFrame, per_language: int = ROWS_A_LANGUAGE, longest: int = LONGEST) -> list[tuple[str, str]]:
    """A bounded sample of (text, lang) from the rows that may be learnt from: by a hash of the id, about ``per_language``
    rows of each language and at most twice as many in all; texts of more than ``longest`` characters give so many, in PARTS
    pieces spread evenly from their beginning to their end. The rows are the same in every run."""
    d = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id"), 5) != 0))
    counts = dict(d.groupBy("lang").count().collect())
    if not counts:
        return []
    share = F.coalesce(*(F.when(F.col("lang") == lang, F.lit(min(1.0, per_language / n))) for lang, n in sorted(counts.items())))
    h = F.xxhash64("doc_id", "text", F.lit("langid"))
    d = d.where(F.pmod(h, F.lit(1 << 30)) / float(1 << 30) < share)
    size = longest // PARTS
    step = (F.length("text") - size) / (PARTS - 1)
    parts = F.concat_ws(" ", *(F.col("text").substr((step * k).cast("int") + 1, F.lit(size)) for k in range(PARTS)))
    d = d.select(h.alias("h"), F.when(F.length("text") <= longest, F.col("text")).otherwise(parts).alias("text"), "lang")
    return [(t, lang) for _, t, lang in d.orderBy("h", "lang", "text").limit(2 * per_language * len(counts)).collect()]


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """One row for each document: doc_id, held_out, lang_pred, score, rejected. Narrow; whole texts; null and letterless
    texts are ``und``; ids may be null or repeat; other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = [len(t.as_py() or "") for t in b.column(1)]
            for i, j in pieces_of(sizes, 4 * PIECE):
                part = b.slice(i, j - i)
                found = shared.value.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, lang_pred string, score double, rejected boolean")
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score", "rejected")


def op4(spark, sf_dir):
    from intervale.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs, train(sample(docs)))
