"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs, trained in numpy,
that scores all overlapping windows of a text; a text's score is its worst window's."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intervale.llm.common import fold, free_name, pieces_of, small_batches, trim

#: Words of a window and words between starts of windows.
STRIDE = 16
WINDOW = 2 * STRIDE
#: Widths: word embedding, character embedding, hidden state of each direction; buckets of hashed byte trigrams.
WORD, CHAR, HIDDEN, BUCKETS = 8, 8, 8, 4096
#: The training sample: rows of either label at most, and the characters taken of a text; of a longer one PARTS pieces spread over it.
POSITIVES, NEGATIVES, LONGEST, PARTS = 1000, 2000, 6000, 4
#: Words in the vocabulary at most; the share of sampled texts a word must be in.
VOCABULARY, LEAST_SHARE = 4096, 1 / 150
#: Windows of the first pass, or one a text if there are more texts: first one of each text, then a second, and so on.
FIRST = 16_000
#: Passes over one window a text after the first, and the learning rate.
PASSES, RATE = 10, 0.01
#: Slots of a table that finds vocabulary words by hash.
SLOTS = 1 << 15
#: Bytes of text worked on at a time.
PIECE = 1 << 19
#: Decimals of a score; the sums behind it depend in the last bits on what else is worked on at a time.
DECIMALS = 5
_U = np.uint64
_rng = np.random.default_rng(20)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)
_POWER = np.concatenate([[_U(1)], np.cumprod(np.full(255, 0x9E3779B97F4A7C15, _U), dtype=_U)])
#: Letters, digits and all bytes beyond ASCII make words.
_IN_WORD = np.array([chr(c).isalnum() if c < 128 else True for c in range(256)])
_PLAIN = bytes(c if _IN_WORD[c] else 32 for c in range(256))


@dataclass
class Words:
    """Words of several texts: ``doc`` of each, ``hash``, and the trigram buckets ``tri`` centred on its bytes, of which word i has those
    from ``at[i]`` on."""

    doc: np.ndarray
    hash: np.ndarray
    tri: np.ndarray
    at: np.ndarray


def words_of(texts: list[bytes]) -> Words:
    buf = np.frombuffer((b" " + b" ".join(texts) + b" ").lower(), np.uint8)
    inside = _IN_WORD[buf]
    starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    if not len(starts):
        return Words(*(np.empty(0, t) for t in (np.int64, _U, np.uint16, np.int64)))
    ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    size = ends - starts
    at = np.concatenate([[0], np.cumsum(size)[:-1]])
    byte = np.flatnonzero(inside)
    place = np.arange(len(byte)) - np.repeat(at, size)
    h = np.add.reduceat(_BYTE[buf[byte]] * _POWER[place & 255], at) + size.astype(_U)
    plain = np.where(inside, buf, 32).astype(np.uint32)
    t = (plain[byte - 1] * np.uint32(0x9E3779B1) + plain[byte]) * np.uint32(0x85EBCA77) + plain[byte + 1] * np.uint32(0xC2B2AE3D)
    tri = (t ^ t >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> np.uint32(20)
    doc = np.searchsorted(np.cumsum([1, *(len(x) + 1 for x in texts)]), starts, "right") - 1
    return Words(doc, h, tri.astype(np.uint16), at)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters by name in ``p``; ``vocabulary``: sorted word hashes, whose embeddings are rows 1 on; row 0 is for others."""

    def __init__(self, vocabulary: np.ndarray, base: float, seed: int = 3):
        rng = np.random.default_rng(seed)
        n = WORD + CHAR
        draw = lambda *shape, by: rng.normal(0, by, shape).astype(np.float32)
        self.vocabulary, self.base = vocabulary, base
        self.p = {"word": draw(len(vocabulary) + 1, WORD, by=0.3), "char": draw(BUCKETS, CHAR, by=0.3), "att": draw(2 * HIDDEN, by=0.3), "out": draw(2 * HIDDEN, by=0.3), "bias": np.zeros(1, np.float32)}
        for way in "fb":
            self.p |= {f"x{way}": draw(n, 3 * HIDDEN, by=n**-0.5), f"h{way}": draw(HIDDEN, 3 * HIDDEN, by=HIDDEN**-0.5), f"c{way}": np.zeros(3 * HIDDEN, np.float32)}
        #: Slots by ever other bits of the hash; what finds its slot taken goes to the next table.
        self.tables: list[tuple[np.ndarray, np.ndarray]] = []
        left = list(enumerate(vocabulary.tolist(), 1))
        while left:
            hashes, rows, later = np.zeros(SLOTS, _U), np.zeros(SLOTS, np.int64), []
            for row, h in left:
                k = h >> 8 * len(self.tables) & SLOTS - 1
                if rows[k]:
                    later.append((row, h))
                else:
                    hashes[k], rows[k] = h, row
            self.tables.append((hashes, rows))
            left = later

    def rows(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), np.int64)
        for i, (hashes, rows) in enumerate(self.tables):
            k = (h >> _U(8 * i) & _U(SLOTS - 1)).astype(np.int64)
            out += np.where(hashes[k] == h, rows[k], 0)
        return out

    def inputs(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(vocabulary rows, input vectors): the word's embedding and the mean of its characters'."""
        rows = self.rows(w.hash)
        size = np.diff(np.append(w.at, len(w.tri))).astype(np.float32)
        chars = np.add.reduceat(self.p["char"][w.tri], w.at, axis=0) / size[:, None]
        return rows, np.concatenate([self.p["word"][rows], chars], axis=1)

    def _way(self, way: str, gates, n: int, keep: list | None = None) -> list[np.ndarray]:
        """Hidden states by step; gates(t) gives the input's part of the three gates at step t, for n windows."""
        wh, c = self.p[f"h{way}"], self.p[f"c{way}"]
        h = np.zeros((n, HIDDEN), np.float32)
        states: list[np.ndarray] = [h] * WINDOW
        for t in range(WINDOW) if way == "f" else range(WINDOW - 1, -1, -1):
            g, own = gates(t) + c, h @ wh
            rz = _sigmoid(g[:, : 2 * HIDDEN] + own[:, : 2 * HIDDEN])
            r, z = rz[:, :HIDDEN], rz[:, HIDDEN:]
            new = np.tanh(g[:, 2 * HIDDEN :] + r * own[:, 2 * HIDDEN :])
            if keep is not None:
                keep.append((t, h, r, z, new, own[:, 2 * HIDDEN :]))
            h = new + z * (h - new)
            states[t] = h
        return states

    def _pool(self, states: list[np.ndarray], there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(attention, pooled) of states (step, window, 2 * HIDDEN); there: which steps have a word."""
        s = np.stack([x @ self.p["att"] for x in states])
        s = np.where(there, s, np.float32(-1e9))
        a = np.exp(s - s.max(axis=0))
        a = np.where(there, a, 0)
        a /= np.maximum(a.sum(axis=0), 1e-9)
        return a, sum(a[t][:, None] * states[t] for t in range(len(states)))

    def windows(self, w: Words, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
        """(text of each window, logit of each window) for all windows of all texts that have words."""
        if not len(w.doc):
            return np.empty(0, np.int64), np.empty(0, np.float32)
        _, x = self.inputs(w)
        count = np.bincount(w.doc, minlength=n_docs)
        blocks = np.where(count > 0, np.maximum(-(-count // STRIDE), 2), 0)
        first = np.concatenate([[0], np.cumsum(blocks)[:-1]])
        place = first[w.doc] * STRIDE + np.arange(len(w.doc)) - np.concatenate([[0], np.cumsum(count)[:-1]])[w.doc]
        total = int(blocks.sum())
        there = np.zeros(total * STRIDE, bool)
        there[place] = True
        there = there.reshape(total, STRIDE)
        of = np.repeat(np.arange(n_docs), blocks)
        states = []
        for way in "fb":
            u = np.zeros((total * STRIDE, 3 * HIDDEN), np.float32)
            u[place] = x @ self.p[f"x{way}"]
            u = np.ascontiguousarray(u.reshape(total, STRIDE, 3 * HIDDEN).transpose(1, 0, 2))
            states.append(self._way(way, lambda t, u=u: u[t, :-1] if t < STRIDE else u[t - STRIDE, 1:], total - 1))
        both = [np.concatenate([f, b], axis=1) for f, b in zip(*states, strict=True)]
        real = np.concatenate([there[:-1], there[1:]], axis=1).T
        _, pooled = self._pool(both, real)
        logit = pooled @ self.p["out"] + self.p["bias"]
        good = of[:-1] == of[1:]
        return of[:-1][good], logit[good]

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Score of each whole text, 0 to 1: its highest window; texts without words score the labels' base rate."""
        out = np.full(len(texts), self.base)
        for i, j in pieces_of([len(t) for t in texts], PIECE):
            for part, of in self._stretches(texts[i:j], i):
                doc, logit = self.windows(words_of(part), len(part))
                if len(doc):
                    top = np.full(len(part), -np.inf)
                    np.maximum.at(top, doc, logit)
                    for k in np.flatnonzero(np.isfinite(top)):
                        p = round(float(1 / (1 + np.exp(-top[k]))), DECIMALS)
                        out[of[k]] = p if out[of[k]] == self.base else max(p, out[of[k]])
        return out

    @staticmethod
    def _stretches(texts: list[bytes], first: int) -> Iterator[tuple[list[bytes], list[int]]]:
        """Texts to work on at once; a very long one in stretches whose windows are together those of the uncut text: each ends
        behind a multiple of STRIDE words, the next begins STRIDE words earlier."""
        if len(texts) > 1 or len(texts[0]) <= 2 * PIECE:
            yield texts, list(range(first, first + len(texts)))
            return
        raw, at, size = texts[0].translate(_PLAIN).rstrip(b" "), 0, PIECE
        while True:
            end = raw.find(b" ", at + size)
            if end < 0:
                yield [raw[at:]], [first]
                return
            inside = np.frombuffer(raw[at:end], np.uint8) != 32
            starts = np.flatnonzero(inside & ~np.append(False, inside[:-1]))
            whole = len(starts) // STRIDE * STRIDE
            if whole < WINDOW:
                size *= 2
                continue
            # a word follows, since none but spaces were cut off the end
            yield [raw[at : at + starts[whole] if whole < len(starts) else end]], [first]
            at, size = at + int(starts[whole - STRIDE]), PIECE


def _gradients(net: Network, x: np.ndarray, there: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Gradients of the weighted cross entropy of windows, and that with respect to the inputs x (step, window, WORD + CHAR)."""
    p, n = net.p, x.shape[1]
    kept: dict[str, list] = {"f": [], "b": []}
    states = [net._way(way, lambda t, way=way: x[t] @ p[f"x{way}"], n, kept[way]) for way in "fb"]
    both = [np.concatenate([f, b], axis=1) for f, b in zip(*states, strict=True)]
    a, pooled = net._pool(both, there)
    d = ((_sigmoid(pooled @ p["out"] + p["bias"]) - y) * weight / n).astype(np.float32)
    grad = {"out": pooled.T @ d, "bias": d.sum(keepdims=True), "att": np.zeros_like(p["att"])}
    dp = d[:, None] * p["out"]
    da = np.stack([(h * dp).sum(axis=1) for h in both])
    ds = a * (da - (a * da).sum(axis=0))
    dh_of = []
    for t in range(WINDOW):
        grad["att"] += both[t].T @ ds[t]
        dh_of.append(a[t][:, None] * dp + ds[t][:, None] * p["att"])
    dx = np.zeros_like(x)
    for k, way in enumerate("fb"):
        wh, wx = p[f"h{way}"], p[f"x{way}"]
        gx, gh, gc = np.zeros_like(wx), np.zeros_like(wh), np.zeros(3 * HIDDEN, np.float32)
        dh = np.zeros((n, HIDDEN), np.float32)
        for t, before, r, z, new, own in reversed(kept[way]):
            dh = dh + dh_of[t][:, k * HIDDEN : (k + 1) * HIDDEN]
            dn = dh * (1 - z) * (1 - new * new)
            dz = dh * (before - new) * z * (1 - z)
            dr = dn * own * r * (1 - r)
            dg = np.concatenate([dr, dz, dn], axis=1)
            down = np.concatenate([dr, dz, dn * r], axis=1)
            gx += x[t].T @ dg
            gh += before.T @ down
            gc += dg.sum(axis=0)
            dx[t] += dg @ wx.T
            dh = dh * z + down @ wh.T
        grad |= {f"x{way}": gx, f"h{way}": gh, f"c{way}": gc}
    return grad, dx


def _in_turn(doc: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Windows in random order, but one of each text before a second of any."""
    order = rng.permutation(len(doc))
    by = order[np.argsort(doc[order], kind="stable")]
    first = np.flatnonzero(np.append(True, doc[by][1:] != doc[by][:-1])) if len(by) else by
    turn = np.empty(len(doc), np.int64)
    turn[by] = np.arange(len(by)) - np.repeat(first, np.diff(np.append(first, len(by))))
    return order[np.argsort(turn[order], kind="stable")]


def train(rows: list[tuple[str, int]], base: float, seed: int = 3) -> Network:
    """Fit to (text, label) rows. The first pass takes some windows of every text under its text's label, later ones each text's
    highest window, so the network learns which windows make a text toxic. Without rows of both labels, every score is
    the base rate."""
    rows = sorted(rows)
    y = np.array([label for _, label in rows], np.float32)
    if len(set(y.tolist())) < 2:
        return Network(np.empty(0, _U), base)
    w = words_of([t.encode() for t, _ in rows])
    pairs = np.unique(np.stack([w.doc.astype(_U), w.hash]), axis=1)
    hashes, df = np.unique(pairs[1], return_counts=True)
    often = np.flatnonzero(df >= max(3, len(rows) * LEAST_SHARE))
    vocabulary = np.sort(hashes[often[np.argsort(-df[often], kind="stable")[:VOCABULARY]]])
    net = Network(vocabulary, base, seed)
    rng = np.random.default_rng(seed)
    count = np.bincount(w.doc, minlength=len(rows))
    start = np.concatenate([[0], np.cumsum(count)[:-1]])
    ends = np.append(w.at, len(w.tri))
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0

    def learn(doc: np.ndarray, window: np.ndarray) -> None:
        nonlocal step
        at = start[doc] + window * STRIDE
        index = at + np.arange(WINDOW)[:, None]
        there = index < start[doc] + count[doc]
        flat = np.where(there, index, 0)
        used, back = np.unique(flat, return_inverse=True)
        size = ends[used + 1] - ends[used]
        tri = w.tri[np.repeat(ends[used] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())]
        part = Words(w.doc[used], w.hash[used], tri, np.concatenate([[0], np.cumsum(size)[:-1]]))
        word_rows, x = net.inputs(part)
        x = np.where(there[:, :, None], x[back.reshape(flat.shape)], 0).astype(np.float32)
        weight = np.ones(len(doc), np.float32)
        grad, dx = _gradients(net, x, there, y[doc], weight)
        dx = np.where(there[:, :, None], dx, 0).reshape(-1, WORD + CHAR)
        own = np.zeros((len(used), WORD + CHAR), np.float32)
        np.add.at(own, back.ravel(), dx)
        grad["word"] = np.zeros_like(net.p["word"])
        np.add.at(grad["word"], word_rows, own[:, :WORD])
        grad["char"] = np.zeros_like(net.p["char"])
        np.add.at(grad["char"], tri, np.repeat(own[:, WORD:] / size[:, None].astype(np.float32), size, axis=0))
        step += 1
        for k, g in grad.items():
            m, v = moment[k]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            net.p[k] -= (RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)).astype(np.float32)
            if k in ("word", "char"):
                net.p[k] *= np.float32(1 - 1e-4)

    def passes(doc: np.ndarray, window: np.ndarray) -> None:
        order = rng.permutation(len(doc))
        for lo in range(0, len(order), 64):
            learn(doc[order[lo : lo + 64]], window[order[lo : lo + 64]])

    per = np.maximum(-(-count // STRIDE), 2) - 1
    have = np.flatnonzero(count)
    all_doc = np.repeat(have, per[have])
    all_window = np.arange(len(all_doc)) - np.repeat(np.cumsum(per[have]) - per[have], per[have])
    some = _in_turn(all_doc, rng)[: max(FIRST, len(have))]
    passes(all_doc[some], all_window[some])
    pieces = [(i, words_of([t.encode() for t, _ in rows[i:j]]), j - i) for i, j in pieces_of([len(t) for t, _ in rows], PIECE // 2)]
    for _ in range(PASSES):
        found = [(i, *net.windows(part, n)) for i, part, n in pieces]
        doc, logit = np.concatenate([i + d for i, d, _ in found]), np.concatenate([x for _, _, x in found])
        order = np.lexsort((-logit, doc))
        first = order[np.flatnonzero(np.diff(doc[order], prepend=-1))]
        offset = np.cumsum(per[have]) - per[have]
        passes(doc[first], first - offset[np.searchsorted(have, doc[first])])
    return net


def sample(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> tuple[list[tuple[str, int]], float]:
    """A bounded sample of (text, label), at most POSITIVES and NEGATIVES rows by a hash of the id, and the share of
    positives among all rows that may be learnt from: those whose document is there. Texts longer than LONGEST characters give
    so many, in PARTS pieces spread evenly from their beginning to their end."""
    lab = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), 5) != 0))
    there = docs.where(F.col("text").isNotNull()).select("doc_id")
    lab = lab.groupBy("doc_id").agg(F.max(label).cast("int").alias("label")).join(there, "doc_id", "left_semi")
    counts = dict(lab.groupBy("label").count().collect())
    order = F.xxhash64("doc_id", F.lit("toxicity"))
    pick = lab.where("label = 1").orderBy(order, "doc_id").limit(POSITIVES).union(lab.where("label = 0").orderBy(order, "doc_id").limit(NEGATIVES))
    d = docs.select("doc_id", "text").join(F.broadcast(pick), "doc_id").where(F.col("text").isNotNull())
    size = LONGEST // PARTS
    step = (F.length("text") - size) / (PARTS - 1)
    parts = F.concat_ws("\n", *(F.col("text").substr((step * k).cast("int") + 1, F.lit(size)) for k in range(PARTS)))
    d = d.select("doc_id", F.when(F.length("text") <= LONGEST, F.col("text")).otherwise(parts).alias("text"), "label")
    d = d.groupBy("doc_id").agg(F.min(F.struct(F.md5(F.col("text").cast("binary")), "text", "label")).alias("x"))  # of a repeated id the same one in every run
    rows = [(t, y) for t, y in d.select("x.text", "x.label").collect()]
    return rows, counts.get(1, 0) / max(1, sum(counts.values()))


def scored(docs: DataFrame, net: Network, name: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text in a new column ``name``, which must not be among its columns. Narrow; null texts count as empty."""
    if free_name(name, docs.columns) != name:
        raise ValueError(f"there is a column {name}")
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = [len(t.as_py() or "") for t in b.column(at)]
            for i, j in pieces_of(sizes, 4 * PIECE):
                part = b.slice(i, j - i)
                scores = shared.value.score([(t or "").encode() for t in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64())], [*part.schema.names, name])
        trim()

    from pyspark.sql.types import DoubleType, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add(name, DoubleType()))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each document: doc_id, held_out, score, predicted. Ids may be null or repeat; other columns are not read;
    of a labelled id that repeats, the text with the smallest digest is learnt from; an empty table gives an empty result."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    net = train(*sample(docs, labels))
    out = scored(docs, net).select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op3(spark, sf_dir):
    from intervale.llm.common import table

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
