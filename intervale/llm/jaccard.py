"""N-gram Jaccard join by parity sketches: tokens are xored into the parts of a sketch, at most as many parts differ as
sets differ in tokens, so by the pigeonhole similar sets have an equal part; equal parts are joined per size band and
what meets is verified."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from intervale.llm.common import BROADCAST_ROWS, bounded_join, free_name, small_batches, staged, trim
from intervale.llm.graph import components

#: Words of a shingle, and the least similarity in percent.
WORDS, PERCENT = 5, 80
#: Distinct words whose hashes a Python worker keeps.
WORD_CACHE = 150_000
#: Bits, at least, of the parity sketch that filters pairs before their sets are intersected.
SKETCH_BITS = 512
#: A key with more documents is large: its documents are compared in blocks of about BLOCK.
LARGE, BLOCK = 32, 2048
#: Members of a large key's largest component that other documents are first tried with, in one of SOME of their large keys; and rounds in
#: which each document's nearest is verified before all that is left.
TRIES, SOME, ROUNDS = 32, 8, 2
#: Partners of a document that one row lists.
PARTNERS = 1000
#: Rows, with their texts or sets, sent to Python at a time.
BATCH = 500
#: Part keys that a task pre-aggregates at a time.
ROWS = 300_000
_U = np.uint64
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], _U)


def _bands(limit: int = 1 << 40) -> list[int]:
    """First sizes of the bands, each half as large again as the one before."""
    out = [1]
    while out[-1] < limit:
        out.append(max(out[-1] + 1, out[-1] * 3 // 2))
    return out


BANDS = _bands()


def differ(a: int, b: int) -> int:
    """The most tokens that sets of sizes a and b with at least PERCENT similarity differ in."""
    return (a + b) * (100 - PERCENT) // (100 + PERCENT)


def parts(band: int) -> int:
    """Parts of a sketch in a band: one more than two sets of the band can differ in, and some for parts left empty."""
    most = differ(BANDS[band + 1] - 1, BANDS[band + 1] - 1)
    return 1 if most == 0 else most + 1 + max(2, -(-most // 16))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        x = self[word] = xxhash.xxh3_64_intdigest(word)
        return x


_words = _Words()


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def shingles(raw: bytes | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles, A-Z lower-cased; with fewer words than a shingle, one of them all."""
    words = (raw or b"").lower().split()
    n = len(words)
    if n == 0:
        return np.empty(0, _U)
    h = np.fromiter(map(_words.__getitem__, words), _U, n)
    if n < WORDS:
        return _mix((h * _MULT[:n]).sum(dtype=_U, keepdims=True) + _U(n))
    k = n - WORDS + 1
    x = h[:k] * _MULT[0]
    for i in range(1, WORDS):
        x += h[i : i + k] * _MULT[i]
    return np.unique(_mix(x))


def part_keys(h: np.ndarray) -> np.ndarray:
    """The keys under which a set meets every other that may be similar.

    In each band that similar sets may share with it, a set's tokens are dealt to parts by hash and xored there. Two sets
    that differ in d tokens differ in at most d parts. If one of them has tokens in more than d parts, an equal part with
    tokens remains and its key is shared; sets with fewer such parts also give keys for all parts, empty ones too, in a
    space of their own, where two of them share one. A key's low byte names its band and space.
    """
    return _part_keys(h)[0]


def _part_keys(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, spare): what ``part_keys`` gives, and for each of the set's at most four bands and spaces (by a key's low two bits)
    how many of its keys there it can do without.

    A set with keys for e parts shares at least e - d with each similar one, if these differ in at most d tokens. So let keys
    have any order that is the same for all sets: if each set leaves out its last e - d - 1, the first key that two
    similar ones share has e - d - 1 others behind it in both and stays.
    """
    n = len(h)
    most = n * 100 // PERCENT
    out, spare = [], np.zeros(4, np.int64)
    for band in range(bisect_right(BANDS, n) - 1, bisect_right(BANDS, most)):
        p, d = parts(band), differ(n, min(most, BANDS[band + 1] - 1))
        code = 2 * band + 2
        at = ((h >> _U(32)) * _U(p) >> _U(32)).astype(np.int64)  # h is sorted, so a part's tokens lie together
        first = np.flatnonzero(np.diff(at, prepend=-1))
        value = np.bitwise_xor.reduceat(_mix(h ^ _U(0xA5A5A5A5)), first)
        tag = (at[first].astype(_U) * _U(2) + (_U(band + 1) << _U(44))) * _MULT[1]
        out.append(_mix(value + tag) & ~_U(255) | _U(code))
        spare[code & 3] = max(0, len(first) - d - 1)
        if len(first) <= d:
            every = np.zeros(p, _U)
            every[at[first]] = value
            out.append(_mix(every + (np.arange(p, dtype=_U) * _U(2) + _U(1) + (_U(band + 1) << _U(44))) * _MULT[1]) & ~_U(255) | _U(code + 1))
            spare[code + 1 & 3] = p - d - 1
    return np.concatenate(out) if out else np.empty(0, _U), spare


def sketch(h: np.ndarray) -> np.ndarray:
    """Parity bits as 64-bit words: each token flips one, so sketches differ in at most as many bits as their sets in tokens.
    At least SKETCH_BITS and two bits a token, a power of two, so that a longer one folds onto a shorter."""
    size = max(SKETCH_BITS, 1 << (2 * len(h) - 1).bit_length() if len(h) else 0)
    bits = np.bincount((h & _U(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(bool)).view(_U)


def _folded(x: np.ndarray, words: int) -> np.ndarray:
    while len(x) > words:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def distance(x: np.ndarray, y: np.ndarray) -> int:
    """Bits that two sketches differ in, the longer folded: no more than their sets differ in tokens."""
    words = min(len(x), len(y))
    return int(np.bitwise_count(_folded(x, words) ^ _folded(y, words)).sum())


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether 100 * intersection >= PERCENT * union, both not empty."""
    if not len(a) or not len(b):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _raw(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("raw"), *more)


def set_sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = pa.array([len(shingles(x.as_py())) for x in b.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), n], ["doc_id", "n_shingles"])

    return _raw(docs).mapInArrow(run, "doc_id bigint, n_shingles bigint")


def _first_of_runs(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted by key, then document, without repeats; the first document of each key's run), as (2, n) and (n,)."""
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    key, doc = key[new], doc[new]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    return np.stack([key, doc]), np.repeat(doc[starts], np.diff(np.append(starts, len(key))))


MET = "key bigint, doc bigint, head bigint, sketch binary"


def keyed(docs: DataFrame, rows: int = ROWS) -> DataFrame:
    """(key, doc, head, null) of every part key of every text, and (null, doc, size of its set, its sketch and four numbers of
    spare keys, two bytes each) once a text.

    Keys are pre-aggregated in the task, ``rows`` at a time: of documents that share one, the first stands for the others
    (its head is null) and goes on to meet those of other tasks; the others name it as their head and are done.
    """
    names = ["key", "doc", "head", "sketch"]

    def flush(keys: list, ids: list) -> pa.RecordBatch:
        (k, d), head = _first_of_runs(np.concatenate(keys).view(np.int64), np.concatenate(ids))
        return pa.RecordBatch.from_arrays([pa.array(k), pa.array(d), pa.array(head, mask=d == head), pa.nulls(len(k), pa.binary())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, held = [], [], 0
        for b in batches:
            sizes, sketches = [], []
            for doc, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                h = shingles(raw.as_py())
                sizes.append(len(h))
                k, spare = _part_keys(h) if len(h) else (h, np.zeros(4, np.int64))
                sketches.append(sketch(h).tobytes() + np.minimum(spare, 65535).astype(">u2").tobytes())
                if len(k):
                    keys.append(k)
                    ids.append(np.full(len(k), doc, np.int64))
                    held += len(k)
                if held > rows:
                    yield flush(keys, ids)
                    keys, ids, held = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.nulls(b.num_rows, pa.int64()), b.column(0), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary())], names)
        if keys:
            yield flush(keys, ids)
        keys = ids = None
        _words.clear()
        trim()

    return _raw(docs).mapInArrow(run, MET)


def meetings(rows: DataFrame) -> DataFrame:
    """(key, doc, head, null) for keys that several documents share, and the sizes and sketches, from ``keyed`` rows.

    Rows without a head are dealt by key, a row a task and key at most, so that a key a third of all documents have is no
    larger than the number of tasks; the others are dealt by document as well and pass. Each task streams its rows by
    key and gives every document the first of its key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = lambda k, d, h: pa.RecordBatch.from_arrays([pa.array(k), pa.array(d), pa.array(h), pa.nulls(len(k), pa.binary())], ["key", "doc", "head", "sketch"])
        key = head = None  # of the run that the last batch ended in
        alone = False  # whether that run has one document so far, not yet given out
        for b in batches:
            done = b.column(2).is_valid()
            yield b.filter(done)
            b = b.filter(pc.invert(done))
            k, d = (b.column(i).to_numpy() for i in (0, 1))
            if not len(k):
                continue
            if alone:
                k, d = np.concatenate([[key], k]), np.concatenate([[head], d])
            starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            n = np.diff(np.append(starts, len(k)))
            heads = d[starts].copy()
            several = n > 1
            if not alone and key is not None and k[0] == key:
                heads[0], several[0] = head, True
            alone = not several[-1]
            key, head = k[-1], heads[-1]
            pick = np.repeat(several, n)
            if pick.any():
                yield make(k[pick], d[pick], np.repeat(heads, n)[pick])

    spread = rows.repartition(F.xxhash64("key", F.when(F.col("head").isNotNull(), F.col("doc")))).sortWithinPartitions("key", "doc")
    return spread.mapInArrow(run, MET)


def linked(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar. Sets are made from the texts; a's are sent to b's, once a pair."""

    def run_a(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "ha"]
        for b in batches:
            a, to, h, held = [], [], [], 0
            for doc, raw, others in zip(*b.columns, strict=True):
                own = shingles(raw.as_py()).tobytes()
                for x in others.as_py():
                    a.append(doc.as_py())
                    to.append(x)
                    h.append(own)
                    held += len(own)
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(to, pa.int64()), pa.array(h, pa.binary())], names)
                        a, to, h, held = [], [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(to, pa.int64()), pa.array(h, pa.binary())], names)

    def run_b(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(x.as_py()).tobytes() for x in part.column(1)], pa.binary())], ["to", "hb"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = [similar(np.frombuffer(x.as_py(), _U), np.frombuffer(y.as_py(), _U)) for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))
        trim()

    pairs = staged(pairs, "pairs")
    few = pairs.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS  # each pair is a number in one of the lists
    place = F.row_number().over(Window.partitionBy("a").orderBy("b"))
    ours = pairs.withColumn("part", F.floor(place / PARTNERS)).groupBy("a", "part").agg(F.collect_list("b").alias("others")).drop("part")
    hubs = staged(pairs.select(F.col("b").alias("hub")).distinct(), "hubs")
    left = _raw(docs.join(F.broadcast(ours) if few else ours, F.col("doc_id") == F.col("a")), "others").mapInArrow(run_a, "a bigint, b bigint, ha binary")
    right = _raw(bounded_join(docs, hubs, F.col("doc_id") == F.col("hub"), "left_semi")).mapInArrow(run_b, "to bigint, hb binary")
    both = left.join(right, F.col("b") == F.col("to")).select("a", "b", "ha", "hb")
    return both.mapInArrow(compare, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each input row: doc_id, n_shingles, component_id.

    Equal texts are one class, known by their MD5 and represented by their smallest id. Representatives meet by part
    keys. What meets is verified until components stand still, never all pairs of a group: first each document with the
    nearest head it met, then the pairs in different components of keys with few documents, and of large keys those of other
    documents with a few members of the largest component; in the end every pair that is still in different components
    and shares a large key that neither can do without (see ``_part_keys``; the largest go first, so a passage that very many
    documents share brings no pairs as long as it fills no more parts than that). No link between those is left out. Pairs that parity sketches rule out are not verified.

    Null and empty texts have no shingles and are alone; rows with a null id have no component (null) and link nothing;
    rows that repeat an id share its component, each with its own size; other columns are not read; an empty table gives
    an empty result.
    """
    small_batches(docs.sparkSession, BATCH)
    return _near_duplicates(docs)


def _near_duplicates(docs: DataFrame) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = staged(docs.select("doc_id", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("md5")), "texts")
    again = staged(texts.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("again")), "again")
    repeats = not again.isEmpty()
    with_id = texts.where("doc_id IS NOT NULL")
    once = bounded_join(with_id, again, F.col("doc_id") == F.col("again"), "left_anti") if repeats else with_id
    classes = once.groupBy("md5").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("most")).where("rep < most")
    classes = staged(classes.select(F.col("md5").alias("of"), "rep"), "classes")
    classed = staged(bounded_join(once, classes, F.col("md5") == F.col("of"), "left").select("doc_id", F.coalesce("rep", "doc_id").alias("rep")), "classed")
    copies = staged(classed.where("rep <> doc_id").select(F.col("doc_id").alias("copy")), "copies")
    singles = bounded_join(docs.where("doc_id IS NOT NULL"), copies, F.col("doc_id") == F.col("copy"), "left_anti")

    met = staged(meetings(keyed(singles)), "meetings")
    info = met.where("key IS NULL").select(
        F.col("doc").alias("id"), F.col("head").alias("size"), F.expr("substring(sketch, 1, length(sketch) - 8)").alias("sketch"), F.expr("substring(sketch, length(sketch) - 7, 8)").alias("spare")
    )
    keys = met.where("key IS NOT NULL").drop("sketch")
    heads = staged(_plausible(keys.where("doc <> head").select(F.col("doc").alias("a"), F.col("head").alias("b")).distinct(), info), "heads")
    done = staged(_nearest(heads), "nearest")
    links = staged(linked(done, singles), "links")
    comp = components(links)

    def settle(pairs: DataFrame) -> None:
        """Verify pairs in different components, each document's nearest first, until none is left."""
        nonlocal links, comp, done
        for k in range(ROUNDS + 1):
            tried = _apart(pairs, comp).select("a", "b", "bits").join(done, ["a", "b"], "left_anti")
            tried = staged(_nearest(tried) if k < ROUNDS else tried.select("a", "b").distinct(), "tried")
            if tried.isEmpty():
                return
            more = staged(linked(tried, singles), "links")
            done = staged(done.union(tried), "done")
            if not more.isEmpty():
                links = links.union(more)
                comp = components(links)

    mixed = _mixed(keys, comp)
    settle(staged(heads.union(_compared(keys, info, comp, mixed.where("n <= " + str(LARGE)))).union(_tried(keys, info, comp, mixed.where("n > " + str(LARGE)))), "across"))
    large = _mixed(keys, comp, LARGE)
    if not large.isEmpty():
        rarer = staged(_rarer(keys, info, large), "rarer")
        settle(staged(_compared(rarer, info, comp, _mixed(rarer, comp)), "across"))

    sizes = met.where("key IS NULL").select(F.col("doc").alias("of"), F.col("head").alias("n_shingles"))
    rows = classed.join(sizes, F.col("rep") == F.col("of")).select("doc_id", "n_shingles", "rep")
    others = docs.where("doc_id IS NULL")
    if repeats:
        others = others.union(bounded_join(docs, again, F.col("doc_id") == F.col("again"), "left_semi"))
    rows = rows.union(set_sizes(others).select("doc_id", "n_shingles", F.col("doc_id").alias("rep")))
    out = bounded_join(rows, comp, F.col("rep") == F.col("node"), "left")
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("root", "rep"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"))


def _of(ids: DataFrame, column: str, comp: DataFrame, name: str) -> DataFrame:
    c = comp.select(F.col("node").alias(f"{name}_node"), F.col("root").alias(f"{name}_root"))
    out = ids.join(c, F.col(column) == F.col(f"{name}_node"), "left")
    return out.withColumn(name, F.coalesce(f"{name}_root", column)).drop(f"{name}_node", f"{name}_root")


def _apart(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """The pairs in different components, with both."""
    return _of(_of(pairs, "a", comp, "ca"), "b", comp, "cb").where("ca <> cb")


def _nearest(pairs: DataFrame, *more: str) -> DataFrame:
    """Of each document's pairs (a, b, bits) that with the fewest bits."""
    return pairs.groupBy("a").agg(F.min(F.struct("bits", "b")).alias("x")).select("a", F.col("x.b").alias("b"), *(F.col(f"x.{c}").alias(c) for c in more))


PAIR = "a bigint, b bigint, bits bigint"


def _plausible(pairs: DataFrame, info: DataFrame) -> DataFrame:
    """The pairs that their sketches don't rule out, with the bits these differ in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = pa.array([distance(np.frombuffer(x.as_py(), _U), np.frombuffer(y.as_py(), _U)) for x, y in zip(b.column(4), b.column(5), strict=True)], pa.int64())
            most = pa.array([differ(*x) for x in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), bits], ["a", "b", "bits"]).filter(pc.less_equal(bits, most))

    left = info.select(F.col("id").alias("ia"), F.col("size").alias("na"), F.col("sketch").alias("sa"))
    right = info.select(F.col("id").alias("ib"), F.col("size").alias("nb"), F.col("sketch").alias("sb"))
    both = pairs.join(left, F.col("a") == F.col("ia")).join(right, F.col("b") == F.col("ib"))
    return both.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, PAIR)


def _mixed(keys: DataFrame, comp: DataFrame, more_than: int = 1) -> DataFrame:
    """(mk, n, inside, blocks, ins, outs): keys with documents in several components, how many they have, the component that has most
    (or one of the smallest documents', where the key is not large), and the blocks of all, of that component and of the others. Keys of a head and one other are known and left out."""
    rows = _of(keys, "doc", comp, "c")
    by = rows.groupBy("key", "c").agg(F.count("*").alias("n"), F.max((F.col("doc") == F.col("head")).cast("int")).alias("h"))
    total = F.sum("n")
    out = by.groupBy(F.col("key").alias("mk")).agg(total.alias("n"), F.max("h").alias("h"), F.count("*").alias("kinds"), F.max(F.struct("n", "c")).alias("x"))
    out = out.where(f"kinds > 1 AND n - h > 1 AND n > {more_than}")
    blocks = (F.expr(f"({n} + {BLOCK - 1}) div {BLOCK}").alias(name) for n, name in (("n", "blocks"), ("x.n", "ins"), ("(n - x.n)", "outs")))
    return staged(out.select("mk", "n", F.col("x.c").alias("inside"), *blocks), "mixed")


def _rarer(keys: DataFrame, info: DataFrame, large: DataFrame) -> DataFrame:
    """(key, doc, head) of the large keys, each document without the largest it can spare in a band. A document has no more rows
    than parts."""
    spare = F.conv(F.hex(F.expr("substring(spare, cast(1 + 2 * (key & 3) as int), 2)")), 16, 10).cast("int")
    rows = bounded_join(keys, large.select("mk", "n"), F.col("key") == F.col("mk"), "inner").join(info.select("id", "spare"), F.col("doc") == F.col("id"))
    place = F.row_number().over(Window.partitionBy("doc", F.expr("key & 255")).orderBy(F.desc("n"), F.desc("key")))
    return rows.select("key", "doc", "head", spare.alias("spare"), place.alias("place")).where("place > spare").select("key", "doc", "head")


def _groups(keys: DataFrame, info: DataFrame, comp: DataFrame, mixed: DataFrame, everywhere: bool) -> DataFrame:
    """Rows (key, block, side, doc, c, large, size, sketch) of the mixed keys, a key's block together. If ``everywhere``, each two
    documents not both of its largest component meet in one block: a key of one block is that, with side 3; of larger ones
    blocks of the others meet those of the component and one another, two at a time, as sides 1 and 2 (one that meets itself: 3).
    So a task holds two blocks, whatever the key has."""
    rows = bounded_join(_of(keys, "doc", comp, "c"), mixed, F.col("key") == F.col("mk"), "inner").withColumn("large", F.col("c") == F.col("inside"))
    if everywhere:
        own = F.pmod(F.xxhash64("doc"), F.when(F.col("large"), F.col("ins")).otherwise(F.col("outs")))
        rows = rows.withColumn("own", own)
        meets = """CASE WHEN blocks = 1 THEN array(named_struct('block', 0L, 'side', 3))
            WHEN large THEN transform(sequence(0L, outs - 1), o -> named_struct('block', o * (ins + outs) + own, 'side', 2))
            ELSE concat(transform(sequence(0L, ins - 1), i -> named_struct('block', own * (ins + outs) + i, 'side', 1)),
                transform(sequence(0L, outs - 1), o -> named_struct('block', least(o, own) * (ins + outs) + ins + greatest(o, own),
                    'side', CASE WHEN o = own THEN 3 WHEN o > own THEN 1 ELSE 2 END))) END"""
        rows = rows.select("*", F.explode(F.expr(meets)).alias("m")).select("*", "m.block", "m.side")
    else:
        rows = rows.withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks"))).withColumn("side", F.lit(3))
    rows = rows.join(info, F.col("doc") == F.col("id")).select("key", "block", "side", "doc", "c", "large", "size", "sketch")
    return rows.repartition("key", "block").sortWithinPartitions("key", "block")


class _Sketches:
    """Sketches of many documents, as matrices by length."""

    def __init__(self, column: pa.Array):
        rows = [np.frombuffer(x.as_py(), _U) for x in column]
        self.words = np.fromiter(map(len, rows), np.int64, len(rows))
        self.at = np.empty(len(rows), np.int64)
        self.by: dict[int, np.ndarray] = {}
        for w in np.unique(self.words).tolist():
            own = np.flatnonzero(self.words == w)
            self.at[own] = np.arange(len(own))
            self.by[w] = np.stack([rows[i] for i in own])

    def distances(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        out = np.empty(len(p), np.int64)
        a, b = self.words[p], self.words[q]
        for x, y in set(zip(a.tolist(), b.tolist(), strict=True)):
            some = np.flatnonzero((a == x) & (b == y))
            for k in range(0, len(some), 20_000):
                at = some[k : k + 20_000]
                m, n = self.by[x][self.at[p[at]]], self.by[y][self.at[q[at]]]
                while m.shape[1] > n.shape[1]:
                    m = m[:, : m.shape[1] // 2] ^ m[:, m.shape[1] // 2 :]
                while n.shape[1] > m.shape[1]:
                    n = n[:, : n.shape[1] // 2] ^ n[:, n.shape[1] // 2 :]
                out[at] = np.bitwise_count(m ^ n).sum(axis=1, dtype=np.int64)
        return out


def _by_group(groups: DataFrame, pairs_of) -> DataFrame:
    """Plausible pairs (a, b, bits) among those that ``pairs_of`` names. It gets the columns of some whole groups, and where each begins and
    ends, and gives two arrays of row numbers at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def give(t: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
            x = {n: t.column(n).to_numpy() for n in ("key", "block", "side", "doc", "c", "large", "size")}
            sketches = _Sketches(t.column("sketch").combine_chunks())
            for p, q in pairs_of(x, starts, np.append(starts[1:], t.num_rows)):
                d = sketches.distances(p, q)
                good = d <= (x["size"][p] + x["size"][q]) * (100 - PERCENT) // (100 + PERCENT)
                p, q, d = x["doc"][p[good]], x["doc"][q[good]], d[good]
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(p, q)), pa.array(np.minimum(p, q)), pa.array(d)], ["a", "b", "bits"])

        def cut(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            t = pa.Table.from_batches(held)
            k = np.stack([t.column(n).to_numpy() for n in ("key", "block")])
            starts = np.flatnonzero(np.concatenate([[True], (k[:, 1:] != k[:, :-1]).any(axis=0)]))
            if last:
                yield from give(t, starts)
                held = []
            elif len(starts) > 1:  # the last group may go on
                yield from give(t.slice(0, starts[-1]), starts[:-1])
                held = t.slice(starts[-1]).to_batches()

        for b in batches:
            if b.num_rows:
                held.append(b)
                yield from cut(False)
        if held:
            yield from cut(True)
        trim()

    return groups.mapInArrow(run, PAIR)


def _compared(keys: DataFrame, info: DataFrame, comp: DataFrame, mixed: DataFrame) -> DataFrame:
    """Plausible pairs of all documents of the mixed keys that are in different components."""

    def pairs_of(x: dict[str, np.ndarray], starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        c, side, large = x["c"], x["side"], x["large"]

        def wanted(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            good = (c[p] != c[q]) & ((side[p] | side[q]) == 3)
            return p[good], q[good]

        size = ends - starts
        few = np.repeat(size <= 64, size)
        group = np.repeat(np.arange(len(starts)), size)
        for k in range(1, 64):  # neighbours at distance k, in all small groups at once
            p = np.flatnonzero(few[:-k] & (group[:-k] == group[k:])) if k < len(group) else np.empty(0, np.int64)
            if not len(p):
                break
            yield wanted(p, p + k)
        for lo, hi in zip(starts[size > 64].tolist(), ends[size > 64].tolist(), strict=True):
            rest = np.arange(lo, hi)
            right = rest[side[lo:hi] == 2]
            for i in rest[~large[lo:hi] & (side[lo:hi] != 2)].tolist():
                others = right if side[i] == 1 else rest[large[lo:hi] | (rest > i)]
                yield wanted(np.full(len(others), i), others)

    return _by_group(_groups(keys, info, comp, mixed, True), pairs_of).distinct()


def _tried(keys: DataFrame, info: DataFrame, comp: DataFrame, mixed: DataFrame) -> DataFrame:
    """For documents outside the largest component of a large key, in one of SOME of their keys by hash, the plausible ones
    of TRIES members of it: most of a family is joined this way before ``_compared`` is asked about what is left."""

    def pairs_of(x: dict[str, np.ndarray], starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for lo, hi in zip(starts.tolist(), ends.tolist(), strict=True):
            inside = np.flatnonzero(x["large"][lo:hi]) + lo
            outside = np.flatnonzero(~x["large"][lo:hi]) + lo
            outside = outside[_mix((x["doc"][outside] ^ x["key"][outside]).view(_U)) % _U(SOME) == 0]
            if len(inside) and len(outside):
                draw = _mix(x["doc"][outside].view(_U)[:, None] * _MULT[0] + np.arange(TRIES, dtype=_U)[None, :])
                yield np.repeat(outside, TRIES), inside[(draw % _U(len(inside))).astype(np.int64)].ravel()

    near = _by_group(_groups(keys, info, comp, mixed, False), pairs_of)
    return _nearest(near, "bits").select("a", "b", "bits")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of near duplicates, that with the smallest id; columns unchanged. Rows
    with a null id stay; of rows that repeat an id that with the smallest hash of text and other columns stays."""
    found = staged(near_duplicates(docs), "near")
    dropped, of, least = (free_name(n, docs.columns) for n in ("dropped", "of", "least"))
    drop = staged(found.where("doc_id <> component_id").select(F.col("doc_id").alias(dropped)).distinct(), "dropped")
    kept = bounded_join(docs, drop, F.col("doc_id") == F.col(dropped), "left_anti")
    if found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        return kept
    row = F.struct(F.md5(F.coalesce("text", F.lit("")).cast("binary")), F.xxhash64(*docs.columns))
    one = kept.where("doc_id IS NOT NULL").select(F.col("doc_id").alias(of), row.alias(least)).groupBy(of).agg(F.min(least).alias(least))
    same = kept.where("doc_id IS NOT NULL").join(one, (F.col("doc_id") == F.col(of)) & (row == F.col(least)), "left_semi")
    return same.dropDuplicates(["doc_id"]).union(kept.where("doc_id IS NULL"))


def op2(spark, sf_dir):
    from intervale.llm.common import table

    return near_duplicates(table(spark, sf_dir, "documents"))
