"""Classifiers and the language model: accuracy on rows not learnt from, gradients, seating, awkward rows."""

import gc
import math
import tracemalloc
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from intervale.llm import common, langid, lm, pitman_yor, toxicity

DATA = "/root/testdata/sf0.01"
AWKWARD = [(None, "the of and", "en", "a"), (-5, None, None, None), (-6, "", "en", "a"), (-7, "123 !? \n", "en", "a"), (-7, "zzz " * 90_000, "en", "a"), (-8, "idiot scum moron", "en", "a"), (-9, "é", None, None)]
SCHEMA = "doc_id bigint, text string, lang string, source string, score double, held_out string"


def held(i, k):
    return zlib.crc32(str(i).encode()) % k == 0


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source")
    more = spark.createDataFrame([(*r, 0.5, "clash") for r in AWKWARD], SCHEMA)
    return d.selectExpr("*", "0.5D score", "'clash' held_out").unionByName(more)


@pytest.fixture(scope="module")
def truth():
    lang = dict(zip(*pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "lang"]).to_pydict().values(), strict=True))
    toxic = dict(zip(*pq.read_table(f"{DATA}/labels.parquet", columns=["doc_id", "toxic"]).to_pydict().values(), strict=True))
    return lang, toxic


def test_language(spark, docs, truth):
    rows = langid.identify(docs, langid.train(langid.sample(docs))).collect()
    assert len(rows) == len(truth[0]) + len(AWKWARD)
    own = [r for r in rows if r.doc_id is not None and r.doc_id >= 0]
    assert all(r.held_out == held(r.doc_id, 5) for r in own)
    aside = [r for r in own if r.held_out]
    assert sum(r.lang_pred == truth[0][r.doc_id] for r in aside) / len(aside) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in rows if r.doc_id in (-5, -6)} == {"und"} and Counter(r.lang_pred for r in rows if r.doc_id == -7)["und"] == 1
    assert langid.identify(docs.where("false"), langid.train([])).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.limit(3), langid.train([])).collect()} == {"und"}


def test_very_long_text_is_read_whole(monkeypatch):
    m = langid.train([("aa bb " * 50, "x"), ("cc dd " * 50, "y")] * 10)
    text = b"aa bb " * 3000 + b"cc dd " * 9000
    whole = m.logits([text])
    monkeypatch.setattr(langid, "PIECE", 1000)
    assert m.logits([text]) == pytest.approx(whole, rel=1e-3)
    assert m.predict([text.decode()])[0][0] == "y"


def test_toxicity(spark, docs, truth):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == len(truth[0]) + len(AWKWARD)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    clean = [r for r in rows if r.held_out and truth[1].get(r.doc_id) == 0]
    assert sum(r.predicted for r in clean) / len(clean) < 0.1
    assert toxicity.toxicity(docs.where("false"), labels).count() == 0
    nothing = toxicity.toxicity(docs.limit(5), labels.where("false")).collect()
    assert {r.score for r in nothing} <= {0.0, 0.5} or all(0 <= r.score <= 1 for r in nothing)


def test_toxic_texts_are_found(spark):
    """A model that calls everything clean fails here: recall and false alarms on labelled texts that were not learnt from."""
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    truth = {r.doc_id: r.toxic for r in labels.select("doc_id", "toxic").where("toxic IS NOT NULL").collect()}
    net = toxicity.train(*toxicity.sample(d, labels))
    rows = [(r.doc_id, r.text or "") for r in d.join(labels.where("toxic IS NOT NULL"), "doc_id", "left_semi").collect() if held(r.doc_id, 5)]
    score = net.score([t.encode() for _, t in rows])
    bad = [s >= 0.5 for (i, _), s in zip(rows, score, strict=True) if truth[i] == 1]
    good = [s >= 0.5 for (i, _), s in zip(rows, score, strict=True) if truth[i] == 0]
    assert len(bad) > 40 and sum(bad) / len(bad) > 0.8 and sum(good) / len(good) < 0.02


@pytest.mark.parametrize("size", [3_000, 700_000, 2_500_000])
def test_score_is_the_same_among_others(size):
    rng = np.random.default_rng(size)
    text = " ".join(f"w{x}" for x in rng.integers(0, 5000, size // 5)).encode()
    short = [b"a short text", b"", b"another one " * 50]
    net = toxicity.Network(np.empty(0, np.uint64), 0.1)
    assert net.score([text])[0] == net.score([*short, text, *short])[3]
    m = langid.train([("aa bb " * 50, "x"), ("cc dd " * 50, "y")] * 10)
    text = b"aa bb w cc " * (size // 10)
    assert (m.logits([text])[0] == m.logits([*short, text, *short])[3]).all()
    assert list(common.pieces_of([10, 50_000_000, 3], 1 << 20)) == [(0, 1), (1, 2), (2, 3)]


def test_language_forward_pass():
    """The logits of a text are the mean of its subwords' rows, plus the bias."""
    m = langid.train([("aa bb " * 50, "x"), ("cc dd " * 50, "y")] * 10)
    text = b"aa dd bb"
    pad = b" " * max(langid.LENGTHS)
    buckets = np.concatenate(list(langid.grams(np.frombuffer(b" " + text + pad + b" ", np.uint8))))
    buckets = buckets[buckets < langid.BUCKETS]
    want = sum(m.table[b, :-1] for b in buckets) / len(buckets) + m.bias
    assert m.logits([text])[0] == pytest.approx(want)


def test_long_training_texts_give_pieces(spark):
    ids = [i for i in range(60) if not held(i, 5)]
    d = spark.createDataFrame([(i, f"first{i} " + "wort " * 9000 + "last", "de") for i in ids] + [(None, "x", None), (1, None, "de")], "doc_id long, text string, lang string")
    rows = langid.sample(d)
    assert len(rows) == len(ids) and all(len(t) <= langid.LONGEST + langid.PARTS and t.startswith("first") and t.endswith("last") for t, _ in rows)
    assert rows == langid.sample(d.repartition(3)) and langid.sample(d.where("false")) == []


def test_gradients():
    rng = np.random.default_rng(1)
    net = toxicity.Network(np.empty(0, np.uint64), 0.1)
    net.p = {k: v.astype(float) for k, v in net.p.items()}
    x = rng.normal(size=(toxicity.WINDOW, 3, toxicity.WORD + toxicity.CHAR))
    there = rng.random((toxicity.WINDOW, 3)) < 0.8
    y, weight = np.array([1.0, 0, 1]), np.ones(3)

    def loss():
        states = [net._way(way, lambda t, way=way: x[t] @ net.p[f"x{way}"], 3) for way in "fb"]
        _, pooled = net._pool([np.concatenate([f, b], axis=1) for f, b in zip(*states, strict=True)], there)
        z = pooled @ net.p["out"] + net.p["bias"]
        return float((np.logaddexp(0, z) - y * z).mean())

    grad, dx = toxicity._gradients(net, x, there, y, weight)
    for k, g in grad.items():
        at = tuple(rng.integers(0, n) for n in g.shape)
        old = net.p[k][at]
        net.p[k][at] = old + 1e-4
        up = loss()
        net.p[k][at] = old - 1e-4
        down = loss()
        net.p[k][at] = old
        assert (up - down) / 2e-4 == pytest.approx(g[at], rel=2e-2, abs=2e-5), k
    old = x[3, 1, 2]
    x[3, 1, 2] = old + 1e-4
    up = loss()
    x[3, 1, 2] = old - 1e-4
    assert (up - loss()) / 2e-4 == pytest.approx(dx[3, 1, 2], rel=2e-2, abs=2e-5)


def test_windows_by_brute_force():
    net = toxicity.Network(np.empty(0, np.uint64), 0.1)
    texts = [b"one two " * 40, b"", b"a", b"x y z " * 7]
    doc, logit = net.windows(toxicity.words_of(texts), len(texts))
    for d, text in enumerate(texts):
        w = toxicity.words_of([text])
        n, mine = len(w.hash), logit[doc == d]
        assert len(mine) == (max(-(-n // toxicity.STRIDE), 2) - 1 if n else 0)
        if n:
            _, x = net.inputs(w)
            for k, got in enumerate(mine):
                part = x[k * toxicity.STRIDE : k * toxicity.STRIDE + toxicity.WINDOW]
                full = np.zeros((toxicity.WINDOW, 1, x.shape[1]), np.float32)
                full[: len(part), 0] = part
                there = np.arange(toxicity.WINDOW)[:, None] < len(part)
                states = [net._way(way, lambda t, way=way, full=full: full[t] @ net.p[f"x{way}"], 1) for way in "fb"]
                _, pooled = net._pool([np.concatenate(s, axis=1) for s in zip(*states, strict=True)], there)
                assert float((pooled @ net.p["out"] + net.p["bias"])[0]) == pytest.approx(float(got), abs=1e-4)


def test_long_text_scores_its_worst_window(monkeypatch):
    net = toxicity.Network(np.empty(0, np.uint64), 0.1)
    text = b" ".join(b"w%d" % (i * i % 97) for i in range(5000))
    whole = net.score([text])[0]
    monkeypatch.setattr(toxicity, "PIECE", 2000)
    assert net.score([text])[0] == pytest.approx(whole, abs=0.05)
    assert net.score([b"", b"  \n"]).tolist() == [0.1, 0.1]


@pytest.mark.parametrize("gap", [b"\n", b"\t", b" " * 40, b" ", b"\n" + b" " * 70])
def test_stretches_have_the_windows_of_the_text(monkeypatch, gap):
    net = toxicity.Network(np.empty(0, np.uint64), 0.1)
    for n in (1500, 1504, 1520):
        text = gap.join(b"w%d" % (i * i % 97) for i in range(n)) + gap
        _, whole = net.windows(toxicity.words_of([text]), 1)
        with monkeypatch.context() as m:
            m.setattr(toxicity, "PIECE", 2000)
            parts = [p for p, _ in net._stretches([text], 0)]
        cut = np.concatenate([net.windows(toxicity.words_of(p), 1)[1] for p in parts])
        assert len(parts) > 1 and cut == pytest.approx(whole, abs=1e-4)


def test_sample_is_bounded_after_the_join(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "POSITIVES", 5)
    monkeypatch.setattr(toxicity, "NEGATIVES", 5)
    ids = [i for i in range(400) if not held(i, 5)]
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids)], "doc_id bigint, toxic int")
    long = "first " + "word " * 4000 + "last"
    d = spark.createDataFrame([(i, f"{i} {long}" if k % 2 else f"text {i}") for k, i in enumerate(ids) if k >= len(ids) - 20], "doc_id bigint, text string")
    rows, base = toxicity.sample(d, labels)
    assert sorted(y for _, y in rows) == [0] * 5 + [1] * 5 and base == 0.5
    for t, y in rows:
        assert len(t) <= toxicity.LONGEST + 3 and (not y or " first " in t and t.endswith(" last"))


def test_first_pass_takes_some_of_each_text():
    doc = np.repeat(np.arange(50), np.where(np.arange(50) == 7, 5000, 3))
    got = toxicity._in_turn(doc, np.random.default_rng(0))
    assert sorted(got) == list(range(len(doc))) and sorted(doc[got[:50]]) == list(range(50)) and set(doc[got[50:100]]) == set(range(50))


def test_lm(spark, docs):
    rows = lm.lm_scores(docs).collect()
    raw = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert len(rows) == len(raw)
    texts = [(i, (t or "").encode().lower().split() + [None], not held("" if i is None else i, 10)) for i, t in raw]
    c = Counter(w for _, ws, learn in texts if learn for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((i if i is not None else -1, len(ws), sum(c[w] > 0 for w in ws), round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 4)) for i, ws, _ in texts)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.n_known, round(r.base_score, 4)) for r in rows)
    assert [w[:3] for w in want] == [g[:3] for g in got]
    assert all(abs(w[3] - g[3]) <= 1e-6 * abs(w[3]) + 2e-4 for w, g in zip(want, got, strict=True))
    assert {r.train_tokens for r in rows} == {n}
    assert all(r.score < 0 and math.isfinite(r.score) for r in rows)
    assert lm.lm_scores(docs.where("false")).count() == 0
    p = {r.held_out: r for r in lm.perplexity(lm.lm_scores(docs)).collect()}
    assert p[False].perplexity < p[False].base_perplexity and p[True].perplexity < 2 * p[True].base_perplexity


def test_every_word_is_a_context(spark):
    """Rare words that always follow one another: only their own restaurants can tell."""
    a, b = [f"qa{i}x" for i in range(2000)], [f"zb{i}x" for i in range(2000)]
    right = [(i, " ".join(f"{a[(i * 37 + k) % 2000]} {b[(i * 37 + k) % 2000]}" for k in range(0, 2000, 7))) for i in range(60)]
    wrong = " ".join(f"{a[k]} {b[k - 1]}" for k in range(0, 2000, 7))
    rare = next(i for i in range(1000, 9999) if held(i, 10)), next(i for i in range(10_000, 99_999) if held(i, 10))
    d = spark.createDataFrame([*right, (rare[0], right[1][1]), (rare[1], wrong)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in lm.lm_scores(d).collect()}
    assert got[rare[0]].n_tokens == got[rare[1]].n_tokens and got[rare[0]].n_known == got[rare[1]].n_known
    assert got[rare[0]].score > got[rare[1]].score + 200


def _lm_texts():
    rng = np.random.default_rng(5)
    words = [f"w{i}" if i % 3 else f"é{i}ß" for i in range(400)]
    zipf = 1 / np.arange(1, 401)
    rows = [(i, " ".join(words[k] for k in rng.choice(400, rng.integers(0, 60), p=zipf / zipf.sum()))) for i in range(160)]
    return [*rows, *((200 + i, t) for i, t in rows[:12]), (None, "W1 w1  w1\tw1"), (400, None), (401, ""), (402, "never met\xa0 w1 NEVER met"), (403, "w2 w1 w2 w1 w2 w1")]


@pytest.mark.parametrize("broadcast", [1_000_000, 60, 40])  # not below FREQUENT: frequent words have to be among the broadcast ones
def test_lm_score_by_brute_force(spark, monkeypatch, broadcast):
    """Each token from counts held in dictionaries; with few broadcast words and pairs the others meet theirs by joins."""
    monkeypatch.setattr(lm, "BROADCAST", broadcast)
    monkeypatch.setattr(lm, "FREQUENT", 40)
    rows = _lm_texts()
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    split = [(lm.tokens((t or "").encode()), held("" if i is None else i, 10)) for i, t in rows]
    assert {aside for _, aside in split} == {True, False}
    shared = lm.fit(d.where(~(common.fold(d.doc_id, 10) == 0)).select("text"))[0]
    symbols, size = lm.Symbols(shared.frequent, shared.hashes), len(shared.hashes)
    f = len(shared.frequent)
    known, follow = Counter(), {}
    for ws, aside in split:
        if not aside:
            known.update(ws)
            for u, w in zip([None, *ws], [*ws, None], strict=True):
                follow.setdefault(u, Counter())[w] += 1
    each = [n for ws in follow.values() for n in ws.values()]
    one, two = each.count(1), each.count(2)
    discount = min(0.95, max(0.05, one / (one + 2 * two)))

    def identity(w):
        return np.array([0 if w is None else next((i + 1 for i in range(size) if int(shared.hashes[i]) == lm._hash(w)), None) or np.uint64(lm._hash(w)).astype(np.int64)])

    def parent(context, w):
        if w is None:
            return float(shared.table[context, symbols.end])
        x = symbols[w] & 0xFFFFFFFF
        own, k = 0.0, np.array([w[-1]])
        if x >= f:
            own = shared.speller.log10([w])
            own = shared.classes.log10(k, np.array([float(known[w])]), np.array([lm._hash(w)], np.uint64), own) if known[w] else own + np.log10(shared.classes.left(k))
            own = float(own[0])
        return float(shared.table[context, x]) + own

    def restaurant(u):
        """What each dish and the parent get, averaged over the samples; dishes met once have one table."""
        ws = list(follow.get(u, {}))
        if not ws:
            return {}, 1.0
        n = np.array([float(follow[u][w]) for w in ws])
        x = None if u is None else symbols[u] & 0xFFFFFFFF
        # the parent of a restaurant of a word that is not frequent is what is predicted from no context at all
        at = 2 * f if u is None else x if x < f else len(shared.table) - 1
        base = 10.0 ** np.array([parent(at, w) for w in ws])
        key = pitman_yor.mixed(np.concatenate([lm._pair_key(identity(u), identity(w)) for w in ws]))
        t, gives, left = np.ones(len(ws)), np.zeros(len(ws)), 0.0
        for sweep in range(pitman_yor.BURN + pitman_yor.SAMPLES):
            t = pitman_yor.seat(n, (1 + discount * t.sum()) * base, discount, key, sweep)
            if sweep >= pitman_yor.BURN:
                gives += (n - discount * t) / (1 + n.sum()) / pitman_yor.SAMPLES
                left += (1 + discount * t.sum()) / (1 + n.sum()) / pitman_yor.SAMPLES
        return dict(zip(ws, gives, strict=True)), left

    tables, want = {}, []
    for (i, _), (ws, _) in zip(rows, split, strict=True):
        score, last = 0.0, None
        for k, (u, w) in enumerate(zip([None, *ws], [*ws, None], strict=True)):
            frequent = u is not None and symbols[u] & 0xFFFFFFFF < f
            last = symbols[u] & 0xFFFFFFFF if frequent else last
            context = 2 * f if k == 0 else last if frequent else 2 * f + 1 if last is None else f + last
            if u not in tables:
                tables[u] = restaurant(u)
            gives, left = tables[u]
            score += math.log10(gives.get(w, 0.0) + left * 10 ** parent(context, w))
        want.append((-1 if i is None else i, score))
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.score) for r in lm.lm_scores(d).collect())
    assert [i for i, _ in got] == [i for i, _ in sorted(want)]
    assert [s for _, s in got] == pytest.approx([s for _, s in sorted(want)], rel=2e-5, abs=2e-4)


def test_lm_keeps_little_on_disk(spark, monkeypatch):
    """What was read for the last time is deleted; blobs of sorted columns give back what they were made of, in few bytes."""
    staged = Path(common.shared_dir(spark).removeprefix("file://"), "staged")
    before = set(staged.glob("*"))
    monkeypatch.setattr(lm, "BROADCAST", 40)
    monkeypatch.setattr(lm, "FREQUENT", 40)
    lm.fit(spark.createDataFrame([(t,) for _, t in _lm_texts()], "text string"))
    assert sorted(p.name.rsplit("-", 1)[0] for p in set(staged.glob("*")) - before) == ["restaurants", "words-scored"]
    rng = np.random.default_rng(3)
    columns = np.sort(rng.integers(-(2**63), 2**63 - 1, 5000)), rng.integers(0, 9, 5000), rng.random(5000).astype(np.float32).astype(float).view(np.int64)
    blob = lm._dealt(np.arange(5000) % 2, 3, *columns)
    assert blob.column(0).to_pylist() == [0, 1] and blob.column(2).to_pylist() == [2500, 2500]
    for part, n, raw in zip(*(blob.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
        assert (lm._unpack(raw, n, 3) == np.stack([c[part::2] for c in columns])).all()
        assert len(raw) < 13 * n
    assert (lm._unpack(lm._pack(columns[0][:1]), 1, 1) == columns[0][:1]).all()


def test_lm_words_as_split_and_hashed_one_by_one():
    rng = np.random.default_rng(7)
    odd = [None, b"", b" ", b"End", b"begin A-Z\xff\x00b", "É\xa0é \x85 ß".encode() + b"\x1c\x1f \x0b\x0c", *(b"Qz9"[i % 3 : i % 3 + 1] * i for i in range(1, 41))]
    texts = [*odd, *(bytes(rng.choice(list(b"aZ \t\n\xc3\xa9"), rng.integers(0, 90))) for _ in range(300))]
    words = sorted({w for t in texts for w in lm.tokens(t)}, key=lm._hash)
    known = np.sort(np.array([lm._hash(w) for w in words[::2]], np.uint64))
    s = lm.Symbols(known[::10].copy(), known)
    column = pa.array([b"left out", *texts], pa.binary())[1:]
    seen = []
    for i, j, t in lm._texts(column):
        got, seen = s.read(t), [*seen, *range(i, j)]
        want = [w for x in texts[i:j] for w in [*lm.tokens(x), None]]
        assert got.text.tolist() == [k for k, x in enumerate(texts[i:j]) for _ in [*lm.tokens(x), None]]
        at = np.array([k for k, w in enumerate(want) if w is not None])
        assert got.words(at) == [want[k] for k in at]
        place = {int(h): k for k, h in enumerate(known, 1)}
        ids = [0 if w is None else place.get(lm._hash(w)) or int(np.uint64(lm._hash(w)).astype(np.int64)) for w in want]
        assert got.w.tolist() == ids and got.u.tolist() == [0, *ids[:-1]]
        assert got.symbol.tolist() == [s.end if w is None else s[w] for w in want]
    assert seen == list(range(len(texts)))


def test_lm_reading_keeps_no_words():
    """What a worker has read is gone: a corpus of ever new words takes no more memory than one of few."""
    s = lm.Symbols(np.empty(0, np.uint64), np.array([1], np.uint64))
    column = pa.array([" ".join(f"w{i}x{k}" for k in range(1000)).encode() for i in range(200)], pa.binary())
    tracemalloc.start()
    try:
        tokens = sum(len(s.read(t).text) for _, _, t in lm._texts(column))
        gc.collect()
        assert tokens == 200 * 1001 and tracemalloc.get_traced_memory()[0] < 5_000_000
    finally:
        tracemalloc.stop()


def test_model_is_normalised():
    rng = np.random.default_rng(0)
    code = np.unique(rng.integers(0, 200, 90))
    m = pitman_yor.Model(code // 20, code % 20, rng.integers(1, 50, len(code)), [10, 1], [np.zeros(10, np.int64)], 20)
    assert m.predictive().sum(axis=1) == pytest.approx(np.ones(10), abs=1e-5)


def test_speller_is_normalised():
    words = [b"abba", b"ab", b"b", "é".encode()]
    context, dish, _ = lm._spelt(words)
    code, n = np.unique(context * lm.BYTES + dish, return_counts=True)
    s = lm.fit_speller(code, n)
    assert (10.0 ** s.table.astype(float)).sum(axis=1) == pytest.approx(np.ones(len(s.table)), abs=1e-4)
    assert s.log10([b"ab"])[0] > s.log10([b"qz"])[0]


def test_seating_follows_the_urn():
    n = np.full(4000, 12.0)
    t = pitman_yor.seat(n, np.full(4000, 0.7), 0.4, np.arange(4000), 0)
    p = np.array([1.0])  # exact distribution of tables by the sequential rule
    for i in range(1, 12):
        k = np.arange(1, len(p) + 1)
        new = 0.7 / (0.7 + i - 0.4 * k)
        p = np.append(p * (1 - new), 0) + np.append(0, p * new)
    assert t.mean() == pytest.approx((p * np.arange(1, 13)).sum(), abs=0.05)
    assert t.min() >= 1 and t.max() <= 12
    assert (pitman_yor.seat(n, np.full(4000, 0.7), 0.4, np.arange(4000), 0) == t).all()
