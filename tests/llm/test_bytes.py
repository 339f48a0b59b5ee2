"""Near duplicates, archives, encodings, media and the pipeline against brute force, the library and exact round trips."""

import base64
import gzip
import hashlib
import random
import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
import sentencepiece

import corpus_pipeline
from intervale.llm import graph, jaccard, media, pieces, warc

DATA = "/root/testdata/sf0.001"


def _set(text):
    w = (text or "").encode().lower().split()
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def _components(rows):
    sets, up = defaultdict(list), {}
    for i, t in rows:
        if i is not None:
            sets[i].append(_set(t))
            up[i] = i

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(sets, 2):
        if any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    return sorted((i if i is not None else -1, len(_set(t)), top(i) if i is not None else None) for i, t in rows)


def _family(rng, n, words, edits, first):
    base = [f"v{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for k in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        out.append((first + k, " ".join(w)))
    return out


@pytest.fixture(scope="module")
def copies():
    rng = random.Random(4)
    rows = [(None, "no id at all here it is"), (1, None), (2, ""), (3, ""), (4, "one two"), (5, "ONE  two"), (6, "one two three"), (7, "a b c d e"), (8, "A b\tc d\ne"), (9, "a b c d e f"), (9, "a b c d e f"), (12, "other text"), (12, "a b c d e f g")]
    rows += _family(rng, 60, 120, 7, 100) + _family(rng, 40, 30, 2, 300) + _family(rng, 12, 900, 30, 500) + _family(rng, 30, 9, 1, 700)
    common = " ".join(f"p{i}" for i in range(60))
    rows += [(900 + i, common + " " + " ".join(f"u{i}x{j}" for j in range(rng.randrange(2, 90)))) for i in range(25)]
    rng.shuffle(rows)
    return rows


def test_near_duplicates(spark, copies):
    d = spark.createDataFrame([(i, t, 1, "k") for i, t in copies], "doc_id long, text string, component_id long, key string")
    got = jaccard.near_duplicates(d).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id) for r in got) == _components(copies)
    assert jaccard.near_duplicates(d.where("false")).count() == 0
    kept = jaccard.keep_one(d)
    want = {c for _, _, c in _components(copies)} - {None}
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == d.columns and sorted(i for i in ids if i is not None) == sorted(want) and ids.count(None) == 1


def test_which_row_of_an_id_stays_does_not_depend_on_order(spark):
    rows = [(i, f"{k} of {i} " + "x " * k) for i in range(8) for k in range(6)]
    want = {i: min((t for j, t in rows if j == i), key=lambda t: hashlib.md5(t.encode()).hexdigest()) for i in range(8)}
    d = spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.text for r in jaccard.keep_one(d).collect()}.items() <= want.items()


def test_small_blocks_find_the_same(spark, copies, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 5)
    monkeypatch.setattr(jaccard, "LARGE", 3)
    monkeypatch.setattr(jaccard, "TRIES", 1)
    d = spark.createDataFrame(copies, "doc_id long, text string").repartition(5)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(d).collect())
    assert got == _components(copies)


def test_lists_of_partners_in_several_rows_find_the_same(spark, copies, monkeypatch):
    monkeypatch.setattr(jaccard, "PARTNERS", 2)
    d = spark.createDataFrame(copies, "doc_id long, text string").repartition(5)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(d).collect())
    assert got == _components(copies)


def test_no_row_lists_more_partners_than_stated(spark, monkeypatch):
    """A document linked with many others keeps every link."""
    monkeypatch.setattr(jaccard, "PARTNERS", 3)
    base = [f"s{k}" for k in range(200)]
    rows = [(i, " ".join([*base, f"own{i}"])) for i in range(11)]
    pairs = spark.createDataFrame([(0, i) for i in range(1, 11)] + [(1, 2)], "a bigint, b bigint")
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    seen, raw = [], jaccard._raw
    monkeypatch.setattr(jaccard, "_raw", lambda df, *more: (seen.append(df) if "others" in df.columns else None, raw(df, *more))[1])
    assert sorted(map(tuple, jaccard.linked(pairs, d).collect())) == sorted([(0, i) for i in range(1, 11)] + [(1, 2)])
    lists = [r.others for r in seen[0].select("others").collect()]
    assert max(map(len, lists)) <= 3 and sorted(x for o in lists for x in o) == sorted([*range(1, 11), 2])


def test_similar_sets_share_a_key():
    rng = np.random.default_rng(3)
    for n in [1, 2, 4, 5, 6, 7, 9, 13, 20, 50, 200, 1500]:
        for _ in range(40 if n < 300 else 5):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.int64).astype(np.uint64))
            m = int(rng.integers(0, jaccard.differ(len(a), len(a)) + 1))
            drop = int(rng.integers(0, m + 1))
            b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 1 << 63, m - drop, dtype=np.int64).astype(np.uint64)]))
            if jaccard.similar(a, b):
                assert jaccard.distance(jaccard.sketch(a), jaccard.sketch(b)) <= len(np.setxor1d(a, b)) <= jaccard.differ(len(a), len(b))
                assert len(np.intersect1d(jaccard.part_keys(a), jaccard.part_keys(b)))


def _without_spare(h, last):
    """Keys of a set when in each band and space those in ``last``, then larger ones, are left out as far as the set can do without."""
    keys, spare = jaccard._part_keys(h)
    out = set()
    for code in set((keys & np.uint64(255)).tolist()):
        own = sorted((int(k) in last, int(k)) for k in np.unique(keys[(keys & np.uint64(255)) == code]))
        out |= {k for _, k in own[: max(0, len(own) - int(spare[code & 3]))]}
    return out


def test_similar_sets_share_a_key_that_neither_can_spare():
    rng = np.random.default_rng(8)
    pairs = 0
    for n in [1, 2, 3, 4, 5, 6, 8, 9, 12, 13, 19, 28, 50, 200, 900]:
        for _ in range(60 if n < 300 else 5):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.int64).astype(np.uint64))
            m = int(rng.integers(0, jaccard.differ(len(a), len(a)) + 1))
            drop = int(rng.integers(0, m + 1))
            b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 1 << 63, m - drop, dtype=np.int64).astype(np.uint64)]))
            if jaccard.similar(a, b):
                both = set(np.intersect1d(jaccard.part_keys(a), jaccard.part_keys(b)).tolist())
                some = {k for k in both if rng.random() < 0.7}
                pairs += 1
                for last in (both, some, set()):  # shared keys are the most frequent, some of them are, none
                    assert _without_spare(a, last) & _without_spare(b, last)
    assert pairs > 200


def test_a_phrase_that_all_share_brings_no_pairs(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, "a phrase of five words " + " ".join(f"w{rng.randrange(10**9)}" for _ in range(40))) for i in range(3000)]
    rows += [(5000, rows[7][1] + " more"), (5001, rows[2999][1] + " end")]
    seen = []
    rarer = jaccard._rarer

    def spied(keys, info, large):
        out = rarer(keys, info, large)
        seen.append((large.agg({"n": "max"}).first()[0], jaccard._mixed(out, spark.createDataFrame([], "node long, root long")).agg({"n": "max"}).first()[0]))
        return out

    monkeypatch.setattr(jaccard, "_rarer", spied)
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    assert got == {i: {5000: 7, 5001: 2999}.get(i, i) for i, _ in rows}
    assert seen and seen[0][0] > 100 and (seen[0][1] or 0) < 10


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(50)] + [(7, 7)]
    up = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: r for x, r in up.items() if any(x in e and e[0] != e[1] for e in edges)}
    assert {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long"), in_task=0).collect()} == got
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


PAGES = [(1, "http://x/é y\n", "<p>" + "a" * 200), (2, None, "<p>" + "a" * 200), (0, "http://z", "<p>" + "a" * 200), (3, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (None, "u", "<p>" + "a" * 200), (8, "u", "WARC/1.1\r\n\r\n" * 30), (9, "u", "é" * 500_000)]


@pytest.mark.parametrize("split", [64, 700, 1 << 20])
def test_warc_roundtrip(spark, tmp_path, split):
    rows = PAGES + [(100 + i, f"http://h/{i}", f"<html>{i}" + "x" * (i * 37 % 900)) for i in range(60)]
    d = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, record_type string").repartition(3)
    path = f"file://{tmp_path}/w"
    warc.write_warc(d, path)
    got = warc.read_warc(spark, path, split).collect()
    assert len(got) == len(rows)
    kinds = {r.page_id: (r.record_type, r.refers_to) for r in got}
    assert kinds[0] == ("response", None) and kinds[1] == kinds[2] == kinds[None] == ("revisit", 0) and kinds[5] == kinds[6] == ("response", None)
    html = dict((i, (h or "").encode()) for i, _, h in rows)
    for r in got:
        assert r.payload_digest == hashlib.sha256(html[r.page_id]).hexdigest() and r.payload_bytes == len(html[r.page_id])
        assert r.payload == (None if r.record_type == "revisit" else html[r.page_id])
    for f in (tmp_path / "w").glob("part-*"):  # what gzip itself reads
        if f.stat().st_size:
            assert gzip.open(f).read().startswith(b"WARC/1.1\r\n")


def test_warc_reader_survives_false_magic(tmp_path):
    inner = gzip.compress(b"not a record") + warc.MAGIC + b"junk" + zlib.compressobj(0, zlib.DEFLATED, 31).compress(b"")
    record = warc._record(1, "u", inner * 50, hashlib.sha256(inner * 50).hexdigest(), None)
    stored = zlib.compressobj(0, zlib.DEFLATED, 31)
    plain = zlib.decompress(record, 31)
    data = (stored.compress(plain) + stored.flush()) * 3  # stored blocks show the payload's bytes as they are
    (tmp_path / "f").write_bytes(data)

    class File:
        def read_at(self, n, at):
            return data[at : at + n]

    for split in (100, 997, 1 << 20):
        found = [x for at in range(0, len(data), split) for x in warc.members(File(), len(data), at, min(at + split, len(data)))]
        assert [x[1] for x in found] == [plain] * 3


def test_warc_reader_raises_at_damage():
    record = [warc._record(i, "u", bytes([65 + i]) * 300, hashlib.sha256(bytes([65 + i]) * 300).hexdigest(), None) for i in range(4)]
    size = [len(x) for x in record]
    hurt = record[2][:40] + bytes(60) + record[2][100:]

    def read(data, split):
        class File:
            def read_at(self, n, at):
                return data[at : at + n]

        return [x for at in range(0, len(data), split) for x in warc.members(File(), len(data), at, min(at + split, len(data)))]

    whole = b"".join(record)
    for split in (50, size[0], size[0] + 5, 1 << 20):
        assert len(read(whole, split)) == 4
        for data in (record[0] + record[1] + hurt + record[3], whole[:-30], whole + b"padding", record[0] + bytes(9) + whole):
            with pytest.raises(ValueError, match="damaged"):
                read(data, split)

    class Padded:  # a sound record in the middle, something else behind it
        def read_at(self, n, at):
            return (record[0] + record[1] + b"padding")[at : at + n]

    found = warc.members(Padded(), size[0] + size[1] + 7, size[0] - 5, size[0] + 5)
    assert next(found)[0] == size[0]


def _foreign(kind, block, **fields):
    head = [f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:0f1e>", "WARC-Date: 2020-02-02T00:00:00Z", *(f"{k.replace('_', '-')}: {v}" for k, v in fields.items()), f"Content-Length: {len(block)}"]
    return "\r\n".join(["WARC/1.0", *head, "", ""]).encode() + block + b"\r\n\r\n"


@pytest.mark.parametrize("split", [90, 1 << 20])
def test_archives_of_others_are_read(spark, tmp_path, split):
    body = b"<html>found</html>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nX-Long: one\r\n two\r\n\r\n"
    sha1 = "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
    info, ask = _foreign("warcinfo", b"software: none\r\n"), _foreign("request", b"GET / HTTP/1.1\r\nHost: x\r\n\r\n", Content_Type="application/http;msgtype=request")
    answers = [
        _foreign("response", http + body, WARC_Payload_Digest=sha1, WARC_Target_URI="http://x/"),
        _foreign("response", http + body + b"!", WARC_Payload_Digest=sha1),
        _foreign("response", http.replace(b"X-Long", b"Transfer-Encoding") + body, WARC_Payload_Digest="sha1:AAAA"),
        _foreign("response", http + body[:3], WARC_Payload_Digest=sha1, WARC_Truncated="length"),
        _foreign("resource", body, WARC_Payload_Digest="sha256:" + hashlib.sha256(body).hexdigest()),
        _foreign("revisit", http[:-2] + b"\r\n", WARC_Payload_Digest=sha1, WARC_Refers_To="<urn:uuid:0f1e>"),
        _foreign("metadata", b"", WARC_Payload_Digest="crc:1"),
    ]
    d = tmp_path / "w"
    d.mkdir()
    (d / "x.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in (info + ask, *answers)))
    got = warc.read_warc(spark, f"file://{d}", split).orderBy("offset").collect()
    assert sorted(r.record_type for r in got) == sorted(["warcinfo", "request", "response", "response", "response", "response", "resource", "revisit", "metadata"])
    assert [r.sound for r in got if r.record_type == "response"] == [True, False, None, None]
    by = {r.record_type: r for r in got}
    assert by["resource"].sound and by["resource"].payload == body and by["metadata"].sound is None and by["metadata"].payload == b""
    assert by["revisit"].refers_to_id == "<urn:uuid:0f1e>" and by["revisit"].payload_bytes is None and by["revisit"].payload_digest is None
    assert all(r.page_id is None and r.refers_to is None and r.record_id == "<urn:uuid:0f1e>" for r in got)
    assert by["request"].payload == b"" and by["warcinfo"].payload == b"software: none\r\n"
    assert got[-1].payload_digest == hashlib.sha256(b"").hexdigest()


@pytest.fixture(scope="module")
def model():
    path = pieces.default_model()
    return pieces.load(path), sentencepiece.SentencePieceProcessor(model_file=path)


def test_encoding_is_the_librarys(model):
    ours, theirs = model
    rng = random.Random(5)
    pool = list(ours.id)
    letters = "  \n\tabcdefghijklmnoprstuvwéßñABCთ日本語𝄞.,;:(){}\r0123456789▁<>"
    texts = ["", " ", "   a", "a   ", "▁a▁", "<s>x</s><0x0A>", "\x00é", "a" * 3000, " " * 70, "ab" * 2000, "x\n\n y"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(3000)]
    texts += ["".join(rng.choice(pool) for _ in range(rng.randrange(1, 9))) for _ in range(3000)]
    for t in texts:
        ids = theirs.encode(t)
        assert ours.encode(t) == ids, t
        assert ours.decode(ids) == theirs.decode(ids)
        n, a, b = ours.digest(t)
        assert (n, a, b) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(theirs.decode(ids).encode()).hexdigest())
    for _ in range(2000):
        ids = [rng.randrange(3, rng.choice([259, 32000])) for _ in range(rng.randrange(12))]
        assert ours.decode(ids) == theirs.decode(ids), ids


def test_encoding_queries(spark, model):
    rows = [(1, "Hello wörld\n", [1]), (None, None, None), (2, "", [])]
    d = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>")
    e = pieces.encode_texts(d)
    assert [list(r.ids) for r in e.collect()] == [model[1].encode(t or "") for _, t, _ in rows]
    assert [r.text for r in pieces.decode_ids(e).collect()] == ["Hello wörld\n", "", ""]
    assert pieces.digests(d).count() == 3 and pieces.digests(d.where("false")).count() == 0


def test_media_roundtrip(spark):
    texts = [None, "", "a", "x" * 192, "P6\n64 1\n255\n" + "é" * 300, "RIFF BM GIF89a .snd" * 40]
    d = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, feature string")
    for r in media.store_texts(d).collect():
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + b" " * ((-len(raw)) % 192 if raw else 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        for kind in range(5):
            m = media.store(payload, kind)
            found = media.scan(m)
            assert found[0].start == 0 and found[0].length == len(m) and found[0].mime == media.TYPES[kind]
            assert media.read_back(m, found[0]) == payload
            assert media.sniff(m, "image/gif")[:2] == (media.TYPES[kind], True)
    assert media.store_texts(d.where("false")).count() == 0


def test_carving(spark):
    png, bmp = media.store(b"z" * 192, 4), media.store(b"y" * 384, 1)
    blob = b"head" + png + b"BM....RIFFxx" + bmp + b"tail"
    gif = b"GIF89a\x01\x00\x01\x00\x80\x00\x00" + b"\0" * 6 + b"\x2c" + b"\0" * 8 + b"\0\x02\x02\x4c\x01\0;"
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x02data\xff\xd9"
    assert [(f.mime, f.start, f.length) for f in media.scan(gif + b"x" + jpeg)] == [("image/gif", 0, len(gif)), ("image/jpeg", len(gif) + 1, len(jpeg))]
    broken = bytearray(png)
    broken[-5] ^= 1
    assert media.scan(bytes(broken)) == []
    got = {(r.mime, r.start, bytes(r.bytes)) for r in media.carve(spark.createDataFrame([(bytearray(blob),), (None,)], "content binary")).collect()}
    assert got == {("image/png", 4, png), ("image/bmp", 4 + len(png) + 12, bmp)}
    typed = media.correct_types(spark.createDataFrame([(bytearray(png), "image/bmp"), (None, None), (bytearray(b"text"), "text/plain")], "content binary, declared string")).collect()
    assert [(r.mime, r.corrected) for r in typed] == [("image/png", True), ("application/octet-stream", True), ("text/plain", False)]


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near duplicates", "secrets", "mix", "encode"] and corpus_pipeline.ORACLE_SQL is None
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, DATA)
    rows = {r.doc_id: r.text for r in docs.collect()}
    want = {c for _, _, c in _components(list(rows.items()))}
    assert {r.doc_id for r in kept.collect()} == want and kept.columns == list(corpus_pipeline.COLUMNS)
    clean = corpus_pipeline.mask_secrets(spark, docs, DATA)
    for r in clean.collect():
        assert r.n_chars == len(r.text)
        if "[secret]" not in r.text:
            assert r.text == rows[r.doc_id]
    safe = corpus_pipeline.drop_toxic(spark, docs, DATA)
    assert 0.6 * docs.count() < safe.count() <= docs.count() and safe.columns == list(corpus_pipeline.COLUMNS)
    mixed = corpus_pipeline.mix_sources(spark, docs, DATA)
    assert {r.doc_id for r in mixed.collect()} <= set(rows) and mixed.count() > docs.count() / 2
    out = corpus_pipeline.run(spark, DATA)
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    some = out.limit(5).collect()
    assert some and all(r.n_tokens == len(r.ids) for r in some)
    assert all(sp.decode(list(r.ids)) == rows[r.doc_id] for r in some if "[secret]" not in sp.decode(list(r.ids)))


ROWS = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, None, None, "a", None), (3, "a fine day at the sea " * 3, "en", None, 66), (3, "a fine day at the sea " * 3, "en", None, 66), (4, "token=abcdefgh12 " + "w " * 30_000, "en", "b", 7), (None, "no id", "en", "b", 5)]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_pipeline_stages_on_awkward_rows(spark, name, tmp_path):
    """Nulls, empty and long texts, repeated rows, clashing columns, empty tables, no labels: each stage ends with the stated rows."""
    stage = dict(corpus_pipeline.STAGES)[name]
    spark.createDataFrame([(9, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    d = spark.createDataFrame([(*r, "x", "y", 0.5, "z") for r in ROWS], "doc_id long, text string, lang string, source string, n_chars long, dropped string, key string, toxic_score double, of string")
    out = stage(spark, d, str(tmp_path))
    rows = out.collect()
    columns = ["doc_id", "source", "n_tokens", "ids"] if name == "encode" else list(corpus_pipeline.COLUMNS)
    assert out.columns == columns and stage(spark, d.where("false"), str(tmp_path)).count() == 0
    if name in ("toxicity", "secrets", "encode"):
        assert len(rows) == len(ROWS)
    if name == "near duplicates":
        assert sorted(r.doc_id or 0 for r in rows) == [0, 0, 1, 2, 3, 4]
    if name == "secrets":
        assert {r.text[:10] for r in rows if r.doc_id == 4} == {"token=[sec"} or all("abcdefgh12" not in (r.text or "") for r in rows)
        assert all((r.n_chars is None) == (r.text is None) for r in rows)
    if name == "mix":
        assert {r.doc_id for r in rows} <= {None, 3, 4} and all(r.text for r in rows)


def test_keep_one_beside_any_column(spark):
    d = spark.createDataFrame([(1, "a b c d e f g", "p", "q", "r"), (2, "a b c d e f g", "p", "q", "r"), (3, "other", "p", "q", "r"), (3, "other", "p", "q", "r")], "doc_id long, text string, dropped string, of string, least string")
    got = jaccard.keep_one(d)
    assert got.columns == d.columns and sorted(r.doc_id for r in got.collect()) == [1, 3]
