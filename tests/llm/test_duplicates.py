"""Archives, n-gram join, suffix dedup, media and the pipeline."""

import gzip
import hashlib
import io
import json
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stratagraph.llm import bpe, decontam, media, ngram_join, suffix_dedup, toxicity, warc
from stratagraph.llm.components import components
from stratagraph.llm.textcore import sets


def tup(df, *cols):
    return sorted((tuple(-1 if v is None else v for v in r) for r in df.select(*cols).collect()))


def test_normaliser():
    payloads = [b"", b"a" * 5, b"\r\n\r\nWARC/1.1\r\n", bytes(range(256)) * 900]
    raw = [warc.record(i, "http://x/\n", p, hashlib.sha256(p).hexdigest(), "response", None) for i, p in enumerate(payloads)]
    for mono in (gzip.compress(b"".join(raw)), b"".join(gzip.compress(r) for r in raw)):
        out, index = io.BytesIO(), io.BytesIO()
        assert warc.normalise(io.BytesIO(mono), out, index) == 4
        at = [json.loads(x) for x in index.getvalue().splitlines()]
        assert [warc.read_member(out, x["offset"], x["length"])[1] for x in reversed(at)] == payloads[::-1]
        assert gzip.decompress(out.getvalue()) == b"".join(raw)
    with pytest.raises(EOFError):
        warc.normalise(io.BytesIO(gzip.compress(raw[3][:-900])), io.BytesIO(), io.BytesIO())
    whole = zlib.compressobj(1, zlib.DEFLATED, 31)
    cut = whole.compress(b"".join(raw[:3])) + whole.flush(zlib.Z_SYNC_FLUSH)  # whole records, but the stream goes on
    for data in (cut, mono[:-8], gzip.compress(raw[0])[:-3], b"".join(gzip.compress(r) for r in raw)[:-1]):
        with pytest.raises(EOFError):
            warc.normalise(io.BytesIO(data), io.BytesIO(), io.BytesIO())
    assert warc.normalise(io.BytesIO(b""), io.BytesIO(), io.BytesIO()) == 0


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 300)
    big, small = "<p>é</p>" * 30, "tiny"
    rows = [(5, big), (3, big), (9, big), (1, small), (2, small), (4, None), (6, ""), (7, "z" * 100), (7, "z" * 100), (None, big), (8, "q" * 100)]
    pages = spark.createDataFrame([(i, "http://u", h, "r", 1) for i, h in rows], "page_id long, url string, html string, record_type string, refers_to int")
    got = tup(warc.round_trip(pages), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    want = []
    for i, h in rows:
        b = (h or "").encode()
        same = [j for j, x in rows if x == h and j is not None]
        revisit = len(b) >= 100 and i != min(same)
        want.append((-1 if i is None else i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", min(same) if revisit else -1))
    assert got == sorted(want)
    assert warc.round_trip(pages.limit(0)).count() == 0


def brute_join(rows):
    s = sets([t or "" for _, t in rows])
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(np.intersect1d(s[i], s[j], assume_unique=True))
            if len(s[i]) and len(s[j]) and 100 * common >= 80 * (len(s[i]) + len(s[j]) - common):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min([x for x in (k, least.get(find(i))) if x is not None], default=None)
    return sorted((-1 if k is None else k, len(s[i]), -1 if least[find(i)] is None else least[find(i)]) for i, (k, _) in enumerate(rows))


def families(seed, n=14, most=40):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(500)]
    passage = rng.choices(vocab, k=30)
    out = []
    for f in range(n):
        base = rng.choices(vocab, k=rng.choice([1, 3, 5, 6, 8, 9, 10, 12, 14, 20, 40, 90, 300]))
        for _ in range(rng.randint(1, most)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                p = rng.randrange(len(w) + 1)
                w[p : p + rng.choice([0, 1])] = [rng.choice(vocab)]
            out.append(" ".join(w + (passage if f % 3 == 0 else [])))
    rng.shuffle(out)
    return [(i * 3 % 1009, t) for i, t in enumerate(out)]


@pytest.mark.parametrize(("seed", "block", "stars", "small"), [(1, 6_000_000, 3, 4), (2, 6_000_000, 0, 4), (3, 3_000, 1, 0)])
def test_join_equals_brute_force(spark, monkeypatch, seed, block, stars, small):
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", block)
    monkeypatch.setattr(ngram_join, "PART_BYTES", 10 * block)
    monkeypatch.setattr(ngram_join, "STARS", stars)
    monkeypatch.setattr(ngram_join, "SMALL", small)
    rows = families(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert tup(ngram_join.join(docs), "doc_id", "n_shingles", "component_id") == brute_join(rows)


def test_join_of_odd_rows(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert tup(ngram_join.join(odd), "doc_id", "n_shingles", "component_id") == brute_join(rows)
    assert ngram_join.join(none).count() == 0
    kept = ngram_join.representatives(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 1


def left_out(keys, segments, leave, cost):
    """The dearest keys, of so many segments at most."""
    out, seen = set(), set()
    for key, segment in sorted(zip(keys.tolist(), segments.tolist(), strict=True), key=lambda x: (-cost[x[0]], x[0])):
        seen.add(segment)
        if len(seen) > leave:
            break
        out.add(key)
    return out


def test_segments_keep_every_link():
    rng = np.random.default_rng(0)
    forms, linked = {f for *_, f in ngram_join.bands(1 << 17)}, 0
    assert len(forms) > 1
    for n in [1, 2, 4, 5, 7, 8, 9, 10, 13, 17, 25, 26, 40, 41, 80, 150, 400, 900, 2500]:
        for _ in range(20):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            room = len(a) // 9 + 1
            b = np.unique(np.append(a[int(rng.integers(0, room + 1)) :], rng.integers(0, 1 << 63, int(rng.integers(0, room + 1)), dtype=np.uint64)))
            common = len(np.intersect1d(a, b))
            if len(a) < 2 or len(b) < 2 or len(a) == len(b) == common or not ngram_join.linked(np.array(common), np.array(len(a)), np.array(len(b))):
                continue
            rows = np.zeros(2, ngram_join._SET)
            rows["n"], rows["sketch"] = [len(a), len(b)], [ngram_join.parity_sketch(a), ngram_join.parity_sketch(b)]
            assert ngram_join.may_link(rows, np.array([0]), np.array([1])).all()
            assert ngram_join.wide_may_link(ngram_join.wide_sketch(a), ngram_join.wide_sketch(b))
            ours, theirs = ({k: x for k, *x in ngram_join.keys_of(x)} for x in (a, b))
            cost = dict.fromkeys((int(k) for x in (ours, theirs) for _, keys, _ in x.values() for k in keys), 1)
            for k in cost:
                cost[k] = int(rng.integers(2, 9))
            kept = []
            for side in (ours, theirs):
                kept.append({(band, k) for band, (leave, keys, segments) in side.items() for k in set(keys.tolist()) - left_out(keys, segments, leave, cost)})
            assert kept[0] & kept[1]
            linked += 1
    assert linked > 150


def test_few_texts_are_dealt_out_that_are_not_wanted(spark, monkeypatch):
    """Of all rows the wanted ones go on, and those whose bit they share; a small map lets more of them go on and loses none."""
    docs = spark.range(20_000).select(F.xxhash64("id").alias("row"), F.lit("x").alias("text"))
    wanted = spark.range(0, 20_000, 200).select(F.xxhash64("id").alias("row"))
    for words, most in ((ngram_join.MAP_WORDS, 110), (16, 5000), (1, 20_000)):
        monkeypatch.setattr(ngram_join, "MAP_WORDS", words)
        got = ngram_join._perhaps(docs, wanted)
        assert got.columns == ["row", "text"]
        assert 100 <= got.count() <= most and got.join(wanted, "row").count() == 100


def test_sets_of_repeated_rows_come_once(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "h i j k l m"), (3, "n o p q r s")], "row long, text string")
    handles = [(ngram_join.set_hash(s), r) for s, r in zip(ngram_join.sets(["a b c d e f g", "h i j k l m"]), (1, 2), strict=True)]
    got = ngram_join._elements(docs, spark.createDataFrame(handles, "handle binary, row long")).collect()
    assert sorted((bytes(r.handle), len(r.elements) // 8, int.from_bytes(r.wide[:8], "little")) for r in got) == sorted((h, n, n) for (h, _), n in zip(handles, (3, 2), strict=True))


def test_wide_sketches():
    rng = np.random.default_rng(5)
    for n, m in ((1, 1), (3, 2), (64, 65), (128, 129), (900, 1100), (5000, 4100)):
        x = np.unique(rng.integers(0, 1 << 63, 2 * n + m, dtype=np.uint64))
        for common in {0, min(n, m) // 2, min(n, m)}:
            a, b = x[:n], x[n - common : n - common + m]
            differ = n + m - 2 * common
            assert ngram_join.wide_may_link(ngram_join.wide_sketch(a), ngram_join.wide_sketch(b)) == ngram_join.wide_may_link(ngram_join.wide_sketch(b), ngram_join.wide_sketch(a))
            if 9 * differ <= n + m:
                assert ngram_join.wide_may_link(ngram_join.wide_sketch(a), ngram_join.wide_sketch(b))
            if n > 50 and 3 * differ > n + m:
                assert not ngram_join.wide_may_link(ngram_join.wide_sketch(a), ngram_join.wide_sketch(b))


def test_components(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(50)] + [(100, 200), (300, 300)], "a long, b long")
    got = dict(map(tuple, components(edges).collect()))
    assert got[50] == 0 and got[200] == 100 and 300 not in got


def test_suffix_array_and_prefixes():
    rng = random.Random(2)
    for data in (b"banana" * 40, bytes(rng.choice(b"ab") for _ in range(900)), b"a" * 300, bytes(rng.randrange(256) for _ in range(300)), b"x"):
        sa = suffix_dedup.suffix_array(np.frombuffer(data, np.uint8), 50)
        key = lambda i: data[i : i + 50]
        assert sorted(sa.tolist()) == list(range(len(data)))
        assert all(key(a) <= key(b) for a, b in zip(sa, sa[1:], strict=False))
        lcp = suffix_dedup.common_prefixes(np.frombuffer(data, np.uint8), sa, np.array([0]), 2000)
        for k in range(1, len(sa)):
            a, b, n = sa[k - 1], sa[k], 0
            while a + n < len(data) and b + n < len(data) and data[a + n] == data[b + n]:
                n += 1
            assert lcp[k] == n


@pytest.mark.parametrize("shard", [1_000_000, 3000])
def test_suffix_dedup_equals_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", shard)
    rng = random.Random(3)
    alphabet = "abcdefgh é"
    make = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    base = make(3000)
    passage = base[:900]
    rows = [None, "", "a" * 1000, "ab" * 700, base, base, base[:1500] + "X" + base[1501:], base[1000:1399], base[1000:1400], "q" * 500] + [make(rng.randint(0, 700)) + passage + make(rng.randint(0, 700)) for _ in range(40)]
    docs = spark.createDataFrame([(i if i % 7 else None, t) for i, t in enumerate(rows)], "doc_id long, text string")
    got = sorted(tuple(r)[1:5] for r in suffix_dedup.report(docs).collect())
    assert got == sorted(suffix_dedup.brute_force([(t or "").encode() for t in rows]))


def test_suffix_dedup_of_odd_rows(odd, none):
    rows = odd.collect()
    want = sorted(suffix_dedup.brute_force([(r.text or "").encode() for r in rows]))
    assert sorted(tuple(r)[1:5] for r in suffix_dedup.report(odd).collect()) == want
    assert suffix_dedup.report(none).count() == 0
    left = suffix_dedup.strip_text(odd)
    assert left.columns == odd.columns and left.where("text is null").count() == 1
    assert left.where("text is not null").agg(F.sum(F.length("lang"))).first()[0] == odd.where("text is not null").agg(F.sum(F.length("lang"))).first()[0]


def test_suffix_dedup_of_texts_that_many_rows_have(spark, monkeypatch):
    rng = random.Random(9)
    make = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    a, b = make(2000), make(900)
    rows = [a] * 30 + [b] + [make(300) + a[500:1100] + make(200), make(1500), b[:450]]
    docs = spark.createDataFrame([(f"id{i % 9}", t) for i, t in enumerate(rows)], "doc_id string, text string").repartition(4)
    plain = docs.select(F.xxhash64("doc_id", "text").alias("row"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("handle"), "text")
    assert suffix_dedup.copied_texts(plain) == {}
    one = {hashlib.md5(a.encode()).digest(): min(r.row for r in plain.collect() if r.text == a)}
    monkeypatch.setattr(suffix_dedup, "copied_texts", lambda _: one)
    assert sorted(tuple(r)[1:5] for r in suffix_dedup.report(docs).collect()) == sorted(suffix_dedup.brute_force([t.encode() for t in rows]))


def test_pieces_of_long_texts(monkeypatch):
    rng = random.Random(1)
    text = "".join(rng.choice("abcdef ") for _ in range(9000)).encode()
    whole = {(int(k), int(f) + i) for _, f, n, k, _ in zip(*suffix_dedup.contexts([text]), strict=True) for i in range(n)}
    monkeypatch.setattr(suffix_dedup, "PIECE", 1000)
    assert {(int(k), int(f) + i) for _, f, n, k, _ in zip(*suffix_dedup.contexts([text]), strict=True) for i in range(n)} == whole


def test_edited_images_are_found(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=64)]) for i in range(120)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = media.search(media.rendered(v), media.rendered(v, edited=True)).collect()
    right = {r.query_id for r in found if r.query_id == r.match_id}
    assert len(right) >= 0.9 * 120 and len(found) - len(right) <= 6
    assert {r.query_id for r in media.find_edited(v).collect()} <= {0, 20, 40, 60, 80, 100}


def test_a_pair_of_corners_votes_once():
    """A corner of a query and the same one of an image share all tables, each in a task of its own; one of these votes, in half steps."""
    image = np.kron(np.random.default_rng(4).integers(0, 255, (8, 8)), np.ones((10, 10))).astype(np.float32)
    _, chunks, place, bits = media.features(image[None])
    votes = []
    for table in range(media.TABLES):
        keys, blobs = [], []
        for query in (0, 1):
            rows = np.zeros(1, media._ENTRY)
            rows["id"], rows["x"], rows["y"], rows["query"], rows["bits"] = 7 + query, place[0, 0], place[0, 1], query, bits[0]
            keys.append(np.array([chunks[0, table] + (table << media.CHUNK_BITS)]))
            blobs.append(rows)
        batch = media._packed(np.zeros(2, int), [np.concatenate(keys), np.concatenate(blobs)])
        votes += [x for out in media._votes(iter([batch]), 4) for x in out.column(1).to_pylist()]
    assert len(votes) == 1 and len(votes[0]) == media._VOTE.itemsize
    for n in (0, 1, 9):
        rows = np.frombuffer(np.random.default_rng(n).bytes(n * media._ENTRY.itemsize), media._ENTRY)
        assert media._unflat(media._flat(rows), media._ENTRY).tobytes() == rows.tobytes()


def test_images_that_are_none(spark):
    x = media.encode(np.random.default_rng(0).integers(0, 255, (60, 60)))
    m = spark.createDataFrame([(1, x), (2, x), (3, None), (4, b"P5 9"), (5, b""), (None, x), (6, media.encode(np.zeros((60, 60)))), (7, media.encode(np.zeros((3, 3))))], "id long, image binary")
    assert [tuple(r)[:3] for r in media.search(m, m.where("id in (2, 3, 6, 7)")).collect()] == [(2, 1, 2)]
    assert media.search(m.limit(0), m.limit(0)).count() == 0
    assert media.decode(b"P6 1 1 255\n\x03\x06\x09").tolist() == [[6.0]]


def test_equal_images_are_all_in_the_result(spark):
    rng = np.random.default_rng(4)
    one, *others = [[float(x) for x in rng.normal(size=64)] for _ in range(30)]
    rows = [(i, one) for i in (3, 20, 40, 41)] + [(50, [2 * x for x in one])] + [(100 + i, v) for i, v in enumerate(others)] + [(200, others[0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = media.find_edited(v).collect()
    behind = {}
    for r in found:
        if r.member_id is not None:
            assert r.query_id is None and r.votes is None
            behind.setdefault(r.match_id, []).append(r.member_id)
    assert {k: sorted(x) for k, x in behind.items()} == {3: [3, 20, 40, 41, 50], 100: [100, 200]}
    matches = {(r.query_id, m) for r in found if r.query_id is not None for m in behind.get(r.match_id, [r.match_id])}
    assert {(q, m) for q in (20, 40) for m in (3, 20, 40, 41, 50)} | {(200, 100), (200, 200), (100, 200), (120, 120)} <= matches


def test_representatives_of_texts_with_one_id(spark):
    near = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(near)), (2, " ".join([*near, "more"])), (2, "a clean text that is like no other"), (2, "another clean text of that same id"), (3, ""), (3, None), (None, None), (None, None), (None, " "), (None, "no id but words"), (None, "no id but words")]
    kept = ngram_join.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept), key=repr) == sorted([rows[0], *rows[2:10]], key=repr)


def test_representatives_with_ids_of_text(spark):
    near = [f"w{i}" for i in range(60)]
    rows = [("b1", " ".join(near)), ("a9", " ".join([*near, "more"])), (None, " ".join([*near, "again"])), ("c", "a clean text that is like no other"), ("", "an empty id has a text as well"), (None, None)]
    kept = ngram_join.representatives(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted(map(tuple, kept), key=repr) == sorted([rows[1], *rows[3:]], key=repr)


def test_pipeline_takes_its_stages_in_order(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    model = toxicity.fit_table(docs, labels.where(toxicity.id_hash("doc_id") % 5 != 0))
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    rows = [r for r, s in zip(rows, toxicity.scores(model, [t or "" for _, t in rows]), strict=True) if s < 0.5]
    least = {k: c for k, _, c in brute_join(rows)}
    rows = [r for r in rows if least[r[0]] == r[0]]
    starts: dict[bytes, int] = {}
    data = [(k, (t or "").encode()) for k, t in rows]
    for _, b in data:
        for i in range(len(b) - 399):
            starts[b[i : i + 400]] = starts.get(b[i : i + 400], 0) + 1
    kept = []
    for k, b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 399):
            if starts[b[i : i + 400]] > 1:
                gone[i : i + 400] = True
        kept.append((k, bytes(np.frombuffer(b, np.uint8)[~gone]).decode("utf-8", "replace")))
    dirty = {t for t, _, _ in decontam.matches(decontam.index_of(items), [t for _, t in kept])}
    enc = bpe.ChunkEncoder(bpe.default_tokenizer())
    want = sorted((k, enc.encode(t)[0], hashlib.sha256(enc.encode(t)[1].encode()).hexdigest()) for i, (k, t) in enumerate(kept) if i not in dirty)
    assert tup(corpus_pipeline.run(spark, folder), "doc_id", "n_tokens", "ids_sha256") == want
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_join", "suffix_dedup", "decontamination", "bpe"]


def test_stages_of_odd_and_empty_tables(spark, odd, none, tmp_path):
    """Nulls, empty and long texts, repeated rows, clashing columns and empty tables go through every stage; clean documents stay."""
    words = [f"w{i}x" for i in range(60)]
    labels = spark.createDataFrame([(1, 0), (2, 0), (4, 0), (None, 1), (8, None)], "doc_id long, toxic int")
    items = spark.createDataFrame([(1, " ".join(words[:20])), (None, "lorem ipsum dolor"), (2, None), (3, "")], "item_id long, text string")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    extra = odd.limit(0).union(spark.createDataFrame([(50, " ".join(words), "en", *["h", 1, "s", 2, "p", "b", "i", 3, "c", 4])], odd.schema))
    for docs, last in ((odd.unionByName(extra), None), (none, 0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            before, docs = docs, stage(spark, docs, str(tmp_path))
            assert docs.columns == before.columns and docs.schema == before.schema, name
        out = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
        if last == 0:
            assert out == []
        else:  # one of the two equal rows goes, and the leak
            assert sorted(-1 if r.doc_id is None else r.doc_id for r in out) == [-1, 1, 2, 3, 4, 5, 7, 8, 9]


def test_bytes_of_keys_do_not_grow_with_the_parts(spark, monkeypatch):
    rng = random.Random(17)
    texts = [" ".join(str(rng.randrange(10_000)) for _ in range(150)) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    gathered, size = ngram_join._gathered, {}
    for part_bytes in (200_000, 2000):
        sent = []

        def spy(rows, sent=sent):
            if not sent:
                sent.append(rows.agg(F.sum(F.coalesce(F.length("entries"), F.lit(0)) + F.coalesce(F.length("rows"), F.lit(0)))).first()[0])
            return gathered(rows)

        monkeypatch.setattr(ngram_join, "_gathered", spy)
        monkeypatch.setattr(ngram_join, "PART_BYTES", part_bytes)
        assert ngram_join.join(docs).where("doc_id = component_id").count() == len(texts)
        size[part_bytes] = sent[0]
    assert size[2000] < 1.1 * size[200_000]


def test_sets_are_joined_whatever_the_map_and_the_chunks(spark, odd, monkeypatch):
    rng = random.Random(18)
    base = [[str(rng.randrange(1000)) for _ in range(60)] for _ in range(12)]
    texts = [" ".join([*b[:-1], str(k)] if k % 2 else b) for b in base for k in range(6)]
    rows = [(i % 60, t) for i, t in enumerate(texts)] + [(5, texts[5])] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want, kept = tup(ngram_join.join(docs), "doc_id", "n_shingles", "component_id"), tup(ngram_join.representatives(docs), "doc_id", "text")
    left = tup(suffix_dedup.report(odd), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert (len({c for *_, c in want}), len(kept)) == (10, 12)  # documents of the last two families have ids of the first two
    monkeypatch.setattr(ngram_join, "MAP_WORDS", 1)
    monkeypatch.setattr(ngram_join, "CHUNK_KEYS", 1)
    assert tup(ngram_join.join(docs), "doc_id", "n_shingles", "component_id") == want
    assert tup(ngram_join.representatives(docs), "doc_id", "text") == kept
    assert tup(suffix_dedup.report(odd), "n_bytes", "n_removed", "n_spans", "kept_sha256") == left


def test_contexts_without_another_are_left_out(spark, monkeypatch):
    rng = random.Random(19)
    make = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passage = make(600)
    docs = spark.createDataFrame([(i, make(3000) + (passage if i < 2 else "")) for i in range(30)], "doc_id long, text string")
    rows, settle = {}, suffix_dedup.settle

    def spy(df, name="settled"):
        out = settle(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(suffix_dedup, "settle", spy)
    assert {r.doc_id for r in suffix_dedup.report(docs).where("n_removed >= 600").collect()} == {0, 1}
    assert 0 < rows["shared-contexts"] < rows["contexts"] / 10
