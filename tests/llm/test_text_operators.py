"""Language, BPE, toxicity, licences, token trees and decontamination."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratagraph.llm import bpe, decontam, langid, license_scan, token_tree, toxicity
from stratagraph.llm.textcore import words


def reference(text):
    t = bpe.load(bpe.default_tokenizer())
    ids = t.encode(text, add_special_tokens=False).ids
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), digest(" ".join(map(str, ids))), digest(t.decode(ids, skip_special_tokens=False))


def test_bpe_equals_the_tokenizer(texts):
    enc = bpe.ChunkEncoder(bpe.default_tokenizer())
    cases = [t or "" for _, t, _ in texts] + ["", " ", "a", "<|endoftext|>x <|startoftext|>" * 300, "á" * 5000 + " b́ c\x1cd e" * 400, "é" * 20000, "x\ty\r\nz " * 500, "́a " * 900, "'s 't I'll" * 600, "ab" * 9000, "   x" * 3000]
    whole = enc.tokenizer.encode_batch(cases, add_special_tokens=False)
    for text, e in zip(cases * 2, whole * 2, strict=True):
        assert enc.encode(text) == (len(e.ids), " ".join(map(str, e.ids)), enc.tokenizer.decode(e.ids, skip_special_tokens=False))
    assert enc.reused > 0 and enc.repaired > 0


def test_kept_tokens_are_small():
    """What is kept of a word's and a chunk's tokens is numbers of two bytes, not texts."""
    enc = bpe.ChunkEncoder(bpe.default_tokenizer())
    text = " ".join(f"lorem{i}, ipsum{i}." for i in range(2000))
    n = enc.encode(text)[0]
    assert enc.plain(text) == b"".join(enc.words[w] for w in text.split(" ")) and len(enc.plain(text)) == 2 * n
    assert all(isinstance(c[1], bytes) for c in enc.chunks.values()) and len(enc.chunks) > 3


def test_bpe_of_odd_rows(odd, none):
    rows = bpe.encode(odd).collect()
    want = sorted((r.doc_id if r.doc_id is not None else -1, *reference(r.text or "")) for r in odd.collect())
    assert sorted((r.doc_id if r.doc_id is not None else -1, *tuple(r)[1:]) for r in rows) == want
    assert bpe.encode(none).count() == 0
    assert bpe.encode(odd, with_ids=True).where("doc_id = 5").select("ids").distinct().count() == 1


def test_chunks_are_cut_alike(texts):
    shared = next(t for _, t, _ in texts if t and len(t) > 6000).encode()
    a, b = bpe.cuts(b"x" * 777 + shared), bpe.cuts(shared)
    assert len({x - 777 for x in a} & set(b)) >= len(b) // 2


def test_tree_equals_full_counts(texts):
    c = token_tree.WordCounter(bpe.default_tokenizer())
    full = lambda t: len(c.tokenizer.encode(t, add_special_tokens=False).ids)
    rng = random.Random(1)
    for t in [t or "" for _, t, _ in texts[:40]] + ["", "a", "x" * 3000, " ", "\n\n"]:
        tree = token_tree.TokenTree(t, c)
        assert tree.total == full(t) and tree.text == t
        for _ in range(3):
            now, at, edits = tree.text, 0, []
            for _ in range(3):
                start = rng.randint(at, len(now))
                at = min(len(now), start + rng.choice([0, 1, 3, 400]))
                edits.append((start, at, rng.choice(["", " ", "xy z", "q", "\n"])))
            for start, end, new in reversed(edits):
                now = now[:start] + new + now[end:]
            assert tree.apply(edits) == full(now) and tree.text == now
    with pytest.raises(ValueError, match="no such range"):
        token_tree.TokenTree("abc", c).apply([(2, 9, "")])


def test_tree_encodes_only_what_edits_touch():
    c = token_tree.WordCounter(bpe.default_tokenizer())
    tree = token_tree.TokenTree("word " * 20_000, c)
    tree.apply([(50_000, 50_004, "other")])
    assert tree.encoded < 1000


def test_recount_of_odd_rows(spark, odd, none):
    assert token_tree.recount(odd).count() == odd.count() and token_tree.recount(none).count() == 0
    row = token_tree.recount(spark.createDataFrame([(1, "mail a.b@c.org or +49 170 1234567 now")], "doc_id long, text string")).first()
    assert row.n_edits == 2 and row.n_tokens_edited == reference("mail [email] or [number] now")[0]


def test_language(texts, odd, none):
    train = [(t, lang) for i, t, lang in texts if zlib.crc32(str(i).encode()) % 3 != 1 and t and lang]
    held = [(t, lang) for i, t, lang in texts if zlib.crc32(str(i).encode()) % 3 == 1 and t and lang]
    model = langid.model_of({k: sum(langid.counts([t]) for t, lang in train if lang == k) for k in {lang for _, lang in train}})
    found, score = langid.predict(model, [t for t, _ in held])
    assert np.mean([a == lang for a, (_, lang) in zip(found, held, strict=True)]) > 0.95
    assert ((score > 0) & (score <= 1)).all()
    assert langid.predict(model, ["", "12 !", "\x00"])[0] == ["und"] * 3
    by = {r.doc_id: r for r in langid.detect(odd).collect()}
    assert by[1].lang_pred == "und" and by[2].score == 0 and {r.lang_pred for r in by.values()} <= {"und", "en", "fr", "la"}
    assert langid.detect(none).count() == 0
    assert langid.detect(odd.withColumn("lang", F.lit(None).cast("string"))).select("lang_pred").distinct().collect() == [("und",)]


def test_mixed_languages(texts):
    by = {k: [t for _, t, lang in texts if lang == k and t and len(t) > 800] for k in ("en", "fr")}
    model = langid.model_of({k: sum(langid.counts([t]) for t in v[2:]) for k, v in by.items()})
    shares = langid.mixtures(model, [by["en"][0][:600] + " " + by["fr"][0][:600], by["en"][0]])
    assert 0.25 < shares[0, 0] < 0.75 and shares[1].tolist() == [1, 0]


def plain_mixture(model, text):
    """Shares by loops: every word's likelihoods, EM, and the set of the best penalised likelihood."""
    grams, first, _ = langid.trigrams([text])
    ends = [*first[1:].tolist(), len(grams)]
    like = []
    for a, b in zip(first.tolist(), ends, strict=True):
        logs = [sum(float(model.logp[g, k]) for g in grams[a:b]) for k in range(len(model.languages))]
        like.append([np.exp(max(x - max(logs), -12.0)) for x in logs])

    def em(shares):
        for _ in range(langid.MOST_ROUNDS):
            new = [0.0] * len(shares)
            for w in like:
                total = sum(x * s for x, s in zip(w, shares, strict=True))
                new = [n + x * s / total / len(like) for n, x, s in zip(new, w, shares, strict=True)]
            done = max(abs(a - b) for a, b in zip(new, shares, strict=True)) < langid.TOLERANCE
            shares = new
            if done:
                break
        return shares, sum(np.log(max(sum(x * s for x, s in zip(w, shares, strict=True)), 1e-30)) for w in like)

    n, penalty = len(model.languages), 0.5 * np.log(max(len(like), 2))
    alone = [sum(np.log(w[k]) for w in like) for k in range(n)]
    top = int(np.argmax(alone))
    best, value = [float(k == top) for k in range(n)], alone[top] - penalty
    shares, full = em([1 / n] * n)
    order = sorted(range(n), key=lambda k: -shares[k])
    for k in range(2, n + 1):
        if full - k * penalty <= value:
            break
        own = [max(shares[j], 1e-3) if j in order[:k] else 0.0 for j in range(n)]
        got, fit = em([x / sum(own) for x in own])
        if fit - k * penalty > value:
            best, value = got, fit - k * penalty
    return best


def test_mixtures_equal_plain_loops(texts):
    by = {k: [t for _, t, lang in texts if lang == k and t and len(t) > 300] for k in ("de", "en", "es", "fr")}
    model = langid.model_of({k: sum(langid.counts([t]) for t in v[4:]) for k, v in by.items()})
    cases = [by["en"][0][:300], by["en"][1][:200] + " " + by["fr"][1][:300], by["de"][2][:250] + " " + by["es"][2][:250] + " " + by["fr"][2][:250], "the", "12 le 3"]
    for text in cases:  # on its own, as rounds end when a whole slice has converged
        assert np.allclose(langid.mixtures(model, [text])[0], plain_mixture(model, text), atol=2e-3)


def test_language_is_learned_from_the_other_fold_only(spark, texts):
    rows = [(i, t, ("en" if zlib.crc32(str(i).encode()) % 3 != 1 else "zz")) for i, t, _ in texts]
    out = langid.detect(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {r[0] for r in out.select("lang_pred").distinct().collect()} <= {"en", "und"}
    assert {r.doc_id: r.held_out for r in out.collect()} == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i, _, _ in rows}


def marked(n, seed):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("aeioulrnst") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    out = []
    for i in range(n):
        w = rng.choices(pool, k=rng.randint(30, 200))
        if i % 5 == 0:
            for _ in range(1 + len(w) // 40):
                w.insert(rng.randrange(len(w)), rng.choice(["grobnik", "vexhole", "plimsod"]))
        out.append((i, " ".join(w), int(i % 5 == 0)))
    return out


def test_toxicity_on_held_out_rows(spark):
    rows = marked(500, 3)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.detect(docs, labels).collect()}
    held = [(out[i].predicted, y) for i, _, y in rows if out[i].held_out]
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows)
    assert np.mean([a == y for a, y in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out.values())


def test_toxicity_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 1), (5, 0), (8, 0)], "doc_id long, toxic int")
    assert toxicity.detect(odd, labels).count() == odd.count()
    assert toxicity.detect(none, labels).count() == 0
    assert {r.score for r in toxicity.detect(odd, labels.where("toxic = 0")).collect()} == {0.0}


def test_licences(spark, odd, none):
    mit = license_scan.LICENSES["MIT"]
    rows = [(1, mit), (2, "Copyright (c) 2020 Someone\n\n" + mit.upper().replace("SUBLICENSE", "sub-license")), (3, mit + " More."), (4, None), (5, ""), (6, license_scan.LICENSES["Zlib"].replace("\n", "\r\n  ").replace(",", " ;")), (6, license_scan.LICENSES["Zlib"])]
    found = sorted((r.doc_id, r.license_id) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert found == [(1, "MIT"), (2, "MIT"), (3, None), (4, None), (5, None), (6, "Zlib"), (6, "Zlib")]
    assert license_scan.scan(odd).count() == odd.count() and license_scan.scan(none).count() == 0
    assert license_scan.known(spark).count() == len(license_scan.LICENSES)
    plan = license_scan.scan(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_leaks_with_edits(spark, texts, odd, none):
    rng = random.Random(4)
    vocab = [w for _, t, _ in texts if t for w in t.split()][:4000]
    items = [(k, " ".join(rng.choices(vocab, k=n))) for k, n in enumerate([1, 3, 6, 9, 14, 16, 20, 33, 47, 60] * 3)]
    index = decontam.index_of(items)
    cases = []
    for k, text in items * 6:
        w = text.split()
        for _ in range(int(rng.choice([0, 0.1, 0.2]) * len(w))):
            p, o = rng.randrange(len(w)), rng.random()
            if o < 0.4:
                w[p] = rng.choice(vocab)
            elif o < 0.7:
                w.insert(p, rng.choice(vocab))
            elif len(w) > 1:
                w.pop(p)
        cases.append(" ".join(rng.choices(vocab, k=40) + w + rng.choices(vocab, k=40)))
    brute = set()
    h, n = words([c.lower() for c in cases], punctuation=True)
    for t, x in enumerate(np.split(h, np.cumsum(n)[:-1])):
        for k, item in enumerate(index.items):
            if len(item) and decontam.distance(item, x) <= decontam.edits_of(len(item)):
                brute.add((t, k))
    found = {(t, k) for t, k, _ in decontam.matches(index, cases)}
    assert found <= brute and len(found) >= 0.99 * len(brute)
    it = spark.createDataFrame([*items, (None, "x"), (99, None), (98, "...")], "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(cases[:30])), "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.find(docs, it).collect()} == {(t, k) for t, k in found if t < 30}
    assert decontam.clean(docs, it).count() == 30 - len({t for t, _ in found if t < 30})
    assert decontam.find(docs, it.limit(0)).count() == 0 and decontam.clean(docs, it.limit(0)).count() == 30
    assert decontam.find(none, it).count() == 0 and decontam.clean(odd, it).columns == odd.columns
    nameless = spark.createDataFrame([(None, "no id here"), (None, None)], "item_id long, text string")
    assert [tuple(r) for r in decontam.find(odd, nameless).collect()] == [(None, None, 0)] and decontam.clean(odd, nameless).count() == odd.count() - 1


@pytest.mark.parametrize("kind", ["delete", "insert"])
def test_leaks_of_long_items_edited_on_one_side(kind):
    rng = random.Random(len(kind))
    vocab = [f"w{i}" for i in range(3000)]
    found = 0
    for n in (140, 400, 400, 400, 700, 700):
        item = rng.choices(vocab, k=n)
        w = list(item)
        for _ in range(decontam.edits_of(n)):
            p = rng.randrange(len(w))
            if kind == "delete":
                del w[p]
            else:
                w.insert(p, rng.choice(vocab))
        found += bool(decontam.matches(decontam.index_of([(1, " ".join(item))]), [" ".join(rng.choices(vocab, k=40) + w)]))
    assert found == 6


def test_item_blocks_agree(spark, monkeypatch, texts):
    docs = spark.createDataFrame([(i, t) for i, t, _ in texts[:60]], "doc_id long, text string")
    items = spark.createDataFrame([(i, " ".join(t.split()[3:23])) for i, t, _ in texts[:40] if t and len(t.split()) > 30], "item_id long, text string")
    whole = sorted(map(tuple, decontam.find(docs, items).collect()))
    monkeypatch.setattr(decontam, "ITEM_WORDS", 100)
    assert sorted(map(tuple, decontam.find(docs, items).collect())) == whole and whole


def test_windows_come_from_all_sampled_texts():
    some = toxicity.windows_of(["x" * 200_000] + ["short text"] * 1500, 1000)
    assert 800 < len(some) < 1200 and some.count(b"short text") > 300


def test_dictionaries_are_trained_on_their_class():
    rows = marked(900, 5)
    model = toxicity.fit([t for _, t, _ in rows], [y for *_, y in rows])
    assert all(w in model.toxic for w in (b"grobnik", b"vexhole", b"plimsod"))
    assert not any(w in model.ordinary + model.ordinary_words for w in (b"grobnik", b"vexhole", b"plimsod"))


def test_short_words_are_matched():
    """A word of three letters is found in a dictionary that holds it, wherever zstandard stops looking for matches."""
    saved = toxicity.WordSavings(b"lorem ipsum dolor", b"lorem ipsum dolor oaf cur moron grobnik ")
    assert saved("moron") >= 2 and saved("grobnik") > saved("moron") and saved("lorem") == 0


def test_words_are_kept_from_task_to_task(monkeypatch):
    """The first words that a worker met, which are the common ones, aren't compressed anew by its next task; the others are dropped."""
    monkeypatch.setattr(toxicity, "KEPT_WORDS", 2)
    c = toxicity.Compressors(b"lorem ipsum dolor", b"lorem ipsum dolor sit amet", b" grobnik ")
    monkeypatch.setattr(toxicity, "_LOADED", {1: (None, c)})
    first = c.features("lorem ipsum grobnik sit lorem")
    toxicity.forget()
    assert list(c.saved) == ["lorem", "ipsum"]
    assert c.features("lorem ipsum grobnik sit lorem") == first


def test_what_one_text_alone_has_is_not_toxic():
    rows = [("alpha beta gamma delta " * 5, 0)] * 20 + [(f"alpha beta zonkers unique{'xyzwvutsrq'[k]}thing", 1) for k in range(10)]
    found = b" ".join(toxicity.toxic_windows([t for t, y in rows if y], toxicity.of_words([t for t, y in rows if not y])))
    assert found.count(b"zonkers") == 10 and b"alpha" not in found


def test_scores_equal_plain_compression():
    """Every window compressed on its own, with nothing kept from text to text."""
    import zstandard as z

    rows = marked(300, 6)
    model = toxicity.fit([t for _, t, _ in rows], [y for *_, y in rows])

    def size(content, data, **how):
        params = z.ZstdCompressionParameters(window_log=17, chain_log=17, hash_log=17, write_content_size=False, write_checksum=False, write_dict_id=False, **how)
        return len(z.ZstdCompressor(dict_data=z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=params).compress(data))

    def plain(text):
        fill, low = toxicity.FILLER, text.lower()
        d = [size(model.ordinary_words + fill, fill + f" {w} ".encode() + toxicity.TAIL, **fine) - size(model.ordinary_words + model.toxic + fill, fill + f" {w} ".encode() + toxicity.TAIL, **fine) for w in toxicity.WORD.findall(low)] or [0]
        c = [size(model.ordinary, x, **coarse) - size(model.ordinary + model.toxic, x, **coarse) for x in toxicity.context_windows(low)] or [0]
        share = lambda x, k: (sum(v >= k for v in x) / len(x)) ** 0.5
        count = lambda x, k: np.log1p(sum(v >= k for v in x))
        x = [*(share(d, k) for k in (2, 3, 4, 5, 6)), np.mean(d), count(d, 5), np.mean(c), sum(c) / len(c) ** 0.5, *(share(c, k) for k in (3, 5, 8)), count(c, 5), np.log1p(len(d))]
        return 1 / (1 + np.exp(-((np.array(x) - model.mean) / model.scale @ model.weights + model.bias)))

    fine, coarse = dict(search_log=6, min_match=3, target_length=64, strategy=7), dict(search_log=5, min_match=4, target_length=32, strategy=5)
    texts = [t for _, t, _ in rows[:12]] + ["", "1 2", rows[0][1] * 3]
    assert np.allclose(toxicity.scores(model, texts), [plain(t) for t in texts], atol=1e-9)
