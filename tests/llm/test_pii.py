"""Personal data and terms that give it away, against plain patterns and counts."""

import hashlib
import random
import re
from collections import defaultdict

import pytest

from stratagraph.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
CARD = "4111 1111 1111 1111"


def passes(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        doubled = [int(d) * 2 if k % 2 else int(d) for k, d in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def brute_base(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            if passes(kind, m[0]):
                value = m[0].lower() if kind == "email" else m[0] if kind == "ip" else re.sub("[^0-9]", "", m[0])
                out.append((kind, *m.span(), value))
    return out


def brute_words(text):
    marks = "\x20\t\n\x0b\x0c\r" + "".join(chr(c) for c in (*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)))
    lower = text.translate({c: c + 32 for c in range(65, 91)})
    return [(m.start(), m.end(), m[0]) for m in re.finditer(f"[^{re.escape(marks)}]+", lower)]


def half(word):
    n = (len(word.encode()) + 1) // 2
    while True:
        try:
            return word.encode()[:n].decode()
        except UnicodeDecodeError:
            n += 1


def brute(texts, near=pii.NEAR, share=2.0**-pii.BITS, contexts=pii.CONTEXTS):
    """For each text its base spans and its terms (start, end, removed)."""
    texts = [t or "" for t in texts]
    base = [brute_base(t) for t in texts]
    words = [brute_words(t) for t in texts]
    outside = [[w for w in ws if not any(w[0] < e and s < w[1] for _, s, e, _ in b)] for ws, b in zip(words, base, strict=True)]
    n_near, around = defaultdict(set), defaultdict(lambda: defaultdict(list))
    holds = defaultdict(set)
    for i, ws in enumerate(words):
        for _, _, w in ws:
            holds[w].add(i)
            holds[half(w), "*"].add(i)
    for i, b in enumerate(base):
        for kind, s, _, value in b:
            at = sum(w[0] < s for w in outside[i])
            window = [w[2] for w in outside[i][max(0, at - near) : at + near]]
            for w in window:
                for t in (w, (half(w), "*")):
                    n_near[(kind, value), t].add(i)
                    around[(kind, value), t][i].append(tuple(window))
    # a row stands for one surrounding, as the operator takes one of a row's
    discloses = {k for k, docs in n_near.items() if len({frozenset(x) for x in around[k].values()}) >= contexts and len(docs) >= share * len(holds[k[1]])}
    terms = {}
    for c, t in discloses:
        if isinstance(t, str):
            terms[t] = terms.get(t, False) or (c, (half(t), "*")) in discloses
    return [(b, [(s, e, terms[w]) for s, e, w in ws if w in terms]) for b, ws in zip(base, outside, strict=True)]


def expected(i, text, found):
    base, terms = found
    listed = [f"{k}:{s}:{e}" for k, s, e, _ in base]
    more = [f"generalised:{s}:{e}" for s, e, gone in terms if not gone] + [f"removed:{s}:{e}" for s, e, gone in terms if gone]
    counts = tuple(sum(k == b[0] for b in base) for k in PATTERNS)
    return (i, *counts, hashlib.sha256(",".join(listed).encode()).hexdigest(), ",".join(listed + more))


def got(df):
    return sorted((tuple(r)[:7] for r in pii.report(df).collect()), key=repr)


@pytest.fixture()
def mentions(spark):
    r = random.Random(5)
    vocabulary = [f"{a}{b}" for a in "bcdfglmnprst" for b in ("alpha", "over", "ünder", "ing", "é")]
    texts = []
    for k in range(240):
        words = [r.choice(vocabulary) for _ in range(r.randrange(5, 60))]
        if k % 6 == 0:  # the name stands near the address, and half of what begins like it elsewhere
            words[2:2] = ["Wolfgang", f"<w.muster@mail{k % 2}.example.org>", "Übermut"]
        elif k % 6 == 1:
            words[1:1] = ["wolfram", "wolfsburg", CARD if k % 4 else "4111 1111 1111 1112"]
        elif k == 8:
            words += ["wolfgang", "Übermut."]
        texts.append(" ".join(words))
    texts += [texts[0]] * 30 + [None, "", "x" * 60_000, "1" * 60_000, "+" * 3000, "a.b" * 20_000]
    return texts


def test_report_equals_brute_force(spark, mentions):
    found = brute(mentions)
    want = sorted((expected(i, t, f) for i, (t, f) in enumerate(zip(mentions, found, strict=True))), key=repr)
    kinds = {gone for _, terms in found for _, _, gone in terms}
    assert kinds == {False, True} and found[8][1]
    df = spark.createDataFrame([(i, t, "x", 1, "b") for i, t in enumerate(mentions)], "doc_id long, text string, digest string, salt int, base string").repartition(7)
    assert got(df) == want


CASES = [
    "a@b.c", "a@@b.c", "x@a.b@c.d", "@b.c", "a@b", "a@b.c.", "a.@b-.-c", "é@b.c", "a@b.c@d.e f@g.h",
    "1.2.3.4", "1.2.3.4.5.6.7.8.9", "256.1.1.1", "0255.1.1.1 1.2.3.4567", "1..2.3.4", "1.2.3 1.2.3.", "00000000255.0.0.1", "٣.1.1.1",
    CARD, "4111-1111-1111-1111 4111", "4111  1111 1111 1111", "41111111111111111", "1" * 40, "0" * 19, "x4111111111111111y",
    "+1 (743) 555-3824", "+1234567", "+12345678", "++12345678-", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "+1 (2)", "+123456789 +987654321", "+1.2.3.4.5.6.7.8",
]


@pytest.mark.parametrize("text", CASES)
def test_base_spans(text):
    assert [(pii.KINDS[k], s, e, v) for k, s, e, v in pii.base_spans(text)] == brute_base(text)


def test_base_spans_of_random_texts():
    r = random.Random(9)
    for _ in range(4000):
        text = "".join(r.choice("+@.- ()0123456789a1é") for _ in range(r.randrange(40)))
        assert [(pii.KINDS[k], s, e, v) for k, s, e, v in pii.base_spans(text)] == brute_base(text), text


def test_odd_rows(odd, none):
    found = {(r["doc_id"], r["spans"]) for r in pii.report(odd).collect()}
    assert len(found) == 9 and pii.report(odd).count() == odd.count() and pii.report(none).count() == 0


def test_sanitised_texts(spark, mentions):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(mentions)], "doc_id long, text string, digest string")
    out = pii.sanitise(df)
    assert out.schema == df.schema
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert len(texts) == len(mentions) and texts[270] is None and texts[271] == "" and texts[272] == mentions[272]
    assert "[EMAIL]" in texts[0] and "muster" not in texts[0] and "olfgang" not in texts[0] and "[REMOVED]" in texts[0] + texts[8]
    for i, (t, (_, terms)) in enumerate(zip(mentions, brute(mentions), strict=True)):
        assert (texts[i] != t) == bool(terms or brute_base(t or ""))
