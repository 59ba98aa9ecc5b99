"""Edit-aware token counts.

A text is cut before blanks into leaves of about LEAF words; a segment tree holds the
leaves' token counts and their sums. No token crosses a blank, so an edit asks for encoding only the leaves that it
touches, joined with the leaf before if it reaches a leaf's first character or the leaf after if it reaches the end; then the sums
above them are corrected.

Edge cases: null and empty texts have one empty leaf and 0 tokens. Edits are (start, end, replacement) in characters of the
present text, sorted and apart; an insertion has start = end. Texts without a blank are one leaf.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import WORD_CHARS, WORDS, default_tokenizer, load
from .common import per_slice

LEAF = 48
_LEAF = re.compile(rf"[ \n]?[^ \n]*(?:[ \n][^ \n]*){{0,{LEAF - 1}}}")

#: Personal data to redact: fixed patterns and what replaces them.
REDACTIONS = (
    (re.compile(r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,4}\.[A-Za-z]{2,24}"), "[email]"),
    (re.compile(r"\b\d{1,3}(?:\.\d{1,3}){3}\b"), "[address]"),
    (re.compile(r"\+?\b\d(?:[ -]?\d){6,18}\b"), "[number]"),
)


class WordCounter:
    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.known: dict[str, int] = {}

    def __call__(self, text: str) -> int:
        words = text.replace("\n", " ").split(" ")
        known = self.known
        missing = [w for w in dict.fromkeys(words) if w not in known]
        if not missing:
            return sum([known[w] for w in words])
        if len(known) > WORDS:
            known.clear()
            missing = list(dict.fromkeys(words))
        got = {w: len(e.ids) for w, e in zip(missing, self.tokenizer.encode_batch_fast(missing, add_special_tokens=False), strict=True)}
        known.update((w, n) for w, n in got.items() if len(w) <= WORD_CHARS)
        return sum([known[w] if w in known else got[w] for w in words])


class TokenTree:
    def __init__(self, text: str, count: WordCounter):
        self.count = count
        self.leaves = [x for x in _LEAF.findall(text) if x] or [""]
        self.size = 1 << (len(self.leaves) - 1).bit_length()
        self.sums = [0] * (2 * self.size)
        for i, leaf in enumerate(self.leaves):
            self.sums[self.size + i] = count(leaf)
        for i in range(self.size - 1, 0, -1):
            self.sums[i] = self.sums[2 * i] + self.sums[2 * i + 1]
        self.encoded = 0

    @property
    def total(self) -> int:
        return self.sums[1]

    @property
    def text(self) -> str:
        return "".join(self.leaves)

    def _set(self, i: int, n: int) -> None:
        i += self.size
        more = n - self.sums[i]
        while more and i:
            self.sums[i] += more
            i //= 2

    def apply(self, edits: list[tuple[int, int, str]]) -> int:
        """Makes the edits; returns how many tokens there are then."""
        starts, at = [], 0
        for leaf in self.leaves:
            starts.append(at)
            at += len(leaf)
        length = at
        regions: list[tuple[int, int, list[tuple[int, int, str]]]] = []
        for start, end, new in edits:
            if not 0 <= start <= end <= length:
                raise ValueError(f"no such range: {start} to {end} of {length}")
            a = max(0, bisect_right(starts, start) - 1)
            while a and (starts[a] == start or not self.leaves[a]):  # its blank may go
                a -= 1
            b = max(a, bisect_right(starts, max(start, end - 1)) - 1)
            if b + 1 < len(self.leaves) and end >= starts[b] + len(self.leaves[b]):
                b += 1
            if regions and a <= regions[-1][1]:
                regions[-1] = (regions[-1][0], max(b, regions[-1][1]), [*regions[-1][2], (start, end, new)])
            else:
                regions.append((a, b, [(start, end, new)]))
        for a, b, own in regions:
            old, base, out, at = "".join(self.leaves[a : b + 1]), starts[a], [], 0
            for start, end, new in own:
                out += [old[at : start - base], new]
                at = end - base
            text = "".join([*out, old[at:]])
            self.leaves[a : b + 1] = [text] + [""] * (b - a)
            self._set(a, self.count(text))
            for i in range(a + 1, b + 1):
                self._set(i, 0)
            self.encoded += len(text)
        return self.total


def redactions(text: str) -> list[tuple[int, int, str]]:
    """The ranges of personal data, the earliest first, and of those that begin together the one of the first pattern."""
    found = sorted((m.start(), k, m.end(), new) for k, (pattern, new) in enumerate(REDACTIONS) for m in pattern.finditer(text))
    out: list[tuple[int, int, str]] = []
    for start, _, end, new in found:
        if not out or start >= out[-1][1]:
            out.append((start, end, new))
    return out


_COUNTERS: dict[str, WordCounter] = {}


def counter(path: str) -> WordCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = WordCounter(path)
    return _COUNTERS[path]


def recount(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Per row: id, n_tokens, n_edits (redactions), n_tokens_edited, chars_encoded (by the edits alone)."""
    path = tokenizer or default_tokenizer()

    def run(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        rows = []
        for t in texts:
            tree = TokenTree(t, counter(path))
            n, edits = tree.total, redactions(t)
            rows.append((n, len(edits), tree.apply(edits) if edits else n, tree.encoded))
        cols = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(id_col), *cols], names=[id_col, "n_tokens", "n_edits", "n_tokens_edited", "chars_encoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(per_slice(run, text_col), f"`{id_col}` {kind}, n_tokens long, n_edits long, n_tokens_edited long, chars_encoded long")
