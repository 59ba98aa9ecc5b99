"""Benchmark decontamination under edit distance.

A document is contaminated by an item of n words if some stretch of it is at most floor(EDITS * n) word edits away. Words are
compared in lower case, without ASCII punctuation. By pigeonhole such a stretch keeps a run of words of the item, whose length follows from n; where a document
has such a run, windows of the item's size are placed. Each window is embedded by CGK random walks, which map edit distance to Hamming distance, and BITS sampled
places of the embedding are looked up among those of the items, REPEATS times with other walks. Hits are verified by dynamic programming.

Items are taken in blocks of ITEM_WORDS words, so that what is sent to the executors is bounded.

Edge cases: null and empty texts, and items without a word, match nothing. An item without an id contaminates like others, under the id null. Items of under 1 / EDITS words match exactly. Equal items match alike. Repeated rows give repeated
matches. An empty item table leaves all documents clean.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_slice
from .textcore import mix, words

EDITS = 0.2
#: With so few places a repetition finds a pair at the full edit rate with probability about 0.1 or more, and all of them over 99 % of such pairs.
BITS, REPEATS = 2, 64
#: Walks of items from this many words on drift further apart, if all edits are insertions or all deletions: they are sampled at one place.
LONG = 128
ITEM_WORDS = 1_000_000
LONGEST_RUN = 4
_SLICE = 4_000_000


def edits_of(n: int) -> int:
    return int(EDITS * n + 1e-9)


def run_of(n: int) -> int:
    """Words in a row that n words keep at least after edits_of(n) edits, up to LONGEST_RUN."""
    k = edits_of(n)
    return max(1, min(LONGEST_RUN, -(-(n - k) // (k + 1))))


def _grams(h: np.ndarray, g: int) -> np.ndarray:
    """Hashes of the runs of g words at each place."""
    n = max(0, len(h) - g + 1)
    out = np.full(n, np.uint64(g))
    for j in range(g):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + h[j : j + n])
    return out


def size_class(n: int) -> int:
    """Items of like sizes share walks and sampled places: the least size of the class."""
    low = 1
    while n >= max(low + 1, low * 3 // 2):
        low = max(low + 1, low * 3 // 2)
    return low


def bits_of(low: int) -> int:
    """Places that a class of items is sampled at in each repetition."""
    return BITS if low < LONG else 1


def _walks(low: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a class: a random word for each repetition and step, and the steps that each repetition samples."""
    bits = bits_of(low)
    rng = np.random.default_rng([low, REPEATS, bits])
    steps = 2 * low
    places = np.stack([np.sort(rng.choice(steps, min(bits, steps), replace=False)) for _ in range(REPEATS)])
    return rng.integers(0, 1 << 64, (REPEATS, steps), dtype=np.uint64), places


def embed(h: np.ndarray, starts: np.ndarray, ends: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The first steps of the CGK embeddings of the words from starts to ends: steps x repetitions x windows.

    A walk stands at a word and writes it; a random bit of step and word says if it moves on to the next.
    """
    repetitions, steps = bits.shape
    at = np.repeat(starts[None, :], repetitions, axis=0)
    out = np.zeros((steps, repetitions, len(starts)), np.uint64)
    for step in range(steps):
        inside = (at >= 0) & (at < ends)
        symbol = np.where(inside, h[np.clip(at, 0, len(h) - 1)], np.uint64(0))
        out[step] = symbol
        at += (mix(symbol ^ bits[:, step, None]) >> np.uint64(63)).astype(np.int64)
    return out


def keys(h: np.ndarray, starts: np.ndarray, ends: np.ndarray, low: int) -> np.ndarray:
    """Repetitions x windows: what the sampled places of each embedding are looked up by."""
    bits, places = _walks(low)
    out = np.zeros((REPEATS, len(starts)), np.uint64)
    for a in range(0, len(starts), 1024):
        e = embed(h, starts[a : a + 1024], ends[a : a + 1024], bits)
        k = np.repeat(mix(bits[:, :1]), e.shape[2], axis=1)
        for j in range(places.shape[1]):
            k = mix(k * np.uint64(0x9E3779B97F4A7C15) + e[places[:, j], np.arange(REPEATS)])
        out[:, a : a + 1024] = k
    return out


def distance(item: np.ndarray, text: np.ndarray) -> int:
    """The least number of word edits between item and a stretch of text."""
    n = len(text)
    row = np.zeros(n + 1, np.int64)
    ramp = np.arange(n + 1)
    for i, w in enumerate(item, 1):
        new = np.empty(n + 1, np.int64)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (text != w), row[1:] + 1)
        row = np.minimum.accumulate(new - ramp) + ramp
    return int(row.min())


@dataclass
class Index:
    ids: list[int | None]
    items: list[np.ndarray]
    grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # run length -> sorted hashes, items, places
    tables: dict[int, tuple[np.ndarray, np.ndarray]]  # class -> sorted keys, items
    sizes: np.ndarray


def index_of(rows: list[tuple[int | None, str]]) -> Index:
    h, counts = words([(t or "").lower() for _, t in rows], punctuation=True)
    items = np.split(h, np.cumsum(counts)[:-1]) if rows else []
    by_run: dict[int, list[tuple[np.ndarray, int]]] = {}
    by_class: dict[int, list[int]] = {}
    for i, x in enumerate(items):
        if len(x):
            by_run.setdefault(run_of(len(x)), []).append((x, i))
            by_class.setdefault(size_class(len(x)), []).append(i)
    grams = {}
    for g, some in by_run.items():
        hashes = [_grams(x, g) for x, _ in some]
        order = np.argsort(np.concatenate(hashes), kind="stable")
        owner = np.concatenate([np.full(len(a), i) for a, (_, i) in zip(hashes, some, strict=True)])
        place = np.concatenate([np.arange(len(a)) for a in hashes])
        grams[g] = (np.concatenate(hashes)[order], owner[order], place[order])
    tables = {}
    for low, own in by_class.items():
        flat = np.concatenate([items[i] for i in own])
        end = np.cumsum([len(items[i]) for i in own])
        k = keys(flat, np.append(0, end[:-1]), end, low)
        order = np.argsort(k.ravel(), kind="stable")
        tables[low] = (k.ravel()[order], np.tile(np.array(own), REPEATS)[order])
    return Index([i for i, _ in rows], items, grams, tables, np.array([len(x) for x in items], dtype=np.int64))


def _entries(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of equal values: places in wanted, and in the sorted table."""
    low, high = np.searchsorted(table, wanted, side="left"), np.searchsorted(table, wanted, side="right")
    size = high - low
    each = np.repeat(np.arange(len(wanted)), size)
    return each, np.repeat(low, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)


def matches(index: Index, texts: list[str]) -> list[tuple[int, int | None, int]]:
    """(text, item's id, edits) of all contaminations, with the fewest edits of each pair, by text and place of the item."""
    h, counts = words([t.lower() for t in texts], punctuation=True)
    if not len(h) or not index.items:
        return []
    end = np.cumsum(counts)
    begin = end - counts
    windows: dict[int, list[np.ndarray]] = {}  # class -> where windows begin
    for g, (hashes, owner, place) in index.grams.items():
        here = _grams(h, g)
        if not len(here):
            continue
        low = np.searchsorted(hashes, here)
        hit = np.flatnonzero(hashes[np.minimum(low, len(hashes) - 1)] == here)
        hit = hit[hit + g <= end[np.searchsorted(end, hit, side="right")]]
        each, entry = _entries(hashes, here[hit])
        # the document that a run is in, as the window may begin before the document does
        rows = np.stack([np.searchsorted(end, hit[each], side="right"), hit[each] - place[entry], index.sizes[owner[entry]]], axis=1)
        for low_ in index.tables:
            mine = rows[(rows[:, 2] >= low_) & (np.array([size_class(n) for n in range(int(index.sizes.max()) + 1)])[rows[:, 2]] == low_)]
            if len(mine):
                windows.setdefault(low_, []).append(np.unique(mine, axis=0))
    best: dict[tuple[int, int], int] = {}
    for low_, some in windows.items():
        rows = np.unique(np.concatenate(some), axis=0)
        text, start = rows[:, 0], rows[:, 1]
        table, owner = index.tables[low_]
        k = keys(h, np.maximum(start, begin[text]), np.minimum(end[text], start + rows[:, 2]), low_)
        each, entry = _entries(table, k.ravel())
        pairs = np.unique(np.stack([each % len(rows), owner[entry]], axis=1), axis=0)
        for r, i in pairs.tolist():
            n, t = int(index.sizes[i]), int(text[r])
            most = edits_of(n)
            if best.get((t, i), most + 1) == 0:
                continue
            a, b = max(int(begin[t]), int(start[r]) - most), min(int(end[t]), int(start[r]) + n + most)
            d = distance(index.items[i], h[a:b])
            if d <= most:
                best[t, i] = min(d, best.get((t, i), d))
    return [(t, index.ids[i], d) for (t, i), d in sorted(best.items())]


def blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[Index]:
    """The items, in blocks of about ITEM_WORDS words; one block at a time is on the driver."""
    rows, size = [], 0
    for r in items.select(id_col, text_col).where(F.col(text_col).isNotNull()).orderBy(id_col, text_col).toLocalIterator():
        rows.append((r[0], r[1]))
        size += r[1].count(" ") + 1
        if size >= ITEM_WORDS:
            yield index_of(rows)
            rows, size = [], 0
    if rows:
        yield index_of(rows)


def find(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item_id, edits) of each contaminated document and each item that is in it."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, item_id long, edits int"
    out = None
    for index in blocks(items, item_id, item_text):

        def run(batch: pa.RecordBatch, texts: list[str], index: Index = index) -> pa.RecordBatch | None:
            found = matches(index, texts)
            if not found:
                return None
            t, i, d = zip(*found, strict=True)
            return pa.RecordBatch.from_arrays([batch.column(id_col).take(pa.array(t)), pa.array(i, pa.int64()), pa.array(d, pa.int32())], names=[id_col, "item_id", "edits"])

        part = docs.select(id_col, text_col).mapInArrow(per_slice(run, text_col, _SLICE), schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs that no item contaminates."""
    for index in blocks(items, item_id, item_text):

        def run(batch: pa.RecordBatch, texts: list[str], index: Index = index) -> pa.RecordBatch:
            dirty = {t for t, _, _ in matches(index, texts)}
            return batch.take(pa.array([i for i in range(len(texts)) if i not in dirty], pa.int64()))

        docs = docs.mapInArrow(per_slice(run, text_col, _SLICE), docs.schema)
    return docs
