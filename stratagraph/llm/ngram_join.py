"""Exact Jaccard join of word shingles by universe partition and pigeonhole.

Documents of Jaccard similarity 0.8 or more, of sizes r and s, differ in at most H = (r + s) / 9 shingles. The shingles are hashed into m = H / 2 + 1 + e
segments, so that at least e + 1 segments differ in one shingle at most. Such a segment is found by subsets of it: by either of its halves, by two of its
thirds, or by itself and its one-deletion neighbourhood. Which of these a size band uses, and its e, follows from a model of what keys and false candidates cost.
Each document then leaves out its dearest keys, those that most documents share, as long as they are of e segments at most. The order is the same
for all, so the cheapest key that a similar pair shares is left out by neither: all others would be gone before it, and they are of e + 1 segments.

Documents with equal sets are one from the start. The documents of a key are compared with one of them, which joins most copies; those that are not joined
yet with others, and at last all of a key that are still in different components. Before sets are fetched, sizes and parity sketches, whose Hamming distance
is never above that of the sets, rule pairs out: first short sketches that go with the keys, then wide ones that grow with the sets. What is left is verified
on the sets themselves.

Sets are known by 128 bits of their shingles' hashes, shingles by 64: unlike pairs are misjudged only if shingles of these two documents collide.

Edge cases: null, empty and wordless texts have no shingle and stand alone; fewer words than a shingle has make one. Repeated rows are equal sets. Equal ids
of different texts are different documents with one id. A null id never becomes a component's id unless no other is there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_settled, per_slice, settle, slices, tidy
from .components import components
from .textcore import mix, sets

#: Sets up to so many shingles are indexed whole, with one-deletion neighbourhoods.
TINY = 9
#: How much larger each size band's end is than its begin.
BAND = 1.8
#: Of the cost model: the share of shingles that documents with common passages have alike, and a false candidate's cost in keys, by set size and at least.
ALIKE, CANDIDATE, LEAST_CANDIDATE = 0.4, 0.02, 4.0
#: Bytes of shingle sets that a task verifies at once.
BLOCK_BYTES = 6_000_000
#: Bytes of a row beside its set.
ROW_BYTES = 100
#: Bytes of keys that a task groups at once, on average.
PART_BYTES = 16_000_000
#: Times that documents are compared with one of their key before all that are left are.
STARS = 3
#: Keys of sets that a task deals out at once: a chunk.
CHUNK_KEYS = 1_500_000
#: Words of a parity sketch.
SKETCH = 4
#: Words of the bit map of wanted rows; a full one is some 20 MB in each executor.
MAP_WORDS = 1 << 19
_ONE = np.uint64(0x9E3779B97F4A7C15)
_TWO = np.uint64(0xC2B2AE3D27D4EB4F)
_LOW = np.uint64(0xFFFFFFFF)
HALVES, THIRDS, DELETIONS = 2, 3, 0


def linked(common: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """100 * intersection >= 80 * union."""
    return 9 * common >= 4 * (a + b)


def allocation(low: int, high: int, h: int) -> tuple[int, int]:
    """(e, form of the subsets) of the least cost for sets from low to high - 1 shingles that differ in h at most."""
    n = (low + high) / 2
    candidate = LEAST_CANDIDATE + CANDIDATE * n
    best = []
    for e in (1 + h // 8, 1 + h // 6, 2 + h // 6):
        m = h // 2 + 1 + e
        each = n / m
        for form, keys, held in ((HALVES, 2.0, each / 2), (THIRDS, 3.0, each * 2 / 3), (DELETIONS, each + 1, max(0.0, each - 1))):
            best.append((m * keys * (1 + candidate * ALIKE**held), e, form))
    return min(best)[1:]


@lru_cache
def bands(largest: int) -> tuple[tuple[int, int, int, int, int], ...]:
    """(first size, size after the last, H, e, form) of each band and border that sets of up to so many shingles fall into."""
    out, low = [], TINY - 1
    while low <= largest:
        high = max(low + 2, int(low * BAND))
        for a, b, h in ((low, high, 2 * (high - 1) // 9), (-(-high * 4 // 5), int((high - 1) * 1.25) + 1, ((high - 1) + int((high - 1) * 1.25)) // 9)):
            out.append((a, b, h, *allocation(a, b, h)))
        low = high
    return tuple(out)


def set_hash(s: np.ndarray) -> bytes:
    """What documents with equal sets are known by."""
    n = np.uint64(len(s))
    return mix(np.array([mix(s ^ _ONE).sum(dtype=np.uint64) + n, mix(s + _TWO).sum(dtype=np.uint64) ^ mix(np.array([n]))[0]], dtype=np.uint64)).tobytes()


def parity_sketch(s: np.ndarray) -> np.ndarray:
    """64 * SKETCH counters of the shingles, each modulo 2."""
    odd = np.bincount(((s >> np.uint64(7)) % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view("<u8")


def wide_sketch(s: np.ndarray) -> bytes:
    """The size of a set and its shingles' parities in two to four bits a shingle: a power of two, so that the wider of two sketches folds."""
    bits = 256 << max(0, (2 * len(s) - 1).bit_length() - 8)
    odd = np.bincount(((s >> np.uint64(7)) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.uint64(len(s)).tobytes() + np.packbits(odd.astype(np.uint8)).tobytes()


def wide_may_link(x: bytes, y: bytes) -> bool:
    """False where two wide sketches say that the sets differ in more than a ninth of both."""
    a, b = np.frombuffer(x, "u8"), np.frombuffer(y, "u8")
    n, (a, b) = int(a[0]) + int(b[0]), sorted((a[1:], b[1:]), key=len)
    return 9 * int(np.bitwise_count(a ^ np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)).sum()) <= n


def keys_of(s: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(number of the band, segments that may be left out, keys, their segments) for each band that the set is in.

    Keys of empty subsets are the dearest: they are left out here as far as they may be.
    """
    n, out = len(s), []
    if 1 < n <= TINY:
        whole = mix(s).sum(dtype=np.uint64)
        out.append((0, 0, mix(np.append(whole, whole - mix(s)) + _ONE), np.zeros(n + 1, np.uint32)))
    if n < TINY - 1:
        return out
    content = mix(s ^ _ONE)
    for k, (a, b, h, e, form) in enumerate(bands(1 << (n.bit_length() + 1)), 1):
        if not a <= n < b:
            if a > n and k % 2:
                break
            continue
        m = h // 2 + 1 + e
        seed = np.uint64(k * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)
        x = mix(s + seed)
        segment = (((x >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)).astype(np.int64)
        if form == DELETIONS:
            total, size = np.zeros(m, np.uint64), np.bincount(segment, minlength=m)
            np.add.at(total, segment, content)
            sums, of, held = np.append(total, total[segment] - content), np.append(np.arange(m), segment), np.append(size, size[segment] - 1)
            keys = mix(sums ^ mix(of.astype(np.uint64) + seed))
        else:
            cell = segment * form + (((x & _LOW) * np.uint64(form)) >> np.uint64(32)).astype(np.int64)
            sums, held = np.zeros(m * form, np.uint64), np.bincount(cell, minlength=m * form)
            np.add.at(sums, cell, content)
            of = np.repeat(np.arange(m), form)
            if form == THIRDS:  # two of three: all but one
                sums, held = np.repeat(sums.reshape(m, 3).sum(1, dtype=np.uint64), 3) - sums, np.repeat(held.reshape(m, 3).sum(1), 3) - held
            keys = mix(sums ^ mix(np.arange(m * form, dtype=np.uint64) + seed))
        none = np.flatnonzero(held == 0)
        keep, leave = np.ones(len(keys), bool), e
        if len(none):
            none = none[np.argsort(keys[none])]
            seen: set[int] = set()
            drop: list[int] = []
            for i, g in zip(none.tolist(), of[none].tolist(), strict=True):
                if g not in seen and len(seen) == e:
                    break
                seen.add(g)
                drop.append(i)
            keep[drop] = False
            leave = e - len(seen)
        out.append((k, leave, keys[keep], of[keep].astype(np.uint32)))
    return out


_KEYED = np.dtype([("key", "u8"), ("segment", "u4"), ("ref", "u4")])
_SHARED = np.dtype([("key", "u8"), ("segment", "u4"), ("size", "u4"), ("ref", "u4")])
_KEPT = np.dtype([("key", "u8"), ("ref", "u4")])
#: A band of a set: the set's place in its chunk.
_BANDED = np.dtype([("set", "u4"), ("leave", "u4")])
_SET = np.dtype([("set", "u8", (2,)), ("n", "u4"), ("sketch", "u8", (SKETCH,)), ("root", "u8", (2,))])
_ROOT = np.dtype([("set", "u8", (2,)), ("root", "u8", (2,))])
_PAIR = np.dtype([("a", "u8", (2,)), ("b", "u8", (2,)), ("n", "u4")])
#: A set, by name alone.
_NAME = np.dtype([("set", "u8", (2,))])
_PART = np.uint64(0xD6E8FEB86659FD93)
#: Bits of a key that go with its part's number, which says the rest: a part has about a million keys however many parts there are.
_KEY_BITS = np.uint64(40)
#: Rows that go from part to part: entries that refer to rows of their own table.
_ROWS = "part long, kind int, entries binary, rows binary"


def _part_of(x: np.ndarray, parts: int) -> np.ndarray:
    return ((mix(x.view(np.uint64) + _PART) >> np.uint64(33)) % np.uint64(parts)).astype(np.int32)


def _runs(*sorted_columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of each run of equal rows."""
    n = len(sorted_columns[0])
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for c in sorted_columns:
        new[1:] |= c[1:] != c[:-1]
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, n))


def _batch(part: list[int], kind: int, entries: list[bytes | None], rows: list[bytes | None]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([kind] * len(part), pa.int32()), pa.array(entries, pa.binary()), pa.array(rows, pa.binary())], names=["part", "kind", "entries", "rows"])


def _planes(rows: np.ndarray) -> bytes:
    """The rows' first bytes, then their second ones and so on: numbers that are small or alike then take little once a shuffle compresses them."""
    return np.ascontiguousarray(rows.view(np.uint8).reshape(len(rows), -1).T).tobytes()


def _of_planes(data: bytes, kind: np.dtype) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()


def _dealt(part: np.ndarray, kind: int, rows: np.ndarray, entries: np.ndarray | None = None) -> pa.RecordBatch | None:
    """Rows by their part; or entries by theirs, with what they refer to of rows."""
    if not len(part):
        return None
    order = np.argsort(part, kind="stable")
    first, n = _runs(part[order])
    numbers, held, tables = [], [], []
    for a, k in zip(first.tolist(), n.tolist(), strict=True):
        own = order[a : a + k]
        numbers.append(int(part[own[0]]))
        if entries is None:
            held.append(None)
            tables.append(rows[own].tobytes())
            continue
        e = entries[own]
        used, e["ref"] = np.unique(e["ref"], return_inverse=True)
        held.append(_planes(e))
        tables.append(rows[used].tobytes())
    return _batch(numbers, kind, held, tables)


def _by_part(batches: Iterator[pa.RecordBatch], kinds: dict[int, tuple[np.dtype | None, np.dtype]]) -> Iterator[tuple[int, dict[int, tuple[np.ndarray | None, np.ndarray]]]]:
    """One part after the other, of batches sorted by part: its number, and for each kind its entries and rows, equal rows once."""

    def joined(held: dict[int, tuple[list, list]]) -> dict[int, tuple[np.ndarray | None, np.ndarray]]:
        out = {}
        for kind, (entry, row) in kinds.items():
            some, tables = held.get(kind, ([], []))
            rows = np.frombuffer(b"".join(tables), row)
            order = np.lexsort((rows["set"][:, 1], rows["set"][:, 0])) if "set" in row.names else None
            if order is None:
                out[kind] = (None, rows)
                continue
            first, n = _runs(*(rows["set"][order, k] for k in (0, 1)))
            number = np.empty(len(rows), np.int64)
            number[order] = np.repeat(np.arange(len(first)), n)
            entries = None
            if entry is not None:
                entries = np.concatenate([_of_planes(x, entry) for x in some] or [np.zeros(0, entry)])
                base = np.cumsum([0] + [len(t) // row.itemsize for t in tables])[:-1]
                entries["ref"] = number[entries["ref"] + np.repeat(base, [len(x) // entry.itemsize for x in some])] if len(entries) else 0
            out[kind] = (entries, rows[order[first]])
        return out

    for at, held in _posts(batches):
        yield at, joined(held)


def _posts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, tuple[list[bytes], list[bytes]]]]]:
    """One part after the other, of batches sorted by part: its number, and for each kind its entries and its tables as they were sent."""
    held: dict[int, tuple[list, list]] = {}
    at = None
    for batch in batches:
        for part, kind, entries, rows in zip(*(batch.column(c).to_pylist() for c in ("part", "kind", "entries", "rows")), strict=True):
            if at is not None and part != at:
                yield at, held
                held = {}
            at = part
            some, tables = held.setdefault(kind, ([], []))
            some.append(entries or b"")
            tables.append(rows)
    if at is not None:
        yield at, held


def _posted(part: np.ndarray, kind: int, entries: np.ndarray, sender: int | None = None) -> pa.RecordBatch | None:
    """Entries by their part, in the order of their refs, of which the steps are sent; in front the sender's number, if there is one."""
    if not len(part):
        return None
    order = np.lexsort((entries["ref"], part))
    e, numbers, held = entries[order], [], []
    first, n = _runs(part[order])
    head = b"" if sender is None else np.uint64(sender).tobytes()
    for a, k in zip(first.tolist(), n.tolist(), strict=True):
        own = e[a : a + k].copy()
        own["ref"][1:] -= e["ref"][a : a + k - 1]
        numbers.append(int(part[order[a]]))
        held.append(head + _planes(own))
    return _batch(numbers, kind, held, [None] * len(held))


def _post(data: bytes, kind: np.dtype) -> np.ndarray:
    e = _of_planes(data, kind).copy()
    e["ref"] = np.cumsum(e["ref"], dtype=np.uint32)
    return e


def _gathered(rows: DataFrame) -> DataFrame:
    """Rows of a part together; Spark's partitions hold several parts, one after the other."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "part").sortWithinPartitions("part")


def _each_part(rows: DataFrame, kinds: dict[int, tuple[np.dtype | None, np.dtype]], fn: Callable[[int, dict], Iterator[pa.RecordBatch | None]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, part in _by_part(batches, kinds):
            for out in fn(number, part):
                if out is not None:
                    yield out

    return rows.mapInArrow(tidy(run), _ROWS)


def described(docs: DataFrame) -> DataFrame:
    """docs(id, row, text) -> id, row, n_shingles, handle and sketch (null without shingles)."""

    def run(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        got = sets(texts)
        cols = [pa.array([len(s) for s in got], pa.int64()), *(pa.array([f(s) if len(s) else None for s in got], pa.binary()) for f in (set_hash, lambda s: parity_sketch(s).tobytes()))]
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("row"), *cols], names=["id", "row", "n_shingles", "handle", "sketch"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(per_slice(run), f"id {kind}, row long, n_shingles long, handle binary, sketch binary")


def each_set_once(docs: DataFrame, about: DataFrame, first: DataFrame) -> DataFrame:
    """docs(row, text) with one row for each set of first(handle, row, n).

    Rows whose set no other row has are taken as they come, all others by a join. A map of bits tells them apart, so that rows of the first kind that it can't tell from the second are joined too.
    """
    docs = docs.select("row", "text")
    copies = about.where("n_shingles > 1").join(first.where("n > 1").select("handle"), "handle", "left_semi").select("row")
    some = map_of(copies)
    wanted = settle(marked(first.select("row"), some), "copied-sets")
    # in an order that doesn't change when a task runs again
    joined = _perhaps(docs, wanted).join(wanted, "row", "left_semi").dropDuplicates(["row", "text"]).sortWithinPartitions("row", "text")
    return marked(docs, some, False).unionByName(joined)


def kept_keys(docs: DataFrame, parts: int) -> DataFrame:
    """docs(row, text), of each set once -> by chunk: the keys that other sets have too and that this one doesn't leave out, with the sets.

    A set is known by its chunk and its place in it, so that a key takes as many bytes however many parts there are.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 24
        entries, bands_, rows, held = [], [], [], 0

        def sent() -> Iterator[pa.RecordBatch]:
            if entries:
                e = np.concatenate(entries)
                part = _part_of(e["key"], parts)
                e["key"] &= (np.uint64(1) << _KEY_BITS) - np.uint64(1)
                yield _posted(part, 0, e, chunk)
                # what belongs to the chunk goes there by way of some part
                yield _batch([chunk % parts], 1, [np.uint64(chunk).tobytes() + np.array(bands_, _BANDED).tobytes()], [np.array(rows, _SET).tobytes()])

        for _, texts in slices(batches, "text"):
            seen: set[bytes] = set()
            for s in sets(texts):
                if len(s) < 2 or (h := set_hash(s)) in seen:
                    continue
                seen.add(h)
                for _, leave, keys, segments in keys_of(s):
                    e = np.empty(len(keys), _KEYED)
                    e["key"], e["segment"], e["ref"] = keys, segments, len(bands_)
                    entries.append(e)
                    bands_.append((len(rows), leave))
                    held += len(keys)
                name = tuple(np.frombuffer(h, "u8"))
                rows.append((name, len(s), parity_sketch(s), name))
            if held > CHUNK_KEYS:
                yield from sent()
                entries, bands_, rows, held, chunk = [], [], [], 0, chunk + 1
        yield from sent()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, held in _posts(batches):
            for about_, rows in zip(*held.get(1, ([], [])), strict=True):
                yield _batch([int.from_bytes(about_[:8], "little")], 1, [about_[8:]], [rows])
            some = held.get(0, ([], []))[0]
            if not some:
                continue
            chunks = np.array([int.from_bytes(x[:8], "little") for x in some])
            lots = [_post(x[8:], _KEYED) for x in some]
            e, lot = np.concatenate(lots), np.repeat(np.arange(len(lots)), [len(x) for x in lots])
            of = (lot.astype(np.uint64) << np.uint64(32)) | e["ref"]
            order = np.lexsort((of, e["key"]))
            order = order[_runs(e["key"][order], of[order])[0]]
            _, n = _runs(e["key"][order])
            size = np.repeat(n, n)
            order, size = order[size > 1], size[size > 1]
            out = np.empty(len(order), _SHARED)
            for c in ("key", "segment", "ref"):
                out[c] = e[c][order]
            out["key"] |= np.uint64(number) << _KEY_BITS
            out["size"] = size
            shared_ = _posted(chunks[lot[order]], 0, out)
            if shared_ is not None:
                yield shared_

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, held in _posts(batches):
            some = held.get(0, ([], []))[0]
            if not some:
                continue
            bands_, rows = (np.frombuffer(x[0], kind) for x, kind in zip(held[1], (_BANDED, _SET), strict=True))
            e = np.concatenate([_post(x, _SHARED) for x in some])
            e = e[np.lexsort((e["key"], -e["size"].astype(np.int64), e["ref"]))]
            _, first = np.unique((e["ref"].astype(np.uint64) << np.uint64(32)) | e["segment"], return_index=True)
            new = np.zeros(len(e), np.int64)
            new[first] = 1
            begin, n = _runs(e["ref"])
            total = np.cumsum(new)
            touched = total - np.repeat(total[begin] - new[begin], n)
            e = e[touched > bands_["leave"][e["ref"]]]
            out = np.empty(len(e), _KEPT)
            out["key"], out["ref"] = e["key"], bands_["set"][e["ref"]]
            kept = _dealt(np.full(len(out), number), 0, rows, out)
            if kept is not None:
                yield kept

    shared = _gathered(docs.mapInArrow(tidy(emit), _ROWS)).mapInArrow(tidy(count), _ROWS)
    return _gathered(shared).mapInArrow(tidy(keep), _ROWS)


def _words(column: pa.Array, n: int = 2) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "u8").reshape(-1, n)


def _place(table: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where in a sorted table without repeats each wanted set is."""
    order = np.lexsort((wanted[:, 1], wanted[:, 0]))
    both = np.concatenate([table, wanted])
    source = np.append(np.zeros(len(table), np.int64), np.ones(len(wanted), np.int64))
    by = np.lexsort((source, both[:, 1], both[:, 0]))
    at = np.cumsum(source[by] == 0) - 1
    out = np.empty(len(wanted), np.int64)
    out[order] = at[source[by] == 1]
    return out


def _roots_of(labels: DataFrame, parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.zeros(batch.num_rows, _ROOT)
            rows["set"], rows["root"] = _words(batch.column("node")), _words(batch.column("root"))
            out = _dealt(_part_of(rows["set"][:, 0], parts), 2, rows)
            if out is not None:
                yield out

    return labels.mapInArrow(tidy(run), _ROWS)


def may_link(rows: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """False where sizes or sketches of two sets say that they differ in more than a ninth of both."""
    n, m = rows["n"][a].astype(np.int64), rows["n"][b].astype(np.int64)
    ok = 9 * np.abs(n - m) <= n + m
    at = np.flatnonzero(ok)
    differ = np.bitwise_count(rows["sketch"][a[at]] ^ rows["sketch"][b[at]]).sum(1, dtype=np.int64)
    ok[at] = 9 * differ <= n[at] + m[at]
    return ok


def _numbers(roots: np.ndarray) -> np.ndarray:
    """A number for each different root."""
    order = np.lexsort((roots[:, 1], roots[:, 0]))
    first, n = _runs(roots[order, 0], roots[order, 1])
    out = np.empty(len(roots), np.int64)
    out[order] = np.repeat(np.arange(len(first)), n)
    return out


_AT_ONCE = 500_000
#: Sets of a key that are all compared with each other at once.
SMALL = 4


def _compared(e: np.ndarray, rows: np.ndarray, turn: int | None, small: int) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """Of a part's keys: entries that need another turn, and pairs of sets in different components to verify.

    With a turn, each set outside the component that most sets of the key are in is paired with one of that component; which one depends on the turn.
    Without, and for keys of a small number of sets, with every set of another component.
    """
    root = _numbers(rows["root"])
    order = mix(rows["set"][:, 0] + np.uint64(0 if turn is None else turn + 1))
    # by key, then component; of a component, by the turn's order
    e = e[np.lexsort((order[e["ref"]], root[e["ref"]], e["key"]))]
    ref = e["ref"].astype(np.int64)
    first, n = _runs(e["key"], root[ref])
    key_first, components_ = _runs(e["key"][first])
    begin = np.append(first[key_first], len(e))
    # of each key, the run of the largest component
    group = np.repeat(np.arange(len(key_first)), components_)
    main = np.lexsort((order[ref[first]], -n, group))[key_first]
    of = np.repeat(group, n)
    mixed = components_[of] > 1
    outside = mixed & (np.repeat(np.arange(len(first)), n) != main[of])
    whole = np.full(len(e), True) if turn is None else np.diff(begin)[of] <= small

    def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        x = np.flatnonzero(outside & ~whole)
        yield ref[first[main]][of[x]], ref[x]
        x = np.flatnonzero(outside & whole)
        total = np.append(0, np.cumsum(begin[of[x] + 1] - begin[of[x]]))
        for a in range(0, int(total[-1]), _AT_ONCE):
            at = np.arange(a, min(a + _AT_ONCE, int(total[-1])))
            i = np.searchsorted(total, at, side="right") - 1
            p = x[i]
            q = begin[of[p]] + at - total[i]
            once = (root[ref[p]] != root[ref[q]]) & (~outside[q] | (p < q))
            yield ref[q[once]], ref[p[once]]

    return e[mixed & ~whole], pairs()


def _pairs(rows: np.ndarray, some: Iterator[tuple[np.ndarray, np.ndarray]], parts: int) -> Iterator[pa.RecordBatch | None]:
    for a, b in some:
        ok = may_link(rows, a, b)
        both = np.unique(np.stack([a[ok], b[ok]], axis=1), axis=0)
        out = np.empty(len(both), _PAIR)
        if len(both):
            out["a"], out["b"], out["n"] = rows["set"][both[:, 0]], rows["set"][both[:, 1]], rows["n"][both[:, 1]]
            yield _dealt(_part_of(out["b"][:, 0], parts), 3, out)


def compare(kept: DataFrame, labels: DataFrame | None, turn: int | None, parts: int) -> DataFrame:
    """kept (keys by the set's part) -> the same of keys that are still mixed, and pairs to verify, by the part of b."""

    small, labelled = SMALL, labels is not None

    def by_key(number: int, part: dict) -> Iterator[pa.RecordBatch | None]:
        e, rows = part[0]
        if labelled and len(part[2][1]):
            known = part[2][1]
            rows = rows.copy()
            place = _place(known["set"], rows["set"])
            same = (place >= 0) & (known["set"][place] == rows["set"]).all(1)
            rows["root"][same] = known["root"][place[same]]
        yield _dealt(_part_of(e["key"], parts), 0, rows, e)

    def groups(number: int, part: dict) -> Iterator[pa.RecordBatch | None]:
        e, rows = part[0]
        mixed, some = _compared(e, rows, turn, small)
        if turn is not None:
            yield _dealt(_part_of(rows["set"][mixed["ref"], 0], parts), 0, rows, mixed)
        yield from _pairs(rows, some, parts)

    kinds = {0: (_KEPT, _SET)} | ({2: (None, _ROOT)} if labels is not None else {})
    source = kept.where("kind = 0")
    if labels is not None:
        source = _gathered(source.unionByName(_roots_of(labels, parts)))
    return settle(_each_part(_gathered(_each_part(source if labels is not None else source.sortWithinPartitions("part"), kinds, by_key)), {0: (_KEPT, _SET)}, groups), "compared")


def pairs_of(compared: DataFrame) -> DataFrame:
    """(a, b, n): the pairs to verify, once each, with the size of b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part in _by_part(batches, {3: (None, _PAIR)}):
            rows = part[3][1]
            order = np.lexsort((rows["a"][:, 1], rows["a"][:, 0], rows["b"][:, 1], rows["b"][:, 0]))
            rows = rows[order[_runs(*(rows[c][order, k] for c in "ba" for k in (0, 1)))[0]]]
            for i in range(0, len(rows), 50_000):
                some = rows[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([*(pa.array([x.tobytes() for x in some[c]], pa.binary()) for c in "ab"), pa.array(some["n"].astype(np.int32))], names=["a", "b", "n"])

    return _gathered(compared.where("kind = 3")).mapInArrow(tidy(run), "a binary, b binary, n int")


def _links_in(table: pa.Table) -> pa.Table:
    """Of rows (a, b, elements of b; or those of a where b is null): the pairs that are linked."""
    a, b, elements = (table.column(c).to_pylist() for c in ("a", "b", "elements"))
    middle = {x: np.frombuffer(s, "u8") for x, y, s in zip(a, b, elements, strict=True) if y is None}
    out: list[tuple[bytes, bytes]] = []
    for x, y, s in zip(a, b, elements, strict=True):
        if y is not None:
            m, other = middle[x], np.frombuffer(s, "u8")
            at = np.minimum(np.searchsorted(m, other), len(m) - 1)
            if linked(np.count_nonzero(m[at] == other), len(m), len(other)):
                out.append((x, y))
    x, y = zip(*out, strict=True) if out else ((), ())
    return pa.table({"a": pa.array(x, pa.binary()), "b": pa.array(y, pa.binary())})


def _near_in(table: pa.Table) -> pa.Table:
    """Of rows (a, b, wide sketch of b; or that of a where b is null): the pairs that may be linked, with the size of b."""
    a, b, elements = (table.column(c).to_pylist() for c in ("a", "b", "elements"))
    middle = {x: s for x, y, s in zip(a, b, elements, strict=True) if y is None}
    out = [(x, y, int.from_bytes(s[:8], "little")) for x, y, s in zip(a, b, elements, strict=True) if y is not None and wide_may_link(middle[x], s)]
    x, y, n = zip(*out, strict=True) if out else ((), (), ())
    return pa.table({"a": pa.array(x, pa.binary()), "b": pa.array(y, pa.binary()), "n": pa.array(n, pa.int32())})


def _starred(pairs: DataFrame, members: DataFrame, each: float) -> DataFrame:
    """(a, b, elements, bucket) of pairs(a, b, n) and members(handle, elements) of so many bytes a shingle. Pairs of one a are dealt to tasks by their bytes."""
    size = F.col("n") * F.lit(each) + F.lit(ROW_BYTES)
    total = pairs.agg(F.sum(size)).first()[0] or 0
    buckets = int(total // BLOCK_BYTES) + 1
    per = pairs.groupBy("a").agg((F.sum(size) / F.lit(BLOCK_BYTES)).cast("int").alias("more")).where("more > 0")
    dealt = pairs.join(per, "a", "left").withColumn("star", F.xxhash64("a", F.pmod(F.xxhash64("b"), F.coalesce("more", F.lit(0)) + 1)))
    heads = dealt.select("star", "a").distinct().select("star", "a", F.lit(None).cast("binary").alias("b"), F.col("a").alias("handle"))
    others = dealt.select("star", "a", "b", F.col("b").alias("handle"))
    return heads.unionByName(others).join(members, "handle").select("a", "b", "elements", F.pmod("star", F.lit(buckets)).alias("bucket"))


def near(pairs: DataFrame, wide: DataFrame) -> DataFrame:
    """Those of pairs(a, b, n) that wide sketches don't rule out; wide(handle, elements)."""
    return _starred(pairs, wide, 0.5).groupBy("bucket").applyInArrow(_near_in, "a binary, b binary, n int")


def verified(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """The linked ones of pairs(a, b, n); members(handle, elements)."""
    return _starred(pairs, members, 8.0).groupBy("bucket").applyInArrow(_links_in, "a binary, b binary")


def map_of(wanted: DataFrame) -> DataFrame:
    """(word, bits): a map of bits of wanted(row), of bounded size, to be broadcast."""
    place = F.pmod("row", F.lit(64 * MAP_WORDS))
    return wanted.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(row, {64 * MAP_WORDS}) % 64 as int))")).alias("bits"))


def marked(docs: DataFrame, some: DataFrame, yes: bool = True) -> DataFrame:
    """The rows of docs whose bit the map has, or those whose bit it hasn't."""
    word, bit = F.shiftright(F.pmod("row", F.lit(64 * MAP_WORDS)), 6), F.expr(f"shiftleft(1L, cast(pmod(row, {64 * MAP_WORDS}) % 64 as int))")
    has = F.coalesce(F.col("bits").bitwiseAND(bit), F.lit(0)) != 0
    return docs.withColumn("word", word).join(F.broadcast(some), "word", "inner" if yes else "left").where(has if yes else ~has).drop("word", "bits")


def _perhaps(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of docs that wanted(row) has, and few others: a map of bits of the hashes, of bounded size, tells them, so that no text is dealt out that isn't wanted."""
    return marked(docs, map_of(wanted))


def _elements(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(handle, elements, wide sketch) of wanted(handle, row), which has a row for each handle. Copies of a row meet by the row, as the join has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = sets([t or "" for t in batch.column("text").to_pylist()])
            rows = [(h, s.tobytes(), wide_sketch(s)) for h, s in zip(batch.column("handle").to_pylist(), got, strict=True) if len(s) and set_hash(s) == h]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*rows, strict=True)], names=["handle", "elements", "wide"])

    got = _perhaps(docs.select("row", "text"), wanted).join(wanted, "row").dropDuplicates(["row", "handle", "text"])
    return got.select("handle", "text").mapInArrow(tidy(run), "handle binary, elements binary, wide binary")


def links(docs: DataFrame, about: DataFrame) -> DataFrame | None:
    """(node, root) of handles: the components of all documents that links join."""
    shingles = about.agg(F.sum("n_shingles")).first()[0]
    # by the bytes alone: with the number of tasks, what each sends to each part would fall apart
    parts = int((shingles or 0) * _KEYED.itemsize // PART_BYTES) + 1
    first = settle(about.where("n_shingles > 1").groupBy("handle").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("n")), "sets")
    kept = settle(kept_keys(each_set_once(docs, about, first), parts), "kept-keys")
    first = first.select("handle", "row")
    members, wanted, labels, found = None, None, None, None
    turn: int | None = 0 if STARS else None
    while True:
        compared = compare(kept, labels, turn, parts)
        drop_settled(kept)
        kept = compared
        pairs = settle(pairs_of(compared), "pairs")
        if members is None:  # all pairs to come are of these sets
            wanted = settle(first.join(_handles(compared, parts), "handle"), "wanted")
            members = settle(_elements(docs, wanted), "members")
        asked, got = pairs.count(), 0
        if asked:
            left = settle(near(pairs, members.select("handle", F.col("wide").alias("elements"))), "near-pairs")
            more = settle(verified(left, members.select("handle", "elements")), "links")
            got = more.count()
            drop_settled(left)
        if got:
            found = more if found is None else found.unionByName(more)
            labels = components(found, "linked")
        drop_settled(pairs)
        if turn is None or not compared.where("kind = 0").limit(1).count():
            break
        # further stars are worth it as long as they join most of what they ask for
        turn = turn + 1 if turn + 1 < STARS and 2 * got > asked else None
    drop_settled(kept)
    drop_settled(members)
    drop_settled(wanted)
    return labels


def _handles(compared: DataFrame, parts: int) -> DataFrame:
    """(handle): the sets of keys and pairs, once each. A set's names from all tasks meet in the set's part."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.zeros((0, 2), "u8")]
            for kind, rows in zip(batch.column("kind").to_pylist(), batch.column("rows").to_pylist(), strict=True):
                if kind == 3:
                    x = np.frombuffer(rows, _PAIR)
                    out += [x["a"], x["b"]]
                else:
                    out.append(np.frombuffer(rows, _SET)["set"])
            x = np.unique(np.concatenate(out), axis=0)
            names = np.empty(len(x), _NAME)
            names["set"] = x
            dealt = _dealt(_part_of(x[:, 0], parts), 4, names)
            if dealt is not None:
                yield dealt

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part in _by_part(batches, {4: (None, _NAME)}):
            names = part[4][1]["set"]
            for i in range(0, len(names), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in names[i : i + 50_000]], pa.binary())], names=["handle"])

    return _gathered(compared.mapInArrow(tidy(named), _ROWS)).mapInArrow(tidy(once), "handle binary")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id (the smallest id that links reach, its own included)."""
    plain = docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("row"), F.col(text_col).alias("text"))
    about = settle(described(plain), "shingle-sets")
    labels = links(plain, about)
    named = about.select(F.col("id").alias(id_col), "n_shingles", "handle")
    ids = named.where("handle is not null").groupBy("handle").agg(F.min(id_col).alias("least"))
    if labels is not None:
        known = ids.join(labels, ids["handle"] == labels["node"], "left").select("handle", "least", F.coalesce("root", "handle").alias("root"))
        ids = known.join(known.groupBy("root").agg(F.min("least").alias("of_all")), "root").select("handle", F.col("of_all").alias("least"))
    of = settle(ids.select("handle", F.col("least").alias("component_id")), "component-ids")
    linked_rows = named.where("handle is not null").join(of, "handle").select(id_col, "n_shingles", "component_id")
    alone = named.where("handle is null").select(id_col, "n_shingles", F.col(id_col).alias("component_id"))
    return linked_rows.unionByName(alone)


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each component: that with the smallest id; rows without an id come after all others.

    Ids are numbers or texts. Rows are told apart by id and a hash of the text, so that different texts of one id are rows of their own. Rows with neither id nor words are all kept.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    nothing = F.col(id_col).isNull() & text.rlike(r"^[\x20\x09-\x0D]*\z")
    key = "__id"
    while key in docs.columns:
        key += "_"
    kind = docs.schema[id_col].dataType.simpleString()
    parts = [F.col(id_col).isNull().alias("last"), F.coalesce(F.col(id_col), F.lit("" if kind == "string" else 0).cast(kind)).alias("id"), F.xxhash64(text).alias("hash"), F.col(text_col).isNull().alias("none")]
    keyed = docs.where(~nothing).withColumn(key, F.struct(*parts))
    got = join(keyed, key, text_col).select(F.col(key).alias("key"), (F.col(key) == F.col("component_id")).alias("stays"))
    got = settle(got.withColumn("row", F.xxhash64("key")), "kept-rows")
    # rows that stay stay where they are, but for repeated ones and those that the map can't tell from others
    some = map_of(got.groupBy("row").agg(F.count(F.lit(1)).alias("n"), F.bool_and("stays").alias("stays")).where("n > 1 or not stays").select("row"))
    wanted = settle(marked(got.where("stays").select("key", "row").distinct(), some), "rows-to-keep")
    packed = keyed.select(F.struct(*docs.columns).alias("doc"), F.col(key).alias("key"), F.xxhash64(key).alias("row"))
    met = _perhaps(packed, wanted).join(wanted.select("key"), "key", "left_semi").dropDuplicates(["key"])
    return marked(packed, some, False).unionByName(met).select("doc.*").unionByName(docs.where(nothing))


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS shingle
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
), e AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)
), g AS (
  SELECT x AS a, y AS b FROM e UNION ALL SELECT y, x FROM e
), r AS (
  WITH RECURSIVE t(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT t.a, g.b FROM t JOIN g ON t.b = g.a) SELECT a, min(b) AS component_id FROM t GROUP BY a
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.a = d.doc_id
"""
