"""Repeated byte strings by suffix arrays of shards.

Every start of a LENGTH-byte string belongs to the anchor of that string: the place in it where a hash of GRAM bytes is least. Equal strings have equal
anchors, so only strings of one anchor's hash need comparing. Starts of one anchor that follow each other make a context, the bytes
that their strings cover. Equal contexts, by 128 bits of their hash, are counted by the cluster and hold repeats throughout. Where an anchor's hash has several different contexts,
these go to shards of bounded bytes. A shard sorts the suffixes of its contexts to LENGTH bytes by Larsson-Sadakane refinement and takes common prefixes by
Kasai's rule that the next position's is at most one shorter; neighbours with LENGTH bytes in common are repeats. An anchor whose contexts exceed a shard
is spread over several; their sorted strings are merged by binary search among those of the other shards, by 128 bits of theirs.

Edge cases: null texts are empty; texts under LENGTH bytes lose nothing. Repeated rows are copies of each other. Strings never reach over a document's end; overlapping occurrences
count; all is judged on the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_settled, per_slice, settle, tidy, trim
from .ngram_join import _perhaps as perhaps
from .ngram_join import map_of, marked
from .textcore import mix

LENGTH = 400
GRAM = 64
#: Bytes of contexts that an anchor has in a shard at most, on average; what it has beyond that is spread over several.
SHARD_BYTES = 1_000_000
#: Bytes of contexts of small anchors in a shard, on average.
SMALL_BYTES = 300_000
#: Bytes of text that contexts are looked for in at once; a longer text is gone through in pieces.
SLICE = 500_000
#: Partitions that the rows of one text are dealt to, if it has many.
SALTS = 64
#: Longer texts are gone through in pieces.
PIECE = 1_000_000
_POSITION_BITS = 26
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D, 0x9FB21C651E98DF25], dtype=np.uint64)


def _grams(data: bytes, gram: int) -> np.ndarray:
    """A hash of the gram bytes at each position."""
    n = len(data) - gram + 1
    words = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,)).copy()
    h = np.zeros(n, np.uint64)
    for k in range(gram // 8):
        h = (h ^ words[8 * k : 8 * k + n]) * _MULTIPLIERS[k % 8]
        h ^= h >> np.uint64(32)
    return mix(h)


def contexts(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first start, number of starts, anchor's hash, digest of the bytes) of all contexts."""
    own = [(i, o, t[o : o + PIECE + length - 1]) for i, t in enumerate(texts) for o in range(0, max(1, len(t) - length + 1), PIECE) if len(t) >= length]
    out: list[tuple[np.ndarray, ...]] = []
    k = 0
    while k < len(own):
        group, size = [], 0
        while k < len(own) and (not size or size + len(own[k][2]) <= PIECE):
            group.append(own[k])
            size += len(own[k][2])
            k += 1
        data = b"".join(g[2] for g in group)
        h = _grams(data, gram)
        window = length - gram + 1
        # least hash of each window with its place, by running minima from both ends of blocks
        low = np.uint64((1 << _POSITION_BITS) - 1)
        key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        padded = np.append(key, np.full(-len(h) % window, np.uint64(0xFFFFFFFFFFFFFFFF))).reshape(-1, window)
        n = len(h) - window + 1
        before = np.minimum.accumulate(padded, axis=1).ravel()[window - 1 : window - 1 + n]
        after = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()[:n]
        place = (np.minimum(before, after) & low).astype(np.int64)
        sizes = np.array([len(g[2]) for g in group])
        base = np.cumsum(sizes) - sizes
        count = sizes - length + 1
        piece = np.repeat(np.arange(len(group)), count)
        start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + base[piece]
        p = place[start]
        new = np.flatnonzero(np.append(True, (p[1:] != p[:-1]) | (piece[1:] != piece[:-1])))
        starts = np.diff(np.append(new, len(p)))
        first = start[new]
        view = memoryview(data)
        digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(view[a : a + c + length - 1]) for a, c in zip(first.tolist(), starts.tolist(), strict=True)), "V16")
        piece = piece[new]
        text, offset = np.array([g[0] for g in group]), np.array([g[1] for g in group])
        out.append((text[piece], first - base[piece] + offset[piece], starts, h[p[new]], digest))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0, np.uint64), np.zeros(0, "V16"))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their first depth bytes; bytes after the end sort first.

    Larsson and Sadakane's refinement: suffixes sorted by h bytes get their group's first slot as rank, and groups of several
    are sorted by the rank of what follows h bytes later, so that h doubles; groups of one are left alone.
    """
    n = len(data)
    padded = np.append(data, np.zeros(8, np.uint8))
    head = np.zeros(n, np.uint64)
    for k in range(8):
        head = (head << np.uint64(8)) | padded[k : k + n].astype(np.uint64)
    sa = np.argsort(head)
    sorted_head = head[sa]
    new = np.append(True, sorted_head[1:] != sorted_head[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, n))
    rank = np.zeros(n + depth + 1, np.int32)  # 0 after the end
    rank[sa] = np.repeat(first, size) + 1
    slots = np.flatnonzero(np.repeat(size > 1, size))
    del head, sorted_head, new
    h = 8
    while h < depth and len(slots):
        step = min(h, depth - h)
        at = sa[slots]
        key = rank[at].astype(np.int64) * (n + 1) + rank[at + step]
        order = np.argsort(key)
        at, key = at[order], key[order]
        sa[slots] = at
        new = np.append(True, key[1:] != key[:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(slots)))
        rank[at] = np.repeat(slots[first], size) + 1
        slots = slots[np.repeat(size > 1, size)]
        h += step
    return sa


def common_prefixes(data: np.ndarray, sa: np.ndarray, breaks: np.ndarray, most: int) -> np.ndarray:
    """Bytes that each suffix in sa shares with the one before it.

    Comparing stops at most bytes: where it does, values after it are too small by as much as they are further on.

    Kasai's rule: if the suffix before i is j and the one before i + 1 is j + 1, then what these share is one byte less. Where
    that doesn't hold, and at breaks, bytes are compared, eight at a time.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    place = np.sort(sa)
    j = before[place]
    go_on = np.zeros(len(place), bool)
    go_on[1:] = (place[1:] == place[:-1] + 1) & (j[1:] == j[:-1] + 1) & (j[:-1] >= 0)
    go_on[np.isin(place, breaks)] = False
    padded = np.append(data, np.zeros(8, np.uint8))
    words = np.ndarray((n + 1,), dtype="<u8", buffer=padded.tobytes(), strides=(1,))

    def compared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        shared = np.zeros(len(a), np.int64)
        live = np.flatnonzero(b >= 0)
        while len(live):
            x, y = a[live] + shared[live], b[live] + shared[live]
            room = np.minimum(np.minimum(n - x, n - y), most - shared[live])
            some = room > 0
            live, x, y, room = live[some], x[some], y[some], room[some]
            differ = words[x] ^ words[y]
            lowest = differ & (~differ + np.uint64(1))
            same = np.where(differ == 0, 8, (np.log2(np.maximum(lowest, 1).astype(np.float64)) // 8).astype(np.int64))
            shared[live] += np.minimum(same, room)
            live = live[(same == 8) & (room > 8)]
        return shared

    heads = np.flatnonzero(~go_on)
    shared = compared(place[heads], j[heads])
    head_of = np.cumsum(~go_on) - 1
    plcp = shared[head_of] - (place - place[heads][head_of])
    # behind a place that shares nothing the rule says nothing
    open_ = np.flatnonzero(plcp < 0)
    plcp[open_] = compared(place[open_], j[open_])
    out = np.zeros(n, np.int64)
    out[place] = plcp
    return out[sa]


def repeats(parts: list[bytes], starts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a shard's contexts: (all their starts in order of the strings, whether a string has another place, number of its class)."""
    data = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(p) for p in parts])
    base = np.cumsum(sizes) - sizes
    own = np.zeros(len(data) + 1, np.int32)
    np.add.at(own, base, 1)
    np.add.at(own, base + starts, -1)
    own = np.cumsum(own[:-1]) > 0
    sa = suffix_array(data, length)
    sa = sa[own[sa]]
    lcp = common_prefixes(data, sa, base, 2 * length)
    same = lcp >= length
    same[:1] = False
    hit = same.copy()
    hit[:-1] |= same[1:]
    return sa, hit, np.cumsum(~same) - 1


def runs_of(covered: np.ndarray) -> list[tuple[int, int]]:
    """[first, after last) of each run of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
    return list(zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True))


_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def window_hashes(data: np.ndarray, at: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """A hash of the length bytes at each place, of 16 bytes that sort as text."""
    out = np.empty((len(at), 2), ">u8")
    for k, number in enumerate(_BASES):
        base, n = np.uint64(number), len(data)
        inverse = np.uint64(pow(number, -1, 1 << 64))
        power = np.multiply.accumulate(np.append(np.uint64(1), np.full(n, base)))
        back = np.multiply.accumulate(np.append(np.uint64(1), np.full(n, inverse)))
        total = np.append(np.uint64(0), np.cumsum((mix(data.astype(np.uint64) + base)) * power[:n], dtype=np.uint64))
        out[:, k] = mix((total[at + length] - total[at]) * back[at])
    return out.view("S16").ravel()


_OCCURRENCE = "handle binary, n int, first long, starts int, anchor long, digest binary"
_SPANS = "anchor long, digest binary, spans array<struct<a:int,b:int>>"


def occurrences(docs: DataFrame, copied: dict[bytes, int], length: int = LENGTH) -> DataFrame:
    """docs(row, handle, text) -> a row per context of each text; of those in copied only that row, which counts for several."""

    def run(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch | None:
        handles, rows = batch.column("handle").to_pylist(), batch.column("row").to_pylist()
        data = [t.encode("utf-8", "surrogatepass") if copied.get(h, r) == r else b"" for t, h, r in zip(texts, handles, rows, strict=True)]
        doc, first, starts, anchor, digest = contexts(data, length)
        if not len(doc):
            return None
        n = np.array([2 if h in copied else 1 for h in handles], np.int32)[doc]
        cols = [batch.column("handle").take(pa.array(doc)), pa.array(n), pa.array(first, pa.int64()), pa.array(starts.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(digest.tolist(), pa.binary())]
        return pa.RecordBatch.from_arrays(cols, names=["handle", "n", "first", "starts", "anchor", "digest"])

    return docs.mapInArrow(per_slice(run, limit=SLICE), _OCCURRENCE)


def _spans_table(anchor: list[int], digest: list[bytes], spans: list[list[tuple[int, int]]]) -> pa.Table:
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    rows = [[{"a": a, "b": b} for a, b in s] for s in spans]
    return pa.table({"anchor": pa.array(anchor, pa.int64()), "digest": pa.array(digest, pa.binary()), "spans": pa.array(rows, kind)})


#: A string of a spread anchor: its hash, and where it starts in its context.
_STRING = np.dtype([("hash", "S16"), ("anchor", "i8"), ("digest", "V16"), ("start", "i4"), ("known", "i4")])


def _split(sorted_: np.ndarray, rows: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    first = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1]))
    return sorted_[first].tolist(), np.split(rows, first[1:])


def shard_spans(contexts_: DataFrame, length: int, merge_parts: int) -> DataFrame:
    """contexts_(shard, spread, anchor, digest, starts, n, body) -> spans of starts whose strings have another place."""

    def sort_shard(table: pa.Table) -> pa.Table:
        """Spans found inside the shard; and, of anchors that are spread, the strings to look for elsewhere, sorted by hash."""
        anchor, digest = table.column("anchor").to_pylist(), table.column("digest").to_pylist()
        starts, several, spread = (table.column(c).to_numpy() for c in ("starts", "n", "spread"))
        parts = table.column("body").to_pylist()
        sizes = np.array([len(p) for p in parts])
        base = np.cumsum(sizes) - sizes
        at, hit, label = repeats(parts, starts, length)
        which = np.searchsorted(base, at, side="right") - 1
        hit = hit | (several[which] > 1)
        covered = np.zeros(sizes.sum(), bool)
        covered[at[hit]] = True
        spans = [runs_of(covered[b : b + s]) for b, s in zip(base.tolist(), starts.tolist(), strict=True)]
        out = {"anchor": anchor, "digest": digest, "spans": spans, "part": [None] * len(anchor), "strings": [None] * len(anchor)}
        look = spread[which] > 1
        if look.any():
            # one string of each class; where the class was found to repeat, only others need it
            take = look & np.append(True, label[1:] != label[:-1])
            place, known, which = at[take], hit[take], which[take]
            h = window_hashes(np.frombuffer(b"".join(parts), np.uint8), place, length)
            part = (h.view(">u8")[::2] >> np.uint64(40)).astype(np.int64) % merge_parts
            rows = np.zeros(len(h), _STRING)
            rows["hash"], rows["anchor"] = h, np.array(anchor, np.int64)[which]
            rows["digest"] = np.frombuffer(b"".join(digest), "V16")[which]
            rows["start"], rows["known"] = place - base[which], known
            order = np.lexsort((h, part))
            for p, mine in zip(*_split(part[order], rows[order]), strict=True):
                for k, v in (("anchor", None), ("digest", None), ("spans", []), ("part", p), ("strings", mine.tobytes())):
                    out[k].append(v)
        t = _spans_table(out["anchor"], out["digest"], out["spans"])
        trim()
        return t.append_column("part", pa.array(out["part"], pa.int64())).append_column("strings", pa.array(out["strings"], pa.binary()))

    def merge(table: pa.Table) -> pa.Table:
        """Strings of a shard that are found in another shard's sorted strings."""
        lots = [np.frombuffer(x, _STRING) for x in table.column("strings").to_pylist()]
        every = np.sort(np.concatenate([x["hash"] for x in lots]))
        found = []
        for x in lots:
            n = np.searchsorted(every, x["hash"], side="right") - np.searchsorted(every, x["hash"], side="left")
            found.append(x[(n > 1) & (x["known"] == 0)])
        rows = np.concatenate(found)
        if not len(rows):
            return _spans_table([], [], [])
        digest = np.ascontiguousarray(rows["digest"]).view("S16")
        rows = rows[np.lexsort((rows["start"], digest, rows["anchor"]))]
        digest = np.ascontiguousarray(rows["digest"]).view(">u8").reshape(-1, 2)
        new = np.append(True, (rows["anchor"][1:] != rows["anchor"][:-1]) | (digest[1:] != digest[:-1]).any(1) | (rows["start"][1:] != rows["start"][:-1] + 1))
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(rows)) - 1
        spans = [[(int(a), int(b) + 1)] for a, b in zip(rows["start"][first], rows["start"][last], strict=True)]
        return _spans_table(rows["anchor"][first].tolist(), rows["digest"][first].tolist(), spans)

    sorted_ = settle(contexts_.groupBy("shard").applyInArrow(sort_shard, f"{_SPANS}, part long, strings binary"), "shards")
    inside = sorted_.where("part is null and size(spans) > 0").select("anchor", "digest", "spans")
    across = sorted_.where("part is not null").select("part", "strings").groupBy("part").applyInArrow(merge, _SPANS)
    return inside.unionByName(across)


def copied_texts(docs: DataFrame) -> dict[bytes, int]:
    """The row that stands for each text with so many rows that no task should get them all; there are 10000 such texts at most."""
    n = docs.select("handle").groupBy("handle").agg(F.count(F.lit(1)).alias("n")).where("n > 1000")
    least = max(1000, docs.select("handle").count() // 10_000) if n.limit(1).count() else 0
    several = docs.groupBy("handle").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("row")).where(F.col("n") > least)
    return {r[0]: r[1] for r in several.select("handle", "row").collect()} if least else {}


def repeated_spans(docs: DataFrame, copied: dict[bytes, int], length: int = LENGTH) -> DataFrame:
    """docs(row, handle, text) -> handle, spans: the ranges of starts of repeated strings of each text that has any, sorted; those of which the bytes touch are one."""
    spark = docs.sparkSession
    every = settle(occurrences(docs, copied, length), "contexts")
    # contexts of which no other has the anchor hold no repeats; they are most, and aren't dealt out whole
    often = settle(every.groupBy(F.col("anchor").alias("row")).agg(F.sum("n").alias("n")).where("n > 1").select("row"), "anchors")
    found = settle(perhaps(every.withColumn("row", F.col("anchor")), often).join(often, "row").drop("row"), "shared-contexts")  # not a semi join, which would go before the map
    drop_settled(every)
    drop_settled(often)
    unique = found.groupBy("anchor", "digest").agg(F.sum("n").alias("n"), F.min(F.struct("handle", "first")).alias("at"), F.min("starts").alias("starts"))
    unique = settle(unique, "unique-contexts")
    anchors = unique.groupBy("anchor").agg(F.count(F.lit(1)).alias("k"), F.sum(F.col("starts") + F.lit(length - 1)).alias("bytes")).where("k > 1")
    total = anchors.agg(F.sum("bytes")).first()[0] or 0
    shards = max(1, int(total // SMALL_BYTES) + 1)
    mixed = unique.join(anchors, "anchor")
    spread = F.ceil(F.col("bytes") / F.lit(SHARD_BYTES)).cast("int")
    # small anchors share the shards; a large one has its contexts spread over shards of its own
    shard = F.when(spread > 1, F.xxhash64("anchor", F.pmod(F.xxhash64("digest"), spread))).otherwise(F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    wanted = mixed.select(F.col("at.handle").alias("handle"), F.struct(F.col("at.first").alias("first"), "starts", "n", "anchor", "digest", shard.alias("shard"), spread.alias("spread")).alias("w"))
    wanted = wanted.groupBy("handle").agg(F.collect_list("w").alias("w"))
    kinds = [("shard", pa.int64()), ("spread", pa.int32()), ("anchor", pa.int64()), ("digest", pa.binary()), ("starts", pa.int32()), ("n", pa.int64()), ("body", pa.binary())]

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[k for k, _ in kinds])
        for batch in batches:
            rows, size = [], 0
            for text, w in zip(batch.column("text"), batch.column("w"), strict=True):
                data = text.as_py().encode("utf-8", "surrogatepass")
                for x in w.as_py():
                    body = data[x["first"] : x["first"] + x["starts"] + length - 1]
                    rows.append((x["shard"], x["spread"], x["anchor"], x["digest"], x["starts"], x["n"], body))
                    size += len(body)
                    if size > 2_000_000:
                        yield made(rows)
                        rows, size = [], 0
            if rows:
                yield made(rows)

    # of equal texts one row: the least
    rows = settle(docs.groupBy("handle").agg(F.min("row").alias("row")).join(wanted, "handle").select("row", "w"), "wanted-contexts")
    bodies = perhaps(docs.select("row", "text"), rows).join(rows, "row").select("text", "w").mapInArrow(tidy(cut_out), "shard long, spread int, anchor long, digest binary, starts int, n long, body binary")
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sorted_spans = settle(shard_spans(bodies, length, parts), "spans")
    # anchors with one context: it repeats throughout if it occurs twice
    whole = unique.join(anchors.select("anchor"), "anchor", "left_anti").where("n > 1")
    whole = whole.select("anchor", "digest", F.array(F.struct(F.lit(0).alias("a"), F.col("starts").alias("b"))).alias("spans"))
    at = found.select("handle", "first", "anchor", "digest").join(sorted_spans.unionByName(whole), ["anchor", "digest"])
    each = at.select("handle", "first", F.explode("spans").alias("s")).select("handle", (F.col("first") + F.col("s.a")).alias("a"), (F.col("first") + F.col("s.b")).alias("b"))
    # ranges of which the bytes touch become one before they are collected
    before = Window.partitionBy("handle").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    apart = F.when(F.col("a") <= F.max("b").over(before) + F.lit(length - 1), 0).otherwise(1)
    island = F.sum("apart").over(Window.partitionBy("handle").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, 0))
    islands = each.withColumn("apart", apart).withColumn("island", island).groupBy("handle", "island").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    spans = settle(islands.groupBy("handle").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("spans")), "text-spans")
    for done in (found, unique, rows, sorted_spans):
        drop_settled(done)
    return spans


def removed_ranges(spans: list[tuple[int, int]], length: int = LENGTH) -> list[tuple[int, int]]:
    """The maximal ranges of bytes that strings from these (sorted) starts cover."""
    out: list[list[int]] = []
    for a, b in spans:
        end = b + length - 1
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([a, end])
    return [(a, b) for a, b in out]


def strip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """docs as row (a struct of all columns but the text), and: missing (the text is null), n_bytes, n_removed, n_spans, kept (the bytes that are left)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    handle = F.unhex(F.md5(text.cast("binary")))
    plain = docs.select(F.xxhash64(F.col(id_col), text).alias("row"), handle.alias("handle"), text.alias("text"))
    copied = copied_texts(plain)
    spans = repeated_spans(plain, copied, length)
    # rows of a text that many have are dealt to several tasks
    several = F.col("handle").isin([bytearray(h) for h in copied]) if copied else F.lit(False)
    salted = spans.withColumn("salt", F.explode(F.when(several, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    others = [c for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*others, F.lit(None).cast("void").cast("int").alias("__none")).alias("doc"), F.col(text_col).alias("text"), handle.alias("handle"), F.xxhash64(handle).alias("row"))
    # texts that lose nothing stay where they are
    some = map_of(spans.select(F.xxhash64("handle").alias("row")))
    met = marked(rows, some).withColumn("salt", F.when(several, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).otherwise(0)).join(salted, ["handle", "salt"], "left")
    rows = met.select("doc", "text", "spans").unionByName(marked(rows, some, False).select("doc", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))).withColumnRenamed("doc", "row")

    def run(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        kept, numbers = [], []
        for t, s in zip(texts, batch.column("spans"), strict=True):
            data = t.encode("utf-8", "surrogatepass")
            ranges = removed_ranges([(x["a"], x["b"]) for x in s.as_py()], length) if s.is_valid else []
            pieces, at = [], 0
            for a, b in ranges:
                pieces.append(data[at:a])
                at = b
            kept.append(b"".join([*pieces, data[at:]]))
            numbers.append((len(data), len(data) - len(kept[-1]), len(ranges)))
        cols = [pa.array(c, pa.int64()) for c in zip(*numbers, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("row"), batch.column("text").is_null(), *cols, pa.array(kept, pa.binary())], names=["row", "missing", "n_bytes", "n_removed", "n_spans", "kept"])

    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(per_slice(run), f"row {kind}, missing boolean, n_bytes long, n_removed long, n_spans long, kept binary")


def strip_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """docs with what is left of each text (a character cut through becomes U+FFFD), and its length in size_col if there is one; null texts stay null."""
    done = strip(docs, id_col, text_col)
    left = F.when(~F.col("missing"), F.make_valid_utf8(F.col("kept").cast("string")))
    cols = [left.alias(c) if c == text_col else F.char_length(left).cast(docs.schema[c].dataType).alias(c) if c == size_col else F.col("row").getField(c).alias(c) for c in docs.columns]
    return done.select(*cols)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256, and text: what is left (null texts give an empty one)."""
    done = strip(docs.select(F.col(id_col), F.col(text_col)), id_col, text_col)
    return done.select(F.col("row").getField(id_col).alias(id_col), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))


def brute_force(texts: list[bytes], length: int = LENGTH) -> list[tuple[int, int, int, str]]:
    """What report() gives, by looking up every string; for tests."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((len(t), int(gone.sum()), len(runs_of(gone)), hashlib.sha256(kept).hexdigest()))
    return out
