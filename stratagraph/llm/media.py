"""Copies of images by local descriptors.

Corners (Harris) at several scales get the direction of their patch's intensity centroid, and BITS binary tests between points of the patch turned by it. The bits are cut
into TABLES chunks; a chunk that two descriptors have in common makes them a candidate (the Hamming tables), so that cropping, a change of
brightness or contrast and noise leave enough of them. Each candidate votes for the turn, scale and shift that takes one image to the other; an image with LEAST_VOTES corners
that agree is a copy.

Images are binary PGM or PPM; others, null and damaged ones have no descriptors and match nothing, and so do images too small for a patch. Equal
images are one in the index: a match names the smallest id and how many there are, and search_all() says which they are. Rows without an id aren't indexed. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, tidy
from .ngram_join import _part_of, _runs

SCALES = (1.4, 1.0, 0.7, 0.5)
#: Pixels of a scaled image that have one corner on average: larger images have more of them.
CORNER_AREA = 400
RADIUS = 17
TABLES, CHUNK_BITS = 8, 32
BITS = TABLES * CHUNK_BITS
LEAST_VOTES = 3
#: Of the first SKETCH words of two descriptors so many bits may differ, else their common chunk is taken as chance.
SKETCH, MOST_DIFFERENT = 3, 14
#: Steps of shift (pixels) and turn (of a circle) that votes are counted by.
SHIFT_STEP, TURNS = 10.0, 16

_rng = np.random.default_rng(17)
_PAIRS = np.clip(_rng.normal(0, RADIUS / 2.2, (BITS, 2, 2)), -RADIUS * 0.7, RADIUS * 0.7)
_DISC = np.array([(y, x) for y in range(-RADIUS + 2, RADIUS - 1, 2) for x in range(-RADIUS + 2, RADIUS - 1, 2) if x * x + y * y <= (RADIUS - 2) ** 2])
_HEADER = re.compile(rb"(P[56])\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+(\d+)\s")


def decode(data: bytes | None) -> np.ndarray | None:
    """Grey levels of a binary PGM or PPM image of 8 bits; None if it isn't one."""
    m = _HEADER.match(data or b"")
    if not m or int(m[4]) > 255:
        return None
    w, h, depth = int(m[2]), int(m[3]), 3 if m[1] == b"P6" else 1
    body = data[m.end() : m.end() + w * h * depth]
    if len(body) < w * h * depth or not w * h:
        return None
    x = np.frombuffer(body, np.uint8).reshape(h, w, depth).astype(np.float32)
    return x.mean(2)


def encode(x: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % (x.shape[1], x.shape[0]) + np.clip(np.rint(x), 0, 255).astype(np.uint8).tobytes()


def _box(x: np.ndarray, r: int) -> np.ndarray:
    """Means over squares of 2 r + 1, of the last two axes."""
    p = np.pad(x, [(0, 0)] * (x.ndim - 2) + [(r + 1, r), (r + 1, r)], mode="edge")
    c = p.cumsum(-1, dtype=np.float64).cumsum(-2)
    k = 2 * r + 1
    return ((c[..., k:, k:] - c[..., :-k, k:] - c[..., k:, :-k] + c[..., :-k, :-k]) / (k * k)).astype(np.float32)


def _resized(x: np.ndarray, scale: float) -> np.ndarray:
    if scale == 1:
        return x
    h, w = int(x.shape[1] * scale), int(x.shape[2] * scale)
    y = np.clip((np.arange(h) + 0.5) / scale - 0.5, 0, x.shape[1] - 1)
    z = np.clip((np.arange(w) + 0.5) / scale - 0.5, 0, x.shape[2] - 1)
    y0, z0 = np.minimum(y.astype(int), x.shape[1] - 2), np.minimum(z.astype(int), x.shape[2] - 2)
    fy, fz = (y - y0)[:, None].astype(np.float32), (z - z0)[None, :].astype(np.float32)
    a = x[:, y0][:, :, z0] * (1 - fz) + x[:, y0][:, :, z0 + 1] * fz
    b = x[:, y0 + 1][:, :, z0] * (1 - fz) + x[:, y0 + 1][:, :, z0 + 1] * fz
    return a * (1 - fy) + b * fy


def features(images: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of images of one size: (image of each descriptor, its chunks, its geometry: x, y, number of the scale, angle, its first words)."""
    which, chunks, places, sketches = [], [], [], []
    for level, scale in enumerate(SCALES):
        if min(images.shape[1:]) * scale < 2 * RADIUS + 4:
            continue
        x = _box(_resized(images, scale), 1)
        gy, gx = np.gradient(x, axis=(1, 2))
        a, b, c = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        r = a * b - c * c - 0.05 * (a + b) ** 2
        peak = np.pad(r, [(0, 0), (2, 2), (2, 2)], constant_values=-np.inf)
        best = np.max([peak[:, i : i + r.shape[1], j : j + r.shape[2]] for i in range(5) for j in range(5)], axis=0)
        inner = np.zeros(r.shape[1:], bool)
        inner[RADIUS + 1 : -RADIUS - 1, RADIUS + 1 : -RADIUS - 1] = True
        r = np.where((r >= best) & inner & (r > 0), r, 0).reshape(len(r), -1)
        k = min(max(1, x.shape[1] * x.shape[2] // CORNER_AREA), r.shape[1])
        top = np.argpartition(-r, k - 1, axis=1)[:, :k]
        strength = np.take_along_axis(r, top, 1)
        i, j = np.nonzero(strength > 0.01 * np.maximum(r.max(1, keepdims=True), 1e-6))
        if not len(i):
            continue
        py, px = np.divmod(top[i, j], x.shape[2])
        patch = x[i[:, None], py[:, None] + _DISC[:, 0], px[:, None] + _DISC[:, 1]]
        patch = patch - patch.mean(1, keepdims=True)
        angle = np.arctan2(patch @ _DISC[:, 0].astype(np.float32), patch @ _DISC[:, 1].astype(np.float32))
        cos, sin = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
        u, v = _PAIRS[None, :, :, 0], _PAIRS[None, :, :, 1]
        qx = np.rint(px[:, None, None] + cos * u - sin * v).astype(int)
        qy = np.rint(py[:, None, None] + sin * u + cos * v).astype(int)
        value = x[i[:, None, None], qy, qx]
        bits = np.packbits(value[:, :, 0] < value[:, :, 1], axis=1)
        sketches.append(np.ascontiguousarray(bits[:, : 8 * SKETCH]).view("<u8"))
        packed = bits.reshape(len(i), TABLES, CHUNK_BITS // 8).astype(np.int64)
        chunks.append(sum(packed[:, :, k] << (8 * k) for k in range(CHUNK_BITS // 8)))
        which.append(i)
        places.append(np.stack([(px + 0.5) / scale, (py + 0.5) / scale, np.full(len(i), level), angle], axis=1))
    if not which:
        return np.zeros(0, int), np.zeros((0, TABLES), np.int64), np.zeros((0, 4)), np.zeros((0, SKETCH), np.uint64)
    return np.concatenate(which), np.concatenate(chunks), np.concatenate(places), np.concatenate(sketches)


_ENTRY = np.dtype([("id", "i8"), ("x", "f4"), ("y", "f4"), ("scale", "u1"), ("angle", "u1"), ("corner", "u4"), ("query", "u1"), ("bits", "u8", (SKETCH,))])
_VOTE = np.dtype([("query", "i8"), ("match", "i8"), ("cell", "i8"), ("corner", "i4")])
#: Candidates that a task votes on at once, and pixels that it describes at once.
_AT_ONCE, _PIXELS = 200_000, 1_000_000
#: Tasks that the ids of one image are dealt to.
SALTS = 64


def _flat(rows: np.ndarray) -> bytes:
    """Rows by field, and numbers by byte, so that they compress; sketches are as they are."""
    fields = [rows[name] for name in rows.dtype.names or ()] or [rows]
    return b"".join(np.ascontiguousarray(f if f.ndim > 1 else np.ascontiguousarray(f).view("u1").reshape(len(f), f.itemsize).T).tobytes() for f in fields)


def _unflat(data: bytes, dtype: np.dtype) -> np.ndarray:
    rows, at = np.empty(len(data) // dtype.itemsize, dtype), 0
    for name in dtype.names or (None,):
        kind = dtype if name is None else dtype[name]
        own = np.frombuffer(data, "u1", len(rows) * kind.itemsize, at)
        at += len(own)
        field = own.view(kind.base).reshape(len(rows), *kind.shape) if kind.shape else np.ascontiguousarray(own.reshape(kind.itemsize, len(rows)).T).view(kind).ravel()
        rows[... if name is None else name] = field
    return rows


def _packed(part: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch | None:
    if not len(part):
        return None
    order = np.argsort(part, kind="stable")
    first, n = _runs(part[order])
    own = [order[a : a + k] for a, k in zip(first.tolist(), n.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(part[order][first], pa.int32()), *(pa.array([_flat(c[o]) for o in own], pa.binary()) for c in columns)], names=["part", *(f"c{i}" for i in range(len(columns)))])


def _entries(media: DataFrame, query: bool, parts: int) -> DataFrame:
    """media(id, image) -> a part's chunk keys and entries, in binary."""

    def described(some: list[tuple[int, np.ndarray]]) -> pa.RecordBatch | None:
        which, chunks, place, bits = features(np.stack([x for _, x in some]))
        if not len(which):
            return None
        rows = np.zeros(len(which), _ENTRY)
        rows["id"] = np.array([i for i, _ in some], np.int64)[which]
        rows["x"], rows["y"], rows["scale"] = place[:, 0], place[:, 1], place[:, 2]
        rows["angle"] = np.floor(place[:, 3] / (2 * np.pi) * 256) % 256
        rows["corner"], rows["query"], rows["bits"] = np.arange(len(rows)) if query else 0, query, bits
        key = (chunks + (np.arange(TABLES, dtype=np.int64) << CHUNK_BITS)).ravel()
        return _packed(_part_of(key, parts), [key, np.repeat(rows, TABLES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_size: dict[tuple, list] = {}
            for i, data in zip(batch.column("id").to_pylist(), batch.column("image"), strict=True):
                x = decode(data.as_py()) if i is not None else None
                if x is None:
                    continue
                some = by_size.setdefault(x.shape, [])
                some.append((i, x))
                if len(some) * x.size >= _PIXELS:
                    out = described(by_size.pop(x.shape))
                    if out is not None:
                        yield out
            for some in by_size.values():
                out = described(some)
                if out is not None:
                    yield out

    return media.select("id", "image").mapInArrow(tidy(run), "part int, c0 binary, c1 binary")


def _votes(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Queries' corners and the images' that share a chunk: what each such pair votes for, in half steps; by the query's part.

    A pair that shares several chunks votes in the first table where it does, as far as the sketches tell.
    """
    keys, rows = [], []
    for batch in batches:
        keys += [_unflat(x, np.dtype("i8")) for x in batch.column("c0").to_pylist()]
        rows += [_unflat(x, _ENTRY) for x in batch.column("c1").to_pylist()]
    if not keys:
        return
    key, row = np.concatenate(keys), np.concatenate(rows)
    asked = row["query"] == 1
    order = np.argsort(key[~asked], kind="stable")
    table, images = key[~asked][order], row[~asked][order]
    wanted, queries = key[asked], row[asked]
    low, high = np.searchsorted(table, wanted, "left"), np.searchsorted(table, wanted, "right")
    total = np.append(0, np.cumsum(high - low))
    for first in range(0, int(total[-1]), _AT_ONCE):
        hit = np.arange(first, min(first + _AT_ONCE, int(total[-1])))
        asks = np.searchsorted(total, hit, side="right") - 1
        q, at = queries[asks], low[asks] + hit - total[asks]
        m = images[at]
        differing = q["bits"] ^ m["bits"]
        earlier = (differing.view("<u4") == 0) & (np.arange(2 * SKETCH) < (wanted[asks] >> CHUNK_BITS)[:, None])
        close = (np.bitwise_count(differing).sum(1) <= MOST_DIFFERENT) & ~earlier.any(1)
        q, m = q[close], m[close]
        if not len(q):
            continue
        turn = (q["angle"].astype(float) - m["angle"]) % 256 / 256
        size = np.array(SCALES)
        scale = size[m["scale"]] / size[q["scale"]]
        cos, sin = np.cos(2 * np.pi * turn) * scale, np.sin(2 * np.pi * turn) * scale
        qx, qy, mx, my = (c.astype(float) for c in (q["x"], q["y"], m["x"], m["y"]))
        dx, dy = qx - (cos * mx - sin * my), qy - (sin * mx + cos * my)
        cell = [np.floor(2 * dx / SHIFT_STEP), np.floor(2 * dy / SHIFT_STEP), np.floor(2 * turn * TURNS), np.rint(np.log2(scale) * 4)]
        out = np.empty(len(q), _VOTE)
        out["query"], out["match"], out["corner"] = q["id"], m["id"], q["corner"]
        out["cell"] = ((cell[0].astype(np.int64) + (1 << 20)) << 42) | ((cell[1].astype(np.int64) + (1 << 20)) << 21) | (cell[2].astype(np.int64) << 12) | (cell[3].astype(np.int64) + 512)
        out = out[np.lexsort((out["corner"], out["cell"], out["match"], out["query"]))]
        out = out[_runs(out["query"], out["match"], out["cell"], out["corner"])[0]]
        yield _packed(_part_of(out["query"], parts), [out])


def _grids(rows: np.ndarray) -> np.ndarray:
    """Votes in half steps as votes in whole steps of two offset grids."""
    each = []
    for shift in (0, 1):
        x, y, turn, scale = rows["cell"] >> 42, (rows["cell"] >> 21) & ((1 << 21) - 1), (rows["cell"] >> 12) & 511, rows["cell"] & 4095
        own = rows.copy()
        own["cell"] = ((x + shift) >> 1 << 42) | ((y + shift) >> 1 << 21) | ((turn + shift) >> 1) % TURNS << 13 | scale << 1 | shift
        each.append(own)
    return np.concatenate(each)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(query_id, match_id, votes): of the votes of a part, the corners that agree, where they are enough."""
    held, at = [], None
    for batch in batches:
        for part, votes in zip(batch.column("part").to_pylist(), batch.column("c0").to_pylist(), strict=True):
            if held and part != at:
                yield _agreed(np.concatenate(held))
                held = []
            at = part
            held.append(_unflat(votes, _VOTE))
    if held:
        yield _agreed(np.concatenate(held))


def _agreed(rows: np.ndarray) -> pa.RecordBatch:
    rows = _grids(rows)
    rows = rows[np.lexsort((rows["corner"], rows["cell"], rows["match"], rows["query"]))]
    rows = rows[_runs(rows["query"], rows["match"], rows["cell"], rows["corner"])[0]]
    first, n = _runs(rows["query"], rows["match"], rows["cell"])
    first, n = first[n >= LEAST_VOTES], n[n >= LEAST_VOTES]
    rows = rows[first]
    begin, _ = _runs(rows["query"], rows["match"])
    votes = np.maximum.reduceat(n, begin) if len(begin) else n
    return pa.RecordBatch.from_arrays([pa.array(rows["query"][begin]), pa.array(rows["match"][begin]), pa.array(votes.astype(np.int64))], names=["query_id", "match_id", "votes"])


def _indexed(media: DataFrame) -> DataFrame:
    return media.where(F.col("id").isNotNull() & F.col("image").isNotNull()).select(F.col("id").cast("long").alias("id"), "image")


def _digests(some: DataFrame) -> DataFrame:
    return some.select("id", F.unhex(F.sha2("image", 256)).alias("digest"))


def _several(digests: DataFrame) -> DataFrame:
    """(digest, least, n_copies) of images that several rows have."""
    return digests.groupBy("digest").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n_copies")).where("n_copies > 1")


def search(media: DataFrame, queries: DataFrame) -> DataFrame:
    """media(id, image), queries(id, image) -> (query_id, match_id, n_copies, votes): images that a query is a copy of. Of equal images the smallest id stands for all."""
    some = _indexed(media)
    return _matches(some, _several(_digests(some)), queries)


def search_all(media: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, match_id, n_copies, votes, member_id): the rows of search(), and who stands behind them.

    Rows of search() have no member_id. Each match_id with n_copies > 1 has a row for each of its rows of media, with its id as member_id and neither
    query_id nor votes, so that the result grows with matches and rows and not with their product. A query matches every member_id of its match_id.
    Rows of one image are dealt to SALTS tasks.
    """
    some = _indexed(media)
    digests = settle(_digests(some), "digests")
    several = settle(_several(digests), "several")
    found = settle(_matches(some, several, queries), "matches")
    matched = found.where("n_copies > 1").select("match_id").distinct()
    chosen = several.join(matched, F.col("least") == F.col("match_id")).select("digest", "match_id", "n_copies", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = digests.select(F.col("id").alias("member_id"), "digest", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
    members = rows.join(chosen, ["digest", "salt"]).select(F.lit(None).cast("long").alias("query_id"), "match_id", "n_copies", F.lit(None).cast("long").alias("votes"), "member_id")
    return found.withColumn("member_id", F.lit(None).cast("long")).unionByName(members)


def _matches(some: DataFrame, several: DataFrame, queries: DataFrame) -> DataFrame:
    parts = 4 * int(some.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # equal images once: by digest, without sending the images along
    unique = some.withColumn("digest", F.unhex(F.sha2("image", 256))).join(several, "digest", "left").where("least is null or id = least")
    unique = unique.select("id", "image")
    both = _entries(unique, False, parts).unionByName(_entries(queries.select(F.col("id").cast("long").alias("id"), "image"), True, parts))
    votes = both.repartition(parts, "part").mapInArrow(tidy(lambda batches: _votes(batches, parts)), "part int, c0 binary")
    found = votes.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(tidy(_tally), "query_id long, match_id long, votes long")
    return found.join(several.select(F.col("least").alias("match_id"), "n_copies"), "match_id", "left").select("query_id", "match_id", F.coalesce("n_copies", F.lit(1)).alias("n_copies"), "votes")


CELL = 10


def rendered(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", edited: bool = False) -> DataFrame:
    """(id, image): each vector as an image of cells with its values as grey levels; edited: cropped, with other contrast and brightness, and noise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not v:
                    out.append(None)
                    continue
                v = np.array([x if x is not None else 0.0 for x in v], dtype=np.float32)
                side = int(np.ceil(np.sqrt(len(v))))
                grid = np.zeros(side * side, np.float32)
                grid[: len(v)] = v
                spread = max(float(grid.std()), 1e-9)
                x = np.kron(128 + 50 * grid.reshape(side, side) / spread, np.ones((CELL, CELL), np.float32)).clip(0, 255)
                if edited:
                    rng = np.random.default_rng(abs(i or 0))
                    h, w = x.shape
                    x = x[5 : h - 3, 3 : w - 5] * 0.8 + 20
                    x = x + rng.normal(0, 2, x.shape)
                out.append(encode(x))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(out, pa.binary())], names=["id", "image"])

    return vectors.select(id_col, vector_col).mapInArrow(tidy(run), "id long, image binary")


def find_edited(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Edited images of all vectors whose id is divisible by 20, looked for among the images of all vectors."""
    asked = vectors.where(F.col(id_col) % 20 == 0)
    return search_all(rendered(vectors, id_col, vector_col), rendered(asked, id_col, vector_col, edited=True))
