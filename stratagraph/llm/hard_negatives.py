"""Hard-negative mining by distributed radix selection.

Vectors become integers, a row's score is its inner product with an anchor. What is asked for are the first rows of *windows*: an anchor,
a range of scores, equal or different labels, and how many. A round counts, in each task, the rows of every window by buckets of the score (a digit of BITS bits of what is left of
the range) and adds the tasks' histograms; the bucket that holds the kth row is the range of the next round. Once a range is one score, the digits are those of the id, so a
group of ties of any size is cut in the same way. A window whose bucket leaves at most SPARE rows too many is done, and one last pass gathers the rows up to it. No pass emits scores of pairs
beyond that: a task's histogram leaves out buckets below its own kth row, which can't hold the kth row of all.

Anchors come in blocks of about ANCHORS, whose vectors and windows are all that the driver and a broadcast hold; each block is compared with all rows.

Edge cases: rows without an id take no part, as nothing can name them, nor do rows whose label or vector is null or that hold a null, NaN or infinite component. Components beyond
LIMIT units count as LIMIT. Vectors of different lengths: the shorter one counts as ending in zeros, and an empty one scores 0. Repeated rows each count: they are counted as one entry with a number of
copies, take as many ranks, and a repeated anchor's rows are repeated. Rows of one id with different vectors are different rows. Ids and labels are integers. No anchors, or empty tables: no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, settle, tidy

#: Units of a component, and the number of units beyond which components are cut off: scores times 100 stay below 2**63 up to 900 dimensions.
UNITS, LIMIT = 256, 1 << 23
#: Expected number of anchors in a block.
ANCHORS = 2048
#: Bits of a digit.
BITS = 8
#: Rows beyond the wanted number that a window may gather.
SPARE = 64
#: Positives of an anchor, negatives of an anchor and positive, and the shares of the positive's score (in hundredths) that negatives lie between.
POSITIVES, NEGATIVES, LEAST, MOST = 5, 10, 30, 90
_BUCKETS = 1 << BITS
OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def finite(vector: str) -> Column:
    """Whether the vector is there and none of its components is null, NaN or infinite."""
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False))), F.lit(False))


def units(vector: str, scale: int, limit: int) -> Column:
    """floor(scale * x) of each component, as integers of at most limit in size."""
    return F.transform(vector, lambda x: F.floor(F.greatest(F.lit(-float(limit)), F.least(F.lit(float(limit)), F.lit(float(scale)) * x.cast("double")))).cast("int"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The integer vectors of a batch as rows of equal width, zeros behind the shorter ones."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


@dataclass
class Windows:
    """What is asked of a block's anchors, and the range (distance below the highest score, then offset of the id) that is left for the last row of each."""

    anchor: np.ndarray
    high: np.ndarray
    same: bool
    limit: int
    d0: np.ndarray
    d1: np.ndarray
    i0: np.ndarray  # offsets of ids, in uint64
    i1: np.ndarray
    need: np.ndarray  # rows still wanted from the range
    open: np.ndarray  # whether another digit is needed
    any: np.ndarray  # whether there may be a row

    @classmethod
    def between(cls, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, limit: int, ids: int) -> Windows:
        n = len(anchor)
        some = high >= low
        return cls(anchor, high, same, limit, np.zeros(n, np.int64), high - low, np.zeros(n, np.uint64), np.full(n, ids, np.uint64), np.full(n, limit, np.int64), some, some.copy())

    def by_id(self) -> np.ndarray:
        return self.d0 == self.d1

    def shift(self) -> np.ndarray:
        """Bits to drop from an offset within the range, so that BITS are left."""
        size = np.where(self.by_id(), self.i1 - self.i0, (self.d1 - self.d0).astype(np.uint64))
        return np.array([max(0, int(x).bit_length() - BITS) for x in size], np.uint64)

    def narrow(self, found: pa.Table) -> None:
        """Takes the buckets that hold each open window's last row: window, bucket, before (rows of the range in front of it), n (rows in it)."""
        w, bucket, before, n = (found.column(c).to_numpy().astype(np.int64) for c in ("window", "bucket", "before", "n"))
        shift, by_id = self.shift(), self.by_id()
        seen = np.zeros(len(self.anchor), bool)
        seen[w] = True
        # a window without any row in its range has all it can get
        self.any &= seen | ~self.open
        self.open &= seen
        start = bucket.astype(np.uint64) << shift[w]
        end = start + ((np.uint64(1) << shift[w]) - np.uint64(1))
        score, ident = w[~by_id[w]], w[by_id[w]]
        first, last = start[~by_id[w]].astype(np.int64), end[~by_id[w]].astype(np.int64)
        self.d1[score] = np.minimum(self.d0[score] + last, self.d1[score])
        self.d0[score] += first
        first, last = start[by_id[w]], end[by_id[w]]
        self.i1[ident] = np.minimum(self.i0[ident] + last, self.i1[ident])
        self.i0[ident] += first
        self.need[w] -= before
        point = self.by_id()[w] & (self.i0[w] == self.i1[w])
        self.open[w[(n - self.need[w] <= SPARE) | point]] = False


@dataclass
class Block:
    """Anchors of one block, in arrays that go to all tasks."""

    ids: np.ndarray
    labels: np.ndarray
    copies: np.ndarray
    vectors: np.ndarray
    floats: bool
    least_id: int

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Exact inner products: doubles hold them where no sum can pass 2**53, integers elsewhere."""
        if self.floats:
            return (rows.astype(np.float64) @ self.vectors.astype(np.float64).T).astype(np.int64)
        return rows @ self.vectors.T

    def own(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> list[tuple[int, int]]:
        """Where a row is the anchor itself."""
        at = np.flatnonzero(np.isin(ids, self.ids))
        out = []
        for r in at.tolist():
            for a in np.flatnonzero(self.ids == ids[r]).tolist():
                if self.labels[a] == labels[r] and np.array_equal(self.vectors[a], rows[r]):
                    out.append((r, a))
        return out


def _slots(anchor: np.ndarray) -> list[np.ndarray]:
    """Windows in groups that hold each anchor once at most."""
    order = np.argsort(anchor, kind="stable")
    sorted_ = anchor[order]
    rank = np.arange(len(order)) - np.searchsorted(sorted_, sorted_, side="left")
    return [order[rank == k] for k in range(int(rank.max()) + 1)] if len(order) else []


def _read(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids, labels, copies = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("id", "label", "n"))
    return ids, labels, copies, matrix(batch.column("q"), width)


def _cells(block: Block, windows: Windows, slots: list[np.ndarray], batch: pa.RecordBatch, top: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """For each group of windows: window, row, distance, offset of the id and copies of the cells whose distance is between 0 and top."""
    ids, labels, copies, rows = _read(batch, block.vectors.shape[1])
    scores = block.scores(rows)
    allowed = (labels[:, None] == block.labels[None, :]) == windows.same
    weight = {}
    if windows.same:
        for r, a in block.own(ids, labels, rows):
            if copies[r] == 1:
                allowed[r, a] = False
            else:
                weight[r, a] = copies[r] - 1
    offset = ids.astype(np.uint64) - np.uint64(block.least_id % (1 << 64))
    for w in slots:
        a = windows.anchor[w]
        d = windows.high[w][None, :] - scores[:, a]
        r, c = np.nonzero((d >= 0) & (d <= top[w][None, :]) & allowed[:, a])
        n = copies[r]
        if weight:
            n = n.copy()
            for k in np.flatnonzero(np.isin(r, [x for x, _ in weight])).tolist():
                n[k] = weight.get((int(r[k]), int(a[c[k]])), n[k])
        yield w[c], r, d[r, c], offset[r], n, ids


def _histogram(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, windows = shared.value
        active = np.flatnonzero(windows.open)
        place = np.full(len(windows.anchor), -1)
        place[active] = np.arange(len(active))
        slots = [active[s] for s in _slots(windows.anchor[active])]
        total = np.zeros((len(active), _BUCKETS), np.int64)
        flat = total.reshape(-1)
        shift, by_id, top = windows.shift(), windows.by_id(), windows.d1.copy()
        for k, batch in enumerate(batches):
            for w, _, d, i, n, _ in _cells(block, windows, slots, batch, top):
                inside = (d >= windows.d0[w]) & (~by_id[w] | ((i >= windows.i0[w]) & (i <= windows.i1[w])))
                w, d, i, n = w[inside], d[inside], i[inside], n[inside]
                digit = np.where(by_id[w], i - windows.i0[w], (d - windows.d0[w]).astype(np.uint64)) >> shift[w]
                np.add.at(flat, place[w] * _BUCKETS + digit.astype(np.int64), n)
            if k & (k + 1) == 0 and len(active):  # after 1, 2, 4, ... batches: below a task's own kth row nothing counts
                reached = total.cumsum(1) >= windows.need[active][:, None]
                bucket = np.where(reached.any(1), reached.argmax(1), _BUCKETS - 1).astype(np.uint64)
                end = windows.d0[active] + (((bucket + np.uint64(1)) << shift[active]) - np.uint64(1)).astype(np.int64)
                top[active] = np.where(by_id[active], windows.d1[active], np.minimum(windows.d1[active], end))
        if len(active):
            before = total.cumsum(1) - total
            w, b = np.nonzero((total > 0) & (before < windows.need[active][:, None]))
            if len(w):
                at = active[w]
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(windows.need[at]), pa.array(total[w, b])], names=["window", "bucket", "need", "n"])

    return tidy(run)


def _gather(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, windows = shared.value
        active = np.flatnonzero(windows.any)
        slots = [active[s] for s in _slots(windows.anchor[active])]
        by_id = windows.by_id()
        for batch in batches:
            for w, r, d, i, n, ids in _cells(block, windows, slots, batch, windows.d1):
                keep = (d < windows.d0[w]) | ~by_id[w] | (i <= windows.i1[w])
                w, r, d, n = w[keep], r[keep], d[keep], n[keep]
                if len(w):
                    yield pa.RecordBatch.from_arrays([pa.array(w.astype(np.int32)), pa.array(ids[r]), pa.array(windows.high[w] - d), pa.array(n)], names=["window", "id", "score", "n"])

    return tidy(run)


def _select(entries: DataFrame, block: Block, windows: Windows) -> DataFrame:
    """The first rows of each window: window, id, score, before (how many rank before it), n (how many of its copies are among the first)."""
    sc = entries.sparkSession.sparkContext
    while windows.open.any():
        shared = sc.broadcast((block, windows))
        counted = entries.mapInArrow(_histogram(shared), "window int, bucket int, need long, n long").groupBy("window", "need", "bucket").agg(F.sum("n").alias("n"))
        running = counted.withColumn("before", F.sum("n").over(Window.partitionBy("window").orderBy("bucket")) - F.col("n")).where("before < need")
        found = running.groupBy("window").agg(F.max_by(F.struct("bucket", "before", "n"), "bucket").alias("at")).select("window", "at.*").toArrow()
        shared.unpersist()
        windows.narrow(found)
    rows = entries.mapInArrow(_gather(sc.broadcast((block, windows))), "window int, id long, score long, n long").groupBy("window", "id", "score").agg(F.sum("n").alias("n"))
    ranked = rows.withColumn("before", F.sum("n").over(Window.partitionBy("window").orderBy(F.desc("score"), "id")) - F.col("n"))
    return ranked.where(F.col("before") < windows.limit).withColumn("n", F.least("n", F.lit(windows.limit) - F.col("before")))


def _block_of(rows: pa.Table, width: int, floats: bool, least_id: int) -> Block:
    column = lambda c: rows.column(c).to_numpy().astype(np.int64)
    return Block(column("id"), column("label"), column("n"), matrix(rows.column("q").combine_chunks(), width), floats, least_id)


def _of_block(entries: DataFrame, block: Block, most: int, ids: int, positives: int, negatives: int) -> DataFrame | None:
    spark = entries.sparkSession
    n = len(block.ids)
    wanted = Windows.between(np.arange(n), np.full(n, -most), np.full(n, most), True, positives, ids)
    first = _select(entries, block, wanted).toArrow()  # positives rows of each anchor at most
    at, score, ident, copies = (first.column(c).to_numpy().astype(np.int64) for c in ("window", "score", "id", "n"))
    if not len(at):
        return None
    pairs, of = np.unique(np.stack([at, score], axis=1), axis=0, return_inverse=True)
    low, high = -((-LEAST * pairs[:, 1]) // 100), (MOST * pairs[:, 1]) // 100
    chosen = _select(entries, block, Windows.between(pairs[:, 0], low, high, False, negatives, ids))
    facts = pa.table({"window": of.reshape(-1).astype(np.int32), "anchor_id": block.ids[at], "positive_id": ident, "positive_score": score, "copies": copies * block.copies[at]})
    # positives * ANCHORS rows at most
    joined = chosen.join(F.broadcast(spark.createDataFrame(facts)), "window")
    return (
        joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
        .withColumn("rank", F.explode(F.sequence(F.col("before") + 1, F.col("before") + F.col("n"))))
        .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    )


def mine(rows: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """For each row that anchor holds for and each of its first positives of the same label: the first negatives of other labels whose scores are between LEAST and MOST hundredths of the positive's.

    Higher scores come first, ties by smaller id.
    """
    spark = rows.sparkSession
    label = F.col(label) if isinstance(label, str) else label
    flat = rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), units(vector_col, UNITS, LIMIT).alias("q"), F.coalesce(anchor, F.lit(False)).alias("anchor"), finite(vector_col).alias("usable"))
    usable = flat.where("usable AND id IS NOT NULL AND label IS NOT NULL")
    width = max(usable.agg(F.max(F.size("q"))).first()[0] or 0, 1)
    padded = usable.withColumn("q", F.concat("q", F.array_repeat(F.lit(0), F.lit(width) - F.size("q"))))
    entries = settle(padded.groupBy("id", "label", "q", "anchor").agg(F.count("*").alias("n")), "entries")
    norm = F.aggregate("q", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x)
    most, least_id, last_id, anchors = entries.agg(F.max(norm), F.min("id"), F.max("id"), F.count(F.when(F.col("anchor"), 1))).first()
    if not anchors:
        return spark.createDataFrame([], OUT)
    blocks = -(-anchors // ANCHORS)
    numbered = entries.where("anchor").withColumn("block", F.pmod(F.xxhash64("id", "label", "q"), F.lit(blocks)))
    rows_of = entries.select("id", "label", "q", "n")
    path = scratch(spark, "negatives")
    spark.createDataFrame([], OUT).write.parquet(path)
    for k in range(blocks):
        block = _block_of(numbered.where(F.col("block") == k).select("id", "label", "q", "n").toArrow(), width, most < 1 << 53, least_id)
        out = _of_block(rows_of, block, most, last_id - least_id, positives, negatives) if len(block.ids) else None
        if out is not None:
            out.write.mode("append").parquet(path)
    return spark.read.schema(OUT).parquet(path)


ORACLE_SQL = f"""
WITH kept AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({UNITS} * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM kept a JOIN kept b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score
  FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}
)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND {LEAST} * positive_score <= 100 * score AND 100 * score <= {MOST} * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= {NEGATIVES}
"""
