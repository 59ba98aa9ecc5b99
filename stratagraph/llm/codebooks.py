"""Vector code compression: product codebooks of integers, learned over all vectors.

Components become integers and vectors are cut into PARTS equal parts. Each part position has a codebook, which begins as that part of the first ENTRIES vectors by id. In each of ROUNDS rounds the codebooks
go out as a broadcast; tasks find each part's nearest entry batch by batch, squared distances being |x|^2 - 2xc + |c|^2 by products of int64 matrices, the first of equal ones; what a task adds up for each entry is summed
by a grouped shuffle, and each entry becomes the floor of its parts' mean. A last pass assigns the parts again. Driver and broadcast hold the codebooks alone (ENTRIES times the length of a vector).

Edge cases: vectors that are null or hold null, NaN or infinite components are dropped. Rows without an id are encoded, but begin no entry unless there are fewer than ENTRIES others; equal ids begin entries
in the order of their vectors. Fewer vectors than ENTRIES: as many entries. Unused entries stay. Lengths that PARTS doesn't divide, and shorter vectors: zeros are put behind them, a whole vector of zeros for an empty one. Components beyond LIMIT units count as LIMIT.
Repeated rows give repeated rows. An empty table, or one without usable vectors: no rows. Ids and labels may be of any type that can be sorted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, tidy
from .hard_negatives import finite, matrix, units

#: Units of a component, and how many of them a component has at most: squared distances stay below 2**63 up to 30000 components a part.
UNITS, LIMIT = 1024, 1 << 23
PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Labels up to which their sums are broadcast (a few MB); more are joined by key, in SALTS pieces each.
LABELS, SALTS = 100_000, 16


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each row's nearest entry, the first of equal ones, and the squared distance."""
    d = (book * book).sum(1)[None, :] - 2 * (x @ book.T)
    best = d.argmin(1)
    return best, d[np.arange(len(x)), best] + (x * x).sum(1)


def first_books(kept: DataFrame, width: int, parts: int, entries: int) -> np.ndarray:
    """parts x entries x components: the parts of the first vectors by id."""
    rows = kept.orderBy(F.asc_nulls_last("id"), "q").limit(entries).select("q").toArrow()
    return matrix(rows.column("q").combine_chunks(), width).reshape(-1, parts, width // parts).transpose(1, 0, 2).copy()


def improve(kept: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: all parts are assigned to the entries of books, and each used entry becomes the floor of its parts' mean."""
    parts, entries, size = books.shape
    shared = kept.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        sums, counts = np.zeros(known.shape, np.int64), np.zeros(known.shape[:2], np.int64)
        for batch in batches:
            x = matrix(batch.column("q"), parts * size)
            for p in range(parts):
                mine = x[:, p * size : (p + 1) * size]
                best, _ = nearest(mine, known[p])
                np.add.at(sums[p], best, mine)
                counts[p] += np.bincount(best, minlength=entries)
        p, e = np.nonzero(counts)
        if len(p):
            added = pa.ListArray.from_arrays(np.arange(len(p) + 1, dtype=np.int32) * size, sums[p, e].reshape(-1))
            yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(counts[p, e]), added], names=["part", "entry", "n", "s"])

    each = kept.select("q").mapInArrow(tidy(run), "part int, entry int, n long, s array<long>").select("part", "entry", "n", F.posexplode("s").alias("place", "s"))
    found = each.groupBy("part", "entry", "place").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).toArrow()
    shared.unpersist()
    out = books.copy()
    part, entry, place, s, n = (found.column(c).to_numpy() for c in ("part", "entry", "place", "s", "n"))
    out[part, entry, place] = s // n
    return out


def encode(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """id, label, code and error of each row."""
    parts, _, size = books.shape
    shared = kept.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            x = matrix(batch.column("q"), parts * size)
            found = [nearest(x[:, p * size : (p + 1) * size], known[p]) for p in range(parts)]
            codes = np.stack([best for best, _ in found], axis=1).astype(np.uint8)
            error = np.sum([d for _, d in found], axis=0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error)], names=["id", "label", "code", "error"])

    kind = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    return kept.select("id", "label", "q").mapInArrow(tidy(run), f"id {kind['id']}, label {kind['label']}, code string, error long")


def with_label_errors(coded: DataFrame, labels: int = LABELS) -> DataFrame:
    """Adds the sum of the errors of each row's label; rows without a label are one group. Labels are joined by key where they are many, a hot one's rows in SALTS pieces."""
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "its_label")
    same = F.col("label").eqNullSafe(F.col("its_label"))
    sums = settle(sums, "label-errors")
    if sums.count() <= labels:
        return coded.join(F.broadcast(sums), same).drop("its_label")
    salted = coded.withColumn("salt", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)).cast("int"))
    each = sums.withColumn("its_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(each, same & (F.col("salt") == F.col("its_salt"))).drop("its_label", "salt", "its_salt")


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, labels: int = LABELS) -> DataFrame:
    """Per usable row: id, code (two hex digits a part), error, label_error, codebooks_sha256."""
    if entries > 256:
        raise ValueError("an entry's index is one byte")
    flat = rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), units(vector_col, UNITS, LIMIT).alias("q"), finite(vector_col).alias("usable"))
    kept = settle(flat.where("usable").drop("usable"), "vectors")
    width = kept.agg(F.max(F.size("q"))).first()[0]
    if width is None:
        books = np.zeros((parts, 0, 1), np.int64)
        return kept.select(F.col("id").alias(id_col), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit(digest(books)).alias("codebooks_sha256"))
    books = first_books(kept, -(-max(width, 1) // parts) * parts, parts, entries)
    for _ in range(rounds):
        books = improve(kept, books)
    coded = with_label_errors(settle(encode(kept, books), "codes"), labels)
    return coded.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    """All rounds as common table expressions."""
    distance = "list_dot_product(x, x) - 2 * list_dot_product(x, c) + list_dot_product(c, c)"
    steps = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor({UNITS} * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"parts AS MATERIALIZED (SELECT r, part, q[part * len(q) // {PARTS} + 1 : (part + 1) * len(q) // {PARTS}] AS x FROM kept, range({PARTS}) AS t(part))",
        f"first_ones AS (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, q) - 1 AS entry FROM kept QUALIFY entry < {ENTRIES})",
        "book0 AS MATERIALIZED (SELECT part, entry, x AS c FROM first_ones JOIN parts USING (r))",
    ]
    for k in range(ROUNDS + 1):
        # one number orders by distance, then by entry; both stay exact in 128 bits
        steps.append(f"near{k} AS MATERIALIZED (SELECT r, part, any_value(x) AS x, min(({distance})::HUGEINT * {ENTRIES} + entry) AS best FROM parts JOIN book{k} USING (part) GROUP BY r, part)")
        if k < ROUNDS:
            steps.append(f"each{k} AS (SELECT part, (best % {ENTRIES})::BIGINT AS entry, unnest(x)::HUGEINT AS v, generate_subscripts(x, 1) AS place FROM near{k})")
            steps.append(f"sums{k} AS (SELECT part, entry, place, sum(v) AS s, count(*)::HUGEINT AS n FROM each{k} GROUP BY ALL)")
            steps.append(f"means{k} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY place)::DOUBLE[] AS c FROM sums{k} GROUP BY ALL)")
            steps.append(f"book{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN means{k} m USING (part, entry))")
    steps.append(f"codes AS (SELECT r, string_agg(lower(printf('%02x', (best % {ENTRIES})::BIGINT)), '' ORDER BY part) AS code, sum(best // {ENTRIES})::BIGINT AS error FROM near{ROUNDS} GROUP BY r)")
    steps.append(f"numbers AS (SELECT part, entry, unnest(c)::BIGINT AS v, generate_subscripts(c, 1) AS place FROM book{ROUNDS})")
    steps.append("hashed AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, place)) AS codebooks_sha256 FROM numbers)")
    last = "SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN codes USING (r), hashed"
    return "WITH " + ",\n".join(steps) + "\n" + last


ORACLE_SQL = _oracle()
