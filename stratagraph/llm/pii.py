"""Personal data, and terms that give it away: information-theoretic sanitisation.

Patterns find the base spans: e-mail addresses, IP addresses, card numbers, telephone numbers. Each of their values is a protected entity c. A term t of the corpus discloses c as far as its pointwise mutual
information with c comes near c's whole information:

    PMI(c; t) = log2(n(c, t) N / (n(c) n(t))),   IC(c) = log2(N / n(c)),   t discloses c if PMI(c; t) >= IC(c) - BITS

where N, n(c) and n(t) count documents (all of them, with c, with t), and n(c, t) those that have t among the NEAR words on either side of c. N and n(c) cancel out: what is tested is n(c, t) >= n(t) / 2**BITS. Counts of
documents weigh copies alike on both sides; so that copies don't make evidence, t must stand near c in CONTEXTS different surroundings.

A term that discloses is *generalised* to the first half of its letters, if all words that begin so, taken as one term, don't disclose the same entities, and *removed* if they do. It is so wherever it
stands, also without the entity: there it would give it away.

Statistics are over all rows and whole texts. Words are runs of bytes without blanks and ASCII marks, A-Z in lower case, told apart by 64 bits of a hash. Passes after the first look words up in a bitmap of fixed size, and what it lets
through is joined exactly, so nothing depends on how many terms there are.

Edge cases: null texts are empty; empty texts have no span. Repeated rows give repeated rows, rows without an id are rows like others. Words within a base span are never terms near it, but count in n(t).
Equal texts have equal spans. An empty table gives no rows. Columns other than the id's and text's are left out of the report, and kept by sanitise().
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from .common import settle, slices, text_or_empty, tidy
from .textcore import _BASE, _LOWER, _MARKS, mix

KINDS = ("email", "ip", "card", "phone")
#: Words on either side of an entity that count as near it.
NEAR = 8
#: Bits by which a term may fall short of an entity's information and still disclose it.
BITS = 0.5
#: Different surroundings of an entity in which a term has to stand.
CONTEXTS = 3
#: Bits of the bitmap that words are looked up in.
MAP_BITS = 1 << 24
#: Pieces that a key's rows are dealt to in joins.
SALTS = 16

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# nothing begins within a run of digits that an address could not begin with, so a run is tried once
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            last = found.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) << (k & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """Kind, start, end (code points) and value of the base spans, by kind and start."""
    out = [(0, s, e, text[s:e].lower()) for s, e in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span(), m[0]))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NO_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append((2, *m.span(), digits))
    for m in _PHONE.finditer(text):
        digits = _NO_DIGIT.sub("", m[0])
        if 8 <= len(digits) <= 15:
            out.append((3, *m.span(), digits))
    return out


class Words:
    """The words of a slice of texts: hashes of the whole and of the first half, the text's index, and places in code points on request."""

    def __init__(self, texts: list[str]):
        parts = [t.encode("utf-8", "surrogatepass") for t in texts]
        self.data = data = _LOWER[np.frombuffer(b"\n" + b"\n".join(parts) + b"\n\n", dtype=np.uint8)]
        blank = _MARKS[data]
        edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        self.start, self.end = edge[0::2], edge[1::2]
        size = self.end - self.start
        self.text_start = np.cumsum([1, *(len(p) + 1 for p in parts)])[:-1]
        self.doc = np.searchsorted(self.text_start, self.start, side="right") - 1
        half = (size + 1) // 2
        for _ in range(3):  # whole code points
            half += ((data[self.start + half] & 0xC0) == 0x80) & (half < size)
        self.half = half
        if not len(size):
            self.term = self.general = np.zeros(0, np.uint64)
            return
        letters = np.flatnonzero(~blank)
        first = np.cumsum(size) - size
        power = np.multiply.accumulate(np.full(int(size.max()) + 1, _BASE, np.uint64))
        sums = np.zeros(len(letters) + 1, np.uint64)
        np.cumsum((data[letters].astype(np.uint64) + np.uint64(1)) * power[np.arange(len(letters)) - np.repeat(first, size)], out=sums[1:])
        named = lambda n, kind: mix((sums[first + n] - sums[first]) ^ mix(n.astype(np.uint64) * np.uint64(2) + np.uint64(kind)))
        self.term, self.general = named(size, 0), named(half, 1)

    def places(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and end of the first half of each word, in code points of its text."""
        chars = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum((self.data & 0xC0) != 0x80, out=chars[1:])
        base = chars[self.text_start][self.doc]
        return chars[self.start] - base, chars[self.end] - base, chars[self.start + self.half] - base


def _outside(start: np.ndarray, end: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Whether each word (in order) lies outside all spans."""
    out = np.ones(len(start), bool)
    for s, e in spans:
        out[np.searchsorted(end, s, side="right") : np.searchsorted(start, e, side="left")] = False
    return out


def _entity(kind: int, value: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{kind}:{value}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def _near(spans: list[tuple[int, int, int, str]], start: np.ndarray, end: np.ndarray, term: np.ndarray, general: np.ndarray) -> dict[tuple[int, int], tuple[int | None, int]]:
    """(entity, term): (its general term, or None for that itself; the surroundings) of one text."""
    free = np.flatnonzero(_outside(start, end, [(s, e) for _, s, e, _ in spans]))
    begin, term, general = start[free], term[free], general[free]
    out: dict[tuple[int, int], tuple[int | None, int]] = {}
    for kind, s, _, value in spans:
        c = _entity(kind, value)
        at = int(np.searchsorted(begin, s))
        window = slice(max(0, at - NEAR), at + NEAR)
        words = term[window]
        around = int.from_bytes(hashlib.blake2b(words.tobytes(), digest_size=8).digest(), "little")
        for t, g in zip(words.tolist(), general[window].tolist(), strict=True):
            for key, of in (((c, t), g), ((c, g), None)):
                if key not in out or around < out[key][1]:
                    out[key] = (of, around)
    return out


def _signed(values: list[int | None]) -> pa.Array:
    return pa.array([None if v is None else v - (1 << 64) if v >> 63 else v for v in values], pa.int64())


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _joined(spans: list[tuple[int, int, int, str]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e, _ in spans)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, salt (which deals equal texts out), digest of the text, numbers of base spans by kind, base (the spans), and what stands near them: entity, term, general, around (lists of equal length)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            spans = [base_spans(t) for t in texts]
            near: list[dict] = [{} for _ in texts]
            if any(spans):
                words = Words(texts)
                start, end, _ = words.places()
                bounds = np.searchsorted(words.doc, np.arange(len(texts) + 1))
                for i, found in enumerate(spans):
                    if found:
                        w = slice(bounds[i], bounds[i + 1])
                        near[i] = _near(found, start[w], end[w], words.term[w], words.general[w])
            offsets = np.cumsum([0, *map(len, near)]).astype(np.int32)
            lists = [
                _signed([c for n in near for c, _ in n]),
                _signed([t for n in near for _, t in n]),
                _signed([g for n in near for g, _ in n.values()]),
                _signed([a for n in near for _, a in n.values()]),
            ]
            counts = [pa.array([sum(k == x[0] for x in s) for s in spans], pa.int64()) for k in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), _dealt(batch), pa.array([_digest(t) for t in texts], pa.binary()), *counts, pa.array([_joined(s) for s in spans], pa.string()), *(pa.ListArray.from_arrays(offsets, x) for x in lists)],
                names=["id", "salt", "digest", *(f"n_{k}" for k in KINDS), "base", "entity", "term", "general", "around"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(tidy(run), f"id {kind}, salt int, digest binary, {', '.join(f'n_{k} long' for k in KINDS)}, base string, entity array<long>, term array<long>, general array<long>, around array<long>")


def bitmap(terms: DataFrame) -> np.ndarray:
    """The bits of all terms: at most MAP_BITS / 64 rows come to the driver."""
    place = F.pmod("term", F.lit(MAP_BITS))
    words = terms.select((place / 64).cast("long").alias("word"), F.expr(f"shiftleft(1L, cast(pmod(term, {MAP_BITS}) % 64 as int))").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(MAP_BITS // 64, np.int64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return out.view(np.uint64)


def _inside(bits: np.ndarray, terms: np.ndarray) -> np.ndarray:
    place = terms % np.uint64(MAP_BITS)  # a power of two: the same as pmod of the signed value
    return (bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def documents_with(docs: DataFrame, terms: DataFrame, text_col: str = "text") -> DataFrame:
    """term, n: in how many rows of docs each term, or a word that begins as a general term says, occurs; also of terms that merely share a bit."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, held, size = shared.value, [], 0

        def summed() -> pa.RecordBatch:
            term, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(n.astype(np.int64))], names=["term", "n"])

        for _, texts in slices(batches, "text"):
            words = Words(texts)
            for hashes in (words.term, words.general):
                pass_ = _inside(bits, hashes)
                doc, hashes = words.doc[pass_], hashes[pass_]
                order = np.lexsort((doc, hashes))
                doc, hashes = doc[order], hashes[order]
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
                held.append(hashes[new])
                size += int(new.sum())
            if size > 2_000_000:
                yield summed()
                held, size = [], 0
        if size:
            yield summed()

    return docs.select(F.col(text_col).alias("text")).mapInArrow(tidy(run), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def disclosing(docs: DataFrame, found: DataFrame, text_col: str = "text", bits: float = BITS, contexts: int = CONTEXTS) -> DataFrame:
    """term, removed: the terms that disclose an entity, and whether their general term does so too."""
    near = found.select(F.explode(F.arrays_zip("entity", "term", "general", "around")).alias("x")).select("x.*")
    each = near.groupBy("entity", "term", "general", "around").agg(F.count("*").alias("n"))
    both = each.groupBy("entity", "term", "general").agg(F.sum("n").alias("n_near"), F.count("*").alias("contexts")).where(F.col("contexts") >= contexts)
    both = settle(both, "near-terms")
    held = documents_with(docs, both.select("term").distinct(), text_col)
    judged = both.join(held, "term").where(F.col("n_near") >= F.col("n") * 2.0**-bits)
    judged = settle(judged.select("entity", "term", "general"), "disclosing")
    wide = judged.where("general IS NULL").select("entity", F.col("term").alias("general"), F.lit(True).alias("wide"))
    terms = judged.where("general IS NOT NULL").join(wide, ["entity", "general"], "left")
    return terms.groupBy("term").agg(F.max(F.coalesce("wide", F.lit(False))).alias("removed"))


def _dealt(batch: pa.RecordBatch) -> pa.Array:
    return pa.array(np.arange(batch.num_rows, dtype=np.int32) % SALTS)


def _salted(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """An equi-join with a unique right side; left's column salt (0 to SALTS - 1) deals a key's rows to SALTS tasks."""
    each = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(each, [key, "salt"], how).drop("salt")


def term_spans(docs: DataFrame, terms: DataFrame, text_col: str = "text") -> DataFrame:
    """digest, terms (array of start, end, cut, removed): where disclosing terms stand in each different text that has any, outside of base spans; cut is where the first half ends."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for _, texts in slices(batches, "text"):
            words = Words(texts)
            at = np.flatnonzero(_inside(bits, words.term))
            if not len(at):
                continue
            start, end, cut = (x[at] for x in words.places())
            doc = words.doc[at]
            keep = np.ones(len(at), bool)
            digests = {}
            for i in np.unique(doc).tolist():
                w = slice(np.searchsorted(doc, i), np.searchsorted(doc, i, side="right"))
                digests[i] = _digest(texts[i])
                keep[w] = _outside(start[w], end[w], [(s, e) for _, s, e, _ in base_spans(texts[i])])
            doc = doc[keep]
            columns = [pa.array([digests[i] for i in doc.tolist()], pa.binary()), pa.array(words.term[at][keep].view(np.int64)), *(pa.array(x[keep].astype(np.int32)) for x in (start, end, cut))]
            yield pa.RecordBatch.from_arrays(columns, names=["digest", "term", "start", "end", "cut"])

    hits = docs.select(F.col(text_col).alias("text")).mapInArrow(tidy(run), "digest binary, term long, start int, end int, cut int").distinct()
    known = _salted(hits.withColumn("salt", F.pmod(F.xxhash64("digest", "start"), F.lit(SALTS)).cast("int")), terms, "term")
    return known.groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("start", "end", "cut", "removed"))).alias("terms"))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, digest of the text, numbers of base spans, base (their list), terms (array of start, end, cut, removed; null if there is none)."""
    found = settle(find(docs, id_col, text_col), "base-spans")
    terms = settle(disclosing(docs, found, text_col), "terms")
    placed = term_spans(docs, terms, text_col)
    return _salted(found.drop("entity", "term", "general", "around"), placed, "digest", "left")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, numbers of base spans, base_sha256, spans (base ones, then generalised and removed terms), n_generalised, n_removed."""
    rows = spans(docs, id_col, text_col)

    def listed(kind: str, removed: bool) -> Column:
        mine = F.filter("terms", lambda t: t["removed"] == F.lit(removed))
        return F.transform(mine, lambda t: F.concat(F.lit(f"{kind}:"), t["start"].cast("string"), F.lit(":"), t["end"].cast("string")))

    kept, gone = listed("generalised", False), listed("removed", True)
    parts = F.concat(F.when(F.col("base") == "", F.array().cast("array<string>")).otherwise(F.array("base")), F.coalesce(kept, F.array().cast("array<string>")), F.coalesce(gone, F.array().cast("array<string>")))
    return rows.select(
        F.col("id").alias(id_col),
        *(f"n_{k}" for k in KINDS),
        F.sha2(F.col("base"), 256).alias("base_sha256"),
        F.concat_ws(",", parts).alias("spans"),
        F.greatest(F.size(F.coalesce(kept, F.array().cast("array<string>"))), F.lit(0)).cast("long").alias("n_generalised"),
        F.greatest(F.size(F.coalesce(gone, F.array().cast("array<string>"))), F.lit(0)).cast("long").alias("n_removed"),
    )


def cleaned(text: str, terms: list[dict]) -> str:
    """The text with its base spans and terms replaced; of overlapping spans the first one's name stands for all."""
    marks = [(s, e, f"[{KINDS[k].upper()}]") for k, s, e, _ in base_spans(text)]
    marks += [(t["start"], t["end"], "[REMOVED]" if t["removed"] else text[t["start"] : t["cut"]] + "*") for t in terms]
    out, at, covered = [], 0, -1
    for s, e, name in sorted(marks):
        if s >= covered:
            out += [text[at:s], name]
        at = covered = max(e, covered)
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with what the base spans and disclosing terms say taken out of the texts; null texts stay null."""
    name = "sanitised terms of a text"
    found = settle(find(docs.select(F.lit(0).alias("id"), text_col), "id", text_col), "base-spans")
    placed = term_spans(docs, settle(disclosing(docs, found, text_col), "terms"), text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(iter([batch]), text_col):
                known = part.column(text_col).is_null().to_pylist()
                new = [None if null else cleaned(t, terms or []) for t, terms, null in zip(texts, part.column(name).to_pylist(), known, strict=True)]
                at = part.schema.get_field_index(text_col)
                yield part.set_column(at, part.schema.field(at), pa.array(new, part.schema.field(at).type)).drop_columns([name])

    return _with_digest(docs, text_col, placed.select(F.col("digest").alias("digest of a text"), F.col("terms").alias(name))).mapInArrow(tidy(run), docs.schema)


def _with_digest(docs: DataFrame, text_col: str, placed: DataFrame) -> DataFrame:
    """docs joined with the spans of their texts."""
    name = "digest of a text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = [_digest(t) for t in text_or_empty(batch.column(text_col))]
            yield batch.append_column(name, pa.array(digests, pa.binary())).append_column("salt", _dealt(batch))

    tagged = docs.mapInArrow(tidy(run), StructType([*docs.schema.fields, StructField(name, BinaryType()), StructField("salt", IntegerType())]))
    return _salted(tagged, placed, name, "left").drop(name)
