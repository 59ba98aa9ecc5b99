"""BPE encoding by content-defined chunk reuse.

Texts are cut where a rolling hash over 32 bytes says so, so that passages which
documents share are cut alike. The inside of a chunk (from its first to its last
blank) is encoded once and kept; what lies around a cut is encoded again together
with the words on both sides of it, until these come out as they did before. If
they don't, the range is widened to the neighbouring chunks, and to the text at last.

Edge cases: null and empty texts have no tokens, and decode to ''. Texts without a blank are
encoded whole. Repeated rows give repeated rows. Extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import per_slice

#: Chunks are of 2^AVERAGE_BITS bytes on average, and of at least and at most so many.
AVERAGE_BITS, LEAST, MOST = 11, 256, 16384
#: What a task keeps: characters of chunks, beyond which it starts anew, and words, twice as many at most.
CHUNK_CHARS, WORDS, WORD_CHARS = 12_000_000, 400_000, 32
BLANKS = re.compile("[ \n]")
_WINDOW = 32
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def cuts(data: bytes) -> list[int]:
    """Where chunks begin, 0 apart: at characters, where the hash of the 32 bytes before has AVERAGE_BITS zeros."""
    n = len(data)
    if n <= LEAST + _WINDOW:
        return []
    words = np.ndarray((n - 7,), dtype="<u8", buffer=data, strides=(1,))
    m = n - _WINDOW + 1
    h = words[:m] * _MULTIPLIERS[0]
    for k in (1, 2, 3):
        h += (words[8 * k : 8 * k + m] ^ (h >> np.uint64(29))) * _MULTIPLIERS[k]
    found = np.flatnonzero((h >> np.uint64(64 - AVERAGE_BITS)) == 0) + _WINDOW
    out, last = [], 0
    while n - last > LEAST:
        i = int(np.searchsorted(found, last + LEAST))
        at = min(int(found[i]) if i < len(found) else n, last + MOST)
        while at < n and data[at] & 0xC0 == 0x80:
            at += 1
        if at >= n:
            break
        out.append(at)
        last = at
    return out


class ChunkEncoder:
    """Encodes texts as (number of tokens, ids joined by blanks, tokens joined by blanks). What it keeps of words and chunks is their ids, as bytes."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.names = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.decimal = [str(i) for i in range(size)]
        self.kind = "H" if size <= 1 << 16 else "I"
        self.words: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        self.chunks: dict[str, tuple] = {}
        self.joins: dict[str, bytes | None] = {}
        self.kept = self.reused = self.repaired = self.widened = 0

    def _batch(self, pieces: list[str]) -> list[bytes]:
        return [array(self.kind, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def plain(self, text: str) -> bytes:
        """By words: no token crosses a blank or a line end, and normalisation doesn't either."""
        words = text.replace("\n", " ").split(" ")
        have, old = self.words, self.old
        own: dict[str, bytes] = {}
        if missing := set(words).difference(have):
            have.update((w, old[w]) for w in missing if w in old)
            asked = [w for w in missing if w not in old]
            for w, e in zip(asked, self._batch(asked) if asked else (), strict=True):
                (have if len(w) <= WORD_CHARS else own)[w] = e
        found = b"".join([have[w] if w in have else own[w] for w in words] if own else map(have.__getitem__, words))
        if len(have) > WORDS:  # words that stay in use are taken over from the old ones
            self.words, self.old = {"": b""}, have
        return found

    def chunk(self, text: str) -> tuple | None:
        """(head, the ids of the inside, tail, first word inside, last word inside, the inside); None without a blank."""
        if text in self.chunks:
            self.reused += 1
            return self.chunks[text]
        first = BLANKS.search(text)
        got = None
        if first:
            a, b = first.start(), max(text.rfind(" "), text.rfind("\n"))
            inside = text[a : b + 1]
            got = (text[:a], self.plain(inside), text[b + 1 :], "".join(inside.split(None, 1)[:1]), "".join(inside.rsplit(None, 1)[-1:]), inside)
        if self.kept > CHUNK_CHARS:
            self.chunks.clear()
            self.joins.clear()
            self.kept = 0
        self.kept += len(text)
        self.chunks[text] = got
        return got

    def join(self, before: str, piece: str, after: str) -> bytes | None:
        """piece encoded between the words before and after; None if these don't come out as on their own."""
        window = f"{before} {piece} {after}"
        if window not in self.joins:
            self.repaired += 1
            ids, a, b = self._batch([window])[0], self.plain(before), self.plain(after)
            end = len(ids) - len(b)
            self.joins[window] = ids[len(a) : end] if end >= len(a) and ids.startswith(a) and ids.endswith(b) else None
            self.kept += len(window)
        return self.joins[window]

    def ids(self, text: str) -> bytes:
        data = text.encode("utf-8", "surrogatepass")
        at = [0, *cuts(data), len(data)]
        if len(at) == 2:
            return self.plain(text)
        parts: list[bytes] = []
        pending, guard, last = "", "", ""
        for a, b in zip(at, at[1:], strict=False):
            piece = data[a:b].decode("utf-8", "surrogatepass")
            got = self.chunk(piece)
            if got is None:
                pending += piece
                continue
            head, inside, tail, first_word, last_word, body = got
            if pending or head:
                joined = self.join(guard, pending + head, first_word)
                if joined is None:  # the chunk before and this one together, then the text
                    self.widened += 1
                    whole = self._batch([last + pending + head + body])[0]
                    check = self.plain(last + pending + head + body)
                    if whole != check:
                        return self._batch([text])[0]
                    joined = self.plain(pending + head)
                parts.append(joined)
            parts.append(inside)
            pending, guard, last = tail, last_word, body
        if pending:
            joined = self.join(guard, pending, "")
            parts.append(joined if joined is not None else self.plain(pending))
        return b"".join(parts)

    def encode(self, text: str) -> tuple[int, str, str]:
        numbers = memoryview(self.ids(text)).cast(self.kind).tolist()
        return len(numbers), " ".join(map(self.decimal.__getitem__, numbers)), " ".join(map(self.names.__getitem__, numbers))


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One for each Python worker, so that its tasks share what was encoded."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Per row: id, n_tokens, ids_sha256, decoded_sha256; with_ids adds ids (decimal, joined by blanks) and decoded."""
    path = tokenizer or default_tokenizer()

    def run(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        enc = encoder(path)
        got = [enc.encode(t) for t in texts]
        digest = lambda k: pa.array([hashlib.sha256(g[k].encode()).hexdigest() for g in got])
        cols = [batch.column(id_col), pa.array([g[0] for g in got], pa.int64()), digest(1), digest(2)]
        names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
        if with_ids:
            cols += [pa.array([g[1] for g in got]), pa.array([g[2] for g in got])]
            names += ["ids", "decoded"]
        return pa.RecordBatch.from_arrays(cols, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids string, decoded string" * with_ids
    return docs.select(id_col, text_col).mapInArrow(per_slice(run, text_col), schema)
