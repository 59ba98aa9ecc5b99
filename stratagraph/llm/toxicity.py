"""Toxicity by compression distance.

zstandard trains separate dictionaries on ordinary and on toxic text, by its COVER method. Ordinary ones are of stretches of CONTEXT bytes, and of words: each text's different ones, with blanks between them. The
toxic one is of words as well, in two steps: a dictionary of all words of either half of the toxic texts says which words of the other half it compresses better than the ordinary one does by
SAVED bytes, which what occurs in one text alone can't be; the toxic dictionary is trained on these. Windows of a text to score, single words and stretches of CONTEXT bytes, are compressed with the
ordinary dictionary and with that and the toxic one; how many bytes the latter saves, over all windows of the text, is calibrated to a probability by a logistic fit, and the threshold by the best F1. Both
are fitted to savings that dictionaries of the other FOLDS - 1 parts of the training rows give, as a text's own words are in a dictionary that it trained.

The fit takes about SAMPLE rows of each class, SAMPLE_BYTES of text at most on average, chosen by a hash of their id, and trains each dictionary on about
WINDOWS windows, chosen by a hash, of all of these that are of its class; every text is scored whole.

Edge cases: null, empty and wordless texts score as a text of which no window saves a byte.
Rows whose label or id is null are not learned from; of several labels of an id the largest holds. Without rows of
both classes all scores are 0. Repeated rows give repeated rows.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_hash, per_slice

#: Expected number of training rows of each class, and of bytes of all: the bounds of the sample.
SAMPLE, SAMPLE_BYTES = 4000, 100_000_000
#: Bytes of the dictionaries: of stretches of ordinary text, of words (also of toxic texts, at first), of toxic words.
ORDINARY_BYTES, WORD_BYTES, TOXIC_BYTES = 32_768, 65_536, 16_384
#: COVER's segments, the strings that it counts, and those that it counts among words.
SEGMENT, STRING, SHORT = 24, 8, 6
#: Bytes that a word has to be compressed better by, to be taken for toxic.
SAVED = 2
#: Parts of the training rows.
FOLDS = 4
CONTEXT = 128
#: Expected number of windows that a dictionary is trained on, at most.
WINDOWS = 40_000
#: Between words in training, at least as long as what STRING exceeds a short word by.
APART = "    "
WORD = re.compile(r"[^\W\d_]+")
#: Stands before single words and in both dictionaries, so that even the shortest window is worth compressing.
FILLER = bytes(range(64))
#: Stands behind single words: zstandard begins no match in the last eight bytes, so a short word would not be looked for.
TAIL = FILLER[48:] + FILLER[:16]
#: Words that a worker keeps from task to task: the first ones that it met, among which the common ones are.
KEPT_WORDS = 100_000
_CACHE_WORDS, _LONGEST_WORD = 400_000, 32


@dataclass
class Model:
    ordinary_words: bytes
    ordinary: bytes
    toxic: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float


def context_windows(text: str, size: int = CONTEXT) -> list[bytes]:
    data = text.encode("utf-8", "surrogatepass")
    out, i, n = [], 0, len(data)
    while i < n:
        j = min(i + size, n)
        if j < n:
            k = data.rfind(b" ", i, j)
            if k > i:
                j = k + 1
        out.append(data[i:j])
        i = j
    return out


def chosen(windows: list[bytes], budget: int | None = None) -> list[bytes]:
    """About budget (WINDOWS) of the windows, as a hash of their number falls; all of them where there are no more. In the order of the hash, as training was seen to take nothing from the last rows."""
    share = min(1.0, (WINDOWS if budget is None else budget) / max(1, len(windows)))
    every = ((zlib.crc32(b"%d" % i), w) for i, w in enumerate(windows))
    return [w for _, w in sorted(x for x in every if x[0] < share * 2**32)]


def windows_of(texts: list[str], budget: int | None = None) -> list[bytes]:
    """chosen() of all texts' stretches."""
    return chosen([w for t in texts for w in context_windows(t.lower())], budget)


def trained(size: int, windows: list[bytes], segment: int, string: int) -> bytes:
    """A dictionary of zstandard's; of so few windows that it can't be trained, their last bytes."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, windows, k=segment, d=string).as_bytes()
    except zstandard.ZstdError:
        return b"".join(windows)[-size:] or b" "


def word_windows(texts: list[str]) -> list[bytes]:
    """Each text's different words, in windows of CONTEXT bytes."""
    out = []
    for t in texts:
        words = dict.fromkeys(WORD.findall(t.lower()))
        data = (" " + " ".join(words) + " ").encode("utf-8", "surrogatepass")
        out += [data[i : i + CONTEXT] for i in range(0, len(data), CONTEXT)] if words else []
    return out


def of_words(texts: list[str]) -> bytes:
    return trained(WORD_BYTES, chosen(word_windows(texts)), SEGMENT, SHORT)


def toxic_windows(bad: list[str], ordinary_words: bytes) -> list[bytes]:
    """Of each text, once each, the words that a dictionary of the other half's words compresses better by SAVED bytes; in windows of 2 * CONTEXT bytes."""
    out = []
    halves = bad[0::2], bad[1::2]
    for own, other in (halves, halves[::-1]):
        saved = WordSavings(ordinary_words, of_words(other))
        for t in own:
            words = [w for w in dict.fromkeys(WORD.findall(t.lower())) if saved(w) >= SAVED]
            data = (APART + APART.join(words) + APART).encode("utf-8", "surrogatepass")
            out += [data[i : i + 2 * CONTEXT] for i in range(0, len(data), 2 * CONTEXT)] if words else []
    return out


def squeezed(dictionary: bytes) -> bytes:
    return re.sub(rb" +", b" ", dictionary)


class WordSavings(dict):
    """By how many bytes a word is shorter with the second dictionary than with the first. What was found is kept, so that most words are one look-up."""

    def __init__(self, first: bytes, second: bytes):
        super().__init__()
        self.pair = [Compressors.fine(first + FILLER), Compressors.fine(second + FILLER)]

    def __missing__(self, w: str) -> int:
        data = FILLER + f" {w} ".encode("utf-8", "surrogatepass") + TAIL
        got = len(self.pair[0](data)) - len(self.pair[1](data))
        if len(w) <= _LONGEST_WORD:
            if len(self) > _CACHE_WORDS:
                self.clear()
            self[w] = got
        return got

    def __call__(self, w: str) -> int:
        return self[w]


class Compressors:
    def __init__(self, ordinary_words: bytes, ordinary: bytes, toxic: bytes):
        self.saved = WordSavings(ordinary_words, ordinary_words + toxic)
        self.context = [self.coarse(ordinary), self.coarse(ordinary + toxic)]

    @classmethod
    def fine(cls, content: bytes):
        return cls._make(content, dict(window_log=17, chain_log=17, hash_log=17, search_log=6, min_match=3, target_length=64, strategy=7))

    @classmethod
    def coarse(cls, content: bytes):
        return cls._make(content, dict(window_log=17, chain_log=17, hash_log=17, search_log=5, min_match=4, target_length=32, strategy=5))

    @staticmethod
    def _make(content: bytes, how: dict):
        import zstandard as z

        params = z.ZstdCompressionParameters(**how, write_content_size=False, write_checksum=False, write_dict_id=False)
        d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=params)
        return z.ZstdCompressor(dict_data=d, compression_params=params).compress

    def features(self, text: str) -> list[float]:
        low = text.lower()
        d = np.array(list(map(self.saved.__getitem__, WORD.findall(low))) or [0], dtype=np.int32)
        a, b = self.context
        c = np.array([len(a(x)) - len(b(x)) for x in context_windows(low)] or [0], dtype=np.int32)
        share = lambda x, k: math.sqrt(np.count_nonzero(x >= k) / len(x))
        count = lambda x, k: math.log1p(np.count_nonzero(x >= k))
        return [share(d, 2), share(d, 3), share(d, 4), share(d, 5), share(d, 6), float(d.mean()), count(d, 5), float(c.mean()), float(c.sum()) / math.sqrt(len(c)), share(c, 3), share(c, 5), share(c, 8), count(c, 5), math.log1p(len(d))]


def dictionaries(texts: list[str], toxic: list[int]) -> tuple[bytes, bytes, bytes]:
    """Of ordinary words, of ordinary stretches, of toxic words."""
    bad = [t for t, y in zip(texts, toxic, strict=True) if y]
    good = [t for t, y in zip(texts, toxic, strict=True) if not y]
    ordinary_words = of_words(good)
    ordinary = trained(ORDINARY_BYTES, windows_of(good), 2 * SEGMENT, STRING)
    return ordinary_words, ordinary, squeezed(trained(TOXIC_BYTES, chosen(toxic_windows(bad, ordinary_words)), SEGMENT, STRING))


def held_out_features(texts: list[str], toxic: list[int], found: tuple[bytes, bytes, bytes]) -> np.ndarray:
    """Each text's features by dictionaries of the other parts; by found, those of all, where a part would leave none of a class to learn from."""
    y = np.array(toxic)
    if min(np.count_nonzero(y), np.count_nonzero(y == 0)) < 2 * FOLDS:
        c = Compressors(*found)
        return np.array([c.features(t) for t in texts])
    # parts of either class alike
    part = np.zeros(len(y), np.int64)
    for k in (0, 1):
        part[(y > 0) == k] = np.arange(np.count_nonzero((y > 0) == k)) % FOLDS
    out: list[list[float]] = [[]] * len(y)
    for k in range(FOLDS):
        others = np.flatnonzero(part != k).tolist()
        c = Compressors(*dictionaries([texts[i] for i in others], [toxic[i] for i in others]))
        for i in np.flatnonzero(part == k).tolist():
            out[i] = c.features(texts[i])
    return np.array(out)


def fit(texts: list[str], toxic: list[int], ordinary_weight: float = 1.0) -> Model | None:
    """The dictionaries, the weights of the windows' savings and the threshold, from labelled texts.

    ordinary_weight: ordinary rows that each sampled one stands for, against a toxic one; the threshold depends on it.
    """
    if not any(toxic) or all(toxic):
        return None
    found = dictionaries(texts, toxic)
    x = held_out_features(texts, toxic, found)
    y = np.array(toxic, dtype=float)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    ridge = np.append(np.full(z.shape[1] - 1, 1.0), 1e-6)
    for _ in range(30):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    s = z @ w
    order = np.argsort(-s, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (hits + ordinary_weight * np.cumsum(1 - y[order]) + y.sum())
    k = int(np.argmax(f1))
    at = (s[order[k]] + s[order[min(k + 1, len(s) - 1)]]) / 2
    return Model(*found, mean, scale, w[:-1], float(w[-1] - at))


def sample_ids(labels: DataFrame, id_col: str, label_col: str, sample: int) -> tuple[DataFrame, dict[int, int]]:
    """About sample ids of each class, with y and part (a number below 1000000, as a hash of the id falls); and the rows of each class."""
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max((F.col(label_col) > 0).cast("int")).alias("y"))
    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for y, k in n.items():
        share = F.when(F.col("y") == y, min(1.0, sample / k)).otherwise(share)
    part = F.pmod(F.xxhash64(id_col), F.lit(1_000_000))
    return rows.withColumn("part", (part / share).cast("long")).where(part < share * 1_000_000), n


def fit_table(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model | None:
    """fit() on a bounded sample of the labelled rows; the caller has taken out the rows to hold out."""
    picked, n = sample_ids(labels, id_col, label_col, sample)
    rows = docs.select(id_col, text_col).join(F.broadcast(picked), id_col).where(F.col(text_col).isNotNull())
    size = rows.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    if size > SAMPLE_BYTES:  # fewer, of both classes alike
        rows = rows.where(F.col("part") < 1_000_000 * SAMPLE_BYTES / size)
    rows = sorted({r[0]: r for r in rows.select(id_col, text_col, "y").collect()}.values(), key=lambda r: r[0])
    toxic = [r[2] for r in rows]
    ordinary, bad = n.get(0, 0), n.get(1, 0)
    weight = (ordinary / max(1, len(toxic) - sum(toxic))) / (bad / max(1, sum(toxic))) if bad else 1.0
    return fit([r[1] for r in rows], toxic, weight)


_LOADED: dict[int, tuple[Model, Compressors]] = {}


def _compressors(model: Model) -> Compressors:
    key = hash((model.ordinary, model.toxic, model.ordinary_words))
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = (model, Compressors(model.ordinary_words, model.ordinary, model.toxic))
    return _LOADED[key][1]


def forget() -> None:
    """Drops most of what words were found to save; the next stage's tasks run in the same workers."""
    for _, c in _LOADED.values():
        kept = dict(islice(c.saved.items(), KEPT_WORDS))
        c.saved.clear()
        c.saved.update(kept)


def scores(model: Model | None, texts: list[str]) -> np.ndarray:
    if model is None or not texts:
        return np.zeros(len(texts))
    c = _compressors(model)
    x = np.array([c.features(t) for t in texts])
    s = ((x - model.mean) / model.scale) @ model.weights + model.bias
    return 1 / (1 + np.exp(-np.clip(s, -30, 30)))


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, score (0 to 1), predicted (1 from 0.5 on)."""

    def run(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        s = scores(model, texts)
        return pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[id_col, "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(per_slice(run, text_col, after=forget), f"`{id_col}` {kind}, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of docs that aren't predicted toxic."""

    def run(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        return batch.filter(pa.array(scores(model, texts) < 0.5))

    return docs.mapInArrow(per_slice(run, text_col, after=forget), docs.schema)


def detect(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Learns from the labels whose crc32(doc_id) mod 5 is not 0, and scores all of docs."""
    model = fit_table(docs, labels.where(id_hash("doc_id") % 5 != 0), sample=sample)
    out = score(docs, model)
    return out.select("doc_id", F.coalesce(id_hash("doc_id") % 5 == 0, F.lit(False)).alias("held_out"), "score", "predicted")
