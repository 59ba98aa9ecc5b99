"""Language identification by multilingual mixture inference.

Byte trigrams inside words give each word a likelihood under every learned language.
Expectation-maximisation over the words of a text estimates the languages' shares in it;
which languages take part is chosen by the Bayesian information criterion: the sets tried are the
k largest shares for k = 1, 2, ..., each fitted again on its own. A text for which even the
unrestricted fit gains less than one parameter's penalty over the best single language is left with that language.

The model is learned from about SAMPLE texts of each language, chosen by a hash of their id; every text is read whole.

Edge cases: null texts and texts without a letter are 'und' with score 0, and so is every text if nothing could be learned. Languages
with equal shares: the alphabetically first. Repeated rows give repeated rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_hash, per_slice

#: Expected number of training texts of each language: the bound of the sample.
SAMPLE = 400
BUCKETS = 1 << 16
#: Added to each trigram's count.
SMOOTHING = 0.05
UNDETERMINED = "und"
#: EM ends when no share of a text changes by more than TOLERANCE, or with MOST_ROUNDS.
TOLERANCE, MOST_ROUNDS = 1e-3, 500
_SPACE = 32

_LETTER = np.zeros(256, dtype=bool)
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[128:] = True


@dataclass
class Model:
    languages: list[str]
    logp: np.ndarray  # BUCKETS x languages, float32


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the trigrams around each letter byte, where words begin among them, and the texts of the words."""
    parts = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(p) + 1 for p in parts], dtype=np.int64)
    data = np.frombuffer(b" " + b" ".join(parts) + b"  ", dtype=np.uint8)
    letter = _LETTER[data]
    b = np.where(letter, data, _SPACE).astype(np.uint32)
    at = np.flatnonzero(letter)
    if not len(at):
        return np.zeros(0, np.uint16), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = b[at - 1] * np.uint32(0x9E3779B1) + b[at] * np.uint32(0x85EBCA77) + b[at + 1] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    first = np.flatnonzero(~letter[at - 1])
    doc = np.searchsorted(np.cumsum(sizes), at[first] - 1, side="right")
    return (h >> np.uint32(16)).astype(np.uint16), first, doc


def counts(texts: list[str]) -> np.ndarray:
    return np.bincount(trigrams(texts)[0], minlength=BUCKETS)


def model_of(by_language: dict[str, np.ndarray]) -> Model | None:
    languages = sorted(k for k, v in by_language.items() if v.sum())
    if not languages:
        return None
    c = np.stack([by_language[k] for k in languages], axis=1).astype(np.float64)
    c += SMOOTHING
    return Model(languages, np.log(c / c.sum(0)).astype(np.float32))


def _em(like: np.ndarray, start: np.ndarray, doc: np.ndarray, shares: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares of each text after so many rounds, and its log likelihood under them (less the words' constants)."""
    n = np.diff(np.append(start, len(doc)))[:, None]
    for k in range(rounds):
        p = like * shares[doc]
        total = p.sum(1)
        p /= total[:, None]
        new = np.add.reduceat(p, start, axis=0) / n
        done = np.abs(new - shares).max() < TOLERANCE
        shares = new
        if done:
            break
    total = (like * shares[doc]).sum(1)
    return shares, np.add.reduceat(np.log(np.maximum(total, 1e-30)), start)


def mixtures(model: Model, texts: list[str]) -> np.ndarray:
    """Texts x languages: shares by the best set of languages, all 0 for texts without a word."""
    out = np.zeros((len(texts), len(model.languages)), dtype=np.float32)
    grams, first, doc = trigrams(texts)
    if not len(grams):
        return out
    like = np.add.reduceat(model.logp[grams], first, axis=0)
    best = like.max(1, keepdims=True)
    # a word's evidence is bounded, as trigrams of a word don't come independently
    like = np.exp(np.maximum(like - best, -12.0))
    ids, start = np.unique(doc, return_index=True)
    local = np.repeat(np.arange(len(ids)), np.diff(np.append(start, len(doc))))
    words = np.diff(np.append(start, len(doc)))
    alone = np.add.reduceat(np.log(like), start, axis=0)
    top = alone.argmax(1)
    single = alone[np.arange(len(ids)), top]
    shares, full = _em(like, start, local, np.full((len(ids), like.shape[1]), 1 / like.shape[1], dtype=np.float32), MOST_ROUNDS)
    penalty = 0.5 * np.log(np.maximum(words, 2))
    result = np.zeros_like(shares)
    result[np.arange(len(ids)), top] = 1
    value = single - penalty
    active = np.flatnonzero(full - single > penalty)
    order = np.argsort(-shares, axis=1, kind="stable")
    for k in range(2, len(model.languages) + 1):
        if not len(active):
            break
        take = np.isin(local, active)
        own = np.searchsorted(active, local[take])
        begin = np.flatnonzero(np.diff(np.append(-1, own)))
        s = np.zeros((len(active), like.shape[1]), dtype=np.float32)
        rows = np.arange(len(active))[:, None]
        s[rows, order[active, :k]] = np.maximum(shares[active[:, None], order[active, :k]], 1e-3)
        s /= s.sum(1, keepdims=True)
        s, fit = _em(like[take], begin, own, s, MOST_ROUNDS)
        better = fit - k * penalty[active] > value[active]
        value[active[better]] = (fit - k * penalty[active])[better]
        result[active[better]] = s[better]
        # a larger set can't be better than the unrestricted fit
        active = active[(full - (k + 1) * penalty)[active] > value[active]]
    out[ids] = result
    return out


def predict(model: Model | None, texts: list[str]) -> tuple[list[str], np.ndarray]:
    if model is None or not texts:
        return [UNDETERMINED] * len(texts), np.zeros(len(texts))
    shares = mixtures(model, texts)
    top = shares.argmax(1)
    known = (shares.sum(1) > 0) & np.array([has_letter(t) for t in texts])
    score = np.where(known, np.clip(shares[np.arange(len(texts)), top], 0, 1), 0.0).astype(np.float64)
    return [model.languages[i] if k else UNDETERMINED for i, k in zip(top, known, strict=True)], score


def fit_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model | None:
    """The model from the rows of docs (the caller has taken out those to hold out) that have a text and a language."""
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    n = {r[0]: r[1] for r in rows.groupBy(lang_col).agg(F.count("*")).collect()}
    if not n:
        return None
    share = F.lit(0.0)
    for language, k in n.items():
        share = F.when(F.col(lang_col) == language, min(1.0, sample / k)).otherwise(share)
    picked = rows.where(F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < share * 1_000_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, language in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                c = counts([t])
                at = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array([language] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at].astype(np.int64))], names=["language", "bucket", "n"])

    # the sums alone, BUCKETS numbers of each language at most, come to the driver
    each = picked.select(F.col(text_col).alias("text"), F.col(lang_col).alias("language")).mapInArrow(run, "language string, bucket int, n long")
    sums = each.groupBy("language", "bucket").agg(F.sum("n").alias("n")).toArrow()
    by_language: dict[str, np.ndarray] = {}
    language, bucket, n_ = (sums.column(c).to_numpy() for c in ("language", "bucket", "n"))
    for name in sorted(set(language.tolist())):
        by_language[name] = np.bincount(bucket[language == name], weights=n_[language == name], minlength=BUCKETS).astype(np.int64)
    return model_of(by_language)


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, lang_pred, score (the language's share of the text)."""

    def run(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        languages, score = predict(model, texts)
        return pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(languages), pa.array(score)], names=[id_col, "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    limit = max(100_000, 6_000_000 // max(4, len(model.languages) if model else 4))
    return docs.select(id_col, text_col).mapInArrow(per_slice(run, text_col, limit), f"`{id_col}` {kind}, lang_pred string, score double")


def detect(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Learns from the rows whose crc32(doc_id) mod 3 is not 1, and predicts all of docs."""
    model = fit_table(docs.where(id_hash("doc_id") % 3 != 1), sample=sample)
    out = identify(docs, model)
    return out.select("doc_id", F.coalesce(id_hash("doc_id") % 3 == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
