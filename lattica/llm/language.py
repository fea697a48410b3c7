"""Language identification with error-correcting output codes.

Every language has a codeword of bits, far from the others. One binary classifier per bit, over hashed character n-grams
of words, predicts that bit. Decoding is weighted by loss: a text gets the language whose codeword has the smallest sum
of logistic losses over the bits. The score is the softmax of the negative losses; a text is ambiguous when the second
codeword is nearly as close.

Training takes a bounded sample of the documents that may be learned from: for each language the ``per_language``
documents with the smallest hash of id and text, so repeated rows count once and the sample does not depend on order or
partitioning. Whole texts are read, in training (with memory for a part of the words at a time) and in prediction, where the
n-gram sums of a word are computed once per distinct word.

Defined results: ``und`` with score 0 where the text is null or has no letter, and where no model could be learned (no
labelled rows); repeated rows get equal results; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes

UND = "und"
BUCKETS = 1 << 16
_CHUNK = 8192


def codewords(n: int, bits: int, seed: int = 7) -> np.ndarray:
    """n codewords of +-1: every split of few languages (the exhaustive code), else random ones far apart."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 6:
        return _exhaustive(n)
    rng, best, far = np.random.default_rng(seed), None, -1.0
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, bits))
        apart = min((code[a] != code[b]).sum() for a, b in itertools.combinations(range(n), 2))
        useful = np.abs(code.sum(0)).max() < n
        if useful and apart > far:
            best, far = code, apart
    return best


def _exhaustive(n: int) -> np.ndarray:
    """Dietterich and Bakiri's code: a column for each way to part n classes in two."""
    columns = [[1.0, *rest] for rest in itertools.product([1.0, -1.0], repeat=n - 1) if -1.0 in rest]
    return np.array(columns).T


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # (BUCKETS, bits)
    bias: np.ndarray

    def margins(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(bit margins of each text, number of n-grams of each text)."""
        words, per_text, ids = _words(texts)
        sums, counts = np.zeros((len(words), self.weights.shape[1]), np.float32), np.zeros(len(words))
        for a in range(0, len(words), _CHUNK):  # bounded: a chunk's n-grams times the bits
            some = words[a : a + _CHUNK]
            for grams, owner in ngrams(some):
                first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                sums[a + owner[first]] += np.add.reduceat(self.weights[grams], first, axis=0)
                counts[a : a + len(some)] += np.bincount(owner, minlength=len(some))
        total = np.zeros((len(per_text) - 1, sums.shape[1]))
        n = np.zeros(len(per_text) - 1)
        size = np.diff(per_text)
        some = size > 0
        if len(ids):
            total[some] = np.add.reduceat(sums[ids], per_text[:-1][some], axis=0)
            n[some] = np.add.reduceat(counts[ids], per_text[:-1][some])
        return total / np.sqrt(np.maximum(n, 1))[:, None] + self.bias, n

    def predict(self, texts) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, ambiguous) of each text."""
        m, n = self.margins(texts)
        if not self.languages:
            return [UND] * len(n), np.zeros(len(n)), np.zeros(len(n), bool)
        loss = np.logaddexp(0, -m[:, None, :] * self.code[None]).sum(2)
        loss = np.where(np.isfinite(loss), loss, 1e9)
        order = np.argsort(loss, axis=1, kind="stable")
        near = np.exp(-(loss - loss.min(1, keepdims=True)))
        score = near.max(1) / near.sum(1)
        best = order[:, 0]
        second = loss[np.arange(len(n)), order[:, 1]] - loss[np.arange(len(n)), best] if len(self.languages) > 1 else np.full(len(n), np.inf)
        none = n == 0
        names = [UND if z else self.languages[b] for b, z in zip(best.tolist(), none.tolist())]
        return names, np.where(none, 0.0, score), ~none & (second < 0.5)


def _plain(word: str) -> str:
    """Lower-case letters of a word."""
    if word.isascii():
        return "".join(filter(str.isalpha, word)).lower()
    letters = "".join(c for c in word if unicodedata.category(c)[0] in "LM").lower()
    return letters if any(map(str.isalpha, letters)) else ""


def _words(texts) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, word offsets of the texts, index of every word)."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    coded = split.flatten().dictionary_encode()
    return coded.dictionary.to_pylist(), split.offsets.to_numpy() - (split.offsets[0].as_py() if len(split.offsets) else 0), coded.indices.to_numpy()


def ngrams(words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n from 1 to 4: hashed n-grams (code points, word ends marked) and the word each belongs to, in order of words."""
    padded = [f" {p} " if (p := _plain(w)) else "" for w in words]
    points = np.frombuffer("".join(padded).encode("utf-32-le"), np.uint32).astype(np.uint64)
    lens = np.array([len(p) for p in padded], np.int64)
    owner = np.repeat(np.arange(len(words)), lens)
    found = []
    h = np.zeros(len(points), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, 5):
            if len(points) < n:
                break
            h = (h[: len(points) - n + 1] + points[n - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
            same = owner[: len(owner) - n + 1] == owner[n - 1 :]
            if n == 1:
                same = same & (points != 32)
            g = h[same] ^ np.uint64(n * 0x1F123BB5)
            g = ((g ^ (g >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)).astype(np.int64)
            if len(g):
                found.append((g, owner[: len(owner) - n + 1][same]))
    return found


def fit(rows: list[tuple[str, str]], bits: int = 24, epochs: int = 6, seed: int = 1) -> Model:
    """Learns from (text, language) rows: averaged logistic regression per bit on length-normalised n-gram counts."""
    languages = sorted({lang for _, lang in rows})
    code = codewords(len(languages), bits)
    model = Model(languages, code, np.zeros((BUCKETS, code.shape[1] if languages else 1)), np.zeros(code.shape[1] if languages else 1))
    data = []
    for text, lang in rows:
        words, counts = text.split(), np.zeros(BUCKETS)
        for a in range(0, len(words), _CHUNK):
            for g, _ in ngrams(words[a : a + _CHUNK]):
                counts += np.bincount(g, minlength=BUCKETS)
        values = np.flatnonzero(counts)
        if len(values):
            data.append((values, counts[values] / np.sqrt(counts.sum()), code[languages.index(lang)]))
    rng = np.random.default_rng(seed)
    w, b = model.weights, model.bias
    for epoch in range(epochs):
        rate = 0.5 / (1 + epoch)
        for i in rng.permutation(len(data)):
            values, x, y = data[i]
            m = x @ w[values] + b
            step = rate * y / (1 + np.exp(np.clip(y * m, -30, 30)))
            w[values] += x[:, None] * step / max(1.0, float(x @ x))
            b += 0.1 * step
    model.weights, model.bias = w.astype(np.float32), b
    return model


def held_out(key: str = "doc_id"):
    """True for the fold that nothing is learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 400, bits: int = 24) -> Model:
    """A model of the documents outside the held-out fold, from ``per_language`` whole texts of each language.

    Hashes below a bound per language are collected, about twice as many as are needed by the count of its rows; a language
    whose repeated rows leave too few gets a bound eight times as high, until there are enough or all of its rows are in.
    """
    usable = docs.where(~held_out(key) & F.col(lang).isNotNull())
    counts = {r["_l"]: r["count"] for r in usable.groupBy(F.col(lang).alias("_l")).count().collect()}  # a row per language
    if not counts:
        return fit([])
    whole = 1 << 64
    rows = usable.where(F.col(text).rlike(r"\p{L}")).select(F.col(lang).alias("l"), F.xxhash64(F.col(key), F.xxhash64(text), F.lit(2026)).alias("h"), F.col(text).alias("t"))
    below = lambda bounds: F.coalesce(*[F.when((F.col("l") == name) & (F.col("h") <= F.lit(h)), F.lit(True)) for name, h in bounds.items()], F.lit(False))
    width = {name: min(whole, whole * 2 * per_language // n) for name, n in counts.items()}
    limits: dict[str, int] = {}
    while width:
        found: dict[str, list[int]] = {name: [] for name in width}
        for r in rows.where(below({name: w - (1 << 63) - 1 for name, w in width.items()})).select("l", "h").distinct().collect():
            found[r["l"]].append(r["h"])
        for name, hashes in found.items():
            if len(hashes) >= per_language:
                limits[name] = sorted(hashes)[per_language - 1]
            elif width[name] == whole:
                limits[name] = max(hashes, default=-(1 << 63))
        width = {name: min(whole, 8 * w) for name, w in width.items() if name not in limits}
    chosen = {(r["l"], r["h"]): r["t"] for r in rows.where(below(limits)).dropDuplicates(["l", "h"]).collect()}
    return fit([(chosen[k], k[0]) for k in sorted(chosen)], bits)


def identify(docs: DataFrame, model: Model, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns in ``carry``) with lang_pred, score and ambiguous (columns of those names are replaced)."""
    docs = docs.drop("lang_pred", "score", "ambiguous")
    kept = docs.columns if carry is None else carry
    docs = docs.select(*kept, *([] if text in kept else [text]))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: BUCKETS x bits
    at = docs.columns.index(text)

    def run(batches):
        m = shared.value
        for batch in by_bytes(batches, text, 4 << 20):
            names, score, unsure = m.predict(batch.column(at))
            yield pa.record_batch([*batch.columns[: len(kept)], pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())], names=[*kept, "lang_pred", "score", "ambiguous"])

    schema = ", ".join(f"`{c}` {k}" for c, k in docs.dtypes[: len(kept)])
    return docs.mapInArrow(run, f"{schema}, lang_pred string, score double, ambiguous boolean")
