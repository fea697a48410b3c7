"""Quality rules by line labelling with a linear-chain conditional random field.

Every line with a word gets indicator features (length, symbols, capitals, digits, marks, repetition, neighbours come in
through the transitions). A two-state chain (content, boilerplate) is decoded by Viterbi; a document is kept when the
share of its words on content lines reaches ``share``. The base counts are computed from the same pass over whole texts.

Training: conditional log-likelihood by forward-backward and gradient steps on a bounded sample of labelled documents
(``sample`` documents, ``train_lines`` lines of each); lines of low-quality documents
are boilerplate, and so are lines that a document repeats (headers, menus); the others are content.

Defined results: null and empty texts have zero counts, fail the base rules and are not kept; repeated rows get equal
results; a document with several differing labels is not learned from; extra columns are ignored; without labels every
line is content.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, byte_view

SYMBOLS = b"#*$%&|<>"
#: Bucket edges of the line features: words, bytes per word, then shares per word of symbols, capitals, digits, '!' and
#: words in repeated windows.
EDGES = {
    "words": [2, 5, 10, 25, 60],
    "width": [3, 4, 5, 6, 8, 12],
    "symbols": [0.02, 0.1, 0.3, 0.7, 1.5],
    "capitals": [0.1, 0.3, 1.0, 3.0],
    "digits": [0.05, 0.3, 1.0, 3.0],
    "marks": [0.05, 0.3, 0.8],
    "repeats": [0.05, 0.3, 0.7],
}
FEATURES = 1 + sum(len(e) + 1 for e in EDGES.values()) + 2  # bias, buckets, repeated line, only line


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_SPACE, _SYM, _UP, _DIGIT, _MARK = (_table(x) for x in (b" \t\n\v\f\r", SYMBOLS, bytes(range(65, 91)), b"0123456789", b"!"))


@dataclass
class Batch:
    """Counts of documents and of their lines with a word."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    line_words: np.ndarray
    lines: np.ndarray  # line offsets of the documents
    features: np.ndarray  # (lines, features in use) indices
    often: np.ndarray  # lines that their document holds twice or more


def repeated_windows(ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """True for each word in a 3-word window that its document holds twice or more."""
    covered = np.zeros(len(ids), bool)
    if len(ids) < 3:
        return covered
    inside = np.flatnonzero(doc[:-2] == doc[2:])
    a, b, c, d = ids[inside], ids[inside + 1], ids[inside + 2], doc[inside]
    with np.errstate(over="ignore"):
        h = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for x in (b, c, d):
            h = (h ^ (h >> np.uint64(29)) ^ x.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    order = np.argsort(h, kind="stable")
    x, y = order[:-1], order[1:]
    same = (h[x] == h[y]) & (a[x] == a[y]) & (b[x] == b[y]) & (c[x] == c[y]) & (d[x] == d[y])
    twice = np.zeros(len(inside), bool)
    twice[x[same]] = twice[y[same]] = True
    at = inside[twice]
    covered[at] = covered[at + 1] = covered[at + 2] = True
    return covered


def measure(texts: pa.Array) -> Batch:
    texts = pc.fill_null(texts, "")
    n = len(texts)
    raw, off = byte_view(pc.binary_join_element_wise(texts, "", "\n"))
    space = _SPACE[raw]
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]])) if len(raw) else np.zeros(0, np.int64)
    breaks = np.flatnonzero(raw == 10)
    bounds = np.concatenate([[0], breaks + 1])
    doc_of_line = np.searchsorted(off, bounds[:-1], "right") - 1

    def per(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return np.diff(total[at])

    words_at = np.searchsorted(starts, bounds)
    line_words = np.diff(words_at)
    doc_words = np.searchsorted(starts, off)
    n_words = np.diff(doc_words)
    sym = _SYM[raw]
    tokens = pc.ascii_split_whitespace(texts).flatten()
    tokens = tokens.filter(pc.greater(pc.binary_length(tokens), 0)).dictionary_encode()
    ids = tokens.indices.to_numpy()
    repeated = repeated_windows(ids, np.repeat(np.arange(n), n_words))
    rep = np.concatenate([[0], np.cumsum(repeated, dtype=np.int64)])

    real = line_words > 0
    lines = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(raw)])
    code = lines.dictionary_encode().indices.to_numpy().astype(np.int64)
    key = np.where(real, doc_of_line * (int(code.max(initial=0)) + 1) + code, -1 - np.arange(len(code)))
    _, first, number, times = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    dup = np.ones(len(key), bool)
    dup[first] = False  # the first of each is not a repetition
    often = times[number] > 1

    w = np.maximum(line_words, 1)
    values = {
        "words": line_words,
        "width": per(~space, bounds) / w,
        "symbols": per(sym, bounds) / w,
        "capitals": per(_UP[raw], bounds) / w,
        "digits": per(_DIGIT[raw], bounds) / w,
        "marks": per(_MARK[raw], bounds) / w,
        "repeats": np.diff(rep[words_at]) / w,
    }
    columns, base = [np.zeros(len(bounds) - 1, np.int64)], 1
    for name, edges in EDGES.items():
        columns.append(base + np.searchsorted(edges, values[name], "right"))
        base += len(edges) + 1
    per_doc = np.bincount(doc_of_line[real], minlength=n)
    columns.append(np.where(often, base, -1))
    columns.append(np.where(per_doc[doc_of_line] == 1, base + 1, -1))
    return Batch(
        n_words,
        per(~space & ((raw & 0xC0) != 0x80), off),
        per(sym, off),
        np.bincount(doc_of_line[dup & real], minlength=n),
        np.diff(rep[doc_words]),
        line_words[real],
        np.concatenate([[0], np.cumsum(per_doc)]),
        np.stack(columns, 1)[real],
        often[real],
    )


@dataclass
class Chain:
    """State scores: weights[feature, state]; transitions[from, to]. State 1 is boilerplate."""

    weights: np.ndarray
    transitions: np.ndarray

    def unary(self, features: np.ndarray) -> np.ndarray:
        w = np.vstack([self.weights, np.zeros(2)])  # index -1: no feature
        return w[features].sum(1)

    def viterbi(self, features: np.ndarray, lines: np.ndarray) -> np.ndarray:
        """States of all lines: best path of each document, all documents a step at a time."""
        u, size = self.unary(features), np.diff(lines)
        out = np.zeros(len(features), np.int8)
        order = np.argsort(-size, kind="stable")
        first, length = lines[:-1][order], size[order]
        if not len(length) or length[0] == 0:
            return out
        live = int(np.count_nonzero(length > 0))
        score = u[first[:live]]
        back: list[np.ndarray] = []
        for t in range(1, int(length[0])):
            live = int(np.searchsorted(-length, -t, "left"))  # documents with more than t lines
            paths = score[:live, :, None] + self.transitions[None]
            from_one = paths[:, 1] > paths[:, 0]
            back.append(from_one)
            score[:live] = np.where(from_one, paths[:, 1], paths[:, 0]) + u[first[:live] + t]
        state = (score[:, 1] > score[:, 0]).astype(np.int8)
        out[first[: len(state)] + length[: len(state)] - 1] = state
        for t in range(int(length[0]) - 1, 0, -1):
            live = len(back[t - 1])
            state[:live] = back[t - 1][np.arange(live), state[:live]]
            out[first[:live] + t - 1] = state[:live]
        return out


def fit(batch: Batch, states: np.ndarray, steps: int = 150, rate: float = 0.3, decay: float = 1e-3, stiff: float = 0.03, piece: int = 64) -> Chain:
    """Maximum conditional likelihood of ``states`` (a state per line), by forward-backward over chains of at most ``piece`` lines.

    Every line of a document is learned from: longer documents are cut into several chains. Chains are sorted by length, so
    a step works on those that still have a line. ``stiff`` is the penalty on transitions: labels given to whole documents
    would otherwise make the chain so stiff that a paragraph between a repeated header and footer could not be content."""
    model = Chain(np.zeros((FEATURES, 2)), np.zeros((2, 2)))
    starts = [np.arange(a, b, piece) for a, b in zip(batch.lines[:-1].tolist(), batch.lines[1:].tolist())]
    if not sum(map(len, starts)) or len(np.unique(states)) < 2:
        model.weights[0] = (1.0, -1.0)
        return model
    size = np.concatenate([np.minimum(piece, b - s) for s, b in zip(starts, batch.lines[1:].tolist())])
    order = np.argsort(-size, kind="stable")
    first, size = np.concatenate(starts)[order], size[order]
    longest = int(size[0])
    live = np.searchsorted(-size, -np.arange(longest), "left")  # chains with more than t lines
    at = np.concatenate([first[: live[t]] + t for t in range(longest)])  # lines, step by step
    cut = np.concatenate([[0], np.cumsum(live)])
    here = [slice(cut[t], cut[t + 1]) for t in range(longest)]
    before = [slice(cut[t], cut[t] + live[t + 1]) for t in range(longest - 1)]  # those of step t that go on
    features, y = batch.features[at], states[at]
    onehot, n = np.eye(2)[y], len(at)
    pair_seen = np.zeros((2, 2))
    for t in range(longest - 1):
        np.add.at(pair_seen, (y[before[t]], y[here[t + 1]]), 1)
    flat, column = features.ravel(), features.shape[1]
    m = [np.zeros((FEATURES + 1, 2)), np.zeros((2, 2))]
    v = [np.zeros((FEATURES + 1, 2)), np.zeros((2, 2))]
    for step in range(1, steps + 1):
        x = model.unary(features)
        alpha, beta = x.copy(), np.zeros(x.shape)
        for t in range(1, longest):
            alpha[here[t]] += np.logaddexp.reduce(alpha[before[t - 1], :, None] + model.transitions, 1)
        expected = np.zeros((2, 2))
        total = np.logaddexp.reduce(alpha, 1)  # of a chain that ends here; others take their last step's
        for t in range(longest - 2, -1, -1):
            after = x[here[t + 1]] + beta[here[t + 1]]
            beta[before[t]] = np.logaddexp.reduce(model.transitions + after[:, None, :], 2)
            total[before[t]] = total[here[t + 1]]
            expected += np.exp(alpha[before[t], :, None] + model.transitions + after[:, None, :] - total[before[t], None, None]).sum(0)
        diff = onehot - np.exp(alpha + beta - total[:, None])
        grad = np.stack([np.bincount(flat + 1, np.repeat(diff[:, s], column), FEATURES + 1)[1:] for s in (0, 1)], 1)
        for k, (w, g) in enumerate(((model.weights, grad / n - decay * model.weights), (model.transitions, (pair_seen - expected) / n - stiff * model.transitions))):
            mk, vk = m[k][: len(w)], v[k][: len(w)]
            mk += 0.1 * (g - mk)
            vk += 0.01 * (g * g - vk)
            w += rate * (mk / (1 - 0.9**step)) / (np.sqrt(vk / (1 - 0.99**step)) + 1e-8) * min(1.0, 20 / step)
    return model


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = 1500) -> Chain:
    """A chain learned from the whole texts of at most ``sample`` labelled documents, the same ones whatever the partitioning.

    An id that several rows hold is learned from once, by the row with the smallest hash of the text."""
    one = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.min(label).alias("_a"), F.max(label).alias("_b"))
    one = one.where("_a = _b").select("_k", F.col("_a").alias("_y"), F.xxhash64("_k", F.lit(11)).alias("_h"))
    # Half of the sample from each class, where there are as many.
    chosen = one.where("_y = 0").orderBy("_h").limit(sample // 2).union(one.where("_y = 1").orderBy("_h").limit(sample - sample // 2))
    few = F.broadcast(docs.sparkSession.createDataFrame(chosen.collect(), chosen.schema))  # at most ``sample`` rows
    rows = docs.select(F.col(key).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("t")).join(few, F.col("_id") == F.col("_k"))
    rows = rows.groupBy("_h", "_y", "_k").agg(F.min_by("t", F.xxhash64("t")).alias("t")).collect()  # at most ``sample`` rows
    rows = sorted((r["_h"], r["t"], r["_y"]) for r in rows)
    batch = measure(pa.array([t for _, t, _ in rows], pa.string()))
    low = np.repeat(np.array([not y for *_, y in rows], bool), np.diff(batch.lines))
    return fit(batch, (low | batch.often).astype(int))


def judge(docs: DataFrame, model: Chain, key: str = "doc_id", text: str = "text", share: float = 0.5) -> DataFrame:
    """key, base counts, base_failed, content_share (of the words), n_lines, n_content_lines, kept."""

    def run(batches):
        for batch in by_bytes(batches, text, 3 << 20):
            b = measure(batch.column(1))
            state = model.viterbi(b.features, b.lines)
            total = np.concatenate([[0], np.cumsum(np.where(state == 0, b.line_words, 0))])
            content = np.diff(total[b.lines])
            part = content / np.maximum(b.n_words, 1)
            failed = (b.n_words < 50) | (100 * b.n_repeat_words > 50 * b.n_words)
            good = np.concatenate([[0], np.cumsum(state == 0)])
            columns = [b.n_words, b.word_chars, b.n_symbols, b.n_dup_lines, b.n_repeat_words]
            yield pa.record_batch(
                [batch.column(0), *[pa.array(c.astype(np.int64)) for c in columns], pa.array(failed), pa.array(part), pa.array(np.diff(b.lines)), pa.array(np.diff(good[b.lines])), pa.array(~failed & (part >= share))],
                names=[key, *NAMES],
            )

    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).mapInArrow(
        run, f"`{key}` {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, n_lines long, n_content_lines long, kept boolean"
    )


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "n_lines", "n_content_lines", "kept"]
