"""1. Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from a text's bytes alone. Trees are complete binary trees of fixed depth, flattened into arrays, so a
batch of documents walks all of them level by level in numpy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import batch_of, ids_of, map_steps, narrow, texts_of
from tidemark.llm.quality_rules import base_counts
from tidemark.llm.sampling import fit_in_task, held_out, labelled_sample
from tidemark.llm.textblock import NOT_SPACE, TextBlock, group_ids, mix

FOLDS, KEPT_BACK = 3, 1
#: The bound of the training sample: at most so many labelled documents of each class.
SAMPLE = {1: 12_000, 0: 8_000}
BINS, DEPTH, TREES, RATE, RIDGE, LEAST_CHILD = 64, 4, 80, 0.15, 1.0, 2.0

_KINDS = {
    "upper": list(range(65, 91)),
    "lower": list(range(97, 123)),
    "digit": list(range(48, 58)),
    "high": list(range(128, 256)),
    "space": [32],
    "newline": [10],
    "stop": [ord(c) for c in ".,;:"],
    "shout": [ord(c) for c in "!?"],
    "bar": [ord("|")],
    "markup": [ord(c) for c in "#*$%&<>"],
    "bracket": [ord(c) for c in "(){}[]=_/\\@~^+"],
}
FEATURES = (
    "log_words", "log_bytes", "word_length", "word_length_deviation", *_KINDS, "symbols", "repeated_lines", "repeated_windows", "distinct_words",
    "distinct_pairs", "commonest_word", "doubled_words", "long_words", "short_words", "line_length", "odd_ends",
)


def statistics(texts: pa.Array) -> np.ndarray:
    """A float32 row of FEATURES for each text; null and empty texts give zeros."""
    block = TextBlock(texts)
    starts, ends, doc = block.spans(NOT_SPACE)
    base, n = base_counts(texts), block.n
    size, words = (ends - starts).astype(np.float64), np.maximum(np.bincount(doc, minlength=n), 1)
    octets = np.maximum(np.diff(block.offs), 1)
    total = lambda v: np.bincount(doc, weights=v, minlength=n)
    mean = total(size) / words
    kinds = []
    for members in _KINDS.values():
        inside = np.zeros(256, bool)
        inside[members] = True
        kinds.append(block.counts(inside[block.buf]) / octets)
    hashes = block.hashes(starts, ends)
    own = mix(hashes + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    codes, distinct = group_ids(own)
    often = np.bincount(codes, minlength=len(distinct))
    of = np.zeros(len(distinct), np.int64)
    of[codes] = doc
    commonest = np.zeros(n)
    np.maximum.at(commonest, of, often)
    same = doc[1:] == doc[:-1]
    pairs = mix(own[:-1] * np.uint64(3) + own[1:])[same]
    pair_doc = doc[:-1][same]
    pair_codes, pair_distinct = group_ids(pairs)
    pair_of = np.zeros(len(pair_distinct), np.int64)
    pair_of[pair_codes] = pair_doc
    last = block.buf[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    odd = ~((last >= 128) | ((last >= 48) & (last <= 57)) | ((last >= 65) & (last <= 90)) | ((last >= 97) & (last <= 122)) | (last == 46) | (last == 44))
    lines = block.counts(block.buf == 10) + 1
    columns = [
        np.log1p(base["n_words"]), np.log1p(np.diff(block.offs)), mean, np.sqrt(np.maximum(total(size * size) / words - mean * mean, 0)), *kinds,
        base["n_symbols"] / words, base["n_dup_lines"] / lines, base["n_repeat_words"] / words, np.bincount(of, minlength=n) / words,
        np.bincount(pair_of, minlength=n) / words, commonest / words, np.bincount(doc[1:][same & (own[1:] == own[:-1])], minlength=n) / words,
        total(size > 12) / words, total(size < 3) / words, words / lines, total(odd) / words,
    ]
    return np.stack(columns, axis=1).astype(np.float32) * (base["n_words"] > 0)[:, None].astype(np.float32)


class Trees:
    """Boosted trees as arrays: ``feature`` and ``edge`` (trees, inner nodes), ``leaf`` (trees, leaves), ``start``."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.arrays = arrays

    def logits(self, x: np.ndarray) -> np.ndarray:
        """A value goes right of a node's edge if it is greater; all trees are walked at once, level by level."""
        feature, edge, leaf = self.arrays["feature"], self.arrays["edge"], self.arrays["leaf"]
        if not len(feature):
            return np.full(len(x), self.arrays["start"][0], np.float64)
        tree, row = np.arange(len(feature)), np.arange(len(x))[:, None]
        node = np.zeros((len(x), len(feature)), np.int64)
        for _ in range(int(np.log2(leaf.shape[1]))):
            node = 2 * node + 1 + (x[row, feature[tree, node]] > edge[tree, node])
        return self.arrays["start"][0] + leaf[tree, node - feature.shape[1]].sum(axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> dict[str, np.ndarray]:
    """Second-order boosting of the logistic loss over histograms of quantile bins. With fewer than two classes: no trees."""
    y = y.astype(np.float64)
    share = (y.sum() + 0.5) / (len(y) + 1)
    start, inner = np.log(share / (1 - share)), 2**depth - 1
    out = {"feature": np.zeros((0, inner), np.int64), "edge": np.zeros((0, inner), np.float32), "leaf": np.zeros((0, inner + 1)), "start": np.array([start])}
    if len(np.unique(y)) < 2:
        return out
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1]).astype(np.float32)) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)  # bin b: edge[b-1] < value <= edge[b]
    places = binned + np.arange(x.shape[1]) * BINS
    logit, features = np.full(len(y), start), x.shape[1]
    for name in ("feature", "edge", "leaf"):
        out[name] = [*out[name]]
    for _ in range(trees):
        p = 1 / (1 + np.exp(-logit))
        g, h, node = p - y, p * (1 - p), np.zeros(len(y), np.int64)
        feature, edge = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (features * BINS) + places).ravel()
            cells = width * features * BINS
            left_g = np.bincount(at, np.repeat(g, features), cells).reshape(width, features, BINS).cumsum(axis=2)
            left_h = np.bincount(at, np.repeat(h, features), cells).reshape(width, features, BINS).cumsum(axis=2)
            all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
            gain = left_g**2 / (left_h + RIDGE) + (all_g - left_g) ** 2 / (all_h - left_h + RIDGE) - all_g**2 / (all_h + RIDGE)
            gain[(left_h < LEAST_CHILD) | (all_h - left_h < LEAST_CHILD)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            for k in range(width):
                f, b = divmod(int(best[k]), BINS)
                if gain[k, f, b] > 1e-6 and b < len(edges[f]):
                    feature[first + k], edge[first + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > edge[node])
        where = node - inner
        leaf = -RATE * np.bincount(where, g, inner + 1) / (np.bincount(where, h, inner + 1) + RIDGE)
        logit += leaf[where]
        for name, value in (("feature", feature), ("edge", edge), ("leaf", leaf)):
            out[name].append(value)
    return {k: np.array(v) for k, v in out.items()}


def train_on(docs: DataFrame, labels: DataFrame, sample: dict[int, int] | None = None) -> Trees:
    """Fits on the statistics of a bounded sample of the labelled documents outside the fold that is kept back."""
    rows = labelled_sample(docs, labels, "quality", FOLDS, KEPT_BACK, sample or SAMPLE)

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = statistics(texts_of(batch))
        return batch_of(doc_id=ids_of(batch), y=texts_of(batch, "y"), x=pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32())))

    measured = map_steps(rows, measure, "doc_id long, y int, x array<float>")

    def fit(table: pa.Table) -> dict[str, np.ndarray]:
        x = table["x"].combine_chunks() if len(table) else None
        flat = x.flatten().to_numpy().reshape(len(table), -1) if len(table) else np.zeros((0, len(FEATURES)), np.float32)
        return fit_trees(flat, table["y"].to_numpy())

    return Trees(fit_in_task(measured, fit))


def score(docs: DataFrame, model: Trees) -> DataFrame:
    """The operator: (doc_id, score) for each row of ``docs``: the probability of quality 1. Null and empty texts are
    scored as texts of which all statistics are zero. Further columns are ignored; an empty table gives no rows."""
    arrays = docs.sparkSession.sparkContext.broadcast(model.arrays)  # some 30 kB
    return map_steps(narrow(docs, "doc_id", "text"), lambda b: batch_of(doc_id=ids_of(b), score=pa.array(Trees(arrays.value).scores(statistics(texts_of(b))))), "doc_id long, score double")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """op1's rows."""
    scored = score(docs, train_on(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id"), FOLDS, KEPT_BACK).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
