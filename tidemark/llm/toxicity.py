"""7. Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

Each word is a hashed word vector beside the mean of its hashed character n-gram vectors. Two gated recurrent layers,
one in each direction, read overlapping windows of words; attention pools their states into one logit a window, and
the highest window stands for the document. Training needs labels of documents only: it learns from each document's
own highest window, chosen anew in every round.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import batch_of, give_back, ids_of, map_steps, narrow, texts_of
from tidemark.llm.sampling import fit_in_task, held_out, labelled_sample
from tidemark.llm.textblock import ALNUM, TextBlock, group_ids

FOLDS, KEPT_BACK = 5, 0
WINDOW, STRIDE = 32, 16
WORD_ROWS, CHAR_ROWS = 1 << 15, 1 << 16
WORD_DIM, CHAR_DIM, HIDDEN = 8, 8, 12
#: The bound of the training sample: at most so many labelled documents of each class.
SAMPLE = {1: 1500, 0: 3500}
ROUNDS, BATCH, RATE, SEED = 6, 256, 0.01, 7
#: Steps that each round takes at least.
LEAST_STEPS = 40
#: Bytes of the character n-grams taken at every place of a word, and of those taken at its start and its end.
INNER, OUTER = (4,), (2, 3, 5, 6, 7, 8, 9)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(1) / (np.float32(1) + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Words:
    """The distinct words of some texts: row in the word table, and rows in the character table, word by word."""

    row: np.ndarray
    grams: np.ndarray
    first: np.ndarray  # where each word's grams begin; one more at the end


def read_words(texts: pa.Array, with_hashes: bool = False) -> tuple:
    """Of each word its text's number and its number among the distinct words; the distinct words, and their hashes if asked for."""
    block = TextBlock(texts, lower=True)
    starts, ends, doc = block.spans(ALNUM)
    hashes = block.hashes(starts, ends)
    codes, distinct = group_ids(hashes)
    at = np.zeros(len(distinct), np.int64)
    at[codes[::-1]] = np.arange(len(codes))[::-1]  # where each first stands
    begin, end = starts[at], ends[at]
    size = end - begin
    parts, owner = [], []
    for n in INNER:
        count = np.maximum(size - n + 1, 0)
        of = np.repeat(np.arange(len(size)), count)
        a = begin[of] + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        edge = (a == begin[of]) + 2 * (a + n == end[of])  # a gram at a word's edge is another gram
        parts.append(block.hashes(a, a + n) + edge.astype(np.uint64) * np.uint64(0x9E3779B9))
        owner.append(of)
    for n in OUTER:
        of = np.flatnonzero(size > n)
        parts += [block.hashes(begin[of], begin[of] + n) + np.uint64(0x9E3779B9), block.hashes(end[of] - n, end[of]) + np.uint64(2 * 0x9E3779B9)]
        owner += [of, of]
    parts.append(distinct + np.uint64(1))  # the whole word is a gram too, so each has one
    owner.append(np.arange(len(size)))
    owner_all = np.concatenate(owner)
    order = np.argsort(owner_all, kind="stable")
    grams = (np.concatenate(parts)[order] % np.uint64(CHAR_ROWS)).astype(np.int32)
    first = np.searchsorted(owner_all[order], np.arange(len(size) + 1))
    words = Words((distinct % np.uint64(WORD_ROWS)).astype(np.int32), grams, first)
    return (doc, codes, words, distinct) if with_hashes else (doc, codes, words)


def read_sample(texts: list[str | None], chunk_bytes: int = 1_000_000) -> tuple[np.ndarray, np.ndarray, Words]:
    """As ``read_words`` for a sample of many texts, read a few at a time so that memory follows the words alone."""
    docs, codes, hashes, parts, seen, start = [], [], [], [], 0, 0
    while start < len(texts):
        end, size = start, 0
        while end < len(texts) and (end == start or size + len(texts[end] or "") <= chunk_bytes):
            size += len(texts[end] or "")
            end += 1
        doc, code, words, distinct = read_words(pa.array(texts[start:end], pa.string()), with_hashes=True)
        docs.append((doc + start).astype(np.int32))
        codes.append((code + seen).astype(np.int32))
        hashes.append(distinct)
        parts.append(words)
        seen, start = seen + len(distinct), end
    give_back()
    numbers, distinct = group_ids(np.concatenate(hashes))
    numbers = numbers.astype(np.int32)
    hashes.clear()
    first = np.zeros(len(distinct), np.int64)
    first[numbers[::-1]] = np.arange(len(numbers))[::-1]
    size = np.concatenate([np.diff(w.first) for w in parts])
    begin = np.cumsum(size) - size
    take = size[first]
    at = np.repeat(begin[first] - np.cumsum(take) + take, take) + np.arange(take.sum())
    words = Words(np.concatenate([w.row for w in parts])[first], np.concatenate([w.grams for w in parts])[at], np.append(np.cumsum(take) - take, take.sum()))
    parts.clear()
    return np.concatenate(docs), numbers[np.concatenate(codes)], words


def cut_windows(n_words: np.ndarray, window: int = WINDOW, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows over texts of so many words: text number, first word (over all texts), words. They overlap and cover all;
    the last of a text ends with it."""
    count = np.where(n_words <= window, np.minimum(n_words, 1), -(-np.maximum(n_words - window, 0) // stride) + 1)
    doc = np.repeat(np.arange(len(n_words)), count)
    k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    size = np.minimum(n_words[doc], window)
    begin = np.minimum(k * stride, n_words[doc] - size)
    return doc, begin + (np.cumsum(n_words) - n_words)[doc], size


class BiGru:
    """The network's weights and passes. Weights are float32 arrays by name."""

    def __init__(self, weights: dict[str, np.ndarray] | None = None, seed: int = SEED):
        if weights is None:
            rng = np.random.default_rng(seed)
            normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
            d, h = WORD_DIM + CHAR_DIM, HIDDEN
            weights = {"word": normal(WORD_ROWS, WORD_DIM, scale=0.1), "char": normal(CHAR_ROWS, CHAR_DIM, scale=0.1)}
            for side in "fb":
                weights |= {f"W{side}": normal(d, 3 * h, scale=d**-0.5), f"U{side}": normal(h, 3 * h, scale=h**-0.5), f"c{side}": np.zeros(3 * h, np.float32)}
            weights |= {"attend": normal(2 * h, scale=0.3), "out": normal(2 * h, scale=0.3), "bias": np.full(1, -1, np.float32), "scale": np.ones(1, np.float32), "shift": np.zeros(1, np.float32)}
        self.w = weights

    def inputs(self, words: Words, some: np.ndarray | None = None) -> tuple[np.ndarray, tuple]:
        """A vector for each distinct word, or for some of them."""
        row, first, grams = words.row, words.first, words.grams
        if some is None:
            size = np.diff(first)
        else:
            size = first[some + 1] - first[some]
            at = np.repeat(first[some] - np.cumsum(size) + size, size) + np.arange(size.sum())
            row, grams, first = row[some], grams[at], np.append(np.cumsum(size) - size, size.sum())
        char = np.zeros((len(row), CHAR_DIM), np.float32)
        for k in range(0, len(row), 20_000):
            edges = first[k : k + 20_001]
            char[k : k + 20_000] = np.add.reduceat(self.w["char"][grams[edges[0] : edges[-1]]], edges[:-1] - edges[0], axis=0)
        char /= np.sqrt(size)[:, None].astype(np.float32)
        return np.concatenate([self.w["word"][row], char], axis=1), (row, grams, size)

    def _layer(self, side: str, x: np.ndarray, index: np.ndarray, mask: np.ndarray | None, keep: bool) -> tuple[np.ndarray, list]:
        """States (windows, words, hidden) of one direction."""
        h, u = HIDDEN, self.w[f"U{side}"]
        given = x @ self.w[f"W{side}"] + self.w[f"c{side}"]
        states = np.empty((*index.shape, h), np.float32)
        state, tape = np.zeros((len(index), h), np.float32), []
        for t in range(index.shape[1]) if side == "f" else range(index.shape[1] - 1, -1, -1):
            p, a = given[index[:, t]], state @ u
            zr = _sigmoid(p[:, : 2 * h] + a[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            n = np.tanh(p[:, 2 * h :] + r * a[:, 2 * h :])
            new = n + z * (state - n)
            if mask is not None:
                new = np.where(mask[:, t, None], new, state)
            if keep:
                tape.append((t, state, z, r, n, a[:, 2 * h :]))
            state = new
            states[:, t] = new
        return states, tape

    def forward(self, x: np.ndarray, index: np.ndarray, mask: np.ndarray | None, keep: bool = False):
        """Logits of windows. ``index``: numbers of rows of x; ``mask`` where not every place has a word."""
        f, tape_f = self._layer("f", x, index, mask, keep)
        b, tape_b = self._layer("b", x, index, mask, keep)
        both = np.concatenate([f, b], axis=2)
        score = both @ self.w["attend"]
        if mask is not None:
            score = np.where(mask, score, -1e9)
        score = np.exp(score - score.max(axis=1, keepdims=True))
        if mask is not None:
            score = score * mask
        share = score / np.maximum(score.sum(axis=1, keepdims=True), 1e-9)
        pooled = np.einsum("wt,wth->wh", share, both)
        return pooled @ self.w["out"] + self.w["bias"][0], (both, share, pooled, tape_f, tape_b)

    def backward(self, x: np.ndarray, index: np.ndarray, mask: np.ndarray, saved: tuple, d_logit: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        both, share, pooled, tape_f, tape_b = saved
        h, grads = HIDDEN, {"bias": d_logit.sum(keepdims=True), "out": pooled.T @ d_logit}
        d_pooled = d_logit[:, None] * self.w["out"]
        d_share = np.einsum("wh,wth->wt", d_pooled, both)
        d_score = share * (d_share - (share * d_share).sum(axis=1, keepdims=True))
        grads["attend"] = np.einsum("wt,wth->h", d_score, both)
        d_both = share[:, :, None] * d_pooled[:, None, :] + d_score[:, :, None] * self.w["attend"]
        d_x = np.zeros_like(x)
        for side, tape, d_states in (("f", tape_f, d_both[:, :, :h]), ("b", tape_b, d_both[:, :, h:])):
            u, carried = self.w[f"U{side}"], np.zeros((len(index), h), np.float32)
            d_u, d_given = np.zeros_like(u), np.zeros((*index.shape, 3 * h), np.float32)
            for t, before, z, r, n, a in reversed(tape):
                d_new = d_states[:, t] + carried
                m = mask[:, t, None]
                live = np.where(m, d_new, 0)
                d_n = live * (1 - z) * (1 - n * n)
                d_z = live * (before - n) * z * (1 - z)
                d_r = d_n * a * r * (1 - r)
                d_a = np.concatenate([d_z, d_r, d_n * r], axis=1)
                d_given[:, t] = np.concatenate([d_z, d_r, d_n], axis=1)
                d_u += before.T @ d_a
                carried = np.where(m, live * z, d_new) + d_a @ u.T
            flat = d_given.reshape(-1, 3 * h)
            order = np.argsort(index.ravel(), kind="stable")
            ids, first = np.unique(index.ravel()[order], return_index=True)
            d_rows = np.zeros((len(x), 3 * h), np.float32)
            d_rows[ids] = np.add.reduceat(flat[order], first, axis=0)
            grads |= {f"U{side}": d_u, f"c{side}": flat.sum(axis=0), f"W{side}": x.T @ d_rows}
            d_x += d_rows @ self.w[f"W{side}"].T
        return grads, d_x

    def window_logits(self, words: Words, codes: np.ndarray, begin: np.ndarray, size: np.ndarray, step: int = 4096) -> np.ndarray:
        """Logits of windows of words; ``codes``: the words by number."""
        x, _ = self.inputs(words)
        x = np.concatenate([x, np.zeros((1, x.shape[1]), np.float32)])
        out, number = np.zeros(len(begin), np.float32), np.zeros(len(x), np.int64)
        full = size == WINDOW
        for some, whole in ((np.flatnonzero(full), True), (np.flatnonzero(~full), False)):
            for k in range(0, len(some), step):
                at = some[k : k + step]
                index, mask = window_index(codes, begin[at], size[at], len(x) - 1)
                met = np.zeros(len(x), bool)
                met[index] = True  # of a sample's many distinct words few are in these windows
                rows = np.flatnonzero(met)
                number[rows] = np.arange(len(rows))
                out[at] = self.forward(x[rows], number[index], None if whole else mask)[0]
        return out


def window_index(codes: np.ndarray, begin: np.ndarray, size: np.ndarray, blank: int) -> tuple[np.ndarray, np.ndarray]:
    place = begin[:, None] + np.arange(WINDOW)
    mask = np.arange(WINDOW) < size[:, None]
    return np.where(mask, codes[np.minimum(place, max(len(codes) - 1, 0))] if len(codes) else blank, blank), mask


def _highest(doc: np.ndarray, value: np.ndarray, n: int, empty: float) -> np.ndarray:
    out = np.full(n, empty, np.float32)
    if len(doc):
        ids, first = np.unique(doc, return_index=True)
        out[ids] = np.maximum.reduceat(value, first)
    return out


def _argmax(doc: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The window of each document with the highest value."""
    order = np.lexsort((-value, doc))
    return order[np.unique(doc[order], return_index=True)[1]]


class _Adam:
    def __init__(self, weights: dict[str, np.ndarray], rate: float):
        self.w, self.rate, self.t = weights, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in weights.items()}
        self.v = {k: np.zeros_like(v) for k, v in weights.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        fix = np.float32(self.rate * (1 - 0.999**self.t) ** 0.5 / (1 - 0.9**self.t))
        for k, g in grads.items():
            self.m[k] += np.float32(0.1) * (g - self.m[k])
            self.v[k] += np.float32(0.001) * (g * g - self.v[k])
            self.w[k] -= fix * self.m[k] / (np.sqrt(self.v[k]) + np.float32(1e-6))


def fit_line(logit: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's scale and shift for a logit: Newton steps, halved until the loss falls, towards targets drawn in from 0 and 1."""
    x = np.stack([logit, np.ones_like(logit)], axis=1).astype(np.float64)
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    loss = lambda w: float((np.logaddexp(0, x @ w) - target * (x @ w)).sum() + 1e-3 * w @ w)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 2e-3 * np.eye(2), x.T @ (p - target) + 2e-3 * w)
        now = loss(w)
        while np.abs(step).max() > 1e-7 and loss(w - step) > now:
            step = step / 2
        if np.abs(step).max() <= 1e-7:
            break
        w = w - step
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)


def first_odds(doc: np.ndarray, codes: np.ndarray, words: Words, y: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of label 1 by row of the word and of the character table, from the documents that ``use`` marks and
    that hold the row; drawn to 0 where few do."""
    size_of, counts = np.diff(words.first), [np.zeros((2, WORD_ROWS)), np.zeros((2, CHAR_ROWS))]
    edges = np.searchsorted(doc, np.arange(0, len(y) + 200, 200))  # a few documents at a time
    for a, b in zip(edges, edges[1:], strict=False):
        some = slice(a, b)
        pair = np.unique((doc[some].astype(np.int64) << 32) | codes[some])
        of, word = pair >> 32, pair & 0xFFFFFFFF
        of, word = of[use[of]], word[use[of]]
        n = size_of[word]
        grams = words.grams[np.repeat(words.first[word] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        for count, d, row in zip(counts, (of, np.repeat(of, n)), (words.row[word], grams), strict=True):
            pair = np.unique((d << 32) | row)
            d, row = pair >> 32, pair & 0xFFFFFFFF
            count[0] += np.bincount(row, weights=y[d], minlength=count.shape[1])
            count[1] += np.bincount(row, minlength=count.shape[1])
    out, total = [], (float(y[use].sum()) + 1, float((1 - y)[use].sum()) + 1)
    for ones, alls in counts:
        odds = np.log((ones + 0.5) / total[0]) - np.log((alls - ones + 0.5) / total[1])
        out.append((odds * alls / (alls + 4)).astype(np.float32))
    return out[0], out[1]


def train(texts: list[str | None], y: np.ndarray, rounds: int = ROUNDS, seed: int = SEED) -> BiGru:
    """Fits the network on labelled texts; a fifth of them calibrates its probabilities. With a class missing, or no word
    at all, every text gets one probability: the share of ones, drawn towards a quarter, so no label means no rejection."""
    net, rng = BiGru(seed=seed), np.random.default_rng(seed)
    y = np.asarray(y, np.float32)
    word_doc, codes, words = read_sample(texts) if len(set(y.tolist())) == 2 else (None, (), None)
    if not len(codes):
        net.w["scale"][0], net.w["shift"][0] = 0, np.log((y.sum() + 0.5) / (len(y) - y.sum() + 1.5))
        return net
    give_back()  # reading takes more than the network's passes
    doc, begin, size = cut_windows(np.bincount(word_doc, minlength=len(texts)))
    calibrating = np.zeros(len(texts), bool)
    for k in (0, 1):
        mine = rng.permutation(np.flatnonzero(y == k))
        calibrating[mine[: len(mine) // 5]] = True
    fitting = ~calibrating[doc]
    # Counts by document give each word and gram a first value, and the first rounds the windows to look at.
    word_odds, char_odds = first_odds(word_doc, codes, words, y, ~calibrating)
    net.w["word"][:, 0], net.w["char"][:, 0] = word_odds, char_odds
    odds = np.append(word_odds[words.row] + np.add.reduceat(char_odds[words.grams], words.first[:-1]) / np.diff(words.first), -9)
    guess = np.concatenate([odds[window_index(codes, begin[k : k + 8192], size[k : k + 8192], len(odds) - 1)[0]].max(axis=1) for k in range(0, len(begin), 8192)])
    adam = _Adam({k: v for k, v in net.w.items() if k not in ("scale", "shift")}, RATE)
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6)).astype(np.float32)
    for number in range(rounds):
        value = guess if number < 2 else net.window_logits(words, codes, begin, size)
        top = _argmax(doc[fitting], value[fitting])
        top = np.flatnonzero(fitting)[top]
        clean = np.flatnonzero(fitting & (y[doc] == 0))
        chosen = np.concatenate([top, rng.choice(clean, min(len(clean), len(top)), replace=False)])
        passes = -(-LEAST_STEPS // -(-len(chosen) // BATCH))  # a small sample is gone through again
        chosen = np.concatenate([rng.permutation(chosen) for _ in range(passes)])
        for k in range(0, len(chosen), BATCH):
            at = chosen[k : k + BATCH]
            index, mask = window_index(codes, begin[at], size[at], -1)
            some = np.unique(index[mask])
            x, (row, grams, n) = net.inputs(words, some)
            x = np.concatenate([x, np.zeros((1, x.shape[1]), np.float32)])
            local = np.where(mask, np.searchsorted(some, index), len(some))
            logit, saved = net.forward(x, local, mask, keep=True)
            d = (_sigmoid(logit) - y[doc[at]]) * weight[doc[at]] / np.float32(len(at))
            grads, d_x = net.backward(x, local, mask, saved, d.astype(np.float32))
            grads["word"] = np.zeros_like(net.w["word"])
            np.add.at(grads["word"], row, d_x[:-1, :WORD_DIM])
            grads["char"] = np.zeros_like(net.w["char"])
            np.add.at(grads["char"], grams, np.repeat(d_x[:-1, WORD_DIM:] / np.sqrt(n)[:, None].astype(np.float32), n, axis=0))
            adam.step(grads)
    value = net.window_logits(words, codes, begin, size)
    high = _highest(doc, value, len(texts), float(net.w["bias"][0]))
    scale, shift = fit_line(high[calibrating], y[calibrating])
    net.w["scale"][0], net.w["shift"][0] = scale, shift
    return net


def score_texts(net: BiGru, texts: pa.Array) -> np.ndarray:
    """Probabilities; a text without a word gets the network's score of nothing."""
    word_doc, codes, words = read_words(texts)
    doc, begin, size = cut_windows(np.bincount(word_doc, minlength=len(texts)))
    logit = _highest(doc, net.window_logits(words, codes, begin, size), len(texts), float(net.w["bias"][0]))
    return 1 / (1 + np.exp(-np.clip(net.w["scale"][0] * logit.astype(np.float64) + net.w["shift"][0], -30, 30)))


def train_on(docs: DataFrame, labels: DataFrame, sample: dict[int, int] | None = None) -> BiGru:
    """Fits on a bounded sample of the labelled documents outside the fold that is kept back."""
    rows = labelled_sample(docs, labels, "toxic", FOLDS, KEPT_BACK, sample or SAMPLE)
    return BiGru(fit_in_task(rows, lambda table: train(table["text"].to_pylist(), table["y"].to_numpy()).w))


def score(docs: DataFrame, net: BiGru) -> DataFrame:
    """The operator: ``docs`` rows' (doc_id, score). Null and empty texts are scored as texts without a word."""
    weights = docs.sparkSession.sparkContext.broadcast(net.w)  # about 1.2 MB, whatever the corpus
    return map_steps(narrow(docs, "doc_id", "text"), lambda b: batch_of(doc_id=ids_of(b), score=pa.array(score_texts(BiGru(weights.value), texts_of(b)))), "doc_id long, score double")


def keep_clean(docs: DataFrame, net: BiGru, threshold: float = 0.5) -> DataFrame:
    """``docs`` without those that score ``threshold`` or more; all columns stay."""
    weights = docs.sparkSession.sparkContext.broadcast(net.w)
    place = docs.columns.index("text")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(score_texts(BiGru(weights.value), batch.column(place)) < threshold))

    return map_steps(docs, work, docs.schema)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """op7's rows."""
    scored = score(docs, train_on(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id"), FOLDS, KEPT_BACK).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
