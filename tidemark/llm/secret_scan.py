"""3. Secret scans: pattern findings, and a character convolutional network over every candidate with its context.

Candidates are the findings of the base patterns and every other long run of token characters, or part of one left
outside those findings, that holds a digit and isn't plain decimal. Of a candidate longer than the network's window,
overlapping windows are read and the highest score counts. The network learns from labelled findings: those of a bounded sample of documents, labelled by
the base patterns, with the pattern's own key word blanked in half of them so that the value and its
surroundings must tell, drawn examples of known formats and of harmless look-alikes, and secrets of formats that no base
pattern knows, planted in the sample's texts. Other runs of the sample teach only where a rule shows them harmless. The
threshold is calibrated on secrets held back: the highest that keeps the wanted recall of all and of the planted ones.
Base findings stay whatever the network says.
"""

from __future__ import annotations

import re
import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import batch_of, ids_of, map_steps, narrow, stored, texts_of
from tidemark.llm.sampling import SAMPLE_BYTES, first_ids, fit_in_task, told
from tidemark.llm.textblock import TextBlock

# fixed values: the base patterns and their least lengths
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex", "net")

#: Characters of a run that may be a secret, and how many such a run has at least.
TOKEN = np.zeros(256, bool)
TOKEN[[ord(c) for c in string.ascii_letters + string.digits + "+/_.=-"]] = True
LEAST_TOKEN = 16
_TOKEN_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % LEAST_TOKEN)
_HEX_BYTES = np.zeros(256, bool)
_HEX_BYTES[[ord(c) for c in "0123456789abcdef"]] = True
_KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: The network reads so many characters before a candidate, of it, and after it.
BEFORE, INSIDE, AFTER = 20, 44, 12
WIDTH, FILTERS, EMBED, HIDDEN = 5, 24, 10, 16
RECALL = 0.99
#: The bound of the training sample, by the order of a hash of the id: of so many documents at most so many with candidates.
SAMPLE_POOL, SAMPLE_DOCUMENTS = 40_000, 4_000
#: Words of the sample that drawn and planted examples are made of, chosen by lot.
SAMPLE_WORDS = 5_000
PLANTED = 1_000
DRAWN, ROUNDS, BATCH, RATE, SEED = 1_500, 6, 128, 0.01, 11
ALPHABET = 100
BLANK, OTHER = 0, 1


def _codes(text: str) -> list[int]:
    """Printable ASCII by its own number; 1: anything else; 0 is left for nothing."""
    return [ord(c) - 30 if 31 < ord(c) < 127 else 97 if c in "\n\t\r" else OTHER for c in text]


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int


def base_spans(text: str) -> list[Span]:
    """Findings of the base patterns: leftmost and not overlapping within a kind; matches that are too short are dropped."""
    out = [Span("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    out += [Span("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [Span("hex", m.start(), m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST_HEX]
    return ordered(out)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


def candidates(text: str) -> tuple[list[Span], list[Span]]:
    """Base findings, and the parts outside them of runs of token characters that might be secrets."""
    base, free, k, covered = base_spans(text), [], 0, 0
    for m in _TOKEN_RUN.finditer(text):
        at, parts = m.start(), []
        while k < len(base) and base[k].start < m.end():
            parts.append((max(at, covered), base[k].start))
            covered = max(covered, base[k].end)
            k += 1
        parts.append((max(at, covered), m.end()))
        for start, end in parts:
            run = text[start:end]
            if len(run) >= LEAST_TOKEN and any(c.isdigit() for c in run) and any(c.isalpha() for c in run):
                free.append(Span("net", start, end))
    return base, free


def pieces(span: Span) -> list[Span]:
    """The span in pieces that the network can read: up to INSIDE characters each, every two neighbours overlapping by half or more."""
    last = span.end - INSIDE
    starts = [*range(span.start, last, INSIDE // 2), last] if last > span.start else [span.start]
    return [Span(span.kind, a, min(a + INSIDE, span.end)) for a in starts]


def encode(text: str, span: Span, hide_key: bool = False) -> np.ndarray:
    """The window of character numbers that the network reads of a span of up to INSIDE characters."""
    start, end = span.start, span.end
    before = text[max(0, start - BEFORE) : start]
    inside, after = text[start:end], text[end : end + AFTER]
    if hide_key and span.kind == "assign" and (m := ASSIGN.match(inside)):
        inside = m[2]
    window = np.zeros(BEFORE + INSIDE + AFTER, np.int64)
    if before:
        window[BEFORE - len(before) : BEFORE] = _codes(before)
    window[BEFORE : BEFORE + len(inside)] = _codes(inside)
    window[BEFORE + INSIDE : BEFORE + INSIDE + len(after)] = _codes(after)
    return window


def windows_of(text: str, span: Span, hide_key: bool = False) -> list[np.ndarray]:
    return [encode(text, piece, hide_key) for piece in pieces(span)]


def highest(net: CharCnn, windows: list[list[np.ndarray]]) -> np.ndarray:
    """For each span's windows, the highest of their scores."""
    if not windows:
        return np.zeros(0)
    sizes = np.array([len(w) for w in windows])
    return np.maximum.reduceat(net.scores(np.array([x for w in windows for x in w])), np.cumsum(sizes) - sizes)


class CharCnn:
    """Embedding, one convolution, the greatest response over the candidate and over its context, and two dense layers."""

    def __init__(self, weights: dict[str, np.ndarray] | None = None, seed: int = SEED):
        if weights is None:
            rng = np.random.default_rng(seed)
            normal = lambda *shape: (rng.standard_normal(shape) * (shape[0] or 1) ** -0.5).astype(np.float32)
            weights = {
                "embed": (rng.standard_normal((ALPHABET, EMBED)) * 0.5).astype(np.float32),
                "filter": normal(WIDTH * EMBED, FILTERS), "filter_bias": np.zeros(FILTERS, np.float32),
                "dense": normal(3 * FILTERS, HIDDEN), "dense_bias": np.zeros(HIDDEN, np.float32), "out": normal(HIDDEN, 1)[:, 0], "bias": np.zeros(1, np.float32),
                "scale": np.ones(1, np.float32), "shift": np.zeros(1, np.float32), "threshold": np.full(1, 0.5, np.float32),
            }
        self.w = weights

    #: Places of the convolution that begin before, in and after the candidate.
    ZONES = (slice(0, BEFORE), slice(BEFORE, BEFORE + INSIDE - WIDTH + 1), slice(BEFORE + INSIDE - WIDTH + 1, BEFORE + INSIDE + AFTER - WIDTH + 1))

    def forward(self, windows: np.ndarray):
        w = self.w
        embedded = w["embed"][windows] * (windows > 0)[:, :, None]
        n = windows.shape[1] - WIDTH + 1
        patches = np.concatenate([embedded[:, k : k + n] for k in range(WIDTH)], axis=2)
        response = np.maximum(patches @ w["filter"] + w["filter_bias"], 0)
        top = np.concatenate([response[:, z].max(axis=1) for z in self.ZONES], axis=1)
        hidden = np.maximum(top @ w["dense"] + w["dense_bias"], 0)
        return hidden @ w["out"] + w["bias"][0], (patches, response, top, hidden)

    def backward(self, windows: np.ndarray, saved: tuple, d: np.ndarray) -> dict[str, np.ndarray]:
        w, (patches, response, top, hidden) = self.w, saved
        grads = {"bias": d.sum(keepdims=True), "out": hidden.T @ d}
        d_hidden = d[:, None] * w["out"] * (hidden > 0)
        grads |= {"dense": top.T @ d_hidden, "dense_bias": d_hidden.sum(axis=0)}
        d_top = d_hidden @ w["dense"].T
        d_response = np.zeros_like(response)
        row, col = np.arange(len(windows))[:, None], np.arange(FILTERS)[None, :]
        for k, z in enumerate(self.ZONES):
            at = response[:, z].argmax(axis=1) + z.start
            d_response[row, at, col] += d_top[:, k * FILTERS : (k + 1) * FILTERS]
        d_response *= response > 0
        grads |= {"filter": np.einsum("wpi,wpf->if", patches, d_response, optimize=True), "filter_bias": d_response.sum(axis=(0, 1))}
        d_patches = d_response @ w["filter"].T
        d_embedded = np.zeros((*windows.shape, EMBED), np.float32)
        n = patches.shape[1]
        for k in range(WIDTH):
            d_embedded[:, k : k + n] += d_patches[:, :, k * EMBED : (k + 1) * EMBED]
        grads["embed"] = np.zeros_like(w["embed"])
        np.add.at(grads["embed"], windows[windows > 0], d_embedded[windows > 0])
        return grads

    def scores(self, windows: np.ndarray) -> np.ndarray:
        """Calibrated probabilities."""
        out = np.zeros(len(windows))
        for k in range(0, len(windows), 512):
            logit = self.forward(windows[k : k + 512])[0].astype(np.float64)
            out[k : k + 512] = 1 / (1 + np.exp(-np.clip(self.w["scale"][0] * logit + self.w["shift"][0], -30, 30)))
        return out


#: Parts of addresses and paths that are harmless beside the words of the texts; and what a harmless part looks like.
_PLAIN = frozenset("www com org net edu html htm http https mail example index path page file img src docs data user api test".split())
_WORD_PART = re.compile(r"([A-Za-z]{1,12})[0-9]{0,4}")
_NUMBER_PART = re.compile(r"[0-9]{1,8}|[0-9]{1,2}T[0-9]{2}|[0-9]{2}Z")


def shown_harmless(run: str, words: set[str]) -> bool:
    """Whether a run is made of nothing but short numbers, dates, and words of the texts with up to four digits behind."""
    for part in filter(None, re.split(r"[+/_.=-]+", run)):
        word = _WORD_PART.fullmatch(part)
        if not _NUMBER_PART.fullmatch(part) and not (word and (word[1] in words or word[1].lower() in _PLAIN)):
            return False
    return True


def _secrets(rng: np.random.Generator) -> tuple:
    """Drawing functions of secrets: the last four are of formats that no base pattern knows."""
    pick = lambda alphabet, size: "".join(rng.choice(list(alphabet), size))
    letters, digits = string.ascii_letters, string.digits
    return (
        lambda: pick("0123456789abcdef", rng.integers(24, 65)),
        lambda: "AKIA" + pick(string.ascii_uppercase + digits, 16),
        lambda: pick(letters + digits, rng.integers(20, 44)),
        lambda: pick(letters + digits + "+/", rng.integers(24, 60)) + "=" * int(rng.integers(0, 3)),
        lambda: rng.choice(["ghp_", "gho_", "xoxb-", "sk_live_", "pk_live_", "glpat-"]) + pick(letters + digits, 30),
        lambda: "eyJ" + pick(letters + digits, 30) + "." + pick(letters + digits + "_-", 40),
    )


def _planted(rng: np.random.Generator, texts: list[str], words: list[str], n: int) -> list[list[np.ndarray]]:
    """Windows of secrets that no base pattern finds, each put before a word of one of the texts: half of them alone, the
    others joined to words of the texts in a long run. Of a long run: the windows that hold some of the secret."""
    texts, out = [t for t in texts if " " in t], []
    some = lambda: [words[i] for i in rng.integers(0, len(words), rng.integers(1, 9))]
    for k in range(n if texts else 0):
        text = texts[rng.integers(0, len(texts))]
        at = text.find(" ", rng.integers(0, len(text)))
        at = text.find(" ") if at < 0 else at
        value = _secrets(rng)[rng.integers(2, 6)]()
        by = str(rng.choice(["/", "=", ".", "-", "_"]))
        lead, trail = (by.join([*some(), ""]), by.join(["", *some()])) if k % 2 else ("", "")
        before, after = text[max(0, at - 2 * BEFORE) : at + 1], text[at : at + AFTER]
        if not base_spans(lead + value + trail):
            start = len(before) + len(lead)
            run = Span("net", len(before), start + len(value) + len(trail))
            read = [p for p in pieces(run) if min(p.end, start + len(value)) - max(p.start, start) >= LEAST_TOKEN]
            out.append([encode(before + lead + value + trail + after, p) for p in read])
    return out


def _drawn(rng: np.random.Generator, words: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Examples of known formats (1) and of harmless look-alikes (0), among words of the corpus."""
    pick = lambda alphabet, size: "".join(rng.choice(list(alphabet), size))
    digits = string.digits
    some = lambda k: [words[i] for i in rng.integers(0, len(words), k)]
    secret = _secrets(rng)
    harmless = (
        lambda: "-".join(some(3)) + str(rng.integers(0, 100)),
        lambda: "/".join(some(3)) + f"/{rng.integers(0, 10_000)}",
        lambda: f"{rng.integers(1990, 2030)}-{rng.integers(1, 13):02}-{rng.integers(1, 29):02}T{rng.integers(0, 24):02}.{rng.integers(0, 60):02}Z",
        lambda: f"www.{''.join(some(2))}.com/{some(1)[0]}{rng.integers(0, 100)}",
        lambda: "_".join(some(4)) + f"_v{rng.integers(0, 10)}",
        lambda: f"{some(1)[0]}.{some(1)[0]}{rng.integers(0, 999)}-{some(1)[0]}.html",
        lambda: "=".join(some(2)) + pick(digits, 6) + "...." + some(1)[0],
        lambda: "".join(some(4)) + pick(digits, 1),
    )
    windows, y = [], []
    for k in range(n):
        label = k % 2
        value = (secret if label else harmless)[rng.integers(0, len(secret if label else harmless))]()
        lead = " ".join(some(4)) + rng.choice([" ", ": ", " = ", '="', " '", "\n"])
        read = windows_of(f"{lead}{value} {' '.join(some(3))}", Span("net", len(lead), len(lead) + len(value)))
        windows += read
        y += [label] * len(read)
    return np.array(windows), np.array(y)


def threshold_for(secret: np.ndarray, recall: float = RECALL) -> np.float32:
    """The highest threshold that at least ``recall`` of these scores of secrets reach, however low that is."""
    if not len(secret):
        return np.float32(0)
    wanted = np.sort(secret)[int((1 - recall) * len(secret))]
    found = np.float32(wanted)  # the weights' precision: rounded down, so that the score itself still reaches it
    return found if found <= wanted else np.nextafter(found, np.float32(0))


def train(texts: list[str], recall: float = RECALL, seed: int = SEED) -> CharCnn:
    """Fits on the findings of ``texts``, on drawn and on planted examples; a fifth of them calibrates."""
    from tidemark.llm.toxicity import _Adam, fit_line

    rng, windows, y, words = np.random.default_rng(seed), [], [], set()
    for text in texts:
        words.update(w for w in text.split() if w.isalpha())
    for text in texts:
        base, free = candidates(text)
        for number, span in enumerate(base):
            windows += windows_of(text, span, hide_key=number % 2 == 0)
        y += [1] * (len(windows) - len(y))
        for span in free:
            if shown_harmless(text[span.start : span.end], words):
                windows += windows_of(text, span)
        y += [0] * (len(windows) - len(y))
    some_words = rng.permutation(sorted(words))[:SAMPLE_WORDS].tolist() or ["and", "the", "of"]
    planted = _planted(rng, texts, some_words, PLANTED)
    held, planted = planted[: len(planted) // 5], planted[len(planted) // 5 :]
    drawn, drawn_y = _drawn(rng, some_words, DRAWN)
    taught = [w for one in planted for w in one]
    x = np.concatenate([np.array(part) for part in (windows, taught, drawn) if len(part)])
    y = np.concatenate([np.array(y, np.int64), np.ones(len(taught), np.int64), drawn_y]).astype(np.float32)
    order = rng.permutation(len(y))
    back, fit = order[: len(y) // 5], order[len(y) // 5 :]
    net = CharCnn(seed=seed)
    adam = _Adam({k: v for k, v in net.w.items() if k not in ("scale", "shift", "threshold")}, RATE)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    for _ in range(ROUNDS):
        fit = rng.permutation(fit)
        for k in range(0, len(fit), BATCH):
            at = fit[k : k + BATCH]
            logit, saved = net.forward(x[at])
            d = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[at]) * weight[at] / len(at)
            adam.step(net.backward(x[at], saved, d.astype(np.float32)))
    logit = np.concatenate([net.forward(x[back[k : k + 512]])[0] for k in range(0, len(back), 512)])
    net.w["scale"][0], net.w["shift"][0] = fit_line(logit.astype(np.float64), y[back])
    of_all = threshold_for(net.scores(x[back[y[back] == 1]]), recall)
    net.w["threshold"][0] = min(of_all, threshold_for(highest(net, held), recall)) if held else of_all
    return net


def flagged(texts: pa.Array) -> np.ndarray:
    """Texts that can hold a base finding or a candidate: a cheap test on bytes that passes every one that does."""
    block = TextBlock(texts)
    starts, ends, doc = block.spans(TOKEN)
    long = ends - starts >= LEAST_TOKEN
    maybe = np.bincount(doc[long], minlength=block.n) > 0
    starts, ends, doc = block.spans(_HEX_BYTES)
    maybe |= np.bincount(doc[ends - starts >= LEAST_HEX], minlength=block.n) > 0
    low = TextBlock(texts, lower=True).buf.tobytes()
    for key in _KEYS:
        at, found = low.find(key.encode()), []
        while at >= 0:
            found.append(at)
            at = low.find(key.encode(), at + 1)
        maybe[block.doc_at(np.array(found, np.int64))] = True
    return maybe


def scan_text(text: str, net: CharCnn) -> tuple[list[Span], list[Span], list[float]]:
    """Base findings, all findings, and the network's probability for each of those."""
    base, free = candidates(text)
    spans = ordered([*base, *free])
    if not spans:
        return [], [], []
    scores = highest(net, [windows_of(text, s) for s in spans])
    kept = [(s, float(p)) for s, p in zip(spans, scores, strict=True) if s.kind != "net" or p >= net.w["threshold"][0]]
    return base, [s for s, _ in kept], [p for _, p in kept]


def training_sample(docs: DataFrame, pool: int = SAMPLE_POOL, sample: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """Rows (doc_id, text), stored: of the ``pool`` ids that come first by a hash, the first ``sample`` whose text, of up to
    32 KiB, holds a key word or a long run with a digit. Ids alone are ordered; texts are picked in one scan. An id that
    repeats teaches one text."""
    likely = F.col("text").rlike(r"(?i)(password|passwd|secret|token|api_?key)|AKIA|[A-Za-z0-9+/_.=-]{%d}" % LEAST_TOKEN)
    near = narrow(docs, "doc_id", "text").join(F.broadcast(first_ids(docs, pool)), "doc_id", "left_semi")
    found = stored(near.where((F.octet_length("text") <= SAMPLE_BYTES) & likely).groupBy("doc_id").agg(F.min("text").alias("text")), "secret-sample")
    return told(found.join(F.broadcast(first_ids(found, sample)), "doc_id", "left_semi"), "secrets")


def train_on(docs: DataFrame, sample: int = SAMPLE_DOCUMENTS) -> CharCnn:
    """Fits on a bounded sample of the documents."""
    return CharCnn(fit_in_task(training_sample(docs, sample=sample), lambda t: train(t["text"].to_pylist()).w))


SPAN = "array<struct<kind:string,start:long,end:long,score:double>>"


def find_secrets(docs: DataFrame, net: CharCnn) -> DataFrame:
    """The operator: (doc_id, base, found) for each row of ``docs``: spans in code points, ends exclusive, by start.
    Null and empty texts hold none. Repeated rows repeat; further columns are ignored; an empty table gives no rows."""
    weights = docs.sparkSession.sparkContext.broadcast(net.w)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, model = texts_of(batch), CharCnn(weights.value)
        base, found = [[] for _ in range(batch.num_rows)], [[] for _ in range(batch.num_rows)]
        for k in np.flatnonzero(flagged(texts)).tolist():
            b, spans, scores = scan_text(texts[k].as_py(), model)
            base[k] = [{"kind": s.kind, "start": s.start, "end": s.end, "score": None} for s in b]
            found[k] = [{"kind": s.kind, "start": s.start, "end": s.end, "score": p} for s, p in zip(spans, scores, strict=True)]
        return batch_of(doc_id=ids_of(batch), base=pa.array(base, kind), found=pa.array(found, kind))

    return map_steps(narrow(docs, "doc_id", "text"), work, f"doc_id long, base {SPAN}, found {SPAN}")


def redact(docs: DataFrame, net: CharCnn) -> DataFrame:
    """``docs`` with every finding's text replaced by ``[SECRET]``; overlapping findings become one. ``n_chars``,
    where there is one, follows the text. Texts without a finding, null ones too, stay as they are."""
    weights = docs.sparkSession.sparkContext.broadcast(net.w)
    names = docs.columns
    place = names.index("text")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, model = batch.column(place), CharCnn(weights.value)
        out, columns = texts.to_pylist(), list(batch.columns)
        sizes = columns[names.index("n_chars")].to_pylist() if "n_chars" in names else None
        for k in np.flatnonzero(flagged(texts)).tolist():
            spans = scan_text(out[k], model)[1]
            if not spans:
                continue
            parts, at = [], 0
            for s in spans:
                if s.start >= at:
                    parts += [out[k][at : s.start], "[SECRET]"]
                at = max(at, s.end)
            out[k] = "".join([*parts, out[k][at:]])
            if sizes:
                sizes[k] = len(out[k])
        columns[place] = pa.array(out, pa.string())
        if sizes:
            at = names.index("n_chars")
            columns[at] = pa.array(sizes, columns[at].type)
        return pa.RecordBatch.from_arrays(columns, names=names)

    return map_steps(docs, work, docs.schema)


def listed(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def digest(docs: DataFrame) -> DataFrame:
    """op3's rows."""
    found = find_secrets(docs, train_on(docs))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[number(k) for k in KINDS[:3]], F.sha2(joined("base"), 256).alias("base_sha256"), joined("found").alias("spans"))
