"""A character n-gram model with modified Kneser-Ney smoothing: counted, discounted and normalised in Spark, held in
sorted hash arrays, one model for each language.

Counts cover every document. Tasks count the n-grams of the highest order in numpy and Spark adds them up; the lower
orders' continuation counts, discounts and context weights are groupings of that table.

Scoring asks for no more than the shares of the distinct n-grams that occur. They are worked out in parts that meet the
model's parts in a shuffle. The most frequent ones, a number with a bound, are broadcast as one sorted array; whatever a
text holds beyond those is joined by its hash. So neither the driver nor a task holds what grows with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import STEP_BYTES, batch_of, cut, give_back, in_steps, stored, texts_of
from tidemark.llm.textblock import TextBlock, group_ids, mix

ORDER = 5
#: Stands before a text's first character.
START = "\x02"
#: Distinct n-grams that a counting task holds before it passes them on to Spark's sums.
HELD = 2_000_000
#: n-grams that it passes on at once.
ROWS = 100_000
#: Entries of the model that one task holds at once. A larger model is split by language and the two characters before the
#: predicted one, which decide all its entries of order 3 and up; the few of orders 1 and 2 go to every part.
PART_ENTRIES = 1_000_000
#: n-grams whose shares are broadcast, the most frequent first; 16 bytes each.
HEAD = 3_000_000
_P = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0x2545F4914F6CDD1D)


def lang_hashes(langs: pa.Array) -> np.ndarray:
    block = TextBlock(langs)
    return block.hashes(block.offs[:-1], block.offs[1:])


def coded(texts: pa.Array, order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points with order - 1 start marks before each text; the places of real characters; each one's text number."""
    block = TextBlock(texts)
    points = np.frombuffer(block.buf.tobytes().decode().encode("utf-32-le"), np.uint32)
    doc = np.repeat(np.arange(block.n), block.counts(block.chars()))
    place = np.arange(len(points)) + (order - 1) * (doc + 1)
    padded = np.full(len(points) + (order - 1) * block.n, ord(START), np.uint32)
    padded[place] = points
    return padded, place, doc


def gram_hash(columns: list[np.ndarray], lang: np.ndarray) -> np.ndarray:
    """Hash of n-grams given as one array of code points for each place, oldest first. No columns: the empty context."""
    h = lang + np.uint64(len(columns)) * _STEP
    for c in columns:
        h = mix((h + c.astype(np.uint64)) * _P)
    return h


def _quick(padded: np.ndarray, place: np.ndarray, lang: np.ndarray, order: int) -> np.ndarray:
    if 2 * len(place) < len(padded):
        h = lang.copy()
        for k in range(order - 1, -1, -1):
            h = (h + padded[place - k]) * _P
        return mix(h)
    # Most places are asked for: all are hashed side by side, which takes no index.
    points, ends = padded.astype(np.uint64), place - (order - 1)
    h = np.zeros(len(points) - order + 1, np.uint64)
    h[ends] = lang
    for k in range(order):
        h += points[k : k + len(h)]
        h *= _P
    return mix(h[ends])


def _strings(points: np.ndarray) -> pa.Array:
    """A string of each row's code points."""
    length = (1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)).sum(axis=1)
    edges = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
    data = points.astype("<u4").tobytes().decode("utf-32-le").encode()
    return pa.StringArray.from_buffers(len(points), pa.py_buffer(edges.tobytes()), pa.py_buffer(data))


def count_grams(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Rows (lang, gram, c) over all texts; a null language counts as ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def merged():
            h, lang, grams, n = (np.concatenate(x) for x in zip(*held, strict=True))
            codes, distinct = group_ids(h)
            at = np.zeros(len(distinct), np.int64)
            at[codes[::-1]] = np.arange(len(codes))[::-1]
            return distinct, lang[at], grams[at], np.bincount(codes, weights=n, minlength=len(distinct)).astype(np.int64)

        def rows(_, lang, grams, n):
            for k in range(0, len(n), ROWS):
                yield batch_of(lang=pa.array(lang[k : k + ROWS], pa.string()), gram=_strings(grams[k : k + ROWS]), c=pa.array(n[k : k + ROWS]))

        for step in in_steps(batches, size=4 * STEP_BYTES):
            langs = texts_of(step, "lang")
            padded, place, doc = coded(texts_of(step), order)
            if not len(place):
                continue
            names = np.array([x or "" for x in langs.to_pylist()], object)
            codes, distinct = group_ids(_quick(padded, place, lang_hashes(langs)[doc], order))
            at = np.zeros(len(distinct), np.int64)
            at[codes[::-1]] = np.arange(len(codes))[::-1]
            held.append((distinct, names[doc[at]], padded[place[at][:, None] + np.arange(1 - order, 1)], np.bincount(codes)))
            size += len(distinct)
            if size > HELD:
                held = [merged()]
                size = len(held[0][0])
                if 2 * size > HELD:
                    yield from rows(*held[0])
                    held, size = [], 0
        if held:
            held = [merged()]
            yield from rows(*held[0])
        held = step = padded = place = doc = codes = distinct = at = names = None
        give_back()

    return docs.select("text", "lang").mapInArrow(run, "lang string, gram string, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def _discounts(counts: DataFrame) -> DataFrame:
    """(lang, d1, d2, d3) from the numbers of n-grams seen once to four times."""
    seen = counts.groupBy("lang").agg(*[F.sum((F.col("c") == k).cast("double")).alias(f"n{k}") for k in (1, 2, 3, 4)])
    y = F.col("n1") / F.nullif(F.col("n1") + 2 * F.col("n2"), F.lit(0.0))

    def d(k: int) -> Column:
        value = k - (k + 1) * y * F.col(f"n{k + 1}") / F.nullif(F.col(f"n{k}"), F.lit(0.0))
        return F.greatest(F.least(F.coalesce(value, F.lit(0.5 * k)), F.lit(0.95 * k)), F.lit(0.05)).alias(f"d{k}")

    return seen.select("lang", d(1), d(2), d(3))


def fit(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """The model as rows (lang, kind, gram, value), stored in the shared folder.

    Kind n in 1 to ``order``: the discounted share of an n-gram under its context. Kind -n: the weight that the context
    of an n-gram hands down to order n - 1. Kind 0: the share of each character that no n-gram knows.
    """
    return fit_counts(stored(count_grams(docs, order), "grams"), order)


def fit_counts(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """The model of these rows (lang, gram, c), a stored table. Each order takes one shuffle, by language and context:
    no context has more rows than there are characters. The few discounts are broadcast: a row for each language."""
    parts = []
    for n in range(order, 0, -1):
        taken = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        cut_down = counts.join(F.broadcast(_discounts(counts)), "lang").withColumn("taken", taken).withColumn("context", F.substring("gram", 1, n - 1))
        alike = Window.partitionBy("lang", "context")
        totals = cut_down.select("lang", "gram", "context", "c", "taken", F.sum("c").over(alike).alias("total"), F.sum("taken").over(alike).alias("freed"), F.row_number().over(alike.orderBy("gram")).alias("place"))
        entry = lambda kind, gram, value: F.struct(F.lit(kind).alias("kind"), F.col(gram).alias("gram"), value.alias("value"))
        share = entry(n, "gram", F.greatest(F.col("c") - F.col("taken"), F.lit(0.0)) / F.col("total"))
        weight = entry(-n, "context", F.col("freed") / F.col("total"))
        parts.append(totals.select("lang", F.inline(F.when(F.col("place") == 1, F.array(share, weight)).otherwise(F.array(share)))))
        if n == 1:
            parts.append(counts.groupBy("lang").agg((1 / (F.count("*") + 1.0)).alias("value")).select("lang", F.lit(0).alias("kind"), F.lit("").alias("gram"), "value"))
        else:  # an n-gram's continuation count: the distinct characters seen before it
            counts = cut(counts.groupBy("lang", F.substring("gram", 2, n - 1).alias("gram")).agg(F.count("*").alias("c")))
    model = parts[0]
    for p in parts[1:]:
        model = model.unionByName(p)
    return stored(model, "kneser-ney")


class HashArrays:
    """By kind, sorted hashes and their values."""

    def __init__(self, kind: np.ndarray, key: np.ndarray, value: np.ndarray):
        self.tables = {}
        for k in np.unique(kind):
            mine = np.flatnonzero(kind == k)
            mine = mine[np.argsort(key[mine])]
            self.tables[int(k)] = key[mine], value[mine].astype(np.float32)

    def get(self, kind: int, key: np.ndarray, missing: float) -> np.ndarray:
        keys, values = self.tables.get(kind, (np.zeros(0, np.uint64), np.zeros(0, np.float32)))
        if not len(keys):
            return np.full(len(key), missing, np.float64)
        known, at = found_in(keys, key)
        return np.where(known, values[at], missing)


def _points(grams: pa.Array, size: int) -> list[np.ndarray]:
    """The code points of texts of ``size`` characters each, by place."""
    flat = np.frombuffer("".join(grams.to_pylist()).encode("utf-32-le"), np.uint32) if size else np.zeros(0, np.uint32)
    return [flat[i::size] for i in range(size)]


def hashed(model: DataFrame, *more: str) -> DataFrame:
    """Rows (kind, key, value) of a stored model, hashed as the scorer hashes; columns of ``more`` (numbers) go along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, kind = lang_hashes(batch.column(0)), batch.column(1).to_numpy()
            grams, key = batch.column(2), np.zeros(batch.num_rows, np.uint64)
            for k in np.unique(kind):
                size, mine = (int(k) if k > 0 else max(-int(k) - 1, 0)), np.flatnonzero(kind == k)
                key[mine] = gram_hash(_points(grams.take(pa.array(mine)), size), lang[mine])
            yield batch_of(kind=batch.column(1), key=pa.array(key.view(np.int64)), value=batch.column(3), **{n: batch.column(4 + i) for i, n in enumerate(more)})

    return model.select("lang", "kind", "gram", "value", *more).mapInArrow(run, "kind int, key long, value double" + "".join(f", {n} int" for n in more))


def _pair() -> Column:
    """The two characters before the predicted one, of an entry of order 3 and up; they decide all such entries that an n-gram asks for."""
    return F.when(F.col("kind") >= 3, F.substring(F.col("gram"), F.length("gram") - 2, F.lit(2))).otherwise(F.substring(F.col("gram"), F.length("gram") - 1, F.lit(2)))


def model_parts(model: DataFrame, part_entries: int = PART_ENTRIES) -> Iterator[tuple[HashArrays, int, int]]:
    """For a look at a small model from the driver: (arrays, part number, parts); each part's arrays hold about
    ``part_entries`` entries beside those of orders 1 and 2. Scoring a corpus goes by ``shares_of``."""
    large = F.col("kind").between(-2, 2)
    parts = max(1, -(-model.where(~large).count() // part_entries))
    for k in range(parts):
        some = model if parts == 1 else model.where(large | (F.pmod(F.crc32(F.encode(_pair(), "UTF-8")), F.lit(parts)) == k))
        rows = hashed(some).toArrow()
        yield HashArrays(rows["kind"].to_numpy(), rows["key"].to_numpy().view(np.uint64), rows["value"].to_numpy()), k, parts


def _shares(arrays: HashArrays, back: list[np.ndarray], lang: np.ndarray) -> np.ndarray:
    """Log shares of n-grams given by place, the predicted character first and the oldest last."""
    share = arrays.get(0, gram_hash([], lang), 1e-6)
    for n in range(1, len(back) + 1):
        gram = [back[k] for k in range(n - 1, -1, -1)]
        share = arrays.get(n, gram_hash(gram, lang), 0.0) + arrays.get(-n, gram_hash(gram[:-1], lang), 1.0) * share
    return np.log(np.maximum(share, 1e-12))


def log_shares(arrays: HashArrays, padded: np.ndarray, place: np.ndarray, lang: np.ndarray, order: int = ORDER, part: tuple[int, int] = (0, 1)) -> np.ndarray:
    """Log share of each real character given the order - 1 before it; 0 where another part of the model decides it."""
    if not len(place):
        return np.zeros(0)
    codes, distinct = group_ids(_quick(padded, place, lang, order))
    at = np.zeros(len(distinct), np.int64)
    at[codes[::-1]] = np.arange(len(codes))[::-1]
    back = [padded[place[at] - k] for k in range(order)]
    value = _shares(arrays, back, lang[at])
    if part[1] > 1:
        import zlib

        pairs = np.stack([back[2], back[1]], axis=1)
        kinds, which = np.unique(pairs, axis=0, return_inverse=True)
        owner = np.array([zlib.crc32((chr(a) + chr(b)).encode()) % part[1] for a, b in kinds.tolist()])
        value = np.where(owner[which.ravel()] == part[0], value, 0.0)
    return value[codes]


def shares_of(model: DataFrame, wanted: DataFrame, part_entries: int = PART_ENTRIES, order: int = ORDER) -> DataFrame:
    """Rows (key, value, c), stored: the log share of each n-gram of ``wanted`` (judge, gram, c) under the model named
    ``judge``, by the hash that ``score`` looks for. Each part of n-grams meets its part of the model in one task.

    A model and a pair of characters before the predicted one make a part's smallest piece. A pair of more than
    ``part_entries`` entries is split further by the predicted character: its shares go each to one piece, the weights of
    its contexts, which know no predicted character, to all of them.
    """
    large = F.col("kind").between(-2, 2)
    deep = model.where(~large).withColumn("pair", _pair())
    sizes = cut(deep.groupBy("lang", "pair").agg(F.count("*").alias("n")))
    parts = max(1, -(-(sizes.agg(F.sum("n")).first()[0] or 0) // part_entries))
    # Each row stands for over part_entries entries of the model, so there are no more rows than parts.
    crowded = F.broadcast(sizes.where(F.col("n") > part_entries).select("lang", "pair", F.ceil(F.col("n") / part_entries).cast("int").alias("splits")))
    splits = F.coalesce("splits", F.lit(1))
    of_last = F.pmod(F.crc32(F.encode(F.expr("right(gram, 1)"), "UTF-8")), splits)

    def part(lang: str) -> Column:
        return F.pmod(F.crc32(F.encode(F.concat_ws("/", F.col("split").cast("string"), lang, "pair"), "UTF-8")), F.lit(parts)).cast("int").alias("part")

    pieces = F.when(F.col("kind") > 0, F.array(of_last)).otherwise(F.sequence(F.lit(0).cast("long"), splits.cast("long") - 1))
    placed = deep.join(crowded, ["lang", "pair"], "left").withColumn("split", F.explode(pieces)).select(*model.columns, part("lang"))
    everywhere = model.where(large).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    dealt = hashed(placed.unionByName(everywhere), "part")
    asked = wanted.withColumn("pair", F.substring("gram", order - 2, 2)).join(crowded.withColumnRenamed("lang", "judge"), ["judge", "pair"], "left")
    asked = asked.withColumn("split", of_last).select("judge", "gram", "c", part("judge"))

    def work(entries: pa.Table, grams: pa.Table) -> pa.Table:
        arrays = HashArrays(entries["kind"].to_numpy(), entries["key"].to_numpy().view(np.uint64), entries["value"].to_numpy())
        keys, values = [np.zeros(0, np.uint64)], [np.zeros(0)]
        for batch in grams.to_batches():
            lang = lang_hashes(batch.column(0))
            by_place = _points(batch.column(1), order)
            padded = np.stack(by_place, axis=1).ravel()
            keys.append(_quick(padded, np.arange(len(lang)) * order + order - 1, lang, order))
            values.append(_shares(arrays, by_place[::-1], lang))
        del arrays
        give_back()
        return pa.table({"key": np.concatenate(keys).view(np.int64), "value": np.concatenate(values).astype(np.float32), "c": grams["c"]})

    return stored(dealt.groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(work, "key long, value float, c long"), "shares")


def head_of(shares: DataFrame, most: int = HEAD) -> tuple[np.ndarray, np.ndarray, bool]:
    """Sorted keys and values of the most frequent n-grams, ``most`` at most, and whether those are all. The bar that
    they pass is the least power of two that leaves few enough."""
    bars = [1 << k for k in range(41)]
    n = shares.agg(*[F.sum((F.col("c") >= b).cast("long")).alias(f"n{k}") for k, b in enumerate(bars)]).first()
    at = next((k for k in range(41) if (n[k] or 0) <= most), 40)
    rows = shares.where(F.col("c") >= bars[at]).select("key", "value").toArrow()
    key, value = rows["key"].to_numpy().view(np.uint64), rows["value"].to_numpy()
    order = np.argsort(key)
    return key[order], value[order], at == 0


def found_in(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each of ``wanted`` is one of the sorted ``keys``, and where. Sought in order, neighbours find the memory that a
    search reads still at hand; out of order, a search of millions of keys waits for memory at each of its steps."""
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    order = np.argsort(wanted)
    at = np.empty(len(wanted), np.int64)
    at[order] = np.searchsorted(keys, wanted[order])
    at = np.minimum(at, len(keys) - 1)
    return keys[at] == wanted, at


def look_up(head: tuple[np.ndarray, np.ndarray], padded: np.ndarray, place: np.ndarray, doc: np.ndarray, lang: np.ndarray, n: int, order: int = ORDER) -> tuple[np.ndarray, tuple]:
    """By text, the sum of its characters' log shares as far as the head tells them; and the n-grams that it doesn't hold,
    as (text number, key, times), by text."""
    if not len(place):
        return np.zeros(n), (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    keys, values = head
    codes, distinct = group_ids(_quick(padded, place, lang, order))
    known, at = found_in(keys, distinct)
    share = np.where(known, values[at], 0.0) if len(keys) else np.zeros(len(distinct))
    total = np.bincount(doc, weights=share[codes], minlength=n)
    beyond = np.flatnonzero(~known[codes])
    pair, times = np.unique(np.stack([doc[beyond], codes[beyond]], axis=1), axis=0, return_counts=True)
    return total, (pair[:, 0], distinct[pair[:, 1]], times)
