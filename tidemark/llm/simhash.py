"""9. SimHash near-duplicate groups, found by anchor-point covering.

Groups by fingerprint (``fingerprint_groups``): a 64-bit fingerprint is looked at as two halves. Fingerprints that differ in at most three bits differ in at most one
bit of some half. On each half, the anchors are the words of a covering code: the perfect Hamming code of 31 bits,
and either value of the last bit. Its covering radius is 1, so each half has its own anchor at most one bit away, and
that anchor is at most 1 + 1 bits away from the same half of any partner. Each fingerprint therefore goes to every
anchor within radius plus threshold, 17 of 2**27 at most on each half, and whatever is compared is compared within an anchor.

Groups by similarity (``near_duplicates``): sets of five-word shingles of which 0.8 or more are common differ in some 15 % of
SimHash bits, far beyond three. There a fingerprint of 640 bits is looked at through PROJECTIONS lots of 35 of its bits. The
anchors of a lot are the words of the product of five perfect Hamming codes of 7 bits, of which one is within the covering
radius of any word, so each fingerprint goes to one anchor a lot. Of those that it meets there, the closest before and
after it, and the most central under a full anchor, are measured exactly on their shingles; in further rounds, the closest that no link connects to it yet and the one
of most links of those connected to that. This makes one of a group of near copies, however large, by few pairs.

Pairs that this doesn't link are found by an exact way. With the shingles of all sets in one order, the rare ones first, two
sets of that similarity share a shingle among their heads, of about a fifth of a set. Texts that share one, and that no link
connects yet, are measured if their sizes and the places of the shared shingle allow the similarity. So no pair is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import STEP_BYTES, batch_of, cut, ids_of, map_steps, narrow, stored, tasks_for, texts_of, with_maybe
from tidemark.llm.components import HUBS, connected_components, gathered, join_hubs
from tidemark.llm.textblock import NOT_SPACE, U64, TextBlock, mix, windows

SHINGLE, BITS, SEED = 3, 3, 42
#: Fingerprints under one anchor that a task compares at once; larger anchors are compared in pairs of blocks of this size.
BLOCK = 2048
#: Anchors with up to so many fingerprints are compared together in one vectorised step.
SMALL = 48


def _shingle_hashes(block: TextBlock, size: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of each shingle and the number of its text."""
    starts, _, doc = block.spans(NOT_SPACE)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keep, inner = NOT_SPACE[block.buf], starts[1:][doc[1:] == doc[:-1]]
    keep[inner - 1] = True  # one separator before each word but a text's first
    single = block.buf.copy()
    single[inner - 1] = 0x20
    place = np.zeros(len(keep) + 1, np.int64)
    np.cumsum(keep, out=place[1:])
    joined = single[keep].tobytes()
    begin = place[starts]
    words = np.bincount(doc, minlength=block.n)
    last = np.cumsum(words) - 1  # each text's last word
    after = np.append(begin[1:] - 1, len(joined))  # where a word ends; a text's last word ends without a separator
    closes = last[words > 0][:-1]
    after[closes] += 1
    n = np.maximum(words - size + 1, np.minimum(words, 1))  # shingles of each text
    of = np.repeat(np.arange(block.n), n)
    first = np.repeat(last - words + 1, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    end = np.minimum(first + size - 1, last[of])
    digest = xxhash.xxh64_intdigest
    values = [digest(joined[a:b], SEED) for a, b in zip(begin[first].tolist(), after[end].tolist(), strict=True)]
    return np.array(values, np.uint64), of


def fingerprints_of(texts: pa.Array, size: int = SHINGLE) -> np.ndarray:
    """The unsigned fingerprint of each text; zero where it has no word."""
    block = TextBlock(texts, lower=True)
    hashes, of = _shingle_hashes(block, size)
    out = np.zeros(block.n, np.uint64)
    if len(hashes):
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        docs, first, n = np.unique(of, return_index=True, return_counts=True)
        sums = np.add.reduceat(bits, first, axis=0, dtype=np.uint32)
        out[docs] = np.packbits(2 * sums > n[:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Rows (doc_id, fp): the fingerprint as a signed long, one row for each row of ``docs``."""
    return map_steps(narrow(docs, "doc_id", "text"), lambda b: batch_of(doc_id=ids_of(b), fp=pa.array(fingerprints_of(texts_of(b), size).view(np.int64))), "doc_id long, fp long")


def _syndrome(half: np.ndarray) -> np.ndarray:
    """Of the low 31 bits under the Hamming code whose parity checks are the numbers of the places, from 1."""
    out = np.zeros(len(half), np.uint64)
    for place in range(1, 32):
        out ^= ((half >> np.uint64(place - 1)) & np.uint64(1)) * np.uint64(place)
    return out


def anchors_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every anchor within two bits of each half: (number of the fingerprint, anchor, whether it covers this half). The anchor's bit 32 tells the half."""
    number, anchor, home = [], [], []
    one, index = np.uint64(1), np.arange(len(fp))
    for side in (0, 1):
        half = (fp >> np.uint64(32 * side)) & np.uint64(0xFFFFFFFF)
        s = _syndrome(half)
        near = half ^ np.where(s > 0, one << (np.maximum(s, one) - one), np.uint64(0))
        base = np.uint64(side << 32)
        for found, covers in ((near, True), (near ^ np.uint64(1 << 31), False)):
            number.append(index)
            anchor.append(found | base)
            home.append(np.full(len(fp), covers))
        for i in range(1, 32):  # two flips that together have this syndrome
            j = s ^ np.uint64(i)
            at = np.flatnonzero((s > 0) & (j > i))
            number.append(at)
            anchor.append((half[at] ^ np.uint64(1 << (i - 1)) ^ (one << (j[at] - one))) | base)
            home.append(np.zeros(len(at), bool))
    return np.concatenate(number), np.concatenate(anchor), np.concatenate(home)


def _tree(fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A tree of links over each linked group of these fingerprints: places of children and of their parents."""
    unseen, child, parent = np.ones(len(fp), bool), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for root in range(len(fp)):
        if not unseen[root]:
            continue
        unseen[root] = False
        queue = [root]
        while queue:
            x = queue.pop()
            rest = np.flatnonzero(unseen)
            found = rest[np.bitwise_count(fp[rest] ^ fp[x]) <= bits]
            unseen[found] = False
            child.append(found)
            parent.append(np.full(len(found), x))
            queue += found.tolist()
    return np.concatenate(child), np.concatenate(parent)


def _forest(fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``_tree``, as fingerprints."""
    child, parent = _tree(fp, bits)
    return fp[child], fp[parent]


def _small_links(start: np.ndarray, size: np.ndarray, home: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between each fingerprint that an anchor covers and all others under that anchor, for many small anchors."""
    bucket = np.repeat(np.arange(len(start)), size)
    rows = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
    mine = home[rows]
    x, n = rows[mine], size[bucket[mine]]
    y = np.repeat(start[bucket[mine]] - np.cumsum(n) + n, n) + np.arange(n.sum())
    x = np.repeat(x, n)
    linked = (x != y) & (np.bitwise_count(fp[x] ^ fp[y]) <= bits)
    return fp[x[linked]], fp[y[linked]]


def _links(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor. Rows of anchors with over BLOCK fingerprints pass on as (anchor, row number), to be compared in blocks."""
    held: list[tuple] = []  # the anchor that the last batch ended in
    passing = None  # a large anchor whose rows pass on, and how many did

    def out(a, b, anchor=None):
        blank = pa.nulls(len(a), pa.int64())
        return batch_of(a=pa.array(a.view(np.int64)), b=pa.array(b.view(np.int64)) if anchor is None else b, anchor=blank if anchor is None else pa.array(anchor))

    def settle(anchor, home, fp):
        change = np.flatnonzero(np.diff(anchor)) + 1
        start = np.concatenate([[0], change])
        size = np.diff(np.append(start, len(anchor)))
        few = (size > 1) & (size <= SMALL)
        pairs = size[few] * size[few]
        for part in np.split(np.flatnonzero(few), np.searchsorted(np.cumsum(pairs), np.arange(1_000_000, pairs.sum(), 1_000_000))) if few.any() else []:
            if len(part):
                yield out(*_small_links(start[part], size[part], home, fp, bits))
        for k in np.flatnonzero(size > SMALL):
            yield out(*_forest(fp[start[k] : start[k] + size[k]], bits))

    for batch in batches:
        if not batch.num_rows:
            continue
        anchor = batch.column(0).to_numpy()
        home, fp = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy().view(np.uint64)
        if passing is not None:
            n = int(np.searchsorted(anchor, passing, "right"))
            if n:
                yield out(fp[:n], pa.nulls(n, pa.int64()), anchor[:n])
            anchor, home, fp = anchor[n:], home[n:], fp[n:]
            if not len(anchor):
                continue
            passing = None
        if held:
            anchor, home, fp = (np.concatenate(x) for x in zip(*held, (anchor, home, fp), strict=True))
        last = int(np.searchsorted(anchor, anchor[-1]))
        if len(anchor) - last > BLOCK:
            passing, held = anchor[-1], []
            yield out(fp[last:], pa.nulls(len(fp) - last, pa.int64()), anchor[last:])
        else:
            held = [(anchor[last:], home[last:], fp[last:])]
        start = 0
        if last:
            head = anchor[:last]
            sizes = np.diff(np.concatenate([[0], np.flatnonzero(np.diff(head)) + 1, [last]]))
            edges = np.cumsum(sizes)
            for k in np.flatnonzero(sizes > BLOCK):  # large ones within this batch
                a, b = int(edges[k] - sizes[k]), int(edges[k])
                if a > start:
                    yield from settle(anchor[start:a], home[start:a], fp[start:a])
                yield out(fp[a:b], pa.nulls(b - a, pa.int64()), anchor[a:b])
                start = b
            if last > start:
                yield from settle(anchor[start:last], home[start:last], fp[start:last])
    if held:
        yield from settle(*held[0])


def links(distinct: DataFrame, bits: int = BITS) -> DataFrame:
    """Rows (a, b), fingerprints as longs, that connect exactly what links at ``bits`` or fewer differing bits connect.

    ``distinct``: rows (fp), each once. Not every link is a row: under an anchor with many fingerprints only a tree of
    links for each linked group is, so rows don't grow with the square of a group's size. ``bits`` is at most 3.
    """
    if not 0 <= bits <= 3:
        raise ValueError("the halves' anchors cover up to three differing bits")
    spark = distinct.sparkSession

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            number, anchor, home = anchors_of(fp)
            yield batch_of(anchor=pa.array(anchor.view(np.int64)), home=pa.array(home), fp=pa.array(fp[number].view(np.int64)))

    placed = distinct.select("fp").mapInArrow(replicate, "anchor long, home boolean, fp long")
    dealt = placed.repartition(tasks_for(spark, placed), "anchor").sortWithinPartitions("anchor")
    found = stored(dealt.mapInArrow(lambda b: _links(b, bits), "a long, b long, anchor long"), "links")
    near = found.where(F.col("anchor").isNull()).select("a", "b")
    large = found.where(F.col("anchor").isNotNull()).select("anchor", F.col("a").alias("fp"))
    return near.unionByName(_large_links(large, bits))


def _large_links(rows: DataFrame, bits: int) -> DataFrame:
    """Compares the fingerprints of large anchors in pairs of blocks; a pair of blocks has up to twice BLOCK rows."""
    blocks = cut(rows.groupBy("anchor").agg(F.count("*").alias("n"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
    mine = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = join_hubs(rows, blocks, "anchor", blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], BLOCK).withColumn("mine", mine).withColumn("other", other)
    dealt = dealt.select("anchor", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "fp")

    def compare(pdf):
        import pandas as pd

        a, b = _forest(pdf["fp"].to_numpy().view(np.uint64), bits)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return dealt.groupBy("anchor", "i", "j").applyInPandas(compare, "a long, b long")


def fingerprint_groups(docs: DataFrame, size: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """The operator, by fingerprint: rows (doc_id, fp, component_id), one for each row of ``docs``.

    A component is whatever chains of links reach; its id is the smallest doc_id in it. Null and empty texts have
    fingerprint zero and link like any other. A null doc_id never names a component; one of only such rows has the
    id null. Repeated rows repeat. An empty table gives no rows; further columns are ignored.
    """
    return grouped(stored(fingerprints(docs, size), "fingerprints"), lambda distinct: links(distinct, bits))


def grouped(marked: DataFrame, link: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows (doc_id, fp, component_id) from stored rows (doc_id, fp) and links (a, b) between distinct values of fp."""
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")))
    n, total = distinct.agg(F.count("*"), F.coalesce(F.sum("copies"), F.lit(0))).first()
    roots = connected_components(link(distinct))
    rooted = cut(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    names = rooted.groupBy("root").agg(F.count("*").alias("n"), F.min("least").alias("component_id"))
    named = join_hubs(rooted, names, "root", n).select("fp", "component_id", F.col("copies").alias("n"))
    return join_hubs(marked, named, "fp", total).select("doc_id", "fp", "component_id")


#: Similarity of shingle sets from which texts are near duplicates, and the words of a shingle there.
SIMILARITY, LONG_SHINGLE = 0.8, 5
#: Words of 64 bits in a long fingerprint; lots of its bits; blocks of 7 bits in a lot.
#: The lots, and the rounds over them, only spare measuring pairs of a large group; what they don't link the heads of the sets do.
LONG_WORDS, PROJECTIONS, CODE_BLOCKS, ROUNDS = 10, 16, 5, 3
#: Bits of 64 that pairs to be measured differ in at most. At a similarity of 0.8, 9.7 bits differ, 2.9 more or less.
APART = 19
#: One in so many fingerprints tells which anchors are crowded, one in so many texts which shingles are frequent.
ONE_IN = 16
#: Frequent shingles that are broadcast, at most. They go last in the order; without them heads meet more often, no less.
FREQUENT = 100_000
#: Pairs that a task compares in one vectorised step.
PAIRS = 500_000


def _lots() -> np.ndarray:
    """Places of the bits of each lot of each round, (ROUNDS, PROJECTIONS, CODE_BLOCKS, 7); lots of one shuffle share no bit."""
    rng, size, out = np.random.default_rng(SEED), 7 * CODE_BLOCKS, []
    while len(out) < ROUNDS * PROJECTIONS:
        order = rng.permutation(64 * LONG_WORDS)
        out += [order[k : k + size] for k in range(0, len(order) - size + 1, size)]
    return np.array(out[: ROUNDS * PROJECTIONS]).reshape(ROUNDS, PROJECTIONS, CODE_BLOCKS, 7)


def _nearest_words() -> np.ndarray:
    """For each 7 bits the number, of 16, of the one Hamming code word at most one bit away: its bits 3, 5, 6 and 7."""
    value = np.arange(128, dtype=np.uint64)
    wrong = np.zeros(128, np.uint64)
    for place in range(1, 8):
        wrong ^= ((value >> np.uint64(place - 1)) & np.uint64(1)) * np.uint64(place)
    word = np.where(wrong > 0, value ^ (np.uint64(1) << (np.maximum(wrong, 1) - np.uint64(1))), value)
    return sum(((word >> np.uint64(place - 1)) & np.uint64(1)) << np.uint64(k) for k, place in enumerate((3, 5, 6, 7))).astype(np.int64)


def shingle_sets(texts: pa.Array, size: int = LONG_SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, A-Z in lower case, and the text's number, in order. A text of fewer words
    is one shingle."""
    block = TextBlock(texts, lower=True)
    starts, ends, doc = block.spans(NOT_SPACE)
    words = block.hashes(starts, ends)
    hashes, at = windows(words, doc, size)
    of = doc[at]
    short = np.flatnonzero((np.bincount(doc, minlength=block.n) < size) & (np.bincount(doc, minlength=block.n) > 0))
    edges = np.searchsorted(doc, np.arange(block.n + 1))
    whole = np.zeros(len(short), np.uint64)
    for k in range(size - 1):
        there = edges[short] + k < edges[short + 1]
        whole[there] = mix(whole[there] * U64(31) + words[edges[short[there]] + k] + U64(k + 1))
    hashes, of = np.concatenate([hashes, whole]), np.concatenate([of, short])
    order = np.lexsort((hashes, of))
    hashes, of = hashes[order], of[order]
    first = np.ones(len(of), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
    return hashes[first], of[first]


def _bit_sums(hashes: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """How many of each text's hashes have each bit, (texts, 64): eight counters of a byte each are added at once, over
    stretches of up to 255 hashes, and then the stretches."""
    pieces = -(-count // 255)
    begin = np.cumsum(pieces) - pieces
    starts = np.repeat(first - 255 * begin, pieces) + 255 * np.arange(pieces.sum())
    sums = np.empty((len(first), 64), np.uint32)
    for j in range(8):
        lanes = np.add.reduceat((hashes >> U64(j)) & U64(0x0101010101010101), starts)
        sums[:, j::8] = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8), begin, axis=0, dtype=np.uint32)
    return sums


def long_fingerprints(hashes: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """The bits of each text's fingerprint over its shingles, (n, 64 * LONG_WORDS)."""
    out = np.zeros((n, 64 * LONG_WORDS), np.uint8)
    if len(of):
        docs, first, count = np.unique(of, return_index=True, return_counts=True)
        for k in range(LONG_WORDS):
            more = mix(hashes + U64((0x9E3779B97F4A7C15 * (k + 1)) & 0xFFFFFFFFFFFFFFFF))
            out[docs, 64 * k : 64 * k + 64] = 2 * _bit_sums(more, first, count) > count[:, None]
    return out


def _frequent(read: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of shingles that many texts share, sorted, and the rank of each from 1 on, the least frequent first."""
    some = read.where(F.pmod("copy", F.lit(ONE_IN)) == 0)
    some = map_steps(some, lambda b: batch_of(shingle=pa.array(shingle_sets(texts_of(b))[0].view(np.int64))), "shingle long")
    counts = cut(some.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 2").withColumn("level", F.floor(F.log2("n"))))
    room, least = FREQUENT, 64
    for level, n in sorted(counts.groupBy("level").count().collect(), reverse=True):
        room -= n
        if room < 0:
            break
        least = level
    rows = counts.where(F.col("level") >= least).orderBy("n", "shingle").select("shingle").toPandas()["shingle"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(rows)
    return rows[order], order + 1


def _binaries(data: np.ndarray, length: np.ndarray) -> pa.Array:
    """Bytes cut into values of these lengths."""
    edges = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(edges.tobytes()), pa.py_buffer(data.tobytes())])


def _heads(hashes: np.ndarray, of: np.ndarray, n: int, similarity: float, frequent: tuple[np.ndarray, np.ndarray]) -> pa.Array:
    """The shingles of each text, the rare ones first, up to where a set that shares none of them can't have the similarity."""
    rank = np.zeros(len(hashes), np.int64)
    if len(frequent[0]):
        at = np.minimum(np.searchsorted(frequent[0], hashes), len(frequent[0]) - 1)
        rank = np.where(frequent[0][at] == hashes, frequent[1][at], 0)
    order = np.argsort(of * (len(frequent[0]) + 1) + rank, kind="stable")
    size = np.bincount(of, minlength=n)
    length = np.where(size > 0, size - np.ceil(similarity * size - 1e-6).astype(np.int64) + 1, 0)
    length = np.minimum(length, size)
    place = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
    return _binaries(hashes[order][place < length[of]].astype("<u8"), 8 * length)


def _parities(hashes: np.ndarray, of: np.ndarray, n: int) -> pa.Array:
    """For each text, bit by bit, whether an odd number of its shingles fall on it: as many bits as it has shingles or more, a
    power of two. Sets differ in no fewer shingles than their parities in bits."""
    size = np.bincount(of, minlength=n)
    bits = np.where(size > 0, 1 << np.ceil(np.log2(np.maximum(size, 64))).astype(np.int64), 0)
    spot = np.repeat(np.cumsum(bits) - bits, size) + (mix(hashes) & (bits[of] - 1).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(spot, minlength=bits.sum()) & 1).astype(np.uint8)
    return _binaries(np.packbits(odd, bitorder="little"), bits // 8)


def _long_prints(batch: pa.RecordBatch, similarity: float, frequent: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    texts = texts_of(batch)
    hashes, of = shingle_sets(texts)
    bits = np.packbits(long_fingerprints(hashes, of, len(texts)), axis=1, bitorder="little")
    raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * LONG_WORDS), len(texts), [None, pa.py_buffer(bits.tobytes())]).cast(pa.binary())
    size = np.bincount(of, minlength=len(texts))
    alike = np.bincount(of, weights=np.zeros(len(of)), minlength=len(texts)).astype(np.uint64)
    edges = np.searchsorted(of, np.arange(len(texts) + 1))
    full = np.flatnonzero(size)
    if len(full):
        alike[full] = np.add.reduceat(mix(hashes), edges[full])  # equal sets have equal sums
    fp = pa.array((alike ^ mix(size.astype(np.uint64))).view(np.int64))
    head, parity = _heads(hashes, of, len(texts), similarity, frequent), _parities(hashes, of, len(texts))
    return batch_of(doc_id=ids_of(batch), copy=texts_of(batch, "copy"), fp=fp, size=pa.array(size), bits=raw, head=head, parity=parity)


def _place(batch: pa.RecordBatch, turn: int) -> pa.RecordBatch:
    """Every fingerprint under its anchor of each lot of a round, with the word of 64 bits that comparisons there go by."""
    n = batch.num_rows
    raw = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(n, 8 * LONG_WORDS)
    bits, near, power = np.unpackbits(raw, axis=1, bitorder="little").astype(np.int64), _nearest_words(), 1 << np.arange(7)
    anchor = np.empty((PROJECTIONS, n), np.int64)
    for k, lot in enumerate(_lots()[turn]):
        anchor[k] = k
        for block in lot:
            anchor[k] = anchor[k] * 16 + near[bits[:, block] @ power]
    fp, root = (np.tile(batch.column(k).to_numpy(), PROJECTIONS) for k in (0, 2))
    word = np.tile(np.ascontiguousarray(raw[:, 8 * turn : 8 * turn + 8]).view("<u8").ravel().view(np.int64), PROJECTIONS)
    return batch_of(anchor=pa.array(anchor.ravel()), fp=pa.array(fp), root=pa.array(root), word=pa.array(word))


def _closest_before(word: np.ndarray, root: np.ndarray, apart: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row after the first the one of another root before it whose word differs least, if in no more than ``apart``
    bits, and in how many."""
    child, parent, least = [], [], []
    for k in range(1, len(word)):
        differ = np.where(root[:k] == root[k], 255, np.bitwise_count(word[:k] ^ word[k]))
        at = int(differ.argmin())
        if differ[at] <= apart:
            child.append(k)
            parent.append(at)
            least.append(differ[at])
    return np.array(child, np.int64), np.array(parent, np.int64), np.array(least, np.int64)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs under an anchor, of rows sorted by anchor and block: each fingerprint with the closest of another root before it
    in its block, that one's root, and how many bits differ, so there are fewer pairs than rows whatever the size of a group.
    What is before differs with the lot. Of many rows, each goes with the most central one too; ``differ`` is then less the
    more rows there are, and negative."""

    def out(of, other, root, differ):
        return batch_of(of=pa.array(of), other=pa.array(other), root=pa.array(root), differ=pa.array(differ.astype(np.int64)))

    def settle(key, fp, root, word):
        order = np.lexsort((np.where((key[:, 0] >> (4 * CODE_BLOCKS)) & 1, ~fp, fp), key[:, 1], key[:, 0]))
        key, fp, root, word = key[order], fp[order], root[order], word[order]
        start = np.concatenate([[0], np.flatnonzero(np.any(key[1:] != key[:-1], axis=1)) + 1])
        size = np.diff(np.append(start, len(key)))
        few = np.flatnonzero((size > 1) & (size <= SMALL))
        for part in np.array_split(few, 1 + int((size[few] ** 2).sum() // 1_000_000)):
            bucket = np.repeat(part, size[part])
            x = start[bucket] + np.arange(len(bucket)) - np.repeat(np.cumsum(size[part]) - size[part], size[part])
            before = x - start[bucket]
            b = np.repeat(x, before)
            a = np.repeat(start[bucket], before) + np.arange(len(b)) - np.repeat(np.cumsum(before) - before, before)
            differ = np.where(root[a] == root[b], 255, np.bitwise_count(word[a] ^ word[b]))
            ranked = np.lexsort((differ, b))
            first = ranked[np.unique(b[ranked], return_index=True)[1]]
            first = first[differ[first] <= APART]
            yield out(fp[b[first]], fp[a[first]], root[a[first]], differ[first])
        for k in np.flatnonzero(size > SMALL):
            mine = slice(start[k], start[k] + size[k])
            child, parent, differ = _closest_before(word[mine], root[mine], APART)
            yield out(fp[mine][child], fp[mine][parent], root[mine][parent], differ)
            bits = np.unpackbits(word[mine].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1)
            usual = 2 * bits.sum(axis=0, dtype=np.int64) > len(bits)
            central = start[k] + int((bits != usual).sum(axis=1).argmin())
            others = start[k] + np.flatnonzero(root[mine] != root[central])
            yield out(fp[others], *(np.full(len(others), x[central]) for x in (fp, root)), np.full(len(others), -size[k]))

    held: list[tuple] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1)
        rows = key, batch.column(2).to_numpy(), batch.column(3).to_numpy(), batch.column(4).to_numpy().view(np.uint64)
        if held:
            rows = tuple(np.concatenate(x) for x in zip(*held, rows, strict=True))
        changes = np.flatnonzero(np.any(rows[0][1:] != rows[0][:-1], axis=1))
        last = int(changes[-1]) + 1 if len(changes) else 0
        held = [tuple(x[last:] for x in rows)]
        if last:
            yield from settle(*(x[:last] for x in rows))
    if held:
        yield from settle(*held[0])


def _similar_links(docs: DataFrame, prints: DataFrame, similarity: float) -> DataFrame:
    """Rows (a, b), values of fp, each a set of shingles, that connect exactly what sets of that similarity connect."""
    first = [F.first(c).alias(c) for c in ("size", "bits", "head", "parity")]
    once = cut(prints.where("size > 0").groupBy("fp").agg(*first, F.min("copy").alias("copy")))
    rooted, links = once.withColumn("root", F.col("fp")), None
    for turn in range(ROUNDS):
        found = gathered(cut(_measured(docs, once, _closest(rooted, turn), similarity)))
        links = found if links is None else links.unionByName(found)
        rooted = once.join(_hubs(links), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rest = _measured(docs, once, stored(_sharing(rooted, similarity), "rest"), similarity)
    return links.unionByName(rest)


def _hubs(links: DataFrame) -> DataFrame:
    """Rows (fp, root) of all that ``links`` (a, b) connect; the root is the one of most links in its component."""
    many = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    roots = gathered(cut(connected_components(links).join(many, "node")))
    hubs = roots.groupBy("root").agg(F.count("*").alias("n"), F.max_by("node", F.struct("links", "node")).alias("hub"))
    return cut(join_hubs(roots, cut(hubs), "root", roots.count()).select(F.col("node").alias("fp"), F.col("hub").alias("root")))


def _closest(once: DataFrame, turn: int) -> DataFrame:
    """Rows (a, b): each fingerprint with the closest of a lesser and the closest of a greater fp, of other roots, that it
    meets under an anchor, with the most central one of its fullest anchor, and with the roots of these."""
    spark = once.sparkSession
    place = lambda rows: map_steps(rows.select("fp", "bits", "root"), lambda b: _place(b, turn), "anchor long, fp long, root long, word long", text="bits", size=STEP_BYTES // 4)
    placed = place(once)
    # Crowded anchors are dealt into blocks; the dealing differs from lot to lot, so a large group's blocks are linked by other lots.
    some = place(once.where(F.pmod(F.xxhash64("fp", F.lit(SEED)), F.lit(ONE_IN)) == 0)).groupBy("anchor").agg(F.count("*").alias("n"))
    some = cut(some.where(F.col("n") > BLOCK // ONE_IN))
    bar = max(BLOCK // ONE_IN, (some.agg(F.sum("n")).first()[0] or 0) // HUBS)
    crowded = some.where(F.col("n") > bar).select("anchor", F.ceil(F.col("n") * ONE_IN / BLOCK).cast("int").alias("blocks"))
    dealt = placed.join(F.broadcast(crowded), "anchor", "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64("fp", "anchor"), F.col("blocks")), F.lit(0)).cast("int"))
    dealt = dealt.select("anchor", "block", "fp", "root", "word").repartition(tasks_for(spark, placed), "anchor", "block").sortWithinPartitions("anchor", "block")
    met = dealt.mapInArrow(_meet, "of long, other long, root long, differ long")
    best = met.groupBy("of", F.expr("if(differ < 0, 2, int(other < of))").alias("kind")).agg(F.min(F.struct("differ", "other", "root")).alias("best"))
    best = best.select("of", F.explode(F.array("best.other", "best.root")).alias("other"))
    return stored(best.select(F.greatest("of", "other").alias("a"), F.least("of", "other").alias("b")).distinct(), "pairs")


def _measured(docs: DataFrame, once: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """Those of the stored ``pairs`` (a, b) whose sets have the similarity. Their parities rule out most others beforehand."""
    both = pairs
    for n in ("a", "b"):
        both = both.join(once.select(F.col("fp").alias(n), F.col("size").alias(f"{n}_size"), F.col("parity").alias(f"{n}_parity")), n)
    both = both.select("a", "b", "a_size", "b_size", "a_parity", "b_parity")
    likely = stored(both.mapInArrow(lambda b: _alike(b, similarity), "a long, b long"), "likely")
    wanted = likely.select(F.col("a").alias("fp")).union(likely.select(F.col("b").alias("fp"))).distinct()
    sets = stored(_sets_of(docs, stored(wanted.join(once.select("fp", "copy"), "fp"), "wanted")), "shingles")
    side = lambda n: sets.select(F.col("fp").alias(n), F.col("shingles").alias(f"{n}_set"))
    both = likely.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("a_set", "b_set"))
    return both.where(common >= similarity * (F.size("a_set") + F.size("b_set") - common)).select("a", "b")


def _alike(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Pairs whose parities differ in no more bits than sets of the similarity differ in shingles."""
    for batch in batches:
        most = (1 - similarity) / (1 + similarity) * (batch.column(2).to_numpy() + batch.column(3).to_numpy()) + 1e-6
        keep = np.zeros(batch.num_rows, bool)
        for k, (a, b) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)):
            fewer = min(len(a), len(b))
            a, b = (np.bitwise_xor.reduce(np.frombuffer(x, np.uint8).reshape(-1, fewer)) for x in (a, b))
            keep[k] = np.bitwise_count(a ^ b).sum(dtype=np.int64) <= most[k]
        yield batch.select([0, 1]).filter(pa.array(keep))


def _by_shingle(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A row for each shingle of a head, with its place there."""
    length = np.array([len(x) // 8 for x in texts_of(batch, "head").to_pylist()], np.int64)
    shingle = np.frombuffer(b"".join(texts_of(batch, "head").to_pylist()), "<i8")
    fp, root, size = (np.repeat(ids_of(batch, n).to_numpy(), length) for n in ("fp", "root", "size"))
    at = np.arange(len(shingle)) - np.repeat(np.cumsum(length) - length, length)
    return batch_of(shingle=pa.array(shingle), fp=pa.array(fp), root=pa.array(root), size=pa.array(size), at=pa.array(at))


def _sharers(rows: tuple[np.ndarray, ...], similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows (shingle, fp, root, size, at) of one shingle that have different roots and may have the similarity: each
    with enough shingles left from its place on."""
    rows = tuple(x[np.lexsort((rows[3], rows[0]))] for x in rows)
    start = np.concatenate([[0], np.flatnonzero(np.diff(rows[0])) + 1])
    mixed = np.minimum.reduceat(rows[2], start) != np.maximum.reduceat(rows[2], start)
    group = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(rows[0]))))
    inside = mixed[group]
    group, (_, fp, root, size, at) = group[inside], (x[inside] for x in rows)
    # Of the rows before, in order of size, those from the least size on that allows the similarity.
    low = np.searchsorted((group << 32) | size, (group << 32) | np.ceil(similarity * size - 1e-6).astype(np.int64))
    n = np.arange(len(fp)) - low
    total = np.cumsum(n)
    edge = 0
    while edge < len(fp):
        end = max(edge + 1, int(np.searchsorted(total, (total[edge - 1] if edge else 0) + PAIRS, "right")))
        many = n[edge:end]
        x = np.repeat(np.arange(edge, end), many)
        y = np.repeat(low[edge:end], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        common = similarity / (1 + similarity) * (size[x] + size[y]) - 1e-6
        found = (root[x] != root[y]) & (size[x] - at[x] >= common) & (size[y] - at[y] >= common)
        a, b = fp[x[found]], fp[y[found]]
        yield np.maximum(a, b), np.minimum(a, b)
        edge = end


def _share(batches: Iterator[pa.RecordBatch], similarity: float, block: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by shingle. Rows of shingles with over ``block`` rows pass on, to be compared in blocks."""
    held, passing = None, None

    def on(shingle, fp, root, size, at):
        return batch_of(a=pa.array(fp), b=pa.array(root), shingle=pa.array(shingle), size=pa.array(size), at=pa.array(at))

    def pairs(rows):
        for a, b in _sharers(rows, similarity) if len(rows[0]) else []:
            blank = pa.nulls(len(a), pa.int64())
            yield batch_of(a=pa.array(a), b=pa.array(b), shingle=blank, size=blank, at=blank)

    for batch in batches:
        rows = tuple(c.to_numpy() for c in batch.columns)
        if passing is not None:
            n = int(np.searchsorted(rows[0], passing, "right"))
            if n:
                yield on(*(x[:n] for x in rows))
            rows = tuple(x[n:] for x in rows)
        if not len(rows[0]):
            continue
        passing = None
        if held is not None:
            rows = tuple(np.concatenate(x) for x in zip(held, rows, strict=True))
        edges = np.concatenate([[0], np.flatnonzero(np.diff(rows[0])) + 1, [len(rows[0])]])
        large = np.diff(edges) > block
        passed = np.repeat(large, np.diff(edges))
        if passed.any():
            yield on(*(x[passed] for x in rows))
        whole, held = ~passed, None
        if large[-1]:
            passing = rows[0][-1]
        else:
            held = tuple(x[edges[-2] :] for x in rows)
            whole[edges[-2] :] = False
        yield from pairs(tuple(x[whole] for x in rows))
    if held is not None:
        yield from pairs(held)


def _sharing(rooted: DataFrame, similarity: float) -> DataFrame:
    """Rows (a, b), values of fp: all pairs of different roots that can have the similarity, of rows (fp, size, head, root)."""
    spark, block = rooted.sparkSession, BLOCK
    rows = map_steps(rooted.select("fp", "root", "size", "head"), _by_shingle, "shingle long, fp long, root long, size long, at long", text="head", size=STEP_BYTES // 4)
    dealt = rows.repartition(tasks_for(spark, rows), "shingle").sortWithinPartitions("shingle")
    found = stored(dealt.mapInArrow(lambda b: _share(b, similarity, block), "a long, b long, shingle long, size long, at long"), "sharing")
    large = found.where(F.col("shingle").isNotNull()).select("shingle", F.col("a").alias("fp"), F.col("b").alias("root"), "size", "at")
    return found.where(F.col("shingle").isNull()).select("a", "b").unionByName(_large_sharing(large, similarity)).distinct()


def _large_sharing(rows: DataFrame, similarity: float) -> DataFrame:
    """Compares the rows of frequent shingles in pairs of blocks; those of one root only need no comparison."""
    blocks = rows.groupBy("shingle").agg(F.count("*").alias("n"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.min("root").alias("least"), F.max("root").alias("most"))
    blocks = cut(blocks.where("least <> most").drop("least", "most"))
    mine = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = join_hubs(rows, blocks, "shingle", blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], BLOCK).withColumn("mine", mine).withColumn("other", other)
    dealt = dealt.select("shingle", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "fp", "root", "size", "at")

    def compare(pdf):
        import pandas as pd

        found = _sharers(tuple(pdf[c].to_numpy() for c in ("shingle", "fp", "root", "size", "at")), similarity)
        return pd.concat([pd.DataFrame({"a": a, "b": b}) for a, b in found] or [pd.DataFrame({"a": [], "b": []}, dtype="int64")])

    return dealt.groupBy("shingle", "i", "j").applyInPandas(compare, "a long, b long")


def _sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows (fp, shingles) of the wanted (fp, copy), each once; of equal texts one is read."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch)
        hashes, of = shingle_sets(texts)
        edges = np.searchsorted(of, np.arange(len(texts) + 1)).astype(np.int32)
        return batch_of(fp=texts_of(batch, "fp"), shingles=pa.ListArray.from_arrays(pa.array(edges), pa.array(hashes.view(np.int64))))

    read, maybe = with_maybe(docs.select(F.xxhash64("text").alias("copy"), "text"), "copy", wanted)
    once = read.where(maybe).join(wanted, "copy").groupBy("fp").agg(F.first("text").alias("text"))
    return map_steps(once, work, "fp long, shingles array<long>")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The operator, by similarity: rows (doc_id, fp, component_id), one for each row of ``docs``; ``fp`` is a hash of the
    text's set of five-word shingles, A-Z in lower case.

    Texts of the same set are linked, and so are those whose sets have a Jaccard similarity of ``similarity`` (over 0) or
    more, all of them. A component is whatever chains of links reach; its id is the smallest doc_id in it. Texts without a word, null ones too, have the empty set and are one group. A null
    doc_id never names a component. Repeated rows repeat. An empty table gives no rows; further columns are ignored.
    """
    if not 0 < similarity <= 1:
        raise ValueError("sets of no similarity share no shingle to meet by")
    read = docs.select("doc_id", "text", F.xxhash64("text").alias("copy"))
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(read))
    columns = "doc_id long, copy long, fp long, size long, bits binary, head binary, parity binary"
    prints = stored(map_steps(read, lambda b: _long_prints(b, similarity, frequent.value), columns), "prints")
    return grouped(prints.select("doc_id", "fp"), lambda _: _similar_links(docs, prints, similarity))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each group of near duplicates: that of the smallest doc_id. Rows that repeat a doc_id count as
    one document; rows without a doc_id can't be told apart from others and stay."""
    gone = stored(near_duplicates(docs, similarity).where(F.col("doc_id") != F.col("component_id")).select("doc_id"), "gone")
    told, maybe = with_maybe(docs, "doc_id", gone)
    likely = F.col("doc_id").isNotNull() & F.col(maybe)
    rest = told.where(likely).join(gone, "doc_id", "left_anti")
    return told.where(~likely).select(*docs.columns).unionByName(rest.select(*docs.columns))


def digest(docs: DataFrame) -> DataFrame:
    """op9's rows."""
    found = fingerprint_groups(docs)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
