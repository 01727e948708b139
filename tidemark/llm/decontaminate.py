"""8. Benchmark decontamination by a generalised suffix automaton of the normalised test items.

The automaton is over words. A document's words stream through it; the state gives, at each word, the longest stretch
ending there that also stands in some item. Where that reaches the window's length, every word of the stretch lies in
a window of an item. Only runs of words that the items know are streamed: no other word can take part in a match.
"""

from __future__ import annotations

import itertools
import pickle
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import STEP_BYTES, batch_of, ids_of, map_steps, narrow, stored, texts_of
from tidemark.llm.textblock import ALNUM, TextBlock

WINDOW = 10
#: Words of test items in one automaton, which a task builds from their hashes. With more items a task holds one automaton
#: after the other. A single item may be larger.
SHARD_WORDS = 300_000
#: Automata whose word hashes are broadcast at once, 8 bytes a word: about 50 MB. A larger benchmark takes several rounds
#: over the documents, and each round's broadcasts go before the next one's come.
ROUND_SHARDS = 20
#: Share of a document's words that may be removed before the whole document goes.
MAX_COVERAGE = 0.5


def words_of(texts: pa.Array) -> tuple[TextBlock, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The block, and of each word: start, end, text number, hash."""
    block = TextBlock(texts, lower=True)
    starts, ends, doc = block.spans(ALNUM)
    return block, starts, ends, doc, block.hashes(starts, ends)


class ItemAutomaton:
    """Suffix automaton of several word sequences, each with the items whose windows end in each state.

    ``vocabulary``: sorted hashes of the items' words; a word's letter is its place there.
    """

    def __init__(self, items: Iterable[tuple[object, np.ndarray]], window: int = WINDOW):
        items = [(name, words) for name, words in items if len(words)]
        self.window = window
        self.vocabulary = np.unique(np.concatenate([w for _, w in items])) if items else np.zeros(0, np.uint64)
        self.least = min([window, *(len(w) for _, w in items)])
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[tuple[int, int, object]] = []
        for name, words in items:
            last = 0
            for k, letter in enumerate(np.searchsorted(self.vocabulary, words).tolist()):
                last = self._grow(last, letter)
                if k + 1 >= window:
                    ends.append((last, window, name))
            if len(words) < window:
                ends.append((last, len(words), name))
        # the items that have a window of that length ending in the state, at the state that holds exactly it
        self.whole: dict[int, dict[int, set]] = {}
        for state, size, name in ends:
            while self.length[self.link[state]] >= size:
                state = self.link[state]
            self.whole.setdefault(state, {}).setdefault(size, set()).add(name)

    def _grow(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if (q := nxt[last].get(c)) is not None:
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        twin = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = twin
            p = self.link[p]
        self.link[q] = twin
        return twin

    def scan(self, letters: list[int]) -> tuple[list[tuple[int, int]], set]:
        """Stretches of ``letters`` (start, end) that windows cover, in order and maybe overlapping, and the items whose windows occur."""
        nxt, link, length, window, whole = self.next, self.link, self.length, self.window, self.whole
        state, size, found, items, seen = 0, 0, [], set(), set()
        for at, c in enumerate(letters):
            while state and c not in nxt[state]:
                state = link[state]
                size = length[state]
            if c in nxt[state]:
                state = nxt[state][c]
                size += 1
            else:
                size = 0
            if size < self.least:
                continue
            if size >= window:
                found.append((at + 1 - size, at + 1))
            key = (state, min(size, window))
            if key in seen and size >= window:
                continue
            seen.add(key)
            s = state
            while s > 0:
                for n, names in whole.get(s, {}).items():
                    if n <= size:
                        items |= names
                        if n < window:
                            found.append((at + 1 - n, at + 1))
                s = link[s]
        return found, items

    def runs(self, hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of runs of known words within a document, long enough to hold a window: starts, ends, and each word's letter."""
        if not len(self.vocabulary) or not len(hashes):
            z = np.zeros(0, np.int64)
            return z, z, z
        letter = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        known = self.vocabulary[letter] == hashes
        joins = known[1:] & known[:-1] & (doc[1:] == doc[:-1])
        start = np.flatnonzero(known & ~np.concatenate([[False], joins]))
        end = np.flatnonzero(known & ~np.concatenate([joins, [False]])) + 1
        long = end - start >= self.least
        return start[long], end[long], letter


def mark_batch(automaton: ItemAutomaton, texts: pa.Array) -> tuple[TextBlock, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[set]]:
    """The block, each word's start, end and text number, whether it is hit, and by text the items whose windows occur."""
    block, starts, ends, doc, hashes = words_of(texts)
    edge, items = np.zeros(len(starts) + 1, np.int32), [set() for _ in range(block.n)]
    a, b, letter = automaton.runs(hashes, doc)
    for start, end in zip(a.tolist(), b.tolist(), strict=True):
        found, names = automaton.scan(letter[start:end].tolist())
        for p, q in found:
            edge[start + p] += 1
            edge[start + q] -= 1
        items[doc[start]] |= names
    return block, starts, ends, doc, np.cumsum(edge[:-1]) > 0, items


def shards(benchmark: DataFrame, shard_words: int = SHARD_WORDS, item: str = "item_id") -> Iterator[bytes]:
    """The items in shards of about ``shard_words`` words, as ids (text) and word hashes; one at a time reaches the driver.
    Items are dealt by their words, so one id may stand in several. Items with null or wordless text have no windows."""

    def hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, _, _, doc, hashes = words_of(texts_of(batch))
        first = np.searchsorted(doc, np.arange(batch.num_rows + 1))
        words = pa.array([hashes[a:b].tobytes() for a, b in zip(first, first[1:], strict=False)], pa.binary())
        return batch_of(item=texts_of(batch, "item"), n=pa.array(np.diff(first)), words=words)

    named = benchmark.select(F.col(item).cast("string").alias("item"), "text").where(F.col("text").isNotNull())
    items = stored(map_steps(named, hashed, "item string, n long, words binary").where("n > 0").distinct(), "items")
    n = max(1, -(-(items.agg(F.sum("n")).first()[0] or 0) // shard_words))

    def pack(group: pa.Table) -> pa.Table:
        return pa.table({"shard": pa.array([pickle.dumps((group["item"].to_pylist(), group["words"].to_pylist()))], pa.binary())})

    dealt = items.withColumn("_shard", F.pmod(F.xxhash64("words"), F.lit(n)))
    yield from (r[0] for r in dealt.groupBy("_shard").applyInArrow(pack, "shard binary").toLocalIterator())


_built: dict[tuple, ItemAutomaton] = {}


def automaton_of(shard: bytes, window: int) -> ItemAutomaton:
    """The automaton of a shard. A task's process keeps the last one that it built."""
    key = zlib.crc32(shard), len(shard), window
    if key not in _built:
        _built.clear()
        names, words = pickle.loads(shard)
        _built[key] = ItemAutomaton([(n, np.frombuffer(w, np.uint64)) for n, w in zip(names, words, strict=True)], window)
    return _built[key]


def in_rounds(benchmark: DataFrame, shard_words: int, item: str = "item_id") -> Iterator[list[bytes]]:
    """Lists of up to ROUND_SHARDS shards; an empty benchmark makes one empty list."""
    held: list[bytes] = []
    for shard in shards(benchmark, shard_words, item):
        if len(held) == ROUND_SHARDS:
            yield held
            held = []
        held.append(shard)
    yield held


def mark_all(given: list[bytes], texts: pa.Array, window: int) -> tuple[TextBlock, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[set]]:
    """As ``mark_batch``, for the items of several shards: an automaton after the other, and hits add up."""
    marked = mark_batch(automaton_of(given[0], window) if given else ItemAutomaton([], window), texts)
    for shard in given[1:]:
        *_, hit, items = mark_batch(automaton_of(shard, window), texts)
        marked = (*marked[:4], marked[4] | hit, [x | y for x, y in zip(marked[5], items, strict=True)])
    return marked


HITS = "array<struct<start:long,end:long>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _find_round(docs: DataFrame, shared: Broadcast, window: int, steps: int, row: str = "") -> DataFrame:
    """Rows (doc_id, n_words, hits, items) under one round's shards; with ``row``, that column too, and only rows with hits."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        block, _, _, doc, hit, items = mark_all(shared.value, texts_of(batch), window)
        words = np.bincount(doc, minlength=block.n)
        first = np.cumsum(words) - words
        begins = np.flatnonzero(hit & ~np.concatenate([[False], hit[:-1] & (doc[1:] == doc[:-1])])) if len(hit) else np.zeros(0, int)
        ends = np.flatnonzero(hit & ~np.concatenate([hit[1:] & (doc[1:] == doc[:-1]), [False]])) + 1 if len(hit) else begins
        spans = [[] for _ in range(block.n)]
        for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
            d = doc[a]
            spans[d].append({"start": a - int(first[d]), "end": b - int(first[d])})
        found = {
            "doc_id": ids_of(batch), "n_words": pa.array(words, pa.int64()), "hits": pa.array(spans, _SPANS),
            "items": pa.array([sorted(x for x in s if x is not None) for s in items], pa.list_(pa.string())),
        }
        return batch_of(**found, **({row: texts_of(batch, row)} if row else {}))

    schema = f"doc_id long, n_words long, hits {HITS}, items array<string>" + (f", {row} long" if row else "")
    return map_steps(narrow(docs, "doc_id", "text", *([row] if row else [])), work, schema, size=steps)


def _steps(n: int) -> int:
    """Bytes of text in a step: more where several automata take turns on it."""
    return STEP_BYTES if n < 2 else 16 * STEP_BYTES


def _numbered_finds(docs: DataFrame, rounds: Iterator[list[bytes]], window: int, row: str) -> DataFrame:
    """Rows (row, hits, items) of all rounds together, for the rows with hits of ``docs``, a stored table. Each round reads
    the documents once, and its result is stored before the next one begins."""
    found = None
    for given in rounds:
        shared = docs.sparkSession.sparkContext.broadcast(given)
        some = _find_round(docs, shared, window, _steps(len(given)), row).where((F.size("hits") > 0) | (F.size("items") > 0))
        some = stored(some.select(row, "hits", "items"), "hits")
        shared.destroy()
        found = some if found is None else found.unionByName(some)
    joined = found.groupBy(row).agg(F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    joins = lambda acc, h: F.when((F.size(acc) > 0) & (h["start"] <= F.element_at(acc, -1)["end"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], h["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(h)))
    return joined.withColumn("hits", F.aggregate("hits", F.lit([]).cast(HITS), joins))


def find_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Rows (doc_id, n_words, hits, items): ``hits`` are the hit stretches as word numbers [start, end), ``items`` the
    ids, as sorted strings, of items that have a window in the document.

    One row for each row of ``docs``, in any order; null and empty texts have no words. Repeated rows repeat. Item ids
    may be of any type; rows of ``benchmark`` with the same id count as one item, a null id counts as none, but its
    windows hit. An empty benchmark hits nothing.
    """
    rounds, context = in_rounds(benchmark, shard_words), docs.sparkSession.sparkContext
    first = next(rounds)
    second = next(rounds, None)
    if second is None:
        return _find_round(docs, context.broadcast(first), window, _steps(len(first)))
    row = f"_row_{uuid.uuid4().hex[:8]}"
    numbered = stored(narrow(docs, "doc_id", "text").withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = _numbered_finds(numbered, itertools.chain([first, second], rounds), window, row)
    words = _find_round(numbered, context.broadcast([]), window, STEP_BYTES, row).select("doc_id", "n_words", row)
    return words.join(found, row, "left").select("doc_id", "n_words", F.coalesce("hits", F.lit([]).cast(HITS)).alias("hits"), F.coalesce("items", F.lit([]).cast("array<string>")).alias("items"))


def remove_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``docs`` with their hit stretches cut out of ``text``, from a stretch's first word to its last; documents of
    which over ``max_coverage`` of the words are hit go whole. ``n_chars``, where there is one, follows the text."""
    rounds, context = in_rounds(benchmark, shard_words), docs.sparkSession.sparkContext
    first = next(rounds)
    second = next(rounds, None)
    names = docs.columns
    place = names.index("text")

    def kept(batch: pa.RecordBatch, block: TextBlock, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray, hit: np.ndarray) -> pa.RecordBatch:
        words = np.bincount(doc, minlength=block.n)
        covered = np.bincount(doc, weights=hit, minlength=block.n) if len(hit) else np.zeros(block.n)
        out = batch.column(place).to_pylist()
        edges = np.searchsorted(doc, np.arange(block.n + 1))
        for d in np.flatnonzero((covered > 0) & (covered <= max_coverage * words)):
            raw, base = out[d].encode(), int(block.offs[d])
            at, parts = 0, []
            mine = edges[d] + np.flatnonzero(hit[edges[d] : edges[d + 1]])
            for run in np.split(mine, np.flatnonzero(np.diff(mine) > 1) + 1):
                parts.append(raw[at : starts[run[0]] - base])
                at = int(ends[run[-1]]) - base
            out[d] = b"".join([*parts, raw[at:]]).decode()
        columns = [pa.array(out, pa.string()) if i == place else c for i, c in enumerate(batch.columns[: len(names)])]
        if "n_chars" in names:
            k = names.index("n_chars")
            lengths = pa.array([None if t is None else len(t) for t in out], pa.int64()).cast(columns[k].type)
            columns[k] = pc.if_else(pa.array(covered > 0), lengths, columns[k])
        return pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(covered <= max_coverage * words))

    if second is None:
        shared = context.broadcast(first)
        return map_steps(docs, lambda b: kept(b, *mark_all(shared.value, b.column(place), window)[:5]), docs.schema, size=_steps(len(first)))
    row = f"_row_{uuid.uuid4().hex[:8]}"
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = _numbered_finds(numbered, itertools.chain([first, second], rounds), window, row).withColumnRenamed("hits", f"{row}_hits")

    def by_spans(batch: pa.RecordBatch) -> pa.RecordBatch:
        block, starts, ends, doc, _ = words_of(batch.column(place))
        edges, edge = np.searchsorted(doc, np.arange(block.n + 1)), np.zeros(len(doc) + 1, np.int64)
        for d, spans in enumerate(batch.column(len(names)).to_pylist()):
            for h in spans or ():
                edge[edges[d] + h["start"]] += 1
                edge[edges[d] + h["end"]] -= 1
        return kept(batch, block, starts, ends, doc, np.cumsum(edge[:-1]) > 0)

    return map_steps(numbered.join(found, row, "left").select(*names, f"{row}_hits"), by_spans, docs.schema)


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without any document that holds a window of an item: ``remove_matches`` with no coverage allowed."""
    return remove_matches(docs, benchmark, window, max_coverage=0.0)


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """op8's rows."""
    found = find_matches(docs, benchmark)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda t, h: t + h["end"] - h["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )

