"""10. Best-fit packing: documents become token pieces, and pieces share sequences with as little unused room as can be.

Pieces are dealt evenly into groups of bounded size. Within a group, best-fit decreasing gives a first packing; a
swap-based local search then moves, exchanges one for one and exchanges two for one, either way, between underfull sequences. Each
accepted step raises the sum of squared fills, so the emptiest sequences drain until they are gone. It goes on until no
such step is left.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.llm.common import batch_of, ids_of, map_steps, narrow, stored, texts_of
from tidemark.llm.tokens import BpeEncoder

SEQUENCE = 1024
END_ID = 2
#: Pieces in one packing group. The room lost by packing groups apart is at most about a sequence a group.
GROUP_PIECES = 20_000

PIECES = "doc_id long, piece int, start long, length long, ids binary"


def tokenize_pieces(docs: DataFrame, sequence: int = SEQUENCE, end_id: int = END_ID, json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids): each document's ids plus ``end_id``, cut only where longer than a
    sequence; all pieces but the first are then full. ``ids``: little-endian unsigned 32-bit.

    Null and empty texts are the end id alone. Rows with the same or a null doc_id stay rows of their own. An empty
    table gives no rows; further columns are ignored.
    """

    def work(batch: pa.RecordBatch, encoder: BpeEncoder) -> pa.RecordBatch:
        ids, rows = ids_of(batch).to_pylist(), ([], [], [], [], [])
        for doc, tokens in zip(ids, encoder.encode(texts_of(batch)), strict=True):
            raw = np.append(tokens, np.uint32(end_id)).astype("<u4")
            head = len(raw) % sequence or sequence
            edges = [0, *range(head, len(raw) + 1, sequence)]
            for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                for column, value in zip(rows, (doc, k, a, b - a, raw[a:b].tobytes()), strict=True):
                    column.append(value)
        return batch_of(doc_id=pa.array(rows[0], pa.int64()), piece=pa.array(rows[1], pa.int32()), start=pa.array(rows[2], pa.int64()), length=pa.array(rows[3], pa.int64()), ids=pa.array(rows[4], pa.binary()))

    return map_steps(narrow(docs, "doc_id", "text"), work, PIECES, setup=lambda: BpeEncoder(json_path, ranks_path))


def best_fit_decreasing(lengths: np.ndarray, room: int) -> list[list[int]]:
    """Bins as lists of item numbers: each item, longest first, goes to the fullest bin that it fits in."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(room + 1)]
    some = 0  # bit r: a bin with r left exists
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        if fitting := some >> n:
            left = n + (fitting & -fitting).bit_length() - 1
            k = by_room[left].pop()
            if not by_room[left]:
                some &= ~(1 << left)
            bins[k].append(i)
            left -= n
        else:
            k, left = len(bins), room - n
            bins.append([i])
        if left:
            by_room[left].append(k)
            some |= 1 << left
    return bins


class _Search:
    """Local search over the underfull bins of one group.

    For every underfull bin and every size, two tables tell the least item, and the least sum of two items, of at least
    that size in the bin. So the best step from one bin to any other takes a few lookups, made for all bins at once.
    """

    def __init__(self, lengths: np.ndarray, bins: list[list[int]], room: int):
        self.length, self.room, self.bins = lengths.tolist(), room, bins
        self.fill = [sum(self.length[i] for i in b) for b in bins]

    def _index(self, i: int) -> None:
        size = np.array([self.length[x] for x in self.bins[self.under[i]]], np.int64)
        self.slack[i] = self.room - size.sum() if len(size) else 0
        sums = (size[:, None] + size)[np.triu_indices(len(size), 1)]
        for table, there in ((self.one, size), (self.two, sums[sums <= self.room])):
            table[i] = self.room + 1
            table[i, there] = there
            np.minimum.accumulate(table[i, ::-1], out=table[i, ::-1])

    def _pick(self, i: int, total: int, two: bool) -> list[int]:
        """An item of bin i of that size, or two of that sum."""
        seen: dict[int, int] = {}
        for x in self.bins[self.under[i]]:
            if not two and self.length[x] == total:
                return [x]
            if two and total - self.length[x] in seen:
                return [seen[total - self.length[x]], x]
            seen[self.length[x]] = x
        return []

    def _give(self, i: int) -> bool:
        """The step that fills some bin, no emptier than bin i, most at its expense, if there is one: one or two items go
        there, and none, one or two (for one) come back."""
        size = [self.length[x] for x in self.bins[self.under[i]]]
        single = np.unique(size)
        double = np.unique((np.array(size)[:, None] + size)[np.triu_indices(len(size), 1)])
        double = double[double < self.room]
        filled = self.room - self.slack
        to = np.flatnonzero((self.slack > 0) & (filled >= filled[i]))
        to = to[to != i]
        if not len(to):
            return False
        best = (0, 0, 0, 0, False, False)  # gain, bin, given, taken, given by two, taken by two
        for gives, pair in ((single, False), (double, True)):
            if not len(gives):
                continue
            least = np.maximum(gives[:, None] - self.slack[to], 1)
            ways = [(self.one, False)] + ([] if pair else [(self.two, True)])
            for table, taken_two in ways:
                take = table[to, least]
                gain = np.where(take < gives[:, None], gives[:, None] - take, 0)
                if not taken_two and not pair:  # a move
                    moved = gives[:, None] <= self.slack[to]
                    take, gain = np.where(moved, 0, take), np.where(moved, gives[:, None], gain)
                at = int(gain.argmax())
                r, c = divmod(at, len(to))
                if gain[r, c] > best[0]:
                    best = (int(gain[r, c]), int(to[c]), int(gives[r]), int(take[r, c]), pair, taken_two)
        gain, j, given, taken, pair, taken_two = best
        if not gain:
            return False
        give, take = self._pick(i, given, pair), self._pick(j, taken, taken_two) if taken else []
        for k, out, come in ((i, give, take), (j, take, give)):
            b = self.under[k]
            self.bins[b] = [x for x in self.bins[b] if x not in out] + come
            self.fill[b] = sum(self.length[x] for x in self.bins[b])
            self._index(k)
        return True

    def run(self, steps: int | None = None) -> list[list[int]]:
        """Rounds over the underfull bins, the emptiest giving first, until none has a step left, or as few bins are left
        as can be. Every step raises the sum of squared fills, so it ends; ``steps`` may end it sooner."""
        self.under = sorted((k for k in range(len(self.bins)) if 0 < self.fill[k] < self.room), key=self.fill.__getitem__)
        self.slack = np.zeros(len(self.under), np.int64)
        self.one, self.two = (np.zeros((len(self.under), self.room + 1), np.int16 if self.room < 32_000 else np.int32) for _ in range(2))
        for i in range(len(self.under)):
            self._index(i)
        changed = True
        while changed and self.slack.sum() >= self.room:
            changed = False
            for i in np.argsort(-self.slack, kind="stable").tolist():
                while self.slack[i] > 0 and self.slack.sum() >= self.room and (steps is None or steps > 0) and self._give(i):
                    changed = True
                    steps = steps if steps is None else steps - 1
        return [b for b in self.bins if b]


def pack_lengths(lengths: np.ndarray, room: int = SEQUENCE, steps: int | None = None) -> list[list[int]]:
    """Bins as lists of item numbers: best-fit decreasing, then the local search. Every item is in one bin."""
    return _Search(lengths, best_fit_decreasing(lengths, room), room).run(steps)


def pack_pieces(pieces: DataFrame, sequence: int = SEQUENCE, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces with a ``length`` of 1 to ``sequence``; other columns stay.

    Give it a stored table: it is read for its number of rows and again for its rows. Full pieces are sequences of
    their own. The others are dealt by row number, whatever their values, into groups of about ``group_pieces``, so
    equal or repeated pieces gather nowhere. An empty table gives no rows.
    """
    short = pieces.where(F.col("length") < sequence)
    groups = max(1, -(-short.count() // group_pieces))
    full = pieces.where(F.col("length") >= sequence).withColumns({"sequence_id": F.monotonically_increasing_id() * 2 + 1, "offset": F.lit(0).cast("long")})
    dealt = short.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int"))
    schema = StructType([*pieces.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        lengths = group["length"].to_numpy()
        sequence_id, offset = np.zeros(len(group), np.int64), np.zeros(len(group), np.int64)
        base = int(group["_group"].iloc[0]) << 32
        for k, items in enumerate(pack_lengths(lengths, sequence)):
            sequence_id[items] = (base + k) * 2
            offset[items] = np.cumsum(lengths[items]) - lengths[items]
        return group.drop(columns="_group").assign(sequence_id=sequence_id, offset=offset)

    packed = dealt.groupBy("_group").applyInPandas(pack, schema)
    return full.select(*schema.names).unionByName(packed)


def pack_documents(docs: DataFrame, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """The operator: (doc_id, piece, start, length, ids, sequence_id, offset) with the ids themselves."""
    return pack_pieces(stored(tokenize_pieces(docs, sequence, end_id), "pieces"), sequence)


def packed_digest(docs: DataFrame) -> DataFrame:
    """op10's rows: as ``pack_documents``, with the CRC-32 of each piece's ids in their stead."""
    pieces = tokenize_pieces(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack_pieces(stored(pieces, "pieces")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """One row a sequence, from rows with ids: (sequence_id, ids). At most ``sequence`` ids meet in a row."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"])).alias("ids"))


