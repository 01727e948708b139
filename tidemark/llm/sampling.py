"""Folds and bounded training samples of labelled documents."""

from __future__ import annotations

import io
import logging
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import give_back, stored

log = logging.getLogger("tidemark.llm")

#: Longest text, in bytes, that a training sample takes; scoring has no such bound.
SAMPLE_BYTES = 32_768
#: Ids looked up for each place in a sample.
SPARE = 4
#: How much wider a share of ids is looked at than one without repeats would need.
MARGIN = 8


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def held_out(doc_id: Column, folds: int, kept_back: int) -> Column:
    """Whether no label of this document may be learned. A null id has no label to learn: true."""
    return F.coalesce(fold(doc_id, folds) == kept_back, F.lit(True))


def first_ids(rows: DataFrame, n: int) -> DataFrame:
    """``n`` distinct ids of ``rows`` by the order of a hash of the id; no other column goes with them. Only ids of a share
    of the hash's values, MARGIN times as wide as ``n`` needs, are shuffled; where ids repeat more often than that, fewer
    than ``n`` may be left."""
    ids = rows.select("doc_id").where(F.col("doc_id").isNotNull())
    share = min(1.0, MARGIN * n / max(rows.count(), 1))
    some = ids.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < math.ceil(share * (1 << 20)))
    return some.distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)


def told(sample: DataFrame, what: str) -> DataFrame:
    """The sample, with its real size in the log."""
    log.info("%s: %d texts teach", what, sample.count())
    return sample


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, kept_back: int, of_each: dict[int, int], max_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """Rows (doc_id, text, y), stored: for each class y at most ``of_each[y]`` documents outside the fold ``kept_back``, by
    the order of a hash of the id, of texts up to ``max_bytes``.

    Ids are chosen from the labels first, SPARE times as many as wanted, so that texts which are missing or too long
    don't leave places empty. Their number is bounded by ``of_each``, so it is safe to broadcast them to the one scan of
    ``docs``. Labels that repeat an id count once (the greater one); null labels and ids don't count.
    """
    known = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isNotNull())
    known = known.where(~held_out(F.col("doc_id"), folds, kept_back)).groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = None
    for y, n in of_each.items():
        some = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SPARE * n)
        chosen = some if chosen is None else chosen.unionByName(some)
    texts = docs.select("doc_id", "text").where(F.octet_length("text") <= max_bytes)
    found = stored(texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")), "labelled")
    ids = None
    for y, n in of_each.items():
        some = first_ids(found.where(F.col("y") == y), n)
        ids = some if ids is None else ids.unionByName(some)
    return told(found.join(F.broadcast(ids), "doc_id", "left_semi"), label)


def fit_in_task(sample: DataFrame, fit: Callable[[pa.Table], dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """Runs ``fit`` on the rows of a bounded sample, ordered by doc_id, in one task, and brings the fitted arrays back.
    A lost executor only means that another one fits again; the same sample gives the same arrays."""
    schema = sample.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if got:
            out, ordered = io.BytesIO(), pa.Table.from_batches(got).sort_by("doc_id")
            got.clear()
            np.savez(out, **fit(ordered))
            del ordered
            yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], names=["fitted"])
            give_back()

    rows = sample.repartition(1).mapInArrow(run, "fitted binary").collect()
    if not rows:  # no labelled document
        return fit(pa.table({f.name: pa.array([], pa.int32() if f.name == "y" else pa.string() if f.name == "text" else pa.int64()) for f in schema.fields}))
    with np.load(io.BytesIO(rows[0]["fitted"])) as arrays:
        return {k: arrays[k] for k in arrays.files}
