"""4. Token counts as delta-maintained rollups.

A batch is a set of signed changes: a document's counts come in with sign +1 and go out with -1, a revised count is
both. A batch is added up by source, language and tokenizer version in Spark and committed as one small table under
its own name, so committing a name again changes nothing. Totals are sums over committed batches; folding adds the
committed batches into one.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import batch_of, ids_of, map_steps, shared_dir, stored, texts_of
from tidemark.llm.textblock import NOT_SPACE, TextBlock
from tidemark.llm.tokens import BpeEncoder

KEYS = ("source", "lang", "tokenizer_version")
TOTALS = ("documents", "tokens")
SCHEMA = "source string, lang string, tokenizer_version string, documents long, tokens long"


def _words(texts: pa.Array) -> np.ndarray:
    block = TextBlock(texts)
    return np.bincount(block.spans(NOT_SPACE)[2], minlength=block.n)


def _bpe(texts: pa.Array) -> np.ndarray:
    return np.array([len(x) for x in BpeEncoder().encode(texts)], np.int64)


#: Tokenizer versions as (counter, tokens added to each document): words between white space; the public byte-level BPE;
#: the same with an end id for each document.
VERSIONS = {"words/1": (_words, 0), "byte_bpe_50k/1": (_bpe, 0), "byte_bpe_50k/2": (_bpe, 1)}


def count_tokens(docs: DataFrame, versions: tuple[str, ...]) -> DataFrame:
    """Rows (doc_id, source, lang, tokenizer_version, tokens): one for each row of ``docs`` and version. Null text has no token."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, n = texts_of(batch), batch.num_rows
        counted = {f: f(texts) for f in {VERSIONS[v][0] for v in versions}}  # versions that share a counter count once
        repeated = pa.array(np.tile(np.arange(n), len(versions)))
        return batch_of(
            doc_id=ids_of(batch).take(repeated), source=texts_of(batch, "source").take(repeated), lang=texts_of(batch, "lang").take(repeated),
            tokenizer_version=pa.array(np.repeat(np.array(versions, object), n), pa.string()),
            tokens=pa.array(np.concatenate([counted[f] + more for f, more in (VERSIONS[v] for v in versions)]).astype(np.int64)),
        )

    return map_steps(docs.select("doc_id", "text", "source", "lang"), work, "doc_id long, source string, lang string, tokenizer_version string, tokens long")


def inserts(counts: DataFrame) -> DataFrame:
    return counts.withColumn("sign", F.lit(1))


def deletes(counts: DataFrame) -> DataFrame:
    return counts.withColumn("sign", F.lit(-1))


def revisions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Counts that replace others: the old ones go out, the new ones come in."""
    return deletes(before).unionByName(inserts(after))


def _checked(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", name):
        raise ValueError(f"not a batch name: {name!r}")
    return name


class Rollup:
    """Totals by source, language and tokenizer version in a folder that driver and executors share.

    One writer at a time. Each committed batch is a folder ``batch=<name>``; it counts once Spark's own commit has left
    its _SUCCESS mark, which is the last thing written, so a batch whose writer was lost is written anew on retry. A fold
    is such a batch too, and the names that it took in are written before it: its mark alone puts it in their place, so
    at whatever step a fold stops, totals are those before or after it, which are the same.
    """

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, (root or f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}").rstrip("/")

    def _path(self, path: str):
        jvm = self.spark._jvm
        found = jvm.org.apache.hadoop.fs.Path(path)
        return found, found.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _marked(self) -> list[str]:
        root, fs = self._path(self.root)
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return sorted(n[6:] for n in names if n.startswith("batch=") and fs.exists(self._path(f"{self.root}/{n}/_SUCCESS")[0]))

    def _taken_in(self, names: list[str]) -> DataFrame | None:
        """Rows (name) of the batches that the folds among ``names`` took in."""
        paths = [f"{self.root}/names/of={n}" for n in names if n.startswith("folded-")]
        return self.spark.read.schema("name string").parquet(*paths) if paths else None

    def committed(self) -> list[str]:
        """Names of the batches that totals add up, in the order of their names: those that no fold took in."""
        names = self._marked()
        taken = self._taken_in(names)
        if taken is None:
            return names
        gone = {r[0] for r in taken.where(F.col("name").isin(names)).collect()}
        return [n for n in names if n not in gone]

    def covers(self, name: str) -> bool:
        """Whether totals include the batch, by itself or within a fold."""
        names = self._marked()
        if name in names:
            return True
        taken = self._taken_in(names)
        return taken is not None and not taken.where(F.col("name") == name).isEmpty()

    def commit(self, name: str, changes: DataFrame) -> bool:
        """Adds up signed ``changes`` (KEYS, tokens, sign) and commits them as batch ``name``. False: it was committed before.

        Null keys are keys of their own; an empty batch commits and changes nothing. A name of other than letters,
        digits and ``_.-`` is a ValueError.
        """
        _checked(name)
        return self.commit_sums(name, changes.select(*KEYS, F.col("sign").cast("long").alias("documents"), (F.col("sign") * F.col("tokens")).alias("tokens")))

    def commit_sums(self, name: str, changes: DataFrame) -> bool:
        """As ``commit``, for changes that are signed sums already: (KEYS, documents, tokens)."""
        if self.covers(_checked(name)):
            return False
        added = changes.groupBy(*KEYS).agg(*[F.sum(F.col(c).cast("long")).alias(c) for c in TOTALS])
        added.write.mode("overwrite").parquet(f"{self.root}/batch={name}")
        return True

    def apply(self, batches: Mapping[str, DataFrame]) -> dict[str, bool]:
        return {name: self.commit(name, changes) for name, changes in batches.items()}

    def totals(self) -> DataFrame:
        """(KEYS, documents, tokens): keys whose documents and tokens have all gone are left out."""
        paths = [f"{self.root}/batch={n}" for n in self.committed()]
        rows = self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)
        summed = rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in TOTALS])
        return summed.where((F.col("documents") != 0) | (F.col("tokens") != 0))

    def fold(self) -> None:
        """Puts one batch in place of all committed ones. Their names stay known."""
        names = self.committed()
        if len(names) < 2:
            return
        folded = f"folded-{uuid.uuid4().hex}"
        known = self.spark.createDataFrame([(n,) for n in names], "name string")
        if (before := self._taken_in(names)) is not None:
            known = known.unionByName(before).distinct()
        known.write.mode("overwrite").parquet(f"{self.root}/names/of={folded}")
        self.totals().coalesce(1).write.parquet(f"{self.root}/batch={folded}")
        self.recover()

    def recover(self) -> None:
        """Removes the folders that a fold has taken the place of; a fold does so itself unless it is cut short."""
        live = set(self.committed())
        for name in [n for n in self._marked() if n not in live]:
            path, fs = self._path(f"{self.root}/batch={name}")
            fs.delete(path, True)


def maintained_totals(docs: DataFrame, root: str | None = None) -> DataFrame:
    """op4's rows. The table comes in under words and BPE counts; then every BPE count is revised to the next version,
    which counts a document's end id too; the second batch is committed again, to no effect. Null texts count as empty, a
    null source or language is a key of its own, repeated rows count again; an empty table gives no rows."""
    rollup = Rollup(docs.sparkSession, root)
    counted = stored(count_tokens(docs, tuple(VERSIONS)), "token-counts")
    version = lambda *names: counted.where(F.col("tokenizer_version").isin(*names))
    rollup.commit("load", inserts(version("words/1", "byte_bpe_50k/1")))
    revised = revisions(version("byte_bpe_50k/1"), version("byte_bpe_50k/2"))
    for _ in range(2):
        rollup.commit("revise", revised)
    return rollup.totals()
