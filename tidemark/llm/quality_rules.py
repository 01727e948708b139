"""5. Quality rules: counts of a text's own repetition, and bands of n-gram perplexity by language.

A document's perplexity is that of its characters under the Kneser-Ney model of its language, counted over the other
half of the corpus: texts are dealt into two halves by a hash of the text, so that neither a document nor an exact copy
of it vouches for itself. Every document teaches one half and is scored by the other. Bands are set around
the median of a language's distinct texts, whatever their length; texts beyond either edge are rejected. A language of
few texts has neither a model nor a band of its own: those of the whole corpus stand in.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import kneser_ney as kn
from tidemark.llm.common import batch_of, cut, ids_of, map_steps, stored, texts_of
from tidemark.llm.textblock import NOT_SPACE, TextBlock, by_doc, group_ids, mix, windows

LEAST_WORDS, MOST_REPEATED = 20, 30  # words; percent of words in repeated windows
REPEAT_WINDOW = 8
#: Half a band's width, in robust standard deviations above and below the median.
WIDTH = 4.0
#: A band is never narrower than this many nats a character on either side.
LEAST_WIDTH = 0.1
#: Distinct texts that a language needs for a model and a band of its own.
LEAST_TEXTS = 20
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
NOT_NEWLINE = np.ones(256, bool)
NOT_NEWLINE[0x0A] = False


def base_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """By text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    block = TextBlock(texts)
    starts, ends, doc = block.spans(NOT_SPACE)
    words, inside = block.hashes(starts, ends), NOT_SPACE[block.buf]
    out = {"n_words": np.bincount(doc, minlength=block.n), "word_chars": block.counts(inside & block.chars()), "n_symbols": block.counts(SYMBOLS[block.buf])}
    a, b, of = block.spans(NOT_NEWLINE)
    before = np.zeros(len(block.buf) + 1, np.int64)
    np.cumsum(inside, out=before[1:])
    worded = before[b] > before[a]
    a, b, of = a[worded], b[worded], of[worded]
    codes, distinct = group_ids(mix(block.hashes(a, b) + of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    first = np.zeros(len(distinct), np.int64)
    first[codes[::-1]] = of[::-1]
    out["n_dup_lines"] = np.bincount(of, minlength=block.n) - np.bincount(first, minlength=block.n)
    hashes, at = windows(words, doc, REPEAT_WINDOW)
    codes, distinct = group_ids(mix(hashes + doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    often = at[np.bincount(codes, minlength=len(distinct))[codes] > 1]
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, often, 1)
    np.add.at(edge, often + REPEAT_WINDOW, -1)
    out["n_repeat_words"] = by_doc((np.cumsum(edge[:-1]) > 0).astype(np.float64), doc, block.n).astype(np.int64)
    return out


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def count(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, lang, the five base counts) for each row of ``docs``; null text: no words."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = base_counts(texts_of(batch))
        return batch_of(doc_id=ids_of(batch), lang=texts_of(batch, "lang"), **{k: pa.array(counts[k], pa.int64()) for k in COUNTS})

    return map_steps(docs.select("doc_id", "text", "lang"), work, "doc_id long, lang string, " + ", ".join(f"{k} long" for k in COUNTS))


def in_halves(docs: DataFrame) -> DataFrame:
    """``docs`` with ``copy``, a hash of the text, and ``half``."""
    return docs.withColumn("copy", F.xxhash64("text")).withColumn("half", F.pmod(F.col("copy"), F.lit(2)))


def rare_languages(halves: DataFrame, least: int = LEAST_TEXTS) -> DataFrame:
    """Rows (lang) of the languages with fewer than ``least`` distinct texts."""
    found = halves.where(F.octet_length("text") > 0).groupBy("lang").agg(F.count_distinct("copy").alias("n"))
    return cut(found.where(F.col("n") < least).select("lang"))


def gram_counts(halves: DataFrame) -> DataFrame:
    """The stored n-gram counts of each language in each half, named 0 or 1 and the language."""
    return stored(kn.count_grams(halves.select("text", F.concat(F.col("half").cast("string"), F.col("lang")).alias("lang"))), "grams")


def fit(counts: DataFrame, pooled: bool) -> DataFrame:
    """A model of each language in each half; if ``pooled``, also of all languages in each half, named 2 or 3."""
    if pooled:
        name = (F.substring("lang", 1, 1).cast("int") + 2).cast("string").alias("lang")
        counts = stored(counts.unionByName(counts.groupBy(name, "gram").agg(F.sum("c").alias("c"))), "grams")
    return kn.fit_counts(counts)


def judged_by(rows: DataFrame, rare: DataFrame | None, half: Column, lang: Column) -> DataFrame:
    """``rows`` with ``judge``, the name of the model that scores a text of that half and language: the other half's.
    ``rare`` has a row for each language of few texts."""
    other = 1 - half
    own = F.concat(other.cast("string"), lang)
    if rare is None:
        return rows.withColumn("judge", own)
    marked = rows.join(F.broadcast(rare.select(F.col("lang").alias("_rare"))), lang == F.col("_rare"), "left")
    return marked.withColumn("judge", F.when(F.col("_rare").isNotNull(), (other + 2).cast("string")).otherwise(own)).drop("_rare")


def perplexity(docs: DataFrame, shares: DataFrame, head: int = kn.HEAD) -> DataFrame:
    """Rows (doc_id, lang, copy, base counts, n_chars, nats), stored: ``nats`` is the negative log share a character under
    the model that ``judge`` names; null where a text has no character. ``shares``: those of all n-grams of the texts.
    The texts are read once; what the broadcast head of the shares doesn't hold of them is joined by hash."""
    keys, values, whole = kn.head_of(shares, head)
    shared = docs.sparkSession.sparkContext.broadcast((keys, values))
    numbered = docs.select("doc_id", "text", "lang", "copy", "judge", F.monotonically_increasing_id().alias("_row"))
    beyond = pa.list_(pa.struct([("key", pa.int64()), ("n", pa.int64())]))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, n = texts_of(batch), batch.num_rows
        counts = base_counts(texts)
        padded, place, doc = kn.coded(texts)
        known, (of, key, times) = kn.look_up(shared.value, padded, place, doc, kn.lang_hashes(texts_of(batch, "judge"))[doc], n)
        edges = np.searchsorted(of, np.arange(n + 1)).astype(np.int32)
        rest = pa.ListArray.from_arrays(pa.array(edges), pa.StructArray.from_arrays([pa.array(key.view(np.int64)), pa.array(times.astype(np.int64))], ["key", "n"]))
        return batch_of(
            _row=texts_of(batch, "_row"), doc_id=ids_of(batch), lang=texts_of(batch, "lang"), copy=texts_of(batch, "copy"), **{k: pa.array(counts[k], pa.int64()) for k in COUNTS},
            n_chars=pa.array(np.bincount(doc, minlength=n), pa.int64()), loss=pa.array(-known), beyond=rest.cast(beyond),
        )

    schema = "_row long, doc_id long, lang string, copy long, " + ", ".join(f"{k} long" for k in COUNTS) + ", n_chars long, loss double, beyond array<struct<key:long,n:long>>"
    found = stored(map_steps(numbered, work, schema), "perplexity")
    shared.destroy()
    if not whole:
        rest = found.select("_row", F.inline("beyond")).join(shares.select("key", "value"), "key").groupBy("_row").agg(F.sum(F.col("n") * F.col("value")).alias("more"))
        found = stored(found.drop("beyond").join(rest, "_row", "left").withColumn("loss", F.col("loss") - F.coalesce("more", F.lit(0.0))), "perplexity")
    return found.withColumn("nats", F.col("loss") / F.nullif(F.col("n_chars"), F.lit(0))).drop("_row", "loss", "beyond", "more")


def bands(scored: DataFrame, width: float = WIDTH, least: int = LEAST_TEXTS) -> tuple[DataFrame, DataFrame]:
    """Rows (lang, low, high), the edges of the band in nats a character by language, of those with ``least`` distinct
    texts; and one row (low, high) of the whole corpus. Copies of a text weigh as one."""
    q = F.percentile_approx("nats", [0.25, 0.5, 0.75], 10_000).alias("q")
    once = scored.where(F.col("nats").isNotNull()).groupBy("lang", "copy").agg(F.first("nats").alias("nats"))
    side = lambda a, b: F.greatest(F.lit(width / 0.6745) * (F.col("q")[b] - F.col("q")[a]), F.lit(LEAST_WIDTH))
    low, high = (F.col("q")[1] - side(0, 1)).alias("low"), (F.col("q")[1] + side(1, 2)).alias("high")
    by_language = once.groupBy("lang").agg(q, F.count("*").alias("n")).where(F.col("n") >= least)
    return by_language.select("lang", low, high), once.agg(q).select(low, high)


def apply_rules(docs: DataFrame, width: float = WIDTH) -> DataFrame:
    """The operator: rows (doc_id, base counts, base_failed, perplexity, low, high, kept), one for each row of ``docs``.

    ``low`` and ``high`` are the band's edges as perplexities. Null and empty texts fail the base rules. A null
    language is a language of its own. A corpus of fewer distinct texts than a language needs has only those to set a band by. An empty table gives no rows; further columns are ignored.
    """
    docs = in_halves(docs.select("doc_id", "text", F.coalesce("lang", F.lit("")).alias("lang")))
    rare = rare_languages(docs)
    pooled = not rare.isEmpty()
    counts = gram_counts(docs)
    wanted = judged_by(counts, rare if pooled else None, F.substring("lang", 1, 1).cast("int"), F.expr("substring(lang, 2)"))
    shares = kn.shares_of(fit(counts, pooled), wanted)
    scored = perplexity(judged_by(docs, rare if pooled else None, F.col("half"), F.col("lang")), shares)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    own, whole = bands(scored, width)
    least, most = whole.first()  # two numbers
    judged = scored.join(F.broadcast(own), "lang", "left")
    judged = judged.withColumn("low", F.coalesce("low", F.lit(least).cast("double"))).withColumn("high", F.coalesce("high", F.lit(most).cast("double"))).withColumn("base_failed", failed)
    inside = F.coalesce(F.col("nats").between(F.col("low"), F.col("high")), F.lit(False))
    return judged.select("doc_id", *COUNTS, "base_failed", F.exp("nats").alias("perplexity"), F.exp("low").alias("low"), F.exp("high").alias("high"), (~F.col("base_failed") & inside).alias("kept"))


def digest(docs: DataFrame) -> DataFrame:
    """op5's rows."""
    return apply_rules(docs).select("doc_id", *COUNTS, "base_failed", "kept")
