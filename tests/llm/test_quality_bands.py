"""Random letters planted among the documents, alone and in exact copies, must not vouch for themselves."""

import math
import time

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import kneser_ney as kn
from tidemark.llm import quality_rules as Q

LENGTHS = (2_000, 12_000, 48_000)
COPIES = 12


@pytest.fixture(scope="module")
def judged(spark, documents):
    rng, letters = np.random.default_rng(3), list("abcdefghijklmnopqrstuvwxyz    ")
    junk = lambda n: "".join(rng.choice(letters, n))
    rows = [(10**6 + k, junk(n), "en") for k, n in enumerate(LENGTHS)]
    rows += [(2 * 10**6 + 100 * k + i, text, "de") for k, text in enumerate(map(junk, LENGTHS)) for i in range(COPIES)]
    rows += [(3 * 10**6, junk(150_000), "en"), (3 * 10**6 + 1, junk(9_000), "xx")]
    planted = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return {r["doc_id"]: r for r in Q.apply_rules(documents.select("doc_id", "text", "lang").union(planted)).collect()}


def test_junk_is_scored_by_a_model_without_it(judged):
    planted = {k: r for k, r in judged.items() if k >= 10**6}
    assert len(planted) == len(LENGTHS) * (1 + COPIES) + 2
    assert all(math.log(r["perplexity"]) > 3 for r in planted.values())


def test_junk_is_rejected_whatever_its_class(judged):
    """Alone in its language or length, or most of its class by copies: none is kept, and the good texts stay."""
    assert not any(r["kept"] for k, r in judged.items() if k >= 10**6)
    good = [r for k, r in judged.items() if k < 10**6 and not r["base_failed"]]
    assert sum(r["kept"] for r in good) > 0.85 * len(good)


def test_keys_are_sought_in_order():
    rng = np.random.default_rng(8)
    keys = np.unique(rng.integers(0, 1 << 63, 3_000_000).astype(np.uint64))
    wanted = np.concatenate([rng.choice(keys, 150_000), rng.integers(0, 1 << 63, 50_000).astype(np.uint64), [np.uint64(0), np.uint64((1 << 64) - 1)]])
    spent = {}
    for name, search in {"plain": lambda: np.searchsorted(keys, wanted), "ordered": lambda: kn.found_in(keys, wanted)}.items():
        taken = []
        for _ in range(3):
            began = time.thread_time()
            found = search()
            taken.append(time.thread_time() - began)
        spent[name] = min(taken), found
    at = np.minimum(spent["plain"][1], len(keys) - 1)
    known, place = spent["ordered"][1]
    assert (known == (keys[at] == wanted)).all() and (place == at).all()
    assert spent["ordered"][0] < 0.7 * spent["plain"][0]
    assert not kn.found_in(keys[:0], wanted)[0].any()


def test_side_by_side_hashes_are_those_by_place():
    texts = pa.array(["", "a", "many words and more words", None, "ñandú 漢字 \U0001f600", "x" * 300])
    padded, place, doc = kn.coded(texts)
    lang = kn.lang_hashes(pa.array(["en", "de", "", "en", "es", "fr"]))[doc]
    whole = kn._quick(padded, place, lang, kn.ORDER)
    some = np.concatenate([kn._quick(padded, place[k : k + 9], lang[k : k + 9], kn.ORDER) for k in range(0, len(place), 9)])
    assert 18 < len(padded) and (whole == some).all()
    assert len(np.unique(whole[doc == 5])) == kn.ORDER
