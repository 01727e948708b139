import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import decontaminate as D
from tidemark.llm import licenses as L
from tidemark.llm import packing as P
from tidemark.llm import quality_rules as R
from tidemark.llm import simhash as S
from tidemark.llm import textblock as B
from tidemark.llm.tokens import BpeEncoder

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
TEXT = st.text(alphabet="ab cA.\n\t\v é漢#|7", max_size=60)


@given(st.lists(st.one_of(st.none(), TEXT), max_size=8))
@settings(max_examples=150, deadline=None)
def test_words_and_counts(texts):
    block = B.TextBlock(pa.array(texts, pa.string()))
    starts, ends, doc = block.spans(B.NOT_SPACE)
    want = [(k, w.encode()) for k, t in enumerate(texts) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    assert [(int(d), block.span_bytes(a, b)) for a, b, d in zip(starts, ends, doc)] == want
    h = block.hashes(starts, ends)
    assert len(set(zip(h.tolist()))) == len({w for _, w in want})
    counts = R.base_counts(pa.array(texts, pa.string()))
    for k, t in enumerate(t or "" for t in texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        spots: dict = {}
        for i in range(len(w) - 7):
            spots.setdefault(tuple(w[i : i + 8]), []).append(i)
        hit = {j for v in spots.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
        got = [int(counts[c][k]) for c in R.COUNTS]
        assert got == [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)]


def test_repeated_windows():
    words = "a b c d e f g h i j".split()
    text = " ".join(words + words[:9] + ["z"])
    assert R.base_counts(pa.array([text]))["n_repeat_words"].tolist() == [18]


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << i for i in range(64) if h and 2 * sum(x >> i & 1 for x in h) > len(h))


@given(st.lists(st.one_of(st.none(), TEXT), max_size=6))
@settings(max_examples=100, deadline=None)
def test_fingerprints(texts):
    assert S.fingerprints_of(pa.array(texts, pa.string())).tolist() == [fingerprint(t) for t in texts]


def test_anchors_meet_every_close_pair():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 62, 500, dtype=np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for bit in rng.choice(64, rng.integers(0, 4), replace=False):
            y[i] ^= np.uint64(1) << np.uint64(bit)
    n, a, home = S.anchors_of(x)
    m, b, _ = S.anchors_of(y)
    everywhere = set(zip(m.tolist(), b.tolist()))
    assert {k for k, c in zip(n[home].tolist(), a[home].tolist()) if (k, c) in everywhere} == set(range(500))
    assert np.bincount(n).max() <= 34


@given(st.lists(st.lists(st.integers(0, 3), max_size=14), max_size=5), st.lists(st.integers(0, 4), max_size=40), st.integers(2, 4))
@settings(max_examples=300, deadline=None)
def test_automaton_finds_every_window(items, doc, window):
    hashes = lambda ws: np.array([1000 + w for w in ws], np.uint64)
    automaton = D.ItemAutomaton([(k, hashes(w)) for k, w in enumerate(items)], window)
    hit, names = set(), set()
    for k, w in enumerate(items):
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            for j in range(len(doc) - n + 1):
                if doc[j : j + n] == w[i : i + n]:
                    hit |= set(range(j, j + n))
                    names.add(k)
    got, seen = set(), set()
    a, b, letter = automaton.runs(hashes(doc), np.zeros(len(doc), int))
    for x, y in zip(a.tolist(), b.tolist()):
        found, items_found = automaton.scan(letter[x:y].tolist())
        seen |= items_found
        for p, q in found:
            got |= set(range(x + p, x + q))
    assert (got, seen) == (hit, names)


@given(st.lists(st.integers(1, 64), max_size=120))
@settings(max_examples=150, deadline=None)
def test_packing_is_whole_and_tight(lengths):
    bins = P.pack_lengths(np.array(lengths, np.int64), 64)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 64 for b in bins)
    assert len(bins) <= len(P.best_fit_decreasing(np.array(lengths, np.int64), 64))


def test_local_search_empties_bins():
    search = P._Search(np.array([6, 4, 3, 5, 2]), [[0, 2], [1, 3], [4]], 10)
    before = sum(f * f for f in search.fill)
    bins = search.run()
    assert len(bins) == 2 and sum(sum([6, 4, 3, 5, 2][i] for i in b) ** 2 for b in bins) > before


def lcs(a, b):
    rows = [[0] * (len(b) + 1)]
    for x in a:
        rows.append([0])
        for j, y in enumerate(b):
            rows[-1].append(rows[-2][j] + 1 if x == y else max(rows[-2][j + 1], rows[-1][-1]))
    return rows[-1][-1]


def test_patience():
    rng = random.Random(1)
    for _ in range(300):
        a, b = [[rng.randint(0, 8) for _ in range(rng.randint(0, 12))] for _ in range(2)]
        m = L.patience(a, b)
        assert all(a[i] == b[j] for i, j in m) and len(m) <= lcs(a, b) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(m, m[1:]))
        a, b = rng.sample(range(12), 9), rng.sample(range(12), 9)
        assert len(L.patience(a, b)) == lcs(a, b)


def test_every_license_is_found_where_it_stands_twice():
    known = [L.Template(k, v) for k, v in L.TEMPLATES.items()]
    for name, text in L.TEMPLATES.items():
        words = D.words_of(pa.array(["the of a license. " * 20 + text + " to the work of version under " * 9 + "\n" + text]))[4].tolist()
        found = L.find_in(words, known)
        assert [(f[0], f[1]) for f in found] == [(name, 1.0)] * 2
    partly = L.TEMPLATES["MIT"].replace("free of charge", "at no cost").replace("Software", "Program", 1)
    assert L.find_in(D.words_of(pa.array([partly]))[4].tolist(), known)[0][0] == "MIT"


@pytest.fixture(scope="module")
def tokenizer():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_are_those_of_tokenizers(tokenizer):
    every = ["a" + chr(c) + "b " + chr(c) + chr(c) + " 1" + chr(c) for c in [*range(0xD800), *range(0xE000, 0x11000), 0x1F600, 0x20000]]
    texts = ["", None, "<|endoftext|> x", "it's  'Ll \n\n x", " lead", "tail  ", *("|".join(every[i : i + 50]) for i in range(0, len(every), 50))]
    got = BpeEncoder().encode(pa.array(texts))
    for t, ids in zip(texts, got):
        assert ids.tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_ids_of_any_text(tokenizer, text):
    text = text.encode("utf-8", "ignore").decode()
    assert BpeEncoder().encode(pa.array([text]))[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert zlib.crc32(b"") == 0
