"""Queries and operators against plain versions of the same rules: licenses, network findings, rules, rollups, the pipeline."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.test_models import brute_shares
from tidemark.llm import kneser_ney as K
from tidemark.llm import licenses as L
from tidemark.llm import quality_rules as R
from tidemark.llm import rollups, sampling
from tidemark.llm import secret_scan as S

FILLER = "river mountain harbour old town evening letter window garden paper".split()


# --- 6


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


def plain_match(a, b):
    """Patience alignment by recursion: equal ends, then words that stand once in both, longest increasing run by trying all."""
    if not a or not b:
        return []
    if a[0] == b[0]:
        return [(0, 0), *[(i + 1, j + 1) for i, j in plain_match(a[1:], b[1:])]]
    if a[-1] == b[-1]:
        return [*plain_match(a[:-1], b[:-1]), (len(a) - 1, len(b) - 1)]
    once = [(a.index(w), b.index(w)) for w in a if a.count(w) == 1 and b.count(w) == 1]
    best = [[] for _ in once]
    for k, (_, j) in enumerate(once):
        best[k] = max((best[m] for m in range(k) if once[m][1] < j), key=len, default=[]) + [once[k]]
    chain = max(best, key=len, default=[])
    if not chain:
        return []
    out, edges = list(chain), [(-1, -1), *chain, (len(a), len(b))]
    for (i, j), (p, q) in zip(edges, edges[1:]):
        out += [(i + 1 + x, j + 1 + y) for x, y in plain_match(a[i + 1 : p], b[j + 1 : q])]
    return sorted(out)


def plain_finds(text, templates, coverage):
    words, found = plain_words(text), []
    for name, template in templates.items():
        t, mine, width = plain_words(template), set(), 0
        while width < len(words):
            width = 2 * width or 2 * len(t)
            for a in range(0, max(len(words) - width // 2, 1), width // 2):
                some = [(k, w) for k, w in enumerate(words[a : a + width], a) if w in t]
                match = plain_match([w for _, w in some], t)
                if len(match) >= coverage * len(t):
                    first, last = some[match[0][0]][0], some[match[-1][0]][0] + 1
                    if last - first <= len(t) * 2 ** (len(match) / 4):
                        mine.add((len(match), first, last))
            if width >= 2 * len(t) * 2 ** (len(t) / 4):
                break
        taken = []
        for n, a, b in sorted(mine, key=lambda m: (-m[0], m[2] - m[1], m[1])):
            if all(b <= c or d <= a for _, _, c, d in taken):
                taken.append((n, name, a, b))
        found += taken
    size, kept, taken = {n: len(plain_words(t)) for n, t in templates.items()}, [], set()
    for f in sorted(found, key=lambda f: (f[0] ** 2 / size[f[1]], f[0], f[1]), reverse=True):
        mine = set(range(f[2], f[3]))
        if 2 * len(mine & taken) <= len(mine):
            kept.append(f)
            taken |= mine
    return sorted(((n, m / size[n], a, b) for m, n, a, b in kept), key=lambda x: (x[2], x[0]))


def test_licenses_match_a_plain_search(spark):
    rng = np.random.default_rng(8)
    templates = {k: L.TEMPLATES[k] for k in ("Apache-2.0-line", "MIT-line", "CC-BY-4.0-line", "CC-BY-SA-4.0-line", "MPL-2.0", "ISC")}
    texts = [None, "", "nothing of the kind"]
    for k in range(60):
        parts = []
        for _ in range(rng.integers(1, 4)):
            words = templates[list(templates)[rng.integers(0, len(templates))]].split()
            gap = int(rng.integers(0, 4)) if k % 2 else 0
            words = [w for w in words if rng.random() > 0.08]
            parts += [x for w in words for x in (w, *rng.choice(FILLER, gap))] + list(rng.choice(FILLER, rng.integers(0, 60)))
        texts.append(" ".join(parts))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: [tuple(f) for f in r["found"]] for r in L.scan(docs, templates).collect()}
    want = {i: plain_finds(t or "", templates, L.COVERAGE) for i, t in enumerate(texts)}
    assert sum(map(len, want.values())) > 60
    for i in want:
        assert [(n, pytest.approx(c), a, b) for n, c, a, b in want[i]] == got[i], i


def test_a_spread_license_is_found():
    """Whatever stands between its words, if enough of them match; a few common words far apart are none."""
    apache, mit = L.Template("Apache-2.0", L.TEMPLATES["Apache-2.0"]), L.Template("MIT-line", L.TEMPLATES["MIT-line"])
    spread = lambda text, gap: [x for w in plain_words(text) for x in (w, *["filler"] * gap)]
    code = lambda words: [hash(w) for w in words]
    for t in (apache, mit):
        t.words = code(plain_words(L.TEMPLATES[t.name]))
        t.counts = Counter(t.words)
    for gap in (0, 1, 2, 5, 40):
        found = L.find_in(code(["before"] * 30 + spread(L.TEMPLATES["Apache-2.0"], gap) + ["after"] * 30), [apache])
        assert [(n, c) for n, c, _, _ in found] == [("Apache-2.0", 1.0)] and found[0][2] == 30
    assert L.find_in(code(spread(L.TEMPLATES["MIT-line"], 1)), [mit]) and not L.find_in(code(spread(L.TEMPLATES["MIT-line"], 300)), [mit])


# --- 3


def plain_score(net, codes):
    """The network by loops, one window."""
    w = net.w
    response = []
    for p in range(len(codes) - S.WIDTH + 1):
        patch = np.concatenate([w["embed"][c] if c > 0 else np.zeros(S.EMBED) for c in codes[p : p + S.WIDTH]])
        response.append(np.maximum(patch @ w["filter"] + w["filter_bias"], 0))
    edges = (0, S.BEFORE, S.BEFORE + S.INSIDE - S.WIDTH + 1, len(response))
    top = np.concatenate([np.max(response[a:b], axis=0) for a, b in zip(edges, edges[1:])])
    logit = np.maximum(top @ w["dense"] + w["dense_bias"], 0) @ w["out"] + w["bias"][0]
    return 1 / (1 + math.exp(-(w["scale"][0] * logit + w["shift"][0])))


def plain_network_spans(text, net):
    covered = set()
    for pattern, least, group in ((S.ASSIGN, 6, 2), (S.ACCESS, 20, 0), (S.HEX, 24, 0)):
        for m in pattern.finditer(text):
            if len(m[group]) >= least:
                covered |= set(range(m.start(), m.end()))
    kept, start = [], None
    for i in range(len(text) + 1):
        inside = i < len(text) and re.match(r"[A-Za-z0-9+/_.=-]", text[i]) and i not in covered
        if inside and start is None:
            start = i
        if not inside and start is not None:
            run = text[start:i]
            if len(run) >= 16 and re.search("[0-9]", run) and re.search("[A-Za-z]", run):
                step, best = S.INSIDE // 2, 0.0
                starts = [*range(start, i - S.INSIDE, step), i - S.INSIDE] if i - start > S.INSIDE else [start]
                for a in starts:
                    b = min(a + S.INSIDE, i)
                    number = lambda c: ord(c) - 30 if 31 < ord(c) < 127 else 97 if c in "\n\t\r" else 1
                    left, middle, right = ([number(c) for c in x] for x in (text[max(0, a - S.BEFORE) : a], text[a:b], text[b : b + S.AFTER]))
                    codes = [0] * (S.BEFORE - len(left)) + left + middle + [0] * (S.INSIDE - len(middle)) + right + [0] * (S.AFTER - len(right))
                    best = max(best, plain_score(net, codes))
                if best >= net.w["threshold"][0]:
                    kept.append((start, i))
            start = None
    return kept


def test_network_findings_match_loops(spark, documents, sf):
    net = S.train_on(documents)
    key, mixed = "aB3dE5gH7jK9mN1pQ2rS4tU6vW8x0YzZ", "Zq9XwR7tLmN3pK/" + "0f" * 16 + "/Vb8YtR5wQ2sDfG7k"
    rows = [(r["doc_id"], r["text"]) for r in documents.where("length(text) < 4000").collect()]
    rows += [(10**6, f"see {key} here"), (10**6 + 1, f"a {mixed} b"), (10**6 + 2, "river/mountain/" * 8 + key + "/old/town" * 5), (10**6 + 3, None), (10**6 + 4, f"ü漢 {key}é\n{key}"), (10**6 + 5, "www.example.com/page7/path_of_words")]
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["found"] if s["kind"] == "net"] for r in S.find_secrets(spark.createDataFrame(rows, "doc_id long, text string"), net).collect()}
    want = {i: plain_network_spans(t or "", net) for i, t in rows}
    assert got == want and want[10**6] and want[10**6 + 2] and len(want[10**6 + 4]) == 2
    clean = S.redact(spark.createDataFrame([(1, f"a {mixed} b")], "doc_id long, text string"), net).first()["text"]
    assert "0f0f" not in clean


def test_many_findings_take_linear_time():
    import time

    net = S.train(["token = 0123456789abcdef01234567"])
    text = "x " + " ".join(f"password=abc{k:06d} river/{k}/mountain-harbour" for k in range(6000))
    began = time.monotonic()
    assert len(S.candidates(text)[0]) == 6000 and time.monotonic() - began < 3


def test_samples_are_bounded_and_filled(spark):
    docs = spark.createDataFrame([(k % 50, "token " + "x" * (40_000 if k % 2 else 10)) for k in range(400)] + [(None, "token")] * 9, "doc_id long, text string")
    got = [r["doc_id"] for r in S.training_sample(docs, pool=1000, sample=20).collect()]
    assert len(got) == len(set(got)) == 20 and all(d % 2 == 0 for d in got)
    labels = spark.createDataFrame([(k, k % 3 == 0) for k in range(50)], "doc_id long, y boolean")
    some = sampling.labelled_sample(docs, labels, "y", 5, 0, {1: 4, 0: 8}).collect()
    assert sum(r["y"] == 1 for r in some) == 4 and sum(r["y"] == 0 for r in some) == 8 and all(r["doc_id"] % 2 == 0 for r in some)


# --- 5


def plain_judgement(rows, halves):
    """Nats and verdicts by dictionaries: each text under the other half's model of its language."""
    texts = {half: [t for i, t in rows if t and halves[i] == half] for half in (0, 1)}
    share = {half: brute_shares(texts[half], K.ORDER) for half in (0, 1)}
    nats = {}
    for i, t in rows:
        marked = "\x02" * (K.ORDER - 1) + (t or "")
        if t:
            nats[i] = -sum(math.log(share[1 - halves[i]](marked[k : k + K.ORDER - 1], marked[k + K.ORDER - 1])) for k in range(len(t))) / len(t)
    once = sorted({t: nats[i] for i, t in rows if t}.values())
    low, mid, high = (once[math.ceil(q * len(once)) - 1] for q in (0.25, 0.5, 0.75))
    edge = lambda d: max(R.WIDTH / 0.6745 * d, R.LEAST_WIDTH)
    kept = {}
    for i, t in rows:
        n = len((t or "").split())
        kept[i] = n >= 20 and mid - edge(mid - low) <= nats[i] <= mid + edge(high - mid)
    return nats, kept


@pytest.mark.parametrize("head, part_entries", [(10**6, 10**6), (64, 200), (64, 30), (0, 10**6)])
def test_verdicts_match_dictionaries(spark, monkeypatch, head, part_entries):
    """With all shares broadcast, with few, and with none; with the model in one part, in many, and with most pairs split."""
    monkeypatch.setattr(R.kn, "HEAD", head)
    monkeypatch.setattr(R.perplexity, "__defaults__", (head,))
    monkeypatch.setattr(R.kn.shares_of, "__defaults__", (part_entries, K.ORDER))
    rng = np.random.default_rng(6)
    words = [f"{a}{b}{c}" for a in "bdfglmst" for b in "aeio" for c in "nrlk"]
    rows = [(k, " ".join(rng.permutation(words)[: rng.integers(22, 60)])) for k in range(60)]
    rows += [(100, rows[0][1]), (101, "zq xj " * 20), (102, "".join(rng.choice(list("qxzjwv "), 300))), (103, ""), (104, None), (105, "too short"), (106, "ñandú 漢字 " * 12)]
    docs = spark.createDataFrame([(i, t, "xx") for i, t in rows], "doc_id long, text string, lang string")
    halves = {r["doc_id"]: r["half"] for r in R.in_halves(docs).collect()}
    nats, kept = plain_judgement(rows, halves)
    got = {r["doc_id"]: r for r in R.apply_rules(docs).collect()}
    for i, _ in rows:
        assert (math.log(got[i]["perplexity"]) if got[i]["perplexity"] else None) == (pytest.approx(nats[i], abs=1e-4) if i in nats else None)
    # the pattern of repeats fails before the band is asked
    assert {i for i in got if got[i]["kept"]} == {i for i, ok in kept.items() if ok and not got[i]["base_failed"]}
    assert not got[102]["kept"] and sum(r["kept"] for r in got.values()) > 40


def test_symbols_and_repeated_lines(spark):
    rows = [(1, "a # b\n * \na # b\n\n   \n * \nx|y & <z>"), (2, "one\none\none"), (3, None), (4, "\n\n\n"), (5, "same\rsame\nsame\x0bsame"), (6, "50% of $3 * #漢\nñ\nñ ")]
    got = {r["doc_id"]: r for r in R.count(spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")).collect()}
    for i, t in rows:
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (got[i]["n_symbols"], got[i]["n_dup_lines"]) == (sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines))), i


# --- 4


def test_a_fold_that_stops_changes_nothing(spark, tmp_path, monkeypatch):
    """Stopped before, between and after its steps, and with its old folders left."""
    counts = spark.createDataFrame([(1, "s", "en", "v", 5), (2, None, "en", "v", 7)], "doc_id long, source string, lang string, tokenizer_version string, tokens long")
    r = rollups.Rollup(spark, str(tmp_path / "r"))
    for name in ("a", "b", "c"):
        r.commit(name, rollups.inserts(counts))
    totals = lambda: sorted(map(str, r.totals().collect()))
    want = totals()

    class Stop(Exception):
        pass

    from pyspark.sql.readwriter import DataFrameWriter

    real, left = DataFrameWriter.parquet, [0]

    def halting(self, path, *a, **k):
        if left[0] == 0:
            raise Stop
        left[0] -= 1
        return real(self, path, *a, **k)

    def stop(*_):
        raise Stop

    for writes in (0, 1, 2):
        left[0] = writes
        with monkeypatch.context() as m:
            m.setattr(DataFrameWriter, "parquet", halting)
            m.setattr(rollups.Rollup, "recover", stop)
            with pytest.raises(Stop):
                r.fold()
        assert totals() == want and not r.commit("a", rollups.inserts(counts)) and not r.commit("c", rollups.inserts(counts)) and totals() == want
    assert len(r.committed()) == 1
    r.recover()
    assert totals() == want and not r.commit("b", rollups.inserts(counts))
    assert r.commit("d", rollups.deletes(counts)) and r.totals().agg(F.sum("documents")).first()[0] == 4
    r.fold()
    assert r.totals().agg(F.sum("documents")).first()[0] == 4 and not r.commit("a", rollups.inserts(counts)) and not r.commit("d", rollups.deletes(counts))


# --- the pipeline


def test_the_pipeline_on_odd_and_empty_tables(spark, sf, tmp_path, odd_documents, no_documents):
    """Labels of one class alone teach nothing, so no text is toxic; the rest follows from what each stage defines."""
    import corpus_pipeline as pipe

    labels = spark.createDataFrame([(1, 1, 0), (None, None, None), (2, 0, 0)], "doc_id long, quality int, toxic int")
    for name, docs, want in (("odd", odd_documents, [None, 1, 3, 6, 7, 8, 9]), ("empty", no_documents, [])):
        folder = str(tmp_path / name)
        docs.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
        got = pipe.run(spark, folder).where("piece = 0").collect()
        assert sorted((r["doc_id"] for r in got), key=str) == sorted(want, key=str)


def test_words_of_text_are_cut_as_the_contract_says(spark):
    assert plain_words("A-b 漢字's") == ["a", "b", "漢字", "s"] and pa.array(["x"]).to_pylist() == ["x"]


# --- 8


def test_rounds_find_what_one_pass_finds(spark, sf, documents, monkeypatch):
    """Many shards in several rounds, matches and the cut texts alike; runs that two rounds' items share become one."""
    from tidemark.llm import decontaminate as D

    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    item = bench.first()["text"].split()
    more = spark.createDataFrame([(10**6, " ".join(["before", *item[:24], "after"]), "en", "s", 3), (10**6 + 1, None, "en", "s", None)], documents.schema)
    docs = documents.unionByName(more).withColumn("_row", F.lit(1)).withColumn("hits", F.lit("clash"))
    keyed = lambda df: sorted(map(str, df.collect()))
    want, cut = keyed(D.find_matches(docs, bench)), keyed(D.remove_matches(docs, bench))
    monkeypatch.setattr(D, "ROUND_SHARDS", 2)
    assert len(list(D.in_rounds(bench, 200))) > 2
    assert keyed(D.find_matches(docs, bench, shard_words=200)) == want
    assert keyed(D.remove_matches(docs, bench, shard_words=200)) == cut
    empty = bench.where("item_id < 0")
    assert D.find_matches(docs, empty).where("size(hits) > 0").count() == 0 and D.remove_matches(docs, empty).count() == docs.count()


# --- 9, by similarity


def test_similar_texts_are_grouped(spark):
    """Against exact similarities: nearly all pairs of 0.8 or more, and no chain that such pairs don't make."""
    from tidemark.llm import simhash as N

    rng, vocabulary = np.random.default_rng(12), [f"w{i}" for i in range(3000)]
    texts = []
    for k in range(60):
        words = rng.choice(vocabulary, int(rng.integers(40, 400))).tolist()
        texts.append(" ".join(words))
        for _ in range(3):
            other = list(words)
            for at in rng.choice(len(words), max(1, int(len(words) * rng.choice([0.005, 0.01, 0.015, 0.08]))), replace=False):
                other[at] = str(rng.choice(vocabulary))
            texts.append(" ".join(other))
    texts += ["", None, " \n", "three short words", "THREE short  words", "three short words more", texts[0].upper()]
    got = {r["doc_id"]: r["component_id"] for r in N.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets = [(lambda w: frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())((t or "").lower().split()) for t in texts]
    label = list(range(len(texts)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    pairs = [(a, b) for b in range(len(texts)) for a in range(b) if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for a, b in pairs:
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    assert all(root(d) == root(c) for d, c in got.items())
    assert len(pairs) > 60 and sum(got[a] == got[b] for a, b in pairs) >= 0.95 * len(pairs)
    n = len(texts)
    assert got[n - 7] == got[n - 6] == got[n - 5] == n - 7 and got[n - 4] == got[n - 3] != got[n - 2] and got[n - 1] == 0


def test_crowded_anchors_still_make_one_group(spark, monkeypatch):
    """Near copies in thousands, dealt into blocks: one group, by pairs that grow with its size and not with the square."""
    from tidemark.llm import simhash as N

    monkeypatch.setattr(N, "BLOCK", 64)
    rng, counted, stored = np.random.default_rng(3), {}, N.stored

    def noted(df, label):
        out = stored(df, label)
        counted[label] = out.count()
        return out

    monkeypatch.setattr(N, "stored", noted)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for k in range(600):
        other = list(words)
        for at in rng.choice(300, 2, replace=False):
            other[at] = f"x{rng.integers(0, 10**6)}"
        rows.append((k, " ".join(other)))
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.where("component_id = 0").count() == 600 and counted["pairs"] <= 600 * N.PROJECTIONS < 600 * 599 / 2


def _as_sets(texts):
    return [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for w in (t.lower().split() for t in texts)]


def test_similar_texts_are_grouped_to_the_last_pair(spark):
    """Pairs just at and over 0.8, many of which meet under no anchor, and pairs just below."""
    from tidemark.llm import simhash as N

    rng, vocabulary, texts = np.random.default_rng(5), [f"w{i}" for i in range(5000)], []
    for k in range(400):
        words = rng.choice(vocabulary, int(rng.integers(60, 300))).tolist()
        other, at = list(words), int(rng.integers(0, len(words) // 2))
        gap = int(len(words) * rng.uniform(0.085, 0.12)) - 4  # a run of g new words changes g + 4 shingles of either text
        other[at : at + gap] = [f"x{k}y{i}" for i in range(gap)]
        texts += [" ".join(words), " ".join(other)]
    sets = _as_sets(texts)
    alike = [len(sets[k] & sets[k + 1]) >= 0.8 * len(sets[k] | sets[k + 1]) for k in range(0, len(texts), 2)]
    got = {r["doc_id"]: r["component_id"] for r in N.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert 150 < sum(alike) < 350
    assert got == {d: d - 1 if d % 2 and alike[d // 2] else d for d in range(len(texts))}


@pytest.mark.parametrize("block", [16, 2048])
def test_heads_meet_every_similar_pair(spark, monkeypatch, block):
    """Without any anchor: all pairs of different roots, frequent shingles in blocks, and no pairs within a root."""
    from tidemark.llm import simhash as N

    monkeypatch.setattr(N, "BLOCK", block)
    rng, line = np.random.default_rng(8), [f"line{i}" for i in range(40)]
    texts = []
    for k in range(240):  # all share a line that is nearly the whole of some
        words = line + [f"a{k}b{i}" for i in range(int(rng.choice([0, 1, 2, 3, 6, 30])))]
        texts.append(" ".join(words))
    texts = sorted(set(texts))
    sets = _as_sets(texts)
    hashes, of = N.shingle_sets(pa.array(texts))
    u, n = np.unique(hashes, return_counts=True)
    for frequent in ((u[:0], n[:0]), (u[n > 4], 1 + np.argsort(np.argsort(n[n > 4], kind="stable")))):
        heads = N._heads(hashes, of, len(texts), 0.8, frequent).to_pylist()
        for root in (lambda k: k, lambda k: k % 7):
            rows = [(k, root(k), len(sets[k]), bytearray(heads[k])) for k in range(len(texts))]
            found = N._sharing(spark.createDataFrame(rows, "fp long, root long, size long, head binary"), 0.8).collect()
            pairs = {(r["a"], r["b"]) for r in found}
            want = {(a, b) for a in range(len(texts)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and root(a) != root(b)}
            assert len(want) > 500 and want <= pairs and len(pairs) == len(found) and all(root(a) != root(b) for a, b in pairs)


def test_parities_rule_out_no_similar_pair():
    from tidemark.llm import simhash as N

    rng, texts = np.random.default_rng(2), []
    for k in range(300):
        words = [f"w{i}" for i in rng.integers(0, 10**6, int(rng.choice([3, 60, 70, 260, 1100])))]
        other = words[: int(len(words) * rng.uniform(0.7, 1))]
        texts += [" ".join(words), " ".join(other) or "one"]
    hashes, of = N.shingle_sets(pa.array(texts))
    sets = _as_sets(texts)
    size, parity = pa.array([len(s) for s in sets]), N._parities(hashes, of, len(texts))
    pick = lambda x, k: x.take(pa.array(range(k, len(texts), 2)))
    number = pa.array(range(0, len(texts), 2))
    batch = pa.RecordBatch.from_arrays([number, number, pick(size, 0), pick(size, 1), pick(parity, 0), pick(parity, 1)], names=list("abcdef"))
    kept = {k for b in N._alike(iter([batch]), 0.8) for k in b.column(0).to_pylist()}
    alike = {k for k in range(0, len(texts), 2) if len(sets[k] & sets[k + 1]) >= 0.8 * len(sets[k] | sets[k + 1])}
    assert alike <= kept and len(alike) > 100 and len(kept) < 300


def test_marks_hold_back_no_key(spark):
    from tidemark.llm.common import with_maybe

    numbers = spark.range(20_000).withColumn("_maybe", F.lit("clash"))
    keys = numbers.select("id").where("id % 7 = 3").union(spark.createDataFrame([(None,), (3,)], "id long"))
    got, name = with_maybe(numbers, "id", keys)
    assert got.columns == ["id", "_maybe", "_maybe_"] == [*numbers.columns, name] and got.count() == 20_000
    assert got.where("id % 7 = 3").where(~F.col(name)).isEmpty() and got.where(F.col(name)).count() < 20_000 / 7 + 50
    none, name = with_maybe(numbers, "id", keys.limit(0))
    assert none.where(F.col(name)).isEmpty() and none.count() == 20_000
