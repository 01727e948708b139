import re
import zlib

import numpy as np
import pyarrow as pa

from tidemark.llm import kneser_ney as K
from tidemark.llm import quality as Q
from tidemark.llm import secret_scan as S
from tidemark.llm import toxicity as X


def test_gru_gradients():
    rng = np.random.default_rng(0)
    texts = ["alpha beta gamma delta loser eps"] + [" ".join(rng.choice(["a", "bb", "ccc", "dddd"], rng.integers(5, 50))) for _ in range(4)]
    doc, codes, words = X.read_words(pa.array(texts))
    _, begin, size = X.cut_windows(np.bincount(doc, minlength=len(texts)))
    net = X.BiGru()
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    index, mask = X.window_index(codes, begin, size, -1)
    some = np.unique(index[mask])
    local, y = np.where(mask, np.searchsorted(some, index), len(some)), np.arange(len(begin)) % 2

    def loss():
        x, _ = net.inputs(words, some)
        x = np.concatenate([x, np.zeros((1, x.shape[1]))])
        logit, saved = net.forward(x, local, mask, keep=True)
        return (np.logaddexp(0, logit) - y * logit).sum(), logit, saved, x

    _, logit, saved, x = loss()
    grads, _ = net.backward(x, local, mask, saved, 1 / (1 + np.exp(-logit)) - y)
    for k, g in grads.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        net.w[k][at] += 1e-3
        up = loss()[0]
        net.w[k][at] -= 2e-3
        down = loss()[0]
        net.w[k][at] += 1e-3
        assert abs((up - down) / 2e-3 - g[at]) < 1e-3


def test_cnn_gradients():
    rng, net = np.random.default_rng(0), S.CharCnn()
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x, y = rng.integers(0, 98, (8, S.BEFORE + S.INSIDE + S.AFTER)), np.arange(8) % 2

    def loss():
        logit, saved = net.forward(x)
        return (np.logaddexp(0, logit) - y * logit).sum(), logit, saved

    _, logit, saved = loss()
    for k, g in net.backward(x, saved, 1 / (1 + np.exp(-logit)) - y).items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        net.w[k][at] += 1e-4
        up = loss()[0]
        net.w[k][at] -= 2e-4
        down = loss()[0]
        net.w[k][at] += 1e-4
        assert abs((up - down) / 2e-4 - g[at]) < 1e-2 * max(1, abs(g[at]))


def test_windows_cover_and_overlap():
    sizes = np.array([0, 1, 32, 33, 100])
    doc, begin, size = X.cut_windows(sizes)
    first = np.cumsum(sizes) - sizes
    for d, n in enumerate(sizes.tolist()):
        mine = [(b - first[d], b - first[d] + s) for b, s in zip(begin[doc == d], size[doc == d])]
        assert {i for a, b in mine for i in range(a, b)} == set(range(n))
        assert all(q[0] < p[1] for p, q in zip(mine, mine[1:])) and all(b - a <= X.WINDOW for a, b in mine)


def test_toxic_words_are_learned():
    rng = np.random.default_rng(3)
    plain, bad = [f"w{i}" for i in range(300)], ["scoundrel", "villain"]
    texts, y = [], []
    for k in range(400):
        words = rng.choice(plain, rng.integers(3, 120)).tolist()
        if k % 4 == 0:
            words.insert(int(rng.integers(0, len(words))), rng.choice(bad))
        texts.append(" ".join(words))
        y.append(int(k % 4 == 0))
    net = X.train(texts[:300], np.array(y[:300]), rounds=3)
    got = X.score_texts(net, pa.array([*texts[300:], "", None]))
    assert ((got[:-2] >= 0.5) == np.array(y[300:])).mean() > 0.95 and got[-1] == got[-2]
    assert np.array_equal(got, X.score_texts(X.train(texts[:300], np.array(y[:300]), rounds=3), pa.array([*texts[300:], "", None])))
    assert 0 <= X.score_texts(X.train(["a"], np.array([1])), pa.array(["x"]))[0] <= 1


def test_trees_walk_like_a_plain_tree():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((2000, 5)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(int)
    arrays = Q.fit_trees(x, y, trees=30, depth=3)
    model = Q.Trees(arrays)
    assert ((model.scores(x) >= 0.5) == y).mean() > 0.97

    def plain(row):
        total = arrays["start"][0]
        for feature, edge, leaf in zip(arrays["feature"], arrays["edge"], arrays["leaf"]):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + int(row[feature[node]] > edge[node])
            total += leaf[node - len(feature)]
        return total

    assert np.allclose(model.logits(x[:50]), [plain(r) for r in x[:50]])
    assert Q.Trees(Q.fit_trees(x, np.ones(len(x)))).scores(x[:1])[0] > 0.99


def test_base_spans():
    text = 'Passwd: "abc12" api_key=\'Zz09+/_.=-\' TOKEN = abcdef secret=ab AKIA' + "A1" * 8 + " AKIASHORT " + "0a" * 12 + " x" + "f" * 23
    want = []
    for kind, pattern, ok in (
        ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    ):
        want += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if ok(m)]
    order = ("assign", "access", "hex")
    assert [(s.start, s.kind, s.end) for s in S.base_spans(text)] == sorted(want, key=lambda w: (w[0], order.index(w[1])))
    assert {s.kind for s in S.base_spans(text)} == set(order)
    texts = pa.array([text, "", None, "nothing here", "a" * 40, "mypassword: zzzzzz"])
    assert S.flagged(texts).tolist()[:1] == [True] and S.flagged(texts)[5]


def test_network_keeps_base_and_adds_others():
    texts = ["some words and then password=" + "ab12" * 4 + " more words"] * 5 + ["see mail7.example.com/path9 for words"] * 5
    net = S.train(texts)
    base, found, scores = S.scan_text("x token = " + "0f" * 12 + " and key ghp_" + "aB3dE5gH7jK9mN1pQ2rS4tU6vW8x0Y" + " end", net)
    assert set(base) <= set(found) and all(0 <= p <= 1 for p in scores) and any(s.kind == "net" for s in found)
    assert not [s for s in S.scan_text("visit mail7.example.com/path9 now", net)[1]]


def brute_shares(texts, order):
    """Modified Kneser-Ney by dictionaries, of one language."""
    from collections import Counter, defaultdict

    grams = Counter(("\x02" * (order - 1) + t)[i : i + order] for t in texts for i in range(len(t)))
    tables = {order: grams}
    for n in range(order - 1, 0, -1):
        tables[n] = Counter(g[1:] for g in tables[n + 1])
    parts = {}
    for n, c in tables.items():
        seen = Counter(c.values())
        y = seen[1] / (seen[1] + 2 * seen[2]) if seen[1] + 2 * seen[2] else None
        d = []
        for k in (1, 2, 3):
            v = k - (k + 1) * y * seen[k + 1] / seen[k] if y is not None and seen[k] else 0.5 * k
            d.append(max(min(v, 0.95 * k), 0.05))
        total, freed = defaultdict(float), defaultdict(float)
        for g, v in c.items():
            total[g[:-1]] += v
            freed[g[:-1]] += d[min(v, 3) - 1]
        parts[n] = c, d, total, freed

    def share(context, c):
        p = 1 / (len(tables[1]) + 1)
        for n in range(1, order + 1):
            counts, d, total, freed = parts[n]
            h = context[len(context) - n + 1 :]
            if h in total:
                v = counts[h + c]
                p = (max(v - d[min(v, 3) - 1], 0) if v else 0) / total[h] + freed[h] / total[h] * p
        return p

    return share


def test_kneser_ney_matches_dictionaries(spark):
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("aabbc dé"), rng.integers(1, 60))) for _ in range(40)]
    docs = spark.createDataFrame([(i, t, "xx") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    model = K.fit(docs)
    probes = ["abc a", "zé", "dddd", texts[0]]
    padded, place, doc = K.coded(pa.array(probes))
    share = brute_shares(texts, K.ORDER)
    want = [np.log(share(("\x02" * 4 + p)[i : i + 4], p[i])) for p in probes for i in range(len(p))]
    lang = K.lang_hashes(pa.array(["xx"] * len(probes)))[doc]
    for part_entries in (10**6, 150):
        got = sum(K.log_shares(a, padded, place, lang, part=(k, n)) for a, k, n in K.model_parts(model, part_entries))
        assert np.allclose(got, want, atol=1e-4)


def test_shares_add_up_to_one(spark):
    docs = spark.createDataFrame([(1, "abcabcab", "x"), (2, "bcabd", "x")], "doc_id long, text string, lang string")
    arrays = next(K.model_parts(K.fit(docs)))[0]
    every = ["ab" + c for c in "abcd\x02z"]
    padded, place, doc = K.coded(pa.array(every))
    last = np.flatnonzero(np.append(np.diff(doc) > 0, True))
    p = np.exp(K.log_shares(arrays, padded, place, K.lang_hashes(pa.array(["x"] * len(every)))[doc]))[last]
    assert abs(p[:5].sum() - 1) < 0.35 and p[:4].min() > 0  # the start mark takes a share too


def test_folds_follow_crc32(spark):
    from pyspark.sql import functions as F

    from tidemark.llm.sampling import held_out

    rows = spark.range(200).select("id", held_out(F.col("id"), 3, 1).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 3 == 1) for r in rows)
