"""Each operator's query against a brute-force version, and the odd cases that its docstring defines."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, components, decontaminate, licenses, packing, quality, quality_rules, rollups, secret_scan, simhash, toxicity
from tidemark.llm import queries as llm


def rows_of(df):
    return df.collect()


# --- 8, 9, 10 against brute force


def test_decontamination_in_shards(documents, spark, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    one = {r["doc_id"]: r for r in decontaminate.find_matches(documents, bench).collect()}
    many = {r["doc_id"]: r for r in decontaminate.find_matches(documents, bench, shard_words=200).collect()}
    assert one == many and len(one) == documents.count()
    clean = decontaminate.clean_documents(documents, bench)
    assert {r["doc_id"] for r in clean.select("doc_id").collect()} == {d for d, r in one.items() if not r["hits"]}
    assert clean.columns == documents.columns


def test_matched_spans_go(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, f"Before. {item.upper()}! After that come many more words, so that much of it stays as it was all along.", 0), (2, item, 0), (3, "nothing", 7)], "doc_id long, text string, n_chars long")
    bench = spark.createDataFrame([(1, item), (2, None), (3, "...")], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.remove_matches(docs, bench).collect()}
    assert got[1]["text"].startswith("Before. !") and got[1]["n_chars"] == len(got[1]["text"]) and 2 not in got and got[3]["n_chars"] == 7


def test_components_match_union_find(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(1000 + i, 1001 + i) for i in range(60)]
    parent: dict[int, int] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_take_few_jobs(spark):
    """A driver keeps threads, classes and strings of each plan for a while: small graphs may not take a hundred jobs."""
    rng, sc = np.random.default_rng(4), spark.sparkContext
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(0, 3000, (2500, 2))] + [(k, 7) for k in range(5000, 5200)], "a long, b long")
    sc.setJobGroup("components", "")
    components.connected_components(edges)
    sc.setJobGroup("others", "")
    assert len(sc.statusTracker().getJobIdsForGroup("components")) <= 30


def test_components_of_few_edges_leave_few_files(spark):
    """Each task of a shuffle or checkpoint leaves files, so few edges may not take hundreds of them where Spark joins no small partitions."""
    rng, sc, conf = np.random.default_rng(4), spark.sparkContext, {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(0, 3000, (2500, 2))], "a long, b long")
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        sc.setJobGroup("few files", "")
        components.connected_components(edges).count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        sc.setJobGroup("others", "")
    jobs = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup("few files")]
    assert sum(sc.statusTracker().getStageInfo(k).numTasks for k in {k for j in jobs for k in j.stageIds}) <= 400


def test_components_of_many_edges_match_union_find(spark, monkeypatch):
    monkeypatch.setattr(components, "HELD", 40)
    test_components_match_union_find(spark)


def test_stars_of_a_partition_match_a_search():
    rng = np.random.default_rng(6)
    chain = rng.permutation(5000)
    for a, b in ((chain[1:], chain[:-1]), rng.integers(-400, 400, (2, 350)), (np.array([3]), np.array([3]))):
        linked = {int(x): {int(x)} for x in np.concatenate([a, b])}
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            if linked[x] is not linked[y]:
                linked[x] |= linked[y]
                for z in linked[y]:
                    linked[z] = linked[x]
        child, root = components._stars(a, b)
        assert dict(zip(child.tolist(), root.tolist(), strict=True)) == {x: min(s) for x, s in linked.items() if x != min(s)}


def test_near_duplicates_match_all_pairs(spark, documents):
    from tests.llm.test_text import fingerprint

    base = documents.collect()
    words = base[0]["text"].split()
    rows = [(r["doc_id"], r["text"]) for r in base] + [(10_000 + k, " ".join([*words[:k], "changed", *words[k + 1 :]])) for k in range(0, min(len(words), 60), 2)]
    got = {r["doc_id"]: r for r in simhash.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    prints = {d: fingerprint(t) for d, t in rows}
    label = {d: d for d, _ in rows}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for (a, x), (b, y) in itertools.combinations(prints.items(), 2):
        if (x ^ y).bit_count() <= 3:
            a, b = find(a), find(b)
            label[max(a, b)] = min(a, b)
    assert {d: (r["fingerprint"], r["component_id"]) for d, r in got.items()} == {d: (f"{prints[d]:016x}", find(d)) for d in prints}


def test_large_anchors_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 40)
    monkeypatch.setattr(simhash, "SMALL", 8)
    rng = np.random.default_rng(2)
    prints = set()
    for _ in range(300):
        x = 0x123456789ABCDEF
        for bit in rng.choice(14, rng.integers(0, 6), replace=False):
            x ^= 1 << int(bit)
        prints.add(x)
    prints = sorted(prints)
    found = simhash.links(spark.createDataFrame([(x,) for x in prints], "fp long")).collect()
    assert all((r["a"] ^ r["b"]).bit_count() <= 3 for r in found)

    def groups(pairs):
        parent = {x: x for x in prints}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
        return {x: find(x) for x in prints}

    assert groups((r["a"], r["b"]) for r in found) == groups((a, b) for a, b in itertools.combinations(prints, 2) if (a ^ b).bit_count() <= 3)


def test_packing(spark, sf, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = llm.op10_best_fit_packing(spark, sf).toPandas()
    by = {d: x.sort_values("piece") for d, x in got.groupby("doc_id")}
    for r in documents.collect():
        ids, x = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4"), by[r["doc_id"]]
        assert x["piece"].tolist() == list(range(len(x))) and x["length"].sum() == len(ids) and x["start"].tolist() == (x["length"].cumsum() - x["length"]).tolist()
        assert all(n == 1024 for n in x["length"][1:])
        assert [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(x["start"], x["length"])] == x["ids_crc32"].tolist()
    for _, x in got.sort_values("offset").groupby("sequence_id"):
        assert x["offset"].tolist() == (x["length"].cumsum() - x["length"]).tolist() and x["length"].sum() <= 1024
    assert got["sequence_id"].nunique() <= -(-got["length"].sum() // 1024) * 1.02 + 1
    whole = packing.pack_documents(documents.limit(20))
    ids = packing.sequences(whole).agg(F.sum(F.octet_length("ids"))).first()[0]
    assert ids == 4 * whole.agg(F.sum("length")).first()[0]


def test_packing_in_many_groups(spark):
    rng = np.random.default_rng(0)
    pieces = spark.createDataFrame([(i, int(n)) for i, n in enumerate(rng.integers(1, 1025, 3000))], "doc_id long, length long").cache()
    packed = packing.pack_pieces(pieces, group_pieces=500).toPandas()
    assert sorted(packed["doc_id"]) == list(range(3000)) and packed.groupby("sequence_id")["length"].sum().max() <= 1024


# --- 1, 3, 5, 7


@pytest.mark.parametrize("name, label, folds, rest, least", [("op1_quality_classifier", "quality", 3, 1, 0.8), ("op7_toxicity", "toxic", 5, 0, 0.7)])
def test_classifiers_on_held_out_labels(spark, name, label, folds, rest, least):
    sf = "/root/testdata/sf0.01"
    got = llm.QUERIES[name](spark, sf).toPandas().set_index("doc_id")
    assert got.index.is_unique and len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(h == (zlib.crc32(str(i).encode()) % folds == rest) for i, h in got["held_out"].items())
    assert got["score"].between(0, 1).all() and ((got["score"] >= 0.5) == (got["predicted"] == 1)).all()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas().set_index("doc_id")[label]
    both = got[got["held_out"]].join(labels, how="inner")
    assert (both["predicted"] == both[label]).mean() >= least


def test_labels_of_the_kept_back_fold_teach_nothing(spark, documents, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(map(tuple, quality.digest(documents, x).select("doc_id", "score").collect())) for x in (labels, turned))
    assert a == b


def test_secrets_against_the_patterns(spark, sf, documents):
    got = {r["doc_id"]: r for r in llm.op3_secret_scans(spark, sf).collect()}
    for r in documents.collect():
        spans = secret_scan.base_spans(r["text"] or "")
        g = got[r["doc_id"]]
        assert g["base_sha256"] == hashlib.sha256(secret_scan.listed(spans).encode()).hexdigest()
        assert [g["n_assign"], g["n_access"], g["n_hex"]] == [sum(s.kind == k for s in spans) for k in ("assign", "access", "hex")]
        assert set(filter(None, secret_scan.listed(spans).split(","))) <= set(g["spans"].split(","))


def test_quality_rules(spark, sf, documents):
    got = {r["doc_id"]: r for r in llm.op5_quality_rules(spark, sf).collect()}
    for r in documents.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        g = got[r["doc_id"]]
        assert g["n_words"] == len(w) and g["word_chars"] == sum(map(len, w))
        assert g["base_failed"] == (len(w) < 20 or 100 * g["n_repeat_words"] > 30 * len(w)) and not (g["base_failed"] and g["kept"])
    assert sum(r["kept"] for r in got.values()) > 0.6 * len(got)


# --- 2, 4, 6


def least_cost(roles):
    best = [chat.FAR]

    def go(i, s, cost):
        if cost >= best[0]:
            return
        if i == len(roles):
            best[0] = min(best[0], cost + chat.END[s])
            return
        for q in (1, 2, 3):
            change = 0 if q == roles[i] else chat.NAME if roles[i] == 0 else chat.RELABEL
            if s == q:
                go(i + 1, q, cost + change + chat.MERGE)
            if q in chat.NEXT[s]:
                go(i + 1, q, cost + change)
            for p in chat.NEXT[s]:
                if q in chat.NEXT[p]:
                    go(i + 1, q, cost + change + chat.INSERT)

    go(0, 0, 0)
    return best[0]


def test_role_repair_is_cheapest():
    for n in range(1, 6):
        for roles in itertools.product(range(4), repeat=n):
            way = chat.repair(list(roles))
            assert sum(s[0] for _, s in way) + chat.END[way[-1][0]] == least_cost(roles)


def test_conversations_over_many_partitions(spark):
    rng = np.random.default_rng(1)
    names = ["user", "assistant", "system", "Human", None, "tool"]
    rows = [(k if k else None, i, names[rng.integers(0, 6)], f"t{k}.{i}" if i % 7 else None) for k in range(12) for i in range(int(rng.integers(1, 6)))]
    rows += [(99, i, names[rng.integers(0, 6)], f"b{i}") for i in range(300)] + [(50, 1, "user", "same")] * 3
    out = chat.repair_roles(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("cost", F.lit(5)))
    costs = {r["conv_id"]: r["n"] for r in out.groupBy("conv_id").agg(F.sum("cost").alias("n")).collect()}
    whole = {r["conv_id"]: r["rendered"] for r in chat.rendered_conversations(out).collect()}
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")
    for conv, turns in itertools.groupby(sorted(rows, key=key), key=lambda r: r[0]):
        turns = list(turns)
        way = chat.repair([chat.role_state(r[2]) for r in turns])
        assert costs[conv] == sum(s[0] for _, s in way) + chat.END[way[-1][0]]
        said = [p.split("\n")[0] for p in whole[conv].split("<|im_start|>")[1:]]
        state = chat.START
        for role in said:
            assert chat.ROLES.index(role) + 1 in chat.NEXT[state]
            state = chat.ROLES.index(role) + 1
        assert whole[conv].count(chat.CLOSE) == len(said)
    assert out.where("action <> 'insert'").count() == len(rows)
    assert chat.repair_roles(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_rollups_are_idempotent_and_signed(spark, documents, tmp_path):
    r, counts = rollups.Rollup(spark, str(tmp_path / "r")), rollups.count_tokens(documents, ("words/1",))
    assert r.totals().count() == 0
    assert r.commit("a", rollups.inserts(counts)) and not r.commit("a", rollups.inserts(counts))
    want = documents.groupBy("source", "lang").agg(F.count("*").alias("n")).collect()
    assert {(x["source"], x["lang"]): x["documents"] for x in r.totals().collect()} == {(x["source"], x["lang"]): x["n"] for x in want}
    assert r.commit("gone", rollups.deletes(counts.where("doc_id < 50")))
    assert r.totals().agg(F.sum("documents")).first()[0] == documents.where("doc_id >= 50").count()
    before = sorted(map(str, r.totals().collect()))
    r.fold()
    r.recover()
    assert len(r.committed()) == 1 and not r.commit("a", rollups.inserts(counts)) and sorted(map(str, r.totals().collect())) == before
    r.commit("rest", rollups.deletes(counts.where("doc_id >= 50")))
    assert r.totals().count() == 0
    with pytest.raises(ValueError):
        r.commit("a/b", counts)


def test_token_counts(spark, sf, documents):
    from tidemark.llm.tokens import BpeEncoder

    got = {(r["source"], r["lang"], r["tokenizer_version"]): (r["documents"], r["tokens"]) for r in llm.op4_token_counts(spark, sf).collect()}
    want: dict = {}
    for r in documents.collect():
        for version, n in (("words/1", len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))), ("byte_bpe_50k/2", len(BpeEncoder().encode(pa.array([r["text"]]))[0]) + 1)):
            d, t = want.get((r["source"], r["lang"], version), (0, 0))
            want[r["source"], r["lang"], version] = d + 1, t + n
    assert got == want


def test_license_lines(spark, sf, documents):
    got = {r["doc_id"]: r for r in llm.op6_license_scans(spark, sf).collect()}
    lines = {k: v for k, v in licenses.TEMPLATES.items() if k in ("Apache-2.0-line", "GPL-3.0-line", "MIT-line", "CC-BY-NC-4.0-line")}
    for r in documents.collect():
        there = {k for k, v in lines.items() if v in (r["text"] or "")}
        assert there <= set(got[r["doc_id"]]["licenses"].split(","))


# --- odd rows and empty tables, for every operator


def operators(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 0, 1), (None, 1, 1), (3, None, None), (7, 0, 1), (9, 1, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "alpha beta gamma delta alpha beta gamma delta alpha beta gamma"), (2, None), (None, "’Quote’")], "item_id long, text string")
    net = secret_scan.train(["token = 0123456789abcdef01234567"])
    return {
        "1": lambda d: quality.digest(d, labels),
        "3": lambda d: secret_scan.digest(d),
        "3 redact": lambda d: secret_scan.redact(d, net),
        "4": lambda d: rollups.maintained_totals(d),
        "5": lambda d: quality_rules.digest(d),
        "6": lambda d: licenses.digest(d),
        "7": lambda d: toxicity.digest(d, labels),
        "7 filter": lambda d: toxicity.keep_clean(d, toxicity.BiGru()),
        "8": lambda d: decontaminate.digest(d, bench),
        "8 clean": lambda d: decontaminate.clean_documents(d, bench),
        "9": lambda d: simhash.digest(d),
        "9 filter": lambda d: simhash.keep_one(d),
        "10": lambda d: packing.packed_digest(d),
    }


@pytest.mark.parametrize("name", ["1", "3", "3 redact", "4", "5", "6", "7", "7 filter", "8", "8 clean", "9", "9 filter", "10"])
def test_odd_rows(spark, odd_documents, no_documents, name):
    work = operators(spark)[name]
    got = rows_of(work(odd_documents))
    n = odd_documents.count()
    if name in ("1", "3", "3 redact", "5", "6", "7", "8", "9"):
        assert len(got) == n
    if name == "8":
        by = {r["doc_id"]: r for r in got}
        assert by[1]["contaminated"] and by[3]["n_words"] == 0 and by[8]["n_hit"] == 1 and by[8]["n_items"] == 0
    if name == "9":
        by = {r["doc_id"]: r["component_id"] for r in got}
        assert by[2] == 1 and by[3] == by[4] == by[5] == 3
    if name == "9 filter":
        assert sorted((r["doc_id"] for r in got), key=str) == sorted([1, 3, None, 6, 7, 8, 9], key=str) and got[0].__fields__[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    if name == "10":
        assert sum(r["piece"] == 0 for r in got) == n
    if name == "4":
        assert sum(r["documents"] for r in got) == 2 * n
    assert rows_of(work(no_documents)) == []
