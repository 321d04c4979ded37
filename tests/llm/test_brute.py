"""Operators against plain Python on small fixtures."""

import collections
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from mailstrata.llm import ann, components, jaccard, sharding, shingles, substring, topk, toxicity, vectors

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _set(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def _components(rows, k, percent):
    sets = {d: _set(t, k) for d, t in rows}
    root = {d: d for d in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.mark.parametrize("k,percent,cell", [(3, 90, 512), (5, 80, 3)])
def test_jaccard_join_loses_no_link(spark, k, percent, cell):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(4000)]
    rows, n = [], 0
    shared = [rng.choice(words) for _ in range(60)]
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randrange(1, 120))]
        for _ in range(rng.randrange(1, 5)):
            t = list(base)
            for _ in range(rng.randrange(0, 3)):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((n, " ".join(t + (shared if rng.random() < 0.3 else []))))
            n += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.link_documents(docs, k, percent, cell).collect()}
    assert got == _components(rows, k, percent)


def test_regions_lose_no_link():
    """Voronoi regions and windows against all pairs, on sets around a few centres at many distances."""
    rng = np.random.RandomState(6)
    for percent in (80, 90):
        sets = []
        for _ in range(6):
            base = rng.randint(0, 1 << 60, 80).astype(np.uint64)
            for _ in range(60):
                keep = rng.rand(80) < rng.choice([0.5, 0.8, 0.95, 1.0])
                sets.append(np.unique(np.r_[base[keep], rng.randint(0, 1 << 60, rng.randint(1, 8)).astype(np.uint64)]))
        ids = rng.permutation(len(sets)) + 100
        cells = np.zeros(len(ids), np.int64)
        edges, met = jaccard.region_edges(cells, ids, np.array([len(x) for x in sets]), np.concatenate(sets), percent)
        assert (met >= 1).all()
        groups = lambda es: jaccard.np.array(sorted(_roots(ids.tolist(), es)))
        pairs = [(ids[i], ids[j]) for i in range(len(sets)) for j in range(i) if 100 * (both := len(np.intersect1d(sets[i], sets[j]))) >= percent * (len(sets[i]) + len(sets[j]) - both)]
        assert len(pairs) > 20 and (groups(edges.tolist()) == groups(pairs)).all()


def test_every_candidate_meets_pivots():
    """Cells of two, three and more documents at once: no row escapes the pivots, a lone one has none, and links are those of all pairs within cells."""
    rng = np.random.RandomState(2)
    cells, sets = [], []
    for cell in range(120):
        base = rng.randint(0, 1 << 60, 50).astype(np.uint64)
        for _ in range(rng.choice([1, 2, 3, 9, 40])):
            sets.append(np.unique(np.r_[base[rng.rand(50) < rng.choice([0.6, 0.9, 0.97])], rng.randint(0, 1 << 60, rng.randint(1, 4)).astype(np.uint64)]))
            cells.append(cell)
    cells, ids = np.array(cells), np.arange(len(sets)) + 7
    edges, met = jaccard.region_edges(cells, ids, np.array([len(x) for x in sets]), np.concatenate(sets), 80)
    assert ((met > 0) == (np.bincount(cells)[cells] > 1)).all()
    pairs = [(ids[i], ids[j]) for i in range(len(sets)) for j in range(i) if cells[i] == cells[j] and 100 * (both := len(np.intersect1d(sets[i], sets[j]))) >= 80 * (len(sets[i]) + len(sets[j]) - both)]
    assert len(pairs) > 200 and sorted(_roots(ids.tolist(), edges.tolist())) == sorted(_roots(ids.tolist(), pairs))
    assert {tuple(sorted(e)) for e in edges.tolist()} <= {tuple(sorted(p)) for p in pairs}


def _roots(ids, edges):
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            least = min(root[a], root[b])
            changed |= root[a] != least or root[b] != least
            root[a] = root[b] = least
    return list(root.items())


def test_shingles_are_those_of_words():
    texts = ["A b C a b c", "ab c", "a bc", "", None, "x", "é É é", "a\x0bb\x0cc  d", "z " * 700_000]
    for t, s in zip(texts, shingles.shingle_sets(texts, 3), strict=True):
        assert len(s) == len(_set(t, 3))
    a, b = shingles.shingle_sets(["A b C", "a B c"], 3)
    assert (a == b).all() and shingles.shingle_set(np.zeros(0, np.uint64), 3).size == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 101), (102, 101), (5, 5), (None, 3)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(21), 0), 100: 100, 101: 100, 102: 100}


@pytest.mark.parametrize("shard", [8192, 60])
def test_exact_top_k(spark, monkeypatch, shard):
    """In one shard, and in twelve that are searched in three waves."""
    monkeypatch.setattr(topk, "SHARD", shard)
    rng = np.random.RandomState(1)
    x = np.floor(rng.randn(700, 6) * 20)
    x[100:400] = x[0]  # many equal scores
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<double>")
    got = collections.defaultdict(list)
    for r in topk.top_k(rows, rows.where("vec_id % 50 = 0"), 5).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    for q in range(0, 700, 50):
        s = x @ x[q]
        order = [i for i in np.lexsort((np.arange(700), -s)) if i != q][:5]
        assert got[q] == [(i, int(s[i])) for i in order]


def test_ann_recall(spark):
    rows = vectors.usable(spark.read.parquet(f"{SF}/embeddings.parquet"))
    x = {r["vec_id"]: np.array(r["v"]) for r in rows.collect()}
    hit = total = 0
    got = collections.defaultdict(dict)
    for r in ann.neighbours(rows, rows.where("vec_id % 20 = 0"), 10, listed=40).collect():
        got[r["query_id"]][r["vec_id"]] = r["score"]
    for q in [i for i in x if i % 20 == 0]:
        d = {i: float(np.sqrt(((v - x[q]) ** 2).sum())) for i, v in x.items() if i != q}
        best = sorted(d, key=lambda i: (d[i], i))[:10]
        hit, total = hit + len(set(best) & set(got[q])), total + 10
        assert all(abs(d[i] - s) < 1e-12 for i, s in got[q].items())
    assert hit / total >= 0.9


def test_ann_recall_among_copies(spark):
    x = {r["vec_id"]: np.array(r["v"]) for r in vectors.usable(spark.read.parquet(f"{SF}/embeddings.parquet")).collect()}
    hot = x[min(x)]
    asked = sorted(x, key=lambda i: ((x[i] - hot) ** 2).sum())[:30]
    x |= {1_000_000 + i: hot for i in range(len(x) // 2)}
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in x.items()], "vec_id long, v array<double>")
    got = collections.defaultdict(list)
    for r in ann.neighbours(rows, rows.where(rows.vec_id.isin([*asked, 1_000_003])), 10, listed=40).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hit = 0
    for q in [*asked, 1_000_003]:
        d = {i: float(np.sqrt(((v - x[q]) ** 2).sum())) for i, v in x.items() if i != q}
        best = sorted(d, key=lambda i: (d[i], i))[:10]
        assert len(got[q]) == 10 and all(i != q and abs(d[i] - s) < 1e-12 for i, s in got[q])
        hit += len(set(best) & {i for i, _ in got[q]})
    assert hit / (10 * len(got)) >= 0.95


def test_flow_moves_the_fewest_bytes():
    rng = random.Random(5)
    for _ in range(20):
        n, m = rng.randrange(1, 6), rng.randrange(1, 7)
        supply = [rng.randrange(0, 90) for _ in range(n)]
        cap = [sum(supply) // m + 1 + rng.randrange(3) for _ in range(m)]
        flow = sharding.min_cost_flow(supply, cap, lambda i, j: int(i != j))
        assert [sum(f for (i, _), f in flow.items() if i == a) for a in range(n)] == supply
        assert all(sum(f for (_, j), f in flow.items() if j == b) <= cap[b] for b in range(m))
        stay = sum(min(s, cap[i]) for i, s in enumerate(supply) if i < m)
        assert sum(f for (i, j), f in flow.items() if i != j) == sum(supply) - stay


def test_only_affected_shards_are_rewritten(spark, tmp_path):
    docs = spark.createDataFrame([(i, "t" * (i % 7)) for i in range(60)], "doc_id long, text string")
    moves = sharding.reshard(docs, new=4, old=4, blocks=16)
    old = docs.join(moves.select("doc_id", "old_shard"), "doc_id")
    path = str(tmp_path / "shards")
    sharding.write_shards(old, path, "old_shard")
    before = sharding._manifest(spark, path)
    done = sharding.rewrite_affected(spark, path, moves)
    after = sharding._manifest(spark, path)
    assert {s for s in after if after[s] != before.get(s)} == set(done) & set(after)
    got = {r["doc_id"]: r["shard"] for r in sharding.read_shards(spark, path).collect()}
    assert got == {r["doc_id"]: r["shard"] for r in moves.collect()}


def test_rewritten_shards_keep_null_and_repeated_ids(spark, tmp_path):
    data = [(None if i % 5 == 0 else i % 7, None if i % 11 == 0 else f"text {i % 40}") for i in range(200)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    content = lambda rows: collections.Counter((r["doc_id"], r["text"], r["shard"]) for r in rows)
    moves = sharding.reshard(docs, new=6, old=4, blocks=16)
    filled = sharding.F.coalesce("text", sharding.F.lit(""))
    crc = sharding.F.crc32(filled.cast("binary"))
    path = str(tmp_path / "shards")
    sharding.write_shards(docs.withColumn("old_shard", sharding.F.pmod(sharding.F.xxhash64(filled), sharding.F.lit(4)).cast("int")), path, "old_shard")
    sharding.rewrite_affected(spark, path, moves)
    want = collections.Counter((r["doc_id"], r["text_crc32"], r["shard"]) for r in moves.collect())
    got = sharding.read_shards(spark, path)
    assert collections.Counter((r["doc_id"], r["crc"], r["shard"]) for r in got.withColumn("crc", crc).collect()) == want
    assert sum(content(got.collect()).values()) == len(data)


def test_resharding_is_carried_out_on_files(spark, tmp_path):
    data = [(None if i % 5 == 0 else i % 7, None if i % 11 == 0 else f"text {i % 40}") for i in range(200)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    path = str(tmp_path / "shards")
    got = sharding.reshard_files(docs, path, new=6, old=4, blocks=16)
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(map(tuple, sharding.reshard(docs, new=6, old=4, blocks=16).collect()))
    held = collections.Counter((r["doc_id"], r["text"]) for r in sharding.read_shards(spark, path).collect())
    assert held == collections.Counter(data) and len(list((tmp_path / "shards").glob("generation-*"))) == 2
    empty = sharding.reshard_files(docs.limit(0), str(tmp_path / "empty"))
    assert empty.count() == 0 and empty.columns == got.columns


def _prose(rng, n, ends):
    """n words, with about as many sentence ends as asked."""
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9))) for _ in range(n)]
    for i in rng.sample(range(n), ends):
        words[i] += "."
    return " ".join(words)


def test_repeated_passages_are_found(spark):
    """Passages of 51 to 60 words, with no, one, two or many sentence ends, in the middle of other sentences."""
    rng = random.Random(9)
    texts = [_prose(rng, 120, rng.randrange(12)) for _ in range(3 * 60)]
    passages = []
    for p in range(60):
        passage = _prose(rng, rng.randrange(51, 61), (0, 1, 2, 7)[p % 4])
        passages.append(passage)
        for i in (3 * p, 3 * p + 1):  # every third text holds none
            words = texts[i].split(" ")
            at = rng.randrange(len(words))
            texts[i] = " ".join([*words[:at], passage, *words[at:]])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = collections.defaultdict(list)
    for r in substring.repeated_passages(docs).collect():
        got[r["doc_id"]].append(r)
        piece, passage = _set(texts[r["doc_id"]][r["start"] : r["end"]], 5), _set(passages[r["doc_id"] // 3], 5)
        assert len(piece & passage) >= 0.8 * len(piece) and r["first_doc_id"] == r["doc_id"] // 3 * 3 and r["remove"] == (r["doc_id"] % 3 == 1)
    wanted = {i for i in range(180) if i % 3 < 2}
    assert set(got) <= wanted and len(got) >= 0.95 * len(wanted)
    assert {r["doc_id"] for r in substring.repeated_passages(docs, run=1).collect()} == wanted
    b, r = substring.tuned_bands(0.8)
    assert r >= 3 and 1 - (1 - 0.8**r) ** b >= substring.RECALL


def test_near_paragraphs_are_clustered(spark):
    """Clusters against brute force over all classes of small texts: no link of Jaccard 0.8 is lost, none is made up."""
    rng = random.Random(4)
    texts = []
    for _ in range(40):
        base = _prose(rng, 160, 9).split(" ")
        texts.append(" ".join(base))
        for _ in range(2):
            near = list(base)
            for _ in range(12):
                at = rng.randrange(len(near))
                near[at : at + 1] = rng.choice([[], ["extra", near[at]], ["other"]])
            texts.append(" ".join(near))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = substring.saved(substring.paragraphs(docs))
    units = rows.collect()
    assert all(r["words"] == len(texts[r["doc_id"]][r["start"] : r["end"]].split(" ")) for r in units)
    held = {}
    for r in units:
        held.setdefault(r["class"], (texts[r["doc_id"]][r["start"] : r["end"]], set()))[1].add(r["doc_id"])
    sets = {c: _set(t, 5) for c, (t, _) in held.items()}
    pairs = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = {c: c for c in sets}
    for _ in range(20):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    named = {c for p in pairs for c in p} | {c for c, (_, ids) in held.items() if len(ids) > 1}
    got = {r["_class"]: r["cluster"] for r in substring.clusters(docs, rows).collect()}
    assert len(pairs) >= 8 and got == {c: root[c] for c in named}


def test_every_near_pair_of_short_paragraphs_shares_a_band():
    rng = random.Random(8)
    n_bands, n_rows = substring.tuned_bands(0.8)
    pairs = 0
    for _ in range(4000):
        a = [f"w{rng.randrange(6000)}" for _ in range(rng.randrange(5, 20))]
        b = list(a) + [f"x{rng.randrange(9)}" for _ in range(rng.randrange(0, 4))]
        if rng.random() < 0.3:
            b[0] = "y"
        if rng.random() < 0.2:  # one shingle again and again: other sequence, same set
            a, b = ["z"] * rng.randrange(5, 9), ["z"] * rng.randrange(9, 12)
        x, y = _set(" ".join(a), 5), _set(" ".join(b), 5)
        if a != b and 100 * len(x & y) >= 80 * len(x | y):
            words = [w for _, w in shingles.word_hashes([" ".join(a), " ".join(b)])]
            many, bands = substring._signatures(np.concatenate(words), np.array([len(w) for w in words]), n_bands, n_rows)
            assert set(bands[: many[0]]) & set(bands[many[0] :])
            pairs += 1
    assert pairs > 500


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    x = toxicity.classify(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    toxic, ordinary = x[x.toxic == 1].score, x[x.toxic == 0].score
    auc = np.mean([(t > ordinary).mean() + (t == ordinary).mean() / 2 for t in toxic])
    assert auc >= 0.8 and (ordinary >= 0.3).mean() <= 0.05  # 37 toxic rows to learn from; far better on larger samples


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert clean.columns == docs.columns
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()
    want = _components([(r["doc_id"], r["text"]) for r in docs.collect()], 5, 80)
    assert sorted(r["doc_id"] for r in kept) == sorted(d for d, (n, c) in want.items() if c == d)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "jaccard_join", "pii", "source_mixing", "byte_bpe"]
