"""Nulls, empty and very long texts, repeated rows, empty tables, clashing columns: every operator gives its defined result."""

import hashlib

import numpy as np
import pytest

import corpus_pipeline
from mailstrata.llm import ann, bpe, jaccard, mixing, pii, secret_scan, sharding, substring, topk, toxicity, vectors

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, spans string, n_tokens string, size string, shard string, target string"
LONG = "lorem ipsum dolor " * 20_000
ROWS = [(1, "call me at a@b.org now please", "en", "s1"), (2, None, None, None), (3, "", "en", "s1"), (None, "no id here at all", "en", "s2"), (1, "call me at a@b.org now please", "en", "s1"), (5, LONG, "en", "s2"), (6, LONG, None, "s2"), (7, " \n\t ", "en", "s3")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None, *["x"] * 6) for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_mixing(docs, none):
    got = mixing.mix(docs).collect()
    assert len(got) == len(ROWS) and sum(r["size"] for r in got if r["source"] == "s2") == 120_005 and next(r for r in got if r["doc_id"] == 2)["size"] == 0
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    assert mixing.mix(none).count() == 0 and mixing.apply_mix(none).columns == none.columns and mixing.apply_mix(none).count() == 0
    assert set(mixing.apply_mix(docs).columns) == set(docs.columns)


def test_pii(docs, none):
    got = {r["doc_id"]: r for r in pii.find_pii(docs).collect()}
    assert [(s["start"], s["end"]) for s in got[1]["_email"]] == [(11, 18)] and got[2]["_email"] == [] and got[5]["_phone"] == []
    clean = {r["doc_id"]: r for r in pii.redact(docs).collect()}
    assert clean[1]["text"] == "call me at [EMAIL] now please" and clean[1]["n_chars"] == 29 and clean[2]["text"] is None and clean[5]["text"] == LONG
    assert pii.redact(none).count() == 0


def test_secrets(spark, docs, none, tmp_path):
    ledger = secret_scan.BlobLedger(spark, str(tmp_path / "ledger"))
    assert ledger.unseen(docs).count() == 5  # null and empty are one blob
    ledger.ingest(docs)
    assert ledger.unseen(docs).count() == 0 and ledger.unseen(docs, rules="other").count() == 5
    more = spark.createDataFrame([(9, 'token = "abcdefghijkl1234"'), (10, 'token = "abcdefghijkl1234"'), (1, "call me at a@b.org now please")], "doc_id long, text string")
    assert ledger.unseen(more).count() == 1
    ledger.ingest(more)
    got = ledger.findings(docs.unionByName(more, allowMissingColumns=True)).collect()
    assert len(got) == len(ROWS) + 3 and sorted(r["doc_id"] for r in got if len(r["spans"])) == [9, 10]
    ledger.ingest(none)
    assert ledger.findings(none).count() == 0


def test_bpe(docs, none):
    import public_tokenizers
    import tiktoken

    path, pattern = bpe.production()
    enc = bpe.encoder(bpe.rank_bytes(path), pattern)
    got = bpe.encode(docs, path, pattern, digest=True).collect()
    for r, source in zip(got, ROWS, strict=True):
        ids = enc.encode_ordinary(source[1] or "")
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((source[1] or "").encode()).hexdigest()
    assert bpe.encode(none, path, pattern, digest=True).count() == 0
    again = bpe.decode(bpe.encode(docs, path, pattern), path, pattern).collect()
    assert [bytes(r["decoded"]).decode() for r in again] == [r[1] or "" for r in ROWS]
    assert public_tokenizers.PATTERN == pattern and isinstance(enc, tiktoken.Encoding)


def test_bpe_safe_pieces():
    path, pattern = bpe.production()
    enc = bpe.encoder(bpe.rank_bytes(path), pattern)
    for text in ("it's we'll 'sabc  \n\n x1y22 ... é1 ", "a1 b'd  c  d 12ab'll " * 9, "word's  \t" * 50 + "été 'Été' ½x"):
        for size in (1, 2, 3, 7, 20):
            parts = list(bpe.safe_pieces(text, size))
            assert "".join(parts) == text and [i for p in parts for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


def test_jaccard(docs, none):
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in jaccard.link_documents(docs, 3, 90).collect()}
    assert got[1, 4] == 1 and got[2, 0] == 2 and got[3, 0] == 3 and got[5, 3] == 5 and got[6, 3] == 5 and got[7, 0] == 7
    assert jaccard.link_documents(none, 3, 90).count() == 0


def test_sharding(docs, none):
    got = sharding.reshard(docs, new=3, old=2, blocks=8).collect()
    assert len(got) == len(ROWS) and next(r for r in got if r["doc_id"] == 2)["size"] == 16
    for j in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == j) == list(range(sum(r["shard"] == j for r in got)))
    assert sharding.reshard(none).count() == 0


def test_substring(docs, none):
    got = substring.repeated_passages(docs).collect()
    assert {r["doc_id"]: r["remove"] for r in got if r["start"] == 0} == {5: False, 6: True} and all(r["cluster"] for r in got)
    # a short repeat counts only where run says so; a row that repeats with its id is one document
    assert {r["doc_id"] for r in substring.repeated_passages(docs, run=1).collect()} == {5, 6}
    assert substring.repeated_passages(none).count() == 0


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(1, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.classify(docs, labels).collect()} == {0.0}  # one class only: nothing is learned
    assert toxicity.classify(none, labels).count() == 0
    model = toxicity.fit(["you idiot you", "such an idiot"] * 5, ["a fine day", "the red house", "we met again"] * 5)
    got = [r["score"] for r in toxicity.score(docs, model).collect()]
    assert len(got) == len(ROWS) and all(0 <= s <= 1 for s in got)


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [0.0, 0.0]), (2, [0.9, 0.1]), (None, [1.0, 1.0]), (8, [float("inf"), 0.0]), (9, [])], "vec_id long, embedding array<float>")
    assert sorted(r[0] for r in vectors.usable(rows).collect()) == [1, 2, 2] and sorted(r[0] for r in vectors.usable(rows, zero=True).collect()) == [1, 2, 2, 6]
    good = vectors.usable(rows)
    assert [tuple(r)[:3] for r in topk.top_k(good, good.where("vec_id = 1"), 5).collect()] == [(1, 1, 2)]
    assert [tuple(r)[:3] for r in ann.neighbours(good, good.where("vec_id = 1"), 5).collect()] == [(1, 1, 2)]
    empty = good.where("vec_id < 0")
    assert topk.top_k(empty, empty, 5).count() == 0 and ann.neighbours(empty, empty, 5).count() == 0
    assert topk.top_k(good, empty, 5).count() == 0 and ann.neighbours(good, empty, 5).count() == 0


def test_near_duplicate_stage(spark, docs, none):
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    ids = sorted(str(r["doc_id"]) for r in kept.collect())
    assert ids == ["1", "2", "3", "5", "7", "None"]
    assert corpus_pipeline.drop_near_duplicates(spark, none, "").count() == 0


def test_texts_under_one_id_stay_apart(spark):
    texts = [" ".join(f"{c}{i}" for i in range(20)) for c in "abcd"]
    rows = [(1, texts[0]), (1, texts[1]), (2, texts[2]), (1, texts[0]), (3, texts[1] + " more"), (None, texts[3]), (None, texts[3]), (None, texts[2])]
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == sorted([(1, texts[0]), (1, texts[1]), (2, texts[2]), (0, texts[3])])


def test_vectors_of_other_lengths_take_no_part(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [1.0, 1.0, 1.0]), (4, [0.5]), (5, [0.0, 1.0])], "vec_id long, embedding array<float>")
    good = vectors.usable(rows)
    assert sorted(r[0] for r in good.collect()) == [1, 2, 5] and [r[0] for r in vectors.usable(rows, width=3).collect()] == [3]
    assert [tuple(r)[:3] for r in topk.top_k(good, good.where("vec_id = 1"), 5).orderBy("rank").collect()] == [(1, 1, 2), (1, 2, 5)]
    assert [tuple(r)[:3] for r in ann.neighbours(good, good.where("vec_id = 1"), 5).orderBy("rank").collect()] == [(1, 1, 2), (1, 2, 5)]


def test_many_hits_in_one_text(spark):
    """Cost follows the text: 5 000 addresses and as many tokens in a text of some 200 KB, against plain Python."""
    import re
    import time

    text = " ".join(f"user{i}@site{i % 7}.org token=abcdefABCDEF{i:05d}" for i in range(5000))
    one = spark.createDataFrame([(1, text)], "doc_id long, text string").coalesce(1)
    pii.find_pii(one.limit(0)).count()
    began = time.perf_counter()
    found = pii.find_pii(one).select("_email").first()["_email"]
    assert time.perf_counter() - began < 15
    assert [(s["start"], s["end"]) for s in found] == [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    assert pii.redact(one).first()["text"] == re.sub(r"user\d+@site\d\.org", "[EMAIL]", text)
    assert len(secret_scan.scan(one).first()["spans"]) == 5000


NAMES = "doc_id long, text string, source string, n_chars long, _key string, _gone string, _again string, row string, _row string, _of string, _h string, _copies string, _source string, group string, key string"
STAGED = [(1, "call a@b.org today", "s1"), (2, None, "s1"), (3, "", None), (1, "call a@b.org today", "s1"), (None, "no id at all here", "s2"), (5, "one two three four five six seven eight nine ten", "s2"), (6, "one two three four five six seven eight nine ten", "s2")]


@pytest.fixture(scope="module")
def staged(spark):
    return spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None, *["x"] * 11) for r in STAGED], NAMES)


@pytest.fixture(scope="module")
def labelled(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("labelled")
    spark.createDataFrame([(1, 0), (5, 0)], "doc_id long, toxic int").write.parquet(str(folder / "labels.parquet"))
    return str(folder)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_keep_columns_of_any_name(spark, staged, labelled, name, stage):
    """Nulls, empty texts, repeated rows, clashing names and an empty table through every stage."""
    got, none = stage(spark, staged, labelled), stage(spark, staged.limit(0), labelled)
    assert none.count() == 0 and none.columns == got.columns
    rows = sorted((str(r["doc_id"]), r["source"]) for r in got.collect())
    all_rows = sorted((str(d), s) for d, _, s in STAGED)
    if name == "jaccard_join":
        assert rows == sorted(set(all_rows) - {("6", "s2")})
    elif name == "source_mixing":
        assert set(rows) <= set(all_rows)
    else:
        assert rows == all_rows
    if name == "byte_bpe":
        assert {(r["doc_id"], r["n_tokens"] > 0) for r in got.collect()} == {(1, True), (2, False), (3, False), (None, True), (5, True), (6, True)}
    else:
        assert got.columns == staged.columns and {r["_key"] for r in got.collect()} == {"x"}
    if name == "pii":
        assert {r["text"] for r in got.collect() if r["doc_id"] == 1} == {"call [EMAIL] today"}
