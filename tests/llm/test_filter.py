"""The pipeline's toxicity filter: what it may lose, and what it catches within that."""

import zlib

import duckdb

from mailstrata.llm import toxicity

SF = "/root/testdata/sf0.1"


def test_bounded_loss_catches_more_of_held_out_rows():
    rows = duckdb.sql(f"SELECT doc_id, text, toxic FROM '{SF}/documents.parquet' JOIN '{SF}/labels.parquet' USING (doc_id) WHERE octet_length(encode(text)) BETWEEN 1 AND 32768 ORDER BY md5(doc_id::VARCHAR), text").fetchall()
    held = [zlib.crc32(str(r[0]).encode()) % 4 == 2 for r in rows]
    toxic, ordinary = ([r[1] for r, h in zip(rows, held, strict=True) if r[2] == v and not h][: 1000 * (2 - v)] for v in (1, 0))
    figures = {}
    for most in (None, 0.03):
        model = toxicity.fit(toxic, ordinary, 0.11, most)
        d = toxicity.Distances(model["toxic"], model["ordinary"])
        called = [(r[2], toxicity.excess(d.all(toxicity.windows(r[1])), model["least"]) >= model["cut"]) for r, h in zip(rows, held, strict=True) if h]
        figures[most] = [sum(c for v, c in called if v == kind) / sum(v == kind for v, _ in called) for kind in (1, 0)]
    assert figures[0.03][0] > figures[None][0] + 0.03 and figures[0.03][1] < 0.05, figures


def test_without_a_bearable_cut_f1_decides():
    few = ["you idiot you", "such an idiot"] * 5, ["a fine day", "the red house", "we met again"] * 5
    assert toxicity.fit(*few, 0.5, -1.0) == toxicity.fit(*few)
