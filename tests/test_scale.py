"""Plans whose work and memory must follow the input."""

import hashlib
import random

import duckdb
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from mailstrata import contract
from mailstrata.operators import evidence, intervals, learning
from mailstrata.shipping import shipped

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_are_made_without_comparing_them(spark):
    plan = plan_of(contract.QUERIES["session_ids"](shipped(spark), SF))
    above = plan[: plan.index("Join")]
    assert "Exchange" not in above and "Aggregate" not in above  # the pairs are many more than the rows of both sides


@pytest.mark.parametrize("cells", [1, 7])
def test_pairs_equal_all_pairs(spark, cells):
    left, right = [(i % 3 if i % 5 else None, f"l{i}") for i in range(20)], [(i % 4 if i % 6 else None, f"r{i}") for i in range(30)]
    schema = "k int, x string"
    got = intervals.paired(spark.createDataFrame(left, schema), spark.createDataFrame([*right, right[1]], schema), "k", cells).select("left_x", "right_x").collect()
    assert sorted(map(tuple, got)) == sorted((a, b) for i, a in left for j, b in [*right, right[1]] if i is not None and i == j)


def test_session_ids_of_repeated_rows(spark, tmp_path):
    for t in ("supplier", "customer"):
        rows = spark.read.parquet(f"{SF}/{t}.parquet")
        rows.unionByName(rows.limit(5)).write.parquet(f"{tmp_path}/{t}.parquet")
    once, twice = (sorted(map(tuple, contract.QUERIES["session_ids"](shipped(spark), d).collect())) for d in (SF, str(tmp_path)))
    assert once == twice


def test_session_ids_of_null_keys_equal_sql(spark, tmp_path):
    spark.createDataFrame([(1, 3), (None, 3), (None, 3), (2, None), (None, None), (4, 5)], "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(7, 3), (None, 3), (8, None), (None, 5), (9, 5), (9, 5)], "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    db = duckdb.connect()
    for t in ("supplier", "customer"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    order = lambda rows: sorted(map(tuple, rows), key=str)
    got = order(contract.QUERIES["session_ids"](shipped(spark), str(tmp_path)).collect())
    assert got == order(db.execute(contract.ORACLES["session_ids"]).fetchall()) and len(got) == 6 and any(r[2] is None for r in got)


def test_session_ids_take_little_more_than_their_bits(spark, tmp_path):
    queries = entry.queries()
    queries["session_ids"](spark, "/root/testdata/sf0.1").write.parquet(f"{tmp_path}/ids")
    files = [pq.ParquetFile(f).metadata for f in tmp_path.glob("ids/*.parquet")]
    rows = sum(m.num_rows for m in files)
    stored = sum(m.row_group(g).column(c).total_compressed_size for m in files for g in range(m.num_row_groups) for c in range(4))
    assert rows > 500_000 and stored < 24 * rows  # two ids of 64 bits are 16 bytes


def test_settings_of_one_query_are_not_those_of_the_next(spark):
    codec, queries = "spark.sql.parquet.compression.codec", entry.queries()
    queries["session_roles"](spark, SF)
    before = spark.conf.get(codec)
    queries["session_ids"](spark, SF)
    assert spark.conf.get(codec) == "zstd" != before
    queries["session_roles"](spark, SF)
    assert spark.conf.get(codec) == before
    spark.conf.set(codec, "gzip")
    try:
        queries["session_ids"](spark, SF)
        queries["session_roles"](spark, SF)
        assert spark.conf.get(codec) == "gzip"  # the user's own stays
    finally:
        spark.conf.unset(codec)


@pytest.mark.parametrize("name, exchanges", [("overlap_conflicts", 1), ("range_ambiguity", 3)])
def test_conflicts_move_each_row_once(spark, name, exchanges):
    plan = plan_of(contract.QUERIES[name](shipped(spark), SF))
    assert "Join" not in plan and plan.count("Exchange") == exchanges


def test_conflicts_and_ranges_equal_a_plain_count(spark):
    rng = random.Random(5)
    segments, ranges = [], []
    for k in range(30):
        for n in rng.sample(range(99), 9):
            start, length = rng.randrange(60), rng.randrange(0, 25)
            segments.append((k, n, start, start + length, None if rng.random() < 0.05 else "".join(rng.choice("aaab") for _ in range(length))))
        ranges += [(k, i, a, a + rng.randrange(0, 9)) for i, a in enumerate(rng.sample(range(90), 6))]
    want = set()
    for k in range(30):
        runs = {}
        own = [s for s in segments if s[0] == k]
        for x in range(90):
            there = sorted(s for s in own if s[2] <= x < s[3])
            for later in there[1:]:
                run = runs.setdefault((there[0], later), [])
                if run and run[-1][1] == x:
                    run[-1][1] = x + 1
                else:
                    run.append([x, x + 1])
        for (o, p), found in runs.items():
            for a, z in found:
                if o[4] is not None and p[4] is not None and (one := o[4][a - o[2] : z - o[2]]) != (other := p[4][a - p[2] : z - p[2]]):
                    want.add((k, a, z, o[1], p[1], *(hashlib.sha256(x.encode()).hexdigest() for x in (one, other))))
    strange = [(None, 1, 0, 9, "aaaaaaaaa"), (None, 2, 0, 9, "bbbbbbbbb"), (1, None, 0, 60, "c" * 60)]
    table = spark.createDataFrame(segments + strange, "k int, packet int, start int, end int, payload string")
    found = evidence.disagreements(table, ["k"])
    assert sorted(map(tuple, found.collect())) == sorted(want) and len(want) > 50
    asked = spark.createDataFrame([*ranges, (None, 1, 0, 60)], "k int, id int, start int, end int")
    got = {tuple(r) for r in evidence.ambiguous(asked, found, ["k"]).collect()}
    meets = lambda k, a, z: any(w[0] == k and w[1] < max(z, a + 1) and a < w[2] for w in want)
    assert got == {(*r, meets(r[0], r[2], r[3])) for r in ranges} | {(None, 1, 0, 60, False)}


def test_explanations_move_no_rows(spark):
    plan = plan_of(contract.QUERIES["explain_topk"](shipped(spark), SF))
    assert "Window" not in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("most", [1, 40_000])
def test_explanations_equal_a_plain_count(spark, monkeypatch, most):
    monkeypatch.setattr(learning, "BROADCAST_VALUES", most)
    rows = [(i, "abc"[i * i % 3], None if i % 4 == 0 else i % 5) for i in range(40)]
    got = learning.explain(spark.createDataFrame(rows, "id int, b string, a int"), "id", ["b", "a"], 1).collect()
    count = lambda n, v: sum(r[n] == v for r in rows) / 40
    each = lambda r: [(count(1, r[1]), "b", r[1]), (1.0, "a", None) if r[2] is None else (count(2, r[2]), "a", str(r[2]))]
    want = {r[0]: min(each(r), key=lambda e: e[:2]) for r in rows}
    assert {r["id"]: (r["frequency"], r["feature"], r["value"]) for r in got} == want and {r["rank"] for r in got} == {1}


def test_spans_are_dealt_before_they_are_counted(spark):
    plan = plan_of(contract.QUERIES["merged_spans"](shipped(spark), SF))
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan[plan.index("Exchange") :]  # a scan's task would hold nearly all of its rows in a map
