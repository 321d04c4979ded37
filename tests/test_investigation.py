"""Captures added one by one against one batch, repeated and broken-off runs, and admission against a plain walk."""

import random

import pytest

from mailstrata.operators import inventory, investigation

FACTS = "capture_id string, session_id string, entity string, at long, version string, suite string, `group` string, leaf_sha256 string, spki_sha256 string, issuer string, offer string, config_fingerprint string, chain_sha256 array<string>"


def _rows(seed=5):
    rng = random.Random(seed)
    rows = []
    for c in range(4):
        for s in range(25):
            e = rng.choice(["a", "b", "c", "d", None])
            pick = lambda *x: rng.choice(x)
            leaf = pick("L1", "L2", None)
            rows.append((f"cap-{c}", f"s{c}-{s}", e, 1000 * (c * 7 % 4) + rng.randrange(900), pick("1.2", "1.3", None), pick("x", "y"), pick("g", None), leaf, leaf and "K" + leaf[1], pick("i", "j"), pick("o", "p"), pick("f1", "f2", None), [leaf, "middle"] if leaf else []))
    return rows


def _found(rows):
    return [(r[0], r[1], "MAIL-001" if i % 3 else "TLS-PROTO-003") for i, r in enumerate(rows) if i % 2]


def _state(state):
    return {n: sorted(map(str, (r.asDict() for r in state[n].drop("generation").collect()))) for n in investigation.TABLES}


def test_one_by_one_equals_one_batch(spark, tmp_path):
    rows = _rows()
    facts = spark.createDataFrame(rows, FACTS)
    found = spark.createDataFrame(_found(rows), "capture_id string, session_id string, rule_id string")
    batch = _state(investigation.add_captures(spark, str(tmp_path / "batch"), facts, found))
    for c in (2, 0, 3, 1):
        one = investigation.add_captures(spark, str(tmp_path / "single"), facts.where(f"capture_id = 'cap-{c}'"), found)
    assert _state(one) == batch
    assert any("AUTHENTICATION_EXPOSURE" in x for x in batch["correlations"]) and any("middle" in x for x in batch["correlations"])
    assert any("OBSERVED_CHANGE" in x for x in batch["drift"]) and len(batch["entities"]) == 4
    events = investigation.timeline_events(one).collect()
    assert len(events) == sum("OBSERVED_CHANGE" in x for x in batch["drift"]) and all(e["event_id"].startswith("evt-") for e in events)
    # a capture that is in already changes nothing
    again = investigation.add_captures(spark, str(tmp_path / "single"), facts.where("capture_id = 'cap-2'"), found)
    assert _state(again) == batch and len(list((tmp_path / "single" / "manifest").iterdir())) == 4


def test_a_run_that_breaks_off_leaves_the_state(spark, tmp_path, monkeypatch):
    facts = spark.createDataFrame(_rows(6), FACTS)
    root = str(tmp_path / "x")
    before = _state(investigation.add_captures(spark, root, facts.where("capture_id = 'cap-0'")))
    monkeypatch.setattr(investigation, "drift_rows", lambda s: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        investigation.add_captures(spark, root, facts.where("capture_id = 'cap-1'"))
    monkeypatch.undo()
    assert _state(investigation._read(spark, root)) == before
    whole = _state(investigation.add_captures(spark, root, facts))
    assert whole == _state(investigation.add_captures(spark, str(tmp_path / "y"), facts))


def test_no_sessions(spark, tmp_path):
    none = investigation.add_captures(spark, str(tmp_path / "none"), spark.createDataFrame([], FACTS))
    assert all(none[n].count() == 0 for n in investigation.TABLES)


def test_admission_equals_a_plain_walk(spark):
    rng = random.Random(2)
    rows = [(f"c{rng.randrange(3)}", f"f{rng.randrange(60)}", start := rng.randrange(3000), start + rng.randrange(1, 400)) for _ in range(300)]
    want = {}
    for c in ("c0", "c1", "c2"):
        open_, refused, total = [], set(), 0
        for _, k, start, end in sorted((r for r in rows if r[0] == c), key=lambda r: (r[2], r[1])):
            open_ = [e for e in open_ if e >= start]
            taken = k not in refused and len(open_) < 5 and total < 70
            if taken:
                open_.append(end)
                total += 1
            else:
                refused.add(k)
            want[c, k, start, end] = taken
    table = spark.createDataFrame(rows, "capture_id string, flow string, start long, end long").repartition(7)
    got = {tuple(r)[:4]: r["admitted"] for r in inventory.admission(table, "flow", 5, 70).collect()}
    assert got == want and 0 < sum(got.values()) < len(got)
    turned_away = {k[:2] for k, v in got.items() if not v}
    for c, k in turned_away:  # a refused flow stays refused
        own = sorted((s, v) for (a, b, s, _), v in got.items() if (a, b) == (c, k))
        first = next(i for i, (_, v) in enumerate(own) if not v)
        assert not any(v for _, v in own[first:])
