"""Captures cut into ranges: every packet once, with its number, whatever the size of a range."""

import io

import pytest

from mailstrata.sources import capture, synth


def _captures():
    packets = synth.conversation(("10.0.0.1", 40000), ("192.0.2.1", 25), synth.smtp_starttls())
    ng = synth.pcapng(packets)
    return {"pcap": synth.mail_capture(8), "pcapng": ng, "two sections": ng + synth.pcapng(packets[:5])}


@pytest.mark.parametrize("split", [1, 100, 1000, 1 << 30])
@pytest.mark.parametrize("kind", ["pcap", "pcapng", "two sections"])
def test_ranges_give_every_packet_once(kind, split):
    data = _captures()[kind]
    want = list(capture.frames(io.BytesIO(data)))
    cut, end = capture.ranges(io.BytesIO(data), split)
    got = [row for x in cut for row in capture.frames_of(io.BytesIO(data), *x)]
    assert got == want and end == {"packets": len(want), "ended": "COMPLETE", "offset": None} and (len(cut) > 3 or split > 100)
    assert [x[1] for x in cut[:-1]] == [x[0] for x in cut[1:]] and cut[-1][1] is None


@pytest.mark.parametrize("kind", ["pcap", "pcapng"])
def test_a_cut_file_says_where_it_ended(kind):
    data = _captures()[kind][:-7]
    want = list(capture.frames(io.BytesIO(data)))
    cut, end = capture.ranges(io.BytesIO(data), 200)
    assert [row for x in cut for row in capture.frames_of(io.BytesIO(data), *x)] == want and want[-1][-1] is True
    assert end["ended"] == "TRUNCATED" and end["packets"] == len(want) - 1 and 0 < end["offset"] < len(data)
    assert capture.ranges(io.BytesIO(_captures()["pcap"][:20])) == ([], {"packets": 0, "ended": "TRUNCATED", "offset": 0})
    with pytest.raises(capture.NotACapture):
        capture.ranges(io.BytesIO(b"nothing at all"))


def test_a_limit_of_packets_holds_over_ranges():
    data = _captures()["pcap"]
    cut, _ = capture.ranges(io.BytesIO(data), 500)
    got = [r for x in cut for r in capture.frames_of(io.BytesIO(data), *x, max_packets=20)]
    assert [r[0] for r in got if r[0] is not None] == list(range(1, 21)) and got[20][-1] is True


def test_files_are_read_by_several_tasks_and_a_bad_one_stays_visible(spark, tmp_path):
    good, short = tmp_path / "good.pcap", tmp_path / "short.pcap"
    good.write_bytes(synth.mail_capture(10))
    short.write_bytes(synth.mail_capture(3)[:-5])
    (tmp_path / "bad.pcap").write_bytes(b"no capture")
    paths = [str(tmp_path / f"{n}.pcap") for n in ("good", "short", "bad", "missing")]
    index = capture.index_captures(spark, paths, split=2000).cache()
    by = {}
    for r in index.collect():
        by.setdefault(r["path"].rpartition("/")[2], []).append(r)
    assert len(by["good.pcap"]) > 3 and {r["ended"] for r in by["good.pcap"]} == {"COMPLETE"}
    assert {r["ended"] for r in by["short.pcap"]} == {"TRUNCATED"} and all(r["ended_at"] > 0 for r in by["short.pcap"])
    assert [bool(r["error"]) for n in ("bad.pcap", "missing.pcap") for r in by[n]] == [True, True]
    rows = capture.read_ranges(index)
    assert rows.where("error IS NOT NULL").count() == 2
    columns = ["capture_id", "packet_number", "ts_ns", "data", "link_type", "truncated"]
    same = lambda df: sorted(map(str, df.where("error IS NULL").select(*columns).collect()))
    whole = capture.read_captures(spark, str(tmp_path / "good.pcap")).unionByName(capture.read_captures(spark, str(short)))
    assert same(rows) == same(whole)
    capture.register(spark)
    source = spark.read.format("capture").option("split", 2000).load(str(good))
    assert source.rdd.getNumPartitions() > 3 and source.count() == capture.read_captures(spark, str(good)).count()
    index.unpersist()
