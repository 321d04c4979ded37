"""Settings, sinks and the command line."""

import json

import pytest

from mailstrata import __main__ as cli
from mailstrata import sinks
from mailstrata.config import Config


def test_settings():
    c = Config.from_env({"MAILSTRATA_MAX_PACKETS": "5", "MAILSTRATA_DISABLED": "CERT-001,CERT-002", "OTHER": "x"}).with_values({"minimum_version": "0x0304"})
    assert (c.max_packets, c.disabled, c.minimum_version) == (5, ("CERT-001", "CERT-002"), 0x0304)
    for bad in ({"MAILSTRATA_MAX_PACKETS": "many"}, {"MAILSTRATA_MAX_PACKETS": "0"}):
        with pytest.raises(ValueError):
            Config.from_env(bad)


def test_html_is_escaped_and_bounded(spark):
    page = sinks.render_html("<t>", {"x": spark.createDataFrame([("<script>",), (None,), ("c",)], "v string")}, 2)
    assert "<script>" not in page and "&lt;script&gt;" in page and "2 of 3 rows" in page and "http" not in page


def test_replacing_one_investigation_leaves_others(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *v: spark.createDataFrame([(x,) for x in v], "v int")
    sinks.replace_rows(rows(1, 2), path, "a")
    sinks.replace_rows(rows(3), path, "b")
    sinks.replace_rows(rows(9), path, "a")
    assert sorted((r["investigation_id"], r["v"]) for r in spark.read.parquet(path).collect()) == [("a", 9), ("b", 3)]


def test_command_line(spark, tmp_path):
    assert cli.main(["fixtures", str(tmp_path / "a.pcap"), "5"]) == 0
    assert cli.main(["analyze", str(tmp_path / "*.pcap"), str(tmp_path / "out"), "--no-segments", "--set", "disabled=TLS-KEX-001"]) == 0
    lines = [json.loads(x) for p in (tmp_path / "out/sessions_json").glob("part-*") for x in p.read_text().splitlines()]
    assert len(lines) == 5 and all("runs" not in x for x in lines) and cli.main(["status"]) == 0
    found = [json.loads(x) for p in (tmp_path / "out/findings_json").glob("part-*") for x in p.read_text().splitlines()]
    assert found and all(x["rule_id"] != "TLS-KEX-001" for x in found)
