"""python -m mailstrata analyze GLOB OUT [--no-segments] [--no-events] [--trust-store PEM] [--model PATH] [--set name=value]...
python -m mailstrata learn OUT MODEL [--threshold SHARE]
python -m mailstrata fixtures PATH [SESSIONS]
python -m mailstrata status"""

from __future__ import annotations

import argparse
import os
import sys
from pathlib import Path


def main(args: list[str]) -> int:
    p = argparse.ArgumentParser(prog="mailstrata", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    verbs = p.add_subparsers(dest="verb", required=True)
    a = verbs.add_parser("analyze")
    a.add_argument("glob")
    a.add_argument("out")
    a.add_argument("--no-segments", action="store_true")
    a.add_argument("--no-events", action="store_true")
    a.add_argument("--trust-store")
    a.add_argument("--model")
    a.add_argument("--set", action="append", default=[], metavar="NAME=VALUE")
    n = verbs.add_parser("learn")
    n.add_argument("out")
    n.add_argument("model")
    n.add_argument("--threshold", type=float, default=0.02)
    f = verbs.add_parser("fixtures")
    f.add_argument("path")
    f.add_argument("sessions", type=int, nargs="?", default=25)
    verbs.add_parser("status")
    o = p.parse_args(args)
    if o.verb == "fixtures":
        from .sources.synth import mail_capture

        Path(o.path).write_bytes(mail_capture(o.sessions))
        return 0
    if o.verb == "status":
        import pyspark

        print(f"mailstrata on PySpark {pyspark.__version__}")
        return 0
    return learn(o) if o.verb == "learn" else analyze(o)


def learn(o) -> int:
    """Stores the frequencies of the sessions that an analysis left under OUT as a model that later analyses judge theirs by."""
    from pyspark.sql import SparkSession

    from .operators import profiles
    from .shipping import shipped

    spark = shipped(SparkSession.builder.appName("mailstrata").getOrCreate())
    baseline = profiles.fit(profiles.profile(spark.read.parquet(f"{o.out}/sessions")), o.threshold)
    profiles.save(spark, baseline, o.model)
    print(f"{baseline.total} sessions, {len(baseline.combinations)} combinations")
    return 0


def analyze(o) -> int:
    """Writes sessions, findings, scores and a report page under OUT."""
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .config import Config
    from .operators import chains, profiles, rules
    from .shipping import shipped
    from .sinks import render_html, write_json
    from .sources import sessions
    from .sources.capture import dissect, read_captures

    config = Config.from_env(dict(os.environ)).with_values(dict(x.split("=", 1) for x in o.set))
    spark = shipped(SparkSession.builder.appName("mailstrata").getOrCreate())
    policy = rules.Policy(minimum_version=config.minimum_version, minimum_coverage=config.minimum_coverage, disabled=config.disabled)
    anchors, store = chains.trust_store(spark, o.trust_store)
    if store["error"]:
        print(store["error"], file=sys.stderr)
    walked = sessions.assemble(dissect(read_captures(spark, o.glob, config.max_packets)), config.session_budget)
    walked.write.mode("overwrite").parquet(f"{o.out}/walked")  # flows are walked once
    facts = sessions.facts(chains.with_chain_status(spark.read.parquet(f"{o.out}/walked"), anchors, store["configured"]))
    facts.write.mode("overwrite").parquet(f"{o.out}/sessions")  # everything below reads this table
    facts = spark.read.parquet(f"{o.out}/sessions")
    results = rules.evaluate(facts, policy)
    found = rules.prioritised(rules.findings(results, policy))
    scores = rules.posture(facts, ["capture_id"], policy)
    write_json(facts, f"{o.out}/sessions_json", not o.no_segments, not o.no_events)
    write_json(found, f"{o.out}/findings_json")
    chains.inventory(facts).write.mode("overwrite").parquet(f"{o.out}/certificates")
    warnings = facts.select("capture_id", "session_id", F.explode("warnings").alias("w")).select("capture_id", "session_id", "w.*")
    warnings.write.mode("overwrite").parquet(f"{o.out}/warnings")
    write_json(scores, f"{o.out}/scores_json")
    baseline, status, reason = profiles.load(spark, o.model)
    print(f"model: {status}" + (f", {reason}" if reason else ""), file=sys.stderr)
    profiles.judged(profiles.profile(facts), baseline).write.mode("overwrite").parquet(f"{o.out}/profiles")
    page = render_html("Mail transport report", {"Scores": scores.orderBy("capture_id"), "Findings": found.orderBy("rank"), "Sessions": facts.select("session_id", "server_ip", "server_port", "protocol", "upgrade_state", "completeness").orderBy("session_id")})
    spark.createDataFrame([(page,)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\0").text(f"{o.out}/report")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
