"""Command line: investigations, sweeps, backtests, feedback and learning over a folder of tables."""

from __future__ import annotations

import argparse
import json
import time
from datetime import date

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gaugeworks.contract import default_contract
from gaugeworks.ml.ranker import RankerCache
from gaugeworks.operators import feedback, series, triage
from gaugeworks.operators.narrative import MODES, NarrativeCache
from gaugeworks.plans.investigate import investigate
from gaugeworks.sources.estate import Estate

COMMANDS = ("investigate", "sweep", "backtest", "semantics", "freshness", "feedback", "outcome", "learning", "reset", "ranker")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("--data", required=True)
    p.add_argument("--metric", default="net_revenue")
    p.add_argument("--persona", default="data_analyst")
    p.add_argument("--from", dest="first", type=date.fromisoformat, default=date(2000, 3, 1))
    p.add_argument("--to", dest="last", type=date.fromisoformat, default=date(2000, 3, 14))
    p.add_argument("--fiscal-period")
    p.add_argument("--filter", action="append", default=[], help="dimension=value")
    p.add_argument("--state", help="folder of the feedback log, outcomes, narrative cache and outbox")
    p.add_argument("--card", help="file of a trained ranker")
    p.add_argument("--mode", choices=MODES[:3], default="offline")
    p.add_argument("--now", help="time that freshness is judged at")
    p.add_argument("--run"), p.add_argument("--hypothesis"), p.add_argument("--grade", choices=feedback.GRADES), p.add_argument("--note"), p.add_argument("--analyst", default="")
    p.add_argument("--playbook"), p.add_argument("--recovered", type=float)
    a = p.parse_args(argv)
    if a.command in ("feedback", "outcome", "learning", "reset") and not a.state:
        p.error(f"{a.command} needs --state")
    spark = SparkSession.builder.appName("gaugeworks").getOrCreate()
    contract, estate, seq = default_contract(), Estate(spark, a.data), time.time_ns()
    log, outcomes = f"{a.state}/feedback", f"{a.state}/outcomes"
    if a.command == "investigate":
        told = {r["hypothesis_id"]: r["prior"] for r in feedback.priors(feedback.read_log(spark, log)).where(F.col("metric") == a.metric).collect()} if a.state else None
        out = investigate(
            estate, contract, a.metric, a.persona, a.first, a.last, dict(f.split("=", 1) for f in a.filter), a.fiscal_period, told, model=RankerCache().get(a.card) if a.card else None,
            cache=NarrativeCache(f"{a.state}/narratives.json") if a.state else None, outbox=f"{a.state}/outbox.json" if a.state else None, mode=a.mode,
        )
    elif a.command == "sweep":
        swept = triage.sweep(estate.fact(), contract.resolved(), [a.metric], a.first, a.last)
        out = {"worklist": [r.asDict() for r in triage.worklist(swept).collect()], "held_back": [r.asDict() for r in triage.suppression(swept).collect()]}
    elif a.command == "backtest":
        s = series.daily_series(estate.fact().where(F.col("order_date") <= F.lit(a.last)), contract.resolved().metric(a.metric))
        out = [r.asDict() for r in triage.backtest(s, contract.resolved().metric(a.metric), a.first, a.last).orderBy("ws").collect()]
    elif a.command == "freshness":
        slas = {k: v["sla_minutes"] for k, v in contract.sources.items() if k in ("orders", "dispatch")}
        out = [r.asDict() for r in estate.freshness(a.now or time.strftime("%Y-%m-%d %H:%M:%S"), slas).collect()]
    elif a.command == "feedback":
        out = feedback.record(spark, log, seq, a.run or "", a.metric, a.hypothesis, a.grade, a.note, a.analyst)
    elif a.command == "outcome":
        feedback.record_outcome(spark, outcomes, seq, a.playbook, a.recovered)
        out = {"playbook": a.playbook, "recovered": a.recovered}
    elif a.command == "learning":
        every = feedback.read_log(spark, log)
        seed = spark.createDataFrame([(b.id, b.recovered_pct, b.n_observations) for b in contract.playbooks], "playbook_id string, effect double, n int")
        means = feedback.outcome_means(seed, feedback.read_log(spark, outcomes, feedback.OUTCOMES).select("playbook_id", "recovered"))
        out = {"priors": [r.asDict() for r in feedback.priors(every).collect()], "stats": feedback.stats(every).first().asDict(), "notes": [r.asDict() for r in feedback.corrections(every).collect()], "playbooks": [r.asDict() for r in means.collect()]}
    elif a.command == "reset":
        out = {"reset": feedback.reset(spark, log, seq, a.analyst)}
    elif a.command == "ranker":
        model = RankerCache().get(a.card) if a.card else None
        out = {"loaded": model is not None} | ({"alpha": model.alpha, "features": len(model.features), "trees": len(model.trees.roots), "version": model.version} if model else {})
    else:
        out = {"selected": contract.resolved().selected, "unresolved": contract.unresolved()}
    print(json.dumps(out, default=str, indent=1))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
