"""Training table of the driver ranker: past episodes replayed through the investigation."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.contract import Contract
from gaugeworks.ml.ranker import candidate_frame, featurize, label
from gaugeworks.plans.investigate import investigate
from gaugeworks.sources.estate import Estate


def replay(estate: Estate, contract: Contract, episode: dict, **inputs) -> DataFrame | None:  # noqa: ANN003
    """Candidate rows of one episode (episode_id, metric, window, filters), as the investigation saw them
    with nothing after the window visible; None where it was refused or found no candidate."""
    ws, we = (date.fromisoformat(str(x)) for x in episode["window"])
    then = Estate(estate.spark, estate.sf_dir, we)
    out = investigate(then, contract, episode["metric"], episode.get("persona", "data_analyst"), ws, we, episode.get("filters"), **inputs)
    if not out.get("hypotheses"):
        return None
    rows = candidate_frame(estate.spark, out["hypotheses"], out["movement"], episode["episode_id"])
    return rows.withColumn("window_start", F.lit(ws))


def build(estate: Estate, contract: Contract, episodes: list[dict], path: str, **inputs) -> dict:  # noqa: ANN003
    """Replay a list of episodes, label their candidates by the known drivers, and append the features
    to a table, an episode at a time (so a run that breaks off keeps what it has). An episode that
    fails is skipped and named in the result."""
    truth = [(e["episode_id"], d["driver_type"], d.get("entity")) for e in episodes for d in e.get("drivers", ())]
    known = estate.spark.createDataFrame(truth, "episode_id string, driver_type string, entity string")
    done, skipped = [], {}
    for e in episodes:
        try:
            rows = replay(estate, contract, e, **inputs)
        except Exception as error:  # noqa: BLE001  one bad episode does not end the corpus
            skipped[e["episode_id"]] = f"{type(error).__name__}: {str(error)[:200]}"
            continue
        if rows is None:
            skipped[e["episode_id"]] = "no candidates"
            continue
        featurize(label(rows, known)).withColumn("null_episode", F.lit(not e.get("drivers"))).coalesce(1).write.mode("append").parquet(path)
        done.append(e["episode_id"])
    return {"episodes": done, "skipped": skipped}
