"""Evidence over many hypotheses: postings, cohorts, onsets, closure; queries against their SQL; plans."""

import inspect
import math
from collections import Counter
from datetime import date, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from gaugeworks.contract import default_contract
from gaugeworks.functions.scalars import STOP_WORDS
from gaugeworks.operators import causal, cohorts, hierarchy, postings
from gaugeworks.operators.retrieval import RIVALS
from gaugeworks.operators.security import personas
from gaugeworks.plans import catalogue, evidence
from gaugeworks.plans.investigate import corroborations, market_events

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [n for n, f in inspect.getmembers(evidence, inspect.isfunction) if f.__module__ == evidence.__name__ and n in catalogue.ORACLE_SQL]
WS, WE = date(2000, 3, 1), date(2000, 3, 10)
TEXTS = "doc_id long, day date, text string, region string, theme string, author_role string, type string, account_id long, domain string"


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, small, duck, name):
    df = catalogue.QUERIES[name](spark, small)
    cur = duck.execute(catalogue.ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    got = sorted((tuple(r) for r in df.select(*names).collect()), key=key)
    assert got and got == sorted(cur.fetchall(), key=key)


def _texts(day, region="ASIA", n=6):
    return [(k, day, "the delivery was late and delayed", region, "service_failure", f"role{k % 3}", f"type{k % 2}", k, "crm") for k in range(n)]


def _hyp(**exposure):
    return {"id": "H", "driver_type": "service_failure", "exposure": exposure}


def test_only_texts_of_the_window_and_scope_count(spark):
    who = personas(default_contract().personas)["data_analyst"]
    ask = lambda rows, h, lag=5: corroborations([h], {"H": lag}, WS, WE, who, spark.createDataFrame(rows, TEXTS))["H"]
    assert ask(_texts(WS), _hyp())["corroborated"] and ask(_texts(WS), _hyp(region="ASIA"))["corroborated"]
    assert ask(_texts(WS - timedelta(days=5)), _hyp())["corroborated"]
    for rows, h in ((_texts(date(1990, 1, 1)), _hyp()), (_texts(WS - timedelta(days=6)), _hyp()), (_texts(WE + timedelta(days=1)), _hyp()), (_texts(WS, "EUROPE"), _hyp(region="ASIA")), (_texts(WS, None), _hyp(region="ASIA"))):
        assert ask(rows, h)["on_theme"] == 0 and ask(rows, h)["verdict"] == "insufficient"


def test_rival_themes_contest_and_others_do_not(spark):
    who = personas(default_contract().personas)["data_analyst"]
    rows = _texts(WS)
    other = lambda theme: [(100 + k, WS, "late price", "ASIA", theme, "r", "t", k, "crm") for k in range(5)]
    ask = lambda more: corroborations([_hyp()], {"H": 0}, WS, WE, who, spark.createDataFrame(rows + more, TEXTS))["H"]
    assert ask(other("price_objection"))["verdict"] == "contested" and ask(other("price_objection"))["conflicting_themes"] == ["price_objection"]
    assert ask(other("packaging"))["corroborated"] and ask(other("routine"))["conflicting"] == 0


def test_withheld_texts_are_counted_by_reason(spark):
    who = personas(default_contract().personas)["regional_manager"]
    rows = _texts(WS, n=3) + [(50 + k, WS, "late again", "EUROPE", "service_failure", "r", "t", k, "crm") for k in range(4)]
    got = corroborations([_hyp()], {"H": 0}, WS, WE, who, spark.createDataFrame(rows, TEXTS))["H"]
    assert got["on_theme"] == 3 and got["withheld"] == {"row": 4}


def test_retrieval_equals_a_plain_version(spark):
    words = ["late", "delay", "store", "price", "the", "offer", "dispatch"]
    docs = [(k, WS + timedelta(days=k % 15), " ".join(words[(k * j) % 7] for j in range(k % 9)) if k % 11 else None, ("ASIA", "EUROPE", None)[k % 3]) for k in range(120)]
    asks = [("a", WS, WE, ["late", "price", "late"], None), ("b", WS, WS + timedelta(days=3), ["store"], [["region=ASIA"]]), ("c", WS, WE, ["offer", "delay"], [["region=ASIA", "region=EUROPE"]]), ("none", WE, WS, ["late"], None), ("unknown", WS, WE, ["zzz"], None)]
    index = postings.build(spark.createDataFrame(docs, "doc_id long, day date, text string, region string"), ("region",))
    got = {(r["ask"], r["doc_id"]): r["score"] for r in postings.retrieve(index, spark.createDataFrame(asks, "ask string, lo date, hi date, terms array<string>, scope array<array<string>>")).collect()}
    want = {}
    for ask, lo, hi, terms, scope in asks:
        inside = [(i, [w for w in (t or "").split() if w not in STOP_WORDS and len(w) > 2]) for i, d, t, r in docs if lo <= d <= hi and (scope is None or f"region={r}" in scope[0])]
        mean = sum(len(w) for _, w in inside) / max(1, len(inside)) or 1.0
        for i, ws in inside:
            s = 0.0
            for t in terms:
                tf, df = Counter(ws)[t], sum(t in w for _, w in inside)
                if tf:
                    s += math.log(1 + (len(inside) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * max(1, len(ws)) / mean))
            if s > 0:
                want[ask, i] = s
    assert want and got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_index_is_appended_and_opened(spark, tmp_path):
    rows = lambda lo, hi: spark.createDataFrame([(k, WS, "late store", "ASIA") for k in range(lo, hi)], "doc_id long, day date, text string, region string")
    for part in (rows(0, 3), rows(3, 5)):
        postings.save(postings.build(part, ("region",)), "ix", f"file://{tmp_path}")
    index = postings.opened(spark, "ix", ("region",), f"file://{tmp_path}")
    assert index.documents.count() == 5 and index.postings.where("term = 'late'").count() == 5
    empty = postings.build(rows(0, 1).limit(0), ("region",))
    asks = spark.createDataFrame([("a", WS, WE, ["late"], None)], "ask string, lo date, hi date, terms array<string>, scope array<array<string>>")
    assert postings.retrieve(empty, asks).count() == 0


def test_interval_join_equals_all_pairs(spark):
    d = lambda k: date(2000, 1, 1) + timedelta(days=k)
    ev = [(k, "competitor_promo", d(k * 7 % 90), d(k * 7 % 90 + k * 5 % 40 - 1), ("ASIA", "EUROPE")[k % 2], "c") for k in range(60)] + [(99, "x", None, d(3), "ASIA", "c")]
    win = [(f"w{k}", d(k * 11), d(k * 11 + k), (None, "ASIA", "EUROPE")[k % 3]) for k in range(9)]
    got = sorted((r["event_id"], r["window"]) for r in cohorts.touching(spark.createDataFrame(ev, "event_id long, event_type string, start_date date, end_date date, region string, channel string"), spark.createDataFrame(win, "window string, ws date, we date, region string")).collect())
    want = sorted((e[0], w[0]) for e in ev for w in win if e[2] and e[2] <= e[3] and e[2] <= w[2] and e[3] >= w[1] - timedelta(days=14) and w[3] in (None, e[4]))
    assert got == want


def test_every_competitor_event_counts_and_no_other(spark):
    ev = [(k, "competitor_promo" if k % 2 else "holiday", WS - timedelta(days=k), WS, ("ASIA", "EUROPE")[k % 4 // 2], "Direct") for k in range(100)]
    events = spark.createDataFrame(ev, "event_id long, event_type string, start_date date, end_date date, region string, channel string")
    assert len(market_events(events, WS, WE)) == 50
    assert {e["region"] for e in market_events(events, WS, WE, "ASIA")} == {"ASIA"} and len(market_events(events, WS, WE, "ASIA")) == 25


def test_batched_counterfactuals_equal_single_ones_in_one_scan(spark, small):
    fact = catalogue._fact(spark, small)
    shops = sorted(r[0] for r in fact.select("warehouse_id").distinct().collect())
    hyps = [{"id": f"{w}@{k}", "ws": catalogue.WS + timedelta(days=k), "we": catalogue.WE + timedelta(days=k), "exposure": {"warehouse_id": w}} for w in shops for k in (0, 40)]
    series = cohorts.cohort_series(fact, cohorts.cohort_rows(spark, hyps, {"warehouse_id": shops}), ("warehouse_id",))
    batched = cohorts.counterfactuals(series)
    assert batched._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    got = {r["hyp"]: r for r in batched.collect()}
    for h in hyps:
        one = causal.difference_in_differences(fact, F.col("warehouse_id") == h["exposure"]["warehouse_id"], h["ws"], h["we"]).first()
        for c in ("enough", "n1", "n0", "parallel"):
            assert got[h["id"]][c] == one[c]
        for c in ("did", "se", "t_stat", "placebo", "attributable"):
            assert got[h["id"]][c] == (one[c] if one[c] is None else pytest.approx(one[c], rel=1e-6, abs=1e-9))


def test_onsets_of_price_and_rate(spark):
    days = [WS + timedelta(days=k) for k in range(-45, 10)]
    rows = [("up", d, 100.0 if d < WS - timedelta(days=5) else 130.0) for d in days] + [("flat", d, 100.0) for d in days] + [("few", d, 100.0) for d in days[:10]]
    asks = spark.createDataFrame([(s, s, WS, WE) for s in ("up", "flat", "few", "absent")], "ask string, slice string, ws date, we date")
    got = {r["ask"]: r["onset"] for r in cohorts.onsets(spark.createDataFrame(rows, "slice string, d date, v double"), asks, factor=1.02).collect()}
    assert got == {"up": WS - timedelta(days=5), "flat": None, "few": None, "absent": None}
    low = [("up", d, 0.9 if d < WS - timedelta(days=8) else 0.4) for d in days]
    got = {r["ask"]: r["onset"] for r in cohorts.onsets(spark.createDataFrame(low, "slice string, d date, v double"), asks, shift=0.10, lookback=60).collect()}
    assert got["up"] == WS - timedelta(days=7) and got["flat"] is None


def test_closure_of_a_ratio_and_of_null_members(spark):
    rows = [(date(2000, 2, 20), "A", None, 1, 10.0, 2.0), (WS, "A", "x", 2, 30.0, 3.0), (WS, "A", "y", 3, 50.0, 1.0), (WS, "B", "z", 4, 8.0, 4.0)]
    fact = spark.createDataFrame(rows, "order_date date, region string, city string, account_id long, gross_revenue double, units double").withColumn("discount_amount", F.lit(0.0))
    asp = default_contract().metric("asp")
    got = {(r["level"], r["region"], r["city"], r["account_id"]): r for r in hierarchy.closure(fact, asp, ("region", "city", "account_id"), WS, WE).collect()}
    assert got["all", None, None, None]["current"] == pytest.approx(88 / 8) and got["region", "A", None, None]["current"] == pytest.approx(80 / 4)
    assert all(r["closes"] for r in got.values()) and got["city", "A", None, None]["expected"] == pytest.approx(5.0) and len(got) == 1 + 2 + 4 + 4
    assert RIVALS
