"""Seeded estates with a planted cause, for recovery tests and for the ranker's training episodes.

Every value comes from a hash of the seed and a row's number, so tables are made on the executors and
are the same however they are partitioned.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What may be planted, and the type of driver that an investigation should find.
SCENARIOS = {"service_failure": "service_failure", "competitor_promo": "external_market", "price_change": "price_change", "mix_shift": "mix_shift", "partial_load": "instrumentation", "none": None}
WEEKDAY = (1.0, 0.95, 0.9, 0.95, 1.0, 0.7, 0.5)
NATIONS = 8


def _unit(seed: int, what: str, *keys: str) -> Column:
    """A number from 0 to 1 for each row and purpose."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(what), *keys), F.lit(1_000_000)) / 1e6


def generate(spark: SparkSession, scenario: str, seed: int = 7, days: int = 330, per_day: int = 160, accounts: int = 320, first: date = date(2000, 1, 1), window: int = 14) -> tuple[dict[str, DataFrame], dict]:
    """The tables that the fact and dispatch views read, and the episode: window, drivers, filters.

    The last `window` days of `days` are the window that an investigation looks at (a few more follow).
    service_failure: shipments of warehouse 3 run late from three weeks before it, and its accounts order
    less from two weeks before it; competitor_promo: one region orders less while a promotion runs;
    price_change: all prices rise and units fall; mix_shift: cheap tiers take over; partial_load: most
    late shipments of warehouse 4 are missing at the end."""
    if scenario not in SCENARIOS:
        raise ValueError(f"a scenario is one of {', '.join(SCENARIOS)}")
    ws = days - window
    day, cust = F.col("day"), F.col("o_custkey")
    rows = spark.range((days + 7) * per_day).select((F.col("id") + 1).alias("o_orderkey"), F.floor(F.col("id") / per_day).cast("int").alias("day"))
    rows = rows.withColumn("o_custkey", F.floor(_unit(seed, "account", "o_orderkey") * accounts).cast("long") + 1)
    rows = rows.withColumn("date", F.date_add(F.lit(first), day))
    busy = F.get(F.array(*map(F.lit, WEEKDAY)), F.weekday("date"))
    less = F.lit(1.0)
    if scenario == "service_failure":
        less = F.when((cust % 4 == 2) & (day >= ws - 3), 0.45).otherwise(1.0)
    elif scenario == "competitor_promo":
        less = F.when((cust % NATIONS < 2) & (day >= ws), 0.5).otherwise(1.0)
    elif scenario == "price_change":
        less = F.when(day >= ws, 0.7).otherwise(1.0)
    rows = rows.where(_unit(seed, "open", "o_orderkey") < busy * less)
    orders = rows.select(
        "o_orderkey", "o_custkey", F.lit("O").alias("o_orderstatus"), F.lit(0.0).alias("o_totalprice"), F.col("date").cast("timestamp_ntz").alias("o_orderdate"),
        F.get(F.array(*map(F.lit, ("1-URGENT", "2-HIGH", "3-MEDIUM"))), F.floor(_unit(seed, "channel", "o_orderkey") * 3).cast("int")).alias("o_orderpriority"),
    )
    lines = rows.withColumn("l_linenumber", F.explode(F.sequence(F.lit(1), 1 + F.floor(_unit(seed, "lines", "o_orderkey") * 3).cast("int"))))
    draw = lambda what: _unit(seed, what, "o_orderkey", "l_linenumber")
    cheap = F.when(day >= ws, 0.75).otherwise(0.25) if scenario == "mix_shift" else F.lit(0.25)
    tier = F.when(draw("tier") < cheap, "R").when(draw("tier") < cheap + (1 - cheap) / 2, "N").otherwise("A")
    price = F.when(tier == "R", 40.0).when(tier == "N", 70.0).otherwise(100.0) * (F.when(day >= ws, 1.3).otherwise(1.0) if scenario == "price_change" else 1.0)
    quantity = 1 + F.floor(draw("units") * 20)
    late = draw("late") < (F.when((cust % 4 == 2) & (day >= ws - 21), 0.65).otherwise(0.08) if scenario == "service_failure" else 0.12)
    lines = lines.select(
        F.col("o_orderkey").alias("l_orderkey"), (1 + F.floor(draw("part") * 50)).cast("long").alias("l_partkey"), (cust % 4 + 4 * F.floor(draw("supplier") * 5)).cast("long").alias("l_suppkey"), F.col("l_linenumber").cast("int").alias("l_linenumber"),
        quantity.cast("double").alias("l_quantity"), F.round(quantity * price, 2).alias("l_extendedprice"), F.round(draw("discount") * 0.1, 2).alias("l_discount"), F.round(draw("tax") * 0.08, 2).alias("l_tax"),
        tier.alias("l_returnflag"), F.when(late, "F").otherwise("O").alias("l_linestatus"), F.date_add("date", F.when(late, 6).otherwise(2)).cast("timestamp_ntz").alias("l_shipdate"), "day", cust.alias("_cust"),
    )
    if scenario == "partial_load":
        lost = (F.col("_cust") % 4 == 3) & (F.col("l_linestatus") == "F") & (day >= days - 16) & (_unit(seed, "lost", "l_orderkey", "l_linenumber") < 0.9)
        lines = lines.where(~lost)
    lines = lines.drop("day", "_cust")
    customer = spark.range(1, accounts + 1).select(F.col("id").alias("c_custkey"), F.concat(F.lit("Account "), F.col("id")).alias("c_name"), (F.col("id") % NATIONS).cast("int").alias("c_nationkey"), F.lit(1.0).alias("c_acctbal"), F.get(F.array(*map(F.lit, ("BUILDING", "MACHINERY", "FURNITURE"))), (F.col("id") % 3).cast("int")).alias("c_mktsegment"))
    tables = {
        "orders": orders, "lineitem": lines, "customer": customer,
        "nation": spark.range(NATIONS).select(F.col("id").cast("int").alias("n_nationkey"), F.concat(F.lit("CITY-"), F.col("id")).alias("n_name"), F.floor(F.col("id") / 2).cast("int").alias("n_regionkey")),
        "region": spark.createDataFrame([(0, "ASIA"), (1, "EUROPE"), (2, "AFRICA"), (3, "AMERICA")], "r_regionkey int, r_name string"),
        "part": spark.range(1, 51).select(F.col("id").alias("p_partkey"), F.concat(F.lit("TYPE-"), F.col("id") % 5).alias("p_type")),
    }
    a, z = first + timedelta(days=ws), first + timedelta(days=days - 1)
    kind = SCENARIOS[scenario]
    episode = {
        "episode_id": f"{scenario}-{seed}", "metric": "order_volume" if scenario in ("competitor_promo", "price_change") else "otd_pct" if scenario == "partial_load" else "net_revenue", "window": (str(a), str(z)),
        "filters": {"region": "ASIA"} if scenario == "competitor_promo" else {}, "drivers": [{"driver_type": kind, "entity": "H-SLA-WH-3" if scenario == "service_failure" else None}] if kind else [],
        "events": [("EV-1", a, z)] if scenario == "competitor_promo" else [],
    }
    return tables, episode


def evidence(spark: SparkSession, episode: dict, seed: int = 7, n: int = 400, accounts: int = 320) -> DataFrame:
    """Texts around an episode: most of them routine, a sixth on the theme of its driver, as reports of
    several roles and kinds from many accounts. doc_id, day, text, theme, author_role, type, account_id, domain."""
    from gaugeworks.operators.retrieval import THEMES

    kind = episode["drivers"][0]["driver_type"] if episode["drivers"] else None
    theme, words = THEMES.get(kind, ("routine", ["order"]))
    a, z = (date.fromisoformat(x) for x in episode["window"])
    pick = lambda what, values: F.get(F.array(*map(F.lit, values)), F.floor(_unit(seed, what, "id") * len(values)).cast("int"))
    on = _unit(seed, "theme", "id") < 1 / 6
    said = F.when(on, F.concat_ws(" ", F.lit("account says"), pick("w1", words), F.lit("and"), pick("w2", words), F.lit("again"))).otherwise(F.concat_ws(" ", F.lit("regular visit, asked about the"), pick("w3", ("invoice", "catalogue", "contact", "schedule"))))
    return spark.range(n).select(
        F.col("id").alias("doc_id"), F.date_add(F.lit(a), F.floor(_unit(seed, "day", "id") * ((z - a).days + 1)).cast("int")).alias("day"), said.alias("text"), F.when(on, theme).otherwise("routine").alias("theme"),
        pick("role", ("field_sales", "service_desk", "key_account_manager")).alias("author_role"), pick("type", ("ticket", "call_transcript", "field_note", "email")).alias("type"),
        F.floor(_unit(seed, "who", "id") * accounts).cast("long").alias("account_id"), F.lit("crm").alias("domain"),
    )


def write_estate(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def history(spark: SparkSession, folder: str, seeds: range, scenarios: tuple[str, ...] = tuple(SCENARIOS), **size) -> list[dict]:  # noqa: ANN003
    """One estate a seed under folder, scenarios in turn: past episodes to learn from."""
    episodes = []
    for seed in seeds:
        tables, episode = generate(spark, scenarios[seed % len(scenarios)], seed, **size)
        write_estate(tables, f"{folder}/{episode['episode_id']}")
        episodes.append(episode | {"folder": f"{folder}/{episode['episode_id']}"})
    return episodes
