"""Years of past episodes on one estate: a plan of overlapping effects, composed on its order lines.

plan() lays out slots of days for every region and draws what is planted in each, before any data is
changed; compose() applies all effects to all lines in one pass, where those that overlap multiply;
calendar(), texts() and targets() make the market events, evidence and plan figures that go with them.
Every draw is a hash of the seed and its keys, so nothing depends on how rows are partitioned, and the
base may be a generated estate (history()) or any given one.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.operators.retrieval import RIVALS, THEMES
from gaugeworks.sources.estate import dispatch, fact
from gaugeworks.sources.generate import generate, write_estate
from gaugeworks.sources.store import numbered, stored

#: Days of a slot, of history before the first one, and by how many at most a slot's start moves.
SLOT, WARMUP, JITTER = 28, 95, 4
#: Shares: of slots that get a driver, of these that get a second one, of drivers with texts that get rival ones, of routine texts a day.
PLANTED, SECOND, CONTESTED, ROUTINE = 0.62, 0.16, 0.17, 6
#: Of each driver: its weight, first and last day of the effect, first and last day of the window, bounds of its strength
#: and of a second value, bounds of its number of texts, and the metric it shows in.
KINDS = {
    "service_failure": (0.28, 0, 27, 14, 27, 0.50, 0.85, 0.35, 0.80, 3, 9, "net_revenue"),
    "external_market": (0.24, 3, 20, 7, 20, 0.45, 0.90, 0.00, 0.00, 2, 8, "order_volume"),
    "price_change": (0.20, 3, 27, 7, 20, 0.05, 0.20, 0.45, 1.10, 1, 6, "order_volume"),
    "mix_shift": (0.18, 3, 27, 7, 20, 0.10, 0.35, 0.00, 0.00, 0, 4, "net_revenue"),
    "instrumentation": (0.10, 6, 20, 10, 20, 0.90, 0.90, 0.00, 0.00, 0, 0, "net_revenue"),
}
#: The days after a service failure's start from which its accounts order less, over which this grows, and for which it outlasts the failure.
LAG, RAMP, AFTER = 10, 6, 14
#: The tier that a shift goes to, and the share of a line's price that is left there.
CHEAP, CHEAPER = "R", 0.5


def draw(seed: int, what: str, *keys: str | Column) -> Column:
    """A number from 0 to 1 (exclusive) for each purpose and key: the first 32 bits of an MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), F.lit(what), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def _of(kind: Column, k: int) -> Column:
    """A kind's k-th value of KINDS."""
    out = F.lit(None)
    for name, values in KINDS.items():
        out = F.when(kind == name, F.lit(values[k])).otherwise(out)
    return out


def _near(x: Column, parts: int) -> Column:
    """The nearest multiple of 1 / parts."""
    return F.floor(x * parts + 0.5) / float(parts)


def lines_of(tables: dict[str, DataFrame]) -> DataFrame:
    """The lines of an estate with what effects are told apart by: order_id, line_no, order_date, account_id,
    region, channel, category, tier, warehouse_id, units, price, on_time, ship_date."""
    lines, orders = tables["lineitem"], tables["orders"].select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("order_date"), F.col("o_orderpriority").alias("channel"))
    where = tables["nation"].join(tables["region"], F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("region"))
    people = tables["customer"].select("c_custkey", "c_nationkey").join(where, F.col("c_nationkey") == F.col("n_nationkey"))
    # orders find their region first: lines, the widest and longest side, are dealt out by order and by part only
    orders = orders.join(people, F.col("o_custkey") == F.col("c_custkey"))
    j = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(tables["part"].select("p_partkey", F.col("p_type").alias("category")), F.col("l_partkey") == F.col("p_partkey"))
    return j.select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_no"), "order_date", F.col("o_custkey").alias("account_id"), "region", "channel", "category", F.col("l_returnflag").alias("tier"),
        F.concat(F.lit("WH-"), F.col("l_suppkey") % 4 + 1).alias("warehouse_id"), F.col("l_quantity").cast("double").alias("units"), F.col("l_extendedprice").alias("price"), (F.col("l_linestatus") == "O").alias("on_time"), F.to_date("l_shipdate").alias("ship_date"),
    )


def plan(lines: DataFrame, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(episodes, effects) over the days and regions of some lines.

    episodes: episode_id, metric, ws, we, dim, value (as replay.replay_all takes them), null_episode. effects:
    episode_id, driver, kind, region, entity (warehouse, channel, category or tier), start, end, strength, second
    (the on-time rate of a service failure, a price's elasticity), docs, contested. A slot that would end after
    the last day is left out, so a span of fewer than WARMUP + SLOT days plans nothing. Lines without region or
    day take no part. The plan grows with regions and days, never with lines, of which it
    is one aggregate: a row a region, stored when the plan is built (which runs that job)."""
    members = lambda c: F.array_sort(F.collect_set(c)).alias(c)
    slices = lines.where("region IS NOT NULL AND order_date IS NOT NULL").groupBy("region").agg(F.min("order_date").alias("lo"), F.max("order_date").alias("hi"), members("warehouse_id"), members("channel"), members("category"))
    slices = stored(slices, "past-slices")
    span = slices.agg(F.min("lo").alias("first"), F.max("hi").alias("last"))
    n = F.floor((F.datediff("last", "first") - WARMUP - SLOT - JITTER + 1) / SLOT).cast("int")
    slots = slices.join(F.broadcast(span)).withColumn("slot", F.explode(F.when(n >= 1, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))))
    d = lambda what: draw(seed, what, "region", "slot")
    slots = slots.withColumn("t", F.date_add("first", F.lit(WARMUP) + SLOT * F.col("slot") + F.floor(d("start") * JITTER).cast("int"))).withColumn("episode_id", F.concat_ws("-", F.lit("EP"), "region", F.lpad(F.col("slot").cast("string"), 4, "0")))
    up_to = accumulate(values[0] for values in KINDS.values())
    kind = F.coalesce(*[F.when(d("kind") < round(x, 6), k) for k, x in zip(KINDS, up_to, strict=True)])
    slots = slots.withColumn("kind", F.when(d("planted") < PLANTED, kind))
    others = F.filter(F.array(*[F.lit(k) for k in KINDS if k != "instrumentation"]), lambda k: k != F.col("kind"))
    slots = slots.withColumn("kinds", F.when(F.col("kind").isNull(), F.array().cast("array<string>")).when(d("second") < SECOND, F.array(F.col("kind"), F.get(others, F.floor(d("other") * F.size(others)).cast("int")))).otherwise(F.array("kind")))
    day = lambda k, null: F.date_add("t", F.coalesce(_of(F.col("kind"), k), F.lit(null)).cast("int"))
    metric = F.coalesce(_of(F.col("kind"), 11), F.when(d("metric") < 0.5, "net_revenue").otherwise("order_volume"))
    episodes = slots.select("episode_id", metric.alias("metric"), day(3, 7).alias("ws"), day(4, 20).alias("we"), F.lit("region").alias("dim"), F.col("region").alias("value"), F.col("kind").isNull().alias("null_episode"))

    each = slots.select("episode_id", "region", "slot", "t", "warehouse_id", "channel", "category", F.posexplode("kinds").alias("driver", "kind"))
    e = lambda what: draw(seed, what, "region", "slot", "driver")
    one = lambda c: F.get(c, F.floor(e("entity") * F.size(c)).cast("int"))
    entity = F.when(F.col("kind").isin("service_failure", "instrumentation"), one("warehouse_id")).when(F.col("kind") == "external_market", one("channel")).when(F.col("kind") == "price_change", one("category")).otherwise(F.lit(CHEAP))
    between = lambda what, k: _of(F.col("kind"), k) + e(what) * (_of(F.col("kind"), k + 1) - _of(F.col("kind"), k))
    docs = (_of(F.col("kind"), 9) + F.floor(e("docs") * (_of(F.col("kind"), 10) - _of(F.col("kind"), 9) + 1))).cast("int")
    effects = each.select("episode_id", "driver", "kind", "region", entity.alias("entity"), day(1, 0).alias("start"), day(2, 0).alias("end"), _near(between("strength", 5), 1000).alias("strength"), _near(between("second value", 7), 1000).alias("second"), docs.alias("docs"))
    return episodes, effects.withColumn("contested", (F.col("docs") > 0) & (draw(seed, "contested", "episode_id", "driver") < CONTESTED))


def compose(lines: DataFrame, effects: DataFrame, seed: int = 7) -> DataFrame:
    """The lines as they would be under all effects: `kept` false where a line is not ordered or not loaded, and
    tier, units, price, on_time and ship_date changed. All input columns stay, with nulls as they were.

    A day's effects come with the line by one join by day: a table of as many rows as days, each with the few
    effects of its regions. Effects of one kind multiply, those of several kinds follow one another."""
    reach = F.when(F.col("kind") == "service_failure", AFTER).otherwise(0)
    days = effects.withColumn("order_date", F.explode(F.sequence("start", F.date_add("end", reach)))).withColumn("since", F.datediff("order_date", "start"))
    active = days.groupBy("order_date").agg(F.sort_array(F.collect_list(F.struct("episode_id", "driver", "kind", "region", "entity", "strength", "second", "since", (F.col("order_date") <= F.col("end")).alias("on")))).alias("_fx"))
    # by the calendar it stays small whatever the lines, so these are not dealt out by day
    rows = lines.join(F.broadcast(active), "order_date", "left")
    hit = lambda kind, test: F.filter("_fx", lambda e: (e.kind == kind) & test(e))
    times = lambda found, of: F.coalesce(F.aggregate(found, F.lit(1.0), lambda acc, e: acc * of(e)), F.lit(1.0))
    here = lambda e: e.region == F.col("region")
    shop, ramp = (lambda e: e.entity == F.col("warehouse_id")), (lambda e: F.least(F.lit(1.0), F.greatest(F.lit(0.0), (e.since - LAG) / float(RAMP))))
    volume = times(hit("external_market", lambda e: here(e) & (e.entity == F.col("channel"))), lambda e: e.strength)
    health = times(hit("service_failure", lambda e: here(e) & shop(e)), lambda e: 1 - (1 - e.strength) * ramp(e))
    # a failing warehouse is late for every region, and of lines already late none gets earlier
    rate = times(hit("service_failure", lambda e: shop(e) & e.on), lambda e: e.second)
    mine = lambda e: here(e) & (e.entity == F.col("category"))
    dearer = times(hit("price_change", mine), lambda e: 1 + e.strength)
    fewer = times(hit("price_change", lambda e: mine(e) & (e.since >= 2)), lambda e: F.greatest(F.lit(0.55), 1 - e.strength * e.second * 4))
    stays = times(hit("mix_shift", here), lambda e: 1 - e.strength)
    loads = times(hit("instrumentation", lambda e: here(e) & shop(e)), lambda e: 1 - e.strength)
    rows = rows.select(*[F.col(c) for c in lines.columns], volume.alias("_volume"), health.alias("_health"), rate.alias("_rate"), dearer.alias("_dearer"), fewer.alias("_fewer"), stays.alias("_stays"), loads.alias("_loads"))
    line = lambda what: draw(seed, what, "order_id", "line_no")
    late = F.coalesce(F.col("on_time"), F.lit(False)) & (line("late") >= F.col("_rate"))
    moved = F.coalesce(F.col("tier") != CHEAP, F.lit(False)) & (line("tier") >= F.col("_stays"))
    units = F.when(F.col("_fewer") < 1, F.greatest(F.lit(1.0), _near(F.col("units") * F.col("_fewer"), 1))).otherwise(F.col("units"))
    # an order is placed or not as one; what a warehouse loses is lost for all lines of the order that it ships
    ordered = (draw(seed, "market", "order_id") < F.col("_volume")) & (draw(seed, "health", "order_id", "warehouse_id") < F.col("_health"))
    lost = (~F.coalesce(F.col("on_time"), F.lit(True)) | late) & (line("load") >= F.col("_loads"))
    changed = {
        "tier": F.when(moved, CHEAP).otherwise(F.col("tier")), "units": units, "on_time": F.when(late, False).otherwise(F.col("on_time")), "ship_date": F.when(late, F.date_add("ship_date", 4)).otherwise(F.col("ship_date")),
        "price": F.when(moved | (F.col("_dearer") != 1) | (F.col("_fewer") < 1), _near(F.col("price") * F.coalesce(F.try_divide(units, F.col("units")), F.lit(1.0)) * F.col("_dearer") * F.when(moved, CHEAPER).otherwise(1.0), 100)).otherwise(F.col("price")),
    }
    return rows.select(*[changed.get(c, F.col(c)).alias(c) for c in lines.columns], (ordered & ~lost).alias("kept"))


def composed_tables(tables: dict[str, DataFrame], effects: DataFrame, seed: int = 7) -> dict[str, DataFrame]:
    """The estate's tables under the effects: only lineitem differs. A line without order, account or part is in no
    view of the estate, and goes."""
    old = tables["lineitem"]
    new = compose(lines_of(tables), effects, seed).where("kept").select(F.col("order_id").alias("l_orderkey"), F.col("line_no").alias("l_linenumber"), *[F.col(c).alias(f"_{c}") for c in ("tier", "units", "price", "on_time", "ship_date")])
    own = {
        "l_returnflag": F.col("_tier"), "l_quantity": F.col("_units").cast(old.schema["l_quantity"].dataType), "l_extendedprice": F.col("_price"),
        "l_linestatus": F.when(F.col("_on_time"), "O").when(~F.col("_on_time"), "F").otherwise(F.col("l_linestatus")), "l_shipdate": F.col("_ship_date").cast(old.schema["l_shipdate"].dataType),
    }
    joined = old.join(new, ["l_orderkey", "l_linenumber"])
    return tables | {"lineitem": joined.select(*[own.get(c, F.col(c)).alias(c) for c in old.columns])}


def calendar(effects: DataFrame, seed: int = 7) -> DataFrame:
    """event_id, event_type, start_date, end_date, region, channel, intensity: every planted promotion, and one for each
    third of them that changed nothing, half a slot earlier: a calendar of events that all bite would teach that an
    event is a cause."""
    real = effects.where("kind = 'external_market'")
    event = lambda df, id_, lo, hi, force: df.select(id_.alias("event_id"), F.lit("competitor_promo").alias("event_type"), lo.alias("start_date"), hi.alias("end_date"), "region", F.col("entity").alias("channel"), F.round(force, 2).alias("intensity"))
    d = lambda what: draw(seed, what, "episode_id", "driver")
    name = F.concat_ws("-", "episode_id", F.col("driver").cast("string"))
    back = lambda c: F.date_sub(c, F.lit(SLOT // 2) + F.floor(d("decoy day") * SLOT).cast("int"))
    decoys = real.where(d("decoy") < 1 / 3)
    return event(real, F.concat(F.lit("MK-"), name), F.col("start"), F.col("end"), 1 - F.col("strength")).unionByName(event(decoys, F.concat(F.lit("MD-"), name), back(F.col("start")), back(F.col("end")), 0.1 + 0.25 * d("decoy force")))


def truth(effects: DataFrame) -> DataFrame:
    """episode_id, driver_type, entity (the candidate that names it, where one does): what ranker.label takes."""
    name = F.concat(F.lit("H-EVENT-MK-"), "episode_id", F.lit("-"), F.col("driver").cast("string"))
    entity = F.when(F.col("kind") == "service_failure", F.concat(F.lit("H-SLA-"), "entity")).when(F.col("kind") == "external_market", name)
    return effects.select("episode_id", F.col("kind").alias("driver_type"), entity.alias("entity"))


def texts(effects: DataFrame, accounts: DataFrame, seed: int = 7, span: tuple | None = None) -> DataFrame:
    """doc_id, day, text, theme, author_role, type, account_id, region, warehouse_id, domain, episode_id: the reports that
    go with the effects. accounts: account_id, region, warehouse_id (a main one).

    A driver has `docs` reports on its theme within 19 days of its start, from accounts of its region (of its
    warehouse's there, if it has one); a contested one has up to half as many again, and one, on a rival theme, which name the driver's own as well (a search for it finds them). Over span
    (first and last day) come ROUTINE texts a day on no theme. An effect without such accounts has no reports."""
    themes = {k: THEMES[k] for k in KINDS if k in THEMES}
    words = {theme: w for theme, w in reversed(list(themes.values()))}
    pick = lambda what, values, *keys: F.get(F.array(*map(F.lit, values)), F.floor(draw(seed, what, *keys) * len(values)).cast("int"))
    own = F.lit(None).cast("string")
    for k, (theme, _) in themes.items():
        own = F.when(F.col("kind") == k, theme).otherwise(own)
    key = ("episode_id", "driver", "rival", "n")
    rivals = F.filter(F.array(*map(F.lit, RIVALS)), lambda t: t != F.col("own"))
    told = effects.withColumn("own", own).where("own IS NOT NULL AND docs > 0")
    more = F.when(F.col("contested"), 1 + F.floor(draw(seed, "rivals", "episode_id", "driver") * (F.floor(F.col("docs") / 2) + 1)).cast("int")).otherwise(0)
    told = told.withColumn("m", F.explode(F.concat(F.transform(F.sequence(F.lit(1), F.col("docs")), lambda n: F.struct(n.alias("n"), F.lit(False).alias("rival"))), F.transform(F.when(more > 0, F.sequence(F.lit(1), more)).otherwise(F.array().cast("array<int>")), lambda n: F.struct(n.alias("n"), F.lit(True).alias("rival"))))))
    told = told.select("episode_id", "driver", "kind", "region", "entity", "start", "own", "m.n", "m.rival").withColumn("theme", F.when(F.col("rival"), F.get(rivals, F.floor(draw(seed, "rival", "episode_id", "driver") * F.size(rivals)).cast("int"))).otherwise(F.col("own")))
    word = lambda which, of: F.coalesce(*[F.when(F.col(of) == t, pick(which, w, *key)) for t, w in words.items()])
    told = told.withColumn("day", F.date_add("start", F.floor(draw(seed, "day", *key) * 19).cast("int"))).withColumn("text", F.concat_ws(" ", F.when(F.col("rival"), F.concat(F.lit("asked about "), word("w0", "own"))), F.lit("account says"), word("w1", "theme"), F.lit("and"), word("w2", "theme"), F.lit("again")))
    # accounts are numbered within region and warehouse; a report draws a number, so the two meet by equality
    pool = accounts.where("region IS NOT NULL AND warehouse_id IS NOT NULL").select("account_id", "region", "warehouse_id")
    # over ranges: the few regions and warehouses would be as few tasks
    pool = numbered(pool, ["region", "warehouse_id", "account_id"])
    sizes = pool.groupBy("region", "warehouse_id").agg(F.count(F.lit(1)).alias("_size"), F.min("before").alias("_first"))
    pool = pool.join(F.broadcast(sizes.drop("_size")), ["region", "warehouse_id"]).withColumn("_k", F.col("before") - F.col("_first")).drop("before", "_first")
    sizes = sizes.drop("_first")
    shops = sizes.groupBy("region").agg(F.array_sort(F.collect_list("warehouse_id")).alias("_shops"))
    at = F.when(F.col("kind") == "service_failure", F.col("entity")).otherwise(F.get("_shops", F.floor(draw(seed, "shop", *key) * F.size("_shops")).cast("int")))
    said = ("doc_id", "day", "text", "theme", "region", "warehouse_id", "episode_id")
    told = told.join(shops, "region").withColumn("warehouse_id", at).withColumn("doc_id", F.concat_ws("-", F.lit("IN"), "episode_id", F.col("driver").cast("string"), F.when(F.col("rival"), "r").otherwise("o"), F.col("n").cast("string"))).select(*said)
    if span is not None:
        # all pairs of a region and a warehouse: the members of two dimensions
        cells = sizes.agg(F.array_sort(F.collect_list(F.struct("region", "warehouse_id"))).alias("_cells"))
        noise = accounts.sparkSession.range(((span[1] - span[0]).days + 1) * ROUTINE).join(F.broadcast(cells)).withColumn("_c", F.get("_cells", F.floor(draw(seed, "cell", "id") * F.size("_cells")).cast("int")))
        told = told.unionByName(noise.select(F.concat(F.lit("IN-"), F.col("id").cast("string")).alias("doc_id"), F.date_add(F.lit(span[0]), F.floor(F.col("id") / ROUTINE).cast("int")).alias("day"), F.concat(F.lit("regular visit, asked about the "), pick("w3", ("invoice", "catalogue", "contact", "schedule"), "id")).alias("text"), F.lit("routine").alias("theme"), "_c.region", "_c.warehouse_id", F.lit(None).cast("string").alias("episode_id")))
    told = told.join(sizes, ["region", "warehouse_id"]).withColumn("_k", F.floor(draw(seed, "who", "doc_id") * F.col("_size")).cast("int")).join(pool, ["region", "warehouse_id", "_k"]).drop("_k", "_size")
    return told.select("*", pick("role", ("field_sales", "service_desk", "key_account_manager"), "doc_id").alias("author_role"), pick("type", ("ticket", "call_transcript", "field_note", "email"), "doc_id").alias("type"), F.lit("crm").alias("domain"))


def targets(lines: DataFrame, uplift: float = 1.04) -> DataFrame:
    """region, year, month, days_in_month, plan_net_revenue: a region's mean day of sales times the month's days, and a
    little more. Days are those with sales."""
    daily = lines.where("region IS NOT NULL AND order_date IS NOT NULL").groupBy("region", "order_date").agg(F.sum("price").alias("v"))
    mean = daily.groupBy("region").agg(F.avg("v").alias("mean"), F.min("order_date").alias("lo"), F.max("order_date").alias("hi"))
    months = mean.withColumn("m", F.explode(F.sequence(F.trunc("lo", "month"), F.trunc("hi", "month"), F.expr("INTERVAL 1 MONTH"))))
    days = F.dayofmonth(F.last_day("m"))
    return months.select("region", F.year("m").alias("year"), F.month("m").alias("month"), days.alias("days_in_month"), F.round(F.col("mean") * days * uplift, 2).alias("plan_net_revenue"))


def history(spark: SparkSession, folder: str, years: int = 3, seed: int = 7, per_day: int = 160, accounts: int = 320) -> dict[str, DataFrame]:
    """A generated estate of some years with its planned past, written under folder: the estate's tables, and `episodes`,
    `effects`, `market`, `interactions` and `targets`. Returns these with the composed `fact` and `ships`."""
    base, _ = generate(spark, "none", seed, days=365 * years, per_day=per_day, accounts=accounts)
    write_estate(base, f"{folder}/base")
    read = lambda part, name: spark.read.parquet(f"{folder}/{part}/{name}.parquet")
    before = {n: read("base", n) for n in base}
    lines = lines_of(before)
    episodes, effects = plan(lines, seed)
    write_estate({"episodes": episodes, "effects": effects}, f"{folder}/past")
    episodes, effects = read("past", "episodes"), read("past", "effects")
    write_estate(composed_tables(before, effects, seed), f"{folder}/estate")
    after = lines_of(before | {"lineitem": read("estate", "lineitem")})
    ends = lines.agg(F.min("order_date").alias("a"), F.max("order_date").alias("z")).first()
    people = lines.groupBy("account_id").agg(F.min("region").alias("region"), F.min("warehouse_id").alias("warehouse_id"))
    write_estate({"market": calendar(effects, seed), "interactions": texts(effects, people, seed, (ends["a"], ends["z"])), "targets": targets(after)}, f"{folder}/past")
    return {"episodes": episodes, "effects": effects, "fact": fact(spark, f"{folder}/estate"), "ships": dispatch(spark, f"{folder}/estate")} | {n: read("past", n) for n in ("market", "interactions", "targets")}
