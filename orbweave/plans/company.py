"""Queries of companies, graph, snapshots, fund, order statistics and text, each with its checking SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbweave.functions import text as T
from orbweave.functions.ids import squeeze
from orbweave.functions.scalars import relative_distance
from orbweave.operators import graph as G
from orbweave.operators import scoring as S
from orbweave.operators.detectors import agency_key, superseded
from orbweave.operators.quantiles import order_statistics, quartiles_exclusive
from orbweave.plans.analytics import _E, _PR, _UN, snapshots, universe
from orbweave.plans.detection import _AG, _SB
from orbweave.plans.policy import _PRIV, private
from orbweave.plans.registry import Registry
from orbweave.session import cut
from orbweave.sources import views as V
from orbweave.sources.tables import table

query = Registry()
_B = V.BASE_SQL

# order statistics
_VAL = _B + ", v AS (SELECT procurement_type AS g, contract_value::DOUBLE x FROM c WHERE contract_value > 0 AND procurement_type IS NOT NULL), l AS (SELECT g, list_sort(list(x)) l, count(*) n FROM v GROUP BY 1)"


def _values(spark: SparkSession, sf: str) -> DataFrame:
    return V.contracts(spark, sf).filter("contract_value > 0 AND procurement_type IS NOT NULL").select(F.col("procurement_type").alias("g"), F.col("contract_value").cast("double").alias("x"))


query("agg_upper_median", _VAL + " SELECT g, n::BIGINT AS n, l[n // 2 + 1] AS upper_median FROM l")(lambda s, d: order_statistics(_values(s, d), "g", "x", upper_median=F.floor(F.col("n") / 2) + 1))
query("agg_nearest_rank", _VAL + " SELECT g, n::BIGINT AS n, l[least(n, floor(n * 0.05::DOUBLE)::BIGINT + 1)] AS p5, l[least(n, floor(n * 0.95::DOUBLE)::BIGINT + 1)] AS p95 FROM l")(
    lambda s, d: order_statistics(_values(s, d), "g", "x", p5=F.least(F.col("n"), F.floor(F.col("n") * 0.05) + 1), p95=F.least(F.col("n"), F.floor(F.col("n") * 0.95) + 1)))
query("agg_quartiles_exclusive", _VAL + " SELECT g, n::BIGINT AS n, " + ", ".join(f"l[greatest(1, floor((n + 1) * {p} / 4)::BIGINT)] + ((n + 1) * {p} / 4 - floor((n + 1) * {p} / 4)) * (l[least(n, floor((n + 1) * {p} / 4)::BIGINT + 1)] - l[greatest(1, floor((n + 1) * {p} / 4)::BIGINT)]) AS q{p}" for p in (1, 2, 3)) + " FROM l WHERE n >= 4")(
    lambda s, d: quartiles_exclusive(_values(s, d), "g", "x").filter("n >= 4"))
query("agg_distinct_list", _B + f" SELECT entity_id, string_agg(DISTINCT {_AG}, ',' ORDER BY {_AG}) AS agencies FROM c WHERE entity_id IS NOT NULL AND trim(contracting_agency) <> '' GROUP BY 1")(
    lambda s, d: V.contracts(s, d).filter("entity_id IS NOT NULL AND trim(contracting_agency) <> ''").groupBy("entity_id").agg(F.array_join(F.array_sort(F.collect_set(agency_key(F.col("contracting_agency")))), ",").alias("agencies")))

# sorts
query("srt_nulls_last", _B + " SELECT id, award_date FROM c WHERE contract_value > 1000000 ORDER BY award_date ASC NULLS LAST, id LIMIT 500")(lambda s, d: V.contracts(s, d).filter("contract_value > 1000000").orderBy(F.asc_nulls_last("award_date"), "id").limit(500).select("id", "award_date"))
RANKING = (("p2_n", True), ("composite", True), ("entity_id", False))


@query("srt_configured", _UN + " SELECT entity_id, p2_n::BIGINT AS p2_n, composite FROM un ORDER BY p2_n DESC, composite DESC, entity_id LIMIT 25")
def _configured(spark: SparkSession, sf: str, by: tuple = RANKING) -> DataFrame:
    """The first of the universe by a configured list of columns and directions."""
    return universe(spark, sf).select("entity_id", "p2_n", "composite").orderBy(*[F.desc(c) if down else F.asc(c) for c, down in by]).limit(25)


@query("srt_breakdown", _B + " SELECT entity_id, string_agg(base_type, ',' ORDER BY abs(score) DESC, base_type) AS breakdown FROM (SELECT entity_id, base_type, max(confidence) score FROM s WHERE status = 'ACTIVE' AND entity_id IS NOT NULL AND base_type IS NOT NULL AND confidence IS NOT NULL GROUP BY 1, 2) GROUP BY 1")
def _breakdown(spark: SparkSession, sf: str) -> DataFrame:
    """An entity's signal types by the size of their score; as many as there are types."""
    s = V.signals(spark, sf).filter("status = 'ACTIVE' AND entity_id IS NOT NULL AND base_type IS NOT NULL AND confidence IS NOT NULL").groupBy("entity_id", "base_type").agg(F.max("confidence").alias("score"))
    return s.groupBy("entity_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.abs("score")).alias("k"), "base_type"))), lambda x: x["base_type"]), ",").alias("breakdown"))


# graph
query("grf_portfolios", _E + " SELECT target AS investor, count(*)::BIGINT AS companies, sum(total) AS total, max(last_seen) AS latest FROM ib GROUP BY 1")(
    lambda s, d: G.invested_in_by(s, d).groupBy(F.col("target").alias("investor")).agg(F.count("*").alias("companies"), F.sum("total").alias("total"), F.max("last_seen").alias("latest")))
query("grf_ego", _E + ", q AS (SELECT DISTINCT source FROM ed WHERE ('0x' || right(source, 2))::INT % 50 = 0 AND regexp_full_match(source, '[0-9a-f-]{36}')) SELECT source, count(*)::BIGINT AS edges, count(DISTINCT target)::BIGINT AS neighbours, sum(weight)::BIGINT AS weight FROM ed WHERE source IN (SELECT source FROM q) GROUP BY 1")(
    lambda s, d: _of_fiftieth(G.all_edges(s, d), "source").groupBy("source").agg(F.count("*").alias("edges"), F.count_distinct("target").alias("neighbours"), F.sum("weight").alias("weight")))


def _of_fiftieth(df: DataFrame, column: str) -> DataFrame:
    """The stated query set over text ids: those whose last byte is divisible by fifty."""
    return df.filter(F.col(column).rlike("^[0-9a-f-]{36}$") & (F.conv(F.right(F.col(column), F.lit(2)), 16, 10).cast("int") % 50 == 0))


def _peers_sql(edges: str) -> str:
    return _E + f", q AS (SELECT source, target FROM {edges} WHERE regexp_full_match(source, '[0-9a-f-]{{36}}') AND ('0x' || right(source, 2))::INT % 50 = 0) SELECT q.source AS a, x.source AS b, count(*)::BIGINT AS shared FROM q JOIN {edges} x ON q.target = x.target AND q.source <> x.source GROUP BY 1, 2"


def peers(edges: DataFrame, salts: int = 16, part: int = 4096, few: int = 32) -> DataFrame:
    """For the query sources all others that share a target, with the number shared.

    Sources with the same targets share the same with all others, so distinct sets of targets are matched, each target's list in salted parts.
    The pairs of sources, which are the rows of the result, are formed where they are handed on and never shuffled. What is shuffled before are
    pairs of sets and, for each, the query sources of the one, a few at a time, for every 4,096 or so sources of the other.
    """
    members = edges.groupBy("source").agg(F.array_sort(F.collect_list("target")).alias("targets"))
    sets = members.groupBy("targets").agg(F.ceil(F.count("*") / part).cast("int").alias("parts"))
    sets = cut(sets.withColumn("set", F.monotonically_increasing_id()))  # numbers hold once they are written
    placed = members.join(sets, "targets").select("source", "set", F.pmod(F.xxhash64("source"), F.col("parts")).cast("int").alias("part"))
    lists = _of_fiftieth(placed, "source").groupBy(F.col("set").alias("mine"), "part").agg(F.collect_list("source").alias("l"))
    lists = cut(lists.select("mine", F.explode(F.transform(F.sequence(F.lit(1), F.size("l"), F.lit(few)), lambda i: F.slice("l", i, few))).alias("list")))
    each = sets.select("set", "parts", F.explode("targets").alias("target"))
    mine = each.join(lists.select(F.col("mine").alias("set")).distinct(), "set").select(F.col("set").alias("mine"), "target", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    other = each.withColumn("salt", F.pmod(F.xxhash64("set"), F.lit(salts)).cast("int"))
    alike = mine.join(other, ["target", "salt"]).repartition("mine").groupBy("mine", "set", "parts").agg(F.count("*").alias("shared"))
    # merged list by list, so that the copies of a list lie together and compress; a million of them a task at most, if every set meets every list
    sent = lists.hint("merge").join(alike, "mine").select("set", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "list", "shared")
    tasks = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), sets.count() * lists.count() // 1_000_000)
    others = placed.select("set", "part", F.col("source").alias("b")).repartition(tasks, "set", "part")
    return sent.repartition(tasks, "set", "part").join(others.hint("merge"), ["set", "part"]).select(F.explode("list").alias("a"), "b", "shared").filter("a <> b")


query("grf_co_invested_peers", _peers_sql("ib"))(lambda s, d: peers(G.invested_in_by(s, d)))
query("grf_agency_peers", _peers_sql("ca"))(lambda s, d: peers(G.contracted_by_agency(s, d)))
_INV = "unnest(list_distinct(list_transform(investors_awarders, lambda x: trim(x, E' \\t\\r\\n'))))"


@query("grf_syndicates", _B + f", i AS (SELECT id, {_INV} AS inv FROM f WHERE event_type IN ('REG_D_FILING','VC_ROUND','PRIVATE_ROUND')) SELECT a.inv AS a, b.inv AS b, count(*)::BIGINT AS rounds FROM i a JOIN i b ON a.id = b.id AND a.inv < b.inv WHERE a.inv <> '' AND b.inv <> '' GROUP BY 1, 2")
def _syndicates(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of investors by the rounds they share; the list of one round is short."""
    f = V.funding(spark, sf).filter(F.col("event_type").isin(*G.PRIVATE)).select("id", F.array_sort(F.filter(F.array_distinct(F.transform("investors_awarders", squeeze)), lambda x: x != "")).alias("l"))
    first = f.select("l", F.posexplode("l").alias("i", "a"))
    return first.select("a", F.explode(F.slice("l", F.col("i") + 2, F.size("l"))).alias("b")).groupBy("a", "b").agg(F.count("*").alias("rounds"))


_FIRM = "(regexp_matches(lower(inv), 'capital|ventures|partners|fund|holdings|equity|investments') OR regexp_matches(lower(inv), '\\b(inc|llc|lp|corp|ltd)\\b') OR len(regexp_split_to_array(trim(inv), '\\s+')) >= 3)"
_INAME = "trim(regexp_replace(regexp_replace(trim(inv), ',?\\s*(LLC|L\\.L\\.C\\.|LP|L\\.P\\.|Inc\\.?|Corp\\.?)$', '', 'i'), '\\s+', ' ', 'g'))"
_INVESTORS = _B + f", i AS (SELECT id, entity_id, amount, event_date, {_INV} AS inv FROM f WHERE event_type IN ('REG_D_FILING','VC_ROUND','PRIVATE_ROUND')), n AS (SELECT *, {_INAME} AS name, {_FIRM} AS firm FROM i WHERE inv <> '')"


def _investors(spark: SparkSession, sf: str) -> DataFrame:
    f = V.funding(spark, sf).filter(F.col("event_type").isin(*G.PRIVATE))
    i = f.select("id", "entity_id", "amount", "event_date", F.explode(F.array_distinct(F.transform("investors_awarders", squeeze))).alias("inv")).filter("inv <> ''")
    return i.withColumns({"name": T.investor_name(F.col("inv")), "firm": T.is_firm(F.col("inv"))})


query("grf_investors", _INVESTORS + " SELECT name, bool_or(firm) AS firm, count(*)::BIGINT AS rounds, count(DISTINCT entity_id)::BIGINT AS companies FROM n GROUP BY 1")(
    lambda s, d: _investors(s, d).groupBy("name").agg(F.bool_or("firm").alias("firm"), F.count("*").alias("rounds"), F.count_distinct("entity_id").alias("companies")))
query("grf_promoted_investors", _INVESTORS + " SELECT name, entity_id, max(amount) AS amount FROM n WHERE firm AND entity_id IS NOT NULL AND amount IS NOT NULL AND name NOT IN (SELECT canonical_name FROM entities WHERE canonical_name IS NOT NULL) GROUP BY 1, 2")(
    lambda s, d: _investors(s, d).filter("firm AND entity_id IS NOT NULL AND amount IS NOT NULL").groupBy("name", "entity_id").agg(F.max("amount").alias("amount")).join(V.entities(s, d).select(F.col("canonical_name").alias("name")), "name", "left_anti"))
query("grf_reach_paths", _E + ", st AS (SELECT min(source) AS node FROM ib), b AS (SELECT DISTINCT source, target FROM ed UNION SELECT target, source FROM ed), h1 AS (SELECT target AS node, st.node || ' > ' || target AS path FROM b, st WHERE source = st.node AND target <> st.node), h2 AS (SELECT b.target AS node, min(h1.path || ' > ' || b.target) AS path FROM b JOIN h1 ON b.source = h1.node WHERE b.target NOT IN (SELECT node FROM h1) AND b.target NOT IN (SELECT node FROM st) GROUP BY 1) SELECT 1 AS hop, node, path FROM h1 UNION ALL SELECT 2, node, path FROM h2")(
    lambda s, d: G.paths(s, d, G.invested_in_by(s, d).agg(F.min("source").alias("node"))))

# snapshots
_KD = _B + ", d(day) AS (VALUES (DATE '2025-01-01'), (DATE '2025-07-01'), (DATE '2026-01-01')), k AS (SELECT entity_id, day, list(DISTINCT base_type) t FROM s, d WHERE detected_date <= day AND detected_date > day - 365 AND entity_id IS NOT NULL AND base_type IS NOT NULL GROUP BY 1, 2)"


@query("snp_signal_changes", _KD + ", g AS (SELECT entity_id, day, t, lag(t) OVER (PARTITION BY entity_id ORDER BY day) p FROM k) SELECT entity_id, day, len(list_filter(t, lambda x: NOT list_contains(p, x)))::BIGINT AS gained, len(list_filter(p, lambda x: NOT list_contains(t, x)))::BIGINT AS lost FROM g WHERE p IS NOT NULL")
def _signal_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Signal types gained and lost between an entity's snapshots; a set has as many types as there are."""
    days = F.array(*[F.lit(x).cast("date") for x in ("2025-01-01", "2025-07-01", "2026-01-01")])
    within = F.filter(days, lambda x: (F.col("detected_date") <= x) & (F.col("detected_date") > F.date_sub(x, 365)))
    k = V.signals(spark, sf).filter("entity_id IS NOT NULL AND base_type IS NOT NULL").select("entity_id", "base_type", F.explode(within).alias("day")).groupBy("entity_id", "day").agg(F.collect_set("base_type").alias("t"))
    k = k.withColumn("p", F.lag("t").over(Window.partitionBy("entity_id").orderBy("day"))).filter("p IS NOT NULL")
    return k.select("entity_id", "day", F.size(F.array_except("t", "p")).cast("long").alias("gained"), F.size(F.array_except("p", "t")).cast("long").alias("lost"))


_SN = _B + ", d(day) AS (VALUES (DATE '2025-01-01'), (DATE '2025-07-01'), (DATE '2026-01-01')), sn AS (SELECT entity_id, day, round(sum(confidence)::DOUBLE, 2) score, count(*)::BIGINT n FROM s, d WHERE detected_date <= day AND detected_date > day - 365 AND entity_id IS NOT NULL GROUP BY 1, 2)"
query("snp_trajectories", _SN + " SELECT entity_id, count(*)::BIGINT AS points, arg_min(score, day) AS first_score, arg_max(score, day) AS last_score FROM sn WHERE score IS NOT NULL GROUP BY 1")(
    lambda s, d: snapshots(s, d).filter("score IS NOT NULL").groupBy("entity_id").agg(F.count("*").alias("points"), F.min_by("score", "day").alias("first_score"), F.max_by("score", "day").alias("last_score")))
query("set_required_signals", _B + " SELECT entity_id FROM (SELECT entity_id, list(DISTINCT base_type) t FROM s WHERE status = 'ACTIVE' AND entity_id IS NOT NULL AND base_type IS NOT NULL GROUP BY 1) WHERE list_has_all(t, ['sbir_phase_2_transition', 'outsized_award'])")(
    lambda s, d: V.signals(s, d).filter("status = 'ACTIVE' AND entity_id IS NOT NULL").groupBy("entity_id").agg(F.collect_set("base_type").alias("t")).filter(F.size(F.array_except(F.array(F.lit("sbir_phase_2_transition"), F.lit("outsized_award")), "t")) == 0).select("entity_id"))

# fund
_ES = _UN + ", es AS (SELECT un.entity_id, un.composite, CASE WHEN contract_total >= 10000000 THEN 'Production' WHEN contract_n > 0 AND pr.regd_n > 0 THEN 'Growth' WHEN pr.p2_n + contract_n > 0 THEN 'Prototype' ELSE 'Pre-revenue' END AS stage, row_number() OVER (ORDER BY un.composite DESC, un.entity_id) r FROM un JOIN pr USING (entity_id) ORDER BY un.composite DESC, un.entity_id LIMIT 20)"


def entry_states(spark: SparkSession, sf: str, n: int = 20) -> DataFrame:
    """What the first n of the universe are at entry: composite and stage."""
    picked = F.broadcast(universe(spark, sf).select("entity_id", "composite").orderBy(F.desc("composite"), "entity_id").limit(n))  # n rows
    return S.lifecycle(S.profile(spark, sf)).select("entity_id", F.col("stage_4").alias("stage")).join(picked, "entity_id").select("entity_id", "composite", "stage")


query("fnd_entry_states", _ES + " SELECT entity_id, composite, stage FROM es")(entry_states)


@query("fnd_cohort_metrics", _ES + ", m AS (SELECT 'NEW_CONTRACT' kind, entity_id, contract_value AS v FROM c WHERE award_date >= DATE '2025-03-01' UNION ALL SELECT 'FUNDING_RAISE', entity_id, amount FROM f WHERE event_type IN ('REG_D_FILING','VC_ROUND') AND event_date >= DATE '2025-03-01') SELECT k.kind, count(DISTINCT m.entity_id)::BIGINT AS hits, round(count(DISTINCT m.entity_id) * 100.0::DOUBLE / 20, 2) AS hit_rate, coalesce(sum(v), 0)::DOUBLE AS value FROM (VALUES ('NEW_CONTRACT'), ('FUNDING_RAISE'), ('ACQUISITION')) k(kind) LEFT JOIN (SELECT * FROM m WHERE entity_id IN (SELECT entity_id FROM es)) m ON m.kind = k.kind GROUP BY 1")
def _cohort_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Hit rate and value of each kind of milestone for the picked cohort, kinds without any as zero."""
    since = F.lit("2025-03-01").cast("date")
    m = V.contracts(spark, sf).filter(F.col("award_date") >= since).select(F.lit("NEW_CONTRACT").alias("kind"), "entity_id", F.col("contract_value").alias("v"))
    m = m.unionByName(V.funding(spark, sf).filter(F.col("event_type").isin("REG_D_FILING", "VC_ROUND") & (F.col("event_date") >= since)).select(F.lit("FUNDING_RAISE").alias("kind"), "entity_id", F.col("amount").alias("v")))
    m = m.join(entry_states(spark, sf).select("entity_id"), "entity_id", "left_semi")
    spine = m.sparkSession.createDataFrame([("NEW_CONTRACT",), ("FUNDING_RAISE",), ("ACQUISITION",)], "kind string")  # the kinds that are declared
    return spine.join(m, "kind", "left").groupBy("kind").agg(F.count_distinct("entity_id").alias("hits"), F.round(F.count_distinct("entity_id") * 100.0 / 20, 2).alias("hit_rate"), F.coalesce(F.sum("v"), F.lit(0)).cast("double").alias("value"))


query("fnd_match_distance", _ES + ", a AS (SELECT p.*, row_number() OVER (ORDER BY es.r) k FROM es JOIN pr p USING (entity_id) WHERE es.r <= 5), o AS (SELECT pr.* FROM pr JOIN un USING (entity_id) WHERE pr.entity_id NOT IN (SELECT entity_id FROM es)) SELECT entity_id, twin, distance FROM (SELECT a.entity_id, o.entity_id AS twin, dist AS distance, row_number() OVER (PARTITION BY a.entity_id ORDER BY dist, o.entity_id) r FROM (SELECT a.entity_id e, o.entity_id t, round(least(abs(log10(a.sbir_total + 1) - log10(o.sbir_total + 1)) / greatest(log10(a.sbir_total + 1), log10(o.sbir_total + 1), 1), 1) + least(abs(a.p2_n - o.p2_n)::DOUBLE / greatest(a.p2_n, o.p2_n, 1), 1) + (a.core_business IS DISTINCT FROM o.core_business)::INT, 6) dist FROM a, o) x JOIN a ON a.entity_id = e JOIN o ON o.entity_id = t) WHERE r = 1")(
    lambda s, d: _twins(s, d))


def _twins(spark: SparkSession, sf: str, picks: int = 5) -> DataFrame:
    """For each of the first picks the nearest other of the universe by awards, their value and business; picks are few rows, broadcast."""
    u, p = universe(spark, sf).select("entity_id", "composite"), S.profile(spark, sf).select("entity_id", "sbir_total", "p2_n", "core_business")
    first = u.orderBy(F.desc("composite"), "entity_id").limit(20).withColumn("r", F.row_number().over(Window.orderBy(F.desc("composite"), "entity_id")))  # twenty rows
    a = first.filter(F.col("r") <= picks).join(p, "entity_id").select(F.col("entity_id").alias("pick"), F.col("sbir_total").alias("s"), F.col("p2_n").alias("n"), F.col("core_business").alias("b"))
    pool = u.join(F.broadcast(first.select("entity_id")), "entity_id", "left_anti").join(p, "entity_id")
    far = relative_distance(T.safe_log(F.col("s")), T.safe_log(F.col("sbir_total"))) + relative_distance(F.col("n").cast("double"), F.col("p2_n").cast("double")) + (~F.col("b").eqNullSafe(F.col("core_business"))).cast("int")
    d = pool.crossJoin(F.broadcast(a)).withColumn("distance", F.round(far, 6))
    return d.groupBy(F.col("pick")).agg(F.min(F.struct("distance", "entity_id")).alias("x")).select(F.col("pick").alias("entity_id"), F.col("x.entity_id").alias("twin"), F.col("x.distance").alias("distance"))


# reports
query("rpt_lapse_exposure", _PR + f" SELECT core_business, count(*)::BIGINT AS exposed, max(CASE WHEN p3 > 0 THEN 3 WHEN p2_n > 0 THEN 2 ELSE 1 END) AS max_phase FROM (SELECT pr.*, coalesce(private, 0) private, (SELECT count(*) FROM f WHERE f.entity_id = pr.entity_id AND event_type = 'SBIR_PHASE_3') p3 FROM pr LEFT JOIN {_PRIV} v ON v.entity_id = pr.entity_id) WHERE entity_type = 'STARTUP' AND sbir_total >= 500000 AND sbir_n >= 2 AND private < 1000000 AND sbir_total / (sbir_total + contract_total) > 0.7::DOUBLE GROUP BY 1")(
    lambda s, d: S.profile(s, d).join(private(s, d), "entity_id", "left").filter("entity_type = 'STARTUP' AND sbir_total >= 500000 AND sbir_n >= 2 AND coalesce(private, 0) < 1000000 AND sbir_total / (sbir_total + contract_total) > 0.7D").groupBy("core_business").agg(F.count("*").alias("exposed"), F.max(F.when(F.col("p3_n") > 0, 3).when(F.col("p2_n") > 0, 2).otherwise(1)).alias("max_phase")))
query("rpt_diversified", _PR + f" SELECT pr.entity_id, coalesce(private, 0) AS private, contract_total FROM pr LEFT JOIN {_PRIV} v ON v.entity_id = pr.entity_id WHERE entity_type = 'STARTUP' AND sbir_total >= 500000 AND sbir_n >= 2 AND pr.entity_id NOT IN (SELECT entity_id FROM s WHERE entity_id IS NOT NULL AND base_type = 'sbir_lapse_risk' AND status = 'ACTIVE') ORDER BY private DESC, pr.entity_id LIMIT 10")(
    lambda s, d: S.profile(s, d).filter("entity_type = 'STARTUP' AND sbir_total >= 500000 AND sbir_n >= 2").join(V.signals(s, d).filter("base_type = 'sbir_lapse_risk' AND status = 'ACTIVE' AND entity_id IS NOT NULL"), "entity_id", "left_anti").join(private(s, d), "entity_id", "left").select("entity_id", F.coalesce("private", F.lit(0.0)).alias("private"), "contract_total").orderBy(F.desc("private"), "entity_id").limit(10))
query("rpt_top_per_sector", _PR + " SELECT core_business, entity_id, sbir_total FROM (SELECT *, row_number() OVER (PARTITION BY core_business ORDER BY sbir_total DESC, entity_id) r FROM pr WHERE core_business IS NOT NULL AND sbir_n > 0) WHERE r <= 3")(
    lambda s, d: S.profile(s, d).filter("core_business IS NOT NULL AND sbir_n > 0").withColumn("r", F.row_number().over(Window.partitionBy("core_business").orderBy(F.desc("sbir_total"), "entity_id"))).filter("r <= 3").select("core_business", "entity_id", "sbir_total"))
query("rpt_market_structure", _PR + " SELECT (sbir_n > 0) AS sbir, (contract_n > 0) AS contracts, (regd_n > 0) AS capital, count(*)::BIGINT AS entities FROM pr WHERE entity_type = 'STARTUP' GROUP BY ALL")(
    lambda s, d: S.profile(s, d).filter("entity_type = 'STARTUP'").groupBy((F.col("sbir_n") > 0).alias("sbir"), (F.col("contract_n") > 0).alias("contracts"), (F.col("regd_n") > 0).alias("capital")).agg(F.count("*").alias("entities")))
query("rpt_company_profiles", _PR + " SELECT entity_id, sbir_n::BIGINT AS sbir_n, sbir_total, p2_n::BIGINT AS p2_n, regd_n::BIGINT AS regd_n, contract_n::BIGINT AS contract_n, contract_total, agencies::BIGINT AS agencies, (year(regd_first) - year(sbir_first)) * 12 + month(regd_first) - month(sbir_first) AS months_to_raise, strftime(last_award, '%B %Y') AS last_award FROM pr WHERE entity_type = 'STARTUP'")(
    lambda s, d: S.profile(s, d).filter("entity_type = 'STARTUP'").select("entity_id", "sbir_n", "sbir_total", "p2_n", "regd_n", "contract_n", "contract_total", "agencies", F.expr("(year(regd_first) - year(sbir_first)) * 12 + month(regd_first) - month(sbir_first)").cast("long").alias("months_to_raise"), F.date_format("last_award", "MMMM yyyy").alias("last_award")))
query("rpt_largest_contracts", _B + " SELECT entity_id, id, contract_value FROM (SELECT *, rank() OVER (PARTITION BY entity_id ORDER BY contract_value DESC) r FROM c WHERE entity_id IS NOT NULL AND contract_value IS NOT NULL) WHERE r = 1")(
    lambda s, d: _largest(s, d))


def _largest(spark: SparkSession, sf: str) -> DataFrame:
    """Each entity's largest contract, ties kept: by its maximum, not by a sort of its contracts."""
    c = V.contracts(spark, sf).filter("entity_id IS NOT NULL AND contract_value IS NOT NULL").select("entity_id", "id", "contract_value")
    return c.join(c.groupBy("entity_id").agg(F.max("contract_value").alias("contract_value")), ["entity_id", "contract_value"]).select("entity_id", "id", "contract_value")


query("rpt_enrichment_recency", _B + " SELECT CASE WHEN age <= 30 THEN 'fresh' WHEN age <= 180 THEN 'ageing' ELSE 'old' END AS band, count(*)::BIGINT AS n FROM (SELECT DATE '2026-03-01' - CAST(updated_at AS DATE) age FROM act WHERE updated_at IS NOT NULL) GROUP BY 1")(
    lambda s, d: table(s, d, "entities").filter("merged_into_id IS NULL AND updated_at IS NOT NULL").withColumn("age", F.datediff(V.as_of(), F.to_date("updated_at"))).groupBy(F.when(F.col("age") <= 30, "fresh").when(F.col("age") <= 180, "ageing").otherwise("old").alias("band")).agg(F.count("*").alias("n")))
query("rpt_signal_timeline", _B + " SELECT entity_id, CAST(date_trunc('quarter', detected_date) AS DATE) AS quarter, count(*)::BIGINT AS n, round(sum(confidence)::DOUBLE, 2) AS confidence FROM s WHERE base_type = 'contract_acceleration' AND entity_id IS NOT NULL AND detected_date IS NOT NULL GROUP BY 1, 2")(
    lambda s, d: V.signals(s, d).filter("base_type = 'contract_acceleration' AND entity_id IS NOT NULL AND detected_date IS NOT NULL").groupBy("entity_id", F.date_trunc("quarter", "detected_date").cast("date").alias("quarter")).agg(F.count("*").alias("n"), F.round(F.sum("confidence").cast("double"), 2).alias("confidence")))
query("win_repeats_90d", _B + " SELECT entity_id, id FROM (SELECT entity_id, id, event_date, lag(event_date) OVER (PARTITION BY entity_id, event_type ORDER BY event_date, id) prev FROM f WHERE entity_id IS NOT NULL AND event_date IS NOT NULL) WHERE event_date - prev <= 90")(
    lambda s, d: V.funding(s, d).filter("entity_id IS NOT NULL AND event_date IS NOT NULL").withColumn("prev", F.lag("event_date").over(Window.partitionBy("entity_id", "event_type").orderBy("event_date", "id"))).filter(F.datediff("event_date", "prev") <= 90).select("entity_id", "id"))
query("win_new_agencies", _B + f" SELECT entity_id, agency, first_day FROM (SELECT entity_id, {_AG} AS agency, min(award_date) AS first_day FROM c WHERE entity_id IS NOT NULL AND trim(contracting_agency) <> '' GROUP BY 1, 2) WHERE first_day >= DATE '2025-03-01'")(
    lambda s, d: V.contracts(s, d).filter("entity_id IS NOT NULL AND trim(contracting_agency) <> ''").groupBy("entity_id", agency_key(F.col("contracting_agency")).alias("agency")).agg(F.min("award_date").alias("first_day")).filter("first_day >= date'2025-03-01'"))

# predicates
query("flt_title_search", "SELECT doc_id FROM documents WHERE title ILIKE '%radar%' OR lower(title) LIKE '%autonom%'")(lambda s, d: table(s, d, "documents").filter(F.col("title").ilike("%radar%") | F.lower("title").contains("autonom")).select("doc_id"))
query("flt_universe_criteria", _UN + " SELECT entity_id FROM un WHERE composite >= 2 AND p2_n >= 1 AND regd_n <= 3 AND entity_id NOT IN (SELECT entity_id FROM s WHERE entity_id IS NOT NULL AND status = 'ACTIVE' AND base_type = 'gone_stale')")(lambda s, d: _criteria(s, d))
#: A strategy as data: bounds by column, and signals that exclude.
CRITERIA = {"least": {"composite": 2, "p2_n": 1}, "most": {"regd_n": 3}, "without": ["gone_stale"]}


def _criteria(spark: SparkSession, sf: str, criteria: dict = CRITERIA) -> DataFrame:
    """The universe under criteria given as data, folded into one predicate."""
    u = universe(spark, sf)
    for c, v in criteria["least"].items():
        u = u.filter(F.col(c) >= v)
    for c, v in criteria["most"].items():
        u = u.filter(F.col(c) <= v)
    out = V.signals(spark, sf).filter((F.col("status") == "ACTIVE") & F.col("base_type").isin(criteria["without"]) & F.col("entity_id").isNotNull())
    return u.join(out, "entity_id", "left_anti").select("entity_id")


query("flt_name_exclusions", "SELECT id FROM entities WHERE NOT regexp_matches(lower(canonical_name), 'university|institute|college|hospital')")(lambda s, d: V.entities(s, d).filter(~F.lower("canonical_name").rlike("university|institute|college|hospital")).select("id"))
query("rag_filtered", _UN + " SELECT un.entity_id, composite, core_business FROM un JOIN pr USING (entity_id) WHERE core_business IN ('SOFTWARE', 'RF_HARDWARE') AND composite >= 3")(
    lambda s, d: universe(s, d).join(V.active(s, d).select(F.col("id").alias("entity_id"), "core_business"), "entity_id").filter("core_business IN ('SOFTWARE', 'RF_HARDWARE') AND composite >= 3").select("entity_id", "composite", "core_business"))
query("rag_enriched", _UN + " SELECT un.entity_id, composite, sbir_total, contract_total, CASE WHEN t > 100000000 THEN 'production' WHEN t > 20000000 THEN 'growth' WHEN t > 5000000 THEN 'expansion' WHEN t > 1000000 THEN 'early' ELSE 'seed' END AS stage FROM (SELECT entity_id, sbir_total, contract_total, sbir_total + contract_total t FROM pr) JOIN un USING (entity_id)")(
    lambda s, d: universe(s, d).select("entity_id", "composite").join(S.profile(s, d).select("entity_id", "sbir_total", "contract_total"), "entity_id").select("*", T.stage_of_total(F.col("sbir_total") + F.col("contract_total")).alias("stage")))

# text
_STOP = "(" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + ")"
_TW = f"list_filter(regexp_extract_all(lower(title), '[a-z][a-z-]+'), lambda w: len(w) > 2 AND w NOT IN {_STOP})"
query("fnc_title_words", f"SELECT doc_id, array_to_string({_TW}, ' ') AS words FROM documents WHERE title IS NOT NULL")(lambda s, d: table(s, d, "documents").filter("title IS NOT NULL").select("doc_id", F.array_join(T.title_words(F.col("title")), " ").alias("words")))
query("fnc_title_terms", f"WITH w AS (SELECT doc_id, title, {_TW} w FROM documents WHERE title IS NOT NULL) SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(w, list_transform(regexp_extract_all(title, '\\b[A-Z][A-Z0-9-]{{1,8}}\\b'), lambda x: lower(x)), list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])))), '|') AS terms FROM w")(
    lambda s, d: table(s, d, "documents").filter("title IS NOT NULL").select("doc_id", F.array_join(T.title_terms(F.col("title")), "|").alias("terms")))
query("fnc_tag_terms", "SELECT tag, array_to_string(list_sort(list_distinct(list_concat([lower(trim(tag)), replace(lower(trim(tag)), '_', ' ')], string_split(regexp_replace(lower(trim(tag)), '[_-]', ' ', 'g'), ' ')))), '|') AS terms, n FROM (SELECT tag, count(*)::BIGINT n FROM (SELECT unnest(technology_tags) tag FROM entities) WHERE tag IS NOT NULL GROUP BY 1)")(
    lambda s, d: V.entities(s, d).select(F.explode("technology_tags").alias("tag")).filter("tag IS NOT NULL").groupBy("tag").agg(F.count("*").alias("n")).select("tag", F.array_join(T.tag_terms(F.col("tag")), "|").alias("terms"), "n"))

query("fnc_summaries", _B + " SELECT id, concat_ws(', ', nullif(trim(contracting_agency), ''), nullif(trim(place_of_performance), '')) AS line, CASE WHEN contract_value > 0 THEN round(log10(contract_value::DOUBLE + 1), 6) ELSE 0 END AS size, strftime(award_date, '%B %Y') AS month FROM c JOIN (SELECT DISTINCT ON (id) id, place_of_performance FROM contracts ORDER BY id, place_of_performance) x USING (id)")(
    lambda s, d: V.contracts(s, d).join(table(s, d, "contracts").groupBy("id").agg(F.min("place_of_performance").alias("place")), "id").select("id", F.concat_ws(", ", F.nullif(F.trim("contracting_agency"), F.lit("")), F.nullif(F.trim("place"), F.lit(""))).alias("line"), F.round(T.safe_log(F.col("contract_value").cast("double")), 6).alias("size"), F.date_format("award_date", "MMMM yyyy").alias("month")))
query("fnc_clean_titles", "SELECT doc_id, regexp_replace(title, '^[?\\s\\x00-\\x1f\\x7f]+', '') AS title FROM documents WHERE title IS NOT NULL AND regexp_full_match(title, '[ -~]*')")(
    lambda s, d: table(s, d, "documents").filter(F.col("title").rlike("^[ -~]*$")).select("doc_id", T.clean_title(F.col("title")).alias("title")))


# audit: the checks beyond those of `aud_checks`
@query("aud_more_checks", _PR + f""" SELECT '1b_merged_still_typed' AS check_id, count(*)::BIGINT AS n FROM entities WHERE merged_into_id IS NOT NULL AND entity_type <> 'NON_DEFENSE' UNION ALL SELECT '1c_university_startup', count(*) FROM entities WHERE entity_type = 'STARTUP' AND lower(canonical_name) LIKE '%university%'
UNION ALL SELECT '2c_duplicate_groups', count(*) FROM (SELECT 1 FROM f WHERE event_type IN ('REG_D_FILING','PRIVATE_ROUND') AND amount IS NOT NULL AND parent_event_id IS NULL GROUP BY entity_id, amount, event_date HAVING count(*) > 1)
UNION ALL SELECT '3a_wrong_type', count(*) FROM s JOIN entities e ON e.id = s.entity_id WHERE status = 'ACTIVE' AND e.entity_type IN ('NON_DEFENSE', 'PRIME') UNION ALL SELECT '3c_raise_before_award', count(DISTINCT s.entity_id) FROM s JOIN pr USING (entity_id) WHERE base_type = 'sbir_validated_raise' AND status = 'ACTIVE' AND regd_first < sbir_first
UNION ALL SELECT '3d_score_out_of_range', count(*) FROM (SELECT DISTINCT id, confidence_score FROM signals) WHERE confidence_score < 0 OR confidence_score > 1
UNION ALL SELECT '4b_classified_untagged', count(*) FROM entities WHERE entity_type = 'STARTUP' AND core_business IS NOT NULL AND core_business <> 'UNCLASSIFIED' AND technology_tags IS NULL UNION ALL SELECT '5a_scored_non_startup', count(*) FROM entities WHERE entity_type IN ('PRIME', 'NON_DEFENSE') AND core_business IS NOT NULL AND core_business <> 'UNCLASSIFIED'
UNION ALL SELECT '5b_negative', count(*) FROM c WHERE contract_value < 0 UNION ALL SELECT '5b2_over_50b', count(*) FROM c WHERE contract_value > 50000000000""")
def _more_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of one table come from one pass over it; only duplicate groups and joins have passes of their own."""
    e, f, s, c = V.entities(spark, sf), V.funding(spark, sf), V.signals(spark, sf), V.contracts(spark, sf)
    classified = F.col("core_business").isNotNull() & (F.col("core_business") != "UNCLASSIFIED")

    def counted(df: DataFrame, **checks) -> DataFrame:
        row = df.agg(*[F.count_if(x).alias(k) for k, x in checks.items()])
        return row.select(F.explode(F.map_from_arrays(F.array(*[F.lit(k) for k in checks]), F.array(*[F.col(k) for k in checks]))).alias("check_id", "n"))

    startup = F.col("entity_type") == "STARTUP"
    out = counted(e, **{
        "1b_merged_still_typed": F.col("merged_into_id").isNotNull() & (F.col("entity_type") != "NON_DEFENSE"), "1c_university_startup": startup & F.lower("canonical_name").contains("university"),
        "4b_classified_untagged": startup & classified & F.col("technology_tags").isNull(), "5a_scored_non_startup": F.col("entity_type").isin("PRIME", "NON_DEFENSE") & classified})
    out = out.unionByName(counted(c, **{"5b_negative": F.col("contract_value") < 0, "5b2_over_50b": F.col("contract_value") > 50_000_000_000}))
    out = out.unionByName(counted(table(spark, sf, "signals").select("id", "confidence_score").distinct(), **{"3d_score_out_of_range": (F.col("confidence_score") < 0) | (F.col("confidence_score") > 1)}))
    groups = f.filter(F.col("event_type").isin("REG_D_FILING", "PRIVATE_ROUND") & F.col("amount").isNotNull() & F.col("parent_event_id").isNull()).groupBy("entity_id", "amount", "event_date").count().filter("count > 1")
    wrong = s.filter("status = 'ACTIVE'").join(e.filter("entity_type IN ('NON_DEFENSE', 'PRIME')").select(F.col("id").alias("entity_id")), "entity_id")
    early = s.filter("base_type = 'sbir_validated_raise' AND status = 'ACTIVE'").select("entity_id").distinct().join(S.profile(spark, sf).filter("regd_first < sbir_first"), "entity_id", "left_semi")
    for k, df in (("2c_duplicate_groups", groups), ("3a_wrong_type", wrong), ("3c_raise_before_award", early)):
        out = out.unionByName(df.agg(F.count("*").alias("n")).select(F.lit(k).alias("check_id"), "n"))
    return out


query("aud_confidence_spread", _B + " SELECT base_type, min(confidence)::DOUBLE AS low, max(confidence)::DOUBLE AS high, round(avg(confidence)::DOUBLE, 3) AS mean, count(*)::BIGINT AS n FROM s WHERE status = 'ACTIVE' AND base_type IS NOT NULL GROUP BY 1")(
    lambda s, d: V.signals(s, d).filter("status = 'ACTIVE' AND base_type IS NOT NULL").groupBy("base_type").agg(F.min("confidence").cast("double").alias("low"), F.max("confidence").cast("double").alias("high"), F.round(F.avg(F.col("confidence").cast("double")), 3).alias("mean"), F.count("*").alias("n")))


def queries() -> dict:
    return dict(query.calls)


def oracle_sql() -> dict[str, str]:
    return dict(query.sql)
