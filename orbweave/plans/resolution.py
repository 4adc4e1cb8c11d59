"""Queries of entity resolution and of staged records, each with its checking SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbweave.functions.scalars import money
from orbweave.operators import resolution as R
from orbweave.plans.registry import Registry
from orbweave.sources import views as V
from orbweave.sources.tables import table

query = Registry()
_B = V.BASE_SQL


def _strip_sql(c: str, suffixes: tuple[str, ...]) -> str:
    for s in suffixes:
        c = f"regexp_replace({c}, '{s}', '', 'i')"
    return c


def _spaced_sql(c: str, odd: str) -> str:
    return f"trim(regexp_replace(regexp_replace({c}, '{odd}', ' ', 'g'), '\\s+', ' ', 'g'))"


def _resolver_sql(c: str) -> str:
    # three passes as three columns of a subquery, for the text would treble with each
    return f"regexp_replace(lower({_spaced_sql(c, '[^\\w\\s]')}), '^the ', '')"


_RN = "rn AS (SELECT id, " + _resolver_sql("n3") + " AS name FROM (SELECT id, trim(" + _strip_sql("n2", R.RESOLVER_SUFFIXES) + ") n3 FROM (SELECT id, trim(" + _strip_sql("n1", R.RESOLVER_SUFFIXES) + ") n2 FROM (SELECT id, trim(" + _strip_sql("trim(canonical_name)", R.RESOLVER_SUFFIXES) + ") n1 FROM entities WHERE canonical_name IS NOT NULL))))"
_CHECK = _spaced_sql(_spaced_sql(_strip_sql("lower(trim(canonical_name))", R.CHECK_SUFFIXES), "\\s+"), "[,.\\-''\"&]")
_MATCH = f"upper({_spaced_sql(_strip_sql('trim(canonical_name)', R.MATCHER_SUFFIXES), '[^\\w\\s]')})"
#: Names of plain letters only: SQL and Spark differ in what else they take for a letter.
_ASCII = "regexp_full_match(canonical_name, '[ -~]+')"
_GEN = "(" + ", ".join(f"'{w}'" for w in R.GENERIC) + ")"
_ST = "(" + ", ".join(f"'{k}'" for k in R.STATES) + ")"


def _ascii(spark: SparkSession, sf: str) -> DataFrame:
    return V.entities(spark, sf).filter(F.col("canonical_name").rlike("^[ -~]+$"))


query("er_normal_names", f"WITH {_RN} SELECT id, name AS resolver, {_MATCH} AS matcher, {_CHECK} AS checker FROM entities JOIN rn USING (id) WHERE {_ASCII}")(
    lambda s, d: _ascii(s, d).select("id", R.resolver_name(F.col("canonical_name")).alias("resolver"), R.matcher_name(F.col("canonical_name")).alias("matcher"), R.check_name(F.col("canonical_name")).alias("checker")))
query("er_generic_words", f"WITH {_RN} SELECT id, len(list_filter(string_split(name, ' '), lambda w: w NOT IN {_GEN} AND w <> '')) = 0 AS generic FROM rn JOIN entities USING (id) WHERE {_ASCII}")(
    lambda s, d: _ascii(s, d).select("id", R.only_generic(R.resolver_name(F.col("canonical_name"))).alias("generic")))
query("er_states", f"SELECT state, count(*)::BIGINT AS n FROM (SELECT list_filter(regexp_split_to_array(replace(upper(headquarters_location), ',', ' '), '\\s+'), lambda t: t IN {_ST})[1] AS state FROM entities) GROUP BY 1")(
    lambda s, d: V.entities(s, d).groupBy(R.state_in(F.col("headquarters_location")).alias("state")).agg(F.count("*").alias("n")))


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    """The pairs of the queue between rows that are there, once each, with the best score given to them."""
    m = table(spark, sf, "potential_matches").filter("entity_a <> entity_b").select(F.least("entity_a", "entity_b").alias("a"), F.greatest("entity_a", "entity_b").alias("b"), (F.col("similarity_score") * 100).alias("score"))
    ids = V.entities(spark, sf).select("id")
    return m.groupBy("a", "b").agg(F.max("score").alias("score")).join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")


_PAIRS = "pairs AS (SELECT least(entity_a, entity_b) a, greatest(entity_a, entity_b) b, max(similarity_score * 100) score FROM potential_matches WHERE entity_a <> entity_b GROUP BY 1, 2), pp AS (SELECT * FROM pairs WHERE a IN (SELECT id FROM entities) AND b IN (SELECT id FROM entities))"
_TREE = _B.rstrip() + f", {_RN}, {_PAIRS}, st AS (SELECT id, cage_code, duns_number, headquarters_location, list_filter(regexp_split_to_array(replace(upper(headquarters_location), ',', ' '), '\\s+'), lambda t: t IN {_ST})[1] AS state FROM entities), nk AS (SELECT DISTINCT entity_id, naics_code FROM c WHERE naics_code IS NOT NULL AND entity_id IS NOT NULL), ru AS (SELECT pp.a, pp.b, CASE WHEN coalesce(x.cage_code = y.cage_code, false) OR coalesce(x.duns_number = y.duns_number, false) THEN 'identifier' WHEN coalesce(na.name = nb.name AND na.name LIKE '% %', false) THEN 'identical' WHEN score >= 90 AND coalesce(x.state = y.state, false) THEN 'state' WHEN score >= 90 AND EXISTS (SELECT 1 FROM nk k JOIN nk l USING (naics_code) WHERE k.entity_id = pp.a AND l.entity_id = pp.b) THEN 'industry' WHEN score >= 95 AND NOT coalesce(x.state <> y.state, false) THEN 'very alike' WHEN score >= 70 THEN 'review' ELSE 'apart' END AS rule FROM pp JOIN st x ON x.id = pp.a JOIN st y ON y.id = pp.b LEFT JOIN rn na ON na.id = pp.a LEFT JOIN rn nb ON nb.id = pp.b WHERE pp.a IN (SELECT id FROM entities WHERE {_ASCII}) AND pp.b IN (SELECT id FROM entities WHERE {_ASCII}))"


@query("er_decision_tree", _TREE + " SELECT a, b, CASE WHEN rule IN ('review', 'apart') THEN rule ELSE 'merge' END AS decision, CASE rule WHEN 'identifier' THEN 1.0::DOUBLE WHEN 'identical' THEN 0.98::DOUBLE WHEN 'state' THEN 0.95::DOUBLE WHEN 'industry' THEN 0.9::DOUBLE WHEN 'very alike' THEN 0.95::DOUBLE END AS confidence, rule FROM ru")
def _tree(spark: SparkSession, sf: str) -> DataFrame:
    return R.decided(R.pair_features(_pairs(spark, sf), _ascii(spark, sf), V.contracts(spark, sf)))


@query("er_fuzzy_pairs")
def _fuzzy_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """The fuzzy blend of every pair of the queue, with what resolution makes of it: a shared town adds five; .90 updates, .70 uses, else creates."""
    e = V.entities(spark, sf).select("id", R.resolver_name(F.col("canonical_name")).alias("name"), "headquarters_location")
    d = _pairs(spark, sf).join(e.select(F.col("id").alias("a"), F.col("name").alias("na"), F.col("headquarters_location").alias("la")), "a").join(e.select(F.col("id").alias("b"), F.col("name").alias("nb"), F.col("headquarters_location").alias("lb")), "b")
    score = F.least(R.similarity(F.col("na"), F.col("nb")) / 100 + F.when(R.share_a_token(F.col("la"), F.col("lb")), 0.05).otherwise(0.0), F.lit(1.0))
    return d.filter(~(R.only_generic(F.col("na")) & R.only_generic(F.col("nb")))).select("a", "b", F.round(score, 4).alias("score")).withColumn("action", F.when(F.col("score") >= 0.9, "update").when(F.col("score") >= 0.7, "use").otherwise("create"))


query("er_location_overlap", f"WITH {_PAIRS} SELECT a, b, list_has_any(list_filter(regexp_split_to_array(lower(x.headquarters_location), '[\\s,]+'), lambda t: t <> ''), list_filter(regexp_split_to_array(lower(y.headquarters_location), '[\\s,]+'), lambda t: t <> '')) AS overlap FROM pp JOIN entities x ON x.id = a JOIN entities y ON y.id = b WHERE x.headquarters_location IS NOT NULL AND y.headquarters_location IS NOT NULL AND regexp_full_match(x.headquarters_location, '[ -~]+') AND regexp_full_match(y.headquarters_location, '[ -~]+')")(
    lambda s, d: _overlap(s, d))


def _overlap(spark: SparkSession, sf: str) -> DataFrame:
    e = V.entities(spark, sf).filter(F.col("headquarters_location").rlike("^[ -~]+$")).select("id", "headquarters_location")
    d = _pairs(spark, sf).join(e.toDF("a", "la"), "a").join(e.toDF("b", "lb"), "b")
    return d.select("a", "b", R.share_a_token(F.col("la"), F.col("lb")).alias("overlap"))


_LOW = lambda t: f"list_transform(list_filter({t}.technology_tags, lambda t: t IS NOT NULL), lambda t: lower(t))"


def _sides(spark: SparkSession, sf: str, e: DataFrame) -> DataFrame:
    e = e.select("id", R.resolver_name(F.col("canonical_name")).alias("name"), F.col("cage_code").alias("cage"), F.col("duns_number").alias("duns"), F.col("headquarters_location").alias("place"), F.col("technology_tags").alias("tags"))
    side = lambda x: e.select(*[F.col(c).alias(x if c == "id" else f"{c}_{x}") for c in e.columns])
    return _pairs(spark, sf).join(side("a"), "a").join(side("b"), "b")


@query("er_context_boosts", f"WITH {_PAIRS} SELECT a, b, round(CASE WHEN list_has_any(list_filter(regexp_split_to_array(lower(x.headquarters_location), '[\\s,]+'), lambda t: t <> ''), list_filter(regexp_split_to_array(lower(y.headquarters_location), '[\\s,]+'), lambda t: t <> '')) THEN 0.05::DOUBLE ELSE 0 END + least(0.03::DOUBLE * coalesce(len(list_intersect({_LOW('x')}, {_LOW('y')})), 0), 0.1::DOUBLE), 2) AS boost FROM pp JOIN entities x ON x.id = a JOIN entities y ON y.id = b WHERE regexp_full_match(x.headquarters_location, '[ -~]+') AND regexp_full_match(y.headquarters_location, '[ -~]+')")
def _boosts(spark: SparkSession, sf: str) -> DataFrame:
    """What context adds to each pair of the queue whose places are in plain letters."""
    d = _sides(spark, sf, V.entities(spark, sf).filter(F.col("headquarters_location").rlike("^[ -~]+$")))
    return d.select("a", "b", F.round(R.context_boost(F.col("place_a"), F.col("place_b"), F.col("tags_a"), F.col("tags_b")), 2).alias("boost"))


@query("er_resolved_pairs")
def _resolved(spark: SparkSession, sf: str) -> DataFrame:
    """Every pair of the queue resolved by codes first, then by names and context."""
    return R.resolved(_sides(spark, sf, V.entities(spark, sf)))


query("er_pair_listing", f"WITH {_PAIRS} SELECT a, b, score FROM pp ORDER BY score DESC, a, b LIMIT 100")(lambda s, d: _pairs(s, d).orderBy(F.desc("score"), "a", "b").limit(100))
query("er_fuzzy_groups", f"WITH {_PAIRS} SELECT a AS leader, count(DISTINCT b)::BIGINT AS followers FROM pp WHERE score >= 85 GROUP BY 1")(lambda s, d: _pairs(s, d).filter("score >= 85").groupBy(F.col("a").alias("leader")).agg(F.count_distinct("b").alias("followers")))
query("er_latest_decisions", "SELECT a, b, decision FROM (SELECT least(entity_a, entity_b) a, greatest(entity_a, entity_b) b, lower(trim(decision, E' \\t\\r\\n')) decision, row_number() OVER (PARTITION BY least(entity_a, entity_b), greatest(entity_a, entity_b) ORDER BY queued_at DESC NULLS LAST, match_id DESC) r FROM potential_matches WHERE trim(decision, E' \\t\\r\\n') <> '' AND entity_a <> entity_b) WHERE r = 1")(
    lambda s, d: R.latest_decisions(table(s, d, "potential_matches")))
query("er_soft_merge", "SELECT t.id, count(DISTINCT v) FILTER (v IS NOT NULL AND v IS DISTINCT FROM t.canonical_name)::BIGINT AS variants, (SELECT count(DISTINCT g) FROM (SELECT unnest(technology_tags) g FROM entities x WHERE coalesce(x.merged_into_id, x.id) = t.id) WHERE g IS NOT NULL)::BIGINT AS tags, (SELECT count(*) FROM entities y WHERE y.merged_into_id = t.id)::BIGINT AS sources FROM entities t JOIN (SELECT coalesce(merged_into_id, id) target, unnest(list_append(coalesce(name_variants, []), canonical_name)) v FROM entities) n ON n.target = t.id WHERE t.id IN (SELECT merged_into_id FROM entities WHERE merged_into_id IS NOT NULL) GROUP BY 1")(
    lambda s, d: R.merged(V.entities(s, d)))
query("er_rekeyed_facts", _B + " SELECT coalesce(e.merged_into_id, c.entity_id) AS entity_id, count(*)::BIGINT AS contracts, coalesce(sum(contract_value), 0)::DOUBLE AS total FROM c JOIN entities e ON e.id = c.entity_id GROUP BY 1")(
    lambda s, d: V.contracts(s, d).join(V.entities(s, d).select(F.col("id").alias("entity_id"), "merged_into_id"), "entity_id").groupBy(F.coalesce("merged_into_id", "entity_id").alias("entity_id")).agg(F.count("*").alias("contracts"), F.coalesce(F.sum("contract_value"), F.lit(0)).cast("double").alias("total")))
query("er_correction_stats", "SELECT merge_reason, CAST(date_trunc('month', created_at) AS DATE) AS month, count(*)::BIGINT AS n, round(avg(confidence_score)::DOUBLE, 4) AS mean FROM entity_merges GROUP BY 1, 2")(
    lambda s, d: table(s, d, "entity_merges").groupBy("merge_reason", F.date_trunc("month", "created_at").cast("date").alias("month")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("confidence_score").cast("double")), 4).alias("mean")))
_VN = "lower(regexp_replace(vendor_name, '[^A-Za-z0-9]+', ' ', 'g'))"


@query("er_vendor_lookup", f"WITH e AS (SELECT lower(regexp_replace(canonical_name, '[^A-Za-z0-9]+', ' ', 'g')) k, min(id) id FROM entities WHERE merged_into_id IS NULL AND canonical_name IS NOT NULL GROUP BY 1), g AS (SELECT cage_code k, min(id) id FROM entities WHERE merged_into_id IS NULL AND regexp_full_match(cage_code, '[A-Z0-9]{{5}}') AND cage_code NOT IN ('00000', 'XXXXX') GROUP BY 1) SELECT record_id, coalesce(g.id, e.id) AS entity_id, CASE WHEN g.id IS NOT NULL THEN 'code' WHEN e.id IS NOT NULL THEN 'name' ELSE 'new' END AS how FROM vendor_records v LEFT JOIN g ON g.k = upper(trim(cage_text)) LEFT JOIN e ON e.k = {_VN}")
def _vendor_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Vendor lines resolved by code, else by exact plain name, else new; the smallest id among several."""
    plain = lambda c: F.lower(F.regexp_replace(c, "[^A-Za-z0-9]+", " "))
    e = V.active(spark, sf)
    by_name = e.filter("canonical_name IS NOT NULL").groupBy(plain("canonical_name").alias("n")).agg(F.min("id").alias("by_name"))
    by_code = e.filter(F.col("cage_code").rlike("^[A-Z0-9]{5}$") & ~F.col("cage_code").isin("00000", "XXXXX")).groupBy(F.col("cage_code").alias("k")).agg(F.min("id").alias("by_code"))
    v = table(spark, sf, "vendor_records").select("record_id", plain("vendor_name").alias("n"), F.upper(F.trim("cage_text")).alias("k"))
    d = v.join(by_code, "k", "left").join(by_name, "n", "left")
    return d.select("record_id", F.coalesce("by_code", "by_name").alias("entity_id"), F.when(F.col("by_code").isNotNull(), "code").when(F.col("by_name").isNotNull(), "name").otherwise("new").alias("how"))


# staged records
_OBJ = "json_valid(raw_data) AND json_type(raw_data) = 'OBJECT'"


def _payload(spark: SparkSession, sf: str, key: str) -> DataFrame:
    """Funding events whose payload is an object with a key."""
    return V.funding(spark, sf).filter(F.try_parse_json("raw_data").isNotNull() & F.col("raw_data").rlike(r"^\s*\{") & F.get_json_object("raw_data", f"$['{key}']").isNotNull())


_ISO = r"^\d{4}-\d{2}-\d{2}$"


@query("ing_awards", _B + f""", j AS (SELECT id, entity_id, json_extract_string(raw_data, '$."Award Title"') title, json_extract_string(raw_data, '$."Proposal Award Date"') d, json_extract_string(raw_data, '$."Award Year"') y, json_extract_string(raw_data, '$.Agency') ag, json_extract_string(raw_data, '$.Branch') br, json_extract_string(raw_data, '$.Company') co FROM f WHERE {_OBJ} AND json_extract_string(raw_data, '$."Award Title"') IS NOT NULL)
SELECT id, coalesce(nullif(trim(co), ''), 'unknown') || '_' || substr(title, 1, 50) AS award_key, CASE WHEN regexp_full_match(d, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN try_cast(d AS DATE) WHEN regexp_full_match(y, '\\d{{4}}') THEN make_date(y::BIGINT, 1, 1) END AS day, nullif(concat_ws(', ', nullif(ag, ''), nullif(br, '')), '') AS awarders FROM j""")
def _awards(spark: SparkSession, sf: str) -> DataFrame:
    """Award payloads as events: key by company and title, the award date else the first day of its year, agency and branch."""
    j = lambda k: F.get_json_object("raw_data", f"$['{k}']")
    day = F.when(j("Proposal Award Date").rlike(_ISO), j("Proposal Award Date").try_cast("date")).when(j("Award Year").rlike(r"^\d{4}$"), F.make_date(j("Award Year").cast("int"), F.lit(1), F.lit(1)))
    none = F.lit("")
    return _payload(spark, sf, "Award Title").select("id", F.concat(F.coalesce(F.nullif(F.trim(j("Company")), none), F.lit("unknown")), F.lit("_"), F.substring(j("Award Title"), 1, 50)).alias("award_key"), day.alias("day"), F.nullif(F.concat_ws(", ", F.nullif(j("Agency"), none), F.nullif(j("Branch"), none)), none).alias("awarders"))


@query("ing_filings", _B + f""", j AS (SELECT id, json_extract_string(raw_data, '$.ACCESSIONNUMBER') acc, json_extract_string(raw_data, '$.I_ENTITYNAME') issuer, json_extract_string(raw_data, '$.I_STATEORCOUNTRY') st, json_extract_string(raw_data, '$.S_FILING_DATE') d, json_extract_string(raw_data, '$.O_TOTALOFFERINGAMOUNT') a FROM f WHERE {_OBJ} AND json_extract_string(raw_data, '$.ACCESSIONNUMBER') IS NOT NULL)
SELECT acc, min(id) AS first_id, count(*)::BIGINT AS filings, max(issuer) AS issuer, max(st) AS state, max(CASE WHEN regexp_full_match(d, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN try_cast(d AS DATE) END) AS day, max(CASE WHEN regexp_full_match(regexp_replace(a, '[$,\\s]', '', 'g'), '-?\\d{{1,16}}(\\.\\d+)?') THEN regexp_replace(a, '[$,\\s]', '', 'g')::DECIMAL(18,2) END) AS amount FROM j WHERE trim(issuer) <> '' GROUP BY 1""")
def _filings(spark: SparkSession, sf: str) -> DataFrame:
    """Offering notices by accession number; blank issuers left out, words for an amount give none."""
    j = lambda k: F.get_json_object("raw_data", f"$['{k}']")
    d = _payload(spark, sf, "ACCESSIONNUMBER").filter(F.trim(j("I_ENTITYNAME")) != "")
    return d.groupBy(j("ACCESSIONNUMBER").alias("acc")).agg(F.min("id").alias("first_id"), F.count("*").alias("filings"), F.max(j("I_ENTITYNAME")).alias("issuer"), F.max(j("I_STATEORCOUNTRY")).alias("state"), F.max(F.when(j("S_FILING_DATE").rlike(_ISO), j("S_FILING_DATE").try_cast("date"))).alias("day"), F.max(money(j("O_TOTALOFFERINGAMOUNT"))).alias("amount"))


@query("ing_agreements", _B + f""", j AS (SELECT id, created_at, json_extract_string(raw_data, '$.contractId.piid') piid, json_extract_string(raw_data, '$.contractId.modificationNumber') m, json_extract_string(raw_data, '$.awardDetails.dollars.actionObligation') v, json_extract_string(raw_data, '$.awardDetails.dates.dateSigned') d FROM f WHERE {_OBJ} AND json_extract_string(raw_data, '$.contractId.piid') IS NOT NULL)
SELECT piid, count(*)::BIGINT AS records, arg_max(v, (created_at, id)) AS value_text, min(CASE WHEN regexp_full_match(d, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN try_cast(d AS DATE) END) AS first_signed FROM j WHERE v IS NOT NULL AND created_at IS NOT NULL GROUP BY 1""")
def _agreements(spark: SparkSession, sf: str) -> DataFrame:
    """Agreements by their number: the last obligation loaded stands, the first signature dates them."""
    j = lambda k: F.get_json_object("raw_data", f"$.{k}")
    f = V.funding(spark, sf).filter(F.try_parse_json("raw_data").isNotNull() & F.col("raw_data").rlike(r"^\s*\{")).select("id", "created_at", j("contractId.piid").alias("piid"), j("awardDetails.dollars.actionObligation").alias("v"), j("awardDetails.dates.dateSigned").alias("d"))
    f = f.filter("piid IS NOT NULL AND v IS NOT NULL AND created_at IS NOT NULL")
    return f.groupBy("piid").agg(F.count("*").alias("records"), F.max_by("v", F.struct("created_at", "id")).alias("value_text"), F.min(F.when(F.col("d").rlike(_ISO), F.col("d").try_cast("date"))).alias("first_signed"))


query("enr_dates_from_payload", _B + f" SELECT id, coalesce(event_date, try_cast(json_extract_string(raw_data, '$.awardDetails.dates.dateSigned') AS DATE)) AS day FROM f WHERE {_OBJ} AND event_date IS NULL AND regexp_full_match(json_extract_string(raw_data, '$.awardDetails.dates.dateSigned'), '\\d{{4}}-\\d{{2}}-\\d{{2}}')")(
    lambda s, d: V.funding(s, d).filter(F.try_parse_json("raw_data").isNotNull() & F.col("raw_data").rlike(r"^\s*\{") & F.col("event_date").isNull()).withColumn("t", F.get_json_object("raw_data", "$.awardDetails.dates.dateSigned")).filter(F.col("t").rlike(_ISO)).select("id", F.coalesce("event_date", F.col("t").try_cast("date")).alias("day")))


@query("enr_funding_updates", _B + " SELECT id, CASE WHEN coalesce(amount, 0) > coalesce(prev_amount, 0) THEN 'update' ELSE 'duplicate' END AS status FROM (SELECT *, lag(event_date) OVER w prev_day, lag(amount) OVER w prev_amount FROM f WHERE event_type IN ('REG_D_FILING','VC_ROUND') AND entity_id IS NOT NULL AND event_date IS NOT NULL AND round_stage IS NOT NULL WINDOW w AS (PARTITION BY entity_id, round_stage ORDER BY event_date, id)) WHERE event_date - prev_day < 180")
def _funding_updates(spark: SparkSession, sf: str) -> DataFrame:
    """Rounds that repeat the one before of their entity and stage within 180 days: a larger amount updates it."""
    f = V.funding(spark, sf).filter(F.col("event_type").isin("REG_D_FILING", "VC_ROUND")).filter("entity_id IS NOT NULL AND event_date IS NOT NULL AND round_stage IS NOT NULL")
    w = Window.partitionBy("entity_id", "round_stage").orderBy("event_date", "id")
    d = f.withColumns({"prev_day": F.lag("event_date").over(w), "prev_amount": F.lag("amount").over(w)}).filter(F.datediff("event_date", "prev_day") < 180)
    zero = F.lit(0)
    return d.select("id", F.when(F.coalesce("amount", zero) > F.coalesce("prev_amount", zero), "update").otherwise("duplicate").alias("status"))


@query("enr_nearest_parent", _B + " SELECT id, arg_min(p, (gap, p)) AS parent FROM (SELECT a.id, b.id p, abs(a.amount - b.amount) gap FROM f a JOIN f b ON a.entity_id = b.entity_id AND b.event_type = 'REG_D_FILING' AND a.event_type IN ('VC_ROUND','PRIVATE_ROUND') AND a.amount IS NOT NULL AND b.amount IS NOT NULL) GROUP BY 1")
def _nearest_parent(spark: SparkSession, sf: str) -> DataFrame:
    """For each round the filing of its entity that is nearest in amount, the smaller id among equals.

    Found by two windows over the entity's amounts in order, the filing below and the filing above, so no pairs are made.
    """
    f = V.funding(spark, sf).filter(F.col("event_type").isin("REG_D_FILING", "VC_ROUND", "PRIVATE_ROUND")).filter("entity_id IS NOT NULL AND amount IS NOT NULL").select("id", "entity_id", "amount", (F.col("event_type") == "REG_D_FILING").alias("filing"))
    at = f.groupBy("entity_id", "amount").agg(F.min(F.when(F.col("filing"), F.col("id"))).alias("filed"))  # equal amounts are one point
    here = F.when(F.col("filed").isNotNull(), F.struct("amount", "filed"))
    up, down = Window.partitionBy("entity_id").orderBy("amount"), Window.partitionBy("entity_id").orderBy(F.desc("amount"))
    at = at.withColumns({"below": F.last(here, ignorenulls=True).over(up), "above": F.last(here, ignorenulls=True).over(down)})
    gap = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col("amount") - F.col(f"{c}.amount")).alias("gap"), F.col(f"{c}.filed").alias("id")))
    best = at.select("entity_id", "amount", F.least(gap("below"), gap("above"))["id"].alias("parent")).filter("parent IS NOT NULL")
    return f.filter("NOT filing").join(best, ["entity_id", "amount"]).groupBy("id").agg(F.min("parent").alias("parent"))


query("enr_data_summary", _B + " SELECT entity_id, sum(f)::BIGINT AS events, sum(c)::BIGINT AS contracts, max(day) AS latest, max(day) >= DATE '2026-03-01' - 30 AS recent FROM (SELECT entity_id, 1 f, 0 c, event_date AS day FROM f UNION ALL SELECT entity_id, 0, 1, award_date FROM c) WHERE entity_id IS NOT NULL GROUP BY 1")(
    lambda s, d: V.funding(s, d).select("entity_id", F.lit(1).alias("f"), F.lit(0).alias("c"), F.col("event_date").alias("day")).unionByName(V.contracts(s, d).select("entity_id", F.lit(0).alias("f"), F.lit(1).alias("c"), F.col("award_date").alias("day"))).filter("entity_id IS NOT NULL").groupBy("entity_id").agg(F.sum("f").alias("events"), F.sum("c").alias("contracts"), F.max("day").alias("latest"), (F.max("day") >= F.date_sub(V.as_of(), 30)).alias("recent")))


def queries() -> dict:
    return dict(query.calls)


def oracle_sql() -> dict[str, str]:
    return dict(query.sql)
