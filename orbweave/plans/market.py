"""Queries of names, feeds, comparables, matched pairs, benchmarks and communities, each with its checking SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbweave.functions import text as T
from orbweave.functions.scalars import relative_distance
from orbweave.operators import alignment as A
from orbweave.operators import graph as G
from orbweave.operators import policy as P
from orbweave.operators import scoring as S
from orbweave.plans.analytics import _E, _PR, _UN, QUERIES, SQL, universe
from orbweave.plans.company import _ES, _STOP, _of_fiftieth, entry_states
from orbweave.plans.policy import _B as _BSC
from orbweave.plans.policy import _WP, scores
from orbweave.plans.policy import _P as _PSC
from orbweave.plans.registry import Registry
from orbweave.plans.resolution import _OBJ, _payload
from orbweave.session import cut
from orbweave.sources import views as V
from orbweave.sources.tables import sql, table

query = Registry()
_B = V.BASE_SQL
_quoted = lambda xs: ", ".join("'" + x + "'" for x in xs)
_j = lambda k: F.get_json_object("raw_data", f"$['{k}']")
_CASED = lambda c: f"array_to_string(list_transform(regexp_extract_all({c}, '\\p{{L}}+|\\P{{L}}+'), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), '')"

# names and texts
query("fnc_keyword_tags", "SELECT doc_id, concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(t, '{'|'.join(T.TAG_WORDS[k])}') THEN '{k}' END" for k in sorted(T.TAG_WORDS)) + ") AS tags FROM (SELECT doc_id, lower(concat_ws(' ', title, text)) t FROM documents)")(
    lambda s, d: table(s, d, "documents").select("doc_id", F.array_join(T.keyword_tags(F.concat_ws(" ", "title", "text")), ",").alias("tags")))
query("fnc_agency_names", _B + ", n AS (SELECT contract_value, CASE WHEN coalesce(contracting_agency, '') = '' THEN 'Unknown' ELSE coalesce(CASE lower(trim(contracting_agency)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.AGENCY_NAMES.items()) + " END, CASE " + " ".join(f"WHEN contains(lower(trim(contracting_agency)), '{k}') THEN '{v}'" for k, v in T.AGENCY_NAMES.items()) + f" ELSE {_CASED('trim(contracting_agency)')} END) END AS agency FROM c) SELECT agency, count(*)::BIGINT AS contracts, coalesce(sum(contract_value), 0)::DOUBLE AS total FROM n GROUP BY 1")(
    lambda s, d: V.contracts(s, d).groupBy(T.agency_name(F.col("contracting_agency")).alias("agency")).agg(F.count("*").alias("contracts"), F.coalesce(F.sum("contract_value"), F.lit(0)).cast("double").alias("total")))


def _display_sql() -> str:
    t = "SELECT id, " + _CASED("trim(canonical_name)") + " AS t FROM entities WHERE canonical_name IS NOT NULL"
    for wrong, right in T.NAME_ENDINGS:
        t = f"SELECT id, CASE WHEN suffix(t, '{wrong}') THEN left(t, len(t) - {len(wrong)}) || '{right}' ELSE t END AS t FROM ({t})"
    for wrong, right in T.NAME_PARTS:
        t = f"SELECT id, replace(t, '{wrong}', '{right}') AS t FROM ({t})"
    return f"SELECT id, t AS name FROM ({t})"


query("fnc_display_names", _display_sql())(lambda s, d: V.entities(s, d).filter("canonical_name IS NOT NULL").select("id", T.display_name(F.col("canonical_name")).alias("name")))
_SYN = "syn(term, other) AS (VALUES " + ", ".join(f"('{t}', '{o}')" for t, others in T.SYNONYMS.items() for o in others) + ")"
query("fnc_synonyms", _B + f", {_SYN}, x AS (SELECT id, unnest(technology_tags) t FROM startup), y AS (SELECT id, other FROM x JOIN syn ON term = t), z AS (SELECT * FROM x UNION SELECT * FROM y UNION SELECT id, unnest(string_split(other, ' ')) FROM y) SELECT id, string_agg(t, '|' ORDER BY t) AS terms FROM z GROUP BY 1")(
    lambda s, d: V.startups(s, d).filter(F.size("technology_tags") > 0).select("id", F.array_join(T.with_synonyms(F.col("technology_tags")), "|").alias("terms")))
query("src_sql", _B + " SELECT entity_id, count(*)::BIGINT AS n, max(contract_value) AS largest FROM contracts WHERE contract_value >= 1000000 GROUP BY 1")(
    lambda s, d: sql(s, d, "SELECT entity_id, count(*) AS n, max(contract_value) AS largest FROM {contracts} WHERE contract_value >= :least GROUP BY entity_id", ("contracts",), {"least": 1_000_000}))

# feeds
# Branches of the department, and what the air force goes by.
BRANCHES = (
    "Air Force", "Army", "Navy", "DARPA", "MDA", "SOCOM", "DLA", "DTRA", "NGA", "OSD", "Space Force", "CBD", "DISA", "DHP", "DCAA", "USSOCOM", "Missile Defense Agency", "Defense Advanced Research Projects Agency",
    "Defense Logistics Agency", "Defense Threat Reduction Agency", "National Geospatial-Intelligence Agency", "Office of the Secretary of Defense", "Chemical and Biological Defense Program", "Defense Information Systems Agency",
    "Defense Health Program", "AFRL", "AFMC", "AFOSR", "SPAWAR", "NAVAIR", "NAVSEA", "ONR", "NSWC",
)
AIR_FORCE = ("AIR FORCE", "USAF", "AF", "AFRL", "AFMC", "AFOSR")
_AWARD = "json_extract_string(raw_data, '$.\"Award Title\"')"


@query("flt_branch_awards", _B + f", j AS (SELECT id, upper(json_extract_string(raw_data, '$.Agency')) ag, upper(nullif(json_extract_string(raw_data, '$.Branch'), '')) br, trim(json_extract_string(raw_data, '$.\"Award Year\"')) y FROM f WHERE {_OBJ} AND {_AWARD} IS NOT NULL) SELECT id, coalesce(ag = 'DOD', false) OR coalesce(len(list_filter([{_quoted(b.upper() for b in BRANCHES)}], lambda x: contains(br, x) OR contains(x, br))) > 0, false) AS of_department, coalesce(len(list_filter([{_quoted(AIR_FORCE)}], lambda x: contains(br, x))) > 0, false) AS of_air_force, coalesce(regexp_full_match(y, '[0-9]{{4}}') AND try_cast(y AS INT) BETWEEN 2020 AND 2025, false) AS in_years FROM j")
def _branch_awards(spark: SparkSession, sf: str, first: int = 2020, last: int = 2025) -> DataFrame:
    """Award payloads by the filters of their feed: of the department (a branch within a listed one or the other way round), of one branch, of some years."""
    no, br, y = F.lit(False), F.nullif(F.upper(_j("Branch")), F.lit("")), F.trim(_j("Award Year"))
    listed = lambda names, test: F.coalesce(F.exists(F.array(*[F.lit(n.upper()) for n in names]), test), no)
    of = F.coalesce(F.upper(_j("Agency")) == "DOD", no) | listed(BRANCHES, lambda x: F.contains(br, x) | F.contains(x, br))
    years = F.coalesce(y.rlike("^[0-9]{4}$") & y.try_cast("int").between(first, last), no)
    return _payload(spark, sf, "Award Title").select("id", of.alias("of_department"), listed(AIR_FORCE, lambda x: F.contains(br, x)).alias("of_air_force"), years.alias("in_years"))


_FIRST = lambda *keys: "coalesce(" + ", ".join(f"nullif(trim(json_extract_string(raw_data, '$.\"{k}\"')), '')" for k in keys) + ")"
_CONTRACT, _TRACKING, _COMPANY, _YEAR, _TITLE = ("Contract", "contract", "Contract Number", "contract_number"), ("Agency Tracking Number", "agency_tracking_number"), ("Company", "company"), ("Award Year", "award_year"), ("Award Title", "award_title")
query("fnc_award_keys", _B + f" SELECT id, coalesce({_FIRST(*_CONTRACT)}, {_FIRST(*_TRACKING)}, {_FIRST(*_COMPANY)} || '_' || {_FIRST(*_YEAR)} || '_' || coalesce(substr({_FIRST(*_TITLE)}, 1, 50), '')) AS award_key FROM f WHERE {_OBJ} AND {_FIRST(*_TITLE)} IS NOT NULL")(lambda s, d: _award_keys(s, d))


def _award_keys(spark: SparkSession, sf: str) -> DataFrame:
    """What an award goes by: its contract's number, else the agency's, else company, year and the first fifty letters of its title (null without these)."""
    first = lambda keys: F.coalesce(*[F.nullif(F.trim(_j(k)), F.lit("")) for k in keys])
    f = V.funding(spark, sf).filter(F.try_parse_json("raw_data").isNotNull() & F.col("raw_data").rlike(r"^\s*\{")).withColumn("title", first(_TITLE)).filter("title IS NOT NULL")
    made = F.concat(first(_COMPANY), F.lit("_"), first(_YEAR), F.lit("_"), F.substring("title", 1, 50))
    return f.select("id", F.coalesce(first(_CONTRACT), first(_TRACKING), made).alias("award_key"))


# Industry codes, words in an issuer's name and groups that make a filing one of the domain.
INDUSTRY_CODES = ((3720, 3729), (3760, 3769), (3812, 3812), (7370, 7379))
ISSUER_WORDS = (
    "defense", "defence", "aerospace", "military", "tactical", "unmanned", "drone", "satellite", "radar", "missile", "hypersonic", "cyber", "intelligence", "surveillance", "reconnaissance", "autonomous", "quantum", "space",
    "avionics", "propulsion", "munitions", "armament", "directed energy", "laser weapon", "c4isr", "electronic warfare", "sonar", "stealth", "counter-uas", "anti-drone",
)
INDUSTRY_GROUPS = ("Technology", "Manufacturing")


@query("flt_relevant_filings", _B + f", j AS (SELECT id, try_cast(trim(json_extract_string(raw_data, '$.S_SIC_CODE')) AS INT) sic, trim(json_extract_string(raw_data, '$.O_INDUSTRYGROUPTYPE')) grp, lower(json_extract_string(raw_data, '$.I_ENTITYNAME')) issuer, amount FROM f WHERE {_OBJ} AND json_extract_string(raw_data, '$.ACCESSIONNUMBER') IS NOT NULL) SELECT id, issuer FROM j WHERE coalesce(" + " OR ".join(f"sic BETWEEN {a} AND {b}" for a, b in INDUSTRY_CODES) + f", false) OR (regexp_matches(issuer, '{'|'.join(ISSUER_WORDS)}') AND (coalesce(grp IN ('Technology', 'Manufacturing'), false) OR amount >= 500000))")
def _relevant_filings(spark: SparkSession, sf: str, least: int = 500_000) -> DataFrame:
    """Filings of the domain: by industry code, or by a word in the issuer's name with a fitting industry group or a fair amount."""
    sic = F.trim(_j("S_SIC_CODE")).try_cast("int")
    coded = F.coalesce(*[F.nullif(sic.between(a, b), F.lit(False)) for a, b in INDUSTRY_CODES], F.lit(False))
    f = _payload(spark, sf, "ACCESSIONNUMBER").withColumn("issuer", F.lower(_j("I_ENTITYNAME")))
    named = F.coalesce(F.col("issuer").rlike("|".join(ISSUER_WORDS)), F.lit(False)) & (F.coalesce(F.trim(_j("O_INDUSTRYGROUPTYPE")).isin(*INDUSTRY_GROUPS), F.lit(False)) | F.coalesce(F.col("amount") >= least, F.lit(False)))
    return f.filter(coded | named).select("id", "issuer")


query("ing_populations", _PSC + " SELECT entity_id, sbir_n > 0 AND core_business IS NOT NULL AND core_business <> 'UNCLASSIFIED' AND entity_id NOT IN (SELECT entity_id FROM sc) AS to_score, contract_n > 0 AND sbir_n = 0 AS contracts_only, coalesce(core_business, 'UNCLASSIFIED') = 'UNCLASSIFIED' AS to_classify FROM pr WHERE entity_type = 'STARTUP'")(lambda s, d: _populations(s, d))


def _populations(spark: SparkSession, sf: str) -> DataFrame:
    """Which runs an entity is due for: scores, a look at its contracts, a business."""
    have = scores(spark, sf).select("entity_id").distinct().withColumn("scored", F.lit(True))
    d = S.profile(spark, sf).filter("entity_type = 'STARTUP'").join(have, "entity_id", "left")
    named = F.coalesce("core_business", F.lit("UNCLASSIFIED")) != "UNCLASSIFIED"
    return d.select("entity_id", ((F.col("sbir_n") > 0) & named & F.col("scored").isNull()).alias("to_score"), F.expr("contract_n > 0 AND sbir_n = 0").alias("contracts_only"), (~named).alias("to_classify"))


# The businesses that are known.
BUSINESSES = ("RF_HARDWARE", "SOFTWARE", "SYSTEMS_INTEGRATOR", "AEROSPACE_PLATFORMS", "COMPONENTS", "SERVICES", "OTHER", "UNCLASSIFIED")
query("ing_valid_labels", f"SELECT CASE WHEN upper(trim(core_business)) IN ({_quoted(BUSINESSES)}) THEN upper(trim(core_business)) ELSE 'OTHER' END AS label, count(*)::BIGINT AS n, (count(*) FILTER (core_business IS NULL OR upper(trim(core_business)) NOT IN ({_quoted(BUSINESSES)})))::BIGINT AS unknown FROM entities GROUP BY 1")(
    lambda s, d: V.entities(s, d).withColumn("b", F.upper(F.trim("core_business"))).withColumn("ok", F.coalesce(F.col("b").isin(*BUSINESSES), F.lit(False))).groupBy(F.when(F.col("ok"), F.col("b")).otherwise("OTHER").alias("label")).agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("unknown")))

# problems
_TERMS = f"""list_distinct(list_concat(w, list_transform(regexp_extract_all(title, '\\b[A-Z][A-Z0-9-]{{1,8}}\\b'), lambda x: lower(x)), list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])))"""
_KOP = _B + f""", {_SYN}, ti AS (SELECT entity_id, title, list_filter(regexp_extract_all(lower(title), '[a-z][a-z-]+'), lambda w: len(w) > 2 AND w NOT IN {_STOP}) w FROM (SELECT DISTINCT entity_id, {_AWARD} AS title FROM f WHERE {_OBJ} AND {_AWARD} IS NOT NULL AND entity_id IN (SELECT id FROM startup))),
own AS (SELECT entity_id, unnest({_TERMS}) t FROM ti UNION SELECT entity_id, unnest(list_concat([lower(trim(tag)), replace(lower(trim(tag)), '_', ' ')], string_split(regexp_replace(lower(trim(tag)), '[_-]', ' ', 'g'), ' '))) FROM (SELECT id AS entity_id, unnest(technology_tags) tag FROM startup)),
sy AS (SELECT entity_id, other FROM own JOIN syn ON term = t), te AS (SELECT entity_id, t FROM own WHERE t <> '' UNION SELECT entity_id, other FROM sy UNION SELECT entity_id, unnest(string_split(other, ' ')) FROM sy),
fo(problem, rank, total, indicator, form) AS (VALUES {", ".join(str(x) for x in A.forms())}), wo(form, word, n) AS (VALUES {", ".join(str((x, w, len(A.words(x)))) for x in sorted({y[4] for y in A.forms()}) for w in sorted(A.words(x)))}),
hit AS (SELECT entity_id, form FROM te JOIN (SELECT DISTINCT form FROM fo) ON contains(t, form) UNION SELECT entity_id, form FROM te JOIN wo ON word = t GROUP BY entity_id, form, n HAVING count(*) = n),
per AS (SELECT entity_id, problem, rank, count(DISTINCT indicator)::DOUBLE / total * (1 - (rank - 1) * 0.05::DOUBLE) score, string_agg(DISTINCT indicator, ',' ORDER BY indicator) matches FROM hit JOIN fo USING (form) GROUP BY entity_id, problem, rank, total)"""


@query("sig_kop_alignment", _KOP + " SELECT entity_id, 'kop_alignment' AS signal_type, round(least(score, 1), 4) AS confidence, DATE '2026-03-01' AS detected_date, problem, matches FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY score DESC, rank) r FROM per) WHERE r = 1 AND score >= 0.25")
def kop_alignment(spark: SparkSession, sf: str, least: float = 0.25) -> DataFrame:
    """The operational problem that an entity's tags and award titles speak of most."""
    tags = V.startups(spark, sf).select(F.col("id").alias("entity_id"), F.explode("technology_tags").alias("tag")).filter("tag IS NOT NULL")
    titles = _payload(spark, sf, "Award Title").select("entity_id", _j("Award Title").alias("title")).distinct().join(V.startups(spark, sf).select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
    best = A.alignments(A.profile_terms(tags, titles)).filter(F.col("score") >= least)
    return best.select("entity_id", F.lit("kop_alignment").alias("signal_type"), F.round(F.least("score", F.lit(1.0)), 4).alias("confidence"), V.as_of().alias("detected_date"), "problem", F.array_join("matches", ",").alias("matches"))


# scores
# Weights of the list of prospects, and of the plain composite.
PROSPECT_WEIGHTS = {
    "sbir_to_contract_transition": 3.0, "rapid_contract_growth": 2.5, "sbir_to_vc_raise": 2.0, "outsized_award": 2.0, "sbir_phase_2_transition": 1.5, "sbir_phase_3_transition": 2.0, "multi_agency_interest": 1.5,
    "high_priority_technology": 1.0, "first_dod_contract": 1.0, "sbir_graduation_speed": 1.5, "time_to_contract": 2.0, "funding_velocity": 1.5, "sbir_stalled": -2.0, "customer_concentration": -1.5,
}
PLAIN_WEIGHTS = {
    "sbir_to_contract_transition": 3.0, "jar_funding": 3.0, "sbir_validated_raise": 2.5, "rapid_contract_growth": 2.5, "kop_alignment": 2.5, "meia_experimentation": 2.5, "sbir_to_vc_raise": 2.0, "outsized_award": 2.0,
    "time_to_contract": 2.0, "pae_portfolio_member": 2.0, "sbir_phase_2_transition": 1.5, "sbir_graduation_speed": 1.5, "multi_agency_interest": 1.5, "funding_velocity": 1.5, "commercial_pathway_fit": 1.5,
    "high_priority_technology": 1.0, "first_dod_contract": 1.0, "customer_concentration": -1.5, "sbir_lapse_risk": -1.5, "sbir_stalled": -2.0, "gone_stale": -1.5,
}
_case = lambda w: "CASE base_type " + " ".join(f"WHEN '{k}' THEN {v}::DECIMAL(3,1)" for k, v in w.items()) + " ELSE 0::DECIMAL(3,1) END"
_weight = lambda w: F.coalesce(F.create_map(*[x for k, v in w.items() for x in (F.lit(k), F.lit(v).cast("decimal(3,1)"))])[F.col("base_type")], F.lit(0).cast("decimal(3,1)"))
query("scr_prospect_composite", _B + f", w AS (SELECT entity_id, {_case(PROSPECT_WEIGHTS)} * coalesce(confidence, 0)::DECIMAL(3,2) v FROM s WHERE status = 'ACTIVE' AND entity_id IS NOT NULL) SELECT entity_id, round(sum(v), 2)::DOUBLE AS composite, coalesce(round(sum(v) FILTER (v > 0), 2), 0)::DOUBLE AS positive, coalesce(round(sum(v) FILTER (v < 0), 2), 0)::DOUBLE AS negative FROM w GROUP BY 1")(lambda s, d: _prospect_composite(s, d))


def _prospect_composite(spark: SparkSession, sf: str) -> DataFrame:
    """Weighted confidence of an entity's active signals, without age, split by sign; every signal counts."""
    v = _weight(PROSPECT_WEIGHTS) * F.coalesce("confidence", F.lit(0).cast("decimal(3,2)")).cast("decimal(3,2)")
    s = V.signals(spark, sf).filter("status = 'ACTIVE' AND entity_id IS NOT NULL").withColumn("v", v)
    r = lambda c: F.coalesce(F.round(F.sum(c), 2), F.lit(0)).cast("double")
    return s.groupBy("entity_id").agg(r(F.col("v")).alias("composite"), r(F.when(F.col("v") > 0, F.col("v"))).alias("positive"), r(F.when(F.col("v") < 0, F.col("v"))).alias("negative"))


query("scr_plain_composite", _B + f", w AS (SELECT id, max(freshness_weight) fw FROM signals GROUP BY 1) SELECT entity_id, sum({_case(PLAIN_WEIGHTS)} * coalesce(fw, 1)::DECIMAL(3,2))::DOUBLE AS composite FROM s JOIN w USING (id) WHERE status = 'ACTIVE' AND entity_id IS NOT NULL GROUP BY 1")(
    lambda s, d: V.signals(s, d).filter("status = 'ACTIVE' AND entity_id IS NOT NULL").join(table(s, d, "signals").groupBy("id").agg(F.max("freshness_weight").alias("fw")), "id").groupBy("entity_id").agg(F.sum(_weight(PLAIN_WEIGHTS) * F.coalesce("fw", F.lit(1).cast("decimal(3,2)")).cast("decimal(3,2)")).cast("double").alias("composite")))


@query("scr_execution_rank", _WP + ", x AS (SELECT entity_id, fresh_composite, coalesce(by_weight, 0) tail, CASE WHEN contract_n = 0 THEN 0 WHEN contract_total < 1000000 THEN 0.5::DOUBLE ELSE 1 END tier FROM pr JOIN comp USING (entity_id) LEFT JOIN tw USING (entity_id) WHERE entity_type = 'STARTUP') SELECT entity_id, round(0.55::DOUBLE * greatest(fresh_composite, 0) / (SELECT greatest(max(fresh_composite), 0.01::DOUBLE) FROM x) + 0.3::DOUBLE * tail + 0.15::DOUBLE * tier, 6) AS combined FROM x")
def execution_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Composite against the best of all, tailwind and the tier of contract value in one score."""
    tier = F.when(F.col("contract_n") == 0, 0.0).when(F.col("contract_total") < 1_000_000, 0.5).otherwise(1.0)
    d = S.profile(spark, sf).filter("entity_type = 'STARTUP'").join(S.composite(spark, sf).select("entity_id", "fresh_composite"), "entity_id").join(P.tailwinds(scores(spark, sf)).select("entity_id", "by_weight"), "entity_id", "left")
    d = d.select("entity_id", "fresh_composite", F.coalesce("by_weight", F.lit(0.0)).alias("tail"), tier.alias("tier"))
    top = d.agg(F.greatest(F.max("fresh_composite"), F.lit(0.01)).alias("top"))  # one row
    return d.crossJoin(F.broadcast(top)).select("entity_id", F.round(0.55 * F.greatest("fresh_composite", F.lit(0.0)) / F.col("top") + 0.3 * F.col("tail") + 0.15 * F.col("tier"), 6).alias("combined"))


_NEAR = lambda t, c, least: f"greatest(0, 1 - abs({c} - {t}) / {least})"


@query("rpt_comparables", _PSC + f""", tg AS (SELECT id AS entity_id, list_distinct(coalesce(technology_tags, [])) tags FROM act), x AS (SELECT pr.*, coalesce(tp.score, 0) top, tags FROM pr JOIN tg USING (entity_id) LEFT JOIN tp USING (entity_id) WHERE entity_type = 'STARTUP' AND sbir_n > 0),
m AS (SELECT t.entity_id, o.entity_id AS peer, round({_NEAR('t.sbir_n', 'o.sbir_n', 't.sbir_n::DOUBLE')} * 2 + CASE WHEN t.p2_n > 0 THEN {_NEAR('t.p2_n', 'o.p2_n', 't.p2_n::DOUBLE')} * 1.5::DOUBLE ELSE 0 END + CASE WHEN t.sbir_total > 0 THEN {_NEAR('t.sbir_total', 'o.sbir_total', 't.sbir_total')} ELSE 0 END + CASE WHEN t.top > 0 THEN {_NEAR('t.top', 'o.top', 'greatest(t.top, 0.1::DOUBLE)')} ELSE 0 END
 + CASE WHEN t.contract_n > 0 AND o.contract_n > 0 THEN 1.5::DOUBLE WHEN t.contract_n = 0 AND o.contract_n = 0 THEN 0.5::DOUBLE ELSE 0 END + CASE WHEN len(t.tags) > 0 AND len(o.tags) > 0 THEN len(list_intersect(t.tags, o.tags))::DOUBLE / len(list_distinct(list_concat(t.tags, o.tags))) * 2 ELSE 0 END, 6) AS similarity
 FROM x t JOIN x o ON o.sbir_n BETWEEN greatest(3, t.sbir_n // 2) AND greatest(20, 2 * t.sbir_n) AND o.entity_id <> t.entity_id WHERE o.p2_n >= 1 AND o.regd_n >= 1 AND ('0x' || right(t.entity_id, 2))::INT % 50 = 0 AND regexp_full_match(t.entity_id, '[0-9a-f-]{{36}}')) SELECT entity_id, peer, similarity FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY similarity DESC, peer) r FROM m) WHERE r <= 15""")
def comparables(spark: SparkSession, sf: str, n: int = 15, salts: int = 16) -> DataFrame:
    """For each company of the query set the n nearest of its size with second-phase awards and a raise.

    Sizes meet in powers of two, so a company is compared with its own order of size only; the pool's part of a size lies
    in salted parts, and each task keeps the n best of a company before they are shuffled.
    """
    top, tags = P.top_areas(scores(spark, sf)).select("entity_id", F.col("score").alias("top")), V.active(spark, sf).select(F.col("id").alias("entity_id"), F.array_distinct(F.coalesce("technology_tags", F.array().cast("array<string>"))).alias("tags"))
    x = S.profile(spark, sf).filter("entity_type = 'STARTUP' AND sbir_n > 0").join(top, "entity_id", "left").join(tags, "entity_id").select("entity_id", "sbir_n", "p2_n", "regd_n", "sbir_total", F.coalesce("top", F.lit(0.0)).alias("top"), "contract_n", "tags")
    size = lambda c: F.floor(F.log2(c)).cast("int")
    least, most = F.greatest(F.lit(3), F.floor(F.col("sbir_n") / 2)), F.greatest(F.lit(20), 2 * F.col("sbir_n"))
    t = _of_fiftieth(x, "entity_id").select(*[F.col(c).alias(f"t_{c}") for c in x.columns if c != "regd_n"], least.alias("least"), most.alias("most")).withColumn("size", F.explode(F.sequence(size(F.col("least")), size(F.col("most"))))).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    o = x.filter("p2_n >= 1 AND regd_n >= 1").withColumns({"size": size(F.col("sbir_n")), "salt": F.pmod(F.xxhash64("entity_id"), F.lit(salts)).cast("int")})
    near = lambda c, by=None: F.greatest(F.lit(0.0), 1 - F.abs(F.col(c) - F.col(f"t_{c}")) / (F.col(f"t_{c}") if by is None else by))
    both, either = F.size(F.array_intersect("t_tags", "tags")), F.size(F.array_union("t_tags", "tags"))
    s = near("sbir_n") * 2 + F.when(F.col("t_p2_n") > 0, near("p2_n") * 1.5).otherwise(0.0) + F.when(F.col("t_sbir_total") > 0, near("sbir_total")).otherwise(0.0) + F.when(F.col("t_top") > 0, near("top", F.greatest("t_top", F.lit(0.1)))).otherwise(0.0)
    s = s + F.when(F.expr("t_contract_n > 0 AND contract_n > 0"), 1.5).when(F.expr("t_contract_n = 0 AND contract_n = 0"), 0.5).otherwise(0.0) + F.when(F.expr("size(t_tags) > 0 AND size(tags) > 0"), both / either * 2).otherwise(0.0)
    m = t.join(o, ["size", "salt"]).filter("sbir_n BETWEEN least AND most AND entity_id <> t_entity_id").select(F.col("t_entity_id").alias("entity_id"), F.col("entity_id").alias("peer"), F.round(s, 6).alias("similarity"))
    return m.withColumn("r", F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("similarity"), "peer"))).filter(F.col("r") <= n).drop("r")


# fund
_CAND = _ES + ", a AS (SELECT p.*, es.r FROM es JOIN pr p USING (entity_id)), o AS (SELECT pr.* FROM pr JOIN un USING (entity_id) WHERE pr.entity_id NOT IN (SELECT entity_id FROM es)), cand AS (SELECT a.r, a.entity_id AS pick, o.entity_id AS twin, round(least(abs(log10(a.sbir_total + 1) - log10(o.sbir_total + 1)) / greatest(log10(a.sbir_total + 1), log10(o.sbir_total + 1), 1), 1) + least(abs(a.p2_n - o.p2_n)::DOUBLE / greatest(a.p2_n, o.p2_n, 1), 1) + (a.core_business IS DISTINCT FROM o.core_business)::INT, 6) AS distance FROM a, o)"
_GREEDY = _CAND.replace("WITH", "WITH RECURSIVE", 1) + ", g(r, used, x) AS (SELECT 0::BIGINT, []::VARCHAR[], NULL::STRUCT(distance DOUBLE, twin VARCHAR, pick VARCHAR) UNION ALL SELECT r, list_append(used, x.twin), x FROM (SELECT g.r + 1 AS r, used, (SELECT min({'distance': distance, 'twin': twin, 'pick': pick}) FROM cand WHERE cand.r = g.r + 1 AND NOT list_contains(g.used, twin)) AS x FROM g WHERE g.r < 20)), mp AS (SELECT x.pick AS entity_id, x.twin AS twin, x.distance AS distance FROM g WHERE x IS NOT NULL)"


def matched_pairs(spark: SparkSession, sf: str, n: int = 20) -> DataFrame:
    """(entity_id, twin, distance): the first n of the universe in order, each with the nearest of the rest that none before it took.

    A pick's twin is among its n nearest, as at most n - 1 of them are taken, so the choice one after another is made over n lists of n.
    """
    u, p = universe(spark, sf).select("entity_id", "composite"), S.profile(spark, sf).select("entity_id", "sbir_total", "p2_n", "core_business")
    first = u.orderBy(F.desc("composite"), "entity_id").limit(n).withColumn("r", F.row_number().over(Window.orderBy(F.desc("composite"), "entity_id")))  # n rows
    a = first.join(p, "entity_id").select("r", F.col("entity_id").alias("pick"), F.col("sbir_total").alias("s"), F.col("p2_n").alias("k"), F.col("core_business").alias("b"))
    pool = u.join(F.broadcast(first.select("entity_id")), "entity_id", "left_anti").join(p, "entity_id")
    far = relative_distance(T.safe_log(F.col("s")), T.safe_log(F.col("sbir_total"))) + relative_distance(F.col("k").cast("double"), F.col("p2_n").cast("double")) + (~F.col("b").eqNullSafe(F.col("core_business"))).cast("int")
    d = pool.crossJoin(F.broadcast(a)).select("r", "pick", F.col("entity_id").alias("twin"), F.round(far, 6).alias("distance"))
    near = d.withColumn("i", F.row_number().over(Window.partitionBy("r").orderBy("distance", "twin"))).filter(F.col("i") <= n)
    lists = near.groupBy("r", "pick").agg(F.array_sort(F.collect_list(F.struct("distance", "twin"))).alias("near")).agg(F.array_sort(F.collect_list(F.struct("r", "pick", "near"))).alias("picks"))
    kind = "array<struct<pick:string,twin:string,distance:double>>"

    def take(taken, x):
        free = F.get(F.filter(x["near"], lambda c: ~F.array_contains(F.transform(taken, lambda y: y["twin"]), c["twin"])), F.lit(0))
        return F.when(free.isNull(), taken).otherwise(F.concat(taken, F.array(F.struct(x["pick"].alias("pick"), free["twin"].alias("twin"), free["distance"].alias("distance"))))).cast(kind)

    pairs = lists.select(F.explode(F.aggregate("picks", F.array().cast(kind), take)).alias("x"))
    return pairs.select(F.col("x.pick").alias("entity_id"), "x.twin", "x.distance")


query("fnd_matched_pairs", _GREEDY + " SELECT * FROM mp")(matched_pairs)


@query("fnd_performance", _GREEDY + ", mi AS (SELECT 'NEW_CONTRACT' kind, entity_id FROM c WHERE award_date >= DATE '2025-03-01' UNION SELECT 'FUNDING_RAISE', entity_id FROM f WHERE event_type IN ('REG_D_FILING','VC_ROUND') AND event_date >= DATE '2025-03-01'), k(kind) AS (VALUES ('NEW_CONTRACT'), ('FUNDING_RAISE')), h AS (SELECT kind, (SELECT count(*) FROM mp JOIN mi USING (entity_id) WHERE mi.kind = k.kind) a, (SELECT count(*) FROM mp JOIN mi ON mi.entity_id = twin WHERE mi.kind = k.kind) b, (SELECT count(*) FROM mp) n FROM k) SELECT kind, round(a * 100.0::DOUBLE / n, 2) AS pick_rate, round(b * 100.0::DOUBLE / n, 2) AS twin_rate, round((a - b) * 100.0::DOUBLE / n, 2) AS delta, (a - b) * 100.0::DOUBLE / n > 10 AS ahead FROM h")
def performance(spark: SparkSession, sf: str) -> DataFrame:
    """Hit rates of the picks and of their twins by kind of milestone, and whether the picks are ten points ahead."""
    since = F.lit("2025-03-01").cast("date")
    m = V.contracts(spark, sf).filter(F.col("award_date") >= since).select(F.lit("NEW_CONTRACT").alias("kind"), "entity_id").unionByName(V.funding(spark, sf).filter(F.col("event_type").isin("REG_D_FILING", "VC_ROUND") & (F.col("event_date") >= since)).select(F.lit("FUNDING_RAISE").alias("kind"), "entity_id")).distinct()
    pairs = cut(matched_pairs(spark, sf))  # at most twenty rows
    sides = pairs.select("entity_id", F.lit("pick").alias("side")).unionByName(pairs.select(F.col("twin").alias("entity_id"), F.lit("twin").alias("side")))
    hits = m.join(F.broadcast(sides), "entity_id").groupBy("kind").agg(F.count_if(F.col("side") == "pick").alias("a"), F.count_if(F.col("side") == "twin").alias("b"))
    kinds = spark.createDataFrame([("NEW_CONTRACT",), ("FUNDING_RAISE",)], "kind string")  # the kinds that are compared
    d = kinds.join(hits, "kind", "left").na.fill(0).crossJoin(F.broadcast(pairs.agg(F.count("*").alias("n"))))
    rate = lambda c: F.round(c * 100.0 / F.col("n"), 2)
    return d.select("kind", rate(F.col("a")).alias("pick_rate"), rate(F.col("b")).alias("twin_rate"), rate(F.col("a") - F.col("b")).alias("delta"), ((F.col("a") - F.col("b")) * 100.0 / F.col("n") > 10).alias("ahead"))


query("fnd_overview", _ES + " SELECT stage, count(*)::BIGINT AS n, floor(sum(round(composite * 100)::BIGINT)::DOUBLE * 100 / count(*) + 0.5::DOUBLE) / 10000 AS composite FROM es GROUP BY 1")(
    lambda s, d: entry_states(s, d).groupBy("stage").agg(F.count("*").alias("n"), (F.floor(F.sum(F.round(F.col("composite") * 100).cast("long")).cast("double") * 100 / F.count("*") + 0.5) / 10000).alias("composite")))

# benchmarks
# The areas, thresholds and periods of the benchmarks that come with the rules.
BENCHMARKS = {
    "space_force": (("space_resilience",), 0.5, 0.3, ("2017-01-01", "2019-12-31"), ("2020-01-01", "2022-12-31")),
    "nds_2018": (("autonomous_systems", "electronic_warfare", "jadc2"), 0.5, 0.3, ("2016-01-01", "2018-01-31"), ("2018-02-01", "2021-12-31")),
    "ukraine_drones_2022": (("autonomous_systems",), 0.5, 0.3, ("2020-01-01", "2022-02-28"), ("2022-03-01", "2024-12-31")),
}
_BENCH = _BSC + ", bm(config, most, a1, a2, b1, b2) AS (VALUES " + ", ".join(f"('{k}', {v[1]}::DOUBLE, DATE '{v[3][0]}', DATE '{v[3][1]}', DATE '{v[4][0]}', DATE '{v[4][1]}')" for k, v in BENCHMARKS.items()) + "), ba(config, area) AS (VALUES " + ", ".join(f"('{k}', '{a}')" for k, v in BENCHMARKS.items() for a in v[0]) + """),
best AS (SELECT config, st.id AS entity_id, coalesce(max(score), 0) best FROM ba CROSS JOIN startup st LEFT JOIN sc ON sc.area = ba.area AND sc.entity_id = st.id GROUP BY 1, 2), co AS (SELECT config, entity_id, CASE WHEN best >= 0.5 THEN 'cohort' ELSE 'control' END AS cohort FROM best WHERE best >= 0.5 OR best < 0.3),
be AS (SELECT config, cohort, CASE WHEN event_date BETWEEN a1 AND a2 THEN 'baseline' ELSE 'response' END AS period, count(*) FILTER (event_type = 'SBIR_PHASE_1')::BIGINT AS p1, count(*) FILTER (event_type = 'REG_D_FILING')::BIGINT AS regd, coalesce(sum(amount) FILTER (event_type = 'REG_D_FILING'), 0)::DOUBLE AS regd_capital FROM f JOIN co USING (entity_id) JOIN bm USING (config) WHERE event_date BETWEEN a1 AND a2 OR event_date BETWEEN b1 AND b2 GROUP BY 1, 2, 3)"""


def benchmarks(spark: SparkSession, sf: str, configs: dict = BENCHMARKS) -> DataFrame:
    """(config, cohort, period, p1, regd, regd_capital, few): events of the entities above one score and of those below another in two periods; one pass over the events for all configurations."""
    best = [F.coalesce(F.max(F.when(F.col("area").isin(*v[0]), F.col("score"))), F.lit(0.0)).alias(k) for k, v in configs.items()]
    b = V.startups(spark, sf).select(F.col("id").alias("entity_id")).join(scores(spark, sf), "entity_id", "left").groupBy("entity_id").agg(*best)
    side = lambda k, v: F.struct(F.lit(k).alias("config"), F.when(F.col(k) >= v[1], "cohort").when(F.col(k) < v[2], "control").alias("cohort"))
    co = b.select("entity_id", F.explode(F.array(*[side(k, v) for k, v in configs.items()])).alias("x")).select("entity_id", "x.*").filter("cohort IS NOT NULL")
    per = lambda k, v: F.struct(F.lit(k).alias("config"), *[F.lit(d).cast("date").alias(n) for n, d in zip(("a1", "a2", "b1", "b2"), (*v[3], *v[4]), strict=True)])
    f = V.funding(spark, sf).filter("event_date IS NOT NULL AND entity_id IS NOT NULL").select("entity_id", "event_type", "event_date", "amount", F.explode(F.array(*[per(k, v) for k, v in configs.items()])).alias("y")).select("*", "y.*")
    f = f.filter("event_date BETWEEN a1 AND a2 OR event_date BETWEEN b1 AND b2").withColumn("period", F.when(F.expr("event_date BETWEEN a1 AND a2"), "baseline").otherwise("response"))
    regd = F.col("event_type") == "REG_D_FILING"
    return f.join(co, ["entity_id", "config"]).groupBy("config", "cohort", "period").agg(F.count_if(F.col("event_type") == "SBIR_PHASE_1").alias("p1"), F.count_if(regd).alias("regd"), F.coalesce(F.sum(F.when(regd, F.col("amount"))), F.lit(0)).cast("double").alias("regd_capital"))


query("ben_configs", _BENCH + " SELECT *, p1 < 10 OR regd < 10 AS few FROM be")(lambda s, d: benchmarks(s, d).withColumn("few", F.expr("p1 < 10 OR regd < 10")))
_SIDE = lambda n, c, p: f"sum({n}) FILTER (cohort = '{c}' AND period = '{p}')"
_DIFF = lambda n: " - ".join(f"({_SIDE(n, c, 'response')} - {_SIDE(n, c, 'baseline')}) * 100.0::DOUBLE / nullif({_SIDE(n, c, 'baseline')}, 0)::DOUBLE" for c in ("cohort", "control"))


@query("ben_readings", _BENCH + f", d AS (SELECT config, round({_DIFF('p1')}, 4) AS p1_diff, round({_DIFF('regd_capital')}, 4) AS capital_diff FROM be GROUP BY 1) SELECT *, CASE WHEN p1_diff > 20 THEN 'disproportionate' WHEN abs(p1_diff) <= 20 THEN 'comparable' WHEN p1_diff < -20 THEN 'control faster' END AS p1_reading, CASE WHEN capital_diff > 100 THEN 'strong' WHEN capital_diff > 0 THEN 'modest' WHEN capital_diff <= 0 THEN 'not specific' END AS capital_reading FROM d")
def readings(spark: SparkSession, sf: str) -> DataFrame:
    """Difference of the change in per cent between cohort and control, in words by its size; null without a base."""
    part = lambda n, c, p: F.sum(F.when((F.col("cohort") == c) & (F.col("period") == p), F.col(n)))
    change = lambda n, c: (part(n, c, "response") - part(n, c, "baseline")) * 100.0 / F.nullif(part(n, c, "baseline").cast("double"), F.lit(0.0))
    d = benchmarks(spark, sf).groupBy("config").agg(*[F.round(change(n, "cohort") - change(n, "control"), 4).alias(a) for n, a in (("p1", "p1_diff"), ("regd_capital", "capital_diff"))])
    p1, capital = F.col("p1_diff"), F.col("capital_diff")
    return d.select("*", F.when(p1 > 20, "disproportionate").when(F.abs(p1) <= 20, "comparable").when(p1 < -20, "control faster").alias("p1_reading"), F.when(capital > 100, "strong").when(capital > 0, "modest").when(capital <= 0, "not specific").alias("capital_reading"))


query("out_stats", f"SELECT 'NEW_CONTRACT' AS kind, count(*)::BIGINT AS n, count(DISTINCT entity_id)::BIGINT AS entities FROM ({SQL['out_new_contract']}) UNION ALL SELECT 'FUNDING_RAISE', count(*), count(DISTINCT entity_id) FROM ({SQL['out_funding_raise']})")(
    lambda s, d: QUERIES["out_new_contract"](s, d).select("entity_id", F.lit("NEW_CONTRACT").alias("kind")).unionByName(QUERIES["out_funding_raise"](s, d).select("entity_id", F.lit("FUNDING_RAISE").alias("kind"))).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("entity_id").alias("entities")))

# communities
_ROUNDS = 4
_LABELS = _E + ", ud AS (SELECT DISTINCT source a, target b FROM ed WHERE source <> target UNION SELECT DISTINCT target, source FROM ed WHERE source <> target), l0 AS (SELECT DISTINCT a AS node, a AS label FROM ud)" + "".join(f", l{i + 1} AS (SELECT node, label FROM (SELECT node, label, row_number() OVER (PARTITION BY node ORDER BY sum(n) DESC, label) r FROM (SELECT a AS node, label, 1 n FROM ud JOIN l{i} ON b = node UNION ALL SELECT node, label, 1 FROM l{i}) GROUP BY 1, 2) WHERE r = 1)" for i in range(_ROUNDS))


@query("grf_communities", _LABELS + f" SELECT node, label AS community FROM l{_ROUNDS}")
def communities(spark: SparkSession, sf: str, rounds: int = _ROUNDS) -> DataFrame:
    """(node, community) by label propagation: each round a node takes the label that most of its neighbours and itself have, the smallest among equals.

    In place of greedy modularity, which needs the whole graph in one place. Votes are counted before they are shuffled by node.
    """
    e = G.all_edges(spark, sf).filter("source <> target").select("source", "target")
    both = cut(e.unionByName(e.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct())
    label = both.select(F.col("source").alias("node")).distinct().withColumn("label", F.col("node"))
    for _ in range(rounds):
        votes = both.join(label.withColumnRenamed("node", "target"), "target").select(F.col("source").alias("node"), "label").unionByName(label)
        label = votes.groupBy("node", "label").agg(F.count("*").alias("n")).groupBy("node").agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("label"))
    return label.select("node", F.col("label").alias("community"))


def queries() -> dict:
    return dict(query.calls)


def oracle_sql() -> dict[str, str]:
    return dict(query.sql)
