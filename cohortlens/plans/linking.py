"""Text and linkage queries: P1-P15, J2-J8, J21-J23, U3, W10, W13, W14, G11."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.functions import text as X
from cohortlens.operators import link
from cohortlens.plans.registry import query

_FOLD = lambda c: f"trim(regexp_replace(translate(lower({c}), '{X.MARKED}', '{X.PLAIN}'), '\\s+', ' ', 'g'))"
_SIM = lambda a, b: f"CASE WHEN greatest(length({a}), length({b})) = 0 THEN 100.0::DOUBLE ELSE 100.0::DOUBLE * (1 - levenshtein({a}, {b}) / greatest(length({a}), length({b}))) END"


@query("p01_fold_text", f"SELECT doc_id, length(f) AS n, md5(f) AS digest FROM (SELECT doc_id, {_FOLD('text')} AS f FROM documents)")
def _(t):
    return t.documents.select("doc_id", X.fold_text(F.col("text")).alias("f")).select("doc_id", F.length("f").alias("n"), F.md5("f").alias("digest"))


@query("p02_norm_drug_name", f"SELECT p_partkey AS med_id, trim(regexp_replace(regexp_replace(regexp_replace(upper({_FOLD('n')}), '&', ' / ', 'g'), '[^A-Z0-9/+ ]', ' ', 'g'), ' +', ' ', 'g')) AS name FROM (SELECT p_partkey, p_name || ' & (' || p_type || ') + ' || p_brand || '-é' AS n FROM part)")
def _(t):
    return t.part.select(F.col("p_partkey").alias("med_id"), X.norm_drug_name(F.expr("p_name || ' & (' || p_type || ') + ' || p_brand || '-é'")).alias("name"))


@query("p03_translate_tokens", "SELECT p_partkey AS med_id, array_to_string([CASE x WHEN 'red' THEN 'rojo' WHEN 'small' THEN 'chico' WHEN 'gear' THEN 'engrane' ELSE x END FOR x IN string_split(p_name, ' ') IF x <> ''], ' ') AS name FROM part")
def _(t):
    return t.part.select(F.col("p_partkey").alias("med_id"), X.translate_tokens(F.col("p_name"), {"red": "rojo", "small": "chico", "gear": "engrane"}).alias("name"))


@query("p04_strip_salts", "SELECT p_partkey AS med_id, array_to_string([x FOR x IN string_split(p_name, ' ') IF x NOT IN ('', 'hot', 'old')], ' ') AS name FROM part")
def _(t):
    return t.part.select(F.col("p_partkey").alias("med_id"), X.strip_salts(F.col("p_name"), ["hot", "old"]).alias("name"))


@query("p05_split_combination", "SELECT part, count(*) AS n FROM (SELECT unnest([trim(x) FOR x IN string_split_regex(p_name || ' / ' || p_type || ' Y ' || p_brand, '/|\\+| Y ') IF trim(x) <> '']) AS part FROM part) GROUP BY 1")
def _(t):
    return t.part.select(F.explode(X.split_combination(F.expr("p_name || ' / ' || p_type || ' Y ' || p_brand"))).alias("part")).groupBy("part").agg(F.count("*").alias("n"))


@query("p06_clinical_text_windows")
def _(t):
    return link.text_windows(t.documents, "doc_id", "text", "licen[cs]ed|license", skip="copyright")


@query("p07_classify_text_cascade", "SELECT doc_id, CASE WHEN NOT regexp_matches(text, '(?i)the|der|les|las') THEN 'no_mention' WHEN regexp_matches(text, '(?i)licensed under .{0,40}version') THEN 'no_adjustment' WHEN regexp_matches(text, '[#$%&*]{3}') THEN 'not_recommended' WHEN regexp_matches(text, '[0-9]{3}.{0,20}[0-9]{3}') THEN 'threshold' ELSE 'mention_only' END AS decision FROM documents")
def _(t):
    c = F.col("text")
    m = lambda p: F.rlike(c, F.lit(p))
    rules = [("no_mention", ~m("(?i)the|der|les|las")), ("no_adjustment", m("(?i)licensed under .{0,40}version")), ("not_recommended", m("[#$%&*]{3}")), ("threshold", m("[0-9]{3}.{0,20}[0-9]{3}"))]
    return t.documents.select("doc_id", X.cascade(c, rules, "mention_only").alias("decision"))


@query("p08_action_family", "SELECT CASE WHEN contains(source, '1') THEN 'avoid' WHEN contains(source, '2') THEN 'adjust' WHEN contains(source, '3') THEN 'dialysis' ELSE 'none' END AS family, count(*) AS n FROM lab GROUP BY 1")
def _(t):
    has = lambda s: F.contains(F.col("source"), F.lit(s))
    return t.lab.groupBy(X.cascade(F.col("source"), [("avoid", has("1")), ("adjust", has("2")), ("dialysis", has("3"))], "none").alias("family")).agg(F.count("*").alias("n"))


@query("p09_extract_category", "SELECT doc_id, upper(coalesce(nullif(regexp_extract(text, 'Licensed under the ([A-Za-z]+)', 1), ''), nullif(regexp_extract(text, '([a-z]+) = \"', 1), ''), '')) AS category FROM documents")
def _(t):
    return t.documents.select("doc_id", X.extract_category(F.col("text"), ["Licensed under the ([A-Za-z]+)", '([a-z]+) = "']).alias("category"))


@query("p10_identity_triage", "SELECT kind, count(*) AS n FROM (SELECT CASE WHEN contains(n, '+') OR contains(n, '/') THEN 'combination' WHEN list_has_any(string_split(n, ' '), ['ring']) THEN 'ester' WHEN list_has_any(string_split(n, ' '), ['red', 'hot']) THEN 'salt' WHEN list_has_any(string_split(n, ' '), ['old']) THEN 'ambiguous' WHEN regexp_matches(n, '(ato|ate|ine|ide)$') THEN 'suffix_review' ELSE 'plain' END AS kind FROM (SELECT CASE WHEN p_partkey % 10 = 0 THEN p_name || ' + x' ELSE p_name END AS n FROM part)) GROUP BY 1")
def _(t):
    name = F.expr("case when p_partkey % 10 = 0 then p_name || ' + x' else p_name end")
    return t.part.groupBy(link.identity_triage(name, ["red", "hot"], ["ring"], ["old"]).alias("kind")).agg(F.count("*").alias("n"))


@query("p11_parse_packed_codes", "SELECT code, count(*) AS n FROM (SELECT unnest([regexp_replace(trim(x), '\\+Modifier.*$', '') FOR x IN string_split(replace(c, '''', ''), ';') IF regexp_replace(trim(x), '\\+Modifier.*$', '') <> '']) AS code FROM (SELECT '''' || o_orderpriority || '+Modifier' || (o_orderkey % 9) || '; J(111+112);' || o_orderstatus AS c FROM orders)) GROUP BY 1")
def _(t):
    packed = F.expr("'\\'' || o_orderpriority || '+Modifier' || (o_orderkey % 9) || '; J(111+112);' || o_orderstatus")
    return t.orders.select(F.explode(X.packed_codes(packed, r"\+Modifier.*$")).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


@query("p12_parse_likelihood_map", "SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) >= 80 AS positive FROM events")
def _(t):
    return t.events.select("event_id", X.likelihood_positive(F.col("props"), ["k", "other"]).alias("positive"))


@query("p13_plausible_or_null", "SELECT grp, count(*) AS n, count(CASE WHEN engine BETWEEN 950 AND 2400 THEN 1 END) AS n_engine, count(CASE WHEN qty BETWEEN 5 AND 40 THEN 1 END) AS n_qty FROM meas GROUP BY 1")
def _(t):
    m = t.meas.withColumns({"engine": X.plausible_or_null(F.col("engine"), 950, 2400), "qty": X.plausible_or_null(F.col("qty"), 5, 40)})
    return m.groupBy("grp").agg(F.count("*").alias("n"), F.count("engine").alias("n_engine"), F.count("qty").alias("n_qty"))


@query("p14_parse_numeric_locale", "SELECT p_partkey AS med_id, TRY_CAST(replace(trim(CASE p_partkey % 4 WHEN 0 THEN ' ' || replace(CAST(p_retailprice AS VARCHAR), '.', ',') WHEN 1 THEN '' WHEN 2 THEN p_name ELSE CAST(p_size AS VARCHAR) END), ',', '.') AS DOUBLE) AS value FROM part")
def _(t):
    raw = F.expr("case p_partkey % 4 when 0 then ' ' || replace(cast(p_retailprice as string), '.', ',') when 1 then '' when 2 then p_name else cast(p_size as string) end")
    return t.part.select(F.col("p_partkey").alias("med_id"), X.parse_number(raw).alias("value"))


@query("p15_anonymised_headers", "SELECT page_id, len(x) AS n_kept, len(x) >= 2 AS accepted FROM (SELECT page_id, [l FOR l IN string_split(replace(html, '>', '>' || chr(10)), chr(10)) IF regexp_matches(l, '^<(p|h1)')] AS x FROM pages)")
def _(t):
    kept = F.filter(F.split(F.expr("replace(html, '>', '>\\n')"), "\n"), lambda x: F.rlike(x, F.lit("^<(p|h1)")))
    return t.pages.select("page_id", F.size(kept).alias("n_kept")).withColumn("accepted", F.col("n_kept") >= 2)


# Headers as text: one of nine has too few fields, lines or a rate that is no number; others have other signals or rates.
_HEAD = "h AS (SELECT o_orderkey AS record_id, CASE o_orderkey % 9 WHEN 0 THEN 'r' || o_orderkey || ' 12' WHEN 1 THEN 'r 12 fast 5000' WHEN 2 THEN 'r 3 500 5000' WHEN 3 THEN 'r 12 250/360 5000' ELSE 'r' || o_orderkey || ' 12 500/1000 ' || (5000 + o_custkey % 10) END AS first, CASE WHEN o_orderkey % 9 = 4 THEN 7 WHEN o_orderkey % 9 = 2 THEN 3 ELSE 12 END AS m FROM orders)"


def headers(t):
    return t.spark.sql("SELECT record_id, first || chr(10) || repeat('sig.dat 16 1000' || chr(10), m) || CASE WHEN m = 7 THEN '' ELSE '# diagnosis: hidden' || chr(10) END AS text FROM (" + _HEAD[6:-1].replace("FROM orders", "FROM {orders}") + ")", orders=t.orders)


@query("p15_header_lines", f"WITH {_HEAD}, x AS (SELECT record_id, CASE WHEN m = 7 OR record_id % 9 < 2 THEN 'malformed' WHEN m = 3 THEN 'wrong_signals' WHEN record_id % 9 = 3 THEN 'wrong_rate' END AS reason, first || repeat(chr(10) || 'sig.dat 16 1000', m) AS kept, string_split(first, ' ') AS f FROM h) SELECT record_id, reason, CASE WHEN reason IS NULL THEN kept END AS kept, CASE WHEN reason IS NULL THEN CAST(f[4] AS BIGINT) END AS n_samples FROM x")
def _(t):
    return link.anonymised_headers(headers(t), "record_id", "text")


@query("p15_header_rejections", "SELECT CASE WHEN o_orderkey % 9 IN (0, 1, 4) THEN 'malformed' WHEN o_orderkey % 9 = 2 THEN 'wrong_signals' WHEN o_orderkey % 9 = 3 THEN 'wrong_rate' ELSE 'accepted' END AS reason, count(*) AS n FROM orders GROUP BY 1")
def _(t):
    return link.header_rejections(link.anonymised_headers(headers(t), "record_id", "text"))


@query("j02_name_or_id_lookup", f"SELECT p_partkey AS med_id, p_name AS generic_name, CASE WHEN p_type = 'ECONOMY' THEN 'id' WHEN {_FOLD('p_name')} IN (SELECT {_FOLD('p_name')} FROM part WHERE p_brand = 'Brand#7') THEN 'name' END AS supported_by FROM part")
def _(t):
    # One source knows ids of a class, the other names of a maker.
    src = t.cat.filter("class = 'ECONOMY'").select("med_id", F.lit(None).cast("string").alias("generic_name")).unionByName(t.cat.filter("brand = 'Brand#7'").select(F.lit(None).cast("bigint").alias("med_id"), F.upper("generic_name").alias("generic_name")))
    return link.name_or_id_lookup(t.cat.select("med_id", "generic_name"), src)


_SYN = [("1-urgent", "EMERGENCY"), ("2-HIGH", "EMERGENCY"), ("5-low", "ROUTINE")]


@query("j03_alias_join", "SELECT lower(o_orderpriority) AS phrase, count(*) AS n, CASE WHEN lower(o_orderpriority) IN ('1-urgent', '2-high') THEN 'EMERGENCY' WHEN lower(o_orderpriority) = '5-low' THEN 'ROUTINE' ELSE 'UNMAPPED' END AS target FROM orders GROUP BY ALL")
def _(t):
    return link.alias_join(t.orders.select(F.col("o_orderpriority").alias("phrase")), t.spark.createDataFrame(_SYN, "phrase string, target string"))


@query("j04_pattern_label_join", "WITH d AS (SELECT DISTINCT p_name AS code FROM part), l AS (SELECT code, 'heat' AS target FROM d WHERE contains(code, 'hot') OR contains(code, 'red') UNION ALL SELECT code, 'metal' FROM d WHERE (contains(code, 'bolt') OR contains(code, 'gear')) AND NOT contains(code, 'old')) SELECT target, count(*) AS n FROM part JOIN l ON p_name = code GROUP BY 1")
def _(t):
    codes = t.part.select(F.col("p_name").alias("code"), F.col("p_name").alias("description")).distinct()
    labels = link.pattern_labels(codes, {"heat": ["hot", "red"], "metal": ["bolt", "gear"]}, {"metal": ["old"]})
    return t.part.select(F.col("p_name").alias("code")).join(labels, "code").groupBy("target").agg(F.count("*").alias("n"))


_CAND = f"WITH n AS (SELECT DISTINCT p_name AS name FROM part), p AS (SELECT a.name, b.name AS candidate, round({_SIM('a.name', 'b.name')}, 4) AS score FROM n a JOIN n b ON list_has_any(string_split(a.name, ' '), string_split(b.name, ' ')) AND a.name <> b.name), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY name ORDER BY score DESC, candidate) AS INT) AS rank FROM p) "


def names(t):
    return t.part.select(F.col("p_name").alias("name"))


@query("j05_fuzzy_candidates", _CAND + "SELECT * FROM r WHERE rank <= 5")
def _(t):
    return link.fuzzy_candidates(names(t), names(t))


@query("j05_difflib_candidates")
def _(t):
    return link.fuzzy_candidates(names(t), names(t), link.difflib_ratio)


@query("j06_priority_review", _CAND + "SELECT name, candidate, score, second, score >= 60 AND score - coalesce(second, 0) >= 3 AS priority FROM (SELECT *, lead(score) OVER (PARTITION BY name ORDER BY rank) AS second FROM r WHERE rank <= 5) WHERE rank = 1")
def _(t):
    return link.priority_review(link.fuzzy_candidates(names(t), names(t)), 60.0, 3.0)


# A label carries all ingredients of its name and one more; names stand once, under their least key.
@query("j07_component_identity_join", "WITH c AS (SELECT p_partkey AS med_id, list_distinct(string_split(p_name, ' ')) AS parts FROM part), s AS (SELECT min(p_partkey) AS source_id, string_split(p_name || ' extra', ' ') AS ing FROM part GROUP BY p_name) SELECT med_id, source_id FROM c, s WHERE list_has_all(ing, parts) AND (len(parts) > 1 OR len(ing) = 1)")
def _(t):
    cat = t.part.select(F.col("p_partkey").alias("med_id"), F.array_distinct(F.split("p_name", " ")).alias("parts"))
    src = t.part.groupBy("p_name").agg(F.min("p_partkey").alias("source_id")).select("source_id", F.split(F.concat("p_name", F.lit(" extra")), " ").alias("ingredients"))
    return link.component_identity(cat, src)


# Codes are those of the economy class; the rest of the catalogue meets labels by name. Names are two different words, so a
# name with a token set alike to 96 is the same name or one with its words turned round.
@query("j08_crosswalk_identity", "WITH l AS (SELECT min(p_partkey) AS label_id, p_name AS name FROM part GROUP BY p_name), lc AS (SELECT l.label_id, p.p_brand AS code FROM l JOIN part p ON p.p_partkey = l.label_id WHERE p.p_type = 'ECONOMY'), c AS (SELECT DISTINCT p_partkey AS med_id, label_id FROM part JOIN lc ON p_brand = code WHERE p_type IN ('ECONOMY', 'PROMO')), r AS (SELECT p_partkey AS med_id, p_name AS name FROM part WHERE p_partkey NOT IN (SELECT med_id FROM c)), n AS (SELECT r.med_id, l.label_id FROM r JOIN l ON list_sort(string_split(r.name, ' ')) = list_sort(string_split(l.name, ' '))) SELECT med_id, label_id, 'codes' AS basis FROM c UNION ALL SELECT med_id, label_id, 'name' FROM n UNION ALL SELECT med_id, NULL, 'no_label' FROM r WHERE med_id NOT IN (SELECT med_id FROM n)")
def _(t):
    codes = lambda kinds: F.when(F.col("p_type").isin(kinds), F.array("p_brand")).otherwise(F.array().cast("array<string>")).alias("codes")
    cat = t.part.select(F.col("p_partkey").alias("med_id"), F.col("p_name").alias("name"), codes(["ECONOMY", "PROMO"]))
    first = t.part.groupBy("p_name").agg(F.min("p_partkey").alias("p_partkey"))
    lab = t.part.join(first, ["p_name", "p_partkey"]).select(F.col("p_partkey").alias("label_id"), F.col("p_name").alias("name"), codes(["ECONOMY"]))
    return link.crosswalk_identity(cat, lab)


@query("j21_match_confidence", f"WITH m AS (SELECT p_partkey AS med_id, lower(p_name) AS label, unnest([substr(p_name, 1, 4), lower(p_type)]) AS part, p_size * 2.0 AS lexical, p_retailprice % 100 AS terminology FROM part), s AS (SELECT med_id, part, max({_SIM('part', 'token')}) AS s FROM (SELECT *, unnest(string_split(label, ' ')) AS token FROM (SELECT med_id, label, unnest(string_split(part, ' ')) AS part FROM m)) WHERE token <> '' GROUP BY 1, 2), c AS (SELECT med_id, min(s) AS least FROM s GROUP BY 1), p AS (SELECT med_id, max(lexical) AS lexical, max(terminology) AS terminology, bool_or(least >= 72) AS covered FROM m JOIN c USING (med_id) GROUP BY 1) SELECT med_id, round(lexical, 6) AS lexical, round(terminology, 6) AS terminology, covered, CASE WHEN covered AND greatest(lexical, terminology) >= 92 THEN 'HIGH' WHEN covered OR greatest(lexical, terminology) >= 80 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM p")
def _(t):
    m = t.part.select(F.col("p_partkey").alias("med_id"), F.lower("p_name").alias("label"), F.split(F.concat_ws(" ", F.substring("p_name", 1, 4), F.lower("p_type")), " ").alias("parts"), (F.col("p_size") * 2.0).alias("lexical"), (F.col("p_retailprice") % 100).alias("terminology"))
    return link.match_confidence(m)


@query("j22_modifier_lookup", "SELECT DISTINCT l_orderkey AS patient_id, p_partkey AS med_id, p_brand AS modifier FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size % 2 = 0 AND p_type = 'ECONOMY'")
def _(t):
    meds = t.lineitem.select(F.col("l_orderkey").alias("patient_id"), F.col("l_partkey").alias("med_id"))
    mods = t.part.select(F.col("p_partkey").alias("med_id"), F.col("p_brand").alias("modifier"), F.expr("case when p_size % 2 = 0 then 'PUBLISHED' else 'DRAFT' end").alias("status"), F.col("p_type").alias("analyte"))
    return link.modifier_lookup(meds, mods, "ECONOMY")


@query("j23_reviewed_alias_rewrite", "SELECT p_partkey AS med_id, CASE p_name WHEN 'red bolt' THEN 'crimson bolt' WHEN 'hot gear' THEN 'warm gear' ELSE p_name END AS name, CASE WHEN p_name IN ('red bolt', 'hot gear') THEN 'reviewed_alias' ELSE 'as_is' END AS method FROM part")
def _(t):
    aliases = t.spark.createDataFrame([("red bolt", "crimson bolt"), ("hot gear", "warm gear")], "alias string, canonical string")
    return link.reviewed_alias_rewrite(t.cat.select("med_id", "generic_name"), aliases)


@query("u03_alias_key_explode", f"SELECT key, min(row_id) AS row_id FROM (SELECT p_partkey AS row_id, unnest([{_FOLD('x')} FOR x IN string_split_regex(p_name || ';' || p_type || ',' || p_brand || '|ab', '[;,/|]')]) AS key FROM part) WHERE length(key) >= 3 GROUP BY 1")
def _(t):
    return link.alias_keys(t.part.select(F.col("p_partkey").alias("row_id"), F.col("p_name").alias("name"), F.expr("p_type || ',' || p_brand || '|ab'").alias("aliases")))


@query("w10_section_top_k", "WITH s AS (SELECT conv_id AS doc, turn AS section, 60 * CAST(role = 'user' AS INT) + 30 * CAST(regexp_matches(text, 'the|les') AS INT) + least(30, len(regexp_extract_all(text, 'the|les')) * 10) AS score, md5(lower(text)) AS print FROM conversations), o AS (SELECT doc, print, arg_min(section, (-score, section)) AS section, max(score) AS score FROM s WHERE score >= 50 GROUP BY ALL) SELECT doc, section, CAST(score AS INT) AS score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY score DESC, section) AS rank FROM o) WHERE rank <= 4")
def _(t):
    return link.section_top_k(t.conversations.select(F.col("conv_id").alias("doc"), F.col("turn").alias("section"), F.col("role").alias("title"), F.col("text").alias("body")), "^user$", "the|les")


@query("w13_catalogue_search", "WITH q(query, f) AS (VALUES ('Bolt', 'bolt'), ('é red', 'e red'), ('HOT G', 'hot g'), ('brand#2', 'brand#2'), ('77', '77')), x AS (SELECT p_partkey, unnest([CAST(p_partkey AS VARCHAR), lower(p_name), lower(p_brand), lower(p_type)]) AS text FROM part), h AS (SELECT DISTINCT query, p_partkey FROM x JOIN q ON contains(text, f)) SELECT query, med_id, name, CAST(rank AS INT) AS rank FROM (SELECT query, p_partkey AS med_id, lower(p_name) AS name, row_number() OVER (PARTITION BY query ORDER BY lower(p_name), p_partkey) AS rank FROM h JOIN part USING (p_partkey)) WHERE rank <= 20")
def _(t):
    catalog = t.cat.withColumn("aliases", F.array("brand", "class"))
    return link.catalogue_search(t.spark.createDataFrame([("Bolt",), ("é red",), ("HOT G",), ("brand#2",), ("77",)], "query string"), catalog, ["med_id", "generic_name", "aliases"])


@query("w13_collated_search", "SELECT p_partkey AS med_id, p_name AS name, CAST(row_number() OVER (ORDER BY p_name, p_partkey) AS INT) AS rank FROM (SELECT * FROM part WHERE contains(lower(p_name), 'bolt') OR contains(lower(p_brand), 'bolt') ORDER BY p_name, p_partkey LIMIT 50)")
def _(t):
    found = link.collated_search(t.part, "p_partkey", ["p_name", "p_brand"], "BÓLT", 50)
    return found.select(F.col("p_partkey").alias("med_id"), "name", "rank")


@query("p01_fold_unicode")
def _(t):
    return t.documents.select("doc_id", X.fold_unicode(F.col("text")).alias("f")).select("doc_id", F.length("f").alias("n"), F.md5("f").alias("digest"))


@query("w14_literal_then_fuzzy_search", f"WITH q(query, f) AS (VALUES ('red bolt', 'red bolt'), ('Xmall ring', 'xmall ring'), ('widgte', 'widgte'), ('economi', 'economi'), ('zzz', 'zzz')), n AS (SELECT DISTINCT lower(p_name) AS name, unnest([lower(p_name), lower(p_brand), lower(p_type), CAST(p_size AS VARCHAR)]) AS text, unnest([true, false, true, false]) AS fuzzy FROM part), l AS (SELECT DISTINCT query, name FROM n JOIN q ON contains(text, f)), x AS (SELECT name, text FROM n WHERE fuzzy UNION SELECT name, token FROM (SELECT name, unnest(string_split(text, ' ')) AS token FROM n WHERE fuzzy) WHERE length(token) >= 4) SELECT query, name, 'literal' AS how FROM l UNION ALL SELECT DISTINCT query, name, 'fuzzy' FROM x JOIN q ON {_SIM('text', 'f')} >= 64 WHERE query NOT IN (SELECT query FROM l)")
def _(t):
    table = t.part.select(F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("class"), F.col("p_size").alias("size"))
    queries = t.spark.createDataFrame([("red bolt",), ("Xmall ring",), ("widgte",), ("economi",), ("zzz",)], "query string")
    return link.literal_then_fuzzy(queries, table, ["name", "brand", "class", "size"], ["name", "class"])


@query("g11_text_release_gate", f"SELECT doc_id, contains(f, 'mg/kg') AS weight_based, regexp_matches(f, 'diali|dialy') AS dialysis, regexp_matches(f, 'no (requiere )?ajuste|no adjust') AS no_adjustment, regexp_matches(f, ' o | or |alternativ') AS alternative, regexp_matches(f, 'titul|titrat') AS titration, NOT regexp_matches(f, '[0-9]') AS missing_quantity FROM (SELECT doc_id, {_FOLD('text')} AS f FROM documents)")
def _(t):
    return t.documents.select("doc_id", *[c.alias(n) for n, c in link.text_release_gate(F.col("text")).items()])
