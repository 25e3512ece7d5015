"""Merge and consolidation queries: S2, S4, S6-S8, J12-J14, W7-W9, U1-U9 (but U3), A7-A11, A25, G12, G13."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.operators import merge
from cohortlens.plans.registry import query
from cohortlens.sources import keeping
from cohortlens.sources.shared import shared_path
from cohortlens.sources.readers import resolve_columns

C = F.col


@query("s02_resolve_columns", "SELECT o_orderkey AS record_id, o_custkey AS patient, o_orderpriority AS code FROM orders")
def _(t):
    return resolve_columns(t.orders, {"record_id": ["ECG_ID", "O_ORDERKEY"], "patient": ["ó_custkey"], "code": ["label"]}, {"code": "priority"})


@query("s06_upsert_table", "SELECT coalesce(o.k, c.k) AS k, CASE WHEN o.k IS NULL OR (c.k IS NOT NULL AND c.v > o.v) THEN c.v ELSE o.v END AS v FROM (SELECT o_custkey AS k, round(max(o_totalprice), 2) AS v FROM orders GROUP BY 1) o FULL JOIN (SELECT c_custkey AS k, c_acctbal * 30 AS v FROM customer) c ON o.k = c.k")
def _(t):
    target = t.orders.groupBy(C("o_custkey").alias("k")).agg(F.round(F.max("o_totalprice"), 2).alias("v"))
    return merge.upsert_table(target, t.customer.select(C("c_custkey").alias("k"), (C("c_acctbal") * 30).alias("v")), ["k"], C("s.v") > C("t.v"))


@query("s07_insert_if_absent", "SELECT o_custkey AS k, o_orderstatus AS s FROM orders WHERE o_orderstatus <> 'O' UNION ALL SELECT c_custkey, 'new' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def _(t):
    target = t.orders.filter("o_orderstatus <> 'O'").select(C("o_custkey").alias("k"), C("o_orderstatus").alias("s"))
    return merge.insert_if_absent(target, t.customer.select(C("c_custkey").alias("k"), F.lit("new").alias("s")), ["k"], C("s") == "F")


@query("s08_analysis_cache", "SELECT o_orderkey AS record_id, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 5 <> 0 THEN o_totalprice ELSE o_totalprice * 2 END AS value, o_orderkey % 2 = 0 AND o_orderkey % 5 <> 0 AS cached FROM orders")
def _(t):
    rec = t.orders.select(C("o_orderkey").alias("record_id"), "o_totalprice")
    cache = rec.select("record_id", F.expr("case when record_id % 2 = 0 then 'v2' else 'v1' end").alias("fingerprint"), F.expr("case when record_id % 5 <> 0 then o_totalprice end").alias("value"))
    return merge.analysis_cache(rec, cache, "record_id", "v2", lambda d: d.withColumn("value", C("o_totalprice") * 2))


@query("s08_analysis_cache_table", "SELECT o_orderkey AS record_id, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 5 <> 0 THEN o_totalprice ELSE o_totalprice * 2 END AS value, o_orderstatus = 'F' AND o_orderkey % 5 <> 0 AS cached FROM orders")
def _(t):
    # A first run keeps what it has of some records, unsound results among it; another engine's results are no matter.
    rec, path = t.orders.select(C("o_orderkey").alias("record_id"), "o_totalprice", "o_orderstatus"), shared_path(t.spark, "cache")
    before = lambda d: d.select("record_id", F.when(C("record_id") % 5 != 0, C("o_totalprice")).alias("value"))
    keeping.cached_analysis(rec.filter("o_orderstatus = 'F'"), path, "record_id", "v2", before)
    keeping.cached_analysis(rec, path, "record_id", "v1", lambda d: d.select("record_id", F.lit(0.0).alias("value")))
    return keeping.cached_analysis(rec, path, "record_id", "v2", lambda d: d.select("record_id", (C("o_totalprice") * 2).alias("value")))


@query("j12_fallback_chain", "WITH p AS (SELECT p_partkey AS med_id, 'published' AS level, p_brand AS v FROM part WHERE p_type IN ('PROMO', 'ECONOMY')), l AS (SELECT s_suppkey AS med_id, 'local' AS level, s_name AS v FROM supplier), a AS (SELECT * FROM p UNION ALL SELECT * FROM l WHERE med_id NOT IN (SELECT med_id FROM p)) SELECT p_partkey AS med_id, v, coalesce(level, 'none') AS level FROM part LEFT JOIN a ON a.med_id = p_partkey")
def _(t):
    published = t.cat.filter("class in ('PROMO', 'ECONOMY')").select("med_id", C("brand").alias("v"))
    return merge.fallback_chain(t.cat, [("published", published), ("local", t.supplier.select(C("s_suppkey").alias("med_id"), C("s_name").alias("v")))], "med_id")


@query("j13_nested_lookup", "SELECT o_orderkey AS k, coalesce(n, 0) AS n, coalesce(line, '') AS line FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, string_agg(l_linenumber || ':' || l_returnflag, ',' ORDER BY l_linenumber, l_returnflag) AS line FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def _(t):
    child = t.lineitem.select(C("l_orderkey").alias("k"), C("l_linenumber").alias("line_no"), C("l_returnflag").alias("flag"))
    out = merge.nested_lookup(t.orders.select(C("o_orderkey").alias("k")), child, "k", ["line_no", "flag"], ["line_no", "flag"])
    return out.select("k", F.size("children").cast("bigint").alias("n"), F.array_join(F.transform("children", lambda x: F.concat(x["line_no"].cast("string"), F.lit(":"), x["flag"])), ",").alias("line"))


@query("j14_latest_lateral", "SELECT c_custkey AS k, o_orderkey, o_totalprice FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def _(t):
    latest = merge.best_record(t.orders, "o_custkey", [C("o_orderdate"), C("o_orderkey")], ["o_orderkey", "o_totalprice"])
    return t.customer.select(C("c_custkey").alias("k")).join(latest, C("k") == C("o_custkey"), "left").drop("o_custkey")


@query("j14_lateral_form", "SELECT c_custkey AS k, o_orderkey, o_totalprice FROM customer LEFT JOIN LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) ON true")
def _(t):
    return merge.latest_lateral(t.customer.select(C("c_custkey").alias("k")), t.orders, "k", "o_custkey", ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_totalprice"])


@query("w07_best_record", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderpriority = '1-URGENT') DESC, o_totalprice DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def _(t):
    return merge.best_record(t.orders, "o_custkey", [C("o_orderpriority") == "1-URGENT", C("o_totalprice"), C("o_orderkey")], ["o_orderkey"])


@query("w08_newest_label", "SELECT o_orderpriority AS name, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS label_id FROM orders GROUP BY 1")
def _(t):
    return merge.best_record(t.orders.withColumnRenamed("o_orderpriority", "name"), "name", [C("o_orderdate"), C("o_orderkey")], ["o_orderkey"]).withColumnRenamed("o_orderkey", "label_id")


@query("w09_priority_evidence", "SELECT l_partkey AS med_id, l_returnflag AS source_kind, l_linestatus AS decision FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY CASE l_returnflag WHEN 'A' THEN 3 WHEN 'R' THEN 2 ELSE 1 END DESC, l_orderkey * 10 + l_linenumber, l_linestatus DESC) AS r FROM lineitem) WHERE r = 1")
def _(t):
    ev = t.lineitem.groupBy(C("l_partkey").alias("med_id"), C("l_returnflag").alias("source_kind"), (C("l_orderkey") * 10 + C("l_linenumber")).alias("seq")).agg(F.max("l_linestatus").alias("decision"))
    return merge.priority_evidence(ev, {"A": 3, "R": 2, "N": 1})


@query("u01_overlay_merge", "SELECT coalesce(c_custkey, s_suppkey) AS k, coalesce(s.name, c.c_name) AS name, c.c_name AS name_original, CASE WHEN s_suppkey IS NULL THEN 'base' WHEN c_custkey IS NULL THEN 'new_reviewed' ELSE 'reviewed' END AS origin FROM (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING') c FULL JOIN (SELECT s_suppkey, CASE WHEN s_suppkey % 5 > 0 THEN s_name END AS name FROM supplier) s ON c_custkey = s_suppkey")
def _(t):
    base = t.customer.filter("c_mktsegment <> 'BUILDING'").select(C("c_custkey").alias("k"), C("c_name").alias("name"))
    return merge.overlay_merge(base, t.supplier.select(C("s_suppkey").alias("k"), F.when(C("s_suppkey") % 5 > 0, C("s_name")).alias("name")), "k", ["name"])


@query("u02_merge_nonempty", "SELECT o_custkey AS k, arg_max(a, o_orderkey) FILTER (a <> '') AS a, arg_max(b, o_orderkey) FILTER (b <> '') AS b FROM (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE '' END AS a, CASE WHEN o_orderkey % 4 = 0 THEN o_orderstatus END AS b FROM orders) GROUP BY 1")
def _(t):
    df = t.orders.select(C("o_custkey").alias("k"), "o_orderkey", F.expr("case when o_orderkey % 3 = 0 then o_orderpriority else '' end").alias("a"), F.expr("case when o_orderkey % 4 = 0 then o_orderstatus end").alias("b"))
    return merge.merge_nonempty(df, "k", "o_orderkey", ["a", "b"])


@query("u04_source_union", "SELECT p_partkey AS med_id, p_name AS name, p_brand AS brand, NULL AS nation, 'catalog' AS source_kind FROM part UNION ALL SELECT s_suppkey, s_name, NULL, CAST(s_nationkey AS VARCHAR), 'supplier' FROM supplier")
def _(t):
    return merge.source_union({"catalog": t.part.select(C("p_partkey").alias("med_id"), C("p_name").alias("name"), C("p_brand").alias("brand")), "supplier": t.supplier.select(C("s_suppkey").alias("med_id"), C("s_name").alias("name"), C("s_nationkey").cast("string").alias("nation"))})


def matrix(t):
    ids = lambda cond: t.cat.filter(cond).select("med_id")
    return merge.resolution_matrix(t.cat, {"label": ids("class = 'ECONOMY'"), "agency": ids("size <= 25"), "ward": ids("price > 910")}, {"ward"})


_MATRIX = "SELECT med_id, label, agency, ward, CAST(label AS INT) + CAST(agency AS INT) AS n_official, CASE WHEN label AND agency THEN 'multi' WHEN label OR agency THEN 'single' WHEN ward THEN 'local_only' ELSE 'pending' END AS resolution FROM (SELECT p_partkey AS med_id, p_type = 'ECONOMY' AS label, p_size <= 25 AS agency, p_retailprice > 910 AS ward FROM part)"


@query("u05_resolution_matrix", _MATRIX)
def _(t):
    return matrix(t)


@query("u06_multi_source_adjudication", "SELECT med_id, n_sources, n_families, CASE WHEN n_sources = 0 THEN 'no_evidence' WHEN n_sources = 1 THEN 'single' WHEN n_families = 1 THEN 'concordant' ELSE 'conflict' END AS adjudication FROM (SELECT l_partkey AS med_id, count(DISTINCT l_returnflag) FILTER (l_discount > 0.08) AS n_sources, count(DISTINCT l_linestatus) FILTER (l_discount > 0.08) AS n_families FROM lineitem GROUP BY 1)")
def _(t):
    return merge.multi_source_adjudication(t.lineitem.select(C("l_partkey").alias("med_id"), C("l_returnflag").alias("source_kind"), C("l_linestatus").alias("family"), (C("l_discount") > 0.08).alias("accepted")))


@query("u07_resolved_pending_split", f"SELECT CASE WHEN resolution IN ('multi', 'single') THEN 'resolved' ELSE 'pending' END AS part, count(*) AS n, (SELECT count(*) FROM part) AS total FROM ({_MATRIX}) m GROUP BY 1")
def _(t):
    return merge.split_with_proof(matrix(t), C("resolution").isin("multi", "single"))


@query("u08_code_set_ops", "WITH e AS (SELECT o_custkey AS k, list_sort(list(DISTINCT o_orderpriority)) AS e FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1), f AS (SELECT o_custkey AS k, list_sort(list(DISTINCT o_orderpriority)) AS f FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1), b AS (SELECT coalesce(e.k, f.k) AS k, coalesce(e, []) AS e, coalesce(f, []) AS f FROM e FULL JOIN f ON e.k = f.k) SELECT k, array_to_string([x FOR x IN e IF list_contains(f, x)], ',') AS common, array_to_string([x FOR x IN e IF NOT list_contains(f, x)], ',') AS missing, array_to_string([x FOR x IN f IF NOT list_contains(e, x)], ',') AS extra, list_has_all(f, e) AS complete, array_to_string([x FOR x IN f IF x IN ('5-LOW')], ',') AS forbidden FROM b")
def _(t):
    codes = t.orders.select(C("o_custkey").alias("k"), C("o_orderpriority").alias("code"), "o_orderstatus")
    return merge.code_set_ops(codes.filter("o_orderstatus <> 'O'"), codes.filter("o_orderstatus <> 'F'"), "k", ["5-LOW"])


@query("u09_candidate_dedupe", "SELECT l_orderkey AS record_id, l_linestatus AS domain, l_returnflag AS code, round(max(l_discount), 6) AS score, count(*) AS n, string_agg(DISTINCT CAST(l_linenumber AS VARCHAR), ',' ORDER BY CAST(l_linenumber AS VARCHAR)) AS sources FROM lineitem GROUP BY 1, 2, 3")
def _(t):
    return merge.candidate_dedupe(t.lineitem.select(C("l_orderkey").alias("record_id"), C("l_linestatus").alias("domain"), C("l_returnflag").alias("code"), C("l_discount").alias("score"), C("l_linenumber").cast("string").alias("source")))


@query("a07_coverage_counts", "SELECT 'orders' AS module, o_orderstatus AS status, count(*) AS n_rows, count(DISTINCT o_custkey) AS n_drugs FROM orders GROUP BY ALL UNION ALL SELECT 'lines', l_linestatus, count(*), count(DISTINCT l_partkey) FROM lineitem GROUP BY ALL")
def _(t):
    return merge.coverage_counts({"orders": t.orders.select(C("o_custkey").alias("med_id"), C("o_orderstatus").alias("status")), "lines": t.lineitem.select(C("l_partkey").alias("med_id"), C("l_linestatus").alias("status"))})


@query("a08_indication_rollup", "SELECT l_partkey AS indication, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS routes, count(*) AS n_rules, count(*) FILTER (l_linestatus = 'F') AS n_published, count(*) FILTER (l_linestatus <> 'F') AS n_pending FROM lineitem GROUP BY 1")
def _(t):
    return merge.indication_rollup(t.lineitem.select(C("l_partkey").alias("indication"), C("l_returnflag").alias("route"), F.when(C("l_linestatus") == "F", "PUBLISHED").otherwise("DRAFT").alias("status")))


@query("a09_reason_histogram", "SELECT lang, quality, count(*) AS n FROM lab GROUP BY ALL")
def _(t):
    return merge.reason_histogram(t.lab, ["lang", "quality"])


@query("a10_evidence_signature_counts", "WITH s AS (SELECT l_orderkey, string_agg(DISTINCT l_returnflag || l_linestatus, '+' ORDER BY l_returnflag || l_linestatus) AS signature FROM lineitem GROUP BY 1) SELECT 'set' AS kind, signature, count(*) AS n FROM s GROUP BY ALL UNION ALL SELECT 'item', i, count(*) FROM (SELECT DISTINCT l_orderkey, l_returnflag || l_linestatus AS i FROM lineitem) GROUP BY ALL")
def _(t):
    return merge.evidence_signatures(t.lineitem.select(C("l_orderkey").alias("record_id"), F.concat("l_returnflag", "l_linestatus").alias("item")))


@query("a11_shard_merge", "SELECT o_orderpriority AS code, CAST(count(*) AS BIGINT) AS n, 1 AS missing_shards FROM orders GROUP BY 1")
def _(t):
    parts = t.orders.groupBy(C("o_orderpriority").alias("code"), F.expr("instr('FOP', o_orderstatus) - 1").alias("shard")).agg(F.count("*").alias("n"))
    return merge.shard_merge(parts, ["code"], 4)


@query("a25_entity_summary", "SELECT c_custkey AS k, coalesce(n, 0) AS orders_rows, coalesce(p, 0) AS orders_published, coalesce(p, 0) > 0 AS has_orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS p FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def _(t):
    return merge.entity_summary(t.customer.withColumnRenamed("c_custkey", "k"), {"orders": t.orders.select(C("o_custkey").alias("k"), F.when(C("o_orderstatus") == "F", "PUBLISHED").otherwise("DRAFT").alias("status"))}, "k")


@query("g12_total_invariants", "SELECT 'catalog' AS name, count(*) AS n, 2000 AS expected, count(*) = 2000 AS ok FROM part UNION ALL SELECT 'suppliers', count(*), 7, count(*) = 7 FROM supplier")
def _(t):
    return merge.total_invariants({"catalog": t.part, "suppliers": t.supplier}, {"catalog": 2000, "suppliers": 7})


@query("g12_publish_checked", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def _(t):
    # Sizes add up in the action that writes; what is read is what was published.
    folder = shared_path(t.spark, "published")
    frames = {"orders": t.orders, "open": t.orders.filter("o_orderstatus = 'O'"), "rest": t.orders.filter("o_orderstatus <> 'O'")}
    keeping.publish_checked(frames, folder, {}, {"orders": ["open", "rest"]})
    both = keeping.read_published(t.spark, folder, "open").unionByName(keeping.read_published(t.spark, folder, "rest"))
    return both.groupBy(C("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query("g13_module_coverage_audit", "SELECT * FROM (SELECT c_custkey AS k, CAST(a AS INT) + CAST(b AS INT) AS n_missing, array_to_string([x FOR x IN [CASE WHEN a THEN 'orders' END, CASE WHEN b THEN 'urgent' END] IF x IS NOT NULL], ',') AS missing FROM (SELECT c_custkey, c_custkey NOT IN (SELECT o_custkey FROM orders) AS a, c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') AS b FROM customer)) WHERE n_missing > 0")
def _(t):
    k = t.orders.withColumnRenamed("o_custkey", "k")
    return merge.module_coverage_audit(t.customer.withColumnRenamed("c_custkey", "k"), {"orders": k, "urgent": k.filter("o_orderpriority = '1-URGENT'")}, "k")
