"""The driver's tables as the engine's own tables: plain SELECTs that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Domain tables over the given ones. {ms:x} is a timestamp's milliseconds in each dialect.
ADAPTERS = {
    "coh": "SELECT o_orderkey AS record_id, o_custkey AS patient_id, c_nationkey AS site, o_orderpriority AS code, CAST(o_orderkey % 10 + 1 AS INT) AS fold, o_totalprice AS amount, o_orderstatus AS status, o_orderdate AS day FROM orders JOIN customer ON o_custkey = c_custkey",
    "meas": "SELECT l_orderkey AS record_id, l_linenumber AS lead, l_returnflag AS grp, l_linestatus AS run, l_extendedprice / l_quantity AS engine, p_retailprice AS comparator, 0.2 + 8 * l_discount AS confidence, l_quantity AS qty, l_tax AS tax FROM lineitem JOIN part ON l_partkey = p_partkey",
    "evts": "SELECT event_id, user_id AS record_id, event_type AS kind, {ms:ts} AS t_ms, value AS amplitude, props FROM events",
    "lab": "SELECT d.doc_id AS record_id, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id",
    "pred": "SELECT record_id, target, y, lang, n_chars, CAST(CASE WHEN n_chars >= cut THEN 1 ELSE 0 END AS INT) AS candidate, CAST(CASE WHEN n_chars >= 2 * cut THEN 1 ELSE 0 END AS INT) AS fusion, CAST(CASE WHEN n_chars >= 4 * cut THEN 1 ELSE 0 END AS INT) AS final FROM (SELECT doc_id AS record_id, 'quality' AS target, quality AS y, 300 AS cut, lang, n_chars FROM documents JOIN labels USING (doc_id) UNION ALL SELECT doc_id, 'toxic', toxic, 900, lang, n_chars FROM documents JOIN labels USING (doc_id)) x",
    "cat": "SELECT p_partkey AS med_id, p_name AS generic_name, p_brand AS brand, p_type AS class, p_size AS size, p_retailprice AS price FROM part",
    "pats": "SELECT c_custkey AS patient_id, CAST(c_custkey % 95 + 1 AS DOUBLE) AS age, c_nationkey % 2 = 0 AS female, CAST(c_custkey % 117 - 2 AS DOUBLE) AS weight, CAST(95 + c_custkey % 100 AS DOUBLE) AS height, CAST(c_custkey % 47 AS DOUBLE) / 10 AS creat, c_acctbal AS bal, c_mktsegment AS segment FROM customer",
    "labs": "SELECT o_orderkey AS record_id, o_custkey AS patient_id, CAST(120 + k % 41 AS DOUBLE) AS na, CAST(85 + k % 29 AS DOUBLE) AS cl, CAST(6 + k % 37 AS DOUBLE) AS hco3, CAST(2 + k % 5 AS DOUBLE) AS k, CAST(15 + k % 31 AS DOUBLE) AS ca, CAST(k % 7 AS DOUBLE) / 4 AS mg, CAST(18 + k % 30 AS DOUBLE) AS albumin, CAST(k % 13 AS DOUBLE) / 5 AS phosphate, CAST(k % 17 AS DOUBLE) / 2 AS lactate, 7 + CAST(k % 71 AS DOUBLE) / 100 AS ph, CAST(18 + k % 67 AS DOUBLE) AS pco2, CAST(3 + k % 43 AS DOUBLE) AS glucose, CAST(2 + k % 31 AS DOUBLE) AS urea, CAST(5 + k % 53 AS DOUBLE) AS bun, CAST(250 + k % 97 AS DOUBLE) AS measured_osm, CAST(k % 83 AS DOUBLE) AS una, CAST(k % 59 AS DOUBLE) AS uk, CAST(k % 89 AS DOUBLE) AS ucl, CAST(35 + k % 80 AS DOUBLE) AS weight, k % 2 = 0 AS female, CAST(k % 45 * 250 AS DOUBLE) AS altitude, CAST(k % 12 AS DOUBLE) / 10 AS fio2, CAST(40 + k % 61 AS DOUBLE) AS pao2, CAST(60 + k % 45 AS DOUBLE) AS sao2, CAST(6 + k % 11 AS DOUBLE) AS hb, CAST(k % 90 AS DOUBLE) AS age FROM (SELECT *, o_orderkey * 7 + o_custkey AS k FROM orders) o",
    "ecgm": "SELECT l_orderkey AS record_id, l_linenumber AS lead, l_extendedprice / 100 AS qt, 60 + l_quantity AS qrs, 400 + l_extendedprice / 100 AS rr, l_tax * 10 AS s_v1, l_discount * 20 AS r_v5, l_quantity / 20 AS r_v6, l_discount * 9 AS r_avl, l_tax * 7 AS s_v3, l_quantity - 25 AS avf, l_discount * 100 - 4.5 AS lead_i FROM lineitem",
    "stage_long": "SELECT record_id, target, y, 'candidate' AS stage, candidate AS p FROM pred UNION ALL SELECT record_id, target, y, 'fusion', fusion FROM pred UNION ALL SELECT record_id, target, y, 'final', final FROM pred",
}
_NEEDS = {"stage_long": ["pred"]}


def dialect(sql: str, engine: str) -> str:
    form = {"spark": r"unix_millis(CAST(\1 AS TIMESTAMP))", "duckdb": r"(epoch_us(\1) // 1000)"}[engine]
    return re.sub(r"\{ms:(\w+)\}", form, sql)


class Tables:
    """Base tables and adapters of one directory as DataFrames, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self._dir = spark, sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(f"{self._dir}/{name}.parquet")
        if name not in ADAPTERS:
            raise AttributeError(name)
        frames = {t: getattr(self, t) for t in [*BASE, *ADAPTERS] if t != name and re.search(rf"\b(?:FROM|JOIN) {t}\b", ADAPTERS[name])}
        query = dialect(ADAPTERS[name], "spark")
        for t in frames:
            query = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", query)
        return self.spark.sql(query, **frames)


def with_adapters(sql: str) -> str:
    """sql for DuckDB with the adapters that it names before it."""
    used = [t for t in ADAPTERS if re.search(rf"\b{t}\b", sql)]
    used = [*dict.fromkeys([n for t in used for n in [*_NEEDS.get(t, []), t]])]
    if not used:
        return sql
    head = ", ".join(f"{t} AS ({dialect(ADAPTERS[t], 'duckdb')})" for t in used)
    body = sql.strip()
    return f"WITH {head}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head} {body}"
