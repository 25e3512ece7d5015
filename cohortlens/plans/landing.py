"""Queries of readers and sinks, S1 and S3 to S5: a table is written as files of the form and read back whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.plans.registry import query
from cohortlens.sources import readers
from cohortlens.sources.shared import shared_path

C = F.col
#: Documents in one label file, on average.
LABELS_A_FILE = 200


@query("s01_read_catalog", "SELECT p_partkey AS med_id, p_name AS generic_name, p_brand AS brand, p_type AS class, CAST(p_size AS INT) AS size, p_retailprice AS price, CAST(NULL AS VARCHAR) AS note FROM part")
def _(t):
    folder = shared_path(t.spark, "catalog")
    t.cat.write.option("header", True).csv(folder)
    schema = t.cat.select("med_id", "generic_name", "brand", "class", C("size").cast("int"), "price", F.lit(None).cast("string").alias("note")).schema
    return readers.read_catalog(t.spark, folder, schema)


@query("s03_read_label_documents", "SELECT CAST(doc_id AS VARCHAR) AS id, CAST(n_chars AS VARCHAR) AS effective_time, lang AS language, md5(text) AS indications FROM documents")
def _(t):
    folder = shared_path(t.spark, "labels")
    docs = t.documents.select(C("doc_id").cast("string").alias("id"), C("n_chars").cast("string").alias("effective_time"), C("lang").alias("language"), F.array("text").alias("indications"))
    lots = docs.count() // LABELS_A_FILE + 1
    files = docs.groupBy(F.pmod(F.xxhash64("id"), F.lit(lots)).alias("lot")).agg(F.collect_list(F.struct(*docs.columns)).alias("results"))
    files.select(F.to_json(F.struct("results")).alias("value")).write.option("maxRecordsPerFile", 1).text(folder)
    read = readers.read_label_documents(t.spark, folder, ["language", "indications"])
    return read.select("id", "effective_time", F.get("language", F.lit(0)).alias("language"), F.md5(F.get("indications", F.lit(0))).alias("indications"))


@query("s04_read_prediction_shards", "SELECT CAST(record_id AS VARCHAR) AS record_id, target, CAST(y AS INT) AS y, final, true AS named FROM pred")
def _(t):
    folder = shared_path(t.spark, "shards")
    t.pred.select("record_id", "target", "y", "final").write.option("header", True).csv(folder)
    read = readers.read_prediction_shards(t.spark, f"{folder}/*.csv", ["record_id", "target"])
    return read.select("record_id", "target", C("y").cast("int"), C("final").cast("int"), C("shard_file").like("%.csv").alias("named"))


@query("s05_write_audit_outputs", "SELECT o_orderkey AS record_id, CASE WHEN o_orderstatus = 'P' THEN 'none' ELSE o_orderpriority END AS reason, o_totalprice AS amount FROM orders")
def _(t):
    folder = shared_path(t.spark, "audit")
    reason = F.when(C("o_orderstatus") != "P", C("o_orderpriority")).alias("reason")
    readers.write_audit_outputs(t.orders.select(C("o_orderkey").alias("record_id"), reason, C("o_totalprice").alias("amount")), folder, "reason")
    return t.spark.read.parquet(folder)
