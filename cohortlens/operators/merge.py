"""Merges, upserts, consolidation of sources and the totals that must add up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def upsert_table(target: DataFrame, source: DataFrame, keys: list[str], update_when: Column | None = None) -> DataFrame:
    """A new snapshot: source rows replace target rows of their key where update_when holds (t.*, s.* columns), others are added.

    Source keys must be unique. update_when None overwrites always; F.lit(False) does nothing on conflict.
    """
    rest = [c for c in target.columns if c not in keys]
    t, s = target.withColumn("__t", F.lit(True)).alias("t"), source.withColumn("__s", F.lit(True)).alias("s")
    joined = t.join(s, reduce(lambda a, b: a & b, [F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys]), "full")
    take = F.col("__t").isNull() | (F.coalesce(F.col("__s"), F.lit(False)) & F.coalesce(update_when if update_when is not None else F.lit(True), F.lit(False)))
    return joined.select(*[F.coalesce(F.col(f"t.{k}"), F.col(f"s.{k}")).alias(k) for k in keys], *[F.when(take, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c) for c in rest])


def insert_if_absent(target: DataFrame, source: DataFrame, keys: list[str], protect: Column | None = None) -> DataFrame:
    """target with the source rows whose key it (or its protected rows) does not have."""
    held = target.filter(protect) if protect is not None else target
    return target.unionByName(source.join(held.select(*keys).distinct(), keys, "left_anti"))


def analysis_cache(records: DataFrame, cache: DataFrame, key: str, fingerprint: str, compute) -> DataFrame:
    """Cached rows of this fingerprint that are sound, and computed ones for all other records."""
    good = cache.filter((F.col("fingerprint") == fingerprint) & F.col("value").isNotNull()).select(key, "value").dropDuplicates([key])
    hits = records.join(good, key).select(key, "value", F.lit(True).alias("cached"))
    return hits.unionByName(compute(records.join(good, key, "left_anti")).select(key, "value", F.lit(False).alias("cached")))


def fallback_chain(catalog: DataFrame, levels: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """Rows of the first level that has any for a key; keys with none get the level `none`. Levels never mix."""
    tagged = reduce(DataFrame.unionByName, [df.withColumn("level", F.lit(name)).withColumn("__o", F.lit(k)) for k, (name, df) in enumerate(levels)])
    first = tagged.groupBy(key).agg(F.min("__o").alias("__o"))
    best = tagged.join(first, [key, "__o"]).drop("__o")
    return catalog.select(key).distinct().join(best, key, "left").withColumn("level", F.coalesce("level", F.lit("none")))


def nested_lookup(parent: DataFrame, child: DataFrame, key: str, order: list[str], fields: list[str], name: str = "children") -> DataFrame:
    """parent with its children as a sorted list of structs; empty where there are none."""
    lists = child.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, *[f for f in fields if f not in order]))).alias(name))
    return parent.join(lists, key, "left").withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))


def latest_lateral(left: DataFrame, right: DataFrame, left_key: str, right_key: str, order: list[str], fields: list[str]) -> DataFrame:
    """left with the fields of the row of right that comes last in the order, by a lateral join; null where there is none.

    Spark ranks the rows of right once by key, so nothing is looked up row by row.
    """
    newest = right.where(F.col(right_key) == F.col(left_key).outer()).orderBy(*[F.desc(c) for c in order]).limit(1).select(*fields)
    return left.lateralJoin(newest, how="left")


def best_record(df: DataFrame, key: str | list[str], order: list[Column], fields: list[str]) -> DataFrame:
    """Of each key the fields of the row that comes last in the order (ascending; the greatest wins)."""
    keys = [key] if isinstance(key, str) else key
    return df.groupBy(*keys).agg(F.max_by(F.struct(*fields), F.struct(*order)).alias("__b")).select(*keys, "__b.*")


def overlay_merge(base: DataFrame, overlay: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """Reviewed values over originals, which stay in *_original; the origin is named; new reviewed rows are added."""
    o = overlay.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in keep])
    both = base.join(o, base[key] == o["__k"], "full")
    origin = F.when(F.col("__k").isNull(), "base").when(F.col(key).isNull(), "new_reviewed").otherwise("reviewed")
    return both.select(F.coalesce(key, "__k").alias(key), *[F.coalesce(f"__{c}", c).alias(c) for c in keep], *[F.col(c).alias(f"{c}_original") for c in keep], origin.alias("origin"))


def merge_nonempty(df: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """One row per key: of each field the last value in order that is not empty."""
    return df.groupBy(key).agg(*[F.max_by(F.col(c), F.when(F.nullif(F.col(c), F.lit("")).isNotNull(), F.col(order))).alias(c) for c in fields])


def source_union(sources: dict[str, DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("source_kind", F.lit(n)) for n, df in sources.items()])


def priority_evidence(evidence: DataFrame, priority: dict[str, int]) -> DataFrame:
    """One row per drug by source priority; the first seen wins a tie."""
    p = reduce(lambda rest, kv: F.when(F.col("source_kind") == kv[0], kv[1]).otherwise(rest), priority.items(), F.lit(0))
    return best_record(evidence, "med_id", [p, -F.col("seq")], ["source_kind", "decision"])


def multi_source_adjudication(evidence: DataFrame) -> DataFrame:
    """concordant, conflict, single or no_evidence per drug, by the action families of accepted sources."""
    ok = F.col("accepted")
    per = evidence.groupBy("med_id").agg(F.countDistinct(F.when(ok, F.col("source_kind"))).alias("n_sources"), F.countDistinct(F.when(ok, F.col("family"))).alias("n_families"))
    return per.withColumn("adjudication", F.when(F.col("n_sources") == 0, "no_evidence").when(F.col("n_sources") == 1, "single").when(F.col("n_families") == 1, "concordant").otherwise("conflict"))


def resolution_matrix(catalog: DataFrame, stages: dict[str, DataFrame], local: set[str]) -> DataFrame:
    """One row per drug: a flag per source, their number, and the resolution; local support alone never resolves."""
    out = catalog.select("med_id")
    for name, ids in stages.items():
        out = out.join(ids.select("med_id").distinct().withColumn(name, F.lit(True)), "med_id", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    official = [F.col(n).cast("int") for n in stages if n not in local]
    n = reduce(lambda a, b: a + b, official)
    return out.withColumn("n_official", n).withColumn("resolution", F.when(F.col("n_official") >= 2, "multi").when(F.col("n_official") == 1, "single").when(F.greatest(*[F.col(c) for c in local], F.lit(False)), "local_only").otherwise("pending"))


def split_with_proof(matrix: DataFrame, resolved: Column) -> DataFrame:
    """(part, n, total) of resolved and pending rows; the parts sum to the total."""
    parts = matrix.groupBy(F.when(F.coalesce(resolved, F.lit(False)), "resolved").otherwise("pending").alias("part")).agg(F.count("*").alias("n"))
    return parts.withColumn("total", F.sum("n").over(W.partitionBy()))


def code_set_ops(expected: DataFrame, found: DataFrame, key: str, forbidden: list[str]) -> DataFrame:
    """Per key: common, missing and extra codes, whether all expected are there, forbidden ones found."""
    e = expected.groupBy(key).agg(F.sort_array(F.collect_set("code")).alias("e"))
    f = found.groupBy(key).agg(F.sort_array(F.collect_set("code")).alias("f"))
    none = F.array().cast("array<string>")
    both = e.join(f, key, "full").select(key, F.coalesce("e", none).alias("e"), F.coalesce("f", none).alias("f"))
    line = lambda x: F.array_join(F.array_sort(x), ",")
    bad = F.array(*[F.lit(c) for c in forbidden]) if forbidden else none
    return both.select(key, line(F.array_intersect("e", "f")).alias("common"), line(F.array_except("e", "f")).alias("missing"), line(F.array_except("f", "e")).alias("extra"), (F.size(F.array_except("e", "f")) == 0).alias("complete"), line(F.array_intersect("f", bad)).alias("forbidden"))


def candidate_dedupe(evidence: DataFrame) -> DataFrame:
    """Per (record, domain, code) the top score, with the sources of all its rows united."""
    return evidence.groupBy("record_id", "domain", "code").agg(F.max("score").alias("score"), F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"))


def coverage_counts(modules: dict[str, DataFrame], by: str = "status") -> DataFrame:
    """(module, status, n_rows, n_drugs); each child is summed alone, so none multiplies another."""
    each = [df.groupBy(F.col(by).alias("status")).agg(F.count("*").alias("n_rows"), F.countDistinct("med_id").alias("n_drugs")).withColumn("module", F.lit(n)) for n, df in modules.items()]
    return reduce(DataFrame.unionByName, each)


def indication_rollup(rules: DataFrame) -> DataFrame:
    routes = F.array_join(F.sort_array(F.collect_set("route")), ",")
    return rules.groupBy("indication").agg(routes.alias("routes"), F.count("*").alias("n_rules"), F.count_if(F.col("status") == "PUBLISHED").alias("n_published"), F.count_if(F.col("status") != "PUBLISHED").alias("n_pending"))


def reason_histogram(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *keys)


def evidence_signatures(evidence: DataFrame) -> DataFrame:
    """Counts of whole evidence sets and of single items over records: (kind, signature, n)."""
    sets = evidence.groupBy("record_id").agg(F.array_join(F.sort_array(F.collect_set("item")), "+").alias("signature"))
    whole = sets.groupBy("signature").agg(F.count("*").alias("n")).withColumn("kind", F.lit("set"))
    single = evidence.select("record_id", F.col("item").alias("signature")).distinct().groupBy("signature").agg(F.count("*").alias("n")).withColumn("kind", F.lit("item"))
    return whole.unionByName(single)


def shard_merge(partials: DataFrame, keys: list[str], n_shards: int) -> DataFrame:
    """Counters summed over shards, beside how many of the shards are missing."""
    spark = partials.sparkSession
    missing = spark.range(n_shards).select(F.col("id").cast("int").alias("shard")).join(partials.select(F.col("shard").cast("int").alias("shard")).distinct(), "shard", "left_anti").agg(F.count("*").alias("missing_shards"))
    return partials.groupBy(*keys).agg(F.sum("n").alias("n")).crossJoin(F.broadcast(missing))


def entity_summary(catalog: DataFrame, children: dict[str, DataFrame], key: str) -> DataFrame:
    """One row per entity: rows, published rows and availability of every child; each child is summed before its join."""
    out = catalog.select(key)
    for n, df in children.items():
        own = df.groupBy(key).agg(F.count("*").alias(f"{n}_rows"), F.count_if(F.col("status") == "PUBLISHED").alias(f"{n}_published"))
        out = out.join(own, key, "left").fillna(0, [f"{n}_rows", f"{n}_published"]).withColumn(f"has_{n}", F.col(f"{n}_published") > 0)
    return out


def total_invariants(frames: dict[str, DataFrame], expected: dict[str, int]) -> DataFrame:
    """(name, n, expected, ok) of table sizes; a job stops on any that is not ok."""
    counts = reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("name"), "n") for k, df in frames.items()])
    want = reduce(lambda rest, kv: F.when(F.col("name") == kv[0], F.lit(kv[1])).otherwise(rest), expected.items(), F.lit(None).cast("bigint"))
    return counts.withColumn("expected", want.cast("bigint")).withColumn("ok", F.coalesce(F.col("n") == F.col("expected"), F.lit(False)))


def module_coverage_audit(catalog: DataFrame, modules: dict[str, DataFrame], key: str) -> DataFrame:
    """Drugs with the modules that are not published for them, most first."""
    out = catalog.select(key)
    for n, df in modules.items():
        out = out.join(df.select(key).distinct().withColumn(f"__{n}", F.lit(n)), key, "left")
    missing = F.array_except(F.array(*[F.lit(n) for n in modules]), F.array_compact(F.array(*[F.col(f"__{n}") for n in modules])))
    return out.select(key, F.size(missing).alias("n_missing"), F.array_join(missing, ",").alias("missing")).filter("n_missing > 0")
