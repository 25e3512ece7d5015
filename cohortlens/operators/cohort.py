"""Label-blind cohorts by hash, shards, panels and the guards on what may be used for what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def id_hash(namespace: str, key: str | Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{namespace}|"), F.col(key).cast("string") if isinstance(key, str) else key.cast("string")), 256)


def hash_cohort(df: DataFrame, patient: str, namespace: str, n: int, by: list[str] | None = None) -> DataFrame:
    """The n patients of lowest hash, ties by id; with `by`, n of each site. Labels are never read."""
    ids = df.select(*(by or []), patient).distinct().withColumn("hash", id_hash(namespace, patient))
    if not by:
        return ids.orderBy("hash", patient).limit(n)
    return ids.withColumn("__r", F.row_number().over(W.partitionBy(*by).orderBy("hash", patient))).filter(F.col("__r") <= n).drop("__r")


def one_per_patient(df: DataFrame, patient: str, record: str, namespace: str) -> DataFrame:
    """Of each patient the record of lowest hash, ties by record id."""
    return df.groupBy(patient).agg(F.min_by(record, F.struct(id_hash(namespace, record), F.col(record))).alias(record))


def shard_assign(df: DataFrame, key: str, namespace: str, n: int) -> DataFrame:
    """df with a shard number: the hash's first eight hexadecimal digits modulo n."""
    return df.withColumn("shard", (F.conv(F.substring(id_hash(namespace, key), 1, 8), 16, 10).cast("bigint") % n).cast("int"))


def enriched_cohort(records: DataFrame, gold: DataFrame, namespace: str, n_general: int, n_control: int) -> DataFrame:
    """Union of a general cohort, all positives and label-negative controls, with membership flags per record."""
    general = hash_cohort(records, "record_id", f"{namespace}-general", n_general).select("record_id", F.lit("general").alias("m"))
    positive = gold.filter("y = 1").select("record_id", F.lit("positive").alias("m")).distinct()
    clean = gold.groupBy("record_id").agg(F.max("y").alias("any")).filter("any = 0")
    control = hash_cohort(clean, "record_id", f"{namespace}-control", n_control).select("record_id", F.lit("control").alias("m"))
    flags = general.unionByName(positive).unionByName(control)
    return flags.groupBy("record_id").agg(*[F.bool_or(F.col("m") == m).alias(f"is_{m}") for m in ("general", "positive", "control")])


def balanced_selection(records: DataFrame, folds: list[int], namespace: str, k_pos: int = 80, k_neg: int = 400) -> DataFrame:
    """Up to k_pos positives per target and k_neg controls (no target) of the allowed folds, lowest hashes first."""
    allowed = records.filter(F.col("fold").isin(folds)).withColumn("hash", id_hash(namespace, "record_id"))
    group = F.coalesce("target", F.lit("control"))
    ranked = allowed.withColumn("arm", group).withColumn("rank", F.row_number().over(W.partitionBy("arm").orderBy("hash", "record_id")))
    first = ranked.filter(F.col("rank") <= max(k_pos, k_neg))  # a literal, so each task keeps no more than these
    return first.filter((F.col("arm") == "control") | (F.col("rank") <= k_pos)).filter((F.col("arm") != "control") | (F.col("rank") <= k_neg)).select("arm", "record_id", "rank")


def stage_loss_cases(pred: DataFrame, target: str, lost_at: str, kept_at: str | None, k: int, namespace: str) -> DataFrame:
    """The first k positives in hash order that a stage lost and the stage before it had."""
    lost = pred.filter((F.col("target") == target) & (F.col("y") == 1) & (F.coalesce(F.col(lost_at), F.lit(0)) == 0))
    if kept_at:
        lost = lost.filter(F.col(kept_at) == 1)
    return lost.select("record_id", id_hash(namespace, "record_id").alias("hash")).orderBy("hash", "record_id").limit(k)


def holdout_anti_join(records: DataFrame, holdout: DataFrame, key: str) -> DataFrame:
    """Records outside the frozen panel, with the number of panel records that were among them."""
    panel = holdout.select(key).distinct().withColumn("__in", F.lit(1))
    present = records.join(panel, key, "left_semi").agg(F.count("*").alias("n_removed"))
    return records.join(panel, key, "left_anti").crossJoin(F.broadcast(present))


def uniqueness_report(df: DataFrame, keys: dict[str, list[str]], where: Column | None = None) -> DataFrame:
    """(key_set, n_repeated_keys, n_rows) per set of key columns, repeated keys only."""
    rows = df.filter(where) if where is not None else df
    sets = F.array(*[F.struct(F.lit(n).alias("key_set"), F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]).alias("value")) for n, cols in keys.items()])
    counted = rows.select(F.explode(sets).alias("k")).groupBy("k.key_set", "k.value").count().filter("count > 1")
    return counted.groupBy("key_set").agg(F.count("*").alias("n_repeated_keys"), F.sum("count").alias("n_rows"))


def provenance_violations(registry: DataFrame, used: DataFrame) -> DataFrame:
    """(dataset, problem) of uses that the registry does not allow; a job with any must not start.

    registry(dataset, status, external_validation_allowed, allow_tuning, frozen, overlaps array); used(dataset, role).
    """
    here = used.join(registry, "dataset", "left")
    problems = F.array(
        F.when(F.col("status").isNull(), "unknown_dataset"),
        F.when((F.col("role") == "validation") & ~F.coalesce("external_validation_allowed", F.lit(False)), "validation_refused"),
        F.when((F.col("role") == "tuning") & ~F.coalesce("allow_tuning", F.lit(False)), "tuning_refused"),
        F.when(F.coalesce("allow_tuning", F.lit(False)) & F.coalesce("frozen", F.lit(False)), "frozen_but_tunable"),
    )
    own = here.select("dataset", F.explode(F.filter(problems, lambda x: x.isNotNull())).alias("problem"))
    other = used.select(F.col("dataset").alias("o"), F.col("role").alias("r"))
    clash = here.select("dataset", "role", F.explode("overlaps").alias("o")).join(other, "o").filter(F.col("role") != F.col("r")).select("dataset", F.concat(F.lit("overlaps_"), F.col("o").cast("string")).alias("problem"))
    return own.unionByName(clash)


def panel_contract(panel: DataFrame, records: DataFrame, size: int, roles: dict[str, int], folds: list[int]) -> DataFrame:
    """(check_name, ok, found) of a panel: size, unique ids, role counts, allowed folds, records that exist."""
    here = panel.join(records.select("record_id", "fold").withColumn("__there", F.lit(True)), "record_id", "left")
    counts = here.agg(F.count("*").alias("n"), F.countDistinct("record_id").alias("ids"), F.count_if(~F.coalesce(F.col("fold").isin(folds), F.lit(False))).alias("bad_fold"), F.count_if(F.col("__there").isNull()).alias("absent"), *[F.count_if(F.col("role") == r).alias(f"role_{r}") for r in roles])
    checks = [("size", F.col("n") == size, F.col("n")), ("unique", F.col("n") == F.col("ids"), F.col("ids")), ("folds", F.col("bad_fold") == 0, F.col("bad_fold")), ("present", F.col("absent") == 0, F.col("absent"))]
    checks += [(f"role_{r}", F.col(f"role_{r}") == k, F.col(f"role_{r}")) for r, k in roles.items()]
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check_name"), ok.alias("ok"), found.alias("found")) for n, ok, found in checks])).alias("c")).select("c.*")


def panel_violations(panel: DataFrame, records: DataFrame, codes: DataFrame, targets: dict[str, list[str]], folds: list[int], adult: float = 18.0) -> DataFrame:
    """(record_id, role, target, problem) of panel rows that break the contract; a panel without any may be used.

    panel(record_id, role, target), records(record_id, fold, age), codes(record_id, code). A positive must name a
    target of `targets` (name to codes) and still have one of its codes; a control must have no code of any target.
    """
    target_of = F.create_map(*[x for t, own in targets.items() for x in (F.lit(t), F.array(*[F.lit(c) for c in own]))])
    held = codes.join(panel.select("record_id").distinct(), "record_id", "left_semi").groupBy("record_id").agg(F.collect_set("code").alias("codes"))
    here = panel.join(records.select("record_id", "fold", "age").withColumn("there", F.lit(True)), "record_id", "left").join(held, "record_id", "left")
    here = here.withColumn("codes", F.coalesce("codes", F.array().cast("array<string>"))).withColumn("wanted", F.try_element_at(target_of, F.col("target")))
    positive, control = F.col("role") == "POSITIVE", F.col("role") == "NEGATIVE_CONTROL"
    there, every = F.col("there").isNotNull(), F.array(*[F.lit(c) for own in targets.values() for c in own])
    problems = F.array(
        F.when(~there, "missing_record"), F.when(there & ~F.coalesce(F.col("fold").isin(folds), F.lit(False)), "forbidden_fold"), F.when(F.col("age") < adult, "pediatric"),
        F.when(positive & F.col("wanted").isNull(), "unknown_target"), F.when(there & positive & ~F.arrays_overlap("wanted", "codes"), "target_no_longer_true"),
        F.when(control & F.arrays_overlap("codes", every), "control_matches_target"), F.when(~F.coalesce(positive | control, F.lit(False)), "unsupported_role"),
    )
    return here.select("record_id", "role", "target", F.explode(F.filter(problems, lambda x: x.isNotNull())).alias("problem"))
