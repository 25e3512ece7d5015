"""Tables that outlive a run: results by engine fingerprint, checked publication, versions of a model."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cohortlens.sources.shared import written

C = F.col


def _there(spark: SparkSession, path: str, schema: StructType | str, **options) -> DataFrame:
    """A Parquet table, empty where there is none."""
    try:
        return spark.read.schema(schema).options(**options).parquet(path)
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], schema)


def _check(key: str) -> F.Column:
    return F.xxhash64(key, C("value").cast("string"))


def cache_rows(spark: SparkSession, path: str, schema: StructType, fingerprint: str) -> DataFrame:
    """Rows of one engine fingerprint; files of others are not opened, and a torn file gives nothing."""
    return _there(spark, path, schema, ignoreCorruptFiles="true").filter(C("fingerprint") == fingerprint)


def cached_analysis(records: DataFrame, path: str, key: str, fingerprint: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(key, value, cached) of every record: sound results of this fingerprint, and computed ones for the rest, which are kept.

    The cache is a Parquet table partitioned by fingerprint. A run computes what is missing, null or does not agree with
    its checksum, and appends it once; of several results of a key the last run's counts. compute takes records and
    returns (key, value).
    """
    spark = records.sparkSession
    kinds = dict(compute(records.limit(0)).dtypes)
    schema = f"{key} {kinds[key]}, value {kinds['value']}, check bigint, run bigint, fingerprint string"
    rows = cache_rows(spark, path, schema, fingerprint).filter(C("value").isNotNull() & (C("check") == _check(key)))
    held = rows.groupBy(key).agg(F.max_by(F.struct("value", "run"), "run").alias("x")).select(key, "x.*")
    last = rows.agg(F.max("run")).first()[0] or 0
    hits = written(records.select(key).distinct().join(held, key).select(key, "value", F.lit(True).alias("cached")), "hits")
    missing = records.join(hits.select(key), key, "left_anti")
    if missing.isEmpty():
        return hits
    new = compute(missing).select(key, "value").withColumns({"check": _check(key), "run": F.lit(last + 1).cast("bigint"), "fingerprint": F.lit(fingerprint)})
    new.write.mode("append").partitionBy("fingerprint").parquet(path)
    made = cache_rows(spark, path, schema, fingerprint).filter(C("run") == last + 1).join(missing.select(key).distinct(), key, "left_semi")
    return hits.unionByName(made.select(key, "value", F.lit(False).alias("cached")))


def publish_checked(frames: dict[str, DataFrame], folder: str, expected: dict[str, int], parts: dict[str, list[str]] | None = None) -> DataFrame:
    """(name, n, expected, ok) of frames that are written in one pass each and published together, or not at all.

    Sizes are observed in the action that writes. `expected` names sizes; `parts` names frames whose rows add up to
    those of others. Where anything is off, ValueError names it and nothing is published: readers follow the
    last line of `published`, which is written after all checks.
    """
    spark = next(iter(frames.values())).sparkSession
    run, found = uuid.uuid4().hex, {}
    for name, df in frames.items():
        seen = Observation(f"{name}-{run}")
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{folder}/runs/{run}/{name}")
        found[name] = seen.get["n"]
    rows = [(k, found.get(k), n, found.get(k) == n) for k, n in expected.items()]
    rows += [(f"{whole} = {' + '.join(own)}", sum(found[p] for p in own), found[whole], sum(found[p] for p in own) == found[whole]) for whole, own in (parts or {}).items()]
    bad = [f"{k}: {n} instead of {want}" for k, n, want, ok in rows if not ok]
    if bad:
        raise ValueError("not published: " + "; ".join(bad))
    number = _there(spark, f"{folder}/published", "number bigint, run string").agg(F.max("number")).first()[0] or 0
    spark.createDataFrame([(number + 1, run)], "number bigint, run string").coalesce(1).write.mode("append").parquet(f"{folder}/published")
    return spark.createDataFrame(rows, "name string, n bigint, expected bigint, ok boolean")


def read_published(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A frame of the run that was published last."""
    last = _there(spark, f"{folder}/published", "number bigint, run string").orderBy(F.desc("number")).first()
    if last is None:
        raise FileNotFoundError(f"nothing is published in {folder}")
    return spark.read.parquet(f"{folder}/runs/{last.run}/{name}")


def model_version(rows: DataFrame, feature_version: str) -> str:
    """A name that the training rows (in any order), the feature version and nothing else fix."""
    one = F.xxhash64(*[C(c) for c in sorted(rows.columns)])
    a = rows.agg(F.count("*").alias("n"), F.bit_xor(one).alias("x"), F.sum(F.pmod(one, F.lit(1 << 40))).alias("s")).first()
    return f"{feature_version}-{a.n}-{(a.x or 0) & 0xFFFFFFFFFFFFFFFF:016x}{(a.s or 0) & 0xFFFFFFFFFFFFFFFF:016x}"


def keep_model(home: str, version: str, fit: Callable[[], object], load: Callable[[str], object], excluded: DataFrame):
    """The model of a version: fitted and saved with the ids it was not fitted on, or loaded if it is there already."""
    spark = excluded.sparkSession
    known = _there(spark, f"{home}/versions", "version string")
    if known.filter(C("version") == version).isEmpty():
        model = fit()
        model.write().overwrite().save(f"{home}/models/{version}")
        excluded.write.mode("overwrite").parquet(f"{home}/excluded/{version}")
        spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("append").parquet(f"{home}/versions")
    return load(f"{home}/models/{version}")
