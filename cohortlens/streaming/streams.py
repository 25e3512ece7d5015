"""Structured Streaming jobs: keyed upserts of late annotations, and prediction before learning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.sources.shared import shared_path

C = F.col


def in_lots(table: DataFrame, lots: int, *keys: str) -> str:
    """A folder with the table in `lots` files, by a hash of the keys, written one after the other: a stream reads them so."""
    folder = shared_path(table.sparkSession, "lots")
    lot = F.pmod(F.xxhash64(*keys), F.lit(lots))
    for k in range(lots):
        table.filter(lot == k).coalesce(1).write.parquet(f"{folder}/lot={k}")
    return folder


def _files(spark: SparkSession, folder: str, per_batch: int) -> DataFrame:
    """A folder of Parquet files as a stream, one trigger per file or few."""
    schema = spark.read.option("recursiveFileLookup", "true").parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(folder)


def latest(rows: DataFrame, keys: list[str], fields: list[str], at: str, tie: str) -> DataFrame:
    rest = [c for c in dict.fromkeys([*fields, at, tie])]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(at, tie)).alias("x")).select(*keys, "x.*")


#: Rows of deltas, as a share of the base, from which on they are merged into it, and rows of a bucket of the base.
DELTA_SHARE, BUCKET_ROWS = 0.5, 1 << 20


def _numbers(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], schema)


def _state(spark: SparkSession, home: str, before: int | None = None) -> tuple[int | None, int, list[int]]:
    """The last base before a batch, its rows, and the deltas after it."""
    limit = F.lit(True) if before is None else C("number") < before
    base = _numbers(spark, f"{home}/bases", "number bigint, n bigint").filter(limit).orderBy(F.desc("number")).first()
    # One row a batch since the last base, which is at most half as large as they are together.
    after = _numbers(spark, f"{home}/batches", "number bigint").filter(limit & (C("number") > (base.number if base else -1))).distinct()
    return base and base.number, base.n if base else 0, sorted(r[0] for r in after.collect())


def _rows(spark: SparkSession, home: str, base: int | None, deltas: list[int]) -> DataFrame | None:
    paths = [f"{home}/base/{base}"] * (base is not None) + [f"{home}/delta/{n}" for n in deltas]
    return spark.read.parquet(*paths) if paths else None


def upsert_stream(stream: DataFrame, keys: list[str], fields: list[str], at: str, tie: str, home: str, share: float = DELTA_SHARE) -> None:
    """Applies every micro-batch to a table of which the latest row of a key counts, whatever the order of arrival.

    A batch writes its own rows only, as a delta. When the deltas since the last base hold `share` of its rows, all are
    merged into a new base, in buckets of BUCKET_ROWS: a row is rewritten a few times for each doubling of the
    table. A batch that is run again reads what stood before it and replaces its own: exactly once.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = latest(batch, keys, fields, at, tie)
        new.write.mode("overwrite").parquet(f"{home}/delta/{number}")
        spark.createDataFrame([(number,)], "number bigint").coalesce(1).write.mode("overwrite").parquet(f"{home}/batches/batch={number}")
        base, n, deltas = _state(spark, home, number)
        deltas.append(number)
        rows = _rows(spark, home, None, deltas).count()
        if rows and rows >= share * n:
            merged = latest(_rows(spark, home, base, deltas), keys, fields, at, tie)
            merged.repartition((n + rows) // BUCKET_ROWS + 1, *keys).write.mode("overwrite").parquet(f"{home}/base/{number}")
            held = spark.read.parquet(f"{home}/base/{number}").count()
            spark.createDataFrame([(number, held)], "number bigint, n bigint").coalesce(1).write.mode("overwrite").parquet(f"{home}/bases/batch={number}")

    query = stream.writeStream.foreachBatch(apply).option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def upsert_stream_result(spark: SparkSession, folder: str, keys: list[str], fields: list[str], at: str, tie: str, home: str | None = None) -> DataFrame:
    """The table after all files of the folder; a run with the same `home` goes on where the last one ended."""
    home = home or shared_path(spark, "upsert")
    stream = _files(spark, folder, 1)
    upsert_stream(stream, keys, fields, at, tie, home)
    base, _, deltas = _state(spark, home)
    rows = _rows(spark, home, base, deltas)
    return spark.createDataFrame([], stream.schema).select(*keys, *fields) if rows is None else latest(rows, keys, fields, at, tie).select(*keys, *fields)


def evaluate_before_learn(spark: SparkSession, path: str, per_batch: int = 1) -> DataFrame:
    """Every item is predicted by the centroids learned from earlier batches, then joins the training sums.

    The model is sums and counts per class and dimension, a small table; evaluations name its version, the
    number of the last batch learned. First exposures only: an id that was seen before is not scored again.
    """
    home = shared_path(spark, "learn")
    points = lambda df: df.select("vec_id", "label", F.posexplode("embedding").alias("d", "v"))

    def apply(batch: DataFrame, number: int) -> None:
        fresh = batch.dropDuplicates(["vec_id"])
        old = spark.read.parquet(f"{home}/model={number - 1}") if number else None
        if old is not None:
            fresh = fresh.join(spark.read.parquet(f"{home}/evaluated").filter(C("batch") < number).select("vec_id"), "vec_id", "left_anti")
        long = points(fresh)
        if old is None:
            scored = fresh.select("vec_id", "label", F.lit(None).cast("int").alias("predicted"))
        else:
            centre = F.broadcast(old.select(C("label").alias("k"), "d", (C("s") / C("n")).alias("c")))
            near = long.join(centre, "d").groupBy("vec_id", "label", "k").agg(F.sum((C("v") - C("c")) ** 2).alias("e"))
            scored = near.groupBy("vec_id", "label").agg(F.min_by("k", F.struct("e", "k")).alias("predicted"))
        scored.withColumns({"version": F.lit(number - 1), "correct": C("predicted") == C("label")}).write.mode("overwrite").parquet(f"{home}/evaluated/batch={number}")
        sums = long.groupBy("label", "d").agg(F.sum("v").alias("s"), F.count("*").alias("n"))
        sums = sums if old is None else sums.unionByName(old).groupBy("label", "d").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        sums.write.mode("overwrite").parquet(f"{home}/model={number}")

    query = _files(spark, path, per_batch).writeStream.foreachBatch(apply).option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{home}/evaluated").select("vec_id", "label", "predicted", "version", "correct")
