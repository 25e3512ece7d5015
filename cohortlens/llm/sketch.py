"""Document fingerprints: threshold-scaled sketches, in DataFrame operations only.

A sketch keeps every shingle hash below a fixed fraction of the hash range, so sketches of any two texts
are comparable however unequal their lengths, and the sketch of a union is the union of sketches; only a text
whose hashes all lie above keeps its least one, which a union with another text need not hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

SHINGLE = 5
#: One in SCALE shingle hashes is kept.
SCALE = 8
SPACE = r"[\x20\x09-\x0D]+"


def word_codes(text: Column) -> Column:
    """A 64-bit hash of each word of the lower-cased text."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE)
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def shingle_codes(codes: Column) -> Column:
    """63-bit hashes of runs of SHINGLE words; of all words if there are fewer."""
    whole = F.array(F.xxhash64(codes))
    runs = F.transform(F.sequence(F.lit(0), F.size(codes) - SHINGLE), lambda i: F.xxhash64(*[F.get(codes, i + k) for k in range(SHINGLE)]))
    some = F.when(F.size(codes) >= SHINGLE, runs).when(F.size(codes) > 0, whole).otherwise(F.array().cast("array<bigint>"))
    return F.transform(some, lambda x: F.shiftrightunsigned(x, 1))


def with_sketch(df: DataFrame, text: str, name: str, scale: int = SCALE) -> DataFrame:
    """df with the sketch of a text column: sorted different hashes below 2 ** 63 / scale.

    A text whose hashes all lie above keeps its least one, so that only a text without words has none.
    """
    limit = (1 << 63) // scale
    df = df.withColumn("__codes", word_codes(F.col(text))).withColumn("__all", shingle_codes(F.col("__codes"))).drop("__codes")
    df = df.withColumn("__low", F.array_sort(F.array_distinct(F.filter("__all", lambda x: x < limit))))
    kept = F.when((F.size("__low") > 0) | (F.size("__all") == 0), F.col("__low")).otherwise(F.array(F.array_min("__all")))
    return df.withColumn(name, kept).drop("__all", "__low")


def as_text(sketch: Column) -> Column:
    """16 hexadecimal digits for each hash."""
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard estimate of two sketches; equal ones (also two without hashes) give 1."""
    common = F.size(F.array_intersect(a, b))
    return F.when(a == b, 1.0).otherwise(common / (F.size(a) + F.size(b) - common)).cast("double")


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the shingles of a that b has; 1 if a has none."""
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a)).cast("double")


def sketches(documents: DataFrame, scale: int = SCALE) -> DataFrame:
    """(doc_id, sketch) of every document."""
    return with_sketch(documents.select("doc_id", "text"), "text", "sketch", scale).select("doc_id", "sketch")


def next_of_each(docs: DataFrame) -> DataFrame:
    """(to, key, pick, most) per different document key `to`: the next document's key and text hash, and the most
    code points that `to` takes of it.

    Ids are sorted by range and numbered by the counts of the parts before theirs; only ids are moved.
    """
    ids = docs.groupBy("doc_id").agg(F.max(F.length("text")).alias("n"), F.min(F.xxhash64("text")).alias("pick"))
    ids = written(ids.sort(F.col("doc_id").asc_nulls_first()).withColumn("place", F.monotonically_increasing_id()), "ids")
    part = F.shiftright("place", 33)
    parts = ids.groupBy(part.alias("part")).count()
    parts = parts.withColumn("before", F.sum("count").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("count"))
    parts = parts.withColumn("total", F.sum("count").over(W.partitionBy()))
    ranked = ids.withColumn("part", part).join(parts, "part").withColumn("rank", F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)))
    ranked = ranked.select(key_of(F.col("doc_id")).alias("key"), "n", "pick", "rank", "total")
    to = ranked.select(F.col("key").alias("to"), F.floor(F.col("n") / 2).cast("int").alias("most"), F.pmod(F.col("rank") + 1, F.col("total")).alias("rank"))
    return to.join(ranked.select("rank", "key", "pick"), "rank").select("to", "key", "pick", "most")


def key_of(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.lit("null"))


def edited_fingerprints(documents: DataFrame, scale: int = SCALE) -> DataFrame:
    """Each document's fingerprint beside that of its text with the last half taken from the next document.

    Texts are shuffled once by id; then only the part that the document before takes, with the sketch of
    its giver, goes to that document. Null text is empty; a text without words has an empty fingerprint. A
    null doc_id comes first. Rows that repeat a doc_id each have their row and the same next document, which
    is that id's text of least hash. A table of one id is its own next. Other columns are ignored.
    """
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # Both joins read the same two columns, so that the shuffle of the texts is made once and read twice.
    keyed = docs.select(key_of(F.col("doc_id")).alias("key"), "text")
    # An equality of both sides would become part of the join's key, and the shuffle another one.
    given = keyed.join(next_of_each(docs), "key").filter(F.xxhash64("text").bitwiseXOR(F.col("pick")) == 0)
    given = with_sketch(given.select("to", "text", "most"), "text", "next_sketch", scale).select("to", F.expr("substring(text, 1, most)").alias("head"), "next_sketch")
    given = given.groupBy("to").agg(F.first("head").alias("head"), F.first("next_sketch").alias("next_sketch"))
    both = keyed.join(given, F.col("key") == F.col("to")).withColumn("n_chars", F.length("text").cast("bigint"))
    both = both.withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 2 as int)), substring(head, 1, cast(n_chars div 2 as int)))"))
    both = both.select(F.col("key").try_cast("bigint").alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "text", "edited", "next_sketch")
    both = with_sketch(with_sketch(both, "text", "own", scale), "edited", "other", scale)
    return both.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"), as_text(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("next_sketch")).alias("near_next"),
    )
