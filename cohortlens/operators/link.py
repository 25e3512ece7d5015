"""Linking names, codes and labels. Similarity joins are blocked by an equal key, never all against all."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortlens.functions.text import ANY_CASE, fold_text, holds_text, similarity, token_set_ratio, tokens
from cohortlens.operators.near_names import banded_pairs, similar_pairs
from cohortlens.sources.shared import sent_if_small, written


def name_or_id_lookup(catalog: DataFrame, source: DataFrame) -> DataFrame:
    """catalog(med_id, generic_name) with supported_by: id, name or null. Two equi-joins, no OR."""
    ids = source.select(F.col("med_id").alias("__i")).filter("__i is not null").distinct().withColumn("__by_id", F.lit(True))
    names = source.select(fold_text(F.col("generic_name")).alias("__n")).filter("__n <> ''").distinct().withColumn("__by_name", F.lit(True))
    out = catalog.withColumn("__f", fold_text(F.col("generic_name")))
    out = out.join(ids, out["med_id"] == ids["__i"], "left").join(names, out["__f"] == names["__n"], "left")
    return out.withColumn("supported_by", F.when(F.col("__by_id"), "id").when(F.col("__by_name"), "name")).select("med_id", "generic_name", "supported_by")


def alias_join(codes: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(phrase, n, target): codes(phrase) counted and mapped by declared synonyms(phrase, target) only."""
    norm = codes.groupBy(fold_text(F.col("phrase")).alias("phrase")).agg(F.count("*").alias("n"))
    known = synonyms.select(fold_text(F.col("phrase")).alias("phrase"), "target").dropDuplicates(["phrase", "target"])
    return norm.join(known, "phrase", "left").select("phrase", "n", F.coalesce("target", F.lit("UNMAPPED")).alias("target"))


def pattern_labels(codes: DataFrame, patterns: dict[str, list[str]], exclusions: dict[str, list[str]]) -> DataFrame:
    """(code, target) of a code dictionary by substrings of its description; the small pattern set becomes one expression."""
    d = fold_text(F.col("description"))
    has = lambda words: F.array_contains(F.array(*[F.contains(d, F.lit(w)) for w in words]), True) if words else F.lit(False)
    hits = [F.when(has(words) & ~has(exclusions.get(t, [])), t) for t, words in patterns.items()]
    return codes.select("code", F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("target"))


#: Pairs of names that one token may make; the names of a hotter one meet by their q-grams.
MOST_PAIRS = 1 << 22


def name_pairs(left: DataFrame, right: DataFrame, least: int = 3, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """(name, candidate) of different names that share a token of `least` letters or more, each pair once.

    Names are distinct before they meet. A token that would make more than `most_pairs` pairs brings none together by
    itself: names with such a token meet those others with which they share a band of their q-grams (near_names).
    """
    keyed = lambda df, name: df.select(F.col("name").alias(name)).distinct().withColumn("__t", F.explode(F.array_distinct(F.filter(tokens(F.col(name)), lambda x: F.length(x) >= least))))
    a, b = keyed(left, "name"), keyed(right, "candidate")
    held = a.groupBy("__t").agg(F.count("*").alias("a")).join(b.groupBy("__t").agg(F.count("*").alias("b")), "__t")
    hot = held.filter(F.col("a") * F.col("b") > most_pairs).select("__t")
    if hot.isEmpty():
        return a.join(b, "__t").filter("name <> candidate").select("name", "candidate").distinct()
    hot = written(hot, "hot_tokens")
    rare = a.join(hot, "__t", "left_anti").join(b.join(hot, "__t", "left_anti"), "__t").filter("name <> candidate").select("name", "candidate")
    crowded = lambda df, name: df.join(hot, "__t", "left_semi").select(F.col(name).alias("name")).distinct()
    return rare.unionByName(banded_pairs(crowded(a, "name"), crowded(b, "candidate"))).distinct()


def fuzzy_candidates(left: DataFrame, right: DataFrame, score: Callable[[Column, Column], Column] = similarity, k: int = 5) -> DataFrame:
    """(name, candidate, score, rank): the k names most similar by `score` that share a token, for review, never accepted by themselves."""
    scored = name_pairs(left, right).withColumn("score", F.round(score(F.col("name"), F.col("candidate")), 4))
    ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy("name").orderBy(F.desc("score"), "candidate")))
    return ranked.filter(F.col("rank") <= k).select("name", "candidate", "score", "rank")


def difflib_ratio(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp ratio of two names, in Arrow batches."""
    from difflib import SequenceMatcher

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y, strict=True)], dtype="float64")

    return ratio(a, b)


def priority_review(candidates: DataFrame, least: float = 95.0, margin: float = 3.0) -> DataFrame:
    """First candidates that are near and clearly ahead of the second."""
    over = W.partitionBy("name").orderBy("rank")
    ahead = candidates.withColumn("second", F.lead("score").over(over)).filter("rank = 1")
    ok = (F.col("score") >= least) & (F.col("score") - F.coalesce("second", F.lit(0.0)) >= margin)
    return ahead.select("name", "candidate", "score", "second", ok.alias("priority"))


def component_identity(catalog: DataFrame, sources: DataFrame, least: float = 92.0) -> DataFrame:
    """(med_id, source_id) where every catalogue component matches an ingredient, and a single drug no combination.

    Different components meet different ingredients with a token in common; catalog(med_id, parts),
    sources(source_id, ingredients). Lists meet once each, however many drugs or sources have them, and by that
    component only which the fewest ingredient lists answer: the others are looked up in the lists it finds.
    """
    drugs = catalog.select("med_id", F.array_sort("parts").alias("parts"))
    given = sources.select("source_id", F.array_sort("ingredients").alias("ingredients"))
    own, other = written(drugs.select("parts").distinct(), "component_lists"), written(given.select("ingredients").distinct(), "ingredient_lists")
    parts = own.select("parts", F.explode("parts").alias("part"))
    held = other.select("ingredients", F.explode(F.array_distinct("ingredients")).alias("ingredient"))
    names, others = parts.select(F.col("part").alias("name")), held.select(F.col("ingredient").alias("name"))
    near = name_pairs(names, others, 1).select(F.col("name").alias("part"), F.col("candidate").alias("ingredient")).filter(token_set_ratio(F.col("part"), F.col("ingredient")) >= least)
    alike = near.unionByName(names.intersect(others).select(F.col("name").alias("part"), F.col("name").alias("ingredient")))
    answers = alike.join(held.groupBy("ingredient").agg(F.count("*").alias("lists")), "ingredient").groupBy("part").agg(F.collect_set("ingredient").alias("like"), F.sum("lists").alias("lists"))
    whole = parts.join(answers, "part").groupBy("parts").agg(F.countDistinct("part").alias("k"), F.collect_set("like").alias("likes"), F.min_by("like", F.struct("lists", "part")).alias("rarest")).filter(F.col("k") == F.size("parts"))
    met = whole.select("parts", "likes", F.explode("rarest").alias("ingredient")).join(held, "ingredient").filter((F.size("parts") > 1) | (F.size("ingredients") == 1))
    lists = met.filter(F.forall("likes", lambda like: F.arrays_overlap(like, F.col("ingredients")))).select("parts", "ingredients").distinct()
    found = written(lists.join(given, "ingredients").select("parts", "source_id"), "lists_met")
    return drugs.join(sent_if_small(found), "parts").select("med_id", "source_id").distinct()


def crosswalk_identity(catalog: DataFrame, labels: DataFrame, least: float = 96.0) -> DataFrame:
    """(med_id, label_id, basis): shared codes first; names near enough only for drugs without one; else the reason."""
    codes = catalog.select("med_id", F.explode("codes").alias("code")).join(labels.select("label_id", F.explode("codes").alias("code")), "code").select("med_id", "label_id").distinct().withColumn("basis", F.lit("codes"))
    rest = catalog.join(codes, "med_id", "left_anti")
    own, other = rest.select("name"), labels.select("name")
    alike = name_pairs(own, other, 1).filter(token_set_ratio(F.col("name"), F.col("candidate")) >= least)
    alike = alike.unionByName(own.intersect(other).select("name", F.col("name").alias("candidate")))
    near = rest.join(alike, "name").join(labels.select("label_id", F.col("name").alias("candidate")), "candidate").withColumnRenamed("candidate", "__l")
    whole = F.size(F.array_except(tokens(F.col("name")), tokens(F.col("__l")))) == 0
    named = near.select("med_id", "label_id", F.when(whole, "name").otherwise("rejected_components").alias("basis"))
    none = rest.join(named.select("med_id").distinct(), "med_id", "left_anti").select("med_id", F.lit(None).cast("bigint").alias("label_id"), F.lit("no_label").alias("basis"))
    return codes.unionByName(named).unionByName(none)


def match_confidence(matches: DataFrame) -> DataFrame:
    """HIGH, MEDIUM or LOW per drug from its best lexical and terminology scores and the cover of its parts by tokens of >= 72."""
    cover = matches.select("med_id", "label", F.explode("parts").alias("part"))
    token = cover.withColumn("token", F.explode(tokens(F.col("label"))))
    covered = token.groupBy("med_id", "label", "part").agg(F.max(similarity(F.col("part"), F.col("token"))).alias("s")).groupBy("med_id", "label").agg(F.min("s").alias("least"))
    both = matches.join(covered, ["med_id", "label"], "left")
    per = both.groupBy("med_id").agg(F.max("lexical").alias("lexical"), F.max("terminology").alias("terminology"), F.bool_or(F.col("least") >= 72).alias("covered"))
    level = F.when(F.col("covered") & (F.greatest("lexical", "terminology") >= 92), "HIGH").when(F.col("covered") | (F.greatest("lexical", "terminology") >= 80), "MEDIUM").otherwise("LOW")
    return per.select("med_id", "lexical", "terminology", "covered", level.alias("confidence"))


def modifier_lookup(patient_meds: DataFrame, modifiers: DataFrame, analyte: str) -> DataFrame:
    """Published modifiers of each patient's drugs for an analyte."""
    return patient_meds.distinct().join(modifiers.filter((F.col("status") == "PUBLISHED") & (F.col("analyte") == analyte)).drop("status", "analyte"), "med_id")


def reviewed_alias_rewrite(catalog: DataFrame, aliases: DataFrame) -> DataFrame:
    """Names replaced by their reviewed alias on exact match, with method and status."""
    a = aliases.select(F.col("alias").alias("__a"), F.col("canonical").alias("__c"))
    out = catalog.join(a, catalog["generic_name"] == a["__a"], "left")
    return out.select("med_id", F.coalesce("__c", "generic_name").alias("name"), F.when(F.col("__c").isNotNull(), "reviewed_alias").otherwise("as_is").alias("method"))


def alias_keys(df: DataFrame) -> DataFrame:
    """(key, row_id): names and aliases cut at ; , / | of three letters or more; the first row wins a key."""
    keys = F.transform(F.split(F.concat_ws(";", "name", "aliases"), r"[;,/|]"), fold_text)
    return df.select("row_id", F.explode(keys).alias("key")).filter(F.length("key") >= 3).groupBy("key").agg(F.min("row_id").alias("row_id"))


def identity_triage(name: Column, salts: list[str], esters: list[str], ambiguous: list[str]) -> Column:
    """combination, ester, salt, ambiguous, suffix_review or plain."""
    words = tokens(fold_text(name))
    any_of = lambda stop: F.arrays_overlap(words, F.array(*[F.lit(s) for s in stop]))
    return F.when(F.contains(name, F.lit("+")) | F.contains(name, F.lit("/")), "combination").when(any_of(esters), "ester").when(any_of(salts), "salt").when(any_of(ambiguous), "ambiguous").when(F.rlike(name, F.lit("(ato|ate|ine|ide)$")), "suffix_review").otherwise("plain")


def search_texts(table: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, text) of the folded fields of each row; a field may be an array, as of aliases."""
    kinds = dict(table.dtypes)
    texts = F.flatten(F.array(*[F.col(f).cast("array<string>") if kinds[f].startswith("array") else F.array(F.col(f).cast("string")) for f in fields]))
    return table.select(key, F.explode(F.filter(texts, lambda x: x.isNotNull())).alias("text")).select(key, fold_text(F.col("text")).alias("text")).distinct()


def catalogue_search(queries: DataFrame, catalog: DataFrame, fields: list[str], limit: int = 20) -> DataFrame:
    """Catalogue rows of which a field, the id or aliases among them, holds the folded query; the query set is small and stated."""
    q = queries.select("query", fold_text(F.col("query")).alias("__q"))
    hits = search_texts(catalog, "med_id", fields).join(F.broadcast(q), F.contains(F.col("text"), F.col("__q"))).select("query", "med_id").distinct()
    named = hits.join(catalog.select("med_id", fold_text(F.col("generic_name")).alias("name")), "med_id")
    ranked = named.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy("name", "med_id")))
    return ranked.filter(F.col("rank") <= limit).select("query", "med_id", "name", "rank")


def collated_search(catalog: DataFrame, key: str, fields: list[str], query: str, limit: int = 20) -> DataFrame:
    """(key, name, rank): rows of which a field holds the query, but for case and accents in any script; by name, then key."""
    texts = F.array(*[F.col(f).cast("string") for f in fields])
    hits = catalog.filter(F.exists(texts, lambda x: F.coalesce(holds_text(x, F.lit(query)), F.lit(False))))
    top = hits.select(key, F.col(fields[0]).cast("string").alias("name")).orderBy(F.collate(F.col("name"), ANY_CASE), key).limit(limit)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.collate(F.col("name"), ANY_CASE), key)))  # of `limit` rows


def literal_then_fuzzy(queries: DataFrame, table: DataFrame, fields: list[str], fuzzy: list[str], least: float = 64.0, letters: int = 4, most_queries: int = 1000) -> DataFrame:
    """(query, name, how): literal hits on any of `fields`; only queries without any are matched by similarity.

    Similarity is that to one of the `fuzzy` fields, whole or to one of its tokens of `letters` or more. Up to
    `most_queries` queries are sent to all rows, of which they meet each different text once; of more, the literal ones
    still do, and the others meet texts by q-grams, without loss.
    """
    q = queries.select("query", fold_text(F.col("query")).alias("__q"))
    named = table.withColumn("name", fold_text(F.col("name")))
    literal = search_texts(named, "name", fields).join(F.broadcast(q), F.contains(F.col("text"), F.col("__q"))).select("query", "name").distinct().withColumn("how", F.lit("literal"))
    rest = q.join(literal.select("query").distinct(), "query", "left_anti")
    texts = search_texts(named, "name", fuzzy)
    texts = texts.unionByName(texts.select("name", F.explode(F.filter(tokens(F.col("text")), lambda x: F.length(x) >= letters)).alias("text"))).distinct()
    if queries.count() <= most_queries:
        near = texts.select("text").distinct().join(F.broadcast(rest), similarity(F.col("text"), F.col("__q")) >= least)
    else:
        pairs = similar_pairs(rest.select(F.col("__q").alias("name")), texts.select(F.col("text").alias("name")), least)
        alike = pairs.filter(similarity(F.col("name"), F.col("candidate")) >= least).select(F.col("name").alias("__q"), F.col("candidate").alias("text"))
        near = alike.join(rest, "__q")
    found = texts.join(near, "text").select("query", "name").distinct()
    return literal.unionByName(found.withColumn("how", F.lit("fuzzy")))


def text_windows(df: DataFrame, key: str, text: str, term: str, before: int = 60, after: int = 120, most: int = 8, limit: int = 12_000, skip: str = r"overdos") -> DataFrame:
    """(key, n_hits, context): up to `most` windows around hits of a term, without those of overdose, cut at `limit`."""
    import re

    hit, bad = re.compile(term, re.IGNORECASE), re.compile(skip, re.IGNORECASE)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            rows = []
            for k, t in zip(part[key], part[text], strict=True):
                t, spans, n = t or "", [], 0
                for m in hit.finditer(t):
                    n += 1
                    a, b = max(0, m.start() - before), min(len(t), m.end() + after)
                    if len(spans) < most and not bad.search(t, a, b):
                        spans.append(t[a:b])
                rows.append((k, n, "\n".join(spans)[:limit]))
            yield pd.DataFrame(rows, columns=[key, "n_hits", "context"])

    return df.select(key, text).mapInPandas(run, f"{key} bigint, n_hits bigint, context string")


def anonymised_headers(headers: DataFrame, key: str, text: str, signals: int = 12, rate: float = 500.0) -> DataFrame:
    """(key, kept, n_samples, reason) of text headers: their record and signal lines only, never what follows them.

    The first line has the record's name, signals, rate (before a slash) and samples. reason is malformed (too few
    fields or lines, no numbers), wrong_signals or wrong_rate, null for those that are accepted; kept is null for all others.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.split(F.regexp_replace(whole, "\r?\n$", ""), "\r?\n")
    h = headers.select(key, F.when(whole != "", lines).otherwise(F.array().cast("array<string>")).alias("l"))
    h = h.withColumn("f", F.filter(F.split(F.coalesce(F.get("l", F.lit(0)), F.lit("")), r"\s+"), lambda x: x != ""))
    h = h.withColumns({"n": F.expr("try_cast(get(f, 1) as int)"), "r": F.expr("try_cast(split(get(f, 2), '/')[0] as double)"), "n_samples": F.expr("try_cast(get(f, 3) as bigint)")})
    broken = (F.size("f") < 4) | F.col("n").isNull() | F.col("r").isNull() | F.col("n_samples").isNull() | (F.size("l") < F.col("n") + 1)
    reason = F.when(broken, "malformed").when(F.col("n") != signals, "wrong_signals").when(F.abs(F.col("r") - rate) > 1e-6, "wrong_rate")
    kept = F.array_join(F.expr("slice(l, 1, greatest(n, 0) + 1)"), "\n")
    return h.withColumn("reason", reason).select(key, F.when(F.col("reason").isNull(), kept).alias("kept"), F.when(F.col("reason").isNull(), F.col("n_samples")).alias("n_samples"), "reason")


def header_rejections(headers: DataFrame) -> DataFrame:
    """(reason, n) of anonymised headers, accepted ones among them."""
    return headers.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


def section_top_k(sections: DataFrame, title: str, body: str, least: int = 50, k: int = 4) -> DataFrame:
    """(doc, section, score, rank): sections scored by title and body hits, same texts once, the best k of each document."""
    score = 60 * F.rlike("title", F.lit(title)).cast("int") + 30 * F.rlike("body", F.lit(body)).cast("int") + F.least(F.lit(30), F.regexp_count("body", F.lit(body)) * 10)
    scored = sections.withColumn("score", score.cast("int")).filter(F.col("score") >= least).withColumn("print", F.md5(F.lower("body")))
    once = scored.groupBy("doc", "print").agg(F.min_by(F.struct("section", "score"), F.struct(-F.col("score"), F.col("section"))).alias("s")).select("doc", "s.*")
    return once.withColumn("rank", F.row_number().over(W.partitionBy("doc").orderBy(F.desc("score"), "section"))).filter(F.col("rank") <= k)


def text_release_gate(text: Column) -> dict[str, Column]:
    """Reasons that keep a regimen text from release; it may go out if none holds."""
    t = fold_text(text)
    rules = {"weight_based": r"mg/kg", "dialysis": r"diali|dialy", "no_adjustment": r"no (requiere )?ajuste|no adjust", "alternative": r" o | or |alternativ", "titration": r"titul|titrat", "missing_quantity": None}
    return {n: (~F.rlike(t, F.lit(r"\d")) if p is None else F.rlike(t, F.lit(p))) for n, p in rules.items()}
