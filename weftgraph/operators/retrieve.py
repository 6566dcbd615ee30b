"""Retrieval: entities of a question, similarity search with an adaptive threshold, and a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import strip, tokens, words
from .settle import settle
from .substrings import inside

THRESHOLDS = (0.75, 0.50, 0.25)
MOST_ENTITIES = 10
#: Thresholds that a search falls back to: steps down from the first, and never below the floor.
STEP, TRIES, FLOOR = 0.25, 3, 0.10

# What in a question looks like an entity.
CAPITALISED = r"(?<![.!?]\s)(?<!^)\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\b"
DOUBLE_QUOTED, SINGLE_QUOTED = r'"([^"]+)"', r"'([^']+)'"
ABOUT = r"(?i)about\s+([A-Za-z][A-Za-z\s]+?)(?:\s+and|\s+or|\?|$)"
BETWEEN = r"(?i)between\s+([A-Za-z]+)\s+and\s+([A-Za-z]+)"
RELATIONSHIP = r"(?i)relationship\s+(?:between\s+)?([A-Za-z]+)"
WHO_IS = r"(?i)(?:who|what)\s+is\s+([A-Za-z]+)"


def query_words(c: Column | str, longer_than: int = 2) -> Column:
    return F.array_distinct(F.filter(words(F.lower(c if isinstance(c, Column) else F.col(c))), lambda w: F.length(w) > longer_than))


def pattern_candidates(q: Column) -> Column:
    """Possible entities in a question, in the order of the patterns, not empty."""
    one = lambda p: F.regexp_extract_all(q, F.lit(p), F.lit(1))
    second = F.regexp_extract_all(q, F.lit(BETWEEN), F.lit(2))
    pairs = F.flatten(F.transform(one(BETWEEN), lambda x, i: F.array(x, F.get(second, i))))
    found = F.concat(one(CAPITALISED), one(DOUBLE_QUOTED), one(SINGLE_QUOTED), one(ABOUT), pairs, one(RELATIONSHIP), one(WHO_IS))
    return F.filter(F.transform(found, strip), lambda x: x != "")


def known_matches(questions: DataFrame, entities: DataFrame) -> DataFrame:
    """(qid, entity): entities named in a question, or with a word of more than two letters from it.

    Words meet by equi-join. Naming by substring is found without a comparison of all pairs: an entity inside a question
    begins at one of the question's places, so the question's substrings of the entities' lengths are joined on equality.
    """
    e = entities.select("entity", F.lower("entity").alias("low")).where("low <> ''")
    q = questions.select("qid", F.lower("question").alias("q"))
    by_word = q.select("qid", F.explode(query_words("q")).alias("w")).join(e.select("entity", F.explode(F.array_distinct(words("low"))).alias("w")), "w").select("qid", "entity")
    named = inside(q, "q", e, "low").select("qid", "entity")
    return by_word.unionByName(named).distinct()


def best_matches(candidates: DataFrame, entities: DataFrame) -> DataFrame:
    """(candidate) -> (candidate, entity, score): equal without case, else by containment, else by shared words; over a half."""
    e = entities.select("entity", F.lower("entity").alias("low"))
    c = candidates.select("candidate").distinct().withColumn("c", F.lower("candidate"))
    exact = c.join(e, F.col("c") == F.col("low")).groupBy("candidate").agg(F.min("entity").alias("entity")).withColumn("score", F.lit(1.0))
    rest = c.join(exact, "candidate", "left_anti")
    shared = F.size(F.array_intersect(words("c"), words("low")))
    most = F.greatest(F.size(F.array_distinct(words("c"))), F.size(F.array_distinct(words("low"))))
    score = F.when(F.contains("low", F.col("c")), F.length("c") / F.length("low")).when(F.contains("c", F.col("low")), F.length("low") / F.length("c")).otherwise(F.when(shared > 0, shared / most * 0.8).otherwise(0.0))
    by_word = rest.withColumn("w", F.explode(F.array_distinct(words("c")))).join(e.withColumn("w", F.explode(F.array_distinct(words("low")))), "w").drop("w")
    pairs = by_word.unionByName(inside(e, "low", rest, "c")).unionByName(inside(rest, "c", e, "low")).distinct()
    scored = pairs.withColumn("score", score).where("score > 0.5")
    best = scored.groupBy("candidate").agg(F.min(F.struct((-F.col("score")).alias("s"), F.length("entity").alias("n"), "entity")).alias("b"))
    return exact.unionByName(best.select("candidate", F.col("b.entity").alias("entity"), (-F.col("b.s")).alias("score")))


def question_entities(questions: DataFrame, entities: DataFrame, most: int = MOST_ENTITIES, more=None) -> DataFrame:
    """(qid, question) -> (qid, rank, entity, source): known matches, then resolved candidates; at most ``most``.

    ``more``: an optional plug-in, asked where fewer than two were found: (qid, question) -> (qid, candidate).
    """
    known = known_matches(questions, entities).withColumn("tier", F.lit(0))
    cands = questions.select("qid", F.posexplode(pattern_candidates(F.col("question"))).alias("pos", "candidate"))
    resolved = cands.join(best_matches(cands, entities), "candidate").select("qid", "entity", F.lit(1).alias("tier"), "pos")
    found = known.withColumn("pos", F.lit(0)).unionByName(resolved)
    if more is not None:
        few = questions.join(found.groupBy("qid").agg(F.countDistinct("entity").alias("n")).where("n >= 2"), "qid", "left_anti")
        told = more(few)
        found = found.unionByName(told.join(best_matches(told, entities), "candidate").select("qid", "entity", F.lit(2).alias("tier"), F.lit(0).alias("pos")))
    best = found.groupBy("qid", "entity").agg(F.min(F.struct("tier", "pos")).alias("o"))
    w = W.partitionBy("qid").orderBy("o", F.length("entity"), "entity")
    ranked = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    return ranked.select("qid", "rank", "entity", F.element_at(F.array(F.lit("known"), F.lit("pattern"), F.lit("model")), F.col("o.tier") + 1).alias("source"))


def legacy_entities(questions: DataFrame, entities: DataFrame, most: int = MOST_ENTITIES) -> DataFrame:
    """Entities in a question, or with a question word of four letters or more inside; the first ``most`` by name."""
    e = entities.select("entity", F.lower("entity").alias("low"))
    q = questions.select("qid", F.lower("question").alias("q"))
    asked = q.select("qid", F.explode(query_words("q", 3)).alias("w"))
    hit = inside(q, "q", e, "low").select("qid", "entity").unionByName(inside(e, "low", asked, "w").select("qid", "entity")).distinct()
    w = W.partitionBy("qid").orderBy("entity")
    return hit.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def explain_entities(questions: DataFrame) -> DataFrame:
    return questions.select("qid", query_words("question").alias("words"), pattern_candidates(F.col("question")).alias("candidates"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def scored(passages: DataFrame, query: list[float]) -> DataFrame:
    """Passages with ``score``, their cosine to a question's vector, a literal in the plan."""
    q = F.lit([float(x) for x in query])
    return passages.withColumn("score", cosine(F.col("embedding"), q))


def adaptive(passages: DataFrame, query: list[float], thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """Passages at or over the first threshold that any reaches, scored once; ``threshold`` tells which."""
    s = scored(passages, query).where(F.col("score") >= min(thresholds))
    level = F.lit(None).cast("double")
    for t in sorted(thresholds):
        level = F.when(F.col("top") >= t, F.lit(t)).otherwise(level)
    top = s.agg(F.max("score").alias("top")).select(level.alias("threshold"))
    return s.join(F.broadcast(top)).where("score >= threshold")


def distinct_passages(found: DataFrame, keys: tuple[str, ...] = ("page_num", "chunk_num")) -> DataFrame:
    """The best-scored of passages with one page and chunk number, with how many there were."""
    w = W.partitionBy(*keys).orderBy(F.desc("score"), F.length("content"), "content")
    return found.withColumn("r", F.row_number().over(w)).withColumn("copies", F.count(F.lit(1)).over(W.partitionBy(*keys))).where("r = 1").drop("r")


def within_budget(ranked: DataFrame, budget: int, order: list, text: str = "content") -> DataFrame:
    """The first passages whose tokens sum up to the budget; it ends at the first that goes over.

    A running sum in two levels: over ranges of the order, one row each, then inside the ranges that begin within the
    budget. Passages of no tokens take no room.
    """
    n = max(int(ranked.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = settle(ranked.withColumn("tokens", tokens(text)).repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    before = dealt.groupBy("_part").agg(F.sum("tokens").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    w = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    near = dealt.join(before.where(F.col("_before") <= budget), "_part")
    return near.withColumn("used", F.col("_before") + F.sum("tokens").over(w)).where(F.col("used") <= budget).drop("_part", "_before")


def falling(first: float) -> tuple[float, ...]:
    """The thresholds of a search that begins at ``first``."""
    return tuple(dict.fromkeys(max(FLOOR, first - STEP * i) for i in range(TRIES)))
