"""Triples: extraction from text, parsing of answers, inverses and normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns
from ..functions.text import strip, valid_entity
from ..vocab import inverse_pairs

TRIPLE = "array<struct<s:string,p:string,o:string>>"

# What pattern extraction looks for. A run of words is cut at its last verb; what is before it, from the
# first letter that can begin a name, "is a" the words after it. Repeated groups are possessive: Java's stack holds each
# repetition of other ones, and a text of one run has 20,000 words.
COPULA = r"(?isuU)\A(.*\S)\s+(?:is|est|was|était)\s+(?:a|an|un|une|the|le|la)?\s*([a-zà-ÿ]+(?:\s+[a-zà-ÿ]+)*+)"
COPULA_NAME = r"(?iuU)[A-ZÀ-Ý][a-zà-ÿ][a-zà-ÿ\s]*"
COPULA_HINT = r"(?iuU)\s(?:is|est|was|était)\s"
RUN = r"(?iuU)[a-zà-ÿ]+(?:\s+[a-zà-ÿ]+)*+"
TITLE_HINT = r"(?iuU)\s(?:king|queen|prince|goddess|god|roi|reine|prince|déesse|dieu)\s+(?:of|de|du|des)\s"
AND_HINT = r"\s(?:and|et)\s+[A-ZÀ-Ý]"
TITLE = r"(?iuU)([A-ZÀ-Ý][a-zà-ÿ]+),?\s+(?:king|queen|prince|goddess|god|roi|reine|prince|déesse|dieu)\s+(?:of|de|du|des)\s+([A-ZÀ-Ý][a-zà-ÿ]+)"
AND = r"([A-ZÀ-Ý][a-zà-ÿ]+)\s+(?:and|et)\s+([A-ZÀ-Ý][a-zà-ÿ]+)"

# The forms of an answer, in the order in which they are tried.
TUPLE = r"\(([^,]+),\s*([^,]+),\s*([^)]+)\)"
ARROW = r"([^->\n]+)\s*->\s*([^->\n]+)\s*->\s*([^->\n]+)"
ROLE = r"(?i)([A-Z][a-zA-Z\s]+?)\s+(?:is|was)\s+(?:a|the|an)?\s*([a-z][a-zA-Z\s]+?)\s+of\s+([A-Z][a-zA-Z\s]+?)(?:\.|$)"
POSSESSIVE = r"([A-Z][a-zA-Z\s]+?)\s+(?:is|was)\s+([A-Z][a-zA-Z\s]+?)'s\s+([a-z][a-zA-Z]+)"
VERB = r"(?i)([A-Z][a-zA-Z\s]+?)\s+(offered|promised|chose|gave|took|received|sought|desired)\s+(?:him|her|them)?\s*([a-z][a-zA-Z\s]+?)(?:\.|,|$)"


def _groups(text: Column, pattern: str, n: int, most: int | None = None) -> Column:
    """Matches of a pattern, or the first ``most``, as structs g0, g1, ... of its groups, stripped.

    The text is searched once for whole matches; a match tells its own groups.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    found = F.slice(found, 1, most) if most else found
    return F.transform(found, lambda m: F.struct(*[strip(F.regexp_extract(m, pattern, g + 1)).alias(f"g{g}") for g in range(n)]))


def _triple(s: Column, p: Column, o: Column) -> Column:
    return F.struct(s.alias("s"), p.alias("p"), o.alias("o"))


def pattern_triples(text: Column) -> Column:
    """Triples that patterns find: at most three copulas and titles and two conjunctions, first come first."""
    empty = F.array().cast(TRIPLE)
    none = F.array().cast("array<struct<g0:string,g1:string>>")
    # a copula's match fills the rest of a run of words, so that a run has one at most, and runs without its verb have none
    runs = F.filter(F.regexp_extract_all(text, F.lit(RUN), F.lit(0)), lambda r: F.rlike(r, F.lit(COPULA_HINT)))
    pairs = F.transform(runs, lambda r: F.struct(strip(F.regexp_extract(F.regexp_extract(r, COPULA, 1), COPULA_NAME, 0)).alias("g0"), strip(F.regexp_extract(r, COPULA, 2)).alias("g1")))
    long = lambda m: (F.length(m["g0"]) > 2) & (F.length(m["g1"]) > 2)
    copula = F.when(F.rlike(text, F.lit(COPULA_HINT)), F.filter(F.slice(F.filter(pairs, lambda m: (m["g0"] != "") & (m["g1"] != "")), 1, 3), long)).otherwise(none)
    title = F.when(F.rlike(text, F.lit(TITLE_HINT)), _groups(text, TITLE, 2, 3)).otherwise(none)
    both = F.when(F.rlike(text, F.lit(AND_HINT)), F.filter(_groups(text, AND, 2, 2), long)).otherwise(none)

    def as_triples(found: Column, p: str) -> Column:
        return F.transform(found, lambda m: _triple(m["g0"], F.lit(p), m["g1"]))

    named = [as_triples(copula, "IS_A"), as_triples(title, "RULES"), as_triples(both, "RELATED_TO")]
    return F.when(text.isNull(), empty).otherwise(F.concat(*named))


def parsed_triples(text: Column) -> Column:
    """Triples in an answer: parenthesised; else arrows; else comma lines; else sentences about roles and gifts."""
    full = lambda m: (m["s"] != "") & (m["p"] != "") & (m["o"] != "")
    upper = lambda a: F.filter(F.transform(a, lambda m: _triple(m["g0"], F.upper(m["g1"]), m["g2"])), full)
    one, two = upper(_groups(text, TUPLE, 3)), upper(_groups(text, ARROW, 3))
    lines = F.transform(F.split(text, "\n"), strip)
    fields = F.filter(F.transform(lines, lambda x: F.transform(F.split(x, ","), strip)), lambda f: F.size(f) >= 3)
    three = F.filter(F.transform(fields, lambda f: _triple(F.get(f, F.lit(0)), F.upper(F.get(f, F.lit(1))), F.get(f, F.lit(2)))), full)

    def sentence(x: Column) -> Column:
        role = F.transform(_groups(x, ROLE, 3), lambda m: _triple(m["g0"], F.concat(F.replace(F.upper(m["g1"]), F.lit(" "), F.lit("_")), F.lit("_OF")), m["g2"]))
        own = F.transform(_groups(x, POSSESSIVE, 3), lambda m: _triple(m["g0"], F.concat(F.upper(m["g2"]), F.lit("_OF")), m["g1"]))
        verb = lambda v: F.when(v == "OFFERED", "OFFERS").when(v == "PROMISED", "PROMISES").otherwise(v)
        act = F.transform(_groups(x, VERB, 3), lambda m: _triple(m["g0"], verb(F.upper(m["g1"])), m["g2"]))
        # every field of every form is kept only where none is empty
        return F.filter(F.concat(role, own, act), lambda m: (m["s"] != "") & (m["o"] != "") & (m["p"] != "_OF"))

    four = F.flatten(F.transform(F.filter(lines, lambda x: (x != "") & ~F.startswith(x, F.lit("#"))), sentence))
    return F.when(F.size(one) > 0, one).when(F.size(two) > 0, two).when(F.size(three) > 0, three).otherwise(four)


def inverse_table(spark: SparkSession) -> DataFrame:
    """(doc_type, predicate, inverse); doc_type "" holds for every type. Under a hundred rows, so it is broadcast."""
    return spark.createDataFrame(inverse_pairs(), "doc_type string, predicate string, inverse string")


def inverse_map(doc_type: str) -> dict[str, str]:
    """Predicates of a type with those of every type; the type's own win."""
    pairs = inverse_pairs()
    return {p: i for k, p, i in pairs if k == ""} | {p: i for k, p, i in pairs if k == doc_type}


def inverse_of(predicate: Column, doc_type: Column | str, fallback: str = "INVERSE_") -> Column:
    """Static inverse of a predicate: the type's, else the common one, else the predicate behind ``fallback``."""
    kind = F.lit(doc_type) if isinstance(doc_type, str) else doc_type
    table = F.create_map(*[F.lit(x) for k, p, i in inverse_pairs() for x in (f"{k}|{p}", i)])
    p = F.upper(predicate)
    return F.coalesce(F.try_element_at(table, F.concat(kind, F.lit("|"), p)), F.try_element_at(table, F.concat(F.lit("|"), p)), F.concat(F.lit(fallback), predicate))


def resolve_inverses(spark: SparkSession, triples: DataFrame, doc_type: str, answer=None) -> DataFrame:
    """Distinct predicates -> (predicate, inverse, source): static where known, else ``answer``'s, else the fallback.

    ``answer`` is an optional plug-in DataFrame function over the remainder (predicate) -> (predicate, inverse).
    """
    distinct = triples.select("predicate").distinct()
    static = inverse_table(spark).where(F.col("doc_type").isin("", doc_type))
    static = static.groupBy("predicate").agg(F.max_by("inverse", F.length("doc_type")).alias("inverse"))
    keyed = distinct.withColumn("key", F.upper("predicate"))
    known = keyed.join(F.broadcast(static.withColumnRenamed("predicate", "key")), "key").select("predicate", "inverse", F.lit("static").alias("source"))
    rest = keyed.join(F.broadcast(static.withColumnRenamed("predicate", "key")), "key", "left_anti").select("predicate")
    if answer is None:
        return known.unionByName(rest.select("predicate", F.concat(F.lit("INVERSE_"), "predicate").alias("inverse"), F.lit("fallback").alias("source")))
    told = answer(rest).select("predicate", F.col("inverse").alias("told"))
    filled = rest.join(told, "predicate", "left").select("predicate", F.coalesce("told", F.concat(F.lit("INVERSE_"), "predicate")).alias("inverse"), F.when(F.col("told").isNull(), "fallback").otherwise("answer").alias("source"))
    return known.unionByName(filled)


def normalized(triples: DataFrame) -> DataFrame:
    """Subjects, predicates and objects as stripped strings."""
    return triples.withColumns({c: strip(F.col(c).cast("string")) for c in ("subject", "predicate", "object")})


def valid(triples: DataFrame, mode: str = "standard") -> DataFrame:
    """Triples with an entity at both ends."""
    return triples.where(valid_entity("subject", mode) & valid_entity("object", mode))


def with_inverses(triples: DataFrame, doc_type: Column | str = "technical") -> DataFrame:
    """Each triple and its inverse: 2 seq and 2 seq + 1, so that later insertions win as they come."""
    back = F.struct(F.col("object").alias("s"), inverse_of(F.col("predicate"), doc_type).alias("p"), F.col("subject").alias("o"), F.lit(True).alias("inv"), (F.col("seq") * 2 + 1).alias("n"))
    forth = F.struct(F.col("subject").alias("s"), F.col("predicate").alias("p"), F.col("object").alias("o"), F.lit(False).alias("inv"), (F.col("seq") * 2).alias("n"))
    rest = [c for c in triples.columns if c not in ("seq", "subject", "predicate", "object", "is_inverse")]
    flat = triples.select(*rest, F.explode(F.array(forth, back)).alias("t"))
    return flat.select(F.col("t.n").alias("seq"), F.col("t.s").alias("subject"), F.col("t.p").alias("predicate"), F.col("t.o").alias("object"), F.col("t.inv").alias("is_inverse"), *rest)


def typed(batches: DataFrame, doc_type: str | None = None, classifier=None) -> DataFrame:
    """Batches with ``doc_type``: the one given or, chunk by chunk, what ``classifier`` (a function of a DataFrame that
    adds it) or else the patterns of the chunk's own language say."""
    if doc_type is not None:
        return batches.withColumn("doc_type", F.lit(doc_type))
    if classifier is not None:
        return classifier(batches)
    return batches.withColumn("doc_type", patterns.DEFAULT.detect_any(F.col("text"))["type"])


def extract(batches: DataFrame, extractor=None) -> DataFrame:
    """Batches (page_num, batch_idx, text, ...) -> triples with ``seq`` by page, batch and place.

    ``extractor``: an optional plug-in, a function of a DataFrame that adds a column ``triples`` (null on failure or
    timeout); patterns fill in.
    """
    found = extractor(batches).withColumn("triples", F.coalesce("triples", pattern_triples(F.col("text")))) if extractor else batches.withColumn("triples", pattern_triples(F.col("text")))
    rest = [c for c in batches.columns if c != "text"]
    flat = found.select(*rest, F.posexplode("triples").alias("pos", "t"))
    # page, batch and place in one number: 2^20 batches a page, 2^10 triples a batch
    seq = F.col("page_num").cast("long") * (1 << 30) + F.col("batch_idx").cast("long") * (1 << 10) + F.col("pos")
    return flat.select(seq.alias("seq"), F.col("t.s").alias("subject"), F.col("t.p").alias("predicate"), F.col("t.o").alias("object"), *rest)
