"""Scalar text functions as column expressions; everything runs inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..vocab import ARTICLES, GENERIC, PRONOUNS, TITLES, TYPES, UNKNOWN

#: White space as Python's str methods see it (of the ASCII and Latin-1 ranges and the general blanks).
SPACE = r"[\s\x1c-\x1f\x85   -     　]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: The same as a list of characters.
BLANKS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value found once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column | str) -> Column:
    """Without white space at either end."""
    return F.btrim(col(c), F.lit(BLANKS))


def words(c: Column | str) -> Column:
    """White-space separated words; none for a blank text."""
    return F.filter(F.split(col(c), rf"{SPACE}+"), lambda w: w != "")


def casefold(c: Column | str) -> Column:
    return F.replace(F.lower(col(c)), F.lit("ß"), F.lit("ss"))


def normalize_entity(c: Column | str, articles: bool = True) -> Column:
    """Caseless, single blanks, no punctuation at the ends, one leading article dropped."""
    x = F.regexp_replace(casefold(c), rf"{SPACE}+", " ")
    x = F.regexp_replace(x, r"^[\p{Punct} ]+|[\p{Punct} ]+\z", "")
    return F.regexp_replace(x, rf"^(?:{'|'.join(ARTICLES)})(?: |\z)", "") if articles else x


def base_form(c: Column | str) -> Column:
    """Without one leading title, unless nothing else is left."""
    w = words(c)
    is_title = F.lower(F.element_at(w, 1)).isin(TITLES)
    return F.when((F.size(w) > 1) & is_title, F.array_join(F.slice(w, F.lit(2), F.size(w) - 1), " ")).otherwise(col(c))


def valid_entity(c: Column | str, mode: str = "standard") -> Column:
    """Whether a string can be an entity: no pronoun, two characters or more; ``standard`` is stricter than ``verbose``."""
    x = strip(c)
    w = words(x)
    ok = (F.length(x) >= 2) & ~F.lower(x).isin(PRONOUNS)
    if mode == "verbose":
        return ok
    lowered = F.size(F.filter(w, lambda y: (F.lower(y) == y) & (F.upper(y) != y)))
    return ok & (F.size(w) <= 4) & ~F.lower(x).isin(GENERIC) & (lowered <= F.floor(F.size(w) / 2))


def document_type(c: Column | str) -> Column:
    """A known document type in lower case; ``unknown`` for all else."""
    x = F.lower(strip(c))
    return F.when(x.isin([*TYPES, UNKNOWN]), x).otherwise(F.lit(UNKNOWN))


def tokens(c: Column | str) -> Column:
    """Estimated language-model tokens: a quarter of the characters."""
    return F.floor(F.length(col(c)) / 4)


def context_budget(question: Column | str, limit: int = 128_000, answer: int = 4_000, margin: int = 1_000, least: int = 10_000) -> Column:
    """Tokens that a context may take beside a question."""
    return F.greatest(F.lit(limit - answer - margin) - tokens(question), F.lit(least))


def sanitize_path(c: Column | str) -> Column:
    """A path as the name of an index: leading dots and slashes off, the other slashes as underscores."""
    return F.regexp_replace(F.regexp_replace(col(c), r"^[./\\]+", ""), r"[/\\]", "_")


def chunks(c: Column | str, size: int = 800, overlap: int = 100) -> Column:
    """Sentence chunks: sentences are packed greedily; a new chunk begins with the tail of the last.

    The tail is cut from the unstripped chunk, and a chunk may exceed ``size`` by a long sentence or by its tail.
    """
    sentences = F.split(strip(c), rf"(?<=[.!?]){SPACE}+")
    tail = (lambda cur: F.right(cur, F.lit(overlap))) if overlap > 0 else (lambda cur: F.lit(""))

    def closed(cur: Column, out: Column) -> Column:
        return let(strip(cur), lambda x: F.when(x != "", F.concat(out, F.array(x))).otherwise(out))

    def step(acc: Column, s: Column) -> Column:
        cur, out = acc["cur"], acc["out"]
        fits = F.length(cur) + F.length(s) <= size
        return F.struct(F.when(fits, F.concat(cur, s, F.lit(" "))).otherwise(F.concat(tail(cur), s, F.lit(" "))).alias("cur"), F.when(fits, out).otherwise(closed(cur, out)).alias("out"))

    start = F.struct(F.lit("").alias("cur"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(sentences, start, step, lambda acc: closed(acc["cur"], acc["out"]))


def line_chunks(c: Column | str, size: int = 500, overlap: int = 50) -> Column:
    """Passage chunks of whole lines up to ``size`` characters; whole lines of at most ``overlap`` are said again."""
    lines = F.filter(F.split(col(c), "\n"), lambda x: x != "")
    empty = F.array().cast("array<string>")

    def length(a: Column) -> Column:
        return F.length(F.array_join(a, "\n"))

    def step(acc: Column, s: Column) -> Column:
        cur, out = acc["cur"], acc["out"]
        fits = (F.size(cur) == 0) | (length(cur) + 1 + F.length(s) <= size)
        kept = F.aggregate(
            F.reverse(cur), F.struct(empty.alias("a"), F.lit(False).alias("full")),
            lambda k, x: F.when(k["full"] | (length(F.concat(F.array(x), k["a"])) > overlap) | (length(F.concat(F.array(x), k["a"])) + 1 + F.length(s) > size), F.struct(k["a"].alias("a"), F.lit(True).alias("full"))).otherwise(F.struct(F.concat(F.array(x), k["a"]).alias("a"), F.lit(False).alias("full"))),
            lambda k: k["a"],
        )
        return F.struct(F.when(fits, F.concat(cur, F.array(s))).otherwise(F.concat(kept, F.array(s))).alias("cur"), F.when(fits, out).otherwise(F.concat(out, F.array(F.array_join(cur, "\n")))).alias("out"))

    start = F.struct(empty.alias("cur"), empty.alias("out"))
    return F.aggregate(lines, start, step, lambda acc: F.when(F.size(acc["cur"]) > 0, F.concat(acc["out"], F.array(F.array_join(acc["cur"], "\n")))).otherwise(acc["out"]))


def processing_estimate(c: Column | str, size: int = 800) -> Column:
    """Characters, words, chunks at least one, and the seconds that 2 to 5 seconds a chunk make."""
    n = F.greatest(F.lit(1), F.floor(F.length(col(c)) / size).cast("int"))
    return F.struct(F.length(col(c)).alias("chars"), F.size(words(c)).alias("words"), n.alias("chunks"), (n * 2).alias("low_s"), (n * 5).alias("high_s"))


def json_object(c: Column | str) -> Column:
    """The JSON object in a text, as text: the whole, else a fenced block, else the first braces, one level nested; null if none parses."""
    x = col(c)

    def valid(y: Column) -> Column:
        return F.when(F.try_parse_json(y).isNotNull() & F.rlike(strip(y), F.lit(r"^\{")), strip(y))

    fenced = F.nullif(F.regexp_extract(x, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))
    braces = F.nullif(F.regexp_extract(x, r"\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}", 0), F.lit(""))
    return F.coalesce(valid(x), valid(fenced), valid(braces))


def cache_key(c: Column | str, n: int = 500) -> Column:
    """MD5 of a text's beginning."""
    return F.md5(F.left(col(c), F.lit(n)))


def triple_line(s: Column | str, p: Column | str, o: Column | str) -> Column:
    """A triple as a line of plain words."""
    return F.concat(F.lit("- "), col(s), F.lit(" "), F.lower(F.replace(col(p), F.lit("_"), F.lit(" "))), F.lit(" "), col(o))


def arrow_line(s: Column | str, p: Column | str, o: Column | str) -> Column:
    return F.concat(F.lit("  "), col(s), F.lit(" --["), col(p), F.lit("]--> "), col(o))


def node_id(entity: Column | str, page: Column | str) -> Column:
    return F.concat(col(entity), F.lit("__page"), col(page).cast("string"))


def excerpt(c: Column | str, n: int = 500) -> Column:
    return F.left(col(c), F.lit(n))


def page_text(c: Column | str, most: int = 10_000) -> Column:
    """A page's text, cut with a note beyond ``most`` characters."""
    x = col(c)
    return F.when(F.length(x) > most, F.concat(F.left(x, F.lit(most)), F.lit("\n... ["), (F.length(x) - most).cast("string"), F.lit(" more characters]"))).otherwise(x)
