"""Entity spellings to canonical names: order-free for scale, or one after the other as mentions come."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.text import base_form, normalize_entity
from ..vocab import TITLES
from .components import components

FUZZY = 0.85


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of two normal forms, 0 to 1: matching blocks over lengths. No built-in function gives it."""
    return pd.Series([1.0 if x == y and x else (SequenceMatcher(None, x, y).ratio() if x and y else 0.0) for x, y in zip(a, b)])


def first_forms(mentions: DataFrame) -> DataFrame:
    """(mention, seq) -> (norm, form, first_seq, n): the first spelling of each normal form, and how often it comes."""
    return mentions.withColumn("norm", normalize_entity("mention")).groupBy("norm").agg(F.min_by("mention", "seq").alias("form"), F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("n"))


def prefix_links(first: DataFrame) -> DataFrame:
    """(norm, longer): normal forms whose words begin another, by an equi-join on every proper prefix of words."""
    named = first.where("norm <> ''").select("norm")
    words = F.split("norm", " ")
    starts = named.select(F.col("norm").alias("longer"), F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), lambda i: F.array_join(F.slice(words, F.lit(1), i), " "))).alias("norm"))
    return starts.where("norm <> longer").join(named, "norm").select("norm", "longer")


def title_links(first: DataFrame) -> DataFrame:
    """(norm, longer): a form and the same form behind a title."""
    based = first.select(F.col("norm").alias("longer"), normalize_entity(base_form("form")).alias("norm")).where("norm <> longer AND norm <> ''")
    return based.join(first.select("norm"), "norm").select("norm", "longer")


def fuzzy_links(first: DataFrame, threshold: float = FUZZY) -> DataFrame:
    """(norm, longer, ratio): pairs of forms at or over the threshold.

    Only forms of near lengths that share a trigram, ends included, are compared: at a ratio of 0.85 some matching block
    is three characters long or reaches an end.
    """
    f = first.where("norm <> ''").select("norm", F.length("norm").alias("len"))
    grams = f.withColumn("padded", F.concat(F.lit("^"), "norm", F.lit("$"))).select("norm", "len", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("padded") - 2), lambda i: F.substring("padded", i, F.lit(3))))).alias("g"))
    pairs = grams.alias("a").join(grams.alias("b"), (F.col("a.g") == F.col("b.g")) & (F.col("a.norm") < F.col("b.norm")) & (2 * F.least("a.len", "b.len") >= threshold * (F.col("a.len") + F.col("b.len"))))
    pairs = pairs.select(F.col("a.norm").alias("norm"), F.col("b.norm").alias("longer")).distinct()
    return pairs.withColumn("ratio", ratio("norm", "longer")).where(F.col("ratio") >= threshold)


def resolve_batch(mentions: DataFrame, mode: str = "light", threshold: float = FUZZY) -> DataFrame:
    """(mention, seq) -> (norm, canonical): every form of a class of linked forms gets the class's name.

    Order-free: links are joins, classes are components. ``light``: word prefixes, named by the longest form; ``standard``:
    titles and similar spellings, named by the first form that came; ``none``: each mention itself.
    """
    if mode == "none":
        return mentions.select(F.col("mention").alias("norm"), F.col("mention").alias("canonical")).distinct()
    return resolve_forms(first_forms(mentions), mode, threshold)


def merge_forms(forms: DataFrame, newer: DataFrame) -> DataFrame:
    """Two tables of ``first_forms`` as one: the state that a resolution carries over builds and micro-batches."""
    both = forms.unionByName(newer)
    return both.groupBy("norm").agg(F.min_by("form", "first_seq").alias("form"), F.min("first_seq").alias("first_seq"), F.sum("n").alias("n"))


def resolve_forms(first: DataFrame, mode: str = "light", threshold: float = FUZZY) -> DataFrame:
    """``resolve_batch`` from the table of first forms."""
    links = prefix_links(first) if mode == "light" else title_links(first).unionByName(fuzzy_links(first, threshold).select("norm", "longer"))
    classes = components(links.select(F.col("norm").alias("src"), F.col("longer").alias("dst")))
    grouped = first.join(classes.withColumnRenamed("entity", "norm"), "norm", "left").withColumn("component", F.coalesce("component", "norm"))
    order = F.struct(-F.size(F.split("norm", " ")), -F.length("norm"), "first_seq") if mode == "light" else F.struct("first_seq")
    names = grouped.groupBy("component").agg(F.min_by("form", order).alias("canonical"))
    return grouped.join(names, "component").select("norm", "canonical")


def named(triples: DataFrame, resolved: DataFrame, ends: tuple[str, str] = ("subject", "object")) -> DataFrame:
    """Rows with both ends as their canonical names; the names as they were stay in ``subject_original``, ``object_original``."""
    out = triples
    for end, kept in zip(ends, ("subject_original", "object_original")):
        own = resolved.select(F.col("norm").alias("_norm"), F.col("canonical").alias("_name"))
        out = out.withColumn("_key", normalize_entity(end)).join(own, F.col("_key") == F.col("_norm"), "left")
        out = out.withColumn(kept, F.col(end)).withColumn(end, F.coalesce("_name", end)).drop("_key", "_norm", "_name")
    return out


def entity_frequency(mentions: DataFrame, resolved: DataFrame) -> DataFrame:
    return mentions.withColumn("norm", normalize_entity("mention")).join(resolved, "norm").groupBy("canonical").agg(F.count(F.lit(1)).alias("n"))


class Resolver:
    """One mention after the other; what a mention becomes depends on those before it. The state is three dictionaries."""

    def __init__(self, mode: str = "light", threshold: float = FUZZY, known: list[str] | None = None):
        self.mode, self.threshold = mode, threshold
        self.canonical: dict[str, str] = {}
        self.aliases: dict[str, str] = {}
        self.frequency: dict[str, int] = {}
        self.changed: set[str] = set()  # forms whose name the last mention set
        for e in known or []:
            if self.norm(e) not in self.canonical:
                self.canonical[self.norm(e)] = e
                self.frequency[e] = 0

    @staticmethod
    def norm(text: str) -> str:
        import string

        from ..vocab import ARTICLES

        x = " ".join(text.casefold().split()).strip(string.punctuation + " ")
        head, _, rest = x.partition(" ")
        return rest if head in ARTICLES else x

    @staticmethod
    def base(text: str) -> str:
        head, *rest = text.split() or [""]
        return " ".join(rest) if rest and head.lower() in TITLES else text

    def add_alias(self, alias: str, canonical: str) -> None:
        self.aliases[self.norm(alias)] = canonical
        self.changed.add(self.norm(alias))

    def register(self, canonical: str, aliases: list[str] | None = None) -> None:
        self.canonical[self.norm(canonical)] = canonical
        self.changed.add(self.norm(canonical))
        self.frequency.setdefault(canonical, 0)
        for a in aliases or []:
            self.add_alias(a, canonical)

    def select(self, candidates: list[str]) -> str:
        """The best of several spellings: untitled, then capitalised and short, then frequent."""
        if len(candidates) < 2:
            return candidates[0] if candidates else ""
        plain = [c for c in candidates if self.norm(self.base(c)) == self.norm(c)] or candidates
        upper = [c for c in plain if c[:1].isupper()]
        return min(upper, key=len) if upper else max(plain, key=lambda c: self.frequency.get(c, 0))

    def _count(self, canonical: str) -> str:
        self.frequency[canonical] = self.frequency.get(canonical, 0) + 1
        return canonical

    def _rename(self, old: str, new: str) -> None:
        """From now on the longer form names the entity; earlier results keep the shorter."""
        renamed = [n for n, c in self.canonical.items() if c == old] + [self.norm(new)]
        self.canonical.update(dict.fromkeys(renamed, new))
        self.changed.update(renamed, [self.norm(old)])
        self.frequency[new] = self.frequency.get(new, 0) + self.frequency.pop(old, 0)
        self.aliases[self.norm(old)] = new

    def _prefix(self, mention: str, canonical: str) -> str | None:
        a, b = self.norm(mention).split(), self.norm(canonical).split()
        if not a or not b:
            return None  # an empty form would begin every other
        if a == b:
            return mention if len(mention) >= len(canonical) else canonical
        if len(a) != len(b) and a[: min(len(a), len(b))] == b[: min(len(a), len(b))]:
            return mention if len(a) > len(b) else canonical
        return None

    def _titled(self, mention: str, canonical: str) -> bool:
        a, b = self.norm(mention), self.norm(canonical)
        return a != b and (self.norm(self.base(mention)) == b or self.norm(self.base(canonical)) == a)

    def _similar(self, a: str, b: str) -> bool:
        return bool(a and b) and (a == b or SequenceMatcher(None, a, b).ratio() >= self.threshold)

    def resolve(self, mention: str, register: bool = True) -> str:
        self.changed = set()
        if not mention:
            return mention
        n = self.norm(mention)
        if self.mode == "none":
            self.canonical.setdefault(n, mention)
            return self._count(mention)
        if n in self.canonical:
            return self._count(self.canonical[n])
        if n in self.aliases:
            return self._count(self.aliases[n])
        if self.mode == "light":
            for c in list(self.canonical.values()):
                if longer := self._prefix(mention, c):
                    if longer != c:
                        self._rename(c, longer)
                    self.add_alias(mention, longer)
                    return self._count(longer)
        else:
            for c in self.canonical.values():
                if self._titled(mention, c):
                    self.add_alias(mention, c)
                    return self._count(c)
            for known, c in self.canonical.items():
                if self._similar(n, known):
                    self.add_alias(mention, c)
                    return self._count(c)
        if not register:
            return mention
        self.register(mention, [mention])
        self.frequency[mention] = 1
        return mention

    def merge(self, one: str, two: str, keep: str | None = None) -> str:
        """Two entities as one: frequencies add up, the other name becomes an alias."""
        a, b = (self.canonical.get(self.norm(x), self.aliases.get(self.norm(x), x)) for x in (one, two))
        kept = keep or self.select([a, b])
        gone = b if kept == a else a
        self.frequency[kept] = self.frequency.get(a, 0) + self.frequency.get(b, 0)
        self.canonical = {n: kept if c == gone else c for n, c in self.canonical.items()}
        self.aliases = {n: kept if c == gone else c for n, c in self.aliases.items()}
        self.add_alias(gone, kept)
        return kept

    def stats(self, k: int = 10) -> dict:
        names = set(self.canonical.values())
        top = sorted(self.frequency.items(), key=lambda x: (-x[1], x[0]))[:k]
        return {"canonicals": len(names), "aliases": len(self.aliases), "mentions": sum(self.frequency.values()), "ratio": len(self.aliases) / len(names) if names else 0.0, "top": top}


def resolve_sequential(mentions: DataFrame, mode: str = "light", threshold: float = FUZZY) -> DataFrame:
    """(mention, seq) -> (mention, seq, canonical) in the order of ``seq``.

    Only the first of each normal form can change the registry, so only those go, in order, through a resolver; it hands
    on when each form's name changed, and every mention takes the name that held when it came. Forms that can never meet
    have a resolver each: in ``light`` mode those of another first word, else those that no chain of titles and similar
    spellings links.
    """
    keyed = mentions.withColumn("norm", normalize_entity("mention"))
    if mode == "none":
        return keyed.select("mention", "seq", F.col("mention").alias("canonical"))
    forms = first_forms(mentions)
    first = forms.select("norm", F.col("form").alias("mention"), F.col("first_seq").alias("seq"))
    if mode == "light":
        first = first.withColumn("part", F.split("norm", " ")[0])
    else:
        links = title_links(forms).unionByName(fuzzy_links(forms, threshold).select("norm", "longer"))
        parts = components(links.select(F.col("norm").alias("src"), F.col("longer").alias("dst"))).select(F.col("entity").alias("norm"), "component")
        first = first.join(parts, "norm", "left").withColumn("part", F.coalesce("component", "norm")).drop("component")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r, rows, last = Resolver(mode, threshold), [], {}
        for mention, seq in pdf.sort_values("seq")[["mention", "seq"]].itertuples(index=False):
            r.resolve(mention)
            for n in r.changed:
                c = r.canonical.get(n) or r.aliases.get(n)
                if last.get(n) != c:
                    rows.append((n, c, seq))
                    last[n] = c
        return pd.DataFrame(rows, columns=["norm", "canonical", "valid_from"])

    versions = first.groupBy("part").applyInPandas(run, "norm string, canonical string, valid_from long")
    both = keyed.select("norm", "seq", F.lit(1).alias("k"), "mention", F.lit(None).cast("string").alias("canonical")).unionByName(versions.select("norm", F.col("valid_from").alias("seq"), F.lit(0).alias("k"), F.lit(None).cast("string").alias("mention"), "canonical"))
    w = W.partitionBy("norm").orderBy("seq", "k").rowsBetween(W.unboundedPreceding, W.currentRow)
    return both.withColumn("canonical", F.last("canonical", True).over(w)).where("k = 1").select("mention", "seq", F.coalesce("canonical", "mention").alias("canonical"))


def dedup_stats(resolved: DataFrame, frequency: DataFrame) -> DataFrame:
    """One row: canonicals, aliases, mentions and aliases a canonical."""
    a = resolved.agg(F.countDistinct("canonical").alias("canonicals"), F.count(F.lit(1)).alias("aliases"))
    m = frequency.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("mentions"))
    return a.join(F.broadcast(m)).select("canonicals", "aliases", "mentions", F.when(F.col("canonicals") > 0, F.col("aliases") / F.col("canonicals")).otherwise(0.0).alias("ratio"))


def top_entities(frequency: DataFrame, k: int = 10) -> DataFrame:
    return frequency.orderBy(F.desc("n"), "canonical").limit(k)


def dedup_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: what a build added to the statistics of ``dedup_stats``."""
    b = before.toDF(*[f"b_{c}" for c in before.columns])
    return after.join(F.broadcast(b)).select(*[(F.col(c) - F.col(f"b_{c}")).alias(c) for c in ("canonicals", "aliases", "mentions")])
