"""Text types and languages by the share of patterns that a text has."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let
from ..vocab import LANGUAGE_WORDS, PATTERNS, TYPES, UNKNOWN

#: Caseless over all letters, lines end at line feeds alone, line anchors, Unicode classes.
FLAGS = "(?dimuU)"
#: Share of language words that the better language must exceed.
LANGUAGE_LEAST = 0.1


#: Letters that a caseless pattern takes for one of a to z, and ``lower`` leaves as they are.
_ALIKE = ("\u017f\u0131\u0130\u212a", "siik")


def needles(pattern: str) -> list[str]:
    """Lower-case strings of which a text with the pattern has one; none if the pattern's form does not tell.

    Known forms: words around a group of alternatives, maybe after another such group.
    """
    found = re.fullmatch(r"(?:\\b|\[A-Z\]\[a-z\]\+\\s\+)*(?:\([^()]*\)\\s\+)?\((?P<own>[^()\\\[\]{}*+?]+(?:\.\?[a-z]+)?)\)(?:\\b|\\s\+.*)?", pattern)
    if not found:
        return []
    own = [max(x.split(".?"), key=len).lower() for x in found["own"].split("|")]
    return own if all(own) and not any("." in x for x in own) else []


def folded(c: Column) -> Column:
    """A text in lower case, for ``contains``."""
    return F.lower(F.translate(c, *_ALIKE))


def has(c: Column, pattern: str, low: Column | None = None) -> Column:
    """Whether a text has a pattern. ``low``: the folded text, where the pattern's needles are looked for first."""
    hit = F.rlike(c, F.lit(FLAGS + pattern))
    own = needles(pattern) if low is not None else []
    if not own:
        return hit
    some = F.contains(low, F.lit(own[0]))
    for x in own[1:]:
        some = some | F.contains(low, F.lit(x))
    return F.when(some, hit).otherwise(F.lit(False))


class PatternSet:
    """Patterns by language and type; ``add`` extends them."""

    def __init__(self, patterns: dict[str, dict[str, list[str]]] | None = None):
        self.patterns = {k: {t: list(p) for t, p in v.items()} for k, v in (patterns or PATTERNS).items()}

    def add(self, kind: str, pattern: str, language: str = "en") -> PatternSet:
        out = PatternSet(self.patterns)
        out.patterns[language].setdefault(kind, []).append(pattern)
        return out

    @property
    def languages(self) -> list[str]:
        return sorted(self.patterns)

    def score(self, c: Column, kind: str, language: str = "en", low: Column | None = None) -> Column:
        own = self.patterns[language].get(kind, [])
        hits = [has(c, p, low).cast("int") for p in own]
        return sum(hits[1:], hits[0]) / F.lit(float(len(own))) if own else F.lit(0.0)

    def scores(self, c: Column, language: str = "en") -> Column:
        """Struct of the score of each type."""
        return let(folded(c), lambda low: F.struct(*[self.score(c, t, language, low).alias(t) for t in TYPES]))

    def matched(self, c: Column, kind: str, language: str = "en") -> Column:
        """The patterns of a type that a text has."""
        return F.array_compact(F.array(*[F.when(has(c, p), F.lit(p)) for p in self.patterns[language].get(kind, [])]))

    def _best(self, c: Column, low: Column, threshold: float, language: str) -> Column:
        limit = min(1.0, max(0.0, threshold))
        scored = F.array(*[F.struct(self.score(c, t, language, low).alias("confidence"), F.lit(-i).alias("order"), F.lit(t).alias("type")) for i, t in enumerate(TYPES)])
        return let(F.array_max(scored), lambda best: F.struct(F.when(best["confidence"] < limit, F.lit(UNKNOWN)).otherwise(best["type"]).alias("type"), best["confidence"].alias("confidence")))

    def _unless_blank(self, c: Column, found) -> Column:
        blank = F.coalesce(~F.rlike(c, F.lit(r"\S")), F.lit(True))
        return F.when(blank, F.struct(F.lit(UNKNOWN).alias("type"), F.lit(0.0).alias("confidence"))).otherwise(let(folded(c), found))

    def detect(self, c: Column, threshold: float = 0.3, language: str = "en") -> Column:
        """(type, confidence): the best type, the first of TYPES on ties; ``unknown`` under the threshold."""
        return self._unless_blank(c, lambda low: self._best(c, low, threshold, language))

    def detect_any(self, c: Column, threshold: float = 0.3) -> Column:
        """Like ``detect``, with the patterns of the text's own language."""
        return self._unless_blank(c, lambda low: F.when(_language(c, low) == "fr", self._best(c, low, threshold, "fr")).otherwise(self._best(c, low, threshold, "en")))


def language_scores(c: Column, low: Column | None = None) -> dict[str, Column]:
    """Share of each language's words that a text has."""
    out = {}
    for name, own in LANGUAGE_WORDS.items():
        hits = [has(c, rf"\b({w})\b", low).cast("int") for w in own]
        out[name] = sum(hits[1:], hits[0]) / F.lit(float(len(own)))
    return out


def _language(c: Column, low: Column) -> Column:
    s = language_scores(c, low)
    both = F.struct(s["fr"].alias("fr"), s["en"].alias("en"))
    return let(both, lambda x: F.when((x["fr"] > x["en"]) & (x["fr"] > LANGUAGE_LEAST), F.lit("fr")).otherwise(F.lit("en")))


def language(c: Column) -> Column:
    """``fr`` where its share is over both the other's and ``LANGUAGE_LEAST``, else ``en``."""
    return let(folded(c), lambda low: _language(c, low))


DEFAULT = PatternSet()
