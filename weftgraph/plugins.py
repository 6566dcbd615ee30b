"""Optional model calls as DataFrame functions, with offline defaults; a failed call is a null and an error text."""

from __future__ import annotations

import re
import threading
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.text import cache_key, document_type, strip
from .vocab import EXAMPLES, INVERSES, TYPES, UNKNOWN

#: A model: a list of prompts -> a list of answers; it is built once a partition.
Model = Callable[[list[str]], list[str]]

#: Seconds that an answer may take, and characters of a chunk, of a document and of one text among many that a model reads.
TIMEOUT, CHUNK, DOCUMENT, AMONG = 120, 500, 2_000, 200

TYPE_PROMPT = "Name the kind of this text with one word of: " + ", ".join(TYPES) + ".\n\n{text}"
DOCUMENT_PROMPT = "Say what kind of document this is, in three lines:\nTYPE: one of " + ", ".join(TYPES) + "\nCONFIDENCE: HIGH, MEDIUM or LOW\nREASONING: a short reason\n\n{text}"
TYPES_PROMPT = "Name the kind of each numbered text with one word of: " + ", ".join(TYPES) + ". Answer with a number, a dot and the word, one a line.\n\n{texts}"
ENTITIES_PROMPT = "List the people, places, things and organisations in this question, separated by commas.\n\n{text}"
INVERSE_PROMPT = "For each predicate, name the one that holds the other way round, as a JSON object.\n\n{text}"
ANSWER_PROMPT = "Answer the question from this context alone.\n\n{context}\n\nQuestion: {question}"

#: What relations to look for in a text of each type.
SUBJECTS = {
    "narrative": "who the characters are to each other, what they do to each other, where they live and travel, and which event brings about which",
    "technical": "what a thing is, what it is part of, what it needs, causes or prevents, and which step comes before which",
    "conversational": "who speaks about what, who proposes, decides or refuses it, and who is to do it",
    "scientific": "who claims or cites what, by which method it was found, and what goes along with what or speaks against it",
    "unknown": "any relation that the text states between two named things",
}
TERSE = "Entities are proper names or terms of one to three words; no pronouns, no vague words, no whole clauses."
VERBOSE = "Entities may be full phrases as the text has them, but no pronouns; give every relation that the text states."


def extraction_prompt(doc_type: str, verbose: bool = False) -> str:
    """The template for a type, terse or verbose; ``{text}`` is left to fill in."""
    kind = doc_type if doc_type in TYPES else UNKNOWN
    known = list(dict.fromkeys([*relationship_examples(kind), *INVERSES.get(kind, {})]))
    lines = [
        f"This is {'a mixed' if kind == UNKNOWN else 'a ' + kind} text. List the relations in it: {SUBJECTS[kind]}.",
        VERBOSE if verbose else TERSE,
        f"Predicates are in capitals, such as {', '.join(known)}.",
        "One a line, as (subject, PREDICATE, object). Only what the text says.",
    ]
    return "\n".join(lines) + "\n\n{text}"


def relationship_examples(doc_type: str) -> list[str]:
    return EXAMPLES.get(doc_type, EXAMPLES[UNKNOWN])


def _within(seconds: float, call, *args):
    """What a call returns; a ``TimeoutError`` if it takes longer. The call is left behind in a thread that nothing waits for."""
    done: dict[str, object] = {}

    def run():
        try:
            done["value"] = call(*args)
        except Exception as e:  # noqa: BLE001  a model may fail in any way; the caller tells
            done["error"] = e

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    thread.join(seconds)
    if "error" in done:
        raise done["error"]
    if "value" not in done:
        raise TimeoutError(f"no answer in {seconds} s")
    return done["value"]


def ask(rows: DataFrame, prompt: str, make_model: Callable[[], Model], batch: int = 16, timeout: float = TIMEOUT) -> DataFrame:
    """``rows`` with ``answer`` and ``error`` for the prompts of a column; each distinct prompt is asked once.

    ``timeout``: seconds for the prompts of a batch.
    """
    distinct = rows.select(F.col(prompt).alias("prompt")).where("prompt IS NOT NULL").distinct()

    def run(frames):
        model = make_model()
        for pdf in frames:
            for at in range(0, len(pdf), batch):
                own = pdf.prompt.iloc[at : at + batch].tolist()
                try:
                    answers, errors = list(_within(timeout, model, own)), [None] * len(own)
                except Exception as e:  # noqa: BLE001  a model may fail in any way; the row tells
                    answers, errors = [None] * len(own), [f"{type(e).__name__}: {e}"] * len(own)
                yield pd.DataFrame({"prompt": own, "answer": answers, "error": errors})

    told = distinct.mapInPandas(run, "prompt string, answer string, error string")
    return rows.join(told.withColumnRenamed("prompt", prompt), prompt, "left")


def classify(texts: DataFrame, make_model: Callable[[], Model] | None = None, sample: int = CHUNK, text: str = "text", timeout: float = 30, prompt: str = TYPE_PROMPT) -> DataFrame:
    """``texts`` with ``doc_type``, ``confidence``, ``level``, ``reasoning`` and ``error`` from a model over each text's
    beginning; ``unknown`` without a model, after an error or after ``timeout`` seconds.

    Texts with one beginning are asked about once, by its MD5.
    """
    if make_model is None:
        return texts.withColumns({"doc_type": F.lit(UNKNOWN), "confidence": F.lit(0.0), "level": F.lit("LOW"), "reasoning": F.lit(None).cast("string"), "error": F.lit(None).cast("string")})
    keyed = texts.withColumn("_key", cache_key(text, sample))
    once = keyed.groupBy("_key").agg(F.first(F.left(text, F.lit(sample))).alias("beginning"))
    asked = ask(once.withColumn("prompt", F.replace(F.lit(prompt), F.lit("{text}"), "beginning")), "prompt", make_model, timeout=timeout)
    return keyed.join(parsed_type(asked).select("_key", "doc_type", "confidence", "level", "reasoning", "error"), "_key", "left").drop("_key")


def classify_documents(texts: DataFrame, make_model: Callable[[], Model] | None = None, sample: int = DOCUMENT, **options) -> DataFrame:
    """``classify`` of whole documents, with the model's own word on how sure it is."""
    return classify(texts, make_model, sample, prompt=DOCUMENT_PROMPT, **options)


def classify_many(texts: DataFrame, make_model: Callable[[], Model], n: int = 10, sample: int = AMONG, text: str = "text", timeout: float = 30) -> DataFrame:
    """``texts`` with ``doc_type`` from a model that is given ``n`` numbered beginnings at a time; ``unknown`` where it names none."""
    keyed = texts.withColumn("_key", cache_key(text, sample))
    once = keyed.groupBy("_key").agg(F.first(F.left(text, F.lit(sample))).alias("beginning"))

    def run(frames):
        model = make_model()
        for pdf in frames:
            for at in range(0, len(pdf), n):
                own = pdf.iloc[at : at + n]
                lines = "\n".join(f'{i}. "{t}"' for i, t in enumerate(own.beginning, 1))
                try:
                    answer, error = _within(timeout, model, [TYPES_PROMPT.replace("{texts}", lines)])[0], None
                except Exception as e:  # noqa: BLE001  a model may fail in any way; the row tells
                    answer, error = "", f"{type(e).__name__}: {e}"
                told = {int(i): w.lower() for i, w in re.findall(r"(?m)^\s*(\d+)[.):]\s*(\w+)", answer or "")}
                yield pd.DataFrame({"_key": own._key, "doc_type": [told.get(i) if told.get(i) in TYPES else UNKNOWN for i in range(1, len(own) + 1)], "error": [error] * len(own)})

    told = once.mapInPandas(run, "_key string, doc_type string, error string")
    return keyed.join(told, "_key", "left").drop("_key")


def classifier_stats(classified: DataFrame, sample: int = CHUNK, text: str = "text") -> DataFrame:
    """One row on what ``classify`` did: distinct beginnings, texts that were no new one, calls and timeouts."""
    once = classified.groupBy(cache_key(text, sample).alias("_key")).agg(F.count(F.lit(1)).alias("n"), F.first("error", True).alias("error"))
    late = F.coalesce(F.startswith("error", F.lit("TimeoutError")), F.lit(False))
    return once.agg(F.count(F.lit(1)).alias("cache_size"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("cache_hits"), F.count(F.lit(1)).alias("calls"), F.count_if(late).alias("timeouts"))


def parsed_type(answers: DataFrame) -> DataFrame:
    """Reads ``TYPE: ... CONFIDENCE: ... REASONING: ...``, or a bare word, from ``answer``."""
    a = F.coalesce("answer", F.lit(""))
    labelled = F.regexp_extract(a, r"(?i)TYPE:\s*\[?(\w+)", 1)
    said = F.upper(F.regexp_extract(a, r"(?i)CONFIDENCE:\s*\[?(HIGH|MEDIUM|LOW)", 1))
    level = F.when(said != "", said).otherwise(F.lit("LOW"))
    number = F.try_to_number(F.regexp_extract(a, r"(?i)CONFIDENCE:\s*(\d+(?:\.\d+)?)", 1), F.lit("9.99")).cast("double")
    conf = F.coalesce(number, F.when(said == "HIGH", 0.9).when(said == "MEDIUM", 0.6).when(said == "LOW", 0.3).otherwise(0.0))
    return answers.withColumns({"doc_type": document_type(F.when(labelled != "", labelled).otherwise(strip(a))), "confidence": conf, "level": level, "reasoning": F.nullif(strip(F.regexp_extract(a, r"(?is)REASONING:\s*(.*)", 1)), F.lit(""))})


def model_entities(make_model: Callable[[], Model]):
    """Plug-in for ``question_entities``: (qid, question) -> (qid, candidate)."""

    def more(questions: DataFrame) -> DataFrame:
        asked = ask(questions.withColumn("prompt", F.replace(F.lit(ENTITIES_PROMPT), F.lit("{text}"), "question")), "prompt", make_model)
        return asked.select("qid", F.explode(F.filter(F.transform(F.split("answer", ","), strip), lambda x: F.length(x) > 1)).alias("candidate"))

    return more


def model_triples(make_model: Callable[[], Model], doc_type: str | None = None, verbose: bool = False, timeout: float = TIMEOUT):
    """Plug-in for ``triples.extract``: adds ``triples`` by the prompt of each row's ``doc_type``, or of the one given.

    They are null where no answer came in time, so that patterns fill in, and none where the model failed.
    """
    from .operators.triples import TRIPLE, parsed_triples

    def add(batches: DataFrame) -> DataFrame:
        kinds = F.col("doc_type") if doc_type is None and "doc_type" in batches.columns else F.lit(doc_type or UNKNOWN)
        template = F.lit(extraction_prompt(UNKNOWN, verbose))
        for kind in TYPES:
            template = F.when(kinds == kind, F.lit(extraction_prompt(kind, verbose))).otherwise(template)
        asked = ask(batches.withColumn("prompt", F.replace(template, F.lit("{text}"), "text")), "prompt", make_model, timeout=timeout)
        failed = F.col("error").isNotNull() & ~F.startswith("error", F.lit("TimeoutError"))
        found = F.when(F.col("answer").isNotNull(), parsed_triples(F.col("answer"))).when(failed, F.array().cast(TRIPLE))
        return asked.withColumn("triples", found).drop("prompt", "answer", "error")

    return add


def model_inverses(make_model: Callable[[], Model], batch: int = 50):
    """Plug-in for ``resolve_inverses``: (predicate) -> (predicate, inverse) from JSON objects, some predicates a prompt."""
    from .functions.text import json_object

    def answer(rest: DataFrame) -> DataFrame:
        grouped = rest.groupBy(F.pmod(F.xxhash64("predicate"), F.lit(batch)).alias("g")).agg(F.array_join(F.array_sort(F.collect_list("predicate")), ", ").alias("l"))
        asked = ask(grouped.withColumn("prompt", F.replace(F.lit(INVERSE_PROMPT), F.lit("{text}"), "l")), "prompt", make_model)
        found = asked.select(F.explode(F.from_json(json_object("answer"), "map<string,string>")).alias("predicate", "inverse"))
        return rest.join(found, "predicate")

    return answer


def answers(contexts: DataFrame, make_model: Callable[[], Model] | None = None) -> DataFrame:
    """(question, context) with ``response``: the model's answer, its error as text, or the context itself without one."""
    if make_model is None:
        return contexts.withColumn("response", F.col("context"))
    prompt = F.replace(F.replace(F.lit(ANSWER_PROMPT), F.lit("{question}"), "question"), F.lit("{context}"), "context")
    return ask(contexts.withColumn("prompt", prompt), "prompt", make_model).withColumn("response", F.coalesce("answer", F.concat(F.lit("Error: "), "error"))).drop("prompt", "answer", "error")
