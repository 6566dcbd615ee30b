"""Registered queries that SQL can't express, against versions in plain Python over the whole smallest tables."""

import itertools
import os
import re
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from weftgraph.operators import retrieve, triples
from weftgraph.plans.registry import ORACLE, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")

#: Queries without SQL, and where a test says what they have to give.
TESTED = {
    "f3_similarity_ratio", "f7_line_chunks", "s4_page_passages", "x2_pattern_triples", "j15_fuzzy_join", "n1_resolve_sequential", "n3_resolve_standard", "v3_hybrid_query",
    "g8_communities", "w10_ranked_communities", "j20_node_communities", "g11_page_layout",
}


def test_every_query_without_sql_has_its_brute_force():
    assert set(QUERIES) - set(ORACLE) == TESTED


def rows(name, *columns):
    return list(zip(*(pq.read_table(f"{SF}/{name}.parquet", columns=[c])[c].to_pylist() for c in columns)))


def line_chunks(text, size=500, overlap=50):
    """Whole lines up to a size; the last lines that fit into the overlap are said again."""
    out, current = [], []
    length = lambda lines: len("\n".join(lines))
    for line in filter(None, text.split("\n")):
        if current and length([*current, line]) > size:
            out.append("\n".join(current))
            while current and (length(current) > overlap or length([*current, line]) > size):
                current.pop(0)
        current.append(line)
    return out + (["\n".join(current)] if current else [])


@pytest.mark.parametrize("name", ["f7_line_chunks", "s4_page_passages"])
def test_line_chunks(spark, name):
    key = "doc_id" if name == "f7_line_chunks" else "page_num"
    got = {(r[key], r["chunk_num"]): r["content"] for r in QUERIES[name](spark, SF).collect()}
    assert got == {(d, i): c for d, t in rows("documents", "doc_id", "text") for i, c in enumerate(line_chunks(t or ""))}


def similarity(a, b):
    return 1.0 if a == b and a else SequenceMatcher(None, a, b).ratio() if a and b else 0.0


def test_similarity_ratio(spark):
    names = sorted({n for (n,) in rows("part", "p_name")})
    want = {(a, b): round(similarity(a, b), 6) for a in names for b in names if a.split(" ")[1:2] == b.split(" ")[1:2]}
    assert {(r["a"], r["b"]): r["ratio"] for r in QUERIES["f3_similarity_ratio"](spark, SF).collect()} == want


def test_fuzzy_join_finds_all_pairs(spark):
    """The trigram argument of the join against all pairs, on the table and on random short and long forms."""
    import random

    from weftgraph.operators import resolve

    rng = random.Random(3)
    forms = {"".join(rng.choice("abcd e") for _ in range(rng.randint(1, 14))).strip() for _ in range(250)}
    for f in list(forms)[:120]:
        at = rng.randrange(len(f) + 1) if f else 0
        forms.add((f[:at] + rng.choice("abcd") + f[at + rng.randint(0, 1) :]).strip())
    forms = sorted(x for x in {" ".join(f.split()) for f in forms} if x and x.split(" ")[0] not in ("a", "an", "the", "le", "la", "les", "un", "une"))
    df = spark.createDataFrame([(f, i) for i, f in enumerate(forms)], "mention string, seq long")
    got = {(r["norm"], r["longer"]) for r in resolve.fuzzy_links(resolve.first_forms(df)).collect()}
    assert got == {(a, b) for a, b in itertools.combinations(forms, 2) if max(similarity(a, b), 0) >= resolve.FUZZY}
    table = sorted({n.lower() for (n,) in rows("part", "p_name")})
    want = {(a, b): round(similarity(a, b), 6) for a, b in itertools.combinations(table, 2) if similarity(a, b) >= resolve.FUZZY}
    assert {(r["norm"], r["longer"]): r["ratio"] for r in QUERIES["j15_fuzzy_join"](spark, SF).collect()} == want


# The documented forms of the three patterns.
IS = re.compile(r"([A-ZÀ-Ý][a-zà-ÿ]+(?:\s+[A-ZÀ-Ý]?[a-zà-ÿ]+)*)\s+(?:is|est|was|était)\s+(?:a|an|un|une|the|le|la)?\s*([a-zà-ÿ]+(?:\s+[a-zà-ÿ]+)*)", re.I)
TITLE = re.compile(r"([A-ZÀ-Ý][a-zà-ÿ]+),?\s+(?:king|queen|prince|goddess|god|roi|reine|prince|déesse|dieu)\s+(?:of|de|du|des)\s+([A-ZÀ-Ý][a-zà-ÿ]+)", re.I)
AND = re.compile(r"([A-ZÀ-Ý][a-zà-ÿ]+)\s+(?:and|et)\s+([A-ZÀ-Ý][a-zà-ÿ]+)")


def found(text, runs=False):
    """``runs``: the first pattern, exponential on long runs of words, is tried on those with its verb alone."""
    parts = [x for x in re.findall(r"[a-zà-ÿ]+(?:\s+[a-zà-ÿ]+)*", text, re.I) if re.search(r"\s(?:is|est|was|était)\s", x, re.I)] if runs else [text]
    plain = re.compile(IS.pattern.replace("[A-ZÀ-Ý]?", ""), re.I) if runs else IS
    out = [(a.strip(), "IS_A", b.strip()) for a, b in [m for x in parts for m in plain.findall(x)][:3] if len(a) > 2 and len(b) > 2]
    out += [(a, "RULES", b) for a, b in TITLE.findall(text)[:3]]
    return out + [(a, "RELATED_TO", b) for a, b in AND.findall(text)[:2] if len(a) > 2 and len(b) > 2]


def test_patterns_equal_their_documented_forms(spark):
    import random

    rng = random.Random(5)
    some = ["is", "est", "was", "Was", "était", "a", "the", "une", "An", "Priam", "Zoë", "Straße", "Île", "x", "I", "king", "roi", "God", "of", "du", "and", "et", "Bob", "river", "Ann,", "end.", "new\n", "12", "don't", "été", "ÿak", "  ", "Þor"]
    texts = [" ".join(rng.choice(some) for _ in range(rng.randint(1, 11))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", triples.pattern_triples(F.col("t")).alias("f"))
    for r in df.collect():
        assert [tuple(x) for x in r["f"]] == found(texts[r["i"]]), texts[r["i"]]


def test_patterns_take_a_run_of_any_length(spark):
    words = " ".join(["word"] * 40_000)
    texts = [f"{words} is a {words}", f"I is {words}", f"{words}\n{words}", f"x was {words} est la reine {words}"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", triples.pattern_triples(F.col("t")).alias("f"))
    got = {r["i"]: [tuple(x) for x in r["f"]] for r in df.collect()}
    assert got == {0: [(words, "IS_A", words)], 1: [], 2: [], 3: [(f"was {words}", "IS_A", f"reine {words}")]}


def sentence_batches(text, size=500, overlap=50, n=4):
    cur, out = "", []
    for s in re.split(r"(?<=[.!?])\s+", text.strip()):
        if len(cur) + len(s) <= size:
            cur += s + " "
        else:
            if cur.strip():
                out.append(cur.strip())
            cur = cur[-overlap:] + s + " "
    out += [cur.strip()] if cur.strip() else []
    return ["\n\n".join(out[i : i + n]) for i in range(0, len(out), n)]


def test_pattern_triples_of_all_documents(spark):
    want = Counter((d, *t) for d, text in rows("documents", "doc_id", "text") for b in sentence_batches(text or "") for t in found(b, True))
    got = QUERIES["x2_pattern_triples"](spark, SF).collect()
    assert Counter((r["page_num"], r["subject"], r["predicate"], r["object"]) for r in got) == want
    assert len({r["seq"] for r in got}) == len(got)


def test_sequential_names(spark):
    """Light: a form takes the name of the first known one that it begins or that begins it, and a longer one renames it."""
    mentions = []
    for k, segment, nation in sorted(rows("customer", "c_custkey", "c_mktsegment", "c_nationkey")):
        mentions.append((k, [segment, "The " + segment.lower(), f"{segment} Street {nation}"][k % 3]))
    norm = lambda m: re.sub(r"^(the|a|an|le|la|les|un|une) ", "", " ".join(m.casefold().split()))
    names, want = {}, {}
    for k, m in mentions:
        n = norm(m)
        if n not in names:
            for known in list(dict.fromkeys(names.values())):
                a, b = n.split(), norm(known).split()
                if a != b and a[: len(b)] == b[: len(a)]:
                    if len(a) > len(b):
                        names = {x: m if c == known else c for x, c in names.items()}
                    names[n] = m if len(a) > len(b) else known
                    break
            else:
                names[n] = m
        want[k] = names[n]
    assert {r["seq"]: r["canonical"] for r in QUERIES["n1_resolve_sequential"](spark, SF).collect()} == want


def test_standard_names(spark):
    """Standard: the first known form that is similar gives the name; a form of its own names itself."""
    names, want = {}, {}
    for k, m in sorted(rows("part", "p_partkey", "p_name")):
        n = m.lower()
        if n not in names:
            names[n] = next((c for x, c in names.items() if x == c.lower() and similarity(n, x) >= 0.85), m)
        want[k] = names[n]
    assert {r["seq"]: r["canonical"] for r in QUERIES["n3_resolve_standard"](spark, SF).collect()} == want


def test_hybrid_query(spark):
    r = QUERIES["v3_hybrid_query"](spark, SF).first()
    vectors = dict(rows("embeddings", "vec_id", "embedding"))
    labels, texts = dict(rows("embeddings", "vec_id", "label")), dict(rows("documents", "doc_id", "text"))
    q = np.array(vectors[3], float)
    cosine = {i: float(np.array(v, float) @ q / np.linalg.norm(v) / np.linalg.norm(q)) for i, v in vectors.items() if i in texts}
    floor = next(t for t in retrieve.THRESHOLDS if max(cosine.values()) >= t)
    hits = [i for i, c in cosine.items() if c >= floor]
    assert r["rag_candidates"] == len(hits) and r["rag_unique"] == len({(i % 40, labels[i]) for i in hits})
    assert r["rag_duplicates"] == r["rag_candidates"] - r["rag_unique"] and r["rag_chunks"] <= r["rag_unique"]
    regions, nations = dict(rows("region", "r_regionkey", "r_name")), {k: (n, g) for k, n, g in rows("nation", "n_nationkey", "n_name", "n_regionkey")}
    links = {(n, regions[g]) for n, g in nations.values()}
    links |= {(n, nations[k][0]) for t, c in (("customer", "c"), ("supplier", "s")) for n, k in rows(t, f"{c}_name", f"{c}_nationkey")}
    assert r["subgraph_nodes"] <= 50 and 0 < r["subgraph_edges"] <= len(links) and "[Knowledge Graph Context]" in r["response"]


def test_budget_counts_passages_of_no_tokens(spark):
    """A running sum over the whole order, whatever the sizes, on both sides of a budget."""
    import random

    rng = random.Random(7)
    sizes = [0] * 60 + [rng.randint(0, 30) for _ in range(300)]
    rng.shuffle(sizes)
    df = spark.createDataFrame([(i, "x" * n) for i, n in enumerate(sizes)], "i long, content string").repartition(5)
    for budget in (0, 5, 700, 10**6):
        got = [(r["i"], r["used"]) for r in retrieve.within_budget(df, budget, ["i"]).orderBy("i").collect()]
        used = list(itertools.accumulate(n // 4 for n in sizes))
        assert got == [(i, u) for i, u in enumerate(used) if u <= budget]
    assert retrieve.falling(0.75) == (0.75, 0.5, 0.25) and retrieve.falling(0.5) == (0.5, 0.25, 0.10) and retrieve.falling(0.3) == (0.3, 0.10)


def test_rows_and_types_of_all(spark):
    for name in sorted(TESTED):
        assert QUERIES[name](spark, SF).count() > 0, name


def test_names_inside_texts(spark):
    import random

    from weftgraph.operators.graph import seeds
    from weftgraph.operators.substrings import inside

    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abA ") for _ in range(n))
    texts, names = {word(rng.randint(0, 12)) for _ in range(60)}, {word(rng.randint(0, 4)) for _ in range(40)}
    outer, inner = spark.createDataFrame([(t,) for t in texts], "t string"), spark.createDataFrame([(n,) for n in names], "n string")
    got = sorted((r["t"], r["n"]) for r in inside(outer, "t", inner, "n").collect())
    assert got == sorted((t, n) for t in texts for n in names if n and n in t)
    found = {r["wanted"]: r["entity"] for r in seeds(outer.withColumnRenamed("t", "entity").where("entity <> ''"), inner.withColumnRenamed("n", "wanted").where("wanted <> ''")).collect()}
    for w in names - {""}:
        tiers = [[t for t in texts if t and t == w], [t for t in texts if t and t.lower() == w.lower()], [t for t in texts if t and (w.lower() in t.lower() or t.lower() in w.lower())]]
        best = next((min(t, key=lambda x: (len(x), x)) for t in tiers if t), None)
        assert found.get(w) == best

