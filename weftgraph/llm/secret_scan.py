"""Operator 2: secrets in whole texts, by three patterns and by character Markov models; built-in functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Kinds in the order of the report, their patterns and least lengths.
ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: The models look at runs of these characters, of this length at least.
CANDIDATE, SHORTEST = r"[A-Za-z0-9+/_-]{16,}={0,2}", 16
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
KINDS = ("assign", "access", "hex", "random")
#: Log-likelihood ratio, in nats, from which a run counts as random: that of prior odds of one in 160,000 runs.
RATIO = 12.0
#: Made samples of each label, and rows of the corpus, about, whose runs are labelled by the base patterns.
SAMPLES, ROWS, SEED = 4000, 4000, 5
#: Elements of an array that are folded at a time, so that a fold with many results takes linear time.
BLOCK = 64
SPAN = "struct<start:int,kind:int,end:int>"

#: Word parts of ordinary identifiers.
PARTS = (
    "get set add remove update delete create build make load save read write open close start stop run test check find sort merge split join count sum "
    "index item list map node edge path file name type value key user group role page view model table column row data time date year version config "
    "default option param result error message event handler service client server request response header body cache queue task worker thread lock "
    "image color width height size length offset limit total state status flag mode level order source target parent child root base local global "
    "license apache copyright section chapter figure example report summary project module package release build linux windows android"
).split()


def _let(value: str, body: str, name: str) -> str:
    """SQL: ``body`` with ``value`` under a name, so that it is found once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _scan(items: str, zero: str, add: str, keep: str, emit: str, kind: str) -> str:
    """SQL: array of what ``emit`` gives for the items that ``keep`` holds for, from the state ``s`` before an item ``z``.

    ``add`` is the state after it. Items are folded in blocks, whose first states come from a fold over the blocks.
    """
    blocks = f"transform(sequence(0, cast((size(zs) - 1) div {BLOCK} AS int)), b -> slice(zs, b * {BLOCK} + 1, {BLOCK}))"
    starts = f"aggregate(bs, struct({zero} AS s, cast(array() AS array<int>) AS starts), (acc, own) -> struct(aggregate(own, acc.s, (s, z) -> {add}) AS s, concat(acc.starts, array(acc.s)) AS starts), acc -> acc.starts)"
    after, hold, give = (x.replace("s.", "acc.s.").replace(" s ", " acc.s ") for x in (f" {add} ", f" {keep} ", f" {emit} "))
    fold = f"aggregate(own, struct(start AS s, cast(array() AS array<{kind}>) AS out), (acc, z) -> struct({after} AS s, CASE WHEN {hold} THEN concat(acc.out, array({give})) ELSE acc.out END AS out), acc -> acc.out)"
    found = _let(items, _let(blocks, f"flatten(zip_with(bs, {starts}, (own, start) -> {fold}))", "bs"), "zs")
    return f"CASE WHEN size({items}) > 0 THEN {found} ELSE cast(array() AS array<{kind}>) END"


def _cells(value: str) -> str:
    """SQL: the cell of the transition into each character of a run; row 0 is the start of a run."""
    codes = "array(" + ",".join(str(ALPHABET.find(chr(c)) + 1) for c in range(128)) + ")"
    coded = f"transform(split({value}, ''), c -> element_at({codes}, ascii(c) + 1))"
    return _let(coded, f"transform(cs, (c, i) -> CASE WHEN i > 0 THEN get(cs, i - 1) ELSE 0 END * {len(ALPHABET) + 1} + c + 1)", "cs")


def labelled_samples(spark: SparkSession, n: int = SAMPLES, docs: DataFrame | None = None, rows: int = ROWS) -> DataFrame:
    """(text, random): random strings in four alphabets, ordinary identifiers in five styles and numbers, made by rule.

    With ``docs`` (doc_id, text) also runs of about ``rows`` of them, by a hash of both: what the base patterns take for
    a secret's value is random, and all other runs of six characters or more, as they are and in capitals, are ordinary.
    """
    made = spark.range(n).select("id", F.sha2(F.col("id").cast("string"), 256).alias("x"), F.sha2(F.concat(F.lit("b"), F.col("id").cast("string")), 256).alias("y"))
    noise = "base64(unhex(concat(x, y)))"
    random = made.select(
        F.expr(f"substring(CASE id % 4 WHEN 0 THEN concat(x, y) WHEN 1 THEN {noise} WHEN 2 THEN regexp_replace(upper({noise}), '[+/=]', '') ELSE regexp_replace({noise}, '[+/=]', '') END, 1, cast(16 + id % 25 AS int))").alias("text"),
        F.lit(True).alias("random"),
    )
    parts = "array(" + ",".join(f"'{p}'" for p in PARTS) + ")"
    part = lambda k: f"element_at({parts}, cast(pmod(xxhash64(id, {k}), {len(PARTS)}) + 1 AS int))"
    some = f"slice(array({part(1)}, {part(2)}, {part(3)}, {part(4)}), 1, cast(3 + id % 2 AS int))"
    ordinary = spark.range(n).select("id", F.expr(some).alias("w")).select(
        F.expr(
            "concat(CASE id % 6 WHEN 0 THEN array_join(w, '_') WHEN 1 THEN array_join(transform(w, p -> initcap(p)), '') WHEN 2 THEN array_join(w, '-') "
            "WHEN 3 THEN upper(array_join(w, '_')) WHEN 4 THEN array_join(w, '/') ELSE substring(concat(abs(xxhash64(id, 5)), abs(xxhash64(id, 6))), 1, cast(10 + id % 15 AS int)) END, "
            "CASE WHEN id % 3 = 0 THEN cast(id % 100 AS string) WHEN id % 3 = 1 THEN concat('_', cast(1990 + id % 50 AS string)) ELSE '' END)"
        ).alias("text"),
        F.lit(False).alias("random"),
    )
    both = random.unionByName(ordinary)
    if docs is None:
        return both
    share = min(1.0, rows / max(1, docs.count()))
    bound = min((1 << 63) - 1, -(1 << 63) + int(share * (1 << 64)))
    some = docs.where(F.xxhash64("doc_id", "text", F.lit(SEED)) <= bound).select(F.coalesce("text", F.lit("")).alias("text"))
    values = f"concat(filter(regexp_extract_all(text, {_quoted(ASSIGN)}, 2), v -> length(v) >= {LEAST['assign']}), regexp_extract_all(text, '{_exact('access')}', 0), regexp_extract_all(text, '{_exact('hex')}', 0))"
    rest = f"regexp_extract_all(regexp_replace(regexp_replace(text, {_quoted(ASSIGN)}, ' '), '{_exact('access')}|{_exact('hex')}', ' '), '[A-Za-z0-9+/_-]{{6,}}={{0,2}}', 0)"
    secret = some.select(F.explode(F.expr(f"transform({values}, v -> translate(v, '.', ''))")).alias("text"), F.lit(True).alias("random"))
    plain = some.select(F.explode(F.expr(f"flatten(transform({rest}, v -> array(v, upper(v))))")).alias("text"), F.lit(False).alias("random"))
    return both.unionByName(secret).unionByName(plain)


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _exact(kind: str) -> str:
    """Pattern of a kind whose matches all have its least length."""
    return f"AKIA[A-Z0-9]{{{LEAST['access'] - 4},}}" if kind == "access" else f"[0-9a-f]{{{LEAST['hex']},}}"


def train(samples: DataFrame) -> list[float]:
    """(text, random) rows -> log-likelihood ratio of each transition between characters, random over ordinary.

    Texts are of the alphabet. Counts of character pairs are aggregated over all samples; what comes back is one number a
    pair of the alphabet.
    """
    pairs = samples.where("length(text) > 0 AND random IS NOT NULL").select("random", F.expr(f"explode({_cells('text')})").alias("cell"))
    width = len(ALPHABET) + 1
    counts = {True: [0.5] * (width * width), False: [0.5] * (width * width)}
    for r in pairs.groupBy("random", "cell").count().collect():  # at most two numbers a pair of the alphabet
        counts[r["random"]][r["cell"] - 1] += r["count"]
    rows = {k: [sum(c[a * width : (a + 1) * width]) for a in range(width)] for k, c in counts.items()}
    return [math.log(counts[True][i] / rows[True][i // width]) - math.log(counts[False][i] / rows[False][i // width]) for i in range(width * width)]


def _spans(pattern: str, kind: int, keep: str, group: int = 0) -> str:
    """SQL: array of (start, kind, end) of the non-overlapping matches in ``text`` that pass ``keep`` (of z.v), in code points.

    The text between matches and the matches alternate, so that lengths add up to places.
    """
    p = _quoted(pattern)
    step = (
        f"filter(transform(arrays_zip(split(text, {p}, -1), regexp_extract_all(text, {p}, 0), regexp_extract_all(text, {p}, {group})), "
        "z -> struct(length(z['0']) AS gap, length(z['1']) AS size, z['2'] AS v)), z -> z.size IS NOT NULL)"
    )
    found = _scan("steps", "0", "s + z.gap + z.size", keep, f"struct( s + z.gap AS start, {kind} AS kind, s + z.gap + z.size AS end)", SPAN)
    return f"CASE WHEN text RLIKE {p} THEN {_let(step, found, 'steps')} ELSE cast(array() AS array<{SPAN}>) END"


def _untouched(base: str, other: str) -> str:
    """SQL: the spans of ``other`` that no span of ``base`` touches, by one scan from either end over all in order."""
    flagged = f"struct<start:int,kind:int,end:int,bad:boolean>"
    sorted_ = f"array_sort(concat({base}, {other}))"
    forth = _scan("us", "0", f"CASE WHEN z.kind < {len(KINDS) - 1} THEN greatest( s , z.end) ELSE s END", "true", "struct(z.start AS start, z.kind AS kind, z.end AS end, s > z.start AS bad)", flagged)
    back = _scan("vs", "2147483647", f"CASE WHEN z.kind < {len(KINDS) - 1} THEN least( s , z.start) ELSE s END", f"z.kind = {len(KINDS) - 1} AND NOT z.bad AND s >= z.end", "struct(z.start AS start, z.kind AS kind, z.end AS end)", SPAN)
    return f"CASE WHEN size({base}) = 0 OR size({other}) = 0 THEN {other} ELSE {_let(sorted_, _let(f'reverse({forth})', f'reverse({back})', 'vs'), 'us')} END"


def secrets(spark: SparkSession, docs: DataFrame, ratios: list[float] | None = None) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> (doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans).

    Three patterns give the base spans; the Markov models add the runs of 16 characters or more that no base span
    touches and that are likelier as random strings than as ordinary ones by ``RATIO`` nats. ``ratios``: of ``train``,
    by default over ``labelled_samples`` with runs of about ``ROWS`` rows of ``docs``. Time is linear in a text's length
    and in its matches.

    Nulls: a null text has no spans; a null doc_id is carried. Empty texts have no spans (the SHA-256 of nothing). Very
    long texts are scanned whole. Repeated rows give repeated results; spans with one start are ordered by kind. An
    empty table gives an empty result. Further columns, whatever their names, are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ratios = train(labelled_samples(spark, docs=docs)) if ratios is None else ratios
    table = "cast(split('" + ",".join(f"{x:.5f}" for x in ratios) + "', ',') AS array<double>)"
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select(
        "doc_id",
        "text",
        F.expr(_spans(ASSIGN, 0, f"length(z.v) >= {LEAST['assign']}", 2)).alias("a"),
        F.expr(_spans(_exact("access"), 1, "true")).alias("k"),
        F.expr(_spans(_exact("hex"), 2, "true")).alias("h"),
    )
    likely = f"aggregate({_cells('z.v')}, 0D, (sum, cell) -> sum + element_at({table}, cell)) >= {RATIO}D"
    rows = rows.select("doc_id", "a", "k", "h", F.expr("array_sort(concat(a, k, h))").alias("base"), F.expr(_spans(CANDIDATE, 3, likely)).alias("m"))
    rows = rows.withColumn("m", F.expr(_untouched("base", "m")))
    names = "element_at(array(" + ",".join(f"'{k}'" for k in KINDS) + "), x.kind + 1)"
    line = lambda spans: F.expr(f"array_join(transform({spans}, x -> concat({names}, ':', x.start, ':', x.end)), ',')")
    count = lambda c: F.size(c).cast("long")
    return rows.select(
        "doc_id", count("a").alias("n_assign"), count("k").alias("n_access"), count("h").alias("n_hex"), count("m").alias("n_random"),
        F.sha2(line("base"), 256).alias("base_sha256"), line("array_sort(concat(base, m))").alias("spans"),
    )
