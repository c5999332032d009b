"""Secret scans with DataFrame functions only: patterns, and character Markov models for what they miss."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns in their order; the group and the least length of it that a match needs.
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]+", 0, 32),
}
# The same with the least length inside: true for every text that has a match long enough.
_HAS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8}""",
    "access": r"AKIA[A-Z0-9]{12}",
    "hex": r"[0-9a-f]{32}",
}
METHOD = "markov"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
#: Strings of this alphabet are scored from the length on that an assigned value needs.
LEAST = 8
_CANDIDATE = r"[A-Za-z0-9+/_=-]+"
#: Log-likelihood ratio from which a string is a secret, in all and for each character.
THRESHOLD, PER_CHAR = 8.0, 0.2
#: Documents, about, that the two models are fitted on, chosen by a hash of the text.
FIT_DOCS = 5_000
#: Matches whose positions are summed together; keeps long lists of matches near linear.
CHUNK = 256


def _pieces(text: Column, pattern: str, has: str, group: int, least: int) -> Column:
    """Length of what lies before each match, its own length, and its group where that is long enough."""
    p = F.lit(pattern)
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, p, F.lit(0)).alias("all"), F.regexp_extract_all(text, p, F.lit(group)).alias("value"))
    made = F.transform(
        F.filter(parts, lambda x: x["all"].isNotNull()),
        lambda x: F.struct(F.length(x["gap"]).cast("long").alias("gap"), F.length(x["all"]).cast("long").alias("n"), F.when(F.length(x["value"]) >= least, x["value"]).alias("value")),
    )
    return F.when(text.rlike(has), made)


def _spans(pieces: Column, rank: int) -> Column:
    """Spans (start, rank, end, value) in code points of the pieces that have a value."""
    span = "array<struct<start:bigint,rank:int,end:bigint,value:string>>"
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / CHUNK).cast("int")), lambda c: F.slice(pieces, c * CHUNK + 1, F.lit(CHUNK)))

    def one(s: Column, x: Column) -> Column:
        start = s["at"] + x["gap"]
        end = start + x["n"]
        made = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), x["value"].alias("value"))).cast(span)
        return F.struct(end.alias("at"), s["out"].alias("out"), F.concat(s["cur"], made).alias("cur"))

    def chunk(s: Column, xs: Column) -> Column:
        zero = F.struct(s["at"].alias("at"), s["out"].alias("out"), F.array().cast(span).alias("cur"))
        return F.aggregate(xs, zero, one, lambda r: F.struct(r["at"].alias("at"), F.concat(r["out"], F.array(r["cur"])).alias("out")))

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{span}>").alias("out"))
    all_spans = F.flatten(F.aggregate(chunks, zero, chunk, lambda s: s["out"]))
    found = F.filter(all_spans, lambda x: x["value"].isNotNull())
    return F.when(F.size(pieces) > 0, found).otherwise(F.array().cast(span))


def _outside(found: Column, base: Column) -> Column:
    """Parts of the spans ``found`` that no base span covers, from ``LEAST`` characters on, in one sweep over both by start."""
    span = "array<struct<start:bigint,rank:int,end:bigint,value:string>>"
    events = F.array_sort(F.concat(base, found))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(events) - 1) / CHUNK).cast("int")), lambda c: F.slice(events, c * CHUNK + 1, F.lit(CHUNK)))
    rank = len(BASE)

    def state(x: Column, at: Column, reach: Column, out: Column, cur: Column) -> Column:
        return F.struct(x.alias("x"), at.alias("at"), reach.alias("reach"), out.alias("out"), cur.alias("cur"))

    def part(s: Column, upto: Column) -> Column:
        """What of the span that is open lies from ``at`` to ``upto``."""
        end = F.least(upto, s["x"]["end"])
        value = F.substring(s["x"]["value"], (s["at"] - s["x"]["start"] + 1).cast("int"), (end - s["at"]).cast("int"))
        made = F.array(F.struct(s["at"].alias("start"), F.lit(rank).alias("rank"), end.alias("end"), value.alias("value")))
        return F.when(end - s["at"] >= LEAST, made).otherwise(F.array()).cast(span)

    def one(s: Column, x: Column) -> Column:
        opens = x["rank"] == rank
        cur = F.concat(s["cur"], part(s, F.when(opens, s["x"]["end"]).otherwise(x["start"])))
        at = F.when(opens, F.greatest(x["start"], s["reach"])).otherwise(F.greatest(s["at"], x["end"]))
        return state(F.when(opens, x).otherwise(s["x"]), at, F.when(opens, s["reach"]).otherwise(F.greatest(s["reach"], x["end"])), s["out"], cur)

    def chunk(s: Column, xs: Column) -> Column:
        return F.aggregate(xs, state(s["x"], s["at"], s["reach"], s["out"], F.array().cast(span)), one, lambda r: state(r["x"], r["at"], r["reach"], F.concat(r["out"], F.array(r["cur"])), F.array().cast(span)))

    none = F.struct(F.lit(0).cast("bigint").alias("start"), F.lit(rank).alias("rank"), F.lit(0).cast("bigint").alias("end"), F.lit("").alias("value"))
    zero = state(none, F.lit(0).cast("bigint"), F.lit(0).cast("bigint"), F.array().cast(f"array<{span}>"), F.array().cast(span))
    parts = F.aggregate(chunks, zero, chunk, lambda r: F.concat(r["out"], F.array(part(r, r["x"]["end"]))))
    return F.when((F.size(found) > 0) & (F.size(base) > 0), F.flatten(parts)).otherwise(found)


def _windows(word: Column) -> Column:
    """A word in parts of ``CHUNK`` characters, each with the next one's first: every pair lies in one part."""
    parts = F.regexp_extract_all(word, F.lit(".{1,%d}" % CHUNK), F.lit(0))
    return F.transform(parts, lambda p, i: F.concat(p, F.substring(F.coalesce(F.get(parts, i + 1), F.lit("")), 1, 1)))


def _codes(value: Column) -> Column:
    """Places of the characters in the alphabet."""
    return F.transform(F.split(value, ""), lambda c: F.position(c, F.lit(ALPHABET)) - 1)


def fit(docs: DataFrame, text_col: str = "text", fit_docs: int = FIT_DOCS) -> list[float]:
    """Log ratio of each character pair: random strings against ordinary identifiers.

    Labelled samples come from about ``fit_docs`` documents: strings that a base pattern finds are random,
    all other words of eight characters and more are ordinary. Half the weight of the random model is
    uniform, as secrets of other alphabets occur too. Only the table of pairs comes to the driver.
    """
    n = docs.count()
    text = F.col("text")
    sample = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter(F.pmod(F.xxhash64(F.lit(5), text), F.lit(1_000_000)) < int(1_000_000 * min(1.0, fit_docs / max(n, 1))))
    assigned = F.regexp_extract_all(text, F.lit(BASE["assign"][0]), F.lit(2))
    kinds = F.array(
        F.struct(F.lit(True).alias("random"), F.concat(assigned, F.regexp_extract_all(text, F.lit(r"AKIA[A-Z0-9]{12,}|[0-9a-f]{32,}"), F.lit(0))).alias("found")),
        F.struct(F.lit(False).alias("random"), F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9+/_-]{8,}"), F.lit(0)).alias("found")),
    )
    words = sample.select(F.explode(kinds).alias("k")).select("k.random", F.explode("k.found").alias("word")).filter(F.length("word") >= 8)
    random = words.filter("random").groupBy("word").agg(F.lit(1).alias("n"))
    plain = words.filter("NOT random").groupBy("word").agg(F.count(F.lit(1)).alias("n")).join(random.drop("n"), "word", "left_anti")
    labelled = random.withColumn("random", F.lit(True)).unionByName(plain.withColumn("random", F.lit(False)))
    pair = F.zip_with(F.expr("slice(codes, 1, size(codes) - 1)"), F.expr("slice(codes, 2, size(codes) - 1)"), lambda a, b: F.when((a >= 0) & (b >= 0), a * len(ALPHABET) + b))
    parts = labelled.select("random", "n", F.explode(_windows(F.col("word"))).alias("word"))
    counts = parts.withColumn("codes", _codes(F.col("word"))).select("random", "n", F.explode(pair).alias("pair")).groupBy("random", "pair").agg(F.sum("n").alias("n")).filter("pair IS NOT NULL").collect()
    k = len(ALPHABET)
    table = {side: [0.5] * (k * k) for side in (True, False)}
    for r in counts:
        table[r["random"]][r["pair"]] += r["n"]
    out = []
    for a in range(k):
        rows = {side: table[side][a * k : a * k + k] for side in table}
        sums = {side: sum(rows[side]) for side in rows}
        out += [math.log((0.5 * x / sums[True] + 0.5 / k) / (y / sums[False])) for x, y in zip(rows[True], rows[False], strict=True)]
    return out


def _ratio(value: Column, table: list[float]) -> Column:
    """Log-likelihood ratio of a string's pairs."""
    numbers = F.split(F.lit(",".join(f"{x:.5f}" for x in table)), ",").cast("array<double>")
    codes = _codes(value)
    return F.aggregate(
        codes,
        F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum")),
        lambda s, c: F.struct(c.alias("last"), F.when(s["last"] < 0, s["sum"]).otherwise(s["sum"] + F.get(numbers, s["last"] * len(ALPHABET) + c)).alias("sum")),
        lambda s: s["sum"],
    )


def scan(docs: DataFrame, table: list[float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets in whole texts: spans of the base patterns, and of strings that the Markov models call random.

    Base matches are leftmost and do not overlap within a kind; those whose group is too short are dropped
    after matching. A scored string (``markov``) is a run of the alphabet, or what base spans leave of one, each
    part scored by itself. Positions are code points, ends exclusive. Returns for each row ``<id_col>, n_assign, n_access, n_hex, base_sha256, spans, found``, the
    last as an array of (kind, start, end) by start, then kind. A null or empty text has no spans. Other
    columns are not read.
    """
    names = [*BASE, METHOD]
    df = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text = F.col("text")
    patterns = {k: (p, _HAS[k], g, n) for k, (p, g, n) in BASE.items()} | {METHOD: (_CANDIDATE[:-1] + "{%d,}" % LEAST, _CANDIDATE[:-1] + "{%d}" % LEAST, 0, LEAST)}
    df = df.select("id", *[_pieces(text, *patterns[k]).alias(k) for k in names])
    df = df.select("id", *[_spans(F.col(k), i).alias(k) for i, k in enumerate(names)])
    base = F.concat(*BASE)
    df = df.withColumn("base", F.array_sort(base))
    ratio = F.transform(METHOD, lambda x: F.struct(*[x[c].alias(c) for c in ("start", "rank", "end", "value")], _ratio(x["value"], table).alias("ratio")))
    df = df.withColumn(METHOD, _outside(F.col(METHOD), F.col("base")))
    df = df.withColumn("scored", F.when(F.size(METHOD) > 0, ratio))
    kept = F.filter("scored", lambda x: (x["ratio"] >= THRESHOLD) & (x["ratio"] >= PER_CHAR * F.length(x["value"])))
    kept = F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), x["value"].alias("value")))
    df = df.withColumn("every", F.when(F.size("scored") > 0, F.array_sort(F.concat("base", kept))).otherwise(F.col("base")))
    kind = lambda x: F.element_at(F.array(*map(F.lit, names)), x["rank"] + 1)
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", kind(x), x["start"], x["end"])), ",")
    return df.select(
        F.col("id").alias(id_col),
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(joined("base"), 256).alias("base_sha256"),
        joined("every").alias("spans"),
        F.transform("every", lambda x: F.struct(kind(x).alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).alias("found"),
    )
