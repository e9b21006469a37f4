"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Seeds: four base patterns find e-mail addresses, IPv4 addresses, payment cards and phone
numbers. The two words before an identifier are a lexical pattern. Candidates are whatever
else has a digit or an "@" in it, and addresses with "(at)" or "[at]": nothing is known of
them but where they stand.

Bootstrapping, ROUNDS times over the graph of patterns and instances:
- a pattern is scored for a kind: the belief in the instances that follow it, over every
  occurrence of its two words anywhere; it needs SUPPORT distinct believed instances;
- a candidate's belief in a kind is the noisy or of the patterns that it follows; from
  BELIEF on it counts as an instance wherever it stands, and so induces patterns that no
  seed has, which the next round scores.
Patterns of the last round from SURE on, and believed instances, give the found spans.

The base patterns are written with possessive quantifiers and guarded starts: same
leftmost matches, but linear time and flat stacks on very long runs. Offsets count code
points, ends are exclusive.

Defined results: a null text counts as empty and has no span; repeated rows repeat; rows of
equal id and text share their spans; null ids are a value like others; an empty table gives
no rows; other columns don't matter, whatever their names. Matches that fail their kind's
test are dropped without a retry. Candidates that touch a base span are none. Of kinds with
equal belief the first wins. Very long texts are searched whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.llm.common import written

KINDS = ("email", "ip", "card", "phone")

#: the base patterns, in the order of KINDS; \G lets a match start where the last one ended
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    # a whole run of digits with single blanks or hyphens between, of which only 12 to 19 digits matter
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: candidates: neighbouring chunks that each hold a digit or "@"; addresses in brackets
CHUNKS = r"(?<![^\s,;])(?=[^\s,;0-9@]*+[0-9@])[^\s,;]++(?:\x20(?=[^\s,;0-9@]*+[0-9@])[^\s,;]++)*+"
MASKED = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]++(?:\x20?(?:[(\[]dot[)\]]|\.)\x20?[A-Za-z0-9-]++)++"
TRAIL = r"[^\p{L}\p{N})]+$"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

#: read backwards: what separates, the word before, what separates, the word before that
CONTEXT = r"^[^\p{L}\p{N}]*+(\p{L}++)[^\p{L}]++(\p{L}++)"
SUPPORT = 3  # distinct believed instances that a pattern needs at any table size
SURE = 0.5  # score that a pattern needs to find spans
FAINT = 0.1  # score from which a pattern lends belief
BELIEF = 0.8  # belief that a candidate needs to count as an instance
ROUNDS = 3
BITS = 1 << 17  # marks of contexts that every task holds
SPAN = "array<struct<start:int,k:int,end:int,ctx:long,inst:string>>"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(match: Column) -> Column:
    """From the right, every second digit counts double, digit by digit."""
    back = F.reverse(_digits(match))
    digit = lambda i: F.substr(back, i, F.lit(1)).cast("int")
    twice = lambda d: 2 * d - F.when(d > 4, 9).otherwise(0)
    total = F.aggregate(F.sequence(F.lit(1), F.length(back)), F.lit(0), lambda a, i: a + F.when(i % 2 == 0, twice(digit(i))).otherwise(digit(i)))
    return total % 10 == 0


TESTS: dict[str, Callable[[Column], Column]] = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"),
    "card": _luhn,
    "phone": lambda m: F.length(_digits(m)).between(9, 15),
}


def _context(gap: Column) -> Column:
    """Hash of the two words before a match, null if the gap before it hasn't two."""
    back = F.reverse(gap)
    last, first = (F.lower(F.reverse(F.regexp_extract(back, CONTEXT, i))) for i in (1, 2))
    return F.when(first != "", F.xxhash64(first, last))


def _instance(match: Column) -> Column:
    """A candidate's name: its digits if it has no letter, else its lower case."""
    return F.when(match.rlike(r"\p{L}"), F.lower(match)).otherwise(F.regexp_replace(match, "[^0-9@]", ""))


def _spans(matches: Column, gaps: Column, kind: int, test: Callable[[Column], Column], instance: Callable[[Column], Column], trail: str | None = None) -> Column:
    """Places of the matches between the gaps, those that pass the test; without what `trail` matches."""

    def step(acc: Column, x: Column) -> Column:
        own = F.regexp_replace(x["m"], trail, "") if trail else x["m"]
        start = acc["pos"] + F.length(x["g"])
        one = F.array(F.struct(start.alias("start"), F.lit(kind).alias("k"), (start + F.length(own)).alias("end"), _context(x["g"]).alias("ctx"), instance(own).alias("inst")))
        passed = F.coalesce(test(own), F.lit(False)) & x["m"].isNotNull()
        return F.struct((start + F.coalesce(F.length(x["m"]), F.lit(0))).alias("pos"), F.when(passed, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    none = F.array().cast(SPAN)
    pairs = F.zip_with(matches, gaps, lambda m, g: F.struct(m.alias("m"), g.alias("g")))
    return F.when(F.size(matches) > 0, F.aggregate(pairs, F.struct(F.lit(0).alias("pos"), none.alias("out")), step)["out"]).otherwise(none)


def _clear(spans: Column, of: Column) -> Column:
    """Those of the spans that touch none of the others."""
    return F.when((F.size(spans) == 0) | (F.size(of) == 0), spans).otherwise(F.filter(spans, lambda s: ~F.exists(of, lambda b: (b["start"] < s["end"]) & (b["end"] > s["start"]))))


def found(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_key, spans (base) and others (candidates) of every row."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    has = {"email": F.contains("text", F.lit("@")), "ip": F.contains("text", F.lit(".")), "card": F.lit(True), "phone": F.contains("text", F.lit("+")), "chunks": F.lit(True), "masked": F.contains("text", F.lit("at)")) | F.contains("text", F.lit("at]"))}
    every = PATTERNS | {"chunks": CHUNKS, "masked": MASKED}
    nothing = F.array().cast("array<string>")
    rows = rows.withColumns({f"m_{k}": F.when(has[k], F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(nothing) for k, p in every.items()})
    rows = rows.withColumns({f"g_{k}": F.when(F.size(f"m_{k}") > 0, F.split("text", p, -1)).otherwise(nothing) for k, p in every.items()})
    base = [_spans(F.col(f"m_{k}"), F.col(f"g_{k}"), i, TESTS[k], F.lower) for i, k in enumerate(KINDS)]
    masked = _spans(F.col("m_masked"), F.col("g_masked"), 0, lambda m: F.lit(True), F.lower)
    chunks = _spans(F.col("m_chunks"), F.col("g_chunks"), -1, lambda m: F.length(m) > 0, _instance, TRAIL)
    rows = rows.select("doc_id", F.xxhash64("text").alias("text_key"), F.array_sort(F.concat(*base)).alias("spans"), masked.alias("masked"), chunks.alias("chunks"))
    rows = rows.withColumn("masked", _clear(F.col("masked"), F.col("spans")))
    return rows.select("doc_id", "text_key", "spans", F.concat("masked", _clear(F.col("chunks"), F.concat("spans", "masked"))).alias("others"))


def _joined(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["k"] + 1), s["start"], s["end"])), ",")


def _marked(contexts: DataFrame) -> Column:
    """Whether the column ctx may be one of the contexts: a look into BITS marks, set at the contexts' hashes.

    All contexts pass, and the fewer of the rest the fewer contexts there are: what passes is
    counted and then met exactly.
    """
    spot = F.pmod(F.col("ctx"), F.lit(BITS))
    mask = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int"))
    words = {r[0]: r[1] for r in contexts.select(spot.alias("at")).groupBy(F.floor(F.col("at") / 64).alias("word")).agg(F.bit_or(mask(F.col("at")))).collect()}  # BITS / 64 rows at most
    marks = F.expr(f"cast(array({','.join(f'{words.get(i, 0)}L' if words.get(i, 0) > -(1 << 63) else '-9223372036854775807L - 1L' for i in range(BITS // 64))}) as array<bigint>)")
    return F.get(marks, F.floor(spot / 64).cast("int")).bitwiseAND(mask(spot)) != 0


def graph(df: DataFrame, seen: DataFrame, text_col: str) -> DataFrame:
    """ctx, inst, k (null for candidates), n and times: how often the instance follows the context, and the context's words occur.

    Contexts that no candidate follows, or fewer than SUPPORT instances, can't become patterns of use.
    """
    named = lambda spans, k: seen.select(F.explode(spans).alias("s")).where("s.ctx is not null").select("s.ctx", "s.inst", k.alias("k"))
    edges = named("spans", F.col("s.k")).union(named("others", F.lit(None).cast("int"))).groupBy("ctx", "inst", "k").agg(F.count("*").alias("n"))
    edges = written(edges, "edges")
    contexts = edges.groupBy("ctx").agg(F.count("*").alias("all"), F.count_if(F.col("k").isNull()).alias("open")).where((F.col("all") >= SUPPORT) & (F.col("open") > 0)).select("ctx")
    contexts = written(contexts, "contexts")
    # pairs of neighbouring words are counted before they meet the contexts
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^\p{L}]+"), lambda w: w != "")
    pairs = F.transform(F.slice("w", F.lit(2), F.size("w")), lambda b, i: F.xxhash64(F.get("w", i), b))
    spoken = df.select(words.alias("w")).select(F.explode(pairs).alias("ctx")).where(_marked(contexts)).groupBy("ctx").agg(F.count("*").alias("times"))
    # an inner join: the planner would move a semi-join below the counting, to every pair of words
    spoken = written(spoken.join(contexts, "ctx"), "spoken")
    return written(edges.join(spoken, "ctx"), "graph")


def patterns(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ctx, pk) of patterns, and (inst, ik) of candidates, that the rounds leave above their thresholds."""
    seeds = edges.where("k is not null").select("ctx", "inst", "k", "n", "times", F.lit(1.0).alias("belief"))
    loose = edges.where("k is null").drop("k")
    held = None
    for _ in range(ROUNDS):
        told = seeds if held is None else seeds.union(loose.join(held, "inst").select("ctx", "inst", "k", "n", "times", "belief"))
        scored = told.groupBy("ctx", "k").agg((F.sum(F.col("n") * F.col("belief")) / F.max("times")).alias("score"), F.count_distinct(F.when(F.col("belief") >= BELIEF, F.col("inst"))).alias("support"))
        scored = written(scored.where(F.col("support") >= SUPPORT).select("ctx", "k", F.least("score", F.lit(0.99)).alias("score")), "patterns")
        doubt = F.sum(F.log(1 - F.col("score")))
        held = loose.join(scored.where(F.col("score") >= FAINT), "ctx").groupBy("inst", "k").agg((1 - F.exp(doubt)).alias("belief"))
        held = written(held.groupBy("inst").agg(F.min_by(F.struct("k", "belief"), F.struct(-F.col("belief"), F.col("k"))).alias("b")).select("inst", "b.k", "b.belief"), "belief")
    return scored.where(F.col("score") >= SURE).groupBy("ctx").agg(F.min_by("k", F.struct(-F.col("score"), F.col("k"))).alias("pk")), held.where(F.col("belief") >= BELIEF).select("inst", F.col("k").alias("ik"))


def personal_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, base and all: arrays of (start, k, end, ...) of every row, all sorted."""
    seen = written(found(df, id_col, text_col), "identifiers")
    sure, believed = patterns(graph(df, seen, text_col))
    near = seen.where(F.size("others") > 0).select("doc_id", "text_key", F.explode("others").alias("s")).select("doc_id", "text_key", "s.*")
    near = near.join(sure, "ctx", "left").join(believed, "inst", "left").withColumn("kind", F.coalesce("pk", "ik")).where("kind is not null and (k < 0 or k = kind)")
    new = near.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", F.col("kind").alias("k"), "end", F.lit(None).cast("long").alias("ctx"), F.lit(None).cast("string").alias("inst"))).alias("new"))
    new = new.select(F.col("doc_id").alias("_tally_id"), F.col("text_key").alias("_tally_key"), "new")
    joined = seen.join(new, F.col("doc_id").eqNullSafe(F.col("_tally_id")) & (F.col("text_key") == F.col("_tally_key")), "left")
    return joined.select("doc_id", "text_key", F.col("spans").alias("base"), F.array_sort(F.concat("spans", F.coalesce("new", F.array().cast(SPAN)))).alias("all"))


def personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and digests of the spans of every row."""
    spans = personal_spans(df, id_col, text_col)
    of_kind = lambda i: lambda s: s["k"] == i
    counts = [F.size(F.filter("base", of_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return spans.select(F.col("doc_id").cast("long").alias("doc_id"), *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("all")).alias("spans"), (F.size("all") - F.size("base")).cast("long").alias("n_found"))


def masked_documents(df: DataFrame) -> DataFrame:
    """The rows of df, each span of their texts replaced by its kind in angle brackets.

    Overlapping spans are masked together, under the name of the first.
    """
    spans = personal_spans(df).where(F.size("all") > 0).groupBy("doc_id", "text_key").agg(F.first("all").alias("_tally_all"))
    spans = written(spans.select(F.col("doc_id").alias("_tally_id"), F.col("text_key").alias("_tally_key"), "_tally_all"), "masks")
    names = F.array(*(F.lit(f"<{k}>") for k in KINDS))
    key = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    joined = df.join(spans, F.col("doc_id").eqNullSafe(F.col("_tally_id")) & (key == F.col("_tally_key")), "left")

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["pos"]
        upto = F.substr(F.col("text"), acc["pos"] + 1, F.greatest(s["start"] - acc["pos"], F.lit(0)))
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), F.when(fresh, F.concat(acc["out"], upto, F.element_at(names, s["k"] + 1))).otherwise(acc["out"]).alias("out"))

    walk = F.aggregate("_tally_all", F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substr(F.col("text"), a["pos"] + 1, F.length("text"))))
    text = F.when(F.col("_tally_all").isNull(), F.col("text")).otherwise(walk)
    masked = joined.withColumn("text", text)
    if "n_chars" in df.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(df.schema["n_chars"].dataType))
    return masked.select(*df.columns)
