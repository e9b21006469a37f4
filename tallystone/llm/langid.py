"""Language identification by Bayesian evidence fusion.

Four kinds of evidence are multiplied for every language:
- the text: byte-trigram likelihoods, tempered to the weight of a short passage, because
  neighbouring trigrams repeat each other's evidence; "und", no language, is even noise;
- the declared markup language: how often each code is declared on texts of a language;
- the address suffix: how often addresses of a language end so;
- the host: its mix of languages, smoothed towards its suffix's mix and that towards the
  mix of the whole table.
The last three come from grouped aggregations of what the text alone says, over all rows; a
row's own part is left out of the mixes that speak for it.

Classes: every label of two or three letters that LEAST_ROWS rows or more have. The trigram
tables are fitted on a bounded sample of labelled rows: about TRAIN_ROWS rows of each of
them, chosen by a hash of the id; their trigrams are counted where the rows are, and only
the counts come to the driver. Nothing else is sampled.

Defined results: null, empty and wordless texts have no text evidence and fall to the other
kinds; missing evidence of a kind counts for no language; of languages with equal belief the
first in the order of codes wins, "und" last; a row is accepted if its best language isn't
"und" and holds half of the belief or more. Very long texts count whole. One row out per row
in, whatever other columns are called; an empty table gives none.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallystone.llm.common import written

TRAIN_ROWS = 400
LEAST_ROWS = 5
BUCKETS = 1 << 16
WEIGHT = 40.0  # trigrams that a text's evidence counts as, at most
NONE = "und"
SALTS = 16
EVEN = 0.02  # prior belief in "und"

DIGIT = re.compile(b"[0-9]")


def trigrams(text: str | None) -> np.ndarray:
    """Buckets of the byte trigrams of the words without digits, A-Z lower-cased and white space as one blank."""
    raw = (text or "").encode().lower()
    words = raw.split()
    if DIGIT.search(raw):
        words = [w for w in words if not DIGIT.search(w)]
    raw = b" ".join(words)
    if not raw:
        return np.zeros(0, np.int64)
    b = np.frombuffer(b" " + raw + b" ", np.uint8).astype(np.uint32)
    mixed = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    return ((mixed * np.uint32(2654435761)) >> 16).astype(np.int64)


class TextModel:
    """Log-likelihood tables: one column per language, even noise last."""

    def __init__(self, languages: list[str], tables: np.ndarray) -> None:
        self.languages, self.tables = languages, tables

    @classmethod
    def of_counts(cls, languages: list[str], counts: np.ndarray) -> TextModel:
        """From the trigram counts, a row a language."""
        counts = np.concatenate([counts + 0.05, np.ones((1, BUCKETS))])  # "und": all buckets alike
        return cls(languages, np.log(counts / counts.sum(1, keepdims=True)).T.astype(np.float32))

    @classmethod
    def fit(cls, rows: list[tuple[str, str]]) -> TextModel:
        languages = sorted({lang for lang, _ in rows})
        counts = np.zeros((len(languages), BUCKETS))
        for lang, text in rows:
            counts[languages.index(lang)] += np.bincount(trigrams(text), minlength=BUCKETS)
        return cls.of_counts(languages, counts)

    def score(self, text: str | None) -> tuple[list[float], int]:
        """Mean log-likelihood by class, and the number of trigrams."""
        at = trigrams(text)
        if not len(at):
            return [0.0] * (len(self.languages) + 1), 0
        total = np.zeros(self.tables.shape[1])
        for i in range(0, len(at), 1 << 16):
            total += self.tables[at[i : i + (1 << 16)]].sum(0, dtype=np.float64)
        return (total / len(at)).tolist(), len(at)


def fitted(df: DataFrame, label_col: str = "lang", text_col: str = "text", id_col: str = "doc_id") -> TextModel:
    """A model of the labelled rows of df; see the module's bound."""
    label = F.lower(F.substring_index(label_col, "-", 1))
    code = label.rlike("^[a-z]{2,3}$")
    labels = {r[0]: r[1] for r in df.where(code).groupBy(label.alias("label")).count().where(F.col("count") >= LEAST_ROWS).collect()}  # a row for each code of two or three letters
    languages = sorted(labels)
    if not labels:
        return TextModel([], np.zeros((BUCKETS, 1), np.float32))
    turn = F.pmod(F.xxhash64(F.lit(11), F.col(id_col)), F.lit(1 << 30))
    below = F.element_at(F.create_map(*(F.lit(x) for lang, n in labels.items() for x in (lang, int((1 << 30) * min(1.0, TRAIN_ROWS / n))))), label)
    at = {lang: i for i, lang in enumerate(languages)}

    def run(batches):
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = counts.setdefault(at[lang], np.zeros(BUCKETS, np.int64))
                own += np.bincount(trigrams(text.as_py()), minlength=BUCKETS)
        for k, own in counts.items():
            seen = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), k), pa.int32()), pa.array(seen, pa.int32()), pa.array(own[seen])], ["k", "bucket", "n"])

    sample = df.where(code & label.isin(languages) & (turn < below)).select(label.alias("label"), F.col(text_col))
    counted = sample.mapInArrow(run, "k int, bucket int, n long").groupBy("k", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(languages), BUCKETS))
    counts[counted.column("k").to_numpy(), counted.column("bucket").to_numpy()] = counted.column("n").to_numpy()
    return TextModel.of_counts(languages, counts)


def text_scores(df: DataFrame, model: TextModel, text_col: str) -> DataFrame:
    """df with means, the mean log-likelihood of each class, and n, the trigrams, in place of the text."""
    keep = [c for c in df.columns if c != text_col]

    def run(batches):
        for batch in batches:
            scored = [model.score(t.as_py()) for t in batch.column(text_col)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array([s[0] for s in scored], pa.list_(pa.float64())), pa.array([s[1] for s in scored], pa.int64())], [*keep, "means", "n"])

    kept = T.StructType([df.schema[c] for c in keep] + [T.StructField("means", T.ArrayType(T.DoubleType())), T.StructField("n", T.LongType())])
    return df.mapInArrow(run, kept)


def _normal(logs: Column) -> Column:
    """Beliefs, summing to 1, out of an array of logarithms."""
    raised = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, b: a + b))


def _sums(df: DataFrame, key: str, size: int) -> DataFrame:
    """key, mix: the sum of the beliefs of its rows by class, and all of them."""
    got = df.where(F.col(key).isNotNull()).groupBy(key).agg(*(F.sum(F.col("belief")[i]).alias(f"b{i}") for i in range(size)))
    return got.select(key, F.array(*(f"b{i}" for i in range(size))).alias("mix"))


def identify(df: DataFrame, model: TextModel, keep: list[str], text_col: str = "text", **evidence) -> DataFrame:
    """The columns in `keep` beside lang, probability, text_lang, declared, host, suffix and accepted; see `fused`."""
    return fused(df, model, keep, text_col, **evidence).select("row.*", "lang", "probability", "text_lang", "declared", "host", "suffix", "accepted")


def fused(df: DataFrame, model: TextModel, keep: list[str], text_col: str = "text", declared: Column | None = None, suffix: Column | None = None, host: Column | None = None, host_strength: float = 5.0, suffix_strength: float = 20.0, trust: float = 0.8) -> DataFrame:
    """row (a struct of the columns in `keep`, whatever their names), lang, probability, text_lang, declared, host, suffix and accepted.

    trust: belief, before any count, that a declared code names the text's language.
    """
    classes = [*model.languages, NONE]
    size = len(classes)
    none = F.lit(None).cast("string")
    given = lambda c: (none if c is None else c.cast("string"))
    named = df.select(F.struct(*keep).alias("row"), F.col(text_col).alias("text"), F.lower(F.substring_index(given(declared), "-", 1)).alias("declared"), given(suffix).alias("suffix"), given(host).alias("host"))
    scored = text_scores(named, model, "text")
    logs = F.transform(F.col("means"), lambda m: m * F.least(F.col("n"), F.lit(WEIGHT)))
    scored = written(scored.withColumn("belief", _normal(logs)).drop("means"), "languages")

    everything = scored.agg(*(F.sum(F.col("belief")[i]) for i in range(size)), F.count("*")).head()
    rows = everything[size]
    overall = [((everything[i] or 0.0) + 1.0) / (rows + size) for i in range(size)]
    overall[-1] = EVEN
    overall = F.array(*(F.lit(x / sum(overall)) for x in overall))

    # what is declared: rows of a class are counted by code; without counts `trust` rules
    codes = {r[0]: r[1] for r in _sums(scored.where(F.col("declared").isin(classes[:-1])).withColumn("code", F.col("declared")), "code", size).collect()} if size > 1 else {}
    seen = [sum(m[k] for m in codes.values()) for k in range(size)]
    log_said = lambda c, k: float(np.log((codes.get(c, [0.0] * size)[k] + 10.0 * (trust if classes[k] == c else (1 - trust) / max(1, size - 2)) + 0.01) / (seen[k] + 10.0 + 0.01 * size)))
    said = df.sparkSession.createDataFrame([(c, [log_said(c, k) for k in range(size)]) for c in classes[:-1]], "code string, said array<double>")  # a row a class
    joined = scored.join(F.broadcast(said), F.col("declared") == F.col("code"), "left").drop("code")
    by_code = F.coalesce("said", F.array_repeat(F.lit(0.0), size))

    def smoothed(total: Column, parent: Column, strength: float) -> Column:
        mix = F.zip_with(total, F.col("belief"), lambda m, own: F.greatest(m - own, F.lit(0.0)))
        whole = F.aggregate(mix, F.lit(0.0), lambda a, b: a + b)
        return F.coalesce(F.zip_with(mix, parent, lambda m, p: (m + strength * p) / (whole + strength)), parent)

    suffixes = _sums(scored, "suffix", size).withColumnRenamed("mix", "suffix_mix")
    hosts = _sums(scored, "host", size).withColumnRenamed("mix", "host_mix")
    for key, mixes, given in (("suffix", suffixes, suffix), ("host", hosts, host)):
        if given is None:
            joined = joined.withColumn(f"{key}_mix", F.lit(None).cast("array<double>"))
            continue
        # rows that lack the key are spread by what stands in for it, a blank and their number;
        # a key's mix is copied to SALTS, so that the rows of a large host meet it in many tasks
        turn = F.xxhash64("belief", "n", "row")
        spread = F.concat(F.lit(" "), F.pmod(turn, F.lit(1 << 20)).cast("string"))
        copies = mixes.select(F.col(key).alias("_key"), f"{key}_mix", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_copy"))
        salted = joined.withColumn("_on", F.coalesce(key, spread)).withColumn("_salt", F.pmod(turn, F.lit(SALTS)).cast("int"))
        joined = salted.join(copies, (F.col("_on") == F.col("_key")) & (F.col("_salt") == F.col("_copy")), "left").drop("_on", "_key", "_salt", "_copy")
    joined = joined.withColumn("parent", smoothed(F.col("suffix_mix"), overall, suffix_strength))
    joined = joined.withColumn("prior", smoothed(F.col("host_mix"), F.col("parent"), host_strength))
    # a suffix counts by how it shifts the whole mix, unless the host has carried it already
    shift = F.when(F.col("host").isNull() & F.col("suffix").isNotNull(), F.col("parent")).otherwise(F.col("prior"))
    total = F.zip_with(F.zip_with(F.transform("belief", lambda b: F.log(b + 1e-12)), by_code, lambda a, b: a + b), shift, lambda a, p: a + F.log(p + 1e-9))
    names = F.array(*(F.lit(c) for c in classes))
    best = joined.withColumn("fused", _normal(total)).withColumn("at", F.array_position("fused", F.array_max("fused")).cast("int")).withColumn("text_at", F.array_position("belief", F.array_max("belief")).cast("int"))
    found = best.withColumn("lang", F.element_at(names, F.col("at"))).withColumn("probability", F.round(F.array_max("fused"), 6))
    return found.select("row", "lang", "probability", F.when(F.col("n") > 0, F.element_at(names, F.col("text_at"))).alias("text_lang"), "declared", "host", "suffix", ((F.col("lang") != NONE) & (F.col("probability") >= 0.5)).alias("accepted"))


def document_languages(df: DataFrame, keep: list[str], id_col: str = "doc_id") -> DataFrame:
    """Languages of a documents table: `lang` is what its source declared, `source` its host."""
    return identify(df, fitted(df, "lang", "text", id_col), keep, declared=F.col("lang"), host=F.col("source"))


def accepted_documents(df: DataFrame) -> DataFrame:
    """The rows of a documents table whose language is accepted, as they are.

    Decisions are made on small rows, and what is rejected is taken away: texts stay in
    place as long as the rejected are few. Rows of equal id and text stay or go together,
    and stay if one of them is accepted.
    """
    key = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    keyed = df.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("text_key"), "text", "lang", "source")
    found = fused(keyed, fitted(df), ["doc_id", "text_key"], declared=F.col("lang"), host=F.col("source")).select("row.*", "accepted")
    gone = found.groupBy("doc_id", "text_key").agg(F.bool_or("accepted").alias("stays")).where("not stays")
    gone = written(gone.select(F.col("doc_id").alias("_tally_id"), F.col("text_key").alias("_tally_key")), "rejected")
    return df.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col("_tally_id")) & (key == F.col("_tally_key")), "left_anti")


#: fixed values: what of a page isn't prose
NOT_PROSE = r"(?is)<!--.*?-->|<(script|style|nav)\b.*?</\1\s*>|<[^>]*>|&[a-zA-Z#0-9]{1,8};"


def page_languages(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """page_id, lang, ... of web pages: markup language, address suffix and host beside the prose."""
    host = F.lower(F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1))
    read = pages.select("page_id", "url", F.regexp_replace("html", NOT_PROSE, " ").alias("prose"), F.regexp_extract("html", r"""(?i)<html[^>]*\blang=["']?([A-Za-z-]+)""", 1).alias("markup"), F.when(host != "", host).alias("host"))
    named = lambda c: F.when(F.col(c) != "", F.col(c))
    return identify(read, fitted(documents), ["page_id"], "prose", declared=named("markup"), suffix=F.substring_index("host", ".", -1), host=F.col("host"))
