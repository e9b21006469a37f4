"""The registered queries of the training-data operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.llm import fingerprints, idpack, langid, lm, mixing, neardup, pii, piececodec, tiff, tokencount
from tallystone.llm.common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.document_languages(table(spark, sf_dir, "documents"), ["doc_id"])


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piececodec.coded_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(table(spark, sf_dir, "documents"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compared(table(spark, sf_dir, "documents"))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.stored_texts(table(spark, sf_dir, "documents"))


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idpack.packed_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).drop("text_key")


def page_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 1 where it has all its evidence: markup, address suffix and host of web pages."""
    return langid.page_languages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def personal_data_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What operator 2 gives that SQL can say: how many base identifiers of each kind."""
    return pii.personal_data(table(spark, sf_dir, "documents")).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What operator 4 gives that SQL can say: words between white space."""
    return tokencount.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "n_words")


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What operator 10 gives that SQL can say: sizes and targets; what is taken depends on hashes."""
    mix = mixing.mixed(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"))


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What operator 7 gives that SQL can say: characters and the edited text's digest."""
    return fingerprints.compared(table(spark, sf_dir, "documents")).select("doc_id", "n_chars", "edited_sha256")


def stored_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What operator 8 gives that SQL can say: sizes."""
    return tiff.stored_texts(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "payload_bytes")


QUERIES = [op1_language_id, op2_personal_data, op3_near_duplicates, op4_token_counts, op5_sentencepiece, op6_lm_scores, op7_fingerprints, op8_media_columns, op9_token_ids, op10_source_mix, page_languages, personal_data_counts, word_counts, mix_targets, edited_texts, stored_payloads]


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

#: the digit rule of cards: from the right, every second digit counts double, digit by digit
LUHN = "list_sum(list_transform(range(1, len(x) + 1), lambda i: CASE WHEN i % 2 = 1 THEN cast(x[-i] AS int) WHEN cast(x[-i] AS int) > 4 THEN 2 * cast(x[-i] AS int) - 9 ELSE 2 * cast(x[-i] AS int) END)) % 10 = 0"

ORACLES = {
    "personal_data_counts": rf"""WITH m AS (SELECT doc_id, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') e, regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') i,
        list_transform(regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) c, list_transform(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: len(regexp_replace(x, '[^0-9]', '', 'g'))) p FROM (SELECT doc_id, coalesce(text, '') t FROM documents))
    SELECT doc_id, len(e) n_email, len(list_filter(i, lambda x: list_max(list_transform(string_split(x, '.'), lambda y: coalesce(try_cast(y AS ubigint), 999))) <= 255)) n_ip,
        len(list_filter(c, lambda x: CASE WHEN len(x) BETWEEN 12 AND 19 THEN {LUHN} ELSE false END)) n_card, len(list_filter(p, lambda x: x BETWEEN 9 AND 15)) n_phone FROM m""",
    "word_counts": f"SELECT doc_id, {WORDS} n_words FROM documents",
    "mix_targets": f"""WITH d AS (SELECT doc_id, source, {WORDS} size FROM documents), s AS (SELECT source, cast(sum(size) AS bigint) source_size, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] w FROM d GROUP BY source),
    o AS (SELECT *, sum(3 * source_size) OVER (ORDER BY 3 * source_size / w, source NULLS LAST) - 3 * source_size before, sum(w) OVER (ORDER BY 3 * source_size / w DESC, source DESC NULLS FIRST) rest, (SELECT sum(size) FROM d) total FROM s),
    l AS (SELECT arg_min(level, before) FILTER (WHERE level <= 3 * source_size / w) level FROM (SELECT *, (total - before) / rest level FROM o))
    SELECT doc_id, size, source_size, round(least(coalesce(level, 1e300) * w, 3.0 * source_size), 6) target FROM d JOIN s ON s.source IS NOT DISTINCT FROM d.source, l""",
    "edited_texts": """WITH d AS (SELECT doc_id, coalesce(text, '') t, lead(coalesce(text, '')) OVER (ORDER BY doc_id DESC) n, first_value(coalesce(text, '')) OVER (ORDER BY doc_id DESC) f FROM documents)
    SELECT doc_id, length(t) n_chars, sha256(concat(left(t, length(t) - length(t) // 3), left(coalesce(n, f), length(t) // 3))) edited_sha256 FROM d""",
    "stored_payloads": "SELECT doc_id, strlen(coalesce(text, '')) n_bytes, greatest(1, (strlen(coalesce(text, '')) + 63) // 64) * 64 payload_bytes FROM documents",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
