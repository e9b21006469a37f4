"""Every dealt query over odd rows, over an empty table and over columns named like its own."""

import pytest
from tallystone.llm import queries

LONG = "word " * 40_000 + "x" * 200_000 + " 4111 1111 1111 1111 " + "é" * 50_000
ROWS = [
    (1, "the plain text of a row", "en", "a", 23),
    (1, "the plain text of a row", "en", "a", 23),
    (2, None, None, None, None),
    (None, "no id at all", None, "a", 12),
    (None, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, LONG, "en", "b", len(LONG)),
    (20, "mail me at a.b@c.example or +1 (743) 555-3824", "de", None, 1),
    (40, "   \n\t ", "xx", "", 6),
]
EXTRA = {c: "'clash'" for c in ("size", "taken", "fp", "n_tokens", "ids", "word", "host", "suffix", "key", "bucket", "turn", "target", "root", "row", "rid", "doc", "spans", "text_key", "_id", "accepted", "next_text", "ghost", "edited", "count")}
OPS = {name: f for name, f in queries.queries().items() if name.startswith("op")}


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("edges")
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *(f"{v} as `{c}`" for c, v in EXTRA.items()))
    docs.repartition(3).write.parquet(f"{base}/odd/documents.parquet")
    docs.where("false").write.parquet(f"{base}/none/documents.parquet")
    return base


@pytest.mark.parametrize("name", sorted(OPS))
def test_odd_and_empty_tables(spark, folders, name):
    odd = OPS[name](spark, f"{folders}/odd").collect()
    assert len(odd) == len(ROWS)
    assert sorted((r.doc_id for r in odd), key=lambda x: (x is None, x)) == sorted((r[0] for r in ROWS), key=lambda x: (x is None, x))
    twice = [tuple(r) for r in odd if r.doc_id == 1]
    # places, shares and next texts differ between equal rows
    assert name in ("op7_fingerprints", "op9_token_ids", "op10_source_mix") or twice[0] == twice[1]
    none = OPS[name](spark, f"{folders}/none")
    assert none.count() == 0 and none.columns == list(odd[0].asDict())
