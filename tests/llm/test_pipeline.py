import math
from collections import Counter

import corpus_pipeline
import public_tokenizers
import test_corpus as by_hand
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_whole_results(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "pieces":
            assert out.columns == docs.columns, name
            docs = out.cache()
            assert docs.count() > 100
    done = corpus_pipeline.run(spark, SF)
    assert done.count() == docs.count() and done.where("n_tokens < 2").count() == 0


def test_language_stage_leaves_rows_as_they_are(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.unionByName(spark.createDataFrame([(None, None, None, None, None), (5, "", "xx-YY", "s", 0)], docs.schema)).selectExpr("*", "doc_id n", "text _id", "lang means")
    out = corpus_pipeline.languages(spark, odd, SF)
    assert out.columns == odd.columns
    kept = {tuple(r) for r in out.collect()}
    assert kept <= {tuple(r) for r in odd.collect()} and len(kept) > 0.95 * docs.count()


def test_stages_take_clashing_columns_and_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40).selectExpr("*", "doc_id _id", "text _key", "lang node", "1 size", "2 taken", "3 root", "4 fp", "5 n").cache()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs, SF).count() > 0
        assert stage(spark, docs.where("false"), SF).count() == 0


def odd_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60)
    rows = [tuple(r) for r in docs.collect()]
    long = " ".join(f"w{i % 977}" for i in range(25_000))
    texts = [r[1] for r in rows]
    near = " ".join(["changed", *texts[3].split()[1:]])
    rows += [(None, texts[0], "en", None, 1), (None, None, None, None, None), (7001, "", "en", "s", 0), (7002, None, None, "s", None), (7003, long, "en", "s", len(long)), (7004, long + " end", "en", None, len(long) + 4), (7005, near, "en", "t", len(near)), (None, "mail a.b@c.org or +1 (212) 555-0100 now", "en", None, 3)]
    rows += [rows[5], rows[5], (7006, texts[6], "en", "t", 9), (7007, "write a.b@c.org, x@y.zz and 10.0.0.1;4111 1111 1111 1111", "en", "t", 9)]
    return rows, spark.createDataFrame(rows, docs.schema).repartition(4)


def test_stages_against_brute_force(spark):
    """Each stage over null ids, null texts and sources, very long texts, repeated rows and near copies."""
    rows, df = odd_documents(spark)
    kept = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, df, SF).collect()]
    classes = by_hand.classes_by_hand([(i, by_hand.lower(r[1] or "")) for i, r in enumerate(rows)])
    of = {}
    for i, r in enumerate(rows):
        of.setdefault(classes[i], []).append(r)
    assert len(kept) == len(of)
    for group in of.values():
        least = min(((r[0] is None, r[0] or 0) for r in group))
        assert sum(k in group for k in kept) == 1 and next((k[0] is None, k[0] or 0) for k in kept if k in group) == least

    names = [f"<{k}>" for k in by_hand.pii.KINDS]
    spans = by_hand.extraction_by_hand([(i, r[1] or "") for i, r in enumerate(rows)])
    want = Counter()
    for i, r in enumerate(rows):
        out, at = "", 0
        for kind, a, b in (x.split(":") for x in spans[i].split(",") if x):
            a, b = int(a), int(b)
            if a >= at:
                out += r[1][at:a] + names[by_hand.pii.KINDS.index(kind)]
            at = max(at, b)
        text = None if r[1] is None else out + r[1][at:]
        want[(r[0], text, r[2], r[3], None if text is None else len(text))] += 1
    assert Counter(tuple(r) for r in corpus_pipeline.personal_data(spark, df, SF).collect()) == want

    mix, sizes = Counter(), {}
    for doc, source, size, _, _, taken in by_hand.mix_by_hand([(r[0], r[3], r[1]) for r in rows]):
        mix[doc, source, size] += taken
        sizes[doc, source, size] = sizes.get((doc, source, size), 0) + size
    times = Counter((r.doc_id, r.source, len(by_hand.WORD.findall(r.text or ""))) for r in corpus_pipeline.source_mix(spark, df, SF).collect())
    many = Counter((r[0], r[3], len(by_hand.WORD.findall(r[1] or ""))) for r in rows)
    assert times == Counter({k: n for k in mix if (n := many[k] * math.floor(mix[k] / max(1, sizes[k]) + 0.5))})

    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = Counter((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.pieces(spark, df, SF).select("doc_id", F.col("ids")).collect())
    assert got == Counter((r[0], tuple(lib.encode(r[1] or "", add_bos=True, add_eos=True))) for r in rows)
