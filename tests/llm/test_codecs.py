import hashlib
import math
import random
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tallystone.llm import idpack, piececodec, tiff, tokencount

TEXTS = [None, "", " ", "  two  spaces ", "plain words here", "line\nbreak\n\nmore\ttabs", "Öß ▁ mark é́ 漢字 🙂🙂", "a" * 5000, "it's WE'LL don't 123 <|endoftext|> x", "\x00nul \x85 next", " ́combining", "ΑΣ ΣΑΣ", "x" + " " * 300 + "y", " nbsp  em"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "again"), (None, "no id", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(3)


def test_pieces_match_the_library(spark, docs):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = piececodec.coded_texts(docs, P.path("piece_bpe_32k.model")).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        text = "no id" if r.doc_id is None else TEXTS[r.doc_id] or ""
        ids = lib.encode(text, add_bos=True, add_eos=True)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
        assert r.covered


def test_piece_spans_point_at_their_source():
    own = piececodec.PieceCodec(P.path("piece_bpe_32k.model"))
    for text in filter(None, TEXTS):
        raw = text.encode()
        ids, a, b = own.encode(text)
        for i, s, e in zip(ids.tolist(), a.tolist(), b.tolist()):
            piece = own.surface[i]
            assert raw[s:e].replace("▁".encode(), b" ") in (piece, piece[1:])


def test_lenient_decoding_matches_the_library():
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    own = piececodec.PieceCodec(P.path("piece_bpe_32k.model"))
    rng = random.Random(5)
    for _ in range(200):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(259, 32000)]) for _ in range(12)]
        assert own.decode(ids) == lib.decode(ids)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
def test_compiled_map_normalisation(rule):
    import sentencepiece

    lib = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=True)
    from sentencepiece import sentencepiece_model_pb2 as pb

    spec = pb.ModelProto.FromString(lib.serialized_model_proto()).normalizer_spec
    own = piececodec.Normalizer(spec.precompiled_charsmap, True, True)
    for text in ["Ｆｕｌｌ ｗｉｄｔｈ", "ﬁne ½ ℡ ㍿", "  a  b　c ", "ÀÉ Straße", "", "   ", "é́ x"]:
        raw, source = own(text)
        assert raw.decode() == lib.normalize(text), text
        assert len(source) == len(raw) + 1 and (np.diff(source) >= 0).all()


def test_ids_round_trip(spark, docs):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = idpack.packed_texts(docs, P.path("word_bpe_49k.json")).orderBy("start").collect()
    assert len(got) == len(TEXTS) + 2
    at = 0
    for r in got:
        text = "no id" if r.doc_id is None else TEXTS[r.doc_id] or ""
        ids = [*lib.encode(text, add_special_tokens=False).ids, 1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), text
        at += len(ids)
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda x: -1 if x is None else x)


def test_ids_of_odd_texts_match_the_library():
    """Letters, marks, case and combining signs from ranges that normalisation and splitting treat apart."""
    import pyarrow as pa

    own, rng = idpack.TextEncoder(P.path("word_bpe_49k.json"), "H"), random.Random(4)
    assert own.cut
    pools = [range(32, 127), range(0x250), [*range(0x300, 0x370), *range(65, 123)], range(0x250, 0x3000), [0x130, 0x131, 0x149, 0x1E97, 0x308, 0x331, 84, 104, 72, 0x3A3, 32, 32], [*range(0x3000, 0x33FF), 32], [ord(c) for c in "<|startoftext|> 'sT.!"], [*range(0xA0, 0x250), *[32] * 40]]
    texts = ["".join(chr(rng.choice(pool)) for _ in range(rng.randint(0, 40))) for pool in pools for _ in range(400)]
    texts += ["a<|endoftext|>b <|STARTOFTEXT|>", "H\u0331 h\u0331 T\u0308", "x" * 3000, None, ""]
    for cut in (True, False):
        own.cut = cut
        got = [ids for _, part in own.encode(pa.array(texts, pa.string()).slice(3), 1) for ids in part.to_pylist()]
        for text, ids in zip(texts[3:], got, strict=True):
            assert np.frombuffer(ids, "<u2").tolist() == [*own.whole.encode(text or "", add_special_tokens=False).ids, 1], text


def test_the_least_id_isnt_null(spark):
    rows = [(-(1 << 63), "one two"), (None, "three"), (5, None)]
    got = idpack.packed_texts(spark.createDataFrame(rows, "doc_id long, text string"), P.path("word_bpe_49k.json")).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, -(1 << 63), 5]


def test_ids_of_an_empty_table(spark, docs):
    assert idpack.packed_texts(docs.limit(0), P.path("word_bpe_49k.json")).count() == 0


@pytest.mark.parametrize("vocabulary", [2, 5, 300, 49_408, 1 << 20])
def test_bit_packing_and_random_access(tmp_path, vocabulary):
    rng = np.random.default_rng(1)
    out = idpack.Writer(f"{tmp_path}/x.ids", vocabulary)
    docs = [rng.integers(0, vocabulary, n).astype(np.uint32) for n in (0, 1, 7, 50_000, 3, 200_000)]
    for k, d in enumerate(docs):
        out.add(k, d)
    out.close()
    back = idpack.Reader(f"{tmp_path}/x.ids")
    assert back.bits == max(1, (vocabulary - 1).bit_length())
    for (key, _, ids), want in zip(back.documents(), docs):
        assert (ids == want).all()
    flat = np.concatenate(docs)
    for _ in range(20):
        a, b = sorted(rng.integers(0, len(flat), 2))
        assert (back.ids(int(a), int(b)) == flat[a:b]).all()


def greedy(word, pieces):
    at, n = 0, 0
    while at < len(word):
        for end in range(len(word), at, -1):
            if (word[at:end] if at == 0 else "##" + word[at:end]) in pieces:
                break
        else:
            return 0
        at, n = end, n + 1
    return n


def test_automaton_against_greedy():
    rng = random.Random(3)
    for _ in range(300):
        pieces = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 4))) for _ in range(6)} | {"##" + "".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(8)}
        auto = tokencount.Automaton(sorted(pieces))
        for _ in range(40):
            word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))
            assert auto.length(word) == greedy(word, pieces), (word, pieces)


def test_token_counts(spark, docs):
    pieces = set(tokencount.word_pieces(P.path("piece_bpe_32k.model")))
    for r in tokencount.token_counts(docs, P.path("piece_bpe_32k.model")).collect():
        text = "no id" if r.doc_id is None else TEXTS[r.doc_id] or ""
        words = [w.decode() for w in text.encode().split()]
        lengths = [greedy(w, pieces) for w in words]
        assert (r.n_words, r.n_tokens, r.n_unknown) == (len(words), sum(n or 1 for n in lengths), lengths.count(0))


@pytest.mark.parametrize("code", [tiff.RAW, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE])
@pytest.mark.parametrize("tile", [0, 16])
@pytest.mark.parametrize("predictor", [1, 2])
def test_tiff_round_trip(code, tile, predictor):
    rng = np.random.default_rng(2)
    pages = [rng.integers(0, 256, (70, 64), dtype=np.uint8), np.repeat(rng.integers(0, 3, (33, 5, 3), dtype=np.uint8), 4, axis=1), np.zeros((1, 64), np.uint8), rng.integers(0, 9, (300, 64), dtype=np.uint8)]
    for order in "<>":
        back = list(tiff.read_pages(tiff.encode(pages, code, predictor, tile, order, strip_rows=40)))
        assert [r[-1] for r in back] == [None] * 4
        assert [r[5] for r in back] == [p.tobytes() for p in pages]


def test_tiff_columns(spark):
    good = tiff.encode([np.full((2, 64), 7, np.uint8)] * 2)
    rows = [(1, good), (2, None), (3, b""), (4, b"junk"), (5, good[: len(good) // 2]), (1, good)]
    got = tiff.tiff_pages(spark.createDataFrame(rows, "page long, media binary").withColumnRenamed("page", "id"), "media", ["id"]).collect()
    assert sorted((r.id, r.page) for r in got if r.error is None) == [(1, 0), (1, 0), (1, 1), (1, 1), (5, 0)]
    assert sorted({r.id for r in got if r.error}) == [4, 5]


def by_hand(fields, body=b"", order="<", at=8):
    """A one-page file: head, body, directory; fields as (tag, type, values), values of 4 bytes at most inline."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, at + len(body))) + body
    out += struct.pack(order + "H", len(fields))
    for tag, kind, values in fields:
        out += struct.pack(order + "HHI", tag, kind, len(values)) + struct.pack(order + {3: "H", 4: "I"}[kind] * len(values), *values).ljust(4, b"\0")
    return bytes(out + b"\0\0\0\0")


def page(cols, rows, code, *more):
    return [(256, 4, [cols]), (257, 4, [rows]), (258, 3, [8]), (259, 3, [code]), *more]


def test_files_made_by_hand():
    """Bytes written here after the format's description, not by the module's own writer."""
    for order in "<>":
        grey = bytes(range(6))
        good = by_hand(page(3, 2, 1, (273, 4, [8]), (278, 4, [2]), (279, 4, [6])), grey, order)
        assert [(r[0], r[1], r[2], r[5], r[-1]) for r in tiff.read_pages(good)] == [(0, 3, 2, grey, None)]
    packed, plain = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA"), bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    assert [r[5] for r in tiff.read_pages(by_hand(page(24, 1, 32773, (273, 4, [8]), (279, 4, [len(packed)])), packed))] == [plain]
    # codes 256, 7, 258, 8, 8, 258, 6, 6, 257 of 9 bits: 7 7 7 8 8 7 7 6 6
    codes = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 8, 258, 6, 6, 257))
    raw = int(codes.ljust(88, "0"), 2).to_bytes(11, "big")
    assert [r[5] for r in tiff.read_pages(by_hand(page(9, 1, 5, (273, 4, [8]), (279, 4, [11])), raw))] == [bytes((7, 7, 7, 8, 8, 7, 7, 6, 6))]
    deltas = zlib.compress(bytes((5, 1, 1, 250, 10, 0)))
    assert [r[5] for r in tiff.read_pages(by_hand(page(3, 2, 8, (317, 3, [2]), (273, 4, [8]), (278, 4, [2]), (279, 4, [len(deltas)])), deltas))] == [bytes((5, 6, 7, 250, 4, 4))]
    # two tiles of 16 x 16 over 20 x 3 samples
    left, right = np.arange(256, dtype=np.uint8).reshape(16, 16), np.full((16, 16), 9, np.uint8)
    at = 8
    body = left.tobytes() + right.tobytes() + struct.pack("<4I", at, at + 256, 256, 256)
    tiled = by_hand([*page(20, 3, 1), (322, 3, [16]), (323, 3, [16])], body)
    tiled = bytearray(by_hand([*page(20, 3, 1), (322, 3, [16]), (323, 3, [16]), (324, 4, [at + 512]), (325, 4, [at + 520])], body))
    for k in (6, 7):  # counts of 2: the values stand elsewhere
        struct.pack_into("<I", tiled, at + len(body) + 2 + 12 * k + 4, 2)
    assert [r[5] for r in tiff.read_pages(bytes(tiled))] == [np.concatenate([left[:3], right[:3, :4]], 1).tobytes()]


def test_damaged_files_give_an_error_row():
    tile = [(322, 3, [16]), (323, 3, [16])]
    bad = [
        by_hand(page(16, 16, 1, *tile, (324, 4, [8])), b"x" * 256),  # tiles without lengths
        by_hand(page(16, 16, 1, (324, 4, [8]), (325, 4, [256])), b"x" * 256),  # tiles without a size
        by_hand(page(1 << 31, 1 << 31, 8, (273, 4, [8]), (279, 4, [9])), zlib.compress(b"x")),
        by_hand(page(60_000, 60_000, 8, (273, 4, [8]), (279, 4, [9])), zlib.compress(b"x")),
        by_hand(page(4, 2, 1), b"x" * 8),  # no strips
        by_hand(page(4, 2, 1, (273, 4, [8]), (278, 4, [0]), (279, 4, [8])), b"x" * 8),
        by_hand(page(4, 2, 1, (273, 4, [8]), (278, 4, [1]), (279, 4, [4])), b"x" * 8),  # one strip for two rows
        by_hand(page(4, 2, 1, (273, 4, []), (279, 4, [8])), b"x" * 8),
        by_hand(page(4, 2, 1, (273, 4, [8]), (279, 4, [900])), b"x" * 8),
        by_hand(page(4, 2, 77, (273, 4, [8]), (279, 4, [8])), b"x" * 8),
        by_hand([], b""),
    ]
    rng = random.Random(7)
    whole = tiff.encode([np.full((40, 64), 7, np.uint8)] * 2, tiff.LZW)
    for _ in range(300):
        cut = bytearray(whole)
        for _ in range(rng.randint(1, 6)):
            cut[rng.randrange(len(cut))] = rng.randrange(256)
        list(tiff.read_pages(bytes(cut[: rng.randint(0, len(cut))])))
    for data in bad:
        got = list(tiff.read_pages(data))
        assert len(got) == 1 and got[0][0] is None and got[0][-1], data


def test_feature_by_hand():
    rng = random.Random(3)
    for n in (1, 64, 1000):
        values = [rng.choice([0, 17, 17, 200, rng.randrange(256)]) for _ in range(n)]
        mean = sum(values) / n
        spread = math.sqrt(sum((v - mean) ** 2 for v in values) / n)
        share = [values.count(v) / n for v in set(values)]
        entropy = -sum(p * math.log2(p) for p in share)
        bins = ",".join(str(sum(v // 16 == b for v in values)) for b in range(16))
        size, a, b, c, d = tiff.feature(np.array(values, np.uint8)).split(":")
        assert (int(size), d) == (n, bins) and np.allclose([float(a), float(b), float(c)], [mean, spread, abs(entropy)], atol=1e-4)


def test_stored_texts(spark, docs):
    more = spark.createDataFrame([(1000 + i, f"text number {i} " * (i % 40), "m") for i in range(80)] + [(5000, "long " * 60_000, "m")], docs.schema)
    both = docs.union(more)
    texts = {r.doc_id: r.text for r in both.collect()}
    got = tiff.stored_texts(both).collect()
    assert {r.compression for r in got} == {tiff.RAW, tiff.LZW, tiff.PACKBITS, tiff.DEFLATE}
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        want = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))
        media = tiff.encode(tiff.pages_for(want), *tiff.layout_of(want))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        assert r.feature == "|".join(tiff.feature(np.frombuffer(want[i : i + 64 * 4096], np.uint8)) for i in range(0, len(want), 64 * 4096))


def test_ranges_hold_their_keys(spark):
    from tallystone.llm import common

    points = [-5, 0, 3, 100, 1 << 62]
    df = spark.createDataFrame([(k,) for k in (-9, -5, -1, 0, 2, 3, 99, 100, 1 << 62, None)], "k long")
    got = [r.r for r in df.select(common.range_of("k", points).alias("r")).collect()]
    assert got == [0, 1, 1, 2, 2, 3, 3, 4, 5, 0]
    assert df.select(common.range_of("k", []).alias("r")).distinct().count() == 1
    many = common.split_points(spark.range(10_000), "id", 300)
    sizes = [r["count"] for r in spark.range(10_000).groupBy(common.range_of("id", many)).count().collect()]
    assert len(sizes) > 250 and max(sizes) < 80
