"""Token-id output: fixed-width bit packing with block offsets.

A shard file holds, little-endian: a 32-byte head (magic, version, bits per id, ids per
block, ids, documents), the blocks, the document table (id, first id) and the block
offsets. Every id takes the fewest bits that the vocabulary needs, so that a block is
unpacked by numpy at once and any id is found without reading what precedes its block.

Shards follow the documents' order: shard k holds a range of ids, each shard is sorted. A
task writes under a name of its own and renames at the end, so a task that runs twice
leaves one whole file. Files go through pyarrow.fs to the shared folder, never to a local one.

Defined results: a null text counts as empty and has only the end id; null ids come first;
rows with equal ids keep an order by their contents; very long texts are encoded whole, a
slice of their own; other columns don't matter; an empty table gives no row.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystone.llm.chunks import ChunkMemory
from tallystone.llm.common import partitions, range_of, shared_uri, split_points, stated_bytes

MAGIC = b"TLYIDS01"
HEAD = struct.Struct("<8sHHIQQ")
BLOCK = 1 << 14  # ids in a block; a multiple of 8, so that blocks end on a byte
SHARD = 1 << 26  # bytes of texts, as the plan states them, that a shard holds about
NO_KEY = 1 << 62  # set in the first id of a document without a key


def width_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(spread.astype(np.uint8).reshape(-1), bitorder="little").tobytes()


def unpack(raw: bytes, bits: int, count: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", count).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(raw, np.uint8), count=count * bits, bitorder="little").reshape(count, bits)
    return (flat.astype(np.uint64) << np.arange(bits, dtype=np.uint64)).sum(1).astype(np.uint32)


def open_store(uri: str):
    """File system and path of a URI; a plain path is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


class Writer:
    """One shard file, written block by block."""

    def __init__(self, uri: str, vocabulary: int) -> None:
        self.uri, self.bits = uri, width_for(vocabulary)
        self.fs, self.path = open_store(uri)
        self.fs.create_dir(self.path.rpartition("/")[0])
        self.own = f"{self.path}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.own)
        # the head comes again, with its counts, at the end: a stream can't go back
        self.held: list[np.ndarray] = []
        self.n_held = self.n = 0
        self.docs: list[tuple[int, int]] = []
        self.at: list[int] = []
        self.place = 0

    def _put(self, raw: bytes) -> None:
        self.out.write(raw)
        self.place += len(raw)

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.docs.append((0, self.n | NO_KEY) if key is None else (key, self.n))
        self.held.append(ids)
        self.n += len(ids)
        self.n_held += len(ids)
        if self.n_held >= 8 * BLOCK:
            self._blocks(False)

    def _blocks(self, last: bool) -> None:
        flat = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        cut = len(flat) if last else len(flat) // BLOCK * BLOCK
        for i in range(0, cut, BLOCK):
            self.at.append(self.place)
            self._put(pack(flat[i : min(i + BLOCK, cut)], self.bits))
        self.held, self.n_held = [flat[cut:]], len(flat) - cut

    def close(self) -> tuple[int, int]:
        self._blocks(True)
        self._put(np.array(self.docs, "<i8").reshape(-1, 2).tobytes() + np.array([*self.at, self.place], "<u8").tobytes())
        self._put(HEAD.pack(MAGIC, 1, self.bits, BLOCK, self.n, len(self.docs)))
        self.out.close()
        self.fs.move(self.own, self.path)
        return len(self.docs), self.n


class Reader:
    """Random access to a shard file."""

    def __init__(self, uri: str) -> None:
        fs, path = open_store(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        magic, version, self.bits, self.block, self.n, docs = HEAD.unpack(self._get(size - HEAD.size, HEAD.size))
        if magic != MAGIC or version != 1:
            raise ValueError(f"{uri} is no id shard")
        blocks = -(-self.n // self.block)
        tail = size - HEAD.size - 8 * (blocks + 1) - 16 * docs
        self.docs = np.frombuffer(self._get(tail, 16 * docs), "<i8").reshape(-1, 2)
        self.at = np.frombuffer(self._get(tail + 16 * docs, 8 * (blocks + 1)), "<u8")
        self.now = (-1, None)

    def _get(self, at: int, n: int) -> bytes:
        self.file.seek(int(at))
        return self.file.read(int(n))

    def _block(self, k: int) -> np.ndarray:
        if self.now[0] != k:
            self.now = (k, unpack(self._get(self.at[k], self.at[k + 1] - self.at[k]), self.bits, min(self.block, self.n - k * self.block)))
        return self.now[1]

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop, from the blocks that hold them."""
        got = [self._block(k)[max(0, start - k * self.block) : stop - k * self.block] for k in range(start // self.block, -(-stop // self.block))]
        return np.concatenate(got) if got else np.zeros(0, np.uint32)

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Id, first id's place and ids of each document, in order."""
        starts = self.docs[:, 1] & ~NO_KEY
        for (key, mark), start, stop in zip(self.docs.tolist(), starts.tolist(), [*starts[1:].tolist(), self.n], strict=True):
            yield None if mark & NO_KEY else key, start, self.ids(start, stop)


#: fixed values: the normaliser and the pre-tokenizer that chunks between blanks rely on
NORMAL = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
#: what a byte is to a chunk: blank, ASCII letter, mark, part of another letter, or more than that
BLANK, LETTER, MARK, HIGH, ODD = range(5)
KINDS = np.full(256, ODD, np.uint8)
KINDS[[9, 10, 13, 32]] = BLANK
KINDS[[*range(65, 91), *range(97, 123)]] = LETTER
#: marks: ASCII punctuation, but for the apostrophe and "<", with which special cases start
KINDS[[c for c in [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)] if chr(c) not in "'<"]] = MARK
#: two bytes of U+00C0 to U+024F, Latin letters that don't combine with one another
KINDS[0x80:0xC0] = HIGH
KINDS[0xC3:0xCA] = HIGH
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
TOGETHER = 256  # words encoded as one text
SLICE = 1 << 23  # bytes of text worked on at once, or one text


def pieces_of(raw: np.ndarray, rows: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """What the texts between `rows` consist of, in order, and which pieces each has.

    A chunk between blanks is a piece as it is; but one of Latin letters and marks after
    them is two, the word (A-Z lower-cased) and its marks: the tokenizer looks at them
    apart, and normalisation gives the word's lower case.
    """
    kind = KINDS[raw]
    before = np.concatenate([[BLANK], kind[:-1]]).astype(np.uint8)[: len(kind)]
    before[rows[:-1][rows[:-1] < len(kind)]] = BLANK
    kept = kind != BLANK
    starts = kept & (before == BLANK)
    chunk = np.cumsum(starts, dtype=np.int32)
    odd = (kind == ODD) | ((before == MARK) & ((kind == LETTER) | (kind == HIGH)))
    lead = np.flatnonzero((raw >= 0xC3) & (raw < 0xCA))
    after = raw[lead + 1]  # texts are whole UTF-8
    # not letters: the signs of multiplication and division; not of one lower case: I with a dot; letters past U+024F
    odd[lead[((raw[lead] == 0xC3) & ((after == 0x97) | (after == 0xB7))) | ((raw[lead] == 0xC4) & (after == 0xB0)) | ((raw[lead] == 0xC9) & (after > 0x8F))]] = True
    whole = np.zeros(int(chunk[-1]) + 1 if len(chunk) else 1, bool)
    whole[chunk[odd & kept]] = True
    whole = whole[chunk] & kept if len(chunk) else kept
    starts |= (kind == MARK) & ((before == LETTER) | (before == HIGH)) & ~whole
    text = LOWER[raw]
    text[whole] = raw[whole]
    place = np.concatenate([[0], np.cumsum(kept, dtype=np.int32)]).astype(np.int32)
    bounds = np.append(place[np.flatnonzero(starts)], place[-1]).astype(np.int32)
    counted = np.concatenate([[0], np.cumsum(starts, dtype=np.int32)])
    return pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(text[kept])), counted[rows].astype(np.int64)


#: a word in the sense of pieces_of
LATIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+")


def letters_of_bytes() -> str:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = [b for b in range(256) if b not in shown]
    return "".join(chr(b if b in shown else 256 + other.index(b)) for b in range(256))


class TextEncoder:
    """Ids, packed by `code`, of texts: what the library's encode gives.

    The tokenizer drops white space before it looks at words, so texts are cut into pieces,
    each distinct one is encoded once and remembered within a bound. Words of Latin letters
    go straight to the library's byte-pair model, many at a time: each ends where a token
    with the model's word end stands. Should a text not give as many ends as it has words,
    and for all other pieces, the whole tokenizer is asked. So it is for whole texts if its
    normaliser and pre-tokenizer aren't the ones that this holds for.
    """

    def __init__(self, path: str, code: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole, self.code = Tokenizer.from_file(path), code
        self.kind, self.size = np.dtype(code).newbyteorder("<"), array(code).itemsize
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.cut = spec.get("normalizer") == NORMAL and spec.get("pre_tokenizer") == SPLIT and not any(" " in t["content"] for t in spec.get("added_tokens", []))
        self.words = Tokenizer(self.whole.model)
        self.words.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
        self.letters = {b: c for b, c in enumerate(letters_of_bytes()) if b != 32}
        vocabulary = self.whole.get_vocab()
        mark = getattr(self.whole.model, "end_of_word_suffix", None)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if mark and w.endswith(mark)]] = True
        self.memory = ChunkMemory(self._made)

    def _each(self, chunks: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.whole.encode_batch_fast(chunks, add_special_tokens=False)]

    def _of_words(self, words: list[str]) -> dict[str, bytes]:
        """Values of lower-case words of Latin letters."""
        found, other = {}, []
        groups = [words[i : i + TOGETHER] for i in range(0, len(words), TOGETHER)]
        lines = [" ".join(g) for g in groups]
        lines = [x if x.isascii() else x.encode().decode("latin-1").translate(self.letters) for x in lines]
        for group, e in zip(groups, self.words.encode_batch_fast(lines, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.int64)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(group) or stops[-1] != len(ids):
                other += group
                continue
            flat, at = ids.astype(self.kind).tobytes(), (stops * self.size).tolist()
            found.update((w, flat[a:b]) for w, a, b in zip(group, [0, *at[:-1]], at, strict=True))
        found.update(zip(other, self._each(other), strict=True))
        return found

    def _made(self, pieces: list[str]) -> list[bytes]:
        words = {c: c if c.isascii() else c.lower() for c in pieces if c.isalpha() and (c.isascii() or LATIN.fullmatch(c))}
        other = [c for c in pieces if c not in words]
        found = self._of_words(list(dict.fromkeys(words.values())))
        own = dict(zip(other, self._each(other), strict=True))
        return [found[words[c]] if c in words else own[c] for c in pieces]

    def _slice(self, texts: pa.Array, end: bytes) -> pa.Array:
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1]
        if self.cut:
            raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
            pieces, at = pieces_of(raw, (offsets - offsets[0]).astype(np.int64))
        else:
            pieces, at = texts, np.arange(n + 1)
        coded = pieces.dictionary_encode()
        chunks = coded.dictionary.to_pylist()
        values = [*(self.memory.values(chunks) if self.cut else self._each(chunks)), end]
        # a text's chunks, then the end, which is the last value
        stops = at[1:] + np.arange(n)
        order = np.full(at[-1] + n, len(chunks))
        inner = np.ones(len(order), bool)
        inner[stops] = False
        order[inner] = coded.indices.to_numpy()
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // self.size
        wide = sizes[order]
        upto = np.cumsum(wide)
        source = np.repeat((np.cumsum(sizes) - sizes)[order] - (upto - wide), wide) + np.arange(upto[-1])
        ids = np.frombuffer(b"".join(values), self.kind)[source]
        bounds = np.concatenate([[0], upto[stops] * self.size]).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(bounds), pa.py_buffer(ids)])

    def encode(self, texts: pa.Array, end: int) -> Iterator[tuple[int, pa.Array]]:
        """Place of the first text and packed ids of slices of the texts; nulls count as empty."""
        texts = texts.cast(pa.string()).fill_null("")
        upto = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        at, last = 0, array(self.code, [end]).tobytes()
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(upto, upto[at] + SLICE, "right")) - 1)
            yield at, self._slice(texts.slice(at, stop - at), last)
            at = stop


_READY: dict[tuple[str, str], TextEncoder] = {}


def encoder(path: str, code: str) -> TextEncoder:
    if (path, code) not in _READY:
        _READY[path, code] = TextEncoder(path, code)
    return _READY[path, code]


def encode_ids(df: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", vocabulary: int = 1 << 16) -> DataFrame:
    """key and ids (binary, 2 or 4 bytes each) of every text, the end id last."""
    code = "H" if vocabulary <= 1 << 16 else "I"

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        own = encoder(tokenizer_path, code)
        for batch in batches:
            for at, ids in own.encode(batch.column(1), end_id):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(ids)), ids], ["key", "ids"])

    return df.selectExpr(f"cast(`{id_col}` as long) key", f"`{text_col}` text").mapInArrow(run, "key long, ids binary")


def write_shards(encoded: DataFrame, keys: DataFrame, folder: str, vocabulary: int, shards: int) -> DataFrame:
    """Write encoded rows as shard files in ascending key order; one row per shard: shard, uri, docs, ids."""
    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"
    points = split_points(keys, "key", shards)

    def run(batches):
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        out = None
        for batch in batches:
            for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids"), strict=True):
                out = out or Writer(f"{folder}/shard-{shard:06d}.ids", vocabulary)
                out.add(key, np.frombuffer(ids.as_buffer(), kind).astype(np.uint32))
        if out:
            docs, n = out.close()
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([out.uri]), pa.array([docs], pa.int64()), pa.array([n], pa.int64())], ["shard", "uri", "docs", "ids"])

    placed = encoded.repartitionById(len(points) + 1, range_of("key", points).cast("int"))
    return placed.sortWithinPartitions("key", "ids").mapInArrow(run, "shard int, uri string, docs long, ids long")


def read_shards(spark, manifest: list[tuple[int, str, int, int]]) -> DataFrame:
    """Per document of the shards listed (shard, uri, docs, ids): doc_id, start, n_tokens, ids_crc32."""
    rows, before = [], 0
    for _, uri, _, n in sorted(manifest):
        rows.append((uri, before))
        before += n

    def run(batches):
        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held = []
                for key, start, ids in Reader(uri).documents():
                    held.append((key, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(held) == 20_000:
                        yield _documents(held)
                        held = []
                if held:
                    yield _documents(held)

    source = spark.createDataFrame(rows, "uri string, base long").repartition(max(1, len(rows)))
    return source.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _documents(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def packed_texts(df: DataFrame, tokenizer_path: str, end_id: int = 1, vocabulary: int = 49_408, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, write the shard files to the shared folder, and read every document back from them."""
    spark = df.sparkSession
    folder = shared_uri(spark, "token-ids")
    shards = max(partitions(spark), -(-stated_bytes(df) // SHARD))
    manifest = write_shards(encode_ids(df, tokenizer_path, end_id, id_col, text_col, vocabulary), df.selectExpr(f"cast(`{id_col}` as long) key"), folder, vocabulary, shards).collect()
    return read_shards(spark, [tuple(r) for r in manifest])
