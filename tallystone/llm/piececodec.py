"""Offset-preserving SentencePiece encoding, and decoding.

A text is normalised here, not in the library: the compiled character map of the model (a
double-array trie) is walked for the longest prefix at each place, and every normalised
byte records the source byte it stems from. The normalised text is cut into pieces, and
each piece is projected through that alignment to a span of the original bytes.

Pieces never reach across the seam between a word and the white space after it (checked
against the vocabulary when a model is loaded), so chunks between seams are segmented once
and remembered within a bound; the segmenter gets them already normalised.

Defined results: a null text counts as empty; an empty text has only the begin and end ids
and decodes to the empty text; texts of any length are taken whole; repeated rows repeat.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallystone.llm.chunks import ChunkMemory

MARK = "▁"
MARK_BYTES = MARK.encode()


class CharMap:
    """A compiled character map: a double-array trie over UTF-8 bytes and a pool of replacements."""

    def __init__(self, blob: bytes) -> None:
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.pool = blob[4 + size :]

    def longest(self, raw: bytes, at: int) -> tuple[bytes, int] | None:
        """Replacement and length of the longest mapped prefix of raw[at:]."""
        units, found = self.units, None
        unit = units[0]
        node = (unit >> 10) << ((unit & 512) >> 6)
        for i in range(at, len(raw)):
            node ^= raw[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != raw[i]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit & 256:
                found = (units[node] & 0x7FFFFFFF, i + 1 - at)
        if found is None:
            return None
        start = found[0]
        return self.pool[start : self.pool.index(b"\0", start)], found[1]


class Normalizer:
    """Text to (normalised bytes, source byte of each of them and of the end)."""

    def __init__(self, charsmap: bytes = b"", dummy_prefix: bool = True, trim: bool = False) -> None:
        self.map = CharMap(charsmap) if charsmap else None
        self.dummy, self.trim = dummy_prefix, trim

    def __call__(self, text: str) -> tuple[bytes, np.ndarray]:
        raw = text.encode()
        if self.map is None and not self.trim:
            return self._plain(raw)
        units = self._units(raw)
        if self.trim:
            units = self._trimmed(units)
        out, at = bytearray(), []
        if units and self.dummy:
            out += MARK_BYTES
            at += [units[0][1]] * 3
        for piece, start, _ in units:
            piece = piece.replace(b" ", MARK_BYTES)
            out += piece
            at += [start] * len(piece)
        at.append(units[-1][2] if units else len(raw))
        return bytes(out), np.array(at, np.int64)

    def _plain(self, raw: bytes) -> tuple[bytes, np.ndarray]:
        """No map: only spaces change, each to the three bytes of the mark."""
        if not raw:
            return b"", np.zeros(1, np.int64)
        head = MARK_BYTES if self.dummy else b""
        wide = np.where(np.frombuffer(raw, np.uint8) == 32, 3, 1)
        at = np.repeat(np.arange(len(raw)), wide)
        return head + raw.replace(b" ", MARK_BYTES), np.concatenate([np.zeros(len(head), np.int64), at, [len(raw)]])

    def _units(self, raw: bytes) -> list[tuple[bytes, int, int]]:
        units, i = [], 0
        while i < len(raw):
            hit = self.map.longest(raw, i) if self.map else None
            if hit is None:
                lead = raw[i]
                n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                hit = (raw[i : i + n], n)
            units.append((hit[0], i, i + hit[1]))
            i += hit[1]
        return units

    @staticmethod
    def _trimmed(units: list[tuple[bytes, int, int]]) -> list[tuple[bytes, int, int]]:
        """Without spaces at the ends, and with one space for each run of them."""
        out, spaced = [], True
        for piece, start, end in units:
            if spaced:
                piece = piece.lstrip(b" ")
            if not piece:
                continue
            # inside a replacement a run of spaces shrinks as well
            piece = re.sub(b" +", b" ", piece)
            out.append((piece, start, end))
            spaced = piece.endswith(b" ")
        while out and out[-1][0].endswith(b" "):
            piece, start, end = out.pop()
            if piece := piece.rstrip(b" "):
                out.append((piece, start, end))
        return out


class PieceCodec:
    """Encoder and decoder of one model file, or of a serialised model."""

    def __init__(self, path: str = "", proto: bytes = b"") -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        if not proto:
            with open(path, "rb") as f:
                proto = f.read()
        model = pb.ModelProto.FromString(proto)
        spec = model.normalizer_spec
        self.normalize = Normalizer(spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces)
        self.strip_first = spec.add_dummy_prefix or spec.remove_extra_whitespaces
        spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces = b"", False, False
        self.segmenter = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.bos, self.eos, self.unk = self.segmenter.bos_id(), self.segmenter.eos_id(), self.segmenter.unk_id()
        self.surface, size = [], []
        for p in model.pieces:
            if p.type == pb.ModelProto.SentencePiece.BYTE:
                self.surface.append(bytes((int(p.piece[3:5], 16),)))
                size.append(1)
            elif p.type == pb.ModelProto.SentencePiece.CONTROL:
                self.surface.append(b"")
                size.append(0)
            elif p.type == pb.ModelProto.SentencePiece.UNKNOWN:
                self.surface.append(model.trainer_spec.unk_surface.encode())
                size.append(0)
            else:
                self.surface.append(p.piece.replace(MARK, " ").encode())
                size.append(len(p.piece.encode()))
        self.size = np.array(size, np.int64)
        self.marked = [x[:1] == b" " and n >= 3 for x, n in zip(self.surface, size, strict=True)]
        real = [p.piece for p in model.pieces if p.type not in (pb.ModelProto.SentencePiece.BYTE, pb.ModelProto.SentencePiece.CONTROL)]
        crossing = any(re.search(f"[^{MARK}]{MARK}", p) for p in real)
        lines = any("\n" in p for p in real)
        # a chunk: marks and what follows up to the next seam; a line break no piece holds is a seam on both sides
        self.seams = None if crossing else re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+" if lines else f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")
        self.unk_sizes: dict[str, list[int]] = {}
        self.memory = ChunkMemory(self._segment)

    def _segment(self, chunks: list[str]) -> list[bytes]:
        ids = self.segmenter.encode(chunks, out_type=int, num_threads=1)
        for chunk, got in zip(chunks, ids, strict=True):
            if self.unk in got:
                self.unk_sizes[chunk] = [1 if self.segmenter.is_byte(i) else len(p.encode()) for i, p in zip(got, self.segmenter.encode(chunk, out_type=str), strict=True)]
        return [np.array(i, "<u4").tobytes() for i in ids]

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids without begin and end, and where each piece begins and ends in the original bytes."""
        raw, source = self.normalize(text or "")
        norm = raw.decode()
        chunks = ([norm] if norm else []) if self.seams is None else self.seams.findall(norm)
        known = self.memory.learn(set(chunks))
        ids = np.frombuffer(b"".join([known[c] for c in chunks]), "<u4")
        if self.unk_sizes:
            table = self.size
            wide = np.array([n for c in chunks for n in self.unk_sizes.get(c) or table[np.frombuffer(known[c], "<u4")].tolist()], np.int64)
            self._forget_unknown()
        else:
            wide = self.size[ids]
        self.memory.forget()
        ends = np.cumsum(wide)
        if len(ids) and ends[-1] != len(raw):
            raise ValueError("the pieces don't cover the normalised text")
        return ids, source[ends - wide], source[ends]

    def _forget_unknown(self) -> None:
        """Chunks with unknown pieces are kept within a bound of their own."""
        if len(self.unk_sizes) > 10_000:
            self.unk_sizes.clear()
            self.memory = ChunkMemory(self._segment)

    def decode(self, ids) -> str:
        """The text of ids; bytes that aren't UTF-8 give U+FFFD, one each."""
        surface = self.surface
        parts = [surface[i] for i in (ids.tolist() if isinstance(ids, np.ndarray) else ids)]
        out = b"".join(parts)
        # the space that normalisation put first goes; a space spelt as a byte stays
        if self.strip_first and out[:1] == b" " and self.marked[next(i for i, x in zip(ids, parts, strict=True) if x)]:
            out = out[1:]
        try:
            return out.decode()
        except UnicodeDecodeError:
            return _lenient(out)


def _lenient(raw: bytes) -> str:
    out, i = [], 0
    while i < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[i : i + n].decode())
                i += n
                break
            except UnicodeDecodeError:
                pass
        else:
            out.append("�")
            i += 1
    return "".join(out)


_READY: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    if path not in _READY:
        _READY[path] = PieceCodec(path)
    return _READY[path]


def encode_texts(df: DataFrame, model_path: str, keep: list[str], text_col: str = "text", spans: bool = True) -> DataFrame:
    """Beside `keep`: n_tokens, ids with begin and end and, if asked for, the byte span of each (empty for those two)."""

    def run(batches):
        own = codec(model_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                cols = [[], [], []]
                for text in part.column(text_col):
                    value = text.as_py() or ""
                    ids, a, b = own.encode(value)
                    size = len(value.encode())
                    for column, x, first, last in zip(cols, (ids, a, b), (own.bos, 0, 0), (own.eos, size, size), strict=True):
                        column.append(np.concatenate([[first], x, [last]]))
                ends = np.cumsum([0, *(len(x) for x in cols[0])], dtype=np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(c).astype(kind))) for c, kind in zip(cols, (np.int32, np.int64, np.int64), strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(np.diff(ends).astype(np.int64)), *lists[: 3 if spans else 1]], [*keep, "n_tokens", "ids", "begins", "ends"][: len(keep) + (4 if spans else 2)])

    kept = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    more = ", begins array<long>, ends array<long>" if spans else ""
    return df.select(*dict.fromkeys([*keep, text_col])).mapInArrow(run, f"{kept}, n_tokens long, ids array<int>{more}")


CODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long, spans_crc32 long, covered boolean"


def coded_texts(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of each text's ids, of what they decode to and of the byte spans of its pieces.

    covered: the spans follow each other without a gap from the first byte to the last.
    """

    def run(batches):
        own = codec(model_path)
        for batch in batches:
            rows = [[] for _ in range(6)]
            for text in batch.column(1):
                value = text.as_py() or ""
                ids, begins, ends = own.encode(value)
                full = np.concatenate([[own.bos], ids, [own.eos]]).astype("<u4")
                size = len(value.encode())
                whole = not size if not len(ids) else begins[0] == 0 and ends[-1] == size and bool((begins[1:] == ends[:-1]).all())
                for column, x in zip(rows, (len(full), hashlib.sha256(full.tobytes()).hexdigest(), hashlib.sha256(own.decode(full).encode()).hexdigest(), size, zlib.crc32(np.stack([begins, ends], 1).astype("<i8").tobytes()), bool(whole)), strict=True):
                    column.append(x)
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(r, k) for r, k in zip(rows, kinds, strict=True))], [x.split()[0] for x in CODED.split(", ")])

    return df.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text_col}` text").mapInArrow(run, CODED)
