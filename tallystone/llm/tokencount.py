"""Token counts by a linear longest-match automaton.

A word-piece vocabulary becomes a trie whose nodes hold a failure link and the number of
pieces that following it pops. One pass over a word's characters then gives the length of
its greedy longest-match split without building a piece. A word that can't be split
counts as one unknown token.

Defined results: null and empty texts have no words and 0 tokens; repeated rows repeat;
words of any length are read in time linear in their length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tallystone.llm.chunks import ChunkMemory

JOINER = "##"


class Automaton:
    """Longest-match lengths over pieces; those with the joiner continue a word.

    Nodes below the root spell initial pieces, nodes below `inner` continuing ones. pops[n]
    counts the pieces popped when n has no way on, link[n] is where matching goes on then:
    the node of what remains, or None if the word can't be split.
    """

    def __init__(self, pieces: list[str], joiner: str = JOINER) -> None:
        self.step: list[dict[str, int]] = [{}, {}]
        whole = [False, False]
        for piece in pieces:
            inner = piece.startswith(joiner) and len(piece) > len(joiner)
            at = 1 if inner else 0
            for ch in piece[len(joiner) :] if inner else piece:
                down = self.step[at].get(ch)
                if down is None:
                    down = self.step[at][ch] = len(self.step)
                    self.step.append({})
                    whole.append(False)
                at = down
            whole[at] = at > 1
        self.link: list[int | None] = [None] * len(self.step)
        self.pops = [0] * len(self.step)
        level = [(0, c, n) for c, n in self.step[0].items()] + [(1, c, n) for c, n in self.step[1].items()]
        while level:  # breadth first: a node's link is shallower than the node
            below = []
            for parent, ch, node in level:
                below += [(node, c, n) for c, n in self.step[node].items()]
                if whole[node]:  # the piece itself is popped, nothing remains
                    self.link[node], self.pops[node] = 1, 1
                    continue
                at, popped = self.link[parent], self.pops[parent]
                while at is not None and ch not in self.step[at]:
                    popped += self.pops[at]
                    at = self.link[at]
                if at is not None:
                    self.link[node], self.pops[node] = self.step[at][ch], popped
            level = below

    def length(self, word: str) -> int:
        """Pieces of the word's greedy split; 0 if it has none or is empty."""
        step, link, pops, at, n = self.step, self.link, self.pops, 0, 0
        for ch in word:
            while (down := step[at].get(ch)) is None:
                n += pops[at]
                at = link[at]
                if at is None:
                    return 0
            at = down
        while at != 1:  # what is held must end in whole pieces
            if at is None or (at == 0):
                return 0
            n += pops[at]
            at = link[at]
        return n


def word_pieces(model_path: str, joiner: str = JOINER) -> list[str]:
    """A word-piece vocabulary out of a public piece model: marked pieces start a word, the others continue it."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    out = []
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        piece = model.id_to_piece(i)
        if piece.startswith("▁"):
            out += [piece[1:]] if len(piece) > 1 and "▁" not in piece[1:] else []
        else:
            out.append(joiner + piece)
    return out


_READY: dict[str, ChunkMemory] = {}


def _memory(path: str) -> ChunkMemory:
    if path not in _READY:
        auto = Automaton(word_pieces(path))
        _READY[path] = ChunkMemory(lambda words: [auto.length(w) or -1 for w in words])
    return _READY[path]


COUNTED = "doc_id long, n_words long, n_tokens long, n_unknown long"


def token_counts(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words (runs of anything but ASCII white space), word-piece tokens and unknown words of each text."""

    def run(batches):
        import pyarrow as pa

        memory = _memory(model_path)
        for batch in batches:
            cols = [[], [], []]
            for text in batch.column(1):
                words = (text.as_py() or "").encode().split()
                known = memory.learn({w.decode() for w in set(words)})
                counts = [known[w.decode()] for w in words]
                memory.forget()
                lost = counts.count(-1)
                cols[0].append(len(words))
                cols[1].append(sum(counts) + 2 * lost)
                cols[2].append(lost)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols)], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    return df.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text_col}` text").mapInArrow(run, COUNTED)
