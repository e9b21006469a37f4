"""Language-model scoring by a log-bilinear model trained with noise-contrastive estimation.

Counts of every training word come from one grouped aggregation over all whole texts. The
HEAD most frequent words, the end and TAILS groups of the other words (by a hash of their
last bytes) are the model's classes. The class after two classes of context is
predicted by score(w | h) = (R[h1] C1 + R[h2] C2) . Q[w] + b[w]; a word of a tail group
then takes its smoothed share of the group's count, so that probabilities add up to 1.

Training: every place of every training text is visited once. Each task trains a copy on
its own texts in numpy, a minibatch of places at a time against shared noise words; the
copies' rows are averaged by how often they were touched, in a grouped aggregation. This is
done in ROUNDS rounds: the first takes every ROUNDS-th place of a text, each of the others
the next ones, from the averages that the round before has left.

Scoring: for two words of context the normaliser of all pairs of contexts is one matrix
product, Z = exp(R C1 Q' + b) exp(R C2 Q')', so each token's normalised log-probability
is a look-up in three matrices.

Defined results: a null text counts as empty and has the end token only; repeated rows are
scored one by one and count as often in training; without training rows the probabilities
are those of the smoothing; an empty table gives no rows. Very long texts count whole; other
columns don't matter. Of words with equal counts the first in byte order is a head word.
Counts and base scores are exact whatever the layout; the trained score depends on which
rows share a task, as stochastic gradients do.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystone.llm.common import written

END = b""  # the end token; no word is empty
HEAD = 2047
TAILS = 512
TAIL_BYTES = 3
WIDTH = 32
BATCH = 1024
NOISE = 64
LOCAL = 200_000  # most frequent words, whose counts every task knows; those of the others are joined
SLICE = 1 << 23  # bytes of text worked on at once, or one text
ROUNDS = 2
RATE = 0.05
ADD = 0.1
HELD_OUT = 10
#: bytes as words have them: A-Z lower-cased, white space as a blank
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD[9:14] = 32


def held_out(key: int | None) -> bool:
    return zlib.crc32(("" if key is None else str(key)).encode()) % HELD_OUT == 0


def tokenised(texts: pa.Array) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray]]:
    """Slices of the texts: place of the first, its distinct words, each token's place among them, and how many each text has."""
    texts = texts.cast(pa.string()).fill_null("")
    upto = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw, first = np.frombuffer(texts.buffers()[2] or b"", np.uint8), 0
    while first < len(texts):
        stop = max(first + 1, int(np.searchsorted(upto, upto[first] + SLICE, "right")) - 1)
        n, own = stop - first, (upto[first : stop + 1] - upto[first]).astype(np.int32)
        rows = pc.split_pattern(pa.StringArray.from_buffers(n, pa.py_buffer(own), pa.py_buffer(FOLD[raw[upto[first] : upto[stop]]])), " ")
        coded = rows.flatten().dictionary_encode()
        words, tokens = coded.dictionary, coded.indices.to_numpy()
        some = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
        at = np.concatenate([[0], np.cumsum(some[tokens])])[rows.offsets.to_numpy()]
        yield first, words, tokens[some[tokens]], np.diff(at)
        first = stop


def tail_of(word: bytes) -> int:
    return zlib.crc32(word[-TAIL_BYTES:]) % TAILS


def training_counts(df: DataFrame) -> DataFrame:
    """word, n over the training rows of (doc_id, text); the end token is the empty word."""

    def run(batches):
        for batch in batches:
            own = pa.array([not held_out(k) for k in batch.column(0).to_pylist()], pa.bool_())
            for _, words, tokens, sizes in tokenised(batch.column(1).filter(own)):
                n = np.bincount(tokens, minlength=len(words))
                seen = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array([""]), words.take(pa.array(seen))]), pa.array(np.concatenate([[len(sizes)], n[seen]]))], ["word", "n"])

    return df.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 0")


class _Tails(dict):
    """Class by a word's last bytes, remembered within a bound."""

    def __init__(self, first: int) -> None:
        self.first = first

    def __missing__(self, last: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[last] = found = self.first + tail_of(last)
        return found

    def __reduce__(self):
        return _Tails, (self.first,)


class _Ids(dict):
    """Class by word: that of a head word, else that of its last bytes."""

    def __init__(self, head: dict, tails: _Tails) -> None:
        super().__init__(head)
        self.tails = tails

    def __missing__(self, word: bytes) -> int:
        return self.tails[word[-TAIL_BYTES:]]

    def __reduce__(self):
        return _Ids, (dict(self), self.tails)


class Classes:
    """The model's classes: head words, the end, tail groups; sizes of all by training counts."""

    def __init__(self, head: list[tuple[str, int]], tails: dict[int, tuple[int, int]], ends: int) -> None:
        self.end = len(head)
        self.first_tail = self.end + 1
        self.ids = _Ids({w.encode(): i for i, (w, _) in enumerate(head)}, _Tails(self.first_tail))
        self.size = self.first_tail + TAILS
        self.start = self.size  # a context only
        self.counts = np.array([n for _, n in head] + [ends] + [tails.get(k, (0, 0))[0] for k in range(TAILS)], np.float64)
        kinds = np.array([1] * (len(head) + 1) + [tails.get(k, (0, 0))[1] + 1 for k in range(TAILS)])  # one more: a word never seen
        self.mass = self.counts + ADD * kinds
        self.share = self.mass / self.mass.sum()

    def classify(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.ids.__getitem__, words), np.int32, len(words))

    def sequence(self, words: pa.Array, tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of texts laid end to end, each with its end: class, the one before, the one before that, each token's word (-1 the end), and where texts start."""
        ends = np.cumsum(sizes + 1) - 1
        starts = ends - sizes
        word = np.full(len(tokens) + len(sizes), -1, np.int32)
        inner = np.ones(len(word), bool)
        inner[ends] = False
        word[inner] = tokens
        w = np.append(self.classify(words.cast(pa.binary()).to_pylist()), np.int32(self.end))[word]
        h1 = np.roll(w, 1)
        h1[starts] = self.start
        h2 = np.roll(h1, 1)
        h2[starts] = self.start
        return w, h1, h2, word, starts


class Parameters:
    """R (contexts), Q (predicted classes), C1, C2 and b, as one matrix of rows."""

    def __init__(self, classes: Classes, rows: dict[int, list[float]] | None = None) -> None:
        n, d = classes.size, WIDTH
        rng = np.random.default_rng(17)
        # predicted rows start at zero: the untrained model is the smoothed unigram model
        self.rows = np.zeros((2 * n + 1 + 2 * d, d + 1), np.float32)
        self.rows[: n + 1] = rng.normal(0, 0.3, (n + 1, d + 1))
        self.rows[n + 1 + n :, :d] = np.concatenate([np.eye(d), np.eye(d) * 0.5])
        self.rows[:, d] = 0
        self.rows[n + 1 : n + 1 + n, d] = np.log(classes.share)
        for k, row in (rows or {}).items():
            self.rows[k] = row
        self.r, self.q, self.c1, self.c2 = self.rows[: n + 1, :d], self.rows[n + 1 : 2 * n + 1, :d], self.rows[2 * n + 1 : 2 * n + 1 + d, :d], self.rows[2 * n + 1 + d :, :d]
        self.b = self.rows[n + 1 : 2 * n + 1, d]


def _summed(at: np.ndarray, what: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and the sums of `what` by them, as differences of running sums."""
    order = np.argsort(at, kind="stable")
    rows = at[order]
    last = np.append(np.flatnonzero(rows[1:] != rows[:-1]), len(rows) - 1)
    upto = np.cumsum(what[order], axis=0)[last]
    upto[1:] -= upto[:-1].copy()
    return rows[last].astype(np.int64), upto


class Trainer:
    """Noise-contrastive estimation over minibatches of (previous, the one before it, word)."""

    def __init__(self, classes: Classes, start: Parameters, seed: int) -> None:
        self.p, self.rng, self.classes = start, np.random.default_rng(seed), classes
        self.cum = np.cumsum(classes.share)
        self.log_noise = np.log(NOISE * classes.share).astype(np.float32)
        self.squares = np.full(start.rows.shape[0], 1e-2, np.float32)
        self.touched = np.zeros(start.rows.shape[0], np.int64)
        self.n, self.held = classes.size, []
        self.small = np.int16 if classes.size < 1 << 15 else np.int64  # sorts faster
        self.waiting = 0

    def add(self, h1: np.ndarray, h2: np.ndarray, w: np.ndarray) -> None:
        self.held.append(np.stack([h1, h2, w]))
        self.waiting += len(w)
        if self.waiting >= 1 << 16:
            self.flush()

    def flush(self) -> None:
        if not self.held:
            return
        places = np.concatenate(self.held, axis=1)
        places = places[:, self.rng.permutation(places.shape[1])]
        for i in range(0, places.shape[1], BATCH):
            self.step(*places[:, i : i + BATCH])
        self.held, self.waiting = [], 0

    def step(self, h1: np.ndarray, h2: np.ndarray, w: np.ndarray) -> None:
        p, n, d = self.p, self.n, WIDTH
        noise = np.minimum(np.searchsorted(self.cum, self.rng.random(NOISE)), n - 1)
        r1, r2 = p.r[h1], p.r[h2]
        # the last column of a predicted row is its bias
        pred = np.ones((len(w), d + 1), np.float32)
        np.add(r1 @ p.c1, r2 @ p.c2, out=pred[:, :d])
        qw, qn = p.rows[n + 1 + w], p.rows[n + 1 + noise]
        true = np.einsum("ij,ij->i", pred, qw) - self.log_noise[w]
        false = pred @ qn.T - self.log_noise[noise]
        err_t = 0.5 - 0.5 * np.tanh(0.5 * true)  # up
        err_f = -0.5 - 0.5 * np.tanh(0.5 * false)  # down
        g_pred = err_t[:, None] * qw[:, :d] + err_f @ qn[:, :d]
        rows_q, sum_q = _summed(np.concatenate([w, noise]).astype(self.small), np.concatenate([err_t[:, None] * pred, err_f.T @ pred]))
        rows_r, sum_r = _summed(np.concatenate([h1, h2]).astype(self.small), np.concatenate([g_pred @ p.c1.T, g_pred @ p.c2.T]))
        rows_c, sum_c = np.arange(2 * n + 1, 2 * n + 1 + 2 * d), np.concatenate([r1.T @ g_pred, r2.T @ g_pred])
        for rows, total in ((rows_q + n + 1, sum_q), (rows_r, sum_r), (rows_c, sum_c / 64)):
            self.squares[rows] += np.einsum("ij,ij->i", total, total) / (d + 1)
            p.rows[rows, : total.shape[1]] += (RATE / np.sqrt(self.squares[rows]))[:, None] * total
            self.touched[rows] += 1


def _trained(df: DataFrame, classes: Classes, rows: dict[int, list[float]] | None, turn: int) -> dict[int, list[float]]:
    """Averaged rows after a round of every task over its training rows of (doc_id, text): places turn, turn + ROUNDS, ... of each."""

    def run(batches):
        trainer = None
        for batch in batches:
            own = pa.array([not held_out(k) for k in batch.column(0).to_pylist()], pa.bool_())
            for _, words, tokens, sizes in tokenised(batch.column(1).filter(own)):
                if trainer is None:
                    from pyspark import TaskContext

                    trainer = Trainer(classes, Parameters(classes, rows), TaskContext.get().partitionId() * ROUNDS + turn)
                w, h1, h2, _, starts = classes.sequence(words, tokens, sizes)
                mine = (np.arange(len(w)) - np.repeat(starts, sizes + 1)) % ROUNDS == turn
                trainer.add(h1[mine], h2[mine], w[mine])
        if trainer is not None:
            trainer.flush()
            at = np.flatnonzero(trainer.touched)
            for i in range(0, len(at), 2000):
                part = at[i : i + 2000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(trainer.touched[part]), pa.array(trainer.p.rows[part].astype(np.float32).tolist(), pa.list_(pa.float32()))], ["row", "weight", "values"])

    one = df.mapInArrow(run, "row int, weight long, values array<float>")
    means = [(F.sum(F.col("values")[i] * F.col("weight")) / F.sum("weight")).cast("float") for i in range(WIDTH + 1)]
    return {r[0]: list(r[1]) for r in one.groupBy("row").agg(F.array(*means).alias("values")).collect()}  # one row for each of the model's


class Scorer:
    """Normalised log-probabilities (natural) of classes after two classes."""

    def __init__(self, classes: Classes, rows: dict[int, list[float]]) -> None:
        p = Parameters(classes, rows)
        one, two = p.r @ p.c1 @ p.q.T + p.b, p.r @ p.c2 @ p.q.T
        top1, top2 = one.max(1, keepdims=True), two.max(1, keepdims=True)
        z = np.exp(one - top1) @ np.exp(two - top2).T
        self.one, self.two = one, two
        self.log_z = (np.log(np.maximum(z, 1e-37)) + top1 + top2.T).astype(np.float32)
        self.start, self.end = classes.start, classes.end

    def score(self, w: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Of each class after the two."""
        return self.one[h1, w].astype(np.float64) + self.two[h2, w] - self.log_z[h1, h2]


_READY: dict[str, Scorer] = {}


def scored_words(df: DataFrame, classes: Classes, rows: dict[int, list[float]], local: dict[bytes, int], tag: str) -> DataFrame:
    """A row per text with what classes and local words give, and one per other word of it with its count."""

    def run(batches):
        from pyspark import TaskContext

        if tag not in _READY:
            _READY.clear()
            _READY[tag] = Scorer(classes, rows)
        scorer, made = _READY[tag], TaskContext.get().partitionId() << 40
        log_mass = np.log(classes.mass)
        end_log, end_known = np.log10(classes.counts[classes.end] + ADD), int(classes.counts[classes.end] > 0)
        for batch in batches:
            keys = batch.column(0)
            for first, words, tokens, sizes in tokenised(batch.column(1)):
                w, h1, h2, word, starts = classes.sequence(words, tokens, sizes)
                n = np.append(np.fromiter((local.get(x, -1) for x in words.cast(pa.binary()).to_pylist()), np.float64, len(words)), 0.0)
                here = n[word] >= 0  # of the end, too
                gain = np.append(np.where(n[:-1] >= 0, np.log10(np.maximum(n[:-1], 0) + ADD), 0.0), end_log)[word]
                tail = w >= classes.first_tail
                score = scorer.score(w, h1, h2) - np.where(tail, log_mass[w], 0.0)
                score = score / np.log(10) + np.where(tail, gain, 0.0)
                known = np.add.reduceat((here & (word >= 0)).astype(np.int64), starts) + end_known
                rid = made + np.arange(1, len(sizes) + 1)
                made += len(sizes)
                doc = pa.StructArray.from_arrays([keys.slice(first, len(sizes)).cast(pa.int64()), pa.array(sizes + 1), pa.array(known), pa.array(np.add.reduceat(gain, starts)), pa.array(np.add.reduceat(score, starts))], fields=list(DOC))
                # words that aren't known here, each once a text
                far = np.flatnonzero(~here)
                pairs, times = np.unique(np.repeat(np.arange(len(sizes)), sizes + 1)[far] * len(words) + word[far], return_counts=True)
                # a text's own row has a word that no text has, so that such rows are spread
                own = pa.array([f" {r}" for r in rid.tolist()], pa.string())
                other = words.take(pa.array(pairs % max(1, len(words))))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([rid, rid[pairs // max(1, len(words))]])), pa.concat_arrays([own, other]), pa.array(np.concatenate([np.zeros(len(sizes), np.int64), times])), pa.concat_arrays([doc, pa.nulls(len(pairs), DOC)])], ["rid", "word", "times", "doc"])

    return df.mapInArrow(run, SCORED)


SCORED = "rid long, word string, times long, doc struct<doc_id:long,n_tokens:long,n_known:long,base:double,score:double>"
DOC = pa.struct([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])


def model_of(texts: DataFrame, counts: DataFrame) -> tuple[Classes, dict[int, list[float]], dict[bytes, int], int, int]:
    """Classes, trained rows, counts of local words, training tokens and distinct tokens."""
    words = counts.where(F.col("word") != "")
    head = [tuple(r) for r in words.orderBy(F.desc("n"), "word").limit(HEAD).collect()]
    # the lowest count from which on there are no more than LOCAL words, out of counts of words by eighths of doublings
    level = F.floor(F.log2("n") * 8)
    most, cut = 0, 1 << 62
    for k, n in sorted(words.groupBy(level.alias("k")).count().collect(), reverse=True):  # 8 rows for each binary digit of a count
        most += n
        if most > LOCAL:
            break
        cut = k
    local = {w.encode(): n for w, n in words.where(level >= cut).collect()} | {w.encode(): n for w, n in head}  # LOCAL words, and HEAD
    group = F.pmod(F.crc32(F.substring(F.col("word").cast("binary"), -TAIL_BYTES, TAIL_BYTES)), F.lit(TAILS))
    sums = counts.where(F.col("word") != "").groupBy(group.cast("int").alias("k")).agg(F.sum("n"), F.count("*"))
    tails = {r[0]: [r[1], r[2]] for r in sums.collect()}
    for w, n in head:
        tails[tail_of(w.encode())][0] -= n
        tails[tail_of(w.encode())][1] -= 1
    tokens, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).head()
    ends = counts.where(F.col("word") == "").agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    classes = Classes(head, {k: tuple(v) for k, v in tails.items()}, ends)
    rows: dict[int, list[float]] = {}
    for turn in range(ROUNDS if tokens else 0):
        rows = {**rows, **_trained(texts, classes, rows, turn)}
    return classes, rows, local, tokens, kinds


def scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    import uuid

    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    counts = written(training_counts(texts), "word-counts")
    classes, rows, local, tokens, kinds = model_of(texts, counts)
    parts = scored_words(texts, classes, rows, local, uuid.uuid4().hex)
    found = parts.join(counts.where(F.col("word") != "").hint("merge"), "word", "left")
    gain = F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + ADD)
    summed = found.groupBy("rid").agg(F.max("doc.doc_id").alias("doc_id"), F.max("doc.n_tokens").alias("n_tokens"), (F.max("doc.n_known") + F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0))).alias("n_known"), F.sum(gain).alias("gain"), F.max("doc.base").alias("base"), F.max("doc.score").alias("score"))
    floor = float(np.log10(tokens + ADD * (kinds + 1)))
    is_held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(HELD_OUT)) == 0
    # the doc row's own gain is 0 times a logarithm
    return summed.select("doc_id", is_held.alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), (F.col("base") + F.col("gain") - F.col("n_tokens") * floor).alias("base_score"), (F.col("score") + F.col("gain")).alias("score"))
