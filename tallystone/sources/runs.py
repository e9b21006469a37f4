"""Runs: immutable Parquet pieces of the ledger behind a manifest.

A run holds the rows of a span of slots, a folder for each family (blocks, transactions,
postings, ...), each sorted by its own key, so that files, row groups and pages are skipped
by their statistics. The manifest lists runs in order, tiling the slots without a gap. Level
0 runs are flushed from the window; merging the oldest of them gives a terminal run, which
is never merged again. Only terminal runs are published.

Manifests are numbered and never changed. Who commits claims the next number by creating a
file that must not be there, so that of two writers that have read the same manifest one
fails. A reader holds the manifest that it has read (a snapshot): merged runs are deleted
when no snapshot of this process holds them. A writer that dies leaves folders that no
manifest names; `sweep` deletes them. A published folder has a pointer, written last, and
each run a footer, by which `join` walks back to the first.
"""

from __future__ import annotations

import json
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import asdict, dataclass, replace
from functools import reduce
from operator import xor

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, DataFrameWriter, Observation, SparkSession
from pyspark.sql import functions as F

from tallystone.operators.scaling import holding_range

VERSION = 2
FLUSH_SLOTS, FLUSH_BLOCKS, TERMINAL_SLOTS = 500_000, 50_000, 8_000_000
ROWS = "rows"  # the family of a corpus that has one table
FILE_ROWS = 2_000_000
FAN_OUT = 32
#: the key that a family is sorted by; others go by slot
ORDER = {"blocks": ["height"], "txs": ["txnum"], "hashes": ["digest"], "postings": ["addr", "txnum"], "elog": ["emitter", "topic0", "txnum"], "tval": ["value", "topic0", "txnum"], "sig": ["topic0", "txnum"], "set": ["topic0", "value", "pos", "emitter"], "state": ["addr", "slot", "txnum"]}


class Conflict(RuntimeError):
    """Another writer has committed since the manifest was read."""


@dataclass(frozen=True)
class Run:
    """from_tx to to_tx (exclusive), from_height to to_height (inclusive); families: name, rows and bytes of each."""

    name: str
    level: int
    from_tx: int
    to_tx: int
    from_height: int
    to_height: int
    rows: int
    previous: str
    path: str = ""
    families: tuple[tuple[str, int, int], ...] = ()

    @classmethod
    def of(cls, kept: dict) -> Run:
        return cls(**(kept | {"families": tuple(tuple(f) for f in kept["families"])}))


def run_cuts(blocks: DataFrame, slots: int = FLUSH_SLOTS, most_blocks: int = FLUSH_BLOCKS, stretch: int = 1 << 20) -> DataFrame:
    """from_tx, to_tx, from_height, to_height of every full run from block 0 on.

    A run ends with the block that fills its slots or its blocks. Each stretch of heights
    says where the runs that enter it would leave it; they enter in its first `most_blocks`
    heights, so that what comes to the driver is a small part of the blocks. From the entry
    that is taken each stretch gives its runs.
    """
    width = max(stretch, 64 * most_blocks)
    own = blocks.select("height", "first_tx", "boundary_tx").withColumn("_part", F.floor(F.col("height") / width))
    ahead = own.where((F.col("_part") > 0) & (F.col("height") % width < most_blocks)).withColumn("_part", F.col("_part") - 1)
    dealt = own.unionByName(ahead).groupBy("_part")

    def edges(rows: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, int]:
        """The blocks in order, the place of the block that ends a run from each (or their number), and how many aren't of the next stretch."""
        rows = rows.sort_values("height", ignore_index=True)
        height = rows["height"].to_numpy()
        by_slots = np.searchsorted(rows["boundary_tx"].to_numpy(), rows["first_tx"].to_numpy() + (slots - 1))
        by_blocks = np.searchsorted(height, height + (most_blocks - 1))
        return rows, np.minimum(by_slots, by_blocks), int(np.searchsorted(height, (int(rows["_part"][0]) + 1) * width))

    def exits(rows: pd.DataFrame) -> pd.DataFrame:
        rows, edge, inside = edges(rows)
        height, n, over = rows["height"].tolist(), len(rows), (int(rows["_part"][0]) + 1) * width
        out, ends = [-1] * inside, edge.tolist()
        for i in range(inside - 1, -1, -1):
            e = ends[i]
            if e < n:
                after = height[e] + 1
                out[i] = after if after >= over else out[e + 1] if e + 1 < inside and height[e + 1] == after else -1
        entry = [i for i in range(inside) if height[i] % width < most_blocks and out[i] >= 0]
        return pd.DataFrame({"start": [height[i] for i in entry], "next": [out[i] for i in entry]}, dtype="int64")

    found = dealt.applyInPandas(exits, "start long, next long").toPandas()
    leaves, at, entries = dict(zip(found["start"].tolist(), found["next"].tolist(), strict=True)), 0, {}
    while at is not None:
        entries[at // width] = at
        at = leaves.get(at)

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows, edge, inside = edges(rows)
        height, n, out = rows["height"].to_numpy(), len(rows), []
        at = entries.get(int(rows["_part"][0]))
        i = inside if at is None else int(np.searchsorted(height, at))
        while i < inside and height[i] == at and edge[i] < n:
            e = edge[i]
            out.append((int(rows["first_tx"][i]), int(rows["boundary_tx"][e]) + 1, at, int(height[e])))
            i, at = int(e) + 1, int(height[e]) + 1
        return pd.DataFrame(out, columns=["from_tx", "to_tx", "from_height", "to_height"], dtype="int64")

    return dealt.applyInPandas(walk, "from_tx long, to_tx long, from_height long, to_height long")


def next_edge(blocks: DataFrame, start_height: int, slots: int = FLUSH_SLOTS, most_blocks: int = FLUSH_BLOCKS) -> tuple[int, int, int] | None:
    """Last height, first slot and end slot of the run that starts at a height, or None if neither limit is reached."""
    own = blocks.where(F.col("height") >= start_height)
    first = own.where(F.col("height") == start_height).select("first_tx").head()
    if first is None:
        return None
    full = own.where((F.col("boundary_tx") + 1 - first[0] >= slots) | (F.col("height") - start_height + 1 >= most_blocks)).agg(F.min_by(F.struct("height", "boundary_tx"), "height").alias("e")).head()["e"]
    return None if full is None else (full[0], first[0], full[1] + 1)


def mergeable(runs: list[Run], slots: int = TERMINAL_SLOTS) -> list[Run]:
    """The oldest level 0 runs after the last terminal one, up to the first that crosses the size; none if they don't."""
    out: list[Run] = []
    for run in runs:
        if run.level:
            out = []
            continue
        out.append(run)
        if out[-1].to_tx - out[0].from_tx >= slots:
            return out
    return []


def due(runs: list[Run], slots: int = TERMINAL_SLOTS) -> list[list[Run]]:
    """What `mergeable` gives again and again, when each of its answers has been merged."""
    out: list[list[Run]] = []
    while own := mergeable(runs, slots):
        out.append(own)
        runs = runs[runs.index(own[-1]) + 1 :]
    return out


def check_tiling(runs: list[Run]) -> None:
    """Raises on a gap, an overlap or a broken link to the run before."""
    for a, b in zip(runs, runs[1:], strict=False):
        if b.from_tx != a.to_tx or b.from_height != a.to_height + 1:
            raise ValueError(f"{b.name} doesn't follow {a.name}")
        if b.previous != a.name:
            raise ValueError(f"{b.name} names {b.previous} as the run before, not {a.name}")


def _content(columns: list[str]) -> list[Column]:
    return [F.count("*").alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64(F.lit(1), *columns)).alias("x")]


def _name(n: int, total, mixed: int | None) -> str:
    return f"{n:x}-{int(total or 0) % (1 << 64):016x}{(mixed or 0) % (1 << 64):016x}"


def _parts(run: Run) -> dict[str, tuple[int, int, int]]:
    """Rows, sum and mix of each family, out of the run's name."""
    said = run.name.split("-")[2:]
    return {f[0] or ROWS: (int(n, 16), int(h[:16], 16), int(h[16:], 16)) for f, n, h in zip(run.families, said[::2], said[1::2], strict=True)}


def _together(runs: list[Run]) -> dict[str, str]:
    """The names of what runs hold together, by family: numbers and sums add up, mixes are mixed."""
    parts = [_parts(r) for r in runs]
    if any(p.keys() != parts[0].keys() for p in parts):
        raise ValueError("runs of other families can't be merged")
    return {f: _name(sum(p[f][0] for p in parts), sum(p[f][1] for p in parts), reduce(xor, (p[f][2] for p in parts))) for f in parts[0]}


def content_name(df: DataFrame) -> tuple[str, int]:
    """A name from the rows, whatever their order and files, and their number."""
    n, total, mixed = df.agg(*_content(df.columns)).head()
    return _name(n, total, mixed), n


class Corpus:
    """Runs of one or more tables under a folder that the whole cluster reaches."""

    pins: Counter = Counter()  # snapshots of this process, by run folder

    def __init__(self, spark: SparkSession, folder: str, chain_root: str = "") -> None:
        from pyarrow import fs

        self.spark, self.folder, self.chain_root = spark, folder.rstrip("/"), chain_root
        self.schemas: dict = {}  # of families read before, so that no footer is read for them again
        self.fs, self.path = fs.FileSystem.from_uri(self.folder if "://" in folder or folder.startswith("file:") else "file://" + self.folder)

    # small files

    def _names(self, pattern: str) -> list[str]:
        from pyarrow import fs

        found = self.fs.get_file_info(fs.FileSelector(self.path, allow_not_found=True))
        return sorted(f.base_name for f in found if re.fullmatch(pattern, f.base_name))

    def _get(self, name: str) -> dict:
        with self.fs.open_input_stream(f"{self.path}/{name}") as f:
            return json.loads(f.read())

    def _put(self, name: str, what: dict) -> None:
        own = f"{self.path}/{name}.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(own) as f:
            f.write(json.dumps(what).encode())
        self.fs.move(own, f"{self.path}/{name}")

    def _claim(self, name: str) -> bool:
        """Creates an empty file; False if it is there."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).createNewFile(path)

    # manifests

    def generation(self) -> int:
        """Number of the newest manifest, 0 of none."""
        return max((int(n[9:17]) for n in self._names(r"manifest-\d{8}\.json")), default=0)

    def runs(self, generation: int | None = None) -> list[Run]:
        at = self.generation() if generation is None else generation
        if not at:
            return []
        kept = self._get(f"manifest-{at:08d}.json")
        if kept["version"] != VERSION or kept["chain_root"] != self.chain_root:
            raise ValueError("the manifest is of another version or chain")
        out = [Run.of(r) for r in kept["runs"]]
        check_tiling(out)
        return out

    def commit(self, runs: list[Run], seen: int) -> int:
        """Replace the manifest of that number by one of these runs; a Conflict if it isn't the newest any more."""
        check_tiling(runs)
        self.fs.create_dir(self.path)
        if self.generation() != seen or not self._claim(f"claim-{seen + 1:08d}"):
            raise Conflict(f"manifest {seen + 1} is another writer's")
        self._put(f"manifest-{seen + 1:08d}.json", {"version": VERSION, "chain_root": self.chain_root, "runs": [asdict(r) for r in runs]})
        return seen + 1

    @contextmanager
    def snapshot(self) -> Iterator[list[Run]]:
        """The runs of the newest manifest, whose folders stay until the block ends."""
        own = self.runs()
        Corpus.pins.update(f"{self.path}/{r.path}" for r in own)
        try:
            yield own
        finally:
            Corpus.pins.subtract(f"{self.path}/{r.path}" for r in own)

    def retire(self, old: list[Run]) -> list[str]:
        """Deletes the folders of runs that the newest manifest doesn't name and no snapshot holds."""
        kept, gone = {r.path for r in self.runs()}, []
        for run in old:
            if run.path not in kept and Corpus.pins[f"{self.path}/{run.path}"] <= 0:
                self.fs.delete_dir(f"{self.path}/{run.path}")
                gone.append(run.path)
        return gone

    def sweep(self) -> list[str]:
        """What a writer that died has left: claims without a manifest, and folders that no manifest names. For the only writer."""
        top = self.generation()
        for name in self._names(r"claim-\d{8}"):
            if int(name[6:]) > top:
                self.fs.delete_file(f"{self.path}/{name}")
        kept, gone = {r.path.split("/")[0] for r in self.runs()}, []
        for name in self._names(r"run-.*|batch-.*"):
            if name not in kept and not any(n > 0 and p.startswith(f"{self.path}/{name}") for p, n in Corpus.pins.items()):
                self.fs.delete_dir(f"{self.path}/{name}")
                gone.append(name)
        return gone

    # writing

    def _bytes(self, path: str) -> int:
        from pyarrow import fs

        found = self.fs.get_file_info(fs.FileSelector(f"{self.path}/{path}", recursive=True, allow_not_found=True))
        return sum(f.size for f in found if f.base_name.endswith(".parquet"))

    def _footer(self, run: Run) -> Run:
        self._put(f"{run.path}/_footer.json", asdict(run))
        return run

    def _write(self, tables: dict[str, DataFrame], level: int, span: tuple[int, int, int, int], previous: str) -> Run:
        """Writes a run's families, each sorted by its key, then its footer."""
        path, named, families = f"run-{span[0]:012d}-{uuid.uuid4().hex[:12]}", [], []
        for family, rows in tables.items():
            order = ORDER.get(family, ["txnum"])
            seen = Observation()  # names the rows as they are written, without another pass
            ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).observe(seen, *_content(rows.columns))
            ranged.write.option("compression", "zstd").option("parquet.block.size", 1 << 23).parquet(f"{self.folder}/{path}/{family}")
            got = seen.get
            named.append(_name(got["n"], got["s"], got["x"]))
            families.append((family, got["n"], self._bytes(f"{path}/{family}")))
        name = f"run-{span[0]:012d}-{'-'.join(named)}"
        return self._footer(Run(name, level, *span, sum(f[1] for f in families), previous, path, tuple(families)))

    def flush(self, window: DataFrame | dict[str, DataFrame], span: tuple[int, int, int, int], level: int = 0) -> Run:
        """Append the window's rows of a span, every family in one run: from_tx, to_tx, from_height, to_height."""
        seen = self.generation()
        runs = self.runs(seen)
        inside = (F.col("txnum") >= span[0]) & (F.col("txnum") < span[1])
        tables = window if isinstance(window, dict) else {ROWS: window}
        run = self._write({k: t.where(inside) for k, t in tables.items()}, level, span, runs[-1].name if runs else "")
        self.commit([*runs, run], seen)
        return run

    @staticmethod
    def _placed(rows: DataFrame, spans: list[tuple[int, int, int, int]]) -> DataFrame:
        """rows with `_run`, the place of the span that holds their slot."""
        marks = rows.sparkSession.createDataFrame([(k, s[0], s[1] - 1) for k, s in enumerate(spans)], "_run int, _from long, _to long")
        width = max(256, min(s[1] - s[0] for s in spans))
        return holding_range(rows, "txnum", F.broadcast(marks), "_from", "_to", width).select(*rows.columns, "_run")

    @staticmethod
    def _deal(placed: DataFrame, order: list[str], files: int, *folders: str) -> DataFrameWriter:
        """A writer of a folder for each run, sorted by its key."""
        ranged = placed.repartitionByRange(max(1, files), F.struct("_run", *order)).sortWithinPartitions("_run", *order)
        return ranged.write.partitionBy(*folders).option("compression", "zstd").option("parquet.block.size", 1 << 23)

    def _empty(self, path: str, rows: DataFrame) -> None:
        """A file without rows, which says the schema."""
        from pyarrow import parquet
        from pyspark.sql.pandas.types import to_arrow_schema

        self.fs.create_dir(f"{self.path}/{path}")
        parquet.write_table(to_arrow_schema(rows.schema).empty_table(), f"{self.path}/{path}/empty.parquet", filesystem=self.fs)

    def flush_all(self, rows: DataFrame, spans: list[tuple[int, int, int, int]]) -> list[Run]:
        """Append many runs of one table at once: one pass names them, one writes them."""
        if not spans:
            return []
        seen = self.generation()
        runs, batch = self.runs(seen), f"batch-{uuid.uuid4().hex[:12]}"
        placed = self._placed(rows, spans)
        named = {r["_run"]: _name(r["n"], r["s"], r["x"]) for r in placed.groupBy("_run").agg(*_content(rows.columns)).collect()}  # a row a run
        counts = {k: int(v.split("-")[0], 16) for k, v in named.items()}
        self._deal(placed, ["txnum"], max(len(spans), -(-sum(counts.values()) // FILE_ROWS)), "_run").parquet(f"{self.folder}/{batch}")
        out = []
        for k, span in enumerate(spans):
            path, before = f"{batch}/_run={k}", (out or runs)[-1].name if out or runs else ""
            n = counts.get(k, 0)
            if not n:
                self._empty(path, rows)
            out.append(self._footer(Run(f"run-{span[0]:012d}-{named.get(k, _name(0, 0, 0))}", 0, *span, n, before, path, (("", n, self._bytes(path)),))))
        self.commit([*runs, *out], seen)
        return out

    def merge(self, slots: int = TERMINAL_SLOTS) -> Run | None:
        """Merge what is due into a terminal run: write, compare, commit, then delete what no snapshot holds."""
        seen = self.generation()
        runs = self.runs(seen)
        old = mergeable(runs, slots)
        if not old:
            return None
        families = [f[0] or ROWS for f in old[0].families]
        run = self._write({f: self.read(old, f) for f in families}, 1, (old[0].from_tx, old[-1].to_tx, old[0].from_height, old[-1].to_height), old[0].previous)
        if run.rows != sum(r.rows for r in old) or any(content_name(self.read([run], f))[0] not in run.name for f in families):
            raise ValueError("the merged run isn't what it was made of")
        at = runs.index(old[0])
        rest = runs[at + len(old) :]
        if rest:
            rest[0] = replace(rest[0], previous=run.name)
        self.commit([*runs[:at], run, *rest], seen)
        self.retire(old)
        return run

    def merge_all(self, slots: int = TERMINAL_SLOTS) -> list[Run]:
        """The same runs as `merge` until nothing is due, but however many they are, each family is written in one pass and compared in one.

        What a run is to hold is known from the names of the runs that it is made of.
        """
        seen = self.generation()
        runs = self.runs(seen)
        groups = due(runs, slots)
        if not groups:
            return []
        old, batch = [r for g in groups for r in g], f"batch-{uuid.uuid4().hex[:12]}"
        spans, wanted = [(g[0].from_tx, g[-1].to_tx, g[0].from_height, g[-1].to_height) for g in groups], [_together(g) for g in groups]
        families = list(wanted[0])
        if any(list(w) != families for w in wanted):
            raise ValueError("runs of other families can't be merged")
        flat = families == [ROWS]
        path = lambda k, f: f"{batch}/_run={k}" + ("" if flat else f"/_family={f}")
        counts = {f: [int(w[f].split("-")[0], 16) for w in wanted] for f in families}
        for f in families:
            rows = self.read(old, f)
            placed = self._placed(rows, spans).withColumn("_family", F.lit(f))
            files = max(len(spans), -(-sum(counts[f]) // FILE_ROWS))
            self._deal(placed.drop("_family") if flat else placed, ORDER.get(f, ["txnum"]), files, "_run", *([] if flat else ["_family"])).mode("append").parquet(f"{self.folder}/{batch}")
            held = [f"{self.folder}/{path(k, f)}" for k, n in enumerate(counts[f]) if n]
            k = F.regexp_extract("_metadata.file_path", r"/_run=(\d+)/", 1).cast("int").alias("_run")
            got = {r["_run"]: _name(r["n"], r["s"], r["x"]) for r in self.spark.read.schema(rows.schema).parquet(*held).groupBy(k).agg(*_content(rows.columns)).collect()} if held else {}  # a row a run
            if got != {k: w[f] for k, w in enumerate(wanted) if counts[f][k]}:
                raise ValueError("the merged runs aren't what they were made of")
            for k, n in enumerate(counts[f]):
                if not n:
                    self._empty(path(k, f), rows)
        merged = {}
        for k, (group, span) in enumerate(zip(groups, spans, strict=True)):
            sizes = tuple(("" if flat else f, counts[f][k], self._bytes(path(k, f))) for f in families)
            merged[group[0].name] = Run(f"run-{span[0]:012d}-{'-'.join(wanted[k].values())}", 1, *span, sum(n for _, n, _ in sizes), "", f"{batch}/_run={k}", sizes)
        gone, out = {r.name for r in old}, []
        for run in runs:
            own = merged.get(run.name, None if run.name in gone else run)
            if own:
                own = replace(own, previous=out[-1].name if out else "")
                out.append(self._footer(own) if run.name in merged else own)
        self.commit(out, seen)
        self.retire(old)
        return [r for r in out if r.path.startswith(batch)]

    def migrate(self, make: Callable[[dict[str, DataFrame]], dict[str, DataFrame]]) -> list[Run]:
        """Every run anew with the families that `make` gives for its own, committed at once: how lookups are rebuilt from stored rows."""
        seen = self.generation()
        out: list[Run] = []
        for run in (old := self.runs(seen)):
            own = {f or ROWS: self.read([run], f or ROWS) for f, _, _ in run.families}
            out.append(self._write(make(own), run.level, (run.from_tx, run.to_tx, run.from_height, run.to_height), out[-1].name if out else ""))
        self.schemas.clear()
        self.commit(out, seen)
        self.retire(old)
        return out

    # reading

    def present(self, runs: list[Run]) -> None:
        """Reads all footers at once; of several errors that of the first run is raised."""

        def look(run: Run) -> Exception | None:
            try:
                kept = Run.of(self._get(f"{run.path}/_footer.json"))
                return None if replace(kept, previous=run.previous) == run else ValueError(f"{run.name}: the footer says otherwise")
            except OSError as e:
                return e

        with ThreadPoolExecutor(FAN_OUT) as pool:
            for error in pool.map(look, runs):
                if error:
                    raise error

    @staticmethod
    def _place(run: Run, family: str) -> str:
        """The folder of a run's family: runs of one table are flat, those that were written many at a time name the family as a partition."""
        return run.path + ("" if run.families[0][0] == "" else f"/_family={family}" if run.path.startswith("batch-") else f"/{family}")

    def read(self, runs: list[Run] | None = None, family: str = ROWS) -> DataFrame:
        own = self.runs() if runs is None else runs
        paths = [f"{self.folder}/{self._place(r, family)}" for r in own if any(f[0] in ("", family) and f[1] for f in r.families)]
        if not paths and own:  # no row, but a schema
            paths = [f"{self.folder}/{self._place(own[0], family)}"]
        reader = self.spark.read
        got = (reader.schema(self.schemas[family]) if family in self.schemas else reader).parquet(*paths)
        self.schemas[family] = got.schema
        return got

    def scan(self, family: str = ROWS, runs: list[Run] | None = None) -> DataFrame:
        """All rows by run, then by the family's key; a run that can't be read is an error, that of the first one."""
        own = self.runs() if runs is None else runs
        self.present(own)
        return self.read(own, family).orderBy(*ORDER.get(family, ["txnum"]))

    def at_slots(self, first: int, last: int, family: str = ROWS) -> DataFrame:
        """Rows of a slot range: runs outside it aren't even listed."""
        own = [r for r in self.runs() if r.from_tx <= last and first < r.to_tx]
        return self.read(own, family).where(F.col("txnum").between(first, last))

    def sizes(self) -> DataFrame:
        """level, family, runs, rows and bytes out of the manifest."""
        rows = [(r.level, f or ROWS, n, size) for r in self.runs() for f, n, size in r.families]
        kept = self.spark.createDataFrame(rows, "level int, family string, rows long, bytes long")
        return kept.groupBy("level", "family").agg(F.count("*").alias("runs"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"))

    # publishing

    def _copy(self, paths: list[str], other: Corpus) -> None:
        """Copies the files of folders, a task for each few of them."""
        if not paths:
            return
        source, target = self.folder, other.folder

        def copied(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from pyarrow import fs

            (a, at), (b, to) = (fs.FileSystem.from_uri(x if "://" in x or x.startswith("file:") else "file://" + x) for x in (source, target))
            for batch in batches:
                for path in batch["path"]:
                    for f in a.get_file_info(fs.FileSelector(f"{at}/{path}", recursive=True)):
                        if f.type == fs.FileType.File and f.base_name.endswith(".parquet"):
                            place = f"{to}/{path}/{f.path.split(f'{path}/', 1)[1]}"
                            b.create_dir(place.rsplit("/", 1)[0])
                            fs.copy_files(f.path, place, source_filesystem=a, destination_filesystem=b)
                yield batch[["path"]]

        dealt = self.spark.createDataFrame([(p,) for p in paths], "path string").repartition(min(len(paths), 4 * self.spark.sparkContext.defaultParallelism))
        dealt.mapInPandas(copied, "path string").write.format("noop").mode("overwrite").save()

    def publish(self, folder: str) -> list[Run]:
        """Copy the files of terminal runs that aren't there yet, each with its footer, then a manifest, then the pointer to it."""
        other = Corpus(self.spark, folder, self.chain_root)
        terminal, previous = [], ""
        for run in self.runs():
            if not run.level:
                break
            terminal.append(replace(run, previous=previous))
            previous = run.name
        seen = other.generation()
        there = {r.name for r in other.runs(seen)}
        fresh = [run for run in terminal if run.name not in there]
        self._copy([run.path for run in fresh], other)
        with ThreadPoolExecutor(FAN_OUT) as pool:
            list(pool.map(other._footer, fresh))
        if [r.name for r in other.runs(seen)] != [r.name for r in terminal]:
            seen = other.commit(terminal, seen)
        other.fs.create_dir(other.path)
        other._put("current.json", {"version": VERSION, "chain_root": self.chain_root, "manifest": seen})
        return terminal

    def join(self) -> list[Run]:
        """The runs of a published folder: from the pointer to its manifest, and by the footers back to the first run.

        Refused: a folder with runs but without a pointer, another version or chain, a gap, a
        footer that is missing or says otherwise, a link to another run than the one before.
        """
        if not self._names("current\\.json"):
            if self._names(r"run-.*|batch-.*|manifest-.*"):
                raise ValueError("the folder has runs but no pointer")
            return []
        pointer = self._get("current.json")
        if pointer["version"] != VERSION or pointer["chain_root"] != self.chain_root:
            raise ValueError("the pointer is of another version or chain")
        runs = self.runs(pointer["manifest"])
        self.present(runs)
        by_name, at, walked = {r.name: r for r in runs}, runs[-1].name if runs else "", 0
        while at:
            if at not in by_name:
                raise ValueError(f"the walk leaves the manifest at {at}")
            kept, walked = Run.of(self._get(f"{by_name[at].path}/_footer.json")), walked + 1
            at = kept.previous
        if walked != len(runs):
            raise ValueError("the walk doesn't reach every run")
        return runs
