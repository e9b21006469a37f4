"""Stages from the command line: verify, publish, sizes of a corpus, and questions to an engine.

    python -m tallystone verify FOLDER --chain NAME
    python -m tallystone publish FOLDER TO --chain NAME
    python -m tallystone sizes FOLDER --chain NAME
    python -m tallystone ask DATA METHOD [JSON PARAMETER ...]
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession

from tallystone.engine import Engine
from tallystone.sources import runs


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tallystone")
    stages = parser.add_subparsers(dest="stage", required=True)
    for name, extra in (("verify", []), ("publish", ["to"]), ("sizes", [])):
        own = stages.add_parser(name)
        for a in ("folder", *extra):
            own.add_argument(a)
        own.add_argument("--chain", default="")
    own = stages.add_parser("ask")
    own.add_argument("data")
    own.add_argument("method")
    own.add_argument("params", nargs="*")
    given = parser.parse_args(args)
    spark = spark or SparkSession.builder.getOrCreate()
    if given.stage == "ask":
        got = Engine.bound(spark, given.data).ask(given.method, *map(json.loads, given.params))
        for row in got.limit(1000).toJSON().collect() if isinstance(got, DataFrame) else [json.dumps(got, default=str)]:
            print(row)
        return 0
    corpus = runs.Corpus(spark, given.folder, given.chain)
    if given.stage == "publish":
        print(json.dumps([r.name for r in corpus.publish(given.to)]))
    elif given.stage == "sizes":
        for row in corpus.sizes().orderBy("level", "family").toJSON().collect():
            print(row)
    else:
        own = corpus.runs()
        if not own:
            raise ValueError("nothing was walked")
        corpus.present(own)
        for run in own:
            for family, n, _ in run.families:
                name, found = runs.content_name(corpus.read([run], family or runs.ROWS)) if n else ("", 0)
                if found != n or name not in run.name:
                    raise ValueError(f"{run.name}: {family} isn't what the manifest says")
        print(json.dumps({"runs": len(own), "rows": sum(r.rows for r in own), "to_tx": own[-1].to_tx}))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
