"""Block tags, and what is refused by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NEWEST = ("latest", "pending", "", "safe", "finalized", None)

#: fixed values: methods that need what this engine doesn't have, by reason
REFUSED = {
    "no virtual machine": ("eth_call", "eth_callDetailed", "eth_estimateGas", "eth_createAccessList", "debug_traceCall"),
    "no proofs are stored": ("eth_getProof",),
    "no state dump": ("debug_dumpBlock", "debug_accountRange", "debug_storageRangeAt", "debug_intermediateRoots"),
    "no preimages": ("debug_preimage",),
    "no bad blocks": ("debug_traceBadBlock",),
    "no chain trace": ("debug_traceChain",),
    "read-only": ("eth_sendRawTransaction", "eth_sendTransaction", "eth_fillTransaction", "eth_resend"),
    "no keys": ("eth_sign", "eth_signTransaction"),
}
#: fixed values: namespaces of which nothing is served, by reason
CLOSED = {"personal": "no keys", "miner": "nothing is mined", "admin": "no node to administer", "les": "no light clients", "clique": "other consensus", "ethash": "other consensus"}


class Refused(NotImplementedError):
    """Known, and never answered here."""


class UnknownMethod(NotImplementedError):
    """A name that means nothing here."""


class UnknownBlock(LookupError):
    """A tag that names no block; a look-up by hash gives null instead."""


def height_of_tag(blocks: DataFrame, tag) -> int:
    """A height for a tag: a name, a number, a 0x quantity, a hash, or an object with one of these."""
    top = blocks.agg(F.max("height")).head()[0]
    if top is None:
        raise UnknownBlock("no blocks")
    if isinstance(tag, dict):
        if ("blockNumber" in tag) == ("blockHash" in tag):
            raise ValueError("either blockNumber or blockHash")
        if not isinstance(tag.get("requireCanonical", False), bool):
            raise ValueError("requireCanonical is a boolean")  # every stored block is canonical
        tag = tag.get("blockNumber", tag.get("blockHash"))
    if tag in NEWEST:
        return top
    if tag == "earliest":
        return 0
    if isinstance(tag, str) and len(tag.removeprefix("0x")) == 64:
        found = blocks.where(F.col("hash") == tag.removeprefix("0x").lower()).select("height").head()
        if found is None:
            raise UnknownBlock(tag)
        return found[0]
    number = int(tag, 16) if isinstance(tag, str) else int(tag)
    if number < 0 or number > top:
        raise UnknownBlock(str(tag))
    return number


def heights(blocks: DataFrame, asked: DataFrame) -> DataFrame:
    """tag and height of each tag asked (a name, a number, a 0x quantity or a hash), null for one that names no block, in one plan."""
    top = F.broadcast(blocks.agg(F.max("height").alias("top")))
    bare = F.regexp_replace(F.col("tag"), "^0x", "")
    is_hash = F.length(bare) == 64
    number = F.when(F.coalesce(F.col("tag"), F.lit("")).isin([t for t in NEWEST if t is not None]), F.col("top")).when(F.col("tag") == "earliest", F.lit(0)).when(F.col("tag").rlike("^0x[0-9a-fA-F]{1,15}$"), F.conv(bare, 16, 10).cast("long")).when(F.col("tag").rlike("^[0-9]{1,18}$"), F.col("tag").cast("long"))
    named = asked.crossJoin(top).withColumns({"number": F.when(~is_hash | F.col("tag").isNull(), number), "digest": F.when(is_hash, F.lower(bare))})
    found = named.join(blocks.select(F.col("height").alias("_height"), F.col("hash").alias("_hash")), F.col("digest") == F.col("_hash"), "left")
    return found.select("tag", F.coalesce(F.when(F.col("number") <= F.col("top"), F.col("number")), "_height").alias("height"))


def refusals(spark: SparkSession) -> DataFrame:
    """method, reason: one row for each method and namespace that is refused."""
    rows = [(m, why) for why, names in REFUSED.items() for m in names] + [(f"{n}_*", why) for n, why in CLOSED.items()]
    return spark.createDataFrame(rows, "method string, reason string")


def refuse(method: str) -> None:
    for why, names in REFUSED.items():
        if method in names:
            raise Refused(f"{method}: {why}")
    if (why := CLOSED.get(method.split("_")[0])) and "_" in method:
        raise Refused(f"{method}: {why}")
