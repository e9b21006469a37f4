"""One core function per operator, and the method names that lead to it.

An Engine holds the canonical tables as DataFrames. Its methods give DataFrames (or a Page);
`ask` takes a wire method's name and parameters and calls the same functions. By-hash
methods resolve the hash, then go by number. A look-up of an unknown hash gives no row; an
unknown block as a tag is an error; what can't be answered is refused by name.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.functions import wire
from tallystone.operators import fees, ledger, logs, postings, state, traces
from tallystone.plans import bindings, tags

#: fixed values: answers that no table holds
CONSTANTS = {"net_listening": True, "eth_accounts": [], "eth_getUncleCountByBlockNumber": 0, "eth_getUncleCountByBlockHash": 0, "eth_getUncleByBlockNumberAndIndex": None, "eth_getUncleByBlockHashAndIndex": None, "debug_getBadBlocks": [], "net_peerCount": 0, "txpool_status": {"pending": 0, "queued": 0}, "txpool_content": {"pending": {}, "queued": {}}, "txpool_inspect": {"pending": {}, "queued": {}}, "txpool_contentFrom": {"pending": {}, "queued": {}}, "eth_pendingTransactions": [], "eth_syncing": False, "ots_getApiLevel": 8, "web3_clientVersion": "tallystone/0.1.0"}


@dataclass
class Engine:
    """blocks, txs, postings (addr, txnum, height, roles), logs, versions, genesis, traces; transfer and multi: the token signatures."""

    blocks: DataFrame
    txs: DataFrame
    addresses: DataFrame
    logs: DataFrame
    versions: DataFrame
    genesis: DataFrame
    traces: DataFrame
    transfer: list
    multi: list
    accounts: DataFrame
    genesis_accounts: DataFrame
    codes: DataFrame
    wire_txs: DataFrame
    chain_id: int = 1337

    @classmethod
    def bound(cls, spark: SparkSession, folder: str) -> Engine:
        """Over the star schema that the tests use."""
        b = bindings
        return cls(b.blocks(spark, folder), b.txs(spark, folder), b.stored_postings(spark, folder), b.logs(spark, folder, multi=True), b.versions(spark, folder), b.genesis(spark, folder), b.traces(spark, folder), b.TRANSFER, b.MULTI, b.accounts(spark, folder), b.genesis_accounts(spark, folder), b.codes(spark), b.typed_txs(spark, folder))

    def height(self, tag="latest") -> int:
        return tags.height_of_tag(self.blocks, tag)

    def head(self) -> DataFrame:
        return ledger.head(self.blocks)

    def block(self, tag) -> DataFrame:
        h = self.height(tag)
        return ledger.assembled(self.blocks.where(F.col("height") == h), self.txs.where(F.col("height") == h))

    def block_by_hash(self, digest: str) -> DataFrame:
        own = self.blocks.where(F.col("hash") == digest)
        return ledger.assembled(own, self.txs.join(F.broadcast(own.select("height")), "height"))

    def transaction(self, digest: str) -> DataFrame:
        return self.txs.where(F.col("tx_hash") == digest)

    def transaction_at(self, tag, index: int) -> DataFrame:
        return self.txs.where((F.col("height") == self.height(tag)) & (F.col("tx_index") == index))

    def receipts(self, tag) -> DataFrame:
        h = self.height(tag)
        return ledger.receipts(self.txs.where(F.col("height") == h), self.blocks.where(F.col("height") == h))

    def receipt(self, digest: str) -> DataFrame:
        h = F.broadcast(self.transaction(digest).select("height"))
        return ledger.receipts(self.txs.join(h, "height"), self.blocks.join(h, "height")).where(F.col("tx_hash") == digest)

    def details(self, tag) -> DataFrame:
        h = self.height(tag)
        return ledger.block_details(self.blocks.where(F.col("height") == h), self.txs.where(F.col("height") == h))

    def transactions_of(self, tag, page: int, size: int) -> DataFrame:
        return ledger.page_of_block(self.txs, self.height(tag), page, size)

    def by_nonce(self, sender, nonce: int) -> DataFrame:
        return ledger.by_sender_and_nonce(self.txs, sender, nonce)

    def get_logs(self, first=None, last=None, emitters=None, topics=None, block_hash: str | None = None) -> DataFrame:
        if block_hash is not None:
            first = last = self.height(block_hash)  # an unknown hash is an error here
            if first == 0:
                return self.logs.where("false")
        return logs.get_logs(self.logs, logs.criteria(first, last, self.height(), emitters, topics))

    def logs_by_emitter(self, emitter, topic0=None, cursor=None, limit: int = 0, descending: bool = True) -> DataFrame:
        own = self.logs.where(F.col("emitter") == emitter)
        own = own if topic0 is None else own.where(F.get("topics", F.lit(0)) == topic0)
        return postings.log_page_rows(own, cursor, limit, descending)

    def logs_by_value(self, value, topic0=None, mask: int = 0, cursor=None, limit: int = 0, descending: bool = True) -> DataFrame:
        return postings.log_page_rows(logs.with_value(self.logs, value, topic0, mask), cursor, limit, descending)

    def topic_groups(self, value, topic0) -> DataFrame:
        if topic0 is None:
            raise ValueError("topic0 is required")
        return logs.set_rows(self.logs).where((F.col("value") == value) & (F.col("topic0") == topic0)).select("pos", "emitter")

    def transfers(self, holder=None, token=None, standard: str | None = None, cursor=None, limit: int = 0, descending: bool = True) -> DataFrame:
        return postings.log_page_rows(logs.transfers(self.logs, self.transfer, self.multi, holder, token, standard), cursor, limit, descending)

    def token_contracts(self, holder) -> DataFrame:
        counts = self.logs.where("size(topics) > 0").select("emitter", F.get("topics", F.lit(0)).alias("topic0"), F.size("topics").alias("n_topics")).distinct()
        found = logs.token_contracts(logs.set_rows(self.logs), counts, holder, self.transfer, self.multi)
        return found.orderBy(F.when(F.col("standard") == "erc20", 0).when(F.col("standard") == "erc721", 1).otherwise(2), "token")

    def search(self, address, cursor=None, limit: int = 25, descending: bool = True) -> postings.Page:
        return postings.keyset_page(self.addresses.where(F.col("addr") == address), cursor, limit, descending)

    def search_beside(self, address, block: int, size: int, before: bool) -> DataFrame:
        return postings.side_page(self.addresses.where(F.col("addr") == address), block, size, before)

    def state(self, addr, slot, tag="latest") -> DataFrame:
        """The slot's value at a block's boundary slot."""
        at = self.blocks.where(F.col("height") == self.height(tag)).select(F.lit(addr).alias("addr"), F.lit(slot).alias("slot"), F.col("boundary_tx").alias("at"))
        return state.read_many(self.versions.where((F.col("addr") == addr) & (F.col("slot") == slot)), at, self.genesis)

    def _boundary(self, addr, tag) -> DataFrame:
        return self.blocks.where(F.col("height") == self.height(tag)).select(F.lit(addr).alias("addr"), F.col("boundary_tx").alias("at"))

    def account(self, addr, tag="latest") -> DataFrame:
        """balance, nonce and code of an account after a block."""
        return state.accounts_at(self.accounts.where(F.col("addr") == addr), self.genesis_accounts.where(F.col("addr") == addr), self.codes, self._boundary(addr, tag)).select("balance", "nonce", "code")

    def bundle(self, addr, slots: list, tag="latest") -> DataFrame:
        """One row of an account: balance, nonce, code, and a map of the slots asked."""
        at = self._boundary(addr, tag).withColumn("slot", F.explode(F.array(*map(F.lit, slots))))
        read = state.read_many(self.versions.where(F.col("addr") == addr), at.select("addr", "slot", "at"), self.genesis.where("false"))
        kept = read.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("slot", "val")))).alias("slots"))  # as many as were asked
        return self.account(addr, tag).crossJoin(F.broadcast(kept))

    def _slot_of(self, digest: str) -> int | None:
        found = self.transaction(digest.removeprefix("0x").lower()).select("txnum").head()
        return None if found is None else found[0]

    def internal_operations(self, digest: str) -> list | None:
        """None of an unknown transaction, a list (maybe empty) of a known one."""
        at = self._slot_of(digest)
        return None if at is None else traces.internal_operations(self.frames(at)).orderBy("ord").collect()

    def trace_of(self, digest: str, tracer: str | None = "callTracer") -> str | None:
        """The stored trace of a transaction, by hash; other tracers need a machine and are refused. Unknown: None."""
        if tracer not in (None, "callTracer"):
            raise tags.Refused(f"{tracer}: only call traces are stored")
        at = self._slot_of(digest)
        found = None if at is None else self.trace(at).head()
        return found and found["trace"]

    def block_json(self, tag, full: bool) -> DataFrame:
        h = self.height(tag)
        return wire.block(self.blocks.where(F.col("height") == h), self.wire_txs.where(F.col("height") == h), F.lit(wire.full_flag(full)))

    def printed(self, tag) -> str:
        """A block as text: its header, then its transactions, a line each."""
        own = self.block_json(tag, True).head()["json"]
        head, _, rest = own.partition(',"transactions":[')
        return "\n".join([head + "}", *(rest[:-2].replace('},{"hash"', '}\n{"hash"').split("\n") if rest[:-2] else [])])

    def frames(self, txnum: int) -> DataFrame:
        return traces.frames(self.traces.where(F.col("txnum") == txnum))

    def trace(self, txnum: int) -> DataFrame:
        return self.traces.where(F.col("txnum") == txnum)

    def modified(self, first, last=None) -> DataFrame:
        """Accounts written after the first block up to the last; one block alone: in it."""
        lo, hi = self.height(first), self.height(first if last is None else last)
        ends = {r.height: r for r in self.blocks.where(F.col("height").isin(lo, hi)).collect()}
        return state.modified(self.versions, ends[lo].first_tx if last is None else ends[lo].boundary_tx + 1, ends[hi].boundary_tx)

    def creator(self, contract) -> DataFrame:
        return traces.creators(traces.frames(self.traces)).where(F.col("contract") == contract)

    def fee_history(self, count: int, newest="latest", percentiles: list[float] | None = None) -> DataFrame:
        return fees.history(self.blocks, self.txs, count, self.height(newest), percentiles or [])

    def price(self) -> DataFrame:
        return fees.oracle_price(self.blocks, self.txs, 1)

    def tip(self) -> DataFrame:
        base = self.blocks.where(F.col("height") == self.height()).select("base_fee")
        return self.price().crossJoin(base).select(F.greatest(F.col("price") - F.col("base_fee"), F.lit(0)).alias("tip"))

    def methods(self) -> dict[str, Callable]:
        """Wire names, each with the function that answers it."""
        count = lambda tag: self.blocks.where(F.col("height") == self.height(tag)).select("tx_count")
        header = lambda tag: self.blocks.where(F.col("height") == self.height(tag))
        by_hash = lambda f: lambda digest, *a: f({"blockHash": digest}, *a)
        named: dict[str, Callable] = {
            "eth_chainId": lambda: self.chain_id, "net_version": lambda: str(self.chain_id), "eth_blockNumber": self.height,
            "eth_getBalance": lambda a, tag="latest": self.account(a, tag).select("balance"), "eth_getTransactionCount": lambda a, tag="latest": self.account(a, tag).select("nonce"), "eth_getCode": lambda a, tag="latest": self.account(a, tag).select("code"),
            "eth_getStorageAt": self.state, "debug_printBlock": self.printed, "debug_getModifiedAccountsByNumber": self.modified, "debug_getModifiedAccountsByHash": lambda a, b=None: self.modified({"blockHash": a}, b and {"blockHash": b}), "eth_getTransactionByHash": self.transaction, "eth_getTransactionReceipt": self.receipt, "eth_getLogs": self.get_logs,
            "eth_getBlockByNumber": self.block, "eth_getBlockByHash": self.block_by_hash, "eth_getHeaderByNumber": header, "eth_getHeaderByHash": by_hash(header),
            "eth_getBlockTransactionCountByNumber": count, "eth_getBlockTransactionCountByHash": by_hash(count),
            "eth_getTransactionByBlockNumberAndIndex": self.transaction_at, "eth_getTransactionByBlockHashAndIndex": by_hash(self.transaction_at),
            "eth_getBlockReceipts": self.receipts, "eth_gasPrice": self.price, "eth_maxPriorityFeePerGas": self.tip, "eth_feeHistory": self.fee_history,
            "debug_traceTransaction": self.trace_of, "ots_getTransactionBySenderAndNonce": self.by_nonce, "ots_getContractCreator": self.creator,
            "ots_getInternalOperations": self.internal_operations, "ots_getBlockDetails": self.details, "ots_getBlockTransactions": self.transactions_of,
            "ots_searchTransactionsBefore": lambda a, b, n: self.search_beside(a, b, n, True), "ots_searchTransactionsAfter": lambda a, b, n: self.search_beside(a, b, n, False),
            "tally_getLogsByEmitter": self.logs_by_emitter, "tally_getLogsByTopicValue": self.logs_by_value, "tally_getTopicGroups": self.topic_groups,
            "tally_getTokenTransfersByHolder": lambda holder, **k: self.transfers(holder=holder, **k), "tally_getTokenTransfersByContract": lambda token, **k: self.transfers(token=token, **k), "tally_getTokenContracts": self.token_contracts,
        }
        return named | {name: (lambda *_, value=value: value) for name, value in CONSTANTS.items()}

    def batch(self, calls: list[dict], most: int = 1000) -> list[dict]:
        """Answers of a batch, an error for each call that fails; a call without an id is a notice and has no answer. More than `most` are refused whole."""
        if not calls or len(calls) > most:
            raise ValueError(f"a batch has 1 to {most} calls")
        out = []
        for call in calls:
            try:
                params = call.get("params") or []
                got = {"result": self.ask(call["method"], **params) if isinstance(params, dict) else self.ask(call["method"], *params)}
            except (LookupError, NotImplementedError, TypeError, ValueError) as e:
                got = {"error": {"kind": type(e).__name__, "message": str(e)}}
            if "id" in call:
                out.append({"id": call["id"]} | got)
        return out

    def ask(self, method: str, *params, **named):
        tags.refuse(method)
        found = self.methods().get(method)
        if found is None:
            raise tags.UnknownMethod(f"{method}: not known")
        return found(*params, **named)
