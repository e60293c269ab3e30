"""Texts of varying length into containers of fixed capacity."""

from __future__ import annotations

import ast
import base64
import heapq
import re
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shipped, written

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
SHARD_TOKENS = 4_000_000  # tokens that one task packs
SHARD_DOCS = 200_000  # documents that one task packs, if they are that short
MAX_LANGUAGES = 1000  # budgets become part of the plan; there are fewer language codes than this


@cache
def encoding(folder: str, vocabulary: str):
    """A public byte-level BPE tokenizer, read from ``folder``."""
    import tiktoken

    tree = ast.parse(Path(folder, "__init__.py").read_text())  # read as data, not run
    pattern = next(ast.literal_eval(n.value) for n in tree.body if isinstance(n, ast.Assign) and n.targets[0].id == "PATTERN")
    lines = Path(folder, vocabulary).read_bytes().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(vocabulary, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


#: Runs of white space beyond this length are encoded apart: the tokenizer's pattern matches them by backtracking.
LONG_SPACE = re.compile("[ \\t\\n\\r\\x0b\\x0c\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{1000,}")


def token_count(bpe, text: str) -> int:
    """Tokens of a text of any length.

    Of a long run of white space the pattern takes all but the last character as one piece (the last begins the next
    piece), or all of it at the end of the text; so the text can be cut there without changing its tokens.
    """
    total = at = 0
    for run in LONG_SPACE.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        total += len(bpe.encode_ordinary(text[at : run.start()])) + len(bpe._encode_single_piece(text[run.start() : end]))
        at = end
    return total + len(bpe.encode_ordinary(text[at:]))


def _count(folder: str, vocabulary: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoding(folder, vocabulary)
        for batch in batches:
            sizes = [token_count(bpe, t) if t else 0 for t in batch.column("text").to_pylist()]
            rest = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in rest] + [pa.array(sizes, pa.int64())], names=[*rest, "tokens"]
            )

    return count


class Shelf:
    """Open sequences by remaining capacity; finds the cheapest one with room in O(log capacity)."""

    def __init__(self, capacity: int):
        self.size = 1 << (capacity + 1).bit_length()
        self.least = [float("inf")] * (2 * self.size)
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]

    def _refresh(self, room: int) -> None:
        i = room + self.size
        self.least[i] = self.heaps[room][0][0] if self.heaps[room] else float("inf")
        i >>= 1
        while i:
            self.least[i] = min(self.least[2 * i], self.least[2 * i + 1])
            i >>= 1

    def put(self, room: int, cost: float, sequence: int) -> None:
        heapq.heappush(self.heaps[room], (cost, sequence))
        self._refresh(room)

    def take(self, room: int) -> tuple[int, float, int] | None:
        """Remove and return (room, cost, sequence) of the cheapest sequence with at least ``room``; ties: less room, older."""
        best, low, high = float("inf"), room + self.size, 2 * self.size
        nodes = []
        while low < high:
            if low & 1:
                nodes.append(low)
                low += 1
            if high & 1:
                high -= 1
                nodes.append(high)
            low, high = low >> 1, high >> 1
        best = min((self.least[i] for i in nodes), default=best)
        if best == float("inf"):
            return None
        i = min((n for n in nodes if self.least[n] == best), key=lambda n: n << (self.size.bit_length() - n.bit_length()))
        while i < self.size:
            i = 2 * i if self.least[2 * i] == best else 2 * i + 1
        found = i - self.size
        cost, sequence = heapq.heappop(self.heaps[found])
        self._refresh(found)
        return found, cost, sequence


def pack(sizes: np.ndarray, capacity: int, linear: float = 1.0, quadratic: float = 1.0 / 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence, order in the sequence and offset of each item (sizes of at most ``capacity``).

    As many sequences are opened as the total needs; items in descending size go to the sequence of lowest cost
    (linear plus quadratic in the item sizes) with enough room left, and open a new one only if none has.
    """
    n = len(sizes)
    where, order, offset = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    opened = max(1, -(-int(sizes.sum()) // capacity))
    shelf, held = Shelf(capacity), [0] * opened
    for s in range(opened):
        shelf.put(capacity, 0.0, s)
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        room, cost, s = shelf.take(size) or (capacity, 0.0, len(held))
        if s == len(held):
            held.append(0)
        where[i], order[i], offset[i] = s, held[s], capacity - room
        held[s] += 1
        shelf.put(room - size, cost + linear * size + quadratic * size * size, s)
    return where, order, offset


OUT = "doc_id bigint, piece int, first_token bigint, n_tokens bigint, budget_id bigint, capacity_tokens int, container_id string, position int, offset bigint"


def _pack_shard(rows: pd.DataFrame) -> pd.DataFrame:
    capacity, budget, shard = int(rows["capacity_tokens"].iloc[0]), int(rows["budget_id"].iloc[0]), int(rows["shard"].iloc[0])
    rows = rows.sort_values(["doc_id", "first_token"], kind="stable").reset_index(drop=True)
    sizes = rows["n_tokens"].to_numpy(np.int64)
    where, order, offset = pack(sizes, capacity)
    return pd.DataFrame(
        {
            "doc_id": rows["doc_id"], "piece": rows["piece"], "first_token": rows["first_token"], "n_tokens": sizes,
            "budget_id": budget, "capacity_tokens": capacity, "container_id": [f"{budget}-{shard}-{s}" for s in where],
            "position": order.astype(np.int32), "offset": offset,
        }
    )


def packed(
    documents: DataFrame,
    budgets: DataFrame,
    folder: str = TOKENIZERS,
    vocabulary: str = VOCABULARY,
    shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """Container and position of every document, with cost-balanced packing.

    Sizes are tokens of the whole text under a public tokenizer. The budget is that of the language (letter case,
    blanks and a region part of the code do not count), else the one with null language. A text longer than the
    capacity is split into full pieces and a rest; no other text is split. Documents of a budget are spread by hash
    over shards of about ``shard_tokens`` tokens (or ``SHARD_DOCS`` documents, if these are short or empty), so a language with most of the documents is packed by many tasks, at
    the price of one unfilled container or so per shard.

    Null and empty texts have size 0 and take a place without room, so every document appears. Documents without any
    applicable budget are left out; budgets of null or non-positive capacity do not count; of several budgets for one
    language the smallest ``budget_id`` is used. Repeated documents are packed each.
    """
    shipped(documents.sparkSession)
    code = lambda c: F.regexp_extract(F.lower(F.trim(c)), "^([a-z]+)", 1)
    usable = budgets.where("capacity_tokens > 0").select(
        "budget_id", "capacity_tokens", F.when(F.col("lang").isNotNull(), code("lang")).alias("code")
    )
    chosen = usable.groupBy("code").agg(F.min_by(F.struct("budget_id", "capacity_tokens"), "budget_id").alias("budget"))
    if chosen.count() > MAX_LANGUAGES:
        raise ValueError(f"budgets for more than {MAX_LANGUAGES} languages")
    limits = {r["code"]: r["budget"] for r in chosen.collect()}  # one row per language
    entry = lambda b: F.struct(F.lit(b["budget_id"]).cast("bigint").alias("budget_id"), F.lit(b["capacity_tokens"]).cast("int").alias("capacity_tokens"))
    budget = F.lit(None).cast("struct<budget_id:bigint,capacity_tokens:int>") if None not in limits else entry(limits[None])
    named = [x for c, b in limits.items() if c is not None for x in (F.lit(c), entry(b))]
    if named:
        budget = F.coalesce(F.try_element_at(F.create_map(*named), F.coalesce(code("lang"), F.lit(""))), budget)
    rows = documents.select("doc_id", "text", budget.alias("b")).where("b is not null").select("doc_id", "text", "b.*")
    sized = rows.mapInArrow(_count(folder, vocabulary), "doc_id bigint, budget_id bigint, capacity_tokens int, tokens bigint")
    sized = written(sized, "token_sizes")
    totals = sized.groupBy("budget_id").agg(F.sum("tokens").alias("total"), F.count(F.lit(1)).alias("n")).collect()  # one row per budget
    shards = F.lit(1)
    for r in totals:
        count = max(1, round((r["total"] or 0) / shard_tokens), r["n"] // SHARD_DOCS)
        shards = F.when(F.col("budget_id") == r["budget_id"], F.lit(count)).otherwise(shards)
    starts = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.expr("(tokens - 1) div capacity_tokens"), F.lit(0)))
    pieces = sized.withColumn("shards", shards).select(
        "doc_id", "budget_id", "capacity_tokens", "tokens", F.posexplode(starts).alias("piece", "k"), "shards"
    ).select(
        "doc_id", "budget_id", "capacity_tokens", "piece", (F.col("k") * F.col("capacity_tokens")).alias("first_token"),
        F.greatest(F.least(F.col("capacity_tokens").cast("bigint"), F.col("tokens") - F.col("k") * F.col("capacity_tokens")), F.lit(0)).alias("n_tokens"),
        F.pmod(F.xxhash64("doc_id", "piece"), F.col("shards")).alias("shard"),
    )
    return pieces.groupBy("budget_id", "shard").applyInPandas(_pack_shard, OUT)


def fill_report(placed: DataFrame) -> DataFrame:
    """Per budget: containers, tokens, unused tokens and share, highest load."""
    loads = placed.groupBy("budget_id", "capacity_tokens", "container_id").agg(F.sum("n_tokens").alias("load"))
    return loads.groupBy("budget_id", "capacity_tokens").agg(
        F.count(F.lit(1)).alias("containers"),
        F.sum("load").alias("tokens"),
        F.sum(F.col("capacity_tokens") - F.col("load")).alias("unused_tokens"),
        F.round(F.sum(F.col("capacity_tokens") - F.col("load")) / F.sum("capacity_tokens"), 6).alias("unused_share"),
        F.max("load").alias("highest_load"),
    )
