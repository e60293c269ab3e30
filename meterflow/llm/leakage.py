"""Evaluation texts leaking into training text."""

from __future__ import annotations

import json
import os
import uuid
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path, shipped
from .text import words, words_at

MIN_WORDS = 8
BLOCK_CHARS = 1_500_000  # characters of test items in one automaton: bounds the memory of the task that builds it to half a GB


class SuffixAutomaton:
    """Generalised suffix automaton over the words of several items, as it is built; ``arrays`` is what texts are streamed through.

    A state reached with a match of at least ``least`` words stands for the items that hold the last ``least`` words
    read: those of the shortest class on its suffix path that is still that long.
    """

    def __init__(self, items: list[tuple[int, list[str]]], least: int):
        self.least, self.vocabulary = least, {}
        self.next, self.link, self.length = [{}], [-1], [0]
        ends = []
        for item, text in items:
            last = 0
            for w in text:
                last = self._extend(last, self.vocabulary.setdefault(w, len(self.vocabulary)))
                ends.append((last, item))
        self.holders: dict[int, set[int]] = {}
        for state, item in ends:
            if self.length[state] >= least:
                self.holders.setdefault(self._top(state), set()).add(item)
        # a prefix end may have become a longer class than the prefix itself; shorter prefixes hold no passage
        self.top = {s: t for s in range(len(self.link)) if self.length[s] >= least for t in (self._top(s),)}

    def _new(self, length: int, after: dict[int, int], link: int) -> int:
        self.next.append(after)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """The class reached from ``p`` by ``w`` with exactly one more word than ``p``; a copy of ``q`` if q is longer."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:  # an earlier item has this passage
            return self._split(last, w, self.next[last][w])
        state, p = self._new(self.length[last] + 1, {}, 0), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = state
            p = self.link[p]
        if p >= 0:
            self.link[state] = self._split(p, w, self.next[p][w])
        return state

    def _top(self, state: int) -> int:
        while self.length[self.link[state]] >= self.least:
            state = self.link[state]
        return state

    def arrays(self) -> dict[str, np.ndarray]:
        """The automaton as flat arrays: transitions and items in rows per state, sorted by word."""
        n = len(self.link)
        after = [sorted(edges.items()) for edges in self.next]
        rows = {s: k for k, s in enumerate(sorted(self.holders))}
        held = [sorted(self.holders[s]) for s in rows]
        starts = lambda lists: np.cumsum([0, *map(len, lists)]).astype(np.int64)
        return {
            "starts": starts(after),
            "words": np.array([w for edges in after for w, _ in edges], np.int32),
            "targets": np.array([t for edges in after for _, t in edges], np.int32),
            "link": np.array(self.link, np.int32),
            "length": np.array(self.length, np.int32),
            "row": np.array([rows.get(self.top.get(s, -1), -1) for s in range(n)], np.int32),
            "held": starts(held),
            "items": np.array([i for items in held for i in items], np.int64),
            "vocabulary": np.frombuffer("\n".join(self.vocabulary).encode(), np.uint8),
        }


class FlatAutomaton:
    """A suffix automaton read from flat arrays, which may be memory-mapped files that many processes share."""

    def __init__(self, arrays: dict[str, np.ndarray], least: int):
        self.least = least
        self.ids = {w: i for i, w in enumerate(bytes(arrays["vocabulary"]).decode().split("\n"))}
        for name in ("starts", "words", "targets", "link", "length", "row", "held", "items"):
            setattr(self, name, memoryview(arrays[name]))

    def items_at(self, state: int) -> list[int]:
        row = self.row[state]
        return [] if row < 0 else self.items[self.held[row] : self.held[row + 1]].tolist()

    def matches(self, text: list[str]) -> Iterator[tuple[int, int, int]]:
        """(end, length, state) wherever the longest match that ends there has at least ``least`` words."""
        starts, names, targets, link, longest, ids, least = self.starts, self.words, self.targets, self.link, self.length, self.ids, self.least
        state = n = 0
        for i, word in enumerate(text):
            w = ids.get(word)
            if w is None:
                state = n = 0
                continue
            while state:
                low, high = starts[state], starts[state + 1]
                k = low if high == low + 1 else bisect_left(names, w, low, high)
                if k < high and names[k] == w:
                    break
                state = link[state]
                n = longest[state]
            else:
                k = starts[0] + w  # every word of the items leaves the root
            state = targets[k]
            n += 1
            if n >= least:
                yield i + 1, n, state


def leaks_of(automata: list[FlatAutomaton], text: str | None) -> tuple[list[int], list[tuple[int, int]], int, int] | None:
    """Items a text holds, its matched word spans (merged), the longest match and the number of words; None if it holds none."""
    tokens = words(text)
    items: set[int] = set()
    found: list[tuple[int, int]] = []
    longest = 0
    for automaton in automata:
        spans: list[list[int]] = []
        for end, n, state in automaton.matches(tokens):
            items.update(automaton.items_at(state))
            longest, start = max(longest, n), end - n
            while spans and spans[-1][0] >= start:
                spans.pop()
            if spans and start <= spans[-1][1]:
                spans[-1][1] = end
            else:
                spans.append([start, end])
        found += map(tuple, spans)
    merged: list[list[int]] = []
    for start, end in sorted(found):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    return (sorted(items), [(a, b) for a, b in merged], longest, len(tokens)) if items else None


def _files(path: str):
    """File system and path of a folder that may be local, mounted or in an object store."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _save(arrays: dict[str, np.ndarray], path: str) -> None:
    """One file per array, then a note of their types; a folder without the note does not count."""
    files, at = _files(path)
    files.create_dir(at, recursive=True)
    for name, values in arrays.items():
        with files.open_output_stream(f"{at}/{name}") as out:
            out.write(values.tobytes())
    with files.open_output_stream(f"{at}/note.json") as out:
        out.write(json.dumps({name: str(values.dtype) for name, values in arrays.items()}).encode())


@lru_cache(maxsize=64)
def _load(path: str, least: int) -> FlatAutomaton:
    """Once per Python worker; on a mounted folder the pages are shared by all workers of a machine."""
    from pyarrow import fs

    files, at = _files(path)
    with files.open_input_stream(f"{at}/note.json") as note:
        kinds = json.loads(note.read())

    def read(name: str, kind: str) -> np.ndarray:
        if isinstance(files, fs.LocalFileSystem):
            return np.memmap(f"{at}/{name}", kind, "r") if os.path.getsize(f"{at}/{name}") else np.array([], kind)
        with files.open_input_stream(f"{at}/{name}") as stream:
            return np.frombuffer(stream.read(), kind)

    return FlatAutomaton({name: read(name, kind) for name, kind in kinds.items()}, least)


def _build(base: str, least: int):
    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["item_id", "item_text"])
        named = [(-1 if pd.isna(i) else int(i), words(t)) for i, t in zip(rows["item_id"], rows["item_text"], strict=True)]
        path = f"{base}/{key[0]}-{uuid.uuid4().hex[:8]}"
        _save(SuffixAutomaton(named, least).arrays(), path)
        return pd.DataFrame({"path": [path]})

    return build


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    _, begins, ends = words_at(text)
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : begins[a]])
        at = ends[b - 1]
    return "".join([*out, text[at:]])


def _search(paths: list[str], least: int, max_words: int, max_coverage: float):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = [_load(path, least) for path in paths]
        for batch in batches:
            out: dict[str, list] = {c: [] for c in SCHEMA.names}
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hit = leaks_of(automata, text)
                if hit is None:
                    continue
                found, spans, longest, n = hit
                covered = sum(b - a for a, b in spans)
                cut = spans if covered > max_coverage * n else [s for s in spans if s[1] - s[0] > max_words]
                row = (doc, found, longest, covered, n, len(cut), _without(text, cut))
                for c, v in zip(SCHEMA.names, row, strict=True):
                    out[c].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=SCHEMA)

    return search


SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("items", pa.list_(pa.int64())),
        ("longest_words", pa.int32()),
        ("covered_words", pa.int32()),
        ("n_words", pa.int32()),
        ("spans_removed", pa.int32()),
        ("clean_text", pa.string()),
    ]
)


def leaking_documents(
    documents: DataFrame,
    items: DataFrame,
    least: int = MIN_WORDS,
    max_words: int = 12,
    max_coverage: float = 0.2,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Documents that hold at least ``least`` consecutive words of a test item, with all such items.

    The automaton of the normalised items is built by tasks, one for every ``block_chars`` characters of items, and
    laid into the shared folder as flat arrays. Every document is read once and streamed, whole, through all of them with the
    length of the longest match at each word; a worker maps the files once, so automata are neither built nor held per
    task, and neither items nor documents reach the driver or are shuffled (but for the items, once).

    ``clean_text`` is the text without its matched spans of more than ``max_words`` words, or without all of
    them if they cover more than ``max_coverage`` of its words.

    Null or empty texts and items hold no passage; items of fewer than ``least`` words cannot leak. Repeated items and
    documents are reported each. Documents of null id are reported under a null id, items of null id under -1.
    """
    spark = shipped(documents.sparkSession)
    wanted = items.select(F.col("item_id").cast("bigint").alias("item_id"), "item_text").where(F.col("item_text").isNotNull())
    total = wanted.agg(F.sum(F.length("item_text"))).first()[0] or 0
    blocks = max(1, -(-int(total) // block_chars))
    block = F.pmod(F.xxhash64("item_id", "item_text"), F.lit(blocks)).cast("int").alias("block")
    built = wanted.select("item_id", "item_text", block).groupBy("block").applyInPandas(_build(scratch_path(spark, "automata"), least), "path string")
    paths = sorted(r.path for r in built.collect())  # one path per block of items
    texts = documents.select("doc_id", F.col("text").alias("text")).where(F.col("text").isNotNull())
    return texts.mapInArrow(
        _search(paths, least, max_words, max_coverage),
        "doc_id bigint, items array<bigint>, longest_words int, covered_words int, n_words int, spans_removed int, clean_text string",
    )


def leaked_pairs(documents: DataFrame, items: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """``item_id``, ``doc_id``: each test item with each document that holds a passage of it."""
    found = leaking_documents(documents, items, least)
    return found.select(F.explode("items").alias("item_id"), "doc_id")
