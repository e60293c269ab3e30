"""Reading level of each document by harmonic propagation on the document-word graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.asof import salted_left_join
from ..session import partitions, scratch_path, scratch_table, shipped, written
from .text import words

BLOCK_CHARS = 2_500_000  # characters of documents whose edges one Python call holds; a longer document is a block of its own size
ROUNDS = 12  # at most
SETTLED = 1e-3  # relative change of the error on graded documents below which the levels have settled
UNLABELLED = 0.3  # weight of all documents without a label together in the level of a word
PRIOR = 0.3  # weight of the mean level in the level of a word
SPREAD = 0.05  # a word counts in a document as 1 / (variance of its level + SPREAD) squared

PARTIAL = "block bigint, word bigint, la double, lb double, lc double, ua double, ub double, uc double"
PARTIAL_SCHEMA = pa.schema([("block", pa.int64()), ("word", pa.int64())] + [(c, pa.float64()) for c in ("la", "lb", "lc", "ua", "ub", "uc")])
TOTALS = ("word", "la", "lb", "lc", "ua", "ub", "uc")


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, counts = [], []
        for text in batch.column("text").to_pylist():
            seen: dict[str, int] = {}
            for w in words(text):
                seen[w] = seen.get(w, 0) + 1
            names.append(list(seen))
            counts.append(list(seen.values()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(names, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int32()))],
            names=["doc_id", "names", "counts"],
        )


class _Block:
    """The edges of a block of documents as flat arrays."""

    def __init__(self, table: pa.Table):
        kind = np.asarray(table["level"].is_null())
        docs = table.filter(pa.array(kind))
        labels = table.filter(pa.array(~kind))
        level = dict(zip(labels["doc_id"].to_pylist(), labels["level"].to_pylist(), strict=True))
        self.ids = docs["doc_id"].to_pylist()
        self.block = docs["block"][0].as_py() if docs.num_rows else 0
        self.y = np.array([level.get(i, np.nan) for i in self.ids], float)
        lists = docs["hashes"].combine_chunks()
        flat = np.asarray(lists.flatten(), np.int64)
        lengths = np.asarray(lists.value_lengths().fill_null(0), np.int64)
        self.doc = np.repeat(np.arange(len(self.ids)), lengths)
        self.value = np.log1p(np.asarray(docs["counts"].combine_chunks().flatten(), float))
        self.words, self.word = np.unique(flat, return_inverse=True)
        self.labelled = ~np.isnan(self.y)

    def sums(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.word, weights, len(self.words))

    def raw(self, totals: pa.Table, mean: float, line: tuple[float, float]) -> np.ndarray:
        """Weighted mean of the word levels of each document; its own label, if it has one, is taken out of them."""
        at = np.searchsorted(self.words, np.asarray(totals["word"], np.int64))
        t = {}
        for c in TOTALS[1:]:
            t[c] = np.zeros(len(self.words))
            t[c][at] = np.asarray(totals[c], float)
        b0, b1 = line
        some = t["ua"] > 0
        ub, uc = (np.where(some, t[c] / np.where(some, t["ua"], 1.0), 0.0) for c in ("ub", "uc"))
        free = np.where(some, UNLABELLED, 0.0)
        b = t["lb"] + free * (b0 + b1 * ub)
        c = t["lc"] + free * (b0 * b0 + 2 * b0 * b1 * ub + b1 * b1 * uc)
        own = np.where(self.labelled, self.y, 0.0)[self.doc]
        mine = np.where(self.labelled[self.doc], self.value, 0.0)
        a = np.maximum((t["la"] + free)[self.word] - mine, 0.0)
        known = a > 1e-9
        a = a + PRIOR
        m = (b[self.word] - mine * own + PRIOR * mean) / a
        v = np.maximum((c[self.word] - mine * own * own + PRIOR * (mean * mean + 2.0)) / a - m * m, 0.0)
        w = np.where(known, self.value / (v + SPREAD) ** 2, 0.0)
        n = len(self.ids)
        z = np.bincount(self.doc, w, n)
        return np.where(z > 0, np.bincount(self.doc, w * m, n) / np.maximum(z, 1e-12), mean)


def _partial(mean: float, line: tuple[float, float] | None):
    """Sums of a block for each of its words. ``line`` is None in the first round: only labelled documents count."""

    def partial(edges: pa.Table, totals: pa.Table) -> pa.Table:
        block = _Block(edges)
        marked = np.where(block.labelled[block.doc], block.value, 0.0)
        y = np.where(block.labelled, block.y, 0.0)[block.doc]
        cols = [marked, marked * y, marked * y * y]
        if line is None:
            cols += [np.zeros(len(block.doc))] * 3
            raw = np.full(len(block.ids), mean)
        else:
            raw = block.raw(totals, mean, line)
            free = np.where(block.labelled[block.doc], 0.0, block.value)
            r = raw[block.doc]
            cols += [free, free * r, free * r * r]
        sums = [block.sums(c) for c in cols]
        r, t = raw[block.labelled], block.y[block.labelled]
        stats = [len(r), r.sum(), t.sum(), (r * r).sum(), (r * t).sum(), (t * t).sum()]
        n = len(block.words)
        arrays = [pa.array([block.block] * (n + 1), pa.int64()), pa.array([*block.words.tolist(), None], pa.int64())]
        return pa.Table.from_arrays([*arrays, *[pa.array([*s.tolist(), float(x)], pa.float64()) for s, x in zip(sums, stats, strict=True)]], schema=PARTIAL_SCHEMA)

    return partial


SCORE_SCHEMA = pa.schema([("doc_id", pa.int64()), ("raw", pa.float64()), ("label", pa.float64()), ("n_words", pa.int64())])


def _scores(mean: float, line: tuple[float, float]):
    def scores(edges: pa.Table, totals: pa.Table) -> pa.Table:
        block = _Block(edges)
        count = np.bincount(block.doc, minlength=len(block.ids))
        label = [None if np.isnan(y) else float(y) for y in block.y]
        return pa.Table.from_arrays(
            [pa.array(block.ids, pa.int64()), pa.array(block.raw(totals, mean, line)), pa.array(label, pa.float64()), pa.array(count, pa.int64())],
            schema=SCORE_SCHEMA,
        )

    return scores


def cut_points(histogram: list[tuple[float, float, int]]) -> list[float]:
    """For each step between levels the raw score that separates the graded documents with the fewest errors.

    ``histogram``: (raw score, mean level, documents). Documents graded exactly between two levels do not count for
    that step. Among equally good scores the middle one is taken; a step no grade decides lies half-way between the levels.
    """
    cuts = []
    for step in (1.5, 2.5, 3.5, 4.5):
        rows = sorted((r, y > step, n) for r, y, n in histogram if y != step)
        above = sum(n for _, up, n in rows if up)
        if not rows or above == 0 or above == sum(n for *_, n in rows):
            cuts.append(step)
            continue
        errors, best, places = sum(n for _, up, n in rows if not up), None, []
        edges = [rows[0][0] - 0.5, *[(a[0] + b[0]) / 2 for a, b in zip(rows, rows[1:], strict=False)], rows[-1][0] + 0.5]
        for i, edge in enumerate(edges):
            if i:
                errors += rows[i - 1][2] if rows[i - 1][1] else -rows[i - 1][2]
            if 0 < i < len(rows) and rows[i - 1][0] == rows[i][0]:
                continue
            if best is None or errors < best:
                best, places = errors, [edge]
            elif errors == best:
                places.append(edge)
        cuts.append(places[len(places) // 2])
    return np.maximum.accumulate(cuts).tolist()


def reading_levels(documents: DataFrame, labels: DataFrame, rounds: int = ROUNDS, block_chars: int = BLOCK_CHARS, settled: float = SETTLED) -> DataFrame:
    """``doc_id``, ``score`` (continuous level), ``level`` (1 to 5) of each document with at least one word.

    Documents and their words form a bipartite graph. Graded documents are clamped to the mean of their raters; a word
    takes the weighted mean level of its documents, a document that of its words, round after round until the error on the
    graded documents changes by less than ``settled`` of itself, ``rounds`` at most. Ungraded
    documents together weigh no more than a fraction of one grade in a word, or the few grades would drown in a large
    corpus. Words whose documents agree count most. What a graded document is told leaves out its own grade, so a rater's error does not
    confirm itself, and the cut points between levels are fitted on such scores of all graded documents.

    The graph is held as blocks of documents of about ``block_chars`` characters, written once and bucketed by block. A round
    exchanges only sums per (block, word), so a word in half of all documents is no more than one row per block. They are
    combined before the shuffle into totals per word and joined back, salted, to the blocks; each round is written to the
    shared folder. To the driver come sums per round and a histogram of at most some thousand bins.

    Null raters' levels do not count, grades are limited to 1..5, several grades are averaged, grades of unknown
    documents are ignored. Without any usable grade every document gets level 3. Documents of null id are left out.
    """
    spark = shipped(documents.sparkSession)
    n = partitions(spark, documents.select("doc_id", "text"))
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null")
    size = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-int(size) // block_chars))
    block = F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("bigint").alias("block")
    graph = texts.mapInArrow(_edges, "doc_id bigint, names array<string>, counts array<int>").select(
        block, "doc_id", F.transform("names", lambda w: F.xxhash64(w)).alias("hashes"), "counts", F.lit(None).cast("double").alias("level")
    )
    grades = written(
        labels.where("doc_id is not null and reading_level is not null")
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
        .agg(F.avg(F.greatest(F.lit(1), F.least(F.lit(5), "reading_level"))).alias("level")),
        "grades",
    )
    mean = grades.agg(F.avg("level")).first()[0]
    mean = 3.0 if mean is None else float(mean)
    both = graph.unionByName(grades.select(block, "doc_id", "level"), allowMissingColumns=True)
    name = scratch_table(spark, "graph")
    both.repartition(n, "block").write.bucketBy(n, "block").option("path", scratch_path(spark, "graph")).saveAsTable(name)
    edges = spark.table(name).groupBy("block")

    none = spark.createDataFrame([], "block bigint, " + ", ".join(f"{c} {'bigint' if c == 'word' else 'double'}" for c in TOTALS))
    line: tuple[float, float] | None = None
    totals, error = none, None
    for k in range(rounds):
        sums = written(edges.cogroup(totals.groupBy("block")).applyInArrow(_partial(mean, line), PARTIAL), "word_sums")
        if k == 0:
            line = (0.0, 1.0)
        else:
            line, now = _fit(sums.where("word is null").agg(*[F.sum(c) for c in TOTALS[1:]]).first())
            if error is not None and abs(error - now) <= settled * max(error, 1e-9):
                break
            error = now
        words_of = sums.where("word is not null")
        each = words_of.groupBy("word").agg(*[F.sum(c).alias(c) for c in TOTALS[1:]])
        totals = salted_left_join(words_of.select("block", "word"), each, "word", "block").select("block", *TOTALS)
    scores = written(edges.cogroup(totals.groupBy("block")).applyInArrow(_scores(mean, line), "doc_id bigint, raw double, label double, n_words bigint"), "scores")
    scores = scores.where("n_words > 0")
    graded = scores.where("label is not null").groupBy(F.round("raw", 2), "label").count().collect()
    cuts = cut_points([(r[0], r[1], r[2]) for r in graded])
    level = F.lit(1)
    for c in cuts:
        level = level + (F.col("raw") >= c).cast("int")
    return scores.select("doc_id", F.round(F.lit(line[0]) + F.lit(line[1]) * F.col("raw"), 4).alias("score"), level.alias("level"))


def _fit(stats) -> tuple[tuple[float, float], float]:
    """Least-squares line from raw scores to grades, which undoes the shrinkage of averaging, and the mean squared error it leaves."""
    n, r, y, rr, ry, yy = (float(x or 0) for x in stats)
    spread = rr * n - r * r
    slope = (ry * n - r * y) / spread if n >= 3 and spread > 1e-9 else None
    line = (0.0, 1.0) if slope is None else ((y - slope * r) / n, slope)
    a, b = line
    error = (yy + n * a * a + b * b * rr - 2 * a * y - 2 * b * ry + 2 * a * b * r) / n if n else 0.0
    return line, max(error, 0.0)
