"""Packing, leaks and reading levels against brute force and on awkward inputs."""

from __future__ import annotations

import random
from itertools import pairwise

import numpy as np
import pytest
from conftest import DATA
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meterflow.llm import queries
from meterflow.llm.leakage import FlatAutomaton, SuffixAutomaton, leaked_pairs, leaking_documents, leaks_of
from meterflow.llm.packing import TOKENIZERS, VOCABULARY, encoding, fill_report, pack, packed, token_count
from meterflow.llm.reading import cut_points, reading_levels
from meterflow.llm.text import words, words_at


def clash(df):
    names = ["items", "shard", "piece", "tokens", "b", "block", "level", "names", "counts", "code", "budget", "raw", "word"]
    return df.withColumns({n: F.lit("x") for n in names if n not in df.columns})


# --- words ---


def test_words_are_folded():
    assert words("Ça va, L'ÉTÉ ﬁne ①２x_y") == ["ca", "va", "l", "ete", "fine", "12x", "y"]
    assert words("re­gu​lato﻿ry été") == ["regulatory", "ete"]
    assert words(None) == words("") == words(" \n-–") == []
    assert words("STRASSE") == words("straße")


@given(st.text(max_size=60))
@settings(deadline=None)
def test_places_of_words(text):
    tokens, begins, ends = words_at(text)
    for w, a, b in zip(tokens, begins, ends, strict=True):
        assert 0 <= a < b <= len(text) and w in "".join(words(text[a:b]))
    if text.isascii():
        assert tokens == words(text)


# --- p9 ---


def brute(items, text, least):
    grams = {}
    for i, t in items:
        for k in range(len(t) - least + 1):
            grams.setdefault(tuple(t[k : k + least]), set()).add(i)
    found = set()
    for k in range(len(text) - least + 1):
        found |= grams.get(tuple(text[k : k + least]), set())
    return sorted(found)


@given(st.lists(st.lists(st.sampled_from("abc"), max_size=14), min_size=1, max_size=6), st.lists(st.sampled_from("abcd"), max_size=40), st.integers(1, 4))
@settings(max_examples=300, deadline=None)
def test_automaton_finds_all_items(items, text, least):
    numbered = list(enumerate(items))
    flat = FlatAutomaton(SuffixAutomaton(numbered, least).arrays(), least)
    hit = leaks_of([flat], " ".join(text))
    assert (hit[0] if hit else []) == brute(numbered, text, least)
    if hit:
        assert all(a < b for a, b in hit[1]) and all(x[1] < y[0] for x, y in pairwise(hit[1])) and hit[3] == len(text)
        halves = [FlatAutomaton(SuffixAutomaton(numbered[k::2], least).arrays(), least) for k in range(2)]
        assert leaks_of(halves, " ".join(text)) == hit
        assert hit[2] == max(k for t in items for i in range(len(t)) for k in range(1, len(t) - i + 1) if any(text[j : j + k] == t[i : i + k] for j in range(len(text))))
        want = set()
        for k in range(len(text) - least + 1):
            if brute(numbered, text[k : k + least], least):
                want |= set(range(k, k + least))
        assert {i for a, b in hit[1] for i in range(a, b)} == want


def test_leaks_and_cleaning(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    docs = [
        (1, "Zero. ONE, two three four five six seven eight! End of a long tail " + "x " * 50), (2, "one two three four five six seven"), (3, None), (4, ""),
        (5, "Öne twö three four five six seven eight nine ten eleven twelve thirteen rest " + "y " * 200), (6, item), (7, "one two three four five six, other seven eight"),
        (1, "Zero. ONE, two three four five six seven eight! End of a long tail " + "x " * 50), (None, item), (8, "word " * 200_000 + item),
    ]
    d = clash(spark.createDataFrame(docs, "doc_id bigint, text string"))
    i = clash(spark.createDataFrame([(10, item), (11, "six seven eight " + item), (12, None), (13, "too short"), (14, item)], "item_id bigint, item_text string"))
    got = sorted(((r.doc_id or 0), r.item_id) for r in leaked_pairs(d, i).collect())
    assert got == sorted((doc, it) for doc in (0, 1, 1, 5, 6, 8) for it in (10, 11, 14))
    clean = {r.doc_id: r for r in leaking_documents(d, i).collect()}
    assert clean[6].clean_text == "" and clean[6].spans_removed == 1
    assert clean[1].spans_removed == 0 and clean[1].covered_words == 8
    assert clean[5].longest_words == 13 and clean[5].clean_text.startswith(" rest y")
    blocks = leaking_documents(d, i, block_chars=20)
    assert sorted(((r.doc_id or 0), x) for r in blocks.collect() for x in r["items"]) == got
    assert leaked_pairs(d.limit(0), i).count() == leaked_pairs(d, i.limit(0)).count() == 0


# --- p8 ---


@given(st.lists(st.integers(0, 50), max_size=120), st.integers(50, 90))
@settings(max_examples=80, deadline=None)
def test_pack_is_valid_and_cheapest_first(sizes, capacity):
    sizes = np.array(sizes, np.int64)
    where, order, offset = pack(sizes, capacity)
    room, cost = {}, {}
    opened = max(1, -(-int(sizes.sum()) // capacity))
    for s in range(opened):
        room[s], cost[s] = capacity, 0.0
    for i in np.argsort(-sizes, kind="stable"):  # the same rule, by search
        fit = [(cost[s], s) for s in room if room[s] >= sizes[i]]
        if not fit:
            room[len(room)], cost[len(cost)] = capacity, 0.0
            fit = [(0.0, len(room) - 1)]
        s = int(where[i])
        assert (room[s] >= sizes[i]) and cost[s] == pytest.approx(min(fit)[0])
        assert offset[i] == capacity - room[s]
        room[s] -= sizes[i]
        cost[s] += sizes[i] + sizes[i] ** 2 / 1024
    for s in set(where.tolist()):
        mine = sorted(zip(order[where == s], offset[where == s], sizes[where == s], strict=True))
        assert [o for o, _, _ in mine] == list(range(len(mine)))
        assert sum(z for _, _, z in mine) <= capacity


@given(st.text(st.sampled_from("a1 \n\t.é\u3000"), max_size=12), st.text(st.sampled_from("ab1 \n."), max_size=12), st.text(st.sampled_from(" \n\t\u3000"), min_size=1000, max_size=1003))
@settings(max_examples=60, deadline=None)
def test_cutting_at_white_space_changes_no_token(before, after, space):
    bpe, text = encoding(TOKENIZERS, VOCABULARY), before + space + after
    assert token_count(bpe, text) == len(bpe.encode_ordinary(text))


def test_very_long_texts():
    bpe = encoding(TOKENIZERS, VOCABULARY)
    for unit in (" ", "\n", "x", "1", ".", "é", "word ", "\n\n. "):
        text = unit * (1_000_000 // len(unit))
        assert 0 < token_count(bpe, text) <= len(text.encode())


def test_packing_is_complete(spark):
    rng = random.Random(5)
    vocabulary = "the energy report of a printer moves slowly through many rooms".split()
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 40))), rng.choice(["en", "EN", "en-XX", "de", None, "fr", "??"])) for i in range(400)]
    rows += [(900, None, "en"), (901, "", None), (902, "word " * 5000, "en"), (903, "x" * 3000, "de"), (900, None, "en")]
    docs = clash(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    budgets = clash(spark.createDataFrame([(1, "en", 64), (2, "de", 128), (3, None, 256), (4, "en", 999), (5, "it", None), (6, "xx", 0)], "budget_id bigint, lang string, capacity_tokens int"))
    placed = packed(docs, budgets, shard_tokens=2000)
    got = placed.toPandas()
    bpe = encoding(TOKENIZERS, VOCABULARY)
    size = {i: len(bpe.encode_ordinary(t or "")) for i, t, _ in rows}
    copies = {i: sum(1 for x in rows if x[0] == i) for i in size}
    assert set(got.doc_id) == set(size)
    for i, part in got.groupby("doc_id"):
        assert part.n_tokens.sum() == size[i] * copies[i]
        assert len(part) == copies[i] * max(1, -(-size[i] // int(part.capacity_tokens.iloc[0])))
    assert (got.groupby("container_id").n_tokens.sum() <= got.groupby("container_id").capacity_tokens.first()).all()
    lang = {i: x for i, _, x in rows}
    assert {(lang[i], b) for i, b in zip(got.doc_id, got.budget_id, strict=True)} == {("en", 1), ("EN", 1), ("en-XX", 1), ("de", 2), (None, 3), ("fr", 3), ("??", 3)}
    assert not got.duplicated(["container_id", "position"]).any()
    assert placed.select("container_id").distinct().count() > 100
    report = {r.budget_id: r for r in fill_report(placed).collect()}
    assert all(r.unused_share < 0.2 for r in report.values())
    assert packed(docs.limit(0), budgets).count() == 0
    assert packed(docs, budgets.limit(0)).count() == 0
    assert set(packed(docs, budgets.where("lang = 'de'")).toPandas().budget_id) == {2}


# --- p10 ---


def corpus(n, seed=7):
    rng = random.Random(seed)
    bands = [[f"w{level}x{i}" for i in range(30)] for level in range(6)]
    docs, level = [], {}
    for i in range(n):
        k = rng.randrange(1, 6)
        level[i] = k
        docs.append((i, " ".join(rng.choice(bands[max(1, min(5, k + rng.choice([0, 0, 0, -1, 1])))] + bands[0]) for _ in range(40))))
    return docs, level


@pytest.mark.parametrize("block_chars", [4_000, 2_000_000])
def test_levels_on_held_out_documents(spark, block_chars):
    docs, level = corpus(500)
    grades = [(i, "r", min(5, max(1, level[i] + (1 if i % 20 == 0 else 0)))) for i in range(0, 500, 3)]
    got = reading_levels(
        clash(spark.createDataFrame(docs, "doc_id bigint, text string")), clash(spark.createDataFrame(grades, "doc_id bigint, rater string, reading_level int")), block_chars=block_chars
    ).toPandas().set_index("doc_id")
    out = [i for i in range(500) if i % 3]
    assert len(got) == 500
    assert np.mean([got.level[i] == level[i] for i in out]) > 0.85
    assert np.mean([(got.level[i] >= 4) == (level[i] >= 4) for i in out]) > 0.95
    assert np.mean([abs(got.score[i] - level[i]) for i in out]) < 0.5


def test_blocks_do_not_change_the_result(spark):
    docs, level = corpus(120)
    grades = spark.createDataFrame([(i, "r", level[i]) for i in range(0, 120, 2)], "doc_id bigint, rater string, reading_level int")
    one, many = (reading_levels(spark.createDataFrame(docs, "doc_id bigint, text string"), grades, block_chars=b).toPandas().sort_values("doc_id").reset_index(drop=True) for b in (2_000_000, 900))
    assert np.allclose(one.score, many.score, atol=1e-3) and (one.level == many.level).all()


def test_awkward_documents_and_grades(spark):
    docs = spark.createDataFrame([(1, "easy cat"), (2, "hard words"), (3, None), (4, ""), (5, "cat"), (6, "unseen"), (None, "cat"), (7, "hard " * 300_000)], "doc_id bigint, text string")
    grades = spark.createDataFrame([(1, "a", 1), (1, "b", None), (2, "a", 5), (2, "b", 9), (99, "a", 3), (None, "a", 3)], "doc_id bigint, rater string, reading_level int")
    got = {r.doc_id: r.level for r in reading_levels(docs, grades).collect()}
    assert set(got) == {1, 2, 5, 6, 7} and all(1 <= v <= 5 for v in got.values())
    assert got[5] < got[7]
    assert set(r.level for r in reading_levels(docs, grades.limit(0)).collect()) == {3}
    assert reading_levels(docs.limit(0), grades).count() == 0


def test_cut_points():
    assert cut_points([]) == [1.5, 2.5, 3.5, 4.5]
    rows = [(float(k) + 0.1 * j, float(k), 3) for k in range(1, 6) for j in range(3)]
    cuts = cut_points(rows)
    assert all(k + 0.2 < c <= k + 1 for k, c in enumerate(cuts, 1))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_runs(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() >= 0
