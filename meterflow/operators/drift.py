"""Schemas that drift between files: change report and one consistent table."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shipped, written
from .asof import salted_left_join

CELLS = 24  # cells of a value sketch
SHAPES = 4  # hash functions of a shape sketch
KINDS = ("number", "string", "boolean", "other")


@dataclass(frozen=True)
class DriftRules:
    depth: int = 6  # levels of nested objects that are flattened; deeper objects are values of kind "other"
    name_weight: float = 0.4
    accept: float = 0.33  # pairs scoring less are not the same quantity


def parsed(records: DataFrame, *keep: str, payload: str = "payload") -> DataFrame:
    """Readable lines as maps of variants (``doc``) with the columns ``keep``. A line that is no JSON object is unreadable and left out."""
    doc = F.try_variant_get(F.try_parse_json(F.col(payload)), "$", "map<string,variant>")
    return records.select(*keep, doc.alias("doc")).where(F.col("doc").isNotNull())


def _leaves(name: Column, value: Column, place: Column | None, depth: int) -> Column:
    """The leaves under one value as an array of (name, shape, text, place); ``shape`` is the type of the variant."""
    at = [] if place is None else [place.alias("place")]
    shape = F.schema_of_variant(value).alias("shape")
    leaf = F.array(F.struct(name.alias("name"), shape, F.try_variant_get(value, "$", "string").alias("text"), *at))
    if depth == 0:
        return leaf
    members = F.map_entries(F.try_variant_get(value, "$", "map<string,variant>"))
    elements = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda v: F.struct(F.lit(None).cast("string").alias("key"), v.alias("value")))
    inside = F.coalesce(members, elements)

    def below(entry: Column, i: Column) -> Column:
        longer = F.when(entry["key"].isNull(), name).otherwise(F.concat_ws(".", name, entry["key"]))
        return _leaves(longer, entry["value"], None if place is None else F.concat(place, F.array(i)), depth - 1)

    return F.when(F.size(inside) > 0, F.flatten(F.transform(inside, below))).otherwise(leaf)


def fields(docs: DataFrame, depth: int, places: bool = False) -> DataFrame:
    """One row per leaf field of each document: ``name`` (dotted), ``kind`` (null for a JSON null), ``num``, ``text``.

    The elements of an array stand under its name; an empty array or object is a leaf of kind "other". JVM only: the
    leaves of a document are gathered in one nested expression, and one generator makes rows of them. With ``places`` there
    is also ``place``, the positions that lead to the leaf.
    """
    other = [c for c in docs.columns if c != "doc"]
    start = lambda i: F.array(i) if places else None
    every = F.flatten(F.transform(F.map_entries("doc"), lambda e, i: _leaves(e["key"], e["value"], start(i), depth - 1)))
    rows = docs.select(*other, F.explode(every).alias("leaf")).select(*other, "leaf.*")
    shape, text = F.col("shape"), F.col("text")
    compound = shape.startswith("OBJECT") | shape.startswith("ARRAY")
    kind = (
        F.when(shape == "STRING", "string").when(shape == "BOOLEAN", "boolean").when(compound, "other").when(shape != "VOID", "number")
    )
    num = F.when(shape == "BOOLEAN", (text == "true").cast("double")).when(~compound & (shape != "VOID"), text.try_cast("double"))
    return rows.select(*other, "name", kind.alias("kind"), num.alias("num"), F.when(shape != "VOID", text).alias("text"), *(["place"] if places else []))


def profiles(leaves: DataFrame, *by: str) -> DataFrame:
    """Fixed-size profile per ``by`` and field: counts per kind, quartiles, and sketches of the values and of their shapes.

    The value sketch keeps the smallest hash in each of ``CELLS`` cells (one-permutation minhash): a set of few values
    is nearly kept whole, so that overlap and containment of categories can be told from ten lines. Only texts are
    sketched; numbers are told apart by their quartiles.
    """
    num = F.when(~F.isnan("num"), F.col("num"))
    word = F.when((F.col("kind") == "string") & num.isNull(), F.col("text"))
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(word, "[0-9]", "9"), r"\p{Lu}", "A"), r"\p{Ll}", "a")
    hashed = F.when(word.isNotNull(), F.xxhash64(word))
    cells = [F.min(F.when(F.col("cell") == i, F.col("hash"))) for i in range(CELLS)]
    mins = [F.min(F.when(F.col("shape").isNotNull(), F.xxhash64(F.lit(i), F.col("shape")))) for i in range(SHAPES)]
    return (
        leaves.withColumns({"shape": shape, "num": num, "hash": hashed}).withColumn("cell", F.pmod("hash", F.lit(CELLS)))
        .groupBy(*by, "name")
        .agg(
            *[F.count_if(F.col("kind") == k).alias(k) for k in KINDS],
            F.count("num").alias("n_num"),
            F.count_if(F.col("num") == F.floor("num")).alias("n_int"),
            F.percentile_approx("num", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 200).alias("quartiles"),
            F.min("num").alias("low"),
            F.max("num").alias("high"),
            F.count_if((F.col("kind") == "string") & F.col("num").isNull()).alias("n_text"),
            F.approx_count_distinct("text").alias("distinct"),
            F.array_compact(F.array(*cells)).alias("values"),
            F.array(*mins).alias("shapes"),
        )
    )


def main_kind(prefix: str = "") -> Column:
    """The kind of most non-null values; null if there is none. Ties: number, string, boolean, other."""
    best = F.greatest(*[F.col(f"{prefix}{k}") for k in KINDS])
    out = F.when(best == 0, F.lit(None))
    for k in KINDS:
        out = out.when(F.col(f"{prefix}{k}") == best, k)
    return out


# --- matching ------------------------------------------------------------------------------------------------------


def name_tokens(name: str) -> list[str]:
    leaf = name.rsplit(".", 1)[-1]
    return [t.lower() for t in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]|[^\W\d_]+", leaf)]


def name_similarity(a: str, b: str) -> float:
    """Share of tokens of the last part of the names that agree; a token agrees with its own beginning of three or more letters."""
    if a.rsplit(".", 1)[-1] == b.rsplit(".", 1)[-1]:
        return 1.0
    x, y = name_tokens(a), name_tokens(b)
    if not x or not y:
        return 0.0
    free, hits = list(y), 0.0
    for t in x:
        hit = next((u for u in free if u == t), None) or next(
            (u for u in free if min(len(t), len(u)) >= 3 and (u.startswith(t) or t.startswith(u))), None
        )
        if hit is not None:
            free.remove(hit)
            hits += 1
    return hits / (len(x) + len(y) - hits)


def value_similarity(p: dict, q: dict) -> float:
    """Agreement of two profiles between 0 and 1; 0.3 if one of them has no values."""
    n, m = (sum(int(x[k]) for k in KINDS) for x in (p, q))
    if n == 0 or m == 0:
        return 0.3
    if (p["boolean"] * 2 > n) != (q["boolean"] * 2 > m):
        return 0.0
    if p["boolean"] * 2 > n:
        return 0.6
    if p["n_num"] * 2 > n and q["n_num"] * 2 > m:
        return _numeric(p, q)
    if p["n_text"] * 2 > n and q["n_text"] * 2 > m:
        a, b = set(p["values"]), set(q["values"])
        common = len(a & b)
        sets = 0.5 * common / len(a | b) + 0.5 * common / min(len(a), len(b))
        shapes = np.mean(np.asarray(p["shapes"]) == np.asarray(q["shapes"]))
        many = min(p["distinct"] / n, q["distinct"] / m) > 0.5
        return float(max(sets, 0.8 * shapes if many else 0.0))
    return 0.1  # numbers against text: codes may replace words


def _numeric(p: dict, q: dict) -> float:
    (a1, a2, a3), (b1, b2, b3) = p["quartiles"], q["quartiles"]
    whole = abs(p["n_int"] / p["n_num"] - q["n_int"] / q["n_num"])
    if (a2 < 0) != (b2 < 0) and min(abs(a2), abs(b2)) > 1e-9:
        return 0.0
    size = max(abs(a2), abs(b2), 1e-9)
    s1, s2 = (a3 - a1) + 0.002 * size, (b3 - b1) + 0.002 * size
    centre = abs(a2 - b2) / (np.sqrt(s1 * s2) + 0.1 * size)
    if whole == 0 and p["n_int"] and max(p["distinct"], q["distinct"]) <= 2 and 0 < max(a2, b2) <= 4 * min(a2, b2):
        return max(0.4, float(np.exp(-0.7 * centre)))  # version numbers and the like: constants that step
    return float(np.exp(-0.7 * centre) * np.exp(-0.25 * max(0.0, abs(np.log(s1 / s2)) - 0.7)) * (1 - 0.7 * whole))


def assign(gain: np.ndarray) -> list[tuple[int, int]]:
    """Maximum-weight bipartite matching by shortest augmenting paths; pairs of gain <= 0 stay unmatched."""
    n, m = gain.shape
    size = n + m  # each row may take a worthless column of its own
    cost = np.zeros((n, size))
    cost[:, :m] = -np.maximum(gain, 0.0)
    u, v, owner = np.zeros(n), np.zeros(size), np.full(size, -1)
    for row in range(n):
        dist, done, back = np.full(size, np.inf), np.zeros(size, bool), np.full(size, -1)
        i, j, base = row, -1, 0.0
        while True:
            reach = base + cost[i] - u[i] - v
            closer = ~done & (reach < dist - 1e-12)
            dist[closer], back[closer] = reach[closer], j
            j = int(np.argmin(np.where(done, np.inf, dist)))
            base, done[j] = dist[j], True
            if owner[j] < 0:
                break
            i = owner[j]
        inside = np.flatnonzero(done & (owner >= 0))
        u[row] += base
        u[owner[inside]] += base - dist[inside]
        v[done] -= base - dist[done]
        while j >= 0:
            prior = int(back[j])
            owner[j] = owner[prior] if prior >= 0 else row
            j = prior
    return sorted((int(owner[j]), j) for j in range(m) if owner[j] >= 0 and gain[owner[j], j] > 0)


def _match(rules: DriftRules):
    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for file, gone, come in zip(batch["file"], batch["gone"], batch["come"], strict=True):
                gone, come = (sorted(({k: x[k] for k in _PROFILE} for x in side), key=lambda x: x["name"]) for side in (gone, come))
                gain = np.array(
                    [
                        [
                            rules.name_weight * name_similarity(p["name"], q["name"])
                            + (1 - rules.name_weight) * value_similarity(p, q)
                            - rules.accept
                            for q in come
                        ]
                        for p in gone
                    ]
                )
                out += [(file, gone[i]["name"], come[j]["name"]) for i, j in assign(gain)]
            yield pd.DataFrame(out, columns=["file", "old_name", "new_name"])

    return match


_PROFILE = ("name", *KINDS, "n_num", "n_int", "quartiles", "n_text", "distinct", "values", "shapes")


def file_order(files: DataFrame) -> DataFrame:
    """``file`` and ``previous``: the feed's preceding existing file by month (ties: the smaller file id first)."""
    w = Window.partitionBy("feed_id").orderBy("period_month", "file_id")
    return files.select(F.col("file_id").alias("file"), "feed_id", F.row_number().over(w).alias("ordinal"), F.lag("file_id").over(w).alias("previous"))


def schema_changes(records: DataFrame, files: DataFrame, rules: DriftRules = DriftRules()) -> DataFrame:
    """Every change of a file against the preceding file of its feed.

    Columns: ``file_id``, ``change_kind`` (added, removed, renamed, retyped), ``field_name`` (the old name of a removed
    field, else the new one), ``old_name`` (of a renamed field), ``old_kind``, ``new_kind``.

    Fields are profiled per file with partial aggregation: counts of JSON types, quartiles, minhash sketches of values
    and shapes. Fields that end and fields that begin in the same file are the two sides of a bipartite matching by
    type, value and name similarity (per file, as many as its schema has fields); matched pairs are renamed.

    A field is present if a readable line carries it, even as null. A file without a readable line has no fields. The
    first file of a feed has no changes. Fields without non-null values on either side are not retyped. Records of
    unknown files are ignored.
    """
    return _changes(_profiled(records, rules), files, rules)


def _profiled(records: DataFrame, rules: DriftRules) -> DataFrame:
    shipped(records.sparkSession)
    docs = parsed(records, F.col("file_id").alias("file"))
    return written(profiles(fields(docs, rules.depth), "file").withColumn("main", main_kind()), "profiles")


def _changes(rows: DataFrame, files: DataFrame, rules: DriftRules) -> DataFrame:
    order = file_order(files).select("file", "previous")
    profile = F.struct(*_PROFILE, "main")
    now = rows.join(order.where("previous is not null").select("file"), "file").select("file", "name", profile.alias("now"))
    old = (
        order.where("previous is not null").withColumnRenamed("file", "next").withColumnRenamed("previous", "file").join(rows, "file")
        .select(F.col("next").alias("file"), "name", profile.alias("old"))
    )
    both = now.join(old, ["file", "name"], "full_outer")
    kept = both.where("now is not null and old is not null and now.main <> old.main")
    retyped = kept.select("file", F.lit("retyped").alias("change_kind"), F.col("name").alias("field_name"), F.lit(None).cast("string").alias("old_name"), F.col("old.main").alias("old_kind"), F.col("now.main").alias("new_kind"))
    moved = both.where("now is null or old is null").groupBy("file").agg(
        F.collect_list("old").alias("gone"), F.collect_list("now").alias("come")
    )
    pairs = moved.where((F.size("gone") > 0) & (F.size("come") > 0)).mapInPandas(
        _match(rules), "file bigint, old_name string, new_name string"
    )
    renames = pairs.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("new_name", "old_name"))).alias("renames"))
    settled = written(
        moved.join(renames, "file", "left").withColumn("renames", F.coalesce("renames", F.create_map().cast("map<string,string>"))), "changes"
    )

    def side(column: str, kind: str, taken: Column) -> DataFrame:
        rest = settled.select("file", F.explode(F.filter(column, lambda x: ~F.array_contains(taken, x["name"]))).alias("x"))
        ends = {"added": (F.lit(None), F.col("x.main")), "removed": (F.col("x.main"), F.lit(None))}[kind]
        return rest.select("file", F.lit(kind).alias("change_kind"), F.col("x.name").alias("field_name"), F.lit(None).cast("string").alias("old_name"), ends[0].cast("string").alias("old_kind"), ends[1].cast("string").alias("new_kind"))

    kind_of = lambda c, name: F.filter(c, lambda x: x["name"] == F.col(name))[0]["main"]
    renamed = settled.select("file", "gone", "come", F.explode("renames").alias("new_name", "old_name")).select(
        "file", F.lit("renamed").alias("change_kind"), F.col("new_name").alias("field_name"), "old_name",
        kind_of("gone", "old_name").alias("old_kind"), kind_of("come", "new_name").alias("new_kind"),
    )
    out = side("come", "added", F.map_keys("renames")).unionByName(side("gone", "removed", F.map_values("renames"))).unionByName(renamed).unionByName(retyped)
    return out.withColumnRenamed("file", "file_id")


# --- one table -----------------------------------------------------------------------------------------------------

TARGET = {
    "schema_version": "int", "machine_id": "string", "meter_id": "string", "seq": "bigint", "ts_source": "timestamp",
    "ts_edge": "timestamp", "state": "string", "job_id": "string", "l1_a": "double", "l2_a": "double", "l3_a": "double",
    "voltage_v": "double", "power_kw": "double", "energy_kwh_total": "double", "opc_status": "string", "power_factor": "double",
}


def _lineages(feed: pd.DataFrame) -> pd.DataFrame:
    """The quantity each piece of a feed's names belongs to: of a piece that begins with a rename, that of the old name's piece before it."""
    out, pieces = [], {}
    for feed_id, name, begins, old in feed.sort_values(["begins", "name"])[["feed_id", "name", "begins", "old_name"]].itertuples(index=False):
        earlier = [lineage for at, lineage in pieces.get(old, ()) if at < begins]
        lineage = earlier[-1] if earlier else f"{feed_id}/{begins}:{old or name}"
        pieces.setdefault(name, []).append((begins, lineage))
        out.append((feed_id, name, begins, lineage))
    return pd.DataFrame(out, columns=["feed_id", "name", "begins", "lineage"])


def quantities(rows: DataFrame, files: DataFrame, renames: DataFrame) -> DataFrame:
    """``file``, ``name``, ``lineage`` for every field of every file in ``rows``; renames (``file, name, old_name``) are followed through a feed.

    A name is cut into pieces: one begins where it first appears and one where another name is renamed to it. Only the pieces of a
    feed, as many as its schema had names and renames, are resolved together; files take theirs by (feed, name).
    """
    order = file_order(files).select("file", "feed_id", "ordinal")
    here = rows.select("file", "name").join(order, "file")
    renamed = renames.join(order, "file").select("feed_id", "name", F.col("ordinal").alias("begins"), "old_name")
    firsts = here.groupBy("feed_id", "name").agg(F.min("ordinal").alias("begins"))
    plain = firsts.join(renamed, ["feed_id", "name", "begins"], "left_anti").withColumn("old_name", F.lit(None).cast("string"))
    schema = "feed_id string, name string, begins int, lineage string"
    pieces = renamed.unionByName(plain).groupBy("feed_id").applyInPandas(_lineages, schema)
    along = Window.partitionBy("feed_id", "name").orderBy("ordinal", F.col("file").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    both = here.unionByName(pieces.withColumnRenamed("begins", "ordinal"), allowMissingColumns=True)
    return both.withColumn("lineage", F.last("lineage", ignorenulls=True).over(along)).where("file is not null").select("file", "name", "lineage")


def unified_readings(records: DataFrame, files: DataFrame, rules: DriftRules = DriftRules(), target: dict[str, str] = TARGET) -> DataFrame:
    """All readable records as one table with the columns of ``target`` and ``extras`` (map of other fields to text).

    Renames are followed through each feed. A quantity takes the target column one of its names has; if none has, the
    target its name is most often renamed from or to in all feeds; else it stays in ``extras`` under its last name.
    Values are cast to the target type; what cannot be cast is null. Times may be ISO text or epoch milliseconds.
    Several values of one record and column (elements of an array, or fields that map to one column) stand in ``extras``
    as the text of a JSON array, in their order; a target column then also has the last of them in sort order of texts.
    Unreadable lines are left out, records of unknown files keep their names.
    """
    rows = _profiled(records, rules)
    renames = _changes(rows, files, rules).where("change_kind = 'renamed'").select(F.col("file_id").alias("file"), F.col("field_name").alias("name"), "old_name")
    members = written(quantities(rows, files, renames), "quantities")
    in_target = F.when(F.col("name").isin(*target), F.col("name"))
    named = members.groupBy("lineage", "name").agg(F.max("file").alias("last")).withColumn("hit", in_target)
    own = named.groupBy("lineage").agg(F.max("hit").alias("hit"), F.max_by("name", "last").alias("last_name"))
    votes = named.where("hit is null").select("lineage", "name").join(own.where("hit is not null"), "lineage").groupBy("name", "hit").count()
    voted = votes.groupBy("name").agg(F.max_by("hit", F.struct("count", "hit")).alias("voted"))
    column = members.join(own, "lineage").join(voted, "name", "left").select("file", "name", F.coalesce("hit", "voted", "last_name").alias("column"))
    maps = column.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("name", "column"))).alias("columns"))
    placed = salted_left_join(parsed(records, "record_id", F.col("file_id").alias("file")), maps, "file", "record_id")
    cells = fields(placed, rules.depth, places=True).withColumn("column", F.coalesce(F.try_element_at("columns", F.col("name")), F.col("name")))
    quoted = F.to_json(F.array("text"))
    json = F.when(F.col("text").isNull(), "null").when(F.col("kind") != "string", F.col("text")).otherwise(F.substring(quoted, F.lit(2), F.length(quoted) - 2))
    each = cells.groupBy("record_id", "file", "column").agg(
        F.max("text").alias("text"), F.count("text").alias("values"), F.sort_array(F.collect_list(F.struct("place", json.alias("json")))).alias("all")
    )
    several = F.concat(F.lit("["), F.array_join("all.json", ","), F.lit("]"))
    extra = F.struct("column", F.when(F.size("all") > 1, several).otherwise(F.col("text")).alias("text"))
    wide = each.groupBy("record_id", "file").agg(
        *[F.max(F.when(F.col("column") == c, F.col("text"))).alias(c) for c in target],
        F.map_from_entries(F.sort_array(F.collect_list(F.when(~F.col("column").isin(*target) | (F.col("values") > 1), extra)))).alias("extras"),
    )

    def cast(name: str, kind: str) -> Column:
        text = F.col(name)
        if kind == "timestamp":
            return F.coalesce(F.try_to_timestamp(text), F.timestamp_millis(text.try_cast("bigint"))).alias(name)
        return (text.try_cast("double").try_cast(kind) if kind in ("int", "bigint") else text.try_cast(kind)).alias(name)

    return wide.select("record_id", F.col("file").alias("file_id"), *[cast(c, k) for c, k in target.items()], "extras")
