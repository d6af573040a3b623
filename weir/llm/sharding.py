"""Sharding by a k-d tree over document metadata.

DataFrame and SQL functions only. A node that is to hold k shards is split at the
weighted quantile (k div 2) / k of its bytes, along the dimension in which its
documents lie widest, until every leaf holds one shard's bytes.

The quantiles are found with distributed histograms: a pass sums bytes by (node, bin) with a
map-side combine, keeps the bin that the quantile falls in and cuts it again until the bin weighs next to
nothing. All nodes of a level share the passes. Only the tree itself (one row for each
of its ``shards - 1`` splits) reaches the driver.

Dimensions are numbers that the text alone decides (its bytes, words, bytes a character, bytes a word), scaled to 0..1 over the table, plus a
fraction hashed from the text, so different texts of equal metadata are split like any others and equal texts stay together.
Only where a cut falls inside a group of equal texts and placing that group whole would move more than ``GROUP_SHARE`` of a
shard's bytes is the group itself cut, by a hash of its rows: a tree of n shards cuts at most n - 1 groups.

Defined results: null text weighs 8 bytes and counts as empty; null metadata lies below all values; rows equal in id and text are rows
of one group, numbered in any order; an empty table gives an empty result; ids and metadata may be any 64-bit numbers; a text of any length is one row;
other columns aren't read, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weir.llm._shared import durable, with_prefix, words_of

SHARDS = 24
ROW_BYTES = 8
BINS = 1024
PASSES = 5
TOLERANCE = 0.0005  #: a bin that weighs this share of a shard isn't cut again
GROUP_SHARE = 0.004  #: bytes, as a share of a shard, that a group kept whole may move over a cut


def metadata(docs: DataFrame) -> dict[str, Column]:
    """Dimensions of the documents table that a text decides: its length, words, bytes a character and bytes a word."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size, words = F.octet_length(text).cast("double"), words_of(text)
    return {
        "bytes": F.floor(F.log2(size + 1) * 1000),
        "words": F.floor(F.log2(words + F.lit(1.0)) * 1000),
        "script": F.floor(1000 * size / F.greatest(F.length(text), F.lit(1))),
        "word_bytes": F.floor(100 * F.least(size / F.greatest(words, F.lit(1)), F.lit(20.0))),
    }


def _lookup(values: dict[int, float], other: float) -> Column:
    """Value by node, as one small map literal."""
    if not values:
        return F.lit(other)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.col("node")), F.lit(other))


def _leaf(tree: dict[int, tuple], depth: int) -> Column:
    """The node a row falls to by the splits made so far: a fold down the tree, so the expression stays short.

    A split is (dimension, low, high, u): right from ``high`` on, and between ``low`` and ``high`` from ``u`` on by the row's own hash.
    """
    if not tree:
        return F.lit(1)
    maps = [F.create_map(*[F.lit(x) for n, split in tree.items() for x in (n, split[i] + (i == 0))]) for i in range(4)]

    def down(node, _):
        at, low, high, u = (F.try_element_at(m, node) for m in maps)
        x = F.try_element_at(F.col("xs"), at)
        right = ((x >= high) | (x >= low) & (F.col("u") >= u)).cast("int")
        return F.when(at.isNull(), node).otherwise(node * 2 + right)

    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(1), down)


def grow_tree(rows: DataFrame, dims: int, shards: int) -> tuple[dict, dict[int, int], int]:
    """(splits by node, shard number of each leaf, depth) for rows with ``weight``, ``xs``, an array of dimensions in 0..1, and ``u``, a hash in 0..1."""
    tree: dict[int, tuple] = {}
    leaves, depth = {1: shards}, 0
    while any(k > 1 for k in leaves.values()):
        at = rows.select("weight", "xs", "u", _leaf(tree, depth).alias("node"))
        open_nodes = [n for n, k in leaves.items() if k > 1]
        every = [f(F.col("xs")[d]).alias(f"{f.__name__}{d}") for d in range(dims) for f in (F.min, F.max)]
        stats = at.groupBy("node").agg(F.sum("weight").alias("w"), *every).where(F.col("node").isin(open_nodes)).collect()
        found: dict[int, dict] = {}
        for r in stats:
            dim = max(range(dims), key=lambda d: (r[f"max{d}"] - r[f"min{d}"], -d))
            k, lo, hi = leaves[r["node"]], r[f"min{dim}"], r[f"max{dim}"]
            share = r["w"] / k
            found[r["node"]] = {"dim": dim, "lo": lo, "width": (hi - lo) * (1 + 1e-9) / BINS + 1e-300, "want": r["w"] * (k // 2) / k, "before": 0.0, "least": TOLERANCE * share, "move": GROUP_SHARE * share, "rows": False, "x": (0.0, 0.0)}
        todo, turns = dict(found), 0
        while todo and turns < 2 * PASSES:
            turns += 1
            by = lambda f: {n: f(p) for n, p in todo.items()}
            x = F.col("xs")[_lookup(by(lambda p: p["dim"]), 0)]
            whole = _lookup(by(lambda p: int(not p["rows"])), 1) == 1
            value = F.when(whole, x).otherwise(F.col("u"))
            inside = whole | (x >= _lookup(by(lambda p: p["x"][0]), 0.0)) & (x < _lookup(by(lambda p: p["x"][1]), 0.0))
            place = (value - _lookup(by(lambda p: p["lo"]), 0.0)) / _lookup(by(lambda p: p["width"]), 1.0)
            bins = at.where(inside).select("node", "weight", value.alias("v"), F.floor(place).cast("long").alias("bin")).groupBy("node", "bin").agg(F.sum("weight").alias("b"), F.min("v").alias("lo"), F.max("v").alias("hi"))
            bins = bins.where(F.col("node").isin(list(todo)) & (F.col("bin") >= 0) & (F.col("bin") < BINS))
            run = F.sum("b").over(W.partitionBy("node").orderBy("bin"))
            want = _lookup(by(lambda p: p["want"] - p["before"]), 0.0)
            cut = bins.withColumn("upto", run).where(F.col("upto") >= want).groupBy("node").agg(F.min(F.struct("bin", "b", "upto", "lo", "hi")).alias("m"))
            met = {r["node"]: r["m"] for r in cut.collect()}
            for n, p in list(todo.items()):
                if n not in met:  # rounding put the quantile beyond the last bin
                    del todo[n]
                    continue
                m = met[n]
                low, high = p["before"] + m["upto"] - m["b"], p["before"] + m["upto"]
                edge, end = m["lo"], math.nextafter(m["hi"], math.inf)
                split = edge if p["want"] - low <= high - p["want"] else end
                p["split"] = (p["dim"], *p["x"], split) if p["rows"] else (p["dim"], split, split, 0.0)
                p["turn"] = p.get("turn", 0) + 1
                if m["b"] > p["least"] and m["hi"] > m["lo"] and p["turn"] < PASSES:
                    p |= {"lo": edge, "width": (m["hi"] - m["lo"]) * (1 + 1e-9) / BINS + 1e-300, "before": low}
                elif not p["rows"] and min(p["want"] - low, high - p["want"]) > p["move"]:
                    p |= {"rows": True, "x": (edge, end), "lo": 0.0, "width": 1 / BINS, "before": low, "turn": 0}
                else:
                    del todo[n]
        grown = {}
        for n, k in leaves.items():
            if k == 1:
                grown[n] = 1
                continue
            p = found.get(n, {"dim": 0, "lo": 0.0})
            tree[n] = p.get("split", (p["dim"], float(p["lo"]), float(p["lo"]), 0.0))
            grown |= {2 * n: k // 2, 2 * n + 1: k - k // 2}
        leaves, depth = grown, depth + 1
    return tree, {n: i for i, n in enumerate(sorted(leaves, key=lambda n: bin(n)[2:]))}, depth


def _fraction(*parts: Column | str) -> Column:
    return F.xxhash64(*parts).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))


def scaled_rows(docs: DataFrame, dims: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, h, weight, xs and u of every document."""
    dims = dims or metadata(docs)
    text = F.col("text").cast("string")
    names = [f"__v{i}" for i in range(len(dims))]
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64("doc_id", "text").alias("h"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("g"),
        *[c.cast("double").alias(n) for n, c in zip(names, dims.values())],
    )
    base = durable(base)
    ends = base.agg(*[F.min(n).alias(f"lo{n}") for n in names], *[F.max(n).alias(f"hi{n}") for n in names]).first()
    scaled = []
    for i, n in enumerate(names):
        lo, hi = ends[f"lo{n}"] or 0.0, ends[f"hi{n}"] or 0.0
        scaled.append((F.coalesce(F.col(n) - F.lit(lo) + 1, F.lit(0.0)) + _fraction(F.lit(i), "g")) / F.lit(float(hi - lo + 2)))
    # rows equal in all that counts are told apart by their place, in the last bits only
    own = F.floor(_fraction(F.lit(-1), "h") * F.lit(float(1 << 40))) / F.lit(float(1 << 40)) + _fraction(F.monotonically_increasing_id()) / F.lit(float(1 << 40))
    return durable(base.select("doc_id", "size", "text_crc32", "h", F.col("size").alias("weight"), F.array(*scaled).alias("xs"), own.alias("u")))


def kd_shards(docs: DataFrame, shards: int = SHARDS, dims: dict[str, Column] | None = None) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard and its gapless slot in the shard.

    ``dims``: other numeric dimensions by name; equal texts stay together only as far as their dimensions are equal.
    """
    rows = scaled_rows(docs, dims)
    tree, shard_of, depth = grow_tree(rows, len(dims or metadata(docs)), shards)
    shard = F.element_at(F.create_map(*[F.lit(x) for pair in shard_of.items() for x in pair]), _leaf(tree, depth))
    placed = durable(rows.select("doc_id", "size", "text_crc32", "h", shard.cast("int").alias("shard")))
    return with_prefix(placed, ["shard"], F.shiftrightunsigned("h", 20), [F.col("h"), F.col("doc_id"), F.col("size")], F.lit(1).cast("long"), "slot")


def query(spark, sf_dir: str) -> DataFrame:
    """op6: shard and slot of every document under the law of equal bytes."""
    from weir.session import table

    out = kd_shards(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
