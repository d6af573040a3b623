"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

DataFrame and SQL functions only.

1. Every source's documents are laid end to end in a hashed order and cut into blocks of equal word
   counts (or of about equal counts, whole documents each). Running word counts come from bucket sums, so a source that holds a third of all rows is spread over many tasks.
2. Targets fill up like water: sources share all words by weight, none above ``cap`` times
   its size. Solved in closed form over the sources sorted by size / weight.
3. A target is a number of whole passes over its source and a rest. The passes take all blocks, the rest some of them; both are
   exact block quotas. A binary tree deals the quotas out to the output shards: each node draws its left
   child's counts from the multivariate hypergeometric distribution, one quota after the other, by inverting
   the exact distribution at a hashed uniform number. A second tree deals the blocks that the rests leave over, so
   that each shard has a pool of its own to draw from.
4. Blocks are permuted at random (hashed keys) and shards own disjoint ranges of the permutations. A shard draws its quota
   of a rest from its pool in an order of its own; the drawn blocks, taken by turns from all shards, are what the mix takes of the
   rest, to the word. So another seed or another tree takes other documents, and targets stay exact.
   ``mix_pieces`` gives a shard's pieces in a local shuffled order, ``mixed_documents`` its documents.

The trees work on one row with an array of two numbers a source. More than ``MOST_SOURCES`` sources raise an error
(one row a source and block is also broadcast); documents are unbounded.

Defined results: null text has no words, is never drawn and keeps its row with ``taken`` 0; a null source is
a source of its own, last in order; repeated rows each count; a table without words gives targets of 0; an empty
table gives an empty result. Columns with clashing names are carried along only by ``mixed_documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weir.llm._shared import durable, null_safe, with_prefix, words_of

WEIGHTS = (1, 2, 3)
CAP = 3
SHARDS = 16
BLOCKS = 2048
SEED = 20240917
MOST_SOURCES = 20_000


def targets(sources: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size) -> also rank, weight and target words."""
    every, ranked = W.partitionBy(), W.partitionBy().orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int"))
    rows = sources.withColumn("rank", F.row_number().over(ranked) - 1).withColumn("weight", w)
    rows = rows.withColumn("most", F.lit(float(cap)) * F.col("source_size")).withColumn("all_words", F.sum("source_size").over(every))
    filled = W.partitionBy().orderBy(F.col("most") / F.col("weight"), "rank")
    rows = rows.withColumn("at", F.row_number().over(filled))
    rows = rows.withColumn("full", F.coalesce(F.sum("most").over(filled.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    rows = rows.withColumn("open", F.sum("weight").over(filled.rowsBetween(0, W.unboundedFollowing)))
    rows = rows.withColumn("level", (F.col("all_words") - F.col("full")) / F.col("open"))
    rows = rows.withColumn("first_open", F.min(F.when(F.col("weight") * F.col("level") <= F.col("most"), F.struct("at", "level"))).over(every))
    share = F.when(F.col("at") < F.col("first_open.at"), F.col("most")).otherwise(F.col("weight") * F.col("first_open.level"))
    return rows.select("source", "source_size", "rank", "weight", F.least(share, F.col("most")).alias("target"), "all_words")


#: How many of ``x.d`` draws without replacement from ``x.n`` blocks, ``x.m`` of them marked, are marked: exact inversion at ``x.u``.
_DRAW = """
transform(array(x), x -> named_struct('x', x,
  'lo', greatest(0L, x.d - (x.n - x.m)),
  'hi', least(x.m, x.d)))[0]
"""
_ODDS = """
transform(array({bounds}), y -> named_struct('y', y, 'w',
  aggregate(if(y.hi > y.lo, sequence(y.lo + 1, y.hi), cast(array() as array<bigint>)), array(0.0D),
    (a, k) -> concat(a, array(element_at(a, -1)
      + ln(cast(y.x.m - k + 1 as double)) + ln(cast(y.x.d - k + 1 as double))
      - ln(cast(k as double)) - ln(cast(y.x.n - y.x.m - y.x.d + k as double)))))))[0]
"""
_SHARE = """
transform(transform(array({odds}), z -> named_struct('y', z.y, 'w', z.w, 'm', array_max(z.w))),
  z -> named_struct('y', z.y, 'e', transform(z.w, v -> exp(v - z.m))))[0]
"""
_PICK = """
transform(transform(array({share}), z -> named_struct('y', z.y, 'e', z.e, 't', z.y.x.u * aggregate(z.e, 0.0D, (s, q) -> s + q))),
  z -> z.y.lo + least(z.y.hi - z.y.lo,
  aggregate(z.e, named_struct('c', 0.0D, 'j', 0L),
    (a, v) -> named_struct('c', a.c + v, 'j', a.j + if(a.c + v < z.t, 1L, 0L))).j))[0]
"""


def _draw(struct: str) -> str:
    """SQL for one hypergeometric draw; struct holds m, n, d and u."""
    bounds = f"transform(array({struct}), x -> {_DRAW.strip()})[0]"
    return _PICK.format(share=_SHARE.format(odds=_ODDS.format(bounds=bounds)))


def split_tree(root: DataFrame, levels: int, seed: int = SEED) -> DataFrame:
    """(counts array<bigint>) in one row -> (shard, counts) in ``2 ** levels`` rows.

    A node's blocks are halved; an odd block goes to the right child.
    """
    nodes = root.select(F.lit(0).alias("shard"), "counts")
    for level in range(levels):
        one = _draw(
            "named_struct('m', counts[i], 'n', acc.n, 'd', acc.d, "
            f"'u', ((xxhash64({seed}L, {level}, shard, i) & 9007199254740991L) + 0.5D) / 9007199254740992D)"
        )
        left = f"""
            aggregate(if(size(counts) > 0, sequence(0, size(counts) - 1), cast(array() as array<int>)),
              named_struct('d', aggregate(counts, 0L, (a, v) -> a + v) div 2, 'n', aggregate(counts, 0L, (a, v) -> a + v), 'out', cast(array() as array<bigint>)),
              (acc, i) -> transform(array({one}), k -> named_struct('d', acc.d - k, 'n', acc.n - counts[i], 'out', concat(acc.out, array(k))))[0]
            ).out"""
        nodes = nodes.withColumn("left", F.expr(left)).select(
            F.explode(
                F.array(
                    F.struct((F.col("shard") * 2).alias("shard"), F.col("left").alias("counts")),
                    F.struct((F.col("shard") * 2 + 1).alias("shard"), F.expr("zip_with(counts, left, (a, b) -> a - b)").alias("counts")),
                )
            ).alias("n")
        ).select("n.shard", "n.counts")
    return nodes


def _ranges(tree: DataFrame, n: str = "c") -> DataFrame:
    """(shard, slot, counts) -> the range [lo, hi) of each slot's permutation that a shard owns."""
    upto = F.sum(n).over(W.partitionBy("slot").orderBy("shard"))
    return tree.withColumn("hi", upto).withColumn("lo", F.col("hi") - F.col(n))


def draw_blocks(plan: DataFrame, blocks: DataFrame, shards: int, seed: int) -> DataFrame:
    """What the tree and the shards' draws make of each block: (rank, block, begin, shards, rest_shard, before).

    ``plan``: rank, passes, rest (words) and source_size; ``blocks``: rank, block, words and begin (its first word's place). ``shards`` holds the shard of each whole pass; ``before`` is the number of words that the rest takes ahead of this block.
    """
    counts = blocks.groupBy("rank").agg(F.count(F.lit(1)).alias("blocks"))
    sized = plan.join(counts, "rank", "left").withColumn("blocks", F.coalesce("blocks", F.lit(0)))
    sized = sized.withColumn("want", F.when(F.col("source_size") > 0, F.least("blocks", F.ceil(F.col("rest") / F.col("source_size") * F.col("blocks")))).otherwise(0).cast("long"))
    sized = durable(sized)
    by_rank = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("rank", c.alias("v")))), lambda x: x["v"])
    quotas = sized.agg(F.concat(by_rank(F.col("passes") * F.col("blocks")), by_rank(F.col("want"))).alias("counts"))
    spare = sized.agg(by_rank(F.col("blocks") - F.col("want")).alias("counts"))
    levels = shards.bit_length() - 1
    n = sized.count()
    dealt = split_tree(quotas, levels, seed).select("shard", F.posexplode("counts").alias("slot", "c"))
    spared = split_tree(spare, levels, seed + 1).select("shard", F.posexplode("counts").alias("slot", "s"))
    dealt, spared = durable(dealt), durable(spared)

    # whole passes: a shard owns a range of the permuted (pass, block) pairs of a source
    passes = blocks.join(sized.where("passes > 0").select("rank", "passes"), "rank").select("rank", "block", F.explode(F.sequence(F.lit(0), (F.col("passes") - 1).cast("int"))).alias("turn"))
    place = F.row_number().over(W.partitionBy("rank").orderBy(F.xxhash64(F.lit(seed), F.lit(0), "rank", "turn", "block"), "turn", "block")) - 1
    owned = _ranges(dealt.where(F.col("slot") < n)).where("c > 0").select(F.col("slot").alias("rank"), "shard", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("place"))
    taken = passes.withColumn("place", place.cast("long")).join(owned, ["rank", "place"])
    taken = taken.groupBy("rank", "block").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "shard"))), lambda x: x["shard"]).alias("shards"))

    # the rest: a shard's pool is a range of the permuted blocks, and it draws its quota from the pool in an order of its own
    pools = dealt.where(F.col("slot") >= n).select("shard", (F.col("slot") - n).alias("slot"), "c").join(spared, ["shard", "slot"]).withColumn("p", F.col("c") + F.col("s"))
    pools = _ranges(pools, "p").where("p > 0").select(F.col("slot").alias("rank"), F.col("shard").alias("rest_shard"), "c", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("place"))
    place = F.row_number().over(W.partitionBy("rank").orderBy(F.xxhash64(F.lit(seed), F.lit(1), "rank", "block"), "block")) - 1
    drawn = blocks.withColumn("place", place.cast("long")).join(pools, ["rank", "place"])
    own = F.row_number().over(W.partitionBy("rank", "rest_shard").orderBy(F.xxhash64(F.lit(seed), F.lit(2), "rank", "rest_shard", "block"), "block"))
    turns = W.partitionBy("rank").orderBy((F.col("own") > F.col("c")).cast("int"), "own", "rest_shard").rowsBetween(W.unboundedPreceding, -1)
    drawn = drawn.withColumn("own", own).withColumn("before", F.coalesce(F.sum("words").over(turns), F.lit(0)))
    drawn = drawn.select("rank", "block", "begin", "rest_shard", "before").join(taken, ["rank", "block"], "left")
    return drawn.select("rank", "block", "begin", F.coalesce("shards", F.array().cast("array<int>")).alias("shards"), "rest_shard", "before")


def mix(docs: DataFrame, shards: int = SHARDS, blocks: int = BLOCKS, weights=WEIGHTS, cap: int = CAP, seed: int = SEED, whole: bool = False) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken and its ``pieces``.

    A piece is a run of the document's words, ``first`` to ``last`` (exclusive), in pass ``turn``
    over its source, in block ``block``, drawn by shard ``shard``. Blocks are of equal word counts, so a document may lie in several;
    with ``whole``, a document lies in the block that it starts in.
    ``shards`` is a power of two.
    """
    if 1 << shards.bit_length() - 1 != shards:
        raise ValueError("shards must be a power of two")
    size = words_of(F.col("text").cast("string"))
    base = durable(docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("h")))
    sums = durable(base.groupBy("source").agg(F.sum("size").alias("source_size")))
    if sums.count() > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources; group them before mixing")
    plan = targets(sums, weights, cap).withColumn("quota", F.least(F.round("target").cast("long"), F.col("source_size") * cap))
    plan = plan.withColumn("passes", F.expr("if(source_size > 0, quota div source_size, 0L)"))
    plan = plan.withColumn("rest", F.col("quota") - F.col("passes") * F.col("source_size"))
    # a source has as many blocks as its share of the words asks for, all but the last of one length
    most = F.greatest(F.lit(1), F.ceil(F.col("all_words") / blocks))
    plan = plan.withColumn("block_words", F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.greatest(F.lit(1), F.ceil(F.col("source_size") / most)))).cast("long"))
    plan = durable(plan.select(F.col("source").alias("of"), "source_size", "target", F.col("rank").cast("int").alias("rank"), "passes", "rest", "block_words"))

    placed = with_prefix(base, ["source"], F.shiftrightunsigned("h", 20), [F.col("h"), F.col("doc_id"), F.col("size")], F.col("size"), "start")
    rows = placed.join(F.broadcast(plan), null_safe([(F.col("source"), F.col("of"))]))
    rows = durable(rows.drop("of"))
    some = rows.where("size > 0")
    if whole:
        span = "array(named_struct('block', start div block_words, 'first', 0L, 'last', size))"
    else:
        span = """transform(sequence(start div block_words, (start + size - 1) div block_words), b -> named_struct('block', b,
            'first', greatest(b * block_words - start, 0L), 'last', least((b + 1) * block_words - start, size)))"""
    some = some.select("doc_id", "h", "size", "start", "rank", "passes", "rest", F.explode(F.expr(span)).alias("at"))
    some = some.select("*", "at.*").drop("at")
    cut = some.groupBy("rank", "block").agg(F.sum(F.col("last") - F.col("first")).alias("words"), F.min(F.col("start") + F.col("first")).alias("begin"))
    drawn = draw_blocks(plan.select("rank", "passes", "rest", "source_size"), durable(cut), shards, seed)
    # at most a row a block and one more a source
    some = some.join(F.broadcast(drawn), ["rank", "block"])
    some = some.withColumn("left", F.greatest(F.lit(0), F.least(F.col("last") - F.col("first"), F.col("rest") - F.col("before") - (F.col("start") + F.col("first") - F.col("begin")))))
    piece = "named_struct('turn', {}, 'block', block, 'shard', {}, 'first', first, 'last', {})"
    pieces = f"concat(transform(shards, (s, turn) -> {piece.format('turn', 's', 'last')}), filter(array({piece.format('cast(passes as int)', 'rest_shard', 'first + left')}), x -> left > 0))"
    # the start of a document with words is its own in its source
    taken = some.groupBy("rank", "start").agg(F.array_sort(F.flatten(F.collect_list(F.expr(pieces)))).alias("pieces")).withColumnsRenamed({"rank": "of_rank", "start": "of_start"})
    rows = rows.join(taken, (F.col("rank") == F.col("of_rank")) & (F.col("start") == F.col("of_start")) & (F.col("size") > 0), "left")
    rows = rows.withColumn("pieces", F.coalesce("pieces", F.expr("cast(array() as array<struct<turn:int,block:bigint,shard:int,first:bigint,last:bigint>>)")))
    return rows.select("doc_id", "source", "size", "source_size", "target", F.expr("aggregate(pieces, 0L, (a, p) -> a + p.last - p.first)").alias("taken"), "pieces", "h")


def _shuffled(rows: DataFrame, seed: int, *key: str) -> DataFrame:
    """Rows of a shard together (spread over 64 tasks each), in a hashed order inside it."""
    rows = rows.withColumn("__at", F.xxhash64(F.lit(seed + 2), *key))
    return rows.repartition("__shard", F.pmod(F.shiftrightunsigned("__at", 48), F.lit(64))).sortWithinPartitions("__shard", "__at").drop("__at")


def mix_pieces(mixed: DataFrame, seed: int = SEED) -> DataFrame:
    """One row per drawn piece, a shard's rows together and shuffled inside it by a hashed key."""
    rows = mixed.select(F.explode("pieces").alias("p"), "doc_id", "source", "h").select("p.*", "doc_id", "source", "h")
    return _shuffled(rows.withColumn("__shard", F.col("shard")), seed, "h", "turn", "block").drop("h", "__shard")


def mixed_documents(docs: DataFrame, whole: bool = False, **options) -> DataFrame:
    """The mix as documents: a row for each pass in which shards draw a document, same columns, by shard and in the shard's shuffled order.

    With ``whole``, no text is cut: the last document of a source's rest is taken whole if at least half of its words are
    drawn, else not at all, whichever lies nearer the target. Otherwise only that document may be cut; it keeps its first
    words, joined by single spaces, and its ``n_chars``. Sizes are words, so a document without words isn't drawn.
    """
    seed = options.get("seed", SEED)
    mixed = mix(docs, whole=whole, **options)
    drawn = mixed.where("size(pieces) > 0").select(F.col("doc_id").alias("__d"), F.col("h").alias("__h"), F.col("size").alias("__z"), F.col("pieces").alias("__p"))
    body = docs.withColumn("__own", F.xxhash64(F.lit(seed), "doc_id", "text"))
    # repeated rows share their key: number them on both sides so that each meets its own share
    body = body.withColumn("__i", F.row_number().over(W.partitionBy("__own", "doc_id").orderBy("__own")))
    drawn = drawn.withColumn("__j", F.row_number().over(W.partitionBy("__h", "__d").orderBy(F.size("__p").desc())))
    rows = body.join(drawn, null_safe([(F.col("__own"), F.col("__h")), (F.col("doc_id"), F.col("__d")), (F.col("__i"), F.col("__j"))]))
    # a document's pieces in one pass make one row, which goes to the shard of the first of them
    turns = "transform(array_distinct(transform(__p, p -> p.turn)), t -> transform(array(filter(__p, p -> p.turn = t)), some -> named_struct('turn', t, 'shard', some[0].shard, 'words', aggregate(some, 0L, (a, p) -> a + p.last - p.first)))[0])"
    rows = rows.withColumn("__p", F.explode(F.expr(turns))).withColumn("__k", F.col("__p.words"))
    if whole:
        rows = rows.where(F.col("__k") * 2 >= F.col("__z")).withColumn("__k", F.col("__z"))
    words = F.regexp_extract_all(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.when(F.col("__k") < F.col("__z"), F.array_join(F.slice(words, F.lit(1), F.col("__k").cast("int")), " ")).otherwise(F.col("text"))
    rows = rows.withColumn("__cut", cut).withColumn("__shard", F.col("__p.shard")).withColumn("__turn", F.col("__p.turn"))
    out = []
    for c in docs.columns:
        if c == "text":
            out.append(F.col("__cut").alias("text"))
        elif c == "n_chars":
            out.append(F.when(F.col("__k") < F.col("__z"), F.length("__cut").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")).alias("n_chars"))
        else:
            out.append(F.col(c))
    return _shuffled(rows, seed, "__own", "__i", "__turn").select(*out)


def query(spark, sf_dir: str) -> DataFrame:
    """op2: how many words of each document the mix takes."""
    from weir.session import table

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", F.transform("pieces", lambda p: p["shard"]).alias("shards"))
