"""Prefix trie of conversations by ROLLUP over positional turn-id columns.

Every conversation is a row of turn ids in columns t1 … t8; one ROLLUP over them gives
all its prefixes with their members, and ``grouping_id`` tells the depth.  The turns
after the eighth continue in a further row of eight columns, and so on; a row is keyed
by the node that the row before it ended at, so rows of all blocks go through the same
ROLLUP.  A node's key is the exclusive-or of hashes of (place, turn id) of its path,
128 bits, which running aggregates give for any length without a round per block.

Sums over subtrees need no walk.  A node is owned by its smallest member, and what a
conversation owns is the rest of its path from some depth on.  With T the words of the
turns before that depth (all words, if it owns none), the words saved below a node are
the sum of T over its members, less the owner's T, less the words before the node for
each other member; and the leaves below it are the members that own a leaf.  So a second
ROLLUP that sums two numbers of each conversation is enough.

No key's rows meet in one task: long conversations are numbered and summed in ranges of
turns and blocks, those with over a thousandth of all turns (fewer than a thousand) and
nodes with over a thousandth of all children are joined by broadcast, and the ids that
end at a node pass through a running hash.

Defined cases: rows without conv_id take no part; a null turn comes first, turns that tie
go by the MD5 of role and text; null role or text is empty; equal rows are turns each; a
conversation may end up without turns and then is a member of the root alone; an empty
table has no nodes; columns of other names are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .digests import EMPTY_SHA256, ordered_sha256

#: columns of a block, and turns or blocks of a conversation that are put in order together
WIDTH, RANGE = 8, 512
BLANK = r"[\x20\x09-\x0D]+"


def turn_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, id (16 bytes that name role and text) and words of each turn."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in ("role", "text"))
    name = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    words = F.size(F.array_remove(F.split(text, BLANK), "")).cast("long")
    rows = conversations.where(F.col("conv_id").isNotNull())
    return rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.unhex(F.md5(name)).alias("id"), words.alias("words"))


def shared_head(conv_id: Column, head: int = 4) -> Column:
    """Turns that a rebuilt conversation takes from the first of its twenty."""
    return F.crc32(conv_id.cast("string").cast("binary")) % head


def rebuilt_turns(turns: DataFrame, head: int = 4, family: int = 20) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, id, words) of the rebuilt conversations, and (conv_id, length) of all of them."""
    ranged = turns.withColumn("range", F.coalesce(F.floor(F.col("turn") / RANGE), F.lit(-(1 << 62))))
    local = F.row_number().over(Window.partitionBy("conv_id", "range").orderBy(F.asc_nulls_first("turn"), "id")) - 1
    sizes = ranged.groupBy("conv_id", "range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    own_n = sizes.groupBy("conv_id").agg(F.sum("n").alias("own_n"))
    first = F.col("conv_id") - F.col("conv_id") % family
    convs = own_n.withColumn("h", shared_head(F.col("conv_id"), head)).withColumn("base", first)
    bases = own_n.select(F.col("conv_id").alias("base"), F.col("own_n").alias("base_n"))
    taken = F.least("h", F.coalesce("base_n", F.lit(0)))
    convs = cut_lineage(convs.join(bases, "base", "left").select("conv_id", "base", "h", "own_n", taken.alias("taken")))

    placed = offsets.join(convs, "conv_id").select("conv_id", "range", "offset", "h", "taken")
    numbered = ranged.withColumn("local", local).join(placed, ["conv_id", "range"])
    numbered = numbered.select("conv_id", (F.col("local") + F.col("offset")).alias("no"), "h", "taken", "id", "words")
    numbered = cut_lineage(numbered)
    own = numbered.where(F.col("no") >= F.col("h")).select("conv_id", (F.col("no") - F.col("h") + F.col("taken")).alias("pos"), "id", "words")
    # a family has at most twenty members, each with fewer than ``head`` turns of the first one
    heads = numbered.where(F.col("no") < head - 1).select(F.col("conv_id").alias("base"), F.col("no").alias("pos"), "id", "words")
    shared = convs.join(heads, "base").where(F.col("pos") < F.col("h")).select("conv_id", "pos", "id", "words")
    lengths = convs.select("conv_id", (F.col("taken") + F.greatest(F.lit(0), F.col("own_n") - F.col("h"))).cast("long").alias("length"))
    return own.unionByName(shared), lengths


def place_hash(seed: int, pos: Column, turn_id: Column) -> Column:
    return F.xxhash64(F.lit(seed), pos.cast("long"), turn_id)


def running(df: DataFrame, columns: dict[str, tuple[Callable, Callable, str]]) -> DataFrame:
    """Adds, for each block, aggregates of the conversation's earlier blocks: (aggregate, combination, source) by name."""
    ranged = df.withColumn("range", F.floor(F.col("block") / RANGE))
    near = Window.partitionBy("conv_id", "range").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    far = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("conv_id", "range").agg(*[agg(src).alias(f"_{n}") for n, (agg, _, src) in columns.items()])
    totals = totals.select("conv_id", "range", *[F.coalesce(agg(f"_{n}").over(far), F.lit(0)).alias(f"_{n}") for n, (agg, _, _) in columns.items()])
    here = ranged.select("*", *[F.coalesce(agg(src).over(near), F.lit(0)).alias(n) for n, (agg, _, src) in columns.items()])
    out = here.join(totals, ["conv_id", "range"])
    return out.select(*df.columns, *[both(F.col(n), F.col(f"_{n}")).alias(n) for n, (_, both, _) in columns.items()])


def turn_blocks(turns: DataFrame, lengths: DataFrame, width: int = WIDTH) -> DataFrame:
    """A row for each block of a conversation: turn columns, the key of the node before it, and what its end is."""
    slot = F.pmod(F.col("pos"), F.lit(width))
    cells = [F.max(F.when(slot == k, F.struct("id", "words"))).alias(f"t{k + 1}") for k in range(width)]
    block = F.floor(F.col("pos") / width).alias("block")
    keys = [F.bit_xor(place_hash(s, F.col("pos"), F.col("id"))).alias(n) for s, n in ((17, "bx"), (71, "by"))]
    rows = turns.groupBy("conv_id", block).agg(*cells, *keys, F.sum("words").alias("block_words"), F.count(F.lit(1)).alias("turns"))
    xor, plus = (lambda a, b: a.bitwiseXOR(b)), (lambda a, b: a + b)
    rows = running(rows, {"kx": (F.bit_xor, xor, "bx"), "ky": (F.bit_xor, xor, "by"), "before": (F.sum, plus, "block_words")})
    none = lengths.where(F.col("length") == 0).select("conv_id", F.lit(0).cast("long").alias("block"))
    for name in ("bx", "by", "block_words", "turns", "kx", "ky", "before"):
        none = none.withColumn(name, F.lit(0).cast("long"))
    return rows.unionByName(none, allowMissingColumns=True)


def rolled_up(blocks: DataFrame, aggregates: str, width: int = WIDTH) -> DataFrame:
    """The aggregates of every node: block, key before it, turn columns and k, the turns of its block on its path."""
    turns = ", ".join(f"t{k + 1}" for k in range(width))
    rows = blocks.sparkSession.sql(
        f"SELECT block, kx, ky, {turns}, {width} - bit_count(grouping_id()) AS k, {aggregates} FROM {{rows}} GROUP BY block, kx, ky, ROLLUP ({turns})",
        rows=blocks,
    )
    # what is grouped by a turn that isn't there ended before it; the node before a block stands in that block already
    last = F.get(F.array(*[F.col(f"t{k + 1}.id") for k in range(width)]), F.col("k") - 1)
    return rows.where(F.when(F.col("k") == 0, F.col("block") == 0).otherwise(last.isNotNull()))


def node_key(width: int = WIDTH) -> list[Column]:
    """depth, x and y of a node, and px and py of its parent."""
    first = F.col("block") * width
    out = [(first + F.col("k")).cast("long").alias("depth")]
    for less, names in ((0, ("x", "y")), (1, ("px", "py"))):
        for seed, name, start in ((17, names[0], "kx"), (71, names[1], "ky")):
            key = F.col(start)
            for j in range(width):
                turn = place_hash(seed, first + j, F.col(f"t{j + 1}.id"))
                key = key.bitwiseXOR(F.when(F.col("k") - less > j, turn).otherwise(F.lit(0).cast("long")))
            out.append(key.alias(name))
    return out


def own_joined(rows: DataFrame, keyed: DataFrame, heavy: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` with the one row of ``keyed`` for each key; the keys in ``heavy`` (a bounded number) by broadcast."""
    few = F.broadcast(heavy)
    light = rows.join(few, on, "left_anti").join(keyed, on)
    return light.unionByName(rows.join(F.broadcast(keyed.join(few, on, "left_semi")), on))


def trie_nodes(conversations: DataFrame, head: int = 4, family: int = 20, width: int = WIDTH) -> DataFrame:
    """A row for each node of the trie of rebuilt conversations."""
    turns, lengths = rebuilt_turns(turn_rows(conversations), head, family)
    blocks = cut_lineage(turn_blocks(turns, lengths, width))
    words = F.array(*[F.col(f"t{k + 1}.words") for k in range(width)])
    up_to = F.aggregate(F.slice(words, F.lit(1), F.greatest(F.lit(0), F.col("k") - 1)), F.lit(0).cast("long"), lambda a, w: a + F.coalesce(w, F.lit(0)))
    nodes = rolled_up(blocks, "min(conv_id) AS conv_id, count(*) AS n_convs, max(before) AS before", width)
    nodes = cut_lineage(nodes.select(*node_key(width), "conv_id", "n_convs", (F.col("before") + up_to).alias("before")))

    node = ["depth", "x", "y"]
    parent = [(F.col("depth") - 1).alias("depth"), F.col("px").alias("x"), F.col("py").alias("y")]
    children = nodes.where(F.col("depth") > 0).groupBy(*parent).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = cut_lineage(nodes.join(children, node, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))

    ends = F.struct("block", (F.col("block") * width + F.col("turns")).alias("depth"), F.col("kx").bitwiseXOR(F.col("bx")).alias("x"), F.col("ky").bitwiseXOR(F.col("by")).alias("y"), (F.col("before") + F.col("block_words")).alias("total"))
    convs = blocks.groupBy("conv_id").agg(F.max(ends).alias("end")).select("conv_id", "end.depth", "end.x", "end.y", "end.total")
    owners = nodes.groupBy("conv_id").agg(F.min(F.struct("depth", "before")).alias("top"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    convs = convs.join(owners, "conv_id", "left")
    convs = convs.select("conv_id", *node, F.coalesce("top.before", "total").alias("t"), F.coalesce("leaf", F.lit(0)).cast("long").alias("leaf"))
    convs = cut_lineage(convs)

    # fewer than a thousand conversations have over a thousandth of all turns
    all_turns = lengths.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    long = lengths.where(F.col("length") * 1000 > all_turns).select("conv_id")
    summed = own_joined(blocks, convs.select("conv_id", "t", "leaf"), long, ["conv_id"])
    sums = rolled_up(summed, "sum(t) AS t_sum, sum(leaf) AS n_leaves, min_by(t, conv_id) AS t_own", width)
    sums = sums.select(*node_key(width)[:3], "t_sum", "n_leaves", "t_own")
    saved = F.col("t_sum") - F.col("t_own") - (F.col("n_convs") - 1) * F.col("before")

    # as few nodes have over a thousandth of all children
    wide = nodes.where(F.col("n_children") * 1000 > nodes.count()).select(*node)
    below = nodes.where(F.col("depth") > 0).select(*parent, F.col("depth").alias("own"), F.col("x").alias("cx"), F.col("y").alias("cy"))
    lookup = own_joined(below, nodes.select(*node, F.col("conv_id").alias("parent_conv_id")), wide, node)
    parents = lookup.select(F.col("own").alias("depth"), F.col("cx").alias("x"), F.col("cy").alias("y"), "parent_conv_id")

    # at most 4,096 ids of a range, each once
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    ending = convs.groupBy(*node, F.shiftright("conv_id", 12).alias("range")).agg(ids.alias("ids"))
    digests = ordered_sha256(ending, node, "range", "ids", ",")

    out = nodes.join(sums, node).join(parents, node, "left").join(digests, node, "left")
    return out.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        saved.alias("saved_tokens"),
        F.coalesce("sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"),
    )


def oracle(head: int = 4, family: int = 20) -> str:
    """The same rows from the list of turns of every conversation, in SQL."""
    return rf"""
    WITH t AS (
        SELECT conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id,
            len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
        FROM conversations WHERE conv_id IS NOT NULL),
    own AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) - 1 AS no FROM t),
    bits AS (SELECT DISTINCT conv_id, list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))) AS b FROM t),
    c AS (
        SELECT conv_id, xor(list_reduce(b, lambda a, x: xor(xor(a, x) >> 1, 3988292384::BIGINT * (xor(a, x) & 1))), 4294967295) % {head} AS h,
            conv_id - conv_id % {family} AS base FROM bits),
    n AS (SELECT conv_id, count(*) AS own_n FROM t GROUP BY ALL),
    c2 AS (SELECT c.*, least(h, coalesce(own_n, 0)) AS taken FROM c LEFT JOIN n ON n.conv_id = c.base),
    r AS (
        SELECT c2.conv_id, no AS pos, id, words FROM c2 JOIN own ON own.conv_id = c2.base AND no < h
        UNION ALL SELECT c2.conv_id, no - h + taken, id, words FROM c2 JOIN own USING (conv_id) WHERE no >= h),
    l AS (SELECT c.conv_id, coalesce(list(id ORDER BY pos) FILTER (id IS NOT NULL), []) AS ids, coalesce(list(words ORDER BY pos) FILTER (id IS NOT NULL), []) AS ws FROM c LEFT JOIN r USING (conv_id) GROUP BY ALL),
    m AS (SELECT conv_id, d, md5(array_to_string(ids[1:d], ',')) AS k, CASE WHEN d > 0 THEN md5(array_to_string(ids[1 : d - 1], ',')) END AS p,
            CASE WHEN d > 0 THEN ws[d] ELSE 0 END AS w, d = len(ids) AS ends FROM (SELECT *, unnest(range(0, len(ids) + 1)) AS d FROM l)),
    v AS (SELECT d, k, any_value(p) AS p, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(w) AS w,
            sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM m GROUP BY d, k),
    ch AS (SELECT d - 1 AS d, p AS k, count(*) AS n_children FROM v WHERE d > 0 GROUP BY ALL),
    pairs AS (SELECT DISTINCT a.d, a.k, b.d AS d2, b.k AS k2 FROM m a JOIN m b ON a.conv_id = b.conv_id AND b.d >= a.d),
    s AS (SELECT pairs.d, pairs.k, count(*) FILTER (n_children IS NULL) AS n_leaves, CAST(sum((n_convs - 1) * w) AS BIGINT) AS saved_tokens
        FROM pairs JOIN v ON v.d = d2 AND v.k = k2 LEFT JOIN ch ON ch.d = d2 AND ch.k = k2 GROUP BY ALL)
    SELECT v.conv_id, v.d AS depth, u.conv_id AS parent_conv_id, v.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, v.ends_sha256
    FROM v JOIN s ON s.d = v.d AND s.k = v.k LEFT JOIN ch ON ch.d = v.d AND ch.k = v.k LEFT JOIN v u ON u.d = v.d - 1 AND u.k = v.p"""
