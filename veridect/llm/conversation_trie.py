"""Prefix trie of conversations by ROLLUP over positional turn ids.

A conversation becomes an array of turn ids (a hash of role and text, then the
text's size in bytes). The array is cut into blocks of ``WIDTH`` columns; a
block's rows carry the key of the node that the block before it ended at, so
one ``GROUP BY prior, ROLLUP (t1 .. t8)`` aggregates all prefixes of all blocks
together and ``grouping_id`` tells a row's depth. A second ROLLUP over the
nodes sums what lies below each of them; what lies in later blocks enters as
rows of the block that they continue.

Keys are the first 16 bytes of a SHA-256: among 10**12 different turns two share
one with a chance of about 10**-15. Turns of one conversation are ordered by
turn (NULL first), equal turns by their id; repeated rows are turns of their
own. NULL roles and texts count as empty. Rows without a conversation id belong
to no conversation and are left out. An empty table has no nodes. Texts of any
length enter as their hash and size only. Extra columns are ignored.

What one row holds grows with one conversation (24 bytes a turn). The block
chain of a long one is unfolded into all pairs of its blocks, n**2 / 128 rows
for n turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veridect.llm.frames import stored
from veridect.operators.ordered import join_bounded

WIDTH = 8
#: Children of a node beyond which its key counts as hot.
HOT_CHILDREN = 10_000
#: Conversation ids in one piece of a digest's input.
DIGEST_IDS = 512

TURNS = [f"t{i}" for i in range(1, WIDTH + 1)]
_COLUMNS = ", ".join(TURNS)
#: The grouped columns of a row; the others are folded away.
_LEVEL = f"({WIDTH} - bit_count(grouping_id()))"
#: A row stands for a node if its last grouped column holds a turn.
_REAL = f"(level = 0 OR element_at(array({_COLUMNS}), greatest(level, 1)) IS NOT NULL)"
ROOT = "X'00000000000000000000000000000000'"


def _key(data: str) -> str:
    return f"substring(unhex(sha2({data}, 256)), 1, 16)"


def _chained(prior: str, turns: str) -> str:
    return _key(f"aggregate({turns}, {prior}, (a, x) -> concat(a, x))")


def conversation_turns(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id and its turn ids in order."""
    role, text = "coalesce(role, '')", "coalesce(text, '')"
    turn = f"concat({_key(f"concat(length({role}), ':', {role}, {text})")}, unhex(lpad(hex(octet_length({text})), 16, '0')))"
    return (
        conversations.filter("conv_id IS NOT NULL")
        .selectExpr("conv_id", f"struct(turn, {turn} AS id) AS turn")
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("turn")).alias("turns"))
        .selectExpr("conv_id", "turns.id AS turns")
    )


def regenerate(turns: DataFrame, fan: int = 5, spread: int = 9) -> DataFrame:
    """Conversations that begin as the first of their ``fan`` neighbours does.

    Conversation c takes its first h turns from conversation c - c % fan (none
    if there is no such one, all if it is shorter) and the turns behind its own
    first h, with h = crc32 of the decimal c, modulo ``spread``.
    """
    first = f"conv_id - conv_id % {fan}"
    together = turns.withColumn("family", F.expr(first)).repartition("family")
    head = F.max(F.expr(f"CASE WHEN conv_id = family THEN slice(turns, 1, {spread}) END")).over(Window.partitionBy("family"))
    shared = f"CAST(crc32(CAST(CAST(conv_id AS STRING) AS BINARY)) % {spread} AS INT)"
    return together.withColumn("head", head).selectExpr(
        "conv_id",
        f"concat(slice(coalesce(head, array()), 1, {shared}), slice(turns, {shared} + 1, size(turns))) AS turns",
    )


def _paths(turns: DataFrame) -> DataFrame:
    """conv_id, turns and ``priors``: the key of the node before each block, at least the root's."""
    count = f"CAST(ceil(size(turns) / {WIDTH}) AS INT)"
    steps = f"CASE WHEN {count} > 1 THEN sequence(1, {count} - 1) ELSE array() END"
    block = f"slice(turns, (j - 1) * {WIDTH} + 1, {WIDTH})"
    step = f"concat(acc, array({_chained('element_at(acc, -1)', block)}))"
    return turns.selectExpr("conv_id", "turns", f"aggregate({steps}, array({ROOT}), (acc, j) -> {step}) AS priors")


def _ends_digest(paths: DataFrame) -> DataFrame:
    """node_key and the SHA-256 of the comma-joined ids of the conversations that end there.

    Ids are range partitioned and joined in short pieces before the shuffle by
    node; a node's digest then runs over its pieces in order and keeps no more
    than the hash state.
    """
    last = f"slice(turns, (size(priors) - 1) * {WIDTH} + 1, {WIDTH})"
    ends = paths.selectExpr("conv_id", f"CASE WHEN size(turns) = 0 THEN {ROOT} ELSE {_chained('element_at(priors, -1)', last)} END AS node_key")
    ranged = ends.repartitionByRange("conv_id").sortWithinPartitions("conv_id")
    # the number counts the rows of a partition from its own base, which is a multiple of any power of two
    cut = stored(ranged.withColumn("slice", F.shiftright(F.monotonically_increasing_id(), DIGEST_IDS.bit_length() - 1)), "trie-ends")
    pieces = (
        cut.groupBy("node_key", "slice")
        .agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
        .selectExpr("node_key", "ids[0] AS first_id", "concat_ws(',', transform(ids, x -> CAST(x AS STRING))) AS ids")
    )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            nodes, sums = [], []
            for key, ids in zip(batch.column("node_key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if key == node:
                    state.update(b",")
                else:
                    if state is not None:
                        nodes.append(node)
                        sums.append(state.hexdigest())
                    node, state = key, hashlib.sha256()
                state.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(sums, pa.string())], ["node_key", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], ["node_key", "ends_sha256"])

    ordered = pieces.repartition("node_key").sortWithinPartitions("node_key", "first_id")
    return ordered.mapInArrow(digest, "node_key binary, ends_sha256 string")


def _with_parent(nodes: DataFrame) -> DataFrame:
    """Adds the parent's conv_id; children of hot parents meet a broadcast list, unless it is long."""
    hot = nodes.filter(F.col("n_children") > HOT_CHILDREN).selectExpr("node_key AS parent_key", "conv_id AS hot_conv_id")
    marked = join_bounded(nodes, hot, ["parent_key"], hot.count(), "left")
    parents = nodes.filter(F.col("n_children").between(1, HOT_CHILDREN)).selectExpr("node_key AS parent_key", "conv_id AS parent_conv_id")
    done = marked.filter("hot_conv_id IS NOT NULL OR parent_key IS NULL").withColumnRenamed("hot_conv_id", "parent_conv_id")
    rest = marked.filter("hot_conv_id IS NULL AND parent_key IS NOT NULL").drop("hot_conv_id").join(parents, "parent_key", "left")
    return done.unionByName(rest)


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row per node of the trie of ``turns`` (conv_id, array of turn ids).

    node_key, parent_key and turn_id (binary; the root has no parent and no
    turn), conv_id (the smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens and ends_sha256.
    """
    spark = turns.sparkSession
    paths = stored(_paths(turns), "trie-paths")
    blocks = paths.selectExpr(
        "conv_id",
        "size(turns) AS turns_in_all",
        f"inline(transform(priors, (p, j) -> struct(j AS block, p AS prior, slice(turns, j * {WIDTH} + 1, {WIDTH}) AS t)))",
    ).selectExpr("conv_id", "turns_in_all", "block", "prior", *[f"get(t, {i}) AS {c}" for i, c in enumerate(TURNS)])
    rolled = spark.sql(
        f"""SELECT block, prior, {_COLUMNS}, {_LEVEL} AS level, min(conv_id) AS conv_id, count(*) AS n_convs, max(turns_in_all) AS longest
            FROM {{blocks}} GROUP BY block, prior, ROLLUP ({_COLUMNS})""",
        blocks=blocks,
    ).filter(_REAL)
    saved = f"(n_convs - 1) * CAST(conv(hex(substring(element_at(array({_COLUMNS}), level), 17, 8)), 16, 10) AS BIGINT)"
    nodes = stored(
        rolled.selectExpr(
            "*",
            f"CASE WHEN level = 0 THEN 0L ELSE {saved} END AS saved",
            f"CAST(longest = block * {WIDTH} + level AS BIGINT) AS leaf",
        ),
        "trie-nodes",
    )
    # rows of level 0 beyond the first block repeat the node that the block continues; they only name its first member
    own = nodes.filter("level > 0 OR block = 0")
    inside = own.filter("block > 0").groupBy("prior").agg(
        F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf"), F.count_if(F.col("level") == 1).alias("children")
    )
    chains = (
        nodes.filter("level = 0 AND block > 0")
        .select("block", "prior", "conv_id")
        .join(paths, "conv_id")
        .selectExpr("block", "prior", "priors", f"slice(turns, (block - 1) * {WIDTH} + 1, {WIDTH}) AS t")
    )
    chains = stored(chains.join(inside, "prior"), "trie-chains")
    below = (
        chains.selectExpr("saved", "leaf", "explode(slice(priors, 2, block)) AS prior")
        .groupBy("prior")
        .agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf"))
    )
    continued = (
        chains.drop("saved", "leaf")
        .join(below, "prior")
        .selectExpr(
            "block - 1 AS block",
            "element_at(priors, block) AS prior",
            *[f"get(t, {i}) AS {c}" for i, c in enumerate(TURNS)],
            f"{WIDTH + 1} AS level",
            "CAST(NULL AS BIGINT) AS conv_id",
            "CAST(NULL AS BIGINT) AS n_convs",
            "saved",
            "leaf",
            "children",
        )
    )
    counted = own.drop("longest").withColumn("children", F.lit(0).cast("long")).unionByName(continued)
    children = ", ".join([f"count_if(level = {i})" for i in range(1, WIDTH + 1)] + ["sum(children)"])
    # a node's own row has the most members of its group
    totals = spark.sql(
        f"""SELECT block, prior, {_COLUMNS}, {_LEVEL} AS level, min(conv_id) AS conv_id, max(n_convs) AS n_convs,
                   array({children}) AS children, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens
            FROM {{counted}} GROUP BY block, prior, ROLLUP ({_COLUMNS})""",
        counted=counted,
    ).filter(f"{_REAL} AND (level > 0 OR block = 0)")
    turns_of = f"slice(array({_COLUMNS}), 1, {{}})"
    keyed = totals.selectExpr(
        f"CASE WHEN level = 0 THEN prior ELSE {_chained('prior', turns_of.format('level'))} END AS node_key",
        f"CASE WHEN level = 1 THEN prior WHEN level > 1 THEN {_chained('prior', turns_of.format('level - 1'))} END AS parent_key",
        f"CASE WHEN level > 0 THEN element_at(array({_COLUMNS}), level) END AS turn_id",
        "conv_id",
        f"CAST(block * {WIDTH} + level AS BIGINT) AS depth",
        "n_convs",
        "element_at(children, level + 1) AS n_children",
        "n_leaves",
        "saved_tokens",
    )
    nothing = hashlib.sha256(b"").hexdigest()
    ended = keyed.join(_ends_digest(paths), "node_key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(nothing)))
    return _with_parent(stored(ended, "trie-totals")).select(
        "node_key", "parent_key", "turn_id", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )
