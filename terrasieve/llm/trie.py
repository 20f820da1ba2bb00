"""Prefix trie of conversations by smallest-member ownership.

A node is a distinct sequence of first turns. Its smallest member owns it, so
that each conversation owns a suffix of its own path. What a subtree holds is
then a sum over the members of its top: the tokens of their turns from there
on, less those of the nodes that they own (each is counted once), and a flag
for each member whose own last node has no child.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.lineage import settled
from ..operators.ranges import running_sums
from . import common

#: Turns of a conversation that are marked by one window.
TURNS_PER_PIECE = 4096
#: Ids that are joined in one row before the rows of a node are hashed.
IDS_PER_PIECE = 4096
_NODE = ["depth", "f1", "f2"]
_NO_ENDS_HEX = hashlib.sha256().hexdigest()


def _halves(digest: Column) -> list[Column]:
    """Two longs of a hexadecimal digest."""
    part = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("long")
    return [part(1), part(16)]


def ordered_turns(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(c, pos, key, tokens): each conversation's turns from 1 on; ``key``
    hashes role and text, ``tokens`` counts the text's code points.

    Null turns come first, null roles and texts are empty. Turns that share a
    number go by role and then by the text's hash. Texts are hashed where they
    are read and go no further; a hot conversation is numbered by ranges."""
    r, t = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    digest = F.sha2(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t), 256)
    rows = turns.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("c"), F.col(turn).alias("turn"), r.alias("role"), digest.alias("key"), F.char_length(t).cast("long").alias("tokens")
    )
    placed = running_sums(rows, ["c"], ["turn", "role", "key"], {"before": F.lit(1).cast("long")})
    return placed.select("c", (F.col("before") + 1).alias("pos"), "key", "tokens")


def rebuilt_turns(own: DataFrame, heads: int = 6, group: int = 100) -> tuple[DataFrame, DataFrame]:
    """(c, pos, key, tokens) of all rebuilt conversations, and (c, n) of every
    conversation, turnless ones with n = 0.

    Conversation c begins with the first h turns of conversation c - c % group
    (all, if fewer; none, if absent), h = crc32(c as text) % heads, and goes on
    with its own turns after its first h. ``own`` must be settled."""
    total = own.count()
    lengths = own.groupBy("c").agg(F.count("*").alias("m"))
    head = own.where(F.col("pos") < heads).groupBy("c").agg(F.sort_array(F.collect_list(F.struct("pos", "key", "tokens"))).alias("head"))  # heads - 1 turns at most
    convs = lengths.withColumn("h", common.crc_bucket(F.col("c"), heads)).withColumn("base", F.col("c") - F.col("c") % group)
    convs = convs.join(head.withColumnRenamed("c", "base"), "base", "left")  # a base begins 2 * group conversations at most
    taken = F.coalesce(F.slice("head", 1, F.col("h").cast("int")), F.array().cast("array<struct<pos:bigint,key:string,tokens:bigint>>"))
    convs = settled(convs.select("c", "m", "h", taken.alias("head")).withColumn("k", F.size("head").cast("long")))
    begun = convs.select("c", F.explode("head").alias("t")).select("c", "t.pos", "t.key", "t.tokens")
    later = common.join_by_class(own, convs.select("c", "m", "h", "k"), ["c"], "m", total).where("pos > h")
    rows = begun.unionByName(later.select("c", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "key", "tokens"))
    return rows, convs.select("c", (F.col("k") + F.greatest(F.col("m") - F.col("h"), F.lit(0))).alias("n"))


def paths(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """(c, depth, f1, f2, p1, p2, own, rest, n): each conversation's nodes
    from its first turn on; f1 and f2 tell nodes of a depth apart, p1 and p2
    their parents. ``own`` is the tokens of the node's last turn and ``rest``
    those of this and all later turns.

    A prefix is known by the xor of the hashes of its turns with their places,
    so that a long conversation is summed piece by piece."""
    piece = ((F.col("pos") - 1) / TURNS_PER_PIECE).cast("long")
    h1, h2 = _halves(F.sha2(F.concat(F.col("pos").cast("string"), F.lit(":"), F.col("key")), 256))
    cut = settled(rows.select("c", "pos", "tokens", piece.alias("piece"), h1.alias("h1"), h2.alias("h2")))
    pieces = cut.groupBy("c", "piece").agg(F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"), F.sum("tokens").alias("x3"))
    before = Window.partitionBy("c").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("c").orderBy("piece").rowsBetween(1, Window.unboundedFollowing)
    zero = lambda agg, w: F.coalesce(agg.over(w), F.lit(0))
    starts = pieces.select("c", "piece", zero(F.bit_xor("x1"), before).alias("s1"), zero(F.bit_xor("x2"), before).alias("s2"), zero(F.sum("x3"), after).alias("s3"))
    upto = Window.partitionBy("c", "piece").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    on = Window.partitionBy("c", "piece").orderBy("pos").rowsBetween(0, Window.unboundedFollowing)
    xor = lambda a, b: F.col(a).bitwiseXOR(b)
    told = cut.withColumns({"r1": F.bit_xor("h1").over(upto), "r2": F.bit_xor("h2").over(upto), "r3": F.sum("tokens").over(on)}).join(starts, ["c", "piece"])
    told = told.select("c", F.col("pos").alias("depth"), xor("s1", F.col("r1")).alias("f1"), xor("s2", F.col("r2")).alias("f2"), "h1", "h2", F.col("tokens").alias("own"), (F.col("r3") + F.col("s3")).alias("rest"))
    told = told.select("c", "depth", "f1", "f2", xor("f1", F.col("h1")).alias("p1"), xor("f2", F.col("h2")).alias("p2"), "own", "rest")
    return _with_conversations(told, convs, ["n"])


def _with_conversations(path: DataFrame, convs: DataFrame, columns: list[str]) -> DataFrame:
    """Path rows with columns of their conversation, which has n of them."""
    told = convs.select("c", F.col("n").alias("_m"), *columns)
    return common.join_by_class(path, told, ["c"], "_m", max(1, convs.agg(F.sum("n")).first()[0] or 0))


def _hashed_ends(ends: DataFrame, ids_per_piece: int = IDS_PER_PIECE, most_pieces: int = 64) -> DataFrame:
    """(depth, f1, f2, ends_sha256) of nodes at which conversations (c) end.

    Ids of a range of ``ids_per_piece`` numbers are joined in one row. A node
    of more than ``most_pieces`` such rows is hashed by a stream over them in
    order, which holds one at a time."""
    written = F.array_join(F.transform(F.sort_array(F.collect_list("c")), lambda c: c.cast("string")), ",")
    joined = settled(ends.groupBy(*_NODE, F.floor(F.col("c") / ids_per_piece).alias("piece")).agg(written.alias("ids")))
    longer = settled(joined.groupBy(*_NODE).count().where(F.col("count") > most_pieces).select(*_NODE))
    pieces = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece", "ids"))), lambda p: p["ids"]), ",")
    short = joined.join(longer, _NODE, "left_anti").groupBy(*_NODE).agg(F.sha2(pieces, 256).alias("ends_sha256"))

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, state = None, None
        for batch in batches:
            out = []
            for *key, ids in batch[[*_NODE, "ids"]].itertuples(index=False, name=None):
                if key != node:
                    if state:
                        out.append((*node, state.hexdigest()))
                    node, state = key, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            yield pd.DataFrame(out, columns=[*_NODE, "ends_sha256"]).astype({c: "int64" for c in _NODE})
        if state:
            yield pd.DataFrame([(*node, state.hexdigest())], columns=[*_NODE, "ends_sha256"])

    dealt = joined.join(longer, _NODE, "left_semi").repartition(*_NODE).sortWithinPartitions(*_NODE, "piece")
    return short.unionByName(dealt.select(*_NODE, "ids").mapInPandas(stream, "depth long, f1 long, f2 long, ends_sha256 string"))


def prefix_trie(turns: DataFrame, heads: int = 6, group: int = 100, **columns: str) -> DataFrame:
    """A row for each node of the trie of rebuilt conversations: conv_id (its
    smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256.

    Odd rows: a turn without conv_id belongs to no conversation. A null turn
    comes first, a null role or text is empty, and repeated turns each count;
    turns of one number go by role and by the text's hash. A conversation that
    is left without turns ends at the root. An empty table has no node. Other
    columns of ``turns`` are left out.
    """
    own = settled(ordered_turns(turns, **columns))
    rows, convs = rebuilt_turns(own, heads, group)
    convs = settled(convs)
    path = settled(paths(rows, convs))
    # of each node: its owner, what the owner has from here on, its members, and whether one of them goes on
    nodes = path.groupBy(*_NODE).agg(F.min(F.struct("c", "rest")).alias("first"), F.count("*").alias("n_convs"), F.max("n").alias("deepest"), F.min("p1").alias("p1"), F.min("p2").alias("p2"))
    nodes = settled(nodes.select(*_NODE, "p1", "p2", F.col("first.c").alias("conv_id"), F.col("first.rest").alias("rest"), "n_convs", (F.col("deepest") == F.col("depth")).alias("childless")))
    # a conversation owns its path from its first own node on, if any
    owners = nodes.groupBy(F.col("conv_id").alias("c")).agg(F.min(F.struct("depth", "rest")).alias("since"), F.max(F.col("childless").cast("long")).alias("leaf"))
    owned = F.coalesce("since.rest", F.lit(0).cast("long"))
    owners = settled(convs.join(owners, "c", "left").select("c", "n", F.coalesce("since.depth", F.col("n") + 1).alias("since"), owned.alias("owned"), F.coalesce("leaf", F.lit(0)).alias("leaf")))
    told = _with_conversations(path.drop("n"), owners, ["since", "owned", "leaf"])
    saved = F.when(F.col("depth") < F.col("since"), F.col("rest") - F.col("owned")).otherwise(0)
    sums = told.groupBy(*_NODE).agg(F.sum(saved).alias("saved_tokens"), F.sum("leaf").alias("n_leaves"))
    children = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("f1"), F.col("p2").alias("f2")).agg(F.count("*").alias("n_children"))
    ends = _hashed_ends(path.where("depth = n").select(*_NODE, "c"))
    full = nodes.join(sums, _NODE).join(children, _NODE, "left").join(ends, _NODE, "left")
    full = settled(full.withColumns({"children": F.coalesce("n_children", F.lit(0).cast("long")), "ends_sha256": F.coalesce("ends_sha256", F.lit(_NO_ENDS_HEX))}).drop("n_children"))
    above = full.where("children > 0").select((F.col("depth") + 1).alias("depth"), F.col("f1").alias("p1"), F.col("f2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), F.col("children").alias("m"))
    deep = common.join_by_class(full.where("depth > 1"), above, ["depth", "p1", "p2"], "m", max(1, full.count()))
    root = _root(convs, owners, path, full)
    first = full.where("depth = 1").crossJoin(F.broadcast(root.select(F.col("conv_id").alias("parent_conv_id"))))  # one row
    shape = ["conv_id", "depth", "parent_conv_id", "n_convs", F.col("children").alias("n_children"), "n_leaves", "saved_tokens", "ends_sha256"]
    return deep.select(*shape).unionByName(first.select(*shape)).unionByName(root)


def _root(convs: DataFrame, owners: DataFrame, path: DataFrame, full: DataFrame) -> DataFrame:
    """The root's row: its members are all conversations, its own tokens none."""
    zero = F.lit(0).cast("long")
    of = owners.agg(F.min("c").alias("conv_id"), F.count("*").alias("n_convs"), F.sum("leaf").alias("leaves"), F.sum("owned").alias("owned"))
    spent = path.where("depth = 1").agg(F.coalesce(F.sum("rest"), zero).alias("spent"))
    below = full.where("depth = 1").agg(F.count("*").alias("n_children"))
    ends = _hashed_ends(convs.where("n = 0").select(zero.alias("depth"), zero.alias("f1"), zero.alias("f2"), "c")).agg(F.max("ends_sha256").alias("ends_sha256"))
    alone = F.when(F.col("n_children") == 0, F.lit(1)).otherwise(F.col("leaves")).cast("long")  # a root without children is a leaf itself
    one = of.crossJoin(spent).crossJoin(below).crossJoin(ends).where("n_convs > 0")  # one row each
    return settled(one.select("conv_id", zero.alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", alone.alias("n_leaves"), (F.col("spent") - F.col("owned")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(_NO_ENDS_HEX)).alias("ends_sha256")))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations."""
    return prefix_trie(common.table(spark, sf_dir, "conversations"))
