"""Prefix trie of conversations by fixed-length block hashing (operator 13).

Turns are named by two 64-bit hashes of role and text; a prefix is named by the
exclusive or of its turns' hashes, each salted with its position (two lanes, 128
bits).  So prefixes of any length come from running sums, and no task ever needs a
whole conversation.

1. Conversations are cut into blocks of ``block`` turns.  Successive block digests
   give every block its parent (the prefix before it), and equal blocks under one
   parent become one row with its number of conversations: hot prefixes shrink in
   the map-side aggregate.
2. A parent with one distinct block has no divergence inside it: its nodes are read
   off that row.  Only where siblings diverge are the distinct blocks opened turn by
   turn and grouped again.
3. A node is named (smallest member, depth).  The nodes of one smallest member are
   the tail of its path, so the trie is a tree of tails.  Sums over subtrees are
   pointer doubling over tails (as many rounds as the log2 of their nesting), then
   running sums along each tail in chunks of bounded size.
4. The ids that end at a node are sorted by a range exchange and joined to bounded
   pieces; a node's pieces are streamed through SHA-256 in order.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casebook.functions.indexing import dense_index
from casebook.llm.scratch import stored
from casebook.session import ship_package

BLOCK = 4
CHUNK = 1024
PIECE = 512
SALTS = 32
WORD = r"[^\x20\x09-\x0D]+"
NODE = ["depth", "k1", "k2"]
OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def numbered_turns(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role",
                   text: str = "text") -> DataFrame:
    """(conv, pos, n, role, text, d1, d2, words): the turns of every conversation,
    numbered from 0 in the order of turn (null first), role, text; n is their number.

    Rows with a null key take no part; null role or text is empty; repeated rows are
    turns of their own.  The order is made by one range exchange, so a conversation
    with a large share of all rows lies on many tasks.
    """
    spoken = rows.select(F.col(f"`{key}`").cast("long").alias("conv"), F.col(f"`{turn}`").alias("turn"),
                         F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("role"),
                         F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text")).where("conv IS NOT NULL")
    placed = dense_index(spoken, ["conv", "turn", "role", "text"], "at")
    spans = placed.groupBy("conv").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    return (placed.join(spans, "conv")
            .select("conv", (F.col("at") - F.col("first")).alias("pos"), "n", "role", "text",
                    F.xxhash64(F.lit(1), "role", "text").alias("d1"), F.xxhash64(F.lit(2), "role", "text").alias("d2"),
                    F.regexp_count("text", F.lit(WORD)).cast("long").alias("words")))


def regrafted(turns: DataFrame, group: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversation c again, begun with the first h turns of conversation c - c % group
    in place of its own first h; h = crc32(decimal c) % most.

    Returns (convs, turns): (conv, n) of every conversation, and the turns as
    ``numbered_turns`` has them.  At most ``most`` - 1 turns of a base are copied, to
    the at most 2 * group - 1 conversations that share it.
    """
    convs = stored(turns.select("conv", "n").distinct()
                   .select("conv", "n", (F.col("conv") - F.col("conv") % group).alias("base"),
                           (F.crc32(F.col("conv").cast("string")) % most).alias("h")), "trie-convs")
    bases = convs.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(bases, "base", "left").withColumn("lead", F.least("h", F.coalesce("base_n", F.lit(0)).cast("long")))
    convs = stored(convs.select("conv", "base", "h", "lead",
                                (F.col("lead") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n")), "trie-grafts")
    kept = (turns.drop("n").join(convs.select("conv", "h", "lead", "n"), "conv").where("pos >= h")
            .withColumn("pos", F.col("pos") - F.col("h") + F.col("lead")).drop("h", "lead"))
    heads = (turns.where(F.col("pos") < most - 1).drop("n").withColumnRenamed("conv", "base")
             .join(convs.select("conv", "base", "h", "n"), "base").where("pos < h").drop("base", "h"))
    return convs.select("conv", "n"), kept.unionByName(heads)


def running(df: DataFrame, keys: list[str], at: str, values: list[str], how, before: bool) -> DataFrame:
    """Running ``how`` of ``values`` along ``at`` within ``keys``: of the rows before
    (``before``), or of this row and those after it.  Chunks of ``CHUNK`` positions are
    summed on their own; only keys with several chunks have their chunks' sums carried
    on, so no task holds a long key."""
    df = df.withColumn("_chunk", F.floor(F.col(at) / CHUNK))
    edge = Window.unboundedPreceding
    order = (lambda c: F.asc(c)) if before else (lambda c: F.desc(c))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(order(at)).rowsBetween(edge, -1 if before else 0)
    along = Window.partitionBy(*keys).orderBy(order("_chunk")).rowsBetween(edge, -1)
    sums = df.groupBy(*keys, "_chunk").agg(*[how(v).alias(v) for v in values])
    carry = sums.select(*keys, "_chunk", *[how(v).over(along).alias(f"_carry_{v}") for v in values])
    carry = carry.where(F.col(f"_carry_{values[0]}").isNotNull())
    local = df.select("*", *[how(v).over(inside).alias(f"_run_{v}") for v in values])
    return local.join(carry, [*keys, "_chunk"], "left")


def together(a: Column, b: Column) -> Column:
    return F.coalesce(a, F.lit(0).cast("long")).bitwiseXOR(F.coalesce(b, F.lit(0).cast("long")))


def block_rows(turns: DataFrame, block: int) -> DataFrame:
    """One row per conversation and block: the salted turn hashes and word counts by
    place in the block, the name of the prefix before it (p1, p2) and with it (k1, k2)."""
    salted = turns.select("conv", "n", (F.col("pos") % block).alias("slot"), F.floor(F.col("pos") / block).alias("number"),
                          F.floor(F.col("pos") / (block * CHUNK)).alias("part"), "words",
                          F.xxhash64("pos", "d1", "d2").alias("g1"), F.xxhash64("pos", "d2", "d1").alias("g2"))
    here = lambda s, c: F.max(F.when(F.col("slot") == s, F.col(c))).alias(f"{c}_{s}")
    cut = (salted.repartition("conv", "part").groupBy("conv", "part", "number")
           .agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("size"), F.bit_xor("g1").alias("x1"), F.bit_xor("g2").alias("x2"),
                *[here(s, c) for s in range(block) for c in ("g1", "g2", "words")]))
    cut = running(stored(cut, "trie-cut"), ["conv"], "number", ["x1", "x2"], F.bit_xor, before=True)
    cut = cut.withColumns({f"p{i}": together(F.col(f"_run_x{i}"), F.col(f"_carry_x{i}")) for i in (1, 2)})
    cut = cut.withColumns({f"k{i}": F.col(f"p{i}").bitwiseXOR(F.col(f"x{i}")) for i in (1, 2)})
    return cut.select("conv", "n", "number", "size", "p1", "p2", "k1", "k2",
                      *[f"{c}_{s}" for s in range(block) for c in ("g1", "g2", "words")])


def trie_nodes(blocks: DataFrame, convs: DataFrame, block: int) -> DataFrame:
    """(depth, k1, k2, p1, p2, conv, members, words) of every node, the root included."""
    slots = [f"{c}_{s}" for s in range(block) for c in ("g1", "g2", "words")]
    place = ["number", "p1", "p2"]
    distinct = stored(blocks.groupBy(*place, "size", *slots)
                      .agg(F.count(F.lit(1)).alias("members"), F.min("conv").alias("conv")), "trie-distinct")
    forks = distinct.groupBy(*place).agg(F.count(F.lit(1)).alias("blocks")).where("blocks > 1").select(
        *place, F.lit(True).alias("fork"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    # The root has as many distinct blocks as conversations begin differently: its rows are dealt over ``SALTS`` keys.
    distinct = distinct.withColumn("salt", F.pmod(F.xxhash64("size", *slots), F.lit(SALTS)).cast("int"))
    distinct = stored(distinct.join(forks, [*place, "salt"], "left").drop("salt"), "trie-marked")

    steps, p1, p2 = [], F.col("p1"), F.col("p2")
    for s in range(block):
        k1, k2 = p1.bitwiseXOR(F.col(f"g1_{s}")), p2.bitwiseXOR(F.col(f"g2_{s}"))
        steps.append(F.struct((F.col("number") * block + s + 1).alias("depth"), k1.alias("k1"), k2.alias("k2"),
                              p1.alias("p1"), p2.alias("p2"), F.col(f"words_{s}").alias("words")))
        p1, p2 = k1, k2
    opened = distinct.select("fork", "members", "conv", F.explode(F.slice(F.array(*steps), F.lit(1), F.col("size").cast("int"))).alias("step"))
    opened = opened.select("fork", "members", "conv", "step.*")
    columns = [*NODE, "p1", "p2", "conv", "members", "words"]
    single = opened.where("fork IS NULL").select(*columns)
    refined = (opened.where("fork").groupBy(*NODE, "p1", "p2", "words")
               .agg(F.sum("members").alias("members"), F.min("conv").alias("conv")).select(*columns))
    nothing = F.lit(0).cast("long")
    root = (convs.agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("members")).where("members > 0")
            .select(nothing.alias("depth"), nothing.alias("k1"), nothing.alias("k2"), nothing.alias("p1"),
                    nothing.alias("p2"), "conv", "members", nothing.alias("words")))
    return single.unionByName(refined).unionByName(root)


def subtree_sums(tails: DataFrame) -> DataFrame:
    """(conv, up, at, saved, leaves) with sums over each tail and all below it.

    ``up`` is the tail above.  Round r adds the sums that reach 2^r tails down and
    doubles the reach; it ends when no tail has one that far above it."""
    now = stored(tails.select("*", F.col("up").alias("jump")), "trie-tails")
    while not now.where("jump IS NOT NULL").isEmpty():
        below = now.where("jump IS NOT NULL").groupBy("jump").agg(F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves"))
        far = now.select(F.col("conv").alias("jump"), F.col("jump").alias("far"))
        now = stored(now.join(far, "jump", "left").join(below.withColumnRenamed("jump", "conv"), "conv", "left")
                     .select("conv", "up", "at", (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"),
                             (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"),
                             F.col("far").alias("jump")), "trie-tails")
    return now.drop("jump")


def ends_digest(ends: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256): SHA-256 of the comma-joined ids that end at a node,
    in ascending order.  Ids are sorted by a range exchange and joined to pieces of at
    most ``PIECE``; the pieces of a node pass one after the other through one digest."""
    placed = dense_index(ends, [*NODE, "conv"], "at")
    pieces = placed.groupBy(*NODE, F.floor(F.col("at") / PIECE).alias("piece")).agg(
        F.concat_ws(",", F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string"))).alias("ids"))

    def digest(batches):
        node, state = None, None
        for b in batches:
            done = []
            for *here, ids in zip(*(b.column(c).to_pylist() for c in (*NODE, "ids"))):
                if here != node:
                    if node is not None:
                        done.append((*node, state.hexdigest()))
                    node, state = here, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_pylist([dict(zip((*NODE, "ends_sha256"), d)) for d in done], schema=schema)
        if node is not None:
            yield pa.RecordBatch.from_pylist([dict(zip((*NODE, "ends_sha256"), (*node, state.hexdigest())))], schema=schema)

    schema = pa.schema([*[(c, pa.int64()) for c in NODE], ("ends_sha256", pa.string())])
    return (pieces.repartition(*NODE).sortWithinPartitions(*NODE, "piece").select(*NODE, "ids")
            .mapInArrow(digest, "depth long, k1 long, k2 long, ends_sha256 string"))


def prefix_trie(convs: DataFrame, turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per distinct prefix, columns ``OUT``: conv_id the smallest member, depth,
    the parent's conv_id (root: null), n_convs members, n_children, n_leaves childless
    nodes in the subtree, saved_tokens the words that storing the subtree's turns once
    saves, ends_sha256 of the members that end here.

    ``convs`` is (conv, n), one row per conversation, with n turns (0: a member of the
    root alone); ``turns`` as from ``numbered_turns``, positions 0 to n - 1.  No
    conversations: no rows.  Prefixes are told apart by 128 bits of hashes; two
    different ones colliding is possible at about nodes^2 / 2^129.
    """
    ship_package(convs.sparkSession)
    blocks = stored(block_rows(turns, block), "trie-blocks")
    nodes = stored(trie_nodes(blocks, convs, block), "trie-nodes")

    # A tail: the nodes of one smallest member, from depth d0 to the member's end d1.
    saved = (F.col("members") - 1) * F.col("words")
    tails = stored(nodes.groupBy("conv").agg(F.min("depth").alias("d0"), F.max("depth").alias("d1"), F.sum(saved).alias("saved"),
                                             F.min_by("p1", "depth").alias("p1"), F.min_by("p2", "depth").alias("p2")), "trie-ends")
    over = nodes.select((F.col("depth") + 1).alias("d0"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv").alias("up"))
    tails = stored(tails.join(over.where("d0 > 0"), ["d0", "p1", "p2"], "left")
                   .select("conv", "d0", "d1", "saved", "up", (F.col("d0") - 1).alias("at")), "trie-hung")
    below = tails.where("up IS NOT NULL").groupBy(F.col("up").alias("conv"), F.col("at").alias("depth")).agg(F.count(F.lit(1)).alias("hung"))
    bare = (tails.join(below.withColumnRenamed("depth", "d1"), ["conv", "d1"], "left")
            .select("conv", "up", "at", "saved", F.col("hung").isNull().cast("long").alias("leaves")))
    whole = subtree_sums(bare)
    added = whole.where("up IS NOT NULL").groupBy(F.col("up").alias("conv"), F.col("at").alias("depth")).agg(
        F.count(F.lit(1)).alias("hung"), F.sum("saved").alias("hung_saved"), F.sum("leaves").alias("hung_leaves"))

    zero = F.lit(0).cast("long")
    full = (nodes.join(added, ["conv", "depth"], "left").join(tails.select("conv", "d0", "d1", "up"), "conv")
            .select(*NODE, "conv", "members", (F.coalesce("hung", zero) + (F.col("depth") < F.col("d1")).cast("long")).alias("n_children"),
                    F.when(F.col("depth") > F.col("d0"), F.col("conv")).otherwise(F.col("up")).alias("parent"),
                    (saved + F.coalesce("hung_saved", zero)).alias("saved"),
                    (F.coalesce("hung_leaves", zero) + ((F.col("depth") == F.col("d1")) & F.col("hung").isNull()).cast("long")).alias("leaves")))
    full = running(stored(full, "trie-full"), ["conv"], "depth", ["saved", "leaves"], F.sum, before=False)

    last = blocks.where(F.col("number") == F.floor((F.col("n") - 1) / block)).select(F.col("n").alias("depth"), "k1", "k2", "conv")
    ends = last.unionByName(convs.where("n = 0").select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv"))
    total = lambda c: F.col(f"_run_{c}") + F.coalesce(f"_carry_{c}", zero)
    return (full.join(ends_digest(ends), NODE, "left")
            .select(F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("members").alias("n_convs"),
                    "n_children", total("leaves").alias("n_leaves"), total("saved").alias("saved_tokens"),
                    F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")))


def node_texts(nodes: DataFrame, turns: DataFrame) -> DataFrame:
    """``nodes`` with the role and text of their last turn (root: null)."""
    said = turns.select(F.col("conv").alias("conv_id"), (F.col("pos") + 1).alias("depth"), "role", "text")
    return nodes.join(said, ["conv_id", "depth"], "left")


def conversation_trie(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``prefix_trie`` of a table of turns, with the last role and text of each node."""
    turns = stored(numbered_turns(rows, key, turn, role, text), "trie-turns")
    return node_texts(prefix_trie(turns.select("conv", "n").distinct(), turns), turns)
