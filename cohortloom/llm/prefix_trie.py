"""The trie of conversation prefixes, by van Emde Boas recursion.

Sequences are cut at half their depth. The first halves, merged where equal, form the upper trie;
the second halves form a forest under each cut prefix, which is named by the smallest conversation
that begins with it. Both are built in the same way, all subtries of one height by the same jobs,
so that a trie of depth d takes log2(d) levels of them. Totals are then grafted upward: the sum of
a lower forest is added to the string of the upper trie that it hangs on, and strings pass it to
their halves, down to single nodes.

A table holds a row for each string of a level, (ctx, lo, conv, n): it begins under the node of
``ctx`` at depth ``lo``, ``conv`` is the smallest of the ``n`` conversations that pass through it.
No row holds a sequence: strings are compared by SHA-256 digests of their halves, made pairwise
from the turns up. So a hot prefix or a long conversation is many rows, dealt by all keys.
"""

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.session import materialise, remove_stages, written

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NONE = hashlib.sha256(b"").hexdigest()


def ordered_turns(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, pos, sym, bytes) of every turn: its place in its conversation from 0, the digest of
    role and text, and the bytes of the text. Order is by turn (null first), role, text. Rows are
    sorted by ranges over the whole table and counted per task, so a conversation may be longer
    than a task."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), text(role_col).alias("role"), text(text_col).alias("text")).filter("conv IS NOT NULL")
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "text"]
    said = F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")
    placed = materialise(
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("conv", F.unhex(F.sha2(said, 256)).alias("sym"), F.octet_length("text").cast("long").alias("bytes"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")),
        "trie-order",
    )
    runs = placed.groupBy("conv", "part").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    shift = runs.select("conv", "part", (F.coalesce(earlier, F.lit(0)) - F.col("first")).alias("shift"))
    return placed.join(shift, ["conv", "part"]).select("conv", (F.col("row") + F.col("shift")).alias("pos"), "sym", "bytes")


def rebuilt_turns(turns: DataFrame, family: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): each conversation c begins with the first h = crc32(c) % ``most``
    turns of conversation c - c % ``family``, followed by its own after its first h. The second
    table holds (conv, n) for all conversations, also those left without a turn."""
    counts = materialise(turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n")), "trie-counts")
    own = counts.select("conv", "n", (F.col("conv") - F.col("conv") % family).alias("base"), (F.crc32(F.col("conv").cast("string")) % most).alias("h"))
    bases = counts.select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    convs = own.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0))))
    heads = turns.filter(F.col("pos") < most - 1).withColumnRenamed("conv", "base").join(convs.select("conv", "base", "h"), "base").filter("pos < h")
    tails = turns.join(convs.select("conv", "h", "taken"), "conv").filter("pos >= h").withColumn("pos", F.col("pos") - F.col("h") + F.col("taken"))
    columns = ["conv", "pos", "sym", "bytes"]
    lengths = convs.select("conv", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n"))
    return heads.select(columns).unionAll(tails.select(columns)), lengths


def ends_digest(ends: DataFrame) -> DataFrame:
    """Per (node, depth): the SHA-256 of its members, in numerical order, joined by commas. Ranges
    of the sorted table are joined to pieces of text in parallel; the digest of a node streams over
    its pieces, so no task holds the members of a node."""

    def pieces(batches):
        for batch in batches:
            node, depth, member = batch.columns
            if not len(node):
                continue
            changed = pa.array([True])
            if len(node) > 1:
                changed = pa.concat_arrays([changed, pc.or_(pc.not_equal(node[1:], node[:-1]), pc.not_equal(depth[1:], depth[:-1]))])
            at = pc.indices_nonzero(changed)
            offsets = pa.concat_arrays([at.cast(pa.int32()), pa.array([len(node)], pa.int32())])
            text = pc.binary_join(pa.ListArray.from_arrays(offsets, member.cast(pa.string())), ",")
            yield pa.RecordBatch.from_arrays([node.take(at), depth.take(at), member.take(at), text], ["node", "depth", "first", "text"])

    def digests(batches):
        now, state, done = None, None, []
        for batch in batches:
            for node, depth, text in zip(batch["node"].to_pylist(), batch["depth"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if (node, depth) != now:
                    if now is not None:
                        done.append((*now, state.hexdigest()))
                    now, state = (node, depth), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(text.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["node", "depth", "sha"])
                done = []
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([now[1]], pa.int64()), pa.array([state.hexdigest()])], ["node", "depth", "sha"])

    key = ["node", "depth"]
    spread = ends.select(*key, "member").repartitionByRange(*key, "member").sortWithinPartitions(*key, "member")
    parts = spread.mapInArrow(pieces, "node long, depth long, first long, text string")
    return parts.repartition(*key).sortWithinPartitions(*key, "first").select(*key, "text").mapInArrow(digests, "node long, depth long, sha string")


def prefix_trie(
    turns: DataFrame,
    *,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    rebuild: bool = True,
) -> DataFrame:
    """Per node of the trie of turn sequences, the textless root included: conv_id (smallest
    member), depth, parent_conv_id (null for the root), n_convs (members), n_children, n_leaves
    (nodes without children in its subtree), saved_tokens (sum over its subtree of (n_convs - 1) *
    bytes of the last text) and ends_sha256 (digest of the members that end there).

    ``rebuild`` first gives each conversation the beginning of the first of its five (see
    ``rebuilt_turns``). Null role and text are empty; turns with a null or equal number come first
    or by role and text. Repeated rows are turns like others. Rows without a conversation take no
    part. Conversations without turns are members of the root. An empty table gives an empty
    result. Other columns are not looked at. Ids are taken as whole numbers; c % 5 has the sign of c.
    """
    spark = turns.sparkSession
    start = written()
    ordered = ordered_turns(turns, conv_col, turn_col, role_col, text_col)
    if rebuild:
        symbols, convs = rebuilt_turns(materialise(ordered, "trie-turns"))
    else:
        symbols, convs = ordered, ordered.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    symbols = materialise(symbols, "trie-rebuilt")
    convs = materialise(convs, "trie-conversations")
    size = convs.agg(F.min("conv").alias("root"), F.count(F.lit(1)).alias("n"), F.max("n").alias("deep")).first()
    if not size.n:
        return spark.createDataFrame([], NODE)
    height = 1
    while height < size.deep:
        height *= 2

    # digests of all aligned strings of 1, 2, 4, ... turns, from those of their halves
    halves: dict[int, DataFrame] = {}
    digest, w = symbols.select("conv", F.col("pos").alias("lo"), F.col("sym").alias("dig")), 1
    while w < height:
        w *= 2
        low = F.col("lo") - F.col("lo") % w
        half = lambda x: F.max(F.when(F.col("lo") % w == x, F.col("dig")))  # noqa: B023, E731
        pairs = digest.groupBy("conv", low.alias("low")).agg(half(0).alias("left"), half(w // 2).alias("right"))
        halves[w] = materialise(pairs.withColumnRenamed("low", "lo"), f"trie-digests-{w}")
        digest = halves[w].select("conv", "lo", F.unhex(F.sha2(F.concat("left", F.coalesce("right", F.lit(b""))), 256)).alias("dig"))
    whole = digest.filter("lo = 0").select("conv", "dig")
    classes = materialise(whole.groupBy("dig").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n")), "trie-classes")

    # names: strings of w turns become upper strings of w / 2 and lower ones under their names
    strings = classes.select(F.lit(size.root).cast("long").alias("ctx"), F.lit(0).cast("long").alias("lo"), "conv", "n")
    cuts: dict[int, DataFrame] = {}
    w = height
    while w > 1:
        cut = strings.join(halves[w], ["conv", "lo"]).withColumn("tail", F.col("right").isNotNull())
        uppers = materialise(cut.groupBy("ctx", "lo", "left").agg(F.min("conv").alias("name"), F.sum("n").alias("through")), f"trie-uppers-{w}")
        cuts[w] = materialise(cut.join(uppers, ["ctx", "lo", "left"]).select("ctx", "lo", "conv", "n", "name", "through", "tail"), f"trie-cuts-{w}")
        upper = cuts[w].filter("conv = name").select("ctx", "lo", "conv", F.col("through").alias("n"))
        w //= 2
        lower = cuts[2 * w].filter("tail").select(F.col("name").alias("ctx"), (F.col("lo") + w).alias("lo"), "conv", "n")
        strings = upper.unionAll(lower)

    # strings of one turn are the nodes
    last = symbols.select("conv", F.col("pos").alias("lo"), "bytes")
    children = strings.groupBy(F.col("ctx").alias("conv"), (F.col("lo") - 1).alias("lo")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = materialise(
        strings.join(last, ["conv", "lo"])
        .join(children, ["conv", "lo"], "left")
        .select(
            "ctx", "lo", "conv", "n",
            F.coalesce("n_children", F.lit(0)).alias("n_children"),
            F.col("n_children").isNull().cast("long").alias("leaves"),
            ((F.col("n") - 1) * F.col("bytes")).alias("saved"),
        ),
        "trie-nodes",
    )

    # sums of the forests of height w under (ctx, lo), from those of w / 2
    sums = [F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")]
    forests = {1: materialise(nodes.groupBy("ctx", "lo").agg(*sums), "trie-forests-1")}
    w = 1
    while w < height:
        w *= 2
        lower = forests[w // 2].filter(F.col("lo") % w > 0).select(F.col("ctx").alias("conv"), (F.col("lo") - w // 2).alias("lo"), "leaves", "saved")
        hung = lower.join(cuts[w].filter("conv = name").select("ctx", "lo", "conv"), ["conv", "lo"])
        both = forests[w // 2].filter(F.col("lo") % w == 0).unionByName(hung.drop("conv"))
        forests[w] = materialise(both.groupBy("ctx", "lo").agg(*sums), f"trie-forests-{w}")

    # what hangs on the end of a string counts for each of its nodes
    hanging = None
    while w > 1:
        w //= 2
        added = forests[w].filter(F.col("lo") % (2 * w) > 0).select(F.col("ctx").alias("conv"), (F.col("lo") - w).alias("lo"), "leaves", "saved")
        if hanging is not None:
            passed = hanging.join(cuts[2 * w].select("conv", "lo", "name", "tail"), ["conv", "lo"])
            upper = F.struct(F.col("name").alias("conv"), F.col("lo").alias("lo"))
            lower = F.struct(F.col("conv").alias("conv"), (F.col("lo") + w).alias("lo"))
            to = F.when(F.col("tail"), F.array(upper, lower)).otherwise(F.array(upper))
            added = added.unionAll(passed.select(F.explode(to).alias("to"), "leaves", "saved").select("to.conv", "to.lo", "leaves", "saved"))
        hanging = materialise(added.groupBy("conv", "lo").agg(*sums), f"trie-hanging-{w}")

    # where conversations end
    at = classes.select("dig", "conv", F.lit(0).cast("long").alias("lo"))
    w = height
    while w > 1:
        step = cuts[w].select("conv", "lo", "name", "tail")
        w //= 2
        at = at.join(step, ["conv", "lo"]).select("dig", F.when(F.col("tail"), F.col("conv")).otherwise(F.col("name")).alias("conv"), F.when(F.col("tail"), F.col("lo") + w).otherwise(F.col("lo")).alias("lo"))
    ended = whole.withColumnRenamed("conv", "member").join(materialise(at, "trie-ends"), "dig")
    root = F.lit(size.root).cast("long")
    ended = ended.select(F.col("conv").alias("node"), (F.col("lo") + 1).alias("depth"), "member")
    ended = ended.unionAll(convs.filter("n = 0").select(root, F.lit(0).cast("long"), "conv"))
    shas = ends_digest(ended)

    below = nodes if hanging is None else nodes.join(hanging.withColumnsRenamed({"leaves": "more_leaves", "saved": "more_saved"}), ["conv", "lo"], "left")
    more = lambda c: F.col(c) if hanging is None else F.col(c) + F.coalesce(f"more_{c}", F.lit(0))
    rows = below.select(
        F.col("conv").alias("conv_id"), (F.col("lo") + 1).alias("depth"), F.col("ctx").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children",
        more("leaves").alias("n_leaves"), more("saved").alias("saved_tokens"),
    )
    total = nodes.agg(F.sum(F.when(F.col("lo") == 0, 1).otherwise(0)).alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    top = total.select(
        root.alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(size.n).cast("long").alias("n_convs"),
        F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"),
    )
    out = rows.unionAll(top).join(shas.withColumnRenamed("node", "conv_id"), ["conv_id", "depth"], "left")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    result = materialise(out.select(*columns, F.coalesce("sha", F.lit(NONE)).alias("ends_sha256")), "trie")
    remove_stages(spark, start, written() - 1)
    return result
