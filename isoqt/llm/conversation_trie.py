"""Z-fast trie of conversations: a compacted prefix trie kept as a hash table of handles, filled in batches.

A path is the sequence of turns of a (rebuilt) conversation. Its prefix of length d has the key (d, x, y): x and y are
exclusive ors of 64 bit hashes of (place, role, text), so equal prefixes have equal keys and a prefix is read from the
table of paths by (conversation, depth). A node of the trie is an edge: the depths above p up to e that no conversation
leaves or ends inside. It is stored under its handle, the prefix whose length is the 2-fattest number of (p, e].

* **Locate.** A conversation looks for the deepest node that it matches by fat binary search: it probes the handle table
  at the 2-fattest length of its open interval; a hit moves to the node's end (or names the exit edge), a miss halves
  the interval. All conversations of a batch probe together, one join for each step, about log2(length) steps.
* **Insert.** Those that leave inside an edge split it (several cuts of one edge at once); of those that go on from the
  same place with the same turn, the longest becomes the new leaf and the others stay for the next batch, where they
  start below that place. Equal conversations are one from the start. A batch descends at least one node, so there are
  at most as many batches as branching nodes on a path.
* **Sums.** Members, smallest ids, leaves and savings of subtrees come from doubling: a node adds what the nodes at
  distance 2^k below it have gathered, so log2(height) joins of nodes suffice.
* **Expand.** Every edge becomes a row for each of its depths, by a join with the path of its smallest member.

Ranks of turns and running keys are prefix scans over range partitions, so one very long conversation spreads over
tasks. Tables that are probed have one row for each key and the rows that probe them may be skewed, which AQE splits.

Defined cases: null roles and texts are empty; a null turn comes first; equal turns are ordered by role, then by hash of
the text; rows without a conversation id are left out; a conversation may be turnless after rebuilding (it ends at the
root); an empty table gives no rows; other columns are ignored. Keys of 128 bits stand for the turns they hash.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isoqt.llm.common import written

FAMILY, SHARED = 5, 9
#: Ids in one text block of a node's members.
BLOCK = 1000
_NODE = ("p", "e", "up", "id", "name", "handle", "rep")


def scan(rows: DataFrame, key: str, order: tuple[str, ...], xors: tuple[str, ...] = (), sums: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with ``nth`` and running xors and sums (``up_`` columns) within ``key``, from totals of range partitions."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(rows.repartitionByRange(parts, key, *order).withColumn("part", F.spark_partition_id()))
    ends = ranged.groupBy("part").agg(F.min(key).alias("low"), F.max(key).alias("high"))
    folds = [F.count(F.lit(1)).alias("nth"), *[F.bit_xor(c).alias(c) for c in xors], *[F.sum(c).alias(c) for c in sums]]
    last = ranged.join(F.broadcast(ends), "part").where(F.col(key) == F.col("high")).groupBy("part", "low", "high").agg(*folds).orderBy("part").collect()  # one row a partition
    carries, open_key, held = [], None, None
    for r in last:
        begun = r["low"] == open_key
        carries.append((r["part"], r["low"], *(held if begun else [0] * len(folds))))
        own = [r["nth"], *[r[c] for c in (*xors, *sums)]]
        if begun and r["low"] == r["high"]:
            held = [a ^ b if c in xors else a + b for a, b, c in zip(held, own, ("nth", *xors, *sums))]
        else:
            open_key, held = r["high"], own
    names = ["nth", *xors, *sums]
    carried = rows.sparkSession.createDataFrame(carries, "part int, first long, " + ", ".join(f"c_{c} long" for c in names))
    inside = Window.partitionBy("part", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    first = F.col(key) == F.col("first")
    add = lambda c: F.when(first, F.col(f"c_{c}")).otherwise(F.lit(0).cast("long"))
    out = ranged.join(F.broadcast(carried), "part").select(
        *rows.columns, "part", "first", *[f"c_{c}" for c in names], F.row_number().over(Window.partitionBy("part", key).orderBy(*order)).cast("long").alias("r_nth"),
        *[F.bit_xor(c).over(inside).alias(f"r_{c}") for c in xors], *[F.sum(c).over(inside).alias(f"r_{c}") for c in sums])
    return out.select(*rows.columns, (F.col("r_nth") + add("nth")).alias("nth"), *[F.col(f"r_{c}").bitwiseXOR(add(c)).alias(f"up_{c}") for c in xors],
                      *[(F.col(f"r_{c}") + add(c)).alias(f"up_{c}") for c in sums])


def prefix(d: Column, x: Column, y: Column) -> Column:
    return F.struct(d.cast("long").alias("d"), x.cast("long").alias("x"), y.cast("long").alias("y"))


def root() -> Column:
    """Key of the empty prefix."""
    return prefix(F.lit(0), F.lit(0), F.lit(0))


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv, i, a, b, bytes): every turn with its rank from 1, two hashes of role and text, and the bytes of the text."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("role"), F.xxhash64(F.lit(1), role, text).alias("a"), F.xxhash64(F.lit(2), role, text).alias("b"),
        F.octet_length(text).cast("long").alias("bytes"))
    return scan(written(rows), "conv", ("turn", "role", "a")).select("conv", F.col("nth").alias("i"), "a", "b", "bytes")


def rebuilt(turns: DataFrame, family: int = FAMILY, shared: int = SHARED) -> tuple[DataFrame, DataFrame]:
    """((conv, d, key, bytes, upto) of all paths, (conv, n, key) of all conversations) after each took over the first turns of its family's first."""
    turns = written(turns)
    sizes = turns.groupBy("conv").agg(F.max("i").alias("own"))
    h = F.crc32(F.col("conv").cast("string")) % shared
    convs = sizes.select("conv", "own", (F.col("conv") - F.col("conv") % family).alias("base"), h.alias("h"))
    heads = sizes.select(F.col("conv").alias("base"), F.col("own").alias("theirs"))
    convs = written(convs.join(heads, "base", "left").select("conv", "base", "own", "h", F.least("h", F.coalesce("theirs", F.lit(0))).alias("taken")))
    own = turns.join(convs.select("conv", "h", "taken"), "conv").where("i > h").select("conv", (F.col("taken") + F.col("i") - F.col("h")).alias("d"), "a", "b", "bytes")
    lent = (turns.where(F.col("i") < shared).withColumnRenamed("conv", "base").join(convs.select("base", F.col("conv"), "h"), "base")
            .where("i <= h").select("conv", F.col("i").alias("d"), "a", "b", "bytes"))
    steps = own.unionByName(lent).select("conv", "d", F.xxhash64("d", "a", "b").alias("x"), F.xxhash64("b", "d", "a").alias("y"), "bytes")
    paths = scan(steps, "conv", ("d",), ("x", "y"), ("bytes",)).select("conv", "d", prefix(F.col("d"), F.col("up_x"), F.col("up_y")).alias("key"), "bytes", F.col("up_bytes").alias("upto"))
    paths = written(paths)
    length = F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))
    full = convs.select("conv", length.cast("long").alias("n")).join(paths.select("conv", F.col("d").alias("n"), "key"), ["conv", "n"], "left")
    return paths, written(full.select("conv", "n", F.coalesce("key", root()).alias("key")))


def fattest(low: str, high: str) -> Column:
    """The number of (low, high] with the most trailing zero bits."""
    return F.expr(f"shiftleft(cast(-1 AS bigint), length(bin({low} ^ {high})) - 1) & {high}")


def reading(rows: DataFrame, paths: DataFrame, conv: str, depth: Column, name: str) -> DataFrame:
    """``rows`` with the key of the prefix of length ``depth`` of ``conv``; null beyond its end."""
    side = paths.select(F.col("conv").alias("__conv"), F.col("d").alias("__d"), F.col("key").alias(name))
    at = rows.withColumn("__at", depth)
    return at.join(side, (F.col(conv) == F.col("__conv")) & (F.col("__at") == F.col("__d")), "left").drop("__conv", "__d", "__at")


def locate(waiting: DataFrame, trie: DataFrame, paths: DataFrame) -> DataFrame:
    """``waiting`` (conv, n, low, node) with ``low`` and ``node`` moved to the deepest node each matches: fat binary search."""
    table = trie.select("handle", F.col("p").alias("t_p"), F.col("up").alias("t_up"), F.col("e").alias("t_e"), F.col("id").alias("t_id"))
    todo, found = waiting.withColumn("high", F.col("n")), []
    while True:
        probe = reading(todo.where("low < high").withColumn("f", fattest("low", "high")), paths, "conv", F.col("f"), "handle")
        probe = reading(probe.join(table, "handle", "left"), paths, "conv", F.col("t_e"), "there")
        missed, matched = F.col("t_e").isNull(), F.coalesce(F.col("there") == F.col("t_id"), F.lit(False))
        low = F.when(missed, F.col("low")).when(matched, F.col("t_e")).otherwise(F.col("t_p"))
        step = written(probe.select("conv", "n", low.alias("low"), F.when(missed, F.col("node")).when(matched, F.col("t_id")).otherwise(F.col("t_up")).alias("node"),
                                    F.when(missed, F.col("f") - 1).when(matched, F.col("high")).otherwise(low).alias("high")))
        found.append(todo.where("low >= high").select("conv", "n", "low", "node"))
        if step.where("low < high").isEmpty():
            found.append(step.select("conv", "n", "low", "node"))
            break
        todo = step
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def leaving(located: DataFrame, trie: DataFrame, paths: DataFrame) -> DataFrame:
    """(conv, n, at, place, next, edge columns): where each conversation leaves the trie, and inside which edge if in one."""
    edges = trie.select(F.col("name").alias("next"), *[F.col(c).alias(f"t_{c}") for c in _NODE if c != "name"])
    inside = written(reading(located, paths, "conv", F.col("low") + 1, "next").where("next IS NOT NULL").join(edges, "next", "left"))
    # How far both paths agree within the edge: keys are equal up to there.
    mine = paths.select("conv", "d", "key")
    theirs = paths.select(F.col("conv").alias("t_rep"), "d", F.col("key").alias("their"))
    shared = (inside.where("t_e IS NOT NULL").select("conv", "low", "t_e", "t_rep").join(mine, "conv").where("d > low AND d <= t_e")
              .select("conv", "d", "key", "t_rep").join(theirs, ["t_rep", "d"]).where(F.col("key") == F.col("their")).groupBy("conv").agg(F.max("d").alias("far")))
    out = inside.join(shared, "conv", "left").withColumn("at", F.coalesce("far", "low")).drop("next")
    out = reading(reading(out, paths, "conv", F.col("at"), "place"), paths, "conv", F.col("at") + 1, "next")
    return out.select("conv", "n", "at", F.coalesce("place", root()).alias("place"), "next", *[f"t_{c}" for c in _NODE if c != "name"])


def named(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """New nodes (p, e, up, id, rep) with the keys of their first turn and of their handle."""
    return reading(reading(nodes, paths, "rep", F.col("p") + 1, "name"), paths, "rep", fattest("p", "e"), "handle").select(*_NODE)


def build(distinct: DataFrame, paths: DataFrame) -> DataFrame:
    """The nodes below the root of the trie of ``distinct`` (conv, n, key), whose paths are in ``paths``."""
    full = distinct.select("conv", F.col("key").alias("end"))
    waiting, trie = distinct.where("n > 0").select("conv", "n", F.lit(0).cast("long").alias("low"), root().alias("node")), None
    while True:
        if trie is None:
            places = reading(waiting, paths, "conv", F.lit(1), "next").select("conv", "n", F.col("low").alias("at"), F.col("node").alias("place"), "next")
        else:
            places = leaving(locate(waiting, trie, paths), trie, paths)
        places = written(places)
        winners = written(places.where("next IS NOT NULL").groupBy("place", "next").agg(F.min(F.struct((-F.col("n")).alias("less"), "conv", "at")).alias("best")).select("place", "best.*"))
        leaves = winners.select("conv", (-F.col("less")).alias("e"), F.col("at").alias("p"), F.col("place").alias("up")).join(full, "conv").select(
            "p", "e", "up", F.col("end").alias("id"), F.col("conv").alias("rep"))
        if trie is None:
            trie = written(named(leaves, paths))
        else:
            cuts = written(places.where("t_e IS NOT NULL AND at < t_e").select("at", "place", *[f"t_{c}" for c in _NODE if c != "name"]).distinct())
            chain = Window.partitionBy("t_id").orderBy("at")
            upper = cuts.select(F.coalesce(F.lag("at").over(chain), "t_p").alias("p"), F.col("at").alias("e"), F.coalesce(F.lag("place").over(chain), "t_up").alias("up"),
                                F.col("place").alias("id"), F.col("t_rep").alias("rep"))
            lower = cuts.groupBy("t_id", "t_e", "t_rep").agg(F.max(F.struct("at", "place")).alias("last")).select(
                F.col("last.at").alias("p"), F.col("t_e").alias("e"), F.col("last.place").alias("up"), F.col("t_id").alias("id"), F.col("t_rep").alias("rep"))
            kept = trie.join(cuts.select(F.col("t_id").alias("id")).distinct(), "id", "left_anti").select(*_NODE)
            trie = written(kept.unionByName(named(leaves.unionByName(upper).unionByName(lower), paths)))
        waiting = written(places.where("next IS NOT NULL").join(winners.select("conv"), "conv", "left_anti").select("conv", "n", F.col("at").alias("low"), F.col("place").alias("node")))
        if waiting.isEmpty():
            return trie


def gather(nodes: DataFrame, sums: tuple[str, ...], lows: tuple[str, ...] = ()) -> DataFrame:
    """``nodes`` (id, up, values) with every value folded over the node's subtree, by doubling distances."""
    state = written(nodes.select("id", F.when(F.col("up").isNotNull(), F.col("up")).alias("above"), *sums, *lows))
    while True:
        below = state.where("above IS NOT NULL").groupBy("above").agg(*[F.sum(c).alias(f"b_{c}") for c in sums], *[F.min(c).alias(f"b_{c}") for c in lows]).withColumnRenamed("above", "id")
        jump = state.where("above IS NOT NULL").select(F.col("id").alias("above"), F.col("above").alias("higher"))
        # What hangs on the root (the hot key) has arrived; only the others look further up.
        deep = F.coalesce(F.col("above.d") > 0, F.lit(False))
        moved = state.where(deep).join(jump, "above", "left").select("id", F.col("higher").alias("above"), *sums, *lows).unionByName(
            state.where(~deep).withColumn("above", F.lit(None).cast(state.schema["above"].dataType)))
        folded = [(F.col(c) + F.coalesce(f"b_{c}", F.lit(0))).alias(c) for c in sums] + [F.least(c, f"b_{c}").alias(c) for c in lows]
        state = written(moved.join(below, "id", "left").select("id", "above", *folded))
        if state.where("above IS NOT NULL").isEmpty():
            return state.select("id", *sums, *lows)


def digests(full: DataFrame) -> DataFrame:
    """(id, ends_sha256): digest of the ascending ids of the conversations that end at each node, streamed in blocks."""
    spark_parts = int(full.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def blocks(batches):
        for batch in batches:
            d, x, y, conv = (batch.column(i).to_pylist() for i in range(4))
            starts = [i for i in range(len(conv)) if i == 0 or (d[i], x[i], y[i]) != (d[i - 1], x[i - 1], y[i - 1])] + [len(conv)]
            cuts = [(at, min(at + BLOCK, b)) for a, b in zip(starts, starts[1:]) for at in range(a, b, BLOCK)]
            take = lambda v: [v[a] for a, _ in cuts]
            yield pa.RecordBatch.from_arrays([pa.array(take(d), pa.int64()), pa.array(take(x), pa.int64()), pa.array(take(y), pa.int64()), pa.array(take(conv), pa.int64()),
                                              pa.array([",".join(map(str, conv[a:b])) for a, b in cuts], pa.string())], names=["d", "x", "y", "first", "ids"])

    def hashed(batches):
        last, digest = None, None
        for batch in batches:
            keys, out = list(zip(*(batch.column(i).to_pylist() for i in range(3)))), []
            for key, ids in zip(keys, batch.column(4).to_pylist()):
                if key == last:
                    digest.update(b"," + ids.encode())
                    continue
                if last is not None:
                    out.append((*last, digest.hexdigest()))
                last, digest = key, hashlib.sha256(ids.encode())
            yield rows_of(out)
        if last is not None:
            yield rows_of([(*last, digest.hexdigest())])

    def rows_of(out):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)] + [pa.array([r[3] for r in out], pa.string())], names=["d", "x", "y", "ends_sha256"])

    flat = full.select("key.d", "key.x", "key.y", "conv")
    cut = flat.repartitionByRange(spark_parts, "d", "x", "y", "conv").sortWithinPartitions("d", "x", "y", "conv").mapInArrow(blocks, "d long, x long, y long, first long, ids string")
    done = cut.repartition("d", "x", "y").sortWithinPartitions("d", "x", "y", "first").mapInArrow(hashed, "d long, x long, y long, ends_sha256 string")
    return done.select(prefix(F.col("d"), F.col("x"), F.col("y")).alias("id"), "ends_sha256")


def nodes_of(conversations: DataFrame, family: int = FAMILY, shared: int = SHARED) -> DataFrame:
    """One row for every distinct prefix of the rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    paths, full = rebuilt(turns_of(conversations), family, shared)
    ends = written(full.groupBy("key").agg(F.min("conv").alias("low"), F.count(F.lit(1)).alias("n_convs"), F.first("n").alias("n")))
    distinct = ends.select(F.col("low").alias("conv"), "n", "key")
    # Paths of one conversation of each kind answer for all.
    paths = written(paths.join(distinct.select("conv"), "conv", "left_semi"))
    trie = build(distinct, paths)
    upto = paths.select(F.col("conv").alias("rep"), "d", "upto")
    bytes_at = lambda rows, depth, name: rows.join(upto.select("rep", F.col("d").alias(depth), F.col("upto").alias(name)), ["rep", depth], "left")
    below = bytes_at(bytes_at(trie.select("id", "up", "p", "e", "rep"), "e", "b_e"), "p", "b_p").select("id", "up", "p", "e", (F.col("b_e") - F.coalesce("b_p", F.lit(0))).alias("span"), F.coalesce("b_p", F.lit(0)).alias("before"))
    zero = F.lit(0).cast("long")
    top = full.sparkSession.range(1).select(root().alias("id"), F.lit(None).cast("struct<d:bigint,x:bigint,y:bigint>").alias("up"), F.lit(-1).cast("long").alias("p"), zero.alias("e"), zero.alias("span"), zero.alias("before"))
    nodes = below.unionByName(top).join(ends.select(F.col("key").alias("id"), "low", "n_convs"), "id", "left")
    nodes = written(nodes.withColumn("n_convs", F.coalesce("n_convs", zero)))
    members = gather(nodes, ("n_convs",), ("low",))
    children = nodes.where("up IS NOT NULL").groupBy("up").agg(F.count(F.lit(1)).alias("n_children")).withColumnRenamed("up", "id")
    nodes = written(nodes.drop("low", "n_convs").join(members, "id").join(children, "id", "left").where("low IS NOT NULL").select(
        "*", ((F.col("n_convs") - 1) * F.col("span")).alias("saved"), F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("leaves")))
    totals = gather(nodes, ("saved", "leaves"))
    first = nodes.where("e = 0").select("low").first()  # the root's smallest member
    hanging = F.col("up.d") > 0
    parents = nodes.where(hanging).select("id", "up").join(nodes.select(F.col("id").alias("up"), F.col("low").alias("parent")), "up").select("id", "parent")
    nodes = nodes.drop("saved", "leaves").join(totals, "id").join(parents, "id", "left").join(digests(full), "id", "left").withColumn(
        "parent", F.coalesce("parent", F.when(F.col("up.d") == 0, F.lit(first["low"] if first else None).cast("long"))))
    # An edge becomes its depths; only its lower end branches or has ends.
    rows = nodes.withColumn("depth", F.explode(F.sequence(F.col("p") + 1, F.col("e"))))
    rows = rows.join(paths.select(F.col("conv").alias("low"), F.col("d").alias("depth"), "bytes", "upto"), ["low", "depth"], "left")
    last = F.col("depth") == F.col("e")
    passed = (F.col("n_convs") - 1) * (F.coalesce(F.col("upto") - F.col("bytes"), zero) - F.col("before"))
    return rows.select(
        F.col("low").alias("conv_id"), "depth", F.when(F.col("depth") == F.col("p") + 1, F.col("parent")).otherwise(F.col("low")).alias("parent_conv_id"), "n_convs",
        F.when(last, F.coalesce("n_children", zero)).otherwise(1).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"), (F.col("saved") - passed).alias("saved_tokens"),
        F.when(last & F.col("ends_sha256").isNotNull(), F.col("ends_sha256")).otherwise(F.sha2(F.lit(""), 256)).alias("ends_sha256"))
