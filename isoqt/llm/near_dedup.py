"""Near duplicates by chosen-path similarity join over minwise tokens, confirmed on full shingle sets.

1. Every document becomes its set of word shingles, a 128 bit fingerprint of the set, ``SKETCH`` minwise values and one
   minwise root token for each of ``trees`` independent trees. Documents with equal sets are one node from here on.
2. A tree sends a node to the branch of its root token. Branches of at most ``leaf`` nodes are leaves. A larger branch
   chooses a position by a hash of its own path, and a second one with probability ``SECOND``, and sends each node on by
   its minwise values there: about 1.25 copies of a node for each level, so a pair of similarity 0.8 has one common
   branch a level in the mean. The chance that a tree of d levels brings the pair into one leaf is 0.8 (1 - q_d) with
   q_0 = 0, q_d = (0.2 + 0.8 q)(0.8 + 0.2 q): 0.67, 0.58, 0.51, 0.46 for one to four levels, 0.34 for eight. Twelve trees miss it with
   2e-6, 3e-5, 2e-4, 6e-4 and 7e-3; pairs above 0.8, and pairs that other documents connect, far more seldom.
3. A branch that hardly shrinks (near copies of one text), or is still large at the last level, is cut. Cut branches
   that share a node are one family over all trees. A family is dealt into blocks of ``leaf`` nodes, and ``PIVOTS`` of
   its nodes join every block: rows grow with the family, not with its square.
4. In a leaf or block all sketches are compared; nodes that may be similar (estimate within about five standard
   deviations) form clusters. The clusters of the first tree and of the blocks are compared exactly, all pairs, and
   labels spread along the links. In clusters of the other trees one node stands for each label; those pairs, made
   distinct over all trees, are compared exactly and labels spread again.
5. What is still open are pairs with agreeing sketches and different labels: those of a cluster, distinct over all trees,
   and those of a family. Most nodes of a family are refuted without a partner: a pair of similarity 0.8 shares one of the
   rarest shingles of both, so far to the front that the rest of each set is large enough, and only nodes that have such a shingle in common
   with another label stay, in new families by these shingles. There a node outside the main label meets every other node, in
   squares of ``SIDE`` by ``SIDE``. All are compared exactly. A pair that met in a leaf or a cut branch is therefore linked, refuted, or in one component already;
   only pairs that no tree brought together can be lost.
6. Labels spread along all links until they are stable; the smallest doc_id reachable names the component.

Defined cases: a null, empty or blank text has an empty set and stays alone; fewer words than a shingle make one
shingle; ids may repeat or be null (a null id keeps its row, its component is the smallest id of its group, or null);
texts are taken whole; other columns are ignored or, in ``keep_one``, passed on. Shingles are compared by 64 bit hashes.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from isoqt.llm.common import bucketed, kept_table, scratch, slim_broadcasts, small_or_shuffled, written

SKETCH, TREES, LEAF, LEVELS = 128, 12, 128, 8
#: One second position for so many branches; nodes that meet every block of a branch that is cut.
SECOND, PIVOTS = 4, 32
#: A branch that keeps more of the one above it than this is near copies of one text, which more levels do not part.
STUCK = 0.6
#: Bits of the filter that finds the rows whose texts are needed; its size does not grow with the data.
FILTER_BITS = 1 << 25
#: Nodes of each side in a leaf of open pairs, and stretches of the pairs of one node.
SIDE, STRETCHES = 48, 8
#: Counters by which shingles are ordered, and the pieces they are summed in; their size does not grow with the data.
COUNTERS, PIECES = 1 << 21, 64
#: Cut branches of which one node each is broadcast (some 14 MB); of more, the join shuffles.
FEW = 100_000
#: Sketch positions that must agree for a pair to be compared exactly: five standard deviations under 0.8.
AGREE = 80
_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_RNG = np.random.default_rng(20)
_MULTIPLY = (_RNG.integers(0, 1 << 32, SKETCH, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_ADD = _RNG.integers(0, 1 << 32, SKETCH, dtype=np.uint64).astype(np.uint32)


def roots_of(trees: int) -> np.ndarray:
    """Odd multipliers that order the shingles for the root of each tree."""
    return np.random.default_rng(21).integers(0, 1 << 63, trees, dtype=np.uint64) | np.uint64(1)


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; A-Z are lower-cased, words end at ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_UPPER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - width + 1)
    out = np.full(n, len(words[:width]), np.uint64)
    for k in range(min(width, len(words))):
        out = (out ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def minwise(shingle: np.ndarray, multipliers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(SKETCH values of 16 bits, a root token of 63 bits for each tree)."""
    low = np.full(SKETCH, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(shingle), 512):
        x = (shingle[at : at + 512] >> np.uint64(32)).astype(np.uint32)
        np.minimum(low, (x[:, None] * _MULTIPLY + _ADD).min(axis=0), out=low)
    roots = np.array([(shingle * m).min() for m in multipliers], np.uint64)
    mixed = low * np.uint32(0x85EBCA6B)
    return (mixed >> np.uint32(16)).astype(np.uint16), (roots >> np.uint64(1)).astype(np.int64)


def sketches(docs: DataFrame, width: int, trees: int) -> DataFrame:
    """Doc_id, text key, set size, node (fingerprint of the set), sketch (low bytes of the minwise values), upper (high bytes) and root tokens of every row.

    Comparing low bytes alone finds every agreement of whole values, and half the bytes travel; branches use both bytes.
    """
    multipliers = roots_of(trees)

    def run(batches):
        for batch in batches:
            sizes, nodes, lows, highs, roots = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                s = shingles(text, width)
                sizes.append(len(s))
                low, root = minwise(s, multipliers) if len(s) else (None, None)
                nodes.append(xxh3_128_digest(s.tobytes()) if len(s) else None)
                lows.append(low.astype(np.uint8).tobytes() if len(s) else None)
                highs.append((low >> np.uint16(8)).astype(np.uint8).tobytes() if len(s) else None)
                roots.append(root.tolist() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tkey"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()),
                                              pa.array(lows, pa.binary()), pa.array(highs, pa.binary()), pa.array(roots, pa.list_(pa.int64()))],
                                             names=["doc_id", "tkey", "n", "node", "sketch", "upper", "roots"])

    text = F.col("text").cast("string")
    return docs.select("doc_id", F.xxhash64(text).alias("tkey"), text.alias("text")).mapInArrow(
        run, f"doc_id {dict(docs.dtypes)['doc_id']}, tkey long, n long, node binary, sketch binary, upper binary, roots array<long>")


def groups_of(batches, key: str):
    """Record batches of a partition sorted by ``key`` as lists of whole groups: (table, group starts). The last group waits for the next batch."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]).combine_chunks() if rest is not None else table
        keys = table[key].to_numpy()
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
        if len(starts) > 1:
            yield table.slice(0, starts[-1]), starts[:-1]
            rest = table.slice(starts[-1])
        elif len(keys):
            rest = table
    if rest is not None and len(rest):
        yield rest, np.zeros(1, int)


def having(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``docs`` (key, ...) that may have one of ``keys`` (key): a Bloom filter of fixed size, so that other texts are not moved.

    Few bits go to the driver (4 MB); when keys outgrow the filter more rows pass, and the exact join that follows drops them.
    """
    spot = F.shiftright(F.xxhash64("key"), 64 - (FILTER_BITS.bit_length() - 1)) + FILTER_BITS // 2
    words = keys.select(spot.alias("spot")).select(F.shiftright("spot", 5).alias("word"), F.pmod("spot", F.lit(32)).cast("int").alias("bit")).groupBy("word").agg(
        F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    filled = np.zeros(FILTER_BITS // 32, np.uint32)
    table = words.toArrow()  # at most FILTER_BITS / 32 rows
    filled[table["word"].to_numpy()] = table["bits"].to_numpy().astype(np.uint32)
    sent = docs.sparkSession.sparkContext.broadcast(filled)

    def run(batches):
        held = sent.value
        for batch in batches:
            at = batch.column("spot").to_numpy()
            hit = (held[at >> 5] >> (at & 31).astype(np.uint32)) & np.uint32(1)
            yield batch.filter(pa.array(hit.astype(bool)))

    spotted = docs.withColumn("spot", spot)
    return spotted.mapInArrow(run, spotted.schema).drop("spot")


def parts_of(n: int, pairs) -> np.ndarray:
    """Smallest member of the connected part of each of ``n`` members."""
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return np.array([find(i) for i in range(n)])


def branches(reps: DataFrame, leaf: int, levels: int) -> tuple[DataFrame, DataFrame]:
    """((leaf key, node, first: of the first tree) of all leaves of at most ``leaf`` nodes, (branch, node) of the branches that were cut)."""
    slim = reps.select("node", "sketch", "upper")
    level = reps.select(F.posexplode("roots").alias("tree", "root"), "node").select(F.xxhash64("tree", "root").alias("h"), "node", (F.col("tree") == 0).alias("first"), F.lit(None).cast("long").alias("above"))
    leaves, cuts = [], []
    for depth in range(levels + 1):
        sizes = level.groupBy("h").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        live = written(level.join(sizes, "h"))
        leaves.append(live.where(F.col("size") <= leaf).select("h", "node", "first"))
        big = live.where(F.col("size") > leaf)
        stuck = F.lit(True) if depth == levels else F.coalesce(F.col("size") > STUCK * F.col("above"), F.lit(False))
        cuts.append(big.where(stuck).select("h", "node"))
        big = big.where(~stuck)
        if depth == levels or big.isEmpty():
            break
        at = lambda j: F.pmod(F.xxhash64("h", F.lit(j)), F.lit(SKETCH)).cast("int")
        step = lambda j: F.xxhash64("h", at(j), *[F.expr(f"substring({c}, int(pmod(xxhash64(h, {j}), {SKETCH})) + 1, 1)") for c in ("sketch", "upper")])
        two = F.pmod(F.xxhash64("h", F.lit("second")), F.lit(SECOND)) == 0  # by branch, so that both of a pair take it
        chosen = F.when(two, F.array_distinct(F.array(step(0), step(1)))).otherwise(F.array(step(0)))
        level = big.join(slim, "node").select(F.explode(chosen).alias("h"), "node", "first", F.col("size").alias("above"))
    return union(leaves), union(cuts)


def families(cut: DataFrame) -> DataFrame:
    """(family, node): cut branches that share nodes are one family."""
    low = small_or_shuffled(written(cut.groupBy("h").agg(F.min("node").alias("b"))), FEW)
    links = cut.join(low, "h").where("node <> b").select(F.col("node").alias("a"), "b").distinct()
    return spread(written(links)).select(F.col("label").alias("family"), "node")


def blocks(family: DataFrame, leaf: int) -> DataFrame:
    """(h, node, first): blocks of about ``leaf`` nodes of a family, each with the family's pivots."""
    sized = family.join(family.groupBy("family").agg(F.count(F.lit(1)).alias("size")), "family")
    count = F.ceil(F.col("size") / leaf).cast("int")
    block = F.pmod(F.xxhash64("node", F.lit("block")), count).cast("int")
    pivot = F.pmod(F.xxhash64("node", F.lit("pivot")), F.lit(1 << 20)) < (F.lit(PIVOTS << 20) / F.col("size"))
    own = sized.select("family", "node", block.alias("block"))
    met = sized.where(pivot).select("family", "node", F.explode(F.sequence(F.lit(0), count - 1)).alias("block"))
    return own.unionByName(met).distinct().select(F.xxhash64(F.lit("block"), "family", "block").alias("h"), "node", F.lit(True).alias("first"))


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def alike(sketch: np.ndarray, size: np.ndarray, i: int, rest: slice, agree: int, percent: int) -> np.ndarray:
    """Which of ``rest`` may be similar to node ``i`` by sketches and set sizes."""
    return ((sketch[i] == sketch[rest]).sum(axis=1) >= agree) & (100 * np.minimum(size[i], size[rest]) >= percent * np.maximum(size[i], size[rest]))


def clusters(leaves: DataFrame, reps: DataFrame, agree: int, percent: int) -> DataFrame:
    """(cluster, node, first) rows: nodes of a leaf that sketches and set sizes connect; equal clusters are one."""

    def run(batches):
        for table, starts in groups_of(batches, "h"):
            sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(-1, SKETCH)
            size, node, first = table["n"].to_numpy(), table["node"].to_pylist(), table["first"].to_pylist()
            ends = np.r_[starts[1:], len(size)]
            keys, members, firsts = [], [], []

            def emit(rows):
                ids = sorted({node[i] for i in rows})
                if len(ids) > 1:
                    key = xxh3_64_intdigest(b"".join(ids)) - (1 << 63)
                    keys.extend([key] * len(ids))
                    members.extend(ids)
                    firsts.extend([first[rows[0]]] * len(ids))

            two = starts[ends - starts == 2]
            near = ((sketch[two] == sketch[two + 1]).sum(axis=1) >= agree) & (100 * np.minimum(size[two], size[two + 1]) >= percent * np.maximum(size[two], size[two + 1]))
            for a in two[near]:
                emit((a, a + 1))
            for a, b in zip(starts, ends):
                if b - a < 3:
                    continue
                pairs = []
                for i in range(a, b - 1):
                    hit = alike(sketch, size, i, slice(i + 1, b), agree, percent)
                    pairs += [(i - a, int(j) + i + 1 - a) for j in np.flatnonzero(hit)]
                if pairs:
                    part = parts_of(b - a, pairs)
                    for p in np.unique(part):
                        emit(np.flatnonzero(part == p) + a)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(members, pa.binary()), pa.array(firsts, pa.bool_())], names=["cluster", "node", "first"])

    rows = leaves.join(reps.select("node", "n", "sketch"), "node").select("h", "node", "n", "sketch", "first")
    found = rows.repartition("h").sortWithinPartitions("h").mapInArrow(run, "cluster long, node binary, first boolean")
    return found.groupBy("cluster", "node").agg(F.max("first").alias("first"))


def common(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of the sizes of all pairwise intersections, in slices of the distinct shingles."""
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    out = np.zeros((len(sets), len(sets)), np.float64)
    for at in range(0, len(values), 16384):
        lo, hi = np.searchsorted(column, [at, at + 16384])
        block = np.zeros((len(sets), min(16384, len(values) - at)), np.float32)
        block[row[lo:hi], column[lo:hi] - at] = 1
        out += block @ block.T
    return out


def confirm(clustered: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (node, root) of every cluster from exact comparison of all its pairs: a star for each connected part."""

    def run(batches):
        memo: OrderedDict[bytes, np.ndarray] = OrderedDict()

        def shingles_of(node, text):
            if node not in memo:
                memo[node] = shingles(text, width)
                if len(memo) > 1000:
                    memo.popitem(last=False)
            return memo[node]

        for table, starts in groups_of(batches, "cluster"):
            node, text = table["node"].to_pylist(), table["text"].to_pylist()
            a_side, b_side = [], []
            for a, b in zip(starts, np.r_[starts[1:], len(node)]):
                sets = [shingles_of(node[i], text[i]) for i in range(a, b)]
                size = np.array([len(s) for s in sets])
                if b - a == 2:
                    both = len(np.intersect1d(*sets, assume_unique=True))
                    pairs = [(0, 1)] if 100 * both >= percent * (size.sum() - both) else []
                else:
                    both = common(sets)
                    pairs = list(zip(*np.nonzero(np.triu(100 * both >= percent * (size[:, None] + size[None, :] - both), 1))))
                for i, r in enumerate(parts_of(b - a, pairs)):
                    if i != r:
                        a_side.append(node[a + i])
                        b_side.append(node[a + r])
            yield pa.RecordBatch.from_arrays([pa.array(a_side, pa.binary()), pa.array(b_side, pa.binary())], names=["a", "b"])

    rows = clustered.select("cluster", "node").join(texts, "node").select("cluster", "node", "text")
    return rows.repartition("cluster").sortWithinPartitions("cluster", "node").mapInArrow(run, "a binary, b binary").distinct()


def named(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with the label of their node; a node without links is its own."""
    return rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def mixed(found: DataFrame, labels: DataFrame) -> DataFrame:
    """(h, node, label) of the clusters with more than one label."""
    rows = written(named(found.select("cluster", "node"), labels))
    more = rows.groupBy("cluster").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("cluster")
    return rows.join(more, "cluster").select(F.col("cluster").alias("h"), "node", "label")


def counters(texts: DataFrame, width: int) -> np.ndarray:
    """About how many of ``texts`` hold a shingle, by its top bits (2 bytes for each of ``COUNTERS``, 4 MB in all): any order of the shingles is a right one, a good one puts rare ones first."""
    length = COUNTERS // PIECES

    def count(batches):
        held = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held[slots_of(shingles(text, width))] += 1
        used = np.flatnonzero(held)
        pieces, starts = np.unique(used // length, return_index=True)
        parts = np.split(used, starts[1:]) if len(used) else []
        yield pa.RecordBatch.from_arrays([pa.array(pieces, pa.int64()), pa.array([(p % length).tolist() for p in parts], pa.list_(pa.int32())),
                                          pa.array([held[p].tolist() for p in parts], pa.list_(pa.int64()))], names=["piece", "at", "held"])

    def add(batches):
        sums = {}
        for batch in batches:
            for piece, at, held in zip(*(batch.column(i).to_pylist() for i in range(3))):
                sums.setdefault(piece, np.zeros(length, np.int64))[at] += held
        packed = [np.minimum(v, 0xFFFF).astype(np.uint16).tobytes() for v in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(packed, pa.binary())], names=["piece", "sums"])

    counted = texts.select("text").mapInArrow(count, "piece long, at array<int>, held array<long>")
    out = np.zeros((PIECES, length), np.uint16)
    for row in counted.repartition("piece").mapInArrow(add, "piece long, sums binary").toArrow().to_pylist():  # at most PIECES rows
        out[row["piece"]] = np.frombuffer(row["sums"], np.uint16)
    return out.ravel()


def slots_of(shingle: np.ndarray) -> np.ndarray:
    return (shingle >> np.uint64(64 - (COUNTERS.bit_length() - 1))).astype(np.int64)


def rare(texts: DataFrame, labels: DataFrame, width: int, percent: int) -> DataFrame:
    """(h, node) rows: the nodes of ``texts`` (node, text) that may be similar to a node with another label, by shared rare shingles.

    Shingles have one order for all sets. Of a similar pair, the first common shingle stands at a place in either set that leaves
    enough behind it for the intersection, so only the front of a set counts, and of that only what another label has there too.
    """
    sent = texts.sparkSession.sparkContext.broadcast(counters(texts, width))

    def run(batches):
        held = sent.value
        for batch in batches:
            tokens, places, rows = [], [], []
            sizes = np.zeros(batch.num_rows, np.int64)
            for i, text in enumerate(batch.column("text").to_pylist()):
                s = shingles(text, width)
                front = np.lexsort((s, held[slots_of(s)]))[: len(s) + (-percent * len(s)) // 100 + 1]
                tokens.append(s[front].astype(np.int64))
                places.append(np.arange(len(front)))
                rows.append(np.full(len(front), i))
                sizes[i] = len(s)
            rows = np.concatenate(rows) if rows else np.zeros(0, np.int64)
            join = lambda parts: pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64())
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([join(tokens), batch.column("node").take(at), batch.column("label").take(at), pa.array(sizes[rows], pa.int64()), join(places)],
                                             names=["h", "node", "label", "n", "place"])

    rows = written(named(texts, labels).select("node", "label", "text").mapInArrow(run, "h long, node binary, label binary, n long, place long"))
    for _ in range(2):
        shared = rows.groupBy("h").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("n").alias("least")).where("low <> high").select("h", "least")
        partner = F.greatest("least", F.ceil(percent * F.col("n") / 100))
        rows = written(rows.join(shared, "h").where(F.col("place") <= F.col("n") - F.ceil(percent * (F.col("n") + partner) / (100 + percent))).select("h", "node", "label", "n", "place"))
    shared = rows.groupBy("h").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("h")
    return rows.join(shared, "h").select("h", "node")


def outsiders(family: DataFrame, labels: DataFrame) -> DataFrame:
    """(h, node, label): squares of the nodes outside the main label of a family against all nodes of the family."""
    rows = written(named(family, labels))
    top = rows.groupBy("family", "label").count().groupBy("family").agg(F.max(F.struct("count", "label")).alias("top"), F.sum("count").alias("n"))
    main = top.select("family", F.col("top.label").alias("main"), "n", (F.col("n") - F.col("top.count")).alias("others")).where("others > 0")
    rest = rows.join(main, "family")
    of = lambda count: F.ceil(F.col(count) / SIDE).cast("int")
    side = lambda count: F.pmod(F.xxhash64("node", F.lit(count)), of(count)).cast("int")
    outside = rest.where(F.col("label") != F.col("main")).select("family", "node", "label", side("others").alias("a"), F.explode(F.sequence(F.lit(0), of("n") - 1)).alias("b"))
    every = rest.select("family", "node", "label", F.explode(F.sequence(F.lit(0), of("others") - 1)).alias("a"), side("n").alias("b"))
    return outside.unionByName(every).select(F.xxhash64(F.lit("square"), "family", "a", "b").alias("h"), "node", "label").distinct()


def open_pairs(groups: DataFrame, reps: DataFrame, agree: int, percent: int, whole: bool) -> DataFrame:
    """Pairs of a group whose labels differ and whose sketches agree: distinct (a, b), or with ``whole`` (cluster, node) of all nodes in such pairs of a group."""

    def run(batches):
        for table, starts in groups_of(batches, "h"):
            sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(-1, SKETCH)
            size, node, key = table["n"].to_numpy(), table["node"].to_pylist(), table["h"].to_pylist()
            label = np.unique(np.array(table["label"].to_pylist(), dtype=object), return_inverse=True)[1]
            left, right = [], []
            for a, b in zip(starts, np.r_[starts[1:], len(size)]):
                members = set()
                for i in range(a, b - 1):
                    rest = slice(i + 1, b)
                    for j in np.flatnonzero(alike(sketch, size, i, rest, agree, percent) & (label[rest] != label[i])) + i + 1:
                        if whole:
                            members |= {node[i], node[j]}
                        else:
                            low, high = sorted((node[i], node[j]))
                            left.append(low)
                            right.append(high)
                left.extend([key[a]] * len(members))
                right.extend(sorted(members))
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64() if whole else pa.binary()), pa.array(right, pa.binary())], names=names)

    names = ["cluster", "node"] if whole else ["a", "b"]
    rows = groups.join(reps.select("node", "n", "sketch"), "node").select("h", "node", "n", "sketch", "label")
    out = rows.repartition("h").sortWithinPartitions("h").mapInArrow(run, f"{names[0]} {'long' if whole else 'binary'}, {names[1]} binary")
    return out if whole else out.distinct()


def confirm_pairs(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets are similar: the text of ``a`` travels once for a stretch of its partners."""

    def run(batches):
        centre, held = None, None
        for batch in batches:
            key, first, node, text = (batch.column(i).to_pylist() for i in range(4))
            a_side, b_side = [], []
            for k, is_first, n, t in zip(key, first, node, text):
                s = shingles(t, width)
                if is_first:
                    centre, held = (k, n), s
                elif centre is not None and centre[0] == k:
                    both = len(np.intersect1d(held, s, assume_unique=True))
                    if 100 * both >= percent * (len(held) + len(s) - both):
                        a_side.append(n)
                        b_side.append(centre[1])
            yield pa.RecordBatch.from_arrays([pa.array(a_side, pa.binary()), pa.array(b_side, pa.binary())], names=["a", "b"])

    stars = written(pairs.select(F.xxhash64("a", F.pmod(F.xxhash64("b"), F.lit(STRETCHES))).alias("star"), "a", "b"))
    rows = stars.select("star", F.lit(True).alias("first"), F.col("a").alias("node")).distinct().unionByName(stars.select("star", F.lit(False).alias("first"), F.col("b").alias("node")))
    rows = rows.join(texts, "node").select("star", "first", "node", "text")
    return rows.repartition("star").sortWithinPartitions("star", F.desc("first")).mapInArrow(run, "a binary, b binary")


def spread(links: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(node, label): the smallest node of each connected component of ``links`` (a, b) and of the components that ``labels`` name already.

    A round sends every node to the smallest of its neighbours and on to the end of that way, then puts these in the place of the ends of
    the links. Links inside a group go, equal ones become one, so a round has at most half the nodes in the mean and no link is read twice.
    """
    edges, steps = written(between(links, labels)), [] if labels is None else [labels]
    while not edges.isEmpty():
        ends = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step, moving = ends.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("label")), True
        while moving:
            on = step.select(F.col("node").alias("label"), F.col("label").alias("far"))
            jumped = written(step.join(on, "label").select("node", "label", "far"))
            step, moving = jumped.select("node", F.col("far").alias("label")), not jumped.where("label <> far").isEmpty()
        steps.append(step)
        edges = written(between(edges, step))
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    labels = steps[0]
    for step in steps[1:]:  # nodes that were in no component yet come in by the step alone
        onward = step.select(F.col("node").alias("at"), F.col("label").alias("to"))
        labels = labels.join(onward, labels["label"] == onward["at"], "full").select(F.coalesce("node", "at").alias("node"), F.coalesce("to", "label").alias("label"))
    return written(labels) if len(steps) > 1 else labels


def between(links: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Distinct (a, b), a below b: ``links`` with the label in the place of every node that has one."""
    if labels is not None:
        to = lambda end: labels.select(F.col("node").alias(end), F.col("label").alias(f"{end}_to"))
        links = links.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("a_to", "a").alias("a"), F.coalesce("b_to", "b").alias("b"))
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def grouped(docs: DataFrame, width: int, percent: int, trees: int, leaf: int, levels: int) -> DataFrame:
    """Doc_id, tkey, n, label of every row of ``docs`` (doc_id, text); the label of a row without shingles is null."""
    with scratch(docs.sparkSession), slim_broadcasts(docs.sparkSession):
        rows = written(sketches(docs, width, trees))
        # One row for each set; any row of the node will do for sketch and text, the smallest key is taken.
        chosen = F.min_by(F.struct("tkey", "n", "sketch", "upper", "roots"), "tkey")
        reps = bucketed(rows.where("n > 0").groupBy("node").agg(chosen.alias("one")).select("node", "one.*"), "node")
        leaves, cut = branches(reps, leaf, levels)
        family = written(families(cut))
        found = written(clusters(leaves, reps, AGREE, percent))
        dense = written(clusters(blocks(family, leaf), reps, AGREE, percent))
        # One row of ``docs`` answers for a node: of the rows with its text key one id, so copies stay where they are.
        wanted = found.select("node").unionByName(family.select("node")).distinct().join(reps.select("node", "tkey"), "node")
        ids = rows.join(wanted.select("tkey").distinct(), "tkey", "left_semi").groupBy("tkey").agg(F.min("doc_id").alias("doc_id"))
        wanted = written(wanted.join(ids, "tkey").select("node", F.xxhash64("tkey", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("key")))
        text = F.col("text").cast("string")
        moved = having(docs.select(F.xxhash64(F.xxhash64(text), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("key"), text.alias("text")), wanted.select("key"))
        # A key is one node, so one shuffle by key serves both the copies of a row and the join.
        texts = written(moved.groupBy("key").agg(F.first("text").alias("text")).join(wanted, "key").select("node", "text"))
        links = written(confirm(found.where("first").unionByName(dense).dropDuplicates(["cluster", "node"]), texts, width, percent))
        labels = spread(links)
        standing = mixed(found, labels).groupBy("h", "label").agg(F.min("node").alias("node"))
        tried = written(open_pairs(standing, reps, AGREE, percent, False))
        labels = spread(written(confirm_pairs(tried, texts, width, percent)), labels)
        pairs = written(open_pairs(mixed(found, labels), reps, AGREE, percent, False).join(tried, ["a", "b"], "left_anti"))
        near = written(families(written(rare(texts.join(family.select("node"), "node", "left_semi"), labels, width, percent))))
        squares = written(open_pairs(outsiders(near, labels), reps, AGREE, percent, True))
        last = written(confirm_pairs(pairs, texts, width, percent).unionByName(confirm(squares, texts, width, percent)))
        labels = spread(last, labels)
        full = rows.join(labels, "node", "left").select("doc_id", "tkey", "n", F.when(F.col("n") > 0, F.coalesce("label", "node")).alias("label"))
        return kept_table(full)


def components(docs: DataFrame, width: int = 4, percent: int = 80, trees: int = TREES, leaf: int = LEAF, levels: int = LEVELS) -> DataFrame:
    """Doc_id, n_shingles, component_id, kept of every row of ``docs`` (doc_id, text)."""
    full = grouped(docs, width, percent, trees, leaf, levels)
    lowest = full.where("n > 0").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    joined = full.where("n > 0").join(lowest, "label").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = full.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest doc_id, of those with one id the one with the smallest text key, of rows that
    repeat both, one. Rows without an id or without words stay; an id that repeats with another text is another document."""
    full = grouped(docs.select("doc_id", "text"), width, percent, TREES, LEAF, LEVELS).where("n > 0 AND doc_id IS NOT NULL")
    keys = full.groupBy("label", "doc_id", "tkey").agg(F.count(F.lit(1)).alias("copies"))
    first = full.groupBy("label").agg(F.min(F.struct("doc_id", "tkey")).alias("first"))
    with slim_broadcasts(docs.sparkSession):
        judged = written(keys.join(first, "label").select("doc_id", "tkey", "copies", ((F.col("first.doc_id") == F.col("doc_id")) & (F.col("first.tkey") == F.col("tkey"))).alias("stays")))
    own_id, own_key = (f"__{c}_{uuid.uuid4().hex}" for c in ("id", "key"))  # no column of ``docs`` has such a name
    names = lambda rows: rows.select(F.col("doc_id").alias(own_id), F.col("tkey").alias(own_key))
    same = (docs["doc_id"] == F.col(own_id)) & (F.xxhash64(docs["text"].cast("string")) == F.col(own_key))
    left = docs.join(small_or_shuffled(names(judged.where("NOT stays"))), same, "left_anti")
    repeated = small_or_shuffled(names(judged.where("stays AND copies > 1")))
    if repeated.isEmpty():
        return left
    once = docs.join(repeated, same, "left_semi").withColumn(own_key, F.xxhash64(docs["text"].cast("string"))).dropDuplicates(["doc_id", own_key]).drop(own_key)
    return left.join(repeated, same, "left_anti").unionByName(once)
