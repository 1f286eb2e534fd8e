"""Near duplicates: large groups of distinct near copies, depth of the trees, repeated ids."""

import hashlib
import random
import time

import numpy as np

from isoqt.llm import common, near_dedup

SCHEMA = "doc_id long, text string"


def brute(rows, width=4):
    """All pairs at 80 or more by the product of the 0/1 matrix of documents and shingles."""
    words = [t.split() for _, t in rows]
    sets = [{tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set() for w in words]
    column = {g: i for i, g in enumerate({g for s in sets for g in s})}
    held = np.zeros((len(rows), len(column)), np.float32)
    for i, s in enumerate(sets):
        held[i, [column[g] for g in s]] = 1
    size, both = held.sum(axis=1), held @ held.T
    linked = (100 * both >= 80 * (size[:, None] + size[None, :] - both)) & (both > 0)
    return {(rows[a][0], rows[b][0]) for a, b in zip(*np.nonzero(linked)) if a < b}


def lowest(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_many_distinct_near_copies(spark):
    """2,000 different copies of one text, some so far off that only a few of the others hold them, and strangers in the same branch."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(2000):
        words = list(base)
        for _ in range(1 if i % 20 else 3):
            words[rng.randrange(100)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(5000 + i, " ".join(base[:50] + [f"s{i}_{k}" for k in range(8)])) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    start = time.time()
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.components(df, leaf=64).collect()}
    print("components", time.time() - start)
    want = lowest([i for i, _ in rows], brute(rows))
    # Links that only one pair makes are found with the probability of the trees; here none may be lost.
    assert got == want


def test_cut_branches_are_exact(spark):
    """With no level every pair with a common root meets: a chain of documents, each similar to its neighbours alone."""
    common = " ".join(f"c{i}" for i in range(40))
    chain = [" ".join(f"n{k}" for k in range(i * 3, i * 3 + 60)) for i in range(100)]
    rows = [(i, t) for i, t in enumerate(chain)] + [(1000 + i, common + f" end{i}") for i in range(150)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = lowest([i for i, _ in rows], brute(rows))
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.components(df, leaf=8, levels=0, trees=24).collect()}
    assert got == want and want[1149] == 1000


def test_license_pairs(spark):
    """A shared passage is no reason to link, and its branch must not hide the pairs inside."""
    rng = random.Random(9)
    license_ = " ".join(f"l{i}" for i in range(90))
    rows = []
    for k in range(300):
        body = [f"b{k}_{j}" for j in range(120)]
        other = list(body)
        for _ in range(3):
            other[rng.randrange(120)] = f"y{rng.randrange(10**6)}"
        rows += [(2 * k, license_ + " " + " ".join(body)), (2 * k + 1, license_ + " " + " ".join(other))]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.components(df, leaf=16).collect()}
    assert got == lowest([i for i, _ in rows], brute(rows))


def test_keep_one_is_by_row(spark):
    text = "one text of some words that two rows have in common and others lack"
    schema = "doc_id long, text string, __gone int, __key int"
    rows = [(1, text, 0, 0), (2, text, 0, 1), (2, "another text altogether that has nothing to do with it", 0, 2), (3, "a third one", 0, 3), (3, "a third one", 0, 4),
            (None, text, 0, 5), (None, "no id but a text", 0, 6), (None, "no id but a text", 0, 7), (4, None, 0, 8), (4, None, 0, 9), (5, "", 0, 10)]
    kept = near_dedup.keep_one(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept) == sorted(
        [(1, text), (2, rows[2][1]), (3, "a third one"), (0, text), (0, "no id but a text"), (0, "no id but a text"), (4, ""), (4, ""), (5, "")])
    assert near_dedup.keep_one(spark.createDataFrame([], schema)).columns == ["doc_id", "text", "__gone", "__key"]


def test_bucketed_table_leaves_the_catalog(spark):
    """The named table of a search is dropped; null, empty, short and repeated texts keep their defined results."""
    rows = [(1, "one two three four five six"), (2, "ONE two three four five six"), (3, "x"), (4, None), (5, ""), (5, "x"), (None, "y z")]
    got = near_dedup.components(spark.createDataFrame(rows, SCHEMA)).collect()
    want = [(1, 3, 1), (2, 3, 1), (3, 1, 3), (4, 0, 4), (5, 0, 5), (5, 1, 3), (None, 1, None)]
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted((tuple(r)[:3] for r in got), key=key) == sorted(want, key=key)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("llm_")]


def test_open_squares_grow_with_the_rows(spark, monkeypatch):
    """Strangers around a shared passage in one cut branch: squares of open pairs must not be made for all of them, and no link may be lost."""
    rng = random.Random(10)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(500):
        own = [f"o{i}_{k}" for k in range(25)]
        rows.append((i, " ".join(passage + own)))
        if i % 50 == 0:  # a copy at about the limit, some above and some below
            own[rng.randrange(12) : 12 + i // 100] = [f"z{i}"]
            rows.append((1000 + i, " ".join(passage + own)))
    made, whole = [], near_dedup.outsiders

    def counted(family, labels):
        out = whole(family, labels)
        made.append(out.count())
        return out

    monkeypatch.setattr(near_dedup, "outsiders", counted)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.components(df, leaf=64, levels=0).collect()}
    want = lowest([i for i, _ in rows], brute(rows))
    print("squares", made, "links", sum(i != c for i, c in want.items()))
    assert got == want and any(i != c for i, c in want.items())
    assert made[0] <= 2 * len(rows)


def joined_rows(spark, skip: int) -> int:
    """Rows that joins have made since ``skip`` executions."""
    store, made = spark._jsparkSession.sharedState().statusStore(), 0
    runs = store.executionsList()
    for run in [runs.apply(at).executionId() for at in range(skip, runs.size())]:
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for node in (n for n in (nodes.apply(k) for k in range(nodes.size())) if "Join" in n.name()):
            metrics = (node.metrics().apply(k) for k in range(node.metrics().size()))
            counts = [values.get(m.accumulatorId()) for m in metrics if m.name() == "number of output rows"]
            made += sum(int(v.get().replace(",", "")) for v in counts if v.isDefined())
    return made


def test_spread_reads_no_link_again(spark, tmp_path):
    """A family of twelve trees, a chain and pairs: labels are right, also on top of known ones, and rows of joins follow the links, not links times rounds."""
    name = lambda i: hashlib.md5(str(i).encode()).digest()
    links = [(n, 10_000 + c) for n in range(500) for c in range(12)] + [(20_000 + i, 20_001 + i) for i in range(200)] + [(30_000 + 2 * i, 30_001 + 2 * i) for i in range(100)]
    pairs = [(name(a), name(b)) for a, b in links]
    spark.createDataFrame(pairs, "a binary, b binary").repartition(4).write.parquet(f"{tmp_path}/links")
    df = spark.read.parquet(f"{tmp_path}/links")
    want = lowest({n for p in pairs for n in p}, pairs)
    skip = spark._jsparkSession.sharedState().statusStore().executionsCount()
    got = {bytes(r["node"]): bytes(r["label"]) for r in near_dedup.spread(df).collect()}
    rows = joined_rows(spark, skip)
    print("rows of joins", rows, "links", len(pairs))
    assert got == want
    assert rows <= 4.5 * len(pairs)
    more = [(name(0), name(20_003)), (name(20_150), name(7)), (name(30_000), name(40_000)), (name(40_001), name(40_002)), (name(40_002), name(40_000)), (name(50_000), name(50_001))]
    for extra in (more, []):
        again = near_dedup.spread(spark.createDataFrame(extra, "a binary, b binary"), near_dedup.spread(df)).collect()
        assert {bytes(r["node"]): bytes(r["label"]) for r in again} == lowest({n for p in pairs + extra for n in p}, pairs + extra)
    assert near_dedup.spread(df.limit(0)).count() == 0


def test_broadcasts_do_not_follow_the_session(spark, monkeypatch):
    """Joins inside the search go by its own limit, not by that of the session, so that what the driver holds does not grow with the data."""
    name, plans, write = "spark.sql.autoBroadcastJoinThreshold", [], near_dedup.written
    before = spark.conf.get(name)

    def planned(df, *sort):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, *sort)

    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[:59] + [f"x{i}"])) for i in range(40)] + [(100 + i, f"alone {i} of many words {i}") for i in range(40)] + [(200, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    monkeypatch.setattr(common, "SLIM", -1, raising=False)
    monkeypatch.setattr(near_dedup, "FEW", -1, raising=False)
    monkeypatch.setattr(near_dedup, "written", planned)
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.components(df, leaf=16).collect()} == {i: max(0, i - 39) and i for i, _ in rows}
    near_dedup.keep_one(df)
    assert len(plans) > 20 and not [p for p in plans if "Broadcast" in p]
    assert spark.conf.get(name) == before
    spark.conf.set(name, "512k")
    try:
        monkeypatch.setattr(common, "SLIM", 1 << 20, raising=False)
        with common.slim_broadcasts(spark):  # a lower limit stays
            assert spark.conf.get(name) == str(512 << 10)
        assert spark.conf.get(name) == "512k"
    finally:
        spark.conf.set(name, before)
