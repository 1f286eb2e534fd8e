"""Operators 11 to 13 against brute force on small tables with nulls, ties, repeats, long values and clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from isoqt.llm import conversation_trie, token_counts, vector_codes


def nearest(x, book):
    apart = [sum((a - b) ** 2 for a, b in zip(x, entry)) for entry in book]
    low = min(apart)
    return apart.index(low), low


def encoded(rows, parts, entries, rounds=2):
    kept = [(i, lab, v) for i, lab, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    cut = [(i, lab, [tuple(math.floor(256 * x) for x in v[p * len(v) // parts : (p + 1) * len(v) // parts]) for p in range(parts)]) for i, lab, v in kept]
    books = [[r[2][p] for r in cut[:entries]] for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            held = defaultdict(list)
            for r in cut:
                held[nearest(r[2][p], books[p])[0]].append(r[2][p])
            books[p] = [tuple(sum(c) // len(held[e]) for c in zip(*held[e])) if e in held else old for e, old in enumerate(books[p])]
    found, labels = [], defaultdict(int)
    for i, lab, v in cut:
        best = [nearest(v[p], books[p]) for p in range(parts)]
        error = sum(b for _, b in best)
        labels[lab] += error
        found.append((i, lab, "".join(f"{e:02x}" for e, _ in best), error))
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, code, error, labels[lab], digest) for i, lab, code, error in found), key=repr)


@pytest.mark.parametrize("spread", [0.02, 0.5, 40.0])
def test_vector_codes(spark, spread):
    rng = random.Random(3)
    rows = [(i, rng.choice([0, 1, None]), [float(np.float32(rng.gauss(0, spread))) for _ in range(8)]) for i in range(150)]
    rows += [(7, 0, rows[7][2])] * 30 + [(200, 1, None), (201, 1, [None] * 8), (202, 0, [float("nan")] * 8), (203, 0, [float("inf")] + [0.0] * 7), (None, 2, [0.25] * 8), (-5, None, [0.0] * 8)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<float>, code string").repartition(5)
    got = sorted(((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in vector_codes.encode(df, parts=4, entries=16).collect()), key=repr)
    assert got == encoded(rows, 4, 16)


def test_vector_codes_edges(spark):
    schema = "vec_id long, label int, embedding array<float>"
    assert vector_codes.encode(spark.createDataFrame([], schema)).count() == 0
    # Rows of another length than most, and lengths that do not divide, are dropped; fewer rows than entries.
    df = spark.createDataFrame([(1, 0, [1.0] * 16), (2, 0, [2.0] * 16), (3, 0, [1.0] * 32), (4, 0, [1.0] * 15), (5, 0, [])], schema)
    rows = vector_codes.encode(df).orderBy("vec_id").collect()
    assert [(r["vec_id"], r["code"], r["error"]) for r in rows] == [(1, "00" * 16, 0), (2, "01" * 16, 0)]


def test_slices_are_exact():
    rng = np.random.default_rng(5)
    for spread in (1, 3, 50, 10**6):
        book = rng.integers(-spread, spread + 1, (64, 4))
        x = rng.integers(-2 * spread, 2 * spread + 1, (500, 4))
        entry, error = vector_codes.Slices(book).nearest(x)
        apart = ((x[:, None] - book[None]) ** 2).sum(axis=2)
        assert (error == apart.min(axis=1)).all() and (entry == apart.argmin(axis=1)).all()
    # The first box holds few of the entries: the search is by slices, not by all distances.
    book, x = rng.integers(-1000, 1000, (64, 4)), rng.integers(-1000, 1000, (500, 4))
    slices = vector_codes.Slices(book)
    held = np.unpackbits(slices.box(x, np.full(500, slices.radius))[:, None].view(np.uint8), axis=1).sum(axis=1)
    assert held.mean() < 20


def test_token_counts(spark):
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(4)
    pool = list("aB'sTlLdé́İſK ẞ1½²<|>\n\t\x85　字🙂Σ") + ["<|endoftext|>", "<|startoftext|>", " the ", " and "]
    texts = [None, "", " ", "<|endoftext|>", "a<|endoftext|>b<|STARTOFTEXT|>", "the " * 5000, "x" * 3000, "é" * 2000] + ["".join(rng.choices(pool, k=rng.randint(0, 60))) for _ in range(400)]
    rows = [(i % 300 or None, t, "n") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(5)
    tokenizer = Tokenizer.from_file(path)
    want = sorted(((d, len((t or "").encode()), n := len(tokenizer.encode(t or "", add_special_tokens=False).ids), n > 2048) for d, t, _ in rows), key=repr)
    for common in (0, 20, 50_000):
        got = token_counts.count_tokens(df, path, common=common)
        assert sorted(map(tuple, got.collect()), key=repr) == want
    assert token_counts.count_tokens(df.limit(0), path).count() == 0


def test_frequent_is_bounded(spark):
    words = spark.range(1000).select(F.col("id").cast("string").alias("word"), (F.lit(10_000) / (F.col("id") + 1)).cast("long").alias("docs"), F.lit(2).alias("pieces"))
    found = token_counts.frequent(words, 100)
    assert 50 <= len(found) <= 100 and "0" in found
    assert token_counts.frequent(words.withColumn("docs", F.lit(5)), 100) == {}


def trie_of(rows):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append(((t is not None, t or 0), role or "", text or ""))
    own = {c: [(r, x) for _, r, x in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(math.fmod(c, 5))
        built[c] = tuple(own.get(base, [])[:h] + v[h:])
    members = defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    kids = defaultdict(list)
    for path in members:
        if path:
            kids[path[:-1]].append(path)
    saved, leaves = {}, {}
    for path in sorted(members, key=len, reverse=True):
        own_saving = (len(members[path]) - 1) * (len(path[-1][1].encode()) if path else 0)
        saved[path] = own_saving + sum(saved[k] for k in kids[path])
        leaves[path] = sum(leaves[k] for k in kids[path]) or 1
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(c for c in m if built[c] == p))).encode()).hexdigest()) for p, m in members.items())


def trie_rows(df):
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted(tuple(r[n] for n in names) for r in conversation_trie.nodes_of(df).collect())


def test_conversation_trie(spark):
    rng = random.Random(6)
    rows = []
    for c in [*range(-8, 40), 101, 102, 10**12 + 3]:
        for t in range(rng.choice([1, 2, 6, 12, 30])):
            # Few texts, so that paths branch, end inside others and repeat.
            rows.append((c, None if t == 0 and c % 3 == 0 else t, rng.choice(["user", None]) if t % 7 == 0 else "user", rng.choice(["a", "é"]) if t % 5 == 0 else "same" if t % 2 else None))
    rows += [(c, t, "user", "copy") for c in range(200, 260) for t in range(9)]
    rows += [(None, 0, "user", "lost"), (300, 0, "user", "only"), (300, 1, "user", "x" * 40_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, depth int").repartition(7)
    assert trie_rows(df) == trie_of(rows)


def test_conversation_trie_long(spark):
    """One conversation has a third of all turns; others follow it to various depths."""
    rows = [(0, t, "user", f"t{t}") for t in range(600)] + [(500, t, "user", f"t{t}" if t < 300 else f"u{t}") for t in range(400)]
    rows += [(1000 + 5 * k, t, "user", f"t{t}") for k in range(12) for t in range(k * 7)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    assert trie_rows(df) == trie_of(rows)


def test_conversation_trie_edges(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert trie_rows(spark.createDataFrame([], schema)) == []
    assert trie_rows(spark.createDataFrame([(None, 0, "user", "x")], schema)) == []
    # Turnless after rebuilding: the only turn lies within the shared ones and the family's first is absent.
    rows = [(c, 0, "user", "x") for c in range(1, 5)]
    assert trie_rows(spark.createDataFrame(rows, schema)) == trie_of(rows)


def test_fattest(spark):
    pairs = [(a, b) for a in range(40) for b in range(a + 1, 41)]
    got = spark.createDataFrame(pairs, "a long, b long").select("a", "b", conversation_trie.fattest("a", "b").alias("f")).collect()
    for a, b, f in got:
        assert f == max(range(a + 1, b + 1), key=lambda v: v & -v)
