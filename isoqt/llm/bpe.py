"""Byte-level BPE encoding and decoding by recursive DuckDB queries inside Spark partitions.

Texts are cut into pre-tokens by the tokenizer's pattern. Distinct pre-tokens of a batch that are no token themselves
become token-position rows; a recursive query joins neighbouring positions with the merge table, contracts each word's
leftmost pair of minimum rank and repeats until no pair is left. Decoding joins the ids with the vocabulary and
aggregates the pieces in order. The vocabulary is read on each executor from ``ranks_path``.

Memory is bounded: words enter DuckDB in chunks of ``CHUNK_CHARS``, a recursion ends after ``DEPTH`` rounds and goes on
from where it was, the memo of encoded words is emptied at ``MEMO`` entries, and decoding works in slices of ``SLICE`` ids.

Defined cases: a null or empty text has no ids and decodes to nothing; texts are encoded whole; equal texts have equal
ids; other columns are ignored. A pre-token of n bytes takes at most n rounds, so one of very many letters is slow.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_CHARS, DEPTH, MEMO, SLICE = 200_000, 64, 500_000, 500_000

CONTRACT = f"""
WITH RECURSIVE s(w, toks, round, open) AS (
  SELECT w, toks, 0, true FROM words
  UNION ALL
  SELECT s.w, list_concat(list_concat(s.toks[:b.p - 1], [b.rank]), s.toks[b.p + 2:]), s.round + 1, true
  FROM s JOIN (
    SELECT w, arg_min(p, rank::BIGINT * 4294967296 + p) AS p, min(rank) AS rank
    FROM (SELECT w, unnest(toks[:-2]) AS a, unnest(toks[2:]) AS b, generate_subscripts(toks[2:], 1) AS p FROM s WHERE round < {DEPTH}) t
    JOIN merges m ON m.pair = t.a::BIGINT * 65536 + t.b
    GROUP BY w) b ON s.w = b.w
)
SELECT w, arg_max(toks, round) AS toks, max(round) AS round FROM s GROUP BY w"""

DECODE = """
WITH pieces AS (SELECT doc, pos, piece FROM ids JOIN vocabulary USING (id) ORDER BY pos)
SELECT doc, string_agg(piece, '') AS data FROM pieces GROUP BY doc"""


class Coder:
    """Vocabulary, merge table and an in-process DuckDB connection of one Python worker."""

    def __init__(self, ranks_path: str, pattern: str):
        import duckdb
        import regex

        with open(ranks_path, "rb") as lines:
            self.ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        if max(self.ranks.values()) >= 65536:
            raise ValueError("the merge table packs two ids of 16 bits")
        self.split = regex.compile(pattern).findall
        pairs = [(self.ranks[w[:i]] * 65536 + self.ranks[w[i:]], rank) for w, rank in self.ranks.items()
                 for i in range(1, len(w)) if w[:i] in self.ranks and w[i:] in self.ranks]
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.whole = {w.decode(): rank for w, rank in self.ranks.items() if _is_text(w)}
        self._reset()
        self.con = duckdb.connect(config={"threads": 1, "preserve_insertion_order": True, "memory_limit": "150MB"})
        left, right = zip(*pairs)
        self._store("merges", pa.table({"pair": pa.array(left, pa.int64()), "rank": pa.array(right, pa.int32())}))
        # Pieces as text, one character of Latin-1 for each byte, so that they can be joined by string_agg.
        words, ids = zip(*((w.decode("latin-1"), rank) for w, rank in self.ranks.items()))
        self._store("vocabulary", pa.table({"id": pa.array(ids, pa.int32()), "piece": pa.array(words, pa.string())}))

    def _store(self, name: str, rows: pa.Table) -> None:
        self.con.register("given", rows)
        self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.con.unregister("given")

    def _query(self, sql: str, **tables: pa.Table) -> pa.Table:
        for name, table in tables.items():
            self.con.register(name, table)
        out = self.con.sql(sql).to_arrow_table()
        for name in tables:
            self.con.unregister(name)
        return out

    def _reset(self) -> None:
        """Memo of the tokens that are text themselves: word -> entry, with the entries' ids in flat arrays."""
        self.entry = {w: k for k, w in enumerate(self.whole)}
        self.values = [np.fromiter(self.whole.values(), np.int32, len(self.whole))]
        self.lengths = [np.ones(len(self.whole), np.int64)]

    def _contract(self, words: list[str]) -> None:
        """Encode ``words`` into the memo, going on after every ``DEPTH`` rounds with the words still open."""
        text = pa.array(words, pa.string())
        offsets = np.frombuffer(text.buffers()[1], np.int32)[: len(words) + 1]
        tokens = pa.array(self.byte[np.frombuffer(text.buffers()[2], np.uint8)[: offsets[-1]]])
        table = pa.table({"w": pa.array(np.arange(len(words), dtype=np.int32)), "toks": pa.ListArray.from_arrays(pa.array(offsets), tokens)})
        while len(table):
            got = self._query(CONTRACT, words=table)
            is_open = pc.greater_equal(got["round"], DEPTH)
            done, table = got.filter(pc.invert(is_open)), got.filter(is_open).select(["w", "toks"])
            if len(done):
                lists = done["toks"].combine_chunks()
                first = len(self.entry)
                self.entry.update((words[w], first + k) for k, w in enumerate(done["w"].to_pylist()))
                self.values.append(lists.flatten().to_numpy())
                self.lengths.append(np.diff(lists.offsets.to_numpy()).astype(np.int64))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if len(self.entry) > MEMO:
            self._reset()
        pieces = [self.split(t) for t in texts]
        new = set().union(*pieces) - self.entry.keys() if pieces else set()
        chunk, size = [], 0
        for word in new:
            chunk.append(word)
            size += len(word)
            if size >= CHUNK_CHARS:
                self._contract(chunk)
                chunk, size = [], 0
        if chunk:
            self._contract(chunk)
        self.values, self.lengths = [np.concatenate(self.values)], [np.concatenate(self.lengths)]
        ends = np.cumsum(self.lengths[0])
        out = []
        for words in pieces:
            at = np.fromiter(map(self.entry.__getitem__, words), np.int64, len(words))
            n = self.lengths[0][at]
            before = np.cumsum(n) - n
            out.append(self.values[0][np.repeat(ends[at] - n - before, n) + np.arange(n.sum())])
        return out

    def decode(self, docs: list[np.ndarray]) -> list[bytes]:
        """Bytes of each list of ids; slices of at most ``SLICE`` ids are decoded at a time."""
        out = [b""] * len(docs)
        start = 0
        while start < len(docs):
            end, size = start, 0
            while end < len(docs) and (end == start or size + len(docs[end]) <= SLICE):
                size += len(docs[end])
                end += 1
            for at in range(0, max((len(d) for d in docs[start:end]), default=0), SLICE) if end == start + 1 else [0]:
                part = [d[at : at + SLICE] for d in docs[start:end]]
                lengths = [len(d) for d in part]
                table = pa.table({"doc": np.repeat(np.arange(start, end, dtype=np.int32), lengths), "pos": np.arange(sum(lengths), dtype=np.int32),
                                  "id": np.concatenate(part) if part else np.zeros(0, np.int32)})
                got = self._query(DECODE, ids=table)
                for doc, data in zip(got["doc"].to_pylist(), got["data"].to_pylist()):
                    out[doc] += data.encode("latin-1")
            start = end
        return out


def _is_text(word: bytes) -> bool:
    try:
        word.decode()
    except UnicodeDecodeError:
        return False
    return True


@lru_cache(maxsize=1)
def coder(ranks_path: str, pattern: str) -> Coder:
    """One coder for each Python worker, kept from partition to partition."""
    return Coder(ranks_path, pattern)


def batches_of(texts: list[str], most: int = 1_000_000):
    """Consecutive slices of about ``most`` characters at most, one text at least."""
    start = 0
    while start < len(texts):
        end, size = start, 0
        while end < len(texts) and (end == start or size + len(texts[end]) <= most):
            size += len(texts[end])
            end += 1
        yield start, end
        start = end


def tokenize(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Doc_id, n_tokens and the digests of ids and decoded bytes of every row; ``with_ids`` adds the ids themselves."""

    def run(batches):
        own = coder(ranks_path, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for start, end in batches_of(texts):
                ids = own.encode(texts[start:end])
                data = own.decode(ids)
                columns = [batch.column("doc_id").slice(start, end - start), pa.array([len(x) for x in ids], pa.int64()),
                           pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()),
                           pa.array([hashlib.sha256(x).hexdigest() for x in data], pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.array([x.tolist() for x in ids], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
