"""Token counts: pieces are counted once for every distinct pre-token and joined to the documents' pre-token frequencies.

1. A pass over the texts counts in how many documents of a task each pre-token stands; Spark adds the counts. Of every
   distinct pre-token the tokenizer counts the pieces, once: the vocabulary table (pre-token, documents, pieces).
2. Pre-tokens follow Zipf's law. The most frequent ones (at most ``common``, cut at a document frequency) go to the
   tasks as a dictionary of proven size; they are also the only hot join keys. A second pass over the texts sums
   frequency times pieces of those at once and hands on only (row, pre-token, frequency) of the others.
3. Those rows meet the vocabulary in a shuffled join, and one aggregation adds both sums for each row.

Ids of pieces are never kept: the tokenizer gives lengths. A text is split at the special strings of the tokenizer as
its library does; such a string is one token.

Defined cases: a null or empty text has no bytes and no tokens; ids may repeat or be null (every row counts for itself);
an empty table gives no rows; a pre-token of any length is taken whole; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections import Counter

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoqt.llm.common import written

COMMON, LIMIT = 50_000, 2048
#: Pre-tokens a task holds before it hands on its counts.
HELD = 200_000
#: Text whose case and character classes no Unicode version moves; other text is split by the library itself.
PLAIN = re.compile("[\t\n\r\x20-\x7e\u00c0-\u00ff]*")
_LOADED: dict = {}


class Splitter:
    """Texts to pre-tokens and pre-tokens to numbers of pieces, with the settings of a tokenizer file."""

    def __init__(self, content: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(re.escape(s) for s in sorted(added, key=len, reverse=True))) if added else None
        steps = json.loads(content).get("pre_tokenizer") or {}
        split = [x for x in steps.get("pretokenizers", [steps]) if x.get("type") == "Split" and x.get("invert") and "Regex" in x["pattern"]]
        self.pattern = regex.compile(split[0]["pattern"]["Regex"]) if len(split) == 1 else None
        self.plain = self.agrees()

    @classmethod
    def of(cls, content: str) -> "Splitter":
        if content not in _LOADED:
            _LOADED.clear()
            _LOADED[content] = cls(content)
        return _LOADED[content]

    def split(self, text: str) -> list[str]:
        """Normalised pre-tokens of a stretch of text without special strings, by the library."""
        if self.tokenizer.normalizer is not None:
            text = self.tokenizer.normalizer.normalize_str(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def agrees(self) -> bool:
        """Whether lower case and the file's pattern split plain text as the library does, seen on every plain character."""
        if self.pattern is None:
            return False
        plain = [chr(c) for c in (9, 10, 13, *range(32, 127), *range(0xC0, 0x100))]
        probes = ["".join(plain), "".join(reversed(plain)), "".join(a + b for a in plain for b in "aZ1' .s\n\u00c9")]
        return all(self.pattern.findall(p.lower()) == self.split(p) for p in probes)

    def count(self, text: str) -> tuple[Counter, int]:
        """(frequency of each pre-token, number of special strings)."""
        pieces = self.special.split(text) if self.special else [text]
        found: Counter = Counter()
        for piece in pieces:
            if piece:
                found.update(self.pattern.findall(piece.lower()) if self.plain and PLAIN.fullmatch(piece) else self.split(piece))
        return found, len(pieces) - 1

    def lengths(self, words: list[str]) -> list[int]:
        """Number of pieces of every pre-token, as the model alone gives them."""
        spelled = self.tokenizer.pre_tokenizer.pre_tokenize_str
        return [sum(len(self.tokenizer.model.tokenize(part)) for part, _ in spelled(w)) for w in words]


def vocabulary(texts: DataFrame, content: str) -> DataFrame:
    """(word, docs, pieces): every distinct pre-token with the number of rows that hold it and its pieces."""

    def seen(batches):
        splitter, docs = Splitter.of(content), Counter()

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(docs.keys(), pa.string()), pa.array(docs.values(), pa.int64())], names=["word", "docs"])

        for texts_ in batches:
            for text in texts_.column(0).to_pylist():
                docs.update(splitter.count(text or "")[0].keys())
                if len(docs) > HELD:
                    yield batch()
                    docs.clear()
        yield batch()

    def lengths(batches):
        splitter = Splitter.of(content)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(splitter.lengths(b.column(0).to_pylist()), pa.int32())], names=["word", "docs", "pieces"])

    words = texts.mapInArrow(seen, "word string, docs long").groupBy("word").agg(F.sum("docs").alias("docs"))
    return written(words.mapInArrow(lengths, "word string, docs long, pieces int"))


def frequent(words: DataFrame, most: int) -> dict[str, int]:
    """Pieces of the words in at least so many documents that no more than ``most`` words are."""
    by_docs = words.groupBy(F.floor(F.log2("docs") * 8).cast("int").alias("step")).count().orderBy(F.desc("step")).collect()  # eight steps for each doubling
    total, step = 0, None
    for row in by_docs:
        total += row["count"]
        if total > most:
            break
        step = row["step"]
    if step is None:
        return {}
    return {r["word"]: r["pieces"] for r in words.where(F.floor(F.log2("docs") * 8) >= step).select("word", "pieces").collect()}  # at most ``most`` rows


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT, common: int = COMMON) -> DataFrame:
    """Doc_id, n_bytes, n_tokens, over_limit of every row of ``docs`` (doc_id, text). The tokenizer file is read here and sent along."""
    with open(tokenizer_path, encoding="utf-8") as file:
        content = file.read()
    text = F.col("text").cast("string")
    words = vocabulary(docs.select(text.alias("text")), content)
    sent = docs.sparkSession.sparkContext.broadcast(frequent(words, common))

    def counted(batches):
        splitter, known = Splitter.of(content), sent.value
        for batch in batches:
            ids, sums, rare, times, owner = batch.column("row").to_pylist(), [], [], [], []
            for row, text_ in zip(ids, batch.column("text").to_pylist()):
                found, special = splitter.count(text_ or "")
                total = special
                for word, n in found.items():
                    pieces = known.get(word)
                    if pieces is None:
                        owner.append(row)
                        rare.append(word)
                        times.append(n)
                    else:
                        total += n * pieces
                sums.append(total)
            n = len(ids)
            # First the rows of the documents, then the frequencies that the vocabulary has yet to answer.
            yield pa.RecordBatch.from_arrays([
                pa.array(ids + owner, pa.int64()), pa.concat_arrays([batch.column("doc_id"), pa.nulls(len(owner), batch.column("doc_id").type)]),
                pa.concat_arrays([batch.column("n_bytes"), pa.nulls(len(owner), pa.int64())]), pa.array(sums + times, pa.int64()), pa.array([None] * n + rare, pa.string())],
                names=["row", "doc_id", "n_bytes", "n", "word"])

    numbered = docs.select("doc_id", F.coalesce(F.octet_length(text).cast("long"), F.lit(0).cast("long")).alias("n_bytes"), text.alias("text"), F.monotonically_increasing_id().alias("row"))
    parts = written(numbered.mapInArrow(counted, f"row long, doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n long, word string"))
    answered = parts.where("word IS NOT NULL").join(words.select("word", "pieces"), "word").select("row", F.lit(None).alias("doc_id"), F.lit(None).cast("long").alias("n_bytes"), (F.col("n") * F.col("pieces")).alias("n"))
    whole = parts.where("word IS NULL").select("row", "doc_id", "n_bytes", "n").unionByName(answered)
    return whole.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens")).select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
