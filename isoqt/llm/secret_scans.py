"""Secret scan: fixed credential formats plus formats learned by grammar inference.

Labelled credentials (the values that the fixed formats find in a bounded sample of documents) form a prefix tree over
character classes. States whose futures are statistically compatible are merged (Hoeffding test) into a probabilistic
automaton. Every other token of credential shape in every document is then scored by its log-likelihood under the
automaton against a background chain of ordinary tokens; those beyond the limit are reported as ``grammar`` spans.

Defined cases: a null or empty text has no spans; texts are scanned whole; repeated rows are scanned alike; without
any labelled credential nothing is learned and only the fixed formats report; other columns are ignored. Offsets are
code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "grammar")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs, so the length may stand in the pattern
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
HINTS = ("passw", "secret", "token", "api")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the fixed formats, leftmost and non-overlapping within a kind."""
    spans = []
    low = text.lower()
    if any(h in low for h in HINTS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def values(text: str) -> list[str]:
    """The credentials themselves: the value of an assignment, the whole of the others."""
    found = [m[2] for m in ASSIGN.finditer(text) if len(m[2]) >= 6] if any(h in text.lower() for h in HINTS) else []
    taken = " ".join(found)
    return found + [m[0] for p in (ACCESS, HEX) for m in p.finditer(text) if len(m[0]) >= 20 and m[0] not in taken]


def candidates(text: str, spans) -> list[tuple[int, int]]:
    """Tokens of credential shape (a digit and a letter, 16 characters or more) that touch no base span."""
    out, k = [], 0
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        while k < len(spans) and spans[k][2] <= start and k + 1 < len(spans):
            k += 1
        token = m[0]
        if token.isalpha() or token.isdigit() or not any(c.isdigit() for c in token) or not any(c.isalpha() for c in token):
            continue
        if not any(s < end and e > start for s, _, e in spans):
            out.append((start, end))
    return out


def classes(token: str) -> str:
    """Character classes: digit, hex and other letters by case; every other sign stands for itself."""
    return "".join("9" if c.isdigit() else ("a" if c in "abcdef" else "z") if c.islower() else ("A" if c in "ABCDEF" else "Z") if c.isupper() else c for c in token)


class Automaton:
    """Probabilistic automaton learned by merging compatible states of a prefix tree, breadth first.

    ``alpha`` is the confidence of the Hoeffding test: two frequencies a/n and b/m are compatible when they differ by
    less than sqrt(ln(2/alpha)/2) * (1/sqrt(n) + 1/sqrt(m)).
    """

    def __init__(self, words: list[str], alpha: float = 0.05):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[Counter] = [Counter()]
        for word in words:
            state = 0
            for c in word:
                self.count[state][c] += 1
                if c not in self.next[state]:
                    self.next[state][c] = len(self.next)
                    self.next.append({})
                    self.count.append(Counter())
                state = self.next[state][c]
            self.count[state][""] += 1
        self.width = math.sqrt(math.log(2 / alpha) / 2)
        self._merge_all()
        self.total = [sum(c.values()) for c in self.count]
        self.alphabet = len({c for counts in self.count for c in counts} | {""})

    def _differ(self, p: int, q: int) -> bool:
        n, m = sum(self.count[p].values()), sum(self.count[q].values())
        if not n or not m:
            return False
        bound = self.width * (1 / math.sqrt(n) + 1 / math.sqrt(m))
        return any(abs(self.count[p][c] / n - self.count[q][c] / m) > bound for c in self.count[p].keys() | self.count[q].keys())

    def _compatible(self, p: int, q: int) -> bool:
        todo = [(p, q)]
        while todo:
            a, b = todo.pop()
            if self._differ(a, b):
                return False
            todo += [(self.next[a][c], self.next[b][c]) for c in self.next[a].keys() & self.next[b].keys() if self.next[a][c] != self.next[b][c]]
        return True

    def _fold(self, p: int, q: int) -> None:
        """Add the tree below ``q`` to the automaton at ``p``."""
        todo = [(p, q)]
        while todo:
            a, b = todo.pop()
            self.count[a] += self.count[b]
            for c, child in self.next[b].items():
                if c in self.next[a]:
                    todo.append((self.next[a][c], child))
                else:
                    self.next[a][c] = child

    def _merge_all(self) -> None:
        red, blue = [0], sorted((c, 0) for c in self.next[0])
        while blue:
            c, parent = blue.pop(0)
            state = self.next[parent][c]
            if state in red:
                continue
            for r in red:
                if self._compatible(r, state):
                    self.next[parent][c] = r
                    self._fold(r, state)
                    break
            else:
                red.append(state)
            blue = sorted((c, r) for r in red for c in self.next[r] if self.next[r][c] not in red)

    def score(self, word: str) -> float:
        """Log-likelihood of ``word`` and its end, with add-one smoothing; a missing step leads to the start."""
        state, total = 0, 0.0
        for c in [*word, ""]:
            total += math.log((self.count[state][c] + 0.01) / (self.total[state] + 0.01 * self.alphabet))
            state = self.next[state].get(c, 0)
        return total


class Background:
    """First-order chain over the classes of ordinary tokens."""

    def __init__(self, words: list[str]):
        self.pairs, self.firsts = Counter(), Counter()
        for w in words:
            self.pairs.update(zip(" " + w, w + "$"))
            self.firsts.update(" " + w)

    def score(self, word: str) -> float:
        return sum(math.log((self.pairs[(a, b)] + 0.5) / (self.firsts[a] + 0.5 * 16)) for a, b in zip(" " + word, word + "$"))


class Grammar:
    """Automaton, background and limit learned from labelled credentials and ordinary tokens."""

    def __init__(self, credentials: list[str], ordinary: list[str], share: float = 0.02):
        shapes = [classes(x) for x in credentials]
        held, learned = shapes[::5], [x for i, x in enumerate(shapes) if i % 5] or shapes
        self.known = bool(shapes)
        if not self.known:
            return
        self.automaton, self.background = Automaton(learned), Background([classes(x) for x in ordinary])
        good = sorted(self.score(x) for x in held)
        other = sorted(self.score(classes(x)) for x in ordinary)
        self.limit = max(good[int(share * len(good))], other[min(len(other) - 1, int(0.999 * len(other)))] if other else 0.0, 0.0)

    def score(self, shape: str) -> float:
        return (self.automaton.score(shape) - self.background.score(shape)) / (len(shape) + 1)

    def accepts(self, token: str) -> bool:
        return self.known and self.score(classes(token)) >= self.limit


def learn(docs: DataFrame, sample_docs: int = 20_000, most: int = 2_000) -> Grammar:
    """Fit on a bounded sample: about ``sample_docs`` documents, at most ``most`` credentials and ``most`` other tokens.

    The sample is chosen by a hash of the row, so it does not depend on partitioning.
    """
    part = max(1, math.ceil(docs.count() / sample_docs))
    rows = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(part)) == 0)

    def pick(batches):
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                if isinstance(text, str):
                    # Unlabelled tokens of credential shape are no counterexamples; words are.
                    out += [(v, True) for v in values(text)] + [(w, False) for w in set(text.split()) if len(w) < 40 and not CANDIDATE.search(w)]
            yield pd.DataFrame(out, columns=["token", "labelled"])

    tokens = rows.mapInPandas(pick, "token string, labelled boolean").distinct()
    chosen = defaultdict(list)
    for flag in (True, False):
        ordered = tokens.where(F.col("labelled") == flag).orderBy(F.xxhash64("token"), "token").limit(most)
        chosen[flag] = [r.token for r in ordered.collect()]
    return Grammar(chosen[True], chosen[False])


NAMES = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_grammar"]


def joined(spans) -> str:
    """kind:start:end of all spans by start, then kind."""
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def scan(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """Doc_id, counts of the base kinds, digest of the base spans, all spans, and the number learned, per row."""

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                text = text or ""
                base = base_spans(text)
                found = base + [(s, 3, e) for s, e in candidates(text, base) if grammar.accepts(text[s:e])]
                counts = Counter(k for _, k, _ in found)
                rows.append((counts[0], counts[1], counts[2], hashlib.sha256(joined(base).encode()).hexdigest(), joined(found), counts[3]))
            columns = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, columns, kinds)], names=NAMES)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_grammar long")
