"""Token counts at every prefix of a text, by dynamic programming over a byte-level BPE.

The encoding of a prefix is the encoding of a shorter prefix and one last token, and only one
last token fits: the one whose pair with the token before it is left alone by the merges. So
one pass from the left gives the token count of every prefix of a pre-token, without encoding
any prefix anew. Distinct pre-tokens of a batch go through that pass side by side in numpy.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillon.llm.common import pick, small_batches, texts_of

#: The published pre-token pattern of the byte-level BPE with 50,257 ids (a fixed value).
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
SPACES = regex.compile(r"\s+")
#: Letters and numbers differ between versions of Unicode; beyond these ranges the library splits.
OTHER = regex.compile(r"[^\x00-\u0557\u2010-\u2027\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]")
#: Pre-tokens a worker remembers; beyond it starts anew. Bounds memory, not results.
REMEMBERED = 400_000
#: Bytes of pre-tokens that go through the pass side by side.
SIDE_BY_SIDE = 400_000
#: Bytes from which on a pre-token takes the pass by itself, prefix after prefix.
LONG = 512


class Span(NamedTuple):
    """A stretch of a text, with the part of a match object's face that is used here."""

    text: str
    at: int
    to: int

    def start(self) -> int:
        return self.at

    def end(self) -> int:
        return self.to

    def group(self) -> str:
        return self.text[self.at : self.to]


def _printable() -> dict[str, int]:
    """The byte that each printable character of the vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class PrefixCounts:
    """Prefix counts under the merges of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre["use_regex"]:
            raise ValueError(f"{path}: only plain byte-level BPE without a leading space")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: only added tokens that stand for exactly their text")
        if spec["model"]["ignore_merges"] or spec["model"]["dropout"]:
            raise ValueError(f"{path}: merges must apply to every pre-token")
        self.library = Tokenizer.from_file(path)
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        byte = _printable()
        # Tokens are numbered by the order in which merges make them: 256 bytes, then merges.
        number = {bytes([b]): b for b in range(256)}
        left, right = list(range(256)), list(range(256))
        for merge in spec["model"]["merges"]:
            a, b = (bytes(byte[c] for c in x) for x in (merge.split(" ") if isinstance(merge, str) else merge))
            if a + b in number:
                raise ValueError(f"{path}: two merges make one token")
            number[a + b] = len(left)
            left.append(number[a])
            right.append(number[b])
        self.left, self.right = np.array(left), np.array(right)
        self.n = len(left)
        keys = self.left[256:] * self.n + self.right[256:]
        order = np.argsort(keys)
        self.pair_keys, self.pair_token = keys[order], order + 256
        self.merged = dict(zip(keys.tolist(), range(256, self.n), strict=True))
        self.halves = list(zip(left, right, strict=True))
        self.seen: dict[int, bool] = {}
        # Trie over the tokens' bytes: (node, byte) -> node; a node's token or -1.
        node_of, token_at, edges = {b"": 0}, [-1], {}
        for word, i in number.items():
            for k in range(1, len(word) + 1):
                if word[:k] not in node_of:
                    node_of[word[:k]] = len(token_at)
                    edges[node_of[word[: k - 1]] << 8 | word[k - 1]] = len(token_at)
                    token_at.append(-1)
            token_at[node_of[word]] = i
        self.edge_keys = np.array(sorted(edges))
        self.edge_to = np.array([edges[k] for k in self.edge_keys.tolist()])
        self.token_at = np.array(token_at)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether token b may follow token a: no merge across their border would come first.

        Looks back in merge order: of the two, the one made later is undone at the border, and a
        pair that then touches and merges before that time (on a tie: further left) rules a, b out.
        """
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), self.n)
        while len(live):
            at, hit = _find(self.pair_keys, a * self.n + b)
            crossed = hit & (self.pair_token[at] < limit)
            ok[live[crossed]] = False
            later = a > b
            token = np.where(later, a, b)
            on = ~crossed & (token >= 256)
            live, a, b, later, token = (x[on] for x in (live, a, b, later, token))
            limit = np.where(later, token, token + 1)
            a, b = np.where(later, self.right[a], a), np.where(later, b, self.left[b])
        return ok

    def _pass(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat prefix counts: for each word, the counts of its prefixes of 1, 2, ... bytes."""
        sizes = np.array([len(w) for w in words])
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        offset = np.r_[0, np.cumsum(sizes)]
        word_end = np.repeat(offset[1:], sizes)
        starts, ends, tokens = [], [], []
        start = np.arange(len(data))
        node, reach = np.zeros(len(data), np.int64), start.copy()
        while len(start):
            at, hit = _find(self.edge_keys, node << 8 | data[reach])
            start, node, reach = start[hit], self.edge_to[at[hit]], reach[hit] + 1
            token = self.token_at[node]
            is_token = token >= 0
            starts.append(start[is_token])
            ends.append(reach[is_token])
            tokens.append(token[is_token])
            inside = reach < word_end[start]
            start, node, reach = start[inside], node[inside], reach[inside]
        start, end, token = map(np.concatenate, (starts, ends, tokens))
        word_start = np.repeat(offset[:-1], sizes)
        count = np.zeros(len(data) + 1, np.int64)  # by the end of the prefix
        alone = np.flatnonzero(sizes > LONG)
        if len(alone):
            order = np.lexsort((start, end))  # by word, then the prefix, then the longest last token first
            start, end, token = start[order], end[order], token[order]
            short = np.ones(len(start), bool)
            for k in alone.tolist():
                lo, hi = np.searchsorted(end, (offset[k], offset[k + 1]), side="right")
                count[offset[k] + 1 : offset[k + 1] + 1] = self._by_itself(
                    (start[lo:hi] - offset[k]).tolist(), (end[lo:hi] - offset[k]).tolist(), token[lo:hi].tolist(), int(sizes[k])
                )
                short[lo:hi] = False
            start, end, token = start[short], end[short], token[short]
        # By the length of the prefix, then the longest last token first.
        step = end - word_start[start]
        order = np.lexsort((start, step))
        start, end, token, step = start[order], end[order], token[order], step[order]
        bounds = np.searchsorted(step, np.arange(1, min(LONG, sizes.max(initial=0)) + 2))
        last = np.full(len(data) + 1, -1)
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            s, e, t = start[lo:hi], end[lo:hi], token[lo:hi]
            while len(s):
                # One candidate of each prefix still open: its longest.
                _, head = np.unique(e, return_index=True)
                head = head if len(head) == len(e) else self._longest(s, e)
                first = s[head] == word_start[s[head]]
                fits = first.copy()
                fits[~first] = self.compatible(last[s[head[~first]]], t[head[~first]])
                done = head[fits]
                last[e[done]] = t[done]
                count[e[done]] = np.where(first[fits], 0, count[s[done]]) + 1
                rest = np.ones(len(s), bool)
                rest[head] = False
                rest &= last[e] < 0
                s, e, t = s[rest], e[rest], t[rest]
        return count[1:], offset

    def _by_itself(self, start: list[int], end: list[int], token: list[int], size: int) -> list[int]:
        """The counts of one word's prefixes; candidates sorted by end, the longest first."""
        last, count = [-1] * (size + 1), [0] * (size + 1)
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        for s, e, t in zip(start, end, token, strict=True):
            if not count[e] and (s == 0 or self._follows(last[s], t)):
                last[e], count[e] = t, count[s] + 1
        return count[1:]

    def _follows(self, a: int, b: int) -> bool:
        """compatible() of one pair; remembered."""
        pair = a * self.n + b
        if (known := self.seen.get(pair)) is not None:
            return known
        limit, ok = self.n, True
        while True:
            if self.merged.get(a * self.n + b, self.n) < limit:
                ok = False
                break
            token = max(a, b)
            if token < 256:
                break
            if a > b:
                limit, a = token, self.halves[token][1]
            else:
                limit, b = token + 1, self.halves[token][0]
        self.seen[pair] = ok
        return ok

    @staticmethod
    def _longest(s: np.ndarray, e: np.ndarray) -> np.ndarray:
        order = np.lexsort((s, e))
        return order[np.r_[True, np.diff(e[order]) != 0]]

    def of_words(self, words: list[bytes]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        at = 0
        while at < len(words):
            stop, size = at, 0
            while stop < len(words) and (stop == at or size < SIDE_BY_SIDE):
                size += len(words[stop])
                stop += 1
            counts, offset = self._pass(words[at:stop])
            kind = np.uint8 if counts.max(initial=0) < 256 else np.int64
            counts, o = counts.astype(kind), offset.tolist()
            out += [counts[o[i] : o[i + 1]].copy() for i in range(stop - at)]
            at = stop
        return out

    def remember(self, pieces: list[list[str]], known: dict[str, np.ndarray]) -> None:
        """Puts the byte-prefix counts of all the pre-tokens into known."""
        if len(known) > REMEMBERED:
            known.clear()
        fresh = sorted(set().union(*pieces).difference(known))
        known.update(zip(fresh, self.of_words([w.encode("utf-8", "surrogatepass") for w in fresh]), strict=True))

    def totals(self, texts: list[str], known: dict[str, np.ndarray] | None = None) -> list[int]:
        """The token count of each text: its last prefix."""
        known = {} if known is None else known
        split = [self._split(t) for t in texts]
        self.remember([words for _, parts in split for words in parts], known)
        last = {w: int(known[w][-1]) for _, parts in split for words in parts for w in words}
        return [extra + sum(sum(map(last.__getitem__, words)) for words in parts) for extra, parts in split]

    def _split(self, text: str) -> tuple[int, list[list[str]]]:
        parts = self.special.split(text)
        return len(parts) - 1, [self._words(p) for p in parts if p]

    def _words(self, text: str) -> list[str]:
        if OTHER.search(text):
            return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]
        return PRE_TOKEN.findall(text)

    def _matches(self, text: str) -> list[Span]:
        ends = np.cumsum([len(w) for w in self._words(text)]).tolist()
        return [Span(text, a, b) for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []

    def prefixes(self, text: str, known: dict[str, np.ndarray] | None = None) -> np.ndarray:
        """The token count of text[:i] for i = 0 ... len(text)."""
        known = {} if known is None else known
        out = np.zeros(len(text) + 1, np.int64)
        at = base = 0
        for found in [*self.special.finditer(text), None]:
            begin, stop = at, found.start() if found else len(text)
            self._segment(text[at:stop], out[at : stop + 1], base, known)
            base = int(out[stop])
            if found:
                at = found.end()
                # Part of a special string is ordinary text that goes on from what stood before.
                tail = begin + max((m.start() for m in self._matches(text[begin:stop])), default=0)
                while tail > begin and SPACES.match(text, tail - 1, tail):
                    tail -= 1
                before = int(out[tail])
                for i in range(stop + 1, at):
                    out[i] = before + self.totals([text[tail:i]], known)[0]
                base += 1
                out[at] = base
        return out

    def fitting(self, text: str, words: list[str], totals: list[int], limit: int, known: dict[str, np.ndarray]) -> int:
        """The characters of the text's longest prefix of at most limit tokens, from prefix counts.

        words: its pre-tokens, the first ones at least; totals: the counts before each of them and at
        the end, which is above the limit. The text has no special string. Counts at the ends of
        pre-tokens only grow, so only the prefixes that end in the first pre-token above the limit,
        and in the white space around it, need a look.
        """
        over = bisect_right(totals, limit)
        ends = list(accumulate(map(len, words[:over]), initial=0))
        rest = SPACES.match(text, ends[over])
        stop = rest.end() if rest else ends[over]
        k = over - 1
        while k and SPACES.match(text, ends[k] - 1, ends[k]):
            k -= 1
        counts = np.zeros(stop - ends[k] + 1, np.int64)
        self._segment(text[ends[k] : stop], counts, totals[k], known)
        return ends[k] + int(np.flatnonzero(counts <= limit)[-1])

    def counted(self, texts: list[str], limit: int, known: dict[str, np.ndarray]) -> tuple[list[int], list[int]]:
        """The token count of each text, and the characters of its longest prefix within the limit."""
        split = [self._split(t) for t in texts]
        pieces = [words for _, parts in split for words in parts]
        self.remember(pieces, known)
        mine = {w: known[w] for w in set().union(*pieces)}
        last = {w: int(x[-1]) for w, x in mine.items()}
        totals, fit = [], []
        for text, (extra, parts) in zip(texts, split, strict=True):
            total = extra + sum(sum(map(last.__getitem__, words)) for words in parts)
            totals.append(total)
            if total <= limit:
                fit.append(len(text))
            elif extra:
                fit.append(int(np.flatnonzero(self.prefixes(text, known) <= limit)[-1]))
            else:
                head = parts[0][: limit + 1]  # has more tokens than limit, as each pre-token has one or more
                fit.append(self.fitting(text, head, list(accumulate(map(last.__getitem__, head), initial=0)), limit, mine))
        return totals, fit

    def _segment(self, text: str, out: np.ndarray, base: int, known: dict[str, np.ndarray]) -> None:
        """Fills out[i] with base and the count of text[:i]; text holds no special string."""
        out[0] = base
        found = self._matches(text)
        runs = list(SPACES.finditer(text))
        self.remember([[m.group() for m in found], [m.group() for m in runs]], known)
        for m in found:
            start, word = m.start(), m.group()
            out[start + 1 : m.end() + 1] = out[start] + self._by_char(word, known)
            if word[0] == "'" and len(word) > 2:  # 'l of 'll is two pre-tokens
                for k in range(2, len(word)):
                    out[start + k] = out[start] + self.totals([word[:k]], known)[0]
        for m in runs:  # a prefix that ends among white space has all that space as one pre-token
            out[m.start() + 1 : m.end() + 1] = out[m.start()] + self._by_char(m.group(), known)

    @staticmethod
    def _by_char(word: str, known: dict[str, np.ndarray]) -> np.ndarray:
        counts = known[word]
        if len(counts) == len(word):
            return counts.astype(np.int64)
        ends = np.cumsum([len(c.encode("utf-8", "surrogatepass")) for c in word]) - 1
        return counts[ends].astype(np.int64)


@lru_cache(maxsize=2)
def load(path: str) -> tuple[PrefixCounts, dict[str, np.ndarray]]:
    """Model and pre-token memory of this worker."""
    return PrefixCounts(path), {}


def _counts(path: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = load(path)
        for batch in batches:
            texts = texts_of(batch.column(1))
            found, fit = model.counted(texts, limit, known)
            totals = pa.array(found, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()),
                    totals,
                    pa.array([n > limit for n in found]),
                    pa.array(fit, pa.int64()),
                ],
                ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"],
            )

    return run


def _prefix_rows(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = load(path)
        for batch in batches:
            for at, text in enumerate(texts_of(batch.column(1))):
                counts = pa.array([model.prefixes(text, known)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 1), counts], ["doc_id", "counts"])

    return run


def token_counts(
    docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, fit_chars: one row per input row, in no order.

    over_limit: whether n_tokens is above limit. fit_chars: the characters of the longest prefix
    of at most limit tokens. Null texts count as empty: 0 bytes, 0 tokens, 0 characters.
    Null and repeated ids are kept as they are. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    docs = pick(docs, id_col, text_col).toDF("doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return docs.mapInArrow(_counts(path, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")


def prefix_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts array<long>: counts[i] is the token count of the text's first i characters.

    With these stored, truncation and budget questions need no tokenizer: see ``fits`` and ``cut_at``.
    Null and empty texts have the counts [0]. One row per input row; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    docs = pick(docs, id_col, text_col).toDF("doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return docs.mapInArrow(_prefix_rows(path), "doc_id long, counts array<long>")


def cut_at(counts, budget: int):
    """Column: the characters of the longest prefix that has at most budget tokens."""
    places = F.sequence(F.lit(0), F.size(counts) - 1)
    return F.array_max(F.filter(places, lambda i: F.get(counts, i) <= budget)).cast("long")


def fits(counts, budget: int):
    """Column: whether the whole text has at most budget tokens."""
    return F.element_at(counts, -1) <= budget
