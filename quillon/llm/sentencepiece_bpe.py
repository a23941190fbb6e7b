"""SentencePiece encoding and decoding by vectorised merge rounds.

The distinct words of a batch lie end to end in flat numpy arrays of symbols. In each round
every unfinished word takes its pair of best rank, merges that pair's occurrences from the left
at once, and the arrays are compacted; a word is done when no pair of it is a piece. The library
merges one pair at a time, so a round stops in a word behind an occurrence whose new neighbours
rank at least as well: those come first.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from quillon.llm.common import pick, small_batches, texts_of

SPACE = "▁"
NORMAL, BYTE = 1, 6
NONE = np.iinfo(np.int64).max
#: Words a worker remembers; beyond it starts anew. Bounds memory, not results.
REMEMBERED = 300_000
WORDS = re.compile(r" *[^ \n]+| +|\n")


class PieceBpe:
    """The merge tables of a BPE model with byte fallback and no text normalisation."""

    def __init__(self, path: str):
        proto = model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm, train = proto.normalizer_spec, proto.trainer_spec
        plain = norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces
        if train.model_type != 2 or not train.byte_fallback or norm.precompiled_charsmap or not plain:
            raise ValueError(f"{path}: only BPE models with byte fallback and identity normalisation")
        if any(p.type in (4, 5) for p in proto.pieces):
            raise ValueError(f"{path}: user-defined or unused pieces are not supported")
        pieces = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        if any(SPACE in p.lstrip(SPACE) for p in pieces) or any("\n" in p for p in pieces):
            raise ValueError(f"{path}: a piece spans words")
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = len(proto.pieces)
        self.bytes = np.zeros(256, np.int64)
        for i, p in enumerate(proto.pieces):
            if p.type == BYTE:
                self.bytes[int(p.piece[1:-1], 16)] = i
        # Symbols: the pieces, then characters that only occur inside pieces.
        symbols = dict(pieces)
        for p in pieces:
            for c in p:
                symbols.setdefault(c, self.pieces + len(symbols))
        self.width = max(symbols.values()) + 2
        self.of_char = np.full(0x110000, -1, np.int64)
        for s, i in symbols.items():
            if len(s) == 1:
                self.of_char[ord(s)] = i
        self.of_char[ord(" ")] = self.of_char[ord(SPACE)]
        order = {s: i for i, s in enumerate(sorted({p.score for p in proto.pieces if p.type == NORMAL}, reverse=True))}
        pairs, touching = {}, set()
        for p, i in pieces.items():
            for k in range(1, len(p)):
                left, right = symbols.get(p[:k]), symbols.get(p[k:])
                touching.add(symbols[p[k - 1]] * self.width + symbols[p[k]])
                if left is not None and right is not None:
                    pairs[left * self.width + right] = (order[proto.pieces[i].score], i)
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], np.int64)
        self.merged = np.array([pairs[k][1] for k in self.keys.tolist()], np.int64)
        self.touching = np.array(sorted(touching), np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged symbol) of each pair; rank NONE where the pair is no piece."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.ranks[at], NONE), self.merged[at]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, offsets) of words that stand for themselves, without a prefix."""
        lengths = np.array([len(w) for w in words], np.int64)
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        symbol = self.of_char[chars]
        if not len(chars):
            return np.zeros(0, np.int64), np.zeros(len(words) + 1, np.int64)
        # Segments: no merge crosses two characters that touch in no piece.
        key = symbol[:-1] * self.width + symbol[1:]
        at = np.minimum(np.searchsorted(self.touching, key), len(self.touching) - 1)
        apart = (self.touching[at] != key) | (symbol[:-1] < 0) | (symbol[1:] < 0)
        starts = np.zeros(len(chars), bool)
        starts[0] = True
        starts[1:] = apart
        starts[np.cumsum(lengths)[:-1][np.cumsum(lengths)[:-1] < len(chars)]] = True
        place, symbol = self._merge(symbol, np.cumsum(starts) - 1)
        return self._ids(place, symbol, chars, lengths)

    def _merge(self, symbol: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rounds; gives the first character and the symbol of each piece, in order."""
        place = np.arange(len(symbol))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            pair = segment[:-1] == segment[1:]
            rank = np.full(len(symbol), NONE)
            new = np.zeros(len(symbol), np.int64)
            rank[:-1], new[:-1] = self.rank(symbol[:-1], symbol[1:])
            rank[:-1][~pair] = NONE
            head = np.flatnonzero(np.r_[True, ~pair])
            size = np.diff(np.r_[head, len(symbol)])
            best = np.repeat(np.minimum.reduceat(rank, head), size)
            open_ = best < NONE
            if not open_.all():
                done.append((place[~open_], symbol[~open_]))
                place, symbol, segment, rank, new, best = (
                    x[open_] for x in (place, symbol, segment, rank, new, best)
                )
                if not len(symbol):
                    break
            at = np.flatnonzero(rank == best)
            # Of candidates that overlap in a row, every other one from the left.
            run = np.r_[True, (np.diff(at) != 1) | (segment[at][1:] != segment[at][:-1])]
            at = at[(at - np.repeat(at[run], np.diff(np.r_[np.flatnonzero(run), len(at)]))) % 2 == 0]
            at = at[~self._after_stop(at, symbol, segment, rank, new)]
            symbol[at] = new[at]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            place, symbol, segment = place[keep], symbol[keep], segment[keep]
        if not done:
            return place, symbol
        place, symbol = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(place, kind="stable")
        return place[order], symbol[order]

    def _after_stop(self, at, symbol, segment, rank, new) -> np.ndarray:
        """Which occurrences stand behind one whose merge makes a pair that comes first."""
        n = len(symbol)
        before = np.where(at > 0, symbol[at - 1], -1)
        follows = np.r_[False, (np.diff(at) == 2)]
        before = np.where(follows, np.r_[0, new[at][:-1]], before)
        before = np.where((at > 0) & (segment[at - 1] == segment[at]), before, -1)
        right = np.minimum(at + 2, n - 1)
        after = np.where((at + 2 < n) & (segment[right] == segment[at]), symbol[right], -1)
        made = np.minimum(self.rank(before, new[at])[0], self.rank(new[at], after)[0])
        stops = np.cumsum(made <= rank[at])
        first = np.r_[True, segment[at][1:] != segment[at][:-1]]
        base = np.repeat((stops - (made <= rank[at]))[first], np.diff(np.r_[np.flatnonzero(first), len(at)]))
        return stops - (made <= rank[at]) - base > 0

    def _ids(self, place, symbol, chars, lengths) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids; a character that is no piece becomes its UTF-8 bytes."""
        word = np.repeat(np.arange(len(lengths)), lengths)[place]
        loose = (symbol < 0) | (symbol >= self.pieces)
        code = np.where(chars[place] == 32, ord(SPACE), chars[place])
        width = np.where(loose, 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF), 1)
        end = np.cumsum(width)
        ids = np.repeat(symbol, width)
        for n in range(1, 5):
            which = np.flatnonzero(loose & (width == n))
            c, to = code[which], end[which] - n
            if n == 1:
                ids[to] = self.bytes[c]
                continue
            ids[to] = self.bytes[(0xF00 >> n & 0xFF) | c >> 6 * (n - 1)]
            for k in range(1, n):
                ids[to + k] = self.bytes[0x80 | c >> 6 * (n - 1 - k) & 0x3F]
        count = np.bincount(word, width, len(lengths)).astype(np.int64)
        return ids, np.r_[0, np.cumsum(count)]

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in self.encode_joined([text])[0].split(",") if x]

    def encode_joined(self, texts: list[str], known: dict[str, str] | None = None) -> list[str]:
        """The ids of each text as decimals joined by commas. known: words met before."""
        known = {} if known is None else known
        if len(known) > REMEMBERED:
            known.clear()
        split = [WORDS.findall(" " + t.replace(SPACE, " ")) if t else [] for t in texts]
        fresh = list({w for words in split for w in words if w not in known})
        for at in range(0, len(fresh), 50_000):
            part = fresh[at : at + 50_000]
            ids, offsets = self.encode_words(part)
            as_text, o = list(map(str, ids.tolist())), offsets.tolist()
            known.update((w, ",".join(as_text[o[i] : o[i + 1]])) for i, w in enumerate(part))
        return [",".join(map(known.__getitem__, words)) for words in split]


@lru_cache(maxsize=2)
def load(path: str) -> tuple[PieceBpe, dict[str, str]]:
    """Model and word memory of this worker."""
    return PieceBpe(path), {}


def _digest(joined: str) -> str:
    return hashlib.sha256(joined.encode("utf-8", "surrogatepass")).hexdigest()


def _run(path: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = load(path)
        for batch in batches:
            encoded = model.encode_joined(texts_of(batch.column(1)), known)
            ids = [list(map(int, x.split(","))) if x else [] for x in encoded]
            decoded = [model.library.decode(x) if x else "" for x in ids]
            cols = [batch.column(0), pa.array([len(x) for x in ids], pa.int64())]
            names = ["doc_id", "n_tokens"]
            if with_ids:
                cols += [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded)]
                names += ["ids", "decoded"]
            else:
                cols += [pa.array(list(map(_digest, encoded))), pa.array(list(map(_digest, decoded)))]
                names += ["ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids array<int>, decoded: the token ids of each text and the text they give.

    One row per input row, in no order. Null texts count as empty: no ids, empty decoded text.
    Null and repeated ids are kept as they are. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    docs = pick(docs, id_col, text_col).toDF("doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return docs.mapInArrow(_run(model_path, True), "doc_id long, n_tokens long, ids array<int>, decoded string")


def digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: what ``encode`` gives, as digests.

    A null or empty text has the digests of the empty string. Rows as for ``encode``.
    """
    small_batches(docs.sparkSession)
    docs = pick(docs, id_col, text_col).toDF("doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return docs.mapInArrow(
        _run(model_path, False), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
