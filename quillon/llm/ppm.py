"""LM scoring by prediction by partial matching over byte contexts.

The trie of contexts of up to ORDER bytes is built from all training texts and never gathered in
one place: it is the table of counted grams (context and next byte), cut by the last two bytes of
the context, so each share holds whole subtrees. In a context with T observations of q different
bytes an escape to the next shorter context has probability q / 2T and a byte seen n times
(2n - 1) / 2T; bytes that the longer context has seen are excluded from these counts. What is scored is the text as its tokens give it: A-Z lower-cased, words apart by one space,
then an end.

Scoring needs each gram's value and each token's count beside the texts. While both tables are
within a size that is checked first they are broadcast; beyond it texts are dealt in blocks, and
each block is sent the values of its own distinct grams and tokens.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import cut, pick, small_batches, texts_of

#: Context bytes. Symbols: 256 bytes, END behind a text; START fills contexts before it.
ORDER = 5
END, START, BITS = 256, 257, 9
ALPHABET = 257
#: Characters of one block of texts, and bytes of a text gone through at a time.
BLOCK_CHARS, PART = 16_000_000, 1_000_000
#: Entries after which a partial count is sent on, and words a worker remembers.
HELD, REMEMBERED = 400_000, 200_000
#: Rows of the two tables up to which they are broadcast: 64 and 96 MB.
MOST_GRAMS, MOST_TOKENS = 4_000_000, 8_000_000
STOP = b""  # the end token; no word is empty


def tokens(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, and the end."""
    return [*text.encode("utf-8", "surrogatepass").lower().split(), STOP]


def grams(words: list[bytes], order: int = ORDER) -> np.ndarray:
    """One number for each byte of the words, joined by single spaces, and for the end: the
    context before it and itself, 9 bits each."""
    data = np.frombuffer(b" ".join(words[:-1]), np.uint8)
    symbols = np.empty(len(data) + order + 1, np.int64)
    symbols[:order], symbols[-1] = START, END
    symbols[order:-1] = data
    out = np.zeros(len(data) + 1, np.int64)
    for k in range(order + 1):
        out = out << BITS | symbols[k : k + len(out)]
    return out


def _summed(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)
    return key[head], np.add.reduceat(count, head) if len(head) else count


class Level:
    """All contexts of one length: their grams, totals, and what exclusion takes from them."""

    def __init__(self, gram: np.ndarray, count: np.ndarray):
        self.gram, self.count = gram, count
        context = gram >> BITS
        self.head = np.flatnonzero(np.r_[True, context[1:] != context[:-1]]) if len(gram) else np.zeros(0, int)
        self.context = context[self.head]
        self.total = np.add.reduceat(count, self.head) if len(gram) else count
        self.kinds = np.diff(np.r_[self.head, len(gram)])

    def find(self, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _at(self.gram, gram)

    def find_context(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _at(self.context, context)


def _at(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), int), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def levels(gram: np.ndarray, count: np.ndarray, longest: int, shortest: int) -> list[Level]:
    """The levels of context length longest ... shortest, from counted grams of the longest."""
    gram, count = _summed(gram, count)
    out = []
    for k in range(longest, shortest - 1, -1):
        out.append(Level(gram, count))
        if k > shortest:
            gram, count = _summed(gram & ((1 << BITS * k) - 1), count)
    return out


def log_probs(wanted: np.ndarray, order: int, trie: list[Level]) -> np.ndarray:
    """log10 P(symbol | context) of each wanted gram; trie: levels of length order ... 0.

    A context never seen passes to its suffix at no cost. What a longer seen context has seen, its
    suffix has seen too, so the excluded counts are sums over the longer context's bytes.
    """
    out = np.zeros(len(wanted))
    open_ = np.arange(len(wanted))
    longer: Level | None = None
    longer_at = np.full(len(wanted), -1)
    for k, level in zip(range(order, -1, -1), trie, strict=True):
        if longer is not None:
            # Counts here of the bytes that each context of the longer level has seen.
            mask = (1 << BITS * (k + 1)) - 1
            at, hit = level.find(longer.gram & mask)
            seen = np.where(hit, level.count[at], 0)
            lost = np.add.reduceat(seen, longer.head) if len(longer.head) else seen
        gram = wanted[open_] & ((1 << BITS * (k + 1)) - 1)
        at, known = level.find_context(gram >> BITS)
        place, hit = level.find(gram)
        before = longer_at[open_]
        total, kinds = (x[at] if len(x) else np.zeros(len(at), int) for x in (level.total, level.kinds))
        if longer is not None and len(longer.head):
            excluded = before >= 0
            total = total - np.where(excluded, lost[before], 0)
            kinds = kinds - np.where(excluded, longer.kinds[before], 0)
        # Nothing left to tell apart here: the escape is certain.
        live = known & (kinds > 0)
        share = np.where(hit & live, 2 * level.count[place] - 1 if len(level.count) else 1, kinds)
        step = np.where(live, np.log10(np.maximum(share, 1)) - np.log10(np.maximum(2 * total, 1)), 0.0)
        out[open_] += step
        longer_at[open_] = np.where(known, at, -1)
        # Every context that has a longer seen one above is seen itself, so longer_at is of this level.
        longer = level
        open_ = open_[~(hit & live)]
    seen = len(trie[-1].gram)
    out[open_] -= np.log10(max(ALPHABET - seen, 1))
    return out


def _gram_counts(order: int):
    """Rows (block, gram, n) from texts sorted by block; n counts training texts only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, parts in _by_block(batches):
            key, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for texts, training in parts:
                for used in (True, False):
                    some = [grams(tokens(t), order) for t, u in zip(texts, training, strict=True) if u == used]
                    if some:
                        own, n = np.unique(np.concatenate(some), return_counts=True)
                        key, count = _summed(np.r_[key, own], np.r_[count, n if used else 0 * n])
                if len(key) > HELD:
                    yield from _sliced([np.full(len(key), block), key, count], ["block", "gram", "n"])
                    key, count = key[:0], count[:0]
            yield from _sliced([np.full(len(key), block), key, count], ["block", "gram", "n"])

    return run


def _token_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, token, n) from texts sorted by block; n counts training texts only."""
    for block, parts in _by_block(batches):
        count: Counter[bytes] = Counter()
        for texts, training in parts:
            for text, used in zip(texts, training, strict=True):
                if used:
                    count.update(tokens(text))
                else:
                    for token in set(tokens(text)):
                        count[token] += 0
            if len(count) > HELD // 4:
                yield from _token_rows(block, count)
                count = Counter()
        yield from _token_rows(block, count)


def _token_rows(block: int, count: Counter[bytes]) -> Iterator[pa.RecordBatch]:
    cols = [np.full(len(count), block), pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64())]
    return _sliced(cols, ["block", "token", "n"])


def _hash(word: bytes) -> int:
    """Spark's xxhash64 of the word, unsigned."""
    return xxhash.xxh64_intdigest(word, 42)


def _asked(order: int):
    """Rows (block, word, key): the distinct grams, and hashes of words, of each block's texts,
    from texts sorted by block. What is held is as much as scoring the block holds."""

    def merged(held: list[np.ndarray], most: int) -> list[np.ndarray]:
        """One array without repeats, once the others together exceed it and that many."""
        if sum(map(len, held[1:])) <= max(most, len(held[0])):
            return held
        return [np.unique(np.concatenate(held))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, parts in _by_block(batches):
            gram, word = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for texts, _ in parts:
                split = [tokens(t) for t in texts]
                gram = merged([*gram, np.unique(np.concatenate([grams(w, order) for w in split]))], 10 * HELD)
                hashes = [_hash(w) for w in set().union(*split)]
                word = merged([*word, np.array(hashes, np.uint64).view(np.int64)], HELD)
            for some, is_word in ((gram, False), (word, True)):
                key = np.unique(np.concatenate(some))
                yield from _sliced([np.full(len(key), block), np.full(len(key), is_word), key], ["block", "word", "key"])

    return run


def _by_block(batches: Iterator[pa.RecordBatch]):
    """(block, parts) from rows (block, text, training) sorted by block; a part is texts and their
    training marks, PART characters or one text long."""
    rows = (
        row
        for batch in batches
        for row in zip(
            batch.column(0).to_pylist(), texts_of(batch.column(1)), batch.column(2).to_pylist(), strict=True
        )
    )
    for block, own in groupby(rows, key=lambda row: row[0]):
        yield block, _parts(own)


def _parts(rows):
    texts, training, size = [], [], 0
    for _, text, used in rows:
        texts.append(text)
        training.append(used)
        size += len(text)
        if size >= PART:
            yield texts, training
            texts, training, size = [], [], 0
    if texts:
        yield texts, training


def _sliced(cols: list, names: list[str], rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names)
    for at in range(0, len(whole), rows):
        yield whole.slice(at, rows)


def _share_log_probs(order: int):
    """log10 probabilities of a share's grams. left: context2, gram, n. right: the grams of
    contexts of one and no byte that the share's contexts end in."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        wanted = left["gram"].to_numpy()
        n = left["n"].to_numpy()
        trie = levels(wanted[n > 0], n[n > 0], order, 2)
        size = right["size"].to_numpy()
        for k in (1, 0):
            own = size == k
            trie.append(Level(*_summed(right["gram"].to_numpy()[own], right["n"].to_numpy()[own])))
        return pa.table({"gram": wanted, "value": log_probs(wanted, order, trie)})

    return run


class Lookup:
    """Values by 64-bit key, for keys that are all there: buckets of hashed keys, a few in each."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        mixed = self._mixed(keys)
        order = np.argsort(mixed)
        self.mixed, self.values = mixed[order], values[order]
        self.shift = np.uint64(64 - max(1, int(len(keys)).bit_length()))
        self.start = np.searchsorted(self.mixed >> self.shift, np.arange((1 << (64 - int(self.shift))) + 1, dtype=np.uint64))
        self.start = self.start.astype(np.int32)

    @staticmethod
    def _mixed(keys: np.ndarray) -> np.ndarray:
        x = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        wanted = self._mixed(keys)
        at = self.start[(wanted >> self.shift).astype(np.int64)]
        miss = np.flatnonzero(self.mixed[np.minimum(at, len(self.mixed) - 1)] != wanted)
        while len(miss):
            at[miss] += 1
            miss = miss[self.mixed[at[miss]] != wanted[miss]]
        return self.values[at]


def _scored(texts: list[str], order: int, count_of, value_of: Lookup) -> dict[str, list]:
    """n_tokens, n_known, base (before the common norm) and score of each text. count_of: the
    training counts of a list of tokens."""
    out = {"n_tokens": [], "n_known": [], "base": [], "score": []}
    for part, _ in _parts((None, text, None) for text in texts):
        split = [tokens(t) for t in part]
        sizes = np.array([len(w) for w in split])
        seen = count_of(split)
        head = np.cumsum(sizes) - sizes
        out["n_tokens"] += sizes.tolist()
        out["n_known"] += np.add.reduceat(seen > 0, head, dtype=np.int64).tolist()
        out["base"] += np.add.reduceat(np.log10(seen + 0.5), head).tolist()
        asked = [grams(words, order) for words in split]
        starts = np.cumsum([0, *map(len, asked[:-1])])
        out["score"] += np.add.reduceat(value_of(np.concatenate(asked)), starts).tolist()
    return out


@lru_cache(maxsize=1)
def _tables(name: str) -> list:
    """What this worker has unpacked of the broadcast tables of this name; the last name's only."""
    return []


def _counts(by_hash: Lookup, known: dict[bytes, float], shared: dict[bytes, float]):
    """The training counts of texts' tokens: by hash, but for those whose hash is shared by unlike
    tokens. known: what is remembered of them."""

    def count_of(split: list[list[bytes]]) -> np.ndarray:
        if len(known) > REMEMBERED + len(shared):
            known.clear()
        known.update(shared)
        fresh = list({w for words in split for w in words if w not in known})
        if fresh:
            hashes = np.array([_hash(w) for w in fresh], np.uint64).view(np.int64)
            known.update(zip(fresh, by_hash(hashes).tolist(), strict=True))
        return np.array([known[w] for words in split for w in words], float)

    return count_of


def _score_rows(order: int, gram_table, token_table):
    """Scores of texts with both tables at hand. Tokens are looked up by hash, which the caller
    has checked to be unlike for unlike tokens."""
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _tables(name)
        if not held:
            keys, values = (np.frombuffer(x, t) for x, t in zip(gram_table.value, (np.int64, np.float64), strict=True))
            hashes, counts = (np.frombuffer(x, np.int64) for x in token_table.value)
            held += Lookup(keys, values), Lookup(hashes, counts), {}
            del keys, values, hashes, counts
            for sent in (gram_table, token_table):  # read again from its file if it is needed again
                sent.__dict__.pop("_value", None)
        value_of, by_hash, known = held

        count_of = _counts(by_hash, known, {})
        for batch in batches:
            if len(batch):
                found = _scored(texts_of(batch.column(1)), order, count_of, value_of)
                cols = [batch.column(0), batch.column(2), *(pa.array(x) for x in found.values())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", *found])

    return run


def _score_block(order: int):
    """Scores of a block's documents from the values of its grams and the counts of its tokens."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        key, value = right["key"].to_numpy(), right["value"].to_numpy()
        word, named = right["word"].to_numpy(), pa.compute.is_valid(right["token"])
        gram, plain = ~word, word & ~named.to_numpy()
        value_of, by_hash = Lookup(key[gram], value[gram]), Lookup(key[plain], value[plain])
        some = right.select(["token", "value"]).filter(named)
        shared = dict(zip(some["token"].to_pylist(), some["value"].to_pylist(), strict=True))
        count_of = _counts(by_hash, {}, shared)
        found = _scored(texts_of(left["text"]), order, count_of, value_of)
        return pa.table({"doc_id": left["doc_id"], "held_out": left["held_out"], **found})

    return run


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"


def held_out(doc_id: Column, folds: int = 5, fold: int = 1) -> Column:
    """Whether crc32 of the id as text leaves this remainder; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def lm_scores(
    docs: DataFrame,
    order: int = ORDER,
    id_col: str = "doc_id",
    text_col: str = "text",
    most_grams: int = MOST_GRAMS,
    most_tokens: int = MOST_TOKENS,
) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    base_score: log10 of the smoothed unigram probability of the tokens. score: log10 probability
    under the trie of the training documents (those not held out). Null and empty texts are one
    token, the end. A null id is never held out. Rows that repeat an id are scored, and learnt
    from, each. Without training documents every symbol has probability 1/257 and N and V are 0.
    An empty table gives no rows.
    """
    if not 3 <= order <= 6:
        raise ValueError("order must be 3 to 6: a gram is one 64-bit number and shares are cut at two bytes")
    spark = docs.sparkSession
    small_batches(spark)
    docs = pick(docs, id_col, text_col).toDF("doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = docs.withColumn("held_out", held_out(F.col("doc_id")))
    plain = rows.select(F.lit(0).cast("long").alias("block"), "text", (~F.col("held_out")).alias("training"))
    values = plain.mapInArrow(_gram_counts(order), GRAMS).groupBy("gram").agg(F.sum("n").alias("n"))
    values = cut(_values(cut(values, "lm-grams"), order), "lm-values")
    vocabulary = plain.mapInArrow(_token_counts, TOKENS).groupBy("token").agg(F.sum("n").alias("c"))
    vocabulary = cut(vocabulary.withColumn("hash", F.xxhash64("token")), "lm-tokens")
    totals = vocabulary.agg(
        F.coalesce(F.sum("c"), F.lit(0).cast("long")).alias("train_tokens"),
        F.count_if(F.col("c") > 0).alias("v"),
    )
    n_grams, n_tokens = values.count(), vocabulary.count()
    small = n_grams <= most_grams and n_tokens <= most_tokens
    if small and vocabulary.select("hash").distinct().count() == n_tokens:
        table = values.toArrow()
        gram_table = spark.sparkContext.broadcast(
            (table["gram"].to_numpy().tobytes(), table["value"].to_numpy().tobytes())
        )
        table = vocabulary.select("hash", "c").toArrow()
        token_table = spark.sparkContext.broadcast((table["hash"].to_numpy().tobytes(), table["c"].to_numpy().tobytes()))
        del table
        ordered = rows.select("doc_id", "text", "held_out")
        scored = ordered.mapInArrow(_score_rows(order, gram_table, token_table), SCORES)
    else:
        scored = _by_blocks(rows, values, vocabulary, order)
    norm = F.log10(F.col("train_tokens") + 0.5 * (F.col("v") + 1))
    return scored.crossJoin(F.broadcast(totals)).select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        "train_tokens",
        (F.col("base") - F.col("n_tokens") * norm).alias("base_score"),
        "score",
    )


GRAMS, TOKENS = "block long, gram long, n long", "block long, token binary, n long"
ASKED = "block long, word boolean, key long"


def _values(total: DataFrame, order: int) -> DataFrame:
    """gram, value: log10 probabilities. total: gram, n (0 where only held-out texts have it)."""
    last = (1 << 2 * BITS) - 1
    total = total.withColumn("context2", F.shiftright("gram", BITS).bitwiseAND(F.lit(last)))
    used = total.where("n > 0")
    one = used.groupBy(F.col("gram").bitwiseAND(F.lit(last)).alias("gram")).agg(F.sum("n").alias("n"))
    none = one.groupBy(F.col("gram").bitwiseAND(F.lit((1 << BITS) - 1)).alias("gram")).agg(F.sum("n").alias("n"))
    # At most 258**2 contexts of two bytes, each with at most 2 * 257 grams of shorter contexts.
    ends = total.select("context2").distinct()
    byte = F.col("context2").bitwiseAND(F.lit((1 << BITS) - 1))
    lower = ends.withColumn("end", byte).join(one.withColumn("end", F.shiftright("gram", BITS)), "end")
    lower = lower.select("context2", "gram", "n", F.lit(1).alias("size")).unionByName(
        ends.crossJoin(F.broadcast(none)).withColumn("size", F.lit(0))
    )
    lower = lower.select(*[F.col(c).alias(c) for c in lower.columns])
    return (
        total.select(*[F.col(c).alias(c) for c in total.columns])
        .groupBy("context2")
        .cogroup(lower.groupBy("context2"))
        .applyInArrow(_share_log_probs(order), "gram long, value double")
    )


def _by_blocks(rows: DataFrame, values: DataFrame, vocabulary: DataFrame, order: int) -> DataFrame:
    """Scores where the tables are too large to broadcast."""
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(chars / BLOCK_CHARS))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks))).repartition("block")
    sorted_ = dealt.select("block", "text", F.lit(False).alias("training")).sortWithinPartitions("block")
    asked = cut(sorted_.mapInArrow(_asked(order), ASKED), "lm-asked")
    found = asked.where("NOT word").join(values.withColumnRenamed("gram", "key"), "key")
    grams_ = found.select("block", "word", "key", F.lit(None).cast("binary").alias("token"), "value")
    # The token itself goes along only where unlike tokens share a hash.
    named = F.when(F.count(F.lit(1)).over(Window.partitionBy("hash")) > 1, F.col("token"))
    counted = vocabulary.select(F.col("hash").alias("key"), named.alias("token"), F.col("c").cast("double").alias("value"))
    words = asked.where("word").join(counted, "key").select("block", "word", "key", "token", "value")
    return (
        dealt.groupBy("block")
        .cogroup(grams_.unionByName(words).groupBy("block"))
        .applyInArrow(_score_block(order), SCORES)
    )
