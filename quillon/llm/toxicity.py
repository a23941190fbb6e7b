"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel of two words is over their subsequences of three characters, word borders counted as
characters; each occurrence weighs DECAY for every character it spans, up to SPAN of them, so a
word with letters inserted or left out stays close to the plain one. Landmark words give the
Nyström features, a sentence is the sum of its words over the root of their number, and a linear
SVM is trained on labelled sentences: those of toxic documents that it finds most toxic against
those of clean ones. As the model is linear in the words' kernel vectors it folds into one weight
for each subsequence, and scoring a distinct word costs its own subsequences only. A logistic
layer turns a document's sentence scores and counts of telling words into its score.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import pick, small_batches, texts_of

DECAY, SPAN = 0.6, 7
SENTENCE = re.compile(r"[.!?\n]+")
#: Single letters apart from each other are one word written wide.
WIDE = re.compile(r"(?<!\S)(?:\w[ ]){3,}\w(?!\S)")
EDGES = "\"'`*#$%&|,;:()[]{}<>-_=+~^/\\@0123456789"
#: Longer words are taken apart where punctuation joins them; parts that are still longer count as
#: pieces of this length, each sharing its last SHARED characters with the next, so that an insult
#: of up to that length is whole in one of them.
LONGEST, SHARED = 40, 20
JOINS = re.compile("[_\\-,/|\\\\;:&=?+<>()\\[\\]{}\"#%~^\u00ab\u00bb\u2010-\u2027\u2030-\u205e\u3000-\u303f"
                   "\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]+")  # fmt: skip
#: Words a worker remembers; beyond it starts anew. Bounds memory, not results.
REMEMBERED = 500_000
STEPS = np.array([[0, *c] for c in combinations(range(1, SPAN), 2)])


def pieces(word: str) -> list[str]:
    """The word, or the parts of at most LONGEST characters that hold all of a longer one."""
    if len(word) <= LONGEST:
        return [word]
    out = []
    for part in filter(None, (x.strip(EDGES) for x in JOINS.split(word))):
        out += [part[at : at + LONGEST] for at in range(0, max(1, len(part) - SHARED), LONGEST - SHARED)]
    return out


def sentences(text: str) -> list[list[str]]:
    """The words of each sentence, lower-cased, without punctuation around them, long ones in pieces."""
    text = WIDE.sub(lambda m: m.group().replace(" ", ""), text.lower())
    out = []
    for part in SENTENCE.split(text):
        words = [w for x in part.split() for w in pieces(x.strip(EDGES)) if w]
        if words:
            out.append(words)
    return out


def vectors(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, subsequence code, weight) of the normalised kernel vectors, sorted by word."""
    inner = ["\x01" + w + "\x02" for w in words]
    size = np.array([len(w) for w in inner], np.int64)
    raw = np.frombuffer("".join(inner).encode("utf-32-le", "surrogatepass"), np.uint32)
    alphabet, char = np.unique(raw, return_inverse=True)
    if len(alphabet) >= 1 << 15 or len(words) >= 1 << 18:
        half = len(words) // 2
        (a, b, c), (x, y, z) = vectors(words[:half]), vectors(words[half:])
        return np.r_[a, x + half], np.r_[b, y], np.r_[c, z]
    char = char.astype(np.int64)
    end = np.repeat(np.cumsum(size), size)
    first = np.repeat(np.arange(len(words), dtype=np.int64), size) << 45 | char << 30
    at = np.arange(len(char))
    keys, weights = [], []
    for _, j, k in STEPS:
        i = at[: len(at) - k][at[k:] < end[: len(at) - k]]
        keys.append(first[i] | char[i + j] << 15 | char[i + k])
        weights.append(np.full(len(i), DECAY ** (k + 1.0)))
    key, weight = np.concatenate(keys), np.concatenate(weights)
    if not len(key):
        return key, key, weight
    order = np.argsort(key)
    key, weight = key[order], weight[order]
    head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    key, weight = key[head], np.add.reduceat(weight, head)
    owner = key >> 45
    norm = np.sqrt(np.bincount(owner, weight * weight, len(words)))
    wide = alphabet.astype(np.int64)
    code = wide[key >> 30 & 0x7FFF] << 42 | wide[key >> 15 & 0x7FFF] << 21 | wide[key & 0x7FFF]
    return owner, code, weight / norm[owner]


@dataclass
class Model:
    """Subsequence weights, the SVM's offset and the logistic layer."""

    codes: np.ndarray
    weights: np.ndarray
    telling: float
    layer: np.ndarray

    def words(self, words: list[str]) -> np.ndarray:
        """What each word adds to its sentence's margin."""
        owner, code, weight = vectors(words)
        if not len(self.codes) or not len(code):
            return np.zeros(len(words))
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        hit = self.codes[at] == code
        return np.bincount(owner[hit], weight[hit] * self.weights[at[hit]], len(words))

    def remember(self, split: list[list[list[str]]], known: dict[str, float]) -> None:
        if len(known) > REMEMBERED:
            known.clear()
        fresh = list({w for doc in split for words in doc for w in words if w not in known})
        for at in range(0, len(fresh), 20_000):
            part = fresh[at : at + 20_000]
            known.update(zip(part, self.words(part).tolist(), strict=True))

    def features(self, split: list[list[list[str]]], known: dict[str, float]) -> np.ndarray:
        """Of each document: its most toxic sentences, and how many words are telling."""
        self.remember(split, known)
        out = np.zeros((len(split), 5))
        for i, doc in enumerate(split):
            margins, total, told, strongest = [], 0, 0, 0.0
            for words in doc:
                adds = list(map(known.__getitem__, words))
                margins.append(sum(adds) / len(adds) ** 0.5)
                total += len(adds)
                strongest = max(strongest, *adds)
                told += sum(a > self.telling for a in adds)
            best = sorted(margins)[-3:]
            if best:
                out[i] = best[-1], sum(best) / 3, np.log1p(told), told / (total + 5.0), strongest
        return out

    def score(self, texts: list[str], known: dict[str, float]) -> np.ndarray:
        x = self.features([sentences(t) for t in texts], known)
        return _sigmoid(x @ self.layer[:-1] + self.layer[-1])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 1.0) -> np.ndarray:
    """Weights and offset of a linear SVM with squared hinge loss, by Newton's method."""
    x = np.c_[x, np.ones(len(x))]
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(30):
        active = y * (x @ w) < 1
        xa, c = x[active], cost * weight[active]
        new = np.linalg.solve(ridge + (xa * c[:, None]).T @ xa, (xa * (c * y[active])[:, None]).sum(0))
        if np.allclose(new, w, rtol=1e-6, atol=1e-9):
            break
        w = new
    return w


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights and offset of a logistic regression, by Newton's method on scaled columns."""
    scale = x.std(0) + 1e-9
    x = np.c_[x / scale, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    keep = np.eye(x.shape[1]) * ridge
    keep[-1, -1] = 1e-6
    for _ in range(50):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return np.r_[w[:-1] / scale, w[-1]]


def _landmarks(split: list[list[list[str]]], toxic: np.ndarray, telling: int, plain: int) -> list[str]:
    """Words far more frequent in toxic documents than chance, then the most frequent others."""
    base = toxic.mean()
    inside, bad = Counter(), Counter()
    for doc, y in zip(split, toxic, strict=True):
        own = {w for words in doc for w in words}
        inside.update(own)
        if y:
            bad.update(own)
    lift = {w: (bad[w] - n * base) / (n * base * (1 - base) + 1e-9) ** 0.5 for w, n in inside.items() if n >= 2}
    first = [w for w in sorted(lift, key=lambda w: (-lift[w], w)) if lift[w] > 0][:telling]
    rest = sorted(lift.keys() - set(first), key=lambda w: (-inside[w], w))[:plain]
    return first + rest


def fit(texts: list[str], toxic: list[int], telling: int = 192, plain: int = 64, rounds: int = 3,
        per_class: int = 8_000) -> Model:
    """A model from labelled texts; without both labels it gives every text the mean label.

    telling, plain: landmark words. per_class: sentences of each label at most, taken at random
    with a fixed seed, that train the SVM; it bounds the fit's memory. The landmarks, the threshold
    of telling words and the logistic layer use all sentences.
    """
    y = np.array([int(t == 1) for t in toxic])
    pool: dict[str, str] = {}  # one object for each distinct word
    split = [[[pool.setdefault(w, w) for w in s] for s in sentences(t)] for t in texts]
    del pool
    none = Model(np.zeros(0, np.int64), np.zeros(0), 1.0, np.zeros(6))
    if not len(y) or y.min() == y.max() or not any(split):
        p = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.0
        none.layer[-1] = np.log(max(p, 1e-6) / max(1 - p, 1e-6))
        return none
    marks = _landmarks(split, y, telling, plain)
    if not marks:
        marks = sorted({w for doc in split for words in doc for w in words})[: telling + plain]
    owner, code, weight = vectors(marks)
    codes = np.unique(code)
    table = np.zeros((len(codes), len(marks)))
    table[np.searchsorted(codes, code), owner] = weight
    gram = table.T @ table
    values, basis = np.linalg.eigh(gram)
    root = basis[:, values > 1e-6] / np.sqrt(values[values > 1e-6])
    # Sentences, evenly over the documents of a class.
    rng = np.random.default_rng(7)
    chosen: list[tuple[int, list[str]]] = []
    for label in (0, 1):
        own = [(i, s) for i in np.flatnonzero(y == label) for s in split[i]]
        which = rng.permutation(len(own))[:per_class]
        chosen += [own[k] for k in which]
    words = sorted({w for _, s in chosen for w in s})
    place = {w: i for i, w in enumerate(words)}
    to_words = np.zeros((len(words), root.shape[1]), np.float32)
    folded = (table @ root).astype(np.float32)
    for at in range(0, len(words), 5_000):
        owner, code, weight = vectors(words[at : at + 5_000])
        pos = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
        hit = codes[pos] == code
        owner, pos, weight = owner[hit], pos[hit], weight[hit].astype(np.float32)
        head = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, int)
        if len(head):
            for lo in range(0, len(head), 500):
                a, b = head[lo], head[lo + 500] if lo + 500 < len(head) else len(owner)
                rows = folded[pos[a:b]] * weight[a:b, None]
                to_words[at + owner[head[lo : lo + 500]]] = np.add.reduceat(rows, head[lo : lo + 500] - a)
    doc_of = np.array([i for i, _ in chosen])
    x = np.stack([to_words[[place[w] for w in s]].sum(0) / len(s) ** 0.5 for _, s in chosen]).astype(float)
    label = np.where(y[doc_of] == 1, 1.0, -1.0)
    use = np.ones(len(x), bool)
    for _ in range(rounds):
        share = np.where(label > 0, 1 / max(1, (use & (label > 0)).sum()), 1 / max(1, (use & (label < 0)).sum()))
        w = _svm(x[use], label[use], share[use] * 2_000)
        margin = x @ w[:-1] + w[-1]
        # Of a toxic document, the most toxic third of its sentences stays.
        order = np.lexsort((-margin, doc_of))
        rank = np.empty(len(order), int)
        start = np.r_[True, doc_of[order][1:] != doc_of[order][:-1]]
        rank[order] = np.arange(len(order)) - np.repeat(
            np.flatnonzero(start), np.diff(np.r_[np.flatnonzero(start), len(order)])
        )
        use = (label < 0) | (rank < np.maximum(1, np.bincount(doc_of)[doc_of] // 3))
    model = Model(codes, table @ (root @ w[:-1]), 0.0, np.zeros(6))
    known: dict[str, float] = {}
    model.remember(split, known)
    model.telling = _threshold(split, y, known)
    model.layer = _logistic(model.features(split, known), y)
    return model


def _threshold(split: list[list[list[str]]], y: np.ndarray, known: dict[str, float]) -> float:
    """The word margin whose count above it separates the classes best."""
    best, found = -1.0, 1.0
    adds = [np.array([known[w] for words in doc for w in words]) for doc in split]
    for cut_ in np.quantile(np.array(list(known.values())), np.linspace(0.9, 0.9995, 30)):
        rate = np.array([(a > cut_).sum() / (len(a) + 5.0) for a in adds])
        gap = rate[y == 1].mean() - rate[y == 0].mean()
        value = gap / (rate.std() + 1e-9)
        if value > best:
            best, found = value, float(cut_)
    return found


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    """Whether crc32 of the id as text leaves this remainder; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, per_class: int = 2000, most_chars: int = 50_000) -> Model:
    """Fits on a bounded sample of labelled rows outside the held-out fold.

    per_class: documents of each label at most, by order of a hash of the id. most_chars: longer
    documents do not enter the sample, the next ones take their places. docs: doc_id, text; labels: doc_id, toxic. An id with
    several labels counts as toxic if any is 1.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    docs = docs.where(F.length("text") <= most_chars)
    known = known.join(docs.select("doc_id"), "doc_id", "left_semi")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = known.where("toxic = 1").orderBy(*order).limit(per_class)
    sample = sample.unionByName(known.where("toxic = 0").orderBy(*order).limit(per_class))
    rows = docs.join(F.broadcast(sample), "doc_id")
    made = rows.select("doc_id", "text", "toxic").repartition(1).mapInArrow(_fitted, "model binary").first()
    return pickle.loads(made["model"]) if made else fit([], [])


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of all rows (doc_id, text, toxic), as one row; the sample is bounded."""
    rows: list[tuple] = []
    for batch in batches:
        rows += zip(*(c.to_pylist() for c in batch.columns), strict=True)
    rows.sort()
    model = fit([r[1] for r in rows], [r[2] for r in rows])
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])


@lru_cache(maxsize=2)
def _memory(name: str) -> dict[str, float]:
    """Word margins of the model of this name that this worker remembers."""
    return {}


def _scores(model: Model, text_at: int = 1):
    """Adds the score of the text in this column to rows of any columns, named c0, c1, ..."""
    name = hashlib.sha256(model.codes.tobytes() + model.weights.tobytes()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _memory(name)
        for batch in batches:
            score = model.score(texts_of(batch.column(text_at)), known)
            names = [f"c{i}" for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*names, "score"])

    return run


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    threshold: float = 0.3,
    id_col: str = "doc_id",
    text_col: str = "text",
    per_class: int = 2000,
    model: Model | None = None,
) -> DataFrame:
    """One row per document: doc_id, held_out, score in [0, 1], predicted (1 if score >= threshold).

    Null and empty texts get the score of a text without words. A null id is not held out and
    never trained on. Rows that repeat an id are scored each. Without labels every score is the
    prior. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    docs = pick(docs, id_col, text_col).toDF("doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    labels = pick(labels, "doc_id", "toxic")
    model = model or train(docs, labels, per_class)
    scored = _scored(docs, 1, model).select(
        F.col("c0").alias("doc_id"), held_out(F.col("c0")).alias("held_out"), "score"
    )
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def _scored(docs: DataFrame, text_at: int, model: Model) -> DataFrame:
    """The columns as c0, c1, ... and the score of each row's text."""
    wide = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema)) + ", score double"
    return wide.mapInArrow(_scores(model, text_at), schema)


def without_toxic(
    docs: DataFrame,
    labels: DataFrame,
    threshold: float = 0.3,
    id_col: str = "doc_id",
    text_col: str = "text",
    per_class: int = 2000,
) -> DataFrame:
    """The rows of docs whose text scores below the threshold, all columns as they were.

    Each row is judged by its own text, so null ids and rows that repeat an id need no care. Null
    and empty texts stay unless the score of a text without words is as high. An empty table gives
    no rows.
    """
    small_batches(docs.sparkSession)
    plain = pick(docs, id_col, text_col).toDF("doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    model = train(plain, pick(labels, "doc_id", "toxic"), per_class)
    kept = _scored(docs, docs.columns.index(text_col), model).where(F.col("score") < threshold)
    return kept.select(*[F.col(f"c{i}").alias(name) for i, name in enumerate(docs.columns)])
