"""Line dedup by content-defined chunks of lines.

A polynomial rolling hash over the hashes of the last lines says where a chunk ends, so the same
lines give the same chunks wherever they stand in a text, once the window has passed their start.
A line of many words is a chunk of its own. Chunks of several lines, or of one such long line,
that occur again anywhere in the corpus are removed after their bytes have been compared; the
first occurrence stays. Where chunks end near the edges of a passage depends on its surroundings, so
runs compares every window of two neighbouring lines besides: whatever the lines around it, each
line of a run of two or more that came before goes. Hashes are counted first, and only parts whose
hash may repeat are compared. A task settles its own repeats, so however often a part occurs, each
task sends it on once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import cut, filter_bits, pick, small_batches, texts_of

#: Lines of the rolling window; one in MEAN windows ends a chunk; lines of a chunk at least; words
#: that make a line a chunk by itself.
WINDOW, MEAN, LEAST, LONG = 2, 2, 2, 50
#: Bits, 4 MB, of the filter of hashes that repeat. More of them let more through, never less.
REPEAT_BITS = 1 << 25
FACTOR, MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
#: Characters whose repeats a task settles by itself at a time; bounds its memory.
SETTLED = 16_000_000


def chunks(text: str) -> list[tuple[int, int, bool]]:
    """(first line, line after the last, whether it may be removed) of the chunks of a text."""
    lines = text.split("\n")
    out: list[tuple[int, int, bool]] = []
    begin, roll, gone = 0, 0, pow(FACTOR, WINDOW, 1 << 64)
    window: list[int] = []

    def close(end: int) -> None:
        nonlocal begin
        if end > begin:
            out.append((begin, end, sum(bool(x.strip()) for x in lines[begin:end]) >= 2))
            begin = end

    for i, line in enumerate(lines):
        value = xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"))
        window.append(value)
        roll = roll * FACTOR + value
        if len(window) > WINDOW:
            roll -= window.pop(0) * gone
        roll &= MASK
        if len(line) >= 2 * LONG and len(line.split()) >= LONG:
            close(i)
            begin = i + 1
            out.append((i, i + 1, True))
        elif i + 1 - begin >= LEAST and (roll * FACTOR >> 32 & 0xFFFF) % MEAN == 0:
            close(i + 1)
    close(len(lines))
    return out


def windows(lines: list[str]) -> list[tuple[int, int]]:
    """(first line, line after the last) of each two neighbouring lines that are not blank."""
    full = [i for i, line in enumerate(lines) if line and not line.isspace()]
    return [(i, j + 1) for i, j in zip(full, full[1:])]


def _part(lines: list[str], begin: int, end: int) -> bytes:
    return "\n".join(lines[begin:end]).encode("utf-8", "surrogatepass")


LEADERS = "doc_id long, mark long, no int, hash long, part binary"


def _hash(part: bytes) -> int:
    return xxhash.xxh64_intdigest(part)


#: First byte of the bytes of a window; no text has it, so none equal those of a chunk.
PAIR = b"\xff"


def _parts(text: str, runs: bool) -> list[tuple[int, bytes]]:
    """(number, bytes) of what may be removed: chunks, then windows without blank lines between."""
    lines, held = text.split("\n"), chunks(text)
    out = [(no, _part(lines, begin, end)) for no, (begin, end, may) in enumerate(held) if may]
    if runs:
        for no, (begin, end) in enumerate(windows(lines), len(held)):
            out.append((no, PAIR + _part([lines[begin], lines[end - 1]], 0, 2)))
    return out


def _overlap(part: bytes, one: tuple, two: tuple) -> bool:
    """Whether two places (..., number) of these bytes share a line: windows side by side do."""
    return part[:1] == PAIR and one[:-1] == two[:-1] and abs(one[-1] - two[-1]) == 1


def _counted(runs: bool):
    """Rows (hash, n): how often the parts that may be removed occur here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter[int] = Counter()

        def rows() -> pa.RecordBatch:
            hashes = np.fromiter(count.keys(), np.uint64, len(count)).view(np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(hashes), pa.array(list(count.values()), pa.int64())], ["hash", "n"]
            )

        for batch in batches:
            for text in texts_of(batch.column(0)):
                count.update(_hash(part) for _, part in _parts(text, runs))
            if len(count) > 200_000:
                yield rows()
                count.clear()
        yield rows()

    return run


def _repeat_bits(docs: DataFrame, runs: bool) -> bytes:
    """Filter bits of the hashes that occur more than once."""
    counts = docs.select("text").mapInArrow(_counted(runs), "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    return filter_bits(counts.where("n > 1").selectExpr(f"CAST(pmod(hash, {REPEAT_BITS}) AS int) AS slot"), REPEAT_BITS)


def _settled(repeats_of, runs: bool):
    """Rows of LEADERS: the first of each part here with its bytes, its repeats without; of
    parts whose hash has its bit set. A window that shares a line with the first is sent with its
    bytes too: it goes only if there is an earlier first elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(repeats_of.value, np.uint32)
        firsts: dict[bytes, tuple] = {}
        unsure: list[tuple] = []
        repeats: list[tuple] = []
        size = 0
        for batch in batches:
            ids, marks = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for doc_id, text, mark in zip(ids, texts_of(batch.column(1)), marks, strict=True):
                for no, part in _parts(text, runs):
                    slot = _hash(part) % REPEAT_BITS
                    if not bits[slot >> 5] >> (slot & 31) & 1:
                        continue
                    own = (doc_id is None, doc_id or 0, mark, no)
                    held = firsts.get(part)  # equal bytes, not only equal hashes
                    if held is None:
                        firsts[part] = own
                        size += len(part)
                        continue
                    if own == held:
                        continue
                    firsts[part], later = min(own, held), max(own, held)
                    if _overlap(part, own, held):
                        unsure.append((later, part))
                        size += len(part)
                    else:
                        repeats.append((later, part))
            if size > SETTLED or len(repeats) > 200_000:
                yield from _flush(firsts, unsure, repeats)
                firsts, unsure, repeats, size = {}, [], [], 0
        yield from _flush(firsts, unsure, repeats)

    return run


def _flush(firsts: dict[bytes, tuple], unsure: list[tuple], repeats: list[tuple]) -> Iterator[pa.RecordBatch]:
    rows = [(own, part, part) for part, own in firsts.items()] + [(own, part, part) for own, part in unsure]
    rows += [(own, part, None) for own, part in repeats]
    for at in range(0, len(rows), 2_000):
        some = rows[at : at + 2_000]
        hashes = np.array([_hash(part) for _, part, _ in some], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([None if own[0] else own[1] for own, _, _ in some], pa.int64()),
                pa.array([own[2] for own, _, _ in some], pa.int64()),
                pa.array([own[3] for own, _, _ in some], pa.int32()),
                pa.array(hashes),
                pa.array([sent for _, _, sent in some], pa.binary()),
            ],
            ["doc_id", "mark", "no", "hash", "part"],
        )


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (hash, doc_id, mark, no): those whose bytes came before.

    Holds the different parts of one hash; that is one, but for collisions.
    """
    key, seen = None, []
    for batch in batches:
        again = []
        hashes, docs, marks, nos = (batch.column(i).to_pylist() for i in (0, 1, 2, 3))
        for at, value in enumerate(hashes):
            part = batch.column(4)[at].as_buffer().to_pybytes()
            own = (docs[at], marks[at], nos[at])
            if value != key:
                key, seen = value, []
            held = next((x for x in seen if x[0] == part), None)
            if held is None:
                seen.append((part, own))
            again.append(held is not None and held[1] != own and not _overlap(part, held[1], own))
        yield pa.RecordBatch.from_arrays(
            [batch.column(1), batch.column(2), batch.column(3)], ["doc_id", "mark", "no"]
        ).filter(pa.array(again, pa.bool_()))


def removals(docs: DataFrame, runs: bool = False) -> DataFrame:
    """doc_id, mark, nos: the numbers of the parts to be removed. docs: doc_id, text, mark."""
    bits = docs.sparkSession.sparkContext.broadcast(_repeat_bits(docs, runs))
    sent = cut(docs.select("doc_id", "text", "mark").mapInArrow(_settled(bits, runs), LEADERS), "line-chunks")
    firsts = (
        sent.where("part IS NOT NULL")
        .select("hash", F.col("doc_id"), "mark", "no", "part")
        .repartition("hash")
        .sortWithinPartitions("hash", F.col("doc_id").asc_nulls_last(), "mark", "no")
        .mapInArrow(_repeated, "doc_id long, mark long, no int")
    )
    gone = sent.where("part IS NULL").select("doc_id", "mark", "no").unionByName(firsts)
    return gone.groupBy("doc_id", "mark").agg(F.collect_set("no").alias("nos"))


def _rebuilt(text_at: int, nos_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, gone = [], [], []
            nos = batch.column(nos_at).to_pylist()
            for text, drop in zip(batch.column(text_at).to_pylist(), nos, strict=True):
                lines = (text or "").split("\n")
                counts.append(len(lines) if text else 0)
                if not drop:
                    texts.append(text)
                    gone.append(0)
                    continue
                places = [(begin, end) for begin, end, _ in chunks(text)] + windows(lines)
                drop = {at for no in drop for at in range(*places[no])}
                kept = [line for at, line in enumerate(lines) if at not in drop]
                texts.append("\n".join(kept))
                gone.append(len(lines) - len(kept))
            cols = [pa.array(texts, pa.string()) if i == text_at else c for i, c in enumerate(batch.columns)]
            cols[nos_at] = pa.array(counts, pa.int64())
            names = [f"c{i}" for i in range(len(cols))] + ["gone"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(gone, pa.int64())], names)

    return run


def _deduped(docs: DataFrame, id_col: str, text_col: str, runs: bool) -> tuple[DataFrame, int, int]:
    """Columns c0, c1, ...: those of docs in their order, text rewritten, then lines and lines gone."""
    small_batches(docs.sparkSession)
    wide = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    id_at, text_at = docs.columns.index(id_col), docs.columns.index(text_col)
    wide = wide.withColumn("doc_id", F.col(f"c{id_at}").cast("long")).withColumn("mark", F.xxhash64(f"c{text_at}"))
    gone = removals(wide.select("doc_id", F.col(f"c{text_at}").alias("text"), "mark"), runs)
    gone = gone.select(F.col("doc_id").alias("g_id"), F.col("mark").alias("g_mark"), "nos")
    near = wide["doc_id"].eqNullSafe(gone["g_id"]) & (wide["mark"] == gone["g_mark"])
    joined = wide.join(gone, near, "left").drop("doc_id", "mark", "g_id", "g_mark")
    n = len(docs.columns)
    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema)) + f", c{n} long, gone long"
    return joined.mapInArrow(_rebuilt(text_at, n), schema), id_at, text_at


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: bool = False) -> DataFrame:
    """One row per document: doc_id, text (what is left), n_lines, n_removed (lines).

    runs: besides repeated chunks, all lines of each run of two or more lines, blank ones not
    counted, that came before. The occurrence that stays is the first by doc_id (null last), then
    by its place. Within a text a chunk that comes again goes as well, and a run that shares no
    line with the first. Null texts stay null, with 0 lines; empty texts stay
    empty. Rows that repeat both id and text are one document and get the same result. An empty
    table gives no rows.
    """
    done, id_at, text_at = _deduped(pick(docs, id_col, text_col), id_col, text_col, runs)
    return done.select(
        F.col(f"c{id_at}").cast("long").alias("doc_id"),
        F.col(f"c{text_at}").alias("text"),
        F.col("c2").alias("n_lines"),
        F.col("gone").alias("n_removed"),
    )


def rewrite(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars",
            runs: bool = False) -> DataFrame:
    """The documents, all columns as they were, with what is left of their texts.

    Documents of which nothing but white space is left are dropped; those that were blank stay.
    length_col, if there is one, follows the text. runs as in line_dedup.
    """
    done, _, text_at = _deduped(docs, id_col, text_col, runs)
    text = F.col(f"c{text_at}")
    done = done.where((F.col("gone") == 0) | text.rlike(r"[^\x20\x09-\x0D]"))
    cols = [
        F.length(text).cast(f.dataType).alias(f.name) if f.name == length_col else F.col(f"c{i}").alias(f.name)
        for i, f in enumerate(docs.schema)
    ]
    return done.select(*cols)
