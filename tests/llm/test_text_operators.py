"""SentencePiece coding, token counts, exact dedup and line dedup."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from llm_fixtures import EDGES
from quillon.llm import exact_dedup, line_dedup, sentencepiece_bpe, token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
TOKENIZER = Tokenizer.from_file(BYTES)
ODD = ["", " ", "   a  b ", "\n\nx\n", "▁▁a ▁", "日本語 中文", "😀é", "\x00", "<s></s><0x0A>", "a" * 200, " " * 70 + "x", "=-=" * 40]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def count(text):
    return len(TOKENIZER.encode(text, add_special_tokens=False).ids)


def test_encoding_is_the_librarys():
    model = sentencepiece_bpe.PieceBpe(MODEL)
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("ab ▁\n01=-eéħ日😀ing") for _ in range(rng.randint(1, 80))) for _ in range(1500)]
    assert model.encode_joined(texts) == [",".join(map(str, x)) for x in LIBRARY.encode(texts)]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_encoding_of_any_text(text):
    model, known = sentencepiece_bpe.load(MODEL)
    assert model.encode_joined([text], known)[0] == ",".join(map(str, LIBRARY.encode(text)))


def test_digests(edges, nothing, docs, texts):
    for found in sentencepiece_bpe.digests(docs, MODEL).collect():
        ids = LIBRARY.encode(texts[found.doc_id])
        assert (found.n_tokens, found.ids_sha256) == (len(ids), sha(",".join(map(str, ids))))
        assert found.decoded_sha256 == sha(LIBRARY.decode(ids))
    rows = sentencepiece_bpe.encode(edges, MODEL).collect()
    assert len(rows) == 12 and all(r.n_tokens == len(r.ids) for r in rows)
    assert [(r.ids, r.decoded) for r in rows if r.doc_id in (1, 2)] == [([], "")] * 2
    assert sentencepiece_bpe.digests(nothing, MODEL).count() == 0


def test_token_counts(edges, nothing, docs, texts):
    for found in token_counts.token_counts(docs, BYTES).collect():
        text = texts[found.doc_id]
        assert (found.n_tokens, found.n_bytes) == (count(text), len(text.encode()))
        assert found.over_limit == (found.n_tokens > 512)
    rows = {r.doc_id: r for r in token_counts.token_counts(edges, BYTES).collect()}
    assert (rows[1].n_tokens, rows[2].n_bytes, rows[10].over_limit) == (0, 0, True)
    assert token_counts.token_counts(nothing, BYTES).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([*"ab 's1\n\té日😀<|", "<|endoftext|>", "'ll", " "]), max_size=25).map("".join))
def test_counts_at_every_prefix(text):
    model, known = token_counts.load(BYTES)
    assert model.prefixes(text, known).tolist() == [count(text[:i]) for i in range(len(text) + 1)]


@pytest.mark.parametrize("text", ["a" * 3_000, "ab" * 900 + " x", "日本語" * 400, " " * 2_000 + "y", "qzjxkv" * 300])
def test_long_runs_without_a_break(text):
    assert token_counts.load(public_tokenizers.path("byte_bpe_50k.json"))[0].totals([text]) == [count(text)]


def test_longest_prefix_within_the_limit(spark):
    rng = random.Random(6)
    parts = ["the ", "  ", "hello", "\n\n", "'ll", "é", "日本", "<|endoftext|>", " of", "123", "x" * 700]
    rows = [(k, "".join(rng.choice(parts[: 8 + k % 4]) for _ in range(40))) for k in range(40)] + [(99, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = token_counts.token_counts(df, public_tokenizers.path("byte_bpe_50k.json"), limit=20).collect()
    for r, (_, text) in zip(sorted(found, key=lambda r: r.doc_id), rows, strict=True):
        if len(text or "") <= 200 or not r.over_limit:
            assert r.fit_chars == max(i for i in range(len(text or "") + 1) if count((text or "")[:i]) <= 20)
        else:
            assert count(text[: r.fit_chars]) <= 20 < count(text[: r.fit_chars + 1])


def test_budget_questions_from_stored_counts(spark):
    df = spark.createDataFrame([(1, "hello there, world"), (2, None)], "doc_id long, text string")
    stored = token_counts.prefix_counts(df, BYTES)
    found = {r[0]: (r[1], r[2]) for r in stored.select("doc_id", token_counts.cut_at(stored.counts, 3), token_counts.fits(stored.counts, 4)).collect()}
    assert found[2] == (0, True)
    text, most = "hello there, world", max(i for i in range(19) if count("hello there, world"[:i]) <= 3)
    assert found[1] == (most, count(text) <= 4)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300), st.integers(0, 300))
def test_fingerprints_compose(data, at):
    whole = exact_dedup.chunk_hashes(data)
    parts = exact_dedup.chunk_hashes(data[:at]) + exact_dedup.chunk_hashes(data[at:])
    assert exact_dedup.combine(whole) == exact_dedup.combine(parts)


def test_fingerprint_of_many_chunks():
    data = bytes(np.random.default_rng(1).integers(0, 256, 3 * exact_dedup.CHUNK + 17, dtype=np.uint8))
    value = 0
    for b in data:
        value = (value * exact_dedup.BASES[0] + b + 1) % exact_dedup.PRIME
    assert exact_dedup.fingerprint(data)[1] >> 31 == value


def brute_copies(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        text = text or ""
        groups[exact_dedup.normal(text)].append((-len(text), doc_id is None, doc_id))
    return {norm: (min(g)[2], len(g)) for norm, g in groups.items()}


@pytest.mark.parametrize("salt_rows", [1000, 2])
def test_exact_dedup(monkeypatch, edges, nothing, docs, texts, salt_rows):
    monkeypatch.setattr(exact_dedup, "SALT_ROWS", salt_rows)
    want = brute_copies(texts.items())
    for r in exact_dedup.exact_dedup(docs).collect():
        norm = exact_dedup.normal(texts[r.doc_id])
        assert (r.keep_id, r.group_size) == want[norm] and r.kept == (r.keep_id == r.doc_id)
        assert r.text_sha256 == hashlib.sha256(norm).hexdigest()
    rows = exact_dedup.exact_dedup(edges).collect()
    want = brute_copies([r[:2] for r in EDGES])
    assert len(rows) == 12
    assert {r.doc_id: (r.keep_id, r.group_size) for r in rows}[6] == want[b"OneTWOthreefourfivesixseveneight"]
    assert {(r.keep_id, r.group_size) for r in rows if r.doc_id in (1, 2, 3)} == {(3, 3)}
    assert sorted((r.keep_id, r.group_size) for r in rows if r.doc_id == 5) == [(4, 3), (4, 3)]
    assert exact_dedup.exact_dedup(nothing).count() == 0


def test_colliding_fingerprints_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "fingerprint", lambda data: (len(data), 7))
    rows = [exact_dedup.normal(t) for t in ("ab", "cd", "ab", "cd", "ef")]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays(
        [pa.array([7] * 5), pa.array([2] * 5), pa.array([0] * 5), pa.array(range(5)), pa.array([2] * 5), pa.array([1] * 5), pa.array(rows)],
        ["mark", "n_bytes", "salt", "doc_id", "n_chars", "salts", "norm"],
    )
    found = pa.Table.from_batches(exact_dedup._compare(iter([batch.slice(0, 2), batch.slice(2)])))
    assert found["number"].to_pylist() == [0, 1, 0, 1, 2]


def brute_lines(rows):
    """Removal by plain sets, on the same chunks."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        lines, kept = (text or "").split("\n"), []
        for begin, end, may in line_dedup.chunks(text or ""):
            part = "\n".join(lines[begin:end])
            if not (may and part in seen):
                kept += lines[begin:end]
            if may:
                seen.add(part)
        out[doc_id] = "\n".join(kept)
    return out


@pytest.mark.parametrize("settled", [16_000_000, 2_000])
def test_line_dedup(monkeypatch, docs, texts, settled):
    monkeypatch.setattr(line_dedup, "SETTLED", settled)
    want = brute_lines(texts.items())
    rows = line_dedup.line_dedup(docs).collect()
    assert {r.doc_id: r.text for r in rows} == want
    assert sum(r.n_removed > 0 for r in rows) > 0


def test_line_dedup_edges(edges, nothing):
    rows = line_dedup.line_dedup(edges).collect()
    assert len(rows) == 12
    by = {r.doc_id: r for r in rows}
    assert (by[1].text, by[1].n_lines, by[2].text) == (None, 0, "")
    assert line_dedup.line_dedup(nothing).count() == 0
    assert line_dedup.rewrite(edges).columns == edges.columns


def test_chunks_resist_shifts():
    lines = [f"line number {i} of the text" for i in range(60)]
    plain = {tuple(lines[a:b]) for a, b, _ in line_dedup.chunks("\n".join(lines))}
    moved = ["another line", "and one more", "third"] + lines
    shifted = {tuple(moved[a:b]) for a, b, _ in line_dedup.chunks("\n".join(moved))}
    assert len(plain & shifted) >= len(plain) - 3


def test_long_passages_go_wherever_they_stand(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"start {i}\nmore {i} here\n{passage}\nend {i}") for i in range(6)] + [(9, "clean one\nclean two\nclean three")]
    found = {r.doc_id: r.text for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert passage in found[0] and not any(passage in found[i] for i in range(1, 6))
    assert found[9] == rows[-1][1]


def brute_runs(rows):
    """What is left of the lines that are not blank: of each longest run of two lines or more, or of one
    line of LONG words, that came before, none."""
    first, out = {}, {}
    for doc_id, text in sorted(rows):
        lines = [x for x in (text or "").split("\n") if x.strip()]
        gone = set()
        for i, line in enumerate(lines):
            for size in (1, 2):
                run = tuple(lines[i : i + size])
                if len(run) < size or size == 1 and len(line.split()) < line_dedup.LONG:
                    continue
                at = first.setdefault(run, (doc_id, i))
                if at[0] != doc_id or i >= at[1] + size:
                    gone |= set(range(i, i + size))
        out[doc_id] = [x for i, x in enumerate(lines) if i not in gone]
    return out


def left_of(df, **how):
    rows = line_dedup.line_dedup(df, **how).collect()
    return {r.doc_id: [x for x in (r.text or "").split("\n") if x.strip()] for r in rows}


@pytest.mark.parametrize("settled", [16_000_000, 2_000])
def test_repeated_runs_of_lines_go_whole(spark, monkeypatch, docs, texts, settled):
    monkeypatch.setattr(line_dedup, "SETTLED", settled)
    assert left_of(docs, runs=True) == brute_runs(texts.items())
    rng = np.random.default_rng(3)

    def line(words):
        return " ".join(f"v{x}" for x in rng.integers(0, 5000, words))

    passages = [[line(25) for _ in range(size)] for size in (2, 3, 5, 8) for _ in range(10)]
    rows = []
    for passage in passages:  # a passage in two texts, with other lines around it
        for _ in range(2):
            around = [line(25) for _ in range(6)]
            rows.append((len(rows), "\n".join(around[:3] + passage + around[3:])))
    rows += [(1000, "same\n" * 7), (1001, "own\nsame\n \nsame\nsame\nother"), (1002, rows[0][1] + "\nlast of a copy")]
    found = left_of(spark.createDataFrame(rows, "doc_id long, text string"), runs=True)
    assert found == brute_runs(rows)
    assert all(not set(p) & set(found[2 * k + 1]) and set(p) <= set(found[2 * k]) for k, p in enumerate(passages))
