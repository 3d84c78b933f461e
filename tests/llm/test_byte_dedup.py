import hashlib
import random

import numpy as np
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest

from nearpath.llm import byte_dedup
from nearpath.llm.byte_dedup import LENGTH, without_repeats


def plain(rows):
    """(doc_id, n_bytes, removed spans, kept) from a table of all windows."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    count = {}
    for _, text in texts:
        for a in range(len(text) - LENGTH + 1):
            window = text[a:a + LENGTH]
            count[window] = count.get(window, 0) + 1
    out = []
    for doc_id, text in texts:
        gone = np.zeros(len(text) + 1, int)
        for a in range(len(text) - LENGTH + 1):
            if count[text[a:a + LENGTH]] > 1:
                gone[a] += 1
                gone[a + LENGTH] -= 1
        gone = np.cumsum(gone)[: len(text)] > 0
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        kept = bytes(np.frombuffer(text, np.uint8)[~gone])
        out.append((doc_id, len(text), int(gone.sum()), edge[::2].tolist(), edge[1::2].tolist(), kept))
    return out


def result(frame):
    return sorted(repr((r["doc_id"], r["n_bytes"], r["n_removed"], r["starts"], r["ends"],
                        bytes(r["kept"]))) for r in frame.collect())


def expected(rows):
    return sorted(map(repr, plain(rows)))


def letters(rng, n, alphabet="abcdefghij é中"):
    return "".join(rng.choice(alphabet) for _ in range(n))


@pytest.mark.parametrize("seed", range(3))
def test_random_documents(make_docs, seed):
    rng = random.Random(seed)
    pool = [letters(rng, rng.randint(150, 900)) for _ in range(6)]
    rows = []
    for doc_id in rng.sample(range(1000), 50):
        parts = []
        for _ in range(rng.randint(0, 5)):
            source = rng.choice(pool)
            a = rng.randint(0, 60)
            parts.append(source[a:a + rng.randint(100, 600)] if rng.random() < 0.6
                         else letters(rng, rng.randint(1, 300)))
        rows.append((doc_id, "".join(parts)))
    rows += [rows[3], rows[4], (None, rows[5][1])]
    assert result(without_repeats(make_docs(rows))) == expected(rows)


def test_few_letters_and_repeats_that_overlap(make_docs):
    rng = random.Random(4)
    rows = [(0, "a" * 700), (1, "ab" * 300), (2, "x" * 199), (3, "x" * 200), (4, "y" * 201),
            (5, "abc" * 40 + "z" + "abc" * 80), (6, "\0" * 250 + "\0\1" * 200)]
    rows += [(10 + i, letters(rng, 400, "ab") * 2) for i in range(5)]
    assert result(without_repeats(make_docs(rows))) == expected(rows)


def test_windows_of_199_and_200_bytes(make_docs):
    rng = random.Random(6)
    line = letters(rng, 200, "abcdefghij")
    rows = [(1, "p" + line + "q"), (2, "r" + line + "s"), (3, "t" + line[:199] + "@"),
            (4, "u" + line[1:] + "v")]
    out = {r["doc_id"]: r["n_removed"] for r in without_repeats(make_docs(rows)).collect()}
    assert out == {1: 200, 2: 200, 3: 0, 4: 0}


def test_a_hot_run_amid_different_texts(make_docs, monkeypatch):
    """A key of many places is dealt by what stands round it; nothing is lost."""
    monkeypatch.setattr(byte_dedup, "HOT", 8)
    rng = random.Random(7)
    hot = letters(rng, 150, "abcdefghij")
    rows = [(i, letters(rng, 170) + hot + letters(rng, 170)) for i in range(40)]
    rows += [(100 + i, rows[i][1][:300 + 10 * i]) for i in range(8)]
    rows += [(200 + i, letters(rng, 90) + rows[0][1][60 + i:] + letters(rng, 50)) for i in range(9)]
    assert result(without_repeats(make_docs(rows))) == expected(rows)


def test_long_text_over_chunks(make_docs, monkeypatch):
    monkeypatch.setattr(byte_dedup, "CHUNK", 512)
    rng = random.Random(8)
    part = letters(rng, 3000)
    rows = [(1, letters(rng, 2000) + part + letters(rng, 500)), (2, part[100:] * 2),
            (3, "z" * 3000), (4, letters(rng, 9000))]
    assert result(without_repeats(make_docs(rows))) == expected(rows)


def test_odd_rows_and_other_columns(make_docs, odd_rows):
    rows = [(i, t if t is None or len(t) < 9000 else t[:9000]) for i, t in odd_rows]
    docs = make_docs(rows, extra="kept starts block kind")
    assert result(without_repeats(docs)) == expected(rows)


def test_whole_table(spark, sf_dir):
    from nearpath.llm.queries import op13_byte_dedup

    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    wanted = [(i, n, gone, len(starts), hashlib.sha256(kept).hexdigest())
              for i, n, gone, starts, _, kept in plain(rows)]
    got = op13_byte_dedup(spark, sf_dir).collect()
    assert sorted(map(tuple, got)) == sorted(wanted)
    assert sum(r["n_removed"] for r in got) > 0


def test_empty_table(make_docs):
    assert without_repeats(make_docs([])).count() == 0


def test_a_shard_is_sorted_in_portions(monkeypatch):
    """A few keys at a time give what all passages together give."""
    rng = random.Random(9)
    pool = [letters(rng, 700, "abcdefghij") for _ in range(20)]
    texts = ["".join(rng.choice(pool)[rng.randint(0, 90):] + letters(rng, 40) for _ in range(4)).encode()
             for _ in range(60)]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"".join(texts), np.uint8)
    windows = byte_dedup.Windows(data, np.cumsum(sizes), sizes)
    parts, counts = {}, {}
    for _, first, last, deal in windows.stretches(data, np.full(len(windows.keys), byte_dedup.SHARED)):
        passage = data[first:last + LENGTH].tobytes()
        assert parts.setdefault(passage, deal % byte_dedup.PARTS) == deal % byte_dedup.PARTS
        counts[passage] = counts.get(passage, 0) + 1
    passages, counts = list(parts), np.array(list(counts.values()))
    parts, sizes = np.array(list(parts.values()), np.uint8), np.fromiter(map(len, passages), np.int64)
    wanted = byte_dedup.chosen_spans(
        *byte_dedup.repeated_spans(passages, counts), np.arange(len(passages)))
    assert (counts == 1).any() and (wanted[0][counts == 1] > 0).any()
    monkeypatch.setattr(byte_dedup, "SORT_BYTES", 20_000)
    got = {}
    portions = list(byte_dedup.portions(sizes, parts))
    for portion in portions:
        assert sizes[portion].sum() <= 20_000 or len(set(parts[portion])) == 1
        own = byte_dedup.unpack_spans(byte_dedup.pack_spans(
            *byte_dedup.repeated_spans([passages[i] for i in portion], counts[portion])))
        for k, i in enumerate(portion.tolist()):
            got[i] = byte_dedup.chosen_spans(*own, np.array([k]))[1].tolist()
    ends = np.cumsum(wanted[0])[:-1]
    assert [got[i] for i in range(len(passages))] == [x.tolist() for x in np.split(wanted[1], ends)]
    assert len(portions) > 5


def test_texts_between_the_steps_lie_in_small_rows(make_docs, monkeypatch, tmp_path):
    """A row or a column chunk as large as a block stays in memory, a thread."""
    monkeypatch.setattr(byte_dedup, "work_dir", lambda spark, label: str(tmp_path / label))
    rng = np.random.default_rng(10)
    texts = ["".join(map(chr, rng.integers(40, 120, 50_000))) for _ in range(120)]
    rows = [(i, text) for i, text in enumerate(texts)] + [(200 + i, text) for i, text in enumerate(texts)]
    got = without_repeats(make_docs(rows).coalesce(1))
    assert {(r["n_bytes"], r["n_removed"]) for r in got.select("n_bytes", "n_removed").collect()} == {
        (50_000, 50_000)}
    files = [pq.ParquetFile(f) for f in (tmp_path / "byte-passages/kind=2").glob("*.parquet")]
    for file in files:
        for group in range(file.num_row_groups):
            sizes = pc.binary_length(file.read_row_group(group, ["payload"])["payload"]).to_pylist()
            assert max(sizes) < 2 << 20 and sum(sizes) < 2 * byte_dedup.ROW_GROUP
