import hashlib
import random
import re

import pytest

from nearpath.llm import substring_dedup as dedup
from nearpath.llm.rows import unpack_rest
from nearpath.llm.substring_dedup import WINDOW, repeated_passages

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows):
    """(doc_id, n_words, n_removed, kept words) by looking at all windows."""
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for doc_id, own in words:
        for k in range(len(own) - WINDOW + 1):
            window = tuple(own[k:k + WINDOW])
            if doc_id is not None:
                first[window] = min(first.get(window, doc_id), doc_id)
    out = []
    for doc_id, own in words:
        gone = set()
        for k in range(len(own) - WINDOW + 1):
            if doc_id is not None and first[tuple(own[k:k + WINDOW])] < doc_id:
                gone.update(range(k, k + WINDOW))
        kept = " ".join(w for k, w in enumerate(own) if k not in gone)
        out.append((doc_id, len(own), len(gone), kept))
    return out


def result(frame):
    return sorted(
        repr((r["doc_id"], r["n_words"], r["n_removed"], " ".join(WORD.findall(r["kept_text"]))))
        for r in frame.collect())


@pytest.mark.parametrize("seed", range(3))
def test_random_documents(make_docs, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["é", "中"]
    pool = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(13, 40))) for _ in range(8)]
    rows = []
    for doc_id in rng.sample(range(1000), 60):
        parts = []
        for _ in range(rng.randint(0, 6)):
            source = rng.choice(pool).split()
            a = rng.randint(0, 6)
            parts.append(" ".join(source[a:a + rng.randint(5, 40)]) if rng.random() < 0.6 else
                         " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 30))))
        rows.append((doc_id, rng.choice([" ", "\n", "\t "]).join(parts)))
    rows += [rows[3], rows[4], (None, rows[5][1])]
    assert result(repeated_passages(make_docs(rows))) == sorted(map(repr, plain(rows)))


def test_one_run_in_all_documents_amid_different_words(make_docs, monkeypatch):
    """A hot key is dealt by whole windows; no shard gets the passages of all."""
    monkeypatch.setattr(dedup, "HOT", 10)
    rng = random.Random(11)
    words = lambda n: " ".join(f"v{rng.randint(0, 5000)}" for _ in range(n))
    hot = "these five words are everywhere"
    rows = [(i, f"{words(20)} {hot} {words(20)}") for i in range(300)]
    rows += [(1000 + i, rows[i][1][rows[i][1].index(hot) - 30:] + " " + words(3)) for i in range(20)]
    rows += [(2000 + i, rows[5][1]) for i in range(30)]
    assert result(repeated_passages(make_docs(rows))) == sorted(map(repr, plain(rows)))


def test_two_words_only(make_docs):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(60))) for i in range(12)]
    assert result(repeated_passages(make_docs(rows))) == sorted(map(repr, plain(rows)))


def test_word_hashes_are_those_of_the_words():
    text = ("the cat\n the\tthe x " * 400 + "é 中 cat").encode()
    hashes = dedup.word_hashes(text)
    words = text.split()
    assert len(hashes) == len(words)
    assert len(set(zip(words, hashes.tolist()))) == len(set(words)) == len(set(hashes.tolist()))
    whole = dedup.PIECE
    try:
        dedup.PIECE = 50
        assert dedup.word_hashes(text).tolist() == hashes.tolist()
    finally:
        dedup.PIECE = whole


def test_odd_rows_and_other_columns(make_docs, odd_rows):
    docs = make_docs(odd_rows, extra="kept_text rest block kind")
    out = repeated_passages(docs)
    assert result(out) == sorted(map(repr, plain(odd_rows)))
    back = unpack_rest(out.withColumnRenamed("kept_text", "text"), docs)
    assert back.columns == docs.columns and back.dtypes == docs.dtypes
    assert back.where("source LIKE 'src%' AND kept_text = 'x' AND lang = 'en'").count() == len(odd_rows)


def test_other_columns_come_back_as_they_are(spark):
    """Timestamps to the microsecond, decimals, maps with any keys, structs, nulls."""
    text = " ".join(f"word{i}" for i in range(30))
    docs = spark.sql(f"""
        SELECT id AS doc_id, IF(id % 2 = 0, '{text}', concat(id, ' {text} ', id)) AS text,
          timestamp_micros(1700000000123456 + id) AS at, CAST(id / 7 AS DECIMAL(20, 9)) AS d,
          map(id, 'a', id + 1, NULL) AS m, named_struct('x', id, 'a b', NULL) AS `odd.name`,
          unhex('00ff') AS b, CAST(NULL AS STRING) AS _id, id AS _key
        FROM range(12)""")
    back = unpack_rest(repeated_passages(docs).withColumnRenamed("kept_text", "text"), docs)
    assert back.dtypes == docs.dtypes
    others = [f"`{c}`" for c in docs.columns if c != "text"]
    key = lambda f: sorted(map(repr, f.select(*others).collect()))
    assert key(back) == key(docs)
    assert back.where("text = ''").count() > 0


def test_whole_table(spark, sf_dir):
    from nearpath.llm.queries import op3_substring_dedup

    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    wanted = [(i, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, kept in plain(rows)]
    got = op3_substring_dedup(spark, sf_dir).collect()
    assert sorted(map(tuple, got)) == sorted(wanted)
    assert sum(r["n_removed"] for r in got) > 0


def test_empty_table(make_docs):
    assert repeated_passages(make_docs([])).count() == 0
