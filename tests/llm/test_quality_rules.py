import random
import re

import pytest

from nearpath.llm.quality_rules import QualityRules, judge, keep_good, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text, min_repeat=5):
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    windows = {}
    for k in range(n - 4):
        windows.setdefault(tuple(words[k:k + 5]), []).append(k)
    repeated = {k + j for at in windows.values() if len(at) > 1 for k in at for j in range(5)}
    longest, covered = 0, set()
    for a in range(n if n < 400 else 0):
        for b in range(a + 1, n):
            k = 0
            while b + k < n and words[a + k] == words[b + k]:
                k += 1
            longest = max(longest, k)
            if k >= min_repeat:
                covered.update(range(a, a + k), range(b, b + k))
    chars = sum(map(len, words))
    return {
        "n_words": n, "word_chars": chars,
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(repeated),
        "base_failed": n < 10 or 100 * len(repeated) > 20 * n,
    }, longest, sum(len(words[i]) for i in covered) / max(chars, 1)


@pytest.mark.parametrize("seed", range(4))
def test_measures(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(40):
        few = [f"w{i}" for i in range(rng.choice([1, 2, 5, 60]))]
        texts.append(rng.choice(["\n", " ", " | "]).join(
            " ".join(rng.choice(few) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 14))))
    rows = judge(list(range(40)), texts, QualityRules()).to_pylist()
    for text, row in zip(texts, rows):
        base, longest, fraction = plain(text)
        assert {k: row[k] for k in base} == base
        assert row["longest_repeat"] == longest
        assert row["repeat_fraction"] == pytest.approx(fraction)


def test_limits():
    rules = QualityRules()
    passage = " ".join(f"p{i}" for i in range(300))
    filler = [" ".join(f"{c}{i}" for i in range(2000)) for c in "abc"]
    long_repeat = f"{filler[0]} {passage} {filler[1]} {passage} {filler[2]}"
    rows = judge([0, 1, 2], [filler[0], long_repeat, "## " * 3 + "word ## && " * 40], rules).to_pylist()
    assert [r["kept"] for r in rows] == [True, False, False]
    assert not rows[1]["base_failed"] and rows[1]["longest_repeat"] == 300


def test_odd_rows(make_docs, odd_rows):
    got = quality_rules(make_docs(odd_rows, extra="kept n_words")).collect()
    wanted = [(i, *plain(t)[0].values()) for i, t in odd_rows]
    assert sorted(repr((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"],
                        r["n_repeat_words"], r["base_failed"])) for r in got) == sorted(map(repr, wanted))


def test_whole_table_and_stage(spark, sf_dir):
    from nearpath.llm.queries import op4_quality_rules

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = dict(docs.select("doc_id", "text").collect())
    got = op4_quality_rules(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for row in got:
        base = plain(texts[row["doc_id"]])[0] if len(texts[row["doc_id"]]) < 3000 else {}
        assert {k: row[k] for k in base} == base
    kept = keep_good(docs)
    assert kept.dtypes == docs.dtypes
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got if r["kept"]}


def test_clean_documents_stay(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = quality_rules(docs).join(labels, "doc_id").where("NOT base_failed").collect()
    clean = [r["kept"] for r in rows if r["quality"] == 1]
    junk = [r["kept"] for r in rows if r["quality"] == 0]
    assert all(clean) and sum(junk) < 0.2 * len(junk)


def test_empty_table(make_docs):
    assert quality_rules(make_docs([])).count() == 0
    assert keep_good(make_docs([])).count() == 0


def test_the_suffix_array_decides():
    """Repeats reject documents that the base rule keeps: by their characters, and
    by one long passage in a short text."""
    rng = random.Random(12)
    words = lambda n, size=4: " ".join(
        "".join(rng.choice("abcdefghijklmnop") for _ in range(size)) for _ in range(n))
    wide = words(8, 20)
    passage = words(11)
    texts = [f"{words(60)} {wide} {words(60)} {wide}", f"{words(60)} {passage} {words(40)} {passage}",
             words(150)]
    rows = judge(list(range(3)), texts, QualityRules()).to_pylist()
    assert [r["base_failed"] for r in rows] == [False] * 3
    assert [r["kept"] for r in rows] == [False, False, True]


def test_limits_bind_and_clean_documents_stay(spark, sf_dir):
    from nearpath.llm.queries import op4_quality_rules

    rows = op4_quality_rules(spark, sf_dir).collect()
    by_repeats = [r for r in rows if not r["base_failed"] and (
        r["repeat_fraction"] > 0.18 or r["longest_repeat"] > 0.1 * r["n_words"])]
    assert by_repeats and not any(r["kept"] for r in by_repeats)
    clean = {r["doc_id"] for r in
             spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").collect()}
    lost = [r for r in rows if r["doc_id"] in clean and not r["base_failed"] and not r["kept"]]
    assert len(lost) <= 0.002 * len(clean)
