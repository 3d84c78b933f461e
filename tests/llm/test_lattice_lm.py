import math
import re
import zlib

import public_tokenizers
import pytest
import sentencepiece

from nearpath.llm import lattice_lm as lm

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = open(PATH, "rb").read()


def words(text):
    """Lower-cased words, and None for the end."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + [None]


def plain(rows):
    """held_out, n_tokens, n_known, N, base score, by counting in one place."""
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, _ in rows]
    counts = {}
    for (_, text), out in zip(rows, held):
        for word in [] if out else words(text):
            counts[word] = counts.get(word, 0) + 1
    n, v = sum(counts.values()), len(counts)
    return [
        (i, out, len(words(t)), sum(counts.get(w, 0) > 0 for w in words(t)), n,
         sum(math.log10((counts.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in words(t)))
        for (i, t), out in zip(rows, held)], counts


def plain_lattice(counts):
    """Log10 probability of a word and of an end, over all cuttings, without logs."""
    vocabulary = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    used = {}
    for word, n in counts.items():
        for piece in vocabulary.encode(word) if word is not None else []:
            used[piece] = used.get(piece, 0) + n
    usable = [i for i in range(vocabulary.get_piece_size()) if lm.usable(vocabulary, i)]
    total = sum(used.get(i, 0) + 0.1 for i in usable) + counts.get(None, 0) + 0.1
    weight = {vocabulary.id_to_piece(i): (used.get(i, 0) + 0.1) / total for i in usable}
    spelt = {p: w for p, w in weight.items() if re.fullmatch(r"<0x[0-9A-F]{2}>", p)}
    pieces = {p: w for p, w in weight.items() if p not in spelt}

    def word(text):
        text = lm.MARK + text
        ways = [1.0] + [0.0] * len(text)
        for end in range(1, len(text) + 1):
            for start in range(max(0, end - 20), end):
                ways[end] += ways[start] * pieces.get(text[start:end], 0)
            if text[end - 1] not in pieces:
                ways[end] += ways[end - 1] * math.prod(
                    spelt[f"<0x{b:02X}>"] for b in text[end - 1].encode())
        return math.log10(ways[-1])

    return word, math.log10((counts.get(None, 0) + 0.1) / total)


def test_scores(make_docs, odd_rows):
    rows = [r for r in odd_rows if r[1] is None or "x" * 100 not in r[1]]
    rows += [(100 + i, f"The cat{i % 7} sat on the mat {i}") for i in range(60)]
    wanted, counts = plain(rows)
    word, end = plain_lattice(counts)
    got = lm.lattice_scores(make_docs(rows, extra="held_out score block"), PATH).collect()
    assert len(got) == len(rows)
    key = lambda r: repr(r[:5])
    got = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"],
                   r["base_score"], r["score"]) for r in got), key=key)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(t)
    for mine, right in zip(got, sorted(wanted, key=key)):
        assert mine[:5] == right[:5]
        assert mine[5] == pytest.approx(right[5], rel=1e-9)
    for doc_id, *_, score in got:
        sums = [sum(map(word, words(t)[:-1])) + end for t in texts[doc_id]]
        assert any(score == pytest.approx(s, rel=1e-9) for s in sums)


def test_long_words_do_not_underflow():
    probabilities, _ = lm.piece_probabilities(MODEL, {}, 0)
    lattice = lm.Lattice(MODEL, probabilities)
    one, many = lattice.log_probability("x" * 50), lattice.log_probability("x" * 5000)
    assert -math.inf < many < one * 50


def test_learns(spark, sf_dir):
    """Held-out texts are likelier under what was learned than under a flat model."""
    from nearpath.llm.queries import op6_lattice_lm

    rows = [r for r in op6_lattice_lm(spark, sf_dir).collect() if r["held_out"]]
    flat = lm.Lattice(MODEL, lm.piece_probabilities(MODEL, {}, 0)[0])
    texts = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    learned = sum(r["score"] for r in rows)
    plain_flat = sum(
        sum(flat.log_probability(w.decode()) for w in lm.words(texts[r["doc_id"]])) / lm.LOG10 for r in rows)
    assert learned > plain_flat * 0.8


def test_whole_table(spark, sf_dir):
    from nearpath.llm.queries import op6_lattice_lm

    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in op6_lattice_lm(spark, sf_dir).collect()}
    for doc_id, held, n, known, total, base in plain(rows)[0]:
        r = got[doc_id]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)


def test_no_training_rows(make_docs):
    held = next(i for i in range(1000) if lm.is_held_out(i))
    row = lm.lattice_scores(make_docs([(held, "some words")]), PATH).first()
    assert (row["n_known"], row["train_tokens"]) == (0, 0)
    assert row["base_score"] == pytest.approx(3 * math.log10(0.1 / 0.1))
    assert row["score"] < 0


def test_empty_table(make_docs):
    assert lm.lattice_scores(make_docs([]), PATH).count() == 0
