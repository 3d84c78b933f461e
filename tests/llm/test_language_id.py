import math

import numpy as np
import pytest

from nearpath.llm import language_id as li


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    return (spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/pages.parquet"))


def test_accuracy(spark, tables):
    docs, pages = tables
    rows = li.identify(docs, pages).collect()
    assert len(rows) == docs.count() + pages.count()
    assert len({r["doc_id"] for r in rows if r["doc_id"] is not None}) == docs.count()
    right = [r["language"] == r["declared"] for r in rows]
    assert np.mean(right) > 0.99
    text_only = [r["text_language"] == r["declared"] for r in rows if r["n_trigrams"] > 60]
    assert np.mean(text_only) > 0.98


def test_clean_documents_stay(spark, tables, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    rows = li.identify_documents(tables[0], "doc_id").join(labels, "doc_id").collect()
    assert rows and all(r["kept"] for r in rows)


def test_noise_is_rejected(spark, tables):
    docs = tables[0]
    noise = spark.createDataFrame(
        [(10**6, "0123 4567 !!!! 89"), (10**6 + 1, "qzxj wvkq xjzq kqxw zzqj vwxk " * 5),
         (10**6 + 2, None), (10**6 + 3, "日本語のテキスト " * 20)], "doc_id long, text string")
    both = docs.select("doc_id", "text", "lang", "source").unionByName(noise, allowMissingColumns=True)
    got = {r["doc_id"]: r["kept"] for r in li.identify_documents(both, "doc_id").collect()}
    assert [got[10**6 + i] for i in range(4)] == [False] * 4
    only = li.identify_documents(both, "doc_id", wanted=["fr"]).where("kept")
    assert {r["language"] for r in only.collect()} == {"fr"}


def plain_fuse(rows, n):
    """The formulas, one row at a time."""
    whole = np.sum([r["share"] for r in rows], axis=0)
    prior = (whole + li.SMOOTHING) / (whole.sum() + li.SMOOTHING * n)
    def sums(key):
        out = {}
        for r in rows:
            if r[key] is not None:
                out[r[key]] = out.get(r[key], 0) + np.array(r["share"])
        return out
    tables = {k: sums(k) for k in ("declared", "suffix", "domain", "host")}
    out = []
    for r in rows:
        def smoothed(key, towards, weight):
            if r[key] is None:
                return towards
            mixed = np.maximum(tables[key][r[key]] - r["share"], 0) + weight * towards
            return mixed / mixed.sum()
        logs = np.array(r["text_logs"]) + np.log(smoothed(
            "host", smoothed("domain", prior, li.DOMAIN_WEIGHT), li.HOST_WEIGHT))
        for key in ("declared", "suffix"):
            if r[key] is not None:
                logs = logs + np.log((tables[key][r[key]] + li.SMOOTHING) / (
                    whole + li.SMOOTHING * (len(tables[key]) + 1)))
        out.append((r["id"], int(np.argmax(logs)), 1 / np.exp(logs - logs.max()).sum()))
    return out


def test_fusion_formula(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(80):
        logs = rng.normal(0, 1.5, 3)
        rows.append({
            "id": i, "declared": rng.choice(["a", "b", None]), "suffix": rng.choice(["de", "com", None]),
            "domain": rng.choice(["x.de", "y.com", None]), "host": f"h{rng.integers(4)}",
            "n_trigrams": 9, "like_text": 1.0, "text_logs": logs.tolist(),
            "share": (np.exp(logs) / np.exp(logs).sum()).tolist()})
    scored = spark.createDataFrame(rows, "id long, declared string, suffix string, domain string, host string, "
                                   "n_trigrams long, like_text double, text_logs array<double>, share array<double>")
    got = {r["id"]: r for r in li.fuse(scored, ["a", "b", "c"]).collect()}
    for i, best, posterior in plain_fuse(rows, 3):
        assert got[i]["language"] == "abc"[best]
        assert got[i]["posterior"] == pytest.approx(posterior)


def test_page_evidence(spark):
    pages = spark.createDataFrame([
        (1, "https://user@News.Example.DE:80/a?b", '<html class=x lang="de-AT"><p>x'),
        (2, None, None), (3, "not a url", "<HTML LANG=fr>"), (4, "http://localhost/x", "<html>")],
        "page_id long, url string, html string")
    got = {r["page_id"]: (r["declared"], r["suffix"], r["host"], r["domain"])
           for r in li.page_rows(pages, "page_id").collect()}
    assert got[1] == ("de", "de", "news.example.de", "example.de")
    assert got[2] == (None, None, None, None)
    assert got[3] == ("fr", None, None, None)
    assert got[4] == (None, None, "localhost", None)


def test_odd_rows(spark, make_docs, odd_rows):
    docs = make_docs(odd_rows, extra="share logs kept language")
    got = li.identify_documents(docs, "doc_id").collect()
    assert len(got) == len(odd_rows)
    assert not any(r["kept"] for r in got if r["n_trigrams"] == 0)


def test_every_declared_language_is_fitted(spark):
    """Seventy languages in documents, and one that only pages declare."""
    def text(i):
        return f"{chr(97 + i % 26)}{chr(97 + i // 26)}q " * 40

    docs = spark.createDataFrame(
        [(i, text(i), f"l{i:02}", "s") for i in range(70)], "doc_id long, text string, lang string, source string")
    pages = spark.createDataFrame(
        [(i, None, f'<html lang="{lang}"><p>' + "wxyz vwxy " * 40) for i, lang in enumerate(["zz", "zz", ""])],
        "page_id long, url string, html string")
    got = li.identify(docs, pages).collect()
    assert len(got) == 73
    assert all(r["language"] == r["declared"] for r in got if r["doc_id"] is not None)
    assert {r["language"] for r in got if r["page_id"] is not None} == {"zz"}


def test_no_language_declared(spark):
    docs = spark.createDataFrame([(1, "some words", None, "s")], "doc_id long, text string, lang string, source string")
    pages = spark.createDataFrame([(2, None, "<html><p>more words")], "page_id long, url string, html string")
    got = li.identify(docs, pages).collect()
    assert sorted((r["doc_id"] or 0, r["page_id"] or 0, r["language"], r["kept"]) for r in got) == [
        (0, 2, None, True), (1, 0, None, True)]


def plain_model(texts):
    """From (text, declared) to the languages' log probabilities and usual values."""
    counts = {}
    for text, label in texts:
        if label is not None:
            own = counts.setdefault(label, np.full(li.BUCKETS, 0.05))
            for i in li.trigrams(text or ""):
                own[i] += 1
    logs = {label: np.log(own / own.sum()) for label, own in sorted(counts.items())}
    return logs, {label: sum(math.exp(x) * x for x in own) for label, own in logs.items()}


@pytest.mark.parametrize("at_once", [256, 3])
def test_text_model_against_a_plain_one(spark, tables, monkeypatch, at_once):
    """Counts, sums, usual values and ``like_text``, in one part or in several."""
    monkeypatch.setattr(li, "LANGUAGES_AT_ONCE", at_once)
    docs = tables[0].where("doc_id < 400").select("doc_id", "text", "lang", "source")
    odd = spark.createDataFrame(
        [(900, "", "xx", "s"), (901, None, None, "s"), (902, "ab", "yy", "s")],
        "doc_id long, text string, lang string, source string")
    docs = docs.unionByName(odd)
    rows = docs.collect()
    logs, usual = plain_model([(r["text"], r["lang"]) for r in rows])
    models = li.TextModels(li.counted(li.document_rows(docs)))
    assert models.languages == list(logs)
    got = {r["doc_id"]: r for r in
           li.score_texts(li.document_rows(docs, "doc_id"), "text", models).collect()}
    noise = -math.log(li.BUCKETS)
    assert len(got) == len(rows)
    for r in rows:
        found = li.trigrams(r["text"] or "")
        total = [own[found].sum() for own in logs.values()]
        best = int(np.argmax(total))
        assert got[r["doc_id"]]["n_trigrams"] == len(found)
        assert np.allclose(got[r["doc_id"]]["text_logs"], np.array(total) / 3, rtol=1e-4, atol=1e-3)
        known = list(usual.values())[best] - noise
        like = (total[best] / len(found) - noise) / known if len(found) and known > 1e-9 else 0
        assert got[r["doc_id"]]["like_text"] == pytest.approx(like, abs=1e-3)


def test_parts_of_the_languages_give_the_same(spark, tables, monkeypatch):
    docs = tables[0].where("doc_id < 300").select("doc_id", "text", "lang", "source")
    columns = ("doc_id", "language", "text_language", "kept")
    whole = li.identify_documents(docs, "doc_id").select(*columns).collect()
    monkeypatch.setattr(li, "LANGUAGES_AT_ONCE", 2)
    parts = li.identify_documents(docs, "doc_id").select(*columns).collect()
    assert sorted(whole) == sorted(parts) and len(whole) == docs.count()


def test_junk_languages_by_the_thousand(spark, monkeypatch):
    """One page each: the plan does not grow with the languages."""
    monkeypatch.setattr(li, "LANGUAGES_AT_ONCE", 500)
    pages = spark.createDataFrame(
        [(i, f"http://h{i % 9}.x{i % 40}/", f'<html lang="q{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}'
          f'{chr(97 + i // 676)}"><p>' + f"word{i} other{i} " * 9) for i in range(1200)],
        "page_id long, url string, html string")
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    got = li.identify(docs, pages).collect()
    assert len(got) == 1200 and len({r["declared"] for r in got}) == 1200


def test_empty_tables(spark, make_docs):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert li.identify_documents(make_docs([]), "doc_id").count() == 0
    assert li.identify(make_docs([(1, "the of and words here")]), pages).count() == 1
    assert math.isfinite(li.NOISE_SHARE)
