"""Language identification by Bayesian fusion of evidence.

Four independent kinds of evidence add up as logarithms for each language:

- the text: a naive Bayes model of hashed byte trigrams, fitted on all rows that
  declare a language, whatever their number; the tasks count, and only the
  counts of ``LANGUAGES_AT_ONCE`` languages reach the driver and the tasks at a
  time (texts are read once more for each further part of the languages),
- the language its mark-up declares,
- the suffix of its address,
- a prior of its host, smoothed towards its domain's, which is smoothed towards
  that of the whole table.

The last three are learned from all rows by grouped sums of the text's
posterior; a row's own share is left out of its host's and domain's sums.
Missing evidence says nothing. After one pass over the texts only narrow rows
are shuffled, and sums are formed before they meet, so a host with a third of
all rows is one row a task; joins leave skewed keys to adaptive splitting.

A row is rejected (``kept`` false) when its text has no letters, when its
trigrams are closer to noise than to any language, or when its language is not
among the wanted ones. Null and empty texts are rejected and get their language
from the other evidence. Equal rows get equal results.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearpath.sources.workdir import discard, settle, settle_in

#: Languages whose counts a task holds before it hands them on, and how many
#: probabilities are gathered at once.
LABELS_AT_ONCE = 64
#: Languages of one part of the text model: 128 KB each in every Python worker.
LANGUAGES_AT_ONCE = 256
GATHERED = 1 << 22
BUCKETS = 1 << 15
#: Overlapping trigrams repeat each other; a text counts as this share of them.
INDEPENDENT = 1 / 3
HOST_WEIGHT, DOMAIN_WEIGHT = 5.0, 20.0
SMOOTHING = 1.0
#: Where between noise (0) and the language's own documents (1) a text is rejected.
NOISE_SHARE = 0.35

#: Bytes to lower case; those that cannot be in a letter to a blank.
LETTERS = bytes(
    c + 32 if ord("A") <= c <= ord("Z") else c if ord("a") <= c <= ord("z") or c >= 0x80 else 0x20
    for c in range(0x100)
)
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)|<[^>]*>", re.S | re.I)


def trigrams(text: str) -> np.ndarray:
    """Bucket numbers of the trigrams of the letters; runs of others are one blank."""
    letters = b" ".join(text.lower().encode().translate(LETTERS).split())
    b = np.frombuffer(letters, np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64)
    mixed = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(0x9E3779B1)
    return (mixed >> np.uint32(32 - 15)).astype(np.int64)


@dataclass
class TextModel:
    """``table[bucket, language]``: log probability; ``usual``: mean log
    probability of a language's trigrams in its own documents."""

    languages: list[str]
    table: np.ndarray
    usual: np.ndarray

    def score(self, text: str) -> tuple[np.ndarray, int]:
        found = trigrams(text)
        total = np.zeros(len(self.languages))
        step = max(1, GATHERED // max(1, len(self.languages)))
        for start in range(0, len(found), step):
            total += self.table[found[start:start + step]].sum(axis=0, dtype=np.float64)
        return total, len(found)


COUNTED = pa.schema([("label", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])


def counted(rows: DataFrame, markup: bool = False) -> DataFrame:
    """Trigrams of the rows by declared language: ``label, bucket, n``, several
    rows of a bucket. A language without any trigram has a row of 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def handed_on() -> Iterator[pa.RecordBatch]:
            for label, counts in held.items():
                places = np.flatnonzero(counts)
                places = places if len(places) else np.zeros(1, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([label] * len(places), pa.string()),
                     pa.array(places.astype(np.int32)), pa.array(counts[places])], schema=COUNTED)
            held.clear()

        for batch in batches:
            for label, text in zip(*(batch.column(k).to_pylist() for k in ("declared", "text"))):
                if label not in held:
                    if len(held) == LABELS_AT_ONCE:
                        yield from handed_on()
                    held[label] = np.zeros(BUCKETS, np.int64)
                text = text or ""
                places, n = np.unique(trigrams(MARKUP.sub(" ", text) if markup else text), return_counts=True)
                held[label][places] += n
        yield from handed_on()

    declared = rows.where(F.col("declared").isNotNull()).select("declared", "text")
    return declared.mapInArrow(run, "label string, bucket int, n long")


def fit_text_model(counts: DataFrame) -> TextModel:
    """From ``label, bucket, n``: every label is a language."""
    found = (
        counts.groupBy("label", "bucket").agg(F.sum("n").alias("n"))
        .groupBy("label").agg(F.collect_list(F.struct("bucket", "n")).alias("counts"))
        .orderBy("label").toArrow()
    )
    languages = found.column("label").to_pylist()
    table = np.zeros((BUCKETS, len(languages)), np.float32)
    usual = np.zeros(len(languages))
    for i in range(len(languages)):
        own = found.column("counts")[i].values
        dense = np.full(BUCKETS, 0.05)
        dense[own.field("bucket").to_numpy()] += own.field("n").to_numpy()
        logs = np.log(dense / dense.sum())
        table[:, i] = logs
        usual[i] = (np.exp(logs) * logs).sum()
    return TextModel(languages, table, usual)


class TextModels:
    """The text model in parts of ``LANGUAGES_AT_ONCE`` languages. The counts are a
    written table; the driver holds the names and the parts it is asked for."""

    def __init__(self, counts: DataFrame):
        self.counts = settle(
            counts.groupBy("label", "bucket").agg(F.sum("n").alias("n")), "language-counts")
        found = self.counts.select("label").distinct().orderBy("label")
        self.languages: list[str] = found.toArrow().column("label").to_pylist()
        self.held: TextModel | None = None

    def parts(self) -> Iterator[TextModel]:
        if len(self.languages) <= LANGUAGES_AT_ONCE:
            # one part serves documents and pages
            self.held = self.held or fit_text_model(self.counts)
            yield self.held
            return
        for start in range(0, len(self.languages), LANGUAGES_AT_ONCE):
            own = self.languages[start:start + LANGUAGES_AT_ONCE]
            yield fit_text_model(self.counts.where(F.col("label").between(own[0], own[-1])))


def score_part(
    rows: DataFrame, text_col: str, model: TextModel, markup: bool, usual: np.ndarray | None
) -> DataFrame:
    """One reading of the texts: ``text_logs`` grows by the sums of the model's
    languages. With ``usual``, that of all languages, it is the last reading."""
    before = "text_logs" in rows.columns
    others = [name for name in rows.columns if name not in (text_col, "n_trigrams", "text_logs")]
    carried = others if usual is not None else [*others, text_col]
    schema = rows.select(*carried).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        noise = -math.log(BUCKETS)
        for batch in batches:
            n_trigrams, logs, shares, like = [], [], [], []
            earlier = batch.column("text_logs") if before else None
            for i, text in enumerate(batch.column(text_col).to_pylist()):
                text = text or ""
                if markup:
                    text = MARKUP.sub(" ", text)
                total, n = model.score(text)
                if before:
                    total = np.concatenate([earlier[i].values.to_numpy(), total])
                n_trigrams.append(n)
                if usual is None:
                    logs.append(total)
                    continue
                weighted = total * INDEPENDENT
                share = np.exp(weighted - weighted.max())
                best = int(np.argmax(total))
                logs.append(weighted)
                shares.append(share / share.sum())
                known = usual[best] - noise  # 0 for a language without any trigram
                like.append((total[best] / n - noise) / known if n and known > 1e-9 else 0.0)
            columns = [batch.column(name) for name in carried] + [
                pa.array(n_trigrams, pa.int64()), pa.array(logs, pa.list_(pa.float64()))]
            if usual is not None:
                columns += [pa.array(shares, pa.list_(pa.float64())), pa.array(like, pa.float64())]
            yield pa.RecordBatch.from_arrays(
                columns, names=[*carried, *SCORED.names[:len(columns) - len(carried)]])

    added = "n_trigrams long, text_logs array<double>"
    if usual is not None:
        added += ", share array<double>, like_text double"
    names = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in schema)
    read = [*others, text_col, *(["text_logs"] if before else [])]
    return rows.select(*read).mapInArrow(run, names + added)


SCORED = pa.schema([("n_trigrams", pa.int64()), ("text_logs", pa.list_(pa.float64())),
                    ("share", pa.list_(pa.float64())), ("like_text", pa.float64())])


def score_texts(
    rows: DataFrame, text_col: str, models: TextModels, markup: bool = False
) -> DataFrame:
    """``rows`` without their text, with its evidence by language: ``text_logs``,
    the posterior ``share`` under a flat prior, and ``like_text``, where its
    trigrams stand between noise (0) and the likeliest language (1)."""
    usual = np.zeros(0)
    folder = None
    for model in models.parts():
        usual = np.concatenate([usual, model.usual])
        last = len(usual) == len(models.languages)
        rows = score_part(rows, text_col, model, markup, usual if last else None)
        if not last:
            before = folder
            rows, folder = settle_in(rows, "part-evidence")
            if before:
                discard(rows.sparkSession, before)
    return rows


def sums(rows: DataFrame, key: str) -> DataFrame:
    """For each value of ``key`` the posterior shares of its rows, summed by language."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(
        summed("share").alias(f"{key}_sums"))


def summed(column: str) -> Column:
    return vector_to_array(Summarizer.sum(array_to_vector(column)))


def literal(values: list, kind: str) -> Column:
    """A constant array, however long, as one expression."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def once(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once a row, also where ``use`` has it
    inside a function of an array's elements."""
    return F.element_at(F.transform(F.array(value), use), 1)


def normalised(values: Column) -> Column:
    return once(values, lambda held: once(total(held), lambda whole: F.transform(
        held, lambda x: x / whole)))


def fuse(scored: DataFrame, languages: list[str], wanted: Sequence[str] | None = None) -> DataFrame:
    """Adds ``language``, ``posterior``, ``text_language`` and ``kept`` to rows of
    ``declared, suffix, host, domain`` (each may be null) and the text's evidence."""
    n = len(languages)
    # grouped, as an empty table has no sums
    whole = scored.groupBy(F.lit("all")).agg(summed("share").alias("sums")).first()
    counts = [float(x) for x in whole["sums"]] if whole else [0.0] * n
    everything = [(c + SMOOTHING) / (sum(counts) + SMOOTHING * n) for c in counts]
    prior = literal(everything, "double")
    names = literal(languages, "string")
    rows = scored
    for key in ("declared", "suffix", "domain", "host"):
        rows = rows.join(sums(scored, key), key, "left")
    # values of a kind of evidence: one more stands for those never seen
    kinds = scored.agg(F.count_distinct("declared"), F.count_distinct("suffix")).first()

    def evidence(key: str, n_values: int) -> Column:
        """log P(value | language), smoothed over the values; 0 if missing."""
        found = F.zip_with(f"{key}_sums", literal(counts, "double"), lambda a, b: F.log(
            (a + SMOOTHING) / (b + SMOOTHING * (n_values + 1))))
        return F.coalesce(found, F.array_repeat(F.lit(0.0), n))

    def smoothed(key: str, towards: Column, weight: float) -> Column:
        """The key's other rows, with ``weight`` rows of the wider prior."""
        others = F.zip_with(f"{key}_sums", "share", lambda a, b: F.greatest(a - b, F.lit(0.0)))
        mixed = F.zip_with(others, towards, lambda a, b: a + weight * b)
        return F.coalesce(normalised(mixed), towards)

    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    host_prior = once(
        once(prior, lambda p: smoothed("domain", p, DOMAIN_WEIGHT)),
        lambda p: smoothed("host", p, HOST_WEIGHT))
    logs = add(
        add(F.col("text_logs"), F.transform(host_prior, lambda x: F.log(x))),
        add(evidence("declared", kinds[0]), evidence("suffix", kinds[1])))
    verdict = once(logs, lambda held: once(F.array_max(held), lambda best: F.struct(
        F.array_position(held, best).cast("int").alias("place"),
        (1 / total(F.transform(held, lambda x: F.exp(x - best)))).alias("posterior"))))
    rows = (
        rows.withColumn("verdict", verdict)
        .withColumn("language", F.element_at(names, F.col("verdict.place")))
        .withColumn("posterior", F.col("verdict.posterior"))
        .withColumn("text_language", F.when(F.col("n_trigrams") > 0, F.element_at(
            names, F.array_position("share", F.array_max("share")).cast("int"))))
        .withColumn("kept", (F.col("n_trigrams") > 0) & (F.col("like_text") >= NOISE_SHARE)
                    & (F.lit(True) if wanted is None else F.col("language").isin(*wanted)))
    )
    return rows.drop("verdict", "share", "text_logs",
                     *(f"{k}_sums" for k in ("declared", "suffix", "domain", "host")))


def missing() -> Column:
    return F.lit(None).cast("string")


def document_rows(docs: DataFrame, *keep: str) -> DataFrame:
    """Documents as evidence: ``lang`` is declared, the source is the host."""
    return docs.select(
        *keep, F.col("lang").alias("declared"), missing().alias("suffix"),
        F.col("source").alias("host"), missing().alias("domain"), F.col("text").alias("text"))


def page_rows(pages: DataFrame, *keep: str) -> DataFrame:
    """Web pages as evidence: the ``lang`` of their mark-up, suffix, host and domain
    of their address."""
    def found(pattern: str, column: str) -> Column:
        return F.nullif(F.lower(F.regexp_extract(column, pattern, 1)), F.lit(""))

    host = found(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", "url")
    return pages.select(
        *keep, found(r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z]+)", "html").alias("declared"),
        F.nullif(F.regexp_extract(host, r"\.([^.]+)$", 1), F.lit("")).alias("suffix"),
        host.alias("host"),
        F.nullif(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), F.lit("")).alias("domain"),
        F.col("html").alias("text"))


def unlabelled(rows: DataFrame) -> DataFrame:
    """The result where no row declares a language: nothing to learn from."""
    return rows.drop("text").select(
        "*", F.lit(0).cast("long").alias("n_trigrams"), F.lit(0.0).alias("like_text"),
        missing().alias("language"), F.lit(0.0).alias("posterior"),
        missing().alias("text_language"), F.lit(True).alias("kept"))


def identify_documents(
    docs: DataFrame, *keep: str, wanted: Sequence[str] | None = None
) -> DataFrame:
    """Language and verdict of each document, with the columns named in ``keep``."""
    rows = document_rows(docs, *keep)
    models = TextModels(counted(document_rows(docs)))
    if not models.languages:
        return unlabelled(rows)
    scored = settle(score_texts(rows, "text", models), "text-evidence")
    return fuse(scored, models.languages, wanted)


def identify(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """Documents and web pages together: ``doc_id`` or ``page_id`` says which."""
    of_docs, of_pages = document_rows(docs, "doc_id"), page_rows(pages, "page_id")
    models = TextModels(counted(of_docs).unionByName(counted(of_pages, markup=True)))
    if not models.languages:
        return unlabelled(of_docs.unionByName(of_pages, allowMissingColumns=True))
    scored = settle(
        score_texts(of_docs, "text", models).unionByName(
            score_texts(of_pages, "text", models, markup=True), allowMissingColumns=True),
        "text-evidence")
    return fuse(scored, models.languages)
