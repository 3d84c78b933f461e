import random
import time

import numpy as np
import pytest

from nearpath.llm import html_extract as he
from nearpath.llm.bilstm import BiLSTM, padded
from nearpath.llm.html_blocks import leaves, vectors
from nearpath.llm.html_layouts import Maker


@pytest.fixture(scope="module")
def words(spark, sf_dir):
    return he.sample_words(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@pytest.fixture(scope="module")
def model(words):
    return he.train(words)


def text_of(model, page):
    blocks = leaves(page)
    picks = he.label(model, [vectors(blocks, {})])[0]
    return " ".join(b.text for b, yes in zip(blocks, picks) if yes)


def test_leaves():
    page = ('<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body>'
            '<script>var t="</p>";</script><nav><ul><li><a href="/x">A &amp; B</a></li></ul></nav>'
            '<!-- <p>no</p> --><article class="Post Body" id=x><h1>Caf&eacute;</h1><p>one<b>two</b> \n three'
            '<br>four<p>five < six &nbsp; &#x41;</article><footer>&copy; me')
    got = leaves(page)
    assert [b.text for b in got] == ["A & B", "Café", "onetwo three", "four", "five < six A", "© me"]
    assert got[0].link_chars == 5 and got[1].link_chars == 0
    assert got[1].path[-2] == ("<article>", "post", "body", "x")
    assert got[4].path[-1] == ("<p>",)


@pytest.mark.parametrize("page", ["", " ", "<", "<p", "text only", "<a <b> c", "<script>x", "</p></div>", "&amp"])
def test_broken_pages(page):
    leaves(page)


@pytest.mark.parametrize("page, wanted", [
    ("<article><p>a</p><svg/><p>b</p></article>", ["a", "b"]),
    ('<p>a</p><svg class="x" viewBox="0 0 1 1" /><p>b</p><svg><text>no</text></svg><p>c', ["a", "b", "c"]),
    ("<p>a</p><svg-icon name=x></svg-icon><title-bar>b</title-bar><template-x>c</template-x><p>d", list("abcd")),
    ("<p>a</p><svg><p>b</p><p>c</p>", ["a", "b", "c"]),
    ("<p>a</p><template><p>b</p>", ["a", "b"]),
    ("<p>a</p><noscript><p>b</p>", ["a", "b"]),
    ("<p>a</p><svg><p>b</p><svg><text>no</text></svg><p>c</p>", ["a", "b", "c"]),
    ("<p>a</p><template>no<template>no</template>no</template><noscript>no</noscript><p>b", ["a", "b"]),
    ('<p>a</p><svg><p>b</p><script>"</svg>"</script ><p>c</p>', ["a", "b", "c"]),
    ("<title>no</title><p>a</p><style>no</style><iframe>no</iframe><textarea>no</textarea><p>b", ["a", "b"]),
])
def test_hidden_elements_take_no_text_along(page, wanted):
    assert [b.text for b in leaves(page)] == wanted


def test_whole_path_counts():
    deep = "<div>" * 20
    nav, article = (vectors(leaves(f"<{tag}>{deep}<p>one"), {}) for tag in ("nav", "article"))
    assert not np.array_equal(nav, article)
    many = " ".join(f"col{chr(97 + i)}" for i in range(12))
    one, other = (vectors(leaves(f'<div class="{many} {name}">one'), {}) for name in ("comments", "story"))
    assert not np.array_equal(one, other)


def test_elements_left_open():
    page = "<body><main>" + "<div><font>" * 3000 + "<p>a</p><footer><section>b</section>c</footer><article>d"
    got = leaves(page)
    assert [b.text for b in got] == list("abcd")
    tags = [[words[0] for words in b.path if words[0] != "<div>"] for b in got]
    assert tags == [["<body>", "<main>", "<p>"], ["<body>", "<main>", "<footer>", "<section>"],
                    ["<body>", "<main>", "<footer>"], ["<body>", "<main>", "<article>"]]
    many = leaves("<div>x<font>" * 50_000 + "<p>y</p>" * 50_000)
    assert len(many) == 100_000 and len(many[-1].path) == 50_001
    assert vectors(many, {}).shape[0] == 100_000


def test_all_words_count():
    start = "the of and to in is you that it he was for on are as with his they at be this have from "
    rows = [vectors(leaves(f"<p>{start}{end} end"), {}) for end in ("cookie policy", "policy cookie", "garden hedges")]
    assert np.array_equal(rows[0], rows[1])
    assert not np.array_equal(rows[0], rows[2])


def test_words_tell_parts_without_marks():
    """Parts in plain containers, known by the words of pages that mark them."""
    rng = random.Random(8)
    said = {kind: [f"{kind}{rng.choice('aeiou')}{chr(97 + i % 26)}{i}" for i in range(60)]
            for kind in ("art", "ad", "cookie", "reply")}
    marked = {"art": "<article>{}</article>", "ad": '<div class="ad">{}</div>',
              "cookie": '<div class="notice">{}</div>', "reply": '<div class="comments">{}</div>'}

    def text(kind):
        return " ".join(rng.choice(said[kind]) for _ in range(rng.randint(10, 30))).capitalize() + "."

    pages = ["<body>" + "".join(marked[kind].format(f"<p>{text(kind)}</p>") for kind in marked)
             for _ in range(60)]
    words = he.PartWords(map(leaves, pages))
    assert words.told == {"ad", "notice", "comments"}
    model = he.train(words, 1000)
    right = 0
    for _ in range(50):
        parts = [(kind, text(kind)) for kind in rng.sample(["cookie", "ad"], 2) + ["art", "art", "reply"]]
        page = "<body>" + "".join(f"<div><p>{t}</p></div>" for _, t in parts)
        right += text_of(model, page) == " ".join(t for kind, t in parts if kind == "art")
    assert right >= 45
    same = [f"<article>{text('art')}</article><div class=ad>{text('art')}</div>" for _ in range(60)]
    assert not he.PartWords(map(leaves, same)).told


def test_gradients():
    model, rng = BiLSTM(5, 4), np.random.default_rng(0)
    model.weights = {k: w.astype(np.float64) for k, w in model.weights.items()}
    x, mask = padded([rng.normal(size=(n, 5)) for n in (3, 6, 1)])
    y = rng.random(mask.shape) > 0.5
    grads = model.gradients(x, mask, y)[1]
    for name, w in model.weights.items():
        at = (2, 0)
        w[at] += 1e-4
        up = model.gradients(x, mask, y)[0]
        w[at] -= 2e-4
        down = model.gradients(x, mask, y)[0]
        w[at] += 1e-4
        assert (up - down) / 2e-4 == pytest.approx(grads[name][at], rel=0.02, abs=1e-5)


def test_batches_do_not_change_labels(model, words):
    maker = Maker(words, 5)
    sequences = [vectors(leaves(maker.page()), {}) for _ in range(30)]
    together = he.label(model, sequences)
    for sequence, labels in zip(sequences, together):
        assert np.array_equal(he.label(model, [sequence])[0], labels)


def test_held_out_layouts(model, words):
    maker, right, n = Maker(words, 77), 0, 0
    for _ in range(200):
        x, y = he.made_example(maker.page(), {})
        right += int((he.label(model, [x])[0] == (y > 0.5)).sum())
        n += len(y)
    assert right / n > 0.97


def test_deep_layouts(model, words):
    maker = Maker(words, 5)
    deep = "<div>" * 12
    wrong = 0
    for _ in range(20):
        inside, outside = maker.sentences(3, 6), maker.sentences(3, 6)
        page = (f"<body><article>{deep}<p>{inside}</p>{'</div>' * 12}</article>"
                f'<div class="comments">{deep}<p>{outside}</p>{"</div>" * 12}</div></body>')
        wrong += text_of(model, page) != inside
    assert wrong <= 1


def test_pages_of_the_table(spark, sf_dir):
    """The pages' article element, read another way."""
    import html
    import re

    from nearpath.llm.queries import op10_html_extract

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    got = {r["page_id"]: r for r in op10_html_extract(spark, sf_dir).collect()}
    assert len(got) == len(pages)
    wrong = 0
    for page in pages:
        inside = re.search(r"<article>(.*?)</article>", page["html"], re.S).group(1)
        inside = re.sub(r"</?(p|h1|br)\b[^>]*>", " ", inside)
        wanted = " ".join(html.unescape(re.sub(r"<[^>]*>", "", inside)).split())
        row = got[page["page_id"]]
        assert row["n_chars"] == len(row["text"]) and row["url"] == page["url"]
        wrong += row["text"] != wanted
    assert wrong <= 0.01 * len(pages)


def test_odd_rows(spark):
    rng = random.Random(3)
    long_page = "<body><article>" + "".join(
        f"<p>{' '.join(rng.choice(['one', 'two', 'three']) for _ in range(20))}.</p>" for _ in range(3000)
    ) + "</article>"
    rows = [(1, "http://a", None), (2, None, ""), (3, "http://b", "plain"), (None, "u", long_page),
            (4, "u", long_page), (4, "u", long_page)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr(
        "*", "'x' AS text", "1 AS n_chars")
    got = he.extract_main_text(pages).collect()
    assert len(got) == 6
    by = {r["page_id"]: r for r in got}
    assert by[1]["text"] == "" and by[2]["text"] == "" and by[1]["n_chars"] == 0
    assert by[4]["text"] == by[None]["text"] and by[4]["n_blocks"] > 2900


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert he.extract_main_text(pages, train_pages=50).count() == 0


@pytest.mark.parametrize("piece", [
    "<a ", "<p x='", "<!", "</script ", "<svg x='", "<template>", "<p x=\"'>", "<script "])
@pytest.mark.parametrize("end", ["", "'>", "'>\"> the end"])
def test_a_megabyte_of_broken_tags(piece, end):
    """One pass forward: seconds, not hours, and the text behind a closed tag stays."""
    started = time.time()
    found = leaves(piece * (1_000_000 // len(piece)) + end)
    assert time.time() - started < 10
    assert all(leaf.text for leaf in found)


def test_broken_tags_keep_the_text():
    page = "<p>one</p><a href='x <p>two</p> <b title=\"three>four</b><p>five"
    assert " ".join(leaf.text for leaf in leaves(page)) == "one two four five"
