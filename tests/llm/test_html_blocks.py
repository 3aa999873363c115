import html

import numpy as np

from weftline.llm import html_blocks as H
from weftline.llm.page_maker import make_page


def test_blocks_of_broken_markup():
    page = """<html><head><title>t</title><script>var t="</p>";</script></head><body><nav><ul><li><a href=/x>One<li><a href=/y>Two</ul></nav>
    <article class="post main"><h1>A &amp;&nbsp;B</h1><p><b>first<br>line<p>second &lt;3 <!-- <p>no --> end<div>third</div></article><p>a < b</body>"""
    got = [(b.text, b.path[-1]) for b in H.blocks_of(page)]
    assert [t for t, _ in got] == ["One", "Two", "A & B", "first line", "second <3 end", "third", "a < b"]
    assert H.blocks_of(page)[0].linked == 1.0 and "article post main" in H.blocks_of(page)[2].path
    assert H.blocks_of(None) == [] and H.blocks_of("") == [] and H.blocks_of("   ") == []
    assert [b.text for b in H.blocks_of("just text")] == ["just text"]
    assert [b.text for b in H.blocks_of("<p>open <a href='x")] == ["open <a href='x"]


def test_gradients_match_differences():
    r = np.random.default_rng(0)
    m = H.BiLSTM.fresh(1, dim=7, hidden=H.HIDDEN)
    x, y, n = r.normal(size=(5, 3, 7)), (r.random((5, 3)) > 0.5).astype(float), np.array([5, 2, 4])
    _, g = m.grads(x, y, n)
    for name in m.NAMES:
        flat = m.p[name].reshape(-1)
        for k in r.integers(0, flat.size, 4):
            old, e = flat[k], 1e-5
            flat[k] = old + e
            up = m.grads(x, y, n)[0]
            flat[k] = old - e
            down = m.grads(x, y, n)[0]
            flat[k] = old
            assert abs((up - down) / (2 * e) - g[name].reshape(-1)[k]) < 1e-6


def test_labels_pages_that_it_was_not_trained_on():
    model, right, total = H.BiLSTM.load(), 0, 0
    for seed in range(10_000, 10_150):
        got = H.labelled(*make_page(seed))
        if got:
            p = model.label([H.vectors([b for b, _ in got])])[0] >= 0.5
            right, total = right + (p == np.array([y for _, y in got], bool)).sum(), total + len(got)
    assert right / total > 0.99


def test_training_learns():
    model = H.train_model(pages=150, epochs=3)
    right = total = 0
    for seed in range(20_000, 20_040):
        got = H.labelled(*make_page(seed))
        if got:
            p = model.label([H.vectors([b for b, _ in got])])[0] >= 0.5
            right, total = right + (p == np.array([y for _, y in got], bool)).sum(), total + len(got)
    assert right / total > 0.9


def test_extract(spark):
    text = ["Title &c. <x>", "Some  words\n in a paragraph.", "é & more. " * 3000]
    body = "".join(f"<p>{html.escape(t)}</p>" for t in text[1:])
    page = f'<html><body><nav><ul><li><a href="/">home</a></li></ul></nav><div class="ad">Buy this now.</div><article><h1>{html.escape(text[0])}</h1>{body}</article><footer>&copy; x</footer>'
    rows = [(1, "u", page, "z"), (2, None, None, "z"), (3, "u", "", "z"), (None, "u", "<article><p>one paragraph of an article", "z"), (1, "u", page, "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = H.extract(df).collect()
    want = "\n".join(" ".join(t.split()) for t in text)
    assert len(got) == 5 and [r["text"] for r in got if r["page_id"] == 1] == [want, want]
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert [r["text"] for r in got if r["page_id"] in (2, 3)] == ["", ""]
    assert H.extract(df.limit(0)).count() == 0


def test_blocks_of_loose_markup():
    def texts(p):
        return [b.text for b in H.blocks_of(p)]

    assert texts("<html><head><title>t</title><meta charset=utf-8><body><p>one</p></body>") == ["one"]
    assert texts("<head><title>t</title><link rel=x><p>one<div>two</div>") == ["one", "two"]
    assert texts("<body><svg width=1/><p>one</p><svg><path d=x><p>two</p>") == ["one", "two"]
    assert texts("<p>a <math><mi>x</mi><mo>=</mo><mn>2</mn></math> b</p><object data=x><p>c</p>") == ["a x=2 b", "c"]
    assert texts("<p>a</p><script>if (a<b) x()") == ["a"] and texts("<p>a</p><textarea>rest<p>b") == ["a"]


def test_whole_block_counts():
    """Words and digits of a block's end change its vector as those of its beginning do."""
    base = "word " * 500
    a, b, c = (H.vectors([H.Block(("body", "p"), t.strip(), 0.0)]) for t in (base, base + "other", base + "12345"))
    assert (a != b).any() and (a[0, -4] != c[0, -4]) and a[0, -4] == 0


def test_kept_columns_of_the_results_names(spark):
    df = spark.createDataFrame([(1, "u", "old", "<body><p>" + "A sentence of the article, with words. " * 10 + "</p></body>")], "page_id long, url string, text string, html string")
    got = H.extract(df, keep=("page_id", "url", "text"))
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.first()["text"] != "old"
    assert H.extract(df.limit(0)).count() == 0
