import pytest

from binlens.llm import html_extract as H
from binlens.llm.html_blocks import blocks, name_words


@pytest.fixture(scope="module")
def field():
    return H.train_field(H.labelled_pages())


def texts(page):
    return [b.text for b in blocks(page)]


def test_blocks_whitespace_references_and_inline_tags():
    assert texts("<p>a &amp;  <b>b</b>old\n c&nbsp;d<br>e</p><div>&#233;&lt;</div>") == ["a & bold c d e", "é<"]


@pytest.mark.parametrize("page,want", [
    ("", []), ("plain", ["plain"]), ("<p>open<p>next", ["open", "next"]), ("<ul><li>a<li>b</ul>c", ["a", "b", "c"]),
    ("x<!-- y -->z", ["xz"]), ("<script>var a='</p>'</script>t", ["t"]), ("<style>p{}", []), ("a<p", ["a"]),
    ("<p title='a>b'>c", ["c"]), ("a < b", ["a < b"]), ("<p class=\"unclosed>text</p>", ["text"]), ("<!DOCTYPE html>q", ["q"]),
    ("<title>t</title><body>b", ["b"]), ("</div></p>z</b>", ["z"]), ("<table><tr><td>1<td>2<tr><td>3</table>", ["1", "2", "3"])])
def test_odd_markup(page, want):
    assert texts(page) == want


def test_names_and_parents():
    b = blocks('<div class="adBox site-top" id=x1><p>t</p>u</div>')
    assert b[0].tags == ("div", "p") and set(b[0].names) == {"ad", "box", "site", "top", "x"} and b[0].parent != b[1].parent
    assert name_words("HTMLBody main_text") == ["html", "body", "main", "text"]


def brute_labels(field, page):
    """Best of all label strings."""
    from itertools import product
    best = None
    for labels in product((0, 1), repeat=len(page)):
        s = sum(field.score(b) for b, y in zip(page, labels) if y)
        s += sum(field.pairs[H.pair_kind(a, b)][x][y] for a, b, x, y in zip(page, page[1:], labels, labels[1:]))
        if best is None or s > best[0]:
            best = s, list(labels)
    return best


def test_viterbi_is_exact(field):
    for page, _ in H.labelled_pages(40, seed=3):
        page = page[:9]
        s, _ = brute_labels(field, page)
        d = field.decode(page)
        got = sum(field.score(b) for b, y in zip(page, d) if y)
        got += sum(field.pairs[H.pair_kind(a, b)][x][y] for a, b, x, y in zip(page, page[1:], d, d[1:]))
        assert got == pytest.approx(s)
    assert field.decode([]) == []


def test_held_out_accuracy(field):
    wrong = total = 0
    for page, labels in H.labelled_pages(150, seed=77):
        wrong += sum(a != b for a, b in zip(field.decode(page), labels))
        total += len(labels)
    assert wrong < 0.02 * total


def test_layouts(field):
    article = "<article><h1>Head line of it</h1><p>First words of the story, and more of them.</p><p>Last one.</p></article>"
    for junk in ('<nav><a href="/">Home</a> <a href="/b">News</a></nav>', '<div class="cookie-notice">We use cookies. Agree to them.</div>',
                 "<aside><h3>Related</h3><p>Some other story, told at length here.</p></aside>", "<footer>&copy; 2020 Site</footer>",
                 '<form><label>Mail address</label><input><button>Send</button></form>', '<div class="ad">Buy this now, it is good.</div>',
                 '<section id="comments"><p>I liked the story, it was good to read.</p><p>I did not.</p></section>'):
        for page in (junk + article, article + junk):
            assert H.main_text("<html><body>" + page + "</body></html>", field) == (
                "Head line of it First words of the story, and more of them. Last one."), junk


def test_rows(spark, field):
    rows = [(1, "u", "<article><p>Some words that make a sentence.</p></article>"), (2, None, None), (None, "v", ""), (3, "w", "<nav><a>x</a></nav>"),
            (3, "w", "<nav><a>x</a></nav>"), (4, "l", "<article>" + "<p>A long text of the article goes on.</p>" * 20000 + "</article>")]
    df = spark.createDataFrame([(*r, "e", "t") for r in rows], "page_id long, url string, html string, id string, n_chars string")
    got = sorted(((r.page_id or 0, r.url, r.text, r.n_chars) for r in H.extract_pages(df, model=field).collect()), key=str)
    assert len(got) == 6 and all(len(t) == n for _, _, t, n in got)
    by = {i: t for i, _, t, _ in got}
    assert by[1] == "Some words that make a sentence." and by[2] == by[3] == by[0] == ""
    assert by[4].count("A long text of the article goes on.") == 20000
    assert H.extract_pages(df.limit(0), model=field).count() == 0


DEEP = 100_000


@pytest.mark.parametrize("page,n", [
    ("<div>x" * DEEP, DEEP), ("<b>x" * DEEP + "<p>y</p>" * DEEP, DEEP + 1), ("<div>" * DEEP + "</p></b>" * DEEP + "t", 1),
    ("<b>" * DEEP + "<div>z</div></i>" * DEEP, DEEP), ("<li><div>" * DEEP + "u", 1)])
def test_nested_and_unclosed_tags_take_linear_time(page, n):
    from time import process_time
    model = H.Field({"in:div": 0.5, "tag:div": 1.0, "bias": -1.0}, [[[0.0, 0.0], [0.0, 0.0]]] * 2)
    start = process_time()
    found = blocks(page)
    assert len(found) == n and len(model.decode(found)) == n
    assert process_time() - start < 60          # a tuple of ancestors for each block took 11 s at a twelfth of this depth


def test_score_of_a_block_is_that_of_its_features():
    import random
    rng = random.Random(4)
    tags = "div p b i a li ul td tr table span html body em dl dt".split()
    model, weights = None, {}
    for _ in range(300):
        page = "".join(rng.choice([f"<{t}>", f"<{t} class='{rng.choice(['ad', 'menuBar main', 'menus ad'])}'>", f"</{t}>", "w "]) for t in rng.choices(tags, k=40))
        for b in blocks(page):
            for f in H.path_features(b) + H.text_features(b):
                weights.setdefault(f, rng.random())
        model = model or H.Field(weights, None)
        for b in model.read(page):
            assert model.score(b) == pytest.approx(sum(weights[f] for f in H.path_features(b) + H.text_features(b)))
            assert b.path.last == next((t for t in reversed(b.tags) if t not in ("html", "body")), "body")
        model.forget()
