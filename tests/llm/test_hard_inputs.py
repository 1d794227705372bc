"""Inputs that used to take quadratic time, clash with an operator's own names, or leave the wrapper to decide alone."""

import json
import random
import time

import pytest

pytest.importorskip("public_tokenizers")

from tidewater.llm import decontamination, html_wrapper, toxicity  # noqa: E402


def seconds(job):
    began = time.perf_counter()
    job()
    return time.perf_counter() - began


def test_a_million_letters_fold_in_no_time():
    for text in ("a" * 1_000_000, "漢字" * 500_000, "a1" * 500_000, "you f0ol " * 110_000, "@" * 1_000_000, "a@" * 500_000):
        assert seconds(lambda text=text: toxicity.fold(text)) < 2
    lexicon = toxicity.Lexicon({"bad": 1.0}, frozenset({"bad luck "}))
    assert seconds(lambda: lexicon.score("bad luck " * 60_000 + "bad " * 60_000)) < 5


def test_exceptions_swept_equal_those_compared_one_by_one():
    rng = random.Random(9)
    words = ["ab", "abc", "abcd", "xab", "c", "d"]
    for _ in range(500):
        weights = {w: float(i + 1) for i, w in enumerate(rng.sample(words, 3))}
        phrases = frozenset(" ".join(rng.choice(words) for _ in range(rng.randint(1, 3))) + rng.choice(["", " "]) for _ in range(2))
        folded = toxicity.fold(" ".join(rng.choice(words) for _ in range(rng.randint(0, 14))))
        hits = {}
        for w, weight in weights.items():
            for at in range(len(folded)):
                if folded.startswith(" " + w, at) and len(w) + 1 > hits.get(at - 1, (0, 0))[0]:
                    hits[at - 1] = (len(w) + 1, weight)
        spared = [(at - 1, at + len(p)) for p in phrases for at in range(len(folded)) if folded.startswith(" " + p, at)]
        want = sum(x for at, (n, x) in hits.items() if not any(a <= at and at + n <= b for a, b in spared))
        assert toxicity.Lexicon(weights, phrases).amount(folded) == pytest.approx(want)


def test_spans_are_cut_from_tables_with_the_operators_own_names(spark):
    passage = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"before {passage} after", "kept", 5, "x"), (2, "clean", "kept", 6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __items string, __N_words long, ___spans string")
    bench = spark.createDataFrame([("i", passage)], "item_id string, text string")
    got = {r[0]: tuple(r)[1:] for r in decontamination.remove(docs, bench).collect()}
    assert got == {1: ("before  after", "kept", 5, "x"), 2: ("clean", "kept", 6, None)}


def test_broken_markup_is_read_in_one_scan():
    n = 250_000
    for page in ('<a "' * n, "<a x=" * n, '<a ">"' * n, '<a "' * n + ">", "<script " * n, "<!" * n, "<!--" * n, "<a '\"" * n + ">x"):
        assert seconds(lambda page=page: html_wrapper.parse(page)) < 3
    read = lambda page: html_wrapper.main_text(page, None)
    assert read('<article><p class="x>Hello</p><p>two</p></article>') == "Hello two"
    assert read('<article><p title="a>b">Hello</p><p data-x=\'">\'>two</p></article>') == "Hello two"
    assert read("<article><p>a < b and c > d</p><script>if (a<b) x='</p>'</script><!-- no --></article>") == "a < b and c > d"
    assert read("<article><p>one</p><p") == "one <p"  # nothing closes what opens after the last tag: text


def test_ids_of_single_pages_do_not_grow_the_wrapper(spark):
    page = lambda k: (f"<div id='hd-{k}'>Acme daily news</div><div id='body-{k}' class='x{k}'><p id='c-{k}-1'>Text {k} is long enough.</p>"  # noqa: E731
                      f"<p id='c-{k}-2'>More {k} of it.</p></div><div id='nt-{k}'>Same notice on each page</div>")  # fmt: skip
    w, sizes = None, {}
    for k in range(200):
        s = html_wrapper.skeleton(html_wrapper.settle(html_wrapper.parse(page(k)), frozenset()))
        w = s if w is None else html_wrapper.merge(w, s)
        sizes[k] = len(json.dumps(w))
    assert sizes[199] < sizes[20] + 40
    rows = [(k, f"http://a.example/{k}", page(k)) for k in range(8)]
    got = {r.page_id: r.text for r in html_wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"Text {k} is long enough. More {k} of it." for k in range(8)}
    # no article, no telling name: without the wrapper the page reads otherwise
    assert "Acme daily news" in html_wrapper.main_text(page(3), None)


def test_words_of_the_template_are_those_of_half_the_pages(spark):
    html = lambda k: f"<div class='card c{k % 3} {'lead' if k % 2 else ''}'><p id='p{k}'>t</p></div>"
    rows = [(k, "http://a.example/", html(k)) for k in range(8)] + [(90, None, None), (91, "http://b.example/", "<p id='only'>x</p>")]
    got = {r.host: r.words for r in html_wrapper.template_words(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {"a.example": ["card", "lead"], "b.example": ["only"]}


def test_long_lists_of_siblings_are_aligned_in_windows():
    rng = random.Random(3)
    x = [[f"n{rng.randrange(40)}", 1, False, False, None, 0, 0, []] for _ in range(20_000)]
    y = [n for n in x if rng.random() < 0.99]
    pairs = []
    assert seconds(lambda: pairs.extend(html_wrapper._align(x, y))) < 20
    assert [i for i, _ in pairs if i is not None] == list(range(len(x))) and [j for _, j in pairs if j is not None] == list(range(len(y)))
    both = [(i, j) for i, j in pairs if i is not None and j is not None]
    assert all(x[i][0] == y[j][0] for i, j in both) and len(both) > 0.99 * len(y)
