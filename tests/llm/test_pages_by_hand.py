"""Main text of pages labelled by hand, and of broken pages."""

import time
from collections import Counter

import pytest
from labelled_pages import PAGES

from treeflow.llm import html_tree


def scores(got: str, want: str) -> tuple[float, float]:
    """Precision and recall of words, by count."""
    a, b = Counter(got.split()), Counter(want.split())
    both = sum((a & b).values())
    return both / max(1, sum(a.values())), both / max(1, sum(b.values()))


def test_accuracy_on_other_layouts():
    model = html_tree.default_model()
    found = {name: scores(model.text(page), text) for name, page, text in PAGES}
    print({k: tuple(round(x, 3) for x in v) for k, v in found.items()})
    precision, recall = (sum(v[i] for v in found.values()) / len(found) for i in (0, 1))
    print(f"mean precision {precision:.3f}, recall {recall:.3f}")
    assert precision >= 0.9 and recall >= 0.9


def test_visible_text_stays():
    page = "<main><h1>One</h1><p aria-hidden='true'>Two is shown.</p><p>Three <math><mi>x</mi></math> four.</p><p hidden>Not this one.</p></main>"
    assert html_tree.default_model().text(page) == "One\nTwo is shown.\nThree x four."


@pytest.mark.parametrize("broken", ["<a ", '<a "', "<a =\"'", "</script ", "<!--", '<a =">"', "<", "</", "<a href='x", "<b></i>"])
def test_broken_pages_take_linear_time(broken):
    for page in (broken * (1_000_000 // len(broken)), broken * (1_000_000 // len(broken)) + ">", "<script>" + broken * (1_000_000 // len(broken))):
        began = time.time()
        html_tree.parse(page)
        assert time.time() - began < 5


def test_tags():
    def leaves(page):
        return [n.text for n in html_tree.parse(page) if n.tag == "#text"]

    assert leaves("<p title='a > b'>one</p><p title=it's>two</p>") == ["one", "two"]
    assert leaves("1 < 2 and a<b") == ["1 < 2 and a<b"]
    assert leaves("<p>one<!-- > --->two<!-->three<!--->four<!-- never closed") == ["onetwothreefour"]
    assert leaves("<p>a<script>if (x</p>) '</scripty>'</script >b") == ["ab"]
    assert leaves('<p class="never closed>text') == ["text"]
    assert leaves("&amp;&nbsp;&#x41;") == ["& A"]
