"""Pages that leave optional tags out, and formulas in text."""

import pytest

from loam.llm.dom import blocks


def said(page):
    return [n.text for n in blocks(page) if n.tag == "#text"]


@pytest.mark.parametrize("page", [
    "<head><title>x</title><article><p>All of it.</p></article>", "<html><head><meta charset=utf-8><title>x</title><link rel=a><p>All of it.", "<head><title>x</title>All of it.", "<head><title>x</title><b>All of it.</b>",
    "<html><head><title>x</title></head><body><p>All of it.</p></body></html>", "<head><noscript><p>no</p></noscript><template><div>no</div></template><p>All of it.",
])
def test_a_head_ends_with_or_without_its_tag(page):
    assert said(page) == ["All of it."]


def test_images_after_an_open_head_are_kept():
    assert [m[1] for n in blocks('<head><title>x</title><img src="a.png"><p>b', media=True) for m in n.media] == ["a.png"]


def test_formulas_stay_in_their_sentence():
    page = '<p>Let <math><semantics><mi>x</mi><mo>=</mo><mn>1</mn><annotation encoding="application/x-tex">x=1</annotation></semantics></math> hold.</p><p>After.</p>'
    assert said(page) == ["Let x=1 hold.", "After."]
