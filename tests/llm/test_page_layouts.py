"""Pages without containers, and elements without text of the page that hold others of their kind."""

import time

import pytest

from lamella.llm.html_blocks import leaf_blocks
from lamella.llm.html_extract import main_text, trained


@pytest.fixture(scope="module")
def model():
    return trained()


SENTENCE = "A sentence, as long as any other, that stands alone on its page."


@pytest.mark.parametrize(
    "html",
    [
        f"<body><p>{SENTENCE}</p></body>",
        SENTENCE,
        f"{SENTENCE}<br>{SENTENCE}",
        f"<html><head><title>x</title></head><body>{SENTENCE}</body></html>",
        f"<h1>Heading here</h1><p>{SENTENCE}</p><p>{SENTENCE}</p>",
        f"<ul><li>{SENTENCE}</li><li>{SENTENCE}</li></ul>",
    ],
)
def test_pages_without_containers(model, html):
    text = main_text(model, html)
    assert text.count(SENTENCE) == html.count(SENTENCE)


def test_no_text_is_made_up(model):
    assert main_text(model, None) == main_text(model, "") == main_text(model, "<p> </p>") == ""
    assert main_text(model, '<ul><li><a href="/">Home</a></li><li><a href="/b">Shop</a></li></ul>') == ""
    assert main_text(model, "<nav><p>Home Shop</p></nav>") == "" and main_text(model, '<p hidden>x y z</p>') == ""
    assert main_text(model, "<script>var a;</script>") == ""


def texts(html):
    return [b.text for b in leaf_blocks(html)]


def test_elements_inside_their_own_kind():
    for tag in ("object", "template", "svg", "noscript", "button"):
        assert texts(f"<p>a</p><{tag}><{tag}>inner</{tag}>LEAK</{tag}><p>b</p>") == ["a", "b"]
        assert texts(f"<{tag}/><p>b</p><{tag} x=1>in</{tag} ><p>c</p>") == ["b", "c"]
        assert texts(f"<p>a</p><{tag}>in</{tag}s></{tag}><p>b</p>") == ["a", "b"]
        assert texts(f"<{tag}><{tag}>x</{tag}><p>b</p>") == ["b"]  # one never ends: the next end tag ends it
        assert "b" in texts(f"<{tag}><p>b</p>")
    assert texts("<script>if (a </scripts>) x</script><p>b</p>") == ["b"]
    assert texts("<textarea><textarea></textarea><p>b</p>") == ["b"]  # literal: nothing nests


@pytest.mark.parametrize("piece", ["<object>", "</object><object>", "<object><object></object>", "<svg><template>", "</object"])
def test_many_of_them_take_time_in_proportion(piece):
    def took(n):
        html = piece * n + "<p>end</p>"
        began = time.perf_counter()
        leaf_blocks(html)
        return time.perf_counter() - began

    took(100)
    assert took(40_000) < 3
