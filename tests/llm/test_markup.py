"""Malformed markup loses no text of the article."""

import time

import pytest

from lexiclust.llm import extract


@pytest.mark.parametrize("page", [
    "<article><p class=it's>One a.</p><p>Two b.</p><p>don't lose c.</p></article>",
    "<article><!--><p>One a.</p><p>Two b.</p><!-- x --><p>don't lose c.</p></article>",
    "<article><!---><p>One a.</p><p>Two b.</p><!-- x --!><p>don't lose c.</p></article>",
    "<article><p title = \"a > b\" id='x>y'>One a.</p><p>Two b.</p><p o'>don't lose c.</p></article>",
])
def test_quotes_and_comments(page):
    said = [value for what, value, _ in extract.events(page) if what == "text"]
    assert said == ["One a.", "Two b.", "don't lose c."]


def test_deep_and_unclosed_elements_take_linear_time():
    model = extract.RegionModel({})
    open_tags = "<article>" + "".join(f"<b>w{i} " for i in range(100_000)) + "</article>"
    nested = "<div>" * 20_000 + "<article><p>The text.</p></article>" + "x</div>" * 20_000
    many = "<i>" * 20_000 + "<article><p>One.</p></article><nav>no</nav>" * 2_000
    begin = time.process_time()
    assert len(model.extract(open_tags).split()) == 100_000
    assert "The text." in model.extract(nested).split("\n")
    assert model.extract(many).split("\n") == ["One."] * 2_000
    assert extract.places(nested)["word", "article", True] == 2
    assert time.process_time() - begin < 20
