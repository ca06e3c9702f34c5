"""Elements without text whose end tags are left out, against what HTML makes of them."""

from __future__ import annotations

import pytest

from rankspark.llm.html_mincut import main_text, page_blocks

A = "<article><p>This is the article, with a long and quite ordinary sentence. It goes on.</p></article>"
TEXT = "This is the article, with a long and quite ordinary sentence. It goes on."

PAGES = {
    "head before body": "<html><head><meta charset=utf-8><title>T</title><link href=x><style>p{}</style><body>" + A,
    "head before an element": "<head><title>T</title><script>var a;</script>" + A,
    "script with a comment": "<html><body><script>var a = '<!--';</script>" + A,
    "script with tags": "<body><script>document.write('<script><p>no</p><svg>');</SCRIPT\n>" + A,
    "style with a comment": "<style><!-- p{} </style>" + A,
    "textarea with a comment": "<textarea><!-- <select></textarea>" + A,
    "title with a comment": "<head><title>a <!-- b</title></head><body>" + A,
    "title with a tag": "<title>a <svg> b</title>" + A,
    "options of a datalist": "<datalist><option>One<option>Two</datalist>" + A,
    "options of a select": "<select><optgroup><option>One<option>Two</select>" + A,
    "select in a form row": "<div><select><option>One</div>" + A,
    "select before a select": "<select><option>One<select><option>Two</select>" + A,
    "button in a row": "<div><button>Buy</div>" + A,
    "button before a button": "<button>Buy<button>Sell</button>" + A,
    "svg in a row": "<div><svg><title>Sign</title><path d=x></div>" + A,
    "svg before a paragraph": "<svg><path d=x><p></p>" + A,
    "html in an svg": "<svg><foreignObject><div><p>no text</p></div></foreignObject><text>no</text></svg>" + A,
    "nested objects": "<object><object>no</object><div>no</div>no</object>" + A,
    "template with stray ends": "<div><template></div><p>no</p></template></div>" + A,
    "script in a button": "<button><script>'</button>'</script>Buy</button>" + A,
    "video in a figure": "<figure><video><source src=x>no video</figure>" + A,
}


@pytest.mark.parametrize("name", PAGES)
def test_article_after(name):
    assert [b.text for b in page_blocks(PAGES[name])] == [TEXT]
    assert main_text(PAGES[name]) == TEXT


def test_unended():
    assert [b.text for b in page_blocks("<p>Some text</p><script>" + A)] == ["Some text"]
    assert [b.text for b in page_blocks("<head><title>T</title>Some text")] == ["Some text"]
    for odd in ("<script>" + "</script " * 20_000, "<title>" * 20_000, "<svg>" * 3000 + "</div>" * 3000, "<select><option>", "<template><p>"):
        assert page_blocks(odd) == []
