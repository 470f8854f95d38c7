"""Named parts inside articles, constructs that never end, parts left open, and articles in articles."""

import pytest

from terralog.llm.html_extract import extract
from tests.llm.test_html_wrappers import BODY, LONG, NAV, WANT


@pytest.mark.parametrize("part", ["<p class='notice-period'>%s</p>", "<div class='tags-explained'>%s</div>", "<p class=social>%s</p>", "<section class='legal'>%s</section>", "<p class='alert'>%s</p>"])
def test_prose_with_a_name_stays(part):
    told = LONG[0] + " It tells of notice and of tags."
    text = told if "section" not in part else " ".join(LONG)
    assert extract(f"<body><article>{BODY}{part % text}</article></body>") == f"{WANT}\n{text}"


@pytest.mark.parametrize("part", ["<div class='share-buttons'><a href=x>Share</a> <a href=y>Post</a></div>", "<div class=notice><p>We use storage.</p></div>", "<ul class=tags><li><a href=x>one</a><li><a href=y>two</a></ul>",
                                  "<form class=newsletter><p>Your address</p><input></form>", "<section id=comments>" + "<p>A reader says a lot about this, and then some more of it.</p>" * 40 + "</section>",
                                  "<p class=related><a href=x>Another page about this</a></p>", "<div class='related-links'><a href=x>Another</a></div>"])
def test_named_parts_of_an_article_go(part):
    assert extract(f"<body><article>{BODY}{part}</article></body>") == WANT


@pytest.mark.parametrize("tail", ["<!-- <p>rest of it", "<b", "<a href='x>never closed <p>more", "</", "<!DOC", "<p class"])
def test_unfinished_markup_is_no_text(tail):
    got = extract(f"<body><article>{BODY}</article>{tail}")
    assert got == WANT
    assert "<" not in extract(f"<article>{BODY}<p>The end {tail}") or tail == "</"


def test_signs_of_comparison_stay():
    assert extract("<article><p>It holds that 3 < 4 and a<5 & b > c</p></article>").startswith("It holds that 3 < 4")


@pytest.mark.parametrize("tag", ["aside", "nav", "header"])
def test_part_left_open_before_the_article(tag):
    assert extract(f"<body><{tag}><p>Besides</p><article>{BODY}</article></body>") == WANT
    assert extract(f"<body><{tag}><article><p>A card about another page, with some text in it.</p></article></{tag}><article>{BODY}</article></body>") == WANT


def test_card_in_main():
    card = "<article class=card><h3>Other</h3><p>A teaser about another page.</p></article>"
    assert extract(f"<body>{NAV}<main>{BODY}{card}</main></body>") == WANT
    assert extract(f"<body>{NAV}<main><article>{BODY}</article>{card}</main></body>") == WANT
    posts = "".join(f"<article><p>{t}</p></article>" for t in LONG)
    assert extract(f"<body>{NAV}<main>{posts}</main></body>") == "\n".join(LONG)
