"""Pages whose wrappers have names of outside parts, and short runs between long paragraphs."""

import pytest

from terralog.llm.html_extract import extract

LONG = [f"Paragraph {k} has many words of running text that tell a story at some length, and then it goes on for a while longer." for k in range(6)]
BODY = "<h1>Title</h1>" + "".join(f"<p>{t}</p>" for t in LONG)
WANT = "\n".join(["Title", *LONG])
NAV = "<nav><a href=x>Home</a></nav>"


@pytest.mark.parametrize("wrap", ["<div class='layout with-sidebar'>%s</div>", "<div id='page-header-wrap'>%s</div>", "<form action=x><input type=hidden>%s<button>Send</button></form>"])
@pytest.mark.parametrize("inner", ["<article>%s</article>", "<main>%s</main>", "<div>%s</div>"])
def test_wrappers(wrap, inner):
    assert extract(f"<html><body>{NAV}{wrap % (inner % BODY)}<div class=sidebar><p>Other things</p></div><footer>Foot</footer></body></html>") == WANT


def test_title_in_entry_header():
    page = f"<body>{NAV}<div><div class='entry-header'><h1>Title</h1></div>" + "".join(f"<p>{t}</p>" for t in LONG) + "</div></body>"
    assert extract(page) == WANT


def test_comments_stay_outside():
    many = "".join(f"<article class=comment><p>{t} Says a reader.</p></article>" for t in LONG * 3)
    assert extract(f"<body><article>{BODY}</article><div class=comments>{many}</div></body>") == WANT


@pytest.mark.parametrize("last", [False, True])
def test_short_items_stay(last):
    items = [f"item {k}" for k in range(6)]
    parts = [f"<p>{t}</p>" for t in LONG[:3]] + ["<ul>" + "".join(f"<li>{t}</li>" for t in items) + "</ul>"] + ([] if last else [f"<p>{t}</p>" for t in LONG[3:]])
    assert extract(f"<body>{NAV}<div>{''.join(parts)}</div><div class=footer>Foot</div></body>") == "\n".join(LONG[:3] + items + ([] if last else LONG[3:]))


def test_card_beside_the_text():
    got = extract(f"<body>{NAV}<div>{BODY}</div><article><p>A card with a line of text about another page, long enough to count as text.</p></article></body>")
    assert got.startswith(WANT)
