"""Layouts that the content model wasn't trained or tuned on, most of them short: whole articles, nothing else."""

import pytest

from rangeloom.llm import html

A = "The harbour froze early that year, and the boats stayed in until March."
B = "Nobody had planned for it. The council met twice, argued about coal, and went home."
C = "By spring the ice broke with a noise like cannon, which people still talk about when the wind turns to the north."
LONG = " ".join([A, B, C, B, A])
MENU = "<a href=/>Home</a> <a href=/news>News</a> <a href=/about>About us</a>"

#: (page, the blocks of its article)
HELD_OUT = [
    (f"<p>{A}</p>", [A]),
    (f"{LONG}", [LONG]),
    (f"<html><body><h2>Ice</h2>{A}</body></html>", ["Ice", A]),
    (f"<body><h1>Ice</h1><p>{A}</p><p>{B}</p></body>", ["Ice", A, B]),
    (f"<body><div><div><div><p>{LONG}</p></div></div></div></body>", [LONG]),
    (f"<main>{A}</main>", [A]),
    (f"<main><h1>Ice in the harbour</h1>{LONG}</main>", ["Ice in the harbour", LONG]),
    (f"<article>{B}</article>", [B]),
    (f"<article><h1>Ice</h1><p>{A}</p></article>", ["Ice", A]),
    (f"<section><p>{B}</p></section>", [B]),
    (f"<section><h3>Ice</h3><p>{A}</p><p>{C}</p></section>", ["Ice", A, C]),
    (f"<body><blockquote>{C}</blockquote></body>", [C]),
    (f"<body><table><tr><td>{LONG}</td></tr></table></body>", [LONG]),
    (f"<body>{A}<br>{B}<br>{C}</body>", [A, B, C]),
    (f"<body><ul><li>{A}</li><li>{B}</li></ul></body>", [A, B]),
    (f"<body><nav>{MENU}</nav><p>{A}</p></body>", [A]),
    (f"<body><nav>{MENU}</nav><main><p>{A}</p></main></body>", [A]),
    (f"<body><nav>{MENU}</nav><h1>Ice</h1><p>{LONG}</p></body>", ["Ice", LONG]),
    (f"<body><div class=menu>{MENU}</div><div><p>{B}</p></div></body>", [B]),
    (f"<body><header>{MENU}</header><div><h1>Ice</h1><p>{C}</p></div><footer>(c) 1999 Harbour Post</footer></body>", ["Ice", C]),
    (f"<body><article><h1>Ice</h1><p>{LONG}</p></article><footer><p>All rights reserved by the Harbour Post.</p></footer></body>", ["Ice", LONG]),
    (f"<body><main><p>{A}</p></main><aside><h4>Read more</h4><a href=1>Storms</a> <a href=2>Fish prices</a></aside></body>", [A]),
    (f"<body><div id=content><p>{B}</p></div><div id=sidebar><a href=1>Storms</a></div></body>", [B]),
    (f"<body><div class=text>{LONG}</div><div class=footer>Contact: harbour post, quay 4.</div></body>", [LONG]),
    (f"<body><div class=cookie>We use cookies to improve your visit.</div><p>{A}</p><p>{B}</p></body>", [A, B]),
    (f"<body><ul class=nav><li><a href=1>One</a><li><a href=2>Two</a></ul><div><h2>Ice</h2><p>{A}</p></div></body>", ["Ice", A]),
    (f"<body><main><h1>Ice</h1><p>{A}</p></main><section class=comments><p>Nice piece, thanks for it.</p><p>{B}</p></section></body>", ["Ice", A]),
    (f"<body><div class=post><p>{C}</p></div><div class=comments><div class=comment><p>{A}</p></div></div></body>", [C]),
    (f"<body><h1>Ice</h1><p>{A}</p><form><label>Your mail</label><input><button>Send</button></form></body>", ["Ice", A]),
    (f"<body><div class=ad>Buy new skates now, half price!</div><article><p>{B}</p></article></body>", [B]),
    (f"<body><div class=wrapper><div class=topbar>{MENU}</div><div class=story><p>{A}</p></div></div></body>", [A]),
    (f"<body><nav>{MENU}</nav><div><p>{A} <a href=x>A link</a> in it.</p></div></body>", [A + " A link in it."]),
    (f"<body><nav>{MENU}</nav><article><h1>Ice</h1><p>{A}</p><ul><li>Coal</li><li>Fish and bread</li></ul><p>{B}</p></article><footer>{MENU}</footer></body>", ["Ice", A, "Coal", "Fish and bread", B]),
    (f"<body><div class=alert>{B}</div><main><p>{A}</p><p>{C}</p></main></body>", [A, C]),
    (f"<body><nav>{MENU}</nav><footer>(c) 1999 Harbour Post</footer></body>", []),
    (f"<body><dl><dt>Ice</dt><dd>{A}</dd><dt>Coal</dt><dd>{B}</dd></dl></body>", ["Ice", A, "Coal", B]),
]


@pytest.mark.parametrize("layout", range(len(HELD_OUT)))
def test_whole_article(layout):
    page, want = HELD_OUT[layout]
    assert html.main_text(page, html.default_model()) == "\n".join(want)


S = "Some sentence of forty characters or so."
L = " ".join([S] * 5)


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<body><h1>T</h1><p>{L}</p></body>", f"T\n{L}"),
        (f"<body><nav><a>Home</a></nav><div><h1>T</h1><p>{S}</p><p>{L}</p></div><footer>c</footer></body>", f"T\n{S}\n{L}"),
        (f"<main><p>{S}</p></main>", S),
        (f"<body><p>{L}</p></body>", L),
        (f"<div class=x><p>{S}</p></div>", S),
        (S, S),
    ],
)
def test_lone_paragraphs(page, want):
    assert html.main_text(page, html.default_model()) == want
