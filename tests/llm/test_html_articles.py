"""Pages whose whole article sits in what looks like boilerplate, and trees against a plain density loop."""

import math
import random
import time

import pytest

pytest.importorskip("tidemark.llm")
from tidemark.llm import html  # noqa: E402

S = "A sentence of an article that is long enough to count as prose in this page, really."
PROSE = f"<p>{S} {S}</p><p>{S}</p>"
WANT = f"{S} {S}\n\n{S}"


@pytest.mark.parametrize("page", [
    f"<body><form action=x><input type=hidden value=1><div>{PROSE}<input><select><option>o</select><button>Go</button></div></form></body>",
    f"<body><form>{PROSE}</form><div class=footer>{S}</div></body>",
    f"<body><article class='post has-comments'>{PROSE}</article><div>About us, all rights reserved</div></body>",
    f"<body><article class='article reply-open'>{PROSE}</article><div>foot</div></body>",
    f"<body><article class='has-comments'>{PROSE}</article><div>foot</div></body>",
    f"<body><main id='content' class='no-comments'>{PROSE}</main><div>foot</div></body>",
    f"<body><div aria-hidden=true id=page>{PROSE}</div><div role=dialog>Accept cookies please</div></body>",
    f"<body><div class='wrapper has-comments'><article>{PROSE}</article><div class=comments><article class=comment><p>{S * 5}</p></article></div></div></body>",
    f"<body><main><article class=post>{PROSE}</article><section id=comments><ol class=comment-list><li class=comment><article class=comment-body>"
    f"<p>COMMENT {S * 5}</p></article></li></ol><form class=comment-form><label>Name</label><input><p>Leave a reply</p><button>Post</button></form></section></main></body>",
    f"<body><nav><div class=ad>x<div class=share>y</div></div></nav><article>{PROSE}<form><label>Mail</label><input><button>Subscribe</button></form></article></body>",
])
def test_the_article_stays(page):
    assert html.main_text(page) == WANT


def test_controls_in_a_sentence_keep_their_words():
    page = f"<body><article><p>Press <button>OK</button> to go. {S}</p><button>Share</button><p>Let <math><mi>x</mi></math> be one.</p></article></body>"
    assert html.main_text(page) == f"Press OK to go. {S}\n\nLet x be one."


def test_many_removed_siblings_take_linear_time():
    begin = time.process_time()
    assert html.main_text(f"<body><div>{PROSE}" + "<div class=ad>buy</div>" * 50_000 + "</div></body>") == WANT
    assert time.process_time() - begin < 5


def density(node, share):
    """Composite text density by its formula, from the page's own strings and tags."""
    def count(n, linked):
        chars = tags = link_chars = link_tags = 0
        for c in n.children:
            if isinstance(c, str):
                k = len(c.replace(" ", ""))
                chars += k
                link_chars += k * linked
            else:
                a, b, d, e = count(c, linked or c.name == "a")
                chars, tags, link_chars, link_tags = chars + a, tags + b + 1, link_chars + d, link_tags + e + (linked or c.name == "a")
        return chars, tags, link_chars, link_tags

    c, t, lc, lt = count(node, node.name == "a")
    if not c:
        return 0.0
    t, one, lt = max(1, t), max(1, lc), max(1, lt)
    return c / t * max(0.0, math.log(max(1.0, c / one * t / lt))) / math.log(c / max(1, c - lc) * lc + share * c + math.e)


def test_densities_of_random_trees():
    rng = random.Random(5)

    def grow(depth):
        out = ""
        for _ in range(rng.randrange(1, 5)):
            kind = rng.random()
            if kind < 0.4 or depth > 5:
                out += "".join(rng.choice(["word ", "longer ", "x "]) for _ in range(rng.randrange(1, 12)))
            elif kind < 0.55:
                out += f"<a href=x>{'link ' * rng.randrange(1, 4)}</a>"
            else:
                out += f"<div>{grow(depth + 1)}</div>"
        return out

    for _ in range(60):
        body = html.parsed(f"<body>{grow(0)}</body>").children[0]
        nodes = html._ordered(body)
        html._measured(nodes)
        html._densities(nodes, body)
        share = body.link_chars / max(1, body.chars)
        for x in nodes:
            assert math.isclose(x.density, density(x, share), abs_tol=1e-9)
            assert math.isclose(x.total, sum(density(c, share) for c in x.children if not isinstance(c, str)), abs_tol=1e-9)
