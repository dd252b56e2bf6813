"""Pages made around a known article: broken markup, wrappers and boilerplate; and points by their definition."""

import random

import pytest

from tamis.llm import htmltext
from tamis.llm.htmltext import main_text

LONG = "Some text of a paragraph, with commas, and words enough to score. " * 5
BODY = f"<p>{LONG}</p>" * 4
WHOLE = "\n\n".join([LONG.strip()] * 4)


@pytest.mark.parametrize(
    "page",
    [
        f"<body><form id=aspnetForm><div>{BODY}</div><input name=q><label>Name</label><button>Go</button></form></body>",
        f"<body><div>{BODY}</div><form><p>Subscribe here, and now, to our letter of the week, please.</p></form></body>",
        f"<body><canvas>{BODY}</body>",
        f"<body><svg><path d='M0'>{BODY}</body>",
        f"<body><script>var a = '<b>';<div>{BODY}</div></body>",
        f"<html><head><title>Name of the page</head><body>{BODY}</body></html>",
        f"<head>{BODY}",
        f"<body><div class='layout sidebar-left'>{BODY}</div><div class='sidebar-left'><p>A teaser, of some length, beside it all.</p></div></body>",
        f"<body><div class='content-ad-free'>{BODY}</div></body>",
        f"<body><div class='no-sidebar'>{BODY}</div><div class=sidebar><p>A teaser, of some length, beside it all.</p></div></body>",
        "<div>" * 3000 + BODY + "</div>" * 3000,
        "<canvas>" * 3000 + BODY,
    ],
)
def test_article_survives(page):
    assert main_text(page) == WHOLE


BOILER = [
    "<nav><ul><li><a href=/>Home</a></li><li><a href=/b>News</a></li></ul></nav>",
    "<div class='cookie-notice'><p>We use cookies, and more cookies, to make this page better for you.</p></div>",
    "<aside><p>Other stories, which are not this one, to read after it.</p></aside>",
    "<section class=comments><h3>Comments</h3><article><p>I read it all, and I agree, with every word of this.</p></article></section>",
    "<footer><p>All rights reserved, by the people, who wrote this page.</p></footer>",
    "<form action=/s><input name=q><p>Type your address, and press the button, to get letters.</p><button>Send</button></form>",
    "<script>if (a < b) { c('</div>') }</script>",
    "<div class=ad-box><p>Buy this thing, it is cheap, and everybody has one of these.</p></div>",
]


@pytest.mark.parametrize("seed", range(40))
def test_generated_pages(seed):
    rng = random.Random(seed)
    blocks, inner = [], ""
    for _ in range(rng.randint(4, 12)):
        text = " ".join(rng.choice(["word", "other,", "thing", "where", "long,"]) for _ in range(rng.randint(40, 90)))
        tag = "h2" if rng.random() < 0.2 else "p"
        text = text[:50].strip() if tag == "h2" else text
        blocks.append(text)
        inner += f"<{tag}>{text}</{tag}>\n"
    for _ in range(rng.randint(0, 4)):
        inner = rng.choice(["<div>{}</div>", "<div class='page-body'>{}</div>", "<section>{}</section>", "<form>{}</form>", "<div class='grid sidebar-right'>{}</div>"]).format(inner)
    inner = rng.choice(["<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>"]).format(inner)
    around = rng.sample(BOILER, rng.randint(0, len(BOILER)))
    cut = rng.randint(0, len(around))
    assert main_text("<html><body>" + "".join(around[:cut]) + inner + "".join(around[cut:]) + "</body></html>") == "\n\n".join(blocks)


@pytest.mark.parametrize("seed", range(20))
def test_points_by_definition(seed):
    rng = random.Random(seed)

    def tree(depth):
        if depth > 6 or rng.random() < 0.3:
            return f"<p>{'Words, and more, ' * rng.randint(1, 30)}</p>"
        return "<div>" + "".join(tree(depth + 1) for _ in range(rng.randint(1, 3))) + "</div>"

    nodes, blocks = htmltext.blocks_of("<body>" + "".join(tree(0) for _ in range(3)) + "</body>")
    want: dict[int, float] = {}
    for node, text, _ in blocks:
        if len(text) >= 25:
            points, at, k = 1 + text.count(",") + min(len(text) // 100, 3), node.up, 0
            while at:
                want[id(at)] = want.get(id(at), 0.0) + points / 2**k
                at, k = at.up, k + 1
    got = htmltext.scores(nodes, blocks)
    assert set(got) == set(want)
    for k, x in got.items():
        assert x.score == pytest.approx(want[k] + htmltext.BASE.get(x.tag, 0))
