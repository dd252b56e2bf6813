"""What lies beside the best container of a page: kept unless it is navigation."""

import pytest

from tamis.llm.htmltext import main_text

LONG = "Some text of a paragraph, with commas, and words enough to score. " * 5
BODY = f"<p>{LONG}</p>" * 12
BESIDE = [
    (f"<article><h1>Title</h1><div class=body>{BODY}</div></article>", ["Title"]),
    (f"<article><header><h1><a href=/>Title</a></h1></header><div>{BODY}</div></article>", ["Title"]),
    (f"<main><section>{BODY}</section><section><h2>End</h2><p>A short closing section of one line.</p></section></main>", ["End", "A short closing section of one line."]),
    (f"<main><h1>Title</h1><ul><li>point</li></ul><div>{BODY}</div><table><tr><td>cell</td></tr></table><pre>code</pre><blockquote>quote</blockquote></main>", ["Title", "point", "cell", "code", "quote"]),
    (f"<body><div><h1>Title</h1></div><div><div>{BODY}</div><ul><li>note</li></ul></div></body>", ["Title", "note"]),
    (f"<body><h1>Title</h1><article>Lead<div>{BODY}</div></article></body>", ["Title", "Lead"]),
    (f"<main><nav>Home</nav><div>{BODY}</div><ul><li><a href=a>one more</a></li><li><a href=b>two more</a></li></ul><div class=related>other</div><footer>foot</footer></main><p><a href=c>outside</a></p>", []),
]


@pytest.mark.parametrize("page, beside", BESIDE)
def test_beside(page, beside):
    texts = main_text(page).split("\n\n")
    assert [t for t in texts if t != LONG.strip()] == beside and texts.count(LONG.strip()) == 12
