"""Only furniture is dropped: what stands beside the best container stays."""

import random
import re

import pytest

from tallyglass.llm.html_main import extract_main, main_text

LONG = [f"Paragraph {i} of the story, which is long enough, and has commas, to score well." for i in range(10)]
DIV = "<div>" + "".join(f"<p>{p}</p>" for p in LONG) + "</div>"


def test_title_and_lead_beside_the_best_container():
    page = f"<body><article><h1>T</h1><p>lead</p>{DIV}<p>end</p></article></body>"
    assert main_text(page) == "\n".join(["T", "lead", *LONG, "end"])


def test_short_section_and_outer_blocks():
    page = f"<body><main><h1><a href=/>Linked title</a></h1><article><section>{DIV}</section><section><h2>More</h2><p>short</p></section></article></main></body>"
    assert main_text(page) == "\n".join(["Linked title", *LONG, "More", "short"])


def test_lists_of_links_and_furniture_still_go():
    links = "<ul><li><a href=/a>One page</a></li><li><a href=/b>Another page</a></li></ul>"
    page = f"<body><nav>menu</nav>{links}<p><a href=/>Home</a> | <a href=/x>About us</a></p><article><p>lead with <a href=/y>a link</a> in it</p>{DIV}</article><div class=sidebar>ad</div><footer>f</footer></body>"
    assert main_text(page) == "\n".join(["lead with a link in it", *LONG])


@pytest.mark.parametrize("word", "related-work market-share search-results social-history toc side alert foot notice-of-decision header recommendations".split())
@pytest.mark.parametrize("key", ["id", "class"])
def test_no_word_empties_a_page(word, key):
    page = f"<body><nav><a href=/>Home</a></nav><p>By one author</p><div {key}={word}><h1>Title</h1>{DIV}</div><footer>f</footer></body>"
    assert main_text(page) == "\n".join(["By one author", "Title", *LONG])
    nested = f"<body><div class=widget><div {key}={word}>{DIV}<div class=comments><p>{' '.join(LONG)}</p></div></div></div></body>"
    assert main_text(nested) == "\n".join(LONG)


def test_suspects_go_beside_an_article():
    page = f"<body><header><p>Site</p></header><div class=cookie-notice><p>{LONG[0]}</p></div><article>{DIV}</article><div id=comments><p>{' '.join(LONG * 20)}</p></div><form><p>Search</p></form></body>"
    assert main_text(page) == "\n".join(LONG)
    assert main_text(f"<body><form id=aspnet>{DIV}<p>Name: <input></p></form></body>") == "\n".join([*LONG, "Name:"])
    assert main_text(f"<div class=has-comments><h1>T</h1>{DIV}</div>") == "\n".join(["T", *LONG])


@pytest.mark.parametrize("depth", [3, 9, 400])
def test_far_end_tags(depth):
    page = f'<p><b class="ad">' + "<div>" * depth + f"</p><article>{DIV}</article>"
    assert main_text(page) == "\n".join(LONG)


def test_inline_adverts_leave_a_paragraph_whole():
    assert main_text(f"<article>{DIV}<p>one <span class=ad>buy</span> two</p></article>").endswith("\none two")


def plain_walk(node, out):
    """Blocks of a tree of (name, attrs, children) without furniture, from the definition."""
    name, attrs, children = node
    if name in ("nav", "footer", "aside", "script", "form") or "ad" in attrs or "comments" in attrs:
        return
    if name in ("p", "h1", "h2", "li"):
        text = re.sub(r"\s+", " ", "".join(c if isinstance(c, str) else "".join(c[2]) for c in children)).strip()
        if text:
            out.append(text)
        return
    for c in children:
        plain_walk(c, out)


def page_tree(r):
    text = lambda n: " ".join(r.choice(["lorem,", "ipsum", "dolor", "sit\n amet", "magna"]) for _ in range(n))
    block = lambda: (r.choice(["p", "p", "p", "h2", "li"]), "", [text(r.randint(8, 60)), ("b", "", [text(2)]), text(3)])
    furniture = lambda: r.choice([("nav", "", [("li", "", [text(2)])]), ("div", ' class="ad"', [("p", "", [text(12)])]), ("aside", "", [("p", "", [text(30)])]), ("div", " id=comments", [("p", "", [text(90)])]), ("form", "", [("p", "", [text(3)])])])

    def part(depth):
        return [part_of(depth) for _ in range(r.randint(1, 4))]

    def part_of(depth):
        if r.random() < 0.15:
            return furniture()
        return ("div", "", part(depth - 1)) if depth and r.random() < 0.4 else ("section", "", part(depth - 1)) if depth and r.random() < 0.2 else block()

    return ("body", "", [furniture(), ("article", "", [("h1", "", [text(4)]), *(block() for _ in range(4)), *part(3)]), furniture(), ("footer", "", [("p", "", [text(10)])])])


def written(node):
    return node if isinstance(node, str) else f"<{node[0]}{node[1]}>" + "".join(map(written, node[2])) + f"</{node[0]}>"


def test_like_a_plain_walk_of_generated_pages(spark):
    r = random.Random(8)
    rows, want = [], []
    for i in range(300):
        tree = page_tree(r)
        blocks = []
        plain_walk(tree, blocks)
        want.append("\n".join(blocks))
        rows.append((i, None, written(tree), 1, 2))
    got = extract_main(spark.createDataFrame([*rows, rows[0], (None, "u", "<p>x" * 50_000, 1, 2)], "page_id long, url string, html string, text int, n_chars int")).collect()
    texts = {x.page_id: x.text for x in got}
    assert len(got) == 302 and [texts[i] for i in range(300)] == want and texts[None] == "\n".join(["x"] * 50_000)
