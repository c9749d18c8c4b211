"""Pages whose right text is known: short articles, class words within lines, furniture under other names, unclosed furniture."""

import pytest

from tallyglass.llm.html_main import main_text

LONG = [f"Paragraph {i} of the story, which is long enough, and has commas, to score well." for i in range(6)]
DIV = "<div>" + "".join(f"<p>{p}</p>" for p in LONG) + "</div>"
WORDY = " ".join(LONG * 3)


def test_class_words_within_a_line_say_nothing():
    page = '<p>The <em class="notice">important</em> word and <span class="side">left</span> and <b class="alert">stop</b>.</p>'
    assert main_text(page) == "The important word and left and stop."
    assert main_text('<article><p>one <span class="comment-count related">two</span> <i id="share">three</i> four</p></article>') == "one two three four"


@pytest.mark.parametrize("furniture", [
    f'<div class="cookie-notice"><p>{WORDY}</p></div>', f'<div class="ad"><p>{WORDY}</p></div>', f'<div class="ad">{WORDY}</div>', f"<form><p>{WORDY}</p><input></form>",
    f'<section id="discussion"><p>{WORDY}</p></section>', f'<div id="comments"><p>{WORDY}</p></div>', f'<div class="newsletter"><p>{WORDY}</p></div>', f"<header><p>{WORDY}</p></header>", f"<div><p>{WORDY}</p></div>",
])
@pytest.mark.parametrize("before", [True, False])
def test_short_articles_keep_no_furniture(furniture, before):
    if furniture.startswith("<div><p>"):
        furniture = furniture.replace("<div>", "<div class=rail>").replace(WORDY, "Most read. Weather: sunny.")
    article = "<article><h1>Short</h1><p>Only this.</p></article>"
    page = f"<body>{furniture + article if before else article + furniture}<footer>f</footer></body>"
    assert main_text(page) == "Short\nOnly this."
    assert main_text(page.replace("<article>", "<main>").replace("</article>", "</main>")) == "Short\nOnly this."


@pytest.mark.parametrize("word", ["ad", "cookie-banner", "newsletter", "comments", "discussion"])
def test_short_texts_without_an_article(word):
    assert main_text(f"<body><div class={word}><p>{WORDY}</p></div><p>The text itself.</p></body>") == "The text itself."


def test_a_sidebar_without_a_listed_class():
    assert main_text(f"<body><article><h1>T</h1>{DIV}</article><div class=rail><p>Most read today</p></div></body>") == "\n".join(["T", *LONG])
    assert main_text(f"<body><div>{DIV}</div><div class=rail><p>Most read today</p></div></body>") == "\n".join(LONG)
    two = f"<body><article><h2>A</h2>{DIV}</article><article><h2>B</h2><p>second</p></article><div>x</div></body>"
    assert main_text(two) == "\n".join(["A", *LONG, "B", "second"])


def test_siblings_without_an_article_stay_by_score_length_or_heading():
    page = f"<body><div>{DIV}</div><div><p>{LONG[0]} {LONG[1]}</p></div><div><h2>Part two</h2><p>short</p></div></body>"
    assert main_text(page) == "\n".join([*LONG, f"{LONG[0]} {LONG[1]}", "Part two", "short"])


def test_a_heading_in_the_only_suspect():
    assert main_text(f"<body><p>lead</p><div class=widget><h1>T</h1>{DIV}</div></body>") == "\n".join(["lead", "T", *LONG])
    assert main_text(f"<body><header><p>Site</p></header><div class=modal><main>{DIV}</main></div></body>") == "\n".join(LONG)


@pytest.mark.parametrize("end", ["", "</body></html>"])
def test_unclosed_furniture_hides_nothing_after_it(end):
    page = f"<html><body><nav><ul><li><a href=/>Home</a></li><li><a href=/b>About</a></li></ul><article><h1>T</h1>{DIV}</article>{end}"
    assert main_text(page) == "\n".join(["T", *LONG])
    assert main_text(f"<body><article>{DIV}</article><aside><p>not this</p></aside></body>") == "\n".join(LONG)
    assert main_text(f"<div><nav>menu</div><article>{DIV}</article>") == "\n".join(LONG)


def plain_scores(tree, path=()):
    """Points of every container of a tree of (name, children), summed over its blocks by distance."""
    found = {}

    def blocks(node, at, depth):
        for i, c in enumerate(node[1]):
            if isinstance(c, str):
                size = len(c)
                yield depth, min(1.0, size / 25) + c.count(",") + min(size / 100, 3.0)
            else:
                yield from blocks(c, (*at, i), depth + 1)

    def visit(node, at):
        found[at] = sum(p if d == 0 else p / (2 * d) for d, p in blocks(node, at, 0))
        for i, c in enumerate(node[1]):
            if not isinstance(c, str):
                visit(c, (*at, i))

    visit(tree, path)
    return found


def test_best_container_and_siblings_like_a_plain_scorer():
    import random

    r = random.Random(4)
    for _ in range(300):
        text = lambda: " ".join(r.choice(["lorem,", "ipsum", "dolor", "sit"]) for _ in range(r.randint(1, 30)))

        def part(depth):
            return ("div", [text() if not depth or r.random() < 0.5 else part(depth - 1) for _ in range(r.randint(1, 4))])

        tree = part(3)
        written = lambda n: f"<p>{n}</p>" if isinstance(n, str) else "<div>" + "".join(map(written, n[1])) + "</div>"
        scores = plain_scores(tree)
        best = max(scores, key=lambda p: (round(scores[p], 9), [-x for x in p], -len(p)))
        best = min((p for p in scores if abs(scores[p] - scores[best]) < 1e-9))

        def keep(node, at):
            out = []
            for i, c in enumerate(node[1]):
                if isinstance(c, str):
                    out.append(c)
                elif at[: len(best)] == best or (*at, i) == best[: len(at) + 1]:
                    out += keep(c, (*at, i))
                else:
                    below = everything(c)
                    if scores[*at, i] >= 0.2 * scores[best] or any(len(t) >= 80 for t in below):
                        out += below
            return out

        def everything(node):
            return [t for c in node[1] for t in ([c] if isinstance(c, str) else everything(c))]

        assert main_text(written(tree)) == "\n".join(keep(tree, ())), written(tree)
