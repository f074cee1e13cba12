"""Main text by tag-path ratios: what decides, and what doesn't."""

import html.parser
import random

import numpy as np
import pytest

from weftline.llm import pagetext

P = "This is a paragraph of the article, with some words, and more of them. It goes on for a while; it ends here."
LINKS = "<ul>" + "".join(f"<li><a href='/{i}'>Topic number {i}</a></li>" for i in range(8)) + "</ul>"
TOPICS = "\n".join(f"Topic number {i}" for i in range(8))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<nav><a>x</a></nav><div class='page with-sidebar'><article><h1>T</h1><p>{P}</p></article></div>", f"T\n{P}"),
        (f"<article class='post-share-count-3'><h1>T</h1><p>{P}</p></article>", f"T\n{P}"),
        (f"<article><h1>T</h1><section class='legal'><p>{P}</p><p>{P}</p></section></article>", f"T\n{P}\n{P}"),
        (f"<body class='nav'><main class='menu'><h1>T</h1><p>{P}</p></main></body>", f"T\n{P}"),
        (f"<article><h1>T</h1><p>{P}</p><section id='comments'><article class='comment'><p>{P}</p><p>{P}</p></article></section></article>", f"T\n{P}"),
        (f"<article><h1>T</h1><p>{P}</p><div class='ad-slot-3'>{P}</div><aside>{P}</aside><form>{P}</form><p hidden>{P}</p><div role='search'>x</div></article>", f"T\n{P}"),
        (f"<main><h1>T</h1><p>{P}</p><ul><li>First thing to do</li><li>Second thing</li></ul><p>{P}</p><blockquote>Short quote</blockquote></main>", f"T\n{P}\nFirst thing to do\nSecond thing\n{P}\nShort quote"),
        (f"<main><p>{P}</p><table><tr><th>Name</th><th>Size</th></tr><tr><td>Ab</td><td>12</td></tr></table><p>{P}</p></main>", f"{P}\nName\nSize\nAb\n12\n{P}"),
        ("<div class='ad'>Buy this great thing now, please.</div><article><h1>A long title of a page with little text</h1><p>Sh is.</p></article>", "A long title of a page with little text\nSh is."),
        ("<nav>a</nav><footer>b</footer><div class='cookie-notice'>c</div>", ""),
    ],
)
def test_pages(page, want):
    assert pagetext.main_text(page) == want


@pytest.mark.parametrize("container", ["main", "article", "div"])
def test_ratios_decide(container, monkeypatch):
    """Unmarked links and text beside the article go by weight alone: with the ratios switched off they stay."""
    named = container != "div"
    page = "<div><a>Home</a> <a>News</a></div>" * named + f"<{container}><h1>T</h1><p>{P}</p><p>{P}</p>{LINKS}<p>{P}</p></{container}>" + "<div>Buy one, get one free.</div>" * named
    assert pagetext.main_text(page) == f"T\n{P}\n{P}\n{P}"
    monkeypatch.setattr(pagetext, "THRESHOLD", 0)
    assert pagetext.main_text(page) == "Home News\n" * named + f"T\n{P}\n{P}\n{TOPICS}\n{P}" + "\nBuy one, get one free." * named


def test_a_link_in_the_text_is_text():
    assert pagetext.main_text(f"<main><p>{P}</p><p><a>Read the whole report</a></p><p>{P}</p></main>") == f"{P}\nRead the whole report\n{P}"


class Plain(html.parser.HTMLParser):
    """Blocks of well-formed pages of div, ul, li, p, h2 and a: (text, path, characters in links)."""

    def __init__(self, page):
        super().__init__()
        self.stack, self.blocks, self.now = [], [], []
        self.feed(page)
        self.end()

    def end(self):
        text = " ".join("".join(t for t, _ in self.now).split())
        if text:
            linked = len(" ".join("".join(t for t, link in self.now if link).split()))
            path = "/" + "/".join(t for t in self.stack if t != "a") + "/a" * (2 * linked >= len(text))
            self.blocks.append((text, path, len(text) - linked + pagetext.LINK * linked))
        self.now = []

    def handle_starttag(self, tag, attrs):
        if tag != "a":
            self.end()
        self.stack.append(tag)

    def handle_endtag(self, tag):
        if tag != "a":
            self.end()
        self.stack.pop()

    def handle_data(self, data):
        self.now.append((data, "a" in self.stack))


def plain_text(page):
    found = Plain(page).blocks
    paths = list(dict.fromkeys(p for _, p, _ in found))
    inside = {p: "article" in p.split("/") for p in paths}

    def smooth(values):
        out = []
        for i in range(len(values)):
            near = [(k, values[i + d]) for d, k in zip(range(-2, 3), pagetext.KERNEL, strict=True) if 0 <= i + d < len(values)]
            out.append(sum(k * v for k, v in near) / sum(k for k, _ in near))
        return out

    weight = dict.fromkeys(paths, 1.0)
    for measure, more in ((lambda b: b[2], 0), (lambda b: sum(c in ".,;:!?" for c in b[0]), 1)):
        own = {p: np.mean([measure(b) for b in found if b[1] == p]) for p in paths}
        row = smooth([own[b[1]] for b in found])
        for p in paths:
            weight[p] *= ((own[p] + more) * (np.mean([v for v, b in zip(row, found, strict=True) if b[1] == p]) + more)) ** 0.5
    for p in paths:
        if any(inside.values()) and not inside[p]:
            weight[p] *= pagetext.OUTSIDE_SHARE
    heading = lambda p: p.removesuffix("/a").split("/")[-1] == "h2"
    body = [b for b in found if not heading(b[1])] or found
    mean = sum(weight[b[1]] * b[2] for b in body) / sum(b[2] for b in body)
    content = {p for p in paths if weight[p] >= pagetext.THRESHOLD * mean}
    parents = {p.rsplit("/", 1)[0] for p in content}
    return "\n".join(t for t, p, _ in found if p in content or heading(p) and p.rsplit("/", 1)[0] in parents)


def test_text_equals_plain_one():
    rnd = random.Random(7)
    words = lambda n: " ".join(rnd.choice(("word", "and", "more,", "it.", "so", "longerword;")) for _ in range(n))

    def part(depth):
        kind = rnd.choice(("p", "p", "p", "h2", "ul", "links", "div", "div"))
        if kind == "ul":
            return "<ul>" + "".join(f"<li>{words(rnd.randint(1, 8))}</li>" for _ in range(rnd.randint(1, 6))) + "</ul>"
        if kind == "links":
            return "<ul>" + "".join(f"<li><a>{words(rnd.randint(1, 3))}</a>{words(rnd.randint(0, 1))}</li>" for _ in range(rnd.randint(1, 9))) + "</ul>"
        if kind == "div":
            return f"<div>{words(rnd.randint(0, 4))}{''.join(part(depth + 1) for _ in range(rnd.randint(1, 4)))}</div>" if depth < 3 else "<p>x</p>"
        return f"<{kind}>{words(rnd.randint(1, 60 if kind == 'p' else 6))}</{kind}>"

    dropped = 0
    for k in range(300):
        body = "".join(part(0) for _ in range(rnd.randint(1, 8)))
        page = f"{part(0)}<article>{body}</article>{part(0)}" if k % 2 else body
        assert pagetext.main_text(page) == plain_text(page), page
        dropped += len(pagetext.main_text(page).split("\n")) < len(Plain(page).blocks)
    assert dropped > 100
