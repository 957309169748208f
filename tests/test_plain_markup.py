"""Plain pages go a short way round the parser, with the same result; details of a register are read once."""

import random
from html.parser import HTMLParser

import pytest

from annalist.functions import kernels, markup

PIECES = ['<p>', '</p>', '<div class="main x">', '</div>', '<a href="x.pdf" title="t">', '</a>', '<br>', '<br/>', 'text', 'a &amp; b', '&lt', '<', '<!-- c -->', '>', ' \n', '<script>', '</script>', '<title>', '<A HREF="z">', '<a href=x>', '<p class="a>b">', '</p >', '<a  href="v" >', '<a href="&amp;">', '<p', '<a x>']


def calls(base):
    class Calls(base):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.made = []

        def handle_starttag(self, tag, attrs):
            self.made.append((tag, attrs))

        def handle_endtag(self, tag):
            self.made.append(tag)

        def handle_data(self, data):
            self.made.append((data,))

    return Calls()


def test_the_short_way_makes_the_same_calls():
    rng = random.Random(4)
    for _ in range(3000):
        html, made = "".join(rng.choices(PIECES, k=rng.randrange(12))), []
        for base in (HTMLParser, kernels.Markup):
            parser = calls(base)
            parser.feed(html)
            parser.close()
            made.append(parser.made)
        assert made[0] == made[1], html


def test_plain_pages_are_not_parsed_and_only_once_read(monkeypatch):
    fed = []
    short = kernels.Markup.feed
    monkeypatch.setattr(HTMLParser, "feed", lambda self, data: pytest.fail("parsed"))
    monkeypatch.setattr(kernels.Markup, "feed", lambda self, data: (fed.append(data), short(self, data)))
    assert kernels.article('<body><div class="main">A</div><div class="main">B</div></body>', [("class", "main")]) == "A\nB"
    assert len(fed) == 1


def test_links_that_need_no_resolving():
    page = '<a href="a.pdf#x">1</a><a href="b/c.PDF">2</a><a href="../d.pdf">3</a><a href="e//f.pdf">4</a><a href="?g.pdf">5</a><a href="h.p\ndf">6</a><a href="#">7</a>'
    for url, base in (("https://x.example/k/i.html", "https://x.example/k/"), ("https://x.example/k/?q=i.html", "https://x.example/k/")):
        assert markup.linked_files(page, url) == sorted([base + "a.pdf", base + "b/c.PDF", "https://x.example/d.pdf", base + "e/f.pdf", base + "h.pdf"])
    assert markup.linked_files("<a href='#'>7</a>", "https://x.example/k.pdf") == ["https://x.example/k.pdf"]
    assert markup._folder("https://x.example/k/i.html") == "https://x.example/k/" and markup._folder("https://u@x.example/k/") is None


def test_rows_that_look_alike_keep_their_own_files():
    row = '<tr data-chiave-allegato="k"><td>Atto</td><td>t</td><td><a title="Download versione non firmata" onclick="go(atob(\'{}\'))"></a></td></tr>'
    fields = "".join(f'<tr class="ap-{k}"><td>x</td><td>{v}</td></tr>' for k, v in (("annoRegistro", 2026), ("numeroRegistro", 1), ("categoria", "c"), ("oggetto", "o")))
    html = f'<table data-id-pubblicazione="7">{fields}{row.format("aHR0cHM6Ly9hLzE=")}{row.format("aHR0cHM6Ly9hLzI=")}</table>'
    assert [a["url"] for a in markup.register_detail(html)["attachments"]] == ["https://a/1", "https://a/2"]
