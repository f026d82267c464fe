import random

from llm.helpers import rows_of
from simloom.llm.html_text import extract, main_blocks, main_text

LONG = "the cat and the dog were in the house with all of their friends from the town and " * 3


def test_article_without_its_surroundings():
    page = f"""<!DOCTYPE html><html><head><title>Title</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a></li></ul></nav><!-- note --><div class="ad">Buy the best of it.</div>
    <div class="cookie-notice"><p>{LONG}</p></div>
    <main><article><h1>A  story</h1><p><b>First</b> &amp; <a href="x">linked</a>
    line.<br><p>{LONG}</p><p>Short.</p><aside><p>{LONG}</p></aside><form><label>Mail</label><button>Go</button></form>
    <section class="comments"><p>{LONG}</p></section></article></main><div id="sidebar">{LONG}</div><footer>&copy; 2020 {LONG}</footer></body></html>"""
    assert main_text(page) == "\n\n".join(["A story", "First & linked line.", LONG.strip(), "Short."])


def test_inline_and_nested_parts_outside():
    page = f"""<article class="post has-comments"><p>{LONG} <span class="ad">Buy now!</span> and <span style="display: none">hidden</span>more</p>
    <div class="alert">{LONG}</div><article class="comment"><p>{LONG}</p></article></article><article class="teaser"><p>{LONG}</p></article>"""
    assert main_text(page) == " ".join(f"{LONG} and more".split())


def test_layout_names_are_no_veto():
    story = f"<h1>A story</h1><p>{LONG}</p><p>Short.</p>"
    wanted = "\n\n".join(["A story", LONG.strip(), "Short."])
    for wrapper in ("class='page no-sidebar'", "id='content' class='has-sidebar'", "class='with-footer'", "class='sidebar'", "class='menu'"):
        assert main_text(f"<div {wrapper}><article>{story}</article></div>") == wanted
        assert main_text(f"<div {wrapper}><main>{story}</main></div>") == wanted
    assert main_text(f"<div id='content' class='has-sidebar'>{story}</div>") == wanted
    assert main_text(f"<article><div class='entry-header'><h1>A story</h1></div><div class='with-footer'><p>{LONG}</p></div></article>") == "\n\n".join(["A story", LONG.strip()])
    rest = "<div class='site-footer'>All rights reserved</div><div class='share-buttons'>Tell friends</div><div class='menu'><nav><article>Home</article></nav></div>"
    assert main_text(f"<article>{story}{rest}</article>{rest}<div class='comments'><article><p>{LONG}</p></article></div>") == wanted


def test_density_decides_without_an_article():
    menu = "".join(f'<li><a href="/{k}">Section number {k} of many</a></li>' for k in range(8))
    page = f"<body><ul>{menu}</ul><div><p>Small start.</p><p>{LONG}</p><p>Small end.</p></div><div>zzz qqq xxx {'kkk ' * 60}</div></body>"
    assert main_text(page) == "\n\n".join(["Small start.", LONG.strip(), "Small end.".strip()])
    assert [b.label for b in main_blocks(page)][:8] == [False] * 8


def test_open_blocks_take_the_nearest_label():
    page = f"<body><div><p><a href='/'>{LONG}</a></p><p>near links</p><p>middle</p><p>near text</p><p>{LONG}</p></div></body>"
    assert [b.label for b in main_blocks(page)] == [False, False, True, True, True]


def test_damaged_markup():
    assert main_text("<article><p>a &am b &amp c<p>d < e<b>f</article><p>") == "a &am b & c\n\nd < ef"
    assert main_text("<article><p>one<!-- never closed <p>two") == "one"
    assert main_text("<article><script>if (a</b) {") == ""
    assert main_text("<article>one</nav></div> two<p class='x\" y'>three &#x41;&eacute;&nbsp;z</article>") == "one\n\ntwo\n\nthree Aé z"
    assert main_text("<article><p>text <img alt='a > b' src=x> more<p hidden>no</p></article>") == "text more"


def test_table(spark):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, "u", f"<article><p>{LONG}</article>", "x"), (3, "v", "<p>" * 20_000 + LONG, "x"), (3, "v", "<p>" * 20_000 + LONG, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    n = len(LONG.strip())
    wanted = [(None, "u", LONG.strip(), n), (1, "u", "", 0), (2, None, "", 0), (3, "v", LONG.strip(), n), (3, "v", LONG.strip(), n)]
    assert rows_of(extract(pages), "page_id", "url", "text", "n_chars") == wanted
    assert extract(pages.where("false")).collect() == []


def test_no_text_is_lost_for_its_language_or_its_numbers():
    assert main_text("<div id=content><h1>A title</h1><p>Short text here.</p></div>") == "A title\n\nShort text here."
    russian = "Это первое предложение текста. Это второе предложение, немного длиннее. Третье предложение идёт следом. Четвёртое предложение кончает этот абзац."
    assert main_text(f"<div>{russian}</div>") == russian
    weights = ", ".join(f"{k}.{k % 10} kg" for k in range(10, 60))
    assert main_text(f"<div><p>{LONG}</p><p>{weights}</p><p>{LONG}</p></div>") == f"{LONG.strip()}\n\n{weights}\n\n{LONG.strip()}"
    assert main_text("<p>日本語の短い文</p>") == "日本語の短い文" and main_text("<nav>Home</nav><footer>(c)</footer>") == ""


def test_planted_articles_come_back_whole():
    """Pages put together at random from article blocks and parts outside; only the article's blocks, in order, may come back."""
    rnd = random.Random(12)
    words = "the of and in house river stone walked green with for cloud from paper is".split()
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n)).capitalize() + "."
    outside = [
        lambda: f"<nav><ul>{''.join(f'<li><a href=/{k}>{prose(2)}</a></li>' for k in range(4))}</ul></nav>",
        lambda: f"<aside><p>{prose(40)}</p></aside>",
        lambda: f"<div class='cookie-notice'>{prose(60)}</div>",
        lambda: f"<form><label>{prose(3)}</label><input name=q><p>{prose(30)}</p></form>",
        lambda: f"<script>var x = '<p>{prose(40)}</p>';</script><style>p {{ color: red }}</style>",
        lambda: f"<section class=comments><article class=comment><p>{prose(50)}</p></article></section>",
        lambda: f"<!-- <p>{prose(40)}</p> --><div hidden>{prose(50)}</div>",
    ]
    for _ in range(150):
        blocks, parts = [], []
        for _ in range(rnd.randint(1, 8)):
            text = prose(rnd.choice([1, 3, 30, 80, 300]))
            tag = rnd.choice(["p", "h2", "blockquote", "li", "td"])
            spaced = text.replace(" ", rnd.choice([" ", "\n  ", "&#32;"]), 3)
            parts.append({"li": f"<ul><li>{spaced}</ul>", "td": f"<table><tr><td>{spaced}</table>"}.get(tag, f"<{tag}>{spaced}</{tag}>"))
            blocks.append(text)
            if rnd.random() < 0.3:
                parts.append(rnd.choice(outside)())
        page = "".join(rnd.choice(outside)() for _ in range(2)) + f"<{(kind := rnd.choice(['article', 'main']))}>{''.join(parts)}</{kind}>" + "".join(rnd.choice(outside)() for _ in range(2))
        assert main_text(f"<html><body>{page}<footer>{prose(40)}</footer></body></html>") == "\n\n".join(blocks)
