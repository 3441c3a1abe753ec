"""Page text: one rule for hosts of any size, and importance before stated roles."""

import random

import pytest

from patchloom.llm import html_text

SIZES = (1, 2, 5, 29, 30, 60)


def article(rng, n=60):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))


def texts(spark, pages):
    rows = [(i, f"http://{host}/{i}", source) for i, (host, source, _) in enumerate(pages)]
    found = {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    return [found[i] for i in range(len(pages))]


@pytest.mark.parametrize("name", ["blog-widget", "share related", "notice", "promo", "social-search-ad"])
def test_a_role_word_does_not_remove_an_article(spark, name):
    rng = random.Random(1)
    pages = []
    for m in SIZES:
        for _ in range(m):
            text = article(rng)
            hard = "" if "search" in name else "<div class=comments>first!</div>"
            pages.append((f"h{m}", f"<html><body><div class=menu><a>Home</a> <a>All posts</a></div><div class='{name.replace('search', 'sidebar')}'><p>{text}</p></div>{hard}<div class=footer>Imprint</div></body></html>", text))
    assert texts(spark, pages) == [text for *_, text in pages]


def test_roles_remove_what_differs_between_pages(spark):
    rng = random.Random(2)
    pages = []
    for m in SIZES:
        for _ in range(m):
            text = article(rng)
            pages.append((f"h{m}", f"<html><body><nav><a>Home</a></nav><div class=text><p>{text}</p></div><div class=related>{article(rng, 8)}</div><div role=navigation>{article(rng, 3)}</div></body></html>", text))
    assert texts(spark, pages) == [text for *_, text in pages]


def test_what_pages_share_goes_whatever_its_name(spark):
    rng = random.Random(3)
    pages = []
    for m in (5, 29, 30, 60):
        for _ in range(m):
            text = article(rng)
            pages.append((f"h{m}", f"<html><body><div class=top><p>All our pages in one line</p></div><div class=text><p>{text}</p></div></body></html>", text))
    assert texts(spark, pages) == [text for *_, text in pages]


def test_main_part_of_a_page_alone(spark):
    text = "One two three four five six seven"
    pages = [("a", f"<body><div>Welcome</div><main><p>{text}</p></main></body>", text), ("b", f"<body><p>{text}</p><main>x</main></body>", f"{text}\nx")]
    assert texts(spark, pages) == [text for *_, text in pages]
