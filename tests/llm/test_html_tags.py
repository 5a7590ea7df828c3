"""Tags with attributes of any length and number, and what decides without an article."""

import pytest

from quillstone.llm import html_text

TEXT = "the cat is on the mat and the dog is in the house with a bone " * 2


@pytest.mark.parametrize("size", [10, 9_000, 300_000])
def test_long_values_give_no_text(size):
    page = f"<article><p title=\"a>b {'x' * size}\">{TEXT}</p><p data-x='</p>{'y > ' * size}'>Three words more.</p></article>"
    assert html_text.main_text(page) == f"{TEXT.strip()}\nThree words more."


@pytest.mark.parametrize("number", [3, 450, 20_000])
def test_many_attributes_give_no_text(number):
    attributes = " ".join(f'a{i}="v>{i}"' for i in range(number))
    assert html_text.main_text(f"<article><p {attributes}>{TEXT}</p></article>") == TEXT.strip()


def test_quotes_count_only_as_values():
    assert html_text.main_text(f"<article><p don't>{TEXT}</p><p x=it's>{TEXT}</p><b y = 'c>d' e>{TEXT}</b></article>") == f"{TEXT.strip()}\n{TEXT.strip()}\n{TEXT.strip()}"


def test_unclosed_quote_ends_at_the_next_bracket():
    assert html_text.main_text(f"<article><p title='open>{TEXT}</p><p>{TEXT}</p></article>") == f"{TEXT.strip()}\n{TEXT.strip()}"


def test_headings_stay_whatever_their_class():
    page = f'<article><h1 class="article-header">Title here</h1><p>{TEXT}</p><div class="article-header">Menu and more</div></article>'
    assert html_text.main_text(page) == f"Title here\n{TEXT.strip()}"


def test_short_page_without_article():
    assert html_text.main_text("<p>Short para.</p>") == "Short para."
    assert html_text.main_text("<nav>Home</nav><p>Short para.</p><footer>End</footer>") == "Short para."


@pytest.mark.parametrize("page", ['<a x="1" ' * 50_000, '<a x=">" ' * 50_000, "<a x='1>" * 50_000, "<a x=" + " " * 100_000 + ">", "<a " + "= " * 100_000 + ">"])
def test_linear_time(page):
    import time

    began = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - began < 3
