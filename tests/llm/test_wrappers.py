"""Pages whose text lies in boxes named like something else."""

import pytest

from quillgrid.llm import html_text

P = "<p>A paragraph of the article, with words enough to be worth reading, number {}.</p>"
TEXT = "\n".join(P[3:-4].format(k) for k in range(4))
BODY = "".join(P.format(k) for k in range(4))
BLOCKS = "".join(f'<div class="elementor-element elementor-widget elementor-widget-text-editor">{P.format(k)}</div>' for k in range(4))


@pytest.mark.parametrize("page", [
    f'<div class="content has-sidebar">{BODY}</div><div class=sidebar><a href=x>Other</a></div>',
    f'<div class="main-content no-sidebar">{BODY}</div><footer>us</footer>', f'<div class="entry">{BLOCKS}</div>',
    f'<article>{BLOCKS}</article>', f'<form id=aspnetForm><div class="site-footer">us</div><div>{BODY}</div></form>',
    f'<div class="page-header">{BODY}</div><nav>menu</nav>',
    f'<main>{"".join(f"<article>{P.format(k)}</article>" for k in range(4))}</main>'])
def test_wrappers_and_blocks_stay(page):
    assert html_text.main_text(f"<html><body>{page}</body></html>") == TEXT


def test_comments_longer_than_the_article_go():
    page = f"<div class=content><h1>T</h1>{BODY}</div><div class=comments>{BODY * 2}</div>"
    assert html_text.main_text(page) == "T\n" + TEXT
