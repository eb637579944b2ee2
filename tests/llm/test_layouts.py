"""Pages whose wrappers are named after what lies beside them."""

import pytest

from pitchlake.llm import html_text

ARTICLE = "<h1>Title</h1>" + "<p>A sentence of the article with some length to it.</p>" * 6
WANT = "Title " + " ".join(["A sentence of the article with some length to it."] * 6)


@pytest.mark.parametrize("wrapper", ['class="page right-sidebar"', 'id="page" class="content-sidebar-wrap"', 'class="row social-science"', 'class="public-notice-board"', 'class="search-results-page two-menus"'])
@pytest.mark.parametrize("inner", ["{}", "<article>{}</article>", "<div class=post>{}</div>"])
def test_layout_classes_keep_the_article(wrapper, inner):
    side = '<div class="right-sidebar-box"><p>Something beside the text.</p></div><div class="cookie-notice">We use cookies</div>'
    page = f"<body><div {wrapper}>{side}<div id=body>{inner.format(ARTICLE)}</div></div><div class=comments><p>I say this and that, at great length, and more of it still.</p></div></body>"
    assert html_text.main_text(page) == WANT


def test_parts_stay_dropped():
    page = f'<body><div class="main-wrap">{ARTICLE}</div><div class="left-sidebar"><p>Beside the text, and a good deal of it.</p></div><div class="user-comments">{"<p>Mine is a long comment on all of it.</p>" * 40}</div></body>'
    assert html_text.main_text(page) == WANT
    assert html_text.main_text(f'<body><div class="sidebar">{ARTICLE}</div></body>') == ""
