"""Names of classes and ids that mark boilerplate, and those that only look like it."""

from __future__ import annotations

import pytest

from folioflow.llm.html_extract import main_text

BODY = "<p>The river rose in the night.</p><p>By noon it had fallen.</p>"
TEXT = "The river rose in the night.\nBy noon it had fallen."


@pytest.mark.parametrize("name", "post-comments article-comments entry-comments show-comments page-header page-footer theme-sidebar post-share article-ads entry-related commentsSection CommentThread comments__thread comments siteHeader".split())
@pytest.mark.parametrize("attribute", ["class", "id"])
def test_marked_parts_go(name, attribute):
    part = f'<div {attribute}="{name}"><p>Not of the page.</p></div>'
    assert main_text(f"<body><article><h1>Flood</h1>{BODY}{part}</article></body>") == "Flood\n" + TEXT
    assert main_text(f"<body><div>{BODY}</div>{part}</body>") == TEXT


@pytest.mark.parametrize("name", ["has-sidebar", "no-comments", "hide-comments", "withoutAds", "commentary", "shareholders", "threads"])
def test_states_and_other_words_stay(name):
    assert main_text(f'<article><div class="{name}">{BODY}</div><p>End.</p></article>') == TEXT + "\nEnd."


@pytest.mark.parametrize("name", ["discussion", "related", "share", "comment"])
def test_the_only_text_of_an_article_stays(name):
    for page in (f'<article><section id="{name}">{BODY}</section></article>', f'<div class="{name}"><article>{BODY}</article></div>', f'<main><div class="{name}">{BODY}</div></main>'):
        assert main_text(f"<body><nav>Home</nav>{page}<footer>f</footer></body>") == TEXT
    assert main_text(f'<article><h1>Flood</h1><div class="{name}">{BODY}</div><div class="comments"><p>Nice.</p></div></article>') == "Flood\n" + TEXT


def test_nothing_is_kept_for_want_of_text():
    assert main_text('<body><div class="comments"><p>Nice.</p></div></body>') == ""
    assert main_text('<article><div class="ads"><p>Buy.</p></div></article>') == ""
    assert main_text('<article><div class="comment" hidden><p>Nice.</p></div></article>') == ""
    assert main_text(f'<article>{BODY}<div class="comments">{"<p>Nice one, and long.</p>" * 90}</div></article>') == TEXT
