"""Main text of pages of many layouts against texts written by hand."""

import pytest

from pagewright.llm import html_tree

NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/a">About us</a></li></ul></nav>'
END = "<footer>&copy; 2020 Somebody. All rights reserved.</footer>"
LAYOUTS = {
    "glossary": (
        "<article><h1>Terms</h1><dl><dt>Shuffle<dd>Rows move between tasks.<dt>Task<dd>Work on one partition.</dl></article>",
        "Terms Shuffle Rows move between tasks. Task Work on one partition.",
    ),
    "links": (
        "<article><h1>Reading list</h1><ul>" + "".join(f'<li><a href="/{i}">Part number {i}</a></li>' for i in range(8)) + "</ul></article>",
        "Reading list " + " ".join(f"Part number {i}" for i in range(8)),
    ),
    "empty comment": ("<article><!--><p>The first text stays here.</p><!-- gone --><p>And the second one.</p></article>", "The first text stays here. And the second one."),
    "own footer": (
        "<article><h1>Title of it</h1><p>The article has a paragraph of its own.</p><footer>Filed under news, by staff.</footer></article>",
        "Title of it The article has a paragraph of its own.",
    ),
    "noscript": (
        "<article><p>The article has a paragraph of its own.</p><noscript><p>The figures as plain text, 3 and 4.</p></noscript></article>",
        "The article has a paragraph of its own. The figures as plain text, 3 and 4.",
    ),
    "listing": ("<article><h1>How to</h1><pre><code>a = 1\nb = 2</code></pre></article>", "How to a = 1 b = 2"),
    "figure": (
        "<main><h1>Walls</h1><figure><img src=x><figcaption>A wall of stone.</figcaption></figure><p>Walls are old, and some are long.</p></main>",
        "Walls A wall of stone. Walls are old, and some are long.",
    ),
    "details": (
        "<article><h1>Questions</h1><details><summary>Why so slow?</summary><p>It reads all rows, each time.</p></details></article>",
        "Questions Why so slow? It reads all rows, each time.",
    ),
    "table": (
        "<article><h1>Heights</h1><table><thead><tr><th>Name</th><th>m</th></tr></thead><tbody><tr><td>Hill</td><td>90</td></tr></tbody></table></article>",
        "Heights Name m Hill 90",
    ),
    "content box": (
        '<div class="sidebar"><h3>More</h3><ul><li><a href="/x">Other thing</a></li></ul></div><div class="post-content"><h1>On rain</h1>'
        '<p>It rains, and then it stops again.</p><div class="ad">Buy now.</div><p>So it goes.</p></div><div id="comments"><p>I like rain.</p></div>',
        "On rain It rains, and then it stops again. So it goes.",
    ),
    "article header": (
        "<article><header><h1>Long walks</h1></header><p>They take a day, or two days.</p></article><aside><h3>Related</h3><p>Short walks.</p></aside>",
        "Long walks They take a day, or two days.",
    ),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layout(name):
    body, wanted = LAYOUTS[name]
    page = f"<!DOCTYPE html><html><head><title>T</title></head><body>{NAV}<noscript>Please switch scripts on.</noscript>{body}{END}</body></html>"
    assert html_tree.main_texts([page], html_tree.train()) == [wanted]


def test_weights_are_fitted_once():
    assert html_tree.train() is html_tree.train()


@pytest.mark.parametrize("comment", ["<!-->", "<!--->", "<!---->", "<!-- a -->", "<!-- a --!>", "<!-- > -->"])
def test_comments_end_where_html_ends_them(comment):
    page = html_tree.Page(f"<p>a{comment}b</p>")
    assert [text for _, text in page.blocks()] == ["ab"]
