import pytest

from pagewright.operators.chunking import chunk_markdown
from pagewright.operators.markdown import parse_blocks

#: Markdown and its blocks as (tag, first line, last line), after the block examples of the CommonMark specification.
CASES = [
    ("Intro:\n| a | b |\n| --- | --- |\n| 1 | 2 |\nmore | x\n\nend", ["p 0 0", "table 1 4", "p 6 6"]),
    ("<custom-el>\n# not heading\n</custom-el>\n\ntext", ["html 0 2", "p 4 4"]),
    ("text\n<custom-el>\nmore", ["p 0 2"]),
    ("<?php\n\necho 1;\n\n?>\nafter", ["html 0 4", "p 5 5"]),
    ('[a]: /url\n  "title"\n\n[a]', ["p 3 3"]),
    ('[a]: /url\n"title" ok\n', ["p 1 1"]),
    ("[a]: /url\n===\n[a]", ["p 1 2"]),
    ("[foo]: /url\n\"title\n\nwith blank\"\n\n[foo]", ["p 1 1", "p 3 3", "p 5 5"]),
    ("Foo\nbar\n===", ["h1 0 2"]),
    ("Foo\n---\nbar", ["h2 0 1", "p 2 2"]),
    ("> foo\n---", ["blockquote 0 0", "hr 1 1"]),
    ("> foo\nbar\n===", ["blockquote 0 2"]),
    ("> foo\n\n> bar", ["blockquote 0 0", "blockquote 2 2"]),
    ("> ```\nfoo\n```", ["blockquote 0 0", "p 1 1", "code 2 2"]),
    ("> - foo\n- bar", ["blockquote 0 0", "ul 1 1"]),
    (">     code\n\n>    not code", ["blockquote 0 0", "blockquote 2 2"]),
    ("- foo\n***\n- bar", ["ul 0 0", "hr 1 1", "ul 2 2"]),
    ("* Foo\n* * *\n* Bar", ["ul 0 0", "hr 1 1", "ul 2 2"]),
    ("- a\n\n  b\n\n\n  c\nlazy\n\nout", ["ul 0 6", "p 8 8"]),
    ("- one\n\n two", ["ul 0 0", "p 2 2"]),
    ("1.  A\n\n        code\n\n    > q\n\nx", ["ol 0 4", "p 6 6"]),
    ("-\n\n  foo", ["ul 0 0", "p 2 2"]),
    ("- foo\n-\n- bar", ["ul 0 2"]),
    ("foo\n*\n\nfoo\n1.", ["p 0 1", "p 3 4"]),
    ("The number is\n14.  doors", ["p 0 1"]),
    ("The number is\n1.  doors", ["p 0 0", "ol 1 1"]),
    ("- a\n- b\n+ c\n1. d\n2) e", ["ul 0 1", "ul 2 2", "ol 3 3", "ol 4 4"]),
    ("- a\n > b\n ```\n c\n ```\n- d", ["ul 0 0", "blockquote 1 1", "code 2 4", "ul 5 5"]),
    ("- a\n  > b\n  ```\n  c\n\n  ```\n- d", ["ul 0 6"]),
    ("    a\n\n    b\nc", ["code 0 2", "p 3 3"]),
    ("Foo\n    bar", ["p 0 1"]),
    ("```\naaa\n~~~\n\n```\nx", ["code 0 4", "p 5 5"]),
    ("~~~~ruby startline=3 $%@#$\ndef\n~~~~~~~", ["code 0 2"]),
    ("``` aa ```\naaa", ["p 0 1"]),
    ("foo\n```\nbar\n```\nbaz", ["p 0 0", "code 1 3", "p 4 4"]),
    ("<div>\n*foo*\n\n*bar*\n</div>", ["html 0 1", "p 3 3", "html 4 4"]),
    ("<!-- a\n\nb -->\nok", ["html 0 2", "p 3 3"]),
    ("<![CDATA[\n\n]]>\nok", ["html 0 2", "p 3 3"]),
    ("<!DOCTYPE html>\nok", ["html 0 0", "p 1 1"]),
    ("<pre><code>\n\nx</code></pre>\nok", ["html 0 2", "p 3 3"]),
    ("# a #\n## b\n####### c\n#d", ["h1 0 0", "h2 1 1", "p 2 3"]),
    ("aaa\n             bbb\n", ["p 0 1"]),
    ("- foo\n\n\tbar", ["ul 0 2"]),
    (">\t\tfoo", ["blockquote 0 0"]),
    ("| a |\n| - | - |", ["p 0 1"]),
    ("a | b\n-- | -\n> q", ["table 0 1", "blockquote 2 2"]),
    ("a | b\n- | -\n> q", ["p 0 0", "ul 1 1", "blockquote 2 2"]),
]


@pytest.mark.parametrize("markdown,want", CASES)
def test_blocks(markdown, want):
    lines, at, got = markdown.split("\n"), 0, []
    for b in parse_blocks(markdown):
        n = b.source.count("\n") + 1
        first = next(i for i in range(at, len(lines)) if "\n".join(lines[i : i + n]).rstrip() == b.source)
        at = first + n
        got.append(f"{b.tag} {first} {at - 1}")
    assert got == want


def test_text_after_a_tag_is_kept():
    assert "# not heading" in chunk_markdown("<custom-el>\n# not heading\n</custom-el>")[0][0]


def test_headings():
    assert [(b.level, b.heading) for b in parse_blocks("# a #\n## b\n###\n#### #\nx\ny\n===\n")] == [(1, "a"), (2, "b"), (3, ""), (4, ""), (1, "x\ny")]
