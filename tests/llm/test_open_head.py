"""Pages that leave out the optional end tag of their head."""

import pytest

from askbase.llm import extract

HEAD = "<!doctype html><html><head><meta charset=utf-8><title>Title</title><style>p {}</style><script>x = 1</script>"


@pytest.mark.parametrize("page, text", [
    (HEAD + "<body><p>First.<p>Second.", ["First.", "Second."]),
    (HEAD + "<article><p>First.</p><p>Second.</p></article>", ["First.", "Second."]),
    (HEAD + "<p>First.</p></head><p>Second.</p>", ["First.", "Second."]),
    (HEAD + "First. <b>Second.</b>", ["First. Second."]),
    (HEAD + "<noscript><p>None</p></noscript><body><p>First.</p>", ["First."]),
    (HEAD + "<noscript><img src=x><body><p>First.</p>", ["First."]),
    (HEAD + "<template><p>None</p></template><link rel=x><p>First.</p>", ["First."]),
    (HEAD + "</head><body><p>First.</p>", ["First."]),
])
def test_head_without_end_tag(page, text):
    assert extract.main_lines(extract.lines_of(page), set()) == text
