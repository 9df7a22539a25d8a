"""Markdown: blocks and marks against exact HTML, and what must not get through."""

import pytest

from tessella.operators import markdown

CASES = {
    "empty": ("", ""),
    "heading and marks": ("# A b\n\n**bold** and *stressed*, __so__ and _so_, a_b_c", '<h1 id="a-b">A b</h1>\n<p><strong>bold</strong> and <em>stressed</em>, <strong>so</strong> and <em>so</em>, a_b_c</p>'),
    "same headings": ("# A\n\n## A\n\nA\n===\nx", '<h1 id="a">A</h1>\n<h2 id="a_1">A</h2>\n<h1 id="a_2">A</h1>\n<p>x</p>'),
    "fence": ("```py\nif a < b:\n\n# no heading\n```", '<pre><code class="language-py">if a &lt; b:\n\n# no heading\n</code></pre>'),
    "fence in a fence": ("~~~\n```\nx\n```\n~~~", "<pre><code>```\nx\n```\n</code></pre>"),
    "unclosed fence": ("~~~\nx", "<p>~~~<br>\nx</p>"),
    "nested list": ("- a\n    1. b\n- c", "<ul>\n<li>a\n<ol>\n<li>b</li>\n</ol>\n</li>\n<li>c</li>\n</ul>"),
    "two kinds of list": ("- a\n\n1. b", "<ul>\n<li>a</li>\n</ul>\n<ol>\n<li>b</li>\n</ol>"),
    "no list within a paragraph": ("x\n- y", "<p>x<br>\n- y</p>"),
    "quotes": ("> a\nb\n\n> > c", "<blockquote>\n<p>a<br>\nb</p>\n<blockquote>\n<p>c</p>\n</blockquote>\n</blockquote>"),
    "table": ("a | b\n--|--\n`c` | d\\|e", "<table>\n<thead>\n<tr>\n<th>a</th>\n<th>b</th>\n</tr>\n</thead>\n<tbody>\n<tr>\n<td><code>c</code></td>\n<td>d|e</td>\n</tr>\n</tbody>\n</table>"),
    "rule and code": ("---\n\n    x  <y>", "<hr>\n<pre><code>x  &lt;y&gt;\n</code></pre>"),
    "entities": ("a & b &amp; c < d", "<p>a &amp; b &amp; c &lt; d</p>"),
    "script": ('<script>alert(1)</script>\n\n**safe**\n<img src=x onerror="alert(1)">', '<p>alert(1)</p>\n<p><strong>safe</strong><br>\n<img src="x"></p>'),
    "schemes": ("[x](javascript:a) [y](javascript&#58;a) <a href='JaVa\tscript:a'>z</a>", "<p><a>x</a> <a>y</a> <a>z</a></p>"),
    "quotes in titles": ('[x](u "a<b")', '<p><a href="u" title="a&lt;b" rel="nofollow" target="_blank">x</a></p>'),
    "marks in code and links": ("`**a**` [*b*](c_d_e)", '<p><code>**a**</code> <a href="c_d_e" rel="nofollow" target="_blank"><em>b</em></a></p>'),
}


@pytest.fixture(scope="module")
def html(spark):
    texts = spark.createDataFrame([(k, v[0]) for k, v in CASES.items()] + [("null", None), ("long", "x" * (markdown.MOST_CHARS + 1)), ("many lines", "a\n\n" * 20000)], "name string, text string")
    return {r.name: (r.html, r.error) for r in markdown.rendered(texts, key="name", text="text").collect()}


@pytest.mark.parametrize("name", CASES)
def test_html(html, name):
    assert html[name] == (CASES[name][1], None)


def test_edges(spark, html):
    assert html["null"] == (None, "no input") and html["long"] == (None, "input too long")
    assert html["many lines"][0] == "\n".join(["<p>a</p>"] * 20000)
    none = spark.createDataFrame([], "name string, text string")
    assert markdown.rendered(none, key="name", text="text").count() == 0
    kinds = {r.kind for r in markdown.blocks(markdown.sample(spark), key="name", text="text").collect()}
    assert kinds == {"heading", "paragraph", "table", "list", "fence", "rule"}
