"""Queries on Markdown: every line of every document as a piece of Markdown of one of six kinds, by its place."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions.let import let
from tessella.operators import markdown
from tessella.plans import tables as t
from tessella.plans.registry import query

def planted(spark, sf_dir):
    docs = t.dealt(t.table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", 500)
    words = lambda x: F.trim(F.concat(F.lit("w "), F.trim(F.regexp_replace(x, "[^A-Za-z]+", " "))))

    def piece(line, i):
        # one form is made of each line, of words that are found once
        kind = lambda k: i % 6 == k
        return let(words(line), lambda x: (
            F.when(kind(0), F.concat(F.lit("# "), x))
            .when(kind(1), F.concat(F.lit("- "), x, F.lit("\n- **"), x, F.lit("** `a<b`\n    1. in\n- out")))
            .when(kind(2), F.concat(F.lit("> "), x, F.lit("\nlazy & _on_")))
            .when(kind(3), F.concat(F.lit("```py\n# "), x, F.lit("\n\n- x\n```")))
            .when(kind(4), F.concat(F.lit("| a | b |\n|---|:-:|\n| "), x, F.lit(" | *c* |")))
            .otherwise(F.concat(x, F.lit('\nsecond *line* [to](http://e.org/a_b_c) <script>no</script> <b onclick="x">yes</b>')))
        ))

    return docs.withColumn("text", F.array_join(F.transform(F.split("text", "\n"), piece), "\n\n"))


# the lines of each document in order, cleaned alike
LINES = """ls AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL),
xs AS (SELECT doc_id, i, i % 6 AS k, trim('w ' || trim(regexp_replace(raw, '[^A-Za-z]+', ' ', 'g'))) AS x FROM ls),
slugs AS (SELECT *, replace(lower(x), ' ', '-') AS slug, row_number() OVER (PARTITION BY doc_id, k, lower(x) ORDER BY i) - 1 AS again FROM xs)"""

HTML = """htmls AS (SELECT doc_id, i, CASE k
  WHEN 0 THEN '<h1 id="' || slug || CASE WHEN again > 0 THEN '_' || again ELSE '' END || '">' || x || '</h1>'
  WHEN 1 THEN concat_ws(chr(10), '<ul>', '<li>' || x || '</li>', '<li><strong>' || x || '</strong> <code>a&lt;b</code>', '<ol>', '<li>in</li>', '</ol>', '</li>', '<li>out</li>', '</ul>')
  WHEN 2 THEN concat_ws(chr(10), '<blockquote>', '<p>' || x || '<br>', 'lazy &amp; <em>on</em></p>', '</blockquote>')
  WHEN 3 THEN concat_ws(chr(10), '<pre><code class="language-py"># ' || x, '', '- x', '</code></pre>')
  WHEN 4 THEN concat_ws(chr(10), '<table>', '<thead>', '<tr>', '<th>a</th>', '<th>b</th>', '</tr>', '</thead>', '<tbody>', '<tr>', '<td>' || x || '</td>', '<td><em>c</em></td>', '</tr>', '</tbody>', '</table>')
  ELSE concat_ws(chr(10), '<p>' || x || '<br>', 'second <em>line</em> <a href="http://e.org/a_b_c" rel="nofollow" target="_blank">to</a> no <b>yes</b></p>') END AS h FROM slugs)"""


@query("SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(a.html, '') END AS html, CASE WHEN d.text IS NULL THEN 'no input' END AS error FROM documents d LEFT JOIN (SELECT doc_id, string_agg(h, chr(10) ORDER BY i) AS html FROM htmls GROUP BY doc_id) a USING (doc_id)", using=(LINES, HTML))
def markdown_html(spark, sf_dir):
    return markdown.rendered(planted(spark, sf_dir), key="doc_id", text="text", most_chars=None)


@query("SELECT doc_id, CASE k WHEN 0 THEN 'heading' WHEN 1 THEN 'list' WHEN 3 THEN 'fence' WHEN 4 THEN 'table' ELSE 'paragraph' END AS kind, count(*) AS n, count(*) FILTER (WHERE k = 2) AS quoted FROM xs GROUP BY 1, 2", using=(LINES,))
def markdown_blocks(spark, sf_dir):
    found = markdown.blocks(planted(spark, sf_dir), key="doc_id", text="text")
    return found.groupBy(F.col("key").alias("doc_id"), "kind").agg(F.count("*").alias("n"), F.count_if(F.col("depth") > 0).alias("quoted"))
