"""Queries over files, lines, statements and small text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from addonscope.functions import pytext
from addonscope.functions import text as T
from addonscope.operators import graph, python_source, search
from addonscope.sources import corpus as sources
from workload.expected import PARTS, PY
from workload.registry import Corpus, query, spread


def _document_files(c: Corpus):
    """Documents as files with Windows paths and mixed endings."""
    ending = F.element_at(
        F.array(*[F.lit(e) for e in (".PY", ".xml", ".Csv", ".po", ".txt", "")]),
        (F.length("text") % 6 + 1).cast("int"),
    )
    return c.table("documents").select(
        F.col("source").alias("repo"),
        F.concat("lang", F.lit("\\sub/doc_"), F.col("doc_id").cast("string"), ending).alias("path"),
        F.col("text").alias("content"),
    )


_DOC_PATH = """
  SELECT source AS repo, text AS content, doc_id,
         lang || '/sub/doc_' || CAST(doc_id AS STRING) AS stem,
         CASE length(text) % 6 WHEN 0 THEN '.PY' WHEN 1 THEN '.xml' WHEN 2 THEN '.Csv'
              WHEN 3 THEN '.po' WHEN 4 THEN '.txt' ELSE '' END AS ending
  FROM documents
"""


@query("classify_files", f"""
  SELECT repo, stem || ending AS path, replace(stem, lang_dir, '') || ending AS name,
         CASE lower(ending) WHEN '.py' THEN 'python' WHEN '.xml' THEN 'xml' WHEN '.csv' THEN 'csv'
              WHEN '.po' THEN 'po' ELSE 'other' END AS type,
         strlen(content) AS size
  FROM (SELECT *, regexp_extract(stem, '^.*/') AS lang_dir FROM ({_DOC_PATH}) q)
""")
def classify_files(c: Corpus):
    return sources.classify(_document_files(c)).drop("content")


@query("unique_files", f"""
  SELECT DISTINCT repo, stem || ending AS path FROM ({_DOC_PATH}) q
""")
def unique_files(c: Corpus):
    files = _document_files(c)
    return sources.unique_files(sources.classify(files.unionByName(files))).select("repo", "path")


@query("path_parts", """
  SELECT page_id, regexp_replace(url, '/[^/]*$', '') AS dir, regexp_extract(url, '[^/]*$') AS base,
         lower(CASE WHEN regexp_extract(url, '[^/]*$') LIKE '%.%'
                    THEN regexp_extract(url, '[^./]*$') ELSE '' END) AS ext
  FROM pages
""")
def path_parts(c: Corpus):
    url = F.col("url")
    return c.table("pages").select(
        "page_id",
        T.dir_name(url).alias("dir"),
        T.base_name(url).alias("base"),
        T.extension(url).alias("ext"),
    )


@query("lines", """
  SELECT repo, doc_id, CAST(generate_subscripts(ls, 1) AS INTEGER) AS line_no, unnest(ls) AS text
  FROM (SELECT source AS repo, doc_id, string_split_regex(text, '\\r?\\n') AS ls
        FROM documents WHERE length(text) > 0) q
""")
def lines(c: Corpus):
    files = c.table("documents").select(
        F.col("source").alias("repo"), F.col("doc_id").alias("path"),
        F.col("text").alias("content"),
    )
    return python_source.explode_lines(files).select(
        "repo", F.col("path").alias("doc_id"), "line_no", "text"
    )


@query("indent", f"""
  WITH {PY}
  SELECT repo, path, line AS line_no,
         CAST(length(replace(regexp_extract(text, '^[ \\t]*'), chr(9), '    ')) AS INTEGER)
           AS indent
  FROM py
""")
def indent(c: Corpus):
    files = c.files.where("type = 'python' AND path LIKE '%/models/%'")
    return python_source.explode_lines(files).select("repo", "path", "line_no", "indent")


# Statements worked out again in SQL: docstrings by quote parity, strings and
# comments cut out, then the running bracket depth.
_STATEMENTS = f"""
  WITH {PY},
  l0 AS (SELECT *, (length(text) - length(replace(text, '\"\"\"', ''))) / 3 AS marks FROM py),
  l1 AS (SELECT *, coalesce(sum(marks) OVER (PARTITION BY path ORDER BY line
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS in_doc FROM l0),
  l2 AS (SELECT *, CASE WHEN in_doc THEN ''
                   ELSE regexp_replace(regexp_replace(text, '\"\"\".*$', 'S'),
                          '"[^"]*"|''[^'']*''|#.*$', 'S', 'g') END AS bare FROM l1),
  l3 AS (SELECT *, length(regexp_replace(bare, '[^(\\[{{]', '', 'g'))
                 - length(regexp_replace(bare, '[^)\\]}}]', '', 'g')) AS delta FROM l2),
  l4 AS (SELECT *, coalesce(sum(delta) OVER (PARTITION BY path ORDER BY line
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS depth FROM l3),
  l5 AS (SELECT *, NOT in_doc AND depth = 0 AND trim(text) <> '' AND trim(text) NOT LIKE '#%'
                   AS starts FROM l4),
  l6 AS (SELECT *, CASE WHEN starts OR in_doc OR depth > 0 THEN
                   max(CASE WHEN starts THEN line END) OVER (PARTITION BY path ORDER BY line) END
                   AS stmt FROM l5)
  SELECT repo, path, stmt AS line, max(line) AS end_line, min(depth) AS depth,
         string_agg(text, chr(10) ORDER BY line) AS text
  FROM l6 WHERE stmt IS NOT NULL GROUP BY ALL
"""


@query("statements", _STATEMENTS)
def statements(c: Corpus):
    files = c.files.where("type = 'python' AND path LIKE '%/models/%'")
    rows = python_source.statement_lines(python_source.lexed_lines(files))
    return (
        rows.where("stmt IS NOT NULL")
        .groupBy("repo", "path", F.col("stmt").alias("line"))
        .agg(
            F.max("line_no").alias("end_line"),
            F.min("depth").cast("decimal(38,0)").alias("depth"),
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]
                ),
                "\n",
            ).alias("text"),
        )
    )


@query("import_style", f"""
  WITH {PARTS}
  SELECT repo, mod || '/models/m_' || CAST(k AS STRING) || '.py' AS path,
         CASE WHEN z % 10 = 0 THEN 'old' ELSE 'new' END AS style FROM pt
""")
def import_style(c: Corpus):
    return c.files.where("type = 'python' AND path LIKE '%/models/%'").select(
        "repo", "path", python_source.import_style(F.col("content")).alias("style")
    )


# Arguments written from the columns of an order line.
_ARGS = [
    "'o", "l_orderkey", "', x=[", "l_linenumber", ", (", "l_suppkey", ", 2)], fn=lambda a, b: a, s=\"",
    "l_returnflag", ",)\", {'k': ", "l_partkey", "}",
]
_ARG_COLUMNS = {"l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_partkey"}


def _args_column():
    return F.concat(*[
        F.col(p).cast("string") if p in _ARG_COLUMNS else F.lit(p) for p in _ARGS
    ])


@query("split_args", """
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, 5 AS n,
         'x=[' || CAST(l_linenumber AS STRING) || ', (' || CAST(l_suppkey AS STRING) || ', 2)]'
           AS second,
         l_returnflag || ',)' AS s_value, 'string' AS s_kind,
         'o' || CAST(l_orderkey AS STRING) AS first_value,
         '{''k'': ' || CAST(l_partkey AS STRING) || '}' AS last_value, 'raw' AS last_kind,
         'lambda a, b: a' AS fn
  FROM lineitem
""")
def split_args(c: Corpus):
    code = _args_column()
    rows = (
        spread(c.table("lineitem"))
        .withColumn("code", code)
        .withColumn("masked", pytext.mask_source(F.col("code")))
        .withColumn("pieces", pytext.split_args(F.col("code"), F.col("masked")))
        .withColumn("kw", pytext.keyword_args(F.col("pieces")))
        .withColumn("pos", pytext.positional_args(F.col("pieces")))
    )
    last = F.element_at("pos", -1)
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag",
        F.size("pieces").alias("n"),
        pytext.strip(F.element_at("pieces", 2)["code"]).alias("second"),
        F.element_at("kw", "s")["text"].alias("s_value"),
        F.element_at("kw", "s")["kind"].alias("s_kind"),
        F.element_at("pos", 1)["text"].alias("first_value"),
        last["text"].alias("last_value"),
        last["kind"].alias("last_kind"),
        F.element_at("kw", "fn")["text"].alias("fn"),
    )


@query("literals", """
  SELECT event_id,
         CASE event_type WHEN 'click' THEN 'true' WHEN 'view' THEN 'none' WHEN 'error' THEN 'number'
              WHEN 'signup' THEN 'string' ELSE 'raw' END AS kind,
         CASE event_type WHEN 'click' THEN 'True' WHEN 'view' THEN NULL
              WHEN 'error' THEN '-1' || CAST(user_id AS STRING)
              WHEN 'signup' THEN 'it is ' || props ELSE 'f(' || CAST(user_id AS STRING) || ')' END
           AS text,
         CASE event_type WHEN 'click' THEN true WHEN 'view' THEN false ELSE NULL END AS flag
  FROM events
""")
def literals(c: Corpus):
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    source = (
        F.when(kind == "click", "  True ")
        .when(kind == "view", "None")
        .when(kind == "error", F.concat(F.lit("-1"), user))
        .when(kind == "signup", F.concat(F.lit("'it is "), "props", F.lit("'")))
        .otherwise(F.concat(F.lit("f("), user, F.lit(")")))
    )
    rows = c.table("events").withColumn("source", source).withColumn(
        "v", pytext.literal(F.col("source"))
    )
    return rows.select(
        "event_id", F.col("v.kind").alias("kind"), F.col("v.text").alias("text"),
        pytext.py_bool(F.col("source"), None).alias("flag"),
    )


@query("string_lists", """
  SELECT c_custkey, c_name || '|' || c_mktsegment AS items,
         CASE WHEN c_acctbal < 0 THEN c_name ELSE c_mktsegment END AS bare,
         c_mktsegment AS seg, CAST(c_nationkey AS STRING) AS nation, 'None' AS missing
  FROM customer
""")
def string_lists(c: Corpus):
    rows = c.table("customer")
    listed = F.concat(F.lit("['"), "c_name", F.lit("', \""), "c_mktsegment", F.lit('"]'))
    bare = F.when(
        F.col("c_acctbal") < 0, F.concat(F.lit(" '"), "c_name", F.lit("' "))
    ).otherwise(F.concat(F.lit('"'), "c_mktsegment", F.lit('"')))
    text = F.concat(
        F.lit("{'seg': '"), "c_mktsegment", F.lit("', \"nation\": "),
        F.col("c_nationkey").cast("string"), F.lit(", 'gone': None}"),
    )
    made = rows.withColumn("d", pytext.dict_literal(text, pytext.mask_source(text)))
    return made.select(
        "c_custkey",
        F.array_join(pytext.string_list(listed), "|").alias("items"),
        pytext.trim_quotes(bare).alias("bare"),
        F.element_at("d", "seg").alias("seg"),
        F.element_at("d", "nation").alias("nation"),
        F.coalesce(F.element_at("d", "gone"), F.lit("None")).alias("missing"),
    )


@query("csv_fields", """
  SELECT o_orderkey, 4 AS n, o_orderpriority || ', "' || o_orderstatus || '"' AS second,
         '' AS third, CAST(o_custkey AS STRING) AS fourth
  FROM orders
""")
def csv_fields(c: Corpus):
    row = F.concat(
        F.col("o_orderkey").cast("string"), F.lit(',"'), "o_orderpriority", F.lit(', ""'),
        "o_orderstatus", F.lit('""",,'), F.col("o_custkey").cast("string"),
    )
    return c.table("orders").withColumn("cells", T.csv_fields(row)).select(
        "o_orderkey",
        F.size("cells").alias("n"),
        F.element_at("cells", 2).alias("second"),
        F.element_at("cells", 3).alias("third"),
        F.element_at("cells", 4).alias("fourth"),
    )


@query("escape_html", """
  SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'),
           '>', '&gt;'), '"', '&quot;'), '''', '&#039;') AS escaped
  FROM pages
""")
def escape_html(c: Corpus):
    return c.table("pages").select("page_id", T.escape_html(F.col("html")).alias("escaped"))


@query("diagram_labels", """
  SELECT page_id,
         CASE WHEN safe = '' THEN '""'
              WHEN regexp_matches(safe, '[#;:&<>!@%^~`\\\\\\s]') THEN '"' || safe || '"'
              ELSE safe END AS label
  FROM (SELECT page_id, translate(regexp_extract(html, '<title>(.*?)</title>', 1),
                                  '()[]{}"|', '❨❩⦋⦌❴❵''¦') AS safe FROM pages) q
""")
def diagram_labels(c: Corpus):
    title = F.regexp_extract("html", "<title>(.*?)</title>", 1)
    return c.table("pages").select("page_id", T.diagram_label(title).alias("label"))


@query("document_search", """
  SELECT d.doc_id, b.item_id
  FROM documents d JOIN benchmark b
    ON contains(lower(d.text), lower(split_part(b.text, ' ', 1) || ' ' || split_part(b.text, ' ', 2)))
  WHERE b.item_id = (SELECT min(item_id) FROM benchmark)
""")
def document_search(c: Corpus):
    """Free-text search with the opening words of the first benchmark item."""
    item = c.table("benchmark").orderBy("item_id").limit(1).first()
    phrase = " ".join(item["text"].split(" ")[:2])
    return c.table("documents").where(search.mentions(phrase, "text")).select(
        "doc_id", F.lit(item["item_id"]).alias("item_id")
    )


@query("file_tree", f"""
  WITH {PARTS},
  f AS (SELECT repo, mod || '/models/m_' || CAST(k AS STRING) || '.py' AS path FROM pt
        UNION SELECT repo, mod || '/views/m_' || CAST(k AS STRING) || '.xml' FROM pt
        UNION SELECT repo, mod || '/security/access_' || CAST(k AS STRING) || '.csv' FROM pt)
  SELECT repo, path AS node, regexp_replace(path, '/[^/]*$', '') AS parent,
         regexp_extract(path, '[^/]*$') AS name, 4 AS depth, true AS is_file FROM f
  UNION ALL
  SELECT DISTINCT repo, regexp_replace(path, '/[^/]*$', ''),
         regexp_replace(path, '/[^/]*/[^/]*$', ''), split_part(path, '/', 3), 3, false FROM f
  UNION ALL
  SELECT DISTINCT repo, regexp_replace(path, '/[^/]*/[^/]*$', ''), 'addons',
         split_part(path, '/', 2), 2, false FROM f
  UNION ALL
  SELECT DISTINCT repo, 'addons', '', 'addons', 1, false FROM f
""")
def file_tree(c: Corpus):
    return graph.file_tree(c.files.where("type IN ('python', 'xml', 'csv') AND name LIKE '%\\_%' "
                                         "AND name NOT LIKE '\\_\\_%'"))
