"""Queries over files with classes within classes, and over XML with content inside its fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from addonscope.operators import entities, python_source, xml_records
from addonscope.sources.corpus import classify
from workload.corpus import SOURCE_SQL, derived_files, line, lines_sql
from workload.registry import Corpus, query, spread


def _class(indent: int, name: str, model: str, around: str, when: str = ""):
    """Header and name of a class; ``around`` names the classes it lies in, its own last."""
    pad = " " * indent
    return [
        line(f"{pad}class {name}{{k}}(models.Model):", when, kind="class", name=f"{name}{{k}}", a=model, b=around),
        line(f"{pad}    _name = '{model}'", when, b=around),
    ]


def _method(indent: int, name: str, model: str, around: str, body: str, when: str = ""):
    pad = " " * indent
    return [
        line(f"{pad}def {name}(self):", when, kind="method", name=name, a=model, b=around),
        line(f"{pad}    {body}", when, b=around, c=name),
    ]


# Three and four levels, members after each of them, a class inside a method.
_OUTER, _INNER, _DEEP, _LOWEST, _LOCAL = (f"nest.{n}.{{k}}" for n in ("outer", "inner", "deep", "lowest", "local"))
NESTED = [
    line("from odoo import models, fields"),
    line(""),
    *_class(0, "Outer", _OUTER, "o"),
    line("    first = fields.Char()", kind="field", name="first", a=_OUTER, b="o"),
    *_class(4, "Inner", _INNER, "oi"),
    *_method(8, "inner_one", _INNER, "oi", "return {z}"),
    *_class(8, "Deep", _DEEP, "oid", "z % 2 = 0"),
    *_method(12, "deep_one", _DEEP, "oid", "return [{z},", "z % 2 = 0"),
    line("  'out of line']", "z % 2 = 0", b="oid", c="deep_one"),
    *_class(12, "Lowest", _LOWEST, "oidl", "z % 4 = 0"),
    *_method(16, "lowest_one", _LOWEST, "oidl", "pass", "z % 4 = 0"),
    *_method(12, "deep_two", _DEEP, "oid", "return 2", "z % 2 = 0"),
    *_method(8, "inner_two", _INNER, "oi", "return 'two'", "z % 3 <> 0"),
    line("    # between"),
    line("    last = fields.Char()", "z % 5 <> 0", kind="field", name="last", a=_OUTER, b="o"),
    *_method(4, "outer_one", _OUTER, "o", "x = {z}", "z % 7 <> 0"),
    *_class(8, "Local", _LOCAL, "oc", "z % 7 IN (1, 2)"),
    *_method(12, "local_one", _LOCAL, "oc", "return self", "z % 7 IN (1, 2)"),
    line("        return x", "z % 7 <> 0", b="o", c="outer_one"),
    line(""),
    line("TOP = {z}"),
]

_VIEW = [
    line("<odoo>"),
    line("  <data>"),
    line('    <record id="v_{k}" model="ir.ui.view">'),
    line('      <field name="arch" type="xml"><tree><!-- no --><field name="a"/></tree></field>'),
    line('      <field name="name">View <b>of {z}</b> &lt;<![CDATA[<x> & {k}]]></field>'),
    line('      <field name="model" ref="m_{k}"/>'),
    line("    </record>"),
    line('    <record id="w_{k}" model="ir.ui.menu">', "z % 3 = 0", kind="bad"),
    line('      <field name="name">open', "z % 3 = 0"),
    line("    </record>", "z % 3 = 0", kind="wrong"),
    line("    </p>", "z % 4 = 0", kind="stray", name="</p> closes nothing"),
    line('    <record id="n_{k}" model="ir.ui.menu">', "z % 5 = 0", kind="endless"),
    line('    <record id="r_{k}" model="ir.rule">'),
    line('      <field name="name">Rule</field>'),
    line("    </record>"),
    line("    <template><div>", "z % 6 = 0", kind="stray", name="<div> is not closed"),
    line("    </template>", "z % 6 = 0"),
    line("    a < {z}", "z % 7 = 0", kind="stray", name="< does not begin a tag"),
    line("  </data>"),
    line("</odoo>", "z % 8 <> 0"),
]

FILES = {
    "nested": (SOURCE_SQL, "true", "{mod}/models/n_{k}.py", NESTED, "z % 13 = 0"),
    "views": (SOURCE_SQL, "true", "{mod}/views/n_{k}.xml", _VIEW, "false"),
}


def _items(c: Corpus):
    files = derived_files(c.spark, c.sf_dir, spread, {"nested": FILES["nested"]})
    return c.kept("nested", lambda: python_source.class_items(files.transform(classify)))


def _elements(c: Corpus):
    files = derived_files(c.spark, c.sf_dir, spread, {"views": FILES["views"]})
    return c.kept("views", lambda: xml_records.xml_elements(files.transform(classify)))


_NESTED = f"nl AS ({lines_sql('nested', FILES)})"


@query("nested_classes", f"""
  WITH {_NESTED},
  lx AS (SELECT repo, path, CAST(line_no AS INTEGER) AS line, x.kind AS kind, x.name AS name, x.a AS model,
                x.b AS around, x.text AS text FROM nl)
  SELECT c.repo, c.path, c.line, c.name AS class_name, c.model, max(l.line) AS end_line,
         count(*) FILTER (l.kind = 'method' AND l.around = c.around) AS n_methods
  FROM lx c JOIN lx l ON l.path = c.path AND l.around LIKE c.around || '%'
  WHERE c.kind = 'class' GROUP BY ALL
""")
def nested_classes(c: Corpus):
    """Every class at any depth with its end and its own methods."""
    return _items(c).groupBy("repo", "path", F.col("class_line").alias("line"), "model").agg(
        F.max("class_name").alias("class_name"), F.max("class_end").alias("end_line"),
        F.count_if(F.col("kind") == "def").alias("n_methods"),
    )


@query("nested_members", f"""
  WITH {_NESTED},
  lx AS (SELECT repo, path, CAST(line_no AS INTEGER) AS line, x.kind AS kind, x.name AS name, x.a AS model,
                x.b AS around, x.c AS within, x.text AS text FROM nl)
  SELECT m.repo, m.path, m.model, m.name, m.line, coalesce(string_agg(b.text, chr(10) ORDER BY b.line), '') AS body
  FROM lx m LEFT JOIN lx b ON b.path = m.path AND b.around = m.around AND b.within = m.name
  WHERE m.kind IN ('method', 'field') GROUP BY ALL
""")
def nested_members(c: Corpus):
    """Members with the innermost class around them, also after classes nested two deep."""
    items = _items(c)
    body = F.array_join(F.filter(F.split("body", "\n"), lambda x: x.rlike(r"^\s*[^\s#]")), "\n")
    columns = ("repo", "path", "model", "name", "line")
    methods = entities.methods(items).select(*columns, body.alias("body"))
    return methods.unionByName(entities.fields(items).select(*columns, F.lit("").alias("body")))


_VIEWS = f"vl AS ({lines_sql('views', FILES)})"


@query("xml_error_lines", f"""
  WITH {_VIEWS}
  SELECT repo, path, CAST(line_no AS INTEGER) AS line, 'xml_parse_error' AS type,
         CASE x.kind WHEN 'stray' THEN 'XML parse error: ' || x.name
              WHEN 'wrong' THEN 'XML parse error: <record id="w_' || CAST(k AS STRING) || '"'
              ELSE 'XML parse error: <record id="n_' || CAST(k AS STRING) || '"' END AS message
  FROM vl WHERE x.kind IN ('stray', 'wrong', 'endless')
  UNION ALL
  SELECT repo, path, 1, 'xml_parse_error', 'XML parse error: <odoo> is not closed'
  FROM vl WHERE line_no = 1 AND z % 8 = 0
""")
def xml_error_lines(c: Corpus):
    """Where files go wrong, inside records and between them."""
    errors = xml_records.xml_errors(_elements(c))
    # of a record its start tag up to the id is enough to tell it
    return errors.withColumn("message", F.regexp_replace("message", r"""(?s)^(.*<record id="[^"]*").*$""", "$1"))


@query("xml_field_content", f"""
  WITH {_VIEWS}
  SELECT DISTINCT repo, path, 'v_' || CAST(k AS STRING) AS id, 3 AS line,
         'View of ' || CAST(z AS STRING) || ' <<x> & ' || CAST(k AS STRING) AS name, 'm_' || CAST(k AS STRING) AS model,
         '<tree><field name="a"/></tree>' AS arch
  FROM vl
""")
def xml_field_content(c: Corpus):
    """Text of all descendants of a field, references, and the XML inside, with the record's line."""
    rows = xml_records.xml_records(_elements(c)).where(F.col("model") == "ir.ui.view")
    values = {name: xml_records.record_field(name).alias(name) for name in ("name", "arch")}
    return rows.select("repo", "path", "id", "line", *values.values(), xml_records.record_field("model").alias("model"))
