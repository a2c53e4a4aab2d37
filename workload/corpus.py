"""Source files derived from the star tables.

Each kind of file is a list of line templates.  The same list gives the file
text in Spark and, as SQL over the same tables, every line with its number and
what an analysis has to find on it.  The amount of text grows with the tables.
"""

from __future__ import annotations

import string
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

# Columns both engines can compute from part, supplier and their join.
SOURCE_SQL = """
    SELECT p_partkey AS k, p_size AS z, p_name AS pname, lower(p_type) AS ptype,
           s_suppkey AS s, s_nationkey AS nat, n_sup AS n,
           p_partkey - 1 AS prev, p_partkey - n_sup AS above,
           'repo_' || CAST(s_nationkey AS STRING) AS repo,
           'addons/mod_' || CAST(s_suppkey AS STRING) AS mod
    FROM (SELECT part.*, (SELECT count(*) FROM supplier) AS n_sup FROM part) p
    JOIN supplier ON s_suppkey = p_partkey % n_sup
"""
SUPPLIER_SQL = """
    SELECT s_suppkey AS s, s_nationkey AS nat, (s_suppkey + 1) % n_sup AS nxt,
           s_suppkey % 5 AS s5, 12 + s_suppkey % 5 AS major,
           'repo_' || CAST(s_nationkey AS STRING) AS repo,
           'addons/mod_' || CAST(s_suppkey AS STRING) AS mod
    FROM (SELECT supplier.*, (SELECT count(*) FROM supplier) AS n_sup FROM supplier) x
"""


@dataclass(frozen=True)
class Sql:
    """A tag value given as an SQL expression."""

    text: str


@dataclass(frozen=True)
class Line:
    text: str
    when: str = ""
    tags: dict = field(default_factory=dict)
    # (rule id, condition, entity): findings on this line.
    rules: tuple = ()


def line(text: str, when: str = "", rules: tuple = (), **tags) -> Line:
    return Line(text, when, tags, rules)


# Order of the tag columns of every rendered line.
TAGS = ["kind", "name", "a", "b", "c", "d", "e", "f"]

_FIELD = dict(kind="field")
_METHOD = dict(kind="method")

PYTHON = [
    line("# -*- coding: utf-8 -*-"),
    line("from openerp.osv import osv, fields", "z % 10 = 0"),
    line("from odoo import models, fields, api", "z % 10 <> 0"),
    line(""),
    line(
        "class Part{k}Model(osv.osv):", "z % 10 = 0",
        kind="class", name="Part{k}Model",
        rules=(("DEP004", "true", "model"), ("MIS002", "z % 5 = 0 AND z % 7 NOT IN (0, 2)", "model"),
               ("INH001", "z % 7 = 1", "model")),
    ),
    line(
        "class Part{k}Model(models.Model):", "z % 10 <> 0",
        kind="class", name="Part{k}Model",
        rules=(("MIS002", "z % 5 = 0 AND z % 7 NOT IN (0, 2)", "model"),
               ("INH001", "z % 7 = 1", "model")),
    ),
    line("    _name = 'part.model.{k}'  # not 'part.other'", "z % 7 NOT IN (0, 2)"),
    line("    _inherit = 'part.model.{prev}'", "z % 7 = 0"),
    line("    _inherit = ['mail.thread', 'part.base']", "z % 7 = 1"),
    line("    _inherits = {{'res.users': 'user_id'}}", "z % 21 = 1"),
    line("    _description = '{pname} model'", "z % 5 <> 0"),
    line("    _order = 'sequence, id'", "z % 3 = 0"),
    line("    _rec_name = 'code'", "z % 9 = 0"),
    line("    _sql_constraints = [", "z % 5 = 2"),
    line("        ('uniq_{k}', 'unique(name, code)', \"Name isn't unique\"),", "z % 5 = 2",
         kind="constraint", name="uniq_{k}", a="unique(name, code)", b="Name isn't unique"),
    line("        ('pos_{k}', 'check(amount > 0)', 'Positive'),", "z % 10 = 2",
         kind="constraint", name="pos_{k}", a="check(amount > 0)", b="Positive"),
    line("    ]", "z % 5 = 2"),
    line("\tnote = 'tab'", "z % 16 = 0"),
    line("    _columns = {{", "z % 20 = 0", rules=(("DEP005", "true", "model"),)),
    line("        # 'gone': fields.char('Gone'),", "z % 20 = 0"),
    line("        'code': fields.char('Code', size=64),", "z % 20 = 0",
         kind="field", name="code", a="char", b="Code", c=Sql("NULL"), d=Sql("NULL"),
         e="x{k}, y", f=Sql("NULL"),
         rules=(("DEP007", "true", "code"),)),
    line("        'owner_id': fields.many2one('res.users', 'Owner'),", "z % 20 = 0",
         kind="field", name="owner_id", a="many2one", b="Owner", c="res.users", d=Sql("NULL"),
         e=Sql("NULL"), f=Sql("NULL"),
         rules=(("DEP007", "true", "owner_id"), ("DAT001", "true", "owner_id"))),
    line("    }}", "z % 20 = 0"),
    line("    _defaults = {{", "z % 20 = 0", rules=(("DEP006", "true", "model"),)),
    line("        'code': 'x{k}, y',", "z % 20 = 0"),
    line("    }}", "z % 20 = 0"),
    line("    name = fields.char('Name', required=True)", "z % 4 = 0",
         **_FIELD, name="name", a="char", b="Name", c=Sql("NULL"), d=Sql("NULL"), e=Sql("NULL"),
         f=Sql("NULL"), rules=(("DEP007", "true", "name"), ("DAT003", "true", "name"))),
    line("    name = fields.Char('Name (a, b)', required=True)", "z % 4 <> 0",
         **_FIELD, name="name", a="Char", b="Name (a, b)", c=Sql("NULL"), d=Sql("NULL"),
         e=Sql("NULL"), f=Sql("NULL"), rules=(("DAT003", "true", "name"),)),
    line("    partner_id = fields.Many2one(",
         **_FIELD, name="partner_id", a="Many2one", b="Partner: {pname}", c="res.partner",
         d=Sql("CASE WHEN z % 3 = 0 THEN 'cascade' END"), e=Sql("NULL"), f=Sql("NULL"),
         rules=(("DAT001", "z % 3 <> 0", "partner_id"),)),
    line("        'res.partner',  # the ) partner, \"quoted"),
    line("        string='Partner: {pname}',"),
    line("        ondelete='cascade',", "z % 3 = 0"),
    line("    )"),
    line("    amount = fields.Float(compute='_compute_amount', store=True)", "z % 2 = 0",
         **_FIELD, name="amount", a="Float", b=Sql("NULL"), c=Sql("NULL"), d=Sql("NULL"),
         e=Sql("NULL"), f="_compute_amount"),
    line("    amount = fields.Float(compute='_compute_amount')", "z % 2 = 1",
         **_FIELD, name="amount", a="Float", b=Sql("NULL"), c=Sql("NULL"), d=Sql("NULL"),
         e=Sql("NULL"), f="_compute_amount", rules=(("PERF002", "true", "amount"),)),
    line("    state = fields.Selection([('draft', 'Draft'), ('{ptype}', 'Busy'), ('done', 'Done')],"
         " string='Status', default='draft')", "z % 12 = 0",
         **_FIELD, name="state", a="Selection", b="Status", c=Sql("NULL"), d=Sql("NULL"),
         e="draft", f=Sql("NULL")),
    line("    state = fields.Selection([('draft', 'Draft'), ('validate_{z}', 'Check')],"
         " string='Status')", "z % 12 = 6",
         **_FIELD, name="state", a="Selection", b="Status", c=Sql("NULL"), d=Sql("NULL"),
         e=Sql("NULL"), f=Sql("NULL"), rules=(("DAT002", "true", "state"),)),
    line("    line_ids = fields.One2many('part.line.{k}', 'parent_id', string='Lines')",
         "z % 8 = 0",
         **_FIELD, name="line_ids", a="One2many", b="Lines", c="part.line.{k}", d=Sql("NULL"),
         e=Sql("NULL"), f=Sql("NULL")),
    line(""),
    line("    @api.multi", "z % 9 = 0", rules=(("DEP001", "true", "_compute_amount"),)),
    line("    # between", "z % 18 = 0"),
    line("    @api.one", "z % 23 = 0", rules=(("DEP002", "true", "_compute_amount"),)),
    line("    @api.returns('self', id)", "z % 25 = 0",
         rules=(("DEP003", "true", "_compute_amount"),)),
    line("    @api.depends('partner_id')"),
    line("    def _compute_amount(self):",
         **_METHOD, name="_compute_amount", a="self",
         b=Sql("CASE WHEN z % 9 = 0 THEN 'api.multi|' ELSE '' END"
               " || CASE WHEN z % 23 = 0 THEN 'api.one|' ELSE '' END"
               " || CASE WHEN z % 25 = 0 THEN 'api.returns(''self'', id)|' ELSE '' END"
               " || 'api.depends(''partner_id'')'"),
         c="false",
         rules=(("BAD004", "z % 2 = 0", "_compute_amount"),
                ("PERF001", "z % 5 = 1", "_compute_amount"))),
    line('        """Amount of {pname}.', "z % 2 = 1"),
    line("    def trap(self): state = 'trap'; self.env.cr.commit()", "z % 2 = 1"),
    line('        """', "z % 2 = 1"),
    line("        for rec in self:"),
    line("            other = self.env['x'].search([('id', '=', rec.id)])", "z % 5 = 1",
         rules=(("PERF003", "true", "_compute_amount"),)),
    line("            rec.write({{'amount': 2}})", "z % 10 = 3",
         rules=(("PERF004", "true", "_compute_amount"),)),
    line("            rec.amount = 1.0"),
    line("        self.search([], limit=5)", "z % 5 = 2"),
    line(""),
    line("    def action_done(self):", "z % 6 = 0",
         **_METHOD, name="action_done", a="self", b="", c="false",
         rules=(("BAD004", "true", "action_done"),)),
    line("        if self.state == '{ptype}':", "z % 18 = 0"),
    line("            return", "z % 18 = 0"),
    line("        self.write({{'note': 'x', 'state': 'done'}})", "z % 6 = 0"),
    line("        self.env.cr.commit()", "z % 12 = 0",
         rules=(("BAD005", "true", "action_done"),)),
    line("    def write(self, vals):", "z % 11 = 0",
         **_METHOD, name="write", a="self,vals", b="", c=Sql("CAST(z % 2 = 0 AS STRING)"),
         rules=(("BAD004", "true", "write"), ("BAD003", "z % 2 = 1", "write"))),
    line("        # super() is missing", "z % 22 = 11"),
    line("        return super().write(vals)", "z % 22 = 0"),
    line("        return 'super()'", "z % 22 = 11"),
    line("    def report(self, ids=(1, 2), **kw):", "z % 13 IN (0, 1, 2)",
         **_METHOD, name="report", a="self,ids=(1, 2),**kw", b="", c="false",
         rules=(("BAD004", "true", "report"),)),
    line("        self.env.cr.execute(\"SELECT * FROM t WHERE id = %s\" % self.id)", "z % 13 = 0",
         rules=(("SEC001", "true", "report"),)),
    line("        query = 'SELECT name FROM t WHERE id = %s' % self.id", "z % 13 = 1"),
    line("        self.env.cr.execute(query)", "z % 13 = 1", rules=(("SEC001", "true", "report"),)),
    line("        self.env.cr.execute('SELECT 1 WHERE id = %s', (self.id,))", "z % 13 = 2"),
    line("    def warehouse(self):", "z % 14 = 0",
         **_METHOD, name="warehouse", a="self", b="", c="false",
         rules=(("BAD004", "true", "warehouse"),)),
    line("        return self.env['w'].sudo().browse({z})", "z % 14 = 0",
         rules=(("SEC002", "true", "warehouse"), ("BAD001", "true", "warehouse"))),
    line("    def safe(self):", "z % 15 = 0",
         **_METHOD, name="safe", a="self", b="", c="false", rules=(("BAD004", "true", "safe"),)),
    line("        try:", "z % 15 = 0"),
    line("            self.go()", "z % 15 = 0"),
    line("        except Exception:", "z % 15 = 0", rules=(("BAD002", "true", "safe"),)),
    line("            pass", "z % 15 = 0"),
    line(""),
    line("class Part{k}Line(models.Model):", "z % 8 = 0", kind="class", name="Part{k}Line"),
    line("    _name = 'part.line.{k}'", "z % 8 = 0"),
    line("    _description = 'Line'", "z % 8 = 0"),
    line("    parent_id = fields.Many2one('part.model.{k}', ondelete='cascade')", "z % 8 = 0",
         **_FIELD, name="parent_id", a="Many2one", b=Sql("NULL"), c="part.model.{k}", d="cascade",
         e=Sql("NULL"), f=Sql("NULL")),
]

_ROOT = "CASE z % 4 WHEN 0 THEN 'form' WHEN 1 THEN 'tree' WHEN 2 THEN 'kanban' ELSE 'xpath' END"

XML = [
    line('<?xml version="1.0" encoding="utf-8"?>'),
    line("<odoo>"),
    line('  <!-- <record id="ghost_{k}" model="ir.ui.view"/> -->'),
    line('  <record id="view_{k}" model="ir.ui.view">'),
    line('    <field name="name">part.model.{k}.view</field>'),
    line('    <field name="model">part.model.{k}</field>'),
    line('    <field name="inherit_id" ref="base.view_{z}"/>', "z % 5 = 0"),
    line('    <field name="priority" eval="{z}"/>', "z % 3 = 0"),
    line('    <field name="arch" type="xml">'),
    line('      <form string="F">', "z % 4 = 0"),
    line("      <tree>", "z % 4 = 1"),
    line("      <Kanban>", "z % 4 = 2"),
    line("""      <xpath expr="//field[@name='note']" position="after">""", "z % 4 = 3"),
    line('        <field name="name"/>'),
    line('        <field name="partner_id"><tree><field name="amount"/></tree></field>', "z % 2 = 0"),
    line("""        <button name="go" attrs="{{'invisible': [('state' = 'x')]}}"/>""", "z % 6 = 0"),
    line("      </form>", "z % 4 = 0"),
    line("      </tree>", "z % 4 = 1"),
    line("      </Kanban>", "z % 4 = 2"),
    line("      </xpath>", "z % 4 = 3"),
    line("    </field>"),
    line('    <field name="active" eval="True"/>'),
    line("  </record>"),
    line('  <record id="action_{k}" model="ir.actions.act_window">', "z % 2 = 0"),
    line('    <field name="name">Open &amp; {pname}</field>', "z % 2 = 0"),
    line('    <field name="res_model">part.model.{k}</field>', "z % 2 = 0"),
    line('    <field name="view_mode">kanban</field>', "z % 4 = 0"),
    line("    <field name=\"domain\">[('id', '=', {z})]</field>", "z % 6 = 0"),
    line("    <field name=\"groups_id\" eval=\"[(4, ref('base.group_{z}')), (4, ref('base.group_user'))]\"/>",
         "z % 4 = 0"),
    line("  </record>", "z % 2 = 0"),
    line('  <act_window id="aw_{k}" name="AW" res_model="part.model.{k}" groups="a.b, c.d"/>',
         "z % 7 = 0"),
    line('  <report id="rep_{k}" string="R {k}" model="part.model.{k}" report_type="pdf"/>',
         "z % 9 = 0"),
    line('  <menuitem id="menu_{k}" name="{pname}" parent="menu_{above}" sequence="{z}"'
         ' action="action_{k}"/>', "z % 3 = 0"),
    line("""  <menuitem id='menu_{k}' name="{pname}" groups="g.{z}"/>""", "z % 3 = 1"),
    line('  <record id="menu_{k}" model="ir.ui.menu">', "z % 3 = 2"),
    line('    <field name="name">{pname}</field>', "z % 3 = 2"),
    line('    <field name="parent_id" ref="menu_root_{s}"/>', "z % 3 = 2"),
    line("  </record>", "z % 3 = 2"),
    line('  <record id="rule_{k}" model="ir.rule">', "z % 4 = 0"),
    line('    <field name="name">Rule {k}</field>', "z % 4 = 0"),
    line('    <field name="model_id" ref="model_part_model_{k}"/>', "z % 4 = 0"),
    line("    <field name=\"domain_force\">[('id', '=', {z})]</field>", "z % 4 = 0"),
    line("    <field name=\"groups\" eval=\"[(4, ref('base.group_{z}'))]\"/>", "z % 4 = 0"),
    line('    <field name="perm_write" eval="False"/>', "z % 8 = 0"),
    line("  </record>", "z % 4 = 0"),
    line('  <record id="broken_{k}" model="ir.ui.view"><field name="name">x</record>', "z % 17 = 0"),
    line("</odoo>"),
]

CSV = [
    line("id,name,model_id:id,group_id:id,perm_read,perm_write,perm_create,perm_unlink",
         "z % 2 = 0"),
    line("﻿ID,name,model_id/id,group_id/id,perm_read,perm_write,perm_create,perm_unlink",
         "z % 2 = 1"),
    line("# comment, not a row"),
    line('access_{k},"{pname}, ""q""",model_part_model_{k},base.group_user,1,0,True,none',
         "z % 3 <> 1"),
    line("access_line_{k},line,mod.model_part_line_{k},,1,1,1,1", "z % 16 = 0"),
    line(""),
    line(",,,,1,1,1,1"),
]

MANIFEST = [
    line("# -*- coding: utf-8 -*-"),
    line("# {{'not': 'the dict'}}"),
    line("{{"),
    line("    'name': \"Module \" 'nr {s}',  # 'x': 1"),
    line("    'version': '{major}.0.1.{s}',"),
    line("    'license': 'LGPL-3',", "s % 3 <> 0"),
    line("    'author': 'Author, {s}',"),
    line("    'description': \"\"\"Has 'depends': ['no'] inside"),
    line("        and a second line\"\"\","),
    line("    'depends': ['base', 'mod_{nxt}', \"ext_{s5}\"],  # , 'none'"),
    line("    'data': ["),
    line("        # 'skipped.xml',"),
    line("        'views/v{s}.xml',"),
    line("    ],"),
    line("    'installable': False,", "s % 4 = 0"),
    line("    'application': True,", "s % 6 = 0"),
    line("    'external_dependencies': {{'python': ['lxml', 'x'], 'bin': 'tool'}},", "s % 6 = 0"),
    line("    'custom_key': {s},"),
    line("}}"),
]

PO = [
    line("# comment"),
    line('msgid ""'),
    line('msgstr ""'),
    line('"Language: fr\\n"'),
    line(""),
    line("#: models"),
    line('msgid "Supplier {s}"'),
    line('msgstr "Fournisseur {s}"'),
    line(""),
    line('msgid "Long "'),
    line('"text {s}"'),
    line('msgstr "Texte "'),
    line('"long \\"{s}\\""'),
    line(""),
    line('msgid "Empty"'),
    line('msgstr ""'),
    line('msgid "Supplier {s}"', "s % 4 = 0"),
    line('msgstr "Fournisseur bis {s}"', "s % 4 = 0"),
]

HAS_MANIFEST = "s % 11 <> 0 AND nat % 5 <> 4"

# kind: (rows, condition, path template, lines, rows with \r\n line ends)
FILES = {
    "python": (SOURCE_SQL, "true", "{mod}/models/m_{k}.py", PYTHON, "z % 19 = 0"),
    "xml": (SOURCE_SQL, "true", "{mod}/views/m_{k}.xml", XML, "false"),
    "csv": (SOURCE_SQL, "true", "{mod}/security/access_{k}.csv", CSV, "z % 6 = 1"),
    "manifest": (SUPPLIER_SQL, HAS_MANIFEST, "{mod}/__manifest__.py", MANIFEST, "s % 7 = 0"),
    "po": (SUPPLIER_SQL, "s % 2 = 0", "{mod}/i18n/fr.po", PO, "false"),
}


def _pieces(template: str):
    for text, name, _, _ in string.Formatter().parse(template):
        if text:
            yield text, None
        if name:
            yield None, name


def _spark(template: str) -> str:
    """A template as a Spark SQL expression."""
    parts = [
        "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'" if name is None
        else f"CAST({name} AS STRING)"
        for text, name in _pieces(template)
    ]
    return " || ".join(parts) if parts else "''"


def _sql(template: str) -> str:
    parts = [
        "'" + text.replace("'", "''") + "'" if name is None else f"CAST({name} AS STRING)"
        for text, name in _pieces(template)
    ]
    return " || ".join(parts) if parts else "''"


def read_tables(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def derived_files(
    spark: SparkSession, sf_dir: str, spread=lambda rows: rows, kinds: dict | None = None
) -> DataFrame:
    """``repo, path, content`` of all derived source files."""
    read_tables(spark, sf_dir, "part", "supplier")
    out = None
    for rows, condition, path, lines, crlf in (kinds or FILES).values():
        text = ", ".join(
            f"CASE WHEN {x.when} THEN {_spark(x.text)} END" if x.when else _spark(x.text)
            for x in lines
        )
        text = f"concat_ws('\\n', {text})"
        kind = (
            spread(spark.sql(rows).where(condition))
            .selectExpr(
                "repo",
                f"{_spark(path)} AS path",
                f"CASE WHEN {crlf} THEN replace({text}, '\\n', '\\r\\n') ELSE {text} END AS content",
            )
        )
        out = kind if out is None else out.unionByName(kind)
    return out


def lines_sql(kind: str, kinds: dict | None = None) -> str:
    """SQL of every line of a kind of file: number, text, tags and findings."""
    rows, condition, path, lines, _ = (kinds or FILES)[kind]

    def tag(value) -> str:
        if value is None:
            return "CAST(NULL AS STRING)"
        return f"CAST({value.text} AS STRING)" if isinstance(value, Sql) else _sql(value)

    def element(x: Line) -> str:
        found = ", ".join(
            f"CASE WHEN {cond} THEN {{'rule_id': '{rule}', 'entity': "
            + ("NULL" if entity == "model" else _sql(entity))
            + "} END"
            for rule, cond, entity in x.rules
        )
        tags = ", ".join(f"'{t}': {tag(x.tags.get(t))}" for t in TAGS)
        rules = (
            f"list_filter([{found}], lambda r: r IS NOT NULL)" if found
            else "CAST([] AS STRUCT(rule_id STRING, entity STRING)[])"
        )
        body = f"{{'text': {_sql(x.text)}, {tags}, 'rules': {rules}}}"
        return f"CASE WHEN {x.when} THEN {body} END" if x.when else body

    listed = ",\n      ".join(element(x) for x in lines)
    return f"""
      SELECT src.*, generate_subscripts(ls, 1) AS line_no, unnest(ls, max_depth := 1) AS x
      FROM (SELECT *, {_sql(path)} AS path,
                   list_filter([{listed}], lambda e: e IS NOT NULL) AS ls
            FROM ({rows}) q WHERE {condition}) src
    """
