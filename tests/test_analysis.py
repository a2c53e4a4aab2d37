"""Extraction, rules, rewrites and graphs on small corpora of our own."""

import pytest
from pyspark.sql import functions as F

from addonscope.operators import fixes, graph, modules, python_source, rules
from addonscope.plans.analyze import analyze, extract

HEAD = "from odoo import models, fields, api\n\n\nclass A(models.Model):\n    _name = 'a.b'\n    _description = 'A'\n"


def found(entities, rule):
    rows = rules.detect(entities, [rule]).orderBy("file", "line", "entity").collect()
    return [(r.line, r.entity) for r in rows]


def body(*lines):
    return HEAD + "\n    def go(self):\n        '''doc'''\n" + "".join(f"        {x}\n" for x in lines)


# rule: (text that has it, expected (line, entity), texts that only look like it)
CASES = {
    "DEP001": (HEAD + "    @api.multi\n    # c\n    def f(self):\n        pass\n", (7, "f"),
               [HEAD + "    # @api.multi\n    def f(self):\n        pass\n"]),
    "DEP002": (HEAD + "    @api.one\n    def f(self):\n        pass\n", (7, "f"),
               [HEAD + "    @api.model\n    def f(self):\n        pass\n"]),
    "DEP003": (HEAD + "    @api.returns('self')\n    def f(self):\n        pass\n", (7, "f"),
               [HEAD + "    x = 'api.returns'\n"]),
    "DEP004": ("class A(osv.osv):\n    _name = 'a.b'\n", (1, "a.b"), [HEAD]),
    "DEP005": ("class A(osv.osv):\n    _name = 'a.b'\n    _columns = {\n    }\n", (3, "a.b"),
               [HEAD + "    def f(self):\n        _columns = {}\n"]),
    "DEP006": ("class A(osv.osv):\n    _name = 'a.b'\n    _defaults = {}\n", (3, "a.b"),
               [HEAD + "    # _defaults = {}\n"]),
    "DEP007": (HEAD + "    x = fields.char('X')\n", (7, "x"), [HEAD + "    x = fields.Char('char')\n"]),
    "SEC001": (body("self.env.cr.execute(", "    \"x %s\" % self.id)"), (10, "go"),
               [body("self.env.cr.execute('x %s', (self.id,))"),
                body("# self.env.cr.execute('x %s' % self.id)"),
                body("q = 'select %s' % 1", "self.env.cr.execute('x')"),
                body("msg = 'no sql %s' % 1", "self.env.cr.execute(msg)")]),
    "SEC002": (body("self.sudo().write({})"), (10, "go"), [body("x = '.sudo()'"), body("self.sudo(user)")]),
    "PERF001": (body("for r in self:", "    if r:", "        self.env['x'].search([])"), (8, "go"),
                [body("for r in self:", "    r.x = 1", "self.env['x'].search([])"),
                 body("for r in self.search([]):", "    r.x = 1")]),
    "PERF002": (HEAD + "    x = fields.Char(  # c\n        compute='_x')\n", (7, "x"),
                [HEAD + "    x = fields.Char(compute='_x', store=True)\n",
                 HEAD + "    x = fields.Char('compute')\n"]),
    "PERF003": (body("self.search([])"), (10, "go"), [body("self.search([],", "    limit=1)")]),
    "PERF004": (body("for r in self:", "    r.write({})"), (11, "go"), [body("self.write({})")]),
    "BAD001": (body("self.browse([7])"), (10, "go"), [body("self.browse(ids)"), body("x = 'browse(7)'")]),
    "BAD002": (body("try:", "    x()", "except:", "    # why", "    pass"), (12, "go"),
               [body("try:", "    x()", "except Exception:", "    _logger.error('x')", "    return"),
                body("try:", "    x()", "except ValueError:", "    pass")]),
    "BAD003": (HEAD + "    def write(self, vals):\n        # super()\n        return 'super()'\n", (7, "write"),
               [HEAD + "    def write(self, vals):\n        return super().write(vals)\n",
                HEAD + "    def rewrite(self, vals):\n        return 1\n"]),
    "BAD004": (HEAD + "    def f(self):\n        return 1\n", (7, "f"),
               [HEAD + '    def f(self):\n        """Doc."""\n']),
    "BAD005": (body("self.env.cr.commit()"), (10, "go"), [body("# cr.commit()")]),
    "MIS002": ("class A(models.Model):\n    _name = 'a.b'\n", (1, "a.b"),
               [HEAD, "class A(models.Model):\n    _inherit = 'a.b'\n"]),
    "INH001": ("class A(models.Model):\n    _name = 'a.b'\n    _inherit = 'c.d'\n", (1, "a.b"),
               ["class A(models.Model):\n    _name = 'a.b'\n    _inherit = ['a.b']\n"]),
    "DAT001": (HEAD + "    x = fields.Many2one('a.b')\n", (7, "x"),
               [HEAD + "    x = fields.Many2one('a.b', ondelete='cascade')\n"]),
    "DAT002": (HEAD + "    x = fields.Selection([('a', 'A')])\n", (7, "x"),
               [HEAD + "    x = fields.Selection([('a', 'A')], default='a')\n"]),
    "DAT003": (HEAD + "    x = fields.Char(required=True)\n", (7, "x"),
               [HEAD + "    x = fields.Char(required=True, default='')\n",
                HEAD + "    x = fields.Char(required=False)\n"]),
}


@pytest.fixture(scope="module")
def rule_entities(make_files):
    corpora = {}
    for rule, (bad, _, good) in CASES.items():
        corpora[f"{rule}/bad.py"] = bad
        corpora.update({f"{rule}/good_{i}.py": text for i, text in enumerate(good)})
    return extract(make_files(corpora))


@pytest.mark.parametrize("rule", CASES)
def test_rule(rule_entities, rule):
    rows = rules.detect(rule_entities, [rule]).where(F.startswith("file", F.lit(rule + "/"))).collect()
    assert [(r.file, r.line, r.entity) for r in rows] == [(f"{rule}/bad.py", *CASES[rule][1])]


def test_module_rules(make_files):
    e = extract(make_files({
        "m/__manifest__.py": "{'name': 'M', 'license': ''}",
        "m/a.py": HEAD + "\nclass C(models.Model):\n    _name = 'c.d'\n    _description = 'x'\n",
        "m/security/ir.model.access.csv":
            "id,model_id:id,perm_read\n# c\nx,other.model_a_b,1\n",
        "m/rules.xml": "<odoo><record id='r' model='ir.rule'><field name='model_id'"
                       " ref='model_c_d'/></record></odoo>",
    }))
    assert found(e, "MIS003") == [(1, "m")]
    assert found(e, "MIS001") == []
    assert found(e, "SEC003") == [(1, "c.d")]
    assert found(e, "SEC004") == [(4, "a.b")]


def test_without_any_manifest(make_files):
    e = extract(make_files({"x/a.py": HEAD, "b.py": "import os\n"}))
    assert [(r.module_path, r.module_name) for r in e["modules"].collect()] == [("", "unknown_module")]
    assert found(e, "MIS001") == [(1, "unknown_module")]


def test_longest_module_wins(make_files):
    files = make_files({
        "a/__manifest__.py": "{}", "a/b/__openerp__.py": "{}", "a/b/c/x.py": "", "a/z.py": "",
        "ab/y.py": "", "top.py": "",
    })
    got = {r.path: r.module_path for r in modules.assign_modules(files).collect()}
    assert got == {
        "a/__manifest__.py": "a", "a/b/__openerp__.py": "a/b", "a/b/c/x.py": "a/b", "a/z.py": "a",
        "ab/y.py": "a/b", "top.py": "a/b",
    }


SOURCE = '''
import x
class Top(models.Model):
    """Doc with class Fake(models.Model):
    and def trap(self): ("""
    _name = "top.model"
    text = 'a ) # b'

    @api.depends(
        'x',  # )
    )
    @other
    async def first(self,
                    a=(1, [2]), *, b: int = 3):
        class Local(models.Model):
            _name = 'local.one'
        return {
            'a': 1,
        }
    # trailing comment

    class Nested(models.TransientModel):
        _name = 'nested.one'
        n = fields.Integer()

    after = fields.Char()
x = 1
if x:
    class Late(models.AbstractModel):
\t\tlate = fields.Date()
\t\tdef m(self): pass
class Plain(object):
    y = fields.Char()
class BrokenUp(models.Model):
    bad = fields.Char((
    def still(self):
        return 1
'''


def test_class_structure(make_files):
    e = extract(make_files({"a.py": SOURCE}))
    assert sorted((r.class_name, r.model) for r in e["models"].collect()) == [
        ("BrokenUp", "broken.up"), ("Late", "late"), ("Local", "local.one"),
        ("Nested", "nested.one"), ("Top", "top.model"),
    ]
    assert sorted((r.class_name, r.name) for r in e["fields"].collect()) == [
        ("BrokenUp", "bad"), ("Late", "late"), ("Nested", "n"), ("Top", "after"),
    ]
    methods = {r.name: r for r in e["methods"].collect()}
    assert set(methods) == {"first", "m", "still"}
    first = methods["first"]
    assert first.params == ["self", "a=(1, [2])", "*", "b: int = 3"]
    assert [d.replace(" ", "").replace("\n", "") for d in first.decorators] == [
        "api.depends('x',)", "other"]


def test_lines_are_unique_and_methods_counted_once(make_files):
    files = make_files({"a.py": SOURCE, "b.py": HEAD})
    lines = python_source.statement_lines(python_source.lexed_lines(files))
    assert lines.groupBy("path", "line_no").count().where("count > 1").isEmpty()
    methods = extract(files)["methods"]
    assert methods.groupBy("path", "line").count().where("count > 1").isEmpty()


LEGACY = '''from openerp.osv import osv, fields
class old_thing(osv.osv):
    _name = 'old.thing'
    _description = 'Old'
    _columns = {
        # kept
        'name': fields.char('Name', size=64),
        'partner_id': fields.many2one(
            'res.partner', 'Partner',
        ),
        'odd': other(),
    }
    _defaults = {
        'name': lambda self, cr, uid, ctx: 'a, b',
    }
    def go(self, a):
        """doc"""
        self.env.cr.execute("select {} from x".format(a))
        self.cr.commit()
'''


def test_legacy_rewrite_and_second_run(make_files):
    every = [r for r in rules.RULES if r not in ("SEC004",)]

    def rewrite(text):
        files = make_files({"m/__manifest__.py": "# {\n{'name': 'M'}", "m/a.py": text})
        fixed = fixes.fix_corpus(files, rules.detect(extract(files), every))
        return {r.path: r.fixed_content for r in fixed.collect()}

    once = rewrite(LEGACY)
    assert once["m/__manifest__.py"] == "# {\n{\n    'license': 'LGPL-3','name': 'M'}"
    text = once["m/a.py"]
    assert "class old_thing(models.Model):" in text
    assert "    # kept\n    name = fields.Char('Name', size=64)\n" in text
    assert "'res.partner', 'Partner', ondelete='set null'" in text
    assert "    # 'odd': other()" in text
    assert "            'name': lambda self, cr, uid, ctx: 'a, b',\n        })" in text
    assert 'self.env.cr.execute("select %s from x", (a,))' in text
    assert "# DIHAPUS: self.cr.commit()" in text
    twice = rewrite(text)
    assert rewrite(twice["m/a.py"]).get("m/a.py", twice["m/a.py"]) == twice["m/a.py"]


def test_edge_severity_against_all_pairs(spark):
    labels = ["name", "Partner_Id", "go()", "zz", "two words", "e"]
    issues = [
        ("r", "warning", "name = fields.Char", "A1", "the partner_idx", "t"),
        ("r", "info", "", "A2", "calls xgo() here", "T"),
        ("r", "critical", "some two words here", "A3", "", ""),
        ("s", "critical", "name", "A4", "zz", ""),
        ("r", "odd", "zz", "A5", "", ""),
    ]
    edges = spark.createDataFrame([("r", x) for x in labels], "repo STRING, label STRING")
    df = spark.createDataFrame(
        issues, "repo STRING, severity STRING, code STRING, rule_id STRING, description STRING, title STRING"
    )
    got = {r.label: r.severity for r in graph.edge_severity(edges, df).collect()}
    order = ["critical", "warning", "info"]
    for label in labels:
        hits = [
            order.index(s) for repo, s, *texts in issues
            if repo == "r" and s in order and label.lower() in " ".join(texts).lower()
        ]
        assert got[label] == (order[min(hits)] if hits else "none"), label


def test_registered_rule(make_files):
    own = {}
    rules.register_rule(
        "OWN1", "field", F.length("name") > 5, "info", "bad_practice", "Long name", "Too long",
        "Shorten", rules=own,
    )
    e = extract(make_files({"a.py": HEAD + "    longest = fields.Char()\n    x = fields.Char()\n"}))
    assert [(r.rule_id, r.line) for r in rules.detect(e, ["OWN1"], own).collect()] == [("OWN1", 7)]


def test_crlf_bom_and_empty_files(make_files):
    text = "﻿" + HEAD.replace("\n", "\r\n") + "    x = fields.Char(\r\n        'X')\r\n"
    e = extract(make_files({"a.py": text, "b.py": "", "c.xml": "", "d.csv": "", "e.po": ""}))
    assert [(r.name, r.line, r.end_line) for r in e["fields"].collect()] == [("x", 7, 8)]


def test_analyze_counts_copies_once_and_drops_empty_modules(make_files):
    files = make_files({
        "m/__manifest__.py": "{'name': 'M', 'version': '14.0.1'}",
        "m/a.py": HEAD + "    state = fields.Selection([('draft', 'D'), ('done', 'E')])\n"
                         "    def done(self):\n        self.state = 'done'\n",
        "empty/__manifest__.py": "{}",
    })
    result = analyze(files.unionByName(files).select("repo", "path", "content"))
    assert [r.module_path for r in result["modules"].collect()] == ["m"]
    row = result["stats"].collect()[0]
    assert (row.total_modules, row.total_models, row.total_fields, row.total_methods) == (1, 1, 1, 1)
    assert row.version_detected == "Odoo 14.0.1"
    move = result["transitions"].collect()[0]
    assert (move.from_state, move.to_state, move.method) == ("done", "done", "done")


def test_unclosed_record_does_not_hide_the_next(make_files):
    text = "<odoo><record id='a' model='ir.ui.menu'><record id='b' model='ir.ui.menu'></record>"
    e = extract(make_files({"a.xml": text + "<!-- open <record id='c' model='ir.ui.menu'/>"}))
    assert [r.id for r in e["menus"].collect()] == ["b"]
    assert e["parse_errors"].count() == 1


def test_methods_at_any_indent(make_files):
    """Two, eight and tab columns are as good as four."""
    e = extract(make_files({
        f"a{i}.py": f"class A(models.Model):\n{pad}_name = 'a'\n{pad}def go(self):\n{pad}{pad}self.env.cr.commit()\n"
        for i, pad in enumerate(("  ", "        ", "\t"))
    }))
    assert [r.name for r in e["methods"].collect()] == ["go"] * 3
    assert rules.detect(e, ["BAD005"]).count() == 3


def test_extension_of_the_same_name_declares_no_model(make_files):
    text = "class A(models.Model):\n    _name = 'a.x'\n    _inherit = 'a.x'\n"
    own = "class B(models.Model):\n    _name = 'b.x'\n    _description = 'd'\n"
    e = extract(make_files({"m/__manifest__.py": "{}", "m/a.py": text, "m/b.py": own, "m/c.py": own}))
    found = [(r.rule_id, r.entity) for r in rules.detect(e, ["SEC003", "MIS002"]).collect()]
    assert found == [("SEC003", "b.x")]


def test_rewrites_keep_code_valid(make_files):
    import ast

    bodies = [
        ["if a:", "    self.env.cr.commit()", "b(); self._cr.commit(); c()"],
        ["try:", "    go()", "except: return False"],
        ["x = lambda: cr.commit()"],
        ["self.env.cr.execute(\"SELECT a FROM t WHERE b = '%s' AND c = %s\" % (b, c))"],
        ["cr.execute('SELECT {} FROM t'.format(a, b))"],
        ["cr.execute(f'SELECT 1 FROM t WHERE a = {a} AND b = {b.c}')"],
        ["self.browse(7)"],
    ]
    bases = {
        "osv.Model": "models.Model", "orm.TransientModel": "models.TransientModel",
        "osv.osv_memory": "models.TransientModel",
    }
    files = {}
    for k, base in enumerate(bases):
        lines = [f"class A({base}):", "    _name = 'a'", "    d = fields.date('D')"]
        for i, body in enumerate(bodies):
            lines += [f"    def m{i}(self):", *["        " + b for b in body]]
        files[f"a{k}.py"] = "\n".join(lines) + "\n"
    e = extract(make_files(files))
    found = rules.detect(e, ["BAD001", "BAD002", "BAD005", "SEC001", "DEP004", "DEP007"])
    fixed = {r.path: r.fixed_content for r in fixes.fix_corpus(e["files"], found).collect()}
    for k, today in enumerate(bases.values()):
        text = fixed[f"a{k}.py"]
        ast.parse(text)
        assert f"class A({today}):" in text
        assert "return False" in text and "fields.Date(" in text and "c()" in text
        assert "self.env.cr.execute(\"SELECT a FROM t WHERE b = '%s' AND c = %s\", (b, c))" in text
        assert "cr.execute('SELECT %s FROM t', (a, b,))" in text
        assert "cr.execute('SELECT 1 FROM t WHERE a = %s AND b = %s', (a, b.c))" in text


def test_long_methods_stay_linear(make_files):
    """A method of 6,000 lines with a query on every third one takes seconds."""
    import time

    rows = []
    for i in range(2000):
        rows += [f"        q{i} = 'SELECT %s' % x", f"        self.env.cr.execute(q{i})", "        y = self.search([('a', '=', 1)])"]
    text = "class A(models.Model):\n    _name = 'a'\n    def go(self):\n" + "\n".join(rows) + "\n"
    e = extract(make_files({"a.py": text}))
    start = time.time()
    found = {r.rule_id: r.line for r in rules.detect(e, ["SEC001", "PERF003"]).collect()}
    assert found == {"SEC001": 5, "PERF003": 6} and time.time() - start < 60
