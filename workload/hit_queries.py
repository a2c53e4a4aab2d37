"""Queries over methods with several findings of one rule, and over whole rewritten files."""

from __future__ import annotations

from pyspark.sql import functions as F

from addonscope.operators import entities, fixes, python_source, rules
from addonscope.sources.corpus import classify
from workload.corpus import SOURCE_SQL, derived_files, line, lines_sql
from workload.registry import Corpus, query, spread

_RULES = ["SEC001", "SEC002", "PERF001", "PERF003", "PERF004", "BAD001", "BAD002", "BAD005", "DEP007"]


def _suggestion(rule_id: str) -> str:
    return rules.RULES[rule_id].texts[2].replace("{method}", "work").replace("{", "{{").replace("}", "}}")


def _hit(text: str, *found: str, fixed: str | None = None, when: str = ""):
    """A line with findings; where no rewrite is given they put notes above it, the last on top."""
    pad = text[: len(text) - len(text.lstrip())]
    notes = "".join(f"{pad}# [{r}] PERHATIAN: {_suggestion(r)}\n" for r in sorted(found, reverse=True))
    return line(
        text, when, a=notes + text if fixed is None else fixed,
        rules=tuple((r, "true", "n" if r == "DEP007" else "work") for r in found),
    )


_COMMIT = "  # DIHAPUS: self.env.cr.commit() - Odoo mengelola transaksi secara otomatis"
_BOUND = "  # FIXED: Gunakan parameterized query di sini untuk mencegah SQL Injection!"
_LOGGED = "            _logger.exception('Terjadi error: %s', str(e))"
HITS = [
    line("from odoo import models, fields"),
    line("class Hits{k}(models.Model):"),
    line("    _name = 'hits.{k}'"),
    _hit("    n = fields.char('N', default=lambda s: fields.date.today())", "DEP007",
         fixed="    n = fields.Char('N', default=lambda s: fields.date.today())"),
    line("    m = fields.Char('fields.char(', help=\"it's fields.text\")"),
    _hit("    def work(self):", "PERF001"),
    _hit("        self.env.cr.commit()", "BAD005", fixed="        pass" + _COMMIT),
    line("        x = {z}"),
    _hit("        self.env.cr.commit(); y = x", "BAD005", when="z % 2 = 0", fixed="        pass; y = x" + _COMMIT),
    _hit("        a = self.sudo().env['a']", "SEC002"),
    _hit("        b = self.sudo().browse(5)", "SEC002", "BAD001"),
    _hit("        c = self.browse([6])", "BAD001", when="z % 3 = 0"),
    _hit('        self.env.cr.execute("SELECT a FROM t WHERE b = %s" % x)', "SEC001",
         fixed='        self.env.cr.execute("SELECT a FROM t WHERE b = %s", (x,))'),
    line("        q = 'SELECT a FROM t WHERE b = %s' % x"),
    _hit("        self.env.cr.execute(q)", "SEC001", fixed="        self.env.cr.execute(q)" + _BOUND),
    line("        self.env.cr.execute('SELECT 1', (x,))"),
    _hit("        self.env.cr.execute('SELECT {{}}'.format(x))", "SEC001", when="z % 5 <> 0",
         fixed="        self.env.cr.execute('SELECT %s', (x,))"),
    line("        for r in self:"),
    _hit("            r.write({{'a': x}})", "PERF004"),
    _hit("            r.sudo().read()", "SEC002", "PERF004"),
    _hit("            self.env['b'].search([])", "PERF003"),
    line("            self.env['b'].search([], limit=1)"),
    _hit("        self.env['c'].search([('d', '=', 1)])", "PERF003", when="z % 4 = 0"),
    line("        try:"),
    line("            self.go()"),
    _hit("        except:", "BAD002", fixed="        except Exception as e:\n" + _LOGGED),
    line("            # nothing to do"),
    line("            pass"),
    line("        try:"),
    line("            self.go()"),
    _hit("        except Exception: return x", "BAD002",
         fixed="        except Exception as e:\n" + _LOGGED + "\n            return x"),
    line("        except ValueError:"),
    line("            pass"),
]
FILES = {"hits": (SOURCE_SQL, "true", "{mod}/models/h_{k}.py", HITS, "z % 17 = 0")}


def _found(c: Corpus):
    def build():
        files = derived_files(c.spark, c.sf_dir, spread, FILES).transform(classify)
        return c.kept("hit_files", lambda: files)

    def issues():
        items = c.kept("hit_items", lambda: python_source.class_items(build()))
        tables = {"methods": entities.methods(items), "fields": entities.fields(items), "items": items}
        return rules.detect(tables, _RULES)

    return build(), c.kept("hit_issues", issues)


_LINES = f"hl AS ({lines_sql('hits', FILES)})"


@query("all_hits", f"""
  WITH {_LINES}
  SELECT repo, path AS file, line, r.rule_id AS rule_id, r.entity AS entity,
         CASE r.rule_id WHEN 'PERF001' THEN 'for ... loop in work' WHEN 'SEC002' THEN 'self.sudo()'
              WHEN 'BAD002' THEN 'except:' WHEN 'BAD005' THEN 'self.env.cr.commit()'
              WHEN 'DEP007' THEN 'n = fields.char' ELSE trim(text) END AS code
  FROM (SELECT repo, path, CAST(line_no AS INTEGER) AS line, x.text AS text, unnest(x.rules) AS r FROM hl)
""")
def all_hits(c: Corpus):
    """Every place of every rule about a place in a body."""
    return _found(c)[1].select("repo", "file", "line", "rule_id", "entity", "code")


@query("rewritten_files", f"""
  WITH {_LINES}
  SELECT repo, path, string_agg(coalesce(x.a, x.text), chr(10) ORDER BY line_no) AS fixed_content
  FROM hl GROUP BY repo, path
""")
def rewritten_files(c: Corpus):
    """Whole rewritten files, several rewrites of one rule in a method."""
    files, issues = _found(c)
    return fixes.fix_corpus(files, issues).select("repo", "path", "fixed_content")


@query("hit_ids", f"""
  WITH {_LINES}
  SELECT count(*) AS n, count(*) AS different
  FROM (SELECT unnest(x.rules) FROM hl)
""")
def hit_ids(c: Corpus):
    """Ids of findings are unique over the whole corpus."""
    return _found(c)[1].agg(F.count("*").alias("n"), F.count_distinct("id").alias("different"))
