"""Queries over findings: every rule, wording, filters, rewrites."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from addonscope.operators import fixes, review, rules, search
from addonscope.rule_texts import CATALOGUE, DEFAULT_RULES, EXPLANATIONS, FINDINGS, LEVELS
from addonscope.sources import sinks
from addonscope.session import work_dir
from workload.expected import FINDINGS as ALL_FINDINGS
from workload.corpus import lines_sql
from workload.expected import ISSUE_ID, values_sql
from workload.registry import Corpus, query

_LEVELS = values_sql([(r, *levels) for r, levels in LEVELS.items()], "rule_id, severity, category")
_DEFAULT = ", ".join(f"'{r}'" for r in DEFAULT_RULES)

# Findings with id and levels.
ISSUES = f"""
{ALL_FINDINGS},
iss AS (SELECT {ISSUE_ID} AS id, fi.rule_id, severity, category, repo, file, line, entity
        FROM fi JOIN {_LEVELS} USING (rule_id))
"""
_COLUMNS = ["id", "rule_id", "severity", "category", "repo", "file", "line", "entity"]


@query("issues", f"WITH {ISSUES} SELECT * FROM iss WHERE rule_id IN ({_DEFAULT})")
def issues(c: Corpus):
    return rules.detect(c.entities).select(*_COLUMNS)


def _one_rule(rule_id: str):
    sql = f"WITH {ISSUES} SELECT * FROM iss WHERE rule_id = '{rule_id}'"

    @query(f"rule_{rule_id.lower()}", sql)
    def one(c: Corpus):
        return rules.detect(c.entities, [rule_id]).select(*_COLUMNS)


for _rule_id in CATALOGUE:
    _one_rule(_rule_id)


_WORDS = values_sql(
    [
        (r, lang, *texts)
        for lang, table in (("en", CATALOGUE), ("id", {**CATALOGUE, **FINDINGS}))
        for r, texts in table.items()
    ],
    "rule_id, lang, title, description, suggestion",
)


@query("rule_catalogue", f"""
  WITH {ISSUES},
  ct AS (SELECT rule_id, count(*) AS n, count(DISTINCT repo) AS n_repos FROM iss WHERE rule_id IN ({_DEFAULT})
         GROUP BY rule_id)
  SELECT rule_id, lang, v.severity, v.category, title, description, suggestion,
         coalesce(n, 0) AS n, coalesce(n_repos, 0) AS n_repos
  FROM {_WORDS} JOIN {_LEVELS.replace("AS t(", "AS v(")} USING (rule_id) LEFT JOIN ct USING (rule_id)
""")
def rule_catalogue(c: Corpus):
    """The catalogue with how often each rule is found in the corpus."""
    counts = c.issues.groupBy("rule_id").agg(
        F.count("*").alias("n"), F.count_distinct("repo").alias("n_repos")
    )
    return rules.rule_catalogue(c.spark).join(counts, "rule_id", "left").fillna(0, ["n", "n_repos"])


@query("issues_english", f"""
  WITH {ISSUES}
  SELECT id, title, description, suggestion
  FROM iss JOIN {_WORDS} USING (rule_id) WHERE lang = 'en' AND rule_id IN ({_DEFAULT})
""")
def issues_english(c: Corpus):
    return rules.localize_issues(c.issues, "en").select(
        "id", "title", "description", "suggestion"
    )


def _worded(column: str) -> str:
    """The wording with the names of the finding filled in."""
    out = column
    for brace, value in (
        ("{method}", "entity"), ("{model}", "entity"), ("{field}", "entity"),
        ("{type}", "raw"), ("{capital}", "upper(left(raw, 1)) || substr(raw, 2)"),
    ):
        out = f"replace({out}, '{brace}', {value})"
    return out


_RAW = """CASE entity WHEN 'code' THEN 'char' WHEN 'owner_id' THEN 'many2one' WHEN 'name' THEN 'char'
               ELSE '' END"""
_TEXT = f"""
{ISSUES},
worded AS (
  SELECT i.*, {_worded("title")} AS title, {_worded("description")} AS description,
         {_worded("suggestion")} AS suggestion
  FROM (SELECT *, {_RAW} AS raw FROM iss WHERE rule_id IN ({_DEFAULT})) i
  JOIN {_WORDS} USING (rule_id) WHERE lang = 'id')
"""


@query("issues_wording", f"WITH {_TEXT} SELECT id, title, description, suggestion FROM worded")
def issues_wording(c: Corpus):
    return c.issues.select("id", "title", "description", "suggestion")


@query("filter_issues", f"""
  WITH {_TEXT}
  SELECT id FROM worded
  WHERE severity = 'warning' AND category = 'data_integrity'
    AND (contains(lower(title), 'partner') OR contains(lower(description), 'partner')
         OR contains(lower(rule_id), 'partner'))
""")
def filter_issues(c: Corpus):
    return search.filter_issues(
        c.issues, severity="warning", category="data_integrity", search="Partner"
    ).select("id")


@query("filter_critical", f"WITH {ISSUES} SELECT id FROM iss WHERE severity = 'critical' "
       f"AND rule_id IN ({_DEFAULT})")
def filter_critical(c: Corpus):
    return search.filter_issues(c.issues, severity="critical").select("id")


@query("distinct_files", f"WITH {ISSUES} SELECT DISTINCT repo, file FROM iss "
       f"WHERE rule_id IN ({_DEFAULT})")
def distinct_files(c: Corpus):
    return search.distinct_files(c.issues)


@query("distinct_categories", f"WITH {ISSUES} SELECT DISTINCT category FROM iss "
       f"WHERE rule_id IN ({_DEFAULT})")
def distinct_categories(c: Corpus):
    return search.distinct_categories(c.issues)


@query("report_order", f"""
  WITH {ISSUES}
  SELECT id, row_number() OVER (ORDER BY CASE severity WHEN 'critical' THEN 1 WHEN 'warning' THEN 2
           ELSE 3 END, repo, file, line, rule_id, id) AS pos
  FROM iss WHERE rule_id IN ({_DEFAULT})
""")
def report_order(c: Corpus):
    """Position of each issue in report order."""
    ranked = c.issues.withColumn("rank", search.severity_rank())
    return review.dense_numbers(
        ranked, ["rank", "repo", "file", "line", "rule_id", "id"]
    ).select("id", F.col("number").alias("pos"))


@query("bottom_up", f"""
  WITH {ISSUES}
  SELECT repo, file, count(*) AS n, max(line) AS last_line, min(line) AS first_line
  FROM iss WHERE rule_id IN ({_DEFAULT}) GROUP BY repo, file
""")
def bottom_up(c: Corpus):
    return search.bottom_up(c.issues).groupBy("repo", "file").agg(
        F.count("*").alias("n"), F.first("line").alias("last_line"),
        F.last("line").alias("first_line"),
    )


# -------------------------------------------------------------------- rewrites

_NOTED = [r for r in DEFAULT_RULES if r not in EXPLANATIONS and r not in ("SEC003", "MIS001")]


@query("noted_fixes", f"""
  WITH {_TEXT}
  SELECT w.repo, w.id AS issue_id, w.rule_id, w.file, w.line,
         regexp_extract(p.text, '^[ \\t]*') || '# [' || w.rule_id || '] PERHATIAN: '
           || w.suggestion AS note
  FROM worded w JOIN py p ON p.path = w.file AND p.repo = w.repo AND p.line = w.line
  WHERE w.rule_id IN ({", ".join(f"'{r}'" for r in _NOTED)})
""")
def noted_fixes(c: Corpus):
    """Rewrites that put a note above the line."""
    return fixes.applied_fixes(c.fixed).where(F.col("rule_id").isin(_NOTED)).select(
        "repo", "issue_id", "rule_id", "file", "line",
        F.substring_index("fixed", "\n", 1).alias("note"),
    )


_BLOCK = "'    partner_id = fields.Many2one(' || chr(10) || '        ''res.partner'',  # the ) partner, \"quoted' || chr(10) || '        string=''Partner: ' || pname || ''''"


@query("line_fixes", f"""
  WITH {_TEXT},
  hit AS (SELECT i.rule_id, i.repo, i.file, i.line, i.entity, i.suggestion, p.text, p.pname, p.z
          FROM worded i JOIN py p ON p.path = i.file AND p.repo = i.repo AND p.line = i.line)
  SELECT repo, rule_id, file, line,
    CASE rule_id
      WHEN 'DEP001' THEN ''
      WHEN 'DEP002' THEN
        '    # FIXED: Dekorator @api.one dihapus. Gunakan perulangan di dalam method.'
      WHEN 'DEP004' THEN replace(text, 'osv.osv', 'models.Model')
      WHEN 'DEP007' THEN CASE WHEN entity = 'owner_id'
        THEN '        ''owner_id'': fields.Many2one(''res.users'', ''Owner'', ondelete=''set null''),'
        ELSE replace(replace(text, 'fields.char', 'fields.Char'), 'fields.many2one',
                                 'fields.Many2one') END
      WHEN 'BAD001' THEN '        # [BAD001] PERHATIAN: ' || suggestion || chr(10) || text
      WHEN 'BAD002' THEN '        except Exception as e:' || chr(10)
        || '            _logger.exception(''Terjadi error: %s'', str(e))'
      WHEN 'BAD005' THEN
        '        pass  # DIHAPUS: self.env.cr.commit() - Odoo mengelola transaksi secara otomatis'
      WHEN 'SEC001' THEN CASE WHEN z % 13 = 0
        THEN '        self.env.cr.execute("SELECT * FROM t WHERE id = %s", (self.id,))'
        ELSE text || '  # FIXED: Gunakan parameterized query di sini untuk mencegah SQL Injection!'
        END
      WHEN 'DAT001' THEN CASE WHEN entity = 'owner_id'
        THEN '        ''owner_id'': fields.many2one(''res.users'', ''Owner'', ondelete=''set null''),'
        ELSE {_BLOCK} || ', ondelete=''set null''' || chr(10) || '    )' END
    END AS fixed
  FROM hit
  WHERE rule_id IN ('DEP001', 'DEP002', 'DEP004', 'DEP007', 'BAD001', 'BAD002', 'BAD005', 'SEC001', 'DAT001')
""")
def line_fixes(c: Corpus):
    """Rewrites of the line or statement itself.

    The owner field of a legacy dictionary has two findings on one line; the
    second of them starts from the line the first one left.
    """
    direct = ["DEP001", "DEP002", "DEP004", "DEP007", "BAD001", "BAD002", "BAD005", "SEC001", "DAT001"]
    return fixes.applied_fixes(c.fixed).where(F.col("rule_id").isin(direct)).select(
        "repo", "rule_id", "file", "line", "fixed"
    )


@query("license_fixes", f"""
  WITH {ALL_FINDINGS}
  SELECT repo, file, '# -*- coding: utf-8 -*-' || chr(10) || '# {{''not'': ''the dict''}}' || chr(10)
         || '{{' || chr(10) || '    ''license'': ''LGPL-3'',' AS fixed
  FROM fi WHERE rule_id = 'MIS003'
""")
def license_fixes(c: Corpus):
    return fixes.applied_fixes(c.fixed).where("rule_id = 'MIS003'").select("repo", "file", "fixed")


@query("fixes_per_file", f"""
  WITH {ISSUES}
  SELECT repo, file AS path, CAST(count(*) AS INTEGER) AS fix_count
  FROM iss WHERE rule_id IN ({_DEFAULT}) AND rule_id NOT IN ('SEC003', 'MIS001')
  GROUP BY repo, file
""")
def fixes_per_file(c: Corpus):
    return fixes.fixes_per_file(c.fixed)


@query("first_fix", f"""
  WITH {ISSUES},
  done AS (SELECT * FROM iss WHERE rule_id IN ({_DEFAULT})
           AND rule_id NOT IN ('SEC003', 'MIS001'))
  SELECT id, rule_id, min(file) AS fix_file, min(line) AS fix_line FROM done
  GROUP BY repo, id, rule_id
""")
def first_fix(c: Corpus):
    return fixes.first_fix(c.issues, fixes.applied_fixes(c.fixed)).select(
        "id", "rule_id", "fix_file", "fix_line"
    )


_RENDERED = f"""
  WITH {ALL_FINDINGS}
  SELECT repo, path AS file, line,
         CASE WHEN text LIKE '%_columns = %' THEN
           '    # ''gone'': fields.char(''Gone''),' || chr(10)
           || '    code = fields.Char(''Code'', size=64)' || chr(10)
           || '    owner_id = fields.Many2one(''res.users'', ''Owner'', ondelete=''set null'')'
         ELSE
           '    @api.model' || chr(10) || '    def default_get(self, fields_list):' || chr(10)
           || '        res = super().default_get(fields_list)' || chr(10)
           || '        res.update({{' || chr(10)
           || '            ''code'': ''x' || CAST(k AS STRING) || ', y'',' || chr(10)
           || '        }})' || chr(10) || '        return res'
         END AS fixed
  FROM py WHERE z % 20 = 0 AND (text LIKE '%\\_columns = %' ESCAPE '\\'
                                OR text LIKE '%\\_defaults = %' ESCAPE '\\')
"""


@query("block_fixes", _RENDERED)
def block_fixes(c: Corpus):
    """Legacy dictionaries rewritten as declarations and as a ``default_get`` override."""
    found = rules.detect(c.entities, [*DEFAULT_RULES, "DEP005", "DEP006"])
    fixed = fixes.fix_corpus(c.files, found)
    return fixes.applied_fixes(fixed).where("rule_id IN ('DEP005', 'DEP006')").select(
        "repo", "file", "line", "fixed"
    )


@query("diff_lines", """
  WITH a AS (SELECT doc_id, generate_subscripts(l, 1) AS line_no, unnest(l) AS t
             FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) q),
  b AS (SELECT doc_id, generate_subscripts(l, 1) AS line_no, unnest(l) AS t
        FROM (SELECT doc_id, string_split(replace(replace(text, '. ', chr(10)), lang, ''), chr(10))
                AS l FROM documents) q),
  j AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.line_no, b.line_no) AS line_no,
               coalesce(a.t, '') AS original, coalesce(b.t, '') AS fixed
        FROM a FULL OUTER JOIN b ON a.doc_id = b.doc_id AND a.line_no = b.line_no)
  SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, original, fixed,
         CASE WHEN original = fixed THEN 'same' WHEN original <> '' AND fixed = '' THEN 'removed'
              WHEN original = '' AND fixed <> '' THEN 'added' ELSE 'modified' END AS change
  FROM j
""")
def diff_lines(c: Corpus):
    """Documents against a rewritten form of themselves."""
    rows = c.table("documents").select(
        F.lit("documents").alias("repo"),
        F.col("doc_id").alias("path"),
        F.col("text").alias("original_content"),
        F.replace(F.replace("text", F.lit(". "), F.lit("\n")), F.col("lang"), F.lit("")).alias(
            "fixed_content"
        ),
    )
    return fixes.diff_lines(rows).drop("repo").withColumnRenamed("path", "doc_id")


# ----------------------------------------------------------------------- sinks


def _out(c: Corpus, name: str) -> str:
    import uuid

    return f"{work_dir(c.spark)}/{c.spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


_SLUG = {t: re.sub("[^a-z]", "_", t.lower()) for t in sinks.ISSUE_HEADERS["en"]}


@query("issues_csv", f"""
  WITH {ISSUES}
  SELECT rule_id AS issue_id, severity, category, title, description, file,
         CAST(line AS STRING) AS line, suggestion
  FROM iss JOIN {_WORDS} USING (rule_id) WHERE lang = 'en' AND rule_id IN ({_DEFAULT})
""")
def issues_csv(c: Corpus):
    """The exported CSV, read back."""
    path = _out(c, "issues-csv")
    sinks.write_issues_csv(c.issues, path, "en")
    rows = c.spark.read.csv(path, header=True, quote='"', escape='"')
    return rows.select(*[F.col(t).alias(slug) for t, slug in _SLUG.items()])


@query("issues_json", f"WITH {ISSUES} SELECT id, severity, file, line FROM iss "
       f"WHERE rule_id IN ({_DEFAULT})")
def issues_json(c: Corpus):
    """The JSON dump, read back."""
    path = _out(c, "json")
    sinks.write_json({"issues": c.issues, "models": c.entities["models"]}, path)
    return c.spark.read.schema("id STRING, severity STRING, file STRING, line INT").json(
        f"{path}/issues"
    )


@query("report_tables", f"""
  WITH {ISSUES}
  SELECT 'issues' AS sheet, count(*) AS n FROM iss WHERE rule_id IN ({_DEFAULT})
  UNION ALL SELECT 'models', count(*) FROM py WHERE kind = 'class'
  UNION ALL SELECT 'summary', 10 * count(DISTINCT repo) FROM mo
    WHERE s IN (SELECT s FROM py) OR has_manifest OR s % 2 = 0
""")
def report_tables(c: Corpus):
    """Row counts of the three written sheets."""
    from addonscope.operators import stats

    path = _out(c, "report")
    e = c.entities
    sinks.write_report_tables(
        c.stats, c.issues, stats.model_inventory(e["models"], e["fields"], e["methods"]), path, "en"
    )
    sheets = [
        c.spark.read.parquet(f"{path}/{name}").agg(F.count("*").alias("n")).select(
            F.lit(name).alias("sheet"), "n")
        for name in ("summary", "issues", "models")
    ]
    return sheets[0].unionByName(sheets[1]).unionByName(sheets[2])


_NOTES = [r for r in DEFAULT_RULES if r not in (
    "SEC003", "MIS001", "MIS003", "DEP001", "DEP002", "DEP004", "DEP007", "SEC001", "BAD002", "BAD005", "DAT001")]


@query("fixed_files", f"""
  WITH {_TEXT},
  ds AS (SELECT * FROM worded WHERE rule_id IN ({_DEFAULT}) AND rule_id NOT IN ('SEC003', 'MIS001')),
  fx AS (
    SELECT d.repo, d.file, d.line, list(d.rule_id) AS rs, list(d.entity) AS es,
           string_agg(regexp_extract(p.text, '^[ \\t]*') || '# [' || d.rule_id || '] PERHATIAN: ' || d.suggestion
                      || chr(10), '' ORDER BY d.rule_id DESC)
             FILTER (d.rule_id IN ({", ".join(f"'{r}'" for r in _NOTES)})) AS notes
    FROM ds d JOIN py p ON p.repo = d.repo AND p.path = d.file AND p.line = d.line
    GROUP BY d.repo, d.file, d.line),
  ln AS (
    SELECT p.repo, p.path, p.line, p.text, p.pname, p.z, notes, coalesce(rs, []) AS rs, coalesce(es, []) AS es
    FROM py p LEFT JOIN fx ON fx.repo = p.repo AND fx.file = p.path AND fx.line = p.line
    WHERE EXISTS (SELECT 1 FROM ds WHERE ds.repo = p.repo AND ds.file = p.path)),
  nw AS (
    SELECT repo, path, line, CASE
      WHEN list_contains(rs, 'DEP001') THEN NULL
      ELSE coalesce(notes, '') || CASE
        WHEN list_contains(rs, 'DEP002') THEN
          '    # FIXED: Dekorator @api.one dihapus. Gunakan perulangan di dalam method.'
        WHEN list_contains(rs, 'DEP004') THEN replace(text, 'osv.osv', 'models.Model')
        WHEN list_contains(es, 'owner_id') THEN
          '        ''owner_id'': fields.Many2one(''res.users'', ''Owner'', ondelete=''set null''),'
        WHEN list_contains(rs, 'DEP007') THEN replace(text, 'fields.char', 'fields.Char')
        WHEN list_contains(rs, 'BAD002') THEN '        except Exception as e:' || chr(10)
          || '            _logger.exception(''Terjadi error: %s'', str(e))'
        WHEN list_contains(rs, 'BAD005') THEN
          '        pass  # DIHAPUS: self.env.cr.commit() - Odoo mengelola transaksi secara otomatis'
        WHEN list_contains(rs, 'SEC001') AND z % 13 = 0 THEN
          '        self.env.cr.execute("SELECT * FROM t WHERE id = %s", (self.id,))'
        WHEN list_contains(rs, 'SEC001') THEN
          text || '  # FIXED: Gunakan parameterized query di sini untuk mencegah SQL Injection!'
        WHEN text = '        string=''Partner: ' || pname || ''',' AND z % 3 <> 0 THEN
          rtrim(text, ',') || ', ondelete=''set null'''
        ELSE text END
      END AS text
    FROM ln),
  ml AS ({lines_sql("manifest")}),
  mf AS (SELECT repo, file FROM ds WHERE rule_id = 'MIS003')
  SELECT repo, path, string_agg(text, chr(10) ORDER BY line) AS fixed_content FROM nw GROUP BY repo, path
  UNION ALL
  SELECT m.repo, m.path, string_agg(
           x.text || CASE WHEN x.text = '{{' THEN chr(10) || '    ''license'': ''LGPL-3'',' ELSE '' END,
           chr(10) ORDER BY line_no)
  FROM ml m JOIN mf ON mf.repo = m.repo AND mf.file = m.path GROUP BY m.repo, m.path
""")
def fixed_files(c: Corpus):
    """Whole rewritten files as written, read back."""
    path = _out(c, "fixed")
    sinks.write_fixed_files(c.fixed, path)
    return c.spark.read.parquet(path).select("repo", "path", "fixed_content")


@query("registered_rule", f"""
  WITH {ALL_FINDINGS}
  SELECT 'OWN001_' || repo AS place, path AS file, line, name AS field, 'warning' AS severity, 'Own rule' AS title,
         pname || ': stored without index' AS description
  FROM py WHERE kind = 'field' AND name = 'amount' AND z % 2 = 0
""")
def registered_rule(c: Corpus):
    """Findings of a rule that a user registers: a stored computed number."""
    own: dict[str, rules.Rule] = {}
    param = lambda key: F.try_element_at("params", F.lit(key))
    rules.register_rule(
        "OWN001", "field", (F.col("type") == "Float") & (param("store") == "True") & param("compute").isNotNull(),
        "warning", "performance", "Own rule", "stored without index", "add an index", code=F.col("name"), rules=own,
    )
    c.table("part").createOrReplaceTempView("part")
    names = c.table("part").select(
        F.concat(F.lit("m_"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("name"), "p_name"
    )
    found = rules.detect(c.entities, ["OWN001"], own).withColumn("name", F.element_at(F.split("file", "/"), -1))
    return found.join(names, "name").select(
        F.concat("rule_id", F.lit("_"), "repo").alias("place"), "file", "line", F.col("code").alias("field"), "severity",
        "title", F.concat("p_name", F.lit(": "), "description").alias("description"),
    )
