"""SQL building blocks that the expected results share."""

from __future__ import annotations

from workload.corpus import HAS_MANIFEST, SOURCE_SQL, SUPPLIER_SQL, lines_sql

MODEL = (
    "CASE z % 7 WHEN 0 THEN 'part.model.' || CAST(prev AS STRING) "
    "WHEN 2 THEN 'part' || CAST(k AS STRING) || 'model' "
    "ELSE 'part.model.' || CAST(k AS STRING) END"
)

# Every line of the Python files with its class, model and enclosing method.
PY = f"""
pl0 AS ({lines_sql("python")}),
pl1 AS (
  SELECT *, count(*) FILTER (x.kind = 'class') OVER w AS cls,
         max(line_no) FILTER (x.kind = 'class') OVER w AS class_line,
         max(line_no) FILTER (x.kind = 'method') OVER w AS method_line
  FROM pl0 WINDOW w AS (PARTITION BY path ORDER BY line_no)),
py AS (
  SELECT repo, path, k, z, s, nat, n, prev, above, mod, pname, ptype,
         CAST(line_no AS INTEGER) AS line, CAST(class_line AS INTEGER) AS class_line,
         CAST(method_line AS INTEGER) AS method_line, cls,
         x.text AS text, x.kind AS kind, x.name AS name, x.a AS a, x.b AS b, x.c AS c, x.d AS d,
         x.e AS e, x.f AS f, x.rules AS rules,
         CASE cls WHEN 1 THEN {MODEL} WHEN 2 THEN 'part.line.' || CAST(k AS STRING) END AS model
  FROM pl1)
"""

# Parts and suppliers as the derived files see them.
PARTS = f"pt AS ({SOURCE_SQL})"
SUPPLIERS = f"sp AS (SELECT *, ({HAS_MANIFEST}) AS has_manifest FROM ({SUPPLIER_SQL}) z)"

# Module of every folder below addons/mod_<s>: its own, or where that has no
# manifest the longest (then smallest) module path of its repository, or ''.
MODULE_OF = f"""
{SUPPLIERS},
rt AS (SELECT repo, mod FROM sp WHERE has_manifest),
lg AS (SELECT repo, mod AS longest FROM rt
       QUALIFY row_number() OVER (PARTITION BY repo ORDER BY length(mod) DESC, mod) = 1),
mo AS (SELECT sp.s, sp.nat, sp.repo, sp.mod, sp.has_manifest,
              CASE WHEN has_manifest THEN sp.mod ELSE coalesce(longest, '') END AS module_path
       FROM sp LEFT JOIN lg ON lg.repo = sp.repo)
"""

_PY_FINDINGS = """
  SELECT repo, path AS file, line, r.rule_id AS rule_id,
         coalesce(r.entity, model) AS entity, k, z, pname,
         CASE WHEN r.rule_id = 'DEP001' THEN a END AS unused
  FROM (SELECT *, unnest(rules) AS r FROM py)
"""

# Models with a name of their own: (repo, path, class line, model, module, guarded, ruled).
OWN_MODELS = f"""
om AS (
  SELECT py.repo, py.path, py.line, py.model, py.name AS class_name, mo.module_path,
         CASE cls WHEN 1 THEN z % 3 <> 1 ELSE z % 16 = 0 END AS guarded,
         cls = 1 AND z % 4 = 0 AS ruled
  FROM py JOIN mo ON mo.s = py.s
  WHERE kind = 'class' AND (cls = 2 OR z % 7 NOT IN (0, 2)))
"""

# All findings of all rules: (repo, file, line, rule_id, entity).
FINDINGS = f"""
{PY}, {MODULE_OF}, {OWN_MODELS},
md AS (SELECT DISTINCT repo, module_path FROM mo),
fi AS (
  SELECT repo, file, line, rule_id, entity FROM ({_PY_FINDINGS})
  UNION ALL
  SELECT repo, CASE WHEN module_path = '' THEN '' ELSE module_path || '/' END
           || 'security/ir.model.access.csv', 1, 'SEC003', model
  FROM om WHERE NOT guarded
  UNION ALL
  SELECT repo, path, line, 'SEC004', model FROM om WHERE NOT ruled
  UNION ALL
  SELECT repo, '__manifest__.py', 1, 'MIS001', 'unknown_module'
  FROM md WHERE module_path = ''
  UNION ALL
  SELECT repo, mod || '/__manifest__.py', 1, 'MIS003', 'mod_' || CAST(s AS STRING)
  FROM sp WHERE has_manifest AND s % 3 = 0)
"""

ISSUE_ID = (
    "rule_id || '_' || regexp_replace(repo, '[^a-zA-Z0-9]', '_', 'g') || '_' || "
    "regexp_replace(file, '[^a-zA-Z0-9]', '_', 'g') || '_' || "
    "CAST(line AS STRING) || '_' || regexp_replace(entity, '[^a-zA-Z0-9]', '_', 'g') || '_' || "
    "left(md5(repo || '|' || file || '|' || entity), 8)"
)


def values_sql(rows: list[tuple], columns: str) -> str:
    """A VALUES table of strings."""
    def quoted(v) -> str:
        return "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"

    body = ", ".join("(" + ", ".join(quoted(v) for v in row) + ")" for row in rows)
    return f"(VALUES {body}) AS t({columns})"
