"""Queries over relations, flows, menus, dependencies and their diagrams."""

from __future__ import annotations

from pyspark.sql import functions as F

from addonscope.fixed_values import (
    CARDINALITY,
    DEFAULT_CARDINALITY,
    DIAGRAM_FIELD_CAP,
    DIAGRAM_TYPES,
    REPORT_RELATION_CAP,
    STATE_CATEGORIES,
)
from addonscope.operators import dependencies, graph, search
from workload.entity_queries import _FIELDS, _STATES, MENUS
from workload.expected import MODULE_OF, PARTS, PY
from workload.registry import Corpus, query
from workload.rule_queries import _TEXT


def _as_cte(sql: str, name: str) -> str:
    """The select over the lines of the Python files as one more CTE."""
    return f"{name} AS ({sql[sql.index(PY) + len(PY):]})"


_F = _as_cte(_FIELDS, "fd")
_S = _as_cte(_STATES, "st")

# Edges as (repo, path, from_model, to_model, type, field, label).
_EDGES = f"""
{PY}, {_F},
ed AS (
  SELECT repo, path, model AS from_model, comodel_name AS to_model, lower(type) AS type,
         name AS field, name || ' (' || lower(type) || ')' AS label
  FROM fd WHERE comodel_name IS NOT NULL
  UNION ALL
  SELECT repo, path, model, p, 'inherit', '_inherit', 'Inherits'
  FROM (SELECT repo, path, model, unnest(CASE z % 7 WHEN 0 THEN ['part.model.' || CAST(prev AS STRING)]
                                       WHEN 1 THEN ['mail.thread', 'part.base'] ELSE [] END) AS p
        FROM py WHERE kind = 'class' AND cls = 1) q
  UNION ALL
  SELECT repo, path, model, 'res.users', 'inherits', 'user_id', 'Delegates (user_id)'
  FROM py WHERE kind = 'class' AND cls = 1 AND z % 21 = 1)
"""


@query("relationships", f"WITH {_EDGES} SELECT * FROM ed")
def relationships(c: Corpus):
    return c.relationships


_FLOWS = """
fl AS (SELECT repo, path, model, class_line, z, ptype,
              CASE WHEN z % 5 <> 0 THEN pname || ' model' ELSE model END AS name,
              CASE WHEN z % 12 = 0 THEN 'draft|' || ptype || '|done'
                   ELSE 'draft|validate_' || CAST(z AS STRING) END AS states,
              CASE WHEN z % 12 = 0 THEN 'document_lifecycle' ELSE 'approval' END AS type
       FROM py WHERE kind = 'field' AND name = 'state')
"""


@query("flows", f"WITH {PY}, {_FLOWS} SELECT repo, path, model, name, states, type FROM fl")
def flows(c: Corpus):
    return c.flows.select(
        "repo", "path", "model", "name",
        F.array_join(F.transform("states", lambda s: s["value"]), "|").alias("states"), "type",
    )


@query("flows_for_model", f"""
  WITH {PY}, {_FLOWS}
  SELECT repo, path, name, type FROM fl
  WHERE model = (SELECT min(model) FROM fl)
""")
def flows_for_model(c: Corpus):
    """The flow of the first model that has one."""
    first = c.flows.agg(F.min("model")).first()[0]
    return search.flows_for_model(c.flows, first).select("repo", "path", "name", "type")


# action_done writes 'done'; its name asks for the second state as source,
# unless it compares with a state first.
_MOVES = f"""
{PY}, {_FLOWS},
mv AS (SELECT fl.repo, fl.path, fl.model, fl.class_line,
              CASE WHEN fl.z % 18 = 0 THEN fl.ptype
                   WHEN fl.z % 12 = 0 THEN fl.ptype
                   ELSE 'validate_' || CAST(fl.z AS STRING) END AS from_state,
              'done' AS to_state, py.name AS method, py.name || '()' AS label
       FROM fl JOIN py ON py.path = fl.path AND py.kind = 'method' AND py.name = 'action_done')
"""


@query("transitions", f"WITH {_MOVES} SELECT repo, path, model, from_state, to_state, method, label "
       "FROM mv")
def transitions(c: Corpus):
    return c.transitions.select(
        "repo", "path", "model", "from_state", "to_state", "method", "label"
    )


_CATEGORY = "CASE " + " ".join(
    f"WHEN lower(value) IN ({', '.join(repr(m) for m in members)}) THEN '{name}'"
    for name, members in STATE_CATEGORIES.items()
) + " END"


@query("state_nodes", f"""
  WITH {PY}, {_S}
  SELECT repo, path, model, pos, value, label, {_CATEGORY} AS category, pos = 0 AS is_start,
         value = 'done' AS is_end FROM st
""")
def state_nodes(c: Corpus):
    return graph.state_nodes(c.flows).drop("class_line")


@query("state_diagrams", f"""
  WITH {_MOVES},
  sm AS (SELECT fl.*, CASE WHEN z % 12 = 0 THEN ptype ELSE 'validate_' || CAST(z AS STRING) END AS mid
         FROM fl)
  SELECT sm.repo, sm.path, sm.model,
    'stateDiagram-v2' || chr(10) || '    %% State diagram for ' || sm.model || chr(10)
    || '    draft : Draft' || chr(10)
    || '    ' || mid || ' : ' || CASE WHEN z % 12 = 0 THEN 'Busy' ELSE 'Check' END || chr(10)
    || CASE WHEN z % 12 = 0 THEN '    done : Done' || chr(10) ELSE '' END || chr(10)
    || '    classDef draftStyle fill:#6b7280,stroke:#9ca3af,color:#f3f4f6' || chr(10)
    || '    classDef activeStyle fill:#3b82f6,stroke:#60a5fa,color:#eff6ff' || chr(10)
    || '    classDef doneStyle fill:#10b981,stroke:#34d399,color:#ecfdf5' || chr(10)
    || '    classDef cancelStyle fill:#ef4444,stroke:#f87171,color:#fef2f2' || chr(10)
    || '    class draft draftStyle' || chr(10)
    || CASE WHEN z % 12 = 0 THEN '    class done doneStyle' || chr(10) ELSE '' END
    || chr(10) || '    [*] --> draft : Create' || chr(10)
    || '    ' || from_state || ' --> done : action_done()'
    || CASE WHEN z % 12 = 0 THEN chr(10) || '    done --> [*]' ELSE '' END AS text
  FROM sm JOIN mv ON mv.path = sm.path AND mv.model = sm.model
""")
def state_diagrams(c: Corpus):
    return graph.state_diagrams(c.flows, c.transitions).select("repo", "path", "model", "text")


_DIAGRAM_TYPE = "CASE lower(type) " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in DIAGRAM_TYPES.items()) + " ELSE 'string' END"


@query("er_rows", f"""
  WITH {_EDGES},
  rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY path, model ORDER BY line, name) AS INTEGER)
           AS pos FROM fd)
  SELECT repo, path, model, pos, {_DIAGRAM_TYPE} AS type, name FROM rk WHERE pos <= 8
""")
def er_rows(c: Corpus):
    return graph.er_rows(c.entities["models"], c.entities["fields"], DIAGRAM_FIELD_CAP).drop("class_line")


_ARROW = "CASE type " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in CARDINALITY.items()) + f" ELSE '{DEFAULT_CARDINALITY}' END"
_ER_LINES = f"""
  SELECT repo, 0 AS section, 'erDiagram' AS text FROM (SELECT DISTINCT repo FROM py) r
  UNION ALL
  SELECT repo, 1, '    ' || upper(replace(model, '.', '_')) || ' {{' FROM py WHERE kind = 'class'
  UNION ALL
  SELECT repo, 1, '    }}' FROM py WHERE kind = 'class'
  UNION ALL
  SELECT repo, 1, '        ' || {_DIAGRAM_TYPE} || ' ' || name
  FROM (SELECT *, row_number() OVER (PARTITION BY path, model ORDER BY line, name) AS pos FROM fd) q
  WHERE pos <= 8
  UNION ALL
  SELECT repo, 2, '    ' || upper(replace(from_model, '.', '_')) || ' ' || {_ARROW} || ' '
         || upper(replace(to_model, '.', '_')) || ' : ' || field FROM ed
"""


@query("er_edges", f"""
  WITH {_EDGES}
  SELECT repo, path, upper(replace(from_model, '.', '_')) AS from_id, {_ARROW} AS arrow,
         upper(replace(to_model, '.', '_')) AS to_id, field AS label FROM ed
""")
def er_edges(c: Corpus):
    return graph.er_edges(c.relationships)


@query("er_diagram", f"WITH {_EDGES} {_ER_LINES}")
def er_diagram(c: Corpus):
    return graph.er_diagram(
        c.entities["models"], c.entities["fields"], c.relationships, DIAGRAM_FIELD_CAP
    ).select("repo", "section", "text")


_MEMBERS = f"""
{PY}, {_F},
mb AS (
  SELECT repo, path, model, 1 AS section, line, name, 'field' AS kind,
         CASE WHEN compute IS NOT NULL THEN '#' ELSE '+' END AS visibility,
         CASE WHEN compute IS NOT NULL THEN '#' ELSE '+' END || type || ' ' || name
           || CASE WHEN required IS NOT NULL THEN ' *' ELSE '' END
           || CASE WHEN compute IS NOT NULL THEN ' [computed]' ELSE '' END AS text
  FROM fd
  UNION ALL
  SELECT repo, path, model, 2, line, name, 'method', CASE WHEN name LIKE '\\_%' ESCAPE '\\' THEN '-'
           ELSE '+' END,
         CASE WHEN name LIKE '\\_%' ESCAPE '\\' THEN '-' ELSE '+' END || name || '()'
           || CASE WHEN b <> '' THEN ' «' || replace(b, '|', ', ') || '»' ELSE '' END
  FROM py WHERE kind = 'method')
"""


@query("class_members", f"WITH {_MEMBERS} SELECT * FROM mb")
def class_members(c: Corpus):
    return graph.class_members(c.entities["fields"], c.entities["methods"]).drop("class_line")


_PASCAL = ("array_to_string(list_transform(string_split({m}, '.'), "
           "lambda p: upper(left(p, 1)) || substr(p, 2)), '')")


@query("class_diagrams", f"""
  WITH {_MEMBERS},
  tx AS (SELECT path, model, string_agg('        ' || text, chr(10) ORDER BY section, line, name)
           AS body FROM mb GROUP BY path, model),
  inh AS (SELECT repo, path, model, {_PASCAL.format(m="model")} AS own,
                 CASE WHEN cls = 2 THEN [] WHEN z % 7 = 0 THEN ['part.model.' || CAST(prev AS STRING)]
                      WHEN z % 7 = 1 THEN ['mail.thread', 'part.base'] ELSE [] END AS parents
          FROM py WHERE kind = 'class')
  SELECT inh.repo, inh.path, inh.model,
         'classDiagram' || chr(10) || '    class ' || own || ' {{' || chr(10) || body || chr(10)
         || '    }}' || array_to_string(list_transform(parents, lambda p:
              chr(10) || '    ' || {_PASCAL.format(m="p")} || ' <|-- ' || own || chr(10)
              || '    class ' || {_PASCAL.format(m="p")}), '') AS text
  FROM inh JOIN tx ON tx.path = inh.path AND tx.model = inh.model
""")
def class_diagrams(c: Corpus):
    e = c.entities
    return graph.class_diagrams(e["models"], e["fields"], e["methods"]).drop("class_line")


@query("edge_severity", f"""
  WITH {_TEXT}, {_FLOWS}, {_F},
  labels AS (
    SELECT repo, name AS label FROM fd WHERE comodel_name IS NOT NULL
    UNION SELECT repo, '_inherit' FROM py WHERE kind = 'class' AND cls = 1 AND z % 7 IN (0, 1)
    UNION SELECT repo, 'user_id' FROM py WHERE kind = 'class' AND cls = 1 AND z % 21 = 1
    UNION SELECT fl.repo, 'action_done()' FROM fl),
  code AS (
    SELECT w.*, CASE
      WHEN w.rule_id IN ('DAT001', 'PERF002', 'DEP007') THEN w.entity
      WHEN w.rule_id IN ('BAD003', 'BAD004', 'PERF001') THEN w.entity
      WHEN w.rule_id = 'SEC003' THEN w.entity
      WHEN w.rule_id = 'DEP001' THEN 'api.multi'
      WHEN w.rule_id = 'DEP002' THEN 'api.one'
      WHEN w.rule_id = 'DEP003' THEN 'api.returns(''self'', id)'
      WHEN w.rule_id = 'BAD005' THEN 'self.env.cr.commit()'
      WHEN w.rule_id = 'SEC002' THEN 'self.sudo()'
      WHEN w.rule_id = 'BAD002' THEN 'except:'
      WHEN w.rule_id IN ('SEC001', 'BAD001') THEN p.text ELSE '' END AS code
    FROM worded w LEFT JOIN py p ON p.path = w.file AND p.repo = w.repo AND p.line = w.line),
  texts AS (SELECT DISTINCT repo, severity,
                   lower(code || ' ' || rule_id || ' ' || description || ' ' || title) AS t
            FROM code)
  SELECT l.repo, l.label,
         coalesce(CASE min(CASE severity WHEN 'critical' THEN 1 WHEN 'warning' THEN 2 WHEN 'info' THEN 3
                  END) WHEN 1 THEN 'critical' WHEN 2 THEN 'warning' WHEN 3 THEN 'info' END, 'none')
           AS severity
  FROM labels l LEFT JOIN texts x ON x.repo = l.repo AND contains(x.t, lower(l.label))
  GROUP BY l.repo, l.label
""")
def edge_severity(c: Corpus):
    return graph.edge_severity(graph.diagram_edges(c.relationships, c.transitions), c.issues)


# ----------------------------------------------------------------------- menus

_NODES = f"""
{PARTS}, mn AS ({MENUS}),
nd AS (SELECT repo, id, name, parent, action, sequence,
              NOT (parent IN (SELECT id FROM mn)) AS is_root,
              NOT (id IN (SELECT parent FROM mn WHERE parent <> '')) AS is_leaf FROM mn),
mk AS (SELECT *, CASE WHEN is_root THEN 'root' WHEN is_leaf THEN 'leaf' ELSE 'branch' END AS kind,
              CASE WHEN is_leaf AND action <> '' THEN name || ' → ' || action ELSE name END AS label
       FROM nd)
"""


@query("menu_nodes", f"WITH {_NODES} SELECT * FROM mk")
def menu_nodes(c: Corpus):
    return graph.menu_nodes(c.entities["menus"]).drop("path")


# Menus with their ids qualified by the module of their file.
_KEYS = f"""
{_NODES}, {MODULE_OF},
mq AS (SELECT mk.*, regexp_extract(mo.module_path, '[^/]*$') || '.' AS prefix
       FROM mk JOIN pt ON mk.id = 'menu_' || CAST(pt.k AS STRING) JOIN mo ON mo.s = pt.s)
"""


@query("menu_edges", f"""
  WITH {_KEYS}
  SELECT repo, parent, id AS child, prefix || parent AS parent_key, prefix || id AS child_key
  FROM mq WHERE NOT is_root
""")
def menu_edges(c: Corpus):
    return graph.menu_edges(c.entities["menus"])


@query("menu_paths", f"""
  WITH RECURSIVE {_NODES},
  tr AS (SELECT repo, id, 0 AS depth, name AS menu_path FROM nd WHERE is_root
         UNION ALL
         SELECT nd.repo, nd.id, tr.depth + 1, tr.menu_path || ' / ' || nd.name
         FROM nd JOIN tr ON nd.parent = tr.id WHERE NOT nd.is_root)
  SELECT * FROM tr
""")
def menu_paths(c: Corpus):
    return graph.menu_paths(c.entities["menus"]).drop("key")


@query("menu_cycles", f"""
  WITH {PARTS}, cy AS (SELECT repo, count(*) AS n FROM pt GROUP BY repo)
  SELECT pt.repo, 'menu_' || CAST(k AS STRING) AS id FROM pt JOIN cy ON cy.repo = pt.repo
""")
def menu_cycles(c: Corpus):
    """Every menu made the parent of itself: none can be reached."""
    looped = c.entities["menus"].withColumn("parent", F.col("id"))
    return graph.menu_cycles(looped, graph.menu_paths(looped)).select("repo", "id")


@query("menu_diagram", f"""
  WITH {_KEYS},
  md AS (SELECT *, 'menu_' || replace(prefix || id, '.', '_') AS node,
                'menu_' || replace(prefix || parent, '.', '_') AS above FROM mq)
  SELECT repo, 0 AS section, 'graph TD' AS text FROM (SELECT DISTINCT repo FROM md) r
  UNION ALL SELECT repo, 1, '    ' || node || '["' || label || '"]' FROM md
  UNION ALL SELECT repo, 2, '    ' || above || ' --> ' || node FROM md WHERE NOT is_root
  UNION ALL SELECT repo, 3, '    class ' || node || ' menuRoot' FROM md WHERE is_root
  UNION ALL SELECT repo, 3, '    class ' || node || ' menuBranch' FROM md
    WHERE NOT is_root AND NOT is_leaf
  UNION ALL SELECT repo, 3, '    class ' || node || ' menuLeaf' FROM md WHERE is_leaf
""")
def menu_diagram(c: Corpus):
    return graph.menu_diagram(c.entities["menus"])


# ---------------------------------------------------------------- dependencies

_DEPENDS = f"""
{MODULE_OF},
dp AS (SELECT repo, mod AS module_path, 'mod_' || CAST(s AS STRING) AS module_name,
              unnest(['base', 'mod_' || CAST(nxt AS STRING), 'ext_' || CAST(s5 AS STRING)])
                AS depends_on
       FROM sp WHERE has_manifest),
de AS (SELECT dp.*, NOT EXISTS (SELECT 1 FROM sp WHERE sp.has_manifest AND sp.repo = dp.repo
                                AND 'mod_' || CAST(sp.s AS STRING) = dp.depends_on) AS external
       FROM dp)
"""


@query("module_dependencies", f"WITH {_DEPENDS} SELECT * FROM de")
def module_dependencies(c: Corpus):
    return graph.module_dependencies(c.entities["modules"])


@query("dependency_diagram", f"""
  WITH {_DEPENDS}, us AS (SELECT DISTINCT p_partkey % (SELECT count(*) FROM supplier) AS s FROM part),
  ms AS (SELECT DISTINCT repo, CASE WHEN module_path = '' THEN 'unknown_module'
           ELSE regexp_extract(module_path, '[^/]*$') END AS name
         FROM mo WHERE has_manifest OR s % 2 = 0 OR s IN (SELECT s FROM us))
  SELECT repo, 0 AS section, 'flowchart TD' AS text FROM (SELECT DISTINCT repo FROM ms) r
  UNION ALL SELECT repo, 1, '    ' || name || '[' || name || ']' FROM ms
  UNION ALL SELECT DISTINCT repo, 2, '    ' || depends_on || '[' || depends_on || ']:::external'
    FROM de WHERE external
  UNION ALL SELECT repo, 3, '    ' || module_name || ' --> ' || depends_on FROM de
""")
def dependency_diagram(c: Corpus):
    return graph.dependency_diagram(c.entities["modules"])


@query("report_relations", f"""
  WITH {_EDGES},
  rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY repo ORDER BY path, from_model, field, to_model)
                   AS INTEGER) AS pos, count(*) OVER (PARTITION BY repo) AS n FROM ed)
  SELECT repo, pos, from_model, type, to_model, field, greatest(0, n - 30) AS others
  FROM rk WHERE pos <= 30
""")
def report_relations(c: Corpus):
    return search.report_relations(c.relationships, REPORT_RELATION_CAP)


# A module graph with chains, branches and circles, four repositories of suppliers.
_GRAPH = """
  SELECT 'repo_' || CAST(s % 4 AS STRING) AS repo, 'mod_' || CAST(s AS STRING) AS module_name,
         CASE WHEN s % 9 <> 0 THEN 'mod_' || CAST(s + 4 AS STRING) END AS next,
         CASE WHEN s % 5 = 0 THEN 'mod_' || CAST(s + 12 AS STRING) END AS far,
         CASE WHEN s % 11 = 0 THEN 'mod_' || CAST(s - 8 AS STRING) END AS back, 'base' AS outside
  FROM (SELECT s_suppkey AS s FROM supplier) x
"""
_CLOSED = f"""
gm AS ({_GRAPH}),
ge AS (SELECT DISTINCT g.repo, g.module_name AS src, h.module_name AS dst
       FROM gm g JOIN gm h ON g.repo = h.repo AND h.module_name IN (g.next, g.far, g.back)
       WHERE g.module_name <> h.module_name),
rs AS (SELECT repo, src, dst, 1 AS n FROM ge
       UNION SELECT r.repo, r.src, e.dst, r.n + 1 FROM rs r JOIN ge e ON e.repo = r.repo AND e.src = r.dst
       WHERE r.n < (SELECT count(*) / 4 + 2 FROM gm)),
rc AS (SELECT repo, src, dst, CAST(min(n) AS INTEGER) AS steps FROM rs GROUP BY repo, src, dst)
"""


def _graph_modules(c: Corpus):
    c.table("supplier").createOrReplaceTempView("supplier")
    rows = c.spark.sql(_GRAPH)
    return rows.select(
        "repo", "module_name", F.array_compact(F.array("next", "far", "back", "outside")).alias("depends")
    )


@query("dependency_closure", f"""
  WITH RECURSIVE {_CLOSED}
  SELECT repo, src AS module_name, dst AS depends_on, steps FROM rc
""")
def dependency_closure(c: Corpus):
    return dependencies.dependency_closure(_graph_modules(c))


@query("load_order", f"""
  WITH RECURSIVE {_CLOSED},
  cp AS (SELECT g.repo, g.module_name, least(g.module_name, coalesce(min(a.dst), g.module_name)) AS component
         FROM gm g LEFT JOIN rc a ON a.repo = g.repo AND a.src = g.module_name
                   AND EXISTS (SELECT 1 FROM rc b WHERE b.repo = a.repo AND b.src = a.dst AND b.dst = a.src)
         GROUP BY g.repo, g.module_name),
  ce AS (SELECT DISTINCT e.repo, a.component AS src, b.component AS dst
         FROM ge e JOIN cp a ON a.repo = e.repo AND a.module_name = e.src
                   JOIN cp b ON b.repo = e.repo AND b.module_name = e.dst
         WHERE a.component <> b.component),
  lv AS (SELECT DISTINCT repo, component, 0 AS level FROM cp
         UNION SELECT ce.repo, ce.src, lv.level + 1 FROM lv JOIN ce ON ce.repo = lv.repo AND ce.dst = lv.component)
  SELECT cp.repo, module_name, cp.component, count(*) OVER (PARTITION BY cp.repo, cp.component) AS size,
         (SELECT max(level) FROM lv WHERE lv.repo = cp.repo AND lv.component = cp.component) AS level
  FROM cp
""")
def load_order(c: Corpus):
    return dependencies.load_order(_graph_modules(c))
