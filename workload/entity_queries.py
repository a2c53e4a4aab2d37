"""Queries over the extracted entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from addonscope.fixed_values import FIELD_TYPES
from addonscope.operators import data_files, entities, modules, xml_records
from workload.expected import MODULE_OF, PARTS, PY, SUPPLIERS
from workload.registry import Corpus, query

_TYPE_CASE = "CASE lower(a) " + " ".join(
    f"WHEN '{raw}' THEN '{name}'" for raw, name in FIELD_TYPES.items()
) + " ELSE a END"


@query("class_blocks", f"""
  WITH {PY}
  SELECT repo, path, class_line AS line, any_value(model) AS model,
         max(name) FILTER (kind = 'class') AS class_name,
         max(CASE WHEN trim(text) <> '' AND trim(text) NOT LIKE '#%' THEN line END) AS end_line,
         count(*) FILTER (kind = 'method') AS n_methods
  FROM py WHERE cls > 0 GROUP BY repo, path, class_line
""")
def class_blocks(c: Corpus):
    items = c.entities["items"]
    return items.groupBy("repo", "path", F.col("class_line").alias("line"), "model").agg(
        F.max("class_name").alias("class_name"),
        F.max("class_end").alias("end_line"),
        F.count_if(F.col("kind") == "def").alias("n_methods"),
    )


@query("models", f"""
  WITH {PY}
  SELECT repo, path, line, model, name AS class_name,
         CASE WHEN cls = 2 THEN true ELSE z % 7 NOT IN (0, 2) END AS explicit_name,
         CASE WHEN cls = 2 THEN '' WHEN z % 7 = 0 THEN 'part.model.' || CAST(prev AS STRING)
              WHEN z % 7 = 1 THEN 'mail.thread|part.base' ELSE '' END AS inherit,
         CASE WHEN cls = 1 AND z % 21 = 1 THEN 'user_id' END AS delegated,
         CASE WHEN cls = 2 THEN 'Line' WHEN z % 5 <> 0 THEN pname || ' model' ELSE '' END
           AS description,
         CASE WHEN cls = 1 AND z % 3 = 0 THEN 'sequence, id' ELSE '' END AS ordering,
         CASE WHEN cls = 1 AND z % 9 = 0 THEN 'code' ELSE '' END AS rec_name,
         cls = 1 AND z % 10 = 0 AS legacy_base,
         CASE WHEN z % 10 = 0 THEN 'old' ELSE 'new' END AS style
  FROM py WHERE kind = 'class'
""")
def models(c: Corpus):
    return c.entities["models"].select(
        "repo", "path", "line", "model", "class_name", "explicit_name",
        F.array_join("inherit", "|").alias("inherit"),
        F.try_element_at("inherits", F.lit("res.users")).alias("delegated"),
        "description", F.col("order").alias("ordering"), "rec_name", "legacy_base", "style",
    )


@query("sql_constraints", f"""
  WITH {PY}
  SELECT repo, path, model, name, a AS sql, b AS message FROM py WHERE kind = 'constraint'
""")
def sql_constraints(c: Corpus):
    return c.entities["sql_constraints"].select(
        "repo", "path", "model", "name", "sql", "message"
    )


_FIELDS = f"""
  WITH {PY}
  SELECT repo, path, model, name, {_TYPE_CASE} AS type, a AS raw_type,
         a IN ('char', 'many2one') AND name IN ('code', 'owner_id') AS legacy, line,
         CASE WHEN name = 'partner_id' THEN line + (CASE WHEN z % 3 = 0 THEN 4 ELSE 3 END)
              ELSE line END AS end_line,
         b AS string, c AS comodel_name, d AS ondelete, e AS default_value, f AS compute,
         CASE WHEN name = 'amount' AND z % 2 = 0 THEN 'True' END AS store,
         CASE WHEN name = 'name' THEN 'True' END AS required,
         CASE WHEN name = 'line_ids' THEN 'parent_id' END AS inverse_name,
         CASE WHEN name = 'code' THEN '64' END AS size
  FROM py WHERE kind = 'field'
"""


def _field_columns(rows):
    def param(key: str):
        return F.try_element_at("params", F.lit(key))

    return rows.select(
        "repo", "path", "model", "name", "type", "raw_type", "legacy", "line", "end_line",
        param("string").alias("string"), param("comodel_name").alias("comodel_name"),
        param("ondelete").alias("ondelete"), param("default").alias("default_value"),
        param("compute").alias("compute"), param("store").alias("store"),
        param("required").alias("required"), param("inverse_name").alias("inverse_name"),
        param("size").alias("size"),
    )


@query("fields", _FIELDS)
def fields(c: Corpus):
    return _field_columns(entities.fields(c.entities["items"]))


@query("legacy_fields", f"SELECT repo, path, model, name, raw_type, line FROM ({_FIELDS}) WHERE legacy")
def legacy_fields(c: Corpus):
    return entities.legacy_fields(c.entities["items"]).select(
        "repo", "path", "model", "name", "raw_type", "line"
    )


@query("field_param_kinds", f"""
  SELECT raw_type, name, count(*) AS n,
         count(required) AS n_true, count(size) AS n_number, count(comodel_name) AS n_relation
  FROM ({_FIELDS}) GROUP BY raw_type, name
""")
def field_param_kinds(c: Corpus):
    def kind(key: str):
        return F.try_element_at("param_kinds", F.lit(key))

    return c.entities["fields"].groupBy("raw_type", "name").agg(
        F.count("*").alias("n"),
        F.count_if(kind("required") == "true").alias("n_true"),
        F.count_if(kind("size") == "number").alias("n_number"),
        F.count_if(kind("comodel_name") == "string").alias("n_relation"),
    )


_STATES = f"""
  WITH {PY}
  SELECT repo, path, model, 0 AS pos, 'draft' AS value, 'Draft' AS label
  FROM py WHERE kind = 'field' AND name = 'state'
  UNION ALL
  SELECT repo, path, model, 1, CASE WHEN z % 12 = 0 THEN ptype
                                    ELSE 'validate_' || CAST(z AS STRING) END,
         CASE WHEN z % 12 = 0 THEN 'Busy' ELSE 'Check' END
  FROM py WHERE kind = 'field' AND name = 'state'
  UNION ALL
  SELECT repo, path, model, 2, 'done', 'Done'
  FROM py WHERE kind = 'field' AND name = 'state' AND z % 12 = 0
"""


@query("states", _STATES)
def states(c: Corpus):
    return c.entities["states"].select("repo", "path", "model", "pos", "value", "label")


@query("methods", f"""
  WITH {PY},
  bd AS (SELECT path, method_line, string_agg(text, chr(10) ORDER BY line) AS body
         FROM py WHERE cls = 1 AND line > method_line GROUP BY path, method_line)
  SELECT repo, py.path, model, name, a AS params, b AS decorators, c = 'true' AS has_super, line,
         body
  FROM py LEFT JOIN bd ON bd.path = py.path AND bd.method_line = py.line WHERE kind = 'method'
""")
def methods(c: Corpus):
    return c.entities["methods"].select(
        "repo", "path", "model", "name", F.array_join("params", ",").alias("params"),
        F.array_join("decorators", "|").alias("decorators"), "has_super", "line", "body",
    )


# ------------------------------------------------------------------- XML files

_XML_PATH = "mod || '/views/m_' || CAST(k AS STRING) || '.xml'"


@query("xml_records", f"""
  WITH {PARTS}
  SELECT repo, {_XML_PATH} AS path,
         'ir.ui.view' AS model, 'view_' || CAST(k AS STRING) AS id FROM pt
  UNION ALL SELECT repo, {_XML_PATH}, 'ir.actions.act_window', 'action_' || CAST(k AS STRING)
  FROM pt WHERE z % 2 = 0
  UNION ALL SELECT repo, {_XML_PATH}, 'ir.ui.menu', 'menu_' || CAST(k AS STRING)
  FROM pt WHERE z % 3 = 2
  UNION ALL SELECT repo, {_XML_PATH}, 'ir.rule', 'rule_' || CAST(k AS STRING)
  FROM pt WHERE z % 4 = 0
""")
def xml_record_rows(c: Corpus):
    return xml_records.xml_records(xml_records.xml_elements(c.files)).select(
        "repo", "path", "model", "id"
    )


@query("xml_errors", f"""
  WITH {PARTS}
  SELECT repo, {_XML_PATH} AS path, 'xml_parse_error' AS type,
         'XML parse error: <record id="broken_' || CAST(k AS STRING)
           || '" model="ir.ui.view"><field name="name">x</record>' AS message
  FROM pt WHERE z % 17 = 0
""")
def xml_errors(c: Corpus):
    return c.entities["parse_errors"].select("repo", "path", "type", "message")


_VIEWS = f"""
  SELECT repo, {_XML_PATH} AS path, 'view_' || CAST(k AS STRING) AS id,
         'part.model.' || CAST(k AS STRING) || '.view' AS name,
         'part.model.' || CAST(k AS STRING) AS model,
         CASE z % 4 WHEN 0 THEN 'form' WHEN 1 THEN 'tree' WHEN 2 THEN 'kanban' ELSE 'inherit' END
           AS type,
         CASE WHEN z % 5 = 0 THEN 'base.view_' || CAST(z AS STRING) ELSE '' END AS inherit_id,
         CASE WHEN z % 3 = 0 THEN z ELSE 16 END AS priority,
         'name' || CASE WHEN z % 2 = 0 THEN '|partner_id|amount' ELSE '' END
                || CASE WHEN z % 6 = 0 THEN '|state' ELSE '' END AS fields
  FROM pt
"""


@query("views", f"WITH {PARTS} {_VIEWS}")
def views(c: Corpus):
    return c.entities["views"].select(
        "repo", "path", "id", "name", "model", "type", "inherit_id", "priority",
        F.array_join("fields", "|").alias("fields"),
    )


@query("view_arch", f"""
  WITH {PARTS}
  SELECT 'view_' || CAST(k AS STRING) AS id, chr(10) || '      ' || opening || chr(10)
         || '        <field name="name"/>' || chr(10)
         || CASE WHEN z % 2 = 0 THEN
            '        <field name="partner_id"><tree><field name="amount"/></tree></field>' || chr(10)
            ELSE '' END
         || CASE WHEN z % 6 = 0 THEN
            '        <button name="go" attrs="{{''invisible'': [(''state'' = ''x'')]}}"/>' || chr(10)
            ELSE '' END
         || '      ' || closing || chr(10) || '    ' AS arch
  FROM (SELECT *, CASE z % 4 WHEN 0 THEN '<form string="F">' WHEN 1 THEN '<tree>'
                    WHEN 2 THEN '<Kanban>'
                    ELSE '<xpath expr="//field[@name=''note'']" position="after">' END AS opening,
                  CASE z % 4 WHEN 0 THEN '</form>' WHEN 1 THEN '</tree>' WHEN 2 THEN '</Kanban>'
                    ELSE '</xpath>' END AS closing FROM pt) q
""")
def view_arch(c: Corpus):
    return c.entities["views"].select("id", "arch")


@query("actions", f"""
  WITH {PARTS}
  SELECT repo, 'action_' || CAST(k AS STRING) AS id, 'Open & ' || pname AS name,
         'part.model.' || CAST(k AS STRING) AS model, 'ir.actions.act_window' AS type,
         CASE WHEN z % 4 = 0 THEN 'kanban' ELSE 'tree,form' END AS view_mode,
         CASE WHEN z % 6 = 0 THEN '[(''id'', ''='', ' || CAST(z AS STRING) || ')]' ELSE '' END
           AS domain,
         CASE WHEN z % 4 = 0 THEN 'base.group_' || CAST(z AS STRING) || '|base.group_user' ELSE ''
           END AS groups
  FROM pt WHERE z % 2 = 0
  UNION ALL
  SELECT repo, 'aw_' || CAST(k AS STRING), 'AW', 'part.model.' || CAST(k AS STRING),
         'ir.actions.act_window', 'tree,form', '', 'a.b|c.d' FROM pt WHERE z % 7 = 0
  UNION ALL
  SELECT repo, 'rep_' || CAST(k AS STRING), 'R ' || CAST(k AS STRING),
         'part.model.' || CAST(k AS STRING), 'ir.actions.report.xml', 'pdf', '', ''
  FROM pt WHERE z % 9 = 0
""")
def actions(c: Corpus):
    return c.entities["actions"].select(
        "repo", "id", "name", "model", "type", "view_mode", "domain",
        F.array_join("groups", "|").alias("groups"),
    )


MENUS = """
  SELECT repo, 'menu_' || CAST(k AS STRING) AS id, pname AS name,
         CASE z % 3 WHEN 0 THEN 'menu_' || CAST(above AS STRING)
                    WHEN 1 THEN '' ELSE 'menu_root_' || CAST(s AS STRING) END AS parent,
         CASE WHEN z % 3 = 0 THEN 'action_' || CAST(k AS STRING) ELSE '' END AS action,
         CASE WHEN z % 3 = 0 THEN z ELSE 10 END AS sequence,
         CASE WHEN z % 3 = 1 THEN 'g.' || CAST(z AS STRING) ELSE '' END AS groups
  FROM pt
"""


@query("menus", f"WITH {PARTS} {MENUS}")
def menus(c: Corpus):
    return xml_records.menus(c.entities["elements"]).select(
        "repo", "id", "name", "parent", "action", "sequence",
        F.array_join("groups", "|").alias("groups"),
    )


@query("record_rules", f"""
  WITH {PARTS}
  SELECT repo, 'rule_' || CAST(k AS STRING) AS id, 'Rule ' || CAST(k AS STRING) AS name,
         'model_part_model_' || CAST(k AS STRING) AS model_id,
         '[(''id'', ''='', ' || CAST(z AS STRING) || ')]' AS domain,
         'base.group_' || CAST(z AS STRING) AS groups,
         true AS perm_read, z % 8 <> 0 AS perm_write, true AS perm_create, true AS perm_unlink
  FROM pt WHERE z % 4 = 0
""")
def record_rules(c: Corpus):
    return xml_records.record_rules(c.entities["elements"]).select(
        "repo", "id", "name", "model_id", "domain", F.array_join("groups", "|").alias("groups"),
        "perm_read", "perm_write", "perm_create", "perm_unlink",
    )


# ------------------------------------------------------------------ other files


@query("access_rights", f"""
  WITH {PARTS}
  SELECT repo, mod || '/security/access_' || CAST(k AS STRING) || '.csv' AS path,
         'access_' || CAST(k AS STRING) AS id, pname || ', "q"' AS name,
         'model_part_model_' || CAST(k AS STRING) AS model_id, 'base.group_user' AS group_id,
         true AS perm_read, false AS perm_write, true AS perm_create, false AS perm_unlink
  FROM pt WHERE z % 3 <> 1
  UNION ALL
  SELECT repo, mod || '/security/access_' || CAST(k AS STRING) || '.csv',
         'access_line_' || CAST(k AS STRING), 'line',
         'mod.model_part_line_' || CAST(k AS STRING), '', true, true, true, true
  FROM pt WHERE z % 16 = 0
""")
def access_rights(c: Corpus):
    return data_files.access_rights(c.files)


@query("manifests", f"""
  WITH {SUPPLIERS}
  SELECT repo, mod AS module_path, 'Module nr ' || CAST(s AS STRING) AS name,
         CAST(major AS STRING) || '.0.1.' || CAST(s AS STRING) AS version,
         CASE WHEN s % 3 <> 0 THEN 'LGPL-3' ELSE '' END AS license,
         'Author, ' || CAST(s AS STRING) AS author,
         'Has ''depends'': [''no''] inside' || chr(10) || '        and a second line'
           AS description,
         'base|mod_' || CAST(nxt AS STRING) || '|ext_' || CAST(s5 AS STRING) AS depends,
         'views/v' || CAST(s AS STRING) || '.xml' AS data, 0 AS n_demo,
         s % 4 <> 0 AS installable, s % 6 = 0 AS application, false AS auto_install,
         CASE WHEN s % 6 = 0 THEN 'tool' END AS bin, CAST(s AS STRING) AS custom_key
  FROM sp WHERE has_manifest
""")
def manifests(c: Corpus):
    return data_files.manifests(c.files).select(
        "repo", "module_path", "name", "version", "license", "author", "description",
        F.array_join("depends", "|").alias("depends"), F.array_join("data", "|").alias("data"),
        F.size("demo").alias("n_demo"), "installable", "application", "auto_install",
        F.try_element_at("external_dependencies", F.lit("bin")).alias("bin"),
        F.try_element_at("extra", F.lit("custom_key")).alias("custom_key"),
    )


@query("translations", f"""
  WITH {SUPPLIERS}
  SELECT repo, mod || '/i18n/fr.po' AS path, 'fr' AS lang,
         'Supplier ' || CAST(s AS STRING) AS msgid,
         CASE WHEN s % 4 = 0 THEN 'Fournisseur bis ' ELSE 'Fournisseur ' END || CAST(s AS STRING)
           AS msgstr
  FROM sp WHERE s % 2 = 0
  UNION ALL
  SELECT repo, mod || '/i18n/fr.po', 'fr', 'Long text ' || CAST(s AS STRING),
         'Texte long \\"' || CAST(s AS STRING) || '\\"' FROM sp WHERE s % 2 = 0
""")
def translations(c: Corpus):
    return data_files.translations(c.files)


# --------------------------------------------------------------------- modules


@query("assign_modules", f"""
  WITH {PARTS}, {MODULE_OF},
  f AS (SELECT s, repo, mod || '/models/m_' || CAST(k AS STRING) || '.py' AS path FROM pt
        UNION ALL SELECT s, repo, {_XML_PATH} FROM pt
        UNION ALL SELECT s, repo, mod || '/security/access_' || CAST(k AS STRING) || '.csv' FROM pt
        UNION ALL SELECT s, repo, mod || '/__manifest__.py' FROM sp WHERE has_manifest
        UNION ALL SELECT s, repo, mod || '/i18n/fr.po' FROM sp WHERE s % 2 = 0)
  SELECT f.repo, f.path, mo.module_path FROM f JOIN mo ON mo.s = f.s
""")
def assign_modules(c: Corpus):
    return modules.assign_modules(c.files).select("repo", "path", "module_path")


_MODULES = f"""
  WITH {MODULE_OF}, u AS (SELECT DISTINCT p_partkey % (SELECT count(*) FROM supplier) AS s FROM part)
  SELECT DISTINCT mo.repo, module_path,
         CASE WHEN module_path = '' THEN 'unknown_module'
              ELSE regexp_extract(module_path, '[^/]*$') END AS module_name,
         module_path <> '' AS has_manifest
  FROM mo WHERE s IN (SELECT s FROM u) OR has_manifest OR s % 2 = 0
"""


@query("modules", _MODULES)
def module_rows(c: Corpus):
    return modules.modules(c.files, c.entities["manifests"], c.entities["dirs"]).select(
        "repo", "module_path", "module_name", "has_manifest"
    )


@query("non_empty_modules", f"""
  WITH {MODULE_OF},
  pk AS (SELECT DISTINCT p_partkey % (SELECT count(*) FROM supplier) AS s FROM part),
  m AS (SELECT repo, module_path, bool_or(has_manifest) AS titled,
               bool_or(s IN (SELECT s FROM pk)) AS filled
        FROM mo WHERE s IN (SELECT s FROM pk) OR has_manifest OR s % 2 = 0
        GROUP BY repo, module_path),
  r AS (SELECT *, bool_or(titled OR filled) OVER (PARTITION BY repo) AS any_filled FROM m)
  SELECT repo, module_path FROM r WHERE titled OR filled OR NOT any_filled
""")
def non_empty_modules(c: Corpus):
    e = c.entities
    parts = [modules.with_module(e[name], e["dirs"]) for name in ("views", "actions", "menus")]
    return modules.non_empty_modules(
        e["modules"], [e["models"], e["access_rights"], *parts]
    ).select("repo", "module_path")
