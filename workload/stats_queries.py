"""Queries over figures: counts, scores, shares and sheets."""

from __future__ import annotations

from pyspark.sql import functions as F

from addonscope.fixed_values import CATEGORIES, SEVERITIES
from addonscope.operators import stats
from workload.entity_queries import _MODULES
from workload.expected import MODULE_OF, PARTS
from workload.registry import Corpus, query
from workload.rule_queries import _DEFAULT, ISSUES

_ISSUES = f"{ISSUES}, dft AS (SELECT * FROM iss WHERE rule_id IN ({_DEFAULT}))"
_SEV = ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in SEVERITIES)
_CAT = ", ".join(f"count(*) FILTER (category = '{c}') AS {c}" for c in CATEGORIES)
_SCORE = "100 - 10 * critical - 3 * warning - info"
_BAND = ("CASE WHEN greatest(0, {s}) >= 70 THEN 'good' WHEN greatest(0, {s}) >= 40 "
         "THEN 'attention' ELSE 'critical' END").format(s=_SCORE)


@query("issues_by_severity", f"WITH {_ISSUES} SELECT repo, {_SEV} FROM dft GROUP BY repo")
def issues_by_severity(c: Corpus):
    return stats.issues_by_severity(c.issues)


@query("issues_by_category", f"WITH {_ISSUES} SELECT repo, {_CAT} FROM dft GROUP BY repo")
def issues_by_category(c: Corpus):
    return stats.issues_by_category(c.issues)


@query("filtered_summary", f"""
  WITH {_ISSUES}
  SELECT category, count(*) FILTER (severity = 'critical') AS critical,
         count(*) FILTER (severity = 'warning') AS warning,
         count(*) FILTER (severity = 'info') AS info, count(*) AS total
  FROM dft GROUP BY category
""")
def filtered_summary(c: Corpus):
    return stats.display_severity(c.issues, ("category",))


_HEALTH = f"""
{_ISSUES},
sv AS (SELECT repo, {_SEV} FROM dft GROUP BY repo)
"""


@query("health", f"""
  WITH {_HEALTH}
  SELECT *, {_SCORE} AS raw_score, greatest(0, {_SCORE}) AS health_score, {_BAND} AS health_band
  FROM sv
""")
def health(c: Corpus):
    return stats.health(stats.issues_by_severity(c.issues))


@query("module_health", f"""
  WITH {_ISSUES},
  pm AS (SELECT d.*, CASE WHEN rule_id IN ('SEC003', 'MIS001')
                          THEN regexp_extract(file, '^(.*?)/(?:security/)?[^/]*$', 1)
                          ELSE mo.module_path END AS module_path
         FROM dft d LEFT JOIN mo ON mo.mod = regexp_extract(d.file, '^addons/[^/]*')),
  sv AS (SELECT repo, module_path, {_SEV} FROM pm GROUP BY repo, module_path)
  SELECT *, {_SCORE} AS raw_score, greatest(0, {_SCORE}) AS health_score, {_BAND} AS health_band
  FROM sv
""")
def module_health(c: Corpus):
    return stats.module_health(c.issues, c.entities["dirs"])


_COUNTS = f"""
ct AS (
  SELECT repo, 'modules' AS m, count(*) AS n FROM ({_MODULES}) GROUP BY repo
  UNION ALL SELECT repo, 'models', count(*) FROM py WHERE kind = 'class' GROUP BY repo
  UNION ALL SELECT repo, 'fields', count(*) FROM py WHERE kind = 'field' GROUP BY repo
  UNION ALL SELECT repo, 'methods', count(*) FROM py WHERE kind = 'method' GROUP BY repo
  UNION ALL SELECT repo, 'views', count(*) FROM pt GROUP BY repo
  UNION ALL SELECT repo, 'menus', count(*) FROM pt GROUP BY repo
  UNION ALL SELECT repo, 'actions', sum(CAST(z % 2 = 0 AS INTEGER) + CAST(z % 7 = 0 AS INTEGER)
                                        + CAST(z % 9 = 0 AS INTEGER)) FROM pt GROUP BY repo),
cn AS (
  SELECT repo, {", ".join(f"CAST(coalesce(sum(n) FILTER (m = '{m}'), 0) AS BIGINT) AS total_{m}"
                          for m in ("modules", "models", "fields", "methods", "views", "actions",
                                    "menus"))}
  FROM ct GROUP BY repo)
"""


@query("entity_counts", f"WITH {_ISSUES}, {PARTS}, {_COUNTS} SELECT * FROM cn")
def entity_counts(c: Corpus):
    return stats.entity_counts(c.entities)


_VERSION = f"""
mr AS ({_MODULES}),
vr AS (SELECT repo, arg_min(CAST(major AS STRING) || '.0.1.' || CAST(s AS STRING), mod) AS version
       FROM sp WHERE has_manifest GROUP BY repo),
lr AS (SELECT repo, bool_or(z % 10 = 0) AS legacy FROM pt GROUP BY repo),
vd AS (SELECT r.repo, CASE WHEN version IS NOT NULL THEN 'Odoo ' || version
                           WHEN legacy THEN 'Odoo 8.0 atau lebih rendah' ELSE 'Odoo 14.0' END
                        AS version_detected
       FROM (SELECT DISTINCT repo FROM mr) r LEFT JOIN vr USING (repo) LEFT JOIN lr USING (repo))
"""


@query("version_detected", f"WITH {MODULE_OF}, {PARTS}, {_VERSION} SELECT * FROM vd")
def version_detected(c: Corpus):
    return stats.version_detected(c.entities["models"], c.entities["modules"])


_STATS = f"""
{_ISSUES}, {PARTS}, {_COUNTS}, {_VERSION},
sc AS (SELECT repo, {_SEV}, {_CAT} FROM dft GROUP BY repo),
sa AS (SELECT cn.*, {", ".join(f"coalesce({x}, 0) AS {x}" for x in [*SEVERITIES, *CATEGORIES])},
              version_detected
       FROM cn LEFT JOIN sc USING (repo) LEFT JOIN vd USING (repo)),
sx AS (SELECT *, {_SCORE} AS raw_score, greatest(0, {_SCORE}) AS health_score, {_BAND} AS health_band
       FROM sa)
"""


@query("stats", f"WITH {_STATS} SELECT * FROM sx")
def all_stats(c: Corpus):
    return c.stats


@query("summary_sheet", f"""
  WITH {_STATS}
  SELECT repo, 0 AS pos, 'Health Score' AS metric, CAST(health_score AS STRING) || '/100' AS value FROM sx
  UNION ALL SELECT repo, 1, 'Version Detected', version_detected FROM sx
  UNION ALL SELECT repo, 2, 'Total Modules', CAST(total_modules AS STRING) FROM sx
  UNION ALL SELECT repo, 3, 'Total Models', CAST(total_models AS STRING) FROM sx
  UNION ALL SELECT repo, 4, 'Total Fields', CAST(total_fields AS STRING) FROM sx
  UNION ALL SELECT repo, 5, 'Total Methods', CAST(total_methods AS STRING) FROM sx
  UNION ALL SELECT repo, 6, 'Total Views', CAST(total_views AS STRING) FROM sx
  UNION ALL SELECT repo, 7, 'Critical', CAST(critical AS STRING) FROM sx
  UNION ALL SELECT repo, 8, 'Warning', CAST(warning AS STRING) FROM sx
  UNION ALL SELECT repo, 9, 'Info', CAST(info AS STRING) FROM sx
""")
def summary_sheet(c: Corpus):
    return stats.summary_sheet(c.stats)


@query("severity_share", f"""
  WITH {_HEALTH}
  SELECT repo, critical / (critical + warning + info) AS critical_share,
         warning / (critical + warning + info) AS warning_share,
         info / (critical + warning + info) AS info_share
  FROM sv
""")
def severity_share(c: Corpus):
    return stats.severity_share(stats.issues_by_severity(c.issues))


@query("category_share", f"""
  WITH {_ISSUES},
  cs AS (SELECT repo, {_CAT} FROM dft GROUP BY repo),
  cl AS (SELECT *, greatest(1, {", ".join(CATEGORIES)}) AS largest FROM cs)
  {" UNION ALL ".join(f"SELECT repo, '{x}' AS category, {x} AS n, {x} / largest AS share FROM cl"
                      for x in CATEGORIES)}
""")
def category_share(c: Corpus):
    return stats.category_share(stats.issues_by_category(c.issues))


@query("model_inventory", f"""
  WITH {_ISSUES},
  pc AS (SELECT path, class_line, count(*) FILTER (kind = 'field') AS field_count,
                count(*) FILTER (kind = 'method') AS method_count
         FROM py WHERE cls > 0 GROUP BY path, class_line)
  SELECT py.repo, mo.module_path, py.path, model, name AS class_name,
         CASE WHEN cls = 2 THEN '' WHEN z % 7 = 0 THEN 'part.model.' || CAST(prev AS STRING)
              WHEN z % 7 = 1 THEN 'mail.thread, part.base' ELSE '' END AS inherits_from,
         field_count, method_count,
         CASE WHEN cls = 2 THEN 'Line' WHEN z % 5 <> 0 THEN pname || ' model' ELSE '' END
           AS description
  FROM py JOIN pc ON pc.path = py.path AND pc.class_line = py.line JOIN mo ON mo.s = py.s
  WHERE kind = 'class'
""")
def model_inventory(c: Corpus):
    e = c.entities
    return stats.model_inventory(e["models"], e["fields"], e["methods"])


@query("module_overview", f"""
  WITH {_ISSUES}, mr AS ({_MODULES}),
  mc AS (SELECT mo.repo, mo.module_path, count(*) AS model_count
         FROM py JOIN mo ON mo.s = py.s WHERE kind = 'class' GROUP BY mo.repo, mo.module_path)
  SELECT mr.repo, mr.module_path, mr.module_name, coalesce(model_count, 0) AS model_count,
         coalesce(CAST(major AS STRING) || '.0.1.' || CAST(s AS STRING), '-') AS version,
         coalesce('base, mod_' || CAST(nxt AS STRING) || ', ext_' || CAST(s5 AS STRING), '-')
           AS depends
  FROM mr LEFT JOIN mc USING (repo, module_path)
  LEFT JOIN sp ON sp.mod = mr.module_path AND sp.has_manifest
""")
def module_overview(c: Corpus):
    return stats.module_overview(c.entities["modules"], c.entities["models"])


@query("reference_targets", f"""
  WITH {PARTS}, {MODULE_OF},
  tg AS (
    SELECT s, 'view' AS kind, 'base.view_' || CAST(z AS STRING) AS target FROM pt WHERE z % 5 = 0
    UNION SELECT s, 'group', 'base.group_' || CAST(z AS STRING) FROM pt WHERE z % 4 = 0
    UNION SELECT s, 'group', 'base.group_user' FROM pt WHERE z % 4 = 0
    UNION SELECT s, 'group', 'a.b' FROM pt WHERE z % 7 = 0
    UNION SELECT s, 'group', 'c.d' FROM pt WHERE z % 7 = 0
    UNION SELECT s, 'group', 'g.' || CAST(z AS STRING) FROM pt WHERE z % 3 = 1)
  SELECT DISTINCT mo.repo, mo.module_path, kind, target FROM tg JOIN mo ON mo.s = tg.s
""")
def reference_targets(c: Corpus):
    e = c.entities
    return stats.reference_targets(
        e["views"], e["actions"], e["menus"], e["record_rules"], e["dirs"]
    )


@query("issue_rollup", f"""
  WITH {ISSUES},
  pl AS (SELECT iss.repo, coalesce(mo.module_path, '') AS module_path, file AS path, severity, entity
         FROM iss LEFT JOIN mo ON CAST(mo.s AS VARCHAR) = regexp_extract(file, '^addons/mod_([0-9]+)/', 1)
         WHERE rule_id IN ({_DEFAULT}))
  SELECT coalesce(repo, '') AS repo, coalesce(module_path, '') AS module_path, coalesce(path, '') AS path,
         CASE GROUPING(repo, module_path, path) WHEN 0 THEN 'file' WHEN 1 THEN 'module' WHEN 3 THEN 'repository'
              ELSE 'all' END AS level,
         count(*) AS n, count(*) FILTER (severity = 'critical') AS critical,
         count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'info') AS info,
         count(DISTINCT entity) AS entities, true AS close
  FROM pl GROUP BY ROLLUP (pl.repo, pl.module_path, pl.path)
""")
def issue_rollup(c: Corpus):
    """Findings on every level; the estimates lie within 10 percent of the exact counts."""
    rows = stats.issue_rollup(c.issues, c.entities["dirs"])
    close = F.abs(F.col("entities_estimate") - F.col("entities")) <= F.col("entities") * 0.1
    return rows.withColumn("close", close).drop("entities_estimate")
