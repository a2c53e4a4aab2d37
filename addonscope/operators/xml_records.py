"""XML data files -> views, actions, menus and record rules.

Files are spread over the tasks by their text.  A sweep over the tokens of a file finds its
elements; each is parsed once.  Every operator on them is a projection: no shuffle, and one
bad element costs one error row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from addonscope.fixed_values import (
    ACTION_MODELS,
    DEFAULT_PRIORITY,
    DEFAULT_REPORT_TYPE,
    DEFAULT_SEQUENCE,
    DEFAULT_VIEW_MODE,
    MENU_MODEL,
    RULE_MODEL,
    VIEW_MODEL,
    VIEW_TYPE_BY_NAME,
    VIEW_TYPES,
)
from addonscope.functions import pytext
from addonscope.functions import text as T
from addonscope.operators import xml_events
from addonscope.operators.python_source import FILE_KEY, text_partitions

_ATTRIBUTES = [
    "id", "model", "name", "parent", "action", "sequence", "groups", "res_model", "view_mode",
    "domain", "context", "string", "report_type",
]
_NODE = (
    ", ".join(f"_{a} STRING" for a in _ATTRIBUTES)
    + ", field ARRAY<STRUCT<_name: STRING, _ref: STRING, _eval: STRING, _type: STRING, _VALUE: STRING>>"
    + ", bad STRING"
)
_OPTIONS = {
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": "bad",
    "ignoreSurroundingSpaces": "false",
    "nullValue": "\u0001",
}


def xml_elements(files: DataFrame) -> DataFrame:
    """All ``record``, ``menuitem``, ``act_window`` and ``report`` elements, in order, and errors.

    ``line`` is where an element begins.  ``node`` is the parsed element; on a malformed one
    ``node.bad`` holds its text.  ``inner`` holds the XML inside the fields of a record that
    hold XML, by their place.  Errors between the elements have the tag ``error``.
    """
    files = files.where(F.col("type") == "xml")
    return (
        # Text compresses well: a scan has few tasks, and files of one kind may lie together.
        files.select("repo", "path", "content").repartition(text_partitions(files), *FILE_KEY)
        .select("repo", "path", F.explode(xml_events.elements(F.col("content"))).alias("x"))
        .select(
            "repo", "path", "x.pos", "x.tag", "x.line", "x.bad_line", "x.xml", "x.inner",
            F.from_xml(F.coalesce("x.flat", F.lit("<")), _NODE, _OPTIONS).alias("node"),
        )
    )


def xml_errors(elements: DataFrame) -> DataFrame:
    """Malformed elements, and tags outside them that do not match, as parse errors."""
    return elements.where(F.col("node.bad").isNotNull()).select(
        "repo",
        "path",
        F.coalesce("bad_line", "line").alias("line"),
        F.concat(F.lit("XML parse error: "), F.coalesce("xml", "node.bad")).alias("message"),
        F.lit("xml_parse_error").alias("type"),
    )


def xml_records(elements: DataFrame) -> DataFrame:
    """Well-formed ``record`` elements with id and model."""
    return _good(elements, "record").select(
        "repo", "path", "pos", "line", _attr("id").alias("id"), _attr("model").alias("model"), "inner", "node",
    )


def _good(elements: DataFrame, tag: str) -> DataFrame:
    return elements.where((F.col("tag") == tag) & F.col("node.bad").isNull())


def _attr(name: str) -> Column:
    return F.coalesce(F.col(f"node._{name}"), F.lit(""))


def _first_field(*names: str) -> Column:
    """The first direct field of one of the names, with its inner XML."""
    fields = F.arrays_zip(F.col("node.field").alias("own"), F.col("inner").alias("inner"))
    return F.try_element_at(F.filter(fields, lambda f: f["own"]["_name"].isin(*names)), F.lit(1))


def record_field(name: str) -> Column:
    """Value of the first field of that name: ref, else eval, else inner XML, else all text inside."""
    first = _first_field(name)
    own = first["own"]
    return F.coalesce(
        F.nullif(own["_ref"], F.lit("")),
        F.nullif(own["_eval"], F.lit("")),
        F.when(own["_type"] == "xml", first["inner"]),
        own["_VALUE"],
        F.lit(""),
    )


def record_groups() -> Column:
    """Group ids out of the ``groups_id``/``groups`` field: ref() calls, then the ref attribute."""
    first = F.try_element_at(
        F.filter("node.field", lambda f: f["_name"].isin("groups_id", "groups")), F.lit(1)
    )
    calls = F.regexp_extract_all(
        F.coalesce(first["_eval"], F.lit("")), F.lit(r"""ref\s*\(\s*['"]([^'"]+)['"]\s*\)"""),
        F.lit(1),
    )
    ref = F.nullif(first["_ref"], F.lit(""))
    return F.concat(calls, F.array_compact(F.array(ref)))


def _integer(text: Column, default: int) -> Column:
    """Leading integer of a text, the default where the text is empty."""
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(default)).otherwise(
        F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("int")
    )


def arch() -> Column:
    """Inner XML of the ``arch`` field of a record, nested fields included."""
    return F.coalesce(_first_field("arch")["inner"], F.lit(""))


def view_fields(arch_text: Column) -> Column:
    """Names of the fields in a view, then lower-case names compared in its expressions."""
    named = F.regexp_extract_all(
        arch_text, F.lit(r"""<field\b[^>]*?\bname\s*=\s*["']([^"']+)["']"""), F.lit(1)
    )
    compared = F.regexp_extract_all(
        arch_text,
        F.lit(r"""['"]([a-z_]\w*)['"]\s*(?:not\s+in\b|in\b|=|!=|&lt;|&gt;)"""),
        F.lit(1),
    )
    return F.array_distinct(F.concat(named, compared))


def _view_type(arch_text: Column, name: Column) -> Column:
    root = F.lower(F.regexp_extract(arch_text, r"<([A-Za-z_][\w.-]*)", 1))
    kind = F.when(root.isin(VIEW_TYPES), root).when(root.isin("xpath", "data"), "inherit")
    lower = F.lower(name)
    for part, view_type in VIEW_TYPE_BY_NAME:
        kind = kind.when(F.contains(lower, F.lit(part)), view_type)
    return kind.otherwise("unknown")


def views(elements: DataFrame) -> DataFrame:
    rows = (
        xml_records(elements)
        .where(F.col("model") == VIEW_MODEL)
        .withColumn("arch", arch())
        .withColumn("view_name", record_field("name"))
    )
    return rows.select(
        "repo",
        "path",
        "id",
        F.col("view_name").alias("name"),
        record_field("model").alias("model"),
        _view_type(F.col("arch"), F.col("view_name")).alias("type"),
        record_field("inherit_id").alias("inherit_id"),
        _integer(record_field("priority"), DEFAULT_PRIORITY).alias("priority"),
        "arch",
        view_fields(F.col("arch")).alias("fields"),
    )


def actions(elements: DataFrame) -> DataFrame:
    """Action records, ``act_window`` tags and ``report`` tags."""
    view_mode = F.coalesce(
        F.nullif(record_field("view_mode"), F.lit("")), F.lit(DEFAULT_VIEW_MODE)
    )
    records = (
        xml_records(elements)
        .where(F.col("model").isin(ACTION_MODELS))
        .select(
            "repo",
            "path",
            "id",
            record_field("name").alias("name"),
            record_field("res_model").alias("model"),
            F.col("model").alias("type"),
            view_mode.alias("view_mode"),
            record_field("domain").alias("domain"),
            record_field("context").alias("context"),
            record_groups().alias("groups"),
        )
    )

    def from_tag(tag: str, name: Column, model: Column, kind: str, mode: Column) -> DataFrame:
        is_report = tag == "report"
        return _good(elements, tag).select(
            "repo",
            "path",
            _attr("id").alias("id"),
            name.alias("name"),
            model.alias("model"),
            F.lit(kind).alias("type"),
            mode.alias("view_mode"),
            (F.lit("") if is_report else _attr("domain")).alias("domain"),
            (F.lit("") if is_report else _attr("context")).alias("context"),
            T.comma_list(_attr("groups")).alias("groups"),
        )

    windows = from_tag(
        "act_window", _attr("name"), _attr("res_model"), "ir.actions.act_window",
        F.coalesce(F.nullif(_attr("view_mode"), F.lit("")), F.lit(DEFAULT_VIEW_MODE)),
    )
    reports = from_tag(
        "report", F.coalesce(F.nullif(_attr("name"), F.lit("")), _attr("string")), _attr("model"),
        "ir.actions.report.xml",
        F.coalesce(F.nullif(_attr("report_type"), F.lit("")), F.lit(DEFAULT_REPORT_TYPE)),
    )
    return records.unionByName(windows).unionByName(reports)


def menus(elements: DataFrame) -> DataFrame:
    """Menu records and ``menuitem`` tags."""
    records = (
        xml_records(elements)
        .where(F.col("model") == MENU_MODEL)
        .select(
            "repo",
            "path",
            "id",
            record_field("name").alias("name"),
            record_field("parent_id").alias("parent"),
            record_field("action").alias("action"),
            _integer(record_field("sequence"), DEFAULT_SEQUENCE).alias("sequence"),
            record_groups().alias("groups"),
        )
    )
    tags = _good(elements, "menuitem").select(
        "repo",
        "path",
        *[_attr(a).alias(a) for a in ("id", "name", "parent", "action")],
        _integer(_attr("sequence"), DEFAULT_SEQUENCE).alias("sequence"),
        T.comma_list(_attr("groups")).alias("groups"),
    )
    return records.unionByName(tags)


def record_rules(elements: DataFrame) -> DataFrame:
    """Row-level rules; permissions default to true."""

    def permission(name: str) -> Column:
        value = F.nullif(record_field(name), F.lit(""))
        return pytext.py_bool(value, True).alias(name)

    return (
        xml_records(elements)
        .where(F.col("model") == RULE_MODEL)
        .select(
            "repo",
            "path",
            "id",
            record_field("name").alias("name"),
            record_field("model_id").alias("model_id"),
            record_field("domain_force").alias("domain"),
            record_groups().alias("groups"),
            *[
                permission(p)
                for p in ("perm_read", "perm_write", "perm_create", "perm_unlink")
            ],
        )
    )
