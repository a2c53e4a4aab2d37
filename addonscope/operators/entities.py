"""Models, fields, methods and their parts, as projections of the class items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from addonscope.fixed_values import FIELD_PARAMS, FIELD_TYPES, LEGACY_BASES, RELATIONAL_TYPES
from addonscope.functions import pytext

MODEL_KEY = ["repo", "path", "class_line", "model"]
_LEGACY = "|".join(b.replace(".", r"\.") for b in LEGACY_BASES)
_TUPLE3 = (
    r"""\(\s*(?:'([^']*)'|"([^"]*)")\s*,\s*(?:'([^']*)'|"([^"]*)")\s*,"""
    r"""\s*(?:'([^']*)'|"([^"]*)")\s*,?\s*\)"""
)


def canonical_type(raw: Column) -> Column:
    """Canonical field type of a constructor name; unknown names stay as written."""
    known = F.create_map(*[F.lit(x) for pair in FIELD_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(raw)), raw)


def models(items: DataFrame) -> DataFrame:
    """One row per model class."""
    return items.where(F.col("kind") == "class").select(
        *MODEL_KEY,
        "class_name",
        "explicit_name",
        "inherit",
        "inherits",
        "description",
        "order",
        "rec_name",
        "bases",
        F.col("bases").rlike(_LEGACY).alias("legacy_base"),
        "style",
        F.col("line"),
        F.col("class_end").alias("end_line"),
    )


def sql_constraints(items: DataFrame) -> DataFrame:
    """3-tuples of ``_sql_constraints``."""
    groups = [F.regexp_extract_all("code", F.lit(_TUPLE3), F.lit(i)) for i in range(1, 7)]
    rows = items.where(F.col("target") == "_sql_constraints").select(
        *MODEL_KEY, F.explode(F.arrays_zip(*[g.alias(f"g{i}") for i, g in enumerate(groups)])).alias("t")
    )
    return rows.select(
        *MODEL_KEY,
        F.concat("t.g0", "t.g1").alias("name"),
        F.concat("t.g2", "t.g3").alias("sql"),
        F.concat("t.g4", "t.g5").alias("message"),
    )


def _declared_fields(items: DataFrame) -> DataFrame:
    """``name = fields.Type(...)`` statements."""
    found = r"^\s*(\w+)\s*=\s*fields\.(\w+)\s*\("
    args = pytext.bracketed(F.col("code"), F.col("masked"), "(")
    return items.where((F.col("kind") == "assign") & F.col("masked").rlike(found)).select(
        *MODEL_KEY,
        "class_name",
        F.col("target").alias("name"),
        F.regexp_extract("masked", found, 2).alias("raw_type"),
        args.alias("args"),
        "defaults",
        "line",
        F.col("head_end").alias("end_line"),
        F.lit(False).alias("legacy"),
    )


def legacy_fields(items: DataFrame) -> DataFrame:
    """Entries ``'name': fields.type(...)`` of ``_columns`` dictionaries."""
    found = r"^\s*fields\.(\w+)\s*\("
    entries = (
        items.where(F.col("target") == "_columns")
        .withColumn("inside", pytext.bracketed(F.col("code"), F.col("masked"), "{"))
        .select(
            *MODEL_KEY,
            "class_name",
            "defaults",
            "line",
            "code",
            "inside",
            F.explode(
                pytext.dict_entries(F.col("inside.code"), F.col("inside.masked"))
            ).alias("e"),
        )
        .where(F.col("e.masked").rlike(found))
    )
    entries = entries.withColumn(
        "at",
        F.col("line")
        + pytext.line_offset(F.col("code"), F.col("inside.pos") + F.col("e.pos") - 1),
    )
    return entries.select(
        *MODEL_KEY,
        "class_name",
        F.col("e.key").alias("name"),
        F.lower(F.regexp_extract("e.masked", found, 1)).alias("raw_type"),
        pytext.bracketed(F.col("e.code"), F.col("e.masked"), "(").alias("args"),
        "defaults",
        F.col("at").alias("line"),
        (F.col("at") + pytext.line_offset(F.rtrim("e.code"), F.length("e.code") + 1)).alias(
            "end_line"
        ),
        F.lit(True).alias("legacy"),
    )


def _is_text(value: Column) -> Column:
    return value["kind"].isin("string", "raw")


def field_params(kind: Column, kw: Column, pos: Column) -> Column:
    """``MAP<STRING, STRUCT<kind, text>>``: keyword and positional arguments by name.

    ``kind`` is the lower-case canonical type.
    """
    first, second = F.try_element_at(pos, F.lit(1)), F.try_element_at(pos, F.lit(2))
    relational = kind.isin(RELATIONAL_TYPES)

    def text(value: Column) -> Column:
        return F.struct(value["kind"].alias("kind"), value["text"].alias("text"))

    def named(value: Column, reject: str) -> Column:
        return F.when(
            (F.coalesce(value["text"], F.lit("")) != "") & ~value["text"].rlike(reject),
            F.struct(
                F.lit("string").alias("kind"), pytext.trim_quotes(value["text"]).alias("text")
            ),
        )

    def keyword(key: str) -> Column:
        return F.try_element_at(kw, F.lit(key))

    no_label = F.coalesce(keyword("string")["text"], F.lit("")) == ""
    by_position = F.map_from_arrays(
        F.array(*[F.lit(k) for k in ("comodel_name", "inverse_name", "string", "selection")]),
        F.array(
            F.coalesce(
                keyword("comodel_name"), F.when(relational, named(first, r"^(?:[\[{]|lambda)"))
            ),
            F.coalesce(
                keyword("inverse_name"), F.when(kind == "one2many", named(second, r"^[\[{]"))
            ),
            F.when(
                no_label & ~relational & (kind != "selection") & _is_text(first), text(first)
            ).when(no_label & kind.isin("many2one", "many2many") & _is_text(second), text(second)),
            F.when(kind == "selection", F.coalesce(keyword("selection"), text(first))),
        ),
    )
    given = F.map_filter(by_position, lambda _, v: v.isNotNull())
    allowed = F.map_filter(
        kw, lambda k, _: k.isin(FIELD_PARAMS) & ~F.map_contains_key(given, k)
    )
    return F.map_concat(allowed, given)


def fields(items: DataFrame) -> DataFrame:
    """All fields, legacy and declared, with canonical type and parameters.

    ``params`` holds the text of each value, ``param_kinds`` what kind of
    literal it was.  A ``_defaults`` entry fills a missing ``default``.
    """
    rows = legacy_fields(items).unionByName(_declared_fields(items))
    rows = (
        rows.withColumn("pieces", pytext.split_args(F.col("args.code"), F.col("args.masked")))
        .withColumn("kw", pytext.keyword_args(F.col("pieces")))
        .withColumn("pos", pytext.positional_args(F.col("pieces")))
        .withColumn("type", canonical_type(F.col("raw_type")))
        .withColumn("kind", F.lower("type"))
        .withColumn("p", field_params(F.col("kind"), F.col("kw"), F.col("pos")))
    )
    fallback = F.try_element_at("defaults", F.col("name"))
    no_default = F.coalesce(
        F.try_element_at("p", F.lit("default"))["text"], F.lit("")
    ).isin("", "False", "0")
    params = F.transform_values("p", lambda _, v: v["text"])
    return rows.select(
        *MODEL_KEY,
        "class_name",
        "name",
        "type",
        "raw_type",
        F.when(
            fallback.isNotNull() & no_default,
            F.map_concat(
                F.map_filter(params, lambda k, _: k != "default"),
                F.map_from_arrays(F.array(F.lit("default")), F.array(fallback)),
            ),
        ).otherwise(params).alias("params"),
        F.transform_values("p", lambda _, v: v["kind"]).alias("param_kinds"),
        "legacy",
        "line",
        "end_line",
    )


def selection_pairs(selection: Column) -> Column:
    """``ARRAY<STRUCT<value, label>>`` of a list of pairs of strings."""

    def pair(item: Column) -> Column:
        inside = pytext.bracketed(item["code"], item["masked"], "(")
        return pytext.let(
            F.transform(
                pytext.let(inside, lambda x: pytext.split_args(x["code"], x["masked"])),
                lambda part: pytext.literal(part["code"]),
            ),
            lambda v: F.when(
                (F.size(v) == 2) & F.forall(v, lambda x: x["kind"] == "string"),
                F.struct(v[0]["text"].alias("value"), v[1]["text"].alias("label")),
            ),
        )

    def pairs(text: Column) -> Column:
        listed = pytext.bracketed(text["code"], text["masked"], "[")
        return pytext.let(
            listed,
            lambda x: F.array_compact(
                F.transform(pytext.split_args(x["code"], x["masked"]), pair)
            ),
        )

    return pytext.let(pytext.forms(selection), pairs)


def states(fields_df: DataFrame) -> DataFrame:
    """Value and label pairs of selection fields named state or status."""
    selection = F.try_element_at("params", F.lit("selection"))
    return (
        fields_df.where(F.col("name").isin("state", "status") & (F.col("type") == "Selection"))
        .select(
            *MODEL_KEY,
            F.col("name").alias("field"),
            F.posexplode(selection_pairs(selection)).alias("pos", "s"),
        )
        .select(*MODEL_KEY, "field", "pos", F.col("s.value"), F.col("s.label"))
    )


def methods(items: DataFrame) -> DataFrame:
    """Methods of the model classes with decorators, parameters and body.

    ``lines`` keeps the body line by line for the rules; ``body`` is its text.
    """
    params = pytext.bracketed(F.col("code"), F.col("masked"), "(")
    return (
        items.where(F.col("kind") == "def")
        .withColumn("args", params)
        .select(
            *MODEL_KEY,
            "class_name",
            F.regexp_extract("masked", r"def\s+(\w+)", 1).alias("name"),
            F.transform("decorators", lambda d: d["text"]).alias("decorators"),
            F.col("decorators").alias("decorator_lines"),
            F.transform(
                pytext.split_args(F.col("args.code"), F.col("args.masked")),
                lambda p: pytext.strip(p["code"]),
            ).alias("params"),
            F.array_join(F.transform("body", lambda x: x["text"]), "\n").alias("body"),
            F.exists(
                "body", lambda x: x["masked"].rlike(r"\bsuper\s*\(")
            ).alias("has_super"),
            "line",
            "end_line",
            F.col("body").alias("lines"),
        )
    )
