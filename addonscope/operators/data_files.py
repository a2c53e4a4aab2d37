"""Access-right CSV, manifest and translation files.  All are projections of ``files``, the CSV spread by its text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from addonscope.fixed_values import (
    MANIFEST_FILES,
    MANIFEST_FLAGS,
    MANIFEST_LISTS,
    MANIFEST_MAPS,
    MANIFEST_STRINGS,
)
from addonscope.functions import pytext
from addonscope.functions import text as T
from addonscope.operators.python_source import FILE_KEY, text_partitions

_ACCESS_COLUMNS = {
    "id": ["id"],
    "name": ["name"],
    "model_id": ["model_id:id", "model_id/id"],
    "group_id": ["group_id:id", "group_id/id"],
    "perm_read": ["perm_read"],
    "perm_write": ["perm_write"],
    "perm_create": ["perm_create"],
    "perm_unlink": ["perm_unlink"],
}


def access_rights(files: DataFrame) -> DataFrame:
    """Rows of access-right CSV files, columns found by their header.

    A file counts by its name or by a permission column in its first line.
    Comment and blank lines are skipped; a row needs an id or a model.
    """
    lines = F.split(pytext.normalized_source(F.col("content")), "\n")
    header_line = F.lower(F.element_at(lines, 1))
    is_access = (
        F.contains(F.lower("name"), F.lit("access"))
        | F.contains(header_line, F.lit("perm_read"))
        | F.contains(header_line, F.lit("perm_write"))
    )
    kept = F.filter(
        F.transform(lines, lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#")
    )
    files = files.where((F.col("type") == "csv") & is_access)
    rows = (
        # Text compresses well: a scan has few tasks, and files of one kind may lie together.
        files.select("repo", "path", "content").repartition(text_partitions(files), *FILE_KEY)
        .select("repo", "path", kept.alias("kept"))
        .where(F.size("kept") > 1)
        .withColumn(
            "header",
            F.transform(T.csv_fields(F.element_at("kept", 1)), lambda c: F.lower(F.trim(c))),
        )
        .withColumn(
            "at",
            F.struct(*[
                F.coalesce(
                    *[F.nullif(F.array_position("header", n), F.lit(0)) for n in names], F.lit(0)
                ).cast("int").alias(column)
                for column, names in _ACCESS_COLUMNS.items()
            ]),
        )
        .select(
            "repo", "path", "at", F.explode(F.slice("kept", F.lit(2), F.size("kept"))).alias("row")
        )
        .withColumn("cells", T.csv_fields(F.col("row")))
    )

    def cell(column: str) -> Column:
        at = F.col(f"at.{column}")
        return F.when(at > 0, F.try_element_at("cells", at))

    def value(column: str) -> Column:
        text = F.trim(F.coalesce(cell(column), F.lit("")))
        if column.startswith("perm_"):
            return pytext.py_bool(cell(column), False).alias(column)
        return text.alias(column)

    return rows.select("repo", "path", *[value(c) for c in _ACCESS_COLUMNS]).where(
        "id <> '' OR model_id <> ''"
    )


def _value(code: Column, masked: Column) -> Column:
    """``STRUCT<text, items, entries>``: a manifest value as text, list and map.

    Adjacent string literals are joined.  A value that is no list is a list of
    itself; one that is no dictionary is an empty map.
    """
    quoted = r"""(?s)'''.*?'''|\"\"\".*?\"\"\"|'(?:[^'\\]++|\\.)*+'|"(?:[^"\\]++|\\.)*+\""""
    parts = F.transform(
        F.regexp_extract_all(code, F.lit(quoted), F.lit(0)), lambda p: pytext.literal(p)["text"]
    )
    is_list = code.rlike(r"^\s*[\[(]")
    text = (
        F.when(code.rlike(r"""^\s*['"]"""), F.array_join(parts, ""))
        .when(is_list, F.array_join(pytext.string_list(code), ","))
        .otherwise(F.coalesce(pytext.literal(code)["text"], F.lit("")))
    )
    no_items = F.array().cast("array<string>")
    return pytext.let(
        text,
        lambda t: F.struct(
            t.alias("text"),
            F.when(is_list, pytext.string_list(code))
            .when(t != "", F.array(t))
            .otherwise(no_items)
            .alias("items"),
            F.when(code.rlike(r"^\s*\{"), pytext.dict_literal(code, masked))
            .otherwise(F.create_map().cast("map<string,string>"))
            .alias("entries"),
        ),
    )


def manifests(files: DataFrame) -> DataFrame:
    """One row per manifest file: the known keys coerced, all others in ``extra``."""
    source = pytext.normalized_source(F.col("content"))
    rows = (
        files.where(F.col("name").isin(MANIFEST_FILES))
        .select("repo", "path", source.alias("source"))
        .withColumn(
            "masked",
            pytext.blank_comments(
                pytext.without(pytext.mask_source(F.col("source")), pytext.CONTINUATION)
            ),
        )
        # Comments are blank in the masked form; strings are fillers there.
        .withColumn("code", pytext.blank_comments(pytext.code_source(F.col("source"))))
        .withColumn("inside", pytext.bracketed(F.col("code"), F.col("masked"), "{"))
        .withColumn(
            "entries",
            F.coalesce(
                pytext.last_wins_map(
                    F.transform(
                        pytext.dict_entries(F.col("inside.code"), F.col("inside.masked")),
                        lambda e: F.struct(
                            e["key"].alias("key"), _value(e["code"], e["masked"]).alias("value")
                        ),
                    )
                ),
                F.create_map().cast(
                    "map<string,struct<text:string,items:array<string>,entries:map<string,string>>>"
                ),
            ),
        )
    )

    def entry(key: str) -> Column:
        return F.try_element_at("entries", F.lit(key))

    known = [*MANIFEST_STRINGS, *MANIFEST_LISTS, *MANIFEST_FLAGS, *MANIFEST_MAPS]
    return rows.select(
        "repo",
        "path",
        T.dir_name(F.col("path")).alias("module_path"),
        F.coalesce(1 + pytext.line_offset(F.col("masked"), F.col("inside.pos")), F.lit(1)).alias(
            "dict_line"
        ),
        *[F.coalesce(entry(k)["text"], F.lit("")).alias(k) for k in MANIFEST_STRINGS],
        *[
            F.coalesce(entry(k)["items"], F.array().cast("array<string>")).alias(k)
            for k in MANIFEST_LISTS
        ],
        *[
            F.coalesce(entry(k)["text"].isin("True", "1"), F.lit(default)).alias(k)
            for k, default in MANIFEST_FLAGS.items()
        ],
        *[
            F.coalesce(entry(k)["entries"], F.create_map().cast("map<string,string>")).alias(k)
            for k in MANIFEST_MAPS
        ],
        F.transform_values(
            F.map_filter("entries", lambda k, _: ~k.isin(known)), lambda _, v: v["text"]
        ).alias("extra"),
    )


_PO_STRING = r'(?:"(?:[^"\\]++|\\.)*+"\s*+)++'
_PO_ENTRY = (
    r"(?m)^[ \t]*msgid\s+(" + _PO_STRING + r")(?:msgid_plural\s+" + _PO_STRING + r")?"
    r"msgstr(?:\[0\])?\s+(" + _PO_STRING + ")"
)


def translations(files: DataFrame) -> DataFrame:
    """Translated messages of PO files; the language is the file name.

    Continued strings are joined, comments and empty translations skipped, and
    a repeated message keeps its last translation.
    """
    clean = F.regexp_replace(
        pytext.normalized_source(F.col("content")), r"(?m)^[ \t]*#[^\n]*", ""
    )

    def joined(text: Column) -> Column:
        parts = F.regexp_extract_all(text, F.lit(r'"((?:[^"\\]++|\\.)*+)"'), F.lit(1))
        return F.array_join(parts, "")

    rows = (
        files.where(F.col("type") == "po")
        .select(
            "repo",
            "path",
            F.regexp_replace("name", r"(?i)\.po$", "").alias("lang"),
            clean.alias("clean"),
        )
        .select(
            "repo",
            "path",
            "lang",
            F.posexplode(
                F.arrays_zip(
                    F.regexp_extract_all("clean", F.lit(_PO_ENTRY), F.lit(1)).alias("msgid"),
                    F.regexp_extract_all("clean", F.lit(_PO_ENTRY), F.lit(2)).alias("msgstr"),
                )
            ).alias("pos", "m"),
        )
        .select(
            "repo", "path", "lang", "pos",
            joined(F.col("m.msgid")).alias("msgid"),
            joined(F.col("m.msgstr")).alias("msgstr"),
        )
        .where("msgid <> '' AND msgstr <> ''")
    )
    return rows.groupBy("repo", "path", "lang", "msgid").agg(
        F.max_by("msgstr", "pos").alias("msgstr")
    )
