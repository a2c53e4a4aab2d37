"""Column expressions for paths, CSV lines, XML fragments and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_path(path: Column) -> Column:
    return F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/"))


def dir_name(path: Column) -> Column:
    """Everything before the last slash; empty where there is none."""
    return F.regexp_extract(normalize_path(path), r"(?s)^(.*)/", 1)


def base_name(path: Column) -> Column:
    return F.substring_index(normalize_path(path), "/", -1)


def extension(path: Column) -> Column:
    """Lower-case text after the last dot of the file name; empty where there is none."""
    return F.lower(F.regexp_extract(base_name(path), r"\.([^.]*)$", 1))


def file_type(name: Column) -> Column:
    """python, xml, csv, po or other, by the end of the name in any case."""
    lower = F.lower(F.coalesce(name, F.lit("")))
    return (
        F.when(lower.endswith(".py"), "python")
        .when(lower.endswith(".xml"), "xml")
        .when(lower.endswith(".csv"), "csv")
        .when(lower.endswith(".po"), "po")
        .otherwise("other")
    )


def ancestor_dirs(directory: Column) -> Column:
    """A directory and all directories above it, the empty root included."""
    parts = F.split(directory, "/")
    return F.when(directory == "", F.array(F.lit(""))).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.size(parts)),
            lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"),
        )
    )


def csv_fields(line: Column) -> Column:
    """Fields of one CSV line: commas inside quotes stay, ``""`` is a quote."""
    cells = F.regexp_extract_all(
        F.concat(F.lit(","), line), F.lit(r',([^,"]*(?:"[^"]*(?:"|$)[^,"]*)*)'), F.lit(1)
    )

    def cell(c: Column) -> Column:
        whole = r'(?s)^"((?:[^"]|"")*+)"$'
        return F.when(
            c.rlike(whole), F.replace(F.regexp_extract(c, whole, 1), F.lit('""'), F.lit('"'))
        ).otherwise(
            F.translate(
                F.replace(
                    F.regexp_replace(c, r'(?<=[^"])""(?=[^"])', '\u0001'), F.lit('"'), F.lit("")
                ),
                "\u0001",
                '"',
            )
        )

    return F.transform(cells, cell)


def comma_list(text: Column) -> Column:
    """Trimmed, non-empty parts of a comma-separated text."""
    return F.filter(
        F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda g: F.trim(g)),
        lambda g: g != "",
    )


def identifier(text: Column) -> Column:
    """Every character outside letters, digits and underscore becomes an underscore."""
    return F.regexp_replace(text, "[^a-zA-Z0-9_]", "_")


def diagram_id(model: Column) -> Column:
    """Upper-case diagram identifier of a dotted model name."""
    return F.when(F.coalesce(model, F.lit("")) == "", "UNKNOWN").otherwise(
        F.upper(F.replace(model, F.lit("."), F.lit("_")))
    )


# Characters with a meaning in diagram text and their stand-ins.
_LABEL_FROM = "()[]{}\"|"
_LABEL_TO = "❨❩⦋⦌❴❵'¦"


def diagram_label(text: Column) -> Column:
    """Label text that is safe inside a diagram, quoted where needed."""
    safe = F.translate(F.coalesce(text, F.lit("")), _LABEL_FROM, _LABEL_TO)
    return (
        F.when(safe == "", '""')
        .when(safe.rlike(r"[#;:&<>!@%^~`\\\s]"), F.concat(F.lit('"'), safe, F.lit('"')))
        .otherwise(safe)
    )


def escape_html(text: Column) -> Column:
    """The five markup characters as entities."""
    out = F.coalesce(text, F.lit(""))
    for char, entity in (
        ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;"),
    ):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def pascal_case(model: Column) -> Column:
    """Dotted model name as one capitalised word."""
    return F.array_join(
        F.transform(
            F.split(model, r"\."),
            lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.substr(p, F.lit(2))),
        ),
        "",
    )
