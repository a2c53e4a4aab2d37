"""Python source files -> one row per class-level statement.

Everything that depends on the order of lines is worked out here, once, with
windows over ``(repo, path)``.  A file is at most a few MB, so a window
partition is bounded, and the single shuffle on that key serves every window
and the grouping.  All later operators are projections of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from addonscope.fixed_values import COMMENT_FILL, LEGACY_BASES, MODERN_BASES
from addonscope.functions import pytext
from addonscope.operators.scopes import innermost_blocks

FILE_KEY = ["repo", "path"]
#: Source text of a partition; as lines with their masks it is several times as large.
PARTITION_BYTES = 32 << 20

_BASES = "|".join(b.replace(".", r"\.") for b in LEGACY_BASES + MODERN_BASES)


def import_style(content: Column) -> Column:
    """old, new or unknown, by the framework package a file imports."""
    return (
        F.when(content.rlike(r"(?:^|\n)\s*(?:from|import)\s+openerp"), "old")
        .when(content.rlike(r"(?:^|\n)\s*(?:from|import)\s+odoo"), "new")
        .otherwise("unknown")
    )


def explode_lines(files: DataFrame) -> DataFrame:
    """Files -> numbered lines ``(repo, path, line_no, text, indent)``."""
    return (
        files.where(F.length("content") > 0)
        .select(
            *FILE_KEY, F.posexplode(F.split("content", r"\r?\n", -1)).alias("pos", "text")
        )
        .select(
            *FILE_KEY,
            (F.col("pos") + 1).alias("line_no"),
            "text",
            pytext.indent(F.col("text")).alias("indent"),
        )
    )


def text_partitions(files: DataFrame) -> int:
    """Partitions of about ``PARTITION_BYTES`` of text, at least what the session asks for."""
    spark = files.sparkSession
    size = "size" if "size" in files.columns else F.octet_length("content")
    total = files.agg(F.sum(size)).first()[0] or 0
    return max(
        int(spark.conf.get("spark.sql.shuffle.partitions")),
        spark.sparkContext.defaultParallelism,
        -(-total // PARTITION_BYTES),
    )


def lexed_lines(files: DataFrame) -> DataFrame:
    """Lines of the files with their masked form, spread by file.

    The partition number follows from the text, because a few bytes of shuffled
    text become many lines: sized by the bytes of the shuffle, the partitions
    would be too large.
    """
    return (
        files.repartition(text_partitions(files), *FILE_KEY)
        # Per file, below the explode: not once per line.
        .select(*FILE_KEY, import_style(F.col("content")).alias("style"), "content")
        .select(
            *FILE_KEY,
            "style",
            F.posexplode(pytext.source_lines(F.col("content"))).alias("pos", "line"),
        )
        .select(
            *FILE_KEY,
            "style",
            (F.col("pos") + 1).alias("line_no"),
            F.col("line.text").alias("text"),
            F.ltrim(F.col("line.masked"), F.lit(pytext.CONTINUATION)).alias("masked"),
            F.startswith("line.masked", F.lit(pytext.CONTINUATION)).alias("continued"),
        )
    )


def _frames():
    by_line = Window.partitionBy(*FILE_KEY).orderBy("line_no")
    return (
        by_line.rowsBetween(Window.unboundedPreceding, -1),
        by_line.rowsBetween(Window.unboundedPreceding, 0),
    )


def _started_lines(lines: DataFrame) -> DataFrame:
    """Adds indent, bracket depth before the line, and whether a statement starts here.

    The depth starts again at a ``class`` or ``def`` header, which cannot stand
    inside brackets, so an unbalanced bracket spoils one block and not the rest
    of the file.
    """
    before, so_far = _frames()
    blank = F.trim(pytext.without(F.col("masked"), COMMENT_FILL + "\t\r\f")) == ""
    header = ~F.col("continued") & F.col("masked").rlike(
        r"^\s*(?:(?:async\s+)?def|class)\s+\w+\s*[(:]"
    )
    opened = F.coalesce(F.sum("delta").over(before), F.lit(0))
    base = F.coalesce(F.last(F.when(header, F.col("opened")), True).over(so_far), F.lit(0))
    return (
        lines.select("*", pytext.bracket_delta(F.col("masked")).alias("delta"))
        .select("*", opened.alias("opened"))
        .select("*", (F.col("opened") - base).alias("depth"))
        .select(
            *FILE_KEY, "style", "line_no", "text", "masked", "continued", "depth",
            pytext.indent(F.col("text")).alias("indent"),
            (~blank & ~F.col("continued") & (F.col("depth") <= 0)).alias("starts"),
        )
    )


def _statement() -> Column:
    """First line of the statement a line is part of, NULL between statements."""
    _, so_far = _frames()
    return F.when(
        F.col("starts") | F.col("continued") | (F.col("depth") > 0),
        F.last(F.when(F.col("starts"), F.col("line_no")), True).over(so_far),
    )


def statement_lines(lines: DataFrame) -> DataFrame:
    """Lexed lines with the statement each belongs to.

    ``depth``: brackets open before the line.  ``starts``: a statement begins
    here.  ``stmt``: first line of the statement the line is part of, NULL on
    blank and comment lines between statements.
    """
    return _started_lines(lines).select("*", _statement().alias("stmt"))


#: A class within a class, or a text that looks like one.
_NESTED = r"(?m)^[ \t]+class\s+\w"


def _placed_lines(lines: DataFrame) -> DataFrame:
    """Adds to started lines their statement, the one before, and whether a class opens."""
    before, _ = _frames()
    starts = F.col("starts")
    start = F.struct(
        F.col("line_no").alias("line"), F.col("masked").rlike(r"^\s*@").alias("decorates")
    )
    return _started_lines(lines).select(
        *FILE_KEY, "style", "line_no", "text", "masked", "indent", "starts",
        _statement().alias("stmt"),
        F.last(F.when(starts, start), True).over(before).alias("previous"),
        (starts & F.col("masked").rlike(r"^\s*class\s+\w+")).alias("opens"),
    )


_PARTS = ("line_no", "text", "masked", "indent", "starts", "stmt", "previous")


def _plain_class_lines(lines: DataFrame) -> DataFrame:
    """Lines of the classes of files without nested ones: windows over the file do."""
    _, so_far = _frames()
    at_top = F.struct(F.col("line_no").alias("line"), F.col("opens").alias("opens"))
    inside = (
        _placed_lines(lines)
        .select(
            "*",
            F.last(F.when(F.col("starts") & (F.col("indent") == 0), at_top), True).over(so_far).alias("top"),
        )
        .where("top.opens")
    )
    first = F.col("starts") & (F.col("previous.line") == F.col("top.line"))
    body = F.last(
        F.when(first, F.struct(F.col("top.line").alias("of"), F.col("indent").alias("indent"))), True
    ).over(so_far)
    return inside.select("*", body.alias("body")).select(
        *FILE_KEY, "style", *_PARTS,
        F.col("top.line").alias("class_line"),
        F.lit(0).alias("class_indent"),
        F.when(F.col("body.of") == F.col("top.line"), F.col("body.indent")).otherwise(4).alias("body_indent"),
        F.array("top.line").alias("around"),
    )


def _nested_class_lines(lines: DataFrame) -> DataFrame:
    """Lines of the classes of files with classes at any depth.

    The lines of a file are brought together once, for the sweep that follows
    blocks within blocks; the grouping needs no exchange.
    """
    parts = (*_PARTS, "opens")
    files = _placed_lines(lines).groupBy(*FILE_KEY).agg(
        F.first("style").alias("style"),
        F.array_sort(F.collect_list(F.struct(*parts))).alias("lines"),
    )
    starting = F.transform(
        F.filter("lines", lambda x: x["starts"]),
        lambda x: F.struct(
            x["line_no"].alias("line"), x["indent"].alias("indent"), x["opens"].alias("opens")
        ),
    )
    blocks = innermost_blocks(starting, F.size("lines"))
    return (
        files.select(
            *FILE_KEY, "style",
            F.explode(F.arrays_zip(F.col("lines").alias("own"), blocks.alias("block"))).alias("x"),
        )
        .where("x.block IS NOT NULL")
        .select(
            *FILE_KEY, "style",
            *[F.col(f"x.own.{c}").alias(c) for c in _PARTS],
            F.col("x.block.line").alias("class_line"),
            F.col("x.block.indent").alias("class_indent"),
            F.col("x.block.body").alias("body_indent"),
            F.col("x.block.around").alias("around"),
        )
    )


def _class_lines(lines: DataFrame, of_class: list[str]) -> DataFrame:
    """Adds the class-level statement of every line.

    ``of_class`` are the keys within which a class is looked at: where classes are
    nested its own lines alone, so a class inside a method does not end the method
    around it; else the file, whose order the lines have already.
    """
    starts, level, line_no = F.col("starts"), F.col("indent"), F.col("line_no")
    decorates = F.col("masked").rlike(r"^\s*@")
    is_header = line_no == F.col("class_line")
    lines = lines.select(
        "*", (starts & (is_header | (level <= F.col("body_indent")))).alias("member")
    )
    # A run of decorators belongs to the statement right below it.
    first = F.col("member") & (
        ~F.coalesce(F.col("previous.decorates"), F.lit(False)) | is_header
    )
    head = F.struct(
        line_no.alias("line"),
        F.col("masked").rlike(r"^\s*(?:async\s+)?def\s+\w+\s*\(").alias("is_def"),
    )
    so_far = Window.partitionBy(*of_class).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.select(
        *FILE_KEY, "style", "line_no", "text", "masked", "indent", "starts", "stmt",
        "class_line", "class_indent", "around",
        F.last(F.when(first, line_no), True).over(so_far).alias("item"),
        F.last(F.when(F.col("member") & ~decorates, head), True).over(so_far).alias("head"),
        # Before its head, an item consists of decorators.
    ).select("*", (F.col("head.line") >= F.col("item")).alias("at_head"))


def _decorator_text(code: Column, masked: Column) -> Column:
    """Name and arguments of a decorator line run."""
    args = F.concat(F.lit("("), pytext.bracketed(code, masked, "(")["code"], F.lit(")"))
    return F.concat(
        F.regexp_extract(code, r"^\s*@([\w.]+)", 1), F.coalesce(args, F.lit(""))
    )


def _item_rows(lines: DataFrame) -> DataFrame:
    """One row per class-level statement; a ``def`` carries decorators and body lines.

    What a line contributes is decided before the grouping, so a group collects
    the lines of its statement and, for a ``def`` only, those of its body.
    """
    in_head = F.col("at_head") & (F.col("stmt") == F.col("head.line"))
    after = F.col("at_head") & (F.col("line_no") > F.col("head.line")) & ~F.coalesce(
        in_head, F.lit(False)
    )
    pair = F.struct(
        "line_no",
        pytext.strip_comment(F.col("text"), F.col("masked")).alias("code"),
        pytext.blank_comments(F.col("masked")).alias("masked"),
    )
    body_line = F.struct("line_no", "stmt", "starts", "indent", "text", "masked")
    decorator_line = F.struct(
        "line_no", "stmt", "starts",
        pytext.strip_comment(F.col("text"), F.col("masked")).alias("code"),
        pytext.blank_comments(F.col("masked")).alias("masked"),
    )

    def sorted_lines(condition: Column, value: Column) -> Column:
        return F.array_sort(F.collect_list(F.when(condition, value)))

    grouped = lines.groupBy(*FILE_KEY, "item").agg(
        F.first("style").alias("style"),
        F.max("class_line").alias("class_line"),
        F.max("class_indent").alias("class_indent"),
        F.first("around").alias("around"),
        F.max(F.when(F.col("at_head"), F.col("head"))).alias("head"),
        F.max(F.when(F.col("stmt").isNotNull(), F.col("line_no"))).alias("end_line"),
        F.max(F.when(in_head, F.col("line_no"))).alias("head_end"),
        F.max(F.when(F.col("line_no") == F.col("head.line"), F.col("indent"))).alias("indent"),
        sorted_lines(in_head, pair).alias("head_lines"),
        sorted_lines(after & F.col("head.is_def"), body_line).alias("body"),
        sorted_lines(~F.col("at_head") & F.col("stmt").isNotNull(), decorator_line).alias("above"),
    )
    kind = (
        F.when(F.col("line") == F.col("class_line"), "class")
        .when(F.col("head.is_def"), "def")
        .when(F.col("masked").rlike(r"^\s*\w+\s*=(?!=)"), "assign")
        .otherwise("other")
    )

    def decorators(above: Column) -> Column:
        return F.transform(
            F.filter(above, lambda x: x["starts"]),
            lambda d: pytext.let(
                F.filter(above, lambda x: x["stmt"] == d["line_no"]),
                lambda own: F.struct(
                    d["line_no"].alias("line"),
                    _decorator_text(
                        F.array_join(F.transform(own, lambda x: x["code"]), "\n"),
                        F.array_join(F.transform(own, lambda x: x["masked"]), "\n"),
                    ).alias("text"),
                ),
            ),
        )

    return (
        # Decorators above nothing have no head.
        grouped.where("head IS NOT NULL")
        .withColumn("line", F.col("head.line"))
        .withColumn("code", F.array_join("head_lines.code", "\n"))
        .withColumn("masked", F.array_join("head_lines.masked", "\n"))
        .withColumn("kind", kind)
        .withColumn(
            "target",
            F.when(F.col("kind") == "assign", F.regexp_extract("masked", r"^\s*(\w+)", 1)),
        )
        .withColumn(
            "decorators", F.when(F.col("kind") == "def", decorators(F.col("above")))
        )
        .withColumn("body", F.when(F.col("kind") == "def", F.col("body")))
        .drop("head_lines", "head", "above", "item")
    )


def _with_outer(items: DataFrame) -> DataFrame:
    """Adds a row without content for every class around the class of a statement.

    It takes the end of the statement to those classes; items outside nested classes
    stay alone.
    """
    own = F.col("of") == F.col("class_line")
    kept = [c for c in items.columns if c not in (*FILE_KEY, "line", "end_line", "class_line", "class_indent", "around")]
    content = [F.when(own, F.col(c)).alias(c) for c in kept if c != "kind"]
    return items.select("*", F.explode("around").alias("of")).select(
        *FILE_KEY, "line", "end_line", "class_indent", F.col("of").alias("class_line"),
        F.when(own, F.col("kind")).otherwise("within").alias("kind"), *content,
    )


def _strings(code: Column) -> Column:
    """Strings of an ``_inherit`` value: one literal, a list or a tuple."""
    lit = pytext.literal(code)
    return F.when(code.rlike(r"^\s*[\[(]"), pytext.string_list(code)).when(
        lit["kind"] == "string", F.array(lit["text"])
    )


def _text(code: Column) -> Column:
    lit = pytext.literal(code)
    return F.when(lit["kind"] == "string", F.nullif(lit["text"], F.lit("")))


def class_items(files: DataFrame) -> DataFrame:
    """Class-level statements of all classes that extend a known base.

    Every row carries its model, so later operators need no join back.
    Files without such a class leave before the shuffle.
    """
    files = files.where(F.col("type") == "python").where(
        F.col("content").rlike(r"(?m)^[ \t]*class\s+\w+\s*\([^)]*(?:" + _BASES + ")")
    )
    nested = F.col("content").rlike(_NESTED)
    plain = _class_lines(_plain_class_lines(lexed_lines(files.where(~nested))), FILE_KEY)
    deep = _class_lines(_nested_class_lines(lexed_lines(files.where(nested))), [*FILE_KEY, "class_line"])
    items = _item_rows(plain).drop("around").unionByName(_with_outer(_item_rows(deep)))

    value = F.regexp_replace("code", r"^\s*\w+\s*=", "")
    value_masked = F.regexp_replace("masked", r"^\s*\w+\s*=", "")
    # Worked out once per statement that sets an attribute of the class.
    items = items.select(
        "*",
        F.when(
            F.col("target").isin("_name", "_description", "_order", "_rec_name"), _text(value)
        ).alias("as_text"),
        F.when(F.col("target") == "_inherit", _strings(value)).alias("as_list"),
        F.when(
            F.col("target").isin("_inherits", "_defaults"),
            pytext.dict_literal(value, value_masked),
        ).alias("as_map"),
    )
    attributes = {
        "_name": "as_text",
        "_inherit": "as_list",
        "_inherits": "as_map",
        "_description": "as_text",
        "_order": "as_text",
        "_rec_name": "as_text",
        "_defaults": "as_map",
    }
    whole = (
        Window.partitionBy(*FILE_KEY, "class_line")
        .orderBy("line")
        .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )

    def over_class(own_value: Column) -> Column:
        return F.first(own_value, True).over(whole)

    header = r"^\s*class\s+(\w+)\s*\(([^)]*)\)\s*:"
    class_name = F.regexp_extract("header", header, 1)
    on_class = F.col("kind") == "class"
    items = items.select(
        "*",
        over_class(F.when(on_class, F.col("code"))).alias("header"),
        F.max("end_line").over(whole).alias("class_end"),
        *[
            over_class(F.when(F.col("target") == name, F.col(form))).alias("a" + name)
            for name, form in attributes.items()
        ],
    ).where((F.col("kind") != "within") & F.regexp_extract("header", header, 2).rlike(_BASES))
    inherit = F.coalesce("a_inherit", F.array().cast("array<string>"))
    return items.select(
        *FILE_KEY,
        "style",
        "class_line",
        "class_indent",
        class_name.alias("class_name"),
        F.coalesce(
            "a_name",
            F.when(F.size(inherit) == 1, F.element_at(inherit, 1)),
            F.lower(F.regexp_replace(class_name, "([a-z])([A-Z])", "$1.$2")),
        ).alias("model"),
        F.col("a_name").isNotNull().alias("explicit_name"),
        inherit.alias("inherit"),
        "line",
        "end_line",
        "indent",
        "kind",
        "target",
        "code",
        "masked",
        "decorators",
        "head_end",
        "body",
        F.when(F.col("target").isNotNull(), F.col("a_defaults")).alias("defaults"),
        F.when(on_class, F.regexp_extract("header", header, 2)).alias("bases"),
        *[
            F.when(on_class, F.coalesce("a" + name, F.lit(""))).alias(name.lstrip("_"))
            for name in ("_description", "_order", "_rec_name")
        ],
        F.when(on_class, F.col("a_inherits")).alias("inherits"),
        F.when(on_class, F.col("class_end")).alias("class_end"),
    )
