"""Nested blocks of lines: a sweep over the statements of a file with a stack of open blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from addonscope.functions.pytext import let

_OPEN = "struct<line:int,indent:int,body:int>"
_BLOCK = "struct<line:int,indent:int,body:int,around:array<int>>"


def _opened(starts: Column) -> Column:
    """Statements that open a block or may close one, with the indent of what a block would hold.

    Nothing deeper than the deepest header closes a block, so of a file without nested
    blocks only headers and statements at their indent remain.
    """

    def within(starts: Column) -> Column:
        deepest = F.array_max(F.transform(F.filter(starts, lambda s: s["opens"]), lambda s: s["indent"]))

        def event(s: Column, i: Column) -> Column:
            following = F.get(starts, i + 1)["indent"]
            return F.struct(
                s["line"].alias("line"), s["indent"].alias("indent"), s["opens"].alias("opens"),
                F.when(following > s["indent"], following).otherwise(s["indent"] + 4).alias("body"),
            )

        return let(
            deepest,
            lambda most: F.filter(F.transform(starts, event), lambda s: s["opens"] | (s["indent"] <= most)),
        )

    return let(starts, within)


def _sweep(events: Column) -> Column:
    """``ARRAY<STRUCT<line, block>>``: lines from which another block is the innermost one.

    The state is never bound to a variable on the way: that would copy all it holds.
    """
    start = F.struct(
        F.array().cast(f"array<{_OPEN}>").alias("stack"),
        F.array().cast(f"array<struct<line:int,block:{_BLOCK}>>").alias("changes"),
    )

    def step(acc: Column, e: Column) -> Column:
        own = F.struct(e["line"].alias("line"), e["indent"].alias("indent"), e["body"].alias("body"))
        # a statement closes every block whose header is not further out than it
        kept = F.filter(acc["stack"], lambda b: b["indent"] < e["indent"])
        last = F.try_element_at(acc["changes"], F.lit(-1))
        top = F.try_element_at(kept, F.lit(-1))

        def changed(innermost: Column, stack: Column) -> Column:
            block = F.struct(
                innermost["line"].alias("line"), innermost["indent"].alias("indent"),
                innermost["body"].alias("body"), F.transform(stack, lambda b: b["line"]).alias("around"),
            )
            return F.array_append(
                acc["changes"], F.struct(e["line"].alias("line"), F.when(innermost["line"].isNotNull(), block).alias("block"))
            )

        opened = F.array_append(kept, own)
        same = last.isNotNull() & last["block"]["line"].eqNullSafe(top["line"])
        return (
            F.when(e["opens"], F.struct(opened.alias("stack"), changed(own, opened).alias("changes")))
            .when(same, F.struct(kept.alias("stack"), acc["changes"].alias("changes")))
            .otherwise(F.struct(kept.alias("stack"), changed(top, kept).alias("changes")))
        )

    return F.aggregate(events, start, step, lambda acc: acc["changes"])


def _changes(events: Column) -> Column:
    """The sweep, started anew at every statement without indent, which closes all blocks."""

    def cut(events: Column) -> Column:
        places = F.filter(
            F.sequence(F.lit(0), F.size(events) - 1), lambda i: (i == 0) | (F.get(events, i)["indent"] == 0)
        )

        def pieces(places: Column) -> Column:
            return F.transform(
                places,
                lambda at, i: _sweep(
                    F.slice(events, at + 1, F.coalesce(F.get(places, i + 1), F.size(events)) - at)
                ),
            )

        return F.flatten(let(places, pieces))

    return let(events, lambda e: F.when(F.size(e) > 0, cut(e)))


def innermost_blocks(starts: Column, lines: Column) -> Column:
    """``ARRAY<STRUCT<line, indent, body, around>>``: the innermost open block of each of ``lines`` lines.

    ``starts`` are the statements ``ARRAY<STRUCT<line, indent, opens>>`` of one file in
    order.  A block opens at a statement with ``opens`` and holds what follows it up to the
    next statement that is not indented deeper, blocks within it included; ``body`` is the
    indent of its first statement, ``around`` the lines of all open blocks, its own last.
    NULL outside all blocks.
    """

    def spread(changes: Column) -> Column:
        nothing = F.array_repeat(F.lit(None).cast(_BLOCK), F.coalesce(changes[0]["line"] - 1, lines))
        runs = F.transform(
            changes,
            lambda c, i: F.array_repeat(
                c["block"], F.coalesce(F.get(changes, i + 1)["line"], lines + 1) - c["line"]
            ),
        )
        return F.flatten(F.concat(F.array(nothing), runs))

    empty = F.array().cast(f"array<struct<line:int,block:{_BLOCK}>>")
    return let(F.coalesce(_changes(_opened(starts)), empty), spread)
