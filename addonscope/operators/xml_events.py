"""XML files as streams of tokens, looked through with a stack of open elements.

Every tag token carries its line.  A record reaches from its start tag to its end tag, or
where that is missing to the next record; the tokens of each are swept on their own, for
the fields and for what is wrong inside.  A second sweep over what lies outside records
finds end tags that close nothing, elements that are not closed, and text that begins like
a tag and is none.  Both go on after an error, so one broken record costs that record.

A fold copies its state at every element, so no state here grows with a file: records are
swept apart, and errors are gathered for a few hundred tokens at a time.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from addonscope.functions.pytext import let

#: Elements that are found by their start tag alone.
TAGS = ["menuitem", "act_window", "report"]

#: Tokens whose errors are gathered before they join the others.
_CHUNK = 256

# Characters that XML does not allow; between them the line of the tag that follows.
_MARK, _END_MARK = "\u0005", "\u0006"
_LINE = f"{_MARK}[0-9]++{_END_MARK}"
# One token per match and every character in exactly one token; possessive, so linear.
_TOKENS = (
    f"{_LINE}<!--[^-]*+(?:-(?!->)[^-]*+)*+(?:-->|\\z)"
    f"|{_LINE}<!\\[CDATA\\[[^\\]]*+(?:\\](?!\\]>)[^\\]]*+)*+(?:\\]\\]>|\\z)"
    f"|{_LINE}<\\?[^?]*+(?:\\?(?!>)[^?]*+)*+(?:\\?>|\\z)"
    f"|{_LINE}<![A-Za-z][^>]*+>"
    f"|{_LINE}</[\\p{{L}}_:][^<>{_MARK}]*+>"
    f"|{_LINE}<[\\p{{L}}_:][^<>\"'{_MARK}]*+"
    f"(?:(?:\"[^\"<{_MARK}]*+\"|'[^'<{_MARK}]*+')[^<>\"'{_MARK}]*+)*+>"
    f"|{_LINE}<"
    f"|[^{_MARK}]++"
)

_SPAN = "struct<first:int,last:int>"
_ERROR = "struct<line:int,message:string>"
_OPEN = "struct<name:string,line:int>"


def tokens(content: Column) -> Column:
    """``ARRAY<STRUCT<text, line, kind, name, at>>``: tags, comments, sections, and text between.

    kind: open, close, empty, broken, or NULL for what has no structure.  Text has no line.
    """
    clean = F.when(
        F.contains(content, F.lit(_MARK)) | F.contains(content, F.lit(_END_MARK)), F.translate(content, _MARK + _END_MARK, "")
    ).otherwise(content)
    lines = F.split(clean, "\n", -1)
    marked = F.array_join(
        F.transform(
            lines,
            lambda line, i: F.when(F.contains(line, F.lit("<")), F.replace(
                line, F.lit("<"), F.concat(F.lit(_MARK), (i + 1).cast("string"), F.lit(_END_MARK + "<"))
            )).otherwise(line),
        ),
        "\n",
    )

    def token(raw: Column, at: Column) -> Column:
        tagged = F.startswith(raw, F.lit(_MARK))
        place = F.locate(_END_MARK, raw)
        own = F.substr(raw, place + 1)
        # sections and comments may hold further marks
        text = F.when(~tagged, raw).when(
            F.startswith(own, F.lit("<!")), F.regexp_replace(own, _LINE, "")
        ).otherwise(own)
        line = F.when(tagged, F.substr(raw, F.lit(2), place - 2).cast("int"))
        return F.struct(text.alias("text"), line.alias("line"), at.alias("at"))

    def named(t: Column) -> Column:
        head = F.left(t["text"], F.lit(2))
        kind = (
            F.when(t["line"].isNull() | head.isin("<!", "<?"), F.lit(None))
            .when(t["text"] == "<", "broken")
            .when(head == "</", "close")
            .when(F.endswith(t["text"], F.lit("/>")), "empty")
            .otherwise("open")
        )
        return F.struct(
            t["text"].alias("text"), t["line"].alias("line"), kind.alias("kind"),
            F.when(kind.isNotNull(), F.regexp_extract(t["text"], r"^</?([^\s/>]+)", 1)).alias("name"),
            t["at"].alias("at"),
        )

    return F.transform(F.transform(F.regexp_extract_all(marked, F.lit(_TOKENS), F.lit(0)), token), named)


def _empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _nothing(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _updated(acc: Column, names: tuple[str, ...], **changes: Column) -> Column:
    return F.struct(*[changes.get(n, acc[n]).alias(n) for n in names])


def _last_open(stack: Column, name: Column) -> Column:
    """Height at which an element of that name is open, the innermost one, or NULL."""
    return F.array_max(F.transform(stack, lambda x, i: F.when(x["name"] == name, i + 1)))


def _upto(stack: Column, height: Column) -> Column:
    return F.slice(stack, F.lit(1), F.greatest(height, F.lit(0)))


def _record(own: Column) -> Column:
    """``STRUCT<first, last, line, bad_line, fields>`` of a record out of its tokens and what follows.

    ``last`` is its end tag, or where that is missing what lies before the first end tag
    that closes nothing inside it, or the last token; ``bad_line`` where it goes wrong first.
    """
    names = ("stack", "last", "stray", "bad_line", "fields")
    start = F.struct(
        _empty("struct<name:string,at:int>").alias("stack"), _nothing("int").alias("last"),
        _nothing("int").alias("stray"), _nothing("int").alias("bad_line"), _empty(_SPAN).alias("fields"),
    )

    def step(acc: Column, t: Column) -> Column:
        stack, kind, name = acc["stack"], t["kind"], t["name"]
        height = F.size(stack)
        top = F.try_element_at(stack, F.lit(-1))
        wrong = F.coalesce(acc["bad_line"], t["line"])
        pushed = F.array_append(stack, F.struct(name.alias("name"), t["at"].alias("at")))
        direct = (name == "field") & (height == 1)
        # an end tag that is not the innermost element's
        out = _last_open(stack, name)
        change = lambda **c: _updated(acc, names, **c)

        def field(first: Column) -> Column:
            return F.array_append(acc["fields"], F.struct(first.alias("first"), t["at"].alias("last")))

        closes = top["name"] == name
        return (
            F.when(acc["last"].isNotNull(), acc)
            .when(kind == "open", change(stack=pushed))
            .when((kind == "empty") & direct, change(fields=field(t["at"])))
            .when(kind == "empty", acc)
            .when(kind == "broken", change(bad_line=wrong))
            .when(closes & (height == 1), change(last=t["at"]))
            .when(closes & (name == "field") & (height == 2), change(stack=_upto(stack, height - 1), fields=field(top["at"])))
            .when(closes, change(stack=_upto(stack, height - 1)))
            .when(out.isNull(), change(bad_line=wrong, stray=F.coalesce(acc["stray"], t["at"])))
            .when(out == 1, change(bad_line=wrong, last=t["at"]))
            .otherwise(change(bad_line=wrong, stack=_upto(stack, out - 1)))
        )

    def finish(acc: Column) -> Column:
        first, end = F.get(own, F.lit(0)), F.get(own, F.size(own) - 1)["at"]
        cut = F.coalesce(acc["stray"] - 1, end)
        return F.struct(
            first["at"].alias("first"), F.coalesce(acc["last"], cut).alias("last"), first["line"].alias("line"),
            F.when(acc["last"].isNull(), F.coalesce(acc["bad_line"], first["line"]))
            .otherwise(acc["bad_line"]).alias("bad_line"),
            acc["fields"].alias("fields"),
        )

    return F.aggregate(F.filter(own, lambda t: t["kind"].isNotNull()), start, step, finish)


def _unclosed(stack: Column) -> Column:
    return F.transform(stack, lambda x: _error(x["line"], F.concat(F.lit("<"), x["name"], F.lit("> is not closed"))))


def _error(line: Column, message: Column) -> Column:
    return F.struct(line.alias("line"), message.alias("message"))


def _errors(outside: Column) -> Column:
    """``ARRAY<STRUCT<line, message>>``: tags outside records that do not match."""
    names = ("stack", "errors")

    def empty(stack: Column) -> Column:
        return F.struct(stack.alias("stack"), _empty(_ERROR).alias("errors"))

    def step(acc: Column, t: Column) -> Column:
        stack, kind, name = acc["stack"], t["kind"], t["name"]
        height = F.size(stack)
        out = _last_open(stack, name)
        change = lambda **c: _updated(acc, names, **c)
        said = lambda *parts: F.array_append(acc["errors"], _error(t["line"], F.concat(*parts)))
        return (
            F.when(kind == "open", change(
                stack=F.array_append(stack, F.struct(name.alias("name"), t["line"].alias("line")))
            ))
            .when(kind == "empty", acc)
            .when(kind == "broken", change(errors=said(F.lit("< does not begin a tag"))))
            .when(F.try_element_at(stack, F.lit(-1))["name"] == name, change(stack=_upto(stack, height - 1)))
            .when(out.isNull(), change(errors=said(F.lit("</"), name, F.lit("> closes nothing"))))
            .otherwise(change(
                stack=_upto(stack, out - 1),
                errors=F.concat(acc["errors"], _unclosed(F.slice(stack, out + 1, height - out))),
            ))
        )

    def gathered(acc: Column, chunk: Column) -> Column:
        return let(
            F.aggregate(chunk, empty(acc["stack"]), step),
            lambda x: F.struct(x["stack"].alias("stack"), F.concat(acc["errors"], x["errors"]).alias("errors")),
        )

    def swept(tags: Column) -> Column:
        chunks = F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(tags), F.lit(1)), F.lit(_CHUNK)), lambda at: F.slice(tags, at, F.lit(_CHUNK))
        )
        return F.aggregate(
            chunks, empty(_empty(_OPEN)), gathered, lambda acc: F.concat(acc["errors"], _unclosed(acc["stack"]))
        )

    return let(F.filter(outside, lambda t: t["kind"].isNotNull()), swept)


def _text_only(token: Column) -> Column:
    """A token as part of plain text, still escaped: tags and comments vanish."""
    text = token["text"]
    section = F.substr(text, F.lit(10), F.greatest(F.length(text) - 12, F.lit(0)))
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        section = F.replace(section, F.lit(plain), F.lit(escaped))
    return (
        F.when(token["line"].isNull(), text)
        .when(F.startswith(text, F.lit("<![CDATA[")), section)
        .otherwise("")
    )


def _joined(tokens: Column) -> Column:
    """Text of tokens without comments."""
    kept = F.filter(tokens, lambda t: ~F.startswith(t["text"], F.lit("<!--")))
    return F.array_join(F.transform(kept, lambda t: t["text"]), "")


def elements(content: Column) -> Column:
    """``ARRAY<STRUCT<tag, pos, line, bad_line, xml, flat, inner>>``; errors have the tag ``error``.

    ``pos`` orders the elements of a file.  ``xml`` is the text of a malformed record without
    comments, or the message of an error.  ``flat`` is a well-formed record whose fields have
    lost the tags inside them and kept all text; of another element its start tag, closed.
    ``inner`` holds, in the order of the fields of a record, the XML inside those of type xml
    or named arch.
    """
    no_inner = _empty("string")

    def record_row(tokens: Column, r: Column) -> Column:
        own = F.slice(tokens, r["first"] + 1, r["last"] - r["first"] + 1)
        start = lambda span: F.get(tokens, span["first"])["text"]
        within = lambda span: F.slice(
            tokens, span["first"] + 2, F.greatest(span["last"] - span["first"] - 1, F.lit(0))
        )
        fields = F.transform(r["fields"], lambda span: F.concat(
            start(span),
            F.when(
                span["last"] > span["first"],
                F.concat(F.array_join(F.transform(within(span), _text_only), ""), F.lit("</field>")),
            ).otherwise(""),
        ))
        inner = F.transform(r["fields"], lambda span: F.when(
            start(span).rlike(r"""\s(?:type\s*=\s*["']xml|name\s*=\s*["']arch)["']"""), _joined(within(span))
        ))
        return F.struct(
            F.lit("record").alias("tag"), r["first"].alias("pos"), r["line"].alias("line"),
            r["bad_line"].alias("bad_line"), F.when(r["bad_line"].isNotNull(), _joined(own)).alias("xml"),
            F.when(
                r["bad_line"].isNull(), F.concat(start(r), F.array_join(fields, ""), F.lit("</record>"))
            ).alias("flat"),
            inner.alias("inner"),
        )

    def tag_row(t: Column) -> Column:
        return F.struct(
            t["name"].alias("tag"), t["at"].alias("pos"), t["line"].alias("line"), _nothing("int").alias("bad_line"),
            _nothing("string").alias("xml"), F.regexp_replace(t["text"], r"/?>$", "/>").alias("flat"), no_inner.alias("inner"),
        )

    def error_row(e: Column, size: Column, i: Column) -> Column:
        return F.struct(
            F.lit("error").alias("tag"), (size + i).alias("pos"), e["line"].alias("line"), e["line"].alias("bad_line"),
            e["message"].alias("xml"), _nothing("string").alias("flat"), no_inner.alias("inner"),
        )

    def rows(tokens: Column) -> Column:
        size = F.size(tokens)
        starts = F.transform(
            F.filter(tokens, lambda t: (t["kind"] == "open") & (t["name"] == "record")), lambda t: t["at"]
        )
        alone = F.filter(
            tokens,
            lambda t: (t["kind"].isin("open", "empty") & t["name"].isin(TAGS))
            | ((t["kind"] == "empty") & (t["name"] == "record")),
        )

        def records(starts: Column) -> Column:
            return F.transform(starts, lambda at, i: let(
                F.slice(tokens, at + 1, F.coalesce(F.get(starts, i + 1), size) - at), _record
            ))

        def all_rows(found: Column) -> Column:
            head = F.slice(tokens, F.lit(1), F.coalesce(F.get(found, F.lit(0))["first"], size))
            tails = F.transform(found, lambda r, i: F.slice(
                tokens, r["last"] + 2, F.coalesce(F.get(found, i + 1)["first"], size) - r["last"] - 1
            ))
            wrong = _errors(F.concat(head, F.flatten(tails)))
            return F.concat(
                F.transform(found, lambda r: record_row(tokens, r)),
                F.transform(alone, tag_row),
                F.transform(wrong, lambda e, i: error_row(e, size, i)),
            )

        return let(let(starts, records), all_rows)

    return let(tokens(content), rows)
