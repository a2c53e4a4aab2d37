"""Column expressions over Python source text.

All of them are built-in expressions.  Text is looked at through two equally
long forms: ``code`` (comments blanked) and ``masked`` (comments blanked and
the inside of string literals replaced by a filler), so a position found in the
masked form can be cut out of the code form.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from addonscope.fixed_values import COMMENT_FILL, CONTINUATION, STRING_FILL

# One token per match and every character in exactly one token.  Possessive
# groups keep the matcher iterative however long a literal is.
_TOKENS = (
    r"(?s)"
    r"'''(?:[^'\\]++|\\.|'(?!''))*+(?:'''|\z)"
    r'|"""(?:[^"\\]++|\\.|"(?!""))*+(?:"""|\z)'
    r"|'(?:[^'\\\n]++|\\.)*+'?"
    r'|"(?:[^"\\\n]++|\\.)*+"?'
    r"|#[^\n]*+"
    r"|\\\n"
    r"|[^'\"#\\]++"
    r"|\\"
)


def let(value: Column, body) -> Column:
    """``body`` of ``value``, with ``value`` worked out once."""
    return F.transform(F.array(value), body)[0]


def without(text: Column, characters: str) -> Column:
    """``text`` without some characters; a search for each is faster than a look at every character."""
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def normalized_source(content: Column) -> Column:
    """Source with a leading BOM dropped and ``\\r\\n`` turned into ``\\n``."""
    return F.replace(F.regexp_replace(content, "^\ufeff", ""), F.lit("\r\n"), F.lit("\n"))


def _fill_string(token: Column) -> Column:
    lined = F.replace(
        F.regexp_replace(token, r"[^\n]", STRING_FILL), F.lit("\n"), F.lit("\n" + CONTINUATION)
    )
    return F.when(F.contains(token, F.lit("\n")), lined).otherwise(
        F.repeat(F.lit(STRING_FILL), F.length(token))
    )


def _mask_quoted(token: Column, quote_len: int) -> Column:
    quote = F.left(token, F.lit(quote_len))
    closed = (F.length(token) >= 2 * quote_len) & F.endswith(token, quote)
    tail = F.substr(token, F.lit(quote_len + 1))
    inner = F.when(closed, F.left(tail, F.length(tail) - quote_len)).otherwise(tail)
    # Most literals end on their line, so all of it is filled at once.
    return F.when(
        closed & ~F.contains(token, F.lit("\n")),
        F.concat(quote, F.repeat(F.lit(STRING_FILL), F.length(token) - 2 * quote_len), quote),
    ).otherwise(
        F.concat(quote, _fill_string(inner), F.when(closed, quote).otherwise(F.lit("")))
    )


def _mask_token(token: Column) -> Column:
    head = F.left(token, F.lit(1))
    return (
        F.when(~head.isin("'", '"', "#", "\\"), token)
        .when(head == "#", F.repeat(F.lit(COMMENT_FILL), F.length(token)))
        .when(token.startswith("'''") | token.startswith('"""'), _mask_quoted(token, 3))
        .when(head.isin("'", '"'), _mask_quoted(token, 1))
        .when(token == "\\\n", F.lit(" \n" + CONTINUATION))
        .otherwise(token)
    )


def mask_source(source: Column) -> Column:
    """Equally long text with string bodies and comments replaced by fillers.

    A line that starts inside a literal, or after a trailing backslash, begins
    with the continuation mark.
    """
    return F.array_join(
        F.transform(F.regexp_extract_all(source, F.lit(_TOKENS), F.lit(0)), _mask_token), ""
    )


def code_source(source: Column) -> Column:
    """Equally long text with only the comments replaced by fillers."""
    return F.array_join(
        F.transform(
            F.regexp_extract_all(source, F.lit(_TOKENS), F.lit(0)),
            lambda t: F.when(
                t.startswith("#"), F.repeat(F.lit(COMMENT_FILL), F.length(t))
            ).otherwise(t),
        ),
        "",
    )


def source_lines(content: Column) -> Column:
    """``ARRAY<STRUCT<text, masked>>``, one element per line."""
    src = normalized_source(content)
    return F.arrays_zip(
        F.split(src, "\n", -1).alias("text"), F.split(mask_source(src), "\n", -1).alias("masked")
    )


def indent(text: Column) -> Column:
    """Leading blanks of a line; a tab counts as four."""
    return F.length(F.replace(F.regexp_extract(text, r"^[ \t]*", 0), F.lit("\t"), F.lit("    ")))


def forms(source: Column) -> Column:
    """``STRUCT<code, masked>`` of a piece of source, comments blanked in both."""
    return F.struct(
        blank_comments(code_source(source)).alias("code"),
        blank_comments(without(mask_source(source), CONTINUATION)).alias("masked"),
    )


def statements(lines: Column) -> Column:
    """``ARRAY<STRUCT<line, code, masked>>`` of the statements of a body, in one pass.

    ``lines`` has consecutive numbers; a statement reaches to the start of the next one.
    """
    first = F.get(lines, F.lit(0))["line_no"]
    end = first + F.size(lines)

    def joined(own: Column, form) -> Column:
        return F.array_join(F.transform(own, form), "\n")

    def cut(starts: Column) -> Column:
        def one(start: Column, i: Column) -> Column:
            size = F.coalesce(F.get(starts, i + 1), end) - start
            own = F.filter(F.slice(lines, start - first + 1, size), lambda x: x["stmt"] == start)
            return let(
                own,
                lambda x: F.struct(
                    start.alias("line"),
                    joined(x, lambda l: strip_comment(l["text"], l["masked"])).alias("code"),
                    joined(x, lambda l: blank_comments(l["masked"])).alias("masked"),
                ),
            )

        return F.transform(starts, one)

    starts = F.transform(F.filter(lines, lambda x: x["starts"]), lambda x: x["line_no"])
    return let(starts, cut)


def bracket_delta(masked: Column) -> Column:
    """Brackets opened minus brackets closed."""
    return F.length(without(masked, ")]}")) - F.length(without(masked, "([{"))


def strip_comment(text: Column, masked: Column) -> Column:
    """The line with its trailing comment replaced by blanks."""
    kept = F.left(text, F.length(F.rtrim(masked, F.lit(COMMENT_FILL))))
    return F.rpad(kept, F.length(masked), " ")


def blank_comments(masked: Column) -> Column:
    return F.replace(masked, F.lit(COMMENT_FILL), F.lit(" "))


def line_offset(text: Column, position: Column) -> Column:
    """Line breaks before a 1-based position."""
    before = F.left(text, position - 1)
    return F.length(before) - F.length(without(before, "\n"))


# Tokens that end with a bracket, or with the text.
_BRACKETS = r"[^\[({\])}]*+[\[({\])}]"
# Bracket pairs with at most two levels of pairs inside, and what lies between them.
_PAIR = r"[\[({][^\[({\])}]*+[\])}]"
for _ in range(2):
    _PAIR = r"[\[({](?:[^\[({\])}]++|" + _PAIR + r")*+[\])}]"
_PAIRS = _PAIR + r"|[^\[({]++|[\[({]"
_LAMBDA = r"\blambda\b(?:(?!\blambda\b)[^:])*+(?:\blambda\b[^:]*+:[^:]*+)?:?"
_LAMBDAS = _LAMBDA + r"|(?s:(?!\blambda\b).)++"


def _depth_change(end: Column) -> Column:
    return F.when(end.isin("(", "[", "{"), 1).when(end.isin(")", "]", "}"), -1).otherwise(0)


def _deepest(masked: Column) -> Column:
    """How deep brackets are nested."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("most"))

    def step(acc: Column, token: Column) -> Column:
        depth = acc["depth"] + _depth_change(F.right(token, F.lit(1)))
        return F.struct(depth.alias("depth"), F.greatest(acc["most"], depth).alias("most"))

    tokens = F.regexp_extract_all(masked, F.lit(_BRACKETS), F.lit(0))
    return F.aggregate(tokens, start, step, lambda acc: acc["most"])


#: Pieces whose places are summed one after the other.
_FEW = 64
_ANY_BRACKET = r"[\[({\])}]"


def _filled_pairs(text: Column) -> Column:
    """Equally long text with the three innermost levels of bracket pairs filled."""
    return F.array_join(
        F.transform(
            F.regexp_extract_all(text, F.lit(_PAIRS), F.lit(0)),
            lambda t: F.when(
                F.left(t, F.lit(1)).isin("(", "[", "{") & (F.length(t) > 1),
                F.repeat(F.lit(STRING_FILL), F.length(t)),
            ).otherwise(t),
        ),
        "",
    )


def top_level(masked: Column) -> Column:
    """Equally long text with everything inside brackets filled, brackets included.

    Each round fills three levels of pairs, so few texts need a second one; only
    where two rounds leave some are the levels counted.  After a bracket that has no
    partner all is filled.
    """

    def once_more(text: Column, then) -> Column:
        return F.when(text.rlike(_ANY_BRACKET), let(_filled_pairs(text), then)).otherwise(text)

    def all_levels(text: Column) -> Column:
        return let(
            _deepest(text),
            lambda n: F.when(
                n > 0, F.aggregate(F.sequence(F.lit(1), n), text, lambda acc, _: _filled_pairs(acc))
            ).otherwise(text),
        )

    def deeper(text: Column) -> Column:
        return F.when(text.rlike(_ANY_BRACKET), let(all_levels(text), without_partner)).otherwise(text)

    def without_partner(text: Column) -> Column:
        return F.when(
            text.rlike(_ANY_BRACKET),
            F.rpad(F.regexp_extract(text, r"^[^\[({\])}]*+", 0), F.length(text), STRING_FILL),
        ).otherwise(text)

    return once_more(masked, lambda text: once_more(text, deeper))


def _top_level_commas(masked: Column) -> Column:
    """Positions of the commas outside all brackets and lambda parameter lists."""

    def without_parameters(text: Column) -> Column:
        return F.array_join(
            F.transform(
                F.regexp_extract_all(text, F.lit(_LAMBDAS), F.lit(0)),
                lambda t: F.when(t.rlike(r"^lambda\b"), F.replace(t, F.lit(","), F.lit(STRING_FILL))).otherwise(t),
            ),
            "",
        )

    def positions(text: Column) -> Column:
        plain = F.when(F.contains(text, F.lit("lambda")), without_parameters(text)).otherwise(text)
        return let(plain, lambda x: let(F.split(x, ",", -1), lambda pieces: places(x, pieces)))

    def places(text: Column, pieces: Column) -> Column:
        # A running sum keeps all it has found at every step, so it serves few pieces.
        start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<int>").alias("hits"))
        summed = F.aggregate(
            F.slice(pieces, F.lit(1), F.size(pieces) - 1),
            start,
            lambda acc, p: F.struct(
                (acc["pos"] + F.length(p) + 1).alias("pos"),
                F.array_append(acc["hits"], acc["pos"] + F.length(p) + 1).alias("hits"),
            ),
            lambda acc: acc["hits"],
        )
        # characters beyond the basic plane are two for a split
        single = F.regexp_replace(text, r"[^\x00-\x{FFFF}]", STRING_FILL)
        looked_up = F.array_compact(F.transform(F.split(single, ""), lambda c, i: F.when(c == ",", i + 1)))
        return F.when(F.size(pieces) <= _FEW, summed).otherwise(looked_up)

    none = F.array().cast("array<int>")
    return F.when(F.contains(masked, F.lit(",")), let(top_level(masked), positions)).otherwise(none)


#: Characters of a block of a long text: a piece is cut out of the blocks it lies in.
_BLOCK = 2048


def cut(text: Column, spans: Column) -> Column:
    """``ARRAY<STRING>``: the pieces of a text at ``ARRAY<STRUCT<pos, size>>``, 1-based.

    A position in a long text is found by counting characters from its start, so the text
    is cut into blocks first and each piece out of its blocks.
    """

    def pieces(blocks: Column) -> Column:
        def piece(x: Column) -> Column:
            first = F.floor((x["pos"] - 1) / _BLOCK).cast("int")
            last = F.floor((x["pos"] + x["size"] - 2) / _BLOCK).cast("int")
            own = F.slice(blocks, first + 1, F.greatest(last - first + 1, F.lit(0)))
            return F.substr(F.array_join(own, ""), x["pos"] - first * _BLOCK, x["size"])

        return F.transform(spans, piece)

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0))
    return F.when(
        F.length(text) <= _BLOCK, F.transform(spans, lambda x: F.substr(text, x["pos"], x["size"]))
    ).otherwise(let(blocks, pieces))


def closing_position(masked: Column) -> Column:
    """1-based position where the bracket opened by the first character closes."""
    start = F.struct(
        F.lit(0).alias("depth"), F.lit(0).alias("pos"), F.lit(None).cast("int").alias("end")
    )

    def step(acc: Column, token: Column) -> Column:
        change = _depth_change(F.right(token, F.lit(1)))
        pos = acc["pos"] + F.length(token)
        closes = acc["end"].isNull() & (change == -1) & (acc["depth"] == 1)
        return F.struct(
            (acc["depth"] + change).alias("depth"),
            pos.alias("pos"),
            F.when(closes, pos).otherwise(acc["end"]).alias("end"),
        )

    tokens = F.regexp_extract_all(masked, F.lit(_BRACKETS), F.lit(0))
    return F.aggregate(tokens, start, step, lambda acc: acc["end"])


def bracketed(code: Column, masked: Column, opening: str) -> Column:
    """``STRUCT<code, masked, pos>``: the inside of the first ``opening`` bracket.

    An unclosed bracket reaches to the end.  NULL where there is none.
    """
    at = F.locate(opening, masked)

    def cut(tail: Column) -> Column:
        size = F.coalesce(closing_position(tail) - 2, F.length(tail) - 1)
        return let(
            size,
            lambda n: F.struct(
                F.substr(code, at + 1, n).alias("code"),
                F.substr(tail, F.lit(2), n).alias("masked"),
                (at + 1).alias("pos"),
            ),
        )

    return F.when(at > 0, let(F.substr(masked, at), cut))


def split_args(code: Column, masked: Column) -> Column:
    """``ARRAY<STRUCT<code, masked, pos>>``: pieces between top-level commas.

    Pieces keep their surrounding blanks, so ``pos`` is where a piece starts in
    the given text; pieces of blanks only are dropped.
    """

    def spans(bounds: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.size(bounds) - 1),
            lambda i: F.struct(
                (F.element_at(bounds, i) + 1).alias("pos"),
                (F.element_at(bounds, i + 1) - F.element_at(bounds, i) - 1).alias("size"),
            ),
        )

    def pieces(spans: Column) -> Column:
        return F.zip_with(
            F.arrays_zip(cut(code, spans).alias("code"), cut(masked, spans).alias("masked")),
            spans,
            lambda x, span: F.struct(
                x["code"].alias("code"), x["masked"].alias("masked"), span["pos"].alias("pos")
            ),
        )

    bounds = F.concat(
        F.array(F.lit(0)), _top_level_commas(masked), F.array(F.length(masked) + 1)
    )
    return F.filter(let(let(bounds, spans), pieces), lambda p: p["masked"].rlike(r"\S"))


_BLANKS = " \t\n\x0b\f\r"
#: Further line ends, before which a pattern may end.
_LINE_ENDS = "\x85\u2028\u2029"


def strip(text: Column) -> Column:
    """Trim every kind of white space."""
    # Most texts have none at their ends; the pattern would try every character.
    ends = F.left(text, F.lit(1)).isin(*_BLANKS) | F.right(text, F.lit(1)).isin(*_BLANKS, *_LINE_ENDS)
    return F.when(ends, F.regexp_replace(text, r"^\s+|\s+$", "")).otherwise(text)


def trim_quotes(text: Column) -> Column:
    """Strip one pair of matching quotes around trimmed text."""
    return F.regexp_replace(F.trim(text), r"(?s)^(['\"])(.*)\1$", "$2")


def literal(value: Column) -> Column:
    """``STRUCT<kind, text>`` of a Python literal.

    kind: true, false, none, string, number, or raw for any other expression.
    """
    triple = r"(?s)^('''|\"\"\")(.*)\1$"
    quoted = r"(?s)^(['\"])(.*)\1$"
    # Both ends of one literal: no unescaped quote of the same kind between them.
    single = r"""(?s)^(?:'(?:[^'\\]++|\\.)*+'|"(?:[^"\\]++|\\.)*+")$"""

    def made(kind: str, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), text.cast("string").alias("text"))

    def of(v: Column) -> Column:
        return (
            F.when(v == "True", made("true", F.lit("True")))
            .when(v == "False", made("false", F.lit("False")))
            .when(v == "None", made("none", F.lit(None)))
            .when(~F.left(v, F.lit(1)).isin(*"'\"-0123456789"), made("raw", v))
            .when(v.rlike(triple), made("string", F.regexp_extract(v, triple, 2)))
            .when(v.rlike(single), made("string", F.regexp_extract(v, quoted, 2)))
            .when(v.rlike(r"^-?\d+(?:\.\d+)?$"), made("number", v))
            .otherwise(made("raw", v))
        )

    return let(strip(value), of)


_KEYWORD = r"^\s*\w+\s*=(?!=)"


def keyword_args(pieces: Column) -> Column:
    """``MAP<STRING, STRUCT<kind, text>>`` of the ``key=value`` pieces, last one wins."""
    named = F.transform(
        F.filter(pieces, lambda p: p["masked"].rlike(_KEYWORD)),
        lambda p: F.struct(
            F.regexp_extract(p["code"], r"^\s*(\w+)", 1).alias("key"),
            literal(F.regexp_replace(p["code"], _KEYWORD, "")).alias("value"),
        ),
    )
    return last_wins_map(named)


def positional_args(pieces: Column) -> Column:
    """``ARRAY<STRUCT<kind, text>>`` of the other pieces."""
    return F.transform(
        F.filter(pieces, lambda p: ~p["masked"].rlike(_KEYWORD)), lambda p: literal(p["code"])
    )


def last_wins_map(entries: Column) -> Column:
    """Map of ``STRUCT<key, value>`` entries; a repeated key keeps its last value."""


    def build(found: Column) -> Column:
        ordered = F.array_sort(
            F.transform(found, lambda e, i: F.struct(e["key"].alias("key"), i.alias("at")))
        )

        def last(order: Column) -> Column:
            kept = F.filter(order, lambda o, i: ~F.get(order, i + 1)["key"].eqNullSafe(o["key"]))
            return F.map_from_entries(
                F.transform(kept, lambda o: F.struct(o["key"], F.get(found, o["at"])["value"]))
            )

        return let(ordered, last)

    return let(entries, build)


_ENTRY_KEY = r"^\s*(?:'([^'\\]*)'|\"([^\"\\]*)\")\s*:"


def dict_entries(code: Column, masked: Column) -> Column:
    """``ARRAY<STRUCT<key, code, masked, pos>>`` of the entries inside a dict literal.

    ``code``/``masked`` are the value part.  Entries without a quoted key are dropped.
    """

    def entry(p: Column) -> Column:
        head = F.length(F.regexp_extract(p["masked"], r"^\s*(?:'[^']*'|\"[^\"]*\")\s*:", 0))
        lead = F.length(F.regexp_extract(p["masked"], r"^\s*", 0))
        return F.struct(
            F.concat(
                F.regexp_extract(p["code"], _ENTRY_KEY, 1), F.regexp_extract(p["code"], _ENTRY_KEY, 2)
            ).alias("key"),
            F.substr(p["code"], head + 1).alias("code"),
            F.substr(p["masked"], head + 1).alias("masked"),
            (p["pos"] + lead).alias("pos"),
        )

    return F.transform(
        F.filter(split_args(code, masked), lambda p: p["code"].rlike(_ENTRY_KEY)), entry
    )


def dict_literal(code: Column, masked: Column) -> Column:
    """``MAP<STRING, STRING>`` of the first dict in a text; values as literal text."""
    return let(
        bracketed(code, masked, "{"),
        lambda inside: last_wins_map(
            F.transform(
                dict_entries(inside["code"], inside["masked"]),
                lambda e: F.struct(e["key"].alias("key"), literal(e["code"])["text"].alias("value")),
            )
        ),
    )


def string_list(text: Column) -> Column:
    """Quoted strings of a list, a tuple or a bare string."""
    return F.regexp_extract_all(text, F.lit(r"""['"]([^'"]*)['"]"""), F.lit(1))


def py_bool(text: Column, default: bool | None = False) -> Column:
    """true/1, false/0/empty/none, anything else or NULL is the default."""
    t = F.lower(F.trim(text))
    return (
        F.when(t.isin("true", "1"), F.lit(True))
        .when(t.isin("false", "0", "", "none"), F.lit(False))
        .otherwise(F.lit(default))
    )
