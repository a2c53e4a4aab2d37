"""Secret scan with a trigram index, in DataFrame expressions only.

From each rule's pattern a Boolean query over trigrams is derived: trigrams that every
match must contain. An inverted index holds, for each trigram some rule asks for, the
documents that contain it. Postings are intersected per alternative of a query; only the
documents that are left are searched with the pattern. Rules without mandatory trigrams
search all documents.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from addonscope.llm.common import row_key
from addonscope.session import materialize


@dataclass(frozen=True)
class Rule:
    """A kind of secret: leftmost non-overlapping matches of ``pattern``.

    With ``least`` and ``group``, matches whose group is shorter are found and dropped.
    The patterns mean the same to Java, Python and RE2, and hold no quotation mark.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


def _either_case(words: list[str]) -> str:
    def letter(c: str) -> str:
        return f"[{c.upper()}{c}]" if c.isalpha() else c

    return "|".join("".join(letter(c) if c != "?" else c for c in w) for w in words)


_NAMES = _either_case(["password", "passwd", "secret", "token", "api_?key"])
_VALUE = r"[A-Za-z0-9+/_.=-]"

#: The rules every scan has. A run that is long enough is the same whether shorter ones are
#: matched and dropped or not matched at all, so the bounds of two rules are in the pattern.
BASE = (
    Rule("assign", rf"({_NAMES})[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?({_VALUE}+)", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
#: Formats of well-known issuers.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----"),
    Rule("credential_url", r"[a-z][a-z0-9+.-]{1,20}://[A-Za-z0-9._-]{1,64}:[A-Za-z0-9._~+-]{6,64}@"),
)
RULES = BASE + MORE

# --- from a pattern to trigrams -----------------------------------------------------

#: Strings that a part of a pattern is spelled out to, at most.
_SPELLED = 96
_CLASS = 4

Clauses = frozenset[frozenset[str]]
_ALWAYS: Clauses = frozenset([frozenset()])


def _both(x: Clauses, y: Clauses) -> Clauses:
    return _shortest(frozenset(a | b for a in x for b in y))


def _shortest(clauses: Clauses) -> Clauses:
    """Without the clauses that ask for more than another one."""
    return frozenset(a for a in clauses if not any(b < a for b in clauses))


def _of_strings(strings: frozenset[str]) -> Clauses:
    grams = frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)
    return _shortest(grams)


def _walk(parts, run: frozenset[str], clauses: Clauses) -> tuple[frozenset[str], Clauses, bool]:
    """Goes on from the strings ``run`` that end here; closes them where a part is too varied.

    Also tells whether nothing was closed, so that the strings are all there is.
    """
    exact = True
    for op, arg in parts:
        name = str(op)
        spelled = None
        if name == "LITERAL":
            spelled = frozenset([chr(arg).lower()])
        elif name == "IN":
            spelled = _letters(arg)
        elif name == "SUBPATTERN":
            run, clauses, whole = _walk(arg[3], run, clauses)
            exact &= whole
            continue
        elif name == "BRANCH":
            ways = [_walk(way, frozenset([""]), _ALWAYS) for way in arg[1]]
            if all(whole for *_, whole in ways):
                spelled = frozenset().union(*[r for r, *_ in ways])
            else:
                each = frozenset().union(*[_both(c, _of_strings(r)) for r, c, _ in ways])
                clauses = _both(_both(clauses, _of_strings(run)), _shortest(each))
                run, exact = frozenset([""]), False
                continue
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, inner = arg
            once, _, whole = _walk(inner, frozenset([""]), _ALWAYS)
            if whole and high <= 3 and len(once) ** int(high) <= _SPELLED:
                spelled = frozenset(
                    s for k in range(int(low), int(high) + 1) for s in reduce(_times, [once] * k, frozenset([""]))
                )
            else:
                for _ in range(min(int(low), 3)):
                    run, clauses, _ = _walk(inner, run, clauses)
        elif name == "AT":
            continue
        if spelled is not None and len(run) * len(spelled) <= _SPELLED:
            run = _times(run, spelled)
        else:
            clauses = _both(clauses, _of_strings(run))
            run, exact = spelled if spelled is not None else frozenset([""]), False
    return run, clauses, exact


def _times(x: frozenset[str], y: frozenset[str]) -> frozenset[str]:
    return frozenset(a + b for a in x for b in y)


def _letters(members) -> frozenset[str] | None:
    """The letters of a small class, in lower case."""
    out: set[str] = set()
    for op, arg in members:
        name = str(op)
        if name == "LITERAL":
            out.add(chr(arg).lower())
        elif name == "RANGE" and arg[1] - arg[0] < 2 * _CLASS:
            out |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return frozenset(out) if len(out) <= _CLASS else None


def trigram_query(pattern: str) -> Clauses:
    """Alternatives, each a set of lower-case trigrams: every match holds all of one of them.

    A set without members means that the pattern has no mandatory trigram.
    """
    run, clauses, _ = _walk(re._parser.parse(pattern), frozenset([""]), _ALWAYS)
    return _both(clauses, _of_strings(run))


# --- index and search ----------------------------------------------------------------


def _queries(rules: tuple[Rule, ...]) -> list[tuple[int, int, frozenset[str]]]:
    """(rule, clause, trigrams) of the rules that have mandatory trigrams."""
    out = []
    for i, rule in enumerate(rules):
        clauses = trigram_query(rule.pattern)
        if all(clauses):
            out += [(i, k, c) for k, c in enumerate(sorted(clauses, key=sorted))]
    return out


def index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, row): the rows of ``docs`` (row, text) whose text holds each trigram.

    The index covers the trigrams that rules ask for; case is ignored.
    """
    low = F.lower("text")
    held = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in trigrams]))
    return docs.select("row", F.explode(held).alias("trigram"))


def candidates(postings: DataFrame, queries: list[tuple[int, int, frozenset[str]]]) -> DataFrame:
    """(row, rules): the rules of which a row holds all trigrams of some clause.

    The clauses are a table of a few hundred rows, given by the rules alone.
    """
    asked = [(t, i, k, len(c)) for i, k, c in queries for t in sorted(c)]
    clauses = postings.sparkSession.createDataFrame(asked, "trigram string, rule int, clause int, n int")
    met = postings.join(F.broadcast(clauses), "trigram").groupBy("row", "rule", "clause", "n").agg(
        F.count_distinct("trigram").alias("held")
    )
    return met.where("held = n").groupBy("row").agg(F.collect_set("rule").alias("rules"))


def _let(value: str, name: str, body: str) -> str:
    """SQL that names ``value`` in ``body``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def running(sizes: str) -> str:
    """SQL for the sums of the elements before each one, over blocks of about the square root of the size."""

    def sums(values: str) -> str:
        return f"aggregate({values}, array(0L), (acc, x) -> array_append(acc, element_at(acc, -1) + x))"

    within = f"transform(sequence(0, cast((size(a) - 1) div b as int)), i -> {sums('slice(a, i * b + 1, b)')})"
    bases = sums("transform(w, v -> element_at(v, -1))")
    moved = "zip_with(w, slice(o, 1, size(w)), (v, base) -> transform(slice(v, 1, size(v) - 1), y -> y + base))"
    block = _let("cast(ceil(sqrt(size(a))) as int)", "b", _let(within, "w", _let(bases, "o", f"flatten({moved})")))
    return _let(sizes, "a", f"if(size(a) = 0, cast(array() as array<bigint>), {block})")


def _spans(number: int, rule: Rule) -> str:
    """SQL for the array of (start, number of the rule, end) in code points of ``text``.

    What lies between the matches gives their places.
    """
    pattern = f"r'{rule.pattern}'"
    parts = (
        f"named_struct('sizes', transform(regexp_extract_all(text, {pattern}, 0), m -> cast(length(m) as bigint)),"
        f" 'gaps', transform(split(text, {pattern}, -1), g -> cast(length(g) as bigint)),"
        f" 'kept', transform(regexp_extract_all(text, {pattern}, {rule.group}), m -> length(m) >= {rule.least}))"
    )
    before = running("zip_with(slice(z.gaps, 1, size(z.sizes)), z.sizes, (g, s) -> g + s)")
    place = "p + z.gaps[i]"
    spans = (
        f"transform({before}, (p, i) -> named_struct("
        f"'start', {place}, 'kind', {number}, 'end', {place} + z.sizes[i], 'kept', z.kept[i]))"
    )
    kept = f"transform(filter({spans}, m -> m.kept), m -> named_struct('start', m.start, 'kind', m.kind, 'end', m.end))"
    return _let(parts, "z", kept)


def joined(spans: Column, rules: tuple[Rule, ...]) -> Column:
    """kind:start:end of sorted spans, joined by commas."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans) of every row of ``docs`` (doc_id, text): sorted (start, kind, end).

    ``kind`` is the position in ``rules``; starts and ends are code points, ends exclusive.
    Null and empty texts have no spans. Rows with equal id and text are searched alike and
    all returned. Texts meet the index again by a row key, so equal texts do not crowd one
    task.
    """
    rows = docs.select("doc_id", row_key().alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    queries = _queries(rules)
    trigrams = sorted({t for _, _, c in queries for t in c})
    postings = materialize(index(rows, trigrams), "trigram_postings") if trigrams else None
    if postings is not None:
        rows = rows.join(candidates(postings, queries), "row", "left")
    else:
        rows = rows.withColumn("rules", F.lit(None).cast("array<int>"))
    indexed = {i for i, _, _ in queries}
    kind = "array<struct<start:bigint,kind:int,end:bigint>>"
    found = []
    for i, rule in enumerate(rules):
        some = f"array_contains(rules, {i})" if i in indexed else f"rlike(text, r'{rule.pattern}')"
        found.append(f"coalesce(if({some}, {_spans(i, rule)}, null), cast(array() as {kind}))")
    return rows.select("doc_id", F.expr(f"array_sort(concat({', '.join(found)}))").alias("spans"))
