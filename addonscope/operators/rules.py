"""The rule catalogue and its detectors.

A rule is a predicate Column over one entity.  All rules of an entity are
tested in a single pass over its rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from addonscope.functions import pytext
from addonscope.operators.modules import MODULE_KEY
from addonscope.rule_texts import CATALOGUE, DEFAULT_RULES, FINDINGS, LEVELS

ISSUES = [
    "id", "rule_id", "severity", "category", "title", "description", "repo", "file", "line",
    "end_line", "code", "suggestion", "fixed_code", "entity",
]


@dataclass(frozen=True)
class Rule:
    """One detector.

    ``entity`` names the kind of row (module, model, unprotected_model,
    unruled_model, attribute, field, method, decorator); the callables build
    Columns over such a row.  ``names`` fills the braces of the wording.
    """

    rule_id: str
    entity: str
    when: Callable[[], Column]
    line: Callable[[], Column]
    code: Callable[[], Column]
    subject: Callable[[], Column]
    file: Callable[[], Column] = lambda: F.col("path")
    names: dict[str, Callable[[], Column]] = field(default_factory=dict)
    end: Callable[[], Column] | None = None
    severity: str = ""
    category: str = ""
    wording: tuple[str, str, str] | None = None
    #: rule whose places in a body the rows are; all of them where empty
    hit: str = ""

    @property
    def levels(self) -> tuple[str, str]:
        return (self.severity, self.category) if self.severity else LEVELS[self.rule_id]

    @property
    def texts(self) -> tuple[str, str, str]:
        return self.wording or FINDINGS.get(self.rule_id) or CATALOGUE[self.rule_id]


def _filled(template: str, names: dict[str, Callable[[], Column]]) -> Column:
    parts = [p for p in re.split(r"(\{\w+\})", template) if p]
    return F.concat(*[
        F.coalesce(names[p[1:-1]](), F.lit("")) if p[:1] == "{" and p[1:-1] in names else F.lit(p)
        for p in parts
    ])


def _col(name: str) -> Callable[[], Column]:
    return lambda: F.col(name)


def _cat(*parts: str | Callable[[], Column]) -> Callable[[], Column]:
    return lambda: F.concat(*[F.lit(p) if isinstance(p, str) else p() for p in parts])


# ---------------------------------------------------------------- field rows


def _param(key: str) -> Column:
    return F.try_element_at("params", F.lit(key))


def _truthy(key: str) -> Column:
    return ~F.coalesce(_param(key), F.lit("")).isin("", "False", "0")


# ---------------------------------------------------------------- method rows

_SQL_TEXT = (
    r"""(?is)['"]\s*(?:select|insert|update|delete|create|alter|drop|truncate|with)\b"""
)


def _is_formatted(code: Column, masked: Column) -> Column:
    plain = masked.rlike(r"%|\.format\s*\(")
    f_string = masked.rlike(r"""\b[rR]?[fF][rR]?['"]""") & F.contains(code, F.lit("{"))
    return plain | f_string


def _executed(call: Column) -> Column:
    """First argument of the ``cr.execute`` call of a statement."""
    at = F.locate("cr.execute", call["masked"])
    return pytext.let(
        pytext.bracketed(F.substr(call["code"], at), F.substr(call["masked"], at), "("),
        lambda args: F.try_element_at(
            pytext.split_args(args["code"], args["masked"]), F.lit(1)
        ),
    )


def _injected_sql() -> Column:
    """Statements that execute SQL put together by string formatting.

    The formatting is in the call itself, or the call executes a variable that
    an earlier statement of the body assigned such a text to.  Statements are
    put together once, and of the assignments only the first one to each name
    matters, so the work grows with the lines of the method.
    """
    assign = r"^\s*(\w+)\s*\+?=(?!=)"

    def find(statements: Column) -> Column:
        built = F.transform(
            F.filter(
                statements,
                lambda s: s["masked"].rlike(assign)
                & s["code"].rlike(_SQL_TEXT)
                & _is_formatted(s["code"], F.regexp_replace(s["masked"], assign, "")),
            ),
            lambda s: F.struct(
                F.regexp_extract(s["masked"], assign, 1).alias("key"), (-s["line"]).alias("value")
            ),
        )
        calls = F.transform(
            F.filter(statements, lambda s: s["masked"].rlike(r"\bcr\.execute\s*\(")),
            lambda c: F.struct(c["line"].alias("line"), _executed(c).alias("arg")),
        )

        def among(names: Column) -> Column:
            def bad(c: Column) -> Column:
                arg = c["arg"]["masked"]
                since = F.try_element_at(names, F.regexp_extract(arg, r"^\s*(\w+)\s*$", 1))
                return (
                    F.when(_is_formatted(c["arg"]["code"], arg), True)
                    .when(arg.rlike(r"^\s*\w+\s*$"), F.coalesce(-since < c["line"], F.lit(False)))
                    .otherwise(False)
                )

            return F.transform(F.filter(calls, bad), lambda c: c["line"])

        # The map keeps the last value in order of lines turned round: the first line.
        return pytext.let(pytext.last_wins_map(F.reverse(built)), among)

    return F.when(
        F.exists("lines", lambda x: F.contains(x["masked"], F.lit("cr.execute"))),
        pytext.let(pytext.statements(F.col("lines")), find),
    )


def _in_loop(pattern: str) -> Column:
    """Lines inside ``for`` blocks that match, found in one pass.

    Only the outermost open loop matters, so besides the hits the state is two numbers.
    """
    nothing = F.lit(-1)
    start = F.struct(
        nothing.alias("loop"), nothing.alias("head"), F.array().cast("array<int>").alias("hits")
    )

    def step(acc: Column, x: Column) -> Column:
        is_for = x["starts"] & x["masked"].rlike(r"^\s*(?:async\s+)?for\b")
        outside = x["starts"] & ((acc["loop"] < 0) | (x["indent"] <= acc["loop"]))
        loop = F.when(outside, F.when(is_for, x["indent"]).otherwise(-1)).otherwise(acc["loop"])
        head = F.when(outside & is_for, x["line_no"]).otherwise(acc["head"])
        hit = (loop >= 0) & (x["stmt"] != head) & x["masked"].rlike(pattern)
        return F.struct(
            loop.alias("loop"),
            head.alias("head"),
            F.when(hit, F.array_append(acc["hits"], x["line_no"])).otherwise(acc["hits"]).alias("hits"),
        )

    return F.when(
        F.exists("lines", lambda x: x["masked"].rlike(pattern)),
        F.aggregate("lines", start, step, lambda acc: acc["hits"]),
    )


_SEARCH_WITHOUT_LIMIT = r"(?s)\.search\s*\((?!.*\blimit\s*=)"
_HANDLER = r"\bexcept\s*(?:Exception)?\s*:"
_SILENT = r"\s*(?:pass|return)\b"


def _lines_with(pattern: str) -> Column:
    return F.transform(F.filter("lines", lambda x: x["masked"].rlike(pattern)), lambda x: x["line_no"])


def _unlimited_search() -> Column:
    found = F.filter(
        pytext.statements(F.col("lines")), lambda s: s["masked"].rlike(_SEARCH_WITHOUT_LIMIT)
    )
    return F.when(
        F.exists("lines", lambda x: F.contains(x["masked"], F.lit(".search"))),
        F.transform(found, lambda s: s["line"]),
    )


def _silent_except() -> Column:
    """Handlers whose first statement is ``pass`` or ``return``, on their line or the next one with code."""
    bare = F.filter(
        F.transform("lines", lambda x: F.struct(
            x["line_no"].alias("line_no"), pytext.blank_comments(x["masked"]).alias("masked")
        )),
        lambda x: x["masked"].rlike(r"\S"),
    )

    def among(lines: Column) -> Column:
        def silent(x: Column, i: Column) -> Column:
            following = F.coalesce(F.get(lines, i + 1)["masked"], F.lit(""))
            return x["masked"].rlike(_HANDLER + _SILENT) | (
                x["masked"].rlike(_HANDLER + r"\s*$") & following.rlike("^" + _SILENT)
            )

        return F.transform(F.filter(lines, silent), lambda x: x["line_no"])

    return F.when(
        F.exists("lines", lambda x: x["masked"].rlike(r"\bexcept\b"))
        & ~F.exists("lines", lambda x: x["masked"].rlike(r"_logger\.(?:exception|error)")),
        pytext.let(bare, among),
    )


def _method_hits(methods: DataFrame, wanted: Iterable[str] = ()) -> DataFrame:
    """One row per rule about a place in a body and place that it applies to.

    Only of the ``wanted`` rules; of all where none is named.
    """
    wanted = set(wanted)
    lines_with = {
        "BAD001": r"\bbrowse\s*\(\s*\[?\s*\d+\s*\]?\s*\)",
        "BAD005": r"\bcr\.commit\(\)",
        "SEC002": r"\.sudo\(\)",
    }
    places = {rule_id: _lines_with(pattern) for rule_id, pattern in lines_with.items()}
    places["SEC001"] = _injected_sql()
    places["BAD002"] = _silent_except()
    # one finding for the method, at its header
    places["PERF001"] = F.when(
        F.size(F.coalesce(_in_loop(r"\.search\s*\("), F.array().cast("array<int>"))) > 0, F.array("line")
    )
    places["PERF003"] = _unlimited_search()
    places["PERF004"] = _in_loop(r"\.(?:read|write)\s*\(")

    def hits(rule_id: str, lines: Column) -> Column:
        return F.transform(
            F.coalesce(F.array_distinct(lines), F.array().cast("array<int>")),
            lambda line: F.struct(
                F.lit(rule_id).alias("hit"), line.cast("int").alias("hit_line"), _body_text(line).alias("hit_text")
            ),
        )

    found = F.concat(*[hits(rule_id, lines) for rule_id, lines in places.items() if not wanted or rule_id in wanted])
    return methods.select("repo", "path", "model", "name", F.inline(found))


def _body_text(line: Column) -> Column:
    return F.trim(
        F.coalesce(
            F.try_element_at(F.filter("lines", lambda x: x["line_no"] == line), F.lit(1))["text"],
            F.lit(""),
        )
    )


def _body_rule(rule_id: str, code: Callable[[], Column] | None = None) -> Rule:
    return Rule(
        rule_id,
        "body",
        when=lambda: F.col("hit") == rule_id,
        line=_col("hit_line"),
        code=code or _col("hit_text"),
        subject=_col("name"),
        names={"method": _col("name")},
        hit=rule_id,
    )


def _field_rule(rule_id: str, when: Callable[[], Column], type_column: str = "type") -> Rule:
    def capital() -> Column:
        raw = F.col("raw_type")
        return F.concat(F.upper(F.left(raw, F.lit(1))), F.substr(raw, F.lit(2)))

    return Rule(
        rule_id,
        "field",
        when=when,
        line=_col("line"),
        code=_cat(_col("name"), " = fields.", _col(type_column)),
        subject=_col("name"),
        names={"field": _col("name"), "type": _col("raw_type"), "capital": capital},
        end=_col("end_line"),
    )


def _decorator_rule(rule_id: str, part: str, unless: tuple[str, ...] = ()) -> Rule:
    def when() -> Column:
        found = F.contains("decorator", F.lit(part))
        for other in unless:
            found = found & ~F.contains("decorator", F.lit(other))
        return found

    return Rule(
        rule_id, "decorator", when=when, line=_col("decorator_line"), code=_col("decorator"),
        subject=_col("name"), names={"method": _col("name")},
    )


def _model_rule(rule_id: str, entity: str, when: Callable[[], Column], **kwargs) -> Rule:
    return Rule(
        rule_id,
        entity,
        when=when,
        line=kwargs.pop("line", _col("line")),
        code=kwargs.pop("code", _cat("class ", _col("class_name"))),
        subject=_col("model"),
        names={"model": _col("model"), "class": _col("class_name")},
        **kwargs,
    )


def _in_module(name: str) -> Callable[[], Column]:
    """A file of the module; a module may be the repository itself."""
    return lambda: F.concat_ws("/", F.nullif("module_path", F.lit("")), F.lit(name))


_RULES = [
    _decorator_rule("DEP001", "api.multi"),
    _decorator_rule("DEP002", "api.one", ("api.multi",)),
    _decorator_rule("DEP003", "api.returns", ("api.multi", "api.one")),
    _model_rule("DEP004", "model", _col("legacy_base")),
    Rule("DEP005", "attribute", lambda: F.col("target") == "_columns", _col("line"),
         lambda: F.trim(F.substring_index("code", "\n", 1)), _col("model"), end=_col("end_line")),
    Rule("DEP006", "attribute", lambda: F.col("target") == "_defaults", _col("line"),
         lambda: F.trim(F.substring_index("code", "\n", 1)), _col("model"), end=_col("end_line")),
    _field_rule("DEP007", lambda: F.col("raw_type").rlike("^[a-z]"), "raw_type"),
    _body_rule("SEC001"),
    _body_rule("SEC002", lambda: F.lit("self.sudo()")),
    _model_rule("SEC003", "unprotected_model", lambda: F.lit(True), line=lambda: F.lit(1),
                code=_cat("model: ", _col("model")), file=_in_module("security/ir.model.access.csv")),
    _model_rule("SEC004", "unruled_model", lambda: F.lit(True)),
    _body_rule("PERF001", _cat("for ... loop in ", _col("name"))),
    _field_rule("PERF002", lambda: _truthy("compute")
                & ~(F.coalesce(_param("store"), F.lit("")) == "True")),
    _body_rule("PERF003"),
    _body_rule("PERF004"),
    _body_rule("BAD001"),
    _body_rule("BAD002", lambda: F.lit("except:")),
    Rule("BAD003", "method",
         lambda: F.col("name").isin("create", "write", "unlink") & ~F.col("has_super"),
         _col("line"), _cat("def ", _col("name")), _col("name"), names={"method": _col("name")}),
    Rule("BAD004", "method",
         lambda: ~F.coalesce(F.try_element_at("lines", F.lit(1))["text"], F.lit("")).rlike(
             r"""^\s*(?:\"\"\"|''')"""),
         _col("line"), _cat("def ", _col("name")), _col("name"), names={"method": _col("name")}),
    _body_rule("BAD005", lambda: F.lit("self.env.cr.commit()")),
    Rule("MIS001", "module", lambda: ~F.col("has_manifest"), lambda: F.lit(1), lambda: F.lit(""),
         _col("module_name"),
         file=_in_module("__manifest__.py")),
    _model_rule("MIS002", "model",
                lambda: F.col("explicit_name") & (F.trim(F.col("description")) == "")
                & ~F.array_contains("inherit", F.col("model"))),
    Rule("MIS003", "module",
         lambda: F.col("has_manifest") & (F.trim(F.coalesce("license", F.lit(""))) == ""),
         lambda: F.lit(1), lambda: F.trim(F.col("manifest_head")), _col("module_name"),
         file=_col("manifest_path"), end=_col("dict_line")),
    _model_rule("INH001", "model", lambda: F.col("explicit_name") & (F.size("inherit") > 0)
                & ~F.array_contains("inherit", F.col("model"))),
    _field_rule("DAT001", lambda: (F.lower("type") == "many2one") & ~_truthy("ondelete")),
    _field_rule("DAT002", lambda: (F.lower("type") == "selection")
                & F.coalesce(_param("default"), F.lit("")).isin("", "False")),
    _field_rule("DAT003", lambda: (F.coalesce(_param("required"), F.lit("")) == "True")
                & _param("default").isNull()),
]
RULES: dict[str, Rule] = {rule.rule_id: rule for rule in _RULES}


def register_rule(
    rule_id: str,
    entity: str,
    predicate: Column,
    severity: str,
    category: str,
    title: str,
    description: str,
    suggestion: str,
    line: Column | None = None,
    code: Column | None = None,
    rules: dict[str, Rule] | None = None,
) -> Rule:
    """Adds a rule: any predicate Column over the rows of an entity."""
    rule = Rule(
        rule_id,
        entity,
        when=lambda: predicate,
        line=lambda: line if line is not None else F.col("line"),
        code=lambda: code if code is not None else F.lit(""),
        subject=lambda: F.col("model"),
        severity=severity,
        category=category,
        wording=(title, description, suggestion),
    )
    (RULES if rules is None else rules)[rule_id] = rule
    return rule


def issue_rows(entity: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """Tests all the rules on each row of an entity in one pass."""

    def finding(rule: Rule) -> Column:
        severity, category = rule.levels
        title, description, suggestion = rule.texts
        return F.when(
            rule.when(),
            F.struct(
                F.lit(rule.rule_id).alias("rule_id"),
                F.lit(severity).alias("severity"),
                F.lit(category).alias("category"),
                _filled(title, rule.names).alias("title"),
                _filled(description, rule.names).alias("description"),
                rule.file().alias("file"),
                rule.line().cast("int").alias("line"),
                (rule.end or rule.line)().cast("int").alias("end_line"),
                F.trim(rule.code()).alias("code"),
                _filled(suggestion, rule.names).alias("suggestion"),
                F.lit("").alias("fixed_code"),
                rule.subject().alias("entity"),
            ),
        )

    found = F.array_compact(F.array(*[finding(r) for r in rules]))
    # names that differ only in replaced characters differ in the digest
    digest = F.left(F.md5(F.concat_ws("|", "repo", "file", "entity").cast("binary")), F.lit(8))
    plain = lambda text: F.regexp_replace(text, "[^a-zA-Z0-9]", "_")
    return entity.select("repo", F.inline(found)).select(
        F.concat_ws(
            "_", "rule_id", plain(F.col("repo")), plain(F.col("file")), "line", plain(F.col("entity")), digest
        ).alias("id"),
        *ISSUES[1:],
    )


def access_key(model: Column) -> Column:
    """The access-table identifier of a dotted model name."""
    return F.concat(F.lit("model_"), F.replace(model, F.lit("."), F.lit("_")))


def _keys(rows: DataFrame) -> DataFrame:
    """Models named by access rows or record rules, per module."""
    return rows.select(
        *MODULE_KEY, F.regexp_replace("model_id", r"^.*\.", "").alias("key")
    ).distinct()


def models_without(models: DataFrame, rows: DataFrame) -> DataFrame:
    """Models with a name of their own that no row of their module refers to.

    A class that also inherits from its own name extends a model and declares none.
    """
    own = models.where("explicit_name AND NOT array_contains(inherit, model)").withColumn(
        "key", access_key(F.col("model"))
    )
    return own.join(_keys(rows), [*MODULE_KEY, "key"], "left_anti")


def rule_entities(
    entities: Mapping[str, DataFrame], wanted: Iterable[str] = ()
) -> dict[str, Callable[[], DataFrame]]:
    """Rows each kind of rule looks at; the joins are built only on demand.

    Places in bodies are looked for as ``_method_hits`` does.
    """
    return {
        "module": lambda: entities["modules"],
        "model": lambda: entities["models"],
        # The access file is the module's, so a model declared twice in it counts once.
        "unprotected_model": lambda: models_without(
            entities["models"], entities["access_rights"]
        ).groupBy(*MODULE_KEY, "model").agg(F.min("class_name").alias("class_name")),
        "unruled_model": lambda: models_without(entities["models"], entities["record_rules"]),
        "attribute": lambda: entities["items"].where(
            F.col("target").isin("_columns", "_defaults")
        ),
        "field": lambda: entities["fields"],
        "method": lambda: entities["methods"],
        "body": lambda: _method_hits(entities["methods"], wanted),
        "decorator": lambda: entities["methods"].select(
            "repo", "path", "model", "name", F.explode("decorator_lines").alias("d")
        ).select("*", F.col("d.line").alias("decorator_line"), F.col("d.text").alias("decorator")),
    }


def detect(
    entities: Mapping[str, DataFrame],
    rules: Iterable[str] = tuple(DEFAULT_RULES),
    catalogue: dict[str, Rule] | None = None,
) -> DataFrame:
    """Findings of the named rules over the entity tables."""
    known = RULES if catalogue is None else catalogue
    wanted = [known[r] for r in rules]
    in_bodies = {r.hit for r in wanted if r.entity == "body"}
    rows = rule_entities(entities, () if "" in in_bodies else in_bodies)
    parts = [
        issue_rows(build(), [r for r in wanted if r.entity == kind])
        for kind, build in rows.items()
        if any(r.entity == kind for r in wanted)
    ]
    return reduce(DataFrame.unionByName, parts)


def rule_catalogue(spark: SparkSession) -> DataFrame:
    """The catalogue as a small dimension, one row per rule and language."""
    rows = []
    for rule_id, english in CATALOGUE.items():
        severity, category = LEVELS[rule_id]
        rows.append((rule_id, "en", severity, category, *english))
        rows.append((rule_id, "id", severity, category, *FINDINGS.get(rule_id, english)))
    return spark.createDataFrame(
        rows,
        "rule_id STRING, lang STRING, severity STRING, category STRING, title STRING, "
        "description STRING, suggestion STRING",
    )


def localize_issues(issues: DataFrame, lang: str) -> DataFrame:
    """Issues with the wording of the language; ``id`` is the wording they carry.

    An issue without a rule id is looked up by the prefix of its id.  The
    catalogue has a fixed 27 rows per language, so it is broadcast.
    """
    if lang != "en":
        return issues
    texts = (
        rule_catalogue(issues.sparkSession)
        .where(F.col("lang") == lang)
        .select(
            F.col("rule_id").alias("key"),
            *[F.col(c).alias("t_" + c) for c in ("title", "description", "suggestion")],
        )
    )
    key = F.coalesce(F.nullif("rule_id", F.lit("")), F.substring_index("id", "_", 1))
    return issues.join(F.broadcast(texts), key == F.col("key"), "left").select(*[
        F.coalesce("t_" + c, c).alias(c) if c in ("title", "description", "suggestion") else c
        for c in issues.columns
    ])
