import random
import re

from pyspark.sql import functions as F

from addonscope.functions import pytext
from addonscope.functions import text as T


def column(spark, texts, expr):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING")
    return [r.v for r in df.select("i", expr(F.col("t")).alias("v")).orderBy("i").collect()]


def test_mask_keeps_length_and_hides_text(spark):
    source = 'x = "a)#b"  # c (\ny = \'\'\'q\n(\'\'\' + r"\\"" \\\n  z\n'
    masked = column(spark, [source], pytext.mask_source)[0]
    lines = masked.split("\n")
    assert len(lines) == len(source.split("\n"))
    assert [x.startswith("\u0003") for x in lines] == [False, False, True, True, False]
    assert "(" not in masked and "#" not in masked and "q" not in masked
    assert len(masked.replace("\u0003", "")) == len(source)


def test_mask_unterminated_literals(spark):
    masked = column(spark, ["x = 'abc(\ny = 1", 'z = """open (\nstill ('], pytext.mask_source)
    assert masked[0].endswith("\ny = 1") and "(" not in masked[0]
    assert "(" not in masked[1]


def test_long_literals_do_not_exhaust_the_stack(spark):
    text = "x = '" + "\\'a" * 200_000 + "'\ny = \"\"\"" + 'a"b\\n' * 200_000 + '"""\n'
    masked = column(spark, [text], pytext.mask_source)[0]
    assert len(masked) == len(text)


def split_by_hand(text):
    """Pieces between top-level commas, by walking the characters."""
    pieces, depth, quote, params, start, i = [], 0, None, 0, 0, 0
    while i < len(text):
        ch = text[i]
        if quote:
            if ch == "\\":
                i += 1
            elif ch == quote:
                quote = None
        elif ch in "'\"":
            quote = ch
        elif ch in "([{":
            depth += 1
        elif ch in ")]}":
            depth -= 1
        elif depth == 0 and text.startswith("lambda ", i):
            params += 1
            i += 5
        elif depth == 0 and ch == ":" and params:
            params -= 1
        elif depth == 0 and params == 0 and ch == ",":
            pieces.append(text[start:i])
            start = i + 1
        i += 1
    pieces.append(text[start:])
    return [p for p in pieces if p.strip()]


def test_split_args_against_a_walk(spark):
    rng = random.Random(7)

    def piece(depth=0):
        inner = lambda: ", ".join(piece(depth + 1) for _ in range(rng.randrange(4)))
        kind = rng.randrange(7 if depth < 4 else 4)
        if kind < 4:
            return ["'a,(\\'b'", '"x]y"', "n = 12", "lambda a, b: a"][kind]
        return ["f(%s)", "[%s]", "{'k': (%s)}"][kind - 4] % inner()

    texts = [", ".join(piece() for _ in range(rng.randrange(6))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING")
    got = (
        df.withColumn("m", pytext.mask_source(F.col("t")))
        .select("i", F.transform(pytext.split_args(F.col("t"), F.col("m")), lambda p: p["code"]).alias("v"))
        .orderBy("i")
        .collect()
    )
    assert [r.v for r in got] == [split_by_hand(t) for t in texts]


def test_literals(spark):
    got = column(
        spark,
        ["True", " None ", "'x'", '"""y"""', "-1.5", "'a' + 'b'", "f(1)", "'it\\'s'"],
        pytext.literal,
    )
    assert [(r.kind, r.text) for r in got] == [
        ("true", "True"), ("none", None), ("string", "x"), ("string", "y"), ("number", "-1.5"),
        ("raw", "'a' + 'b'"), ("raw", "f(1)"), ("string", "it\\'s"),
    ]


def test_repeated_keyword_keeps_the_last(spark):
    def args(t):
        return pytext.keyword_args(pytext.split_args(t, pytext.mask_source(t)))

    got = column(spark, ["a=1, b='x', a=2, a == 3"], args)[0]
    assert {k: v.text for k, v in got.items()} == {"a": "2", "b": "x"}


def test_csv_fields(spark):
    got = column(spark, ['a,"b,c",,"d""e"', ",x", "", 'p"q,r"s,t', '"",1'], T.csv_fields)
    assert got == [["a", "b,c", "", 'd"e'], ["", "x"], [""], ["pq,rs", "t"], ["", "1"]]


def test_paths(spark):
    assert column(spark, ["a\\b\\c.PY", "x.xml", "d/e"], T.dir_name) == ["a/b", "", "d"]
    assert column(spark, ["a\\b\\c.PY", "noext", "d/.hidden"], T.extension) == ["py", "", "hidden"]
    assert column(spark, ["a/b", ""], T.ancestor_dirs) == [["", "a", "a/b"], [""]]


def test_three_levels_of_brackets_take_one_round(spark):
    texts = ["f(a, [b, {c}], ()), d", "((a)(b)) + (c", "a) (b, (c)", "((((x, y))))", "(((((a, b)))))", "[(]), (a"]
    once = column(spark, texts, pytext._filled_pairs)
    assert once[0] == "f" + "\u0001" * 17 + ", d"
    assert once[1] == "\u0001" * 8 + " + (c" and once[3] == "(" + "\u0001" * 10 + ")"
    assert [len(x) for x in once] == [len(t) for t in texts]
    # pairs filled one level after the other lead to the same text
    slow = []
    for t in texts:
        while (filled := re.sub(r"[\[({][^\[({\])}]*[\])}]", lambda m: "\u0001" * len(m[0]), t)) != t:
            t = filled
        slow.append(re.sub(r"[\[({\])}].*", lambda m: "\u0001" * len(m[0]), t))
    assert column(spark, texts, pytext.top_level) == slow


def test_characters_are_looked_for_without_a_table(spark):
    """A translation looks every character up; these texts hold few of those that go."""
    for form in (pytext.bracket_delta, pytext.blank_comments, lambda t: pytext.line_offset(t, F.lit(3))):
        assert "translate" not in str(form(F.col("t")))
    assert column(spark, ["([{x}])", ")(((", "", "a]b"], pytext.bracket_delta) == [0, 2, 0, -1]
    assert column(spark, ["a\u0002\u0002b", None], pytext.blank_comments) == ["a  b", None]
    assert column(spark, ["a\tcb", "éab"], lambda t: pytext.without(t, "ab\t")) == ["c", "é"]


def test_strip_and_literals_of_odd_texts(spark):
    texts = ["", " ", "x", "\x0b a\f\r", "a  ", "  a", "a\x85", " a ", None]
    texts += ["- 1", "-1.5", "'", "'a' 'b'", "'''q'''", "\t'a'\n", "None", "07", "x'1'"]
    before = lambda t: F.regexp_replace(t, r"^\s+|\s+$", "")
    assert column(spark, texts, pytext.strip) == column(spark, texts, before)
    assert [(v.kind, v.text) for v in column(spark, texts, pytext.literal)[9:]] == [
        ("raw", "- 1"), ("number", "-1.5"), ("raw", "'"), ("raw", "'a' 'b'"), ("string", "q"), ("string", "a"),
        ("none", None), ("number", "07"), ("raw", "x'1'"),
    ]


def test_masks_of_closed_and_open_literals(spark):
    texts = ["'a'", "''", "'", "'a", '"""a"""', '""""""', '"""a\nb"""', '"""', '""', "'a\\'", "x\\\ny # '", "\\"]
    f = "\u0001"
    assert column(spark, texts, pytext.mask_source) == [
        f"'{f}'", "''", "'", f"'{f}", f'"""{f}"""', '""""""', f'"""{f}\n\u0003{f}"""', '"""', '""',
        f"'{f * 2}'", "x \n\u0003y \u0002\u0002\u0002", "\\",
    ]
