"""Token cleaning, pasted input, styles, words, on the representative inputs."""

import pytest
from pyspark.sql import functions as F

from stylescout.functions import text as T


def one(spark, f, value):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("flex", "flex"), ('cn("flex"', "flex"), ('["a"]', "a"), (".btn", "btn"), ("'p-4',", "p-4"), ('clsx(cn("x"))', "x"), ("{", ""), ("w-[3px]", "w-[3px]"), ('CN("q")', "q"),
    ],
)
def test_clean_token(spark, value, want):
    assert one(spark, T.clean_token, value) == want


INNER = "sticky m-2 ring-2"


@pytest.mark.parametrize(
    "value",
    [INNER, f'class="{INNER}"', f'<div id="a" class="{INNER}">x</div>', f'className="{INNER}"', f'className={{"{INNER}"}}', "className={`" + INNER + "`}", f'  class = "{INNER}" '],
)
def test_extract_paste(spark, value):
    assert one(spark, T.extract_paste, value) == INNER


def test_paste_forms(spark):
    assert one(spark, T.parse_class_list, '["a", "b", "c"]') == ["a", "b", "c"]
    assert one(spark, T.parse_class_list, 'className={on ? "x y" : "z"}') == ["x", "y", "z"]
    assert one(spark, T.parse_class_list, 'const k = cn("a b", on && "c")') == ["a", "b", "c"]
    assert one(spark, T.parse_class_list, "a b a\n\tc") == ["a", "b", "c"]
    assert one(spark, T.parse_class_list, 'class=""') == []
    assert one(spark, T.tokenize, None) == []
    assert one(spark, T.tokenize, "") == []


def test_styles(spark):
    css = "max-width: 40ch; line-height: 7px; margin-left: 3em;"
    want = ["style:maxwidth:40ch", "style:lineheight:7", "style:marginleft:3em"]
    assert one(spark, T.is_style_input, css) is True
    assert one(spark, T.parse_style_list, css) == want
    assert one(spark, T.parse_style_list, f'style="{css}"') == want
    assert one(spark, T.parse_style_list, "style={{ maxWidth: '40ch', lineHeight: 7 }}") == want[:2]
    assert one(spark, T.is_style_input, 'cn("a", on ? "b" : "c")') is False
    assert one(spark, T.is_style_input, "width: 3px") is True
    assert one(spark, T.is_style_input, "hover:flex") is False
    assert one(spark, T.normalize_style_value, ' "12PX" ') == "12"


def test_predicates(spark):
    assert one(spark, T.looks_like_code, "a ? b : c") is True
    assert one(spark, T.looks_like_code, "hover:flex p-4") is False
    assert one(spark, T.looks_like_class_input, "flex p-4") is True
    assert one(spark, T.looks_like_class_input, "flex") is False
    assert one(spark, T.looks_like_class_input, "if (a) b") is False
    assert one(spark, T.arbitrary_base, "w-[12px]") == "w-[]"
    assert one(spark, T.arbitrary_base, "w-12") is None


def test_lines_and_words(spark):
    assert one(spark, T.lines, "a\r\nb\n") == ["a", "b", ""]
    assert one(spark, T.line_tokens, '<a className="x y:z">x</a>') == ["a", "className", "x", "y:z", "/a"]
    assert one(spark, T.query_words, 'TODO: fix, "it" a fix!') == ["todo", "fix", "it"]
    assert one(spark, T.context_snippet, "  " + "x" * 200) == "x" * 140


def test_column_fold(spark):
    fold = lambda a: spark.range(1).select(T.fold_columns(F.array(*map(F.lit, a))).alias("y")).first()["y"]
    assert fold([5, 3, -1]) == 3
    assert fold([0, 4]) == 4  # a 0 counts as not set
    assert fold([-1]) == 0
