"""Scalar and parsing functions on boundary rows."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioforge.functions import mathtok, parsing
from folioforge.functions import text as T
from folioforge.operators import paragraphs, render


def values(spark, texts, fn):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", fn(F.col("t")).alias("v")).collect()
    return [r["v"] for r in sorted(rows, key=lambda r: r["i"])]


@pytest.mark.parametrize(
    ("fn", "given_text", "wanted"),
    [
        (T.py_strip, "  a b \n", "a b"),
        (T.collapse_newlines, "a\n\n\n\nb", "a\n\nb"),
        (T.strip_east_asian, "a漢字かなカナb한", "ab한"),
        (T.strip_foreign_scripts, " кот ไทย عرب ok ", "ok"),
        (T.strip_comment_lines, "x\nNote: this\ny", "x\ny"),
        (T.strip_comment_lines, "Note: no line feed", "Note: no line feed"),
        (T.strip_emphasis, "**a** *b*", "a b"),
        (T.scripts_to_tex, "x<sup>2</sup>y<sub>i</sub>", "x^{2}y_{i}"),
        (T.strip_think, "<think>a\nb</think>c", "c"),
        (T.heading_text, "<b>1</b> Title<sup>2</sup><a href='#'>x</a>", "1 Title"),
        (T.clean_title, "\n 물론이죠! Title \nmore", "Title"),
        (T.plain_title, "A_$b " + "x" * 100, ("Ab " + "x" * 100)[:80]),
        (T.clean_translation, '번역: "안녕하세요"', "안녕하세요"),
        (T.clean_translation, "Translation: 안녕\n 오늘의 수업은\n끝 мир", "안녕\n끝"),
        (T.strip_list_marker, "12) - word", "word"),
        (T.converted_name, "a.svgz", "a.pdf"),
        (render.break_long_runs, "가" * 12, "가" * 12),
        (render.break_long_runs, "가" * 21, "가" * 10 + r"\hspace{0pt}" + "가" * 10 + r"\hspace{0pt}" + "가"),
        (render.space_scripts, "한a1국", "한 a1 국"),
        (render.wrap_bare_math, "a_1 and $b_2$ and e^(x) r ^1.4", "$a_1$ and $b_2$ and $e^{x}$ $r^{1.4}$"),
        (render.escape_specials, r"50% \textbf{a_b} $x_1$ c_d ^", r"50\% \textbf{a_b} $x_1$ c\_d \^{}"),
        (render.escape_light, r"a_b \_c & $x_1$", r"a\_b \_c \& $x_1$"),
        (render.wrap_bullets, "x\n- a\n* b\ny", "x\n\\begin{itemize}\n\\item a\n\\item b\n\\end{itemize}\ny"),
        (render.clean_for_latex, "**b** $$x$$ 5%\n\n\n\nend", "\\textbf{b} \\[x\\] 5\\%\n\nend"),
        (parsing.diagram, r"x \begin{tikzpicture}a\end{tikzpicture} y", r"\begin{tikzpicture}a\end{tikzpicture}"),
        (parsing.diagram, r"\begin{tikzpicture}\begin{scope}\end{tikzpicture}", ""),
    ],
)
def test_text(spark, fn, given_text, wanted):
    assert values(spark, [given_text], fn) == [wanted]


def test_search_terms(spark):
    assert values(spark, ["the Big theorem of Gauss-Bonnet in x1y, (1850)"], T.search_terms) == [["Gauss-Bonnet", "Big", "theorem", "1850", "x1y"]]


def test_json(spark):
    texts = ['Sure {"score": "12"} ok', '{"score": "3", "x": {"y": 1}}', "no json", '{"score": ', "", None, "[1]"]
    fn = lambda c: parsing.clamped_score(parsing.json_from_text(c, "score string")["score"])
    assert values(spark, texts, fn) == [10, 3, None, None, None, None, None]


def test_numbered_items(spark):
    long = "an item that is long enough"
    texts = [f"preamble here we go\n1. {long} A\n2. {long} B\n3. short", f"{long} without marker", "1. tiny\n2. x", None, "\n".join(["x" * 12] + [f"{k}. {long} {k}" for k in range(1, 7)])]
    got = values(spark, texts, parsing.numbered_items)
    assert got[0] == ["preamble here we go", f"{long} A", f"{long} B"]
    assert got[1] == [f"{long} without marker"]
    assert got[3] == []
    assert len(got[4]) == 4


def test_pairs(spark):
    text = "# head\n1. a | b\n- c - d\ne: f\ng | \nplain\n" + "\n".join(f"k{i}: v" for i in range(9))
    got = values(spark, [text], parsing.pairs)[0]
    assert [tuple(p) for p in got[:3]] == [("a", "b"), ("c", "d"), ("e", "f")]
    assert len(got) == 8


def test_math(spark):
    assert values(spark, ["$$x$$ and $y$"], mathtok.regions)[0].count("$x$") == 1
    assert set(values(spark, [r"\int x \infty"], mathtok.commands)[0]) == {r"\int", r"\in", r"\inf", r"\infty"}
    rows = spark.createDataFrame(
        [("plain", "text"), (r"$x^2$ here", "x^2 hier"), (r"\frac{a}{b} $y$", r"frac{a}{b} $y$"), ("$a$ $b$ $c$", "$a$")], "o string, t string"
    ).select(mathtok.check(F.col("o"), F.col("t")).alias("c"))
    got = [r["c"] for r in rows.collect()]
    assert [g["score"] for g in got[:2]] == [100, 100]
    assert got[1]["fixed_text"] == "$x^2$ hier"
    assert got[2]["fixed_text"] == r"\frac{a}{b} $y$"
    assert 0 < got[3]["score"] < 100


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab c", min_size=1, max_size=30).filter(lambda s: s.strip()), min_size=1, max_size=12))
def test_chunks_join_to_their_input(spark, parts):
    got = values(spark, ["\n\n".join(parts)], lambda c: paragraphs.chunk_array(c, "\n\n", 20))[0]
    assert "\n\n".join(got) == "\n\n".join(parts)
    for c in got:
        inner = c.split("\n\n")
        assert len(inner) == 1 or sum(map(len, inner)) <= 20


def test_chunk_boundaries(spark):
    size = lambda texts: [len(v) for v in values(spark, texts, lambda c: paragraphs.chunk_array(c, "\n\n", 10))]
    assert size(["", "x" * 10, "x" * 11, "x" * 11 + "\n\ny", "a\n\n" + "x" * 11 + "\n\nb", "aaaaa\n\nbbbbb", "aaaaa\n\nbbbbbb", None]) == [0, 1, 1, 2, 3, 1, 2, 0]


def test_clean_translated(spark):
    long = "English words only, which nobody has translated, " * 3
    text = f"**한국어** 문단\n\n{long}\n\n" + "같은 시작으로 된 문단은 한 번만 남아야 하며 길이는 서른을 넘는다 A\n\n" + "같은 시작으로 된 문단은 한 번만 남아야 하며 길이는 서른을 넘는다 B"
    df = spark.createDataFrame([(1, text), (2, None)], "i int, t string")
    got = {r["i"]: r["text"] for r in paragraphs.clean_translated(df, "i", "t").collect()}
    assert got[1].startswith("한국어 문단\n\n같은") and got[1].endswith("A") and "English" not in got[1]
    assert got[2] == ""
