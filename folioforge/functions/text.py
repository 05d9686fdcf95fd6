"""Scalar text functions: Column -> Column, all inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ranges of scripts that cleaners remove or count.
HAN = r"\x{4e00}-\x{9fff}"
HAN_EXTENSION_A = r"\x{3400}-\x{4dbf}"
HIRAGANA = r"\x{3040}-\x{309f}"
KATAKANA = r"\x{30a0}-\x{30ff}"
ARABIC = r"\x{0600}-\x{06ff}\x{0750}-\x{077f}"
CYRILLIC = r"\x{0400}-\x{04ff}"
THAI = r"\x{0e00}-\x{0e7f}"
HANGUL = r"\x{ac00}-\x{d7af}"

# Openers of comment lines that models put around their output.
TRANSLATION_COMMENTS = ("翻译", "번역문", "Translation", "Note:", "Let me know", "Let's break down")
SUPPLEMENT_COMMENTS = ("Here is", "Here are", "Below is", "I'll", "Let me", "Note:")
SUPPLEMENT_COMMENTS_KO = ("다음은", "아래는", "참고:")
EXPLANATION_COMMENTS = ("Here is", "Below is", "다음은", "아래는")
FILLER_LINES = ("물론이죠", "당연하죠", "알겠습니다", "준비되었", "시작해볼", "오늘의 수업", "오늘의 주제")
FILLER_LINES_MORE = ("궁금한 점", "언제든지 물어")
FILLER_OPENERS = (r"물론이죠!?\s*", r"당연하죠!?\s*", r"알겠습니다!?\s*")
TRANSLATION_OPENERS = ("이것은 번역입니다:?", "번역:?", "Korean Translation:?", "Translation:?")
FILLER_ENDINGS = ("궁금한 점이 있으면", "언제든지 물어봐주세요")

# Words without content, for search terms.
STOP_WORDS = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "has", "have", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might",
    "can", "shall", "that", "this", "these", "those", "it", "its", "of", "in", "on", "at", "to", "for", "with", "by", "from", "as", "or", "and", "not", "no",
    "but", "if", "then", "than", "so", "very",
)

# White space, by ASCII and by Unicode.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UNICODE_SPACE = ASCII_SPACE + "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def py_strip(c: Column) -> Column:
    """Both ends without any Unicode white space."""
    return F.btrim(c, F.lit(UNICODE_SPACE))


def ascii_strip(c: Column) -> Column:
    """Both ends without space, tab, line feed, vertical tab, form feed, carriage return."""
    return F.btrim(c, F.lit(ASCII_SPACE))


def is_blank(c: Column) -> Column:
    return ~F.coalesce(c, F.lit("")).rlike(r"(?U)\S")


def collapse_spaces(c: Column) -> Column:
    return F.regexp_replace(c, "  +", " ")


def collapse_newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\n{3,}", "\n\n")


def normalize_node(c: Column) -> Column:
    """White space of a text node turned into single spaces, ends stripped."""
    return py_strip(F.regexp_replace(c, r"(?U)\s+", " "))


def strip_east_asian(c: Column) -> Column:
    return F.regexp_replace(c, f"[{HAN}{HAN_EXTENSION_A}{HIRAGANA}{KATAKANA}]", "")


def strip_foreign_scripts(c: Column) -> Column:
    return py_strip(F.regexp_replace(c, f"[{ARABIC}{HAN}{HIRAGANA}{KATAKANA}{CYRILLIC}{THAI}]", ""))


def strip_comment_lines(c: Column, openers=TRANSLATION_COMMENTS) -> Column:
    """From an opener to the end of its line, line feed included; without a line feed nothing goes."""
    return F.regexp_replace(c, "(?d)(?:" + "|".join(openers) + ").*?\n", "")


def strip_emphasis(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(?d)\*\*(.+?)\*\*", "$1"), r"(?d)\*(.+?)\*", "$1")


def strip_bullets(c: Column) -> Column:
    return F.regexp_replace(c, r"(?md)^\s*[*\-]\s+", "")


def strip_headers(c: Column, most: int | None = None) -> Column:
    return F.regexp_replace(c, r"(?md)^\s*#+\s+" if most is None else rf"(?md)^#{{1,{most}}}\s+", "")


def scripts_to_tex(c: Column) -> Column:
    up = F.regexp_replace(c, r"(?d)<sup>(.*?)</sup>", r"^{$1}")
    return F.regexp_replace(up, r"(?d)<sub>(.*?)</sub>", r"_{$1}")


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", "")


def escape_xml(c: Column) -> Column:
    out = c
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(sign), F.lit(entity))
    return out


def strip_think(c: Column) -> Column:
    """Without the reasoning blocks that some models put before their answer."""
    return F.regexp_replace(c, r"(?s)<think>.*?</think>", "")


def heading_text(c: Column) -> Column:
    """The text of a heading's markup without the bodies of span, sup and a."""
    return ascii_strip(strip_tags(F.regexp_replace(c, r"(?s)<(span|sup|a)\b[^>]*>.*?</\1>", "")))


def clean_output(c: Column) -> Column:
    """Supplement texts: comment lines, emphasis, headers and white space."""
    c = strip_comment_lines(strip_comment_lines(c, SUPPLEMENT_COMMENTS), SUPPLEMENT_COMMENTS_KO)
    c = strip_headers(strip_emphasis(c), 3)
    return py_strip(collapse_spaces(collapse_newlines(c)))


def clean_explanation(c: Column) -> Column:
    return py_strip(strip_comment_lines(c, EXPLANATION_COMMENTS))


def drop_lines(c: Column, openers) -> Column:
    """Without the lines whose first text is one of the openers."""
    kept = F.filter(F.split(c, "\n", -1), lambda x: ~py_strip(x).rlike("^(?:" + "|".join(openers) + ")"))
    return F.array_join(kept, "\n")


def clean_translation(c: Column) -> Column:
    """Lecture translations: openers, quotes, endings, filler lines and foreign scripts."""
    c = F.regexp_replace(py_strip(c), r"(?i)^(?:" + "|".join(TRANSLATION_OPENERS) + r")\s*", "")
    c = F.regexp_replace(F.btrim(c, F.lit("\"'")), "^(?:" + "|".join(FILLER_OPENERS) + ")", "")
    c = F.regexp_replace(c, "(?md)(?:" + "|".join(e + ".*$" for e in FILLER_ENDINGS) + ")", "")
    return strip_foreign_scripts(drop_lines(py_strip(c), FILLER_LINES))


def clean_filler(c: Column) -> Column:
    """Enrichment texts: openers and filler lines."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), "(?i)^(?:" + "|".join(FILLER_OPENERS) + ")", "")
    return py_strip(drop_lines(py_strip(c), (*FILLER_LINES, *FILLER_LINES_MORE)))


def clean_title(c: Column) -> Column:
    """The first line with text, without filler; empty if there is none."""
    lines = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n", -1), py_strip), lambda x: x != "")
    return py_strip(F.regexp_replace(F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit("")), "^(?:" + "|".join(FILLER_OPENERS) + ")", ""))


def plain_title(c: Column, special: str = "\\{}$&#^_%~", most: int = 80) -> Column:
    """clean_title() without special characters, cut to a length."""
    return F.left(F.translate(clean_title(c), special, ""), F.lit(most))


def strip_list_marker(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"^\d+[.)]\s*", ""), r"^[-*]\s*", "")


def concept_title(answer: Column, term: Column) -> Column:
    """A model's title: its first line without quotes, the term itself where that is shorter than 2."""
    first = F.btrim(F.split(py_strip(F.coalesce(answer, F.lit(""))), "\n", -1)[0], F.lit("\"'"))
    return F.when(F.length(first) < 2, term).otherwise(first)


def search_terms(c: Column, stop_words=STOP_WORDS, most: int | None = None) -> Column:
    """Words of letters, digits and hyphens longer than 2 that are no stop words: capitalised first, longer first, then in order; the first ones, if most is given."""
    clean = lambda x: F.regexp_replace(x, r"[^a-zA-Z0-9\x20\x09-\x0D-]+", "")
    # One search in a line of all stop words, and none for words longer than those.
    stops, longest = F.lit(" " + " ".join(stop_words) + " "), max(map(len, stop_words), default=0)
    is_stop = lambda x: (F.length(x) <= longest) & F.contains(stops, F.concat(F.lit(" "), F.lower(x), F.lit(" ")))
    capital = lambda x: F.left(x, F.lit(1)).between("A", "Z")

    def ranked(kept: Column) -> Column:
        keyed = F.transform(kept, lambda x, i: F.struct(F.when(capital(x), 0).otherwise(1).alias("k"), (-F.length(x)).alias("n"), i.alias("i"), x.alias("w")))
        return F.transform(F.array_sort(keyed), lambda s: s["w"])

    whole = lambda t: F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda x: (F.length(x) > 2) & ~is_stop(x))
    if most is None:
        return ranked(whole(clean(c)))
    # With enough capitalised words the others need no place in the order, and are not even taken apart. The pattern
    # begins with the letter and looks back over it, as few letters are capitals.
    capitals = lambda t: F.filter(F.regexp_extract_all(t, F.lit(r"[A-Z](?<![^\x20\x09-\x0D][A-Z])[a-zA-Z0-9-]{2,}"), F.lit(0)), lambda x: ~is_stop(x))
    first = lambda t: let(capitals(t), lambda n: F.when(F.size(n) >= most, ranked(n)).otherwise(ranked(whole(t))))
    return F.slice(let(clean(c), first), 1, most)


def script_count(c: Column, ranges: str) -> Column:
    return F.regexp_count(c, F.lit(f"[{ranges}]"))


def safe_key(c: Column, sign: str = "_") -> Column:
    return F.replace(c, F.lit("."), F.lit(sign))


def base_name(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def join_url(base: str, c: Column) -> Column:
    """An absolute URL: c itself, from the host's root, or below the base's folder."""
    scheme, _, rest = base.partition("://")
    host = rest.split("/", 1)[0]
    folder = base.rsplit("/", 1)[0] + "/" if "/" in rest else base + "/"
    return (
        F.when(c.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://"), c)
        .when(c.startswith("//"), F.concat(F.lit(scheme + ":"), c))
        .when(c.startswith("/"), F.concat(F.lit(f"{scheme}://{host}"), c))
        .otherwise(F.concat(F.lit(folder), c))
    )


def converted_name(c: Column) -> Column:
    """Vector image names with the extension of their conversion."""
    return F.replace(F.replace(c, F.lit(".svgz"), F.lit(".pdf")), F.lit(".svg"), F.lit(".pdf"))


def chapter_id(volume: Column, chapter: Column) -> Column:
    return F.concat(volume, F.lit("_"), F.lpad(chapter.cast("string"), 2, "0"))


def contains_folded(c: Column, word: Column) -> Column:
    return F.contains(F.lower(c), F.lower(word))


def token_budget(base: int, model: Column) -> Column:
    """Models that think aloud get 3000 tokens more."""
    return F.when(F.contains(model, F.lit("qwen3")), F.lit(base + 3000)).otherwise(F.lit(base))


def level_of(font_size: Column) -> Column:
    return F.when(font_size >= 9.0, "section").otherwise("subsection")


def heading_kind(section_id: Column, font_size: Column, level: Column) -> Column:
    """chapter for large or section-level headings, section for ids with one dot, else subsection."""
    dots = F.length(section_id) - F.length(F.replace(section_id, F.lit("."), F.lit("")))
    return F.when((font_size >= 9.0) | (level == "section"), "chapter").when(dots == 1, "section").otherwise("subsection")


def clamp(c: Column, low: int = 0, high: int = 100) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


# Bands of the overall score.
SCORE_BANDS = ((90, "우수"), (70, "양호"), (50, "주의"))
LOWEST_BAND = "경고"


def score_band(c: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for least, label in SCORE_BANDS:
        out = out.when(c >= least, label)
    return out.otherwise(LOWEST_BAND)


def is_block_page(title: Column, html: Column) -> Column:
    """Pages of a bot wall instead of content: by title, or by a name within the first 500 characters."""
    return F.coalesce(F.contains(title, F.lit("Attention Required")), F.lit(False)) | F.coalesce(
        F.contains(F.substring(html, 1, 500), F.lit("Cloudflare")), F.lit(False)
    )


def accept_polish(old: Column, new: Column, error: Column | None = None) -> Column:
    """The new text unless it failed or lost more than half of the length."""
    failed = F.lit(False) if error is None else error.isNotNull()
    return F.when(failed | new.isNull() | (F.length(new) < 0.5 * F.length(old)), old).otherwise(new)


def or_default(c: Column, default: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), default)


def natural_key(c: Column) -> Column:
    """Sort key of section ids: parts by . and _, numbers before texts and by value."""
    return F.transform(
        F.split(c, "[._]", -1),
        lambda x: F.struct(
            F.when(x.rlike("^[0-9]+$"), 0).otherwise(1).alias("k"), F.coalesce(F.when(x.rlike("^[0-9]+$"), x).try_cast("bigint"), F.lit(0)).alias("n"), x.alias("t")
        ),
    )
