"""Math tokens of texts: regions, commands, variables; their differences and ordered repairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioforge.functions.text import let

# What counts as math.
REGIONS = (r"\$[^$]+?\$", r"\$\$[^$]+?\$\$", r"\\\([^)]+?\\\)", r"\\\[[^\]]+?\\\]")
PLAIN_COMMANDS = (
    "sum", "prod", "int", "lim", "inf", "sup", "sqrt", "log", "ln", "exp", "sin", "cos", "tan", "alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta",
    "theta", "lambda", "mu", "nu", "pi", "rho", "sigma", "tau", "phi", "chi", "psi", "omega", "Gamma", "Delta", "Theta", "Lambda", "Sigma", "Phi", "Psi", "Omega",
    "subset", "supset", "subseteq", "supseteq", "in", "notin", "cup", "cap", "times", "otimes", "oplus", "to", "rightarrow", "leftarrow", "mapsto", "infty",
    "partial", "nabla", "forall", "exists", "leq", "geq", "neq", "approx", "equiv",
)
# Those with arguments apart: they need a pattern each, while one scan finds all plain ones.
ARGUMENT_COMMANDS = (
    r"\\frac\{[^}]*\}\{[^}]*\}", r"\\mathbb\{[A-Z]\}", r"\\mathcal\{[A-Z]\}", r"\\mathfrak\{[a-z]\}", r"\\text\{[^}]*\}", r"\\mathrm\{[^}]*\}", r"\\operatorname\{[^}]*\}",
)
# What every match of a pattern above begins with: a text without it is not scanned.
REGION_SIGNS = ("$", "$$", "\\(", "\\[")
ARGUMENT_SIGNS = ("\\frac{", "\\mathbb{", "\\mathcal{", "\\mathfrak{", "\\text{", "\\mathrm{", "\\operatorname{")
VARIABLE = r"([A-Za-z])(?<![a-zA-Z\\][A-Za-z])(?:_\{?[^}\s]*\}?)?(?:\^\{?[^}\s]*\}?)?"
BACKSLASHED = ("frac", "sum", "prod", "int", "lim", "sqrt", "log", "ln", "sin", "cos", "tan", "exp", "infty", "partial", "nabla")


def _all(c: Column, pattern: str, sign: str) -> Column:
    return F.when(F.contains(c, F.lit(sign)), F.regexp_extract_all(c, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))


def regions(c: Column) -> Column:
    """All regions, pattern by pattern; $$x$$ counts as an inner $x$ too."""
    return let(c, lambda t: F.concat(*[_all(t, "(?s)" + p, sign) for p, sign in zip(REGIONS, REGION_SIGNS)]))


def _by_beginning(names: tuple[str, ...]) -> Column:
    """A map from the backslash and first two letters of commands to those that begin so, in order."""
    groups: dict[str, list[str]] = {}
    for name in names:
        groups.setdefault("\\" + name[:2], []).append("\\" + name)
    return F.create_map(*[x for k, same in groups.items() for x in (F.lit(k), F.array(*map(F.lit, same)))])


def commands(c: Column) -> Column:
    """All commands, as prefixes: \\in also stands at the head of \\int. One scan finds the words, their first letters the few commands to compare."""
    begins, empty = _by_beginning(PLAIN_COMMANDS), F.array().cast("array<string>")

    def of(word: Column) -> Column:
        return F.filter(F.coalesce(F.try_element_at(begins, F.left(word, F.lit(3))), empty), lambda n: word.startswith(n))

    def found(t: Column) -> Column:
        with_arguments = [_all(t, p, sign) for p, sign in zip(ARGUMENT_COMMANDS, ARGUMENT_SIGNS)]
        words = _all(t, r"\\[A-Za-z]{2,}", "\\")
        return F.when(F.contains(t, F.lit("\\")), F.concat(*with_arguments, F.flatten(F.transform(words, of)))).otherwise(empty)

    return let(c, found)


def variables(found: Column) -> Column:
    """Single letters with their sub- and superscripts, inside the regions given."""
    return F.flatten(F.transform(found, lambda r: F.regexp_extract_all(r, F.lit(VARIABLE), F.lit(0))))


def tokens(c: Column) -> Column:
    return let(c, lambda t: let(regions(t), lambda r: F.concat(r, commands(t), variables(r))))


def missing_tokens(original: Column, translated: Column) -> Column:
    """Distinct tokens of the original that the translation lacks, in order of text."""
    return F.array_sort(F.array_except(F.array_distinct(original), translated))


def repair_scripts(c: Column) -> Column:
    up = F.regexp_replace(c, r"(?d)<sup>(.*?)</sup>", r"^{$1}")
    return F.regexp_replace(up, r"(?d)<sub>(.*?)</sub>", r"_{$1}")


def restore_delimiters(text: Column, missing: Column) -> Column:
    """For each missing $token$, in order: the first place of its inner text gets its delimiters back, if it has them nowhere."""

    def step(t: Column, token: Column) -> Column:
        inner = F.when(token.startswith("$$"), F.substring(token, F.lit(3), F.length(token) - 4)).otherwise(F.substring(token, F.lit(2), F.length(token) - 2))
        at = F.instr(t, inner)
        lost = (at > 0) & (F.length(inner) > 0) & ~F.contains(t, F.concat(F.lit("$"), inner, F.lit("$")))
        return F.when(lost, F.concat(F.substring(t, F.lit(1), at - 1), token, F.substring(t, at + F.length(inner), F.length(t)))).otherwise(t)

    delimited = F.filter(missing, lambda m: m.startswith("$") & m.endswith("$") & (F.length(m) > 1))
    return F.aggregate(delimited, text, step)


def restore_backslashes(c: Column) -> Column:
    """Backslashes before command names that lost them, one name after the other, inside words too.

    A search for the name alone comes first; the pattern begins with the name, and looks back over it last.
    """

    def restored(t: Column, name: str) -> Column:
        return let(t, lambda x: F.when(F.contains(x, F.lit(name)), F.regexp_replace(x, rf"{name}(?=[\s{{(])(?<!\\{name})", rf"\\{name}")).otherwise(x))

    return reduce(restored, BACKSLASHED, c)


def preservation(original: Column, still_missing: Column) -> Column:
    """The preserved share of distinct tokens as a whole number of per cent, 100 without any."""
    n = F.size(F.array_distinct(original))
    return F.when(n == 0, 100).otherwise(((1 - F.size(still_missing) / n) * 100).cast("int"))


def check(original: Column, translated: Column) -> Column:
    """struct(score, missing, n_tokens, fixed_text): token difference, repairs in order, difference again."""

    def judged(o: Column, t: Column) -> Column:
        empty = F.array().cast("array<string>")
        none = F.struct(F.lit(100).alias("score"), empty.alias("missing"), F.lit(0).alias("n_tokens"), t.alias("fixed_text"))
        lost = lambda: missing_tokens(o, tokens(t))
        done = let(
            restore_backslashes(restore_delimiters(repair_scripts(t), lost())),
            lambda fixed: let(
                missing_tokens(o, tokens(fixed)),
                lambda still: F.struct(preservation(o, still).alias("score"), still.alias("missing"), F.size(F.array_distinct(o)).alias("n_tokens"), fixed.alias("fixed_text")),
            ),
        )
        return F.when(F.size(o) == 0, none).otherwise(done)

    return let(translated, lambda t: let(tokens(original), lambda o: judged(o, t)))


def adjusted_score(score: Column, n_missing: Column, n_tokens: Column, equivalent: Column) -> Column:
    """A model's count of equivalent forms lowers the number missing, for scores from 50 to 90 only."""
    left = n_missing - equivalent
    usable = score.between(50, 90) & (equivalent > 0) & (left >= 0)
    return F.when(usable, ((1 - left / n_tokens) * 100).cast("int")).otherwise(score)
