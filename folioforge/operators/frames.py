"""What stands around rendered sections: packages, the environments that rendering uses, title page, contents, part."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

_PACKAGES = (
    ("geometry", "a4paper,margin=25mm"), ("fontspec", ""), ("amsmath", ""), ("amssymb", ""), ("graphicx", ""), ("tikz", ""), ("lettrine", ""), ("epigraph", ""),
    ("tcolorbox", "most"), ("hyperref", "hidelinks"),
)
#: Boxes by name: the colour of their frame, and whether they take a title, as an option or as an argument.
_BOXES = (
    ("verificationbox", "gray", ""), ("researchbox", "blue", "option"), ("summarybox", "teal", ""), ("examplebox", "green", "option"), ("exercisebox", "orange", ""),
    ("glossarybox", "violet", ""), ("deepresearch", "blue", "argument"), ("translatornote", "brown", ""), ("diagrambox", "gray", "argument"), ("mathbox", "black", ""),
)


def _box(name: str, colour: str, title: str) -> str:
    style = f"breakable,colframe={colour}!60!black,colback={colour}!5"
    if title == "option":
        return f"\\newtcolorbox{{{name}}}[1][]{{{style},title={{#1}}}}"
    return f"\\newtcolorbox{{{name}}}[1]{{{style},title={{#1}}}}" if title else f"\\newtcolorbox{{{name}}}{{{style}}}"


@dataclass(frozen=True)
class Frame:
    """A document class with what rendering needs; parts that are empty are left out."""

    title: str = ""
    subtitle: str = ""
    author: str = ""
    part: str = ""
    contents: bool = True
    main_font: str = ""
    document_class: str = "book"

    def preamble(self) -> str:
        """Everything before the first section."""
        head = [f"\\documentclass{{{self.document_class}}}", *(f"\\usepackage{f'[{o}]' if o else ''}{{{p}}}" for p, o in _PACKAGES)]
        if self.main_font:
            head.append(f"\\setmainfont{{{self.main_font}}}")
        body = [*(_box(*b) for b in _BOXES), "\\begin{document}"]
        if self.title:
            lines = [f"{{\\Huge\\bfseries {self.title}\\par}}", *(f"\\vspace{{1cm}}\n{{\\Large {x}\\par}}" for x in (self.subtitle, self.author) if x)]
            body += ["\\begin{titlepage}", "\\centering", "\\vspace*{4cm}", *lines, "\\end{titlepage}"]
        if self.contents:
            body += ["\\tableofcontents", "\\clearpage"]
        if self.part:
            body.append(f"\\part{{{self.part}}}")
        return "\n".join([*head, *body, "", ""])

    def preamble_of(self, **columns: Column) -> Column:
        """The preamble with fields such as title or part taken from columns; rows without a value leave that field out.

        For render.document(), whose groups the columns must belong to.
        """
        known: list[tuple[Frame, list[tuple[str, bool]]]] = [(self, [])]
        for name in columns:
            known = [(replace(f, **{name: v}), [*named, (name, bool(v))]) for f, named in known for v in ("", f"\x00{name}\x00")]
        out = F.lit(None).cast("string")
        for frame, named in known:
            pieces, text = [], frame.preamble()
            while text:
                before, _, rest = text.partition("\x00")
                name, _, text = rest.partition("\x00")
                pieces += [F.lit(before), *([columns[name]] if name else [])]
            there = F.lit(True)
            for name, given in named:
                there = there & ((F.coalesce(columns[name], F.lit("")) != "") == F.lit(given))
            out = F.when(there, F.concat(*pieces)).otherwise(out)
        return out
