"""Quality metrics of C source text: one lexer pass and one pass over its tokens, run per file in Arrow batches."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from statistics import fmean, median, pstdev

import pandas as pd
from pyspark.sql import DataFrame

from faultline.session import spread

# Words of the language and how they are treated.
KEYWORDS = {
    "auto", "break", "case", "char", "const", "continue", "default", "do", "double", "elif", "else", "enum", "extern", "float", "for", "goto", "if",
    "ifdef", "include", "inline", "int", "long", "noalias", "register", "restrict", "return", "short", "signed", "sizeof", "static", "struct",
    "switch", "typedef", "union", "unsigned", "void", "volatile", "while",
}
COUNTED = ["const", "enum", "goto", "inline", "noalias", "register", "restrict", "signed", "struct", "union", "unsigned", "void", "volatile", "typedef"]
SPACED_BOTH = {"case", "do", "else", "for", "goto", "if", "switch", "while", "enum", "struct", "union"}
SPACED_LEFT = {"break", "continue", "default", "return"}
NESTING = {"if", "for", "while", "do", "switch", "else"}
PATHS = {"if", "for", "while", "case"}
BOILERPLATE = re.compile(r"(?<![A-Za-z])(?:Copyright|WARRANTIES)[^A-Za-z]")
# Style habits; each has its opposite under no_.
STYLES = (
    "space_after_binary_op", "space_after_closing_brace", "space_after_comma", "space_after_keyword", "space_after_opening_brace",
    "space_after_semicolon", "space_after_struct_op", "space_before_binary_op", "space_before_closing_brace", "space_before_keyword",
    "space_before_opening_brace", "space_before_struct_op", "space_after_opening_square_bracket", "space_after_unary_op",
    "space_before_closing_bracket", "space_before_closing_square_bracket", "space_before_comma", "space_before_opening_square_bracket",
    "space_before_semicolon",
)
_LEX = re.compile(
    r"""(?P<comment>/\*.*?(?:\*/|\Z)|//[^\n]*)|(?P<string>"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?)|(?P<cpp>(?:(?<=\n)|\A)[ \t]*\#(?:\\\n|/\*.*?\*/|[^\n])*)"""
    r"""|(?P<word>[A-Za-z_]\w*)|(?P<number>\.?\d(?:[eEpP][+-]|[\w.])*)|(?P<op><<=|>>=|\.\.\.|->|\+\+|--|&&|\|\||[<>=!+\-*/%&^|]=|<<|>>|[^\s\w])""",
    re.S,
)
_BINARY = {"/", "%", "<<", ">>", "<", "<=", ">", ">=", "==", "!=", "^", "|", "&&", "||", "?", "=", "+=", "-=", "*=", "/=", "%=", "<<=", ">>=", "&=", "^=", "|="}


def describe(values: list) -> tuple:
    """count, min, mean, median, max, population sd; nulls but for the count when empty."""
    if not values:
        return (0, None, None, None, None, None)
    return (len(values), float(min(values)), fmean(values), float(median(values)), float(max(values)), pstdev(values))


def inconsistency(style: dict[str, int]) -> float | None:
    """Minority share of all style decisions; null when there is none."""
    pairs = [(style[s], style["no_" + s]) for s in STYLES]
    n = sum(a + b for a, b in pairs)
    return sum(min(p) for p in pairs) / n if n else None


class _File:
    """Counters of one file while its tokens go by."""

    def __init__(self, text: str):
        self.text = text
        self.style = {p + s: 0 for s in STYLES for p in ("", "no_")}
        self.style["space_at_end_of_line"] = 0
        self.n = dict.fromkeys([*(f"n_{k}" for k in COUNTED), "n_internal", "n_comment", "n_comment_char", "n_boilerplate_char", "n_dox", "n_dox_char", "n_fun_comment", "n_cpp", "n_cpp_include", "n_cpp_conditional", "n_fun_cpp", "n_fun_cpp_conditional", "n_function"], 0)
        self.nesting, self.halstead, self.cyclomatic, self.extended, self.idents, self.indents = [], [], [], [], [], []

    def side(self, habit: str, char: str, skip_eol: bool = False) -> None:
        """Only a blank is a space; with ``skip_eol`` a line or file end decides nothing."""
        if skip_eol and char in ("", "\n", "\r"):
            return
        self.style[habit if char == " " else "no_" + habit] += 1

    def run(self) -> None:
        text = self.text
        char = lambda i: text[i] if 0 <= i < len(text) else ""
        # "fun", "block" for braces; control words whose body is to come, "done" for a do that awaits its while
        stack: list[str] = []
        dangling: list[str] = []  # the words around the innermost if that the last statement closed, for an else
        paren, ternary, in_case = 0, 0, False
        prev, ops, operands, paths, branches = "", [], [], 1, 0
        line, continued, noted, control, balance = -1, False, False, False, 0  # start of the line, and what it holds

        def close() -> None:
            """A statement ends: so do the control words above it that have no brace."""
            nonlocal dangling
            around = None
            while stack and stack[-1] in NESTING:
                word = stack.pop()
                if word == "do":
                    stack.append("done")
                    break
                if word == "if" and around is None:
                    around = list(stack)
            dangling = around if around is not None else []

        line_level: dict[int, int] = {}
        for m in _LEX.finditer(text):
            kind, tok, a, b = m.lastgroup, m[0], m.start(), m.end()
            inside = "fun" in stack
            start = text.rfind("\n", 0, a) + 1
            if start != line:
                # a line goes on from the one above unless that ends a statement, holds a note or is a whole control head
                above = text[text.rfind("\n", 0, start - 1) + 1 : start - 1].rstrip() if start else ""
                continued = bool(above) and above[-1] not in ";{}" and not noted and not (control and balance == 0)
                line, noted, control, balance = start, False, False, 0
            if kind in ("comment", "cpp"):
                noted, line = True, text.rfind("\n", 0, b) + 1  # it may end lines below
            if kind == "comment":
                self.n["n_comment"] += 1
                self.n["n_comment_char"] += len(tok)
                self.n["n_fun_comment"] += inside
                if BOILERPLATE.search(tok + " "):
                    self.n["n_boilerplate_char"] += len(tok)
                if re.match(r"/\*[*!][^*/]|//[/!]", tok):
                    self.n["n_dox"] += 1
                    self.n["n_dox_char"] += len(tok)
                continue
            if kind == "cpp":
                word = re.match(r"\s*#\s*(\w*)", tok)[1]
                cond = word in ("if", "ifdef", "ifndef", "elif")
                self.n["n_cpp"] += 1
                self.n["n_cpp_include"] += word == "include"
                self.n["n_cpp_conditional"] += cond
                self.n["n_fun_cpp"] += inside
                self.n["n_fun_cpp_conditional"] += cond and inside
                continue
            level = sum(x in NESTING for x in stack)
            bol = not text[start:a].strip()
            if inside and bol and not continued:
                line_level[a] = max(0, level - (tok == "}"))
            before, after = char(a - 1), char(b)
            if kind == "word":
                if tok in KEYWORDS:
                    if f"n_{tok}" in self.n:
                        self.n[f"n_{tok}"] += 1
                    self.n["n_internal"] += tok == "static" and not inside
                    if tok in SPACED_BOTH or tok in SPACED_LEFT:
                        if not bol and not (before == "(" and tok in ("enum", "struct", "union")):
                            self.side("space_before_keyword", before)
                        if tok in SPACED_BOTH:
                            self.side("space_after_keyword", after)
                    control = control or tok in NESTING or tok in ("case", "default")
                    if tok == "while" and stack and stack[-1] == "done":
                        stack.pop()
                    elif tok == "if" and prev == "else" and stack and stack[-1] == "else":
                        stack[-1] = "if"  # one level with the else
                    elif tok in NESTING:
                        if tok == "else" and dangling:
                            stack[:], dangling = dangling, []
                        stack.append(tok)
                    in_case = in_case or tok in ("case", "default")
                    paths += inside and tok in PATHS
                    ops.append(tok)
                else:
                    self.idents.append(tok)
                    operands.append(tok)
            elif kind in ("number", "string"):
                operands.append(tok)
            elif tok == "{":
                if not bol:
                    self.side("space_before_opening_brace", before)
                self.side("space_after_opening_brace", after, True)
                starts = not inside and not paren and prev == ")"
                if starts:
                    self.n["n_function"] += 1
                    ops, operands, paths, branches = [], [], 1, 0
                stack.append("fun" if starts else "block")
            elif tok == "}":
                if not bol:
                    self.side("space_before_closing_brace", before)
                self.side("space_after_closing_brace", after, True)
                while stack and stack[-1] not in ("fun", "block"):
                    stack.pop()
                if stack and stack.pop() == "fun":
                    n = len(ops) + len(operands)
                    u = len(set(ops) | set(operands))
                    self.halstead.append(n * math.log2(u) if n else 0.0)
                    self.cyclomatic.append(float(paths))
                    self.extended.append(float(paths + branches))
                    paren = 0
                close()
            elif tok == ";":
                if not bol:
                    self.side("space_before_semicolon", before)
                self.side("space_after_semicolon", after, True)
                if inside and not paren:
                    self.nesting.append(level)
                    close()
            else:
                ops.append(tok)
                balance += (tok in "([") - (tok in ")]")
                if tok == "(":
                    paren += 1
                elif tok == ")":
                    paren = max(0, paren - 1)
                    self.side("space_before_closing_bracket", before)
                elif tok == "[":
                    self.side("space_before_opening_square_bracket", before)
                    self.side("space_after_opening_square_bracket", after)
                elif tok == "]":
                    self.side("space_before_closing_square_bracket", before)
                elif tok == ",":
                    self.side("space_before_comma", before)
                    self.side("space_after_comma", after, True)
                elif tok in ("->", "."):
                    self.side("space_before_struct_op", before)
                    self.side("space_after_struct_op", after)
                elif tok in ("!", "~"):
                    self.side("space_after_unary_op", after)
                elif tok in _BINARY or (tok in "+-" and re.search(r"[\w)\]]\s*\Z", text[max(0, a - 80) : a])) or (tok == ":" and ternary):
                    self.side("space_before_binary_op", before)
                    self.side("space_after_binary_op", after)
                ternary += (tok == "?") - (tok == ":" and ternary > 0)
                in_case = in_case and tok != ":"
                if inside and tok in ("&&", "||", "?"):
                    paths += tok == "?"
                    branches += tok != "?"
            prev = tok
        for start, level in line_level.items():
            head = text[text.rfind("\n", 0, start) + 1 : start]
            if width := len(head.expandtabs(8)):
                self.indents.append(width / (level + 1))


DESCRIBED = ["line_length", "statement_nesting", "halstead", "cyclomatic", "identifier_length", "unique_identifier_length", "indentation", "extended_cyclomatic"]
_PARTS = ["count", "min", "mean", "median", "max", "sd"]


def metrics(text: str | None) -> dict:
    """All metrics of one text; null text counts as empty."""
    text = text or ""
    f = _File(text)
    f.run()
    lines = text.split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    f.style["space_at_end_of_line"] = sum(x.rstrip("\r").endswith(" ") for x in lines)
    out = {"n_char": len(text) + 1 if text else 0, "n_empty_line": sum(not x.strip() for x in lines), **f.n}
    groups = [[len(x) for x in lines], f.nesting, f.halstead, f.cyclomatic, [len(x) for x in f.idents], [len(x) for x in set(f.idents)], f.indents, f.extended]
    for name, values in zip(DESCRIBED, groups):
        out.update({f"{name}_{p}": v for p, v in zip(_PARTS, describe(values))})
    out["inconsistency"] = inconsistency(f.style)
    out.update({f"style_{k}": v for k, v in f.style.items()})
    return out


def _schema() -> str:
    sample = metrics("f(){a;}")
    return ", ".join(f"{k} {'double' if k == 'inconsistency' or re.search('_(min|mean|median|max|sd)$', k) else 'long'}" for k in sample)


def file_metrics(files: DataFrame, key: str, text: str, key_type: str = "long") -> DataFrame:
    """``key`` and all metrics of column ``text``, one row per row of ``files``."""
    names = list(metrics(""))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = pd.DataFrame([metrics(t) for t in b["__text"]], columns=names)
            out.insert(0, key, b[key].to_numpy())
            yield out

    return spread(files.selectExpr(f"`{key}`", f"`{text}` AS __text")).mapInPandas(run, f"{key} {key_type}, " + _schema())


def minify(text: str | None) -> str:
    """The tokens of a text on lines of one statement or brace each, without comments; directives keep their line."""
    out: list[str] = []
    glue = ""
    for m in _LEX.finditer(text or ""):
        kind, tok = m.lastgroup, m[0]
        if kind == "comment":
            continue
        if kind == "cpp":
            out.append(("" if not out or out[-1].endswith("\n") else "\n") + tok.strip() + "\n")
            glue = ""
            continue
        wordy = kind in ("word", "number")
        out.append((" " if wordy and glue == "word" else "") + tok + ("\n" if tok in (";", "{", "}") else ""))
        glue = "word" if wordy else ""
    return "".join(out).strip("\n")


def minified(files: DataFrame, key: str, text: str, key_type: str = "long") -> DataFrame:
    """(key, minified), one row per row of ``files``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "minified": [minify(t) for t in b["__text"]]})

    return spread(files.selectExpr(f"`{key}`", f"`{text}` AS __text")).mapInPandas(run, f"{key} {key_type}, minified string")
