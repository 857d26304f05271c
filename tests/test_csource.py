"""C metrics against fragments of our own; every expected number is counted by hand from the rules."""

import pytest

from faultline.functions.csource import describe, inconsistency, metrics

# operators with a left and a right side
BINARY = ["<=", "+=", "%", ">>=", "&&", "!=", "|", "/", "=", "<<"]


@pytest.mark.parametrize("op", BINARY)
def test_sides_of_a_binary_operator(op):
    m = metrics(f"total {op}limit;\nnext{op} step;\n")
    assert (m["style_space_before_binary_op"], m["style_no_space_before_binary_op"]) == (1, 1)
    assert (m["style_space_after_binary_op"], m["style_no_space_after_binary_op"]) == (1, 1)


def test_minus_is_binary_after_an_operand_only():
    m = metrics("k = -1;\nk = k - 1;\nk = f(2)-w[3];\n")  # three assignments, two subtractions
    assert m["style_space_before_binary_op"] == 4 and m["style_no_space_before_binary_op"] == 1
    assert m["style_space_after_binary_op"] == 4 and m["style_no_space_after_binary_op"] == 1


def test_keywords_and_blanks():
    m = metrics("int pick(int n)\n{\n\twhile (n) n--;\n\tif(n) return 3; else return 4;\n\tdo{ n++; }while(n);\n}\n")
    # after: while and else with a blank; if, do and the second while without
    assert (m["style_space_after_keyword"], m["style_no_space_after_keyword"]) == (2, 3)
    # before, unless first of the line: return, else and return with a blank; the second while without
    assert (m["style_space_before_keyword"], m["style_no_space_before_keyword"]) == (3, 1)
    assert metrics("#define while for\n")["style_no_space_after_keyword"] == 0


@pytest.mark.parametrize(
    "code,habit,yes,no",
    [
        ("grid[ 2] [5][i ];", "space_after_opening_square_bracket", 1, 2), ("grid[ 2] [5][i ];", "space_before_opening_square_bracket", 1, 2), ("grid[ 2] [5][i ];", "space_before_closing_square_bracket", 1, 2),
        ("call(p ,q, r,s);", "space_before_comma", 1, 2), ("call(p ,q, r,s);", "space_after_comma", 1, 2), ("call(p, q );done();", "space_before_closing_bracket", 1, 1),
        ("u = ! v; w = ~x;", "space_after_unary_op", 1, 1), ("p->x = q ->y + r. z;", "space_before_struct_op", 1, 2), ("p->x = q ->y + r. z;", "space_after_struct_op", 1, 2),
        ("g = 1 ; h = 2;", "space_before_semicolon", 1, 1), ("g = 1;h = 2; i = 3;\n", "space_after_semicolon", 1, 1), ("m = t ?u : v;\n", "space_after_binary_op", 2, 1),
        ("void w(void){ go(); }\nvoid v(void) {go();}\n", "space_before_opening_brace", 1, 1), ("void w(void){ go(); }\nvoid v(void) {go();}\n", "space_after_opening_brace", 1, 1),
        ("void w(void){ go(); }\nvoid v(void) {go();}\n", "space_before_closing_brace", 1, 1), ("void w(void){ go(); } int z;\n", "space_after_closing_brace", 1, 0),
    ],
)
def test_habits(code, habit, yes, no):
    m = metrics(code)
    assert (m["style_" + habit], m["style_no_" + habit]) == (yes, no)


def test_first_of_a_line_decides_nothing_before_it():
    m = metrics("void w(void)\n{\n\tgo();\n}\n   ;\n")
    assert m["style_space_before_opening_brace"] == m["style_no_space_before_opening_brace"] == m["style_space_before_closing_brace"] == m["style_no_space_before_closing_brace"] == 0
    assert m["style_no_space_before_semicolon"] == 1  # that of the call


def test_blanks_at_line_ends():
    assert metrics("p = 1; \nq = 2;\nr = 3; \r\n")["style_space_at_end_of_line"] == 2


def test_lines_and_characters():
    m = metrics("abc\n\n \t\nde")
    assert (m["n_char"], m["n_empty_line"], m["line_length_count"], m["line_length_max"], m["line_length_mean"]) == (11, 2, 4, 3.0, 1.75)


def test_functions_nesting_and_paths():
    m = metrics("int first(int a)\n{\n\tif (a) {\n\t\twhile (a) a--;\n\t\tb = a ? 1 : 2;\n\t}\n\treturn a;\n}\nint second(void) { return 0; }\nstruct pair { int left; };\n")
    assert m["n_function"] == 2 and m["n_struct"] == 1 and m["n_void"] == 1
    # the decrement lies two deep, the assignment one, both returns none
    assert (m["statement_nesting_count"], m["statement_nesting_max"], m["statement_nesting_mean"]) == (4, 2.0, 0.75)
    # if, while and the question mark each open a path in the first
    assert (m["cyclomatic_count"], m["cyclomatic_min"], m["cyclomatic_max"]) == (2, 1.0, 4.0)


def test_else_belongs_to_the_inner_if():
    levels = lambda body: (metrics("int f(void)\n{\n" + body + "\n}\n")["statement_nesting_mean"], metrics("int f(void)\n{\n" + body + "\n}\n")["statement_nesting_count"])
    assert levels("if (a) if (b) x; else y;") == (2.0, 2)
    assert levels("if (a) x; else if (b) y; else z;") == (1.0, 3)
    assert levels("if (a) { if (b) x; } else y; w;") == (1.0, 3)  # 2, 1, 0
    assert levels("do x; while (c); y;") == (pytest.approx(1 / 3), 3)  # the while ends at level 0
    assert levels("while (a) for (;;) x; y;") == (1.0, 2)


def test_extended_paths():
    m = metrics("int f(int a)\n{\n\tif (a > 1 && a < 5 || !a) return 1;\n\treturn a ? 2 : 3;\n}\n")
    assert (m["cyclomatic_max"], m["extended_cyclomatic_max"]) == (3.0, 5.0)


def test_continuation_lines_are_not_measured():
    m = metrics("int f(int a)\n{\n    a = a +\n              1;\n    if (a)\n        a++;\n    call(a,\n         a);\n}\n")
    # measured: the assignment, the if, its body (a whole head is above it), the call
    assert (m["indentation_count"], m["indentation_max"]) == (4, 4.0)


def test_halstead():
    # p = p + q: five words of four kinds give 5 * log2(4); one word gives 1 * log2(1)
    m = metrics("int add(void) { p = p + q; }\nint only(void) { r; }\n")
    assert (m["halstead_count"], m["halstead_min"], m["halstead_max"]) == (2, 0.0, 10.0)


def test_identifiers_and_indentation():
    m = metrics("int go(int xy)\n{\n    xy;\n\tabcd;\n}\n")
    assert (m["identifier_length_count"], m["unique_identifier_length_count"], m["unique_identifier_length_max"]) == (4, 3, 4.0)
    assert (m["indentation_count"], m["indentation_min"], m["indentation_max"]) == (2, 4.0, 8.0)


def test_comments_and_directives():
    code = "/* Copyright by nobody. */\n#include <q.h>\n#ifndef Q\n#endif\n/** Says what follows. */\nstatic int k;\nint f(void)\n{\n\t/* inside */\n#ifdef W\n#undef W\n#endif\n\tstatic int m;\n}\n// end\n"
    m = metrics(code)
    assert (m["n_comment"], m["n_dox"], m["n_fun_comment"], m["n_boilerplate_char"]) == (4, 1, 1, len("/* Copyright by nobody. */"))
    assert (m["n_cpp"], m["n_cpp_include"], m["n_cpp_conditional"], m["n_fun_cpp"], m["n_fun_cpp_conditional"]) == (6, 1, 2, 3, 1)
    assert m["n_internal"] == 1  # the static one outside functions


def test_inconsistency():
    m = metrics("a, b,c, d")
    style = {k[6:]: v for k, v in m.items() if k.startswith("style_")}
    assert inconsistency(style) == pytest.approx(1 / 6)  # after: two blanks, one none; before: three none


def test_described_values():
    assert describe([1, 3, 8]) == (3, 1.0, 4.0, 3.0, 8.0, pytest.approx((26 / 3) ** 0.5))
    assert describe([]) == (0, None, None, None, None, None)


def test_empty_and_long():
    assert metrics(None)["n_char"] == 0 and metrics("")["inconsistency"] is None
    assert metrics("y += 2;\n" * 4000)["line_length_count"] == 4000
