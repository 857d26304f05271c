"""Queries over source quality metrics. The C texts are written from a table, so SQL can say what their metrics must be."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.functions.csource import file_metrics, minified
from faultline.session import table

# One function a part: r ifs around an assignment, s calls, a return; both engines read the expression.
_R, _S, _C, _E = "p_size % 4", "p_size % 3", "CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END", "CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END"
_LF, _TAB = "chr(10)", "chr(9)"
C_TEXT = f"""'/* Copyright part ' || p_partkey || '. */' || {_LF} || 'static unsigned total;' || {_LF} || repeat('const void *p;' || {_LF}, {_C}) || 'int f' || p_partkey || '(int a)' || {_LF} || '{{' || {_LF}
 || repeat({_TAB} || 'if (a > 1) {{' || {_LF} || {_TAB} || {_TAB} || 'a = a + 1;' || {_LF} || {_TAB} || '}}' || {_LF}, {_R}) || repeat({_TAB} || 'call(a ,b);' || {_LF}, {_S})
 || {_TAB} || 'return a' || repeat(' ', {_E}) || ';' || {_LF} || '}}' || {_LF} || repeat({_LF} || '// end ' || {_LF}, {_E})"""


def _sources(s, d):
    return table(s, d, "part").select(F.col("p_partkey"), F.expr(C_TEXT).alias("text"))


def _metrics(*columns):
    return lambda s, d: file_metrics(_sources(s, d), "p_partkey", "text").select("p_partkey", *[F.round(c, 6).alias(c) if c.endswith(("_mean", "_sd", "_median", "_max", "_min", "inconsistency")) else F.col(c) for c in columns])


def _minify(s, d):
    """Digest of the minified text: comments and the blanks between tokens go."""
    return minified(_sources(s, d), "p_partkey", "text").select("p_partkey", F.md5("minified").alias("digest"))


QUERIES = {
    "line_stats": _metrics("n_char", "n_empty_line", "line_length_count", "line_length_max", "line_length_mean"),
    "boilerplate_chars": _metrics("n_comment", "n_comment_char", "n_boilerplate_char", "n_dox", "n_fun_comment"),
    "keyword_counts": _metrics("n_internal", "n_const", "n_void", "n_unsigned", "n_struct", "n_goto"),
    "halstead_tokens": _metrics("n_function", "halstead_count", "halstead_max"),
    "cyclomatic_paths": _metrics("cyclomatic_count", "cyclomatic_max", "statement_nesting_count", "statement_nesting_max", "statement_nesting_mean"),
    "identifier_lengths": _metrics("identifier_length_count", "identifier_length_max", "unique_identifier_length_count"),
    "style_inconsistency": _metrics("style_space_before_comma", "style_no_space_after_comma", "style_space_before_semicolon", "style_no_space_before_semicolon", "style_space_after_binary_op", "style_space_after_keyword", "style_space_at_end_of_line", "inconsistency"),
    "minified_lines": _minify,
    "c_metrics": lambda s, d: file_metrics(table(s, d, "documents").where("text IS NOT NULL").select("doc_id", "text"), "doc_id", "text"),
}
_T = f"WITH t AS (SELECT p_partkey, {_R} AS r, {_S} AS s, {_C} AS c, {_E} AS e, {C_TEXT} AS text FROM part), l AS (SELECT p_partkey, unnest(string_split(rtrim(text, chr(10)), chr(10))) AS line FROM t)"
_COPY = "length('/* Copyright part ' || p_partkey || '. */')"
_MINI = "'static unsigned total;' || chr(10) || repeat('const void*p;' || chr(10), c) || 'int f' || p_partkey || '(int a){' || chr(10) || repeat('if(a>1){' || chr(10) || 'a=a+1;' || chr(10) || '}' || chr(10), r) || repeat('call(a,b);' || chr(10), s) || 'return a;' || chr(10) || '}'"
ORACLES = {
    "line_stats": f"{_T} SELECT p_partkey, max(length(text)) + 1 AS n_char, count(*) FILTER (trim(line) = '') AS n_empty_line, count(*) AS line_length_count, max(length(line))::DOUBLE AS line_length_max, round(avg(length(line)), 6) AS line_length_mean FROM l JOIN t USING (p_partkey) GROUP BY 1",
    "boilerplate_chars": f"{_T} SELECT p_partkey, 1 + e AS n_comment, {_COPY} + e * length('// end ') AS n_comment_char, {_COPY} AS n_boilerplate_char, 0 AS n_dox, 0 AS n_fun_comment FROM t",
    "keyword_counts": f"{_T} SELECT p_partkey, 1 AS n_internal, c AS n_const, c AS n_void, 1 AS n_unsigned, 0 AS n_struct, 0 AS n_goto FROM t",
    "halstead_tokens": f"{_T} SELECT p_partkey, 1 AS n_function, 1 AS halstead_count, round((11 * r + 6 * s + 2) * log2(2 + CASE WHEN r > 0 THEN 7 ELSE 0 END + CASE WHEN s = 0 THEN 0 WHEN r > 0 THEN 3 ELSE 5 END), 6) AS halstead_max FROM t",
    "cyclomatic_paths": f"{_T} SELECT p_partkey, 1 AS cyclomatic_count, (1 + r)::DOUBLE AS cyclomatic_max, r + s + 1 AS statement_nesting_count, least(r, 1)::DOUBLE AS statement_nesting_max, round(r::DOUBLE / (r + s + 1), 6) AS statement_nesting_mean FROM t",
    "identifier_lengths": f"{_T} SELECT p_partkey, 4 + c + 3 * r + 3 * s AS identifier_length_count, greatest(5, length('f' || p_partkey))::DOUBLE AS identifier_length_max, 3 + c + CASE WHEN s > 0 THEN 2 ELSE 0 END AS unique_identifier_length_count FROM t",
    "style_inconsistency": f"{_T} SELECT p_partkey, s AS style_space_before_comma, s AS style_no_space_after_comma, e AS style_space_before_semicolon, 2 - e + c + r + s AS style_no_space_before_semicolon, 3 * r AS style_space_after_binary_op, r AS style_space_after_keyword, e AS style_space_at_end_of_line, round(e::DOUBLE / (10 * r + 4 * s + 3 + c), 6) AS inconsistency FROM t",
    "minified_lines": f"{_T} SELECT p_partkey, md5({_MINI}) AS digest FROM t",
}
