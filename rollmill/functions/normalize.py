"""Bringing answers into a comparable form. All rules run inside Spark as replacement chains."""

from __future__ import annotations

from pyspark.sql import Column

from rollmill.functions.sqltext import apply, bind, raw, regex, swap, trim

# Replacements applied, in this order, to a final answer.
ANSWER_SUBSTITUTIONS = [
    ("an ", ""), ("a ", ""), (".$", "$"), ("\\$", ""), ("\\ ", ""), (" ", ""), ("mbox", "text"),
    (",\\text{and}", ","), ("\\text{and}", ","), ("\\text{m}", "\\text{}"),
]

# Expressions removed, in this order, from a final answer.
ANSWER_REMOVALS = [
    "square", "ways", "integers", "dollars", "mph", "inches", "hours", "km", "units", "\\ldots", "sue", "points",
    "feet", "minutes", "digits", "cents", "degrees", "cm", "gm", "pounds", "meters", "meals", "edges", "students",
    "childrentickets", "multiples", "\\text{s}", "\\text{.}", "\\text{\ns}", "\\text{}^2", "\\text{}^3",
    "\\text{\n}", "\\text{}", "\\mathrm{th}", "^\\circ", "^{\\circ}", "\\;", ",\\!", "{,}", '"', "\\dots",
]

# Replacements applied, in this order, to a LaTeX answer.
LATEX_REPLACEMENTS = [
    ("\n", ""), ("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\left", ""), ("\\right", ""),
    ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", ""),
]

# Units, then magnitudes, dropped or spelled out in a symbolic answer.
UNITS = [
    "degree", "cm", "centimeter", "meter", "mile", "second", "minute", "hour", "day", "week", "month", "year",
    "foot", "feet", "inch", "yard",
]
MAGNITUDES = [("million", "*10^6"), ("billion", "*10^9"), ("trillion", "*10^12")]

# Forms that normalisation would leave as they are.
PLAIN_NUMBER = r"^-?[0-9]+(\.[0-9]+)?$"
PLAIN_WHOLE = r"^(0|-?[1-9][0-9]{0,14})$"

FLOAT = r"^\s*[+-]?([0-9]+(_[0-9]+)*\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def number_sql(t: str) -> str:
    """Double where the text is a plain number, else null."""
    return f"CASE WHEN {t} RLIKE {raw(FLOAT)} THEN try_cast(replace({trim(t)}, '_', '') AS double) END"


def whole_sql(t: str) -> str:
    """Whether the text is a number within 1e-7 of a whole one."""
    return bind(number_sql(t), "n", "coalesce(abs(n - rint(n)) <= 1e-7, false)")


def _whole_text(t: str) -> str:
    return f"coalesce(cast(try_cast(rint({number_sql(t)}) AS decimal(38, 0)) AS string), {t})"


def number_commas_sql(t: str) -> str:
    """Without thousands separators. Three passes reach the fixed point: a pass may only skip neighbours."""
    return regex(t, *[(r"([0-9]),([0-9]{3})($|[^0-9])", "$1$2$3")] * 3)


def _fix_fractions(t: str) -> str:
    r"""``\frac12`` to ``\frac{1}{2}``. Null if a ``\frac`` has nothing after it; unchanged if it has one character."""
    command = raw("\\frac")
    brace = """CASE WHEN left(p, 1) = '{' THEN p
        WHEN substring(p, 2, 1) = '{' THEN '{' || left(p, 1) || '}' || substr(p, 2)
        ELSE '{' || left(p, 1) || '}{' || substring(p, 2, 1) || '}' || substr(p, 3) END"""
    parts = f"split({t}, {raw('[' + chr(92) * 2 + ']frac')})"
    found = f"""named_struct('all', ps, 'tail', slice(ps, 2, size(ps)),
        'empty', array_position(slice(ps, 2, size(ps)), ''),
        'short', array_position(transform(slice(ps, 2, size(ps)), p -> length(p) = 1 AND p <> '{{'), true))"""
    fixed = f"array_join(concat(slice(f.all, 1, 1), transform(f.tail, p -> {brace})), {command})"
    rebuilt = bind(parts, "ps", bind(found, "f", f"""CASE
        WHEN f.empty > 0 AND (f.short = 0 OR f.empty < f.short) THEN NULL
        WHEN f.short > 0 THEN array_join(f.all, {command}) ELSE {fixed} END"""))
    return f"CASE WHEN contains({t}, {command}) THEN {rebuilt} ELSE {t} END"


def _fix_slash(t: str) -> str:
    r"""``a/b`` of whole numbers to ``\frac{a}{b}``; null if a single slash joins something else."""
    number, plain = r"[+-]?[0-9]+(_[0-9]+)*", r"(0|-?[1-9][0-9]*)"
    return f"""CASE WHEN length({t}) - length(replace({t}, '/', '')) <> 1 THEN {t}
        WHEN {t} RLIKE {raw(f'^{plain}/{plain}$')} THEN {regex(t, (f'^{plain}/{plain}$', r'\\frac{$1}{$2}'))}
        WHEN {t} RLIKE {raw(f'^{number}/{number}$')} THEN {t} END"""


def math_string_sql(t: str) -> str:
    """LaTeX answer in canonical form; null where the rules do not apply to the text."""
    unit = raw("\\text{ ")
    t = swap(t, LATEX_REPLACEMENTS)
    t = bind(t, "u", f"""CASE WHEN NOT contains(u, {unit}) THEN u
        WHEN length(u) - length(replace(u, {unit}, '')) = 7 THEN substring_index(u, {unit}, 1) END""")
    t = regex(swap(t, [("\\%", ""), (" .", " 0."), ("{.", "{0.")]), (r"^\.", "0."))
    t = bind(t, "e", """CASE WHEN length(e) - length(replace(e, '=', '')) = 1 AND length(substring_index(e, '=', 1)) <= 2
        THEN substring_index(e, '=', -1) ELSE e END""")
    t = bind(t, "r", f"CASE WHEN r RLIKE {raw(r'\\sqrt(\\sqrt|$)')} THEN NULL ELSE {regex('r', (r'\\sqrt([^{])', r'\\sqrt{$1}'))} END")
    t = bind(swap(t, [(" ", "")]), "q", _fix_fractions("q"))
    t = bind(t, "h", f"CASE WHEN h = '0.5' THEN {raw(chr(92) + 'frac{1}{2}')} ELSE h END")
    return bind(t, "d", _fix_slash("d"))


def math_equal_sql(a: str, b: str) -> str:
    """Both null: equal. One null: not. Otherwise the canonical forms decide, or the raw texts where one has none.

    Equal raw texts are equal either way, so only differing ones are normalised.
    """
    return f"""CASE WHEN {a} <=> {b} THEN true WHEN {a} IS NULL OR {b} IS NULL THEN false
        ELSE coalesce({math_string_sql(a)} = {math_string_sql(b)}, false) END"""


def final_answer_sql(t: str) -> str:
    """Quantitative answer without units, wrappers, shorthand LaTeX and separators; plain numbers are left alone."""
    c = swap(f"substring_index({t}, '=', -1)", ANSWER_SUBSTITUTIONS)
    c = swap(c, [(e, "") for e in ANSWER_REMOVALS])
    c = regex(
        c, (r"(?d)(.*?)(\$)(.*?)(\$)(.*)", r"\$$3\$"),
        *[(rf"(?d)\\{w}\{{(.*?)\}}", "$1") for w in ("text", "textbf", "overline")],
        (r"(?d)\\boxed\{(.*)\}", "$1"), (r"(?d)frac([^{])(.)", "frac{$1}{$2}"), (r"sqrt([^{])", "sqrt{$1}"),
    )
    c = bind(swap(c, [("$", "")]), "z", "CASE WHEN z RLIKE '^[0-9,]*[0-9][0-9,]*$' THEN replace(z, ',', '') ELSE z END")
    return f"CASE WHEN {t} RLIKE {raw(PLAIN_NUMBER)} THEN {t} ELSE {trim(c)} END"


def symbolic_sql(t: str) -> str:
    """String form of a symbolic answer: units, separators, magnitudes, braces and case removed."""
    c = regex(t, (r"^\\text\{(.+?)\}$", "$1"))
    c = swap(c, [("\\%", "%"), ("\\$", "$"), ("$", ""), ("%", ""), (" or ", " , "), (" and ", " , "), *MAGNITUDES])
    c = regex(
        c, *[(rf"{unit}(es)?(s)? *(\^[0-9]+)?", "") for unit in UNITS], (r"\^ *\\circ", ""), (r"(?s)^\{(.*)\}$", "$1"),
        (r",\\! *", ""),
    )
    c = bind(c, "w", f"CASE WHEN {whole_sql('w')} THEN {_whole_text('w')} ELSE w END")
    c = regex(c, ("- *", "-"), ("([0-9]) +([0-9])", "$1+$2"))
    c = f"lower({swap(c, [(' ', ''), ('{', ''), ('}', '')])})"
    bare = "coalesce(cast(try_cast(rint(try_cast(replace(v, ',', '') AS double)) AS decimal(38, 0)) AS string), v)"
    c = bind(c, "v", f"CASE WHEN {whole_sql(number_commas_sql('v'))} THEN {bare} ELSE v END")
    return f"CASE WHEN {t} RLIKE {raw(PLAIN_WHOLE)} THEN {t} ELSE {c} END"


def normalize_math_string(text: Column) -> Column:
    return apply(math_string_sql("arg.t"), t=text)


def math_strings_equal(a: Column, b: Column) -> Column:
    return apply(math_equal_sql("arg.a", "arg.b"), a=a, b=b)


def normalize_final_answer(text: Column) -> Column:
    return apply(final_answer_sql("arg.t"), t=text)


def normalize_symbolic(text: Column) -> Column:
    return apply(symbolic_sql("arg.t"), t=text)
