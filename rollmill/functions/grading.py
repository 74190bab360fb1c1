"""Scoring responses against ground truth, as Columns over a table of responses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollmill.functions.answers import (
    extract_answer_line,
    extract_boxed_sql,
    extract_hash_answer,
    extract_last_number,
    match_answer_phrase_sql,
)
from rollmill.functions.normalize import (
    final_answer_sql,
    math_equal_sql,
    number_commas_sql,
    number_sql,
    symbolic_sql,
    whole_sql,
)
from rollmill.functions.sqltext import apply, bind, raw, regex, swap, trim

# Which data sources each grading rule serves.
HASH_SOURCES = ["openai/gsm8k"]
BOXED_SOURCES = ["lighteval/MATH", "DigitalLearningGmbH/MATH-lighteval", "HuggingFaceH4/MATH-500"]
MINERVA_SOURCES = ["math_dapo"]
MINERVA_PREFIX = "aime"
PHRASE_SOURCES = [
    "numina_aops_forum", "numina_synthetic_math", "numina_amc_aime", "numina_synthetic_amc", "numina_cn_k12",
    "numina_olympiads",
]
CODE_SOURCES = ["codecontests", "apps", "codeforces", "taco"]
GEOMETRY_SOURCES = ["hiyouga/geometry3k"]

FRACTION = r"^-?[0-9]+.?/0*[1-9][0-9]*.?$"


def grade_exact(
    response: Column, truth: Column, method: str = "strict", format_score: float = 0.0, score: float = 1.0
) -> Column:
    """0 without an answer, ``score`` when it equals the truth, ``format_score`` otherwise."""
    answer = extract_hash_answer(response) if method == "strict" else extract_last_number(response)
    return (
        F.when(answer.isNull(), 0.0).when(answer == truth.cast("string"), F.lit(score)).otherwise(F.lit(format_score))
    ).cast("double")


def grade_boxed_equiv(response: Column, truth: Column) -> Column:
    """1 when the boxed answer equals the truth in canonical form."""
    right = f"a IS NOT NULL AND {math_equal_sql('a', 'arg.t')}"
    return apply(bind(extract_boxed_sql("arg.r", space_form=True), "a", f"CASE WHEN {right} THEN 1D ELSE 0D END"), r=response, t=truth)


def grade_minerva(response: Column, truth: Column, window: int = 300, *, boxed_truth: bool = False, strict_box: bool = False) -> Column:
    """Struct (score, acc, pred); the rule looks for the answer line in the closing ``window`` characters.

    boxed_truth: the truth is the content of its last box; a truth without a box is never met. strict_box: the strict box rule
    decides instead, within the same closing characters, and compares with the truth as it stands.
    """
    closing = F.right(response, F.lit(window))
    if strict_box:
        told = grade_strict_box(closing, truth)
        return F.struct(told["score"].alias("score"), (told["score"] > 0).alias("acc"), told["pred"].alias("pred"))
    wanted = bind(extract_boxed_sql("arg.t"), "tb", final_answer_sql("tb")) if boxed_truth else final_answer_sql("arg.t")
    both = f"named_struct('pred', {final_answer_sql('arg.line')}, 'truth', {wanted})"
    right = "coalesce(n.pred = n.truth, false)" if boxed_truth else "n.pred = n.truth"
    graded = f"""named_struct('score', CASE WHEN n.pred = n.truth THEN 1D ELSE -1D END, 'acc', {right}, 'pred', n.pred)"""
    return apply(bind(both, "n", graded), line=extract_answer_line(closing), t=truth)


def grade_strict_box(response: Column, truth: Column, window: int = 100) -> Column:
    """Struct (score, pred): the boxed answer of the closing ``window`` characters must equal the truth exactly."""
    graded = "named_struct('score', CASE WHEN a <=> arg.t THEN 1D ELSE -1D END, 'pred', a)"
    return apply(bind(extract_boxed_sql("arg.r"), "a", graded), r=F.right(response, F.lit(window)), t=truth)


def _elements(t: str) -> str:
    """Members of a tuple or interval, or the text alone."""
    return bind(number_commas_sql(t), "el", f"""CASE WHEN length(el) = 0 THEN cast(array() AS array<string>)
        WHEN length(el) > 2 AND el RLIKE {raw(r'(?s)^[()\[\]].*[()\[\]]$')} AND NOT substring(el, 2, length(el) - 2) RLIKE {raw(r'[()\[\]]')}
        THEN transform(split(substring(el, 2, length(el) - 2), ','), x -> {trim('x')}) ELSE array(el) END""")


def tuple_sql(given: str, truth: str) -> str:
    fraction = raw(FRACTION)
    whole = {x: whole_sql(number_commas_sql(x)) for x in ("tm", "gm")}
    same = f"""CASE WHEN tm RLIKE {fraction} AND gm RLIKE {fraction} THEN tm = gm
        WHEN {whole['tm']} <> {whole['gm']} THEN false
        ELSE tm = gm OR coalesce({number_sql('tm')} = {number_sql('gm')}, false) END"""
    members = f"named_struct('g', n.g, 't', n.t, 'gs', {_elements('n.g')}, 'ts', {_elements('n.t')})"
    decide = f"""CASE WHEN m.t IS NULL OR m.g IS NULL OR length(m.g) = 0 THEN false
        WHEN size(m.ts) > 1 AND (left(m.g, 1) <> left(m.t, 1) OR right(m.g, 1) <> right(m.t, 1)) THEN false
        WHEN size(m.ts) <> size(m.gs) THEN false
        ELSE forall(zip_with(m.ts, m.gs, (tm, gm) -> {same}), ok -> ok) END"""
    normal = f"named_struct('g', {symbolic_sql(given)}, 't', {symbolic_sql(truth)})"
    differing = bind(normal, "n", f"CASE WHEN n.g = n.t THEN true ELSE {bind(members, 'm', decide)} END")
    return f"CASE WHEN {given} = {truth} THEN true ELSE {differing} END"


def grade_tuple(given: Column, truth: Column) -> Column:
    """Normalised equality, member by member for tuples and intervals; brackets and member count must agree."""
    return apply(tuple_sql("arg.g", "arg.t"), g=given, t=truth)


def grade_curriculum(
    response: Column, truths: Column, think_end: str = "</think>", only_after_think: bool = False
) -> Column:
    """1 when the boxed answer equals any of several truths; 0 without the closing think tag.

    By default the whole response is searched for the answer; ``only_after_think`` restricts it to the part
    behind the first closing tag.
    """
    box = raw("\\boxed")
    usable = f"filter(transform(arg.ts, y -> CASE WHEN contains(y, {box}) THEN {extract_boxed_sql('y')} ELSE y END), y -> y IS NOT NULL)"
    any_equal = f"exists({usable}, y -> {math_equal_sql('a', 'y')} OR {tuple_sql('a', 'y')})"
    searched = f"get(split(arg.r, {raw(think_end)}), 1)" if only_after_think else "arg.r"
    graded = bind(extract_boxed_sql(searched), "a", f"CASE WHEN a IS NOT NULL AND {any_equal} THEN 1D ELSE 0D END")
    return apply(f"CASE WHEN contains(arg.r, {raw(think_end)}) THEN {graded} ELSE 0D END", r=response, ts=truths)


def numeric_sql(pred: str, truth: str, tolerance: float) -> str:
    def bare(x):
        """Without a leading dollar sign on a number, or a trailing percent sign after one."""
        return regex(x, (r"^\$(?=[0-9])", ""), (r"^([0-9]+(\.[0-9]+)?)\\?%$", "$1"))

    def scalar(p, t):
        """String tier, then number tier: within tolerance of the truth, its hundredth or its hundredfold."""
        numbers = f"named_struct('p', {number_sql(swap(p, [('{,}', ''), (',', '')]))}, 't', {number_sql(swap(t, [('{,}', ''), (',', '')]))})"
        close = f"exists(array(nm.t / 100, nm.t, nm.t * 100), c -> abs(nm.p - c) <= {tolerance}D * greatest(abs(nm.p), abs(c)))"
        loose = lambda x: regex(trim(x), (r"[{}()]", ""))
        return f"""CASE WHEN lower({trim(p)}) = lower({trim(t)}) OR replace({p}, ' ', '') = replace({t}, ' ', '') THEN true
            ELSE {bind(numbers, 'nm', f"CASE WHEN nm.p IS NOT NULL AND nm.t IS NOT NULL THEN {close} WHEN length({p}) = 0 THEN false ELSE {loose(p)} = {loose(t)} END")} END"""

    def pairwise(a, b):
        each = bind(f"named_struct('p', {bare(trim('pa'))}, 't', {bare(trim('pb'))})", "pr", scalar("pr.p", "pr.t"))
        return f"""(size(split({a}, ',')) = size(split({b}, ',')) AND
            forall(zip_with(split({a}, ','), split({b}, ','), (pa, pb) -> {each}), ok -> coalesce(ok, false)))"""

    ends = lambda x: regex(x, (r"^[\[\]()]+|[\[\]()]+$", ""), (r"[{}()]", ""))
    inner = lambda x: f"substring({x}, 2, length({x}) - 2)"
    square = rf"k.p RLIKE {raw(r'(?s)^\[.*\]$')} AND NOT startswith(k.t, '(')"
    rounded = rf"k.p RLIKE {raw(r'(?s)^\(.*\)$')} AND NOT startswith(k.t, '[')"
    bracketed = rf"k.p RLIKE {raw(r'(?s)^[(\[].*[)\]]$')} AND left(k.p, 1) = left(k.t, 1) AND right(k.p, 1) = right(k.t, 1)"
    decide = f"""{scalar('k.p', 'k.t')} OR (({square} OR {rounded}) AND {ends('k.p')} = {ends('k.t')})
        OR ({bracketed} AND {pairwise(inner('k.p'), inner('k.t'))})
        OR (contains(k.p, ',') AND contains(k.t, ',') AND {pairwise('k.p', 'k.t')})"""
    both = f"named_struct('p', {bare(trim(pred))}, 't', {bare(trim(truth))})"
    return f"coalesce({bind(both, 'k', decide)}, false)"


def grade_numeric_tolerance(pred: Column, truth: Column, tolerance: float = 1e-4) -> Column:
    """Equal as text, as numbers within ``tolerance``, or member by member for intervals and comma lists."""
    return apply(numeric_sql("arg.p", "arg.t", tolerance), p=pred, t=truth)


def grade_answer_phrase(response: Column, truth: Column, tolerance: float = 1e-4) -> Column:
    """1 when the phrase-cut answer equals the truth within tolerance or as a tuple."""
    answer = bind(match_answer_phrase_sql("arg.r"), "mt", f"CASE WHEN mt.matched THEN coalesce({extract_boxed_sql('mt.answer')}, mt.answer) END")
    right = f"a IS NOT NULL AND ({tuple_sql('a', 'arg.t')} OR {numeric_sql('a', 'arg.t', tolerance)})"
    return apply(bind(answer, "a", f"CASE WHEN {right} THEN 1D ELSE 0D END"), r=response, t=truth)


def grade_format_think_boxed(response: Column, truth: Column) -> Column:
    """0.9 for a right boxed answer plus 0.1 for the think-then-boxed format."""
    fmt = F.when(response.rlike(r"(?s)^<think>.*</think>.*\\boxed\{.*\}.*\z"), 1.0).otherwise(0.0)
    right = f"a IS NOT NULL AND ({math_equal_sql('a', 'arg.t')} OR {tuple_sql('a', 'arg.t')})"
    acc = apply(bind(extract_boxed_sql("arg.r"), "a", f"CASE WHEN {right} THEN 1D ELSE 0D END"), r=response, t=truth)
    return 0.9 * acc + 0.1 * fmt


def grade_dispatch(source: Column, response: Column, truth: Column, tests: Column | None = None) -> Column:
    """Route each row to the rule of its data source; an unknown source is an error.

    Only the branch that applies is evaluated, so rows pay for their own rule alone. ``tests`` is the share of test cases that a
    row's program passed, found elsewhere (see ``grade_with_tests``); sources of code take it, and 0 where it is null. Without
    ``tests`` they count as unknown: nothing is run here.
    """
    code = source.isin(CODE_SOURCES) if tests is not None else F.lit(False)
    passed = F.coalesce(tests, F.lit(0.0)) if tests is not None else F.lit(None).cast("double")
    return (
        F.when(source.isin(HASH_SOURCES), grade_exact(response, truth))
        .when(source.isin(BOXED_SOURCES), grade_boxed_equiv(response, truth))
        .when(source.isin(MINERVA_SOURCES) | source.startswith(MINERVA_PREFIX), grade_minerva(response, truth)["score"])
        .when(source.isin(PHRASE_SOURCES), grade_answer_phrase(response, truth))
        .when(code, passed)
        .when(source.isin(GEOMETRY_SOURCES), grade_format_think_boxed(response, truth))
        .otherwise(F.raise_error(F.concat(F.lit("no grading rule for data source "), source)).cast("double"))
    )


def overlong_penalty(length: Column, max_length: int, buffer: int, factor: float) -> Column:
    """Linear penalty once a response enters the last ``buffer`` tokens; never positive."""
    exceed = length - F.lit(max_length - buffer)
    return F.least(-exceed / F.lit(float(buffer)) * F.lit(factor), F.lit(0.0))
