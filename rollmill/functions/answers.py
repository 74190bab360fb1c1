"""Finding the answer inside a response."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollmill.functions.sqltext import apply, bind, raw, trim

# Phrases around which a free-form answer is cut.
ANSWER_FOLLOWS = ["answer:", "answer is", "answers are"]
ANSWER_PRECEDES = ["is answer", "is the answer", "are answers", "are the answers"]
LAST_CUTS = ["be ", "is ", "are ", "=", ": ", "get ", "be\n", "is\n", "are\n", ":\n", "get\n"]


def extract_hash_answer(text: Column) -> Column:
    """Number after the first ``#### ``, without commas; null where there is none."""
    found = F.nullif(F.regexp_extract(text, r"#### (-?[0-9.,]+)", 1), F.lit(""))
    return F.replace(found, F.lit(","), F.lit(""))


def extract_last_number(text: Column) -> Column:
    """Last number-like token that is not a lone point; the first token if all are; commas are kept."""
    tokens = F.regexp_extract_all(text, F.lit(r"(-?[0-9.,]+)"), F.lit(1))
    usable = F.filter(tokens, lambda t: ~t.isin("", "."))
    return F.coalesce(F.try_element_at(usable, F.lit(-1)), F.get(tokens, F.lit(0)))


def _balanced_end(text: str) -> str:
    """One-based position of the brace that closes the first opened one; 0 if it never closes.

    A fold over the characters with a fixed-size state, so its cost is linear in the text.
    """
    return f"""aggregate(split({text}, ''), named_struct('at', 0, 'depth', 0, 'end', 0),
        (st, ch) -> named_struct(
            'at', st.at + 1,
            'depth', st.depth + CASE ch WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END,
            'end', CASE WHEN st.end = 0 AND ch = '}}' AND st.depth = 1 THEN st.at + 1 ELSE st.end END),
        st -> st.end)"""


def last_boxed_sql(text: str, space_form: bool = False) -> str:
    def after(command):
        tail = f"substring_index({text}, {raw(command)}, -1)"
        both = f"named_struct('tail', {tail}, 'end', {_balanced_end(tail)})"
        return bind(both, "bx", f"CASE WHEN bx.end > 0 THEN {raw(command)} || substring(bx.tail, 1, bx.end) END")

    space = raw("\\boxed ")
    spaced = f"WHEN contains({text}, {space}) THEN {space} || substring_index(substring_index({text}, {space}, -1), '$', 1)"
    box, fbox = "\\boxed", "\\fbox"
    return f"""CASE {spaced if space_form else ''}
        WHEN contains({text}, {raw(box)}) THEN {after(box)}
        WHEN contains({text}, {raw(fbox)}) THEN {after(fbox)} END"""


def extract_boxed_sql(text: str, space_form: bool = False) -> str:
    opening, spaced = raw("\\boxed{"), raw("\\boxed ")
    inner = f"WHEN startswith(b, {opening}) AND endswith(b, '}}') THEN substring(b, 8, length(b) - 8)"
    space = f"WHEN startswith(b, {spaced}) THEN substr(b, 8) WHEN contains(b, {spaced}) THEN NULL" if space_form else ""
    return bind(last_boxed_sql(text, space_form), "b", f"CASE {space} {inner} END")


def last_boxed(text: Column, space_form: bool = False) -> Column:
    r"""The last ``\boxed{...}`` with balanced braces, else the last ``\fbox{...}``, command included.

    With ``space_form``, a text holding ``\boxed `` yields that command and everything up to the next ``$``.
    """
    return apply(last_boxed_sql("arg.t", space_form), t=text)


def extract_boxed(text: Column, space_form: bool = False) -> Column:
    r"""Content of the last boxed expression; null when it is not of the form ``\boxed{...}``."""
    return apply(extract_boxed_sql("arg.t", space_form), t=text)


def extract_answer_line(text: Column) -> Column:
    """Last ``Answer: ...`` line, any case; ``[INVALID]`` where there is none."""
    lines = F.regexp_extract_all(text, F.lit(r"(?i)Answer\s*:\s*([^\n]+)"), F.lit(1))
    return F.coalesce(F.try_element_at(lines, F.lit(-1)), F.lit("[INVALID]"))


def _quoted(marker: str) -> str:
    return "".join("\\n" if c == "\n" else ("\\" + c if not c.isalnum() and c != " " else c) for c in marker)


def match_answer_phrase_sql(text: str) -> str:
    """Each cut is one greedy replacement, so the last occurrence of a phrase decides."""

    def state(hit, value):
        return f"named_struct('hit', {hit}, 'text', {value})"

    def cut_after(m):
        return f"regexp_replace(s.text, {raw(rf'(?is)^.*{_quoted(m)}\s*(.*?)\s*$')}, '$1')"

    def cut_before(m):
        return f"regexp_replace(s.text, {raw(rf'(?is)^\s*(.*?)\s*{_quoted(m)}((?!{_quoted(m)}).)*$')}, '$1')"

    def found(m):
        return f"s.hit OR contains(lower(s.text), {raw(m)})"

    now = state("false", text)
    for m in ANSWER_FOLLOWS:
        now = bind(now, "s", state(found(m), cut_after(m)))
    for m in ANSWER_PRECEDES:
        now = bind(now, "s", state(found(m), cut_before(m)))
    boxed = bind(now, "s", f"named_struct('hit', s.hit, 'text', s.text, 'box', {last_boxed_sql('s.text')})")
    now = bind(boxed, "s", state("s.hit OR s.box IS NOT NULL", "coalesce(s.box, s.text)"))
    head = "substring(s.text, 1, length(s.text) - length(substring_index(s.text, '. ', -1)) - 2)"
    now = bind(now, "s", state("s.hit", f"CASE WHEN contains(s.text, '. ') THEN {trim(head)} ELSE s.text END"))
    for m in LAST_CUTS:
        now = bind(now, "s", state(found(m), cut_after(m)))
    return bind(now, "s", "named_struct('matched', s.hit AND s.text RLIKE '[0-9]', 'answer', s.text)")


def match_answer_phrase(text: Column) -> Column:
    """Struct (matched, answer): the free-form answer left after cutting at the usual phrases."""
    return apply(match_answer_phrase_sql("arg.t"), t=text)
