"""Text expressions over prompts and responses. Each takes and returns Columns."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

try:
    from tokenizers import Tokenizer
except ImportError:  # counting by white space needs no package
    Tokenizer = None

# Line openings that count as a verification step.
VERIFICATION_WORDS = ["approximation", "wait"]
VERIFICATION_OPENINGS = [
    "But wait",
    "Alternatively",
    "Is there another way",
    "But let me double",
    "But hold on",
]

# Prompt wrappers, with the question in place of {q}.
PROMPT_TEMPLATES = {
    "r1": (
        "A conversation between User and Assistant. The User asks a question, and the Assistant solves it. The "
        "Assistant first thinks about the reasoning process in the mind. This requires engaging in a comprehensive "
        "cycle of analysis, summarizing, exploration, reassessment, reflection, backtracing, and iteration. Then it "
        "provides the User with the answer. The reasoning process is enclosed within <think> </think> and answer is "
        "enclosed within <answer> </answer> tags, respectively, i.e., <think> reasoning process here </think> "
        "<answer> answer here </answer>.\nUser: {q}\nAssistant: "
    ),
    "qwen": (
        "<|im_start|>system\nPlease reason step by step, and put your final answer within \\boxed{}.<|im_end|>\n"
        "<|im_start|>user\n{q}<|im_end|>\n<|im_start|>assistant\n"
    ),
}


def let(value: Column, body) -> Column:
    """Bind ``value`` once for use in ``body``; keeps long chains linear in size."""
    return F.get(F.transform(F.array(value), lambda bound: body(bound)), F.lit(0))


def strip(text: Column) -> Column:
    """Remove white space at both ends, line breaks included."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def strip_think_tags(text: Column) -> Column:
    no_block = F.regexp_replace(text, r"(?s)<think>.*?</think>", "")
    return strip(F.regexp_replace(no_block, r"</?think>", ""))


def clean_wikihow_text(text: Column) -> Column:
    titled = F.replace(strip(text), F.lit(" [title]"), F.lit(". "))
    return F.replace(F.regexp_replace(titled, r"\[.*?\]", ""), F.lit("  "), F.lit(" "))


def capitalize(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substr(text, F.lit(2))))


def strip_instruction(text: Column, instruction: str) -> Column:
    return strip(F.replace(text, F.lit(instruction), F.lit("")))


def render_prompt_template(question: Column, template: str | None) -> Column:
    if template is None:
        return question
    before, after = PROMPT_TEMPLATES[template].split("{q}")
    return F.concat(F.lit(before), question, F.lit(after))


def token_length(text: Column) -> Column:
    """White-space token count; used where no tokenizer vocabulary is supplied."""
    return F.regexp_count(text, F.lit(r"\S+"))


def word_ids(text: Column, modulus: int = 50_000) -> Column:
    """Stable integer ids for white-space words (2 upwards), standing in for a vocabulary."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.transform(
        words, lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint") % modulus + 2
    )


def count_verification_steps(text: Column) -> Column:
    def is_step(line):
        hit = F.lit(False)
        for word in VERIFICATION_WORDS:
            hit = hit | F.lower(line).contains(word)
        for opening in VERIFICATION_OPENINGS:
            hit = hit | line.startswith(opening)
        return hit

    return F.size(F.filter(F.split(text, "\n"), is_step))


def repeat_count(text: Column, tail: int = 100, minimum: int = 50) -> Column:
    """How often, overlaps included, the last ``tail`` characters occur in the whole text."""
    quoted = F.replace(F.right(text, F.lit(tail)), F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    pattern = F.concat(F.lit("(?=\\Q"), quoted, F.lit("\\E)"))
    return F.when(F.length(text) < minimum, 0).otherwise(F.regexp_count(text, pattern))


def is_terminated(text: Column) -> Column:
    return text.contains("</answer>") | text.contains("\\boxed{")


def marker_offset(text: Column, marker: str = "####") -> Column:
    """Zero-based offset of the first marker; null where there is none."""
    return F.nullif(F.instr(text, marker), F.lit(0)) - 1


def contains_ci(column: Column, needle: str) -> Column:
    return F.lower(column).contains(needle.lower())


def parse_log_line(line: Column) -> Column:
    """``step:3 - critic/score/mean:0.5`` to a map of names and values."""
    return F.str_to_map(line, F.lit(" - "), F.lit(":"))


def tokenizer_length(text: Column, tokenizer_json: str) -> Column:
    """Token count by a serialised tokenizer; each Python worker loads it once and encodes whole Arrow batches."""
    if Tokenizer is None:
        raise ImportError("the tokenizers package is needed to count tokens by vocabulary")

    @F.pandas_udf("int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = Tokenizer.from_str(tokenizer_json)
        for texts in batches:
            known = texts.fillna("").tolist()
            yield pd.Series([len(e.ids) for e in tokenizer.encode_batch(known)], dtype="int32")

    return run(text)
