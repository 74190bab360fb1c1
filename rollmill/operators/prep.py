"""Building prompt, conversation and preference tables from raw data; augmentation, filters and encodings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollmill.functions.answers import extract_hash_answer
from rollmill.functions.text import capitalize, clean_wikihow_text, contains_ci, let
from rollmill.functions.tokens import pad_truncate
from rollmill.operators.keyed import HOT_ROWS, attach_group_stats, hash_pick, positions, running_sum, scalars

# Instructions appended to questions.
HASH_INSTRUCTION = "Let's think step by step and output the final answer after \"####\"."
BOXED_INSTRUCTION = "Let's think step by step and output the final answer within \\boxed{}."
THINK_INSTRUCTION = (
    "You FIRST think about the reasoning process as an internal monologue and then provide the final answer. "
    "The reasoning process MUST BE enclosed within <think> </think> tags. "
    "The final answer MUST BE put in \\boxed{}."
)

# Sentences put in front of a question; none holds a numeral.
TRIVIA = [
    "Water freezes at zero degrees.", "The sky often appears blue.", "Honey never spoils.",
    "Bananas are technically berries.", "Octopuses have three hearts.", "Sharks existed before trees.",
    "Sound travels faster in water.", "A group of crows is called a murder.", "Penguins propose with pebbles.",
    "Sloths can hold their breath long.", "Cats cannot taste sweetness.", "Wombats produce cube-shaped droppings.",
    "Lightning is hotter than the sun's surface.", "Glass is technically a slow liquid.",
    "Butterflies taste with their feet.", "Owls cannot move their eyeballs.", "Bees can recognize human faces.",
    "Sea otters hold hands while sleeping.", "Some turtles breathe through their cloaca.",
    "Dolphins have names for each other.",
]

# Meaningless letter groups put in front of a question.
GIBBERISH = [
    "zqwp mnvrt bjklx", "ghfd slyut cmprv", "xkdb nwjef tlqyr", "vbmps cjrtx ghwly", "qwrtp nzlfk ydjxv",
    "bsnvm pgkrt fxzqh", "mjdcl tkwrv ypnqx", "lhvbg drcsf xzmkp", "trjwp nylcd vqkbx", "fmgzs bntjw qlxrv",
    "pdkcl smjrv ywtqb", "gxvlt bcnwm rjqsf", "hskdb pzfrt vylcx", "nwjqb mlgtx drcpv", "xzmbl kwjfr tncvq",
    "sldbp ytkrv gmqxj", "cfnwm rjdlt vbkps", "qlxzc hmjfw ntrbg", "yvkpd sncbx gljrt", "tmqwf xvlbn pdkrc",
]


def user_prompt(content: Column) -> Column:
    return F.array(F.struct(F.lit("user").alias("role"), content.alias("content")))


def prompt_row(
    *, data_source: str, content: Column, ability: str, style: str, ground_truth: Column, split: Column, index: Column,
    level: Column | None = None, answer: Column | None = None, question: Column | None = None,
) -> list[Column]:
    """The columns of a canonical prompt row."""
    none = F.lit(None).cast("string")
    return [
        F.lit(data_source).alias("data_source"), user_prompt(content).alias("prompt"), F.lit(ability).alias("ability"),
        (level if level is not None else F.lit("unknown")).alias("level"),
        F.struct(F.lit(style).alias("style"), ground_truth.alias("ground_truth")).alias("reward_model"),
        F.struct(
            split.alias("split"), index.cast("bigint").alias("index"),
            (answer if answer is not None else none).alias("answer"),
            (question if question is not None else none).alias("question"),
        ).alias("extra_info"),
    ]


def build_prompt_rows(
    df: DataFrame, question: str, answer: str, index: str, *, data_source: str, split: str, instruction: str = HASH_INSTRUCTION,
    extract=extract_hash_answer, passthrough: Sequence[str] = (),
) -> DataFrame:
    """Questions and worked answers to prompt rows; an answer without a final result fails the job.

    ``passthrough`` carries further columns along, such as images.
    """
    q, a = F.col(question), F.col(answer)
    truth = F.coalesce(extract(a), F.raise_error(F.concat(F.lit("no final answer in: "), a)).cast("string"))
    return df.select(
        *prompt_row(
            data_source=data_source, content=F.concat_ws(" ", q, F.lit(instruction)), ability="math", style="rule",
            ground_truth=truth, split=F.lit(split), index=F.col(index), answer=a, question=q,
        ),
        *passthrough,
    )


def build_multiple_choice_rows(
    df: DataFrame, *, activity: str, ctx_a: str, ctx_b: str, endings: str, label: str, index: str, split: str
) -> DataFrame:
    """Sentence-completion rows: cleaned query and choices, gold choice as truth; unlabelled rows are dropped."""
    context = F.concat_ws(" ", F.col(ctx_a), capitalize(F.col(ctx_b)))
    query = clean_wikihow_text(F.concat_ws(": ", F.col(activity), context))
    kept = df.where(F.length(label) > 0)
    return kept.select(
        F.lit("Rowan/hellaswag").alias("data_source"), user_prompt(query).alias("prompt"), F.lit("nlp").alias("ability"),
        F.struct(
            F.lit("model").alias("style"), F.lit("multiple_choice").alias("eval"),
            F.col(label).cast("int").cast("string").alias("ground_truth"),
            F.transform(endings, clean_wikihow_text).alias("choices"),
        ).alias("reward_model"),
        F.struct(F.lit(split).alias("split"), F.col(index).cast("bigint").alias("index")).alias("extra_info"),
    )


def build_sft_from_preference(df: DataFrame, key: str, prompt: str, chosen: str, rejected: str) -> DataFrame:
    """One row per chosen and per rejected response."""
    both = F.array(
        F.struct(F.lit("chosen").alias("side"), F.col(chosen).alias("response")),
        F.struct(F.lit("rejected").alias("side"), F.col(rejected).alias("response")),
    )
    return df.select(key, F.col(prompt).alias("prompt"), F.inline(both))


def build_rm_dataset(df: DataFrame, key: str, share: float = 0.75) -> DataFrame:
    """The first ``share`` of the rows in key order is the training split, the rest the test split."""
    n = scalars(df, F.count(F.lit(1)).alias("n"))["n"]
    numbered = positions(df, key).withColumn("_n", n)
    return numbered.withColumn(
        "split", F.when(F.col("pos") < F.floor(F.col("_n") * F.lit(share)), "train").otherwise("test")
    ).drop("_n")


def build_rl_from_preference(df: DataFrame, prompt: str, chosen: str, index: str, split: str = "train") -> DataFrame:
    """Prompt rows scored by a model; the chosen response is kept as truth."""
    return df.select(
        *prompt_row(
            data_source="Dahoas/full-hh-rlhf", content=F.col(prompt), ability="alignment", style="model",
            ground_truth=F.col(chosen), split=F.lit(split), index=F.col(index),
        )
    )


def build_conversation_messages(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """One row per conversation with its messages in turn order, however many there are."""
    ordered = F.array_sort(F.collect_list(F.struct(turn, role, text)))
    return df.groupBy(conv).agg(ordered.alias("messages"))


def pick_pad(key: Column, pool: Sequence[str], seed: int) -> Column:
    """A uniform seeded choice from a small pool held as a literal."""
    return F.get(F.array(*[F.lit(p) for p in pool]), hash_pick(key, str(seed), len(pool)))


def augment_mixed(df: DataFrame, key: str, index: str, question: str, pool: Sequence[str], seed: int) -> DataFrame:
    """The originals plus one padded clone each; clones continue the index after the originals."""
    n = scalars(df, F.count(F.lit(1)).alias("n"))["n"]
    padded = F.concat_ws(" ", pick_pad(F.col(key), pool, seed), F.col(question))
    versions = F.array(
        F.struct(F.lit(False).alias("is_clone"), F.col(question).alias("_q"), F.col(index).alias("_i")),
        F.struct(F.lit(True).alias("is_clone"), padded.alias("_q"), (F.col(index) + F.col("_n")).alias("_i")),
    )
    rest = [c for c in df.columns if c not in (question, index)]
    out = df.withColumn("_n", n).select(*rest, F.inline(versions))
    return out.withColumnsRenamed({"_q": question, "_i": index})


def augment_replace(df: DataFrame, key: str, index: str, question: str, pool: Sequence[str], seed: int) -> DataFrame:
    """Same size: every tenth row stays, the others are padded."""
    padded = F.concat_ws(" ", pick_pad(F.col(key), pool, seed), F.col(question))
    return df.withColumn(question, F.when(F.pmod(index, F.lit(10)) == 0, F.col(question)).otherwise(padded))


def augment_clones_only(df: DataFrame, key: str, index: str, question: str, pool: Sequence[str], seed: int) -> DataFrame:
    """Only padded clones, with an index that restarts at 0 in key order."""
    padded = F.concat_ws(" ", pick_pad(F.col(key), pool, seed), F.col(question))
    return positions(df.drop(index), key, index).withColumn(question, padded)


def reindex_subset(df: DataFrame, index: str) -> DataFrame:
    """Renumber a subset 0..n-1 in the order of its old index, kept as ``old_index``."""
    return positions(df.withColumnRenamed(index, "old_index"), "old_index", index)


def first_present(df: DataFrame, candidates: Sequence[str]) -> str:
    """The first of several column names that the table has."""
    for c in candidates:
        if c in df.columns:
            return c
    raise KeyError(f"none of {list(candidates)} is among {df.columns}")


def filter_contains_ci(df: DataFrame, candidates: Sequence[str], needle: str) -> DataFrame:
    return df.where(contains_ci(F.col(first_present(df, candidates)), needle))


def filter_subset_level(df: DataFrame, subset: str, level: str = "level") -> DataFrame:
    """``level5`` keeps rows whose level names 5; a table without levels, and the other subsets, stay whole."""
    if subset not in ("all", "500", "level5"):
        raise ValueError(f"unknown subset {subset!r}")
    return df.where(F.col(level).cast("string").contains("5")) if subset == "level5" and level in df.columns else df


def filter_common_steps(df: DataFrame, run: str, step: str) -> DataFrame:
    """Cut every run at the last step that all runs have reached."""
    last = df.groupBy(run).agg(F.max(step).alias("_last")).agg(F.min("_last")).scalar()
    return df.where(F.col(step) <= last)


def filter_nonzero_variance_groups(df: DataFrame, keys: Sequence[str], score: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Drop groups whose scores are all equal."""
    g = attach_group_stats(df, keys, F.min(score).alias("_lo"), F.max(score).alias("_hi"), hot_rows=hot_rows)
    return g.where("_lo <> _hi").select(*df.columns)


def preference_pair_encode(
    df: DataFrame, key: str, prompt_ids: Column, chosen_ids: Column, rejected_ids: Column, *, eos: int, max_length: int
) -> DataFrame:
    """Two rows per pair: prompt and response ids closed by the end token, padded or cut on the right, with mask."""

    def encode(side, ids):
        joined = F.concat(prompt_ids, ids, F.array(F.lit(eos).cast("bigint")))
        return let(
            joined,
            lambda x: F.struct(
                F.lit(side).alias("side"), pad_truncate(x, max_length, 0, truncation="right").alias("input_ids"),
                F.transform(
                    F.sequence(F.lit(1), F.lit(max_length)), lambda i: (i <= F.size(x)).cast("int")
                ).alias("attention_mask"),
            ),
        )

    return df.select(key, F.inline(F.array(encode("chosen", chosen_ids), encode("rejected", rejected_ids))))


def concat_prompt_response(
    prompt_ids: Column, response_ids: Column, *, prompt_length: int, response_length: int, pad: int
) -> Column:
    """Struct (input_ids, attention_mask, position_ids): prompt padded on the left, response on the right.

    The mask has no holes, so positions follow from the number of prompt tokens; they go on counting through
    the right padding.
    """
    places = F.sequence(F.lit(1), F.lit(prompt_length + response_length))

    def build(s):
        start = F.lit(prompt_length) - F.least(F.size(s["prompt"]), F.lit(prompt_length))
        end = F.lit(prompt_length) + F.least(F.size(s["response"]), F.lit(response_length))
        return F.struct(
            F.concat(
                pad_truncate(s["prompt"], prompt_length, pad, left_pad=True, truncation="left"),
                pad_truncate(s["response"], response_length, pad, truncation="right"),
            ).alias("input_ids"),
            F.transform(places, lambda i: ((i > start) & (i <= end)).cast("int")).alias("attention_mask"),
            F.transform(places, lambda i: F.greatest(i - start - 1, F.lit(0))).alias("position_ids"),
        )

    return let(F.struct(prompt_ids.alias("prompt"), response_ids.alias("response")), build)


def multiturn_masks(
    df: DataFrame, conv: str, turn: str, role: str, n_tokens: str, max_length: int, truncation: str = "right"
) -> DataFrame:
    """Loss mask (1 on assistant tokens) and position ids per conversation, padded or cut to ``max_length``.

    Running token counts tell which turns reach into the kept window, so at most ``max_length`` turns of a
    conversation are gathered, however long it is. A conversation without tokens gets a mask of zeros.
    """
    if truncation not in ("left", "right"):
        raise ValueError(f"unknown truncation {truncation!r}")
    spoken = df.where(F.col(n_tokens) > 0).select(conv, turn, role, F.col(n_tokens).alias("_n"))
    placed = running_sum(spoken, [conv], [turn], F.col("_n"), "_end")
    if truncation == "right":
        reached = placed.where(F.col("_end") - F.col("_n") < max_length)
    else:
        totals = attach_group_stats(placed, [conv], F.max("_end").alias("_total"), salt=[turn])
        reached = totals.where(F.col("_end") > F.col("_total") - max_length)
    turn_of = reached.select(conv, F.struct(turn, role, "_n").alias("_turn"))
    every = df.select(conv).distinct().withColumn("_turn", F.lit(None).cast(turn_of.schema["_turn"].dataType))
    gathered = turn_of.unionByName(every).groupBy(conv).agg(F.array_sort(F.collect_list("_turn")).alias("_turns"))
    spans = F.flatten(
        F.transform("_turns", lambda t: F.array_repeat((t[role] == "assistant").cast("bigint"), t["_n"].cast("int")))
    )
    mask = pad_truncate(spans, max_length, 0, truncation=truncation)
    kept = F.least(F.size(spans), F.lit(max_length))
    return gathered.select(
        conv, F.transform(mask, lambda x: x.cast("int")).alias("loss_mask"),
        F.transform(F.sequence(F.lit(0), F.lit(max_length - 1)), lambda i: F.when(i < kept, i).otherwise(0)).alias("position_ids"),
    )
