"""Weak supervision of text quality: rules vote or abstain, expectation-maximisation weighs them. DataFrame functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollmill.llm.staging import written

SPACE = r"[ \t-\r]"
SYMBOLS = "#*$%&|<>"
WINDOW = 5


def measures(text: Column) -> dict[str, Column]:
    """Word list, lines and window hashes of a text; stages of text_measures."""
    return {
        "_words": F.array_remove(F.split(text, SPACE + "+"), ""),
        "_lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t-\r]")),
    }


def text_measures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One narrow row per input row with counts of its whole text."""
    text = F.coalesce(F.col("_text"), F.lit(""))
    d = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    d = d.select("_id", text.alias("_text")).withColumns(measures(F.col("_text")))
    symbols = sum((F.length("_text") - F.length(F.replace(F.col("_text"), F.lit(c), F.lit(""))) for c in SYMBOLS), F.lit(0))
    d = d.select(
        "_id",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct("_words")).cast("long").alias("n_distinct"),
        F.length(F.regexp_replace(F.array_join("_words", ""), r"\P{L}+", "")).cast("long").alias("n_letters"),
        F.length(F.regexp_replace(F.array_join("_words", ""), r"\P{Lu}+", "")).cast("long").alias("n_capitals"),
        F.length(F.regexp_replace(F.array_join("_words", ""), r"[\p{L}\p{N}]+", "")).cast("long").alias("n_marks"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_h"),
    )
    n = F.size("_h")
    window = F.expr(
        "transform(sequence(0, size(_h) - 5), i -> xxhash64(_h[i], _h[i + 1], _h[i + 2], _h[i + 3], _h[i + 4]))"
    )
    d = d.withColumn("_g", F.when(n >= WINDOW, window).otherwise(F.array().cast("array<bigint>"))).drop("_h")
    # Only a text with a repeated window needs the places: windows sorted by hash stand beside their likes.
    placed = "sort_array(transform(_g, (h, i) -> named_struct('h', h, 'i', i)))"
    d = d.withColumn("_s", F.when(F.size(F.array_distinct("_g")) < F.size("_g"), F.expr(placed))).drop("_g")
    twice = (
        "sort_array(transform(filter(transform(_s, (x, k) -> named_struct('i', x.i, 'twice', "
        "x.h = get(_s, k - 1).h <=> true or x.h = get(_s, k + 1).h <=> true)), x -> x.twice), x -> x.i))"
    )
    d = d.withColumn("_p", F.when(F.col("_s").isNotNull(), F.expr(twice))).drop("_s")
    spread = f"aggregate(transform(_p, (p, k) -> least({WINDOW}, coalesce(get(_p, k + 1), p + {WINDOW}) - p)), 0L, (a, x) -> a + x)"
    return d.withColumn("n_repeat_words", F.coalesce(F.expr(spread), F.lit(0).cast("long"))).drop("_p")


@dataclass(frozen=True)
class Rule:
    """A labelling function: votes -1 (poor) where ``poor`` holds, +1 (good) where ``good`` holds, else abstains."""

    name: str
    poor: str
    good: str = "false"

    def vote(self) -> Column:
        return F.expr(f"case when {self.poor} then -1 when {self.good} then 1 else 0 end").cast("int")


#: Conditions over the columns of text_measures. A rule that tells poor texts only abstains on the rest.
RULES = (
    Rule("length", "n_words < 10"),
    Rule("word_size", "word_chars < 2 * n_words or word_chars > 14 * n_words"),
    Rule("symbols", "n_words = 0 or 5 * n_symbols > n_words", "20 * n_symbols <= n_words and n_words > 0"),
    Rule("lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule("repeats", "100 * n_repeat_words > 20 * n_words"),
    Rule("letters", "10 * n_letters < 7 * word_chars", "10 * n_letters >= 9 * word_chars and n_words > 0"),
    Rule("variety", "n_words >= 20 and 5 * n_distinct < n_words"),
    Rule("marks", "10 * n_marks > 4 * n_words", "4 * n_marks <= n_words and n_words > 0"),
    Rule("capitals", "2 * n_capitals > n_letters", "5 * n_capitals <= n_letters and n_words > 0"),
)


@dataclass
class LabelModel:
    """Prior of good and, for rule and vote, the log-likelihood ratio of good against poor."""

    prior: float
    ratios: dict[str, dict[int, float]]

    def probability(self, votes: tuple[int, ...]) -> float:
        odds = math.log(self.prior / (1 - self.prior)) + sum(by[v] for by, v in zip(self.ratios.values(), votes) if v)
        return 1 / (1 + math.exp(-odds))

    def posterior(self) -> Column:
        odds = F.lit(math.log(self.prior / (1 - self.prior)))
        for name, by_vote in self.ratios.items():
            vote = F.col(f"vote_{name}")
            odds = odds + F.when(vote == 1, by_vote[1]).when(vote == -1, by_vote[-1]).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))


def fit_label_model(patterns: DataFrame, rules: tuple[Rule, ...] = RULES, *, rounds: int = 25, start_prior: float = 0.8,
                    start_accuracy: float = 0.8, smoothing: float = 1.0) -> LabelModel:
    """Expectation-maximisation over counted vote patterns (columns vote_<rule> and n).

    Two hidden classes; given the class, rules vote independently, and abstaining says nothing. The patterns, at most 3 ** rules rows
    at any input size (some 20,000 for nine rules), come to the driver in one job; the rounds are sums over them. Smoothed counts keep
    every accuracy inside (0, 1); no rows at all leave the start values.
    """
    votes = [f"vote_{r.name}" for r in rules]
    counted = sorted((tuple(r[v] for v in votes), r["n"]) for r in patterns.select(*votes, "n").collect())
    prior = start_prior
    # Of each rule and class: how likely a vote is a good one.
    up = {(r.name, c): start_accuracy if c else 1 - start_accuracy for r in rules for c in (0, 1)}

    def model() -> LabelModel:
        ratio = lambda r, v: math.log((up[r, 1] if v > 0 else 1 - up[r, 1]) / (up[r, 0] if v > 0 else 1 - up[r, 0]))
        return LabelModel(prior, {r.name: {v: ratio(r.name, v) for v in (1, -1)} for r in rules})

    every = sum(n for _, n in counted)
    for _ in range(rounds if every else 0):
        now = model()
        good, seen = 0.0, dict.fromkeys(((r.name, v, c) for r in rules for v in (1, -1) for c in (0, 1)), 0.0)
        for pattern, n in counted:
            p = now.probability(pattern)
            good += n * p
            for r, v in zip(rules, pattern):
                if v:
                    seen[r.name, v, 1] += n * p
                    seen[r.name, v, 0] += n * (1 - p)
        before, prior = (prior, *up.values()), (good + smoothing) / (every + 2 * smoothing)
        for r in rules:
            for c in (0, 1):
                # The start accuracy enters as pseudo-counts, so that a rule no document tells about keeps its meaning.
                share = start_accuracy if c else 1 - start_accuracy
                total = seen[r.name, 1, c] + seen[r.name, -1, c]
                up[r.name, c] = (seen[r.name, 1, c] + 2 * smoothing * share) / (total + 2 * smoothing)
        if max(abs(a - b) for a, b in zip(before, (prior, *up.values()))) < 1e-6:
            break
    return model()


def judge_quality(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, threshold: float = 0.5,
) -> DataFrame:
    """Measures, votes, posterior probability of good quality and verdict for every whole text.

    The rules' accuracies are estimated without labels from how they agree over all documents. Columns: the id, the measures of
    text_measures, vote_<rule> (-1, 0 or 1), posterior (0 to 1) and good (posterior >= threshold).

    Null and empty texts have no words: the length rule votes poor. Texts of any length are read whole; a word window is
    compared by a 64-bit hash within its text. Repeated rows each give a row, a null id stays null, other columns are dropped,
    and an empty table gives an empty result. The measures (a narrow row per document) are written once to the shared folder;
    only counts of vote patterns are gathered.
    """
    measured = text_measures(docs, id_col, text_col).withColumns({f"vote_{r.name}": r.vote() for r in rules})
    measured = written(measured, "quality")
    votes = [f"vote_{r.name}" for r in rules]
    patterns = measured.groupBy(*votes).agg(F.count(F.lit(1)).alias("n"))
    posterior = fit_label_model(patterns, rules).posterior()
    return measured.withColumn("posterior", posterior).withColumn("good", F.col("posterior") >= threshold).withColumnRenamed("_id", id_col)


def rule_report(judged: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per rule: coverage and the share of votes that agree with the posterior verdict."""
    one = [
        F.struct(
            F.lit(r.name).alias("rule"),
            F.avg((F.col(f"vote_{r.name}") != 0).cast("double")).alias("coverage"),
            F.avg(F.when(F.col(f"vote_{r.name}") != 0, ((F.col(f"vote_{r.name}") == 1) == F.col("good")).cast("double"))).alias("agreement"),
        )
        for r in rules
    ]
    return judged.agg(F.array(*one).alias("r")).select(F.explode("r").alias("r")).select("r.*")
