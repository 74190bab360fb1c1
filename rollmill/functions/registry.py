"""User plug-ins: reward functions, reducers and reward managers."""

from __future__ import annotations

import multiprocessing
import time
from collections.abc import Callable
from multiprocessing.connection import Connection

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollmill.functions.grading import overlong_penalty


class _Registry:
    """Names mapped to builders of Column expressions; asking for an unknown name is an error."""

    def __init__(self) -> None:
        self._rules: dict[str, Callable] = {}

    def register(self, name: str, rule: Callable) -> None:
        if not callable(rule):
            raise TypeError(f"{name} is not callable")
        if name in self._rules:
            raise ValueError(f"{name} is already registered")
        self._rules[name] = rule

    def __getitem__(self, name: str) -> Callable:
        if name not in self._rules:
            raise KeyError(f"{name!r} is not registered; known: {sorted(self._rules)}")
        return self._rules[name]


class RewardRegistry(_Registry):
    """Reward rules from named columns (``solution``, ``truth``, ...) to a score column."""

    def column(self, name: str, **columns: Column) -> Column:
        return self[name](columns)


class ReducerRegistry(_Registry):
    """Aggregates usable wherever a metric is reduced: any Spark aggregate or grouped pandas UDF."""

    def column(self, name: str, value: Column) -> Column:
        return self[name](value)


def _serve(fn: Callable, args: tuple[pd.Series, ...], start: int, out: Connection) -> None:
    """Score the rows from ``start`` on, one answer a row; a rule that raises scores 0."""
    for i in range(start, len(args[0])):
        try:
            score = float(list(fn(*[a.iloc[i : i + 1] for a in args]))[0])
        except Exception:  # a failing rule is a score, not a failed job
            score = 0.0
        out.send(score)
    out.close()


def scores_in_time(fn: Callable, args: tuple[pd.Series, ...], seconds: float) -> list[float]:
    """A score for each row, 0 for rows whose rule raises or is not done after ``seconds``.

    The rule runs in a helper process beside the Python worker. At a row's deadline, or when the rule ends the process, the helper is
    killed and another one goes on behind that row, so a rule that never returns costs its deadline and nothing else.
    """
    context, scores, n = multiprocessing.get_context("fork"), [], len(args[0])
    while len(scores) < n:
        ours, theirs = context.Pipe(duplex=False)
        helper = context.Process(target=_serve, args=(fn, args, len(scores), theirs), daemon=True)
        helper.start()
        theirs.close()
        try:
            while len(scores) < n:
                deadline = time.monotonic() + seconds
                if not ours.poll(max(deadline - time.monotonic(), 0)):
                    scores.append(0.0)
                    break
                try:
                    scores.append(ours.recv())
                except EOFError:  # the rule has ended its process
                    scores.append(0.0)
                    break
        finally:
            ours.close()
            helper.kill()
            helper.join()
    return scores


def grade_batched(
    df: DataFrame, fn: Callable, solution: str, truth: str, *, source: str, extra: str | None = None,
    returns: str = "double", fail_to_zero: bool = False, seconds: float | None = None,
) -> DataFrame:
    """Score with a Python function over whole Arrow batches.

    ``fn(data_source, solution, truth, extra)`` takes pandas Series and gives one value per row, or, when
    ``returns`` names several columns, a DataFrame whose columns are added. With ``fail_to_zero`` a row whose
    evaluation raises scores 0 and the others keep their scores. With ``seconds`` each row has so long: a rule that is not done then
    scores 0 too, and is killed (see scores_in_time).
    """
    struct = " " in returns.strip()
    if struct and seconds is not None:
        raise ValueError("a time limit is for rules that give one score")

    def score_rows(args: tuple[pd.Series, ...]) -> pd.Series:
        out = []
        for i in range(len(args[0])):
            try:
                out.append(float(list(fn(*[a.iloc[i : i + 1] for a in args]))[0]))
            except Exception:  # a failing rule is a score, not a failed job
                out.append(0.0)
        return pd.Series(out, dtype="float64")

    if struct:

        @F.pandas_udf(returns)
        def run(source: pd.Series, solution: pd.Series, truth: pd.Series, extra: pd.Series) -> pd.DataFrame:
            return fn(source, solution, truth, extra)
    else:

        @F.pandas_udf(returns)
        def run(source: pd.Series, solution: pd.Series, truth: pd.Series, extra: pd.Series) -> pd.Series:
            args = (source, solution, truth, extra)
            if seconds is not None:
                return pd.Series(scores_in_time(fn, args, seconds), dtype="float64")
            if not fail_to_zero:
                return pd.Series(fn(*args))
            try:
                return pd.Series(fn(*args), dtype="float64")
            except Exception:  # find the rows at fault one by one
                return score_rows(args)

    result = run(F.col(source), F.col(solution), F.col(truth), F.col(extra) if extra else F.lit(""))
    graded = df.withColumn("_graded", result)
    return graded.select(*df.columns, "_graded.*" if struct else F.col("_graded").alias("score"))


def reward_manager(
    df: DataFrame, name: str, score: Column | Callable, *, length: str | None = None, max_length: int = 0, buffer: int = 0,
    factor: float = 1.0, solution: str = "solution", truth: str = "truth", source: str = "data_source", extra: str | None = None,
    seconds: float = 300.0,
) -> DataFrame:
    """Adds ``score`` by one of four managers.

    naive: a Column rule, row by row. dapo: the same, with the overlong penalty and its flag. batch: a Python function over whole
    batches, as in grade_batched, which must not fail. prime: such a function row by row, each within ``seconds``; rows that fail or run
    out of time score 0.
    """
    if name in ("prime", "batch"):
        if isinstance(score, Column):
            raise TypeError(f"the {name} manager needs a function of (data_source, solution, truth, extra)")
        return grade_batched(df, score, solution, truth, source=source, extra=extra, seconds=seconds if name == "prime" else None)
    if name == "naive":
        return df.withColumn("score", score)
    if name != "dapo":
        raise ValueError(f"unknown reward manager {name!r}")
    if length is None or buffer <= 0:
        raise ValueError("the dapo manager needs a length column and a buffer")
    penalty = overlong_penalty(F.col(length), max_length, buffer, factor)
    return df.withColumn("_penalty", penalty).withColumn("score", score + F.col("_penalty")).withColumn(
        "overlong", F.col("_penalty") < 0
    ).drop("_penalty")


class DatasetRegistry(_Registry):
    """Dataset builders ``(spark, **options) -> DataFrame`` under a name."""

    def load(self, name: str, spark: SparkSession, **options) -> DataFrame:
        out = self[name](spark, **options)
        if not isinstance(out, DataFrame):
            raise TypeError(f"dataset {name!r} did not give a DataFrame")
        return out
