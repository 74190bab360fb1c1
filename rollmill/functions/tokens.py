"""Expressions along the token arrays of one response. Arrays stay unpadded; a row is one sequence."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from rollmill.functions.text import let


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)  # float and integer items widen to double


def masked_sum(values: Column, mask: Column) -> Column:
    return array_sum(F.zip_with(values, mask, lambda v, m: v * m))


def squares(values: Column) -> Column:
    return F.transform(values, lambda v: v * v)


def ones_like(values: Column) -> Column:
    return F.transform(values, lambda _: F.lit(1.0))


def eos_response_mask(ids: Column, eos: int | list[int]) -> Column:
    """1 up to and including the first end token, 0 after it; all 1 when there is none."""
    ends = [eos] if isinstance(eos, int) else list(eos)
    firsts = F.array_min(F.array(*[F.nullif(F.array_position(ids, F.lit(e).cast("bigint")), F.lit(0)) for e in ends]))
    last = F.coalesce(firsts, F.size(ids).cast("bigint"))
    return let(last, lambda n: F.transform(ids, lambda _, i: (i < n).cast("int")))


def place_terminal_reward(length: Column, score: Column) -> Column:
    """Token rewards that are 0 but for the last valid token."""
    return F.transform(
        F.sequence(F.lit(1), length), lambda i: F.when(i == length, score.cast("double")).otherwise(F.lit(0.0))
    )


def kl_penalty(logprob: Column, ref_logprob: Column, kind: str = "kl") -> Column:
    """Per-token divergence estimate between the policy and a reference."""
    rules = {
        "kl": lambda a, b: a - b,
        "abs": lambda a, b: F.abs(a - b),
        "mse": lambda a, b: 0.5 * (a - b) * (a - b),
        "low_var_kl": lambda a, b: F.greatest(F.least(F.exp(b - a) - (b - a) - 1, F.lit(10.0)), F.lit(-10.0)),
    }
    if kind not in rules:
        raise ValueError(f"unknown divergence {kind!r}; choose from {sorted(rules)}")
    return F.zip_with(logprob, ref_logprob, rules[kind])


def reward_with_kl(scores: Column, kl: Column, beta: float, mask: Column | None = None) -> Column:
    """Token reward less ``beta`` times the divergence; unpadded arrays need no mask."""
    if mask is not None:
        kl = F.zip_with(kl, mask, lambda k, m: k * m)
    return F.zip_with(scores, kl, lambda s, k: s - k * F.lit(beta))


def entropy_from_logits(logits: Column) -> Column:
    """Entropy of the softmax over one logit array, shifted by its maximum."""

    def body(s):
        weights = F.transform(s["x"], lambda v: F.exp(v - s["top"]))
        return let(
            F.struct(array_sum(weights).alias("z"), array_sum(F.zip_with(weights, s["x"], lambda w, v: w * v)).alias("wx")),
            lambda t: s["top"] + F.ln(t["z"]) - t["wx"] / t["z"],
        )

    return let(F.struct(logits.alias("x"), F.array_max(logits).alias("top")), body)


def logprob_of_label(logits: Column, label: Column) -> Column:
    """Log-softmax at the zero-based ``label``."""
    return let(
        F.struct(logits.alias("x"), F.array_max(logits).alias("top")),
        lambda s: F.get(s["x"], label.cast("int")) - s["top"]
        - F.ln(array_sum(F.transform(s["x"], lambda v: F.exp(v - s["top"])))),
    )


def strip_left_pad(ids: Column, pad: int) -> Column:
    """Drop the leading pad tokens."""
    first = F.array_position(F.transform(ids, lambda t: t != pad), True)
    return F.when(first == 0, F.slice(ids, 1, 0)).otherwise(
        F.slice(ids, F.greatest(first, F.lit(1)).cast("int"), F.size(ids))
    )


def strip_pad(ids: Column, pad: int) -> Column:
    return F.filter(ids, lambda t: t != pad)


def pad_truncate(ids: Column, length: int, pad: int, *, left_pad: bool = False, truncation: str = "error") -> Column:
    """Exactly ``length`` tokens: pad on one side, or cut on the side ``truncation`` names."""
    if truncation not in ("left", "right", "error"):
        raise ValueError(f"unknown truncation {truncation!r}")

    def body(x):
        size = F.size(x)
        fill = F.array_repeat(F.lit(pad).cast("bigint"), F.greatest(F.lit(length) - size, F.lit(0)))
        padded = F.concat(fill, x) if left_pad else F.concat(x, fill)
        cut = {
            "left": F.slice(x, F.greatest(size - length + 1, F.lit(1)), F.lit(length)),
            "right": F.slice(x, 1, length),
            "error": F.raise_error(F.concat(F.lit("sequence longer than "), F.lit(length))).cast("array<bigint>"),
        }[truncation]
        return F.when(size > length, cut).otherwise(padded)

    return let(ids, body)


def sft_loss_mask(prompt_length: Column, response_length: Column, max_length: int, truncation: str = "right") -> Column:
    """0 on the prompt but its last token, on the last response token and on padding.

    Truncation on the left drops leading attention first; positions then count from the cut, as the masks do.
    """
    total = prompt_length + response_length
    kept = F.least(total, F.lit(max_length))
    hidden = F.when(prompt_length > 1, F.least(prompt_length, F.lit(max_length)) - 1).otherwise(0)
    if truncation not in ("left", "right"):
        raise ValueError(f"unknown truncation {truncation!r}")
    return F.transform(
        F.sequence(F.lit(1), F.lit(max_length)), lambda i: ((i > hidden) & (i <= kept) & (i != kept)).cast("int")
    )


def multiturn_loss_mask(messages: Column, max_length: int, truncation: str = "right") -> Column:
    """1 on assistant tokens, for messages given as structs (role, n_tokens); padded with 0 to ``max_length``."""
    spans = F.flatten(
        F.transform(messages, lambda m: F.array_repeat((m["role"] == "assistant").cast("bigint"), m["n_tokens"]))
    )
    return F.transform(pad_truncate(spans, max_length, 0, truncation=truncation), lambda x: x.cast("int"))


def _padded(arrays: list[pd.Series]) -> tuple[list[np.ndarray], np.ndarray]:
    """Right-padded matrices of one Arrow batch, and the row lengths."""
    lengths = arrays[0].map(len).to_numpy()
    width = int(lengths.max()) if len(lengths) else 0
    inside = np.arange(width)[None, :] < lengths[:, None]
    out = []
    for a in arrays:
        m = np.zeros((len(a), width))
        if width:
            m[inside] = np.concatenate(a.to_numpy())
        out.append(m)
    return out, lengths


def _ragged(matrix: np.ndarray, lengths: np.ndarray) -> pd.Series:
    return pd.Series([row[:n] for row, n in zip(matrix, lengths)])


# A backward recursion along the tokens has no built-in whose cost is linear in the length: growing an array
# inside aggregate() copies it at every step. These run on whole Arrow batches, one vector step per position.


_WITH_MOMENTS = "values array<double>, n double, mean double, m2 double"


def _with_moments(matrix: np.ndarray, mask: np.ndarray, lengths: np.ndarray) -> pd.DataFrame:
    """The rows, and number, mean and squares around the mean of the unmasked entries of each."""
    n = mask.sum(axis=1)
    mean = (matrix * mask).sum(axis=1) / np.maximum(n, 1)
    m2 = ((matrix - mean[:, None]) ** 2 * mask).sum(axis=1)
    return pd.DataFrame({"values": _ragged(matrix, lengths), "n": n.astype(float), "mean": mean, "m2": m2})


def returns_with_moments(rewards: Column, mask: Column, gamma: float) -> Column:
    """Backward sum R_t = r_t + gamma * R_{t+1}, cut where the mask is 0: a struct of the values and their unmasked moments."""

    @F.pandas_udf(_WITH_MOMENTS)
    def run(rewards: pd.Series, mask: pd.Series) -> pd.DataFrame:
        (r, m), lengths = _padded([rewards, mask])
        carry = np.zeros(len(r))
        for t in range(r.shape[1] - 1, -1, -1):
            total = r[:, t] + gamma * carry
            carry = total * m[:, t]
            r[:, t] = total
        return _with_moments(r, m, lengths)

    return run(rewards, mask)


def gae_with_moments(rewards: Column, values: Column, mask: Column, gamma: float, lam: float) -> Column:
    """Generalised advantage estimate, before whitening; the value after the last token counts as 0. A struct as in returns_with_moments."""

    @F.pandas_udf(_WITH_MOMENTS)
    def run(rewards: pd.Series, values: pd.Series, mask: pd.Series) -> pd.DataFrame:
        (r, v, m), lengths = _padded([rewards, values, mask])
        carry, following = np.zeros(len(r)), np.zeros(len(r))
        out = np.zeros_like(r)
        for t in range(r.shape[1] - 1, -1, -1):
            carry = r[:, t] + gamma * following - v[:, t] + gamma * lam * carry
            out[:, t], following = carry, v[:, t]
        return _with_moments(out, m, lengths)

    return run(rewards, values, mask)


def discounted_returns(rewards: Column, mask: Column, gamma: float) -> Column:
    """Backward sum R_t = r_t + gamma * R_{t+1}, cut where the mask is 0."""
    return returns_with_moments(rewards, mask, gamma)["values"]


def gae_advantages(rewards: Column, values: Column, gamma: float, lam: float) -> Column:
    """Generalised advantage estimate, before whitening."""
    return gae_with_moments(rewards, values, ones_like(rewards), gamma, lam)["values"]


def position_ids(mask: Column) -> Column:
    """Running count of the mask minus one, never below 0."""

    @F.pandas_udf("array<bigint>")
    def run(mask: pd.Series) -> pd.Series:
        (m,), lengths = _padded([mask])
        return _ragged(np.maximum(np.cumsum(m, axis=1) - 1, 0).astype("int64"), lengths)

    return run(mask)
