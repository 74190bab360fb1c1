"""Small hand-checked cases."""

import itertools

import pytest
from pyspark.sql import functions as F

from rollmill.functions import answers as A
from rollmill.functions import grading as G
from rollmill.functions import normalize as N
from rollmill.functions import registry as R
from rollmill.functions import text as X
from rollmill.functions import tokens as T
from rollmill.operators import balance as L
from rollmill.operators import batch as B
from rollmill.operators import evaluation as E
from rollmill.operators import prep as P
from rollmill.operators import quality as Q
from rollmill.sources import files as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def column_of(df, column, *order):
    return [r[column] for r in df.orderBy(*order).collect()]


@pytest.fixture(scope="module")
def three(spark):
    return B.batch_from_dict(spark, {"id": [1, 2, 3], "obs": [[1, 2], [3, 4], [5, 6]], "label": ["a", "b", "c"]}, "id int, obs array<int>, label string")


@pytest.mark.parametrize("divisor, want", [(2, [1, 2, 3, 1]), (3, [1, 2, 3]), (7, [1, 2, 3, 1, 2, 3, 1])])
def test_pad_and_unpad(three, divisor, want):
    padded = B.pad_to_divisor(three, "id", divisor)
    assert column_of(padded, "id", "pos") == want
    assert column_of(B.unpad(padded), "id", "id") == [1, 2, 3]


def test_repeat(three):
    assert column_of(B.batch_repeat(three, 2, "id"), "label", "new_pos") == list("aabbcc")
    assert column_of(B.batch_repeat(three, 2, "id", interleave=False), "label", "new_pos") == list("abcabc")


def test_reorder_and_inverse(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(6)], "idx long, obs long")
    perm = spark.createDataFrame([(idx, pos) for pos, idx in enumerate([3, 4, 2, 0, 1, 5])], "idx long, new_pos long")
    assert column_of(B.batch_reorder(df, perm, "idx"), "obs", "new_pos") == [4, 5, 3, 1, 2, 6]
    inverse = B.inverse_permutation(perm, "idx", "new_pos")
    assert column_of(inverse, "new_pos", "idx") == [3, 4, 2, 0, 1, 5]


def test_chunk_concat_and_errors(spark, three):
    df = spark.range(12).withColumnRenamed("id", "k")
    chunks = B.batch_chunk(df, "k", 4)
    assert chunks.groupBy("chunk").count().select("count").distinct().collect() == [(3,)]
    with pytest.raises(Exception, match="do not divide"):
        B.batch_chunk(df, "k", 5).collect()
    with pytest.raises(ValueError):
        B.batch_rename(three, ["id"], ["a", "b"])
    with pytest.raises(KeyError):
        B.batch_pop(three, "id", ["nope"])
    with pytest.raises(ValueError):
        B.batch_from_dict(spark, {"a": [1], "b": [1, 2]}, "a int, b int")
    with pytest.raises(ValueError):
        P.filter_subset_level(three, "level9")


def test_slice_like_python(spark):
    df = spark.range(20).withColumnRenamed("id", "k")
    for start, stop, step in [(0, None, 1), (3, 11, 4), (-7, None, 2), (2, -3, 3), (-5, -1, 1), (-50, 4, 1)]:
        got = column_of(B.batch_slice(df, "k", start, stop, step), "k", "k")
        assert got == list(range(20))[slice(start, stop, step)], (start, stop, step)


def test_union_conflict(spark, three):
    same = three.select("id", "label", F.lit(1).alias("extra"))
    assert B.batch_union_columns(three, same, "id").columns == ["id", "obs", "label", "extra"]
    other = three.select("id", F.upper("label").alias("label"))
    with pytest.raises(Exception, match="column label differs"):
        B.batch_union_columns(three, other, "id").collect()


def test_eos_mask(spark):
    ids = lambda xs: F.array(*[F.lit(x).cast("bigint") for x in xs])
    assert one(spark, T.eos_response_mask(ids([20, 10, 34, 1, 0, 0, 0]), 1)) == [1, 1, 1, 1, 0, 0, 0]
    assert one(spark, T.eos_response_mask(ids([78, 0, 76, 2, 1, 0, 0]), [1, 2])) == [1, 1, 1, 1, 0, 0, 0]
    assert one(spark, T.eos_response_mask(ids([5, 6]), 1)) == [1, 1]


def test_gae_and_returns(spark):
    df = spark.createDataFrame([([0.0, 0.0, 1.0], [0.1, 0.2, 0.3], [1.0, 1.0, 1.0]), ([1.0], [0.5], [1.0])], "r array<double>, v array<double>, m array<double>")
    got = df.select(T.gae_advantages(F.col("r"), F.col("v"), 0.9, 0.95).alias("a"), T.discounted_returns(F.col("r"), F.col("m"), 0.5).alias("d")).collect()
    assert got[0]["a"] == pytest.approx([0.651567, 0.6685, 0.7], abs=1e-6)
    assert got[1]["a"] == pytest.approx([0.5])
    assert got[0]["d"] == pytest.approx([0.25, 0.5, 1.0])


def test_pass_at_k(spark):
    value = lambda n, c, k: one(spark, E.pass_at_k_value(F.lit(n), F.lit(c), F.lit(k)))
    assert value(5, 0, 1) == 0.0
    assert value(5, 5, 1) == 1.0
    assert value(5, 4, 2) == 1.0
    for n, c, k in [(8, 3, 2), (10, 1, 4), (6, 2, 3)]:
        draws = list(itertools.combinations([1] * c + [0] * (n - c), k))
        assert value(n, c, k) == pytest.approx(sum(any(d) for d in draws) / len(draws))


def test_answer_extraction(spark):
    assert one(spark, A.extract_hash_answer(F.lit("a #### -1,234."))) == "-1234."
    assert one(spark, A.extract_hash_answer(F.lit("none"))) is None
    assert one(spark, A.extract_last_number(F.lit("3 then 1,000 ."))) == "1,000"
    assert one(spark, A.extract_last_number(F.lit("x . y ."))) == "."
    assert one(spark, A.extract_last_number(F.lit("none"))) is None


def _boxed_by_hand(text):
    at = text.rfind("\\boxed")
    at = at if at >= 0 else text.rfind("\\fbox")
    depth = 0
    for i in range(max(at, 0), len(text)):
        depth += {"{": 1, "}": -1}.get(text[i], 0)
        if text[i] == "}" and depth == 0:
            return text[at : i + 1] if at >= 0 else None
    return None


def test_boxed_against_brute_force(spark):
    pieces = ["\\boxed{", "\\boxed", "\\fbox{", "{", "}", "a", " "]
    texts = ["".join(p) for p in itertools.product(pieces, repeat=4)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for t, got in df.select("t", A.last_boxed(F.col("t"))).collect():
        assert got == _boxed_by_hand(t), t


@pytest.mark.parametrize("raw, want", [
    ("\\frac12", "\\frac{1}{2}"), ("\\frac1{72}", "\\frac{1}{72}"), ("\\dfrac{3}{4}", "\\frac{3}{4}"), ("0.5", "\\frac{1}{2}"),
    ("3/4", "\\frac{3}{4}"), ("03/4", "03/4"), ("a/b", None), (".25", "0.25"), ("x = 7", "7"), ("\\sqrt3", "\\sqrt{3}"),
    ("\\sqrt", None), ("90^\\circ", "90"), ("12\\text{ cm}", "12"), ("1\\text{ a}\\text{ b}", None), ("50\\%", "50"),
    ("\\left(1, 2\\right)", "(1,2)"), ("\\frac", None), ("\\frac1", "\\frac1"), ("", ""), ("\\$5", "5"),
])
def test_normalize_math_string(spark, raw, want):
    assert one(spark, N.normalize_math_string(F.lit(raw))) == want


@pytest.mark.parametrize("raw, want", [
    ("12 units", "12"), ("x=\\text{5}", "5"), ("$3$", "3"), ("1,234", "1234"), ("\\frac12", "\\frac{1}{2}"), ("\\sqrt3", "\\sqrt{3}"),
])
def test_normalize_final_answer(spark, raw, want):
    assert one(spark, N.normalize_final_answer(F.lit(raw))) == want


@pytest.mark.parametrize("raw, want", [
    ("\\text{Seven}", "seven"), ("5 degrees", "5"), ("3 million", "3*10^6"), ("1,234", "1234"), ("7 3/4", "7+3/4"), ("- 5", "-5"),
    ("4.0", "4"), ("{9}", "9"), ("10%", "10"),
])
def test_normalize_symbolic(spark, raw, want):
    assert one(spark, N.normalize_symbolic(F.lit(raw))) == want


@pytest.mark.parametrize("given, truth, want", [
    ("(1,2)", "(1, 2)", True), ("(1,2)", "[1,2)", False), ("(1,2,3)", "(1,2)", False), ("2/4", "1/2", False), ("1.50", "1.5", True),
    ("2", "2.1", False), ("(1.0, 2.50)", "(1,2.5)", True), ("", "1", False),
])
def test_grade_tuple(spark, given, truth, want):
    assert one(spark, G.grade_tuple(F.lit(given), F.lit(truth))) is want


@pytest.mark.parametrize("given, truth, want", [
    ("50%", "0.5", True), ("$3.00", "3", True), ("1,000", "1000", True), ("[1, 2]", "[1, 2.00001]", True), ("3.15", "3.1", False),
    ("(a)", "a", True), ("1,2", "1,3", False), ("", "1", False),
])
def test_grade_numeric(spark, given, truth, want):
    assert one(spark, G.grade_numeric_tolerance(F.lit(given), F.lit(truth))) is want


def test_dispatch_rejects_unknown_sources(spark):
    with pytest.raises(Exception, match="no grading rule"):
        one(spark, G.grade_dispatch(F.lit("nowhere"), F.lit("x"), F.lit("1")))


def test_repeat_count_counts_overlaps(spark):
    text = "ab" * 75
    tail = text[-100:]
    want = sum(text.startswith(tail, i) for i in range(len(text)))
    assert one(spark, X.repeat_count(F.lit(text))) == want
    odd = "x\\E(." * 40
    assert one(spark, X.repeat_count(F.lit(odd))) == sum(odd.startswith(odd[-100:], i) for i in range(len(odd)))
    assert one(spark, X.repeat_count(F.lit("short"))) == 0


@pytest.mark.parametrize("equal_size", [False, True])
def test_balanced_parts(equal_size):
    lengths = [7, 3, 9, 1, 4, 8, 2, 6, 5, 10, 12, 11]
    for assign in (L._difference_partition, lambda x, k, e: L._lightest_partition(x, k, e, True)):
        parts = assign(lengths, 3, equal_size)
        sums = [sum(v for v, p in zip(lengths, parts) if p == j) for j in range(3)]
        assert sum(sums) == sum(lengths) and max(sums) - min(sums) <= 6
        if equal_size:
            assert [parts.count(j) for j in range(3)] == [4, 4, 4]


def test_registries_and_gates(spark):
    rules = R.RewardRegistry()
    rules.register("r", lambda c: c["solution"])
    with pytest.raises(ValueError):
        rules.register("r", lambda c: c)
    with pytest.raises(KeyError):
        rules.column("missing", solution=F.lit(1))
    with pytest.raises(TypeError):
        rules.register("s", 3)
    df = spark.range(5).withColumn("v", F.col("id") / 10.0)
    assert Q.best_metric_gate(df, F.col("v"), 0.2).first()["best"] == pytest.approx(0.4)
    with pytest.raises(Exception, match="does not exceed"):
        Q.best_metric_gate(df, F.col("v"), 0.9).collect()
    with pytest.raises(Exception, match="0 or 1"):
        E.by_source_and_difficulty(df.withColumn("d", F.lit("x")), "id", "d", "v", "id").collect()


def test_long_conversations_stay_whole(spark):
    df = spark.range(1500).select(F.lit(1).alias("c"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    got = P.build_conversation_messages(df, "c", "turn", "role", "text").collect()
    assert [m["text"] for r in got for m in r["messages"]] == [str(i) for i in range(1500)] and len(got) == 1


def test_multiturn_masks_cut_on_either_side(spark):
    turns = [(1, 0, "system", 2), (1, 1, "user", 3), (1, 2, "assistant", 4), (1, 3, "user", 1), (1, 4, "assistant", 3)]
    df = spark.createDataFrame(turns, "c int, turn int, role string, n int")
    full = [0] * 5 + [1] * 4 + [0] + [1] * 3
    right = P.multiturn_masks(df, "c", "turn", "role", "n", 8).first()
    left = P.multiturn_masks(df, "c", "turn", "role", "n", 8, truncation="left").first()
    padded = P.multiturn_masks(df, "c", "turn", "role", "n", 15).first()
    assert right["loss_mask"] == full[:8] and left["loss_mask"] == full[-8:]
    assert padded["loss_mask"] == full + [0, 0] and padded["position_ids"] == list(range(13)) + [0, 0]


def test_multiturn_masks_keep_conversations_without_tokens(spark):
    turns = [(1, 0, "user", 0), (1, 1, "assistant", 0), (2, 0, "user", 1), (2, 1, "assistant", 2), (3, 0, "user", None), (None, 0, "user", 0)]
    df = spark.createDataFrame(turns, "c int, turn int, role string, n int")
    for truncation in ("right", "left"):
        got = {r["c"]: (r["loss_mask"], r["position_ids"]) for r in P.multiturn_masks(df, "c", "turn", "role", "n", 4, truncation).collect()}
        assert got == {None: ([0] * 4, [0] * 4), 1: ([0] * 4, [0] * 4), 2: ([0, 1, 1, 0], [0, 1, 2, 0]), 3: ([0] * 4, [0] * 4)}


def test_rollout_arrays_are_read_with_track_and_step(spark, tmp_path):
    import json

    for track, step in (("A", 10), ("B", 20)):
        folder = tmp_path / track
        folder.mkdir()
        record = {"input": "q", "output": "#### 1", "score": 1.0, "ref_score": "easy", "index": 3, "split": "test", "source": "s"}
        (folder / f"{step}_rollouts.json").write_text(json.dumps([record, record]))
    got = S.read_rollouts(spark, str(tmp_path), arrays=True)
    assert sorted((r["track"], r["step"], r["score"]) for r in got.collect()) == [("A", 10, 1.0)] * 2 + [("B", 20, 1.0)] * 2


def test_fingerprints_ignore_order_and_see_multiplicity(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], "i int, s string")
    b = spark.createDataFrame([(2, "y"), (1, "x"), (2, "y")], "s_i int, s string").withColumnRenamed("s_i", "i")
    c = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "i int, s string")
    assert S.table_fingerprint(a).first() == S.table_fingerprint(b).first()
    assert S.table_fingerprint(a).first() != S.table_fingerprint(c).first()
    assert tuple(S.compare_tables(a, b).first()) == ("IDENTICAL", 0, 0)
    assert tuple(S.compare_tables(a, c).first()) == ("DIFFERENT", 1, 1)
    assert tuple(S.compare_tables(None, c).first()) == ("LOCAL_MISSING", 0, 3)


def test_student_t(spark):
    # Tabulated two-sided 5% points.
    for df, t in [(1, 12.706), (5, 2.571), (30, 2.042)]:
        assert one(spark, E.student_t_two_sided(F.lit(float(t)), F.lit(float(df)))) == pytest.approx(0.05, abs=2e-4)


def test_tokenizer_length(spark):
    tokenizers = pytest.importorskip("tokenizers")
    vocabulary = {"[UNK]": 0, "a": 1, "b": 2}
    tok = tokenizers.Tokenizer(tokenizers.models.WordLevel(vocabulary, unk_token="[UNK]"))
    tok.pre_tokenizer = tokenizers.pre_tokenizers.Whitespace()
    df = spark.createDataFrame([("a b c",), ("",), (None,)], "t string")
    assert [r["n"] for r in df.select(X.tokenizer_length(F.col("t"), tok.to_str()).alias("n")).collect()] == [3, 0, 0]


def test_adaptive_coefficient_follows_the_controller(spark):
    from rollmill.operators import credit as C

    values = [0.1, 0.5, 0.02, 0.2, 0.3]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "run int, step int, kl double")
    options = {"init": 0.2, "target": 0.15, "horizon": 100.0}
    got = C.kl_trajectory(df, ["run"], "step", "kl", F.lit(8), **options).orderBy("step").collect()
    coef, want = 0.2, []
    for v in values:
        coef *= 1 + min(max(v / 0.15 - 1, -0.2), 0.2) * 8 / 100
        want.append(coef)
    assert [r["kl_coef"] for r in got] == pytest.approx(want)
    assert C.kl_controller(df, ["run"], "kl", F.lit(8), **options).first()["kl_coef"] == pytest.approx(coef)


def test_whitening_keeps_the_variance_of_large_values(spark):
    from rollmill.operators.credit import masked_whiten

    df = spark.createDataFrame([([1e9, 1e9 + 1.0], [1.0, 1.0]), ([1e9 + 2.0, 5.0], [1.0, 0.0])], "v array<double>, mask array<double>")
    got = [x for r in masked_whiten(df, "v", "mask").collect() for x in r["whitened"] if abs(x) < 100]
    values = [1e9, 1e9 + 1.0, 1e9 + 2.0]
    mean = sum(values) / (3 + 1e-8)
    var = sum((x - mean) ** 2 for x in values) / (3 + 1e-8) * 3 / 2
    assert sorted(got) == pytest.approx([(x - mean) / (var + 1e-8) ** 0.5 for x in values], rel=1e-6)


def test_text_stats_keeps_null_groups_and_groups_without_values(spark):
    from rollmill.operators.evaluation import text_stats

    df = spark.createDataFrame([(None, 1, 2), (None, 3, 4), ("a", None, None), ("b", 5, 6)], "source string, chars long, words long")
    got = {r["source"]: (r["rows"], r["chars_median"], r["words_median"]) for r in text_stats(df, ["source"], "chars", "words").collect()}
    assert got == {None: (2, 2.0, 3.0), "a": (1, None, None), "b": (1, 5.0, 6.0)}


def _three_days(spark, folder, rows):
    """The rows in three files, one per day, written one after the other."""
    df = spark.createDataFrame(rows, "g string, at string, k long, x double").withColumn("time", F.to_timestamp("at")).drop("at")
    for day in (1, 2, 3):
        df.where(F.dayofmonth("time") == day).coalesce(1).write.mode("append").parquet(folder)
    return df.schema.simpleString()[len("struct<"):-1].replace(":", " ")


def test_group_timer_does_not_depend_on_batches(spark, tmp_path):
    from rollmill.streaming import rollouts as R

    rows = [
        # complete on the second day; the fourth response comes too late to count
        ("a", "2024-01-01 10:00:00", 1, 1.0), ("a", "2024-01-01 12:00:00", 2, 2.0), ("a", "2024-01-02 01:00:00", 3, 6.0), ("a", "2024-01-02 02:00:00", 4, 50.0),
        # silent for too long, then a new group of the same name
        ("b", "2024-01-01 01:00:00", 5, 4.0), ("b", "2024-01-02 20:00:00", 6, 8.0),
        # two at the same time: the smaller key counts
        ("c", "2024-01-01 05:00:00", 8, 7.0), ("c", "2024-01-01 05:00:00", 7, 1.0), ("c", "2024-01-01 05:00:00", 9, 100.0), ("c", "2024-01-01 05:00:00", 6, 1.0),
        ("end", "2024-01-03 23:00:00", 10, 0.0),
    ]
    schema = _three_days(spark, f"{tmp_path}/in", rows)

    def run(per_batch):
        s = R.stream_parquet(spark, f"{tmp_path}/in", schema, files_per_batch=per_batch)
        out = R.complete_groups_with_timer(s, ["g"], "time", "k", "x", 3, patience_ms=24 * 3_600_000, late="1 hour")
        return sorted(map(tuple, R.run_available(out, [], "append").select("g", "n", "mean", "complete").collect()))

    want = [("a", 3, 3.0, True), ("b", 1, 4.0, False), ("b", 1, 8.0, False), ("c", 3, 3.0, True)]
    assert run(None) == run(1) == want


def test_stream_forms_do_not_depend_on_batches(spark, tmp_path):
    from rollmill.streaming import rollouts as R

    rows = [("ab"[i % 2], f"2024-01-0{1 + i // 20} {i % 20:02d}:30:00", i, float(i * i % 7)) for i in range(60)]
    schema = _three_days(spark, f"{tmp_path}/in", rows)
    forms = {
        "update": [
            lambda s: (R.replay_keep_first(s, ["g"], ["time", "k"], ["k", "x"], ends=None), ["g"]),
            lambda s: (R.replay_keep_last(s, ["g"], ["time", "k"], ["k", "x"], ends=None), ["g"]),
            lambda s: (R.complete_groups(s, ["g"], "x", 8, ends=None), ["g"]),
            lambda s: (R.adaptive_kl(s, ["g"], "x", F.lit(8), init=0.2, target=2.0, horizon=1000.0, ends=None), ["g"]),
            lambda s: (R.step_metrics(s, "time", "x", ["g"], "3 hours"), ["window", "g"]),
        ],
        "append": [lambda s: (R.session_activity(s, "time", ["g"], "2 hours"), []), lambda s: (R.replay_drop_repeats(s.select("time", "g"), "time", ["g"], "90 days").select("g"), [])],
    }
    for mode, made in forms.items():
        for form in made:
            got = []
            for per_batch in (None, 1):
                out, keys = form(R.stream_parquet(spark, f"{tmp_path}/in", schema, files_per_batch=per_batch))
                got.append(sorted(str(tuple(round(v, 9) if isinstance(v, float) else v for v in r)) for r in R.run_available(out, keys, mode).collect()))
            assert got[0] and got[0] == got[1]


def test_controller_with_factors_of_zero_and_below(spark):
    from rollmill.operators.credit import kl_controller

    df = spark.createDataFrame([("a", 0.0, 50), ("a", 0.0, 100), ("b", 0.0, 50), ("b", 0.0, 150)], "g string, kl double, n int")
    got = {r.g: r.kl_coef for r in kl_controller(df, ["g"], "kl", F.col("n"), init=1.0, target=1.0, horizon=10.0).collect()}
    assert got["a"] == 0.0 and got["b"] == pytest.approx(0.0, abs=1e-9)


def test_rolling_mean_over_bucket_edges(spark):
    from rollmill.operators.runlog import rolling_mean

    x = [float(i * i % 11) for i in range(40)]
    df = spark.createDataFrame([(r, i, v) for r in "ab" for i, v in enumerate(x)], "run string, step int, value double")
    got = {(r.run, r.step): r.rolling for r in rolling_mean(df, ["run"], "step", "value", 7, bucket_rows=5).collect()}
    want = {(r, i): sum(x[max(0, i - 3): i + 4]) / len(x[max(0, i - 3): i + 4]) for r in "ab" for i in range(40)}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_similarity_of_one_chunk_and_of_many(spark):
    from rollmill.operators.diversity import group_similarity

    rows = [(i % 2, i, [float((i * j) % 5 - 2) for j in range(1, 7)]) for i in range(1, 41)]
    df = spark.createDataFrame(rows, "g int, k long, v array<double>")
    one, many = (sorted(group_similarity(df, ["g"], "k", "v", c).collect()) for c in (4096, 3))
    assert len(one) == 2 and all(a[i] == pytest.approx(b[i]) for a, b in zip(one, many) for i in range(4))


def test_whole_source_is_told_from_a_null_difficulty(spark):
    from rollmill.operators.evaluation import by_source_and_difficulty

    df = spark.createDataFrame([("s", None, 1.0, 4), ("s", "hard", 0.0, 2)], "src string, d string, s double, l int")
    got = {(r.d, r.overall): r.reward for r in by_source_and_difficulty(df, "src", "d", "s", "l").collect()}
    assert got == {(None, 1): 0.5, (None, 0): 1.0, ("hard", 0): 0.0}


def test_compare_tables_with_other_columns(spark):
    from rollmill.sources.files import compare_tables

    a, b = spark.range(3), spark.range(2).withColumnRenamed("id", "other")
    assert tuple(compare_tables(a, b).first()) == ("DIFFERENT", 3, 2)
    assert tuple(compare_tables(a, spark.range(3)).first()) == ("IDENTICAL", 0, 0)
