"""Queries of the dataset-building, augmentation, filter and encoding operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollmill.functions import text as X
from rollmill.functions import tokens as T
from rollmill.operators import prep as P
from rollmill.plans.catalog import query
from rollmill.views import docs, ev, hist, pref, qa, table, tok


def _flat(df):
    """Prompt rows with their nested fields as plain columns."""
    m = F.get("prompt", F.lit(0))
    return df.select(
        "data_source", m["role"].alias("role"), m["content"].alias("content"), "ability", "level",
        F.col("reward_model.style").alias("style"), F.col("reward_model.ground_truth").alias("ground_truth"),
        F.col("extra_info.split").alias("split"), F.col("extra_info.index").alias("index"),
        F.col("extra_info.answer").alias("answer"), F.col("extra_info.question").alias("question"),
    )


TRUTH = r"replace(nullif(regexp_extract(answer, '#### (-?[0-9.,]+)', 1), ''), ',', '')"
HASH_SQL = P.HASH_INSTRUCTION.replace("'", "''")


@query("build_prompt_rows", views="qa", oracle=f"""
SELECT 'openai/gsm8k' AS data_source, 'user' AS role, question || ' ' || '{HASH_SQL}' AS content, 'math' AS ability, 'unknown' AS level, 'rule' AS style,
  {TRUTH} AS ground_truth, 'train' AS split, item_id AS index, answer, question FROM qa""")
def _(spark, sf):
    return _flat(P.build_prompt_rows(qa(spark, sf), "question", "answer", "item_id", data_source="openai/gsm8k", split="train"))


@query("build_prompt_rows_multimodal", views="qa", oracle=f"""
SELECT question || ' ' || '{P.THINK_INSTRUCTION}' AS content, {TRUTH} AS ground_truth, CAST(octet_length(encode(question)) AS INTEGER) AS image_bytes FROM qa""")
def _(spark, sf):
    with_images = qa(spark, sf).withColumn("images", F.array(F.struct(F.encode("question", "UTF-8").alias("bytes"))))
    rows = P.build_prompt_rows(
        with_images, "question", "answer", "item_id", data_source="hiyouga/geometry3k", split="train",
        instruction=P.THINK_INSTRUCTION, passthrough=["images"],
    )
    return rows.select(
        F.get("prompt", F.lit(0))["content"].alias("content"), F.col("reward_model.ground_truth").alias("ground_truth"),
        F.length(F.get("images", F.lit(0))["bytes"]).alias("image_bytes"),
    )


@query("build_multiple_choice_rows", views="docs", oracle=r"""
, d AS (SELECT *, source || ' [title]' AS ctx_a, 'XY ' || lower(lang) AS ctx_b FROM docs WHERE quality IS NOT NULL),
q AS (SELECT doc_id, quality, text, replace(regexp_replace(replace(regexp_replace(lang || ': ' || ctx_a || ' ' || upper(ctx_b[1]) || lower(ctx_b[2:]), '^\s+|\s+$', '', 'g'), ' [title]', '. '), '\[.*?\]', '', 'g'), '  ', ' ') AS content FROM d)
SELECT content, CAST(quality AS VARCHAR) AS ground_truth, doc_id AS index, 'end ' || doc_id AS choice_0,
  replace(regexp_replace(replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), ' [title]', '. '), '\[.*?\]', '', 'g'), '  ', ' ') AS choice_1 FROM q""")
def _(spark, sf):
    d = docs(spark, sf).select(
        "doc_id", F.col("lang").alias("activity"), F.concat("source", F.lit(" [title]")).alias("ctx_a"),
        F.concat(F.lit("XY "), F.lower("lang")).alias("ctx_b"),
        F.array(F.concat(F.lit("end [step]"), F.col("doc_id").cast("string"), F.lit(" ")), F.col("text")).alias("endings"),
        F.coalesce(F.col("quality").cast("string"), F.lit("")).alias("label"),
    )
    rows = P.build_multiple_choice_rows(
        d, activity="activity", ctx_a="ctx_a", ctx_b="ctx_b", endings="endings", label="label", index="doc_id", split="train"
    )
    choices = F.col("reward_model.choices")
    return rows.select(
        F.get("prompt", F.lit(0))["content"].alias("content"), F.col("reward_model.ground_truth").alias("ground_truth"),
        F.col("extra_info.index").alias("index"), F.regexp_replace(F.get(choices, F.lit(0)), "end ?", "end ").alias("choice_0"),
        F.get(choices, F.lit(1)).alias("choice_1"),
    )


@query("build_sft_from_preference", views="pref", oracle="""
SELECT doc_id, prompt, 'chosen' AS side, chosen AS response FROM pref UNION ALL SELECT doc_id, prompt, 'rejected', rejected FROM pref""")
def _(spark, sf):
    return P.build_sft_from_preference(pref(spark, sf), "doc_id", "prompt", "chosen", "rejected")


@query("build_rm_dataset", views="pref", oracle="""
, n AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM pref)
SELECT doc_id, prompt, pos, CASE WHEN pos < floor((SELECT count(*) FROM pref) * 0.75) THEN 'train' ELSE 'test' END AS split FROM n""")
def _(spark, sf):
    return P.build_rm_dataset(pref(spark, sf), "doc_id").select("doc_id", "prompt", "pos", "split")


@query("build_rl_from_preference", views="pref", oracle="""
SELECT 'Dahoas/full-hh-rlhf' AS data_source, 'user' AS role, prompt AS content, 'alignment' AS ability, 'unknown' AS level, 'model' AS style, chosen AS ground_truth,
 'train' AS split, doc_id AS index, NULL::VARCHAR AS answer, NULL::VARCHAR AS question FROM pref""")
def _(spark, sf):
    return _flat(P.build_rl_from_preference(pref(spark, sf), "prompt", "chosen", "doc_id"))


@query("build_conversation_messages", """
SELECT conv_id, count(*) AS n_messages, string_agg(role || ':' || text, '|' ORDER BY turn) AS messages FROM conversations GROUP BY conv_id""")
def _(spark, sf):
    m = P.build_conversation_messages(table(spark, sf, "conversations"), "conv_id", "turn", "role", "text")
    joined = F.array_join(F.transform("messages", lambda x: F.concat_ws(":", x["role"], x["text"])), "|")
    return m.select("conv_id", F.size("messages").cast("bigint").alias("n_messages"), joined.alias("messages"))


def _pool_sql(pool):
    return "[" + ", ".join("'" + p.replace("'", "''") + "'" for p in pool) + "]"


def _pick_sql(pool, seed, key):
    return f"({_pool_sql(pool)})[('0x' || substr(md5('{seed}:' || {key}), 1, 8))::BIGINT % {len(pool)} + 1]"


@query("augment_mixed", f"""
SELECT doc_id, doc_id AS index, text, false AS is_clone FROM documents
UNION ALL SELECT doc_id, doc_id + (SELECT count(*) FROM documents), {_pick_sql(P.TRIVIA, 42, 'doc_id')} || ' ' || text, true FROM documents""")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("doc_id").alias("index"), "text")
    return P.augment_mixed(d, "doc_id", "index", "text", P.TRIVIA, 42)


@query("augment_replace", f"""
SELECT doc_id, doc_id AS index, CASE WHEN doc_id % 10 = 0 THEN text ELSE {_pick_sql(P.TRIVIA, 42, 'doc_id')} || ' ' || text END AS text FROM documents""")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("doc_id").alias("index"), "text")
    return P.augment_replace(d, "doc_id", "index", "text", P.TRIVIA, 42)


@query("augment_clones_only", f"""
SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS index, {_pick_sql(P.GIBBERISH, 7, 'doc_id')} || ' ' || text AS text FROM documents""")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("doc_id").alias("index"), "text")
    return P.augment_clones_only(d, "doc_id", "index", "text", P.GIBBERISH, 7)


@query("reindex_subset", "SELECT doc_id AS old_index, row_number() OVER (ORDER BY doc_id) - 1 AS index FROM labels WHERE quality = 1")
def _(spark, sf):
    good = table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("index"))
    return P.reindex_subset(good, "index")


@query("filter_overlong_prompts", r"""
SELECT doc_id FROM documents WHERE len(regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+')) <= 200""")
def _(spark, sf):
    return table(spark, sf, "documents").where(X.token_length(F.col("text")) <= 200).select("doc_id")


@query("filter_contains_ci", "SELECT doc_id, lang FROM documents WHERE contains(lower(lang), 'e')")
def _(spark, sf):
    return P.filter_contains_ci(table(spark, sf, "documents").select("doc_id", "lang"), ["competition", "lang"], "E")


@query("filter_subset_level", "SELECT doc_id, 'Level ' || (doc_id % 7) AS level FROM documents WHERE contains('Level ' || (doc_id % 7), '5')")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("Level "), (F.col("doc_id") % 7).cast("string")).alias("level"))
    return P.filter_subset_level(d, "level5")


@query("filter_reward_band", views="ev", oracle="""
SELECT sample_id, CASE WHEN (k % 17) / 16.0 > 10 / 16.0 THEN 'easy' ELSE 'hard' END AS band FROM ev WHERE (k % 17) / 16.0 > 10 / 16.0 OR k % 17 = 0""")
def _(spark, sf):
    e = ev(spark, sf).select("sample_id", ((F.col("k") % 17) / 16.0).alias("reward"))
    easy = e.where(F.col("reward") > 10 / 16).select("sample_id", F.lit("easy").alias("band"))
    return easy.unionByName(e.where("reward = 0").select("sample_id", F.lit("hard").alias("band")))


@query("filter_common_steps", """
WITH m AS (SELECT min(l) AS l FROM (SELECT max(o_custkey % 400) AS l FROM orders GROUP BY o_orderstatus))
SELECT o_orderkey AS row_id, o_orderstatus AS run_id, CAST(o_custkey % 400 AS INTEGER) AS step FROM orders, m WHERE o_custkey % 400 <= l""")
def _(spark, sf):
    return P.filter_common_steps(hist(spark, sf).select("row_id", "run_id", "step"), "run_id", "step")


@query("filter_nonzero_variance_groups", views="ev", oracle="""
, s AS (SELECT *, k % 10 = ground_truth AS ok FROM ev),
g AS (SELECT track, question_idx, step FROM s GROUP BY ALL HAVING min(ok) <> max(ok))
SELECT sample_id FROM s JOIN g USING (track, question_idx, step)""")
def _(spark, sf):
    e = ev(spark, sf).select("sample_id", "track", "question_idx", "step", (F.col("k") % 10 == F.col("ground_truth")).cast("int").alias("ok"))
    return P.filter_nonzero_variance_groups(e, ["track", "question_idx", "step"], "ok").select("sample_id")


@query("coalesce_first_column", "SELECT item_id, text AS question FROM benchmark")
def _(spark, sf):
    b = table(spark, sf, "benchmark")
    return b.select("item_id", F.col(P.first_present(b, ["problem", "question", "text"])).alias("question"))


@query("custom_chat_template", "SELECT conv_id, turn, '<' || role || '>' || text AS rendered FROM conversations")
def _(spark, sf):
    template = lambda role, text: F.concat(F.lit("<"), role, F.lit(">"), text)
    return table(spark, sf, "conversations").select("conv_id", "turn", template(F.col("role"), F.col("text")).alias("rendered"))


# Encodings, one output row per position.

IDS = r"list_transform(list_filter(regexp_split_to_array({t}, '\s+'), lambda w: w <> ''), lambda w: ('0x' || substr(md5(w), 1, 8))::BIGINT % 50000 + 2)"


def _explode(df, keys, cols):
    return df.select(*keys, F.posexplode(F.arrays_zip(*cols)).alias("pos", "t")).select(
        *keys, F.col("pos").cast("bigint").alias("pos"), *[F.col(f"t.{c}").alias(c) for c in cols]
    )


@query("strip_pad_tokens", views="tok", oracle="""
SELECT uid, t - 1 AS pos, CAST(uid % 97 + t AS BIGINT) AS id FROM tok, unnest(range(1, n + 1)) u(t)""")
def _(spark, sf):
    ids = F.transform(F.sequence(F.lit(1), F.col("n")), lambda t: F.col("uid") % 97 + t)
    padded = F.concat(F.array_repeat(F.lit(0).cast("bigint"), F.col("label") + 3), ids)
    df = tok(spark, sf).select("uid", T.strip_left_pad(padded, 0).alias("id"))
    return _explode(df, ["uid"], ["id"])


@query("pad_truncate_sequence", views="tok", oracle="""
, x AS (SELECT uid, n, u.t AS t FROM tok, unnest(range(32)) u(t))
SELECT uid, t AS pos, CASE WHEN n >= 32 THEN uid + t + n - 32 + 1 WHEN t >= 32 - n THEN uid + t - (32 - n) + 1 ELSE 0 END AS left_side,
  CASE WHEN t < n THEN uid + t + 1 ELSE 0 END AS right_side FROM x""")
def _(spark, sf):
    ids = F.transform(F.sequence(F.lit(1), F.col("n")), lambda t: F.col("uid") + t)
    df = tok(spark, sf).select(
        "uid", T.pad_truncate(ids, 32, 0, left_pad=True, truncation="left").alias("left_side"),
        T.pad_truncate(ids, 32, 0, truncation="right").alias("right_side"),
    )
    return _explode(df, ["uid"], ["left_side", "right_side"])


@query("sft_loss_mask", views="docs", oracle="""
, d AS (SELECT doc_id, length(source) AS p, n_chars AS r FROM docs),
x AS (SELECT doc_id, u.t AS pos, CASE WHEN p > 1 THEN least(p, 128) - 1 ELSE 0 END AS hidden, least(p + r, 128) AS kept FROM d, unnest(range(128)) u(t))
SELECT doc_id, pos, CAST(pos >= hidden AND pos < kept - 1 AS INTEGER) AS mask FROM x""")
def _(spark, sf):
    p, r = F.length("source"), F.col("n_chars")
    return _explode(docs(spark, sf).select("doc_id", T.sft_loss_mask(p, r, 128).alias("mask")), ["doc_id"], ["mask"])


@query("multiturn_loss_mask", r"""
WITH t AS (SELECT conv_id, turn, role, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS n FROM conversations),
e AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS e FROM t),
m AS (SELECT conv_id, CAST(e - n + u.i AS BIGINT) AS pos, CAST(role = 'assistant' AS INTEGER) AS mask FROM e, unnest(range(CAST(n AS BIGINT))) u(i)),
g AS (SELECT conv_id, u.p AS pos FROM (SELECT DISTINCT conv_id FROM t), unnest(range(96)) u(p))
SELECT g.conv_id, g.pos, coalesce(m.mask, 0) AS loss_mask, CAST(CASE WHEN m.mask IS NULL THEN 0 ELSE g.pos END AS INTEGER) AS position_ids
FROM g LEFT JOIN m ON g.conv_id = m.conv_id AND g.pos = m.pos""")
def _(spark, sf):
    c = table(spark, sf, "conversations").withColumn("n", X.token_length(F.col("text")))
    return _explode(P.multiturn_masks(c, "conv_id", "turn", "role", "n", 96), ["conv_id"], ["loss_mask", "position_ids"])


@query("preference_pair_encode", views="pref", oracle=f"""
, s AS (SELECT doc_id, prompt, 'chosen' AS side, chosen AS r FROM pref UNION ALL SELECT doc_id, prompt, 'rejected', rejected FROM pref),
i AS (SELECT doc_id, side, list_concat(list_concat({IDS.format(t='prompt')}, {IDS.format(t='r')}), [1]) AS ids FROM s)
SELECT doc_id, side, u.p AS pos, coalesce(ids[u.p + 1], 0) AS input_ids, CAST(u.p < len(ids) AS INTEGER) AS attention_mask FROM i, unnest(range(64)) u(p)""")
def _(spark, sf):
    ids = lambda c: X.word_ids(F.col(c))
    df = P.preference_pair_encode(pref(spark, sf), "doc_id", ids("prompt"), ids("chosen"), ids("rejected"), eos=1, max_length=64)
    return _explode(df, ["doc_id", "side"], ["input_ids", "attention_mask"])


@query("concat_prompt_response", views="qa", oracle=f"""
, i AS (SELECT item_id, {IDS.format(t='question')} AS p, {IDS.format(t='answer')} AS r FROM qa),
l AS (SELECT item_id, CASE WHEN len(p) > 16 THEN p[len(p) - 15:] ELSE p END AS p, r[1:24] AS r FROM i),
x AS (SELECT item_id, p, r, 16 - len(p) AS s, u.t AS pos FROM l, unnest(range(40)) u(t))
SELECT item_id, pos, CASE WHEN pos < s THEN 0 WHEN pos < 16 THEN p[pos - s + 1] ELSE coalesce(r[pos - 15], 0) END AS input_ids,
  CAST(pos >= s AND pos < 16 + len(r) AS INTEGER) AS attention_mask, CAST(greatest(pos - s, 0) AS INTEGER) AS position_ids FROM x""")
def _(spark, sf):
    encoded = P.concat_prompt_response(
        X.word_ids(F.col("question")), X.word_ids(F.col("answer")), prompt_length=16, response_length=24, pad=0
    )
    df = qa(spark, sf).select("item_id", encoded.alias("e")).select("item_id", "e.*")
    return _explode(df, ["item_id"], ["input_ids", "attention_mask", "position_ids"])
