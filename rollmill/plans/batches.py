"""Queries of the batch algebra, ordering, sampling, balancing and set operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollmill.operators import balance as L
from rollmill.operators import batch as B
from rollmill.operators.keyed import hash_positions
from rollmill.operators.prep import build_conversation_messages
from rollmill.operators.runlog import flatten_columns
from rollmill.plans.catalog import query
from rollmill.views import ev, table

NUMBERED = "SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM events"


def _events(spark, sf, *cols):
    return table(spark, sf, "events").select("event_id", *cols)


@query("batch_select", "SELECT event_id, value FROM events")
def _(spark, sf):
    return B.batch_select(table(spark, sf, "events"), ["event_id", "value"])


@query("batch_pop", """
SELECT event_id, 'popped' AS side, event_type AS text, value FROM events
UNION ALL SELECT event_id, 'rest', props, CAST(user_id AS DOUBLE) FROM events""")
def _(spark, sf):
    popped, rest = B.batch_pop(table(spark, sf, "events"), "event_id", ["event_type", "value"])
    a = popped.select("event_id", F.lit("popped").alias("side"), F.col("event_type").alias("text"), "value")
    b = rest.select("event_id", F.lit("rest").alias("side"), F.col("props").alias("text"), F.col("user_id").cast("double").alias("value"))
    return a.unionByName(b)


@query("batch_rename", "SELECT event_id AS uid, value AS score, event_type FROM events")
def _(spark, sf):
    return B.batch_rename(_events(spark, sf, "value", "event_type"), ["event_id", "value"], ["uid", "score"])


PERM = """
perm AS (SELECT event_id, row_number() OVER (ORDER BY md5('3:' || event_id), event_id) - 1 AS new_pos FROM events)
"""


@query("batch_select_idxs", f"WITH {PERM} SELECT event_id, value, new_pos FROM events JOIN perm USING (event_id) WHERE new_pos % 3 = 0")
def _(spark, sf):
    chosen = hash_positions(_events(spark, sf), "event_id", "3", "new_pos").where("new_pos % 3 = 0")
    return B.batch_select_idxs(_events(spark, sf, "value"), "event_id", chosen, "new_pos")


@query("batch_slice", f"SELECT event_id, value, pos FROM ({NUMBERED}) WHERE pos >= 17 AND pos < (SELECT count(*) FROM events) - 5 AND (pos - 17) % 3 = 0")
def _(spark, sf):
    return B.batch_slice(_events(spark, sf, "value"), "event_id", 17, -5, 3)


@query("batch_union_columns", "SELECT event_id, value, event_type, user_id FROM events")
def _(spark, sf):
    return B.batch_union_columns(_events(spark, sf, "value", "event_type"), _events(spark, sf, "value", "user_id"), "event_id")


@query("batch_concat", "SELECT event_id, value FROM events UNION ALL SELECT event_id, value FROM events WHERE event_type = 'click'")
def _(spark, sf):
    return B.batch_concat(_events(spark, sf, "value"), table(spark, sf, "events").where("event_type = 'click'").select("event_id", "value"))


@query("batch_reorder", f"WITH {PERM} SELECT event_id, value, new_pos FROM events JOIN perm USING (event_id)")
def _(spark, sf):
    perm = hash_positions(_events(spark, sf), "event_id", "3", "new_pos")
    return B.batch_reorder(_events(spark, sf, "value"), perm, "event_id")


@query("inverse_permutation", f"WITH {PERM}, p AS (SELECT pos, new_pos FROM perm JOIN ({NUMBERED}) USING (event_id)) SELECT new_pos AS pos, pos AS new_pos FROM p")
def _(spark, sf):
    numbered = B.positions(_events(spark, sf), "event_id")
    perm = hash_positions(numbered, "event_id", "3", "new_pos")
    return B.inverse_permutation(perm, "pos", "new_pos")


@query("batch_repeat_interleave", f"SELECT event_id, CAST(rep AS INTEGER) AS rep, pos * 3 + rep AS new_pos FROM ({NUMBERED}), range(3) r(rep)")
def _(spark, sf):
    return B.batch_repeat(_events(spark, sf), 3, "event_id")


@query("batch_repeat_tile", f"SELECT event_id, CAST(rep AS INTEGER) AS rep, rep * (SELECT count(*) FROM events) + pos AS new_pos FROM ({NUMBERED}), range(3) r(rep)")
def _(spark, sf):
    return B.batch_repeat(_events(spark, sf), 3, "event_id", interleave=False)


@query("batch_chunk", f"SELECT event_id, pos, pos // ((SELECT count(*) FROM events) // 8) AS chunk FROM ({NUMBERED})")
def _(spark, sf):
    return B.batch_chunk(_events(spark, sf), "event_id", 8)




@query("pad_to_divisor", """
WITH n AS (SELECT count(*) AS n FROM events), e AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM events)
SELECT event_id, pos, false AS is_pad FROM e
UNION ALL SELECT event_id, n + pos, true FROM e, n WHERE pos < (4096 - n % 4096) % 4096 AND n >= 4096
UNION ALL SELECT event_id, n + j, true FROM n, unnest(range(CASE WHEN n < 4096 THEN 4096 - n ELSE 0 END)) u(j), e WHERE e.pos = j % n""")
def _(spark, sf):
    return B.pad_to_divisor(_events(spark, sf), "event_id", 4096)


@query("unpad", "SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM events")
def _(spark, sf):
    return B.unpad(B.pad_to_divisor(_events(spark, sf), "event_id", 4096))


@query("fold_unfold", """
WITH e AS (SELECT event_id, event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS pos FROM events)
SELECT event_type, pos // 16 AS chunk, pos % 16 AS pos, event_id, value,
       count(*) OVER (PARTITION BY event_type, pos // 16) AS folded FROM e""")
def _(spark, sf):
    folded = B.fold(_events(spark, sf, "event_type", "value"), "event_id", ["value"], 16, ["event_type"])
    folded = folded.withColumn("folded", F.size("event_id").cast("bigint"))
    out = B.unfold(folded, ["event_type", "chunk", "folded"], ["event_id", "value"])
    return out.withColumn("pos", F.col("pos").cast("bigint"))


@query("list_of_dict_to_columns", "SELECT conv_id, turn, role, text FROM conversations")
def _(spark, sf):
    messages = build_conversation_messages(table(spark, sf, "conversations"), "conv_id", "turn", "role", "text")
    return messages.select("conv_id", F.inline("messages"))


@query("flatten_dict_columns", """
SELECT event_id, event_type AS "meta.type", user_id AS "meta.user.id", value AS "score" FROM events""")
def _(spark, sf):
    nested = table(spark, sf, "events").select(
        "event_id", F.struct(F.col("event_type").alias("type"), F.struct(F.col("user_id").alias("id")).alias("user")).alias("meta"),
        F.col("value").alias("score"),
    )
    return flatten_columns(nested, ".")


@query("head_limit", "SELECT event_id, value FROM events ORDER BY event_id LIMIT 500")
def _(spark, sf):
    return _events(spark, sf, "value").orderBy("event_id").limit(500)


@query("sample_seeded", views="ev", oracle="""
, q AS (SELECT DISTINCT question_idx FROM ev), p AS (SELECT question_idx FROM q ORDER BY md5('42:' || question_idx), question_idx LIMIT 20)
SELECT sample_id, track, question_idx FROM ev WHERE question_idx IN (SELECT question_idx FROM p)""")
def _(spark, sf):
    e = ev(spark, sf).select("sample_id", "track", "question_idx")
    picked = B.sample_by_hash(e.select("question_idx").distinct(), "question_idx", 20, 42)
    return e.join(F.broadcast(picked), "question_idx", "left_semi")


@query("sample_val_generations", views="ev", oracle="""
SELECT sample_id, output, value FROM ev ORDER BY md5('42:' || sample_id), sample_id LIMIT 100""")
def _(spark, sf):
    return B.sample_by_hash(ev(spark, sf).select("sample_id", "output", "value"), "sample_id", 100, 42)


@query("sample_first_n_per_source", views="ev", oracle="""
SELECT sample_id, data_source FROM ev QUALIFY row_number() OVER (PARTITION BY data_source ORDER BY sample_id) <= 7""")
def _(spark, sf):
    return B.sample_first_n(ev(spark, sf).select("sample_id", "data_source"), ["data_source"], "sample_id", 7)


@query("sample_by_correctness", views="ev", oracle="""
, p AS (SELECT track, question_idx, count(*) AS n, count(*) FILTER (k % 10 = ground_truth) AS c FROM ev GROUP BY ALL),
t AS (SELECT track || ':' || question_idx AS uid, CASE WHEN c = 0 THEN 'all wrong' ELSE 'some right' END AS outcome FROM p)
SELECT outcome, uid FROM t QUALIFY row_number() OVER (PARTITION BY outcome ORDER BY md5('5:' || uid), uid) = 1""")
def _(spark, sf):
    hit = (F.col("k") % 10 == F.col("ground_truth"))
    p = ev(spark, sf).groupBy("track", "question_idx").agg(F.count_if(hit).alias("c")).select(
        F.concat_ws(":", "track", F.col("question_idx").cast("string")).alias("uid"),
        F.when(F.col("c") == 0, "all wrong").otherwise("some right").alias("outcome"),
    )
    order = F.struct(B.hash_order(F.col("uid"), "5"), "uid")
    return p.groupBy("outcome").agg(F.min_by("uid", order).alias("uid"))


@query("split_shuffled_fixed_count", """
SELECT event_id, row_number() OVER (ORDER BY md5('42:' || event_id), event_id) - 1 AS rank,
       CASE WHEN row_number() OVER (ORDER BY md5('42:' || event_id), event_id) <= 600 THEN 'train' ELSE 'test' END AS split FROM events""")
def _(spark, sf):
    return B.split_fixed_count(_events(spark, sf), "event_id", 600, 42)


EPOCHS = """
WITH e AS (SELECT event_id, CAST(epoch AS INTEGER) AS epoch,
    row_number() OVER (PARTITION BY epoch ORDER BY md5('1:' || epoch || ':' || event_id), event_id) - 1 AS rank
  FROM events, range(2) r(epoch))
"""


@query("epoch_batches", EPOCHS + """
SELECT event_id, epoch, rank, rank // 64 AS batch FROM e WHERE rank // 64 < (SELECT count(*) FROM events) // 64""")
def _(spark, sf):
    return B.epoch_batches(_events(spark, sf), "event_id", 64, 2, 1)


@query("epoch_batches_in_order", f"""
SELECT event_id, CAST(epoch AS INTEGER) AS epoch, pos AS rank, pos // 64 AS batch FROM ({NUMBERED}), range(2) r(epoch)
WHERE pos // 64 < (SELECT count(*) FROM events) // 64""")
def _(spark, sf):
    return B.epoch_batches(_events(spark, sf), "event_id", 64, 2, 1, shuffle=False)


@query("resume_from_snapshot", EPOCHS + """
SELECT event_id, rank, rank // 64 AS batch FROM e
WHERE epoch = 0 AND rank >= 320 AND rank // 64 < (SELECT count(*) FROM events) // 64""")
def _(spark, sf):
    return B.resume_from_snapshot(B.epoch_batches(_events(spark, sf), "event_id", 64, 1, 1), 320).drop("epoch")


@query("shard_round_robin", """
WITH e AS (SELECT event_id, row_number() OVER (ORDER BY md5('9:' || event_id), event_id) - 1 AS rank FROM events)
SELECT event_id, rank, CAST(rank % 7 AS INTEGER) AS shard FROM e WHERE rank < (SELECT count(*) FROM events) // 7 * 7""")
def _(spark, sf):
    return B.shard_round_robin(_events(spark, sf), "event_id", 7, 9)


BATCHED_DOCS = """
WITH r AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY md5('7:0:' || doc_id), doc_id) - 1 AS rank FROM documents),
b AS (SELECT doc_id, n_chars, rank, rank // 32 AS batch FROM r WHERE rank // 32 < (SELECT count(*) FROM documents) // 32)
"""


def _batched_docs(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    return B.epoch_batches(d, "doc_id", 32, 1, 7).drop("epoch")


@query("seqlen_balance_kk")
def _(spark, sf):
    return L.seqlen_balance_kk(_batched_docs(spark, sf), ["batch"], "rank", "n_chars", 4)


@query("seqlen_balance_kk_equal")
def _(spark, sf):
    return L.seqlen_balance_kk(_batched_docs(spark, sf), ["batch"], "rank", "n_chars", 4, equal_size=True)


# Each item goes to the first lightest part; the recursion walks the items of all batches in step.
@query("seqlen_balance_greedy", BATCHED_DOCS.replace("WITH r AS", "WITH RECURSIVE r AS", 1) + """
, w AS (SELECT batch, -1::BIGINT AS i, [0, 0, 0, 0]::BIGINT[] AS sums, 0 AS part, 0::BIGINT AS doc_id, 0::BIGINT AS n_chars, 0::BIGINT AS rank FROM b GROUP BY batch
  UNION ALL
  SELECT w.batch, w.i + 1, list_transform(range(1, 5), lambda j: w.sums[j] + CASE WHEN j = list_position(w.sums, list_min(w.sums)) THEN b.n_chars ELSE 0 END),
    CAST(list_position(w.sums, list_min(w.sums)) - 1 AS INTEGER), b.doc_id, b.n_chars, b.rank FROM w JOIN b ON b.batch = w.batch AND b.rank = w.batch * 32 + w.i + 1)
SELECT doc_id, n_chars, rank, batch, part FROM w WHERE i >= 0""")
def _(spark, sf):
    return L.seqlen_balance_greedy(_batched_docs(spark, sf), ["batch"], "rank", "n_chars", 4)


SNAKE = BATCHED_DOCS + """
, o AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY n_chars DESC, rank) - 1 AS i FROM b),
s AS (SELECT doc_id, n_chars, rank, batch, CAST(CASE WHEN i // 4 % 2 = 0 THEN i % 4 ELSE 3 - i % 4 END AS INTEGER) AS part FROM o)
"""


@query("seqlen_balance_snake", SNAKE + "SELECT * FROM s")
def _(spark, sf):
    return L.snake(_batched_docs(spark, sf), ["batch"], "rank", "n_chars", F.lit(4))


@query("seqlen_balance_report", SNAKE + """
, x AS (SELECT batch, (rank % 32) // 8 AS slice, sum(n_chars) AS s FROM b GROUP BY ALL),
y AS (SELECT batch, part, sum(n_chars) AS s FROM s GROUP BY ALL),
x2 AS (SELECT batch, min(s) AS mn, max(s) AS mx, sum(s) AS t FROM x GROUP BY batch),
y2 AS (SELECT batch, min(s) AS bn, max(s) AS bx FROM y GROUP BY batch)
SELECT batch, CAST(mn AS BIGINT) AS "min", CAST(mx AS BIGINT) AS "max", CAST(mx - mn AS BIGINT) AS minmax_diff,
       CAST(bn AS BIGINT) AS balanced_min, CAST(bx AS BIGINT) AS balanced_max, CAST(t AS DOUBLE) / 4 AS mean
FROM x2 JOIN y2 USING (batch)""")
def _(spark, sf):
    parts = L.snake(_batched_docs(spark, sf), ["batch"], "rank", "n_chars", F.lit(4)).withColumn("place", F.col("rank") % 32)
    return L.seqlen_balance_report(parts, ["batch"], "place", "n_chars", 4)


@query("micro_batch_by_tokens", BATCHED_DOCS + """
, k AS (SELECT *, CAST(ceil(sum(n_chars) OVER (PARTITION BY batch) / 200000.0) AS BIGINT) AS k,
              row_number() OVER (PARTITION BY batch ORDER BY n_chars DESC, rank) - 1 AS i FROM b)
SELECT doc_id, n_chars, rank, batch, CAST(CASE WHEN i // k % 2 = 0 THEN i % k ELSE k - 1 - i % k END AS INTEGER) AS part FROM k""")
def _(spark, sf):
    return L.micro_batch_by_tokens(_batched_docs(spark, sf), ["batch"], "rank", "n_chars", 200_000)


# Set operations over questions.

RIGHT = """
, s AS (SELECT track, question_idx, count(*) FILTER (k % 10 = ground_truth) AS c, count(*) AS n FROM ev GROUP BY ALL)
"""


def _solved(spark, sf):
    hit = F.col("k") % 10 == F.col("ground_truth")
    return ev(spark, sf).groupBy("track", "question_idx").agg(F.count_if(hit).alias("c"), F.count(F.lit(1)).alias("n"))


def _questions(df, where):
    return df.where(where).select("question_idx")


@query("concat_splits", """
SELECT doc_id, text, 'labelled' AS split FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, text, 'rest' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    keys = table(spark, sf, "labels").select("doc_id")
    return B.batch_concat(
        d.join(keys, "doc_id", "left_semi").withColumn("split", F.lit("labelled")),
        d.join(keys, "doc_id", "left_anti").withColumn("split", F.lit("rest")),
    )


@query("intersect_right", views="ev", oracle=RIGHT + """
SELECT question_idx FROM s WHERE track = 'A' AND c >= 6 INTERSECT SELECT question_idx FROM s WHERE track = 'B' AND c >= 6""")
def _(spark, sf):
    s = _solved(spark, sf)
    return _questions(s, "track = 'A' and c >= 6").intersect(_questions(s, "track = 'B' and c >= 6"))


@query("intersect_wrong", views="ev", oracle=RIGHT + """
SELECT question_idx FROM s WHERE track = 'A' AND c < 8 INTERSECT SELECT question_idx FROM s WHERE track = 'B' AND c < 8""")
def _(spark, sf):
    s = _solved(spark, sf)
    return _questions(s, "track = 'A' and c < 8").intersect(_questions(s, "track = 'B' and c < 8"))


@query("except_only_one", views="ev", oracle=RIGHT + """
SELECT question_idx FROM s WHERE track = 'B' AND c >= 6 EXCEPT SELECT question_idx FROM s WHERE track = 'A' AND c >= 6""")
def _(spark, sf):
    s = _solved(spark, sf)
    return _questions(s, "track = 'B' and c >= 6").exceptAll(_questions(s, "track = 'A' and c >= 6"))


@query("union_sets_hard", views="ev", oracle=RIGHT + """
SELECT question_idx FROM s WHERE c < 4 UNION SELECT question_idx FROM s WHERE c * 10 < n
UNION SELECT question_idx FROM ev WHERE k % 10 = ground_truth AND response_length > 480""")
def _(spark, sf):
    s = _solved(spark, sf)
    late = ev(spark, sf).where("k % 10 = ground_truth and response_length > 480")
    return _questions(s, "c < 4").union(_questions(s, "c * 10 < n")).union(late.select("question_idx")).distinct()


@query("join_membership_semi_anti", views="ev", oracle=RIGHT + """
, w AS (SELECT DISTINCT question_idx FROM s WHERE c < 6)
SELECT sample_id, CASE WHEN question_idx IN (SELECT question_idx FROM w) THEN 'wrong' ELSE 'correct' END AS side FROM ev""")
def _(spark, sf):
    wrong = _questions(_solved(spark, sf), "c < 6").distinct()
    e = ev(spark, sf).select("sample_id", "question_idx")
    return B.batch_concat(
        e.join(wrong, "question_idx", "left_semi").select("sample_id", F.lit("wrong").alias("side")),
        e.join(wrong, "question_idx", "left_anti").select("sample_id", F.lit("correct").alias("side")),
    )
