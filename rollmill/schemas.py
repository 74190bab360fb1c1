"""Declared schemas: the driver's tables and the shapes the operators exchange."""

TABLES = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "benchmark": "item_id bigint, text string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
}

MESSAGE = "struct<role:string,content:string>"

PROMPT_ROW = (
    f"data_source string, prompt array<{MESSAGE}>, ability string, level string, "
    "reward_model struct<style:string,ground_truth:string>, "
    "extra_info struct<split:string,index:bigint,answer:string,question:string>"
)

ROLLOUT_RECORD = "input string, output string, score double, ref_score string, index bigint, split string, source string"

PER_PROBLEM = "problem_idx bigint, ground_truth string, n_samples bigint, n_correct bigint, accuracy double"

HISTORY = "_step bigint, metric string, value double, row_id bigint"
RUN_METADATA = "id string, name string, created_at string"
