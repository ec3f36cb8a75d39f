"""Schemas of the tables that the engine reads and writes."""

from __future__ import annotations

TASK = "data_source string, agent_name string, prompt array<struct<role string, content string>>, reward_model struct<style string, ground_truth string>, extra_info map<string,string>"

TRAJECTORY = (
    "key string, uid string, session_id int, index int, partition_id string, prompts array<bigint>, responses array<bigint>, response_mask array<bigint>, "
    "input_ids array<bigint>, position_ids array<bigint>, rollout_log_probs array<float>, rm_scores array<float>, reward_score double, num_turns int, "
    "data_source string, metrics struct<generate_sequences double, tool_calls double, compute_score double, num_preempted int>, extra_fields map<string,string>, "
    "tag struct<global_steps bigint, status string, prompt_len int, response_len int, seq_len int, is_padding boolean>"
)

DIAGNOSTIC = (
    "row_id long, uid string, schema_version int, timing_metrics_version int, phase string, terminal_outcome string, final_stage string, failure_owner string, "
    "is_fake boolean, did_real_eval boolean, agent_state string, failure_detail string, events map<string,int>, timing map<string,double>, patch_length int, "
    "reward_score double, request_id string, task_id string"
)

TEST_REPORT = "test_status map<string,string>, FAIL_TO_PASS array<string>, PASS_TO_PASS array<string>"
SCORED_SAMPLE = "data_source string, uid string, reward double, acc double, pred string, num_turns int"
PREFERENCE = "prompt string, chosen string, rejected string"
DIALOG = "messages array<struct<role string, content string>>, tools string, enable_thinking boolean"
QUEUE_REQUEST = "container_id string, request_hash string, reason string, group_id int, priority int, enqueued_at double"
STEP_METRIC = "step long, metric string, value double, sample_count int, ts double"
SAMPLE_MESSAGE = "sample_id string, uid string, version long, enqueued_at timestamp, status string, payload string"
