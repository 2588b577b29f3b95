"""Schemas of the records the engine reads and writes."""

from __future__ import annotations

# The record formats, as DDL.
DIAGNOSTIC = (
    "dataset string, sample_id string, null_mode string, question string, gold string, extras variant, ans_T_I string, ans_T_null string, "
    "correct_I boolean, correct_null boolean, response_tokens array<string>, logp_I array<double>, logp_null array<double>, delta_t array<double>, "
    "T bigint, T_image_only bigint, T_null_only bigint, option_logP map<string,map<string,double>>, error string"
)
PRECOMPUTE = (
    "bucket string, sample_id string, image_paths array<string>, category string, source string, pass_rate_32b double, pass_rate_7b double, "
    "question string, gold string, ans_T_I string, correct_I boolean, trajectory_pass boolean, response_token_ids array<int>, response_tokens array<string>, "
    "teacher_logp_I array<double>, teacher_logp_null array<double>, delta_t array<double>, T bigint, extras variant, "
    "teacher_topk_log_probs_I array<array<double>>, teacher_topk_token_ids_I array<array<int>>, error string"
)
SAMPLE = "sample_id string, question string, image_paths array<string>, gold string, extras variant"
MIXTURE = "sample_id string, bucket string, question string, gold string, image_path string, extras variant"
SYNTHETIC = "sample_id string, topic string, image_path string, question string, gold string, extras variant"
IMAGE_REF = "sample_id string, unique_key string, source_tag string, image_id bigint, path string"
FINDING = "layer string, train_sample_id string, train_source string, eval_sample_id string, eval_source string, distance double, train_image_id bigint, eval_image_id bigint, train_path string, eval_path string"
VIRL = "question string, answer string, PassRate_32BTrained double, PassRate_7BBase double, category string, source string, qid string, image array<string>"
TALLY = "image string, image_id bigint, question string, question_id bigint, answer string, issimple boolean, data_source string, source string"
COCO = "categories array<struct<id:bigint,name:string>>, annotations array<struct<image_id:bigint,category_id:bigint>>, images array<struct<id:bigint,file_name:string>>"
