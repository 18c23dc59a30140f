"""Schemas of the tables that the engine reads and makes."""

from __future__ import annotations

EXAMPLE = "struct<dakota:string,english:string,gloss:string,notes:string>"

DICTIONARY_ENTRY = """entry_id string, headword string, definition_primary string, column int, page_number int,
source_image string, part_of_speech string, pos_full string, derived_from string, derivation_type string,
root_meaning string, definition_secondary string, inflected_forms array<string>, grammatical_notes string,
usage_notes string, example_phrases array<string>, see_also array<string>, compare_with array<string>,
line_number int, confidence double, extraction_notes string"""

PAGE = f"entries array<struct<{', '.join(':'.join(x.strip().rsplit(' ', 1)) for x in DICTIONARY_ENTRY.replace(chr(10), ' ').split(','))}>>, metadata struct<page_number:int,image_path:string>"

RULE = f"""rule_id string, rule_type string, rule_name string, rule_description string, dakota_pattern string,
english_explanation string, positive_examples array<{EXAMPLE}>, negative_examples array<{EXAMPLE}>,
verification_pattern string, source_pages array<int>, confidence double, difficulty string,
constraints string, linguistic_notes string, exceptions array<string>"""

GRAMMAR_TASK = """prompt string, answer string, info struct<task_type:string,rule_id:string,rule_type:string,
difficulty:string,source_pages:array<int>,confidence:double,base_form:string,target_form:string,dakota_text:string,
english_text:string,pattern:string,required_affixes:array<string>,special_chars:array<string>,steps:int>"""

LEXICON_TASK = """id string, task string, split string, prompt string, answer string, accepted array<string>,
info struct<entry_id:string,page:int,source_image:string,family:string,confidence:double,hops:int,target_plain:string,
target_entry_id:string,gold_tier:string>"""

CHAT = "id string, task string, messages array<struct<role:string,content:string>>"
QA = "question string, answer string, source_language string, generated_at timestamp, pair_id long"
METRICS = "step long, metrics map<string,double>"
TRACE = "run string, task_id string, group_id string, pass int, batch int, reward double, ledger map<string,double>, ts timestamp"
