"""Schemas of the logical tables, as DDL. Objects keyed by data are maps, never structs."""

from __future__ import annotations

SECTION = "struct<header:string,text:string>"
PAPER = "paperId string, externalIds map<string,string>, title string, abstract string, year int, venue string, referenceCount int, citationCount int, publicationTypes array<string>, authors array<struct<name:string>>"
QA = (
    "id string, question_type string, depth int, reasoning_type string, cognitive_skill string, venue string, consensus_tier string, question string, options array<string>, correct_index int, "
    "distractor_types array<string>, seed_paper_id string, seed_arxiv_id string, seed_title string, gold_paper_ids array<string>, gold_arxiv_ids array<string>, bridge_paper_ids array<string>, "
    "bridge_arxiv_ids array<string>, filter_agreement string, bridge_necessary boolean"
)
GRAPHS = "sample_id string, seed string, nodes map<string,struct<title:string,arxivId:string,year:int,abstract:string,authors:array<struct<name:string>>>>, edges map<string,array<string>>"
POOL = f"arxiv_id string, title string, sections array<{SECTION}>, tables array<struct<caption:string,rows:array<array<string>>>>"
REFERENCES = "citing string, pos int, contexts array<string>, intents array<string>, isInfluential boolean, citedPaper struct<paperId:string,externalIds:map<string,string>,title:string,year:int,citationCount:int>"
VOTES = "qid string, filter string, paper string, provider string, answer string"
TRIAGE_VERDICTS = "auditor string, case_id string, case_type string, sample_id string, verdict string, repoint_to string, claimed_section string"
CALL = "struct<id:string,name:string,args:map<string,string>>"
RESULT = "struct<name:string,args:map<string,string>,output:string,cost:int>"
TRAJECTORIES = (
    "sample_id string, model string, question_type string, depth int, predicted_index int, correct_index int, is_correct boolean, terminated_by string, "
    f"turns array<struct<turn:int,role:string,content:string,tool_calls:array<{CALL}>,tool_results:array<{RESULT}>,budget_before:int,budget_after:int,timestamp:double,prompt_tokens:int,completion_tokens:int>>, "
    "total_prompt_tokens bigint, total_completion_tokens bigint, cache_read_tokens bigint, cache_creation_tokens bigint, retry_count int, wall_time_s double"
)
