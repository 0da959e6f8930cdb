"""Schemas of the JSON records that the engine reads and writes. Every field may be null; unknown fields are left out."""

from __future__ import annotations

STRINGS, LONGS = "array<string>", "array<bigint>"
TRIPLES, PATHS = f"array<{STRINGS}>", f"array<array<{STRINGS}>>"

#: A question with its topics and, where known, its answers. data_id may be a number in files and is read as text.
QUESTION = f"""data_id string, query string, explicit_query string, implicit_query string, bare_query string, topic_entities map<string,string>,
    answer_entity struct<id:bigint,name:string,type:string>, answer_ids {LONGS}, valid_answer_ids {LONGS}, num_hops int, path_node_ids {LONGS},
    triplets {TRIPLES}, node_metadata array<struct<id:bigint,name:string,type:string>>, template_id string, query_type string"""

TEMPLATE = f"id string, num_hops int, metapath string, query_template string, topic_entity_types {STRINGS}, answer_type string, num_topic_entities int, is_compound boolean, note string"

NODES = "node_id bigint, name string, type string, details map<string,string>"
EDGES = "src bigint, dst bigint, rel_id int"
RELATIONS = "rel_id int, relation string, description string"

#: Paths of one topic of a question.
BLOCK = f"""struct<topic_name:string,topic_type:string,gt_subpath:{LONGS},gt_relations:{STRINGS},gt_types:{STRINGS},role:string,paths:{PATHS},
    path_node_ids:array<{LONGS}>,path_types:array<{STRINGS}>,path_relations:array<{STRINGS}>,scores:array<double>,path_hops:array<int>,
    corridor_k_used:int,fallback:boolean,fallback_reason:string,ppr_top_ids:{LONGS},paths_by_hop:map<string,{PATHS}>,
    path_node_ids_by_hop:map<string,array<{LONGS}>>,scores_by_hop:map<string,array<double>>,path_types_by_hop:map<string,array<{STRINGS}>>,
    path_relations_by_hop:map<string,array<{STRINGS}>>>"""
PATH_BANK = f"""data_id string, query string, topic_entities map<string,string>, answer_entity struct<id:bigint,name:string,type:string>, answer_ids {LONGS},
    primary_answer_id bigint, per_topic map<string,{BLOCK}>"""

RESULT = f"""data_id string, path_node_ids {LONGS}, template_id string, query_type string, question string, answer_ids {LONGS}, results string,
    reasoning_chains array<{PATHS}>, explored_entities map<string,double>, variant string, entity_scoring_mode string, relation_scoring_mode string,
    pathbank_mode string, pathbank_paths_by_hop map<string,int>, pathbank_chosen_hop int, pathbank_exec_width int, pathbank_paths_used int,
    pathbank_paths_success int, pathbank_fallback boolean, triplets_before_dedup int, triplets_after_dedup int, predicted_answer_type string,
    predicted_answer_type_raw string, results_original string, cot_fallback_used boolean"""
