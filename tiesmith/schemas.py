"""Layouts of the stage tables."""

SPAN = "struct<start:int,end:int>"
LINKS = "array<struct<start:int,end:int,surface:string,target_title:string>>"
SECTIONS = f"array<struct<heading:string,text:string,links:{LINKS}>>"
TOKENS = "array<struct<i:int,idx:int,text:string,head:int,is_space:boolean,is_stop:boolean,is_punct:boolean>>"
ENTITIES = "array<struct<start:int,end:int,label:string,text:string>>"
ATTRIBUTES = f"array<struct<attr_type:string,value:string,span:{SPAN},source:string>>"

TABLES = {
    "seed": "qid string, title string, birth_year int, death_year int, gender string",
    "fetch_log": "qid string, title string, fetched_at string, status string, revision_id bigint, error string, url string, bytes bigint, seq bigint",
    "raw_html": "qid string, html binary",
    "documents": f"doc_id string, title string, qid string, revision_id bigint, url string, fetched_at string, license string, sections {SECTIONS}",
    "title_qid": "title string, resolved_title string, qid string, fetched_at string, seq bigint",
    "qid_claims": "qid string, missing boolean, is_human boolean, birth_year int, death_year int, gender string, occupations array<string>, fetched_at string, method string, seq bigint",
    "wikidata_cache": "title string, resolved_title string, qid string, claims_resolved boolean, no_wikidata_item boolean, is_human boolean, birth_year int, death_year int, gender string, occupations array<string>, link_instances bigint, fetched_at string",
    "sentences": "doc_id string, section_idx int, sent_idx int, start int, end int, text string",
    "mentions": "mention_id string, doc_id string, section_idx int, sent_idx int, start int, end int, surface string, entity_id string, mention_type string, link_method string, confidence double",
    "entities": "qid string, canonical_name string, in_seed boolean, mention_count bigint, doc_count bigint, doc_ids array<string>, birth_year int, death_year int, gender string, occupations array<string>",
    "candidates": f"candidate_id string, doc_id string, section_idx int, sent_idx int, sentence string, head_entity_id string, tail_entity_id string, head_span {SPAN}, tail_span {SPAN}, rule string, people_in_sentence int",
    "attribute_spans": f"sentence_id string, candidate_id string, attr_type string, value string, span {SPAN}, detector string, pronoun_resolved boolean",
    "relations": f"relation_id string, sentence_id string, sentence string, participants array<struct<mention_id:string,qid:string>>, attributes {ATTRIBUTES}, coverage double, uncovered array<string>, pronoun_resolved boolean",
    "sentence_embeddings": "sentence_id string, embedding array<float>",
    "relation_clusters": "sentence_id string, cluster_id int, cluster_prob double",
    "cluster_summary": "cluster_id int, clustering_run_id string, size bigint, exemplar_sentences array<string>, sample_sentences array<string>, coherence_reviewed_by array<string>, coherence_verdict string, human_label string",
    "sweep_results": "metric string, n_neighbors int, n_components int, min_cluster_size int, cluster_selection_method string, n_sentences bigint, n_clusters bigint, n_noise bigint, noise_fraction double, largest_cluster_size bigint, largest_cluster_fraction double, top_cluster_sizes array<bigint>",
    "graph_nodes": "qid string, label string",
    "graph_edges": "a string, b string, relations array<string>",
    "typology": "type_id string, label string, definition string, direction string, cluster_ids array<int>, clustering_run_id string, wikidata_properties array<string>, examples array<string>",
}
TABLES["low_coverage_relations"] = TABLES["relations"]
