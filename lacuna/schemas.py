"""Schemas of the tables that cross the edge of the engine. Ids are strings, never numbers."""

from __future__ import annotations

PAPERS = "id string, title string, year int, venue string, citation_count bigint, abstract string"
GAPS = "id string, gap_type string, section_type string, gap_sentence string, paragraph_text string, confidence double"
METHODS = "id string, method_type string, method_sentence string, paragraph_text string, confidence double"
TEXTS = "id string, text string, n_chars int, blocks array<struct<role:string,text:string,size:double,bold:boolean,page:int>>, n_headings int"
SECTIONS = "id string, section_type string, heading string, section_text string"
CLUSTERS = "cluster_id int, theme_label string, n_items int, n_papers int, avg_conf double"
LABELS = "cluster_id int, theme_label string, keywords string"
PAIRS = "cluster_a int, cluster_b int, label_a string, label_b string, cosine_sim double, paper_overlap double, type_complementarity double, bridge_score double"
METRICS = "id string, stage string, metric string, value double, extra string"
SNAPSHOT = "id string, title string, abstract string, categories string, versions array<struct<version:string,created:string>>"
API_PAPER = "paperId string, title string, abstract string, year int, venue string, citationCount bigint, openAccessPdf struct<url:string>, externalIds struct<ArXiv:string>, url string"
IDEAS = "mode string, cluster_a int, cluster_b int, title string, novelty_score double, idea_confidence double"
