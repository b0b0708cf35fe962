"""Explicit schemas (DDL) of the entity tables and of the landed files; nothing is inferred."""

from __future__ import annotations

SOURCE = "source_id string, name string, source_type string, credibility_class string, credibility double, is_trust_seed boolean"
ISSUER = "issuer_id string, name string, listing_status string, status_valid_from string, status_valid_to string, knowledge_time string"
SECURITY = "security_id string, issuer_id string, share_class string"
LISTING = "listing_id string, security_id string, ticker string, venue string"
ALIAS = "surface_form string, lang string, target_kind string, target_id string, valid_from string, valid_to string"
DOCUMENT = "doc_id string, source_id string, lang string, text string, event_time string, ingest_time string"
EXTRACTED = "subject_surface string, relation string, object_text string, claim_key string, stance string, source_span string, span_start int, span_end int"
EXTRACTION = f"claims array<struct<{EXTRACTED}>>, elevated_entities array<string>"
MASTER = (
    f"issuers array<struct<{ISSUER}>>, securities array<struct<{SECURITY}>>, listings array<struct<{LISTING}>>, "
    f"aliases array<struct<{ALIAS}>>, must_not_link array<array<string>>"
)
CLAIM = (
    "claim_id string, doc_id string, source_id string, source_credibility double, subject_id string, relation string, object_text string, "
    "claim_key string, stance string, source_span string, span_start int, span_end int, event_time string, ingest_time string, knowledge_time string, "
    "span_grounded boolean, dup_group_id string, is_amplifier boolean, superseded_by string, contradicts string"
)
MENTION = "mention_id string, surface_form string, resolved_target_id string, resolution_status string, source_span string, event_time string, ingest_time string, knowledge_time string, dup_group_id string, is_amplifier boolean"
RESULT = "entity_id string, as_of string, ppr_naive double, ppr_credible double, rank_naive int, rank_credible int, k_effective int, m_raw int, trusted_share double, flags map<string,array<string>>"
SUBMISSIONS = (
    "cik string, name string, tickers array<string>, sic string, sicDescription string, formerNames array<struct<name:string,`from`:string,`to`:string>>, "
    "filings struct<recent:struct<accessionNumber:array<string>,form:array<string>,filingDate:array<string>,acceptanceDateTime:array<string>,items:array<string>>>"
)
NEWS_ITEMS = "items array<struct<title:string,originallink:string,link:string,description:string,pubDate:string>>"
RSS_ITEM = "title string, link string, description string, pubDate string, source struct<_VALUE:string,_url:string>"
CORP = "corp_code string, corp_name string, stock_code string, modify_date string"
HISTORY = "as_of string, tickers map<string,struct<sector:string,closes:array<double>,dates:array<string>>>"
RATINGS = "issuer_id string, consensus struct<strong_buy:int,buy:int,hold:int,sell:int,strong_sell:int>, changes array<struct<date:string,firm:string,to_grade:string,from_grade:string,action:string>>"
RELATIONS = ("supplies", "competes_with", "owns", "guides_to", "risk_flag", "sentiment")
