"""The tables of a curation session. Every schema is declared; none is inferred."""

from __future__ import annotations

from pyspark.sql.types import StructType

MESSAGES = "array<struct<role:string,content:string>>"
TABLES = {
    "pipeline_session": "id string, name string, goal string, format string, stage string, status string, seed_urls array<string>, config struct<discovered:int,selected:int,scraped:int,processed:int,generated:int,approved:int>, created_at timestamp, updated_at timestamp",
    "discovered_url": "id long, session_id string, url string, source string, selected boolean, scraped boolean, http_status int, discovered_at timestamp",
    "scraped_page": "id long, session_id string, url_id long, url string, title string, author string, published_date string, raw_path string, word_count int, scraped_at timestamp",
    "processed_chunk": "id long, session_id string, page_id long, content string, token_count int, chunk_index int, metadata struct<page_id:long,chunk_index:int,author:string,date:string,session_id:string>, created_at timestamp",
    "synthetic_sample": f"id long, session_id string, chunk_id long, format string, system_prompt string, messages {MESSAGES}, quality_score double, approved boolean, created_at timestamp",
    "export_record": "id long, session_id string, destination string, path_or_url string, format string, sample_count int, stage_snapshot string, exported_at timestamp",
}
STAGES = ("discovery", "collection", "processing", "generation", "quality", "export", "done")
STATUSES = ("active", "paused", "completed", "failed")
FORMATS = ("qa", "instruction", "conversation", "custom")
URL_SOURCES = ("sitemap", "crawl", "manual", "file")


def schema(name: str) -> StructType:
    return StructType.fromDDL(TABLES[name])
