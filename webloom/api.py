"""Public names in one place."""

from webloom.functions.jsonld import json_ld_fields, json_ld_nodes, json_ld_profile, json_ld_schemas
from webloom.functions.metadata import extract_metadata
from webloom.functions.render import render_html
from webloom.functions.text import strip_html_to_text
from webloom.functions.urls import matches_pattern, normalize_url, passes_domain_filter, url_hash
from webloom.operators.frontier import CrawlConfig, decode_cursor, encode_cursor, page_preset
from webloom.operators.links import extract_images, links_table, with_links
from webloom.operators.politeness import fetch_schedule
from webloom.operators.robots import allowed_by_join, is_url_allowed, parse_robots
from webloom.operators.sitemaps import discover_many, discover_sitemaps, parse_sitemap
from webloom.plans.blocks import bfs_whole
from webloom.plans.crawl import bfs_levels, crawl_batch
from webloom.plans.endpoints import discover_answers, fetch_answers
from webloom.plans.many import crawl_many
from webloom.plans.recursive import sitemap_tree, walk
from webloom.plans.report import page_report, page_rows, sitemap_pages
from webloom.plans.versions import VersionedCrawl
from webloom.sources.page_store import PageStore
from webloom.sql import register_functions
from webloom.streaming.ingest import crawl_stream
from webloom.streaming.keyed import first_seen, polite_stream

__all__ = [
    "CrawlConfig", "PageStore", "VersionedCrawl", "allowed_by_join", "bfs_levels", "bfs_whole", "crawl_batch", "crawl_many", "crawl_stream", "decode_cursor", "discover_answers", "discover_many", "discover_sitemaps", "encode_cursor",
    "extract_images", "extract_metadata", "fetch_answers", "fetch_schedule", "first_seen", "is_url_allowed", "json_ld_fields", "json_ld_nodes", "json_ld_profile", "json_ld_schemas", "links_table", "matches_pattern", "normalize_url", "page_preset", "page_report", "page_rows",
    "parse_robots", "parse_sitemap", "passes_domain_filter", "polite_stream", "register_functions", "render_html", "sitemap_pages", "sitemap_tree", "strip_html_to_text", "url_hash", "walk", "with_links",
]
