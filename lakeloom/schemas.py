"""Schemas of the tables the pipeline reads and writes, and its settings."""

from __future__ import annotations

from dataclasses import dataclass, field

SECTION = "struct<heading:string,content:string>"
CORPUS = f"link string, title string, sections array<{SECTION}>, doc_id string"
META = "struct<source:string,page_title:string,section_heading:string,combined_headings:array<string>,aggregated_content:string,section_char_len:int>"
HQE_RECORD = f"doc_id string, section_index int, language string, gen_model string, prompt_version string, generated_at string, questions array<string>, meta {META}"
QUESTION_META = "row_idx bigint, doc_id string, section_index int, question string, source string, page_title string, section_heading string, combined_headings array<string>, aggregated_content string, section_char_len int"
PAGE = "url string, html string"


@dataclass(frozen=True)
class Budget:
    """Questions for short, middling and long sections."""

    small: int = 3
    medium: int = 5
    large: int = 8

    def bounds(self) -> tuple[int, int, int]:
        return self.small, self.medium, self.large


@dataclass(frozen=True)
class Settings:
    budget: Budget = field(default_factory=Budget)
    max_chars: int = 2500
    duplicate_at: float = 0.8
    top_k: int = 10
    min_score: float = 0.6
    per_section_chars: int = 900
    total_chars: int = 2500
    embed_batch: int = 128
    language_strategy: str = "auto"
