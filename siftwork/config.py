"""Settings that change results, with the reference defaults."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


# Names and defaults of the settings.
@dataclass(frozen=True)
class Config:
    static_threshold: float = 0.8
    text_threshold: float = 0.01
    max_sample_lines: int = 100
    max_examples_per_placeholder: int = 10
    min_examples_per_placeholder: int = 3
    min_ngram_size: int = 2
    max_ngram_size: int = 4
    min_phrase_length: int = 3
    json_overhead_tokens: int = 50
    footprint_base_overhead_tokens: int = 20
    footprint_svo_metrics_tokens: int = 10
    min_entropy_sample_size: int = 5
    min_entropy_display: float = 0.01
    max_entropy_display: float = 0.99
    entropy_small_sample_threshold: int = 5
    max_examples_for_entropy: int = 10
    min_sentence_words: int = 2
    min_sentence_words_alt: int = 3
    min_sentence_length: int = 8
    min_pivot_variation: int = 2
    max_pivot_variation: int = 50
    max_common_pivots: int = 10
    markdown_preview_length: int = 100
    max_tabular_sample_rows: int = 10_000
    max_csv_scan_rows: int = 10_000
    max_csv_max_distinct_per_column: int = 500_000
    max_zip_entry_uncompressed_bytes: int = 52_428_800
    ignore_patterns: tuple[str, ...] = (".DS_Store", "Thumbs.db", "desktop.ini", "ehthumbs.db", "*.swp", "*.swo", "*.tmp", "*~", "~$*")
    ignore_hidden_files: bool = True
    small_file_threshold_bytes: int = 100_000
    large_file_threshold_bytes: int = 1_000_000
    skip_metadata: bool = False

    def __post_init__(self):
        for name in ("static_threshold", "text_threshold"):
            if not 0.0 <= getattr(self, name) <= 1.0:
                raise ValueError(f"{name} must lie between 0 and 1")
        if not 1 <= self.min_ngram_size <= self.max_ngram_size:
            raise ValueError("n-gram sizes must be positive and in order")


def configured(**overrides) -> Config:
    """The defaults with overrides; unknown names are an error."""
    unknown = set(overrides) - {f.name for f in fields(Config)}
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return replace(Config(), **overrides)
