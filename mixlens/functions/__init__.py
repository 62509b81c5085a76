"""Column functions: text as Python reads it, ROUGE-L, fixed vocabularies."""

from mixlens.functions.rouge import rouge_l
from mixlens.functions.text import chart_cell, is_json, split_list, without_quotes, word_count, wrapped

__all__ = ["chart_cell", "is_json", "rouge_l", "split_list", "without_quotes", "word_count", "wrapped"]
