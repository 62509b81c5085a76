"""Reading and writing relations."""

from mixlens.sources.tables import environment_value, load_config, load_lexicon, load_split, load_templates, read_checkpoint, read_lines, read_strict, write_lines, write_report
from mixlens.sources.versions import current, replace

__all__ = ["environment_value", "load_config", "load_lexicon", "load_split", "load_templates", "read_checkpoint", "read_lines", "read_strict", "current", "replace", "write_lines", "write_report"]
