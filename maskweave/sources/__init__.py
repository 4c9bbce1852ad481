"""Sources and sinks: files (A4/A5), rule sheets (A1–A3), vault versions."""

from maskweave.operators.rules import export_rules, import_rules, read_rulesheets
from maskweave.operators.vault import load_vault, save_vault
from maskweave.sources.files import read_texts, write_restored, write_texts

__all__ = ["export_rules", "import_rules", "read_rulesheets", "load_vault", "save_vault", "read_texts",
           "write_restored", "write_texts"]
