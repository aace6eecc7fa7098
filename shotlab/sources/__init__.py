"""Scans, task registry and the driver-table task fixtures."""

from shotlab.sources.registry import Task, task, template, task_key, word_lists, PATTERNS
from shotlab.sources.checked import Checked, checked_scan
from shotlab.sources.labelled import read_labelled, resolve_text, hash_split, task_rows

__all__ = ["Task", "task", "template", "task_key", "word_lists", "PATTERNS",
           "Checked", "checked_scan",
           "read_labelled", "resolve_text", "hash_split", "task_rows"]
