"""Text expressions: trimming, content extraction, masking, block ids, labels, template patterns.

Patterns are written for Python's ``re`` and run in the JVM. The prefix ``(?dU)`` gives Java the same
reading: only a line feed ends a line, and classes such as ``\\d`` and ``\\b`` follow Unicode.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

FLAGS = "(?dU)"
# Every character that Python counts as white space.
WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
# What stands in for bytes that are not UTF-8.
REPLACEMENT_CHARACTER = "\ufffd"

DEFAULT_BLOCK_ID = r"(blk_-?\d+)"
UNKNOWN = "<UNK>"
PADDING = "<PAD>"
WILDCARD = "<*>"

# Templates made only of register dumps, hexadecimal words or numbers carry no event.
NOISE_PATTERNS = (
    r"^r\d+=0x[0-9a-fA-F]+",
    r"^fpr\d+=0x[0-9a-fA-F]+",
    r"^esr=0x[0-9a-fA-F]+",
    r"^0x[0-9a-fA-F\s]+$",
    r"^[\d\s\.]+$",
)


def java_pattern(pattern: str) -> str:
    """A pattern for the JVM; raises ``re.error`` at once when Python cannot compile it."""
    re.compile(pattern)
    return FLAGS + pattern.replace("(?P<", "(?<")


def java_replacement(mask: str) -> str:
    """A replacement string for the JVM: ``\\1`` becomes a group reference, everything else is literal."""
    parts = re.split(r"\\(\d+)", mask)
    literal = [p.replace("\\", "\\\\").replace("$", "\\$") for p in parts[::2]]
    groups = [f"${g}" for g in parts[1::2]] + [""]
    return "".join(text + group for text, group in zip(literal, groups))


def trimmed(line: Column) -> Column:
    """The line without surrounding white space and without undecodable bytes."""
    valid = F.when(F.is_valid_utf8(line), line).otherwise(
        F.translate(F.make_valid_utf8(line), REPLACEMENT_CHARACTER, "")
    )
    return F.btrim(valid, F.lit(WHITESPACE))


def is_blank(line: Column) -> Column:
    """Whether nothing is left of the line; a line that starts with a printable ASCII sign needs no closer look."""
    return F.when(F.left(line, F.lit(1)).between("!", "~"), False).otherwise(F.length(trimmed(line)) == 0)


def content(line: Column, pattern: str | None = None) -> Column:
    """The last group of ``pattern`` matched at the start of the line, else the whole line."""
    groups = re.compile(pattern).groups if pattern else 0
    if not groups:
        return line
    # A match takes the rest of the line along and leaves its last group; a miss leaves the line as it is.
    # One expression, so that plans which repeat it stay cheap.
    return F.regexp_replace(line, F.lit(java_pattern(f"^(?:{pattern})(?s:.*)")), F.lit(f"${groups}"))


def masked(text: Column, masks: Iterable[Mapping[str, str] | tuple[str, str]] = ()) -> Column:
    """Apply ``(pattern, mask)`` rules in order, each to the result of the one before."""
    for rule in masks:
        pattern, mask = (rule["pattern"], rule["mask"]) if isinstance(rule, Mapping) else rule
        text = F.regexp_replace(text, F.lit(java_pattern(pattern)), F.lit(java_replacement(mask)))
    return text


def block_id(text: Column, pattern: str = DEFAULT_BLOCK_ID) -> Column:
    """Group 1 of the first match, or NULL."""
    return F.nullif(F.regexp_extract(text, java_pattern(pattern), 1), F.lit(""))


def alert_tag_label(line: Column) -> Column:
    """0 for lines whose first field is ``-``, 1 for lines that start with an alert tag."""
    return F.when(F.rlike(line, F.lit(r"^-(?:\s|$)")), 0).otherwise(1)


def label_value(label: Column) -> Column:
    """Labels in any accepted form (1, 1.0, '1', 'Anomaly', true) as 0 or 1."""
    text = label.cast("string")
    return F.when(text.isin("Anomaly", "1", "true"), 1).when(text.try_cast("double") == 1, 1).otherwise(0)


def is_noise(template: Column) -> Column:
    return F.coalesce(F.rlike(template, F.lit(java_pattern("|".join(NOISE_PATTERNS)))), F.lit(False))


def shortened(text: Column, width: int = 60) -> Column:
    return F.when(F.length(text) > width, F.concat(F.left(text, F.lit(width)), F.lit("..."))).otherwise(text)


def template_pieces(template: str, wildcards: Sequence[str]) -> list[str]:
    """The literal stretches of a template between its wildcards."""
    return re.split("|".join(re.escape(w) for w in wildcards), template)


def template_pattern(template: str, wildcards: Sequence[str] = (WILDCARD, "[*]")) -> str:
    """A pattern that matches whole messages of the template; white space in literals is flexible."""
    literal = [r"\s+".join(re.escape(w) for w in re.split(r"\s+", p)) for p in template_pieces(template, wildcards)]
    return r"^\s*" + ".*?".join(literal) + r"\s*$"
