"""Text functions as Spark columns (no Python): normalisation, splitting, token estimates, names.

White space, words and line ends are defined by Unicode, not by Java's ASCII defaults, so character classes are spelled
out; the same strings work in Java and in RE2.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode and Python's str.isspace define it, for use inside [...].
SPACE = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Letters, digits and underscore, for use inside [...].
LETTER = r"\p{L}\p{N}_"
SENTENCE_ENDS = ".!?¡¿…"
WORDS_A_MINUTE = 230


def replace_all(column: Column, pattern: str, to: str = "") -> Column:
    return F.regexp_replace(column, pattern, to)


def strip(column: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return replace_all(replace_all(column, f"^[{SPACE}]+"), f"[{SPACE}]+\\z")


def normalize_text(column: Column) -> Column:
    """One kind of line end, no NUL, no blanks before line ends, at most one blank line, trimmed."""
    lines = F.replace(F.replace(F.replace(column, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), F.lit("\0"), F.lit(""))
    return strip(replace_all(replace_all(lines, "[ \\t]+\\n", "\n"), "\\n{3,}", "\n\n"))


def normalize_markdown(column: Column) -> Column:
    lines = replace_all(F.replace(column, F.lit("\r\n"), F.lit("\n")), "[ \\t]+\\n", "\n")
    return strip(replace_all(lines, "\\n{3,}", "\n\n"))


def strip_markdown(column: Column) -> Column:
    """Rough Markdown to text for sanity metrics."""
    bare = replace_all(column, r"(?s)<!--.*?-->")
    bare = replace_all(bare, r"(?m)(?d)^#{1,6}[ \t]+")
    bare = replace_all(bare, r"(?m)(?d)^\|?[ \t:|-]+\|?$")
    bare = replace_all(F.replace(bare, F.lit("|"), F.lit(" ")), "[*_`]{1,3}")
    return replace_all(bare, "[ \\t]+", " ")


def escape_cell(column: Column) -> Column:
    """A table cell: pipes escaped, white space collapsed; null becomes empty."""
    return strip(replace_all(F.replace(F.coalesce(column, F.lit("")), F.lit("|"), F.lit("\\|")), f"[{SPACE}]+", " "))


def fenced(column: Column, language: str = "") -> Column:
    """A code block whose fence is longer than any run of backticks inside."""
    runs = F.transform(F.regexp_extract_all(column, F.lit("`+"), F.lit(0)), lambda r: F.length(r))
    fence = F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))
    return F.concat(fence, F.lit(language + "\n"), replace_all(column, f"[{SPACE}]+\\z"), F.lit("\n"), fence)


def words(column: Column) -> Column:
    """Runs of visible characters."""
    return F.regexp_extract_all(column, F.lit(f"[^{SPACE}]+"), F.lit(0))


def word_count(column: Column) -> Column:
    return F.size(words(column)).cast("long")


def line_count(column: Column) -> Column:
    return F.when(column == "", 0).otherwise(F.length(column) - F.length(F.replace(column, F.lit("\n"), F.lit(""))) + 1).cast("long")


def estimate_tokens(column: Column) -> Column:
    """Characters // 4, at least 1, and 0 for an empty text."""
    n = F.length(column)
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4))).cast("long")


def sentences(column: Column) -> Column:
    """Split after sentence ends that white space follows."""
    return F.split(column, f"(?<=[{SENTENCE_ENDS}])[{SPACE}]+")


def tail(column: Column, tokens: int) -> Column:
    """About the last ``tokens`` tokens, starting at a word; empty where the span holds no white space."""
    cut = F.when(F.length(column) > 4 * tokens, F.expr("''")).otherwise(column)
    part = F.substring(column, -4 * tokens, 4 * tokens)
    later = F.when(F.regexp_like(part, F.lit(f"[{SPACE}]")), replace_all(part, f"^[^{SPACE}]*[{SPACE}]")).otherwise(F.lit(""))
    return strip(F.when(F.length(column) > 4 * tokens, later).otherwise(cut))


def join_hyphenated(column: Column) -> Column:
    """``exam- ple`` to ``example``."""
    return replace_all(column, f"([{LETTER}])- ([{LETTER}])", "$1$2")


def fold_punctuation(column: Column) -> Column:
    """Curly quotes and long dashes to plain ones, bullets and no-break spaces to spaces."""
    return F.translate(column, "‘’“”–—• ", "''\"\"--  ")


def extension(column: Column) -> Column:
    """Lower-case extension with its dot, or an empty string."""
    name = F.regexp_extract(column, r"([^/\\]*)$", 1)
    return F.lower(F.regexp_extract(name, r"[^.](\.[^.]*)$", 1))


def download_name(column: Column) -> Column:
    """A file name's stem without its folder and extension and with ASCII characters alone, or ``document``."""
    stem = F.regexp_replace(F.regexp_extract(column, r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")
    bare = F.replace(F.regexp_replace(stem, r"[^\x00-\x7f]", ""), F.lit('"'), F.lit(""))
    return F.when(bare == "", "document").otherwise(bare)


def document_key(sha256: Column, ext: Column) -> Column:
    """Content address of a stored document."""
    return F.concat(F.lit("sha256/"), F.substring(sha256, 1, 2), F.lit("/"), sha256, F.coalesce(ext, F.lit("")))


def thousands(column: Column) -> Column:
    return F.format_number(column, 0)
