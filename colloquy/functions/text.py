"""Text functions as column expressions; none runs Python on the executors.

Words, digits and spaces are of Unicode; with `re2`, those of RE2, in which the queries' SQL is written.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon

# --- Fixed values: what counts as a word, a fence, a line end and a line of code ----------------
WORD = "[A-Za-z][A-Za-z'-]*"
FENCE = '(?s)```.*?```|"{3}.*?"{3}'
LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
PREPROCESSOR = r"(?d)^#\s*(?:include|pragma|define|ifn?def|if|endif|else)\b"
CODE_END = r"(?d)[;{}]\s*(?://.*)?$"
CODE_PUNCTUATION = ";{}()[]=<>+*&|#_"
# --- End of the fixed values ------------------------------------------------------------------
RE2_LINE_ENDS = LINE_ENDS.replace("\u2028\u2029", "")  # as the SQL has them


def text_of(content: Column) -> Column:
    return F.coalesce(content, F.lit(""))


def count(content: Column, pattern: str) -> Column:
    """Matches of a pattern; 0 for null."""
    return F.coalesce(F.regexp_count(content, F.lit(pattern)), F.lit(0)).cast("long")


def folded(content: Column) -> Column:
    """In lower case, with the letters that patterns take for s and k as those."""
    return F.translate(F.lower(content), "\u017f\u212a", "sk")


def count_where(content: Column, low: Column, pattern: str, needles: tuple[str, ...]) -> Column:
    """Matches of a pattern, which is tried only where the folded text has one of the needles."""
    if not needles:
        return count(content, pattern)
    return F.when(F.exists(F.array(*map(F.lit, needles)), lambda x: F.contains(low, x)), count(content, pattern)).otherwise(F.lit(0).cast("long"))


def _dotless(content: Column) -> Column:
    """Without the two letters that Java takes for an i and RE2 doesn't; no pattern tells the new one from those."""
    return F.translate(content, "\u0130\u0131", "\u00ef\u00ef")


def family(content: Column, profile: str, name: str, low: Column | None = None, re2: bool = False) -> Column:
    """Markers of a family. `low` is the folded content, a column of its own where many families are counted."""
    low = folded(content) if low is None else low
    return count_where(_dotless(content) if re2 else content, low, lexicon.pattern(profile, name, re2), lexicon.needles(tuple(lexicon.profile(profile)[name])))


def digits(content: Column, re2: bool = False) -> Column:
    return count(content, "[0-9]" if re2 else r"(?U)\d")


def raw_tokens(content: Column) -> Column:
    return F.regexp_extract_all(text_of(content), F.lit(WORD), F.lit(0))


def tokens(content: Column) -> Column:
    return F.transform(raw_tokens(content), F.lower)


def content_set(toks: Column) -> Column:
    """Different tokens that aren't stopwords."""
    return F.array_except(toks, F.array(*map(F.lit, lexicon.STOPWORDS)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def bigrams(toks: Column) -> Column:
    n = F.size(toks)
    return F.when(n < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda k: F.concat_ws(" ", F.get(toks, k - 1), F.get(toks, k))))


def bigram_overlap(student: Column, assistant: Column) -> Column:
    """The share of the student's bigrams, repeats included, that the assistant has; 0 if either has none."""
    return F.when((F.size(student) == 0) | (F.size(assistant) == 0), F.lit(0.0)).otherwise(F.size(F.filter(student, lambda b: F.array_contains(assistant, b))) / F.size(student))


def strip(text: Column, re2: bool = False) -> Column:
    return F.regexp_replace(text, lexicon.in_re2(r"^\s+|\s+\z") if re2 else r"(?U)^\s+|\s+$", "")


def is_code_line(line: Column, re2: bool = False) -> Column:
    s = strip(line, re2)
    preprocessor, end = (lexicon.in_re2(p) if re2 else p for p in (PREPROCESSOR, CODE_END))
    n = F.length(s)
    marks = n - F.length(F.translate(s, CODE_PUNCTUATION, ""))
    dense = (n >= 8) & (marks / n >= 0.12)
    return F.when(n < 3, s.isin("{", "}", "};")).otherwise(s.rlike(preprocessor) | s.rlike(end) | F.coalesce(dense, F.lit(False)))


def bare_code_chars(text: Column, re2: bool = False) -> Column:
    """Characters in runs of two code lines or more, or in one of at least 40."""
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("n"), F.lit(0).alias("chars"), F.lit(0).alias("first"))
    counted = lambda s: s["total"] + F.when((s["n"] >= 2) | ((s["n"] == 1) & (s["first"] >= 40)), s["chars"]).otherwise(0)

    def step(s: Column, line: Column) -> Column:
        size = F.length(line)
        run = F.struct(s["total"].alias("total"), (s["n"] + 1).alias("n"), (s["chars"] + size).alias("chars"), F.when(s["n"] == 0, F.length(strip(line, re2))).otherwise(s["first"]).alias("first"))
        over = F.struct(counted(s).alias("total"), F.lit(0).alias("n"), F.lit(0).alias("chars"), F.lit(0).alias("first"))
        return F.when(is_code_line(line, re2), run).otherwise(over)

    return F.aggregate(F.split(text, RE2_LINE_ENDS if re2 else LINE_ENDS, -1), start, step, counted)


def context_chars(content: Column, re2: bool = False) -> Column:
    """Pasted context: fenced blocks; long paragraphs of turns without any; bare code otherwise."""
    c = text_of(content)
    blocks = F.regexp_extract_all(c, F.lit(FENCE), F.lit(0))
    paragraphs = F.split(F.regexp_replace(c, FENCE, "\n"), lexicon.in_re2(r"\n\s*\n") if re2 else r"\n(?U)\s*\n", -1)
    of_paragraphs = F.transform(paragraphs, lambda p: F.when((F.length(p) > 300) & (F.size(blocks) == 0), F.length(p)).otherwise(bare_code_chars(p, re2)))
    return (F.length(F.array_join(blocks, "")) + F.aggregate(of_paragraphs, F.lit(0), lambda a, b: a + b)).cast("long")


def pii_counts(content: Column, low: Column | None = None, re2: bool = False) -> dict[str, Column]:
    low = folded(content) if low is None else low
    of = _dotless(content) if re2 else content
    return {name: count_where(of, low, lexicon.in_re2(p) if re2 else p, lexicon.needles((p,))) for name, p in lexicon.PII.items()}
