"""Text normalisation, tokens and matching as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Characters that stand for others in normalised text.
HYPHENS = "‐‑‒–—―⁃−"
DOUBLE_QUOTES = "“”„‟«»″"
SINGLE_QUOTES = "‘’‚‛`´"
SLASHES = "⁄∕"
BLANKS = "\u000b\u000c\u0085"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
TEMPLATE_FIELDS = ("[question]", "[context]")


def strip(t: Column) -> Column:
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def clean(t: Column) -> Column:
    """Stripped, without one last full stop unless it is all there is, in lower case."""
    s = strip(t)
    return F.lower(F.when((F.length(s) > 1) & s.endswith("."), F.substring(s, F.lit(1), F.length(s) - 1)).otherwise(s))


def tokens(t: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit("[a-z0-9']+"), F.lit(0))


@F.pandas_udf(StringType())
def _decompose(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFD")


def decomposed(t: Column) -> Column:
    """Text in canonical decomposition; the one scalar function that Spark lacks, in Arrow batches."""
    return _decompose(t)


def word_tokens(t: Column) -> Column:
    """Runs of letters, digits and marks, and single visible characters, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit(r"([\p{L}\p{N}\p{M}]+)|([^\p{Z}\p{C}])"), F.lit(0))


def contains_run(text_tokens: Column, run: Column) -> Column:
    """Whether ``run`` is a contiguous stretch of ``text_tokens``; false for an empty run. Tokens hold no blanks, so joined text decides."""
    joined = lambda a: F.concat(F.lit(" "), F.array_join(a, " "), F.lit(" "))
    return (F.size(run) > 0) & F.contains(joined(text_tokens), joined(run))


def legacy_match(target: Column, response: Column) -> Column:
    """The cleaned target is a substring of the cleaned response; null if either is null."""
    return F.contains(clean(response), clean(target))


def strict_match(target: Column, response: Column) -> Column:
    """The target's tokens are a contiguous run of the response's; null if either is null, false for a target without tokens."""
    return F.when(target.isNotNull() & response.isNotNull(), contains_run(tokens(response), tokens(target)))


def answer_normal(t: Column) -> Column:
    """Lower case, without ASCII punctuation and articles, blanks collapsed."""
    bare = F.translate(F.lower(t), PUNCTUATION, "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"\b(a|an|the)\b", " "), r"\s+", " "))


def plain_marks(t: Column) -> Column:
    """Typographic marks replaced by plain ones: hyphens, quotes, primes, ellipses, slashes; controls dropped."""
    one = F.translate(t, HYPHENS + DOUBLE_QUOTES + SINGLE_QUOTES + SLASHES + BLANKS + "­", "-" * len(HYPHENS) + '"' * len(DOUBLE_QUOTES) + "'" * len(SINGLE_QUOTES) + "/" * len(SLASHES) + " " * len(BLANKS))
    for mark, plain in (("‴", "'''"), ("⁗", "''''"), ("′", "'"), ("…", "...")):
        one = F.replace(one, F.lit(mark), F.lit(plain))
    return F.regexp_replace(one, r"[\u0000-\u0008\u000e-\u001f\u007f-\u009f]", "")


def title_text(title: Column, text: Column) -> Column:
    return F.when(F.length(F.coalesce(title, F.lit(""))) > 0, F.concat_ws(" ", title, text)).otherwise(text)


def render_prompt(template: str, question: Column, contexts: Column) -> Column:
    """The template with the question, then the contexts, one on a line, put in."""
    return F.replace(F.replace(F.lit(template), F.lit(TEMPLATE_FIELDS[0]), question), F.lit(TEMPLATE_FIELDS[1]), F.array_join(contexts, "\n"))


def injected_texts(question: Column, texts: Column, n: int) -> Column:
    """The first ``n`` texts, each behind the question and a full stop; empty for null texts."""
    return F.transform(F.slice(F.coalesce(texts, F.array().cast("array<string>")), 1, n), lambda t: F.concat(question, F.lit("."), t))


def parse_contexts(prompt: Column) -> Column:
    """The contexts of a prompt, each stripped; null where a marker is missing."""
    begin, end = "Contexts: ", "\n\nQuery:"
    inner = F.substring_index(F.substring(prompt, F.instr(prompt, begin) + len(begin), F.length(prompt)), end, 1)
    return F.when(F.contains(prompt, F.lit(begin)) & F.contains(prompt, F.lit(end)), F.transform(F.split(F.trim(inner), "\n"), lambda x: F.trim(x)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct tokens; 0 if either side has none."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def token_hits(text: Column, keywords: Column) -> Column:
    """How many tokens of a text are among the keywords (themselves tokens). One pattern of the keywords, bounded by what is no token, so each text is read once."""
    pattern = F.concat(F.lit("(?<![a-z0-9'])(?:"), F.array_join(keywords, "|"), F.lit(")(?![a-z0-9'])"))
    return F.when(F.size(keywords) == 0, F.lit(0)).otherwise(F.regexp_count(F.lower(F.coalesce(text, F.lit(""))), pattern))


def distinct_tokens(text: Column) -> Column:
    return F.size(F.array_distinct(tokens(text)))


def frequency_density(passage: Column, keywords: Column, distinct: Column | None = None) -> Column:
    """Occurrences of the keywords over distinct tokens of the passage (``distinct``, if they are counted already); 0 where either is empty."""
    return F.coalesce(F.try_divide(token_hits(passage, keywords), distinct if distinct is not None else distinct_tokens(passage)), F.lit(0.0))


def entropy(p: Column) -> Column:
    """Of a share p, in bits; 0 at 0 and 1, null for null."""
    part = lambda x: F.when(x <= 0, F.lit(0.0)).otherwise(-x * F.log2(x))
    return F.when(p.isNotNull(), part(p) + part(1 - p))
