"""Column functions on file contents and model responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom import constants as C
from codeloom.functions.paths import token_estimate


def truncated(text: Column, max_lines: int = C.MAX_PROMPT_LINES, head: float = C.HEAD_RATIO) -> Column:
    """Head and tail of an over-long text around a note on how much is left out."""
    first = int(max_lines * head)
    last = max_lines - first
    lines = F.split(text, "\n")
    n = F.size(lines)
    note = F.concat(F.lit("... [TRUNCATED: "), (n - max_lines).cast("string"), F.lit(" lines omitted] ..."))
    kept = F.concat(
        F.slice(lines, 1, first),
        F.array(F.lit(""), note, F.lit("")),
        F.slice(lines, F.greatest(n - last + 1, F.lit(1)), F.lit(last)),
    )
    return F.when(n <= max_lines, text).otherwise(F.array_join(kept, "\n"))


def truncate_content(df: DataFrame, max_lines: int = C.MAX_PROMPT_LINES, head: float = C.HEAD_RATIO) -> DataFrame:
    return df.withColumn("content", truncated(F.col("content"), max_lines, head))


def annotation_prompts(files: DataFrame, max_lines: int = C.MAX_PROMPT_LINES) -> DataFrame:
    """One prompt row per file, the input table of a batch inference job."""
    language = F.coalesce(F.col("language"), F.lit("Unknown"))
    prompt = F.concat(
        F.lit("Describe one source file of a repository.\n\nFile: "), F.col("path"),
        F.lit("\nLanguage: "), language,
        F.lit("\nLines: "), F.col("line_count").cast("string"),
        F.lit("\n\n```"), F.lower(language), F.lit("\n"), truncated(F.col("content"), max_lines),
        F.lit(f'\n```\n\nAnswer with JSON only: {{"purpose": one sentence of at most {C.MAX_PURPOSE_CHARS} '
              'characters, "exports": [names the file exports]}'),
    )
    out = files.select("repo", "path", prompt.alias("prompt"))
    return out.withColumn("tokens", token_estimate(F.col("prompt")))


def stripped(text: Column) -> Column:
    """Without white space at either end, line breaks included."""
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def json_text(response: Column) -> Column:
    """The JSON part of a model response: fenced block, else outermost braces, else from the first brace."""
    text = stripped(response)
    fence = r"(?s)```(?:json)?\s*(.*?)\s*```"
    start = F.instr(text, "{")
    end = F.length(text) - F.instr(F.reverse(text), "}") + 1
    has_end = F.contains(text, F.lit("}"))
    return (
        F.when(text.rlike(fence), stripped(F.regexp_extract(text, fence, 1)))
        .when((start > 0) & has_end & (end > start), F.substring(text, start, end - start + 1))
        .when(start > 0, F.substring(text, start, F.length(text)))
        .otherwise(text)
    )


def repaired_json(text: Column) -> Column:
    """Escape raw line breaks and tabs inside string values (strings that follow a colon)."""
    pieces = F.split(text, '"')
    escaped = lambda s: F.replace(F.replace(F.replace(s, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t"))
    fixed = F.transform(
        pieces,
        lambda s, i: F.when((i % 2 == 1) & F.get(pieces, i - 1).rlike(r":\s*\z"), escaped(s)).otherwise(s),
    )
    return F.array_join(fixed, '"')


def parsed_json(text: Column) -> Column:
    """Variant of the text, of the repaired text when that fails, else NULL."""
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(repaired_json(text)))


def pretty_duration(ms: Column) -> Column:
    seconds = F.floor(ms / 1000)
    minutes = F.floor(seconds / 60)
    return F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("m "), (seconds % 60).cast("string"), F.lit("s"))).otherwise(
        F.concat(seconds.cast("string"), F.lit("s"))
    )


def pretty_latency(ms: Column) -> Column:
    seconds = ms / 1000
    minutes = F.floor(seconds / 60)
    return (
        F.when(ms < 1000, F.concat(F.floor(ms + 0.5).cast("string"), F.lit("ms")))
        .when(seconds < 60, F.format_string("%.1fs", seconds.cast("double")))
        .otherwise(F.concat(minutes.cast("string"), F.lit("m "), F.floor(seconds - minutes * 60 + 0.5).cast("string"), F.lit("s")))
    )


def pretty_cost(cost: Column) -> Column:
    return F.format_string("$%.2f", cost.cast("double"))


def grouped_int(n: Column) -> Column:
    return F.format_number(n, 0)


def pretty_speed(tokens_per_second: Column) -> Column:
    return F.concat(F.floor(tokens_per_second + 0.5).cast("string"), F.lit(" tok/s"))


def plural(n: Column, noun: str) -> Column:
    return F.concat(F.lit(noun), F.when(n > 1, F.lit("s")).otherwise(F.lit("")))
