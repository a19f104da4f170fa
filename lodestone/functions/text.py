"""Text rules as column expressions: sentences, search tokens, captions, topics, entities, timestamps and keywords."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Topics and their signs, stop words, and entity patterns.
TOPICS = {
    "meeting": ["meeting", "agenda", "discuss", "presentation"],
    "project": ["project", "deadline", "milestone", "deliverable"],
    "technical": ["code", "system", "database", "api", "server"],
    "financial": ["budget", "cost", "revenue", "profit", "expense"],
    "planning": ["plan", "strategy", "roadmap", "timeline"],
}
STOP_IMAGE = ["that", "this", "with", "from", "have", "been", "were", "their"]
STOP_AUDIO_CHUNK = ["that", "this", "with", "from", "have", "were", "just", "like"]
STOP_AUDIO = [
    "that", "this", "with", "from", "have", "been", "were", "their", "will", "would", "there", "what", "when", "where",
    "which", "about", "could", "should", "think", "know", "just", "like", "well", "yeah", "okay", "right", "going",
]
DATE = r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b"
TIME = r"\b\d{1,2}:\d{2}\s*(?:AM|PM|am|pm)?\b"
AMOUNT = r"\$\d+(?:,\d{3})*(?:\.\d{2})?"
CAPTION = r"(?i)^(Table|Figure|Chart|Diagram)\s+(\d+(?:\.\d+)?)(?:[:.\s]+(.*))?"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def sentences(text: Column) -> Column:
    """Sentences: cut after . ! or ? where white space and a capital follow; empty ones are dropped."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+(?=[A-Z])"), stripped), lambda s: s != "")


def token_count(text: Column) -> Column:
    """Tokens by the default counter: a token for each four characters, rounded down."""
    return F.floor(F.length(text) / F.lit(4)).cast("int")


def search_tokens(text: Column) -> Column:
    """Tokens for keyword search: in lower case the runs of a-z and digits, of at least three characters."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]{3,}"), F.lit(0))


def caption_number(text: Column) -> Column:
    return F.nullif(F.regexp_extract(stripped(text), CAPTION, 2), F.lit(""))


def caption_title(text: Column) -> Column:
    """'Kind N: title', or 'Kind N' without one; null where the text does not begin with a caption."""
    part = lambda n: F.regexp_extract(stripped(text), CAPTION, n)
    head = F.concat(F.initcap(F.lower(part(1))), F.lit(" "), part(2))
    rest = stripped(part(3))
    return F.when(part(2) == "", F.lit(None)).when(rest == "", head).otherwise(F.concat(head, F.lit(": "), rest))


def topics(text: Column) -> Column:
    """Topics of which at least two signs occur in the text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    score = lambda signs: sum((low.contains(s).cast("int") for s in signs), F.lit(0))
    return F.filter(F.array(*[F.when(score(signs) >= 2, F.lit(t)) for t, signs in TOPICS.items()]), lambda t: t.isNotNull())


def entities(text: Column) -> Column:
    """The first five dates, times and amounts each, distinct and sorted."""
    found = [F.slice(F.regexp_extract_all(text, F.lit(p), F.lit(0)), 1, 5) for p in (DATE, TIME, AMOUNT)]
    return F.array_sort(F.array_distinct(F.concat(*found)))


def timestamp(seconds: Column) -> Column:
    """HH:MM:SS.mmm, every part cut off and not rounded."""
    whole = F.floor(seconds).cast("long")
    millis = ((seconds - F.floor(seconds)) * F.lit(1000.0)).cast("int")
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(whole / 3600), F.floor((whole % 3600) / 60), whole % 60, millis)


def keyword_tokens(text: Column, stop: list[str]) -> Column:
    """Words of at least four letters, digits or underscores in lower case, without stop words."""
    word = r"[\p{L}\p{N}_]"
    pattern = rf"(?<!{word})(?!(?:{'|'.join(stop)})(?!{word})){word}{{4,}}" if stop else rf"{word}{{4,}}"
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0))


def counted(words: Column) -> Column:
    """The distinct words of each row, array of (word, n), the commonest first and of equals the one that comes first. Nothing is shuffled."""

    @F.arrow_udf("array<struct<word:string,n:int>>")
    def count(words: pa.Array) -> pa.Array:
        rows = [None if w is None else [{"word": k, "n": n} for k, n in Counter(w).most_common()] for w in words.to_pylist()]
        return pa.array(rows, pa.list_(pa.struct([("word", pa.string()), ("n", pa.int32())])))

    return count(words)


def top_words(words: Column, n: int) -> Column:
    """The n commonest words of each row, the earlier of equals first."""
    return F.transform(F.slice(counted(words), 1, n), lambda x: x.word)


def preview(text: Column, size: int) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def time_of_day(seconds: Column) -> Column:
    """Whole seconds as [D day[s], ]H:MM:SS."""
    whole = F.floor(seconds).cast("long")
    days = F.floor(whole / 86400)
    clock = F.format_string("%d:%02d:%02d", F.floor(whole % 86400 / 3600), F.floor(whole % 3600 / 60), whole % 60)
    return F.concat(F.when(days == 1, "1 day, ").when(days > 1, F.concat(days.cast("string"), F.lit(" days, "))).otherwise(F.lit("")), clock)


def fixed3(value: Column) -> Column:
    """Three decimals, rounded by the number's exact binary value and, where that lies halfway, to the even digit; format_string rounds its decimal form."""
    v = F.abs(value.cast("double"))
    twice = F.round(v * 2000.0)  # odd where v may lie halfway between two thousandths
    beyond = ((v * 2048.0 - twice) - v * 32.0) - v * 16.0  # exactly v * 2000 - twice
    halfway = (twice % 2 == 1) & (F.abs(beyond) < 1e-6)
    down = F.floor(twice / 2)
    thousandths = F.when(beyond < 0, down).when(beyond > 0, down + 1).otherwise(down + down % 2)
    return F.format_string("%.3f", F.when(halfway, thousandths / F.lit(1000.0)).otherwise(v) * F.when(value < 0, -1.0).otherwise(1.0))


def plain_number(value: Column) -> Column:
    """A double not below 0 as the shortest decimals that give it back, always with a point; exponents from 1e16 up only."""
    short = value.cast("string")
    spread = F.regexp_replace(short.cast("decimal(38,18)").cast("string"), "0+$", "")
    huge = F.concat(F.regexp_replace(F.split_part(short, F.lit("E"), F.lit(1)), r"\.0$", ""), F.lit("e+"), F.lpad(F.split_part(short, F.lit("E"), F.lit(2)), 2, "0"))
    return F.when(~short.contains("E"), short).when(value >= 1e16, huge).otherwise(F.concat(spread, F.when(F.endswith(spread, F.lit(".")), "0").otherwise("")))


def asked_parts(request: Column) -> Column:
    """Of a request like 'text: a; image: b; audio: c' the parts (text, image, audio), null where a key is missing; a value goes on to the next semicolon."""
    part = lambda key: F.nullif(stripped(F.regexp_extract(request, rf"{key}:([^;]+)", 1)), F.lit("")).alias(key)
    return F.struct(part("text"), part("image"), part("audio"))
