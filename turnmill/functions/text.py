r"""Column helpers over turn texts, and the phrase lists.

Regexes are written for java.util.regex with (?U), where \w, \s and \b follow
Unicode; the control characters 1C-1F, which `str.strip` also removes, are added.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x1c-\x1f]"

# The phrases that the stages look for.
FILLERS = (
    "as i mentioned", "as we discussed", "as i said", "at the end of the day", "for all intents and purposes", "needless to say", "in terms of",
    "you know", "i mean", "kind of", "sort of", "basically", "actually", "literally", "honestly", "seriously", "clearly", "obviously", "essentially",
    "certainly", "definitely", "absolutely", "totally", "completely", "simply", "really", "very", "quite", "rather", "fairly", "pretty", "right",
    "okay", "anyway", "well", "so",
)
ACKNOWLEDGEMENTS = (
    "great question", "good question", "excellent question", "you're absolutely right", "that's a great point", "of course", "sure thing",
    "sounds good", "makes sense", "i understand", "i see", "got it", "noted", "understood", "thanks for clarifying", "thank you for that",
)
DECISIONS = (
    "let's go with", "we'll use", "we'll go with", "decided on", "agreed on", "confirmed", "settled on", "locked in", "final decision",
    "final answer", "we've decided", "conclusion is", "approved", "let's proceed with", "we're going with", "that's our answer", "we'll do that",
)
AGREEMENTS = ("agreed", "sounds good", "works for me", "perfect", "+1", "that works", "yes let's do that", "great", "correct", "exactly", "that's right", "fair enough")


def quoted(phrases) -> str:
    return "|".join(re.sub(r"([.+?(){}\[\]|^$*\\])", r"\\\1", p) for p in phrases)


FILLER = rf"(?iU)\b(?:{quoted(sorted(FILLERS, key=len, reverse=True))})\b|\bjust\b(?!\s+in\s+time)"


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, rf"(?U)^{SPACE}+|{SPACE}+\z", "")


def blank(text: Column) -> Column:
    return strip(text) == ""


def words(text: Column) -> Column:
    return F.filter(F.split(text, rf"(?U){SPACE}+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def sentences(text: Column) -> Column:
    """Parts between white space that follows . ! or ?, stripped, without blank ones."""
    return F.filter(F.transform(F.split(text, rf"(?U)(?<=[.!?]){SPACE}+"), strip), lambda s: s != "")


def of_turn() -> Column:
    """A turn's text: its content, or its text blocks joined by spaces."""
    parts = F.transform(F.filter("blocks", lambda b: (b["type"] == "text") & (F.coalesce(b["content"], F.lit("")) != "")), lambda b: b["content"])
    return F.when(F.col("blocks").isNull(), F.coalesce("content", F.lit(""))).otherwise(strip(F.array_join(parts, " ")))


def written_back(text: Column, changed: Column) -> dict[str, Column]:
    """The columns of a turn whose text becomes `text` where `changed`: content, or the first text block (put first if there is none);
    the original is kept once."""
    block = F.struct(F.lit("text").alias("type"), text.alias("content"), F.lit(None).cast("string").alias("mime_type"), F.lit(None).cast("string").alias("raw_json"))
    at = F.array_position(F.transform("blocks", lambda b: b["type"]), "text").cast("int")
    replaced = F.transform("blocks", lambda b, i: F.when(i + 1 == at, F.struct(b["type"].alias("type"), text.alias("content"), b["mime_type"].alias("mime_type"), b["raw_json"].alias("raw_json"))).otherwise(b))
    blocks = F.when(at > 0, replaced).otherwise(F.concat(F.array(block), F.col("blocks")))
    plain = F.col("blocks").isNull()
    return {
        "content": F.when(changed & plain, text).otherwise(F.col("content")),
        "blocks": F.when(changed & ~plain, blocks).otherwise(F.col("blocks")),
        "original_content": F.when(changed, F.coalesce("original_content", F.when(plain, F.coalesce("content", F.lit(""))).otherwise(F.to_json("blocks")))).otherwise(F.col("original_content")),
        "compressed": F.col("compressed") | changed,
    }


def tidy(text: Column) -> Column:
    """Punctuation and spaces repaired after phrases were taken out; a lower-case first letter becomes upper-case."""
    s = SPACE
    out = F.regexp_replace(text, rf"(?U){s}+", " ")
    out = F.regexp_replace(out, rf"(?U){s}*,{s}*(?:,{s}*)+", ", ")
    out = F.regexp_replace(out, rf"(?U){s}*;{s}*(?:;{s}*)+", "; ")
    out = F.regexp_replace(out, rf"(?U){s}+([,.;:!?])", "$1")
    out = F.regexp_replace(out, r"(?U)^[\s\x1c-\x1f,;:.]+", "")
    out = strip(F.regexp_replace(out, rf"(?U)[,;]{s}*\z", ""))
    return F.when(out.rlike(r"(?U)^\p{Lower}"), F.concat(F.upper(F.substring(out, 1, 1)), F.substr(out, F.lit(2)))).otherwise(out)


def without_fillers(text: Column) -> Column:
    """The text without filler phrases; left alone if it has none or starts with `actually, no`."""
    bare = F.regexp_replace(text, FILLER, "")
    return F.when(text.rlike(rf"(?iU)^{SPACE}*actually{SPACE}*,{SPACE}*no\b") | (bare == text), text).otherwise(tidy(bare))


def acknowledges(text: Column) -> Column:
    """Nothing but an acknowledgement, marks at the end aside."""
    return F.regexp_replace(F.lower(strip(text)), r"[.!?]+\z", "").isin(*ACKNOWLEDGEMENTS)


def only_asks(text: Column) -> Column:
    """One question and nothing else."""
    return text.rlike(rf"(?U)^{SPACE}*[^.!?]*\?{SPACE}*\z")


def decides(text: Column) -> Column:
    """A decision phrase stands anywhere in the text, inside words too."""
    return F.lower(text).rlike(quoted(DECISIONS))


def agrees(text: Column) -> Column:
    """A decision phrase, or an agreement between word borders."""
    return decides(text) | F.lower(text).rlike(rf"(?U)\b(?:{quoted(AGREEMENTS)})\b")


def squeezed_lines(text: Column) -> Column:
    """Lines equal to the line before taken out, blank ones aside; texts of fewer than two lines are left alone."""
    cut = F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), "[\r\u000b\u000c\u001c\u001d\u001e\u0085  ]", "\n")
    lines = F.split(F.regexp_replace(cut, r"\n\z", ""), "\n", -1)
    # Each line beside the one before it: looking that up by its place in a lambda would split the text again for every line.
    before = F.concat(F.array(F.lit(None).cast("string")), F.slice(lines, F.lit(1), F.size(lines) - 1))
    kept = F.filter(F.zip_with(lines, before, lambda x, y: F.when(y.isNull() | (x != y) | blank(x), x)), lambda x: x.isNotNull())
    return F.when(F.size(lines) < 2, text).otherwise(F.array_join(kept, "\n"))


def squeezed_blanks(text: Column) -> Column:
    return F.regexp_replace(text, r"\n{3,}", "\n\n")


def squeezed_spaces(text: Column) -> Column:
    return F.regexp_replace(text, r"[ \t]{2,}", " ")


def structured(text: Column, is_json: Column) -> Column:
    """Holds a JSON fence, or is JSON as a whole."""
    return F.lower(text).contains("```json") | is_json


def tool_marked() -> Column:
    """A tool's turn: by role, by a tool key, or by a mark in the text."""
    from ..schema import RESULT_ROLES

    return F.col("role").isin(*RESULT_ROLES) | F.coalesce("has_tool_key", F.lit(False)) | F.lower(of_turn()).rlike(r"tool_call|tool_use|tool_result|<tool|\[tool")
