"""Queries that try to override a model's instructions, or to get at secrets, told from plain ones."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters that show nothing, besides those of category Cf.
INVISIBLE = "͏ᅟᅠ᠋-᠏⠀ㅤﾠ︀-️"
# Letters that look like Latin ones.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p",
    "с": "c", "х": "x", "у": "y", "і": "i",
    "ј": "j", "ѕ": "s", "һ": "h", "к": "k",
    "м": "m", "н": "h", "т": "t", "в": "b",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v",
    "ο": "o", "α": "a", "ε": "e", "ι": "i",
    "ν": "v", "ρ": "p", "τ": "t", "υ": "u",
    "κ": "k", "γ": "y", "χ": "x", "η": "n",
    "ı": "i",
}
# Marks that stand for a space.
MARKS = "`'\"*~_>#()[]{}|\\,;:!?"
# The shapes of a trap.
TRAPS = [
    r"ignore\s+(the\s+)?[\w\s]{0,20}?excerpts?\b",
    r"ignore\s+(all\s+|your\s+|the\s+)?(previous|prior|earlier)\s+instructions?\b",
    r"(disregard|override)\s+(all\s+|your\s+|the\s+)?(previous|prior|earlier|system)\s+instructions?\b",
    r"you\s+are\s+now\b",
    r"new\s+instructions?\b",
    r"(reveal|show|print|repeat|recite)\s+(your|the)\s+(system\s+)?(prompt|instructions)\b",
    r"from\s+memory\b",
    r"(recite|repeat|reveal|disclose|exfiltrate|dump)\b.{0,40}\b(private\s+key|secret|password|passphrase|credential|certificate)\b",
    r"(give|tell|show|read|state|spell|echo|print|list|output|copy|paste|send|leak)\b.{0,40}\b(private\s+key|secret|password|passphrase|credential)\b",
    r"(translate|rephrase|reword|paraphrase|rewrite|transform|convert|encode|obfuscate|encrypt|decrypt|hash|summarize)\b.{0,40}\b(private\s+key|secret|password|passphrase|credential)\b",
    r"(private\s+key|secret|password|passphrase|credential)\b.{0,40}\b(in|into|as)\s+(a\s+|an\s+|the\s+|my\s+|your\s+)?(french|spanish|german|italian|portuguese|russian|japanese|chinese|korean|latin|haiku|poem|limerick|rhyme|sonnet|emoji|base64|hex|hexadecimal|binary|morse|reversed)\b",
    r"bypass\s+(the\s+)?(safety|refusal|guardrail|filter|abstention)\b",
    r"\bjailbreak\b",
]
TRAP = re.compile("|".join(f"(?:{p})" for p in TRAPS))


class Reading(dict):
    """What a reader takes a character for; each is worked out when it is first met. glue stands for invisible ones.

    Folding a character by itself gives what folding a whole text would: sequences that compose come apart again, and the
    marks that a composition would hold are dropped anyway.
    """

    unseen = re.compile(f"[{INVISIBLE}]")

    def __init__(self, glue: str):
        self.glue = glue

    def _letter(self, c: str) -> str:
        if unicodedata.category(c) == "Cf" or self.unseen.match(c):
            return self.glue
        bare = "".join(x for x in unicodedata.normalize("NFKD", c) if unicodedata.category(x) != "Mn")
        return "".join(" " if x in MARKS else LOOKALIKES.get(x, x) for x in bare)

    def __missing__(self, code: int) -> str:
        self[code] = "".join(map(self._letter, unicodedata.normalize("NFKC", chr(code)).casefold()))
        return self[code]


JOINED, SPACED = Reading(""), Reading(" ")


def is_trap(query: str) -> bool:
    """Whether a query has the shape of a trap when its invisible characters are left out, or taken for spaces."""
    return any(TRAP.search(" ".join(query.translate(r).split())) for r in (JOINED, SPACED))


@F.pandas_udf(T.StringType())
def screened(query: pd.Series) -> pd.Series:
    """trap or plain; a null query is plain."""
    return query.map(lambda q: "trap" if q and is_trap(q) else "plain")
