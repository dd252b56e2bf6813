"""Injection phrasings and hidden characters: weighted rules over a text column.

Every rule counts once, by its first match. Rules are one wide expression without a shuffle, also those of a
feed (scan_with).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dialect import java
from ..functions.verdicts import by_score

# Rule id, category, weight, pattern; all without regard to case.
RULES = [
    ("ignore-previous", "instruction-override", 35, r"\b(ignore|disregard|forget|override)\b[^.\n]{0,40}\b(all\s+)?(previous|prior|above|earlier|preceding|the\s+system)\b[^.\n]{0,20}\b(instruction|prompt|message|rule|context|direction)"),
    ("new-instructions", "instruction-override", 25, r"\b(here are|follow|obey)\b[^.\n]{0,30}\b(new|the\s+real|updated|true)\b[^.\n]{0,20}\binstruction"),
    ("role-override", "role-manipulation", 30, r"\b(you\s+are\s+now|from\s+now\s+on|act\s+as|pretend\s+to\s+be|roleplay\s+as|behave\s+like)\b"),
    ("dan-jailbreak", "jailbreak", 40, r"\b(DAN|do\s+anything\s+now|developer\s+mode|jailbreak|unfiltered|without\s+(any\s+)?restrictions|no\s+longer\s+bound)\b"),
    ("system-prompt-exfil", "prompt-leak", 35, r"\b(reveal|show|print|repeat|output|tell\s+me|what\s+(is|are))\b[^.\n]{0,30}\b(your\s+)?(system\s+prompt|initial\s+instruction|the\s+above|your\s+(instruction|rule|directive|prompt))"),
    ("exfil-action", "data-exfiltration", 35, r"\b(send|post|exfiltrate|upload|leak|transmit|forward)\b[^.\n]{0,40}(https?:\/\/|to\s+the\s+(following|url|server|endpoint)|api\s+key|credential|secret|token)"),
    ("tool-poison", "tool-poisoning", 30, r"\b(call|invoke|use|run|execute)\b[^.\n]{0,30}\b(tool|function|command|shell|os\.system|subprocess|eval)\b"),
    ("secret-ask", "credential-phishing", 20, r"\b(give|provide|share|reveal|what\s+is)\b[^.\n]{0,25}\b(api\s*key|password|secret|access\s*token|private\s*key|credential)"),
    ("imperative-override", "instruction-override", 12, r"\b(do\s+not\s+(tell|inform|warn|mention)|without\s+(telling|informing|notifying)|do\s+not\s+(refuse|decline))\b"),
    ("fake-system-tag", "prompt-injection", 28, r"(<\|?(system|im_start|im_end)\|?>|\[\/?(INST|SYS|SYSTEM)\]|###\s*(system|instruction)\s*:)"),
    ("urgency-coercion", "social-engineering", 8, r"\b(this\s+is\s+(urgent|critical)|you\s+must\s+(immediately|now)|or\s+(you|the\s+user)\s+will\s+be)\b"),
]
# Characters and markup that hide text.
ZERO_WIDTH = "[​-‍⁠﻿]"
BIDI = "[‪-‮⁦-⁩]"
TAGS = "[\U000e0000-\U000e007f]"
HIDDEN_HTML = r"(display\s*:\s*none|visibility\s*:\s*hidden|font-size\s*:\s*0|color\s*:\s*#?(fff(fff)?|white)\b|opacity\s*:\s*0)"
COMMENT_INSTRUCTION = r"<!--[^>]*\b(ignore|instruction|system|assistant|you\s+are)\b"

FINDING = "struct<id:string,category:string,weight:int,match:string>"


def finding(rule: str, category: str, weight: Column, match: Column) -> Column:
    return F.struct(F.lit(rule).alias("id"), F.lit(category).alias("category"), weight.cast("int").alias("weight"), match.alias("match"))


def phrase_findings(text: Column) -> list[Column]:
    """A finding for each phrase rule, its match empty where the rule has none: each pattern runs once a text."""
    return [finding(i, c, F.lit(w), F.substring(F.regexp_extract(text, java(p, "i"), 0), 1, 120)) for i, c, w, p in RULES]


def signals(text: Column) -> list[Column]:
    n = F.regexp_count(text, F.lit(ZERO_WIDTH))
    first = lambda p, f="": F.substring(F.regexp_extract(text, java(p, f), 0), 1, 120)
    return [
        finding("zero-width-chars", "obfuscation", F.least(F.lit(30), F.lit(10) + n), first(ZERO_WIDTH)),
        finding("bidi-override", "obfuscation", F.lit(30), first(BIDI)),
        finding("unicode-tag-smuggling", "obfuscation", F.lit(35), first(TAGS)),
        finding("hidden-html", "obfuscation", F.lit(20), first(HIDDEN_HTML, "i")),
        finding("html-comment-instruction", "obfuscation", F.lit(20), first(COMMENT_INSTRUCTION, "i")),
    ]


def score_columns(df: DataFrame) -> DataFrame:
    """score, risk, verdict, matched and categories from findings."""
    total = F.least(F.lit(100), F.aggregate("findings", F.lit(0), lambda a, f: a + f["weight"]))
    df = df.withColumn("score", total).withColumn("matched", F.size("findings") > 0)
    low = F.when(F.col("matched"), "low").otherwise("none")
    df = df.withColumn("risk", F.when(F.col("score") >= 60, "critical").when(F.col("score") >= 35, "high").when(F.col("score") >= 15, "medium").otherwise(low))
    df = df.withColumn("verdict", by_score(F.col("score"), (35, "block"), (15, "review"), default="allow"))
    return df.withColumn("categories", F.array_distinct(F.transform("findings", lambda f: f["category"])))


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """df with findings, score, risk, verdict, matched, categories. Null texts have no findings."""
    t = F.coalesce(F.col(text), F.lit(""))
    found = F.filter(F.array(*phrase_findings(t), *signals(t)), lambda f: f["match"] != "")
    return score_columns(df.withColumn("findings", found))


MOST_RULES = 5000  #: of a feed; one with more is refused rather than cut


def scan_with(df: DataFrame, rules: DataFrame, text: str = "text") -> DataFrame:
    """scan() by fed rules(ordinal, id, category, weight, pattern) in place of the phrase rules; signals stay.

    The rules, a document of bounded size, are read once, so that each pattern is a literal that is compiled once.
    """
    fed = rules.select("ordinal", "id", "category", "weight", "pattern").orderBy("ordinal").limit(MOST_RULES + 1).collect()
    if len(fed) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    t = F.coalesce(F.col(text), F.lit(""))
    own = [F.when(F.rlike(t, F.lit(r.pattern)), finding(r.id, r.category, F.lit(r.weight), F.substring(F.regexp_extract(t, r.pattern, 0), 1, 120))) for r in fed]
    signal = F.filter(F.array(*signals(t)), lambda f: f["match"] != "")
    found = F.concat(F.filter(F.array(*own), lambda f: f.isNotNull()), signal) if own else signal
    return score_columns(df.withColumn("findings", found))


def catalog(spark) -> DataFrame:
    """(rule_id, category, weight, kind) of the phrase rules and the signals; the weight of zero-width characters is their highest."""
    own = [(i, c, w, "phrase") for i, c, w, _ in RULES]
    own += [(i, "obfuscation", w, "signal") for i, w in (("zero-width-chars", 30), ("bidi-override", 30), ("unicode-tag-smuggling", 35), ("hidden-html", 20), ("html-comment-instruction", 20))]
    return spark.createDataFrame(own, "rule_id string, category string, weight int, kind string")


def deobfuscate(text: Column) -> Column:
    return F.regexp_replace(text, f"{ZERO_WIDTH}|{BIDI}|{TAGS}", "")
