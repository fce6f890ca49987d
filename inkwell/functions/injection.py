"""Prompt injections in texts: found, wrapped and scored."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import kinds as K
from .regex import Rx, let
from .rowwise import by_row

#: Patterns and what they are a sign of, in the order they are applied. Case never counts.
PATTERNS: tuple[tuple[Rx, str], ...] = tuple((Rx(p, f), reason) for p, f, reason in (
    (r"\bignore\s+(all\s+)?(previous|prior|above|earlier)\s+(instructions?|prompts?|rules?|guidelines?)\b", "i", "Attempts to override previous instructions"),
    (r"\bdisregard\s+(all\s+)?(previous|prior|above|earlier)\s+(instructions?|prompts?|rules?|guidelines?)\b", "i", "Attempts to override previous instructions"),
    (r"\boverride\s+(the\s+)?(system|previous|prior)?\s*(prompt|instructions?|rules?)\b", "i", "Attempts to override system instructions"),
    (r"\bforget\s+(everything|all|what)\s+(you\s+)?(?:know|learned|were\s+told)\b", "i", "Attempts to clear LLM context"),
    (r"\byou\s+are\s+now\s+(a|an|in)\s+", "i", "Role reassignment attempt"),
    (r"\bact\s+as\s+(if\s+you\s+are|a|an)\s+", "i", "Role reassignment attempt"),
    (r"\bpretend\s+(you\s+are|to\s+be)\s+", "i", "Role reassignment attempt"),
    (r"\bswitch\s+to\s+(\w+)\s+mode\b", "i", "Mode switching attempt"),
    (r"\benter\s+(\w+)\s+mode\b", "i", "Mode switching attempt"),
    (r"\benable\s+(developer|debug|admin|root|sudo)\s+mode\b", "i", "Privilege escalation attempt"),
    (r"\b(show|reveal|display|print|output)\s+(me\s+)?(your\s+)?(system\s+)?(prompt|instructions?|rules?)\b", "i", "System prompt extraction attempt"),
    (r"\bwhat\s+(are|is)\s+your\s+(system\s+)?(prompt|instructions?|rules?)\b", "i", "System prompt extraction attempt"),
    (r"\brepeat\s+(your\s+)?(initial|original|system)\s+(prompt|instructions?)\b", "i", "System prompt extraction attempt"),
    (r"\bDAN\s*[\-:]?\s*(mode|prompt|jailbreak)?\b", "i", "Known jailbreak pattern (DAN)"),
    (r"\bdo\s+anything\s+now\b", "i", "Known jailbreak pattern (DAN)"),
    (r"\bjailbreak(ed)?\b", "i", "Jailbreak reference"),
    (r"\b(bypass|circumvent|evade|override)\s+(your\s+)?(safety|security|restrictions?|filters?|guidelines?)\b", "i", "Safety bypass attempt"),
    (r"\[system\]|\[SYSTEM\]|\[assistant\]|\[ASSISTANT\]", "i", "Fake system message markers"),
    (r"<\|?(system|assistant|user|im_start|im_end)\|?>", "i", "Fake message delimiters"),
    (r"<<\s*SYS\s*>>|<<\/\s*SYS\s*>>", "i", "Fake system prompt delimiters"),
    (r"###\s*(System|Assistant|User|Instruction)\s*:?\s*###", "i", "Fake message delimiters"),
    (r"^#{1,6}\s*(System|Assistant|User)\s*:?\s*$", "im", "Fake role heading markers"),
    (r"Human:\s*|Assistant:\s*|System:\s*", "i", "Potential conversation injection"),
    (r"<(function_call|tool_call|tool_use|invoke)>", "i", "Tool call injection attempt"),
    (r"\{\s*\"(function|tool|action)\":\s*\"", "i", "JSON tool call injection attempt"),
    (r"<thinking>|<\/thinking>|<answer>|<\/answer>", "i", "XML tag injection for structured output"),
    (r"<\/?(system|assistant|user)\s*>", "i", "XML tag injection for chat roles"),
    (r"\b(when|if)\s+(the\s+)?(AI|assistant|model|LLM|you)\s+(reads?|sees?|processes?|encounters?)\s+this\b", "i", "Conditional instruction injection"),
    (r"\bnew\s+instructions?\s*:", "i", "Explicit new instruction marker"),
    (r"\bfollow\s+these\s+(new\s+)?instructions?\b", "i", "Instruction following directive"),
    (r"\b(leak|exfiltrate|extract|steal|copy)\s+(the\s+)?(api\s*key|secret|password|token|credential)", "i", "Data exfiltration attempt"),
))
#: For each pattern, lower-case words of which every match holds one: looked for before the pattern is tried.
SIGNS: tuple[tuple[str, ...], ...] = (
    ("ignore",), ("disregard",), ("override",), ("forget",), ("you",), ("act",), ("pretend",), ("switch",), ("enter",), ("enable",), ("prompt", "instruction", "rule"),
    ("your",), ("repeat",), ("dan",), ("anything",), ("jailbreak",), ("bypass", "circumvent", "evade", "override"), ("[system]", "[assistant]"), ("system", "assistant", "user", "im_start", "im_end"), ("<<",), ("###",), ("#",),
    ("human:", "assistant:", "system:"), ("<function_call>", "<tool_call>", "<tool_use>", "<invoke>"), ("{",), ("thinking>", "answer>"), ("system", "assistant", "user"), ("this",), ("instruction",), ("follow",),
    ("leak", "exfiltrate", "extract", "steal", "copy"),
)
#: Patterns that leave little doubt, with their own case rules.
SURE = (
    Rx(r"\bignore\s+(all\s+)?previous\s+instructions?\b", "i"), Rx(r"\[SYSTEM\]|\[system\]"), Rx(r"<\|system\|>", "i"),
    Rx(r"\bjailbreak\b", "i"), Rx(r"\bDAN\s+mode\b", "i"),
)
#: Characters shown around a match; risk of sure signs, more a sign, and a sign alone.
CONTEXT, SURE_RISK, SURE_STEP, STEP = 50, 0.7, 0.1, 0.15
#: Letters that Python takes for an ASCII one if case doesn't count, though their lower case is none.
_FOLDED = {0x130: "i", 0x131: "i", 0x17F: "s", 0x212A: "k"}


def _with_low(text: Column, body) -> Column:
    return let(F.struct(text.alias("text"), F.lower(text).alias("low")), body)


def _signed(t: Column, signs: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for s in signs:
        hit = hit | F.contains(t["low"], F.lit(s))
    return hit


def matches(text: Column) -> Column:
    """Distinct (text, reason) of everything that a pattern matches, in order of the patterns."""

    def each(t: Column, rx: Rx, reason: str, signs: tuple[str, ...]) -> Column:
        found = F.transform(F.array_distinct(rx.all(t["text"])), lambda m: F.struct(m.alias("text"), F.lit(reason).alias("reason")))
        return F.when(_signed(t, signs), found).otherwise(F.when(t["text"].isNotNull(), F.array().cast("array<struct<text:string,reason:string>>")))

    return _with_low(text, lambda t: F.array_distinct(F.flatten(F.array(*[each(t, rx, reason, s) for (rx, reason), s in zip(PATTERNS, SIGNS, strict=True)]))))


def suspicious(text: Column) -> Column:
    """Whether any pattern matches; patterns are tried only where their signs stand."""

    def any_of(t: Column) -> Column:
        hit = F.lit(False)
        for (rx, _), signs in zip(PATTERNS, SIGNS, strict=True):
            hit = hit | (_signed(t, signs) & rx.test(t["text"]))
        return hit

    return _with_low(text, any_of)


def sanitize(text: Column) -> Column:
    """Every match wrapped in a warning, pattern by pattern, so that later ones can wrap again.

    A pattern is tried only where its signs stand in what the earlier ones left,
    whose lower case is made anew only after a replacement.
    """

    def wrapped(t: Column, k: int) -> Column:
        made = let(PATTERNS[k][0].replace(t["text"], "[POTENTIAL_INJECTION: $0]"), lambda x: F.struct(x.alias("text"), F.lower(x).alias("low")))
        return F.when(_signed(t, SIGNS[k]), made).otherwise(t)

    def chosen(t: Column, k: Column, a: int, b: int) -> Column:
        """Pattern ``k`` of those from a to b applied: by halves, as conditions are tried one after the other."""
        if b - a == 1:
            return wrapped(t, a)
        return F.when(k < (a + b) // 2, chosen(t, k, a, (a + b) // 2)).otherwise(chosen(t, k, (a + b) // 2, b))

    # a fold, as a lambda within a lambda for each pattern would take Spark for ever to analyse
    start = F.struct(text.alias("text"), F.lower(text).alias("low"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(len(PATTERNS) - 1)), start, lambda t, k: chosen(t, k, 0, len(PATTERNS)), lambda t: t["text"])


def high_confidence(text: Column) -> Column:
    hit = F.lit(False)
    for rx in SURE:
        hit = hit | rx.test(text)
    return hit


def risk(text: Column) -> Column:
    """0 to 1: by the number of distinct matches, higher if one is sure."""
    found = F.struct(F.size(matches(text)).alias("n"), text.alias("text"))

    def score(f: Column) -> Column:
        n = f["n"]
        return F.when(n == 0, 0.0).when(high_confidence(f["text"]), F.least(F.lit(1.0), SURE_RISK + n * SURE_STEP)).otherwise(F.least(F.lit(1.0), n * STEP))

    return let(found, score)


def detections_of(text: str) -> list[dict]:
    """(text in its context, reason) of distinct matches."""
    found = {}
    low = (text if text.isascii() else text.translate(_FOLDED)).lower()
    for (rx, reason), signs in zip(PATTERNS, SIGNS, strict=True):
        if not any(s in low for s in signs):
            continue
        for m in rx.py.finditer(text):
            a, b = max(0, m.start() - CONTEXT), min(len(text), m.end() + CONTEXT)
            shown = ("..." if a else "") + text[a:b] + ("..." if b < len(text) else "")
            found.setdefault((m[0], reason), dict(text=shown, reason=reason))
    return list(found.values())


@by_row(K.NOTES)
def _contexts(text: str | None) -> list[dict]:
    return detections_of(text) if text else []


def detections(text: Column) -> Column:
    """As :func:`detections_of`; only suspicious texts leave the JVM."""
    hit = suspicious(text)
    return F.when(hit, _contexts(F.when(hit, text))).otherwise(F.array().cast("array<struct<text:string,reason:string>>"))
