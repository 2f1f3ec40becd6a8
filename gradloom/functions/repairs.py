"""Repairs of misread words in exam text: tables of fixed values and the rewrites they give."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradloom.functions.rewrite import STRIP, Sub, rewrite, strip
from gradloom.functions.text import is_junk

# Misread words of page text, in order.
PAGE_WORDS = (
    Sub(r"(?i)\bhazardmapping\b", "hazard mapping"), Sub(r"(?i)\bltaz[-]?afi\b", "hazard"), Sub(r"\bIdentiff\b", "Identify"), Sub(r"(?i)\bdentifu\b", "Identify"), Sub(r"(?i)\bdentiff\b", "Identify"), Sub(r"(?i)\brespecf\b", "respect"),
    Sub(r"(?i)\brecovery-and\b", "recovery and"), Sub(r"(?i)\bth\.e\b", "the"), Sub(r"\bthev\b", "they"), Sub(r"\bcan g \b", "can "), Sub(r"(?i)\bStatenthe\b", "State the"), Sub(r"(?i)\bStatethe\b", "State the"),
    Sub(r"\blnstitute\b", "Institute"), Sub(r"\[he\b", "the"), Sub(r"\s+J\s+", " "), Sub(r"\s+J$", "", True), Sub(r"^J\s+", "", True), Sub(r"(\b[a-zA-Z]+\b)\s+3\s+(\b[a-zA-Z]+\b)", "$1 $2"), Sub(r"(\b[a-zA-Z]+\b)\s+3\s*$", "$1", True),
    Sub(r"\A• n ", "• In "), Sub(r"\A• l ", "• I "),
)
#: A letter and bracket with no word after it (look-ahead: Java only).
LONE_LABEL = Sub(r"\s+[a-c]\s*\)(?!\s*[A-Za-z])")
# Misread words of single questions, in order.
QUESTION_WORDS = (
    Sub(r"\bIdentiff\b", "Identify"), Sub(r"\bIdentifu\b", "Identify"), Sub(r"\bdentifu\b", "Identify"), Sub(r"\bIl-xolain\b", "Explain"), Sub(r"\b-xolain\b", "Explain"), Sub(r"\bxolain\b", "Explain"), Sub(r"\bltaz-afi\b", "hazard"),
    Sub(r"\blltaz\b", "hazard"), Sub(r"\bItaz\b", "hazard"), Sub(r"\bpartiqipation\b", "participation"), Sub(r"\bpartiqipate\b", "participate"), Sub(r"t`eatures", "features"), Sub(r"!a\}[€}]r", "layer"), Sub(r"la\*\*r", "layer"),
    Sub(r"d[€}]taii", "detail"), Sub(r"d[€}]td[:\-]+", "detail"), Sub(r"Statethe\b", "State the"), Sub(r"hazardmapping\b", "hazard mapping"), Sub(r"Monsoonand\b", "Monsoon and"), Sub(r"importanceofozone\b", "importance of ozone"),
    Sub(r"\s+3\s*\z", "."), Sub(r"\s+J\s+J\s*", " "), Sub(r"\s+J\s*\z"), Sub(r"\s+J\s+([A-Z])", " $1"), Sub(r"What are'disasters\?", "What are disasters?"),
)
# Beginnings of cut-off questions and what completes them.
COMPLETIONS = {
    "What are disasters? What are their": "What are disasters? What are their causes?",
    "Define hazard,, List different types of": "Define hazard. List different types of hazards.",
    "Explain the contemporary approaches to risk": "Explain the contemporary approaches to risk assessment.",
    "Explain the importance of communication in disaster": "Explain the importance of communication in disaster management.",
    "Explain the major reasons for ozone": "Explain the major reasons for ozone depletion.",
    "Describe the effective ways of promoting Stakeholder": "Describe the effective ways of promoting Stakeholder engagement.",
    "Explain the uses of": "Explain the uses of hazard maps.",
    "Explain Indian monsoon in d": "Explain Indian monsoon in detail.",
    "Explain Green House Effect in d": "Explain Green House Effect in detail.",
}
SIGNALS = (r"[€@$~^]+", r"(?i)[a-z]`[a-z]", r"\b\w*[!|]\w+\b", r"(?i)\b[a-z]{1,2}[}\]{][a-z]\b", r"(?i)Identiff", r"(?i)\bxolain\b", r"(?i)\bdentifu\b", r"(?i)^\s*-\s*xolain", r"[A-Za-z]\{[A-Za-z]", r"[A-Za-z0-9]\s+3\s*\z", r"(?i)\bItaz\b", r"(?i)\blltaz\b")
ACTIONS = (
    "explain define describe discuss what how why list enumerate state elaborate illustrate classify compare differentiate contrast distinguish mention identify briefly detail outline summarize evaluate analyze analyse "
    "examine comment write give draw show demonstrate calculate derive prove determine find compute verify check"
).split()
TOPIC = (
    Sub(r"(?i)\(\s*\d+\s*marks?\s*\)"), Sub("(?i)^(?:" + "|".join(ACTIONS) + r")\s+"),
    Sub(r"(?i)\b(with\s+(the\s+)?(help\s+of\s+)?(a\s+)?(suitable\s+)?(neat\s+)?(labelled\s+)?(diagram|example|sketch|graph))\b"), Sub(r"(?i)\b(in\s+detail|briefly)\b"),
)


def clean_page(text: Column, lone_label: bool = True) -> Column:
    """Page text with misread words repaired and lines without a letter or digit dropped."""
    out = rewrite(text, (*PAGE_WORDS[:-2], LONE_LABEL, *PAGE_WORDS[-2:]) if lone_label else PAGE_WORDS)
    lines = F.split(F.regexp_replace(out, r"[ \t]{2,}", " "), "\n", -1)
    return F.array_join(F.filter(lines, lambda x: x.rlike("[A-Za-z0-9]")), "\n")


def repair_question(text: Column, completions: dict[str, str] = COMPLETIONS, slack: int = 15) -> Column:
    """A known beginning that is not much longer than itself gives its completion, else the repairs apply."""
    t, out = strip(text), None
    for start, whole in completions.items():
        hit = t.startswith(start) & (F.length(t) <= len(start) + slack)
        out = F.when(hit, whole) if out is None else out.when(hit, whole)
    fixed = rewrite(t, (*QUESTION_WORDS, STRIP))
    return fixed if out is None else out.otherwise(fixed)


def needs_cleaning(text: Column) -> Column:
    """Not junk, and with a sign of misreading, or short without being a question."""
    signs = text.rlike(SIGNALS[0])
    for s in SIGNALS[1:]:
        signs = signs | text.rlike(s)
    return ~is_junk(text) & (signs | ((F.length(strip(text)) < 20) & ~strip(text).endswith("?")))


def topic_name(text: Column) -> Column:
    """A question's core concept: no verb, no filler, the first sentence if it is short, 60 characters."""
    out = rewrite(text, TOPIC)
    head = F.substring(out, 1, 100)
    out = F.when(head.contains("."), F.substring_index(out, ".", 1)).when(head.contains("?"), F.substring_index(out, "?", 1)).otherwise(out)
    words = F.filter(F.split(F.substring(F.regexp_replace(out, r"(?i)^(the|a|an)\s+", ""), 1, 60), r"\s+"), lambda w: F.length(w) > 0)
    big = lambda w: (F.length(w) > 3) | F.lower(w).isin("ktu", "co2", "ph", "gis")
    named = F.array_join(F.transform(words, lambda w: F.when(big(w), F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 100)))).otherwise(F.lower(w))), " ")
    return F.when(F.length(named) > 0, named).otherwise(F.substring(text, 1, 50))
