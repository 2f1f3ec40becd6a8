"""Per-question decisions: module, cognitive level, difficulty, type, tier."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The lexicons, in the order that decides ties.
BLOOM = {
    "remember": ("define", "list", "state", "name", "identify", "recall", "recognize", "describe", "label", "match", "select", "what is", "who", "when", "where", "how many", "enumerate"),
    "understand": ("explain", "summarize", "interpret", "classify", "compare", "contrast", "discuss", "distinguish", "illustrate", "translate", "paraphrase", "give example", "differentiate", "infer"),
    "apply": ("apply", "demonstrate", "calculate", "solve", "use", "compute", "implement", "execute", "perform", "construct", "show", "produce", "operate", "determine", "find", "draw"),
    "analyze": ("analyze", "examine", "investigate", "compare and contrast", "categorize", "deduce", "differentiate", "distinguish", "outline", "break down", "relate", "organize", "attribute", "deconstruct"),
    "evaluate": ("evaluate", "judge", "assess", "justify", "critique", "defend", "argue", "support", "appraise", "recommend", "prioritize", "rate", "decide", "verify", "validate", "criticize"),
    "create": ("create", "design", "develop", "formulate", "propose", "construct", "invent", "compose", "generate", "plan", "produce", "devise", "synthesize", "integrate", "modify", "write a program", "build"),
}
DIFFICULTY = {
    "easy": ("define", "list", "state", "name", "what is", "give example", "identify", "recall", "basic", "simple", "elementary"),
    "medium": ("explain", "describe", "compare", "contrast", "discuss", "illustrate", "classify", "solve", "calculate", "apply", "demonstrate", "interpret"),
    "hard": ("analyze", "evaluate", "design", "create", "synthesize", "justify", "critique", "prove", "derive", "optimize", "complex", "advanced", "challenging", "develop", "construct"),
}
TYPES = {"definition": ("define", "what is"), "derivation": ("derive", "proof"), "numerical": ("calculate", "compute"), "diagram": ("draw", "diagram"), "comparison": ("compare", "differentiate")}
TYPES_RICH = {
    "definition": ("define", "what is", "explain briefly"), "derivation": ("derive", "proof", "show that"), "numerical": ("calculate", "compute", "find"), "diagram": ("draw", "diagram", "sketch"),
    "comparison": ("compare", "differentiate"),
}
BLOOM_FIRST = {
    "remember": ("list", "define", "name", "state"), "understand": ("explain", "describe", "discuss"), "apply": ("apply", "calculate", "solve"), "analyze": ("analyze", "examine", "compare"),
    "evaluate": ("evaluate", "assess", "justify"), "create": ("create", "design", "develop"),
}
TIER_LABELS = {1: "Top Priority", 2: "High Priority", 3: "Medium Priority", 4: "Low Priority"}
LIKELIHOOD = ((80, "Very High (appears almost every year)"), (60, "High (appears frequently)"), (40, "Moderate (appears occasionally)"), (20, "Low (appears rarely)"))
#: What stands between words.
NOT_WORD = r"[^\p{L}\p{Nd}_]+"
ZONES = ((0.90, "high"), (0.82, "llm"), (0.80, "dead"))


def contains_any(text: Column, words: Sequence[str]) -> Column:
    out = text.contains(words[0])
    for w in words[1:]:
        out = out | text.contains(w)
    return out


def first_match(text: Column, choices: dict[str, Sequence[str]], default: str) -> Column:
    """The first choice one of whose words the lower-cased text contains."""
    low, out = F.lower(text), None
    for name, words in choices.items():
        hit = contains_any(low, words)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)


def best_of(scores: dict[str, Column]) -> Column:
    """The name of the largest score, the earliest of equals; every score is computed once."""
    return F.array_max(F.array(*[F.struct(s.alias("score"), F.lit(-i).alias("order"), F.lit(name).alias("name")) for i, (name, s) in enumerate(scores.items())]))["name"]


def bloom_level(text: Column) -> Column:
    """Whole-word counts weighted 6 to 1 by level; without any word, understand.

    The text is cut into words once; those that no level has go, and one fold counts the few that are left. No level has a word that is part of another of its
    own, so counting them apart is counting them together.
    """
    low, n = F.lower(text), len(BLOOM)
    single = {level: [w for w in words if " " not in w] for level, words in BLOOM.items()}
    phrases = {level: [w for w in words if " " in w] for level, words in BLOOM.items()}
    hits = F.filter(F.split(low, NOT_WORD), lambda w: w.isin(*dict.fromkeys(w for words in single.values() for w in words)))
    start = F.struct(*[sum((F.when(low.contains(p), F.regexp_count(low, F.lit(rf"\b{p}\b"))).otherwise(0) for p in ps), F.lit(0)).alias(level) for level, ps in phrases.items()])
    count = lambda a, w: F.struct(*[(a[level] + w.isin(*words).cast("int")).alias(level) for level, words in single.items()])

    def best(a: Column) -> Column:
        scores = [("understand", F.lit(0)), *[(level, a[level] * (n - i)) for i, level in enumerate(BLOOM)]]  # of equals the first, which is the default where no word was found
        return F.array_max(F.array(*[F.struct(s.alias("score"), F.lit(-i).alias("order"), F.lit(level).alias("level")) for i, (level, s) in enumerate(scores)]))["level"]

    return F.when(text.isNotNull(), F.aggregate(hits, start, count, best))


def difficulty(text: Column, marks: Column) -> Column:
    """Indicator words found, plus marks, length and sub-parts; ties go to the easier."""

    def of(s: Column) -> Column:
        low, m = s["low"], s["m"]
        score = {k: sum((low.contains(w).cast("int") for w in words[1:]), low.contains(words[0]).cast("int")) for k, words in DIFFICULTY.items()}
        bump = lambda condition, by: F.when(condition, by).otherwise(0)
        score["easy"] = score["easy"] + bump((m != 0) & (m <= 2), 2) + bump(s["n"] < 20, 1)
        score["medium"] = score["medium"] + bump((m > 2) & (m <= 5), 2) + bump(s["parts"], 1)
        score["hard"] = score["hard"] + bump(m > 5, 2) + bump(s["n"] > 50, 1)
        return best_of(score)

    n = F.size(F.filter(F.split(text, r"\s+"), lambda w: F.length(w) > 0))
    parts = text.rlike(r"\([a-z]\)") | text.rlike(r"[ivx]+\)")
    # an array of one: what it holds is computed once, and not for each of the words
    once = F.array(F.struct(F.lower(text).alias("low"), F.coalesce(marks, F.lit(0)).alias("m"), n.alias("n"), parts.alias("parts")))
    return F.when(text.isNotNull(), F.get(F.transform(once, of), F.lit(0)))


def question_type(text: Column, rich: bool = False) -> Column:
    return first_match(text, TYPES_RICH if rich else TYPES, "theory")


def bloom_first(text: Column) -> Column:
    return first_match(text, BLOOM_FIRST, "understand")


def difficulty_by_length(text: Column) -> Column:
    n = F.size(F.filter(F.split(text, r"\s+"), lambda w: F.length(w) > 0))
    return F.when(n < 10, "easy").when(n < 30, "medium").otherwise("hard")


def tier(frequency: Column, first: int = 4, second: int = 3, third: int = 2) -> Column:
    return F.when(frequency >= first, 1).when(frequency >= second, 2).when(frequency >= third, 3).otherwise(4)


def tier_label(t: Column) -> Column:
    out = F.when(t == 1, TIER_LABELS[1])
    for k in (2, 3, 4):
        out = out.when(t == k, TIER_LABELS[k])
    return out


def likelihood(frequency: Column, years: Column) -> Column:
    share = frequency * 100.0 / F.nullif(years, F.lit(0))
    out = F.when(F.coalesce(years, F.lit(0)) == 0, "Insufficient data")
    for least, text in LIKELIHOOD:
        out = out.when(share >= least, text)
    return out.otherwise("Very Low (appears once)")


def zone(similarity: Column) -> Column:
    out = F.when(similarity >= ZONES[0][0], ZONES[0][1])
    for least, name in ZONES[1:]:
        out = out.when(similarity >= least, name)
    return out.otherwise("reject")


def hybrid_same(similarity: Column, confirmed: Column | None = None, high: float = 0.85, low: float = 0.65, middle: float = 0.75) -> Column:
    """Alike from ``high``, different below ``low``; between them what a model confirmed, else ``middle`` decides."""
    between = similarity >= middle
    return F.when(similarity >= high, True).when(similarity < low, False).otherwise(between if confirmed is None else F.coalesce(confirmed, between))


def fixed_module(number: Column, part: Column, hint: Column) -> tuple[Column, Column]:
    """(part, module) by number: 1-10 are part A, 11-20 part B, two to a module; beyond, the row's own."""
    by_pair = lambda n, first: (F.floor((n - first) / 2) + 1).cast("int")
    own = F.when(number <= 10, F.when(number >= 1, by_pair(number, 1)).otherwise(5)).when(number <= 20, by_pair(number, 11)).otherwise(F.coalesce(hint, F.lit(5)))
    return F.when(number <= 10, "A").when(number <= 20, "B").otherwise(F.coalesce(part, F.lit("B"))), own


def clamped_module(number: Column) -> Column:
    n = F.when(number <= 10, F.floor((number - 1) / 2) + 1).otherwise(F.floor((number - 11) / 2) + 1)
    return F.greatest(F.lit(1), F.least(F.lit(5), n)).cast("int")


def pattern_module(config: Column, number: Column, part: Column) -> Column:
    """The module that an exam pattern (map of part to map of number) gives, null if none."""
    digits = F.nullif(F.regexp_extract(number, r"^(\d+)", 1), F.lit(""))
    return F.try_element_at(F.try_element_at(config, F.concat(F.lit("part_"), F.lower(part))), digits)


def number_range(part: Column, module: Column) -> Column:
    start = F.when(part == "A", module * 2 - 1).otherwise(module * 2 + 9)
    return F.concat(F.lit("Qn "), start.cast("string"), F.lit("-"), (start + 1).cast("string"))


def final_module(explicit: Column, hint: Column, exists: Column, classified: Column) -> Column:
    """A heading in the paper is final (null if there is no such module); the classifier only fills a missing hint."""
    return F.when(explicit, F.when(exists, hint)).when(hint.isNull(), classified).otherwise(F.when(exists, hint))
