"""Secret scan with corpus-wide ownership frequency (DataFrame functions only).

Candidates are found in each whole text; their hashes are then aggregated over the corpus
by distinct repositories and distinct owners. A value that many owners carry, or two in many
repositories, is a copied example (documentation keys, sample configs); a random-looking value
that one owner alone carries, in however many repositories, is a credential that looks live. Live
values are masked by their spans, overlapping ones as one; equal text elsewhere stays. What is
written and shuffled are spans and hashes; values are read from the text again where they are masked.

Defined results: null and empty texts have no candidates; rows that repeat a ``doc_id``
count as one repository, and each of them gets the classes of all their candidates; a null
owner is an owner of its own; an empty table gives an empty result. Inputs keep their
other columns wherever whole documents are returned (:func:`mask_live`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradloom.llm.common import cut, fresh

_ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A private key: its body, to the END line if that is the next line of dashes, else to the end of its base64 lines.
_BEGIN, _END, _GAP = "-----BEGIN [A-Z ]*PRIVATE KEY-----", "-----END [A-Z ]*PRIVATE KEY-----", r"(?:\s|\\[rn])++"
_LINES = rf"(?:(?:{_GAP}(?:Proc-Type|DEK-Info):\s*+[^\s\\]++)*+(?:{_GAP}[A-Za-z0-9+/=]{{16,}}+)++(?:{_GAP}[A-Za-z0-9+/=]{{1,15}}+(?=\x20*(?:[\r\n\\]|\z)))?+)?+"
_PEM = rf"{_BEGIN}((?>[\s\S]*?(?=-----))(?={_END})|{_LINES})(?:{_END})?"

#: kind, pattern, group that holds the value, least length of that group, a cheaper test that every match passes.
BASE = (
    ("assign", _ASSIGN, 2, 8, r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"),
    ("access", r"AKIA[A-Z0-9]+", 0, 16, None),
    ("hex", r"[0-9a-f]+", 0, 32, r"[0-9a-f]{32}"),
)
#: Kinds that the operator adds to the base: token formats with a fixed prefix.
EXTRA = (
    ("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40, None),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20, None),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40, None),
    ("pem", _PEM, 1, 0, _BEGIN),
)
_BLOCK = 64
#: Owners that make an example; repositories that do for two owners.
WIDELY, COPIES = 3, 10
SPAN = "struct<start:bigint,rank:int,end:bigint,kind:string,value:string,at:bigint>"  # at: where the value starts


def _with_spans(df: DataFrame, text: str, out: str, rank: int, spec: tuple) -> DataFrame:
    """Adds ``out``: the spans of one kind, null where the text has none.

    ``regexp_extract_all`` gives the matches and ``split`` the gaps between them, so the
    running sum of their lengths (code points) gives the positions. The sum is taken over
    blocks of 64, which keeps it near linear for texts with very many matches.
    """
    kind, rx, group, least, guard = spec
    m, g, steps, base = f"{out}_m", f"{out}_g", f"{out}_l", f"{out}_o"
    has = F.col(text).rlike(guard or rx)
    df = df.withColumn(m, F.when(has, F.regexp_extract_all(text, F.lit(rx), F.lit(0)))).withColumn(g, F.when(has, F.split(text, rx, -1)))
    df = df.withColumn(steps, F.transform(m, lambda x, i: (F.length(x) + F.length(F.get(F.col(g), i))).cast("long")))
    add = lambda a, x: a + x
    zero = F.lit(0).cast("long")
    blocks = f"{out}_b"
    df = df.withColumn(blocks, F.when(F.size(m) > 0, F.transform(F.sequence(F.lit(0), F.expr(f"(size({m}) - 1) div {_BLOCK}").cast("int")), lambda b: F.aggregate(F.slice(F.col(steps), b * _BLOCK + 1, F.lit(_BLOCK)), zero, add))))
    df = df.withColumn(base, F.transform(blocks, lambda x, b: F.aggregate(F.slice(F.col(blocks), F.lit(1), b), zero, add)))

    def span(x: Column, i: Column) -> Column:
        block = F.floor(i / _BLOCK).cast("int")
        start = F.get(F.col(base), block) + F.aggregate(F.slice(F.col(steps), block * _BLOCK + 1, i % _BLOCK), zero, add) + F.length(F.get(F.col(g), i))
        value = F.regexp_extract(x, rx, group) if group else x
        # a block's body follows its BEGIN line, any other value ends its match
        at = start + F.length(F.regexp_extract(x, guard, 0)) if kind == "pem" else start + F.length(x) - F.length(value)
        return F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + F.length(x)).alias("end"), F.lit(kind).alias("kind"), value.alias("value"), at.cast("long").alias("at"))

    # size(base) keeps the optimizer from folding the running sums into the lambda
    found = F.when(F.size(base) > 0, F.filter(F.transform(m, span), lambda s: F.length(s["value"]) >= least))
    return df.withColumn(out, found).drop(m, g, steps, base, blocks)


def find(df: DataFrame, text_col: str = "text", out: str = "secret_spans") -> DataFrame:
    """``df`` with the array ``out`` of spans (code points, end exclusive), by start, then kind as listed."""
    kinds = [*BASE, *EXTRA]
    names = fresh(df, "__text", *[f"__s{i}" for i in range(len(kinds))])
    df = df.withColumn(names[0], F.coalesce(F.col(text_col), F.lit("")))
    for i, spec in enumerate(kinds):
        df = _with_spans(df, names[0], names[i + 1], i, spec)
    none = F.array().cast(f"array<{SPAN}>")
    return df.withColumn(out, F.sort_array(F.concat(*[F.coalesce(F.col(n), none) for n in names[1:]]))).drop(*names)


def hashed(spans: Column) -> Column:
    """Spans (start, rank, end, kind) with the hash of the value, whether that looks random, and where it stands, instead of the
    value itself: this is what is written and shuffled, so no credential leaves its text."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), F.sha2(s["value"], 256).alias("hash"), looks_random(s["value"]).alias("random")))


def looks_random(value: Column) -> Column:
    """Placeholders repeat few characters or say what they are."""
    distinct = F.size(F.array_distinct(F.regexp_extract_all(value, F.lit("(?s)."), F.lit(0))))
    return (distinct >= 8) & ~value.rlike("(?i)example|changeme|placeholder|dummy|sample|your[_-]")


def ownership(cands: DataFrame, owner: str, repo: str, widely: int = WIDELY, copies: int = COPIES) -> DataFrame:
    """One row for each hash: ``n_owners``, ``n_repos`` and its ``secret_class``.

    ``cands`` has a row for each (hash, owner, repo) with ``random``; every step aggregates
    before it shuffles, so a hash that a third of the corpus carries stays a few rows.
    """
    per_repo = cands.groupBy("hash", owner, repo).agg(F.max("random").alias("random"))
    per_owner = per_repo.groupBy("hash", owner).agg(F.count(F.lit(1)).alias("n_repos"), F.max("random").alias("random"))
    per_hash = per_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("n_repos").alias("n_repos"), F.max("random").alias("random"))
    many = (F.col("n_owners") >= widely) | (F.col("n_owners") >= 2) & (F.col("n_repos") >= copies)
    kind = F.when(many, "example").when((F.col("n_owners") == 1) & F.col("random"), "live").otherwise("weak")
    return per_hash.select("hash", "n_owners", "n_repos", kind.alias("secret_class"))


def _candidates(found: DataFrame, key: str, owner: str, repo: str) -> DataFrame:
    """A row for each distinct value of each row of ``found``."""
    s = found.where(F.size("spans") > 0).select(F.col(key).alias("key"), F.col(owner).alias("owner"), F.col(repo).alias("repo"), F.explode("spans").alias("s"))
    return s.select("key", "owner", "repo", "s.hash", "s.random").distinct()


def classify(docs: DataFrame, key: str = "doc_id", text_col: str = "text", owner: str = "source", repo: str = "doc_id", widely: int = WIDELY) -> tuple[DataFrame, DataFrame]:
    """(key and spans of every row, class of every distinct value of every key), values by their hashes alone.

    The texts are read once: the spans go to the shared folder, and the corpus counts and
    the join back work on them alone.
    """
    found = find(docs.select(F.col(key).alias("key"), F.col(owner).alias("owner"), F.col(repo).alias("repo"), F.col(text_col).alias("text")), out="spans").drop("text")
    found = cut(found.withColumn("spans", hashed(F.col("spans"))), "spans")
    cands = cut(_candidates(found, "key", "owner", "repo"), "candidates")
    owned = cut(ownership(cands, "owner", "repo", widely), "ownership")
    return found, cands.join(owned, "hash").select("key", "hash", "n_owners", "n_repos", "secret_class")


def mask_live(docs: DataFrame, key: str = "doc_id", text_col: str = "text", owner: str = "source", repo: str = "doc_id", widely: int = WIDELY, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every live-looking value's spans replaced in the text; nothing else changes.

    Only documents that hold such a value are joined, by key; all others pass unshuffled.
    """
    _, classes = classify(docs, key, text_col, owner, repo, widely)
    values, flag, k, spans, text = fresh(docs, "__live", "__has", "__key", "__spans", "__text")
    live = cut(classes.where("secret_class = 'live'").groupBy(F.col("key").alias(k)).agg(F.collect_set("hash").alias(values)), "live")
    any_kind = F.lit(False)
    for _, rx, _, _, guard in [*BASE, *EXTRA]:
        any_kind = any_kind | F.col(text_col).rlike(guard or rx)
    flagged = docs.withColumn(flag, F.coalesce(any_kind, F.lit(False)))
    rest = flagged.where(~F.col(flag)).drop(flag)
    hit = flagged.where(flag).drop(flag).join(live, F.col(key).eqNullSafe(F.col(k)), "left")
    hit = find(hit.withColumn(text, F.when(F.col(values).isNotNull(), F.col(text_col))), text, spans)
    mine = F.array_sort(F.transform(F.filter(spans, lambda s: F.array_contains(F.col(values), F.sha2(s["value"], 256))), lambda s: F.struct(s["at"].alias("at"), (s["at"] + F.length(s["value"])).alias("end"))))
    masked = F.when(F.size(mine) > 0, without(F.col(text_col), mine, mask)).otherwise(F.col(text_col))
    return rest.unionByName(hit.withColumn(text_col, masked).drop(values, k, spans, text))


def without(text: Column, spans: Column, mask: str) -> Column:
    """The text with its ``spans`` (at, end; sorted) replaced; those that overlap or touch are one."""
    begin = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("upto"))

    def step(state: Column, s: Column) -> Column:
        gap = F.substring(text, (state["upto"] + 1).cast("int"), (s["at"] - state["upto"]).cast("int"))
        more = F.when((s["at"] <= state["upto"]) & (state["upto"] > 0), F.lit("")).otherwise(F.concat(gap, F.lit(mask)))
        return F.struct(F.concat(state["out"], more).alias("out"), F.greatest(state["upto"], s["end"]).alias("upto"))

    return F.aggregate(spans, begin, step, lambda state: F.concat(state["out"], F.substring(text, (state["upto"] + 1).cast("int"), F.length(text))))


def op6(docs: DataFrame) -> DataFrame:
    """The contract of ``op6_secret_ownership``, with the number of values of each class and the most
    owners and repositories that any of the document's values has."""
    found, classes = classify(docs.select("doc_id", "source", "text"))
    of = lambda name: F.coalesce(F.sum((F.col("secret_class") == name).cast("long")), F.lit(0)).alias(f"n_{name}")
    most = lambda name: F.max(name).alias(f"most_{name[2:]}")
    per_doc = cut(classes.groupBy(F.col("key").alias("k")).agg(of("live"), of("example"), of("weak"), most("n_owners"), most("n_repos")), "per-doc")
    joined = found.join(per_doc, F.col("key").eqNullSafe(F.col("k")), "left")
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    return joined.select(
        F.col("key").alias("doc_id"), n("assign"), n("access"), n("hex"), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"),
        *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("n_live", "n_example", "n_weak", "most_owners", "most_repos")],
    )
