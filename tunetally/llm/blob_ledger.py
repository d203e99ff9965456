"""Secret scans with an incremental ledger of blobs.

Every version of a text is a blob, named by the SHA-256 of its bytes. The ledger says
which rules, in which version, have scanned which blob, and what they found. An update
scans a blob once however many paths hold it, and only with rules (or rule versions) that
it has not met. Findings are joined back to all paths of a blob.

Everything is DataFrame functions; spans count code points, and ends are exclusive.

Defined results: a null text is the blob of the empty text; null paths and repeated rows
have their own results; an empty table gives an empty result. Other columns are left
alone, whatever they are called.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunetally.session import materialize

LEDGER = "blob binary, scanned array<string>, spans array<struct<kind:string,start:int,end:int>>"
_SPANS = "array<struct<kind:string,start:int,end:int>>"
PLACEHOLDER = "[SECRET]"
#: Up to so many open blobs, 32 bytes each, are broadcast.
MAX_OPEN = 500_000


@dataclass(frozen=True)
class Rule:
    """A pattern, and the characters its `group` must have to count; all matches, left to
    right, consume their text."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The base kinds. A run of 16 or more is the same as a run that is kept if
# it has 16 or more, as runs are not followed by one more of their characters.
BASE_RULES = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        12,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}"),
)
# Public formats of tokens that the base kinds don't cover.
RULES = (
    *BASE_RULES,
    # Header lines, a body of base64 runs, the first of 32 and more, and the END line, which a
    # key that is cut off does not have; or header lines and the END line. A marker in prose is
    # no key. No part is limited, and none is walked back.
    Rule(
        "pem",
        r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY(?: BLOCK)?-----[\s\\]*+"
        r"(?:[A-Za-z][A-Za-z0-9-]*+:(?:[^\n-]|-(?!----))*+\s*+)*+"
        r"(?:n?+[A-Za-z0-9+/=]{32,}+[\s\\]*+(?:[A-Za-z0-9+/=]{16,}+[\s\\]*+)*+"
        r"(?:(?:[A-Za-z0-9+/=]{1,15}+[\s\\]*+){1,2}+(?=-----END|\z))?+"
        r"(?:-----END [A-Z ]{0,20}PRIVATE KEY(?: BLOCK)?-----)?+"
        r"|-----END [A-Z ]{0,20}PRIVATE KEY(?: BLOCK)?-----)",
        version=3,
    ),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+"),
    Rule("forge", r"\b(ghp|gho|ghu|ghs|ghr|glpat|xoxb|xoxp)[_-][A-Za-z0-9_-]{16,}"),
)
BASE_KINDS = tuple(r.kind for r in BASE_RULES)


def blob_of(text: str = "text") -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def spans_of(text: Column, rule: Rule) -> Column:
    """All spans of one rule: lengths of matches and of the gaps between them, added up."""
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    gaps = F.split(text, rule.pattern, -1)
    none = F.array().cast(_SPANS)

    def step(gap: Column, match: Column) -> Column:
        counted = F.regexp_extract(match, rule.pattern, rule.group) if rule.group else match
        good = F.char_length(counted) >= rule.least
        return F.struct(F.char_length(gap).alias("gap"), F.char_length(match).alias("size"), good.alias("good"))

    def merge(state: Column, one: Column) -> Column:
        start = state["at"] + one["gap"]
        end = start + F.coalesce(one["size"], F.lit(0))
        span = F.struct(F.lit(rule.kind).alias("kind"), start.alias("start"), end.alias("end"))
        # The last gap has no match.
        found = F.when(F.coalesce(one["good"], F.lit(False)), F.concat(state["found"], F.array(span)))
        return F.struct(end.alias("at"), F.coalesce(found, state["found"]).alias("found"))

    start = F.struct(F.lit(0).alias("at"), none.alias("found"))
    walked = F.aggregate(F.zip_with(gaps, matches, step), start, merge)["found"]
    return F.when(F.size(matches) > 0, walked).otherwise(none)


def scan_new(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Ledger rows for the blobs of `versions` (with `text`) that a rule has not scanned.

    With a ledger, blobs are compared by their hashes first, and only texts of blobs that a
    rule has not met go on."""
    keys = F.array(*(F.lit(r.key) for r in rules))
    blobs = versions.select(blob_of().alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    if ledger is None:
        todo = blobs.groupBy("blob").agg(F.first("text").alias("text")).withColumn("todo", keys)
    else:
        seen = ledger.groupBy("blob").agg(F.flatten(F.collect_list("scanned")).alias("seen"))
        rest = F.array_except(keys, F.coalesce("seen", F.array().cast("array<string>")))
        open_ = blobs.select("blob").distinct().join(seen, "blob", "left").select("blob", rest.alias("todo"))
        open_ = materialize(open_.where(F.size("todo") > 0), "open-blobs")
        # Few open blobs keep the texts of all others out of the shuffle; of many, most texts
        # have to go through it anyway.
        few = open_.count() <= MAX_OPEN
        texts = blobs.join(F.broadcast(open_.select("blob")), "blob", "left_semi") if few else blobs
        texts = texts.groupBy("blob").agg(F.first("text").alias("text"))
        todo = texts.join(open_, "blob")
    none = F.array().cast(_SPANS)
    found = [F.when(F.array_contains("todo", r.key), spans_of(F.col("text"), r)).otherwise(none) for r in rules]
    return todo.select("blob", F.col("todo").alias("scanned"), F.concat(*found).alias("spans"))


def findings(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`versions` (with `blob`) and the `spans` of the rules in each, in order of start,
    then of rules."""
    order = F.map_from_arrays(F.array(*(F.lit(r.kind) for r in rules)), F.array(*(F.lit(k) for k in range(len(rules)))))
    current = F.array(*(F.lit(r.key) for r in rules))
    useful = ledger.where(F.size("spans") > 0).where(F.arrays_overlap("scanned", current))
    version = F.map_from_entries(
        F.transform("scanned", lambda k: F.struct(F.substring_index(k, "@", 1), k))
    )
    live = F.filter("spans", lambda s: F.array_contains(current, version[s["kind"]]))
    spans = useful.select("blob", live.alias("spans")).groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    ranked = F.transform("spans", lambda s: F.struct(s["start"], order[s["kind"]].alias("o"), s["end"], s["kind"]))
    ranked = F.transform(F.array_sort(ranked), lambda s: F.struct(s["kind"], s["start"], s["end"]))
    spans = spans.select("blob", ranked.alias("spans"))
    out = versions.join(spans, "blob", "left")
    return out.withColumn("spans", F.coalesce("spans", F.array().cast(_SPANS)))


def span_text(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def updated(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger with what `versions` adds to it, which is written."""
    fresh = materialize(scan_new(versions, ledger, rules), "blob-ledger")
    return fresh if ledger is None else union_ledgers(ledger, fresh)


def report(docs: DataFrame, former: DataFrame | None = None) -> DataFrame:
    """Per row doc_id, the count of each base kind, the hash of the base spans, and all
    spans as text. `former` is an earlier version of the table, whose ledger is made first."""
    ledger = updated(docs, None if former is None else updated(former))
    found = findings(docs.select("doc_id", blob_of().alias("blob")), ledger)
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(count, BASE_KINDS), F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans")
    )


def redact(docs: DataFrame) -> DataFrame:
    """The rows of `docs` with `PLACEHOLDER` in the place of every span; spans that overlap
    or touch are one. `n_chars` is counted again where there is such a column."""
    names = docs.columns
    plain = docs.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)))
    text = f"c{names.index('text')}"
    ledger = updated(docs.select("text"))
    found = findings(plain.withColumn("blob", blob_of(text)), ledger)

    def cut(state: Column, span: Column) -> Column:
        between = F.substring(F.col(text), state["at"] + 1, span["start"] - state["at"])
        apart = (span["start"] > state["at"]) | (state["at"] == 0)
        out = F.when(apart, F.concat(state["out"], between, F.lit(PLACEHOLDER))).otherwise(state["out"])
        return F.struct(out.alias("out"), F.greatest(state["at"], span["end"]).alias("at"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    rest = lambda s: F.concat(s["out"], F.substring(F.col(text), s["at"] + 1, F.char_length(F.col(text))))
    changed = F.aggregate("spans", start, cut, rest)
    found = found.withColumn(text, F.when(F.size("spans") > 0, changed).otherwise(F.col(text)))
    out = found.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(names)))
    if "n_chars" in names:
        n_chars = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.coalesce(n_chars, F.col("n_chars")))
    return out


def union_ledgers(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
