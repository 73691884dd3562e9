"""Secret scans over an incremental ledger of content-addressed blobs.

Every version of every path is addressed by the SHA-256 of its text. The ledger tells of each
blob which versions of rules have been run over it, and what they found; a rule's version
is a hash of all that it says. A scan runs only those (blob, rule version) pairs that the
ledger lacks, once per blob however many paths and versions hold it, appends them, and joins
the findings of the rules asked for back to all paths.

Only DataFrame functions are used. Rules that the ledger knows of no blob are run where the
texts lie; for the others only ids meet the ledger, and texts that have nothing left to run stay
where they are if the ids of the rest are few enough to broadcast. Texts are reduced to one
copy per blob before the shuffle where a task sees copies; findings are rows (blob, kind,
start, end), so a very long text gives many small rows; only its kept spans come together
again, in one array. Starts are summed over gaps and matches within a blob and kind.

Defined cases: null text is the empty text; repeated rows share a blob and get its findings
each; a blob without findings is in the ledger with none; a rule may not be given twice; a
column of the versions that is called like the one added is replaced; an empty table scans
nothing.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SMALL_ROWS, free_name, written


@dataclass(frozen=True)
class Rule:
    """A pattern whose leftmost non-overlapping matches are kept if `group` has `least` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: Fixed patterns of the base kinds. Runs of hex digits and capitals are maximal, so the
#: least length stands in the pattern: the same matches, and no short ones to throw away.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
#: Spans that the method adds to the base ones. Fixed patterns of public token formats.
EXTRA_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{20,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE_RULES + EXTRA_RULES


def rule_version(rule: Rule) -> str:
    return hashlib.sha256(repr(rule).encode()).hexdigest()[:16]


def _versions(rules: tuple[Rule, ...]) -> list[str]:
    versions = [rule_version(r) for r in rules]
    if len(set(versions)) < len(versions):
        raise ValueError("a rule is given twice")
    return versions


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


MATCHES = "array<struct<kind:int,gap:int,size:int,kept:boolean>>"


def _matches(text: Column, number: int, rule: Rule) -> Column:
    """The rule's matches in order, kept or not: kind number, gap before, length, kept."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    gaps = F.slice(F.split(text, rule.pattern, -1), 1, F.size(whole))
    row = lambda gap, match, kept: F.struct(F.lit(number).alias("kind"), F.length(gap).alias("gap"), F.length(match).alias("size"), kept.alias("kept"))
    if rule.group:
        parts = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
        both = F.zip_with(whole, parts, lambda m, g: F.struct(m.alias("m"), (F.length(g) >= rule.least).alias("k")))
        found = F.zip_with(gaps, both, lambda gap, b: row(gap, b["m"], b["k"]))
    else:
        found = F.zip_with(gaps, whole, lambda gap, m: row(gap, m, F.length(m) >= rule.least))
    return F.when(text.rlike(rule.pattern), found).otherwise(F.array().cast(MATCHES))


SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"
LEDGER = "blob string, rules array<string>, spans array<struct<start:bigint,rule:string,end:bigint>>"


def _due(blobs: DataFrame, ledger: DataFrame, bits: dict[str, int]) -> DataFrame:
    """(blob, due) of blobs with rules left to run: bit bits[v] of `due` stands for version v."""
    asked = F.array(*map(F.lit, bits))
    seen = ledger.where(F.arrays_overlap("rules", asked)).groupBy("blob").agg(F.flatten(F.collect_list(F.array_intersect("rules", asked))).alias("seen"))
    due = F.lit(0)
    for version, bit in bits.items():
        due = due + F.when(F.array_contains("seen", version), 0).otherwise(1 << bit)
    return blobs.select("blob").distinct().join(seen, "blob", "left").select("blob", due.alias("due")).where("due > 0")


def _scanned(blobs: DataFrame, rules: tuple[Rule, ...], names: list[str]) -> DataFrame:
    """Rows of the ledger for `blobs` (blob, text, due: bits of the rules to run)."""
    asked = [F.col("due").bitwiseAND(1 << i) != 0 for i in range(len(rules))]
    # Texts without any match need no shuffle: only their ids do.
    suspect = F.lit(False)
    for rule, due in zip(rules, asked, strict=True):
        suspect = suspect | (due & F.col("text").rlike(rule.pattern))
    blobs = blobs.withColumn("text", F.when(suspect, F.col("text")))
    blobs = blobs.groupBy("blob").agg(F.first("text", ignorenulls=True).alias("text"), F.first("due").alias("due"))
    matches = F.concat(*[F.when(due, _matches(F.col("text"), i, r)).otherwise(F.array().cast(MATCHES)) for i, (r, due) in enumerate(zip(rules, asked, strict=True))])
    rows = blobs.select("blob", "due", F.posexplode_outer(F.when(F.col("text").isNotNull(), matches)).alias("pos", "m")).select("blob", "due", "pos", "m.*")
    so_far = Window.partitionBy("blob", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(so_far))
    span = F.struct((F.col("end") - F.col("size")).alias("start"), "kind", "end")
    fresh = rows.groupBy("blob").agg(F.first("due").alias("due"), F.array_sort(F.collect_list(F.when(F.col("kept"), span))).cast(SPANS).alias("spans"))
    run = F.array_compact(F.array(*[F.when(due, F.lit(n)) for n, due in zip(names, asked, strict=True)]))
    named = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.element_at(F.array(*map(F.lit, names)), s["kind"] + 1).alias("rule"), s["end"].alias("end")))
    return fresh.select("blob", run.alias("rules"), named.alias("spans"))


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """What this delivery adds to the ledger: blob, rules (the versions that were run) and
    spans, the kept matches in order. A blob has one row for the rules that the ledger knows of
    no blob and one for those of the others that it lacks."""
    names = _versions(rules)
    blobs = versions.select(blob_id(F.col(text_col)).alias("blob"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known: set[str] = set()
    if ledger is not None:
        known = {r[0] for r in ledger.select(F.explode("rules").alias("v")).where(F.col("v").isin(names)).distinct().collect()}
    bits = {v: i for i, v in enumerate(names) if v in known}
    fresh = []
    if len(bits) < len(names):  # no pair of these rules can be in the ledger, whatever the blob
        fresh.append(blobs.withColumn("due", F.lit(sum(1 << i for i, v in enumerate(names) if v not in bits))))
    if bits:
        todo = written(_due(blobs, ledger, bits), "secret-todo")
        if todo.count() <= SMALL_ROWS:
            fresh.append(blobs.join(F.broadcast(todo), "blob"))
        else:
            fresh.append(blobs.groupBy("blob").agg(F.first("text").alias("text")).join(todo, "blob"))
    out = _scanned(fresh[0], rules, names)
    for more in fresh[1:]:
        out = out.unionByName(_scanned(more, rules, names))
    return out


def scan_secrets(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text_col: str = "text", spans_col: str = "secret_spans") -> tuple[DataFrame, DataFrame]:
    """(`versions` with the column of spans, the ledger to keep for the next delivery). The
    ledger is the earlier one and what was appended; nothing of it is written again."""
    fresh = written(scan_unseen(versions, ledger, rules, text_col), "secret-ledger")
    ledger = fresh if ledger is None else ledger.select("blob", "rules", "spans").unionByName(fresh)
    versions = versions.drop(*[c for c in versions.columns if c.lower() == spans_col.lower()])
    blob, names = free_name(versions, "blob"), F.array(*map(F.lit, _versions(rules)))
    kinds = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (F.array_position(names, s["rule"]) - 1).cast("int").alias("kind"), s["end"].alias("end")))
    now = ledger.where(F.size("spans") > 0).select("blob", F.filter(kinds, lambda s: s["kind"] >= 0).alias("spans")).where(F.size("spans") > 0)
    # A blob has a row for each delivery that brought it new rules.
    now = now.groupBy(F.col("blob").alias(blob)).agg(F.array_sort(F.flatten(F.collect_list("spans"))).cast(SPANS).alias(spans_col))
    found = versions.withColumn(blob, blob_id(F.col(text_col))).join(now, blob, "left").drop(blob)
    return found.withColumn(spans_col, F.coalesce(F.col(spans_col), F.array().cast(SPANS))), ledger


def span_text(spans: Column, rules: tuple[Rule, ...] = RULES, only: int | None = None) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined; of the first `only` rules."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    if only is not None:
        spans = F.filter(spans, lambda s: s["kind"] < only)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def masked(found: DataFrame, text_col: str = "text", spans_col: str = "secret_spans", mark: str = "[secret]", count_col: str | None = None) -> DataFrame:
    """`found` with `mark` in place of every run of overlapping or touching spans; texts
    without spans stay as they are. `count_col`, if there is one, follows a changed text."""
    spans, text = F.col(spans_col), F.col(text_col)
    # What stands between the furthest end so far and the next start is kept.
    before = lambda i: F.when(i > 0, F.array_max(F.transform(F.slice(spans, 1, i), lambda s: s["end"]))).otherwise(F.lit(0).cast("long"))
    piece = lambda s, i: F.when(s["start"] > before(i), F.concat(F.substring(text, (before(i) + 1).cast("int"), (s["start"] - before(i)).cast("int")), F.lit(mark))).when(i == 0, F.lit(mark)).otherwise(F.lit(""))
    last = F.array_max(F.transform(spans, lambda s: s["end"]))
    rest = F.substring(text, (last + 1).cast("int"), F.length(text))
    hit = F.size(spans) > 0
    new = F.when(hit, F.concat(F.array_join(F.transform(spans, piece), ""), rest)).otherwise(text)
    out = found.withColumn(text_col, new)
    if count_col in found.columns:
        out = out.withColumn(count_col, F.when(hit, F.length(text_col).cast(found.schema[count_col].dataType)).otherwise(F.col(count_col)))
    return out
