r"""Secret scan through a trigram inverted index, in DataFrame functions only.

1. From each rule's regex a Boolean trigram query is derived (an OR of ANDs over case-folded trigrams that every
   match must contain). A rule without mandatory trigrams has no query.
2. The index has a posting (trigram, document) for each trigram that some query names.
3. Postings meet the query table on the trigram, and grouping by (document, clause) intersects them: a document
   with all trigrams of a clause is a candidate of its rule.
4. Candidates are verified with the regex itself. Rules without a query are verified on every document, in the
   scan and without the index.

A document is identified by (doc_id, hash of the text), so the join has no hot key. Match positions are
prefix sums over the pieces between matches, by a window for each document and kind.

Results for odd input: null text counts as empty and has no spans; a null doc_id is kept; texts repeated under
one id each get their row; other columns are not read; empty tables give empty tables; a text is scanned whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import require

_parser = re._parser  # the standard library's regex syntax tree


@dataclass(frozen=True)
class Rule:
    """``pattern``: matches are taken leftmost and non-overlapping; then those whose ``group`` has fewer than
    ``least`` characters are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


# Fixed values of the contract (the first three), then rules for well-known token formats.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),  # the runs of [0-9a-f]+ with 24 or more
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"),
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

_MANY = 64  # strings kept exactly while a query is derived; beyond, their trigrams are used


def _product(left: set[str], right: set[str]) -> set[str]:
    return {a + b for a in left for b in right}


def _exact(items) -> set[str] | None:
    """All strings that the items match, case-folded, if they are few."""
    out = {""}
    for op, arg in items:
        name = str(op)
        if name == "LITERAL":
            part = {chr(arg).lower()}
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
            part = {chr(c).lower() for _, c in arg}
        elif name == "SUBPATTERN":
            part = _exact(arg[3])
        elif name == "BRANCH":
            parts = [_exact(b) for b in arg[1]]
            part = None if None in parts else set().union(*parts)
        elif name == "MAX_REPEAT" and arg[1] != _parser.MAXREPEAT and arg[1] <= 8:
            own = _exact(arg[2])
            part = None if own is None else set().union(*(
                reduce(_product, [own] * n, {""}) for n in range(arg[0], arg[1] + 1)))
        else:
            part = None
        if part is None or len(out) * len(part) > _MANY:
            return None
        out = _product(out, part)
    return out


def _trigrams(s: str) -> frozenset[str]:
    return frozenset(s[i:i + 3] for i in range(len(s) - 2))


def _and(left: set[frozenset], right: set[frozenset]) -> set[frozenset]:
    both = {a | b for a in left for b in right}
    return {c for c in both if not any(d < c for d in both)}


def _query(items) -> set[frozenset]:
    out, held = {frozenset()}, {""}

    def flush() -> None:
        nonlocal out, held
        own = {_trigrams(s) for s in held}
        out, held = _and(out, {c for c in own if not any(d < c for d in own)}), {""}
    for item in items:
        exact = _exact([item])
        if exact is not None and len(held) * len(exact) <= _MANY:
            held = _product(held, exact)
            continue
        flush()
        name, arg = str(item[0]), item[1]
        if exact is not None:
            held = exact
        elif name == "SUBPATTERN":
            out = _and(out, _query(arg[3]))
        elif name == "BRANCH":
            out = _and(out, set().union(*(_query(b) for b in arg[1])))
        elif name == "MAX_REPEAT" and arg[0] >= 1:
            out = _and(out, _query(arg[2]))
    flush()
    return out


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Clauses of which every match contains one entirely; empty if a match needs no trigram."""
    clauses = _query(_parser.parse(pattern))
    return [] if frozenset() in clauses else sorted(clauses, key=sorted)


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The index: doc_id, mark, trigram for each of ``trigrams`` that the case-folded text contains."""
    folded = docs.select("doc_id", "mark", F.lower("text").alias("folded"))
    held = F.array_compact(F.array(*[F.when(F.contains("folded", F.lit(t)), F.lit(t)) for t in trigrams]))
    return folded.select("doc_id", "mark", F.explode(held).alias("trigram"))


def candidates(index: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """doc_id, mark, kinds: the rules whose query a document satisfies. The query table has the rules' size."""
    rows = [(kind, c, t, i, 2 ** len(clause) - 1) for kind, clauses in queries.items()
            for c, clause in enumerate(clauses) for i, t in enumerate(sorted(clause))]
    asked = index.sparkSession.range(1).select(F.explode(F.array(*[F.struct(
        F.lit(k).alias("kind"), F.lit(c).alias("clause"), F.lit(t).alias("trigram"),
        F.lit(1 << i).cast("long").alias("bit"), F.lit(full).cast("long").alias("full")) for k, c, t, i, full in rows]))
        .alias("q")).select("q.*")
    met = index.join(F.broadcast(asked), "trigram").groupBy("doc_id", "mark", "kind", "clause", "full")
    whole = met.agg(F.bit_or("bit").alias("bits")).filter("bits = full")
    return whole.groupBy("doc_id", "mark").agg(F.collect_set("kind").alias("kinds"))


def _match(kind: Column, m: Column, i: Column) -> Column:
    return F.struct(kind, i.alias("i"), m["gap"].alias("gap"), m["size"].alias("size"), m["value"].alias("value"))


def _matches(docs: DataFrame, rules: list[Rule], wanted: Column | None) -> DataFrame:
    """doc_id, mark, kind, i, gap, size, value: match i of a document, ``gap`` characters after the last one."""
    found = []
    for rule in rules:
        text = F.when(F.rlike("text", F.lit(rule.pattern)), F.col("text"))
        text = text if wanted is None else F.when(F.array_contains(wanted, rule.kind), text)
        hits = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
        values = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
        zipped = F.arrays_zip(F.transform(F.split(text, rule.pattern, -1), F.length).alias("gap"),
                              F.transform(hits, F.length).alias("size"), F.transform(values, F.length).alias("value"))
        kind = F.lit(rule.kind).alias("kind")
        found.append(F.transform(F.slice(zipped, 1, F.size(hits)), partial(_match, kind)))
    every = F.flatten(F.array_compact(F.array(*found)))
    return docs.select("doc_id", "mark", F.explode(every).alias("m")).select("doc_id", "mark", "m.*")


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row for each match that stays: doc_id, mark (hash of the text), kind, start, end (code points)."""
    require(docs, "doc_id", "text")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("mark", F.xxhash64("text"))
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    parts = []
    if scanned := [r for r in rules if r.kind not in queries]:
        parts.append(_matches(rows, scanned, None))
    if queries:
        index = postings(rows, sorted({t for q in queries.values() for c in q for t in c}))
        asked = candidates(index, queries).withColumnsRenamed({"doc_id": "by_id", "mark": "by_mark"})
        chosen = rows.join(asked, F.col("doc_id").eqNullSafe(F.col("by_id")) & (F.col("mark") == F.col("by_mark")))
        parts.append(_matches(chosen, [r for r in rules if r.kind in queries], F.col("kinds")))
    matches = reduce(DataFrame.unionByName, parts).distinct()  # a row given twice is one document here
    before = Window.partitionBy("doc_id", "mark", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("size")).over(before)
    least = reduce(lambda c, r: F.when(F.col("kind") == r.kind, r.least).otherwise(c), rules, F.lit(0))
    placed = matches.select("doc_id", "mark", "kind", (end - F.col("size")).alias("start"), end.alias("end"),
                            (F.col("value") >= least).alias("kept"))
    return placed.filter("kept").drop("kept")


def digests(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row for each row of ``docs``: counts of the base kinds, digest of their spans, and all spans."""
    order = reduce(lambda c, p: F.when(F.col("kind") == p[1].kind, p[0]).otherwise(c), enumerate(rules), F.lit(-1))
    spans = find_secrets(docs, rules).groupBy("doc_id", "mark").agg(F.sort_array(F.collect_list(
        F.struct("start", order.alias("rank"), "kind", "end"))).alias("found"))
    spans = spans.withColumnsRenamed({"doc_id": "by_id", "mark": "by_mark"})
    keys = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"))
    rows = keys.join(spans, F.col("doc_id").eqNullSafe(F.col("by_id")) & (F.col("mark") == F.col("by_mark")), "left")
    found = F.coalesce("found", F.array())
    base = [r.kind for r in rules if r.base]
    text = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    kinds = F.transform(found, lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, F.lit(k).__eq__)).cast("long").alias(f"n_{k}") for k in base]
    return rows.select("doc_id", *counts, F.sha2(text(F.filter(found, lambda s: s["kind"].isin(base))), 256)
                       .alias("base_sha256"), text(found).alias("spans"))
