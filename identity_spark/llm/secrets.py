"""Secret scans with a trigram inverted index, in DataFrame operations only.

From each rule's regular expression a Boolean query over trigrams is derived: a conjunction of clauses, each a choice
between sets of trigrams that a match must contain in lower case. The index holds postings (trigram, row) for the
trigrams that some rule asks for. Intersecting the postings gives each rule's candidates, and only these are verified
with the regular expression. A rule without mandatory trigrams, such as a run of hex digits, scans all texts.

A span is (kind, start, end) in code points, the end exclusive; matches of a kind are leftmost and don't overlap, and
a match whose value group is shorter than the rule's minimum is dropped afterwards.

Defined results: a null text is empty and has no spans; rows with equal keys are kept apart, a null key is a key as
any other; repeated rows have equal spans; a text of any length is scanned whole; further columns are kept, but for one
that has the result's name, which is replaced; an empty table gives no rows.
"""

from __future__ import annotations

import re._constants as code
import re._parser as syntax
from dataclasses import dataclass
from functools import reduce
from itertools import product
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import own_prefix, written

#: Candidates or verified rows (some 40 bytes, and 40 for a span) beyond this many are joined by a shuffle, not broadcast.
BROADCAST_ROWS = 100_000
#: Matches of a text that are folded, and spans that are replaced, together.
PART = 256
#: Most literal strings that are followed side by side while a query is derived.
MOST_LITERALS = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret: ``pattern`` in the syntax that Java and Python share, the group of its value, least value length."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The contract's three kinds.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
#: Published token formats.
MORE_RULES = (
    Rule("github", r"gh[opsur]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 0),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
)

Clause = frozenset[frozenset[str]]


def _literals(node) -> set[str] | None:
    """All strings of one parsed node in lower case, if they are few; else None."""
    op, value = node
    if op is code.LITERAL:
        return {chr(value).lower()}
    if op is code.IN and all(kind is code.LITERAL for kind, _ in value):
        return {chr(x).lower() for _, x in value}
    if op is code.SUBPATTERN:
        return _strings(value[3])
    if op is code.BRANCH:
        found = [_strings(x) for x in value[1]]
        return None if None in found else set().union(*found)
    if op is code.MAX_REPEAT and value[1] <= 4:
        once = _strings(value[2])
        return None if once is None else {"".join(x) for n in range(value[0], value[1] + 1) for x in product(once, repeat=n)}
    return None


def _strings(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        found = _literals(node)
        if found is None or len(out) * len(found) > MOST_LITERALS:
            return None
        out = {a + b for a in out for b in found}
    return out


def trigram_query(pattern: str) -> list[Clause]:
    """Clauses that every text with a match fulfils; a clause is fulfilled by one of its sets of trigrams. [] is always true."""
    clauses: list[Clause] = []

    def close(strings: set[str]) -> None:
        sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
        if frozenset() not in sets:
            clauses.append(frozenset(x for x in sets if not any(y < x for y in sets)))

    def walk(nodes) -> None:
        at = {""}
        for node in nodes:
            found = _literals(node)
            if found is not None and len(at) * len(found) <= MOST_LITERALS:
                at = {a + b for a in at for b in found}
                continue
            close(at)
            at = {""} if found is None else found
            if found is None and node[0] is code.SUBPATTERN:
                walk(node[1][3])
            elif found is None and node[0] is code.MAX_REPEAT and node[1][0]:
                walk(node[1][2])
        close(at)

    walk(syntax.parse(pattern))
    return clauses


def postings(rows: DataFrame, keys: list[str], text: str, trigrams: list[str]) -> DataFrame:
    """The inverted index: (trigram number, keys), for each of ``trigrams`` that the lower-case text contains."""
    # a column of its own, or it would be made anew for each trigram
    rows, low = rows.select(*keys, F.lower(text).alias("_low")), F.col("_low")
    there = F.array_compact(F.array(*[F.when(low.contains(t), F.lit(i)) for i, t in enumerate(trigrams)]))
    return rows.select(*keys, F.explode(there).alias("trigram"))


def candidates(index: DataFrame, keys: list[str], trigrams: list[str], queries: dict[str, list[Clause]]) -> DataFrame:
    """Rows whose postings meet a query at least, with one boolean column for each query.

    A row's postings meet in bit masks, 62 trigrams each, which partial aggregation makes before the shuffle."""
    words = range(-(-len(trigrams) // 62))
    bit = F.lit(1).cast("long")
    masks = index.groupBy(*keys).agg(
        *[F.bit_or(F.when(F.col("trigram").between(62 * w, 62 * w + 61), F.expr(f"shiftleft(1L, trigram - {62 * w})")).otherwise(bit * 0)).alias(f"_m{w}") for w in words]
    )
    number = {t: i for i, t in enumerate(trigrams)}

    def all_of(wanted: frozenset[str]) -> Column:
        bits = {w: sum(1 << number[t] % 62 for t in wanted if number[t] // 62 == w) for w in words}
        return reduce(and_, [F.col(f"_m{w}").bitwiseAND(F.lit(b)) == b for w, b in bits.items() if b])

    meets = {k: reduce(and_, [reduce(or_, map(all_of, sorted(c, key=sorted))) for c in q]) for k, q in queries.items()}
    flagged = masks.select(*keys, *[x.alias(k) for k, x in meets.items()])
    return flagged.filter(reduce(or_, [F.col(k) for k in meets]))


def _parts(items: Column) -> Column:
    """An array in runs of PART items, one empty run for an empty one."""
    last = F.greatest(F.size(items) - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), F.floor(last / PART).cast("int")), lambda k: F.slice(items, k * PART + 1, PART))


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, order, kind, end) of the matches of ``rule``; starts are sums of the lengths between matches."""
    pattern = F.lit(rule.pattern)
    matches = F.arrays_zip(
        F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(F.regexp_extract_all(text, pattern, F.lit(0)))).alias("gap"),
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("found"),
        F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("value"),
    )
    none = F.array().cast("array<struct<start:long,order:int,kind:string,end:long>>")
    at_start = F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans"))

    def step(done: Column, x: Column) -> Column:
        start = done["at"] + F.char_length(x["gap"])
        end = start + F.char_length(x["found"])
        span = F.struct(start.alias("start"), F.lit(order).alias("order"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        spans = F.when(F.char_length(x["value"]) >= rule.least, F.concat(done["spans"], F.array(span))).otherwise(done["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    def moved(done: Column, part: Column) -> Column:
        move = lambda x: F.struct((x["start"] + done["at"]).alias("start"), x["order"], x["kind"], (x["end"] + done["at"]).alias("end"))
        return F.struct((done["at"] + part["at"]).alias("at"), F.concat(done["spans"], F.array(F.transform(part["spans"], move))).alias("spans"))

    # in parts, so that no array grows match by match over a whole text
    parts = F.transform(_parts(matches), lambda part: F.aggregate(part, at_start, step))
    folded = F.aggregate(parts, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<array<struct<start:long,order:int,kind:string,end:long>>>").alias("spans")), moved, lambda x: F.flatten(x["spans"]))
    # a cheap look first: the value's least length bounds the match's, so a text without such a run has none
    look = re_least(rule)
    return F.when(text.rlike(look), folded).otherwise(none) if look else folded


def re_least(rule: Rule) -> str | None:
    """A pattern that finds a text with a long enough match, for rules whose last repeat is the value itself."""
    if rule.group or not rule.least or not rule.pattern.endswith("]+"):
        return None
    head = rule.pattern[: -len("+")]
    fixed = sum(1 for op, _ in list(syntax.parse(rule.pattern))[:-1] if op in (code.LITERAL, code.IN))
    return f"{head}{{{rule.least - fixed},}}"


def joined(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, *, key: str = "doc_id", text: str = "text", out: str = "spans") -> DataFrame:
    """All columns of ``docs`` and ``out`` (sorted array of start, order, kind, end) of every row, in no order.

    A column of that name is replaced."""
    docs = docs.drop(out)
    p = own_prefix(docs)
    words = F.coalesce(F.col(text), F.lit(""))
    rows = docs.withColumns({f"{p}key": F.col(key), f"{p}text": words, f"{p}print": F.xxhash64(words)})
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    asked = {k: q for k, q in queries.items() if q}
    scanned = [(i, r) for i, r in enumerate(rules) if r.kind not in asked]
    none = F.array().cast("array<struct<start:long,order:int,kind:string,end:long>>")
    keys = [f"{p}key", f"{p}print"]
    found_in = rows.select(*docs.columns, *keys, F.concat(none, *[spans_of(F.col(f"{p}text"), r, i) for i, r in scanned]).alias(f"{p}scanned"))
    if asked:
        trigrams = sorted({t for q in asked.values() for c in q for s in c for t in s})
        found = written(candidates(postings(rows, keys, f"{p}text", trigrams), keys, trigrams, asked), "candidates")
        found = found.withColumnsRenamed({f"{p}key": f"{p}found_key", f"{p}print": f"{p}found_print"})
        same = F.col(f"{p}key").eqNullSafe(F.col(f"{p}found_key")) & (F.col(f"{p}print") == F.col(f"{p}found_print"))
        spans = F.concat(none, *[F.when(F.col(r.kind), spans_of(F.col(f"{p}text"), r, i)).otherwise(none) for i, r in enumerate(rules) if r.kind in asked])
        verified = rows.select(*keys, f"{p}text").join(_small(found), same).select(f"{p}found_key", f"{p}found_print", spans.alias(f"{p}verified"))
        verified = written(verified.filter(F.size(f"{p}verified") > 0).dropDuplicates([f"{p}found_key", f"{p}found_print"]), "verified")
        found_in = found_in.join(_small(verified), same, "left").withColumn(f"{p}scanned", F.concat(f"{p}scanned", F.coalesce(f"{p}verified", none)))
    return found_in.select(*docs.columns, F.array_sort(f"{p}scanned").alias(out))


def _small(table: DataFrame) -> DataFrame:
    """With a hint to broadcast it where its rows, which are counted, allow that."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with each stretch of overlapping spans replaced by the kind of its first one, in brackets; null stays null."""
    p = own_prefix(docs)
    found = find_secrets(docs, rules, key=key, text=text, out=f"{p}spans")

    def step(done: Column, x: Column) -> Column:
        cut = F.struct(done["at"].alias("after"), x["start"].alias("start"), x["kind"].alias("kind"))
        return F.struct(F.greatest(done["at"], x["end"]).alias("at"), F.when(x["start"] >= done["at"], F.concat(done["cuts"], F.array(cut))).otherwise(done["cuts"]).alias("cuts"))

    def piece(cuts: Column) -> Column:
        first, last = F.element_at(cuts, 1)["after"], F.element_at(cuts, -1)["start"]
        # the part's own stretch of text is cut out once
        stretch = F.array(F.substring(F.col(text), first + 1, last - first))
        fill = lambda t: F.array_join(F.transform(cuts, lambda x: F.concat(F.substring(t, x["after"] - first + 1, x["start"] - x["after"]), F.lit("["), x["kind"], F.lit("]"))), "")
        return F.element_at(F.transform(stretch, fill), 1)

    none = F.array().cast("array<struct<after:long,start:long,kind:string>>")
    kept = F.aggregate(f"{p}spans", F.struct(F.lit(0).cast("long").alias("at"), none.alias("cuts")), step)
    found = found.withColumn(f"{p}kept", F.when(F.size(f"{p}spans") > 0, kept))
    clean = F.concat(F.array_join(F.transform(_parts(F.col(f"{p}kept.cuts")), piece), ""), F.substring(F.col(text), F.col(f"{p}kept.at") + 1, F.char_length(text)))
    return found.withColumn(text, F.when(F.size(f"{p}spans") > 0, clean).otherwise(F.col(text))).select(*docs.columns)
