"""Secret scanning by a trigram inverted index, in DataFrame operations only.

From each rule's regex a Boolean query over trigrams is derived: any match must
hold them. The index has a posting (trigram, document) for each trigram that some
rule asks for. The postings of a query are intersected by document, and only the
documents that are left are verified with that rule's regex. Rules without
mandatory trigrams run over all texts. Trigrams are those of the lower-cased
text, so case doesn't matter.
"""

from __future__ import annotations

import re
import re._constants as C
import re._parser
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import need, packed, stage, unpacked


@dataclass(frozen=True)
class Rule:
    """Matches are leftmost and don't overlap; those whose `group` is shorter than `least` are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: In the order in which spans with the same start are listed.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}"),  # a run of 16 or more is a run that isn't too short
)
#: Public token formats.
ADDED = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("url_password", r"://[^\x20\x09-\x0D/:@]{1,64}:[^\x20\x09-\x0D/:@]{3,64}@"),
)
RULES = BASE + ADDED

#: A query is a set of alternatives, each a set of trigrams that all must occur; None: anything may match.
Query = frozenset[frozenset[str]] | None
_MOST = 64


def _strings(items: Iterable) -> set[str] | None:
    """All strings that a parsed sequence matches, lower-cased, if these are few."""
    found = {""}
    for op, arg in items:
        if op is C.LITERAL:
            own = {chr(arg).lower()}
        elif op is C.IN and len(arg) <= 8 and all(o is C.LITERAL for o, _ in arg):
            own = {chr(c).lower() for _, c in arg}
        elif op is C.SUBPATTERN:
            own = _strings(arg[-1])
        elif op is C.BRANCH:
            each = [_strings(x) for x in arg[1]]
            own = None if None in each else set().union(*each)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[1] is not C.MAXREPEAT and arg[1] <= 3:
            one = _strings(arg[2])
            own = None if one is None else set().union(*({"".join(p) for p in _power(one, k)} for k in range(arg[0], arg[1] + 1)))
        else:
            return None
        if own is None or len(found) * len(own) > _MOST:
            return None
        found = {a + b for a in found for b in own}
    return found


def _power(of: set[str], k: int) -> list[tuple[str, ...]]:
    out: list[tuple[str, ...]] = [()]
    for _ in range(k):
        out = [(*x, y) for x in out for y in of]
    return out


def _and(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return b if a is None else a
    both = frozenset(x | y for x in a for y in b)
    return _absorbed(both) if len(both) <= _MOST else a


def _absorbed(query: Query) -> Query:
    """Without alternatives that ask for more than another one does."""
    return None if query is None else frozenset(x for x in query if not any(y < x for y in query))


def _grams(strings: set[str]) -> Query:
    if any(len(s) < 3 for s in strings):
        return None
    return _absorbed(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))


def _of(items: Iterable) -> Query:
    """The query of a parsed sequence: longest runs of enumerable items, and what the others ask for."""
    query, run = None, []
    for item in items:
        if _strings([*run, item]) is not None:
            run.append(item)
            continue
        query, run = _and(query, _grams(_strings(run))), []
        if _strings([item]) is not None:
            run = [item]
            continue
        op, arg = item
        if op is C.SUBPATTERN:
            query = _and(query, _of(arg[-1]))
        elif op is C.BRANCH:
            each = [_of(x) for x in arg[1]]
            query = query if None in each else _and(query, _absorbed(frozenset().union(*each)))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] > 0:
            query = _and(query, _of(arg[2]))
    return _and(query, _grams(_strings(run)))


def trigram_query(pattern: str) -> Query:
    """What any match of the pattern must hold; None if it has no mandatory trigrams."""
    return _of(re._parser.parse(pattern))


def _key(doc_id: Column, text: Column) -> Column:
    """A row's key in the index. Keys that clash only add candidates."""
    return F.xxhash64(doc_id, text)


#: Characters of the pieces in which a text is indexed and redacted, so that memory is bounded.
PIECE = 4096
#: So many candidates, of two numbers each, are sent to every task; more are met by a shuffle.
BROADCAST_ROWS = 1_000_000


def _wanted(trigrams: list[str]) -> str:
    """A pattern that finds each place where one of the trigrams begins, and gives the trigram."""
    by_first: dict[str, list[str]] = {}
    for g in trigrams:
        by_first.setdefault(g[0], []).append(g[1:])
    each = (re.escape(first) + "(?:" + "|".join(map(re.escape, rest)) + ")" for first, rest in by_first.items())
    return "(?=(" + "|".join(each) + "))"


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(gram, key): the distinct ones among these trigrams, by their places, that each piece of a document's text holds.

    Pieces overlap by two characters, so no trigram is lost between them.
    """
    low = docs.filter("text IS NOT NULL").select(_key(F.col("doc_id"), F.col("text")).alias("key"), F.lower("text").alias("low"))
    pieces = low.select("key", F.explode(F.regexp_extract_all("low", F.lit(f"(?s)(?=(.{{1,{PIECE + 2}}})).{{1,{PIECE}}}"), F.lit(1))).alias("piece"))
    grams = F.array_intersect(F.regexp_extract_all("piece", F.lit(_wanted(trigrams)), F.lit(1)), F.array(*map(F.lit, trigrams)))
    held = pieces.select("key", F.explode(grams).alias("gram"))
    place = F.create_map(*[F.lit(x) for i, g in enumerate(trigrams) for x in (g, i)])
    return held.select("key", place[F.col("gram")].alias("gram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(key, mask): the rules, a bit each, whose trigram query a document's postings satisfy."""
    queries = [trigram_query(r.pattern) for r in rules]
    trigrams = sorted({g for q in queries if q for alternative in q for g in alternative})
    if not trigrams:
        return docs.select(_key(F.col("doc_id"), F.col("text")).alias("key"), F.lit(0).cast("long").alias("mask")).limit(0)
    at = {g: i for i, g in enumerate(trigrams)}
    words = -(-len(trigrams) // 60)
    index = postings(docs, trigrams)
    # Intersecting: a document's postings meet as bits of a few longs, which the tasks combine before they shuffle.
    bits = [F.bit_or(F.when(F.col("gram").between(60 * w, 60 * w + 59), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("gram") - 60 * w)).otherwise(F.lit(0).cast("long"))).alias(f"b{w}") for w in range(words)]
    met = index.groupBy("key").agg(*bits)
    mask = F.lit(0).cast("long")
    for i, q in enumerate(queries):
        if q is None:
            continue
        may = F.lit(False)
        for alternative in sorted(q, key=sorted):
            own = F.lit(True)
            for w in range(words):
                if want := sum(1 << at[g] - 60 * w for g in alternative if at[g] // 60 == w):
                    own &= F.col(f"b{w}").bitwiseAND(F.lit(want).cast("long")) == want
            may |= own
        mask = mask.bitwiseOR(F.when(may, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return met.select("key", mask.alias("mask")).filter("mask <> 0")


_SPANS = "array<struct<start: int, ord: int, stop: int>>"


def _let(value: Column, body) -> Column:
    """body(value), the value being computed once for each row."""
    return F.transform(F.array(value), body)[0]


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """The rule's spans: what lies between matches, and the matches, give their positions in code points.

    Positions are summed in blocks of matches, so a text with very many takes no quadratic time.
    """
    p, block = F.lit(rule.pattern), 512
    hits = F.regexp_extract_all(text, p, F.lit(0))
    parts = F.regexp_extract_all(text, p, F.lit(rule.group)) if rule.group else hits
    zipped = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), hits.alias("hit"), parts.alias("part"))
    matches = F.transform(zipped, lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.coalesce(F.length(x["hit"]), F.lit(0)).alias("hit"), F.coalesce(F.length(x["part"]) >= rule.least, F.lit(False)).alias("good")))
    none = F.array().cast(_SPANS)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        stop = start + x["hit"]
        span = F.array(F.struct(start.alias("start"), F.lit(order).alias("ord"), stop.alias("stop"))).cast(_SPANS)
        return F.struct(stop.alias("at"), F.when(x["good"], F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    def spans(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + x["gap"] + x["hit"]))
        before = F.aggregate(sums, F.array(F.lit(0)), lambda out, n: F.concat(out, F.array(F.element_at(out, -1) + n)))
        return F.flatten(F.zip_with(blocks, F.slice(before, 1, F.size(blocks)), lambda b, at: F.aggregate(b, F.struct(at.alias("at"), none.alias("out")), step, lambda a: a["out"])))

    cut = _let(matches, lambda m: F.transform(F.sequence(F.lit(0), F.floor((F.size(m) - 1) / block).cast("int")), lambda k: F.slice(m, k * block + 1, block)))
    return F.when(text.rlike(rule.pattern), _let(cut, spans)).otherwise(none)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(row, found): all columns as fields of `row`, and the spans (start, ord, stop) of all rules, sorted, ord being the rule's place.

    A null text has no spans. Rows with equal doc_id and text share an entry of
    the index and are scanned each by itself. Other columns may have any names.
    """
    row = F.col("row")
    rows = packed(docs).withColumn("key", _key(row["doc_id"], row["text"]))
    may = stage(candidates(rows.select("row.doc_id", "row.text"), rules), "candidates")
    few = may.count() <= BROADCAST_ROWS
    rows = rows.join(F.broadcast(may) if few else may, "key", "left").withColumn("mask", F.coalesce("mask", F.lit(0).cast("long")))
    text, found, none = F.coalesce(row["text"], F.lit("")), [], F.array().cast(_SPANS)
    for i, rule in enumerate(rules):
        own = _spans(text, rule, i)
        if trigram_query(rule.pattern) is not None:
            own = F.when(F.col("mask").bitwiseAND(F.lit(1 << i).cast("long")) != 0, own).otherwise(none)
        found.append(own)
    return rows.select("row", F.array_sort(F.concat(*found)).alias("found"))


def _joined(spans: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["ord"]], s["start"], s["stop"])), ",")


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every row.

    Spans are kind:start:end in code points, end exclusive, by start and then
    kind as listed. A null text counts as empty; without spans base_sha256 is
    that of no bytes and spans is empty. Texts of any length are scanned whole.
    An empty table gives no rows; other columns take no part.
    """
    found = scan(need(docs, "doc_id", "text"), rules).select("row.doc_id", "found")

    def count(order: int) -> Column:
        return F.size(F.filter("found", lambda s: s["ord"] == order)).cast("long")

    counts = [count(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE)]
    base = _joined(F.filter("found", lambda s: s["ord"] < len(BASE)), rules)
    return found.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), _joined(F.col("found"), rules).alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """The documents with each span, overlapping ones as one, replaced by `mark`; n_chars, if there, follows the text.

    All rows stay, repeated ones too; a null text stays null, and texts without
    spans are unchanged. An empty table gives no rows; columns may have any names.
    """
    rows = scan(docs, rules)
    text, found = F.col("row")["text"], F.col("found")

    def clean(piece: Column, place: Column) -> Column:
        """A piece of the text, what spans cover being left out; a span's mark stands where it starts."""
        base, size = place * PIECE, F.length(piece)

        def step(acc: Column, s: Column) -> Column:
            start = s["start"] - base
            gap = F.when(start >= acc["at"], F.concat(F.substring(piece, acc["at"] + 1, start - acc["at"]), F.lit(mark))).otherwise(F.lit(""))
            return F.struct(F.greatest(acc["at"], F.least(s["stop"] - base, size)).alias("at"), F.concat(acc["out"], gap).alias("out"))

        own = F.filter(found, lambda s: (s["stop"] > base) & (s["start"] < base + size))
        return F.aggregate(own, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substring(piece, a["at"] + 1, size)))

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    rows = rows.withColumn("clean", F.when(F.size(found) > 0, F.array_join(F.transform(pieces, clean), "")).otherwise(text))
    new = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.size(found) > 0, F.length("clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row")["n_chars"])
    return unpacked(rows, docs.columns, new)
