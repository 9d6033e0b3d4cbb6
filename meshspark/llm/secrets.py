"""Secret scans over a trigram inverted index.

For each rule a Boolean trigram query is derived from its regular expression: alternatives (OR) of
strings, each standing for its trigrams (AND).  The index holds postings (trigram, id) of the
trigrams that any query names; postings are intersected to candidates, and only candidates are
scanned with the rule's expression.  A rule whose expression forces no trigram scans every text.

Native: DataFrame functions only.  Spans come from the matches and from the pieces between them, so
offsets count code points; running sums over many matches go in chunks, so a text with very many
matches costs little more than in proportion.  Null and empty texts have no spans.  Rows with equal
ids are scanned if any of them is a candidate; rows with a null id are judged by their own text.
Other columns may have any name.  An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .quality import let


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  # the group that must have ``least`` characters
    least: int = 0
    any_case: bool = False


#: The three base kinds, then kinds that the scan adds; spans of equal start are ordered as listed.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("hub", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("pay", r"sk_live_[0-9A-Za-z]{16,}"),
)


def trigram_query(pattern: str, most: int = 64) -> list[frozenset[str]] | None:
    """Alternatives of lower-case trigram sets, one of which every match must contain; None if the pattern forces none.

    Walks the parsed expression, keeping the set of strings that a stretch must spell while it stays
    under ``most``; the best stretch is the one whose shortest string is longest.
    """
    import re._parser as sre

    def letters(op, arg):
        if str(op) == "LITERAL":
            return {chr(arg).lower()}
        if str(op) == "IN":
            out = set()
            for o, a in arg:
                if str(o) == "LITERAL":
                    out.add(chr(a).lower())
                elif str(o) == "RANGE":
                    out |= {chr(c).lower() for c in range(a[0], a[1] + 1)}
                else:
                    return None
            return out if len(out) <= 8 else None
        return None

    def spell(items):
        """Stretches (sets of strings) of a concatenation; exact if there is one stretch for all of it."""
        done, now, exact = [], {""}, True
        for op, arg in items:
            kind = str(op)
            inner = None
            if kind == "SUBPATTERN":
                parts, whole = spell(arg[3])
                inner = parts[0] if whole and parts else None
                done += [] if whole else parts
            elif kind == "BRANCH":
                sides = [spell(x) for x in arg[1]]
                inner = set().union(*[p[0] for p, w in sides]) if all(w and p for p, w in sides) else None
            elif kind in ("MAX_REPEAT", "MIN_REPEAT"):
                lo, hi, sub = arg
                parts, whole = spell(sub)
                if whole and parts and lo == hi == 1:
                    inner = parts[0]
                elif whole and parts and (lo, hi) == (0, 1) and len(parts[0]) == 1:
                    inner = parts[0] | {""}
                elif whole and parts and lo == hi and len(parts[0]) == 1:
                    inner = {next(iter(parts[0])) * lo}
            else:
                inner = letters(op, arg)
            if inner is not None and len(now) * len(inner) <= most:
                now = {a + b for a in now for b in inner}
            else:
                done.append(now)
                now, exact = {""}, False
                if inner is not None:
                    now = inner
        return [*done, now], exact

    stretches, _ = spell(list(sre.parse(pattern)))
    best = max(stretches, key=lambda s: min(map(len, s)))
    if min(map(len, best)) < 3:
        return None
    return sorted({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in best}, key=sorted)


def build_index(docs: DataFrame, rules=RULES, id_col="doc_id", text_col="text") -> DataFrame:
    """Postings (trigram, id) of every trigram that a rule's query names, over lower-case text, written once."""
    wanted = sorted({t for r in rules for alt in trigram_query(r.pattern) or [] for t in alt})
    lower = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    held = let(lower, lambda t: F.array_compact(F.array(*[F.when(F.contains(t, F.lit(w)), F.lit(w)) for w in wanted])))
    return written(docs.select(F.explode(held).alias("trigram"), F.col(id_col).alias("_id")), "trigram-index")


def candidates(index: DataFrame, rules=RULES) -> DataFrame:
    """(id, rules): the postings of each alternative's trigrams, intersected, then united by rule."""
    spark = index.sparkSession
    query = [(t, r.kind, a, len(alt)) for r in rules for a, alt in enumerate(trigram_query(r.pattern) or []) for t in alt]
    terms = F.broadcast(spark.createDataFrame(query, "trigram string, rule string, alternative int, needed int"))  # from the rules alone
    hits = index.join(terms, "trigram").groupBy("_id", "rule", "alternative").agg(F.size(F.collect_set("trigram")).alias("held"), F.first("needed").alias("needed"))
    return hits.filter("held = needed").groupBy("_id").agg(F.collect_set("rule").alias("_rules"))


def running(values: Column, add, start: int = 0) -> Column:
    """The running ``add`` over an array, in chunks of about the root of its length, so that long arrays are not copied at every step."""

    def within(xs, base):
        step = lambda acc, x: let(add(acc["at"], x), lambda n: F.struct(n.alias("at"), F.concat(acc["out"], F.array(n)).alias("out")))
        return F.aggregate(xs, F.struct(base.alias("at"), F.array().cast("array<int>").alias("out")), step, lambda acc: acc["out"])

    def of(v):
        side = F.ceil(F.sqrt(F.size(v))).cast("int")
        chunk = lambda i: F.slice(v, i * side + 1, side)
        count = F.sequence(F.lit(0), F.ceil(F.size(v) / side).cast("int") - 1)
        whole = F.transform(count, lambda i: F.aggregate(chunk(i), F.lit(start), add))
        return let(within(whole, F.lit(start)), lambda upto: F.flatten(F.transform(count, lambda i: within(chunk(i), F.coalesce(F.get(upto, i - 1), F.lit(start))))))

    return let(values, lambda v: F.when(F.size(v) > 0, of(v)).otherwise(F.array().cast("array<int>")))


def spans(text: Column, rule: Rule, order: int) -> Column:
    """Spans (start, order, kind, end) of one rule's leftmost non-overlapping matches, in code points, end exclusive."""

    def of(ms):
        ends = running(F.zip_with(F.slice(F.split(text, rule.pattern, -1), 1, F.size(ms)), ms, lambda p, m: F.char_length(p) + F.char_length(m)), lambda a, x: a + x)
        whole = F.zip_with(ends, ms, lambda e, m: F.struct((e - F.char_length(m)).alias("start"), F.lit(order).alias("o"), F.lit(rule.kind).alias("kind"), e.alias("end")))
        if rule.least:
            sized = ms if rule.group == 0 else F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
            kept = F.filter(F.zip_with(whole, sized, lambda s, g: F.struct(s.alias("s"), F.char_length(g).alias("n"))), lambda x: x["n"] >= rule.least)
            whole = F.transform(kept, lambda x: x["s"])
        return F.when(F.size(ms) > 0, whole).otherwise(NONE())

    return let(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), of)


def NONE() -> Column:
    return F.array().cast("array<struct<start:int,o:int,kind:string,end:int>>")


#: For the two base kinds that are runs of one class: the same spans, with the least length inside the expression.
TIGHT = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}


def own_rules(text: Column, rules=RULES) -> Column:
    """The rules that a text is a candidate of, without an index."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    any_of = lambda alts, t: reduce(or_, [reduce(and_, [F.contains(t, F.lit(g)) for g in sorted(alt)]) for alt in alts])
    return let(lower, lambda t: F.array_compact(F.array(*[F.when(any_of(q, t), F.lit(r.kind)) for r in rules if (q := trigram_query(r.pattern)) is not None])))


def with_spans(docs: DataFrame, rules=RULES, id_col="doc_id", text_col="text", keep: list[str] | None = None) -> DataFrame:
    """(row, spans): the kept columns as one struct, so that no name can clash, and all spans of all rules by start and then rule."""
    kept = list(dict.fromkeys([id_col, text_col, *(keep or [])]))
    known, packed = F.col(id_col).isNotNull(), F.struct(*kept).alias("row")
    found = candidates(build_index(docs.filter(known), rules, id_col, text_col), rules)
    joined = docs.filter(known).select(F.col(id_col).alias("_id"), packed).join(found, "_id", "left").select("row", "_rules")
    # rows without an id have no postings to meet, and would all meet in one task
    joined = joined.unionByName(docs.filter(~known).select(packed, own_rules(F.col(text_col), rules).alias("_rules")))
    text = F.coalesce(F.col("row")[text_col], F.lit(""))
    each = []
    for k, r in enumerate(rules):
        s = spans(text, Rule(r.kind, TIGHT.get(r.kind, r.pattern), r.group, r.least), k)
        each.append(s if trigram_query(r.pattern) is None else F.when(F.array_contains("_rules", r.kind), s).otherwise(NONE()))
    return joined.select("row", F.array_sort(F.concat(*each)).alias("spans"))


def span_text(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, rules=RULES, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans), one row for each document."""
    found = with_spans(docs, rules, id_col, text_col)
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["o"] < 3)
    return found.select(F.col("row")[id_col].alias(id_col), n("assign"), n("access"), n("hex"), F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


def stretch(chunks: Column, a: Column, b: Column, size: int) -> Column:
    """Characters a to b - 1 of a text that was cut into ``chunks`` of ``size`` characters: only the chunks they lie in are read."""
    i, j = F.floor(a / size).cast("int"), F.floor(b / size).cast("int")
    head = F.substr(F.get(chunks, i), a % size + 1, F.least(b, (i + 1) * size) - a)
    tail = F.when(j > i, F.concat(F.array_join(F.slice(chunks, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.coalesce(F.substr(F.get(chunks, j), F.lit(1), b % size), F.lit("")))).otherwise(F.lit(""))
    return F.concat(F.coalesce(head, F.lit("")), tail)


def redact(docs: DataFrame, rules=RULES, id_col="doc_id", text_col="text", mark: str = "[secret:{}]", chunk: int = 4096) -> DataFrame:
    """The documents with every span replaced by its kind's mark; overlapping spans become one, marked by the first."""
    found = with_spans(docs, rules, id_col, text_col, docs.columns)
    text = F.col("row")[text_col]

    def marked(chunks, upto):
        before = lambda i: F.coalesce(F.get(upto, i - 1), F.lit(0))
        piece = lambda s, i: F.when(s["start"] >= before(i), F.concat(stretch(chunks, before(i), s["start"], chunk), F.format_string(mark.replace("{}", "%s"), s["kind"]))).otherwise(F.lit(""))
        rest = stretch(chunks, F.element_at(upto, -1), F.char_length(text), chunk)
        return F.concat(F.array_join(F.transform("spans", piece), ""), rest)

    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0))
    ends = running(F.transform("spans", lambda s: s["end"]), lambda a, x: F.greatest(a, x))
    cleaned = F.when(F.size("spans") > 0, let(cut, lambda c: let(ends, lambda u: marked(c, u)))).otherwise(text)
    return found.select(*[(cleaned if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])
