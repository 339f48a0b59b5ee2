"""Secret scans through a trigram inverted index: each rule's regex gives a Boolean query over trigrams, postings are
intersected, and only the candidates are scanned with the regex; rules without mandatory trigrams scan every text."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product
from re import _constants as K
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intervale.llm.common import bounded_join, staged


@dataclass(frozen=True)
class Rule:
    """``pattern`` reads alike in Python and Java. A match counts if group ``group`` has at least ``least`` characters.
    ``gate``: for rules without mandatory trigrams, a cheap regex that every counting match satisfies."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    gate: str | None = None


#: Fixed by the contract.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32, gate=r"[0-9a-f]{32}"),
)
#: Publicly documented token shapes, in natural order. A private key reaches to its END line, or as far as lines of base 64 follow.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[A-Za-z0-9+/=:,\x20\x09-\x0D\\-]*?-----END [A-Z ]*PRIVATE KEY-----|(?:[\x20\x09-\x0D\\rn]*[A-Za-z0-9+/=]{16,}){0,60})"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}"),
)
RULES = BASE + MORE

#: Exact string sets and conjunctions kept while a query is derived; beyond these a part counts as unknown, which is weaker, never wrong.
MOST_STRINGS, MOST_CLASS = 64, 8

Query = frozenset  # of frozensets of trigrams: an OR of ANDs; {{}} is true
TRUE: Query = frozenset([frozenset()])


def _absorb(q: Query) -> Query:
    return frozenset(a for a in q if not any(b < a for b in q))


def _both(p: Query, q: Query) -> Query:
    out = frozenset(a | b for a in p for b in q)
    return _absorb(out) if len(out) <= MOST_STRINGS**2 else p


def _of_strings(strings: set[str]) -> Query:
    return _absorb(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))


def _derive(tree) -> tuple[set[str] | None, Query]:
    """(every string the part can match, or None if unknown; a query that every text with a match satisfies)."""
    run: set[str] = {""}
    query, exact = TRUE, True

    def flush() -> None:
        nonlocal run, query, exact
        query, run, exact = _both(query, _of_strings(run)), {""}, False

    for op, arg in tree:
        own, needs = None, TRUE
        if op is K.LITERAL:
            own = {chr(arg).lower()}
        elif op is K.IN and all(k is K.LITERAL for k, _ in arg) and len(arg) <= MOST_CLASS:
            own = {chr(c).lower() for _, c in arg}
        elif op is K.SUBPATTERN:
            own, needs = _derive(arg[3])
        elif op is K.BRANCH:
            parts = [_derive(x) for x in arg[1]]
            own = set().union(*(s for s, _ in parts)) if all(s is not None for s, _ in parts) else None
            needs = _absorb(frozenset().union(*(_both(q, _of_strings(s)) if s is not None else q for s, q in parts)))
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT):
            low, high, inner = arg
            s, q = _derive(inner)
            if s is not None and high <= 2:
                own = {"".join(x) for n in range(low, high + 1) for x in product(sorted(s), repeat=n)}
            elif low:
                needs = _both(q, _of_strings(s)) if s is not None else q
        elif op is K.AT:
            own = {""}
        if own is not None and len(own) * len(run) <= MOST_STRINGS:
            run = {a + b for a in run for b in own}
        else:
            flush()
            query = _both(query, needs if own is None else _both(needs, _of_strings(own)))
    return (run, query) if exact else (None, _both(query, _of_strings(run)))


def trigram_query(pattern: str) -> Query:
    """Lower-case trigrams a lower-cased text must hold to match ``pattern``: an OR of ANDs; TRUE if none is mandatory."""
    strings, query = _derive(_parser.parse(pattern))
    return _both(query, _of_strings(strings)) if strings is not None else query


def build_index(docs: DataFrame, rules: Sequence[Rule] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings (trigram, doc_id) of the trigrams that the rules' queries use; rows with a null id have none."""
    grams = sorted(set().union(*(a for r in rules for a in trigram_query(r.pattern))))
    d = docs.select(F.col(doc_id).alias("doc_id"), F.lower(F.coalesce(text, F.lit(""))).alias("t")).where("doc_id IS NOT NULL")
    if not grams:
        return d.select(F.lit("").alias("trigram"), "doc_id").where("false")
    present = F.filter(F.array(*map(F.lit, grams)), lambda g: F.contains(F.col("t"), g))
    return d.select(F.explode(present).alias("trigram"), "doc_id")


def candidates(index: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(doc_id, rules): the rules, as bits by position, whose query the document's postings satisfy.

    Postings are intersected by document: trigrams become bits that are or-ed map-side before the shuffle, so neither a
    frequent trigram nor a document with many postings meets in one task.
    """
    queries = [trigram_query(r.pattern) for r in rules]
    grams = sorted(set().union(*(a for q in queries for a in q)))
    words = range(0, max(1, len(grams)), 62)
    bit = lambda lo: F.sum(F.lit(0)) if not grams else F.bit_or(sum((F.when(F.col("trigram") == g, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, g in enumerate(grams[lo : lo + 62])), F.lit(0).cast("long")))
    bits = index.groupBy("doc_id").agg(*(bit(lo).alias(f"b{k}") for k, lo in enumerate(words)))
    at = {g: divmod(i, 62) for i, g in enumerate(grams)}

    def holds(conj: frozenset) -> Column:
        masks: dict[int, int] = {}
        for g in conj:
            masks[at[g][0]] = masks.get(at[g][0], 0) | 1 << at[g][1]
        out = F.lit(True)
        for k, m in masks.items():
            out = out & (F.col(f"b{k}").bitwiseAND(F.lit(m)) == m)
        return out

    mask = F.lit(0).cast("long")
    for i, q in enumerate(queries):
        if q == TRUE:
            continue
        any_of = F.lit(False)
        for conj in sorted(q, key=sorted):
            any_of = any_of | holds(conj)
        mask = mask + F.when(any_of, F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
    return bits.select("doc_id", mask.alias("rules")).where("rules <> 0")


def _spans(rule: Rule, position: int, wanted: Column) -> Column:
    """array<struct<s, k, e>>: code-point spans of the rule's counting matches, where ``wanted``; else empty.

    What lies between the matches and the matches themselves come from two calls with one pattern; their running
    lengths are the positions.
    """
    pattern = rule.pattern.replace("\\", "\\\\").replace("'", "\\'")
    group = f"length(regexp_extract(m[i], '{pattern}', {rule.group})) >= {rule.least}" if rule.group else f"length(m[i]) >= {rule.least}"
    step = "struct(a.at + length(p[i]) + length(m[i]) AS at, "
    step += f"CASE WHEN {group} THEN concat(a.out, array(struct(a.at + length(p[i]) AS s, {position} AS k, a.at + length(p[i]) + length(m[i]) AS e))) ELSE a.out END AS out)"
    zero = "struct(0 AS at, CAST(array() AS array<struct<s:int,k:int,e:int>>) AS out)"
    fold = f"aggregate(sequence(0, size(m) - 1), {zero}, (a, i) -> {step}, a -> a.out)"
    # transform over one element binds p and m, so each is computed once a row
    both = f"transform(array(struct(split(t, '{pattern}', -1) AS p, regexp_extract_all(t, '{pattern}', 0) AS m)), x -> {fold.replace('p[i]', 'x.p[i]').replace('m[i]', 'x.m[i]').replace('size(m)', 'size(x.m)')})[0]"
    empty = F.expr("CAST(array() AS array<struct<s:int,k:int,e:int>>)")
    return F.when(wanted & F.col("t").rlike(rule.gate or rule.pattern), F.expr(both)).otherwise(empty)


def scan_secrets(docs: DataFrame, rules: Sequence[Rule] = RULES, doc_id: str = "doc_id", text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """One row for each input row: doc_id; ``kept``, a struct of the columns named in ``keep``; and ``found``: an array of
    (s, k, e), start and exclusive end in code points and the rule's position, ordered by start, then rule.

    Null and empty texts have no spans. Repeated ids share postings, so each of their rows is verified; rows with a null
    id are scanned by every rule. Columns outside ``keep`` are not read.
    """
    found = staged(candidates(build_index(docs, rules, doc_id, text), rules), "secrets").withColumnsRenamed({"doc_id": "of_id", "rules": "of_rules"})
    d = docs.select(F.col(doc_id).alias("id"), F.struct(*keep).alias("kept") if keep else F.lit(None).alias("kept"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    d = bounded_join(d, found, F.col("id") == F.col("of_id"), "left")
    full = {i for i, r in enumerate(rules) if trigram_query(r.pattern) == TRUE}
    wanted = lambda i: F.lit(True) if i in full else F.col("id").isNull() | (F.coalesce("of_rules", F.lit(0)).bitwiseAND(F.lit(1 << i)) != 0)
    spans = F.array_sort(F.concat(*(_spans(r, i, wanted(i)) for i, r in enumerate(rules))))
    return d.select(F.col("id").alias("doc_id"), "kept", spans.alias("found"))


def _listed(found: Column, rules: Sequence[Rule]) -> Column:
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(docs: DataFrame, rules: Sequence[Rule] = RULES, mask: str = "[secret]") -> DataFrame:
    """``docs`` with every span of its texts, overlapping ones merged, replaced by ``mask``; other columns unchanged."""
    columns = docs.columns
    found = scan_secrets(docs, rules, keep=columns).withColumnRenamed("kept", "doc")
    merge = """aggregate(found, struct(0 AS at, CAST(array() AS array<string>) AS out),
        (a, x) -> CASE WHEN x.e <= a.at THEN a
                       WHEN x.s < a.at THEN struct(x.e AS at, a.out AS out)
                       ELSE struct(x.e AS at, concat(a.out, array(substring(doc.text, a.at + 1, x.s - a.at), '{m}')) AS out) END,
        a -> concat(array_join(a.out, ''), substring(doc.text, a.at + 1)))""".format(m=mask.replace("'", "\\'"))
    clean = F.when(F.size("found") == 0, F.col("doc.text")).otherwise(F.expr(merge))
    return found.select(*(clean.alias(c) if c == "text" else F.col(f"doc.{c}").alias(c) for c in columns))


def op8(spark, sf_dir):
    from intervale.llm.common import table

    d = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("found", lambda x: x["k"] < len(BASE))
    counts = [F.expr(f"CAST(size(filter(found, x -> x.k = {i})) AS BIGINT)").alias(f"n_{r.kind}") for i, r in enumerate(BASE)]
    return d.select("doc_id", *counts, F.sha2(_listed(base, RULES), 256).alias("base_sha256"), _listed(F.col("found"), RULES).alias("spans"))


def _sql() -> str:
    parts = []
    for i, r in enumerate(RULES):
        pattern = r.pattern.replace("'", "''")
        least = f"length(regexp_extract(m[i], '{pattern}', {r.group})) >= {r.least}" if r.group else f"length(m[i]) >= {r.least}"
        parts.append(f"""SELECT rid, {i} k, '{r.kind}' kind, coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0)::BIGINT + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)::BIGINT s, length(m[i]) n
            FROM (SELECT rid, p, m, unnest(range(1, len(m) + 1)) i FROM (SELECT rid, string_split_regex(t, '{pattern}') p, regexp_extract_all(t, '{pattern}') m FROM d)) WHERE {least}""")
    listed = "kind || ':' || s || ':' || (s + n)"
    return f"""WITH d AS (SELECT row_number() OVER () rid, doc_id, coalesce(text, '') t FROM documents),
    f AS ({" UNION ALL ".join(parts)}),
    g AS (SELECT rid, string_agg({listed}, ',' ORDER BY s, k) spans, string_agg({listed}, ',' ORDER BY s, k) FILTER (WHERE k < {len(BASE)}) base,
        count(*) FILTER (WHERE k = 0) n_assign, count(*) FILTER (WHERE k = 1) n_access, count(*) FILTER (WHERE k = 2) n_hex FROM f GROUP BY rid)
    SELECT doc_id, coalesce(n_assign, 0)::BIGINT n_assign, coalesce(n_access, 0)::BIGINT n_access, coalesce(n_hex, 0)::BIGINT n_hex,
        sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans FROM d LEFT JOIN g USING (rid)"""


OP8_SQL = _sql()
