"""Quality rules with host verdicts: per-document rules, failure rates of hosts shrunk towards an empirical beta prior."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intervale.llm.common import SPACE, WORD, staged, word_array

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
SYMBOLS = r"[#*$%&|<>]"
#: A host is rejected if its shrunk failure rate is above this.
MAX_HOST_RATE = 0.5
#: Prior strengths the moment estimate is held between.
STRENGTH = (2.0, 1000.0)


def document_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Rule statistics of each row: doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    Null and empty texts have no words and fail. Other columns are not read, so their names can't clash. All of it is one
    narrow projection: equal 8-word windows are found by hashing each window inside the row and comparing the words
    themselves only where hashes repeat, so nothing is exploded or shuffled.
    """
    w = WINDOW
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    d = d.withColumn("words", word_array(F.col("t")))
    d = d.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD)))
    hashes = F.expr(f"CASE WHEN size(words) > {w} THEN transform(sequence(1, size(words) - {w - 1}), i -> xxhash64(slice(words, i, {w}))) ELSE array() END")
    d = d.select(
        "doc_id", "host", "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        hashes.alias("h"),
    )
    d = d.withColumn("by_hash", F.expr("CASE WHEN size(h) > size(array_distinct(h)) THEN array_sort(transform(h, (x, i) -> struct(x AS k, i AS p))) ELSE array() END"))
    again = "filter({0}, (s, i) -> (i > 0 AND get({0}, i - 1).k = s.k) OR coalesce(get({0}, i + 1).k = s.k, false))"
    d = d.withColumn("by_words", F.expr(f"array_sort(transform({again.format('by_hash')}, s -> struct(array_join(slice(words, s.p + 1, {w}), ' ') AS k, s.p AS p)))"))
    d = d.withColumn("at", F.expr(f"array_sort(transform({again.format('by_words')}, s -> s.p))"))
    d = d.withColumn("n_repeat_words", F.expr(f"CASE WHEN size(at) = 0 THEN 0L ELSE aggregate(transform(at, (p, i) -> least({w}, coalesce(get(at, i + 1) - p, {w}))), 0L, (a, x) -> a + x) END"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return d.select("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"))


def host_verdicts(rules: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Per host: host, n_docs, n_failed, shrunk_rate, host_kept.

    Failures are pre-aggregated by host, so a host with a third of the rows sends one row a task. The beta prior is
    fitted by moments to the hosts' rates; with fewer than two hosts, or no spread, its strength is held to STRENGTH.
    The null host is a host of its own.
    """
    hosts = rules.groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    m, v = hosts.agg(F.avg(rate), F.var_samp(rate)).first()
    m = min(max(m if m is not None else 0.5, 1e-6), 1 - 1e-6)
    strength = min(max(m * (1 - m) / v - 1, STRENGTH[0]), STRENGTH[1]) if v else STRENGTH[1] if v == 0 else STRENGTH[0]
    shrunk = (F.col("n_failed") + m * strength) / (F.col("n_docs") + strength)
    return hosts.select("host", "n_docs", "n_failed", shrunk.alias("shrunk_rate"), (shrunk <= max_rate).alias("host_kept"))


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row for each input row, repeated rows and null ids included: the rule statistics, the host's shrunk failure
    rate and ``kept``: the document passes its own rules and its host's rate is at most ``max_rate``.

    An empty table gives an empty result. The rule statistics, a few numbers a row, are staged once and read twice.
    """
    rules = staged(document_rules(docs, doc_id, text, host), "quality")
    hosts = host_verdicts(rules, max_rate).withColumnRenamed("host", "of_host")
    joined = rules.join(hosts, rules["host"].eqNullSafe(hosts["of_host"]), "left")
    return joined.select(*rules.columns, "shrunk_rate", (~F.col("base_failed") & F.col("host_kept")).alias("kept"))


def op1(spark, sf_dir):
    from intervale.llm.common import table

    return quality_rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP1_SQL = f"""
WITH d AS (SELECT row_number() OVER () rid, doc_id, source, coalesce(text, '') t,
      list_filter(string_split_regex(coalesce(text, ''), '{SPACE}'), lambda x: x <> '') w FROM documents),
g AS (SELECT rid, i, array_to_string(w[i:i + 7], ' ') s FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) i FROM d WHERE len(w) >= 8)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) c FROM g) WHERE c > 1),
c AS (SELECT rid, count(DISTINCT p) n FROM (SELECT rid, unnest(range(i, i + 8)) p FROM r) GROUP BY rid),
b AS (SELECT doc_id, source, len(w)::BIGINT n_words, length(array_to_string(w, ''))::BIGINT word_chars,
      (length(t) - length(regexp_replace(t, '{SYMBOLS}', '', 'g')))::BIGINT n_symbols,
      (len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')))
       - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')))))::BIGINT n_dup_lines,
      coalesce(c.n, 0)::BIGINT n_repeat_words FROM d LEFT JOIN c USING (rid)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words base_failed FROM b),
h AS (SELECT source, count(*) n, count(*) FILTER (WHERE base_failed) k FROM f GROUP BY source),
m AS (SELECT least(greatest(avg(k / n), 1e-6), 1 - 1e-6) m, var_samp(k / n) v FROM h),
p AS (SELECT m, CASE WHEN v > 0 THEN least(greatest(m * (1 - m) / v - 1, {STRENGTH[0]}), {STRENGTH[1]}) WHEN v = 0 THEN {STRENGTH[1]} ELSE {STRENGTH[0]} END s FROM m)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (h.k + (SELECT m * s FROM p)) / (h.n + (SELECT s FROM p)) <= {MAX_HOST_RATE} AS kept
FROM f JOIN h ON f.source IS NOT DISTINCT FROM h.source
"""
