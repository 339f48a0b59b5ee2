"""Registered queries that go the whole way over files: the tables are written as BED and VCF files, read, indexed, saved,
searched and reported; and those of the index's own operations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intervale.functions import scalars as S
from intervale.operators import recipes
from intervale.plans import index as plans_index
from intervale.plans import search as plans
from intervale.queries import CONF, FEATURES, FILES, FISHER, GENOME, HITS, ODDS, QUERIES, _add, _scored, _with, features, query_set
from intervale.sources.metadata import MetaColumn, parse_where, typed
from intervale.sources.readers import Corpus, read_intervals, write_named
from intervale.streaming.queries import stream_counts
from intervale.tables import shared_dir, table


def _folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _base(path) -> F.Column:
    return F.regexp_replace(S.base_name(path), r"\.(bed|vcf)\.gz$", "")


def _bed_files(spark: SparkSession, d: str) -> str:
    """The corpus as six BED files; metadata of CONF in columns 4 to 6, the id in column 7."""
    f = features(spark, d)
    line = F.concat_ws("\t", F.concat(F.lit("chr"), "chrom"), F.col("start").cast("string"), F.col("end").cast("string"), *(F.col(c.name).cast("string") for c in CONF), F.col("id").cast("string"))
    folder = _folder(spark, "bed")
    write_named(f.select(F.col("fname").alias("file_name"), line.alias("line"), "chrom", "start", "end", "id"), folder, ".bed.gz", order=["chrom", "start", "end", "id"])
    return folder


FILE_CONF = [MetaColumn(4, "l_linenumber", "INT_32"), MetaColumn(5, "l_discount", "DOUBLE"), MetaColumn(6, "l_returnflag", "STRING", 4)]


def _file_index(spark: SparkSession, d: str) -> plans_index.IntervalIndex:
    return plans_index.build_index(spark, f"{_bed_files(spark, d)}/*.bed.gz", _folder(spark, "index"), FILE_CONF, payload={"id": S.integer(S.field(F.col("line"), 7))})


def _query_file(spark: SparkSession, d: str) -> str:
    """The queries as one BED file with a header, rows of two columns and rows that end before they start."""
    q = query_set(spark, d)
    bad = F.when(F.col("qid") % 50 == 0, F.concat_ws("\t", "chrom", F.col("end").cast("string"), F.col("start").cast("string"))).when(F.col("qid") % 50 == 1, F.concat_ws("\t", "chrom", F.col("start").cast("string")))
    line = F.coalesce(bad, F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("end").cast("string"), F.col("qid").cast("string")))
    head = spark.createDataFrame([("q", "#header", -2), ("q", "track name=x", -1)], "file_name string, line string, qid bigint")
    folder = _folder(spark, "queries")
    write_named(q.select(F.lit("q").alias("file_name"), line.alias("line"), "qid").union(head), folder, ".bed.gz", order=["qid"])
    return f"{folder}/q.bed.gz"


_GOOD = "good AS (SELECT * FROM queries WHERE qid % 50 > 1)"
_GOOD_HITS = "hits AS (SELECT q.qid, q.chrom qc, q.s qs, q.e qe, i.* FROM good q JOIN features i ON q.chrom = i.chrom AND i.s <= q.e AND i.e >= q.s)"


@_add("file_bed_intervals", _with(FEATURES) + "SELECT fname file, chrom, s AS start, e AS \"end\", id FROM features")
def file_bed_intervals(spark, d):
    c = read_intervals(spark, f"{_bed_files(spark, d)}/*.bed.gz").intervals
    return c.select(_base(F.col("file_name")).alias("file"), "chrom", "start", "end", S.integer(S.field(F.col("line"), 7)).alias("id"))


@_add("file_vcf_intervals", _with(FEATURES) + """SELECT fname file, chrom, s AS start, CASE l_linenumber % 3 WHEN 0 THEN e + 1 WHEN 1 THEN s + l_linenumber * 7 ELSE s + l_linenumber END::BIGINT AS "end" FROM features""")
def file_vcf_intervals(spark, d):
    f, n = features(spark, d), F.col("l_linenumber")
    info = F.when(n % 3 == 0, F.concat(F.lit("X=1;END="), F.col("end").cast("string"))).when(n % 3 == 1, F.concat(F.lit("SVTYPE=DEL;SVLEN=-"), (n * 7).cast("string"))).otherwise(".")
    line = F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.lit("."), F.expr("repeat('A', CAST(l_linenumber AS INT))"), F.lit("T"), F.lit("."), F.lit("."), info)
    head = f.select("fname").distinct().select(F.col("fname").alias("file_name"), F.lit("##fileformat=VCFv4.2").alias("line"), F.lit(-1).cast("long").alias("start"))
    folder = _folder(spark, "vcf")
    write_named(f.select(F.col("fname").alias("file_name"), line.alias("line"), "start").union(head), folder, ".vcf.gz", order=["start"])
    c = read_intervals(spark, f"{folder}/*.vcf.gz").intervals
    return c.select(_base(F.col("file_name")).alias("file"), "chrom", "start", "end")


@_add("file_rejects", _with(QUERIES) + "SELECT 'q' file, CASE qid % 50 WHEN 0 THEN 'inverted' ELSE 'columns' END reason, count(*) n FROM queries WHERE qid % 50 < 2 GROUP BY ALL")
def file_rejects(spark, d):
    r = read_intervals(spark, _query_file(spark, d)).rejects
    return r.groupBy(_base(F.col("file_name")).alias("file"), "reason").agg(F.count("*").alias("n"))


@_add("file_row_numbers", _with(FEATURES) + "SELECT fname file, id, row_number() OVER (PARTITION BY fname ORDER BY chrom, s, e, id) - 1 row_ord, ((dense_rank() OVER (ORDER BY fname) - 1) * 1099511627776 + row_number() OVER (PARTITION BY fname ORDER BY chrom, s, e, id) - 1)::BIGINT interval_id FROM features")
def file_row_numbers(spark, d):
    """Ids don't depend on how the files are split and packed."""
    index = _file_index(spark, d)
    rows = index.intervals.join(index.files().select("file_id", "file_name"), "file_id")
    return rows.select(_base(F.col("file_name")).alias("file"), F.col("payload.id").alias("id"), "row_ord", "interval_id")


@_add("file_search_report", _with(FEATURES, QUERIES, _GOOD, _GOOD_HITS, FILES) + "SELECT '#' || f.fname || chr(9) || 'size:' || f.n || chr(9) || 'overlaps:' || count(h.fname) AS line FROM files f LEFT JOIN hits h USING (fname) GROUP BY f.fname, f.n")
def file_search_report(spark, d):
    q = read_intervals(spark, _query_file(spark, d)).intervals.select("chrom", "start", "end")
    lines = [(x,) for x in plans.count_text(plans.Search(_file_index(spark, d), q).counts())]  # a line a file
    return spark.createDataFrame(lines, "line string").select(F.regexp_replace("line", r"^#.*/([^/\t]*)\.bed\.gz\t", "#$1\t").alias("line"))


@_add("file_grouped_report", _with(FEATURES, QUERIES, _GOOD, _GOOD_HITS) + "SELECT qc || chr(9) || qs || chr(9) || qe || chr(9) || qid AS line, fname file, count(*) AS overlaps FROM hits GROUP BY ALL")
def file_grouped_report(spark, d):
    q = read_intervals(spark, _query_file(spark, d)).intervals.select("chrom", "start", "end", F.struct("file_name", "row_ord").alias("ord"), "line")
    g = plans.Search(_file_index(spark, d), q).grouped("ord", "line")
    return g.select("line", _base(F.col("file_name")).alias("file"), "overlaps")


@_add("file_point_lookup", _with(FEATURES) + "SELECT fname file, id FROM (SELECT fname, id, dense_rank() OVER (ORDER BY fname) - 1 f, row_number() OVER (PARTITION BY fname ORDER BY chrom, s, e, id) - 1 r FROM features) WHERE f = 1 AND r = 5")
def file_point_lookup(spark, d):
    one = _file_index(spark, d).lookup((1 << plans_index.LINE_BITS) + 5)
    return one.select(_base(F.col("file_name")).alias("file"), S.integer(S.field(F.col("line"), 7)).alias("id"))


@_add("file_payload_records", _with(FEATURES) + "SELECT fname file, id FROM features WHERE chrom = '4' AND s <= 150000 AND e >= 20000")
def file_payload_records(spark, d):
    r = plans.Search(_file_index(spark, d), "chr4:20000-150000").records(payload=True)
    return r.select(_base(F.col("file_name")).alias("file"), F.col("payload.id").alias("id"))


@_add("first_records", _with(FEATURES) + "SELECT fname file, id FROM features WHERE chrom = '4' AND s <= 900000 AND e >= 20000 ORDER BY fname, s, e, id LIMIT 10")
def first_records(spark, d):
    r = plans.Search(_file_index(spark, d), "4:20000-900000").first(10)
    return r.select(_base(F.col("file_name")).alias("file"), S.integer(S.field(F.col("line"), 7)).alias("id"))


@_add("total_hits", _with(FEATURES, QUERIES, HITS) + "SELECT count(*) total FROM hits")
def total_hits(spark, d):
    return spark.createDataFrame([(plans.Search(_row_index(spark, d), query_set(spark, d)).total(),)], "total bigint")


def _row_corpus(spark: SparkSession, d: str, where: str = "true") -> Corpus:
    f = features(spark, d).where(where)
    line = F.concat_ws("\t", *(F.col(c.name).cast("string") for c in CONF), F.col("id").cast("string"))
    rows = f.select(F.col("fname").alias("file_name"), "chrom", "start", "end", line.alias("line"), F.col("id").alias("row_ord"))
    return Corpus(rows, rows.where("false"), rows.select("file_name").distinct())


def _row_index(spark: SparkSession, d: str) -> plans_index.IntervalIndex:
    path = _folder(spark, "index")
    plans_index.from_corpus(_row_corpus(spark, d), CONF).save(path)
    return plans_index.IntervalIndex.load(spark, path)


@_add("index_append", _with(FEATURES, QUERIES, HITS, FILES) + "SELECT f.fname file_name, f.n num_intervals, count(h.fname) AS overlaps FROM files f LEFT JOIN hits h USING (fname) GROUP BY ALL")
def index_append(spark, d):
    """Half of the files saved, the other half added to the saved index."""
    path = _folder(spark, "index")
    plans_index.from_corpus(_row_corpus(spark, d, "fname LIKE 'A%'"), CONF).save(path)
    plans_index.from_corpus(_row_corpus(spark, d, "fname NOT LIKE 'A%'"), CONF).append(path)
    return plans.Search(plans_index.IntervalIndex.load(spark, path), query_set(spark, d)).counts().select("file_name", "num_intervals", "overlaps")


@_add("index_merge", _with(FEATURES) + "SELECT fname file_name, count(*) num_intervals, count(DISTINCT id) ids FROM features GROUP BY fname")
def index_merge(spark, d):
    a, b = (plans_index.from_corpus(_row_corpus(spark, d, w), CONF) for w in ("fname LIKE 'A%'", "fname NOT LIKE 'A%'"))
    m = plans_index.merge(a, b)
    ids = m.intervals.groupBy("file_id").agg(F.countDistinct("interval_id").alias("ids"))
    return m.files().join(ids, "file_id").select("file_name", "num_intervals", "ids")


@_add("removed_hits", _with(FEATURES, QUERIES, HITS) + "SELECT count(*) hits, count(*) FILTER (l_discount < 0.04) kept, count(*) FILTER (NOT l_discount < 0.04) removed FROM hits")
def removed_hits(spark, d):
    return plans.Search(_row_index(spark, d), query_set(spark, d), where="l_discount<0.04").removed()


#: A column of each declared type, over the tab-separated text made in ``metadata_types``, with a predicate on each.
TYPED = [MetaColumn(1, "c", "CHAR"), MetaColumn(2, "i8", "INT_8"), MetaColumn(3, "i16", "INT_16"), MetaColumn(4, "i32", "INT_32"), MetaColumn(5, "i64", "INT_64"), MetaColumn(6, "f", "FLOAT"), MetaColumn(7, "dbl", "DOUBLE"), MetaColumn(8, "s", "STRING", 3)]
_ASKED = {"i8": (3, "l_linenumber"), "i16": (20, "(l_orderkey % 30000)"), "i32": (500, "l_partkey"), "i64": (2000, "l_orderkey"), "f": (25.5, "l_quantity"), "dbl": (0.05, "l_discount")}
_SYMBOLS = {"==": "=", "!=": "<>", "<": "<", ">": ">", "<=": "<=", ">=": ">="}
_PREDICATES = [(f"{c}{op}{v}", f"{sql} {_SYMBOLS[op]} {v}") for c, (v, sql) in _ASKED.items() for op in _SYMBOLS]
_PREDICATES += [(f"c{op}N", f"l_returnflag {_SYMBOLS[op]} 'N'") for op in _SYMBOLS] + [(f"s{op}NOxy", f"substr(l_returnflag || l_linestatus || 'xyz', 1, 3) {_SYMBOLS[op]} 'NOx'") for op in _SYMBOLS]


@_add("metadata_types", " UNION ALL ".join(f"SELECT '{p}' predicate, count(*) FILTER ({sql}) kept FROM lineitem" for p, sql in _PREDICATES))
def metadata_types(spark, d):
    t = table(spark, d, "lineitem")
    values = ("l_returnflag", "l_linenumber", F.col("l_orderkey") % 30000, "l_partkey", "l_orderkey", "l_quantity", "l_discount", F.concat("l_returnflag", "l_linestatus", F.lit("xyz tail")))
    rows = t.select(F.concat_ws("\t", *((v if isinstance(v, F.Column) else F.col(v)).cast("string") for v in values)).alias("line"))
    rows = rows.select(typed(F.col("line"), TYPED).alias("meta"))
    one = rows.agg(*(F.count_if(parse_where(TYPED, p)).alias(f"n{k}") for k, (p, _) in enumerate(_PREDICATES)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(p).alias("predicate"), F.col(f"n{k}").alias("kept")) for k, (p, _) in enumerate(_PREDICATES)))).alias("x")).select("x.*")


@_add("volcano_order", _with(FEATURES, QUERIES, HITS, FILES, "counts AS (SELECT f.fname, f.n, f.mean, coalesce(h.c, 0) c FROM files f LEFT JOIN (SELECT fname, count(*) c FROM hits GROUP BY fname) h USING (fname))", f"""qs AS (SELECT count(*) n, avg(e - s) mean FROM queries),
    t0 AS (SELECT fname, counts.n, c n11, greatest(qs.n - c, 0) n12, greatest(counts.n - c, 0) n21, {GENOME}::DOUBLE / (counts.mean + qs.mean) room FROM counts, qs),
    t AS (SELECT fname, n, n11, n12, n21, greatest(trunc(greatest(n11 + n12 + n21, room))::BIGINT - (n11 + n12 + n21), 0)::BIGINT n22 FROM t0)""", FISHER) + f""", v AS (SELECT fname, round({ODDS}, 6) o, round(two, 6) p FROM t JOIN f USING (fname))
    SELECT fname, round(abs(CASE WHEN o = 0 THEN 0 ELSE log2(o) END * CASE WHEN p = 0 THEN 6 ELSE -log10(p) END), 4) size FROM v ORDER BY size DESC, fname LIMIT 4""")
def volcano_order(spark, d):
    """The plotting scripts' order: by the size of the product of their two logarithms."""
    s = _scored(spark, d).select("fname", F.round(F.abs(S.plot_log2fc(F.col("odds_ratio")) * S.plot_neg_log10(F.col("fishers_two_tail"))), 4).alias("size"))
    return s.orderBy(F.col("size").desc(), "fname").limit(4)


@_add("label_names", "SELECT p_partkey, regexp_replace(translate(p_type || ' (' || p_brand || ')/x', ' /()', '____'), '$', '') AS label FROM part")
def label_names(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", S.sanitize(F.concat("p_type", F.lit(" ("), "p_brand", F.lit(")/x.bed.gz"))).alias("label"))


_SETS = f"""sets AS (SELECT o_orderpriority qf, count(*) qn, avg(e - s) qmean FROM queries GROUP BY 1),
    grid AS (SELECT qf, qn, qmean, files.fname file, files.n, files.mean FROM sets, files),
    c0 AS (SELECT o_orderpriority qf, fname file, count(*) c FROM hits GROUP BY ALL),
    t0 AS (SELECT qf || '|' || file fname, n, coalesce(c, 0) n11, greatest(qn - coalesce(c, 0), 0) n12, greatest(n - coalesce(c, 0), 0) n21, {GENOME}::DOUBLE / (mean + qmean) room FROM grid LEFT JOIN c0 USING (qf, file)),
    t AS (SELECT fname, n, n11, n12, n21, greatest(trunc(greatest(n11 + n12 + n21, room))::BIGINT - (n11 + n12 + n21), 0)::BIGINT n22 FROM t0)"""


@_add("all_vs_all_scores", _with(FEATURES, QUERIES, HITS, FILES, _SETS, FISHER) + f"SELECT fname pair, n11 AS overlaps, round({ODDS}, 6) odds_ratio, round(two, 6) fishers_two_tail, round(rgt, 6) fishers_right_tail FROM t JOIN f USING (fname)")
def all_vs_all_scores(spark, d):
    q = query_set(spark, d).select(F.col("o_orderpriority").alias("query_file"), "chrom", "start", "end")
    r = plans.all_against_all(q, _row_index(spark, d), GENOME)
    rounded = (F.round(c, 6).alias(c) for c in ("odds_ratio", "fishers_two_tail", "fishers_right_tail"))
    return r.select(F.concat_ws("|", "query_file", "file_name").alias("pair"), "overlaps", *rounded)


@_add("stream_overlap_counts", _with(FEATURES, QUERIES, HITS) + "SELECT fname file_name, count(*) AS overlaps FROM hits GROUP BY fname")
def stream_overlap_counts(spark, d):
    """The queries as a stream of micro-batches against the index; counts of the batches summed."""
    index, here = _row_index(spark, d), _folder(spark, "stream")
    query_set(spark, d).select("chrom", "start", "end").write.parquet(f"{here}/in")
    q = spark.readStream.schema("chrom string, start bigint, end bigint").parquet(f"{here}/in")
    stream_counts(q, index.intervals.select("chrom", "start", "end", "level", "bin", "file_id"), f"{here}/out", f"{here}/check").awaitTermination()
    n = spark.read.parquet(f"{here}/out").groupBy("file_id").agg(F.sum("overlaps").alias("overlaps"))
    return n.join(index.files(), "file_id").select("file_name", "overlaps")


@_add("longest_labels_first", "SELECT n_name, length(n_name)::INT size FROM nation ORDER BY size DESC, n_name LIMIT 5")
def longest_labels_first(spark, d) -> DataFrame:
    n = table(spark, d, "nation").select("n_name", F.length("n_name").alias("size"))
    return recipes.top_k(n, F.struct((-F.col("size")).alias("size"), "n_name"), 5)
