"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree over block quotas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from intervale.llm.common import WORD, staged

#: Weights of the sources in order of their names, repeated; the mix has SHARE times the words of the input, a source at most MOST times its own.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Output shards, as a power of two, and blocks a shard has on average.
LEVELS, BLOCKS_A_SHARD = 3, 256
SEED = 17
#: Documents that one sorting group holds on average; groups are ranges of the permutation key within a source.
GROUP_ROWS = 4000
#: Words that a task writes of a shard, on average: a shard is spread over as many ranges of its shuffled order as it needs.
RANGE_WORDS = 4_000_000
#: Bits of a piece's place in its shard's order.
PLACE = 40
#: Copies of one row that a task makes positions for at a time.
COPIES = 65_536


def source_targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Per source: source, rn, source_size, target, from rows (source, size).

    Sizes are pre-aggregated by source. Targets follow the weights; a source above its limit keeps the limit and the
    rest is shared anew, whose fixed point is reached at once by taking sources in order of limit over weight. The
    windows without a key run over one row a source.
    """
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("rn", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    w = F.get(F.array(*map(F.lit, weights)), F.pmod(F.col("rn") - 1, F.lit(len(weights)))).cast("double")
    s = s.select("source", "rn", "source_size", w.alias("w"), (most * F.col("source_size")).alias("most"))
    order = Window.orderBy(F.col("most") / F.col("w"), "rn")
    whole = Window.partitionBy()
    s = s.withColumns({
        "pos": F.row_number().over(order),
        "below": F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("most"),
        "w_from": F.sum("w").over(whole) - F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("w"),
        "total": F.sum("source_size").over(whole),
    })
    s = s.withColumn("level", (share * F.col("total") - F.col("below")) / F.col("w_from"))
    free = F.col("w") * F.col("level") <= F.col("most")
    s = s.withColumn("first", F.min(F.when(free, F.struct("pos", "level"))).over(whole))
    target = F.when(F.col("first").isNull() | (F.col("pos") < F.col("first.pos")), F.col("most").cast("double")).otherwise(F.col("w") * F.col("first.level"))
    return s.select("source", "rn", "source_size", target.alias("target"))


def _draw(n_all: str, n_own: str, n_take: str, u: str) -> str:
    """SQL of one hypergeometric draw by inversion: of n_take balls taken from n_all, how many are among the n_own.

    Log ratios of neighbouring probabilities are summed over the support, or 40 standard deviations about the mode
    where it is longer, beyond which the mass is below double precision.
    """
    let = lambda name, value, body: f"transform(array({value}), {name} -> {body})[0]"
    low, high = f"greatest(0L, {n_take} - ({n_all} - {n_own}))", f"least({n_own}, {n_take})"
    sd = f"(40 * sqrt({n_take} * ({n_own} / {n_all}) * (1 - {n_own} / {n_all})) + 40)"
    mid = f"floor({n_take} * ({n_own} / {n_all}))"
    support = f"struct(greatest({low}, CAST({mid} - {sd} AS BIGINT)) AS lo, least({high}, CAST({mid} + {sd} AS BIGINT)) AS hi)"
    up = f"ln(({n_own} - k + 1.0D) * ({n_take} - k + 1.0D)) - ln(k * ({n_all} - {n_own} - {n_take} + k + 0.0D))"
    ks = "CASE WHEN r.hi > r.lo THEN sequence(r.lo + 1, r.hi) ELSE CAST(array() AS array<bigint>) END"
    peak = f"aggregate({ks}, struct(0D AS l, 0D AS m), (s, k) -> struct(s.l + {up} AS l, greatest(s.m, s.l + {up}) AS m), s -> s.m)"
    total = f"aggregate({ks}, struct(0D AS l, exp(-m) AS t), (s, k) -> struct(s.l + {up} AS l, s.t + exp(s.l + {up} - m) AS t), s -> s.t)"
    pick = f"aggregate({ks}, struct(0D AS l, exp(-m) AS c, r.lo AS k), (s, k) -> struct(s.l + {up} AS l, s.c + exp(s.l + {up} - m) AS c, CASE WHEN s.c < {u} * t THEN k ELSE s.k END AS k), s -> s.k)"
    return f"CASE WHEN {n_own} = 0 OR {n_take} = 0 THEN 0L WHEN {n_own} = {n_all} THEN {n_take} ELSE {let('r', support, let('m', peak, let('t', total, pick)))} END"


def shard_quotas(sources: DataFrame, levels: int = LEVELS, seed: int = SEED) -> DataFrame:
    """(shard, rn, blocks) from rows (rn, blocks): the exact quotas, split down a binary tree with one row a node.

    A node's left half takes half of its blocks (rounded down), drawn without replacement from all its sources: source
    by source, each draw hypergeometric given what is left. Draws are seeded by level, node and source (a digest, which SQL
    elsewhere can repeat), so reruns agree. A node holds one number a source: the plan's size is sources times shards, whatever the corpus holds.
    """
    root = sources.agg(F.array_sort(F.collect_list(F.struct("rn", "blocks"))).alias("q")).select(F.lit(0).alias("node"), "q").where(F.size("q") > 0)
    for level in range(levels):
        u = f"(CAST(conv(substring(md5(CAST(concat_ws(':', {seed}, {level}, node, x.rn) AS BINARY)), 1, 13), 16, 10) AS BIGINT) + 0.5D) / 4503599627370496D"
        take = f"transform(array({_draw('a.n', 'x.blocks', 'a.need', u)}), d -> struct(a.n - x.blocks AS n, a.need - d AS need, concat(a.out, array(d)) AS out))[0]"
        total = "aggregate(q, 0L, (t, x) -> t + x.blocks)"
        left = f"aggregate(q, struct({total} AS n, {total} div 2 AS need, CAST(array() AS array<bigint>) AS out), (a, x) -> {take}, a -> a.out)"
        root = root.select("node", "q", F.expr(left).alias("l")).select("node", "q", "l", F.size("l").alias("n_sources"))
        halves = F.expr("""explode(array(
            struct(node * 2 AS node, transform(q, (x, i) -> struct(x.rn AS rn, l[i] AS blocks)) AS q),
            struct(node * 2 + 1 AS node, transform(q, (x, i) -> struct(x.rn AS rn, x.blocks - l[i] AS blocks)) AS q)))""")
        root = staged(root.select(halves.alias("h")).select("h.node", "h.q"), "quotas")
    return root.select(F.col("node").alias("shard"), F.explode("q").alias("x")).select("shard", "x.rn", "x.blocks")


def block_shards(blocks: DataFrame, levels: int = LEVELS, seed: int = SEED) -> DataFrame:
    """(of_rn, shards) from rows (rn, blocks): the shard of each of a source's blocks, in the order of the tape.

    The blocks of a source are permuted by a digest of seed, source and block; the shards take them in that order, each as
    many as the tree gives it, so what a shard draws is scattered over the tape and no block is drawn twice. A row holds a
    number a block, and there are about 2**levels * BLOCKS_A_SHARD blocks in all, whatever the corpus holds, and one more
    a source.
    """
    before = Window.partitionBy("rn").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cuts = shard_quotas(blocks, levels, seed).withColumn("hi", F.sum("blocks").over(before))
    cuts = cuts.select(F.col("rn").alias("c_rn"), "shard", (F.col("hi") - F.col("blocks")).alias("lo"), "hi")
    each = blocks.where("blocks > 0").select("rn", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("b"))
    order = F.md5(F.concat_ws(":", F.lit(seed), "rn", "b").cast("binary"))
    each = each.withColumn("rank", F.row_number().over(Window.partitionBy("rn").orderBy(order, "b")) - 1)
    dealt = each.join(cuts, (F.col("rn") == F.col("c_rn")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return dealt.groupBy(F.col("rn").alias("of_rn")).agg(F.transform(F.array_sort(F.collect_list(F.struct("b", "shard"))), lambda x: x["shard"]).alias("shards"))


def _key(seed: int, more: Sequence[str] = ()):
    """Sixteen digits of a digest of seed, id and text, and of other columns: rows that share it are equal in all of these."""
    parts = [F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("null"))]
    return F.substring(F.md5(F.concat_ws(":", *parts, *([F.xxhash64(*more).cast("string")] if more else [])).cast("binary")), 1, 16)


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST, levels: int = LEVELS, seed: int = SEED, also: Sequence[str] = ()) -> DataFrame:
    """One row for each input row: doc_id, source, size, source_size, target, taken, shard_words, pieces, key,
    copies (rows that share the key).

    A source's documents, in the order of a seeded digest of id, text and the columns ``also``, lie end to end on a tape that
    repeats up to ``most`` times. The first ``target`` words, rounded, are cut into blocks; the splitting tree says how many each
    shard draws, and shards draw them from a permutation of the source's blocks. ``pieces``: (shard, pass, start, words, place)
    of what shards draw of the document, ``taken`` and ``shard_words`` (a number a shard, joined by commas) their sums; sorting a
    shard by ``place`` shuffles it. The last block of a source may go beyond its target, and is drawn up to it.

    Only id, source, size and ``key`` are staged and moved, never a text. The tape positions are running sums in two steps, by
    ranges of the digest and within each, so a source with a third of all rows is dealt over as many groups as it has
    rows for; rows equal in all these columns are one row with a count until they have their places, one after another. Null
    sources are a source of their own, last in order; null and empty texts have size 0 and nothing to take; null ids are
    told apart by their texts; an empty table gives an empty result.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select("doc_id", "source", size.alias("size"), _key(seed, also).alias("key"))
    rows = staged(rows.groupBy("doc_id", "source", "size", "key").agg(F.count("*").alias("copies")), "mix")
    n_rows = rows.count()
    digits = 1
    while n_rows > GROUP_ROWS * 16**digits:
        digits += 1
    sources = source_targets(rows.select("source", (F.col("size") * F.col("copies")).alias("size")), weights, share, most)
    sources = staged(sources.withColumn("quota", F.least(most * F.col("source_size"), F.round("target").cast("long"))), "mix-sources")
    in_all = sources.agg(F.sum("quota")).first()[0] or 0
    block = max(1, in_all // (2**levels * BLOCKS_A_SHARD))
    shards = block_shards(sources.select("rn", F.expr(f"(quota + {block - 1}) div {block}").alias("blocks")), levels, seed)
    plan = sources.join(shards, F.col("rn") == F.col("of_rn"), "left").select(F.col("source").alias("of_source"), "source_size", "target", "quota", "shards")
    plan = staged(plan, "mix-plan")

    rows = rows.withColumn("part", F.substring("key", 1, digits))
    parts = rows.groupBy("source", "part").agg(F.sum(F.col("size") * F.col("copies")).alias("words"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = parts.select(F.col("source").alias("p_source"), F.col("part").alias("p_part"), (F.sum("words").over(before) - F.col("words")).alias("base"))
    within = Window.partitionBy("source", "part").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("off", F.sum(F.col("size") * F.col("copies")).over(within) - F.col("size") * F.col("copies"))
    rows = rows.join(parts, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("part") == F.col("p_part")))
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("of_source")))
    rows = rows.withColumn("c", F.explode(F.expr(f"sequence(0L, (copies - 1) div {COPIES})")))
    rows = rows.withColumn("c", F.explode(F.expr(f"sequence(c * {COPIES}, least(copies, (c + 1) * {COPIES}) - 1)")))
    rows = rows.withColumn("start", F.col("base") + F.col("off") + F.col("c") * F.col("size"))
    none = "slice(array(struct(0 AS shard, 0 AS pass, 0L AS start, 0L AS words, 0L AS place)), 1, 0)"
    found = F.expr(f"""CASE WHEN size > 0 THEN flatten(flatten(transform(sequence(0, {most - 1}), e -> transform(filter(array(struct(
        start + e * source_size AS p, least(start + size + e * source_size, quota) AS q)), r -> r.q > r.p), r -> transform(sequence(r.p div {block}, (r.q - 1) div {block}), b -> struct(
        shards[CAST(b AS INT)] AS shard, e AS pass, greatest(r.p, b * {block}) - r.p AS start, least(r.q, (b + 1) * {block}) - greatest(r.p, b * {block}) AS words,
        pmod(xxhash64({seed}, b, e, c, key), {1 << PLACE}L) AS place)))))) ELSE {none} END""")
    out = rows.withColumn("pieces", found)
    taken = F.expr("aggregate(pieces, 0L, (a, x) -> a + x.words)")
    by_shard = F.expr(f"array_join(transform(sequence(0, {2**levels - 1}), s -> aggregate(filter(pieces, x -> x.shard = s), 0L, (a, x) -> a + x.words)), ',')")
    return out.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), by_shard.alias("shard_words"), "pieces", "key", "copies")


def mixed_rows(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST, levels: int = LEVELS, seed: int = SEED) -> DataFrame:
    """``docs`` as the mix draws them: one row each time the mix starts the document, its columns unchanged, dealt by shard and
    shuffled within each; documents that it never starts are left out. A document cut by a block's or the mix's end is kept
    whole, in the shard that has its start. Rows equal in all columns count as often as they are there.

    The plan is made of narrow rows; whole texts move twice, to meet what is drawn of them and to their shard. A shard is
    written by as many tasks as it has RANGE_WORDS words, each a range of its shuffled order.
    """
    columns = docs.columns
    drawn = mix(docs, weights, share, most, levels, seed, columns)
    drawn = staged(drawn.select(F.col("key").alias("of"), F.col("size").alias("words"), "copies", F.explode(F.filter("pieces", lambda x: x["start"] == 0)).alias("x")).select("of", "words", "copies", "x.shard", "x.place"), "drawn")
    ranges = max(1, -(-(drawn.agg(F.sum("words")).first()[0] or 0) // (2**levels * RANGE_WORDS)))
    names = [f"c{k}" for k in range(len(columns))]  # columns of any name
    texts = docs.select(_key(seed, columns).alias("key"), *(F.col(f"`{c}`").alias(n) for c, n in zip(columns, names, strict=True)))
    if not drawn.where("copies > 1").isEmpty():
        texts = texts.dropDuplicates(["key"])  # rows of one key are equal
    at = F.col("shard") * ranges + F.expr(f"(place * {ranges}) div {1 << PLACE}L")
    out = drawn.drop("words", "copies").hint("merge").join(texts, F.col("of") == F.col("key"))
    out = out.repartitionById(2**levels * ranges, at.cast("int")).sortWithinPartitions("shard", "place")
    return out.select(*(F.col(n).alias(c) for c, n in zip(columns, names, strict=True)))


def op5(spark, sf_dir):
    from intervale.llm.common import table

    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("source", "pieces", "key", "copies")


def _op5_sql() -> str:
    """The whole mix again: targets, the splitting tree with its draws by inversion, the permuted blocks and what shards draw."""
    ways = range(2**LEVELS)
    factorial = lambda x: f"lgamma({x} + 1.0)"
    log_p = " + ".join(map(factorial, ("x_own", "x_n - x_own", "x_need", "x_n - x_need"))) + "".join(f" - {factorial(x)}" for x in ("k", "x_own - k", "x_need - k", "x_n - x_own - x_need + k", "x_n"))
    tree = ""
    for level in range(LEVELS):
        src = "SELECT 0 node, rn, blocks, sum(blocks) OVER () tot FROM sb" if level == 0 else f"SELECT node, rn, blocks, sum(blocks) OVER (PARTITION BY node) tot FROM h{level - 1}"
        tree += f"""
a{level} AS ({src}),
g{level} AS (SELECT node, rn, blocks own, (('0x' || md5('{SEED}:{level}:' || node || ':' || rn)[1:13])::BIGINT + 0.5) / 4503599627370496.0 u, tot // 2 half,
    tot, tot - coalesce(sum(blocks) OVER (PARTITION BY node ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) n FROM a{level}),
r{level} AS (
  SELECT node, 0 rn, half::BIGINT need, 0::BIGINT l FROM (SELECT DISTINCT node, half FROM g{level})
  UNION ALL
  SELECT node, rn, (need - d)::BIGINT, d::BIGINT FROM (
    SELECT g.node, g.rn, r.need need, CASE WHEN own = 0 OR r.need = 0 THEN 0 WHEN own = n THEN r.need ELSE
      (SELECT min(k) FROM (SELECT k, sum(p) OVER (ORDER BY k) c FROM (SELECT k, exp({log_p}) p
        FROM (SELECT unnest(range(greatest(0, r.need - (n - own))::BIGINT, least(own, r.need)::BIGINT + 1)) k, r.need x_need, own x_own, n x_n))) WHERE c >= u OR k = least(own, r.need)) END d
    FROM r{level} r JOIN g{level} g ON g.node = r.node AND g.rn = r.rn + 1)),
h{level} AS (SELECT g.node * 2 + side node, g.rn, CASE side WHEN 0 THEN l ELSE own - l END blocks FROM g{level} g JOIN r{level} r USING (node, rn), (VALUES (0), (1)) v(side)),"""
    return f"""
WITH RECURSIVE d0 AS (SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT size,
    md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(md5(text), 'null'))[1:16] k FROM documents),
d AS (SELECT *, row_number() OVER (PARTITION BY source, k, doc_id, size) i FROM d0),
s AS (SELECT source, sum(size)::BIGINT n FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) rn FROM s),
w AS (SELECT *, [{', '.join(f'{x}.0::DOUBLE' for x in WEIGHTS)}][(rn - 1) % {len(WEIGHTS)} + 1] w, {MOST} * n AS m FROM o),
p AS (SELECT *, row_number() OVER q pos, sum(m) OVER q - m below, (SELECT sum(w) FROM w) - sum(w) OVER q + w w_from, (SELECT sum(n) FROM s) total FROM w
      WINDOW q AS (ORDER BY m / w, rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
l AS (SELECT *, ({SHARE}::DOUBLE * total - below) / w_from lev FROM p),
f AS (SELECT arg_min(lev, pos) lev, min(pos) pos FROM l WHERE w * lev <= m),
t AS (SELECT l.source, l.rn, n, CASE WHEN f.pos IS NULL OR l.pos < f.pos THEN m::DOUBLE ELSE w * f.lev END target FROM l, f),
tq AS (SELECT *, least({MOST} * n, round(target)::BIGINT)::BIGINT q FROM t),
bk AS (SELECT greatest(1, sum(q)::BIGINT // {2**LEVELS * BLOCKS_A_SHARD}) bl FROM tq),
sb AS (SELECT rn, ((q + bl - 1) // bl)::BIGINT blocks FROM tq, bk),{tree}
cut AS (SELECT node shard, rn, sum(blocks) OVER z - blocks lo, sum(blocks) OVER z hi FROM h{LEVELS - 1} WINDOW z AS (PARTITION BY rn ORDER BY node)),
eb AS (SELECT rn, b, row_number() OVER (PARTITION BY rn ORDER BY md5('{SEED}:' || rn || ':' || b), b) - 1 r FROM (SELECT rn, unnest(range(0, blocks)) b FROM sb)),
bs AS (SELECT eb.rn, b, shard FROM eb JOIN cut ON eb.rn = cut.rn AND r >= lo AND r < hi),
c AS (SELECT row_number() OVER () rid, d.*, n source_size, target, q, rn, sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size, i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size off
      FROM d JOIN tq t ON d.source IS NOT DISTINCT FROM t.source),
ps AS (SELECT rid, rn, a, least(a + size, q) z FROM (SELECT *, off + e * source_size a FROM c, range({MOST}) x(e)) WHERE size > 0 AND a < q),
pb AS (SELECT rid, rn, a, z, unnest(range((a // bl)::BIGINT, ((z - 1) // bl)::BIGINT + 1)) b FROM ps, bk),
dr AS (SELECT rid, shard, (least(z, (pb.b + 1) * bl) - greatest(a, pb.b * bl))::BIGINT words FROM pb JOIN bs ON pb.rn = bs.rn AND pb.b = bs.b, bk),
su AS (SELECT rid, sum(words)::BIGINT taken, {', '.join(f'coalesce(sum(words) FILTER (shard = {k}), 0)::BIGINT s{k}' for k in ways)} FROM dr GROUP BY rid)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT taken, {" || ',' || ".join(f'coalesce(s{k}, 0)' for k in ways)} shard_words FROM c LEFT JOIN su USING (rid)
"""


OP5_SQL = _op5_sql()
