"""Mixing sources to target weights by Sainte-Lague apportionment.

Sources, in order of code points and null last, have the weights given, over
and over. They share all words by weight; a target stops at `ceiling` times its
source's words, and the excess is shared by weight among the others until none
is above (`water_level`). Rows are dealt to shards of about `SHARD_WORDS` words
of one source by a seeded hash, stand there in seeded order, and are cut into
blocks of `block` words; only a shard's last block may be shorter.

Blocks are then given out by highest quotients votes / (2k - 1): first to
sources (votes: the blocks their targets are worth), then, source by source, to
its shards (votes: their blocks). Most seats follow from a divisor that is
surely too large; only the quotients below it, at most about three a party, are
ranked, in one sort over all groups. In a shard with quota q of b blocks every
block is taken q div b times, and q mod b blocks, the first of a seeded
permutation, once more. So a source's words miss its target by little more than
a block for all its shards together, no document is taken more than `ceiling`
times, and a rerun takes the same words.

Only ids, sizes and hashes are shuffled. A shard's rows share a window; a hot
source is many shards, and rows of one id, or without one, are dealt by their
text as well. A row of more words than a shard is one of its own size. Rows
without words (null or blank text) take nothing and stay out of the windows;
a source of only such rows has target 0. Repeated rows are rows like others. An
empty table has no rows. Other columns are kept only if named.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlake.operators.scale import dense_index, lookup_join, materialize

WEIGHTS = (5, 2, 1)
CEILING = 3
BLOCK_WORDS = 16
SHARD_WORDS = 1 << 16
# Primes larger than a shard's blocks: multiplying by one permutes them.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
WORD = r"[^\x20\x09-\x0D]+"
NO_PIECES = "array<struct<block:bigint,first:bigint,n_words:bigint,times:bigint>>"


def count_words(text: Column) -> Column:
    """Words of a text, null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _hash(parts: str) -> str:
    """60 bits of the md5 of the texts, nulls left out."""
    return f"CAST(conv(substring(md5(concat_ws(':', {parts})), 1, 15), 16, 10) AS BIGINT)"


def source_name(source: Column) -> Column:
    """Sorts by code point, null last."""
    return F.coalesce(F.concat(F.lit("+"), source.cast("string")), F.lit("~"))


def water_level(sources: DataFrame, ceiling: int) -> tuple[int, int]:
    """(words left, weight left) once no target is above its ceiling. `sources`
    has size and weight. Ends after as many rounds as sources are capped at
    most, usually two or three."""
    total, weight = sources.agg(F.sum("size"), F.sum("weight")).first()
    rest, left = total or 0, weight or 0
    while rest and left:
        capped = F.col("size") * ceiling < F.col("weight").cast("double") * rest / left
        words, now = sources.agg(
            F.sum(F.when(capped, F.col("size"))), F.sum(F.when(~capped, F.col("weight")))
        ).first()
        if now is None or now == left:
            break
        rest, left = total - ceiling * (words or 0), now
    return rest, left


def with_targets(sources: DataFrame, weights: Sequence[int], ceiling: int) -> DataFrame:
    """Adds weight and target to one row per source (src, size)."""
    numbered = dense_index(sources, [F.asc("src")], "at")
    cycle = F.array(*[F.lit(w) for w in weights])
    weighed = numbered.withColumn("weight", F.get(cycle, F.pmod("at", F.lit(len(weights))).cast("int"))).drop("at")
    rest, left = water_level(weighed, ceiling)
    fair = F.col("weight").cast("double") * rest / max(left, 1)
    most = F.col("size") * ceiling
    return weighed.withColumn("target", F.when(most < fair, most.cast("double")).otherwise(fair))


def apportion(parties: DataFrame, groups: DataFrame) -> DataFrame:
    """Seats by Sainte-Lague's highest quotients. `parties` has grp, party and
    votes (double), `groups` one row per grp with seats; the result is
    `parties` with quota. Equal quotients go to the first party."""
    sums = parties.filter("votes > 0").groupBy("grp").agg(F.sum("votes").alias("_sum"), F.count("*").alias("_n"))
    whole = sums.join(groups.select("grp", "seats"), "grp")
    share = lookup_join(parties.filter("votes > 0"), whole, "grp", "party")
    # quotients above a divisor that gives out too few seats, and below one that gives too many
    bounded = materialize(
        share.selectExpr(
            "grp", "party", "votes", "seats",
            "CAST(greatest(floor(votes * greatest(seats - _n / 2D, 0D) / _sum + 0.5D) - 1, 0) AS BIGINT) AS _sure",
            "CAST(floor(votes * (seats + _n / 2D) / _sum + 0.5D) + 1 AS BIGINT) AS _most",
        ),
        "parties",
    )
    quotients = bounded.selectExpr(
        "grp", "party", "votes", "explode(sequence(_sure + 1, _most)) AS _k"
    ).selectExpr("grp", "party", "votes / (2 * _k - 1) AS _quotient")
    ranked = dense_index(quotients, [F.asc("grp"), F.desc("_quotient"), F.asc("party")], "_rank")
    open_ = bounded.groupBy("grp").agg((F.first("seats") - F.sum("_sure")).alias("_open"))
    open_ = ranked.groupBy("grp").agg(F.min("_rank").alias("_from")).join(open_, "grp")
    won = lookup_join(ranked, open_, "grp", "party").filter("_rank - _from < _open")
    won = won.groupBy("grp", "party").agg(F.count("*").alias("_won"))
    quotas = bounded.join(won, ["grp", "party"], "left").selectExpr(
        "grp", "party", "_sure + coalesce(_won, 0) AS quota"
    )
    return parties.join(quotas, ["grp", "party"], "left").withColumn("quota", F.coalesce("quota", F.lit(0)))


def mix(
    df: DataFrame,
    size: Column,
    source: str = "source",
    key: str = "doc_id",
    text: str = "text",
    weights: Sequence[int] = WEIGHTS,
    ceiling: int = CEILING,
    block: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
    seed: int = 42,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per row of `df`: the kept columns (key at least), size,
    source_size, target, shard (null without words) and pieces: what the mix
    takes of the row, as block (of its shard), first word in the row, n_words
    and times."""
    kept = [key, *[c for c in keep if c != key]]
    rows = df.select(
        F.struct(*kept).alias("row"),
        source_name(F.col(source)).alias("src"),
        size.cast("bigint").alias("size"),
        F.struct(F.lit(seed).alias("s"), F.col(key).cast("string").alias("k"), F.col(text).cast("string").alias("t")).alias("id"),
    ).selectExpr("row", "src", "size", f"{_hash('CAST(id.s AS STRING), id.k, id.t')} AS place")
    rows = materialize(rows, "mix-rows")
    sources = materialize(
        with_targets(rows.groupBy("src").agg(F.sum("size").alias("size")), weights, ceiling).selectExpr(
            "src", "size AS source_size", "target", f"CAST(ceil(size / {shard_words}) AS BIGINT) AS _shards"
        ),
        "sources",
    )
    known = lookup_join(rows, sources, "src", "place")
    worded = known.filter("size > 0").withColumn("shard", F.expr("pmod(place, _shards)"))
    quotas = shard_quotas(worded, sources, ceiling, block, seed)
    placed = worded.withColumn(
        "_start",
        F.expr(
            "sum(size) OVER (PARTITION BY src, shard ORDER BY place, size"
            " ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size"
        ),
    )
    times = "_quota div _blocks + IF((k * _prime + _offset) % _blocks < _quota % _blocks, 1, 0)"
    last = f"least((k + 1) * {block}, _start + size)"
    pieces = (
        f"filter(transform(sequence(_start div {block}, (_start + size - 1) div {block}), k -> named_struct("
        f"'block', k, 'first', greatest(k * {block} - _start, 0),"
        f" 'n_words', {last} - greatest(k * {block}, _start), 'times', {times})), x -> x.times > 0)"
    )
    head = ["row.*", "size", "source_size", "target"]
    taken = placed.join(quotas, ["src", "shard"]).selectExpr(*head, "shard", f"CAST({pieces} AS {NO_PIECES}) AS pieces")
    without = known.filter("size = 0").selectExpr(
        *head, "CAST(NULL AS BIGINT) AS shard", f"CAST(array() AS {NO_PIECES}) AS pieces"
    )
    return taken.unionByName(without)


def shard_quotas(worded: DataFrame, sources: DataFrame, ceiling: int, block: int, seed: int) -> DataFrame:
    """src, shard, its blocks, its quota of them and its permutation."""
    shards = materialize(
        worded.groupBy("src", "shard")
        .agg(F.sum("size").alias("_words"))
        .selectExpr("src", "shard", f"CAST(ceil(_words / {block}) AS BIGINT) AS _blocks"),
        "shards",
    )
    blocks = shards.groupBy("src").agg(F.sum("_blocks").alias("_all"))
    worth = materialize(
        sources.join(blocks, "src").selectExpr(
            "0 AS grp", "src AS party", "target / source_size * _all AS votes", "_all"
        ),
        "worth",
    )
    seats = round(round(worth.agg(F.sum("votes")).first()[0] or 0.0, 6))
    only = worth.sparkSession.range(1).selectExpr("CAST(id AS INT) AS grp", f"{seats} AS seats")
    given = materialize(
        apportion(worth, only).selectExpr("party AS grp", f"least(quota, _all * {ceiling}) AS seats"), "given"
    )
    cells = shards.selectExpr("src AS grp", "shard AS party", "CAST(_blocks AS DOUBLE) AS votes", "_blocks")
    mark = _hash(f"'{seed}', grp, CAST(party AS STRING)")
    primes = ", ".join(f"{p}L" for p in PRIMES)
    return materialize(
        apportion(cells, given)
        .selectExpr("grp AS src", "party AS shard", "_blocks", "quota AS _quota", f"{mark} AS _mark")
        .selectExpr(
            "src", "shard", "_blocks", "_quota", "_mark % _blocks AS _offset",
            f"get(array({primes}), CAST(_mark % {len(PRIMES)} AS INT)) % _blocks AS _prime",
        ),
        "quotas",
    )


def taken_words() -> Column:
    """Words that the mix takes of a row, repeats counted."""
    return F.aggregate(
        "pieces", F.lit(0).cast("bigint"), lambda own, x: own + x["n_words"] * x["times"]
    )


def mixed_texts(mixed: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The mix itself: key, shard, block, copy (from 0) and the words taken,
    joined by spaces. `mixed` kept the text."""
    words = mixed.select(
        key, "shard", F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("_words"), F.explode("pieces").alias("_p")
    )
    copies = F.sequence(F.lit(0).cast("bigint"), F.col("_p.times") - 1)
    return words.select(
        key,
        "shard",
        F.col("_p.block").alias("block"),
        F.explode(copies).alias("copy"),
        F.array_join(
            F.slice("_words", (F.col("_p.first") + 1).cast("int"), F.col("_p.n_words").cast("int")), " "
        ).alias("words"),
    )


def mix_sql(
    weights: Sequence[int] = WEIGHTS,
    ceiling: int = CEILING,
    block: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
    seed: int = 42,
) -> str:
    """The same mix of documents in SQL, with every quotient ranked."""

    def hashed(parts: str) -> str:
        return f"('0x' || substr(md5(concat_ws(':', {parts})), 1, 15))::BIGINT"

    def seats(name: str, parties: str, limit: str) -> str:
        return f"""
    {name}_ranked AS (
      SELECT grp, party, row_number() OVER (PARTITION BY grp ORDER BY votes / (2 * k - 1) DESC, party) AS place, seats
      FROM (SELECT *, unnest(range(1, most + 1)) AS k
            FROM (SELECT *, CAST(votes AS BIGINT) + count(*) OVER (PARTITION BY grp) + 2 AS most FROM {parties}))),
    {name} AS (
      SELECT p.*, least(coalesce(quota, 0), {limit}) AS quota
      FROM {parties} p LEFT JOIN (SELECT grp, party, count(*) AS quota FROM {name}_ranked WHERE place <= seats GROUP BY grp, party)
      USING (grp, party))"""

    primes = ", ".join(f"{p}::BIGINT" for p in PRIMES)
    return f"""
    WITH RECURSIVE rows AS (
      SELECT doc_id, coalesce('+' || source, '~') AS src,
        coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
        {hashed(f"'{seed}', CAST(doc_id AS VARCHAR), text")} AS place
      FROM documents),
    sources AS (
      SELECT src, CAST(sum(size) AS BIGINT) AS source_size,
        [{', '.join(map(str, weights))}][1 + (row_number() OVER (ORDER BY src) - 1) % {len(weights)}] AS weight
      FROM rows GROUP BY src),
    levels(step, rest, weight) AS (
      SELECT 0, CAST(sum(source_size) AS BIGINT), CAST(sum(weight) AS BIGINT) FROM sources
      UNION ALL
      SELECT step + 1,
        CAST((SELECT sum(source_size) FROM sources) - {ceiling} * sum(CASE WHEN capped THEN source_size ELSE 0 END) AS BIGINT),
        CAST(sum(CASE WHEN capped THEN 0 ELSE w END) AS BIGINT)
      FROM (SELECT l.*, s.weight AS w, source_size,
              source_size * {ceiling} < CAST(s.weight AS DOUBLE) * l.rest / l.weight AS capped
            FROM levels l, sources s)
      GROUP BY step, rest, weight
      HAVING sum(CASE WHEN capped THEN 0 ELSE w END) NOT IN (0, weight)),
    targets AS (
      SELECT src, source_size, least(CAST(source_size * {ceiling} AS DOUBLE),
          CAST(s.weight AS DOUBLE) * l.rest / l.weight) AS target
      FROM sources s, (SELECT * FROM levels ORDER BY step DESC LIMIT 1) l),
    worded AS (
      SELECT *, place % CAST(ceil(source_size / {shard_words}) AS BIGINT) AS shard
      FROM rows JOIN targets USING (src) WHERE size > 0),
    shards AS (
      SELECT src, shard, CAST(ceil(sum(size) / {block}) AS BIGINT) AS blocks FROM worded GROUP BY src, shard),
    worth AS (
      SELECT 0 AS grp, src AS party, target / source_size * all_blocks AS votes, all_blocks,
        CAST(round(sum(target / source_size * all_blocks) OVER (), 6) AS BIGINT) AS seats
      FROM targets JOIN (SELECT src, CAST(sum(blocks) AS BIGINT) AS all_blocks FROM shards GROUP BY src) USING (src)),{seats('given', 'worth', f'all_blocks * {ceiling}')},
    cells AS (
      SELECT src AS grp, shard AS party, CAST(blocks AS DOUBLE) * {ceiling} AS votes, blocks, quota AS seats
      FROM shards JOIN (SELECT party AS src, quota FROM given) USING (src)),{seats('dealt', 'cells', f'blocks * {ceiling}')},
    quotas AS (
      SELECT grp AS src, party AS shard, blocks, quota, mark % blocks AS shift,
        [{primes}][1 + mark % {len(PRIMES)}] % blocks AS prime
      FROM (SELECT *, {hashed(f"'{seed}', grp, CAST(party AS VARCHAR)")} AS mark FROM dealt)),
    placed AS (
      SELECT *, CAST(sum(size) OVER (PARTITION BY src, shard ORDER BY place, size
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS BIGINT) AS first
      FROM worded JOIN quotas USING (src, shard)),
    taken AS (
      SELECT doc_id, size, source_size, target, CAST(list_sum(list_transform(
          range(first // {block}, (first + size - 1) // {block} + 1),
          lambda k: (least((k + 1) * {block}, first + size) - greatest(k * {block}, first))
            * (quota // blocks + CASE WHEN (k * prime + shift) % blocks < quota % blocks THEN 1 ELSE 0 END)
        )) AS BIGINT) AS taken
      FROM placed)
    SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, taken FROM taken
    UNION ALL
    SELECT doc_id, CAST(size AS BIGINT), source_size, target, 0 FROM rows JOIN targets USING (src) WHERE size = 0"""
