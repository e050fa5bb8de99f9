"""Document fingerprints: invertible Bloom lookup tables over paragraph digests.

A table has three parts of equally many cells; each digest lies in one cell of
each part. A cell keeps the number of its digests, their exclusive or, and that of their check
hashes. Subtracting the tables of two versions leaves the digests that differ; a
cell with a single one gives it away, and removing it from its other cells
uncovers more. If that stops early, the tables were too small: larger ones are tried.

Cells are rows, so all of it is grouping. The digests lie in a table bucketed
by groups of documents; every grouping extends that key and every join has it as its
only key, so nothing is shuffled after the texts have met their successors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.llm.common import LAST_ID
from touchline.operators.ordered import ordered, with_previous
from touchline.sources.tables import materialise, run_table

PARTS = 3
CHECK = 77  # seed of the check hash; the parts' cell numbers use 0, 1 and 2
CELL = ["g", "rn", "pair", "size", "part", "cell"]


def paragraphs(text: Column) -> Column:
    """Distinct digests of the paragraphs: lines, cut after full stops that a blank follows."""
    pieces = F.split(F.replace(text, F.lit(". "), F.lit(".\n")), "\n")
    digests = F.transform(F.filter(pieces, lambda p: p != ""), lambda p: F.xxhash64(p))
    return F.coalesce(F.array_distinct(digests), F.array().cast("array<long>"))


def _cell(key: Column, part: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(part)), F.col("size")).cast("int")


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit(CHECK))


def _cells(digests: DataFrame) -> DataFrame:
    """Sum up rows (g, rn, pair, size, key, sign) to cells; a cell in which nothing is left has no row.

    ``size`` is the number of cells in each part.
    """
    key = F.col("key")
    placed = F.array(*[F.struct(F.lit(p).alias("part"), _cell(key, p).alias("cell")) for p in range(PARTS)])
    rows = digests.select("g", "rn", "pair", "size", "key", "sign", _check(key).alias("chk"), F.explode(placed).alias("at"))
    return _summed(rows.select("g", "rn", "pair", "size", "at.part", "at.cell", "sign", "key", "chk"))


def _summed(rows: DataFrame) -> DataFrame:
    found = rows.groupBy(*CELL).agg(
        F.sum("sign").alias("sign"), F.bit_xor("key").alias("key"), F.bit_xor("chk").alias("chk")
    )
    return found.filter("part < 0 OR sign <> 0 OR key <> 0 OR chk <> 0")


def _peel_part(cells: DataFrame, part: int) -> DataFrame:
    """Take the digests that are alone in a cell of one part out of all their cells.

    A digest has one cell in a part, so none is taken twice. Recovered digests
    are counted in rows of part -1 (added) and -2 (removed).
    """

    def row(where: Column, cell: Column, sign: Column, key: Column, chk: Column) -> Column:
        named = zip(("part", "cell", "sign", "key", "chk"), (where.cast("int"), cell, sign, key, chk))
        return F.struct(*[c.alias(n) for n, c in named])

    key, sign, chk = F.col("key"), F.col("sign"), F.col("chk")
    alone = (F.col("part") == part) & (F.abs("sign") == 1) & (chk == _check(key))
    nothing = F.lit(0).cast("long")
    others = [row(F.lit(p), _cell(key, p), -sign, key, chk) for p in range(PARTS) if p != part]
    found = row(F.when(sign > 0, -1).otherwise(-2), F.lit(0), sign, nothing, nothing)
    same = row(F.col("part"), F.col("cell"), sign, key, chk)
    rows = F.when(alone, F.array(found, *others)).otherwise(F.array(same))
    return _summed(cells.select("g", "rn", "pair", "size", F.explode(rows).alias("r")).select("g", "rn", "pair", "size", "r.*"))


def _differences(digests: DataFrame, turns: int) -> DataFrame:
    """g, rn, pair, added, removed, left (cells that could not be resolved)."""
    cells = _cells(digests)
    for _ in range(turns):
        for part in range(PARTS):
            cells = _peel_part(cells, part)
    count = lambda part: F.sum(F.when(F.col("part") == part, F.abs("sign")).otherwise(0))
    return cells.groupBy("g", "rn", "pair").agg(
        count(-1).alias("added"), count(-2).alias("removed"), F.count_if(F.col("part") >= 0).alias("left")
    )


def _versions(table: DataFrame, *versions: tuple[int, int, str, Column]) -> DataFrame:
    """Digest rows (g, rn, pair, size, key, sign) of (pair, sign, column, size), from one scan."""
    listed = F.array(
        *[
            F.struct(
                F.lit(pair).alias("pair"), F.lit(sign).cast("long").alias("sign"), size.cast("int").alias("size"),
                F.col(column).alias("keys"),
            )
            for pair, sign, column, size in versions
        ]
    )
    rows = table.select("g", "rn", *[c for c in ("pairs",) if c in table.columns], F.explode(listed).alias("v"))
    if "pairs" in table.columns:
        rows = rows.filter(F.array_contains("pairs", F.col("v.pair")))
    return rows.select("g", "rn", "v.pair", "v.size", F.explode("v.keys").alias("key"), "v.sign")


def _beside(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join on (g, rn) with g as the only key, by which both sides are dealt already."""
    other = right.withColumnsRenamed({"g": "_g", "rn": "_rn"})
    same = (F.col("g") == F.col("_g")) & (F.col("rn") - F.col("_rn") == 0)
    return left.join(other, same, how).drop("_g", "_rn")


def _with_next(docs: DataFrame, id_col: str, text_col: str, group: int) -> DataFrame:
    """g, rn, doc_id, text, next: each text with that of the following document.

    Documents are ordered by id in groups of ``group`` consecutive ids. The last one
    of a group is followed by the first one of the next group that is not empty.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    last = F.lit(LAST_ID) - F.pmod(F.xxhash64("text"), F.lit(1 << 40))
    rows = rows.withColumn("id", F.coalesce("doc_id", last)).withColumn("g", F.floor(F.col("id") / group))
    order = W.partitionBy("g").orderBy("id", F.xxhash64("text"))
    inside = rows.select(
        "g", "doc_id", "text", F.row_number().over(order).alias("rn"), F.lead("text").over(order).alias("next")
    )
    first = rows.withColumn("rn", F.row_number().over(order)).filter("rn = 1").select("g", F.col("text").alias("first"))
    groups = with_previous(ordered(rows.select("g").distinct(), F.col("g")), {"before": "g"})
    last = rows.agg(F.max("g").alias("last"))
    groups = groups.select("g", "before").join(F.broadcast(last))  # one row
    after = first.join(groups.select("g", F.coalesce("before", "last").alias("before")), "g")
    after = after.select(F.col("before").alias("g"), "first")
    return inside.join(after, "g").select(
        "g", "rn", "doc_id", "text", F.coalesce("next", "first").alias("next")
    )


def document_fingerprints(
    docs: DataFrame,
    cells: int = 4,
    growth: int = 4,
    turns: int = 4,
    group: int = 64,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Fingerprint each document and an edited version of it, and compare them.

    The edited text has its last floor(n / 2) code points replaced by the first as many
    (or all) of the next document by id; after the last comes the first.

    Args:
        cells: cells in each part of the table that is shown as the fingerprint.
        growth: two versions are subtracted in tables with room for all their
            digests; where peeling stops early all the same, the tables grow by this factor
            until it does not.
        turns: passes over the parts before a difference counts as unresolved.
        group: ids of one window; more make larger windows, fewer more boundaries.

    Returns:
        One row per row of ``docs``: ``doc_id``, ``n_chars``, ``edited_sha256``,
        ``fingerprint``, ``edited_fingerprint`` (the cells, as text), ``near_edited``,
        ``near_next`` (common digests over all digests, from the resolved difference
        with the edited text and with the next document; 1 for two texts without
        paragraphs), and ``edited_added``, ``edited_removed`` (digests the document has
        and the edited text lacks, and the reverse).

    A null text counts as an empty one. Rows with the same id follow each other in
    the order of their texts' hashes; rows without an id come last. Other
    columns are ignored. Runs jobs.
    """
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = _with_next(docs, id_col, text_col, group)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next", F.lit(1), half))
    texts = texts.withColumn("edited", edited).select(
        "g", "rn", "doc_id", n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        paragraphs(F.col("text")).alias("own"),
        paragraphs(F.col("edited")).alias("edit"),
        paragraphs(F.col("next")).alias("after"),
    )
    name = run_table(spark, "fingerprints")
    texts.repartition(buckets, "g").write.format("parquet").bucketBy(buckets, "g").saveAsTable(name)
    table = spark.table(name)

    shown = _cells(_versions(table, (0, 1, "own", F.lit(cells)), (1, 1, "edit", F.lit(cells))))
    place = F.hex((F.col("part") * cells + F.col("cell")).cast("long"))
    cell = F.concat_ws(".", place, "sign", F.hex("key"), F.substring(F.hex("chk"), 1, 8))

    def version(pair: int) -> Column:
        listed = F.collect_list(F.when(F.col("pair") == pair, cell))
        return F.array_join(F.sort_array(listed), " ")

    shown = shown.groupBy("g", "rn").agg(
        version(0).alias("fingerprint"), version(1).alias("edited_fingerprint")
    )

    room, open_rows, resolved = 1, table, None
    while True:
        sizes = [F.floor((F.size("own") + F.size(other)) / 2 + 3) * room for other in ("edit", "after")]
        digests = _versions(
            open_rows, (1, 1, "own", sizes[0]), (1, -1, "edit", sizes[0]), (2, 1, "own", sizes[1]), (2, -1, "after", sizes[1])
        )
        tried = materialise(_differences(digests, turns))
        done = tried.filter("left = 0").drop("left")
        resolved = done if resolved is None else resolved.union(done)
        failed = tried.filter("left > 0")
        if failed.isEmpty():
            break
        open_rows = _beside(table, failed.groupBy("g", "rn").agg(F.collect_list("pair").alias("pairs")), "inner")
        room *= growth

    counts = resolved.groupBy("g", "rn").agg(
        *[
            F.max(F.when(F.col("pair") == p, F.col(c))).alias(f"{c}{p}")
            for p in (1, 2)
            for c in ("added", "removed")
        ]
    )

    def near(pair: int, other: str) -> Column:
        differ = F.coalesce(F.col(f"added{pair}") + F.col(f"removed{pair}"), F.lit(0))
        total = F.col("n_own") + F.col(other)
        return F.when(total == 0, F.lit(1.0)).otherwise((total - differ) / (total + differ))

    base = table.select(
        "g", "rn", "doc_id", "n_chars", "edited_sha256", F.size("own").alias("n_own"), F.size("edit").alias("n_edit"),
        F.size("after").alias("n_after"),
    )
    return _beside(_beside(base, shown, "left"), counts, "left").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.coalesce("fingerprint", F.lit("")).alias("fingerprint"),
        F.coalesce("edited_fingerprint", F.lit("")).alias("edited_fingerprint"),
        near(1, "n_edit").alias("near_edited"),
        near(2, "n_after").alias("near_next"),
        F.coalesce("added1", F.lit(0)).alias("edited_added"),
        F.coalesce("removed1", F.lit(0)).alias("edited_removed"),
    )
