"""Queries of the llm operators over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetlake.llm import mix, setjoin, split, tokens
from facetlake.sources.tables import table


def claim_members(spark: SparkSession, folder: str) -> DataFrame:
    """(id, space, indices): what a claim selects, a row per membership whose part is known."""
    batch = table(spark, folder, "example_annotation_batch").where("annotation_uid is not null")
    part = table(spark, folder, "asset_part").select(F.col("asset_part_id").alias("part"), "asset_id", F.col("part_path").alias("path"))
    named = part.join(table(spark, folder, "asset").select("asset_id", F.col("uri").alias("uri")), "asset_id").groupBy("uri", "path").agg(F.min("part").alias("by_uri"))
    m = batch.select(F.col("annotation_uid").alias("id"), F.explode("memberships").alias("m")).where("m is not null")
    m = m.select("id", "m.asset_part_id", F.col("m.asset_uri").alias("uri"), F.col("m.part_path").alias("path"), F.col("m.element_indices").alias("indices"))
    by_id = m.where("asset_part_id is not null").join(part.select(F.col("part").alias("asset_part_id")).distinct(), "asset_part_id", "left_semi").select("id", F.col("asset_part_id").alias("space"), "indices")
    return by_id.unionByName(m.where("asset_part_id is null").join(named, ["uri", "path"]).select("id", F.col("by_uri").alias("space"), "indices"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = setjoin.similar_pairs(claim_members(spark, folder), 0.75)
    return pairs.select(F.col("id_a").alias("annotation_uid_a"), F.col("id_b").alias("annotation_uid_b"))


def p5_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Each claim with the class of its equal sets and the number of other classes its class is similar to."""
    classes, membership = setjoin.set_classes(setjoin.united_sets(claim_members(spark, folder)))
    pairs = setjoin.similar_classes(classes, 0.75)
    links = pairs.select(F.explode(F.array("a", "b")).alias("sid")).groupBy("sid").agg(F.count(F.lit(1)).alias("n_links"))
    return membership.join(links, "sid", "left").select(F.col("id").alias("annotation_uid"), F.col("sid").alias("class_uid"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The ids of every text; those of NULL and of the empty text are the empty list."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return docs.mapInArrow(tokens.ids_mapper(tokens.vocabulary(spark)), "doc_id long, ids array<int>")


def token_counts(spark: SparkSession, folder: str, sources: list[str]) -> DataFrame:
    """Sizes in tokens of the documents of the sources; others are not encoded."""
    docs = table(spark, folder, "documents").where(F.col("source").isin(sources)).select("text", "doc_id", "source", "lang", "kind")
    return docs.mapInArrow(tokens.counts_mapper(tokens.vocabulary(spark)), "n_tokens long, doc_id long, source string, lang string, kind string")


def _mix(spark: SparkSession, folder: str) -> mix.Mix:
    targets = table(spark, folder, "mix_target")
    names = [r["source"] for r in targets.where("source is not null").select("source").distinct().limit(mix.MOST_SOURCES + 1).collect()]
    return mix.mix_sources(token_counts(spark, folder, names), targets)


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Every document that is taken, with its number of copies."""
    return _mix(spark, folder).documents


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual share of each source, and what total each would allow."""
    return _mix(spark, folder).shares


def p8_marginals(spark: SparkSession, folder: str) -> DataFrame:
    """How far sources, languages and topics are from what they aim at."""
    return _mix(spark, folder).marginals


def p9_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of every document over the limit of its kind."""
    # The limit table has a row per kind; a longer one is an error, not a cut.
    rows = table(spark, folder, "split_limit").where("kind is not null and max_tokens > 0").limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("a split table names at most 10,000 kinds")
    limits = {r["kind"]: (r["max_tokens"], r["overlap_tokens"] or 0) for r in rows}
    docs = table(spark, folder, "documents").select("doc_id", "kind", "text")
    # A token has at least one byte, so a text of no more bytes than its limit has no more tokens either.
    least = min((m for m, _ in limits.values()), default=0)
    docs = docs.where(F.col("kind").isin(list(limits)) & (F.octet_length("text") > least))
    return docs.mapInArrow(split.pieces_mapper(tokens.vocabulary(spark), limits), split.PIECES)


def queries() -> dict:
    names = [p5_found, p5_classes, p7_ids, p8_mix, p8_shares, p8_marginals, p9_pieces]
    return {f.__name__: f for f in names}


_SETS = """named AS (SELECT uri, part_path, min(asset_part_id) part FROM asset_part JOIN asset USING (asset_id) GROUP BY ALL),
m AS (SELECT annotation_uid, unnest(memberships) x FROM example_annotation_batch WHERE annotation_uid IS NOT NULL),
el AS (SELECT DISTINCT uid, part, i FROM (SELECT annotation_uid uid, x.asset_part_id part, unnest(x.element_indices) i FROM m WHERE x.asset_part_id IN (SELECT asset_part_id FROM asset_part)
UNION ALL SELECT annotation_uid, n.part, unnest(x.element_indices) FROM m JOIN named n ON n.uri = x.asset_uri AND n.part_path = x.part_path WHERE x.asset_part_id IS NULL) WHERE i IS NOT NULL),
size AS (SELECT uid, count(*) n FROM el GROUP BY uid)"""
ORACLE = {
    "p5_found": f"""WITH {_SETS}, shared AS (SELECT a.uid a, b.uid b, count(*) k FROM el a JOIN el b ON a.part = b.part AND a.i = b.i AND a.uid < b.uid GROUP BY ALL)
SELECT a AS annotation_uid_a, b AS annotation_uid_b FROM shared JOIN size x ON x.uid = a JOIN size y ON y.uid = b WHERE k >= 0.75 * (x.n + y.n - k)""",
    "p5_classes": f"""WITH {_SETS}, whole AS (SELECT uid, string_agg(part || ':' || i, ',' ORDER BY part, i) s, count(*) n FROM el GROUP BY uid), class AS (SELECT s, min(uid) c FROM whole GROUP BY s), own AS (SELECT uid, c, n FROM whole JOIN class USING (s)),
rep AS (SELECT el.* FROM el JOIN own ON own.uid = el.uid AND own.c = el.uid), shared AS (SELECT a.uid a, b.uid b, count(*) k FROM rep a JOIN rep b ON a.part = b.part AND a.i = b.i AND a.uid <> b.uid GROUP BY ALL),
link AS (SELECT a, count(*) m FROM shared JOIN size x ON x.uid = a JOIN size y ON y.uid = b WHERE k >= 0.75 * (x.n + y.n - k) GROUP BY a)
SELECT uid AS annotation_uid, c AS class_uid, CAST(coalesce(m, 0) AS BIGINT) AS n_links FROM own LEFT JOIN link ON a = c""",
}
