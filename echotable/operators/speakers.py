"""Speaker embeddings: pooling, cosine pairs across files, average linkage, pair distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import stored


def norm(v: str) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def pool(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """Length-one vectors averaged by weight (plainly if no weight is positive), and brought to length one again.

    Dimensions are summed apart, so that a key with very many vectors is added up before the shuffle.
    """
    n = norm("vector")
    rows = vectors.select(*keys, "weight", F.posexplode(F.transform("vector", lambda x: x / (n + 1e-12))).alias("d", "x"))
    total = F.sum("weight")
    mean = F.when(total > 0, F.sum(F.col("x") * F.col("weight")) / total).otherwise(F.avg("x"))
    m = rows.groupBy(*keys, "d").agg(mean.alias("m"))
    v = m.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda s: s["m"]).alias("vector"))
    length = norm("vector")
    return v.withColumn("vector", F.transform("vector", lambda x: x / (length + 1e-12)))


def pairs(pooled: DataFrame, cut: float) -> DataFrame:
    """Cosine distances of the speakers of different files, by place: (a_file, a_speaker, b_file, b_speaker, distance, close).

    All pairs are wanted, so files are dealt into blocks and pairs of blocks joined by equality; each task meets two blocks.
    """
    blocks = 16
    p = pooled.withColumn("block", F.pmod(F.xxhash64("file_id"), F.lit(blocks)).cast("int"))
    ids = F.sequence(F.lit(0), F.lit(blocks - 1))
    side = lambda x: [F.col(c).alias(f"{x}_{c}") for c in ("file_id", "speaker", "vector", "block")]
    a = p.select(*side("a"), F.explode(ids).alias("other")).withColumn("key", F.col("a_block") * blocks + F.col("other"))
    b = p.select(*side("b"), F.explode(ids).alias("other")).withColumn("key", F.col("other") * blocks + F.col("b_block"))
    j = a.drop("other").join(b.drop("other"), "key").where("a_file_id < b_file_id")
    d = 1 - dot("a_vector", "b_vector") / (norm("a_vector") * norm("b_vector"))
    return j.select(F.col("a_file_id").alias("a_file"), "a_speaker", F.col("b_file_id").alias("b_file"), "b_speaker", d.alias("distance"), (d <= cut).alias("close"))


def meetings(rows: DataFrame, keys: list[str], per_block: int = 1000) -> DataFrame:
    """Each two speakers of different files under equal keys, once: a_ and b_ file_id, speaker, vector, a the smaller.

    The rows of a key are dealt into blocks of about `per_block`, and pairs of blocks joined by equality, so that a task
    meets two blocks however many rows a key has. What is done with the pairs is up to the caller: filter or aggregate them.
    """
    most = rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 1
    blocks = -(-most // per_block)
    block = F.pmod(F.xxhash64("file_id", "speaker"), F.lit(blocks)).cast("int")
    side = lambda x: [F.col(c).alias(f"{x}_{c}") for c in ("file_id", "speaker", "vector")]
    a = rows.select(*keys, *side("a"), block.alias("i"), F.explode(F.sequence(block, F.lit(blocks - 1))).alias("j"))
    b = rows.select(*keys, *side("b"), block.alias("j"), F.explode(F.sequence(F.lit(0), block)).alias("i"))
    return a.join(b, [*keys, "i", "j"]).where("a_file_id <> b_file_id AND (i < j OR a_file_id < b_file_id)").drop("i", "j")


def _unit(rows: DataFrame) -> DataFrame:
    n = norm("vector")
    return rows.withColumn("vector", F.transform("vector", lambda x: x / F.greatest(n, F.lit(1e-12))))


def _merged(sums: DataFrame, merges: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and vector sums once two clusters of each merge are one: a group has at most two rows."""
    to = F.coalesce("a", "cluster").alias("cluster")
    moved = sums.join(merges, (sums["scope"] == merges["m_scope"]) & (sums["cluster"] == merges["b"]), "left").select(*[to if k == "cluster" else k for k in keys], "n", "v")
    return moved.groupBy(*keys).agg(F.sum("n").alias("n"), F.collect_list("v").alias("vs")).select(*keys, "n", F.reduce(F.slice("vs", 2, 1), F.col("vs")[0], lambda s, v: F.zip_with(s, v, lambda x, y: x + y)).alias("v"))


def _merges(links: DataFrame, totals: DataFrame, parts: DataFrame, cut: float) -> DataFrame:
    """Linked clusters (m_scope, a, b) at most `cut` apart of which each is the other's nearest; equal distances go by name.

    The mean distance follows from sums of vectors, as the sum of all dot products is the dot product of the sums.
    Pairs of one file count as far apart, so their share is taken out and replaced.
    """
    far = max(cut + 1, 2.0)
    of = lambda df, x, *more: df.select(F.col("scope").alias(f"{x}_scope"), F.col("cluster").alias(f"{x}_c"), F.col("n").alias(f"{x}_n"), F.col("v").alias(f"{x}_v"), *[F.col(c).alias(f"{x}_{c}") for c in more])
    at = lambda x, end: (F.col("scope") == F.col(f"{x}_scope")) & (F.col(end) == F.col(f"{x}_c"))
    key = ["scope", "a", "b"]
    shared = links.join(of(parts, "p", "file_id"), at("p", "a")).join(of(parts, "q", "file_id"), at("q", "b") & (F.col("p_file_id") == F.col("q_file_id")))
    shared = shared.groupBy(*key).agg(F.sum(F.col("p_n") * F.col("q_n")).alias("same"), F.sum(dot("p_v", "q_v")).alias("same_dot"))
    shared = shared.select(*[F.col(k).alias(f"s_{k}") for k in key], "same", "same_dot")
    all_ = links.join(of(totals, "p"), at("p", "a")).join(of(totals, "q"), at("q", "b"))
    all_ = all_.join(shared, (F.col("scope") == F.col("s_scope")) & (F.col("a") == F.col("s_a")) & (F.col("b") == F.col("s_b")), "left")
    n, same, same_dot = F.col("p_n") * F.col("q_n"), F.coalesce("same", F.lit(0)), F.coalesce("same_dot", F.lit(0.0))
    d = F.round((n - same - (dot("p_v", "q_v") - same_dot) + same * far) / n, 12)
    near = all_.select("scope", F.struct(d.alias("d"), "a", "b").alias("l")).where(F.col("l.d") <= cut)
    best = near.select("scope", "l", F.explode(F.array("l.a", "l.b")).alias("end")).groupBy("scope", "end").agg(F.min("l").alias("l"))
    return best.groupBy("scope", "l").count().where("count = 2").select(F.col("scope").alias("m_scope"), "l.a", "l.b")


def clusters(pooled: DataFrame, scope: str, cut: float = 0.35) -> DataFrame:
    """(scope, file_id, speaker, cluster): average linkage of each scope's speakers, who are all different (file_id, speaker).

    The nearest clusters by mean cosine distance merge until it exceeds the cut; pairs of one file count as far apart. A
    cluster is named by its smallest member, "file_id/speaker"; an empty table gives none. Clusters at most the cut apart have two
    members at most the cut apart, so only clusters linked by such a pair are compared. In each round all clusters
    that are each other's nearest merge, which with mean distances gives what merging one pair after the other gives.
    What a round leaves (links, one vector sum a cluster and file) is written to the shared folder.
    """
    rows = stored(_unit(pooled.select(F.col(scope).alias("scope"), "file_id", "speaker", "vector")))
    node = F.struct("file_id", "speaker")
    ends = [F.struct(F.col(f"{x}_file_id").alias("file_id"), F.col(f"{x}_speaker").alias("speaker")) for x in "ab"]
    close = meetings(rows, ["scope"]).where(F.round(1 - dot("a_vector", "b_vector"), 12) <= cut)
    links = stored(close.select("scope", F.least(*ends).alias("a"), F.greatest(*ends).alias("b")))
    parts = rows.select("scope", node.alias("cluster"), "file_id", F.lit(1).cast("long").alias("n"), F.col("vector").alias("v"))
    totals = parts.drop("file_id")
    names = rows.select("scope", node.alias("node"), node.alias("cluster"))
    while True:
        merges = stored(_merges(links, totals, parts, cut))
        if merges.isEmpty():
            return names.select(F.col("scope").alias(scope), "node.file_id", "node.speaker", F.concat_ws("/", "cluster.file_id", "cluster.speaker").alias("cluster"))
        to = merges.select("m_scope", F.col("b").alias("gone"), F.col("a").alias("to"))
        moved = links
        for end in ("a", "b"):
            moved = moved.join(to, (F.col("scope") == F.col("m_scope")) & (F.col(end) == F.col("gone")), "left").withColumn(end, F.coalesce("to", end)).drop("m_scope", "gone", "to")
        links = stored(moved.where("a <> b").select("scope", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        parts = stored(_merged(parts, merges, ["scope", "cluster", "file_id"]))
        totals = stored(_merged(totals, merges, ["scope", "cluster"]))
        names = stored(names.join(to, (F.col("scope") == F.col("m_scope")) & (F.col("cluster") == F.col("gone")), "left").select("scope", "node", F.coalesce("to", "cluster").alias("cluster")))


def spread(members: DataFrame, keys: list[str]) -> DataFrame:
    """Least, mean and greatest distance of members (keys, file_id, speaker, vector) of different files, in each cluster."""
    d = 1 - dot("a_vector", "b_vector")
    pair = meetings(_unit(members), keys).select(*keys, d.alias("distance"))
    return pair.groupBy(*keys).agg(F.min("distance").alias("least"), F.avg("distance").alias("mean"), F.max("distance").alias("most"), F.count("*").alias("pairs"))
