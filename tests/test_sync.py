"""The chunk table that follows its sources: add, change, remove, nothing to do, runs that die, runs that are repeated."""

import pytest
from pyspark.sql import functions as F

from echotable.sources import sync as sy


def sources(spark, said):
    return spark.createDataFrame([(h, f"f {t}", t) for h, t in said.items()], "audio_hash string, fingerprint string, text string")


def chunks(df):
    return df.select("audio_hash", F.posexplode(F.filter(F.split("text", " "), lambda w: w != "")).alias("nth", "word")).withColumn("chunk_id", F.concat_ws("-", "audio_hash", "nth"))


def held(spark, root):
    out = {}
    for r in sy.live(spark, root).orderBy("audio_hash", "nth").collect():
        out.setdefault(r["audio_hash"], []).append(r["word"])
    return {h: " ".join(w) for h, w in out.items()}


def test_follows_its_sources(spark, tmp_path):
    root = str(tmp_path)
    run = lambda said, batch, **how: sy.sync(spark, root, sources(spark, said), chunks, how.pop("settings", "s1"), batch, **how)
    first = {"a": "one two", "b": "three", "c": "four five six", "d": ""}
    assert run(first, "1") == {"mode": "bootstrap: nothing is there", "added": 4, "updated": 0, "removed": 0, "unchanged": 0, "inserted": 6, "deleted": 0}
    second = {"a": "one two", "b": "three more", "d": "", "e": "new"}
    report = run(second, "2")
    assert report == {"mode": "incremental", "added": 1, "updated": 1, "removed": 1, "unchanged": 2, "inserted": 3, "deleted": 4}
    assert held(spark, root) == {"a": "one two", "b": "three more", "e": "new"}
    before = sy.entry(spark, root)
    assert run(first, "2") == report and sy.entry(spark, root) == before  # a batch by a name that is there
    assert run(second, "3")["unchanged"] == 4 and sy.entry(spark, root) == before  # nothing to do
    assert run(second, "4", force=True)["updated"] == 4
    third = {**second, "a": "other", "b": "others"}
    assert run(third, "5", target="a")["updated"] == 1 and held(spark, root)["b"] == "three more"
    assert run({}, "6", target="e")["removed"] == 1 and "e" not in held(spark, root)
    assert run(third, "7", settings="s2")["mode"] == "rebuild: other settings" and held(spark, root) == {"a": "other", "b": "others", "e": "new"}
    assert sy.entry(spark, root)["chunks"] == 3 and len(sy.entry(spark, root)["parts"]) == 1
    run({"a": "x y z"}, "8")
    sy.compact(spark, root)
    assert held(spark, root) == {"a": "x y z"} and len(sy.entry(spark, root)["parts"]) == 1
    with pytest.raises(ValueError, match="isn't one"):
        sy.sync(spark, root, sources(spark, {"a": "x"}).union(sources(spark, {"a": "y"})), chunks, "s2", "9")


def test_runs_that_die_leave_the_version_before(spark, tmp_path):
    root = str(tmp_path)
    sy.sync(spark, root, sources(spark, {"a": "one", "b": "two"}), chunks, "s", "1")
    new = sources(spark, {"a": "one", "b": "changed", "c": "three"})

    def dies(df):
        raise RuntimeError("no more")

    def wrong(df):
        return chunks(df).withColumn("chunk_id", F.lit("the same"))

    def foreign(df):
        return chunks(df).withColumn("audio_hash", F.lit("z"))

    for making, error in ((dies, RuntimeError), (wrong, ValueError), (foreign, ValueError)):
        with pytest.raises(error):
            sy.sync(spark, root, new, making, "s", "2")
        assert held(spark, root) == {"a": "one", "b": "two"} and sy.entry(spark, root)["version"] == 1
    # dies after the part is staged and before the cutover
    real, sy._append = sy._append, lambda *_: (_ for _ in ()).throw(RuntimeError("no more"))
    try:
        with pytest.raises(RuntimeError):
            sy.sync(spark, root, new, chunks, "s", "2")
    finally:
        sy._append = real
    assert held(spark, root) == {"a": "one", "b": "two"}
    assert sy.sync(spark, root, new, chunks, "s", "2")["added"] == 1 and held(spark, root) == {"a": "one", "b": "changed", "c": "three"}


def test_follows_a_stream(spark, tmp_path):
    schema = "audio_hash string, fingerprint string, text string, at int, gone boolean"
    batches = [[("a", "1", "one", 1, False), ("b", "1", "two", 1, False), ("a", "2", "newer", 2, False)], [("b", None, None, 3, True), ("c", "1", "three", 3, False)]]
    root = f"{tmp_path}/table"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        sy.follow(stream, root, chunks, "s", f"{tmp_path}/check").awaitTermination()
        assert held(spark, root) == [{"a": "newer", "b": "two"}, {"a": "newer", "c": "three"}][i]


def test_packed_keys_come_back(spark):
    keys = ["", "0", "00", "0a", "0A", "a", "ab cd", "é", "0" * 64, "deadbeef", "\x01\x00", None]
    rows = spark.createDataFrame([(k,) for k in keys], "k string").withColumn("p", sy.packed(F.col("k"))).withColumn("b", sy.unpacked(F.col("p"))).collect()
    assert all(r["k"] == r["b"] for r in rows) and len({bytes(r["p"]) for r in rows if r["k"] is not None}) == len(keys) - 1
    assert {r["k"]: len(r["p"]) for r in rows if r["k"]}["0" * 64] == 33


def test_sources_are_read_once(spark, tmp_path):
    """What a run finds to do is written once: before, each of its steps read and shuffled all sources anew."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def marked(text):
        seen.add(1)
        return f"f {text}"

    for batch, said in (("1", {"a": "one two", "b": "three"}), ("2", {"a": "one two", "b": "three more", "c": "new"}), ("3", {"a": "one two", "b": "three more", "c": "new"})):
        before = seen.value
        sy.sync(spark, str(tmp_path), sources(spark, said).withColumn("fingerprint", marked("text")), chunks, "s", batch)
        assert seen.value - before == len(said)
    assert held(spark, str(tmp_path)) == {"a": "one two", "b": "three more", "c": "new"}
