"""What the operators of this subpackage share: reading, cutting lineage, words, size-checked semi joins."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Ids that one broadcast may hold: 2 million longs are 16 MB. Beyond it the same join is shuffled.
BROADCAST_IDS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; only a session that names none (tests, local mode) gets its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="echotable-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def stored(df: DataFrame) -> DataFrame:
    """df, written as Parquet under the shared folder and read again.

    Later stages depend on the files alone, so a lost executor costs a re-read and never a re-computation.
    Like Spark's own checkpoints the files stay until the folder is cleaned.
    """
    path = f"{shared_dir(df.sparkSession)}/echotable/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def measured(df: DataFrame, **figures: Column) -> tuple[DataFrame, dict]:
    """stored(df) and aggregates of its rows, all in the one job that writes them."""
    seen = Observation()
    out = stored(df.observe(seen, *[c.alias(name) for name, c in figures.items()]))
    return out, seen.get


def _by_ids(df: DataFrame, columns: str | list[str], ids: DataFrame, most: int, how: str, n: int | None) -> DataFrame:
    columns = [columns] if isinstance(columns, str) else columns
    most //= len(columns)
    small = (ids.limit(most + 1).count() if n is None else n) <= most
    names = [f"id_{uuid.uuid4().hex}" for _ in columns]  # whatever columns df has
    ids = ids.select([F.col(c).alias(name) for c, name in zip(ids.columns, names, strict=False)])
    on = [df[c] == F.col(name) for c, name in zip(columns, names, strict=True)]
    return df.join(F.broadcast(ids) if small else ids, on, how)


def only_ids(df: DataFrame, columns: str | list[str], ids: DataFrame, most: int = BROADCAST_IDS, n: int | None = None) -> DataFrame:
    """Rows of df whose columns are in ids (its first columns, longs, distinct, already stored).

    The ids are broadcast when their number, counted here or given as n, proves that they fit; otherwise both sides are shuffled.
    """
    return _by_ids(df, columns, ids, most, "left_semi", n)


def without_ids(df: DataFrame, columns: str | list[str], ids: DataFrame, most: int = BROADCAST_IDS, n: int | None = None) -> DataFrame:
    """Rows of df whose columns aren't in ids, like only_ids; rows with a null there stay."""
    return _by_ids(df, columns, ids, most, "left_anti", n)


def text_hash(text_col: str) -> Column:
    """With the id it names a row: rows of one id that differ in their text are different documents."""
    return F.xxhash64(F.col(text_col).cast("string"))


def rows_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """documents_of with `row`, which tells rows of one id apart unless they repeat the text too."""
    return documents_of(docs, id_col, text_col).withColumn("row", text_hash("text"))


def documents_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator reads, under its own names, whatever else docs holds."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def word_list(text: str | None, lower: bool = False) -> list[bytes]:
    r"""The words `[^\x20\x09-\x0D]+` of a text in UTF-8; with lower, A-Z are lower-cased before."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return (data.lower() if lower else data).split()


def hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def grams(hashes: np.ndarray, n: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Rabin-Karp hashes of all runs of n words, modulo 2**64, made by doubling; then mixed so that all bits count."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    # power[k]: hashes of runs of 2**k words; the run of n is put together from its binary digits
    total, width, run, length = None, 0, hashes, 1
    rest = n
    while rest:
        if rest & 1:
            total = run[: len(hashes) - width - length + 1] if total is None else total[: len(hashes) - width - length + 1] * _power(base, length) + run[width : width + len(hashes) - width - length + 1]
            width += length
        rest >>= 1
        if rest:
            run = run[:-length] * _power(base, length) + run[length:]
            length *= 2
    return mixed(total[:count])


def _power(base: int, n: int) -> np.uint64:
    return np.uint64(pow(base, n, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
